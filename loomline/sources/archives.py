"""Lines of the text files inside archives: zip by its directory, one task a member; tar (packed or not) from front to back.

Only the paths of the archives are listed by the driver. A first job reads the directories (the tail of a zip, nothing of a tar), a second one the members, each
as a stream of lines that is never held as a whole.
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.stores import open_store

#: Lines handed on at a time.
AT_ONCE = 10_000
#: Bytes of a zip file without a member.
EMPTY = 22
#: Name parts of members that are never read.
SKIPPED = ("README", "__MACOSX", ".DS_Store")


def members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, size`` of every member of the zip files at ``path`` (one, a glob, a folder); a tar is one row without a member, since only reading it tells."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for archive in b.column(0).to_pylist():
                fs, at = open_store(archive)
                if at.lower().endswith(".zip"):
                    with fs.open_input_file(at) as f:
                        if f.size() <= EMPTY:
                            continue
                        z = zipfile.ZipFile(f)
                        out += [(archive, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
                elif at.lower().endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2")):
                    out.append((archive, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["archive", "member", "size"])

    return found.mapInArrow(listed, "archive string, member string, size long")


def _wanted(name: str, suffix: str) -> bool:
    return name.endswith(suffix) and not any(s in name for s in SKIPPED)


def archive_lines(spark: SparkSession, path: str, suffix: str = ".txt", prefer: str | None = None) -> DataFrame:
    """``archive, member, line, value`` of the members that end in ``suffix``, without read-me files and the like; lines from 0, without their ends.

    With ``prefer``, an archive that has members whose name holds it gives these only (a tar, whose members show as they pass, is filtered
    after reading). Bytes that are no UTF-8 are replaced. Archives without a member give no rows.
    """
    listed = members(spark, path).where(F.col("member").isNull() | (F.endswith("member", F.lit(suffix)) & ~F.rlike("member", F.lit("|".join(map(_quoted, SKIPPED))))))
    if prefer is not None:
        listed = _preferred(listed, prefer)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, member in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = open_store(archive)
                if member is not None:
                    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(member) as m:
                        yield from _lines(archive, member, m)
                else:
                    with fs.open_input_stream(at, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                        for info in t:
                            if info.isfile() and _wanted(info.name, suffix):
                                yield from _lines(archive, info.name, t.extractfile(info))

    # a task a member, whatever their sizes
    n = max(1, listed.count())
    out = listed.select("archive", "member").repartition(min(n, 10_000)).mapInArrow(read, "archive string, member string, line long, value string")
    if prefer is not None:
        tar = F.col("archive").rlike(r"(?i)\.(tar|tgz|tar\.gz|tar\.bz2)$")
        out = out.where(~tar).unionByName(_preferred(out.where(tar), prefer))
    return out


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s)


def _preferred(df: DataFrame, prefer: str) -> DataFrame:
    """Of an archive with members whose names hold ``prefer`` only these."""
    has = df.where(F.contains("member", F.lit(prefer))).select("archive").distinct()
    return df.join(has.withColumn("_has", F.lit(True)), "archive", "left").where(F.col("_has").isNull() | F.contains("member", F.lit(prefer)) | F.col("member").isNull()).drop("_has")


def _cut(stream) -> Iterator[bytes]:
    """Lines of a stream that can only be read forwards, without their line feeds."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _lines(archive: str, member: str, stream) -> Iterator[pa.RecordBatch]:
    held: list[str] = []
    done = 0
    for line in _cut(stream):
        held.append(line.decode("utf-8", "replace").rstrip("\r"))
        if len(held) == AT_ONCE:
            yield _batch(archive, member, done, held)
            done, held = done + len(held), []
    if held:
        yield _batch(archive, member, done, held)


def _batch(archive: str, member: str, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([member] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], names=["archive", "member", "line", "value"])
