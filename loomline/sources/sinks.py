"""Sinks that show their result only once it is whole: one file a document, and versions of a table behind a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loomline.sources.stores import open_store

#: Characters of an id that may stand in a file's name; others become their code in the form %xxxx.
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")


def file_name(doc_id) -> str:
    """A file's name for an id; different ids have different names."""
    return "".join(c if c in PLAIN else f"%{ord(c):04x}" for c in str(doc_id)) + ".txt"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]
    folder: str


class TextFiles(DataSource):
    """Writer of columns id and text: a file ``<id>.txt`` a row below the option ``path``. Register with ``spark.dataSource.register``.

    Tasks write into a staging folder of the job, each into a folder of its own, so that a repeated or a lost task leaves nothing behind; the
    commit moves the files of the tasks that count to their places, an abort removes the staging folder. Of rows with one id, one
    that comes later in the commit's order wins. Files of earlier jobs stay, unless a new one has the same name.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"))


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"{path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        fs, at = open_store(folder)
        fs.create_dir(at, recursive=True)
        names = []
        for row in iterator:
            if row["id"] is None:
                raise ValueError("a document without an id has no file")
            names.append(file_name(row["id"]))
            with fs.open_output_stream(f"{at}/{names[-1]}") as f:
                f.write((row["text"] or "").encode())
        return _Written(sorted(set(names)), folder)

    def commit(self, messages: list) -> None:
        fs, at = open_store(self.path)
        for m in messages:
            if m is not None:
                _, source = open_store(m.folder)
                for name in m.names:
                    fs.move(f"{source}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, at = open_store(self.staging)
        if fs.get_file_info(at).type.name == "Directory":
            fs.delete_dir(at)


MANIFEST = "current.json"


def write_version(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write ``df`` as the next version of the table at ``path`` and return its number; the last ``keep`` versions before it stay as backups.

    The version is written beside the others; only then is the manifest replaced, in one step, so that readers see the old or the new table, and
    a job that fails changes nothing that they see. ``df`` may read the table itself. One writer at a time.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = _manifest(spark, path)
    n = (old or {"version": 0})["version"] + 1
    target = f"{path.rstrip('/')}/v{n:08d}"
    df.write.mode("overwrite").parquet(target)  # what a failed attempt left there was never shown
    kept = [*((old or {}).get("versions") or []), n][-(keep + 1) :]
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"version": n, "versions": kept}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")), options)
    for v in (old or {}).get("versions") or []:
        if v not in kept:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{v:08d}"), True)
    return n


def _manifest(spark: SparkSession, path: str) -> dict | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at ``path`` as its manifest says, or one of the versions that it keeps."""
    m = _manifest(spark, path)
    if m is None or (version is not None and version not in m["versions"]):
        raise FileNotFoundError(f"no such version at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/v{version or m['version']:08d}")
