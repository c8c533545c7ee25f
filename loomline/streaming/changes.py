"""Files that are changed in place, as a stream, and the progress of queries.

    spark.dataSource.register(ChangedFiles)
    files = spark.readStream.format("changed_files").option("path", folder).load()   # a row for each time a file's stamp moves
    changed(files)                                                                    # a row for each change of content

The built-in file source knows a file by its path and never looks again. This one goes by time stamps: its offset is the latest stamp seen and
how many files have it, so the offset stays small however many files there are. A stamp that moves without a change (or a file read twice
at a boundary) is told by the content's hash, kept as state by path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.sources.stores import open_store

SCHEMA = "path string, stamp long, text string"


class ChangedFiles(DataSource):
    """Files below the option ``path`` (a file or a folder) whose name ends in the option ``suffix``: path, stamp (nanoseconds), text."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("suffix", ""))


#: Files that a task reads.
FILES = 64


class _Some(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceStreamReader):
    """The driver lists names and stamps; tasks read the files."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def _listed(self) -> list[tuple[int, str]]:
        import pyarrow.fs as pafs

        fs, at = open_store(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        return sorted((i.mtime_ns, i.path) for i in found if i.is_file and i.path.endswith(self.suffix))

    def initialOffset(self) -> dict:
        return {"stamp": -1, "files": 0}

    def latestOffset(self) -> dict:
        listed = self._listed()
        if not listed:
            return self.initialOffset()
        return {"stamp": listed[-1][0], "files": sum(s == listed[-1][0] for s, _ in listed)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [(s, p) for s, p in self._listed() if start["stamp"] <= s <= end["stamp"]]
        return [_Some(files[k : k + FILES]) for k in range(0, len(files), FILES)]

    def read(self, partition: _Some) -> Iterator[tuple]:
        fs, _ = open_store(self.path)
        for stamp, path in partition.files:
            try:
                with fs.open_input_stream(path) as f:
                    yield path, stamp, f.read().decode("utf-8", "replace")
            except FileNotFoundError:  # gone since it was listed
                continue


def changed(files: DataFrame) -> DataFrame:
    """``doc_id`` (path), ``text`` and ``version`` (from 1) of each change of a file's content; untouched files and moved stamps give nothing.

    The state is a hash and a number a path. Of several readings of a file in one batch the latest stamp counts.
    """

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        last = rows.sort_values("stamp").iloc[-1]
        h, version = state.get if state.exists else (None, 0)
        if last["h"] != h:
            state.update((last["h"], version + 1))
            yield pd.DataFrame({"doc_id": [key[0]], "text": [last["text"]], "version": [version + 1]})

    keyed = files.withColumn("h", F.sha2("text", 256)).groupBy("path")
    return keyed.applyInPandasWithState(one, "doc_id string, text string, version long", "h string, version long", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Tells after every batch of a query how far it is: number, rows, rows a second, seconds so far; kept in ``lines``, and passed to ``say``."""

    def __init__(self, say: Callable[[str], None] | None = None):
        super().__init__()
        self.say, self.lines, self.seconds, self.rows = say, [], {}, {}

    def onQueryStarted(self, event) -> None:
        self.seconds[str(event.id)], self.rows[str(event.id)] = 0.0, 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:
            return
        k = str(p.id)
        self.seconds[k] = self.seconds.get(k, 0.0) + p.batchDuration / 1000
        self.rows[k] = self.rows.get(k, 0) + p.numInputRows
        line = f"{p.name or k}: batch {p.batchId}, {p.numInputRows} rows, {p.processedRowsPerSecond:.1f} rows/s, {self.rows[k]} rows in {self.seconds[k]:.1f} s"
        self.lines.append(line)
        if self.say:
            self.say(line)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
