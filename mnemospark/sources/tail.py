"""A stream source for files that grow: it delivers the complete lines that were appended since the last batch.

Spark's file source reads a file once. This one keeps how far each file was read; a line without its end waits for the
next batch, and a file that shrank is read from its start. Files lie in a folder that all executors see.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def complete_until(path: str) -> int:
    """The byte behind the last line end of a file; 0 if there is none."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            low = max(0, at - CHUNK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str):
        self.folder, self.glob = folder, glob

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for base, _, names in os.walk(self.folder):
            for name in names:
                if fnmatch.fnmatch(name, self.glob):
                    path = os.path.join(base, name)
                    try:
                        out[path] = complete_until(path)
                    except OSError:  # gone since
                        continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if begin > stop:
                begin = 0
            if begin < stop:
                out.append(Range(path, begin, stop))
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line or at + len(line) > partition.end:
                    break
                yield partition.path, at, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """format("tail") with the options path and glob: path, offset, line."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("glob", "*.jsonl"))
