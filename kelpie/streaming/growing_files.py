"""A stream over files that grow: each is read from the byte where the last batch ended.

Only lines that a line feed ends are taken. A file that is shorter than its offset was rewritten: it is
read again from its start, and `generation` tells its lines from the earlier ones. What was added to a
file is read in stretches of `STRETCH` bytes, a line by the task in whose stretch it begins.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


STRETCH = 64 << 20


class Slice(InputPartition):
    """A byte range of one file; lines that begin in it belong to it. The first range of a batch begins with a line."""

    def __init__(self, path: str, start: int, end: int, generation: int, first: bool = True):
        self.path, self.start, self.end, self.generation, self.first = path, start, end, generation, first


def complete_end(path: str, start: int) -> int:
    """The byte after the last line feed at or after `start`; `start` if there is none."""
    size, step = os.path.getsize(path), 1 << 16
    with open(path, "rb") as file:
        at = size
        while at > start:
            low = max(start, at - step)
            file.seek(low)
            cut = file.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return start


class GrowingFileReader(DataSourceStreamReader):
    """Offsets are {path: [bytes, generation]} of all files that match the pattern."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            end, generation = self.seen.get(path, [0, 0])
            if os.path.getsize(path) < end:
                end, generation = 0, generation + 1
            self.seen[path] = [complete_end(path, end), generation]
        return {p: list(v) for p, v in self.seen.items()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        slices = []
        for path, (stop, generation) in end.items():
            begin, before = start.get(path, [0, 0])
            begin = begin if before == generation else 0
            self.seen.setdefault(path, [stop, generation])
            for at in range(begin, stop, STRETCH):
                slices.append(Slice(path, at, min(at + STRETCH, stop), generation, at == begin))
        return slices or [Slice("", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as file:
            at = partition.start
            if not partition.first:  # the line that is under way belongs to the stretch before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < partition.end:
                line = file.readline()
                if not line:
                    return
                yield partition.path, partition.generation, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """spark.dataSource.register(GrowingFiles), then readStream.format('growing_files').load(pattern)."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "path string, generation int, byte_offset long, raw_line string"

    def streamReader(self, schema) -> GrowingFileReader:
        return GrowingFileReader(self.options["path"])
