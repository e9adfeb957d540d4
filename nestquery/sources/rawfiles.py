"""A Python data source for files that Spark's own file scan passes over, and for heads.

Spark's scan leaves out names that begin with "." or "_", which sidecar files do.  This
source lists a mounted folder and reads whole files, or only their first `head` bytes and
last `tail` ones, on the executors.

    spark.dataSource.register(RawFiles)
    spark.read.format("rawfiles").option("hidden", "true").load(folder)
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES, BATCH_BYTES = 64 << 20, 16 << 20


class RawFiles(DataSource):
    """Options: path; hidden (only names that begin with . or _); head, tail (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "rawfiles"

    def schema(self) -> str:
        return "name string, size long, mtime_ns long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.head = int(options["head"]) if "head" in options else None
        self.tail = int(options.get("tail", 0))

    def partitions(self) -> list[InputPartition]:
        out, own, size = [], [], 0
        for here, dirs, files in os.walk(self.root):
            dirs.sort()
            for f in sorted(files):
                full = os.path.join(here, f)
                if os.path.islink(full) or self.hidden and f[0] not in "._":
                    continue
                s = os.stat(full)
                own.append((os.path.relpath(full, self.root), s.st_size, s.st_mtime_ns))
                size += min(s.st_size, self.head + self.tail) if self.head is not None else s.st_size
                if size >= PARTITION_BYTES:
                    out.append(_Files(own))
                    own, size = [], 0
        return [*out, _Files(own)] if own or not out else out

    def _bytes(self, path: str, size: int) -> bytes:
        with open(path, "rb") as f:
            if self.head is None or size <= self.head + self.tail:
                return f.read()
            head = f.read(self.head)
            f.seek(size - self.tail)
            return head + f.read(self.tail)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["name", "size", "mtime_ns", "content"]
            )

        rows, held = [], 0
        for name, size, mtime in partition.files:
            rows.append((name, size, mtime, self._bytes(os.path.join(self.root, name), size)))
            held += len(rows[-1][3])
            if held >= BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)
