"""A streaming source of logical-replication messages: a PySpark data source named ``pgoutput``.

It reads segments of recorded messages from a folder (each message framed by its length, four
bytes, big-endian), decodes them and yields change-log envelopes, one commit after another. A
segment holds whole transactions and the relation messages that they need; segments are named
in order. A live connection to a server would replace ``_segments`` and the reading of one.

    spark.dataSource.register(PgOutput)
    spark.readStream.format("pgoutput").option("tables", json).load(folder)

Segments are read by the executors, so the folder must be one that they all see.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from brooklet.schema import TableSchema
from brooklet.sources.changelog import ENVELOPE
from brooklet.sources.pgoutput import envelopes


def frame(messages: list[bytes]) -> bytes:
    return b"".join(struct.pack("!I", len(m)) + m for m in messages)


def unframe(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("!I", data, at)
        if at + 4 + n > len(data):
            raise ValueError("segment ends early")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


class Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Segments:
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.tables = {t: TableSchema.from_json(t, d) for t, d in json.loads(options["tables"]).items()}

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".seg"))

    def read(self, partition: Segment) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        for e in envelopes(unframe(data), self.tables):
            h = e["headers"]
            yield (e["type"], e["key"], e["value"], e["old"], (h["operation"], h["txid"], h["lsn"], h["seq"]))


class _Batch(_Segments, DataSourceReader):
    def partitions(self) -> list[Segment]:
        return [Segment(os.path.join(self.folder, n)) for n in self.names()]


class _Stream(_Segments, DataSourceStreamReader):
    """An offset is the name of the last segment read. A segment that arrives with an earlier name is out
    of the log's order, and an error."""

    def initialOffset(self) -> dict:
        return {"after": "", "segments": 0}

    def latestOffset(self) -> dict:
        names = self.names()
        return {"after": names[-1] if names else "", "segments": len(names)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        names = [n for n in self.names() if n <= end["after"]]
        if sum(n <= start["after"] for n in names) > start["segments"] or len(names) > end["segments"]:
            raise ValueError(f"a segment was added before {end['after']}, out of order")
        return [Segment(os.path.join(self.folder, n)) for n in names if n > start["after"]]

    def commit(self, end: dict) -> None:
        pass


class PgOutput(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgoutput"

    def schema(self) -> str:
        return ENVELOPE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
