"""Containers as tables: blocks from (path, content) rows or from files, and containers from members."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import formats as A

_EXTRA = pa.list_(pa.struct([("type", pa.int64()), ("data", pa.binary())]))
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split(" ", 1)[0], _KINDS.get(c.split(" ", 1)[1], _EXTRA)) for c in A.COLUMNS.split(", ")])


def read_blocks(containers: DataFrame, payload: bool = False) -> DataFrame:
    """One row for each block of each container (path, content), with the payload and its verdict where asked for.

    A container is parsed by one task; only headers are kept unless payloads are projected.
    """
    schema = f"path string, {A.COLUMNS}" + (", payload binary, payload_ok boolean" if payload else "")
    arrow = pa.schema([("path", pa.string()), *_ARROW, *([("payload", pa.binary()), ("payload_ok", pa.bool_())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py() or b""
                rows = []
                for x in A.parse(data):
                    x["path"] = path.as_py()
                    if payload:
                        piece = data[x["data_offset"] : x["data_offset"] + x["packed"]] if x["kind"] in ("file", "service") else None
                        x["payload"], x["payload_ok"] = piece, None if piece is None else A.payload_ok(x, piece)
                    rows.append(x)
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return containers.select("path", "content").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Blocks of the files under a path, through Spark's own file reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read_blocks(files.select("path", "content"), payload)


def write_containers(members: DataFrame, family: str = "5+") -> DataFrame:
    """(archive, content) from members (archive, member_index, name, payload); an archive's members meet in one task, in order."""
    write = {"5+": A.write50, "1.5-4": A.write15, "1.3": A.write13}[family]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member_index")
        ms = [{"name": bytes(n), "payload": bytes(p)} for n, p in zip(pdf.name, pdf.payload, strict=True)]
        return pd.DataFrame({"archive": [key[0]], "content": [write(ms)]})

    return members.select("archive", "member_index", "name", "payload").groupBy("archive").applyInPandas(build, "archive string, content binary")


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(folder): members of local or mounted container files; one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return f"path string, {A.COLUMNS}"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        import os

        found = [os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from ..functions.ranges import walk

        with open(partition.value, "rb") as f:  # headers only: payloads are jumped over
            for x in walk(f):
                yield (partition.value, *(([(e["type"], e["data"]) for e in x["extras"]] if x["extras"] is not None else None) if k == "extras" else x[k] for k in A.FIELDS))


def members_of(blocks: DataFrame) -> DataFrame:
    """File blocks as members, numbered in archive order."""
    from pyspark.sql import Window

    return blocks.where("kind = 'file'").withColumn("member_index", F.row_number().over(Window.partitionBy("path").orderBy("block")) - 1)
