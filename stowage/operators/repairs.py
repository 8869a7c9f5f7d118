"""Recovery records inside containers: protected, damaged, repaired and written back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inline
from ..functions.kernels import binary_kernel
from ..plans.catalog import Catalog
from ..plans.storage import scratch_folder
from ..sources.archives import members_of, read_blocks
from ..sources.sinks import drop_staging, publish
from ..sources.tables import read
from .archives import _containers

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

PERCENT = 10


def repair_containers(containers: DataFrame) -> DataFrame:
    """path, content, chunks, damaged, rebuilt, error of containers (path, content) repaired from their own records.

    A container without an intact chunk, or with too few of them, keeps its bytes and says why in `error`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                data = bytes(content or b"")
                try:
                    back, report = inline.repair(data)
                    rows.append((path, back, report["chunks"], report["damaged"], report["rebuilt"], None))
                except ValueError as e:
                    rows.append((path, data, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "chunks", "damaged", "rebuilt", "error"]).astype({"chunks": "Int64", "damaged": "Int64", "rebuilt": "boolean"})

    return containers.select("path", "content").mapInPandas(run, "path string, content binary, chunks long, damaged long, rebuilt boolean, error string")


def repair_to(containers: DataFrame, folder: str) -> DataFrame:
    """Repaired containers published as whole files under a shared folder, named by the path's last part; a report row for each, and
    nothing is written for those that cannot be repaired. Nothing happens until an action runs on the report."""
    staging = f".staging-{uuid.uuid4().hex}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, error in zip(pdf.path, pdf.content, pdf.error, strict=True):
                target = os.path.basename(path)
                if error is None:
                    publish(bytes(content), folder, os.path.join(folder, staging), path, target, "always")
                rows.append((path, target, "unrepaired" if error else "written"))
            yield pd.DataFrame(rows, columns=["path", "target", "status"])

    return repair_containers(containers).select("path", "content", "error").mapInPandas(write, "path string, target string, status string")


def _protected(spark, folder: str) -> DataFrame:
    return _containers(spark, folder, "5+").withColumn("content", binary_kernel(lambda b: inline.protect(b, PERCENT))("content"))


def _middle(data: bytes) -> bytes:
    """A run of 40 bytes is lost within one shard in the middle: the least record, of one chunk, can bring back no more than one shard."""
    g = inline.find_chunks(data)[0][0]
    at = g.data // 2 * g.width
    return data[:at] + bytes(b ^ 255 for b in data[at : at + 40]) + data[at + 40 :]


def _headers(data: bytes) -> bytes:
    """Main header and first member's header are lost, so that no walk gets past them."""
    return data[:8] + bytes(b ^ 255 for b in data[8:40]) + data[40:]


def _chunk(data: bytes) -> bytes:
    """The mark of the first chunk is lost, and the end block with it."""
    at = data.find(inline.MARK)
    return data[:at] + b"lost" + data[at + 4 : -3]


def _texts(containers: DataFrame) -> DataFrame:
    b = members_of(read_blocks(containers, payload=True)).where("header_ok and payload_ok")
    return b.select(F.regexp_extract(F.decode("name", "UTF-8"), r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.sha2("payload", 256).alias("digest"))


_TEXTS = "SELECT doc_id, sha256(text) AS digest FROM documents"


@CATALOG.add("r01_inline_repair", _TEXTS)
def r01(spark, folder):
    """Payloads of all containers are damaged; the members are read from the repaired ones."""
    return _texts(repair_containers(_protected(spark, folder).withColumn("content", binary_kernel(_middle)("content"))))


@CATALOG.add("r02_raw_bytes_repair", _TEXTS)
def r02(spark, folder):
    return _texts(repair_containers(_protected(spark, folder).withColumn("content", binary_kernel(_headers)("content"))))


@CATALOG.add("r06_rebuild_record", "SELECT 'a' || doc_id // 64 AS archive, 0 AS damaged, count(*) > 0 AS same FROM documents GROUP BY 1")
def r06(spark, folder):
    """The record lost a chunk and the container its end: both come back byte by byte, unless the record had one chunk only, which cannot be."""
    p = _protected(spark, folder).withColumn("whole", F.sha2("content", 256))
    hurt = p.select(F.concat_ws("\0", "path", "whole").alias("path"), binary_kernel(lambda b: _chunk(b) if inline.find_chunks(b)[0][0].parity > 1 else b[:-3])("content").alias("content"))
    r = repair_containers(hurt)
    return r.select(F.split_part("path", F.lit("\0"), F.lit(1)).alias("archive"), "damaged", (F.split_part("path", F.lit("\0"), F.lit(2)) == F.sha2("content", 256)).alias("same"))


@CATALOG.add("k16_repair_to_path", _TEXTS)
def k16(spark, folder):
    """Damaged containers are repaired into files of a shared folder, and the members read from these."""
    out = scratch_folder(spark, "repaired")
    repair_to(_protected(spark, folder).withColumn("content", binary_kernel(_middle)("content")), out).write.format("noop").mode("overwrite").save()
    drop_staging(out)
    return _texts(spark.read.format("binaryFile").load(out).select("path", "content"))


# Bytes read at once, the least stripe and the most bytes of all stripes
BLOCK, LEAST, MOST = 1 << 18, 1 << 12, 1 << 26


@CATALOG.add(
    "r11_memory_mode",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey::BIGINT * 4096 AS size, l_suppkey::BIGINT * 16384 AS room FROM lineitem),
d AS (SELECT *, CASE WHEN size >= 204800 THEN 200 ELSE greatest(1, (size + 1023) // 1024) END AS n FROM p),
g AS (SELECT *, CASE WHEN size < 204800 THEN greatest(1, {PERCENT} * n // 100) ELSE {PERCENT} * n // 100 END AS rows, ((size + n - 1) // n + 1) // 2 * 2 AS width FROM d)
SELECT l_orderkey, l_linenumber, rows * width + {BLOCK} <= room AS resident,
  CASE WHEN rows * width + {BLOCK} > room THEN greatest(2, CASE WHEN least(least(room, {MOST}) // (rows + 1), width) // 2 * 2 < {LEAST} THEN least({LEAST}, greatest(width, 2)) ELSE least(least(room, {MOST}) // (rows + 1), width) // 2 * 2 END) END AS stripe FROM g""",
)
def r11(spark, folder):
    """Whether the parity of a container stays in memory, or the width of the column stripes it is computed in."""
    p = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey").cast("long") * 4096).alias("size"), (F.col("l_suppkey").cast("long") * 16384).alias("room"))
    small = F.expr("size < 204800")
    p = p.withColumn("n", F.when(small, F.expr("greatest(1L, (size + 1023) div 1024)")).otherwise(F.lit(200).cast("long")))
    p = p.withColumn("width", F.expr("((size + n - 1) div n + 1) div 2 * 2")).withColumn("rows", F.when(small, F.expr(f"greatest(1L, {PERCENT} * n div 100)")).otherwise(F.expr(f"{PERCENT} * n div 100")))
    resident = F.expr(f"rows * width + {BLOCK} <= room")
    stripe = F.expr(f"least(least(room, {MOST}L) div (rows + 1), width) div 2 * 2")
    stripe = F.greatest(F.lit(2).cast("long"), F.when(stripe < LEAST, F.least(F.lit(LEAST).cast("long"), F.greatest("width", F.lit(2).cast("long")))).otherwise(stripe))
    return p.select("l_orderkey", "l_linenumber", resident.alias("resident"), F.when(~resident, stripe).alias("stripe"))
