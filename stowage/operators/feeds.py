"""Volumes fed one by one, members that end in a later volume, and records of the program that wrote a container."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as A
from ..plans.catalog import Catalog
from ..sources.archives import read_blocks
from ..sources.tables import fragments, read
from ..streaming import volumes as V
from .archives import _members

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def feed_states(volumes: DataFrame) -> DataFrame:
    """set_id, volume, index, previous, ended: the state of a feed behind each volume (set_id, volume, is_last)."""
    w = Window.partitionBy("set_id").orderBy("volume")
    ended = F.coalesce(F.max(F.col("is_last")).over(w), F.lit(False))
    return volumes.select("set_id", "volume", F.row_number().over(w).alias("index"), F.lag("volume").over(w).alias("previous"), ended.alias("ended"))


@CATALOG.add("x02_feed_state", "SELECT set_id, volume, row_number() OVER w AS index, lag(volume) OVER w AS previous, volume = max(volume) OVER (PARTITION BY set_id) AS ended FROM {fragments} WINDOW w AS (PARTITION BY set_id ORDER BY volume)")
def x02(spark, folder):
    f = fragments(spark, folder)
    return feed_states(f.withColumn("is_last", F.col("volume") == F.max("volume").over(Window.partitionBy("set_id"))))


@CATALOG.add("x03_split_member_walk", "SELECT doc_id AS set_id, greatest(1, (octet_length(encode(text)) + 499) // 500) AS volumes, sha256(text) AS digest FROM documents WHERE doc_id % 5 <> 0")
def x03(spark, folder):
    """The streaming walk's step over documents in pieces of 500 bytes, the last ones first; every fifth document's first piece never comes."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for k, data in zip(pdf.member_index, pdf.payload, strict=True):
                data = bytes(data)
                n = max(1, -(-len(data) // 500))
                rows += [(k, v, data[500 * v : 500 * (v + 1)], v == n - 1) for v in range(int(k % 5 == 0), n)]
            yield pd.DataFrame(rows, columns=["set_id", "volume", "piece", "is_last"])

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, last, out = {}, None, []
        for volume, piece, is_last in sorted(zip(pdf.volume.tolist(), map(bytes, pdf.piece), pdf.is_last.tolist(), strict=True), reverse=True):
            payload, held, last = V.walk_split(held, last, [(volume, piece, is_last)])
            if payload is not None:
                out.append((key[0], len(pdf), payload))
        return pd.DataFrame(out, columns=["set_id", "volumes", "payload"])

    p = _members(spark, folder).select("member_index", "payload").mapInPandas(cut, V.PIECES)
    return p.groupBy("set_id").applyInPandas(walk, V.WHOLE).select("set_id", "volumes", F.sha2("payload", 256).alias("digest"))


#: The most bytes of a producer's record.
MOST = 256


def replaceable(producer: bytes) -> Column:
    """Blocks (with `payload_ok` and `payload`) that a rewrite may replace: an intact, stored service record of this producer without any
    metadata of its own, that unknowing programs drop (flag 4). All else needs a rewrite that says what it loses."""
    plain = (F.col("flags") == 2 + 4) & (F.size("extras") == 0) & (F.col("method") == 0) & (F.col("attr") == 0) & (F.col("host") == 0) & F.col("time").isNull()
    intact = F.col("header_ok") & F.coalesce(F.col("payload_ok"), F.lit(False)) & F.col("check_value").isNotNull() & (F.col("unpacked") == F.col("packed")) & (F.col("unpacked") <= MOST)
    return (F.col("kind") == "service") & (F.col("name") == F.lit(producer)) & plain & intact


@CATALOG.add("p18_replaceable_producer", "SELECT page_id, page_id % 6 = 0 AS replaceable FROM pages")
def p18(spark, folder):
    """A record a page: plain, with an attribute, with a time, under another name, kept by unknowing programs, and damaged."""

    @F.pandas_udf("binary")
    def make(page: pd.Series) -> pd.Series:
        out = []
        for k in map(int, page):
            k %= 6
            data, name = b"writer 1", b"OTHER" if k == 3 else b"WRITER"
            stored = b"Writer 1" if k == 5 else data
            time = struct.pack("<I", 7) if k == 2 else b""
            fields = A.vint(4 | (2 if k == 2 else 0)) + A.vint(len(data)) + A.vint(1 if k == 1 else 0) + time + struct.pack("<I", zlib.crc32(data)) + A.vint(0) + A.vint(0) + A.vint(len(name)) + name
            whole = A.write50([])
            at = next(x["offset"] for x in A.parse(whole) if x["kind"] == "end")
            out.append(whole[:at] + A.block50(3, 0 if k == 4 else 4, fields, data=stored) + whole[at:])
        return pd.Series(out)

    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make("page_id").alias("content"))
    b = read_blocks(c, payload=True).where("kind = 'service'")
    return b.select(F.col("path").cast("long").alias("page_id"), replaceable(b"WRITER").alias("replaceable"))
