"""Stand-ins for archives over the driver's tables, and their SQL for an independent engine.

members: a document is a member of the archive named by its source; names repeat on purpose.
fragments: a conversation is a volume set, a turn a volume; volume numbers leave gaps.
blocks: an order is an archive, a line item one of its header blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_NUMBER = "turn + CASE WHEN turn > conv_id % 4 THEN 1 + conv_id % 2 ELSE 0 END"


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn is a volume; from a place that depends on the set on, numbers are one or two higher, so that sets have gaps."""
    c = read(spark, folder, "conversations")
    return c.select(F.col("conv_id").alias("set_id"), F.expr(_NUMBER).alias("volume"), "role", F.octet_length("text").cast("long").alias("packed_size"))


FRAGMENTS = f"(SELECT conv_id AS set_id, {_NUMBER} AS volume, role, octet_length(encode(text))::BIGINT AS packed_size FROM conversations)"

_MEMBER = {
    "archive": "source",
    "member_index": "doc_id",
    "name": "concat(source, '/', lang, '/f', doc_id % 97, '.txt')",
    "packed_size": "n_chars - n_chars % 3",
    "host_os": "doc_id % 6",
    "file_attr": "(doc_id * 7919) % 65536",
    "flags": "(doc_id * 31) % 512",
    "unpack_version": "CASE doc_id % 4 WHEN 0 THEN 15 WHEN 1 THEN 20 WHEN 2 THEN 29 ELSE 36 END",
    "is_directory": "doc_id % 11 = 0",
    "is_redirection": "doc_id % 13 = 5",
    "is_solid": "doc_id % 3 <> 0",
    "is_encrypted": "doc_id % 7 = 3",
    "is_stored": "doc_id % 5 = 1",
    "is_damaged": "doc_id % 17 = 4",
    "link_type": "doc_id % 7",
    "link_flags": "doc_id % 3",
    "link_target": "concat(source, '/', lang, '/f', (doc_id * 5) % 97, '.txt')",
}


def members(spark: SparkSession, folder: str, text: bool = False) -> DataFrame:
    d = read(spark, folder, "documents")
    columns = [F.expr(v).alias(k) for k, v in _MEMBER.items()]
    return d.select(*columns, F.octet_length("text").cast("long").alias("unpacked_size"), *(["text"] if text else []))


MEMBERS = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in _MEMBER.items()) + ", octet_length(encode(text))::BIGINT AS unpacked_size, text FROM documents)"


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of an archive in a total order; kinds and flags come from the line's numbers."""
    b = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return b.selectExpr("l_orderkey AS archive_id", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp", "CAST(l_quantity AS BIGINT) AS size", "CASE l_partkey % 6 WHEN 0 THEN 'service' WHEN 1 THEN 'newsub' WHEN 2 THEN 'protect' ELSE 'file' END AS kind", "CASE l_suppkey % 6 WHEN 0 THEN 'QO' WHEN 1 THEN 'RR' WHEN 2 THEN 'CMT' WHEN 3 THEN 'ACL' WHEN 4 THEN 'STM' ELSE 'XYZ' END AS label", "l_partkey % 32 AS flags")


BLOCKS = "(SELECT l_orderkey AS archive_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_quantity::BIGINT AS size, CASE l_partkey % 6 WHEN 0 THEN 'service' WHEN 1 THEN 'newsub' WHEN 2 THEN 'protect' ELSE 'file' END AS kind, CASE l_suppkey % 6 WHEN 0 THEN 'QO' WHEN 1 THEN 'RR' WHEN 2 THEN 'CMT' WHEN 3 THEN 'ACL' WHEN 4 THEN 'STM' ELSE 'XYZ' END AS label, l_partkey % 32 AS flags FROM lineitem)"
