"""Containers written from documents and read back, in all three layouts; name codecs, keys, hashes, recovery."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checksums, ciphers, namecodecs, recovery
from ..functions import formats as A
from ..functions.kernels import binary_kernel
from ..plans.catalog import Catalog
from ..sources.archives import members_of, read_blocks, write_containers
from ..sources.tables import read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def _members(spark, folder: str) -> DataFrame:
    """64 documents an archive, so that no archive grows with the input."""
    d = read(spark, folder, "documents").where("doc_id is not null")
    return d.select(F.concat(F.lit("a"), F.expr("doc_id div 64")).alias("archive"), F.col("doc_id").alias("member_index"), F.encode(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), "UTF-8").alias("name"), F.encode("text", "UTF-8").alias("payload"))


def _containers(spark, folder: str, family: str) -> DataFrame:
    return write_containers(_members(spark, folder), family).withColumnRenamed("archive", "path")


def _round_trip(family: str):
    def run(spark, folder: str) -> DataFrame:
        b = members_of(read_blocks(_containers(spark, folder, family), payload=True))
        return b.select(F.col("path").alias("archive"), "member_index", F.decode("name", "UTF-8").alias("name"), F.col("unpacked").alias("size"), "header_ok", "payload_ok", F.sha2("payload", 256).alias("digest"))

    return run


_TRIP = "SELECT 'a' || doc_id // 64 AS archive, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) - 1 AS member_index, source || '/' || lang || '/' || doc_id || '.txt' AS name, octet_length(encode(text)) AS size, true AS header_ok, true AS payload_ok, sha256(text) AS digest FROM documents"
CATALOG.add("k07_write_and_read_5", _TRIP)(_round_trip("5+"))
CATALOG.add("k09_write_and_read_4", _TRIP)(_round_trip("1.5-4"))
CATALOG.add("k11_write_and_read_1", _TRIP)(_round_trip("1.3"))


def _walk(family: str):
    def run(spark, folder: str) -> DataFrame:
        return read_blocks(_containers(spark, folder, family)).groupBy(F.col("path").alias("archive"), "kind").agg(F.count("*").alias("blocks"), F.bool_and("header_ok").alias("headers_ok"))

    return run


def _walk_sql(ends: bool) -> str:
    extra = "UNION ALL SELECT archive, 'main', 1, true FROM a " + ("UNION ALL SELECT archive, 'end', 1, true FROM a" if ends else "")
    return f"WITH a AS (SELECT 'a' || doc_id // 64 AS archive, count(*) AS n FROM documents GROUP BY 1) SELECT archive, 'file' AS kind, n AS blocks, true AS headers_ok FROM a {extra}"


CATALOG.add("s08_block_walk_5", _walk_sql(True))(_walk("5+"))
CATALOG.add("s07_block_walk_4", _walk_sql(True))(_walk("1.5-4"))
CATALOG.add("s06_block_walk_1", _walk_sql(False))(_walk("1.3"))


@CATALOG.add("x11_truncation_salvage", "SELECT 'a' || doc_id // 64 AS archive, count(*) AS members, true AS cut FROM documents GROUP BY 1")
def x11(spark, folder):
    """Containers that lack their last three bytes: members before the cut survive, and one row tells of the cut."""
    c = _containers(spark, folder, "5+").select("path", F.substr("content", F.lit(1), F.length("content") - 3).alias("content"))
    return read_blocks(c).groupBy(F.col("path").alias("archive")).agg(F.count_if(F.col("kind") == "file").alias("members"), F.bool_or(F.col("kind") == "cut").alias("cut"))


@CATALOG.add("s11_extra_records", "SELECT 'a' || doc_id // 64 AS archive, doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 5 END::BIGINT AS type FROM documents")
def s11(spark, folder):
    """Hash and redirection records, one row each."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ms = [{"name": str(i).encode(), "payload": b"", **({"hash": checksums.blake2sp(b"")} if i % 3 == 0 else {"link": (1, 0, b"target")})} for i in sorted(pdf.member_index)]
        return pd.DataFrame({"path": [key[0]], "content": [A.write50(ms)]})

    c = _members(spark, folder).select("archive", "member_index").groupBy("archive").applyInPandas(build, "path string, content binary")
    b = read_blocks(c).where("kind = 'file'")
    return b.select(F.col("path").alias("archive"), F.decode("name", "UTF-8").cast("long").alias("doc_id"), F.explode("extras").alias("e")).select("archive", "doc_id", "e.type")


@CATALOG.add("f01_legacy_name_decode", "SELECT doc_id, lang AS shown FROM documents")
def f01(spark, folder):
    """Names in code page 437 decode to the same letters."""
    decode = binary_kernel(lambda b: namecodecs.decode_legacy(b, "cp437"), "string")
    return read(spark, folder, "documents").select("doc_id", decode(F.encode("lang", "UTF-8")).alias("shown"))


@CATALOG.add("f04_marked_names", "SELECT doc_id, octet_length(encode(text)) + 1 AS bytes, true AS same FROM documents")
def f04(spark, folder):
    """Names with a byte that is not UTF-8: the marked form decodes back to the same bytes."""
    trip = binary_kernel(lambda b: namecodecs.decode_marked(namecodecs.encode_marked(b)))
    d = read(spark, folder, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff")).alias("raw"))
    d = d.withColumn("back", trip("raw"))
    return d.select("doc_id", F.length("back").alias("bytes"), (F.col("raw") == F.col("back")).alias("same"))


@CATALOG.add("f06_packed_unicode_names", "SELECT page_id, url AS name FROM pages")
def f06(spark, folder):
    """The packed Unicode form of a name, decoded again."""
    trip = binary_kernel(lambda b: A.legacy_name(namecodecs.encode_packed(b.decode()), True))
    return read(spark, folder, "pages").select("page_id", F.decode(trip(F.encode("url", "UTF-8")), "UTF-8").alias("name"))


@CATALOG.add("y01_cipher_1_3", "SELECT doc_id, sha256(text) AS digest FROM documents")
def y01(spark, folder):
    key = ciphers.key13(b"password")
    trip = binary_kernel(lambda b: ciphers.crypt13(ciphers.crypt13(b, key, False), key, True))
    return read(spark, folder, "documents").select("doc_id", F.sha2(trip(F.encode("text", "UTF-8")), 256).alias("digest"))


@CATALOG.add("y02_cipher_1_5", "SELECT c_custkey, c_name AS name FROM customer")
def y02(spark, folder):
    trip = binary_kernel(lambda b: ciphers.crypt15(ciphers.crypt15(b, b"password"), b"password"))
    return read(spark, folder, "customer").select("c_custkey", F.decode(trip(F.encode("c_name", "UTF-8")), "UTF-8").alias("name"))


@CATALOG.add("y05_aes_cbc_raw", "SELECT doc_id, sha256(text) AS digest FROM documents")
def y05(spark, folder):
    """Unpadded AES-256-CBC there and back with built-in functions; the payload is filled up to whole blocks and cut again."""
    d = read(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    d = d.withColumn("filled", F.concat("data", F.substr(F.lit(bytes(16)), F.lit(1), 16 - F.length("data") % 16)))
    key, iv = F.unhex(F.sha2(F.lit(b"key"), 256)), F.unhex(F.md5(F.lit(b"iv")))
    d = d.withColumn("sealed", ciphers.aes_encrypt_raw(F.col("filled"), key, iv))
    return d.select("doc_id", F.sha2(F.substr(ciphers.aes_decrypt_raw(F.col("sealed"), key, iv), F.lit(1), F.length("data")), 256).alias("digest"))


@CATALOG.add("y07_key_dedupe", "SELECT doc_id, doc_id % 16 AS salt, doc_id % 5 <> 2 AS correct FROM documents")
def y07(spark, folder):
    """Each distinct salt is derived once and joined back; a stored check tells right passwords from wrong ones."""

    @F.pandas_udf("binary")
    def check(salt: pd.Series, password: pd.Series) -> pd.Series:
        return pd.Series([ciphers.keys50(p.encode(), int(s).to_bytes(16, "little"), 4)["check"] for s, p in zip(salt, password, strict=True)])

    d = read(spark, folder, "documents").selectExpr("doc_id", "doc_id % 16 AS salt", "CASE WHEN doc_id % 5 = 2 THEN 'guess' ELSE 'right' END AS password")
    derived = d.select("salt", "password").distinct().withColumn("check", check("salt", "password"))
    stored = d.select("salt").distinct().withColumn("stored", check("salt", F.lit("right")))
    return d.join(derived, ["salt", "password"]).join(stored, "salt").select("doc_id", "salt", (F.col("check") == F.col("stored")).alias("correct"))


@CATALOG.add("a08_tree_hash")
def a08(spark, folder):
    tree = binary_kernel(checksums.blake2sp)
    return read(spark, folder, "documents").select("doc_id", F.hex(tree(F.encode("text", "UTF-8"))).alias("hash"))


@CATALOG.add("a09_crc64")
def a09(spark, folder):
    crc = binary_kernel(lambda b: checksums.crc64(b).to_bytes(8, "big"))
    return read(spark, folder, "customer").select("c_custkey", F.hex(crc(F.encode("c_name", "UTF-8"))).alias("crc"))


_SHARD = 8


def _repair(bits: int):
    field = recovery.GF16 if bits == 16 else recovery.GF8

    def run(spark, folder: str) -> DataFrame:
        """Groups of eight documents' heads are shards; two of each group are lost and solved from parity."""

        def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id")
            size = max(map(len, pdf.data))
            size += size % 2
            data = [bytes(b).ljust(size, b"\0") for b in pdf.data]
            parity = recovery.encode(data, 2, field)
            lost = [None if i < 2 else b for i, b in enumerate(data)]
            back = recovery.reconstruct(lost, list(enumerate(parity)), field)
            return pd.DataFrame({"doc_id": pdf.doc_id, "data": [b[: len(d)] for b, d in zip(back, pdf.data, strict=True)]})

        d = read(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
        out = d.groupBy(F.expr(f"doc_id div {_SHARD}").alias("g")).applyInPandas(solve, "doc_id long, data binary")
        return out.select("doc_id", F.sha2("data", 256).alias("digest"))

    return run


CATALOG.add("r05_reconstruct_gf16", "SELECT doc_id, sha256(text) AS digest FROM documents")(_repair(16))
CATALOG.add("r08_reconstruct_gf8", "SELECT doc_id, sha256(text) AS digest FROM documents")(_repair(8))


@CATALOG.add("s25_recovery_volumes", "SELECT s_suppkey AS number, 3 AS data_count, 1 AS parity_count, true AS ok FROM supplier")
def s25(spark, folder):
    """Recovery volumes written and read back, shard table included."""

    @F.pandas_udf("struct<data_count:int,parity_count:int,ok:boolean>")
    def trip(n: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = [A.parse_rev(A.write_rev(int(i) & 0xFFFF, [(1, 2), (3, 4), (5, 6)], 1, s.encode())) for i, s in zip(n, name, strict=True)]
        return pd.DataFrame({"data_count": [r["data_count"] for r in rows], "parity_count": [r["parity_count"] for r in rows], "ok": [r["ok"] for r in rows]})

    return read(spark, folder, "supplier").select(F.col("s_suppkey").alias("number"), trip("s_suppkey", "s_name").alias("x")).select("number", "x.*")


@CATALOG.add("c06_compressed_round_trip", "SELECT page_id, sha256(html) AS digest FROM pages")
def c06(spark, folder):
    """Pages packed with literals and matches and decoded again, block by block."""
    from ..functions import lz50

    trip = binary_kernel(lambda b: lz50.Decoder().decode(lz50.encode(b), len(b)))
    return read(spark, folder, "pages").select("page_id", F.sha2(trip(F.encode("html", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c14_literal_round_trip", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def c14(spark, folder):
    """Texts packed with literals only."""
    from ..functions import lz50

    trip = binary_kernel(lambda b: lz50.Decoder().decode(lz50.encode(b, False), len(b)))
    return read(spark, folder, "conversations").select("conv_id", "turn", F.sha2(trip(F.encode("text", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c09_solid_chain", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def c09(spark, folder):
    """A conversation is a solid chain: one decoder goes through its turns in order."""
    from ..functions import lz50

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, decoder = pdf.sort_values("turn"), lz50.Decoder()
        return pdf.assign(data=[decoder.decode(lz50.encode(bytes(b)), len(b)) for b in pdf.data])

    c = read(spark, folder, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data"))
    return c.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, data binary").select("conv_id", "turn", F.sha2("data", 256).alias("digest"))


@CATALOG.add("c07_block_headers", "SELECT page_id, 1 AS blocks, true AS last FROM pages")
def c07(spark, folder):
    """Headers of the blocks of packed pages."""
    from ..functions import lz50

    @F.pandas_udf("struct<blocks:int,last:boolean>")
    def headers(data: pd.Series) -> pd.DataFrame:
        rows = []
        for b in data:
            b, at, n, last = lz50.encode(bytes(b), False), 0, 0, False
            while at < len(b):
                _, at, _, last, _ = lz50.parse_block(b, at)
                n += 1
            rows.append({"blocks": n, "last": last})
        return pd.DataFrame(rows)

    return read(spark, folder, "pages").select("page_id", headers(F.encode("html", "UTF-8")).alias("x")).select("page_id", "x.*")


@CATALOG.add("c20_branch_filter", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c20(spark, folder):
    """Call targets made absolute and relative again."""
    from ..functions.filters import x86_decode, x86_encode

    trip = binary_kernel(lambda b: x86_decode(x86_encode(b, 0, True), 0, True))
    return read(spark, folder, "documents").select("doc_id", F.sha2(trip(F.encode("text", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c22_arm_filter", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c22(spark, folder):
    from ..functions.filters import arm_decode, arm_encode

    trip = binary_kernel(lambda b: arm_decode(arm_encode(b)))
    return read(spark, folder, "documents").select("doc_id", F.sha2(trip(F.encode("text", "UTF-8")), 256).alias("digest"))


@CATALOG.add("r04_encoder_matrix", "SELECT count(*) AS cells, true AS inverse FROM range(5), range(20)")
def r04(spark, folder):
    """Cells of a parity matrix: each is the inverse of (row + data) xor column in GF(2**16)."""
    m = recovery.encoder_matrix(20, 5)
    cells = spark.createDataFrame([(i, j, int(m[i, j])) for i in range(5) for j in range(20)], "i int, j int, cell long")

    @F.pandas_udf("long")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(recovery.GF16.multiply(a.to_numpy(), b.to_numpy()))

    ok = product("cell", ((F.col("i") + 20).bitwiseXOR(F.col("j"))).cast("long")) == 1
    return cells.select(ok.alias("ok")).agg(F.count("*").alias("cells"), F.bool_and("ok").alias("inverse"))


@CATALOG.add("a18_code_lengths", "SELECT doc_id, true AS complete FROM documents WHERE length(text) > 0")
def a18(spark, folder):
    """Code lengths from the byte counts of a payload, which make a complete code."""
    from ..functions.bytemaps import counts
    from ..functions.lz50 import code_lengths

    complete = binary_kernel(lambda b: sum(2.0**-n for n in code_lengths(counts(np.frombuffer(b, np.uint8)).tolist()) if n) == 1.0, "boolean")
    return read(spark, folder, "documents").where("length(text) > 0").select("doc_id", complete(F.encode("text", "UTF-8")).alias("complete"))


@CATALOG.add("c23_bundle_filter", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c23(spark, folder):
    from ..functions.filters import itanium_decode, itanium_encode

    trip = binary_kernel(lambda b: itanium_decode(itanium_encode(b)))
    return read(spark, folder, "documents").select("doc_id", F.sha2(trip(F.encode("text", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c24_picture_filter", "SELECT page_id, sha256(html) AS digest FROM pages")
def c24(spark, folder):
    from ..functions.filters import rgb_decode, rgb_encode

    trip = binary_kernel(lambda b: rgb_decode(rgb_encode(b, 48), 48))
    return read(spark, folder, "pages").select("page_id", F.sha2(trip(F.encode("html", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c35_branch_encode", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 16777216 - 1 ELSE c_custkey END AS target FROM customer")
def c35(spark, folder):
    """A relative call at place 0 becomes the absolute target: place of the operand plus the distance."""
    from ..functions.filters import x86_encode

    def target(b: bytes) -> int:
        return int.from_bytes(x86_encode(b"\xe8" + (int(b) - 1).to_bytes(4, "little", signed=True) + b"\0")[1:5], "little", signed=True)

    run = binary_kernel(target, "long")
    c = read(spark, folder, "customer")
    return c.select("c_custkey", run(F.encode(F.expr("CASE WHEN c_custkey % 2 = 0 THEN 16777215 ELSE c_custkey END").cast("string"), "UTF-8")).alias("target"))
