"""Queries over payload bytes: signatures, checksums, histograms, parity, delta planes, detectors.

Payloads are the whole texts of documents as UTF-8. Checksums and detectors stay inside JVM expressions; byte
counts, parity and delta planes go through numpy in Arrow batches, so that a byte is never a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import bytemaps
from ..functions.checksums import crc32_combine
from ..plans.catalog import Catalog
from ..sources.tables import read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

_B = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)"


def _payload(spark, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))


#: The 256 values of the CRC-32 table, from its polynomial.
def crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = "[" + ",".join(map(str, crc_table())) + "]"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, x: xor(s >> 8, ({_TABLE})[(xor(s, x) & 255) + 1]::BIGINT)))"


@CATALOG.add("a04_crc32", f"SELECT doc_id, {_CRC} AS crc FROM (SELECT doc_id, {_B} AS b FROM documents)")
def a04(spark, folder):
    return _payload(spark, folder).select("doc_id", F.crc32("data").alias("crc"))


@CATALOG.add("a05_crc32_combine", f"SELECT doc_id, {_CRC} AS crc FROM (SELECT doc_id, {_B} AS b FROM documents)")
def a05(spark, folder):
    """The CRC-32 of a payload from those of its two halves and the second one's length."""
    d = _payload(spark, folder).withColumn("half", F.floor(F.length("data") / 2).cast("int"))
    first, second = F.substr("data", F.lit(1), F.col("half")), F.substr("data", F.col("half") + 1)
    d = d.select("doc_id", F.crc32(first).alias("a"), F.crc32(second).alias("b"), F.length(second).cast("long").alias("n"))
    return d.select("doc_id", crc32_combine("a", "b", "n").alias("crc"))


@CATALOG.add("a07_rotating_checksum", f"SELECT doc_id, list_reduce(list_prepend(0::BIGINT, b), lambda s, x: ((((s + x) & 65535) << 1) & 65535) | (((s + x) & 65535) >> 15)) AS checksum FROM (SELECT doc_id, {_B} AS b FROM documents)")
def a07(spark, folder):
    return _payload(spark, folder).select("doc_id", B.rotating_checksum(B.byte_values(F.col("data"))).alias("checksum"))


@CATALOG.add("a10_byte_histogram", f"SELECT doc_id, x AS byte, count(*) AS n FROM (SELECT doc_id, unnest({_B}) AS x FROM documents) GROUP BY ALL")
def a10(spark, folder):
    """Counts of byte values of a payload."""
    d = _payload(spark, folder).select("doc_id", F.posexplode(bytemaps.histogram("data")).alias("byte", "n")).where("n > 0")
    return d.groupBy("doc_id", F.col("byte").cast("long").alias("byte")).agg(F.sum("n").alias("n"))


@CATALOG.add("a16_text_bytes", f"SELECT doc_id, len(list_filter(b, lambda x: x IN (9, 10, 13) OR (x >= 32 AND x <= 126))) AS text_bytes, len(b) AS size FROM (SELECT doc_id, {_B} AS b FROM documents)")
def a16(spark, folder):
    """Printable bytes: what is left of the text without other characters, which is one byte each."""
    d = read(spark, folder, "documents")
    return d.select("doc_id", F.length(F.regexp_replace("text", r"[^\t\n\r\x20-\x7e]", "")).cast("long").alias("text_bytes"), F.octet_length("text").cast("long").alias("size"))


@CATALOG.add("p19_text_like", f"SELECT doc_id, len(list_filter(list_slice(b, 1, 16384), lambda x: x IN (9, 10, 13) OR (x >= 32 AND x <= 126))) * 100 // greatest(len(list_slice(b, 1, 16384)), 1) >= 95 AS text_like FROM (SELECT doc_id, {_B} AS b FROM documents)")
def p19(spark, folder):
    """At least 95 % printable bytes in the detector's own window, the first 16 KiB."""
    head = F.substr(F.col("data"), F.lit(1), F.lit(16384))
    n = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\t\n\r\x20-\x7e]", ""))
    return _payload(spark, folder).select("doc_id", (F.floor(n * 100 / F.greatest(F.length(head), F.lit(1))) >= 95).alias("text_like"))


_STRIDES = 8


@CATALOG.add("a11_stride_hits", f"SELECT doc_id, k AS stride, len(list_filter(range(9, len(b) + 1), lambda i: (b[i] - b[i - k] + 258) % 256 <= 4)) AS hits FROM (SELECT doc_id, {_B} AS b FROM documents), range(1, 9) r(k)")
def a11(spark, folder):
    """For strides 1 to 8: bytes within two of the byte a stride back."""
    d = _payload(spark, folder).select("doc_id", B.byte_values(F.col("data")).alias("b"))
    return d.select("doc_id", F.explode(_stride_counts()).alias("x")).select("doc_id", "x.*")


def _stride_counts() -> Column:
    n = F.size("b")
    one = lambda k: F.size(F.filter(F.zip_with(F.slice("b", F.lit(_STRIDES + 1), F.greatest(n - _STRIDES, F.lit(0))), F.slice("b", F.lit(_STRIDES + 1 - k), F.greatest(n - _STRIDES, F.lit(0))), lambda x, y: (x - y + 258) % 256 <= 4), lambda v: v))
    return F.array(*(F.struct(F.lit(k).cast("long").alias("stride"), one(k).cast("long").alias("hits")) for k in range(1, _STRIDES + 1)))


def _best_stride(d: DataFrame, keys: list[str]) -> DataFrame:
    """best (hits) and the shortest stride within 95 % of it, from rows x (stride, hits); eight rows a key."""
    d = d.groupBy(*keys).agg(F.max("x.hits").alias("best"), F.collect_list("x").alias("h"))
    return d.select(*keys, "best", F.expr("array_min(transform(filter(h, x -> x.hits * 100 >= best * 95), x -> x.stride))").alias("stride"))


@CATALOG.add("t06_table_stride", f"WITH h AS (SELECT doc_id, n, k, len(list_filter(range(9, n + 1), lambda i: (b[i] - b[i - k] + 258) % 256 <= 4)) AS hits FROM (SELECT doc_id, len(b) AS n, b FROM (SELECT doc_id, {_B} AS b FROM documents)), range(1, 9) r(k)) SELECT doc_id, min(CASE WHEN hits * 100 >= best * 95 THEN k END) AS stride FROM (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS best FROM h) WHERE best * 100 >= greatest(n - 8, 0) * 40 GROUP BY doc_id")
def t06(spark, folder):
    """The shortest stride within 95 % of the best, which must predict 40 % of the bytes."""
    d = _payload(spark, folder).select("doc_id", B.byte_values(F.col("data")).alias("b"))
    d = _best_stride(d.select("doc_id", F.size("b").alias("n"), F.explode(_stride_counts()).alias("x")), ["doc_id", "n"])
    return d.where(F.col("best") * 100 >= F.greatest(F.col("n") - 8, F.lit(0)) * 40).select("doc_id", "stride")


@CATALOG.add("g03_table_regions", f"WITH w AS (SELECT doc_id, i AS w, list_slice(b, i * 512 + 1, i * 512 + 512) AS b FROM (SELECT doc_id, b, unnest(range(len(b) // 512)) AS i FROM (SELECT doc_id, {_B} AS b FROM documents))), h AS (SELECT doc_id, w, k, len(list_filter(range(9, 513), lambda i: (b[i] - b[i - k] + 258) % 256 <= 4)) AS hits FROM w, range(1, 9) r(k)), s AS (SELECT doc_id, w, min(CASE WHEN hits * 100 >= best * 95 THEN k END) AS stride FROM (SELECT *, max(hits) OVER (PARTITION BY doc_id, w) AS best FROM h) WHERE best * 100 >= 504 * 40 GROUP BY ALL) SELECT doc_id, stride, min(w) * 512 AS start, (max(w) + 1) * 512 AS end_ FROM (SELECT *, w - row_number() OVER (PARTITION BY doc_id, stride ORDER BY w) AS run FROM s) GROUP BY doc_id, stride, run HAVING count(*) >= 2")
def g03(spark, folder):
    """Windows of 512 bytes with one stride that follow each other; regions of one window are dropped."""
    d = _payload(spark, folder).select("doc_id", "data", F.floor(F.length("data") / 512).cast("int").alias("n")).where("n > 0")
    d = d.select("doc_id", "data", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"))
    d = d.select("doc_id", "w", B.byte_values(F.substr("data", F.col("w") * 512 + 1, F.lit(512))).alias("b"))
    d = _best_stride(d.select("doc_id", "w", F.explode(_stride_counts()).alias("x")), ["doc_id", "w"]).where("best * 100 >= 504 * 40")
    d = d.withColumn("run", F.col("w") - F.row_number().over(Window.partitionBy("doc_id", "stride").orderBy("w")))
    g = d.groupBy("doc_id", "stride", "run").agg(F.min("w").alias("a"), F.max("w").alias("z"), F.count("*").alias("k")).where("k >= 2")
    return g.selectExpr("doc_id", "stride", "a * 512 AS start", "(z + 1) * 512 AS end_")


@CATALOG.add("g02_opcode_regions", f"WITH p AS (SELECT doc_id, unnest(list_filter(range(1, len(b) - 3), lambda i: b[i] IN (232, 233))) - 1 AS p FROM (SELECT doc_id, {_B} AS b FROM documents)), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 4096 THEN 0 ELSE 1 END AS new FROM p)), g AS (SELECT doc_id, min(p) AS a, max(p) AS z, count(*) AS n FROM c GROUP BY doc_id, c HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, z - a, a) AS place FROM g) SELECT doc_id, a AS start, z + 5 AS end_, n FROM k WHERE place <= 8")
def g02(spark, folder):
    """Regions around opcodes E8 and E9: clusters of at least two, the eight richest of a payload."""
    d = _payload(spark, folder).select("doc_id", B.byte_values(F.col("data")).alias("b"))
    at = F.filter(F.transform("b", lambda x, i: F.when(x.isin(232, 233) & (i < F.size("b") - 4), i)), lambda i: i.isNotNull())
    d = d.select("doc_id", F.explode(at).alias("p"))
    w = Window.partitionBy("doc_id").orderBy("p")
    d = d.withColumn("new", F.when(F.col("p") - F.lag("p").over(w) <= 4096, 0).otherwise(1)).withColumn("c", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy("doc_id", "c").agg(F.min("p").alias("a"), F.max("p").alias("z"), F.count("*").alias("n")).where("n >= 2")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), F.col("z") - F.col("a"), "a"))
    return g.withColumn("place", place).where("place <= 8").selectExpr("doc_id", "a AS start", "z + 5 AS end_", "n")


@CATALOG.add("a12_sector_parity", f"SELECT doc_id, (i // 64) % 4 AS slot, i % 64 AS place, bit_xor(x) AS parity FROM (SELECT doc_id, unnest({_B}) AS x, unnest(range(octet_length(encode(text)))) AS i FROM documents) GROUP BY ALL")
def a12(spark, folder):
    """Sectors of 64 bytes dealt to four slots; parity is the exclusive or of a slot's sectors, byte by byte."""
    d = _payload(spark, folder).select("doc_id", F.posexplode(bytemaps.slot_parity("data")).alias("i", "parity")).where("parity is not null")
    return d.select("doc_id", F.expr("cast(i div 64 as long)").alias("slot"), F.expr("cast(i % 64 as long)").alias("place"), F.col("parity").cast("long").alias("parity"))


@CATALOG.add("r10_sector_repair", f"WITH b AS (SELECT doc_id, unnest({_B}) AS x, unnest(range(octet_length(encode(text)))) AS i FROM documents) SELECT doc_id, count(*) AS repaired, sum(x * (i + 1))::BIGINT AS weighted FROM b WHERE i // 64 = 1 GROUP BY doc_id")
def r10(spark, folder):
    """The second sector of every payload is lost and comes back from its slot's parity and the other sectors."""
    d = _payload(spark, folder).select("doc_id", bytemaps.second_sector("data").alias("x")).where("x.repaired > 0")
    return d.select("doc_id", "x.repaired", "x.weighted")


@CATALOG.add("w15_delta_decode", f"SELECT doc_id, sum(v * (i + 1))::BIGINT AS weighted, count(*) AS n FROM (SELECT doc_id, i, ((-sum(x) OVER (PARTITION BY doc_id, i % 3 ORDER BY i)) % 256 + 256) % 256 AS v FROM (SELECT doc_id, unnest({_B}) AS x, unnest(range(octet_length(encode(text)))) AS i FROM documents)) GROUP BY doc_id")
def w15(spark, folder):
    """Three channels of running differences modulo 256, summed up as they are decoded."""
    return _payload(spark, folder).select("doc_id", bytemaps.delta_sums(True)("data").alias("x")).where("x.n > 0").select("doc_id", "x.weighted", "x.n")


@CATALOG.add("w16_delta_encode", f"SELECT doc_id, sum(v * (i + 1))::BIGINT AS weighted, count(*) AS n FROM (SELECT doc_id, i, ((coalesce(lag(x) OVER (PARTITION BY doc_id, i % 3 ORDER BY i), 0) - x) % 256 + 256) % 256 AS v FROM (SELECT doc_id, unnest({_B}) AS x, unnest(range(octet_length(encode(text)))) AS i FROM documents)) GROUP BY doc_id")
def w16(spark, folder):
    """Three channels of differences to the byte before, modulo 256."""
    return _payload(spark, folder).select("doc_id", bytemaps.delta_sums(False)("data").alias("x")).where("x.n > 0").select("doc_id", "x.weighted", "x.n")


@CATALOG.add("c21_delta_filter", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c21(spark, folder):
    """Delta filter with four channels, encoded and decoded again by the byte kernels: the payload's digest must come back."""
    from ..functions.kernels import binary_kernel
    from ..functions.filters import delta_decode, delta_encode

    trip = binary_kernel(lambda b: delta_decode(delta_encode(b, 4), 4))
    return _payload(spark, folder).select("doc_id", F.sha2(trip("data"), 256).alias("digest"))


_SIG = "CASE doc_id % 6 WHEN 0 THEN unhex('526172211A0701') WHEN 1 THEN unhex('526172211A0700') WHEN 2 THEN unhex('52457E5E') WHEN 3 THEN unhex('4D5A') WHEN 4 THEN unhex('52457E5E00526172211A0700') ELSE unhex('') END"
_SIG_D = "CASE doc_id % 6 WHEN 0 THEN '526172211A0701' WHEN 1 THEN '526172211A0700' WHEN 2 THEN '52457E5E' WHEN 3 THEN '4D5A' WHEN 4 THEN '52457E5E00526172211A0700' ELSE '' END"
# The three signatures and the scan window
SIGNATURES = {"5+": "526172211A0701", "1.5-4": "526172211A0700", "1.3": "52457E5E"}
SCAN = 8 << 20


def signature_at_start(data: Column) -> Column:
    h = F.hex(F.substr(data, F.lit(1), F.lit(8)))
    out = F.lit(None)
    for name, mark in reversed(SIGNATURES.items()):
        out = F.when(h.startswith(mark), name).otherwise(out)
    return out


def signature_scan(data: Column) -> Column:
    """family and offset of the first strong signature in the window; the 1.3 one counts only where no strong one is."""
    head = F.decode(F.substr(data, F.lit(1), F.lit(SCAN + 8)), "ISO-8859-1")
    at = {k: F.instr(head, F.lit(bytes.fromhex(m).decode("latin-1"))) for k, m in SIGNATURES.items()}
    far = F.lit((1 << 31) - 1)
    five, four = F.when(at["5+"] > 0, at["5+"]).otherwise(far), F.when(at["1.5-4"] > 0, at["1.5-4"]).otherwise(far)
    strong = F.least(five, four)
    return F.when(strong < far, F.struct(F.when(five < four, "5+").otherwise("1.5-4").alias("family"), (strong - 1).alias("offset"))).when(at["1.3"] > 0, F.struct(F.lit("1.3").alias("family"), (at["1.3"] - 1).alias("offset")))


@CATALOG.add("s01_signature_at_start", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '5+' WHEN 1 THEN '1.5-4' WHEN 2 THEN '1.3' WHEN 4 THEN '1.3' END AS family FROM documents")
def s01(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", F.concat(F.expr(_SIG), F.encode("text", "UTF-8")).alias("data"))
    return d.select("doc_id", signature_at_start(F.col("data")).alias("family"))


@CATALOG.add("s02_signature_scan", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '5+' WHEN 1 THEN '1.5-4' WHEN 2 THEN '1.3' WHEN 4 THEN '1.5-4' END AS family, octet_length(encode(text)) + CASE WHEN doc_id % 6 = 4 THEN 5 ELSE 0 END AS offset_ FROM documents WHERE doc_id % 6 NOT IN (3, 5)")
def s02(spark, folder):
    """A signature behind a self-extractor's own bytes."""
    d = read(spark, folder, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), F.expr(_SIG)).alias("data"))
    return d.select("doc_id", signature_scan(F.col("data")).alias("x")).where("x is not null").select("doc_id", "x.family", F.col("x.offset").cast("long").alias("offset_"))


@CATALOG.add("p25_header_crc_5", f"SELECT doc_id, doc_id % 9 <> 4 AS valid FROM documents")
def p25(spark, folder):
    """CRC-32 of a header without its own four bytes against the stored value; every ninth header is damaged."""
    body = F.col("data")
    stored = F.when(F.col("doc_id") % 9 == 4, F.crc32(body).bitwiseXOR(1)).otherwise(F.crc32(body))
    d = _payload(spark, folder).withColumn("header", F.concat(F.unhex(F.lpad(F.hex(stored), 8, "0")), body))
    return d.select("doc_id", (F.crc32(F.substr("header", F.lit(5))) == F.conv(F.hex(F.substr("header", F.lit(1), F.lit(4))), 16, 10).cast("long")).alias("valid"))


@CATALOG.add("p26_header_crc_4", f"SELECT doc_id, {_CRC} & 65535 AS crc16 FROM (SELECT doc_id, {_B} AS b FROM documents)")
def p26(spark, folder):
    return _payload(spark, folder).select("doc_id", F.crc32("data").bitwiseAND(65535).alias("crc16"))


@CATALOG.add("c01_stored_copy", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents")
def c01(spark, folder):
    """A stored payload is a slice of the archive's bytes."""
    d = read(spark, folder, "documents").select("doc_id", F.concat(F.lit(b"head"), F.encode("text", "UTF-8"), F.lit(b"tail")).alias("archive"))
    piece = F.substr("archive", F.lit(5), F.length("archive") - 8)
    return d.select("doc_id", F.sha2(piece, 256).alias("digest"), F.length(piece).cast("long").alias("size"))


@CATALOG.add("c34_packed_bytes", "SELECT doc_id, sha256(text[3:]) AS digest FROM documents")
def c34(spark, folder):
    """Undecoded bytes of a range: a text from its third character on."""
    return read(spark, folder, "documents").select("doc_id", F.sha2(F.encode(F.substr("text", F.lit(3)), "UTF-8"), 256).alias("digest"))


@CATALOG.add("c32_verify_integrity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true ELSE doc_id % 5 <> 2 END AS ok, CASE WHEN doc_id % 3 = 0 THEN 'hash' ELSE 'crc32' END AS by FROM documents")
def c32(spark, folder):
    """A strong hash, where present, decides alone; a wrong CRC-32 beside it passes."""
    crc = F.when(F.col("doc_id") % 5 == 2, F.crc32("data").bitwiseXOR(1)).otherwise(F.crc32("data"))
    d = _payload(spark, folder).withColumn("crc", crc).withColumn("hash", F.when(F.col("doc_id") % 3 == 0, F.sha2("data", 256)))
    return d.select("doc_id", F.when(F.col("hash").isNotNull(), F.sha2("data", 256) == F.col("hash")).otherwise(F.crc32("data") == F.col("crc")).alias("ok"), F.when(F.col("hash").isNotNull(), "hash").otherwise("crc32").alias("by"))


# Length and CRC-32 of the standard filter programs
PROGRAMS = [(53, 0xAD576887, "e8"), (57, 0x3CD7E57E, "e8e9"), (120, 0x3769893F, "itanium"), (29, 0x0E06077D, "delta"), (149, 0x1C2C5DC8, "rgb"), (216, 0xBC85E701, "audio")]


@CATALOG.add("c26_standard_filters", "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'e8' WHEN 1 THEN 'e8e9' WHEN 2 THEN 'itanium' WHEN 3 THEN 'delta' WHEN 4 THEN 'rgb' WHEN 5 THEN 'audio' END AS filter FROM orders")
def c26(spark, folder):
    """A filter program is known by its length and CRC-32."""
    dim = spark.createDataFrame(PROGRAMS, "size long, crc long, filter string")
    pick = F.element_at(F.array(*(F.struct(F.lit(n).cast("long").alias("size"), F.lit(c).cast("long").alias("crc")) for n, c, _ in PROGRAMS), *(F.struct(F.lit(k).cast("long").alias("size"), F.lit(5).cast("long").alias("crc")) for k in (53, 7))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = read(spark, folder, "orders").select("o_orderkey", pick.alias("p")).select("o_orderkey", "p.size", "p.crc")
    return o.join(dim, ["size", "crc"], "left").select("o_orderkey", "filter")
