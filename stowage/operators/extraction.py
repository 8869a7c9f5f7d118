"""Volume sets written and extracted again, header fields, comments, links, keys, filter choice, recovery."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums, ciphers, filters, namecodecs, recovery
from ..functions import formats as A
from ..functions.kernels import binary_kernel
from ..plans.catalog import Catalog
from ..sources.archives import members_of, read_blocks
from ..sources.tables import fragments, read
from ..streaming import volumes as V
from .archives import _containers, _members

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles
WRITERS = {"5+": A.write50, "1.5-4": A.write15, "1.3": A.write13}


# ------------------------------------------------------------------ volume sets
def write_volumes(members: DataFrame, size: int, family: str = "5+") -> DataFrame:
    """(set_id, volume, content) from (set_id, name, payload): a payload is cut at every `size` bytes, one volume a piece."""
    write = WRITERS[family]

    def cut(batches):
        for pdf in batches:
            rows = []
            for set_id, name, data in zip(pdf.set_id, pdf.name, pdf.payload, strict=True):
                data = bytes(data)
                n = max(1, -(-len(data) // size))
                for v in range(n):
                    piece = data[v * size : (v + 1) * size]
                    m = {"name": bytes(name), "payload": piece, "split_before": v > 0, "split_after": v < n - 1, "unpacked": len(data)}
                    more = {"volume": v, "more": v < n - 1} if family == "5+" else {"end_flags": int(v < n - 1), "number": v} if family == "1.5-4" else {}
                    rows.append((set_id, v, write([m], **more)))
            yield pd.DataFrame(rows, columns=["set_id", "volume", "content"])

    return members.select("set_id", "name", "payload").mapInPandas(cut, "set_id long, volume int, content binary")


def extract_sets(volumes: DataFrame) -> DataFrame:
    """set_id, name, payload, pieces, whole: fragments of a set joined in volume order; whole where the first starts, the last ends, and none is missing."""
    b = read_blocks(volumes.select(F.concat_ws("/", "set_id", "volume").alias("path"), "content"), payload=True).where("kind = 'file'")
    b = b.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("set_id"), F.split_part("path", F.lit("/"), F.lit(2)).cast("int").alias("volume"), "name", "payload", "payload_ok", "split_before", "split_after")
    g = b.groupBy("set_id", "name").agg(F.array_sort(F.collect_list(F.struct("volume", "payload", "split_before", "split_after"))).alias("f"), F.bool_and("payload_ok").alias("ok"))
    whole = ~F.element_at("f", 1)["split_before"] & ~F.element_at("f", -1)["split_after"] & (F.element_at("f", -1)["volume"] - F.element_at("f", 1)["volume"] + 1 == F.size("f"))
    joined = F.aggregate("f", F.lit(b""), lambda s, x: F.concat(s, x["payload"]))
    return g.select("set_id", F.decode("name", "UTF-8").alias("name"), joined.alias("payload"), F.size("f").alias("pieces"), (whole & F.col("ok")).alias("whole"))


def _sets(family: str):
    def run(spark, folder: str) -> DataFrame:
        m = _members(spark, folder).select(F.col("member_index").alias("set_id"), "name", "payload")
        out = extract_sets(write_volumes(m, 2000, family))
        return out.select("set_id", "pieces", "whole", F.sha2("payload", 256).alias("digest"))

    return run


_SETS = "SELECT doc_id AS set_id, greatest(1, (octet_length(encode(text)) + 1999) // 2000) AS pieces, true AS whole, sha256(text) AS digest FROM documents"
CATALOG.add("k08_write_volumes_5", _SETS)(_sets("5+"))
CATALOG.add("k10_write_volumes_4", _SETS)(_sets("1.5-4"))
CATALOG.add("k12_write_volumes_1", _SETS)(_sets("1.3"))


@CATALOG.add("k21_test_volume_set", "SELECT doc_id AS set_id, n - 1 <> doc_id % 3 OR n = 1 AS whole FROM (SELECT doc_id, greatest(1, (octet_length(encode(text)) + 1999) // 2000) AS n FROM documents) WHERE n > 1 OR doc_id % 3 <> 0")
def k21(spark, folder):
    """Sets that lost one volume (0, 1 or 2): a set whose last volume went is not whole, nor one with a gap or without its start."""
    m = _members(spark, folder).select(F.col("member_index").alias("set_id"), "name", "payload")
    v = write_volumes(m, 2000).where("volume <> set_id % 3")
    found = extract_sets(v).select("set_id", "whole", "pieces")
    n = read(spark, folder, "documents").selectExpr("doc_id AS set_id", "greatest(1, (octet_length(text) + 1999) div 2000) AS n")
    return found.join(n, "set_id").select("set_id", F.when(F.expr("set_id % 3 >= n"), F.col("whole")).otherwise(~F.col("whole") & (F.expr("set_id % 3") != F.col("n") - 1) | (F.col("n") == 1)).alias("whole"))


@CATALOG.add("x01_arriving_volumes", "WITH r AS (SELECT *, volume - row_number() OVER (PARTITION BY set_id ORDER BY volume) AS run FROM {fragments}), g AS (SELECT set_id, run, min(volume) AS first_volume, max(volume) AS last_volume, count(*) AS fragments, sum(packed_size)::BIGINT AS packed_size FROM r GROUP BY ALL) SELECT set_id, first_volume, last_volume, fragments, packed_size, CASE WHEN last_volume = max(last_volume) OVER (PARTITION BY set_id) THEN 'complete' ELSE 'missing_volume' END AS status FROM g")
def x01(spark, folder):
    """The streaming fold's step over whole sets: a gap ends a run with an error row, the last volume completes one."""
    f = fragments(spark, folder)
    last = F.col("volume") == F.max("volume").over(Window.partitionBy("set_id"))
    f = f.select("set_id", "volume", "packed_size", last.alias("is_last"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = V.advance(int(pdf.set_id.iloc[0]), None, list(zip(pdf.volume.tolist(), pdf.packed_size.tolist(), pdf.is_last.tolist(), strict=True)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in V.OUTPUT.split(", ")])

    return f.groupBy("set_id").applyInPandas(run, V.OUTPUT)


@CATALOG.add("x04_late_volumes", "SELECT set_id, volume, volume < max(volume) OVER (PARTITION BY set_id ORDER BY role, volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM {fragments} QUALIFY late")
def x04(spark, folder):
    """Volumes that come after a higher one, when they arrive by role."""
    w = Window.partitionBy("set_id").orderBy("role", "volume").rowsBetween(Window.unboundedPreceding, -1)
    return fragments(spark, folder).select("set_id", "volume", (F.col("volume") < F.max("volume").over(w)).alias("late")).where("late")


@CATALOG.add("x06_errors_as_rows", "SELECT 'a' || doc_id // 64 AS archive, count(*) FILTER (doc_id % 5 = 2 AND octet_length(encode(text)) > 0) AS damaged, count(*) AS members FROM documents GROUP BY 1")
def x06(spark, folder):
    """Damaged members do not stop the others: every fifth payload has a wrong first byte, and each member has its own verdict."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member_index")
        ms = [{"name": bytes(n), "payload": bytes(p), "crc": zlib.crc32(bytes(p)) ^ (1 if i % 5 == 2 and len(p) else 0)} for i, n, p in zip(pdf.member_index, pdf.name, pdf.payload, strict=True)]
        return pd.DataFrame({"path": [pdf.archive.iloc[0]], "content": [A.write50(ms)]})

    c = _members(spark, folder).groupBy("archive").applyInPandas(build, "path string, content binary")
    b = members_of(read_blocks(c, payload=True))
    return b.groupBy(F.col("path").alias("archive")).agg(F.count_if(~F.col("payload_ok")).alias("damaged"), F.count("*").alias("members"))


# ------------------------------------------------------------------ header fields
_FIELDS = "SELECT 'a' || doc_id // 64 AS archive, source || '/' || lang || '/' || doc_id || '.txt' AS name, octet_length(encode(text)) AS unpacked, 33188 AS attr, {host} AS host, 0 AS method FROM documents"


def _header_fields(family: str):
    def run(spark, folder: str) -> DataFrame:
        b = read_blocks(_containers(spark, folder, family)).where("kind = 'file'")
        return b.select(F.col("path").alias("archive"), F.decode("name", "UTF-8").alias("name"), "unpacked", "attr", "host", "method")

    return run


CATALOG.add("s09_file_header_5", _FIELDS.replace("{host}", "1"))(_header_fields("5+"))
CATALOG.add("s10_file_header_4", _FIELDS.replace("{host}", "3"))(_header_fields("1.5-4"))


@CATALOG.add("s33_end_block_number", "SELECT s_suppkey AS number, true AS has_next FROM supplier")
def s33(spark, folder):
    make = binary_kernel(lambda b: A.write15([], end_flags=1, number=int(b) & 0xFFFF))
    c = read(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), make(F.encode(F.col("s_suppkey").cast("string"), "UTF-8")).alias("content"))
    b = read_blocks(c).where("kind = 'end'")
    return b.select(F.col("time").alias("number"), (F.col("flags").bitwiseAND(1) != 0).alias("has_next"))


@CATALOG.add("c29_archive_comment", "SELECT page_id, url AS comment FROM pages")
def c29(spark, folder):
    """An archive's comment is the payload of a service block."""
    make = binary_kernel(lambda b: A.write50([], comment=b))
    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make(F.encode("url", "UTF-8")).alias("content"))
    b = read_blocks(c, payload=True).where("kind = 'service' and name = CAST('CMT' AS BINARY) and payload_ok")
    return b.select(F.col("path").cast("long").alias("page_id"), F.decode("payload", "UTF-8").alias("comment"))


@CATALOG.add("c31_symlink_targets", "SELECT page_id, url AS target FROM pages")
def c31(spark, folder):
    """The payload of a Unix link before format 5 is its target."""
    make = binary_kernel(lambda b: A.write15([{"name": b"link", "payload": b, "attr": 0o120777}]))
    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make(F.encode("url", "UTF-8")).alias("content"))
    b = read_blocks(c, payload=True).where("kind = 'file' and host = 3 and (attr & 61440) = 40960")
    return b.select(F.col("path").cast("long").alias("page_id"), F.decode("payload", "UTF-8").alias("target"))


@CATALOG.add("k19_print_members", "SELECT doc_id, text FROM documents")
def k19(spark, folder):
    b = members_of(read_blocks(_containers(spark, folder, "5+"), payload=True))
    return b.select(F.regexp_extract(F.decode("name", "UTF-8"), r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.decode("payload", "UTF-8").alias("text"))


@CATALOG.add("k23_extract_with_links", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'link' ELSE 'payload' END AS sort, CASE WHEN page_id % 4 = 0 THEN url END AS target FROM pages")
def k23(spark, folder):
    """Members with a redirection record go to the links, the others to the payloads."""

    @F.pandas_udf("binary")
    def make(i: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([A.write50([{"name": b"n", "payload": b"" if k % 4 == 0 else b"data", **({"link": (1, 0, u.encode())} if k % 4 == 0 else {})}]) for k, u in zip(i, url, strict=True)])

    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make("page_id", "url").alias("content"))
    b = members_of(read_blocks(c))
    record = F.get(F.filter("extras", lambda e: e["type"] == 5), 0)["data"]

    @F.pandas_udf("string")
    def target(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            if d is None:
                out.append(None)
                continue
            _, at = A.read_vint(d, 0)
            _, at = A.read_vint(d, at)
            n, at = A.read_vint(d, at)
            out.append(bytes(d[at : at + n]).decode())
        return pd.Series(out)

    return b.select(F.col("path").cast("long").alias("page_id"), F.when(record.isNotNull(), "link").otherwise("payload").alias("sort"), target(record).alias("target"))


@CATALOG.add("b10_rewrite", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def b10(spark, folder):
    """Archives rewritten without the labelled members."""
    from ..plans.facade import ArchivePlan

    gone = read(spark, folder, "labels").select(F.col("doc_id").alias("member_index")).distinct()
    out = ArchivePlan(_members(spark, folder)).remove(gone).build()
    b = members_of(read_blocks(out.withColumnRenamed("archive", "path"), payload=True))
    return b.select(F.regexp_extract(F.decode("name", "UTF-8"), r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.sha2("payload", 256).alias("digest"))


# ------------------------------------------------------------------ names, keys
@CATALOG.add("f05_decode_marked", "SELECT page_id, url AS name FROM pages")
def f05(spark, folder):
    back = binary_kernel(lambda b: namecodecs.decode_marked((namecodecs.MARK + b.decode()).encode()))
    return read(spark, folder, "pages").select("page_id", F.decode(back(F.encode("url", "UTF-8")), "UTF-8").alias("name"))


@CATALOG.add("f07_encode_packed", "SELECT page_id, length(url) + 2 + (length(url) + 3) // 4 + 2 * length(url) AS bytes FROM pages WHERE octet_length(encode(url)) = length(url)")
def f07(spark, folder):
    pack = binary_kernel(lambda b: namecodecs.encode_packed(b.decode()))
    p = read(spark, folder, "pages").where("octet_length(url) = length(url)")
    return p.select("page_id", F.length(pack(F.encode("url", "UTF-8"))).cast("long").alias("bytes"))


@CATALOG.add("f11_lossy_utf8", "SELECT page_id, url || '�' AS shown FROM pages")
def f11(spark, folder):
    lossy = binary_kernel(lambda b: b.decode("utf-8", "replace"), "string")
    return read(spark, folder, "pages").select("page_id", lossy(F.concat(F.encode("url", "UTF-8"), F.lit(b"\xff"))).alias("shown"))


def _derived(password: str, salt: str):
    @F.pandas_udf("struct<check:binary,hash_key:binary>")
    def run(password: pd.Series, salt: pd.Series) -> pd.DataFrame:
        keys = [ciphers.keys50(p.encode(), int(s).to_bytes(16, "little"), 3) for p, s in zip(password, salt, strict=True)]
        return pd.DataFrame({"check": [k["check"] for k in keys], "hash_key": [k["hash_key"] for k in keys]})

    return run(password, salt)


@CATALOG.add("j08_password_candidates", "SELECT n_nationkey AS archive, c.i AS candidate, CASE WHEN n_nationkey % 6 = 5 THEN 'undetermined' WHEN c.i = n_nationkey % 4 THEN 'correct' ELSE 'wrong' END AS verdict FROM nation, (SELECT unnest(range(4)) AS i) c")
def j08(spark, folder):
    """Candidates against archives: the caller's list is a literal that every archive explodes; keys are derived once for each pair of password and salt."""
    candidates = F.array(*(F.struct(F.lit(i).cast("long").alias("candidate"), F.lit(f"word{i}").alias("password")) for i in range(4)))
    archives = read(spark, folder, "nation").select(F.col("n_nationkey").alias("archive"))
    stored = archives.withColumn("right", F.concat(F.lit("word"), F.expr("archive % 4")))
    stored = stored.select("archive", F.when(F.expr("archive % 6 = 5"), F.lit(bytes(8))).otherwise(_derived("right", "archive")["check"]).alias("stored"))
    tried = stored.select("*", F.inline(candidates)).withColumn("check", _derived("password", "archive")["check"])
    verdict = F.when(F.col("stored") == F.lit(bytes(8)), "undetermined").when(F.col("stored") == F.col("check"), "correct").otherwise("wrong")
    return tried.select("archive", "candidate", verdict.alias("verdict"))


@CATALOG.add("t07_first_proved_password", "SELECT n_nationkey AS archive, n_nationkey % 4 AS candidate FROM nation WHERE n_nationkey % 6 <> 5")
def t07(spark, folder):
    return j08(spark, folder).where("verdict = 'correct'").groupBy("archive").agg(F.min("candidate").alias("candidate"))


@CATALOG.add("y09_keyed_checksums", "SELECT n_nationkey, true AS same_key_same_mac, true AS other_key_other_mac FROM nation")
def y09(spark, folder):
    @F.pandas_udf("struct<a:long,b:long,c:binary>")
    def macs(k: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for i, s in zip(k, name, strict=True):
            key = ciphers.keys50(b"pw", int(i).to_bytes(16, "little"), 2)["hash_key"]
            other = ciphers.keys50(b"pw2", int(i).to_bytes(16, "little"), 2)["hash_key"]
            crc = zlib.crc32(s.encode())
            rows.append({"a": checksums.mac_crc32(key, crc), "b": checksums.mac_crc32(other, crc), "c": checksums.mac_hash(key, checksums.blake2sp(s.encode()))})
        return pd.DataFrame(rows)

    n = read(spark, folder, "nation").withColumn("x", macs("n_nationkey", "n_name")).withColumn("y", macs("n_nationkey", "n_name"))
    return n.select("n_nationkey", ((F.col("x.a") == F.col("y.a")) & (F.col("x.c") == F.col("y.c"))).alias("same_key_same_mac"), (F.col("x.a") != F.col("x.b")).alias("other_key_other_mac"))


# ------------------------------------------------------------------ checksums, fields, recovery
@CATALOG.add("a06_crc32_of_zeros", "SELECT s_suppkey, true AS same FROM supplier")
def a06(spark, folder):
    @F.pandas_udf("boolean")
    def same(n: pd.Series) -> pd.Series:
        return pd.Series([checksums.zeros(0xFFFFFFFF, int(i) * 37) ^ 0xFFFFFFFF == zlib.crc32(bytes(int(i) * 37)) for i in n])

    return read(spark, folder, "supplier").select("s_suppkey", same("s_suppkey").alias("same"))


def _field(bits: int):
    field = recovery.GF16 if bits == 16 else recovery.GF8

    def run(spark, folder: str) -> DataFrame:
        @F.pandas_udf("boolean")
        def unit(n: pd.Series) -> pd.Series:
            return pd.Series([int(field.multiply(x, field.inverse(x))) == 1 for x in (int(i) % field.order + 1 for i in n)])

        return read(spark, folder, "orders").select("o_orderkey", unit("o_orderkey").alias("unit"))

    return run


CATALOG.add("m06_field_65536", "SELECT o_orderkey, true AS unit FROM orders")(_field(16))
CATALOG.add("m07_field_256", "SELECT o_orderkey, true AS unit FROM orders")(_field(8))


@CATALOG.add("r07_recovery_volume_repair", "SELECT s_nationkey AS set_id, count(*) AS volumes, least(count(*), 2) AS repaired, true AS equal FROM supplier GROUP BY s_nationkey")
def r07(spark, folder):
    """Data volumes of a set: two that fail their check are solved from recovery volumes and checked again."""
    s = read(spark, folder, "supplier").select(F.col("s_nationkey").alias("set_id"), "s_suppkey", F.encode("s_name", "UTF-8").alias("data"))

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s_suppkey")
        size = max(map(len, pdf.data)) + 1 & ~1
        data = [bytes(b).ljust(size, b"\0") for b in pdf.data]
        checks = [(len(b), zlib.crc32(b)) for b in data]
        revs = [A.parse_rev(A.write_rev(len(data) + i, checks, 2, p)) for i, p in enumerate(recovery.encode(data, 2))]
        arrived = [b if i > 1 else b"damaged" for i, b in enumerate(data)]
        valid = [b if (len(b), zlib.crc32(b)) == c else None for b, c in zip(arrived, revs[0]["shards"], strict=True)]
        back = recovery.reconstruct(valid, [(i, r["payload"]) for i, r in enumerate(revs) if r["ok"]])
        ok = all((len(b), zlib.crc32(b)) == c for b, c in zip(back, checks, strict=True))
        return pd.DataFrame({"set_id": [pdf.set_id.iloc[0]], "volumes": [len(data)], "repaired": [sum(v is None for v in valid)], "equal": [ok]})

    return s.groupBy("set_id").applyInPandas(repair, "set_id long, volumes long, repaired long, equal boolean")


@CATALOG.add("r03_parity_shards", "SELECT doc_id // 8 AS g, 2 AS shards FROM documents GROUP BY 1")
def r03(spark, folder):
    """Two parity shards for each group of eight payloads."""

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = max(map(len, pdf.data)) + 1 & ~1
        parity = recovery.encode([bytes(b).ljust(size, b"\0") for b in pdf.sort_values("doc_id").data], 2)
        return pd.DataFrame({"g": [key[0]] * len(parity), "data": parity})

    d = read(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return d.groupBy(F.expr("doc_id div 8").alias("g")).applyInPandas(encode, "g long, data binary").groupBy("g").agg(F.count("*").alias("shards"))


@CATALOG.add("r09_tagged_sector_repair", "SELECT doc_id, count(*) AS sectors FROM (SELECT doc_id, unnest(range((octet_length(encode(text)) + 63) // 64)) AS i FROM documents) WHERE i = 1 GROUP BY doc_id")
def r09(spark, folder):
    """Sectors with a tag of 16 check bits: the damaged one of each payload is told by its tag and rebuilt from its slot."""
    from ..functions.bytemaps import tagged

    d = read(spark, folder, "documents").select("doc_id", tagged(F.encode("text", "UTF-8")).alias("sectors")).where("sectors > 0")
    return d.groupBy("doc_id").agg(F.sum("sectors").alias("sectors"))


# ------------------------------------------------------------------ filter choice
@CATALOG.add("g05_choose_filter")
def g05(spark, folder):
    """The filter whose output a fast packer makes smallest, unfiltered first: the search's own packer is stood in for by zlib."""
    trials = {"none": lambda b: b, **{f"delta{c}": (lambda b, c=c: filters.delta_encode(b, c)) for c in (1, 2, 4)}, "e8": filters.x86_encode}

    @F.pandas_udf("struct<filter:string,packed:long>")
    def choose(data: pd.Series) -> pd.DataFrame:
        rows = []
        for b in data:
            sizes = {k: len(zlib.compress(f(bytes(b)), 1)) for k, f in trials.items()}
            best = min(sizes, key=sizes.get)
            rows.append({"filter": best if sizes[best] * 100 < sizes["none"] * 99 else "none", "packed": sizes[best]})
        return pd.DataFrame(rows)

    return read(spark, folder, "pages").select("page_id", choose(F.encode("html", "UTF-8")).alias("x")).select("page_id", "x.*")


@CATALOG.add("c15_match_round_trip", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def c15(spark, folder):
    """Texts packed with literals and matches."""
    from ..functions import lz50

    trip = binary_kernel(lambda b: lz50.Decoder().decode(lz50.encode(b), len(b)))
    return read(spark, folder, "conversations").select("conv_id", "turn", F.sha2(trip(F.encode("text", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c08_code_tables", "SELECT page_id, true AS complete FROM pages")
def c08(spark, folder):
    """Tables of packed pages: the literal codes read back fill the code space exactly."""
    from ..functions import lz50

    def complete(b: bytes) -> bool:
        packed = lz50.encode(b, False)
        first, end, bits, _, _ = lz50.parse_block(packed, 0)
        return sum(2.0**-n for n in lz50.read_tables(lz50.Window(packed[first:end], bits))[0] if n) == 1.0

    return read(spark, folder, "pages").select("page_id", binary_kernel(complete, "boolean")(F.encode("html", "UTF-8")).alias("complete"))


# ------------------------------------------------------------------ typed records
@CATALOG.add("s12_main_records", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS quick_open, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS recovery FROM orders")
def s12(spark, folder):
    """Locator records written and read: offsets of the quick-open and recovery services."""
    from ..functions import extras

    @F.pandas_udf("struct<quick_open:long,recovery:long>")
    def trip(q: pd.Series, r: pd.Series) -> pd.DataFrame:
        value = lambda x: None if pd.isna(x) else int(x)
        rows = [extras.read_locator(extras.write_locator(value(a), value(b))) for a, b in zip(q, r, strict=True)]
        return pd.DataFrame({k: pd.array([x[k] for x in rows], "Int64") for k in ("quick_open", "recovery")})

    o = read(spark, folder, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS q", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS r")
    return o.select("o_orderkey", trip("q", "r").alias("x")).select("o_orderkey", "x.*")


@CATALOG.add("s34_archive_metadata", "SELECT c_custkey, c_name AS name, c_custkey * 10000000 + 116444736000000000 AS ticks FROM customer")
def s34(spark, folder):
    """The original name and creation time of an archive."""
    from ..functions import extras

    @F.pandas_udf("struct<name:string,ticks:long>")
    def trip(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = [extras.read_metadata(extras.write_metadata(s.encode(), unix=int(i))) for s, i in zip(n, k, strict=True)]
        return pd.DataFrame({"name": [r["name"].decode() for r in rows], "ticks": [r["ticks"] for r in rows]})

    return read(spark, folder, "customer").select("c_custkey", trip("c_name", "c_custkey").alias("x")).select("c_custkey", "x.*")


@CATALOG.add("d09_time_records", "SELECT o_orderkey, o_orderkey * 1234567891 AS modified, o_custkey * 1000000007 AS created FROM orders")
def d09(spark, folder):
    """Times of a member to the nanosecond, through the record and back."""
    from ..functions import extras

    @F.pandas_udf("struct<modified:long,created:long>")
    def trip(m: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = [extras.read_times(extras.write_times({"modified": int(a), "created": int(b)})) for a, b in zip(m, c, strict=True)]
        return pd.DataFrame(rows)

    o = read(spark, folder, "orders").selectExpr("o_orderkey", "o_orderkey * 1234567891 AS m", "o_custkey * 1000000007 AS c")
    return o.select("o_orderkey", trip("m", "c").alias("x")).select("o_orderkey", "x.*")


@CATALOG.add("d08_extended_times", "SELECT o_orderkey, o_orderkey * 7919 % 20000000 AS fraction FROM orders")
def d08(spark, folder):
    """Format 3's extension: fractions of 100 ns and the odd second beside a DOS word."""
    from ..functions import extras

    trip = binary_kernel(lambda b: extras.read_extended(extras.write_extended([(1, int(b)), None, None, (2, 5)]), 1)[0][1], "long")
    return read(spark, folder, "orders").select("o_orderkey", trip(F.encode(F.expr("o_orderkey * 7919 % 20000000").cast("string"), "UTF-8")).alias("fraction"))


@CATALOG.add("y04_key_derivation_3", "SELECT r_regionkey, 16 AS key_bytes, 16 AS iv_bytes FROM region")
def y04(spark, folder):
    """Keys of format 3 for one salt each: 2**18 rounds of SHA-1, so distinct salts only."""
    derive = binary_kernel(lambda b: b"".join(ciphers.keys30(b"password", b.rjust(8, b"0"))))
    r = read(spark, folder, "region").select("r_regionkey", derive(F.encode(F.col("r_regionkey").cast("string"), "UTF-8")).alias("k"))
    return r.select("r_regionkey", F.length(F.substr("k", F.lit(1), F.lit(16))).alias("key_bytes"), (F.length("k") - 16).alias("iv_bytes"))


# ------------------------------------------------------------------ further scans, sinks and reports
@CATALOG.add("s03_scan_from_bytes", "SELECT page_id, (['5+', '1.5-4', '1.3'])[(page_id % 3 + 1)::INT] AS family, 1 AS members FROM pages")
def s03(spark, folder):
    """Containers of all three families, told apart by their signatures behind a stub."""

    @F.pandas_udf("binary")
    def make(i: pd.Series, url: pd.Series) -> pd.Series:
        writers = (A.write50, A.write15, A.write13)
        return pd.Series([b"stub" + writers[k % 3]([{"name": b"n", "payload": u.encode()}]) for k, u in zip(i, url, strict=True)])

    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make("page_id", "url").alias("content"))
    b = read_blocks(c).where("kind = 'file'")
    return b.groupBy(F.col("path").cast("long").alias("page_id"), "family").agg(F.count("*").alias("members"))


@CATALOG.add("s04_scan_from_path", "SELECT 'none' AS kind, false AS header_ok, 'no signature' AS error")
def s04(spark, folder):
    """Files under a path, through Spark's own reader; a table's file is no archive, and one row says so."""
    from ..sources.archives import read_files

    return read_files(spark, f"{folder}/region.parquet").select("kind", "header_ok", "error")


@CATALOG.add("s29_ingest_path")
def s29(spark, folder):
    """Files under a path as members to be: name, size and time; contents are not projected."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/region.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("unpacked_size"))


@CATALOG.add("s37_protect_headers", "SELECT s_suppkey, s_suppkey % 500 AS rec_sectors, s_suppkey * 7 AS blocks, 2 * s_suppkey * 7 + 512 * (s_suppkey % 500) AS data_size FROM supplier")
def s37(spark, folder):
    @F.pandas_udf("struct<rec_sectors:long,blocks:long,data_size:long>")
    def trip(k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([A.read_protect(A.protect15(int(i) % 500, int(i) * 7)) for i in k])

    return read(spark, folder, "supplier").select("s_suppkey", trip("s_suppkey").alias("x")).select("s_suppkey", "x.*")


@CATALOG.add("c33_authenticity_flag", "SELECT page_id, page_id % 2 = 0 AS present FROM pages")
def c33(spark, folder):
    """Format 1.3 says only that authenticity data is there."""

    @F.pandas_udf("binary")
    def make(i: pd.Series) -> pd.Series:
        return pd.Series([A.write13([], flags=0xA0 if k % 2 == 0 else 0x80) for k in i])

    c = read(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), make("page_id").alias("content"))
    return read_blocks(c).where("kind = 'main'").select(F.col("path").cast("long").alias("page_id"), (F.col("flags").bitwiseAND(0x20) != 0).alias("present"))


@CATALOG.add("b13_build_bytes", "SELECT 'a' || doc_id // 64 AS archive, (7 + sum(21 + octet_length(encode(source || '/' || lang || '/' || doc_id || '.txt')) + octet_length(encode(text))))::BIGINT AS bytes FROM documents GROUP BY 1")
def b13(spark, folder):
    """Sizes of built containers of format 1.3: a header of seven bytes, then 21 bytes, the name and the payload of each member."""
    return _containers(spark, folder, "1.3").select(F.col("path").alias("archive"), F.length("content").cast("long").alias("bytes"))


@CATALOG.add("k15_collected_volumes", "SELECT doc_id AS set_id, greatest(1, (octet_length(encode(text)) + 1999) // 2000) AS volumes FROM documents")
def k15(spark, folder):
    """The volumes of a set as one ordered array."""
    m = _members(spark, folder).select(F.col("member_index").alias("set_id"), "name", "payload")
    g = write_volumes(m, 2000).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("volume", "content"))).alias("v"))
    return g.select("set_id", F.size("v").cast("long").alias("volumes"))


@CATALOG.add("k18_restore_order", "SELECT member_index, row_number() OVER (PARTITION BY archive ORDER BY is_directory, CASE WHEN is_directory THEN -len(string_split(name, '/')) ELSE 0 END, member_index) AS step FROM {members}")
def k18(spark, folder):
    """Times are restored on files first, then on directories from the deepest up."""
    from ..sources.tables import members

    depth = F.when(F.col("is_directory"), -F.size(F.split("name", "/"))).otherwise(0)
    return members(spark, folder).select("member_index", F.row_number().over(Window.partitionBy("archive").orderBy("is_directory", depth, "member_index")).alias("step"))


@CATALOG.add("k20_extract_volume_set", "SELECT doc_id AS set_id, text FROM documents")
def k20(spark, folder):
    m = _members(spark, folder).select(F.col("member_index").alias("set_id"), "name", "payload")
    return extract_sets(write_volumes(m, 3000)).select("set_id", F.decode("payload", "UTF-8").alias("text"))


@CATALOG.add("x05_controlled_stop", "SELECT archive, count(*) AS extracted FROM (SELECT archive, member_index, min(CASE WHEN is_damaged THEN member_index END) OVER (PARTITION BY archive) AS stop FROM {members}) WHERE stop IS NULL OR member_index < stop GROUP BY archive")
def x05(spark, folder):
    """Extraction stops at the first damaged member of an archive."""
    from ..sources.tables import members

    m = members(spark, folder)
    stop = m.groupBy("archive").agg(F.min(F.when(F.col("is_damaged"), F.col("member_index"))).alias("stop"))
    return m.join(stop, "archive").where("stop is null or member_index < stop").groupBy("archive").agg(F.count("*").alias("extracted"))


@CATALOG.add("a19_recovery_report", "SELECT s_nationkey AS set_id, count(*) AS expected, count(*) FILTER (s_suppkey % 5 <> 1) AS available, count(*) FILTER (s_suppkey % 5 <> 1 AND s_suppkey % 9 = 2) AS damaged, count(*) FILTER (s_suppkey % 5 = 1 OR s_suppkey % 9 = 2) <= 2 AS repairable FROM supplier GROUP BY s_nationkey")
def a19(spark, folder):
    """Shards of a set that are expected, that arrived and that fail their check; two parity shards repair two."""
    s = read(spark, folder, "supplier").selectExpr("s_nationkey AS set_id", "s_suppkey % 5 <> 1 AS here", "s_suppkey % 9 = 2 AS bad")
    return s.groupBy("set_id").agg(F.count("*").alias("expected"), F.count_if("here").alias("available"), F.count_if(F.col("here") & F.col("bad")).alias("damaged"), (F.count_if(~F.col("here") | F.col("bad")) <= 2).alias("repairable"))


@CATALOG.add("y10_random_salts", "SELECT count(*) AS salts, true AS all_differ FROM orders")
def y10(spark, folder):
    """Salts from the operating system, one for each member; no two are equal."""
    import os

    @F.pandas_udf("binary")
    def urandom(k: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(16) for _ in k])

    salt = urandom.asNondeterministic()
    o = read(spark, folder, "orders").select(salt("o_orderkey").alias("salt"))
    return o.agg(F.count("*").alias("salts"), (F.count_distinct("salt") == F.count("*")).alias("all_differ"))


@CATALOG.add("g04_screened_kinds")
def g04(spark, folder):
    """Packed size of the sample window of a page for each kind of filter."""
    kinds = {"none": lambda b: b, "delta": lambda b: filters.delta_encode(b, 3), "e8": filters.x86_encode, "arm": filters.arm_encode}
    from ..functions.bits import sample_range

    p = read(spark, folder, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"))
    r = sample_range(F.length("data").cast("long"))
    p = p.select("page_id", F.substr("data", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")).alias("sample"))
    sizes = F.array(*(F.struct(F.lit(k).alias("kind"), binary_kernel(lambda b, f=f: len(zlib.compress(f(b), 1)), "long")("sample").alias("packed")) for k, f in kinds.items()))
    return p.select("page_id", F.inline(sizes))


@CATALOG.add("w07_block_splitting")
def w07(spark, folder):
    """Blocks of payloads by drift: byte counts of a payload's chunks go through the ordered fold."""
    import numpy as np

    from ..functions.blocks import cuts
    from ..functions.bytemaps import chunk_counts

    blocks = binary_kernel(lambda b: cuts(chunk_counts(np.frombuffer(b, np.uint8), 4096)) if b else [], "array<long>")
    d = read(spark, folder, "documents").select("doc_id", F.posexplode(blocks(F.encode("text", "UTF-8"))).alias("chunk", "block"))
    return d.groupBy("doc_id", "block").agg(F.min(F.col("chunk").cast("long")).alias("first_chunk"), F.count("*").alias("chunks"))


# ------------------------------------------------------------------ more on keys
@CATALOG.add("y06_key_derivation_5", "SELECT n_nationkey, 32 AS key_bytes, 32 AS hash_key_bytes, true AS differ FROM nation")
def y06(spark, folder):
    """Key, hash key and check of a password: three taps of one PBKDF2 chain."""

    @F.pandas_udf("struct<key_bytes:int,hash_key_bytes:int,differ:boolean>")
    def derive(k: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = [ciphers.keys50(s.encode(), int(i).to_bytes(16, "little"), 6) for i, s in zip(k, name, strict=True)]
        return pd.DataFrame({"key_bytes": [len(r["key"]) for r in rows], "hash_key_bytes": [len(r["hash_key"]) for r in rows], "differ": [r["key"] != r["hash_key"] for r in rows]})

    return read(spark, folder, "nation").select("n_nationkey", derive("n_nationkey", "n_name").alias("x")).select("n_nationkey", "x.*")


@CATALOG.add("y08_password_check", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' ELSE 'undetermined' END AS verdict FROM nation")
def y08(spark, folder):
    """The stored record of eight bytes and four of their SHA-256; an all-zero record says nothing."""

    @F.pandas_udf("string")
    def verdict(k: pd.Series) -> pd.Series:
        out = []
        for i in k:
            check = ciphers.keys50(b"pw", int(i).to_bytes(16, "little"), 4)["check"]
            other = ciphers.keys50(b"no", int(i).to_bytes(16, "little"), 4)["check"]
            stored = (ciphers.check_record(check), ciphers.check_record(other), bytes(12))[int(i) % 3]
            out.append(ciphers.verdict(check, stored))
        return pd.Series(out)

    return read(spark, folder, "nation").select("n_nationkey", verdict("n_nationkey").alias("verdict"))


@CATALOG.add("y12_keyed_tree_hash", "SELECT n_nationkey, 32 AS bytes, true AS keyed FROM nation")
def y12(spark, folder):
    """A strong hash under a password is an HMAC of the plain one."""

    @F.pandas_udf("struct<bytes:int,keyed:boolean>")
    def mac(k: pd.Series, name: pd.Series) -> pd.DataFrame:
        plain = [checksums.blake2sp(s.encode()) for s in name]
        keyed = [checksums.mac_hash(int(i).to_bytes(32, "little"), d) for i, d in zip(k, plain, strict=True)]
        return pd.DataFrame({"bytes": [len(x) for x in keyed], "keyed": [x != d for x, d in zip(keyed, plain, strict=True)]})

    return read(spark, folder, "nation").select("n_nationkey", mac("n_nationkey", "n_name").alias("x")).select("n_nationkey", "x.*")
