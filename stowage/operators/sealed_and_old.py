"""Payloads of the older compressed formats, encrypted headers, walks by ranges, older recovery volumes."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ciphers, lzold, ranges, sealed
from ..functions import formats as A
from ..functions.kernels import binary_kernel
from ..plans.catalog import Catalog
from ..sources.tables import read
from .archives import _containers, _walk_sql

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


# ------------------------------------------------------------------ payloads of 2.0 and 2.9
def _pages_through(layout_name: str):
    def run(spark, folder: str) -> DataFrame:
        layout = getattr(lzold, layout_name)
        trip = binary_kernel(lambda b: lzold.Decoder(layout).decode(lzold.encode(b, layout), len(b)))
        return read(spark, folder, "pages").select("page_id", F.sha2(trip(F.encode("html", "UTF-8")), 256).alias("digest"))

    return run


CATALOG.add("c03_unpack_20", "SELECT page_id, sha256(html) AS digest FROM pages")(_pages_through("V20"))
CATALOG.add("c04_unpack_29", "SELECT page_id, sha256(html) AS digest FROM pages")(_pages_through("V29"))


def _chains(layout_name: str):
    def run(spark, folder: str) -> DataFrame:
        """A conversation is a chain: the members are packed one by one, and one decoder goes through them in order."""
        layout = getattr(lzold, layout_name)

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, decoder = pdf.sort_values("turn"), lzold.Decoder(layout)
            return pdf.assign(data=[decoder.decode(lzold.encode(bytes(b), layout), len(b)) for b in pdf.data])

        c = read(spark, folder, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data"))
        return c.groupBy("conv_id").applyInPandas(chain, "conv_id long, turn long, data binary").select("conv_id", "turn", F.sha2("data", 256).alias("digest"))

    return run


CATALOG.add("c11_encode_20", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")(_chains("V20"))
CATALOG.add("c12_encode_29", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")(_chains("V29"))


@CATALOG.add("c03_audio_blocks", "SELECT page_id, sha256(html) AS digest FROM pages")
def c03_audio(spark, folder):
    """Audio blocks of 2.0 with two channels, which predict each other."""
    trip = binary_kernel(lambda b: lzold.Decoder(lzold.V20).decode(lzold.encode_audio(b, 2), len(b)))
    return read(spark, folder, "pages").select("page_id", F.sha2(trip(F.encode("html", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c25_audio_filter", "SELECT page_id, sha256(html) AS digest FROM pages")
def c25(spark, folder):
    trip = binary_kernel(lambda b: lzold.audio_filter(lzold.audio_filter(b, 3, False), 3))
    return read(spark, folder, "pages").select("page_id", F.sha2(trip(F.encode("html", "UTF-8")), 256).alias("digest"))


@CATALOG.add("c36_canonical_codes", "SELECT k, s AS symbol, least(s + 1, k) AS length, coalesce(sum(1 << (15 - least(s + 1, k))) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_place FROM (SELECT n_nationkey AS k, unnest(range(0, n_nationkey + 1)) AS s FROM nation WHERE n_nationkey BETWEEN 1 AND 15)")
def c36(spark, folder):
    """Codes of lengths 1, 2, 3 up to k, the last one twice: the first place of each symbol in the look-up of 15 bits, and its length."""
    from ..functions.lz50 import canonical

    @F.pandas_udf("array<struct<symbol:long,length:long,first_place:long>>")
    def places(k: pd.Series) -> pd.Series:
        out = []
        for n in k:
            table = canonical([*range(1, n + 1), n])
            firsts = [i for i in range(len(table)) if i == 0 or table[i] != table[i - 1]]
            out.append([{"symbol": table[i][0], "length": table[i][1], "first_place": i} for i in firsts])
        return pd.Series(out)

    n = read(spark, folder, "nation").where("n_nationkey between 1 and 15").select(F.col("n_nationkey").cast("long").alias("k"))
    return n.select("k", F.explode(places("k")).alias("x")).select("k", "x.*")


# ------------------------------------------------------------------ encrypted headers
def _sealed(spark, folder: str, with_check: bool = True) -> DataFrame:
    """The documents' containers with encrypted headers; the salt follows from the container's name."""

    @F.pandas_udf("binary")
    def seal(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([sealed.seal(bytes(c), b"password", zlib.crc32(p.encode()).to_bytes(16, "little"), 4, with_check) for p, c in zip(path, content, strict=True)])

    return _containers(spark, folder, "5+").select("path", seal("path", "content").alias("content"))


def read_sealed(containers: DataFrame, password: bytes, walk=sealed.walk) -> DataFrame:
    """path and the walk's columns kind, name, packed, header_ok for each block of sealed containers; a key is derived once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p.as_py(), x["kind"], x["name"], x["packed"], x["header_ok"]) for p, c in zip(batch.column("path"), batch.column("content"), strict=True) for x in walk(c.as_py() or b"", password)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], ["path", "kind", "name", "packed", "header_ok"])

    return containers.select("path", "content").mapInArrow(run, "path string, kind string, name binary, packed long, header_ok boolean")


@CATALOG.add("s15_encrypted_headers", _walk_sql(True))
def s15(spark, folder):
    b = read_sealed(_sealed(spark, folder), b"password")
    return b.groupBy(F.col("path").alias("archive"), "kind").agg(F.count("*").alias("blocks"), F.bool_and("header_ok").alias("headers_ok"))


@CATALOG.add("s16_encrypted_headers_3", _walk_sql(True))
def s16(spark, folder):
    """Every header of format 3 behind its salt: the containers share four salts, and a worker derives a key once for each."""

    @F.pandas_udf("binary")
    def seal(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([sealed.seal15(bytes(c), b"password", (zlib.crc32(p.encode()) % 4).to_bytes(8, "little")) for p, c in zip(path, content, strict=True)])

    c = _containers(spark, folder, "1.5-4").select("path", seal("path", "content").alias("content"))
    return read_sealed(c, b"password", sealed.walk15).groupBy(F.col("path").alias("archive"), "kind").agg(F.count("*").alias("blocks"), F.bool_and("header_ok").alias("headers_ok"))


@CATALOG.add("y11_header_password", "SELECT 'a' || doc_id // 64 AS archive, 'correct' AS right_one, 'wrong' AS other FROM documents GROUP BY 1")
def y11(spark, folder):
    """Without a stored check, the first header is decrypted for trial and its check value decides."""
    trial = lambda p: binary_kernel(lambda b: sealed.matches(b, p), "string")
    return _sealed(spark, folder, False).select(F.col("path").alias("archive"), trial(b"password")("content").alias("right_one"), trial(b"guess")("content").alias("other"))


@CATALOG.add("s27_password_probe", "SELECT 'a' || doc_id // 64 AS archive, 4 AS log_rounds, 16 AS salt_bytes, true AS has_check FROM documents GROUP BY 1")
def s27(spark, folder):
    """What a password is tried against, from the first 256 bytes of a container: no payload is read."""

    @F.pandas_udf("struct<log_rounds:int,salt_bytes:int,has_check:boolean>")
    def look(head: pd.Series) -> pd.DataFrame:
        found = [sealed.probe(bytes(b)) for b in head]
        return pd.DataFrame([{"log_rounds": p["log_rounds"], "salt_bytes": len(p["salt"]), "has_check": p["check"] != bytes(12)} for p in found])

    return _sealed(spark, folder).select(F.col("path").alias("archive"), look(F.substr("content", F.lit(1), F.lit(256))).alias("x")).select("archive", "x.*")


# ------------------------------------------------------------------ walks by ranges
def _by_ranges(family: str):
    def run(spark, folder: str) -> DataFrame:
        """Blocks of containers by ranged reads, and whether these stay within 512 bytes a block."""

        @F.pandas_udf("struct<blocks:long,same:boolean,bounded:boolean>")
        def look(content: pd.Series) -> pd.DataFrame:
            out = []
            for c in content:
                reader = ranges.Counted(bytes(c))
                found = list(ranges.walk(reader, 512))
                out.append({"blocks": len(found), "same": found == list(A.parse(bytes(c))), "bounded": reader.bytes_read <= 512 * (len(found) + 2)})
            return pd.DataFrame(out)

        return _containers(spark, folder, family).select(F.col("path").alias("archive"), look("content").alias("x")).select("archive", "x.*")

    return run


_RANGES = "SELECT 'a' || doc_id // 64 AS archive, count(*) + 2 AS blocks, true AS same, true AS bounded FROM documents GROUP BY 1"
CATALOG.add("s05_seekable_scan", _RANGES)(_by_ranges("5+"))
CATALOG.add("s17_range_cursor", _RANGES)(_by_ranges("1.5-4"))


@CATALOG.add("s30_replayable_source", "SELECT 'a' || doc_id // 64 AS archive, count(*) AS members, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def s30(spark, folder):
    """One reader is walked twice: first for the headers, then for payloads from the last member to the first."""

    @F.pandas_udf("struct<members:long,bytes:long>")
    def twice(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            reader = ranges.Counted(bytes(c))
            files = [x for x in ranges.walk(reader) if x["kind"] == "file"]
            whole = [p for x in reversed(files) if A.payload_ok(x, p := ranges.payload(reader, x))]
            out.append({"members": len(whole), "bytes": sum(map(len, whole))})
        return pd.DataFrame(out)

    return _containers(spark, folder, "5+").select(F.col("path").alias("archive"), twice("content").alias("x")).select("archive", "x.*")


# ------------------------------------------------------------------ recovery records and volumes
def parse_old_rev(name: str, data: bytes) -> tuple[int, int, int] | None:
    """(index, recovery count, data count) of a recovery volume of format 3: from its last seven bytes if their check value fits, else from the last three numbers of its name."""
    if len(data) >= 7 and zlib.crc32(data[:-4]) == struct.unpack("<I", data[-4:])[0]:
        return data[-5], data[-6] + 1, data[-7] + 1
    numbers = [int(n) for n in re.findall(r"[0-9]+", name.rpartition(".")[0])][-3:]
    if len(numbers) < 3 or not all(0 < n < 256 for n in numbers):
        return None
    return numbers[2] - 1, numbers[1], numbers[0]


@CATALOG.add("s26_old_recovery_volumes", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey % 5 END AS shard, CASE WHEN s_suppkey % 3 < 2 THEN 5 END AS recovery, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey % 40 + 1 END AS data FROM supplier")
def s26(spark, folder):
    """Recovery volumes that tell their place in a trailer, in their name, or nowhere."""

    @F.pandas_udf("struct<shard:long,recovery:long,data:long>")
    def look(k: pd.Series, name: pd.Series) -> pd.DataFrame:
        out = []
        for i, s in zip(k, name, strict=True):
            body, i = s.encode(), int(i)
            if i % 3 == 0:
                body += bytes((i % 40, 4, i % 5))
                body += struct.pack("<I", zlib.crc32(body))
            found = parse_old_rev(f"set_{i % 40 + 1}_5_{i % 5 + 1}.rev" if i % 3 == 1 else "unnamed.rev", body)
            out.append(dict(zip(("shard", "recovery", "data"), found or (None, None, None), strict=True)))
        return pd.DataFrame(out)

    return read(spark, folder, "supplier").select("s_suppkey", look("s_suppkey", "s_name").alias("x")).select("s_suppkey", "x.*")


@CATALOG.add("s31_recovery_descriptor", "SELECT c_custkey, c_custkey % 100 + 1 AS percent, c_custkey % 700 AS payload_size FROM customer")
def s31(spark, folder):
    """A recovery service tells its percentage in its own record; the payload is what it protects with."""

    @F.pandas_udf("struct<percent:long,payload_size:long>")
    def look(k: pd.Series) -> pd.DataFrame:
        out = []
        for i in k:
            i = int(i)
            body = A.vint(0) + A.vint(i % 700) + A.vint(0) + A.vint(0) + A.vint(0) + A.vint(2) + b"RR"
            data = A.block50(3, 0, body, A.extra50(7, A.vint(i % 100 + 1)), bytes(i % 700))
            x = next(A.parse50(data, 0))
            record = next(e["data"] for e in x["extras"] if e["type"] == 7)
            percent, end = A.read_vint(record, 0)
            out.append({"percent": percent if x["name"] == b"RR" and end == len(record) else None, "payload_size": x["packed"]})
        return pd.DataFrame(out)

    return read(spark, folder, "customer").select("c_custkey", look("c_custkey").alias("x")).select("c_custkey", "x.*")


# ------------------------------------------------------------------ keys
@CATALOG.add("j11_key_cache", "SELECT s_nationkey AS salt, count(*) AS members, 1 AS derivations, count(DISTINCT s_nationkey) AS keys FROM supplier GROUP BY 1")
def j11(spark, folder):
    """Members that share a salt share a derived key: each (password, salt) is derived in one row and joined back."""

    @F.pandas_udf("binary")
    def derive(salt: pd.Series) -> pd.Series:
        return pd.Series([ciphers.keys50(b"password", int(s).to_bytes(16, "little"), 6)["key"] for s in salt])

    s = read(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("salt"))
    keys = s.groupBy("salt").agg(F.lit(1).alias("derivations")).withColumn("key", derive("salt"))
    return s.join(keys, "salt").groupBy("salt").agg(F.count("*").alias("members"), F.max("derivations").alias("derivations"), F.count_distinct("key").alias("keys"))
