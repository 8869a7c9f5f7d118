"""Encoder parts as queries, quick listings, read sessions, and callbacks of the caller."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import formats as A
from ..functions import lz50, matches, sealed
from ..functions.extras import read_locator, write_locator
from ..functions.kernels import binary_kernel
from ..plans.catalog import Catalog
from ..sources.archives import members_of, read_blocks
from ..sources.sinks import on_error, progress, selected_by
from ..sources.tables import read
from .archives import _containers

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

_TURNS = "SELECT conv_id, turn, sha256(text) AS digest FROM conversations"
_PAGES = "SELECT page_id, sha256(html) AS digest FROM pages"


def _turns(f):
    def run(spark, folder):
        c = read(spark, folder, "conversations")
        return c.select("conv_id", "turn", F.sha2(binary_kernel(f)(F.encode("text", "UTF-8")), 256).alias("digest"))

    return run


CATALOG.add("c16_hash_chains", _TURNS)(_turns(lambda b: matches.rebuilt(matches.Chains(b).tokens(4094))))


@CATALOG.add("c17_match_trees", "SELECT conv_id, turn, true AS no_shorter FROM conversations")
def c17(spark, folder):
    """At every place the tree's longest match is as long as that of the whole chain."""

    def check(b: bytes) -> bool:
        chains, tree = matches.Chains(b, depth=None), matches.Tree(b, depth=None)
        for i in range(len(b)):
            found, walked = chains.longest(i), tree.place(i)
            chains.add(i)
            if (found[0] if found else 0) != (walked[-1][0] if walked else 0):
                return False
        return True

    return read(spark, folder, "conversations").select("conv_id", "turn", binary_kernel(check, "boolean")(F.encode("text", "UTF-8")).alias("no_shorter"))


@CATALOG.add("c19_optimal_parse", "SELECT conv_id, turn, true AS whole, true AS no_larger FROM conversations")
def c19(spark, folder):
    """Texts through the refined parse, against the greedy one."""

    @F.pandas_udf("struct<whole:boolean,no_larger:boolean>")
    def trip(data: pd.Series) -> pd.DataFrame:
        out = []
        for b in map(bytes, data):
            small = lz50.encode_refined(b)
            out.append({"whole": lz50.Decoder().decode(small, len(b)) == b, "no_larger": len(small) <= len(lz50.encode(b))})
        return pd.DataFrame(out, columns=["whole", "no_larger"])

    return read(spark, folder, "conversations").select("conv_id", "turn", trip(F.encode("text", "UTF-8")).alias("x")).select("conv_id", "turn", "x.*")


@CATALOG.add("c38_filter_records", _PAGES)
def c38(spark, folder):
    """Pages in two parts, each under a filter of its own kind, which the decoder learns from the stream."""

    def trip(b: bytes) -> bytes:
        half, kind = len(b) // 2, zlib.crc32(b) % 4
        parts = [(0, half, kind, 4), (half, len(b) - half, (kind + 1) % 4, 2)] if half else []
        return lz50.Decoder().decode(lz50.encode(b, filters=parts), len(b))

    return read(spark, folder, "pages").select("page_id", F.sha2(binary_kernel(trip)(F.encode("html", "UTF-8")), 256).alias("digest"))


@CATALOG.add("x13_streaming_encode", _PAGES)
def x13(spark, folder):
    """Pages in blocks of 512 bytes, written one at a time."""
    trip = binary_kernel(lambda b: lz50.Decoder().decode(b"".join(lz50.encode_blocks(b, 512)), len(b)))
    return read(spark, folder, "pages").select("page_id", F.sha2(trip(F.encode("html", "UTF-8")), 256).alias("digest"))


# ------------------------------------------------------------------ quick listings
def with_quick_open(data: bytes) -> bytes:
    """A container of format 5+ whose headers are repeated in a service block before its end, with its place in the main header.

    An entry: check value, size, flags, distance back from the block, length, header."""
    blocks = list(A.parse50(data, len(A.MARK50)))
    main, end = blocks[0], blocks[-1]
    middle = data[main["data_offset"] : end["offset"]]
    width = len(write_locator(0, None))
    while True:  # the place's own length moves what follows it
        locator = write_locator(0, None).ljust(width, b"\0")
        grown = len(A.block50(1, 0, A.vint(main["attr"]), A.extra50(1, locator)))
        place = grown + len(middle)
        locator = write_locator(place, None)
        if len(locator) == width:
            break
        width = len(locator)
    head = A.MARK50 + A.block50(1, 0, A.vint(main["attr"]), A.extra50(1, locator))
    shift = len(head) - main["data_offset"]
    at = len(A.MARK50) + place
    entries = []
    for x in blocks[1:-1]:
        header = data[x["offset"] : x["data_offset"]]
        body = A.vint(0) + A.vint(at - x["offset"] - shift) + A.vint(len(header)) + header
        body = A.vint(len(body)) + body
        entries.append(struct.pack("<I", zlib.crc32(body)) + body)
    cache = b"".join(entries)
    fields = A.vint(4) + A.vint(len(cache)) + A.vint(0) + struct.pack("<I", zlib.crc32(cache)) + A.vint(0) + A.vint(1) + A.vint(2) + b"QO"
    return head + middle + A.block50(3, 0, fields, data=cache) + data[end["offset"] :]


def quick_list(data: bytes) -> list[dict] | None:
    """The blocks that the cache names, with their places; None where there is no cache or an entry is damaged, and the walk must do."""
    main = next(A.parse50(data, len(A.MARK50)), None) if data.startswith(A.MARK50) else None
    if main is None or main["kind"] != "main" or not main["header_ok"]:
        return None
    place = next((read_locator(e["data"])["quick_open"] for e in main["extras"] if e["type"] == 1), None)
    if not place:
        return None
    at = main["offset"] + place
    service = next(A.parse50(data[at:], 0), None)
    if service is None or service["kind"] != "service" or service["name"] != b"QO" or not service["header_ok"]:
        return None
    cache = data[at + service["data_offset"] : at + service["data_offset"] + service["packed"]]
    out, k = [], 0
    try:
        while k < len(cache):
            size, body = A.read_vint(cache, k + 4)
            if zlib.crc32(cache[k + 4 : body + size]) != struct.unpack_from("<I", cache, k)[0]:
                return None
            _, j = A.read_vint(cache, body)
            back, j = A.read_vint(cache, j)
            length, j = A.read_vint(cache, j)
            x = next(A.parse50(cache[j : j + length], 0))
            out.append(x | {"offset": at - back, "data_offset": at - back + length, "error": None, "block": len(out) + 1})
            k = body + size
    except (ValueError, struct.error, StopIteration):
        return None
    return out


@CATALOG.add("s28_quick_open", "SELECT 'a' || doc_id // 64 AS archive, count(*) AS members, sum(octet_length(encode(text)))::BIGINT AS packed, true AS same FROM documents GROUP BY 1")
def s28(spark, folder):
    """Listings from the cache that the locator points at, against those of the walk."""

    @F.pandas_udf("struct<members:long,packed:long,same:boolean>")
    def look(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            data = with_quick_open(bytes(c))
            quick = quick_list(data) or []
            out.append({"members": len(quick), "packed": sum(x["packed"] for x in quick), "same": quick == [x | {"error": None} for x in A.parse(data) if x["kind"] == "file"]})
        return pd.DataFrame(out)

    return _containers(spark, folder, "5+").select(F.col("path").alias("archive"), look("content").alias("x")).select("archive", "x.*")


@CATALOG.add("s24_read_session", "SELECT s_nationkey AS set_id, count(*) AS volumes, 1 AS derivations, count(*) AS members FROM supplier GROUP BY 1")
def s24(spark, folder):
    """Volumes of a set with encrypted headers are read one after the other; the set's first volume derives the key, the later ones share it."""

    def session(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys: dict = {}
        members = 0
        for content in pdf.sort_values("volume").content:
            p = sealed.probe(bytes(content))
            known = (p["salt"], p["log_rounds"])
            if known not in keys:
                keys[known] = sealed.keys50(b"password", *known)
            members += sum(x["kind"] == "file" and x["header_ok"] for x in sealed.walk(bytes(content), b"password", keys[known]))
        return pd.DataFrame({"set_id": [key[0]], "volumes": [len(pdf)], "derivations": [len(keys)], "members": [members]})

    @F.pandas_udf("binary")
    def make(set_id: pd.Series, volume: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([sealed.seal(A.write50([{"name": n.encode(), "payload": b"part"}], int(v)), b"password", int(k).to_bytes(16, "little"), 6) for k, v, n in zip(set_id, volume, name, strict=True)])

    s = read(spark, folder, "supplier").select(F.col("s_nationkey").cast("long").alias("set_id"), F.col("s_suppkey").cast("long").alias("volume"), make("s_nationkey", "s_suppkey", "s_name").alias("content"))
    return s.groupBy("set_id").applyInPandas(session, "set_id long, volumes long, derivations long, members long")


# ------------------------------------------------------------------ callbacks
def _read(spark, folder: str):
    m = members_of(read_blocks(_containers(spark, folder, "5+"), payload=True)).withColumn("doc_id", F.regexp_extract(F.decode("name", "UTF-8"), r"/(\d+)\.txt$", 1).cast("long"))
    return m.withColumn("code", F.when(F.col("doc_id") % 9 == 4, "CHECKSUM_MISMATCH").when(F.col("doc_id") % 50 == 33, "INVALID_ARCHIVE"))


@CATALOG.add("v02_selector_callback", "SELECT doc_id FROM documents WHERE octet_length(encode(text)) % 2 = 0")
def v02(spark, folder):
    """A caller's function decides on each member's metadata."""
    return selected_by(_read(spark, folder), lambda m: m["packed"] % 2 == 0, ["packed"]).select("doc_id")


@CATALOG.add("v03_error_handler", "WITH d AS (SELECT doc_id, doc_id // 64 AS a, CASE WHEN doc_id % 9 = 4 THEN 'skip' WHEN doc_id % 50 = 33 THEN 'stop' END AS x FROM documents) SELECT doc_id FROM d WHERE x IS NULL AND NOT EXISTS (SELECT 1 FROM d e WHERE e.a = d.a AND e.x = 'stop' AND e.doc_id < d.doc_id)")
def v03(spark, folder):
    """A caller's function says of each refused member whether it is left out or the container ends there."""
    return on_error(_read(spark, folder), lambda path, index, code: "skip" if code == "CHECKSUM_MISMATCH" else "stop").select("doc_id")


@CATALOG.add("v04_progress", "SELECT 'a' || doc_id // 64 AS path, doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id)::BIGINT AS completed, sum(octet_length(encode(text))) OVER (PARTITION BY doc_id // 64)::BIGINT AS total FROM documents")
def v04(spark, folder):
    """Progress as rows: bytes done behind each member, and those of its container."""
    return progress(_read(spark, folder)).select("path", "doc_id", "completed", "total")
