"""Exact substring dedup over 100-byte strings, resolved by suffix arrays of linear grouping construction.

Every byte covered by a 100-byte string that also starts earlier (in a document with a smaller doc_id, or
earlier in the same one) is removed. A suffix array of a whole corpus is no distributed object, so
the corpus is first reduced, without losing a match, to short strings that need one:

1. Each window of 100 bytes has an anchor, the leftmost 20-byte piece of least hash inside it. Equal windows
   have equal anchors at equal places. The run of windows of one anchor in a document is a context.
2. One scan counts (anchor, context). A context whose content occurs before is removed whole;
   an anchor with one content only needs nothing more. Copies are combined in the tasks.
3. The first context of each content, where its anchor has several, is cut into runs of at most 16
   windows, which share a core of 85 bytes. A core that occurs once has no match; of equal runs all
   but the earliest are removed whole. Where a core has different runs, each becomes the
   string (up to 15 bytes, core as one symbol, up to 15 bytes), in which a window is 16 symbols.
4. These strings of many cores are joined end to end, their suffix array is built by grouping (see
   grouping.py), and neighbours that share 16 symbols form the groups of equal windows; all but the
   earliest of each are removed.
   A core shared by very many runs would put them in one task; its windows are counted one by one
   instead, by a sum that combines in the tasks.

Hashes of 64 bits stand for anchors, contexts and cores. Texts are shuffled once, to be
joined with their removed ranges.

Defined cases: null counts as empty; texts under 100 bytes lose nothing; rows with the same
doc_id do not remove each other (neither is smaller), but each is compared with all others and with itself; a null
doc_id counts as the largest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _POWERS, bounded, byte_table, kept, prefix_hash, shuffles_removed, span_hash, splitmix, text_bytes
from .grouping import suffix_array

LENGTH, PIECE, RUN = 100, 20, 16
SPAN = LENGTH - PIECE + 1  # places of an anchor in a window
LEAST_BITS, MOST_BITS = 26, 30  # of a bitmap of contexts: 2**26 bits are 8 MB, 2**30 are 128 MB
HOT = 2000  # runs of one core that are resolved in one task
_VALUES = byte_table(lower=False)
_LAST = (1 << 63) - 1


def _anchors(h: np.ndarray) -> np.ndarray:
    """For each window of SPAN hashes, the first place of the least one; the 7 low bits of a hash do not count.

    Least values are kept from each block's start and end, with the place in the block in the low bits.
    """
    n = len(h)
    padded = np.full(-(-n // SPAN) * SPAN, np.uint64(2**64 - 1))
    padded[:n] = h
    rows = (padded & ~np.uint64(127)).reshape(-1, SPAN) | np.arange(SPAN, dtype=np.uint64)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    w = np.arange(n - SPAN + 1)
    left, right = behind[w], ahead[w + SPAN - 1]
    earlier = (left >> np.uint64(7)) <= (right >> np.uint64(7))
    block = np.where(earlier, w, w + SPAN - 1) // SPAN * SPAN
    return block + (np.where(earlier, left, right) & np.uint64(127)).astype(np.int64)


def contexts(data: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(anchor place, first window, last window, anchor hash, context hash, prefix hashes) of a text."""
    n = len(data)
    if n < LENGTH:
        return None
    s = prefix_hash(data, _VALUES)
    _, down = _POWERS.get(len(s))
    h = splitmix((s[PIECE:] - s[:-PIECE]) * down[: n - PIECE + 1])
    place = _anchors(h)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    p = place[first]
    return p, first, last, h[p], span_hash(s, first, last + LENGTH), s


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets, _ = text_bytes(batch.column("text"))
    ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
    for i, (doc, tag) in enumerate(zip(ids, tags, strict=True)):
        yield doc, tag, data[offsets[i] : offsets[i + 1]]


def _combined(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, c, d = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((d, c, h))
    h, c, d = h[order], c[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
    n = np.diff(np.concatenate([new, [len(h)]]))
    return pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(c[new].view(np.int64)), pa.array(d[new]), pa.array(n.astype(np.int64))], ["anchor", "content", "doc", "n"])


def context_counts(texts: DataFrame) -> DataFrame:
    """anchor, content, doc (the least), n, contents (of the anchor) for all that occur twice or whose anchor has several contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, _, data in _texts(batch):
                if (found := contexts(data)) is not None:
                    held.append((found[3], found[4], np.full(len(found[0]), doc, np.int64)))
                    size += len(found[0])
            if size > 1 << 19:
                yield _combined(held)
                held, size = [], 0
        if size:
            yield _combined(held)

    rows = texts.mapInArrow(run, "anchor long, content long, doc long, n long").repartition("anchor")
    every = rows.groupBy("anchor", "content").agg(F.min("doc").alias("doc"), F.sum("n").alias("n"))
    own = Window.partitionBy("anchor")  # the partitioning is there already
    every = every.withColumn("contents", F.count("*").over(own)).withColumn("all", F.sum("n").over(own))
    return every.where("all > 1").select("anchor", "content", "doc", "n", "contents")


def _bits(hashed: Column, keys: DataFrame) -> np.ndarray:
    """A bitmap with two bits for each hash, of 16 bits a hash at least while MOST_BITS allow: so few others pass, however many hashes there are."""
    size = 1 << min(max(LEAST_BITS, (16 * keys.count() - 1).bit_length()), MOST_BITS)
    both = F.array(hashed.bitwiseAND(size - 1), F.shiftrightunsigned(hashed, 33).bitwiseAND(size - 1))
    bit = keys.select(F.explode(both).alias("bit"))
    rows = bit.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
    found = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most 2**MOST_BITS bits
        found[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return found


def _hit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    last = np.uint64(len(bits) * 8 - 1)

    def one(x: np.ndarray) -> np.ndarray:
        k = (x & last).astype(np.int64)
        return (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1

    hit = one(h)
    hit[hit] = one(h[hit] >> np.uint64(33))
    return hit


def _again(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a pair stood earlier in the arrays."""
    order = np.lexsort((np.arange(len(x)), y, x))
    out = np.zeros(len(x), bool)
    out[order[1:]] = (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])
    return out


_SCHEMA = "kind int, key long, content long, doc long, tag long, again boolean, first int, last int, string binary"
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("again", pa.bool_()), ("first", pa.int32()), ("last", pa.int32()), ("string", pa.binary())])


def _runs(p: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts (anchor place, first and last window) cut into runs: (core place, first, last, core hash, run hash)."""
    j0, j1 = (p - b) // RUN, (p - a) // RUN
    n = j1 - j0 + 1
    own = np.repeat(np.arange(len(p)), n)
    j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + j0[own]
    base = p[own] - RUN * j  # the core is data[base : base + LENGTH - RUN + 1]
    w0, w1 = np.maximum(a[own], base - RUN + 1), np.minimum(b[own], base)
    return base, w0, w1, span_hash(s, base, base + LENGTH - RUN + 1), span_hash(s, w0, w1 + LENGTH)


def occurrences(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """kind 0: contexts that may repeat (key: anchor); kind 1: runs of windows of the first contexts whose anchor has several contents (key: core), with their strings. again: equal to an earlier one of the same text, which needs no string."""
    spark = texts.sparkSession
    both = F.col("anchor").bitwiseXOR(F.col("content"))
    repeated = spark.sparkContext.broadcast(_bits(both, counts.where("n > 1")))
    mixed = spark.sparkContext.broadcast(_bits(both.bitwiseXOR(F.col("doc")), counts.where("contents > 1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            strings: list[bytes | None] = []
            for doc, tag, data in _texts(batch):
                if (found := contexts(data)) is None:
                    continue
                p, a, b, h, c, s = found
                k = np.flatnonzero(_hit(repeated.value, h ^ c))
                if len(k):
                    held.append((np.zeros(len(k), np.int32), h[k], c[k], np.full(len(k), doc), np.full(len(k), tag), _again(h[k], c[k]), a[k], b[k]))
                    strings += [None] * len(k)
                k = np.flatnonzero(_hit(mixed.value, h ^ c ^ np.uint64(doc & (2**64 - 1))))
                if len(k):
                    base, w0, w1, core, whole = _runs(p[k], a[k], b[k], s)
                    n = len(base)
                    held.append((np.ones(n, np.int32), core, whole, np.full(n, doc), np.full(n, tag), _again(core, whole), w0, w1))
                    raw, skip = data.tobytes(), LENGTH - RUN + 1
                    strings += [None if y else bytes((x - i,)) + raw[i:x] + raw[x + skip : j + LENGTH] for x, i, j, y in zip(base.tolist(), w0.tolist(), w1.tolist(), held[-1][5].tolist(), strict=True)]
            if held:
                kind, key, content, doc, tag, again, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(again), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(strings, pa.binary())], schema=_ARROW)

    return texts.mapInArrow(run, _SCHEMA)


def equal_windows(runs: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Groups of equal windows among runs (core, length of the left part + left + right), as arrays of (run, window of the run).

    The strings are joined end to end, each closed by a mark of its own below all other symbols.
    """
    symbols: list[int] = []
    owner: list[int] = []
    place: list[int] = []
    name: dict[int, int] = {}
    marks = len(runs)
    for i, (core, packed) in enumerate(runs):
        left = packed[0]
        body = [marks + x for x in packed[1:]]
        row = [*body[:left], marks + 256 + name.setdefault(core, len(name)), *body[left:], i]
        symbols += row
        owner += [i] * len(row)
        place += range(len(row))
    order = np.asarray(suffix_array(symbols), np.int64)
    text, own, at = np.asarray(symbols, np.int64), np.asarray(owner, np.int64), np.asarray(place, np.int64)
    n = len(text)
    length = np.bincount(own, minlength=len(runs))
    fits = at + RUN < length[own]  # RUN symbols before the closing mark
    order = order[fits[order]]
    if not len(order):
        return []
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(RUN):  # neighbours in the suffix array that share RUN symbols
        same &= text[np.minimum(order[1:] + k, n - 1)] == text[np.minimum(order[:-1] + k, n - 1)]
    edge = np.flatnonzero(~same) + 1
    return [np.stack([own[g], at[g]], 1) for g in np.split(order, edge) if len(g) > 1]


def repeated_windows(runs: DataFrame, drops: list[Callable[[], None]]) -> DataFrame:
    """doc, tag, first, last: windows of runs (key, content, doc, tag, first, last, string; none of them again) that also start earlier. drops: gets what removes the tables behind them."""
    equal, drop = kept(runs.groupBy("key", "content").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "substring-equal")
    cores = equal.groupBy("key").agg(F.sum("n").alias("held"), F.count("*").alias("kinds")).where("held > 1").select("key", "kinds")
    equal, drop_shared = kept(equal.drop("n").join(cores, "key"), "substring-shared")
    drop()
    runs, drop = kept(runs.join(equal, ["key", "content"]), "substring-runs")
    drop_shared()
    drops.append(drop)
    whole = runs.where("doc > least").select("doc", "tag", "first", "last")
    runs = runs.where("kinds > 1 and doc = least").select(F.col("key").alias("core"), "doc", "tag", "first", "string", F.col("kinds").alias("held"))

    def resolve(held: list[tuple]) -> pa.RecordBatch:
        """held: (core, doc, tag, first, string), whole cores."""
        out: set[tuple[int, int, int]] = set()
        for g in equal_windows([(r[0], r[4]) for r in held]):
            found = sorted((held[i][1], held[i][2], held[i][3] + t) for i, t in g.tolist())
            stays: dict[int, int] = {}
            for doc, tag, at in found:  # of the least document, the earliest window of each text stays
                if doc != found[0][0] or stays.setdefault(tag, at) != at:
                    out.add((doc, tag, at))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[2], pa.int32())], ["doc", "tag", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) > 10 * HOT and row[0] != held[-1][0]:
                    yield resolve(held)
                    held = []
                held.append(row)
        if held:
            yield resolve(held)

    names = ["core", "doc", "tag", "first", "string"]
    few = runs.where(f"held <= {HOT}").select(names).repartition("core").sortWithinPartitions("core")
    found = few.mapInArrow(run, "doc long, tag long, first int, last int")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of a hot core one by one: a hash of (core, place, bytes on both sides)."""
        for batch in batches:
            rows = []
            for core, doc, tag, first, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, body = packed[0], packed[1:]
                for t in range(len(body) - RUN + 2):
                    key = hashlib.blake2b(core.to_bytes(8, "big", signed=True) + bytes([left - t]) + body[t : t + RUN - 1], digest_size=8).digest()
                    rows.append((int.from_bytes(key, "big", signed=True), doc, tag, first + t))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["key", "doc", "tag", "at"])

    many, drop = kept(runs.where(f"held > {HOT}").select(names).mapInArrow(single, "key long, doc long, tag long, at int"), "substring-hot")
    drops.append(drop)
    least = many.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    again = many.join(least, "key")
    stays = again.where("doc = least").groupBy("key", "tag").agg(F.min("at").alias("stays"))
    again = again.join(stays, ["key", "tag"], "left").where("doc <> least or at <> stays")
    return whole.union(found).union(again.select("doc", "tag", "at", F.col("at").alias("last")))


def removed_ranges(texts: DataFrame) -> DataFrame:
    """doc_id, tag, ranges (first and last windows to remove) of texts (doc_id, tag, text) that lose any; the tag tells rows of one doc_id with different texts apart."""
    drops: list[Callable[[], None]] = []

    def table(df: DataFrame, label: str) -> DataFrame:
        out, drop = kept(df, label)
        drops.append(drop)
        return out

    with shuffles_removed(texts.sparkSession):
        counts = table(context_counts(texts), "substring-counts")
        found = table(occurrences(texts, counts), "substring-occurrences")
        places = ["doc", "tag", "first", "last"]
        least = counts.where("n > 1").select(F.col("anchor").alias("key"), "content", F.col("doc").alias("least"))
        again, found = found.where("again").select(places), found.where("not again").drop("again")
        whole = found.where("kind = 0").select("key", "content", *places).join(least, ["key", "content"]).where("doc > least").select(places)
        ranges = again.union(whole).union(repeated_windows(found.where("kind = 1").drop("kind"), drops))
        ranges = ranges.groupBy(F.col("doc").alias("doc_id"), "tag").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))  # of one document
        ranges, _ = kept(ranges, "substring-ranges")
        for drop in drops:
            drop()
    return ranges


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256 for every row."""
    own = bounded(docs).select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    joined = own.join(removed_ranges(own.select("doc_id", "tag", "text")), ["doc_id", "tag"], "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_bytes(batch.column("text"))
            rows = []
            for i, found in enumerate(batch.column("ranges")):
                own = data[offsets[i] : offsets[i + 1]]
                spans: list[list[int]] = []
                for r in found.as_py() or []:
                    a, b = r["first"], min(r["last"] + LENGTH, len(own))
                    if a >= b:
                        continue
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                raw, at, kept = own.tobytes(), 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(left), len(spans), left, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
