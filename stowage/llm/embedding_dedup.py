"""Embedding near-dedup by sorted projection passes.

Vectors that are equal, component by component, collapse into one representative with a weight. In each
pass, 63 random hyperplanes through the corpus mean give a vector a signature of 63 bits; vectors are
ordered by signature, in blocks between splitters, and each is compared by cosine with
the `window` vectors before it in its block. Pairs with cosine >= `least` are united across passes.

Passes follow from the number of vectors and the recall asked for: `share_found` gives the chance that one
pass brings a pair at the limiting cosine into a window, from the share of signature bits that
such a pair has in common, with the measured mean cosine of the corpus taken out. Where parts of the corpus are denser
than its mean tells, this is too few; so further passes follow until they unite
no more than a share 1 - `recall` of the linked vectors.

Windows bound the candidates only, not the links: inside a component every link is counted, whatever
its distance in a pass. Members within half the limiting angle of the component's first
vector all link to each other (the triangle inequality of angles), so they are counted by weight; the
others are compared with the whole component, in blocks of matrix products that return counts and
never pairs. `exact` compares all vectors in this way instead of by passes.

Comparisons are made in single precision; pairs whose product its rounding leaves open are decided in
double precision.

Defined cases: null, empty and zero vectors and those with null or non-finite components link
with nothing; vectors of different length never link; rows that repeat a vec_id count as one vector
(if their embeddings differ, the one with the larger fingerprint); rows with a null vec_id
are left out, since no id names them; extra columns are ignored, whatever their names. Up to `window` vectors, one pass compares all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, cut, splitmix, stored

LEAST, RECALL, WINDOW = 0.9, 0.999, 1024
BLOCK, TILE = 1 << 17, 2048
BITS = 63
SAMPLE = 1 << 16  # vectors from which splitters are taken


def _units(flat: np.ndarray, n: int) -> np.ndarray:
    """n vectors of one length as rows of length 1, in double precision."""
    x = flat.reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _by_length(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their unit vectors) of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = np.asarray(column.flatten()), np.asarray(column.value_lengths())
    start = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, _units(flat[start[rows][:, None] + np.arange(d)], len(rows))


def _margin(d: int) -> float:
    """Bound of the rounding of a product of unit vectors in single precision."""
    return (d + 8) * float(np.finfo(np.float32).eps)


# ------------------------------------------------------------------ passes and windows
def share_found(n: int, window: int, cosine: float, mean: float, block: int = BLOCK) -> float:
    """Chance that one pass over n vectors brings a pair at `cosine` into a window.

    Around the mean, whose squared length is `mean`, the pair shares a bit with probability p. If k bits are shared, it
    lies on both sides of the middle of about n / 2**k vectors.
    """
    if n <= window + 1:
        return 1.0
    inner = max(-1.0, min(1.0, (cosine - mean) / max(1 - mean, 1e-9)))
    p = 1 - math.acos(inner) / math.pi
    total = p**BITS
    for k in range(BITS):
        r = window * 2.0**k / n
        total += p**k * (1 - p) * (1.0 if r >= 1 else 2 * r * r if r <= 0.5 else 1 - 2 * (1 - r) ** 2)
    return total * (1 - window / (2 * block) if n > block else 1)


def passes_for(n: int, window: int, cosine: float, mean: float, recall: float) -> int:
    found = share_found(n, window, cosine, mean)
    return 1 if found >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _planes(p: int, d: int) -> np.ndarray:
    return np.random.default_rng([20240501, p, d]).standard_normal((d, BITS))


def signature(x: np.ndarray, mean: np.ndarray, p: int) -> np.ndarray:
    """The bits of pass p, the first plane in the highest."""
    return ((x - mean) @ _planes(p, x.shape[1]) >= 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def linked(x: np.ndarray, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the rows they are united with, from all pairs of at most `window` rows apart whose cosine is at least `least`."""
    n, step = len(x), max(window, 1)
    y, margin = x.astype(np.float32), _margin(x.shape[1])
    out_a, out_b = [], []
    for i in range(0, n, step):
        past, low = min(i + step, n), max(0, i - step)
        dots = y[i:past] @ y[low:past].T
        apart = np.arange(i, past)[:, None] - np.arange(low, past)[None, :]
        near = (dots >= least - margin) & (apart > 0) & (apart <= window)
        if not near.any():
            continue
        a, b = np.nonzero(near & (dots < least + margin))
        if len(a):
            near[a, b] = np.einsum("ij,ij->i", x[i + a], x[low + b]) >= least
        label, own = np.arange(past - low), np.arange(i - low, past - low)
        while True:  # the least label of each row and of what it links with, until nothing changes
            before = label.copy()
            label[own] = np.minimum(label[own], np.where(near, label[None, :], past).min(axis=1))
            label = np.minimum(label, np.where(near, label[own][:, None], past).min(axis=0))
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(past - low))
        out_a.append(low + moved)
        out_b.append(low + label[moved])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def candidates(reps: DataFrame, passes: range, n: int, means: dict[int, np.ndarray], window: int, least: float, block: int = BLOCK) -> DataFrame:
    """a, b: edges whose components are those of all pairs that the windows of these passes find."""
    sc = reps.sparkSession.sparkContext
    splitters: dict[tuple[int, int], np.ndarray] = {}
    if n > block:  # a hash of the id chooses about SAMPLE vectors, whatever n
        sample = reps.where(F.xxhash64("id") < F.lit(int(SAMPLE / n * 2.0**64) - 2**63)).select("vector").toArrow()
        for d, rows, x in _by_length(sample.column("vector")):
            parts = math.ceil(n * len(rows) / max(sample.num_rows, 1) / block)
            for p in passes:
                order = np.sort(signature(x, means[d], p))
                splitters[p, d] = order[(np.arange(1, parts) * len(order)) // parts]
    shared = sc.broadcast((splitters, means))  # a number for each block and pass

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters, means = shared.value
        for batch in batches:
            for d, rows, x in _by_length(batch.column("vector")):
                own = batch.take(pa.array(rows))
                ids = np.asarray(own.column("id"))
                for p in passes:
                    sig = signature(x, means[d], p)
                    cuts = splitters.get((p, d), np.zeros(0, np.int64))
                    first, past = np.searchsorted(cuts, sig, side="left"), np.searchsorted(cuts, sig, side="right")
                    deal = splitmix(ids.view(np.uint64) ^ np.uint64(p)) % (past - first + 1).astype(np.uint64)  # equal signatures over several blocks
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), pa.array(np.full(len(rows), d, np.int32)), pa.array((first + deal.astype(np.int64)).astype(np.int32)), pa.array(sig), own.column("id"), own.column("vector")], ["pass", "d", "block", "signature", "id", "vector"])

    def meet(group: pa.Table) -> pa.Table:
        ids, sig = np.asarray(group.column("id")), np.asarray(group.column("signature"))
        order = np.lexsort((ids, sig))
        (_, _, x), = _by_length(group.column("vector"))
        a, b = linked(x[order], window, least)
        return pa.table({"a": ids[order[a]], "b": ids[order[b]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    kind = reps.schema["vector"].dataType.simpleString()
    signed = reps.select("id", "vector").mapInArrow(sign, f"pass int, d int, block int, signature long, id long, vector {kind}")
    return signed.groupBy("pass", "d", "block").applyInArrow(meet, "a long, b long").distinct()


def _means(reps: DataFrame) -> tuple[dict[int, np.ndarray], float]:
    """The mean unit vector of each length, and the largest mean cosine of two vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for d, rows, x in _by_length(batch.column("vector")):
                total[d] = total.get(d, 0) + x.sum(0)
                count[d] = count.get(d, 0) + len(rows)
        for d, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(-1, d)), pa.array(np.concatenate([[count[d]], t]))], ["d", "at", "v"])

    sums = reps.select("vector").mapInArrow(run, "d long, at long, v double").groupBy("d", "at").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in sums.toLocalIterator():  # d + 1 numbers for each length
        found.setdefault(r.d, np.zeros(r.d + 1))[r.at + 1] = r.v
    means = {d: t[1:] / t[0] for d, t in found.items()}
    weighty = [float(m @ m) for d, m in means.items() if found[d][0] > WINDOW]
    return means, max(weighty, default=0.0)


def united(reps: DataFrame, n: int, window: int, least: float, recall: float) -> DataFrame:
    """id, component of the representatives that link with others, by as many passes as it takes."""
    means, mean = _means(reps)
    every = 1 if n <= window + 1 else passes_for(n, window, least, mean, recall)
    group = cut(components(cut(candidates(reps, range(every), n, means, window, least))))
    past, more = every, max(2, every // 3)
    while n > window + 1:
        edges = candidates(reps, range(past, past + more), n, means, window, least)
        past += more
        known = lambda c: group.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        edges = edges.join(known("a"), "a", "left").join(known("b"), "b", "left")
        new = cut(edges.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct())
        size = new.count()
        if size:  # only sets that the round unites are joined anew
            over = cut(components(new))
            moved = group.join(over.select(F.col("id").alias("component"), F.col("component").alias("above")), "component", "left").select("id", F.coalesce("above", "component").alias("component"))
            alone = over.join(group.select("id"), "id", "left_anti")
            group = cut(moved.union(alone.select("id", "component")))
        if size <= (1 - recall) * group.count():
            break
    return group


# ------------------------------------------------------------------ links inside components
def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (each the least row of its set, as label[label] == label) after the sets of a[k] and b[k] are united."""
    a, b = label[a], label[b]
    while len(a := a[differ := a != b]):
        b = b[differ]
        pair = np.unique(np.maximum(a, b) * len(label) + np.minimum(a, b))
        a, b = pair // len(label), pair % len(label)
        label = label.copy()
        np.minimum.at(label, a, b)
        while not np.array_equal(label, above := label[label]):
            label = above
        a, b = label[a], label[b]
    return label


def compare(x: np.ndarray, weight: np.ndarray, core: np.ndarray, old: int, least: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(weight of what each row links with, labels of the linked sets) of unit vectors; with `old`, only rows before it meet rows from it on. Rows of the core, last in both parts, do not meet each other."""
    n = len(x)
    y, margin = x.astype(np.float32), _margin(x.shape[1])
    links, label = np.zeros(n), np.arange(n)
    for i in range(0, old or n, tile):
        past = min(i + tile, old or n)
        for j in range(old or i, n, tile):
            if core[i] and core[j]:
                break  # all that follows is of the core too
            dots = y[i:past] @ y[j : j + tile].T
            flat = np.flatnonzero(dots >= least - margin)
            if not len(flat):
                continue
            a, b = i + flat // dots.shape[1], j + flat % dots.shape[1]
            near = dots.ravel()[flat] >= least + margin
            for k in range(0, len(unsure := np.flatnonzero(~near)), 1 << 16):
                own = unsure[k : k + (1 << 16)]
                near[own] = np.einsum("ij,ij->i", x[a[own]], x[b[own]]) >= least
            near &= (a < b) & ~(core[a] & core[b])
            a, b = a[near], b[near]
            links += np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            label = merge(label, a, b)
    return links, label


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def links(member: DataFrame, least: float, block: int) -> DataFrame:
    """a, b, n: members (id, component, size of it, core, weight, vector) that link, one that each is connected to, and the weight of those it links with; links inside the core are left out.

    Small components share tasks; a component beyond `block` members is dealt into blocks, and every pair of blocks is a task.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    large = F.col("size") > block
    m = member.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    m = m.withColumn("key", F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(256)))).withColumn("large", large)
    m = m.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    m = m.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(group: pa.Table) -> pa.Table:
        ids, weight, core = (np.asarray(group.column(c)) for c in ("id", "weight", "core"))
        part, component, weight = np.asarray(group.column("block")), np.asarray(group.column("component")), weight.astype(np.float64)
        found = []
        for _, rows, x in _by_length(group.column("vector")):
            order = np.lexsort((core[rows], part[rows], component[rows]))
            own, x = rows[order], x[order]
            edges = np.flatnonzero(np.diff(component[own])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True):
                if j - i < 2:
                    continue
                p = part[own[i:j]]
                low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
                old = 0 if low == high else int((p == low).sum())
                if low != high and old in (0, j - i):
                    continue  # one block alone has vectors of this length
                n_links, label = compare(x[i:j], weight[own[i:j]], core[own[i:j]], old, least)
                hit = np.flatnonzero(n_links)
                found.append(pa.table([pa.array(ids[own[i + hit]]), pa.array(ids[own[i + label[hit]]]), pa.array(n_links[hit].astype(np.int64))], schema=_OUT))
        return pa.concat_tables(found) if found else _OUT.empty_table()

    return m.select("large", "key", "low", "high", "block", "id", "component", "core", "weight", "vector").groupBy("large", "key", "low", "high").applyInArrow(run, "a long, b long, n long")


def _with_core(member: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """member (id, component, weight, vector) with `core`: whether it lies within half the limiting angle of the component's first vector."""
    half = math.cos(math.acos(least) / 2) + 1e-9
    met = member.join(reps.select(F.col("id").alias("component"), F.col("vector").alias("hub")), "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = np.zeros(batch.num_rows, bool)
            for (_, rows, x), (_, _, y) in zip(_by_length(batch.column("vector")), _by_length(batch.column("hub")), strict=True):  # of one length in a component
                core[rows] = np.einsum("ij,ij->i", x, y) >= half
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "component", "weight", "vector")), pa.array(core)], ["id", "component", "weight", "vector", "core"])

    kind = reps.schema["vector"].dataType.simpleString()
    return met.select("id", "component", "weight", "vector", "hub").mapInArrow(run, f"id long, component long, weight long, vector {kind}, core boolean")


def near_duplicates(vectors: DataFrame, window: int = WINDOW, least: float = LEAST, recall: float = RECALL, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vec_id."""
    own_type = vectors.schema["embedding"].dataType
    kind = "array<float>" if isinstance(own_type, ArrayType) and isinstance(own_type.elementType, FloatType) else "array<double>"
    v = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    fine = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0), F.lit(False))
    v = v.withColumn("fine", fine)
    own = v.select("vec_id", "fine", F.xxhash64("vector").alias("f1"), F.xxhash64(F.lit(1), "vector").alias("f2")).groupBy("vec_id").agg(F.max(F.struct("fine", "f1", "f2")).alias("s")).select("vec_id", "s.*")
    own = cut(own)
    copies = cut(own.where("fine").groupBy("f1", "f2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    reps = v.where("fine").select("vec_id", "vector", F.xxhash64("vector").alias("f1"), F.xxhash64(F.lit(1), "vector").alias("f2")).join(copies.select(F.col("id").alias("vec_id"), "f1", "f2", "weight"), ["vec_id", "f1", "f2"]).dropDuplicates(["vec_id"])
    reps = stored(reps.select(F.col("vec_id").alias("id"), "vector", "weight"), "vector-representatives")
    n = copies.count()
    if exact:
        member = reps.select("id", F.lit(0).cast("long").alias("component"), F.lit(n).alias("size"), "weight", "vector", F.lit(False).alias("core"))
        found = stored(links(member, least, block), "vector-links")
        group = cut(components(found))
        core = group.select("component").distinct().withColumn("core_weight", F.lit(0).cast("long"))
        member = reps.select("id", "weight", F.lit(False).alias("core")).join(group, "id")
    else:
        group = united(reps, n, window, least, recall)
        member = stored(_with_core(reps.join(group, "id"), reps, least), "vector-members")
        core = member.where("core").groupBy("component").agg(F.sum("weight").alias("core_weight"))
        size = member.groupBy("component").agg(F.count("*").alias("size"))
        found = stored(links(member.join(size, "component"), least, block), "vector-links")
    more = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    counted = member.select("id", "component", "weight", "core").join(core, "component", "left").join(more, "id", "left")
    counted = counted.select("id", "component", (F.when(F.col("core"), F.col("core_weight")).otherwise(F.col("weight")) - 1 + F.coalesce("more", F.lit(0))).alias("links"))

    named = copies.join(counted, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("links"), F.col("weight") - 1).alias("n_links"))
    # ids of equal vectors: the component of the representative is already the least of them
    out = own.join(named.withColumn("fine", F.lit(True)), ["fine", "f1", "f2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL),
f AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = v.vec_id
"""
