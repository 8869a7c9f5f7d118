"""N-gram Jaccard join: a grouped prefix join that is exact and never expands a group of copies.

A document is the set of its distinct 5-word shingles as 64-bit hashes; two documents link
when their Jaccard similarity is at least 0.8 (integers: 100 * i >= 80 * u).

1. A sketch of fixed size counts shingles over all documents. It ranks hash buckets by
   frequency, and hashes are renamed so that their natural order is rare to frequent: the
   common order of a prefix join, in which frequent passages stay out of the prefixes.
2. One scan gives each document its set's size and fingerprint, its prefix (the first
   n - ceil(0.8 n) + 1 shingles) and a parity bitmap with about a bit for a shingle.
   Documents with equal sets collapse into one representative, and representatives with identical prefix
   and size into one group, named by its least id.
3. Groups are posted under the shingles of their prefix; postings of one group alone are dropped. First each
   group meets the leader of each of its postings only (the group whose rarest shingle is the
   least rare: the original of a family of near copies), and each member the head of its group. Links
   verified there form classes, so a family of any size costs a few pairs for each member.
4. Then the postings are kept once for each (shingle, class). Those that stay within one class
   produce nothing more; the others give pairs of groups of different classes, filtered by
   size and position.
5. These are expanded to their members in a join whose condition tests sizes and bitmaps (the
   parity difference is a lower bound of the symmetric difference, so nothing is lost), and what
   passes is verified on whole sets. All verified links give the components.

Verification reads only documents whose id is in a bitmap of fixed size; texts are never shuffled.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; with
fewer than five words the whole sequence is the only shingle; repeated rows (equal doc_id) count
as one document, the one with the larger fingerprint if their texts differ, and come back as one
row each; rows with a null doc_id come back with their size and a null component and link with nothing; extra columns
are ignored. Hashes of 64 bits stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_table, components, cut, pieces, prefix_hash, span_hash, splitmix, stored, text_bytes, words

SHINGLE = 5
SKETCH_BITS = 18
MOST_BITS = 30  # of the bitmap of documents to verify: 8 bits for each, 128 MB at most
_VALUES = byte_table(lower=True)
_WEIGHTS = splitmix(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64((1 << (64 - SKETCH_BITS)) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each text with n+1 entries): every shingle, repeats included, in text order."""
    start, end, first = words(data, offsets)
    h = span_hash(prefix_hash(data, _VALUES), start, end)
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    edge = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=edge[1:])
    at = np.repeat(first[:-1] - edge[:-1], count) + np.arange(edge[-1])
    total = np.zeros(edge[-1], np.uint64)
    length = np.repeat(np.minimum(n, SHINGLE), count)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        total += padded[at + k] * _WEIGHTS[k] * (length > k)
    return splitmix(total + length.astype(np.uint64)), edge


def text_shingles(column, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the batch, ...) pieces: (first row, hashes, edges)."""
    data, offsets, _ = text_bytes(column)
    for i, j in pieces(offsets, most):
        yield i, *shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def frequency_rank(docs: DataFrame) -> np.ndarray:
    """rank of each of 2**SKETCH_BITS hash buckets by its number of shingles in all documents; the sketch's size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, h, _ in text_shingles(batch.column("text")):
                total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        b = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total[b])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**SKETCH_BITS rows
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    total[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    rank = np.empty(1 << SKETCH_BITS, np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(1 << SKETCH_BITS, dtype=np.uint64)
    return rank


def ordered(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes renamed so that their order is rare to frequent; one to one."""
    return (rank[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(64 - SKETCH_BITS)) | (h & _LOW)


def bitmap_words(n: int) -> int:
    """Longs of the parity bitmap of a set of n: a power of two, with at least a bit for a shingle."""
    return max(1, 1 << max(0, (n - 1).bit_length() - 6))


def _signature(s: np.ndarray) -> tuple:
    """n, two fingerprints, prefix fingerprint, prefix and parity bitmap of a sorted set."""
    n = len(s)
    if n == 0:
        return 0, 0, 0, 0, [], []
    m = splitmix(s)
    prefix = s[: n - (4 * n + 4) // 5 + 1]
    size = bitmap_words(n)
    bits = np.bincount((m & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size).astype(np.uint8) & 1
    parity = np.packbits(bits, bitorder="little").view(np.int64)
    fold = lambda x: int(x.view(np.int64))
    return n, fold(m.sum()), fold(np.bitwise_xor.reduce(splitmix(m))), fold(splitmix(prefix).sum()), prefix.view(np.int64), parity


def signatures(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # 8 * 2**SKETCH_BITS bytes
    names = ["doc_id", "n", "f1", "f2", "fp", "prefix", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, h, edge in text_shingles(batch.column("text")):
                h = ordered(h, shared.value)
                rows = [_signature(np.unique(h[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                columns = list(zip(*rows, strict=True))
                arrays = [ids.slice(i, len(rows)), *(pa.array(c, pa.int64()) for c in columns[:4])]
                for c in columns[4:]:
                    off = np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.asarray(x, np.int64) for x in c]))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, fp long, prefix array<long>, parity array<long>")


def _difference(a: str, b: str) -> Column:
    """Lower bound of the symmetric difference: differing bits of two parity bitmaps, the longer folded to the shorter's size."""
    x, y = F.col(a), F.col(b)
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), F.expr("1 + 0") + (F.size(c) / 2).cast("int") - 1), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)


def _unsigned(column: Column) -> Column:
    """A signed long that orders as the unsigned one does."""
    return column.bitwiseXOR(F.lit(-(1 << 63)))


def filtered(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives that may reach the similarity: by size, then by the bitmaps. No pair that reaches it is lost."""
    own = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    p = pairs.join(own("a"), "a").join(own("b"), "b").where("5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")
    return p.where(9 * _difference("p_a", "p_b") <= F.col("n_a") + F.col("n_b")).select("a", "b", "n_a", "n_b")


def expanded(near: DataFrame, grouped: DataFrame, reps: DataFrame, piece: int = 4096) -> DataFrame:
    """Pairs (a, b) of members of two near classes that may reach the similarity.

    The smaller class is expanded first; sizes and bitmaps are tested in the condition of the second
    join, so pairs that fail are never rows. A large class is dealt out in pieces of about `piece` members.
    """
    count = grouped.groupBy("class").agg(F.count("*").alias("size"))
    of = lambda c: count.select(F.col("class").alias(f"class_{c}"), F.col("size").alias(f"size_{c}"))
    near = near.join(of("x"), "class_x").join(of("y"), "class_y")
    first = F.col("size_x") <= F.col("size_y")
    near = near.select(F.when(first, F.col("class_x")).otherwise(F.col("class_y")).alias("small"), F.when(first, F.col("class_y")).otherwise(F.col("class_x")).alias("large"), F.greatest("size_x", "size_y").alias("size"))
    near = near.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((size - 1) div {piece} as int))")))
    member = grouped.join(reps.select("doc_id", "parity"), "doc_id").join(count, "class").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.expr(f"(size - 1) div {piece} + 1")).cast("int"))
    x = near.join(member.select(F.col("class").alias("small"), F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p_a")), "small")
    y = member.select(F.col("class").alias("large_y"), F.col("piece").alias("piece_y"), F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("p_b"))
    fits = (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a")) & (9 * _difference("p_a", "p_b") <= F.col("n_a") + F.col("n_b"))
    return x.join(y, (F.col("large") == F.col("large_y")) & (F.col("piece") == F.col("piece_y")) & fits).select("a", "b")


def _id_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap with the ids' hashes: 8 bits for each, a power of two, 2**MOST_BITS at most."""
    width = min(MOST_BITS, max(20, (8 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << width))
    rows = ids.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    found = np.zeros((1 << width) // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most 2**MOST_BITS bits
        found[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return found


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, counted on the whole sets of both."""
    pairs = stored(pairs, "ngram-pairs")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    found = _id_bits(ids)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            bit = np.asarray(batch.column("bit"))
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            ids = batch.column("doc_id")
            for i, h, edge in text_shingles(batch.column("text")):
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "hashes"])

    wanted = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(found))))
    sets = wanted.mapInArrow(run, "doc_id long, hashes binary").withColumn("size", (F.length("hashes") / 8).cast("long"))
    # a repeated doc_id may have several texts; the representative's is the one of its size
    sets = sets.join(reps.select("doc_id", F.col("n").alias("size")), ["doc_id", "size"]).dropDuplicates(["doc_id"])
    sets = stored(sets.select("doc_id", "hashes"), "ngram-sets")
    p = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("s_a")), "a")
    p = p.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("s_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs are merged
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= 80 * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return p.select("a", "b", "s_a", "s_b").mapInArrow(check, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(signatures(docs, frequency_rank(docs)), "ngram-signatures")
    known = docs.where("doc_id is not null")

    # one row for each doc_id, one representative for each distinct set, one group for each prefix and size
    own = sig.where("doc_id is not null and n > 0").select("doc_id", "n", "f1", "f2", "fp").groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2", "fp")).alias("s")).select("doc_id", "s.*")
    copies = cut(own.groupBy("n", "f1", "f2", "fp").agg(F.min("doc_id").alias("rep")))
    member = own.join(copies.drop("fp"), ["n", "f1", "f2"]).select("doc_id", "rep")
    heads = copies.groupBy("n", "fp").agg(F.min("rep").alias("head"))
    named = copies.join(heads, ["n", "fp"]).select(F.col("rep").alias("doc_id"), F.col("n").alias("n_"), F.col("f1").alias("f1_"), F.col("f2").alias("f2_"), "head")
    reps = sig.join(named, "doc_id").where("n = n_ and f1 = f1_ and f2 = f2_").drop("n_", "f1_", "f2_").dropDuplicates(["doc_id"])  # by doc_id alone, so that prefixes are shuffled once
    reps = stored(reps.select("doc_id", "head", "n", "prefix", "parity"), "ngram-representatives")

    # postings of groups. code: size, and whether the shingle is within the shorter prefix that the smaller set of a pair needs
    posts = reps.where("doc_id = head").select("head", "n", _unsigned(F.element_at("prefix", 1)).alias("rarest"), F.posexplode("prefix").alias("at", "shingle"))
    posts = posts.select("shingle", "head", "rarest", (2 * F.col("n") + (F.col("at") < F.expr("n - (8 * n + 8) div 9 + 1")).cast("long")).alias("code")).repartition("shingle")
    leaders = posts.groupBy("shingle").agg(F.max_by("head", "rarest").alias("leader"), F.max_by("code", "rarest").alias("leads"), F.count("*").alias("held")).where("held > 1")
    posts = stored(posts.join(leaders.select("shingle", "leader", "leads"), "shingle").select("shingle", "head", "code", "leader", "leads"), "ngram-postings")

    # each group against the leaders of its postings, each member against its group's head
    near = posts.where("head <> leader and 5 * (code div 2) >= 4 * (leads div 2) and 5 * (leads div 2) >= 4 * (code div 2)").select(F.greatest("head", "leader").alias("a"), F.least("head", "leader").alias("b"))
    stars = near.distinct().union(reps.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    first = cut(verified(filtered(stars, reps).select("a", "b"), known, reps))
    group = components(first)
    grouped = cut(reps.select("doc_id", "head", "n").join(group.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "head", "n", F.coalesce("component", "doc_id").alias("class")))

    # pairs of classes whose groups share a posting
    held = posts.select("shingle", "head", "code").join(grouped.select("head", "class").distinct(), "head")
    held = held.repartition("shingle").groupBy("shingle", "class").agg(F.min("code").alias("least"), F.max("code").alias("most"), F.max(F.col("code") % 2).alias("in_index"))
    wide = held.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    held = cut(held.join(wide, "shingle").select("shingle", "class", F.expr("least div 2").alias("least"), F.expr("most div 2").alias("most"), "in_index"))
    x, y = (held.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "least", "most", "in_index"))) for s in "xy")
    near = x.join(y, "shingle").where("class_x < class_y and 5 * most_x >= 4 * least_y and 5 * most_y >= 4 * least_x and in_index_x + in_index_y > 0")
    near = near.select("class_x", "class_y").distinct()
    second = cut(verified(expanded(near, grouped.select("doc_id", "n", "class"), reps), known, reps))

    final = components(first.union(second))
    named = member.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component"))
    return sig.select("doc_id", F.col("n").alias("n_shingles")).join(named.select("doc_id", F.col("component").alias("component_id")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the least doc_id; rows of equal doc_id collapse to one, rows without an id stay."""
    found = classes(docs).select("doc_id", "component_id").distinct()
    gone = found.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(kept.where("doc_id is null")).select(docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(root) AS component_id FROM r GROUP BY id) c USING (doc_id)
"""
