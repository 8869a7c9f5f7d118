"""PII removal by information-theoretic sanitisation.

Fixed patterns find the protected entities (email, ip, card, phone). Beyond them, terms that
give an entity away are found from the corpus: for each entity e and each term t outside the
entities of a document that holds e, at any distance, with document counts over the whole corpus,
    PMI(e; t) = log(N * n(e, t) / (n(e) * n(t))),   IC(e) = log(N / n(e)),
and t discloses e when n(e, t) >= `support` and PMI >= `threshold` * IC. Every occurrence of t in a
document that holds e is then generalised, or removed where t determines the entity
(PMI >= `removal` * IC). One document is no evidence at `support` 2: each of its rare words would
disclose its entities.

How it scales: three scans and no text in a shuffle. The first counts entities and terms, summed
in the tasks. The second counts pairs, summed in the tasks too, but only those that can disclose: as
n(e, t) <= n(e), a term of more than N**(1 - threshold) * n(e)**threshold documents cannot, nor can
terms and entities of fewer than `support`. The third finds the places of flagged pairs. What the
scans need to know is broadcast in fixed size (bitmaps, the counts of the commonest terms, the
largest count for each range of entity hashes); all of it lets too much through, never too
little, and joins decide. A hot entity or term is one key of a pre-aggregated sum.

Defined cases: null counts as empty and an empty text has no findings; each row is a document
of its own, so repeated rows add to the counts and get equal results; matches that fail a test are
dropped without retrying inside them; offsets are code points, ends exclusive; extra columns are
kept by `sanitise` and ignored by `find`. In `sanitise`, overlapping spans are replaced as one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_table, cut, pieces, prefix_hash, span_hash, stored, text_bytes

KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BITS = 23  # of a bitmap: 2**23 bits are a megabyte
COMMON = 1 << 17  # terms whose counts are broadcast
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_VALUES = byte_table(lower=True)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.tld, found from each @ so that long runs cost no retries."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            floor = after = m.end()
        else:
            floor = at + 1  # nothing before this @ can reach a later one
        at = text.find("@", after)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the protected entities, by start and then kind as listed."""
    found: list[tuple[int, str, int]] = []
    if not text:
        return found
    if "@" in text:
        found += [(a, "email", b) for a, b in emails(text)]
    if any(d in text for d in "0123456789"):
        if "." in text:
            found += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), "card", m.end()))
        if "+" in text:
            found += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, owner) of the terms, runs of letters, digits and bytes beyond ASCII, of texts that lie end to end."""
    full = _TERM[data]
    begin, last = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges], last[edges - 1] = full[edges], full[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    long = end - start >= 3
    start, end = start[long], end[long]
    return start, end, span_hash(prefix_hash(data, _VALUES), start, end).view(np.int64), np.searchsorted(offsets, start, side="right") - 1


def _hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def free_terms(text: str, base: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the terms outside all entities, in code points."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, end, value, _ = terms(data, np.array([0, len(data)]))
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    start, end = point[start], point[end]
    free = np.ones(len(start), bool)
    for a, _, b in base:
        i, j = np.searchsorted(end, a, side="right"), np.searchsorted(start, b)
        free[i:j] = False
    return start[free], end[free], value[free]


def entity_hashes(text: str, base: list[tuple[int, str, int]]) -> np.ndarray:
    """The distinct hashes of a text's entities."""
    return np.unique(np.array([_hash_text(f"{kind}:{text[a:b].lower()}") for a, kind, b in base], np.int64))


def _hit(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    low = value & ((1 << BITS) - 1)
    return ((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)


def _summed(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal keys (all columns but the last) once, with the sum of their counts."""
    *keys, n = (np.concatenate(c) for c in columns)
    order = np.lexsort(keys)
    keys, n = [k[order] for k in keys], n[order]
    new = np.ones(len(n), bool)
    if len(n):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return [*(k[new] for k in keys), np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n]


def _bitmap(candidates: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITS bits with the low bits of the hashes in column t; built in Spark, at most a megabyte reaches the driver."""
    bit = F.col("t").bitwiseAND((1 << BITS) - 1)
    rows = candidates.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    found = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        found[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return found


def counts(docs: DataFrame) -> DataFrame:
    """kind, t, n: the number of documents with each entity (kind 0), with each term (1), and of all (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[], [], []]
        kept = held = 0

        def add(kind: int, value: np.ndarray, n: np.ndarray) -> None:
            nonlocal held
            held += len(value)
            for c, x in zip(found, (value, np.full(len(value), kind), n), strict=True):
                c.append(x)

        for batch in batches:
            column = batch.column("text")
            add(2, np.zeros(1, np.int64), np.array([len(column)]))
            for text in column:
                text = text.as_py()
                if spans := base_spans(text):
                    e = entity_hashes(text, spans)
                    add(0, e, np.ones(len(e), np.int64))
            data, offsets, _ = text_bytes(column)
            for i, j in pieces(offsets, 1 << 19):
                lo = offsets[i]
                _, _, value, owner = terms(data[lo : offsets[j]], offsets[i : j + 1] - lo)
                order = np.lexsort((owner, value))
                value, owner = value[order], owner[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                add(1, *np.unique(value[new], return_counts=True))
            if held > 2 * kept + (1 << 20):
                found = [[c] for c in _summed(found)]
                kept = held = len(found[0][0])
        if found[0]:  # a row for each key and task
            t, kind, n = _summed(found)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(t), pa.array(n)], ["kind", "t", "n"])

    return docs.select("text").mapInArrow(run, "kind int, t long, n long").groupBy("kind", "t").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, support: int = 2, threshold: float = 0.9) -> DataFrame:
    """e, t, strength (PMI / IC) of the terms that give an entity away."""
    sc = docs.sparkSession.sparkContext
    every = cut(counts(docs).where(F.col("kind").isin(2) | (F.col("n") >= support)))
    total = (every.where("kind = 2").agg(F.sum("n")).first()[0]) or 0
    entity, term = every.where("kind = 0").select("t", "n"), every.where("kind = 1").select("t", "n")
    common = cut(term.orderBy(F.desc("n")).limit(COMMON)).toPandas().sort_values("t")  # the checkpoint takes them in a task, not in the driver
    most = np.zeros(1 << 16, np.int64)
    for r in entity.groupBy(F.col("t").bitwiseAND(65535).alias("range")).agg(F.max("n").alias("n")).collect():
        most[r.range] = r.n
    limit = float(total) ** (1 - threshold) * most.astype(float) ** threshold * (1 + 1e-9)
    shared = sc.broadcast((_bitmap(entity), _bitmap(term), common.t.to_numpy(np.int64), common.n.to_numpy(np.int64), limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities, known, names, sizes, limit = shared.value
        found: list[list[np.ndarray]] = [[], [], []]
        held = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(found)], ["e", "t", "n"])

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                spans = base_spans(text)
                if not spans or not len(own := (e := entity_hashes(text, spans))[_hit(entities, e)]):
                    continue
                t = np.unique(free_terms(text, spans)[2])
                t = t[_hit(known, t)]
                n = np.zeros(len(t), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, t), len(names) - 1)
                    n = np.where(names[at] == t, sizes[at], 0)
                order = np.argsort(n, kind="stable")
                t, n = t[order], n[order]
                for e in own:
                    k = int(np.searchsorted(n, limit[e & 65535], side="right"))
                    for c, x in zip(found, (np.full(k, e), t[:k], np.ones(k, np.int64)), strict=True):
                        c.append(x)
                    held += k
                    if held >= 1 << 20:
                        yield rows()
                        found, held = [[], [], []], 0
        if held:
            yield rows()

    joint = docs.select("text").mapInArrow(run, "e long, t long, n long").groupBy("e", "t").agg(F.sum("n").alias("n_et")).where(F.col("n_et") >= support)
    pairs = joint.join(entity.select(F.col("t").alias("e"), F.col("n").alias("n_e")), "e").join(term, "t")
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.greatest("n", "n_et")))
    return pairs.withColumn("strength", F.when(ic > 0, pmi / ic)).where(F.col("strength") >= threshold).select("e", "t", "strength")


_NEAR = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def places(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, row, base (spans of entities) for each row, near (places of pairs that may be flagged); more places follow in rows with a null base."""
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(flagged.select(F.col("e").alias("t"))), _bitmap(flagged.select(F.col("e").bitwiseXOR(F.col("t")).alias("t")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities, both = shared.value

        def rows(ids: list, keys: list, base: list, near: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(base, _SPAN), pa.array(near, _NEAR)], ["doc_id", "row", "base", "near"])

        for batch in batches:
            ids, keys, base = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), []
            for key, text in zip(keys, batch.column("text"), strict=True):
                text = text.as_py()
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                if not spans or not len(own := (e := entity_hashes(text, spans))[_hit(entities, e)]):
                    continue
                start, end, t = free_terms(text, spans)
                for e in own:
                    at = np.flatnonzero(_hit(both, t ^ e))
                    for k in range(0, len(at), 1 << 16):
                        yield rows([None], [key], [None], [[{"e": int(e), "t": int(t[i]), "start": int(start[i]), "end": int(end[i])} for i in at[k : k + (1 << 16)]]])
            yield rows(ids, keys, base, [None] * len(ids))

    return docs.mapInArrow(run, "doc_id long, row long, base array<struct<start:int,kind:string,end:int>>, near array<struct<e:long,t:long,start:int,end:int>>")


def find(docs: DataFrame, support: int = 2, threshold: float = 0.9, keep: Column | None = None) -> DataFrame:
    """doc_id, row (monotonic, or what `keep` gives), base, extra: entities and disclosing terms (start, end, strength) of every row."""
    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (F.monotonically_increasing_id() if keep is None else keep).alias("row"), "text")
    flagged = cut(disclosing(docs, support, threshold))
    found = stored(places(own, flagged), "pii-entities")
    near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    extra = near.join(flagged, ["e", "t"]).groupBy("row", "start", "end").agg(F.max("strength").alias("strength"))
    extra = extra.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "strength"))).alias("extra"))
    nothing = F.array().cast("array<struct<start:int,end:int,strength:double>>")
    return found.where("base is not null").drop("near").join(extra, "row", "left").withColumn("extra", F.coalesce("extra", nothing))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find()."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, extra in zip(batch.column("base").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                spans = [(s["start"], s["kind"], s["end"]) for s in base]
                every = sorted(spans + [(s["start"], "term", s["end"]) for s in extra], key=lambda s: (s[0], KINDS.index(s[1])))
                n = Counter(k for _, k, _ in every)
                text = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
                rows.append((*(n[k] for k in KINDS[:4]), hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, k, b in every), n["term"]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return found.select("doc_id", "base", "extra").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def replaced(text: str, spans: list[tuple[int, str, int, float]], removal: float) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind; terms are generalised by their shape or removed."""
    out, at, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        a, kind, b, strength = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            if kind == "term" and spans[i][1] != "term":
                kind = spans[i][1]
            b = max(b, spans[i][2])
            i += 1
        word = text[a:b]
        if kind != "term":
            mark = f"[{kind.upper()}]"
        elif strength >= removal:
            mark = "[REMOVED]"
        else:
            mark = "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, support: int = 2, threshold: float = 0.9, removal: float = 0.99) -> DataFrame:
    """docs with entities and disclosing terms replaced in text, all other columns as they are.

    Only rows with disclosing terms need a join, and of a join only (row, spans) is the other side, which is
    written first: Spark broadcasts it while its size is within `spark.sql.autoBroadcastJoinThreshold` and
    shuffles the texts beyond. Entities are found again in the text itself.
    """
    row = "row of docs"
    wide = bounded(docs).withColumn(row, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    found = find(docs.select("doc_id", "text"), support, threshold, keep=F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    extra = found.where(F.size("extra") > 0).select(F.col("row").alias(row), F.col("extra").alias("extra of row")).dropDuplicates([row])
    wide = wide.join(stored(extra, "pii-terms"), row, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            extra = batch.column(names.index("extra of row")).to_pylist()
            texts = []
            for text, more in zip(batch.column(at), extra, strict=True):
                text = text.as_py()
                spans = [(a, k, b, 1.0) for a, k, b in base_spans(text)] + [(s["start"], "term", s["end"], s["strength"]) for s in more or []]
                texts.append(replaced(text, spans, removal) if spans else text)
            columns = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns[:-1], names[:-1])

    wide = wide.drop(row)
    return wide.mapInArrow(run, docs.schema)
