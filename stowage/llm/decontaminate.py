"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Texts are normalised to words joined by single spaces (A-Z lower-cased; every other ASCII
character except digits separates words), and words of the benchmark are numbered. The automaton runs over
word numbers: its patterns are the pieces of 7 words at every seventh place of an item (whole items, if
they are shorter than a window), so it has about one node for each word of the benchmark. Any 13
consecutive words of an item hold a whole piece; where one matches, it is followed along the item to
both sides, and a run of 13 words or more is a run of occurring windows. Each text is scanned once;
hits are word numbers and, in `spans`, character offsets of the original text.

The automaton is broadcast only while the benchmark texts stay within `most_bytes`; a larger
benchmark is dealt into parts of about that size, each with an automaton and a scan of its own, and the
hits of a row are merged. Results are the same on both ways.

`decontaminate` drops a row that holds a whole window of 13 words, or a twentieth of whose words
lie in occurrences of shorter items; the column `contaminated` of `verdicts` asks for the
twentieth in both cases.

Defined cases: null and wordless texts have no words and no hits, wordless items no windows;
items with equal windows all count; a repeated item_id counts once, a null item_id never;
repeated documents are judged alike, row by row, whatever their ids; an empty benchmark contaminates nothing.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored

WINDOW = 13
MOST_BYTES = 8 << 20  # about 1.3 million words and as many nodes, some 100 MB in a Python worker
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEEP = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, n_full long, items array<long>, spans array<struct<start:int,end:int>>"


def normalise(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class Items:
    """The benchmark as numbers: vocabulary, item ids, and the word numbers (from 1) of all items end to end."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        number: dict[bytes, int] = {}
        flat: list[int] = []
        self.ids: list[int] = []
        starts = [0]
        for item, text in rows:
            if item is not None and (w := normalise(text)):
                flat += [number.setdefault(x, len(number) + 1) for x in w]
                self.ids.append(item)
                starts.append(len(flat))
        self.vocabulary = b" ".join(number)
        self.flat, self.starts = np.array(flat, np.uint32), np.array(starts, np.int64)


class Scanner:
    """The automaton, built once in each Python worker from the broadcast items."""

    def __init__(self, items: Items, window: int = WINDOW) -> None:
        import ahocorasick

        self.window, self.ids = window, items.ids
        self.number = {w: i for i, w in enumerate(items.vocabulary.split(), 1)}
        flat, starts = items.flat.tolist(), items.starts.tolist()
        self.items = [tuple(flat[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        piece = (window + 1) // 2
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        places: dict[tuple, list[tuple[int, int]]] = {}
        for row, own in enumerate(self.items):
            if len(own) < window:
                places.setdefault(own, []).append((row, 0))
            else:
                for at in range(0, len(own) - piece + 1, piece):
                    places.setdefault(own[at : at + piece], []).append((row, at))
        for key, found in places.items():
            self.machine.add_word(key, (len(key), found))
        if places:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, set[int], set[int], set[int]]:
        """Number of words; the numbers of hit words, and of those in whole windows; the items with occurring windows."""
        words = normalise(text)
        hit: set[int] = set()
        full: set[int] = set()
        found: set[int] = set()
        if not self.items or not words:
            return len(words), hit, full, found
        number, window = self.number, self.window
        line = tuple(map(number.get, words, repeat(0)))
        followed: dict[tuple[int, int], int] = {}  # (item, its place against the text) -> end of the run there
        for end, (size, places) in self.machine.iter(line):
            begin = end - size + 1
            for row, at in places:
                own = self.items[row]
                if len(own) < window:
                    hit.update(range(begin, end + 1))
                    found.add(self.ids[row])
                    continue
                if followed.get((row, begin - at), -1) > end:
                    continue
                a, b, stop = begin, end + 1, min(len(line), begin - at + len(own))
                while a > 0 and a > begin - at and line[a - 1] == own[a - 1 - begin + at]:
                    a -= 1
                while b < stop and line[b] == own[b - begin + at]:
                    b += 1
                followed[row, begin - at] = b
                if b - a >= window:
                    full.update(range(a, b))
                    found.add(self.ids[row])
        return len(words), hit | full, full, found


def word_places(text: str, numbers: set[int]) -> list[tuple[int, int, int]]:
    """(number, start, end) of words, as character offsets of the original text."""
    return [(i, m.start(), m.end()) for i, m in enumerate(WORD.finditer(text)) if i in numbers] if numbers else []


def joined(places: list[tuple[int, int, int]]) -> list[dict]:
    """Maximal runs of words, from their places in order."""
    runs: list[list[int]] = []
    for i, a, b in places:
        if runs and runs[-1][2] == i - 1:
            runs[-1][1:] = [b, i]
        else:
            runs.append([a, b, i])
    return [{"start": a, "end": b} for a, b, _ in runs]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")


def _number_of_parts(benchmark: DataFrame, most_bytes: int) -> int:
    size = _items(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return int(size // most_bytes) + 1


def _shared(items: DataFrame):
    return items.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in items.toLocalIterator()]))  # a part: about most_bytes of text


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_HITS = pa.list_(pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("full", pa.bool_())]))


def _digest_batch(ids, rows: list[tuple]) -> pa.RecordBatch:
    """rows: (n_words, n_hit, n_full, items, spans)."""
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), _SPANS]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_full", "items", "spans"])


def _in_parts(texts: DataFrame, benchmark: DataFrame, parts: int, window: int) -> DataFrame:
    """row, doc_id, n_words, hits, items of stored texts (row, doc_id, text): one scan for each part of the benchmark, merged by row. No text is shuffled."""

    def scan_of(shared, every: bool) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = Scanner(shared.value, window)
            for batch in batches:
                keep, rows = [], []
                for text in batch.column("text"):
                    text = text.as_py()
                    n, hit, full, found = machine.scan(text)
                    keep.append(every or bool(hit))
                    if keep[-1]:
                        rows.append((n, [{"word": i, "start": a, "end": b, "full": i in full} for i, a, b in word_places(text or "", hit)], sorted(found)))
                own = batch.filter(pa.array(keep, pa.bool_()))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), _HITS, pa.list_(pa.int64())), strict=True))], ["row", "doc_id", "n_words", "hits", "items"])

        return scan

    every = None
    for part in range(parts):
        shared = _shared(_items(benchmark).where(F.pmod(F.hash("item_id"), F.lit(parts)) == part))
        found = stored(texts.select("row", "doc_id", "text").mapInArrow(scan_of(shared, part == 0), "row long, doc_id long, n_words long, hits array<struct<word:int,start:int,end:int,full:boolean>>, items array<long>"), "leaks-part")
        shared.unpersist()
        every = found if every is None else every.union(found)
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # lists of one text


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, hits, items in zip(batch.column("n_words").to_pylist(), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
            places = sorted({(h["word"], h["start"], h["end"]) for h in hits})
            rows.append((n, len(places), len({h["word"] for h in hits if h["full"]}), items, joined(places)))
        yield _digest_batch(batch.column("doc_id"), rows)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_full (hit words in whole windows), items (ids with occurring windows), spans of the hit words."""
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = _number_of_parts(benchmark, most_bytes)
    if parts > 1:
        texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "leaks-texts")
        return _in_parts(texts, benchmark, parts, window).select("doc_id", "n_words", "hits", "items").mapInArrow(_merged, SCHEMA)
    shared = _shared(_items(benchmark))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Scanner(shared.value, window)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                n, hit, full, found = machine.scan(text)
                rows.append((n, len(hit), len(full), sorted(found), joined(word_places(text, hit)) if hit else []))
            yield _digest_batch(batch.column("doc_id"), rows)

    return texts.mapInArrow(scan, SCHEMA)


def verdicts(leaks: DataFrame) -> DataFrame:
    """The digest columns: the number of items, their SHA-256, and whether a twentieth of the words is hit."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return leaks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def leaked(n_words: int, n_hit: int, n_full: int) -> bool:
    """Whether a text is to go: it holds a whole window, or a twentieth of its words is hit."""
    return n_full > 0 or n_hit > 0 and 20 * n_hit >= n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark text (see `leaked`), every column kept; each row is judged by its own text, whatever its doc_id.

    The scan runs as a filter on the row itself, so no text is shuffled. With a benchmark beyond the broadcast
    bound, rows get a number, are stored once, and those to go are taken out by that number.
    """
    parts = _number_of_parts(benchmark, most_bytes)
    if parts > 1:
        row = "row of docs"
        wide = stored(bounded(docs).withColumn(row, F.monotonically_increasing_id()), "leaks-rows")
        found = _in_parts(wide.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, parts, window)
        n_hit = F.size(F.array_distinct(F.transform("hits", lambda h: h["word"])))
        bad = stored(found.where(F.exists("hits", lambda h: h["full"]) | (n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("row").alias(row)), "leaks-bad")
        return wide.join(bad, row, "left_anti").select(*docs.columns)
    shared = _shared(_items(benchmark))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Scanner(shared.value, window)
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index("text")):
                n, hit, full, _ = machine.scan(text.as_py())
                keep.append(not leaked(n, len(hit), len(full)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bounded(docs).mapInArrow(clean, docs.schema)


def sha256_of(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.r, dw.p, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hits)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
