"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points, everything but letters is a space, and n-grams of one
to three of them that hold a letter are hashed into 2**BITS buckets. Counts come from the
training documents (crc32 of the id modulo 4 is not 2, lang not null), of each language a
sample of about `most_rows` documents chosen by a hash of the id: the bound of the fit. Only the `most_langs`
most frequent lang values are learned, which bounds the matrix of log-probabilities
(2**BITS floats, 256 KB, for each language) that is broadcast; batches are scored in numpy by sparse look-ups.

Defined cases: a null text or one without a letter gives `und` with score 0; without training
rows every prediction is `und`; ties go to the language that sorts first; repeated rows are
predicted row by row; extra columns are ignored. lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

BITS, SLICES = 16, 16
UNKNOWN = "und"
_K = np.uint64(0x9E3779B97F4A7C15)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For n = 1, 2, 3: (bucket of the n-gram that ends at each place, whether it counts); the places of each text; the letters of each text."""
    lowered = [f"  {t.lower()}  " for t in texts]  # so that no n-gram reaches into another text
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=offsets[1:])
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    c = np.where(letter, code, 32).astype(np.uint64)
    found = []
    h = np.zeros(len(c), np.uint64)
    some = np.zeros(len(c), bool)
    for n in (1, 2, 3):
        h[n - 1 :] = h[n - 1 :] * np.uint64(0x100000001B3) + c[: len(c) - n + 1] * np.uint64(2 * n + 1) if n > 1 else c
        some = letter.copy() if n == 1 else some
        if n > 1:
            some[n - 1 :] |= letter[: len(c) - n + 1]
        found.append((((h + np.uint64(n)) * _K >> np.uint64(64 - BITS)).astype(np.int32), some.copy()))
    total = np.zeros(len(c) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    return found, offsets, total[offsets[1:]] - total[offsets[:-1]]


def _chunks(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def counts(texts: list[str]) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for i, j in _chunks(texts):
        for bucket, some in grams(texts[i:j])[0]:
            total += np.bincount(bucket[some], minlength=1 << BITS)
    return total


class Model:
    """Languages in order, log-probabilities (language, bucket), log priors."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.table, self.prior = langs, table, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        whole = [t or "" for t in texts]
        names, scores = [], []
        for i, j in _chunks(whole):
            found, offsets, letters = grams(whole[i:j])
            like = np.zeros((len(self.langs), j - i))
            for k, row in enumerate(self.table):
                s = np.zeros(offsets[-1] + 1)
                at = np.zeros(offsets[-1], np.float32)
                for bucket, some in found:
                    at += row[bucket] * some
                np.cumsum(at, out=s[1:], dtype=np.float64)
                like[k] = s[offsets[1:]] - s[offsets[:-1]] + self.prior[k]
            if not self.langs:
                names += [UNKNOWN] * (j - i)
                scores.append(np.zeros(j - i))
                continue
            best = like.argmax(0)
            p = 1 / np.exp(like - like.max(0)).sum(0)
            names += [self.langs[b] if m else UNKNOWN for b, m in zip(best, letters, strict=True)]
            scores.append(np.where(letters > 0, p, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, most_rows: int = 5000, smoothing: float = 0.5, most_langs: int = 400) -> Model:
    rows = bounded(docs).select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    spark = docs.sparkSession
    # the hash of an id lies below the bound for a share most_rows / size of all ids
    bounds = spark.createDataFrame([(x, int(min(1.0, most_rows / sizes[x]) * 2.0**63) * 2 - 2**63 - (sizes[x] <= most_rows)) for x in langs], "lang string, bound long")
    rows = rows.join(F.broadcast(bounds), "lang").where(F.xxhash64("doc_id") <= F.col("bound"))  # most_langs rows
    width = (1 << BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            text, lang = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for own in set(lang):
                total[own] = total.get(own, 0) + counts([t for t, x in zip(text, lang, strict=True) if x == own])
        cells = [(own, k, t[k * width : (k + 1) * width].tobytes()) for own, t in total.items() for k in range(SLICES)]
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "slice", "n"), c, strict=True)) for c in cells], pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("n", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.sum([np.frombuffer(b, np.int64) for b in pdf.n], axis=0)
        return pd.DataFrame({"lang": pdf.lang[:1], "slice": pdf.slice[:1], "n": [n.tobytes()]})

    schema = "lang string, slice int, n binary"
    sums = rows.select("text", "lang").mapInArrow(count, schema).groupBy("lang", "slice").applyInPandas(add, schema)
    table = np.zeros((len(langs), 1 << BITS))
    for r in sums.collect():  # SLICES rows for each language
        table[langs.index(r.lang), r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.n, np.int64)
    table = np.log((table + smoothing) / (table + smoothing).sum(1, keepdims=True)).astype(np.float32)
    n = np.array([sizes[x] for x in langs], float)
    return Model(langs, table, np.log(n / n.sum()) if len(langs) else n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**BITS bytes for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
