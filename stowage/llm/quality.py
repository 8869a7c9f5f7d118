"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of each whole text (sizes, shares of character classes, repetition of words and
lines) are computed in one pass of numpy over Arrow batches. Class means and covariances are
exact sums over the labelled training rows, of more than `most_rows` a sample of about that number
chosen by a hash of the id (the bound of the fit), added up by Spark; only 2 * (1 + d + d*d) numbers
reach the driver. Covariances are shrunk towards the pooled one and a multiple of the
identity, their Cholesky factors are inverted once and kept in the model, and a score is the
logistic of the difference of Mahalanobis log-densities plus the log prior ratio.

Defined cases: a null text counts as empty, and empty texts have a score like any other;
null labels and labels other than 0 and 1 are ignored; a document with several labels counts
once for each; without labels of both classes every score is (n1 + 1) / (n0 + n1 + 2);
repeated documents are scored row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_table, pieces, prefix_hash, span_hash, stored, text_bytes, words

#: Kinds of bytes: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence marks, 6 other punctuation, 7 beyond ASCII.
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 7
KIND[[32, 9, 10, 11, 12, 13]] = 4
KIND[list(b".,;:'\"?-()")] = 5
KIND[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 6
NAMES = ("log_bytes", "log_words", "word_length", "word_spread", "lower", "upper", "digits", "marks", "symbols", "beyond_ascii", "bangs", "log_lines", "words_a_line", "distinct_words", "repeats_before", "distinct_lines", "stops")
D = len(NAMES)
_WORDS, _LINES = byte_table(lower=True), byte_table(lower=False)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each owner (40 bits of each key are compared)."""
    both = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))
    return np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of D transformed statistics for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, D))
    size = np.diff(offsets)
    kind = KIND[data]
    counts = [_per_text(kind == k, offsets) for k in range(8)]
    per = np.maximum(size, 1)
    share = lambda x: np.sqrt(x / per)
    start, end, first = words(data, offsets)
    n_words = np.diff(first)
    per_word = np.maximum(n_words, 1)
    owner = np.repeat(np.arange(n), n_words)
    length = end - start
    total = np.bincount(owner, length, n)
    mean = total / per_word
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / per_word - mean**2, 0))
    hashes = span_hash(prefix_hash(data, _WORDS), start, end)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], offsets[1:], breaks]))
    cuts = cuts[cuts <= len(data)]
    a, b = cuts[:-1], cuts[1:]
    a = a + (a < len(data)) * (data[np.minimum(a, max(len(data) - 1, 0))] == 10) if len(data) else a
    full = b > a
    a, b = a[full], b[full]
    line_owner = np.searchsorted(offsets, a, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    line_hashes = span_hash(prefix_hash(data, _LINES), a, b)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(n_words)
    out[:, 2], out[:, 3] = np.log1p(mean), np.log1p(spread)
    out[:, 4:10] = np.stack([share(counts[k]) for k in (1, 2, 3, 5, 6, 7)], 1)
    out[:, 10] = share(_per_text(data == 33, offsets))
    out[:, 11], out[:, 12] = np.log1p(lines), np.log1p(n_words / np.maximum(lines, 1))
    out[:, 13] = _distinct(hashes, owner, n) / np.sqrt(per_word)
    out[:, 13] = np.log1p(out[:, 13])
    out[:, 14] = np.sqrt(np.bincount(owner, same, n) / per_word)
    out[:, 15] = _distinct(line_hashes, line_owner, n) / np.maximum(lines, 1)
    out[:, 16] = share(_per_text(data == 46, offsets))
    return out


def batch_statistics(column) -> np.ndarray:
    data, offsets, _ = text_bytes(column)
    found = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets, 1 << 19)]
    return np.concatenate(found) if found else np.zeros((0, D))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as an array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors, log determinants and the log prior ratio; `constant` is set where no fit is possible."""

    means: list
    factors: list
    log_dets: list
    prior: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [-0.5 * (((x - m) @ f) ** 2).sum(1) - d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -700, 700)))


def fit(labelled: DataFrame, shrink_pooled: float = 0.1, shrink_identity: float = 0.01) -> Discriminant:
    """From rows (y, x): sums of 1, x and x x' for each class, made in the tasks and added by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten()).reshape(-1, D)
                y = np.asarray(batch.column("y"))
                for k in (0, 1):
                    own = x[y == k]
                    total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(total[k, i])], ["k", "i", "v"])

    sums = labelled.where("y in (0, 1)").select(F.col("y").cast("int").alias("y"), "x").mapInArrow(partial, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + D + D * D))
    for r in sums.collect():  # at most 2 * (1 + D + D * D) rows
        total[r.k, r.i] = r.v
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant([], [], [], 0.0, float((n[1] + 1) / (n.sum() + 2)))
    means = [total[k, 1 : 1 + D] / n[k] for k in (0, 1)]
    own = [total[k, 1 + D :].reshape(D, D) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scale = np.maximum(np.diag(pooled), 1e-9)
    factors, dets = [], []
    for s in own:
        s = (1 - shrink_pooled - shrink_identity) * s + shrink_pooled * pooled + shrink_identity * np.diag(scale)
        root = np.linalg.cholesky(s + 1e-9 * np.eye(D))
        factors.append(np.linalg.inv(root).T)
        dets.append(float(np.log(np.diag(root)).sum()))
    return Discriminant(means, factors, dets, float(np.log(n[1] / n[0])))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


MOST_ROWS = 100_000


def labelled(rows: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows that may train (remainder modulo 3 not 1, a hash of the id below the bound of the sample), and their labels (doc_id, y)."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where("y in (0, 1) and doc_id is not null")
    trains = remainder(F.col("doc_id"), 3) != 1
    n = y.where(trains).count()
    if n > most_rows:
        trains &= F.xxhash64(F.col("doc_id").cast("long")) < F.lit(int(most_rows / n * 2.0**64) - 2**63)
    return rows.where(trains), y.where(trains)


def train(feats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on rows (doc_id, x) and their labels (doc_id, y)."""
    return fit(feats.join(labels, "doc_id"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    feats = stored(features(docs), "quality-features")
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled(feats, labels)))  # two D x D matrices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(np.asarray(batch.column("x").flatten()).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = feats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs predicted to be of quality 1, every column kept; texts are filtered in place, not shuffled."""
    rows, y = labelled(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(train(features(rows), y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(batch_statistics(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
