"""Severity of toxic language: cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deepledger.llm.common import ascii_lower, cut, hash_spans, join_counted, slices, spans_of, text_bytes

#: Labelled documents that a model is fitted on at most; the rest of the pipeline sees every row.
FIT_ROWS = 10_000
#: A word becomes a feature if it is in so many labelled documents and its log odds lie so many deviations from 0.
LEAST_DOCS, LEAST_Z = 3, 2.5
TABLE_BITS = 20
#: Bytes of text that a task works on at once.
SLICE = 1 << 18


@dataclass
class Model:
    """Hashes of words, ascending, one weight for each, and ascending thresholds: P(grade <= k) = s(threshold[k] - weights . x)."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row of grade probabilities for each linear score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - x[:, None], -500, 500)))
        return np.diff(below, axis=1, prepend=0.0, append=1.0)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters (A-Z lower-cased; every byte above 127 counts) of all texts, and each text's offsets among them."""
    data, offsets = text_bytes(column)
    low = ascii_lower(data)
    starts, ends, at = spans_of(((low >= 97) & (low <= 122)) | (data >= 128), offsets)
    return hash_spans(low, starts, ends), at


def labelled_words(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, mark, words, counts) of at most `rows` labelled documents, those of the smallest hash of doc_id; texts of the same words count once, as toxic if one of them is."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                hashes, at = _tokens(batch["text"].slice(a, b - a))
                each = [np.unique(hashes[i:j], return_counts=True) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch["toxic"].slice(a, b - a), pa.array([w.tobytes() for w, _ in each], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in each], pa.binary())], names=["toxic", "words", "counts"])

    texts = join_counted(docs.where("text is not null").select("doc_id", "text"), chosen, ["doc_id"], "inner")
    found = texts.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(work, "toxic int, words binary, counts binary")
    return cut(found.groupBy("words", "counts").agg(F.max("toxic").alias("toxic")).select("toxic", F.xxhash64("words", "counts").alias("mark"), "words", "counts"))


def telling_words(labelled: DataFrame, n: int, positive: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the words in at least LEAST_DOCS documents whose log odds lie LEAST_Z deviations from 0, and those deviations."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(w.as_buffer(), np.uint64) for w in batch["words"]]
            flat = np.concatenate([np.zeros(0, np.uint64), *each])
            bad = np.repeat(batch["toxic"].to_numpy() > 0, [len(w) for w in each])
            words, place, df = np.unique(flat, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df), pa.array(np.bincount(place, weights=bad, minlength=len(words)).astype(np.int64))], names=["word", "df", "bad"])

    counts = labelled.select("toxic", "words").mapInArrow(work, "word long, df long, bad long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("bad").alias("bad"))
    a, b = F.col("bad") + 0.5, positive - F.col("bad") + 0.5
    c, d = F.col("df") - F.col("bad") + 0.5, n - positive - F.col("df") + F.col("bad") + 0.5
    scored = counts.where(F.col("df") >= LEAST_DOCS).select("word", (F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)).alias("z")).where(F.abs("z") >= LEAST_Z)
    found = scored.toArrow()
    words = found["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], found["z"].to_numpy()[order]


def hits(labelled: DataFrame, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """toxic and mark of each document, by mark; document, word number and count of each telling word in one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, tf = [], []
            for w, c in zip(batch["words"], batch["counts"]):
                w = np.frombuffer(w.as_buffer(), np.uint64)
                _, at, place = np.intersect1d(w, words, assume_unique=True, return_indices=True)
                own.append(place.astype(np.int32).tobytes())
                tf.append(np.frombuffer(c.as_buffer(), np.int32)[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch["toxic"], batch["mark"], pa.array(own, pa.binary()), pa.array(tf, pa.binary())], names=["toxic", "mark", "words", "counts"])

    found = labelled.mapInArrow(work, "toxic int, mark long, words binary, counts binary").toArrow()
    order = np.argsort(found["mark"].to_numpy(), kind="stable")
    own, tf = ([np.frombuffer(found[c][i].as_buffer(), np.int32) for i in order.tolist()] for c in ("words", "counts"))
    row = np.repeat(np.arange(len(order)), [len(w) for w in own])
    none = np.zeros(0, np.int32)
    return found["toxic"].to_numpy()[order], found["mark"].to_numpy()[order], row, np.concatenate([none, *own]), np.concatenate([none, *tf])


def descend(grade: np.ndarray, row: np.ndarray, column: np.ndarray, x: np.ndarray, width: int, levels: int, ridge: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared across all thresholds, and ascending thresholds, by full-batch gradient steps with momentum on the mean negative log-likelihood."""
    n = len(grade)
    w, theta = np.zeros(width), np.array([np.log(max(1, (grade <= k).sum()) / max(1, (grade > k).sum())) for k in range(levels)])
    speed_w, speed_t, second_w, second_t = np.zeros_like(w), np.zeros_like(theta), np.zeros_like(w), np.zeros_like(theta)
    at = np.arange(n)
    for step in range(1, steps + 1):
        below = 1 / (1 + np.exp(-np.clip(np.sort(theta)[None, :] - np.bincount(row, weights=w[column] * x, minlength=n)[:, None], -30, 30)))
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        hi, lo = edge[at, grade + 1], edge[at, grade]
        pull = 1 - hi - lo  # derivative of the negative log-likelihood by the linear score
        grad_w = np.bincount(column, weights=pull[row] * x, minlength=len(w)) / n + ridge * w
        slope, grad_t = 1 / np.maximum(hi - lo, 1e-12) / n, np.zeros_like(theta)
        for k in range(levels):
            s = below[:, k] * (1 - below[:, k])
            grad_t[k] = ((grade == k + 1) * s * slope).sum() - ((grade == k) * s * slope).sum()
        for value, speed, second, grad in ((w, speed_w, second_w, grad_w), (theta, speed_t, second_t, grad_t)):
            speed += 0.1 * (grad - speed)
            second += 0.01 * (grad * grad - second)
            value -= 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w, np.sort(theta)


def grades_of(toxic: np.ndarray, fold: np.ndarray, row: np.ndarray, column: np.ndarray, x: np.ndarray, width: int, levels: int) -> np.ndarray:
    """0 for clean documents; 1 to `levels` for toxic ones, by the quantiles of their scores: labels tell no severity.

    A document's score comes from a two-grade fit of the fold that it is not in, so its own words do not set its grade. Documents
    without telling words, whose score says nothing, are of grade 1 if toxic.
    """
    score = np.zeros(len(toxic))
    for f in (0, 1):
        own = fold != f
        number = np.cumsum(own) - 1
        mine = own[row]
        w, _ = descend((toxic[own] > 0).astype(int), number[row[mine]], column[mine], x[mine], width, 1)
        rest = ~mine
        score += np.bincount(row[rest], weights=w[column[rest]] * x[rest], minlength=len(toxic))
    some = np.bincount(row, minlength=len(toxic)) > 0
    at = score[(toxic > 0) & some]
    edges = np.quantile(at, np.arange(1, levels) / levels) if len(at) else np.zeros(levels - 1)
    return np.where(toxic > 0, np.where(some, 1 + np.searchsorted(edges, score), 1), 0)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, levels: int = 3) -> Model:
    """A model of labels (doc_id, toxic), fitted on at most `rows` documents. Unlabelled and null ones take no part.

    Spark counts the words and chooses those that tell toxic from clean; only where these occur comes to the driver.
    """
    labelled = labelled_words(docs, labels, rows)
    n, positive = labelled.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    if positive and positive < n:
        words, _ = telling_words(labelled, n, positive)
        if len(words):
            toxic, mark, row, column, tf = hits(labelled, words)
            x = 1 + np.log(tf)
            grade = grades_of(toxic, mark & 1, row, column, x, len(words), levels)
            return Model(words, *descend(grade, row, column, x, len(words), levels))
    return Model(np.zeros(0, np.uint64), np.zeros(0), np.linspace(3.0, 6.0, levels))


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """docs and p_toxic (that the grade is above 0), expected_severity (the mean grade) and grade (the likeliest, ties to the lower).

    Whole texts are scored. Null and empty texts have no features. Repeated rows score alike; other columns pass through, and
    columns of the three names are replaced. No rows: no rows.
    """
    docs = docs.drop("p_toxic", "expected_severity", "grade")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << TABLE_BITS) - 1)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[model.words & mask] = True
        for batch in batches:
            parts = []
            for a, b in slices(batch["text"], SLICE):
                hashes, at = _tokens(batch["text"].slice(a, b - a))
                hit = np.flatnonzero(table[hashes & mask])
                place = np.searchsorted(model.words, hashes[hit])
                same = (place < len(model.words)) & (model.words[np.minimum(place, len(model.words) - 1)] == hashes[hit]) if len(model.words) else np.zeros(0, bool)
                doc = np.searchsorted(at, hit[same], side="right") - 1
                pair, tf = np.unique(doc * max(1, len(model.words)) + place[same], return_counts=True)
                doc, word = np.divmod(pair, max(1, len(model.words)))
                parts.append(np.bincount(doc, weights=model.weights[word] * (1 + np.log(tf)), minlength=b - a) if len(pair) else np.zeros(b - a))
            p = model.probabilities(np.concatenate(parts) if parts else np.zeros(0))
            new = {"p_toxic": pa.array(1 - p[:, 0]), "expected_severity": pa.array(p @ np.arange(p.shape[1], dtype=float)), "grade": pa.array(p.argmax(1).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])

    return docs.mapInArrow(work, StructType(docs.schema.fields + StructType.fromDDL("p_toxic double, expected_severity double, grade int").fields))
