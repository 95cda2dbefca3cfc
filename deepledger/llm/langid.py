"""Language identification: script ranges, word scores, and a Viterbi path with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deepledger.llm.common import mix64, slices, spans_of

#: First code point of each script range; letters before the first and between known ranges are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
BUCKETS = 1 << 16
#: Log probability lost by a change of language between two words, and by a word in a script that the language does not use.
SWITCH, FOREIGN = 12.0, 60.0
#: A language uses a script if so large a share of its training letters has it.
LEAST_SHARE = 1e-3


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its single lower-case form, the number of its script."""
    every = range(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in every), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    script = np.zeros(0x110000, np.uint8)
    for start, name in SCRIPTS:
        script[start:] = NAMES.index(name)
    return letter, lower, script


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased; starts and ends of the runs of letters; each text's offsets among the runs."""
    letter, lower, _ = _tables()
    texts = [t or "" for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, at = spans_of(letter[points], offsets)
    return lower[points], starts, ends, at


def _trigrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each letter with its two neighbours, the borders of its word being letters too; offsets of each word among them."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
    here = points[where].astype(np.uint64)
    before, after = np.concatenate([[np.uint64(1)], here[:-1]]), np.concatenate([here[1:], [np.uint64(2)]])
    before[at[:-1]], after[at[1:] - 1] = 1, 2
    return (mix64(before << np.uint64(42) | here << np.uint64(21) | after) % np.uint64(BUCKETS)).astype(np.int32), at


@dataclass
class Model:
    """Languages, ascending; log probabilities by language and bucket; which scripts each uses."""

    langs: list[str]
    logs: np.ndarray
    uses: np.ndarray


def train(docs: DataFrame) -> Model:
    """A model of the rows of (text, lang) with neither null: trigram and script counts of whole texts, summed by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for a, b in slices(batch["text"]):
                for lang in dict.fromkeys(langs[a:b]):
                    rows = np.flatnonzero(langs[a:b] == lang) + a
                    points, starts, ends, _ = _words(batch["text"].take(pa.array(rows)).to_pylist())
                    buckets, _ = _trigrams(points, starts, ends) if len(starts) else (np.zeros(0, np.int32), None)
                    scripts = np.repeat(_tables()[2][points[starts]], ends - starts)
                    counts = np.concatenate([np.bincount(buckets, minlength=BUCKETS), np.bincount(scripts, minlength=len(NAMES))])
                    total[lang] = total.get(lang, 0) + counts
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(work, "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS + len(NAMES) rows a language
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    counts[[langs.index(x) for x in found["lang"].to_pylist()], found["bucket"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log(grams + 0.5) - np.log(grams.sum(1, keepdims=True) + 0.5 * BUCKETS)
    return Model(langs, logs.astype(np.float32), scripts >= LEAST_SHARE * np.maximum(1, scripts.sum(1, keepdims=True)))


def word_scores(model: Model, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of log scores for each word: the sum over its letters; languages that do not use its script lose FOREIGN, unless none does."""
    buckets, at = _trigrams(points, starts, ends)
    scores = np.stack([np.add.reduceat(row[buckets], at[:-1]) for row in model.logs], axis=1).astype(np.float64)
    allowed = model.uses[:, _tables()[2][points[starts]]].T
    known = allowed.any(1, keepdims=True)
    return np.where(known, scores - FOREIGN * ~allowed, 0.0)


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path's state of each word, for all texts at once: texts stand side by side, longest first, and step word by word."""
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = at[:-1][order], sizes[order]
    small = np.min_scalar_type(scores.shape[1])
    states = np.arange(scores.shape[1], dtype=small)
    back = np.zeros(scores.shape, small)
    best = scores[begin[sizes > 0]]
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")  # texts with a word t
    for t in range(1, len(live)):
        k = live[t]
        here, rows = best[:k], begin[:k] + t
        top = here.argmax(1)
        change = here[np.arange(k), top][:, None] - switch
        stay = here >= change
        back[rows] = np.where(stay, states, top[:, None])
        best[:k] = np.where(stay, here, change) + scores[rows]
    path = np.zeros(len(scores), small)
    state = best.argmax(1).astype(small)
    for t in range(len(live) - 1, -1, -1):
        rows = begin[: live[t]] + t
        path[rows] = state[: live[t]]
        state[: live[t]] = back[rows, state[: live[t]]]
    return path


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """docs and lang_pred, score and, if asked for, lang_spans: the runs of words of one language (start, end in code points, lang).

    lang_pred has most letters of the text's spans (ties to the smaller name), score is its share of them. Null texts, texts
    without letters, and all texts if no language was learned: und, score 0, no spans. Whole texts are read. Repeated rows
    get equal results; other columns pass through, and columns of the three names are replaced. No rows: no rows.
    """
    docs = docs.drop("lang_pred", "score", "lang_spans")

    def label(texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        points, starts, ends, at = _words(texts)
        n = len(model.langs)
        if not n or not len(starts):
            return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        path = viterbi(word_scores(model, points, starts, ends), at)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        letters = np.bincount(doc * n + path, weights=ends - starts, minlength=len(texts) * n).reshape(-1, n)
        total, top = letters.sum(1), letters.argmax(1)
        names = [model.langs[k] if t else "und" for k, t in zip(top, total)]
        shares = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0).tolist()
        runs: list[list[dict]] = [[] for _ in texts]
        if spans:
            begin = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
            first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path.astype(np.int64), prepend=-1) != 0))
            for a, b in zip(first, np.append(first[1:], len(path))):
                d = doc[a]
                runs[d].append({"start": int(starts[a] - begin[d]), "end": int(ends[b - 1] - begin[d]), "lang": model.langs[path[a]]})
        return names, shares, runs

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                names, shares, runs = label(part["text"].to_pylist())
                new = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(shares, pa.float64())} | ({"lang_spans": pa.array(runs, span)} if spans else {})
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names=[*part.schema.names, *new])

    extra = "lang_pred string, score double" + (", lang_spans array<struct<start:long,end:long,lang:string>>" if spans else "")
    return docs.mapInArrow(work, StructType(docs.schema.fields + StructType.fromDDL(extra).fields))
