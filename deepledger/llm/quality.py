"""Perplexity of words under an interpolated modified Kneser-Ney model of trusted text, thresholded by language."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deepledger.llm.common import GOLDEN, cut, join_counted, mix64, scratch, slices, text_bytes

#: What stands before a text in the place of a word's hash.
START = 0x1FFFFE
#: The language of the model for rows whose own has none: all trusted text together.
ANY = ""
#: Of the trusted texts one in so many, by a hash of the text, sets the thresholds and trains nothing.
FOLDS = 10
#: Held-out texts that a language needs for a model and a quantile of its own.
LEAST_HELD = 20
#: Multipliers of the words of a trigram and of the number of its text, to find the distinct ones of a slice.
_MIX = mix64(np.arange(101, 105, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
GRAM = "a long, b long, c long, n long"
#: Ids of trusted documents up to which they are broadcast; beyond it texts meet them in a shuffle, once, and are written.
IDS = 2_000_000
#: Words that one turn takes at least and one slot at most, and the most turns. A turn shuffles the words of its share of the n-grams and releases them.
TURN_WORDS, SLOT_WORDS, TURNS = 1_000_000, 1_500_000, 8
#: Words that a task deals out together, and how often a word occurs at least that gets several slots.
DEALT_WORDS, HOT_WORDS = 500_000, 10_000
#: Kinds of the rows between tasks.
WORDS, BIGRAMS, TOKENS, HEADS, SUMS, PENDING = range(6)
ROW = "slot int, kind int, data binary"
COUNTED = f"{ROW}, ways int, m int, s array<long>"
#: 0 for blanks, 1 for letters, digits and all beyond ASCII, 2 for other visible characters.
_TYPE = bytes(0 if x <= 32 or x == 127 else 1 if x > 127 or chr(x).isalnum() else 2 for x in range(256))
#: Masks of the first bytes of 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's offsets among them.

    A word is a run of ASCII letters, digits and characters beyond ASCII, or one of other visible characters; case counts.
    """
    data, offsets = text_bytes(column)
    kind = np.frombuffer(data.tobytes().translate(_TYPE), np.uint8)
    hard = np.flatnonzero(data == 0xC2)
    hard = hard[data[np.minimum(hard + 1, len(data) - 1)] == 0xA0]  # the blank that does not break
    if len(hard):
        kind = kind.copy()
        kind[hard] = kind[hard + 1] = 0
    edge = np.ones(len(kind) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    word = kind[at[:-1]] > 0
    starts = at[:-1][word]
    return _word_hashes(data, starts, at[1:][word] - starts), np.searchsorted(starts, offsets)


def _word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, taken 8 bytes at a time; those of more than 64 bytes are hashed one by one."""
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    out = mix64(sizes.astype(np.uint64) * np.uint64(GOLDEN) ^ (eights[starts] & _FIRST[np.minimum(sizes, 8)]))
    far = np.flatnonzero(sizes > 8)
    for done in range(8, 64, 8):
        out[far] = mix64(out[far] ^ (eights[starts[far] + done] & _FIRST[np.minimum(sizes[far] - done, 8)]))
        far = far[sizes[far] > done + 8]
    for i in far.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _trigrams(words: np.ndarray, at: np.ndarray, salt: np.ndarray, pick: Callable | None = None) -> tuple[np.ndarray, ...]:
    """text, a, b, c: the trigram that ends at each word, hashed with the salt of its text; two START stand before each text. pick: which middle words count."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    c, start = mix64(words ^ np.repeat(salt, sizes)), mix64(np.uint64(START) ^ salt)
    b = np.empty_like(c)
    b[1:] = c[:-1]
    b[at[full]] = start[full]
    own = np.arange(len(c)) if pick is None else np.flatnonzero(pick(b))
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[own].astype(np.int64)
    return text, np.where(own - at[text] >= 2, c[np.maximum(own - 2, 0)], start[text]), b[own], c[own]


def _key(*parts: np.ndarray) -> np.ndarray:
    """A hash of the words of an n-gram."""
    key = parts[0] * _MIX[0] + _MIX[3]
    for x, by in zip(parts[1:], _MIX[1:], strict=False):
        key = mix64(key) + x * by
    return mix64(key)


def _word_trigrams(column: pa.Array, lang: str) -> tuple[np.ndarray, ...]:
    """a, b, c, n: the distinct trigrams of words of all texts, hashed with their language, and their counts."""
    words, at = _words(column)
    _, *grams = _trigrams(words, at, np.repeat(_salts([lang]), len(column)))
    _, first, n = np.unique(_key(*grams), return_index=True, return_counts=True)
    return *[x[first].view(np.int64) for x in grams], n.astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, a, b, c, n): the trigrams of words of all rows of (lang, text), neither of them null; each task sums what it reads before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for lang in dict.fromkeys(langs):
                own = batch["text"].take(pa.array(np.flatnonzero(langs == lang)))
                for lo, hi in slices(own):
                    grams = _word_trigrams(own.slice(lo, hi - lo), lang)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams[0]), pa.string()), *map(pa.array, grams)], names=["lang", "a", "b", "c", "n"])

    return texts.mapInArrow(work, f"lang string, {GRAM}").groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): what modified Kneser-Ney takes off counts of 1, 2 and more, from the counts of counts."""
    t = counts.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1.0))
    d = lambda k: F.least(F.lit(float(k)), F.greatest(F.lit(0.0), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}")), F.lit(0.5))))
    return t.select("lang", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def _taken() -> Column:
    return F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))


def _levels(three: DataFrame) -> tuple[DataFrame, ...]:
    """p3 (lang, a, b, c, p), p2 (lang, b, c, p), p1 (lang, c, p) of each n-gram in (lang, a, b, c, n); g2 (lang, a, b, g), g1 (lang, b, g), g0 (lang, g): the weight that a context of two, one and no symbols leaves to the next shorter one.

    Trigrams have raw counts; shorter n-grams count the distinct symbols seen before them. All steps are grouped sums and joins of
    the n-gram shards by language and n-gram; only languages and their discounts, a row each, are broadcast.
    """
    two = three.groupBy("lang", "b", "c").agg(F.count("*").alias("n"))
    one = two.groupBy("lang", "c").agg(F.count("*").alias("n"))

    def level(grams: DataFrame, *context: str) -> tuple[DataFrame, DataFrame]:
        held = grams.join(F.broadcast(_discounts(grams)), "lang")
        sums = held.groupBy("lang", *context).agg(F.sum("n").alias("total"), (F.sum(_taken()) / F.sum("n")).alias("g"))
        own = held.join(sums, ["lang", *context])
        return own.withColumn("own", (F.col("n") - _taken()) / F.col("total")).drop("n", "total", "d1", "d2", "d3"), sums.drop("total")

    w1, g0 = level(one)
    vocabulary = one.groupBy("lang").agg((F.count("*") + 1).alias("v"))  # and the unknown symbol
    g0 = cut(g0.join(vocabulary, "lang").select("lang", (F.col("g") / F.col("v")).alias("g")))  # a row for each language
    p1 = w1.drop("g").join(F.broadcast(g0), "lang").select("lang", "c", (F.col("own") + F.col("g")).alias("p"))
    w2, g1 = level(two, "b")
    p2 = _stored(w2.join(p1, ["lang", "c"]).select("lang", "b", "c", (F.col("own") + F.col("g") * F.col("p")).alias("p")))
    w3, g2 = level(three, "a", "b")
    p3 = w3.join(p2, ["lang", "b", "c"]).select("lang", "a", "b", "c", (F.col("own") + F.col("g") * F.col("p")).alias("p"))
    return p3, p2, p1, g2, g1, g0


def _stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written to the shared folder in columns and read again; what was shuffled for them is released at once."""
    spark, release = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = path or scratch(spark, "quality")
    before = spark.conf.get(release, None)
    spark.conf.set(release, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(release, before) if before is not None else spark.conf.unset(release)
    return spark.read.parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more from the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Plan(NamedTuple):
    """How trigrams are dealt: by their middle word to one of turns * slots shards; those of a hot word to as many as it has ways."""

    turns: int
    slots: int
    hot: np.ndarray
    ways: np.ndarray

    def first(self, b: np.ndarray) -> np.ndarray:
        """The first shard of each middle word, which is a hash."""
        return ((b >> np.uint64(32)) * np.uint64(self.turns * self.slots)) >> np.uint64(32)

    def split(self, b: np.ndarray) -> np.ndarray:
        """The number of shards of each middle word."""
        if not len(self.hot):
            return np.ones(len(b), np.uint64)
        at = np.searchsorted(self.hot, b).clip(max=len(self.hot) - 1)
        return np.where(self.hot[at] == b, self.ways[at], np.uint64(1))

    def shard(self, b: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The shard of each middle word; the way of a hot one is chosen by another word, and its ways lie in different turns."""
        way = ((other >> np.uint64(32)) * self.split(b)) >> np.uint64(32)
        return (self.first(b) + way * np.uint64(self.slots) + way // np.uint64(self.turns)) % np.uint64(self.turns * self.slots)

    def near(self, turn: int) -> Callable[[np.ndarray], np.ndarray]:
        """A quick look at middle words: none of the turn is missed, some hot ones of others are taken."""
        low, high = np.uint64(turn * self.slots), np.uint64((turn + 1) * self.slots)
        warm = np.zeros(1 << 16, bool)
        warm[self.hot & np.uint64(0xFFFF)] = True
        return lambda b: ((first := self.first(b)) >= low) & (first < high) | warm[b & np.uint64(0xFFFF)]

    def slot(self, x: np.ndarray) -> np.ndarray:
        """Where a last word, or what a task has dealt together, meets the rest of its own."""
        return (mix64(x + np.uint64(1)) % np.uint64(self.slots)).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(x.max() if len(x) else 0))


def _packed(*arrays: np.ndarray) -> bytes:
    return pickle.dumps([(x.dtype.str, len(x), pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b"") for x in arrays])


def _unpacked(data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(z, n * np.dtype(t).itemsize, codec="zstd", asbytes=True) if n else b"", t) for t, n, z in pickle.loads(data)]


def _rows(rows: list[tuple], schema: str = ROW) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[x for x, _ in fields])


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[list[np.ndarray]]]:
    """The arrays of all rows of a partition by kind."""
    out: dict[int, list[list[np.ndarray]]] = {k: [] for k in range(6)}
    for batch in batches:
        for kind, data in zip(batch["kind"].to_pylist(), batch["data"], strict=True):
            out[kind].append(_unpacked(data.as_py()))
    return out


def _joined(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*rows, strict=True)]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each key, in order of keys, and each place's number among the keys."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return first, number


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])).tolist() if len(sorted_keys) else []
    return zip(at[:-1], at[1:])


def _dealt(texts: DataFrame, plan: Plan, salts: np.ndarray, turn: int, counting: bool) -> DataFrame:
    """ROW: the trigrams of a turn of (text, _m, _row, _train, _score), by slot; equal ones that a task deals together are one with a number.

    counting: those of a hot word are dealt by their last word, and texts are not told apart. Otherwise they are dealt by their first
    word, and HEADS has the _row of each text that a task deals out together; these are known by a hash of all of their _row.
    """

    def deal(parts: list, heads: list) -> pa.RecordBatch:
        a, b, c, text, slot, tag = _joined(parts)
        rows = np.concatenate(heads)
        bits = np.uint64(64 - int(plan.slots).bit_length())
        thin = lambda x, n: mix64(x) >> np.uint64(64 - n)
        by = (bits - np.uint64(12)) // np.uint64(2)
        order = np.argsort((slot << bits) | (thin(b, int(by)) << (bits - by)) | (thin(a, 12) << by) | thin(c + text.astype(np.uint64) * _MIX[3], int(by)))
        a, b, c, text, slot, tag = (x[order] for x in (a, b, c, text, slot, tag))
        new = np.ones(len(a), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (a, b, c, text)])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(a)))
        a, b, c, text, slot, tag = (x[at] for x in (a, b, c, text, slot, tag))
        name = np.array([int.from_bytes(hashlib.blake2b(rows.tobytes(), digest_size=8).digest(), "little")], np.uint64)
        out = [(int(slot[i]), TOKENS, _packed(name, a[i:j], b[i:j], c[i:j], _narrow(text[i:j]), _narrow(n[i:j]), _narrow(tag[i:j]))) for i, j in _runs(slot)]
        return _rows(out if counting else [*out, (int(plan.slot(name)[0]), HEADS, _packed(name, rows))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, heads, size, near = [], [], 0, plan.near(turn)
        for batch in batches:
            m, train, score, rows = (batch[x].to_numpy(zero_copy_only=False) for x in ("_m", "_train", "_score", "_row"))
            tags = m.astype(np.int64) * 4 + train * 2 + score
            for lo, hi in slices(batch["text"]):
                words, at = _words(batch["text"].slice(lo, hi - lo))
                text, a, b, c = _trigrams(words, at, salts[m[lo:hi]], near)
                slot = plan.shard(b, c if counting else a) - np.uint64(turn * plan.slots)  # one of another turn is no slot, below 0 neither
                own = np.flatnonzero(slot < plan.slots)
                text = text[own]
                parts.append((a[own], b[own], c[own], text * 0 if counting else text + sum(map(len, heads)), slot[own], tags[lo:hi][text]))
                heads.append(rows[lo:hi].view(np.uint64))
                size += len(own)
                if size >= DEALT_WORDS:
                    yield deal(parts, heads)
                    parts, heads, size = [], [], 0
        if size:
            yield deal(parts, heads)

    return texts.select("text", "_m", "_row", "_train", "_score").mapInArrow(work, ROW)


def _at_slots(rows: DataFrame, plan: Plan, work: Callable, schema: str) -> DataFrame:
    """work over the rows of each slot, a task each."""
    return rows.repartitionById(plan.slots, F.col("slot")).mapInArrow(work, schema)


def _statistics(level: int, m: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Rows of COUNTED for each model: how many n-grams have counts of 1, 2, 3 and 4, how many there are, and their sum."""
    return [(-level, WORDS, None, None, int(k), [*(int((n[m == k] == x).sum()) for x in (1, 2, 3, 4)), int((m == k).sum()), int(n[m == k].sum())]) for k in np.unique(m)]


def _counted(train: DataFrame, plan: Plan, salts: np.ndarray, turns: int) -> DataFrame:
    """COUNTED: BIGRAMS (b, c, left words of b c, left words of c, model) at the first shard and with the ways of b, WORDS (c, left words, model) at the slot of c, statistics at -1 to -3."""

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := _gathered(batches)[TOKENS]):
            return
        _, a, b, c, _, n, tag = _joined(rows)
        first, number = _groups(_key(a, b, c))
        b, c, m = b[first], c[first], tag[first] // 4
        out = _statistics(3, m, np.bincount(number, n).astype(np.int64))
        first, number = _groups(_key(b, c))
        b, c, m, n = b[first], c[first], m[first], np.bincount(number)
        out += _statistics(2, m, n)
        slot = plan.slot(c)
        order = np.lexsort([b, slot])
        b, c, m, n, slot = (x[order] for x in (b, c, m, n, slot))
        yield _rows([*out, *((int(slot[i]), BIGRAMS, _packed(b[i:j], c[i:j], _narrow(n[i:j]), _narrow(m[i:j]))) for i, j in _runs(slot))], COUNTED)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := _gathered(batches)[BIGRAMS]):
            return
        b, c, n, m = _joined(rows)
        first, number = _groups(c)
        left = np.bincount(number)
        out = _statistics(1, m[first], left)
        out.append((int(plan.slot(c[:1])[0]), WORDS, _packed(c[first], _narrow(left), _narrow(m[first]))))
        shard, ways = plan.first(b), plan.split(b)
        order = np.lexsort([b, shard, ways])
        b, c, n, m, left, shard, ways = (x[order] for x in (b, c, n, m, left[number], shard, ways))
        yield _rows([*out, *((int(shard[i]), BIGRAMS, _packed(b[i:j], c[i:j], _narrow(n[i:j]), _narrow(left[i:j]), _narrow(m[i:j])), int(ways[i])) for i, j in _runs(shard * np.uint64(1 << 20) + ways))], COUNTED)

    spark, place = train.sparkSession, scratch(train.sparkSession, "quality")
    parts = [f"{place}/{turn}" for turn in range(turns)]
    own = plan._replace(turns=turns, ways=np.minimum(plan.ways, np.uint64(turns * plan.slots)))
    for turn, path in enumerate(parts):
        _stored(_at_slots(_dealt(train, own, salts, turn, True), plan, bigrams, COUNTED), path)
    both = spark.read.schema(COUNTED).parquet(*parts)
    out = _stored(_at_slots(both.where("slot >= 0").select("slot", "kind", "data"), plan, words, COUNTED).union(both.where("slot < 0")))
    _deleted(spark, place)
    return out


class Model(NamedTuple):
    """What holds for a whole model, by its number: discounts of counts of 1, 2 and more of trigrams, bigrams and words, the sum of the words' counts and the probability of an unknown word."""

    three: np.ndarray
    two: np.ndarray
    one: np.ndarray
    total: np.ndarray
    unknown: np.ndarray

    def word(self, left: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (left - self.one[m, np.minimum(left, 3) - 1]) / self.total[m] + self.unknown[m]


def _model(counted: DataFrame, models: int) -> Model:
    """The model of the statistics, of which the driver gets a row for each level and model."""
    d, total, unknown = np.full((3, models, 3), 0.5), np.ones(models), np.ones(models)
    for level in (1, 2, 3):
        for x in counted.where(F.col("slot") == -level).groupBy("m").agg(*[F.sum(F.col("s")[i]) for i in range(6)]).collect():
            m, t1, t2, t3, t4, size, of = x
            y = t1 / max(t1 + 2 * t2, 1)
            d[level - 1, m] = [min(k, max(0.0, k - (k + 1) * y * up / t if t else 0.5)) for k, t, up in ((1, t1, t2), (2, t2, t3), (3, t3, t4))]
            if level == 1:
                total[m], unknown[m] = of, np.dot([t1, t2, size - t1 - t2], d[0, m]) / of / (size + 1)
    return Model(d[2], d[1], d[0], total, unknown)


def _sums(name: np.uint64, text: np.ndarray, nll: np.ndarray, n: np.ndarray, plan: Plan) -> tuple:
    """A row of SUMS: of texts dealt out together, by their place, the sum of -log p and the number of words."""
    at = np.flatnonzero(np.bincount(text))
    add = lambda x: np.bincount(text, x)[at]
    return int(plan.slot(np.array([name]))[0]), SUMS, _packed(np.array([name]), _narrow(at), add(nll), _narrow(add(n).astype(np.int64)))


def _merged(rows: list[list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """The arrays of SUMS by the name of what was dealt out together."""
    by: dict[int, list] = {}
    for name, *x in rows:
        by.setdefault(int(name[0]), []).append(x)
    return {k: _joined(x) for k, x in by.items()}


def _turn(texts: DataFrame, counted: DataFrame, plan: Plan, salts: np.ndarray, model: Model, turn: int) -> DataFrame:
    """(_row, nll, n): of each text, the sum of -log p over the words of a turn, and their number.

    A slot has all trigrams of its middle words (of a hot one those of some first words) and all bigrams of the model that begin with
    them. A word whose bigram the model lacks goes on to the slot of the word; its sums come back to where HEADS are.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        yield _rows([(int(plan.slot(name)[0]), HEADS, _packed(name, x)) for name, x in rows[HEADS]])
        if not rows[TOKENS]:
            return
        names = np.concatenate([x[0] for x in rows[TOKENS]])
        sizes = np.array([len(x[1]) for x in rows[TOKENS]])
        a, b, c, text, n, tag = _joined([x[1:] for x in rows.pop(TOKENS)])
        n = n.astype(np.int64)
        first, number = _groups(_key(a, b, c))
        count = np.bincount(number, np.where(tag & 2, n, 0)).astype(np.int64)  # of each trigram in the model
        m = tag[first] // 4
        taken = np.where(count > 0, model.three[m, np.clip(count, 1, 3) - 1], 0.0)
        _, context = _groups(_key(a, b)[first])
        total = np.bincount(context, count)[context]
        known = total > 0
        total = np.where(known, total, 1)
        own, rest = (count - taken) / total, np.where(known, np.bincount(context, taken)[context] / total, 1.0)
        b, c = b[first], c[first]
        lower, after = np.zeros(len(b)), np.ones(len(b))  # p of the bigram, 0 if the model lacks it; what its first word leaves
        if rows[BIGRAMS]:
            tb, tc, tn, left, tm = _joined(rows.pop(BIGRAMS))
            tn, left = tn.astype(np.int64), left.astype(np.int64)
            begin, context = _groups(tb)
            gone = model.two[tm, np.minimum(tn, 3) - 1]
            total = np.bincount(context, tn)
            leaves = np.bincount(context, gone) / total
            p = (tn - gone) / total[context] + leaves[context] * model.word(left, tm)
            key = _key(tb, tc)
            order = np.argsort(key)
            for values, keys, wanted, into in ((p[order], key[order], _key(b, c), lower), (leaves, tb[begin], b, after)):
                at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
                hit = keys[at] == wanted
                into[hit] = values[at[hit]]
        have = lower > 0
        p = np.where(have, own + rest * lower, rest * after)
        nll = -np.log(np.where(p > 0, p, 1.0))  # where discounts of 0 leave nothing to a word that does not follow, it adds nothing, and an unknown one as if it stood alone
        scored = (tag & 1) > 0
        ends = np.cumsum(sizes)
        out = []
        for name, i, j in zip(names, ends - sizes, ends, strict=True):
            if (own := i + np.flatnonzero(scored[i:j])).size:
                out.append(_sums(name, text[own], nll[number[own]] * n[own], n[own], plan))
        open_ = np.flatnonzero(scored & ~have[number])
        c, slot = c[number[open_]], plan.slot(c)[number[open_]]
        order = np.lexsort([c, slot])
        open_, c, slot = open_[order], c[order], slot[order]
        of = np.searchsorted(ends, open_, side="right")
        for i, j in _runs(slot):
            x = open_[i:j]
            used, at = np.unique(of[i:j], return_inverse=True)
            out.append((int(slot[i]), PENDING, _packed(names[used], c[i:j], _narrow(at), _narrow(text[x]), _narrow(n[x]), _narrow(tag[x] // 4 * 2 + (p[number[x]] == 0)))))
        yield _rows(out)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        yield _rows([(int(plan.slot(name)[0]), HEADS, _packed(name, x)) for name, x in rows[HEADS]])
        out = [_sums(np.uint64(k), text, nll, n, plan) for k, (text, nll, n) in _merged(rows[SUMS]).items()]
        keys, left, m = _joined(rows[WORDS]) if rows[WORDS] else [np.zeros(0, np.uint64)] * 3
        order = np.argsort(keys)
        keys, p = keys[order], model.word(left[order].astype(np.int64), m[order].astype(np.int64))
        parts: dict[int, list] = {}
        for names, c, of, text, n, m in rows[PENDING]:
            nothing, m = m % 2 > 0, m // 2
            q = model.unknown[m]
            if len(keys):
                at = np.searchsorted(keys, c).clip(max=len(keys) - 1)
                q = np.where(keys[at] == c, np.where(nothing, 1.0, p[at]), q)
            order = np.argsort(of, kind="stable")
            for i, j in _runs(of[order]):
                x = order[i:j]
                parts.setdefault(int(names[of[x[0]]]), []).append([text[x], -np.log(q[x]) * n[x]])
        for k, x in parts.items():
            text, nll = _joined(x)
            out.append(_sums(np.uint64(k), text, nll, np.zeros(len(text), np.int64), plan))
        yield _rows(out)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        heads = {int(name[0]): x for name, x in rows[HEADS]}
        for k, (text, nll, n) in _merged(rows[SUMS]).items():
            at = np.flatnonzero(np.bincount(text))
            yield pa.RecordBatch.from_arrays([pa.array(heads[k][at].view(np.int64)), pa.array(np.bincount(text, nll)[at]), pa.array(np.bincount(text, n)[at].astype(np.int64))], names=["_row", "nll", "n"])

    shard = (F.col("slot") + F.col("way") * plan.slots + F.floor(F.col("way") / plan.turns)) % (plan.turns * plan.slots)
    bigrams = counted.where(f"kind = {BIGRAMS}").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    bigrams = bigrams.where(F.floor(shard / plan.slots) == turn).select((shard % plan.slots).cast("int").alias("slot"), "kind", "data")
    vocabulary = counted.where(f"slot >= 0 and kind = {WORDS}").select("slot", "kind", "data")
    scored = _at_slots(_dealt(texts, plan, salts, turn, False).union(bigrams), plan, score, ROW)
    return _at_slots(_at_slots(scored.union(vocabulary), plan, words, ROW), plan, ended, "_row long, nll double, n long")


def _planned(texts: DataFrame, salts: np.ndarray) -> tuple[Plan, int]:
    """Turns and slots by the number of all words, more ways for a word that has more than half the words of a slot; the turns of counting, by the number of words that train."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, train = (batch[x].to_numpy(zero_copy_only=False) for x in ("_m", "_train"))
            for lo, hi in slices(batch["text"]):
                words, at = _words(batch["text"].slice(lo, hi - lo))
                sizes = np.diff(at)
                word, n = np.unique(mix64(words ^ np.repeat(salts[m[lo:hi]], sizes)), return_counts=True)
                often = n * 5_000 >= len(words)  # a word that is rare here can be frequent elsewhere, at the cost of balance alone
                none = np.zeros(often.sum(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([None, *word[often].view(np.int64).tolist()], pa.int64()), pa.array(np.append(len(words), n[often])), pa.array(np.append(sizes[train[lo:hi]].sum(), none))], names=["w", "n", "t"])

    counts = cut(texts.select("text", "_m", "_train").mapInArrow(work, "w long, n long, t long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    total, train = counts.where("w is null").select("n", "t").first()
    turns = min(max(total // TURN_WORDS, 1), TURNS)
    slots = max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-total // (turns * SLOT_WORDS)))
    most = max(total // (turns * slots) // 2, HOT_WORDS)
    hot = sorted((np.int64(x["w"]).view(np.uint64), x["n"]) for x in counts.where(F.col("w").isNotNull() & (F.col("n") > most)).collect())  # at most 2 * turns * slots
    plan = Plan(turns, slots, np.array([x for x, _ in hot], np.uint64), np.array([min(n // most + 1, turns * slots) for _, n in hot], np.uint64))
    return plan, -(-turns * train // max(total, 1)) or 1


def _scored(rows: DataFrame, models: list[str]) -> DataFrame:
    """(_row, nll, n) of the texts of rows (text, _row, _m, _train, _score) with _score: the sum of -log p over the words of each, and their number.

    _m: the number of its model, whose texts with _train train it. Equal rows have one _row and are summed together, which leaves nll / n
    as it is. Each turn tells the words of all texts apart anew and shuffles only the trigrams whose middle words are its own: with them, the
    model's counts of them and all texts that hold them are together, and nothing of a turn is kept but its sums by text.
    """
    salts = _salts(models)
    plan, turns = _planned(rows, salts)
    counted = _counted(rows.where("_train"), plan, salts, turns)
    model = _model(counted, len(models))
    sums = [_stored(_turn(rows, counted, plan, salts, model, turn)) for turn in range(plan.turns)]
    both = sums[0]
    for x in sums[1:]:
        both = both.union(x)
    return both.groupBy("_row").agg(F.sum("nll").alias("_nll"), F.sum("n").alias("_n"))


def score_quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, model_rows: int = IDS, least_held: int = LEAST_HELD) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every row of docs (doc_id, text, lang).

    trusted: (doc_id) of the documents whose text trains the model of words and sets the thresholds. One text in FOLDS of them is
    held out: all of these are scored, none trains, and the threshold of each language is the given quantile of their negative
    log-likelihood per word (in steps of 0.001, so that sums of steps, not of documents, are gathered).
    A language without trusted text to train on or with less than least_held texts held out, and null, uses the model and threshold of all.
    Texts without words, null ones too, and all texts if there is no threshold: kept; perplexity null without words or model. Rows
    with null doc_id train nothing but are scored. Repeated rows score alike. Other columns are left out. No rows: no rows.
    model_rows: up to so many ids of trusted documents are broadcast; the model itself never is.
    """
    trusted = cut(trusted.where("doc_id is not null").select("doc_id").distinct())
    small = trusted.count() <= model_rows
    ids = trusted.withColumn("_trusted", F.lit(True))
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(ids) if small else ids, "doc_id", "left")
    worded = F.col("text").rlike(r"[^\x00-\x20\x7F\xA0]")
    fold = F.when(F.col("_trusted") & worded, F.crc32("text") % FOLDS == 0)
    texts = texts.select("doc_id", "text", "lang", fold.alias("_held"))
    texts = texts if small else _stored(texts)  # each turn reads them
    by_lang = cut(texts.groupBy("lang").agg(F.count_if("_held").alias("held"), F.count_if(~F.col("_held")).alias("train")))
    apart = (F.col("lang") != ANY) & (F.col("held") >= least_held) & (F.col("train") > 0)
    known = sorted(r["lang"] for r in by_lang.where(apart).select("lang").collect())  # languages
    trains = not by_lang.where("train > 0").isEmpty()
    own = F.coalesce(F.col("lang").isin(known), F.lit(False))
    train = F.coalesce(~F.col("_held"), F.lit(False))
    rows = texts.withColumns({"_model": F.when(own, F.col("lang")).otherwise(F.lit(ANY)), "_only": F.lit(False), "_train": train, "_score": F.lit(True)})
    if not by_lang.where(~own).isEmpty():  # of known languages, what else trains the model of all or sets its threshold
        rows = rows.union(texts.where(own & F.col("_held").isNotNull()).withColumns({"_model": F.lit(ANY), "_only": F.lit(True), "_train": train, "_score": F.col("_held")}))
    number = F.coalesce(*[F.when(F.col("_model") == x, F.lit(i)) for i, x in enumerate([*known, ANY])])
    rows = rows.withColumns({"_m": number, "_row": F.xxhash64(*rows.columns)})
    scored = rows.where("_score").select("doc_id", "lang", "_model", "_held", "_only", "_row")
    if trains:
        scored = join_counted(scored, _scored(rows, [*known, ANY]), ["_row"])
    else:
        scored = scored.withColumns({"_nll": F.lit(None).cast("double"), "_n": F.lit(None).cast("long")})
    nll = F.when((F.col("_n") > 0) & (F.col("_nll") > 0), F.col("_nll") / F.col("_n"))
    scored = cut(scored.select("doc_id", "lang", "_model", "_held", "_only", nll.alias("nll")))
    held = scored.where("_held and nll is not null")
    steps = held.groupBy("_model", F.ceil(F.col("nll") * 1000).alias("step")).agg(F.count("*").alias("k"))
    whole = Window.partitionBy("_model")
    cumulative = steps.withColumns({"c": F.sum("k").over(whole.orderBy("step")), "t": F.sum("k").over(whole)})
    limits = cumulative.where(F.col("c") >= quantile * F.col("t")).groupBy("_model").agg((F.min("step") / 1000).alias("limit"))  # a row for each language
    out = scored.where("not _only").join(F.broadcast(limits), "_model", "left")
    return out.select("doc_id", "lang", F.exp("nll").alias("perplexity"), F.exp("limit").alias("threshold"), F.coalesce(F.col("nll") <= F.col("limit"), F.lit(True)).alias("keep"))
