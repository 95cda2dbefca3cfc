"""Quality rules: counts of words, lines and symbols, and the divergence of a document's histograms from those of its language.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deepledger.llm.common import BROADCAST_ROWS, clean_name, cut, join_counted

BLANK = r"[\x20\x09-\x0D]+"
#: Words in a window, and common words of a language at most.
WINDOW, COMMON = 5, 50
#: Fewest words, and most per cent of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 10, 20
#: Words and characters from which a document's histograms are judged.
JUDGED_WORDS, JUDGED_CHARS = 50, 300
#: Largest divergence of words beyond that of as many words drawn from the reference, and largest distance of character classes.
WORD_EXCESS, CHAR_DISTANCE = 0.08, 0.35
CLASSES = ("upper", "letter", "digit", "n_symbols", "rest")


def _length(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _part(p: Column, q: Column) -> Column:
    """What a bin adds to the Jensen-Shannon divergence in bits; nothing if both are 0."""
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (term(p) + term(q)) / 2


def repeated_words(rows: DataFrame, hashes: str, out: str) -> DataFrame:
    """rows with the number of words in windows that occur twice or more: of the array of their words' hashes.

    A window is told by a hash of its words. Only where the distinct windows are fewer are they sorted with their places; of those
    beside an equal one the places give the words covered. Nothing is shuffled.
    """
    count = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
    window, found, same, places = (clean_name(rows, c) for c in ("_window", "_found", "_same", "_places"))
    shifted = [F.slice(hashes, k + 1, count).alias(f"w{k}") for k in range(WINDOW)]
    rows = rows.withColumn(window, F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w)))
    pairs = F.array_sort(F.transform(window, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn(found, F.when(F.size(F.array_distinct(window)) < F.size(window), pairs).otherwise(F.array().cast("array<struct<x: long, i: int>>")))
    rows = rows.withColumn(same, F.zip_with(found, F.slice(found, 2, F.size(found)), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))))
    before = F.concat(F.array(F.lit(False)), F.col(same))
    marked = F.zip_with(F.arrays_zip(F.col(found).alias("f"), F.col(same).alias("s")), before, lambda a, b: F.when(a["s"] | b, a["f"]["i"]))
    rows = rows.withColumn(places, F.array_sort(F.filter(marked, lambda i: i.isNotNull())))
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return rows.withColumn(out, F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)).drop(window, found, same, places)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (with text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the characters of the classes upper, digit, letter and rest; in one pass over the text."""
    text = F.coalesce("text", F.lit(""))
    hashes, lines, plain = (clean_name(docs, c) for c in ("_hashes", "_lines", "_plain"))
    rows = docs.withColumns({
        hashes: F.transform(_words(text), lambda w: F.xxhash64(w)),
        lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        plain: F.regexp_replace(text, r"\p{L}+", ""), "upper": _length(text, r"[^\p{Lu}]+"), "letter": F.char_length(text).cast("long"),
    })
    # what is no letter is short, and blanks, digits and symbols are counted in it
    blanks = F.char_length(plain) - _length(F.col(plain), BLANK)
    rows = rows.withColumns({"word_chars": F.col("letter") - blanks, "digit": _length(F.col(plain), r"[^0-9]+"), "n_symbols": _length(F.col(plain), r"[^#*$%&|<>]+"), "letter": F.col("letter") - F.char_length(plain)}).drop(plain)
    rows = rows.withColumns({"n_words": F.size(hashes).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}).drop(lines)
    rows = repeated_words(rows, hashes, "n_repeat_words").drop(hashes)
    rows = rows.withColumn("letter", F.col("letter") - F.col("upper"))
    return rows.withColumn("rest", F.col("word_chars") - F.col("letter") - F.col("upper") - F.col("digit") - F.col("n_symbols"))


def _lower_words(docs: DataFrame, *kept: Column) -> DataFrame:
    """A row for each word: _w, the hash of the language and the lower-case word, and the columns to keep."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("_lang"), *kept, _words(F.lower("text")).alias("_words"))
    return rows.withColumn("_words", F.explode("_words")).withColumn("_w", F.xxhash64("_lang", "_words")).drop("_words")


def word_reference(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(_lang, _w, bin, n): the common words of each language, numbered, and their counts in all documents.

    Common are the words that are more frequent than the one of place `common` + 1. Words are counted by a hash of language and
    word; each task gives that many of a language to its ranking.
    """
    words = _lower_words(docs).groupBy("_lang", "_w").agg(F.count("*").alias("n"))
    own = Window.partitionBy("_lang")
    first = words.withColumn("bin", F.row_number().over(own.orderBy(F.col("n").desc(), "_w")) - 1).where(F.col("bin") <= common)
    next_count = F.max(F.when(F.col("bin") == common, F.col("n"))).over(own)
    return cut(first.withColumn("next", next_count).where("next is null or n > next").drop("next"))


def bin_counts(docs: DataFrame, reference: DataFrame, keys: list[Column], common: int = COMMON) -> DataFrame:
    """(k0, k1, n, counts): all words, and those of each common word of the language, for the rows of each value of two keys."""
    bins = reference.select("_w", "bin")
    small = bins.count() <= BROADCAST_ROWS
    words = _lower_words(docs, *[k.alias(f"k{i}") for i, k in enumerate(keys)]).drop("_lang")
    binned = words.join(F.broadcast(bins) if small else bins, "_w", "left")
    return binned.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("bin") == i) for i in range(common)]).alias("counts"))


def drawn_divergence(n: Column, shares: Column) -> Column:
    """About the mean divergence of n words drawn from a reference: 1 / (8 n ln 2) for each bin, or half its share if that is less."""
    return F.aggregate(shares, F.lit(0.0), lambda s, q: s + F.least(q / 2, 1 / (8 * n * math.log(2))))


def quality_rules(docs: DataFrame, word_excess: float = WORD_EXCESS, char_distance: float = CHAR_DISTANCE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, word_js, word_noise, char_js, kept) for every row of docs (doc_id, text, lang).

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT per cent of them in windows of five words that occur twice or
    more. Other documents are held against references of their language: shares of its common words in all documents, and of
    character classes in those that did not fail. With JUDGED_WORDS words or more a document goes if its words' Jensen-Shannon
    divergence is over that of as many words drawn from the reference by more than `word_excess`; with JUDGED_CHARS characters or
    more if the distance (the root of the divergence) of its character classes is over `char_distance`.

    Null and empty texts: zeros, base_failed, not kept. A null language is one of its own. Repeated rows get equal values; null
    doc_ids are kept as rows. Very long texts are counted whole. Other columns are left out. No rows: no rows.
    """
    keys = [F.xxhash64("doc_id", "lang", "text"), F.xxhash64(F.lit(1), "text", "lang", "doc_id")]
    docs = docs.select("doc_id", "text", "lang")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    facts = base_counts(docs.withColumns({"k0": keys[0], "k1": keys[1]})).drop("text").withColumn("base_failed", failed)
    facts = cut(facts.withColumn("_lang", F.coalesce("lang", F.lit(""))).drop("lang"))
    sums = facts.where("not base_failed").groupBy("_lang").agg(F.sum("word_chars").alias("all"), *[F.sum(c).alias(f"all_{c}") for c in CLASSES])
    facts = join_counted(facts, sums, ["_lang"])
    char_js = sum((_part(F.col(c) / F.col("word_chars"), F.col(f"all_{c}") / F.col("all")) for c in CLASSES), F.lit(0.0))
    facts = facts.withColumn("char_js", F.when(F.col("word_chars") > 0, char_js)).drop("all", *[f"all_{c}" for c in CLASSES])
    reference = word_reference(docs)
    held = reference.groupBy("_lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    shares = facts.groupBy("_lang").agg(F.sum("n_words").alias("all")).where("all > 0").join(held, "_lang", "left")
    shares = shares.select("_lang", F.array(*[F.coalesce(F.try_element_at("held", F.lit(i)) / F.col("all"), F.lit(0.0)) for i in range(COMMON)]).alias("shares"))
    shares = shares.withColumn("shares", F.concat("shares", F.array(1 - F.aggregate("shares", F.lit(0.0), lambda s, q: s + q))))
    facts = join_counted(facts, shares, ["_lang"])
    # rows of one value of the keys have the same language and text, so that together they have the shares of one
    out = facts.join(bin_counts(docs, reference, keys), ["k0", "k1"], "left")
    every = F.concat("counts", F.array(F.col("n") - F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)))
    word_js = F.aggregate(F.zip_with(every, "shares", lambda c, q: _part(c / F.col("n"), q)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumns({"word_js": word_js, "word_noise": F.when(F.col("n_words") > 0, drawn_divergence(F.col("n_words"), F.col("shares")))})
    odd_words = (F.col("n_words") >= JUDGED_WORDS) & (F.col("word_js") - F.col("word_noise") > word_excess)
    odd_chars = (F.col("word_chars") >= JUDGED_CHARS) & (F.col("char_js") > char_distance**2)
    kept = ~F.col("base_failed") & ~F.coalesce(odd_words, F.lit(False)) & ~F.coalesce(odd_chars, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "word_js", "word_noise", "char_js", kept.alias("kept"))
