"""Token alignment, Merkle manifest and quality rules against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deepledger.llm import alignment, merkle, queries, rules

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "a", "Hello world, it's 10 o'clock.\n\n  indented\ttext  ", "<|endoftext|> <s>[INST] </s>", "漢字かな交じり文 with ASCII words", "a▁b has the piece mark", "café naïve ÀÉ ﬁ ½",
    "emoji 👩‍👩‍👧 and ​ zero width", "\x00\x01 controls \x7f", "x" * 3000, "word " * 2000, "ends with blank ", "  two leading", "a b　c", "0x00 <0x0A> ▁",
]


def docs_of(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, ("en", "de", None)[i % 3], "s" if sources is None else sources[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- token alignment


@pytest.fixture(scope="module")
def coder():
    return alignment.Coders(A, B)


def plain_groups(coder, text):
    """[(A ids, B ids)] of a whole text, or None, from two encodings of all of it."""
    if not text:
        return None
    a, b = coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
    raw = (" " + text).encode()
    ends = []
    for ids, table in ((a, coder.a_bytes), (b, coder.b_bytes)):
        at, own = 0, []
        for i in ids:
            at += len(table[i])
            own.append(at)
        if b"".join(table[i] for i in ids) != raw:
            return None
        ends.append(own)
    both = set(ends[0]) & set(ends[1])
    out, own = [], ([], [])
    parts = sorted([(e, 0, i) for e, i in zip(ends[0], range(len(a)))] + [(e, 1, i) for e, i in zip(ends[1], range(len(b)))])
    for e, side, i in parts:
        own[side].append((a, b)[side][i])
        if side == 1 and e in both:
            out.append((own[0], own[1]))
            own = ([], [])
    assert own == ([], [])
    return out


def segment_groups(coder, text):
    segments = coder.segments(text)
    known = coder.groups(segments)
    return None if None in known else ";".join(x[2] for x in known)


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab.'Z0é漢▁<|> ​👩"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60))
@settings(max_examples=400, deadline=None)
def test_segments_code_as_whole_texts(coder, text):
    want = plain_groups(coder, text)
    assert segment_groups(coder, text) == (None if want is None else as_text(want))


def brute_alignment(coder, texts, by_docs=False):
    whole = [plain_groups(coder, t) for t in texts]
    count = Counter()
    for groups in whole:
        for a, b in {(tuple(a), tuple(b)) for a, b in groups or []} if by_docs else groups or []:
            count[a[-1], b[-1]] += 1
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for groups in whole:
        if groups is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in groups]
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(as_text(groups).encode()).hexdigest()))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("by", ["n", "docs"])
def test_alignment_equals_brute_force(spark, coder, by):
    r = random.Random(4)
    texts = ODD + [" ".join(r.choice(["the", "The", "of,", "unhappiness", "x1", "ßü", "(a)"]) for _ in range(r.randrange(1, 60))) for _ in range(40)] + ["same text twice"] * 5
    rows = alignment.align(docs_of(spark, texts).repartition(3), A, B, by=by, keep_groups=True).collect()
    got = {x["doc_id"]: x for x in rows}
    assert len(rows) == len(texts)
    for i, want in enumerate(brute_alignment(coder, texts, by == "docs")):
        assert tuple(got[i][c] for c in FIELDS) == want
        assert hashlib.sha256(got[i]["groups"].encode()).hexdigest() == want[-1] or want[-1] == ""


def test_alignment_of_a_table(spark, coder):
    sf = "/root/testdata/sf0.001"
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {x["doc_id"]: tuple(x[c] for c in FIELDS) for x in queries.op11_token_alignment(spark, sf).collect()}
    assert got == dict(zip(texts, brute_alignment(coder, list(texts.values()))))


def test_alignment_keeps_null_and_repeated_ids_and_ignores_other_columns(spark):
    docs = docs_of(spark, ["a b", "a b", None], ids=[None, 7, 7]).withColumns({"chunk": F.lit("x"), "key": F.lit(1)})
    assert sorted((x["doc_id"] or -1, x["n_groups"]) for x in alignment.align(docs, A, B).collect()) == [(-1, 2), (7, 0), (7, 2)]
    assert alignment.align(docs.limit(0), A, B).count() == 0


# --- Merkle manifest


def leaf_of(row):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hashlib.sha256("".join(value(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")).encode()).hexdigest()


def tree(leaves, arity):
    """Root, and for each leaf the siblings level by level as (left, right)."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for x, i in enumerate(at):
            run = i - i % arity
            proofs[x].append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
            at[x] = i // arity
        level = [hashlib.sha256("".join(level[i : i + arity]).encode()).hexdigest() for i in range(0, len(level), arity)]
    return level[0], proofs


@given(st.integers(1, 90), st.integers(2, 4), st.integers(1, 3))
@settings(max_examples=120, deadline=None)
def test_traversal_emits_all_paths(n, arity, step):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    height = merkle._levels(n, arity, 99)
    root, paths = merkle.authentication_paths(leaves, height, arity, step)
    assert (root, [list(p) for p in paths]) == tree(leaves, arity)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_brute_force(spark, levels):
    r = random.Random(levels)
    texts = [None, "", "x" * 100_000] + [f"text\n{i} ü" for i in range(120)] + ["twice"] * 4
    sources = [r.choice([None, "a", "a", "a", "b", "ä"]) for _ in texts[:-1]] + ["lone"]
    ids = list(range(len(texts)))
    ids[5], ids[9], ids[-2] = None, None, ids[-3]
    sources[-2] = sources[-3]
    docs = docs_of(spark, texts, sources, ids).withColumns({"lang": F.lit("en"), "node": F.lit(1), "block": F.lit("b"), "note": F.col("text")})
    got = merkle.manifest(docs.repartition(5), keep=["note"], levels=levels, step=1)
    got = got.withColumns({"again": merkle.folded(F.col("leaf"), F.col("proof")), "sha": merkle.proof_digest(F.col("proof"))}).collect()
    rows = [x.asDict() for x in docs.collect()]
    by_source = defaultdict(list)
    for x in rows:
        by_source[x["source"]].append((x["doc_id"] is not None, x["doc_id"] or 0, leaf_of(x)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])], 3) for s in order}
    root, above = tree([trees[s][0] for s in order], 3)
    want = Counter()
    for s, over in zip(order, above):
        for (_, doc, leaf), proof in zip(sorted(by_source[s]), trees[s][1]):
            want[doc, s, leaf, trees[s][0], root, hashlib.sha256("".join(left + right for left, right in proof + over).encode()).hexdigest()] += 1
    assert Counter((x["doc_id"] or 0, x["source"], x["leaf"], x["subroot"], x["root"], x["sha"]) for x in got) == want
    assert all(x["again"] == root for x in got)
    assert {(x["doc_id"], x["note"]) for x in got} == {(x["doc_id"], x["text"]) for x in rows}


def test_manifest_of_nothing_and_of_one_row(spark):
    docs = docs_of(spark, ["a"])
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []


def test_manifest_has_a_row_for_each_of_many_sources(spark):
    docs = docs_of(spark, [str(i) for i in range(200)], [f"s{i:03d}" for i in range(200)])
    got = merkle.manifest(docs, levels=2).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == 200 and len({x["root"] for x in got}) == 1 and all(x["again"] == x["root"] for x in got)


def test_tampering_is_found_where_it_changes_a_text(spark):
    sf = "/root/testdata/sf0.001"
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_merkle(spark, sf).collect()
    assert len(rows) == len(texts)
    for x in rows:
        changed = zlib.crc32(str(x["doc_id"]).encode()) % 2 == 0 and "\n" in (texts[x["doc_id"]] or "")
        assert x["verified"] == (not changed)


# --- quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def divergence(p, q):
    mid = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, mid) if a > 0)
    return (part(p) + part(q)) / 2


def classes(text):
    visible = re.sub(r"[\x20\x09-\x0D]", "", text)
    upper = sum(c.isupper() and c.isalpha() for c in visible)
    letter = sum(c.isalpha() for c in visible) - upper
    digit, symbols = sum("0" <= c <= "9" for c in visible), sum(c in "#*$%&|<>" for c in visible)
    return [upper, letter, digit, symbols, len(visible) - upper - letter - digit - symbols]


def brute_rules(rows):
    """{doc_id: (counts, failed, word_js, word_noise, char_js, kept)} of (doc_id, text, lang)."""
    words, chars, out = defaultdict(Counter), defaultdict(lambda: [0] * 5), {}
    for _, text, lang in rows:
        words[lang or ""].update(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()))
        if not brute_counts(text)[5]:
            chars[lang or ""] = [a + b for a, b in zip(chars[lang or ""], classes(text))]
    for doc, text, lang in rows:
        *counts, failed = brute_counts(text)
        count, n, js, noise, char_js = words[lang or ""], counts[0], None, None, None
        if n:
            top = [w for w, c in count.items() if sum(x >= c for x in count.values()) <= rules.COMMON]
            total = sum(count.values())
            q = [count[w] / total for w in top]
            q.append(1 - sum(q))
            own = Counter(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))
            p = [own[w] / n for w in top]
            js, noise = divergence([*p, 1 - sum(p)], q), sum(min(x / 2, 1 / (8 * n * math.log(2))) for x in q)
            if sum(chars[lang or ""]):
                mine = classes(text)
                char_js = divergence([x / sum(mine) for x in mine], [x / sum(chars[lang or ""]) for x in chars[lang or ""]])
        bad = (n >= 50 and js - noise > rules.WORD_EXCESS) or (counts[1] >= 300 and char_js is not None and char_js > rules.CHAR_DISTANCE**2)
        out[doc] = (*counts, failed, js, noise, char_js, not failed and not bad)
    return out


def assert_rules(got, rows):
    want = brute_rules(rows)
    assert len(got) == len(rows)
    for x in got:
        w = want[x["doc_id"]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"]) == (*w[:6], w[9]), x["doc_id"]
        assert (x["word_js"], x["word_noise"], x["char_js"]) == pytest.approx(w[6:9], abs=1e-9)


def test_rules_equal_brute_force_on_odd_texts(spark):
    r = random.Random(8)
    prose = [" ".join(r.choice("the of and to in cat dog ran fast home by sea river".split()) + r.choice(["", "", ".", str(r.randrange(400))]) for _ in range(r.randrange(5, 300))) for _ in range(60)]
    texts = ODD + prose + ["The " * 80, "\n".join(["same line again here"] * 4), "a b c d e f a b c d e", "a b c d e a b c d e b c d e a", "$$$ ### %%% " * 40, "\n\n \n", "ÀÉ ßÜ " * 70 + "x1 " * 9]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"k0": F.lit("x"), "_lang": F.lit(1), "n_words": F.lit("y")})
    assert_rules(rules.quality_rules(docs.repartition(3)).collect(), rows)


def test_rules_of_a_table_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = rules.quality_rules(docs).cache()
    sampled = got.where("doc_id % 29 = 0").collect()
    every = [(x["doc_id"], x["text"], x["lang"]) for x in docs.select("doc_id", "text", "lang").collect()]
    want = {k: v for k, v in brute_rules_fast(every).items() if k % 29 == 0}
    for x in sampled:
        assert x["word_js"] == pytest.approx(want[x["doc_id"]], abs=1e-9)
    judged = got.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {x["quality"]: x["kept"] for x in judged}
    assert share[1] >= 0.99 and share[0] <= 0.35


def brute_rules_fast(rows):
    """{doc_id: word_js}, with the common words of each language found once."""
    words = defaultdict(Counter)
    for _, text, lang in rows:
        words[lang or ""].update(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()))
    shares = {}
    for lang, count in words.items():
        sizes, above, least = Counter(count.values()), 0, None
        for c in sorted(sizes, reverse=True):
            above += sizes[c]
            if above > rules.COMMON:
                break
            least = c
        top = [w for w, c in count.items() if least is not None and c >= least]
        q = [count[w] / sum(count.values()) for w in top]
        shares[lang] = (top, [*q, 1 - sum(q)])
    out = {}
    for doc, text, lang in rows:
        own = Counter(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()))
        n = sum(own.values())
        if n:
            p = [own[w] / n for w in shares[lang or ""][0]]
            out[doc] = divergence([*p, 1 - sum(p)], shares[lang or ""][1])
    return out


def test_rules_repeat_for_repeated_rows_and_bear_nothing(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, "en"), (3, text, "en"), (3, text, "en"), (4, None, None)], "doc_id long, text string, lang string")
    got = rules.quality_rules(docs).collect()
    assert len(got) == 4
    assert len({(x["n_words"], round(x["word_js"], 9), x["kept"]) for x in got if x["n_words"]}) == 1
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_rules_run_no_python(spark):
    plan = rules.quality_rules(docs_of(spark, ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
