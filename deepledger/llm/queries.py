"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.llm import alignment, chat, decontaminate, jaccard, langid, merkle, packing, pii, quality, rules, topk, toxicity, warc
from deepledger.llm.common import scratch, table

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "select -7L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(own))
    return chat.read_back(chat.format_chats(turns, tokenizer_path())).drop("n_tokens", "loss_tokens")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, keep_payload=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.score_quality(table(spark, sf_dir, "documents"), trusted)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.severity(docs, model)
    return scored.select("doc_id", "expected_severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"))  # a row of null doc_id is not held out
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model, spans=False).drop("text")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.detect_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), redact=False))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES)).drop("groups")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = merkle.manifest(docs.withColumn("claim", merkle.digest(*(fields | {"text": tampered}).values())), keep=["claim"])
    root = merkle.folded(F.col("claim"), F.col("proof"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("word_js", "word_noise", "char_js")


_ALL = (op1_decontaminate, op2_chat_format, op3_topk, op4_jaccard_join, op5_warc, op6_quality, op7_toxicity, op8_language_id, op9_pii, op10_packing, op11_token_alignment, op12_merkle, op13_quality_rules)
QUERIES = {f.__name__: f for f in _ALL}

#: Escapes of deepledger.llm.chat, one backslash in each control string.
_SLASHED = r"regexp_replace(regexp_replace({}, '<(\\*(\||/?s>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"

ORACLES = {
    "op1_decontaminate": r"""
        with w as (
            select 'd' as side, doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents where doc_id is not null
            union all select 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') from benchmark where item_id is not null),
        i as (select id, least(len(ws), 5) as width, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 5) - 1], ' '))) as g from w where side = 'i' and len(ws) > 0),
        d as (select id, width, unnest(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(ws[i:i + width - 1], ' '))) as g
            from w, (select distinct width from i) where side = 'd' and len(ws) >= width),
        n as (select id, count(distinct g) as item_shingles from i group by id),
        c as (select d.id as doc_id, i.id as item_id, count(distinct g) as shared from d join i using (width, g) group by all)
        select doc_id, item_id, item_shingles, shared, shared / item_shingles as containment from c join n on n.id = item_id where 100 * shared >= 80 * item_shingles""",
    "op2_chat_format": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
            sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
            cast(sum(length('<|turn|><|say|><|end|>') + length({_SLASHED.format('role')}) + length({_SLASHED.format('text')})) as bigint) as formatted_chars
        from turns group by conv_id""",
    "op3_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as t from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
        s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.t, d.t), lambda z: z[1] * z[2])) as bigint) as score
            from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank", vec_id, score from s)
        select * from r where "rank" <= 20""",
    "op4_jaccard_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        s as (
            select doc_id, case when coalesce(len(ws), 0) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w),
        g as (select doc_id, hash(unnest(s)) as h, len(s) as n from s),
        p as (select a.doc_id as a, b.doc_id as b, a.n + b.n as t, count(*) as c from g a join g b on a.h = b.h and a.doc_id < b.doc_id group by all),
        e as (select a, b from p where 100 * c >= 80 * (t - c) union all select b, a from p where 100 * c >= 80 * (t - c)),
        r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
        select doc_id, len(s) as n_shingles, least(doc_id, coalesce((select min(b) from r where r.a = s.doc_id), doc_id)) as component_id from s""",
    "op5_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> first then first end as refers_to
        from p left join f using (payload_digest)""",
    "op12_merkle": """
        with recursive f as (
            select *, case when crc32_even then replace(text, chr(10), '') else text end as claimed from (
                select *, coalesce((list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::bigint[]), lambda x, k: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end)), 4294967295) & 1) = 1, false) as crc32_even from documents)),
        l as (
            select doc_id, coalesce('=' || source, '') as grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) as claim
            from (select *, concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head from f)),
        r as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as spot from l),
        n as (
            select grp, 0 as h, spot, leaf as node, count(*) over (partition by grp) as total from r
            union all select grp, h + 1, spot // 3, sha256(string_agg(node, '' order by spot)), (any_value(total) + 2) // 3 from n where total > 1 group by grp, h, spot // 3),
        s as (select grp, node as subroot, row_number() over (order by grp) - 1 as spot from n where total = 1),
        m as (
            select 0 as h, spot, subroot as node, count(*) over () as total from s
            union all select h + 1, spot // 3, sha256(string_agg(node, '' order by spot)), (any_value(total) + 2) // 3 from m where total > 1 group by h, spot // 3),
        runs as (select grp, h, spot // 3 as run, list(node order by spot) as nodes from n where total > 1 group by all),
        tops as (select h, spot // 3 as run, list(node order by spot) as nodes from m where total > 1 group by all),
        way as (
            select doc_id, grp, r.spot, h, nodes, r.spot // (3 ** h)::bigint % 3 as pos from r join runs using (grp) where run = r.spot // (3 ** (h + 1))::bigint
            union all select doc_id, grp, r.spot, 1000 + h, nodes, s.spot // (3 ** h)::bigint % 3 from r join s using (grp) join tops on run = s.spot // (3 ** (h + 1))::bigint),
        p as (select grp, spot, list({'l': array_to_string(nodes[:pos], ''), 'r': array_to_string(nodes[pos + 2:], '')} order by h) as proof from way group by grp, spot),
        o as (
            select doc_id, leaf, subroot, (select node from m where total = 1) as root, coalesce(array_to_string(list_transform(proof, lambda x: x.l || x.r), ''), '') as siblings,
                coalesce(list_reduce(list_prepend({'l': claim, 'r': ''}, proof), lambda x, y: {'l': sha256(y.l || x.l || y.r), 'r': ''}).l, claim) as folded_root
            from r join s using (grp) left join p on p.grp = r.grp and p.spot = r.spot)
        select doc_id, leaf, subroot, root, sha256(siblings) as proof_sha256, folded_root, folded_root = root as verified from o""",
    "op13_quality_rules": r"""
        with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        g as (select doc_id, unnest(range(1, len(ws) - 3)) as i, unnest(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4])) as g from d where len(ws) >= 5),
        t as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
        p as (select doc_id, count(distinct i + k) as n from t, range(5) as s(k) group by doc_id),
        c as (
            select d.doc_id, lang, text, ws, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(p.n, 0) as n_repeat_words,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
                length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as upper, length(regexp_replace(text, '[^0-9]+', '', 'g')) as digit,
                length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) - length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as letter
            from d left join p using (doc_id)),
        f as (select *, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, [upper, letter, digit, n_symbols, word_chars - upper - letter - digit - n_symbols] as classes from c),
        chars as (select lang, k, sum(classes[k]) / sum(word_chars) as q from f, range(1, 6) as r(k) where not base_failed group by lang, k),
        char_js as (
            select doc_id, sum((case when x > 0 then x * log2(2 * x / (x + q)) else 0 end + case when q > 0 then q * log2(2 * q / (x + q)) else 0 end) / 2) as js
            from (select doc_id, classes[k] / word_chars as x, q from f join chars using (lang) where word_chars > 0) group by doc_id),
        u as (select doc_id, lang, unnest(list_transform(ws, lambda x: lower(x))) as w from f),
        v as (select lang, w, count(*) as n from u group by all),
        b as (select *, row_number() over (partition by lang order by n desc) as place from v),
        l as (select lang, max(case when place = 51 then n end) as next from b group by lang),
        totals as (select lang, sum(n) as total from v group by lang),
        top as (select lang, w, n / total as q from v join l using (lang) join totals using (lang) where next is null or n > next),
        ref as (select * from top union all select lang, null, 1 - coalesce((select sum(q) from top where top.lang = l.lang), 0) from l),
        x as (select doc_id, u.lang, top.w, count(*) / any_value(n_words) as x from u join f using (doc_id) left join top on top.lang = u.lang and top.w = u.w group by all),
        word_js as (
            select doc_id, sum((case when coalesce(x, 0) > 0 then x * log2(2 * x / (x + q)) else 0 end + case when q > 0 then q * log2(2 * q / (coalesce(x, 0) + q)) else 0 end) / 2) as js, sum(least(q / 2, 1 / (8 * n_words * ln(2)))) as noise
            from (select f.doc_id, f.n_words, q, x from f join ref on ref.lang = f.lang left join x on x.doc_id = f.doc_id and x.w is not distinct from ref.w where n_words > 0) group by doc_id)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not base_failed and not coalesce(n_words >= 50 and word_js.js - noise > 0.08, false) and not coalesce(word_chars >= 300 and char_js.js > 0.35 * 0.35, false) as kept
        from f left join char_js using (doc_id) left join word_js using (doc_id)""",
}
