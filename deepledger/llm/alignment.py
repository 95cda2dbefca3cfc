"""Alignment of two tokenizers over the same bytes: groups between common token ends, interned, and links counted on the distinct ones."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deepledger.llm.common import cut, join_counted, scratch, slices

#: One blank between two visible ASCII characters. A token of either kind ends before it, so that text can be coded in segments.
_BREAK = re.compile(r"(?<=[!-~]) (?=[!-~])")
_PLAIN = re.compile(r"[!-~](.*[!-~])?", re.DOTALL)
#: Characters of the segments that a task remembers, how many it remembers, and characters of the segments coded in one call.
SHORT, KEPT, RUN = 64, 400_000, 1 << 16
#: ASCII and Latin letters, of which all libraries know the same classes.
_LATIN = re.compile("[\x00-\x7f\xc0-\u024f]*")
#: Fixed value: the pattern of byte-level tokens.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CODERS: dict[tuple[str, str], Coders] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Coders:
    """Tokenizer A (a byte-level `tokenizers` file) and B (a `sentencepiece` model), and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in every], np.int64) for every in (self.a_bytes, self.b_bytes))
        # a text may be coded in segments if B's pieces hold no blank after another character and B changes no blanks, and A starts a token at such a blank
        byte_level = json.loads(self.a.to_str())
        ordinary = byte_level["normalizer"] is None and (byte_level["pre_tokenizer"] or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        self.splits = ordinary and not any(re.search("[^▁]▁", p) for p in pieces) and self.b.normalize("a  b ") == "▁a▁▁b▁"
        self.ranks = self._ranked(byte_level["model"]) if ordinary else None
        self.a_text, self.b_text = ([str(i) for i in range(len(every))] for every in (self.a_bytes, self.b_bytes))
        self.known: dict[str, tuple | None] = {}

    def _ranked(self, model: dict):
        """A faster coder of the same vocabulary, if its ids are the ranks of its merges; for Latin text only, where both cut words alike."""
        import tiktoken

        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocabulary = model["vocab"]
        if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merged)) or any(len(x) > 1 for x in self.a_bytes[:256]):
            return None
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in range(256 + len(merged))}, special_tokens={})

    def segments(self, text: str) -> list[str]:
        return _BREAK.split(text) if self.splits else [text]

    def a_ids(self, text: str) -> list[int]:
        if self.ranks is not None and _LATIN.fullmatch(text):
            return self.ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _cut(self, segments: list[str]) -> list[tuple | None]:
        """For each segment (n_a, n_b, text of its groups), or None if it has no tokens. Several: plain ones only."""
        text = " ".join(segments)
        a, b, raw = self.a_ids(" " + text), self.b.encode(text), b" " + text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return [None] if len(segments) == 1 else [x for s in segments for x in self._cut([s])]
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(a_ends, b_ends)
        a_at, b_at = ([0, *np.searchsorted(ends, both, "right").tolist()] for ends in (a_ends, b_ends))
        a, b = [self.a_text[i] for i in a], [self.b_text[i] for i in b]
        groups = [",".join(a[i:j]) + "|" + ",".join(b[k:n]) for i, j, k, n in zip(a_at, a_at[1:], b_at, b_at[1:])]
        ends = (np.searchsorted(both, np.cumsum([len(s.encode()) + 1 for s in segments])) + 1).tolist()
        return [(a_at[j] - a_at[i], b_at[j] - b_at[i], ";".join(groups[i:j])) for i, j in zip([0, *ends], ends)]

    def groups(self, segments: list[str]) -> list[tuple | None]:
        """`_cut` of distinct segments; plain ones that are not yet known are coded many at a time."""
        if len(self.known) > KEPT:
            self.known.clear()
        runs, size, long = {True: [[]], False: [[]]}, {True: 0, False: 0}, {}
        for s in segments:
            if s in self.known:
                continue
            if len(s) > SHORT or not _PLAIN.fullmatch(s):
                long[s] = self._cut([s])[0]
                continue
            latin = _LATIN.fullmatch(s) is not None
            runs[latin][-1].append(s)
            size[latin] += len(s)
            if size[latin] > RUN:
                runs[latin].append([])
                size[latin] = 0
        for run in (r for every in runs.values() for r in every if r):
            self.known.update(zip(run, self._cut(run)))
        return [long[s] if s in long else self.known[s] for s in segments]

    def links(self, group: str) -> list[tuple[int, int]]:
        """The pairs of an A and a B token of a group that end at the same byte."""
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        if len(a) == len(b) == 1:
            return [(a[0], b[0])]
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        low, high = (np.searchsorted(b_ends, a_ends, side).tolist() for side in ("left", "right"))
        return [(a[i], b[j]) for i in range(len(a)) for j in range(low[i], high[i])]


def coders(a_path: str, b_path: str) -> Coders:
    if (a_path, b_path) not in _CODERS:
        _CODERS[a_path, b_path] = Coders(a_path, b_path)
    return _CODERS[a_path, b_path]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold the largest; their width comes first."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([values.itemsize]) + values.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


_ROW = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, own binary, times binary, number long, key string, n long, docs long"


def _repeated(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges given by their starts and sizes, end to end: the range of each place, and the place."""
    owner = np.repeat(np.arange(len(at)), sizes)
    return owner, at[owner] + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


def _chunk(coder: Coders, texts: list[str | None]) -> tuple[list[tuple], list[str], np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, text, own groups, times of each) of each text, and the chunk's distinct groups with their occurrences and documents."""
    segmented = [coder.segments(t) if t else [] for t in texts]
    index = {s: i for i, s in enumerate(dict.fromkeys(s for segments in segmented for s in segments))}
    known = coder.groups(list(index))
    numbers: dict[str, int] = {}
    own, sizes = [], []
    for x in known:
        groups = x[2].split(";") if x else []
        own.extend([numbers.setdefault(g, len(numbers)) for g in groups])
        sizes.append(len(groups))
    own, sizes = np.array(own, np.int64), np.array(sizes, np.int64)
    counts, bad = np.array([x[:2] if x else (0, 0) for x in known], np.int64).reshape(-1, 2), np.array([x is None for x in known], bool)
    places = [np.array([index[s] for s in segments], np.int64) for segments in segmented]
    good = np.array([len(p) > 0 and not bad[p].any() for p in places], bool)
    lengths = np.array([len(p) if ok else 0 for p, ok in zip(places, good)], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *[p for p, ok in zip(places, good) if ok]])
    # distinct segments of each text, then its distinct groups
    pairs, times = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(index) + flat, return_counts=True)
    doc, segment = pairs // max(1, len(index)), pairs % max(1, len(index))
    owner, place = _repeated((np.cumsum(sizes) - sizes)[segment], sizes[segment])
    pairs, back = np.unique(doc[owner] * max(1, len(numbers)) + own[place], return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, back, times[owner])
    group, of = pairs % max(1, len(numbers)), pairs // max(1, len(numbers))
    totals = np.zeros((len(texts), 3), np.int64)
    np.add.at(totals, doc, np.concatenate([counts, sizes[:, None]], axis=1)[segment] * times[:, None])
    borders, out = np.searchsorted(of, np.arange(len(texts) + 1)).tolist(), []
    for i, p in enumerate(places):
        text = ";".join([known[k][2] for k in p.tolist()]) if good[i] else ""
        out.append((*totals[i].tolist(), text, group[borders[i] : borders[i + 1]], n[borders[i] : borders[i + 1]]))
    every, held = np.zeros((2, len(numbers)), np.int64)
    np.add.at(every, group, n)
    np.add.at(held, group, 1)
    return out, list(numbers), every, held


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Tokens of both kinds of every row of docs (doc_id, text), by chunks of about a megabyte of text; written once, read again.

    Rows of documents: chunk, doc_id, n_a, n_b, n_groups, groups_sha256, groups (the text of the groups, only if kept), own and
    times: the numbers of its distinct groups in the chunk and how often each occurs. Rows of distinct groups: chunk, number, key
    (its A ids and B ids as text), n (occurrences) and docs (documents that hold it).
    """
    names = [f.split()[0] for f in _ROW.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, chunk = coders(a_path, b_path), TaskContext.get().partitionId() << 32
        types = dict(zip(names, [pa.int64()] * 5 + [pa.string(), pa.large_string(), pa.large_binary(), pa.large_binary(), pa.int64(), pa.large_string(), pa.int64(), pa.int64()]))

        def rows(size: int, **columns: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()], names=names)

        for batch in batches:
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                found, groups, n, held = _chunk(coder, part["text"].to_pylist())
                texts = [x[3] for x in found]
                hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                own, times = ([_packed(x[i]) for x in found] for i in (4, 5))
                counts = {c: [x[i] for x in found] for i, c in enumerate(("n_a", "n_b", "n_groups"))}
                kept = {"groups": texts} if keep_groups else {}
                yield rows(len(found), chunk=[chunk] * len(found), doc_id=part["doc_id"].to_pylist(), groups_sha256=hashes, own=own, times=times, **counts, **kept)
                if groups:
                    yield rows(len(n), chunk=[chunk] * len(n), number=range(len(n)), key=groups, n=n, docs=held)
                chunk += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _ROW)
    rows.write.parquet(path := scratch(docs.sparkSession, "alignment"))
    return docs.sparkSession.read.schema(_ROW).parquet(path)


def dictionary_links(groups: DataFrame, a_path: str, b_path: str, by: str = "n") -> DataFrame:
    """(key, a, b, times): the links of each distinct group, expanded once, and its weight: n (occurrences) or docs (documents)."""
    names = ["key", "a", "b", "times"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(a_path, b_path)
        for batch in batches:
            rows = [(k, a, b, t) for k, t in zip(batch["key"].to_pylist(), batch["times"].to_pylist()) for a, b in coder.links(k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.large_string(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    distinct = groups.where("key is not null").groupBy("key").agg(F.sum(by).alias("times"))
    return distinct.mapInArrow(expand, "key string, a long, b long, times long")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold an id pair, and whether no other A id is linked with that B id more often."""
    pairs = links.groupBy("a", "b").agg(F.sum("times").alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    return join_counted(pairs, most, ["b"], "inner").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, by: str = "n", keep_groups: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    A (a byte-level `tokenizers` file) codes a blank and the text, B (a `sentencepiece` model) the text; the strings of special
    tokens are plain text. Places where tokens of both end cut the text into groups; A and B tokens that end together are linked.
    A pair's count is the number of links that hold it (by="n"), or that number with each group counted once a document
    (by="docs"). n_best: links whose count is the highest of their B id; count_sum: the sum over links.

    Each task interns the groups of its chunks of text. Distinct groups are summed over the chunks, their links expanded once
    each, and results come back to the chunks by group, so that what is shuffled is one row for a group of a chunk, however often
    it occurs. Text is coded in segments between single blanks, each distinct one once, where the vocabularies allow it.

    Null and empty texts, and texts whose tokens' bytes are not a blank and the text: zeros and empty strings. Repeated rows count
    each; a null doc_id is kept. Very long texts are a chunk by themselves. Other columns are left out. No rows: no rows.
    """
    groups = aligned_groups(docs, a_path, b_path, keep_groups)
    links = cut(dictionary_links(groups, a_path, b_path, by))
    pairs = pair_counts(links)
    scores = join_counted(links, pairs, ["a", "b"], "inner").groupBy("key").agg(F.count("*").alias("links"), F.count_if("best").alias("best"), F.sum("count").alias("total"))
    # a key has one row in a chunk at most; adaptive execution splits the partition of a key that nearly all chunks hold
    back = groups.where("key is not null").select("chunk", "number", "key").join(scores, "key").select(F.col("chunk").alias("part"), "number", "links", "best", "total")
    rows = groups.where("own is not null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "own", "times")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["number"].to_numpy())
        table = np.stack([right[c].to_numpy()[order] for c in ("links", "best", "total")]).astype(np.int64)
        sums = [table[:, _unpacked(own)] @ _unpacked(times) for own, times in zip(left["own"].to_pylist(), left["times"].to_pylist())]
        sums = np.array(sums, np.int64).reshape(-1, 3)
        out = left.select(["doc_id", "n_a", "n_b", "n_groups"])
        for i, c in enumerate(("n_links", "n_best", "count_sum")):
            out = out.append_column(c, pa.array(sums[:, i]))
        return out.append_column("groups_sha256", left["groups_sha256"]).append_column("groups", left["groups"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    return rows.groupBy("chunk").cogroup(back.groupBy("part")).applyInArrow(finish, schema)
