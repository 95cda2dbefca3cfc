"""Personal data: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of kinds.
EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds that the method adds to the base.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score without context, and words near a span that raise it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "credit", "payment"},
    "phone": {"phone", "call", "tel", "mobile", "contact"},
    "iban": {"iban", "bank", "account", "transfer"},
    "ssn": {"ssn", "social", "security"},
}
NEAR, BONUS = 40, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 check of an account number: moved, letters as 10 to 35, remainder 1."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_HEAD.match(text, start - 1):
            start -= 1
        m = EMAIL_TAIL.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the confirmed base spans."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        # a part of many digits cannot be at most 255, unless all but its end are zeros
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return out


def added_spans(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "iban") for m in IBAN.finditer(text) if mod97(m[0])] + [(*m.span(), "ssn") for m in SSN.finditer(text)]


def find_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, kind, score, base) by start, then kind as listed. Added spans need a score of at least `threshold`."""
    out = []
    for spans, base in ((base_spans(text), True), (added_spans(text), False)):
        for a, b, kind in spans:
            near = {w.lower() for w in re.findall(r"[A-Za-z]+", text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR])}
            score = min(1.0, SCORE[kind] + BONUS * bool(near & CONTEXT[kind]))
            if base or score >= threshold:
                out.append((a, b, kind, score, base))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("base", pa.bool_())])


def redacted(text: str, spans: list) -> str:
    """The text with every span, overlapping ones joined, replaced by the first's kind in brackets."""
    parts, done, at = [], 0, 0
    for a, b, kind, *_ in spans:
        if a >= done:
            parts += (text[at:a], f"[{kind.upper()}]")
            at = b
        done = at = max(done, b)
    return "".join((*parts, text[at:]))


def detect_pii(docs: DataFrame, threshold: float = 0.5, redact: bool = True) -> DataFrame:
    """docs and two columns: pii_spans (start, end, kind, score, base; code points, end exclusive) and pii_text, the redacted text.

    Whole texts are searched. Null text: no spans, null pii_text. Repeated rows each get theirs; other columns, nulls in them
    included, pass through; columns of the two names are replaced. redact=False leaves pii_text out. No rows: no rows.
    """
    docs = docs.drop("pii_spans", "pii_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [find_spans(t, threshold) if t else [] for t in texts]
            spans = pa.array([[dict(zip(("start", "end", "kind", "score", "base"), x)) for x in f] for f in found], pa.list_(SPAN))
            new = {"pii_spans": spans}
            if redact:
                new["pii_text"] = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])

    schema = docs.schema
    extra = "pii_spans array<struct<start:long,end:long,kind:string,score:double,base:boolean>>" + (", pii_text string" if redact else "")
    from pyspark.sql.types import StructType

    return docs.mapInArrow(work, StructType(schema.fields + StructType.fromDDL(extra).fields))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans per document, from the columns of `detect_pii`."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii_spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
