"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, map_rows, text_chunks

#: In the order in which results list them. The first four are the base kinds; the others are added by the method.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: A span counts where its score reaches this. No context takes a base kind below it.
LEAST = 0.7
#: Characters on either side of a span in which context words count.
NEAR = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: The length that a country's IBANs have, by the registry.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTH = {country: n for n, all_ in _LENGTHS.items() for country in all_.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Keys and tokens in hexadecimal, of the lengths that generators give.
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
#: Words that raise the score of a kind, and words that lower it.
RAISE = {
    "email": ("email", "mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"), "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("token", "secret", "key", "apikey", "password", "credential", "bearer"),
}
LOWER = ("order", "invoice", "part", "isbn", "version", "serial", "sku", "commit", "checksum", "sha", "md5", "hash")
START = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.5, "secret": 0.5}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From each @ leftwards: a plain search would try every start of a long run of letters.
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, *run.span()))
        for i in range(0, len(parts) - 3, 4):
            # Leading zeros don't count; the length is tested first as int() is slow on very long runs.
            if all(len(d := p.group().lstrip("0")) <= 3 and int(d or 0) <= 255 for p in parts[i : i + 4]):
                yield parts[i].start(), parts[i + 3].end()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield m.span()


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN of a proposed span ends: words and numbers after it may be in the span.

    The country's registered length goes first, then the whole span; if the country has none, each shorter one that
    ends at a space, the longest first. The checksum decides.
    """
    ends = [end, *(i for i in range(end - 1, start, -1) if text[i] == " ")]
    if n := IBAN_LENGTH.get(text[start : start + 2]):
        ends = [*(e for e in ends if e - start - text.count(" ", start, e) == n), end]
    return next((e for e in ends if _IBAN.fullmatch(text, start, e) and mod97(text[start:e])), None)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = _IBAN.search(text)
    while m:
        end = _iban_end(text, *m.span())
        if end:
            yield m.start(), end
        # What a failed span holds may start an IBAN; a span has at most 43 characters.
        m = _IBAN.search(text, end or m.start() + 1)


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield m.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        found = set(m.group())
        # Drawn at random, both digits and letters come, and many of the sixteen.
        if len(found) >= 8 and _DIGIT.search(m.group()) and not m.group().isdigit():
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns, "secret": _secrets}


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = set(re.findall(r"[a-z]+", text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()))
    score = START[kind] + 0.3 * bool(near & {*RAISE[kind]}) - 0.3 * bool(near & {*LOWER})
    return min(1.0, max(LEAST if kind in BASE else 0.0, score))


def find(text: str | None) -> list[Span]:
    """Spans of a whole text by kind as in KINDS, then by start; code points, end exclusive. A null text has none."""
    if not text:
        return []
    out = []
    some = _DIGIT.search(text) is not None
    for kind in KINDS if some else ("email",):
        for start, end in _FIND[kind](text):
            if (score := _score(text, kind, start, end)) >= LEAST:
                out.append(Span(kind, start, end, score))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one, named by the first kind."""
    out, at = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind))):
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, score) of every whole text, one row for each row of ``docs``.

    Null and empty texts have no spans. Ids may be null or repeat. An empty table gives no rows; other columns aren't read.
    Every pattern is linear in the text, whatever its runs of letters or digits, and texts go through in chunks
    of bounded size.
    """
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("spans", T.ArrayType(_SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for part, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[s._asdict() for s in find(t)] for t in texts], kind)], ["doc_id", "spans"])

    return slim.mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans of each text replaced; ``n_chars``, where there is such a column, follows. Null texts stay null."""
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches, name, where):
        for part, texts in text_chunks(batches, name):
            old = part.column(where)
            found = [find(t) for t in texts]
            new = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            arrays = list(part.columns)
            valid = old.is_valid().to_pylist()
            arrays[where] = pa.array([t if v else None for t, v in zip(new, valid, strict=True)], old.type)
            if count is not None:
                before = part.column(count).to_pylist()
                arrays[count] = pa.array([len(t) if s else n for t, s, n in zip(new, found, before, strict=True)], part.column(count).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return map_rows(docs, run, text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = lambda kinds: F.concat_ws(",", F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(texts(BASE).cast("binary"), 256).alias("base_sha256"), texts(KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
