"""Personal data with offset-preserving deobfuscation.

Four plain patterns (email, ip, card, phone) are searched in the text as it is.
Where a text shows signs of disguise it also goes through transducers that write
a normalised text and keep, for each of its letters, the stretch of the source it
came from: look-alike letters become ASCII, spelled digits become digits, at/dot
disguises become signs. Identifiers found there are mapped back to source
letters and added if a disguise took part in them and no plain span of the same
kind holds them whole; one that is wider than a plain span stands beside it.

All searches run in time linear in the text, but for a logarithm where a span looks for
the plain one around it. Offsets count code points, ends are exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows and
null or repeated ids are searched row by row; a long text is searched whole, in one
go; an empty table gives an empty result; columns of the input that clash with a
result column are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    added: bool


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Letters that look like an ASCII letter (Cyrillic and Greek), and signs.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "г": "r", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y", "З": "3",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "τ": "t", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "·": ".", "•": ".", " ": " ", " ": " ", " ": " ", "　": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
#: Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Words for the signs.
AT_WORDS, DOT_WORDS = ("at", "arroba", "chez"), ("dot", "punkt", "punto", "point")

_W = "(?:" + "|".join(DIGIT_WORDS) + ")"
_AT, _DOT = "(?:" + "|".join(AT_WORDS) + ")", "(?:" + "|".join(DOT_WORDS) + ")"
_RUN = rf"(?:\bplus[\s-]{{1,3}})?\b{_W}(?:[\s,-]{{1,3}}(?:{_DOT}[\s-]{{1,3}})?{_W}){{3,}}\b"
_BRACKET = rf"[\s_]{{0,3}}[\[({{<][\s_]{{0,3}}(?:{_AT}|{_DOT}|@|\.)[\s_]{{0,3}}[\])}}>][\s_]{{0,3}}"
_SPACED = rf"(?<=[A-Za-z0-9])[\x20\t]{{1,3}}{_AT}[\x20\t]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:[\x20\t]{{1,3}}{_DOT}[\x20\t]{{1,3}}|[\[({{<\x20]{{1,3}}{_DOT}[\])}}>\x20]{{1,3}}|\.)[A-Za-z0-9-])"
_SPACED_DOT = rf"(?<=[A-Za-z0-9])[\x20\t]{{1,3}}{_DOT}[\x20\t]{{1,3}}(?=[A-Za-z0-9])"
_SIGNS = re.compile(rf"(?P<run>{_RUN})|(?P<bracket>{_BRACKET})|(?P<at>{_SPACED})|(?P<dot>{_SPACED_DOT})", re.IGNORECASE)
#: Every match of ``_SIGNS`` holds one of ``_HINT``; an underscore ends a word here.
_END = r"(?![^\W_])"
_HINT = re.compile(rf"{_DOT}{_END}|[\[({{<][\s_]{{0,3}}(?:[@.]|{_AT}{_END})|\b{_W}[\s,-]{{1,3}}(?:{_DOT}[\s-]{{1,3}})?{_W}\b|{_SPACED}", re.IGNORECASE)
_ODD = re.compile("[ª²³¹ºſ ­·ɐ-\U0010ffff]")


def _letter(c: str) -> str:
    """The ASCII look-alike of a letter, by table or compatibility form; itself if there is none."""
    if (to := ALIKE.get(c)) is not None:
        return to
    to = unicodedata.normalize("NFKC", c)
    if to in ALIKE:
        return ALIKE[to]
    if len(to) == 1 and to.isascii():
        return to
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


def normalise(text: str) -> tuple[str, list[int], list[int], list[int]] | None:
    """The normalised text, each letter's source start and end, and the normalised places that a disguise made.

    None if the text shows no sign of disguise.
    """
    odd = _ODD.search(text) is not None
    if not odd and not _HINT.search(text):
        return None
    letters, start, end, made = [], [], [], []

    def put(c: str, a: int, b: int, disguise: bool) -> None:
        if disguise:
            made.append(len(letters))
        letters.append(c)
        start.append(a)
        end.append(b)

    # First transducer: letters.
    for i, c in enumerate(text):
        to = _letter(c) if odd and not c.isascii() else c
        if to:
            put(to, i, i + 1, to != c)
    first, s1, e1, touched = "".join(letters), start, end, set(made)
    if _HINT.search(first) is None:
        return first, s1, e1, sorted(touched)
    # Second transducer: words for signs and digits.
    letters, start, end, made, at = [], [], [], [], 0
    for m in _SIGNS.finditer(first):
        for i in range(at, m.start()):
            put(first[i], s1[i], e1[i], i in touched)
        at = m.end()
        if m.lastgroup == "run":
            for w in re.finditer(rf"plus|{_DOT}|{_W}", m[0], re.IGNORECASE):
                word, a, b = w[0].lower(), m.start() + w.start(), m.start() + w.end() - 1
                put("+" if word == "plus" else DIGIT_WORDS.get(word, "."), s1[a], e1[b], True)
        else:
            sign = "@" if m.lastgroup == "at" or m.lastgroup == "bracket" and re.search(rf"(?<![^\W_]){_AT}{_END}|@", m[0], re.IGNORECASE) else "."
            put(sign, s1[m.start()], e1[m.end() - 1], True)
    for i in range(at, len(first)):
        put(first[i], s1[i], e1[i], i in touched)
    return "".join(letters), start, end, made


def find(text: str) -> list[Span]:
    """All spans of a text, by start, kind and end."""
    base = plain(text)
    out = [Span(*b, added=False) for b in base]
    got = normalise(text)
    if got and got[3]:
        clear, start, end, made = got
        begins, ends = ([[b[i] for b in base if b[1] == kind] for kind in range(len(KINDS))] for i in (0, 2))
        for a, kind, b in plain(clear):
            k = bisect_left(made, a)
            if k == len(made) or made[k] >= b:
                continue
            s, e = start[a], end[b - 1]
            held = bisect_right(begins[kind], s) - 1  # spans of a kind do not overlap: no other one can hold it whole
            if held < 0 or ends[kind][held] < e:
                out.append(Span(s, kind, e, True))
    return sorted(out)


def redact(text: str) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at, k, spans = [], 0, 0, find(text)
    while k < len(spans):
        first, stop = spans[k], spans[k].end
        while k < len(spans) and spans[k].start < stop:  # no span is empty, so this takes the first one too
            stop = max(stop, spans[k].end)
            k += 1
        out += [text[at : first.start], f"[{KINDS[first.kind].upper()}]"]
        at = stop
    return "".join([*out, text[at:]])


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("added", pa.bool_())])


def detect(docs: DataFrame, text: str = "text", redacted: str | None = None) -> DataFrame:
    """``docs`` with ``spans``, array of (start, kind, end, added); with ``redacted``, also the redacted text under that name."""
    own = [c for c in docs.columns if c != "spans" and (c == text or c != redacted)]
    names = [c for c in own if c != redacted] + [redacted] * bool(redacted) + ["spans"]
    shape = F.array().cast("array<struct<start: bigint, kind: string, end: bigint, added: boolean>>").alias("spans")
    schema = docs.select(*[c for c in own if c != redacted], *([F.lit("").alias(redacted)] if redacted else []), shape).schema
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            spans = [[{"start": s.start, "kind": KINDS[s.kind], "end": s.end, "added": s.added} for s in find(t)] for t in texts]
            columns = [batch.column(i) for i, c in enumerate(own) if c != redacted]
            if redacted:
                columns.append(pa.array([redact(t) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(SPAN))], names=names)

    return docs.select(*own).mapInArrow(run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: ~s["added"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    added = F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added")
    return detect(docs).select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"), added)
