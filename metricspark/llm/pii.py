"""Personal data: regular expressions propose spans, checksums confirm them, context moves the score.

Four base kinds (email, ip, card, phone) are always reported when their own checks pass.  Further
kinds are reported when their score, after the words nearby have been looked at, reaches THRESHOLD.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "birth")
_RANK = {k: i for i, k in enumerate(KINDS)}

#: Score of a confirmed span, what a context word adds, and the least score of an added kind.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.3, "birth": 0.2}
CONTEXT_GAIN, THRESHOLD = 0.35, 0.5
#: Characters before and after a span in which context words count.
REACH = 48
CONTEXT = {k: re.compile(rf"\b(?:{v})\b", re.IGNORECASE) for k, v in {
    "email": "e-?mail|contact|mailto|address",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|cell|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|tax",
    "birth": "born|birth|birthday|dob",
}.items()}

_MAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])")

# Characters of an account number by country, from the public IBAN registry.
IBAN_LENGTH = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled (less nine above nine); the sum ends in zero."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters go to the end, letters count from ten; the remainder by 97 is one."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(x: str):
    """Leftmost non-overlapping account numbers.  The pattern takes the longest run of tokens, so each token end
    in it is tried: only the one that the country fixes, if it is known, else all from the longest down."""
    m = _IBAN.search(x)
    while m:
        start, run, at = m.start(), m[0], m.start() + 1
        for end in range(len(run), 14, -1):
            if end < len(run) and run[end] != " " or run[end - 1] == " ":
                continue
            n = end - run.count(" ", 0, end)
            if n == IBAN_LENGTH.get(run[:2], n) and mod97(run[:end]):
                at = start + end
                yield start, at
                break
        m = _IBAN.search(x, at)


def _mails(x: str):
    """Leftmost non-overlapping addresses, found from each ``@``: linear in the text."""
    last, at = 0, x.find("@")
    while at >= 0:
        start = at
        while start > last and x[start - 1] in _MAIL_LEFT:
            start -= 1
        m = _MAIL_RIGHT.match(x, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
            at = x.find("@", last)
        else:
            last, at = at + 1, x.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def find(x: str | None) -> list[Span]:
    """All spans of a text by start, then kind; a missing text has none."""
    if not x:
        return []
    found: list[tuple[int, str, int]] = []
    if "@" in x:
        found += [(s, "email", e) for s, e in _mails(x)]
    if _DIGIT.search(x):
        if "." in x:
            found += [(m.start(), "ip", m.end()) for m in _IP.finditer(x) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(x):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), "card", m.end()))
        if "+" in x:
            found += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(x) if 10 <= len(_digits(m[0])) <= 15]
        found += [(s, "iban", e) for s, e in _ibans(x)]
        if "-" in x:
            found += [(m.start(), "ssn", m.end()) for m in _SSN.finditer(x)]
            found += [(m.start(), "birth", m.end()) for m in _BIRTH.finditer(x)]
    out = []
    for start, kind, end in found:
        near = CONTEXT[kind].search(x[max(0, start - REACH):start]) or CONTEXT[kind].search(x[end:end + REACH])
        score = min(1.0, SCORE[kind] + (CONTEXT_GAIN if near else 0.0))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append(Span(start, _RANK[kind], end, score))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(x: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones as one, named after the first) replaced by ``[KIND]``."""
    if not spans:
        return x
    out, at, hole = [], 0, None
    for s in [*spans, None]:
        if s is not None and hole and s.start < hole[1]:
            hole[1] = max(hole[1], s.end)
            continue
        if hole:
            out += [x[at:hole[0]], f"[{hole[2].upper()}]"]
            at = hole[1]
        hole = [s.start, s.end, s.kind] if s is not None else None
    return "".join(out) + x[at:]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, digest of the base spans, all spans and
    their scores (as listed in ``spans``).

    A missing text counts as empty; missing ids stay missing; repeated rows each get their row; other
    columns are ignored.  Every pattern is linear in the text.
    """
    T.prepared(docs.sparkSession)

    def run(batches):
        for b in batches:
            per = [find(x) for x in b.column("text").to_pylist()]
            base = [[s for s in p if s.kind in BASE_KINDS] for p in per]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")]
                + [pa.array([sum(s.rank == k for s in p) for p in base], pa.int64()) for k in range(4)]
                + [pa.array([hashlib.sha256(joined(p).encode()).hexdigest() for p in base], pa.string()),
                   pa.array([joined(p) for p in per], pa.string()),
                   pa.array([[s.score for s in p] for p in per], pa.list_(pa.float64()))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return T.doc_columns(docs).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
             "scores array<double>")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans masked in ``text``; ``n_chars``, if there, counts the new text.  Missing and empty
    texts stay as they are, repeated rows are masked alike, and no other column changes."""
    T.prepared(docs.sparkSession)

    def run(batches):
        for b in batches:
            new = [masked(x, find(x)) for x in b.column("text").to_pylist()]
            for name, col in (("text", new), ("n_chars", [None if x is None else len(x) for x in new])):
                if (k := b.schema.get_field_index(name)) >= 0:
                    kind = b.schema.field(k)
                    b = b.set_column(k, kind, pa.array(col, pa.string() if name == "text" else pa.int64()).cast(kind.type))
            yield b

    return docs.mapInArrow(run, docs.schema)
