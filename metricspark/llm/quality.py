"""Quality rules as a short-circuit cascade.

Every rule is a predicate over counts of a document, and a count is taken only when a rule asks for it.  A
bounded sample measures each rule's rejection rate and its cost, its own counts included; the rules then
run in descending order of rejection per cost, and a document leaves at the first rule that rejects it,
before the counts of later rules are taken.  The order changes only the work, never the verdict: a
document is rejected when any rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Rows that the order of the cascade is estimated on, of at most SAMPLE_BYTES each (they are read by the
#: driver).  The sample never affects a verdict.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 50_000

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_LETTER_BYTES = bytes(b for b in range(256) if b > 127 or chr(b).isalpha())


@dataclass
class Doc:
    """One document; ``codes`` are the hashes of its words.  All other counts are taken when asked for."""

    text: str
    codes: np.ndarray

    @property
    def n_words(self) -> int:
        return len(self.codes)

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw) + len(self.raw.translate(None, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [s for s in self.raw.split(b"\n") if s.strip(_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return _repeat_words(self.codes)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def _symbols(d: Doc) -> bool:
    """More than one symbol per ten words."""
    return 10 * d.n_symbols > d.n_words


def _capitals(d: Doc) -> bool:
    """More than half of the words are in capitals."""
    return 2 * sum(map(str.isupper, d.text.split())) > d.n_words


def _exclaims(d: Doc) -> bool:
    """More than one exclamation or question mark per five words."""
    return 5 * (d.text.count("!") + d.text.count("?")) > d.n_words


def _word_length(d: Doc) -> bool:
    """Mean word length under 2 or over 20."""
    return d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words


def _dup_lines(d: Doc) -> bool:
    """More than half of the lines with a word repeat an earlier one."""
    return 2 * d.n_dup_lines > len(d.lines)


def _runs(d: Doc) -> bool:
    """More than a fifth of the words equal the word before."""
    return 5 * int((d.codes[1:] == d.codes[:-1]).sum()) > d.n_words


def _letters(d: Doc) -> bool:
    """Fewer than 60 % of the bytes outside white space belong to letters."""
    dense = d.raw.translate(None, _SPACES)
    return 5 * len(dense.translate(None, _LETTER_BYTES)) > 2 * len(dense)


def _short(d: Doc) -> bool:
    """Fewer than 50 words."""
    return d.n_words < 50


def _repeats(d: Doc) -> bool:
    """More than half of the words lie in a 3-word window that the text holds twice."""
    return 100 * d.n_repeat_words > 50 * d.n_words


#: The two rules of the contract's base verdict.
BASE: tuple[Rule, ...] = (Rule("short", _short), Rule("repeats", _repeats))
RULES: tuple[Rule, ...] = tuple(Rule(f.__name__[1:], f) for f in (
    _symbols, _capitals, _exclaims, _word_length, _dup_lines, _runs, _letters))


def _repeat_words(codes: np.ndarray) -> int:
    """Words that lie in a 3-word window that occurs at least twice."""
    grams = T.ngram_hashes(codes, 3)
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = np.isin(grams, again)
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k:k + len(twice)] |= twice
    return int(covered.sum())


def measured(texts: list[str | None]) -> Iterator[Doc]:
    """Each text with its words' hashes; a missing text counts as an empty one."""
    for lo, hi in T.groups(texts):
        hashes, offsets = T.word_hashes(texts[lo:hi], lower=False)
        for i in range(lo, hi):
            yield Doc(texts[i] or "", hashes[offsets[i - lo]:offsets[i - lo + 1]])


def base_failed(d: Doc) -> bool:
    return any(r.rejects(d) for r in BASE)


def timed(texts: list[str | None], rules: tuple[Rule, ...]) -> list[tuple[int, float]]:
    """Rejections and seconds of each rule, which takes its counts anew."""
    out = []
    for rule in rules:
        docs = list(measured(texts))
        t0 = time.perf_counter()
        hits = sum(rule.rejects(d) for d in docs)
        out.append((hits, time.perf_counter() - t0))
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Base rules and ``rules`` by descending rejection per cost on a sample of at most SAMPLE_ROWS rows,
    which Spark reads partition by partition until there are enough."""
    every = BASE + tuple(rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(text.alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).take(SAMPLE_ROWS)
    gain = [hits / (secs + 1e-9) for hits, secs in timed([r["text"] for r in sample], every)]
    return [every[k] for k in sorted(range(len(every)), key=lambda k: (-gain[k], k))]


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the five counts, ``base_failed`` and ``kept``.

    A missing text counts as empty and fails (fewer than 50 words); missing ids stay missing;
    repeated rows each get their row; an empty table gives an empty result; columns other than
    ``doc_id`` and ``text`` are ignored.  Memory per task: one Arrow batch.
    """
    spark = docs.sparkSession
    T.prepared(spark)
    d = T.doc_columns(docs)
    ranked = cascade(d, rules)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = []
            for x in measured(texts):
                # The report holds every count, so here the cascade saves only the other rules' work.
                rows.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, base_failed(x),
                             not any(r.rejects(x) for r in ranked)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(c, pa.int64()) for c in cols[:5]]
                + [pa.array(c, pa.bool_()) for c in cols[5:]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept"])

    return d.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                             "n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` (all columns) that no rule rejects; memory as in :func:`verdicts`.

    The rows are filtered in the pass that reads them, so no join brings the verdict back.  A missing or empty
    text has fewer than 50 words and goes; repeated rows are judged alike; no column is added or changed.
    """
    spark = docs.sparkSession
    T.prepared(spark)
    ranked = cascade(docs, rules)

    def run(batches):
        for b in batches:
            keep = [not any(r.rejects(x) for r in ranked)
                    for x in measured(b.column("text").cast(pa.string()).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
