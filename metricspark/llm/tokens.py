"""Token counts by section, from one encoding of the whole document.

A text is encoded once.  Its tokens' character spans follow from the byte lengths of the vocabulary,
and are joined with the sections' character intervals by binary search in the task that holds the
document.  Sections are the lines of the text with their line ends, so they tile it.  A token that
crosses a boundary is given to a section by an explicit rule:

* ``first``: the section of its first character (the default);
* ``last``: the section of its last character;
* ``majority``: the section with most of its characters, the first of equals;
* ``split``: to every section by its share of the token's characters.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

RULES = ("first", "last", "majority", "split")
#: Longer runs of white space are cut out of a text before it is encoded: the public pattern tries every
#: length of such a run in turn, and the encoder's stack does not hold a million tries.
LONG_RUN = 50_000
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def default_ranks() -> str:
    """Path of the public byte-level vocabulary on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    """A byte-level vocabulary read on the driver; the encoder itself is built in each worker."""

    def __init__(self, ranks_file: str, pattern: str | None = None):
        self.public = pattern is None
        if pattern is None:
            import public_tokenizers
            pattern = public_tokenizers.PATTERN
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self._encoder = None

    def __getstate__(self):
        return self.__dict__ | {"_encoder": None}

    def encode(self, x: str) -> list[int]:
        """The ids of the whole text.

        Under the public pattern a run of white space is one piece, but for its last character if something
        follows: that one goes with what follows.  So a long run is merged as a piece of its own, and the
        ids are those of the text encoded at once.  With another pattern nothing is cut."""
        out, at = [], 0
        for run in _LONG.finditer(x) if self.public else ():
            end = run.end() - (run.end() < len(x))
            out += self._encoder.encode_ordinary(x[at:run.start()])
            out += self._encoder._encode_single_piece(x[run.start():end].encode())
            at = end
        return out + self._encoder.encode_ordinary(x[at:])

    def spans(self, x: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last (inclusive) character of every token of the text."""
        if self._encoder is None:
            import tiktoken
            self._encoder = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        ids = np.array(self.encode(x), np.int64)
        ends = np.cumsum(self.sizes[ids])
        raw = np.frombuffer(x.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[ends - self.sizes[ids]], char[ends - 1]


def line_starts(x: str) -> np.ndarray:
    """First character of every line; a line end belongs to the line before it."""
    cps = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.flatnonzero(cps == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(cps) else starts


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Tokens of each section [starts[k], starts[k + 1]) of a text of ``size`` characters."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    out = np.zeros(len(starts))
    if rule == "first":
        np.add.at(out, a, 1)
    elif rule == "last":
        np.add.at(out, b, 1)
    else:
        np.add.at(out, a[a == b], 1)
        ends = np.append(starts[1:], size)
        for k in np.flatnonzero(a != b):
            own = np.arange(a[k], b[k] + 1)
            part = np.minimum(ends[own], last[k] + 1) - np.maximum(starts[own], first[k])
            if rule == "split":
                out[own] += part / part.sum()
            else:
                out[own[part.argmax()]] += 1
    return out


def by_section(docs: DataFrame, rule: str = "first", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per section of every row of ``docs``: ``doc_id``, ``section`` (from 0), ``start`` and ``end``
    in characters, ``n_tokens`` (a whole number but for the rule ``split``) and the document's ``doc_tokens``.

    A missing or empty text has one section without tokens; missing ids stay missing; repeated rows
    each get their rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    spark = docs.sparkSession
    T.prepared(spark)
    shared = spark.sparkContext.broadcast(Tokenizer(ranks_file or default_ranks(), pattern))

    def run(batches):
        tokenizer = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = b.column("doc_id").to_pylist()
            for lo, hi in T.groups(texts):
                cols = [[], [], [], [], [], []]
                for i in range(lo, hi):
                    x = texts[i] or ""
                    first, last = tokenizer.spans(x) if x else (np.empty(0, np.int64),) * 2
                    starts = line_starts(x)
                    n = len(starts)
                    for c, v in zip(cols, (np.full(n, i), np.arange(n), starts, np.append(starts[1:], len(x)),
                                           allocate(first, last, starts, len(x), rule), np.full(n, len(first)))):
                        c.append(v)
                row, section, start, end, tokens, total = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(pa.array(row)), pa.array(section, pa.int64()),
                     pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.float64()),
                     pa.array(total, pa.int64())],
                    names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    return T.doc_columns(docs).mapInArrow(
        run, "doc_id long, section long, start long, end long, n_tokens double, doc_tokens long")
