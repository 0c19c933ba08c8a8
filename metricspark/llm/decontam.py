"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Words (lower case, punctuation apart) are the symbols.  The CGK embedding walks through a word
sequence with shared random bits: at step j it writes the current word and moves on if the bit of
(j, word) is one, so few edits change few of the embedded places.  In each repetition some places are
sampled; a window of a document whose sampled words equal those of an item is a candidate.  Windows
are walked together and leave at the first sampled place at which no item agrees.  A window is looked
at only if few enough of its words are foreign to all items, which no window within the edit bound
can fail.  Candidates are confirmed by their exact edit distance.  Documents never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Edits (words inserted, left out or replaced) allowed, as a share of an item's words.
MAX_EDITS = 0.2
#: Sampled places and repetitions: at the edit bound about 97 % of the planted windows are found.
PLACES, REPEATS = 6, 24
#: Items whose lengths lie within this ratio share a window size.
CLASS_RATIO = 1.15
#: Items sent to the executors at a time (a pass over the documents each).
ITEMS_PER_PASS = 20_000


def _plain(texts) -> tuple[np.ndarray, np.ndarray]:
    return T.word_hashes([t.lower() if t else t for t in texts], lower=False, table=T.PLAIN)


class Items:
    """Benchmark items as word numbers (from 1), in classes of similar length, with their LSH keys."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        words, offsets = _plain(texts)
        self.vocabulary = np.unique(words)
        self.low_bits = np.zeros(1 << 18, bool)
        self.low_bits[self.vocabulary & np.uint64((1 << 18) - 1)] = True
        codes = (np.searchsorted(self.vocabulary, words) + 1).astype(np.int64)
        # Items go by their place in the list: ids may be missing or repeated.
        self.ids = ids
        all_items = [(i, codes[s:e]) for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:])) if e > s]
        held = np.zeros(len(self.vocabulary) + 1, np.int64)
        for _, c in all_items:
            held[np.unique(c)] += 1
        self.telling = (held > 0) & (held <= 2)
        all_items.sort(key=lambda x: len(x[1]))
        self.classes: list[LengthClass] = []
        while all_items:
            least = len(all_items[0][1])
            n = sum(len(c) <= least * CLASS_RATIO for _, c in all_items)
            self.classes.append(LengthClass(all_items[:n], self.telling, len(self.classes)))
            all_items = all_items[n:]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        # Most words of the documents leave at a table of the hashes' low bits.
        places = np.flatnonzero(self.low_bits[words & np.uint64(len(self.low_bits) - 1)])
        some = words[places]
        at = np.minimum(np.searchsorted(self.vocabulary, some), len(self.vocabulary) - 1)
        out = np.zeros(len(words), np.int64)
        out[places] = np.where(self.vocabulary[at] == some, at + 1, 0)
        return out

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text: place of the item -> (distance, first word, words) of its closest window."""
        out: list[dict] = [{} for _ in texts]
        for lo, hi in T.groups(texts):
            words, offsets = _plain(texts[lo:hi])
            codes = self.codes(words)
            ends = np.repeat(offsets[1:], np.diff(offsets))
            foreign = np.concatenate([[0], np.cumsum(codes == 0)])
            telling = np.concatenate([[0], np.cumsum(self.telling[codes])])
            for c in self.classes:
                for p, k in c.candidates(codes, ends, foreign, telling):
                    item, want = c.items[k]
                    most = c.edits(k)
                    window = codes[p:min(ends[p], p + len(want) + most)]
                    # An edit takes away one of the item's distinct words at most.
                    if len(c.sets[k].intersection(window.tolist())) < len(c.sets[k]) - most:
                        continue
                    got = closest(want, window, most)
                    if got is None:
                        continue
                    row = int(np.searchsorted(offsets, p, "right")) - 1
                    best = (got[0], int(p - offsets[row]), got[1])
                    if item not in out[lo + row] or best < out[lo + row][item]:
                        out[lo + row][item] = best
        return out


class LengthClass:
    """Items of ``size`` words or a little more; windows of ``size`` words stand for all of them."""

    def __init__(self, items, telling: np.ndarray, seed: int):
        self.items = items
        self.sets = [frozenset(c.tolist()) for _, c in items]
        self.size = len(items[0][1])
        self.most_edits = int(MAX_EDITS * len(items[-1][1]))
        rng = np.random.default_rng([11, seed])
        steps = 3 * self.size
        self.places = [np.sort(rng.choice(steps, min(PLACES, steps), replace=False)) for _ in range(REPEATS)]
        self.salts = rng.integers(0, 2**63, (REPEATS, steps // 64 + 1), dtype=np.uint64)
        self.n_words = len(telling) - 1
        self.least_telling = min(int(telling[c[:self.size]].sum()) - self.edits(k) for k, (_, c) in enumerate(items))
        codes = np.concatenate([c[:self.size] for _, c in items])
        starts = np.arange(len(items), dtype=np.int64) * self.size
        self.keys = []
        for r in range(REPEATS):
            partial = self._walk(r, codes, starts, starts + self.size, None)
            self.keys.append(partial)

    def edits(self, k: int) -> int:
        return int(MAX_EDITS * len(self.items[k][1]))

    def _walk(self, r, codes, starts, ends, known):
        """Sampled keys of the windows [start, min(end, start + size)) of ``codes``.

        With ``known`` (the items' keys after each sampled place), windows leave as soon as no item
        agrees, and (rows left, their keys) are returned; without it, the keys after each place.
        """
        rows = np.arange(len(starts))
        ends = np.minimum(ends, starts + self.size)
        at = starts.copy()
        key = np.zeros(len(starts), np.uint64)
        bits, block, after = None, -1, []
        last = self.places[r][-1]
        sampled = set(self.places[r].tolist())
        sure = int((ends - starts).min(initial=self.size))  # a walk is at most one word a step ahead
        for j in range(last + 1):
            if j // 64 != block:
                block = j // 64
                bits = T.mix(np.arange(self.n_words + 1, dtype=np.uint64) ^ self.salts[r, block])
            # Past the end of a window its symbol is 0, as for foreign words.
            symbol = codes[at] if j < sure else np.where(at < ends, codes[np.minimum(at, len(codes) - 1)], 0)
            if j in sampled:
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) + np.uint64(1))
                if known is None:
                    after.append(np.sort(key))
                else:
                    have = known[len(after)]
                    after.append(None)
                    stay = have[np.minimum(np.searchsorted(have, key), len(have) - 1)] == key
                    rows, at, ends, key, symbol = rows[stay], at[stay], ends[stay], key[stay], symbol[stay]
                    if not len(rows):
                        break
            at = at + ((bits >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)[symbol]
        return (after, key) if known is None else (rows, key)

    def candidates(self, codes, ends, foreign, telling):
        """Distinct (window start, item) that agree in some repetition."""
        n, e = len(codes), self.most_edits
        if not n:
            return []
        p = np.arange(n)
        stop = np.minimum(ends, p + self.size)
        starts = np.flatnonzero((stop - p >= self.size - e) & (foreign[stop] - foreign[:n] <= e)
                                & (telling[stop] - telling[:n] >= self.least_telling))
        found = set()
        for r in range(REPEATS):
            if not len(starts):
                break
            after, final = self.keys[r]
            rows, key = self._walk(r, codes, starts, ends[starts], after)
            order = np.argsort(final, kind="stable")
            lo = np.searchsorted(final[order], key, "left")
            hi = np.searchsorted(final[order], key, "right")
            for row, a, b in zip(rows, lo, hi):
                found.update((int(starts[row]), int(k)) for k in order[a:b])
        return sorted(found)


def closest(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edit distance, words used) of the item and the closest prefix of the window, or None above ``most``."""
    n = len(item)
    if len(window) >= n and (window[:n] == item).all():
        return 0, n
    width = len(window)
    row = list(range(width + 1))
    window = window.tolist()
    for i, w in enumerate(item.tolist(), 1):
        lo, hi = max(1, i - most), min(width, i + most)
        new = [most + 1] * (width + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (w != window[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row[max(0, lo - 1):hi + 1], default=most + 1) > most:
            return None
    best = min(range(width + 1), key=lambda j: (row[j], abs(j - n)))
    return (row[best], best) if row[best] <= most else None


def _passes(benchmark: DataFrame):
    """Items in blocks of about ITEMS_PER_PASS."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    parts = b.count() // ITEMS_PER_PASS + 1
    for k in range(parts):
        got = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in got], [r["text"] for r in got])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per pair of a document row and an item that it holds: ``doc_id``, ``item_id``,
    ``distance`` (edits), ``first_word`` and ``n_words`` of the closest window (the first of equals).

    Texts and items without a word match nothing; missing ids stay missing; repeated document rows each get
    their rows; equal items (id and text) count once, and different items without an id or with one id each
    have a row; other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    T.prepared(spark)
    out = None
    for items in _passes(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(d, shared.value.ids[i], *v) for d, x in zip(ids, shared.value.leaks(b.column("text").to_pylist()))
                        for i, v in x.items()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "item_id", "distance", "first_word", "n_words"])

        part = T.doc_columns(docs).mapInArrow(
            run, "doc_id long, item_id long, distance long, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item: missing and empty texts stay, repeated rows are
    judged alike, and so is everything without items."""
    spark = docs.sparkSession
    T.prepared(spark)
    for items in _passes(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not x for x in shared.value.leaks(b.column("text").to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
