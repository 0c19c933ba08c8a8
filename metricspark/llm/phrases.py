"""Repeated passages, removed from every document but the first that holds them.

1. Each document gives its anchors: the least 7-gram hash of every WINDOW consecutive words, so equal
   windows have equal anchors wherever they stand.  Anchors of two documents or more set bits in a
   filter of fixed size; it may let windows through that do not recur, never the other way.
2. Windows with such an anchor are compared by their hash, first among the documents of an Arrow batch, so
   that each batch sends on one document of a window at most, then by a sort of those.  Where a later
   document goes on as an earlier one does, its windows make a run, and the run is a passage of the
   earlier document that is sought for the later one's block.
3. The words of a passage are taken from the earlier document itself and sent to the blocks that seek it.
4. Each block of documents compiles its passages into one Aho-Corasick automaton and streams all its
   documents through it.  Only words that the automaton finds are removed: a window whose hash
   happens to be that of another text is refused here.

A block holds about BLOCK_BYTES of text, so an automaton is bounded whatever the corpus holds.  A passage
of very many documents is one row per batch where its windows are sorted; behind that it is a row per
document at most, spread by the document.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

WINDOW = 13
ANCHOR = 7
#: Bits of an anchor that are counted: 40 of them leave few chance repetitions and shorter rows.
ANCHOR_BITS = 40
#: Least and largest number of bits of the anchor filter that is sent to each executor (32 MB and 256 MB), as
#: powers of two, and bytes of text for each bit.  With more recurring anchors the filter lets more windows
#: through to the exact stage; the result is the same.
LEAST_FILTER, LARGEST_FILTER, BYTES_PER_BIT = 28, 31, 25
#: Spark's setting that frees a query's shuffle files as soon as it has ended: the anchors' are as large as half
#: of the text, and not needed once the filter is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: 64-bit words of the filter that are put together in one task.
FILTER_CHUNK = 8192
#: Text of a block of documents.
BLOCK_BYTES = 8_000_000


def window_anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each window of the words."""
    grams = T.ngram_hashes(words, ANCHOR) & np.uint64((1 << ANCHOR_BITS) - 1)
    width = WINDOW - ANCHOR + 1
    out, have = grams, 1  # least of `have` grams from each place on
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def _windows(texts):
    """(row, word hashes) of each text that has a window."""
    for lo, hi in T.groups(texts):
        words, offsets = T.word_hashes(texts[lo:hi], lower=False)
        for k, (s, e) in enumerate(zip(offsets[:-1], offsets[1:])):
            if e - s >= WINDOW:
                yield lo + k, words[s:e]


def recurring_anchors(rows: DataFrame) -> DataFrame:
    """Anchors of at least two rows."""
    def run(batches):
        for b in batches:
            found = [np.unique(window_anchors(w)) for _, w in _windows(b.column("text").to_pylist())]
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64())], names=["anchor"])

    return rows.select("text").mapInArrow(run, "anchor long").groupBy("anchor").count().filter("count > 1").select("anchor")


def filter_bits(size: int) -> int:
    """Bits of the filter for a corpus of so many bytes."""
    return 1 << min(LARGEST_FILTER, max(LEAST_FILTER, (size // BYTES_PER_BIT).bit_length()))


def anchor_filter(anchors: DataFrame, bits: int) -> np.ndarray:
    """The filter's 64-bit words.  They come to the driver in chunks, ``bits`` bits in all at most."""
    def pack(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        place = found["place"].to_numpy()
        words = np.zeros(FILTER_CHUNK, np.uint64)
        np.bitwise_or.at(words, (place >> 6) % FILTER_CHUNK, np.uint64(1) << (place & 63).astype(np.uint64))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})

    place = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    conf = anchors.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        got = anchors.select(place.alias("place"), (place / (64 * FILTER_CHUNK)).cast("int").alias("chunk")).groupBy(
            "chunk").applyInArrow(pack, "chunk int, words binary").toArrow()
    finally:
        conf.set(CLEANUP, before)
    out = np.zeros((bits // 64 // FILTER_CHUNK, FILTER_CHUNK), np.uint64)
    for chunk, words in zip(got["chunk"].to_pylist(), got["words"]):
        out[chunk] = np.frombuffer(words.as_py(), np.uint64)
    return out.ravel()


def within_batch(node: np.ndarray, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a batch the place of its least document's first occurrence, and whether it stands in
    a later document than that."""
    order = np.lexsort((at, node, window))
    head = np.concatenate([[True], window[order][1:] != window[order][:-1]])
    first = np.empty(len(node), np.int64)
    first[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    return first, node > node[first]


def candidates(rows: DataFrame, known) -> DataFrame:
    """The windows whose anchor recurs, as ``key``, ``node``, ``at``; rows of one key hold one window.

    The least document of a batch that holds a window sends it under its hash.  Where later documents of the
    batch hold it, too, these stand with that document under a key of their own, which belongs to the batch."""
    def run(batches):
        bits = known.value
        for b in batches:
            nodes = b.column("node").to_numpy()
            node, at, window = ([np.empty(0, t)] for t in (np.int64, np.int32, np.uint64))
            for i, w in _windows(b.column("text").to_pylist()):
                place = window_anchors(w) & np.uint64(64 * len(bits) - 1)
                hit = np.flatnonzero((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    at.append(hit.astype(np.int32))
                    node.append(np.full(len(hit), nodes[i]))
                    window.append(T.ngram_hashes(w, WINDOW)[hit])
            node, at, window = map(np.concatenate, (node, at, window))
            if not len(node):
                continue
            first, later = within_batch(node, at, window)
            heads = np.unique(first[later])
            own = T.mix(window ^ T.mix(node[first].view(np.uint64) + at[first].astype(np.uint64)))
            sent = np.concatenate([np.flatnonzero(~later), np.flatnonzero(later), heads])
            key = np.concatenate([window[~later], own[later], own[heads]])
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "node": node[sent], "at": at[sent]})

    return rows.select("node", "text").mapInArrow(run, "key long, node long, at int")


def repeats(found: DataFrame) -> DataFrame:
    """The windows that stand in an earlier document, too: ``node``, ``at``, and that document's ``first`` and
    ``first_at``."""
    order = Window.partitionBy("key").orderBy("node", "at").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("node", "at", F.first("node").over(order).alias("first"),
                        F.first("at").over(order).alias("first_at")).filter("node > first")


def _runs(batches):
    """Runs of windows that follow each other in both documents; a run may be cut anywhere."""
    for b in batches:
        node, at, first, first_at = (b.column(c).to_numpy() for c in ("node", "at", "first", "first_at"))
        if not len(node):
            continue
        cut = (np.diff(node) != 0) | (np.diff(first) != 0) | (np.diff(at) != 1) | (np.diff(first_at) != 1)
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        sizes = np.diff(np.concatenate([starts, [len(node)]]))
        yield pa.RecordBatch.from_pydict({"node": node[starts], "first": first[starts], "first_at": first_at[starts],
                                          "size": sizes.astype(np.int32)})


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _passages(key, docs: pa.Table, sought: pa.Table) -> pa.Table:
    """The words of the passages of a block's documents, for each block that seeks them."""
    want: dict[int, list] = {}
    for first, at, size, target in zip(*(sought[c].to_pylist() for c in ("first", "first_at", "size", "target"))):
        want.setdefault(first, []).append((at, size, target))
    out = []
    nodes = docs["node"].to_pylist()
    for i, node in enumerate(nodes):
        if node in want:
            words = _split(docs["text"][i].as_py())
            for at, size, target in want[node]:
                passage = words[at:at + size + WINDOW - 1]
                if len(passage) >= WINDOW:
                    out.append((target, node, b" ".join(passage).decode("utf-8", "surrogatepass")))
    return pa.table({"target": pa.array([o[0] for o in out], pa.int32()), "first": pa.array([o[1] for o in out], pa.int64()),
                     "passage": pa.array([o[2] for o in out], pa.string())})


def compiled(passages: list[tuple[list[bytes], int]]):
    """(automaton, letters of each word) of passages and their first documents; None without passages.

    A word is three letters of three alphabets of equal size, so that no node of the automaton has many
    children and a match can only begin with a word."""
    numbers: dict[bytes, int] = {}
    for words, _ in passages:
        for w in words:
            numbers.setdefault(w, len(numbers))
    if not numbers:
        return None
    size = max(2, int(np.ceil(len(numbers) ** (1 / 3))))
    while size ** 3 < len(numbers):
        size += 1
    one, two, three = ([chr(0x100 + k * size + d) for d in range(size)] for k in range(3))
    letters = {w: one[n // (size * size)] + two[n // size % size] + three[n % size] for w, n in numbers.items()}
    automaton = ahocorasick.Automaton()
    least: dict[str, tuple[int, int]] = {}
    for words, first in passages:
        key = "".join(map(letters.__getitem__, words))
        if key not in least or first < least[key][0]:
            least[key] = (first, len(words))
    for key, value in least.items():
        automaton.add_word(key, value)
    automaton.make_automaton()
    return automaton, letters


def removals(words: list[bytes], node: int, automaton) -> np.ndarray:
    """Which of a document's words lie in a passage of an earlier document."""
    step = np.zeros(len(words) + 1, np.int64)
    if automaton is not None and len(words) >= WINDOW:
        found, letters = automaton
        for end, (first, size) in found.iter("".join([letters.get(w, "\1\1\1") for w in words])):
            if first < node:
                step[end // 3 + 1 - size] += 1
                step[end // 3 + 1] -= 1
    return np.cumsum(step)[:-1] > 0


def _block(key, docs: pa.Table, passages: pa.Table) -> pa.Table:
    """All documents of one block, without the words of its passages."""
    sought = set(zip(passages["passage"].to_pylist(), passages["first"].to_pylist()))
    automaton = compiled([(_split(p), f) for p, f in sorted(sought)])
    counts, gone, digests = [], [], []
    for text, node in zip(docs["text"], docs["node"].to_pylist()):
        words = _split(text.as_py())
        cut = removals(words, node, automaton)
        counts.append(len(words))
        gone.append(int(cut.sum()))
        digests.append(hashlib.sha256(b" ".join(compress(words, ~cut) if gone[-1] else words)).hexdigest())
    return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(counts, pa.int64()),
                     "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``.

    A missing text has no words; rows with one doc_id are one document, so they take nothing from each
    other; rows without doc_id come after all others; other columns are ignored.
    """
    spark = docs.sparkSession
    T.prepared(spark)
    rows = T.doc_columns(docs).withColumn("node", T.row_id())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1

    def block(c):
        return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    known = spark.sparkContext.broadcast(anchor_filter(recurring_anchors(rows), filter_bits(size)))
    runs = repeats(candidates(rows, known)).repartition("node").sortWithinPartitions("node", "at").mapInArrow(
        _runs, "node long, first long, first_at int, size int")
    sought = runs.select(block("first").alias("block"), "first", "first_at", "size", block("node").alias("target")).distinct()
    placed = rows.withColumn("block", block("node"))
    # Both stages read one exchange of the documents by their block.
    passages = placed.groupBy("block").cogroup(sought.groupBy("block")).applyInArrow(
        _passages, "target int, first long, passage string")
    return placed.groupBy("block").cogroup(passages.withColumnRenamed("target", "block").groupBy("block")).applyInArrow(
        _block, "doc_id long, n_words long, n_removed long, kept_sha256 string")
