"""Importance resampling towards a target distribution, on hashed features.

Features are runs of up to ``max_words`` consecutive words; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo the number of buckets.  The distinct features of a group of texts are put into one two-dimensional
byte array per length, and the CRCs of all its rows advance together, column by column; the buckets are
then scattered back to every place where the feature stands.

Two passes read the texts: one counts features per bucket (a task sends one row per bucket that it met),
one adds up each document's gains.  The draw ranks documents by score: they are sorted by ranges, written once,
and a document's rank is its place in its range plus the sizes of the ranges before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

BUCKETS = 10_000
MAX_WORDS = 1
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Per cent of the documents with enough words.
DRAWN = 10
SEED = 2024
#: Features of more bytes than this are rare and nearly all of different lengths: an array each would hold
#: one row, so their CRC is taken one by one (the same value).
LONG = 256
#: Bytes of one array of features of equal length.
MATRIX_BYTES = 1 << 21

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte (reflected polynomial of zip and Ethernet)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a byte matrix, all rows advancing by one column at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return ~crc


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words of the texts, one white space behind each: (bytes, starts, ends, and where each
    text's words begin among them)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = T.LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    word = _WORD[buf]
    before = np.concatenate([[False], word[:-1]])
    offsets = np.searchsorted(np.flatnonzero(word & ~before), begins)
    keep = word | before
    kept = np.where(word, buf, np.uint8(32))[keep]
    ends = np.flatnonzero(~word[keep])
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    return kept, starts, ends, offsets


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a byte matrix, and which of them each row is."""
    width = rows.shape[1]
    if width <= 8:  # as numbers: padded to eight bytes
        padded = np.zeros((len(rows), 8), np.uint8)
        padded[:, :width] = rows
        _, first, inverse = np.unique(padded.view(np.uint64).ravel(), return_index=True, return_inverse=True)
    else:
        _, first, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{width}").ravel(), return_index=True,
                                      return_inverse=True)
    return rows[first], inverse


def buckets_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each feature, given as a span of the bytes."""
    out = np.empty(len(starts), np.int64)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, edges) if len(order) else []:
        size = int(lengths[places[0]])
        if size > LONG:
            out[places] = [zlib.crc32(buf[s:s + size].tobytes()) % buckets for s in starts[places]]
            continue
        step = MATRIX_BYTES // size  # a very long text does not make a larger array
        for some in (places[at:at + step] for at in range(0, len(places), step)):
            rows, inverse = _distinct(buf[starts[some][:, None] + np.arange(size)])
            out[some] = (crc_rows(rows) % np.uint32(buckets))[inverse]
    return out


def features(texts: list[str | None], max_words: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts lo to hi: words of each text, features of each text, and the features' buckets
    in the order of the texts."""
    for lo, hi in T.groups(texts):
        buf, starts, ends, offsets = words_of(texts[lo:hi])
        n_words = np.diff(offsets)
        text_of = np.repeat(np.arange(hi - lo), n_words)
        found, owner = [], []
        for n in range(1, max_words + 1):
            m = max(0, len(starts) - n + 1)
            inside = text_of[:m] == text_of[n - 1:]
            found.append(buckets_of(buf, starts[:m][inside], ends[n - 1:][inside], buckets))
            owner.append(text_of[:m][inside])
        owners, places = np.concatenate(owner), np.concatenate(found)
        order = np.argsort(owners, kind="stable")
        yield lo, hi, n_words, np.bincount(owners, minlength=hi - lo), places[order]


def bucket_counts(rows: DataFrame, text_col: str, max_words: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, places in features(b.column("text").to_pylist(), max_words, buckets):
                total += np.bincount(places, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": met.astype(np.int32), "n": total[met]})

    got = rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the target's to the source's smoothed share of each bucket, in whole thousandths."""
    buckets = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, table: np.ndarray, max_words: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        gain = shared.value
        for b in batches:
            words, counts, weights = [], [], []
            for _, _, w, n, places in features(b.column("text").to_pylist(), max_words, len(gain)):
                sums = np.concatenate([[0], np.cumsum(gain[places])])
                edge = np.concatenate([[0], np.cumsum(n)])
                words.append(w)
                counts.append(n)
                weights.append(sums[edge[1:]] - sums[edge[:-1]])
            flat = [pa.array(np.concatenate([np.empty(0, np.int64), *p]).astype(np.int64)) for p in (words, counts, weights)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *flat], names=["doc_id", "n_words", "n_features", "weight"])

    return T.doc_columns(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` from 1 on in the given order; equal rows are ranked in any order.

    One sort by ranges, written once; then only the sizes of the ranges are summed up.  A random last key
    cuts a range that a single row, repeated very often, would fill."""
    spark = rows.sparkSession
    cut = rows.withColumn("tie", F.rand(SEED)).orderBy(*order, "tie").drop("tie")
    cut = T.written(spark, cut.withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("at", 33).alias("part")
    before, total = [], 0
    for r in cut.groupBy(part).count().orderBy("part").collect():  # one row per range
        before.append((r["part"], total))
        total += r["count"]
    starts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1
    return cut.withColumn("part", part).join(starts, "part").withColumn("rank", place).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, drawn: int = DRAWN, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``, ``n_words``.

    ``target`` is a table with a ``text`` column.  ``weight`` is the sum of the features' gains, ``score`` adds
    Gumbel noise from a hash of seed and doc_id; the ``drawn`` per cent (rounded down) of the documents with
    ``least_words`` words or more that score highest have a ``rank``, ties going to the smaller doc_id.
    Missing texts have no words.  A missing doc_id takes the noise of the empty id and ranks behind equal
    scores; rows of one doc_id have one noise value.  Other columns are ignored."""
    spark = docs.sparkSession
    T.prepared(spark)
    table = gains(bucket_counts(docs, "text", max_words, buckets), bucket_counts(target, "text", max_words, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = T.written(spark, weighed(docs, table, max_words).withColumn("score", F.col("weight") + noise), "importance-rows")
    enough = F.col("n_words") >= least_words
    places = ranked(rows.filter(enough), [F.desc("score"), F.col("doc_id").asc_nulls_last()])
    quota = rows.filter(enough).count() * drawn // 100
    out = places.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).unionByName(
        rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
