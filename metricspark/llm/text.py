"""Shared helpers of the text operators: input columns, Arrow batches, word and shingle hashes.

Words are maximal runs of bytes other than the six ASCII white-space bytes (space, \\t, \\n, \\v,
\\f, \\r).  Hashing works on the UTF-8 bytes of many documents at once: one prefix sum per segment
gives the 64-bit polynomial hash of every word, and n-gram hashes follow from the word hashes, so no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Texts are handled in groups of about this many characters, which bounds a worker's memory.
GROUP_CHARS = 4_000_000
#: Stands for a missing doc_id where ids are compared: rows without an id sort last.
LAST_ID = 2**63 - 1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEGMENT = 1 << 18
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MUL = np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


_POW, _INV = _powers(_BASE, _SEGMENT), _powers(pow(_BASE, -1, 2**64), _SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (two multiply and xor-shift rounds)."""
    x = (x ^ (x >> _S32)) * _MUL
    x = (x ^ (x >> _S29)) * _MUL
    return x ^ (x >> _S32)


def prepared(spark: SparkSession) -> None:
    """Ship the package to the executors' Python workers."""
    ship_package(spark)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost
    executors."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_columns(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of any table that has them; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it if a column has that name (in any case) already."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


#: Keys with more than 1 / HOT of all rows are frequent: there are at most HOT of them.
HOT = 1000


def frequent(rows: DataFrame, key: str) -> list:
    """The frequent values of a column of a written table (not the missing one)."""
    total = rows.count()
    return [r[0] for r in rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(
        F.col("count") * HOT > total).select(key).collect()]


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` (a written table) joined, inner or left, with ``table``, which has one short row per key.  Rows
    of frequent keys meet a broadcast of at most HOT rows; the others are shuffled, so no key brings many
    rows to one task."""
    often = frequent(rows, key)
    if not often:
        return rows.join(table, key, how)
    hot = F.coalesce(F.col(key).isin(often), F.lit(False))
    return rows.filter(hot).join(F.broadcast(table.filter(hot)), key, how).unionByName(
        rows.filter(~hot).join(table.filter(~hot), key, how))


def join_spread(rows: DataFrame, table: DataFrame, key: str, other: str, often: list, parts: int = 32) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one long row per key.  The rows of the keys ``often`` (at
    most HOT) are dealt to ``parts`` tasks by ``other``, and those keys' rows of ``table`` go to each of these."""
    if not often:
        return rows.join(table, key)
    hot = F.col(key).isin(often)
    dealt = rows.withColumn("part", F.when(hot, F.pmod(F.xxhash64(other), F.lit(parts))).otherwise(0).cast("int"))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("part", F.explode(copies)), [key, "part"]).drop("part")


def id_or_last(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c), F.lit(LAST_ID))


def id_or_null(c: Column) -> Column:
    return F.when(c != F.lit(LAST_ID), c)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about GROUP_CHARS characters (one long text is a range)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > GROUP_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


#: Byte tables for :func:`word_hashes`: ASCII letters in lower case; punctuation as white space, too.
LOWER = _LOWER
PLAIN = _LOWER.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def word_hashes(texts: list[str | None], lower: bool, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, and the offsets of each text's words in it.

    ``table`` replaces bytes first; ``lower`` is short for the table LOWER.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    if table is None and lower:
        table = LOWER
    if table is not None:
        buf = table[buf]
    space = _SPACE[buf]
    word = ~space
    starts = np.flatnonzero(word[1:] & space[:-1]) + 1
    if len(word) and word[0]:
        starts = np.concatenate([[0], starts])
    ends = np.flatnonzero(space[1:] & word[:-1]) + 1
    offsets = np.searchsorted(starts, begins)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s = starts[i]
        j = int(np.searchsorted(ends, s + _SEGMENT, "right"))
        if j <= i:  # a word longer than a segment
            out[i] = xxhash.xxh3_64_intdigest(buf[s:ends[i]].tobytes())
            i += 1
            continue
        total = np.zeros(ends[j - 1] - s + 1, np.uint64)
        np.cumsum(_BYTE[buf[s:ends[j - 1]]] * _POW[: len(total) - 1], out=total[1:])
        out[i:j] = (total[ends[i:j] - s] - total[starts[i:j] - s]) * _INV[starts[i:j] - s]
        i = j
    return mix(out), offsets


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position (the last n - 1 positions have none)."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= _MUL
        out += words[k:k + m]
        out ^= out >> _S29
    return mix(out)


def within(offsets: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the n-grams over the joined words lie in one text, and each text's offsets among those."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    keep = np.zeros(max(0, total - n + 1), bool)
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, offsets[:-1][counts > 0], 1)
    np.add.at(step, (offsets[:-1] + counts)[counts > 0], -1)
    keep[:] = np.cumsum(step)[: len(keep)] > 0
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return keep, ends


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def row_id() -> Column:
    """``doc_id``; rows without one get an id above all others that depends on their text."""
    return F.coalesce(F.col("doc_id"), F.lit(LAST_ID) - F.pmod(
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(2**40)))
