"""Balanced contiguous shards of atomic groups, in DataFrame functions only.

Equal texts form an atomic group; groups stand in the order of their SHA-256.  The least shard
capacity for which a greedy left-to-right fill needs no more than ``n_shards`` shards is found by
binary search.  Neither the groups nor their sizes come to the driver: it holds sums of size over
prefixes of the digest (cells), decides what it can from bounds on each cut, and asks for finer cells
only where a cut may lie.  Three hex digits more a round, until the cells there are single groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

#: Hex digits that a round of refinement adds: 4096 cells below each cell looked into.
DIGITS = 3
#: Buckets of rows within a shard, for numbering slots: no window holds a whole shard.
BUCKETS = 1024


class Cells:
    """Sums of size by digest prefix: a sorted list of cells that grows finer where asked to."""

    def __init__(self, sized: DataFrame):
        self.sized = sized
        self.names: list[str] = []
        self.total = 0
        self._replace({"": (0, 0)}, 0)

    def _replace(self, old: dict[str, tuple[int, int]], digits: int) -> None:
        """Cells of ``digits`` + DIGITS hex digits in place of those in ``old``."""
        cell = F.substring("digest", 1, digits + DIGITS).alias("cell")
        rows = self.sized.select(cell, "digest", "bytes")
        if digits:
            rows = rows.filter(F.substring("digest", 1, digits).isin(*old))
        got = rows.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.min("digest").alias("lo"),
                                       F.max("digest").alias("hi")).collect()
        cells = {n: self.cells[n] for n in self.names if n not in old} if digits else {}
        cells |= {r["cell"] if r["lo"] != r["hi"] else r["lo"]: r["bytes"] for r in got}
        self.cells = cells
        self.names = sorted(cells)
        self.ends, at = [], 0
        for n in self.names:
            at += cells[n]
            self.ends.append(at)
        self.total = at

    def at_most(self, v: int) -> tuple[int, int, int | None]:
        """Bounds on the last group end that is ``v`` or less, and the cell that it may lie in."""
        k = bisect_right(self.ends, v)
        low = self.ends[k - 1] if k else 0
        if k == len(self.names) or len(self.names[k]) == 64:
            return low, low, None
        return low, min(v, self.ends[k]), k

    def refine(self, ks: set[int]) -> None:
        """Look into the cells ``ks``, the coarsest of them first."""
        digits = min(len(self.names[k]) for k in ks)
        self._replace({self.names[k]: (0, 0) for k in ks if len(self.names[k]) == digits}, digits)


def _fill(cells: Cells, capacity: int, n: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Bounds on each cut of the greedy fill, and the cells that leave them open."""
    cuts, open_cells, low, high = [], set(), 0, 0
    for _ in range(n):
        low, _, a = cells.at_most(low + capacity)
        _, high, b = cells.at_most(high + capacity)
        high = max(high, low)
        if low != high:
            open_cells |= {k for k in (a, b) if k is not None}
        cuts.append((low, high))
    return cuts, open_cells


def least_capacity(cells: Cells, n: int) -> tuple[int, list[int]]:
    """The smallest capacity for which ``n`` shards hold all groups in order, and its greedy cuts."""
    lo, hi = -(-cells.total // n), cells.total
    while lo < hi:
        mid = (lo + hi) // 2
        cuts, open_cells = _fill(cells, mid, n)
        if cuts[-1][0] >= cells.total:
            hi = mid
        elif cuts[-1][1] < cells.total or not open_cells:
            lo = mid + 1
        else:
            cells.refine(open_cells)
    while (got := _fill(cells, lo, n))[1]:
        cells.refine(got[1])
    return lo, [low for low, _ in got[0]]


def nearest_cuts(cells: Cells, n: int) -> list[int]:
    """The group ends nearest to equal shares of the total."""
    targets = [k * cells.total // n for k in range(1, n + 1)]
    while open_cells := {c for t in targets if (c := cells.at_most(t)[2]) is not None}:
        cells.refine(open_cells)
    out = []
    for t in targets:
        k = bisect_right(cells.ends, t)
        below = cells.ends[k - 1] if k else 0
        above = cells.ends[k] if k < len(cells.ends) else below
        out.append(below if t - below <= above - t else above)
    return out


def cut_digests(cells: Cells, n: int) -> list[str]:
    """The first digest of shards 1 to n - 1 ('~' sorts behind all: an empty shard).

    Cuts near equal shares are taken where they keep to the least capacity, else the greedy cuts.
    """
    capacity, cuts = least_capacity(cells, n)
    even = nearest_cuts(cells, n)
    if max(b - a for a, b in zip([0, *even], even)) <= capacity:
        cuts = even
    firsts = []
    for v in cuts[:-1]:
        k = bisect_right(cells.ends, v)
        firsts.append(cells.names[k] if k < len(cells.names) else "~")
    return firsts


def assign(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size`` (UTF-8 bytes of the text plus 1),
    ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (gapless in a shard) and ``grown_shard`` (null).

    A missing text counts as empty and is grouped with empty texts; ids may repeat or be missing; other
    columns are ignored; an empty table gives an empty result.  A group of any share of the rows
    stays whole in one shard, but its rows are numbered in BUCKETS buckets.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = T.written(spark, docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest")), "shard-rows")
    sized = T.written(spark, rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    firsts = cut_digests(Cells(sized), n_shards)
    shard = F.lit(0)
    for f in firsts:
        shard = shard + (F.col("digest") >= F.lit(f)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "digest", shard.cast("int").alias("shard"),
                       F.pmod(F.xxhash64("doc_id", "digest"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest"))
    # At most n_shards * BUCKETS rows are broadcast.
    return rows.withColumn("place", place).join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
