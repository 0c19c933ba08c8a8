"""Exact quantiles (linear interpolation, as ``percentile``/``quantile_cont``) without
sending all distinct values of a column to one task.

``percentile`` keeps a value->count map per group and merges it in a single
task for a global quantile: at scale that task holds nearly every distinct
value of the column.  Here each target rank is found by selection:

1. ``n`` per column (one count pass).  When every column has at most
   ``direct_max`` values, ``percentile`` itself is used (bounded map, one pass).
2. While a rank's candidate interval holds more than ``small`` values: a
   bounded-memory sketch (``percentile_approx``, rank error <= m/accuracy) over
   the candidates brackets the rank with a margin of 2*m/accuracy, and a count
   pass says how many candidates lie before, on and between the bracket's ends.
   A rank on an end is settled: its value is that end, however many rows share
   it.  Any other goes on with the open interval, so ties never keep the
   candidates from shrinking (by ~accuracy/4 a round).
3. The remaining candidates (<= ``small`` per rank) are counted by value and
   ranked with a running sum over a window partitioned by interval.

All ranks of all columns advance together, one aggregate of the table per step.
The sketch's margin affects speed only: a rank outside its bracket goes on in
the part of the interval that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sqlexpr import dcol, dlit
from .stats import fit_row

SMALL = 2_000_000
DIRECT_MAX = 1_000_000


def _pos(p: float, n: int) -> tuple[float, int, int]:
    pos = p * (n - 1)
    return pos, math.floor(pos), math.ceil(pos)


def exact_quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], small: int = SMALL,
                    accuracy: int = 10000, max_rounds: int = 6,
                    direct_max: int = DIRECT_MAX,
                    known_counts: dict[str, int] | None = None) -> dict[tuple[str, float], float | None]:
    """``known_counts`` (non-NULL values per column, e.g. from an earlier fit) skips the count pass."""
    cols, ps = list(cols), [float(p) for p in ps]
    if not cols:
        return {}
    if known_counts is not None and all(c in known_counts for c in cols):
        counts = {f"n{i}": known_counts[c] for i, c in enumerate(cols)}
    else:
        counts = fit_row(df, [F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    if max(int(counts[f"n{i}"] or 0) for i in range(len(cols))) <= direct_max:
        # Size checked: at most ``direct_max`` values per column, so the single-task
        # value map of ``percentile`` is bounded; one pass, same result.
        row = fit_row(df, [F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in ps])).alias(f"q{i}")
                           for i, c in enumerate(cols)])
        return {(c, p): (row[f"q{i}"][k] if row[f"q{i}"] is not None else None)
                for i, c in enumerate(cols) for k, p in enumerate(ps)}
    # One task per (column, rank): the rank's value lies strictly inside (a, b), which holds ``m`` values
    # and has ``below`` values in front of it, or it is known (``val``).
    tasks: dict[tuple[int, int], dict] = {}
    for i in range(len(cols)):
        n = int(counts[f"n{i}"] or 0)
        for p in ps if n else ():
            for r in _pos(p, n)[1:]:
                tasks[i, r] = {"ci": i, "r": r, "a": None, "b": None, "below": 0, "m": n, "val": None}

    def value(i: int) -> str:
        return dcol(cols[i])

    def inside(t) -> str:
        v = value(t["ci"])
        return " AND ".join([f"{v} IS NOT NULL"] + [f"{v} > {dlit(t['a'])}"] * (t["a"] is not None)
                            + [f"{v} < {dlit(t['b'])}"] * (t["b"] is not None))

    for done in range(max_rounds + 1):
        big = [t for t in tasks.values() if t["val"] is None and t["m"] > small]
        if not big:
            break
        if done == max_rounds:
            raise RuntimeError(f"exact quantiles: more than {small} candidates left after {max_rounds} rounds")
        # One sketch an interval, however many ranks lie in it, and each count once.
        sharing: dict[tuple, list[dict]] = {}
        for t in big:
            sharing.setdefault((t["ci"], t["a"], t["b"]), []).append(t)
        sketch, margin = [], 2.0 / accuracy
        for j, ts in enumerate(sharing.values()):
            shares = [dlit(x) for t in ts for x in (max(0.0, (t["r"] - t["below"]) / t["m"] - margin),
                                                    min(1.0, (t["r"] - t["below"] + 1) / t["m"] + margin))]
            sketch.append(f"percentile_approx(CASE WHEN {inside(ts[0])} THEN {value(ts[0]['ci'])} END, "
                          f"array({', '.join(shares)}), {accuracy}) AS s{j}")
        row = df.agg(*[F.expr(s) for s in sketch]).first()
        brackets = [(t, *row[f"s{j}"][2 * i:2 * i + 2]) for j, ts in enumerate(sharing.values()) for i, t in enumerate(ts)]
        cnt: dict[str, str] = {}
        wanted_counts = []
        for t, a, b in brackets:
            v, within = value(t["ci"]), inside(t)
            conds = (f"{v} < {dlit(a)}", f"{v} = {dlit(a)}", f"{v} > {dlit(a)} AND {v} < {dlit(b)}",
                     f"{v} = {dlit(b)} AND {v} > {dlit(a)}")
            wanted_counts.append([cnt.setdefault(f"count_if({within} AND {c})", f"c{len(cnt)}") for c in conds])
        row = df.agg(*[F.expr(f"{e} AS {name}") for e, name in cnt.items()]).first()
        for (t, a, b), names in zip(brackets, wanted_counts):
            k = t["r"] - t["below"]
            lt, ea, within, eb = (row[x] for x in names)
            if k < lt:
                t.update(b=a, m=lt)
            elif k < lt + ea:
                t["val"] = a
            elif k < lt + ea + within:
                t.update(a=a, b=b, below=t["below"] + lt + ea, m=within)
            elif k < lt + ea + within + eb:
                t["val"] = b
            else:
                t.update(a=b, below=t["below"] + lt + ea + within + eb, m=t["m"] - lt - ea - within - eb)
    # The remaining candidates: one group per interval, equal values counted before they are ranked.
    open_ = [t for t in tasks.values() if t["val"] is None]
    if open_:
        groups: dict[tuple, int] = {}
        for t in open_:
            t["g"] = groups.setdefault((t["ci"], t["a"], t["b"]), len(groups))
        members = [f"CASE WHEN {inside({'ci': ci, 'a': a, 'b': b})} THEN named_struct('g', {g}, 'v', {value(ci)}) END"
                   for (ci, a, b), g in groups.items()]
        ties = df.selectExpr(f"explode(filter(array({', '.join(members)}), x -> x IS NOT NULL)) AS e").groupBy(
            F.col("e.g").alias("g"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        ranked = ties.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("v")))
        wanted = " OR ".join(f"(g = {t['g']} AND upto > {t['r'] - t['below']} AND upto - n <= {t['r'] - t['below']})"
                             for t in open_)
        picked = ranked.where(wanted).collect()          # at most one row per task
        for t in open_:
            k = t["r"] - t["below"]
            t["val"] = next(x["v"] for x in picked if x["g"] == t["g"] and x["upto"] - x["n"] <= k < x["upto"])
    out = {}
    for i, c in enumerate(cols):
        n = int(counts[f"n{i}"] or 0)
        for p in ps:
            if not n:
                out[c, p] = None
                continue
            pos, lo, hi = _pos(p, n)
            low, high = tasks[i, lo]["val"], tasks[i, hi]["val"]
            # same interpolation as Spark's percentile
            out[c, p] = low if lo == hi or low == high else (hi - pos) * low + (pos - lo) * high
    return out


GRID = 1000


def grouped_exact_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], ps: Sequence[float],
                            small: int = SMALL, accuracy: int = 10000, max_rounds: int = 6,
                            salts: int = 16) -> DataFrame:
    """Exact per-group quantiles ``(by..., q_<i>_<j>)`` for column ``cols[i]`` and ``ps[j]``,
    without holding a hot group's values in one task.

    Per round, one aggregate per (group, column, rank) builds a bounded-memory sketch
    on a fixed grid of fractions over the rank's current candidates; the grid points
    around the rank (+-2/accuracy) bracket it.  A second aggregate counts the candidates
    before, on and between the bracket's ends: a rank on an end is settled, others go on
    with the open interval.  Intervals of at most ``small`` values are counted by value and
    ranked with a window partitioned by rank.  The small per-rank state is joined to the
    rows with a salted join."""
    from .stats import salted_join
    by, cols, ps = list(by), list(cols), [float(p) for p in ps]
    eps, grid = 1.0 / accuracy, GRID
    rid = F.monotonically_increasing_id()     # only picks a salt: any value is correct
    long = df.select(*by, rid.alias("__rid"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)
    ])).alias("e")).select(*by, "__rid", "e.ci", "e.v").where(F.col("v").isNotNull())
    keys = [*by, "ci"]
    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pos = F.col("p") * (F.col("n") - 1)
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    state = n.select(*keys, "n", F.explode(F.array(*[F.lit(p) for p in ps])).alias("p")).select(
        *keys, "p", pos.alias("pos"), F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))).alias("r"),
        none.alias("a"), none.alias("b"), zero.alias("below"), F.col("n").cast("long").alias("m"),
        none.alias("val")).checkpoint()
    tk = [*keys, "p", "r"]
    v, k = F.col("v"), F.col("r") - F.col("below")
    inside = (F.col("a").isNull() | (v > F.col("a"))) & (F.col("b").isNull() | (v < F.col("b")))
    fr = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    unsettled = F.col("val").isNull() & (F.col("m") > small)
    for done in range(max_rounds + 1):
        big = state.where(unsettled)
        if big.isEmpty():
            break
        if done == max_rounds:
            raise RuntimeError(f"exact quantiles: more than {small} candidates left after {max_rounds} rounds")
        rows = salted_join(long, big, keys, "__rid", salts).where(inside)
        sk = rows.groupBy(*tk).agg(F.percentile_approx("v", fr, accuracy).alias("sk"))
        low = F.greatest(F.lit(0), F.floor((k / F.col("m") - 2 * eps) * grid)).cast("int")
        high = F.least(F.lit(grid), F.ceil(((k + 1) / F.col("m") + 2 * eps) * grid)).cast("int")
        b2 = big.join(sk, tk).withColumn("na", F.col("sk")[low]).withColumn("nb", F.col("sk")[high]).drop("sk")
        na, nb = F.col("na"), F.col("nb")
        cnt = salted_join(long, b2, keys, "__rid", salts).where(inside).groupBy(*tk).agg(
            F.count_if(v < na).alias("c1"), F.count_if(v <= na).alias("c2"),
            F.count_if((v < nb) | (v <= na)).alias("c3"), F.count_if(v <= nb).alias("c4"))
        step = (F.when(k < F.col("c1"), 1).when(k < F.col("c2"), 2).when(k < F.col("c3"), 3)
                .when(k < F.col("c4"), 4).otherwise(5))
        s = F.col("step")
        upd = b2.join(cnt, tk).withColumn("step", step).select(
            *keys, "p", "pos", "r",
            F.when(s == 3, na).when(s == 5, nb).otherwise(F.col("a")).alias("a"),
            F.when(s == 1, na).when(s == 3, nb).otherwise(F.col("b")).alias("b"),
            (F.col("below") + F.when(s == 3, F.col("c2")).when(s == 5, F.col("c4")).otherwise(0)).alias("below"),
            F.when(s == 1, F.col("c1")).when(s == 3, F.col("c3") - F.col("c2")).otherwise(
                F.col("m") - F.col("c4")).alias("m"),
            F.when(s == 2, na).when(s == 4, nb).alias("val"))
        state = state.where(~unsettled).unionByName(upd).checkpoint()
    # The remaining candidates: equal values are counted before they are ranked.
    ties = salted_join(long, state.where("val IS NULL"), keys, "__rid", salts).where(inside).groupBy(
        *tk, "pos", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*tk).orderBy("v"))
    ranked = ties.withColumn("upto", upto).where((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k))
    known = ranked.select(*tk, "pos", v.alias("val")).unionByName(
        state.where("val IS NOT NULL").select(*tk, "pos", "val"))
    lo_r, hi_r = F.floor("pos"), F.ceil("pos")
    picked = known.groupBy(*keys, "p").agg(
        F.first("pos").alias("pos"), F.max(F.when(F.col("r") == lo_r, F.col("val"))).alias("lv"),
        F.max(F.when(F.col("r") == hi_r, F.col("val"))).alias("hv"))
    val = F.when((hi_r == lo_r) | (F.col("lv") == F.col("hv")), F.col("lv")).otherwise(
        (hi_r - F.col("pos")) * F.col("lv") + (F.col("pos") - lo_r) * F.col("hv"))
    tk = [*keys, "p"]
    res = picked.select(*tk, val.alias("q"))
    out = res.groupBy(*by).pivot("ci", list(range(len(cols)))).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{j}") for j, p in enumerate(ps)])
    return out.select(*by, *[F.col(f"{i}_p{j}" if len(ps) > 1 else f"{i}").alias(f"q_{i}_{j}")
                             for i in range(len(cols)) for j in range(len(ps))])
