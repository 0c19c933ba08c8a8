"""Distributed isolation forest (Liu, Ting & Zhou, ICDM 2008).

Fit: a row enters a tree's sample by an integer hash of (row, tree); the ``psi`` least hashes of a tree are its
sample, so the sampled set is bounded by T*psi rows whatever the data size.
``groupBy(tree).applyInPandas`` grows the T trees in parallel; feature and split of a node come from integer
hashes of (tree, node), so that SQL can grow the same trees.  The model is at most T*(2^(h+1)-1) node rows.

Score: the model is that bounded node table; it is fetched once and shipped to executors in the
``mapInArrow`` closure, which walks all trees level by level for a whole Arrow batch.  Only the features and
the columns that the caller keeps go through Python.  A path's length is counted in whole thousand
millionths (depth, and c(size) of its leaf), so its sum does not depend on the order of the trees;
score = 2^(-E[h]/c(psi)).  Rows scoring above the exact (1 - contamination) quantile
(``exact_quantiles``) are flagged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import PRIME, hashed, hashed_sql, integer_id
from ..functions.quantile import exact_quantiles
from ..functions.sqlexpr import q as quoted
from ..functions.stats import fit_row
from ..plans.order import first_n_per_entity
from ..session import ship_package, stored

EULER_GAMMA = 0.5772156649
#: Path lengths are whole multiples of 1 / UNIT.
UNIT = 1_000_000_000
#: What a hash is for.
SAMPLE, FEATURE, SPLIT = 0, 1, 2
NODE_SCHEMA = "tree int, node int, feature int, split double, size long"


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n > 2:
        return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n
    return 1.0 if n == 2 else 0.0


def salt(seed: int, kind: int) -> int:
    return (seed * 7919 + kind * 104729) % PRIME


def _grow(tree: int, x: np.ndarray, height: int, seed: int) -> list[tuple]:
    """Heap-indexed nodes (children 2i+1, 2i+2); feature -1 marks a leaf."""
    nodes = []
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        sub = x[idx]
        usable = np.empty(0, int)
        if depth < height and len(idx) > 1:
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes.append((tree, node, -1, 0.0, len(idx)))
            continue
        f = int(usable[hashed(tree, node, salt(seed, FEATURE)) % usable.size])
        u = (hashed(tree, node, salt(seed, SPLIT)) + 0.5) / PRIME
        p = float(lo[f] + (hi[f] - lo[f]) * u)
        nodes.append((tree, node, f, p, len(idx)))
        left = sub[:, f] < p
        stack.append((2 * node + 1, idx[left], depth + 1))
        stack.append((2 * node + 2, idx[~left], depth + 1))
    return nodes


def fit_forest(df: DataFrame, cols: Sequence[str], n_trees: int = 100, psi: int = 256, seed: int = 42,
               key_col: str = "row_key") -> tuple[DataFrame, dict]:
    """Returns (node table, info).  ``df`` must have no NULLs in ``cols``."""
    ship_package(df.sparkSession)
    info = fit_row(df, [F.count(F.lit(1)).alias("n")])
    n = int(info["n"] or 0)
    psi_eff = max(1, min(psi, n))
    height = max(1, math.ceil(math.log2(max(psi_eff, 2))))
    feats = F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    rows = df.select(feats, integer_id(df, key_col).alias("k"))
    trees = F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))
    # Most rows enter no tree: those whose hash lies above a bound that leaves each tree psi rows and a
    # margin of six deviations are left out before the sort.  A tree that gets too few is drawn from all.
    share = (psi_eff + 6.0 * math.sqrt(psi_eff) + 30.0) / max(n, 1)

    def sample(bound: int | None) -> DataFrame:
        pairs = rows.select("x", "k", F.explode(trees).alias("tree")).withColumn(
            "r", F.expr(hashed_sql("k", "tree", salt(seed, SAMPLE))))
        if bound is not None:
            pairs = pairs.where(F.col("r") < bound)
        return first_n_per_entity(pairs, ["tree"], [F.col("r"), F.col("k")], psi_eff).select("tree", "x")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(cols)))
        return pd.DataFrame(_grow(tree, x, height, seed), columns=["tree", "node", "feature", "split", "size"])

    def grown(bound):
        return stored(sample(bound).groupBy("tree").applyInPandas(build, NODE_SCHEMA), "forest")

    nodes = grown(int(share * PRIME) if share < 1.0 else None)
    if share < 1.0 and nodes.where((F.col("node") == 0) & (F.col("size") == psi_eff)).count() < n_trees:
        nodes = grown(None)
    return nodes, {"n": n, "psi": psi_eff, "height": height, "n_trees": n_trees}


def score(df: DataFrame, cols: Sequence[str], nodes: DataFrame, info: dict, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``anomaly_score`` = 2^(-E[h(x)]/c(psi))."""
    ship_package(df.sparkSession)
    tbl = nodes.toPandas()          # bounded: n_trees * (2^(height+1) - 1) rows
    n_trees, height, psi = info["n_trees"], info["height"], info["psi"]
    width = 2 ** (height + 1) - 1
    feat = np.full((n_trees, width), -1, dtype=np.int64)
    split = np.zeros((n_trees, width))
    leaf_add = np.zeros((n_trees, width), dtype=np.int64)
    if len(tbl):
        t, nd = tbl["tree"].to_numpy(), tbl["node"].to_numpy()
        feat[t, nd] = tbl["feature"].to_numpy()
        split[t, nd] = tbl["split"].to_numpy()
        leaf_add[t, nd] = [round(c_factor(n) * UNIT) for n in tbl["size"]]
    cpsi = c_factor(psi) or 1.0
    keep = list(df.columns if keep is None else keep)
    names = [f"__x{i}" for i in range(len(cols))]
    source = df.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)])
    out_schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("anomaly_score", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            total = np.zeros(len(x), np.int64)
            rows = np.arange(len(x))
            for t in range(n_trees):
                node, depth = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                for _ in range(height):
                    f = feat[t, node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.where(inner, f, 0)] < split[t, node]
                    node = np.where(inner, np.where(go_left, 2 * node + 1, 2 * node + 2), node)
                    depth += inner
                total += depth * UNIT + leaf_add[t, node]
            got = np.power(2.0, -(total / (UNIT * max(n_trees, 1))) / cpsi)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(got)], names=[*keep, "anomaly_score"])

    return source.mapInArrow(run, out_schema)


def isolation_forest(df: DataFrame, cols: Sequence[str], contamination: float = 0.05, n_trees: int = 100,
                     psi: int = 256, seed: int = 42, key_col: str = "row_key", keep: Sequence[str] | None = None) -> DataFrame:
    """Mean-fill ``cols``, fit, score, flag rows above the (1 - contamination) score quantile.  ``keep``: columns
    of the result (all by default; the filled ones are ``cols``)."""
    means = fit_row(df, [F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    filled = df.selectExpr(*[f"coalesce(CAST({quoted(c)} AS DOUBLE), {means.get(c) or 0.0!r}D) AS {quoted(c)}"
                             if c in cols else quoted(c) for c in df.columns])
    nodes, info = fit_forest(filled, cols, n_trees, psi, seed, key_col)
    # Scores are read twice (cut, then flags): they are written once to the shared folder.
    scored = stored(score(filled, cols, nodes, info, keep), "forest-scores")
    # exact (1 - contamination) quantile: size-checked percentile or distributed selection
    cut = exact_quantiles(scored, ["anomaly_score"], [1.0 - contamination])[("anomaly_score", 1.0 - contamination)]
    cut = float("inf") if cut is None else float(cut)
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(cut))
