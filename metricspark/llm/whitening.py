"""Whitening of embeddings by exact integer covariances.

1. Each entry c becomes the integer x = floor(SCALE * c); the distinct vectors are the fit list.
2. Every task takes the fit list's rows in blocks.  A dimension's values, shifted by its least one so
   that they are not negative, are cut into bit planes, and each plane is packed across the block's rows
   into 64-bit words.  The population counts of ANDed planes, weighted by the planes' powers of two, are
   exact sums of products.  Values are cut into limbs of LIMB bits first, so that no sum can overflow.
3. The driver gets one row per pair of dimensions (and limbs): the scatter matrix, centred as integers
   (n * sum of products - product of sums), is divided only then and goes to ``eigh``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

SCALE = 256
COMPONENTS = 4
#: Bits of a limb: a product of limbs has 32 bits, so a 64-bit sum holds two thousand million rows.
LIMB = 16
#: Rows whose planes are packed together.
BLOCK = 8192
#: Eigenvalues up to this share of the trace count as zero: the component has no whitened values.
FLAT = 1e-12


def integers(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of the rows whose vector has only finite entries.

    Values beyond the range of a long end at its limits.  Where lengths differ, those of the length that
    most of these rows have stay (the smaller of equally frequent ones); empty vectors never do."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    x = F.transform(v, lambda e: F.floor(e * F.lit(float(scale))))
    out = rows.filter(fine & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    sizes = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return out.filter(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch, one per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def marginals(fit: DataFrame) -> list:
    """Per dimension: ``dim``, ``least``, ``most``, ``total`` (exact) and ``n``."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"))
            if len(x):
                low = (x & 0xFFFFFFFF).sum(axis=0)  # sums of halves cannot overflow
                high = (x >> 32).sum(axis=0)
                yield pa.RecordBatch.from_pydict({
                    "dim": np.arange(x.shape[1], dtype=np.int32), "least": x.min(axis=0), "most": x.max(axis=0),
                    "low": low, "high": high, "n": np.full(x.shape[1], len(x), np.int64)})

    parts = fit.select("x").mapInArrow(run, "dim int, least long, most long, low long, high long, n long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]
    got = parts.groupBy("dim").agg(F.min("least").alias("least"), F.max("most").alias("most"), *whole,
                                   F.sum("n").alias("n")).orderBy("dim").collect()
    return [(r["least"], r["most"], int(r["low"]) + (int(r["high"]) << 32), r["n"]) for r in got]


def planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of a block (rows x dimensions, not negative, below 2**bits), packed across rows into
    64-bit words: dimensions x bits x words."""
    n, dims = shifted.shape
    columns = np.ascontiguousarray(shifted.T)
    out = np.zeros((dims, bits, -(-n // 64) * 8), np.uint8)
    for b in range(bits):
        out[:, b, :-(-n // 8)] = np.packbits((columns >> np.uint64(b)) & np.uint64(1) == 1, axis=1)
    return out.view(np.uint64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sums of products of every dimension of ``a`` with every one of ``b``, by weighted counts of
    ANDed bit planes."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat = b.reshape(-1, b.shape[2])
    weights = np.left_shift(np.int64(1), np.arange(b.shape[1], dtype=np.int64))
    for i in range(len(a)):
        for p, plane in enumerate(a[i]):
            counts = np.bitwise_count(flat & plane).sum(axis=1, dtype=np.int64)
            out[i] += (counts.reshape(len(b), -1) @ weights) << p
    return out


def scatter(fit: DataFrame, least: list[int], most: list[int]) -> np.ndarray:
    """Sums of products of the shifted values (x - least), as Python integers."""
    dims, low = len(least), np.array(least, np.int64).view(np.uint64)
    limbs = max(1, *(-(-(m - s).bit_length() // LIMB) for s, m in zip(least, most)))
    bits = min(LIMB, max(1, *((m - s).bit_length() for s, m in zip(least, most))))

    def run(batches):
        sums = {}
        for batch in batches:
            x = _matrix(batch.column("x")).view(np.uint64) - low
            for at in range(0, len(x), BLOCK):
                cut = [planes((x[at:at + BLOCK] >> np.uint64(LIMB * k)) & np.uint64((1 << LIMB) - 1), bits)
                       for k in range(limbs)]
                for k in range(limbs):
                    for m in range(k, limbs):
                        sums[k, m] = sums.get((k, m), 0) + products(cut[k], cut[m])
        i, j = (np.repeat(np.arange(dims, dtype=np.int32), dims), np.tile(np.arange(dims, dtype=np.int32), dims))
        for (k, m), s in sums.items():
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "k": np.full(len(i), k, np.int32),
                                              "m": np.full(len(i), m, np.int32), "s": s.ravel()})

    parts = fit.select("x").mapInArrow(run, "i int, j int, k int, m int, s long")
    got = parts.groupBy("i", "j", "k", "m").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toArrow()
    out = np.zeros((dims, dims), object)
    for i, j, k, m, s in zip(*(got.column(c).to_pylist() for c in "ijkms")):
        out[i, j] += int(s) << (LIMB * (k + m))
        if k != m:
            out[j, i] += int(s) << (LIMB * (k + m))
    return out


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict | None:
    """``n``, ``sums``, ``values`` (eigenvalues), ``vectors`` (columns) and ``trace`` of the covariance of
    the fit list; None if it is empty.  One row per dimension and per pair of dimensions is collected."""
    one = marginals(fit)
    if not one:
        return None
    least, most, sums = ([r[k] for r in one] for k in range(3))
    n = one[0][3]
    shift, total = np.array(least, object), np.array(sums, object)
    # The covariance does not change by a shift: n * sum of products - product of sums, of shifted values.
    centred = n * scatter(fit, least, most) - np.outer(total - n * shift, total - n * shift)
    v = np.array([[int(c) / (n * n) for c in row] for row in centred], float)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return {"n": n, "sums": sums, "values": values[order], "vectors": vectors[:, order],
            "trace": sum(int(centred[k, k]) for k in range(len(sums))) / (n * n)}


def projected(rows: DataFrame, model: dict) -> DataFrame:
    """``vec_id``, ``w`` (whitened values; null where the eigenvalue is zero), ``n`` and ``deviation``
    (decimal text, exact), of columns ``vec_id`` and ``x``."""
    n, sums, values, trace = model["n"], model["sums"], model["values"], model["trace"]
    real = values > FLAT * trace
    weights = model["vectors"] / np.sqrt(np.where(real, values, 1.0))
    means = np.array([s / n for s in sums])
    squares, biggest = sum(s * s for s in sums), max(map(abs, sums))

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"))
            w = (x - means) @ weights
            top = max(1, -int(x.min()), int(x.max())) if x.size else 1
            exact = x if top * max(top, biggest) * len(sums) < 2**62 else x.astype(object)
            own = (exact * exact).sum(axis=1)
            cross = exact @ np.array(sums, exact.dtype)
            far = [str(n * n * int(a) - 2 * n * int(c) + squares) for a, c in zip(own, cross)]
            mask = np.broadcast_to(~real, w.shape).ravel()
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(values), pa.int32()),
                                           pa.array(w.ravel(), pa.float64(), mask=mask))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), out, pa.array(far, pa.string())],
                                             names=["vec_id", "w", "deviation"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, w array<double>, deviation string")


def identity_error(fit: DataFrame, model: dict) -> float | None:
    """Largest entry of the covariance of the whitened fit list less the identity, over the components
    with a whitened value; Spark's population covariance centres before it multiplies."""
    have = [k for k, e in enumerate(model["values"]) if e > FLAT * model["trace"]]
    if not have:
        return None
    w = projected(fit.withColumn("vec_id", F.lit(0).cast("long")), model)
    pairs = [(a, b) for a in have for b in have if a <= b]
    got = w.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """One row per row of ``rows`` with a fit vector and component: ``vec_id``, ``component`` (from 1),
    ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` and ``deviation_exact``.

    Rows whose vector is missing, empty or has missing or non-finite entries, or is not of the usual length
    (see ``integers``), are dropped; ids may be missing or repeated; other columns are ignored.  Components
    whose eigenvalue is zero (up to FLAT of the trace) have no ``whitened``; without any variance
    ``explained`` and ``identity_error`` are null.  ``deviation`` is null beyond the range of a long;
    ``deviation_exact`` is its decimal text.  Fewer dimensions than ``components`` give fewer components."""
    spark = rows.sparkSession
    T.prepared(spark)
    x = integers(rows, id_col, vector_col, scale)
    fit = T.written(spark, x.select("x").distinct(), "whitening-fit")
    model = fitted(fit, components)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double, deviation_exact string")
    trace = model["trace"]
    shares = F.array(*[F.lit(float(e) / trace if trace else None).cast("double") for e in model["values"]])
    error = F.lit(identity_error(fit, model)).cast("double")
    out = projected(x, model).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"),
                      F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
                      shares[F.col("at")].alias("explained"), error.alias("identity_error"),
                      F.col("deviation").alias("deviation_exact"))
