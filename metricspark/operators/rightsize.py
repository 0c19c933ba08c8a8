"""Resource right-sizing: start state, cost, hill climbing per entity, result and savings.

The climb is a ``aggregate(sequence(0, n-1), state, step)`` fold on each
entity row: no UDF, stays inside Catalyst, and every entity climbs in
parallel.  The random draw is an integer hash of (entity, iteration), so a
run is repeatable and checkable by a recursive SQL statement; an entity id
may have any type.  A step evaluates its neighbour once and refers to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, hashed, integer_id

STATE_COLS = ["cpu_utilization", "memory_usage", "power_consumption", "network_latency", "disk_io"]

# Move parameters (fixed values): reduction = lo + (hi - lo) * u, and the
# share of that reduction applied to the coupled resource.
CPU_MOVE = (0.05, 0.10, 0.5)      # cpu, power
MEM_MOVE = (0.03, 0.07, 0.3)      # memory, power
LAT_MOVE = (0.10, 0.20, 0.5)      # latency, disk_io
PENALTY = 2.0

# Advice texts (fixed values).
CPU_OVER = "⚠ CPU still exceeds limit. Consider task migration."
CPU_LOW = "✓ CPU well optimised. Consider consolidating tasks."
MEM_OVER = "⚠ Memory still exceeds limit. Increase system RAM or reduce processes."
MEM_LOW = "✓ Memory efficiently managed."


def initial_state(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per entity mean of each state column; absent column or no value -> 0."""
    aggs = [F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) if c in df.columns
            else F.lit(0.0).alias(c) for c in STATE_COLS]
    return df.groupBy(*by).agg(*aggs)


def cost_expr(cpu: Column, mem: Column, power: Column, cpu_limit: float, mem_limit: float) -> Column:
    """power + 2*(cpu - limit) when over, + 2*(memory - limit) when over."""
    return (power
            + F.when(cpu > cpu_limit, (cpu - F.lit(float(cpu_limit))) * PENALTY).otherwise(F.lit(0.0))
            + F.when(mem > mem_limit, (mem - F.lit(float(mem_limit))) * PENALTY).otherwise(F.lit(0.0)))


#: Salt of the draws' hash.
DRAW_SALT = 12345


def draw(entity: Column, it: Column) -> tuple[Column, Column]:
    """(move in {0,1,2}, uniform u in [0,1)) from the hash of (entity, iteration)."""
    r = hashed(F.pmod(entity, F.lit(PRIME)), it.cast("long"), DRAW_SALT)
    return r % 3, (r % 1000) / F.lit(1000.0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once: a transform over one element binds it to a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbour(acc: Column, mv: Column, u: Column) -> Column:
    zero = F.lit(0.0)
    rc = F.lit(CPU_MOVE[0]) + F.lit(CPU_MOVE[1] - CPU_MOVE[0]) * u
    rm = F.lit(MEM_MOVE[0]) + F.lit(MEM_MOVE[1] - MEM_MOVE[0]) * u
    rl = F.lit(LAT_MOVE[0]) + F.lit(LAT_MOVE[1] - LAT_MOVE[0]) * u
    cpu, mem, pwr, lat, dio = (acc[c] for c in ("cpu", "mem", "pwr", "lat", "dio"))
    return F.struct(
        F.when(mv == 0, F.greatest(zero, cpu * (F.lit(1.0) - rc))).otherwise(cpu).alias("cpu"),
        F.when(mv == 1, F.greatest(zero, mem * (F.lit(1.0) - rm))).otherwise(mem).alias("mem"),
        F.when(mv == 0, F.greatest(zero, pwr * (F.lit(1.0) - rc * CPU_MOVE[2])))
        .when(mv == 1, F.greatest(zero, pwr * (F.lit(1.0) - rm * MEM_MOVE[2]))).otherwise(pwr).alias("pwr"),
        F.when(mv == 2, F.greatest(zero, lat * (F.lit(1.0) - rl))).otherwise(lat).alias("lat"),
        F.when(mv == 2, F.greatest(zero, dio * (F.lit(1.0) - rl * LAT_MOVE[2]))).otherwise(dio).alias("dio"))


def hill_climb(state: DataFrame, entity_col: str, iterations: int = 100, cpu_limit: float = 80.0,
               mem_limit: float = 85.0, trace: bool = False) -> DataFrame:
    """Per entity: accept a neighbour only when its cost is strictly lower; the
    accepted state is always the best so far.  Adds ``best_*`` columns, costs
    and ``n_improvements``; with ``trace`` also an array of per-iteration
    (iteration, current_cost, neighbor_cost, is_improvement)."""
    ent = integer_id(state, entity_col)
    cpu0, mem0, pwr0 = (F.col(c) for c in ("cpu_utilization", "memory_usage", "power_consumption"))
    cost0 = cost_expr(cpu0, mem0, pwr0, cpu_limit, mem_limit)
    fields = [cpu0.alias("cpu"), mem0.alias("mem"), pwr0.alias("pwr"), F.col("network_latency").alias("lat"),
              F.col("disk_io").alias("dio"), cost0.alias("cost"), F.lit(0).alias("n_impr")]
    trace_t = "array<struct<iteration:int,current_cost:double,neighbor_cost:double,is_improvement:boolean>>"
    if trace:
        fields.append(F.array().cast(trace_t).alias("trace"))
    init = F.struct(*fields)

    def accepted(acc, i, nb, ncost):
        better = ncost < acc["cost"]
        out = [F.when(better, nb[k]).otherwise(acc[k]).alias(k) for k in ("cpu", "mem", "pwr", "lat", "dio")]
        out += [F.when(better, ncost).otherwise(acc["cost"]).alias("cost"),
                (acc["n_impr"] + better.cast("int")).alias("n_impr")]
        if trace:
            out.append(F.concat(acc["trace"], F.array(F.struct(
                i.alias("iteration"), acc["cost"].alias("current_cost"), ncost.alias("neighbor_cost"),
                better.alias("is_improvement")))).alias("trace"))
        return F.struct(*out)

    def step(acc, i):
        mv, u = draw(ent, i)
        drawn = F.struct(mv.alias("mv"), u.alias("u"))
        return _let(_let(drawn, lambda d: _neighbour(acc, d["mv"], d["u"])), lambda nb: _let(
            cost_expr(nb["cpu"], nb["mem"], nb["pwr"], cpu_limit, mem_limit), lambda ncost: accepted(acc, i, nb, ncost)))

    res = F.aggregate(F.sequence(F.lit(0), F.lit(iterations - 1)), init, step)
    out = state.select("*", cost0.alias("initial_cost"), res.alias("__hc"))
    cols = [F.col(f"__hc.{k}").alias(f"best_{n}") for k, n in
            (("cpu", "cpu_utilization"), ("mem", "memory_usage"), ("pwr", "power_consumption"),
             ("lat", "network_latency"), ("dio", "disk_io"))]
    cols += [F.col("__hc.cost").alias("best_cost"), F.col("__hc.n_impr").alias("n_improvements")]
    if trace:
        cols.append(F.col("__hc.trace").alias("trace"))
    return out.select(*state.columns, "initial_cost", *cols)


def optimization_result(climbed: DataFrame, by: Sequence[str], cpu_limit: float = 80.0,
                        mem_limit: float = 85.0) -> DataFrame:
    """Reductions (>= 0) from start to best state and the advice texts."""
    zero = F.lit(0.0)
    bc, bm = F.col("best_cpu_utilization"), F.col("best_memory_usage")
    cpu_msg = F.when(bc > cpu_limit, F.lit(CPU_OVER)).when(bc < cpu_limit * 0.6, F.lit(CPU_LOW))
    mem_msg = F.when(bm > mem_limit, F.lit(MEM_OVER)).when(bm < mem_limit * 0.7, F.lit(MEM_LOW))
    return climbed.select(
        *by,
        F.greatest(zero, F.col("cpu_utilization") - bc).alias("cpu_reduction"),
        F.greatest(zero, F.col("memory_usage") - bm).alias("memory_reduction"),
        F.greatest(zero, F.col("power_consumption") - F.col("best_power_consumption")).alias("power_reduction"),
        "best_cost",
        F.concat_ws(" | ", cpu_msg, mem_msg).alias("recommendations"))


def savings(climbed: DataFrame, by: Sequence[str], cpu: str = "cpu_utilization", memory: str = "memory_usage") -> DataFrame:
    """Current vs optimised usage, % saving, and recommended limits
    clip(round_half_even(opt + 5)) to 75..85 (cpu) and 80..90 (memory).  ``cpu`` and ``memory`` are the columns
    of current usage, for example mean predictions."""
    cur = (F.col(cpu) + F.col(memory)) / 2.0
    opt = (F.col("best_cpu_utilization") + F.col("best_memory_usage")) / 2.0

    def limit(x, lo, hi):
        return F.bround(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x + 5.0)), 0).cast("int")
    return climbed.select(
        *by, cur.alias("current_usage"), F.col(cpu).alias("current_cpu_usage"),
        F.col(memory).alias("current_memory_usage"), opt.alias("optimized_usage"),
        F.col("best_cpu_utilization").alias("optimized_cpu_usage"),
        F.col("best_memory_usage").alias("optimized_memory_usage"),
        ((cur - opt) / (cur + F.lit(1e-9)) * 100.0).alias("potential_savings"),
        limit(F.col("best_cpu_utilization"), 75, 85).alias("cpu_limit"),
        limit(F.col("best_memory_usage"), 80, 90).alias("memory_limit"))
