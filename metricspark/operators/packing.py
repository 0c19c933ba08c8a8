"""First-fit packing of tasks into capacity-limited slots, one independent problem per group.

Tasks are taken by priority (desc), then task id; each goes to the first slot
whose cpu and memory stay within the limits, else it stays unplaced.

Exact and bounded per task: a group is processed in rounds of at most
``chunk`` tasks.  Each round folds the next chunk of every group (an
``aggregate`` over an array of at most ``chunk`` structs) starting from the
group's slot loads.  Slot loads only grow, so a later task that does not fit
the loads at the end of a round can never be placed: such tasks are settled
as unplaced by a plain filter, and only tasks that still fit go to the next
round.  Every round places at least one task per active group, so a group
needs more rounds only while it keeps placing.  Lineage is cut after every
round with ``checkpoint()`` (the cluster's shared checkpoint dir).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import salted_join
from ..plans.order import first_n_per_entity

#: Tasks of one group in a partition of the join with the groups' slots.
ROWS_PER_SALT, MAX_SALTS = 2_000_000, 256
# Scheduling suggestions (fixed values).
SUGGEST_PLACED = "Prioritize high-CPU tasks in lower-load intervals and cap concurrent memory-heavy jobs."  # noqa: E501
SUGGEST_NONE = "No scheduling actions required for current load."


def _fits_any(slots: Column, cpu: Column, mem: Column, cpu_limit: float, mem_limit: float) -> Column:
    return F.exists(slots, lambda s: (s["cpu"] + cpu <= cpu_limit) & (s["mem"] + mem <= mem_limit))


def infeasible(tasks: DataFrame, cpu_col: str = "cpu_req", mem_col: str = "memory_req",
               cpu_limit: float = 80.0, mem_limit: float = 85.0) -> DataFrame:
    """Tasks that exceed a limit on their own (no slot can ever take them)."""
    c, m = F.coalesce(F.col(cpu_col), F.lit(5.0)), F.coalesce(F.col(mem_col), F.lit(10.0))
    return tasks.where((c > cpu_limit) | (m > mem_limit)).withColumn(
        "reason", F.when(c > cpu_limit, F.lit("cpu")).otherwise(F.lit("memory")))


def first_fit(tasks: DataFrame, group_col: str = "group_id", id_col: str = "task_id",
              priority_col: str = "priority", cpu_col: str = "cpu_req", mem_col: str = "memory_req",
              slots: int = 24, cpu_limit: float = 80.0, mem_limit: float = 85.0,
              chunk: int = 512, max_rounds: int = 10_000) -> DataFrame:
    """``tasks`` plus ``slot`` (0-based, NULL = unplaced)."""
    t = tasks.select(
        group_col, id_col, priority_col,
        F.coalesce(F.col(cpu_col).cast("double"), F.lit(5.0)).alias("__c"),
        F.coalesce(F.col(mem_col).cast("double"), F.lit(10.0)).alias("__m"),
        F.struct((-F.coalesce(F.col(priority_col), F.lit(0))).alias("p"), F.col(id_col).alias("i")).alias("__ord"))
    largest = t.groupBy(group_col).count().agg(F.max("count")).first()[0] or 0
    salts = max(1, min(MAX_SALTS, -(-largest // ROWS_PER_SALT)))
    slot_t = "array<struct<cpu:double,mem:double>>"
    empty = F.array_repeat(F.struct(F.lit(0.0).alias("cpu"), F.lit(0.0).alias("mem")), slots).cast(slot_t)
    state = None               # (group, __slots) after the last round; absent group = empty slots
    cand = t
    decided = []
    for _ in range(max_rounds):
        head = first_n_per_entity(cand, [group_col], "__ord", chunk)
        grouped = head.groupBy(group_col).agg(
            F.array_sort(F.collect_list(F.struct("__ord", id_col, "__c", "__m"))).alias("__items"),
            F.max("__ord").alias("__last"))
        if state is not None:
            grouped = grouped.join(state, group_col, "left")
            start = F.coalesce(F.col("__slots"), empty)
        else:
            start = empty

        def step(acc, it):
            fits = F.transform(acc["slots"], lambda s: (s["cpu"] + it["__c"] <= cpu_limit)
                               & (s["mem"] + it["__m"] <= mem_limit))

            def put(idx):
                new_slots = F.transform(acc["slots"], lambda s, k: F.when(
                    k + 1 == idx, F.struct((s["cpu"] + it["__c"]).alias("cpu"), (s["mem"] + it["__m"]).alias("mem")))
                    .otherwise(s))
                placed = F.concat(acc["placed"], F.array(F.struct(
                    it[id_col].alias("id"), F.when(idx > 0, (idx - 1).cast("int")).alias("slot"))))
                return F.struct(new_slots.alias("slots"), placed.alias("placed"))
            # The place (1-based, 0 = none) is bound to a name: written out, it is searched anew for every slot.
            return F.transform(F.array(F.array_position(fits, True)), put)[0]

        init = F.struct(start.alias("slots"),
                        F.array().cast(f"array<struct<id:{tasks.schema[id_col].dataType.simpleString()},slot:int>>").alias("placed"))
        folded = grouped.select(group_col, "__last", F.aggregate("__items", init, step).alias("__r")).select(
            group_col, "__last", F.col("__r.slots").alias("__slots"), F.col("__r.placed").alias("__placed"))
        folded = folded.checkpoint()
        decided.append(folded.select(group_col, F.explode("__placed").alias("d")).select(
            group_col, F.col("d.id").alias(id_col), F.col("d.slot").alias("slot")))
        if largest <= chunk:        # one round holds every group whole
            break
        state = folded.select(group_col, "__slots")
        # A group with very many tasks is spread over several partitions by a salt of the task.
        rest = salted_join(cand, folded.select(group_col, "__last", "__slots"), [group_col], id_col, salts).where(
            F.col("__ord") > F.col("__last"))
        fits = _fits_any(F.col("__slots"), F.col("__c"), F.col("__m"), cpu_limit, mem_limit)
        # Tasks that no longer fit anywhere are settled (loads only grow).
        decided.append(rest.where(~fits).select(group_col, id_col, F.lit(None).cast("int").alias("slot")))
        cand = rest.where(fits).select(*t.columns).checkpoint()
        if cand.isEmpty():
            break
    else:
        raise RuntimeError("first_fit did not converge within max_rounds")
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return tasks.join(out, [group_col, id_col], "left")


def schedule_summary(scheduled: DataFrame, group_col: str = "group_id") -> DataFrame:
    g = scheduled.groupBy(group_col).agg(F.count_if(F.col("slot").isNotNull()).alias("scheduled_count"),
                                         F.count(F.lit(1)).alias("total_tasks"))
    return g.select(
        group_col, "scheduled_count", "total_tasks",
        F.when(F.col("total_tasks") > 0, F.col("scheduled_count") * 100.0 / F.col("total_tasks"))
        .otherwise(F.lit(0.0)).alias("success_rate"),
        F.when(F.col("scheduled_count") > 0, F.lit(SUGGEST_PLACED)).otherwise(F.lit(SUGGEST_NONE)).alias("suggestion"))


def slot_loads(scheduled: DataFrame, group_col: str = "group_id", id_col: str = "task_id",
               priority_col: str = "priority", cpu_col: str = "cpu_req", mem_col: str = "memory_req") -> DataFrame:
    """Per (group, slot): cpu and memory load, task count and task ids in placement order.
    A slot holds a bounded number of tasks (capacity / smallest requirement)."""
    placed = scheduled.where(F.col("slot").isNotNull())
    g = placed.groupBy(group_col, "slot").agg(
        F.sum(F.coalesce(F.col(cpu_col).cast("double"), F.lit(5.0))).alias("cpu"),
        F.sum(F.coalesce(F.col(mem_col).cast("double"), F.lit(10.0))).alias("memory"),
        F.count(F.lit(1)).alias("n_tasks"),
        F.array_sort(F.collect_list(F.struct((-F.coalesce(F.col(priority_col), F.lit(0))).alias("p"), F.col(id_col).alias("i"))))
        .alias("__ids"))
    return g.select(group_col, "slot", "cpu", "memory", "n_tasks",
                    F.concat_ws(",", F.transform("__ids", lambda s: s["i"].cast("string"))).alias("task_ids"))
