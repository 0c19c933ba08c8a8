"""Hill climbing and first-fit packing properties; packing against a plain Python first-fit."""

import pytest
from pyspark.sql import functions as F

from metricspark.operators import packing, rightsize
from metricspark.sources.tables import load_metrics, load_tasks

from conftest import SF001


def test_hill_climb_cost_never_rises_and_is_repeatable(spark):
    st = rightsize.initial_state(load_metrics(spark, SF001), ["host_id"])
    a = rightsize.hill_climb(st, "host_id", 100, cpu_limit=9.0, trace=True)
    rows = a.collect()
    assert rows
    for r in rows:
        assert r.best_cost <= r.initial_cost
        costs = [t.current_cost for t in r.trace]
        assert all(x >= y for x, y in zip(costs, costs[1:]))
        assert sum(t.is_improvement for t in r.trace) == r.n_improvements
    b = {r.host_id: r.best_cost for r in rightsize.hill_climb(st, "host_id", 100, cpu_limit=9.0).collect()}
    assert all(b[r.host_id] == r.best_cost for r in rows)


def test_absent_columns_start_at_zero(spark):
    df = spark.createDataFrame([(1, 90.0)], "host_id long, cpu_utilization double")
    st = rightsize.initial_state(df, ["host_id"]).collect()[0]
    assert st.memory_usage == 0.0 and st.power_consumption == 0.0


def test_advice_texts(spark):
    df = spark.createDataFrame([(1, 10.0, 95.0, 100.0, 0.0, 0.0)],
                               "host_id long, cpu_utilization double, memory_usage double, "
                               "power_consumption double, network_latency double, disk_io double")
    c = rightsize.hill_climb(df, "host_id", 1)
    r = rightsize.optimization_result(c, ["host_id"]).collect()[0]
    assert r.recommendations == f"{rightsize.CPU_LOW} | {rightsize.MEM_OVER}"


def _python_first_fit(tasks, slots, cl, ml):
    out = {}
    loads = [[0.0, 0.0] for _ in range(slots)]
    for t in sorted(tasks, key=lambda t: (-t["priority"], t["task_id"])):
        for i, s in enumerate(loads):
            if s[0] + t["cpu_req"] <= cl and s[1] + t["memory_req"] <= ml:
                s[0] += t["cpu_req"]
                s[1] += t["memory_req"]
                out[t["task_id"]] = i
                break
        else:
            out[t["task_id"]] = None
    return out


def test_first_fit_matches_brute_force_and_rounds(spark):
    tasks = load_tasks(spark, SF001)
    by_group = {}
    for r in tasks.collect():
        by_group.setdefault(r.group_id, []).append(r.asDict())
    expect = {}
    for g, ts in by_group.items():
        expect.update(_python_first_fit(ts, 3, 80.0, 85.0))
    for chunk in (512, 2):        # chunk=2 forces many rounds with carried slot loads
        got = {r.task_id: r.slot for r in packing.first_fit(tasks, slots=3, chunk=chunk).collect()}
        assert got == expect


def test_hot_group_first_fit(spark):
    # one group holds a third of all tasks
    tasks = load_tasks(spark, SF001).withColumn(
        "group_id", F.when(F.col("task_id") % 3 == 0, F.lit(-1)).otherwise(F.col("group_id")))
    hot = [r.asDict() for r in tasks.where("group_id = -1").collect()]
    expect = _python_first_fit(hot, 24, 80.0, 85.0)
    got = {r.task_id: r.slot for r in packing.first_fit(tasks, slots=24, chunk=64).where("group_id = -1").collect()}
    assert got == expect


def test_no_slot_over_limit(spark):
    s = packing.first_fit(load_tasks(spark, SF001), slots=3)
    loads = packing.slot_loads(s).collect()
    assert all(r.cpu <= 80.0 and r.memory <= 85.0 for r in loads)
    summ = packing.schedule_summary(s).collect()
    assert all(0.0 <= r.success_rate <= 100.0 for r in summ)


def test_text_ids_and_missing_values(spark):
    rows = [("g", "Task_1", None, None, None), ("g", "Task_2", 5.0, 10.0, 2)]
    got = packing.first_fit(spark.createDataFrame(
        rows, "group_id string, task_id string, cpu_req double, memory_req double, priority int"), slots=2, cpu_limit=6.0)
    assert {r.task_id: r.slot for r in got.collect()} == {"Task_2": 0, "Task_1": 1}
    loads = {r.slot: (r.cpu, r.memory) for r in packing.slot_loads(got).collect()}
    assert loads == {0: (5.0, 10.0), 1: (5.0, 10.0)}


def test_ids_of_any_type_climb_and_do_not_repeat(spark):
    state = spark.createDataFrame([(f"host-{k}", 1 + 65536 * k, 50.0, 50.0, 100.0, 10.0, 10.0) for k in range(3)],
                                  "name string, host long, cpu_utilization double, memory_usage double, power_consumption double, "
                                  "network_latency double, disk_io double")
    for col in ("name", "host"):
        got = [tuple(r) for r in rightsize.hill_climb(state, col, 40).select(
            "best_cpu_utilization", "best_memory_usage", "best_power_consumption").collect()]
        assert len(set(got)) == 3 and got == [tuple(r) for r in rightsize.hill_climb(state, col, 40).select(
            "best_cpu_utilization", "best_memory_usage", "best_power_consumption").collect()]


def test_a_step_evaluates_its_neighbour_once(spark):
    st = rightsize.initial_state(load_metrics(spark, SF001), ["host_id"])
    plan = rightsize.hill_climb(st, "host_id", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest") == 6     # once per changed resource of each move


def test_a_group_with_most_tasks_is_spread(spark, monkeypatch):
    tasks = spark.range(600).selectExpr("CASE WHEN id % 3 < 2 THEN 0 ELSE id END AS group_id", "id AS task_id",
                                        "5D + id % 16 AS cpu_req", "10D + id % 21 AS memory_req", "CAST(id % 5 AS INT) AS priority")
    plain = sorted(map(tuple, packing.first_fit(tasks, chunk=16).collect()))
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 50)
    assert sorted(map(tuple, packing.first_fit(tasks, chunk=16).collect())) == plain


def test_a_task_searches_its_slot_once(spark):
    """The place is bound to a name: the search over the slots does not stand inside their update."""
    tasks = spark.range(40).selectExpr("id % 3 AS group_id", "id AS task_id", "30D AS cpu_req", "10D AS memory_req", "1 AS priority")
    seen = []

    def kept(df, *a, _checkpoint=type(tasks).checkpoint, **kw):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return _checkpoint(df, *a, **kw)
    with pytest.MonkeyPatch.context() as mp:
        mp.setattr(type(tasks), "checkpoint", kept)
        got = {r.task_id: r.slot for r in packing.first_fit(tasks, slots=4).collect()}
    assert seen and all(p.count("array_position") == 1 for p in seen)
    assert got == {k: (k // 3) // 2 if k // 3 < 8 else None for k in range(40)}
