"""Pipeline stages on odd tables; the cascade's saved work; samples and joins that do not depend on layout."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricspark.llm import decontam, license, minhash, pii, quality
from metricspark.llm import text as T
from metricspark.llm.graph import components

SF = "/root/testdata/sf0.001"
GOOD = " ".join(f"word{k}" for k in range(80)) + "."
MAIL = GOOD + " write to bob@example.com now"
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, GOOD), (4, GOOD), (5, GOOD), (6, MAIL), (None, GOOD + " tail"), (None, None),
        (7, "w " * 30_000), (8, "x" * 200_000), (9, " ".join(f"other{k}" for k in range(60)))]
CLASHES = "node long, digest string, label string, rank int, __node long, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Missing and empty texts and ids, repeated rows, long texts, and columns with inner names."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 10 + k, f"d{k}", "l", k, 77, -k) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A benchmark with items without an id, with one id twice, without words, and repeated."""
    path = tmp_path_factory.mktemp("odd-benchmark")
    items = [(None, " ".join(f"other{k}" for k in range(20, 40))), (None, "none of the words is here at all"), (3, None), (3, ""),
             (3, "three one " * 6), (3, "three two " * 6), (4, "-!?"), (4, "-!?")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


STAGES = dict(corpus_pipeline.STAGES[:-1])
KEPT = {  # which rows each stage keeps, by their place in ROWS
    "quality_rules": {3, 4, 5, 6, 7, 11},
    "near_dedup": {0, 1, 2, 3, 8, 9, 10, 11},
    "decontaminate": set(range(11)),
    "mask_personal_data": set(range(12)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_an_odd_table(spark, odd, sf_dir, name):
    got = STAGES[name](spark, odd, sf_dir)
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = {r["rank"]: r for r in got.collect()}
    want = KEPT[name]
    if name == "near_dedup":   # of the two rows of document 4 either one stays
        assert len(rows) == len(want) and (rows.keys() | {3}) - {4} == want | {3}
    else:
        assert rows.keys() == want
    before = {r["rank"]: r for r in odd.collect()}
    for k, r in rows.items():
        if name != "mask_personal_data" or k != 6:
            assert r == before[k]
    assert STAGES[name](spark, odd.limit(0), sf_dir).count() == 0


def test_masked_text_and_its_length(spark, odd, sf_dir):
    r = [r for r in pii.mask(odd).collect() if r["rank"] == 6][0]
    assert "bob@" not in r.text and r.n_chars == len(r.text)


def test_items_without_an_id_and_with_one_id(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "x " + "three one " * 6 + "y " + "three two " * 6), (2, None)], "doc_id long, text string")
    got = decontam.leaks(docs, items).collect()
    assert sorted((r.item_id, r.distance) for r in got if r.distance == 0) == [(3, 0), (3, 0)]
    both = spark.createDataFrame([(None, "alpha beta " * 8), (None, "gamma delta " * 8)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "alpha beta " * 8 + "gamma delta " * 8)], "doc_id long, text string")
    got = [(r.item_id, r.distance) for r in decontam.leaks(docs, both).collect()]
    assert got.count((None, 0)) == 2


# --- quality cascade --------------------------------------------------------------------------------------------


def test_counts_of_later_rules_are_not_taken(monkeypatch):
    taken = Counter()
    plain = quality._repeat_words
    monkeypatch.setattr(quality, "_repeat_words", lambda codes: taken.update(repeats=1) or plain(codes))
    texts = ["too short"] * 5 + [GOOD]
    rules = {r.name: r for r in quality.BASE + quality.RULES}
    cheap_first = [rules["short"], rules["symbols"], rules["repeats"]]
    kept = [not any(r.rejects(d) for r in cheap_first) for d in quality.measured(texts)]
    assert kept == [False] * 5 + [True] and taken["repeats"] == 1
    for d in quality.measured(texts[:5]):
        assert rules["short"].rejects(d) and set(vars(d)) == {"text", "codes"}


def test_each_rule_pays_for_its_own_counts(monkeypatch):
    clock = iter(range(10**6))
    costs = Counter()

    def slow(codes):
        costs["calls"] += 1
        next(clock), next(clock), next(clock)
        return 0
    monkeypatch.setattr(quality.time, "perf_counter", lambda: next(clock))
    monkeypatch.setattr(quality, "_repeat_words", slow)
    rules = {r.name: r for r in quality.BASE + quality.RULES}
    got = quality.timed([GOOD] * 3, (rules["short"], rules["repeats"], rules["repeats"]))
    assert [s for _, s in got] == [1, 10, 10] and costs["calls"] == 6


def test_the_cascade_orders_every_rule_and_reads_few_rows(spark, odd):
    got = quality.cascade(odd)
    assert {r.name for r in got} == {r.name for r in quality.BASE + quality.RULES} and len(got) == 9
    assert [r.name for r in quality.cascade(odd.limit(0))] == [r.name for r in quality.BASE + quality.RULES]


# --- samples and joins ------------------------------------------------------------------------------------------


def test_notices_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def found(d):
        return sorted((r.doc_id, r.paragraph, r.family, r.probability, r.match) for r in license.scan(d).collect())
    one = found(docs)
    assert one and found(docs.repartition(7, "text")) == one and found(docs.orderBy(F.desc("doc_id")).coalesce(1)) == one


def test_joins_with_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(T, "HOT", 4)
    rows = T.written(spark, spark.range(300).selectExpr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k",
                                                        "id AS v"), "t-rows")
    table = T.written(spark, spark.range(200).selectExpr("id AS k", "id * 2 AS w"), "t-table")
    assert T.frequent(rows, "k") == [7]

    def same(a, b):
        assert sorted(map(repr, a.select("k", "v", "w").collect())) == sorted(map(repr, b.select("k", "v", "w").collect()))
    for how in ("inner", "left"):
        same(T.join_unique(rows, table, "k", how), rows.join(table, "k", how))
    same(T.join_spread(rows, table, "k", "v", [7]), rows.join(table, "k"))
    lost = T.written(spark, rows.filter("v > 190"), "t-rows")
    same(T.join_unique(lost, table.filter("k <> 7"), "k", "left"), lost.join(table.filter("k <> 7"), "k", "left"))


def test_components_of_stars_and_chains(spark):
    star = [(0, k) for k in range(1, 400)]
    chain = [(1000 + k, 1001 + k) for k in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(star + chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(400)} | {1000 + k: 1000 for k in range(61)}


def test_pairs_at_the_threshold_share_a_band():
    """Measured loss of banding at a similarity of exactly 3/4, for small and larger unions."""
    rng = np.random.default_rng(5)
    for union, allowed in ((4, 8), (8, 4), (100, 2)):
        lost, n = 0, 4000
        for lo in range(0, n, 500):
            x = rng.integers(0, 2**63, (500, union), dtype=np.uint64)
            both = 3 * union // 4
            cut = both + (union - both) // 2
            left = [np.sort(r[:cut]) for r in x]
            right = [np.sort(np.concatenate([r[:both], r[cut:]])) for r in x]
            a, b = (minhash.band_keys(minhash.signatures(s)) for s in (left, right))
            lost += int((~(a == b).any(axis=1)).sum())
        assert lost <= allowed
