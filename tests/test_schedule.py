"""Schedules, coloring, scenarios and metrics."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcweave import schema
from arcweave.operators import coloring, graph, scenarios, schedule
from arcweave.operators.dictionary import number_rows
from arcweave.plans import config, evaluate


def edges(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], schema.EDGES)


def test_partition_id(spark):
    rows = spark.createDataFrame([("Part 137",), ("x5",), ("none",), (None,)], "t string")
    got = [r.p for r in rows.select(schedule.partition_id(F.col("t")).alias("p")).collect()]
    assert got[:2] == [7, 5] and 0 <= got[2] < 10 and got[3] is None
    assert rows.select(schedule.partition_id(F.col("t"), 10, 2).alias("p")).first().p == 7
    assert spark.createDataFrame([(8, 1)], "i int, j int").select(schedule.diagonal()).first()[0] == 3


def test_batches(spark):
    rows = spark.range(2500).select(F.col("id").alias("edge_id"), F.lit("a").alias("src"), F.lit("b1").alias("dst"))
    sizes = lambda s: sorted(r.n for r in schedule.batch_sizes(s).collect())
    assert sizes(schedule.sequential(rows)) == [500, 1000, 1000]
    assert sizes(schedule.naive_parallel(rows)) == [500, 1000, 1000]
    assert sizes(schedule.mix_and_batch(rows)) == [500, 1000, 1000]
    assert schedule.sequential(rows.limit(0)).count() == 0


def test_number_rows(spark):
    df = spark.range(1000).repartition(7).orderBy(F.desc("id"))
    assert [(r.id, r.n) for r in number_rows(df, "n").orderBy("n").collect()] == [(999 - k, k) for k in range(1000)]
    assert number_rows(spark.range(0), "n").count() == 0


def test_coloring_examples(spark):
    got = coloring.color_edges(edges(spark, [("a", "b"), ("c", "d"), ("b", "c"), ("a", "a"), ("e", "f")])).orderBy("edge_id").collect()
    assert [r.color for r in got] == [0, 0, 1, 1, 0]
    star = coloring.color_edges(edges(spark, [("h", str(k)) for k in range(5)])).orderBy("edge_id").collect()
    assert [r.color for r in star] == [0, 1, 2, 3, 4]
    assert coloring.color_edges(edges(spark, [])).count() == 0
    assert coloring.color_edges(edges(spark, [("a", None), (None, None)])).count() == 0


def first_fit(pairs):
    used, out = {}, []
    for u, v in pairs:
        c = 0
        while c in used.setdefault(u, set()) | used.setdefault(v, set()):
            c += 1
        used[u].add(c)
        used[v].add(c)
        out.append(c)
    return out


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_coloring_is_first_fit(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(7)), str(rng.randrange(9))) for _ in range(25)]
    df = edges(spark, pairs)
    for most in (10**6, 3):
        got = coloring.color_edges(df, most)
        assert [r.color for r in got.orderBy("edge_id").collect()] == first_fit(pairs)
        assert coloring.color_violations(got).first()[:] == (0, 0)


def test_violations_are_seen(spark):
    bad = spark.createDataFrame([(1, "a", "b", 0, "a"), (2, "a", "c", 0, "a"), (3, "d", "e", 1, "d")], "edge_id int, src string, dst string, color int, component string")
    assert coloring.color_violations(bad).first()[:] == (1, 1)


def test_large_star(spark):
    star = spark.range(30_000).selectExpr("id as edge_id", "'hub' as src", "string(id) as dst")
    got = coloring.color_edges(star)
    assert got.where("color <> edge_id").count() == 0 and coloring.color_count(got).first()[:] == (30_000, 30_000, 1)
    assert coloring.color_count(got.limit(0)).first()[:] == (0, 0, 0)


def test_color_batches_touch_an_entity_once_a_wave(spark):
    pairs = [(a, b) for a in "abcd" for b in "abcd" if a != b]
    assert schedule.contention(schedule.color_batch(coloring.color_edges(edges(spark, pairs)), 1)).count() == 0


def test_scenarios(spark):
    df = edges(spark, [("h", x) for x in "abca"] + [("g", "z"), ("g", None), (" ", "q")])
    assert sorted((r.src, r.dst) for r in scenarios.single_hub_scenario(df, "h").collect()) == sorted((x, y) for x in "abc" for y in "abc" if x != y)
    assert scenarios.single_hub_scenario(df, "g").count() == scenarios.single_hub_scenario(df, "nobody").count() == 0
    assert [tuple(r) for r in scenarios.top_hubs(df, 5).collect()] == [("h", 3), ("g", 1)]
    assert scenarios.single_hub_scenario(df, "h", 2).count() == 2


def test_evaluation_loads_the_same_graph(spark, tmp_path):
    df = edges(spark, [(f"n{a}", f"n{b}") for a in range(6) for b in range(6) if a != b] * 2)
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    weights = []
    for s in config.STRATEGIES:
        record = evaluate.run_once(store, s, "s", df, 1, 7)
        assert record[7] == 100.0 and record[0] == s.name
        weights.append({(r.src, r.dst, r.weight) for r in store.links().collect()})
    assert all(w == weights[0] for w in weights) and len(weights[0]) == 30

    class Failing(graph.GraphStore):
        calls = 0

        def merge(self, edges, clock, *rest):
            Failing.calls += 1
            if edges.where("edge_id = 0").count():
                raise RuntimeError("deadlock")
            return super().merge(edges, clock, *rest)

    record = evaluate.run_once(Failing(spark, str(tmp_path / "f")), config.Strategy("sequential", "S", 20, max_retries=2), "s", df, 1, 7)
    assert Failing.calls == 3 + 2 and round(record[7], 3) == round(100 * 40 / 60, 3) and record[12] > 0
    metrics = spark.createDataFrame([record], schema.METRICS)
    assert evaluate.summary(metrics).first().runs == 1
    assert spark.read.json(evaluate.save(metrics, str(tmp_path))).count() == 1
    assert evaluate.rates(0, 0, 0.0) == (0.0, 0.0) and evaluate.CoreMonitor().stop() == 0.0


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data: {output: o}\nalgorithms:\n  mix_and_batch_v2: {name: M, num_partitions: 4, hash_digits: 2}\n  sapoc: {name: S}\n")
    got = config.load(str(path))
    assert got.output == "o" and {(s.kind, s.name) for s in got.strategies} == {("mix_and_batch", "M"), ("batched_sequential", "S")}
    assert [s.kind for s in got.strategies] == ["mix_and_batch", "batched_sequential"]
    order = config.from_mapping({"algorithms": {"color_batch": {}, "sequential_b": {}, "apoc": {}, "sequential_a": {}}}).strategies
    assert [s.name for s in order] == ["sequential_b", "sequential_a", "apoc", "color_batch"]
    assert config.from_mapping({}) == config.Config()
