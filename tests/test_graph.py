"""Upsert, reset, store, links, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave import schema
from arcweave.functions import entities
from arcweave.operators import dedup, graph, links
from arcweave.streaming.upsert import merge_stream, windowed_links

T0 = 99
NODES = [("a", True, 1), ("b", None, None)]
OLD = [("a", "b", 2, 1, None)]
EDGES = [(1, "a", "b"), (2, "a", "b"), (3, "b", "a"), (4, "c", "c"), (5, None, "x"), (6, "x", None)]


def tables(spark):
    return spark.createDataFrame(NODES, schema.NODES), spark.createDataFrame(OLD, schema.LINKS), spark.createDataFrame(EDGES, schema.EDGES)


def test_upsert(spark):
    nodes, old, edges = tables(spark)
    assert set(map(tuple, graph.merge_nodes(nodes, edges, T0).collect())) == {("a", True, 1), ("b", False, T0), ("c", False, T0)}
    new = graph.merge_links(old, edges, T0)
    assert set(map(tuple, new.collect())) == {("a", "b", 4, 1, T0), ("b", "a", 1, T0, None), ("c", "c", 1, T0, None)}
    merged = graph.merge_nodes(nodes, edges, T0)
    assert [r.title for r in graph.reset_nodes(merged).collect()] == ["a"]
    assert graph.reset_links(merged, new).count() == 0


def test_null_weight_stays_and_untouched_nodes_stay(spark):
    old = spark.createDataFrame([("a", "b", None, 1, None), ("q", "r", 5, 1, 2)], schema.LINKS)
    got = {(r.src, r.dst): r.weight for r in graph.merge_links(old, spark.createDataFrame(EDGES, schema.EDGES), T0).collect()}
    assert got[("a", "b")] is None and got[("q", "r")] == 5
    nodes = spark.createDataFrame([("z", None, None)], schema.NODES)
    assert ("z", None, None) in set(map(tuple, graph.merge_nodes(nodes, spark.createDataFrame(EDGES, schema.EDGES), T0).collect()))


def test_empty(spark):
    none = spark.createDataFrame([], schema.EDGES)
    nodes, old, _ = tables(spark)
    assert set(map(tuple, graph.merge_links(old, none, T0).collect())) == set(OLD)
    assert set(map(tuple, graph.merge_nodes(nodes, none, T0).collect())) == set(NODES)
    assert graph.graph_stats(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.LINKS)).first()[:] == (0, 0, 0, 0)


def test_store_two_loads_are_one(spark, tmp_path):
    edges = spark.createDataFrame(EDGES, schema.EDGES)
    one, two = graph.GraphStore(spark, str(tmp_path / "one")), graph.GraphStore(spark, str(tmp_path / "two"))
    one.merge(edges, 5)
    two.merge(edges.where("edge_id <= 2"), 5)
    two.merge(edges.where("edge_id > 2"), 6)
    weights = lambda s: {(r.src, r.dst, r.weight) for r in s.links().collect()}
    assert weights(one) == weights(two) and sum(w for *_, w in weights(one)) == 4
    assert one.stats().first().n_nodes == 3
    one.reset()
    assert one.nodes().count() == one.links().count() == 0


def test_store_folds_like_single_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "MOST_DELTAS", 2)
    rng = random.Random(7)
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    start = spark.createDataFrame(NODES, schema.NODES), spark.createDataFrame([*OLD, ("b", "c", None, 1, 2)], schema.LINKS)
    store.replace(*start)
    nodes, links_ = {r.title: tuple(r) for r in start[0].collect()}, {(r.src, r.dst): tuple(r) for r in start[1].collect()}
    for clock in range(10, 15):
        rows = [(k, rng.choice("abcd"), rng.choice(["a", "b", "e", None])) for k in range(4)]
        edges = spark.createDataFrame(rows, schema.EDGES)
        old = spark.createDataFrame(list(nodes.values()), schema.NODES), spark.createDataFrame(list(links_.values()), schema.LINKS)
        nodes = {r.title: tuple(r) for r in graph.merge_nodes(old[0], edges, clock).collect()}
        links_ = {(r.src, r.dst): tuple(r) for r in graph.merge_links(old[1], edges, clock).collect()}
        store.merge(edges, clock)
        assert {tuple(r) for r in store.nodes().collect()} == set(nodes.values())
        assert {tuple(r) for r in store.links().collect()} == set(links_.values())
    assert len(list((tmp_path / "g/log").glob("*.json"))) == 2 and len([p for p in (tmp_path / "g").iterdir() if p.name != "log"]) <= 5


def test_a_batch_counts_once(spark, tmp_path):
    edges = spark.createDataFrame(EDGES, schema.EDGES)
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    assert store.merge(edges, 1, "s", 0) and not store.merge(edges, 1, "s", 0) and store.merge(edges, 2, "t", 0) and store.merge(edges, 3, "s", 1)
    assert {r.weight for r in store.links().collect()} == {3, 6}
    broken = edges.withColumn("src", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        store.merge(broken, 4, "s", 2)
    assert {r.weight for r in store.links().collect()} == {3, 6} and store.merge(edges, 4, "s", 2)


def test_self_links_have_one_end(spark):
    links_ = spark.createDataFrame([("a", "b", 2, 1, None), ("c", "c", 5, 1, None)], schema.LINKS)
    nodes = spark.createDataFrame([("a", None, 1), ("b", None, 1), ("c", None, 1)], schema.NODES)
    assert graph.graph_stats(nodes, links_).first()[:] == (3, 2, 7, 3)


def test_hot_ends_are_split(spark):
    """The semi join on an end that holds a third of the links is split by the adaptive planner."""
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in keys}
    for k, x in keys.items():
        spark.conf.set(k, x)
    try:
        links_ = spark.range(0, 200_000, 1, 8).selectExpr("md5(string(id)) as src", "if(id % 3 = 0, 'hot', string(id)) as dst", "1L as weight", "1L as created_at", "1L as last_updated")
        nodes = links_.selectExpr("explode(array(src, dst)) as title").distinct().selectExpr("title", "true as is_base", "1L as processed_at")
        kept = graph.reset_links(nodes, links_)
        assert len(kept.collect()) == 200_000
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_category_similarity(spark):
    vectors = spark.createDataFrame([(1, [3.0, 4.0], "x"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [1.0], "x"), (5, [None, 1.0], "x")], "vec_id int, embedding array<float>, category string")
    some = spark.createDataFrame([("e", [1.0, 0.0]), ("f", [0.0, 2.0]), (None, None)], "category string, vector array<float>")
    got = {(r.vec_id, r.category): r.similarity for r in entities.category_similarity(vectors, some).collect()}
    assert len(got) == 15 and abs(got[1, "e"] - 0.6) < 1e-9 and abs(got[1, "f"] - 0.8) < 1e-9
    assert {k for k, x in got.items() if x is not None} == {(1, "e"), (1, "f")}
    assert entities.category_similarity(vectors, some.limit(0)).count() == 0


def test_once(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None), (2, None), (3, "c")]
    df = spark.createDataFrame(rows, "page_id bigint, text string").repartition(3)
    for limit in (100, 0):
        monkeypatch.setattr(dedup, "SEEN_TWICE", limit)
        assert sorted(map(tuple, dedup.once(df).collect()), key=str) == sorted(set(rows), key=str)


def test_link_building(spark):
    pages = spark.createDataFrame([("t", ["x", "y", "x", None]), (None, ["x"]), ("u", None), ("v", [])], schema.PAGE_ENTITIES)
    assert sorted(map(tuple, links.page_links(pages).collect())) == [("t", "x"), ("t", "y")]
    text = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "a", "b")], schema.EDGES)
    image = spark.createDataFrame([(1, "a", "c"), (2, "c", "c")], schema.EDGES)
    got = links.first_links(links.union_links(text, image)).orderBy("source_rank", "edge_id").collect()
    assert [(r.src, r.dst) for r in got] == [("a", "b"), ("a", "c"), ("c", "c")]


def test_stream_equals_batch(spark, tmp_path):
    edges = spark.createDataFrame(EDGES, schema.EDGES)
    edges.repartition(3).write.parquet(str(tmp_path / "in"))
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    source = spark.readStream.schema(schema.EDGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge_stream(source, store, str(tmp_path / "c")).awaitTermination()
    want = {(r.src, r.dst, r.weight) for r in graph.merge_links(spark.createDataFrame([], schema.LINKS), edges, 1).collect()}
    assert {(r.src, r.dst, r.weight) for r in store.links().collect()} == want
    timed = edges.withColumn("at", F.lit("2026-01-01 10:30:00").cast("timestamp"))
    assert sum(r.n for r in windowed_links(timed, "at").collect()) == len(EDGES)
