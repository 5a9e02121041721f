"""Files in and out, the pipeline, and the named queries' contract."""

import json
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arcweave import schema
from arcweave.functions import models
from arcweave.plans import config, pipeline
from arcweave.sources import files


def test_link_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"LINKS_TO": [{"from": "a", "to": "b"}, {"from": "a", "to": None}]}, indent=2))
    df = files.read_link_document(spark, str(tmp_path / "d.json"))
    assert [tuple(r) for r in df.orderBy("edge_id").collect()] == [(0, "a", "b"), (1, "a", None)]
    files.write_link_document(df, str(tmp_path / "out.json"))
    (written,) = (tmp_path / "out.json").glob("part-*")
    assert json.loads(written.read_text()) == {"LINKS_TO": [{"from": "a", "to": "b"}, {"from": "a", "to": None}]}


def test_documents_come_back_in_order(spark, tmp_path):
    rows = [(7 * k % 101, f"s{k}", None if k % 9 == 0 else 'q"\n') for k in range(101)]
    df = spark.createDataFrame(rows, schema.EDGES).repartition(5)
    for size in (10, 1000):
        path = str(tmp_path / f"d{size}.json")
        files.write_link_document(df, path, size)
        got = [tuple(r) for r in files.read_link_document(spark, path).orderBy("edge_id").collect()]
        assert got == [(k, *r[1:]) for k, r in enumerate(sorted(rows))]
    files.write_link_document(df.limit(0), str(tmp_path / "none.json"))
    assert files.read_link_document(spark, str(tmp_path / "none.json")).count() == 0


def test_text_dir(spark, tmp_path):
    pages = spark.createDataFrame([("T\nOne line.\n",), ("",), (" \n",), ("Tür",), (None,)], "text string")
    files.write_text_dir(pages.repartition(2), str(tmp_path / "t"))
    assert sorted(r.text for r in files.read_text_dir(spark, str(tmp_path / "t")).collect()) == ["\n", " \n\n", "T\nOne line.\n\n", "Tür\n"]
    (tmp_path / "u").mkdir()
    (tmp_path / "u/a").write_bytes(b"T\xff\nx")
    (tmp_path / "u/b").write_bytes(b" ")
    assert files.text_dir_report(spark, str(tmp_path / "u")).first()[:] == (2, 2, 0, 1)


def test_records(spark):
    raw = [(1, '{"to": "b", "from": "a", "x": 1}'), (2, '{"from":"a","t'), (3, None), (4, '{"from": null, "to": "b"}'), (5, "text"), (6, "")]
    got = {tuple(r) for r in files.parse_link_records(spark.createDataFrame(raw, "edge_id bigint, record string")).collect()}
    assert got == {(1, "a", "b"), (4, None, "b")}
    back = files.link_json(spark.createDataFrame([(1, "a", 'q"')], schema.EDGES)).first()
    assert json.loads(back.record) == {"from": "a", "to": 'q"'}


def test_folders_and_pipeline(spark, tmp_path):
    texts, images = tmp_path / "t", tmp_path / "i"
    texts.mkdir()
    images.mkdir()
    (texts / "a").write_text("Page One\nThe harbour was built by Anna Kovalova and the River Institute in spring.\nNotes\nnothing of Bert Bertson here at all")
    (texts / "b").write_text("  \n ")
    for name in ("Old_Tower_2.JPG", "x.gif", "bad.png"):
        (images / name).write_bytes(name.encode())
    assert {r.path.rsplit("/", 1)[1] for r in files.read_image_dir(spark, str(images)).collect()} == {"Old_Tower_2.JPG", "bad.png"}

    def backend():
        def score(raw):
            if raw.startswith(b"bad"):
                raise ValueError
            return [("tower, spire", 0.9), ("screen", 0.5), ("low", 0.05)]
        return score

    settings = config.Config(str(texts), str(images), str(tmp_path / "o"), evaluate=False, runs=1, results=str(tmp_path / "r"), store=str(tmp_path / "g"))
    got = pipeline.run(spark, settings, classifier=backend)
    pairs = {(r.src, r.dst) for r in got.collect()}
    assert pairs == {("Page One", "Anna Kovalova"), ("Page One", "River Institute"), ("Old Tower", "tower")}
    saved = files.read_link_document(spark, str(tmp_path / "o/s3.json"))
    assert {(r.src, r.dst) for r in saved.collect()} == pairs
    ends = {("Anna Kovalova", "River Institute"), ("River Institute", "Anna Kovalova")}
    for name in ("s1", "s2"):
        assert {(r.src, r.dst) for r in files.read_link_document(spark, str(tmp_path / f"o/{name}.json")).collect()} == ends
    errors = pipeline.image_errors(files.read_image_dir(spark, str(images)), backend).collect()
    assert len(errors) == 1 and errors[0].path.endswith("bad.png") and errors[0].error.startswith("ValueError")
    # the evaluation reads what the pipeline wrote
    metrics = pipeline.run(spark, replace(settings, evaluate=True, strategies=config.STRATEGIES[:1])).collect()
    assert {(r.scenario, r.success_rate) for r in metrics} == {("s1", 100.0), ("s2", 100.0), ("s3", 100.0)}


def test_image_network():
    rng = np.random.default_rng(1)
    flat = np.full((300, 500, 3), 124, np.uint8)
    x = models.image_input(flat)
    assert x.shape == (1, 3, 224, 224) and np.allclose(x[0, 0], (124 / 255 - 0.485) / 0.229, atol=1e-5)
    assert models.resized(rng.integers(0, 256, (100, 40, 3)), 80).shape == (200, 80, 3)
    ramp = np.repeat(np.arange(100.0)[:, None], 3, 1)[None].repeat(100, 0)
    assert np.allclose(np.diff(models.resized(ramp, 50)[0, :, 0])[1:-1], 2)
    score = models.network_classifier(lambda v: np.array([[v.mean(), 3.0, 3.0, -9.0]]), ["a", "b", "c", "d"], lambda raw: flat, top=3)
    got = score(b"")
    assert [label for label, _ in got] == ["b", "c", "a"] and abs(sum(p for _, p in got) - 1) < 1e-3


def test_models_by_configuration(spark):
    assert models.recognizer("no_such_model") is models.rule_recognizer and not models.installed("")
    rows = spark.createDataFrame([("One sentence is here. Short. Another sentence is here.",), (None,)], "t string")
    got = [r.s for r in rows.select(models.split_sentences(F.col("t"), "no_such_model").alias("s")).collect()]
    assert got == [["One sentence is here.", "Another sentence is here."], None]


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p4_found", "merge_new_links"} <= set(sql)


def test_entry(spark):
    assert entry.entry(spark).where(F.col("weight") > 0).count() > 0
