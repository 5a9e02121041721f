"""Cleaning rules on crafted pages."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcweave.functions import entities, text
from arcweave.plans.pipeline import clean_pages

PAGES = [
    ("  T \none two three four five .Next\nfour words only here\nNotesworthy line stops it all\nnever seen line of five words", "T", "one two three four five. Next"),
    ("See also\nthis line has exactly five words", "See also", "this line has exactly five words"),
    ("T\nU.S.A is a big country", "T", "U. S. A is a big country"),
    ("T\nsee also one two three four", "T", "see also one two three four"),
    ("T\na b c\x1cd\x85e", "T", "a b c d e"),
    ("T", "T", ""),
]


def restated(page):
    """The rules again, line by line in Python."""
    first, *body = page.strip().split("\n")
    kept = []
    for line in body:
        if line.strip().startswith(text.TERMINATORS):
            break
        if len(line.split()) > 4:
            kept.append(line.strip())
    whole = re.sub(r"\s+", " ", "\n".join(kept))
    return first.strip(), re.sub(r"([.!?])([A-Z])", r"\1 \2", re.sub(r"\s+([.!?])", r"\1", whole)).strip()


def test_pages(spark):
    rows = [(i, p) for i, (p, *_) in enumerate(PAGES)] + [(90, " \n "), (91, None), (92, "")]
    got = {r.page_id: (r.title, r.text) for r in clean_pages(spark.createDataFrame(rows, "page_id int, text string")).collect()}
    assert got == {i: (t, c) for i, (_, t, c) in enumerate(PAGES)}
    assert all(restated(p) == (t, c) for p, t, c in PAGES)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB .!?\n\t  \x1f\x85é", max_size=60), min_size=20, max_size=20))
def test_restatement(spark, pages):
    rows = list(enumerate(pages))
    got = {r.page_id: (r.title, r.text) for r in clean_pages(spark.createDataFrame(rows, "page_id int, text string")).collect()}
    assert got == {i: restated(p) for i, p in rows if p.strip()}


def test_sentences(spark):
    df = spark.createDataFrame([("Fourteen chars. Fifteen charss. And here is one more",), ("",), (None,)], "t string")
    got = [r.s for r in df.select(text.rule_sentences(F.col("t")).alias("s")).collect()]
    assert got == [["Fourteen chars.", "Fifteen charss.", "And here is one more"], [], None]


MENTIONS = [
    ("The BBC", "ORG", None), ("the United Nations", "ORG", "United Nations"), ("The The Band", "ORG", "The Band"), ("Rome", "GPE", "Rome"),
    ("UNO", "ORG", None), ("ISBN", "ORG", None), ("Expo 2020", "EVENT", None), ("Area 51", "LOC", "Area 51"), ("http://x.org", "ORG", None),
    ("Monday", "DATE", None), ("x" * 101, "PERSON", None), (None, "ORG", None), ("Rome", None, None), ("", "ORG", None),
]


def test_mentions(spark):
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(MENTIONS)], "i int, text string, label string, want string")
    for r in df.withColumn("got", entities.clean_mention(F.col("text"), F.col("label"))).collect():
        assert r.got == r.want, r


def test_page_entities_are_distinct(spark):
    df = spark.createDataFrame([(1, "A", "the Rome", "GPE"), (1, "A", "Rome", "GPE"), (2, "B", "Rome", "GPE")], "page_id int, title string, text string, label string")
    assert sorted(map(tuple, entities.page_entities(df).collect())) == [(1, "A", "Rome"), (2, "B", "Rome")]


def test_labels_and_file_titles(spark):
    one = spark.range(1)
    for given_, want in [("tabby, tabby cat", "tabby"), ("Monitor", None), ("ox", None), ("n02 thing", None), ("", None), (None, None)]:
        assert one.select(entities.clean_label(F.lit(given_).cast("string")).alias("x")).first().x == want
    scores = spark.createDataFrame([([("dog", 0.1), ("cat", 0.6), ("fox", 0.09), ("cat, kitten", 0.5)],)], "s array<struct<label:string,confidence:double>>")
    assert scores.select(entities.top_labels(F.col("s")).alias("x")).first().x == ["cat", "dog"]
    for path, want in [("a/Eiffel_Tower_12.jpg", "Eiffel Tower"), ("12.png", "12"), ("_7.png", "_7"), ("x/y_z", "y z")]:
        assert one.select(entities.file_title(F.lit(path)).alias("x")).first().x == want


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(entities.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1:] == [None, None, None]
