"""Filters for recognised mentions and image labels, and titles from file names."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arcweave.functions.text import SPACE, strip

if TYPE_CHECKING:
    from collections.abc import Iterator

    from pyspark.sql import Column, DataFrame

# Fixed values.
LABELS = ("ORG", "GPE", "LOC", "PRODUCT", "LAW", "EVENT", "WORK_OF_ART", "PERSON", "NORP")
DISCARDED = ("issn", "isbn", "doi")
GENERIC_LABELS = ("web site", "website", "screen", "monitor", "display", "background", "texture", "pattern", "color", "shape")
MIN_LENGTH, MAX_LENGTH, MIN_LABEL = 4, 100, 3
TOP_LABELS, MIN_CONFIDENCE = 10, 0.1
CATEGORY_BLOCK = 256


def clean_mention(text: Column, label: Column) -> Column:
    """The entity that a mention stands for, or null if it is dropped.

    Known label; stripped length over 3 before one leading article goes; no
    discarded word, URL or run of four digits; length 4 to 100 afterwards.
    """
    bare = strip(text)
    name = F.regexp_replace(bare, rf"(?i)^(a|an|the){SPACE}+", "")
    bad = F.lower(name).isin(*DISCARDED) | name.rlike(r"(?U)https?://|\b\d{4,}\b")
    ok = label.isin(*LABELS) & (F.length(bare) >= MIN_LENGTH) & ~bad & F.length(name).between(MIN_LENGTH, MAX_LENGTH)
    return F.when(ok, name)


def page_entities(mentions: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, title, entity)``, each entity once a page; dropped mentions and null texts or labels give none."""
    entity = clean_mention(F.col("text"), F.col("label"))
    return mentions.select(page, "title", entity.alias("entity")).where("entity is not null").distinct()


def clean_label(label: Column) -> Column:
    """Text before the first comma; null if empty, under 3 characters, generic, or holding n and a digit."""
    name = strip(F.split(label, ",")[0])
    bad = name.rlike("n[0-9]") | F.lower(name).isin(*GENERIC_LABELS) | (F.length(name) < MIN_LABEL)
    return F.when(~bad, name)


def top_labels(scores: Column, top: int = TOP_LABELS, least: float = MIN_CONFIDENCE) -> Column:
    """Clean labels of the best ``top`` scores of at least ``least``, best first, first occurrence kept.

    ``scores``: array of ``(label, confidence)``; ties in confidence go by label; null gives null.
    """
    ranked = F.array_sort(F.transform(scores, lambda s: F.struct((-s["confidence"]).alias("c"), s["label"].alias("l"))))
    best = F.filter(F.slice(ranked, 1, top), lambda s: s["c"] <= -least)
    return F.array_distinct(F.filter(F.transform(best, lambda s: clean_label(s["l"])), lambda x: x.isNotNull()))


def file_title(path: Column) -> Column:
    """Title from a file name: stem, a last all-digit part dropped, parts joined with blanks; the stem if that is empty."""
    name = F.regexp_replace(path, r"^.*/", "")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    title = F.regexp_replace(F.regexp_replace(stem, r"_\d+$", ""), "_", " ")
    return F.when(title != "", title).otherwise(stem)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is null, empty, of another length or zero."""
    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b))))


def category_similarity(vectors: DataFrame, categories: DataFrame) -> DataFrame:
    """``(vec_id, category, similarity)`` of each vector to each stated ``(category, vector)`` row.

    The categories are the query set: they go out as matrices of CATEGORY_BLOCK rows, and the
    vectors meet all blocks in one pass without a shuffle or join. Null where a vector is null, of another
    length than the category's, has a null element or is zero.
    """
    spark, kind = vectors.sparkSession, categories.schema["category"].dataType
    blocks, held = [], []
    for r in categories.select("category", "vector").toLocalIterator():
        held.append((r["category"], r["vector"]))
        if len(held) == CATEGORY_BLOCK:
            blocks.append(spark.sparkContext.broadcast(held))
            held = []
    if held:
        blocks.append(spark.sparkContext.broadcast(held))
    out = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("category", kind), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def unit(rows: list, size: int) -> np.ndarray:
        """Rows of length 1; nan where a row is no vector of ``size`` numbers."""
        fits = [len(v) == size and None not in v if v is not None else False for v in rows]
        m = np.array([v if ok else [np.nan] * size for v, ok in zip(rows, fits)], np.float64).reshape(len(rows), size)
        length = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                ids, rows = batch.column(0).slice(begin, 4096), batch.column(1).slice(begin, 4096).to_pylist()
                for block in blocks:
                    names, wanted = zip(*block.value)
                    similar = np.full((len(rows), len(names)), np.nan)
                    for size in {len(v) for v in wanted if v}:
                        got = unit(rows, size) @ unit(list(wanted), size).T
                        similar = np.where(np.isnan(similar), got, similar)
                    flat = similar.reshape(-1)
                    yield pa.record_batch([
                        ids.take(pa.array(np.repeat(np.arange(len(rows)), len(names)))), pa.array(names * len(rows), arrow.field(1).type), pa.array(flat, mask=np.isnan(flat)),
                    ], schema=arrow)

    return vectors.select("vec_id", "embedding").mapInArrow(run, out)
