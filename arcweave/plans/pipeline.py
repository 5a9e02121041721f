"""From pages and images to one deduplicated link table."""

from __future__ import annotations

import functools
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave.functions import entities, models, text
from arcweave.operators import links, scenarios
from arcweave.operators.dictionary import number_rows
from arcweave.operators.graph import GraphStore
from arcweave.plans import evaluate
from arcweave.session import materialize
from arcweave.sources import files

if TYPE_CHECKING:
    from collections.abc import Callable

    from pyspark.sql import DataFrame, SparkSession

    from arcweave.plans.config import Config


def clean_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, title, text)`` of pages that are not blank."""
    kept = pages.where(text.not_blank_text(F.col("text")))
    return kept.select("page_id", text.page_title(F.col("text")).alias("title"), text.clean_text(F.col("text")).alias("text"))


def text_links(pages: DataFrame, backend: Callable = models.rule_recognizer, splitter: str = "") -> DataFrame:
    """``(edge_id, src, dst)``: title to every entity of a page, each once a page; ``splitter`` names a sentence model."""
    clean = clean_pages(pages)
    found = clean.select("page_id", "title", F.explode(models.recognize(models.split_sentences(F.col("text"), splitter), backend)).alias("m"))
    kept = entities.page_entities(found.select("page_id", "title", F.col("m.text").alias("text"), F.col("m.label").alias("label")))
    pages = kept.groupBy("page_id", "title").agg(F.collect_set("entity").alias("entities"))
    return links.page_links(pages, "page_id").select(F.xxhash64("page_id", "dst").alias("edge_id"), "src", "dst")


def image_links(images: DataFrame, backend: Callable) -> DataFrame:
    """``(edge_id, src, dst)``: file title to every label of an image, best first."""
    scored = images.select("path", models.classify(F.col("content"), backend)["scores"].alias("scores"))
    found = scored.select(entities.file_title(F.col("path")).alias("src"), "path", F.posexplode(entities.top_labels(F.col("scores"))).alias("k", "dst"))
    return found.select(F.xxhash64("path", "k").alias("edge_id"), "src", "dst")


def image_errors(images: DataFrame, backend: Callable) -> DataFrame:
    """``(path, error)`` of the images that the backend fails on."""
    return images.select("path", models.classify(F.col("content"), backend)["error"].alias("error")).where("error is not null")


def run(spark: SparkSession, config: Config, recognizer: Callable | None = None, classifier: Callable | None = None) -> DataFrame:
    """The whole pipeline: links of texts first, then of images, deduplicated and saved as scenario s3, with s1 and s2 made of it;
    or, if the evaluation is on, the evaluation of the saved scenarios.

    Recogniser, sentence splitter and image classifier are those of the configuration unless they are given; without an
    image model no image is read.
    """
    if config.evaluate:
        edges = {s: files.read_link_document(spark, f"{config.output}/{s}.json") for s in config.scenarios}
        metrics = evaluate.evaluate(GraphStore(spark, config.store), edges, config.strategies, config.runs)
        evaluate.save(metrics, config.results)
        return metrics
    pages = files.read_text_dir(spark, config.text_dir).withColumn("page_id", F.xxhash64("path"))
    parts = [text_links(pages, recognizer or models.recognizer(config.model), config.model)]
    if not classifier and config.image_model:
        classifier = functools.partial(models.onnx_classifier, config.image_model, config.image_labels)
    if classifier:
        parts.append(image_links(files.read_image_dir(spark, config.images_dir), classifier))
    merged = materialize(links.first_links(links.union_links(*parts)))
    files.write_link_document(merged, f"{config.output}/s3.json")
    for name, edges in build_scenarios(merged, config.hub).items():
        files.write_link_document(edges, f"{config.output}/{name}.json")
    return merged


def build_scenarios(all_links: DataFrame, hub: str = "") -> dict[str, DataFrame]:
    """Scenario s1 (one hub, the largest if none is named) and s2 (top hubs) of a link table, with ``edge_id``."""
    if not hub:
        first = scenarios.top_hubs(all_links, 1).first()
        hub = first["src"] if first else ""
    made = {"s1": scenarios.single_hub_scenario(all_links, hub), "s2": scenarios.top_hubs_scenario(all_links)}
    return {name: number_rows(rows.orderBy("hub", "src", "dst"), "edge_id").select("edge_id", "src", "dst") for name, rows in made.items()}
