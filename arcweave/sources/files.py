"""Sources and sinks: text pages, images, link documents and link records."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave import schema
from arcweave.functions.text import not_blank_text
from arcweave.operators.dictionary import number_rows

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

DOCUMENT = 100_000   # links of one document


def read_text_dir(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)``: every file of a folder, whole; unreadable bytes are replaced, empty files give empty text, files that fail are left out (``text_dir_report`` counts them)."""
    read = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_dir_report(spark: SparkSession, folder: str) -> DataFrame:
    """``(n_files, n_read, n_unread, n_blank)`` of a folder of pages: one row."""
    listed = spark.read.format("binaryFile").load(folder).select("path")
    pages = read_text_dir(spark, folder).agg(
        F.count(F.lit(1)).alias("n_read"), F.count(F.when(~not_blank_text(F.col("text")), 1)).alias("n_blank")
    )
    files = listed.agg(F.count(F.lit(1)).alias("n_files")).withColumn("_k", F.lit(0))
    return files.join(pages.withColumn("_k", F.lit(0)), "_k").select("n_files", "n_read", (F.col("n_files") - F.col("n_read")).alias("n_unread"), "n_blank")


def write_text_dir(pages: DataFrame, folder: str) -> None:
    """One text file a page, ended by a line break, under names that Spark gives; ``read_text_dir`` reads them. Null texts make none."""
    pages.where("text is not null").select(F.col("text").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)


def read_image_dir(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the .jpg, .jpeg and .png files of a folder, in any letter case."""
    return spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.(jpe?g|png)$")).select("path", "content")


def read_link_document(spark: SparkSession, path: str) -> DataFrame:
    """``(edge_id, src, dst)`` of one link document, or of a folder of them by name; ``edge_id`` is the place in the whole list.

    Of several files one number each comes to the driver, where the next one begins.
    """
    docs = spark.read.schema(schema.LINK_DOCUMENT).json(path, multiLine=True)
    several = len(docs.inputFiles()) > 1
    rows = docs.select(F.col("_metadata.file_path").alias("f"), F.posexplode("LINKS_TO").alias("at", "e"))
    rows = rows.select("f", F.col("at").cast("bigint").alias("edge_id"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"))
    if not several:
        return rows.drop("f")
    starts, total = [], 0
    for r in rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect():
        starts.append((r["f"], total))
        total += r["n"]
    begin = F.broadcast(spark.createDataFrame(starts, "f string, _s bigint"))
    return rows.join(begin, "f").select((F.col("edge_id") + F.col("_s")).alias("edge_id"), "src", "dst")


def write_link_document(links: DataFrame, path: str, size: int = DOCUMENT) -> None:
    """Links in order as ``{"LINKS_TO": [{"from", "to"}, ...]}`` documents of ``size`` links, one file each, written in parallel.

    The order is that of ``source_rank`` (if there is one) and ``edge_id``;
    ``read_link_document`` gives the same list. Up to ``size`` links make one document,
    none an empty list.
    """
    order = [c for c in ("source_rank", "edge_id") if c in links.columns]
    placed = number_rows(links.select(*order, "src", "dst").orderBy(*order, "src", "dst"), "_g").select("_g", F.floor(F.col("_g") / size).alias("_d"), "src", "dst")
    row = F.struct("_g", F.col("src").alias("from"), F.col("dst").alias("to"))
    lists = placed.groupBy("_d").agg(F.array_sort(F.collect_list(row)).alias("l"))
    lists = lists.select("_d", F.transform("l", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))).alias("LINKS_TO"))
    n = placed.agg(F.max("_d")).first()[0]
    if n is None:
        lists = links.sparkSession.range(1).select(F.lit(0).alias("_d"), F.from_json(F.lit('{"LINKS_TO": []}'), schema.LINK_DOCUMENT)["LINKS_TO"].alias("LINKS_TO"))
    text = lists.select("_d", F.to_json(F.struct("LINKS_TO"), {"ignoreNullFields": "false"}).alias("value"))
    parts = min(int(n or 0) + 1, 1000)
    text.repartitionByRange(parts, "_d").sortWithinPartitions("_d").select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def link_json(links: DataFrame) -> DataFrame:
    """``(edge_id, record)``: each link as one JSON object; a null end is left out of it."""
    return links.select("edge_id", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))).alias("record"))


def parse_link_records(raw: DataFrame) -> DataFrame:
    """``(edge_id, src, dst)`` of JSON link records; what is no JSON object is left out, further fields are ignored."""
    kinds = "`from` string, `to` string, `_corrupt_record` string"
    got = F.from_json("record", kinds, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return (
        raw.select("edge_id", got.alias("r"))
        .where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull())
        .select("edge_id", F.col("r.from").alias("src"), F.col("r.to").alias("dst"))
    )
