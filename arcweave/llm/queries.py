"""Named queries of the training-data operators."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave.functions.text import TERMINATORS
from arcweave.llm import cooccur, dupes, langid, leak, mixing, sentences, termfreq, variants
from arcweave.operators.skew import not_blank
from arcweave.queries import table
from arcweave.session import materialize
from arcweave.sources.files import parse_link_records

if TYPE_CHECKING:
    from collections.abc import Callable

    from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_PAIRS = """
WITH p AS (SELECT page_id, arg_max(entities, captured_at) AS e FROM page_data WHERE page_id IS NOT NULL GROUP BY page_id),
x AS (SELECT DISTINCT page_id, u FROM (SELECT page_id, unnest(e) AS u FROM p) WHERE trim(u) <> ''),
t AS (SELECT count(DISTINCT page_id) AS n FROM x), k AS (SELECT u, count(*) AS m FROM x GROUP BY u),
ab AS (SELECT a.u AS a, b.u AS b, count(*) AS n_ab FROM x a JOIN x b ON a.page_id = b.page_id AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= 5)
"""


@query(_PAIRS + """SELECT a AS entity_a, b AS entity_b FROM ab JOIN k ka ON ka.u = a JOIN k kb ON kb.u = b, t
WHERE n_ab * n >= 4 * ka.m * kb.m""")
def p1_found(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


@query(_PAIRS + """SELECT a AS item_a, b AS item_b, n_ab, ka.m AS n_a, kb.m AS n_b, n, round(n_ab * n::DOUBLE / (ka.m * kb.m), 6) AS lift
FROM ab JOIN k ka ON ka.u = a JOIN k kb ON kb.u = b, t WHERE n_ab * n >= 4 * ka.m * kb.m""")
def p1_pair_lift(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("lift", F.round("lift", 6))


def _pairs(spark, sf_dir):
    return cooccur.cooccurrence(cooccur.latest_baskets(table(spark, sf_dir, "page_data"), "page_id", "entities", "captured_at"))


_TERMS = """
WITH l AS (SELECT dst, CASE WHEN trim(src) <> '' THEN src END AS src FROM links_to),
t AS (SELECT count(DISTINCT src) AS n FROM l),
g AS (SELECT dst, count(*) AS n_links, count(DISTINCT src) AS n_src FROM l WHERE trim(dst) <> '' GROUP BY dst),
m AS (SELECT g.*, CASE WHEN n_src < 3 THEN 'rare' WHEN n_src * 50 > t.n THEN 'common' END AS mark FROM g, t)
"""


@query(_TERMS + "SELECT dst, mark FROM m WHERE mark IS NOT NULL")
def p2_found(spark, sf_dir):
    return termfreq.marked_terms(table(spark, sf_dir, "links_to"), "dst", "src").where("mark is not null").select("dst", "mark")


@query(_TERMS + "SELECT dst, n_links, n_src, mark FROM m")
def p2_target_frequency(spark, sf_dir):
    return termfreq.marked_terms(table(spark, sf_dir, "links_to"), "dst", "src").select(
        "dst", F.col("n_occurrences").alias("n_links"), F.col("n_records").alias("n_src"), "mark"
    )


_LINKS = r"""
WITH u AS (SELECT edge_id, src, dst FROM links_to UNION ALL
SELECT edge_id, json_extract_string(record, '$.from'), json_extract_string(record, '$.to') FROM link_raw WHERE json_valid(record)),
c AS (SELECT *, lower(regexp_replace(src, '[^\p{L}\p{Nd}]', '', 'g')) AS s, lower(regexp_replace(dst, '[^\p{L}\p{Nd}]', '', 'g')) AS d FROM u),
g AS (SELECT *, min(edge_id) OVER (PARTITION BY s, d) AS first_edge_id, count(*) OVER (PARTITION BY s, d) AS n_copies FROM c WHERE s <> '' AND d <> '')
"""


@query(_LINKS + "SELECT first_edge_id, edge_id FROM g WHERE edge_id <> first_edge_id")
def p6_found(spark, sf_dir):
    return dupes.link_groups(_all_links(spark, sf_dir)).where("edge_id <> first_edge_id")


@query(_LINKS + "SELECT edge_id, src, dst, n_copies FROM g WHERE edge_id = first_edge_id")
def p6_distinct_links(spark, sf_dir):
    return dupes.distinct_links(_all_links(spark, sf_dir))


def _all_links(spark, sf_dir):
    links = table(spark, sf_dir, "links_to").select("edge_id", "src", "dst")
    return links.unionByName(parse_link_records(table(spark, sf_dir, "link_raw")))


@query()
def p7_found(spark, sf_dir):
    return leak.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@query()
def p7_clean_documents(spark, sf_dir):
    return leak.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "source")


_FOLD = r"trim(lower(regexp_replace(regexp_replace({}, '[\x{{00AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


@query(rf"""WITH d AS (SELECT doc_id, ' ' || {_FOLD.format("text")} || ' ' AS t FROM documents WHERE text <> ''), i AS (SELECT item_id, {_FOLD.format("text")} AS w FROM eval_items),
s AS (SELECT item_id, w, regexp_matches(w, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{0e00}}-\x{{0e7f}}]') AS spaceless FROM i WHERE w <> '')
SELECT doc_id, item_id FROM d, s WHERE CASE WHEN spaceless THEN contains(replace(t, ' ', ''), replace(w, ' ', '')) ELSE contains(t, ' ' || w || ' ') END""")
def p7_whole_items(spark, sf_dir):
    return leak.whole_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query()
def p8_mix(spark, sf_dir):
    counted = mixing.counted_once(table(spark, sf_dir, "documents"))
    return mixing.mix(counted, table(spark, sf_dir, "mix_targets"))


@query()
def p8_mix_report(spark, sf_dir):
    counted, targets = mixing.counted_once(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    return mixing.mix_report(counted, targets, mixing.mix(counted, targets))


@query("SELECT 0::BIGINT AS over_limit, 0::BIGINT AS off_target, 0::BIGINT AS unplaced")
def p8_mix_checks(spark, sf_dir):
    counted, targets = mixing.counted_once(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    return mixing.mix_checks(counted, targets, materialize(mixing.mix(counted, targets)))


@query()
def p8_tempered_mix(spark, sf_dir):
    counted = mixing.counted_once(table(spark, sf_dir, "documents"))
    return mixing.mix(counted, table(spark, sf_dir, "mix_targets"), plan=mixing.plan_temperature)


@query()
def p8_tempered_report(spark, sf_dir):
    counted, targets = mixing.counted_once(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")
    return mixing.mix_report(counted, targets, mixing.mix(counted, targets, plan=mixing.plan_temperature))


@query()
def p5_found(spark, sf_dir):
    return sentences.sentence_units(table(spark, sf_dir, "text_dir")).select("page_id", "start_char", "end_char")


_SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BODY = rf"""WITH a AS (SELECT page_id, string_split(regexp_replace(text, '\A{_SP}+', ''), chr(10))[2:] AS l FROM (SELECT DISTINCT page_id, text FROM text_dir WHERE text IS NOT NULL)),
b AS (SELECT page_id, list_transform(l, lambda v: regexp_replace(v, '{_SP}+', '', 'g')) AS c, list_position(list_transform(l,
lambda v: regexp_matches(v, '\A{_SP}*(?:{"|".join(TERMINATORS)})')), true) AS cut FROM a)
SELECT page_id, CAST(sum(length(array_to_string(CASE WHEN coalesce(cut, 0) = 0 THEN c ELSE c[1:cut - 1] END, ''))) AS BIGINT) AS n_signs FROM b GROUP BY page_id"""


@query(f"SELECT * FROM ({_BODY}) WHERE n_signs > 0")
def p5_covered_signs(spark, sf_dir):
    """Non-blank signs in the units of every page: all that the body has, each once."""
    found = sentences.sentence_units(table(spark, sf_dir, "text_dir"))
    return found.groupBy("page_id").agg(F.sum(F.length(F.regexp_replace("sentence", _SP, ""))).alias("n_signs"))


@query()
def p5_sentences(spark, sf_dir):
    return sentences.sentence_units(table(spark, sf_dir, "text_dir"))


@query()
def p9_found(spark, sf_dir):
    return langid.unstated_languages(table(spark, sf_dir, "documents"))


@query()
def p9_stretches(spark, sf_dir):
    return langid.language_stretches(table(spark, sf_dir, "documents"))


@query()
def p9_documents(spark, sf_dir):
    return langid.document_languages(table(spark, sf_dir, "documents"))


@query("SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_documents, count(*) FILTER (regexp_matches(text, '\\p{L}')) AS n_named, 0::BIGINT AS n_unsure FROM documents")
def p9_document_checks(spark, sf_dir):
    found = langid.document_languages(table(spark, sf_dir, "documents"))
    unsure = F.count(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), 1))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_documents"), F.count("lang").alias("n_named"), unsure.alias("n_unsure"))


@query()
def p9_labels(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


@query()
def p3_found(spark, sf_dir):
    return variants.variant_links(table(spark, sf_dir, "entity"), table(spark, sf_dir, "links_to"))


@query()
def p3_canonical_titles(spark, sf_dir):
    return variants.canonical_titles(table(spark, sf_dir, "entity"), table(spark, sf_dir, "links_to"))


@query()
def p3_members(spark, sf_dir):
    return variants.members(table(spark, sf_dir, "entity"), table(spark, sf_dir, "links_to"))


@query("SELECT count(DISTINCT node_id) AS n_nodes, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_divided FROM entity WHERE trim(title) <> '' AND node_id IS NOT NULL")
def p3_member_checks(spark, sf_dir):
    """Nodes with a title, placed or not; members whose entity is not the smallest of as many nodes as are said; spellings equal but for blanks that are in two entities."""
    entity = table(spark, sf_dir, "entity").where(not_blank("title") & F.col("node_id").isNotNull())
    placed = materialize(variants.members(entity, table(spark, sf_dir, "links_to")))
    groups = placed.groupBy("entity_id", "n_nodes").agg(F.min("node_id").alias("least"), F.countDistinct("node_id").alias("n"))
    wrong = groups.where("least <> entity_id or n < n_nodes").agg(F.count(F.lit(1)).alias("n_misplaced")).withColumn("_k", F.lit(0))
    single = entity.select("node_id", F.lower(F.regexp_replace("title", " +", "")).alias("t")).distinct()
    whole = single.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node_id")
    spelt = single.join(whole, "node_id").join(placed, "node_id").groupBy("t").agg(F.countDistinct("entity_id").alias("n")).where("n > 1")
    nodes = entity.agg(F.countDistinct("node_id").alias("n_nodes")).withColumn("_k", F.lit(0))
    divided = spelt.agg(F.count(F.lit(1)).alias("n_divided")).withColumn("_k", F.lit(0))
    return nodes.join(wrong, "_k").join(divided, "_k").drop("_k")
