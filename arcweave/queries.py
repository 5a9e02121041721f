"""Named queries over the project's tables and, where SQL can say it, their SQL."""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave import schema
from arcweave.functions import entities, text
from arcweave.operators import coloring, dictionary, graph, links, scenarios, schedule, skew
from arcweave.operators.dedup import once
from arcweave.plans import config, evaluate, pipeline
from arcweave.session import materialize, shared_dir
from arcweave.sources import files
from arcweave.streaming import upsert

if TYPE_CHECKING:
    from collections.abc import Callable

    from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
WITH l AS (SELECT dst FROM links_to WHERE trim(dst) <> ''), t AS (SELECT count(*) AS n FROM l)
SELECT dst FROM l, t GROUP BY dst, t.n HAVING count(*) * 200 >= t.n""")
def p4_found(spark, sf_dir):
    return skew.shared_targets(table(spark, sf_dir, "links_to"), 1 / 200).select("dst")


@query("""
WITH l AS (SELECT dst, CASE WHEN trim(src) <> '' THEN src END AS src FROM links_to WHERE trim(dst) <> ''),
p AS (SELECT dst, src, count(*) AS n FROM l GROUP BY dst, src),
r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY n DESC, src) AS r FROM p WHERE src IS NOT NULL),
h AS (SELECT dst, string_agg(src || '=' || n, ' | ' ORDER BY n DESC, src) AS hubs FROM r WHERE r <= 10 GROUP BY dst),
g AS (SELECT dst, CAST(sum(n) AS BIGINT) AS n_links, count(src) AS n_src FROM p GROUP BY dst)
SELECT g.dst, n_links, n_src, coalesce(hubs, '') AS hubs FROM g LEFT JOIN h USING (dst)""")
def p4_target_report(spark, sf_dir):
    return skew.target_report(table(spark, sf_dir, "links_to"))


@query("SELECT dst, src, count(*) AS n FROM links_to WHERE trim(dst) <> '' AND trim(src) <> '' GROUP BY dst, src")
def p4_target_hubs(spark, sf_dir):
    return skew.target_hubs(table(spark, sf_dir, "links_to"))


_ENDS = "SELECT edge_id, src, dst FROM links_to WHERE src IS NOT NULL AND dst IS NOT NULL"
_RECORDS = "SELECT edge_id, json_extract_string(record, '$.from') AS src, json_extract_string(record, '$.to') AS dst FROM link_raw WHERE json_valid(record)"
_NODES = "SELECT title, bool_or(is_base) AS is_base, min(processed_at) AS processed_at FROM entity WHERE title IS NOT NULL GROUP BY title"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "links_to").select("edge_id", "src", "dst")


def _records(spark, sf_dir):
    return files.parse_link_records(table(spark, sf_dir, "link_raw"))


def _nodes(spark, sf_dir):
    """One row per title of the entity table: base if any row says so."""
    rows = table(spark, sf_dir, "entity").where("title is not null")
    return rows.groupBy("title").agg(F.bool_or("is_base").alias("is_base"), F.min("processed_at").alias("processed_at"))


def _empty_links(spark):
    return spark.createDataFrame([], schema.LINKS)


@query(f"SELECT src, dst, count(*) AS weight, 7 AS created_at, CASE WHEN count(*) > 1 THEN 7 END AS last_updated FROM ({_ENDS}) GROUP BY src, dst")
def merge_new_links(spark, sf_dir):
    return graph.merge_links(_empty_links(spark), _links(spark, sf_dir), 7)


@query(f"""WITH a AS (SELECT src, dst, count(*) AS n FROM ({_RECORDS}) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst),
b AS (SELECT src, dst, count(*) AS n FROM ({_ENDS}) GROUP BY src, dst)
SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.n, 0) + coalesce(b.n, 0) AS weight,
CASE WHEN a.n IS NULL THEN 2 ELSE 1 END AS created_at,
CASE WHEN b.n IS NULL THEN CASE WHEN a.n > 1 THEN 1 END WHEN a.n IS NOT NULL OR b.n > 1 THEN 2 END AS last_updated
FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst""")
def merge_existing_links(spark, sf_dir):
    return graph.merge_links(graph.merge_links(_empty_links(spark), _records(spark, sf_dir), 1), _links(spark, sf_dir), 2)


@query(f"SELECT src, dst, count(*) AS weight FROM ({_ENDS}) GROUP BY src, dst")
def merge_incremental_links(spark, sf_dir):
    rows = table(spark, sf_dir, "links_to")
    text = F.coalesce(F.col("origin") == "text", F.lit(False))
    first = graph.merge_links(_empty_links(spark), rows.where(text), 1)
    return graph.merge_links(first, rows.where(~text), 2).select("src", "dst", "weight")


@query(f"SELECT src, dst, count(*) AS weight FROM ({_ENDS}) GROUP BY src, dst")
def merge_streamed_links(spark, sf_dir):
    """The link table as a stream of files, merged into a store batch by batch."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _links(spark, sf_dir).repartition(4).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(schema.EDGES).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    store = graph.GraphStore(spark, f"{folder}/graph")
    upsert.merge_stream(source, store, f"{folder}/checkpoint").awaitTermination()
    return store.links().select("src", "dst", "weight")


@query(f"""WITH t AS (SELECT DISTINCT unnest([src, dst]) AS title FROM ({_ENDS})), n AS ({_NODES})
SELECT coalesce(n.title, t.title) AS title, CASE WHEN t.title IS NULL THEN is_base ELSE coalesce(is_base, false) END AS is_base,
CASE WHEN t.title IS NULL THEN processed_at ELSE coalesce(processed_at, 7) END AS processed_at FROM n FULL JOIN t ON n.title = t.title""")
def merge_nodes(spark, sf_dir):
    return graph.merge_nodes(_nodes(spark, sf_dir), _links(spark, sf_dir), 7)


@query(f"""WITH n AS ({_NODES}), b AS (SELECT title FROM n WHERE is_base)
SELECT src, dst, count(*) AS weight FROM ({_ENDS}) WHERE src IN (FROM b) AND dst IN (FROM b) GROUP BY src, dst""")
def reset_links(spark, sf_dir):
    links = graph.merge_links(_empty_links(spark), _links(spark, sf_dir), 7)
    return graph.reset_links(_nodes(spark, sf_dir), links).select("src", "dst", "weight")


@query(f"SELECT title, is_base, processed_at FROM ({_NODES}) WHERE is_base")
def reset_nodes(spark, sf_dir):
    return graph.reset_nodes(_nodes(spark, sf_dir))


@query(f"""WITH t AS (SELECT DISTINCT unnest([src, dst]) AS title FROM ({_ENDS})), l AS (SELECT src, dst, count(*) AS w FROM ({_ENDS}) GROUP BY src, dst)
SELECT (SELECT count(*) FROM t) AS n_nodes, count(*) AS n_links, CAST(sum(w) AS BIGINT) AS total_weight, 2 * count(*) - count(*) FILTER (src = dst) AS degree_sum FROM l""")
def graph_stats(spark, sf_dir):
    edges = _links(spark, sf_dir)
    nodes = graph.merge_nodes(spark.createDataFrame([], schema.NODES), edges, 7)
    return graph.graph_stats(nodes, graph.merge_links(_empty_links(spark), edges, 7))


@query("""SELECT DISTINCT title AS src, u AS dst, page_id FROM (SELECT page_id, title, captured_at, unnest(entities) AS u FROM page_data WHERE title IS NOT NULL) WHERE u IS NOT NULL""")
def page_links(spark, sf_dir):
    return links.page_links(table(spark, sf_dir, "page_data"), "page_id").distinct()


@query("""WITH u AS (SELECT CASE WHEN origin = 'text' THEN 0 ELSE 1 END AS r, edge_id, src, dst FROM links_to WHERE origin IN ('text', 'image')),
m AS (SELECT src, dst, min(r) AS source_rank FROM u GROUP BY src, dst)
SELECT m.src, m.dst, source_rank, min(edge_id) AS edge_id FROM m JOIN u ON m.src IS NOT DISTINCT FROM u.src AND m.dst IS NOT DISTINCT FROM u.dst AND m.source_rank = u.r
GROUP BY m.src, m.dst, source_rank""")
def links_union_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "links_to")
    return links.first_links(links.union_links(rows.where("origin = 'text'"), rows.where("origin = 'image'")))


@query(f"SELECT edge_id, src, dst FROM ({_RECORDS})")
def link_records(spark, sf_dir):
    return _records(spark, sf_dir)


@query("SELECT edge_id, CAST(json_object('from', src, 'to', dst) AS VARCHAR) AS record FROM links_to WHERE src IS NOT NULL AND dst IS NOT NULL")
def link_json(spark, sf_dir):
    return files.link_json(graph.complete(_links(spark, sf_dir)))


_PAIRS = "p AS (SELECT DISTINCT src, dst FROM links_to WHERE trim(src) <> '' AND trim(dst) <> ''), d AS (SELECT src, count(*) AS degree FROM p GROUP BY src)"


def _clique_sql(hubs: int, cap: int) -> str:
    return f"""{_PAIRS}, h AS (SELECT src FROM d ORDER BY degree DESC, src LIMIT {hubs}),
t AS (SELECT * FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY p.src ORDER BY p.dst) AS r FROM p JOIN h ON p.src = h.src) WHERE r <= {cap}),
c AS (SELECT a.src AS hub, a.dst AS src, b.dst AS dst FROM t a JOIN t b ON a.src = b.src AND a.dst <> b.dst)"""


@query(f"WITH {_PAIRS} SELECT src, degree FROM d")
def hotspot_degree(spark, sf_dir):
    return scenarios.hub_degrees(_links(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT src, degree FROM d ORDER BY degree DESC, src LIMIT 40")
def hotspot_topk(spark, sf_dir):
    return scenarios.top_hubs(_links(spark, sf_dir))


@query(f"WITH {_clique_sql(1, 200)} SELECT hub, src, dst FROM c")
def scenario_single_hub(spark, sf_dir):
    edges = _links(spark, sf_dir)
    hub = scenarios.top_hubs(edges, 1).first()
    return scenarios.single_hub_scenario(edges, hub["src"] if hub else "")


@query(f"WITH {_clique_sql(40, 60)} SELECT hub, src, dst FROM c")
def scenario_top_hubs(spark, sf_dir):
    return scenarios.top_hubs_scenario(_links(spark, sf_dir))


@query(f"WITH {_clique_sql(40, 60)} SELECT src, count(*) AS n_targets, count(*) * (count(*) - 1) AS n_edges FROM t GROUP BY src")
def scenario_sizes(spark, sf_dir):
    edges = _links(spark, sf_dir)
    return scenarios.clique_sizes(scenarios.hub_targets(edges, scenarios.top_hubs(edges), scenarios.TOP_CAP))


@query(f"WITH {_clique_sql(40, 60)} SELECT src, dst, count(*) AS weight FROM c GROUP BY src, dst")
def clique_weights(spark, sf_dir):
    cliques = scenarios.top_hubs_scenario(_links(spark, sf_dir))
    return graph.merge_links(_empty_links(spark), cliques, 7).select("src", "dst", "weight")


_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_W}+|{_W}+\z', '', 'g')"


_CLEAN = rf"""a AS (SELECT page_id, string_split({_strip('text')}, chr(10)) AS l FROM (SELECT DISTINCT page_id, text FROM text_dir) WHERE {_strip('text')} <> ''),
b AS (SELECT page_id, {_strip('l[1]')} AS title, list_transform(l[2:], lambda v: {_strip('v')}) AS b FROM a),
c AS (SELECT *, list_position(list_transform(b, lambda v: regexp_matches(v, '\A(?:{"|".join(text.TERMINATORS)})')), true) AS cut FROM b),
d AS (SELECT page_id, title, list_filter(CASE WHEN coalesce(cut, 0) = 0 THEN b ELSE b[1:cut - 1] END,
lambda v: length(v) > 0 AND len(regexp_split_to_array(v, '{_W}+')) > 4) AS b FROM c),
e AS (SELECT page_id, title, regexp_replace(regexp_replace(regexp_replace(coalesce(array_to_string(b, chr(10)), ''), '{_W}+', ' ', 'g'), ' +([.!?])', '\1', 'g'),
'([.!?])([A-Z])', '\1 \2', 'g') AS t FROM d),
f AS (SELECT page_id, title, {_strip('t')} AS text FROM e)"""


@query(f"WITH {_CLEAN} SELECT page_id, title FROM f")
def text_title(spark, sf_dir):
    return _clean(spark, sf_dir).select("page_id", "title")


@query(f"WITH {_CLEAN} SELECT page_id, title, text FROM f")
def text_clean(spark, sf_dir):
    return _clean(spark, sf_dir)


def _clean(spark, sf_dir):
    return pipeline.clean_pages(once(table(spark, sf_dir, "text_dir").select("page_id", "text")))


@query(rf"""WITH {_CLEAN}, s AS (SELECT page_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)),
lambda v: {_strip('v')}), lambda v: length(v) >= 15)) AS sentence FROM f)
SELECT page_id, sentence, count(*) AS n FROM s GROUP BY page_id, sentence""")
def text_sentences(spark, sf_dir):
    found = _clean(spark, sf_dir).select("page_id", F.explode(text.rule_sentences(F.col("text"))).alias("sentence"))
    return found.groupBy("page_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CLEAN} SELECT title, text, count(*) AS n FROM f GROUP BY title, text")
def text_files(spark, sf_dir):
    """The pages written as one file each, read and cleaned."""
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    files.write_text_dir(once(table(spark, sf_dir, "text_dir").select("page_id", "text")), folder)
    pages = files.read_text_dir(spark, folder).withColumn("page_id", F.xxhash64("path"))
    return pipeline.clean_pages(pages).groupBy("title", "text").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH a AS (SELECT page_id, title, {_strip('text')} AS s, label FROM mentions),
b AS (SELECT page_id, title, s, label, regexp_replace(s, '(?i)^(a|an|the){_W}+', '') AS e FROM a)
SELECT DISTINCT page_id, title, e AS entity FROM b WHERE label IN ({", ".join(f"'{x}'" for x in entities.LABELS)}) AND length(s) > 3
AND lower(e) NOT IN ('issn', 'isbn', 'doi') AND NOT regexp_matches(e, 'https?://|\b\d{{4,}}\b') AND length(e) BETWEEN 4 AND 100""")
def entity_filter(spark, sf_dir):
    return entities.page_entities(table(spark, sf_dir, "mentions"))


@query(rf"""WITH a AS (SELECT mention_id, {_strip("string_split(text, ',')[1]")} AS l FROM mentions)
SELECT DISTINCT mention_id, CASE WHEN NOT regexp_matches(l, 'n[0-9]') AND length(l) >= 3
AND lower(l) NOT IN ({", ".join(f"'{x}'" for x in entities.GENERIC_LABELS)}) THEN l END AS label FROM a""")
def label_clean(spark, sf_dir):
    return table(spark, sf_dir, "mentions").select("mention_id", entities.clean_label(F.col("text")).alias("label")).distinct()


@query(r"""WITH a AS (SELECT page_id, regexp_replace(path, '^.*/', '') AS name FROM text_dir), b AS (SELECT page_id, regexp_replace(name, '^(.+)\.[^.]*$', '\1') AS stem FROM a),
c AS (SELECT page_id, stem, replace(regexp_replace(stem, '_\d+$', ''), '_', ' ') AS t FROM b)
SELECT DISTINCT page_id, CASE WHEN t <> '' THEN t ELSE stem END AS title FROM c""")
def file_title(spark, sf_dir):
    return table(spark, sf_dir, "text_dir").select("page_id", entities.file_title(F.col("path")).alias("title")).distinct()


def _id_sql(c: str) -> str:
    digits = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"CAST(CASE WHEN {digits} <> '' THEN right({digits}, 1)::BIGINT % 10 ELSE ('0x' || substr(md5({c}), 1, 8))::BIGINT % 10 END AS INTEGER)"


_CODES = f"k AS (SELECT edge_id, src, dst, {_id_sql('src')} AS i, {_id_sql('dst')} AS j FROM ({_ENDS}))"


@query(f"WITH {_CODES} SELECT edge_id, i, j, i || '-' || j AS code FROM k")
def partition_codes(spark, sf_dir):
    return schedule.with_codes(graph.complete(_links(spark, sf_dir))).select("edge_id", "i", "j", "code")


@query(f"WITH {_CODES} SELECT CAST((j - i + 10) % 10 AS INTEGER) AS diagonal, count(*) AS n FROM k GROUP BY 1")
def diagonal_sizes(spark, sf_dir):
    coded = schedule.with_codes(graph.complete(_links(spark, sf_dir)))
    return coded.groupBy(schedule.diagonal().alias("diagonal")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT edge_id, (row_number() OVER (ORDER BY edge_id) - 1) // 1000 AS wave FROM ({_ENDS})")
def schedule_sequential(spark, sf_dir):
    return schedule.sequential(graph.complete(_links(spark, sf_dir))).select("edge_id", "wave")


@query(f"SELECT edge_id, (row_number() OVER (ORDER BY md5('42|' || edge_id)) - 1) // 1000 AS lane FROM ({_ENDS})")
def schedule_naive(spark, sf_dir):
    return schedule.naive_parallel(graph.complete(_links(spark, sf_dir))).select("edge_id", "lane")


@query(f"""WITH {_CODES} SELECT edge_id, CAST((j - i + 10) % 10 AS BIGINT) AS wave, CAST(i AS BIGINT) AS lane,
(row_number() OVER (PARTITION BY i, j ORDER BY edge_id) - 1) // 1000 AS step FROM k""")
def schedule_mix(spark, sf_dir):
    return schedule.mix_and_batch(graph.complete(_links(spark, sf_dir))).select("edge_id", "wave", "lane", "step")


@query(f"""WITH {_CODES}, s AS (SELECT src, dst, CAST((j - i + 10) % 10 AS BIGINT) AS wave, i AS lane FROM k),
e AS (SELECT src AS entity, wave, lane FROM s UNION ALL SELECT dst, wave, lane FROM s)
SELECT entity, wave, count(DISTINCT lane) AS lanes FROM e GROUP BY entity, wave HAVING count(DISTINCT lane) > 1""")
def contention_report(spark, sf_dir):
    coded = schedule.with_codes(graph.complete(_links(spark, sf_dir)))
    return schedule.contention(coded.select("src", "dst", schedule.diagonal().cast("bigint").alias("wave"), F.col("i").alias("lane")))


def _scenario_edges(spark, sf_dir):
    """The 40 top hub cliques with a place in the order of hub and ends; bounded by 40 * 60 * 59 rows."""
    rows = scenarios.top_hubs_scenario(_links(spark, sf_dir)).orderBy("hub", "src", "dst")
    return dictionary.number_rows(rows, "edge_id").select("edge_id", "src", "dst")


@query("SELECT 0::BIGINT AS endpoint_repeats, 0::BIGINT AS order_violations")
def color_checks(spark, sf_dir):
    return coloring.color_violations(materialize(coloring.color_edges(_scenario_edges(spark, sf_dir))))


@query()
def schedule_color(spark, sf_dir):
    return schedule.color_batch(coloring.color_edges(_scenario_edges(spark, sf_dir)))


@query(f"""WITH {_clique_sql(40, 60)}, g AS (SELECT src, dst, count(*) AS w FROM c GROUP BY src, dst)
SELECT s.strategy, count(*) AS n_links, CAST(sum(w) AS BIGINT) AS total_weight, CAST(sum(w * w) AS BIGINT) AS squares FROM g,
(VALUES ('batched_parallel'), ('batched_sequential'), ('color_batch'), ('mix_and_batch'), ('naive_parallel'), ('sequential')) s(strategy) GROUP BY s.strategy""")
def strategy_equivalence(spark, sf_dir):
    edges, out = materialize(_scenario_edges(spark, sf_dir)), None
    for strategy in config.STRATEGIES:
        loaded = graph.merge_links(_empty_links(spark), evaluate.plan(strategy, edges), 7)
        row = loaded.agg(F.count(F.lit(1)).alias("n_links"), F.sum("weight").alias("total_weight"), F.sum(F.col("weight") * F.col("weight")).alias("squares"))
        row = row.select(F.lit(strategy.kind).alias("strategy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH c AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings WHERE label < 5 GROUP BY label)
SELECT vec_id, c.label AS category, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS similarity FROM embeddings, c""")
def category_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    some = rows.where("label < 5").groupBy(F.col("label").alias("category")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return entities.category_similarity(rows, some).withColumn("similarity", F.round("similarity", 6))


@query("SELECT date_trunc('hour', loaded_at) AS hour, src, dst, count(*) AS n FROM links_to WHERE src IS NOT NULL AND dst IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1, 2, 3")
def links_per_hour(spark, sf_dir):
    timed = graph.complete(table(spark, sf_dir, "links_to").where("loaded_at is not null"))
    return upsert.windowed_links(timed, "loaded_at").select(F.col("window.start").alias("hour"), "src", "dst", "n")


@query(f"SELECT edge_id, (row_number() OVER (ORDER BY edge_id) - 1) // 1000 AS lane FROM ({_ENDS})")
def schedule_batched_parallel(spark, sf_dir):
    return schedule.batched_parallel(graph.complete(_links(spark, sf_dir))).select("edge_id", "lane")


@query(f"SELECT CAST((r - 1) // 500 AS BIGINT) AS wave, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY edge_id) AS r FROM ({_ENDS})) GROUP BY 1")
def schedule_batch_sizes(spark, sf_dir):
    """The batched sequential strategy with batches of 500."""
    planned = schedule.STRATEGIES["batched_sequential"](graph.complete(_links(spark, sf_dir)), 500)
    return schedule.batch_sizes(planned).select("wave", "n")


@query(f"""WITH {_clique_sql(40, 60)} SELECT count(*) AS n_edges, count(*) AS n_placed, true AS enough FROM c""")
def color_sizes(spark, sf_dir):
    """Every edge has a color, and no fewer colors come out than the busiest entity has links."""
    edges = materialize(_scenario_edges(spark, sf_dir))
    colored = materialize(coloring.color_edges(edges))
    degree = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("d"))
    counted = coloring.color_count(colored).withColumn("_k", F.lit(0)).join(degree.withColumn("_k", F.lit(0)), "_k")
    return counted.select(F.lit(edges.count()).alias("n_edges"), F.col("n_edges").alias("n_placed"), (F.col("n_colors") >= F.col("d")).alias("enough"))


@query(f"""WITH {_clique_sql(40, 60)}, e AS (SELECT src AS entity FROM c UNION ALL SELECT dst FROM c)
SELECT count(*) AS n_rows, (SELECT count(*) FROM e) AS n_ends, 0::BIGINT AS contended FROM c""")
def schedule_color_checks(spark, sf_dir):
    """A color schedule keeps every edge and touches an entity once a wave."""
    planned = materialize(schedule.color_batch(coloring.color_edges(_scenario_edges(spark, sf_dir))))
    ends = planned.select(F.explode(F.array("src", "dst")).alias("entity"), "wave").groupBy("entity", "wave").agg(F.count(F.lit(1)).alias("n"))
    row = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_ends"), F.count(F.when(F.col("n") > 1, 1)).alias("contended"))
    return row.select(F.lit(planned.count()).alias("n_rows"), "n_ends", "contended")


@query(f"SELECT row_number() OVER (ORDER BY edge_id) - 1 AS edge_id, src, dst FROM links_to")
def link_document(spark, sf_dir):
    """The link table written as documents and read again."""
    path = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}.json"
    files.write_link_document(_links(spark, sf_dir), path)
    return files.read_link_document(spark, path)


@query(f"""SELECT 's1' AS scenario, src, dst, count(*) AS n FROM (WITH {_clique_sql(1, 200)} SELECT src, dst FROM c) GROUP BY ALL
UNION ALL SELECT 's2', src, dst, count(*) FROM (WITH {_clique_sql(40, 60)} SELECT src, dst FROM c) GROUP BY ALL""")
def scenario_documents(spark, sf_dir):
    """Scenarios s1 and s2 written as documents and read again."""
    out = None
    for name, edges in pipeline.build_scenarios(_links(spark, sf_dir)).items():
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.json"
        files.write_link_document(edges, path)
        rows = files.read_link_document(spark, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("scenario"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


_MENTION_SCORES = "SELECT page_id, label AS l, 1.0 / (1 + count(*)) AS c FROM mentions WHERE label IS NOT NULL GROUP BY page_id, label"


@query(f"""WITH s AS ({_MENTION_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY c DESC, l) AS k FROM s),
t AS (SELECT page_id, k, {_strip("string_split(l, ',')[1]")} AS l FROM r WHERE k <= 10 AND c >= 0.1)
SELECT page_id, string_agg(l, '|' ORDER BY k) AS labels FROM t WHERE NOT regexp_matches(l, 'n[0-9]') AND length(l) >= 3
AND lower(l) NOT IN ({", ".join(f"'{x}'" for x in entities.GENERIC_LABELS)}) GROUP BY page_id""")
def top_labels(spark, sf_dir):
    """Mention labels of a page scored by how seldom they are, as image labels are by confidence."""
    counted = table(spark, sf_dir, "mentions").where("label is not null").groupBy("page_id", "label").agg((1.0 / (1 + F.count(F.lit(1)))).alias("confidence"))
    scores = counted.groupBy("page_id").agg(F.collect_list(F.struct("label", "confidence")).alias("scores"))
    return scores.select("page_id", F.array_join(entities.top_labels(F.col("scores")), "|").alias("labels")).where("labels <> ''")


def _text_scores():
    """A classifier whose images are texts: the text itself, and a label that is always dropped."""
    return lambda raw: [(raw.decode(), 0.9), ("screen", 0.5), (raw.decode(), 0.05)]


@query(rf"""WITH a AS (SELECT DISTINCT mention_id, page_id, {_strip("string_split(text, ',')[1]")} AS l FROM mentions WHERE text IS NOT NULL)
SELECT 'Page ' || page_id AS src, l AS dst, count(*) AS n FROM a WHERE NOT regexp_matches(l, 'n[0-9]') AND length(l) >= 3
AND lower(l) NOT IN ({", ".join(f"'{x}'" for x in entities.GENERIC_LABELS)}) GROUP BY 1, 2""")
def image_links(spark, sf_dir):
    """Links from file titles to labels; the images are the texts of the mentions."""
    rows = table(spark, sf_dir, "mentions").select("mention_id", "page_id", "text").distinct()
    path = F.concat(F.lit("images/Page_"), "page_id", F.lit("_"), "mention_id", F.lit(".jpg"))
    images = rows.select(path.alias("path"), F.col("text").cast("binary").alias("content"))
    return pipeline.image_links(images, _text_scores).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a AS algorithm_name, s AS scenario, 1::BIGINT AS runs, 100.0::DOUBLE AS success_rate FROM (VALUES ('Sequential insertion'), ('Mix and Batch')) x(a), (VALUES ('top')) y(s)""")
def evaluation_summary(spark, sf_dir):
    """Two strategies, one run each, over the top hub's clique, saved and read again: all rows are loaded."""
    edges = pipeline.build_scenarios(_links(spark, sf_dir))["s1"]
    store = graph.GraphStore(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    some = tuple(s for s in config.STRATEGIES if s.kind in ("sequential", "mix_and_batch"))
    metrics = evaluate.evaluate(store, {"top": materialize(edges)}, some, 1)
    saved = evaluate.save(metrics, f"{shared_dir(spark)}/results-{uuid.uuid4().hex}")
    return evaluate.summary(spark.read.schema(schema.METRICS).json(saved)).select("algorithm_name", "scenario", "runs", "success_rate")
