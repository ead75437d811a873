"""Queries of similarity, parsing, export and summaries of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import chunking, evaluation, export, graph, search, similar, state
from tessella.plans.registry import query
from tessella.plans.search_queries import _GOLD, _gold
from tessella.sources import ingest, views
from tessella.sources.views import FILES


def _vectors(spark, sf):
    return views.table(spark, sf, "embeddings").select(F.format_string("/vec/%06d", "vec_id").alias("path"), "embedding")


_PAIRS = """pairs AS (SELECT a.p AS a, b.p AS b, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s
FROM (SELECT format('/vec/{:06d}', vec_id) AS p, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT format('/vec/{:06d}', vec_id) AS p, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.p < b.p)"""


@query("agg06_similar_pairs", f"WITH {_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM pairs WHERE s >= 0.4")
def _(spark, sf):
    return similar.similar_pairs(_vectors(spark, sf), 0.4).withColumn("similarity", F.round("similarity", 6))


@query("agg06_clusters", f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE s >= 0.4 UNION ALL SELECT b, a FROM pairs WHERE s >= 0.4),
r AS (SELECT DISTINCT a AS path, a AS other FROM e UNION SELECT r.path, e.b FROM r JOIN e ON e.a = r.other) SELECT path, min(other) AS cluster FROM r GROUP BY path""")
def _(spark, sf):
    return similar.clusters(_vectors(spark, sf), 0.4)


@query("evl03_summary", f"""WITH {_GOLD}, r AS (SELECT ranking.question, place, g.doc_id IS NOT NULL AS rel FROM ranking LEFT JOIN gold g ON g.question = ranking.question AND g.doc_id = ranking.doc_id WHERE place < 10),
s AS (SELECT question, count(CASE WHEN rel THEN 1 END) AS m, min(CASE WHEN rel THEN place END) + 1 AS f FROM r GROUP BY question)
SELECT count(*) AS questions, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM s""")
def _(spark, sf):
    gold, ranking = _gold(spark, sf)
    a = evaluation.aggregate(evaluation.scores(ranking, gold, 10))
    return a.select("questions", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@query("ret22_catalog", f"WITH {FILES} SELECT parent_path AS path, max(1.0 / (1 + doc_id % 17)) AS score FROM files GROUP BY 1")
def _(spark, sf):
    f = views.files(spark, sf)
    return f.groupBy(F.col("parent_path").alias("path")).agg(F.max(1.0 / (1 + F.col("doc_id") % 17)).alias("score"))


@query("ret27_chunk_window", "SELECT turn AS seq, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn BETWEEN 0 AND 4")
def _(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("entry_path"), F.col("turn").alias("seq"), "text")
    first = views.table(spark, sf, "conversations").agg(F.min("conv_id")).first()[0]
    return search.window_of(c, str(first), 2, 2).select("seq", "text")


@query("snk02_tree_lines", f"""WITH {FILES} SELECT path, '      - **doc' || doc_id || '.txt** — ' || lang AS line FROM (SELECT path, doc_id, split_part(path, '/', 4) AS lang FROM files)""")
def _(spark, sf):
    f = views.files(spark, sf)
    return export.tree_lines(f.select("path", "kind", F.lit(4).alias("depth"), F.element_at(F.split("path", "/"), 4).alias("summary")))


@query("snk04_mermaid", """SELECT source, target, '  n' || substr(sha256(source), 1, 10) || '["' || source || '"] -->|' || weight || '| n' || substr(sha256(target), 1, 10) || '["' || target || '"]' AS line
FROM (SELECT 'r' || r_regionkey AS source, n_name AS target, n_nationkey AS weight FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def _(spark, sf):
    n = views.table(spark, sf, "nation").join(views.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return export.mermaid_lines(n.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("source"), F.col("n_name").alias("target"), F.col("n_nationkey").alias("weight")))


@query("snk05_snapshot")
def _(spark, sf):
    weights = spark.createDataFrame([("dir", "/corpus", 2.0)], "target_kind string, target string, weight double")
    return export.snapshot(views.summaries(spark, sf), views.links(spark, sf), weights)


@query("src11_pages")
def _(spark, sf):
    p = views.table(spark, sf, "pages").select(F.concat("url", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return ingest.chunks(ingest.parsed(p))


@query("src04_binary", "SELECT page_id, false AS is_binary FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", ingest.binary(F.col("html").cast("binary")).alias("is_binary"))


@query("chk03_markdown")
def _(spark, sf):
    return chunking.markdown_chunks(views.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entry_path"), "text"))


@query("chk05_context_prefix", "SELECT doc_id, 'File: /d' || doc_id || chr(10) || 'Section: ' || lang || chr(10) || 'Document context: ' || substr(text, 1, 500) AS prefix FROM documents")
def _(spark, sf):
    path = F.concat(F.lit("/d"), F.col("doc_id").cast("string"))
    return views.table(spark, sf, "documents").select("doc_id", chunking.context_prefix(path, F.col("lang"), F.col("text")).alias("prefix"))


@query("src02_admitted", "SELECT page_id FROM pages WHERE NOT contains('/' || regexp_replace(url, '^https?://', '') || '/', '/vendor/') AND length(html) <= 8388608")
def _(spark, sf):
    p = views.table(spark, sf, "pages")
    return p.where(ingest.admitted(F.regexp_replace("url", "^https?:/+", "/"), F.length("html"))).select("page_id")


@query("grf10_link_hosts", """WITH e AS (SELECT DISTINCT url AS a, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS b FROM pages) SELECT b AS path, count(*) AS in_degree FROM e GROUP BY b""")
def _(spark, sf):
    g = views.links(spark, sf).select(F.col("from_path").alias("source"), F.col("to_ref").alias("target"))
    return graph.degrees(g).where("in_degree > 0").select("path", "in_degree")


@query("dml14_duplicate_findings")
def _(spark, sf):
    from tessella.operators import insights

    return state.duplicate_findings(insights.duplicate_members(views.summaries(spark, sf)))
