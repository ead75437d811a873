"""Queries of the insight operators over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import paths, text
from tessella.operators import insights
from tessella.plans.registry import query
from tessella.sources import views
from tessella.sources.views import DAY, FILES, NOW, USAGE

_SUMMARIES = f"""WITH {FILES}, summaries AS (SELECT path, parent_path, kind, size AS byte_size, sha256(text) AS source_hash, modified_s FROM files)"""


@query("agg01_region_summary", f"WITH {FILES} SELECT coalesce(hint_cat, 'unknown') AS category, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def _(spark, sf):
    return insights.region_summary(views.files(spark, sf))


@query("agg02_language_breakdown", "SELECT lang AS language, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang")
def _(spark, sf):
    return insights.language_breakdown(views.table(spark, sf, "documents").select(F.col("lang").alias("language")))


@query("agg03_child_histogram", f"WITH {FILES} SELECT parent_path, hint_cat, count(*) AS n FROM files WHERE hint_cat IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return insights.child_histogram(views.files(spark, sf))


_BY_SOURCE = "documents AS (SELECT '/corpus/' || source AS parent_path, lang AS hint_cat FROM main.documents), h AS (SELECT parent_path, hint_cat, count(*) AS n FROM documents GROUP BY ALL)"


@query("agg04_dominant_category", f"""WITH {_BY_SOURCE}, r AS (SELECT *, n / sum(n) OVER (PARTITION BY parent_path) AS confidence FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY n DESC, hint_cat) AS place FROM r WHERE hint_cat IN ('en', 'fr', 'de'))
SELECT parent_path, hint_cat AS category, confidence FROM b WHERE place = 1 AND confidence >= 0.6""")
def _(spark, sf):
    d = views.table(spark, sf, "documents").select(F.concat(F.lit("/corpus/"), "source").alias("parent_path"), F.col("lang").alias("hint_cat"), F.lit("file").alias("kind"))
    return insights.dominant_category(insights.child_histogram(d), ["en", "fr", "de"])


@query("agg05_exact_duplicates", _SUMMARIES + " SELECT source_hash, count(*) AS n, min(path) AS first_path FROM summaries GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return insights.exact_duplicates(views.summaries(spark, sf))


@query("agg05_duplicate_members", _SUMMARIES + " SELECT source_hash, path FROM summaries WHERE source_hash IN (SELECT source_hash FROM summaries GROUP BY 1 HAVING count(*) > 1)")
def _(spark, sf):
    return insights.duplicate_members(views.summaries(spark, sf))


@query("agg07_health", f"""WITH {FILES} SELECT * FROM (
SELECT 'files' AS metric, count(*) AS n FROM files UNION ALL SELECT 'dirs', 0 UNION ALL SELECT 'bytes', CAST(sum(size) AS BIGINT) FROM files
UNION ALL SELECT 'chunks', count(*) FROM embeddings UNION ALL SELECT 'embedded_chunks', count(embedding) FROM embeddings UNION ALL SELECT 'chunked_files', count(DISTINCT label) FROM embeddings
UNION ALL SELECT 'summaries', count(*) FROM files UNION ALL SELECT 'unhashed', 0)""")
def _(spark, sf):
    chunks = views.table(spark, sf, "embeddings").select("embedding", F.col("label").alias("entry_path"))
    return insights.health(views.files(spark, sf), chunks, views.summaries(spark, sf))


@query("agg12_usage_by_tool", f"WITH {USAGE} SELECT tool, count(*) AS calls, CAST(sum(bytes_served) AS BIGINT) AS bytes_served, CAST(sum(bytes_counterfactual) AS BIGINT) AS bytes_counterfactual FROM usage GROUP BY tool")
def _(spark, sf):
    return insights.usage_summary(views.usage(spark, sf), ["tool"])


@query("agg12_usage_by_basis", f"WITH {USAGE} SELECT served_basis, count(*) AS calls, CAST(sum(bytes_served) AS BIGINT) AS bytes_served, CAST(sum(bytes_counterfactual) AS BIGINT) AS bytes_counterfactual FROM usage GROUP BY 1")
def _(spark, sf):
    return insights.usage_summary(views.usage(spark, sf), ["served_basis"])


@query("agg12_usage_by_session", f"WITH {USAGE} SELECT session_id, count(*) AS calls, CAST(sum(bytes_served) AS BIGINT) AS bytes_served, CAST(sum(bytes_counterfactual) AS BIGINT) AS bytes_counterfactual FROM usage GROUP BY 1")
def _(spark, sf):
    return insights.usage_summary(views.usage(spark, sf), ["session_id"])


@query("agg12_usage_since", f"""WITH {USAGE} SELECT count(*) AS calls, CAST(coalesce(sum(bytes_served), 0) AS BIGINT) AS bytes_served, CAST(coalesce(sum(bytes_counterfactual), 0) AS BIGINT) AS bytes_counterfactual FROM usage WHERE usage."at" >= (SELECT max(u."at") - 604800 FROM usage u)""")
def _(spark, sf):
    usage = views.usage(spark, sf)
    return insights.usage_summary(usage, since=usage.agg(F.max("at")).first()[0] - insights.WEEK)


@query("agg13_savings", f"""WITH {USAGE}, t AS (SELECT tool, count(*) AS calls, CAST(sum(bytes_served) AS BIGINT) AS bytes_served, CAST(sum(bytes_counterfactual) AS BIGINT) AS bytes_counterfactual FROM usage GROUP BY tool)
SELECT *, CAST(floor(greatest(bytes_counterfactual - bytes_served, 0) / 4) AS BIGINT) AS tokens_saved,
CAST(least(99, floor(100.0 * greatest(bytes_counterfactual - bytes_served, 0) / bytes_counterfactual + 0.5)) AS BIGINT) AS percent_saved FROM t""")
def _(spark, sf):
    return insights.savings(insights.usage_summary(views.usage(spark, sf), ["tool"]))


@query("agg14_weekly_diff", f"""WITH {FILES}, r AS (SELECT CASE WHEN first_indexed_at >= {NOW - 340 * DAY} THEN 'added' ELSE 'modified' END AS change, path,
CASE WHEN first_indexed_at >= {NOW - 340 * DAY} THEN first_indexed_at ELSE modified_s END AS "at" FROM files WHERE first_indexed_at >= {NOW - 340 * DAY} OR modified_s >= {NOW - 340 * DAY})
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY change ORDER BY "at" DESC, path) <= 500""")
def _(spark, sf):
    return insights.weekly_diff(views.files(spark, sf), NOW - 340 * DAY)


@query("agg15_stale", f"WITH {FILES} SELECT path, modified_s, CAST(floor(({NOW} - modified_s) / {DAY}) AS BIGINT) AS age_days FROM files WHERE modified_s IS NULL OR modified_s < {NOW - 180 * DAY} ORDER BY modified_s NULLS FIRST, path LIMIT 500")
def _(spark, sf):
    return insights.stale(views.files(spark, sf), NOW, 180)


@query("agg16_unlabelled_files", "SELECT '/conv/' || conv_id AS entry_path, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND count(CASE WHEN role = 'system' THEN 1 END) = 0")
def _(spark, sf):
    c = views.table(spark, sf, "conversations")
    return insights.unlabelled_files(c.select(F.concat(F.lit("/conv/"), F.col("conv_id").cast("string")).alias("entry_path"), F.when(F.col("role") == "system", "x").otherwise("").alias("language")))


@query("agg20_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", insights.content_hash(F.col("text")).alias("content_hash"))


@query("agg20_directory_hashes", _SUMMARIES + r""" SELECT parent_path, sha256(string_agg(path || chr(0) || source_hash || chr(0), '' ORDER BY path)) AS source_hash FROM summaries GROUP BY parent_path""")
def _(spark, sf):
    return insights.directory_hashes(views.summaries(spark, sf))


@query("agg21_mean_vectors", "SELECT entry_path, pos - 1 AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM (SELECT '/vec/' || label AS entry_path, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def _(spark, sf):
    chunks = views.table(spark, sf, "embeddings").select(F.concat(F.lit("/vec/"), F.col("label").cast("string")).alias("entry_path"), "embedding")
    return insights.mean_vectors(chunks).withColumn("value", F.round("value", 6))


@query("join15_counterfactual_sizes", f"WITH {FILES}, w AS (SELECT DISTINCT path FROM files WHERE size % 2 = 0 UNION SELECT '/missing') SELECT w.path, coalesce(nullif(f.size, 0), 0) AS bytes FROM w LEFT JOIN files f ON w.path = f.path")
def _(spark, sf):
    f = views.files(spark, sf)
    wanted = f.where("size % 2 = 0").select("path").unionByName(spark.createDataFrame([("/missing",)], "path string"))
    return insights.counterfactual_sizes(wanted, f, views.summaries(spark, sf))


@query("srt02_largest", f"WITH {FILES} SELECT path, size FROM files ORDER BY size DESC, path LIMIT 20")
def _(spark, sf):
    return insights.largest(views.files(spark, sf))


@query("grf21_co_change", f"""WITH {views.COMMITS}, s AS (SELECT commit FROM commits GROUP BY commit HAVING count(*) BETWEEN 2 AND 50)
SELECT a.path AS path_a, b.path AS path_b, count(*) AS n FROM commits a JOIN commits b ON a.commit = b.commit AND a.path < b.path JOIN s ON s.commit = a.commit GROUP BY ALL""")
def _(spark, sf):
    return insights.co_change(views.commits(spark, sf))


@query("grf20_co_change_of", f"""WITH {views.COMMITS}, s AS (SELECT commit FROM commits GROUP BY commit HAVING count(*) BETWEEN 2 AND 50)
SELECT b.path AS path, count(*) AS count FROM commits a JOIN commits b ON a.commit = b.commit AND a.path <> b.path JOIN s ON s.commit = a.commit WHERE a.path = '/supp1' GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    pairs = insights.canonical_pairs(insights.co_change(views.commits(spark, sf)).withColumnRenamed("n", "count"))
    return insights.co_change_of(pairs, "/supp1")


@query("strf1_abstract", r"""SELECT doc_id, CASE WHEN length(s) > 120 THEN substr(s, 1, 120) || '…' ELSE s END AS abstract FROM (
SELECT doc_id, CASE WHEN m <> '' THEN m ELSE t END AS s FROM (SELECT doc_id, trim(text, ' ') AS t, regexp_extract(trim(text, ' '), '(?s)^(.*?[.!?])(\s|$)', 1) AS m FROM documents))""")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.abstract("text").alias("abstract"))


@query("strf4_human_bytes", """SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN format('{:.1f} GB', n / 1073741824.0) WHEN n >= 1048576 THEN format('{:.1f} MB', n / 1048576.0) WHEN n >= 1024 THEN format('{:.1f} KB', n / 1024.0) ELSE n || ' B' END AS bytes
FROM (SELECT o_orderkey, o_orderkey * 977 AS n FROM orders)""")
def _(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", text.human_bytes(F.col("o_orderkey") * 977).alias("bytes"))


@query("strf6_path_parts", f"""WITH {FILES} SELECT path, parent_path AS parent, regexp_extract(path, '[^/]*$', 0) AS base, 'txt' AS ext, length(path) - length(replace(path, '/', '')) AS depth FROM files""")
def _(spark, sf):
    return views.files(spark, sf).select("path", paths.parent("path").alias("parent"), paths.basename("path").alias("base"), paths.extension("path").alias("ext"), paths.depth("path").cast("long").alias("depth"))


@query("strf5_slug", r"""SELECT p_partkey, rtrim(substr(trim(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') AS slug FROM part""")
def _(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" -- "), "p_brand")).alias("slug"))


@query("strf3_xml_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages""")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.xml_escaped("html", True).alias("escaped"))


@query("strf7_redactions", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b(api[_-]?key|secret|token|password|passwd|access[_-]?key)\b(\s*[:=]\s*)[''"]?[A-Za-z0-9_\-./+]{12,}[''"]?')) AS BIGINT) AS n FROM documents""")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.redactions("text").alias("n"))


@query("mth01_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.approx_tokens("text").alias("tokens"))


@query("flt01_subtree", f"WITH {FILES} SELECT path, size FROM files WHERE path = '/corpus/src1' OR starts_with(path, '/corpus/src1/')")
def _(spark, sf):
    return views.files(spark, sf).where(paths.under("path", "/corpus/src1")).select("path", "size")


@query("flt13_modified_since", f"WITH {FILES} SELECT path FROM files WHERE modified_s >= {NOW - 330 * DAY}")
def _(spark, sf):
    return views.files(spark, sf).where(F.col("modified_s") >= NOW - 330 * DAY).select("path")


@query("mth02_cosine", """SELECT vec_id, round(CASE WHEN n > 0 THEN d / n ELSE 0 END, 6) AS cosine FROM (
SELECT vec_id, list_dot_product(e, q) AS d, sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) AS n FROM (
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_reverse(CAST(embedding AS DOUBLE[])) AS q FROM embeddings))""")
def _(spark, sf):
    from tessella.functions.vectors import cosine

    return views.table(spark, sf, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"))
