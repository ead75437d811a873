"""Queries of the questions to a user: what detectors find, what opens, and what answers change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import review
from tessella.plans.registry import query
from tessella.schema import empty
from tessella.sources import views
from tessella.sources.views import CALLS, DIRECTORIES, FILES, NOW

#: Copies: files of one text. Files that have an answer already (every 7th), and ones that a user weighs (every 13th).
_COPIES = """copies AS (SELECT sha256(text) AS cluster, path, doc_id FROM files WHERE text IS NOT NULL),
sets AS (SELECT cluster, min(path) AS subject, count(*) AS n, bool_or(doc_id % 7 = 0) AS covered FROM copies GROUP BY cluster HAVING count(*) > 1)"""


def _copies(spark, sf):
    f = views.files(spark, sf).where("text IS NOT NULL")
    return f.select(F.sha2("text", 256).alias("cluster"), "path", F.lit(True).alias("exact"), F.lit(1.0).alias("similarity"), "doc_id")


def _ledger(spark, rows, **values):
    """decisions with null but for what is given."""
    none = empty(spark, "decisions")
    return rows.select(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in none.schema.fields])


def _asked(spark, sf):
    c = _copies(spark, sf)
    led = _ledger(spark, c.where("doc_id % 7 = 0"), id=F.col("doc_id"), decision_type=F.lit("duplicate"), subject=F.col("path"), status=F.lit("decided"), evidence_hash=F.lit("e"), chosen=F.lit("keep_all"))
    return (led, c.where("doc_id % 7 = 0").select(F.col("doc_id").alias("decision_id"), "path"), *review.duplicates(c))


@query("dml14_askable", f"WITH {FILES}, {_COPIES} SELECT subject, n, sha256('exact' || chr(0) || '100' || chr(0) || n || chr(0) || x) AS evidence_hash FROM sets JOIN (SELECT cluster, CAST(sum(CAST('0x' || substr(sha256(path), 1, 15) AS HUGEINT)) AS VARCHAR) AS x FROM copies GROUP BY cluster) USING (cluster) WHERE NOT covered")
def _(spark, sf):
    led, touched, found, members = _asked(spark, sf)
    return review.askable(led, touched, found, members).select("subject", F.col("weight").cast("long").alias("n"), "evidence_hash")


@query("dml14_opened", f"""WITH {FILES}, {_COPIES}, o AS (SELECT cluster, subject, row_number() OVER (ORDER BY n DESC, subject) AS r FROM sets WHERE NOT covered)
SELECT r + (SELECT max(doc_id) FROM files WHERE doc_id % 7 = 0 AND text IS NOT NULL) AS decision_id, path FROM o JOIN copies USING (cluster) WHERE r <= 20""")
def _(spark, sf):
    led, touched, found, members = _asked(spark, sf)
    return review.opened(led, touched, found, NOW, members)[1]


@query("dml14_archives", f"""WITH {FILES}, {DIRECTORIES}, m AS (SELECT d.path, d.parent_path, count(*) AS files, max(f.modified_s) - CASE WHEN length(d.path) - length(replace(d.path, '/', '')) = 2 AND d.path LIKE '%1' THEN 40000000 ELSE 20000000 END AS modified_s
  FROM directories d JOIN files f ON starts_with(f.path, d.path || '/') WHERE d.path <> '/corpus' GROUP BY d.path, d.parent_path),
s AS (SELECT *, CAST(floor(({NOW} - modified_s) / 86400) AS BIGINT) AS age FROM m WHERE floor(({NOW} - modified_s) / 86400) >= 365)
SELECT path AS subject, sha256(CAST(age // 90 AS VARCHAR) || chr(0) || files) AS evidence_hash FROM s WHERE parent_path NOT IN (SELECT path FROM s) AND path NOT LIKE '%/de'""")
def _(spark, sf):
    f = views.files(spark, sf)
    d = views.directories(f).where("path <> '/corpus'")
    newest = f.select(F.explode(F.array("parent_path", F.substring_index("parent_path", "/", 3))).alias("path"), "modified_s").groupBy("path").agg(F.max("modified_s").alias("newest"))
    back = F.when((F.size(F.split("path", "/")) == 3) & F.endswith("path", F.lit("1")), 40000000).otherwise(20000000)
    entries = d.join(newest, "path").select("path", "kind", (F.col("newest") - back).alias("modified_s")).unionByName(f.select("path", "kind", "modified_s"))
    known = d.where(F.endswith("path", F.lit("/de"))).select("path", F.lit("archive").alias("category"))
    return review.archives(entries, known, NOW).select("subject", "evidence_hash")


@query("dml14_languages", """WITH f AS (SELECT '/o/f' || l_orderkey || '.' || ['kt', 'py', 'txt', 'ZIG', 'mli'][l_orderkey % 5 + 1] AS subject, ['kotlin', 'python', NULL, 'zig', 'ocaml'][l_orderkey % 5 + 1] AS auto_value, count(*) AS n
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
SELECT subject, auto_value, sha256(auto_value || chr(0) || n) AS evidence_hash FROM f WHERE n >= 3 AND auto_value IS NOT NULL""")
def _(spark, sf):
    ending = F.element_at(F.array(*map(F.lit, ("kt", "py", "txt", "ZIG", "mli"))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/o/f"), F.col("l_orderkey").cast("string"), F.lit("."), ending)
    chunks = views.table(spark, sf, "lineitem").select(path.alias("entry_path"), F.when(F.col("l_returnflag") == "R", "some").alias("language"))
    return review.languages(chunks).select("subject", "auto_value", "evidence_hash")


@query("dml14_symbols", f"""WITH {CALLS}, c AS (SELECT to_ref, count(DISTINCT from_path) AS callers FROM edges WHERE kind = 'calls' GROUP BY 1),
d AS (SELECT to_ref, count(*) AS definers, sha256(string_agg(from_path, chr(0) ORDER BY from_path) || chr(0)) AS evidence_hash FROM (SELECT DISTINCT to_ref, from_path FROM edges WHERE kind = 'defines') GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT * FROM c JOIN d USING (to_ref) ORDER BY callers DESC, to_ref LIMIT 10) SELECT to_ref AS subject, callers, evidence_hash FROM h WHERE definers <= 6""")
def _(spark, sf):
    return review.symbols(views.calls(spark, sf))[0].select("subject", F.col("weight").cast("long").alias("callers"), "evidence_hash")


@query("dml14_drifts", """SELECT n.vec_id, sha256(n.label || chr(0) || 'b') AS evidence_hash FROM (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding FROM embeddings) n JOIN embeddings o ON o.vec_id = n.vec_id + 1
WHERE coalesce(list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 0) < 0.8""")
def _(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("source_hash"), "embedding", F.lit("").alias("summary"), F.lit("").alias("summary_l0"))
    new = e.withColumn("path", F.col("vec_id").cast("string")).withColumn("model", F.lit("b"))
    # What stood there before: the next row's vector, of the same content.
    old = new.select("path", "source_hash").join(e.select((F.col("vec_id") - 1).cast("string").alias("path"), "embedding", "summary", "summary_l0", F.lit("a").alias("model")), "path")
    return review.drifts(old, new).select(F.col("subject").cast("long").alias("vec_id"), "evidence_hash")


def _answers(spark, sf):
    """Every set of copies has an answer: its first path, or all where their number is odd."""
    c = _copies(spark, sf)
    sets = c.groupBy("cluster").agg(F.min("path").alias("subject"), F.count("*").alias("n"), F.min("doc_id").alias("id")).where("n > 1")
    led = _ledger(spark, sets, id=F.col("id"), decision_type=F.lit("duplicate"), subject=F.col("subject"), status=F.lit("decided"), chosen=F.when(F.col("n") % 2 == 1, "keep_all").otherwise(F.col("subject")))
    return led, c.join(sets.select("cluster", F.col("id").alias("decision_id")), "cluster").select("decision_id", "path")


@query("dml13_weights", f"""WITH {FILES}, {_COPIES}, ids AS (SELECT cluster, min(doc_id) AS id FROM copies GROUP BY cluster),
silent AS (SELECT path, 'decision:' || id || ' duplicate of ' || subject AS reason FROM copies JOIN sets USING (cluster) JOIN ids USING (cluster) WHERE n % 2 = 0 AND path <> subject),
kept AS (SELECT path AS target, 2.0 AS weight, NULL AS reason FROM files WHERE doc_id % 13 = 0 UNION ALL SELECT path, 0.0, 'decision:0 duplicate of /x' FROM files WHERE doc_id % 13 = 1 AND path NOT IN (SELECT path FROM copies JOIN sets USING (cluster)))
SELECT target, CAST(weight AS DOUBLE) AS weight, reason FROM kept UNION ALL SELECT path, CAST(0.0 AS DOUBLE), reason FROM silent WHERE path NOT IN (SELECT target FROM kept)""")
def _(spark, sf):
    led, touched = _answers(spark, sf)
    f = views.files(spark, sf).where("doc_id % 13 < 2")
    own = F.col("doc_id") % 13 == 1
    weights = f.select(F.lit("file").alias("target_kind"), F.col("path").alias("target"), F.when(own, 0.0).otherwise(2.0).alias("weight"), F.lit("user").alias("source"), F.when(own, "decision:0 duplicate of /x").alias("reason"), F.lit(1).cast("long").alias("updated_at"))
    return review.weights_after(weights, led, touched, NOW).select("target", "weight", "reason")


@query("grf05_pinned", f"""WITH {CALLS}, d AS (SELECT to_ref, from_path FROM edges WHERE kind = 'defines'), pin AS (SELECT to_ref, max(from_path) AS pin FROM d WHERE CAST(substr(to_ref, 5) AS BIGINT) % 3 = 0 GROUP BY 1)
SELECT to_ref AS symbol, from_path AS definer FROM d LEFT JOIN pin USING (to_ref) WHERE pin IS NULL OR from_path = pin""")
def _(spark, sf):
    edges = views.calls(spark, sf)
    said = edges.where("kind = 'defines' AND CAST(substr(to_ref, 5) AS BIGINT) % 3 = 0").groupBy("to_ref").agg(F.max("from_path").alias("chosen"))
    led = _ledger(spark, said, id=F.lit(1), decision_type=F.lit("symbol_ambiguity"), subject=F.col("to_ref"), status=F.lit("decided"), chosen=F.col("chosen"))
    return review.pinned(edges, led).where("kind = 'defines'").select(F.col("to_ref").alias("symbol"), F.col("from_path").alias("definer"))
