"""Queries of documents as lines, and of questions and what is said about them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import export, questions
from tessella.plans.registry import query
from tessella.sources import views
from tessella.sources.views import DIRECTORIES, FILES, NOW


@query("snk02_document", f"""WITH {FILES}, {DIRECTORIES}, n AS (SELECT path, kind, coalesce(left(text, 80), '') AS summary FROM files UNION ALL SELECT path, kind, '' FROM directories),
b AS (SELECT repeat('#', least(length(path) - length(replace(path, '/', '')) + 1, 6)) || CASE WHEN kind = 'dir' THEN ' 📁 ' ELSE ' 📄 ' END || regexp_extract(path, '[^/]*$') || chr(10) || chr(10) || '`' || path || '`' || chr(10) || chr(10) || '<!-- model=m generated_at=5 source_hash= -->' || chr(10) || chr(10)
  || '**Abstract:** short' || chr(10) || chr(10) || summary || chr(10) AS line FROM n)
SELECT line FROM b UNION ALL SELECT '# Index: /corpus' || chr(10) || chr(10) || '> ~' || CAST(ceil(sum(length(line) + 1) / 4) AS BIGINT) || ' tokens (estimate, chars/4)' || chr(10) FROM b""")
def _(spark, sf):
    f = views.files(spark, sf)
    rows = f.select("path", "parent_path", "kind", F.substring("text", 1, 80).alias("summary")).unionByName(views.directories(f).withColumn("summary", F.lit(None).cast("string")))
    depth = (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("long")
    rows = rows.withColumns({"depth": depth, "summary_l0": F.lit("short"), "model": F.lit("m"), "generated_at": F.lit(5), "source_hash": F.lit(None).cast("string")})
    return export.tree_document(rows, "/corpus").select("line")


@query("snk02_nested", f"""WITH {FILES}, {DIRECTORIES}, n AS (SELECT path, parent_path FROM directories UNION ALL SELECT path, parent_path FROM files), k AS (SELECT parent_path AS path, count(*) AS kids FROM n GROUP BY 1)
SELECT path, coalesce(kids, 0) AS kids, row_number() OVER (ORDER BY (SELECT string_agg(chr(1) || CASE WHEN i = len(s) AND s[i] LIKE 'doc%' THEN '0' ELSE '1' END || s[i], '' ORDER BY i) FROM (SELECT string_split(substr(n.path, 2), '/') AS s) t, range(1, len(s) + 1) r(i))) AS rank FROM n LEFT JOIN k USING (path)""")
def _(spark, sf):
    f = views.files(spark, sf)
    rows = f.select("path", "parent_path", "kind").unionByName(views.directories(f))
    none = F.lit(None).cast("string")
    depth = (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("long")
    rows = rows.withColumns({"depth": depth, "summary": none, "summary_l0": none, "model": none, "generated_at": none, "source_hash": none})
    lines = export.tree_document(rows, "/corpus", "xml")
    at = lines.select("place", F.nullif(F.regexp_extract("line", r'<(?:file|directory) path="([^"]*)"', 1), F.lit("")).alias("path"), F.coalesce(F.nullif(F.regexp_extract("line", r'<children count="(\d+)"', 1), F.lit("")).cast("long"), F.lit(0)).alias("kids")).where("path IS NOT NULL")
    return at.select("path", "kids", F.row_number().over(Window.orderBy("place")).cast("long").alias("rank"))


@query("snk03_bundle", f"""WITH {FILES}, n AS (SELECT split_part(path, '/', 4) AS pack_id, 'doc' || doc_id || '-txt-' || substr(sha256(text), 1, 8) || '.md' AS name, 'doc' || doc_id || '.txt' AS title, path, sha256(text) AS hash FROM files)
SELECT pack_id, name, '---' || chr(10) || 'type: "file"' || chr(10) || 'title: "' || title || '"' || chr(10) || 'description: "short"' || chr(10) || 'resource: "' || path || ' (sha256:' || hash || ')"' || chr(10) || 'timestamp: "2025-01-01T00:00:00Z"' || chr(10) || 'model: ""' || chr(10) || 'source_hash: "' || hash || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || 'said' || chr(10) AS line FROM n
UNION ALL SELECT pack_id, 'index.md', '* [' || title || '](' || name || ') - short' FROM n
UNION ALL SELECT pack_id, 'manifest.jsonl', '{{"path":"' || path || '","hash":"' || hash || '","filename":"' || name || '","is_root":true}}' FROM n
UNION ALL SELECT DISTINCT pack_id, 'index.md', '# Pack ' || pack_id || chr(10) || chr(10) || 'A bundle of knowledge.' || chr(10) FROM n
UNION ALL SELECT DISTINCT pack_id, 'log.md', '# Pack ' || pack_id || ' — changelog' || chr(10) FROM n
UNION ALL SELECT DISTINCT pack_id, 'log.md', CASE WHEN pack_id = 'en' THEN '- **Creation** (2025-01-01T00:00:00Z): created' ELSE '(no recorded history)' END FROM n""")
def _(spark, sf):
    f = views.files(spark, sf).where("text IS NOT NULL")
    nodes = f.select(F.element_at(F.split("path", "/"), 4).alias("pack_id"), "path", "kind", F.lit("said").alias("summary"), F.lit("short").alias("summary_l0"), F.lit(None).cast("string").alias("model"), F.lit(NOW).alias("generated_at"), F.sha2("text", 256).alias("source_hash"), F.lit(True).alias("is_root"))
    packs = nodes.select(F.col("pack_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("Pack "), "id"))
    events = packs.where("id = 'en'").select(F.col("id").alias("pack_id"), F.lit(1).alias("id"), F.lit("created").alias("event"), F.lit(None).cast("string").alias("detail"), F.lit(NOW).alias("at"))
    return export.pack_bundle(nodes, events, packs).select("pack_id", "name", "line")


@query("snk04_weights", """SELECT '| ' || c_name || ' | file | ' || CAST(c_custkey % 8 AS VARCHAR) || '.50 | ' || coalesce(c_mktsegment, '') || ' |' AS line FROM customer
UNION ALL SELECT chr(10) || '## Importance weights' || chr(10) || chr(10) || '| target | kind | weight | reason |' || chr(10) || '|---|---|---|---|'""")
def _(spark, sf):
    c = views.table(spark, sf, "customer")
    return export.weight_lines(c.select(F.lit("file").alias("target_kind"), F.col("c_name").alias("target"), (F.col("c_custkey") % 8 + 0.5).alias("weight"), F.col("c_mktsegment").alias("reason"))).select("line")


@query("snk04_graph", """SELECT '  <edge from="/c/' || o_custkey || '" to="/p/' || o_orderpriority || '" weight="' || count(*) || '"/>' AS line FROM orders GROUP BY o_custkey, o_orderpriority UNION ALL SELECT '<code-graph truncated="false">' UNION ALL SELECT '</code-graph>'""")
def _(spark, sf):
    o = views.table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("weight"))
    return export.graph_lines(o.select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("/p/"), "o_orderpriority").alias("target"), "weight"), "xml").select("line")


@query("snk06_report", """WITH q AS (SELECT conv_id AS n, coalesce(text, '') AS text FROM conversations WHERE turn = 0), a AS (SELECT conv_id AS n, coalesce(text, '') AS text FROM conversations WHERE turn = 1), s AS (SELECT conv_id AS n, '/t/' || turn AS path FROM conversations WHERE turn >= 2)
SELECT '# Report' || chr(10) || chr(10) || '_generated now · ' || count(*) || ' queries_' || chr(10) || chr(10) || '## Contents' || chr(10) AS line FROM q
UNION ALL SELECT n || '. [' || text || '](#' || n || '-' || regexp_replace(lower(text), '[^a-z0-9]', '-', 'g') || ')' FROM q
UNION ALL SELECT chr(10) || '## ' || q.n || '. ' || q.text || chr(10) || chr(10) || coalesce(a.text, '') || chr(10) FROM q LEFT JOIN a USING (n)
UNION ALL SELECT '**Sources:**' || chr(10) FROM (SELECT DISTINCT n FROM s) t WHERE n IN (SELECT n FROM q)
UNION ALL SELECT '- `' || path || '`' FROM s WHERE n IN (SELECT n FROM q)""")
def _(spark, sf):
    c = views.table(spark, sf, "conversations").withColumn("n", F.col("conv_id"))
    answers = c.where("turn = 0").select("n", F.col("text").alias("question")).join(c.where("turn = 1").select("n", F.col("text").alias("answer")), "n", "left")
    sources = c.where("turn >= 2").select("n", F.col("turn").alias("rank"), F.concat(F.lit("/t/"), F.col("turn").cast("string")).alias("path"), F.lit("").alias("heading"))
    return export.report_lines(answers, sources, generated_at="now").select("line")


@query("msc13_savings", f"""WITH {FILES}, s AS (SELECT doc_id % 97 AS answer, path, size AS bytes FROM files WHERE size > 0), t AS (SELECT answer, CAST(sum(bytes) AS BIGINT) AS whole FROM s GROUP BY answer), m AS (SELECT * FROM t WHERE whole > answer * 1000)
SELECT answer, path, bytes FROM s WHERE answer IN (SELECT answer FROM m) UNION ALL SELECT answer, NULL, whole FROM m""")
def _(spark, sf):
    f = views.files(spark, sf)
    cited = f.select((F.col("doc_id") % 97).alias("answer"), "path")
    served = cited.select("answer").distinct().withColumn("bytes", F.col("answer") * 1000)
    return export.savings_lines(cited, served, f, views.summaries(spark, sf)).select("answer", "path", "bytes")


_ASKED = """ledger AS (SELECT event_id AS id, ['classification', 'archive', 'duplicate', 'later'][event_id % 4 + 1] AS decision_type, '/u/' || user_id AS subject, CASE WHEN event_id % 3 = 0 THEN 'decided' ELSE 'open' END AS status FROM events)"""


def _asked(spark, sf):
    e = views.table(spark, sf, "events")
    kind = F.element_at(F.array(*map(F.lit, ("classification", "archive", "duplicate", "later"))), (F.col("event_id") % 4 + 1).cast("int"))
    options = F.when(kind == "archive", '["archive","keep_active"]').when(kind == "duplicate", '["/a","/b","keep_all"]').otherwise('["work","ignore"]')
    params = F.concat(F.lit('{"days":'), F.col("event_id").cast("string"), F.lit(',"files":3,"exact":true}'))
    nothing = {c: F.lit(None).cast("long") for c in ("parent_id", "superseded_by", "effects_applied_at", "decided_at")} | {c: F.lit(None).cast("string") for c in ("chosen", "source", "effects")}
    return e.select(
        F.col("event_id").alias("id"), kind.alias("decision_type"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("subject"), F.when(F.col("event_id") % 3 == 0, "decided").otherwise("open").alias("status"), options.alias("options"), params.alias("params"),
        F.lit("work").alias("auto_value"), F.lit(0.7).alias("confidence"), (F.col("event_id") % 7).cast("string").alias("evidence_hash"), F.lit(5).cast("long").alias("priority"), F.lit(1).cast("long").alias("created_at"), *[v.alias(k) for k, v in nothing.items()],
    )


@query("msc12_questions", f"""WITH {_ASKED} SELECT id, CASE decision_type WHEN 'classification' THEN subject || ' looks like work (70%)' WHEN 'archive' THEN subject || ' hasn''t changed in ' || id || ' days — archive it?'
WHEN 'duplicate' THEN '2 copies of ' || substr(subject, 4) || ' — which is canonical?' ELSE decision_type || ': ' || subject END AS title,
CASE decision_type WHEN 'archive' THEN ['Archive (kept indexed, down-weighted in search)', 'Keep active (ask again if it stays untouched)'] WHEN 'duplicate' THEN ['/a', '/b', 'Keep all (no canonical)'] ELSE ['work (suggested)', 'Ignore (stop suggesting)'] END AS labels FROM ledger""")
def _(spark, sf):
    return questions.rendered(_asked(spark, sf)).select("id", "title", "labels")


@query("msc11_checked", f"""WITH {_ASKED}, a AS (SELECT * FROM ledger UNION ALL SELECT -1 - id, decision_type, subject, 'none' FROM ledger WHERE id % 10 = 0)
SELECT id, CASE WHEN status = 'none' THEN 'no decision ' || id WHEN status = 'decided' THEN 'decision is decided, not open' WHEN decision_type = 'later' THEN 'unknown type later' WHEN decision_type = 'classification' THEN 'not an option of: work, ignore'
WHEN decision_type = 'duplicate' THEN 'not an option of: /a, /b, keep_all' END AS refusal FROM a""")
def _(spark, sf):
    ledger = _asked(spark, sf)
    answers = ledger.select("id").unionByName(ledger.where("id % 10 = 0").select((-1 - F.col("id")).alias("id"))).withColumn("chosen", F.lit("archive"))
    return questions.checked(ledger, answers).select("id", "refusal")


@query("msc11_batch_refusal", f"""WITH {_ASKED} SELECT id, NOT (decision_type = 'classification' AND id % 5 < 2 OR decision_type = 'archive' AND id % 5 = 1) AS refused FROM ledger""")
def _(spark, sf):
    chosen = F.element_at(F.array(*map(F.lit, ("work", "archive", "all", "/a", "restore_old"))), (F.col("id") % 5 + 1).cast("int"))
    return _asked(spark, sf).select("id", questions.batch_refusal(F.col("decision_type"), chosen).isNotNull().alias("refused"))


@query("msc12_predismissed", f"""WITH {_ASKED}, f AS (SELECT DISTINCT decision_type, subject FROM ledger WHERE subject LIKE '%7')
SELECT l.decision_type, l.subject, CASE WHEN f.subject IS NOT NULL AND l.status = 'open' THEN 'dismissed' ELSE l.status END AS status FROM ledger l LEFT JOIN f USING (decision_type, subject)
UNION ALL SELECT decision_type, subject, 'dismissed' FROM f""")
def _(spark, sf):
    ledger = _asked(spark, sf)
    found = ledger.where("subject LIKE '%7'").select("decision_type", "subject", F.lit("new").alias("evidence_hash"), "params", "auto_value", "confidence", "priority").distinct()
    return questions.predismissed(ledger, found, NOW).select("decision_type", "subject", "status")


@query("msc11_backfilled", f"""WITH {FILES} SELECT path AS subject, CASE WHEN doc_id % 3 = 0 THEN 'ignore' ELSE split_part(path, '/', 4) END AS chosen, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 1 END AS decided_at FROM files WHERE doc_id % 3 < 2""")
def _(spark, sf):
    f = views.files(spark, sf)
    rest = F.col("doc_id") % 3
    known = f.select("path", F.lit("dir").alias("kind"), F.element_at(F.split("path", "/"), 4).alias("category"), F.lit(1.0).alias("confidence"), F.when(rest == 0, "ignored").when(rest == 1, "user").otherwise("auto").alias("source"), F.when(F.col("doc_id") % 2 == 0, 7).cast("long").alias("confirmed_at"), F.lit(1).cast("long").alias("created_at"))
    ledger = _asked(spark, sf).where("decision_type = 'archive'")
    touched = ledger.select(F.col("id").alias("decision_id"), F.col("subject").alias("path"))
    return questions.backfilled(ledger, touched, known, NOW)[0].where("decision_type = 'classification'").select("subject", "chosen", "decided_at")
