"""Queries of the tree, state and window operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import insights, state, tree
from tessella.plans.registry import query
from tessella.sources import store, views
from tessella.sources.views import DIRECTORIES, FILES, NOW
from tessella.streaming import changes


@query("agg09_tree_level", f"""WITH {FILES}, {DIRECTORIES},
q AS (SELECT path, CASE WHEN length(path) % 3 = 0 THEN 'done' WHEN length(path) % 3 = 1 THEN 'pending' END AS state FROM directories),
kids AS (SELECT path FROM directories WHERE parent_path = '/corpus'),
c AS (SELECT path, lang_n FROM (SELECT '/corpus/' || source AS path, count(*) AS lang_n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1))
SELECT k.path, 'dir' AS kind, (SELECT count(*) FROM files f WHERE f.parent_path = k.path) AS file_count, coalesce(c.lang_n, 0) AS chunk_count,
(SELECT count(CASE WHEN state = 'done' THEN 1 END) FROM q WHERE q.path = k.path OR starts_with(q.path, k.path || '/')) AS covered_dirs,
(SELECT count(CASE WHEN state = 'pending' THEN 1 END) FROM q WHERE q.path = k.path OR starts_with(q.path, k.path || '/')) AS partial_dirs,
(SELECT count(*) FROM q WHERE q.path = k.path OR starts_with(q.path, k.path || '/')) AS total_dirs FROM kids k LEFT JOIN c ON c.path = k.path""")
def _(spark, sf):
    f = views.files(spark, sf)
    d = views.directories(f)
    entries = f.select("path", "parent_path", "kind").unionByName(d)
    q = d.select("path", F.when(F.length("path") % 3 == 0, "done").when(F.length("path") % 3 == 1, "pending").alias("state"))
    return tree.tree_level(entries, f.where("doc_id % 2 = 0").select(F.col("path").alias("entry_path")), q, "/corpus")


@query("agg10_path_coverage", f"WITH {FILES} SELECT count(*) AS files, count(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS chunked FROM files WHERE starts_with(path, '/corpus/src2/')")
def _(spark, sf):
    f = views.files(spark, sf)
    return tree.coverage(f, f.where("doc_id % 3 = 0").select(F.col("path").alias("entry_path")), "/corpus/src2")


@query("agg11_treemap", """WITH p AS (SELECT unnest(['/corpus', '/corpus/' || source, '/corpus/' || source || '/' || lang]) AS path, n_chars FROM documents),
s AS (SELECT path, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS n FROM p GROUP BY path),
r AS (SELECT *, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/') AS parent_path FROM s)
SELECT path, parent_path, bytes, n FROM r QUALIFY row_number() OVER (PARTITION BY parent_path ORDER BY bytes DESC, path) <= 30""")
def _(spark, sf):
    return tree.treemap(views.files(spark, sf)).select("path", "parent_path", "bytes", "n")


@query("agg19_rollup", """WITH p AS (SELECT unnest(['/corpus', '/corpus/' || source, '/corpus/' || source || '/' || lang]) AS path, n_chars FROM documents) SELECT path, CAST(sum(n_chars) AS BIGINT) AS byte_size FROM p GROUP BY path""")
def _(spark, sf):
    s = views.summaries(spark, sf)
    return tree.summarised(s).where("kind = 'dir'").select("path", "byte_size")


@query("agg18_top_projects", """WITH d AS (SELECT DISTINCT unnest(['/r/' || p_brand, '/r/' || p_brand || '/' || p_size, '/r/' || p_brand || '/' || p_size || '/sub']) AS path FROM part),
a AS (SELECT path FROM d WHERE length(path) % 2 = 0) SELECT path FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE starts_with(a.path, b.path || '/'))""")
def _(spark, sf):
    base = F.concat(F.lit("/r/"), "p_brand")
    sized = F.concat(base, F.lit("/"), F.col("p_size").cast("string"))
    d = views.table(spark, sf, "part").select(F.explode(F.array(base, sized, F.concat(sized, F.lit("/sub")))).alias("path")).distinct()
    return tree.top_level(d.where(F.length("path") % 2 == 0).withColumn("is_primary", F.lit(True))).select("path")


@query("agg17_fingerprints", """WITH k AS (SELECT DISTINCT o_custkey AS path, o_orderpriority AS name FROM orders),
h AS (SELECT path, list(name) AS names FROM k GROUP BY path),
m AS (SELECT path, 'both' AS app, 2 AS specificity FROM h WHERE list_contains(names, '1-URGENT') AND list_contains(names, '2-HIGH')
UNION ALL SELECT path, 'any', 1 FROM h WHERE list_has_any(names, ['3-MEDIUM', '4-NOT SPECIFIED']) AND NOT list_contains(names, '5-LOW'))
SELECT path, app, CAST(specificity AS BIGINT) AS specificity, row_number() OVER (PARTITION BY path ORDER BY specificity DESC, app) = 1 AS is_primary FROM m""")
def _(spark, sf):
    kids = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("name"))
    defs = [("both", 2, ["1-URGENT", "2-HIGH"], [], []), ("any", 1, [], ["3-MEDIUM", "4-NOT SPECIFIED"], ["5-LOW"]), ("never", 9, [], [], ["5-LOW"])]
    return tree.fingerprints(kids, spark.createDataFrame(defs, "app string, specificity long, all_of array<string>, any_of array<string>, none_of array<string>"))


@query("dml01_replace", """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    base = o.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return state.replaced(base, o.where("o_custkey % 7 = 0").select("o_orderkey", F.lit("X").alias("status")), ["o_orderkey"])


@query("dml02_conditional_upsert", """SELECT o_custkey AS path, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'user' ELSE 'auto' END AS source, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'old' ELSE 'new' END AS category FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    o = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderkey").alias("k"))
    base = o.select("path", F.when(F.col("k") % 3 == 0, "user").otherwise("auto").alias("source"), F.lit("old").alias("category"))
    return state.upsert_classifications(base, o.select("path", F.lit("auto").alias("source"), F.lit("new").alias("category")))


@query("dml03_ghosts", f"WITH {FILES} SELECT path FROM files WHERE starts_with(path, '/corpus/src2/') AND doc_id % 2 = 0")
def _(spark, sf):
    f = views.files(spark, sf).withColumn("scan_generation", 1 + F.col("doc_id") % 2)
    return state.ghosts(f, "/corpus/src2", 2).select("path")


@query("dml04_delete_subtree", f"WITH {FILES} SELECT path FROM files WHERE NOT starts_with(path, '/corpus/src1/')")
def _(spark, sf):
    return state.without_subtree(views.files(spark, sf), "/corpus/src1").select("path")


@query("dml05_orphans", "SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def _(spark, sf):
    t = views.table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return state.orphans(t, views.table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("path"))).select(F.col("path").alias("doc_id"))


@query("dml06_cache_misses", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def _(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("array<float>").alias("embedding"))
    cache = d.where("doc_id % 3 = 0").select("content_hash", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return state.embedding_misses(d, cache)[1].select("doc_id")


@query("dml16_dirty", f"""WITH {FILES}, s AS (SELECT path FROM files WHERE starts_with(path, '/corpus/src4/') AND (doc_id % 4 = 0 OR modified_s >= {NOW - 330 * 86400}))
SELECT path, CAST(length(path) - length(replace(path, '/', '')) AS BIGINT) AS depth FROM (SELECT path FROM s UNION SELECT regexp_extract(path, '^(.*)/', 1) FROM s UNION SELECT '/corpus/src4' FROM s)""")
def _(spark, sf):
    f = views.files(spark, sf)
    done = f.where("doc_id % 4 <> 0").select("path", F.lit(NOW - 330 * 86400).alias("generated_at"))
    return state.dirty(f, done, "/corpus/src4")


@query("dml18_current_files", "SELECT o_custkey AS entry_path FROM orders WHERE o_orderkey >= o_custkey GROUP BY 1 HAVING bool_and(o_orderstatus <> 'F')")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    chunks = o.select(F.col("o_custkey").alias("entry_path"), F.col("o_orderkey").alias("indexed_at"), F.when(F.col("o_orderstatus") != "F", F.lit(1)).alias("embedding"))
    return state.current_files(chunks, o.select(F.col("o_custkey").alias("path"), F.col("o_custkey").alias("modified_s")).distinct())


@query("agg08_queue_stats", """SELECT o_orderstatus AS state, count(*) AS n, CAST(sum(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS live FROM orders GROUP BY 1""")
def _(spark, sf):
    q = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("state"))
    return state.queue_stats(q, q.where("path % 2 = 0").select("path"))


@query("srt04_next_level", "WITH q AS (SELECT p_partkey AS path, p_size AS depth, CASE WHEN p_partkey % 2 = 0 THEN 'pending' ELSE 'done' END AS state FROM part) SELECT path, depth FROM q WHERE state = 'pending' AND depth = (SELECT max(depth) FROM q WHERE state = 'pending')")
def _(spark, sf):
    q = views.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("depth"), F.when(F.col("p_partkey") % 2 == 0, "pending").otherwise("done").alias("state"))
    return state.next_level(q).select("path", "depth")


@query("win03_recent_turns", "SELECT conv_id AS session_id, turn AS turn_index, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def _(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "text")
    return state.recent_turns(c, 2)


@query("dml11_append_turns", "SELECT conv_id AS session_id, turn AS turn_index FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, max(turn) + 1 FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, max(turn) + 2 FROM conversations GROUP BY conv_id)")
def _(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"))
    new = c.select("session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).distinct()
    return state.appended_turns(c, new).select("session_id", "turn_index")


@query("join02_packs", """SELECT lang AS pack_id, count(*) AS n_paths FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang""")
def _(spark, sf):
    d = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id")
    packs = d.select(F.col("lang").alias("id")).distinct()
    members = d.where("quality = 1").select(F.col("lang").alias("pack_id"), F.col("doc_id").alias("path"))
    events = packs.select(F.col("id").alias("pack_id"), F.lit("created").alias("event"), F.lit(1).alias("at"), F.lit(1).alias("id"))
    return state.packs_listed(packs, members, events).select("pack_id", "n_paths")


@query("ret31_pack_scope", f"WITH {FILES} SELECT path FROM files WHERE starts_with(path, '/corpus/src1/en/') OR starts_with(path, '/corpus/src2/')")
def _(spark, sf):
    members = spark.createDataFrame([("p", "/corpus/src1/en"), ("p", "/corpus/src2")], "pack_id string, path string")
    return state.in_pack(views.files(spark, sf).select("path"), members, "path")


_LEDGER = """ledger AS (SELECT event_id AS id, event_type AS decision_type, CAST(user_id AS VARCHAR) AS subject, CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'decided' WHEN 2 THEN 'dismissed' ELSE 'expired' END AS status,
CAST(event_id % 5 AS VARCHAR) AS evidence_hash, event_id % 10 AS priority, event_id * 7 % 1000 AS created_at FROM events)"""


def _ledger(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ("open", "decided", "dismissed", "expired"))), (F.col("event_id") % 4 + 1).cast("int"))
    return views.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("decision_type"), F.col("user_id").cast("string").alias("subject"), status.alias("status"), (F.col("event_id") % 5).cast("string").alias("evidence_hash"),
        (F.col("event_id") % 10).alias("priority"), (F.col("event_id") * 7 % 1000).alias("created_at"), F.lit(None).cast("long").alias("superseded_by"), F.lit(None).cast("long").alias("effects_applied_at"),
        F.lit(None).cast("string").alias("chosen"), F.lit(None).cast("long").alias("decided_at"),
    )


@query("srt03_inbox", f"WITH {_LEDGER} SELECT id, priority, created_at FROM ledger WHERE status = 'open' ORDER BY priority DESC, created_at DESC, id DESC LIMIT 20 OFFSET 40")
def _(spark, sf):
    return state.inbox(_ledger(spark, sf), 20, 40).select("id", "priority", "created_at")


@query("dml12_current_decisions", f"WITH {_LEDGER} SELECT decision_type, subject, max(id) AS id FROM ledger WHERE status = 'decided' GROUP BY ALL")
def _(spark, sf):
    return state.current_decisions(_ledger(spark, sf)).select("decision_type", "subject", "id")


@query("dml12_recorded", f"""WITH {_LEDGER}, f AS (SELECT DISTINCT decision_type, subject FROM ledger), g AS (SELECT decision_type, subject, '3' AS evidence_hash FROM f)
SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.decision_type = g.decision_type AND l.subject = g.subject AND (l.status = 'open' OR l.status = 'dismissed' AND l.evidence_hash = '3'))""")
def _(spark, sf):
    ledger = _ledger(spark, sf)
    return state.recorded(ledger, ledger.select("decision_type", "subject").distinct().withColumn("evidence_hash", F.lit("3")))


@query("dml12_answered", f"WITH {_LEDGER} SELECT id, CASE WHEN status = 'open' AND id % 8 = 0 THEN 'decided' ELSE status END AS status, CASE WHEN status = 'open' AND id % 8 = 0 THEN 'docs' END AS chosen FROM ledger")
def _(spark, sf):
    ledger = _ledger(spark, sf)
    return state.answered(ledger, ledger.where("id % 8 = 0").select("id", F.lit("docs").alias("chosen")), NOW).select("id", "status", "chosen")


@query("dml14_archive_findings", f"""WITH {FILES}, {DIRECTORIES}, m AS (SELECT parent_path AS path, max(modified_s) - 20000000 AS modified_s FROM files GROUP BY 1)
SELECT 'archive' AS decision_type, path AS subject, sha256(path || chr(0) || CAST(floor(floor(({NOW} - modified_s) / 86400) / 90) AS BIGINT)) AS evidence_hash FROM m WHERE floor(({NOW} - modified_s) / 86400) >= 365""")
def _(spark, sf):
    d = views.files(spark, sf).groupBy(F.col("parent_path").alias("path")).agg((F.max("modified_s") - 20000000).alias("modified_s"))
    return state.archive_findings(d.withColumn("kind", F.lit("dir")), NOW)


@query("dml09_suggested_weights", f"""WITH {FILES}, r AS (SELECT path, CASE WHEN ({NOW - 330 * 86400} - modified_s) / 86400.0 <= 7 THEN 2.0 WHEN ({NOW - 330 * 86400} - modified_s) / 86400.0 <= 30 THEN 1.5 END AS weight, modified_s FROM files)
SELECT path, CAST(weight AS DOUBLE) AS weight, modified_s FROM r WHERE weight IS NOT NULL ORDER BY modified_s DESC, path LIMIT 200""")
def _(spark, sf):
    none = spark.createDataFrame([], "target_kind string, target string")
    return state.suggested_weights(views.files(spark, sf), none, NOW - 330 * 86400)


@query("str05_usage_windows", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def _(spark, sf):
    e = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = changes.usage_windows(e, "1 day", None)
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


@query("str06_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf):
    e = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.sessions(e, "6 hours").select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("str01_coalesced", "SELECT user_id AS path, event_id AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("at"), F.lit("upsert").alias("change"))
    return changes.coalesced(e).select("path", "at")


@query("set02_intersection", f"WITH {FILES} SELECT path FROM files WHERE modified_s >= {NOW - 330 * 86400} INTERSECT SELECT path FROM files WHERE hint_cat = 'fr'")
def _(spark, sf):
    f = views.files(spark, sf)
    return f.where(F.col("modified_s") >= NOW - 330 * 86400).select("path").intersect(f.where("hint_cat = 'fr'").select("path"))


@query("flt14_pruned_tree", f"""WITH {FILES}, m AS (SELECT path FROM files WHERE hint_cat = 'de' AND size > 5000)
SELECT path FROM m UNION SELECT regexp_extract(path, '^(.*)/', 1) FROM m UNION SELECT regexp_extract(path, '^(/[^/]*/[^/]*)', 1) FROM m UNION SELECT '/corpus' FROM m""")
def _(spark, sf):
    m = views.files(spark, sf).where("hint_cat = 'de' AND size > 5000").select("path")
    return m.union(m.select(F.explode(paths.ancestors("path")))).distinct()


@query("agg12_kept_usage", f"WITH {views.USAGE} SELECT id FROM usage WHERE usage.\"at\" >= (SELECT max(u.\"at\") FROM usage u) - 7776000")
def _(spark, sf):
    u = views.usage(spark, sf)
    return insights.kept_usage(u, u.agg(F.max("at")).first()[0]).select("id")


#: What is removed: a directory, and single files.
_GONE = """gone AS (SELECT '/corpus/src1' AS p UNION ALL SELECT path FROM files WHERE doc_id % 41 = 0),
pairs AS (SELECT path AS path_a, lead(path) OVER (ORDER BY doc_id) AS path_b FROM files),
rows AS (SELECT 'entries' AS tbl, path AS a, NULL AS b FROM files UNION ALL SELECT 'entries', path, NULL FROM directories UNION ALL SELECT 'summaries', path, NULL FROM files WHERE doc_id % 2 = 0
  UNION ALL SELECT 'chunks', path, NULL FROM files UNION ALL SELECT 'chunks', path, NULL FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT 'co_change', path_a, path_b FROM pairs WHERE path_b IS NOT NULL)"""


@query("dml04_cascade", f"""WITH {FILES}, {DIRECTORIES}, {_GONE}, flagged AS (SELECT tbl, EXISTS (SELECT 1 FROM gone WHERE a = p OR starts_with(a, p || '/') OR b = p OR starts_with(b, p || '/')) AS hit FROM rows)
SELECT tbl, count(*) FILTER (WHERE hit) AS n_gone, count(*) FILTER (WHERE NOT hit) AS n_left FROM flagged GROUP BY tbl""")
def _(spark, sf):
    f = views.files(spark, sf)
    gone = f.where("doc_id % 41 = 0").select("path").unionByName(spark.createDataFrame([("/corpus/src1",)], "path string"))
    nexts = f.select(F.col("path").alias("path_b"), (F.col("doc_id") - 1).alias("doc_id"))
    tables = {
        "entries": f.select("path").unionByName(views.directories(f).select("path")), "summaries": f.where("doc_id % 2 = 0").select("path"),
        "chunks": f.select(F.col("path").alias("entry_path"), F.lit(0).alias("seq")).unionByName(f.where("doc_id % 3 = 0").select(F.col("path").alias("entry_path"), F.lit(1).alias("seq"))),
        "co_change": f.select(F.col("path").alias("path_a"), "doc_id").join(nexts, "doc_id").select("path_a", "path_b"),
    }
    plan = store.cascade(gone)
    sizes = [rows.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), F.lit(0).cast("long").alias("n_gone"), "n").unionByName(plan[t](rows)[0].agg(F.count("*").alias("n_gone")).select(F.lit(t).alias("tbl"), "n_gone", (-F.col("n_gone")).alias("n"))) for t, rows in tables.items()]
    return reduce(DataFrame.unionByName, sizes).groupBy("tbl").agg(F.sum("n_gone").alias("n_gone"), F.sum("n").alias("n_left"))
