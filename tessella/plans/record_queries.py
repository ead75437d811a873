"""Queries of the records that users keep, and of lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import records
from tessella.plans.registry import query
from tessella.sources import views
from tessella.sources.views import DIRECTORIES, FILES, NOW

#: Events as commands on packs, one pack a user, some of which are there before.
_PACKS = """cmd AS (SELECT event_id + 1 AS seq, 'p' || user_id AS pack_id, 'name' || event_id AS name, ['/e' || event_id % 5, '/e' || event_id % 11] AS paths,
  CASE WHEN event_id % 41 = 0 THEN 'delete' WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 7 = 1 THEN 'rename' WHEN event_id % 7 <= 4 THEN 'add' WHEN event_id % 7 = 5 THEN 'remove' ELSE 'export' END AS op, user_id % 3 = 0 AS known FROM events),
born AS (SELECT pack_id, CASE WHEN bool_or(known) THEN 0 ELSE min(seq) FILTER (op = 'create') END AS born FROM cmd GROUP BY pack_id),
living AS (SELECT cmd.*, born FROM cmd JOIN born USING (pack_id) WHERE seq >= born AND (op <> 'create' OR seq = born)),
dead AS (SELECT pack_id, min(seq) AS dead FROM living WHERE op = 'delete' GROUP BY pack_id),
alive AS (SELECT * FROM living WHERE pack_id NOT IN (SELECT pack_id FROM dead))"""


def _packs(spark, sf):
    e = views.table(spark, sf, "events")
    kind = F.col("event_id") % 7
    op = F.when(F.col("event_id") % 41 == 0, "delete").when(kind == 0, "create").when(kind == 1, "rename").when(kind <= 4, "add").when(kind == 5, "remove").otherwise("export")
    pack, at = F.concat(F.lit("p"), F.col("user_id").cast("string")), lambda n: F.concat(F.lit("/e"), (F.col("event_id") % n).cast("string"))
    commands = e.select((F.col("event_id") + 1).alias("seq"), op.alias("op"), pack.alias("pack_id"), F.concat(F.lit("name"), F.col("event_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("description"), F.array(at(5), at(11)).alias("paths"), F.lit("out").alias("detail"))
    packs = e.where("user_id % 3 = 0").select(pack.alias("id")).distinct().select("id", F.lit("first").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(1).cast("long").alias("created_at"))
    members = packs.select(F.col("id").alias("pack_id"), F.lit("/e0").alias("path"))
    events = packs.select(F.lit(0).cast("long").alias("id"), F.col("id").alias("pack_id"), F.lit("created").alias("event"), F.lit("first").alias("detail"), F.lit(1).cast("long").alias("at"))
    return records.packs_after(packs, members, events, commands, NOW)


@query("dml10_packs", f"""WITH {_PACKS}, n AS (SELECT pack_id, arg_max(name, seq) AS name FROM alive WHERE op IN ('create', 'rename') GROUP BY pack_id),
p AS (SELECT DISTINCT pack_id FROM alive WHERE born > 0 UNION SELECT DISTINCT pack_id FROM cmd WHERE known AND pack_id NOT IN (SELECT pack_id FROM dead))
SELECT pack_id AS id, coalesce(name, 'first') AS name FROM p LEFT JOIN n USING (pack_id)""")
def _(spark, sf):
    return _packs(spark, sf)[0].select("id", "name")


@query("dml10_members", f"""WITH {_PACKS}, m AS (SELECT pack_id, seq, op, unnest(paths) AS path FROM alive WHERE op IN ('add', 'remove') UNION ALL SELECT DISTINCT pack_id, 0, 'add', '/e0' FROM cmd WHERE known AND pack_id NOT IN (SELECT pack_id FROM dead))
SELECT pack_id, path FROM m GROUP BY ALL HAVING arg_max(op, seq) = 'add'""")
def _(spark, sf):
    return _packs(spark, sf)[1]


@query("dml10_events", f"""WITH {_PACKS} SELECT seq AS id, pack_id, CASE op WHEN 'create' THEN 'created' WHEN 'rename' THEN 'renamed' WHEN 'add' THEN 'path_added' WHEN 'remove' THEN 'path_removed' ELSE 'exported' END AS event,
CASE WHEN op IN ('create', 'rename') THEN name WHEN op IN ('add', 'remove') THEN array_to_string(paths, ', ') ELSE 'out' END AS detail FROM alive
UNION ALL SELECT DISTINCT 0, pack_id, 'created', 'first' FROM cmd WHERE known AND pack_id NOT IN (SELECT pack_id FROM dead)""")
def _(spark, sf):
    return _packs(spark, sf)[2].select("id", "pack_id", "event", "detail")


@query("dml10_stale_files", f"""WITH {FILES}, s AS (SELECT path FROM files WHERE NOT (doc_id % 9 <> 0 AND doc_id % 5 <> 0 AND modified_s <= {NOW - 250 * 86400}))
SELECT 'src2' AS pack_id, path FROM s WHERE starts_with(path, '/corpus/src2/') UNION ALL SELECT 'en', path FROM s WHERE regexp_matches(path, '^/corpus/[^/]*/en/')""")
def _(spark, sf):
    f = views.files(spark, sf)
    src = f.where("path LIKE '/corpus/%/en/%'").select(F.lit("en").alias("pack_id"), F.substring_index("path", "/", 4).alias("path")).distinct()
    members = src.unionByName(spark.createDataFrame([("src2", "/corpus/src2")], "pack_id string, path string"))
    chunks = f.select(F.col("path").alias("entry_path"), F.lit(NOW - 250 * 86400).alias("indexed_at"), F.when(F.col("doc_id") % 5 != 0, F.array(F.lit(1.0))).alias("embedding"))
    return records.stale_files(members, chunks, f.where("doc_id % 9 <> 0"))


@query("dml10_import_plan", f"""WITH {FILES}, r AS (SELECT path, CASE WHEN doc_id % 2 <> 0 THEN 'missing' WHEN NOT starts_with(path, '/corpus/src1/') AND NOT regexp_matches(path, '^/corpus/src2/en/') THEN 'outside'
WHEN doc_id % 6 = 0 THEN 'changed' ELSE 'valid' END AS verdict FROM files WHERE doc_id % 5 <> 0) SELECT path, verdict, verdict = 'valid' AS taken FROM r""")
def _(spark, sf):
    f = views.files(spark, sf).withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    items = f.select("path", F.when(F.col("doc_id") % 6 == 0, "other").otherwise(F.col("hash")).alias("hash"), (F.col("doc_id") % 5 != 0).alias("is_root"))
    roots = spark.createDataFrame([("/corpus/src1/",), ("/corpus/src2/en",)], "path string")
    return records.import_plan(items, f.where("doc_id % 2 = 0"), roots, f.select("path", F.col("hash").alias("source_hash"))).select("path", "verdict", "taken")


def _classes(f):
    null = F.lit(None).cast("long")
    return f.where("doc_id % 3 <> 0").select("path", F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), 4).alias("category"), F.lit(0.5).alias("confidence"), F.lit("auto").alias("source"), null.alias("confirmed_at"), F.lit(1).cast("long").alias("created_at"))


@query("dml08_confirmed", f"""WITH {FILES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'dir' ELSE 'file' END AS kind, CASE WHEN doc_id % 4 = 0 THEN 'work' ELSE split_part(path, '/', 4) END AS category, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0.5 END AS DOUBLE) AS confidence,
CASE WHEN doc_id % 4 = 0 THEN 'user' ELSE 'auto' END AS source, CASE WHEN doc_id % 4 = 0 THEN {NOW} END AS confirmed_at, CASE WHEN doc_id % 3 = 0 THEN {NOW} ELSE 1 END AS created_at FROM files WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0""")
def _(spark, sf):
    f = views.files(spark, sf)
    said = f.where("doc_id % 4 = 0").select("path", F.explode(F.array(F.struct(F.lit("media").alias("category"), F.lit(1).alias("seq")), F.struct(F.lit("work").alias("category"), F.lit(2).alias("seq")))).alias("s")).select("path", "s.category", "s.seq")
    return records.confirmed(_classes(f), said, NOW)


@query("dml08_ignored", f"""WITH {FILES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN '' ELSE split_part(path, '/', 4) END AS category, CASE WHEN doc_id % 4 = 0 THEN 'ignored' ELSE 'auto' END AS source, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN {NOW} END AS confirmed_at
FROM files WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0""")
def _(spark, sf):
    f = views.files(spark, sf)
    return records.ignored(_classes(f), f.where("doc_id % 4 = 0").select("path"), NOW).select("path", "category", "source", "confirmed_at")


@query("dml09_weights_set", """SELECT 'file' AS target_kind, CAST(o_custkey AS VARCHAR) AS target, arg_max(o_totalprice, o_orderkey) AS weight FROM orders GROUP BY o_custkey
UNION ALL SELECT 'dir', CAST(c_custkey AS VARCHAR), 1.0 FROM customer UNION ALL SELECT 'file', CAST(c_custkey AS VARCHAR), 1.0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(spark, sf):
    none = F.lit(None).cast("string")
    base = views.table(spark, sf, "customer").select(F.explode(F.array(F.lit("file"), F.lit("dir"))).alias("target_kind"), F.col("c_custkey").cast("string").alias("target"), F.lit(1.0).alias("weight"), none.alias("source"), none.alias("reason"), F.lit(1).cast("long").alias("updated_at"))
    given = views.table(spark, sf, "orders").select(F.lit("file").alias("target_kind"), F.col("o_custkey").cast("string").alias("target"), F.col("o_totalprice").cast("double").alias("weight"), F.lit("user").alias("source"), none.alias("reason"), F.col("o_orderkey").alias("seq"))
    return records.weights_set(base, given, NOW).select("target_kind", "target", "weight")


@query("dml09_recent_weights", f"""WITH {FILES}, r AS (SELECT path, floor(greatest({NOW - 300 * 86400} - modified_s, 0) / 86400) AS age FROM files WHERE modified_s > {NOW - 390 * 86400} ORDER BY modified_s DESC, path LIMIT 200)
SELECT path, CAST(CASE WHEN age <= 7 THEN 2 WHEN age <= 30 THEN 1.5 WHEN age <= 90 THEN 1.2 ELSE 1 END AS DOUBLE) AS weight FROM r""")
def _(spark, sf):
    return records.recent_weights(views.files(spark, sf), NOW - 300 * 86400, 90)


@query("dml11_saved", """SELECT 'u' || user_id AS name, arg_max(event_type, event_id) AS question, count(*) FILTER (event_id % 2 = 1) > 0 AS renewed FROM events GROUP BY user_id""")
def _(spark, sf):
    e = views.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("question"), F.lit("rag").alias("mode"), F.lit(None).cast("string").alias("scope"), F.col("event_id").alias("seq"))
    base = records.saved(e.drop("seq").withColumn("created_at", F.lit(0).cast("long")).limit(0), e.where("seq % 2 = 0"), 1)
    latest = records.saved(base, e, 2)
    odd = e.where("seq % 2 = 1").select("name").distinct().withColumn("odd", F.lit(True))
    return latest.join(odd, "name", "left").select("name", "question", F.coalesce("odd", F.lit(False)).alias("renewed"))


@query("dml11_sessions", f"""SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE {NOW} END AS created_at, CASE WHEN conv_id % 2 = 1 OR max(turn) >= 2 THEN {NOW} ELSE 1 END AS updated_at FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    c = views.table(spark, sf, "conversations")
    base = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("scope"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    asked = c.select(F.col("conv_id").alias("id"), F.lit(None).cast("string").alias("scope"), F.col("turn").alias("seq"))
    return records.sessions_after(base, asked, c.where("turn >= 2").select(F.col("conv_id").alias("session_id")), NOW).select("id", "created_at", "updated_at")


@query("dml11_notes", """SELECT 'n' || p_partkey AS note_path, p_brand AS anchor FROM part WHERE p_size <= 10 UNION ALL SELECT 'n' || p_partkey, p_type FROM part WHERE p_size > 40""")
def _(spark, sf):
    p = views.table(spark, sf, "part")
    note = lambda c, k: p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("note_path"), F.col(c).alias("anchor"), F.lit(k).alias("anchor_kind"), F.col("p_name").alias("title"), F.lit("").alias("pack"), F.lit(1).alias("seq"), "p_size")
    after = records.notes_after(note("p_brand", "symbol").where("p_size <= 10 OR p_size > 40").drop("seq", "p_size"), note("p_type", "path").where("p_size > 40").drop("p_size"))
    return records.notes_of(after, after.select("anchor")).select("note_path", "anchor")


@query("dml17_mode", f"WITH {FILES} SELECT path AS entry_path FROM files WHERE NOT starts_with(path, '/corpus/src3/')")
def _(spark, sf):
    return records.chunks_for_mode(views.files(spark, sf).select(F.col("path").alias("entry_path")), "/corpus/src3", "summaries-only")


@query("msc01_lookup", """WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders UNION SELECT -o_custkey FROM orders) SELECT key, c_name IS NOT NULL AS found, c_name AS name FROM k LEFT JOIN customer ON c_custkey = key""")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    keys = o.select(F.explode(F.array("o_custkey", -F.col("o_custkey"))).alias("key"))
    return records.lookup(views.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), keys)


@query("msc03_children", f"WITH {FILES} SELECT parent_path, path FROM files WHERE parent_path IN (SELECT parent_path FROM files WHERE doc_id % 50 = 0)")
def _(spark, sf):
    f = views.files(spark, sf)
    return records.children(f, f.where("doc_id % 50 = 0").select(F.col("parent_path").alias("path"))).select("parent_path", "path")


@query("msc06_first_texts", "SELECT conv_id AS entry_path, arg_min(text, turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def _(spark, sf):
    c = views.table(spark, sf, "conversations").where("text IS NOT NULL")
    return records.first_texts(c.select(F.col("conv_id").alias("entry_path"), F.col("turn").alias("seq"), "text"))


@query("msc06_code_chunks", f"WITH {FILES} SELECT path AS entry_path, hint_cat AS language FROM files WHERE starts_with(path, '/corpus/src1/') AND hint_cat IS NOT NULL")
def _(spark, sf):
    f = views.files(spark, sf)
    return records.code_chunks(f.select(F.col("path").alias("entry_path"), F.lit(0).alias("seq"), F.col("hint_cat").alias("language")), "/corpus/src1").select("entry_path", "language")


@query("msc09_dimension", "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS n, (SELECT len(arg_min(embedding, vec_id)) FROM embeddings WHERE embedding IS NOT NULL) = len(embedding) AS fits FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, sf):
    v = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return records.vectors_of(v).select("id", F.size("embedding").cast("long").alias("n"), (F.size("embedding") == records.first_dimension(v)).alias("fits"))


@query("msc10_restored", f"""WITH {FILES} SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'Back to it. Again.' ELSE substr(text, 1, 200) END AS summary, CASE WHEN doc_id % 7 = 0 THEN 'Back to it.' ELSE 'short' END AS summary_l0, doc_id % 7 <> 0 AS has_vector FROM files""")
def _(spark, sf):
    f = views.files(spark, sf)
    base = f.select("path", F.substring("text", 1, 200).alias("summary"), F.lit("short").alias("summary_l0"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("m").alias("model"))
    given = f.where("doc_id % 7 = 0").select("path", F.lit("Back to it. Again.").alias("summary"), F.lit(None).cast("string").alias("summary_l0"), F.lit(None).cast("string").alias("model"), F.lit(1).alias("seq"))
    return records.summaries_restored(base, given).select("path", "summary", "summary_l0", F.col("embedding").isNotNull().alias("has_vector"))


@query("msc11_queue_marked", f"""WITH {FILES}, {DIRECTORIES} SELECT path, CASE WHEN length(path) % 2 = 0 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN length(path) % 2 = 0 THEN 'late' END AS error FROM directories""")
def _(spark, sf):
    d = views.directories(views.files(spark, sf))
    queue = d.select("path", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("updated_at"))
    given = d.where("length(path) % 2 = 0").select("path", F.explode(F.array(F.struct(F.lit("done").alias("state"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("seq")), F.struct(F.lit("failed").alias("state"), F.lit("late").alias("error"), F.lit(2).alias("seq")))).alias("s")).select("path", "s.*")
    return records.queue_marked(queue, given, NOW).select("path", "state", "error")


@query("join13_ranked", "SELECT o_orderkey AS id, c_name, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def _(spark, sf):
    top = views.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"))
    table = views.table(spark, sf, "orders").join(views.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "c_name")
    return records.ranked(top, table)
