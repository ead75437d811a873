"""Queries of code graphs with imports: lines of orders as files that import, call and define, parts as files that define."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph, state
from tessella.plans.registry import query
from tessella.sources import views
from tessella.sources.shared import stored

#: Files of parts define a symbol; files of orders call those of their lines and import modules, by six ways of writing it and one
#: that means nothing (a thing of no module).
_CODE = """parts AS (SELECT DISTINCT '/r/d' || (p_partkey // 50) % 5 AS dir, 'k' || p_partkey % 50 AS k, ['ts', 'py', 'rs'][p_partkey % 3 + 1] AS ext FROM part),
files AS (SELECT dir || '/' || k || '.' || ext AS path, 's' || k AS symbol FROM parts),
lines AS (SELECT '/r/d' || l_orderkey % 5 || '/c' || l_orderkey || '.x' AS from_path, '/r/d' || l_orderkey % 5 AS own, 'd' || l_suppkey % 5 AS d, 'k' || l_partkey % 50 AS k, l_linenumber % 7 AS form FROM lineitem),
meant AS (SELECT from_path, CASE form WHEN 1 THEN own || '/' || k || '.ts' WHEN 2 THEN '/r/' || d || '/' || k || '.ts' WHEN 3 THEN '/r/' || d || '/' || k || '.py' WHEN 4 THEN '/r/' || d || '/' || k || '.py'
  WHEN 5 THEN '/r/' || d || '/' || k || '.rs' WHEN 6 THEN own || '/' || k || '.rs' END AS target FROM lines),
imported AS (SELECT DISTINCT from_path, target FROM meant JOIN files ON target = path),
pairs AS (SELECT DISTINCT l.from_path AS caller, symbol, path AS target, own || '/' = regexp_extract(path, '^(.*/)', 1) AS beside FROM lines l JOIN files ON symbol = 's' || k),
tried AS (SELECT p.*, CASE WHEN i.target IS NOT NULL THEN 0 WHEN beside THEN 1 ELSE 2 END AS t FROM pairs p LEFT JOIN imported i ON i.from_path = caller AND i.target = p.target),
resolved AS (SELECT caller, symbol, target, ['import', 'same_dir', 'bare'][t + 1] AS tier FROM tried QUALIFY t = min(t) OVER (PARTITION BY caller, symbol))"""


def _written(spark, sf):
    """The edges as they are written, some of them repeated."""
    part = views.table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("k"), (F.col(c) % 50).cast("string"))
    ending = F.element_at(F.array(*map(F.lit, ("ts", "py", "rs"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    at = F.concat(F.lit("/r/d"), (F.floor(F.col("p_partkey") / 50) % 5).cast("string"), F.lit("/"), name("p_partkey"), F.lit("."), ending)
    defines = part.select(at.alias("from_path"), F.lit("defines").alias("kind"), F.concat(F.lit("s"), name("p_partkey")).alias("to_ref"))
    line = views.table(spark, sf, "lineitem")
    path = F.concat(F.lit("/r/d"), (F.col("l_orderkey") % 5).cast("string"), F.lit("/c"), F.col("l_orderkey").cast("string"), F.lit(".x"))
    d, k, form = F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string")), name("l_partkey"), F.col("l_linenumber") % 7
    ways = {1: F.concat(F.lit("./"), k), 2: F.concat(F.lit("../"), d, F.lit("/"), k), 3: F.concat(F.lit(".."), d, F.lit("."), k), 4: F.concat(d, F.lit("."), k), 5: F.concat(F.lit("crate::"), d, F.lit("::"), k), 6: F.concat(F.lit("super::"), k)}
    ref = F.lit("no-module")
    for n, way in ways.items():
        ref = F.when(form == n, way).otherwise(ref)
    imports = line.select(path.alias("from_path"), F.lit("imports").alias("kind"), ref.alias("to_ref"))
    calls = line.select(path.alias("from_path"), F.lit("calls").alias("kind"), F.concat(F.lit("s"), k).alias("to_ref"))
    return defines.unionByName(imports).unionByName(calls)


def _edges(spark, sf):
    # Read several times by what follows: once written, the tables are read once.
    return stored(_written(spark, sf).distinct())


def _files(edges):
    return edges.where("kind = 'defines'").select(F.col("from_path").alias("path")).distinct()


def _imports(edges):
    return graph.imported(edges, _files(edges))


@query("join09_imported", f"WITH {_CODE} SELECT * FROM imported")
def _(spark, sf):
    return _imports(_edges(spark, sf))


@query("grf03_by_imports", f"WITH {_CODE} SELECT * FROM resolved")
def _(spark, sf):
    edges = _edges(spark, sf)
    return graph.resolved(edges, _imports(edges))


@query("grf22_symbol_context", f"""WITH {_CODE}, callers AS (SELECT DISTINCT from_path AS path FROM lines WHERE k = 'k7' ORDER BY 1 LIMIT 25), n AS (SELECT '/n/' || n_nationkey AS item, n_name AS detail FROM nation WHERE n_nationkey % 3 = 0)
SELECT 'defined' AS section, path AS item, 'fn' AS detail, length(path) AS first, length(path) + 5 AS last FROM files WHERE symbol = 'sk7'
UNION ALL SELECT 'called', path, min(tier), NULL, NULL FROM callers JOIN resolved ON caller = path AND symbol = 'sk7' GROUP BY path
UNION ALL SELECT 'note', item, detail, NULL, NULL FROM n""")
def _(spark, sf):
    # One symbol takes few edges, so the tables are read through filters and nothing of them is grouped or written whole.
    edges = _written(spark, sf)
    at = edges.where("kind = 'defines'").select(F.col("from_path").alias("path"), F.col("to_ref").alias("name"), F.lit("fn").alias("kind"), F.length("from_path").alias("start_line"), (F.length("from_path") + 5).alias("end_line"))
    notes = views.table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("/n/"), F.col("n_nationkey").cast("string")).alias("note_path"), F.lit("sk7").alias("anchor"), F.col("n_name").alias("title"))
    return graph.symbol_context(edges, at, notes, "sk7", files=_files(edges))


@query("strf11_api_surface", """WITH d AS (SELECT DISTINCT '/o' || l_suppkey AS path, CASE WHEN l_linenumber = 7 THEN 'get_' ELSE 'p' END || l_partkey AS name FROM lineitem)
SELECT path, string_agg(name, ', ' ORDER BY name) AS surface FROM (SELECT * FROM d WHERE name NOT LIKE 'get%' QUALIFY row_number() OVER (PARTITION BY path ORDER BY name) <= 12) GROUP BY path""")
def _(spark, sf):
    name = F.concat(F.when(F.col("l_linenumber") == 7, "get_").otherwise("p"), F.col("l_partkey").cast("string"))
    return graph.api_surface(views.table(spark, sf, "lineitem").select(F.concat(F.lit("/o"), F.col("l_suppkey").cast("string")).alias("from_path"), F.lit("defines").alias("kind"), name.alias("to_ref")))


@query("grf12_modules_in", f"""WITH {views.FILES}, m AS (SELECT sha256(text) AS module_id, path AS member_path FROM files WHERE text IS NOT NULL), n AS (SELECT module_id, count(*) AS members, bool_or(starts_with(member_path, '/corpus/src1/')) AS hit FROM m GROUP BY 1)
SELECT m.*, members FROM m JOIN n USING (module_id) WHERE hit""")
def _(spark, sf):
    modules = views.files(spark, sf).where("text IS NOT NULL").select(F.sha2("text", 256).alias("module_id"), F.col("path").alias("member_path"))
    return graph.modules_in(modules, "/corpus/src1")


@query("ret31_suggested", """WITH b AS (SELECT '/f' || l_partkey AS path, min(l_orderkey) AS rank FROM lineitem GROUP BY 1) SELECT * FROM b WHERE path NOT IN (SELECT '/f' || p_partkey FROM part WHERE p_partkey % 4 = 0) ORDER BY rank, path LIMIT 20""")
def _(spark, sf):
    hits = views.table(spark, sf, "lineitem").select(F.concat(F.lit("/f"), F.col("l_partkey").cast("string")).alias("entry_path"), F.col("l_orderkey").alias("rank"))
    has = views.table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("/f"), F.col("p_partkey").cast("string")).alias("path"))
    return state.suggested_members(hits, has)
