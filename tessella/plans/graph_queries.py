"""Queries of the graph operators: orders as calls and definitions of parts, pages as links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph, insights
from tessella.plans.registry import query
from tessella.sources import views
from tessella.sources.shared import cut, parts, stored
from tessella.sources.views import CALLS, LINKS

_RESOLVED = f"""{CALLS},
defs AS (SELECT DISTINCT to_ref AS symbol, from_path AS target FROM edges WHERE kind = 'defines'),
few AS (SELECT symbol FROM defs GROUP BY symbol HAVING count(*) <= 25),
pairs AS (SELECT DISTINCT c.from_path AS caller, c.to_ref AS symbol, d.target, regexp_extract(c.from_path, '^(.*)/', 1) = regexp_extract(d.target, '^(.*)/', 1) AS same
  FROM edges c JOIN defs d ON c.to_ref = d.symbol JOIN few ON few.symbol = d.symbol WHERE c.kind = 'calls'),
best AS (SELECT caller, symbol, bool_or(same) AS any_same FROM pairs GROUP BY ALL),
resolved AS (SELECT caller, symbol, target, CASE WHEN same THEN 'same_dir' ELSE 'bare' END AS tier FROM pairs JOIN best USING (caller, symbol) WHERE same OR NOT any_same)"""
_GRAPH = f"""{_RESOLVED},
graph AS (SELECT caller AS source, target, count(DISTINCT symbol) AS weight, CASE WHEN bool_or(tier = 'same_dir') THEN 'same_dir' ELSE 'bare' END AS tier FROM resolved GROUP BY ALL)"""


def _resolved(spark, sf):
    # The edges are read three times: once they are written, their joins run once.
    return graph.resolved(stored(views.calls(spark, sf)))


def _graph(spark, sf, most=None):
    edges = stored(views.calls(spark, sf))
    return graph.code_graph(graph.resolved(edges), most, parts=parts(edges.count()))


@query("grf01_outgoing", f"WITH {LINKS} SELECT DISTINCT kind, to_ref FROM edges WHERE from_path = (SELECT min(url) FROM pages)")
def _(spark, sf):
    first = views.table(spark, sf, "pages").agg(F.min("url")).first()[0]
    return graph.outgoing(views.links(spark, sf), first)


@query("grf01_incoming", f"WITH {LINKS} SELECT DISTINCT from_path FROM edges WHERE kind = 'imports' AND to_ref = (SELECT min(to_ref) FROM edges)")
def _(spark, sf):
    e = views.links(spark, sf)
    return graph.incoming(e, "imports", e.agg(F.min("to_ref")).first()[0])


@query("grf03_resolved", f"WITH {_RESOLVED} SELECT * FROM resolved")
def _(spark, sf):
    return _resolved(spark, sf)


@query("grf06_definers", f"WITH {CALLS} SELECT to_ref, count(DISTINCT from_path) AS definers FROM edges WHERE kind = 'defines' GROUP BY 1")
def _(spark, sf):
    return graph.definer_counts(views.calls(spark, sf))


@query("grf06_ambiguous", f"""WITH {CALLS} SELECT to_ref, count(DISTINCT CASE WHEN kind = 'defines' THEN from_path END) AS definers, count(DISTINCT CASE WHEN kind = 'calls' THEN from_path END) AS callers
FROM edges GROUP BY 1 HAVING count(DISTINCT CASE WHEN kind = 'defines' THEN from_path END) > 1 AND count(DISTINCT CASE WHEN kind = 'calls' THEN from_path END) > 0""")
def _(spark, sf):
    return graph.ambiguous(views.calls(spark, sf))


@query("grf07_related", f"""WITH {_RESOLVED}, x AS (SELECT min(caller) AS p FROM resolved),
r AS (SELECT target AS path, symbol, tier FROM resolved, x WHERE caller = p UNION ALL SELECT caller, symbol, tier FROM resolved, x WHERE target = p)
SELECT path, count(DISTINCT symbol) AS symbols, CASE WHEN bool_or(tier = 'same_dir') THEN 'same_dir' ELSE 'bare' END AS tier FROM r GROUP BY path ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, sf):
    calls = stored(_resolved(spark, sf))
    return graph.related(calls, calls.agg(F.min("caller")).first()[0])


@query("grf08_code_graph", f"WITH {_GRAPH} SELECT * FROM graph ORDER BY weight DESC, source, target LIMIT 400")
def _(spark, sf):
    return _graph(spark, sf, 400)


@query("grf08_degrees", f"WITH {_GRAPH} SELECT path, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source AS path, 1 AS o, 0 AS i FROM graph UNION ALL SELECT target, 0, 1 FROM graph) GROUP BY path")
def _(spark, sf):
    return graph.degrees(_graph(spark, sf))


_ROUND = """r{k} AS (SELECT n.path, 0.15 / t.n + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{j} WHERE path NOT IN (SELECT source FROM w)) / t.n + 0.85 * coalesce(g.got, 0) AS r
FROM nodes n CROSS JOIN t LEFT JOIN (SELECT w.target, sum(r.r * w.share) AS got FROM w JOIN r{j} r ON r.path = w.source GROUP BY 1) g ON g.target = n.path)"""


@query("grf09_pagerank", f"""WITH {LINKS}, w AS (SELECT from_path AS source, to_ref AS target, 1.0 / count(*) OVER (PARTITION BY from_path) AS share FROM edges),
nodes AS (SELECT source AS path FROM w UNION SELECT target FROM w), t AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT path, 1.0 / n AS r FROM nodes, t), {", ".join(_ROUND.format(k=k, j=k - 1) for k in (1, 2, 3))}
SELECT path, round(r, 9) AS rank FROM r3""")
def _(spark, sf):
    g = views.links(spark, sf).select(F.col("from_path").alias("source"), F.col("to_ref").alias("target"), F.lit(1.0).alias("weight"))
    return graph.pagerank(g, rounds=3).withColumn("rank", F.round("rank", 9))


@query("grf13_blast_radius", f"""WITH {_RESOLVED}, h1 AS (SELECT DISTINCT from_path AS path FROM edges WHERE kind = 'calls' AND to_ref = 'part1') SELECT path, 1 AS hop FROM h1 WHERE path NOT IN (SELECT target FROM defs WHERE symbol = 'part1')""")
def _(spark, sf):
    # Every hop reads the calls: once they are written, they are resolved once.
    e = stored(views.calls(spark, sf))
    return graph.blast_radius(e, stored(graph.resolved(e)), "part1", 2)


@query("grf16_closure", f"""WITH {_RESOLVED}, x AS (SELECT min(caller) AS p FROM resolved) SELECT DISTINCT target AS path, 1 AS hop FROM resolved, x WHERE caller = p""")
def _(spark, sf):
    calls = stored(_resolved(spark, sf))
    start = calls.agg(F.min("caller").alias("path"))
    return graph.reach(calls.select(F.col("caller").alias("source"), "target"), start, 3)


@query("grf17_cycles")
def _(spark, sf):
    pairs = insights.co_change(views.commits(spark, sf)).where("n >= 3")
    both = pairs.select(F.col("path_a").alias("source"), F.col("path_b").alias("target")).unionByName(pairs.where("n >= 4").select(F.col("path_b").alias("source"), F.col("path_a").alias("target")))
    return graph.cycles(cut(both))


@query("grf11_modules")
def _(spark, sf):
    return graph.modules(_graph(spark, sf))


@query("grf19_category_star", """WITH m AS (SELECT lang AS grp, '/corpus/' || source || '/doc' || doc_id AS path FROM documents), f AS (SELECT grp, min(path) AS source FROM m GROUP BY grp)
SELECT DISTINCT source, path AS target FROM m JOIN f USING (grp) WHERE path <> source""")
def _(spark, sf):
    d = views.table(spark, sf, "documents").select(F.col("lang").alias("grp"), F.concat(F.lit("/corpus/"), "source", F.lit("/doc"), F.col("doc_id").cast("string")).alias("path"))
    return graph.star_edges(d)


@query("grf15_symbols_overlapping", """WITH s AS (SELECT '/o' || l_orderkey AS path, 'n' || l_linenumber AS name, 'fn' AS kind, l_linenumber * 10 AS start_line, l_linenumber * 10 + CAST(l_quantity AS INT) % 15 AS end_line FROM lineitem),
h AS (SELECT '/o' || o_orderkey AS path, 15 AS first, 24 AS last FROM orders WHERE o_orderkey % 3 = 0)
SELECT DISTINCT s.path, name, kind, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM h JOIN s ON s.path = h.path AND start_line <= last AND end_line >= first""")
def _(spark, sf):
    line = views.table(spark, sf, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("long")
    s = line.select(F.concat(F.lit("/o"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("fn").alias("kind"), start.alias("start_line"), (start + F.floor("l_quantity") % 15).cast("long").alias("end_line"))
    h = views.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("/o"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(15).alias("first"), F.lit(24).alias("last"))
    return graph.overlapping_symbols(h, s)


@query("join14_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def _(spark, sf):
    return graph.latest(views.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")
