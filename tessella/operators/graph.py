"""Graphs of code and links: tiers of resolved calls, reachability, ranks, cycles and communities.

edges: (from_path, kind, to_ref), where to_ref is a symbol or a module. Files meet where one calls what another defines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths, predicates
from tessella.operators.search import numbered
from tessella.sources.shared import cut, stored

COMMON = 25
#: How a call was resolved, best first when several calls meet; and the order in which ways are tried.
TIERS = ("same_file", "same_dir", "import", "bare")
#: Endings that a relative import may stand for, and parts of paths that hold others' code.
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
NOISE = ("/vendor/", "/node_modules/", "/target/", "/dist/", "/assets/vendor/", "/.next/", "/build/", ".xcodeproj", "/DerivedData/", "/Pods/", ".min.js", ".bundle.js")


_CANDIDATES = "array<struct<how: string, what: string>>"


def outgoing(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("from_path") == path).select("kind", "to_ref").distinct().orderBy("kind", "to_ref")


def incoming(edges: DataFrame, kind: str, ref: str) -> DataFrame:
    return edges.where((F.col("kind") == kind) & (F.col("to_ref") == ref)).select("from_path").distinct().orderBy("from_path")


def import_candidates(caller: Column, ref: Column) -> Column:
    """What imports may mean, as an array of (how, what): 'path' with a whole path, 'suffix' with the last part of one. None for null."""
    here, none = F.regexp_replace(caller, "/[^/]*$", ""), F.array().cast(_CANDIDATES)
    joined = lambda relative: paths.joined(here, relative)
    told = lambda how, whats: F.transform(whats, lambda w: F.struct(F.lit(how).alias("how"), w.alias("what")))
    ended = lambda base, ends: F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(base, e))
    # ./a, ../a: a file, whatever its ending, or the directory's index.
    script = told("path", ended(joined(ref), ("", *JS_ENDINGS, *(f"/index{e}" for e in JS_ENDINGS))))
    # .a, ..a.b: each dot but the first is a level up.
    dots = F.length(F.regexp_extract(ref, r"^\.+", 0))
    module = told("path", ended(joined(F.concat(F.repeat(F.lit("../"), dots - 1), F.translate(F.substr(ref, dots + 1), ".", "/"))), (".py", "/__init__.py")))
    # crate::a::b, super::a: the last name may be a thing in the file of the one before it.
    parts = F.filter(F.split(F.translate(ref, "{", ""), "::"), lambda p: p != "")
    names = F.filter(parts, lambda p: ~p.isin("crate", "self", "super"))
    heads = F.transform(F.filter(F.array(F.size(names), F.size(names) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))
    # A file's own module stands one level below its directory, but for mod.rs.
    rise = F.size(F.filter(parts, lambda p: p == "super")) - F.when(F.endswith(caller, F.lit("/mod.rs")), 0).otherwise(1)
    up = F.repeat(F.lit("../"), rise)
    above = told("path", F.flatten(F.transform(heads, lambda h: ended(joined(F.concat(up, h)), (".rs", "/mod.rs")))))
    inside = told("suffix", F.flatten(F.transform(heads, lambda h: ended(F.concat(F.lit("/"), h), (".rs", "/mod.rs")))))
    # a, a.b: a package or a module anywhere.
    tail = F.concat(F.lit("/"), F.translate(ref, ".", "/"))
    dotted = F.contains(ref, F.lit("."))
    package = told("suffix", F.when(dotted, F.array(F.concat(tail, F.lit("/__init__.py")), F.concat(tail, F.lit(".py")))).otherwise(F.array(F.concat(tail, F.lit("/__init__.py")))))
    return (
        F.when(F.startswith(ref, F.lit(".")), F.when(F.contains(ref, F.lit("/")), script).otherwise(module))
        .when(F.contains(ref, F.lit("::")), F.when(F.get(parts, F.lit(0)) == "super", above).otherwise(inside))
        .when(dotted | ref.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), package).otherwise(none)
    )


def imported(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, target): files (path) that an import of a file may mean. Suffixes meet whole tails of paths, by equality.

    What an import may mean hangs on the caller's directory (and on whether it is mod.rs), not on the caller, so candidates are made
    once for each directory and name, and only the files found are dealt to callers."""
    caller = F.col("from_path")
    here = F.concat(F.regexp_replace(caller, "/[^/]*$", ""), F.lit("/"), F.when(F.endswith(caller, F.lit("/mod.rs")), "mod.rs").otherwise(""))
    asked = edges.where("kind = 'imports'").select("from_path", here.alias("here"), "to_ref")
    found = asked.select("here", "to_ref").distinct().select("here", "to_ref", F.explode(import_candidates(F.col("here"), F.col("to_ref"))).alias("c")).select("here", "to_ref", "c.how", "c.what")
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, -n, n), "/")))
    by_tail = files.where(F.contains("path", F.lit("/"))).select("path", F.explode(tails).alias("what"))
    exact = found.where("how = 'path'").join(files.select(F.col("path").alias("what")), "what").select("here", "to_ref", F.col("what").alias("target"))
    meant = exact.unionByName(found.where("how = 'suffix'").join(by_tail, "what").select("here", "to_ref", F.col("path").alias("target"))).distinct()
    meant = meant.select(F.col("here").alias("at"), F.col("to_ref").alias("ref"), "target")
    return asked.join(meant, F.col("here").eqNullSafe(F.col("at")) & (F.col("to_ref") == F.col("ref"))).select("from_path", "target").distinct()


def _known(calls: DataFrame, defines: DataFrame, imports: DataFrame, cap: int) -> DataFrame:
    """(caller, symbol, known): those of a symbol's targets that a caller imports."""
    imports = imports.where("from_path <> target").select(F.col("from_path").alias("caller"), "target")
    # A file of few symbols meets its importers; one of many meets the calls, lest its symbols times its importers be rows.
    many = defines.groupBy("target").count().where(F.col("count") > cap).select("target")
    by_file = imports.join(defines.join(many, "target", "left_anti"), "target").select("caller", "symbol", "target")
    by_call = calls.join(defines.join(many, "target", "left_semi"), "symbol").join(imports, ["caller", "target"]).select("caller", "symbol", "target")
    return by_file.unionByName(by_call).groupBy("caller", "symbol").agg(F.collect_set("target").alias("known"))


def resolved(edges: DataFrame, imports: DataFrame | None = None, cap: int = COMMON, drop_own: bool = True) -> DataFrame:
    """(caller, symbol, target, tier) of calls: to definers that the caller imports, else in its directory, else to
    all. Symbols without a definer or with more than ``cap`` don't resolve, nor do those a caller defines itself."""
    defines = edges.where("kind = 'defines'").select(F.col("to_ref").alias("symbol"), F.col("from_path").alias("target")).distinct()
    few = defines.groupBy("symbol").count().where(F.col("count") <= cap).select("symbol")
    defines = defines.join(few, "symbol").where("target IS NOT NULL")
    # ``cap`` targets at most stand in a symbol's row, so a call meets one row and becomes only those that it resolves to.
    symbols = defines.groupBy("symbol").agg(F.collect_list(F.struct("target", paths.parent("target").alias("up"))).alias("all"))
    calls = edges.where("kind = 'calls'").select(F.col("from_path").alias("caller"), F.col("to_ref").alias("symbol")).distinct()
    rows = calls.withColumn("from", paths.parent("caller"))
    if imports is not None:
        rows = rows.join(_known(calls, defines, imports, cap), ["caller", "symbol"], "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("array<string>"))
    rows = rows.join(symbols, "symbol")
    if drop_own:
        rows = rows.where(~F.exists("all", lambda t: t["target"] == F.col("caller")))
    else:
        rows = rows.withColumn("all", F.filter("all", lambda t: t["target"] != F.col("caller")))
    rows = rows.withColumn("near", F.filter("all", lambda t: t["up"] == F.col("from")))
    tier = F.when(F.col("known").isNotNull(), "import").when(F.size("near") > 0, "same_dir").otherwise("bare")
    met = F.when(F.col("known").isNotNull(), F.col("known")).when(F.size("near") > 0, F.col("near.target")).otherwise(F.col("all.target"))
    return rows.select("caller", "symbol", F.explode(met).alias("target"), tier.alias("tier"))


def tier_rank(tier: str = "tier"):
    return F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier))


def definer_counts(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'defines'").groupBy("to_ref").agg(F.countDistinct("from_path").alias("definers"))


def ambiguous(edges: DataFrame) -> DataFrame:
    """Symbols with several definers and a caller."""
    n = edges.groupBy("to_ref").agg(
        F.countDistinct(F.when(F.col("kind") == "defines", F.col("from_path"))).alias("definers"), F.countDistinct(F.when(F.col("kind") == "calls", F.col("from_path"))).alias("callers")
    )
    return n.where("definers > 1 AND callers > 0")


def noisy(path: str):
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    return F.greatest(*[F.contains(p, F.lit(x)) for x in NOISE])


def code_graph(calls: DataFrame, most: int | None = None, strict: bool = False, parts: int | None = None) -> DataFrame:
    """(source, target, weight, tier) of ``resolved``'s rows, which are distinct: a unit for each symbol, the best tier of them, no vendored files.
    With ``most`` the heaviest only. ``parts`` says into how many parts callers are dealt (``shared.parts``), which bounds what one task groups."""
    rows = calls.where(~noisy("caller") & ~noisy("target"))
    if strict:
        rows = rows.where("tier <> 'bare'")
    rows = rows.select(F.col("caller").alias("source"), "target", tier_rank().alias("t"))
    if parts:
        # A caller's rows lie in one part, so they are grouped there, and nowhere before.
        rows = rows.repartition(parts, "source")
    out = rows.groupBy("source", "target").agg(F.count("*").alias("weight"), F.min("t").alias("t"))
    out = out.select("source", "target", "weight", F.element_at(F.array(*map(F.lit, TIERS)), F.col("t").cast("int")).alias("tier"))
    return out if most is None else out.orderBy(F.desc("weight"), "source", "target").limit(most)


def degrees(graph: DataFrame) -> DataFrame:
    out = graph.select(F.col("source").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.select(F.col("target").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return out.groupBy("path").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def related(calls: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """Files on either end of a file's resolved calls: (path, symbols, tier)."""
    a = calls.where(F.col("caller") == path).select(F.col("target").alias("path"), "symbol", "tier")
    b = calls.where(F.col("target") == path).select(F.col("caller").alias("path"), "symbol", "tier")
    out = a.unionByName(b).groupBy("path").agg(F.countDistinct("symbol").alias("symbols"), F.min(tier_rank()).alias("t"))
    return out.select("path", "symbols", F.element_at(F.array(*map(F.lit, TIERS)), F.col("t").cast("int")).alias("tier")).orderBy(F.desc("symbols"), "path").limit(limit)


def reach(graph: DataFrame, start: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """(path, hop) of what is reached from start (path) in 1 to depth steps, by the first step that reaches it."""
    a, b = ("source", "target") if forward else ("target", "source")
    # Doubled edges are no harm, as each front is made distinct; making all edges so would group all of them in every turn.
    step = graph.select(F.col(a).alias("path"), F.col(b).alias("next"))
    seen = cut(start.select("path", F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, depth + 1):
        front = cut(front.join(step, "path").select(F.col("next").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def callers_of(edges: DataFrame, symbol: str, imports: DataFrame | None = None, limit: int = 25, files: DataFrame | None = None) -> DataFrame:
    """(path, tier) of the first callers of a symbol by path: how the call of each finds a definition. What they import is given
    (``imported``'s rows), or files (path) are, and then only these callers' imports are told."""
    calls = edges.where((F.col("kind") == "calls") & (F.col("to_ref") == symbol)).select(F.col("from_path").alias("path")).distinct().orderBy("path").limit(limit)
    # At most ``limit`` callers, whatever the number of definers.
    if imports is None and files is not None:
        calls = stored(calls)
        imports = imported(stored(edges.where("kind = 'imports'").join(F.broadcast(calls), F.col("from_path") == F.col("path"), "left_semi")), files)
    calls = F.broadcast(calls)
    at = edges.where((F.col("kind") == "defines") & (F.col("to_ref") == symbol)).select(F.col("from_path").alias("target")).distinct()
    own = at.join(calls, F.col("target") == F.col("path")).select("path", F.lit(1).alias("t"))
    beside = at.select(paths.parent("target").alias("up")).distinct().join(calls.withColumn("up", paths.parent("path")), "up").select("path", F.lit(3).alias("t"))
    rows = calls.withColumn("t", F.lit(4)).unionByName(own).unionByName(beside)
    if imports is not None:
        known = imports.join(calls, F.col("from_path") == F.col("path"), "left_semi").join(at, "target", "left_semi")
        rows = rows.unionByName(known.select(F.col("from_path").alias("path"), F.lit(2).alias("t")))
    tier = F.element_at(F.array(*map(F.lit, ("same_file", "import", "same_dir", "bare"))), F.min("t"))
    return rows.groupBy("path").agg(tier.alias("tier"))


def symbol_context(edges: DataFrame, symbols: DataFrame, notes: DataFrame, symbol: str, imports: DataFrame | None = None, limit: int = 25, most: int = 20, files: DataFrame | None = None) -> DataFrame:
    """(section, item, detail, first, last) of all that is known about a symbol: 'defined' (a file; what it is and its lines),
    'called' (a file, the tier), 'extended' and 'implemented' (a file), 'imports' and 'calls' (the first names that the defining files
    use), 'note' (a note's path, its title). edges may be narrowed by answers first, and repeated ones count once. imports or files: as of
    ``callers_of``. Empty where nothing defines the symbol."""
    none = F.lit(None)
    row = lambda df, section, item, detail=none, first=none, last=none: df.select(
        F.lit(section).alias("section"), F.col(item).alias("item"), detail.cast("string").alias("detail"), first.cast("long").alias("first"), last.cast("long").alias("last")
    )
    at = edges.where((F.col("kind") == "defines") & (F.col("to_ref") == symbol)).select(F.col("from_path").alias("path")).distinct()
    # Of several symbols of the name in one file the first by its lines.
    spans = symbols.where(F.col("name") == symbol).groupBy("path").agg(F.min(F.struct("start_line", "end_line", "kind")).alias("s"))
    out = row(at.join(spans, "path", "left").select("path", "s.*"), "defined", "path", F.col("kind"), F.col("start_line"), F.col("end_line"))
    out = out.unionByName(row(callers_of(edges, symbol, imports, limit, files), "called", "path", F.col("tier")))
    for section, kind in (("extended", "extends"), ("implemented", "implements")):
        out = out.unionByName(row(incoming(edges, kind, symbol), section, "from_path"))
    used = edges.where("kind IN ('imports', 'calls')").join(at.withColumnRenamed("path", "from_path"), "from_path", "left_semi").select("kind", "to_ref").distinct()
    for kind in ("imports", "calls"):
        out = out.unionByName(row(used.where(F.col("kind") == kind).orderBy("to_ref").limit(most), kind, "to_ref"))
    out = out.unionByName(row(notes.where(F.col("anchor") == symbol), "note", "note_path", F.col("title")))
    return out.join(F.broadcast(at.limit(1).select(F.lit(True).alias("__some"))), F.lit(True), "left_semi")


def api_surface(edges: DataFrame, most: int = 12) -> DataFrame:
    """(path, surface): the first names that files define by name, joined by commas, idioms left out. Files with none have no row."""
    names = edges.where("kind = 'defines' AND to_ref IS NOT NULL").where(~predicates.idiom(F.col("to_ref"))).select(F.col("from_path").alias("path"), "to_ref").distinct()
    few = names.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("to_ref"))).where(F.col("n") <= most)
    return few.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("to_ref")), ", ").alias("surface"))


def modules_in(modules: DataFrame, scope: str = "") -> DataFrame:
    """Modules (module_id, member_path, ...) with a member in a scope, whole, with their number of members. Of an empty scope: all."""
    some = modules.where(paths.under("member_path", scope)).select("module_id").distinct()
    rows = modules.join(some, "module_id", "left_semi")
    return rows.join(rows.groupBy("module_id").agg(F.count("*").alias("members")), "module_id")


def blast_radius(edges: DataFrame, calls: DataFrame, symbol: str, depth: int = 2, strict: bool = False, heritage: bool = False) -> DataFrame:
    """(path, hop): direct callers of a symbol, then files whose calls resolve into those, and so on."""
    kinds = ["calls", *(["extends", "implements"] if heritage else [])]
    first = edges.where(F.col("kind").isin(kinds) & (F.col("to_ref") == symbol)).select(F.col("from_path").alias("path")).distinct()
    used = calls.where("tier <> 'bare'") if strict else calls
    graph = used.select(F.col("caller").alias("source"), "target")
    own = edges.where((F.col("kind") == "defines") & (F.col("to_ref") == symbol)).select(F.col("from_path").alias("path"))
    later = reach(graph, first, depth - 1, forward=False).withColumn("hop", F.col("hop") + 1)
    return first.withColumn("hop", F.lit(1)).unionByName(later).join(own.distinct(), "path", "left_anti")


def risk(n: int) -> str:
    return "LOW" if n <= 3 else "MEDIUM" if n <= 9 else "HIGH"


def impact(edges: DataFrame, calls: DataFrame, symbols: list[str], depth: int = 2) -> DataFrame:
    """(path, hop) over several symbols: the least hop."""
    out = None
    for s in symbols:
        one = blast_radius(edges, calls, s, depth)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("path").agg(F.min("hop").alias("hop"))


def shortest_path(calls: DataFrame, start: str, end: str, depth: int = 10) -> list[str]:
    """Files from start to end along resolved calls that aren't bare, or nothing; of equally short ones the first by name."""
    graph = calls.where("tier <> 'bare'").select(F.col("caller").alias("path"), "target").distinct()
    spark = calls.sparkSession
    front = spark.createDataFrame([(start, [start])], "path string, trail array<string>")
    seen = front.select("path")
    for _ in range(depth):
        front = front.join(graph, "path").select(F.col("target").alias("path"), F.concat("trail", F.array("target")).alias("trail"))
        front = cut(front.groupBy("path").agg(F.min("trail").alias("trail")).join(seen, "path", "left_anti"))
        if found := front.where(F.col("path") == end).take(1):
            return found[0]["trail"]
        if front.isEmpty():
            return []
        seen = seen.unionByName(front.select("path"))
    return []


def pagerank(graph: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, least: float = 1e-9) -> DataFrame:
    """(path, rank) over weighted edges (source, target, weight); what nodes without edges hold is dealt to all."""
    ends = graph.select(F.col("source").alias("path")).unionByName(graph.select(F.col("target").alias("path")))
    nodes = cut((nodes.select("path").unionByName(ends) if nodes is not None else ends).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = graph.groupBy("source").agg(F.sum("weight").alias("total"))
    step = cut(graph.join(out, "source").select(F.col("source").alias("path"), "target", (F.col("weight") / F.col("total")).alias("share")))
    hangs = nodes.join(step.select("path").distinct(), "path", "left_anti").withColumn("hangs", F.lit(True))
    nodes = cut(nodes.join(hangs, "path", "left"))
    ranks = nodes.select("path", F.coalesce("hangs", F.lit(False)).alias("hangs"), F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        lost = ranks.where("hangs").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        gained = step.join(ranks.select("path", "rank"), "path").groupBy(F.col("target").alias("path")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        ranks = cut(ranks.join(gained, "path", "left").select("path", "hangs", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        if ranks.agg(F.sum("moved")).first()[0] < least:
            break
        ranks = ranks.drop("moved")
    return ranks.select("path", "rank")


def cycles(graph: DataFrame) -> DataFrame:
    """(path, cycle): strongly connected components of more than one file, named by their smallest.

    Files without a way in or out go first. Then the smallest name that reaches a file colours it, and what reaches the
    colour's file back, within the colour, is its component; the rest goes round again.
    """
    left = cut(graph.where("source <> target").select("source", "target").distinct())
    out = None
    while not left.isEmpty():
        ends = left.select(F.col("source").alias("path")).intersect(left.select(F.col("target").alias("path")))
        trimmed = cut(left.join(ends.withColumnRenamed("path", "source"), "source", "left_semi").join(ends.withColumnRenamed("path", "target"), "target", "left_semi"))
        if trimmed.count() < left.count():
            left = trimmed
            continue
        colour = cut(left.select(F.col("source").alias("path")).distinct().withColumn("colour", F.col("path")))
        while True:
            come = left.join(colour.withColumnRenamed("path", "source"), "source").groupBy(F.col("target").alias("path")).agg(F.min("colour").alias("c"))
            new = cut(colour.join(come, "path", "left").select("path", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            if not new.where("moved").limit(1).count():
                break
            colour = new.drop("moved")
        a = left.join(colour.select(F.col("path").alias("source"), F.col("colour").alias("ca")), "source").join(colour.select(F.col("path").alias("target"), F.col("colour").alias("cb")), "target")
        inside = cut(a.where("ca = cb").select("source", "target", F.col("ca").alias("colour")))
        found = cut(colour.where("path = colour").select("path", "colour"))
        front = found
        while True:
            front = inside.join(front.select(F.col("path").alias("target"), "colour"), ["target", "colour"]).select(F.col("source").alias("path"), "colour").distinct()
            front = cut(front.join(found, ["path", "colour"], "left_anti"))
            if front.isEmpty():
                break
            found = found.unionByName(front)
        several = found.join(found.groupBy("colour").count().where("count > 1").select("colour"), "colour").select("path", F.col("colour").alias("cycle"))
        out = several if out is None else out.unionByName(several)
        left = cut(left.join(found.select(F.col("path").alias("source")), "source", "left_anti").join(found.select(F.col("path").alias("target")), "target", "left_anti"))
    return cut(out) if out is not None else graph.sparkSession.createDataFrame([], "path string, cycle string")


def louvain(n: int, edges: list[tuple[int, int, float]], passes: int = 50) -> list[int]:
    """A community for each of n nodes: one level of greedy modularity, nodes in order, strict gains only."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    degree = [sum(x.values()) for x in near]
    whole = sum(degree)
    of, total = list(range(n)), degree[:]
    moved = whole > 0
    for _ in range(passes):
        if not moved:
            break
        moved = False
        for i in range(n):
            links: dict[int, float] = {of[i]: 0.0}
            for j, w in near[i].items():
                links[of[j]] = links.get(of[j], 0) + w
            total[of[i]] -= degree[i]
            gain = {c: k - total[c] * degree[i] / whole for c, k in links.items()}
            best = of[i]
            for c in sorted(gain):
                if gain[c] > gain[best] + 1e-12:
                    best = c
            total[best] += degree[i]
            if best != of[i]:
                of[i], moved = best, True
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in of]


def _proposed(state: DataFrame, edges: DataFrame, whole: float) -> DataFrame:
    """state (id, dir, degree, of) with each file's best other community (``best``, null where none gains more than staying) and its
    links into its own (``own``). Files of a directory link by one, which is counted by directory and community and never made rows."""
    totals = state.groupBy(F.col("of").alias("c")).agg(F.sum("degree").alias("total"))
    shares = state.groupBy("dir", F.col("of").alias("c")).agg(F.count("*").alias("share"))
    # Where the directory alone links, only the lightest community of each share can be best (the second, where the first is one's own).
    w = Window.partitionBy("dir", "share").orderBy("total", "c")
    light = shares.join(totals, "c").withColumn("n", F.row_number().over(w)).where("n <= 2").select("dir", "c")
    met = edges.join(state.select(F.col("id").alias("j"), F.col("of").alias("c")), "j").select(F.col("i").alias("id"), "c", "weight")
    none = F.lit(0.0).alias("weight")
    met = met.unionByName(state.select("id", F.col("of").alias("c"), none)).unionByName(state.join(light, "dir").select("id", "c", none))
    met = met.groupBy("id", "c").agg(F.sum("weight").alias("weight")).join(state, "id").join(totals, "c").join(shares, ["dir", "c"], "left")
    mine = F.col("c") == F.col("of")
    links = F.col("weight") + F.coalesce("share", F.lit(0)) - mine.cast("int")
    gain = links - (F.col("total") - F.when(mine, F.col("degree")).otherwise(0.0)) * F.col("degree") / whole
    met = met.select("id", "dir", "degree", "of", "c", mine.alias("mine"), links.alias("links"), gain.alias("gain"))
    out = met.groupBy("id").agg(
        *[F.first(x).alias(x) for x in ("dir", "degree", "of")], F.max(F.when(F.col("mine"), F.struct("gain", "links"))).alias("stay"),
        F.max(F.when(~F.col("mine"), F.struct("gain", (-F.col("c")).alias("c")))).alias("go"),
    )
    best = F.when(F.col("go.gain") > F.col("stay.gain") + 1e-12, -F.col("go.c"))
    return out.select("id", "dir", "degree", "of", F.col("stay.links").alias("own"), best.alias("best"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 50, least: float = 1e-6) -> DataFrame:
    """(id, of): greedy modularity of nodes (id, dir) over edges (i, j, weight), both ways, and links of one within directories.

    As ``louvain``, but all files choose at once, in rounds. In a round moves go only to communities named lower or only to ones named higher,
    so no two swap. Where a round's moves together lose modularity they are taken back and half as many go, so it only rises. It ends
    where no move gains, where a round each way gained less than ``least`` of modularity, or after ``rounds``.
    """
    size = nodes.groupBy("dir").agg((F.count("*") - 1).cast("double").alias("beside"))
    calls = edges.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("calls"))
    degree = F.coalesce("calls", F.lit(0.0)) + F.col("beside")
    state = stored(nodes.join(size, "dir").join(calls, "id", "left").select("id", "dir", degree.alias("degree"), F.col("id").alias("of")))
    whole = state.agg(F.sum("degree")).first()[0]
    if not whole:
        return state.select("id", "of")
    kept, reached, gained, halves, lower = None, 0.0, [1.0, 1.0], 0, True
    for turn in range(rounds):
        found = stored(_proposed(state, edges, whole))
        squares = found.groupBy("of").agg(F.sum("degree").alias("total"), F.sum("own").alias("own"))
        modularity = squares.agg(F.sum(F.col("own") / whole - (F.col("total") / whole) ** 2)).first()[0]
        # More than the order of a sum of fractions can make, so that each run goes the same way.
        if kept is None or modularity > reached + 1e-9:
            gained = [gained[1], modularity - reached if kept is not None else 1.0]
            kept, reached, halves, lower = found, modularity, max(halves - 1, 0), not lower
        else:
            halves += 1
        if max(gained) < least:
            break
        # Whether a file is among the movers of a half, a quarter and so on hangs on its place and the turn.
        some = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << min(halves, 40)))
        go = {way: F.col("best") < F.col("of") if way else F.col("best") > F.col("of") for way in (True, False)}
        asked = kept.agg(*[F.min(F.when(go[way], some)).alias(str(way)) for way in go]).first()
        if asked[str(lower)] is None:
            lower = not lower
        if asked[str(lower)] is None:
            break
        # At least one goes: one alone always gains.
        move = go[lower] & (some <= asked[str(lower)])
        state = kept.select("id", "dir", "degree", F.when(move, F.col("best")).otherwise(F.col("of")).alias("of"))
    return kept.select("id", "of")


def _in_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, of) by ``louvain``, of few nodes."""

    def of(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id").reset_index(drop=True)
        at = {p: k for k, p in enumerate(nodes["id"])}
        calls = [(at[i], at[j], w) for i, j, w in zip(edges["i"], edges["j"], edges["weight"], strict=True) if i < j]
        prior = [(a, b, 1.0) for m in nodes.groupby("dir").indices.values() for k, a in enumerate(m) for b in m[k + 1 :]]
        return pd.DataFrame({"id": nodes["id"], "of": louvain(len(nodes), calls + prior)})

    one = F.lit(0).alias("grp")
    return nodes.groupBy(one).cogroup(edges.groupBy(one)).applyInPandas(of, "id long, of long")


def modules(graph: DataFrame, most: int = 1500) -> DataFrame:
    """(module_id, path, cohesion, size): communities of calls and of shared directories; the largest first, then by their first path.
    Up to ``most`` files choose in the order of their paths, one after the other (``louvain``), more in rounds (``communities``)."""
    graph = stored(graph.select("source", "target", F.greatest(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")))
    files = graph.select(F.col("source").alias("path")).unionByName(graph.select(F.col("target").alias("path"))).distinct()
    # In the order of paths, so that the first of a module by its number is the first by its path.
    nodes = stored(files.orderBy("path").select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.monotonically_increasing_id().alias("id")))
    ids = {c: nodes.select(F.col("path").alias(c), F.col("id").alias(i)) for c, i in (("source", "i"), ("target", "j"))}
    calls = graph.where("source <> target").join(ids["source"], "source").join(ids["target"], "target")
    both = calls.select("i", "j", "weight").unionByName(calls.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    edges = stored(both.repartition("i").groupBy("i", "j").agg(F.sum("weight").alias("weight")))
    found = (_in_order if nodes.count() <= most else communities)(nodes.select("id", "dir"), edges)
    found = stored(nodes.join(found, "id").select("id", "path", "of"))
    ends = [found.select(F.col("id").alias(c), F.col("of").alias(f"of_{c}")) for c in ("i", "j")]
    inside = edges.where("i < j").join(ends[0], "i").join(ends[1], "j").where("of_i = of_j").groupBy(F.col("of_i").alias("of")).agg(F.count("*").alias("inside"))
    sizes = found.groupBy("of").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    k = F.col("size")
    cohesion = F.when(k > 1, 2.0 * F.coalesce("inside", F.lit(0)) / (k * (k - 1))).otherwise(1.0)
    rows = sizes.join(inside, "of", "left").select("of", (-k).alias("fewer"), "first", "size", cohesion.alias("cohesion"))
    rows = numbered(rows, ["fewer", "first"], "first")
    return found.join(rows, "of").select(F.col("place").alias("module_id"), "path", "cohesion", "size")


def overlapping_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a hunk (path, first, last) touches."""
    j = hunks.join(symbols, "path").where("start_line <= last AND end_line >= first")
    return j.select("path", "name", F.col("kind"), "start_line", "end_line").distinct()


def star_edges(members: DataFrame, group: str = "grp") -> DataFrame:
    """(source, target): each member of a group with the group's first."""
    first = members.groupBy(group).agg(F.min("path").alias("source"))
    return members.join(first, group).where("path <> source").select("source", F.col("path").alias("target")).distinct()


def neighbourhood(graph: DataFrame, focus: str, depth: int = 1) -> DataFrame:
    """Edges among the files within one or two steps of one, whichever way."""
    spark = graph.sparkSession
    both = graph.select("source", "target").unionByName(graph.select(F.col("target").alias("source"), F.col("source").alias("target")))
    start = spark.createDataFrame([(focus,)], "path string")
    near = reach(both, start, min(max(depth, 1), 2)).select("path").unionByName(start)
    return graph.join(near.select(F.col("path").alias("source")), "source", "left_semi").join(near.select(F.col("path").alias("target")), "target", "left_semi")


def latest(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
