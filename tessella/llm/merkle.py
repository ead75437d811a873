"""A manifest of a dataset as Merkle trees: one a source, and one over their roots.

Leaves are numbered within their source and dealt to aligned buckets of ARITY ** LEVELS. On the executors DuckDB makes a
bucket's levels from Arrow tables by ordered ``string_agg`` and ``sha256``; the roots of the buckets are the leaves of the
next, far smaller tier. Spark numbers, deals, and joins the outer proofs to the inner ones.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import partitions, written

#: Nodes of a run, and levels of a bucket: 2187 leaves.
ARITY, LEVELS = 3, 7
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:binary,right:binary>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field its bytes' number, a colon and its value; of null a dash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``pos``, the place within their ``tree`` by the order's columns (nulls first), and ``size``, the tree's rows.

    Rows are dealt in ranges of (tree, order), so one tree may lie in many tasks; only the ranges' sizes meet. Rows that
    agree in the whole order are alike to it, and take any of their places.
    """
    by = [F.asc_nulls_first(c) for c in ("tree", *order)]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", "first", before.alias("before"), F.sum("n").over(whole).alias("size"))
    return dealt.join(parts, ["tree", "part"]).withColumn("pos", F.expr("before + at - first")).drop("at", "part", "first", "before")


_LEVEL = f"SELECT tree, pos // {ARITY} AS pos, ups, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l{{i}} WHERE ups > {{i}} GROUP BY tree, pos // {ARITY}, ups"
_SIDES = f"""
SELECT a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
FROM l{{i}} a JOIN l{{i}} b ON a.tree = b.tree AND a.pos // {ARITY} = b.pos // {ARITY} WHERE a.ups > {{i}} GROUP BY a.tree, a.pos"""


def _blocks(nodes: pa.Table) -> pa.Table:
    """The paths of a bundle of buckets (tree, pos, ups, h), from each node up as many levels as its bucket has, and the bucket's root."""
    with duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""}) as db:
        db.register("nodes", nodes.select(["tree", "pos", "ups", "h"]).append_column("i", pa.array(range(len(nodes)))))
        db.execute("CREATE TABLE l0 AS SELECT * FROM nodes")
        top = max(nodes.column("ups").to_pylist())
        for i in range(top):
            db.execute(f"CREATE TABLE l{i + 1} AS {_LEVEL.format(i=i)}")
            db.execute(f"CREATE TABLE s{i} AS {_SIDES.format(i=i)}")
        steps = ", ".join(f"{{'left': unhex(s{i}.l), 'right': unhex(s{i}.r)}}" for i in range(top))
        tops = " UNION ALL ".join(f"SELECT tree, pos, {i} AS ups, h FROM l{i} WHERE ups = {i}" for i in range(top + 1))
        joins = " ".join(f"LEFT JOIN s{i} ON s{i}.tree = l0.tree AND s{i}.pos = l0.pos // {ARITY**i}" for i in range(top))
        path = f"[{steps}][:l0.ups]" if top else "CAST([] AS STRUCT(\"left\" BLOB, \"right\" BLOB)[])"
        found = db.sql(f"""
            SELECT {path} AS path, t.h AS top FROM l0 {joins}
            JOIN ({tops}) t ON t.tree = l0.tree AND t.ups = l0.ups AND t.pos = l0.pos // CAST({ARITY} ** l0.ups AS BIGINT) ORDER BY l0.i""").to_arrow_table()
    return nodes.append_column("path", found.column("path")).append_column("top", found.column("top"))


def _tier(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, size, h, more columns) with ``path`` to the root of their bucket and ``top``, that root."""
    width = ARITY**LEVELS
    small = nodes.where(F.col("size") <= width).count()
    # The levels of a tree that one bucket holds: until one node remains.
    ups = F.lit(0)
    for k in range(LEVELS):
        ups = ups + (F.col("size") > ARITY**k).cast("int")
    bundle = F.when(F.col("size") > width, F.concat_ws(":", F.expr(f"pos div {width}"), F.col("tree"))).otherwise(
        F.pmod(F.xxhash64("tree"), F.lit(max(1, small // width))).cast("string"))
    given = nodes.select("*", ups.alias("ups"), bundle.alias("bundle"))
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields if f.name not in ("tree", "pos", "h")]
    schema = ", ".join(["tree string", "pos long", *more, f"path {_PATH}", "top string"])
    names = ["tree", "pos", *[f.name for f in nodes.schema.fields if f.name not in ("tree", "pos", "h")], "path", "top"]
    kept = [c for c in names if c not in ("path", "top")]

    def blocks(table: pa.Table) -> pa.Table:
        return _blocks(table.select([*kept, "ups", "h"])).select(names)

    return written(given.groupBy("bundle").applyInArrow(blocks, schema), "paths")


def _paths(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, size, h, more columns) with ``path`` to the root of their tree and ``root``."""
    alone = nodes.where("size = 1").withColumn("path", F.array().cast(_PATH)).withColumnRenamed("h", "root")
    nodes = nodes.where("size > 1")
    if not nodes.limit(1).count():
        return alone
    width = ARITY**LEVELS
    inner = _tier(nodes)
    tops = inner.where(F.col("pos") % width == 0).select("tree", F.expr(f"pos div {width} AS pos"), F.ceil(F.col("size") / width).alias("size"), F.col("top").alias("h"))
    outer = _paths(tops).select("tree", F.col("pos").alias("bucket"), F.col("path").alias("outer"), "root")
    joined = inner.withColumn("bucket", F.expr(f"pos div {width}")).join(outer, ["tree", "bucket"])
    return joined.withColumn("path", F.concat("path", "outer")).drop("bucket", "outer", "top").unionByName(alone)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings make."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), h, F.lower(F.hex(s["right"]))), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    siblings = F.concat_ws("", F.transform(path, lambda s: F.lower(F.concat(F.hex(s["left"]), F.hex(s["right"])))))
    return F.sha2(siblings, 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf, more columns) with ``subroot`` of their source's tree, ``root`` over all, and ``path``.

    A path has the siblings of each level on the left and on the right, from the leaf through its source's root to the root;
    runs of one have none. A null source is a tree of its own and comes first. Within a source leaves ascend by doc_id, null
    first, then by digest; so repeated rows are leaves each. One row alone is its own root. An empty table has no rows. Texts
    of any length and nulls count by their leaf alone. Columns of leaves may not be called like those added here.
    """
    width = ARITY**LEVELS
    more = [c for c in leaves.columns if c not in ("source", "doc_id", "leaf")]
    # Null first, then sources by their bytes.
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    given = leaves.select(tree.alias("tree"), F.col("doc_id"), F.col("leaf").alias("h"), F.struct(F.col("source"), F.col("leaf"), *[F.col(f"`{c}`") for c in more]).alias("row"))
    nodes = numbered(given, ["doc_id", "h"])
    alone, many = nodes.where("size = 1"), nodes.where("size > 1")
    inner = _tier(many)
    at = F.expr(f"pos div {width}")
    tops = inner.where(F.col("pos") % width == 0).select("tree", at.alias("pos"), F.ceil(F.col("size") / width).alias("size"), F.col("top").alias("h"))
    tops = written(tops.unionByName(alone.select("tree", "pos", "size", "h")), "tops")
    under = _paths(tops).select("tree", F.col("pos").alias("bucket"), F.col("path").alias("under"), F.col("root").alias("subroot"))
    under = written(under, "under")
    roots = numbered(under.where("bucket = 0").select(F.lit("all").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("h")), ["name"])
    over = _paths(roots).select(F.col("name").alias("tree"), F.col("path").alias("over"), "root")
    # Sources meet the root's proofs by bucket, not by document: a hot source is few rows there.
    outer = under.join(over, "tree").select("tree", "bucket", F.concat("under", "over").alias("outer"), "subroot", "root")
    rows = inner.withColumn("bucket", at).select("tree", "bucket", "doc_id", "row", "path")
    rows = rows.unionByName(alone.select("tree", F.lit(0).cast("long").alias("bucket"), "doc_id", "row", F.array().cast(_PATH).alias("path")))
    joined = rows.join(outer, ["tree", "bucket"])
    return joined.select("doc_id", "row.*", "subroot", "root", F.concat("path", "outer").alias("path"))


def verify_tampered(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and what it says of tampered ones: where 2 divides crc32(doc_id), the text has lost its newlines.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row, as in ``manifest``. Columns but FIELDS
    play no part. Null texts and rows without doc_id stay as they are.
    """
    own = [F.col(c) for c in FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    leaves = docs.select("source", "doc_id", leaf(own).alias("leaf"), F.when(changed.isNotNull() & (changed != F.col("text")), leaf([*own[:-1], changed])).alias("other"))
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    out = manifest(leaves).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
