"""The relational model as views of general tables (documents, events, line items), and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths, text

NOW = 1735689600
DAY = 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of entries."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        path.alias("path"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang").alias("parent_path"), F.lit("file").alias("kind"), F.col("n_chars").alias("size"),
        (F.lit(1704067200) + F.col("doc_id") * 7919 % 31536000).alias("modified_s"), (F.lit(1704067200) + F.col("doc_id") * 104729 % 31536000).alias("first_indexed_at"),
        F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang")).alias("hint_cat"), "doc_id", "text",
    )


FILES = """files AS (
  SELECT '/corpus/' || source || '/' || lang || '/doc' || doc_id || '.txt' AS path, '/corpus/' || source || '/' || lang AS parent_path, 'file' AS kind,
    n_chars AS size, 1704067200 + (doc_id * 7919) % 31536000 AS modified_s, 1704067200 + (doc_id * 104729) % 31536000 AS first_indexed_at,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS hint_cat, doc_id, text FROM documents)"""


def directories(files: DataFrame) -> DataFrame:
    """All directories above files: (path, parent_path, kind)."""
    up = files.select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    return up.select("path", paths.parent("path").alias("parent_path"), F.lit("dir").alias("kind"))


DIRECTORIES = """up AS (
  SELECT DISTINCT unnest(['/corpus', '/corpus/' || source, '/corpus/' || source || '/' || lang]) AS path FROM documents),
directories AS (SELECT path, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/') AS parent_path, 'dir' AS kind FROM up)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("path", "parent_path", F.lit("file").alias("kind"), paths.depth("path").cast("long").alias("depth"), F.substring("text", 1, 200).alias("summary"),
                    text.abstract(F.substring("text", 1, 400)).alias("summary_l0"), F.sha2("text", 256).alias("source_hash"), F.col("size").alias("byte_size"), "modified_s")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return e.select(
        F.col("event_id").alias("id"), F.lit("cli").alias("surface"), F.col("event_type").alias("tool"), F.floor(F.col("value") * 100).cast("long").alias("bytes_served"),
        (F.floor(F.col("value") * 100).cast("long") * 3 + k * 100).alias("bytes_counterfactual"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
        F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_id") % 3 == 0, "exact").otherwise("estimate").alias("served_basis"),
    )


USAGE = """usage AS (
  SELECT event_id AS id, 'cli' AS surface, event_type AS tool, CAST(floor(value * 100) AS BIGINT) AS bytes_served,
    CAST(floor(value * 100) AS BIGINT) * 3 + coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 100 AS bytes_counterfactual,
    CAST(floor(epoch(ts)) AS BIGINT) AS "at", CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_id % 3 = 0 THEN 'exact' ELSE 'estimate' END AS served_basis FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges: customers' files call the parts that they order, suppliers' files define the parts of their first lines."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = nation.select("n_nationkey", F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("dir"))
    part = F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    line = table(spark, sf_dir, "lineitem")
    orders, customer, supplier = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    call = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    call = call.select(F.concat("dir", F.lit("/cust"), F.col("c_custkey").cast("string")).alias("from_path"), F.lit("calls").alias("kind"), part.alias("to_ref"))
    define = line.where("l_linenumber = 1").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    define = define.select(F.concat("dir", F.lit("/supp"), F.col("s_suppkey").cast("string")).alias("from_path"), F.lit("defines").alias("kind"), part.alias("to_ref"))
    return call.unionByName(define).distinct()


CALLS = """dirs AS (SELECT n_nationkey, '/' || r_name || '/' || n_name AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
edges AS (
  SELECT DISTINCT dir || '/cust' || c_custkey AS from_path, 'calls' AS kind, 'part' || l_partkey AS to_ref
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN dirs ON c_nationkey = n_nationkey
  UNION
  SELECT DISTINCT dir || '/supp' || s_suppkey, 'defines', 'part' || l_partkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN dirs ON s_nationkey = n_nationkey WHERE l_linenumber = 1)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges: pages import what their anchors point to."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("url").alias("from_path"), F.lit("imports").alias("kind"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("to_ref")).distinct()


LINKS = """edges AS (SELECT DISTINCT url AS from_path, 'imports' AS kind, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS to_ref FROM pages)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, path): orders as commits, their suppliers as files."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("/supp"), F.col("l_suppkey").cast("string")).alias("path")).distinct()


COMMITS = """commits AS (SELECT DISTINCT l_orderkey AS commit, '/supp' || l_suppkey AS path FROM lineitem)"""
