"""Queries of the composed retrieval: documents as chunks with headings, paths and the vectors of the same ids."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import ann, batch, overview, retrieve, search
from tessella.operators import index as inverted
from tessella.plans.registry import query
from tessella.plans.search_queries import _WEIGHTS, _weights
from tessella.sources import views
from tessella.sources.shared import stored
from tessella.sources.views import FILES, NOW

#: A question of words in texts, and one of words in paths and headings.
WORDS, PLACES = "insh therth erthe", "src1 en"
#: The row whose vector stands for that of the question.
ASKED = 7
SETTINGS = retrieve.Settings(top_k=60, mmr=1.0, now=NOW - 320 * 86400)


def _match(question: str, where: str = "true") -> str:
    """SQL of retrieve.match: ``sparse`` (id, score)."""
    tokens, terms = search.query_terms(question)
    fields = {"t": "text", "h": "heading", "p": "entry_path", "c": "CAST(chunk_id AS VARCHAR)"}
    split = ", ".join(rf"list_filter(regexp_split_to_array(translate(lower(coalesce({e}, '')), '{text.ACCENTED}', '{text.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS {n}" for n, e in fields.items())
    once = lambda n, t: f"len(list_filter({n}, lambda w: w = '{t}'))"
    said = lambda n: f"len(list_filter(range(1, len({n}) + 1), lambda i: " + " AND ".join(f"{n}[i + {k}] = '{t}'" for k, t in enumerate(tokens)) + "))"
    tf = [" + ".join(once(n, t) for n in fields) for t in terms] + [" + ".join(said(n) for n in fields)]
    counts = ", ".join(f"{c} AS tf{i}" for i, c in enumerate(tf))
    totals = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(tf)))
    part = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))"
    return f"""words AS (SELECT chunk_id AS id, coalesce({where}, false) AS ok, {split} FROM chunks),
counted AS (SELECT id, ok, len(t) + len(h) + len(p) + len(c) AS length, {counts} FROM words),
totals AS (SELECT count(*) AS n, avg(length) AS mean, {totals} FROM counted),
sparse AS (SELECT id, {" + ".join(map(part, range(len(tf))))} AS score FROM counted, totals WHERE ok AND ({" OR ".join(f"tf{i} > 0" for i in range(len(tf)))}) ORDER BY round(score, 9) DESC, id LIMIT 100)"""


_CHUNKS = f"""{FILES}, chunks AS (SELECT f.doc_id AS chunk_id, path AS entry_path, d.source AS heading, f.text, CAST(e.embedding AS DOUBLE[]) AS embedding FROM files f JOIN documents d USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = f.doc_id)"""
_STUB = "NOT (length(text) < 80 AND regexp_matches(text, '(?i)^(File|Image|Media file): '))"
_DENSE = f"""q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {ASKED}),
dense AS (SELECT chunk_id AS id, list_dot_product(embedding, q) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(q, q))) AS score FROM chunks, q WHERE embedding IS NOT NULL AND {_STUB} ORDER BY round(score, 9) DESC, id LIMIT 100)"""


def _stages(arms: dict[str, str], k: int) -> str:
    """CTEs of fused and final ranks over arms."""
    ranks = " UNION ALL ".join(f"SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS r FROM {a}" for a in arms.values())
    return f"""ranks AS ({ranks}), fused AS (SELECT id, sum(1.0 / (r + 61)) AS score FROM ranks GROUP BY id ORDER BY round(score, 12) DESC, id LIMIT {k}), {_WEIGHTS},
dirs AS (SELECT c.chunk_id, max_by(w.weight, length(w.target)) AS weight FROM chunks c JOIN weights w ON w.target_kind = 'dir' AND starts_with(c.entry_path, w.target || '/') GROUP BY c.chunk_id),
aged AS (SELECT path, CASE WHEN a > 90 THEN 1.0 WHEN a <= 7 THEN 2.0 WHEN a <= 30 THEN 1.5 ELSE 1.2 END AS factor FROM (SELECT path, floor(({NOW - 320 * 86400} - modified_s) / 86400) AS a FROM files)),
final AS (SELECT id, fused.score * CAST(coalesce(own.weight, dirs.weight, cat.weight, 1.0) AS DOUBLE) * factor AS score FROM fused JOIN chunks c ON c.chunk_id = id JOIN files f ON f.doc_id = id JOIN aged ON aged.path = c.entry_path
  LEFT JOIN weights own ON own.target_kind = 'file' AND own.target = c.entry_path LEFT JOIN dirs ON dirs.chunk_id = id LEFT JOIN weights cat ON cat.target_kind = 'category' AND cat.target = f.hint_cat)"""


def _placed(name: str, stage: str = "") -> str:
    head = f"'{stage}' AS stage, " if stage else ""
    return f"SELECT {head}id AS chunk_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, id) - 1 AS place FROM {name}"


def _tables(spark, sf) -> retrieve.Tables:
    f = views.files(spark, sf)
    v = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    head = F.element_at(F.split("path", "/"), 3)
    chunks = f.join(v, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), F.col("path").alias("entry_path"), head.alias("heading"), "text", "embedding")
    known = f.where("hint_cat IS NOT NULL").select("path", F.col("hint_cat").alias("category"), F.lit("auto").alias("source"))
    return retrieve.Tables(chunks, weights=_weights(spark), classifications=known, files=f.select("path", "modified_s"))


def _vector(spark, sf) -> list[float]:
    row = views.table(spark, sf, "embeddings").where(F.col("vec_id") == ASKED).first()
    return [float(x) for x in row["embedding"]]


@query("ret02_fields", f"WITH {_CHUNKS}, {_match(WORDS)} SELECT id, round(score, 6) AS score FROM sparse")
def _(spark, sf):
    return retrieve.match(_tables(spark, sf).chunks, WORDS).withColumn("score", F.round("score", 6))


@query("ret02_scoped_phrase", f"WITH {_CHUNKS}, {_match(PLACES, 'starts_with(entry_path, ' + repr('/corpus/src1/') + ')')} SELECT id, round(score, 6) AS score FROM sparse")
def _(spark, sf):
    chunks = _tables(spark, sf).chunks
    return retrieve.match(chunks, PLACES, admitted=F.startswith("entry_path", F.lit("/corpus/src1/"))).withColumn("score", F.round("score", 6))


@query("ret17_retrieve", f"WITH {_CHUNKS}, {_match(PLACES, _STUB)}, {_DENSE}, {_stages({'a': 'sparse', 'b': 'dense'}, 60)} {_placed('final')}")
def _(spark, sf):
    got = retrieve.retrieve(_tables(spark, sf), PLACES, _vector(spark, sf), SETTINGS)
    return got.select("chunk_id", F.round("rrf_score", 9).alias("score"), "place")


@query("ret07_sparse_mode", f"WITH {_CHUNKS}, {_match(WORDS, _STUB)}, {_stages({'a': 'sparse'}, 60)} {_placed('final')}")
def _(spark, sf):
    got = retrieve.retrieve(_tables(spark, sf), WORDS, _vector(spark, sf), replace(SETTINGS, mode="sparse", mmr=0.5))
    return got.select("chunk_id", F.round("rrf_score", 9).alias("score"), "place")


@query("flt06_asked", f"""WITH {_CHUNKS}, {_match(WORDS, _STUB + " AND contains(lower(entry_path), '/en/') AND ends_with(entry_path, '.txt')")}, {_stages({'a': 'sparse'}, 60)} {_placed('final')}""")
def _(spark, sf):
    got = retrieve.asked(_tables(spark, sf), f"path:/EN/ {WORDS} type:docs", None, replace(SETTINGS, mode="sparse"))
    return got.select("chunk_id", F.round("rrf_score", 9).alias("score"), "place")


_ARM = "SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS score FROM {0} ORDER BY 2 DESC, 1 LIMIT 60"


@query("ret20_trace", f"""WITH {_CHUNKS}, {_match(WORDS, _STUB)}, {_DENSE}, {_stages({'a': 'sparse', 'b': 'dense'}, 60)},
a AS ({_ARM.format('sparse')}), b AS ({_ARM.format('dense')}) {_placed('a', 'sparse')} UNION ALL {_placed('b', 'dense')} UNION ALL {_placed('final', 'final')}""")
def _(spark, sf):
    return retrieve.trace(_tables(spark, sf), WORDS, _vector(spark, sf), SETTINGS).withColumn("score", F.round("score", 9))


_NEAR = """SELECT "query", id, rank, round(score, 9) AS score FROM (
  SELECT a.vec_id AS "query", b.vec_id AS id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(score, 9) DESC, b.vec_id) - 1 AS rank
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b) WHERE rank < 20"""


@query("ret04_graph_nearest", _NEAR)
def _(spark, sf):
    v = views.table(spark, sf, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return ann.nearest(stored(ann.build(v, "vec_id")), asked, 20).select("query", "id", "rank", F.round("score", 9).alias("score"))


@query("ret05_dense_scoped", f"""WITH {_CHUNKS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {ASKED})
SELECT chunk_id AS id, round(list_dot_product(embedding, q) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(q, q))), 9) AS score FROM chunks, q WHERE embedding IS NOT NULL AND starts_with(entry_path, '/corpus/src1/') ORDER BY 2 DESC, 1 LIMIT 30""")
def _(spark, sf):
    chunks = _tables(spark, sf).chunks
    graph = stored(ann.build(chunks)) if ann.worth(chunks) else None
    return ann.dense(chunks, _vector(spark, sf), 30, "/corpus/src1", graph).withColumn("score", F.round("score", 9))


#: (number, text, id of the vector that stands for it, k, expected paths): golden questions of all kinds; the last finds nothing.
GOLDEN = [(1, WORDS, 7, 60, ["en/doc7.txt", "doc3.txt"]), (2, PLACES, 11, 20, ["src1/en/doc1.txt"]), (3, "the of and", 20, 10, ["/corpus/src0"]), (4, "xyzzyq", None, 5, ["nowhere.txt"])]


def _golden_sql() -> str:
    parts = []
    for n, words, asked, k, _ in GOLDEN:
        arms = {"a": "sparse", "b": "dense"} if asked is not None else {"a": "sparse"}
        near = _DENSE.replace(f"vec_id = {ASKED}", f"vec_id = {asked}") if asked is not None else "none AS (SELECT 1)"
        parts.append(f"SELECT {n} AS question, chunk_id, score, place FROM (WITH {_match(words, _STUB)}, {near}, {_stages(arms, k)} {_placed('final')})")
    return " UNION ALL ".join(parts)


def _golden(spark, sf):
    v = views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = spark.createDataFrame([(n, t, a, k) for n, t, a, k, _ in GOLDEN], "question long, text string, vec_id long, k int")
    expected = spark.createDataFrame([(n, p) for n, *_, e in GOLDEN for p in e], "question long, expect string")
    return rows.join(v, "vec_id", "left").drop("vec_id"), expected


def _indexed(tables: retrieve.Tables) -> retrieve.Tables:
    """With a written index."""
    made = inverted.build(tables.chunks)
    return replace(tables, index=inverted.Index(stored(made.postings), stored(made.rows)))


@query("evl05_batch", f"WITH {_CHUNKS} {_golden_sql()}")
def _(spark, sf):
    got = batch.retrieve(_indexed(_tables(spark, sf)), _golden(spark, sf)[0], SETTINGS)
    return got.select("question", "chunk_id", F.round("rrf_score", 9).alias("score"), "place")


_EXPECTED = ", ".join(f"({n}, '{p}')" for n, *_, e in GOLDEN for p in e)


@query("evl05_golden", f"""WITH {_CHUNKS}, expected(question, expect) AS (VALUES {_EXPECTED}), asked(question, k) AS (VALUES {', '.join(f'({n}, {k})' for n, _, _, k, _ in GOLDEN)}),
found AS ({_golden_sql()}), top AS (SELECT f.question, f.place, c.entry_path AS item FROM found f JOIN chunks c USING (chunk_id) JOIN asked a ON a.question = f.question WHERE f.place < a.k),
pairs AS (SELECT t.*, e.expect FROM top t JOIN expected e ON e.question = t.question AND (t.item = e.expect OR (NOT starts_with(e.expect, '/') AND ends_with(t.item, '/' || e.expect)))),
per AS (SELECT question, count(DISTINCT place) AS m, min(place) + 1 AS first_rank, count(DISTINCT expect) AS covered FROM pairs GROUP BY question),
gains AS (SELECT question, sum(1 / log2(place + 2)) AS dcg FROM (SELECT DISTINCT question, place FROM pairs) GROUP BY question)
SELECT a.question, a.k::BIGINT AS k, coalesce(n, 0) AS retrieved, coalesce(m > 0, false) AS hit, first_rank, round(coalesce(1.0 / first_rank, 0.0), 9) AS rr, round(coalesce(m / n, 0.0), 9) AS "precision",
  round(coalesce(covered, 0) / (SELECT count(*) FROM expected e WHERE e.question = a.question), 9) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, m + 1), lambda i: 1 / log2(i + 1))), 0.0), 9) AS ndcg
FROM asked a LEFT JOIN (SELECT question, count(*) AS n FROM top GROUP BY question) t USING (question) LEFT JOIN per USING (question) LEFT JOIN gains USING (question)""")
def _(spark, sf):
    got = batch.evaluate(_indexed(_tables(spark, sf)), *_golden(spark, sf), SETTINGS)
    return got.select("question", "k", "retrieved", "hit", "first_rank", *[F.round(c, 9).alias(c) for c in ("rr", "precision", "recall", "ndcg")])


#: Directories with summaries: the corpus, every second source, and languages but one. Questions: by language, by source, and one over all.
_SUMMED = f"""dirs AS (SELECT '/corpus' AS path, '/' AS parent_path, count(*) AS n FROM files UNION ALL SELECT '/corpus/' || split_part(path, '/', 3), '/corpus', count(*) FROM files GROUP BY 1
  UNION ALL SELECT parent_path, '/corpus/' || split_part(path, '/', 3), count(*) FROM files GROUP BY 1, 2),
summed AS (SELECT *, ' ' || n || ' files – ' || path || ' ' AS summary, CASE WHEN n % 2 = 0 THEN 'é' || n END AS l0 FROM dirs WHERE path = '/corpus' OR (path LIKE '/corpus/%/%' AND path NOT LIKE '%/fr') OR (path NOT LIKE '/corpus/%/%' AND path LIKE '%0'))"""


@query("ret26_overview", f"""WITH {FILES}, {_SUMMED}, hits AS (SELECT 'l:' || parent_path AS question, path, doc_id FROM files UNION ALL SELECT 's:' || split_part(path, '/', 3), path, doc_id FROM files UNION ALL SELECT 'all', path, doc_id FROM files),
top AS (SELECT question, path FROM hits QUALIFY row_number() OVER (PARTITION BY question ORDER BY doc_id) <= 5),
common AS (SELECT question, CASE WHEN count(DISTINCT path) = 1 THEN min(path) WHEN count(DISTINCT split_part(path, '/', 3)) > 1 THEN '/corpus' WHEN count(DISTINCT split_part(path, '/', 4)) > 1 THEN '/corpus/' || min(split_part(path, '/', 3)) ELSE '/corpus/' || min(split_part(path, '/', 3)) || '/' || min(split_part(path, '/', 4)) END AS at FROM top GROUP BY question),
root AS (SELECT question, max_by(s.path, length(s.path)) AS root, max_by(s.summary, length(s.path)) AS summary FROM common c JOIN summed s ON c.at = s.path OR starts_with(c.at, s.path || '/') GROUP BY question),
heads AS (SELECT question, root, 'PROJECT OVERVIEW (directory roll-up summaries — background context; cite numbered excerpts below for specific claims):' || chr(10) || regexp_extract(root, '[^/]*$') || ': ' || trim(summary) || chr(10) AS head FROM root),
parts AS (SELECT parent_path, row_number() OVER (PARTITION BY parent_path ORDER BY path) AS n, '  - ' || regexp_extract(path, '[^/]*$') || ': ' || trim(coalesce(l0, summary)) || chr(10) AS line FROM summed),
fits AS (SELECT question, n, line, strlen(head) + sum(strlen(line)) OVER (PARTITION BY question ORDER BY n) AS after FROM heads JOIN parts ON parent_path = root WHERE n <= 6)
SELECT question, root, head || coalesce((SELECT string_agg(line, '' ORDER BY n) FROM fits f WHERE f.question = h.question AND after <= 200), '') AS overview FROM heads h""")
def _(spark, sf):
    f = views.files(spark, sf)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    source = F.concat(F.lit("/corpus/"), part(3))
    ups = [(F.lit("/corpus"), F.lit("/")), (source, F.lit("/corpus")), (F.col("parent_path"), source)]
    dirs = reduce(DataFrame.unionByName, [f.groupBy(a.alias("path"), b.alias("parent_path")).agg(F.count("*").alias("n")) for a, b in ups])
    deep = F.col("path").like("/corpus/%/%")
    dirs = dirs.where((F.col("path") == "/corpus") | (deep & ~F.col("path").like("%/fr")) | (~deep & F.col("path").like("%0")))
    text_ = F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" files – "), "path", F.lit(" "))
    summed = dirs.select("path", "parent_path", F.lit("dir").alias("kind"), text_.alias("summary"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("é"), F.col("n").cast("string"))).alias("summary_l0"))
    asked = [F.concat(F.lit("l:"), "parent_path"), F.concat(F.lit("s:"), part(3)), F.lit("all")]
    hits = reduce(DataFrame.unionByName, [f.select(q.alias("question"), F.col("path").alias("entry_path"), F.col("doc_id").alias("place")) for q in asked])
    return overview.overviews(overview.common_ancestors(hits), summed, budget=200)
