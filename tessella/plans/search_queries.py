"""Queries of the retrieval operators, over documents as chunks and over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import paths, predicates, text
from tessella.operators import chunking, evaluation, retrieve, search
from tessella.plans.registry import query
from tessella.sources import views
from tessella.sources.views import FILES, NOW

TERMS = ["insh", "therth", "erthe"]
ASKED = 7

_WORDS = rf"""tokens AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents)"""
_BM25 = f"""{_WORDS},
lengths AS (SELECT id, len(w) AS length FROM tokens),
hits AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tokens) WHERE term IN ('insh', 'therth', 'erthe') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
parts AS (SELECT id, tf, length, (SELECT avg(length) FROM lengths) AS mean, ln(((SELECT count(*) FROM lengths) - df + 0.5) / (df + 0.5)) AS idf FROM hits JOIN df USING (term) JOIN lengths USING (id)),
sparse AS (SELECT id, sum((CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM parts GROUP BY id ORDER BY round(score, 9) DESC, id LIMIT 100)"""
_DENSE = f"""q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {ASKED}),
dense AS (SELECT vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))) AS score FROM embeddings, q ORDER BY round(score, 9) DESC, id LIMIT 100)"""
_FUSED = f"""{_BM25}, {_DENSE},
ranks AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS r FROM sparse UNION ALL SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 FROM dense),
fused AS (SELECT id, sum(1.0 / (r + 61)) AS score FROM ranks GROUP BY id ORDER BY round(score, 12) DESC, id LIMIT 100)"""


def sparse(spark, sf):
    chunks = views.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.match(chunks, " ".join(TERMS), ("text",), phrased=False)


def dense(spark, sf):
    v = views.table(spark, sf, "embeddings")
    asked = [float(x) for x in v.where(F.col("vec_id") == ASKED).first()["embedding"]]
    return search.cosine_top(v, asked, search.ARM, "vec_id")


def fused(spark, sf):
    return search.rrf([search.ranked(sparse(spark, sf)), search.ranked(dense(spark, sf))])


@query("chk01_windows", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 800) / 700), 0) AS BIGINT) + 1)) AS seq FROM w WHERE len(w) > 0)
SELECT doc_id, seq, list_aggregate(w[seq * 700 + 1:seq * 700 + 800], 'string_agg', ' ') AS chunk FROM s""")
def _(spark, sf):
    return chunking.windows(views.table(spark, sf, "documents").select("doc_id", "text"))


@query("ret02_bm25", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM sparse")
def _(spark, sf):
    return sparse(spark, sf).withColumn("score", F.round("score", 6))


@query("ret03_cosine", f"WITH {_DENSE} SELECT id, round(score, 6) AS score FROM dense")
def _(spark, sf):
    return dense(spark, sf).withColumn("score", F.round("score", 6))


@query("ret06_rrf", f"WITH {_FUSED} SELECT id, round(score, 9) AS score FROM fused")
def _(spark, sf):
    return fused(spark, sf).withColumn("score", F.round("score", 9))


@query("ret02_index", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM sparse")
def _(spark, sf):
    index, lengths = search.postings(views.table(spark, sf, "documents"), "doc_id")
    return search.bm25(index, lengths, TERMS).withColumn("score", F.round("score", 6))


@query("ret02_postings", f"WITH {_WORDS} SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tokens) GROUP BY ALL")
def _(spark, sf):
    return search.postings(views.table(spark, sf, "documents"), "doc_id")[0]


_HITS = f"""hits AS (SELECT doc_id AS chunk_id, path AS entry_path, modified_s, 1.0 / (1 + doc_id % 17) AS score FROM files)"""


def _hits(spark, sf):
    f = views.files(spark, sf)
    return f.select(F.col("doc_id").alias("chunk_id"), F.col("path").alias("entry_path"), "modified_s", (1.0 / (1 + F.col("doc_id") % 17)).alias("score"), "text")


def _weights(spark):
    rows = [("dir", "/corpus/src1", 3.0), ("dir", "/corpus/src1/en", 0.5), ("dir", "/corpus", 1.1), ("category", "fr", 4.0), ("file", "/corpus/src1/en/doc1.txt", 2.5)]
    return spark.createDataFrame(rows, "target_kind string, target string, weight double")


_WEIGHTS = """weights AS (SELECT * FROM (VALUES ('dir', '/corpus/src1', 3.0), ('dir', '/corpus/src1/en', 0.5), ('dir', '/corpus', 1.1), ('category', 'fr', 4.0), ('file', '/corpus/src1/en/doc1.txt', 2.5)) t(target_kind, target, weight))"""


@query("ret10_weights", f"""WITH {FILES}, {_WEIGHTS},
d AS (SELECT f.path, w.weight, row_number() OVER (PARTITION BY f.path ORDER BY length(w.target) DESC) AS n FROM files f JOIN weights w ON w.target_kind = 'dir' AND starts_with(f.path, w.target || '/'))
SELECT f.path, CAST(coalesce(own.weight, d.weight, cat.weight, 1.0) AS DOUBLE) AS weight FROM files f LEFT JOIN weights own ON own.target_kind = 'file' AND own.target = f.path
LEFT JOIN d ON d.path = f.path AND d.n = 1 LEFT JOIN weights cat ON cat.target_kind = 'category' AND cat.target = f.hint_cat""")
def _(spark, sf):
    f = views.files(spark, sf)
    cls = f.where("hint_cat IS NOT NULL").select("path", F.col("hint_cat").alias("category"), F.lit("auto").alias("source"))
    return search.weights_for(f, _weights(spark), cls)


@query("ret13_recency", f"""WITH {FILES} SELECT path, CAST(CASE WHEN a > 90 THEN 1.0 WHEN a <= 7 THEN 2.0 WHEN a <= 30 THEN 1.5 ELSE 1.2 END AS DOUBLE) AS factor FROM (SELECT path, floor(({NOW - 320 * 86400} - modified_s) / 86400) AS a FROM files)""")
def _(spark, sf):
    return views.files(spark, sf).select("path", search.recency_factor(F.col("modified_s"), NOW - 320 * 86400).alias("factor"))


@query("ret11_archive_penalty", "SELECT p_partkey, CAST(CASE WHEN list_has_any(string_split(lower('/x/' || split_part(p_type, ' ', 1) || '/' || CASE WHEN p_size % 7 = 0 THEN 'Archive' ELSE 'src' END || '/f.rs'), '/'), ['archive', 'archived', 'historical', 'deprecated', 'old']) THEN 0.15 ELSE 1.0 END AS DOUBLE) AS factor FROM part")
def _(spark, sf):
    p = F.concat(F.lit("/x/"), F.substring_index("p_type", " ", 1), F.lit("/"), F.when(F.col("p_size") % 7 == 0, "Archive").otherwise("src"), F.lit("/f.rs"))
    return views.table(spark, sf, "part").select("p_partkey", search.archive_factor(p).alias("factor"))


@query("ret16_cap_per_file", """WITH r AS (SELECT page_id AS rank, '/' || substr(regexp_extract(url, '://([^/]+)', 1), 1, 3) AS entry_path FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY entry_path ORDER BY rank) AS n, min(rank) OVER (PARTITION BY entry_path) AS f FROM r)
SELECT rank, entry_path, row_number() OVER (ORDER BY n > 2, f, n) - 1 AS place FROM n""")
def _(spark, sf):
    host = F.concat(F.lit("/"), F.substring(F.regexp_extract("url", "://([^/]+)", 1), 1, 3))
    return search.cap_per_file(views.table(spark, sf, "pages").select(F.col("page_id").alias("rank"), host.alias("entry_path")), 2)


@query("ret14_mmr")
def _(spark, sf):
    v = views.table(spark, sf, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("chunk_id"), (1.0 / (1 + F.col("vec_id") % 101)).alias("score"), "embedding")
    top = v.withColumn("n", F.row_number().over(_by_query())).where("n <= 100").drop("n")
    return search.mmr(top)


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")


@query("ret23_confidence", """WITH p AS (SELECT conv_id AS query, 1.0 / (59 + turn + conv_id % 9) AS s FROM conversations),
a AS (SELECT query, list_reverse_sort(list(s)) AS s FROM p GROUP BY query),
b AS (SELECT query, s[1] AS top, len(s) AS n, s[len(s) // 2 + 1] AS med, len(list_filter(s, lambda x: x >= 1.0 / 70)) AS strong FROM a)
SELECT query, CASE WHEN strong = 0 THEN 'low' WHEN n = 1 THEN CASE WHEN top >= 1.0 / 61 THEN 'medium' ELSE 'low' END
WHEN top >= 1.0 / 61 AND strong >= 3 AND 2 * n >= 4 AND top / med <= 3 THEN 'high' ELSE 'medium' END AS confidence FROM b""")
def _(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("query"), (1.0 / (59 + F.col("turn") + F.col("conv_id") % 9)).alias("score"))
    return search.confidence(c, top_k=4, embeddings=False)


@query("ret25_packing", """WITH h AS (SELECT conv_id AS query, turn AS rank, turn AS chunk_id, strlen('[' || turn || '] /conv — ' || role || chr(10)) AS head, strlen('[' || turn || '] /conv — ' || role || chr(10) || text || chr(10) || chr(10)) AS bytes FROM conversations),
b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT query, rank AS n, chunk_id, CAST(least(bytes, 600 - before) AS BIGINT) AS bytes, bytes > 600 - before AS cut FROM b WHERE before < 600 AND (bytes <= 600 - before OR 600 - before > head + 40)""")
def _(spark, sf):
    c = views.table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"])
    return search.packed(c.select(F.col("conv_id").alias("query"), F.col("turn").alias("rank"), F.col("turn").alias("chunk_id"), F.lit("/conv").alias("entry_path"), F.col("role").alias("heading"), "text"), 600)


@query("flt03_path_search", f"WITH {FILES} SELECT path FROM files WHERE contains(lower(path), 'src1/d') ORDER BY length(path), path LIMIT 50")
def _(spark, sf):
    f = views.files(spark, sf)
    return f.where(F.contains(F.lower("path"), F.lit("src1/d"))).select("path").orderBy(F.length("path"), "path").limit(50)


@query("flt04_stubs", "SELECT doc_id FROM documents WHERE NOT (length(text) < 80 AND regexp_matches(text, '(?i)^(File|Image|Media file): '))")
def _(spark, sf):
    return search.without_stubs(views.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id")


@query("flt16_extensions", "SELECT regexp_extract(lower(url), '\\.([^./]+)$', 1) AS ext, count(*) AS n FROM pages GROUP BY 1".replace("\\\\", "\\"))
def _(spark, sf):
    return views.table(spark, sf, "pages").groupBy(F.regexp_extract(F.lower("url"), r"\.([^./]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


_GOLD = """gold AS (SELECT DISTINCT b.item_id AS question, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ranking AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY (doc_id * 7919 + question) % 997, doc_id) - 1 AS place FROM
  (SELECT question, doc_id FROM gold UNION SELECT g.question, d.doc_id FROM (SELECT DISTINCT question FROM gold) g JOIN documents d ON d.doc_id % 100 = g.question % 100))"""


@query("evl02_scores", f"""WITH {_GOLD}, r AS (SELECT ranking.question, place, g.doc_id IS NOT NULL AS rel FROM ranking LEFT JOIN gold g ON g.question = ranking.question AND g.doc_id = ranking.doc_id WHERE place < 10),
e AS (SELECT question, count(*) AS expected FROM gold GROUP BY question),
s AS (SELECT question, count(*) AS n, count(CASE WHEN rel THEN 1 END) AS m, min(CASE WHEN rel THEN place END) + 1 AS first_rank, coalesce(sum(CASE WHEN rel THEN 1 / log2(place + 2) END), 0) AS dcg FROM r GROUP BY question)
SELECT question, m > 0 AS hit, first_rank, round(coalesce(1.0 / first_rank, 0), 6) AS rr, round(m / n, 6) AS precision, round(m / expected, 6) AS recall,
round(CASE WHEN m > 0 THEN dcg / list_sum(list_transform(range(0, m), lambda i: 1 / log2(i + 2))) ELSE 0 END, 6) AS ndcg FROM s JOIN e USING (question)""")
def _(spark, sf):
    gold, ranking = _gold(spark, sf)
    s = evaluation.scores(ranking, gold, 10)
    return s.select("question", "hit", "first_rank", *[F.round(c, 6).alias(c) for c in ("rr", "precision", "recall", "ndcg")])


def _gold(spark, sf):
    d, b = views.table(spark, sf, "documents").select("doc_id", "text"), views.table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("passage"))
    gold = evaluation.containing(d, b, "doc_id").withColumnRenamed("doc_id", "item").distinct()
    asked = gold.select("question").distinct()
    more = d.select(F.col("doc_id").alias("item"), (F.col("doc_id") % 100).alias("m")).join(asked.withColumn("m", F.col("question") % 100), "m").select("question", "item")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("question").orderBy((F.col("item") * 7919 + F.col("question")) % 997, "item")) - 1
    return gold, gold.select("question", "item").union(more).distinct().withColumn("place", rank)


@query("strf6_ancestors", f"WITH {FILES} SELECT path, unnest(['/corpus', regexp_extract(path, '^(/[^/]*/[^/]*)', 1), parent_path]) AS ancestor FROM files")
def _(spark, sf):
    return views.files(spark, sf).select("path", F.explode(paths.ancestors("path")).alias("ancestor"))


_ASKED = """asked AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'Where is the ' || p_name || ' computed' WHEN 1 THEN 'which file has the ' || p_name
  WHEN 2 THEN 'where is ' || p_name || ' in (parser.RS)?' WHEN 3 THEN 'explain ' || replace(p_name, ' ', '_') WHEN 4 THEN 'the ' || p_name || ' Function'
  WHEN 5 THEN 'where is the ' || p_name || ' page.html' WHEN 6 THEN 'who called ' || p_name ELSE p_name END AS question FROM part)"""


def _asked(spark, sf):
    name, k = F.col("p_name"), F.col("p_partkey") % 8
    cases = (
        F.concat(F.lit("Where is the "), name, F.lit(" computed")), F.concat(F.lit("which file has the "), name), F.concat(F.lit("where is "), name, F.lit(" in (parser.RS)?")),
        F.concat(F.lit("explain "), F.replace(name, F.lit(" "), F.lit("_"))), F.concat(F.lit("the "), name, F.lit(" Function")), F.concat(F.lit("where is the "), name, F.lit(" page.html")),
        F.concat(F.lit("who called "), name), name,
    )
    question = F.element_at(F.array(*cases), (k + 1).cast("int"))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), question.alias("question"))


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("flt09_code_intent", rf"""WITH {_ASKED}, q AS (SELECT id, question, lower(question) AS q FROM asked)
SELECT id, {_any("q", predicates.CODE_TERMS)} OR len(list_filter(regexp_split_to_array(question, '[^a-zA-Z0-9_]+'), lambda w: len(w) >= 4 AND contains(w, '_'))) > 0
  OR ({_any("q", predicates.LOCATORS)} AND ({_any("q", predicates.CODE_VERBS)}
    OR len(list_filter(list_transform(string_split(q, ' '), lambda w: regexp_extract(w, '\.([a-z]+)[^a-z0-9]*$', 1)), lambda e: e IN {predicates.CODE_EXTENSIONS!r})) > 0)) AS code FROM q""")
def _(spark, sf):
    return _asked(spark, sf).select("id", predicates.code_intent(F.col("question")).alias("code"))


@query("flt11_idioms", f"""WITH names AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS word, ['New', 'get_', 'test', 'len', '', 'value', 'as_str', 'reset_'][p_partkey % 8 + 1] AS head FROM part)
SELECT id, lower(n) IN {predicates.IDIOMS!r} OR {" OR ".join(f"starts_with(lower(n), '{b}')" for b in predicates.IDIOM_BEGINNINGS)} AS idiom
FROM (SELECT id, CASE WHEN ends_with(head, '_') OR head = '' THEN head || word ELSE head END AS n FROM names)""")
def _(spark, sf):
    head = F.element_at(F.array(*map(F.lit, ("New", "get_", "test", "len", "", "value", "as_str", "reset_"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.when(F.endswith(head, F.lit("_")) | (head == ""), F.concat(head, F.split("p_name", " ")[0])).otherwise(head)
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), predicates.idiom(name).alias("idiom"))
