"""The queries of the subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe_codec, collocations, licenses, line_dedup, merkle, nearest, ngram_join, packing, quality_rules, secrets, substring_dedup, token_files, toxicity
from tessella.llm.common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL["op4_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, s, list_aggregate(w[s:s + 49], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)),
least_ids AS (SELECT g, min(doc_id) AS lo FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN least_ids USING (g) WHERE lo < doc_id),
places AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, len(w) AS n, CASE WHEN ps IS NULL THEN w ELSE
    list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(ps, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS k
  FROM words LEFT JOIN places ON words.doc_id = places.doc_id)
SELECT doc_id, n AS n_words, n - len(k) AS n_removed, sha256(coalesce(list_aggregate(k, 'string_agg', ' '), '')) AS kept_sha256 FROM kept
"""


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path, digest=True)


@_query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


@_query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


ORACLE_SQL["op8_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, list_aggregate(w[s:s + 3], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
meets AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM meets JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * both_n >= 85 * (s.n + t.n - both_n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@_query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    # The text itself need not come back from scoring.
    bare = docs.select("doc_id", "text", toxicity.held_out().alias("held_out"))
    return toxicity.score(bare, machine).select("doc_id", "held_out", "score", "predicted")


@_query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), shared_path(spark, "line-index"), digest=True)


ORACLE_SQL["op11_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
shared AS (SELECT k, max(doc_id) AS last_id FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(last_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last_id IS NULL), '')) AS kept_sha256
FROM (SELECT doc_id, i, line, CASE WHEN last_id <> doc_id THEN last_id END AS last_id FROM lines LEFT JOIN shared USING (k)) GROUP BY doc_id
"""


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_tampered(table(spark, sf_dir, "documents"))


#: Trees 0, 1, ... are the sources in order, tree -1 is the one over their roots. crc32 goes bit by bit: -1 is a shift.
ORACLE_SQL["op12_merkle_manifest"] = r"""
WITH RECURSIVE tampered AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 2 = 0
    THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
heads AS (
  SELECT doc_id, source, text, changed, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM tampered),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(head, coalesce(strlen(changed) || ':' || changed, '-'))) AS other FROM heads),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
levels AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, size FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (size + 2) // 3 FROM levels WHERE size > 1 GROUP BY tree, lvl, pos // 3, size),
subroots AS (SELECT tree, lvl, h FROM levels WHERE size = 1),
tops AS (
  SELECT 0 AS lvl, tree AS pos, h, (SELECT count(*) FROM subroots) AS size FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (size + 2) // 3 FROM tops WHERE size > 1 GROUP BY lvl, pos // 3, size),
nodes AS (SELECT tree, lvl, pos, h, size FROM levels UNION ALL SELECT -1, lvl, pos, h, size FROM tops),
sides AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.size > 1 GROUP BY a.tree, a.lvl, a.pos),
inside AS (
  SELECT doc_id, leaf, tree, 0 AS lvl, pos, other AS h, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, leaf, i.tree, i.lvl + 1, i.pos // 3, sha256(s.l || i.h || s.r), proof || s.l || s.r FROM inside i JOIN sides s ON s.tree = i.tree AND s.lvl = i.lvl AND s.pos = i.pos),
outside AS (
  SELECT doc_id, leaf, s.h AS subroot, 0 AS lvl, i.tree AS pos, i.h, proof FROM inside i JOIN subroots s ON s.tree = i.tree AND s.lvl = i.lvl
  UNION ALL
  SELECT doc_id, leaf, subroot, o.lvl + 1, o.pos // 3, sha256(s.l || o.h || s.r), proof || s.l || s.r FROM outside o JOIN sides s ON s.tree = -1 AND s.lvl = o.lvl AND s.pos = o.pos)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM outside o JOIN tops t ON t.size = 1 AND t.lvl = o.lvl
"""


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM pieces),
grams AS (SELECT lang, k AS words, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT lang, w, s, unnest(range(1, least(4, len(w) - s + 1) + 1)) AS k FROM places)),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
longs AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score
  FROM (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k FROM longs)) c
  JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, words - m + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS m FROM longs))),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longest g ON g.lang = lowest.lang AND g.phrase = lowest.phrase WHERE g.longer IS NULL OR 100 * g.longer < 80 * lowest.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
