"""Queries of classification, over parts as files of a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import classify
from tessella.plans.registry import query
from tessella.sources import ignores, views

#: Names that parts are given in turn.
_NAMES = ("Makefile", "a.PY.log", ".env.local", "key.pem", "x.tar.gz", "p.png", "Cargo.lock", "package.json", "noext", "n.ipynb", "t.unknown7", "README", "b.pdf")
_TREE = ("node_modules", "target", "dist", "src", "build", ".venv", "vendor")
_PARTS = f"""parts AS (SELECT p_partkey AS id, '/r/' || split_part(p_brand, '#', 2) || '/' || {list(_TREE)!r}[p_partkey % {len(_TREE)} + 1] AS dir, {list(_NAMES)!r}[p_partkey % {len(_NAMES)} + 1] AS name FROM part)"""


def _parts(spark, sf):
    turn = lambda of: F.element_at(F.array(*map(F.lit, of)), (F.col("p_partkey") % len(of) + 1).cast("int"))
    up = F.concat(F.lit("/r/"), F.split_part("p_brand", F.lit("#"), F.lit(2)), F.lit("/"), turn(_TREE))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), up.alias("dir"), F.concat(up, F.lit("/"), turn(_NAMES)).alias("path"))


#: Names, and what their files are: each stands for a rule or an extension.
_CATEGORIES = {
    "code": "Makefile Dockerfile justfile package.json n.ipynb main.rs main.go A.java a.c a.h a.cpp a.cc a.hpp a.cs a.rb a.php a.py a.js a.mjs a.jsx a.ts a.tsx a.kt a.swift a.scala a.lua a.sh a.BAT a.sql a.xml a.html a.css a.vue a.proto a.json a.md a.txt a.rst a.tex a.pl a.r a.ex a.hs a.zig a.dart",
    "documents": "README LICENSE b.pdf b.doc b.docx b.odt b.ods b.odp b.xls b.xlsx b.ppt b.pptx b.epub b.adoc",
    "config": ".gitignore .editorconfig c.toml c.yaml c.yml c.ini c.conf c.properties c.plist c.tf",
    "lockfile": "Cargo.lock go.sum package-lock.json yarn.lock d.lock",
    "data": "e.csv e.tsv e.parquet e.sqlite e.jsonl e.npy e.h5 e.geojson",
    "archive": "x.tar.gz f.zip f.7z f.zst f.iso",
    "media": "p.png p.JPG p.svg p.webp p.mp3 p.flac p.mp4 p.mkv",
    "font": "g.ttf g.woff2",
    "logs": "a.PY.log",
    "sensitive": ".env .env.local key.pem h.p12 id_rsa .netrc prod.env",
    None: "noext t.unknown7 i.exe i.so i.jar .hidden",
}
_ALL = [n for names in _CATEGORIES.values() for n in names.split()]
_CASES = " ".join(f"WHEN name IN ({', '.join(map(repr, names.split()))}) THEN '{c}'" for c, names in _CATEGORIES.items() if c)


@query("src06_file_category", f"SELECT id, CASE {_CASES} END AS category FROM (SELECT p_partkey AS id, {_ALL!r}[p_partkey % {len(_ALL)} + 1] AS name FROM part)")
def _(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _ALL)), (F.col("p_partkey") % len(_ALL) + 1).cast("int"))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), classify.file_category(F.concat(F.lit("/r/"), name)).alias("category"))


@query("src05_directory_hints", f"""WITH {_PARTS}, d AS (SELECT DISTINCT dir FROM parts UNION SELECT DISTINCT regexp_extract(dir, '^(/r/[^/]*)', 1) FROM parts)
SELECT dir AS path, CASE WHEN ends_with(dir, '/node_modules') THEN 'Node.js dependencies' ELSE 'Python virtual environment' END AS label, 'build-artifact' AS category, 'skip' AS policy FROM d WHERE ends_with(dir, '/node_modules') OR ends_with(dir, '/.venv')""")
def _(spark, sf):
    p = _parts(spark, sf)
    dirs = p.select(F.col("dir").alias("path")).union(p.select(paths.parent("dir").alias("path"))).distinct()
    return classify.directory_hints(dirs, p.select("path", F.col("dir").alias("parent_path")))


@query("flt12_actionable", f"""WITH {_PARTS}, m AS (SELECT id // 3 AS cluster, dir || '/' || name AS path, name, dir FROM parts)
SELECT cluster, NOT (bool_and(coalesce(regexp_extract(name, '^.+\\.([^.]+)$', 1) IN {classify.ASSETS!r}, false)) OR bool_or({' OR '.join(f"contains(path, '{g}')" for g in classify.GENERATED)})) AS actionable,
bool_and(name IN {list(classify.MANIFESTS)!r}) AS siblings, min(name) = max(name) AS same_name, min(dir) = max(dir) AS same_parent FROM m GROUP BY cluster""")
def _(spark, sf):
    return classify.actionable(_parts(spark, sf).select(F.floor(F.col("id") / 3).alias("cluster"), "path"))


#: Ignore files over the corpus: nested ones of each kind, with negation, and the lines of each.
_IGNORES = {
    "/corpus/.gitignore": "# all of two languages\n**/de/\nfr\n!fr\n*7.txt\n/src2/en/doc[0-4]*.txt\nbroken[\n",
    "/corpus/src1/.gitignore": "!doc*7.txt\nen/doc?.txt\n",
    "/corpus/src1/.ignore": "*1.txt\n!en/doc11.txt\n",
    "/corpus/src3/.ignore": "*\n!*/\n!*5.txt\n",
    "/corpus/src3/.tessellaignore": "!doc*9.txt\n",
    "/corpus/src4/en/.tessellaignore": "*\n",
}


@query("src01_kept", f"""WITH {views.FILES}, p AS (SELECT path, split_part(path, '/', 3) AS s, split_part(path, '/', 4) AS l, split_part(path, '/', 5) AS n FROM files),
git AS (SELECT *, CASE WHEN s = 'src1' AND l = 'en' AND regexp_full_match(n, 'doc.[.]txt') THEN true WHEN s = 'src1' AND ends_with(n, '7.txt') THEN false
  WHEN s = 'src2' AND l = 'en' AND regexp_full_match(n, 'doc[0-4].*[.]txt') THEN true WHEN ends_with(n, '7.txt') THEN true END AS g,
  CASE WHEN s = 'src1' THEN CASE WHEN l = 'en' AND n = 'doc11.txt' THEN false WHEN ends_with(n, '1.txt') THEN true END WHEN s = 'src3' THEN NOT ends_with(n, '5.txt') END AS i,
  CASE WHEN s = 'src3' AND ends_with(n, '9.txt') THEN false WHEN s = 'src4' AND l = 'en' THEN true END AS o FROM p)
SELECT path FROM git WHERE l <> 'de' AND NOT coalesce(o, i, g, false)""")
def _(spark, sf):
    told = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in _IGNORES.items()], "path string, content binary")
    return ignores.kept(views.files(spark, sf).select("path"), ignores.rules(told))
