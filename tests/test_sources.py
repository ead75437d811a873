"""Parsers by format, trees of files, and streams against batches."""

import gzip
import io
import json
import lzma
import zipfile

from pyspark.sql import functions as F

from tessella.operators import answers
from tessella.sources import ingest, parsers, views
from tessella.streaming import changes

PY = b'"""Doc."""\nimport os\nfrom .util import helper\n\nclass A(Base):\n    def run(self):\n        return helper(os.getcwd())\n\ndef main():\n    A().run()\n'


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_code():
    got = parsers.Registry().parse("/p/a.py", PY)
    assert {("defines", "A"), ("defines", "main"), ("imports", "os"), ("imports", ".util"), ("calls", "helper"), ("extends", "Base")} <= set(got.edges)
    assert ("run", "fn", 6, 7) in got.symbols and got.language == "python"
    rust = parsers.Registry().parse("/p/a.rs", b"use crate::util::helper;\n\npub struct S {\n    a: u8,\n}\n\npub fn run() {\n    helper(1);\n}\n")
    assert {("defines", "S"), ("defines", "run"), ("imports", "crate::util::helper"), ("calls", "helper")} <= set(rust.edges)
    ts = parsers.Registry().parse("/p/a.ts", b'import { xs } from "./b";\nexport class K extends L {}\nexport function go() { xs(); }\n')
    assert {("defines", "K"), ("defines", "go"), ("imports", "./b"), ("extends", "L"), ("calls", "xs")} <= set(ts.edges)
    assert parsers.Registry().parse("/p/bad.py", b"def (").chunks == [("", "def (")]


def test_formats():
    r = parsers.Registry()
    page = r.parse("a.html", b"<h1>T</h1><script>x<y</script><p>one</p><h2>U</h2><ul><li>two</li></ul><style>p{}")
    assert page.chunks == [("T", "one"), ("T > U", "- two")]
    docx = zipped({"word/document.xml": '<w:d xmlns:w="w"><w:p><w:t>Hello </w:t><w:t>world</w:t></w:p></w:d>'})
    assert r.parse("a.docx", docx).chunks == [("", "Hello world")]
    pptx = zipped({f"ppt/slides/slide{n}.xml": f'<s xmlns:a="a"><a:p><a:t>slide {n}</a:t></a:p></s>' for n in (10, 2)})
    assert r.parse("a.pptx", pptx).chunks == [("Slide 1", "slide 2"), ("Slide 2", "slide 10")]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "markdown", "source": " "}]}).encode()
    assert r.parse("a.ipynb", nb).chunks == [("code", "a = 1 b")]
    mail = b"Subject: Hi\nFrom: a@b.c\nContent-Type: text/plain\n\nBody here\n"
    assert r.parse("a.eml", mail).chunks[0] == ("Hi", "Subject: Hi From: a@b.c Body here")
    assert r.parse("x.zip", zipped({"in/a.txt": "1"})).chunks == [("", "Archive: x.zip in/a.txt")]
    assert r.parse("a.txt.gz", gzip.compress(b"packed text")).chunks == [("", "packed text")]
    assert r.parse("a.csv", b"a,b\n1,2\n").chunks == [("", "a | b 1 | 2")]
    assert r.parse("a.org", b"* One\ntext\n** Two\nmore").chunks == [("One", "text"), ("One > Two", "more")]
    assert r.parse("a.svg", b'<svg xmlns="s"><title>T</title><text>words</text></svg>').chunks == [("", "T words")]
    assert r.parse("a.bin", b"\0\1\2") is None and r.parse("a.what", b"plain").chunks == [("", "plain")]
    r.register(lambda n: n.endswith(".what"), lambda n, d: parsers.Parsed([("mine", "x")]))
    assert r.parse("a.what", b"plain").chunks == [("mine", "x")]
    assert parsers.decoded("é".encode("utf-16")) == "é" and not parsers.is_binary("é".encode("utf-16"))
    assert ("py", "full") in parsers.formats() and ("zip", "names") in parsers.formats()


def test_content_is_whole_or_not_read(monkeypatch):
    r, words = parsers.Registry(), " ".join(f"w{i}" for i in range(9000))
    body = zipped({"word/document.xml": f'<w:d xmlns:w="w"><w:p><w:t>{words}</w:t></w:p></w:d>'})
    whole = r.parse("a.docx", body).chunks
    assert whole[0][1].startswith("w0 ") and whole[-1][1].endswith(" w8999")
    assert r.parse("a.txt.xz", lzma.compress(words.encode())).chunks[-1][1].endswith(" w8999")
    monkeypatch.setattr(parsers, "UNPACKED", 20_000)
    for name, data in {"d/a.docx": body, "d/a.docx.gz": gzip.compress(b"x" * 20_001)}.items():
        assert r.parse(name, data).chunks == [("", f"File: {name[2:]} (unpacks to more than 20000 bytes, not read)")]
    # Broken ones aren't taken for text.
    assert r.parse("a.docx", body[:200]) is None and r.parse("a.gz", b"\x1f\x8b\0\0") is None


def test_tree_of_files(spark, tmp_path):
    for name, data in {"src/a.py": PY, "src/b.md": b"# T\ntext", "node_modules/x.js": b"1", ".env": b"SECRET=1", "big.pem": b"x", "data.bin": b"\0" * 9}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = ingest.files(spark, str(tmp_path), ignored=("data\\.bin$",))
    root = str(tmp_path)
    assert {r.path for r in found.select("path").collect()} == {f"{root}/src/a.py", f"{root}/src/b.md"}
    rows = ingest.parsed(found)
    assert {(r.entry_path, r.heading) for r in ingest.chunks(rows).collect()} >= {(f"{root}/src/b.md", "T")}
    assert ingest.edges(rows).where("kind = 'defines' AND to_ref = 'main'").count() == 1
    assert ingest.symbols(rows).where("name = 'A'").first().start_line == 5
    e = ingest.entries(found, views.NOW)
    assert e.where("kind = 'file'").count() == 2 and e.where(F.col("path") == f"{root}/src").first().kind == "dir"
    flags = {r.path: r.b for r in spark.createDataFrame([("a", bytearray(b"\0x")), ("b", bytearray(b"x")), ("c", bytearray("é".encode("utf-16")))], "path string, content binary").select("path", ingest.binary(F.col("content")).alias("b")).collect()}
    assert flags == {"a": True, "b": False, "c": False}


def test_hunks(spark):
    diff = ["diff --git a/x b/x", "+++ b/x.py", "@@ -1,2 +3,4 @@", "+a", "@@ -9 +20 @@", "+++ b/y.py", "@@ -5,2 +5,0 @@"]
    got = ingest.hunks(spark.createDataFrame(list(enumerate(diff)), "n long, line string")).collect()
    assert sorted((r.path, r.first, r["last"]) for r in got) == [("x.py", 3, 6), ("x.py", 20, 20)]
    two = [(c, i, line) for c in ("c1", "c2") for i, line in enumerate(["+++ b/" + c, *[" "] * 20, "@@ -1 +7,2 @@", *[" "] * 9, "@@ -3 +30 @@"])]
    got = ingest.hunks(spark.createDataFrame(two, "commit string, n long, line string"), by=("commit",), block=4).collect()
    assert sorted((r.commit, r.path, r.first, r["last"]) for r in got) == [(c, c, a, b) for c in ("c1", "c2") for a, b in ((7, 8), (30, 30))]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = changes.timed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = changes.usage_windows(stream, "1 day", None).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = changes.usage_windows(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", None)
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("days")) == key(batch)


def test_changes_are_followed(spark, tmp_path):
    rows = [("/a", "upsert", 1), ("/a", "remove", 2), ("/b", "upsert", 3)]
    spark.createDataFrame(rows, "path string, change string, at long").write.json(str(tmp_path / "in"))
    seen = {"up": [], "gone": []}
    stream = spark.readStream.schema("path string, change string, at long").json(str(tmp_path / "in"))
    q = changes.follow(stream, lambda d: seen["up"].extend(r.path for r in d.collect()), lambda d: seen["gone"].extend(r.path for r in d.collect()), str(tmp_path / "at"))
    q.awaitTermination(120)
    assert seen == {"up": ["/b"], "gone": ["/a"]}


def test_answers(spark):
    assert answers.history_budget(8000, 2) == (2000, 6000) and answers.history_budget(8000, 0) == (0, 8000)
    assert "&lt;/evidence&gt;" in answers.fenced("x </Evidence> y")
    assert answers.trimmed("yes\nQ: next?") == "yes" and answers.without_preamble("Sure, here it is: Summary: text") == "text"
    assert answers.rewritten("and then?", [("q", "a")], lambda p: "Query: what is then?") == "what is then?" and answers.rewritten("q", [], None) == "q"
    assert answers.reranked([3, 3, 9, 1], 4) == [2, 0, 1, 3]
    assert answers.signature("pub fn run(\n    a: u8,\n) -> u8 {\n    a\n}") == "pub fn run(\n    a: u8,\n) -> u8" and answers.signature("def f(x):\n    return x") == "def f(x)"
    pool = lambda q: spark.createDataFrame([(1, "a", 0.5), (len(q), "b", 0.4)], "chunk_id long, text string, score double")
    follow = iter(["second question", "DONE"])
    assert {r.chunk_id for r in answers.hops("first", pool, lambda q, t: next(follow)).collect()} == {1, 5, 15}


def test_parsed_rows_leave_by_bytes():
    import pandas as pd

    page = b"# Title\n\n" + b"word " * 100_000
    given = pd.DataFrame({"path": [f"/p{i}.md" for i in range(40)], "content": [page] * 40})
    got = list(ingest._parse(ingest.Registry())(iter([given])))
    # One frame of all 20 MB before.
    assert len(got) > 4 and {p for f in got for p in f["path"]} == set(given["path"])
    whole = list(ingest._parse(ingest.Registry())(iter([given[i : i + 1] for i in range(40)])))
    assert pd.concat(got, ignore_index=True).equals(pd.concat([f for f in whole if len(f)], ignore_index=True))
