"""Documents as ordered lines, by literal cases."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tessella.operators import export

NODES = "path string, parent_path string, kind string, depth long, summary string, summary_l0 string, model string, generated_at long, source_hash string"


def nodes(spark):
    given = [
        ("/r", "/", "dir", 1, "Root.", None, "m", 0, "h0"), ("/r/a", "/r", "dir", 2, "A dir.", "A", "m", 60, "h1"), ("/r/a b.txt", "/r", "file", 2, 'Has <x> & "q". More.', None, "m", 1, "abcdefghij"), ("/r/a/z.txt", "/r/a", "file", 3, None, None, None, None, None),
        ("/r/a/sub", "/r/a", "dir", 3, "S.", None, "m", 1, "h2"), ("/r/a/sub/k.txt", "/r/a/sub", "file", 4, "K.", None, "m", 1, "h3"), ("/rr/no.txt", "/rr", "file", 2, "No.", None, "m", 1, "h"),
    ]
    return spark.createDataFrame(given, NODES)


def text(lines):
    return "\n".join(r.line for r in lines.orderBy("place").collect())


def test_tree_documents(spark):
    md = text(export.tree_document(nodes(spark), "/r"))
    heads = [line for line in md.split("\n") if line.startswith("#")]
    assert heads == ["# Index: /r", "## 📁 r", "### 📄 a b.txt", "### 📁 a", "#### 📄 z.txt", "#### 📁 sub", "##### 📄 k.txt"]
    body = md.split("\n", 4)[4]
    assert md.split("\n")[2] == f"> ~{-(-(len(body) + 1) // 4)} tokens (estimate, chars/4)"
    assert '**Abstract:** Has <x> & "q".\n' in md and "No." not in md
    doc = ET.fromstring(text(export.tree_document(nodes(spark), "/r", "xml", "now")))
    assert doc.attrib["root"] == "/r" and doc.attrib["generated_at"] == "now" and int(doc.attrib["approx_tokens"]) > 100
    (root,) = doc
    assert (root.tag, root.attrib["name"], root.find("children").attrib["count"]) == ("directory", "r", "2")
    assert [n.attrib["path"] for n in doc.iter() if "path" in n.attrib] == ["/r", "/r/a b.txt", "/r/a", "/r/a/z.txt", "/r/a/sub", "/r/a/sub/k.txt"]
    assert root.find("children/file/summary").text == 'Has <x> & "q". More.'
    assert len(text(export.tree_document(nodes(spark), "/r", "json", most=1)).split("\n")) == 3
    assert text(export.tree_document(nodes(spark).where("false"), "/r", "xml")).count("\n") == 1


def test_pack_bundle(spark):
    n = nodes(spark).where("path like '/r/%'").withColumns({"pack_id": F.lit("p"), "is_root": F.col("depth") == 2})
    n = n.unionByName(n.where("path = '/r/a b.txt'").withColumn("path", F.lit("/s/a b.txt")))
    events = spark.createDataFrame([("p", 2, "path_added", "/r", 86400), ("p", 1, "created", None, 0)], "pack_id string, id long, event string, detail string, at long")
    packs = spark.createDataFrame([("p", "Pack"), ("q", "Quiet")], "id string, name string")
    b = export.pack_bundle(n, events, packs)
    one = lambda pack, name: text(b.where((F.col("pack_id") == pack) & (F.col("name") == name)))
    assert one("p", "log.md") == "# Pack — changelog\n\n- **Creation** (1970-01-01T00:00:00Z): created\n- **Update** (1970-01-02T00:00:00Z): path_added — /r"
    assert one("q", "log.md") == "# Quiet — changelog\n\n(no recorded history)"
    index = one("p", "index.md").split("\n")
    assert index[:4] == ["# Pack", "", "A bundle of knowledge.", ""] and len(index) == 10 and "* [a b.txt](a-b-txt-abcdefgh-2.md) - Has <x> & \"q\"." in index
    assert one("p", "a-b-txt-abcdefgh.md").startswith('---\ntype: "file"\ntitle: "a b.txt"\ndescription: "Has <x> & \\"q\\"."\nresource: "/r/a b.txt (sha256:abcdefghij)"\ntimestamp: "1970-01-01T00:00:01Z"\n')
    assert one("p", "manifest.jsonl").count('"is_root":true') == 3


def test_sections(spark):
    w = spark.createDataFrame([("file", "/a|<b>", 2.0, 'say "x"'), ("dir", "/d", 0.125, None)], "target_kind string, target string, weight double, reason string")
    assert text(export.weight_lines(w)).split("\n")[-2:] == ["| /d | dir | 0.12 |  |", '| /a|<b> | file | 2.00 | say "x" |']
    assert ET.fromstring(text(export.weight_lines(w, "xml")))[1].text == 'say "x"'
    assert text(export.weight_lines(w, "json")).split("\n")[1] == '{"target": "/a|<b>", "kind": "file", "weight": 2.0000, "reason": "say \\"x\\""}'
    assert text(export.weight_lines(w.where("false"))) == ""
    g = spark.createDataFrame([("/x/a", "/y/b", 9), ("/x/a", "/y/c", 10)], "source string, target string, weight long")
    assert text(export.graph_lines(g, truncated=True)) == "\n## Call graph\n\n_(truncated — heaviest edges shown)_\n\n- a → c [10]\n- a → b [9]"
    assert [e.attrib["weight"] for e in ET.fromstring(text(export.graph_lines(g, "xml")))] == ["10", "9"]


def test_signatures(spark):
    given = [
        ("/// Doc.\n#[inline]\npub fn a(x: u8)\n  -> u8 {\n  x\n}", "pub fn a(x: u8)\n  -> u8 { … }"), ('def f(\n    x,\n):\n    """Doc."""\n    return x', "def f(\n    x,\n):"), ("const A = 1", "const A = 1"), ("\n".join(f"l{i}" for i in range(20)), "\n".join(f"l{i}" for i in range(8))), ("", ""), ("// only", ""),
    ]
    rows = spark.createDataFrame([(str(i), i, "h", t, "x") for i, (t, _) in enumerate(given)] + [("z", 0, "h", None, "x"), ("no", 0, "h", "t", None)], "entry_path string, seq int, heading string, text string, language string")
    assert [r.signature for r in export.signature_lines(rows).collect()] == [s for _, s in given] + [""]
    assert export.signature_lines(rows.where("entry_path = '0'"), docs=True).first().signature == "/// Doc.\n#[inline]\npub fn a(x: u8)\n  -> u8 { … }"


def test_reports(spark):
    answers = spark.createDataFrame([(2, "And why?", "Because."), (1, "What <is> it?", "It's & that."), (3, None, None)], "n int, question string, answer string")
    sources = spark.createDataFrame([(1, 2, "/b", None), (1, 1, "/a", "Top"), (9, 1, "/x", "")], "n int, rank int, path string, heading string")
    md = text(export.report_lines(answers, sources, generated_at="today"))
    assert md == "# Report\n\n_generated today · 3 queries_\n\n## Contents\n\n1. [What <is> it?](#1-what--is--it-)\n2. [And why?](#2-and-why-)\n3. [](#3-)\n\n## 1. What <is> it?\n\nIt's & that.\n\n**Sources:**\n\n- `/a` — Top\n- `/b`\n\n## 2. And why?\n\nBecause.\n\n\n## 3. \n\n\n"
    doc = ET.fromstring(text(export.report_lines(answers, sources, "xml")))
    assert [q.attrib["question"] for q in doc] == ["What <is> it?", "And why?", ""] and [s.attrib["path"] for s in doc.iter("source")] == ["/a", "/b"]
    assert ET.fromstring(text(export.report_lines(answers.where("false"), sources, "xml"))).attrib["queries"] == "0"


def test_savings(spark):
    cited = spark.createDataFrame([(1, "/a"), (1, "/a"), (1, "/b"), (2, "/a"), (3, None), (4, "/none")], "answer int, path string")
    served = spark.createDataFrame([(1, 100), (2, 2000), (3, 1), (4, 1)], "answer int, bytes long")
    entries = spark.createDataFrame([("/a", 2000), ("/b", 0)], "path string, size long")
    summaries = spark.createDataFrame([("/b", 8000)], "path string, byte_size long")
    r = {(x.answer, x.path): x for x in export.savings_lines(cited, served, entries, summaries).collect()}
    assert set(r) == {(1, "/a"), (1, "/b"), (1, None)}
    assert r[1, "/b"].line == "     7.8 KB  /b" and r[1, None].line == "  = 9.8 KB of source; served 100 B — 99% less (~2.5K tokens at ≈4 bytes/token)"


def test_iso(spark):
    got = spark.createDataFrame([(0,), (1_735_689_599,), (-1,), (951_782_400,)], "s long").select(export.iso("s").alias("t")).collect()
    assert [r.t for r in got] == ["1970-01-01T00:00:00Z", "2024-12-31T23:59:59Z", "1969-12-31T23:59:59Z", "2000-02-29T00:00:00Z"]
