"""Tables as text: trees, graphs, bundles and snapshots. Each row becomes a line where it is; Spark's writers put the
lines into files, in order within a sorted range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.functions.text import abstract, human_bytes, human_count, redacted, slug, xml_escaped
from tessella.operators import insights


def tree_lines(nodes: DataFrame, style: str = "markdown") -> DataFrame:
    """(path, line) of nodes (path, kind, depth, summary), to be sorted by path: markdown items or XML elements."""
    pad = F.repeat(F.lit("  "), F.greatest(F.col("depth").cast("int") - 1, F.lit(0)))
    name, text = paths.basename("path"), F.coalesce("summary", F.lit(""))
    if style == "markdown":
        line = F.concat(pad, F.lit("- **"), name, F.when(F.col("kind") == "dir", "/").otherwise(""), F.lit("**"), F.when(text != "", F.concat(F.lit(" — "), F.regexp_replace(text, r"\s+", " "))).otherwise(""))
    else:
        line = F.concat(pad, F.lit('<node path="'), xml_escaped("path", True), F.lit('" kind="'), F.col("kind"), F.lit('">'), xml_escaped(text), F.lit("</node>"))
    return nodes.select("path", line.alias("line"))


def mermaid_lines(graph: DataFrame) -> DataFrame:
    """(source, target, line) of a graph's edges for a diagram."""
    node = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(c, 256), 1, 10), F.lit('["'), F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit('"]'))
    return graph.select("source", "target", F.concat(F.lit("  "), node("source"), F.lit(" -->|"), F.col("weight").cast("string"), F.lit("| "), node("target")).alias("line"))


def front_matter(title: Column, kind: Column, size: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(title, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("---\ntitle: "), quoted, F.lit("\nkind: "), kind, F.lit("\nbytes: "), size.cast("string"), F.lit("\n---\n"))


def bundle(nodes: DataFrame) -> DataFrame:
    """(name, content): a file for each node, with a head of its facts."""
    name = F.concat(F.regexp_replace(F.regexp_replace("path", "^/+", ""), "[^A-Za-z0-9._/-]", "_"), F.when(F.col("kind") == "dir", "/index.md").otherwise(".md"))
    return nodes.select(name.alias("name"), F.concat(front_matter(F.col("path"), F.col("kind"), F.coalesce("byte_size", F.lit(0))), F.coalesce("summary", F.lit("")), F.lit("\n")).alias("content"))


def snapshot(summaries: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(part, json): summaries, edges and weights without secrets, one line each; no chunks and no vectors."""
    s = summaries.drop("embedding").withColumn("summary", redacted("summary"))
    out = None
    for part, df in (("summaries", s), ("edges", edges), ("weights", weights)):
        rows = df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def restored(lines: DataFrame, part: str, ddl: str) -> DataFrame:
    return lines.where(F.col("part") == part).select(F.from_json("json", ddl).alias("r")).select("r.*")


# Whole documents, as lines in an order: (place, line). Sorted by place they are the text; Spark's writer sorts by ranges.

#: Stands before each segment in a place, below all characters of names; the other one ends what a directory holds.
_STEP, _END = "\x01", "\U0010ffff"


def _place(kind: Column) -> Column:
    """Where a node stands: what lies in a directory follows it, files before directories, then by name."""
    step = lambda first, segments: F.array_join(F.transform(segments, lambda s: F.concat(F.lit(_STEP + first), s)), "")
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    own = F.when(F.size(parts) == 0, "").when(kind == "dir", step("1", F.slice(parts, -1, 1))).otherwise(step("0", F.slice(parts, -1, 1)))
    return F.concat(step("1", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))), own)


def _tokens(lines: DataFrame) -> DataFrame:
    """(tokens) of lines with their ends."""
    return lines.agg(F.ceil(F.coalesce(F.sum(F.length("line") + 1), F.lit(0)) / 4).cast("long").alias("tokens"))


def tree_document(nodes: DataFrame, root: str, style: str = "markdown", generated_at: str = "", most: int | None = None) -> DataFrame:
    """(place, line): the summaries (path, parent_path, kind, depth, summary, summary_l0, model, generated_at, source_hash) of root and
    of what lies up to ``most`` levels below, as markdown headings, nested XML with an estimate of its tokens, or JSON lines. Nulls are
    empty."""
    top = paths.depth(F.lit(root))
    level = (F.col("depth") - top).cast("int")
    rows = nodes.where(paths.under("path", root) & (F.lit(True) if most is None else level <= most))
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("model", "generated_at", "source_hash", "summary")}
    brief = F.coalesce("summary_l0", abstract("summary"), F.lit(""))
    rows = rows.withColumns({"place": _place(F.col("kind")), "level": level, "brief": brief, **said})
    if style == "json":
        return rows.select("place", F.to_json(F.struct("path", "kind", "depth", F.col("brief").alias("abstract"), "summary", "model", "generated_at", "source_hash")).alias("line"))
    name = paths.basename("path")
    if style == "markdown":
        heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 2, F.lit(6))), F.when(F.col("kind") == "dir", " 📁 ").otherwise(" 📄 "), name)
        facts = F.concat(F.lit("<!-- model="), "model", F.lit(" generated_at="), "generated_at", F.lit(" source_hash="), "source_hash", F.lit(" -->"))
        body = rows.select("place", F.concat(heading, F.lit("\n\n`"), "path", F.lit("`\n\n"), facts, F.lit("\n\n**Abstract:** "), "brief", F.lit("\n\n"), "summary", F.lit("\n")).alias("line"))
        head = _tokens(body).select(F.lit("").alias("place"), F.concat(F.lit(f"# Index: {root}\n\n> ~"), F.col("tokens").cast("string"), F.lit(" tokens (estimate, chars/4)\n")).alias("line"))
        return head.unionByName(body)
    kids = rows.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("kids"))
    rows = rows.join(kids, "path", "left")
    pad, tag = F.repeat(F.lit("  "), 2 * F.col("level") + 1), F.when(F.col("kind") == "dir", "directory").otherwise("file")
    some = F.col("kids").isNotNull()
    begin = F.concat(pad, F.lit("<"), tag, F.lit(' path="'), xml_escaped("path", True), F.lit('" name="'), xml_escaped(name, True), F.lit('" depth="'), F.col("depth").cast("string"), F.lit('">\n'), pad, F.lit("  <abstract>"), xml_escaped("brief"), F.lit("</abstract>\n"))
    told = F.concat(pad, F.lit('  <summary model="'), xml_escaped("model", True), F.lit('" generated_at="'), "generated_at", F.lit('" source_hash="'), xml_escaped("source_hash", True), F.lit('">'), xml_escaped("summary"), F.lit("</summary>"))
    within = F.when(some, F.concat(F.lit("\n"), pad, F.lit('  <children count="'), F.col("kids").cast("string"), F.lit('">'))).otherwise("")
    done = F.concat(F.when(some, F.concat(pad, F.lit("  </children>\n"))).otherwise(""), pad, F.lit("</"), tag, F.lit(">"))
    body = rows.select("place", F.concat(begin, told, within).alias("line")).unionByName(rows.select(F.concat("place", F.lit(_STEP + _END)).alias("place"), done.alias("line")))
    attributes = F.concat(xml_escaped(F.lit(root), True), F.lit('" generated_at="'), xml_escaped(F.lit(generated_at), True), F.lit('" approx_tokens="'), F.col("tokens").cast("string"))
    head = _tokens(body).select(F.lit("").alias("place"), F.concat(F.lit('<index root="'), attributes, F.lit('">')).alias("line"))
    tail = head.select(F.lit(_END).alias("place"), F.lit("</index>").alias("line"))
    return head.unionByName(body).unionByName(tail)


def iso(seconds: Column | str) -> Column:
    """Seconds since 1970 as a time of UTC, in any session's time zone."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(s, F.lit(86400))
    return F.concat(day, F.lit("T"), *[x for k, unit in enumerate((3600, 60, 1)) for x in ([F.lit(":")] if k else []) + [F.lpad((F.floor(rest / unit) % (24 if unit == 3600 else 60)).cast("string"), 2, "0")]], F.lit("Z"))


def json_text(value: Column | str) -> Column:
    """A text as a JSON string: backslashes, quotes, ends of lines and tabs escaped."""
    v = F.col(value) if isinstance(value, str) else value
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), v, F.lit('"'))


def pack_bundle(nodes: DataFrame, events: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, name, place, line): the files of each pack, as lines to be sorted by place. nodes (pack_id, path, kind, summary,
    summary_l0, model, generated_at, source_hash, is_root), events (pack_id, id, event, detail, at), packs (id, name). A file a node,
    named by its slug, the beginning of its hash and a number where two are alike; index.md lists them, log.md the events, manifest.jsonl
    the nodes with their hashes. No file is put together in one row but that of one node."""
    hash8 = F.substring(F.coalesce("source_hash", F.lit("")), 1, 8)
    rows = nodes.withColumns({"title": paths.basename("path"), "brief": F.coalesce("summary_l0", abstract("summary"), F.lit("")), "place": _place(F.col("kind")), "source_hash": F.coalesce("source_hash", F.lit(""))})
    rows = rows.withColumn("stem", F.concat(slug("title"), F.lit("-"), hash8))
    n = F.row_number().over(Window.partitionBy("pack_id", "stem").orderBy("place"))
    rows = rows.withColumn("name", F.concat("stem", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".md")))
    facts = [("type", F.col("kind")), ("title", F.col("title")), ("description", F.col("brief")), ("resource", F.concat("path", F.lit(" (sha256:"), "source_hash", F.lit(")"))), ("timestamp", iso(F.coalesce("generated_at", F.lit(0)))), ("model", F.coalesce("model", F.lit(""))), ("source_hash", F.col("source_hash"))]
    head = F.concat(F.lit("---\n"), *[x for key, v in facts for x in (F.lit(f"{key}: "), json_text(v), F.lit("\n"))], F.lit("---\n\n# "))
    files = rows.select("pack_id", "name", F.lit("").alias("place"), F.concat(head, "title", F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n")).alias("line"))
    index = rows.select("pack_id", F.lit("index.md").alias("name"), F.concat(F.lit(_STEP), "place").alias("place"), F.concat(F.lit("* ["), "title", F.lit("]("), "name", F.lit(") - "), "brief").alias("line"))
    manifest = rows.select("pack_id", F.lit("manifest.jsonl").alias("name"), "place", F.to_json(F.struct("path", F.col("source_hash").alias("hash"), F.col("name").alias("filename"), "is_root")).alias("line"))
    told = F.concat(F.lit("- **"), F.when(F.col("event") == "created", "Creation").otherwise("Update"), F.lit("** ("), iso("at"), F.lit("): "), "event", F.when(F.col("detail").isNotNull(), F.concat(F.lit(" — "), "detail")).otherwise(""))
    when = F.concat(F.lit(_STEP), F.lpad(F.col("at").cast("string"), 20, "0"), F.lit(_STEP), F.lpad(F.col("id").cast("string"), 20, "0"))
    log = events.select("pack_id", F.lit("log.md").alias("name"), when.alias("place"), told.alias("line"))
    quiet = packs.select(F.col("id").alias("pack_id")).join(events.select("pack_id"), "pack_id", "left_anti").select("pack_id", F.lit("log.md").alias("name"), F.lit(_STEP).alias("place"), F.lit("(no recorded history)").alias("line"))
    title = lambda name, end: packs.select(F.col("id").alias("pack_id"), F.lit(name).alias("name"), F.lit("").alias("place"), F.concat(F.lit("# "), F.col("name"), F.lit(end)).alias("line"))
    parts = (files, title("index.md", "\n\nA bundle of knowledge.\n"), index, manifest, title("log.md", " — changelog\n"), log, quiet)
    return reduce(DataFrame.unionByName, parts)


def weight_lines(weights: DataFrame, style: str = "markdown") -> DataFrame:
    """(place, line) of weights by kind and target, as rows of a table, XML elements or JSON lines; nothing of none."""
    reason, two = F.coalesce("reason", F.lit("")), F.format_string("%.2f", F.bround(F.col("weight").cast("double"), 2))
    line = {
        "markdown": F.concat(F.lit("| "), "target", F.lit(" | "), "target_kind", F.lit(" | "), two, F.lit(" | "), reason, F.lit(" |")),
        "json": F.concat(F.lit('{"target": '), json_text("target"), F.lit(', "kind": '), json_text("target_kind"), F.lit(', "weight": '), F.format_string("%.4f", F.col("weight").cast("double")), F.lit(', "reason": '), json_text(reason), F.lit("}")),
        "xml": F.concat(F.lit('  <weight target="'), xml_escaped("target", True), F.lit('" kind="'), xml_escaped("target_kind", True), F.lit('" value="'), two, F.lit('">'), xml_escaped(reason), F.lit("</weight>")),
    }[style]
    around = {"markdown": ("\n## Importance weights\n\n| target | kind | weight | reason |\n|---|---|---|---|", None), "json": (None, None), "xml": ("<weights>", "</weights>")}[style]
    return _enclosed(weights.select(F.concat(F.lit(_STEP), "target_kind", F.lit(_STEP), "target").alias("place"), line.alias("line")), *around)


def _enclosed(lines: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Lines with one before and one after them, if there are any."""
    some = lines.limit(1)
    for text, place in ((first, ""), (last, _END)):
        if text is not None:
            lines = lines.unionByName(some.select(F.lit(place).alias("place"), F.lit(text).alias("line")))
    return lines


def graph_lines(graph: DataFrame, style: str = "markdown", truncated: bool = False) -> DataFrame:
    """(place, line) of a graph's edges (source, target, weight), the heaviest first."""
    place = F.concat(F.lit(_STEP), F.lpad((F.lit(10**15) - F.col("weight").cast("long")).cast("string"), 16, "0"), F.lit(_STEP), "source", F.lit(_STEP), "target")
    weight = F.col("weight").cast("string")
    line = {
        "markdown": F.concat(F.lit("- "), paths.basename("source"), F.lit(" → "), paths.basename("target"), F.lit(" ["), weight, F.lit("]")),
        "json": F.concat(F.lit('{"from": '), json_text("source"), F.lit(', "to": '), json_text("target"), F.lit(', "weight": '), weight, F.lit("}")),
        "xml": F.concat(F.lit('  <edge from="'), xml_escaped("source", True), F.lit('" to="'), xml_escaped("target", True), F.lit('" weight="'), weight, F.lit('"/>')),
    }[style]
    note = "\n\n_(truncated — heaviest edges shown)_\n" if truncated else "\n"
    around = {"markdown": ("\n## Call graph" + note, None), "json": (None, None), "xml": (f'<code-graph truncated="{str(truncated).lower()}">', "</code-graph>")}[style]
    return _enclosed(graph.select(place.alias("place"), line.alias("line")), *around)


def signature(code: Column | str, docs: bool = False, most: int = 8) -> Column:
    """The lines of a definition up to the one that opens its body, ``most`` at most; comments before it only where docs are wanted.
    What follows the last brace is an ellipsis."""
    code = F.col(code) if isinstance(code, str) else code

    def step(acc: Column, line: Column) -> Column:
        more = F.array_append(acc["out"], line)
        full = F.size(more) >= most
        comment = F.ltrim(line).rlike(r"""^\s*(//|#|/\*|\*|\"\"\"|''')""") & ~acc["within"]
        state = lambda out, within, done: F.struct(out.alias("out"), within.alias("within"), done.alias("done"))
        commented = state(more, acc["within"], full) if docs else acc
        opens = F.contains(line, F.lit("{")) | F.rtrim(line).endswith(":") | full
        return F.when(acc["done"], acc).when(comment, commented).otherwise(state(more, F.lit(True), opens))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("within"), F.lit(False).alias("done"))
    joined = F.regexp_replace(F.array_join(F.aggregate(F.split(code, r"\r?\n"), start, step)["out"], "\n"), r"\s+$", "")
    return F.when(F.contains(joined, F.lit("{")), F.concat(F.regexp_extract(joined, r"(?s)^(.*\{)", 1), F.lit(" … }"))).otherwise(joined)


def signature_lines(chunks: DataFrame, docs: bool = False) -> DataFrame:
    """(entry_path, seq, heading, signature) of chunks with a language, in order: a skeleton of the code."""
    return chunks.where("language IS NOT NULL").select("entry_path", "seq", "heading", signature(F.coalesce("text", F.lit("")), docs).alias("signature")).orderBy("entry_path", "seq")


def report_lines(answers: DataFrame, sources: DataFrame, style: str = "markdown", generated_at: str = "") -> DataFrame:
    """(place, line): a report of answers (n, question, answer) and their sources (n, rank, path, heading): contents, then each
    question with its answer and what it rests on."""
    at = lambda *parts: F.concat(*[x for p in parts for x in (F.lit(_STEP), F.lpad(p.cast("string"), 12, "0"))])
    n, zero, one, two, three = F.col("n"), *map(F.lit, (0, 1, 2, 3))
    question, answer, number = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")), F.col("n").cast("string")
    cited = sources.join(answers.select("n"), "n", "left_semi")
    heading = F.coalesce("heading", F.lit(""))
    count = answers.agg(F.count("*").alias("k"))
    having = cited.select("n").distinct()
    if style == "markdown":
        anchor = F.concat(number, F.lit("-"), F.regexp_replace(F.lower(question), "[^a-z0-9]", "-"))
        head = count.select(F.lit("").alias("place"), F.concat(F.lit(f"# Report\n\n_generated {generated_at} · "), F.col("k").cast("string"), F.when(F.col("k") == 1, " query").otherwise(" queries"), F.lit("_\n\n## Contents\n")).alias("line"))
        contents = answers.select(at(zero, n).alias("place"), F.concat(number, F.lit(". ["), question, F.lit("](#"), anchor, F.lit(")")).alias("line"))
        said = answers.select(at(one, n, zero).alias("place"), F.concat(F.lit("\n## "), number, F.lit(". "), question, F.lit("\n\n"), answer, F.lit("\n")).alias("line"))
        label = having.select(at(one, n, one).alias("place"), F.lit("**Sources:**\n").alias("line"))
        each = cited.select(at(one, n, two, F.col("rank")).alias("place"), F.concat(F.lit("- `"), "path", F.lit("`"), F.when(heading != "", F.concat(F.lit(" — "), heading)).otherwise("")).alias("line"))
        return reduce(DataFrame.unionByName, (head, contents, said, label, each))
    head = count.select(F.lit("").alias("place"), F.concat(F.lit(f'<report generated_at="{generated_at}" queries="'), F.col("k").cast("string"), F.lit('">')).alias("line"))
    said = answers.select(at(one, n, zero).alias("place"), F.concat(F.lit('  <query n="'), number, F.lit('" question="'), xml_escaped(question, True), F.lit('">\n    <answer>'), xml_escaped(answer, True), F.lit("</answer>")).alias("line"))
    label = having.select(at(one, n, one).alias("place"), F.lit("    <sources>").alias("line"))
    each = cited.select(at(one, n, two, F.col("rank")).alias("place"), F.concat(F.lit('      <source path="'), xml_escaped("path", True), F.lit('" heading="'), xml_escaped(heading, True), F.lit('"/>')).alias("line"))
    ends = having.select(at(one, n, three).alias("place"), F.lit("    </sources>").alias("line"))
    shut = answers.select(at(one, n, F.lit(4)).alias("place"), F.lit("  </query>").alias("line"))
    tail = head.select(F.lit(_END).alias("place"), F.lit("</report>").alias("line"))
    return reduce(DataFrame.unionByName, (head, said, label, each, ends, shut, tail))


def savings_lines(cited: DataFrame, served: DataFrame, entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """(answer, path, bytes, line): for answers what whole files they stand for. cited (answer, path), served (answer, bytes); each
    answer's row without a path has the total. Nothing of answers that serve no less than their files hold."""
    pairs = cited.select("answer", "path").where("path IS NOT NULL").distinct()
    sizes = pairs.join(insights.counterfactual_sizes(pairs, entries, summaries), "path").where("bytes > 0")
    total = sizes.groupBy("answer").agg(F.sum("bytes").alias("whole")).join(served.select("answer", F.coalesce("bytes", F.lit(0)).alias("given")), "answer").where("whole > given")
    percent = insights.savings(total.select("answer", F.col("given").alias("bytes_served"), F.col("whole").alias("bytes_counterfactual")))
    each = sizes.join(total.select("answer"), "answer", "left_semi").select("answer", "path", "bytes", F.concat(F.lit("  "), F.lpad(human_bytes("bytes"), 9, " "), F.lit("  "), "path").alias("line"))
    summed = F.concat(F.lit("  = "), human_bytes("bytes_counterfactual"), F.lit(" of source; served "), human_bytes("bytes_served"), F.lit(" — "), F.col("percent_saved").cast("string"), F.lit("% less (~"), human_count("tokens_saved"), F.lit(" tokens at ≈4 bytes/token)"))
    return each.unionByName(percent.select("answer", F.lit(None).cast("string").alias("path"), F.col("bytes_counterfactual").alias("bytes"), summed.alias("line")))
