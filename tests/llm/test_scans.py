"""License, secret and quality scans against brute force over small fixtures."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessella.llm import license_rules, licenses, quality_rules, secrets

TEXTS = [
    (1, None), (2, ""), (3, "MIT  License. mit-license! CC-BY 4.0; cc/by X apache license"),
    (4, "SPDX-License-Identifier: GPL-2.0-or-later (c) Copyright 2020 foo. All rights reserved"),
    (None, "Licensed under the Apache License, Version 2.0 é mit license"), (5, "the MIT license " * 700), (5, "the MIT license " * 700),
    (6, "released under the gnu general public license, version 3"), (7, "no words of that kind"),
]


def brute_license(text):
    text = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_phrases_equal_brute_force(spark):
    rows = licenses.report(licenses.scan(spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, score string"))).collect()
    want = collections.Counter((d, *brute_license(t)) for d, t in TEXTS)
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in rows)


def test_license_rules_and_suppression(spark):
    assert len(license_rules.rules()) > 200
    by = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()}
    assert {d.label for d in by[4].detections} == {"gpl-2.0", "all-rights-reserved"}
    assert [d.label for d in by[6].detections] == ["gpl-3.0"]
    for r in by.values():
        spans = [(d.start, d.end, d.priority) for d in r.detections]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] for a in spans for b in spans)


def said(pattern):
    """Texts that a rule's pattern matches: all its alternatives, with and without each part that may be missing."""

    def of(parsed):
        out = [""]
        for op, a in parsed:
            kind = str(op)
            if kind == "IN":
                got = [chr(x[1]) for x in a if str(x[0]) == "LITERAL"] or ["x"]
            elif kind == "BRANCH":
                got = [x for b in a[1] for x in of(b)]
            elif kind == "MAX_REPEAT":
                got = ["".join(c) for n in sorted({a[0], min(int(a[1]), a[0] + 1)}) for c in itertools.product(of(a[2]), repeat=n)]
            else:
                got = {"LITERAL": lambda: [chr(a)], "ANY": lambda: ["x"], "SUBPATTERN": lambda: of(a[3]), "ASSERT": lambda: [""]}[kind]()
            out = [x + y for x in out for y in got]
        return out

    return of(re._parser.parse(pattern))


def test_license_prefilters_keep_all_that_rules_match():
    anchors = re.compile("(?i)" + "|".join(license_rules.ANCHORS).replace("[S]", licenses._SEPARATOR))
    for _, label, keywords, pattern, _ in license_rules.rules():
        for text in said(pattern):
            assert re.search(pattern, f" {text} "), (label, text)
            assert any(k in text for k in keywords), (label, text)
            assert anchors.search(text) and anchors.search(text.replace(" ", "/").upper()), (label, text)


def test_license_names_without_the_word(spark):
    texts = {
        "Creative Commons Attribution 4.0 International": "cc-by-4.0", "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa-3.0", "Zero-Clause BSD": "bsd-0-clause", "MIT No Attribution": "mit-0",
        "http://mozilla.org/MPL/2.0/": "mpl-2.0", "eclipse.org/legal/epl-v10.html": "epl-1.0", "scripts.sil.org/OFL": "ofl-1.1", "PostgreSQL Licence": "postgresql", "PNG Reference Library License": "libpng",
    }
    rows = licenses.report(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == list(texts.values()) and all(r.score > 0 for r in rows)


def test_license_empty(spark):
    assert licenses.report(licenses.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    n = collections.Counter(x[3] for x in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found)).encode()).hexdigest()


def secret_texts():
    rng = random.Random(4)
    key = base64.b64encode(bytes(rng.randrange(256) for _ in range(30))).decode()
    return [
        (1, None), (2, ""), (3, "é😀 Password: 'abcd1234' token=token:abcdefghijk x"), (4, "AKIAABCDEFGHIJKL1 AKIAshort " + "f" * 31 + " " + "ab12" * 8),
        (None, 'secret = short api_key="ABCDEFGH12" apiKey=zzzzzzzzz'), (5, f"key {key} but internationalization_of_things_2 https://example.com/some/long/path/to/page2"),
        (6, "token=abcdefgh1 " * 300 + "x"), (7, "K" * 10 + " KEY toKen=secret=abcdefghij"), (8, "z" * 38 + "1A2"),
    ]


def test_secret_spans_equal_brute_force(spark):
    texts = secret_texts()
    scanned = secrets.scan(spark.createDataFrame([(*t, "old") for t in texts], "doc_id long, text string, spans string"))
    rows = {r.doc_id: r for r in secrets.report(scanned).collect()}
    assert all((r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute_secrets(t) for d, t in texts for r in [rows[d]])
    assert rows[5].spans == "random:4:44" and rows[8].spans == ""


def test_redaction(spark):
    texts = secret_texts()
    out = {r.doc_id: r.text for r in secrets.redacted(secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert out[1] is None and out[2] == ""
    assert out[4] == "[REDACTED-access] AKIAshort " + "f" * 31 + " [REDACTED-hex]"
    assert out[5].startswith("key [REDACTED-random] but inter") and out[6] == "[REDACTED-assign] " * 300 + "x"


def test_secrets_behind_a_name_and_equals_sign(spark):
    rng = random.Random(9)
    data = lambda n: bytes(rng.randrange(256) for _ in range(n))
    values = ["9aQx0LkT7vYc2WmZ5nRbE8uHsJ3dFg6p", *[base64.b64encode(data(n)).decode() for n in (30, 31, 32)], base64.b32encode(data(31)).decode(), base64.b32encode(data(34)).decode()]
    fronts = ["AUTH: ", "PRIVATE_KEY=", "AWS_SECRET_ACCESS_KEY=", "export A=B K=", "a="]
    rows = [(i * 10 + j, f"{f}{v} end") for i, v in enumerate(values) for j, f in enumerate(fronts)]
    scanned = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in secrets.report(scanned).collect()}
    assert spans == {i * 10 + j: f"random:{len(f)}:{len(f) + len(v)}" for i, v in enumerate(values) for j, f in enumerate(fronts)}
    assert all(r.text.endswith("[REDACTED-random] end") for r in secrets.redacted(scanned).collect())


def brute_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def quality_texts():
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "ore", "isti", "u")]
    good = [(i, " ".join(rng.choices(words, k=rng.randint(60, 300))), rng.choice(["en", "de"]), "s") for i in range(300)]
    odd = [(1000, None, None, None), (1001, "", "en", "s"), (1002, "a a a a", "en", "s"), (1003, "x\n\nx\n x\nx \n", "en", "s"), (None, "a b c d a b c", "en", "s"), (0, good[0][1], "en", "s")]
    junk = [(2000 + i, " ".join(f"#{w}$$$***" for w in rng.choices(words, k=200)), "en", "s") for i in range(5)]
    return good, odd, junk


def test_quality_statistics_and_verdicts(spark):
    good, odd, junk = quality_texts()
    rows = quality_rules.judge(spark.createDataFrame(good + odd + junk, "doc_id long, text string, lang string, source string")).collect()
    key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert collections.Counter(map(key, rows)) == collections.Counter(brute_quality(t) for _, t, *_ in good + odd + junk)
    assert not any(r.kept for r in rows if r.base_failed)
    kept = {r.doc_id for r in rows if r.kept}
    assert not kept & {d for d, *_ in junk}
    assert len(kept & set(range(300))) >= sum(not brute_quality(t)[5] for _, t, *_ in good) - 2


@pytest.mark.parametrize("columns", ["doc_id long, text string, lang string, source string", "doc_id long, text string"])
def test_quality_empty(spark, columns):
    assert quality_rules.judge(spark.createDataFrame([], columns)).where(F.col("kept")).count() == 0


def test_many_secrets_in_one_text(spark):
    n = 20_000
    text = "token=abcdefgh1 AUTH: 9aQx0LkT7vYc2WmZ5nRbE8uHsJ3dFg6p " * (n // 2)
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    start = time.perf_counter()
    got = secrets.report(secrets.scan(df)).collect()
    clean = secrets.redacted(secrets.scan(df)).collect()
    assert time.perf_counter() - start < 60
    size = len(text) * 2 // n
    want = [f"{kind}:{size * i + a}:{size * i + b}" for i in range(n // 2) for kind, a, b in (("assign", 0, 15), ("random", 22, 54))]
    assert [r.spans.split(",") for r in got] == [want, want]
    assert all(r.text == "[REDACTED-assign] AUTH: [REDACTED-random] " * (n // 2) for r in clean)


def test_secrets_of_no_rows(spark):
    assert secrets.report(secrets.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
