"""Line index, Merkle manifest and collocations against brute force."""

import collections
import hashlib
import random
import re
import zlib
from itertools import pairwise

import numpy as np
import pytest

from tessella.llm import collocations, line_dedup, merkle

BLANK, LOWER = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, held, least_docs=3, least_chars=20):
    """Rows' lines as they stay, where the rows of ``held`` count."""

    def keys(t):
        return [k if len(k := x.strip(BLANK).translate(LOWER)) >= least_chars else None for x in (t or "").split("\n")]

    docs = collections.defaultdict(set)
    for d, t in held:
        for k in keys(t):
            if k and d is not None:
                docs[k].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if not (k and d is not None and len(docs[k]) >= least_docs and d < max(docs[k]))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(4)
    pool = [f"Line {i} that is long enough" for i in range(25)] + ["short", "x" * 19, "x" * 20, "é" * 20, "é" * 19, "\x1f" * 21, "  line and more of it  "]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t", "\x0b\r"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", "\r", "  "]) for x in rng.choices(pool, k=rng.randint(1, 8)))) for i in range(80)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, (pool[0] + "\n") * 3000), (None, pool[0]), rows[7], (3, pool[1] + "\n" + pool[2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, keys string, shard int").repartition(5)


def kept(index, docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in index.keep(docs).collect()), key=str)


def test_lines_enter_and_leave(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARDS", 4)
    rows = line_rows()
    first, second = rows[:30], rows[30:]
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index")
    index.insert(frame(spark, first))
    assert kept(index, frame(spark, first)) == brute_lines(first, first)
    index.insert(frame(spark, [*second, *first[:5]]))
    assert kept(index, frame(spark, rows)) == brute_lines(rows, rows)
    gone = {d for d, _ in rows[::3]} | {103, 999}
    index.delete(spark.createDataFrame([(d,) for d in gone] * 2, "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert kept(index, frame(spark, left)) == brute_lines(left, left)
    # Those that had left come back as they were, by an index that is opened again.
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index")
    index.insert(frame(spark, [r for r in rows if r[0] in gone]))
    assert kept(index, frame(spark, rows)) == brute_lines(rows, rows)
    # Every shard's filter has exactly the repeated keys, and no fingerprint too many.
    held = [(r.hi, r.lo) for r in index.counts().where("n >= 3").collect()]
    filters = {r.shard: r for r in index._read("filters").collect()}
    assert sum(r.n for r in filters.values()) == len(held) > 20
    assert {(r.hi, r.lo) for r in index.candidates().collect()} >= set(held)


def test_lines_digest_and_empty(spark, tmp_path):
    rows = line_rows()
    got = line_dedup.dedup_lines(frame(spark, rows), f"file://{tmp_path}/a", digest=True).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute_lines(rows, rows)), key=str)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/b").count() == 0


def test_cuckoo_filter():
    rng = random.Random(5)
    keys = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(400)]
    f = line_dedup.CuckooFilter.sized(190)  # 1024 bytes: 512 fingerprints
    for k in keys:
        f.add(*k)
    assert all(k in f for k in keys) and len(f.lanes) == 128
    others = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(5000)]
    assert sum(k in f for k in others) < 25
    for k in keys[:200]:
        f.remove(*k)
    assert all(k in f for k in keys[200:]) and sum(k in f for k in keys[:200]) < 5 and f.n == 200
    for k in keys[200:]:
        f.remove(*k)
    assert not f.lanes.any() and not f.stash


def test_cuckoo_filter_beyond_its_room():
    f = line_dedup.CuckooFilter.sized(0)
    keys = [(i << 20, i * 7919) for i in range(1, 40)]
    for k in keys:
        f.add(*k)
    assert f.stash and all(k in f for k in keys)
    for k in keys:
        f.remove(*k)
    assert not f.lanes.any() and not f.stash


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_leaf(fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def brute_tree(leaves):
    """The root, and of each leaf (left, right) by level."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for p, k in zip(paths, at, strict=True):
            first = k // 3 * 3
            p.append(("".join(level[first:k]), "".join(level[k + 1 : first + 3])))
        level, at = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], paths


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = collections.defaultdict(list)
    for r in rows:
        d, text = r[0], r[4]
        other = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        groups[r[1]].append((d, brute_leaf(r), brute_leaf((*r[:4], other))))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([x[1] for x in groups[s]])
    root, over = brute_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, over, strict=True):
        for (d, leaf, other), path in zip(groups[s], trees[s][1], strict=True):
            h = other
            for left, right in path + top:
                h = sha(left, h, right)
            out.append((d, leaf, trees[s][0], root, sha(*[x for p in path + top for x in p]), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 7])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    sizes = {"hot": 100, None: 9, "": 1, "é": 27, "z": 28, "one": 1, "null": 3, "0": 10}
    rows = [(rng.randint(-50, 500), s, rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["a\nb", "", None, "ü" * 50, "x\n" * 2000])) for s, n in sizes.items() for _ in range(n)]
    rows += [rows[0], rows[0], (None, "hot", None, None, "a\nb"), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int").repartition(4)
    got = merkle.verify_tampered(df).collect()
    want = brute_manifest(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {x[-1] for x in want} == {True, False}


def test_manifest_small(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.verify_tampered(spark.createDataFrame([], schema)).count() == 0
    (r,) = merkle.verify_tampered(spark.createDataFrame([(1, "a", "en", 1, "x")], schema)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == sha()


def brute_phrases(rows, least, absorbed, top):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            totals[lang] += len(w)
            for n in range(1, 5):
                counts.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    found = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    scored = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if any(lang == other and len(v) > len(w) and 100 * f >= absorbed * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (other, v), f in found.items()):
            continue
        score, k = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
        scored[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, x in scored.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)]


def phrase_rows():
    rng = random.Random(6)
    vocabulary = ["The", "the", "é", "É", "of", "a", "b", "new york", "state\tof", "x.y", "end.", "q\x1cr", " ", "don't", *[f"w{i}" for i in range(30)]]
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", "\n", " \t"]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for _ in range(400)]
    return [*rows, ("en", None), (None, ""), ("fr", "la " * 3000), ("xx", "." * 50), rows[0], ("en", "new york city hall " * 20)]


@pytest.mark.parametrize("slice_bytes", [300, 2_000_000])
def test_phrases_equal_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(collocations, "SLICE", slice_bytes)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, words int, phrase string").repartition(5)
    got = [tuple(r) for r in collocations.mine(df, least=5, top=60).collect()]
    want = brute_phrases(rows, 5, 80, 60)
    assert sorted(got) == sorted(want) and len(want) > 50
    assert collocations.mine(df.limit(0)).count() == 0


def test_bitmap_lets_all_phrases_through(spark):
    words = [("en", f"w{i} w{i + 1}") for i in range(3000)]
    held = np.frombuffer(collocations._bitmap(spark.createDataFrame(words, "lang string, phrase string")).value, np.uint8)

    def asked(lang, pairs):
        hashes = [np.array([collocations.xxhash.xxh64_intdigest(p[k]) for p in pairs], np.uint64) for k in (0, 1)]
        return collocations._may_hold(held, collocations._of_phrase(np.uint64(collocations.xxhash.xxh64_intdigest(lang)), hashes))

    names = [f"w{i}" for i in range(3001)]
    assert asked("en", list(pairwise(names))).all()
    assert asked("de", list(pairwise(names))).mean() < 0.1 and asked("en", list(zip(names[1:], names, strict=False))).mean() < 0.1


def test_scores_pass_64_bits(spark, monkeypatch):
    counts = [("en", 1, "a", 2 * 10**18), ("en", 1, "b", 10**18), ("en", 2, "a b", 10**18)]
    tables = spark.createDataFrame(counts, "lang string, words int, phrase string, f long"), spark.createDataFrame([("en", 3 * 10**18)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrases", lambda *_: tables)
    (r,) = collocations.mine(None).collect()
    assert (r.score, r.l, r.r) == (666666, 2 * 10**18, 10**18)
