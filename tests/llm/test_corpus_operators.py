"""Filter audit, Merkle manifest and suffix dedup against brute force on small and odd tables."""
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from docweave.llm import filter_audit, merkle, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def masks_by_force(rows):
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    for r in rows:
        t, w = r["text"] or "", WORDS.findall(r["text"] or "")
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        yield r, {f for f, x in fails.items() if x} | ({"E"} if r["doc_id"] is not None and r["doc_id"] > first[t] else set())


def audit_by_force(rows, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    out = Counter()
    for r, fails in masks_by_force(rows):
        part = r["lang"] or ""
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for s, f in enumerate(order, 1):
                hit = f in fails
                counted = {"kept": not (gone or hit), "removed": hit and not gone, "redundant": hit and gone, "unique_fails": fails == {f}, "good_lost": hit and not gone and r["doc_id"] in good, "toxic_lost": hit and not gone and r["doc_id"] in toxic}
                for k, v in counted.items():
                    out[part, order, s, k] += v
                out[part, f] += hit and not gone
                gone = gone or hit
    return out


def test_audit(spark):
    rnd = random.Random(5)
    texts = [None, "", "a", "A#", " ".join(f"w{i}" for i in range(120)), "x " * 130, " ".join(f"W{i}" for i in range(150)) + " $", "ÄÖ 漢字 \x0b\x1c b", "y" * 200_000]
    rows = [{"doc_id": rnd.choice([None, *range(40)]), "text": rnd.choice(texts), "lang": rnd.choice([None, "", "de", "en"])} for _ in range(150)]
    rows += [dict(rows[0]), dict(rows[1])]
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], 1, "x", 2) for r in rows], "doc_id long, text string, lang string, part int, mask string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit_by_force(rows, labels)
    got = filter_audit.audit(df, marks).collect()
    assert len(got) == 3 * 600 and {r.part for r in got} == {"", "de", "en"}
    for r in got:
        assert r.filter == r.filter_order[r.step - 1]
        for k in filter_audit.MEASURES:
            assert r[k] == want[r.part, r.filter_order, r.step, k], (r, k)
        assert r.shapley == want[r.part, r.filter]
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit(df, marks.limit(0)).collect()} == {0}


def test_audit_of_other_filters_and_large_counts(spark):
    """Two filters by conditions of a caller; sums far beyond 32 bits stay in their fields."""
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "ab", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filter_audit.audit(df, none, {"x": F.col("text").contains("a"), "y": F.col("text").contains("b")}).collect()}
    assert got == {("xy", 1): (1, 2, 0), ("xy", 2): (0, 1, 1), ("yx", 1): (1, 2, 0), ("yx", 2): (0, 1, 1)}
    orders = list(permutations(range(5)))
    many = 1 << 55
    total = filter_audit.wide(31, True, True, orders) * many + filter_audit.wide(0, True, True, orders) * (many - 1)
    got = filter_audit.fields(total, (6, 120, 5))
    assert (got[0] == many - 1).all() and (got[1, :, 0] == many).all() and (got[2, :, 1:] == many).all() and (got[1, :, 1:] == 0).all()
    for bad in ({}, {c: F.lit(True) for c in "abcdefg"}, {"xy": F.lit(True)}):
        with pytest.raises(ValueError):
            filter_audit.audit(df, none, bad)


def hashed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_force(row, lower=False):
    low = lambda v: re.sub("[A-Z]", lambda m: m[0].lower(), v)
    values = [low(v) if v is not None and k == "text" and lower else v for k, v in row.items()]
    return hashed("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """(root, witnesses as lists of (place in run, siblings))"""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for k in range(0, len(nodes), 8):
            run = nodes[k : k + 8]
            for j in range(len(run)):
                for i in below[k + j]:
                    paths[i].append((j, run[:j] + run[j + 1 :]))
            up.append(hashed(run))
            under.append([i for b in below[k : k + 8] for i in b])
        nodes, below = up, under
    return nodes[0], paths


def manifest_by_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        leaves = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_by_force(r)))
        made[g] = leaves, *tree([leaf_by_force(r) for r in leaves])
    root, over = tree([made[g][1] for g in order])
    out = []
    for g, top in zip(order, over, strict=True):
        leaves, subroot, paths = made[g]
        for r, path in zip(leaves, paths, strict=True):
            leaf, steps = leaf_by_force(r), path + top
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            back = leaf_by_force(r, hit)
            for k, siblings in steps:
                back = hashed(siblings[:k] + [back] + siblings[k:])
            out.append((r["doc_id"], leaf, subroot, root, hashed(x for _, s in steps for x in s), back, back == root))
    return Counter(out)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 1}, {"a": 9, "": 64, "Z": 3, "é": 2}, {"a": 513, "b": 512, None: 73}, {f"l{i}": 1 + i % 3 for i in range(70)}, {"a": 4620, "b": 5}])
def test_manifest(spark, monkeypatch, sizes):
    rnd = random.Random(6)
    ids = list(range(-5, 100_000, 7))
    rnd.shuffle(ids)
    rows = [{"doc_id": ids.pop(), "source": rnd.choice([None, "s", "ü"]), "lang": g, "n_chars": rnd.choice([None, 3]), "text": rnd.choice([None, "", "abc", "A1", "ÄB漢"])} for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame([(*r.values(), 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, row int, grp string").repartition(5)
    assert Counter(map(tuple, merkle.documents_manifest(df).collect())) == manifest_by_force(rows)


def test_manifest_of_odd_rows(spark):
    rows = [{"doc_id": d, "source": None, "lang": "x", "n_chars": None, "text": t} for d, t in [(None, "A"), (None, None), (3, "B"), (3, "B"), (3, "b"), (None, "A"), (9, "Z" * 300_000)]]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars int, text string")
    assert Counter(map(tuple, merkle.documents_manifest(df).collect())) == manifest_by_force(rows)
    assert merkle.documents_manifest(df.limit(0)).count() == 0


def test_witnesses_are_extended_by_later_siblings():
    block = merkle.Block()
    for k in range(10):
        block.append(str(k))
    assert block.paths[0] == [list("1234567")] and block.paths[7] == [list("0123456")] and block.paths[8] == []
    assert block.open[0][0][2] == ["9"] and block.open[0][1][2] == ["8"]  # partial, by the open run
    root = block.finish(True)
    first, last = hashed("01234567"), hashed("89")
    assert root == hashed([first, last]) and block.paths[8] == [["9"], [first]] and block.paths[0][1] == [last]
    assert merkle.folded("8", [{"at": 8, "path": [[b"\x09"], [bytes.fromhex(first)]]}]) == hashed([first, hashed(["8", "09"])])


def copies_by_force(rows, window):
    first = {}
    order = sorted(((1 << 63) - 1 if d is None else d, (t or "").encode(), d) for d, t in rows)
    for d, text, _ in order:
        for k in range(len(text) - window + 1):
            first[text[k : k + window]] = min(d, first.get(text[k : k + window], d))
    out = []
    for d, text, doc_id in order:
        gone = bytearray(len(text))
        for k in range(len(text) - window + 1):
            if first[text[k : k + window]] < d:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(text, gone, strict=True) if not g)
        out.append((doc_id, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


SMALL = suffix_dedup.Sizes(run_grams=300, run_items=60, part_grams=200, bucket_items=50)


@pytest.mark.parametrize("sizes", [suffix_dedup.Sizes(), SMALL, SMALL._replace(hot=3, listed=1), SMALL._replace(hot=1, listed=0), SMALL._replace(listed=2)])
@pytest.mark.parametrize(("window", "gram"), [(12, 5), (50, 16), (8, 8)])
def test_suffixes(spark, sizes, window, gram):
    """Passages with other surroundings, near copies, periodic texts, null bytes, other scripts, shared and missing ids, repeats."""
    rnd = random.Random(8)
    passage = "".join(rnd.choices("abcdefgh ", k=90))
    base = "".join(rnd.choices("xyz漢é\0 ", k=400))
    near = lambda: "".join(rnd.choice("Q\0") if rnd.random() < 0.01 else c for c in base)
    texts = [None, "", "short", "ab" * 150, "a" * 200, passage, passage, base, base, *(near() for _ in range(12))]
    texts += ["".join(rnd.choices("uvw", k=rnd.randint(0, 60))) + passage[rnd.randint(0, 9) : 60 + rnd.randint(0, 30)] + "".join(rnd.choices("mno", k=rnd.randint(0, 60))) for _ in range(25)]
    texts += ["\0" * 70, "\0" * 80 + "z", "".join(rnd.choices("ab", k=3000))]
    rows = [(rnd.choice([None, *range(40)]), t) for t in texts for _ in range(rnd.choice([1, 1, 2]))]
    rows += rows[5:8]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, hot string").repartition(3)
    got = suffix_dedup.remove_copies(df, window, gram, sizes=sizes)
    assert Counter(map(tuple, got.collect())) == copies_by_force(rows, window)


def test_suffixes_of_odd_tables(spark):
    df = spark.createDataFrame([(2, "q" * 60 + "w" * 9), (1, "q" * 55), (2, None)], "doc_id int, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_copies(df, with_bytes=True).collect()}
    assert got == {(2, 69): (60, 1, b"w" * 9), (1, 55): (0, 0, b"q" * 55), (2, 0): (0, 0, b"")}
    assert suffix_dedup.remove_copies(df.limit(0)).count() == 0
    assert suffix_dedup.remove_copies(df.where("text is null")).count() == 1
    with pytest.raises(ValueError):
        suffix_dedup.remove_copies(df, window=300)


def test_loser_tree_never_compares_known_prefixes(monkeypatch):
    rnd = random.Random(9)
    plain, seen = suffix_dedup.first_difference, []

    def watched(a, b, known):
        assert a[:known] == b[:known]
        seen.append(max(1, plain(a, b, known) - known))
        return plain(a, b, known)

    for k in (0, 1, 2, 3, 7, 16):
        strings = ["".join(rnd.choices("ab", k=rnd.randint(0, 12))).encode() + b"c" * rnd.choice([0, 40]) for _ in range(60 * k)]
        runs = [sorted(strings[i::k]) for i in range(k)]
        coded = []
        for n, r in enumerate(runs):
            shared, rest = suffix_dedup.front_coded(r)
            assert b"".join(rest) == b"".join(s[c:] for s, c in zip(r, shared, strict=True))
            coded.append(iter([(c, s, (n, s)) for c, s in zip(shared, r, strict=True)]))
        monkeypatch.setattr(suffix_dedup, "first_difference", watched)
        got = list(suffix_dedup.LoserTree(coded))
        monkeypatch.setattr(suffix_dedup, "first_difference", plain)
        assert [s for _, (_, s) in got] == sorted(strings)
        out = [s for _, (_, s) in got]
        assert [c for c, _ in got] == [0, *(plain(a, b, 0) for a, b in zip(out, out[1:], strict=False))][: len(out)]
    assert sum(seen) < 0.6 * sum(map(len, strings)) * 4  # each of 16 runs' strings passes four matches
