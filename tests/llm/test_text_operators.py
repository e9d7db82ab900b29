"""Operators on texts against the libraries they follow and against brute force."""
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm import bpe, common, linking, minhash, mixture, ngram_join, pieces, pii, quality, ring_shards, substring_dedup, token_files, topk_search

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "  a", "a  b ", "a \n b", "it's we'll\n\n", "\ta\r\nb", "ab" * 300, "<|endoftext|>", "x <|endoftext|>y", "😀 éé　x", "don't'S", "\x85\x1c 1"]


def frame(spark, texts, extra=True):
    rows = [(i, t, "de", f"s{i % 3}", None, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long")
    return df if extra else df.select("doc_id", "text")


def test_encoding_follows_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    parts = [*" \n\t'sab1é.!　 tT", "<|endoftext|>", "'re"]
    texts = [*ODD, *("".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(300)), None]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, texts), PATH, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(frame(spark, []), PATH).count() == 0


def test_encoding_of_odd_tables(spark):
    """Repeated rows, rows without ids, a very long piece and clashing columns; and what a vocabulary may not ask for."""
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "漢" * 20_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tok = Tokenizer.from_file(PATH)
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    out = bpe.encode(df, PATH, with_ids=True)
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want
    assert Counter((r.doc_id, r.text) for r in bpe.decode(out, PATH).collect()) == Counter((i, t or "") for i, t, _ in rows)
    blocks = token_files.index(token_files.write(df, PATH)).collect()
    assert Counter((r.doc_id, r.n_tokens - 1) for r in blocks) == want and min(r.start for r in blocks if r.doc_id is None) == 0
    assert token_files.index(token_files.write(df.limit(0), PATH)).count() == 0
    spec = json.load(open(PATH))
    pieces.supported(spec)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}), ("added_tokens", [{"id": 1, "content": "x", "lstrip": True}])):
        with pytest.raises(ValueError):
            pieces.supported(spec | {key: value})


def test_packing_round_trip():
    rnd = np.random.default_rng(1)
    for width in (1, 7, 16, 17, 31):
        ids = rnd.integers(0, 1 << width, 999).astype(np.uint32)
        data = token_files.pack(ids, width)
        assert (token_files.unpack(data, width, 0, 999) == ids).all()
        assert (token_files.unpack(data, width, 333, 340) == ids[333:340]).all()


def test_token_files(spark):
    tok = Tokenizer.from_file(PATH)
    texts = [*ODD, None, "w " * 3000]
    blocks = token_files.write(frame(spark, texts), PATH, block_ids=500)
    got = token_files.index(blocks).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, texts, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.ids for r in token_files.fetch(blocks, [3]).collect()] == [[*tok.encode(texts[3], add_special_tokens=False).ids, 0]]


def repeats(texts, window):
    ws = [WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in ws for k in range(len(w) - window + 1))
    out = []
    for i, w in enumerate(ws):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def removed(spark, texts, window=12, anchor=5):
    return sorted(tuple(r) for r in substring_dedup.remove_repeats(frame(spark, texts), window, anchor).collect())


@pytest.mark.parametrize("paired", [64, 2, 0])
def test_repeats(spark, monkeypatch, paired):
    """Periodic texts, many short repeats, passages, by extension alone, by both ways, and by windows alone."""
    monkeypatch.setattr(substring_dedup, "PAIRED", paired)
    monkeypatch.setattr(substring_dedup, "AT_ONCE", 50)
    rnd = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [" ".join(rnd.choices("ab", k=rnd.randint(0, 300))) for _ in range(25)] + ["a " * 200, None, "", "x y " * 40, f"k {passage} l", f"m {passage[:120]} n", passage, passage]
    texts += [f"u{i} {' '.join(f'p{k}' for k in range(i, i + 16))} v{i}" for i in range(12)] + ["same words " * 30, "x y z " * 20]
    assert removed(spark, texts) == repeats(texts, 12)


def test_repeats_of_odd_tables(spark):
    """Shared ids with different texts, rows without ids, repeated rows, clashing columns, a very long text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (None, f"z {b}"), (None, "n " * 5), (4, None), (5, " ".join(f"l{i}" for i in range(30_000)))]
    df = spark.createDataFrame([(*r, 1, [2], "x") for r in rows], "doc_id long, text string, key int, whole array<int>, parts string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(0, 5, 0), (0, 61, 60), (1, 60, 60), (1, 60, 60), (2, 60, 60), (3, 60, 60), (3, 60, 60), (4, 0, 0), (5, 30_000, 0)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def classes_by_force(texts, size, percent):
    sets = []
    for t in texts:
        w = WORDS.findall(t or "")
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    of = list(range(len(texts)))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                of[max(x, y)] = min(x, y)
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (5, 60), (2, 50)])
def test_near_classes(spark, monkeypatch, size, percent):
    monkeypatch.setattr(linking, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
    texts = [None, "", "a b", "a b", "a", " \n ", "solo text of its own"]
    for _ in range(80):
        w = list(base)
        for _ in range(rnd.randint(0, 8 if percent > 60 else 24)):
            w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 10**6)}"
        texts.append(" ".join(w[: rnd.randint(60, 150)] if percent <= 60 else w))
    got = sorted(tuple(r) for r in ngram_join.near_classes(frame(spark, texts), size, percent).collect())
    assert got == classes_by_force(texts, size, percent)


def test_near_classes_across_bands(spark, monkeypatch):
    """Sets of two size bands, whose sketches differ in width, in Spark's pairs and in tiles."""
    rnd = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"v{rnd.randint(0, 10**6)}" for _ in range(305)]
        texts += [" ".join(base + [f"y{rnd.randint(0, 10**6)}" for _ in range(n)]) for n in (0, 20, 30, 60, 90)]
    want = classes_by_force(texts, 5, 80)
    for small in (24, 1):
        monkeypatch.setattr(linking, "SMALL", small)
        got = sorted(tuple(r) for r in ngram_join.near_classes(frame(spark, texts), 5, 80).collect())
        assert got == want
    assert {np.sign(n - 316) for _, n, _ in want} == {-1, 1}


def test_near_classes_of_odd_tables(spark, monkeypatch):
    """Shared ids, repeated rows, rows without ids, and both ways to meet a table of ids."""
    with pytest.raises(ValueError):
        ngram_join.bands(49)
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} z"), (3, f"{b} z"), (3, f"{b} z"), (None, f"{a} y"), (None, "only here " * 9), (4, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, own int, node string")
    for most in (1_000_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = Counter((r.doc_id, r.component_id) for r in ngram_join.near_classes(df, 5, 80).collect())
        assert got == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 2, (None, 1): 1, (None, None): 1, (4, 4): 3})
        kept = ngram_join.keep_one(df, 5, 80)
        assert kept.columns == df.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (None, rows[6][1]), (4, None), (4, ""), (4, "")])
    assert ngram_join.near_classes(df.limit(0)).count() == ngram_join.keep_one(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(7, a, "p"), (7, a, "q"), (8, "long " * 100_000, "r")], "doc_id long, text string, more string")
    assert [r.doc_id for r in ngram_join.keep_one(twins).orderBy("doc_id").collect()] == [7, 8]


def hashed(text, count=128):
    """A MinHash signature word by word and permutation by permutation, of shingles hashed as the library does."""
    data = (text or "").encode()
    h, _ = common.shingles(common.words(np.frombuffer(data, np.uint8), np.array([0, len(data)])), 5)
    xs = [int(v) >> 32 for v in common.mix(h, 21)]
    factors, offsets = minhash.permutations(count, 1)
    return [min(((x * int(a) + int(b)) % 2**32 for x in xs), default=2**32 - 1) for a, b in zip(factors, offsets, strict=True)]


def test_minhash(spark, monkeypatch):
    texts = ["a b c d e f g h", None, "", "k l m n o p q r s t", "k l m n o p q r s t", "é " * 40, "one two three four five six " * 30, "w " * 50_000]
    df = frame(spark, texts).withColumn("own", F.lit("x")).withColumn("bucket", F.lit(1))
    got = minhash.fingerprints(df).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        t, n = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        mine, changed, after = hashed(t), hashed(edited), hashed(n)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:08x}" for x in mine) and r.edited_fingerprint == "".join(f"{x:08x}" for x in changed)
        assert r.near_edited == sum(x == y for x, y in zip(mine, changed)) / 128
        assert r.near_next == sum(x == y for x, y in zip(mine, after)) / 128
    assert got[1].near_next == 1 and got[3].near_next == 1 and got[0].near_next == 0
    assert minhash.fingerprints(frame(spark, [])).count() == 0
    # Rows without id come first; rows that repeat follow each other.
    rows = [(5, "p q"), (None, "a b"), (5, "p q"), (2, "m n")]
    odd = minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.near_next) for r in odd) == [(0, 0.0), (2, 0.0), (5, 0.0), (5, 1.0)]


def test_minhash_bands_find_near_copies(spark, monkeypatch):
    """Recall against brute force, with groups of one band compared in tiles."""
    monkeypatch.setattr(linking, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rnd = random.Random(15)
    texts = [None, "", "a b", "a b"]
    for _ in range(6):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 10**6)}"
            texts.append(" ".join(w))
    docs = frame(spark, texts)
    linked = {r.own: r.component_id for r in minhash.near_duplicates(docs).collect()}
    own = {r.doc_id: r.own for r in ngram_join._rows(docs).collect()}
    got = {i: linked.get(own[i], i) for i in own}
    want = {i: top for i, _, top in classes_by_force(texts, 5, 80)}
    joined = {(i, j) for i in want for j in want if i < j and want[i] == want[j]}
    found = {(i, j) for i in got for j in got if i < j and got[i] == got[j]}
    assert found <= joined and len(found) >= 0.99 * len(joined) and len(joined) > 300


def best_by_force(rows, every, k):
    """Exact products of floor(1024 x) in whole numbers; rows (vec_id, vector) that take part."""
    low, high = -(2**63) + 1, 2**63 - 1
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: w for i, w in sorted(good, reverse=True) if i % every == 0}.items():
        best = sorted((-max(low, min(high, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def searched(spark, rows, every=100, k=10, kind="double"):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, block string, score int").repartition(3)
    return sorted(tuple(r) for r in topk_search.top_k(df, every, k).collect())


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "STEP", 64)
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.choice([-0.5, 0.25, 0.75], 4)]) for i in range(300)] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (None, [1.0] * 4)]
    rows += [(200, rows[200][1]), (7, rows[7][1]), (310, []), (311, [0.5] * 9)]
    assert searched(spark, rows, kind="float") == best_by_force(rows, 100, 10)
    assert searched(spark, rows[:5], every=2) == best_by_force(rows[:5], 2, 10)
    assert searched(spark, rows[:1]) == searched(spark, []) == []


def test_top_k_refines_until_the_kth_score_is_located(spark, monkeypatch):
    """500 vectors take more than one round; many ties, a query of equal scores only, and scores one apart."""
    rounds = []
    plain = topk_search._round
    monkeypatch.setattr(topk_search, "_round", lambda *a: rounds.append(1) or plain(*a))
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    rnd = np.random.default_rng(3)
    unit = rnd.normal(size=(500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(unit / np.linalg.norm(unit, axis=1, keepdims=True))]
    assert searched(spark, rows, every=50, kind="float") == best_by_force([(i, np.float32(v).tolist()) for i, v in rows], 50, 10)
    assert len(rounds) > 1
    near = random.Random(11)
    edge = [1, 26000, *range(25000, 25007), 15150, 14800, *[14700] * 40]
    tied = [near.choice([1, 2, 3, 700, 26000]) if i % 20 == 0 else near.choice([5, 6, 7, *range(1, 400, 3), 25990]) for i in range(400)]
    flat = [0.25] * 60
    for values, every in ((edge, 100), (tied, 20), (flat, 30)):
        rows = [(i, [v / 1024]) for i, v in enumerate(values)]
        assert searched(spark, rows, every) == best_by_force(rows, every, 10)


def test_top_k_of_large_components(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows[20] = (20, [1e10, *rows[20][1][1:]])  # its product with itself is beyond a long
    rows[33] = (33, [3e9, -2e9, 1e9, 0.0, 1.0, 5e8])
    assert searched(spark, rows, every=10) == best_by_force(rows, 10, 10)
    rows[40], rows[41], rows[42] = (40, [1e200] * 6), (41, [-1e200, 1e200, 1.0, 0.0, 0.0, 0.0]), (42, [1e300] * 6)
    assert searched(spark, rows, every=10) == best_by_force(rows, 10, 10)


def test_ring(spark):
    texts = ["same"] * 40 + [f"t{i}" for i in range(37)] + [None, "", "l " * 100_000]
    rows = [(i, t, "x", i, None) for i, t in enumerate(texts)] + [(None, "t1", "x", 0, None), (3, "same", "x", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, arc string, size long, shard int")
    got = ring_shards.shard_rows(df, shards=4).toPandas()
    assert len(got) == len(rows) and sorted(got.groupby("shard").size()) == [20, 20, 21, 21]
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    by = {r.doc_id: r for r in got.itertuples()}
    assert by[39].size == 5 and by[77].size == by[78].size == 1 and by[79].size == 200_001 and by[40].text_crc32 == zlib.crc32(b"t0")
    assert ring_shards.shard_rows(frame(spark, [])).count() == 0


def test_ring_places_arcs_as_keys_would_walk():
    """Parts of arcs against single keys that walk clockwise, in the same waves."""
    rnd = random.Random(17)
    for shards in (3, 8):
        arcs, owners = ring_shards.ring(shards, 16, 7)
        assert len(arcs) == ring_shards.CELLS and set(arcs) == set(range(len(owners)))
        counts = [rnd.choice([0, 1, 3, 60]) for _ in owners]
        n = sum(counts)
        room = [n // shards + (s < n % shards) for s in range(shards)]
        keys, left, at = [(a, k, a) for a, c in enumerate(counts) for k in range(c)], list(room), {}
        while keys:
            later = []
            for a, k, node in keys:
                s = owners[node]
                if left[s]:
                    left[s] -= 1
                    at[a, k] = s
                else:
                    later.append((a, k, (node + 1) % len(owners)))
            keys = later
        moves = ring_shards.place(counts, owners, room)
        assert {(a, k): s for a, lo, hi, s, _ in moves for k in range(lo, hi)} == at
        slots = Counter((s, slot + i) for a, lo, hi, s, slot in moves for i in range(hi - lo))
        assert max(slots.values()) == 1 and all(sum(1 for s, _ in slots if s == x) == room[x] for x in range(shards))


def test_ring_moves_few_rows(spark):
    """One more shard: what moves is not much more than its share, and most equal texts stay together."""
    texts = [f"text {i % 900}" for i in range(2700)]
    docs = frame(spark, texts)
    a, b = ({(r.doc_id): r.shard for r in ring_shards.shard_rows(docs, shards=n).collect()} for n in (8, 9))
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert 1 / 9 <= moved < 0.2
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, set()).add(a[i])
    assert sum(len(g) > 1 for g in groups.values()) < 30


def seats_by_force(weights, n):
    """Seat after seat to the highest quotient, ties to the first."""
    got = [0] * len(weights)
    for _ in range(n):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_quotas_are_sainte_lague(spark):
    rnd = random.Random(12)
    for weights, n in ([rnd.randint(1, 10**6) for _ in range(7)], 200), ([rnd.randint(1, 30) for _ in range(25)], 40), ([5, 5, 5, 1], 6), ([3.0], 9), ([2, 2], 0):
        df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "k int, w double")
        got = [r.quota for r in mixture.quotas(df, "w", F.lit(n), [], ["k"]).orderBy("k").collect()]
        assert got == seats_by_force(weights, n)


def test_mix(spark):
    texts = ["one two three"] * 30 + [None, "", "x " * 500, "y " * 100]
    got = mixture.mix(frame(spark, texts), block=4).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), n=("source_size", "first"))
    assert ((by.taken - by.target).abs() <= 16).all() and (by.target <= 2 * by.n).all()
    out = mixture.mixed(frame(spark, texts).withColumn("size", F.lit("own")).withColumn("TAKEN", F.lit(1)), block=4)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "size", "TAKEN"]
    assert {r.text for r in out.collect()} <= {*texts} and out.where("text is null").count() == 1 and out.where("size <> 'own'").isEmpty()
    assert mixture.mix(frame(spark, [])).count() == mixture.mixed(frame(spark, [])).count() == 0


def test_mix_of_equal_rows(spark):
    """Copies of a row are taken one by one; whole texts come out as often as each row's taken words make, halves up."""
    rnd = random.Random(21)
    rows = [(7, "a b c", "one", k) for k in range(5)] + [(7, "a b c", None, 9), (None, "d e f g h", "one", 1), (None, "d e f g h", "one", 1), (None, None, None, None), (None, None, None, None)]
    rows += [(rnd.randint(20, 30), " ".join("w" * rnd.randint(1, 9)), rnd.choice(["one", "two", None]), k) for k in range(120)] * 2
    rows += [(3, "hot " * 4, "two", k) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, S int").repartition(7)
    for portion in 1.5, 0.4:
        got = mixture.mix(docs, portion, block=4).toPandas()
        by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), n=("source_size", "first"), rows=("size", "sum"))
        assert (by.n == by.rows).all() and ((by.taken - by.target).abs() <= 16).all() and (got.taken <= 2 * got["size"]).all()
        # By doc_id, source and number of words, as mix() gives no texts; these have one text of each length.
        want = Counter()
        for r in mixture.mix(docs, portion, block=4).collect():
            want[r.doc_id, r.source, r["size"]] += 1 if r["size"] == 0 else (2 * r.taken + r["size"]) // (2 * r["size"])
        out = mixture.mixed(docs, portion, block=4)
        out = out.collect()
        assert Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out) == Counter({k: n for k, n in want.items() if n})
        # No row comes out twice more often than one that equals it.
        times = Counter((r.doc_id, r.source, r.text, r.S) for r in out)
        had = Counter(rows)
        same = {}
        for (i, t, s, mark), n in had.items():
            same.setdefault((i, s, t), []).append((times[i, s, t, mark], n))
        for got_of in same.values():
            low = min(n_out // n for n_out, n in got_of)
            assert all(low * n <= n_out <= (low + 1) * n for n_out, n in got_of)


def test_mix_of_small_sources(spark):
    """Twelve sources of one document of three words: each comes within a word of its target."""
    rows = [(i, "a b c", f"s{i:02}") for i in range(12)]
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in got) and {r.taken > 0 for r in got} == {True}
    # One small source beside a large one, and null sources.
    rows = [(i, "w " * 900, "big") for i in range(50)] + [(99, "a b", "tiny"), (100, "c d e f", None), (101, None, "void")]
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 2).all() and (got.taken <= 2 * got["size"]).all()


def test_mix_deals_a_full_shards_surplus(spark):
    df = spark.createDataFrame([(1, 0, 5, 10, 3), (1, 1, 100, 10, 3), (1, 2, 4, 10, 3), (2, 0, 1, 5, 3), (2, 1, 1, 0, 3)], "k int, shard long, shard_size long, quota long, block long")
    got = {(r.k, r.shard): r.words for r in mixture._within(df, 2.0).collect()}
    assert got == {(1, 0): 10, (1, 1): 30 + 20 + 22, (1, 2): 8, (2, 0): 2, (2, 1): 2}


def test_pii(spark):
    texts = ["Mr. John Smith and Mrs. Ann Smith: jo.1@mail.example.com, JO.1@MAIL.EXAMPLE.COM", "call +1 (017) 555-7713 or +1 017 555 7713", "4111-1111-1111-1111 from 12.84.156.107", 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"!', None, "", "clean text, version 3."]
    out = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, texts), b"k").collect()}
    assert out[4] is None and out[5] == "" and out[6] == texts[6]
    for secret in ("Smith", "John", "jo.1@", "JO.1@", "555-7713", "1111-1111", "12.84", "9233a8"):
        assert not any(secret in (t or "") for t in out.values())
    words = out[0].split()
    assert words[2] == words[6].rstrip(":") and words[7].rstrip(",").upper() == words[8]
    assert pii.luhn(re.sub(r"\D", "", out[2].split()[0]))
    assert re.sub(r"\d", "9", out[1]) == re.sub(r"\d", "9", texts[1])


def pseudonyms(spark, texts, key=b"k"):
    return [r.text for r in pii.pseudonymise(frame(spark, texts), key).orderBy("doc_id").collect()]


def test_pii_distinct(spark, monkeypatch):
    # Two-letter given names leave few surrogates, so some clash and have to move.
    texts = [f"Mr. {a}{b} Qq" for a in "BCDFGHJK" for b in "aeiouyrlnm"] * 2
    a = pseudonyms(spark, texts)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert pseudonyms(spark, texts) == a and len(set(a)) == 80 and a[:80] == a[80:]


def test_pii_fills_small_spaces_and_ends(spark):
    """Every address of a private network, and names whose room is a handful of letters."""
    texts = [" ".join(f"192.168.{a}.{b}" for b in range(256)) for a in range(256)] + ["Tel. " + f"{n:06}" for n in range(300)]
    got = pseudonyms(spark, texts)
    space = {x for t in got[:256] for x in t.split()}
    assert space == {f"192.168.{a}.{b}" for a in range(256) for b in range(256)}
    assert not any(x == y for t, u in zip(texts, got) for x, y in zip(t.split(), u.split()) if x[0].isdigit())
    assert len(set(got[256:])) == 300
    letters = [f"{x}@y.example.com" for x in "abcdefghijklmnopqrstuvwxyz"]
    got = pseudonyms(spark, letters)
    assert len(set(got)) == 26 and not set(got) & set(letters)


def test_permutations_have_no_fixed_points():
    for size in (2, 3, 7, 64, 1000):
        image = [pii.other(b"k", "s", x, size) for x in range(size)]
        assert sorted(image) == list(range(size)) and all(x != y for x, y in enumerate(image))
    cards = {pii.surrogate(b"k", "card", f"411111111111{n:04}") for n in range(2000)}
    assert len(cards) == 2000
    assert all(pii.luhn(pii.surrogate(b"k", "card", c)) == pii.luhn(c) for c in sorted(cards)[:200])
    assert pii._mod97(pii.surrogate(b"k", "iban", "DE89370400440532013000")) == 1


ENTITIES = {
    "email": ["ann.lee@mail.example.com", "JO_1@X.ORG", "ü.ö@post.de"], "ip": ["8.8.8.8", "10.0.0.7"], "ip6": ["2001:db8::1f", "FE80::1:2:3"],
    "card": ["4111 1111 1111 1111", "4111111111111111"], "ssn": ["078-05-1120"], "iban": ["DE89 3704 0044 0532 0130 00"],
    "phone": ["+49 30 1234567", "(017) 555-7713", "Tel. 030 1234567", "Phone: 030/98 76 54", "Fax no. 55 12 34 56"],
    "secret": ["9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "password: hunter2222", 'api_key="abcdefgh-12"', '"token": "ABCDEFGH12345678"', "pwd=Tr0ub4dor&3"],
    "name": ["Mr. John Paul Smith", "MS. LEE", "Dr. Jane Doe", "Mrs. Ana de la Cruz", "Herr von Neumann", "Señora Juana García López", "Prof. Dr. Weber", "Доктор Иван Петров", "Κύριος Νίκος Παππάς",
             "王小明先生", "陈美丽女士", "田中さん", "김철수 씨", "Mr. J. Smith"],
}


def test_pii_recall_by_type_and_script(spark):
    """Each entity alone in a text, and again with words around it: no part of it is left, and the format is kept."""
    rows = [(kind, f"{before}{x}{after}") for kind, xs in ENTITIES.items() for x in xs for before, after in (("", ""), ("so it was ", ", then no more"))]
    got = pii.pseudonymise(frame(spark, [t for _, t in rows]), b"k").orderBy("doc_id").collect()
    labels = {"Tel", "Phone", "Fax", "no", "password", "api_key", "token", "pwd", "so", "it", "was", "then", "more", "de", "la", "von", "J", "씨", "example", "com", "org", "ORG"} | {w.strip(".") for t in (*pii._TITLES, *pii._NEUTRAL) for w in (t, t.upper())}
    for (kind, text), r in zip(rows, got, strict=True):
        assert r.n_entities, text
        for word in re.findall(r"\w{2,}", text):
            for h in pii._HONORIFICS:
                word = word.removesuffix(h)
            if word not in labels and not word.isdigit() and len(word) > 2:
                assert word not in re.findall(r"\w+", r.text), (text, r.text)
        if kind in ("card", "ssn", "iban", "phone"):
            assert re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", text) and r.text != text
    clean = ["plain words, version 3.", "It ran at 12:30:45 on 2024-01-05.", "std::add and x::y", "password: required", "He said Hello World to us", "section 1.2.3.4.5 of 10"]
    assert pseudonyms(spark, clean) == clean


def test_pii_names_that_the_corpus_teaches(spark):
    texts = ["Mr. John Smith came", "Mrs. Ann Lee and Mr. John Doe", "yesterday John Miller spoke; then Miller left", "we saw Ann Taylor there", "they met Karl Weber again"]
    got = pseudonyms(spark, texts)
    john = re.search(r"Mr\. (\w+)", got[0])[1]
    given, family = re.search(r"yesterday (\w+) (\w+) spoke", got[2]).groups()
    assert given == john and family != "Miller" and got[2].endswith(f"then {family} left")
    assert got[3:] == texts[3:]  # Ann is taught by one text only, Karl by none


def test_pii_phones_have_one_form(spark):
    """Spellings of a number in different texts take one surrogate, in the spelling's own format; other numbers take others."""
    same = [["+1 415 555 1234", "+14155551234", "415-555-1234", "(415) 555-1234", "Tel: 415 555 1234", "Tel: 1-415-555-1234"], ["+49301234567", "+49 30 1234567", "+49 (0)30 1234567"], ["+886 912 345 678", "+886912345678"], ["0912-345-678", "Tel. 0912345678"], ["(017) 555-7713", "+1 017 555 7713"]]
    texts = [(k, f"{'Tel: ' if '(0)' in x else ''}{x}") for k, xs in enumerate(same) for x in xs]
    got = pseudonyms(spark, [t for _, t in texts])
    digits = lambda t, n: re.sub(r"\D", "", t.replace("(0)", ""))[-n:]
    seen = {}
    for (k, t), u in zip(texts, got, strict=True):
        assert re.sub(r"\d", "9", u) == re.sub(r"\d", "9", t) and ("(0)" in t) == ("(0)" in u)
        code = {0: "1", 1: "49", 2: "886", 4: "1"}.get(k, "")
        assert digits(u, 99).startswith(code) or len(digits(t, 99)) == 10
        n = len(digits(same[k][0], 99).removeprefix(code)) if "+" in same[k][0] else 10
        seen.setdefault(k, set()).add(digits(u, n))
        assert digits(u, n) != digits(t, n)
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(same)
    # The numbers of a space go to different ones, whether an area may start so or not.
    made = [pii.surrogate(b"k", "phone", f"+1 {a}15{b}550000") for a in range(10) for b in range(10)]
    assert len(set(made)) == 100


def test_pii_names_are_one_in_all_texts(spark):
    """One surrogate for a name part whatever it stands behind; gender and place in the name are those of most texts."""
    texts = ["Dr. John Smith came", "Mr. John Smith came", "Mr. John called", "Mr. John Doe came", "Mrs. Kim Doe came", "Dr. Kim Roe came", "Mr. Kim came", "Ms. Kim Poe came"]
    got = pseudonyms(spark, texts)
    name = lambda k: got[k].split()[1:-1]
    assert len({name(k)[0] for k in (0, 1, 2, 3)}) == 1 and name(0) == name(1)
    assert name(0)[0][-1] == "o" and len({name(k)[0] for k in (4, 5, 6, 7)}) == 1 and name(4)[0][-1] == "a"
    assert name(3)[1] == name(4)[1] and len({w for k in range(8) for w in name(k)}) == 6
    assert [t.split()[0] for t in got] == [t.split()[0] for t in texts]


def test_pii_chinese_family_names(spark):
    """Family names and given names apart: those of one family stay one, persons stay distinct."""
    given = ["大明", "小明", "志強", "美", "建國"]
    texts = [f"{f}{g}先生" for f in "王李歐" for g in given] + ["王大明先生"]
    got = [t.removesuffix("先生") for t in pseudonyms(spark, texts)]
    assert len(set(got)) == 15 and got[0] == got[15] and not set(got) & {t.removesuffix("先生") for t in texts}
    for k in range(3):
        assert len({x[0] for x in got[5 * k : 5 * k + 5]}) == 1
    assert all(x[0] in pii._HAN_FAMILY and set(x[1:]) <= set(pii._HAN_GIVEN["m"]) for x in got)
    crowd = pseudonyms(spark, [f"王{chr(0x5000 + k)}{chr(0x6000 + k)}女士" for k in range(900)])
    assert len(set(crowd)) == 900  # more than there are given names of two characters: the later ones are longer


def test_pii_of_odd_tables(spark):
    """Clashing columns, nulls, repeated rows, a very long text and no rows."""
    long = "word " * 200_000 + "Mr. John Smith"
    rows = [(1, "Mr. Tom Roe", 1, "a", "x", 2), (1, "Mr. Tom Roe", 1, "a", "x", 2), (None, None, None, None, None, None), (3, "", 0, "", "", 0), (4, long, 1, "b", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int, names string, value string, n_entities int")
    out = pii.pseudonymise(df, b"k")
    assert out.columns == ["doc_id", "text", "h", "names", "value", "n_entities"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[1][0].h == 1 and "Roe" not in got[1][0].text
    assert got[None][0].text is None and got[3][0].text == "" and got[4][0].text.startswith("word word") and "Smith" not in got[4][0].text
    assert pii.pseudonymise(df.limit(0), b"k").count() == 0


def test_pii_labels_and_mentions(spark):
    texts = [
        'password = "correct-horse-battery" stays secret',
        "Dr. John Smith and Prof. Dr. Ann Lee met. Herr Dr. Weber came.",
        "Smith called first. Mr. John Smith called. Smith's wife said JOHN and Smith-like. Blacksmith, smith and Johnson stay.",
        "Dr. John Smith wrote to Mr. John Smith's office; see smith@mail.example.com.",
        "Dr. J came. J is a letter, Drive and Drs stay, Dr. no one too.",
    ]
    out = [r.text for r in pii.pseudonymise(frame(spark, texts), b"k").orderBy("doc_id").collect()]
    assert re.fullmatch(r'password = "[a-z]{7}-[a-z]{5}-[a-z]{7}" stays secret', out[0]) and "horse" not in out[0]
    for name in ("John", "Smith", "Ann", "Lee", "Weber"):
        assert not re.search(rf"\b{name}\b", " ".join(out))
    assert out[1].count("Dr. ") == 3 and "Prof. Dr. " in out[1] and "Herr Dr. " in out[1]
    given, family = re.search(r"Mr\. (\w+) (\w+) called", out[2]).groups()
    assert out[2] == f"{family} called first. Mr. {given} {family} called. {family}'s wife said {given.upper()} and {family}-like. Blacksmith, smith and Johnson stay."
    assert out[3].startswith(f"Dr. {given} {family} wrote to Mr. {given} {family}'s office; see ")
    assert out[4].endswith(" came. J is a letter, Drive and Drs stay, Dr. no one too.")


def test_quality_model_by_force():
    """Scores entry by entry, and the first steps of trees and pairs against every split."""
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(300, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x, y, bins=8, rounds=5, pairs=3, pair_rounds=20)
    assert 0 < len(model.pairs) <= 3 and (0, 3) in {tuple(sorted(p)) for p in model.pairs}
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        place = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, place, strict=True)) + sum(t[place[i], place[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(1 / (1 + math.exp(-total)) - score) < 1e-12
    g, h = rnd.normal(size=9), rnd.uniform(0.5, 2, 9)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cut = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
    want = np.where(np.arange(9) < cut, g[:cut].sum() / (h[:cut].sum() + 1), g[cut:].sum() / (h[cut:].sum() + 1))
    assert np.allclose(quality._tree(g, h, 1, 0.0), want)
    G, H = rnd.normal(size=(4, 5)), rnd.uniform(0.5, 2, (4, 5))
    parts = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
    i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda ij: sum(G[p].sum() ** 2 / (H[p].sum() + 1) for p in parts(*ij)))
    got, _ = quality._cross(G, H, 0.0)
    assert all(np.allclose(got[p], G[p].sum() / (H[p].sum() + 1)) for p in parts(i, j))


def test_quality_of_odd_tables(spark):
    """Nulls, repeated rows and labels, very long texts and no rows; the score takes nothing but the text."""
    rows = [(1, None, "de", "s", 2.0), (1, "", "en", "t", None), (None, "some words here", "x", None, 1.0), (2, "some words here", "y", "u", 0.5), (2, "some words here", "y", "u", 0.5), (3, "long words " * 100_000, "z", "v", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (2, None), (None, 1), (9, 5)], "doc_id long, quality int")
    model = quality.learn(df, labels)
    got = quality.scored(df, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (None, 2)}) == 1 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.keep_good(df, model, 0.0).columns == df.columns and quality.keep_good(df, model, 0.0).count() == 6
    assert quality.scored(df.limit(0), model).count() == quality.keep_good(df.limit(0), model).count() == 0


def test_quality(spark):
    rnd = random.Random(6)
    good = [" ".join(rnd.choices(["the", "then", "of", "and", "other", "words"], k=60)) + "." for _ in range(150)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    texts = [*good, *bad, None, ""]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    model = quality.learn(docs, labels)
    got = quality.scored(docs, model).toPandas().sort_values("doc_id")
    held = got[got.held_out & (got.doc_id < 300)]
    assert len(held) and (held.predicted == (held.doc_id < 150)).all()
    assert got.score.between(0, 1).all() and len(got) == len(texts)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 150").count() == 150
    none = quality.learn(docs, labels.limit(0))
    assert quality.scored(docs, none).count() == len(texts)


def test_pipeline_stages(spark):
    """Each stage behind quality against brute force; the mixture against the words that mix() takes."""
    import corpus_pipeline as c

    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(60)]
    texts = [None, "", "a b", "call +1 017 555 7713", "Dr. Ann Lee and Lee, 10.0.0.7"]
    for _ in range(30):
        w = list(base) if rnd.random() < 0.5 else [f"v{rnd.randint(0, 900)}" for _ in range(rnd.randint(1, 90))]
        w[rnd.randrange(len(w))] = "other"
        texts.append("\n".join(w))
    docs = frame(spark, texts)
    kept = {r.doc_id for r in c.near_copies_stage(spark, docs, None).collect()}
    assert kept == {top for _, _, top in classes_by_force(texts, 5, 80)} and len(kept) < len(texts)
    own = {r.doc_id: r for r in c.personal_stage(spark, docs, None).collect()}
    for i, t in enumerate(texts):
        want = pii.rewrite(t, pii.EXAMPLE_KEY, {})[0] if t else t
        assert (own[i].text, own[i].n_chars) == (want, None if want is None else len(want))
    mixed = Counter(r.doc_id for r in c.mixture_stage(spark, docs, None).collect())
    want = {r.doc_id: 1 if r["size"] == 0 else (2 * r.taken + r["size"]) // (2 * r["size"]) for r in mixture.mix(docs).collect()}
    assert mixed == Counter({k: n for k, n in want.items() if n})
    tok = Tokenizer.from_file(PATH)
    assert {r.doc_id: r.n_tokens for r in c.tokens_stage(spark, docs, None).collect()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_pipeline_stages_on_odd_tables(spark):
    """Repeated rows, nulls in every column, clashing names and empty tables, as stages of the pipeline get them."""
    import corpus_pipeline as c

    plain = [(1, "mail to jo.do@example.org now", "one", "jo.do@example.org", "x")] * 3
    rows = [*plain, (None, None, None, None, None), (None, None, None, None, None), (2, "", None, "jo.do@example.org", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, TOKENS string, `size` string")
    own = c.personal_stage(spark, docs, None)
    assert own.columns == docs.columns
    want = Counter((i, pii.rewrite(t, pii.EXAMPLE_KEY, {})[0] if t else t, s, a, b) for i, t, s, a, b in rows)
    assert Counter(tuple(r) for r in own.collect()) == want and not any("jo.do" in (t or "") for _, t, *_ in want)
    tok = Tokenizer.from_file(PATH)
    ids = c.tokens_stage(spark, docs, None).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in ids) == Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    for stage in c.near_copies_stage, c.personal_stage, c.mixture_stage, c.tokens_stage:
        assert stage(spark, docs.limit(0), None).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and set(out.columns) >= {"doc_id", "n_tokens"}


def test_ids_leave_a_task_before_its_batch_is_done():
    """The ids of one slice of text are held, not those of a batch, and pieces are forgotten."""
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [None if i == 7 else f"Row {i} says so. " * 60 for i in range(3000)]})
    out = list(bpe.encoded([rows], PATH, True))
    assert max(b.nbytes for b in out) < 4 * bpe.SLICE and len(out) >= rows.column("text").nbytes // bpe.SLICE
    got = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(3000)) and got[7]["ids"] == [] and all(r["n_tokens"] == len(r["ids"]) for r in got)
    own = bpe.codec(PATH)
    assert got[2999]["ids"] == own.encode("Row 2999 says so. " * 60).tolist() and own.memory.limit * 20 < 1 << 24
