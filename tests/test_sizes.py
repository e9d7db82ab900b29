"""What larger tables showed: rare rows that SQL and query have to agree on, and steps whose memory or shuffle may not grow."""
import inspect
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from docweave.operators import blocked, cases, chunks, segment
from docweave.operators import postings as P
from docweave.operators import retrieval as R
from docweave.plans import catalogue
from docweave.plans.catalogue import ORACLE, QUERIES


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over small tables (pyarrow)."""
    con = duckdb.connect()
    for n, t in tables.items():
        pq.write_table(t, f"{folder}/{n}.parquet")
        con.sql(f"create view {n} as from '{folder}/{n}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    want = con.sql(ORACLE[name]).select(",".join(f'"{c}"' for c in cols)).fetchall()
    return sorted(tuple(r) for r in df.select(*cols).collect()), sorted(want)


def test_names_that_overlap_themselves(spark, tmp_path):
    texts = {1: "x ananananana ananananan. éananananan", 2: "Ananananan ananana", 3: None, 4: "ananananananananananan"}
    names = ["ananananan", "anananananan"]
    got, want = both(spark, tmp_path, "names_in_texts", documents=pa.table({"doc_id": list(texts), "text": list(texts.values())}), benchmark=pa.table({"item_id": [1], "text": ["Ananananan, anananananan"]}))
    counts = [(d, sum(t.startswith(x, i) for i in range(len(t))), x) for d, t in texts.items() if t for x in names if x in t]
    assert got == want == sorted((d, n, x) if isinstance(got[0][1], int) else (d, x, n) for d, n, x in counts)
    assert max(n for _, n, _ in counts) == 7


def test_ties_of_similar_orders_are_exact(spark, tmp_path):
    """Similarities that lie halfway between two places, which sums of doubles put on either side."""
    orders, lines = {}, []
    for q in range(50, 50 * 120, 50):
        # 5 parts that count 1 and 7 that count 0.2 weigh 6.4; a part of them with an odd number of fifths is a tie.
        own = [5 * q + i * 1000000 + 1 for i in range(5)] + [5 * q + i * 1000000 for i in range(7)]
        orders[q] = ("low", "F")
        lines += [(q, x) for x in own]
        for b in range(1, 6):
            full, light = (q // 50 + b) % 6, (q // 50 * 3 + b) % 8
            light += (full + light + 1) % 2 * (1 if light < 7 else -1)
            orders[q + b] = (("low", "F"), ("high", "F"), ("high", "O"))[(q // 50 + b) % 3]
            lines += [(q + b, x) for x in own[:full] + own[5 : 5 + light]]
    lines = [x for _, x in sorted((hash(x) % 1009, x) for x in lines)]
    got, want = both(
        spark, tmp_path, "similar_topk", orders=pa.table({"o_orderkey": list(orders), "o_orderpriority": [p for p, _ in orders.values()], "o_orderstatus": [s for _, s in orders.values()]}),
        lineitem=pa.table({"l_orderkey": [a for a, _ in lines], "l_partkey": [b for _, b in lines]}),
    )
    parts, exact = {}, []
    for o, x in lines:
        parts.setdefault(o, set()).add(x)
    fifths = lambda xs: sum(1 if x % 5 == 0 else 5 for x in xs)
    for q in range(50, 50 * 120, 50):
        near = []
        for b in range(q + 1, q + 6):
            kind = 1500 if orders[b][0] == "low" else 900 if orders[b][1] == "F" else 0
            near.append((-((12000 * fifths(parts[b]) + 32) // 64 + kind), b))
        exact += [(q, b, i + 1, -n / 10000) for i, (n, b) in enumerate(sorted(near))]
    assert got == want == sorted(exact)


def test_pairs_of_orders_move_once(spark, tmp_path, monkeypatch):
    """Tasks are made for the number of pairs, and the rows are the same."""
    orders = pa.table({"o_orderkey": list(range(1, 301)), "o_orderpriority": ["a", "b", None] * 100, "o_orderstatus": ["F", "O"] * 150})
    lines = pa.table({"l_orderkey": [1 + i * 7 % 300 for i in range(2400)], "l_partkey": [None if i % 97 == 0 else i * i % 211 for i in range(2400)]})
    monkeypatch.setattr(catalogue, "PAIRS", 100, raising=False)
    got, want = both(spark, tmp_path, "weighted_jaccard", orders=orders, lineitem=lines)
    assert got == want and len(got) > 200
    df = QUERIES["weighted_jaccard"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= len(got) // 100
    assert df._jdf.queryExecution().executedPlan().toString().count("Join") == 1


def test_searches_make_no_row_of_a_hit(spark, monkeypatch):
    """Blocks of queries against chunks of documents give what all hits give, words that most documents have included."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    pick = lambda n: " ".join(rnd.choices(words, range(30, 0, -1), k=n))
    docs = spark.createDataFrame([(i * 7 % 401, pick(rnd.randint(0, 12)) if i % 50 else None) for i in range(200)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, pick(rnd.randint(1, 6))) for i in range(20)] + [(20, "nowhere"), (21, None)], "query_id long, text string")
    hits = R.bm25(docs, queries)
    want = {k: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect())) for k, df in (("hits", R.top(hits, ["query_id"], "score", "doc_id", 4)), ("all", R.word_top(hits, docs, queries, 200, 4)))}
    monkeypatch.setattr(R, "BLOCK", 6)
    monkeypatch.setattr(R, "STEP", 16)
    monkeypatch.delattr(R, "bm25")
    got = {"hits": R.bm25_top(docs, queries, 4), "all": R.search(docs, queries, 4)}
    assert {k: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect())) for k, df in got.items()} == want


def test_an_index_moves_texts_and_lists_only(spark, tmp_path):
    """No word of a document is a row of a shuffle: the plan that makes the lists has no explode."""
    docs = spark.createDataFrame([(i, f"a b{i % 3} a c{i}") for i in range(40)] + [(50, None), (51, " ")], "doc_id long, text string")
    source = inspect.getsource(P.save)
    P.save(docs, str(tmp_path / "index"), group=8)
    index = P.load(spark, str(tmp_path / "index"))
    assert "explode" not in source
    assert {(r.term, r.df) for r in index.terms.collect()} == {("a", 40), ("b0", 14), ("b1", 13), ("b2", 13)} | {(f"c{i}", 1) for i in range(40)}
    for r in index.postings.collect():
        assert r.docs == sorted(r.docs) and r.best == max(r.high) and r.high == sorted(r.high, reverse=True) and len(r.high) == min(10, len(r.docs))
        assert r.tfs == [2 if r.term == "a" else 1] * len(r.docs) and r.dls == [4] * len(r.docs)


def test_an_index_is_made_where_texts_are_read(spark, tmp_path):
    """Groups are documents that stand together in the input, so no shuffle deals texts or lists; a search makes no row of a hit, and reads a list once for all queries."""
    docs = spark.createDataFrame([(i * 7 % 100, f"a b{i % 3} c{i}") for i in range(60)], "doc_id long, text string").coalesce(1)
    P.save(docs, str(tmp_path / "index"), group=8)
    index = P.load(spark, str(tmp_path / "index"))
    groups = {tuple(r.docs) for r in index.postings.where("term = 'a'").collect()}
    assert groups == {tuple(sorted(i * 7 % 100 for i in range(k, min(k + 8, 60)))) for k in range(0, 60, 8)}
    asked = spark.createDataFrame([(q, f"a b{q % 3} c{q}") for q in range(30)], "query_id long, text string")
    found = P.search(index, asked, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.top(R.bm25(docs, asked), ["query_id"], "score", "doc_id", 3).collect()))


def test_an_index_adds_up_blocks_of_queries(spark, tmp_path, monkeypatch):
    """Any number of blocks, some of them without a word of a group, gives what brute force gives."""
    rnd = random.Random(9)
    docs = spark.createDataFrame([(f"d{i}", " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 5))) if i % 9 else None) for i in range(50)], "doc_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rnd.choices("abcdefghxyz", k=i % 4))) for i in range(23)], "query_id string, text string")
    P.save(docs, str(tmp_path / "index"), group=7)
    index = P.load(spark, str(tmp_path / "index"))
    monkeypatch.setattr(P, "BLOCK", 4, raising=False)
    want = R.bm25(docs, asked)
    assert sorted(map(tuple, P.scores(index, asked).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, P.search(index, asked, 2).collect())) == sorted(map(tuple, R.top(want, ["query_id"], "score", "doc_id", 2).collect()))


def test_pieces_are_cut_a_few_rows_at_a_time(spark):
    rows = spark.createDataFrame([(i, f"Line {i}.\nEnd") for i in range(chunks.ROWS * 2 + 5)], "doc_id long, text string").coalesce(1)
    got = chunks.pieces(rows).select("doc_id", "piece").collect()
    assert sorted((r.doc_id, r.piece) for r in got) == [(i, f"Line {i}.\nEnd") for i in range(chunks.ROWS * 2 + 5)]


def test_similar_orders_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks are made for the number of lines, and the rows are the same."""
    orders = pa.table({"o_orderkey": list(range(1, 301)), "o_orderpriority": ["a", "b", "c"] * 100, "o_orderstatus": ["F", "O"] * 150})
    lines = pa.table({"l_orderkey": [1 + i * 7 % 300 for i in range(2400)], "l_partkey": [i * i % 211 for i in range(2400)]})
    monkeypatch.setattr(cases, "ROWS", 200, raising=False)
    made, write = {}, catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, name: made.setdefault(name, df.rdd.getNumPartitions()) and write(df, name))
    got, want = both(spark, tmp_path, "similar_orders_topk", orders=orders, lineitem=lines)
    assert got == want and len(got) == 30
    assert made["parts"] == 12


def test_a_search_packs_its_documents_once(spark):
    """Chunks are a table that both passes read: what scores them has no other step of Python below it, and splits no text."""
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}", [float(i % 7), 1.0]) for i in range(60)], "doc_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "a b1", [1.0, 0.0]), (2, "c5 c7", None)], "query_id long, text string, q array<float>")
    for df in (R.search(docs, asked, 3), R.bm25_top(docs, asked, 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "xxhash64" not in plan
        assert df.count() >= 4


def test_chunks_hold_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(blocked, "TOKENS", 10)
    lens = [3, 3, 3, 3, 0, 25, 1, None, 9, 2, 1, 1, 1, 1, 1]
    batch = pa.record_batch({"id": pa.array(range(len(lens))), "terms": pa.array([None if n is None else [7] * n for n in lens], pa.list_(pa.int64()))})
    parts = [p.column("id").to_pylist() for p in blocked._parts(batch, 4)]
    assert parts == [[0, 1, 2], [3, 4], [5], [6, 7, 8], [9, 10, 11, 12], [13, 14]]


def test_sums_are_added_a_slice_at_a_time(monkeypatch):
    """However many pairs of words a block and a chunk have: slices of any size give what brute force gives."""
    rnd = random.Random(6)
    docs = [[rnd.choice([1, 2, 3, 5, 8, 13, 21]) for _ in range(rnd.randint(0, 9))] for _ in range(30)]
    asked = [{t: rnd.random() + 0.1 for t in rnd.sample([1, 2, 3, 4, 8, 21, 34], 3)} for _ in range(12)]
    vector = pa.array([None] * 30, pa.list_(pa.float64()))
    d = dict(zip(blocked.NAMES, blocked._pack(pa.record_batch([pa.array(range(30)), pa.array(docs, pa.list_(pa.int64())), vector], ["id", "terms", "vector"]), False), strict=True))
    made = blocked._pack(pa.record_batch([pa.array(range(12)), pa.array([list(x) for x in asked], pa.list_(pa.int64())), pa.array([list(x.values()) for x in asked], pa.list_(pa.float64())), vector[:12]], ["query_id", "terms", "ws", "vector"]), True)
    want = [[sum(w * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / 4.0)) for t, w in q.items()) for x in docs] for q in asked]
    for dense, added in ((0, 1 << 20), (10**9, 1), (10**9, 7), (40, 3)):
        monkeypatch.setattr(blocked, "DENSE", dense)
        monkeypatch.setattr(blocked, "ADDED", added)
        words = blocked.Words(blocked.Side({f"q_{c}": x for c, x in zip(blocked.NAMES, made, strict=True)}, "q_"), blocked.Side(d), 4.0, 1.5, 0.75)
        assert np.allclose(np.vstack([words.sums(0, 5), words.sums(5, 12)]), want)


def test_lines_of_a_release_move_once(spark):
    """Windows and sections of a document are made after one shuffle of its lines; what nothing reads of uncovered lines does not move."""
    rows = [(f"d{i % 9}", "decision", i // 9, 1, i // 9, ("主文", "事實", f"Line {i}", " ")[i // 9 % 4], 0, 5) for i in range(180)]
    lines = spark.createDataFrame(rows, "document_id string, document_type string, idx int, page int, line int, text string, char_start int, char_end int")
    made = segment.segment(lines)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert made.count() == 9 * 2
    loose = segment.uncovered(lines, made.withColumn("end_idx", R.F.col("end_idx") - 1))
    assert loose.columns == lines.columns and [r.text for r in loose.collect()] == ["主文"] * 9
    counted = loose.agg(R.F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in x and "char_start" not in x for x in counted.split("\n") if "hashpartitioning(document_id" in x and "Exchange" in x)


def test_pairs_deal_their_parts_by_their_number(spark, tmp_path, monkeypatch):
    """The steps before the pairs have tasks made for the number of lines too, and the rows are the same."""
    orders = pa.table({"o_orderkey": list(range(1, 301)), "o_orderpriority": ["a", "b", None] * 100, "o_orderstatus": ["F", "O"] * 150})
    lines = pa.table({"l_orderkey": [1 + i * 7 % 300 for i in range(2400)], "l_partkey": [None if i % 97 == 0 else i * i % 211 for i in range(2400)]})
    monkeypatch.setattr(cases, "ROWS", 200)
    made, write = {}, catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, name: made.setdefault(name, df.rdd.getNumPartitions()) and write(df, name))
    got, want = both(spark, tmp_path, "weighted_jaccard", orders=orders, lineitem=lines)
    assert got == want and len(got) > 200 and made["cited"] == 12
    plan = QUERIES["weighted_jaccard"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_partkey") == 2 and all(", 12)" in x for x in plan.split("\n") if "hashpartitioning(l_partkey" in x)


def test_a_row_group_holds_one_chunk_or_block(spark):
    """Chunks and blocks take several MB each, and a task holds a whole row group: by default it would be 100 of them or more."""
    rows = spark.range(0, 40, 1, 1).select("id", R.F.array("id").alias("terms"), R.F.lit(None).cast("array<double>").alias("vector"))
    packed = blocked.chunks(rows, 4)
    asked, n = blocked.blocks(R._asked(rows.withColumnRenamed("id", "query_id").withColumn("ws", R.F.array(R.F.lit(1.0)))).coalesce(1), 8)
    for table, least in ((packed, 10), (asked, 2)):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
        groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
        assert set(groups) == {1} and len(groups) == table.count() >= least
