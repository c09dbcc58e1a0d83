import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import fulltext, fusion, mmr, vector

DOCS = ["alpha alpha alpha beta", "alpha gamma delta epsilon zeta eta theta", "réseau alphabet", "nothing here", "other text", "more text here", "802.1X auth port"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"id{k}", t) for k, t in enumerate(DOCS)], "id string, text string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id int, q string")


def stage(spark, chunks, prefixes, need):
    rows = spark.createDataFrame([(0, 3, need, p) for p in prefixes], "query_id int, stage int, need int, prefix string")
    return {r["id"]: r["bm25"] for r in fulltext.scored_stages(chunks, rows).collect()}


def test_bm25_golden(spark, chunks):
    assert stage(spark, chunks, ["alpha"], 1) == pytest.approx({"id0": 0.3813, "id2": 0.30295, "id1": 0.17622}, abs=1e-5)
    assert stage(spark, chunks, ["alpha", "gamma"], 2) == pytest.approx({"id1": 1.20441}, abs=1e-5)
    assert stage(spark, chunks, ["reseau"], 1) == pytest.approx({"id2": 1.76764}, abs=1e-5)


def test_bm25_equals_sqlite(spark, chunks):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61 remove_diacritics 1')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    db.executemany("INSERT INTO f VALUES (?)", [(d,) for d in DOCS])
    want = {f"id{i - 1}": -r for i, r in db.execute("SELECT rowid, rank FROM f WHERE f MATCH 'text* OR here* OR alph*'")}
    assert stage(spark, chunks, ["text", "here", "alph"], 1) == pytest.approx(want, abs=2e-6)


def test_order_is_inverted_by_default(spark, chunks):
    q = asked(spark, "ALPHA")
    ref = [r["id"] for r in fulltext.cascade(chunks, q, 40).orderBy("rank").collect()]
    best = [r["id"] for r in fulltext.cascade(chunks, q, 40, rank_order="best_first").orderBy("rank").collect()]
    assert ref == ["id1", "id2", "id0"] and best == ref[::-1]


def test_stages(spark, chunks):
    got = {r["query_id"]: (r["stage"], r["id"]) for r in fulltext.cascade(chunks, asked(spark, "802.1X", "texte, text,", "C++ quest-ce mode?", "Alpha Gamma", "ALPHA OTHER"), 40).where("rank = 1").collect()}
    assert got[0] == (fulltext.LIKE, "id6")
    assert 1 not in got and 2 not in got  # signs that the syntax doesn't allow make the stage fail
    assert got[3] == (fulltext.ALL_TECHNICAL, "id1")
    assert got[4][0] == fulltext.ANY_TECHNICAL
    loose = {r["query_id"] for r in fulltext.cascade(chunks, asked(spark, "text,"), 40, strict=False).collect()}
    assert loose == {0}


def test_empty_and_null(spark, chunks):
    assert fulltext.cascade(chunks, asked(spark, None, "", "?"), 40).count() == 0
    assert fulltext.cascade(chunks.where("id = 'x'"), asked(spark, "ALPHA"), 40).count() == 0
    nulls = chunks.unionByName(spark.createDataFrame([("n", None)], "id string, text string"))
    assert fulltext.corpus_stats(nulls).first()["docs"] == 8


def test_second_pass_ranks_go_on(spark, chunks):
    rows = fulltext.two_passes(chunks, asked(spark, "Comment ALPHA ici"), 40).orderBy("pass", "rank").collect()
    assert [(r["pass"], r["rank"]) for r in rows] == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)]


def test_index_on_disk(spark, chunks, tmp_path):
    fulltext.build_index(chunks, str(tmp_path))
    hits = fulltext.indexed_hits(spark.read.parquet(f"{tmp_path}/postings"), ["alpha", "text"])
    live = fulltext.prefix_hits(chunks, spark.createDataFrame([("alpha",), ("text",)], "prefix string"))
    assert sorted(map(tuple, hits.select("prefix", "id", "tf", "dl").collect())) == sorted(map(tuple, live.select("prefix", "id", "tf", "dl").collect()))
    assert fulltext._stats(fulltext.open_index(spark, str(tmp_path)).sums).first()["docs"] == 7


def test_index_answers_as_texts_do(spark, chunks, tmp_path):
    """From a written index, also one that came in two parts, the cascade is what it is from the texts."""
    fulltext.append_index(chunks.where("id < 'id3'"), str(tmp_path))
    fulltext.append_index(chunks.where("id >= 'id3'"), str(tmp_path))
    q = asked(spark, "ALPHA", "Alpha Gamma", "802.1X", "texte text here", None)
    live = sorted(map(tuple, fulltext.cascade(chunks, q, 40).collect()))
    assert live and live == sorted(map(tuple, fulltext.cascade(chunks, q, 40, index=fulltext.open_index(spark, str(tmp_path))).collect()))


@pytest.mark.parametrize("prefixes", [["ad"], ["a", "ad", "adm", "admux"], ["ad", "xyz"], ["é"]])
def test_short_prefixes(spark, tmp_path, prefixes):
    rows = spark.createDataFrame([("1", "adc admux"), ("2", "ad hoc"), ("3", "a b"), ("4", "élan ad ADC")], "id string, text string")
    words = {"1": ["adc", "admux"], "2": ["ad", "hoc"], "3": ["a", "b"], "4": ["elan", "ad", "adc"]}
    want = sorted((p, i, n) for p in prefixes for i, ws in words.items() if (n := sum(w.startswith(p) for w in ws)))
    live = fulltext.prefix_hits(rows, spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    assert sorted((r["prefix"], r["id"], r["tf"]) for r in live.collect()) == want
    fulltext.build_index(rows, str(tmp_path))
    stored = fulltext.indexed_hits(fulltext.open_index(spark, str(tmp_path)).postings, prefixes)
    assert sorted((r["prefix"], r["id"], r["tf"]) for r in stored.collect()) == want


def test_scan_of_the_index_is_pruned(spark, chunks, tmp_path):
    fulltext.build_index(chunks, str(tmp_path))
    plan = fulltext.indexed_hits(fulltext.open_index(spark, str(tmp_path)).postings, ["alpha", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,alpha)" in plan


def test_literals_overlap_and_repeat(spark):
    rows = spark.createDataFrame([("1", "x802.1xy and A-B-C"), ("2", "802.1"), ("3", None), ("4", "a-b a-b")], "id string, text string")
    q = asked(spark, "802.1X", "A-B-C a-b-c", "802.1x A-B-C", "none.here")
    got = {(r["query_id"], r["id"]) for r in fulltext.literal_hits(rows, fulltext.query_terms(q)).collect()}
    assert got == {(0, "1"), (1, "1"), (2, "1")}


def hits(spark, ids):
    return spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "query_id int, id string, rank int")


@pytest.mark.parametrize(
    ("technical", "text", "wanted"),
    [
        (False, ["b", "d", "d", "a"], [("d", 0.064004, 1.0), ("b", 0.048916, 0.764262), ("a", 0.047643, 0.744381), ("c", 0.015873, 0.248)]),
        (True, ["b", "d", "d", "a"], [("d", 0.16001, 1.0), ("b", 0.081967, 0.512262), ("a", 0.078125, 0.48825)]),
        (True, [], []),
    ],
)
def test_fusion(spark, technical, text, wanted):
    kinds = spark.createDataFrame([(0, technical)], "query_id int, technical boolean")
    got = fusion.fused(hits(spark, ["a", "b", "c"]), hits(spark, text), kinds).orderBy(F.desc("rrf")).collect()
    assert [(r["id"], round(r["rrf"], 6), r["score"]) for r in got] == wanted


@pytest.mark.parametrize(("scores", "wanted"), [([4, 1, -2], [1, 0.5, 0]), ([-3, -5], [0.5, 0]), ([2, 2], [0.5, 0.5]), ([-3, -3], [0.25, 0.25]), ([7], [0.5])])
def test_rescaling(spark, scores, wanted):
    rows = spark.createDataFrame([(0, k, float(s)) for k, s in enumerate(scores)], "query_id int, id int, rerank_score double")
    assert [r["score"] for r in fusion.rescaled(rows).orderBy("id").collect()] == wanted


ROWS = [("a", "A", 1.0, [1, 0]), ("b", "A", 0.95, [1, 0.05]), ("c", "A", 0.9, [1, 0.1]), ("d", "B", 0.5, [0, 1]), ("e", "C", 0.3, None), ("z", "D", 0.1, [0, 0])]
MANY = [(str(k), "A", 1 - 0.1 * k, None) for k in range(6)] + [("x", "B", 0.05, None)]


@pytest.mark.parametrize(
    ("rows", "how", "wanted"),
    [
        (ROWS, {"k": 3}, "abd"), (ROWS, {"k": 6}, "abdezc"), (ROWS, {"k": 4, "trade": 1.0}, "abdc"), (ROWS, {"k": 4, "by_vectors": False}, "abde"),
        (MANY, {"k": 5}, "012x3"), (MANY, {"k": 6}, "012x35"), (MANY, {"k": 3, "per_file": 1}, "01x"), (MANY, {"k": 7}, "012x345"), (ROWS, {"k": 0}, ""), ([], {"k": 3}, ""), (MANY, {"k": 3, "per_file": None, "trade": None}, "012"),
    ],
)
def test_mmr(rows, how, wanted):
    order = mmr.pick_order(np.array([r[2] for r in rows], float), [r[1] for r in rows], [None if r[3] is None else np.array(r[3], float) for r in rows], **how)
    assert "".join(rows[i][0] for i in order) == wanted


def test_vector_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)).round(1)
    x[5] = x[7]  # a tie
    x[9] = 0
    rows = [(f"{k:03d}", [float(v) for v in r]) for k, r in enumerate(x)] + [("null", None), ("short", [1.0]), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(5)
    q = [(1, [float(v) for v in x[7]]), (2, [float(v) for v in rng.normal(size=6)]), (3, None)]
    got = vector.topk(chunks, spark.createDataFrame(q, "query_id int, qvec array<double>"), 10)
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else round(float(np.dot(a, b)) / math.sqrt(np.dot(a, a) * np.dot(b, b)), 6)
    for n, v in q[:2]:
        want = sorted((-cos(r, v), i) for i, r in rows[:300])[:10]
        mine = got.where(F.col("query_id") == n).orderBy("rank").collect()
        assert [r["id"] for r in mine] == [i for _, i in want]
        assert [-r["cosine"] for r in mine] == pytest.approx([c for c, _ in want], abs=2e-6)
    assert got.where("query_id = 3").count() == 0
    best = vector.Best(1, 3)
    best.add(["c", "a", "b", "d"], np.ones((4, 1)), np.ones((1, 1)))
    assert sorted(r["id"] for b in best.rows([1], vector.to_arrow_schema(spark.createDataFrame([], "query_id int, id string, cosine double").schema)) for r in b.to_pylist()) == ["a", "b", "c"]


def test_search_in_cells(spark, tmp_path, monkeypatch):
    """Recall of at least 0.9 with a part of the cells, and all of it with all cells. Every vector is indexed."""
    monkeypatch.setattr(vector, "ROWS", 100)
    monkeypatch.setattr(vector, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 12))
    x = np.concatenate([centres[rng.integers(0, 40, 2500)] + 0.35 * rng.normal(size=(2500, 12)), rng.normal(size=(300, 12))])
    bad = [("null", None), ("short", [1.0]), ("nan", [float("nan")] * 12), ("inf", [float("inf")] * 12), (None, [1.0] * 12)]
    chunks = spark.createDataFrame([(f"{k:05d}", [float(v) for v in r]) for k, r in enumerate(x)] + bad, "id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x[::50] + 0.05 * rng.normal(size=x[::50].shape))] + [(999, None)], "query_id int, qvec array<double>")
    vector.build_cells(chunks, str(tmp_path))
    cells = vector.open_cells(spark, str(tmp_path))
    assert cells.vectors.count() == len(x) and cells.centres.count() == int(np.sqrt(len(x) + 4))
    assert cells.centres.first()["probes"] < 26  # half of them
    exact = vector.topk(chunks, asked, 10).select("query_id", "id", "cosine", "rank")
    found = vector.indexed_topk(cells, asked, 10)
    assert found.join(exact, ["query_id", "id"]).count() >= 0.9 * exact.count()
    every = vector.indexed_topk(cells, asked, 10, probes=10_000)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    vector.build_cells(chunks.where("id = 'x'"), f"{tmp_path}/none")
    assert vector.indexed_topk(vector.open_cells(spark, f"{tmp_path}/none"), asked, 10).count() == 0


def test_vector_topk_empty(spark):
    none = spark.createDataFrame([], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, qvec array<double>")
    assert vector.topk(none, q, 3).count() == 0
    assert vector.topk(spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<float>"), q.where("query_id = 2"), 3).count() == 0
