import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import similar_vectors as S
from ravelin.llm import variety as V
from ravelin.llm.vectors import directed, usable

SCHEMA = "id string, vector array<float>, payload struct<text: string, filename: string>, key string, rank int, label string, radius double"


def table(spark, rows):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, p, "k", 7, "l", 0.5) for i, v, p in rows], SCHEMA)


def groups(seed, sizes, dims=16, spread=0.08):
    rng = np.random.default_rng(seed)
    out = []
    for g, n in enumerate(sizes):
        centre = rng.normal(size=dims)
        for _ in range(n):
            v = centre + spread * np.linalg.norm(centre) / 4 * rng.normal(size=dims)
            out.append((f"g{g}", (v * rng.uniform(0.1, 9)).astype(np.float32)))
    return out


def brute(rows, k, least):
    ids = [i for i, _ in rows]
    u = np.array([v / np.linalg.norm(v) for _, v in ((i, np.asarray(v, float)) for i, v in rows)])
    c = np.round(u @ u.T, 6)
    found = {}
    for a in range(len(rows)):
        order = sorted((-c[a, b], ids[b]) for b in range(len(rows)) if b != a and c[a, b] >= least)[:k]
        found[ids[a]] = [i for _, i in order]
    return found


BAD = [("null", None, None), ("short", [1.0] * 15, None), ("nan", [float("nan")] + [1.0] * 15, None), ("inf", [float("inf")] + [1.0] * 15, None), ("zero", [0.0] * 16, None), ("hole", [None] + [1.0] * 15, None), (None, [1.0] * 16, None)]


def test_usable(spark):
    df = table(spark, [*BAD, ("ok", [1.0] + [0.0] * 15, ("t", "f"))])
    assert [r["id"] for r in df.where(usable("vector", 16)).collect()] == [None, "ok"]
    assert [r["id"] for r in directed(df, "id", "vector", 16).collect()] == ["ok"]


def test_neighbours_equal_brute_force(spark):
    rows = [(f"{k:04d}", v) for k, (_, v) in enumerate(groups(1, [90, 40, 30, 12, 5, 3, 2, *[1] * 60]))]
    df = table(spark, [*((i, [float(x) for x in v], (None, "f")) for i, v in rows), *BAD]).repartition(3)
    got = {}
    for r in S.neighbours(df.unionByName(df), "id", "vector", dims=16, k=5, least=0.85, per_pivot=8).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute(rows, 5, 0.85)
    hits = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert all(len(v) <= 5 and i not in v for i, v in got.items())
    pairs = {tuple(r) for r in S.neighbour_pairs(df, "id", "vector", dims=16, k=5, least=0.85).collect()}
    assert all(a < b for a, b in pairs)


def test_copies_and_ties(spark):
    rows = [(f"c{k:02d}", [1.0] * 16, None) for k in range(30)] + [("s", [3.0] * 16, None), ("far", [1.0] + [-1.0] * 15, None)]
    got = {}
    for r in S.neighbours(table(spark, rows), "id", "vector", dims=16, k=3, least=0.85).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["cosine"]))
    assert got["c00"] == [("c01", 1.0), ("c02", 1.0), ("c03", 1.0)]
    assert got["s"] == got["c29"] == [("c00", 1.0), ("c01", 1.0), ("c02", 1.0)]
    assert "far" not in got


@pytest.mark.parametrize("jitter", [1e-7, 2e-5, 2.5e-4, 3.5e-4])
def test_jittered_copies(spark, jitter):
    """Copies that aren't equal at 6 decimals tie all the same, among themselves and as seen from others."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    centre /= np.linalg.norm(centre)
    vectors = [(centre + jitter * rng.normal(size=16)) * rng.uniform(0.5, 2) for _ in range(400)] + [centre + 0.06 * rng.normal(size=16) for _ in range(60)] + list(rng.normal(size=(100, 16)))
    ids = [f"{k:04d}" for k in rng.permutation(len(vectors))]
    rows = [(i, v.astype(np.float32)) for i, v in zip(ids, vectors)]
    df = table(spark, [(i, [float(x) for x in v], None) for i, v in rows])
    got = {}
    for r in S.neighbours(df, "id", "vector", dims=16, k=10, least=0.85, per_pivot=16).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = brute(rows, 10, 0.85)
    assert [i for i, w in want.items() if got.get(i, []) != w] == []


def test_blocks_hold_two_slices():
    rng = np.random.default_rng(3)
    for n, slices in ((40, 1), (60, 4), (240, 16)):
        own = rng.integers(0, slices, n)
        which, block, side = S.blocked(np.zeros(n, np.int64), own, np.full(n, slices))
        assert max(np.bincount(block)) <= 2 * max(np.bincount(own))
        met = np.zeros((n, n), int)
        for b in np.unique(block):
            for s, t in ((2, 2), (0, 1), (1, 0)):
                met[np.ix_(which[(block == b) & (side == s)], which[(block == b) & (side == t)])] += 1
        assert (met == 1).all()


def test_salted_files(spark, monkeypatch):
    monkeypatch.setattr(S, "LONG", 20)  # read on the driver
    rows = [(f"{k:04d}", v) for k, (_, v) in enumerate(groups(3, [150, 20]))]
    df = table(spark, [(i, [float(x) for x in v], None) for i, v in rows])
    got = S.neighbours(df, "id", "vector", dims=16, k=4, least=0.85, per_pivot=40)
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], set()).add(r["neighbour"])
    want = brute(rows, 4, 0.85)
    assert sum(len(found.get(i, set()) & set(w)) for i, w in want.items()) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("rows", [[], BAD, [("a", [1.0] * 16, None)]])
def test_nothing_to_find(spark, rows):
    df = table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    assert S.neighbours(df, "id", "vector", dims=16).count() == 0
    assert S.neighbour_pairs(df, "id", "vector", dims=16).columns == ["id_a", "id_b"]
    assert V.varied_subset(df, "id", "vector", dims=16).count() == (1 if len(rows) == 1 else 0)


def test_footrule():
    a = np.array([[1, 2, 3]])
    assert S.footrule(a, np.array([[1, 2, 3], [2, 1, 3], [4, 5, 6]])).tolist() == [[0, 2, 12]]


def test_places():
    x = np.random.default_rng(0).normal(size=(103, 8))
    for parts in (1, 2, 7, 200):
        n = np.bincount(S.placed(x, parts), minlength=parts)
        assert n.sum() == 103 and n.max() - n.min() <= (2 if parts < 103 else 1)
    assert S.placed(x[:0], 3).tolist() == []


def test_farthest_first():
    x = np.eye(4, dtype=np.float32)[[0, 0, 1, 2]]
    picks, radius = V.farthest_first(x, 9)
    assert sorted(picks.tolist()) == [0, 1, 2, 3] and picks[:3].tolist() == [0, 2, 3] and radius[-1] == pytest.approx(0, abs=1e-3)


def test_varied_subset(spark):
    sizes = [300, 100, *[10] * 8, *[1] * 20]
    made = groups(5, sizes, spread=0.05)
    rows = [(f"{k:04d}", [float(x) for x in v], (None, "big.txt" if k % 2 else f"{k % 40}.txt")) for k, (_, v) in enumerate(made)]
    df = table(spark, rows)
    got = V.varied_subset(df.unionByName(df), "id", "vector", dims=16, share=0.08).collect()
    assert len(got) == len({r["id"] for r in got}) == int(np.ceil(0.08 * len(rows)))
    of = [made[int(r["id"])][0] for r in got]
    assert set(of) == {f"g{g}" for g in range(len(sizes))}  # every kind is there
    assert of.count("g0") < 0.3 * len(of)  # 60 % of the points
    few = V.varied_subset(df, "id", "vector", dims=16, share=0.05, label_share=0.1).collect()
    assert sum(r["label"] == "big.txt" for r in few) <= int(np.ceil(0.1 * len(few)))
    assert V.varied_subset(df, "id", "vector", dims=16, share=1.0, label_share=0.01).count() == len(rows)


@pytest.mark.parametrize(("centres", "sides"), [(4096, 16), (2, 16), (2, 0)])
def test_varied_subset_in_cells(spark, monkeypatch, centres, sides):
    monkeypatch.setattr(V, "CENTRES", centres)
    monkeypatch.setattr(V, "SIDES", sides)
    monkeypatch.setattr(V, "PART", 60)
    monkeypatch.setattr(V, "CELL", 40)
    rows = [(f"{k:04d}", [float(x) for x in v], None) for k, (_, v) in enumerate(groups(6, [150, 60, 30, *[5] * 12], spread=0.05))]
    got = V.varied_subset(table(spark, rows), "id", "vector", dims=16, share=0.1).collect()
    assert len(got) == 30 and len({r["id"] for r in got}) == 30


def test_selecting_by_radius(spark):
    rows = spark.createDataFrame([(f"{k}", 1.0 + (k % 5) / 10) for k in range(50)], "id string, radius double")
    got = V._first(rows, 13).collect()
    assert len(got) == 13 and min(r["radius"] for r in got) == pytest.approx(1.3)
    assert V._first(rows, 99).count() == 50 and V._first(rows.where(F.lit(False)), 3).count() == 0
