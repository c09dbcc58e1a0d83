import random
import sys
import unicodedata as ud
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.llm import contributor_cap as C
from ravelin.llm import lookalikes as L
from ravelin.llm import mixing as M
from ravelin.llm import packing as P
from ravelin.llm import pairs as X
from ravelin.llm import splitting as S
from ravelin.llm import tokens as K
from ravelin.llm import truncation as T

# Splitting


def pieces(spark, rows, **how):
    df = spark.createDataFrame([(i, t, n, "clash", 1) for i, t, n in rows], "id string, text string, filename string, piece string, start int")
    return S.split_oversized(df, **how).orderBy("id", "piece_no").collect()


def check(text, mine, limit, overlap):
    body = text.strip(S.ENDS)
    assert [r["piece_no"] for r in mine] == list(range(len(mine))) and {r["pieces"] for r in mine} <= {len(mine)}
    assert "".join(r["piece"][r["overlap"] :] for r in mine) == body
    for r in mine:
        assert len(r["piece"]) <= limit and r["overlap"] <= overlap and r["end"] - r["start"] == len(r["piece"]) - r["overlap"]
        assert text[r["start"] - r["overlap"] : r["end"]] == r["piece"]
    for a, b in zip(mine, mine[1:]):
        assert a["piece"].endswith(b["piece"][: b["overlap"]])


def test_pieces(spark):
    r = random.Random(1)
    prose = " ".join(f"Sentence {k} goes on for {r.randrange(10**6)} words." for k in range(300))
    texts = {
        "prose": (f"\n\t {prose}  ", "a.txt"), "paragraphs": ("\n\n".join([prose[:700]] * 6), "b.pdf"), "log": ("\n".join(f"[{k:08d}] INFO x {k}" for k in range(400)), "c.LOG"), "word": ("é" * 4000, None),
        "marks": ("é" * 3000, "x"), "code": ("void f() {\n  a = 1;\n}\n\n" * 200, "d.c"), "md": ("# H\n\ntext here\n\n```\ncode\n\nmore\n```\n\n" * 120, "e.md"), "exact": ("x" * 1500, "f.txt"), "one over": ("y" * 1501, "f.txt"), "astral": ("𝒳 " * 1600, "g"),
    }
    got = pieces(spark, [(i, t, n) for i, (t, n) in texts.items()] + [("null", None, "n"), ("empty", "", None), ("blank", " \n" * 2000, "n"), (None, prose, "n")])
    by = {}
    for row in got:
        by.setdefault(row["id"], []).append(row)
    assert set(by) == set(texts) - {"exact"} | {None}
    for i in by:
        text = texts[i][0] if i else prose
        check(text, by[i], 1500, 150)
    assert all(p["piece"].rstrip().endswith((".", "}")) for i in ("prose", "code") for p in by[i])
    assert all(p["piece"][p["overlap"]] == "[" for p in by["log"])
    assert not any(ud.combining(p["piece"][p["overlap"]]) for p in by["marks"])
    assert pieces(spark, []) == []


def test_kinds_of_unusual_names(spark):
    log = "\n".join(f"[{k:08d}] INFO x {k}\n  more of it. And more\n\n  more" for k in range(200))
    md = "# H\n\ntext here\n\n```\ncode\n\nmore\n```\n\n" * 120
    names = {"log": (log, ["a.log", "a.ｌｏｇ", "a.lоg", "a.l\u200bog\ufeff", "a．log", "a.ＬＯＧ"]), "md": (md, ["b.md", "b.ｍd", "b.m\u00add"])}
    for text, mine in names.values():
        got = {}
        for r in pieces(spark, [(n, text, n) for n in mine]):
            got.setdefault(r["id"], []).append((r["start"], r["end"], r["overlap"]))
        assert all(got[n] == got[mine[0]] for n in mine)
        assert got[mine[0]] != [(r["start"], r["end"], r["overlap"]) for r in pieces(spark, [("t", text, "t.txt")])]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["word", "a.", "\n\n", "\n", " ", "x" * 70, "é", "```\n", "# ", "}"]), max_size=120), st.sampled_from(["txt", "md", "c", "log"]), st.integers(5, 60), st.integers(0, 4))
def test_cuts(parts, kind, limit, overlap):
    text = "".join(parts).strip(S.ENDS)
    if not text:
        return
    cuts = list(S._cuts([text, "other text", text], [kind, kind, kind], limit, overlap, 0.5))
    for k, t in enumerate((text, "other text", text)):
        mine = [c for c in cuts if c[0] == k]
        assert [c[1] for c in mine] == list(range(len(mine)))
        assert mine[0][2] == 0 and mine[-1][3] == len(t) and all(a[3] == b[2] for a, b in zip(mine, mine[1:]))
        assert all(b - a + o <= limit and 0 <= o <= overlap and b > a for _, _, a, b, o in mine)


def test_greedy_by_walking(spark):
    """Pointer doubling gives the cuts that walking from successor to successor gives: level by level, the farthest."""
    text = "ab cd. " * 40
    cuts = [c[3] for c in S._cuts([text.strip()], ["txt"], 50, 0, 0.5)]
    at, walked = 0, []
    body = text.strip()
    while at < len(body):
        ends = [k for k in range(at + 1, min(len(body), at + 50) + 1) if k == len(body) or body[k - 2 : k] == ". "]
        at = max(ends)
        walked.append(at)
    assert cuts == walked


# Contributors


def test_caps_equal_sorting(spark):
    r = random.Random(2)
    rows = [(f"{k:04d}", r.choice(["big", "big", "a", "b", None]), r.choice([0.1, 0.2, 0.3, None, float("nan"), -1.0, 7.5])) for k in range(600)]
    df = spark.createDataFrame([(i, f, s, 1, 2.0) for i, f, s in rows], "id string, filename string, score double, n int, last double").repartition(7)
    twice = df.unionByName(df)
    worst = lambda s: s is None or s != s
    gone = set()
    for who in ("big", "a", "b"):
        mine = sorted((x for x in rows if x[1] == who), key=lambda x: (worst(x[2]), 0 if worst(x[2]) else -x[2], x[0]))
        gone |= {x[0] for x in mine[20:]}
    got = [x["id"] for x in C.dropped(twice).collect()]
    assert sorted(got) == sorted(gone)
    kept = C.capped(twice)
    assert kept.columns == df.columns
    assert sorted(x["id"] for x in kept.collect()) == sorted({x[0] for x in rows} - gone)
    assert C.capped(twice, cap=None, share=0.01).where("filename = 'big'").count() == 6


def test_caps_beyond_a_heap(spark, monkeypatch):
    """Ranks over ranges keep what heaps keep."""
    r = random.Random(8)
    rows = [(f"{k:04d}", r.choice(["big", "big", "big", "a", "b", None]), r.choice([0.1, 0.2, 0.3, None, float("nan"), -1.0, 7.5])) for k in range(700)]
    df = spark.createDataFrame(rows, "id string, filename string, score double").repartition(5)
    df = df.unionByName(df)
    want = sorted(x["id"] for x in C.dropped(df, cap=90).collect())
    monkeypatch.setattr(C, "HEAP", 10)
    assert want and sorted(x["id"] for x in C.dropped(df, cap=90).collect()) == want
    assert C.dropped(df.where(F.lit(False)), cap=90).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 1), st.sampled_from([0.0, 1.0, 2.5, -3.0]), st.integers(0, 30)), max_size=80), st.integers(1, 5), st.integers(1, 9))
def test_bars_lose_nothing(rows, cap, size):
    frames = [pd.DataFrame(rows[k : k + size], columns=["who", "last", "score", "id"]) for k in range(0, len(rows), size)]
    waiting, C.WAITING = C.WAITING, 3
    try:
        got = [tuple(x) for f in C._bounded(frames, cap) for x in f.itertuples(index=False)]
    finally:
        C.WAITING = waiting
    want = []
    for who in "ab":
        want += sorted({x for x in rows if x[0] == who}, key=lambda x: (x[1], -x[2], x[3]))[:cap]
    assert sorted(got) == sorted(want)


def test_heaps_flush_and_empty(spark, monkeypatch):
    monkeypatch.setattr(C, "WAITING", 3)
    monkeypatch.setattr(C, "HELD", 5)
    df = spark.createDataFrame([(f"{k:03d}", f"f{k % 9}", float(k % 4)) for k in range(300)], "id string, filename string, score double").repartition(5)
    assert C.dropped(df, cap=3).count() == 300 - 27
    none = df.where(F.lit(False))
    assert C.dropped(none).count() == 0 and C.capped(none).count() == 0
    nulls = spark.createDataFrame([(None, "f", 1.0), ("a", None, None)], "id string, filename string, score double")
    assert [x["id"] for x in C.capped(nulls).collect()] == ["a"] and C.dropped(nulls, cap=1).count() == 0
    with pytest.raises(ValueError):
        C.capped(df, cap=0)


# Look-alikes

SAME = [("Ｆｕｌｌ ９", "Full 9"), ("е́té", "été"), ("ﬁn ﬂ ﬃ", "fin fl ffi"), ("a​b­c﻿", "abc"), ("x y z", "x y z"), ("Ω K Å", "Ω K Å"), ("АВС", "ABC"), ("a‑b", "a-b"), ("e‍́", "é"), ("ё", "ë")]
DIFFERENT = [("été", "ete"), ("cm²", "cm2"), ("A", "a"), ("O", "0"), ("l", "1"), ("œ", "oe"), ("x", "×"), ("-", "—"), ("a b", "a\tb"), ("a", ""), ("½", "1/2")]


def test_classes():
    r = L.Rewriter({})
    for a, b in SAME:
        assert r(a) == r(b), (a, b)
    for a, b in DIFFERENT:
        assert r(a) != r(b), (a, b)
    assert r(None) is None and r("") == "" and r("​") == ""
    assert L.Rewriter({"е": 5, "e": 1})("eе") == "ее"  # the more frequent one stands for both
    assert L.Rewriter({"ﬁ": 5})("fin ﬁn") == "ﬁn ﬁn"
    odd = L.Rewriter({"е": 5, "é": 9, "і": 4})  # representatives from several scripts
    assert len({odd(x) for x in ("é", "é", "е́", "ｅ́")}) == 1 and len({odd(x) for x in ("ﬁ", "fi", "fі", "ｆi")}) == 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="eеｅé́̀​ﬁfi KK²aоＡ   ", max_size=30))
def test_rewriting_is_stable(text):
    r = L.Rewriter({})
    assert r(r(text)) == r(text)
    assert r(ud.normalize("NFC", text)) == r(text)


def test_canonically_equal_texts_are_one():
    """Over all of Unicode: composed and decomposed forms, and forms with their marks in another order, come out the same and stay so."""
    r = L.Rewriter({})
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if not 0xD800 <= c < 0xE000 and (ud.decomposition(x) or x in r.first or c % 97 == 0):
            assert r(x) == r(ud.normalize("NFD", x)) == r(ud.normalize("NFC", x)) == r(r(x)), hex(c)
    assert len({r(x) for x in ("o\u0302\u0323", "o\u0323\u0302", "\u1ed9", "\u043e\u0302\u0323", "\u00f4\u0323", "\uff4f\u0323\u200b\u0302")}) == 1
    for x in "가각が\u095c":
        assert r(x) == r(ud.normalize("NFD", x))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="oоｏôộe\u0302\u0323\u0301가\u1100\u1161\u11a8がか\u3099ﬀﬁﬃfi\u200b", max_size=12), st.sampled_from([{}, {"ﬃ": 9, "ﬀ": 9}, {"ﬁ": 9}, {"о": 9}]))
def test_one_form_for_all_that_look_the_same(text, counts):
    r = L.Rewriter(counts)
    assert r(text) == r(ud.normalize("NFD", text)) == r(ud.normalize("NFC", text)) == r(r(text))


def test_more_pairs():
    r = L.Rewriter({}, (("\U0001d400", "A"),))
    assert r("\U0001d400BC") == r("ABC") == "ABC" and L.Rewriter({})("\U0001d400") != "A"


def test_classes_that_look_the_same(spark):
    rows = [("1", "a.txt", "fin été"), ("2", "а.txt", "fin été"), ("3", "a.txt", "ﬁn été"), ("4", "a.txt", "fin e\u0301t\u00e9"), ("5", "a.txt", "fin ete"), ("6", None, "x"), ("1", "a.txt", "fin été"), ("7", "a.txt", "fin été"), ("8", "a.txt", "fin été")]
    df = spark.createDataFrame([(i, f, t, 1) for i, f, t in rows], "id string, filename string, text string, members int")
    got = {r["id"]: tuple(r)[1:] for r in L.same_looking_classes(df, "id", ["filename", "text"]).collect()}
    assert got == {**{i: ("1", 6, 4, 3, 3) for i in "178"}, **{i: ("1", 6, 4, 1, 5) for i in "234"}, "5": ("5", 1, 1, 1, 0)}
    assert L.same_looking_classes(df.where(F.lit(False)), "id", ["filename", "text"]).count() == 0
    links = sum(r[4] for r in got.values())
    for piece in (2, 5_000):
        members = spark.createDataFrame([(f"{k:02d}", k % 3) for k in range(20)], "id string, key int")
        sides = spark.createDataFrame([(0, 1), (2, 2)], "a int, b int")
        want = {(min(a, b), max(a, b)) for a in range(20) for b in range(20) if (a % 3, b % 3) in ((0, 1), (2, 2)) and a != b}
        assert sorted(map(tuple, X.member_pairs(sides, members, piece).collect())) == sorted((f"{a:02d}", f"{b:02d}") for a, b in want)
    assert len(L.same_looking_pairs(df, "id", ["filename", "text"]).collect()) == links // 2


def test_pairs_that_look_the_same(spark):
    rows = [("1", "a.txt", "fin été"), ("2", "а.txt", "fin été"), ("3", "a.txt", "ﬁn été"), ("4", "a.txt", "fin été"), ("5", "a.txt", "fin ete"), ("6", None, "fin été"), ("7", "a.txt", None), (None, "а.txt", "fin été"), ("8", "", ""), ("9", "​", ""), ("1", "a.txt", "fin été")]
    df = spark.createDataFrame([(i, f, t, "x", "y") for i, f, t in rows], "id string, filename string, text string, variant string, look string")
    got = sorted(map(tuple, L.same_looking_pairs(df, "id", ["filename", "text"]).collect()))
    assert got == [("1", "2"), ("1", "3"), ("2", "3"), ("2", "4"), ("3", "4"), ("8", "9")]
    assert L.same_looking_pairs(df.where(F.lit(False)), "id", ["filename", "text"]).count() == 0
    new = L.rewritten(df, ["filename", "text"])
    assert new.columns == df.columns
    assert {r["filename"] for r in new.where("id in ('1', '2', '3')").collect()} == {"a.txt"}


def test_counts(spark):
    df = spark.createDataFrame([("eéе é fi ﬁ",), (None,), ("",), ("x" * 9,)], "t string")
    got = {r["member"]: r["n"] for r in L.member_counts(df, ["t"]).collect()}
    assert (got["e"], got["е"], got["é"], got["é"], got["fi"], got["ﬁ"]) == (2, 1, 1, 1, 1, 1)


# Tokens, containers, mixes


@pytest.fixture(scope="module")
def ranks():
    try:
        with open(K.DEFAULT, "rb") as f:
            return f.read()
    except OSError:
        pytest.skip("no vocabulary here")


def test_parts(ranks, monkeypatch):
    text = " ".join(f"mot{k} l'été  a-t-il\n\n fini ?" for k in range(400))
    whole = K.encoding(ranks).encode_ordinary(text)
    monkeypatch.setattr(K, "PART", 50)
    assert len(list(K.parts(text))) > 100
    assert K.count(ranks, text) == len(whole) and K.count(ranks, None) is None and K.count(ranks, "") == 0
    cut = list(K._cut(ranks, text + " 𝒳é" * 50, 64))
    assert all(n <= 64 for n, _, _ in cut) and cut[0][1] == 0 and cut[-1][2] == len(text) + 150 and all(a[2] == b[1] for a, b in zip(cut, cut[1:]))
    assert all(n > 60 for n, _, _ in cut[:-1])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=150))
def test_harmonic(lengths):
    bins = P.harmonic(lengths, 64)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 64 for b in bins)
    if lengths:
        assert len(bins) <= 1.7 * -(-sum(lengths) // 64) + 2


def test_containers(spark, ranks):
    r = random.Random(3)
    rows = [(k, " ".join(f"mot{r.randrange(999)}" for _ in range(r.choice([2, 9, 20, 33])))) for k in range(300)] + [(1000, "mot " * 900), (1001, ""), (1002, None), (None, "x")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, container string, tokens int")
    got = P.packed(df, capacity=256, shard=100).collect()
    assert {x["id"] for x in got} == {i for i, t in rows if i is not None and t}
    total = Counter()
    for x in got:
        total[x["container"]] += x["tokens"]
    assert max(total.values()) <= 256 and sum(total.values()) / (256 * len(total)) > 0.95
    parts = sorted((x for x in got if x["id"] == 1000), key=lambda x: x["piece"])
    assert len(parts) == parts[0]["pieces"] >= 4 and all(x["tokens"] == 256 for x in parts[:-1])
    assert parts[0]["char_start"] == 0 and parts[-1]["char_end"] == len("mot " * 900) and all(a["char_end"] == b["char_start"] for a, b in zip(parts, parts[1:]))
    assert all(x["pieces"] == 1 for x in got if x["id"] != 1000)
    assert P.packed(df.where(F.lit(False)), capacity=256).count() == 0
    report = P.fill_report(P.packed(df, capacity=256), 256).first()
    assert report["tokens"] == sum(total.values())


def test_sainte_lague():
    assert M.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    assert M.sainte_lague([1, 1], 3) == [2, 1] and M.sainte_lague([0, 1], 2) == [0, 2] and M.sainte_lague([], 5) == []
    assert M.sainte_lague([5, 1], 10, [3, 99]) == [3, 7] and M.sainte_lague([1], 5, [2]) == [2]


def test_mix(spark, ranks):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(999)}" for _ in range(n))
    rows = [(k, text(r.randint(5, 60)), "big") for k in range(400)] + [(1000 + k, text(30), "mid") for k in range(80)] + [(2000 + k, text(20), "tiny") for k in range(4)] + [(3000, None, "big"), (3001, "", "big"), (3002, text(50), None), (3003, text(50), "unwanted")]
    docs = spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.15, 2), ("absent", 0.05, None), (None, 0.9, 1), ("mid", 0.0, None), ("none", None, 2)], "source string, target_share double, max_repeats int")
    m = M.measured(docs.unionByName(docs), shard=50)
    planned = M.plan(m, targets)
    mix = M.selected(m, planned)
    again = {(x["id"], x["copies"]) for x in M.selected(m, planned).collect()}
    assert {(x["id"], x["copies"]) for x in mix.collect()} == again
    got = {x["source"]: x for x in M.report(mix, planned).collect()}
    assert {s for s, x in got.items() if x["short"]} == {"tiny", "absent"}
    assert got["big"]["share_of_total"] == pytest.approx(0.5, abs=0.01) and got["mid"]["share_of_total"] == pytest.approx(0.3, abs=0.02)
    assert got["mid"]["most_copies"] <= 3 and got["tiny"]["most_copies"] == 2 and got["tiny"]["documents"] == 4
    assert got["absent"]["tokens"] == got["none"]["tokens"] == 0
    # what's short is read from the mix: it changes with the selection
    half = mix.where("id <> 2000")
    assert not {x["source"]: x for x in M.report(half, planned).collect()}["tiny"]["short"]
    none = M.measured(docs.where(F.lit(False)))
    assert M.report(M.selected(none, M.plan(none, targets)), M.plan(none, targets)).count() == 5
    assert M.plan(m, targets.where(F.lit(False))).count() == 0


def test_smaller_documents_fill_the_rest(spark):
    """A document that doesn't fit doesn't end the selection: quotas are met to within the smallest document left."""
    docs = spark.createDataFrame([(k, "a", 1000, k % 2) for k in range(40)] + [(100 + k, "a", 7, k % 2) for k in range(600)] + [(1000, "b", 44200, 0)], "id long, source string, tokens int, shard int")
    planned = M.plan(docs, spark.createDataFrame([("a", 0.25, 1)], "source string, target_share double, max_repeats int"))
    quota = planned.first()["quota"]
    for seed in range(3):
        mix = M.selected(docs, planned, seed).collect()
        assert abs(sum(r["tokens"] * r["copies"] for r in mix) - quota) <= 2 * 4
        assert len(mix) == len({r["id"] for r in mix}) and {r["copies"] for r in mix} == {1}
    whole = M.selected(docs, planned.withColumn("quota", F.lit(2 * 44200)).withColumn("max_repeats", F.lit(2))).collect()
    assert len(whole) == 640 and {r["copies"] for r in whole} == {2}


# Truncation

WHOLE = ["A sentence.", "Really?", 'He said "no".', "Et ainsi de suite...", "And so on…", "x.\n\nFin de la fiche", "x.\n\nRévision B", "text. [note 4]", "text. (cf. annexe 2)", "| a | b |\n| c | d |", "```c\nx = 1;\n```\n\n", "", "  \n", "-", "[00000001] INFO Abc 0x12 5 V (page 3)", "- a ;\n- b."]
CUT = ["A sentence that stops in the mid", "A list, but", "x.\n\n```c\nvoid f(", "broken sig�", "l'étalonnage &am", "corr\\u00", "The value...", "word [...]", "on mesure 12 V (p. ex.", "| a | b |\n| c", "- a ;\n- b ;\n- the ther", "See https://exam", "[00000001] ERR Ab"]
OPEN = ["# Heading Name", "- one\n- two", "[00000001] INFO Abc 0x12 5 V", "See also: https://a.example/b", "```\n```\n# T"]


def test_endings():
    assert [t for t in WHOLE if T.ending(t) != T.WHOLE] == []
    assert [t for t in CUT if T.ending(t) != T.CUT] == []
    assert [t for t in OPEN if T.ending(t) != T.OPEN] == []


def test_words_between_long_rules():
    assert T.ending("=" * 450 + "\nThe words stand in between.\n|" + "-" * 450) == T.CUT
    assert T.ending("=" * 450 + "\n|" + "-" * 450) == T.WHOLE  # no letter or digit at all


def test_limits_and_rates(spark):
    r = random.Random(5)
    rows = [(k, "s", "word " * r.randint(5, 80) + "end.") for k in range(200)]
    rows += [(1000 + k, "s", (f"- item {k} " + "xy " * 90)[:200]) for k in range(20)]  # different list items at a limit: only their length tells
    rows += [(2000 + k, "s", f"- item {'z' * k}") for k in range(20)]
    rows += [(3000, None, "cut in the mid"), (3001, "t", None), (3002, "t", " "), (None, "s", "cut in"), (3000, None, "cut in the mid")]
    df = spark.createDataFrame([(i, s, t, 1, True) for i, s, t in rows], "doc_id long, source string, text string, chars int, truncated boolean")
    got = {x["id"] for x in T.truncated(df).collect()}
    assert got == {1000 + k for k in range(20)} | {3000}
    assert {x["id"]: x["evidence"] for x in T.truncated(df).collect()} == {**{1000 + k: "limit" for k in range(20)}, 3000: "ending"}
    rates = {x["source"]: x for x in T.rates(df).collect()}
    assert (rates["s"]["by_limit"], rates["s"]["by_ending"], rates[None]["by_ending"]) == (20, 0, 1)
    assert (rates["s"]["documents"], rates["s"]["truncated"], rates["s"]["limit_chars"]) == (240, 20, 200)
    assert rates[None]["share"] == 1.0 and rates["t"]["truncated"] == 0
    assert T.truncated(df.where(F.lit(False))).count() == 0 and T.rates(df.where(F.lit(False))).count() == 0


def test_limits_of_rare_cuts_and_several_columns(spark):
    """A limit stays one however much its source grows, copies of one text make none, and each column has its own."""
    r = random.Random(6)
    prose = lambda k: ("word " * r.randint(400, 4000) + f"end {k}.")
    rows = [(k, "s", prose(k), "a title") for k in range(3000)]
    rows += [(5000 + k, "s", (f"{k} " + "words go on " * 90)[:800], "x") for k in range(12)]  # 0.4 % of the source
    rows += [(6000 + k, "s", "the same text, again and again, and", None) for k in range(40)]
    rows += [(7000 + k, "t", "whole.", (f"- {k} " + "abc def " * 20)[:60]) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, title string")
    got = {(x["id"], x["field"]): x["evidence"] for x in T.truncated(df, text_col=["text", "title"]).collect()}
    assert {k[0] for k, v in got.items() if v == T.LIMIT and k[1] == "text"} == {5000 + k for k in range(12)}
    assert {k[0] for k, v in got.items() if v == T.LIMIT and k[1] == "title"} == {7000 + k for k in range(30)}
    assert {v for k, v in got.items() if 6000 <= k[0] < 7000} == {T.ENDING}
