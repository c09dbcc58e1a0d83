from pyspark.sql import functions as F

from ravelin.operators import context, dedup, evaluate
from ravelin.runtime import broadcast_if_small, pinned, shared_dir, written


def test_copies(spark):
    long = "é" * 300
    rows = [("1", "A  b", "F"), ("2", "a b", "f"), ("3", "a b", "g"), ("4", long + "x", "h"), ("5", long + "y", "h"), ("6", None, None), ("7", None, None), ("8", "", "f")]
    got = dedup.without_copies(spark.createDataFrame(rows, "id string, text string, filename string"), [F.col("id")])
    assert sorted(r["id"] for r in got.collect()) == ["1", "3", "4", "6", "8"]
    assert got.columns == ["id", "text", "filename"]


def test_cap(spark):
    rows = [(f"{k}", "core.txt" if k % 2 else "x.txt", k) for k in range(10)] + [("n", None, 1)]
    df = spark.createDataFrame(rows, "id string, path string, n int")
    got = dedup.capped_per_file(df, "path", [F.col("n")], 2, ["CORE"])
    assert sorted(r["id"] for r in got.collect()) == ["0", "1", "2", "3", "5", "7", "9", "n"]
    assert dedup.capped_per_file(df, "path", [F.col("n")], None).count() == 11


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, id string, filename string, text string, score double, rrf double")


def test_context(spark):
    found = results(spark, [(1, 1, "a", "f", "x" * 120, 1.0, 0.3), (1, 2, "b", "g", "x" * 120 + "other", 0.9, 0.2), (1, 3, "c", None, None, 0.8, 0.1), (1, 4, "d", "f", "t", -1000.0, 0.4)])
    c = context.contexts(context.context_rows(found)).first()
    assert (c["included"], c["files"], c["max_rrf"]) == (2, 2, 0.3)
    assert c["context"].startswith('<source id="1" filename="f">\nxxx') and '<source id="2" filename="">\n\n</source>' in c["context"]


def test_decisions(spark):
    q = spark.createDataFrame([(1, "bonjour"), (2, "registre"), (3, "rien"), (4, "faible")], "query_id int, q string")
    found = results(spark, [(2, 1, "a", "f", "t", 0.5, 0.1), (4, 1, "a", "f", "t", 0.1, 0.1)])
    got = {r["query_id"]: r["decision"] for r in context.decisions(q, found, 0.3).collect()}
    assert got == {1: "small_talk", 2: "answer", 3: "no_source", 4: "not_covered"}


def test_platform_ties(spark):
    found = results(spark, [(1, 1, "a", "f", "STM32", 1.0, 0.1), (1, 2, "b", "ATmega", "x", 1.0, 0.1), (2, 1, "a", "f", "nothing", 1.0, 0.1)])
    assert {r["query_id"]: r["platform"] for r in context.platforms(found).collect()} == {1: "atmega", 2: None}


CASE = "test_id int, category string, type string, question string, keywords array<string>, sources array<string>, refusal_patterns array<string>"
RUN = "run_id int, test_id int, model string, result struct<answer: string, sources: array<string>, fallback: boolean, error: string>"


def test_grades(spark):
    cases = spark.createDataFrame([(1, "c", None, "q", ["Key", "no"], ["src"], None), (2, "c", "trap", "q", [], [], None), (3, "c", "normal", "q", [], [], None), (4, "c", "normal", "q", None, None, None)], CASE)
    runs = [(1, 1, ("a KEY", ["My_SRC.pdf"], False, None)), (2, 1, ("key", [], False, None)), (3, 1, (None, None, None, None)), (4, 1, ("key", [], False, "down")), (5, 2, ("Désolé", [], False, None)), (6, 2, ("yes", [], True, None)), (7, 2, ("yes", [], False, None)), (8, 3, ("", [], False, None)), (9, 4, ("", [], False, ""))]
    graded = evaluate.graded(spark.createDataFrame([(r, t, "m", x) for r, t, x in runs], RUN), cases)
    got = {r["run_id"]: r for r in graded.collect()}
    assert [got[k]["status"] for k in range(1, 10)] == ["PASS", "PARTIAL", "FAIL", "ERROR", "PASS", "PASS", "FAIL", "PASS", "PASS"]
    assert got[1]["keyword_found"] == ["Key"] and got[1]["keyword_missing"] == ["no"] and got[1]["source_found"] == ["src"]
    assert got[4]["keyword_found"] == [] and got[5]["source_missing"] == []


def test_latency(spark):
    rows = [("m", "a", 2.0), ("m", "b", None), ("n", "a", 4.06), (None, None, 1.0)]
    runs = spark.createDataFrame([(m, c, (t,)) for m, c, t in rows], "model string, category string, result struct<total_s: double>")
    got = {(r["model"], r["category"]): (r["mean_s"], r["most"]) for r in evaluate.latency(runs).collect()}
    assert got[("m", "a")] == (2.0, 4.1) and got[("m", "b")] == got[("n", "b")] == (0.0, 4.1) and len(got) == 9
    assert evaluate.latency(runs.where("false")).count() == 0
    assert evaluate.latency(runs.where("category = 'b'")).first()["most"] == 1.0


def test_runtime(spark):
    df = spark.range(10)
    assert written(df).count() == 10 and shared_dir(spark)
    assert pinned(df).count() == 10
    assert "ResolvedHint" in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, 5)._jdf.queryExecution().analyzed().toString()
    try:
        pinned(df, 5)
    except ValueError:
        return
    raise AssertionError
