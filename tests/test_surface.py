import pytest
from pyspark.sql import functions as F

from ravelin import cli
from ravelin.functions.register import register
from ravelin.operators import evaluate
from ravelin.operators.rerank import generated


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT cosine(array(1F, 0F), array(1F, 1F)) AS c, cosine(array(0F), array(1F)) AS z, cosine(array(1F), array(1F, 2F)) AS n, folded('ÉTÉ') AS f, round(bm25_part(1, 2, 10, 10), 6) AS b").first()
    assert (round(r["c"], 6), r["z"], r["n"], r["f"], r["b"]) == (0.707107, 0.0, None, "ete", 1.375)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alpha beta gamma " * 20)
    store = str(tmp_path / "s")
    cli.main([store, "index", str(tmp_path / "in")], spark)
    for command in (["stats"], ["files"], ["search", "Alpha"]):
        cli.main([store, *command], spark)
        assert "a.txt" in capsys.readouterr().out or command == ["stats"]
    cli.main([store, "clear"], spark)
    cli.main([store, "files"], spark)
    assert "a.txt" not in capsys.readouterr().out


def test_generator(spark):
    class Model:
        def generate(self, prompts):
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, None)], "query_id int, prompt string").coalesce(1)
    assert [(r["answer"], r["error"]) for r in generated(df, Model()).orderBy("query_id").collect()] == [("A", None), (None, None)]
    bad = spark.createDataFrame([(1, "bad")], "query_id int, prompt string")
    assert generated(bad, Model()).first()["error"] == "no"


def test_running_mean_over_hours(spark):
    rows = [(k, "m", f"2025-01-01 0{k // 2}:00:00", float(k)) for k in range(6)] + [(9, None, None, None)]
    df = spark.createDataFrame(rows, "run_id int, model string, at string, t double").select("run_id", "model", F.to_timestamp("at").alias("finished_at"), F.struct(F.col("t").alias("total_s")).alias("result"))
    got = {r["run_id"]: (r["done"], r["mean_s"], r["left_s"]) for r in evaluate.running_mean(df).collect()}
    assert got[3] == (4, 1.5, 3.0) and got[5] == (6, 2.5, 0.0) and got[9] == (1, 0.0, 0.0)


@pytest.mark.parametrize("traps", [True, False])
def test_traps_switch(spark, traps):
    cases = spark.createDataFrame([(1, "c", "trap", "q", ["k"], [], None)], "test_id int, category string, type string, question string, keywords array<string>, sources array<string>, refusal_patterns array<string>")
    runs = spark.createDataFrame([(1, 1, "m", ("k", [], False, None))], "run_id int, test_id int, model string, result struct<answer: string, sources: array<string>, fallback: boolean, error: string>")
    assert evaluate.graded(runs, cases, traps=traps).first()["status"] == ("FAIL" if traps else "PASS")
