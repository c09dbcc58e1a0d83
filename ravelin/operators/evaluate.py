"""Grading of answers and reports by model and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import rules
from ravelin.functions import text as T
from ravelin.runtime import pinned

#: Reports have at most so many cells of model and category.
CELLS = 20_000


def runs_once(runs: DataFrame) -> DataFrame:
    """Each run as it was loaded first."""
    return runs.withColumn("__n", F.row_number().over(W.partitionBy("run_id").orderBy(F.asc_nulls_last("loaded_at")))).where("__n = 1").drop("__n")


def found_in(expected: Column, text: Column) -> Column:
    """Those of the expected strings that are in the text, without regard to case."""
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda k: F.coalesce(F.lower(text).contains(F.lower(k)), F.lit(False)))


def found_among(expected: Column, names: Column) -> Column:
    """Those of the expected strings that are in any of the names."""
    return F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda k: F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda s: F.coalesce(F.lower(s).contains(F.lower(k)), F.lit(False))))


def graded(runs: DataFrame, cases: DataFrame, refusals: list[str] = rules.REFUSALS, traps: bool = True) -> DataFrame:
    """run_id, model, test_id, status, keyword_found, source_found, keyword_missing, source_missing.

    A null answer is an empty one, a null type means normal, null patterns the default ones; an empty list of expectations counts as met.
    With traps=False questions that should be refused are graded like any other.
    """
    wanted = cases.select("test_id", F.coalesce("type", F.lit("normal")).alias("kind"), "keywords", F.col("sources").alias("expected"), F.coalesce("refusal_patterns", T.strings(refusals)).alias("patterns"))
    answer = F.coalesce(F.col("result.answer"), F.lit(""))
    joined = runs.select("run_id", "model", "test_id", F.col("result.error").alias("error"), F.coalesce("result.fallback", F.lit(False)).alias("fallback"), answer.alias("answer"), F.col("result.sources").alias("names")).join(F.broadcast(wanted), "test_id")
    k, s = found_in(F.col("keywords"), F.col("answer")), found_among(F.col("expected"), F.col("names"))
    none = F.array().cast("array<string>")
    trap, error = (F.col("kind") == "trap") & F.lit(traps), F.coalesce("error", F.lit("")) != ""
    refused = F.exists("patterns", lambda p: F.coalesce(F.lower("answer").contains(F.lower(p)), F.lit(False))) | F.col("fallback")
    k_hit, s_hit = (F.size("k") > 0) | (F.coalesce(F.size("keywords"), F.lit(0)) <= 0), (F.size("s") > 0) | (F.coalesce(F.size("expected"), F.lit(0)) <= 0)
    normal = F.when(k_hit & s_hit, "PASS").when(k_hit | s_hit, "PARTIAL").otherwise("FAIL")
    found = joined.withColumns({"k": k, "s": s})
    skip = error | trap
    return found.select(
        "run_id", "model", "test_id", F.when(error, "ERROR").when(trap, F.when(refused, "PASS").otherwise("FAIL")).otherwise(normal).alias("status"),
        F.when(skip, none).otherwise(F.col("k")).alias("keyword_found"), F.when(skip, none).otherwise(F.col("s")).alias("source_found"),
        F.when(skip, none).otherwise(F.filter(F.coalesce("keywords", none), lambda x: ~F.array_contains("k", x))).alias("keyword_missing"),
        F.when(skip, none).otherwise(F.filter(F.coalesce("expected", none), lambda x: ~F.array_contains("s", x))).alias("source_missing"),
    )


def source_matches(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """run_id, expected, filename: each expected source with each returned file whose name has it. Joins runs to their case, not all to all."""
    files = runs.select("run_id", "test_id", F.explode("result.sources").alias("filename"))
    wanted = cases.select("test_id", F.explode("sources").alias("expected"))
    return files.join(F.broadcast(wanted), "test_id").where(F.lower("filename").contains(F.lower("expected"))).select("run_id", "expected", "filename").distinct()


def summary(runs: DataFrame) -> DataFrame:
    """Per model: tests, the number of each status, pass_pct, mean_s (of the runs with a time), traps_ok, traps, fallbacks."""
    status = F.col("eval.status")
    trap = F.coalesce(F.col("test_type") == "trap", F.lit(False))
    n = F.count(F.lit(1))
    return runs.groupBy("model").agg(
        n.alias("tests"), *[F.count_if(status == s).alias(s.lower()) for s in ("PASS", "PARTIAL", "FAIL", "ERROR")],
        F.round(F.count_if(status == "PASS") / n * 100, 1).alias("pass_pct"), F.round(F.avg("result.total_s"), 3).alias("mean_s"),
        F.count_if(trap & (status == "PASS")).alias("traps_ok"), F.count_if(trap).alias("traps"), F.count_if(F.col("result.fallback")).alias("fallbacks"),
    )


def latency(runs: DataFrame) -> DataFrame:
    """model, category, mean_s (1 decimal; 0 where a model has no time in a category), most: the largest mean, at least 1 if all are 0."""
    mean = pinned(runs.groupBy("model", "category").agg(F.avg("result.total_s").alias("m")), CELLS)  # models and categories are few
    categories = F.array(*[F.lit(r["category"]) for r in mean.select("category").distinct().collect()] or [F.lit(None).cast("string")])
    grid = mean.select("model").distinct().select("model", F.explode(categories).alias("category"))
    full = grid.alias("g").join(mean.alias("m"), F.col("g.model").eqNullSafe(F.col("m.model")) & F.col("g.category").eqNullSafe(F.col("m.category")), "left")
    rows = pinned(full.select("g.model", "g.category", F.round(F.coalesce("m", F.lit(0.0)), 1).alias("mean_s")), CELLS)
    most = rows.agg(F.max("mean_s").alias("most")).first()["most"]
    return rows.withColumn("most", F.lit(float(most or 1.0)))


def pivoted(rows: DataFrame, by: list[str], models: list[str], value: Column) -> DataFrame:
    """One column a model, named by it. The models are given, so that no job has to look for them."""
    return rows.groupBy(*by).pivot("model", models).agg(value)


def source_scores(runs: DataFrame) -> DataFrame:
    """category, model, mean_score (3 decimals) over all sources of all runs, and its bucket."""
    each = runs.select("category", "model", F.explode("result.source_scores").alias("filename", "score"))
    return each.groupBy("category", "model").agg(F.round(F.avg("score"), 3).alias("mean_score")).withColumn("bucket", T.score_bucket(F.col("mean_score")))


def status_matrix(runs: DataFrame, models: list[str]) -> DataFrame:
    """test_id, question (58 code points), and for each model the status of its latest run of the test, a dash if there's none."""
    last = runs.groupBy("test_id", "model").agg(F.max_by(F.struct(F.col("eval.status").alias("s"), F.col("result.question").alias("q")), F.struct("finished_at", "run_id")).alias("x"))
    question = last.groupBy("test_id").agg(F.min("x.q").alias("question"))
    wide = pivoted(last, ["test_id"], models, F.first("x.s"))
    return wide.join(question, "test_id").select("test_id", T.clipped(F.col("question"), 58).alias("question"), *[F.coalesce(F.col(f"`{m}`"), F.lit("—")).alias(m) for m in models])


def running_mean(runs: DataFrame) -> DataFrame:
    """run_id, model, done, mean_s, left_s: after each run its model's mean time so far and what the rest will take at that pace. Null times count as 0.

    Sums over hours come first and are added up, then runs within an hour: no task gets all runs of a model. They're sums of decimals, which
    are the same in any order.
    """
    rows = runs.select("run_id", "model", "finished_at", F.coalesce("result.total_s", F.lit(0.0)).cast("decimal(18,6)").alias("t"), F.coalesce(F.date_trunc("hour", "finished_at"), F.lit("0001-01-01").cast("timestamp")).alias("hour"))
    hours = rows.groupBy("model", "hour").agg(F.sum("t").alias("s"), F.count(F.lit(1)).alias("n"))
    of = W.partitionBy("model")
    earlier = of.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    before = hours.select("model", "hour", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("n").over(of).alias("all"))
    by = W.partitionBy("model", "hour").orderBy("finished_at", "run_id")
    joined = rows.alias("r").join(before.alias("b"), F.col("r.model").eqNullSafe(F.col("b.model")) & (F.col("r.hour") == F.col("b.hour"))).select("r.*", "s0", "n0", "all")
    so_far = joined.select("run_id", "model", (F.row_number().over(by) + F.col("n0")).cast("int").alias("done"), (F.sum("t").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("s0")).cast("double").alias("s"), "all")
    mean = F.col("s") / F.col("done")
    return so_far.select("run_id", "model", "done", F.round(mean, 3).alias("mean_s"), F.round(mean * (F.col("all") - F.col("done")), 3).alias("left_s"))
