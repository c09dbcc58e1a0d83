import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "wanted"), [("  quels bits ?? ", "quels bits "), ("abc.?!", "abc"), ("", ""), (None, None)])
def test_normal_query(spark, given, wanted):
    assert one(spark, T.normal_query, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("x" * 200 + ". tail", "tail"), ("short", "short"), ("z" * 300, ""), ("q" * 200 + "End.", ""), (None, None)])
def test_tail_sentence(spark, given, wanted):
    assert one(spark, T.tail_sentence, given) == wanted


@pytest.mark.parametrize(
    ("paragraph", "section"),
    [("# T", True), ("== x", True), ("-- x", True), ("1.2 Introduction", True), ("1.2 introduction", False), ("123 456 789", True), ("ABC", False), ("GRAND TITRE", True), ("Grand titre", False), ("A" * 40 + " " + "B" * 60, False), ("", False)],
)
def test_is_section(spark, paragraph, section):
    from ravelin.operators.chunking import opens_section

    assert one(spark, T.is_section, paragraph) is section
    assert opens_section(paragraph) is section


def test_lines_and_paragraphs(spark):
    assert one(spark, T.normal_lines, " a\tb  c \r\n\r\n d\re ") == "a b c\n\nd\ne"
    assert one(spark, T.paragraphs, "a\n\n\n\nb \n c") == ["a", "b\nc"]


def test_question_kinds(spark):
    assert one(spark, T.question_kind, "à quoi sert le bit ADEN ?") == "register"
    assert one(spark, T.question_kind, "combien de volts") == "calculation"
    assert one(spark, T.question_kind, "expliquer le SPI") == "concept"
    assert one(spark, T.question_kind, "écrire une boucle") == "code"
    assert one(spark, T.question_kind, "où est-il") == "general"
    assert one(spark, T.question_kind, None) is None


def test_small_talk_within_words(spark):
    assert one(spark, T.is_small_talk, "une architecture") is True
    assert one(spark, lambda c: T.is_small_talk(c, word_boundary=True), "une architecture") is False
    assert one(spark, lambda c: T.is_small_talk(c, word_boundary=True), "hi there") is True


def test_words(spark):
    assert one(spark, T.without_stop_words, "Comment régler les bits, est-ce utile ?") == "régler bits, utile ?"
    assert one(spark, T.expanded_query, "Comment régler le ADC (x) ?") == "régler ADC"
    assert one(spark, T.tokens, "RÉSEAU réseau_802.1X") == ["reseau", "reseau", "802", "1x"]
    assert one(spark, T.tokens, None) == []


@pytest.mark.parametrize(("given", "wanted"), [("12ms", 12.0), ("3.4s", 3.4), ("21,7s", 21.7), (None, 0.0), ("soon", 0.0), ("", 0.0)])
def test_seconds(spark, given, wanted):
    assert one(spark, T.seconds, given) == wanted


def test_display(spark):
    assert one(spark, lambda c: T.clipped(c, 3), "abcd") == "abc…"
    assert one(spark, lambda c: T.clipped(c, 4), "abcd") == "abcd"
    assert [one(spark, T.score_bucket, v, "double") for v in (0.7, 0.4, 0.1, 0.0, None, float("nan"))] == ["good", "fair", "poor", "none", "none", "none"]


def test_vectors(spark):
    row = spark.createDataFrame([([0.0] * 8, [1.0] * 8, [1.0, 2.0])], "z array<float>, o array<float>, s array<float>").select(
        V.cosine("z", "o").alias("zero"), V.cosine("o", "o").alias("same"), V.cosine(F.col("o"), F.col("s")).alias("sizes"), V.mean(F.col("z"), F.col("o")).alias("m"), V.mean(F.col("z"), F.col("s")).alias("k")
    )
    r = row.first()
    assert (r["zero"], round(r["same"], 9), r["sizes"], r["m"], r["k"]) == (0.0, 1.0, None, [0.5] * 8, [0.0] * 8)
