import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.operators.chunking import LEAST, chunked, register, semantic_chunks


def sent(k):
    return " ".join(f"This is sentence number {i:03d} of the body." for i in range(k))


FENCE = "```\ncode\n```"
CASES = {
    "minimum": ("a" * 149, []),
    "boundary": ("a" * 150, [150]),
    "packing": ("a" * 200 + "\n\n" + "b" * 200, [402]),
    "section": (f"{sent(6)}\n\n# Title\n\n{sent(6)}", [245, 254]),
    "size": (f"{sent(30)}\n\n{sent(10)}", [1229, 451]),
    "long line": ("x" * 4000, [4000]),
    "lines": ("\n".join([sent(5)] * 12), [1434, 1066]),
    "lost tail": (f"{sent(36)}\n\ntail words only here, forty chars long ok", [1475]),
    "fence": (f"{FENCE}\n\n{sent(30)}\n\n{sent(30)}", [2474]),
    "stale length": (f"{sent(30)}\n\n# {sent(10)}", [1229, 453]),
    "numbered": (f"{sent(6)}\n\n1.2 Introduction\n\n{sent(6)}", [245, 263]),
    "no letters": (f"{sent(6)}\n\n123 456 789\n\n{sent(6)}", [245, 258]),
    "white space": (f"a\tb\r\n{sent(6)}", [249]),
    "no sentence end": (("w" * 9 + " ") * 140 + f"\n\n{sent(10)}", [1399, 409]),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(name):
    text, lengths = CASES[name]
    assert [len(c) for c in semantic_chunks(text)] == lengths


def test_overlap_and_prefix():
    text = CASES["size"][0]
    assert semantic_chunks(text)[1].startswith("This is sentence number 029 of the body.\n\n")
    assert [len(c) for c in semantic_chunks(text, prefix="[D]")] == [1233, 455]
    assert semantic_chunks(CASES["section"][0])[1].startswith("# Title")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n#`1Z", max_size=400), max_size=12))
def test_lengths(parts):
    for c in semantic_chunks("\n\n".join(parts), size=300, overlap=60):
        assert len(c) >= LEAST


def test_table(spark):
    rows = [("d/datasheet.txt", sent(6)), ("x.txt", None), ("y.txt", "short"), (None, sent(30) + "\n\n" + sent(10))]
    got = sorted((r["path"] or "", r["chunk_ord"], len(r["text"])) for r in chunked(spark.createDataFrame(rows, "path string, text string"), "path", "text").collect())
    prefix = len("[Domaine: Microcontrôleur ATmega328 AVR Électronique]") + 1
    assert got == [("", 0, 1229), ("", 1, 451), ("d/datasheet.txt", 0, 245 + prefix)]
    assert chunked(spark.createDataFrame([], "path string, text string"), "path", "text").count() == 0


def test_sql_function(spark):
    register(spark)
    spark.createDataFrame([(sent(30) + "\n\n" + sent(10),)], "t string").createOrReplaceTempView("docs")
    rows = spark.sql("SELECT c.chunk_ord, length(c.chunk) AS n FROM docs, LATERAL chunk_text(t, 1500, 150, '') c ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(0, 1229), (1, 451)]
