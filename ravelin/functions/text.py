"""Column expressions over text: normalisation, structure, query analysis, tokens. All of them run in the JVM.

Null in, null out, unless said otherwise; the empty text is an ordinary text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import rules

#: Ends of a text as trimming sees them.
WHITE = "\t\n\u000b\f\r \u0085                 　"


def strings(values: list[str]) -> Column:
    """A constant array."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def contains_any(text: Column, patterns: list[str], fold: bool = True) -> Column:
    """Whether text contains one of the patterns, without regard to case by default. No pattern: false."""
    hay = F.lower(text) if fold else text
    found = F.lit(False)
    for p in patterns:
        found = found | hay.contains(p.lower() if fold else p)
    return found


def first_case(text: Column, cases: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first case one of whose patterns is in the lower-cased text."""
    label = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, patterns in cases:
        label = label.when(contains_any(text, patterns), F.lit(name))
    return label.otherwise(F.lit(default))


def domain(path: Column, cases: list[tuple[str, list[str]]] = rules.DOMAINS) -> Column:
    """Prefix that anchors a file's chunks in its domain; the empty string if there's none."""
    return first_case(path, cases, "")


def question_kind(question: Column, cases: list[tuple[str, list[str]]] = rules.QUESTION_KINDS) -> Column:
    return first_case(question, cases, "general")


def is_small_talk(question: Column, triggers: list[str] = rules.SMALL_TALK, word_boundary: bool = False) -> Column:
    """Whether a trigger occurs; within other words as well, unless word_boundary is set."""
    if not word_boundary:
        return contains_any(question, triggers)
    import re

    return F.lower(question).rlike(r"(?U)\b(?:" + "|".join(re.escape(t) for t in triggers) + r")\b")


def is_technical(question: Column, terms: list[str] = rules.TECHNICAL_TERMS) -> Column:
    return contains_any(question, terms)


def is_large_model(name: Column, marks: list[str] = rules.LARGE_MODELS) -> Column:
    return contains_any(name, marks)


def normal_lines(text: Column) -> Column:
    """Line ends as LF, white space within a line as one space, none at its ends."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(lf, f"[{rules.SPACE_CLASS}]+", " "), " ?\n ?", "\n"), F.lit(" "))


def collapsed(text: Column) -> Column:
    """All white space, line ends too, as one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, f"[\n{rules.SPACE_CLASS}]+", " "), F.lit(" "))


def paragraphs(text: Column) -> Column:
    """Array of a text's paragraphs in normal form; empty ones are left out."""
    return F.filter(F.transform(F.split(normal_lines(text), "\n\n"), lambda p: F.btrim(p, F.lit(" \n"))), lambda p: p != "")


def is_section(paragraph: Column) -> Column:
    """Whether a paragraph opens a section: a heading, a rule, a numbered title, or a short line in capitals."""
    line = F.regexp_extract(F.btrim(paragraph, F.lit(WHITE)), r"^[^\n]*", 0)
    numbered = line.rlike(r"^\d") & F.regexp_replace(line, f"^[0-9.]+[{rules.SPACE_CLASS}]*", "").rlike(r"^\p{Lu}")
    capitals = (line == F.upper(line)) & (F.char_length(line) > 5) & line.contains(" ")
    return paragraph.startswith("#") | paragraph.startswith("==") | paragraph.startswith("--") | ((F.char_length(line) < 80) & (line != "") & (numbered | capitals))


def is_code_block(paragraph: Column) -> Column:
    return paragraph.startswith("```") | paragraph.startswith("~~~")


def tail_sentence(text: Column, n: int = 150) -> Column:
    """What follows the last sentence end among the last n code points, or the whole of a text that isn't longer; empty if there's no sentence end."""
    tail = F.regexp_extract(F.right(text, F.lit(n)), r"(?s)^.*[.!?](.+)$", 1)
    return F.when(F.char_length(text) <= n, text).otherwise(F.btrim(tail, F.lit(WHITE)))


def normal_query(question: Column) -> Column:
    """Trimmed, then without punctuation at the end; a space before that punctuation stays."""
    return F.regexp_replace(F.btrim(question, F.lit(WHITE)), "[.,;:!?]+$", "")


def words(question: Column) -> Column:
    """Array of what white space separates."""
    return F.filter(F.split(question, f"[\n{rules.SPACE_CLASS}]+"), lambda w: w != "")


def bare(word: Column) -> Column:
    return F.btrim(word, F.lit(rules.TRIMMED))


def without_stop_words(question: Column, stop: list[str] = rules.EMBEDDING_STOP_WORDS) -> Column:
    """The question's words but for stop words, joined by spaces: for its second embedding."""
    return F.array_join(F.filter(words(question), lambda w: ~F.array_contains(strings(stop), F.lower(bare(w)))), " ")


def expanded_query(question: Column, stop: list[str] = rules.STOP_WORDS) -> Column:
    """The question's words of three letters or more that aren't stop words: for the second full-text pass."""
    return F.array_join(F.filter(words(question), lambda w: (F.char_length(bare(w)) > 2) & ~F.array_contains(strings(stop), F.lower(bare(w)))), " ")


def folded(text: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.regexp_replace(F.lower(text), r"[\x{300}-\x{36F}]", ""), rules.ACCENTED, rules.UNACCENTED)


def tokens(text: Column) -> Column:
    """Array of the runs of letters and digits in a folded text. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def clipped(text: Column, n: int, dots: str = "…") -> Column:
    """For display: the first n code points and dots, if the text is longer."""
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(dots))).otherwise(text)


def score_bucket(score: Column) -> Column:
    """good, fair, poor or none. Null and NaN count as none."""
    return F.when(F.isnan(score), "none").when(score >= 0.7, "good").when(score >= 0.4, "fair").when(score > 0, "poor").otherwise("none")


def seconds(text: Column) -> Column:
    """Number in a duration such as 12ms or 3.4s, in its own unit; a comma counts as a point, and what isn't a number (null too) as 0."""
    number = F.regexp_replace(F.btrim(F.replace(text, F.lit(","), F.lit(".")), F.lit(" ")), r"\s*m?s$", "")
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes of the UTF-8 form, as a binary: a key that may end within a sign."""
    return F.substring(F.encode(text, "UTF-8"), 1, n)


def chunk_id(*parts: Column) -> Column:
    """Deterministic identifier, so that indexing the same files again changes nothing."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)
