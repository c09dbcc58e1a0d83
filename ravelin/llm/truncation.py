"""Text cut off by field limits (problem 9).

Length histograms decide first. For each source and text column, lengths in characters and in bytes (with and without a mark of omission) are
counted over different texts, and a length that is far more frequent than those around it, by size and by a test of significance, is a limit;
a text at a limit that doesn't end as a whole one does was cut off there. Transfers that break off leave no limit: of texts away from every
limit, those whose last line is prose without terminal punctuation, an open code block, or debris of a sign are cut off as well. Lines that
commonly end without a full stop (headings, list items, table rows, log records, links, notes, closing lines) count as whole when they have the
form of their kind, away from a limit. Each row says which evidence it rests on.

Defined results: null, blank and one-sign texts are never cut off; a null source is a source of its own, named null in the report; repeated
rows of one identifier count once (the text whose hash is smallest is used if they differ); copies of a text in one source count once for limits;
rows without identifier are left out; an empty table gives empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.runtime import broadcast_if_small, written

#: A limit has at least this many times what the lengths around it have on average, and as many times what any of them has: a limit in bytes is no
#: sharp one in characters. RISK is the chance that a source without limits shows one, by the Chernoff bound of a Poisson variable,
#: scaled by how uneven the lengths around are.
TIMES, PEAK, RISK = 8, 3, 1e-4
#: Lengths around, and those so close that they count as the limit's own: white space is trimmed, a sign of several bytes is dropped or replaced.
AROUND, CLOSE = 60, 3
AT = {"chars": (2, 0), "bytes": (3, 2), "body_chars": (2, 0), "body_bytes": (3, 2)}
LIMIT, ENDING = "limit", "ending"
#: Sources with limits that are broadcast, each a few lists of lengths; with more the tables are joined by source.
SOURCES = 50_000

# Phrases that end a text with dots though nothing is missing, lines that close a sheet, marks and debris of a cut.
ON = re.compile(r"(?:^|[\s.!?;,])(?:et ainsi de suite|and so on|und so weiter|y así sucesivamente|etc)\s*(?:\.{2,}|…)$", re.I)
CLOSING = re.compile(r"(?:fin|end)(?: (?:de la |du |de l'|of (?:the )?)?\w+)?|(?:révision|revision|version|atelier|workshop|annexe|appendix|page|partie|part|fiche|sheet|section|chapitre|chapter) (?:\d+|[A-Z])", re.I)
MARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.+|…)$")
DEBRIS = re.compile(r"(?:�|&#?\w{0,6}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-Fa-f]?)$")
SHORT_FORM = re.compile(r"(?:^|[\s(])(?:p|ex|cf|env|fig|e|g|e\.g|i\.e|p\. ex|approx|art|chap|no|vs|max|min|réf|ref)\.$", re.I)
BROKEN_NUMBER = re.compile(r"(?<!fig\.)(?<!no\.)(?<!art\.)\s\d+(?:\.\d+)*\.$")
TERMINAL = re.compile(r"[.!?。！？][\"'’”»)\]]*$")
NOTE = re.compile(r"(?:\[[^\[\]]+\]|\([^()]+\))$")
LINK = re.compile(r"https?://\S+$")
WHOLE_LINK = re.compile(r"https?://[\w.-]+\.\w{2,}(?::\d+)?/\S+$")
LOG = re.compile(r"\[\d+\] |\d{4}-\d\d-\d\d[T ]|<\d+>")
ITEM = re.compile(r"(?:[-*+•]|\d+[.)]) ")

WHOLE, CUT, OPEN = 0, 1, 2  # OPEN: whole, unless it's at a limit


def ending(text: str) -> int:
    """How a text ends, by its last lines. A note in brackets after the end doesn't hide what's before it."""
    end = text.rstrip()
    if len(end) < 2 or not any(c.isalnum() for c in end):
        return WHOLE
    last = end[end.rfind("\n") + 1 :].strip()
    noted = NOTE.search(last)
    if noted and not MARK.search(last):
        if not last[: noted.start()].strip():
            return WHOLE
        end = end[: len(end) - len(noted[0])].rstrip()
        last = last[: noted.start()].strip()
    else:
        noted = None
    fences = end.count("\n```") + end.startswith("```") if "```" in end else 0
    if fences % 2:
        return CUT
    if last.startswith("```"):
        return WHOLE
    if DEBRIS.search(last):
        return CUT
    if ON.search(last) or CLOSING.fullmatch(last):
        return WHOLE
    if MARK.search(last):
        return CUT
    cut_before = end.rfind("\n", 0, len(end) - len(last))
    before = end[cut_before:].strip().split("\n")[:-1] if cut_before >= 0 else []
    if last.startswith("|"):
        before = before[-1].strip() if before else ""
        return (WHOLE if before.count("|") in (0, last.count("|")) or not before.startswith("|") else CUT) if last.endswith("|") and len(last) > 1 else CUT
    if last.startswith("#"):
        return WHOLE if noted else OPEN
    if LOG.match(last):
        return (WHOLE if noted else OPEN) if len(last.split()) > 4 else CUT
    if LINK.search(last):
        return OPEN if WHOLE_LINK.search(last) else CUT
    if ITEM.match(last):
        listed = end[:-len(last)].rstrip().rsplit("\n", 1)[-1].strip()
        if ITEM.match(listed) and listed.endswith((";", ",")) and not TERMINAL.search(last):
            return CUT
        return WHOLE if noted or TERMINAL.search(last) else OPEN
    if TERMINAL.search(last):
        return CUT if SHORT_FORM.search(last) or BROKEN_NUMBER.search(last) else WHOLE
    return CUT


def endings(df: DataFrame, id_col: str = "doc_id", text_col: str | Sequence[str] = "text", source_col: str = "source") -> DataFrame:
    """id, source, field (the text column), look (hash of the text), ends, chars, bytes, body_chars, body_bytes: lengths as stored and without a mark of omission."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("t").to_pylist():
                tail = text[-40:]
                mark = MARK.search(tail.rstrip()) if text else None
                body = len(text) - (len(tail) - len(tail.rstrip()[: mark.start()])) if mark else len(text)
                out.append((ending(text), len(text), len(text.encode("utf-8", "replace")), body, len(text[:body].encode("utf-8", "replace"))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int8(), *[pa.int64()] * 4)))], ["id", "source", "field", "look", "ends", "chars", "bytes", "body_chars", "body_bytes"])

    columns = [text_col] if isinstance(text_col, str) else list(text_col)
    each = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in columns])).alias("x"))
    rows = each.select("id", "source", "x.field", F.xxhash64("x.t").alias("look"), "x.t").where("id is not null and t is not null")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, source string, field string, look long, ends byte, chars long, bytes long, body_chars long, body_bytes long")


UNITS = ("chars", "bytes", "body_chars", "body_bytes")


def limits(read: DataFrame) -> DataFrame:
    """source, field, unit, length, n: lengths at which a source's different texts pile up.

    The histogram is aggregated in the map tasks. A source's own is one window: it has at most as many rows as there are different lengths.
    """
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS])
    each = read.select("source", "field", "look", *UNITS).distinct().select("source", "field", F.inline(units)).where("length > 1")
    hist = each.groupBy("source", "field", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("source", "field", "unit")
    near = by.orderBy("length")
    highest = F.greatest(*[F.coalesce(F.max("n").over(near.rangeBetween(*w)), F.lit(0)) for w in ((-AROUND, -CLOSE - 1), (CLOSE + 1, AROUND))])
    total = lambda x, width: F.sum(x).over(near.rangeBetween(-width, width))
    square = F.col("n") * F.col("n")
    seen = hist.select("*", F.count(F.lit(1)).over(by).alias("lengths"), (total("n", AROUND) - total("n", CLOSE)).alias("around"), (total(square, AROUND) - total(square, CLOSE)).alias("squares"), highest.alias("next"))
    usual = (F.col("around") + 1) / F.lit(2.0 * (AROUND - CLOSE))  # one more, for lengths around that nothing has
    uneven = F.greatest(F.lit(1.0), F.coalesce(F.try_divide("squares", "around"), F.lit(1.0)))  # lengths of texts made alike come in lumps
    rare = (F.col("n") * F.log(F.col("n") / usual) - F.col("n") + usual) / uneven  # less the logarithm of the chance of so many
    return seen.where((F.col("n") >= TIMES * usual) & (F.col("n") >= PEAK * F.col("next")) & (rare >= F.log(F.col("lengths") / F.lit(RISK)))).select("source", "field", "unit", "length", "n")


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str | Sequence[str] = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Texts (id, source, field, truncated, evidence), each identifier's field once, and the limits found (as limits()).

    evidence is `limit` for a text at a limit, `ending` for one cut off elsewhere, null for a whole one. Every row is compared with the limits.
    """
    one = F.min(F.struct("look", "source", "ends", *UNITS)).alias("r")
    read = written(endings(df, id_col, text_col, source_col).groupBy("id", "field").agg(one).select("id", "field", "r.*"), "endings")
    found = written(limits(read), "limits")
    below, above = (F.element_at(F.create_map(*[x for u in UNITS for x in (F.lit(u), F.lit(AT[u][k]))]), F.col("unit")) for k in (0, 1))
    near = F.sequence(F.col("length") - below, F.col("length") + above)
    # a row a source and column: the lengths at its limits, as few as it has limits
    wide = found.groupBy("source", "field").agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(F.col("unit") == u, near)))).alias(f"at_{u}") for u in UNITS])
    r, w = read.alias("r"), broadcast_if_small(written(wide, "at"), SOURCES).alias("w")
    met = r.join(w, F.col("r.source").eqNullSafe(F.col("w.source")) & (F.col("r.field") == F.col("w.field")), "left")
    at = F.lit(False)
    for u in UNITS:
        at = at | F.coalesce(F.array_contains(f"w.at_{u}", F.col(f"r.{u}")), F.lit(False))
    evidence = F.when(at & (F.col("r.ends") != WHOLE), LIMIT).when(F.col("r.ends") == CUT, ENDING)
    return met.select("r.id", "r.source", "r.field", evidence.isNotNull().alias("truncated"), evidence.alias("evidence")), found


def truncated(df: DataFrame, id_col: str = "doc_id", text_col: str | Sequence[str] = "text", source_col: str = "source") -> DataFrame:
    """id, field, evidence of each text that was cut off."""
    docs, _ = judged(df, id_col, text_col, source_col)
    return docs.where("truncated").select("id", "field", "evidence")


def rates(df: DataFrame, id_col: str = "doc_id", text_col: str | Sequence[str] = "text", source_col: str = "source") -> DataFrame:
    """source, field, documents (with a text), truncated, by_limit, by_ending, share, limit_chars, limit_bytes (the most frequent limits, null if there's none)."""
    docs, found = judged(df, id_col, text_col, source_col)
    counts = docs.groupBy("source", "field").agg(F.count(F.lit(1)).alias("documents"), F.count_if("truncated").alias("truncated"), *[F.count_if(F.coalesce(F.col("evidence") == e, F.lit(False))).alias(f"by_{e}") for e in (LIMIT, ENDING)])
    most = found.groupBy("source", "field").agg(
        F.max_by(F.when(F.col("unit").endswith("chars"), F.col("length")), F.when(F.col("unit").endswith("chars"), F.struct("n", "length"))).alias("limit_chars"),
        F.max_by(F.when(F.col("unit").endswith("bytes"), F.col("length")), F.when(F.col("unit").endswith("bytes"), F.struct("n", "length"))).alias("limit_bytes"),
    )
    joined = counts.alias("c").join(most.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source")) & (F.col("c.field") == F.col("m.field")), "left")
    return joined.select("c.source", "c.field", "documents", "truncated", "by_limit", "by_ending", F.round(F.col("truncated") / F.col("documents"), 6).alias("share"), "limit_chars", "limit_bytes")
