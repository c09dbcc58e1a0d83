"""The pN_ queries with production parameters over whole tables. oracle_sql() has those that DuckDB can compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.similar_vectors import neighbour_pairs

    return neighbour_pairs(_table(spark, sf_dir, "test"), "id", "vector", dims=64, k=10, least=0.85)


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 10 neighbours of every usable point."""
    from ravelin.llm.similar_vectors import neighbours

    return neighbours(_table(spark, sf_dir, "test"), "id", "vector", dims=64, k=10, least=0.85)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.near_duplicates import similar_pairs

    return similar_pairs(_table(spark, sf_dir, "chunks"), "id", "text", threshold=0.7, min_words=40)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk with its group of near duplicates."""
    from ravelin.llm.near_duplicates import groups

    return groups(_table(spark, sf_dir, "chunks"), "id", "text", threshold=0.7, min_words=40)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_no = 0").select("id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.splitting import split_oversized

    return split_oversized(_table(spark, sf_dir, "chunks"), limit=1500, overlap=150)


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each chunk give without their overlaps, and whether pieces and overlaps keep their limits."""
    pieces = p3_pieces(spark, sf_dir)
    own = F.sort_array(F.collect_set(F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("own"))))
    return pieces.groupBy("id").agg(F.array_join(F.transform(own, lambda x: x["own"]), "").alias("text"), ((F.max(F.char_length("piece")) <= 1500) & (F.max("overlap") <= 150)).alias("within"))


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.variety import varied_subset

    return varied_subset(_table(spark, sf_dir, "test"), "id", "vector", "payload.filename", dims=64, share=0.05)


def p4_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points are chosen, and whether any comes twice or any file name has more than its share while others are left."""
    chosen = p4_subset(spark, sf_dir)
    of = chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))
    most = F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0))
    return of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chosen"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), (most <= F.greatest(F.lit(1), F.ceil(0.02 * F.sum("n")))).alias("within"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.contributor_cap import dropped

    return dropped(_table(spark, sf_dir, "chunks"), "filename", "score", "id", cap=20)


def p5_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that stay, as full records. A score that's no number is shown as null with a mark, for tables to be comparable."""
    from ravelin.llm.contributor_cap import capped

    kept = capped(_table(spark, sf_dir, "chunks"), "filename", "score", "id", cap=20)
    return kept.withColumns({"score": F.when(~F.isnan("score"), F.col("score")), "score_is_nan": F.coalesce(F.isnan("score"), F.lit(False))})


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each file name keeps when none may have more than a thousandth of all."""
    from ravelin.llm.contributor_cap import capped

    return capped(_table(spark, sf_dir, "chunks").select("id", "filename", "score"), "filename", "score", "id", cap=None, share=0.001).groupBy("filename").agg(F.count(F.lit(1)).alias("kept"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.lookalikes import same_looking_pairs

    return same_looking_pairs(_table(spark, sf_dir, "chunks"), "id", ["filename", "text"])


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk with the class of chunks that look the same."""
    from ravelin.llm.lookalikes import same_looking_classes

    return same_looking_classes(_table(spark, sf_dir, "chunks"), "id", ["filename", "text"])


def p6_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with both fields in their consistent form."""
    from ravelin.llm.lookalikes import rewritten

    return rewritten(_table(spark, sf_dir, "chunks").select("id", "filename", "text").distinct(), ["filename", "text"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_containers(spark, sf_dir).where("pieces > 1 and piece = 0").select(F.col("id").alias("doc_id"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)


def p7_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What containers hold of each document: its code points, and whether its pieces follow each other without gap."""
    by = F.sort_array(F.collect_list(F.struct("piece", "char_start", "char_end", "pieces")))
    held = p7_containers(spark, sf_dir).groupBy(F.col("id").alias("doc_id")).agg(by.alias("p"))
    follows = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda k: (F.get("p", k)["piece"] == k) & (F.get("p", k)["pieces"] == F.size("p")) & (F.get("p", k)["char_start"] == F.when(k == 0, F.lit(0)).otherwise(F.get("p", k - 1)["char_end"])))
    return held.select("doc_id", F.element_at("p", -1)["char_end"].alias("chars"), follows.alias("whole"))


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers over their capacity, and whether the room left over is under one in a hundred."""
    each = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("t"))
    return each.agg(F.count_if(F.col("t") > 2048).alias("over"), (F.sum("t") >= 0.99 * 2048 * (F.count(F.lit(1)) - 1)).alias("filled"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    from ravelin.llm.packing import fill_report

    return fill_report(p7_containers(spark, sf_dir), 2048)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ravelin.llm.mixing import measured, plan

    docs = measured(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return docs, plan(docs, _table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_report(spark, sf_dir).where("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    from ravelin.llm.mixing import selected

    return selected(*_mix(spark, sf_dir), seed=8)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached."""
    from ravelin.llm.mixing import report, selected

    docs, planned = _mix(spark, sf_dir)
    return report(selected(docs, planned, seed=8), planned)


def p8_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that each target wins and its quota, with sizes in code points: the apportionment alone, which SQL can do."""
    from ravelin.llm.mixing import plan

    sized = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "source", F.char_length("text").alias("tokens"))
    return plan(sized, _table(spark, sf_dir, "mix_targets")).select("source", "available", "seats", "quota")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.truncation import truncated

    return truncated(_table(spark, sf_dir, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"))


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what each document's finding rests on: a limit of its source, or its ending."""
    from ravelin.llm.truncation import truncated

    return truncated(_table(spark, sf_dir, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"), "evidence")


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which each source's texts pile up."""
    from ravelin.llm.truncation import endings, limits

    return limits(endings(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")).drop("field")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source's documents are cut off, and at which limits."""
    from ravelin.llm.truncation import rates

    return rates(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


#: Chunks once each, with their place among those of the same file.
RANKED = """WITH once AS (SELECT DISTINCT id, text, filename, embedding, score, rrf_raw FROM chunks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY score IS NULL OR isnan(score), CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, id) AS n FROM once)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Lengths of different texts, by source and unit, and those at which they pile up.
LIMITS = rf"""WITH t AS (SELECT DISTINCT source, text, regexp_replace(text, '{BLANK}*(\[{BLANK}*(\.\.\.|…){BLANK}*\]|\({BLANK}*(\.\.\.|…){BLANK}*\)|\.\.\.+|…){BLANK}*$', '') AS body FROM documents WHERE text IS NOT NULL),
u AS (SELECT source, 'chars' AS unit, length(text) AS length FROM t UNION ALL SELECT source, 'bytes', strlen(text) FROM t UNION ALL SELECT source, 'body_chars', length(body) FROM t UNION ALL SELECT source, 'body_bytes', strlen(body) FROM t),
h AS (SELECT source, unit, length, count(*) AS n FROM u WHERE length > 1 GROUP BY ALL), c AS (SELECT source, unit, count(*) AS lengths FROM h GROUP BY ALL),
p AS (SELECT a.source, a.unit, a.length, a.n, coalesce(sum(b.n) FILTER (abs(b.length - a.length) > 3), 0) AS around, coalesce(sum(b.n * b.n) FILTER (abs(b.length - a.length) > 3), 0) AS squares, coalesce(max(b.n) FILTER (abs(b.length - a.length) > 3), 0) AS next
  FROM h a JOIN h b ON a.source IS NOT DISTINCT FROM b.source AND a.unit = b.unit AND b.length BETWEEN a.length - 60 AND a.length + 60 GROUP BY ALL),
q AS (SELECT *, (around + 1) / 114.0 AS usual, greatest(1, CASE WHEN around > 0 THEN squares / around ELSE 1 END) AS uneven FROM p)
SELECT q.source, q.unit, q.length, q.n FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source AND q.unit = c.unit
WHERE n >= 8 * usual AND n >= 3 * next AND (n * ln(n / usual) - n + usual) / uneven >= ln(lengths / 1e-4)"""


# Letters of other scripts beside the Latin ones they look like, by script, and joined letters. Written for the SQL alone: it shares no
# table with the operator.
LETTERS = (
    ("АВЕІЈКМНОРЅСТХҮԚԜӀ", "ABEIJKMHOPSCTXYQWI"), ("асԁеһіјорԛѕԝху", "acdehijopqswxy"),
    ("ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖ", "ABCEHIJKMNOPTXYZ"), ("ϲϳο", "cjo"), ("Օօ", "Oo"), ("ѐёїӓӧόὸ", "èëïäöóò"), ("µ", "μ"),
)
JOINED = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ"))


def _looks(text: str) -> str:
    """SQL of a text's consistent form: without signs that show nothing, plain letters and spaces, joined letters apart, marks composed."""
    form = rf"regexp_replace({text}, '[\p{{Cf}}\x{{34F}}\x{{180B}}-\x{{180D}}\x{{180F}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"
    for x, y in JOINED:
        form = f"replace({form}, '{x}', '{y}')"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    for x, y in (wide, *LETTERS):
        form = f"translate({form}, '{x}', '{y}')"
    return rf"nfc_normalize(regexp_replace(regexp_replace({form}, '[\x{{A0}}\x{{2004}}-\x{{2009}}\x{{202F}}\x{{205F}}]', ' ', 'g'), '[\x{{2010}}\x{{2011}}]', '-', 'g'))"


#: Chunks with file name and text, each once, and their consistent forms.
LOOKS = f"""WITH once AS (SELECT DISTINCT id, filename, text FROM chunks WHERE id IS NOT NULL AND filename IS NOT NULL AND text IS NOT NULL),
f AS MATERIALIZED (SELECT *, {_looks("filename")} AS lf, {_looks("text")} AS lt FROM once)"""


#: Usable points, each once, and their neighbours by brute force.
USABLE = """WITH once AS (SELECT DISTINCT id, vector::DOUBLE[] AS v FROM test WHERE id IS NOT NULL AND len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
NEIGHBOURS = f"""{USABLE}, c AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM once a JOIN once b ON a.id <> b.id),
n AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM c WHERE c >= 0.85 QUALIFY r <= 10)"""
#: Chunks of 40 words or more as multisets of words, and all pairs of a similarity of 0.7: a prefix join over exact frequencies.
SIMILAR = rf"""WITH RECURSIVE once AS (SELECT DISTINCT id, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT id, unnest(regexp_extract_all(lower({_looks("text")}), '[\p{{L}}\p{{N}}]+')) AS word FROM once), c AS MATERIALIZED (SELECT id, word, count(*) AS k FROM w GROUP BY ALL),
n AS MATERIALIZED (SELECT id, sum(k)::BIGINT AS n, string_agg(word || ' ' || k, ' ' ORDER BY word) AS key FROM c GROUP BY id HAVING sum(k) >= 40),
t AS MATERIALIZED (SELECT c.id, n.n, word, unnest(range(k)) AS nth FROM c JOIN n USING (id)), d AS (SELECT word, nth, count(*) AS d FROM t GROUP BY ALL),
p AS MATERIALIZED (SELECT id, n, word, nth FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY d, word, nth) AS place FROM t JOIN d USING (word, nth)) WHERE place <= n - ceil(0.7 * n) + 1),
m AS MATERIALIZED (SELECT DISTINCT a.id AS x, b.id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b USING (word, nth) WHERE a.id < b.id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n),
s AS MATERIALIZED (SELECT x, y, nx, ny, sum(least(a.k, b.k)) AS shared FROM m JOIN c a ON a.id = x JOIN c b ON b.id = y AND a.word = b.word GROUP BY ALL HAVING sum(least(a.k, b.k)) >= 0.7 * (nx + ny - sum(least(a.k, b.k))))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_neighbours": f"{NEIGHBOURS} SELECT x AS id, y AS neighbour, c AS cosine, r AS rank FROM n",
        "p2_found": f"{SIMILAR} SELECT x AS id_a, y AS id_b FROM s",
        "p2_groups": f"""{SIMILAR}, e AS MATERIALIZED (SELECT x, y FROM s UNION ALL SELECT y, x FROM s), r(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.other),
g AS (SELECT id, min(other) AS group_id, count(*) AS group_size FROM r GROUP BY id), k AS (SELECT key, count(*) AS copies FROM n GROUP BY key),
l AS (SELECT e.x AS id, count(DISTINCT b.key) AS links FROM e JOIN n a ON a.id = e.x JOIN n b ON b.id = e.y WHERE a.key <> b.key GROUP BY e.x)
SELECT i.id, coalesce(group_id, i.id) AS group_id, coalesce(group_size, 1) AS group_size, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links
FROM (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL) i LEFT JOIN g USING (id) LEFT JOIN n USING (id) LEFT JOIN k USING (key) LEFT JOIN l USING (id)""",
        "p3_rejoined": "SELECT id, text, true AS within FROM (SELECT DISTINCT id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM chunks) WHERE length(text) > 1500",
        "p4_size": f"{USABLE} SELECT ceil(0.05 * count(*))::BIGINT AS chosen, ceil(0.05 * count(*))::BIGINT AS ids, true AS within FROM (SELECT DISTINCT id FROM once)",
        "p7_rejoined": "SELECT doc_id, length(text) AS chars, true AS whole FROM documents WHERE text <> ''",
        "p7_limits": "SELECT 0::BIGINT AS over, true AS filled",
        "p1_found": f"{NEIGHBOURS} SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM n",
        "p6_found": f"{LOOKS} SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.lf = b.lf AND a.lt = b.lt AND a.id < b.id WHERE a.filename <> b.filename OR a.text <> b.text",
        "p6_classes": f"""{LOOKS}, v AS (SELECT lf, lt, filename, text, count(*) AS copies, min(id) AS least FROM f GROUP BY ALL), c AS (SELECT lf, lt, sum(copies)::BIGINT AS members, count(*) AS variants, min(least) AS class_id FROM v GROUP BY ALL)
SELECT id, class_id, members, variants, copies, members - copies AS links FROM f JOIN v USING (lf, lt, filename, text) JOIN c USING (lf, lt)""",
        # of the two signs for micro the more frequent one stands for both; all other classes of this corpus have a plain member that's far more frequent
        "p6_rewritten": f"""WITH once AS (SELECT DISTINCT id, filename, text FROM chunks), t AS (SELECT filename AS t FROM once UNION ALL SELECT text FROM once),
m AS (SELECT coalesce(sum(length(t) - length(replace(t, 'µ', ''))) >= sum(length(t) - length(replace(t, 'μ', ''))), true) AS micro FROM t)
SELECT id, CASE WHEN micro THEN replace(f, 'μ', 'µ') ELSE f END AS filename, CASE WHEN micro THEN replace(x, 'μ', 'µ') ELSE x END AS text FROM (SELECT id, {_looks("filename")} AS f, {_looks("text")} AS x FROM once), m""",
        "p3_found": "SELECT DISTINCT id FROM chunks WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1500",
        "p8_found": """WITH size AS (SELECT source, sum(strlen(text)) AS bytes FROM documents GROUP BY source), wanted AS (SELECT source, sum(coalesce(target_share, 0)) AS share, max(coalesce(max_repeats, 1)) AS repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY source)
SELECT source FROM wanted LEFT JOIN size USING (source) WHERE coalesce(bytes, 0) * repeats < share * (SELECT sum(bytes) FROM size)""",
        "p8_seats": """WITH size AS (SELECT source, sum(length(text))::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY source),
w AS (SELECT source, sum(coalesce(target_share, 0)) AS share, max(coalesce(max_repeats, 1)) AS repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(n)::BIGINT AS total, greatest(1, sum(n)::BIGINT // 20000) AS block FROM size),
x AS (SELECT source, share / (2 * k + 1) AS quotient FROM w, unnest(range(20001)) AS r(k) WHERE share > 0),
won AS (SELECT source, count(*) AS seats FROM (SELECT * FROM x ORDER BY quotient DESC, source LIMIT (SELECT total // block FROM a)) GROUP BY source)
SELECT w.source, coalesce(n, 0) AS available, coalesce(seats, 0) AS seats, CASE WHEN coalesce(n, 0) * repeats < share * total THEN coalesce(n, 0) * repeats ELSE least(coalesce(seats, 0) * block, coalesce(n, 0) * repeats) END AS quota
FROM w LEFT JOIN size USING (source) LEFT JOIN won USING (source), a""",
        "p9_limits": LIMITS,
        "p5_found": f"{RANKED} SELECT id FROM ranked WHERE n > 20 AND filename IS NOT NULL",
        "p5_capped": f"{RANKED} SELECT id, text, filename, embedding, CASE WHEN NOT isnan(score) THEN score END AS score, rrf_raw, coalesce(isnan(score), false) AS score_is_nan FROM ranked WHERE n <= 20 OR filename IS NULL",
        "p5_share": f"{RANKED} SELECT filename, count(*) AS kept, min(id) AS first_id, max(id) AS last_id FROM ranked, (SELECT greatest(1, floor(0.001 * count(*))) AS cap FROM once) WHERE n <= cap OR filename IS NULL GROUP BY filename",
    }
