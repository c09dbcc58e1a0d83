"""SQL of the registered queries, put together from fragments that mirror the column functions. DuckDB runs it on the same tables."""

from __future__ import annotations

from ravelin.functions import rules

SP = rules.SPACE_CLASS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def any_of(hay: str, patterns: list[str], fold: bool = True) -> str:
    text = f"lower({hay})" if fold else hay
    return "(" + " OR ".join(f"contains({text}, {quoted(p.lower() if fold else p)})" for p in patterns) + ")"


def case_of(hay: str, cases: list[tuple[str, list[str]]], default: str) -> str:
    return f"CASE WHEN {hay} IS NULL THEN NULL " + " ".join(f"WHEN {any_of(hay, ps)} THEN {quoted(n)}" for n, ps in cases) + f" ELSE {quoted(default)} END"


def white(text: str) -> str:
    """A text without white space at its ends."""
    return rf"regexp_replace({text}, '^[\n{SP}]+|[\n{SP}]+$', '', 'g')"


def normal_lines(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({text}, '\r\n?', chr(10), 'g'), '[{SP}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ')"


def collapsed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\n{SP}]+', ' ', 'g'), ' ')"


def words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[\n{SP}]+'), lambda w: w <> '')"


def bare(word: str) -> str:
    return f"trim({word}, {quoted(rules.TRIMMED)})"


def normal_query(text: str) -> str:
    return f"regexp_replace({white(text)}, '[.,;:!?]+$', '')"


def folded(text: str) -> str:
    return rf"translate(regexp_replace(lower({text}), '[\x{{300}}-\x{{36F}}]', '', 'g'), {quoted(rules.ACCENTED)}, {quoted(rules.UNACCENTED)})"


def tokens(text: str) -> str:
    return rf"coalesce(regexp_extract_all({folded(text)}, '[\p{{L}}\p{{N}}]+'), [])"


def without_stop_words(text: str) -> str:
    return f"array_to_string(list_filter({words(text)}, lambda w: NOT list_contains({listed(rules.EMBEDDING_STOP_WORDS)}, lower({bare('w')}))), ' ')"


def expanded(text: str) -> str:
    return f"array_to_string(list_filter({words(text)}, lambda w: length({bare('w')}) > 2 AND NOT list_contains({listed(rules.STOP_WORDS)}, lower({bare('w')}))), ' ')"


def first_bytes(text: str, n: int) -> str:
    return f"left(hex(encode({text})), {2 * n})"


CHUNK = "chunk AS MATERIALIZED (SELECT DISTINCT id, text, filename, embedding FROM chunks)"
ASKED = f"""asked AS MATERIALIZED (SELECT test_id AS query_id, {normal_query('question')} AS q, question FROM test_cases),
vec AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS query_id, embedding AS qvec FROM (SELECT id, embedding FROM chunk WHERE embedding IS NOT NULL ORDER BY id LIMIT 48))"""
CORPUS = f"""tok AS MATERIALIZED (SELECT id, {tokens('text')} AS terms FROM chunk),
stats AS (SELECT count(*) AS docs, sum(len(terms)) / count(*) AS avgdl FROM tok),
post AS MATERIALIZED (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM tok)"""


def terms(name: str, source: str) -> str:
    """literal, technical and valid terms of each question."""
    w, known = words("q"), listed([t.strip() for t in rules.TECHNICAL_TERMS])
    clean = "replace(replace(x, '\"', '\"\"'), '''', '')"
    return f"""{name}_w AS (SELECT query_id, q, {w} AS w FROM {source}),
{name}_v AS (SELECT *, list_filter(list_transform(w, lambda x: {bare('x')}), lambda x: length(x) >= 4 AND regexp_matches(x, '[./-]')) AS literal,
  list_filter(list_transform(w, lambda x: {clean}), lambda x: length(x) > 3 AND NOT list_contains({listed(rules.STOP_WORDS)}, lower(x))) AS valid FROM {name}_w),
{name}_t AS MATERIALIZED (SELECT query_id, q, literal, valid, list_distinct(list_concat(list_filter(valid, lambda x: regexp_matches(x, '[A-Z0-9]')),
  list_filter(list_transform(w, lambda x: {bare('x')}), lambda x: length(x) >= 3 AND list_contains({known}, lower(x))))) AS technical FROM {name}_v)"""


def scored(name: str) -> str:
    """Stages 1 to 3 of the questions whose terms are in {name}_t, as {name}_m (query_id, stage, id, bm25)."""
    return rf"""{name}_s AS (SELECT query_id, 1 AS stage, true AS every_, technical AS terms FROM {name}_t WHERE len(technical) > 1
  UNION ALL SELECT query_id, 2, false, technical FROM {name}_t WHERE len(technical) > 0 UNION ALL SELECT query_id, 3, false, valid FROM {name}_t WHERE len(valid) > 0),
{name}_f AS (SELECT query_id, stage, every_, list_distinct(list_transform(terms, lambda t: {folded('t')})) AS ps FROM {name}_s
  WHERE len(list_filter(terms, lambda t: NOT regexp_full_match(t, '[A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]+') OR t IN ('AND', 'OR', 'NOT'))) = 0),
{name}_p AS MATERIALIZED (SELECT query_id, stage, CASE WHEN every_ THEN len(ps) ELSE 1 END AS need, unnest(ps) AS prefix FROM {name}_f),
{name}_q AS (SELECT DISTINCT prefix FROM {name}_p WHERE prefix <> ''),
{name}_h AS MATERIALIZED (SELECT prefix, id, count(*) AS tf, min(dl) AS dl FROM (SELECT prefix, id, dl FROM {name}_q JOIN post ON left(term, 3) = left(prefix, 3) AND starts_with(term, prefix) WHERE length(prefix) > 2
  UNION ALL SELECT prefix, id, dl FROM {name}_q JOIN post ON starts_with(term, prefix) WHERE length(prefix) < 3) GROUP BY ALL),
{name}_b AS (SELECT h.prefix, h.id, greatest(ln((docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS part
  FROM {name}_h h JOIN (SELECT prefix, count(*) AS n FROM {name}_h GROUP BY prefix) USING (prefix), stats),
{name}_m AS MATERIALIZED (SELECT query_id, stage, id, round(sum(part), 6) AS bm25 FROM {name}_p JOIN {name}_b USING (prefix) GROUP BY query_id, stage, id HAVING count(*) >= max(need))"""


def cascade(name: str, source: str, limit: int) -> str:
    """CTEs up to {name}_hits (query_id, id, stage, bm25, score, rank)."""
    return f"""{terms(name, source)},
{scored(name)},
{name}_l AS (SELECT query_id, 0 AS stage, id, NULL::DOUBLE AS bm25 FROM {name}_t, chunk WHERE len(literal) > 0 AND text IS NOT NULL AND len(list_filter(literal, lambda x: NOT contains(lower(text), lower(x)))) = 0),
{name}_a AS (SELECT *, row_number() OVER (PARTITION BY query_id, stage ORDER BY bm25 DESC NULLS LAST, id) AS n FROM (SELECT * FROM {name}_l UNION ALL BY NAME SELECT * FROM {name}_m)),
{name}_c AS (SELECT *, min(stage) OVER (PARTITION BY query_id) AS least FROM {name}_a WHERE n <= {limit}),
{name}_d AS (SELECT query_id, id, stage, bm25, CASE WHEN stage = 0 THEN 0.8 WHEN bm25 > 0 THEN round(1 / (1 + bm25), 6) ELSE 0.1 END AS score FROM {name}_c WHERE stage = least),
{name}_hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_d)"""


FETCH = 96
PASSES = f"""{cascade('one', 'asked', FETCH)},
wider AS (SELECT query_id, x AS q FROM (SELECT query_id, q, {expanded('q')} AS x FROM asked) WHERE x <> '' AND x <> q),
{cascade('two', 'wider', FETCH // 2)},
passes AS MATERIALIZED (SELECT query_id, id, 1 AS pass, rank FROM one_hits UNION ALL
  SELECT query_id, id, 2, rank + coalesce(before, 0) FROM two_hits LEFT JOIN (SELECT query_id, count(*) AS before FROM one_hits GROUP BY query_id) USING (query_id))"""
NEAR = f"""near AS MATERIALIZED (SELECT * FROM (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM
  (SELECT query_id, id, round(list_cosine_similarity(embedding::DOUBLE[], qvec::DOUBLE[]), 6) AS cosine FROM chunk JOIN vec ON len(embedding) = len(qvec))) WHERE rank <= {FETCH})"""
FUSED = f"""kinds AS (SELECT query_id, {any_of('q', rules.TECHNICAL_TERMS)} AS technical FROM asked),
parts AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM near JOIN kinds USING (query_id) WHERE NOT technical
  UNION ALL SELECT query_id, id, CASE WHEN technical THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END / (60 + rank) FROM passes JOIN kinds USING (query_id)),
sums AS (SELECT query_id, id, round(sum(part), 9) AS rrf FROM parts GROUP BY ALL),
fused AS MATERIALIZED (SELECT *, round(rrf / greatest(1e-4, max(rrf) OVER (PARTITION BY query_id)), 6) AS score FROM sums),
pool AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS place FROM fused) WHERE place <= 12),
results AS MATERIALIZED (SELECT query_id, place AS rank, id, filename, text, score, rrf FROM pool JOIN chunk USING (id))"""
HYBRID = f"WITH {CHUNK}, {ASKED}, {CORPUS}, {PASSES}, {NEAR}, {FUSED}"
RUN = "run AS MATERIALIZED (SELECT * FROM run_results QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at NULLS LAST) = 1)"
EVENT = "event AS MATERIALIZED (SELECT * FROM sse_events QUALIFY row_number() OVER (PARTITION BY req_id, seq ORDER BY arrived_at) = 1)"
