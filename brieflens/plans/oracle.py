"""SQL fragments shared by the oracles: the logical tables of `sources.tables`."""

from __future__ import annotations

from ..functions import fixed
from ..sources import tables as T


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def pick(index: str, values: list[str]) -> str:
    return f"({sql_list(values)})[({index}) + 1]"


WS = "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rx(x: str, pattern: str, value: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(value)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({rx(x, chr(92) + 's+', ' ')})"


def tokens(x: str) -> str:
    return f"list_filter(string_split(lower({rx(x, '[^A-Za-z0-9_]+', ' ')}), ' '), lambda z: z <> '')"


def alnum_tokens(x: str) -> str:
    return f"list_filter(string_split({rx(f'lower({x})', '[^a-z0-9]+', ' ')}, ' '), lambda z: z <> '')"


def content_terms(x: str, stop=fixed.QUESTION_STOP) -> str:
    return (f"list_filter(list_distinct({alnum_tokens(x)}), "
            f"lambda z: length(z) > 2 AND NOT list_contains({sql_list(stop)}, z))")


CHUNKS = f"""chunks AS (
  SELECT doc_id AS chunk_id, 'p' || ((doc_id // 20) % 10) AS project_id, 'r' || ((doc_id // 100) % 4) AS repo_id,
         'f' || (doc_id // 20) AS file_id, 'F' || (doc_id // 20) || {pick('(doc_id // 20) % 7', T.DOC_SUFFIXES)} AS doc_name,
         nullif(doc_id % 7, 0) AS page_number, regexp_extract(text, '^([^\\s.,|]+)', 1) AS section_heading,
         text AS chunk_text
  FROM documents)"""

QUERIES = f"""queries AS (
  SELECT item_id AS q_id, text || {pick('item_id % 4', T.QUERY_EXTRAS)} AS query FROM benchmark)"""

ANNOTATED = """annotated AS (
  SELECT doc_id, 'Slide ' || (doc_id % 50) || '. [Source: deck] ' ||
    replace(replace(text, '. ', ' [' || (doc_id % 9) || '] .' || chr(13) || chr(10) || chr(10) || chr(10) || ' '),
            ', ', ' [' || (doc_id % 4 + 3) || '],  (page ' || (doc_id % 13) || ') ' || chr(9)) ||
    ' < Image ID = ''ab' || doc_id || ''' > on page 3 <IMAGE id="x' || (doc_id % 10) || '"/>-' || chr(10) || 'end ' AS text
  FROM documents)"""

SYNONYMS = "synonyms AS (SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(word)}, {quoted(' '.join(phrases))})" for word, phrases in fixed.QUERY_SYNONYMS.items()
) + ") t(word, phrases))"

EXPANDED = f"""expanded AS (
  SELECT DISTINCT q_id, term FROM (
    SELECT q_id, unnest({tokens('query')}) AS term FROM queries
    UNION ALL
    SELECT q.q_id, unnest({tokens('s.phrases')}) FROM (SELECT q_id, unnest({tokens('query')}) AS term FROM queries) q
    JOIN synonyms s ON s.word = q.term))"""


def classify(hay: str, classes: dict[str, list[str]] = fixed.SECTION_PHRASES) -> str:
    counts = {
        name: "(" + " + ".join(f"CAST(contains({hay}, {quoted(p)}) AS INT)" for p in phrases) + ")"
        for name, phrases in classes.items()
    }
    best = "greatest(" + ", ".join(counts.values()) + ")"
    ladder = " ".join(f"WHEN {count} = {best} THEN {quoted(name)}" for name, count in counts.items())
    return f"CASE WHEN {best} = 0 THEN '' {ladder} END"


TAGGED_HAY = f"lower(section_heading || ' ' || {pick('chunk_id % 8', T.TAG_WORDS)} || ' ' || left(chunk_text, 400))"

# kw(chunk_id, pos, term): keywords of every chunk, from `chunks`
KEYWORDS = f"""kw_words AS (
  SELECT chunk_id, lower(chunk_text) AS low, chunk_text FROM chunks),
kw_occ AS (
  SELECT chunk_id, unnest(regexp_extract_all(low, '[a-z]{{3,}}')) AS term,
         generate_subscripts(regexp_extract_all(low, '[a-z]{{3,}}'), 1) AS pos, 0 AS kind FROM kw_words
  UNION ALL
  SELECT chunk_id, unnest(regexp_extract_all(chunk_text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+')) AS term,
         generate_subscripts(regexp_extract_all(chunk_text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+'), 1) AS pos, 1 AS kind FROM kw_words),
kw_counts AS (
  SELECT chunk_id, term, kind, count(*) * (kind + 1) AS n, min(pos) AS first_pos FROM kw_occ
  WHERE (kind = 0 AND NOT list_contains({sql_list(fixed.KEYWORD_STOP)}, term)) OR (kind = 1 AND length(term) > 5)
  GROUP BY chunk_id, term, kind),
kw AS (
  SELECT chunk_id, pos, CASE WHEN kind = 0 THEN upper(left(term, 1)) || substring(term, 2) ELSE term END AS term FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, kind, first_pos) AS pos FROM kw_counts
    WHERE chunk_id IN (SELECT chunk_id FROM kw_counts WHERE kind = 0)) WHERE pos <= 12),
keyed AS (
  SELECT c.*, coalesce(k.keywords, '') AS keywords FROM chunks c LEFT JOIN
    (SELECT chunk_id, string_agg(term, ' ' ORDER BY pos) AS keywords FROM kw GROUP BY chunk_id) k USING (chunk_id))"""

SECTIONS = """sections AS (
  SELECT 'p' || ((item_id // 5) % 10) AS project_id, item_id AS ord,
         CASE WHEN item_id % 5 = 0 THEN '' || (item_id // 5 + 1) ELSE (item_id // 5 + 1) || '.' || (item_id % 5) END AS section_id,
         text AS title FROM benchmark)"""

# fields of a chunk as lower-cased text, for substring counts; needs `keyed`
FIELDS = """fields AS (
  SELECT chunk_id, project_id, lower(chunk_text) AS t, lower(keywords) AS k, lower(section_heading) AS h,
         lower(doc_name) AS d, length(chunk_text) AS len FROM keyed)"""


def occurrences(field: str, term: str = "term") -> str:
    return f"((length({field}) - length(replace({field}, {term}, ''))) // length({term}))"


BM25 = f"""{CHUNKS}, {QUERIES}, {SYNONYMS}, {EXPANDED},
toks AS (
  SELECT chunk_id, unnest({tokens('section_heading')}) AS term, 1 AS h FROM chunks
  UNION ALL SELECT chunk_id, unnest({tokens('chunk_text')}) AS term, 0 AS h FROM chunks),
lens AS (SELECT chunk_id, len({tokens('section_heading')}) + len({tokens('chunk_text')}) AS dl, doc_name FROM chunks),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT chunk_id, term, sum(h) AS tf_h, sum(1 - h) AS tf_b FROM toks GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (
  SELECT q_id, p.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) *
      (0.45 * tf_h * 2.5 / (tf_h + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 0.55 * tf_b * 2.5 / (tf_b + 1.5 * (0.25 + 0.75 * dl / avgdl))))
      * any_value(CASE WHEN contains(lower(doc_name), 'template') THEN 1.25 WHEN contains(lower(doc_name), 'solution') THEN 1.10
                       WHEN contains(lower(doc_name), 'draft') THEN 0.95 WHEN contains(lower(doc_name), 'wip') THEN 0.90 ELSE 1.0 END) AS score
  FROM expanded e JOIN post p USING (term) JOIN dfs USING (term) JOIN lens l ON l.chunk_id = p.chunk_id, tot
  GROUP BY q_id, p.chunk_id)"""


def ranked(source: str, by: str = "q_id", k: int = 5, score: str = "score", tie: str = "chunk_id") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, {tie}) AS rn "
            f"FROM {source} QUALIFY rn <= {k}")


TFIDF = f"""{CHUNKS}, {KEYWORDS}, {FIELDS}, {QUERIES},
qt AS (SELECT q_id, unnest({content_terms('query')}) AS term FROM queries),
vocab AS (SELECT DISTINCT term FROM qt),
counts AS (
  SELECT chunk_id, term, len, {occurrences('t')} + 2 * {occurrences('k')} + 3 * {occurrences('h')} AS tf
  FROM fields, vocab WHERE contains(t, term) OR contains(k, term) OR contains(h, term)),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
tfidf AS (
  SELECT q_id, chunk_id, sum((1 + ln(tf)) * ln(1 + (SELECT count(*) FROM chunks) / (1.0 + df))) / (1 + any_value(len) / 4000.0) AS score
  FROM counts JOIN qt USING (term) JOIN dfs USING (term) GROUP BY q_id, chunk_id)"""

OVERLAP = f"""ov_q AS (SELECT q_id, list_distinct({alnum_tokens('query')}) AS q FROM queries),
ov_t AS (SELECT q_id, len(q) AS q_size, unnest(q) AS term FROM ov_q),
ov_c AS (SELECT chunk_id, unnest(list_distinct({alnum_tokens("chunk_text || ' ' || section_heading || ' ' || doc_name")})) AS term FROM chunks),
overlap AS (SELECT q_id, chunk_id, count(*) / sqrt(any_value(q_size)) AS score FROM ov_c JOIN ov_t USING (term) GROUP BY q_id, chunk_id)"""

COSINE = """cosine AS (
  SELECT b.item_id AS q_id, v.vec_id AS chunk_id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) v)"""

# lines(doc_id, i, x): sentences of a document; draft_lines adds the markdown line
DRAFT_LINES = r"""raw_lines AS (
  SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS i FROM (SELECT doc_id, string_split_regex(text, '\. |\n') AS parts FROM documents)),
draft_lines AS (
  SELECT doc_id, i, x, CASE
    WHEN i % 6 = 0 THEN '## ' || (i // 6 + 1) || ' ' || x
    WHEN i % 6 = 1 THEN x
    WHEN i % 6 = 2 THEN '| ' || x || ' | ' || doc_id || ' |'
    WHEN i % 6 = 3 THEN '| --- | :--: |'
    WHEN i % 6 = 4 THEN '|' || x || '|<information not available ' || (i // 6) || '>|'
    WHEN i % 12 = 5 THEN '**' || x || '**'
    ELSE (i // 6 + 1) || '.' || (i // 6) || '. ' || x END AS line FROM raw_lines)"""


def headingish(x: str) -> str:
    return (f"(trim({x}) <> '' AND length(trim({x})) <= 70 AND NOT regexp_matches(trim({x}), '[.;,]$') "
            f"AND len(regexp_split_to_array(trim({x}), '\\s+')) <= 8 AND regexp_matches({x}, '^\\P{{L}}*[\\p{{Lu}}\\p{{Lt}}]'))")
