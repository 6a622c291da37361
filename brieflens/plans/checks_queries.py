"""Content checks over one contract per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_checks as C
from ..operators import checks as K
from ..sources import contracts as D
from . import oracle as O
from .registry import register

OUTLINE_SQL = "outline AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {O.quoted(sid)}, {O.quoted(title)}, {O.sql_list(said)})" for i, (sid, title, said) in enumerate(D.OUTLINE)
) + ") t(ord, sid, title, said))"

CONTRACTS = f"""{OUTLINE_SQL}, sections AS (
  SELECT 'd' || doc_id AS project_id, ord::BIGINT AS ord, CASE WHEN doc_id % 5 = 0 THEN '2' || sid ELSE sid END AS section_id, title,
    CASE WHEN (doc_id + ord) % 17 = 3 THEN '' ELSE array_to_string(list_concat(list_filter(lines, lambda x, i: (i - 1) % {len(D.OUTLINE)} = ord),
      list_filter(list_transform(range(len(said)), lambda j: CASE WHEN (doc_id + j * 3) % 4 > 0 THEN said[j + 1] END), lambda s: s IS NOT NULL)), chr(10)) END AS content
  FROM (SELECT doc_id, string_split_regex(translate(text, '|', '/'), '\\. |\\n') AS lines FROM documents), outline WHERE (doc_id + ord) % 23 <> 5)"""


def title_key(x: str) -> str:
    bare = O.rx(x, C_PREFIX, "")
    return f"lower({O.collapse(O.rx(f'''replace({bare}, '&', ' and ')''', '[^a-zA-Z0-9_ ]', ' '))})"


from ..functions.fixed import CHECK_TITLE_PREFIX as C_PREFIX  # noqa: E402

AREA_ROWS = "areas AS (SELECT * FROM (VALUES " + ", ".join(
    f"({O.quoted(a)}, {O.sql_list(ids)}, {O.sql_list(words)}, {O.sql_list(blocked) if blocked else '[]::VARCHAR[]'}, {O.quoted(C.STORY.get(a, ''))})"
    for a, (ids, words, blocked) in C.AREAS.items()) + ") t(area, ids, words, blocked, story))"

LOCATED = f"""{CONTRACTS}, {AREA_ROWS}, keyed AS (SELECT *, {title_key('title')} AS key FROM sections),
located AS (SELECT project_id, area, section_id, title, ord FROM keyed, areas
  WHERE len(list_filter(words, lambda w: contains(key, w))) > 0 AND len(list_filter(blocked, lambda w: contains(key, w))) = 0
  QUALIFY row_number() OVER (PARTITION BY project_id, area ORDER BY NOT list_contains(ids, section_id), ord) = 1)"""

BODIES = f"""{LOCATED}, parts AS (
  SELECT l.project_id, l.area, CASE WHEN s.section_id = l.section_id THEN 0 ELSE 1 END AS kind, s.ord, s.content
  FROM located l JOIN sections s ON s.project_id = l.project_id AND (s.section_id = l.section_id OR
    (NOT list_contains({O.sql_list(C.OWN_TEXT_ONLY)}, l.area) AND starts_with(s.section_id, l.section_id || '.'))) WHERE s.content <> ''
  UNION ALL SELECT l.project_id, 'change', 2, k.ord, k.content FROM located l JOIN keyed k USING (project_id)
  WHERE l.area = 'change' AND k.section_id <> l.section_id AND contains(k.key, 'change request') AND k.content <> ''),
texts AS (SELECT project_id, area, {O.strip("string_agg(content, chr(10) ORDER BY kind, ord)")} AS body FROM parts GROUP BY ALL),
grid AS (SELECT p.project_id, a.area, a.story, l.section_id, l.title, coalesce(t.body, '') AS body FROM (SELECT DISTINCT project_id FROM sections) p, areas a
  LEFT JOIN located l ON l.project_id = p.project_id AND l.area = a.area LEFT JOIN texts t ON t.project_id = p.project_id AND t.area = a.area)"""


def m(pattern: str, x: str = "body") -> str:
    return f"regexp_matches({x}, {O.quoted(pattern)})"


TABLE = "regexp_matches(body, '\\|[^\\n]*\\|\\n\\|[-| :]+\\|\\n\\|')"
FILLED = "section_id IS NOT NULL AND body <> ''"


def flag_sql(area: str, kind: str, when: str, severity: str = "high", evidence: str = "''", out: str | None = None, placed: bool = True) -> str:
    sid, title = ("section_id", "title") if placed else ("NULL::VARCHAR", "NULL::VARCHAR")
    return (f"SELECT project_id, {O.quoted(out or area)} AS area, {O.quoted(kind)} AS kind, {O.quoted(severity)} AS severity, "
            f"{O.quoted(C.STORY[out or area])} AS story, {sid} AS section_id, {title} AS section_title, left({evidence}, 180) AS evidence "
            f"FROM grid WHERE area = {O.quoted(area)} AND ({when})")


def absent_sql(area: str) -> list[str]:
    return [flag_sql(area, "section_missing", "section_id IS NULL", placed=False),
            flag_sql(area, "section_empty", "section_id IS NOT NULL AND body = ''")]


def required_sql(area: str) -> list[str]:
    return [flag_sql(area, kind, f"{FILLED} AND NOT {m(p)}") for a, kind, p in C.REQUIRED if a == area]


def missing_sql(parts: dict[str, str], glue: str) -> str:
    each = ", ".join(f"CASE WHEN NOT {m(p)} THEN {O.quoted(name)} END" for name, p in parts.items())
    return f"array_to_string(list_filter([{each}], lambda z: z IS NOT NULL), {O.quoted(glue)})"


def phrases_sql(phrases: list[str]) -> str:
    return f"array_to_string(list_filter({O.sql_list(phrases)}, lambda p: contains(lower(body), p)), ', ')"


DAYS_ANY = f"({m(C.DAYS)} OR {m(C.BARE_DAYS)})"
DEEMED_AT = f"(length(regexp_extract(body, {O.quoted('(?s)^(.*?)(?:' + C.DEEMED + ')')}, 1)))"
DEEMED_LEN = f"length(regexp_extract(body, {O.quoted(C.DEEMED)}))"
SPAN = f"substring(body, greatest(0, {DEEMED_AT} - 240) + 1, {DEEMED_AT} + {DEEMED_LEN} + 240 - greatest(0, {DEEMED_AT} - 240))"
FAMILY_SQL = {
    "acceptance": absent_sql("acceptance") + [
        flag_sql("acceptance", "criteria_not_measurable", f"{FILLED} AND {phrases_sql(C.VAGUE_ACCEPTANCE)} <> ''", evidence=phrases_sql(C.VAGUE_ACCEPTANCE)),
        flag_sql("acceptance", "criteria_not_per_deliverable", f"{FILLED} AND NOT {TABLE}", "medium"),
        flag_sql("acceptance", "review_window_unit_unclear", f"{FILLED} AND NOT {m(C.DAYS)} AND {m(C.BARE_DAYS)}", "medium", f"regexp_extract(body, {O.quoted(C.BARE_DAYS)})"),
        flag_sql("acceptance", "review_window_missing", f"{FILLED} AND NOT {DAYS_ANY}"),
        flag_sql("acceptance", "deemed_acceptance_missing", f"{FILLED} AND NOT {m(C.DEEMED)}"),
        flag_sql("acceptance", "deemed_acceptance_not_automatic", f"{FILLED} AND {m(C.DEEMED)} AND NOT {m(C.AUTOMATIC, SPAN)} AND NOT {m(C.DAYS, SPAN)}", "medium",
                 f"left({O.rx(SPAN, chr(92) + 's+', ' ')}, 160)"),
    ],
    "change": absent_sql("change") + [
        flag_sql("change", "workflow_missing", f"{FILLED} AND NOT {TABLE} AND NOT {m(C.STEPS)}"),
        flag_sql("change", "approvers_missing", f"{FILLED} AND NOT {m(C.APPROVERS)}"),
        flag_sql("change", "turnaround_missing", f"{FILLED} AND NOT {DAYS_ANY} AND NOT {m(C.TURNAROUND)}"),
        flag_sql("change", "impact_assessment_incomplete", f"{FILLED} AND NOT ({m(C.COST_IMPACT)} AND {m(C.TIME_IMPACT)})"),
        flag_sql("change", "impact_assessment_not_mandatory", f"{FILLED} AND {m(C.COST_IMPACT)} AND {m(C.TIME_IMPACT)} AND NOT {m(C.MANDATORY)}", "medium"),
        flag_sql("change", "no_work_rule_missing", f"{FILLED} AND NOT {m(C.NO_WORK)}"),
    ],
    "commercials": absent_sql("commercials") + required_sql("commercials"),
    "kpis": absent_sql("kpis") + [
        flag_sql("kpis", "metrics_not_tabulated", f"{FILLED} AND NOT {TABLE}"),
        flag_sql("kpis", "targets_not_measurable", f"{FILLED} AND {TABLE} AND NOT {m(C.TARGET)}"),
        # the only table of this section names frequency, method and source, so those rules stay silent
        flag_sql("kpis", "breach_consequence_missing", f"{FILLED} AND NOT {m(C.BREACH)} AND NOT {m(C.NO_CREDITS)}"),
    ],
    "onboarding": absent_sql("onboarding") + [
        flag_sql("onboarding", "onboarding_steps_not_tabulated", f"{FILLED} AND NOT {TABLE}", "medium"),
        flag_sql("onboarding", "onboarding_duration_missing", f"{FILLED} AND NOT {DAYS_ANY} AND NOT {m(C.WEEKS)}"),
        flag_sql("onboarding", "customer_obligations_incomplete", f"{FILLED} AND {missing_sql(C.ACCESS_ITEMS, ', ')} <> ''", evidence=f"'missing: ' || {missing_sql(C.ACCESS_ITEMS, ', ')}"),
        flag_sql("onboarding", "delay_impact_missing", f"{FILLED} AND NOT ({m(C.SCHEDULE_IMPACT)} AND {m(C.BILLING_IMPACT)})"),
    ],
    "assets": absent_sql("assets") + required_sql("assets") + [
        flag_sql("assets", "return_at_closure_missing", f"{FILLED} AND {m(C.RETURN)} AND NOT {m(C.CLOSURE)}"),
        flag_sql("assets", "return_on_rollover_missing", f"{FILLED} AND {m(C.RETURN)} AND NOT {m(C.ROLLOVER)}"),
        flag_sql("assets", "return_timeline_missing", f"{FILLED} AND {m(C.RETURN)} AND NOT {DAYS_ANY}"),
    ],
    "term": absent_sql("termination") + [
        flag_sql("termination", kind, f"{FILLED} AND NOT regexp_matches(body || chr(10) || coalesce((SELECT a.body FROM grid a WHERE a.area = 'agreement' AND a.project_id = grid.project_id), ''), {O.quoted(p)})")
        for a, kind, p in C.REQUIRED if a == "term"
    ] + required_sql("termination") + [
        flag_sql("termination", "notice_period_missing", f"{FILLED} AND NOT {DAYS_ANY}"),
        flag_sql("termination", "exit_obligations_incomplete", f"{FILLED} AND {missing_sql(C.EXIT_PARTS, '; ')} <> ''", evidence=f"'missing: ' || {missing_sql(C.EXIT_PARTS, '; ')}"),
    ],
    "vendor_alignment": absent_sql("vendor_alignment") + required_sql("vendor_alignment") + [
        flag_sql("vendor_alignment", "acceptance_basis_unqualified", f"{FILLED} AND {m(C.ACCEPTANCE_WORD)} AND NOT {m(C.NOT_TIMESHEETS)}", "medium")],
    "vendor_compliance": absent_sql("vendor_compliance") + required_sql("vendor_compliance") + [
        flag_sql("vendor_compliance", "regimes_missing", f"{FILLED} AND {missing_sql(C.REGIMES, ', ')} <> ''", evidence=f"'missing: ' || {missing_sql(C.REGIMES, ', ')}"),
        flag_sql("vendor_compliance", "evidence_not_before_access", f"{FILLED} AND {m(C.EVIDENCE)} AND NOT {m(C.BEFORE_ACCESS)}"),
    ],
}


def flags_sql(families) -> str:
    return f"WITH {BODIES} " + " UNION ALL ".join(s for f in families for s in FAMILY_SQL[f])


def family(name: str, *members: str) -> None:
    members = members or (name,)
    sql = flags_sql(members) if all(f in FAMILY_SQL for f in members) else None
    register(f"check_{name}", sql)(
        lambda spark, d: K.run_checks(D.contracts(spark, d), D.clients(spark, d), families=members))


@register("locate_area", f"WITH {LOCATED} SELECT project_id, area, section_id, title FROM located")
def locate_area(spark, d):
    return K.locate_areas(D.contracts(spark, d)).select("project_id", "area", "section_id", "title")


@register("section_body", f"""
WITH {CONTRACTS}, parts AS (
  SELECT s.project_id, a AS section_id, CASE WHEN a = s.section_id THEN 0 ELSE 1 END AS kind, ord, content
  FROM (SELECT *, unnest(CASE WHEN contains(section_id, '.') THEN [split_part(section_id, '.', 1), section_id] ELSE [section_id] END) AS a FROM sections) s WHERE content <> '')
SELECT project_id, section_id, {O.strip("string_agg(content, chr(10) ORDER BY kind, ord)")} AS body FROM parts GROUP BY ALL""")
def section_body(spark, d):
    return K.section_body(D.contracts(spark, d))


for _name in ("scope", "acceptance", "change", "commercials", "governance", "risks", "kpis", "onboarding", "assets", "term",
              "vendor_alignment", "vendor_compliance"):
    family(_name)


@register("client_patterns", f"""
SELECT 'd' || doc_id AS project_id, CASE doc_id % 3 WHEN 0 THEN 'Board' WHEN 1 THEN '' ELSE 'Acme' END AS words,
  regexp_matches(text, '(?i)\\b(?:customer|client|supplier|vendor|third[\\s\\-]?party|joint|both parties|supplier' || CASE doc_id % 3 WHEN 0 THEN '|Board' WHEN 1 THEN '' ELSE '|Acme' END || ')\\b') AS named
FROM documents""")
def client_patterns(spark, d):
    from ..sources.tables import load
    texts = load(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("project_id"), "text")
    rows = D.clients(spark, d).join(texts, "project_id")
    pattern = K.party_pattern(C.OWNER_WORDS, "supplier", F.col("client_name"))
    words = F.array_join(F.filter(F.split("client_name", " "), lambda w: ~F.lower(w).isin(C.COMPANY_SUFFIXES)), " ")
    return rows.select("project_id", words.alias("words"), F.regexp_like("text", pattern).alias("named"))


TABLE_FREE = ("acceptance", "change", "commercials", "kpis", "onboarding", "assets", "term", "vendor_alignment", "vendor_compliance")


@register("run_checks", f"""
WITH flags AS ({flags_sql(TABLE_FREE)})
SELECT project_id, flag_count, high_count, by_story FROM (
  SELECT project_id, sum(n)::BIGINT AS flag_count, sum(high)::BIGINT AS high_count, string_agg(story || ':' || n, ' ' ORDER BY story || ':' || n) AS by_story FROM (
    SELECT project_id, story, count(*) AS n, count(*) FILTER (severity = 'high') AS high FROM flags GROUP BY ALL) GROUP BY project_id)""")
def run_checks(spark, d):
    return K.check_summary(K.run_checks(D.contracts(spark, d), D.clients(spark, d), families=TABLE_FREE))


@register("run_checks_all")
def run_checks_all(spark, d):
    return K.check_summary(K.run_checks(D.contracts(spark, d), D.clients(spark, d)))


def ordered(flags):
    """Flags of a contract by severity, story, area; a contract's flags are a bounded list."""
    from pyspark.sql import Window
    w = Window.partitionBy("project_id").orderBy(K.severity_rank(F.col("severity")), "story", "area", "kind", "section_id")
    return flags.select("project_id", "area", "kind", F.row_number().over(w).alias("pos"))


@register("findings_order", f"""
WITH flags AS ({flags_sql(TABLE_FREE)})
SELECT project_id, area, kind, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END, story, area, kind, section_id) AS pos FROM flags""")
def findings_order(spark, d):
    return ordered(K.run_checks(D.contracts(spark, d), D.clients(spark, d), families=TABLE_FREE))


@register("findings_order_all")
def findings_order_all(spark, d):
    """As `findings_order`, for all families; those that read tables are tested by fixtures."""
    return ordered(K.run_checks(D.contracts(spark, d), D.clients(spark, d)))
