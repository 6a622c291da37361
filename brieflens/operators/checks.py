"""Content checks of drafted contracts, all contracts in one job.

`sections` holds project_id, ord, section_id, title, content.  Each contract
becomes one row with the text of every area it covers, gathered in one movement;
all rules are then column expressions over that row and shuffle nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_checks as C
from ..functions import structure as S
from ..functions import text as X
from ..functions.arrays import let
from .context import ancestors

FLAG = ("array<struct<area:string,kind:string,severity:string,story:string,section_id:string,"
        "section_title:string,evidence:string>>")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(X.uni(pattern))


# ---------------------------------------------------------------- locating areas

def fitting_areas(title: Column, section_id: Column) -> Column:
    """Areas whose title rule the section meets, with whether its id is preferred."""
    key = X.norm_check_title(title)

    def fits(name: str) -> Column:
        ids, words, blocked = C.AREAS[name]
        ok = any_of([F.contains(key, F.lit(w)) for w in words])
        for b in blocked:
            ok = ok & ~F.contains(key, F.lit(b))
        return F.when(ok, F.struct(F.lit(name).alias("area"), (~section_id.isin(ids)).alias("other_id")))

    return F.filter(F.array(*[fits(name) for name in C.AREAS]), lambda a: a.isNotNull())


def locate_areas(sections: DataFrame) -> DataFrame:
    """project_id, area, section_id, title: the preferred id if its title fits, else the first fit."""
    fits = sections.select(
        "project_id", "ord", "section_id", "title",
        F.explode(fitting_areas(F.col("title"), F.col("section_id"))).alias("fit"))
    best = fits.groupBy("project_id", "fit.area").agg(
        F.min(F.struct("fit.other_id", "ord", "section_id", "title")).alias("s"))
    return best.select("project_id", "area", "s.section_id", "s.title", "s.ord")


def section_body(sections: DataFrame) -> DataFrame:
    """project_id, section_id, body: a section's own text, then its descendants' in order."""
    parts = _text_parts(sections)
    return parts.groupBy("project_id", "section_id").agg(
        F.sort_array(F.collect_list(F.struct("kind", "ord", "content"))).alias("parts")).select(
        "project_id", "section_id", _joined(F.col("parts")).alias("body"))


def _text_parts(sections: DataFrame) -> DataFrame:
    filled = sections.filter(X.text_or_empty(F.col("content")) != "")
    return filled.select(
        "project_id", F.explode(ancestors(F.col("section_id"))).alias("anchor"),
        F.col("section_id").alias("_own"), "ord", "content",
    ).select(
        "project_id", F.col("anchor").alias("section_id"), "ord", "content",
        (F.col("anchor") != F.col("_own")).cast("int").alias("kind"))


def _joined(parts: Column) -> Column:
    return X.strip(F.array_join(F.transform(parts, lambda p: p["content"]), "\n"))


def area_texts(sections: DataFrame) -> DataFrame:
    """One row per project: `areas`, a map from area to struct<section_id, title, body>.

    The sections of a contract are gathered once into an array, which is the only movement of a text; areas are then
    located and their texts joined inside the row.
    """
    filled = X.text_or_empty(F.col("content"))
    one = F.struct("ord", "section_id", "title", filled.alias("content"),
                   F.contains(X.norm_check_title(F.col("title")), F.lit(C.SIBLING_TITLE)).alias("sibling"),
                   fitting_areas(F.col("title"), F.col("section_id")).alias("fits"))
    rows = sections.select("project_id", one.alias("s")).groupBy("project_id").agg(F.collect_list("s").alias("secs"))
    return rows.select("project_id", F.map_from_entries(F.filter(
        F.array(*[_area_entry(F.col("secs"), name) for name in C.AREAS]), lambda e: e.isNotNull())).alias("areas"))


def _area_entry(secs: Column, name: str) -> Column:
    """struct<area, s> of an area of the contract, null where no title fits: the preferred id, else the first fit."""
    fits = F.array_min(F.flatten(F.transform(secs, lambda s: F.transform(
        F.filter(s["fits"], lambda f: f["area"] == name),
        lambda f: F.struct(f["other_id"].alias("other_id"), s["ord"].alias("ord"), s["section_id"].alias("section_id"), s["title"].alias("title"))))))

    def part(kind: Column, s: Column) -> Column:
        return F.struct(kind.cast("int").alias("kind"), s["ord"].alias("ord"), s["content"].alias("content"))

    def body(found: Column) -> Column:
        own = found["section_id"]
        inside = lambda s: s["section_id"] == own
        if name not in C.OWN_TEXT_ONLY:
            inside = lambda s: (s["section_id"] == own) | F.startswith(s["section_id"], F.concat(own, F.lit(".")))
        parts = F.transform(F.filter(secs, lambda s: (s["content"] != "") & inside(s)), lambda s: part(s["section_id"] != own, s))
        if name == "change":
            parts = F.concat(parts, F.transform(
                F.filter(secs, lambda s: (s["content"] != "") & s["sibling"] & (s["section_id"] != own)), lambda s: part(F.lit(2), s)))
        return _joined(F.sort_array(parts))

    return let(fits, lambda f: F.when(f.isNotNull(), F.struct(F.lit(name).alias("area"), F.struct(
        f["section_id"].alias("section_id"), f["title"].alias("title"), body(f).alias("body")).alias("s"))))


# ---------------------------------------------------------------- flags

class Area:
    """One area of the contract row: where it was found and its text."""

    def __init__(self, name: str):
        self.name = name
        self.found = F.try_element_at(F.col("areas"), F.lit(name))
        self.exists = self.found.isNotNull()
        self.body = F.coalesce(self.found["body"], F.lit(""))
        self.filled = self.exists & (self.body != "")

    def has(self, pattern: str) -> Column:
        return has(self.body, pattern)

    def tables(self) -> Column:
        return F.col(f"tables_{self.name}")

    def has_table(self) -> Column:
        return F.size(self.tables()) > 0

    def flag(self, when: Column, kind: str, severity: str = "high", evidence: Column | None = None,
             area: str | None = None, placed: bool = True) -> Column:
        name = area or self.name
        where = self.found if placed else F.lit(None)
        return F.when(when, F.struct(
            F.lit(name).alias("area"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
            F.lit(C.STORY[name]).alias("story"),
            (where["section_id"] if placed else where).cast("string").alias("section_id"),
            (where["title"] if placed else where).cast("string").alias("section_title"),
            F.left(evidence if evidence is not None else F.lit(""), F.lit(180)).alias("evidence")))

    def absent(self) -> list[Column]:
        """The section is missing, or found but not drafted."""
        return [self.flag(~self.exists, "section_missing", placed=False),
                self.flag(self.exists & ~self.filled, "section_empty")]

    def required(self, text: Column | None = None, rules: str | None = None) -> list[Column]:
        body = self.body if text is None else text
        return [self.flag(self.filled & ~has(body, pattern), kind)
                for area, kind, pattern in C.REQUIRED if area == (rules or self.name)]


def phrases_in(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def missing_parts(text: Column, parts: dict[str, str]) -> Column:
    return F.filter(
        F.array(*[F.when(~has(text, pattern), F.lit(name)) for name, pattern in parts.items()]),
        lambda p: p.isNotNull())


def party_pattern(words: list[str], supplier: str | None, client: Column) -> Column:
    """Alternation of party words, the supplier's name and the distinctive words of the client's."""
    fixed_words = words + ([supplier] if supplier else [])
    names = F.filter(
        F.regexp_extract_all(X.text_or_empty(client), F.lit("[A-Za-z][A-Za-z0-9&-]{1,}"), F.lit(0)),
        lambda w: ~F.lower(w).isin(C.COMPANY_SUFFIXES))
    every = F.concat(F.array(*[F.lit(w) for w in fixed_words]), names)
    return F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(every, "|"), F.lit(r")\b"))


def first_column(header: Column, hints: list[str]) -> Column:
    """0-based position of the first header cell holding a hint; null if none."""
    hits = F.filter(
        F.transform(header, lambda h, i: F.when(any_of([F.contains(F.lower(h), F.lit(x)) for x in hints]), i)),
        lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def check_scope(owner: Column) -> list:
    flags = []
    for name in ("scope", "deliverables", "assumptions", "dependencies", "exclusions"):
        area = Area(name)
        thin = F.length(X.collapse(F.regexp_replace(area.body, X.uni(C.CONFIRM), ""))) < 40
        filler = phrases_in(area.body, C.BOILERPLATE)
        flags += area.absent() + [
            area.flag(area.filled & thin, "placeholder_only"),
            area.flag(area.filled & ~thin & (F.size(filler) > 0), "generic_boilerplate", "medium", F.array_join(filler, ", ")),
        ]
    excl = Area("exclusions")
    flags.append(excl.flag(excl.filled & ~excl.has(C.NEGATIVE_SCOPE), "exclusions_not_explicit"))
    dep = Area("dependencies")
    tables = dep.tables()
    flags.append(dep.flag(dep.filled & (F.size(tables) == 0) & ~F.regexp_like(dep.body, owner), "dependency_owner_missing"))

    def of_table(t: Column) -> Column:
        head = F.get(t, F.lit(0))

        def rows(col: Column) -> Column:
            unnamed = F.filter(F.slice(t, F.lit(2), F.size(t)), lambda r: (col < F.size(r)) & (
                (F.get(r, col) == "") | ~F.regexp_like(F.get(r, col), owner)))
            listed = F.transform(unnamed, lambda r: dep.flag(F.lit(True), "dependency_owner_unnamed", "high", F.concat(
                F.get(r, F.lit(0)), F.lit(" → owner: "), F.when(F.get(r, col) == "", "(blank)").otherwise(F.get(r, col)))))
            none = F.array(dep.flag(F.lit(True), "dependency_owner_column_missing", "high", F.array_join(head, " | ")))
            return F.when(col.isNull(), none).otherwise(listed)

        return let(first_column(head, C.OWNER_COLUMNS), rows)

    return flags, [F.flatten(F.transform(tables, of_table))]


def check_acceptance() -> list[Column]:
    a = Area("acceptance")
    vague = phrases_in(a.body, C.VAGUE_ACCEPTANCE)
    deemed = X.uni(C.DEEMED)
    at = F.regexp_instr(a.body, F.lit(deemed))
    end = at - 1 + F.length(F.regexp_extract(a.body, deemed, 0))
    first = F.greatest(F.lit(0), at - 1 - 240)
    span = F.substring(a.body, first + 1, end + 240 - first)
    window, bare = a.has(C.DAYS), a.has(C.BARE_DAYS)
    return a.absent() + [
        a.flag(a.filled & (F.size(vague) > 0), "criteria_not_measurable", "high", F.array_join(vague, ", ")),
        a.flag(a.filled & ~a.has_table(), "criteria_not_per_deliverable", "medium"),
        a.flag(a.filled & ~window & bare, "review_window_unit_unclear", "medium",
               F.regexp_extract(a.body, X.uni(C.BARE_DAYS), 0)),
        a.flag(a.filled & ~window & ~bare, "review_window_missing"),
        a.flag(a.filled & (at == 0), "deemed_acceptance_missing"),
        a.flag(a.filled & (at > 0) & ~has(span, C.AUTOMATIC) & ~has(span, C.DAYS), "deemed_acceptance_not_automatic",
               "medium", F.left(F.regexp_replace(span, X.uni(r"\s+"), " "), F.lit(160))),
    ]


def check_change() -> list[Column]:
    a = Area("change")
    cost, time = a.has(C.COST_IMPACT), a.has(C.TIME_IMPACT)
    return a.absent() + [
        a.flag(a.filled & ~a.has_table() & ~a.has(C.STEPS), "workflow_missing"),
        a.flag(a.filled & ~a.has(C.APPROVERS), "approvers_missing"),
        a.flag(a.filled & ~(a.has(C.DAYS) | a.has(C.BARE_DAYS) | a.has(C.TURNAROUND)), "turnaround_missing"),
        a.flag(a.filled & ~(cost & time), "impact_assessment_incomplete"),
        a.flag(a.filled & cost & time & ~a.has(C.MANDATORY), "impact_assessment_not_mandatory", "medium"),
        a.flag(a.filled & ~a.has(C.NO_WORK), "no_work_rule_missing"),
    ]


def check_commercials() -> list[Column]:
    a = Area("commercials")
    return a.absent() + a.required()


def check_governance(owner: Column, client: Column, supplier: str) -> list[Column]:
    gov, esc, con = Area("governance"), Area("escalation"), Area("contacts")
    esc_here = gov.filled & F.contains(F.lower(gov.body), F.lit("escalat"))
    con_here = gov.filled & gov.has(C.EMAIL)
    flags = gov.absent() + [
        gov.flag(gov.filled & ~gov.has(C.CADENCE), "forum_cadence_missing"),
        gov.flag(gov.filled & ~F.regexp_like(gov.body, owner), "forum_participants_missing"),
        esc.flag(~esc.filled & ~esc_here, "escalation_matrix_missing", placed=False),
        con.flag(~con.filled & ~con_here, "contacts_missing", placed=False),
    ]
    for place, when in ((esc, esc.filled), (gov, ~esc.filled & esc_here)):
        levels = F.sort_array(F.array_distinct(F.regexp_extract_all(place.body, F.lit(X.uni(C.LEVEL)), F.lit(1))))
        gaps = F.array_except(F.array(F.lit("1"), F.lit("2"), F.lit("3")), levels)
        named = F.when(F.size(levels) > 0, F.array_join(levels, ", ")).otherwise("none")
        flags += [
            place.flag(when & (F.size(gaps) > 0), "escalation_levels_incomplete", "high",
                       F.concat(F.lit("found levels: "), named), "escalation"),
            place.flag(when & ~place.has(C.RESPONSE_TIME), "escalation_response_time_missing", area="escalation"),
            place.flag(when & ~F.regexp_like(place.body, owner), "escalation_roles_missing", area="escalation"),
        ]
    own_side = r"(?i)\b" + supplier + r"\b"
    for place, when in ((con, con.filled), (gov, ~con.filled & con_here)):
        both = place.has(own_side) & F.regexp_like(place.body, client)
        flags += [
            place.flag(when & ~place.has(C.EMAIL), "contact_details_missing", "medium", area="contacts"),
            place.flag(when & ~both, "contacts_one_sided", "medium", area="contacts"),
        ]
    return flags


def check_risks(owner: Column) -> tuple[list[Column], list[Column]]:
    a = Area("risks")
    tables = a.tables()
    flags = a.absent() + [a.flag(a.filled & (F.size(tables) == 0), "risk_table_missing")]

    def of_table(t: Column) -> Column:
        head = F.get(t, F.lit(0))
        places = F.struct(*[first_column(head, hints).alias(name) for name, hints in C.RISK_COLUMNS.items()])
        titles = {"likelihood": "risk_likelihood_missing", "impact": "risk_impact_missing",
                  "mitigation": "risk_mitigation_missing", "owner": "risk_owner_column_missing"}

        def of_columns(c: Column) -> Column:
            absent = F.array(*[
                a.flag(c[name].isNull(), kind, "high", F.array_join(head, " | ")) for name, kind in titles.items()])

            def of_row(r: Column) -> Column:
                name = F.get(r, F.lit(0))

                def cell(which: str) -> Column:
                    return F.get(r, c[which])  # null past the end of the row or without the column

                who, fix = cell("owner"), F.lower(cell("mitigation"))
                party = (who != "") & F.regexp_like(who, owner)
                row_flags = [
                    a.flag(~party, "risk_owner_unnamed", "high", F.concat(
                        name, F.lit(" -> owner: "), F.when(who == "", "(blank)").otherwise(who))),
                    a.flag(party & ~has(who, C.OWNER_ROLE), "risk_owner_role_missing", "medium",
                           F.concat(name, F.lit(" -> owner: "), who)),
                    a.flag(fix.isin(C.WEAK_MITIGATION), "risk_mitigation_weak", "medium",
                           F.concat(name, F.lit(" -> "), fix)),
                ] + [
                    a.flag(cell(which) == "", "risk_rating_blank", "medium", F.concat(name, F.lit(f" -> {label} blank")))
                    for which, label in (("likelihood", "Likelihood"), ("impact", "Impact"))
                ]
                return F.array(*row_flags)

            return F.concat(absent, F.flatten(F.transform(F.slice(t, F.lit(2), F.size(t)), of_row)))

        return let(places, of_columns)

    return flags, [F.flatten(F.transform(tables, of_table))]


def check_kpis() -> list[Column]:
    a = Area("kpis")
    tables = a.tables()
    some = a.filled & (F.size(tables) > 0)
    heads = F.lower(F.array_join(F.flatten(F.transform(tables, lambda t: F.get(t, F.lit(0)))), " "))
    shown = F.left(heads, F.lit(120))
    return a.absent() + [
        a.flag(a.filled & (F.size(tables) == 0), "metrics_not_tabulated"),
        a.flag(some & ~a.has(C.TARGET), "targets_not_measurable"),
        a.flag(some & ~F.contains(heads, F.lit("frequen")) & ~a.has(C.CADENCE), "measurement_frequency_missing"),
        a.flag(some & ~any_of([F.contains(heads, F.lit(h)) for h in C.METHOD_COLUMNS]), "measurement_method_missing", "high", shown),
        a.flag(some & ~any_of([F.contains(heads, F.lit(h)) for h in C.SOURCE_COLUMNS]), "data_source_missing", "high", shown),
        a.flag(a.filled & ~(a.has(C.BREACH) | a.has(C.NO_CREDITS)), "breach_consequence_missing"),
    ]


def check_onboarding() -> list[Column]:
    a = Area("onboarding")
    lacking = missing_parts(a.body, C.ACCESS_ITEMS)
    return a.absent() + [
        a.flag(a.filled & ~a.has_table(), "onboarding_steps_not_tabulated", "medium"),
        a.flag(a.filled & ~(a.has(C.DAYS) | a.has(C.BARE_DAYS) | a.has(C.WEEKS)), "onboarding_duration_missing"),
        a.flag(a.filled & (F.size(lacking) > 0), "customer_obligations_incomplete", "high",
               F.concat(F.lit("missing: "), F.array_join(lacking, ", "))),
        a.flag(a.filled & ~(a.has(C.SCHEDULE_IMPACT) & a.has(C.BILLING_IMPACT)), "delay_impact_missing"),
    ]


def check_assets() -> list[Column]:
    a = Area("assets")
    returned = a.filled & a.has(C.RETURN)
    return a.absent() + a.required() + [
        a.flag(returned & ~a.has(C.CLOSURE), "return_at_closure_missing"),
        a.flag(returned & ~a.has(C.ROLLOVER), "return_on_rollover_missing"),
        a.flag(returned & ~(a.has(C.DAYS) | a.has(C.BARE_DAYS)), "return_timeline_missing"),
    ]


def check_term() -> list[Column]:
    a, agreement = Area("termination"), Area("agreement")
    both = F.concat(a.body, F.lit("\n"), agreement.body)
    lacking = missing_parts(a.body, C.EXIT_PARTS)
    return a.absent() + a.required(both, "term") + a.required() + [
        a.flag(a.filled & ~(a.has(C.DAYS) | a.has(C.BARE_DAYS)), "notice_period_missing"),
        a.flag(a.filled & (F.size(lacking) > 0), "exit_obligations_incomplete", "high",
               F.concat(F.lit("missing: "), F.array_join(lacking, "; "))),
    ]


def check_vendor_alignment() -> list[Column]:
    a = Area("vendor_alignment")
    return a.absent() + a.required() + [
        a.flag(a.filled & a.has(C.ACCEPTANCE_WORD) & ~a.has(C.NOT_TIMESHEETS), "acceptance_basis_unqualified", "medium")]


def check_vendor_compliance() -> list[Column]:
    a = Area("vendor_compliance")
    lacking = missing_parts(a.body, C.REGIMES)
    return a.absent() + a.required() + [
        a.flag(a.filled & (F.size(lacking) > 0), "regimes_missing", "high",
               F.concat(F.lit("missing: "), F.array_join(lacking, ", "))),
        a.flag(a.filled & a.has(C.EVIDENCE) & ~a.has(C.BEFORE_ACCESS), "evidence_not_before_access"),
    ]


TABLED = ("dependencies", "acceptance", "change", "risks", "kpis", "onboarding")  # areas whose tables are read

FAMILIES = ("scope", "acceptance", "change", "commercials", "governance", "risks", "kpis", "onboarding",
            "assets", "term", "vendor_alignment", "vendor_compliance")


def run_checks(
    sections: DataFrame, clients: DataFrame | None = None, supplier: str = "supplier", families: tuple[str, ...] = FAMILIES,
) -> DataFrame:
    """Every flag of the named check families, one row each.

    `sections` may carry `has_own_content`; containers without text of their own
    are left out.  `clients` (project_id, client_name) widens the party words
    with each client's own name, `supplier` names the delivering side.
    """
    if "has_own_content" in sections.columns:
        sections = sections.filter(F.coalesce("has_own_content", F.lit(True)))
    rows = area_texts(sections)
    if clients is not None:
        rows = rows.join(clients.select("project_id", "client_name"), "project_id", "left")
    else:
        rows = rows.withColumn("client_name", F.lit(""))
    rows = rows.select(
        "project_id", "areas",
        party_pattern(C.OWNER_WORDS, supplier, F.col("client_name")).alias("owner"),
        party_pattern(C.CLIENT_WORDS, None, F.col("client_name")).alias("client"),
        *[S.extract_tables(Area(name).body).alias(f"tables_{name}") for name in TABLED])
    owner, client = F.col("owner"), F.col("client")
    build = {
        "scope": lambda: check_scope(owner), "acceptance": check_acceptance, "change": check_change,
        "commercials": check_commercials, "governance": lambda: check_governance(owner, client, supplier),
        "risks": lambda: check_risks(owner), "kpis": check_kpis, "onboarding": check_onboarding, "assets": check_assets,
        "term": check_term, "vendor_alignment": check_vendor_alignment, "vendor_compliance": check_vendor_compliance,
    }
    arrays = []
    for family in families:
        made = build[family]()
        single, listed = made if isinstance(made, tuple) else (made, [])
        arrays += [F.array(*single).cast(FLAG)] + [x.cast(FLAG) for x in listed]
    flags = F.filter(F.concat(*arrays), lambda f: f.isNotNull())
    return rows.select("project_id", F.explode(flags).alias("f")).select("project_id", "f.*")


SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(9)


def check_summary(flags: DataFrame) -> DataFrame:
    """Flag counts per project: all, high, and per story."""
    per_story = flags.groupBy("project_id", "story").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high"))
    return per_story.groupBy("project_id").agg(
        F.sum("n").alias("flag_count"), F.sum("high").alias("high_count"),
        F.array_join(F.sort_array(F.collect_list(F.concat("story", F.lit(":"), F.col("n").cast("string")))), " ").alias("by_story"))
