"""Content checks: a complete contract is clean, and each removed statement raises its flag."""

import pytest

from brieflens.operators import checks as K
from brieflens.sources.contracts import OUTLINE

RISKS = "| Risk | Likelihood | Impact | Mitigation | Owner |\n| --- | --- | --- | --- | --- |\n| Delay | High | High | Add staff | Customer - PM |"
COMPLETE = [
    ("13", "13 Commercials", "This is a fixed price engagement in USD. Payable within 30 days of invoice. Late payment bears interest. Taxes are extra. Travel is billed."),
    ("15", "15 Risks", RISKS),
    ("4.8", "4.8 Dependencies", "| Item | Owning Party |\n| --- | --- |\n| Data feed for all of the sites | Customer |"),
]
SCHEMA = "project_id string, ord long, section_id string, title string, content string"


def kinds(spark, change, families):
    rows = [("p", i, sid, title, change.get(sid, text)) for i, (sid, title, text) in enumerate(COMPLETE)]
    flags = K.run_checks(spark.createDataFrame(rows, SCHEMA), families=families).collect()
    return sorted((f["area"], f["kind"]) for f in flags)


def test_complete_contract_is_clean(spark):
    assert kinds(spark, {}, ("commercials", "risks")) == []


@pytest.mark.parametrize("cut, kind", [
    ("fixed price", "billing_model_missing"), ("within 30 days of invoice", "credit_period_missing"),
    ("Late payment bears interest", "delayed_payment_clause_missing"), ("USD", "currency_missing"),
    ("Taxes", "tax_treatment_missing"), ("Travel", "expense_treatment_missing")])
def test_removed_statement(spark, cut, kind):
    assert kinds(spark, {"13": COMPLETE[0][2].replace(cut, "")}, ("commercials",)) == [("commercials", kind)]


@pytest.mark.parametrize("row, kind", [
    ("| Delay | High | High | Add staff |  |", "risk_owner_unnamed"), ("| Delay | High | High | Add staff | Client |", "risk_owner_role_missing"),
    ("| Delay | High | High | Monitor | Customer - PM |", "risk_mitigation_weak"), ("| Delay |  | High | Plan | Customer - PM |", "risk_rating_blank")])
def test_risk_rows(spark, row, kind):
    table = "\n".join(RISKS.split("\n")[:2] + [row])
    assert kinds(spark, {"15": table}, ("risks",)) == [("risks", kind)]


def test_dependency_owners(spark):
    def of(text):
        return [k for a, k in kinds(spark, {"4.8": text}, ("scope",)) if a == "dependencies"]

    assert of(COMPLETE[2][2]) == []
    assert of(COMPLETE[2][2].replace("Customer", "Board")) == ["dependency_owner_unnamed"]
    assert of(COMPLETE[2][2].replace("Owning Party", "Due date")) == ["dependency_owner_column_missing"]
    assert of("The data feed of all sites is ready when the project begins.") == ["dependency_owner_missing"]


# (section, statement left out) -> flags that this alone raises; together they cover all twelve families
RAISED = {
    ("4.7", 0): ["exclusions: exclusions_not_explicit"], ("4.7", 1): ["exclusions: placeholder_only"],
    ("10", 0): ["assumptions: placeholder_only"], ("9", 0): ["deliverables: placeholder_only"], ("4.8", 0): ["dependencies: placeholder_only"],
    ("11", 0): ["acceptance: criteria_not_per_deliverable"], ("11", 1): ["acceptance: review_window_unit_unclear"],
    ("11", 2): ["acceptance: deemed_acceptance_missing"], ("11", 4): [],
    ("17", 0): ["change: workflow_missing"], ("17", 1): ["change: approvers_missing"], ("17", 2): ["change: turnaround_missing"],
    ("17", 3): [],  # a sibling section states cost and time as well
    ("17", 4): ["change: no_work_rule_missing"],
    ("13", 0): ["commercials: billing_model_missing", "commercials: currency_missing"], ("13", 1): ["commercials: credit_period_missing"],
    ("7", 0): ["governance: forum_cadence_missing"], ("7.4", 0): ["escalation: escalation_levels_incomplete", "escalation: escalation_roles_missing"],
    ("7.4", 1): ["escalation: escalation_levels_incomplete"], ("7.5", 0): ["contacts: contacts_one_sided"], ("7.5", 1): ["contacts: contacts_one_sided"],
    ("15", 0): ["risks: risk_likelihood_missing", "risks: risk_mitigation_missing", "risks: risk_owner_column_missing"], ("15", 1): [],
    ("14", 0): ["kpis: metrics_not_tabulated"], ("14", 1): ["kpis: breach_consequence_missing"],
    ("8.1", 0): ["onboarding: onboarding_steps_not_tabulated"], ("8.1", 3): ["onboarding: delay_impact_missing"],
    ("8.2", 0): ["assets: issuance_process_missing"], ("8.2", 1): ["assets: return_obligation_missing"],
    ("8.2", 2): ["assets: return_on_rollover_missing"], ("8.2", 3): ["assets: loss_accountability_missing"],
    ("1", 0): ["termination: term_start_missing"], ("1", 1): ["termination: term_duration_missing"],
    ("19", 0): ["termination: notice_period_missing", "termination: termination_convenience_missing"],
    ("19", 1): ["termination: termination_cause_missing"], ("19", 2): ["termination: renewal_mechanism_missing"],
    ("12.3", 0): ["vendor_alignment: mirroring_not_stated"], ("12.3", 1): ["vendor_alignment: vendor_sla_missing"],
    ("12.4", 1): ["vendor_compliance: not_stated_binding", "vendor_compliance: regimes_missing"],
    ("12.4", 2): ["vendor_compliance: evidence_requirement_missing"], ("12.4", 4): ["vendor_compliance: audit_rights_missing"],
}
ALWAYS = ["risks: risk_mitigation_weak", "risks: risk_owner_role_missing", "risks: risk_owner_unnamed", "risks: risk_rating_blank"]


def test_each_removed_statement_of_all_families(spark):
    """One contract per statement of the outline left out, all in one job, against a contract with every statement."""
    rows = []
    for name, cut in [("all", None), *((f"{s}#{j}", (s, j)) for s, j in RAISED)]:
        rows += [(name, i, sid, title, "\n".join(x for j, x in enumerate(said) if (sid, j) != cut)) for i, (sid, title, said) in enumerate(OUTLINE)]
    flags = {}
    for f in K.run_checks(spark.createDataFrame(rows, SCHEMA)).collect():
        flags.setdefault(f["project_id"], set()).add((f["area"], f["kind"], f["evidence"]))
    whole = flags["all"]
    assert {f"{a}: {k}" for a, k, _ in whole if a == "risks"} == set(ALWAYS)
    for (sid, j), want in RAISED.items():
        assert sorted({f"{a}: {k}" for a, k, _ in flags[f"{sid}#{j}"] - whole}) == want, (sid, j)


def test_areas_are_found_by_id_then_order_and_gather_their_subsections(spark):
    rows = [("p", 0, "9", "Change Requests", "nine"), ("p", 1, "17", "Change control", "own"), ("p", 2, "17.2", "Steps", "two"),
            ("p", 3, "17.1", "Log", "one"), ("p", 4, "4", "Scope of Work", ""), ("p", 5, "4.7", "4.7 Exclusions", "out"), ("p", 6, "4.7.1", "More", "x"),
            ("p", 7, "30", None, None), ("q", 0, "1", "Nothing", "here")]
    found = {r["project_id"]: r["areas"] for r in K.area_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    areas = {name: (s["section_id"], s["body"]) for name, s in found["p"].items()}
    assert areas == {"change": ("17", "own\ntwo\none\nnine"), "scope": ("4", "out\nx"), "exclusions": ("4.7", "out")}
    assert not found["q"]
