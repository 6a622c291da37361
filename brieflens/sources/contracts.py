"""Contract drafts made from documents: one contract per document.

A contract lists the usual sections; the lines of the document are dealt out
over them in turn, so its whole text is there once (bars as slashes: the standard statements
bring the tables), and each section adds those
of its standard statements the document id selects.  Sections and
statements go missing by id, so every content rule meets both cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SENTENCE_BREAK, load

# (section id, title, statements)
OUTLINE = [
    ("1", "1. Agreement Details", ["The effective date is 2026-01-05.", "The duration is 12 months."]),
    ("4", "4 Scope of Work", ["The services cover planning and integration for all sites of the customer.",
                              "Work follows industry best practice as required."]),
    ("4.7", "4.7 Exclusions", ["Hardware is not included.", "Data cleansing is described here at some length for the reader."]),
    ("4.8", "4.8 Dependencies", ["| Dependency | Owning Party |\n| --- | --- |\n| Data feed | Customer |\n| Access |  |\n| Sites | Board |",
                                 "The client provides the data in time."]),
    ("7", "7 Governance", ["The steering committee meets weekly with the customer.", "Escalation uses level 1, level 2 and level 3 within 2 days.",
                           "Write to team@example.com of the supplier."]),
    ("7.4", "7.4 Escalation Matrix", ["Level 1 and tier 2 answer the customer within 4 hours.", "Level 3 answers immediately."]),
    ("7.5", "7.5 Key Contacts", ["Customer contact: anna@example.com.", "Supplier contact: <CONFIRM: email>."]),
    ("8.1", "8.1 Onboarding & Access", ["| Step | Days |\n| --- | --- |\n| Badge | 3 |\n| Laptop | 5 |", "VPN and licences are ready in two weeks.",
                                        "Accounts are open within 5 days.", "A delay moves the milestone and idle time is billable."]),
    ("8.2", "8.2 Asset Return", ["Laptops are issued with an asset tag.", "Kit is returned within 5 days of closure.", "On rollover the leaver hands over.",
                                 "Loss or damage is charged."]),
    ("9", "9 Key Deliverables", ["A design document and a test report are delivered at the end of each phase.", "Other items <CONFIRM: list> etc."]),
    ("10", "10 Key Assumptions", ["The customer keeps its key users available for the whole project term.", "High quality is expected as applicable."]),
    ("11", "11 Acceptance Criteria", ["| Deliverable | Test |\n| --- | --- |\n| Design | Signed |\n| Report | Passed |", "Review takes ten (10) business days.",
                                      "Work is deemed accepted on expiry of the window.", "The aim is customer satisfaction.", "Comments come in 5 days."]),
    ("12.3", "12.3 Vendor Alignment", ["Vendor terms mirror this document.", "SLAs apply to vendors.", "Acceptance is deliverable-based.", "Payment terms are net 30."]),
    ("12.4", "12.4 Vendor Compliance", ["POSH and the Code of Conduct apply.", "ISMS and PIMS are contractually binding.", "Signed evidence is due before access is granted.",
                                        "Breaches lead to removal.", "We may audit records."]),
    ("13", "13 Commercials", ["This is a fixed price engagement in USD.", "Invoices are payable within 30 days of invoice.", "Late payment bears interest.",
                              "Amounts are exclusive of tax.", "Travel is billed as spent."]),
    ("13.6", "13.6 Change Request Terms", ["Each change request states its cost and timeline, which is mandatory."]),
    ("14", "14 KPIs and SLA", ["| Metric | Target | Frequency | Method | Data source |\n| --- | --- | --- | --- | --- |\n| Uptime | 99% | monthly | log | tool |\n| Fixes | 2 days | weekly | count | tool |",
                               "A breach earns a service credit.", "Reports come monthly."]),
    ("15", "15 Risk Register", ["| Risk | Likelihood | Impact | Mitigation | Owner |\n| --- | --- | --- | --- | --- |\n| Delay | High | High | Add staff | Customer - PM |\n| Loss |  | Low | Monitor | Client |\n| Cost | Low | Low | Plan | Board |",
                                "| Risk | Severity |\n| --- | --- |\n| Fire | High |"]),
    ("17", "17 Change Management", ["A change is raised and logged.", "It is approved by the sponsor.", "Turnaround is 5 days.", "Cost and schedule impact must be assessed.",
                                    "No work will begin until it is signed."]),
    ("19", "19 Term and Termination", ["Either side may end for convenience with 30 days notice.", "A material breach ends it for cause.", "It may be renewed.",
                                       "Exit needs knowledge transfer and return of data.", "Assets are to be returned and the final invoice settled."]),
]


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, ord, section_id, title, content, has_own_content: about twenty sections per document."""
    n = F.col("doc_id")
    outline = F.array(*[
        F.struct(F.lit(i).cast("long").alias("ord"), F.lit(sid).alias("section_id"), F.lit(title).alias("title"),
                 F.array(*[F.lit(s) for s in said]).alias("said"))
        for i, (sid, title, said) in enumerate(OUTLINE)
    ])
    # cut into lines before the explode: what stands beside an explode is computed for every row it makes
    cut = load(spark, sf_dir, "documents").select("doc_id", F.split(F.translate("text", "|", "/"), SENTENCE_BREAK).alias("lines"))
    rows = cut.select("doc_id", "lines", F.explode(outline).alias("s"))
    kept = rows.filter((n + F.col("s.ord")) % 23 != 5)
    said = F.filter(F.col("s.said"), lambda x, j: (n + j * 3) % 4 > 0)
    first, last = F.col("s.ord").cast("int"), F.size("lines") - 1
    turns = F.when(first <= last, F.sequence(first, last, F.lit(len(OUTLINE)))).otherwise(F.array().cast("array<int>"))
    own = F.transform(turns, lambda j: F.get("lines", j))
    content = F.when((n + F.col("s.ord")) % 17 == 3, "").otherwise(F.concat_ws("\n", own, said))
    return kept.select(
        F.concat(F.lit("d"), n.cast("string")).alias("project_id"), F.col("s.ord").alias("ord"),
        F.when(n % 5 == 0, F.concat(F.lit("2"), "s.section_id")).otherwise(F.col("s.section_id")).alias("section_id"),
        F.col("s.title").alias("title"), content.alias("content"), F.lit(True).alias("has_own_content"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), n.cast("string")).alias("project_id"),
        F.when(n % 3 == 0, "Board Holdings Inc").when(n % 3 == 1, "").otherwise("Acme Corp").alias("client_name"))
