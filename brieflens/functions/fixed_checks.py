"""Fixed values of the contract content checks: areas, phrases and patterns.

Patterns are portable; `functions.text.uni` makes them Unicode-aware in Java.
"""

# --- fixed values: area -> (preferred ids, title words, blocked title words) ---
AREAS = {
    "scope": (["4"], ["scope of work", "project scope", "services scope"], ["out of scope", "exclusion"]),
    "deliverables": (["9"], ["deliverable"], []),
    "assumptions": (["10"], ["assumption"], []),
    "dependencies": (["4.8"], ["dependenc"], []),
    "exclusions": (["4.7"], ["exclusion", "out of scope", "not in scope"], []),
    "acceptance": (["11"], ["acceptance criteria", "acceptance"], ["acceptance and sign", "sign-off"]),
    "change": (["17"], ["change management", "change request", "change control"], []),
    "commercials": (["13"], ["commercial", "fees and payment", "pricing", "charges"], []),
    "governance": (["7"], ["project management", "governance"], ["risk mitigation"]),
    "escalation": (["7.4"], ["escalation"], []),
    "contacts": (["7.5"], ["key contact", "contact"], []),
    "risks": (["15"], ["risk"], ["risk mitigation", "mitigation"]),
    "kpis": (["14"], ["performance reporting", "kpi", "sla", "service level"], []),
    "onboarding": (["8.1"], ["onboarding", "access provisioning", "mobilisation", "mobilization"], []),
    "assets": (["8.2"], ["asset"], []),
    "agreement": (["1"], ["agreement details"], []),
    "termination": (["19"], ["termination", "term and termination", "term & termination"], []),
    "vendor_alignment": (["12.3"], ["vendor alignment", "subcontractor", "back-to-back", "vendor contract"], []),
    "vendor_compliance": (["12.4"], ["vendor compliance", "contractor compliance", "contractor and vendor"], []),
}
OWN_TEXT_ONLY = ["deliverables", "assumptions", "dependencies", "exclusions", "escalation", "contacts"]
SIBLING_TITLE = "change request"

# --- fixed values: phrases ---
BOILERPLATE = [
    "industry best practice", "as per standard practice", "as applicable", "as required", "where necessary",
    "and other related activities", "etc.", "high quality", "in a timely manner", "as mutually agreed",
    "standard methodology", "usual and customary",
]
VAGUE_ACCEPTANCE = [
    "client satisfaction", "customer satisfaction", "to the satisfaction of", "works as expected",
    "high quality", "acceptable quality", "meets expectations", "satisfactory to",
]
WEAK_MITIGATION = ["monitor", "monitor closely", "keep under review", "manage carefully", "as needed", "tbd", "n/a", "-"]
OWNER_COLUMNS = ["owning party", "owner", "responsible party", "responsible", "accountable", "party"]
METHOD_COLUMNS = ["measurement method", "method", "how measured", "calculation", "formula"]
SOURCE_COLUMNS = ["data source", "source", "system of record", "evidence", "report source"]
RISK_COLUMNS = {
    "likelihood": ["likelihood", "probability"],
    "impact": ["impact", "severity", "consequence"],
    "mitigation": ["mitigation", "response", "treatment", "action"],
    "owner": ["owner", "owning", "responsible", "accountable"],
}
OWNER_WORDS = ["customer", "client", "supplier", "vendor", r"third[\s\-]?party", "joint", "both parties"]
CLIENT_WORDS = ["customer", "client", r"third[\s\-]?party", "joint", "both parties"]
COMPANY_SUFFIXES = [
    "inc", "llc", "ltd", "limited", "corp", "corporation", "gmbh", "plc", "sa", "bv", "co", "company",
    "group", "holdings", "the",
]

# --- fixed values: patterns ---
CONFIRM = r"(?i)<\s*CONFIRM\s*:"
DAYS = (
    r"(?i)\b(?:\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty)\b"
    r"[^.\n]{0,40}?\b(?:business|working|calendar)\s+days?\b"
)
BARE_DAYS = r"(?i)\b(?:\d{1,3})\s*(?:\(\s*\w+\s*\)\s*)?days?\b"
DEEMED = r"(?i)deem(?:ed|s|)\s+(?:to\s+be\s+)?accept"
AUTOMATIC = r"(?i)\bautomatic(?:ally)?\b|\bon expiry\b|\bupon expiry\b|\bwithout further\b|\blapse\b"
NEGATIVE_SCOPE = (
    r"(?i)\b(?:not included|not in scope|out of scope|excluded|excludes|will not|shall not|does not include|"
    r"no \w+ (?:is|are|will)\b)"
)
NO_WORK = (
    r"(?i)\bno\s+(?:\w+\s+){0,3}work\b[^.]{0,160}?\b(?:begin|commence|start|proceed|be\s+performed|be\s+undertaken)|"
    r"\b(?:not|shall not|will not|may not)\s+(?:be\s+)?(?:commence|begin|start|proceed|performed|undertaken)\b[^.]{0,160}?"
    r"\b(?:approv|sign|authoris|authoriz)|"
    r"\b(?:until|before)\b[^.]{0,120}?\b(?:cr|change request)\b[^.]{0,120}?\b(?:approv|sign|authoris|authoriz)|"
    r"\bonly\s+(?:after|upon|once)\b[^.]{0,120}?\b(?:approv|sign|authoris|authoriz)"
)
STEPS = r"(?i)\b(?:step\s*1|raised|logged)\b"
APPROVERS = (
    r"(?i)\bapprov(?:er|ed by|al authority)\b|\bsign(?:ed|-off) by\b|\bauthori[sz]ed by\b|\bsponsor\b|\bengagement manager\b"
)
TURNAROUND = r"(?i)\bturnaround\b|\bsla\b|\bwithin \d+\b"
COST_IMPACT = r"(?i)\bcost\b|\bcommercial\b|\bprice|\bpricing\b|\bfee\b|\bbudget\b|\beffort\b|\bvalue\b"
TIME_IMPACT = r"(?i)\btimeline\b|\bschedule\b|\bmilestone\b|\bduration\b|\bdelivery date\b|\bplan\b"
MANDATORY = r"(?i)\bmandatory\b|\bmust\b|\brequired\b|\bcannot be approved without\b"
CADENCE = (
    r"(?i)\b(?:daily|weekly|fortnight(?:ly)?|bi[\s\-]?weekly|monthly|quarterly|twice (?:a|per) week|every \d+ (?:days?|weeks?))\b"
)
RESPONSE_TIME = (
    r"(?i)\b\d{1,3}\s*(?:\(\s*\w+\s*\))?\s*(?:business |working |calendar )?(?:hours?|hrs?|days?)\b|\bsame day\b|"
    r"\bimmediate(?:ly)?\b"
)
LEVEL = r"(?i)\b(?:level|l|tier)\s*[\-]?\s*([123])\b"
EMAIL = r"(?i)[\w.+-]+@[\w-]+\.[\w.]+|<\s*CONFIRM[^>]*(?:email|contact)[^>]*>"
OWNER_ROLE = r"(?i)[\-—–:,]|\b(?:manager|lead|owner|director|sponsor|architect|head|officer|analyst|pm|smes?)\b"
TARGET = (
    r"(?i)\d+\s*%|\b\d+(?:\.\d+)?\s*(?:hours?|days?|hrs?|business days?|defects?|incidents?|per|/)\b|\b100%|\bzero\b|\bnil\b"
)
NO_CREDITS = (
    r"(?i)no service credits|without service credits|no financial penalt|no penalt|not applicable|no sla|"
    r"does not carry (?:any )?service credit"
)
BREACH = (
    r"(?i)service credit|remediation plan|penalt|breach[^.\n]{0,60}?(?:escalat|credit|remedy)|escalat[^.\n]{0,60}?breach|"
    r"root cause analysis"
)
WEEKS = r"(?i)\bweeks?\b"
BILLING_IMPACT = (
    r"(?i)\bbillab|\bcharge|\binvoic|\bbilling\b|\bcost\b|\bfee\b|\bidle\b|\bstand[\s\-]?by\b|\bnon[\s\-]?productive\b"
)
SCHEDULE_IMPACT = (
    r"(?i)\bschedul|\bmilestone|\btimeline|\bdelivery date|\bslip|\bshift|\bextend|\bdelay[^.\n]{0,60}?\b(?:date|plan|milestone)"
)
ACCESS_ITEMS = {
    "vpn": r"(?i)\bvpn\b|\bremote access\b",
    "licence": r"(?i)\blicen[cs]e",
    "access": r"(?i)\baccess\b|\baccount\b|\bcredential",
}
RETURN = r"(?i)\breturn|\bsurrender|\bhand(?:ed)?\s*back\b|\brecover"
CLOSURE = r"(?i)\bclosure\b|\bcompletion\b|\bend of (?:the )?(?:project|engagement)\b|\btermination\b|\bexit\b"
ROLLOVER = (
    r"(?i)\brollover\b|\broll[\s\-]off\b|\breplacement\b|\breassign|\bleaves? the (?:project|engagement)\b|"
    r"\bexits? the (?:project|team)\b|\bresource change\b|\bdemobilis"
)
ACCEPTANCE_WORD = r"(?i)\bacceptance\b"
NOT_TIMESHEETS = (
    r"(?i)\bnot\b[^.\n]{0,80}?\btimesheet\b|\btimesheet\b[^.\n]{0,80}?\bnot\b|\bdeliverable[\s\-]based\b|"
    r"\brather than (?:a )?timesheet\b"
)
EVIDENCE = (
    r"(?i)\bevidence\b|\backnowledge?ment\b|\backnowledge\b|\bsigned\b|\btraining (?:record|completion|certificate)\b|"
    r"\battestation\b|\bcertificat"
)
BEFORE_ACCESS = (
    r"(?i)\bbefore\b[^.\n]{0,80}?\baccess\b|\bprior to\b[^.\n]{0,80}?\baccess\b|"
    r"\baccess\b[^.\n]{0,80}?\b(?:only after|is granted only|conditional (?:up)?on)\b|\bpre[\s\-]?requisite\b"
)
REGIMES = {
    "POSH": r"(?i)\bPOSH\b|prevention of sexual harassment",
    "Code of Conduct": r"(?i)\bcode of conduct\b|\bCoC\b",
    "ISMS": r"(?i)\bISMS\b|information security management",
    "PIMS": r"(?i)\bPIMS\b|privacy information management",
}
EXIT_PARTS = {
    "knowledge transfer": r"(?i)\bknowledge transfer\b|\bhandover\b|\bhand[\s\-]over\b|\btransition (?:out|assistance|support)\b",
    "data return or deletion": (
        r"(?i)\bdata\b[^.\n]{0,60}?\b(?:return|deletion|delete|destroy|purge)\b|\breturn[^.\n]{0,40}?\bdata\b"),
    "asset return": (
        r"(?i)\basset[^.\n]{0,40}?\breturn|\breturn[^.\n]{0,40}?\basset|\bequipment[^.\n]{0,40}?\breturn"),
    "final settlement": (
        r"(?i)\bfinal settlement\b|\bfinal invoice\b|\bfinal payment\b|\breconcil|\boutstanding amounts?\b"),
}

# --- fixed values: statements an area must contain: (area, kind, pattern); absent = one high flag ---
REQUIRED = [
    ("commercials", "billing_model_missing",
     r"(?i)\btime (?:and|&) materials?\b|\bT&M\b|\bfixed[\s\-]?(?:cost|price|fee)\b|\bmilestone[\s\-]based\b|\bhybrid\b|"
     r"\bretainer\b|\bfixed monthly\b"),
    ("commercials", "credit_period_missing",
     r"(?i)\b(?:net|within|payable within|due within|credit period of)\s*(?:\d{1,3}|thirty|sixty|forty[\s\-]?five|ninety|fifteen)\b"
     r"[^.\n]{0,30}?\bdays?\b|\b(?:\d{1,3})\s*(?:\(\s*\w+\s*\))?\s*days?\b[^.\n]{0,40}?"
     r"\b(?:from (?:the )?invoice|of invoice|after invoice|invoice date)\b"),
    ("commercials", "delayed_payment_clause_missing",
     r"(?i)\binterest\b|\blate[\s\-]payment\b|\boverdue\b|\bpenalt|\bsuspend\b|\bwithhold (?:further )?(?:services|delivery)\b|"
     r"\bdefault\b"),
    ("commercials", "currency_missing",
     r"(?i)\b(?:USD|EUR|GBP|INR|AUD|CAD|SGD|JPY|CHF|AED)\b|[$€£₹]|\b(?:us dollars?|euros?|pounds? sterling|rupees?)\b"),
    ("commercials", "tax_treatment_missing",
     r"(?i)\bVAT\b|\bGST\b|\bsales tax\b|\btaxes?\b|\bwithholding\b|\bexclusive of tax\b|\bservice tax\b"),
    ("commercials", "expense_treatment_missing",
     r"(?i)\bexpenses?\b|\btravel\b|\bout[\s\-]of[\s\-]pocket\b|\bper[\s\-]diem\b|\breimburs"),
    ("assets", "issuance_process_missing",
     r"(?i)\bissu(?:e|ed|ance)\b|\ballocat|\bregister\b|\btrack(?:ed|ing)?\b|\binventory\b|\basset tag\b"),
    ("assets", "return_obligation_missing", RETURN),
    ("assets", "loss_accountability_missing",
     r"(?i)\bloss\b|\blost\b|\bdamage\b|\bnon[\s\-]return\b|\bnot returned\b|\bfail(?:ure|s)? to return\b|"
     r"\breplacement (?:value|cost)\b|\brecover the cost\b|\bdeduct"),
    ("term", "term_start_missing",
     r"(?i)\bstart date\b|\beffective date\b|\bcommence(?:s|ment)?\b|\bbegins? on\b|\bfrom \d{4}-\d{2}-\d{2}\b"),
    ("term", "term_duration_missing",
     r"(?i)\bduration\b|\bend date\b|\bexpir|\bterm of\b|\b\d{1,3}\s*(?:months?|weeks?|years?)\b|\buntil\b"),
    ("term", "renewal_mechanism_missing",
     r"(?i)\brenew|\bextend|\bextension\b|\bauto[\s\-]?renew|\bno renewal\b|\bnot (?:be )?renewed\b"),
    ("termination", "termination_convenience_missing", r"(?i)\bfor convenience\b|\bwithout cause\b|\bat any time\b"),
    ("termination", "termination_cause_missing",
     r"(?i)\bfor cause\b|\bmaterial breach\b|\binsolven|\bdefault\b|\bfraud\b|\bbreach of\b"),
    ("vendor_alignment", "mirroring_not_stated",
     r"(?i)\bmirror|\bback[\s\-]to[\s\-]back\b|\bflow(?:ed|s)?[\s\-]down\b|\bpass(?:ed)?[\s\-]through\b|"
     r"\balign(?:ed|ment)? with\b|\bno less onerous\b|\bequivalent to\b"),
    ("vendor_alignment", "vendor_sla_missing", r"(?i)\bslas?\b|\bservice[\s\-]levels?\b|\bkpis?\b"),
    ("vendor_alignment", "vendor_acceptance_missing", ACCEPTANCE_WORD),
    ("vendor_alignment", "vendor_payment_terms_missing",
     r"(?i)\bpayment terms?\b|\bcredit period\b|\bnet\s*\d+\b|\bpay(?:able|ment) (?:within|after)\b"),
    ("vendor_compliance", "not_stated_binding",
     r"(?i)\bbinding\b|\bcontractually\b|\bshall comply\b|\bmust comply\b|\brequired to comply\b|\bflow(?:ed|s)?[\s\-]down\b"),
    ("vendor_compliance", "evidence_requirement_missing", EVIDENCE),
    ("vendor_compliance", "consequences_missing",
     r"(?i)\brevoke|\brevocation\b|\bremoval\b|\bremove\b|\bterminat|\bsuspend|\bmaterial breach\b|\bdebar"),
    ("vendor_compliance", "audit_rights_missing", r"(?i)\baudit\b|\binspect"),
]

# --- fixed values: review story of each area ---
STORY = {
    "scope": "US-04", "deliverables": "US-04", "assumptions": "US-04", "dependencies": "US-04", "exclusions": "US-04",
    "acceptance": "US-05", "change": "US-06", "commercials": "US-07", "governance": "US-08", "escalation": "US-08",
    "contacts": "US-08", "risks": "US-09", "kpis": "US-10", "onboarding": "US-11", "assets": "US-12",
    "termination": "US-13", "vendor_alignment": "US-14", "vendor_compliance": "US-15",
}
