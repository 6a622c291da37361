"""Word lists, lookup tables, constants and patterns.

Results depend on these exact values, so they are stated as plain text.
"""

# --- fixed values: characters a trim removes ---
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: passage search ---
BM25_K1 = 1.5
BM25_B = 0.75
HEADING_WEIGHT = 0.45
BODY_WEIGHT = 0.55
SNIPPET_CHARS = 450
SNIPPET_LEAD = 0.35
PARAGRAPHS_PER_CHUNK = 10
QUERY_SYNONYMS = {
    "forecast": ["demand", "demand plan", "unconstrained forecast"],
    "consumption": ["net off", "net-off", "forecast consumption"],
    "interface": ["integration", "inbound", "outbound"],
    "integration": ["interface", "middleware", "etl"],
    "assumption": ["constraint", "dependency"],
    "constraints": ["assumptions", "limitations", "gating factors"],
    "sop": ["s&op", "sales operations planning", "sales and operations planning"],
    "brd": ["business requirements", "business requirement document"],
}
DOC_NAME_WEIGHTS = [
    ("template", 1.25),
    ("blueprint", 1.15),
    ("solution", 1.10),
    ("best practice", 1.10),
    ("example", 1.00),
    ("draft", 0.95),
    ("wip", 0.90),
]

# --- fixed values: question answering ---
ANCHORS = 6
NEIGHBOR_WINDOW = 6
NEIGHBOR_STEP = 0.07
NEIGHBOR_MIN_FACTOR = 0.55
MAX_PASSAGES = 12
COVERAGE_MIN = 0.55
ANSWER_TTL_SECONDS = 3600
QUESTION_STOP = [
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "will", "have", "been", "their",
    "what", "which", "how", "does", "did", "is", "of", "to", "in", "on", "a", "an", "do", "can", "about",
    "tell", "me", "please",
]
LEXICAL_STOP = [
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "will", "have", "been", "their",
    "into", "per", "via",
]
BLEND_STOP = [
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "will", "have", "been", "their",
    "each", "also", "into", "its", "not", "has",
]

# --- fixed values: chunking and keywords ---
CHUNK_CHARS = 2000
OVERLAP_CHARS = 200
KEYWORDS_PER_CHUNK = 12
KEYWORD_STOP = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is",
    "it", "as", "be", "was", "are", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "this", "that", "these", "those", "i",
    "we", "you", "he", "she", "they", "me", "him", "her", "us", "them", "my", "our", "your", "his", "its",
    "their", "what", "which", "who", "whom", "when", "where", "why", "how", "not", "no", "nor", "if",
    "then", "than", "so", "very", "just", "about", "up", "out", "into", "over", "after", "before",
    "between", "under", "also", "each", "all", "any", "both", "few", "more", "most", "other", "some",
    "such", "only", "own", "same", "too", "s", "t", "re", "ll", "ve", "d", "m", "don", "doesn", "didn",
    "won", "isn", "aren", "were", "hasn", "haven", "hadn", "wouldn", "couldn", "shouldn",
]
SECTION_PHRASES = {
    "1": ["introduction", "purpose", "scope", "company information", "definitions", "acronyms",
          "background", "overview"],
    "2": ["benefit realization", "benefit realisation", "business issues", "value drivers",
          "quantitative benefits", "qualitative benefits", "kpi", "key performance", "roi",
          "return on investment"],
    "3": ["supply chain scope", "supply chain map", "sites", "demand foundation",
          "supply foundation", "inventory management foundation", "scenario structure",
          "planning constraints", "supply chain design"],
    "4": ["demand planning", "demand process", "demand management", "statistical forecast",
          "forecast consumption", "net off", "demand review", "unconstrained forecast",
          "consensus demand", "demand test", "demand test cases"],
    "5": ["supply planning", "inventory planning", "supply & inventory", "supply and inventory",
          "capacity constraints", "supply exceptions", "inventory exceptions", "supply review",
          "replenishment", "supply test", "supply test cases"],
    "6": ["data integration", "data integrations", "architecture", "data sources", "data files",
          "data frequency", "interface", "inbound", "outbound", "etl", "middleware"],
}
RANK_NOISE = [
    "plan", "planning", "supply", "chain", "demand", "data", "process", "flow", "image", "text", "table",
    "title", "figure", "chart", "document", "file", "page", "section", "item", "part", "type", "value",
    "values", "level", "overview", "details", "information", "general", "report", "analysis", "scenario",
    "scenarios", "metric", "metrics", "review", "results", "result",
]
TOPIC_NOISE = [
    "plan", "planning", "supply", "chain", "demand", "data", "process", "flow", "image", "text", "table",
    "title", "figure", "chart", "workbook", "worksheet", "sheet", "document", "file", "page", "section",
    "item", "part", "type", "value", "values", "level", "date", "time", "name", "code", "unit", "units",
    "order", "orders", "note", "notes", "summary", "overview", "details", "information", "embedded",
    "labeled", "modified", "resource", "there", "following", "general", "used", "using", "ability",
    "assign", "define", "update", "analysis", "description", "report", "output", "input", "inputs",
    "outputs", "implementation", "responsibility", "scenario", "scenarios", "metric", "metrics",
    "tracking", "months", "criteria", "results", "result", "review",
]

# --- fixed values: patterns on titles, headings and locators ---
TITLE_PREFIX = (
    r"(?i)^\s*(?:section\s+|clause\s+)?(?:[0-9]+(?:\.[0-9]+)*|[ivxlc]+|appendix\s+[a-z])[\.\)\:\-—–\s]+"
)
CHECK_TITLE_PREFIX = (
    r"(?i)^\s*(?:section\s+)?(?:[0-9]+(?:\.[0-9]+)*|appendix\s+[a-z])[\.\)\:\-—–\s]+"
)
SECTION_NUMBER = r"^\s*(\d+(?:\.\d+)*)\.?[\s\-–:]+(.+?)\s*\z"
SECTION_MARKER = r"^[ \t]{0,3}#{1,4}[ \t]*([0-9]+(?:\.[0-9]+)*)\b.*$"
# a header row, a separator row, then rows; in a form that cannot backtrack per cell
STRICT_TABLE = r"\|[^\n]*\|\n\|(?:\s*-+\s*\|)+\n(?:\|[^\n]*\|\n)*"
HEDGES = ["idk", "don't know", "dont know", "not sure", "tbd", "you decide", "suggest", "propose"]
EMPTY_WORDS = ["", "null", "none", "n/a", "na", "tbd", "not specified", "not stated", "unknown",
               "not provided"]
LOCATORS = [
    r"(?i)\bSlide\s+\d+\b\.?",
    r"\[Source:[^\]]*\]",
    r"(?i)\bRFP\s+dashboard\b",
    r"(?i)\(\s*(?:page|pg\.?)\s*\d+\s*\)",
    r"(?i)\bon\s+(?:page|pg\.?)\s+\d+\b",
]
IMAGE_TAG_ANY = (
    r"(?i)<[ \t]*image[ \t]+id[ \t]*=[ \t]*[\"']?([A-Za-z0-9_\-]+)[\"']?[ \t]*/?[ \t]*>"
    r"(?:[ \t]*<[ \t]*/[ \t]*image[ \t]*>)?"
)
SECTION_LINE = r"(?i)^section\s+([0-9]+(?:\.[0-9]+)*)\s*[:.)-]?\s*(.*)$"
NUMBERED_PUNCT_LINE = r"^([0-9]+(?:\.[0-9]+)*)(?:\s*[:)-]\s+|\.\s+)(.+)$"
NUMBERED_LINE = r"^([0-9]+(?:\.[0-9]+)*)\s+(.+)$"
TITLE_FILLERS = ["the", "a", "an", "of", "and", "for", "to", "in", "on"]
CAPTION_SKIP_HEADINGS = ["note", "tip", "important", "unknown"]

# --- fixed values: fact gathering ---
HARD_SIGNAL = (
    r"(?i)\b(?:20\d{2})\b"
    r"|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*'?\d{2,4}\b"
    r"|\b(?:go[- ]?live|kick[- ]?off|hypercare|cutover|effective date|end date|"
    r"start date|commencement|duration|milestone)\b"
)
FACT_PROBES = [
    "project timeline start date kickoff go-live date end date duration "
    "months schedule phases milestones hypercare cutover wave release",
    "client name customer company legal entity account engagement project name "
    "proposal title response to RFP",
    "delivery locations onsite offshore geography regions countries sites "
    "plants offices time zone delivery centers",
    "scope in-scope out of scope modules systems applications integrations "
    "landscape environments instances",
    "commercials pricing cost effort estimate rate card resources team size "
    "FTE headcount pyramid engagement model fixed price time and materials",
    "governance steering committee reporting cadence escalation RACI roles "
    "responsibilities project manager stakeholders sponsor",
    "assumptions dependencies prerequisites exclusions constraints risks",
    "deliverables acceptance criteria sign-off milestones payment terms invoicing",
    "methodology approach phases activate explore realize deploy run "
    "implementation strategy conversion migration testing",
    "SLA support KPI performance metrics availability response resolution",
]

# --- fixed values: images in answers ---
IMAGE_INTENT = (
    r"(?i)\b(?:image|images|picture|pictures|photo|photos|diagram|diagrams|figure|figures|"
    r"screenshot|screenshots|screen ?shot|illustration|illustrations|visual|visuals|"
    r"chart|charts|graphic|graphics|fl/?chart|flow ?chart|swimlane|drawing|drawings|"
    r"snapshot|show me|depict|visualis|visualiz)\b"
)
IMAGE_REQUEST_WORDS = [
    "image", "images", "picture", "pictures", "photo", "photos", "diagram", "diagrams", "figure",
    "figures", "screenshot", "screenshots", "screen", "shot", "illustration", "illustrations", "visual",
    "visuals", "graphic", "graphics", "flowchart", "swimlane", "drawing", "drawings", "snapshot", "show",
    "see", "display", "depict", "explain", "tell", "give", "including", "include", "includes", "relevant",
    "related", "any", "some", "view",
]
JUNK_IMAGE = r"(?i)\b(?:logo|branding|abstract|background|decorative|watermark)\b"
DIAGRAM_TITLE = (
    r"(?i)\b(?:architecture|landscape|topology|process\s+flow|to-?be|as-?is|workflow|swimlane|"
    r"integration|interface|data\s+flow|solution\s+design|system\s+design|technical\s+design|"
    r"methodology|approach|framework|operating\s+model|governance\s+model|delivery\s+model|"
    r"engagement\s+model|roadmap|timeline|phases|releases|milestones|"
    r"org(?:anisation|anization)?\s+chart|raci|scope\s+overview|solution\s+overview)\b"
)
PLACEHOLDER = r"(?i)<\s*information not available[^>]*>"

# --- fixed values: scorecard ---
RATINGS = {"Best Practice": 2, "Minimally Meets": 1, "Does Not Meet": 0, "Not Applicable": None}
RATING_RANK = ["Not Applicable", "Does Not Meet", "Minimally Meets", "Best Practice"]
NOT_APPLICABLE_FORMS = ["n/a", "na", "not applicable"]
# (criteria, weight) of categories 1 to 14
RUBRIC = [(4, 0.07), (3, 0.10), (4, 0.07), (4, 0.10), (5, 0.06), (6, 0.05), (5, 0.05),
          (4, 0.05), (4, 0.12), (4, 0.08), (4, 0.07), (4, 0.08), (3, 0.07), (3, 0.03)]
BANDS = [(0.8, "ready"), (0.6, "needs work"), (0.0, "not ready")]
EVIDENCE_STATES = ["found", "absent", "unassessable"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]
RUBRIC_HEADING = r"^### (\d+)\. (.+?) \((\d+) criteria, weight ([\d.]+)\)(.*)$"
RUBRIC_ROW = r"^\|\s*(\d+)\s*\|([^|\n]*)\|([^|\n]*)\|([^|\n]*)\|([^|\n]*)\|\s*$"
CHECKLIST_HEADING = r"^### (2\.\d+) ([^(\n]+?)\s*\((\d+) checkpoints\)(.*)$"
CHECKLIST_ROW = r"^\|\s*(\d+)\s*\|([^|]*)\|([^|]*)\|([^|]*)\|\s*$"

# --- fixed values: review gate ---
GATE_STATES = ["open", "validated", "waived", "na"]
RESOLVED_STATES = ["validated", "waived", "na"]
REASON_STATES = ["waived", "na"]
APPROVER_STATES = ["waived"]

# --- fixed values: legal baseline ---
DEVIATION_THRESHOLD = 0.72
PROTECTED_PHRASES = [
    "indemnif", "limitation of liability", "liability cap", "not to exceed", "intellectual property",
    "work made for hire", "confidential", "data protection", "personal data", "gdpr",
    "termination for convenience", "governing law", "dispute resolution", "warranty", "sole remedy",
    "force majeure", "insurance", "audit right", "subcontract", "non-solicit", "background ip",
    "acceptance is deemed",
]

# --- fixed values: draft quality and isolation ---
UNFILLED = r"(?i)\[(?:CLIENT|COMPANY|DATE|TBD|TODO|PLACEHOLDER|INSERT|ADD HERE)[^\]]*\]"
GENERIC_NAME = r"(?i)\b(?:client name|company name|your company)\b"
PROMPT_COMPANY = r"reference\s+(.+?)\s+throughout|client company:\s*(.+?)(?:\\n|\n|$)"

# --- fixed values: images ---
IMAGE_SECTION_PHRASES = {
    "1": ["introduction", "purpose", "scope", "company information", "overview"],
    "2": ["benefit realization", "business issues", "value drivers", "kpi", "roi"],
    "3": ["supply chain scope", "supply chain map", "sites", "scenario", "constraints"],
    "4": ["demand planning", "demand process", "forecast", "demand management"],
    "5": ["supply planning", "inventory planning", "capacity", "replenishment"],
    "6": ["data integration", "architecture", "data sources", "interface", "etl"],
}
LOGO_WORDS = (
    r"(?i)\b(?:logo|icon|branding|brand mark|wordmark|company logo|corporate logo|product logo|badge|avatar|bullet)\b"
)
DIAGRAM_WEIGHTS = {
    "architecture_diagram": 1.6, "flowchart": 1.6, "process_flow": 1.6, "process_diagram": 1.6,
    "timeline": 1.4, "gantt": 1.4, "chart": 1.2, "table": 1.2, "screenshot": 0.8, "photo": 0.5, "other": 0.6,
}
FIGURE_LINE = r"^\*?\s*Figure\s+[\d.]+\s*:.*\*?$"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\(([^)]*)\)"
OPERATIONAL_DOCS = ["user stories", "user_stories", "workshop", "sprint"]

# --- fixed values: uploads ---
SOURCE_EXTENSIONS = ["pdf", "docx", "doc", "txt", "xlsx", "xls", "xlsm", "pptx", "ppt", "png", "jpg", "jpeg",
                     "gif", "webp", "bmp"]
PROMPT_EXTENSIONS = ["json", "yaml", "yml"]
MAX_FILE_BYTES = 200 * 1024 * 1024
