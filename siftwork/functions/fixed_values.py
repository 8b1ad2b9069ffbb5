"""Word lists, lookup tables, patterns and limits that results depend on.

Nothing here is logic. Every value is data that a result must agree with, so it is stated plainly,
in natural order, once. Anything a user may want to vary is a field of ``siftwork.config.Settings``.
"""

# --- fixed values: URLs -----------------------------------------------------------------------
TRACKING_PARAMS = [
    "gh_src", "gh_jid", "lever-source", "lever-origin", "ref", "source", "src", "referrer",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "fbclid", "gclid", "mc_cid", "mc_eid", "trk", "trackingid", "refid", "sid", "share",
]

# --- fixed values: company names --------------------------------------------------------------
COMPANY_SUFFIXES = [
    "inc", "llc", "ltd", "corp", "corporation", "co", "company", "technologies", "technology", "labs",
]
COMPANY_ALIASES = {"flyzipline": "zipline"}

# --- fixed values: titles and places ----------------------------------------------------------
TITLE_NOISE = [
    r"20\d\d", "summer", "fall", "spring", "winter", "internship", "intern", "co-op", "coop", "remote",
    "hybrid", "onsite", "on-site", "usa", "us", "canada", "new grad", "graduate", "undergraduate",
    "student", "program", "full[- ]?time", "part[- ]?time",
]
PLACE_NOISE = [
    "united states", "usa", r"u\.s\.a?\.?", "us", "canada", "remote in", "remote", "hybrid", "on-?site",
    "in-?person", "office", "hq", "metro area", "area",
]
PLACE_ALIASES = {
    "nyc": "new york", "new york city": "new york", "sf": "san francisco", "bay area": "san francisco",
    "la": "los angeles", "dc": "washington", "washington dc": "washington", "": "remote",
}
INTERNSHIP_WORDS = [
    "intern", "interns", "internship", "internships", "co-?op", "co-?ops", "summer analyst", "campus",
    "early[- ]career", "students?", "undergraduate", "apprentice(?:ship)?", "placement", "working student",
    "werkstudent",
]

# --- fixed values: HTML -----------------------------------------------------------------------
BLOCK_TAGS = ["p", "div", "br", "li", "ul", "ol", "h[1-6]", "tr", "section", "article"]

# --- fixed values: dealbreakers ---------------------------------------------------------------
UNPAID_PHRASES = ["unpaid", "volunteer position", "for academic credit only"]
CLEARANCE_PHRASES = ["security clearance", "top secret", "ts/sci", "secret clearance"]
CITIZENSHIP_PHRASES = [
    "u.s. citizenship required", "must be a u.s. citizen", "us citizens only", "u.s. citizens only",
    "must be a us citizen",
]
SPONSORSHIP_VALUES = ["citizenship is required"]
TITLE_EXCLUDE = [
    "accounting", "accountant", "audit", "tax", "finance analyst", "financial analyst", "marketing", "sales",
    "business development", "customer success", "recruiter", "recruiting", "human resources", "legal",
    "paralegal", "communications", "public relations", "graphic design", "ux", "ui/ux", "product design",
    "product manag", "program manag", "project manag", "supply chain", "procurement", "logistics",
    "operations analyst", "business analyst", "mechanical", "civil engineer", "structural",
    "chemical engineer", "materials engineer", "biomedical", "nurs", "pharmac", "clinical", "content",
    "social media", "copywrit", "journalis", "editorial", "video", "photograph", "event", "hospitality",
    "retail", "manufacturing engineer", "quality engineer", "industrial engineer", "process engineer",
    "environmental", "sustainability", "data analyst", "analytics intern", "business intelligence",
    "strategy intern", "consult", "frontend", "front-end", "front end", "full stack", "full-stack",
    "fullstack", "web developer", "javascript", "water resources", "wastewater", "stormwater",
    "geotechnical", "land development", "land survey", "surveying", "construction administration",
    "construction management", "architectural", "transportation planning",
]
UNPAID_PATTERN = (
    r"(?i)\b(?:unpaid|non-?paid|no (?:pay|compensation|salary|stipend))\b"
    r"(?!\s*(?:time off|leave|pto|vacation|absence|days?|hours?))"
)
PAY_CONTEXT_WORDS = [
    "salary", "compensation", "pay", "stipend", "position", "internship", "role", "opportunity", "this is",
]
FIRMWARE_TITLE_GATE = ["embedded", "electrical", "hardware", "avionics", "microcontrollers?", "mcu"]
FIRMWARE_SIGNALS = [
    r"\bspi\b",
    r"\bi[2²]c\b",
    r"\busart\b|\buart\b",
    r"\bcan[- ]?(?:bus|fd|protocol)\b|\bcanbus\b|\bcan/lin\b|\blin[- ]?bus\b",
    r"\brtos\b|\bfree-?rtos\b|\bzephyr\b|\bvxworks\b|\bthreadx\b",
    r"\bbare[- ]?metal\b",
    r"\bboot-?loaders?\b",
    r"\bmicro-?controllers?\b|\bmcus?\b|\bstm32[a-z0-9_]*\b|\bpic1[68]\b|\besp32\b|\bmsp430\b|\bnrf5\d\b|\bcortex[- ]?m\d?\b|\batmega\b",
    r"\bjtag\b|\bswd\b",
    r"\bembedded c\b|\bfirmware\b",
    r"\bgpio\b",
]
FIRMWARE_MIN_SIGNALS = 3

# --- fixed values: degrees --------------------------------------------------------------------
DEGREE_LEVELS = {"associate": 1, "bachelor": 2, "master": 3, "phd": 4}
DEGREE_PATTERNS = [
    ("phd", r"(?i)(?<![A-Za-z])ph\.?[\s-]?d\.?s?(?![A-Za-z])|doctoral|doctorate|(?<![A-Za-z])d\.?phil"),
    ("master", r"(?i)master'?s?(?:\s+degree)?|graduate degree|(?<![A-Za-z])m\.?eng\b|(?<![A-Za-z])m\.?a\.?sc\b"),
    ("master", r"\bM\.?S\.?c?\.?(?![A-Za-z])|\bM\.?A\.?(?![A-Za-z])|\bMASc\b|\bMEng\b"),
    ("bachelor", r"(?i)bachelor'?s?(?:\s+degree)?|baccalaureate|undergraduate|undergrad\b|(?<![A-Za-z])b\.?eng\b|(?<![A-Za-z])b\.?a\.?sc\b"),
    ("bachelor", r"\bB\.?S\.?c?\.?(?![A-Za-z])|\bB\.?A\.?(?![A-Za-z])|\bBASc\b|\bBEng\b"),
    ("associate", r"(?i)associate'?s?\s+degree|\bA\.?A\.?S?\.?(?![A-Za-z])"),
]
GRAD_STUDENT_PATTERN = r"(?i)\bgraduate\s+(?:student|program\b(?!\s*(?:for|open))|degree|level\s+(?:student|coursework))"
GRAD_FALSE_FRIENDS = r"(?i)\b(?:recent|new|upcoming|graduating|will\s+graduate|expected\s+to\s+graduate)\b"
UNDERGRAD_YEARS = (
    r"(?i)\b(?:fresh(?:man|men)|sophomore|junior|rising\s+(?:junior|senior)|penultimate\s+year"
    r"|four-?\s?year\s+(?:college|university|degree|program|institution)"
    r"|(?:1st|2nd|3rd|4th|first|second|third|fourth)[\s-]year)\b"
)
# dotted abbreviation -> the same letters without dots; tried in this order
DOTTED_DEGREES = [
    "Ph.D", "B.A.Sc", "M.A.Sc", "B.Sc", "M.Sc", "B.S", "M.S", "B.A", "M.A", "B.Eng", "M.Eng", "D.Phil", "A.A.S",
]
CLAUSE_BREAK = r"(?:[.;:!?\n\r•|]|\s[-–—*]\s)+"
REQUIREMENT_WORDS = (
    r"(?i)(?:currently\s+)?(?:enrolled|enrolment|enrollment|pursuing|working\s+to(?:wards?|ward)|matriculated"
    r"|must\s+(?:be|have|hold)|required|require[sd]?\s|requirements?\b|eligib|open\s+(?:only\s+)?to"
    r"|candidat[a-z]+\s+(?:should|must)|you\s+(?:are|will\s+be)\s+(?:currently\s+)?(?:enrolled|pursuing))"
)
OPTIONAL_WORDS = (
    r"(?i)\b(?:preferred|preferable|preferably|a\s+plus|nice\s+to\s+have|bonus|ideally|desirable|desired"
    r"|advantageous|an\s+asset|not\s+required|or\s+equivalent\s+(?:work\s+)?experience"
    r"|also\s+(?:eligible|welcome|considered|encouraged)|are\s+welcome|as\s+well)\b"
)
PAY_WORDS = r"(?i)\b(?:pay|salary|hourly|compensation|wage|stipend|remuneration|rate\s+range|base\s+rate)\b"
PREFERRED_HEADING = r"(?i)\b(?:preferred|desired|nice[\s-]to[\s-]have|bonus|additional|other|pluses)\b"
REQUIRED_HEADING = (
    r"(?i)\b(?:basic|minimum|required|requirements?|mandatory|must[\s-]have|essential|eligibility"
    r"|qualifications?|education)\b"
)
HEADING_MAX_CHARS = 60
CLAUSE_MAX_CHARS = 400
# every requirement clause contains one of these, lower-cased
REQUIREMENT_HINTS = ["enrol", "pursuing", "working", "matriculated", "must", "requir", "eligib", "open", "candidat"]

# --- fixed values: deadlines ------------------------------------------------------------------
DEADLINE_CUE = (
    r"(?i)(?:application\s+deadline|deadline\s+(?:to\s+apply|for\s+applications?)?|apply\s+(?:by|before|no\s+later\s+than)"
    r"|applications?\s+(?:close|closes|closing|due|must\s+be\s+(?:received|submitted)|(?:are\s+)?accepted\s+(?:until|through))"
    r"|closing\s+date|closes\s+on|last\s+day\s+to\s+apply|posting\s+(?:closes|expires)|expires?\s+on|open\s+until)"
    r"[:\s]*(?:is|of|on)?[:\s]*"
)
# every cue contains one of these, lower-cased
DEADLINE_HINTS = ["deadline", "apply", "application", "closing", "closes", "last", "posting", "expire", "until"]
MONTH_PATTERN = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DEADLINE_WINDOW_CHARS = 60
ROLL_FORWARD_AFTER_DAYS = 30
DROP_AFTER_DAYS = 60
ROLLING_PATTERN = (
    r"(?i)\b(?:rolling\s+basis|rolling\s+admission|applications?\s+(?:reviewed|considered)\s+on\s+a\s+rolling)\b"
)

# --- fixed values: application caps -----------------------------------------------------------
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
CAP_NUMBER = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|[1-9]|10)(?![0-9])"
CAP_THING = (
    r"(?:applications?|roles?|positions?|job postings?|postings?|jobs?|internships?|opportunit(?:y|ies)"
    r"|programs?|programmes?|combinations?)"
)
CAP_PATTERN = (
    r"(?i)(?:up to|no more than|a maximum of|maximum of|max(?:imum)? of|limited to|at most)\s+"
    rf"({CAP_NUMBER})\s*(?:\((?:{CAP_NUMBER})\))?\s+(?:[a-z0-9_&/-]+\s+){{0,4}}{CAP_THING}"
    rf"|\bonly\s+(?:[a-z0-9_-]+\s+){{1,4}}({CAP_NUMBER})\s+(?:[a-z0-9_&/-]+\s+){{0,4}}{CAP_THING}"
    r"|\bone (?:[a-z0-9_-]+\s+){0,2}application per (?:candidate|applicant|person|season|recruitment|cycle|year)"
)
CAP_ANCHORS = ["maximum of", "no more than", "limited to", "at most", "up to", "only ", "application per"]
ABOUT_APPLYING = r"(?i)\bappl(?:y|ying|ied|ication|ications)\b|\bsubmit"
PER_ROLE = r"(?i)\bper (?:role|position|posting|job|requisition|opening)\b"
CAP_WINDOW_BEFORE, CAP_WINDOW_AFTER, CAP_SENTENCE_MAX = 40, 200, 400
SUBMITTED_STATUSES = ["applied", "interview", "rejected", "offer"]

# --- fixed values: scorer input text ----------------------------------------------------------
BOILERPLATE = (
    r"(?i)(?:equal opportunity|equal employment|EEO\b|affirmative action|reasonable accommodation"
    r"|without regard to race|all qualified applicants|benefits (?:include|package)|401\(k\)"
    r"|paid time off|medical, dental|E-Verify|we are committed to (?:diversity|creating|building)"
    r"|diversity, equity|background check|drug (?:screen|test)|pay (?:range|transparency)"
    r"|compensation range|base (?:pay|salary) range)"
)
# the same markers as plain phrases; only "eeo" needs a word end
BOILERPLATE_PHRASES = [
    "equal opportunity", "equal employment", "affirmative action", "reasonable accommodation",
    "without regard to race", "all qualified applicants", "benefits include", "benefits package", "401(k)",
    "paid time off", "medical, dental", "e-verify", "we are committed to diversity",
    "we are committed to creating", "we are committed to building", "diversity, equity", "background check",
    "drug screen", "drug test", "pay range", "pay transparency", "compensation range", "base pay range",
    "base salary range",
]
BOILERPLATE_MIN_START = 400
SCORER_TEXT_CHARS = 2500

# --- fixed values: scoring --------------------------------------------------------------------
TIER_REPUTATION = {1: 90, 2: 70, 3: 55}
SOFTWARE_KEYWORDS = [
    "software", "developer", "swe", "sde", "programmer", "programming", "coding", "computer science",
    "computer engineering", "backend", "back-end", "c++", "python", "rust", "java", "golang", "algorithms",
    "data structures",
]
NEGATIVE_TITLE = [
    "sales", "recruit", "marketing", "human resources", "hr ", "finance", "accounting", "legal", "paralegal",
    "customer success", "customer support", "business development", "product manager", "program manager",
    "project manager", "designer", "ux", "ui ", "front-end", "frontend", "front end", "full-stack",
    "full stack", "fullstack", "web developer", "wordpress", "content", "social media", "operations",
    "supply chain", "civil", "mechanical", "chemical", "biomedical", "environmental", "cyber",
    "cybersecurity", "medical", "analyst", "repair", "audit", "tax", "actuarial", "underwriting", "claims",
    "electrical", "manufacturing", "industrial", "process engineer", "quality engineer", "gas",
    "first nations", "apprentice",
]
TRADING_FIRMS = [
    "jane street", "drw", "hudson river trading", "hrt", "imc", "optiver", "citadel", "jump trading", "virtu",
    "tower research", "point72", "de shaw", "d. e. shaw", "d.e. shaw", "five rings", "pdt", "pdtpartners",
    "two sigma", "susquehanna", "sig", "akuna", "old mission", "radix", "xtx", "headlands", "aquatic capital",
    "hyannis port", "hpr", "belvedere", "chicago trading", "flow traders", "maven securities", "millennium",
    "balyasny", "squarepoint", "wolverine", "peak6", "arrowstreet", "renaissance technologies", "cubist",
    "qube", "voleon", "gts", "tradeweb", "sparta", "geneva trading", "vatic", "hehmeyer", "transmarket",
    "da vinci", "mako", "quantlab", "g-research", "man group", "garda", "valkyrie", "bridgewater",
]
TERM_REASON = r"(?i)term|season|winter|spring|summer|fall|autumn|start (?:date|window)|20\d\d"

# --- fixed values: boards ---------------------------------------------------------------------
WORKDAY_URL = (
    r"([A-Za-z0-9_-]+)\.(wd\d+)\.myworkday(?:jobs|site)\.com/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)"
)
BOARD_URLS = [
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/([A-Za-z0-9_-]+)/jobs/"),
    ("lever", r"jobs\.lever\.co/([A-Za-z0-9_-]+)/"),
    ("ashby", r"jobs\.ashbyhq\.com/([A-Za-z0-9_.-]+)/"),
]
WORKDAY_RESERVED_SITES = ["job", "jobs", "details"]
POLLABLE_BOARDS = ["greenhouse", "lever", "ashby", "workday"]
POLLABLE_STATUSES = ["ok", "empty", "unverified"]
DETAIL_URLS = [
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/([^/?#]+)/jobs/(\d+)|greenhouse\.io/embed/job_app\?.*?(?:for=([^&]+)).*?token=(\d+)"),
    ("lever", r"jobs\.lever\.co/([^/?#]+)/([0-9a-f-]{20,})"),
    ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)/([0-9a-f-]{20,})"),
    ("workday", r"https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+)/job/(.+?)(?:[?#]|$)"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([^/?#]+)/(\d+)"),
    ("oracle", r"https?://([^/]+\.oraclecloud\.com)/hcmUI/CandidateExperience/[^/]+/sites/([^/]+)/job/(\d+)"),
]

# --- fixed values: Markdown feeds -------------------------------------------------------------
ROLE_ABBREVIATIONS = {
    "qd": "Quantitative Developer Intern", "qr": "Quantitative Researcher Intern",
    "qt": "Quantitative Trader Intern", "swe": "Software Engineer Intern", "hw": "Hardware Engineer Intern",
    "fpga": "FPGA Engineer Intern", "ds": "Data Scientist Intern",
}
CONTINUATION_MARKS = ["", "↳", "→", "⮑"]
IMAGE_LINK = r"(?i)img\.shields\.io|/images?/|\.(?:png|svg|gif|jpg)(?:\?|$)"
SYMBOL_CLASS = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}✓✅🔒]+"

# --- fixed values: feed discovery -------------------------------------------------------------
FEED_VOCABULARY = r"intern|co-?op|new.?grad|placement|early.?career"
FEED_MIN_STARS, FEED_MAX_IDLE_DAYS, FEED_MIN_ROWS, FEED_SEARCH_EVERY_DAYS = 40, 45, 15, 7
FEED_GONE_STATUS = [404, 410, 451]

# --- fixed values: queues, packing, digest ----------------------------------------------------
FETCH_GIVE_UP = 2
DEACTIVATE_MIN_ROWS = 5
FIRST_BATCH_TOKENS = 26_000
UNREAD_BATCH_MAX = 36
NEW_WINDOW_HOURS = 36
SESSION_GAP_MINUTES = 45
DEADLINE_CARD_DAYS = 14
URGENT_DAYS = 5
TAG_MIN_JOBS, TAG_MIN_SHARE, TAG_MAX = 2, 0.15, 3
RUBRIC_VERSION = "2"
STAGES = ["shortlisted", "applied", "interview", "offer"]
BOARD_STAGES = ["shortlisted", "applied", "interview", "offer", "rejected", "closed", "skipped"]
BUCKETS = ["likely", "reach", "wildcard", "archive"]

# --- fixed values: role types split out of an older one -> their parent ------------------------
SPLIT_FROM = {
    "compilers": "gpu", "silicon": "hardware", "cv": "ml", "database": "systems", "networking": "systems",
    "cloud": "systems", "data": "systems",
}

# --- fixed values: whitespace as str.split() sees it (valid in Java and in RE2 syntax) ----------
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
