"""Rule packs: every word list, pattern and message the engine works with, as data.

A pack is a plain value. Operators compile it into Column expressions (one
alternation per rule), so no rule table is ever joined or shipped as a lookup.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Corpus, messages and word lists that answers are compared on.
# ---------------------------------------------------------------------------

APPROVED_URLS = (
    "https://www.hdfcfund.com/",
    "https://www.hdfcfund.com/explore/mutual-funds/hdfc-flexi-cap-fund/direct",
    "https://www.hdfcfund.com/explore/mutual-funds/hdfc-elss-tax-saver-fund/direct",
    "https://www.hdfcfund.com/mutual-funds/factsheets",
    "https://www.hdfcfund.com/mutual-funds/fund-documents",
)
FACTSHEETS_URL = "https://www.hdfcfund.com/mutual-funds/factsheets"
EXPLORE_URL = "https://www.hdfcfund.com/explore/mutual-funds"

URL_SCHEMES = {
    "https://www.hdfcfund.com/": "hdfc-fund-hub",
    "https://www.hdfcfund.com/explore/mutual-funds/hdfc-flexi-cap-fund/direct": "hdfc-flexi-cap",
    "https://www.hdfcfund.com/explore/mutual-funds/hdfc-elss-tax-saver-fund/direct": "hdfc-elss-tax-saver",
    "https://www.hdfcfund.com/mutual-funds/factsheets": "hdfc-fund-hub",
    "https://www.hdfcfund.com/mutual-funds/fund-documents": "hdfc-fund-hub",
}
UNKNOWN_SCHEME = "unknown"

NOISE_TAGS = ("script", "style", "nav", "header", "footer", "noscript", "svg", "iframe", "form")
NOISE_MARKERS = ("cookie", "consent", "gdpr", "chatbot", "chat-widget", "newsletter", "footer")

FACT_LABEL_LINES = (
    "returns", "inception date", "riskometer", "min sip", "ideal for", "entry load",
    "ter", "lock in", "nav", "aum", "benchmark", "exit load",
)
NOT_A_VALUE = (
    "disclaimer", "click here", "since inception", "read more", "view detail",
    "know more", "view all", "latest factsheet -", "view historical factsheet",
)
MAX_VALUE_CHARS = 45
MAX_VALUE_WORDS = 5
MAX_QUALIFIER_CHARS = 40
MAX_QUALIFIER_WORDS = 4

TARGET_WORDS = 160
MAX_WORDS = 200
MIN_WORDS = 12
OVERLAP_WORDS = 30
FACT_HEADINGS = (
    "exit load", "entry load", "lock in", "ter", "nav", "aum", "benchmark", "riskometer",
    "min sip", "inception date", "product suitability", "downloads", "fund managers",
)
STOP_PHRASES = (
    "invest now", "know more", "view detail", "view detail all", "view all", "read more",
    "table", "graph", "table graph", "disclaimer", "click here",
    "to view the total expense ratio", "no data available", "no result found!!",
    "no result found", "view more", "explore all mutual funds", "explore all funds",
    "complete your kyc", "login with mobile", "download our app",
    "start investing in mutual funds", "overseas", "all equity debt hybrid",
    "regular direct", "direct regular",
)

# Topic keys in priority order, with the question phrases that raise them.
TOPIC_PHRASES = {
    "exit load": ("exit load", "exit loads", "redemption charge"),
    "lock in": ("lock in", "lock-in", "lockin", "lock in period"),
    "min sip": ("minimum sip", "min sip", "sip amount", "small sip"),
    "riskometer": ("riskometer", "risk meter", "riskometer level", "risk level"),
    "ter": ("expense ratio", "ter", "expense", "total expense ratio", "charges"),
    "benchmark": ("benchmark", "index"),
    "aum": ("aum", "assets under management", "fund size"),
    "nav": ("nav", "net asset value"),
    "downloads": ("download", "sid", "kim", "scheme information document",
                  "key information memorandum", "factsheet", "leaflet"),
    "fund managers": ("fund manager", "who manages", "managed by"),
    "entry load": ("entry load",),
    "inception date": ("inception", "when did it start", "launched"),
    "product suitability": ("who should", "suitable for", "am i eligible"),
}
TOPIC_LABELS = {
    "ter": ("total expense ration", "ter:", "ter ", "expense ratio", "expense ratio:"),
    "aum": ("aum", "assets under management"),
    "nav": ("nav", "net asset value"),
    "exit load": ("exit load",),
    "lock in": ("lock in", "lock-in"),
    "min sip": ("min sip", "minimum sip", "sip amount"),
    "riskometer": ("riskometer",),
    "benchmark": ("benchmark",),
    "fund managers": ("fund manager",),
    "inception date": ("inception date", "inception date:"),
    "entry load": ("entry load",),
}
SCHEME_PHRASES = {
    "hdfc-flexi-cap": ("flexi cap", "flexicap", "hdfc flexi"),
    "hdfc-elss-tax-saver": ("elss", "tax saver", "80c", "hdfc elss"),
}
SCHEME_BOOST = 0.35
HEADING_BOOST = 0.30
FACT_BOOST = 0.55
TEXT_BOOST = 0.12

ADVICE_PATTERNS = (
    r"\bshould\s+i\s+(?:buy|sell|invest|purchase|redeem|switch|hold|start|begin|start\s+an\s+sip)\b",
    r"\b(?:can|should)\s+i\s+(?:buy|sell|invest|start|begin)\b",
    r"\b(?:best|top|good|right)\s+(?:mutual\s+)?fund\b",
    r"\bwhich\s+(?:fund|scheme|one|mutual\s+fund)\b",
    r"\bwhich\s+one\s+(?:should|is|would)\b",
    r"\b(?:is|are)\s+it\s+(?:safe|worth|a\s+good\s+(?:idea|buy|time|investment))\b",
    r"\bworth\s+(?:investing|it|buying)\b",
    r"\bgood\s+time\s+to\s+(?:buy|invest|enter|start)\b",
    r"\brecommend\b",
    r"\b(?:suggest|suggestion)s?\b",
    r"\bshould\s+i\s+(?:hold|keep)\b",
    r"\b(?:rebalance|rebalancing|asset\s+allocation)\b",
    r"\bportfolio\b",
    r"\bhow\s+(?:much|should)\s+i\s+(?:invest|allocate|put)\b",
    r"\b(?:allocate|allocation)\b",
)
PERFORMANCE_PATTERNS = (
    r"\bcagr\b",
    r"\breturns?\b",
    r"\bperformance\b",
    r"\bhow\s+much\s+did\b",
    r"\bwhich\s+(?:one\s+)?(?:performed|gave|returned|has\s+performed|is\s+performing)\b",
    r"\bbetter\s+returns?\b",
    r"\bbest\s+performing\b",
    r"\bper\s+cent\s+(?:gain|return|loss)\b",
    r"%\s*(?:gain|return|loss)\b",
    r"\bhow\s+much\s+(?:money\s+)?(?:will|would)\s+i\s+(?:make|earn|get)\b",
    r"\bprofit(?:ability)?\b",
)
OTHER_ISSUERS = (
    "groww", "icici", "sbi", "axis", "nippon", "kotak", "aditya birla", "birla",
    "uti", "tata", "dsp", "lic", "canara", "canarabank", "motilal", "ppfas",
    "sundaram", "principal", "bandhan", "franklin", "invesco", "hsbc", "barclays",
    "mirae", "navi", "quant", "samco", "360one", "jupiter", "angel", "union",
)
OUT_OF_CORPUS_PRODUCTS = (
    "large cap", "mid cap", "small cap", "hdfc advantage", "top 100",
    "value fund", "dividend yield", "large and mid cap", "banking and psu",
    "pharma", "finserv", "energy", "consumer durables", "utilities",
    "infrastructure", "pension", "target maturity", "corporate bond",
    "g-sec", "gold savings", "silver etf", "nifty", "sensex",
    "banking and financial services",
)

PAN_PATTERN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
OTP_PATTERN = (
    r"\b(?:otp|one[\s-]?time[\s-]?password|verification\s+code|"
    r"auth(?:entication)?\s+code|passcode|pin\s+number)\b"
)
EMAIL_PATTERN = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE_PATTERN = r"(?:\+?91[-\s]?)?0?[6-9](?:[\s-]?\d){9}\b"
AADHAAR_PATTERN = r"\b\d{4}\s?-?\s?\d{4}\s?-?\s?\d{4}\b"
AADHAAR_CONTEXT = r"\b(?:aadhaar|uidai|adhaar|aadhar)\b"
LONG_DIGITS_PATTERN = r"\b\d[\d\s-]{8,}\d\b"
CHECK_TABLE = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9),
    (1, 2, 3, 4, 0, 6, 7, 8, 9, 5),
    (2, 3, 4, 0, 1, 7, 8, 9, 5, 6),
    (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1),
    (6, 5, 9, 8, 7, 1, 0, 4, 3, 2),
    (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4),
    (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
CHECK_ROW = (8, 9, 1, 6, 0, 4, 3, 5, 2, 7)

DECLINE_PATTERN = (
    r"not (?:in|provided in|available in|contained in|mentioned in)\b"
    r"|do(?:es)? not contain\b"
    r"|do(?:es)? not (?:have|include|provide)\b"
    r"|is not provided\b"
)
SOURCE_LABELS = r"(?:source|sources|reference|refer|see|refer to|from|at|per)"
LOW_CONFIDENCE_DISTANCE = 1.0
MAX_SENTENCES = 3

PII_MESSAGE = (
    "Please do not share personal identifiers such as PAN, Aadhaar, account "
    "numbers, OTPs, email addresses or phone numbers. I have removed the "
    "personal data from your message. Please re-ask without it."
)
ADVICE_MESSAGE = (
    "I can share the published facts about HDFC Mutual Fund schemes, but I "
    "cannot recommend whether to buy, sell or hold a fund, and I cannot advise "
    "on allocation. Please review the official factsheets and fund documents "
    "for the scheme details and the suitability section."
)
PERFORMANCE_MESSAGE = (
    "I cannot calculate or compare returns, CAGR or performance. The official "
    "factsheet publishes the fund's returns, and the riskometer, benchmark and "
    "expense ratio, for each scheme."
)
OUT_OF_SCOPE_MESSAGE = (
    "I only have the ingested HDFC Mutual Fund pages, so I cannot answer for "
    "other AMCs or for schemes outside this corpus. You can browse the "
    "approved list of HDFC Mutual Fund schemes here."
)
NOT_IN_PAGES = "The ingested HDFC Mutual Fund pages do not contain this information."
MODEL_UNAVAILABLE = "No answer could be made just now. Please ask again later."
EMPTY_CORPUS = "The corpus has not been ingested yet. Run: python -m lanternfold ingest"
LAST_UPDATED_LABEL = "Last updated from sources: "
NO_CONTEXT = "(no context retrieved)"
SYSTEM_PROMPT = """You are a facts-only assistant for HDFC Mutual Fund scheme pages.

Rules:
- Answer ONLY from the CONTEXT below. The context is the entire knowledge source.
- Use at most 3 sentences. No bulleted lists, no markdown headings, no tables.
- Never give investment advice, opinions, recommendations, or "you should" statements.
- Never calculate, compare, rank, or project returns, CAGR, or profit.
- Never state a number that does not appear verbatim in the CONTEXT.
- If the CONTEXT does not contain the answer, reply that the information is not
  in the official HDFC Mutual Fund pages. Do not guess, and do not fill the gap
  from general knowledge.
- Do not include any URL, link, or source name in your answer. The citation is
  added by the application.
- Answer in plain factual prose."""

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RulePack:
    """All rules of one corpus. Swap the pack to serve another corpus."""

    name: str = "funds"
    approved_urls: tuple[str, ...] = APPROVED_URLS
    # Whole sites that may be cited, for corpora too large to list page by page.
    approved_prefixes: tuple[str, ...] = ()
    default_url: str = FACTSHEETS_URL
    scope_url: str = EXPLORE_URL
    url_schemes: dict[str, str] = field(default_factory=lambda: dict(URL_SCHEMES))
    label_lines: tuple[str, ...] = FACT_LABEL_LINES
    not_values: tuple[str, ...] = NOT_A_VALUE
    fact_headings: tuple[str, ...] = FACT_HEADINGS
    stop_phrases: tuple[str, ...] = STOP_PHRASES
    topic_phrases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(TOPIC_PHRASES))
    topic_labels: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(TOPIC_LABELS))
    scheme_phrases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SCHEME_PHRASES))
    advice_patterns: tuple[str, ...] = ADVICE_PATTERNS
    performance_patterns: tuple[str, ...] = PERFORMANCE_PATTERNS
    other_issuers: tuple[str, ...] = OTHER_ISSUERS
    other_products: tuple[str, ...] = OUT_OF_CORPUS_PRODUCTS
    messages: dict[str, str] = field(default_factory=lambda: {
        "pii": PII_MESSAGE,
        "performance": PERFORMANCE_MESSAGE,
        "advice": ADVICE_MESSAGE,
        "out_of_scope": OUT_OF_SCOPE_MESSAGE,
    })
    not_in_pages: str = NOT_IN_PAGES
    system_prompt: str = SYSTEM_PROMPT

    @property
    def fingerprint(self) -> str:
        """Changes with every rule that a stored chunk feature depends on."""
        return hashlib.sha1(repr((self.topic_phrases, self.topic_labels)).encode()).hexdigest()[:12]

    @property
    def topics(self) -> list[str]:
        return list(self.topic_phrases)

    @property
    def schemes(self) -> list[str]:
        return list(self.scheme_phrases)


FUNDS = RulePack()
