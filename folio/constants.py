"""Fixed values that decide results.

Everything that must stay equal between the Spark operators and the DuckDB
oracle lives here, in plain text, so that both sides read the same numbers.
"""

from __future__ import annotations

# --- fixed values: analysis ---------------------------------------------------
# Token pattern: runs of Unicode letters, digits and underscore (Java and RE2
# both accept it; `\w` would be ASCII-only in both).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
# Minimum token length kept by the stop filter.
MIN_TOKEN_LEN = 2
# Stop words of the standard analyzer of the full-text library the reference
# stands on (English list, fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from",
    "have", "if", "in", "is", "it", "may", "not", "of", "on", "or", "tbr",
    "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet",
    "you", "your",
)

# --- fixed values: ranking -----------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
# Per-field (boost, B). Fields not listed use (1.0, BM25_B).
FIELD_WEIGHTS = {"title": (2.0, 0.6), "content": (1.0, 0.75)}
SCORE_DECIMALS = 6

# Re-rank multipliers
BOOST_TITLE_MATCH = 2.0
BOOST_EXACT_MATCH = 3.0
BOOST_FORMAT_PREFERENCE = 1.1
POPULARITY_BANDS = ((0.8, 1.2), (0.5, 1.1))           # (score above, factor)
RECENCY_BANDS = ((7, 1.5), (30, 1.3), (90, 1.1))       # (age days below, factor)
OLD_DOCUMENT_DAYS = 365
OLD_DOCUMENT_FACTOR = 0.9

# --- fixed values: formats -----------------------------------------------------
# Format enum (10 values).
FORMATS = ("markdown", "text", "html", "pdf", "json", "yaml", "code",
           "notebook", "office", "unknown")
STATUSES = ("pending", "indexed", "failed", "updated", "deleted")
# Extension -> format for the formats that have a handler.
EXTENSION_FORMATS = {
    ".txt": "text", ".text": "text", ".log": "text", ".csv": "text", ".tsv": "text",
    ".md": "markdown", ".markdown": "markdown", ".mkd": "markdown", ".mdx": "markdown",
    ".json": "json", ".jsonl": "json", ".geojson": "json",
    ".yaml": "yaml", ".yml": "yaml",
    ".py": "code", ".pyw": "code", ".pyi": "code",
    ".html": "html", ".htm": "html", ".xhtml": "html",
}
# Formats of uploaded files: these extensions only.
UPLOAD_EXTENSION_FORMATS = {
    ".md": "markdown", ".txt": "text", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".py": "code", ".js": "code", ".html": "html", ".htm": "html",
}
# Built-in ignore globs of the scanner.
DEFAULT_IGNORE = (".*", "*.pyc", "__pycache__", "*.swp", "*.tmp", ".DS_Store", "Thumbs.db")

# HTML entities decoded by the text extractor (X15), applied in this order.
HTML_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))

# --- fixed values: search surface ---------------------------------------------
DEFAULT_FACET_FIELDS = ("format", "category", "tags", "status", "year")
SNIPPET_LENGTH = 200
SNIPPET_CUT_RATIO = 0.8
# Terms, and related tags of each, that query templates are filled with.
TEMPLATE_TERMS = 3
MAX_PAGE_SIZE = 100
# Fragments of a hit: tokens in one, tokens before its first hit, and how many.
FRAGMENT_TOKENS, FRAGMENT_CONTEXT, FRAGMENTS = 24, 4, 3
HIGHLIGHT_OPEN = "<mark>"
HIGHLIGHT_CLOSE = "</mark>"
# Words per minute for reading time.
READING_WPM = 225
# Query templates expanded from the top completions (Q7); {term2} is a related tag.
QUERY_TEMPLATES = (
    "title:{term}", "tags:{term}", "format:{term}",
    "{term} AND {term2}", "{term} OR {term2}", '"{term}"',
)
# Suggestions returned when nothing is known yet (Q5).
DEFAULT_SUGGESTIONS = ("format:markdown", "tags:documentation", "title:README")
# Query-log terms shorter than this are skipped; full queries must be shorter than LOG_QUERY_MAX.
LOG_TERM_MIN = 3
LOG_QUERY_MAX = 100
# Metric thresholds (H1): value above -> unhealthy.
DEFAULT_THRESHOLD = 90.0
METRIC_HISTORY = 1000
METRIC_WINDOW = 100

# --- fixed values: query-log classification (P14, P15) ------------------------
QUERY_PATTERNS = (
    ("phrase", r'"([^"]+)"'),
    ("field", r"(\w+):([^\s]+)"),
    ("wildcard", r"[*?]"),
    ("fuzzy", r"~\d*$"),
    ("range", r"\[.+\s+TO\s+.+\]"),
    ("boolean", r"\b(AND|OR|NOT)\b"),
)
OPERATOR_REWRITES = ((" && ", " AND "), (" || ", " OR "), (" ! ", " NOT "), (" + ", " AND "), (" - ", " NOT "))
# Field names of the index document (for `field:` mentions).
INDEX_FIELDS = ("id", "path", "title", "content", "format", "category", "tags", "created_at", "modified_at",
                "indexed_at", "size", "score", "description", "keywords", "content_hash", "status",
                "path_components", "snippet", "year", "month", "metadata_json")

# --- fixed values: test-table mapping ------------------------------
# doc_id % 6 selects the format and the file extension of a test document.
TEST_FORMATS = ("markdown", "text", "html", "json", "yaml", "code")
TEST_EXTENSIONS = (".md", ".txt", ".html", ".json", ".yaml", ".py")
TEST_EPOCH = "2024-01-01 00:00:00"
# Fixed "now" for every time-relative operator on the test tables.
TEST_AS_OF = "2024-03-01 00:00:00"
