"""Fixed values that must equal the reference's for identical results.

Everything in this module is data, listed plainly and in natural order.
"""

# --- fixed values: supported language codes and display names (30 entries) ---
LANGUAGES = [
    ("en", "English"),
    ("es", "Spanish"),
    ("fr", "French"),
    ("de", "German"),
    ("it", "Italian"),
    ("pt", "Portuguese"),
    ("pt-BR", "Portuguese (Brazil)"),
    ("nl", "Dutch"),
    ("pl", "Polish"),
    ("ru", "Russian"),
    ("zh", "Chinese"),
    ("zh-CN", "Chinese (Simplified)"),
    ("zh-TW", "Chinese (Traditional)"),
    ("ja", "Japanese"),
    ("ko", "Korean"),
    ("ar", "Arabic"),
    ("hi", "Hindi"),
    ("tr", "Turkish"),
    ("vi", "Vietnamese"),
    ("th", "Thai"),
    ("sv", "Swedish"),
    ("da", "Danish"),
    ("fi", "Finnish"),
    ("no", "Norwegian"),
    ("cs", "Czech"),
    ("el", "Greek"),
    ("he", "Hebrew"),
    ("id", "Indonesian"),
    ("uk", "Ukrainian"),
    ("ro", "Romanian"),
]
LANGUAGE_CODES = [c for c, _ in LANGUAGES]

# --- fixed values: provider catalogue (name, default model, masks glossary terms) ---
PROVIDERS = [
    ("openai", "gpt-4o-mini", True),
    ("openrouter", "openai/gpt-4o-mini", True),
    ("anthropic", "claude-3-5-sonnet-20241022", True),
    ("deepl", "", False),
    ("google", "gemini-1.5-flash", True),
    ("ollama", "llama3.1", True),
    ("libretranslate", "", False),
    ("custom", "default", True),
]
PROVIDER_NAMES = [p for p, _, _ in PROVIDERS]

# --- fixed values: confidences of the non-LLM providers ---
FIXED_CONFIDENCE = {"deepl": 0.92, "libretranslate": 0.75}

# --- fixed values: operator defaults ---
MAX_TEXT_LENGTH = 10000
MAX_BATCH_ITEMS = 50
DEFAULT_TTL = "24h"
DEFAULT_TTL_SECONDS = 24 * 3600
BACKFILL_TTL_SECONDS = 3600
TM_THRESHOLD = 0.8
TM_CONTAINED_SCORE = 0.95
DEFAULT_PROVIDER = "openai"
L1_MAX_ENTRIES = 10000
BREAKER_FAILURES = 5
BREAKER_COOLDOWN_SECONDS = 30
RATE_PER_SECOND = 100.0
RATE_BURST = 20
MOCK_CONFIDENCE = 0.9
UNPARSED_CONFIDENCE = 0.5
DEEPL_DETECT_CONFIDENCE = 0.95

# --- fixed values: latency histogram upper bounds in seconds (+Inf appended) ---
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# --- fixed values: error texts ---
ERR_INVALID_INPUT = "invalid input"
ERR_PROVIDER_UNAVAILABLE = "provider unavailable"
ERR_RATE_LIMITED = "rate limited"
ERR_NOT_FOUND = "not found"
ERR_EMPTY_TEXT = "invalid input: text is empty"
ERR_TOO_LONG = "invalid input: text exceeds max length"
ERR_INVALID_JSON = "invalid input: invalid json"
ERR_EMPTY_TRANSLATION = "empty translation"
ERR_DOCUMENT_FIELDS = "invalid input: content, format and target_language required"

# --- fixed values: patterns that split documents and find a JSON block (Java-compatible as written) ---
JSON_BLOCK_RE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
FENCE_RE = r"(?s)(```(?:[^\n]*\n)?(.*?)```)"
TAG_RE = r"(<[^>]+>)"

# --- fixed values: prompt fragments ---
PROMPT_INTRO = "You are a professional translator. Translate the following text accurately into "
PROMPT_CONTEXT = "Context: "
PROMPT_TONE = "Tone: "
PROMPT_PLACEHOLDERS = "Preserve the following placeholders exactly as they appear and do not translate them: "
PROMPT_RETURN = (
    "Return ONLY a JSON object with keys: translation (string), source_language (string), "
    "confidence (number 0-1)."
)
PROMPT_ALTERNATIVES = " Also include alternatives (array of strings)."
PROMPT_TEXT = "\n\nText: "
PLACEHOLDER_PREFIX = "__TERM_"
PLACEHOLDER_SUFFIX = "__"

# --- fixed values: document formats ---
DOCUMENT_FORMATS = ["markdown", "plain", "json", "html", "xml"]
