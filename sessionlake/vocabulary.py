"""Fixed values of the data model: names and limits that results depend on."""

# Event types that the statistics, the transcript and the attribution read.
LLM_RESPONSE = "llm_response"
LLM_ERROR = "llm_error"
TOOL_CALL_EXTRACTED = "tool_call_extracted"
TOOL_CALL_RESULT = "tool_call_result"
SIDE_CALL_SUFFIX = "_invoked"
SUMMARIZATION = "summarization_triggered"

# Fields of an llm_response payload.
TOKENS_IN = "tokens_in"
TOKENS_OUT = "tokens_out"
CACHE_WRITE_TOKENS = "cache_write_tokens"
CACHE_READ_TOKENS = "cache_read_tokens"
COST_INPUT = "cost_input"
COST_OUTPUT = "cost_output"
COST_CURRENCY = "cost_currency"
PRICE = "price"
NATIVE_TOOL_CALLS = "native_tool_calls_raw"

# Field of an llm_error payload, and how an error row reads.
ERROR_EXCERPT = "response_body_excerpt"
ERROR_PREFIX = "[LLM error] "
ERROR_FALLBACK = "[LLM error] The request could not be completed."
ERROR_EXCERPT_MAX_BYTES = 200

# Currency key of a call whose provider names none.
NO_CURRENCY = "none"

# Kind a budget covers when it names none.
DEFAULT_BUDGET_KIND = "chat"

# Call ids the agent makes up for calls that carry none.
MADE_UP_PREFIXES = ("planner-", "pipeline-")
MADE_UP_PATTERN = "^call-[0-9]+$"

# Limits. A value outside is rejected; only a title search is cut.
DEFAULT_LIMIT = 25
MAX_LIMIT = 200
DEFAULT_REPLAY_LIMIT = 200
MAX_REPLAY_LIMIT = 500
MAX_SAMPLE_SESSIONS = 5
MAX_ENTITY_IDS = 200
MAX_TITLE_CHARS = 200
MAX_BUCKETS = {"day": 1200, "week": 520, "month": 120, "year": 20}

# White space trimmed from labels, titles, ids and JSON text (Unicode spaces).
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
