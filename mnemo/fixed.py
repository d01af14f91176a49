"""Behaviour that must match the memory service this engine
re-implements. Everything else in the package is derived from these."""

# Search defaults and limits.
DEFAULT_LIMIT = 10
MAX_LIMIT = 200
LEGACY_DEFAULT_LIMIT = 50
DEFAULT_DEPTH = 1
DEFAULT_ORDER_PROPERTY = "created_at"
DEFAULT_ORDER_DESCENDING = True

# Accepted ``order_by`` text (case-insensitive, whole string).
ORDER_BY_REGEX = r"(memory\.|n\.)?([a-zA-Z_]+)\s+(ASC|DESC)"
LEGACY_ORDER_BY_REGEX = r"(n\.)?([a-zA-Z_]+)\s+(ASC|DESC)"

# Properties the fallback phrase search looks at.
PHRASE_FIELDS = ["name", "context", "description"]

# Operation names.
TOOLS = ["search_memories", "create_memory", "create_connection", "update_memory", "update_connection",
         "delete_memory", "delete_connection", "list_memory_labels", "get_guidance"]

# Error texts.
INVALID_ARGUMENTS = "Invalid {name} arguments"
UNKNOWN_TOOL = "Unknown tool: {name}"
SOURCE_NOT_FOUND = "Source memory '{ref}' not found"
TARGET_NOT_FOUND = "Target memory '{ref}' not found"
INVALID_ORDER_BY = 'Invalid order_by format. Use "property ASC" or "property DESC"'

# Legacy ``remember`` link type.
RELATES_TO = "RELATES_TO"

# Timestamp text (JavaScript ``toISOString``), as a Spark pattern.
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

# JavaScript whitespace (``\s``, used by ``trim`` and
# ``split(/\s+/)``): tab, line feed, vertical tab, form feed, carriage
# return, space, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F,
# U+205F, U+3000, U+FEFF.
JS_WS_CLASS = "[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# The same class written for Java's regex engine (Spark's split/regexp_*).
JAVA_WS_CLASS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
