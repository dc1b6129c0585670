"""Fixed values that decide results: word lists, patterns, limits."""

from __future__ import annotations

# Fixed values, in natural order.
VENDOR_DIRS = ("node_modules", "vendor", "third_party", ".venv", "site-packages", "dist", "build", ".next", ".cache", ".turbo", ".parcel-cache")
DENY_GLOBS = ("**/.git/**", "**/.hg/**", "**/.svn/**", "**/*.lock")
#: The same for files at the root, which the globs above don't reach.
DENY_ROOT_GLOBS = (".git/**", ".hg/**", ".svn/**", "*.lock")
ALLOW_GLOBS = ("**",)
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_PARSE_BYTES = 50 * 1024 * 1024
MINIFIED_SUFFIXES = (".min.js", ".bundle.js", ".min.jsx")
MINIFIED_SAMPLE, MINIFIED_LINE = 200_000, 240
GENERATED_MARKERS = ("@generated", "@auto-generated", "autogenerated", "codegen", "do not edit")
GENERATED_SAMPLE = 16_384
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
BINARY_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".bin", ".app", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".jpg", ".jpeg",
    ".png", ".gif", ".bmp", ".tiff", ".webp", ".ico", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".mp3", ".wav", ".ogg", ".pdf", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".ttf", ".otf", ".woff", ".woff2", ".db", ".sqlite", ".sqlite3", ".pyc", ".pyo", ".class", ".dex",
)
STORE_PATTERNS = (
    r"[\"']([A-Za-z0-9+/]{32,}={0,2})[\"']",
    r"[\"']([A-Fa-f0-9]{32,})[\"']",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
)
EFFECT_PATTERNS = (
    r"[\"']([A-Za-z0-9+/]{40,}={0,2})[\"']",
    r"[\"']([A-Fa-f0-9]{40,})[\"']",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
)
CAPTURE_PATTERNS = (r"[A-Za-z0-9_\-+/]{40,}={0,2}", r"[A-Fa-f0-9]{40,}")
PREVIEW_CHARS, PREVIEW_LARGE_CHARS, LARGE_FILE = 200, 100, 1_000_000
SQL_OPS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TRUNCATE")
HTTP_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
PY_KEYWORDS = ("if", "elif", "else", "for", "while", "try", "except", "finally", "return", "break", "continue", "match", "case", "async", "await", "yield")
JS_KEYWORDS = ("if", "else", "for", "while", "do", "try", "catch", "finally", "return", "break", "continue", "switch", "case", "default", "async", "await", "yield")
LABEL_KEYWORDS = ("if", "elif", "else", "case", "default", "except", "catch")
JUMP_KEYWORDS = ("return", "break", "continue")
PY_EFFECT_TOKENS = ("open", "requests", "session", "execute", "cursor", "subprocess", "publish", "send", "enqueue", "s3", "redis", "gcs")
JS_EFFECT_TOKENS = ("fetch", "axios", "fs", "exec", "child_process", "producer", "consumer")
PATH_TOKENS = ("path", "url", "uri", "host", "route", "bucket", "topic", "queue", "table", "sql")
CAPTURE_KINDS = {
    "def.func": ("Function", "function"),
    "def.method": ("Method", "method"),
    "def.class": ("Class", "class"),
    "def.arrow": ("Function", "arrow_function"),
    "def.var_func": ("Function", "function_expression"),
    "def.method_sig": ("Method", "method_signature"),
    "call.expr": ("Call", "call"),
    "call.new": ("Call", "constructor_call"),
    "call.constructor": ("Symbol", "constructor_name"),
    "call.method": ("Symbol", "method_name"),
    "call.func": ("Symbol", "function_name"),
    "call.callee": ("Symbol", "callee_name"),
    "import.stmt": ("Import", "import"),
    "import.from": ("Import", "import_from"),
    "import.module": ("Symbol", "import_module"),
    "import.source": ("Symbol", "import_source"),
    "import.named": ("Symbol", "import_named"),
    "import.default": ("Symbol", "import_default"),
    "import.alias": ("Symbol", "import_alias"),
    "export.stmt": ("Export", "export"),
    "lit.string": ("Literal", "string"),
    "lit.template": ("TemplatePart", "template"),
}
CAPTURE_CAP = 10_000
BLOCK_CAP, FACT_CAP, FOLD_DEPTH, TYPE_CAP = 2000, 512, 6, 32
LONG_LINE, LONG_LINES, DENSE_CHARS, DENSE_SHARE = 2000, 200, 1000, 0.05
NESTING_DEPTH, NESTING_CHARS = 2000, 10_000
ARRAY_COMMAS, ARRAY_CHARS = 5000, 20_000
SARIF_LEVELS = {"ERROR": "error", "WARN": "warning"}
