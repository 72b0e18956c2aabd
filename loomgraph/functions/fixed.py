"""Word lists, patterns and limits that define the results.

These are data, not logic. They have to be exactly what they are for the
classification, extraction and ranking results to come out right.
"""

# --- Fixed values: file classification --------------------------------------
CODE_EXTENSIONS = (
    ".py .ts .tsx .mts .cts .js .jsx .mjs .go .rs .java .c .h .cpp .hpp .cc .cxx "
    ".rb .php .cs .kt .scala .swift .lua .sh .bash .sql .json .yaml .yml .toml"
).split()
DOC_EXTENSIONS = ".md .mdx .qmd .txt .rst .html".split()
PAPER_EXTENSIONS = ".pdf".split()
IMAGE_EXTENSIONS = ".png .jpg .jpeg .gif .webp .svg".split()

SKIP_DIRS = (
    "venv .venv env .env node_modules __pycache__ .git dist build target out site-packages "
    ".pytest_cache .mypy_cache .ruff_cache .tox .nox .eggs "
    ".next .nuxt .turbo .svelte-kit .idea .cache .worktrees __snapshots__"
).split()
SKIP_DIR_SUFFIXES = ["_venv", "_env", ".egg-info"]
SKIP_FILES = (
    "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock "
    "Gemfile.lock composer.lock go.sum uv.lock"
).split()
IGNORE_FILES = [".gitignore", ".loomignore"]
VCS_MARKERS = [".git", ".hg", ".svn"]

SENSITIVE_DIRS = ".ssh .gnupg .aws .gcloud secrets .secrets credentials".split()
SENSITIVE_NAME_PATTERNS = [
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$",
]
SENSITIVE_KEYWORDS = [
    r"(?<![a-zA-Z0-9])(?:credential|secret|passwd|password|private_key|creds|api_key|apikey|auth_key)s?(?![a-zA-Z])",
    r"(?<![a-zA-Z0-9])tokens?(?![a-zA-Z])",
]
SHORT_STEM_WORDS = 2

PAPER_SIGNALS = [
    r"(?i)\barxiv\b",
    r"(?i)\bdoi\s*:",
    r"(?i)\babstract\b",
    r"(?i)\bproceedings\b",
    r"(?i)\bjournal\b",
    r"(?i)\bpreprint\b",
    r"\\cite\{",
    r"\[\d+\]",
    r"\d{4}\.\d{4,5}",
]
PAPER_SIGNAL_THRESHOLD = 3

WARN_EMPTY = "nothing to index here"
WARN_SMALL = "few files: expect structure from the graph rather than savings"
SMALL_CORPUS_WORDS = 5000
SMALL_CORPUS_FILES = 6

# --- Fixed values: extraction -------------------------------------------------
GRAMMAR_BY_EXTENSION = {
    ".py": "python", ".pyw": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".go": "go",
    ".rs": "rust",
}
MARKDOWN_EXTENSIONS = [".md", ".mdx", ".qmd"]
MANIFEST_NAMES = ["pyproject.toml", "package.json", "go.mod"]

BUILTIN_CALLS = (
    "str int float bool bytes list dict set tuple len print range enumerate zip map filter open "
    "isinstance issubclass type super abs min max sum any all sorted reversed round repr hash id iter "
    "next getattr setattr hasattr delattr vars dir callable "
    "Exception BaseException ValueError TypeError KeyError IndexError AttributeError RuntimeError "
    "StopIteration OSError IOError ImportError NotImplementedError NameError LookupError "
    "console window document require module exports process "
    "Array Object String Number Boolean Promise Map Set JSON Math Date Error TypeError_JS RegExp Symbol"
).split()

# --- Fixed values: resolution and ranking ---------------------------------------
SYMBOL_FILE_SUFFIXES = [".py", ".js", ".ts", ".tsx", ".java", ".go", ".rs"]
CALL_SCORE = 0.85
CALL_WEIGHT = 0.85
DEFAULT_EDGE_SCORE = 0.75
DEFAULT_REPORT_SCORE = 0.5

MERGE_THRESHOLD = 0.92
MERGE_BLOCK_CHARS = 4
MERGE_MIN_CHARS = 3

BUILTIN_NOISE_LABELS = (
    "str int float bool bytes bytearray complex object True False Path Any Optional List Dict Set Tuple "
    "Union Callable Type ClassVar Final Literal Protocol os sys re json io abc typing"
).split()
JSON_NOISE_LABELS = (
    "start end name id type properties value key data items title description version dependencies"
).split()
LANGUAGE_FAMILY = {
    ".py": "python", ".pyw": "python",
    ".js": "js", ".jsx": "js", ".mjs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js",
    ".go": "go",
    ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "c", ".cc": "c", ".cxx": "c", ".hpp": "c",
}
CONFIDENCE_RANK = {"AMBIGUOUS": 0, "INFERRED": 1, "EXTRACTED": 2}

AFFECTED_RELATIONS = (
    "calls indirect_call references imports imports_from re_exports inherits extends implements uses "
    "mixes_in embeds contains method"
).split()
QUESTION_STOP_WORDS = (
    "what which how does do the a an is are in on of to and or for with connects "
    "between from this that it its show me explain"
).split()
EXACT_HIT = 5.0
PARTIAL_HIT = 2.0
QUERY_BUDGET = 60


# --- Fixed values: communities ----------------------------------------------------
LOUVAIN_THRESHOLD = 1e-4
SPLIT_RESOLUTION = 2.0
MAX_COMMUNITY_FRACTION = 0.25
MIN_SPLIT_SIZE = 10

# --- Fixed values: labels, file-type synonyms, prices --------------------------------
FILE_TYPE_SYNONYMS = {
    "document": "document", "markdown": "document", "text": "document", "doc": "document",
    "image": "image",
    "code": "code", "source": "code", "tool": "code", "library": "code",
    "concept": "concept", "pattern": "concept", "principle": "concept", "tech": "concept",
    "technology": "concept", "framework": "concept",
    "rationale": "rationale", "note": "rationale",
    "paper": "paper",
}
PRICES = [  # (model prefix, $ per 1M prompt tokens, $ per 1M completion tokens), first match wins
    ("gpt-4.1-mini", 0.40, 1.60),
    ("gpt-4.1", 2.00, 8.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("google/gemini-2.0-flash-001", 0.10, 0.40),
    ("gemini-2.0-flash", 0.10, 0.40),
    ("deepseek", 0.27, 1.10),
    ("llama-3.1-8b-instant", 0.05, 0.08),
    ("meta-llama/Llama-3.3-70B", 0.88, 0.88),
]
CHARS_PER_TOKEN = 4
SEMANTIC_TOKEN_BUDGET = 60_000
SEMANTIC_RELATIONS = ["references", "semantically_similar_to"]

# --- Fixed values: raw-file tools -------------------------------------------------------
RAW_IGNORE_DIRS = (
    "node_modules .git .venv venv __pycache__ dist build .mypy_cache .pytest_cache .ruff_cache "
    ".idea .vscode"
).split()
