"""Fixed values.

Word lists, extension tables, step tables and text patterns. They decide which names are
found and how files are scored, so they are data, kept together here in plain form.
"""

# Folders that are never analysed.
DEFAULT_IGNORE = ["node_modules", ".git", "dist", "build", "coverage"]

# Directory names that never name a feature.
GENERIC_DIRECTORIES = ["src", "lib", "app", "components", "utils", "helpers", "test", "tests", "__tests__", "bin"]

# Path segments that mark a test file.
TEST_SEGMENTS = ["test", "tests", "__tests__"]

# File names (without extension) that start a program.
ENTRY_NAMES = ["index", "main", "app"]

# Extensions tried, in this order, when an import names no existing file.
IMPORT_EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".py", ".java", ".go"]

# Risk steps per measure: (above this value, points), highest first.
RISK_STEPS = {
    "complexity": [(20, 3), (10, 2), (5, 1)],
    "lines": [(500, 3), (300, 2), (150, 1)],
    "change_frequency": [(0.5, 3), (0.2, 2), (0.1, 1)],
    "contributor_count": [(10, 2), (5, 1)],
    "incoming": [(10, 3), (5, 2), (2, 1)],
}

# Branching words and operators counted as complexity. Word boundaries are spelled out
# because \b is Unicode-aware on the JVM; the leading set only lets other characters fail fast.
COMPLEXITY = (
    r"(?=[iefwsct&|?])(?:(?<![A-Za-z0-9_])(?:if|else|for|while|switch|case|try|catch)(?![A-Za-z0-9_])"
    r"|&&|\|\||(?<!\?)\?(?![.?]))"
)

DEAD_CODE_REASON = "No imports found from other files"
DEAD_CODE_CONFIDENCE = "medium"

# Commit log: git log --name-only --date=iso-strict --pretty=format:%H%x09%an%x09%aI%x09%s
COMMIT_HASH = "^[0-9a-fA-F]{7,64}$"

# Per language: file extensions and, per fact, (pattern, number of capture groups).
# A language without a pattern for a fact yields an empty list for it; "interfaces" and
# "structs" are null for languages that do not list them.
LANGUAGES = {
    "javascript": {
        "extensions": [".js", ".jsx", ".mjs"],
        "imports": (r"""import\s+.*?from\s+['"](.+?)['"]|require\s*\(\s*['"](.+?)['"]\s*\)""", 2),
        "functions": (
            r"function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"
            r"|(?<!\w)(\w++)\s*+:\s*(?:async\s+)?function",
            3,
        ),
        "classes": (r"class\s+(\w+)", 1),
        "exports": (
            r"export\s+(?:default\s+)?(?:class|function|const)\s+(\w+)|module\.exports\s*=\s*(\w+)",
            2,
        ),
    },
    "typescript": {
        "extensions": [".ts", ".tsx"],
        "imports": (r"""import\s+.*?from\s+['"](.+?)['"]|require\s*\(\s*['"](.+?)['"]\s*\)""", 2),
        "functions": (
            r"function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"
            r"|(?<!\w)(\w++)\s*+:\s*(?:async\s+)?function",
            3,
        ),
        "classes": (r"class\s+(\w+)", 1),
        "exports": (r"export\s+(?:default\s+)?(?:class|function|const|interface)\s+(\w+)", 1),
        "interfaces": (r"interface\s+(\w+)", 1),
    },
    "python": {
        "extensions": [".py"],
        "imports": (r"from\s+(\S+)\s+import|import\s+(\S+)", 2),
        "functions": (r"def\s+(\w+)\s*\(", 1),
        "classes": (r"class\s+(\w+)", 1),
    },
    "java": {
        "extensions": [".java"],
        "imports": (r"import\s+([^;]+);", 1),
        "functions": (r"\w\s+(\w+)\s*\([^)]*\)\s*\{", 1),
        # The part of it up to the bracket; regex_extract looks for it between closing brackets.
        "function_header": (r"\w\s+(\w+)\s*\(", 1),
        "classes": (r"class\s+(\w+)", 1),
    },
    "go": {
        "extensions": [".go"],
        # The quoted string after an import, which is the next one in the line; another import starts anew.
        "imports": (r"""import\s++(?:(?:(?!import\s)[^"\n])*+"(.+?)"|"(.+?)")""", 2),
        # What opens a block that runs to the next closing bracket.
        "import_block": (r"import\s*\(\s*([\s\S]*)$", 1),
        "import_block_item": (r'"(.+?)"', 1),
        "functions": (r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", 1),
        "structs": (r"type\s+(\w+)\s+struct", 1),
    },
}

# Languages whose facts come from the lexical patterns of lexical_extract.
LEXICAL_LANGUAGES = ["javascript", "typescript"]
