"""Results are only right with exactly these words, edges and patterns."""

# Words that mark vague or uncertain requirement language.
VAGUE_TERMS = [
    "some", "sometimes", "maybe", "probably", "might", "could", "should",
    "various", "etc", "somehow", "something", "stuff", "things", "issue",
    "problem", "seems", "appears", "possibly", "certain", "appropriate",
    "reasonable", "adequate", "sufficient", "necessary", "relevant",
]

# Words that show a requirement touches a technical domain.
DOMAIN_KEYWORDS = {
    "ui": ["ui", "frontend", "css", "html", "button", "dialog", "render", "display",
           "layout", "component", "view", "style", "theme", "widget"],
    "backend": ["api", "server", "endpoint", "handler", "controller", "service",
                "middleware", "route", "request", "response", "rest", "grpc"],
    "database": ["database", "db", "sql", "query", "table", "schema", "migration",
                 "index", "join", "transaction", "postgres", "mysql", "mongo"],
    "infrastructure": ["docker", "kubernetes", "k8s", "deploy", "ci", "cd", "pipeline",
                       "terraform", "helm", "config", "yaml", "nginx", "cluster"],
    "testing": ["test", "spec", "mock", "fixture", "assert", "coverage", "e2e",
                "integration", "unit", "benchmark"],
    "security": ["auth", "token", "permission", "role", "encrypt", "certificate",
                 "ssl", "tls", "oauth", "rbac", "credential"],
}

# White space, digits and word characters as Python text functions
# see them, spelled out because the Java classes differ. The rare spaces stand in an
# intersection, so that common characters are settled by one lookup.
SPACE = (r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
         r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]")
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"

# What counts as a cross reference. Each pattern is counted on its own.
CROSS_REFERENCE_PATTERNS = [
    f"#{DIGIT}+",
    f"https?://[^{SPACE}]+",
    f"[A-Z]+-{DIGIT}+",
    f"@{WORD}+",
]

# Duration buckets in hours, half open [low, high); the last takes the rest.
PREDICTION_BUCKETS = [
    (0, 8, "< 1 day"),
    (8, 24, "1 day"),
    (24, 72, "1-3 days"),
    (72, 168, "3-7 days"),
    (168, 720, "1-4 weeks"),
    (720, None, "> 4 weeks"),
]

# Finer buckets of the quality report; values outside match none.
QUALITY_BUCKETS = [
    (0, 8, "< 1 day"),
    (8, 24, "1 day"),
    (24, 72, "1-3 days"),
    (72, 168, "3-7 days"),
    (168, 720, "1-4 weeks"),
    (720, 2160, "4-12 weeks"),
    (2160, None, "> 12 weeks"),
]

# Effort tiers by upper bound in hours.
EFFORT_TIERS = [(1, "Trivial"), (4, "Small"), (16, "Medium"), (40, "Large")]
TOP_EFFORT_TIER = "XL"

# Effect sizes by upper bound of the absolute delta.
EFFECT_SIZES = [(0.147, "negligible"), (0.33, "small"), (0.474, "medium")]
TOP_EFFECT_SIZE = "large"

# Task categories offered to people asking for an estimate.
TASK_CATEGORIES = [
    ("bug_fix", "Bug fix", "2–8h"),
    ("documentation", "Documentation", "1–4h"),
    ("refactor", "Refactor / cleanup", "4–16h"),
    ("small_feature", "Small feature", "8–24h"),
    ("test_addition", "Test addition", "2–6h"),
    ("config_change", "Config change", "1–3h"),
]

# Labels that exclude an item, and the default thresholds.
EXCLUDED_LABELS = ["duplicate", "wontfix", "invalid", "question"]
MIN_TEXT_LENGTH = 50
MIN_DURATION_HOURS = 1
MAX_DURATION_DAYS = 90
MIN_REPO_ROWS = 10
TARGET_SAMPLE_SIZE = 500
MIN_CLOSED_ISSUES = 1000
MIN_CONTRIBUTORS = 10
MIN_YEARS = 3
LOOKBACK_DAYS = 90
MAX_FILES_PER_COMMIT = 50
MIN_SUPPORT = 3
SEED = 42
TEST_PERCENT = 20
FOLDS = 5
ALPHA = 0.05
SENSITIVITY_CAPS_DAYS = [14, 30, 60, 90, None]
MIN_SENSITIVITY_ROWS = 50

# Feature columns of the two feature tables.
TEXT_FEATURES = [
    "complexity_score", "cross_ref_density", "ambiguity_index",
    "technical_scope", "text_length", "word_count",
]
HISTORY_FEATURES = [
    "num_files", "fan_in", "fan_out",
    "total_churn_added", "total_churn_deleted", "total_churn_commits",
    "avg_churn_per_file", "change_impact_radius",
    "avg_file_age_days", "min_file_age_days", "max_file_age_days",
    "avg_change_frequency", "max_change_frequency",
]
