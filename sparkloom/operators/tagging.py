"""Tags by keywords and category, and entries that hold several statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bordered

# Keywords of each tag, tags of each category, in the order in which equal confidences are taken.
TAG_KEYWORDS = {
    "typescript": ("typescript", "ts", ".ts", ".tsx", "tsc", "tsconfig"),
    "javascript": ("javascript", "js", ".js", ".jsx", "node", "npm", "yarn", "pnpm"),
    "python": ("python", "py", ".py", "pip", "pytest", "django", "flask", "fastapi"),
    "rust": ("rust", "cargo", ".rs", "rustc", "tokio", "async-std"),
    "go": ("golang", ".go", "go mod", "goroutine"),
    "react": ("react", "jsx", "tsx", "usestate", "useeffect", "component"),
    "vue": ("vue", "vuex", "pinia", "nuxt"),
    "angular": ("angular", "ng", "@angular"),
    "security": ("security", "auth", "authentication", "authorization", "password", "token", "jwt", "oauth", "secret", "encrypt", "hash", "csrf", "xss", "sql injection"),
    "api": ("api", "rest", "graphql", "endpoint", "http", "request", "response", "openapi", "swagger"),
    "database": ("database", "sql", "query", "postgres", "mysql", "sqlite", "mongodb", "redis", "orm", "migration"),
    "testing": ("test", "spec", "coverage", "mock", "stub", "jest", "vitest", "mocha", "pytest", "assert", "expect"),
    "performance": ("performance", "optimize", "fast", "slow", "latency", "cache", "memory", "cpu", "benchmark"),
    "devops": ("docker", "kubernetes", "k8s", "ci/cd", "pipeline", "deploy", "container", "helm", "terraform"),
    "documentation": ("documentation", "docs", "readme", "jsdoc", "docstring", "comment"),
    "architecture": ("architecture", "design", "pattern", "solid", "clean", "layer", "module", "service"),
    "refactoring": ("refactor", "rename", "extract", "inline", "move", "cleanup"),
    "debugging": ("debug", "fix", "bug", "issue", "error", "exception", "stack trace", "breakpoint"),
    "configuration": ("config", "configuration", "settings", "env", "environment", "options"),
    "git": ("git", "commit", "branch", "merge", "rebase", "pull request", "pr"),
    "build": ("build", "compile", "bundle", "webpack", "vite", "esbuild", "rollup"),
    "lint": ("lint", "eslint", "prettier", "format", "style"),
}
CATEGORY_TAGS = {
    "code_style": ("code-style", "conventions"), "security": ("security",), "testing": ("testing",), "performance": ("performance",), "workflow": ("workflow",),
    "decision": ("decision",), "fact": ("architecture",), "context": ("context",), "reference": ("reference",),
    "cli": ("cli", "tooling"), "mcp": ("mcp",), "function": ("function",), "api": ("api",),
}
CATEGORY_CONFIDENCE, LEAST_CONFIDENCE, MOST_TAGS = 0.8, 0.6, 3
# What marks an entry as compound, tried in this order.
COMPOUND = (
    ("rules joined by and", r"(?i)\b(always|never|must|should)\b[^.]*\band\b[^.]*\b(always|never|must|should)\b"),
    ("statements after semicolons", r"[^;]+;[^;]+;"),
    ("separate concern", r"(?i)\.\s*(also|additionally|furthermore)\b"),
    ("sentences of rules", r"(?i)\b(always|never|must|should)\b[^.]*\.\s*\b(always|never|must|should)\b"),
    ("further decision", r"(?i)\.\s*we\s+(also\s+)?(decided|chose|selected|opted|picked)\b"),
    ("enumeration", r"(?i)(^|\s)(1\)|2\)|a\)|b\)|first[,:]|second[,:]).+(2\)|3\)|b\)|c\)|second[,:]|third[,:])"),
)
IMPERATIVES = r"\b(use|avoid|prefer|always|never|must|should|ensure|do|don't|dont)\b"
LONG_ENTRY = 300


def tags(rows: DataFrame) -> DataFrame:
    """(id, tag, confidence, source) of rows (id, content, category): at most three tags each, the surest first.

    A keyword counts once however often it occurs, a phrase twice; a tag's confidence is the count over 30 % of its
    keywords, or over three. Null contents have the tags of their category.
    """
    # each step names what the next one uses many times, so that it is worked out once a row
    rows = rows.select("id", "category", F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    count = lambda keys: sum((F.when(F.contains("low", F.lit(k)), 2 if " " in k else 1).otherwise(0) for k in keys), F.lit(0))
    rows = rows.select("id", "category", F.array(*[count(keys) for keys in TAG_KEYWORDS.values()]).alias("counts"))

    def found(place: int, tag: str, keys: tuple[str, ...]) -> Column:
        sure = F.least(F.lit(1.0), F.get("counts", F.lit(place)) / max(3.0, 0.3 * len(keys)))
        return F.struct((-sure).alias("order"), F.lit(place).alias("place"), F.lit(tag).alias("tag"), sure.alias("confidence"), F.lit("keyword").alias("source"))

    by_word = F.filter(F.array(*[found(k, tag, keys) for k, (tag, keys) in enumerate(TAG_KEYWORDS.items())]), lambda t: t["confidence"] >= LEAST_CONFIDENCE)
    place = 0
    by_category = []
    for category, names in CATEGORY_TAGS.items():
        for name in names:
            given = F.struct(F.lit(-CATEGORY_CONFIDENCE).alias("order"), F.lit(len(TAG_KEYWORDS) + place).alias("place"), F.lit(name).alias("tag"), F.lit(CATEGORY_CONFIDENCE).alias("confidence"), F.lit("category").alias("source"))
            by_category.append(F.when(F.col("category") == category, given))
            place += 1
    cut = rows.select("id", by_word.alias("words"), F.array_compact(F.array(*by_category)).alias("given"))
    new = F.filter("given", lambda g: ~F.exists("words", lambda w: w["tag"] == g["tag"]))
    best = F.slice(F.array_sort(F.concat("words", new)), 1, MOST_TAGS)
    return cut.select("id", F.explode(best).alias("t")).select("id", "t.tag", F.round("t.confidence", 6).alias("confidence"), "t.source")


def imperatives(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(bordered(IMPERATIVES)))


def compound(text: Column, entry_type: Column) -> Column:
    """Why an entry holds several statements; null if it holds one."""
    orders = imperatives(text)
    dense = (F.length(text) > LONG_ENTRY) & (F.regexp_count(text, F.lit(r"[.!?]+")) >= 3) & (orders >= 2)
    return F.coalesce(*[F.when(text.rlike(bordered(p)), name) for name, p in COMPOUND], F.when((entry_type == "guideline") & (orders > 2), "many imperatives"), F.when(dense, "long with imperatives"))
