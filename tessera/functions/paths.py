"""Predicates and labels for file paths and identifiers. Several tests for test files differ on purpose: each operator has its own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns by which operators tell test files, fixtures and sources.
TEST_FILE = r"\.(test|spec)\.[jt]sx?$|((^|[/\\])tests?[/\\]|__tests__[/\\]).*(?i:\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|java|php|rs))$|_test\.(go|py|rb|rs|java|php)$|(^|/)test_[^/]*\.py$"
TEST_FILE_SHOWN = r"\.(test|spec)\.[jt]sx?$|^tests?[/\\]|__tests__[/\\]|_test\.(go|py|rb|rs|java|php)$|(^|/)test_[^/]*\.py$"
CODE_FILE = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|java|php|rs)$"
TEST_FILE_STORED = r"[/\\]tests?[/\\]|\.(?i:test|spec)\."
FIXTURE = r"(^|[/\\])fixtures[/\\]"
SKIPPED = r"(^|/)(node_modules|dist|build|coverage|__pycache__|\.venv|\.git)/"
SOURCE_FILE = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|rb|php|java|vue)$"
TEST_LIKE = ("%/test/%", "%/tests/%", "test/%", "tests/%", "%__tests__%", "%.test.%", "%.spec.%")
IMPACT_LIKE = ("%/test/%", "%.test.%", "%.spec.%")
IMPORT_LINE = r"^(import\s|from\s|require\(|use\s|include\s|require_relative|require\s)"
DEFINITION_LINE = r"^(export\s+)?(async\s+)?(function|class|interface|type|enum|struct|trait|const|let|var|def|fn|pub\s+fn|pub\s+struct|pub\s+enum|module)\s"
FRAMEWORK_LIKE = (
    *(f"{root}{p}" for p in ("app/%/page.%", "app/%/layout.%", "app/page.%", "app/layout.%", "app/%/loading.%", "app/%/error.%", "app/%/not-found.%", "app/%/template.%", "app/%/global-error.%", "app/%/default.%", "app/api/%/route.%", "app/%/route.%", "src/routes/+page.%", "src/routes/+layout.%", "api/%") for root in ("", "%/")),
    "jest.config.%", "%/alembic/versions/%", "%/migrations/%",
)
FRAMEWORK_NAMES = ("generateStaticParams", "metadata", "generateMetadata", "viewport", "generateViewport", "revalidate", "dynamic", "fetchCache", "runtime", "preferredRegion", "maxDuration")
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "java": "java", "go": "go", "rs": "rust",
    "php": "php", "rb": "ruby", "vue": "vue", "html": "html", "css": "css", "md": "markdown",
}


def any_like(path: Column, patterns: tuple[str, ...]) -> Column:
    """LIKE without regard to case, in which _ stands for any character."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.ilike(p)
    return out


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_test_file_shown(path: Column) -> Column:
    return path.rlike(TEST_FILE_SHOWN)


def is_test_file_stored(path: Column) -> Column:
    return path.rlike(CODE_FILE) & path.rlike(TEST_FILE_STORED)


def is_test_plan_file(path: Column) -> Column:
    return path.contains("/test/") | path.contains(".test.") | path.contains(".spec.")


def is_fixture_or_test(path: Column) -> Column:
    return is_test_file(path) | path.rlike(FIXTURE)


def is_non_source(path: Column) -> Column:
    return path.rlike(SKIPPED) | ~path.rlike(SOURCE_FILE)


def is_framework_entry(path: Column, name: Column) -> Column:
    return any_like(path, FRAMEWORK_LIKE) | (any_like(path, ("app/%", "%/app/%")) & name.isin(*FRAMEWORK_NAMES))


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def area(path: Column) -> Column:
    """Second segment of paths under src (if there are three), else the first; root for a bare name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, "root").when(parts[0] == "src", F.when(F.size(parts) > 2, parts[1]).otherwise("root")).otherwise(parts[0])


def directory_segment(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise("root")


def resolution_state(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "resolved").when(confidence >= 0.7, "probable").otherwise("ambiguous")


def redact(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, "****").otherwise(F.concat(F.substring(secret, 1, 2), F.lit("****"), F.right(secret, F.lit(2)), F.lit(" [redacted]")))


def glob_to_regex(glob: str) -> str:
    """A Java pattern without regard to case: ** crosses folders, * and ? stay in words, {a,b} is a choice; braces without a comma are literal."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**", at):
            out.append(".*")
            at += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append(".")
        elif c == "{" and re.match(r"\{[^{}]*(\{[^{}]*\}[^{}]*)*\}", glob[at:]) and "," in glob[at:].split("}")[0]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        at += 1
    return f"(?i)^{''.join(out)}$"


def is_safe_regex(pattern: str) -> bool:
    """Whether a user's pattern is free of known causes of exponential matching; callers treat others as without matches."""
    if len(pattern) > 200 or re.search(r"[+*}]\)?[+*{]", pattern) or re.search(r"\([^)]*(\||\\[1-9])[^)]*\)[+*{]", pattern):
        return False
    depth = most = 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        most = max(most, depth)
    return most <= 3


def is_safe_pattern(pattern: Column) -> Column:
    """is_safe_regex of a column of patterns; null is not safe."""
    known = pattern.rlike(r"[+*}]\)?[+*{]") | pattern.rlike(r"\([^)]*(\||\\[1-9])[^)]*\)[+*{]")
    marks = F.split(F.regexp_replace(pattern, r"[^()]", ""), "")
    step = lambda at, c: F.struct((at["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), F.greatest(at["most"], at["depth"] + F.when(c == "(", 1).otherwise(0)).alias("most"))
    most = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step)["most"]
    return F.coalesce((F.length(pattern) <= 200) & ~known & (most <= 3), F.lit(False))
