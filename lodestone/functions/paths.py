"""Languages, test files and excluded directories, as expressions over a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.scalars import base_name, extension

# File extensions by language.
EXTENSIONS = {
    "c": "c", "cc": "cpp", "cjs": "javascript", "cpp": "cpp", "cxx": "cpp", "f": "fortran", "f03": "fortran", "f08": "fortran", "f77": "fortran", "f90": "fortran", "f95": "fortran", "for": "fortran", "ftn": "fortran",
    "h": "cpp", "cs": "csharp", "hpp": "cpp", "hxx": "cpp", "js": "javascript", "mjs": "javascript", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx",
    "html": "html", "htm": "html", "md": "markdown", "mdx": "markdown", "astro": "astro", "css": "css", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
}
# Directories that are left out.
EXCLUDED = ("node_modules", "vendor", ".git", "__pycache__", "target", "dist", "build", ".venv")
# What makes a file a test.
TEST_DIRS = ("tests", "test", "__tests__", "spec")
TEST_NAMES = r"^(test_.*\.(?i:rs|py)|Test.*\.(?i:java))$|(_test\.(rs|py|go)|Test\.java|\.(test|spec)\.(ts|js))$"


def language_of(path: Column) -> Column:
    """By extension in any case, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, F.coalesce(extension(path), F.lit("")))


def language_label(path: Column) -> Column:
    """The language, else the extension, else ``unknown``."""
    return F.coalesce(language_of(path), extension(path), F.lit("unknown"))


def is_excluded(path: Column) -> Column:
    """P4."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))


def is_test(path: Column) -> Column:
    """A test directory in the path, or a test's file name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_DIRS))) | base_name(path).rlike(TEST_NAMES)


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path that are directories."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
