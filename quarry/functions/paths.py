"""Path classification as Columns: language, test code, ignore rules."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension tables, ignore lists and test markers.
CODE_EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript",
    ".jsx": "javascript", ".mjs": "javascript", ".go": "go", ".java": "java", ".rs": "rust",
}
DATA_EXTENSIONS = {
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".ini": "ini", ".cfg": "ini",
    ".conf": "ini", ".env": "ini", ".sql": "sql", ".properties": "ini",
}
TYPED_LANGUAGES = ("python", "typescript", "tsx", "go", "java", "rust")
IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "dist", "build", "target", "out", ".next", ".nuxt", ".cache", "vendor",
    "third_party", "site-packages", ".tox", ".gradle", ".idea", ".vscode", "coverage", "htmlcov",
)
IGNORED_GLOBS = (
    "*.min.js", "*.min.css", "*.map", "*.lock", "*.sum", "package-lock.json", "yarn.lock", "poetry.lock",
    "uv.lock", "Cargo.lock", "*.pb.go", "*_pb2.py", "*.generated.*", "*.g.dart",
)
TEST_DIRS = ("/tests/", "/test/", "/__tests__/", "/spec/", "src/test/java/", "/testing/")
TEST_NAMES = ("test_", "_test.", ".test.", ".spec.", "test.java", "tests.java", "_spec.")
MAX_FILE_BYTES = 1_000_000


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; a leading-dot name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def code_language(path: Column) -> Column:
    return _lookup(CODE_EXTENSIONS, extension(path))


def data_language(path: Column) -> Column:
    return _lookup(DATA_EXTENSIONS, extension(path))


def is_test_path(path: Column) -> Column:
    """Substring rule on the lower-cased path, so `latest_news.py` counts as test code too."""
    dirs = "|".join(re.escape(d) for d in TEST_DIRS)
    names = "|".join(re.escape(n) for n in TEST_NAMES)
    lowered = F.concat(F.lit("/"), F.lower(path))
    return lowered.rlike(dirs) | F.lower(file_name(path)).rlike(names)


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def glob_regex(pattern: str) -> str | None:
    """One ignore-file pattern as a regular expression over a relative path."""
    body = pattern.rstrip()
    if body.startswith("!"):
        body = body[1:]
    if not body or body.startswith("#"):
        return None
    only_dir = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    pieces = re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", body)
    rules = {"**/": "(?:.+/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = []
    for piece in pieces:
        if piece in rules:
            out.append(rules[piece])
        elif piece.startswith("[") and piece.endswith("]"):
            out.append("[" + piece[1:-1].replace("!", "^", 1) + "]" if piece[1:2] == "!" else piece)
        else:
            out.append(re.escape(piece.replace("\\", "")))
    return ("^" if anchored else "^(?:.+/)?") + "".join(out) + ("/.*$" if only_dir else "(?:/.*)?$")


def ignored_by(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Ignore-file verdict; the last matching pattern decides, `!` re-includes.

    Neighbouring patterns of one sign cannot contradict each other, so each such run is one regular expression.
    """
    rules = [(glob_regex(p), not p.lstrip().startswith("!")) for p in patterns]
    verdict = None
    for ignored, run in groupby(reversed([r for r in rules if r[0]]), key=lambda r: r[1]):
        hit = path.rlike("|".join(regex for regex, _ in run))
        verdict = F.when(hit, F.lit(ignored)) if verdict is None else verdict.when(hit, F.lit(ignored))
    return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))
