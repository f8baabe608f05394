"""Scalar text rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token estimate and the lexical stop list.
CHARS_PER_TOKEN = 4.0
SAFETY_MARGIN = 1.15
STOPWORDS = (
    "a an and are as at be been but by can could do does doing for from get had has have how i if in into is it "
    "its me my of on or our over should so than that the their them then there these they this those to under up "
    "use used uses using was we were what when where which who why will with would you your"
).split()
TERM_PATTERN = r"[A-Za-z_][A-Za-z0-9_.]*"
IDENTIFIER_LIKE = r"[A-Za-z_][A-Za-z0-9_]*(?:[._][A-Za-z0-9_]+)+|[a-z]+[A-Z]\w*"
TEST_PREFIXES = ("test_", "Test", "test")
TEST_SUFFIXES = ("_test", "Test", "Tests", "Spec")
# Line terminators as str.splitlines understands them.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def estimate_tokens(text: Column) -> Column:
    """Conservative token estimate; double arithmetic, same operation order everywhere."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN) * F.lit(SAFETY_MARGIN)).cast("long")


def split_lines(text: Column) -> Column:
    """Lines without terminators; a trailing terminator adds no empty line."""
    parts = F.split(text, LINE_BREAK)
    trimmed = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.when(F.element_at(parts, -1) == "", trimmed).otherwise(parts)


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def first_line(text: Column, width: int) -> Column:
    return F.substring(F.element_at(F.split(text, LINE_BREAK), 1), 1, width)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signature_text(raw: Column) -> Column:
    """Header of a definition: one line, no trailing opening brace."""
    return F.trim(F.regexp_replace(collapse_whitespace(raw), r"\{+$", ""))


def module_of(path: Column) -> Column:
    """First two segments when the path is deeper than two, else the first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return (
        F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, 1, 2)))
        .when(F.size(parts) > 0, F.get(parts, F.lit(0)))
        .otherwise(path)
    )


def module_key(path: Column) -> Column:
    """Dotted path without its last extension."""
    return F.translate(F.regexp_replace(path, r"\.[^.]*$", ""), "/", ".")


def last_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def symbol_id(repo: Column, path: Column, local_qname: Column) -> Column:
    return F.concat_ws(":", repo, path, local_qname)


def qualified_name(path: Column, local_qname: Column) -> Column:
    """Dotted address; a file named after its type does not repeat the segment."""
    module = module_key(path)
    head = F.substring_index(local_qname, ".", 1)
    repeated = F.endswith(module, F.concat(F.lit("."), head))
    base = F.when(repeated, F.left(module, F.length(module) - F.length(head) - 1)).otherwise(module)
    return F.when(base == "", local_qname).otherwise(F.concat_ws(".", base, local_qname))


def local_qname(parent: Column, name: Column) -> Column:
    return F.concat_ws(".", parent, name)


def is_constant_name(name: Column) -> Column:
    return (name == F.upper(name)) & (name != F.lower(name)) & (F.length(name) > 1)


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']+|[\"']+$", "")


def strip_test_affix(name: Column) -> Column:
    """Production name a test name points at; the first matching rule wins."""
    out = None
    for prefix in TEST_PREFIXES:
        hit = F.startswith(name, F.lit(prefix)) & (F.length(name) > len(prefix))
        rest = F.regexp_replace(F.substring(name, len(prefix) + 1, 1 << 20), "^_+", "")
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    for suffix in TEST_SUFFIXES:
        hit = F.endswith(name, F.lit(suffix)) & (F.length(name) > len(suffix))
        out = out.when(hit, F.left(name, F.length(name) - len(suffix)))
    return out.otherwise(name)


def lexical_terms(query: Column) -> Column:
    """Words worth matching exactly: no filler, nothing of two characters or fewer."""
    raw = F.regexp_extract_all(query, F.lit(TERM_PATTERN), F.lit(0))
    return F.filter(raw, lambda t: ~F.lower(t).isin(STOPWORDS) & (F.length(t) > 2))


def identifier_like(query: Column) -> Column:
    return F.coalesce(query.rlike(IDENTIFIER_LIKE), F.lit(False))


def relevance_label(score: Column, reason: Column) -> Column:
    label = F.concat(F.lit("relevance "), F.format_string("%.2f", score))
    return F.when(F.coalesce(reason, F.lit("")) == "", label).otherwise(F.concat_ws(" | ", label, reason))


def hop_label(hops: Column) -> Column:
    return F.concat(hops.cast("string"), F.when(hops > 1, F.lit(" hops")).otherwise(F.lit(" hop")))


def card_location(path: Column, start: Column, end: Column, extra: Column, hidden: Column) -> Column:
    """Where a card points: bare path, list of collapsed lines, a range or one line."""
    shown = F.concat_ws(
        ",", F.concat(F.array(start.cast("string")), F.transform(extra, lambda n: n.cast("string")))
    )
    tail = F.when(hidden > 0, F.concat(F.lit(" (+"), hidden.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return (
        F.when(start == 0, path)
        .when(F.size(extra) > 0, F.concat(path, F.lit(":"), shown, tail))
        .when((end != 0) & (end != start), F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
        .otherwise(F.concat(path, F.lit(":"), start.cast("string")))
    )


def card_text(qname: Column, signature: Column, location: Column, reason: Column, placement: Column,
              inline_body: Column) -> Column:
    """Rendered card; empty parts leave no line behind."""

    def line(prefix: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value))

    titled = F.coalesce(qname, F.lit("")) != ""
    bits = F.concat_ws(" | ", line("", reason), line("", placement))
    body = F.array_join(F.transform(split_lines(inline_body), lambda s: F.concat(F.lit("    "), s)), "\n")
    return F.concat_ws(
        "\n",
        F.when(titled, qname).otherwise(location),
        line("  ", signature),
        F.when(titled, F.concat(F.lit("  "), location)),
        line("  <- ", bits),
        line("", body),
    )
