"""Column functions for names, paths and source lines. All are built-in expressions, so Catalyst sees through them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in source text, Unicode's included (fixed value).
WS = r"[\s\x0B   -     　﻿]"
#: A word boundary between ASCII word characters and others (fixed value; the regex engine's own is Unicode-aware).
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Source types and languages by extension (fixed values).
SOURCE_TYPES = {
    "code": ["ts", "tsx", "js", "jsx", "cjs", "mjs", "py", "sh", "bash"],
    "config": ["json", "yaml", "yml", "toml"],
    "query": ["sql", "graphql", "gql"],
    "docs": ["md"],
    "markup": ["html", "xml", "vue", "svelte"],
    "style": ["css", "scss", "less"],
}
LANGUAGES = {
    "javascript": ["js", "jsx", "cjs", "mjs"],
    "typescript": ["ts"],
    "tsx": ["tsx"],
    "python": ["py"],
    "go": ["go"],
    "rust": ["rs"],
    "java": ["java"],
    "csharp": ["cs"],
    "bash": ["sh", "bash"],
    "sql": ["sql"],
    "css": ["css", "scss", "less"],
    "text": ["json", "yaml", "yml", "graphql", "gql", "md", "toml", "xml", "html", "vue", "svelte"],
}
MAX_IDENTIFIER = 256


def trim(c: Column) -> Column:
    """Strips white space at both ends, Unicode's included."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def fold(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def like(c: Column, pattern: str) -> Column:
    """LIKE that ignores ASCII case; % and _ are live and nothing escapes them."""
    return fold(c).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def lines(content: Column) -> Column:
    """Lines split at \\n alone; the empty text has one."""
    return F.split(content, "\n", -1)


def split_words(c: Column) -> Column:
    """Words of a name: cut before each capital and at spaces and underscores, in lower case."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "([A-Z])", " $1"), r"[\s_]+", -1), F.lower), lambda w: w != "")


def query_words(query: str) -> list[str]:
    """The words of a query, by the same cuts."""
    spaced = re.sub(r"([A-Z])", r" \1", query)
    return [w.lower() for w in re.split(r"[\s_]+", spaced) if w]


def identifier_pattern(name: str) -> str:
    """A pattern for a whole identifier; ValueError if empty or longer than MAX_IDENTIFIER."""
    if not isinstance(name, str) or not name:
        raise ValueError("identifier must be a non-empty string")
    if len(name) > MAX_IDENTIFIER:
        raise ValueError(f"identifier is longer than {MAX_IDENTIFIER} characters")
    return BOUNDARY + "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-/" else ch for ch in name) + BOUNDARY


def literal_filter(c: Column, pattern: str, case_sensitive: bool = False, use_regex: bool = False) -> Column:
    """Whether a line holds a literal string. Regular expressions are refused: they could run for ever."""
    if not isinstance(pattern, str) or not pattern:
        raise ValueError("pattern must be a non-empty string")
    if use_regex:
        raise ValueError("regex search is disabled; use a literal pattern")
    return c.contains(pattern) if case_sensitive else F.lower(c).contains(pattern.lower())


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path, or all of it without one."""
    return F.element_at(F.split(path, r"\."), -1)


def _by_extension(ext: Column, table: dict[str, list[str]], other: str) -> Column:
    out = F.lit(other)
    for value, names in table.items():
        out = F.when(ext.isin(*names), F.lit(value)).otherwise(out)
    return out


def source_type(path: Column) -> Column:
    """code, config, query, docs, markup, style, or test: code by its name or directory."""
    base = _by_extension(F.lower(extension(path)), SOURCE_TYPES, "code")
    test = path.rlike(r"\.(test|spec)\.[^.]+\z") | path.rlike(r"(?:^|/)(?:__tests__|__mocks__|__fixtures__|tests?|specs?|mocks?|fixtures?)/")
    return F.when((base == "code") & test, F.lit("test")).otherwise(base)


def language(path: Column) -> Column:
    """The language by extension, in the case given; unknown otherwise."""
    return _by_extension(extension(path), LANGUAGES, "unknown")


def safe_path(c: Column) -> Column:
    """A relative path without traversal or odd characters; ``global`` if nothing is left."""
    parts = F.transform(F.split(c, r"[\\/]+"), lambda p: F.regexp_replace(p, r"[^A-Za-z0-9._-]", "_"))
    parts = F.filter(F.transform(parts, lambda p: F.when(p.isin(".", ".."), F.lit("_")).otherwise(p)), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.lit("global")).otherwise(F.array_join(parts, "/"))


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1; what lies beyond the text is left out."""
    return F.array_join(F.slice(lines(content), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def slug(c: Column) -> Column:
    """A file name for a note's target: path marks, colons and points as dashes, runs of them as one."""
    return F.regexp_replace(F.regexp_replace(c, r"[/:.]", "-"), r"-+", "-")


def iso(at: Column) -> Column:
    """A time as an ISO string in UTC with milliseconds; the session's zone is to be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
