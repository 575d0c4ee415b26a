"""Scalar functions over texts and paths, as Spark columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}\x{3000}]"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def unified_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def lines_of(text: Column) -> Column:
    """Lines as an array; a newline at the end makes no empty last line, and an empty text has none."""
    return F.filter(F.split(F.regexp_replace(unified_newlines(text), r"\n\z", ""), "\n", -1), lambda x, i: (i > 0) | (F.length(unified_newlines(text)) > 0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\u00a0\u3000"))


def cut_bytes(text: Column, size: int) -> Column:
    """The first bytes of a text; a character that they part is shown as U+FFFD."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.make_valid_utf8(F.substring(text.cast("binary"), 1, size).cast("string")))


def duplicate_key(line: Column) -> Column:
    """Trimmed, white space collapsed, lower case, then without six marks, and trimmed once more."""
    return trimmed(F.translate(F.lower(F.regexp_replace(trimmed(line), rf"{SPACE}+", " ")), "`*_>#-", ""))


def literally(term: str) -> str:
    """A pattern for the term itself."""
    return "".join(f"\\{c}" if c in r".^$*+?{}[]|()\/" else c for c in term)


def any_term(lowered: Column, terms: Iterable[str]) -> Column:
    """Whether one of the terms is there: with ASCII word bounds if it is of ASCII characters, else anywhere. A pattern begins
    with its term and looks behind from the term's end, so at all other places its first character already fails; a text
    that doesn't contain the term isn't searched by it."""
    found = []
    for t in terms:
        bounded = f"{literally(t)}(?<![a-z0-9_]{literally(t)})(?![a-z0-9_])"
        found.append(lowered.contains(t) & lowered.rlike(bounded) if t.isascii() else lowered.contains(t))
    return any_of(found)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """From the last dot of the name on, in lower case; of a dotfile its whole name."""
    return F.lower(F.regexp_extract(file_name(path), r"\.[^.]*$", 0))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.lower(file_name(path)), r"\.[^.]*$", "")


def directories(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def path_terms(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "[^a-z0-9]+", -1), lambda x: x != "")


def mapped(key: Column, values: Mapping[str, str]) -> Column:
    """values[key], null without."""
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), list(values.items())[1:], F.when(key == next(iter(values)), values[next(iter(values))]))


def normalized_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem(path), "^test_", ""), "_test$", "")


def is_test_path(path: Column) -> Column:
    from quillmere.functions.catalogs import TEST_DIRS

    name, s = F.lower(file_name(path)), stem(path)
    in_dir = F.arrays_overlap(F.transform(directories(path), F.lower), F.array(*map(F.lit, TEST_DIRS)))
    return in_dir | s.rlike("^(test|spec)[_-]|[_-](test|spec)$") | name.contains(".test.") | name.contains(".spec.")


def is_doc_path(path: Column) -> Column:
    from quillmere.functions.catalogs import DOC_EXTENSIONS

    return extension(path).isin(*DOC_EXTENSIONS)


def token_estimate(size: Column) -> Column:
    """A quarter of bytes (fast) or characters (accurate), one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(size / 4))


def ratio_estimate(chars: Column, ratio: float | None) -> Column:
    """Characters over characters a token, rounded up; null if that ratio isn't known."""
    return F.lit(None).cast("long") if ratio is None else F.ceil(chars / F.lit(float(ratio))).cast("long")


def line_count(text: Column) -> Column:
    """Newlines, and one for a last line without one; 0 of an empty text."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (n + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)).cast("long")


def has_nul(content: Column) -> Column:
    return F.position(F.lit(b"\x00"), content) > 0


def looks_binary(content: Column) -> Column:
    return has_nul(F.substring(content, 1, 4096))


def python_module(path: Column) -> Column:
    """a/b/__init__.py and a/b.py are a.b; null of other paths."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(?i)\.py$", ""), "/__init__$", "")
    return F.when(F.lower(path).endswith(".py"), F.replace(F.regexp_replace(bare, "^/+|/+$", ""), F.lit("/"), F.lit(".")))


def go_package(module: Column, path: Column) -> Column:
    parent = F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "^/+|/+$", "")
    base = F.regexp_replace(module, "/$", "")
    return F.when((module != "") & F.lower(path).endswith(".go"), F.when(parent.isin("", "."), base).otherwise(F.concat(base, F.lit("/"), parent)))
