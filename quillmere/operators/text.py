"""Operators over lines of texts.

They take any table with a key and a text column. All but the duplicates work within a row: lines are an array, matches
and their surroundings are cut from it by higher-order functions and exploded afterwards, so nothing is shuffled and no
row is copied for each of its lines.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import catalogs
from quillmere.functions import columns as C
from quillmere.operators.bounded import top_per_group
from quillmere.sources.scratch import small_or_shuffled, written

Matches = Callable[[Column], Column]


def literal(text: str, ignore_case: bool = False) -> Matches:
    return (lambda line: F.lower(line).contains(text.lower())) if ignore_case else (lambda line: line.contains(text))


def pattern(regex: str, ignore_case: bool = False) -> Matches:
    return lambda line: line.rlike(f"(?i){regex}" if ignore_case else regex)


def log_signal(line: Column) -> Column:
    """Signals anywhere, and one as the end of a word; the bound is spelled out, as engines differ on word bounds."""
    return line.rlike(f"(?i)({'|'.join(catalogs.LOG_SIGNALS)}|{catalogs.LOG_SIGNAL_WORD}([^A-Za-z0-9_]|$))")


def obligation(terms: Sequence[str] = catalogs.OBLIGATIONS, others: Sequence[str] = catalogs.OBLIGATIONS_OTHER) -> Matches:
    """A term with ASCII word bounds, without case, or one of the others anywhere."""
    return lambda line: line.rlike(f"(?i)(^|[^A-Za-z0-9_])({'|'.join(terms)})([^A-Za-z0-9_]|$)") | C.any_of(line.contains(t) for t in others)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), C.lines_of(F.col(text)).alias("lines"))


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), text of every line."""
    return docs.select(F.col(key).alias("key"), F.posexplode(C.lines_of(F.col(text))).alias("i", "text")).select("key", (F.col("i") + 1).alias("line"), "text")


def _indexed(lines: Column, matches: Matches) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda m: matches(m["text"]))


def _before(lines: Column, line: Column, n: int) -> Column:
    start = F.greatest(F.lit(1), line - n)
    return F.slice(lines, start, line - start)


def search(docs: DataFrame, matches: Matches, key: str = "doc_id", text: str = "text", before: int = 0, after: int = 0, per_document: int | None = None) -> DataFrame:
    """key, line, text, before, after: a row for each matching line; every match has its own surroundings."""
    found = _indexed(F.col("lines"), matches)
    if per_document is not None:
        found = F.slice(found, 1, per_document) if per_document else F.slice(found, 1, 0)
    shown = F.transform(
        found, lambda m: F.struct(m["line"].alias("line"), m["text"].alias("text"), _before(F.col("lines"), m["line"], before).alias("before"), F.slice(F.col("lines"), m["line"] + 1, F.lit(after)).alias("after"))
    )
    return _rows(docs, key, text).select("key", F.inline(shown))


def excerpts(docs: DataFrame, matches: Matches, key: str = "doc_id", text: str = "text", before: int = 3, after: int = 5, per_document: int | None = 20) -> DataFrame:
    """key, line, excerpt: each match with its surroundings as one text, below a line that names its place; line numbers
    take six places."""
    found = search(docs, matches, key, text, before, after, per_document)
    first = F.col("line") - F.size("before")
    shown = F.transform(F.concat("before", F.array("text"), "after"), lambda x, i: F.format_string("%6d: %s", first + i, x))
    return found.select("key", "line", F.concat(F.lit("--- "), F.col("key").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit(" ---\n"), F.array_join(shown, "\n")).alias("excerpt"))


def compact_log(docs: DataFrame, key: str = "doc_id", text: str = "text", max_findings: int = 80, tail: int = 20, width: int = 240, in_bytes: bool = False) -> DataFrame:
    """key, line_count, finding_count, findings and tail (both array<struct<line, text>>), findings_truncated; lines are
    cut to a width in characters, or in bytes."""
    found = F.col("found")
    rows = _rows(docs, key, text).withColumn("found", _indexed(F.col("lines"), log_signal))
    cut = lambda xs: F.transform(xs, lambda m: F.struct(m["line"].alias("line"), (C.cut_bytes(m["text"], width) if in_bytes else F.substring(m["text"], 1, width)).alias("text")))
    n = F.size("lines")
    first = F.greatest(F.lit(1), n - tail + 1)
    last = F.transform(F.slice("lines", first, F.lit(tail)), lambda x, i: F.struct((first + i).alias("line"), x.alias("text")))
    return rows.select(
        "key", n.alias("line_count"), F.size(found).alias("finding_count"), cut(F.slice(found, 1, max_findings)).alias("findings"), cut(last).alias("tail"), (F.size(found) > max_findings).alias("findings_truncated")
    )


HEADING = r"^(#{1,3})\s+(.+?)\s*$"
ANY_HEADING = r"^\s*#{1,6} .*$"


def heading_index(docs: DataFrame, key: str = "doc_id", text: str = "text", per_document: int = 60) -> DataFrame:
    """key, line, level, title, heading_count, headings_truncated of headings of the first three levels."""
    found = _indexed(F.col("lines"), lambda x: x.rlike(HEADING))
    rows = _rows(docs, key, text).select("key", found.alias("found"))
    rows = rows.select("key", F.size("found").alias("heading_count"), F.explode(F.slice("found", 1, per_document)).alias("m"))
    return rows.select(
        "key", "m.line", F.length(F.regexp_extract("m.text", HEADING, 1)).alias("level"), F.regexp_extract("m.text", HEADING, 2).alias("title"), "heading_count", (F.col("heading_count") > per_document).alias("headings_truncated")
    )


def policy_index(docs: DataFrame, matches: Matches | None = None, key: str = "doc_id", text: str = "text", width: int = 220) -> DataFrame:
    """key, line, heading, rule_text: lines that oblige, below the last heading (which may be the line itself)."""
    is_heading = lambda x: x.rlike(r"^#{1,6}\s")
    lines = F.col("lines")
    rows = _rows(docs, key, text).withColumn("heads", _indexed(lines, is_heading)).withColumn("rules", _indexed(lines, matches or obligation()))
    title = lambda m: C.trimmed(F.regexp_replace(F.element_at(F.filter("heads", lambda h: h["line"] <= m["line"]), -1)["text"], "^#+", ""))
    shown = F.transform("rules", lambda m: F.struct(m["line"].alias("line"), title(m).alias("heading"), F.substring(C.trimmed(m["text"]), 1, width).alias("rule_text")))
    rows = rows.where(F.size("rules") > 0).withColumn("heads", F.when(F.size("heads") > 0, F.col("heads")).otherwise(F.array(F.struct(F.lit(0).alias("line"), F.lit("").alias("text")))))
    rows = rows.withColumn("heads", F.concat(F.array(F.struct(F.lit(0).alias("line"), F.lit("").alias("text"))), "heads"))
    found = rows.select("key", F.inline(shown))
    return found.withColumn("heading", F.when(F.col("heading") == "", "no-heading").otherwise(F.col("heading")))


def sections(docs: DataFrame, terms: Mapping[str, Sequence[str]] = catalogs.SECTION_TERMS, key: str = "doc_id", text: str = "text", per_section: int = 40) -> DataFrame:
    """key, section, heading_line, title, body (lines that aren't blank, up to the next heading of any level), body_count,
    body_truncated. A heading may open several sections and a section have several headings."""
    lines = F.col("lines")
    is_heading = lambda x: x.rlike(ANY_HEADING)
    rows = _rows(docs, key, text).withColumn("heads", _indexed(lines, is_heading)).where(F.size("heads") > 0)
    following = lambda i: F.coalesce(F.get("heads", i + 1)["line"], F.size("lines") + 1)
    body = lambda m, i: F.filter(F.slice("lines", m["line"] + 1, following(i) - m["line"] - 1), lambda x: C.trimmed(x) != "")
    shown = F.transform("heads", lambda m, i: F.struct(m["line"].alias("heading_line"), C.trimmed(F.regexp_replace(m["text"], r"^\s*#+", "")).alias("title"), body(m, i).alias("body")))
    found = rows.select("key", F.inline(shown)).withColumn("lowered", F.lower("title"))
    names = F.array(*(F.when(C.any_term(F.col("lowered"), ts), F.lit(name)) for name, ts in terms.items()))
    named = found.withColumn("section", F.explode(F.filter(names, lambda x: x.isNotNull())))
    return named.select("key", "section", "heading_line", "title", F.slice("body", 1, per_section).alias("body"), F.size("body").alias("body_count"), (F.size("body") > per_section).alias("body_truncated"))


def stop_check(docs: DataFrame, terms: Mapping[str, Sequence[str]] = catalogs.STOP_TERMS, required: Sequence[str] = catalogs.STOP_REQUIRED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, has_<name> for each check, missing_required, stop_exploring."""
    lowered = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))  # once, for all checks
    checks = lowered.select("key", *(C.any_term(F.col("low"), ts).alias(f"has_{name}") for name, ts in terms.items()))
    missing = F.filter(F.array(*(F.when(~F.col(f"has_{r}"), F.lit(r)) for r in required)), lambda x: x.isNotNull())
    return checks.withColumn("missing_required", missing).withColumn("stop_exploring", F.size("missing_required") == 0)


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 50, max_occurrences: int = 10, width: int = 180) -> DataFrame:
    """normalized, repeated_text, occurrence_count, first_key, first_line, occurrences array<struct<key, line>>,
    occurrences_truncated: lines that two or more keys have, alike but for case, spacing and six marks.

    Texts are parted once, into a written table of a digest for each long line. Two keys differ just if the least and
    the greatest do, so no distinct count is needed, and counts are combined in the map tasks. Only of digests with two keys are
    occurrences ranked (the map tasks pass on ``max_occurrences`` rows of a line at most), and only documents that have a
    first occurrence are read again for its text.
    """
    normal = F.transform(C.lines_of(F.col(text)), lambda x, i: F.struct((i + 1).alias("line"), C.duplicate_key(x).alias("n")))
    long = F.transform(F.filter(normal, lambda m: F.length(m["n"]) >= min_chars), lambda m: F.struct(m["line"].alias("line"), F.unhex(F.sha2(m["n"], 256)).alias("digest")))
    rows = written(docs.select(F.col(key).alias("key"), F.inline(long)), "line-digests")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("key").alias("least"), F.max("key").alias("greatest")).where("least <> greatest")
    groups = written(groups.select("digest", "occurrence_count"), "repeated-lines")
    hits = rows.join(small_or_shuffled(groups.select("digest")), "digest", "left_semi")
    shown = top_per_group(hits, ["digest"], [F.col("key"), F.col("line")], max_occurrences).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("key", "line"))).alias("occurrences"))
    found = written(groups.join(shown, "digest").withColumn("first", F.col("occurrences")[0]), "first-lines")
    wanted = found.groupBy(F.col("first.key").alias("first_key")).agg(F.collect_list(F.struct(F.col("first.line").alias("first_line"), "occurrence_count", "occurrences")).alias("of"))
    lines = docs.select(F.col(key).alias("first_key"), C.lines_of(F.col(text)).alias("lines")).join(wanted, "first_key")
    rows = lines.select("first_key", F.explode(F.transform("of", lambda o: F.struct(o.alias("o"), F.get(F.col("lines"), o["first_line"] - 1).alias("text")))).alias("m"))
    rows = rows.select("first_key", "m.o.*", F.col("m.text").alias("text"))
    return rows.select(
        C.duplicate_key(F.col("text")).alias("normalized"), F.substring(C.trimmed(F.col("text")), 1, width).alias("repeated_text"), "occurrence_count", "first_key", "first_line", "occurrences", (F.col("occurrence_count") > max_occurrences).alias("occurrences_truncated")
    )


def duplicate_order() -> list[Column]:
    return [F.desc("occurrence_count"), F.lower("repeated_text"), F.col("normalized")]


def evidence(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, n: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """item, key, shared: how many word n-grams of an item a text has, each counted once.

    First all texts are gone through by 64-bit hashes of their n-grams, against the distinct ones of the items; only of
    texts that may share one are the n-grams themselves compared, by an equi-join.
    """

    def grams(df: DataFrame, k: str, t: str, name: str, made: Callable[[Column], Column]) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(F.col(t), F.lit(""))), r"[ \t\r\n]+", -1), lambda x: x != "")
        one = df.select(F.col(k).alias(name), words.alias("w")).where(F.size("w") >= n)
        slices = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: made(F.slice("w", i, n)))
        return one.select(name, F.explode(F.array_distinct(slices)).alias("gram"))

    joined = lambda words: F.array_join(words, " ")
    wanted = written(grams(items, item_key, item_text, "item", F.xxhash64).select("gram").distinct(), "item-grams")
    near = written(grams(docs, key, text, "key", F.xxhash64).join(small_or_shuffled(wanted), "gram", "left_semi").select("key").distinct(), "near-items")
    few = docs.join(small_or_shuffled(near.withColumnRenamed("key", key)), key, "left_semi")
    return grams(items, item_key, item_text, "item", joined).join(grams(few, key, text, "key", joined), "gram").groupBy("item", "key").agg(F.count(F.lit(1)).alias("shared"))


def literal_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, text of the lines that begin with one to three hashes and a space, as they are: the plainest dialect."""
    begins = lambda x: x.startswith("# ") | x.startswith("## ") | x.startswith("### ")
    return search(docs, begins, key, text).select("key", "line", "text")
