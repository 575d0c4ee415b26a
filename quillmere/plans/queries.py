"""Queries over the driver's tables, one or more for each operator, with the same results in DuckDB's SQL.

The tables hold no file tree; where an operator wants paths, they are made from the part table by one expression that
both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions import catalogs
from quillmere.functions import columns as C
from quillmere.functions.globs import mapping_glob, name_glob, path_glob, rule_glob
from quillmere.operators import changes, code, graph, inventory, policy, reports, routing, text
from quillmere.operators.bounded import bounded, find, group_totals, scan_capped, top_per_group
from quillmere.operators.selection import medians
from quillmere.sources import adapters, git, index_store
from quillmere.sources.scratch import scratch_path, written_by_size

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def registered(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return registered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def either(words: tuple[str, ...] | list[str], what: str = "contains(low, '{}')") -> str:
    return "(" + " OR ".join(what.format(w.replace("'", "''")) for w in words) + ")"


# ---- lines -----------------------------------------------------------------------------------------------------------

BLANKS = r"[\s\x{00A0}\x{3000}]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


UNIFIED = r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"
ROWS = rf"""
rows AS (SELECT doc_id AS key, CASE WHEN {UNIFIED} = '' THEN [] ELSE string_split(regexp_replace({UNIFIED}, '\n$', ''), chr(10)) END AS l FROM documents),
lines AS (SELECT key, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM rows)
"""
NORMAL = trimmed(f"translate(lower(regexp_replace({trimmed('text')}, '{BLANKS}+', ' ', 'g')), '`*_>#-', '')")


@query(
    f"""
WITH {ROWS}, n AS (SELECT key, line, {trimmed("text")} AS shown, {NORMAL} AS normalized FROM lines),
g AS (
  SELECT normalized, count(*) AS occurrence_count, min({{'key': key, 'line': line}}) AS first, count(DISTINCT key) AS keys,
    array_to_string(list(key || ':' || line ORDER BY key, line)[1:10], ' ') AS occurrences
  FROM n WHERE length(normalized) >= 50 GROUP BY 1
)
SELECT g.normalized, substr(n.shown, 1, 180) AS repeated_text, occurrence_count, first.key AS first_key, first.line AS first_line, occurrences, occurrence_count > 10 AS occurrences_truncated
FROM g JOIN n ON n.key = first.key AND n.line = first.line WHERE keys >= 2
"""
)
def doc_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("occurrences", F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["key"], o["line"])), " "))


@query(f"WITH {ROWS} SELECT key, line, text FROM lines WHERE contains(text, 'License')")
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(table(spark, sf_dir, "documents"), text.literal("License")).select("key", "line", "text")


@query(f"WITH {ROWS} SELECT key, line, text FROM lines WHERE contains(lower(text), 'all rights')")
def search_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(table(spark, sf_dir, "documents"), text.literal("All RIGHTS", ignore_case=True)).select("key", "line", "text")


@query(rf"WITH {ROWS} SELECT key, line, text FROM lines WHERE regexp_matches(text, '[0-9]{{4,}}|(?i)copyright')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(table(spark, sf_dir, "documents"), text.pattern(r"[0-9]{4,}|(?i)copyright")).select("key", "line", "text")


def _around(before: int, after: int, most: str = "") -> str:
    return f"""
WITH {ROWS}, w AS (
  SELECT key, line, text,
    coalesce(string_agg(text, chr(10)) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN {before} PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(text, chr(10)) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN 1 FOLLOWING AND {after} FOLLOWING), '') AS after
  FROM lines
), m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line) AS nth FROM w WHERE contains(text, 'the'))
SELECT key, line, text, before, after FROM m {most}
"""


@query(_around(1, 2))
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.search(table(spark, sf_dir, "documents"), text.literal("the"), before=1, after=2)
    return found.withColumn("before", F.array_join("before", "\n")).withColumn("after", F.array_join("after", "\n"))


@query(_around(3, 5, "WHERE nth <= 20"))
def slice_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.search(table(spark, sf_dir, "documents"), text.literal("the"), before=3, after=5, per_document=20)
    return found.withColumn("before", F.array_join("before", "\n")).withColumn("after", F.array_join("after", "\n"))


@query(
    f"""
WITH {ROWS}, w AS (
  SELECT key, line, text, string_agg(lpad(CAST(line AS VARCHAR), 6, ' ') || ': ' || text, chr(10)) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN 3 PRECEDING AND 5 FOLLOWING) AS shown FROM lines
), m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line) AS nth FROM w WHERE contains(text, 'the'))
SELECT key, line, '--- ' || key || ':' || line || ' ---' || chr(10) || shown AS excerpt FROM m WHERE nth <= 20
"""
)
def numbered_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.excerpts(table(spark, sf_dir, "documents"), text.literal("the"))


SIGNAL = f"regexp_matches(text, '(?i)({'|'.join(catalogs.LOG_SIGNALS)}|ng([^A-Za-z0-9_]|$))')"


@query(
    f"""
WITH {ROWS}, s AS (SELECT key, line, substr(text, 1, 240) AS shown, {SIGNAL} AS hit FROM lines),
c AS (
  SELECT key, count(*) AS line_count, count(*) FILTER (hit) AS finding_count,
    coalesce(array_to_string(list(line || ':' || shown ORDER BY line) FILTER (hit)[1:80], chr(10)), '') AS findings,
    array_to_string(list(line || ':' || shown ORDER BY line)[-20:], chr(10)) AS tail
  FROM s GROUP BY key
)
SELECT key, line_count, finding_count, findings, tail, finding_count > 80 AS findings_truncated FROM c
UNION ALL SELECT key, 0, 0, '', '', false FROM rows WHERE len(l) = 0
"""
)
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.compact_log(table(spark, sf_dir, "documents"))
    shown = lambda name: F.array_join(F.transform(name, lambda m: F.concat_ws(":", m["line"], m["text"])), "\n")
    return found.withColumn("findings", shown("findings")).withColumn("tail", shown("tail"))


@query(
    rf"""
WITH {ROWS}, h AS (
  SELECT key, line, length(regexp_extract(text, '^(#{{1,3}})\s+(.+?)\s*$', 1)) AS level, regexp_extract(text, '^(#{{1,3}})\s+(.+?)\s*$', 2) AS title,
    count(*) OVER (PARTITION BY key) AS heading_count, row_number() OVER (PARTITION BY key ORDER BY line) AS nth
  FROM (SELECT key, line, replace(text, 'The ', '# ') AS text FROM lines) WHERE regexp_matches(text, '^(#{{1,3}})\s+(.+?)\s*$')
)
SELECT key, line, level, title, heading_count, heading_count > 5 AS headings_truncated FROM h WHERE nth <= 5
"""
)
def heading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("The "), F.lit("# ")))
    return text.heading_index(docs, per_document=5)


TERMS = ("must not", "must", "with", "nicht")


@query(
    rf"""
WITH {ROWS}, t AS (SELECT key, line, replace(text, 'The ', '## ') AS text FROM lines), c AS (
  SELECT key, line, text, last_value(CASE WHEN regexp_matches(text, '^#{{1,6}}\s') THEN {trimmed("regexp_replace(text, '^#+', '')")} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM t
)
SELECT key, line, CASE WHEN coalesce(heading, '') = '' THEN 'no-heading' ELSE heading END AS heading, substr({trimmed("text")}, 1, 220) AS rule_text
FROM c WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])({"|".join(TERMS)})([^A-Za-z0-9_]|$)') OR contains(text, 'pour')
"""
)
def policy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("The "), F.lit("## ")))
    return text.policy_index(docs, text.obligation(TERMS, ("pour",)))


SECTIONS = {"goal": ("is", "est"), "required": ("with", "that"), "deferred": ("und", "las")}


@query(
    rf"""
WITH {ROWS}, t AS (SELECT key, line, regexp_replace(text, '^(The|Le|Der|La) ', '## ') AS text FROM lines),
m AS (SELECT *, regexp_matches(text, '^\s*#{{1,6}} .*$') AS head FROM t),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY line ROWS UNBOUNDED PRECEDING) AS part FROM m),
h AS (SELECT key, part, line AS heading_line, {trimmed("regexp_replace(text, '^[[:space:]]*#+', '')")} AS title FROM s WHERE head),
b AS (SELECT key, part, list(text ORDER BY line) FILTER (NOT head AND {trimmed("text")} <> '') AS body FROM s WHERE part > 0 GROUP BY ALL),
n AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{w}')" for k, ws in SECTIONS.items() for w in ws)}) AS v(section, word)),
f AS (SELECT DISTINCT h.key, h.part, h.heading_line, h.title, n.section FROM h JOIN n ON regexp_matches(lower(h.title), '(^|[^a-z0-9_])' || n.word || '([^a-z0-9_]|$)'))
SELECT f.key, f.section, f.heading_line, f.title, coalesce(array_to_string(b.body[1:3], chr(10)), '') AS body, coalesce(len(b.body), 0) AS body_count, coalesce(len(b.body), 0) > 3 AS body_truncated
FROM f JOIN b USING (key, part)
"""
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"(?m)^(The|Le|Der|La) ", "## "))
    return text.sections(docs, SECTIONS, per_section=3).withColumn("body", F.array_join("body", "\n"))


CHECKS = {"goal": ("the", "目的"), "required": ("with",), "acceptance": ("idiot", "les"), "source": ("and",), "tests": ("is", "est")}
NEEDED = ("goal", "required", "tests")


def _present(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(low, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')" if w.isascii() else f"contains(low, '{w}')" for w in words) + ")"


@query(
    f"""
WITH d AS (SELECT doc_id AS key, lower(coalesce(text, '')) AS low FROM documents), c AS (SELECT key, {", ".join(f"{_present(ws)} AS has_{k}" for k, ws in CHECKS.items())} FROM d)
SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN NOT has_{k} THEN '{k}' END" for k in NEEDED)}], lambda x: x IS NOT NULL), ',') AS missing_required, {" AND ".join(f"has_{k}" for k in NEEDED)} AS stop_exploring FROM c
"""
)
def stop_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.stop_check(table(spark, sf_dir, "documents"), CHECKS, NEEDED).withColumn("missing_required", F.array_join("missing_required", ","))


@query(
    r"""
WITH w AS (SELECT item_id AS id, 'i' AS k, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM benchmark
  UNION ALL SELECT doc_id, 'd', list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\r\n]+'), lambda x: x <> '') FROM documents),
g AS (SELECT DISTINCT id, k, array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT id, k, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8))
SELECT a.id AS item, b.id AS key, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.k = 'i' AND b.k = 'd' GROUP BY ALL
"""
)
def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", "text")


TASKS = (("licences", ("License", "rights")), ("words", ("nicht", "with")))


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS task, count(*) AS base_files, sum(length(text)) AS base_chars, count(*) FILTER (hit) AS left_files, coalesce(sum(length(text)) FILTER (hit), 0) AS left_chars,
  round(100.0 * (1 - CAST(count(*) FILTER (hit) AS DOUBLE) / count(*)), 1) AS files_saved, round(100.0 * (1 - CAST(coalesce(sum(length(text)) FILTER (hit), 0) AS DOUBLE) / sum(length(text))), 1) AS chars_saved
FROM (SELECT text, {either(words, "contains(text, '{}')")} AS hit FROM documents)"""
        for name, words in TASKS
    )
)
def benchmark_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", F.length("text").cast("long").alias("n"))
    hits = F.array(*(F.struct(F.lit(name).alias("task"), C.any_of(F.col("text").contains(w) for w in words).alias("hit")) for name, words in TASKS))
    sums = docs.select("n", F.inline(hits)).groupBy("task").agg(
        F.count(F.lit(1)).alias("base_files"), F.sum("n").alias("base_chars"), F.count_if("hit").alias("left_files"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("left_chars")
    )
    return sums.withColumn("files_saved", inventory.reduction(F.col("base_files"), F.col("left_files"))).withColumn("chars_saved", inventory.reduction(F.col("base_chars"), F.col("left_chars")))


# ---- rules -----------------------------------------------------------------------------------------------------------

RULES = [
    policy.Rule("licence", paths=("en/**",), exclude=("**/src3",), forbid="rights reserved", message="no notices"),
    policy.Rule("digits", severity="warning", forbid="[0-9]{6,}", message="no long numbers"),
    policy.Rule("article", paths=("en/*",), require="the ", message="needs an article"),
    policy.Rule("tone", semantic=True, message="be kind"),
]


def _docs_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("folder"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), "text")


#: What the globs of each rule mean for a folder, as SQL.
APPLIED = {"licence": "{0} LIKE 'en/%' AND NOT ({0} = 'src3' OR {0} LIKE '%/src3')", "digits": "true", "article": "regexp_matches({0}, '^en/[^/]*$')"}


def _applied(rule: policy.Rule, column: str) -> str:
    return APPLIED[rule.id].format(column)


def _policy_sql() -> str:
    parts = []
    for r in RULES:
        if r.forbid:
            parts.append(f"SELECT f.folder, f.key, '{r.id}' AS rule_id, '{r.severity}' AS severity, line, 'forbidden' AS kind, regexp_extract(text, '({r.forbid})', 1) AS match FROM lines JOIN f USING (key) WHERE {_applied(r, 'f.folder')} AND regexp_matches(text, '{r.forbid}')")
        if r.require:
            parts.append(f"SELECT f.folder, f.key, '{r.id}', '{r.severity}', NULL, 'missing', NULL FROM f WHERE {_applied(r, 'f.folder')} AND key NOT IN (SELECT key FROM lines WHERE regexp_matches(text, '{r.require}'))")
    return f"WITH {ROWS}, f AS (SELECT doc_id AS key, lang || '/' || source AS folder FROM documents) " + " UNION ALL ".join(parts)


@query(_policy_sql())
def policy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.struct(F.concat_ws("/", "lang", "source").alias("folder"), F.col("doc_id").alias("key")).alias("at"), F.concat_ws("/", "lang", "source").alias("path"), "text")
    found = policy.policy_check(files.select(F.concat_ws("/", "path", F.col("at.key").cast("string")).alias("path"), "text"), [_below(r) for r in RULES])
    parts = F.split("path", "/")
    return found.select(F.concat_ws("/", parts[0], parts[1]).alias("folder"), parts[2].cast("long").alias("key"), "rule_id", "severity", "line", "kind", "match")


def _below(rule: policy.Rule) -> policy.Rule:
    """The same rule for documents below the folders."""
    return policy.Rule(rule.id, tuple(p if p.endswith("**") else f"{p}/*" for p in rule.paths), tuple(f"{p}/*" for p in rule.exclude), rule.severity, rule.forbid, rule.require, rule.message, rule.semantic)


@query(
    f"""
WITH {ROWS}, m AS (SELECT key, line, CASE WHEN line % 3 = 0 THEN text || ' policy-ignore long: known' WHEN line % 5 = 0 THEN text || ' policy-ignore long' ELSE text END AS text FROM lines),
p AS (SELECT *, lag(text) OVER (PARTITION BY key ORDER BY line) AS last FROM m),
r AS (SELECT *, CASE WHEN contains(text, 'policy-ignore long') THEN trim(regexp_extract(text, 'policy-ignore long\\s*:(.*)$', 1)) END AS here,
  CASE WHEN contains(last, 'policy-ignore long') THEN trim(regexp_extract(last, 'policy-ignore long\\s*:(.*)$', 1)) END AS before FROM p)
SELECT key, line, coalesce(nullif(here, ''), nullif(before, ''), here, before) AS reason, coalesce(coalesce(nullif(here, ''), nullif(before, ''), here, before) <> '', false) AS suppressed
FROM r WHERE regexp_matches(text, '[A-Za-z]{{14,}}')
""".replace("\\\\", "\\")
)
def policy_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.lines_of(F.col("text"))
    marked = F.transform(lines, lambda x, i: F.when((i + 1) % 3 == 0, F.concat(x, F.lit(" policy-ignore long: known"))).when((i + 1) % 5 == 0, F.concat(x, F.lit(" policy-ignore long"))).otherwise(x))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array_join(marked, "\n").alias("text"))
    return policy.policy_check(files, [policy.Rule("long", forbid="[A-Za-z]{14,}")]).select(F.col("path").cast("long").alias("key"), "line", "reason", "suppressed")


@query(
    f"""
WITH c AS ({_policy_sql()}), a AS (SELECT lang || '/' || source AS folder FROM documents)
SELECT count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count, 0 AS suppression_count, 0 AS invalid_suppression_count,
  (SELECT sum({" + ".join(f"CASE WHEN {_applied(r, 'folder')} THEN 1 ELSE 0 END" for r in RULES if not r.semantic)}) FROM a) AS files_scanned,
  (SELECT count(*) FROM a) AS distinct_files_scanned, 1 AS semantic_rule_count, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'violations' ELSE 'ok' END AS status
FROM c
"""
)
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, rules = _docs_as_files(spark, sf_dir).select("path", "text"), [_below(r) for r in RULES]
    return policy.policy_summary(files, policy.policy_check(files, rules), rules)


# ---- files -----------------------------------------------------------------------------------------------------------

DIRS = ("src/core/", "tests/unit/", "docs/", "build/Out/", "src/ui/View/", "lib/parser/", "", "tools/Logs/a/", "pkg/dataset/spec/")
EXTS = (".py", ".go", ".md", ".json", ".c", ".h", ".txt", ".log", ".cs", ".gd", ".test.js", "_test.py", ".zip", "")
PATH = (
    "concat(CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIRS)) + " END, CASE WHEN p_partkey % 4 = 0 THEN 'test_' ELSE '' END, replace(p_name, ' ', '_'), "
    "CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTS)) + " END)"
)
FILES = f"SELECT p_partkey AS id, {PATH} AS path, CAST(p_size * 9001 + p_partkey AS BIGINT) AS size FROM part"
EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.[^.]*$'))"
NAME = "regexp_extract(path, '[^/]*$')"
STEM = rf"regexp_replace(lower({NAME}), '\.[^.]*$', '')"
IS_TEST = rf"(regexp_matches('/' || lower(path), '/(test|tests|spec|specs)/') OR regexp_matches({STEM}, '^(test|spec)[_-]|[_-](test|spec)$') OR contains(lower({NAME}), '.test.') OR contains(lower({NAME}), '.spec.'))"
IS_DOC = f"{EXT} IN ({quoted(catalogs.DOC_EXTENSIONS)})"
F_SQL = f"WITH f AS ({FILES}) "


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{PATH} AS path", "CAST(p_size * 9001 + p_partkey AS BIGINT) AS size")


def case_of(values: dict[str, str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _stats(most: str) -> str:
    return f"""
WITH d AS (SELECT lang, text, strlen(text) AS n, {most} AS oversized, strpos(substr(text, 1, 4096), chr(0)) > 0 AS nul FROM (SELECT lang, CASE WHEN doc_id % 7 = 3 THEN text || chr(0) || text ELSE text END AS text FROM documents)),
e AS (SELECT *, NOT oversized AND nul AND instr(text, chr(0)) > 0 AS binary_ FROM d), m AS (SELECT *, NOT oversized AND NOT binary_ AS ok FROM e)
SELECT lang AS "group", count(*) FILTER (ok) AS file_count, CAST(coalesce(sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END) FILTER (ok), 0) AS BIGINT) AS line_count,
  CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS byte_count, count(*) FILTER (oversized) AS oversized, count(*) FILTER (binary_) AS binary_files FROM m GROUP BY lang"""


def _with_nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some with a NUL behind their text, which makes short ones binary."""
    nul = F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("\0"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("text", nul)


@query(
    r"""SELECT lang AS "group", count(*) AS file_count, CAST(sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END) AS BIGINT) AS line_count,
  CAST(sum(strlen(text)) AS BIGINT) AS byte_count, 0 AS oversized, 0 AS binary_files FROM documents GROUP BY lang"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.stats(table(spark, sf_dir, "documents"), F.col("lang"))


@query("SELECT doc_id AS key, strlen(text) AS bytes, greatest(1, length(text) // 4) AS estimated_tokens FROM documents ORDER BY estimated_tokens DESC, bytes DESC, key DESC LIMIT 40")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.context_budget(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), F.col("text"))
    return bounded(rows, inventory.budget_order(), 40).rows


@query("SELECT count(*) AS total, least(count(*), 40) AS returned, count(*) > 40 AS truncated, CAST(sum(greatest(1, strlen(text) // 4)) AS BIGINT) AS estimated_tokens_total FROM documents")
def context_budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.context_budget(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))
    return bounded(rows, inventory.budget_order(), 40).summary.crossJoin(rows.agg(F.sum("estimated_tokens").alias("estimated_tokens_total")))


@query(F_SQL + "SELECT path, size AS bytes, len(string_split(path, '/')) AS depth FROM f ORDER BY bytes DESC, depth DESC, path DESC LIMIT 30")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(inventory.hotspots(files(spark, sf_dir)), inventory.hotspot_order(), 30).rows


@query(F_SQL + "SELECT path, CASE WHEN id % 5 = 0 THEN NULL ELSE size END AS bytes FROM f ORDER BY bytes DESC NULLS LAST, path DESC LIMIT 120")
def responsibility_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("path", F.when(F.col("id") % 5 != 0, F.col("size")).alias("bytes"))
    return bounded(rows, inventory.responsibility_order(), 120).rows


PRIORITY = (
    f"CASE WHEN {NAME} IN ({quoted(catalogs.TOP_NAMES)}) THEN 'P0' WHEN contains('/' || lower(path), '/tests/') THEN 'P2' WHEN contains('/' || lower(path), '/docs/') THEN 'P3' "
    f"WHEN {EXT} IN ({quoted(catalogs.MANIFEST_SOURCES)}) THEN 'P1' ELSE 'P4' END"
)


@query(F_SQL + f"SELECT {PRIORITY} AS context_priority, path, size AS bytes FROM f")
def context_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.manifest(files(spark, sf_dir))


ROLE = (
    f"CASE WHEN contains(lower({NAME}), 'test') OR list_has_any(string_split(lower(path), '/'), ['test', 'tests']) THEN 'tests' WHEN {IS_DOC} OR list_has_any(string_split(lower(path), '/'), ['docs', 'doc']) THEN 'documentation' "
    f"WHEN {EXT} IN ({quoted(catalogs.ROLE_SOURCES)}) THEN 'source' WHEN {EXT} IN ({quoted(catalogs.ROLE_CONFIGS)}) THEN 'configuration' WHEN {EXT} IN ({quoted(catalogs.ROLE_ASSETS)}) THEN 'asset_or_binary' ELSE 'other' END"
)


@query(F_SQL + f", r AS (SELECT path, {ROLE} AS role FROM f) SELECT role, count(*) AS file_count, array_to_string(list(path ORDER BY path)[1:12], '|') AS example_paths FROM r GROUP BY role")
def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.role_map(files(spark, sf_dir)).withColumn("example_paths", F.array_join("example_paths", "|"))


@query(
    F_SQL
    + f", r AS (SELECT path, unnest(list_filter([{', '.join(f'''CASE WHEN {either(words)} THEN '{role}' END''' for role, words in catalogs.DOCUMENT_ROLES.items())}], lambda x: x IS NOT NULL)) AS role FROM (SELECT *, lower({NAME}) AS low FROM (SELECT replace(path, 'red', 'spec') AS path FROM f)) WHERE {IS_DOC}),"
    " n AS (SELECT *, count(*) OVER (PARTITION BY role) AS role_total, row_number() OVER (PARTITION BY role ORDER BY path) AS nth FROM r) SELECT role, path, role_total, role_total > 20 AS role_truncated FROM n WHERE nth <= 20"
)
def document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.document_roles(files(spark, sf_dir).withColumn("path", F.replace("path", F.lit("red"), F.lit("spec"))))


@query(F_SQL + f"SELECT language, count(*) AS file_count FROM (SELECT {case_of(catalogs.ROUTING_LANGUAGES, EXT)} AS language FROM f) WHERE language IS NOT NULL GROUP BY language")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.languages(files(spark, sf_dir))


@query(
    F_SQL
    + f"""SELECT count(*) AS file_count, count(*) FILTER ({IS_DOC}) AS doc_count, count(*) FILTER (regexp_matches(lower(path), '(^|/)tests?/') OR regexp_matches(lower({NAME}), '^test_|_test[.]|[.]test[.]|[.]spec[.]')) AS test_count,
  count(*) FILTER (size >= 100000) AS large_count, CASE WHEN count(*) < 200 THEN 'small' WHEN count(*) < 2000 THEN 'medium' ELSE 'large' END AS size_class,
  array_to_string(list_filter([{", ".join(f'''CASE WHEN bool_or({either(catalogs.SUMMARY_SIGNALS[k], "contains(lower(path), '{}')")}) THEN '{k}' END''' for k in sorted(catalogs.SUMMARY_SIGNALS))}], lambda x: x IS NOT NULL), ',') AS project_types FROM f"""
)
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.summary(files(spark, sf_dir)).withColumn("project_types", F.array_join("project_types", ","))


@query(
    F_SQL
    + f", s AS (SELECT * FROM (VALUES {', '.join(f'''('{k}', '{w}')''' for k, ws in catalogs.SCORED_SIGNALS.items() for w in ws)}) AS v(type, part)), p AS (SELECT DISTINCT unnest(string_split(lower(path), '/')) AS part FROM f) SELECT type, count(DISTINCT part) AS score FROM p JOIN s USING (part) GROUP BY type"
)
def project_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.project_scores(files(spark, sf_dir))


@query(
    F_SQL
    + ", p AS (SELECT string_split(path, '/') AS p FROM f), d AS (SELECT p, unnest(range(1, least(len(p), 3) + 1)) AS depth FROM p) SELECT array_to_string(p[1:depth], '/') AS path, depth, min(CASE WHEN depth < len(p) THEN 'directory' ELSE 'file' END) AS kind FROM d GROUP BY 1, 2"
)
def tree_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.tree(files(spark, sf_dir))


@query(F_SQL + "SELECT DISTINCT string_split(path, '/')[1] AS directory FROM f WHERE contains(path, '/')")
def top_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.top_directories(files(spark, sf_dir))


@query(
    F_SQL
    + f""", p AS (SELECT path, string_split(path, '/') AS p FROM f), t AS (SELECT path, p, list_filter(range(1, len(p)), lambda i: lower(p[i]) IN ({quoted(catalogs.LOW_VALUE_DIRS)}))[1] AS top FROM p)
SELECT DISTINCT array_to_string(p[1:top], '/') AS path, 'directory' AS kind, 'directory_name:' || lower(p[top]) AS matched_rule FROM t WHERE top IS NOT NULL
UNION ALL SELECT DISTINCT path, 'file', 'extension:' || {EXT} FROM t WHERE top IS NULL AND {EXT} IN ({quoted(catalogs.LOW_VALUE_EXTENSIONS)})"""
)
def low_value_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.low_value(files(spark, sf_dir))


@query(F_SQL + f"SELECT path FROM f WHERE NOT list_has_any(list_transform(string_split(path, '/')[1:-2], lambda x: lower(x)), [{quoted(catalogs.IGNORED_DIRS)}])")
def not_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(inventory.not_ignored(F.col("path"))).select("path")


GLOBS = {"path": path_glob("src/*/*.py"), "name": path_glob("test_*.go"), "rule": rule_glob("**/View/*.?s"), "mapping": mapping_glob("**/ui/**"), "fnmatch": name_glob("*core*.py")}


@query(
    F_SQL
    + rf"""SELECT path, regexp_matches(path, '^src/[^/]*/[^/]*\.py$') AS by_path, regexp_matches({NAME}, '^test_[^/]*\.go$') AS by_name, regexp_matches(path, '^(.*/)?View/[^/]*\.[^/]s$') AS by_rule,
  regexp_matches(path, '^.*/ui/.*$') AS by_mapping, regexp_matches(path, '^.*core.*\.py$') AS by_fnmatch FROM f"""
)
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("path", *((C.file_name(F.col("path")) if k == "name" else F.col("path")).rlike(g).alias(f"by_{k}") for k, g in GLOBS.items()))


@query(F_SQL + "SELECT path, array_to_string(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS terms FROM f")
def path_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.array_join(C.path_terms(F.col("path")), " ").alias("terms"))


def _plan_sql() -> str:
    parts = []
    for words, exts, what in catalogs.VALIDATION_RULES:
        hits = ([f"list_has_any(terms, [{quoted(words)}])"] if words else []) + ([f"{EXT} IN ({quoted(exts)})"] if exts else [])
        parts.append(f"CASE WHEN {' OR '.join(hits)} THEN '|{'|'.join(what)}' ELSE '' END")
    return F_SQL + f", t AS (SELECT path, string_split_regex(lower(path), '[^a-z0-9]+') AS terms FROM f), v AS (SELECT path, {' || '.join(parts)} AS v FROM t) SELECT path, CASE WHEN v = '' THEN '{catalogs.VALIDATION_DEFAULT}' ELSE substr(v, 2) END AS validations FROM v"


@query(_plan_sql())
def validation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.array_join(changes.validation_plan(F.col("path")), "|").alias("validations"))


@query(F_SQL + f"SELECT path, {IS_TEST} AS is_test, {IS_DOC} AS is_doc, regexp_replace(regexp_replace({STEM}, '^test_', ''), '_test$', '') AS stem FROM f")
def test_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return files(spark, sf_dir).select("path", C.is_test_path(p).alias("is_test"), C.is_doc_path(p).alias("is_doc"), C.normalized_stem(p).alias("stem"))


@query(
    F_SQL
    + f""", c AS (SELECT DISTINCT path AS changed_file, regexp_replace(regexp_replace({STEM}, '^test_', ''), '_test$', '') AS stem FROM f),
n AS (SELECT DISTINCT path, lower({NAME}) AS name, CASE WHEN {IS_TEST} THEN 'test' WHEN {IS_DOC} THEN 'doc' END AS kind FROM f),
j AS (SELECT changed_file, kind, path, count(*) OVER (PARTITION BY changed_file, kind) AS total, row_number() OVER (PARTITION BY changed_file, kind ORDER BY path) AS nth FROM c JOIN n ON kind IS NOT NULL AND stem <> '' AND contains(name, stem))
SELECT changed_file, kind, path, total, total > 8 AS truncated FROM j WHERE nth <= 8"""
)
def change_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return changes.change_router(f, f)


IMPORTS = F_SQL + ", i AS (SELECT path AS file, replace(p2, '/', '.') AS target FROM (SELECT f.path, g.path AS p2 FROM f JOIN f g ON g.id = f.id * 7 % (SELECT count(*) FROM f)))"


def _imports(f: DataFrame) -> DataFrame:
    n = f.count()
    other = f.select(F.col("id").alias("other"), F.replace("path", F.lit("/"), F.lit(".")).alias("target"))
    return f.withColumn("other", F.col("id") * 7 % n).join(other, "other").select(F.col("path").alias("file"), "target")


@query(
    IMPORTS
    + r""", c AS (SELECT DISTINCT path AS changed_file, regexp_replace(path, '\.[^./]*$', '') AS bare FROM f),
n AS (SELECT DISTINCT changed_file, unnest([changed_file, bare, replace(bare, '/', '.'), regexp_extract(changed_file, '[^/]*$'), regexp_extract(bare, '[^/]*$')]) AS needle FROM c)
SELECT DISTINCT changed_file, file AS consumer FROM n JOIN i ON needle <> '' AND (target = needle OR ends_with(target, '/' || needle) OR ends_with(target, '.' || needle)) WHERE changed_file <> file"""
)
def dependency_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return changes.dependency_consumers(f, _imports(f))


MAPPINGS = ({"source": "src/core/**", "tests": ["tests/unit/core_suite.py"]}, {"source": "lib/*/*.c", "tests": ["tests/lib.py", "tests/c.py"]})


@query(
    F_SQL
    + rf""", c AS (SELECT DISTINCT path AS p FROM f),
g AS (SELECT p, list_concat(CASE WHEN regexp_matches(p, '^src/core/.*$') THEN ['tests/unit/core_suite.py'] ELSE [] END, CASE WHEN regexp_matches(p, '^lib/[^/]*/[^/]*\.c$') THEN ['tests/lib.py', 'tests/c.py'] ELSE [] END) AS explicit,
  [CASE WHEN starts_with(p, 'src/') THEN regexp_replace(regexp_extract(p, '^(.*/)[^/]*$', 1), '^src/', 'tests/') || 'test_' || regexp_extract(p, '[^/]*$') END,
   CASE WHEN contains(p, '/src/') THEN regexp_replace(regexp_extract(p, '^(.*/)[^/]*$', 1), '/src/', '/tests/', 'g') || 'test_' || regexp_extract(p, '[^/]*$') END,
   CASE WHEN ends_with(p, '.go') AND NOT ends_with(p, '_test.go') THEN regexp_replace(p, '\.go$', '_test.go') END, CASE WHEN ends_with(p, '.py') THEN 'tests/test_' || regexp_extract(p, '[^/]*$') END] AS guesses FROM c),
n AS (SELECT p, list(DISTINCT t) AS named FROM (SELECT p, unnest(guesses) AS t FROM g) WHERE t IN (SELECT path FROM f) GROUP BY p),
a AS (SELECT g.p, list_sort(list_distinct(list_concat(explicit, coalesce(named, [])))) AS tests, explicit FROM g LEFT JOIN n ON g.p = n.p)
SELECT p AS changed_file, array_to_string(tests, '|') AS tests, CASE WHEN len(explicit) > 0 THEN 'high' WHEN len(tests) > 0 THEN 'medium' ELSE 'low' END AS confidence, regexp_matches(p, '^docs/.*$') OR len(tests) = 0 AS fallback FROM a"""
)
def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    found = changes.affected_tests(f, f, mappings=MAPPINGS, broader=("docs/**",))
    return found.select("changed_file", F.array_join("tests", "|").alias("tests"), "confidence", "fallback")


LAYERS = [("domain", ["src/core/*"]), ("interface", ["src/ui/*"]), ("library", ["lib/*", "pkg/*"])]
ROLES = [("test", ["*test*"]), ("native", ["*.c", "*.h"]), ("script", ["*.py", "*.gd"])]


@query(
    F_SQL
    + """, a AS (SELECT path, CASE WHEN path LIKE 'src/core/%' THEN 'domain' WHEN path LIKE 'src/ui/%' THEN 'interface' WHEN path LIKE 'lib/%' OR path LIKE 'pkg/%' THEN 'library' END AS layer,
  CASE WHEN contains(path, 'test') THEN 'test' WHEN path LIKE '%.c' OR path LIKE '%.h' THEN 'native' WHEN path LIKE '%.py' OR path LIKE '%.gd' THEN 'script' END AS role FROM f)
SELECT path, layer, role, coalesce(role = 'native', false) AS boundary, CASE WHEN role = 'native' THEN 'review the contract on both sides' WHEN layer IS NOT NULL AND role IS NOT NULL THEN 'stay within the layer' WHEN layer IS NOT NULL THEN 'layer known, role unclassified' ELSE 'unclassified' END AS hint FROM a"""
)
def architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.architecture(files(spark, sf_dir), LAYERS, ROLES, ["native"])


@query(
    F_SQL
    + """, g AS (SELECT path FROM f UNION ALL SELECT * FROM (VALUES ('README.md'), ('src/AGENTS.md'), ('src/ui/README.md'), ('docs/CLAUDE.md'))), t AS (SELECT path AS target, string_split(path, '/')[1:-2] AS p FROM f),
d AS (SELECT target, p, unnest(range(0, len(p) + 1)) AS depth FROM t), n AS (SELECT target, depth, CASE WHEN depth = 0 THEN '' ELSE array_to_string(p[1:depth], '/') || '/' END || name AS guide FROM d, (VALUES ('AGENTS.md'), ('CLAUDE.md'), ('README.md')) AS v(name))
SELECT target, guide, depth FROM n WHERE guide IN (SELECT path FROM g)"""
)
def scoped_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    there = f.select("path").unionByName(spark.createDataFrame([("README.md",), ("src/AGENTS.md",), ("src/ui/README.md",), ("docs/CLAUDE.md",)], "path string"))
    return changes.scoped_guides(f, there)


@query(
    F_SQL
    + """, s AS (SELECT path, min(id) AS id FROM f GROUP BY path) SELECT path, CASE WHEN id % 4 = 0 THEN 'create' WHEN id % 4 = 1 THEN 'not_a_file' WHEN id % 4 = 2 THEN 'unchanged' ELSE 'conflict' END AS action FROM s"""
)
def materialize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = files(spark, sf_dir).groupBy("path").agg(F.min("id").alias("id"))
    source = s.select("path", F.sha2("path", 256).alias("sha256"))
    there = s.where("id % 4 <> 0").select("path", F.sha2(F.when(F.col("id") % 4 == 3, F.concat("path", F.lit("x"))).otherwise(F.col("path")), 256).alias("sha256"), (F.col("id") % 4 != 1).alias("is_file"))
    return changes.materialize_plan(source, there)


@query("SELECT p_partkey AS id, 'Part ' || p_name || ' of ' || p_brand || ' costs {{ price }} ' || p_name AS rendered, 'price' AS unresolved FROM part")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    out, missing = changes.render(F.lit("Part {{ name }} of {{brand}} costs {{ price }} {{ name }}"), values)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), out.alias("rendered"), F.array_join(missing, ",").alias("unresolved"))


# ---- code ------------------------------------------------------------------------------------------------------------

NAME_OF = "replace(p_name, ' ', '_')"
SOURCE = "concat('import os, a.b as c', chr(10), 'from pkg.', lower(p_type), ' import x', chr(10), CASE p_partkey % 3 WHEN 0 THEN 'class ' WHEN 1 THEN '  async def ' ELSE 'def ' END, replace(p_name, ' ', '_'), '(self):', chr(10), '    return ', CAST(p_size AS STRING))"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many_parts(spark, sf_dir).selectExpr("concat('m/f', CAST(p_partkey AS STRING), '.py') AS path", f"{SOURCE} AS text")


@query("SELECT concat('m/f', p_partkey, '.py') AS file, 3 AS line, CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'async_func' ELSE 'func' END AS kind, replace(p_name, ' ', '_') AS name FROM part")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(sources(spark, sf_dir), "python")


@query("SELECT concat('m/f', p_partkey, '.py') AS file, 'a.b|os|pkg.' || lower(p_type) AS targets FROM part")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.dependencies(sources(spark, sf_dir), "python").withColumn("targets", F.array_join("targets", "|"))


# A source is indented at its third line if the key is 1 modulo 3, so it has no tree then.
@query(
    "SELECT concat('m/f', p_partkey, '.py') AS file, CASE WHEN p_partkey % 3 = 1 THEN 'parse_failed' ELSE 'ok' END AS status,"
    " CASE p_partkey % 3 WHEN 2 THEN 'func ' || replace(p_name, ' ', '_') || ' 3-4' WHEN 0 THEN 'class ' || replace(p_name, ' ', '_') || ' 3-4' ELSE '' END AS symbols, CASE WHEN p_partkey % 3 <> 1 THEN 'a.b,os,pkg.' || lower(p_type) ELSE '' END AS imports FROM part"
)
def code_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform("symbols", lambda s: F.concat_ws(" ", s["kind"], s["name"], F.concat_ws("-", s["line"], s["end_line"])))
    return code.python_ast(sources(spark, sf_dir)).select("file", "status", F.array_join(told, ",").alias("symbols"), F.array_join("imports", ",").alias("imports"))


@query(
    "SELECT concat('m/f', p_partkey, '.py') AS file, CASE WHEN p_partkey % 3 <> 1 THEN 'ok' ELSE 'parse_failed' END AS status, CASE WHEN p_partkey % 3 <> 1 THEN 4 END AS line, CASE WHEN p_partkey % 3 <> 1 THEN 'return ' || p_size END AS matched_text,"
    " CASE WHEN p_partkey % 3 <> 1 THEN CAST(p_size AS VARCHAR) END AS value FROM part"
)
def structural_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.structural_search(sources(spark, sf_dir), "return $VALUE").select("file", "status", "line", "matched_text", F.col("captures")["VALUE"].alias("value"))


#: Patterns whose names stand for what the tree holds as strings: pattern, line, matched text and capture in SOURCE.
NAMED = (
    ("import os, a.b as $ALIAS", "1", "'import os, a.b as c'", "'c'"),
    ("from $MODULE import x", "2", "'from pkg.' || lower(p_type) || ' import x'", "'pkg.' || lower(p_type)"),
    ("def $NAME(self): return $VALUE", "3", "'def ' || replace(p_name, ' ', '_') || '(self):' || chr(10) || '    return ' || p_size", "replace(p_name, ' ', '_')"),
    ("def $F($NAME): return $VALUE", "3", "'def ' || replace(p_name, ' ', '_') || '(self):' || chr(10) || '    return ' || p_size", "'self'"),
)


# A source is a class if the key is 0 modulo 3, and a function if it is 2.
@query(
    " UNION ALL ".join(
        f"SELECT '{pattern}' AS pattern, concat('m/f', p_partkey, '.py') AS file, {line} AS line, {text} AS matched_text, {value} AS value FROM part WHERE p_partkey % 3 {'= 2' if line == '3' else '<> 1'}" for pattern, line, text, value in NAMED
    )
)
def structural_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for pattern, *_ in NAMED:
        name = {"$ALIAS": "ALIAS", "$MODULE": "MODULE"}.get(next((n for n in ("$ALIAS", "$MODULE") if n in pattern), ""), "NAME")
        one = code.structural_search(sources(spark, sf_dir), pattern, failures=False).select(F.lit(pattern).alias("pattern"), "file", "line", "matched_text", F.col("captures")[name].alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


#: Parts that a task makes sources of.
PARTS_EACH = 5000


def _many_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt over tasks by their number: a few bytes each, they would be read in few tasks, which then parse long texts."""
    part = table(spark, sf_dir, "part")
    return part.repartition(max(1, -(-part.count() // PARTS_EACH)))


#: Go sources with declarations in comments, raw strings and bodies, which are none.
GO_LINES = "'// package no', 'package p_' || {0}, 'import (', '  /* \"no/comment\" */ \"fmt\"; y `a.org/' || {0} || '`', ')', '/*', 'func InComment() {{', '*/', 'var text = `', 'type InText struct {{', 'import \"no/text\"', '`', 'type (', '  A_' || {0} || ' struct {{ f func() }}', '  B[T any] = []T', ')', 'func (x *A) Do_' || {0} || '(a int) {{ type inner int; s := \"}}//\"; _ = s', CASE p_partkey % 5 WHEN 0 THEN '(' ELSE '' END, '}}'"


@query(
    "SELECT 'm/f' || p_partkey || '.go' AS file, CASE WHEN p_partkey % 5 = 0 THEN 'parse_failed' ELSE 'ok' END AS status, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'package p_' || {0} || ' 2,type A_' || {0} || ' 14,type B 15,func Do_' || {0} || ' 17' END AS symbols,"
    " CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'a.org/' || {0} || ',fmt' END AS imports FROM part".format(NAME_OF)
)
def go_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    files_ = _many_parts(spark, sf_dir).selectExpr("concat('m/f', CAST(p_partkey AS STRING), '.go') AS path", f"concat_ws('\n', {GO_LINES.format(NAME_OF)}) AS text")
    told = F.transform("symbols", lambda s: F.concat_ws(" ", s["kind"], s["name"], s["line"]))
    return code.go_syntax(files_).select("file", "status", F.array_join(told, ",").alias("symbols"), F.array_join("imports", ",").alias("imports"))


@query(r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS target FROM pages")
def link_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("target"))


@query(F_SQL + r"SELECT path, CASE WHEN ends_with(lower(path), '.py') THEN replace(regexp_replace(regexp_replace(path, '(?i)\.py$', ''), '/__init__$', ''), '/', '.') END AS module, CASE WHEN ends_with(lower(path), '.go') THEN CASE WHEN contains(path, '/') THEN 'example.org/m/' || regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE 'example.org/m' END END AS package FROM f")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return files(spark, sf_dir).select("path", C.python_module(p).alias("module"), C.go_package(F.lit("example.org/m/"), p).alias("package"))


@query(
    """
WITH m AS (SELECT DISTINCT p_type || '.' || p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.x' END AS module FROM part), i AS (SELECT DISTINCT p_name AS importer, p_type || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || p_brand || CASE WHEN p_size % 3 = 1 THEN '.x.y' ELSE '' END END AS target FROM part),
j AS (SELECT importer, target, module, row_number() OVER (PARTITION BY importer, target ORDER BY length(module), module) AS nth FROM i JOIN m ON module = target OR starts_with(target, module || '.') OR starts_with(module, target || '.'))
SELECT importer, target, module FROM j WHERE nth = 1
"""
)
def resolve_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    modules = part.selectExpr("concat(p_type, '.', p_brand, CASE WHEN p_size % 2 = 0 THEN '' ELSE '.x' END) AS module")
    imports = part.selectExpr("p_name AS importer", "concat(p_type, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('.', p_brand, CASE WHEN p_size % 3 = 1 THEN '.x.y' ELSE '' END) END) AS target")
    return graph.resolve_modules(imports, modules)


@query(
    F_SQL
    + f""", i AS (SELECT DISTINCT path, CASE WHEN id % 3 = 0 THEN path WHEN id % 3 = 1 THEN 'inc/' || {NAME} ELSE 'none.h' END AS target FROM f), b AS (SELECT {NAME} AS base, max(path) AS by_name FROM f GROUP BY 1)
SELECT i.path, target, coalesce((SELECT max(path) FROM f WHERE f.path = i.target), by_name) AS resolved FROM i LEFT JOIN b ON regexp_extract(target, '[^/]*$') = base"""
)
def resolve_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    includes = f.select("path", F.when(F.col("id") % 3 == 0, F.col("path")).when(F.col("id") % 3 == 1, F.concat(F.lit("inc/"), C.file_name(F.col("path")))).otherwise("none.h").alias("target"))
    return graph.resolve_includes(includes, f.select("path").distinct())


# ---- graph -----------------------------------------------------------------------------------------------------------

NODES = """
nodes AS (SELECT 'r' || r_regionkey AS id, 'module' AS kind, r_name AS name, CAST(NULL AS STRING) AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 'module', n_name, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'module', c_name, NULL FROM customer UNION ALL SELECT 's' || s_suppkey, 'module', s_name, NULL FROM supplier
  UNION ALL SELECT 'file' || n_nationkey, 'file', n_name, 'src/' || n_name FROM nation),
edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'depends_on' AS kind FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey, 'depends_on' FROM customer
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'depends_on' FROM supplier UNION SELECT 'n' || n_nationkey, 'file' || n_nationkey, 'contains_file' FROM nation)
"""


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, nil = table(spark, sf_dir, "nation"), F.lit(None).cast("string")
    named = lambda t, p, k, n: table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("id"), F.lit("module").alias("kind"), F.col(n).alias("name"), nil.alias("path"))
    nodes = named("region", "r", "r_regionkey", "r_name").unionByName(named("nation", "n", "n_nationkey", "n_name")).unionByName(named("customer", "c", "c_custkey", "c_name")).unionByName(named("supplier", "s", "s_suppkey", "s_name"))
    nodes = nodes.unionByName(nation.select(F.concat(F.lit("file"), "n_nationkey").alias("id"), F.lit("file").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("src/"), "n_name").alias("path")))
    edge = lambda t, a, ka, b, kb, kind: table(spark, sf_dir, t).select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"), F.lit(kind).alias("kind"))
    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey", "depends_on").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey", "depends_on")).unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey", "depends_on"))
    edges = edges.unionByName(edge("nation", "n", "n_nationkey", "file", "n_nationkey", "contains_file"))
    return nodes.withColumn("qualified_name", F.col("name")), graph.merge_edges(edges)


@query(
    f"WITH {NODES} SELECT id, kind, name, CASE WHEN lower(id) = 'n1' OR lower(name) = 'n1' OR lower(path) = 'n1' THEN 0 WHEN starts_with(lower(id), 'n1') OR starts_with(lower(name), 'n1') OR starts_with(lower(coalesce(path, '')), 'n1') THEN 1 ELSE 2 END AS match_rank FROM nodes WHERE contains(lower(id), 'n1') OR contains(lower(name), 'n1') OR contains(lower(coalesce(path, '')), 'n1')"
)
def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.query(graph_tables(spark, sf_dir)[0], "N1")


@query(
    f"""
WITH RECURSIVE {NODES}, steps AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT 'r1' AS id, 0 AS distance UNION SELECT dst, distance + 1 FROM walk JOIN steps ON src = id WHERE distance < 2),
v AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)
SELECT v.id, v.distance, coalesce(n.kind, 'unknown') AS kind, n.name, (SELECT count(*) FROM edges WHERE dst = v.id) AS fan_in, (SELECT count(*) FROM edges WHERE src = v.id) AS fan_out FROM v LEFT JOIN nodes n ON n.id = v.id
"""
)
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    return graph.expand(nodes, edges, "r1", depth=2, max_nodes=None).nodes


@query(
    f"""
WITH RECURSIVE {NODES}, seeds AS (SELECT e.src AS id FROM nodes f JOIN edges e ON e.dst = f.id AND e.kind = 'contains_file' WHERE f.path IN (SELECT 'src/' || n_name FROM nation WHERE n_nationkey IN (3, 7))),
walk AS (SELECT id, 0 AS distance FROM seeds UNION SELECT src, distance + 1 FROM walk JOIN edges ON dst = id AND kind = 'depends_on' WHERE distance < 20)
SELECT w.id, coalesce(n.kind, 'module') AS kind, n.name, min(distance) AS distance FROM walk w LEFT JOIN nodes n ON n.id = w.id GROUP BY ALL
"""
)
def affected_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    changed = table(spark, sf_dir, "nation").where("n_nationkey IN (3, 7)").select(F.concat(F.lit("./src/"), "n_name").alias("path"))
    return graph.affected(nodes, edges, changed, None).modules


@query(
    f"WITH {NODES}, ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM ends GROUP BY id"
)
def fan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_counts(graph_tables(spark, sf_dir)[1])


#: Users lead to users of their own ten, and now and then to those of the next ten, from where nothing leads back.
CYCLE = "SELECT DISTINCT 'u' || user_id AS src, 'u' || CASE WHEN event_id % 50 = 0 THEN user_id + 10 ELSE user_id // 10 * 10 + event_id % 10 END AS dst FROM events"


@query(
    f"""
WITH RECURSIVE e AS ({CYCLE}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
m AS (SELECT a.src AS id, a.dst AS other FROM c a JOIN c b ON a.dst = b.src AND a.src = b.dst), p AS (SELECT id, min(other) AS component FROM m GROUP BY id)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM p
"""
)
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = "CASE WHEN event_id % 50 = 0 THEN user_id + 10 ELSE user_id DIV 10 * 10 + event_id % 10 END"
    return graph.cycles(table(spark, sf_dir, "events").selectExpr("concat('u', CAST(user_id AS STRING)) AS src", f"concat('u', CAST({to} AS STRING)) AS dst").distinct())


@query(
    """
WITH n AS (SELECT 'x' || s_suppkey AS id, NULL AS kind, s_name AS name, 0 AS ord FROM supplier UNION ALL SELECT 'x' || c_custkey, c_mktsegment, c_name, 1 FROM customer UNION ALL SELECT 'x' || c_custkey, 'late', '', 2 FROM customer)
SELECT id, arg_min(kind, ord) FILTER (kind IS NOT NULL AND kind <> '') AS kind, arg_min(name, ord) FILTER (name IS NOT NULL AND name <> '') AS name FROM n GROUP BY id
"""
)
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    rows = s.select(F.concat(F.lit("x"), "s_suppkey").alias("id"), F.lit(None).cast("string").alias("kind"), F.col("s_name").alias("name"), F.lit(0).alias("source_ord"))
    rows = rows.unionByName(c.select(F.concat(F.lit("x"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.lit(1).alias("source_ord")))
    rows = rows.unionByName(c.select(F.concat(F.lit("x"), "c_custkey").alias("id"), F.lit("late").alias("kind"), F.lit("").alias("name"), F.lit(2).alias("source_ord")))
    return graph.merge_nodes(rows)


@query("SELECT DISTINCT 'p' || l_partkey AS importer, 's' || l_suppkey AS target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber % 3 <> 0")
def local_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = F.when(F.col("l_linenumber") % 3 == 0, "/x").otherwise("")
    imports = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("importer"), F.concat(F.lit("s"), "l_suppkey", outside).alias("target"))
    return graph.local_imports(imports, table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name")))


# ---- tables ----------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice, nth AS rank, total, total > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE nth <= 3")
def top_rows_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).join(group_totals(orders, ["o_custkey"], 3), "o_custkey")


@query("SELECT event_id AS key, 'k' AS metric, CAST(props ->> 'k' AS DOUBLE) AS value FROM events WHERE CAST(props ->> 'k' AS DOUBLE) >= 50")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.explode(F.from_json("props", "map<string,double>")).alias("metric", "value"))
    return rows.where("value >= 50")


@query("SELECT event_id AS key, 'm.k' AS metric, CAST(props ->> 'k' AS DOUBLE) AS value, CAST(props ->> 'k' AS DOUBLE) / 50 AS level FROM events WHERE CAST(props ->> 'k' AS DOUBLE) / 50 >= 1")
def metric_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    docs = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"m": {"k": {"value": '), k, F.lit(', "levelOfConcern": '), (k.cast("double") / 50).cast("string"), F.lit("}}}")).alias("json"))
    return adapters.concerns(adapters.flat_metrics(docs, "event_id")).select("key", "metric", "value", "level")


@query("SELECT role, count(CASE WHEN turn % 5 <> 4 THEN 1 END) AS measured, count(CASE WHEN turn % 5 = 4 THEN 1 END) AS unmeasured, CAST(sum(v) AS BIGINT) AS total, min(v) AS smallest, max(v) AS largest, avg(v) AS mean, median(v) AS median FROM (SELECT role, turn, CASE WHEN turn % 5 <> 4 THEN length(text) END AS v FROM conversations) GROUP BY role")
def usage_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("role", F.when(F.col("turn") % 5 != 4, F.length("text").cast("long")).alias("v"))
    return inventory.usage_statistics(rows, ["role"], "v")


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(f"SELECT count(v) AS measured, count(*) - count(v) AS unmeasured, CAST(sum(v) AS BIGINT) AS total, min(v) AS smallest, max(v) AS largest, avg(v) AS mean, median(v) AS median FROM (SELECT CASE WHEN l_quantity <> 7 THEN {CENTS} END AS v FROM lineitem)")
def usage_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.usage_statistics(table(spark, sf_dir, "lineitem").selectExpr(f"CASE WHEN l_quantity <> 7 THEN {CENTS} END AS v"), [], "v")


@query("SELECT l_returnflag, l_linestatus, median(l_quantity) AS median FROM lineitem GROUP BY ALL")
def medians_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medians(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query(
    """
SELECT lang AS "group", count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality = 1 AND toxic = 1) AS warned, 0 AS skipped, count(*) FILTER (quality IS NULL) AS unknown, count(*) AS total,
  CASE WHEN count(*) FILTER (quality = 0) > 0 THEN 'failed' WHEN count(*) FILTER (toxic = 1) > 0 THEN 'ok_with_warnings' WHEN count(*) FILTER (quality IS NULL) > 0 THEN 'partial' ELSE 'ok' END AS status
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
"""
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "ok_with_warnings").when(F.col("quality") == 1, "ok")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", status.alias("status"))
    return inventory.status_rollup(rows, "lang")


@query("SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id END, 'f' || doc_id) AS path, CAST(doc_id % 4 AS INT) AS error_count, CAST(doc_id % 2 AS INT) AS missing_count, doc_id % 4 = 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 0 AS ok FROM documents")
def syntax_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    payload = F.to_json(F.struct(F.when(i % 3 == 0, F.concat(F.lit("p"), i)).alias("path"), F.concat(F.lit("f"), i).alias("filename"), (i % 4).alias("errors"), (i % 2).alias("missing_count"), (i % 5 != 0).alias("success")))
    return adapters.syntax_rows(table(spark, sf_dir, "documents").select(payload.alias("json")))


# ---- routing, reports, sources ---------------------------------------------------------------------------------------

CONDITIONS = {
    "doc_count > 0": "docs > 0",
    "test_count > 0": "tests > 0",
    f"has_git OR {routing.LARGER}": "true",
    "has_git": "true",
    "has_git AND size_class = 'large'": "n >= 2000",
    routing.LARGER: "n >= 200",
    "size_class = 'large'": "n >= 2000",
    "array_contains(project_types, 'rule_heavy')": "rules",
    "size(project_types) > 0": "kinds",
    "true": "true",
}


@query(
    F_SQL
    + f""", s AS (SELECT count(*) AS n, count(*) FILTER ({IS_DOC}) AS docs, count(*) FILTER (regexp_matches(lower(path), '(^|/)tests?/') OR regexp_matches(lower({NAME}), '^test_|_test[.]|[.]test[.]|[.]spec[.]')) AS tests,
  bool_or({either(catalogs.SUMMARY_SIGNALS["rule_heavy"], "contains(lower(path), '{}')")}) AS rules, bool_or({" OR ".join(either(w, "contains(lower(path), '{}')") for w in catalogs.SUMMARY_SIGNALS.values())}) AS kinds FROM f) """
    + " UNION ALL ".join(
        f"SELECT '{name}' AS operator, '{phase}' AS phase, {routing.PHASES.index(phase)} AS phase_order, {i} AS ord, '{kind}' AS list, '{when}' AS activation, '{why}' AS reason FROM s WHERE {CONDITIONS[condition]}"
        for i, (name, phase, kind, condition, when, why) in enumerate(routing.CATALOG)
    )
)
def operator_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.recommend(inventory.summary(files(spark, sf_dir)).withColumn("has_git", F.lit(True)))


@query("SELECT * FROM (VALUES ('search', 'open-search', true), ('glob_filter', NULL, false)) AS v(operator, action, available)")
def routed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    recommended = routing.recommend(inventory.summary(files(spark, sf_dir)).withColumn("has_git", F.lit(False)))
    return routing.actions(routing.narrow(recommended, {"goal": True}), spark.createDataFrame([("search", "open-search")], "operator string, action string"))


@query(
    F_SQL
    + f""", l AS (SELECT DISTINCT {case_of(catalogs.ROUTING_LANGUAGES, EXT)} AS language FROM f), k AS (SELECT language, language IN ('python', 'go', 'c') AS known FROM l WHERE language IS NOT NULL)
SELECT language, 'small' AS level, known AS enabled, CASE WHEN known THEN 'sources found' ELSE 'no analysis for this language' END AS reason FROM k UNION ALL SELECT language, 'medium', true, 'the tree is large enough' FROM k WHERE known
UNION ALL SELECT language, 'large', language = 'go', CASE WHEN language = 'go' THEN 'the runtime is there' ELSE 'the runtime is missing' END FROM k WHERE known"""
)
def language_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.language_tools(inventory.languages(files(spark, sf_dir)), "large", ("python", "go", "c"), ("go",))


@query(F_SQL + f", l AS (SELECT DISTINCT {case_of(catalogs.ROUTING_LANGUAGES, EXT)} AS language FROM f) SELECT language, CASE WHEN language = 'go' THEN 'go-list' END AS backend, language = 'go' AS is_available FROM l WHERE language IS NOT NULL")
def backend_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.backend_plan(inventory.languages(files(spark, sf_dir)), {"go-list": True}, {"go": "go-list", "csharp": "dotnet"})


@query(
    F_SQL
    + """, d AS (SELECT path, max(size) AS bytes FROM f GROUP BY path), t AS (SELECT * FROM d ORDER BY bytes DESC, path DESC LIMIT 10), n AS (SELECT count(*) AS n FROM d)
SELECT '| Path | Bytes | Responsibility |' || chr(10) || '|---|---:|---|' || chr(10) || string_agg('| `' || path || '` | ' || bytes || ' | to be told |', chr(10) ORDER BY bytes DESC, path) || (SELECT CASE WHEN n > 10 THEN chr(10) || chr(10) || (n - 10) || ' more files are not shown' ELSE '' END FROM n) AS report FROM t"""
)
def responsibility_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.responsibility_report(files(spark, sf_dir).groupBy("path").agg(F.max("size").alias("bytes")), 10)


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0) AS ahead, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0) AS behind")
def commit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"))
    return git.commit_delta(commits.where("commit % 3 = 0"), commits.where("commit % 2 = 0"))


# A walk tells the directories and then the files of a directory before it goes down into the first of them.
WALK = (
    F_SQL.rstrip()
    + """, parts AS (SELECT DISTINCT string_split(path, '/') AS p FROM f), every AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, CASE WHEN i < len(p) THEN 'directory' ELSE 'file' END AS kind FROM parts, range(1, 30) r(i) WHERE i <= len(p)),
visits AS (SELECT *, row_number() OVER (ORDER BY replace(regexp_replace(path, '(^|/)[^/]*$', ''), '/', chr(1)), kind <> 'directory', regexp_extract(path, '[^/]*$')) AS place, count(*) OVER () AS n FROM every)"""
)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.tree(files(spark, sf_dir), depth=30)


@query(WALK + " SELECT path, kind, place, count(*) OVER () AS returned, least(any_value(n) OVER (), 300) AS visited, false AS results_truncated, any_value(n) OVER () > 300 AS scan_truncated FROM visits WHERE place <= 300 AND regexp_matches(regexp_extract(path, '[^/]*$'), '^.*gear.*$')")
def find_within_a_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, told = find(_entries(spark, sf_dir), "*gear*", kind=None, max_visited=300)
    return rows.select("path", "kind", "place").crossJoin(F.broadcast(told))


@query(WALK + ", hits AS (SELECT *, row_number() OVER (ORDER BY place) AS nth FROM visits WHERE kind = 'file' AND ends_with(path, 'bolt.py')), cut AS (SELECT count(*) > 25 AS cut FROM hits) SELECT path, kind, nth, cut AS results_truncated, false AS scan_truncated FROM hits, cut WHERE nth <= 25")
def find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, told = find(_entries(spark, sf_dir), "*bolt.py", max_results=25)
    nth = F.row_number().over(Window.orderBy("place")).cast("long")  # 25 rows
    return rows.select("path", "kind", nth.alias("nth")).crossJoin(F.broadcast(told.select("results_truncated", "scan_truncated")))


@query(F_SQL + ", s AS (SELECT * FROM f ORDER BY path, id LIMIT 150) SELECT count(*) AS hits, 150 AS scanned, (SELECT count(*) FROM f) > 150 AS scan_truncated FROM s WHERE contains(path, 'ring')")
def scan_capped_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, told = scan_capped(files(spark, sf_dir), [F.col("path"), F.col("id")], 150)
    return seen.where(F.col("path").contains("ring")).agg(F.count(F.lit(1)).alias("hits")).crossJoin(told)


@query(
    """
WITH s AS (SELECT l_orderkey AS d, l_partkey AS s, min(l_linenumber) AS r FROM lineitem GROUP BY ALL), o AS (SELECT s, max('f' || lpad(CAST(d AS VARCHAR), 12, '0')) AS dst FROM s WHERE r = 1 GROUP BY s)
SELECT DISTINCT 'f' || lpad(CAST(d AS VARCHAR), 12, '0') AS src, dst, 'depends_on' AS kind FROM s JOIN o USING (s) WHERE 'f' || lpad(CAST(d AS VARCHAR), 12, '0') <> dst
"""
)
def scip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = adapters.scip_graph(_scip(spark, sf_dir))[1]
    return written_by_size(edges, "scip-edges", table(spark, sf_dir, "lineitem").count())


def _scip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved index for each order: its lines are occurrences of parts, and the first line defines its part."""
    marks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("s")).agg(F.min("l_linenumber").alias("r"))
    mark = F.struct(F.concat(F.lit("p/"), "s").alias("symbol"), F.array(F.col("r") + 4, F.lit(0), F.lit(1)).alias("range"), F.when(F.col("r") == 1, 1).otherwise(0).alias("symbolRoles"))
    told = F.when(F.col("r") == 1, F.struct(F.concat(F.lit("p/"), "s").alias("symbol"), F.when(F.col("s") % 2 == 0, F.concat(F.lit("part"), "s")).alias("displayName"), F.lit("Class").alias("kind")))
    documents = marks.groupBy("d").agg(F.collect_list(mark).alias("occurrences"), F.collect_list(told).alias("symbols"))
    one = F.struct(F.concat(F.lit("f"), F.lpad(F.col("d").cast("string"), 12, "0")).alias("relativePath"), F.lit("x").alias("language"), F.col("symbols"), F.col("occurrences"))
    return documents.select(F.to_json(F.struct(F.array(one).alias("documents"))).alias("json"))


@query(
    """
WITH s AS (SELECT l_orderkey AS d, l_partkey AS s, min(l_linenumber) AS r FROM lineitem GROUP BY ALL)
SELECT 'f' || lpad(CAST(d AS VARCHAR), 12, '0') AS file, CASE WHEN s % 2 = 0 THEN 'part' || s ELSE CAST(s AS VARCHAR) END AS name, 'p/' || s AS qualified_name, 'Class' AS kind, 6 AS line, 'x' AS language FROM s WHERE r = 1
"""
)
def scip_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = adapters.scip_graph(_scip(spark, sf_dir))[0]
    return written_by_size(symbols, "scip-symbols", table(spark, sf_dir, "lineitem").count())


# ---- ordered reports: the first rows of each order -------------------------------------------------------------------


@query(F_SQL + f"SELECT {PRIORITY} AS context_priority, path, size AS bytes FROM f ORDER BY 1, 2, 3 LIMIT 50")
def context_manifest_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(inventory.manifest(files(spark, sf_dir)), [*inventory.manifest_order(), F.col("bytes")], 50).rows


@query("SELECT event_id AS key, 'm.k' AS metric, CAST(props ->> 'k' AS DOUBLE) / 50 AS level FROM events ORDER BY level DESC, metric, key LIMIT 40")
def metric_concerns_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 50
    docs = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"m": {"k": {"levelOfConcern": '), k.cast("string"), F.lit("}}}")).alias("json"))
    return bounded(adapters.flat_metrics(docs, "event_id").select("key", "metric", "level"), [*adapters.concern_order(), F.col("key")], 40).rows


@query("SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CAST(doc_id % 4 AS INT) AS error_count, 0 AS missing_count, doc_id % 4 = 0 AS ok FROM documents ORDER BY ok, path LIMIT 30")
def syntax_failures_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    payload = F.to_json(F.struct(F.concat(F.lit("f"), F.lpad(i.cast("string"), 12, "0")).alias("file"), (i % 4).alias("errors")))
    return bounded(adapters.syntax_rows(table(spark, sf_dir, "documents").select(payload.alias("json"))), adapters.failing_order(), 30).rows


@query(f"SELECT * FROM ({ORACLES['doc_duplicates']}) ORDER BY occurrence_count DESC, lower(repeated_text), normalized LIMIT 20")
def doc_duplicates_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(doc_duplicates(spark, sf_dir), text.duplicate_order(), 20).rows


@query(f"SELECT folder || '/' || key AS path, rule_id, line, kind FROM ({_policy_sql()}) ORDER BY path, line NULLS FIRST, rule_id LIMIT 100")
def policy_findings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.policy_check(_docs_as_files(spark, sf_dir).select("path", "text"), [_below(r) for r in RULES])
    return bounded(found.select("path", "rule_id", "line", "kind"), policy.finding_order(), 100).rows


@query(f"WITH {NODES} SELECT id, kind, name FROM nodes ORDER BY id LIMIT 60")
def graph_nodes_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(graph_tables(spark, sf_dir)[0].select("id", "kind", "name"), graph.node_order(), 60).rows


@query(f"WITH {NODES} SELECT src, dst, kind FROM edges ORDER BY src, dst, kind LIMIT 60")
def graph_edges_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(graph_tables(spark, sf_dir)[1], graph.edge_order(), 60).rows


@query(f"SELECT * FROM ({ORACLES['graph_query']}) ORDER BY match_rank, id LIMIT 12")
def graph_query_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(graph.query(graph_tables(spark, sf_dir)[0], "N1"), graph.match_order(), 12).rows


@query(f"SELECT * FROM ({ORACLES['affected_closure']}) ORDER BY distance, id LIMIT 25")
def affected_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    changed = table(spark, sf_dir, "nation").where("n_nationkey IN (3, 7)").select(F.concat(F.lit("src/"), "n_name").alias("path"))
    return graph.affected(nodes, edges, changed, 25).modules


@query(f"SELECT * FROM ({ORACLES['language_counts']}) ORDER BY file_count DESC, language LIMIT 3")
def languages_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(inventory.languages(files(spark, sf_dir)), inventory.language_order(), 3).rows


@query(f"SELECT * FROM ({ORACLES['tree_prefixes']}) ORDER BY kind <> 'directory', lower(string_split(path, '/')[-1]), path LIMIT 40")
def tree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(inventory.tree(files(spark, sf_dir)), inventory.tree_order(), 40).rows


@query(f"SELECT operator, phase, list FROM ({ORACLES['operator_routing']}) ORDER BY phase_order, ord LIMIT 10")
def operator_routing_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.recommend(inventory.summary(files(spark, sf_dir)).withColumn("has_git", F.lit(True)))
    return bounded(found, routing.phase_order(), 10).rows.select("operator", "phase", "list")


@query(f"SELECT operator, list FROM ({ORACLES['operator_routing']}) WHERE list = 'recommended' UNION ALL SELECT * FROM (VALUES ('extra', 'conditional'))")
def routing_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.recommend(inventory.summary(files(spark, sf_dir)).withColumn("has_git", F.lit(True))).select("operator", "list").where("list = 'recommended'")
    more = spark.createDataFrame([("extra", "conditional"), ("search", "conditional")], "operator string, list string")
    return routing.listed_once(found, more)


# ---- more of code, graphs and reports --------------------------------------------------------------------------------


@query(_stats("strlen(text) > 20000"))
def measured_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # its SQL looks for a NUL in the first 4096 characters, which are more bytes
    return inventory.stats(_with_nul(spark, sf_dir), F.col("lang"), max_bytes=20_000, characters=True)


@query("SELECT doc_id AS key, CAST(ceil(length(text) / 3.5) AS BIGINT) AS estimated_tokens, CAST(NULL AS BIGINT) AS unknown FROM documents")
def ratio_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), C.ratio_estimate(n, 3.5).alias("estimated_tokens"), C.ratio_estimate(n, None).alias("unknown"))


@query(
    """
WITH r AS (SELECT lang AS task, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT task, count(*) AS required_count, count(*) FILTER (NOT sel) AS missing_count, count(*) FILTER (NOT sel) = 0 AS complete
FROM (SELECT task, coalesce(contains(text, 'e'), false) AND NOT (task = 'en' AND doc_id % 5 = 0) AS sel FROM r JOIN documents USING (doc_id)) GROUP BY task
"""
)
def required_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    required = docs.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select(F.col("lang").alias("task"), F.col("doc_id").alias("path"))
    selected = docs.where(F.col("text").contains("e") & ~((F.col("lang") == "en") & (F.col("doc_id") % 5 == 0))).select(F.col("lang").alias("task"), F.col("doc_id").alias("path"))
    return changes.evidence_complete(selected, required)


@query(rf"WITH {ROWS} SELECT key, line, text FROM (SELECT key, line, replace(text, 'The ', '## ') AS text FROM lines) WHERE starts_with(text, '# ') OR starts_with(text, '## ') OR starts_with(text, '### ')")
def literal_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.literal_headings(table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("The "), F.lit("## "))))


#: Of each language a source made from a part: extension, text, declarations (line, kind, name) and targets.
LANGUAGES = {
    "c": ("c", "'#include <stdio.h>', '#  include \"' || {0} || '.h\"', 'typedef struct ' || {0} || ' {{', '}} x;', 'static int run_' || {0} || '(int a)', '  return 1;'", (("3", "'type'", "{0}"), ("5", "'func'", "'run_' || {0}")), "'stdio.h'", "{0} || '.h'"),
    "cpp": ("hpp", "'#include \"base.hpp\"', 'namespace n_' || {0}, 'class ' || {0} || ' {{', '#include <' || {0} || '>'", (("2", "'namespace'", "'n_' || {0}"), ("3", "'class'", "{0}")), "'base.hpp'", "{0}"),
    "csharp": ("cs", "'namespace A.' || {0}, 'public sealed class ' || {0}, '<ProjectReference Include=\"..\\' || {0} || '\\x.csproj\" />', 'internal interface I' || {0}", (("1", "'namespace'", "'A.' || {0}"), ("2", "'class'", "{0}"), ("4", "'interface'", "'I' || {0}")), "'../' || {0} || '/x.csproj'", None),
    "go": ("go", "'package x', 'import (', '  \"fmt\"', '  \"a.org/' || {0} || '\"', ')', 'type ' || {0} || ' struct {{', 'func (x *T) Do_' || {0} || '(a int) {{'", (("6", "'type'", "{0}"), ("7", "'func'", "'Do_' || {0}")), "'a.org/' || {0}", "'fmt'"),
    "gdscript": ("gd", "'extends \"res://base.gd\"', 'class_name C_' || {0}, 'signal s_' || {0}, '@export var v = preload(\"res://' || {0} || '.gd\")', 'func f_' || {0} || '(): pass'", (("2", "'class_name'", "'C_' || {0}"), ("3", "'signal'", "'s_' || {0}"), ("4", "'var'", "'v'"), ("5", "'func'", "'f_' || {0}")), "'res://base.gd'", "'res://' || {0} || '.gd'"),
}


def _sources_of(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    ext, lines = LANGUAGES[language][:2]
    lines = lines.format(NAME_OF).replace("\\", "\\\\")
    return _many_parts(spark, sf_dir).selectExpr(f"concat('m/f', CAST(p_partkey AS STRING), '.{ext}') AS path", f"concat_ws('\n', {lines}) AS text")


def _languages_sql(symbols: bool) -> str:
    parts = []
    for language, (ext, _, declared, first, second) in LANGUAGES.items():
        file = f"'{language}' AS language, 'm/f' || p_partkey || '.{ext}' AS file"
        if symbols:
            parts += [f"SELECT {file}, {line} AS line, {kind} AS kind, {name} AS name FROM part".format(NAME_OF) for line, kind, name in declared]
        else:
            listed = f"list_sort([{first}{', ' + second if second else ''}])".format(NAME_OF)
            parts.append(f"SELECT {file}, array_to_string({listed}, '|') AS targets FROM part")
    return " UNION ALL ".join(parts)


def _every_language(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    out = None
    for language in LANGUAGES:
        one = made(_sources_of(spark, sf_dir, language), language).select(F.lit(language).alias("language"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(_languages_sql(True))
def language_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_language(spark, sf_dir, code.symbols)


@query(_languages_sql(False))
def language_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_language(spark, sf_dir, code.dependencies).withColumn("targets", F.array_join("targets", "|"))


@query("SELECT 'm/f' || p_partkey || '.go' AS file, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS symbol_count FROM part")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.when(F.substring_index(F.regexp_extract("path", r"(\d+)\.go$", 1), ".", 1).cast("long") % 2 == 0, F.col("text")).otherwise("package x")
    f = _sources_of(spark, sf_dir, "go").withColumn("text", plain)
    return code.symbol_counts(code.symbols(f, "go"), f)


@query(
    F_SQL
    + """, p AS (SELECT id, 'src/app' || id % 50 || '/ui' AS dir, CASE id % 5 WHEN 0 THEN '..\\lib' || id || '\\x.csproj' WHEN 1 THEN '../../lib' || id || '/./x.csproj' WHEN 2 THEN 'sub/x.csproj' WHEN 3 THEN '..\\..\\..\\..\\out\\x.csproj' ELSE './y.csproj' END AS ref FROM f)
SELECT id, CASE id % 5 WHEN 0 THEN 'src/app' || id % 50 || '/lib' || id || '/x.csproj' WHEN 1 THEN 'src/lib' || id || '/x.csproj' WHEN 2 THEN dir || '/sub/x.csproj' WHEN 3 THEN '../../../../out/x.csproj' ELSE dir || '/y.csproj' END AS target FROM p"""
)
def project_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text_of = F.when(i % 5 == 0, F.concat(F.lit("..\\lib"), i, F.lit("\\x.csproj"))).when(i % 5 == 1, F.concat(F.lit("../../lib"), i, F.lit("/./x.csproj"))).when(i % 5 == 2, "sub/x.csproj").when(i % 5 == 3, "..\\..\\..\\..\\out\\x.csproj").otherwise("./y.csproj")
    rows = files(spark, sf_dir).select("id", F.concat(F.lit("src/app"), i % 50, F.lit("/ui")).alias("dir"), text_of.alias("ref"))
    return rows.select("id", graph.normalized_reference(F.col("dir"), F.col("ref")).alias("target"))


@query(
    f"""
WITH RECURSIVE {NODES}, ch AS (SELECT 'src/' || n_name AS path FROM nation WHERE n_nationkey IN (3, 7) UNION SELECT 'nowhere'), m AS (SELECT ch.path, n.id FROM ch LEFT JOIN nodes n ON n.kind = 'file' AND n.path = ch.path),
o AS (SELECT m.path, m.id, e.src AS owner FROM m LEFT JOIN edges e ON e.dst = m.id AND e.kind = 'contains_file'),
walk AS (SELECT owner AS id, 0 AS distance FROM o WHERE owner IS NOT NULL UNION SELECT src, distance + 1 FROM walk JOIN edges ON dst = id AND kind = 'depends_on' WHERE distance < 20), w AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)
SELECT (SELECT count(*) FROM ch) AS changed_count, (SELECT count(*) FROM m WHERE id IS NULL) AS unmatched_count, (SELECT count(*) FROM o WHERE id IS NOT NULL AND owner IS NULL) AS ownerless_count, (SELECT count(*) FROM o WHERE owner IS NOT NULL) AS owned_count,
  count(*) AS affected_total, count(*) FILTER (distance = 0) AS seed_count, (SELECT count(*) FROM edges WHERE kind = 'depends_on') AS dependency_edge_count, count(*) > 5 AS affected_truncated,
  'changed_files_are_not_in_the_index' || CASE WHEN count(*) > 5 THEN ',output_was_truncated' ELSE '' END AS uncertainty_reasons, 'broader_or_full' AS recommended_scope FROM w
"""
)
def affected_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    changed = table(spark, sf_dir, "nation").where("n_nationkey IN (3, 7)").select(F.concat(F.lit("src/"), "n_name").alias("path")).unionByName(spark.createDataFrame([("nowhere",)], "path string"))
    return graph.affected(nodes, edges, changed, 5).summary.withColumn("uncertainty_reasons", F.array_join("uncertainty_reasons", ","))


@query(
    f"""
WITH RECURSIVE {NODES}, steps AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT 'r1' AS id, 0 AS distance UNION SELECT dst, distance + 1 FROM walk JOIN steps ON src = id WHERE distance < 2)
SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM walk) AND dst IN (SELECT id FROM walk)
"""
)
def graph_expand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    return graph.expand(nodes, edges, "r1", depth=2, max_nodes=None).edges


@query(
    f"""
WITH {NODES}, steps AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT dst AS id, row_number() OVER (ORDER BY dst) AS place FROM steps WHERE src = 'r1' AND dst <> 'r1' QUALIFY place <= 59),
two AS (SELECT dst AS id, min(place) AS parent FROM one JOIN steps ON src = id WHERE dst <> 'r1' AND dst NOT IN (SELECT id FROM one) GROUP BY dst),
v AS (SELECT 'r1' AS id, 0 AS distance UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two QUALIFY row_number() OVER (ORDER BY parent, id) <= 59 - (SELECT count(*) FROM one))
SELECT v.id, v.distance, coalesce(n.kind, 'unknown') AS kind, n.name, (SELECT count(*) FROM edges WHERE dst = v.id) AS fan_in, (SELECT count(*) FROM edges WHERE src = v.id) AS fan_out FROM v LEFT JOIN nodes n ON n.id = v.id
"""
)
def graph_expand_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph_tables(spark, sf_dir)
    return graph.expand(nodes, edges, "r1", depth=2, max_nodes=60).nodes


@query("SELECT * FROM (VALUES ('n1', 'ok', 'n1'), ('EUROPE', 'ok', 'r3'), ('zzz', 'not_found', ''), ('file1', 'ok', 'file1'), ('file', 'ambiguous', 'file0,file1,file10')) AS v(asked, status, ids)")
def graph_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_tables(spark, sf_dir)[0]
    found = {t: graph.resolve(nodes, t, 3) for t in ("n1", "EUROPE", "zzz", "file1", "file")}
    return spark.createDataFrame([(t, status, ",".join(ids)) for t, (status, ids) in found.items()], "asked string, status string, ids string")


INDEX_FILES = F_SQL + ", d AS (SELECT DISTINCT path FROM f)"
MODULE = r"CASE WHEN ends_with(lower(path), '.py') THEN replace(trim(regexp_replace(regexp_replace(path, '(?i)\.py$', ''), '/__init__$', ''), '/'), '/', '.') END"
PACKAGE = "CASE WHEN ends_with(lower(path), '.go') THEN CASE WHEN contains(path, '/') THEN 'example.org/m/' || trim(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') ELSE 'example.org/m' END END"


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir).select("path").distinct()
    nodes, edges = adapters.index_nodes(f)
    more_nodes, more_edges = adapters.go_packages(f, "example.org/m/")
    return graph.merge_nodes(nodes.unionByName(more_nodes)), graph.merge_edges(edges.unionByName(more_edges))


@query(
    INDEX_FILES
    + f""" SELECT 'file:' || path AS id, 'file' AS kind, {NAME} AS name, path FROM d UNION SELECT 'module:' || m, 'module', m, NULL FROM (SELECT {MODULE} AS m FROM d) WHERE m IS NOT NULL UNION SELECT 'module:' || p, 'module', p, NULL FROM (SELECT {PACKAGE} AS p FROM d) WHERE p IS NOT NULL"""
)
def index_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].select("id", "kind", F.coalesce("name", F.lit("")).alias("name"), "path")


@query(
    INDEX_FILES
    + f""" SELECT 'module:' || m AS src, 'file:' || path AS dst, 'contains_file' AS kind FROM (SELECT path, {MODULE} AS m FROM d) WHERE m IS NOT NULL UNION SELECT 'module:' || p, 'file:' || path, 'contains_file' FROM (SELECT path, {PACKAGE} AS p FROM d) WHERE p IS NOT NULL"""
)
def index_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[1]


@query("SELECT count(*) AS nodes, 'structure-index/1' AS format, true AS input_truncated, 3 AS input_errors FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region)")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index as it is read back, with what the analysers told."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id")).unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("id")))
    told = spark.createDataFrame([('{"tool": "a", "warnings": ["x", "x"], "truncated": false}',), ('{"tool": "b", "errors": ["y"], "scan_truncated": true}',), ("{",)], "json string")
    state = adapters.input_state(told).select("input_truncated", F.size("input_errors").alias("input_errors")).first()
    path = scratch_path(spark, "index")
    index_store.write_index(nodes, nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("depends_on").alias("kind")), path, state["input_truncated"], state["input_errors"])
    back, _, meta = index_store.read_index(spark, path)
    return back.agg(F.count(F.lit(1)).alias("nodes")).select("nodes", F.lit(meta["format"]).alias("format"), F.lit(meta["input_truncated"]).alias("input_truncated"), F.lit(meta["input_errors"]).alias("input_errors"))


@query("SELECT 't' || n_nationkey % 3 || ': w' || n_regionkey AS told FROM nation GROUP BY ALL")
def input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.concat(F.lit("t"), F.col("n_nationkey") % 3).alias("tool"), F.array(F.concat(F.lit("w"), "n_regionkey")).alias("warnings")))
    return adapters.input_state(table(spark, sf_dir, "nation").select(payload.alias("json"))).select(F.explode("input_errors").alias("told"))


CTAGS = "to_json(named_struct('_type', CASE WHEN p_partkey % 7 = 0 THEN 'ptag' ELSE 'tag' END, 'name', CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('x', CAST(p_partkey AS STRING)) END, 'path', concat('m/', p_brand, '.c'), 'line', p_size, 'kind', 'member', 'scope', CASE WHEN p_partkey % 2 = 0 THEN concat('x', CAST(p_partkey - 1 AS STRING)) END)) AS json"


@query(
    "WITH t AS (SELECT p_partkey AS i, 'm/' || p_brand || '.c' AS file, 'x' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'x' || (p_partkey - 1) END AS scope, p_size FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)"
    " SELECT file, name, file || '::' || CASE WHEN scope IS NULL THEN '' ELSE scope || '::' END || name AS qualified_name, 'member' AS kind, p_size AS line FROM t"
)
def ctags_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.ctags_symbols(table(spark, sf_dir, "part").selectExpr(CTAGS))[0].select("file", "name", "qualified_name", "kind", "line")


@query(
    "WITH t AS (SELECT p_partkey AS i, 'm/' || p_brand || '.c' AS file, 'x' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'x' || (p_partkey - 1) END AS scope FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)"
    " SELECT coalesce(o.file || '::' || o.name, t.file) AS src, t.file || '::' || CASE WHEN t.scope IS NULL THEN '' ELSE t.scope || '::' END || t.name AS dst, 'owns' AS kind FROM t LEFT JOIN t o ON o.file = t.file AND o.name = t.scope AND o.scope IS NULL"
)
def ctags_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.ctags_symbols(table(spark, sf_dir, "part").selectExpr(CTAGS))[1]


OUTLINE = (
    "to_json(array(named_struct('path', concat('m/f', CAST(p_partkey AS STRING), '.py'), 'language', 'python', 'items', array(named_struct('name', 'A', 'symbolType', 'class', 'range', named_struct('start', named_struct('line', 3)), "
    "'members', array(named_struct('name', replace(p_name, ' ', '_'), 'symbolType', 'method', 'range', named_struct('start', named_struct('line', p_size))))))))) AS json"
)


@query(
    "SELECT 'm/f' || p_partkey || '.py' AS file, 'A' AS name, 'm/f' || p_partkey || '.py::A' AS qualified_name, 'class' AS kind, 4 AS line, 'python' AS language, 'm/f' || p_partkey || '.py' AS owner FROM part"
    " UNION ALL SELECT 'm/f' || p_partkey || '.py', replace(p_name, ' ', '_'), 'm/f' || p_partkey || '.py::A::' || replace(p_name, ' ', '_'), 'method', p_size + 1, 'python', 'm/f' || p_partkey || '.py::A' FROM part"
)
def outline_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.outline_symbols(table(spark, sf_dir, "part").selectExpr(OUTLINE))


@query(
    "SELECT '# Context' || chr(10) || chr(10) || '- goal: g' || chr(10) || chr(10) || '## Changed' || chr(10) || (SELECT string_agg('- ' || n_name, chr(10) ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 4)) || chr(10) || '- and more' || chr(10) || chr(10) || '## Status' || chr(10) || '- unavailable' AS report"
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.context_pack({"goal": "g"}, table(spark, sf_dir, "nation").select(F.col("n_name").alias("line")), None, limit=4)


@query(
    "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'extra' WHEN 1 THEN 'missing' WHEN 2 THEN 'same' ELSE 'drifted' END AS state, count(*) AS files, sha256('a=1' || chr(10) || 'b=') AS variables FROM nation GROUP BY 1"
)
def template_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("path"))
    rendered = n.where("i % 4 <> 0").select("path", F.col("path").alias("text"))
    there = n.where("i % 4 <> 1").select("path", F.when(F.col("i") % 4 == 3, "other").otherwise(F.col("path")).alias("text"))
    variables = changes.variables_hash(F.create_map(F.lit("b"), F.lit(""), F.lit("a"), F.lit("1")))
    return changes.template_states(rendered, there).groupBy("state").agg(F.count(F.lit(1)).alias("files")).withColumn("variables", variables)


@query("SELECT r_regionkey AS id, 'rule' || r_regionkey AS rule, r_regionkey % 2 = 0 AS hit FROM region")
def rules_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are read from a table of JSON, and whether a file of their own path has a finding."""
    region = table(spark, sf_dir, "region")
    name = F.concat(F.lit("rule"), "r_regionkey")
    made = region.select(F.to_json(F.struct(name.alias("id"), F.array(F.concat(F.lit("d"), "r_regionkey", F.lit("/**"))).alias("paths"), F.lit("bad [0-9]+").alias("forbid"))).alias("json"))
    there = region.select(F.concat(F.lit("d"), "r_regionkey", F.lit("/x")).alias("path"), F.when(F.col("r_regionkey") % 2 == 0, "a bad 12").otherwise("good").alias("text"))
    found = policy.policy_check(there, policy.rules_from_json(made)).select("rule_id").withColumn("hit", F.lit(True))
    return region.select(F.col("r_regionkey").alias("id"), name.alias("rule")).join(found, F.col("rule") == F.col("rule_id"), "left").select("id", "rule", F.coalesce("hit", F.lit(False)).alias("hit"))
