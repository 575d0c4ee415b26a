"""What analysers have saved, as node, edge, metric and summary rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.sources.scratch import small_or_shuffled, written

SCIP = (
    "documents array<struct<relativePath:string,language:string,symbols:array<struct<symbol:string,displayName:string,kind:string,relationships:array<struct<symbol:string>>>>,"
    "occurrences:array<struct<symbol:string,range:array<int>,symbolRoles:int>>>>"
)
#: Bit of a role: the occurrence defines the symbol.
DEFINES = 1
# Keys of a metric node that name no metric below it.
METADATA = ("value", "levelOfConcern", "unit", "prefixes", "description", "objectDescription", "objectName", "referenceValue")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of text files of any size. Files are read in splits, each by one task: the lines of a split are
    numbered by that task, and the lines of the splits before are a prefix sum over one count a split."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")]
    lines = spark.read.text(path).select("value", *split)
    counts = lines.groupBy("file", "start", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("file", "start", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "splits")
    return lines.join(small_or_shuffled(starts), ["file", "start", "part"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value (variant) of each line that isn't blank; a line that isn't JSON fails the query, which tells its
    file, number and text."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("parsed", F.try_parse_json("value"))
    bad = F.concat(F.lit("not JSON: "), F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.substring("value", 1, 120))
    return lines.select("file", "line", F.when(F.col("parsed").isNull(), F.raise_error(bad)).otherwise(F.col("parsed")).alias("value"))


def scip_graph(documents: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """symbols(file, name, qualified_name, kind, line, language) and edges(src, dst, kind) of printed SCIP indexes.

    A document depends on another one that defines a symbol it refers to or relates to; of a symbol that several define
    the last one (by path) counts.
    """
    docs = documents.select(F.inline(F.from_json(json_col, SCIP)["documents"])).withColumnRenamed("relativePath", "file")
    marks = docs.select("file", F.inline("occurrences"))
    defined = marks.where(F.col("symbolRoles").bitwiseAND(DEFINES) == DEFINES).where(F.size("range").isin(3, 4))
    lines = defined.groupBy("file", "symbol").agg(F.min(F.col("range")[0] + 1).alias("line"))
    listed = docs.select("file", "language", F.inline("symbols"))
    symbols = listed.join(lines, ["file", "symbol"], "left").select("file", F.coalesce(F.nullif("displayName", F.lit("")), F.regexp_extract("symbol", r"([^/#.`]+)[#.()]*$", 1)).alias("name"), F.col("symbol").alias("qualified_name"), "kind", "line", "language")
    owners = listed.select("symbol", "file").unionByName(defined.select("symbol", "file")).groupBy("symbol").agg(F.max("file").alias("dst"))
    related = listed.select("file", F.explode("relationships.symbol").alias("symbol"))
    refers = marks.where(~F.col("symbol").startswith("local ")).select("file", "symbol").unionByName(related)
    edges = refers.join(owners, "symbol").where("file <> dst").select(F.col("file").alias("src"), "dst", F.lit("depends_on").alias("kind")).distinct()
    return symbols, edges


CTAGS = "_type string, name string, path string, input string, line int, `end` int, kind string, scope string, language string"


def ctags_symbols(lines: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, edges (owns: from the scope's symbol if the same file has it, else from the file) and one row with
    skipped_count, from JSON lines of Universal Ctags."""
    rows = lines.select(F.from_json(json_col, CTAGS).alias("t")).select("t.*").where("_type is null or _type = 'tag'").withColumn("file", F.coalesce("path", "input"))
    good = rows.where("file is not null and name is not null")
    named = good.withColumn("qualified_name", F.concat_ws("::", "file", F.nullif("scope", F.lit("")), "name"))
    symbols = named.select("file", "name", "qualified_name", "kind", "line", F.col("end").alias("end_line"), "language", F.nullif("scope", F.lit("")).alias("scope"))
    owner = named.select(F.col("file").alias("owner_file"), F.regexp_replace("qualified_name", r"^.*?::", "").alias("owner_scope"), F.col("qualified_name").alias("owner")).distinct()
    joined = symbols.join(owner, (F.col("file") == F.col("owner_file")) & (F.col("scope") == F.col("owner_scope")), "left")
    edges = joined.select(F.coalesce("owner", "file").alias("src"), F.col("qualified_name").alias("dst"), F.lit("owns").alias("kind")).distinct()
    return symbols, edges, rows.agg(F.count_if(F.expr("file is null or name is null")).alias("skipped_count"))


def outline_symbols(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """file, name, qualified_name, kind, line, language, owner: outlines with members nested to any depth, so in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for payload in batch["json"]:
                for file in json.loads(payload):
                    stack = [(item, None) for item in reversed(file.get("items", []))]
                    while stack:
                        item, owner = stack.pop()
                        name = item.get("name", "")
                        full = f"{owner}::{name}" if owner else f"{file.get('path')}::{name}"
                        out.append((file.get("path"), name, full, item.get("symbolType"), ((item.get("range") or {}).get("start") or {}).get("line", -1) + 1, file.get("language"), owner or file.get("path")))
                        stack += [(m, full) for m in reversed(item.get("members") or [])]
            yield pd.DataFrame(out, columns=["file", "name", "qualified_name", "kind", "line", "language", "owner"])

    return documents.select(F.col(json_col).alias("json")).mapInPandas(run, "file string, name string, qualified_name string, kind string, line int, language string, owner string")


def flat_metrics(documents: DataFrame, key: str, json_col: str = "json") -> DataFrame:
    """key, metric, value, level, unit, description: every node of a JSON tree that has a value or a level of concern, by
    its dotted name (places of a list in brackets); a node may be a metric and have further ones below it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
        for batch in batches:
            out = []
            for k, payload in zip(batch["key"], batch["json"], strict=True):
                try:
                    stack = [("", json.loads(payload))]
                except (TypeError, ValueError):
                    out.append((k, None, None, None, None, "not JSON"))
                    continue
                while stack:
                    name, node = stack.pop()
                    if isinstance(node, dict):
                        if number(node.get("value")) is not None or number(node.get("levelOfConcern")) is not None:
                            out.append((k, name, number(node.get("value")), number(node.get("levelOfConcern")), node.get("unit"), node.get("description")))
                        stack += [(f"{name}.{c}" if name else c, v) for c, v in node.items() if c not in METADATA and isinstance(v, dict | list)]
                    elif isinstance(node, list):
                        stack += [(f"{name}[{i}]", v) for i, v in enumerate(node)]
            yield pd.DataFrame(out, columns=["key", "metric", "value", "level", "unit", "description"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(json_col).alias("json")).mapInPandas(run, f"key {kind}, metric string, value double, level double, unit string, description string")


def concerns(metrics: DataFrame, least: float = 1.0) -> DataFrame:
    """Metrics of at least that level of concern."""
    return metrics.where(F.col("level") >= least)


def concern_order() -> list[Column]:
    return [F.desc("level"), F.col("metric")]


def failing_order() -> list[Column]:
    """Of syntax_rows: what isn't ok first, then by path."""
    return [F.col("ok"), F.col("path")]


SYNTAX = "path string, file string, filename string, error_count int, errors int, missing_count int, missing int, successful boolean, success boolean"


def syntax_rows(lines: DataFrame, json_col: str = "json") -> DataFrame:
    """path, error_count, missing_count, ok from rows that may use other names; ok needs success and no errors."""
    r = lines.select(F.from_json(json_col, SYNTAX).alias("r")).select("r.*")
    errors, missing = F.coalesce("error_count", "errors", F.lit(0)), F.coalesce("missing_count", "missing", F.lit(0))
    ok = F.coalesce("successful", "success", F.lit(True)) & (errors == 0) & (missing == 0)
    return r.select(F.coalesce("path", "file", "filename").alias("path"), errors.alias("error_count"), missing.alias("missing_count"), ok.alias("ok"))


def index_nodes(files: DataFrame, symbols: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a structure index: files(path), the Python module of each, symbols and explicit edges between
    paths; merge_nodes and merge_edges of the graph operators join what several sources tell."""
    from quillmere.functions.columns import file_name, python_module

    nil = lambda kind: F.lit(None).cast(kind)
    f = files.select("path").distinct()
    file_nodes = f.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), file_name(F.col("path")).alias("name"), nil("string").alias("qualified_name"), "path", nil("string").alias("symbol_kind"), nil("int").alias("line"), nil("int").alias("end_line"), F.lit(0).alias("source_ord"))
    mods = f.withColumn("module", python_module(F.col("path"))).where("module is not null")
    module_nodes = mods.select(F.concat(F.lit("module:"), "module").alias("id"), F.lit("module").alias("kind"), F.col("module").alias("name"), F.col("module").alias("qualified_name"), nil("string").alias("path"), nil("string").alias("symbol_kind"), nil("int").alias("line"), nil("int").alias("end_line"), F.lit(0).alias("source_ord"))
    nodes = file_nodes.unionByName(module_nodes)
    links = mods.select(F.concat(F.lit("module:"), "module").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("contains_file").alias("kind"))
    if symbols is not None:
        s = symbols.select(F.concat(F.lit("symbol:"), "qualified_name").alias("id"), F.lit("symbol").alias("kind"), "name", "qualified_name", F.col("file").alias("path"), F.col("kind").alias("symbol_kind"), F.col("line").cast("int").alias("line"), nil("int").alias("end_line"), F.lit(1).alias("source_ord"))
        nodes = nodes.unionByName(s)
        links = links.unionByName(symbols.select(F.concat(F.lit("file:"), "file").alias("src"), F.concat(F.lit("symbol:"), "qualified_name").alias("dst"), F.lit("owns").alias("kind")))
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst", "kind"))
    return nodes, links


def go_packages(files: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges that the payload of a Go module adds: the package of every known Go file, and that it contains it."""
    from quillmere.functions.columns import go_package

    owned = files.select("path", go_package(F.lit(module), F.col("path")).alias("package")).where("package is not null").distinct()
    nil = lambda kind: F.lit(None).cast(kind)
    nodes = owned.select("package").distinct().select(
        F.concat(F.lit("module:"), "package").alias("id"), F.lit("module").alias("kind"), F.col("package").alias("name"), F.col("package").alias("qualified_name"), nil("string").alias("path"),
        nil("string").alias("symbol_kind"), nil("int").alias("line"), nil("int").alias("end_line"), F.lit(2).alias("source_ord"),
    )
    return nodes, owned.select(F.concat(F.lit("module:"), "package").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("contains_file").alias("kind"))


PAYLOAD = "tool string, warnings array<string>, errors array<string>, truncated boolean, scan_truncated boolean, files_truncated boolean, output_truncated boolean"


def input_state(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """One row of what the payloads of all analysers tell: input_errors (array, sorted, each once with its tool before it)
    and input_truncated, if any of their flags is set. A payload that isn't JSON is an error of its own."""
    parsed = payloads.select(F.from_json(json_col, PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"), F.try_parse_json(json_col).isNull().alias("broken")).select("p.*", "broken")
    none = F.expr("cast(array() AS array<string>)")
    told = F.transform(F.concat(F.coalesce("warnings", none), F.coalesce("errors", none)), lambda w: F.concat_ws(": ", F.coalesce("tool", F.lit("unknown")), w))
    told = F.when(F.col("broken"), F.array(F.lit("unknown: not JSON"))).otherwise(told)
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("truncated", "scan_truncated", "files_truncated", "output_truncated")]
    cut = flags[0] | flags[1] | flags[2] | flags[3]
    rows = parsed.select(told.alias("told"), cut.alias("cut"))
    errors = rows.select(F.explode("told").alias("told")).distinct().agg(F.sort_array(F.collect_list("told")).alias("input_errors"))
    return errors.crossJoin(rows.agg(F.coalesce(F.bool_or("cut"), F.lit(False)).alias("input_truncated")))  # one row each
