"""From changed paths to tests, documents, validations and guides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import catalogs
from quillmere.functions import columns as C
from quillmere.functions.globs import mapping_glob
from quillmere.operators.bounded import top_per_group
from quillmere.sources.scratch import written

#: Shortest stem that is looked up by its parts; shorter ones are compared with every name.
GRAM = 3


def _grams(value: Column, size: int) -> Column:
    """The parts of ``size`` characters, each once; none of a shorter value."""
    return F.when(F.length(value) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value) - size + 1)), lambda i: F.substring(value, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(stems: DataFrame, names: DataFrame) -> DataFrame:
    """stem, name of the names (of a distinct table name) that contain a stem (of a distinct table stem, none empty).

    Contains is no equi-join; parts of GRAM characters make it one. Parts are counted over all names, a stem is looked up by
    its rarest one, and what that finds is checked, so a part that many names have is met only by stems without any rarer one.
    Stems shorter than a part are looked up by parts of their own length.
    """
    found = None
    for size in range(1, GRAM + 1):
        of = stems.where(F.length("stem") == size) if size < GRAM else stems.where(F.length("stem") >= size)
        asked = of.select("stem", F.explode(_grams(F.col("stem"), size)).alias("gram"))
        parts = names.select("name", F.explode(_grams(F.col("name"), size)).alias("gram"))
        if size == GRAM:
            counts = parts.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            # a part that no name has is the rarest of all, and finds nothing
            asked = asked.join(counts, "gram", "left").groupBy("stem").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        pairs = parts.join(asked, "gram").where(F.contains(F.col("name"), F.col("stem"))).select("stem", "name")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def change_router(changed: DataFrame, files: DataFrame, path: str = "path", per_kind: int = 8) -> DataFrame:
    """changed_file, kind (test or doc), path, total, truncated: files whose name contains the changed file's stem. Stems and names
    are matched once each, and their first files are chosen before they are given to all the changed files of a stem."""
    stems = written(changed.select(F.col(path).alias("changed_file"), C.normalized_stem(F.col(path)).alias("stem")).where("stem <> ''").distinct(), "stems")
    p = F.col(path)
    names = files.select(p.alias("path"), F.lower(C.file_name(p)).alias("name"), F.when(C.is_test_path(p), "test").when(C.is_doc_path(p), "doc").alias("kind")).where("kind is not null").distinct()
    names = written(names, "names")
    pairs = written(contained(stems.select("stem").distinct(), names.select("name").distinct()), "contained")
    # of each name the first files and the number of all, so a name that many files have is told to a stem once
    first = top_per_group(names, ["name", "kind"], [F.col("path")], per_kind).drop("rank")
    found = pairs.join(first, "name")
    totals = pairs.join(names.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n")), "name").groupBy("stem", "kind").agg(F.sum("n").alias("total"))
    chosen = top_per_group(found.drop("name"), ["stem", "kind"], [F.col("path")], per_kind).drop("rank").join(totals, ["stem", "kind"])
    return stems.join(chosen, "stem").select("changed_file", "kind", "path", "total", (F.col("total") > per_kind).alias("truncated"))


def validation_plan(path: Column) -> Column:
    """Recommended validations in the order of the rules, each once."""
    terms, ext = C.path_terms(path), C.extension(path)
    none = F.expr("cast(array() AS array<string>)")
    parts = []
    for words, extensions, what in catalogs.VALIDATION_RULES:
        hit = F.arrays_overlap(terms, F.array(*map(F.lit, words))) if words else F.lit(False)
        if extensions:
            hit = hit | ext.isin(*extensions)
        parts.append(F.when(hit, F.array(*map(F.lit, what))).otherwise(none))
    found = F.array_distinct(F.concat(*parts))
    return F.when(F.size(found) == 0, F.array(F.lit(catalogs.VALIDATION_DEFAULT))).otherwise(found)


def dependency_consumers(changed: DataFrame, imports: DataFrame, path: str = "path") -> DataFrame:
    """changed_file, consumer: files of imports(file, target) whose target is the changed path, its stem path, its dotted
    name or its base name, or ends with one of these behind a slash or a dot. Targets are exploded into their endings,
    so the join is on equal keys. Paths that are listed again are one from the start, so the join makes each pair once a needle."""
    p = F.col(path)
    bare = F.regexp_replace(p, r"\.[^./]*$", "")
    needles = F.array_distinct(F.array(p, bare, F.replace(bare, F.lit("/"), F.lit(".")), C.file_name(p), C.file_name(bare)))
    wanted = changed.select(p).distinct().select(p.alias("changed_file"), F.explode(needles).alias("needle")).where("needle <> ''")
    cuts = F.filter(F.sequence(F.lit(1), F.length("target")), lambda i: (i == 1) | F.substring(F.col("target"), i - 1, 1).isin("/", "."))
    endings = imports.where("target <> ''").select("file", "target").distinct().select("file", F.explode(F.transform(cuts, lambda i: F.substring(F.col("target"), i, F.length("target")))).alias("needle")).distinct()
    return wanted.join(endings, "needle").select("changed_file", F.col("file").alias("consumer")).where("changed_file <> consumer").distinct()


def default_tests(path: Column) -> Column:
    """Where the test of a source file is by convention: tests/ for src/ at the start or within, and _test.go beside."""
    name = C.file_name(path)
    parent = F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    test = F.concat(F.lit("test_"), name)
    at_root = F.when(path.startswith("src/"), F.concat(F.regexp_replace(parent, "^src/", "tests/"), test))
    inside = F.when(path.contains("/src/"), F.concat(F.regexp_replace(parent, "/src/", "/tests/"), test))
    go = F.when(path.endswith(".go") & ~path.endswith("_test.go"), F.regexp_replace(path, r"\.go$", "_test.go"))
    beside = F.when(path.endswith(".py"), F.concat(F.lit("tests/"), test))
    return F.array_distinct(F.filter(F.array(at_root, inside, go, beside), lambda x: x.isNotNull()))


def affected_tests(
    changed: DataFrame, files: DataFrame, imports: DataFrame | None = None, mappings: Sequence[Mapping] = (), broader: Sequence[str] = (), complete: bool = True, path: str = "path"
) -> DataFrame:
    """changed_file, tests, sources, confidence, fallback: tests by explicit mappings (high), by consumers or by naming
    (medium); a pattern of broad impact, an incomplete map or no test at all calls for more than the tests.

    mappings: {"source": glob, "tests": [...]}; imports(file, target) is the dependency map, complete or not.
    """
    p = F.col(path)
    none = F.expr("cast(array() AS array<string>)")
    explicit = F.array_distinct(F.concat(none, *(F.when(p.rlike(mapping_glob(m["source"])), F.array(*map(F.lit, m["tests"]))).otherwise(none) for m in mappings)))
    rows = changed.select(p.alias("changed_file"), explicit.alias("explicit"), C.any_of(p.rlike(mapping_glob(g)) for g in broader).alias("broad"), default_tests(p).alias("guesses")).distinct()
    there = files.select(F.col(path).alias("test"))
    named = rows.select("changed_file", F.explode("guesses").alias("test")).join(there, "test", "left_semi").groupBy("changed_file").agg(F.sort_array(F.collect_set("test")).alias("named"))
    out = rows.join(named, "changed_file", "left")
    if imports is not None:
        users = dependency_consumers(changed.select(p.alias("path")), imports).where(C.is_test_path(F.col("consumer")))
        out = out.join(users.groupBy("changed_file").agg(F.sort_array(F.collect_set("consumer")).alias("used")), "changed_file", "left")
    else:
        out = out.withColumn("used", none)
    tests = F.array_sort(F.array_distinct(F.concat("explicit", F.coalesce("named", none), F.coalesce("used", none))))
    how = F.filter(F.array(F.when(F.size("explicit") > 0, "mapping"), F.when(F.size(F.coalesce("used", none)) > 0, "dependency"), F.when(F.size(F.coalesce("named", none)) > 0, "naming")), lambda x: x.isNotNull())
    return out.select(
        "changed_file", tests.alias("tests"), how.alias("sources"),
        F.when(F.size("explicit") > 0, "high").when(F.size(tests) > 0, "medium").otherwise("low").alias("confidence"),
        (F.col("broad") | F.lit(not complete) | (F.size(tests) == 0)).alias("fallback"),
    )


def architecture(paths: DataFrame, layers: Sequence[tuple[str, Sequence[str]]], roles: Sequence[tuple[str, Sequence[str]]], boundary_roles: Sequence[str], path: str = "path") -> DataFrame:
    """path, layer, role, boundary, hint: the first layer and the first role with a pattern that matches."""
    from quillmere.functions.globs import name_glob

    p = F.col(path)
    first = lambda section: F.coalesce(*(F.when(C.any_of(p.rlike(name_glob(g)) for g in globs), F.lit(name)) for name, globs in section), F.lit(None).cast("string"))
    rows = paths.select(p.alias("path"), first(layers).alias("layer"), first(roles).alias("role"))
    rows = rows.withColumn("boundary", F.coalesce(F.col("role").isin(*boundary_roles), F.lit(False)))
    hint = F.when(F.col("boundary"), "review the contract on both sides").when(F.col("layer").isNotNull() & F.col("role").isNotNull(), "stay within the layer").when(F.col("layer").isNotNull(), "layer known, role unclassified").otherwise("unclassified")
    return rows.withColumn("hint", hint)


def scoped_guides(targets: DataFrame, files: DataFrame, names: Sequence[str] = ("AGENTS.md", "CLAUDE.md", "README.md"), path: str = "path") -> DataFrame:
    """target, guide, depth: files of the names in every directory from the root to the target's own."""
    parts = C.directories(F.col(path))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("directory")))
    asked = targets.select(F.col(path).alias("target"), F.inline(above)).withColumn("name", F.explode(F.array(*map(F.lit, names))))
    asked = asked.withColumn("guide", F.when(F.col("directory") == "", F.col("name")).otherwise(F.concat_ws("/", "directory", "name")))
    return asked.join(files.select(F.col(path).alias("guide")).distinct(), "guide", "left_semi").select("target", "guide", "depth")


def materialize_plan(source: DataFrame, destination: DataFrame, overwrite: bool = False) -> DataFrame:
    """path, action of source(path, sha256) against destination(path, sha256, is_file): create, unchanged, overwrite,
    conflict or not_a_file."""
    there = destination.select("path", F.col("sha256").alias("old"), "is_file")
    return source.join(there, "path", "left").select(
        "path",
        F.when(F.col("is_file").isNull(), "create").when(~F.col("is_file"), "not_a_file").when(F.col("sha256") == F.col("old"), "unchanged").otherwise("overwrite" if overwrite else "conflict").alias("action"),
    )


PLACEHOLDER = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"


def render(text: Column, values: Column) -> tuple[Column, Column]:
    """text with its placeholders replaced from a map of strings, and the sorted names that have no value."""
    names = F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1)
    pieces = F.split(text, PLACEHOLDER, -1)
    whole = F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)
    filled = F.transform(names, lambda n, i: F.coalesce(F.try_element_at(values, n), F.get(whole, i)))
    out = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(filled, i), F.lit("")))), "")
    return out, F.array_sort(F.array_distinct(F.array_except(names, F.map_keys(values))))


def template_state(rendered: Column, existing: Column) -> Column:
    return F.when(existing.isNull(), "missing").when(F.sha2(rendered, 256) == F.sha2(existing, 256), "same").otherwise("drifted")


def variables_hash(values: Column) -> Column:
    """SHA-256 of a map of variables, whatever the order of its entries: name=value lines, sorted by name."""
    entries = F.array_sort(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return F.sha2(F.array_join(entries, "\n"), 256)


def template_states(rendered: DataFrame, existing: DataFrame) -> DataFrame:
    """path, state of rendered(path, text) against existing(path, text): missing, same or drifted, and extra for a file
    that no template makes."""
    both = rendered.select("path", F.col("text").alias("made")).join(existing.select("path", F.col("text").alias("there")), "path", "full")
    return both.select("path", F.when(F.col("made").isNull(), "extra").otherwise(template_state(F.col("made"), F.col("there"))).alias("state"))


def evidence_complete(selected: DataFrame, required: DataFrame) -> DataFrame:
    """task, required_count, missing_count, complete of required(task, path): whether selected(task, path) has all that a
    task requires."""
    asked = required.select("task", "path").distinct()
    missing = asked.join(selected.select("task", "path").distinct(), ["task", "path"], "left_anti").groupBy("task").agg(F.count(F.lit(1)).alias("m"))
    counts = asked.groupBy("task").agg(F.count(F.lit(1)).alias("required_count")).join(missing, "task", "left")
    n = F.coalesce("m", F.lit(0).cast("long"))
    return counts.select("task", "required_count", n.alias("missing_count"), (n == 0).alias("complete"))
