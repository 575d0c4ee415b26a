"""Which operators to run on a tree: a table of conditions over its one-row summary, narrowed by what a task tells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("orient", "search", "scope", "inspect", "validate", "stop")
LARGER = "size_class IN ('medium', 'large')"
#: operator, phase, list, condition over the summary, activation, reason.
CATALOG = (
    ("project_summary", "orient", "recommended", "true", "always", "size and languages come before any reading"),
    ("document_roles", "orient", "recommended", "true", "always", "names of documents that are likely to be authoritative"),
    ("search", "search", "recommended", "true", "always", "lines with a term are cheaper than whole files"),
    ("glob_filter", "search", "recommended", "true", "always", "paths narrow the tree before contents are read"),
    ("heading_index", "search", "conditional", "doc_count > 0", "documents matter to the task", "there are documents: headings first"),
    ("change_router", "scope", "recommended", f"has_git OR {LARGER}", "changed files are known", "changed files lead to tests and documents"),
    ("commit_delta", "scope", "conditional", "has_git", "the remote may have moved on", "what either side lacks"),
    ("context_pack", "inspect", "conditional", "has_git", "context is handed on", "a bounded pack of the state of a task"),
    ("metric_concerns", "orient", "conditional", "has_git AND size_class = 'large'", "the history may be heavy", "saved metrics of the history"),
    ("validation_plan", "validate", "conditional", "test_count > 0", "a change is ready", "there are tests: run the ones that count"),
    ("compact_log", "validate", "conditional", "test_count > 0", "output is long", "findings and tail of a log"),
    ("sections", "orient", "conditional", "doc_count > 0", "a task is written down", "goal, requirements and acceptance"),
    ("stop_check", "stop", "conditional", "doc_count > 0", "the essentials are found", "whether exploring may stop"),
    ("structural_search", "search", "conditional", LARGER, "text finds too much", "search by the shape of code"),
    ("responsibility_report", "scope", "conditional", LARGER, "boundaries are unclear", "large files and who may own them"),
    ("doc_duplicates", "orient", "conditional", LARGER, "documents repeat themselves", "repeated lines of documents"),
    ("hotspots", "orient", "conditional", LARGER, "the shape is unclear", "largest and deepest files"),
    ("context_manifest", "orient", "recommended", "size_class = 'large'", "always", "entry points by priority"),
    ("graph_expand", "scope", "recommended", "size_class = 'large'", "always", "only the neighbourhood of a symbol"),
    ("slice_excerpts", "inspect", "recommended", "size_class = 'large'", "always", "excerpts instead of files"),
    ("context_budget", "orient", "recommended", "size_class = 'large'", "always", "what reading would cost"),
    ("policy_index", "orient", "conditional", "array_contains(project_types, 'rule_heavy')", "rules govern the task", "lines that oblige"),
    ("project_scores", "orient", "conditional", "size(project_types) > 0", "the kind of project matters", "signals of kinds of projects"),
)
#: What a task tells, and the operators that it makes relevant.
TASK_NEEDS = {
    "goal": ("search", "glob_filter"),
    "task_file": ("sections", "heading_index", "stop_check"),
    "changed_files": ("commit_delta", "change_router", "graph_expand", "slice_excerpts"),
    "validation": ("validation_plan", "compact_log"),
}


def recommend(summary: DataFrame, catalog: Sequence[tuple] = CATALOG) -> DataFrame:
    """operator, phase, phase_order, ord, list, activation, reason of the rows whose condition the summary meets; a
    recommended operator isn't listed again as a conditional one. The summary has has_git and the columns of
    inventory.summary."""
    rows = F.array(
        *(
            F.when(
                F.expr(condition),
                F.struct(F.lit(name).alias("operator"), F.lit(phase).alias("phase"), F.lit(PHASES.index(phase)).alias("phase_order"), F.lit(i).alias("ord"), F.lit(kind).alias("list"), F.lit(when).alias("activation"), F.lit(why).alias("reason")),
            )
            for i, (name, phase, kind, condition, when, why) in enumerate(catalog)
        )
    )
    return summary.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def listed_once(recommended: DataFrame, conditional: DataFrame) -> DataFrame:
    """Both lists as one: an operator of both is there once, as a recommended one."""
    return recommended.unionByName(conditional.join(recommended.select("operator"), "operator", "left_anti").select(recommended.columns))


def phase_order() -> list[Column]:
    """By phase, and within one as the catalog lists them."""
    return [F.col("phase_order"), F.col("ord")]


def narrow(recommended: DataFrame, told: Mapping[str, bool], needs: Mapping[str, Sequence[str]] = TASK_NEEDS) -> DataFrame:
    """The recommended operators that the task makes relevant; all of them if it tells nothing."""
    wanted = sorted({o for what, names in needs.items() if told.get(what) for o in names})
    if not any(told.values()):
        return recommended.withColumn("task_relevance", F.lit("general"))
    return recommended.where(F.col("operator").isin(*wanted)).withColumn("task_relevance", F.lit("direct"))


def actions(recommended: DataFrame, mapping: DataFrame) -> DataFrame:
    """operator, action, available: what a front end would start; an operator without an action is unavailable."""
    return recommended.join(mapping.select("operator", "action"), "operator", "left").select("operator", "action", F.col("action").isNotNull().alias("available"))


def language_tools(languages: DataFrame, size_class: str, supported: Sequence[str], runtimes: Sequence[str] = ()) -> DataFrame:
    """language, level, enabled, reason: small analyses for every supported language, medium ones from medium trees on,
    large ones of large trees where the language's runtime is there."""
    known, runtime = F.col("language").isin(*supported), F.col("language").isin(*runtimes) if runtimes else F.lit(False)
    bigger, large = size_class in ("medium", "large"), size_class == "large"
    one = lambda level, on, why: F.struct(F.lit(level).alias("level"), on.alias("enabled"), why.alias("reason"))
    levels = [one("small", known, F.when(known, "sources found").otherwise("no analysis for this language"))]
    if bigger:
        levels.append(F.when(known, one("medium", F.lit(True), F.lit("the tree is large enough"))))
    if large:
        levels.append(F.when(known, one("large", runtime, F.when(runtime, "the runtime is there").otherwise("the runtime is missing"))))
    return languages.select("language", F.inline(F.filter(F.array(*levels), lambda x: x.isNotNull())))


def backend_plan(languages: DataFrame, available: Mapping[str, bool], by_language: Mapping[str, str]) -> DataFrame:
    """language, backend, is_available: a saved index first, then a tag list, then what the language itself offers."""
    own = F.coalesce(*(F.when((F.col("language") == lang) & F.lit(available.get(tool, False)), F.lit(tool)) for lang, tool in by_language.items()), F.lit(None).cast("string"))
    backend = F.when(F.lit(available.get("scip", False)), "scip").when(F.lit(available.get("ctags", False)), "ctags").otherwise(own)
    return languages.select("language", backend.alias("backend"), backend.isNotNull().alias("is_available"))
