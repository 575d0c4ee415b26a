"""Rules over files: patterns that are forbidden in, or required of, the files of some paths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions.globs import rule_glob

#: Stands in a line, with a rule's id and a reason, to suppress a finding there or on the next line.
MARKER = "policy-ignore"
#: Rules that one check takes at most.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """forbid or require is a regular expression; a semantic rule is told, not checked. No paths are all paths."""

    id: str
    paths: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    severity: str = "error"
    forbid: str | None = None
    require: str | None = None
    message: str = ""
    semantic: bool = False
    globs: tuple[tuple[str, ...], tuple[str, ...]] = field(init=False, default=((), ()))

    def __post_init__(self) -> None:
        if self.severity not in ("error", "warning"):
            raise ValueError(f"rule {self.id}: severity is error or warning")
        if not self.semantic and not (self.forbid or self.require):
            raise ValueError(f"rule {self.id}: forbid or require is needed")
        object.__setattr__(self, "globs", (tuple(map(rule_glob, self.paths)), tuple(map(rule_glob, self.exclude))))

    def applies(self, path: Column) -> Column:
        include, exclude = self.globs
        inside = C.any_of(path.rlike(g) for g in include) if include else F.lit(True)
        return inside & ~C.any_of(path.rlike(g) for g in exclude)


FINDING = "struct<rule_id:string,severity:string,line:int,kind:string,message:string,match:string,suppressed:boolean,reason:string>"


def _finding(rule: Rule, line: Column, kind: str, match: Column, suppressed: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), line.cast("int").alias("line"), F.lit(kind).alias("kind"), F.lit(rule.message).alias("message"),
        match.alias("match"), suppressed.alias("suppressed"), reason.alias("reason"),
    )


def _reason(line: Column, rule: Rule, marker: str) -> Column:
    """Null without a marker, empty with one that gives no reason."""
    tag = f"{marker} {rule.id}"
    plain = "".join(f"\\{c}" if c in r".^$*+?{}[]|()\/" else c for c in tag)
    return F.when(line.contains(tag), C.trimmed(F.regexp_extract(line, rf"{plain}\s*:(.*)$", 1)))


def policy_check(files: DataFrame, rules: list[Rule], path: str = "path", text: str = "text", marker: str = MARKER) -> DataFrame:
    """path, rule_id, severity, line, kind, message, match, suppressed, reason: in one pass over the files, within rows.

    A marker with a reason on the line or the one before suppresses a finding; a marker without one is told in reason
    as an empty text, and the finding stays. A required pattern that no line has is a finding without a line.
    """
    rows = files.select(F.col(path).alias("path"), C.lines_of(F.col(text)).alias("lines"))
    parts = [part for rule in rules if not rule.semantic for part in _parts(rule, marker)]
    return rows.select("path", F.inline(F.concat(_nothing(), *parts)))


def _nothing() -> Column:
    return F.expr(f"cast(array() AS array<{FINDING}>)")


def _parts(rule: Rule, marker: str) -> list[Column]:
    applies, nil, parts = rule.applies(F.col("path")), F.lit(None).cast("string"), []
    if rule.forbid:
        hits = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: m["x"].rlike(rule.forbid))

        def found(m: Column) -> Column:
            here, before = _reason(m["x"], rule, marker), _reason(F.get("lines", m["i"] - 1), rule, marker)
            reason = F.coalesce(F.nullif(here, F.lit("")), F.nullif(before, F.lit("")), here, before)
            return _finding(rule, m["i"] + 1, "forbidden", F.regexp_extract(m["x"], f"({rule.forbid})", 1), F.coalesce(reason != "", F.lit(False)), reason)

        parts.append(F.when(applies, F.transform(hits, found)).otherwise(_nothing()))
    if rule.require:
        absent = ~F.exists("lines", lambda x: x.rlike(rule.require))
        parts.append(F.when(applies & absent, F.array(_finding(rule, F.lit(None), "missing", nil, F.lit(False), nil))).otherwise(_nothing()))
    return parts


def finding_order() -> list[Column]:
    return [F.col("path"), F.col("line").asc_nulls_first(), F.col("rule_id")]


def rules_from_json(rows: DataFrame, json_col: str = "json") -> list[Rule]:
    """Rules of a table of JSON objects, of which a project has few: they become expressions of one plan. An object
    without an id is an error."""
    kind = "id string, paths array<string>, exclude array<string>, severity string, forbid string, require string, message string, semantic boolean"
    read = rows.select(F.from_json(json_col, kind).alias("r")).select("r.*").orderBy("id").limit(MOST_RULES + 1).collect()
    if len(read) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if any(not r["id"] for r in read):
        raise ValueError("a rule without an id")
    return [Rule(r["id"], tuple(r["paths"] or ()), tuple(r["exclude"] or ()), r["severity"] or "error", r["forbid"], r["require"], r["message"] or "", bool(r["semantic"])) for r in read]


def policy_summary(files: DataFrame, findings: DataFrame, rules: list[Rule], path: str = "path") -> DataFrame:
    """error_count, warning_count, suppression_count, invalid_suppression_count, semantic_rule_count, files_scanned (of
    each rule), distinct_files_scanned, status: counted before any limit."""
    own = [r.applies(F.col(path)).cast("long") for r in rules if not r.semantic]
    each = sum(own[1:], own[0]) if own else F.lit(0).cast("long")
    scanned = files.select(each.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files_scanned"), F.count_if(F.col("n") > 0).alias("distinct_files_scanned"))
    open_ = ~F.col("suppressed")
    counts = findings.agg(
        F.count_if(open_ & (F.col("severity") == "error")).alias("error_count"),
        F.count_if(open_ & (F.col("severity") == "warning")).alias("warning_count"),
        F.count_if("suppressed").alias("suppression_count"),
        F.count_if(F.col("reason") == "").alias("invalid_suppression_count"),
    )
    both = counts.crossJoin(F.broadcast(scanned))  # one row each
    return both.withColumn("semantic_rule_count", F.lit(sum(r.semantic for r in rules))).withColumn("status", F.when(F.col("error_count") > 0, "violations").otherwise("ok"))
