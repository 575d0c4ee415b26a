from __future__ import annotations

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.operators import code
from quillmere.plans import queries as core
from tests.oracle import DATA, needs_data


def matches(spark, pattern, *sources, **how):
    files = spark.createDataFrame([(f"{i}.py", s) for i, s in enumerate(sources)], "path string, text string")
    return sorted((r["file"], r["line"], r["matched_text"], r["captures"]) for r in code.structural_search(files, pattern, **how).where("status = 'ok'").collect())


@pytest.mark.parametrize(
    ("pattern", "source", "captures"),
    [
        ("$X.$ATTR", "a.b", {"X": "a", "ATTR": "b"}),
        ("def $F($A): return $A", "def f(x): return x", None),  # an argument is no expression, so $A isn't the same twice
        ("def $F($A): return $B", "def f(x): return x", {"F": "f", "A": "x", "B": "x"}),
        ("import $M", "import os", {"M": "os"}),
        ("f($K=1)", "f(k=1)", {"K": "k"}),
        ("class $C($BASE): pass", "class A(B.c): pass", {"C": "A", "BASE": "B.c"}),
        ("global $G", "global g", {"G": "g"}),
        ("$A.x = $A.y", "p.q.x = p.q.y", {"A": "p.q"}),
        ("$A.x = $A.y", "p.x = q.y", None),
        ("f(*$A)", "f(*é)", {"A": "é"}),
    ],
)
def test_names_stand_for_names_too(spark, pattern, source, captures):
    got = matches(spark, pattern, source)
    assert [g[3] for g in got] == ([captures] if captures else [])
    assert [g[3] for g in matches(spark, pattern, source, failures=False)] == ([captures] if captures else [])


def test_nothing_stands_for_what_is_not_there(spark):
    assert matches(spark, "return $X", "def f():\n    return\n") == []
    assert matches(spark, "f(1)", "f(True)", "f(1.0)", "f(1)")[0][0] == "2.py"


def test_only_sources_with_all_names_reach_the_parser(spark):
    files = spark.createDataFrame([("a.py", "logger.info(x)"), ("b.py", "print(x)"), ("c.py", "def ("), ("d.py", "ｌogger.info(y)"), ("e.py", None)], "path string, text string")
    found = code.structural_search(files, "logger.info($X)", failures=False)
    assert sorted((r["file"], r["captures"]["X"]) for r in found.collect()) == [("a.py", "x"), ("d.py", "y")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Contains(text") and "logger" in plan and "info" in plan
    assert code.required(code.compiled_pattern("def run($A, *, key=1): return 'text'.join(a.b)")) == ["a", "b", "join", "key", "run"]
    assert sorted({r["file"] for r in code.structural_search(files, "logger.info($X)").collect()}) == ["a.py", "c.py", "d.py"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["x = é + 1", "f(\n  'a\\nb',\n  \U0001f642_ if 0 else y)".replace("\U0001f642_", "ü"), "s = '''p\n\x0cq'''", "if a:\n\tb()\r", "# é\u2028 no line"]), max_size=6), st.sampled_from(["\n", "\r\n", "\r"]))
def test_segments_are_those_of_the_parser(parts, end):
    text = end.join(parts)
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return
    source = code.Source(text)
    for node in ast.walk(tree):
        if hasattr(node, "lineno"):
            assert source.segment(node) == ast.get_source_segment(text, node)


GO = '''// package wrong
/* package wrong2 */ package main // end

import "os"; import ( /* "no" */
	f "fmt"
	. `a/b`
	_ "c/\\x64"
)

/*
func InComment() {}
type InComment struct{}
*/
const text = `
type InText struct {
import "no"
func InText() {
`
type (
	A struct {
		B int // type X int
		f func(int) string
	}
	C[T any] interface{ M() }
)
type D = map[string]struct{ E int }
var g = func() { type Local int }
func (r *A) Method(x int) (y string, err error) { return "}", nil }
func Generic[T any, U comparable](t T) U { var q rune = '\\''; if q == '{' { q++ }; return *new(U) }
func external(a int)
'''


def test_go_declarations_are_those_at_the_top():
    status, found, imports = code.go_source(GO)
    assert status == "ok" and imports == ["a/b", "c/d", "fmt", "os"]
    lines = {line.strip(): i for i, line in enumerate(GO.split("\n"), 1)}
    assert [(s["kind"], s["name"]) for s in found] == [("package", "main"), ("type", "A"), ("type", "C"), ("type", "D"), ("func", "Method"), ("func", "Generic"), ("func", "external")]
    assert [s["line"] for s in found[:3]] == [2, lines["A struct {"], lines["C[T any] interface{ M() }"]] and found[-1]["line"] == lines["func external(a int)"]


@pytest.mark.parametrize("source", ["", "func main() {}", "package", "package p\nfunc f() {", "package p\nfunc f() }", "package p\nvar s = `open", 'package p\nvar s = "open\n"', "package p\n/* open", "package p\nx := 1", "package p\nfunc f( {)}"])
def test_what_is_not_go_is_told(source):
    assert code.go_source(source) == ("parse_failed", [], [])


def test_go_sources_on_spark(spark):
    files = spark.createDataFrame([("a.go", GO), ("b.go", None), ("c.py", "package p"), ("d.GO", "package p\r\n\r\ntype T int\r\n")], "path string, text string")
    got = {r["file"]: (r["status"], [(s["name"], s["line"]) for s in r["symbols"]], r["imports"]) for r in code.go_syntax(files).collect()}
    assert set(got) >= {"a.go", "b.go"} and "c.py" not in got and got["b.go"] == ("parse_failed", [], []) and len(got["a.go"][1]) == 7
    assert got.get("d.GO", ("ok", [("p", 1), ("T", 3)], [])) == ("ok", [("p", 1), ("T", 3)], [])


@needs_data
def test_parts_are_dealt_over_tasks(spark, monkeypatch):
    """Rows of a few bytes, read in one task, are parsed in many."""
    monkeypatch.setattr(core, "PARTS_EACH", 50)
    n = core.table(spark, str(DATA), "part").count()
    assert core._many_parts(spark, str(DATA)).rdd.getNumPartitions() == -(-n // 50) > 1
