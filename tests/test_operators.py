from __future__ import annotations

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions.globs import mapping_glob, path_glob, rule_glob
from quillmere.operators import changes, code, graph, inventory, policy, text
from quillmere.operators.bounded import bounded
from quillmere.sources import adapters, index_store, scratch, treewalk
from quillmere.streaming import streams


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("**/core/**", "core/x", False), ("**/core/**", "a/core/x", True), ("*.py", "a/b.py", False), ("a?c", "abc", True)],
)
def test_mapping_globs(glob, path, hit):
    assert bool(re.match(mapping_glob(glob), path)) == hit


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/core/*", "core/x", True), ("**/core/*", "a/b/core/x", True), ("src/**", "src/a/b", True), ("src/*", "src/a/b", False), ("a+b", "a+b", True)])
def test_rule_globs(glob, path, hit):
    assert bool(re.match(rule_glob(glob), path)) == hit


@given(st.text(alphabet="ab.*?/+(", max_size=8), st.text(alphabet="ab./+(", max_size=8))
def test_globs_always_compile(glob, path):
    for compiled in (path_glob(glob), rule_glob(glob), mapping_glob(glob)):
        re.match(compiled, path)


def test_lines_of_odd_texts(spark):
    rows = docs(spark, "a\r\nb\rc\n", "", None, "\n", "x").select(C.lines_of(F.col("text")).alias("l")).collect()
    assert [r["l"] for r in rows] == [["a", "b", "c"], [], [], [""], ["x"]]


def test_search_surroundings_are_clipped_and_may_overlap(spark):
    found = text.search(docs(spark, "a\nhit\nhit\nb"), text.literal("hit"), before=2, after=1).orderBy("line").collect()
    assert [(r["line"], r["before"], r["after"]) for r in found] == [(2, ["a"], ["hit"]), (3, ["a", "hit"], ["b"])]


def test_log_signal_word_needs_its_end(spark):
    rows = docs(spark, "ng\nbang\nsinging\nan Error\nang x").select(F.explode(C.lines_of(F.col("text"))).alias("t"))
    assert [r["t"] for r in rows.where(text.log_signal(F.col("t"))).collect()] == ["ng", "bang", "singing", "an Error", "ang x"]
    assert docs(spark, "ngé").where(text.log_signal(F.col("text"))).count() == 1
    assert docs(spark, "ngx").where(text.log_signal(F.col("text"))).count() == 0


def test_duplicates_need_two_documents_and_count_all_lines(spark):
    line = "This long line is in two documents, with some more words."
    found = text.duplicates(docs(spark, f"{line}\n# {line.upper()}", f"x\n{line}", "y" * 60 + "\n" + "y" * 60)).collect()
    assert [(r["occurrence_count"], r["first_key"], r["first_line"], [tuple(o) for o in r["occurrences"]]) for r in found] == [(3, 0, 1, [(0, 1), (0, 2), (1, 2)])]


def test_duplicates_flag_is_only_set_when_something_was_left_out(spark):
    d = docs(spark, *["The very same line that is in every one of the documents."] * 3)
    assert [text.duplicates(d, max_occurrences=n).first()["occurrences_truncated"] for n in (2, 3)] == [True, False]


@pytest.mark.parametrize(("n", "truncated"), [(2, True), (3, False), (None, False)])
def test_bounded(spark, n, truncated):
    b = bounded(docs(spark, "a", "b", "c"), [F.col("doc_id")], n)
    s = b.summary.first()
    assert (b.rows.count(), s["total"], s["returned"], s["truncated"]) == (n or 3, 3, n or 3, truncated)
    with pytest.raises(ValueError, match="limit"):
        bounded(docs(spark, "a"), [F.col("doc_id")], -1)


def test_policy_suppression(spark):
    files = spark.createDataFrame(
        [("a.py", "bad\nbad # policy-ignore r: known\n# policy-ignore r: next\nbad\nbad policy-ignore r"), ("b.md", "bad"), ("sub/c.py", "fine")], "path string, text string"
    )
    rules = [policy.Rule("r", paths=("**/*.py",), forbid="bad"), policy.Rule("q", paths=("sub/*",), severity="warning", require="must")]
    found = policy.policy_check(files, rules)
    got = sorted((r["path"], r["rule_id"], r["line"] or 0, r["suppressed"], r["reason"]) for r in found.collect())
    assert got == [("a.py", "r", 1, False, None), ("a.py", "r", 2, True, "known"), ("a.py", "r", 4, True, "next"), ("a.py", "r", 5, False, ""), ("sub/c.py", "q", 0, False, None)]
    s = policy.policy_summary(files, found, rules).first()
    assert (s["error_count"], s["warning_count"], s["suppression_count"], s["invalid_suppression_count"], s["files_scanned"], s["distinct_files_scanned"], s["status"]) == (2, 1, 2, 1, 3, 2, "violations")
    with pytest.raises(ValueError, match="severity"):
        policy.Rule("x", severity="odd", forbid="a")


def test_validation_terms_are_whole_parts(spark):
    paths = spark.createDataFrame([("build/x",), ("src/ui/view.gd",), ("a/parser.py",)], "path string")
    plans = {r["path"]: r["v"] for r in paths.select("path", changes.validation_plan(F.col("path")).alias("v")).collect()}
    assert plans["build/x"] == ["targeted validation"]
    assert plans["src/ui/view.gd"][0] == "headless smoke if possible" and len(set(plans["src/ui/view.gd"])) == len(plans["src/ui/view.gd"])
    assert plans["a/parser.py"] == ["targeted regression tests", "contract/spec check", "targeted tests", "syntax/build check"]


def test_router_short_and_empty_stems(spark):
    files = spark.createDataFrame([("tests/test_ab.py",), ("docs/cab.md",), ("tests/x_test.py",)], "path string")
    changed = spark.createDataFrame([("src/ab.py",), (".env",)], "path string")
    got = {(r["changed_file"], r["kind"], r["path"]) for r in changes.change_router(changed, files).collect()}
    assert got == {("src/ab.py", "test", "tests/test_ab.py"), ("src/ab.py", "doc", "docs/cab.md")}


def test_stems_are_found_in_names_as_contains_says(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab\u00e9_") for _ in range(n))
    stems, names = {word(rng.randint(1, 5)) for _ in range(40)}, {word(rng.randint(1, 9)) for _ in range(60)}
    got = changes.contained(spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted(map(tuple, got)) == sorted((s, n) for s in stems for n in names if s in n)


def test_incomplete_maps_widen_the_fallback(spark):
    files = spark.createDataFrame([("tests/test_a.py",), ("src/a.py",)], "path string")
    changed = spark.createDataFrame([("src/a.py",)], "path string")
    imports = spark.createDataFrame([("tests/test_b.py", "pkg.src.a")], "file string, target string")
    whole = changes.affected_tests(changed, files, imports).first()
    assert whole["tests"] == ["tests/test_a.py", "tests/test_b.py"] and whole["confidence"] == "medium" and not whole["fallback"]
    assert changes.affected_tests(changed, files, imports, complete=False).first()["fallback"]


def test_render_keeps_what_has_no_value(spark):
    out, missing = changes.render(F.lit("{{a}}-{{ b }}-{{a}}"), F.create_map(F.lit("a"), F.lit("1")))
    assert tuple(spark.range(1).select(out, missing).first()) == ("1-{{ b }}-1", ["b"])


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a")]


def edges_of(spark, pairs, kind="depends_on"):
    return spark.createDataFrame([(*p, kind) for p in pairs], "src string, dst string, kind string")


def test_cycles(spark):
    got = {(r["id"], r["component"], r["size"]) for r in graph.cycles(edges_of(spark, EDGES)).collect()}
    assert got == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2), ("f", "f", 1)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), min_size=1, max_size=8))
def test_cycles_match_a_closure(spark, pairs):
    reach = {(a, b) for a, b in pairs}
    while new := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= new
    wanted = {(a, min(b for b in "abcde" if (a, b) in reach and (b, a) in reach)) for a in "abcde" if (a, a) in reach}
    assert {(r["id"], r["component"]) for r in graph.cycles(edges_of(spark, pairs)).collect()} == wanted


def test_affected_counts_everything_and_tells_what_is_uncertain(spark):
    nodes = spark.createDataFrame([(f"m{x}", "module", x, None) for x in "abc"] + [(f"f{x}", "file", x, f"{x}.py") for x in "abc"], "id string, kind string, name string, path string")
    edges = edges_of(spark, [("ma", "mb"), ("mc", "ma")]).unionByName(edges_of(spark, [(f"m{x}", f"f{x}") for x in "abc"], "contains_file"))
    changed = spark.createDataFrame([("./b.py",)], "path string")
    got = graph.affected(nodes, edges, changed)
    assert [(r["id"], r["distance"]) for r in got.modules.collect()] == [("mb", 0), ("ma", 1), ("mc", 2)]
    assert got.summary.first()["recommended_scope"] == "targeted_dependents"
    cut = graph.affected(nodes, edges, changed.unionByName(spark.createDataFrame([("zz.py",)], "path string")), 2)
    s = cut.summary.first()
    assert cut.modules.count() == 2 and s["affected_total"] == 3 and s["affected_truncated"] and s["recommended_scope"] == "broader_or_full" and s["unmatched_count"] == 1


def test_expand_keeps_the_first_and_tells(spark):
    nodes = spark.createDataFrame([(x, "module", x) for x in "abcd"], "id string, kind string, name string")
    e = graph.expand(nodes, edges_of(spark, EDGES), "c", depth=2, max_nodes=3)
    assert e.truncated and {r["id"] for r in e.nodes.collect()} == {"c", "a", "b"}
    assert {r["kind"] for r in graph.expand(nodes, edges_of(spark, EDGES), "d", depth=1).nodes.where("id = 'e'").collect()} == {"unknown"}
    with pytest.raises(ValueError, match="direction"):
        graph.expand(nodes, edges_of(spark, EDGES), "c", direction="up")


def test_expand_without_a_bound_collects_nothing(spark, monkeypatch):
    nodes = spark.createDataFrame([(x, "module", x) for x in "abcd"], "id string, kind string, name string")
    edges = edges_of(spark, EDGES)
    wanted = graph.expand(nodes, edges, "c", depth=2, max_nodes=1000)
    with monkeypatch.context() as m:
        m.setattr(type(edges), "collect", lambda self: pytest.fail("collected"))
        got = graph.expand(nodes, edges, "c", depth=2, max_nodes=None)
    assert not got.truncated and "Broadcast" not in got.edges._jdf.queryExecution().analyzed().toString() and "hint" not in got.edges._jdf.queryExecution().logical().toString().lower()
    assert sorted(map(tuple, got.nodes.collect())) == sorted(map(tuple, wanted.nodes.collect()))
    assert sorted(map(tuple, got.edges.collect())) == sorted(map(tuple, wanted.edges.collect()))


def test_resolve(spark):
    nodes = spark.createDataFrame([("x", "m", "core", "core", None), ("y", "m", "core_ui", "core_ui", None), ("z", "m", "other", "other", None)], "id string, kind string, name string, qualified_name string, path string")
    assert graph.resolve(nodes, "CORE") == ("ok", ["x"])
    assert graph.resolve(nodes, "cor") == ("ambiguous", ["x", "y"])
    assert graph.resolve(nodes, "nope") == ("not_found", [])


def test_references_are_normalized(spark):
    rows = spark.createDataFrame([("a/b", "..\\c\\d.csproj"), ("", "x.csproj"), ("a", "../../out.csproj")], "d string, r string")
    got = [r[0] for r in rows.select(graph.normalized_reference(F.col("d"), F.col("r"))).collect()]
    assert got == ["a/c/d.csproj", "x.csproj", "../../out.csproj"]


def test_symbols_and_dependencies_by_language(spark):
    files = spark.createDataFrame(
        [
            ("a.go", 'package x\nimport (\n  "fmt"\n  y "a/b"\n)\nfunc (t T) Run() {\n}\ntype Q struct {'),
            ("b.c", '#include <stdio.h>\n#include "x/y.h"\nint main(void) {\n  if (a) {\nstruct Point {'),
            ("c.gd", 'extends "res://base.gd"\nvar x = 1\nfunc go():\n  load("res://s.tscn")\nsignal done'),
            ("d.cs", "namespace A.B\npublic class C {\n  public void Run(int x) {"),
            ("p.csproj", '<ProjectReference Include="..\\q\\q.csproj" />'),
        ],
        "path string, text string",
    )
    found = {lang: sorted((r["kind"], r["name"]) for r in code.symbols(files, lang).collect()) for lang in ("go", "c", "gdscript", "csharp")}
    assert found["go"] == [("func", "Run"), ("type", "Q")]
    assert found["c"] == [("func", "main"), ("type", "Point")]
    assert found["gdscript"] == [("func", "go"), ("signal", "done"), ("var", "x")]
    assert found["csharp"] == [("class", "C"), ("method", "Run"), ("namespace", "A.B")]
    targets = {lang: {r["file"]: r["targets"] for r in code.dependencies(files, lang).collect()} for lang in ("go", "c", "gdscript", "csharp")}
    assert targets["go"]["a.go"] == ["a/b", "fmt"]
    assert targets["c"]["b.c"] == ["stdio.h", "x/y.h"]
    assert targets["gdscript"]["c.gd"] == ["res://base.gd", "res://s.tscn"]
    assert targets["csharp"]["p.csproj"] == ["../q/q.csproj"]


def test_structural_search_unifies_repeated_names(spark):
    files = spark.createDataFrame([("a.py", "x = f(1, 1)\ny = f(1, 2)\n"), ("b.py", "def (")], "path string, text string")
    got = code.structural_search(files, "f($A, $A)").collect()
    assert sorted((r["file"], r["status"], r["line"]) for r in got) == [("a.py", "ok", 1), ("b.py", "parse_failed", None)]
    assert [r["captures"] for r in got if r["status"] == "ok"] == [{"A": "1"}]
    with pytest.raises(ValueError, match="several"):
        code.structural_search(files, "f($$$A)")


def test_python_ast_keeps_relative_dots(spark):
    files = spark.createDataFrame([("a.py", "from ..b import c\nimport d.e\nclass K:\n    async def m(self): pass\n"), ("b.py", "def x(:")], "path string, text string")
    rows = {r["file"]: r for r in code.python_ast(files).collect()}
    assert rows["a.py"]["imports"] == ["..b", "d.e"] and [(s["kind"], s["name"], s["line"]) for s in rows["a.py"]["symbols"]] == [("class", "K", 3), ("async_func", "m", 4)]
    assert rows["b.py"]["status"] == "parse_failed"


def test_adapters(spark):
    one = lambda payload: spark.createDataFrame([(json.dumps(payload),)], "json string")
    scip = {
        "documents": [
            {"relativePath": "a.py", "language": "python", "symbols": [{"symbol": "p/A#", "displayName": "A"}], "occurrences": [{"symbol": "p/A#", "range": [4, 0, 5], "symbolRoles": 1}]},
            {"relativePath": "b.py", "language": "python", "symbols": [], "occurrences": [{"symbol": "p/A#", "range": [1, 0, 2], "symbolRoles": 0}]},
        ]
    }
    symbols, edges = adapters.scip_graph(one(scip))
    assert [(r["file"], r["name"], r["line"]) for r in symbols.collect()] == [("a.py", "A", 5)]
    assert [tuple(r) for r in edges.collect()] == [("b.py", "a.py", "depends_on")]
    tags = spark.createDataFrame([(json.dumps(t),) for t in ({"_type": "tag", "name": "K", "path": "a.py", "line": 1}, {"_type": "tag", "name": "m", "path": "a.py", "scope": "K"}, {"_type": "ptag"}, {"name": "x"})], "json string")
    _, owned, skipped = adapters.ctags_symbols(tags)
    assert {tuple(r) for r in owned.collect()} == {("a.py", "a.py::K", "owns"), ("a.py::K", "a.py::K::m", "owns")} and skipped.first()[0] == 1
    outline = [{"path": "a.py", "language": "python", "items": [{"name": "K", "symbolType": "class", "members": [{"name": "m", "members": [{"name": "deep"}]}]}]}]
    assert [r["qualified_name"] for r in adapters.outline_symbols(one(outline)).collect()] == ["a.py::K", "a.py::K::m", "a.py::K::m::deep"]
    metrics = adapters.flat_metrics(spark.createDataFrame([(1, '{"a": {"value": 3, "levelOfConcern": 2, "b": [{"value": 1}]}}'), (2, "nope")], "id long, json string"), "id")
    assert sorted((r["key"], r["metric"] or "", r["value"] or 0) for r in metrics.collect()) == [(1, "a", 3.0), (1, "a.b[0]", 1.0), (2, "", 0)]
    assert adapters.concerns(metrics).count() == 1


def test_json_lines_fail_on_a_bad_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[2]\n')
    assert sorted(r["line"] for r in adapters.json_lines(spark, str(tmp_path / "a.jsonl")).select("line").collect()) == [1, 3]
    (tmp_path / "b.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="not JSON.*b.jsonl, line 1: .oops"):
        adapters.json_lines(spark, str(tmp_path / "b.jsonl")).collect()


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    lines = [f'{{"n": {i}, "x": "{"y" * (i % 40)}"}}' if i % 9 else "" for i in range(1, 4001)]
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines))
    (tmp_path / "in" / "c.jsonl").write_text("")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        found = adapters.json_lines(spark, str(tmp_path / "in"))
        assert found.rdd.getNumPartitions() > 10
        got = sorted((r["file"][-7:-6], r["line"], r["n"]) for r in found.select("file", "line", F.expr("value:n::int").alias("n")).collect())
        assert got == [(f, i, i) for f in "ab" for i in range(1, 4001) if i % 9]
        lines[3210] = '{"n": '
        (tmp_path / "in" / "b.jsonl").write_text("\n".join(lines))
        with pytest.raises(Exception, match="b.jsonl, line 3211: "):
            adapters.json_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_index_round_trip_and_format(spark, tmp_path):
    nodes, edges = adapters.index_nodes(spark.createDataFrame([("pkg/__init__.py",), ("a.txt",)], "path string"))
    with pytest.raises(ValueError, match="no index"):
        index_store.read_index(spark, str(tmp_path / "i"))
    index_store.write_index(graph.merge_nodes(nodes), graph.merge_edges(edges), str(tmp_path / "i"))
    n, e, meta = index_store.read_index(spark, str(tmp_path / "i"))
    assert {r["id"] for r in n.collect()} == {"file:pkg/__init__.py", "file:a.txt", "module:pkg"} and e.count() == 1 and not meta["input_truncated"]
    spark.createDataFrame([(9, "x", "other/9", False, 0)], index_store.MANIFEST).write.mode("append").parquet(str(tmp_path / "i/manifest"))
    with pytest.raises(ValueError, match="format"):
        index_store.read_index(spark, str(tmp_path / "i"))


def test_an_index_that_fails_half_way_leaves_the_last_one(spark, tmp_path):
    one = spark.createDataFrame([("a", "b", "depends_on")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("a", "module")], "id string, kind string")
    index_store.write_index(nodes, one, str(tmp_path / "i"))
    first = index_store.read_index(spark, str(tmp_path / "i"))
    broken = one.withColumn("src", F.when(F.col("src") == "a", F.raise_error(F.lit("lost"))).otherwise(F.col("src")))
    with pytest.raises(Exception, match="lost"):
        index_store.write_index(nodes.withColumn("kind", F.lit("new")), broken, str(tmp_path / "i"))
    n, e, meta = index_store.read_index(spark, str(tmp_path / "i"))
    assert n.first()["kind"] == "module" and e.count() == 1 and meta["number"] == 1
    index_store.write_index(nodes.withColumn("kind", F.lit("newer")), one.limit(0), str(tmp_path / "i"), input_truncated=True)
    n, e, meta = index_store.read_index(spark, str(tmp_path / "i"))
    assert n.first()["kind"] == "newer" and e.count() == 0 and meta["number"] == 2 and meta["input_truncated"]
    assert first[0].first()["kind"] == "module"  # who reads the version before goes on reading it


def test_tree_keeps_dotfiles_and_prunes(spark, tmp_path):
    for name, data in {".env": b"x", "pkg/__init__.py": b"a\nb", "pkg/Build/gone.py": b"", "node_modules/x.js": b"", "bin.dat": b"\x00\x01", "bad.txt": b"\xffok"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    entries = treewalk.tree_entries(spark, str(tmp_path))
    assert {r["path"] for r in entries.where("kind = 'file'").collect()} == {".env", "pkg/__init__.py", "bin.dat", "bad.txt"}
    read = {r["path"]: r for r in treewalk.texts(treewalk.contents(entries, str(tmp_path))).collect()}
    assert read["bin.dat"]["is_binary"] and read["bin.dat"]["text"] is None and read["bad.txt"]["text"] == "\ufffdok"
    assert treewalk.texts(treewalk.contents(entries, str(tmp_path)), "strict").where("path = 'bad.txt'").first()["text"] is None


def test_usage_median_of_an_even_number(spark):
    rows = spark.createDataFrame([("a", 1000), ("a", 2000), ("a", 3200), ("a", 9000), ("a", None)], "k string, v long")
    r = inventory.usage_statistics(rows, ["k"], "v").first()
    assert (r["median"], r["measured"], r["unmeasured"], r["largest"]) == (2600.0, 4, 1, 9000)


def test_low_value_shows_the_topmost_directory(spark):
    files = spark.createDataFrame([("a/build/tmp/x.o",), ("a/build/y",), ("b.log",), ("c.py",)], "path string")
    assert {tuple(r) for r in inventory.low_value(files).collect()} == {("a/build", "directory", "directory_name:build"), ("b.log", "file", "extension:.log")}


def test_stream_of_a_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("fine\nan error here\nWARN x\n")
    found = streams.log_findings(spark.readStream.text(str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("findings").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT count(*) FROM findings").first()[0] == 2


def test_git_results_are_parsed(spark, tmp_path):
    from quillmere.sources import git

    lines = spark.createDataFrame([('"a b.py"',), ("./x\\y.py",), ("",)], "line string")
    assert {r["path"] for r in git.changed_paths(lines).collect()} == {"a b.py", "x/y.py"}
    status = spark.createDataFrame([(" M a.py",), ("R  old.py -> new.py",), ("?? z",)], "line string")
    assert {tuple(r) for r in git.status_rows(status).collect()} == {(" ", "M", "a.py"), ("R", " ", "new.py"), ("?", "?", "z")}
    stat = spark.createDataFrame([(" 3 files changed, 10 insertions(+), 2 deletions(-)",), (" 1 file changed, 1 deletion(-)",)], "line string")
    assert sorted(tuple(r) for r in git.shortstat(stat).collect()) == [(1, 0, 1), (3, 10, 2)]
    assert git.git_lines(spark, str(tmp_path), "status").status in ("git_query_failed", "git_unavailable")


def test_context_pack_tells_failures_apart_from_nothing(spark):
    from quillmere.operators import reports

    none = spark.createDataFrame([], "line string")
    many = spark.createDataFrame([(f"f{i}",) for i in range(5)], "line string")
    report = reports.context_pack({"Goal": "g"}, many, None, limit=2).first()["report"]
    assert "- f0\n- f1\n- and more" in report and report.endswith("## Status\n- unavailable")
    assert reports.context_pack({"Goal": "g"}, none, none).first()["report"].endswith("- none\n\n## Status\n- clean")


def test_routing_narrows_only_when_a_task_tells_something(spark):
    from quillmere.operators import routing

    summary = spark.createDataFrame([(5000, 3, 0, 0, "large", ["rule_heavy"], False)], "file_count long, doc_count long, test_count long, large_count long, size_class string, project_types array<string>, has_git boolean")
    every = routing.recommend(summary)
    names = {r["operator"] for r in every.collect()}
    assert {"graph_expand", "policy_index", "change_router"} <= names and not names & {"validation_plan", "commit_delta"}
    assert routing.narrow(every, {"goal": False}).count() == len(names)
    assert {r["operator"] for r in routing.narrow(every, {"goal": True, "task_file": True}).collect()} == {"search", "glob_filter", "sections", "heading_index", "stop_check"}


def test_many_chained_rings_are_all_found(spark):
    rings = [[f"n{4 * r + k:05}" for k in range(4)] for r in range(150)]
    edges = [(ring[k], ring[(k + 1) % 4]) for ring in rings for k in range(4)] + [(a[0], b[0]) for a, b in zip(rings, rings[1:])] + [("tail", rings[0][0]), ("self", "self")]
    got = {r["id"]: (r["component"], r["size"]) for r in graph.cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**{n: (ring[0], 4) for ring in rings for n in ring}, "self": ("self", 1)}


def test_closures_of_many_levels(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(20)], "src string, dst string")
    got = {r["id"]: r["distance"] for r in graph.closure(edges, spark.createDataFrame([("000",)], "id string")).collect()}
    assert got == {f"{i:03}": i for i in range(21)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.scratch_path(Session(), "x")


# Files and characters that a fixture of 15 files has, that three tasks are left with, and percents saved.
BASE, LEFT = (15, 4826), ((3, 1328, 72.5), (3, 1032, 78.6), (3, 1183, 75.5))


def test_reductions_are_those_of_the_published_benchmark(spark):
    rows = spark.createDataFrame([(n, c, p) for n, c, p in LEFT], "files long, chars long, percent double")
    got = rows.select(inventory.reduction(F.lit(BASE[0]), F.col("files")).alias("f"), inventory.reduction(F.lit(BASE[1]), F.col("chars")).alias("c"), "percent").collect()
    assert all(r["f"] == 80.0 and r["c"] == r["percent"] for r in got)
    whole = rows.agg(F.sum("files").alias("files"), F.sum("chars").alias("chars")).select(inventory.reduction(F.lit(3 * BASE[0]), F.col("files")), inventory.reduction(F.lit(3 * BASE[1]), F.col("chars")), "chars").first()
    assert tuple(whole) == (80.0, 75.5, 3543)


def test_evidence_that_is_required(spark):
    selected = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "task string, path string")
    required = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "z"), ("c", "x"), ("c", "x")], "task string, path string")
    got = {r["task"]: (r["required_count"], r["missing_count"], r["complete"]) for r in changes.evidence_complete(selected, required).collect()}
    assert got == {"a": (1, 0, True), "b": (2, 1, False), "c": (1, 1, False)}


def test_results_by_language(spark, tmp_path):
    index_store.write_by_language(spark.createDataFrame([("go", 1), ("python", 2)], "language string, n int"), f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["language=go", "language=python"]
    assert index_store.as_json(spark.createDataFrame([(1, "x")], "a int, b string")).first()["json"] == '{"a":1,"b":"x"}'


def test_duplicates_of_no_and_of_odd_rows(spark):
    line = "the same long line of more than fifty characters, twice or more"
    found = text.duplicates(docs(spark, line, None, f"x\n- {line.upper()}\n", line, f"{line} but other", ids=[4, 5, 2, 4, 9])).collect()
    assert [(r["occurrence_count"], r["first_key"], r["first_line"], r["repeated_text"]) for r in found] == [(3, 2, 2, f"- {line.upper()}")]
    assert text.duplicates(docs(spark, line, line, ids=[1, 1])).count() == 0


def test_cuts_in_bytes(spark):
    got = spark.range(1).select(C.cut_bytes(F.lit("aéé"), 3).alias("a"), C.cut_bytes(F.lit("aéé"), 4).alias("b"), C.cut_bytes(F.lit("aé"), 3).alias("c")).first()
    assert tuple(got) == ("aé", "aé\ufffd", "aé")
    log = text.compact_log(docs(spark, "error " + "é" * 10), width=9, in_bytes=True).first()
    assert log["findings"][0]["text"] == "error é\ufffd"


def test_a_deep_tree_is_walked_in_parts(spark, tmp_path, monkeypatch):
    for i in range(3):
        for j in range(4):
            (tmp_path / f"d{i}" / f"e{j}" / "f").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f" / "x.txt").write_text("x" * j)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "top.txt").write_text("1")
    for walks in (2, 10, 128):
        monkeypatch.setattr(treewalk, "WALKS", walks)
        parts = treewalk.TreeReader({"path": str(tmp_path)})
        rows = [r for p in parts.partitions() for r in parts.read(p)]
        assert len(rows) == len(set(rows)) == 3 + 12 + 12 + 12 + 1 and all(r[5] == "ok" for r in rows)
        assert walks > 12 or len(parts.partitions()) >= walks


def test_nul_behind_wide_characters(spark):
    """A NUL behind 4096 bytes but within as many characters."""
    files = docs(spark, "é" * 3000 + "\0")
    assert inventory.stats(files, F.lit("x"), characters=True).first()["binary_files"] == 1
    assert inventory.stats(files, F.lit("x")).first()["binary_files"] == 0


def test_paths_listed_again_are_joined_once(spark):
    """Copies of paths and imports are one before the join, which their numbers would multiply."""
    paths = spark.createDataFrame([("a/b.py",)] * 30 + [("c.py",)], "path string")
    imports = spark.createDataFrame([("c.py", "a.b")] * 30 + [("a/b.py", "b.py")], "file string, target string")
    found = changes.dependency_consumers(paths, imports)
    assert sorted(tuple(r) for r in found.collect()) == [("a/b.py", "c.py")]
    joined = found._jdf.queryExecution().optimizedPlan().toString().partition("Join")[2]
    assert joined.count("Aggregate [") == 3  # the paths, the imports and their endings


def test_terms_are_sought_from_their_first_character(spark):
    """As by the pattern with spelled out bounds; a text is lower-cased once for all checks."""
    texts = ["", "the", "The x", "thethe the", "_the the_", "a the\n", "é the é", "9the the9", "atheb", "c++ x", "xc++", "c++9 c++", "目的地", "le les", "the\u2028"]
    terms = {"a": ("the", "c++"), "b": ("les", "目的"), "c": ("the",)}
    found = text.stop_check(docs(spark, *texts), terms, ("a",))
    spelled = lambda t, ts: any(re.search(f"(^|[^a-z0-9_]){re.escape(x)}([^a-z0-9_]|$)", t.lower()) if x.isascii() else x in t for x in ts)
    assert {r["key"]: (r["has_a"], r["has_b"], r["has_c"]) for r in found.collect()} == {i: tuple(bool(spelled(t, ts)) for ts in terms.values()) for i, t in enumerate(texts)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
