from __future__ import annotations

import json
import os
import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmere.operators import bounded, graph, inventory, selection
from quillmere.sources import scratch, treewalk

# ---- medians -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("few", "pivots"), [(10_000, 24), (6, 3), (1, 2)])
def test_medians_of_groups_of_any_size(spark, few, pivots):
    rng = random.Random(few)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(700)], "b": [3.0] * 300 + [5.0] * 300, "c": [1.0], "d": [1.0, 2.0], None: [float(rng.randrange(4)) for _ in range(401)], "e": [float(i) for i in range(90)] + [1e308, -1e308]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("a", None), ("none", None)]
    rng.shuffle(rows)
    got = {r["k"]: r["median"] for r in selection.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", few, pivots).collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_no_task_holds_more_than_a_few_rows_of_a_group(spark, monkeypatch):
    sizes, whole = [], selection._sorted

    def watched(rows, wanted, keys, on):
        found = selection._same(rows, wanted.select(*on).distinct(), on)
        sizes.extend(r["n"] for r in found.groupBy(*on).agg(F.count("*").alias("n")).collect())
        return whole(rows, wanted, keys, on)

    monkeypatch.setattr(selection, "_sorted", watched)
    got = selection.medians(spark.range(5000).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 5003).alias("v")), ["k"], "v", few=50, pivots=8)
    assert got.first()["median"] == statistics.median(i * 7919 % 5003 for i in range(5000))
    assert sizes and max(sizes) <= 50


def test_medians_of_nothing_and_of_one_group(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    assert [r["median"] for r in selection.medians(rows, [], "v").collect()] == [1.5]
    assert selection.medians(rows.where("v > 9"), [], "v").collect() == []
    r = inventory.usage_statistics(rows, [], "v").first()
    assert (r["measured"], r["unmeasured"], r["total"], r["median"]) == (2, 1, 3, 1.5)


# ---- places ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [None, 0, 1, 137, 5000])
def test_places_are_those_of_one_sort(spark, most):
    rows = spark.range(900).select((F.col("id") * 31 % 101).alias("a"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("n"), F.col("id"))).alias("b"))
    got = [(r["a"], r["b"], r["place"]) for r in bounded.placed(rows, [F.col("a").desc(), F.col("b").asc()], most).orderBy("place").collect()]
    wanted = sorted(((r["a"], r["b"]) for r in rows.collect()), key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    assert [g[:2] for g in got] == wanted[: len(wanted) if most is None else most] and [g[2] for g in got] == list(range(1, len(got) + 1))


# ---- the walk ----------------------------------------------------------------------------------------------------------


def plain_walk(paths, fits, kind, max_results=0, max_depth=0, max_visited=0):
    """The walk step by step."""
    entries = {"/".join(p.split("/")[:i]) for p in paths for i in range(1, p.count("/") + 2)}
    found, visited = [], 0

    def below(directory):
        own = sorted(e for e in entries if e.rpartition("/")[0] == directory)
        return [e for e in own if e not in paths], [e for e in own if e in paths]

    def enter(directory, depth):
        nonlocal visited
        dirs, files = below(directory)
        dirs = [] if max_depth and depth >= max_depth else dirs
        for of, group in (("directory", dirs), ("file", files)):
            for e in group if kind in (None, of) else []:
                if max_visited and visited >= max_visited:
                    return "scan"
                visited += 1
                if max_depth and e.count("/") + 1 > max_depth:
                    continue
                if fits(e):
                    found.append(e)
                    if max_results and len(found) > max_results:
                        return "results"
        for d in dirs:
            if ended := enter(d, depth + 1):
                return ended
        return None

    ended = enter("", 0)
    return found[: max_results or None], visited, ended == "results", ended == "scan"


def entries_of(spark, paths):
    return inventory.tree(spark.createDataFrame([(p,) for p in paths], "path string"), depth=20)


@pytest.mark.parametrize("how", [{}, {"max_visited": 4}, {"max_visited": 9, "kind": None}, {"max_results": 2}, {"max_results": 3, "max_visited": 7}, {"max_depth": 2, "kind": None}, {"max_visited": 1000, "max_results": 1000}, {"kind": "directory", "max_visited": 3}])
def test_find_is_the_walk(spark, how):
    rng = random.Random(str(how))
    parts = ["a", "a-", "a.b", "B", "aa", "é", "0", "ab", "\U0001f642", "￿"]
    paths = {"/".join([*(rng.choice(parts) for _ in range(rng.randint(0, 4))), f"f{rng.randrange(40)}.{rng.choice(['py', 'go'])}"]) for _ in range(70)}
    rows, told = bounded.find(entries_of(spark, paths), "*.py" if how.get("kind", "file") == "file" else "*", **how)
    t = told.first()
    fits = (lambda e: e.endswith(".py")) if how.get("kind", "file") == "file" else (lambda e: True)
    kind, limits = how.get("kind", "file"), {k: v for k, v in how.items() if k != "kind"}
    found, visited, cut, stopped = plain_walk(paths, fits, kind, **limits)
    got = [r["path"] for r in rows.orderBy("place").collect()]
    assert (got, t["returned"] if "max_results" in how else len(found), t["visited"], t["results_truncated"], t["scan_truncated"]) == (found, len(found), visited, cut, stopped)


def test_files_are_told_before_what_is_below(spark):
    rows, told = bounded.find(entries_of(spark, ["a/deep/x.md", "a/y.md", "b/z.md", "top.md"]), "*.md", max_visited=2)
    assert [r["path"] for r in rows.collect()] == ["top.md", "a/y.md"] and told.first()["scan_truncated"]


# ---- filters in the tree source -----------------------------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path: Path) -> Path:
    for p in ("top.py", "top.md", "src/a.py", "src/b.md", "src/deep/c.py", "src/deep/more/d.py", "docs/e.md", "docs/x/y/z/f.md", "node_modules/g.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * len(p))
    return tmp_path


def walked(root, only, monkeypatch):
    """Rows, directories opened, and files asked for their size."""
    opened, asked, scan, stat = [], [], os.scandir, os.stat
    reader = treewalk.TreeReader({"path": str(root), "only": json.dumps(only)})
    with monkeypatch.context() as m:
        m.setattr(treewalk.os, "scandir", lambda p: opened.append(os.path.relpath(p, root)) or scan(p))
        m.setattr(treewalk.os, "stat", lambda p, *a, **k: (asked.append(os.path.relpath(p, root)) if str(p).startswith(f"{root}/") else None) or stat(p, *a, **k))
        rows = [r for part in reader.partitions() for r in reader.read(part)]
    return {r[0] for r in rows}, set(opened), asked


def test_an_extension_stats_only_its_files(tree, monkeypatch):
    rows, _, asked = walked(tree, [("kind", "=", "file"), ("name", "ends", ".py")], monkeypatch)
    assert rows == {"top.py", "src/a.py", "src/deep/c.py", "src/deep/more/d.py"} == set(asked) and len(asked) == 4


def test_a_depth_closes_what_is_below(tree, monkeypatch):
    rows, opened, asked = walked(tree, [("depth", "<=", 2), ("kind", "=", "directory")], monkeypatch)
    assert rows == {"src", "docs", "src/deep", "docs/x"} and opened == {".", "src", "docs"} and asked == []
    assert walked(tree, [("depth", "<", 2)], monkeypatch)[1] == {"."}
    assert walked(tree, [("depth", "in", [1, 2])], monkeypatch)[1] == {".", "src", "docs"}


def test_a_path_opens_only_its_way(tree, monkeypatch):
    rows, opened, _ = walked(tree, [("path", "starts", "src/deep/")], monkeypatch)
    assert rows == {"src/deep/c.py", "src/deep/more", "src/deep/more/d.py"} and opened == {".", "src", "src/deep", "src/deep/more"}
    rows, opened, asked = walked(tree, [("path", "=", "docs/e.md")], monkeypatch)
    assert rows == {"docs/e.md"} and opened == {".", "docs"} and asked == ["docs/e.md"]


CONDITIONS = {
    "kind = 'file' AND name LIKE '%.py'": [("kind", "=", "file"), ("name", "ends", ".py")],
    "depth <= 2": [("depth", "<=", 2)],
    "depth < 2 AND kind = 'directory'": [("depth", "<", 2), ("kind", "=", "directory")],
    "size > 10": [("size", ">", 10)],
    "size <> 9": [("size", "<>", 9)],
    "path LIKE 'src/%' AND depth >= 3": [("path", "starts", "src/"), ("depth", ">=", 3)],
    "path IN ('top.py', 'src/b.md', 'zzz')": [("path", "in", ["top.py", "src/b.md", "zzz"])],
    "depth IN (1, 3)": [("depth", "in", [1, 3])],
    "name LIKE '%e%' AND depth = 2": [("name", "contains", "e"), ("depth", "=", 2)],
}


def test_conditions_leave_the_rows_of_a_filter(spark, tree):
    every = scratch.written(treewalk.tree_entries(spark, str(tree)), "entries")
    for condition, only in CONDITIONS.items():
        wanted = sorted(map(tuple, every.where(condition).collect()), key=str)
        assert wanted and sorted(map(tuple, treewalk.tree_entries(spark, str(tree), only).collect()), key=str) == wanted, condition


def test_parts_of_one_tree_may_meet_in_a_query(spark, tree):
    entries = treewalk.tree_entries(spark, str(tree))
    both = entries.where("name LIKE '%.py'").unionByName(entries.where("name LIKE '%.md'"))
    assert sorted(r["name"] for r in both.collect()) == ["a.py", "b.md", "c.py", "d.py", "e.md", "f.md", "top.md", "top.py"]
    with pytest.raises(ValueError, match="condition"):
        treewalk.TreeReader({"path": str(tree), "only": json.dumps([("status", "=", "ok")])})


def test_characters_that_a_file_really_has_are_kept(spark):
    raw = "a�b\x01a\x01b".encode() + b"\xff\xf0\x9f" + b"c\x01"
    read = spark.createDataFrame([("p", bytearray(raw))], "path string, content binary")
    assert treewalk.texts(read, "ignore").first()["text"] == "a�b\x01a\x01bc\x01"
    assert treewalk.texts(read, "replace").first()["text"].startswith("a�b\x01a\x01b�")


# ---- cycles and capped expansion -----------------------------------------------------------------------------------------


def components_of(edges):
    reach = {}
    for start in {x for e in edges for x in e}:
        seen, stack = set(), [start]
        while stack:
            x = stack.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    stack.append(b)
        reach[start] = seen
    parts = {s: [t for t in seen if s in reach[t]] for s, seen in reach.items() if s in seen}
    return {s: (min(p), len(p)) for s, p in parts.items()}


def cycles_of(spark, edges):
    return {r["id"]: (r["component"], r["size"]) for r in graph.cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}


def test_long_rings_and_chains_take_few_tables(spark, monkeypatch):
    tables, whole = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name, **o: tables.append(name) or whole(df, name, **o))
    monkeypatch.setattr(graph, "saved", scratch.written)
    n, order = 5000, list(range(5000))
    random.Random(1).shuffle(order)
    ring = [f"r{i:05}" for i in order]
    rings = [[f"n{4 * r + k:05}" for k in range(4)] for r in range(500)]
    edges = [(ring[i], ring[(i + 1) % n]) for i in range(n)] + [(g[k], g[(k + 1) % 4]) for g in rings for k in range(4)] + [(a[0], b[0]) for a, b in zip(rings, rings[1:])]
    assert cycles_of(spark, edges) == {**{x: ("r00000", n) for x in ring}, **{x: (g[0], 4) for g in rings for x in g}}
    assert len(tables) < 60


def test_a_line_of_mutual_pairs_is_merged(spark):
    pairs = [(f"{i:04}", f"{i + 1:04}") for i in range(200)]
    assert cycles_of(spark, [*pairs, *((b, a) for a, b in pairs)]) == {f"{i:04}": ("0000", 201) for i in range(201)}


@pytest.mark.parametrize(("seed", "n", "degree"), [(1, 30, 1.1), (2, 60, 1.4), (3, 40, 2.5)])
def test_random_graphs(spark, seed, n, degree):
    rng = random.Random(seed)
    edges = sorted({(f"{rng.randrange(n):02}", f"{rng.randrange(n):02}") for _ in range(int(n * degree))})
    assert cycles_of(spark, [*edges, (None, "00"), ("00", None)]) == components_of(edges)


def test_what_has_no_chains_is_parted_by_colours(spark):
    grid = [(f"{i}{j}", f"{(i + 1) % 5}{j}") for i in range(5) for j in range(5)] + [(f"{i}{j}", f"{i}{(j + 1) % 5}") for i in range(5) for j in range(5)]
    twice = grid + [(f"x{a}", f"x{b}") for a, b in grid] + [(a, f"x{a}") for a, _ in grid[:9]]
    assert cycles_of(spark, twice) == {**{a: ("00", 25) for a, _ in grid}, **{f"x{a}": ("x00", 25) for a, _ in grid}}


@pytest.mark.parametrize("most", [1, 2, 5, 9, 30, 500])
def test_capped_expansion_is_that_of_a_queue(spark, most):
    rng = random.Random(most)
    edges = sorted({(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(70)})
    near = {x: sorted({b for a, b in edges if a == x} | {a for a, b in edges if b == x}) for e in edges for x in e}
    start = edges[0][0]
    queue, placed, level, cut = [start], {start: 0}, [start], False
    for d in (1, 2, 3):
        found = list(dict.fromkeys(y for x in level for y in near[x] if y not in placed))
        cut = len(queue) + len(found) > most
        level = found[: most - len(queue)]
        queue += level
        placed |= dict.fromkeys(level, d)
        if cut or not level:
            break
    nodes = spark.createDataFrame([(x, "module", x) for x in near], "id string, kind string, name string")
    e = graph.expand(nodes, spark.createDataFrame([(a, b, "depends_on") for a, b in edges], "src string, dst string, kind string"), start, depth=3, max_nodes=most)
    assert {r["id"]: r["distance"] for r in e.nodes.collect()} == placed and e.truncated is cut


def test_shuffles_have_partitions_by_the_size_of_the_input(spark, monkeypatch):
    key = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(scratch, "written", lambda df, name: seen.append((name, int(spark.conf.get(key)))) or df)
    for rows in (0, int(before) * scratch.ROWS_EACH, int(before) * scratch.ROWS_EACH + 1):
        scratch.written_by_size(spark.range(1), f"of {rows}", rows)
        assert spark.conf.get(key) == before
    assert [n for _, n in seen] == [int(before), int(before), int(before) + 1]
