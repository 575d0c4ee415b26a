"""The structure graph: nodes(id, kind, name, qualified_name, path, symbol_kind, line, end_line), edges(src, dst, kind).

Closures grow a frontier: each level is one join of the frontier with the edges and an anti-join with what was seen,
written to the session's checkpoint folder, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.operators.bounded import checked, placed
from quillmere.sources.scratch import counted, small_or_shuffled
from quillmere.sources.scratch import written as saved

NODE_FIELDS = ("kind", "name", "qualified_name", "path", "symbol_kind", "line", "end_line")


def merge_nodes(nodes: DataFrame, order: str = "source_ord") -> DataFrame:
    """One node an id: of each field the first value that isn't null or empty, in the order of the sources."""
    def first(name: str) -> Column:
        known = F.col(name).isNotNull() & (F.col(name).cast("string") != "")
        return F.min_by(F.when(known, F.col(name)), F.when(known, F.col(order))).alias(name)

    return nodes.groupBy("id").agg(*(first(c) for c in NODE_FIELDS if c in nodes.columns))


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.coalesce("kind", F.lit("depends_on")).alias("kind")).distinct()


def query(nodes: DataFrame, text: str) -> DataFrame:
    """id, kind, name, match_rank: 0 exact, 1 prefix, 2 contained, over id, qualified name, name and path, without case."""
    values = F.array(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "qualified_name", "name", "path")))
    low = text.lower()
    rank = F.when(F.exists(values, lambda v: v == low), 0).when(F.exists(values, lambda v: v.startswith(low)), 1).when(F.exists(values, lambda v: v.contains(low)), 2)
    return nodes.select("id", "kind", "name", rank.alias("match_rank")).where("match_rank is not null")


def resolve(nodes: DataFrame, text: str, max_candidates: int = 20) -> tuple[str, list[str]]:
    """ok and one id, or ambiguous and the first candidates, or not_found."""
    found = query(nodes, text)
    for match in ("match_rank = 0", "true"):
        ids = [r["id"] for r in found.where(match).orderBy("id").limit(max(2, max_candidates)).collect()]
        if ids:
            return ("ok" if len(ids) == 1 else "ambiguous"), ids[:max_candidates]
    return "not_found", []


#: Levels of a closure after which what was seen is one table again.
LEVELS = 8


def node_order() -> list[Column]:
    return [F.col("id")]


def edge_order() -> list[Column]:
    return [F.col("src"), F.col("dst"), F.col("kind")]


def match_order() -> list[Column]:
    return [F.col("match_rank"), F.col("id")]


def distance_order() -> list[Column]:
    return [F.col("distance"), F.col("id")]


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, distance: all that is reached from seeds(id) along edges(src, dst), by the least number of steps."""
    seen = saved(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "closure")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = saved(reached.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % LEVELS == 0:
            seen = saved(seen, "closure")
    return seen


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


class Expansion(NamedTuple):
    nodes: DataFrame  # id, distance, kind, name, fan_in, fan_out
    edges: DataFrame  # with both ends among the nodes
    truncated: bool


def expand(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, max_nodes: int | None = 80, direction: str = "both") -> Expansion:
    """The neighbourhood of a node: a level keeps the ids that come first by the place of a parent in the queue, then by
    id. Ids that the index lacks are of kind unknown; fan-in and fan-out are over the whole index."""
    steps = _directed(edges, direction)
    if max_nodes is None:
        # of any size, so nothing is collected; without a bound the order of the queue decides nothing
        visited = closure(steps, nodes.sparkSession.createDataFrame([(start,)], "id string"), depth)
        return _expansion(nodes, edges, visited, lambda ends: ends, False)
    # the queue is a table: each level is ranked by range partitions, so neither the driver nor a task holds all of it
    checked(max_nodes)
    visited = saved(nodes.sparkSession.createDataFrame([(start, 0, 1)], "id string, distance int, place long"), "queue")
    count, truncated, level = 1, False, visited
    for distance in range(1, depth + 1):
        parents = level.select(F.col("id").alias("src"), "place")
        found = parents.join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.min("place").alias("parent")).join(visited.select("id"), "id", "left_anti")
        level, n = counted(placed(found, [F.col("parent").asc(), F.col("id").asc()], max_nodes - count + 1).select("id", F.lit(distance).alias("distance"), "place"), "queue")
        if n > max_nodes - count:
            level, truncated = level.where(F.col("place") <= max_nodes - count), True
        visited, count = visited.unionByName(level), count + n
        if not n or truncated:
            break
    return _expansion(nodes, edges, saved(visited.select("id", "distance"), "queue"), small_or_shuffled, truncated)


def _expansion(nodes: DataFrame, edges: DataFrame, visited: DataFrame, hinted: Callable[[DataFrame], DataFrame], truncated: bool) -> Expansion:
    """Of visited(id, distance); hinted says how its ids are joined with the edges."""
    inner = edges
    for end in ("src", "dst"):
        inner = inner.join(hinted(visited.select(F.col("id").alias(end))), end, "left_semi")
    inner = inner.select("src", "dst", "kind")
    fans = fan_counts(edges)
    shown = visited.join(nodes.select("id", "kind", "name"), "id", "left").join(fans, "id", "left")
    shown = shown.select("id", "distance", F.coalesce("kind", F.lit("unknown")).alias("kind"), "name", F.coalesce("fan_in", F.lit(0).cast("long")).alias("fan_in"), F.coalesce("fan_out", F.lit(0).cast("long")).alias("fan_out"))
    return Expansion(shown, inner, truncated)


def fan_counts(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out over edges of all kinds, in one aggregation."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("o")))
    return edges.select(F.inline(ends)).groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between other nodes, after the table names(id, part) of merged ones."""
    ends = edges.join(names.select(F.col("id").alias("src"), F.col("part").alias("a")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst", "left")
    return ends.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()


def _trimmed(edges: DataFrame, layers: int = 2) -> DataFrame:
    """Without edges from nodes that nothing leads to, or to nodes that lead nowhere, some layers deep."""
    for _ in range(layers):
        ways_in, ways_out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(ways_in, "src", "left_semi").join(ways_out, "dst", "left_semi").select("src", "dst")
    return edges


def _mutual(edges: DataFrame) -> tuple[DataFrame, int]:
    """id, part: a node and the least of those it has edges with in both directions, if that is less than itself; and how many."""
    both = edges.join(_reversed(edges), ["src", "dst"], "left_semi")
    return counted(both.groupBy("src").agg(F.min("dst").alias("part")).where("part < src").select(F.col("src").alias("id"), "part"), "mutual")


def _followed(hooks: DataFrame) -> DataFrame:
    """Each node with the last part that its parts lead to; they descend, so they end. What is passed doubles with each table."""
    while True:
        then = hooks.select(F.col("id").alias("part"), F.col("part").alias("further"))
        step = hooks.join(then, "part", "left").select("id", F.coalesce("further", "part").alias("part"), F.col("further").isNotNull().alias("moved"))
        told = Observation()
        hooks = saved(step.observe(told, F.count_if("moved").alias("moved")).select("id", "part"), "merged")
        if not told.get["moved"]:
            return hooks


def _chained(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes with one way in and one way out, of edges without mutual pairs.

    Pointers to the next and to the last node double with each table, until they leave the chain. The tables are id, first, last: the
    nodes before and behind the chain; id, part: nodes of closed rings, with the least of the ring; and the number of both.
    """
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(None).cast("string").alias("last"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("id"), F.col("src").alias("last"), F.lit(None).cast("string").alias("next")))
    degrees = edges.select(F.inline(ends)).groupBy("id").agg(F.count("next").alias("outs"), F.count("last").alias("ins"), F.max("next").alias("next"), F.max("last").alias("last"))
    ways = F.array(F.struct(F.lit(True).alias("ahead"), F.col("next").alias("to")), F.struct(F.lit(False).alias("ahead"), F.col("last").alias("to")))
    # low is the least of the nodes that were passed; a pointer is open while it leads to a node of the chain
    pointers, n = counted(degrees.where("ins = 1 AND outs = 1").select("id", F.inline(ways)).select("id", "ahead", "to", F.col("to").alias("low"), F.lit(True).alias("open")), "chain")
    if not n:
        return pointers, pointers, 0
    still = None
    while True:
        then = pointers.select(F.col("id").alias("to"), "ahead", F.col("to").alias("further"), F.col("low").alias("low_then"))
        step = pointers.join(then, ["to", "ahead"], "left")
        step = step.select("id", "ahead", F.coalesce("further", "to").alias("to"), F.least("low", "low_then").alias("low"), F.col("further").isNotNull().alias("open"), (F.col("low_then") < F.col("low")).alias("lower"))
        told = Observation()
        step = saved(step.observe(told, F.count_if("open").alias("open"), F.count_if(F.col("open") & F.col("lower")).alias("lower")), "chain")
        pointers = step.drop("lower")
        # each step ends the pointers of some node of any chain that isn't closed; so if none has ended, only rings are open
        if told.get["open"] == 0 or (told.get["open"] == still and told.get["lower"] == 0):
            break
        still = told.get["open"]
    between = pointers.groupBy("id").agg(F.max(F.when(~F.col("ahead"), F.col("to"))).alias("first"), F.max(F.when(F.col("ahead"), F.col("to"))).alias("last"), F.max("open").alias("ring"), F.min("low").alias("part"))
    between = saved(between, "between")
    return between.where("NOT ring").select("id", "first", "last"), between.where("ring").select("id", F.least("id", "part").alias("part")), n // 2


def _coloured(edges: DataFrame, round_: int, hops: int = 8) -> tuple[DataFrame, DataFrame]:
    """id, part of nodes that were found in a component; and the edges that are left between the others.

    Each node has a random number; the greatest one is spread along the edges and against them, from node to node. A node
    that has the same one from both sides is of the component of the node that it is from. After some hops that have
    found such nodes the edges are merged and tried again; only if none was found do the numbers go on to the end, when edges
    between different numbers lie on no cycle.
    """
    number = F.struct(F.xxhash64("id", F.lit(round_)).alias("r"), F.col("id").alias("from"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    numbers, n = saved(ids.select("id", number.alias("along"), number.alias("against")), "colours"), 0
    none = F.lit(None).cast("struct<r:bigint,from:string>")
    while True:
        along = edges.join(numbers.select(F.col("id").alias("src"), "along"), "src").select(F.col("dst").alias("id"), "along", none.alias("against"), F.lit(0).alias("own"))
        against = edges.join(numbers.select(F.col("id").alias("dst"), "against"), "dst").select(F.col("src").alias("id"), none.alias("along"), "against", F.lit(0).alias("own"))
        both = numbers.withColumn("own", F.lit(1)).unionByName(along).unionByName(against)
        own = [F.max(F.when(F.col("own") == 1, F.col(c))).alias(f"old_{c}") for c in ("along", "against")]
        step = both.groupBy("id").agg(F.max("along").alias("along"), F.max("against").alias("against"), *own)
        changed = (F.col("along") != F.col("old_along")) | (F.col("against") != F.col("old_against"))
        found = (F.col("along") == F.col("against")) & (F.col("along")["from"] != F.col("id"))
        told, n = Observation(), n + 1
        numbers = saved(step.observe(told, F.count_if(changed).alias("changed"), F.count_if(found).alias("found")).select("id", "along", "against"), "colours")
        if told.get["changed"] == 0 or (n % hops == 0 and told.get["found"]):
            break
    names = numbers.where("along = against AND along.from <> id").select("id", F.col("along.from").alias("part"))
    if told.get["changed"] == 0:
        of = numbers.select("id", F.struct("along", "against").alias("c"))
        ends = edges.join(of.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
        edges = ends.where("a = b").select("src", "dst")
    return saved(names, "merged"), edges


def cycles(edges: DataFrame) -> DataFrame:
    """id, component (its least member), size of the nodes on a cycle, a self-loop too; for graphs of any size.

    The graph is contracted until no edge is left: nodes without a way in or out go; nodes with edges in both directions
    are merged; chains of nodes with one way in and one way out become one edge, and closed rings one node, by
    pointers that double their reach. So rings and chains take tables with the logarithm of their length, and chains
    of components, once these are merged, too. What can't be contracted is parted by random colours, with tables as the longest shortest way.
    A node of a chain is on a cycle if what comes before the chain and what comes behind it are of one component; that is
    looked up in the end, from the last contraction back to the first. Null ends make no edge.
    """
    named = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).dropna().distinct()
    loops = named.where("src = dst").select(F.col("src").alias("id"))
    left = saved(named.where("src <> dst"), "cycle-edges")
    merged: list[tuple[DataFrame, bool]] = []  # tables (id, part), or (id, first, last) of chains
    round_ = 0
    while True:
        hooks, n = _mutual(left)
        if n:
            names = _followed(hooks)
            merged.append((names, False))
            left = saved(_renamed(left, names), "cycle-edges")
            continue
        left, n = counted(_trimmed(left), "cycle-edges")
        if not n:
            break
        between, rings, n = _chained(left)
        if n:
            merged += [(rings, False), (between, True)]
            gone = between.select("id").unionByName(rings.select("id"))
            kept = left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
            left = saved(kept.unionByName(between.where("first <> last").select(F.col("first").alias("src"), F.col("last").alias("dst"))).distinct(), "cycle-edges")
            continue
        names, left = _coloured(left, round_)
        merged.append((names, False))
        left = saved(_renamed(left, names), "cycle-edges")
        round_ += 1
    parts = loops.select("id", F.col("id").alias("part")).limit(0)
    for table, is_chain in reversed(merged):
        known = parts.select(F.col("id").alias("part"), F.col("part").alias("named"))
        if is_chain:
            ends = table.join(known.select(F.col("part").alias("first"), F.col("named").alias("a")), "first", "left").join(known.select(F.col("part").alias("last"), F.col("named").alias("b")), "last", "left")
            own = ends.withColumn("a", F.coalesce("a", "first")).where(F.col("a") == F.coalesce("b", "last")).select("id", F.col("a").alias("part"))
        else:
            own = table.where("id <> part").join(known, "part", "left").select("id", F.coalesce("named", "part").alias("part"))
        parts = saved(parts.unionByName(own), "parts")
    members = parts.unionByName(parts.select(F.col("part").alias("id"), "part")).distinct()
    members = saved(members, "parts")
    every = members.unionByName(loops.join(members, "id", "left_anti").select("id", F.col("id").alias("part")))
    least = every.groupBy("part").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return every.join(least, "part").select("id", "component", "size")


class Affected(NamedTuple):
    modules: DataFrame  # id, kind, name, distance
    summary: DataFrame  # one row


def affected(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_results: int | None = 80, input_truncated: bool = False) -> Affected:
    """Modules that depend, over any number of steps, on the modules that own changed(path): the closure is complete
    even where the output is cut. What is uncertain widens the recommended scope and is told in uncertainty_reasons."""
    paths = changed.select(F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("path")).distinct()
    files = nodes.where("kind = 'file'").select("path", F.col("id").alias("file_id"))
    matched = paths.join(files, "path", "left")
    modules = nodes.where("kind = 'module'").select(F.col("id").alias("owner"))
    owned = edges.where("kind = 'contains_file'").select(F.col("src").alias("owner"), F.col("dst").alias("file_id")).join(modules, "owner", "left_semi")
    state = saved(matched.join(owned, "file_id", "left").select("path", "file_id", "owner"), "changed")
    depends = edges.where("kind = 'depends_on'")
    reached = closure(depends.select(F.col("dst").alias("src"), F.col("src").alias("dst")), state.where("owner is not null").select(F.col("owner").alias("id")))
    shown = reached.join(nodes.select("id", "kind", "name"), "id", "left").select("id", F.coalesce("kind", F.lit("module")).alias("kind"), "name", "distance")
    per_path = state.groupBy("path").agg(F.max("file_id").alias("file_id"), F.max("owner").alias("owner"))
    facts = per_path.agg(F.count(F.lit(1)).alias("changed_count"), F.count_if(F.expr("file_id is null")).alias("unmatched_count"), F.count_if(F.expr("file_id is not null and owner is null")).alias("ownerless_count"), F.count("owner").alias("owned_count"))
    totals = reached.agg(F.count(F.lit(1)).alias("affected_total"), F.count_if(F.expr("distance = 0")).alias("seed_count"))
    count = depends.agg(F.count(F.lit(1)).alias("dependency_edge_count"))
    one = facts.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(count))  # one row each
    cut = F.lit(False) if max_results is None else F.col("affected_total") > max_results
    reasons = F.filter(
        F.array(
            F.when(F.lit(input_truncated), "index_input_was_truncated"),
            F.when(F.col("unmatched_count") > 0, "changed_files_are_not_in_the_index"),
            F.when(F.col("ownerless_count") > 0, "changed_files_have_no_module"),
            F.when((F.col("seed_count") > 0) & (F.col("dependency_edge_count") == 0), "no_dependencies_are_known"),
            F.when(cut, "output_was_truncated"),
        ),
        lambda r: r.isNotNull(),
    )
    told = one.withColumn("affected_truncated", cut).withColumn("uncertainty_reasons", reasons)
    told = told.withColumn("recommended_scope", F.when(F.size("uncertainty_reasons") > 0, "broader_or_full").otherwise("targeted_dependents"))
    rows = shown.orderBy(*distance_order())
    return Affected(rows if max_results is None else rows.limit(max_results), told)


def local_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """importer, target edges whose target is one of packages(name)."""
    return imports.select("importer", "target").distinct().join(packages.select(F.col("name").alias("target")), "target", "left_semi").select("importer", "target")


def _prefixes(name: Column) -> Column:
    parts = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def resolve_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """importer, target, module: the module that a dotted target is, is below of, or is above of; the shortest name wins,
    then the first. Joined by prefixes, so both joins are on equal keys."""
    targets = imports.select("importer", "target").distinct()
    names = modules.select("module").distinct()
    below = targets.select("importer", "target", F.explode(_prefixes(F.col("target"))).alias("module")).join(names, "module")
    above = names.select("module", F.explode(_prefixes(F.col("module"))).alias("target")).join(targets, "target").select("module", "importer", "target")
    both = below.unionByName(above.select("module", "importer", "target"))
    return both.groupBy("importer", "target").agg(F.min_by("module", F.struct(F.length("module"), "module")).alias("module"))


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """path, target, resolved: the file of that very path, else the last one (by path) of that base name, else null."""
    exact = files.select(F.col("path").alias("target"), F.col("path").alias("exact"))
    named = files.groupBy(C.file_name(F.col("path")).alias("base")).agg(F.max("path").alias("by_name"))
    rows = includes.select("path", "target").distinct().withColumn("base", C.file_name(F.col("target")))
    return rows.join(exact, "target", "left").join(named, "base", "left").select("path", "target", F.coalesce("exact", "by_name").alias("resolved"))


def normalized_reference(directory: Column, reference: Column) -> Column:
    """directory/reference with . and .. worked out; what leaves the root stays as it was."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(directory, F.lit("")), F.replace(reference, F.lit("\\"), F.lit("/"))), "/", -1), lambda p: ~p.isin("", "."))
    none = F.expr("cast(array() AS array<string>)")
    walked = F.aggregate(parts, none, lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    return F.when(F.get(walked, 0) == "..", F.replace(reference, F.lit("\\"), F.lit("/"))).otherwise(F.array_join(walked, "/"))
