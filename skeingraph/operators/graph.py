"""Closures, shortest paths and trees over relations and calls.

All are level-synchronous loops of joins: a level is joined with the edges by key, what is
known already is taken off by an anti join, and the level is written to the shared folder, so
plans stay small, cycles end and lost executors cost one level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.operators.ordering import ordinal
from skeingraph.schema import CALL_KINDS, EXECUTABLE, CallerScope, DispatchSearch, ReferenceKind, RelationKind, ResolutionStatus, SymbolKind, TypeKind
from skeingraph.session import ranked, written


def closure(seeds: DataFrame, edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Everything reachable from seeds (key columns and node) over edges (source, target), with its smallest depth; seeds have 0.

    Levels are read as a union of written tables; each level's new rows are found by one join and one anti join."""
    key = key or []
    names = [*key, "node"]
    level = written(seeds.select(*names).distinct().withColumn("depth", F.lit(0)), "closure")
    known, depth = level, 0
    while not level.isEmpty():
        depth += 1
        found = level.select(*key, F.col("node").alias("source")).join(edges.select("source", "target"), "source").select(*key, F.col("target").alias("node")).distinct()
        level = written(found.join(known.select(*names), names, "left_anti").withColumn("depth", F.lit(depth)), "closure")
        known = known.unionByName(level)
    return known


def containing_ancestors(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """node and depth of the seeds (one column of ids) and what contains them, up to and with the first type on each way."""
    edges = symbols.where((F.col("kind") != SymbolKind.TYPE) & F.col("containing_symbol_id").isNotNull()).select(F.col("id").alias("source"), F.col("containing_symbol_id").alias("target"))
    return closure(seeds.toDF("node"), edges)


def path_faults(symbols: DataFrame) -> DataFrame:
    """id and fault of executables whose containment doesn't end at a type, runs in a cycle, or doesn't spell the stored executable path (segments joined by a dot)."""
    x = symbols.where(F.col("kind") != SymbolKind.TYPE).select("id", "executable_identity_path", F.col("containing_symbol_id").alias("up"), F.array("path_segment_identity").alias("path"), F.array("id").alias("seen"))
    parents = symbols.select(F.col("id").alias("up"), F.col("kind").alias("up_kind"), F.col("path_segment_identity").alias("segment"), F.col("containing_symbol_id").alias("next"))
    faults, level = None, written(x, "paths")
    while not level.isEmpty():
        j = level.join(parents, "up", "left")
        fault = (
            F.when(F.array_contains("seen", F.col("up")), "cycle").when(F.col("up_kind").isNull(), "no type")
            .when((F.col("up_kind") == SymbolKind.TYPE) & (F.array_join("path", ".") != F.col("executable_identity_path")), "path")
        )
        j = written(j.withColumn("fault", fault), "paths")
        bad = j.where("fault is not null").select("id", "fault")
        faults = bad if faults is None else faults.unionByName(bad)
        go = j.where(F.col("fault").isNull() & (F.col("up_kind") != SymbolKind.TYPE))
        level = go.select("id", "executable_identity_path", F.col("next").alias("up"), F.concat(F.array("segment"), "path").alias("path"), F.concat("seen", F.array("up")).alias("seen"))
    return faults if faults is not None else x.select("id", F.lit("").alias("fault")).limit(0)


def callees(calls: DataFrame, symbols: DataFrame, seeds: DataFrame, lambdas: bool = True) -> DataFrame:
    """Calls made by the seeds and, with lambdas, by all lambdas somewhere inside them."""
    callers = seeds.toDF("caller_symbol_id").distinct()
    if lambdas:
        inside = symbols.where("containing_symbol_id is not null").select(F.col("containing_symbol_id").alias("source"), F.col("id").alias("target"))
        below = closure(seeds.toDF("node"), inside).where("depth > 0").select(F.col("node").alias("id"))
        found = symbols.where(F.col("kind") == SymbolKind.LAMBDA).join(below, "id", "left_semi").select(F.col("id").alias("caller_symbol_id"))
        callers = callers.unionByName(found).distinct()
    return calls.where(F.col("reference_kind").isin([int(k) for k in CALL_KINDS])).join(callers, "caller_symbol_id", "left_semi")


def _related(relations: DataFrame, *kinds: int) -> DataFrame:
    """Edges from a relation's target to its source: downwards."""
    return relations.where(F.col("relation_kind").isin([int(k) for k in kinds])).select(F.col("target_symbol_id").alias("source"), F.col("source_symbol_id").alias("target"))


def override_expansion(roots: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """root, receiver, method: the root itself, and its overrides that types of the receiver's branch hold. roots: root, receiver (a type's id)."""
    roots = roots.select("root", "receiver").distinct()
    branch = closure(roots.select("receiver", F.col("receiver").alias("node")).distinct(), _related(relations, RelationKind.INHERITS), ["receiver"])
    reach = closure(roots.select("root", F.col("root").alias("node")).distinct(), _related(relations, RelationKind.OVERRIDES), ["root"])
    owners = symbols.select(F.col("id").alias("method"), F.col("containing_symbol_id").alias("type"))
    held = roots.join(reach.select("root", F.col("node").alias("method")), "root").join(owners, "method")
    held = held.join(branch.select("receiver", F.col("node").alias("type")), ["receiver", "type"], "left_semi").select("root", "receiver", "method")
    return held.unionByName(roots.select("root", "receiver", F.col("root").alias("method"))).distinct()


def interface_expansion(roots: DataFrame, relations: DataFrame, bindings: DataFrame) -> DataFrame:
    """root, receiver, method: implementations of the interface method root in the types that are assignable to receiver."""
    roots = roots.select("root", "receiver").distinct()
    below = closure(roots.select("receiver", F.col("receiver").alias("node")).distinct(), _related(relations, RelationKind.INHERITS, RelationKind.IMPLEMENTS), ["receiver"])
    b = bindings.select(F.col("implementing_type_id").alias("node"), F.col("interface_method_id").alias("root"), F.col("implementation_method_id").alias("method"))
    return roots.join(below.select("receiver", "node"), "receiver").join(b, ["root", "node"]).select("root", "receiver", "method").distinct()


def expand_roots(roots: DataFrame, symbols: DataFrame, relations: DataFrame, bindings: DataFrame) -> DataFrame:
    """root, method: each root method with its overrides, or its implementations if its type is an interface. roots: one column of ids."""
    r = roots.toDF("root").distinct().join(symbols.select(F.col("id").alias("root"), F.col("containing_symbol_id").alias("receiver")), "root")
    r = written(r.join(symbols.select(F.col("id").alias("receiver"), "type_kind"), "receiver", "left"), "roots")
    of_interface = F.coalesce(F.col("type_kind") == TypeKind.INTERFACE, F.lit(False))
    found = override_expansion(r.where(~of_interface), symbols, relations).unionByName(interface_expansion(r.where(of_interface), relations, bindings))
    return found.select("root", "method").unionByName(r.select("root", F.col("root").alias("method"))).distinct()


def inherited_depths(types: DataFrame, relations: DataFrame) -> DataFrame:
    """receiver, type, depth: the types that each receiver (id, type_kind) inherits from, nearest depth, from 1. Interfaces follow Implements, others Inherits."""
    up = lambda k: relations.where(F.col("relation_kind") == int(k)).select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target"))
    interface = F.coalesce(F.col("type_kind") == TypeKind.INTERFACE, F.lit(False))
    seeds = lambda which: types.where(which).select(F.col("id").alias("receiver"), F.col("id").alias("node"))
    found = closure(seeds(~interface), up(RelationKind.INHERITS), ["receiver"]).unionByName(closure(seeds(interface), up(RelationKind.IMPLEMENTS), ["receiver"]))
    return found.where("depth > 0").select("receiver", F.col("node").alias("type"), "depth")


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct caller and callee of resolved invocations, and the callee's order of callers: that of the first call site."""
    x = calls.where((F.col("reference_kind") == ReferenceKind.INVOCATION) & (F.col("resolution_status") == ResolutionStatus.RESOLVED) & F.col("callee_definition_id").isNotNull())
    first = F.min(F.struct(ordinal("document_key").alias("document"), F.col("source_start").alias("start"), ordinal("caller_key").alias("key"), F.col("source_length").alias("length"), F.col("id").alias("seq")))
    return x.groupBy(F.col("caller_symbol_id").alias("caller"), F.col("callee_definition_id").alias("callee")).agg(first.alias("site"))


def source_backed_executables(symbols: DataFrame, declarations: DataFrame) -> DataFrame:
    """What an async graph may hold: executable symbols whose preferred declaration is one of their own."""
    own = declarations.select(F.col("id").alias("preferred_declaration_id"), F.col("symbol_id").alias("id"))
    return symbols.where(F.col("kind").isin([int(k) for k in EXECUTABLE])).join(own, ["preferred_declaration_id", "id"], "left_semi").select(*symbols.columns)


def tree_eligible(symbols: DataFrame, declarations: DataFrame, documents: DataFrame) -> DataFrame:
    """symbols with `eligible`, what a caller tree may hold: executable, with a document, and outside of System."""
    place = declarations.select(F.col("id").alias("preferred_declaration_id"), "document_id").join(documents.where("normalized_path is not null").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    rows = symbols.join(place.select("preferred_declaration_id", F.lit(True).alias("_placed")), "preferred_declaration_id", "left")
    system = (F.col("namespace_name") == "System") | F.col("namespace_name").startswith("System.")
    ok = F.col("kind").isin([int(k) for k in EXECUTABLE]) & F.coalesce("_placed", F.lit(False)) & ~F.coalesce(system, F.lit(False))
    return rows.select(*symbols.columns, ok.alias("eligible"))


def depths(origins: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth: steps of the shortest way from each caller to an origin (one column of ids). Without places in queues, a level is one join, one anti join and one write."""
    steps = edges.select(F.col("callee").alias("source"), F.col("caller").alias("target"))
    return closure(origins.toDF("node"), written(steps.distinct(), "steps")).select(F.col("node").alias("id"), "depth")


def propagate(origins: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth, next: the shortest way from each caller to an origin, as a breadth-first search with ordered queues finds it.

    origins: id, key; edges: caller, callee, site (the order of a callee's callers). A level's nodes carry their place in the queue;
    of the ways into a new caller the one with the smallest (place of callee, site) wins, and these pairs order the next level. Places
    come from ranges of rows, so no task orders a whole level."""
    origins = written(origins.select("id", "key").distinct(), "propagate")
    edges = written(edges, "propagate")
    level = written(ranked(origins, [ordinal("key").asc(), F.asc("id")], "place", origins.count()).select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("next"), "place"), "propagate")
    known, depth = level, 0
    while True:
        depth += 1
        ways = level.select(F.col("id").alias("callee"), "place").join(edges, "callee").select(F.col("caller").alias("id"), "callee", "place", "site")
        ways = ways.join(known.select("id"), "id", "left_anti")
        best = written(ways.groupBy("id").agg(F.min(F.struct("place", "site", "callee")).alias("w")), "propagate")
        rows = best.count()
        if not rows:
            return known.drop("place")
        level = ranked(best, [F.asc("w.place"), F.asc("w.site"), F.asc("id")], "place", rows).select("id", F.lit(depth).alias("depth"), F.col("w.callee").alias("next"), "place")
        level = written(level, "propagate")
        known = known.unionByName(level)


class BrokenPath(ValueError):
    """A stored next hop is missing, or doesn't lead one step nearer."""


@dataclass
class NextHopPath:
    nodes: list[int]
    truncated: bool


def next_hop_path(involved: DataFrame, root: int, max_nodes: int = 500) -> NextHopPath | None:
    """The stored way from root (id, depth, next) to an origin, at most max_nodes of it; None if root has no depth.

    Pointers are doubled: each round one self-join of the rows that are nearer than root doubles the steps that are known, so the plan has the logarithm of
    the cap as its number of rounds, and only the way's own rows, max_nodes + 1 at most, reach the driver. Each next hop is checked before the cut."""
    here = involved.where(F.col("id") == root).select("depth", "next").head()
    if here is None or here["depth"] is None:
        return None
    spark = involved.sparkSession
    # Only rows not farther than root can be on a valid way; a broken one leaves it at once.
    rows = written(involved.where((F.col("depth") <= here["depth"]) & (F.col("depth") >= max(0, here["depth"] - max_nodes))).select("id", "depth", "next"), "hops")
    far = rows.where("next is not null").select("id", F.col("next").alias("to"))
    way, steps = spark.createDataFrame([(root, 0)], "id long, place int"), 1
    while steps <= min(max_nodes, here["depth"]):
        # What is known at places 0 to steps - 1, and what lies `steps` hops after each.
        way = written(way.unionByName(way.join(far, "id").select(F.col("to").alias("id"), (F.col("place") + steps).alias("place"))), "way")
        far = written(far.join(far.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")), "hops")
        steps *= 2
    found = {r["place"]: (r["id"], r["depth"]) for r in way.where(F.col("place") <= max_nodes).join(rows.select("id", "depth"), "id", "left").collect()}
    nodes = [root]
    for place in range(1, here["depth"] + 1):
        if found.get(place, (None, None))[1] != here["depth"] - place:
            raise BrokenPath(f"symbol {nodes[-1]} has no valid next hop")
        if len(nodes) == max_nodes:
            return NextHopPath(nodes, True)
        nodes.append(found[place][0])
    return NextHopPath(nodes, False)


@dataclass
class CallerTree:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def caller_tree(calls: DataFrame, symbols: DataFrame, root: int, max_depth: int = 3, max_nodes: int = 500, candidates: DataFrame | None = None) -> CallerTree:
    """Callers of root, their callers and so on: nodes (id, depth) and edges (caller, callee), the callee being the node whose callers were asked for.

    symbols: id, sym_rank and eligible (may be a node). max_depth 0: no limit. At most max_nodes rows of a level reach the
    driver, taken in canonical order; the cap counts the root. At the depth limit only edges between known nodes are kept, and nothing is cut off by that."""
    spark = calls.sparkSession
    kinds = [int(k) for k in CALL_KINDS]
    hits = calls.where(F.col("reference_kind").isin(kinds)).select("caller_symbol_id", F.col("callee_definition_id").alias("callee"))
    if candidates is not None:
        more = calls.where(F.col("reference_kind").isin(kinds)).select(F.col("id").alias("call_id"), "caller_symbol_id").join(candidates, "call_id")
        hits = hits.unionByName(more.select("caller_symbol_id", F.col("candidate_symbol_id").alias("callee")))
    ok = symbols.where("eligible").select(F.col("id").alias("caller"), "sym_rank")
    hits = hits.select(F.col("caller_symbol_id").alias("caller"), "callee").where("callee is not null")
    nodes, frontier, edges, depth, truncated = {root: 0}, [root], [], 0, False
    table = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    while frontier:
        # The frontier holds at most max_nodes ids.
        level = written(hits.join(F.broadcast(table(frontier).toDF("callee")), "callee").distinct().join(ok, "caller"), "tree")
        room = max_nodes - len(nodes)
        at_limit = max_depth and depth == max_depth
        fresh = level.join(F.broadcast(table(nodes).toDF("caller")), "caller", "left_anti").select("caller", "sym_rank").distinct()
        new = [] if at_limit else [r["caller"] for r in fresh.orderBy("sym_rank", "caller").limit(room + 1).collect()]
        truncated |= len(new) > room
        frontier = new[: max(0, room)]
        nodes |= dict.fromkeys(frontier, depth + 1)
        edges.append(level.join(F.broadcast(table(nodes).toDF("caller")), "caller", "left_semi").select("caller", "callee"))
        depth += 1
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return CallerTree(spark.createDataFrame(list(nodes.items()), "id long, depth int"), out, truncated)


def caller_scope(calls: DataFrame, symbols: DataFrame, scope: int) -> DataFrame:
    """Ids of callers: themselves, what contains them (themselves where nothing does), or both."""
    direct = calls.select(F.col("caller_symbol_id").alias("id"))
    if scope == CallerScope.DIRECT:
        return direct.distinct()
    up = symbols.select("id", F.coalesce("containing_symbol_id", "id").alias("up"))
    containing = direct.join(up, "id").select(F.col("up").alias("id"))
    return (containing if scope == CallerScope.CONTAINING else containing.union(direct)).distinct()


def possible_targets(relations: DataFrame, seeds: DataFrame, search: int) -> DataFrame:
    """Relations that show what a call of a seed may run: none for static, overrides for virtual, implementations too for all; one hop."""
    kinds = {DispatchSearch.STATIC: [], DispatchSearch.VIRTUAL: [3], DispatchSearch.ALL: [3, 4, 5]}[DispatchSearch(search)]
    return relations.where(F.col("relation_kind").isin(kinds)).join(seeds.toDF("target_symbol_id").distinct(), "target_symbol_id", "left_semi")


def spanning_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (caller, callee) with `spanning`: the one to each caller from the first node (by sym_rank) a level nearer to the root."""
    c = nodes.select(F.col("id").alias("caller"), F.col("depth").alias("child_depth"), F.col("sym_rank").alias("child_rank"))
    p = nodes.select(F.col("id").alias("callee"), F.col("depth").alias("parent_depth"), F.col("sym_rank").alias("parent_rank"))
    rows = edges.join(c, "caller").join(p, "callee")
    tree = F.col("parent_depth") == F.col("child_depth") - 1
    place = F.row_number().over(Window.partitionBy("caller", tree).orderBy("parent_rank", "callee"))
    return rows.withColumn("spanning", tree & (place == 1))
