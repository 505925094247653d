import random
from collections import defaultdict, deque

import pytest

from skeingraph.operators import graph, joins
from skeingraph.schema import DispatchSearch

CALLS = "id long, caller_symbol_id long, callee_definition_id long, reference_kind int, resolution_status int, document_key string, caller_key string, source_start int, source_length int"


def fifo(origins, calls):
    """Breadth-first search with queues, as a check."""
    lists = defaultdict(list)
    for r in sorted(calls, key=lambda r: (r[5], r[7], r[6], r[8], r[0])):
        if r[1] not in lists[r[2]]:
            lists[r[2]].append(r[1])
    found = {o: (0, None) for o, _ in sorted(origins, key=lambda o: o[1])}
    queue = deque(found)
    while queue:
        x = queue.popleft()
        for c in lists[x]:
            if c not in found:
                found[c] = (found[x][0] + 1, x)
                queue.append(c)
    return found


def propagate(spark, origins, calls):
    edges = graph.call_edges(spark.createDataFrame(calls, CALLS))
    rows = graph.propagate(spark.createDataFrame(origins, "id long, key string"), edges).collect()
    return {r["id"]: (r["depth"], r["next"]) for r in rows}


def call(i, a, b, doc="d", start=0):
    return (i, a, b, 1, 1, doc, f"k{a:03}", start, 1)


def test_propagation_small_cases(spark):
    # A cycle of 1 and 2 over origin 3, an unreachable cycle of 8 and 9, a call from the origin, and an origin that calls itself.
    calls = [call(0, 1, 2), call(1, 2, 1), call(2, 2, 3), call(3, 8, 9), call(4, 9, 8), call(5, 3, 7), call(6, 3, 3)]
    assert propagate(spark, [(3, "k003")], calls) == {3: (0, None), 2: (1, 3), 1: (2, 2)}


def test_propagation_equals_fifo(spark):
    rnd = random.Random(5)
    calls = [call(i, rnd.randrange(40), rnd.randrange(40), rnd.choice("ab"), rnd.randrange(4)) for i in range(90)]
    origins = [(i, f"k{i:03}") for i in (3, 11)]
    assert propagate(spark, origins, calls) == fifo(origins, calls)


def test_next_hop_path(spark):
    rows = spark.createDataFrame([(1, 2, 2), (2, 1, 3), (3, 0, None), (4, 2, 3), (5, None, None)], "id long, depth int, next long")
    assert graph.next_hop_path(rows, 1).nodes == [1, 2, 3]
    assert graph.next_hop_path(rows, 1, max_nodes=2) == graph.NextHopPath([1, 2], True)
    assert graph.next_hop_path(rows, 5) is None
    with pytest.raises(graph.BrokenPath):
        graph.next_hop_path(rows, 4)


def tree(spark, edges, **kw):
    calls = spark.createDataFrame([(i, a, b, 1) for i, (a, b) in enumerate(edges)], "id long, caller_symbol_id long, callee_definition_id long, reference_kind int")
    ids = {x for e in edges for x in e}
    symbols = spark.createDataFrame([(i, i, i != 99) for i in ids], "id long, sym_rank long, eligible boolean")
    t = graph.caller_tree(calls, symbols, 0, **kw)
    return {r["id"]: r["depth"] for r in t.nodes.collect()}, sorted((r["caller"], r["callee"]) for r in t.edges.collect()), t.truncated


def test_caller_tree_limits(spark):
    edges = [(1, 0), (2, 1), (3, 2), (1, 2), (99, 0), (4, 0)]
    assert tree(spark, edges, max_depth=2) == ({0: 0, 1: 1, 4: 1, 2: 2}, [(1, 0), (1, 2), (2, 1), (4, 0)], False)
    assert tree(spark, edges, max_depth=0, max_nodes=2) == ({0: 0, 1: 1}, [(1, 0)], True)
    assert tree(spark, [(0, 0)], max_depth=0)[:2] == ({0: 0}, [(0, 0)])


def test_caller_tree_edge_of_a_candidate_leads_to_the_asked_node(spark):
    calls = spark.createDataFrame([(7, 1, 5, 1)], "id long, caller_symbol_id long, callee_definition_id long, reference_kind int")
    symbols = spark.createDataFrame([(1, 1, True)], "id long, sym_rank long, eligible boolean")
    t = graph.caller_tree(calls, symbols, 0, candidates=spark.createDataFrame([(7, 0)], "call_id long, candidate_symbol_id long"))
    assert [tuple(r) for r in t.edges.collect()] == [(1, 0)]


def test_closures_end_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3)], "source long, target long")
    assert {r["node"]: r["depth"] for r in graph.closure(spark.createDataFrame([(1,)], "node long"), edges).collect()} == {1: 0, 2: 1, 3: 2}


def test_dispatch_and_endpoints(spark):
    r = spark.createDataFrame([(1, 2, 9, 3), (1, 3, 9, 5), (1, 4, 9, 1)], "analysis_profile_id long, source_symbol_id long, target_symbol_id long, relation_kind int")
    seeds = spark.createDataFrame([(9,)], "id long")
    counts = [graph.possible_targets(r, seeds, k).count() for k in DispatchSearch]
    assert counts == [0, 1, 2]
    with pytest.raises(joins.MissingEndpoint):
        joins.endpoints([(r, ["source_symbol_id"])], spark.createDataFrame([(2,), (3,)], "id long"))


def test_path_faults(spark):
    rows = [(1, 1, "T", None, "T"), (2, 2, "M", 1, "M"), (3, 3, "<lambda#1>", 2, "M.<lambda#1>"), (4, 2, "X", 5, "X"), (5, 2, "Y", 4, "Y"), (6, 2, "Z", None, "Z"), (7, 2, "W", 1, "V")]
    s = spark.createDataFrame(rows, "id long, kind int, path_segment_identity string, containing_symbol_id long, executable_identity_path string")
    assert {r["id"]: r["fault"] for r in graph.path_faults(s).collect()} == {4: "cycle", 5: "cycle", 6: "no type", 7: "path"}
