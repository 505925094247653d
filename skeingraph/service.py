"""The query service: each command of a call-graph search as one composition of operators over the stored tables.

A selection finds symbols by selector, typed conditions, kind and async status; a command then reads the tables that it
needs. Root filters never prune what is found from the roots, and cardinality is checked before anything is traversed. Results
are DataFrames whose `place` column counts from 1 in canonical order.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeingraph.functions import text as T
from skeingraph.operators import aggregates, graph, joins, ordering, scans
from skeingraph.operators.output import RequireSingle, single
from skeingraph.plans import conditions as C
from skeingraph.plans import selector as S
from skeingraph.schema import CALL_KINDS, EXECUTABLE, AsyncStatus, CallerScope, DispatchSearch, GeneratedFilter, RelationKind, SymbolKind
from skeingraph.session import ranked, written


class UsageError(ValueError):
    """The request says too little, or asks for what does not go together; nothing has been run."""


@dataclass(frozen=True)
class Request:
    """What a command looks for. kind, status: None where they were not asked for."""

    selector: str | None = None
    conditions: tuple[C.Condition, ...] = ()
    kind: int | None = None
    status: int | None = None
    generated: int = GeneratedFilter.INCLUDE
    ignore_case: bool = False
    include_overrides: bool = False

    def check(self, command: str, minimum: bool = True) -> None:
        if minimum and self.selector is None and not self.conditions and self.kind is None and self.status is None:
            raise UsageError(f"{command} needs a selector or a condition")
        if self.include_overrides and self.kind == SymbolKind.LAMBDA:
            raise UsageError("lambdas have no overrides")
        if self.include_overrides and (self.selector is None or "*" in self.selector):
            raise UsageError("overrides are included for a selector without stars only")


@dataclass
class Selection:
    """roots: symbols with normalized_path, source_start and `place`; declarations: those that met the conditions."""

    roots: DataFrame
    declarations: DataFrame
    ids: DataFrame = field(init=False)

    def __post_init__(self):
        self.ids = self.roots.select("id")


class Service:
    """The tables of one profile: symbols, symbol_declarations, documents, calls and, as far as commands need them, the others of the schema."""

    def __init__(self, tables: dict[str, DataFrame], profile: int | None = None):
        self.t = {n: scans.in_profile(df, profile) if profile is not None and "analysis_profile_id" in df.columns and n != "index_runs" else df for n, df in tables.items()}
        self.spark = self.t["symbols"].sparkSession
        self._ranks: DataFrame | None = None

    @classmethod
    def open(cls, tables: dict[str, DataFrame], name: str | None = None) -> Service:
        """Of the profile of a name, or of the one that was indexed last."""
        row = scans.latest_profile(tables["analysis_profiles"], tables["index_runs"], name).head()
        if row is None:
            raise UsageError(f"no profile {name}" if name else "no profile")
        return cls(tables, row["analysis_profile_id"])

    # What commands share ---------------------------------------------------------------------------------------------

    def placed(self, symbols: DataFrame) -> DataFrame:
        """symbols with the path and start of their preferred declaration, where there is one."""
        d = self.t["symbol_declarations"].select(F.col("id").alias("preferred_declaration_id"), "document_id", "source_start")
        doc = self.t["documents"].select(F.col("id").alias("document_id"), "normalized_path")
        return symbols.join(d, "preferred_declaration_id", "left").join(doc, "document_id", "left").drop("document_id")

    def ranks(self) -> DataFrame:
        """Every symbol's place in canonical order, made once."""
        if self._ranks is None:
            self._ranks = written(ordering.symbol_ranks(self.placed(self.t["symbols"])), "ranks")
        return self._ranks

    def declarations(self, with_text: bool = False) -> DataFrame:
        """Declarations with their document's path, and its source where conditions read it."""
        columns = ["normalized_path", *(["source_text"] if with_text else [])]
        return self.t["symbol_declarations"].join(self.t["documents"].select(F.col("id").alias("document_id"), *columns), "document_id")

    def select(self, request: Request, command: str = "this command", source_only: bool = True, minimum: bool = True) -> Selection:
        """Selector and logical conditions first, then declarations, then the filter of generated roots; canonical order, each symbol once."""
        request.check(command, minimum)
        compiled = C.compile(self.spark, list(request.conditions))
        parsed = S.parse(request.selector) if request.selector is not None else None
        found = scans.functions(self.t["symbols"], request.kind, request.status if request.status is not None else AsyncStatus.ALL)
        if parsed is not None:
            found = S.matching(found, parsed, request.ignore_case)
        found, rows = C.select(found, self.declarations(compiled.needs_text), compiled)
        if source_only:
            found = scans.source_backed(found, self.t["symbol_declarations"], self.t["documents"])
        found = joins.generated_roots(found, self.t["symbol_declarations"], request.generated)
        found = ordering.first_by(self.placed(found), ["id"], [ordering.ordinal("stable_key").asc()])
        # Few symbols are roots as a rule; ordered by ranges otherwise.
        found = written(ranked(found, ordering.symbol_order(), "place"), "roots")
        return Selection(found, rows.join(found.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"))

    def expanded(self, selection: Selection, request: Request) -> DataFrame:
        """Ids of the roots, and of the methods that may run in their place if the request includes overrides."""
        if not request.include_overrides:
            return selection.ids
        return graph.expand_roots(selection.ids, self.t["symbols"], self.t["symbol_relations"], self.t["interface_method_bindings"]).select(F.col("method").alias("id")).distinct()

    def _calls(self, calls: DataFrame, generated: int) -> DataFrame:
        calls = joins.generated_edges(calls, generated, self.t["documents"])
        calls = calls.join(self.t["documents"].select(F.col("id").alias("document_id"), "normalized_path"), "document_id")
        joins.endpoints([(calls, ["caller_symbol_id", "callee_symbol_id", "callee_definition_id"])], self.t["symbols"])
        return ordering.call_places(calls, self.ranks())

    # Commands --------------------------------------------------------------------------------------------------------

    def symbol_find(self, request: Request) -> DataFrame:
        """Symbols, also those known from metadata alone."""
        found = self.select(request, "symbol find", source_only=False)
        if not request.include_overrides:
            return found.roots
        return ranked(self.placed(scans.by_ids(self.t["symbols"], self.expanded(found, request))), ordering.symbol_order(), "place")

    def symbol_list(self, request: Request, involved: bool = False) -> DataFrame:
        found = self.select(request, "symbol list", minimum=False).roots
        return ranked(found.where("async_involvement_depth is not null").drop("place"), ordering.symbol_order(), "place") if involved else found

    def definition(self, request: Request) -> DataFrame:
        """symbol_id, id, declaration_role, normalized_path, source_start, root_order, declaration_place of the roots' declarations."""
        found = self.select(request, "definition")
        if found.roots.isEmpty():
            raise RequireSingle("no symbol matches")
        roots = found.roots.select(F.col("id").alias("symbol_id"), F.col("place").alias("root_order"))
        if request.include_overrides:
            more = self.expanded(found, request).withColumnRenamed("id", "symbol_id")
            roots = more.join(self.ranks().select(F.col("id").alias("symbol_id"), F.col("sym_rank").alias("root_order")), "symbol_id")
        return joins.with_declarations(roots, self.declarations())

    def definition_at(self, positions: DataFrame) -> DataFrame:
        """position, symbol_id, declaration_id of each `path:line:column` (a column `at`): what the innermost call there calls, or failing that the innermost declaration there."""
        p = positions.withColumn("p", T.parse_position(F.col("at"))).select("at", T.normalize_path(F.col("p.path")).alias("normalized_path"), "p.line", "p.column")
        p = p.join(self.t["documents"].select(F.col("id").alias("document_id"), "normalized_path", "source_text"), "normalized_path")
        p = written(p.select("at", "document_id", T.offset_of(F.col("source_text"), F.col("line"), F.col("column")).alias("position")), "positions")
        of_call = joins.innermost(self.t["calls"].select("document_id", "id", "source_start", "source_length"), p)
        target = self.t["calls"].select("id", F.coalesce("callee_definition_id", "callee_symbol_id").alias("called")).where("called is not null")
        called = of_call.join(target, "id").select("document_id", "position", "called")
        own = joins.innermost(self.t["symbol_declarations"].select("document_id", "id", "source_start", "source_length"), p)
        inside = own.join(self.t["symbol_declarations"].select("id", "symbol_id"), "id").select("document_id", "position", F.col("symbol_id").alias("inside"))
        out = p.join(called, ["document_id", "position"], "left").join(inside, ["document_id", "position"], "left")
        out = out.select("at", F.coalesce("called", "inside").alias("symbol_id")).where("symbol_id is not null")
        return out.join(self.t["symbol_declarations"].select("symbol_id", F.col("id").alias("declaration_id")), "symbol_id")

    def source_search(self, request: Request) -> DataFrame:
        """The declarations that meet the conditions, with their symbols' names and `place`."""
        if not request.conditions:
            raise UsageError("source search needs a condition")
        found = self.select(request, "source search")
        s = found.roots.select(F.col("id").alias("symbol_id"), *[F.col(c).alias(f"symbol_{c}") for c in ("namespace_name", "type_identity_path", "executable_identity_path", "normalized_path", "source_start", "stable_key")])
        return ranked(found.declarations.join(s, "symbol_id"), ordering.source_match_order(), "place")

    def source_show(self, request: Request) -> DataFrame:
        """The only root's preferred declaration with its normalized text."""
        found = self.select(request, "source show")
        single(found.ids)
        rows = joins.preferred_declarations(found.roots, self.t["symbol_declarations"])
        own = self.t["documents"].join(rows.select(F.col("document_id").alias("id")), "id", "left_semi")
        scans.checked_payloads(own, self.t["normalized_sources"])
        rows = scans.normalized_text(rows, own, self.t["normalized_sources"])
        return rows.withColumn("source", T.utf16_slice(F.col("normalized_source"), F.col("normalized_start"), F.col("normalized_length"))).drop("normalized_source")

    def references(self, request: Request, generated: int = GeneratedFilter.INCLUDE) -> DataFrame:
        """Call sites of every kind that name a root, or might."""
        found = self.select(request, "references")
        return self._calls(joins.calls_by_callee(self.t["calls"], self.expanded(found, request), self.t["call_candidates"]), generated)

    def callers(self, request: Request, scope: int = CallerScope.DIRECT, dispatch: int = DispatchSearch.STATIC, generated: int = GeneratedFilter.INCLUDE) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Calls of the roots, the symbols that make them by `scope`, and the relations that show what the calls may run."""
        found = self.select(request, "callers")
        ids = self.expanded(found, request)
        calls = self._calls(joins.calls_by_callee(self.t["calls"], ids, self.t["call_candidates"], CALL_KINDS), generated)
        callers = ranked(self.placed(scans.by_ids(self.t["symbols"], graph.caller_scope(calls, self.t["symbols"], scope))), ordering.symbol_order(), "place")
        return calls, callers, ordering.relation_places(graph.possible_targets(self.t["symbol_relations"], ids, dispatch), self.ranks())

    def callees(self, request: Request, lambdas: bool = True, generated: int = GeneratedFilter.INCLUDE) -> DataFrame:
        found = self.select(request, "callees")
        return self._calls(graph.callees(self.t["calls"], self.t["symbols"], self.expanded(found, request), lambdas), generated)

    def overrides(self, request: Request) -> DataFrame:
        """Methods that override a root, one step."""
        found = self.select(request, "overrides")
        methods = found.roots.where(F.col("kind") == SymbolKind.METHOD).select("id")
        return ordering.relation_places(joins.relations_of(self.t["symbol_relations"], self.t["symbols"], methods, "target", [RelationKind.OVERRIDES]), self.ranks())

    def callers_tree(self, request: Request, max_depth: int = 3, max_nodes: int = 500, generated: int = GeneratedFilter.INCLUDE) -> graph.CallerTree:
        """The only root's callers, their callers and so on; nodes and edges with their places."""
        found = self.select(request, "callers tree")
        root = single(found.ids)["id"]
        return self.tree_of(root, max_depth, max_nodes, generated)

    def tree_of(self, root: int, max_depth: int = 3, max_nodes: int = 500, generated: int = GeneratedFilter.INCLUDE) -> graph.CallerTree:
        symbols = graph.tree_eligible(self.t["symbols"], self.t["symbol_declarations"], self.t["documents"]).join(self.ranks(), "id")
        calls = joins.generated_edges(self.t["calls"], generated, self.t["documents"])
        tree = graph.caller_tree(calls, symbols, root, max_depth, max_nodes, self.t["call_candidates"])
        nodes = written(ranked(tree.nodes.join(self.ranks(), "id"), ordering.tree_node_order(), "place", rows=max_nodes), "tree-nodes")
        edges = graph.spanning_edges(nodes, tree.edges.distinct()).withColumnsRenamed({"caller": "child", "callee": "parent"})
        edges = ranked(edges, ordering.tree_edge_order(), "place").withColumnsRenamed({"child": "caller", "parent": "callee"})
        return graph.CallerTree(nodes, edges, tree.truncated)

    def call_sites(self, tree: graph.CallerTree) -> DataFrame:
        """edge_index, call_id, normalized_path, source_start, source_length, place of every call along the tree's edges, candidates too."""
        calls = joins.of_kinds(self.t["calls"], "reference_kind", CALL_KINDS)
        hits = calls.select(F.col("id").alias("call_id"), F.col("caller_symbol_id").alias("caller"), F.col("callee_definition_id").alias("callee"), "document_id", "source_start", "source_length")
        more = self.t["call_candidates"].join(hits.drop("callee"), "call_id").withColumnRenamed("candidate_symbol_id", "callee")
        edges = tree.edges.select("caller", "callee", F.col("place").alias("edge_index"))
        rows = edges.join(hits.unionByName(more).distinct(), ["caller", "callee"])
        rows = rows.join(self.t["documents"].select(F.col("id").alias("document_id"), "normalized_path"), "document_id")
        return ranked(rows, ordering.call_site_order(), "place")

    def involved(self) -> DataFrame:
        """id, depth, next of every executable that leads to one with an async role, over resolved invocations between symbols that the graph may hold."""
        symbols = written(graph.source_backed_executables(self.t["symbols"], self.t["symbol_declarations"]).select("id", "stable_key", "async_role"), "eligible")
        ends = symbols.select("id", "stable_key")
        calls = self.t["calls"].join(ends.withColumnsRenamed({"id": "caller_symbol_id", "stable_key": "caller_key"}), "caller_symbol_id")
        calls = calls.join(ends.select(F.col("id").alias("callee_definition_id")), "callee_definition_id", "left_semi")
        calls = calls.join(self.t["documents"].select(F.col("id").alias("document_id"), F.col("normalized_path").alias("document_key")), "document_id")
        return graph.propagate(symbols.where("async_role <> 0").select("id", F.col("stable_key").alias("key")), graph.call_edges(calls))

    def async_tree(self, request: Request, max_nodes: int = 500) -> graph.NextHopPath | None:
        """The way from the only root to an async operation, by the stored next hops; None if there is none."""
        found = self.select(request, "async tree")
        root = single(found.ids)["id"]
        hops = self.t["symbols"].select("id", F.col("async_involvement_depth").alias("depth"), F.col("async_next_symbol_id").alias("next"))
        return graph.next_hop_path(hops, root, max_nodes)

    def conditions(self, defined: Iterable[str] = ()) -> DataFrame:
        """Conditional symbols with their files and uses; `defined`: the profile's symbols."""
        return aggregates.conditions(self.t["conditional_symbols_used"], list(defined))


#: Kinds that selections look at.
KINDS = EXECUTABLE
