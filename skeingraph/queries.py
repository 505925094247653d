"""The registered queries of the call-graph operators, each beside the SQL that gives the same rows.

In SQL, views and tables stand in braces; what precedes MAIN are further common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.adapters import Views, for_oracle
from skeingraph.functions import text as T
from skeingraph.operators import aggregates, graph, joins, layouts, ordering, scans
from skeingraph.operators.output import table_lines
from skeingraph.plans import conditions as C
from skeingraph.plans import selector
from skeingraph.schema import AsyncStatus, CallerScope, DispatchSearch, GeneratedFilter
from skeingraph.service import Request, Service
from skeingraph.session import ranked
from skeingraph.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.strip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = for_oracle(sql)
        return f

    return add


CALL = "id", "caller_symbol_id", "callee_definition_id"


def _seeds(v: Views, size: int) -> DataFrame:
    return v.part.where(F.col("p_size") == size).select(F.col("p_partkey").alias("id"))


# Scans and sources ---------------------------------------------------------------------------------------------------


@query("""SELECT r_regionkey AS profile_id, r_name AS name, n_nationkey AS run_id FROM {region} JOIN {nation} ON n_regionkey = r_regionkey ORDER BY n_nationkey DESC LIMIT 1""")
def profile_latest(v):
    profiles = v.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    runs = v.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("analysis_profile_id"), F.col("n_nationkey").alias("indexed_at_utc"))
    return scans.latest_profile(profiles, runs).select(F.col("analysis_profile_id").alias("profile_id"), "name", "run_id")


@query("SELECT id, name, kind FROM {symbols} WHERE name = 'small ring' AND kind IN (1, 2) AND preferred_declaration_id IS NOT NULL")
def symbol_scan(v):
    return scans.symbol_scan(v.symbols, name="small ring", kinds=[1, 2], source_only=True).select("id", "name", "kind")


@query("SELECT id, kind FROM {symbols} WHERE kind IN (2, 3, 4, 5) AND name = 'red widget'")
def executable_scan(v):
    return scans.executables(v.symbols, name="red widget").select("id", "kind")


@query("SELECT id, async_role FROM {symbols} WHERE kind = 2 AND async_role <> 0")
def function_scan_async(v):
    return scans.functions(v.symbols, kind=2, status=AsyncStatus.ASYNC).select("id", "async_role")


@query("SELECT id, async_role FROM {symbols} WHERE kind IN (2, 3, 4, 5) AND async_role = 0")
def function_scan_sync(v):
    return scans.functions(v.symbols, status=AsyncStatus.SYNC).select("id", "async_role")


@query("SELECT id, stable_key FROM {symbols} WHERE id IN (1, 5, 9, 77, 100000000)")
def symbols_by_ids(v):
    return scans.by_ids(v.symbols, scans.id_list(v.spark, [1, 5, 9, 77, 100000000])).select("id", "stable_key")


@query("SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE (caller_symbol_id % 50, callee_definition_id % 50) IN ((1, 2), (3, 4), (5, 5))")
def pairs_by_list(v):
    wanted = scans.pair_list(v.spark, [(1, 2), (3, 4), (5, 5)])
    rows = v.calls.withColumn("a", F.col("caller_symbol_id") % 50).withColumn("b", F.col("callee_definition_id") % 50)
    return rows.join(wanted, ["a", "b"], "left_semi").select(*CALL)


@query("SELECT id, normalized_path FROM {files} WHERE normalized_path = 'src1/en/1.cs' OR lower(normalized_path) = lower('SRC2/EN/2.CS')")
def document_by_path(v):
    a = scans.document_by_path(v.files, "src1/en/1.cs")
    b = scans.document_by_path(v.files, "SRC2/EN/2.CS", ignore_case=True)
    return a.unionByName(b).dropDuplicates(["id"]).select("id", "normalized_path")


@query("""t AS (SELECT sha256(text) AS hash, min(doc_id) AS source_id, text FROM {documents} GROUP BY text)
MAIN SELECT d.id, f.normalized_path, t.source_id, length(t.text) AS n_chars FROM {declarations} d JOIN {files} f ON f.id = d.document_id JOIN t ON t.text = f.source_text""")
def normalized_text(v):
    sources = v.documents.withColumn("hash", F.sha2("text", 256)).groupBy("hash", F.col("text").alias("normalized_source")).agg(F.min("doc_id").alias("id"))
    paths = v.files.withColumn("hash", F.sha2("source_text", 256)).join(sources.select("hash", F.col("id").alias("normalized_source_id")), "hash")
    rows = scans.normalized_text(v.declarations.select("id", "document_id"), paths.select("id", "normalized_path", "normalized_source_id"), sources)
    return rows.select("id", "normalized_path", F.col("normalized_source_id").alias("source_id"), F.length("normalized_source").cast("long").alias("n_chars"))


# Filters -------------------------------------------------------------------------------------------------------------


@query(r"""SELECT id, normalized_path FROM {files} WHERE regexp_full_match(normalized_path, 'src1[^/]*/.*[1-3]\.cs') AND normalized_path NOT LIKE '%/fr/%'""")
def input_exclude_glob(v):
    from skeingraph.sources.files import included

    # As P11: excludes are globs without regard to case.
    rows = v.files.where(F.col("normalized_path").rlike(r"^src1[^/]*/") & F.col("normalized_path").rlike(r"[1-3]\.cs$"))
    return rows.where(included(F.col("normalized_path"), ["**/FR/**"])).select("id", "normalized_path")


@query(r"""SELECT id, normalized_path FROM {files} WHERE regexp_full_match(normalized_path, 'src1[^/]*/(?:[^/]*/)*[^/]*7\.cs')""")
def file_glob(v):
    return v.files.where(C.predicate(v.spark, C.Condition("file", r"src1*\**\*7.cs"))).select("id", "normalized_path")


@query(r"""SELECT id FROM {files} WHERE regexp_matches(source_text, '(?s)the.*license') AND NOT contains(source_text, 'MIT')""")
def source_include_exclude(v):
    cs = [C.Condition("include", "the*license"), C.Condition("exclude", "MIT", "literal")]
    return v.files.where(C.compile(v.spark, cs).declaration).select("id")


@query(r"""SELECT id FROM {files} WHERE regexp_matches(source_text, '(?i)licensed under [a-z0-9 ]+') """)
def source_regex(v):
    return v.files.where(C.predicate(v.spark, C.Condition("include", "licensed under [a-z0-9 ]+", "regex", ignore_case=True))).select("id")


@query(r"""SELECT id FROM {symbols} WHERE regexp_full_match(namespace_name, 'Brand1[0-9]?') AND (regexp_full_match(type_display_path, 'ECO.*') OR type_display_path = 'SMALL')
AND id IN (SELECT symbol_id FROM {declarations} d JOIN {files} f ON f.id = d.document_id WHERE f.normalized_path LIKE 'src%/en/%' AND contains(f.source_text, 'the') AND NOT contains(f.source_text, 'License'))""")
def typed_conditions(v):
    """Alternatives within type, all categories together, and one declaration that meets file, include and exclude."""
    cs = [C.Condition("namespace", "Brand1[0-9]?", "regex"), C.Condition("type", "ECO*"), C.Condition("type", "SMALL", "literal"), C.Condition("file", "src*/en/**"), C.Condition("include", "the", "literal"), C.Condition("exclude", "License", "literal")]
    rows = v.declarations.select("symbol_id", "document_id").join(v.files.select(F.col("id").alias("document_id"), "normalized_path", "source_text"), "document_id")
    return C.select(v.symbols, rows, C.compile(v.spark, cs))[0].select("id")


@query("SELECT id FROM {symbols} WHERE type_identity_path = 'ECONOMY' AND namespace_name LIKE 'Brand1%' AND executable_identity_path LIKE 'small%'")
def selector_match(v):
    """Explicit form, with globs of namespace and member."""
    s = selector.parse("Brand1*::ECONOMY::small*")
    return selector.encoded(v.symbols.select("id", "name", "namespace_name", "type_identity_path", "executable_identity_path")).where(selector.candidate_hints(s) & selector.compile(s)).select("id")


@query("SELECT id FROM {symbols} WHERE type_identity_path = 'PROMO' AND executable_identity_path = 'blue_bolt'")
def selector_suffix(v):
    """Short form: the owner is any end of namespace and type."""
    s = selector.parse("PROMO::blue_bolt")
    return selector.encoded(v.symbols.select("id", "namespace_name", "type_identity_path", "executable_identity_path")).where(selector.compile(s)).select("id")


@query("SELECT s.id FROM {symbols} s JOIN {declarations} d ON d.id = s.preferred_declaration_id WHERE NOT d.is_generated")
def generated_roots(v):
    return joins.generated_roots(v.symbols, v.declarations, GeneratedFilter.EXCLUDE).select("id")


@query("SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE NOT is_generated")
def generated_exclude(v):
    return joins.generated_edges(v.calls, GeneratedFilter.EXCLUDE).select(*CALL)


@query("SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE is_generated")
def generated_only(v):
    return joins.generated_edges(v.calls, GeneratedFilter.ONLY).select(*CALL)


@query("SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE reference_kind IN (2)")
def reference_kinds_filter(v):
    return joins.of_kinds(v.calls, "reference_kind", [2]).select(*CALL)


# Joins ---------------------------------------------------------------------------------------------------------------


@query("""SELECT s.id, s.stable_key, d.source_start, f.normalized_path FROM {symbols} s LEFT JOIN {declarations} d ON d.id = s.preferred_declaration_id LEFT JOIN {files} f ON f.id = d.document_id""")
def symbol_projection(v):
    projects = v.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("assembly_name"))
    symbols = v.symbols.withColumn("project_id", F.col("id") % 10)
    return joins.symbol_projection(symbols, v.declarations, v.files, projects).select("id", "stable_key", "source_start", "normalized_path")


@query("""SELECT o_orderkey AS id, count(l_linenumber) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_returnflag, l_partkey), '') AS parameters
FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def parameter_hydration(v):
    p = v.lineitem.select(F.col("l_orderkey").alias("method_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("name"), F.col("l_partkey").alias("type_key"))
    rows = joins.with_parameters(v.orders.select(F.col("o_orderkey").alias("id")), p)
    said = F.array_join(F.transform("parameters", lambda x: F.concat_ws(":", x["ordinal"].cast("string"), x["name"], x["type_key"].cast("string"))), ",")
    return rows.select("id", F.size("parameters").cast("long").alias("n"), said.alias("parameters"))


@query("SELECT d.id, s.stable_key, f.normalized_path FROM {declarations} d JOIN {symbols} s ON s.id = d.symbol_id JOIN {files} f ON f.id = d.document_id")
def declaration_rows(v):
    return joins.declaration_rows(v.declarations, v.symbols, v.files.select("id", "normalized_path")).select("id", "stable_key", "normalized_path")


@query("SELECT DISTINCT d.id, d.declaration_role FROM {symbols} s JOIN {declarations} d ON d.id = s.preferred_declaration_id")
def preferred_declarations(v):
    return joins.preferred_declarations(v.symbols, v.declarations).select("id", "declaration_role").distinct()


@query("""SELECT c.id, a.stable_key AS caller_key, b.stable_key AS callee_key, e.stable_key AS callee_definition_key, f.normalized_path FROM {calls} c JOIN {symbols} a ON a.id = c.caller_symbol_id
LEFT JOIN {symbols} b ON b.id = c.callee_symbol_id LEFT JOIN {symbols} e ON e.id = c.callee_definition_id JOIN {files} f ON f.id = c.document_id""")
def call_projection(v):
    rows = joins.call_projection(v.calls.drop("is_generated"), v.symbols, v.files)
    return rows.select("id", "caller_key", "callee_key", "callee_definition_key", "normalized_path")


@query("SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE callee_definition_id IN (SELECT p_partkey FROM {part} WHERE p_size = 2) AND reference_kind IN (1, 2)")
def calls_by_callee(v):
    return joins.calls_by_callee(v.calls, _seeds(v, 2), kinds=[1, 2]).select(*CALL)


@query("""SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE callee_definition_id IN (SELECT p_partkey FROM {part} WHERE p_size = 2)
OR id IN (SELECT call_id FROM {call_candidates} WHERE candidate_symbol_id IN (SELECT p_partkey FROM {part} WHERE p_size = 2))""")
def calls_by_callee_or_candidate(v):
    return joins.calls_by_callee(v.calls, _seeds(v, 2), v.call_candidates).select(*CALL)


@query("SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE caller_symbol_id IN (SELECT p_partkey FROM {part} WHERE p_size = 3)")
def calls_by_caller(v):
    return joins.calls_by_caller(v.calls, _seeds(v, 3)).select(*CALL)


@query("""SELECT source_symbol_id, target_symbol_id, relation_kind FROM {symbol_relations} WHERE target_symbol_id IN (SELECT p_partkey FROM {part} WHERE p_size = 4) AND relation_kind IN (3, 5)
AND source_symbol_id IN (SELECT id FROM {symbols})""")
def relations_by_target(v):
    return joins.relations_of(v.symbol_relations, v.symbols, _seeds(v, 4), "target", [3, 5]).select("source_symbol_id", "target_symbol_id", "relation_kind")


@query("""SELECT source_symbol_id, target_symbol_id, relation_kind FROM {symbol_relations} WHERE source_symbol_id IN (SELECT p_partkey FROM {part} WHERE p_size = 4)
AND target_symbol_id IN (SELECT id FROM {symbols})""")
def relations_by_source(v):
    return joins.relations_of(v.symbol_relations, v.symbols, _seeds(v, 4), "source").select("source_symbol_id", "target_symbol_id", "relation_kind")


@query("SELECT source_symbol_id, target_symbol_id FROM {symbol_relations} WHERE relation_kind = 3 AND target_symbol_id IN (SELECT p_partkey FROM {part} WHERE p_size < 9) AND source_symbol_id IN (SELECT id FROM {symbols})")
def overrides(v):
    return joins.overrides_of(v.symbol_relations, v.symbols, v.part.where("p_size < 9").select(F.col("p_partkey").alias("id"))).select("source_symbol_id", "target_symbol_id")


@query("SELECT implementing_type_id, interface_method_id, implementation_method_id FROM {interface_method_bindings} WHERE interface_method_id IN (SELECT p_partkey FROM {part} WHERE p_size = 5)")
def bindings_by_interface_method(v):
    return joins.bindings_of(v.interface_method_bindings, _seeds(v, 5)).select("implementing_type_id", "interface_method_id", "implementation_method_id")


@query("""SELECT id, stable_key FROM {symbols} WHERE id IN (SELECT caller_symbol_id FROM {calls} WHERE source_start = 1 UNION SELECT callee_definition_id FROM {calls} WHERE source_start = 1)""")
def endpoint_hydration(v):
    calls = v.calls.where("source_start = 1")
    return joins.endpoints([(calls, ["caller_symbol_id", "callee_definition_id"])], v.symbols).select("id", "stable_key")


@query("""i AS (SELECT CAST(l_orderkey % 50 AS BIGINT) AS document_id, min(l_partkey) AS id, l_linenumber * 1000 AS source_start, CAST(l_quantity AS INT) * 100 AS source_length FROM {lineitem} GROUP BY ALL),
p AS (SELECT DISTINCT CAST(user_id % 50 AS BIGINT) AS document_id, event_id % 9000 AS position FROM {events})
MAIN SELECT document_id, position, id, source_length FROM (
SELECT p.document_id, position, id, source_length, row_number() OVER (PARTITION BY p.document_id, position ORDER BY source_length, id, source_start) AS r FROM p JOIN i ON i.document_id = p.document_id AND source_start <= position AND source_start + source_length >= position) WHERE r = 1""")
def enclosing_interval(v):
    i = v.lineitem.groupBy((F.col("l_orderkey") % 50).alias("document_id"), (F.col("l_linenumber") * 1000).alias("source_start"), (F.col("l_quantity").cast("int") * 100).alias("source_length")).agg(F.min("l_partkey").alias("id"))
    p = v.events.select((F.col("user_id") % 50).alias("document_id"), (F.col("event_id") % 9000).alias("position"))
    return joins.innermost(i, p).select("document_id", "position", "id", "source_length")


@query("SELECT doc_id AS id FROM {documents} WHERE doc_id NOT IN (SELECT document_id FROM {calls})")
def orphan_anti_join(v):
    return joins.orphans(v.documents.select(F.col("doc_id").alias("id")), "id", v.calls, "document_id")


@query("""m AS (SELECT id, id % 20 AS type_id, accessibility, id % 3 AS assembly_name FROM {symbols}), r AS (SELECT n_nationkey AS receiver, n_nationkey % 20 AS type_id, n_nationkey % 3 AS receiver_assembly FROM {nation})
MAIN SELECT m.id, r.receiver FROM m JOIN r USING (type_id) WHERE accessibility IN (6, 3, 5) OR (accessibility IN (4, 2) AND assembly_name = receiver_assembly)""")
def accessible_members(v):
    members = v.symbols.select("id", (F.col("id") % 20).alias("type_id"), "accessibility", (F.col("id") % 3).alias("assembly_name"))
    receivers = v.nation.select(F.col("n_nationkey").alias("receiver"), (F.col("n_nationkey") % 20).cast("long").alias("type_id"), (F.col("n_nationkey") % 3).alias("receiver_assembly"))
    return joins.accessible(members, receivers).select("id", "receiver")


@query("""SELECT s.id AS symbol_id, d.id AS declaration_id, CAST(row_number() OVER (PARTITION BY s.id ORDER BY CASE declaration_role WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END, normalized_path, source_start, d.id) AS INT) AS declaration_place
FROM {symbols} s JOIN {declarations} d ON d.symbol_id = s.id JOIN {files} f ON f.id = d.document_id WHERE s.kind = 2""")
def definitions(v):
    rows = v.declarations.join(v.files.select(F.col("id").alias("document_id"), "normalized_path"), "document_id")
    roots = v.symbols.where("kind = 2").select(F.col("id").alias("symbol_id"), F.col("id").alias("root_order"))
    return joins.with_declarations(roots, rows).select("symbol_id", F.col("id").alias("declaration_id"), "declaration_place")


# Aggregations --------------------------------------------------------------------------------------------------------


@query("SELECT symbol_name, count(DISTINCT document_id) AS documents, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, symbol_name IN ('click', 'view') AS is_defined FROM {conditional_symbols_used} GROUP BY symbol_name")
def conditions_summary(v):
    return aggregates.conditions(v.conditional_symbols_used, ["click", "view"])


@query("""n AS (SELECT doc_id AS document_id, unnest(['DEBUG', source, lang, 'DEBUG']) AS symbol_name FROM {documents})
MAIN SELECT document_id, symbol_name, CAST(count(*) AS INT) AS occurrence_count FROM n GROUP BY ALL""")
def conditional_symbols(v):
    text = F.concat(F.lit("#if DEBUG && ("), F.col("source"), F.lit(" || true) // NOT\ncode\n  # elif "), F.col("lang"), F.lit(" && !DEBUG\n#endif"))
    return aggregates.conditional_symbols(v.documents.select(F.col("doc_id").alias("document_id"), text.alias("text")))


@query("""SELECT symbol_id, arg_min(id, (CASE declaration_role WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END, document_key, source_start, declaration_key)) AS preferred_declaration_id FROM {declarations} GROUP BY symbol_id""")
def preferred_declaration(v):
    return aggregates.preferred_declaration(v.declarations)


@query("SELECT caller_symbol_id AS symbol_id, CAST(bit_or(s.async_role) AS INT) AS async_role FROM {calls} c JOIN {symbols} s ON s.id = c.callee_definition_id GROUP BY 1")
def merged_roles(v):
    rows = v.calls.join(v.symbols.select(F.col("id").alias("callee_definition_id"), "async_role"), "callee_definition_id")
    return aggregates.merged_roles(rows.select(F.col("caller_symbol_id").alias("symbol_id"), "async_role"))


@query("SELECT caller_symbol_id AS call_id, arg_min(async_usage_kind, CASE async_usage_kind WHEN 0 THEN 7 ELSE async_usage_kind END) AS async_usage_kind FROM {calls} GROUP BY 1")
def strongest_usage(v):
    return aggregates.strongest_usage(v.calls.select(F.col("caller_symbol_id").alias("call_id"), "async_usage_kind"))


@query("""SELECT (SELECT count(*) FROM {supplier}) AS projects, (SELECT count(*) FROM {files}) AS documents, (SELECT count(*) FROM {files} WHERE is_generated) AS generated_documents, (SELECT count(*) FROM {symbols}) AS symbols,
(SELECT count(*) FROM {calls}) AS calls, (SELECT count(*) FROM {calls} WHERE resolution_status <> 1) AS unresolved_calls""")
def index_summary(v):
    return aggregates.summary(v.supplier, v.files, v.symbols, v.calls)


@query("""SELECT l_partkey % 100 AS caller, l_suppkey AS callee, string_agg(CAST(l_orderkey * 100 + l_linenumber AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber) AS sites FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM {lineitem}) GROUP BY ALL""")
def call_sites(v):
    x = v.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").distinct()
    rows = x.select((F.col("l_partkey") % 100).alias("caller_symbol_id"), F.col("l_suppkey").alias("callee_definition_id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("source_start"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    return aggregates.call_sites(rows).select("caller", "callee", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query("SELECT event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ordinal FROM {events} WHERE event_type = 'click'")
def lambda_ordinals(v):
    rows = v.events.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), F.col("ts").alias("source_start"))
    return aggregates.lambda_ordinals(rows).select("id", "ordinal")


# Graphs --------------------------------------------------------------------------------------------------------------


@query("""t(node) AS (SELECT p_partkey FROM {part} WHERE p_size = 6 UNION SELECT s.containing_symbol_id FROM t JOIN {symbols} s ON s.id = t.node WHERE s.kind <> 1 AND s.containing_symbol_id IS NOT NULL)
MAIN SELECT node FROM t""")
def ancestor_closure(v):
    return graph.containing_ancestors(v.symbols, _seeds(v, 6)).select("node")


@query("""t(node) AS (SELECT id FROM {symbols} WHERE id % 40 = 3 UNION SELECT s.id FROM t JOIN {symbols} s ON s.containing_symbol_id = t.node)
MAIN SELECT id, caller_symbol_id, callee_definition_id FROM {calls} WHERE reference_kind IN (1, 2) AND (caller_symbol_id % 40 = 3 OR caller_symbol_id IN (SELECT node FROM t JOIN {symbols} s ON s.id = t.node WHERE s.kind = 3 AND s.id % 40 <> 3))""")
def descendant_calls(v):
    return graph.callees(v.calls, v.symbols, v.symbols.where("id % 40 = 3").select("id")).select(*CALL)


@query("""roots AS (SELECT p_partkey AS root, CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS receiver FROM {part} WHERE p_size = 7 AND p_partkey > 1),
branch(receiver, node) AS (SELECT DISTINCT receiver, receiver FROM roots UNION SELECT b.receiver, r.source_symbol_id FROM branch b JOIN {symbol_relations} r ON r.target_symbol_id = b.node AND r.relation_kind = 1),
reach(root, node) AS (SELECT DISTINCT root, root FROM roots UNION SELECT b.root, r.source_symbol_id FROM reach b JOIN {symbol_relations} r ON r.target_symbol_id = b.node AND r.relation_kind = 3)
MAIN SELECT roots.root, roots.receiver, s.id AS method FROM roots JOIN reach USING (root) JOIN {symbols} s ON s.id = reach.node JOIN branch ON branch.receiver = roots.receiver AND branch.node = s.containing_symbol_id
UNION SELECT root, receiver, root FROM roots""")
def override_expansion(v):
    roots = _seeds(v, 7).where("id > 1").select(F.col("id").alias("root"), F.floor(F.col("id") / 2).alias("receiver"))
    return graph.override_expansion(roots, v.symbols, v.symbol_relations)


@query("""roots AS (SELECT p_partkey AS root, CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS receiver FROM {part} WHERE p_partkey BETWEEN 2 AND 9),
below(receiver, node) AS (SELECT DISTINCT receiver, receiver FROM roots UNION SELECT b.receiver, r.source_symbol_id FROM below b JOIN {symbol_relations} r ON r.target_symbol_id = b.node AND r.relation_kind IN (1, 2))
MAIN SELECT DISTINCT root, roots.receiver, implementation_method_id AS method FROM roots JOIN below ON below.receiver = roots.receiver JOIN {interface_method_bindings} ON implementing_type_id = node AND interface_method_id = root""")
def interface_expansion(v):
    roots = v.part.where("p_partkey between 2 and 9").select(F.col("p_partkey").alias("root"), F.floor(F.col("p_partkey") / 2).alias("receiver"))
    return graph.interface_expansion(roots, v.symbol_relations, v.interface_method_bindings)


@query("""x AS (SELECT id, coalesce(type_kind, 0) = 7 AS i FROM {symbols} WHERE kind = 1 AND id % 8 = 0),
t(receiver, node, i, depth) AS (SELECT id, id, i, 0 FROM x UNION SELECT t.receiver, r.target_symbol_id, i, depth + 1 FROM t JOIN {symbol_relations} r ON r.source_symbol_id = t.node AND r.relation_kind = CASE WHEN i THEN 2 ELSE 1 END WHERE depth < 20)
MAIN SELECT receiver, node AS type, CAST(min(depth) AS INT) AS depth FROM t GROUP BY receiver, node HAVING min(depth) > 0""")
def inherited_min_depth(v):
    return graph.inherited_depths(v.symbols.where("kind = 1 and id % 8 = 0"), v.symbol_relations)


@query()
def descendant_calls_all(v):
    """From all symbols; descendant_calls takes one symbol in 40, as its SQL does."""
    return graph.callees(v.calls, v.symbols, v.symbols.select("id")).select(*CALL)


@query()
def interface_expansion_all(v):
    """From all bound interface methods; interface_expansion takes eight, as its SQL does."""
    roots = v.interface_method_bindings.select(F.col("interface_method_id").alias("root")).distinct()
    return graph.interface_expansion(roots.withColumn("receiver", F.floor(F.col("root") / 2)), v.symbol_relations, v.interface_method_bindings)


@query()
def inherited_min_depth_all(v):
    """From all types; inherited_min_depth takes one in eight, as its SQL does."""
    return graph.inherited_depths(v.symbols.where("kind = 1"), v.symbol_relations)


def _call_edges(v: Views) -> DataFrame:
    s = v.symbols.select("id", "stable_key")
    calls = v.calls.join(s.select(F.col("id").alias("caller_symbol_id"), F.col("stable_key").alias("caller_key")), "caller_symbol_id")
    return graph.call_edges(calls.withColumn("document_key", F.col("document_id").cast("string")))


def _involved(v: Views) -> DataFrame:
    return graph.propagate(v.symbols.where("async_role = 5").select("id", F.col("stable_key").alias("key")), _call_edges(v))


@query("""t(id, d) AS (SELECT id, 0 FROM {symbols} WHERE async_role = 5 UNION SELECT c.caller_symbol_id, d + 1 FROM t JOIN {calls} c ON c.callee_definition_id = t.id AND c.reference_kind = 1 WHERE d < 40)
MAIN SELECT id, CAST(min(d) AS INT) AS depth FROM t GROUP BY id""")
def async_depth(v):
    """Depths alone need no places in queues."""
    return graph.depths(v.symbols.where("async_role = 5").select("id"), _call_edges(v))


@query()
def async_next_hop(v):
    """Depth and next hop; the order of queues is beyond plain SQL, so tests hold it against a FIFO search."""
    return _involved(v).select("id", "depth", "next")


TREE = """t(id, d) AS (SELECT min(callee_definition_id), 0 FROM {calls} UNION SELECT c.caller_symbol_id, d + 1 FROM t JOIN {calls} c ON c.callee_definition_id = t.id WHERE d < 3 AND c.caller_symbol_id % 10 > 0),
n AS (SELECT id, CAST(min(d) AS INT) AS depth FROM t GROUP BY id)"""


def _tree(v: Views) -> graph.CallerTree:
    root = v.calls.agg(F.min("callee_definition_id")).first()[0]
    symbols = v.symbols.select("id", F.col("id").alias("sym_rank"), (F.col("id") % 10 > 0).alias("eligible"))
    return graph.caller_tree(v.calls, symbols, root, max_depth=3, max_nodes=100_000)


@query(TREE + " MAIN SELECT id, depth FROM n")
def caller_tree_nodes(v):
    return _tree(v).nodes


@query(TREE + " MAIN SELECT caller_symbol_id AS caller, callee_definition_id AS callee FROM {calls} JOIN n a ON a.id = caller_symbol_id JOIN n b ON b.id = callee_definition_id WHERE caller_symbol_id % 10 > 0")
def caller_tree_edges(v):
    return _tree(v).edges


@query(TREE + """, e AS (SELECT caller_symbol_id AS caller, callee_definition_id AS callee, a.depth AS cd, b.depth AS pd FROM {calls} JOIN n a ON a.id = caller_symbol_id JOIN n b ON b.id = callee_definition_id WHERE caller_symbol_id % 10 > 0)
MAIN SELECT caller, callee, pd = cd - 1 AND callee = min(callee) FILTER (WHERE pd = cd - 1) OVER (PARTITION BY caller) AS spanning FROM e""")
def spanning_edges(v):
    t = _tree(v)
    return graph.spanning_edges(t.nodes.withColumn("sym_rank", F.col("id")), t.edges).select("caller", "callee", "spanning")


@query("""SELECT DISTINCT id FROM (SELECT caller_symbol_id AS id FROM {calls} UNION ALL SELECT coalesce(s.containing_symbol_id, s.id) FROM {calls} c JOIN {symbols} s ON s.id = c.caller_symbol_id)""")
def callers_scope_both(v):
    return graph.caller_scope(v.calls, v.symbols, CallerScope.BOTH)


@query("SELECT source_symbol_id, target_symbol_id, relation_kind FROM {symbol_relations} WHERE relation_kind IN (3, 4, 5) AND target_symbol_id IN (SELECT p_partkey FROM {part} WHERE p_size = 8)")
def possible_targets(v):
    return graph.possible_targets(v.symbol_relations, _seeds(v, 8), DispatchSearch.ALL).select("source_symbol_id", "target_symbol_id", "relation_kind")


# Orders --------------------------------------------------------------------------------------------------------------

PLACED = """SELECT s.id, CAST(row_number() OVER (ORDER BY namespace_name, type_identity_path, executable_identity_path, f.normalized_path NULLS LAST, d.source_start NULLS LAST, stable_key) AS BIGINT) AS sym_rank
FROM {symbols} s LEFT JOIN {declarations} d ON d.id = s.preferred_declaration_id LEFT JOIN {files} f ON f.id = d.document_id"""


def _ranks(v: Views) -> DataFrame:
    d = v.declarations.select(F.col("id").alias("preferred_declaration_id"), "document_id", "source_start")
    f = v.files.select(F.col("id").alias("document_id"), "normalized_path")
    return ordering.symbol_ranks(v.symbols.join(d, "preferred_declaration_id", "left").join(f, "document_id", "left"))


@query(PLACED)
def symbol_canonical_order(v):
    return _ranks(v)


@query(f"""r AS ({PLACED}) MAIN SELECT c.id, CAST(row_number() OVER (ORDER BY a.sym_rank, b.sym_rank NULLS LAST, f.normalized_path, c.source_start, c.source_length, reference_kind, dispatch_kind, resolution_status, resolution_reason, async_usage_kind, c.id) AS BIGINT) AS place
FROM {{calls}} c JOIN r a ON a.id = c.caller_symbol_id LEFT JOIN r b ON b.id = c.callee_definition_id JOIN {{files}} f ON f.id = c.document_id""")
def call_canonical_order(v):
    f = v.files.select(F.col("id").alias("document_id"), "normalized_path")
    rows = v.calls.join(f, "document_id").withColumn("unresolved_name", F.lit(None).cast("string"))
    return ordering.call_places(rows, _ranks(v)).select("id", "place")


@query(f"""r AS ({PLACED}) MAIN SELECT source_symbol_id, target_symbol_id, relation_kind, CAST(row_number() OVER (ORDER BY a.sym_rank, b.sym_rank, relation_kind) AS BIGINT) AS place
FROM (SELECT DISTINCT source_symbol_id, target_symbol_id, relation_kind FROM {{symbol_relations}}) JOIN r a ON a.id = source_symbol_id JOIN r b ON b.id = target_symbol_id""")
def relation_canonical_order(v):
    rows = v.symbol_relations.select("source_symbol_id", "target_symbol_id", "relation_kind").distinct()
    return ordering.relation_places(rows, _ranks(v))


@query("""SELECT id, CAST(row_number() OVER (ORDER BY namespace_name NULLS FIRST, type_identity_path NULLS FIRST, executable_identity_path NULLS FIRST, normalized_path NULLS FIRST, source_start NULLS FIRST, id) AS BIGINT) AS place
FROM (SELECT s.id, namespace_name, type_identity_path, executable_identity_path, f.normalized_path, d.source_start FROM {symbols} s LEFT JOIN {declarations} d ON d.id = s.preferred_declaration_id LEFT JOIN {files} f ON f.id = d.document_id)""")
def repository_order(v):
    d = v.declarations.select(F.col("id").alias("preferred_declaration_id"), "document_id", "source_start")
    rows = v.symbols.join(d, "preferred_declaration_id", "left").join(v.files.select(F.col("id").alias("document_id"), "normalized_path"), "document_id", "left")
    return ranked(rows, ordering.repository_order(), "place").select("id", "place")


# The query service ---------------------------------------------------------------------------------------------------

#: Executables of one int, not generic, in three namespaces, whose own declaration is not generated.
REQUEST = Request(conditions=(C.Condition("method", "*(int)"), C.Condition("namespace", "Ns[1-3]", "regex")), generated=GeneratedFilter.EXCLUDE)
SELECTED = """roots AS (SELECT s.*, f.normalized_path, d.source_start FROM {code_symbols} s JOIN {code_declarations} d ON d.id = s.preferred_declaration_id JOIN {files} f ON f.id = d.document_id
  WHERE s.kind IN (2, 3, 4, 5) AND s.id % 4 = 1 AND regexp_full_match(namespace_name, 'Ns[1-3]') AND NOT d.is_generated),
ranks AS (SELECT s.id, row_number() OVER (ORDER BY namespace_name, type_identity_path, executable_identity_path, f.normalized_path NULLS LAST, d.source_start NULLS LAST, stable_key) AS sym_rank
  FROM {code_symbols} s LEFT JOIN {code_declarations} d ON d.id = s.preferred_declaration_id LEFT JOIN {files} f ON f.id = d.document_id)"""
CALL_PLACES = """SELECT c.id, CAST(row_number() OVER (ORDER BY a.sym_rank, b.sym_rank NULLS LAST, f.normalized_path, c.source_start, c.source_length, reference_kind, async_usage_kind, c.id) AS BIGINT) AS place
FROM {code_calls} c JOIN ranks a ON a.id = c.caller_symbol_id LEFT JOIN ranks b ON b.id = c.callee_definition_id JOIN {files} f ON f.id = c.document_id WHERE """
NAMED = "(callee_definition_id IN (SELECT id FROM roots) OR c.id IN (SELECT call_id FROM {code_candidates} WHERE candidate_symbol_id IN (SELECT id FROM roots)))"


def _service(v: Views) -> Service:
    tables = {"symbols": v.code_symbols, "symbol_declarations": v.code_declarations, "documents": v.files, "calls": v.code_calls, "call_candidates": v.code_candidates}
    return Service(tables | {n: getattr(v, n) for n in ("symbol_relations", "interface_method_bindings", "conditional_symbols_used")}, 1)


@query(SELECTED + " MAIN SELECT r.id, CAST(row_number() OVER (ORDER BY sym_rank) AS BIGINT) AS place FROM roots r JOIN ranks USING (id)")
def service_symbol_list(v):
    return _service(v).symbol_list(REQUEST).select("id", "place")


@query(r"""SELECT s.id FROM {code_symbols} s JOIN {code_declarations} d ON d.id = s.preferred_declaration_id WHERE kind IN (2, 3, 4, 5) AND (regexp_full_match(type_identity_path, 'Brand1[0-9]*') OR regexp_full_match(type_identity_path, 'Brand2[0-9]*<T>')
OR regexp_full_match(type_identity_path, '[^.]*\.Inner<A,B>')) AND regexp_matches(executable_identity_path, '^small_ring[<(]')""")
def service_type_and_method_conditions(v):
    """Globs over generic types, an arity that is given and one that any has by its star, and a literal method, which is any overload."""
    cs = (C.Condition("type", "Brand1[0-9]*", "regex"), C.Condition("type", "Brand2*<X>"), C.Condition("type", "*.Inner<X,Y>"), C.Condition("method", "small_ring", "literal"))
    return _service(v).symbol_find(Request(conditions=cs, kind=None)).join(v.code_declarations.select(F.col("id").alias("preferred_declaration_id")), "preferred_declaration_id", "left_semi").select("id")


@query("SELECT id FROM {code_symbols} WHERE kind IN (2, 3, 4, 5) AND name = 'red_widget' AND id % 4 = 3 AND NOT regexp_matches(type_identity_path, '<')")
def service_symbol_find(v):
    """A selector with aliases, whose leaf name reaches the files."""
    return _service(v).symbol_find(Request("*::red_widget(string, int)")).where(~F.col("type_identity_path").contains("<")).select("id")


@query(SELECTED + " MAIN " + CALL_PLACES + NAMED)
def service_references(v):
    return _service(v).references(REQUEST).select("id", "place")


@query(SELECTED + " MAIN " + CALL_PLACES + NAMED + " AND reference_kind IN (1, 2) AND NOT f.is_generated")
def service_callers(v):
    return _service(v).callers(REQUEST, generated=GeneratedFilter.EXCLUDE)[0].select("id", "place")


@query(SELECTED + """, c AS (SELECT c.caller_symbol_id FROM {code_calls} c JOIN {files} f ON f.id = c.document_id WHERE """ + NAMED + """ AND reference_kind IN (1, 2)),
x AS (SELECT caller_symbol_id AS id FROM c UNION SELECT coalesce(s.containing_symbol_id, s.id) FROM c JOIN {code_symbols} s ON s.id = c.caller_symbol_id)
MAIN SELECT id, CAST(row_number() OVER (ORDER BY sym_rank) AS BIGINT) AS place FROM x JOIN ranks USING (id)""")
def service_effective_callers(v):
    return _service(v).callers(REQUEST, scope=CallerScope.BOTH)[1].select("id", "place")


@query(SELECTED + """ MAIN SELECT source_symbol_id, target_symbol_id, relation_kind, CAST(row_number() OVER (ORDER BY a.sym_rank, b.sym_rank, relation_kind) AS BIGINT) AS place
FROM {symbol_relations} JOIN ranks a ON a.id = source_symbol_id JOIN ranks b ON b.id = target_symbol_id WHERE relation_kind IN (3, 4, 5) AND target_symbol_id IN (SELECT id FROM roots)""")
def service_runtime_targets(v):
    return _service(v).callers(REQUEST, dispatch=DispatchSearch.ALL)[2].select("source_symbol_id", "target_symbol_id", "relation_kind", "place")


@query(SELECTED + """, t(node) AS (SELECT id FROM roots UNION SELECT s.id FROM t JOIN {code_symbols} s ON s.containing_symbol_id = t.node)
MAIN """ + CALL_PLACES + "reference_kind IN (1, 2) AND (c.caller_symbol_id IN (SELECT id FROM roots) OR c.caller_symbol_id IN (SELECT node FROM t JOIN {code_symbols} s ON s.id = t.node WHERE s.kind = 3))")
def service_callees(v):
    return _service(v).callees(REQUEST).select("id", "place")


@query(SELECTED + """ MAIN SELECT source_symbol_id, target_symbol_id, CAST(row_number() OVER (ORDER BY a.sym_rank, b.sym_rank) AS BIGINT) AS place
FROM {symbol_relations} JOIN ranks a ON a.id = source_symbol_id JOIN ranks b ON b.id = target_symbol_id WHERE relation_kind = 3 AND target_symbol_id IN (SELECT id FROM roots WHERE kind = 2)""")
def service_overrides(v):
    return _service(v).overrides(REQUEST).select("source_symbol_id", "target_symbol_id", "place")


@query(SELECTED + """ MAIN SELECT d.id AS declaration_id, CAST(row_number() OVER (ORDER BY sym_rank, CASE declaration_role WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS BIGINT) AS place
FROM roots JOIN ranks USING (id) JOIN {code_declarations} d ON d.symbol_id = roots.id""")
def service_definition(v):
    rows = _service(v).definition(REQUEST)
    return ranked(rows, [F.asc("root_order"), F.asc("declaration_place")], "place").select(F.col("id").alias("declaration_id"), "place")


@query(SELECTED + """ MAIN SELECT d.id AS declaration_id, CAST(row_number() OVER (ORDER BY sym_rank, f.normalized_path, d.source_start, d.id) AS BIGINT) AS place
FROM roots r JOIN ranks USING (id) JOIN {code_declarations} d ON d.symbol_id = r.id JOIN {files} f ON f.id = d.document_id WHERE contains(f.source_text, 'the') AND NOT contains(f.source_text, 'License')""")
def service_source_search(v):
    more = (C.Condition("include", "the", "literal"), C.Condition("exclude", "License", "literal"))
    return _service(v).source_search(Request(conditions=REQUEST.conditions + more, generated=REQUEST.generated)).select(F.col("id").alias("declaration_id"), "place")


@query(r"""p AS (SELECT id AS document_id, normalized_path || ':1:6' AS "at" FROM {files} WHERE id < 100 AND regexp_matches(source_text, '^[ -~][ -~][ -~][ -~][ -~][ -~]')),
c AS (SELECT p."at", callee_definition_id AS called, row_number() OVER (PARTITION BY p."at" ORDER BY source_length, c.id) AS r FROM p JOIN {code_calls} c ON c.document_id = p.document_id AND source_start <= 5 AND source_start + source_length >= 5),
d AS (SELECT p."at", symbol_id, row_number() OVER (PARTITION BY p."at" ORDER BY source_length, d.id) AS r FROM p JOIN {code_declarations} d ON d.document_id = p.document_id AND source_start <= 5 AND source_start + source_length >= 5),
s AS (SELECT p."at", coalesce(called, d.symbol_id) AS symbol_id FROM p LEFT JOIN c ON c."at" = p."at" AND c.r = 1 LEFT JOIN d ON d."at" = p."at" AND d.r = 1)
MAIN SELECT s."at", s.symbol_id, x.id AS declaration_id FROM s JOIN {code_declarations} x ON x.symbol_id = s.symbol_id""")
def service_definition_at(v):
    at = v.files.where((F.col("id") < 100) & F.col("source_text").rlike("^[ -~][ -~][ -~][ -~][ -~][ -~]")).select(F.concat("normalized_path", F.lit(":1:6")).alias("at"))
    return _service(v).definition_at(at)


GRAPH = """ok AS (SELECT s.id FROM {code_symbols} s JOIN {code_declarations} d ON d.id = s.preferred_declaration_id AND d.symbol_id = s.id WHERE s.kind IN (2, 3, 4, 5))"""


@query(GRAPH + """, e AS (SELECT DISTINCT caller_symbol_id AS a, callee_definition_id AS b FROM {code_calls} c JOIN {files} f ON f.id = c.document_id WHERE reference_kind = 1 AND caller_symbol_id IN (SELECT id FROM ok) AND callee_definition_id IN (SELECT id FROM ok)),
t(id, d) AS (SELECT id, 0 FROM {code_symbols} WHERE async_role <> 0 AND id IN (SELECT id FROM ok) UNION SELECT e.a, d + 1 FROM t JOIN e ON e.b = t.id WHERE d < 30)
MAIN SELECT id, CAST(min(d) AS INT) AS depth FROM t GROUP BY id""")
def service_async_involvement(v):
    return _service(v).involved().select("id", "depth")


EDGES = """, ok AS (SELECT s.id FROM {code_symbols} s JOIN {code_declarations} d ON d.id = s.preferred_declaration_id JOIN {files} f ON f.id = d.document_id WHERE s.kind IN (2, 3, 4, 5) AND s.namespace_name <> 'System' AND NOT starts_with(s.namespace_name, 'System.')),
h AS (SELECT caller_symbol_id AS a, callee_definition_id AS b FROM {code_calls} WHERE reference_kind IN (1, 2) UNION SELECT caller_symbol_id, candidate_symbol_id FROM {code_calls} c JOIN {code_candidates} ON call_id = c.id WHERE reference_kind IN (1, 2)),
e AS (SELECT a, b FROM h WHERE a IN (SELECT id FROM ok)),
t(id, d) AS (SELECT min(callee_definition_id), 0 FROM {code_calls} UNION SELECT e.a, d + 1 FROM t JOIN e ON e.b = t.id WHERE d < 2), n AS (SELECT id, min(d) AS depth FROM t GROUP BY id)"""


@query(SELECTED + EDGES + " MAIN SELECT id, CAST(depth AS INT) AS depth, CAST(row_number() OVER (ORDER BY depth, sym_rank) AS BIGINT) AS place FROM n JOIN ranks USING (id)")
def service_tree_nodes(v):
    root = v.code_calls.agg(F.min("callee_definition_id")).first()[0]
    return _service(v).tree_of(root, 2, 10_000).nodes.select("id", "depth", "place")


@query(SELECTED + EDGES + """ MAIN SELECT a AS caller, b AS callee, y.depth = x.depth - 1 AND q.sym_rank = min(q.sym_rank) FILTER (WHERE y.depth = x.depth - 1) OVER (PARTITION BY a) AS spanning,
CAST(row_number() OVER (ORDER BY y.depth, q.sym_rank, x.depth, p.sym_rank) AS BIGINT) AS place
FROM e JOIN n x ON x.id = a JOIN n y ON y.id = b JOIN ranks p ON p.id = a JOIN ranks q ON q.id = b""")
def service_tree_edges(v):
    root = v.code_calls.agg(F.min("callee_definition_id")).first()[0]
    return _service(v).tree_of(root, 2, 10_000).edges.select("caller", "callee", "spanning", "place")


@query(SELECTED + EDGES + """, i AS (SELECT a, b, row_number() OVER (ORDER BY y.depth, q.sym_rank, x.depth, p.sym_rank) AS edge_index FROM e JOIN n x ON x.id = a JOIN n y ON y.id = b JOIN ranks p ON p.id = a JOIN ranks q ON q.id = b),
s AS (SELECT DISTINCT c.id AS call_id, caller_symbol_id AS a, k AS b, document_id, source_start, source_length FROM (SELECT *, callee_definition_id AS k FROM {code_calls} UNION ALL SELECT c.*, candidate_symbol_id FROM {code_calls} c JOIN {code_candidates} ON call_id = c.id) c WHERE reference_kind IN (1, 2))
MAIN SELECT call_id, CAST(edge_index AS BIGINT) AS edge_index, CAST(row_number() OVER (ORDER BY edge_index, f.normalized_path, source_start, source_length, call_id) AS BIGINT) AS place FROM s JOIN i USING (a, b) JOIN {files} f ON f.id = s.document_id""")
def service_call_sites(v):
    service = _service(v)
    tree = service.tree_of(v.code_calls.agg(F.min("callee_definition_id")).first()[0], 2, 10_000)
    return service.call_sites(tree).select("call_id", "edge_index", "place")


@query("""roots AS (SELECT s.id AS root, s.containing_symbol_id AS receiver, t.type_kind = 7 AS i FROM {code_symbols} s JOIN {code_symbols} t ON t.id = s.containing_symbol_id WHERE s.id % 4 = 1),
b(receiver, node) AS (SELECT DISTINCT receiver, receiver FROM roots WHERE NOT coalesce(i, false) UNION SELECT b.receiver, r.source_symbol_id FROM b JOIN {symbol_relations} r ON r.target_symbol_id = b.node AND r.relation_kind = 1),
o(root, node) AS (SELECT DISTINCT root, root FROM roots WHERE NOT coalesce(i, false) UNION SELECT o.root, r.source_symbol_id FROM o JOIN {symbol_relations} r ON r.target_symbol_id = o.node AND r.relation_kind = 3),
l(receiver, node) AS (SELECT DISTINCT receiver, receiver FROM roots WHERE i UNION SELECT l.receiver, r.source_symbol_id FROM l JOIN {symbol_relations} r ON r.target_symbol_id = l.node AND r.relation_kind IN (1, 2))
MAIN SELECT root, s.id AS method FROM roots JOIN o USING (root) JOIN {code_symbols} s ON s.id = o.node JOIN b ON b.receiver = roots.receiver AND b.node = s.containing_symbol_id WHERE NOT coalesce(i, false)
UNION SELECT root, implementation_method_id FROM roots JOIN l ON l.receiver = roots.receiver JOIN {interface_method_bindings} ON implementing_type_id = node AND interface_method_id = root WHERE i
UNION SELECT s.id, s.id FROM {code_symbols} s WHERE s.id % 4 = 1""")
def root_dispatcher(v):
    return graph.expand_roots(v.code_symbols.where("id % 4 = 1").select("id"), v.code_symbols, v.symbol_relations, v.interface_method_bindings)


@query("SELECT symbol_name, count(DISTINCT document_id) AS documents, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, symbol_name IN ('click', 'view') AS is_defined FROM {conditional_symbols_used} GROUP BY symbol_name")
def service_conditions(v):
    return _service(v).conditions(["click", "view"])


# Sets and stores -----------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id FROM {documents} GROUP BY text")
def normalized_dedup(v):
    """Texts once each, the first by id."""
    rows = v.documents.select(F.lower(F.hex(T.text_hash(F.col("text")))).alias("hash"), F.col("doc_id").alias("first_id"))
    return ordering.first_by(rows, ["hash"], [F.asc("first_id")])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM {customer}""")
def upsert(v):
    old = v.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    return store.upsert(old, old.where("id % 3 = 0").withColumn("value", F.lit("new")), ["id"])


# Scalar functions ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, substr(text, 4, 5) AS slice FROM {documents} WHERE length(text) >= 8")
def utf16_slice(v):
    return v.documents.where(T.utf16_length(F.col("text")) >= 8).select("doc_id", T.utf16_slice(F.col("text"), F.lit(3), F.lit(5)).alias("slice"))


@query("SELECT doc_id, CAST(1 + length(left(text, 200)) - length(replace(left(text, 200), chr(10), '')) AS INT) AS line, CAST(length(regexp_extract(left(text, 200), '[^\\n]*$')) + 1 AS INT) AS col FROM {documents}")
def line_column(v):
    return v.documents.select("doc_id", T.line_of(F.col("text"), F.lit(200)).alias("line"), T.column_of(F.col("text"), F.lit(200)).alias("col"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 5 = 1 THEN 3 WHEN doc_id % 5 = 2 THEN 4 WHEN doc_id % 5 = 3 THEN 2 ELSE 0 END AS INT) AS kind FROM {documents}")
def generation_kind(v):
    m = F.col("doc_id") % 5
    path = F.when(m == 0, "a/B.Designer.cs").when(m == 1, "x/GENERATED/a.cs").when(m == 2, "o/P.AssemblyAttributes.cs").otherwise("src/a.cs")
    return v.documents.select("doc_id", T.generation_kind(path, F.when(m == 3, F.concat(F.lit("// <AUTO-GENERATED>\n"), "text")).otherwise(F.col("text"))).alias("kind"))


@query("SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.cs' AS path FROM {documents}")
def normalized_paths(v):
    raw = F.concat(F.lit(".\\"), F.col("source"), F.lit("/x//../"), F.lit("./"), F.col("doc_id").cast("string"), F.lit(".cs"))
    return v.documents.select("doc_id", T.normalize_path(raw).alias("path"))


@query("SELECT id, namespace_name || '.' || type_display_path || '::' || executable_display_path AS csharp, namespace_name || '::' || type_display_path || '::' || executable_display_path AS explicit FROM {symbols}")
def display_paths(v):
    c = [F.col(x) for x in ("namespace_name", "type_display_path", "executable_display_path")]
    return v.symbols.select("id", T.display_path(*c).alias("csharp"), T.display_path(*c, style="explicit").alias("explicit"))


@query("SELECT id, CASE async_role WHEN 5 THEN ' [async: DeclaredAsync, ContainsAwait; depth: ' || CAST(id % 4 AS VARCHAR) || ']' WHEN 2 THEN ' [async: ReturnsAwaitable; depth: ' || CAST(id % 4 AS VARCHAR) || ']' ELSE ' [depth: ' || CAST(id % 4 AS VARCHAR) || ']' END AS suffix FROM {symbols}")
def async_suffixes(v):
    return v.symbols.select("id", T.async_suffix(F.col("async_role"), F.col("id") % 4).alias("suffix"))


@query("SELECT CAST(doc_id AS VARCHAR) || chr(9) || lang || chr(9) || replace(text, chr(10), ' ') AS line FROM {documents}")
def table_output(v):
    return table_lines(v.documents, ["doc_id", "lang", "text"])


@query(TREE.replace("d < 3", "d < 1") + " MAIN SELECT id, depth FROM n WHERE depth = 0 OR id IN (SELECT id FROM n WHERE depth = 1 ORDER BY id LIMIT 2)")
def node_cap(v):
    """The root and the first two callers in canonical order."""
    root = v.calls.agg(F.min("callee_definition_id")).first()[0]
    symbols = v.symbols.select("id", F.col("id").alias("sym_rank"), (F.col("id") % 10 > 0).alias("eligible"))
    return graph.caller_tree(v.calls, symbols, root, max_depth=1, max_nodes=3).nodes


@query("""SELECT l_orderkey, l_linenumber, CAST((CASE WHEN a THEN 1 ELSE 0 END) | (CASE WHEN a AND v THEN 32 ELSE 0 END) | (CASE WHEN a AND i THEN 8 ELSE 0 END) | (CASE WHEN k = 0 THEN 2 ELSE 0 END) | (CASE WHEN k = 1 THEN 16 ELSE 0 END) AS INT) AS role
FROM (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS a, l_linestatus = 'O' AS v, l_tax > 0.04 AS i, l_partkey % 3 AS k FROM {lineitem})""")
def async_roles(v):
    k = F.col("l_partkey") % 3
    kind = F.when(k == 0, "System.Threading.Tasks.Task`1").when(k == 1, "System.Collections.Generic.IAsyncEnumerable`1").otherwise("System.Void")
    role = T.async_role(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_tax") > 0.04, kind)
    return v.lineitem.select("l_orderkey", "l_linenumber", role.alias("role"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 3 WHEN p_size % 4 = 1 OR p_partkey % 2 = 0 THEN 2 ELSE 1 END AS kind FROM {part}")
def dispatch_kinds(v):
    kind = T.dispatch_kind(F.when(F.col("p_size") % 4 == 0, 7).otherwise(2), F.col("p_size") % 4 == 1, F.col("p_partkey") % 2 == 0, F.lit(None).cast("boolean"))
    return v.part.select("p_partkey", kind.alias("kind"))


@query("""SELECT id, 'profile:p|assembly:' || coalesce(nullif(source, 'src0'), 'source') || '|tfm:unknown|M:' || id AS stable, 'k' || id || '|declaration:' || source || ':' || source_start || ':10:' || declaration_role AS declared
FROM (SELECT d.*, document_key AS source FROM {declarations} d)""")
def stable_keys(v):
    i = F.col("id").cast("string")
    stable = T.stable_key(F.lit("p"), F.nullif(F.col("document_key"), F.lit("src0")), F.lit(None).cast("string"), F.concat(F.lit("M:"), i))
    return v.declarations.select("id", stable.alias("stable"), T.declaration_key(F.concat(F.lit("k"), i), F.col("document_key"), F.col("source_start"), F.col("source_length"), F.col("declaration_role")).alias("declared"))


@query(SELECTED + """ MAIN SELECT '  ' || f.normalized_path || ':1:' || (1 + c.source_start) || '  ' || a.namespace_name || '.' || a.type_display_path || '::' || a.executable_display_path || ' -> ' || b.namespace_name || '.' || b.type_display_path || '::' || b.executable_display_path
|| CASE reference_kind WHEN 1 THEN ' [Invocation' ELSE ' [MethodGroup' END || ', Resolved] [' || CASE async_usage_kind WHEN 0 THEN 'None' WHEN 1 THEN 'Awaited' WHEN 2 THEN 'Forwarded' WHEN 3 THEN 'Stored' WHEN 4 THEN 'Passed' WHEN 5 THEN 'Discarded' ELSE 'Unobserved' END || ']' AS line
FROM {code_calls} c JOIN {code_symbols} a ON a.id = c.caller_symbol_id JOIN {code_symbols} b ON b.id = c.callee_definition_id JOIN {files} f ON f.id = c.document_id
WHERE """ + NAMED + """ AND regexp_matches(f.source_text, '^[ -~][ -~][ -~][ -~][ -~][ -~][ -~][ -~]')""")
def service_call_lines(v):
    """References as table lines, where the first line of the source is long enough for the place to be in it."""
    service = _service(v)
    calls = service.references(REQUEST).drop("place")
    plain = v.files.where(F.col("source_text").rlike("^[ -~][ -~][ -~][ -~][ -~][ -~][ -~][ -~]")).select(F.col("id").alias("document_id"))
    named = layouts.with_names(layouts.located(calls.join(plain, "document_id", "left_semi"), v.files), v.code_symbols, {"caller_symbol_id": "caller_name", "callee_definition_id": "target_name"})
    return layouts.call_lines(named)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols are how far from an asynchronous origin."""
    return _involved(Views(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("symbols")).orderBy("depth")
