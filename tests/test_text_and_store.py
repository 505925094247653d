import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skeingraph.functions import text as T
from skeingraph.operators import aggregates, layouts, output
from skeingraph.operators.integrity import IntegrityError, resolved_names
from skeingraph.operators.joins import innermost
from skeingraph.schema import SCHEMAS
from skeingraph.sources import files, store


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head()["x"]


def test_utf16(spark):
    assert one(spark, T.utf16_slice(F.col("t"), F.lit(1), F.lit(3)), t="a😀bc") == "😀b"
    assert one(spark, T.utf16_length(F.col("t")), t="a😀") == 3
    with pytest.raises(Exception, match="outside"):
        one(spark, T.utf16_slice(F.col("t"), F.lit(1), F.lit(9)), t="abc")


@pytest.mark.parametrize(("offset", "line", "column"), [(0, 1, 1), (2, 1, 3), (4, 2, 1), (5, 3, 1), (99, 4, 2), (3, 2, 1)])
def test_positions(spark, offset, line, column):
    text = "ab\r\n\rc\nd"
    got = one(spark, F.struct(T.line_of(F.col("t"), F.lit(offset)), T.column_of(F.col("t"), F.lit(offset))), t=text)
    assert tuple(got) == (line, column)
    if offset not in (3, 99):
        assert one(spark, T.offset_of(F.col("t"), F.lit(line), F.lit(column)), t=text) == offset


def test_paths_and_symbols(spark):
    norm = lambda p: one(spark, T.normalize_path(F.col("t")), t=p)
    assert [norm(p) for p in ("a\\.\\b//c", "a/../b", "", "../a", "/a", "c:x", "a/../..", "a/b/../../../c")] == ["a/b/c", "b", ".", None, None, None, None, None]
    assert tuple(one(spark, T.parse_position(F.col("t")), t="c:/x.cs:10:3")) == ("c:/x.cs", 10, 3)
    assert T.preprocessor_symbols("net6.0-windows", ["A"], ["NET"]) == ["A", "NET5_0_OR_GREATER", "NET6_0", "NET6_0_OR_GREATER", "WINDOWS"]
    assert one(spark, T.short_types(F.col("t")), t="M(System.Int32, A.B.C<X.Y>)") == "M(Int32, C<Y>)"


def test_innermost_includes_ends(spark):
    i = spark.createDataFrame([(1, 10, 0, 5000), (1, 11, 100, 20), (1, 12, 100, 20)], "document_id long, id long, source_start int, source_length int")
    p = spark.createDataFrame([(1, 120), (1, 121), (1, 5001), (1, 4999)], "document_id long, position int")
    assert {r["position"]: r["id"] for r in innermost(i, p).collect()} == {120: 11, 121: 10, 4999: 10}


def test_directory_input(spark, tmp_path):
    for name, text in {"a.cs": "class A", "obj/b.cs": "", "x/c.g.cs": "#if DEBUG\n#endif", "x/skip.cs": "", "n.txt": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["path"]: r for r in files.load_directory(spark, str(tmp_path), ["**/SKIP.cs"]).collect()}
    assert {p: r["generation_kind"] for p, r in rows.items()} == {"a.cs": 0, "x/c.g.cs": 1}
    assert bytes(rows["a.cs"]["content_hash"]) == hashlib.sha256(b"class A").digest()
    assert files.resolve_input(str(tmp_path)).mode == files.InputMode.DIRECTORY
    (tmp_path / "p.csproj").write_text("")
    assert files.resolve_input(str(tmp_path)).mode == files.InputMode.PROJECT
    for s in ("a.sln", "b.sln"):
        (tmp_path / s).write_text("")
    with pytest.raises(files.InputError):
        files.resolve_input(str(tmp_path))
    (tmp_path / "d.txt").write_text("# no\n A \n\nB\nA\n")
    assert files.read_defines(spark, [str(tmp_path / "d.txt")]) == ["A", "B"]
    s = spark.createDataFrame([(1, "#if A && !B // C\n#elif true || A")], "document_id long, text string")
    assert {r["symbol_name"]: r["occurrence_count"] for r in aggregates.conditional_symbols(s).collect()} == {"A": 2, "B": 1}


def blank(name, **values):
    """A row of a table with plain values where none is given."""
    plain = {"string": "", "int": 0, "bigint": 0, "boolean": False, "binary": b"", "array<string>": [], "timestamp": None}
    return tuple(values.get(f.name, None if f.nullable else plain[f.dataType.simpleString()]) for f in SCHEMAS[name])


def snapshot(spark, role=1, length=3):
    sha = hashlib.sha256(b"abc").digest()
    rows = {
        "projects": [blank("projects", id=1)],
        "normalized_sources": [blank("normalized_sources", id=5, normalized_source_hash=sha, normalized_source="abc"), blank("normalized_sources", id=6, normalized_source_hash=hashlib.sha256(b"x").digest(), normalized_source="x")],
        "documents": [blank("documents", id=3, project_id=1, normalized_path="a.cs", normalized_source_id=5)],
        "symbols": [blank("symbols", id=9, stable_key="k", kind=2, preferred_declaration_id=4)],
        "symbol_declarations": [blank("symbol_declarations", id=4, declaration_key="d", symbol_id=9, document_id=3, declaration_role=role, normalized_length=length)],
    }
    return {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}


def test_store_round_trip_and_faults(spark, tmp_path):
    with pytest.raises(store.StoreError):
        store.load(spark, str(tmp_path), "p")
    store.save(spark, str(tmp_path), "p", snapshot(spark))
    store.save(spark, str(tmp_path), "p", snapshot(spark))
    got = store.load(spark, str(tmp_path), "p")
    assert got["symbols"].count() == 1 and [r["id"] for r in got["normalized_sources"].collect()] == [5]
    with pytest.raises(IntegrityError, match="roles"):
        store.save(spark, str(tmp_path), "p", snapshot(spark, role=3))
    with pytest.raises(IntegrityError, match="ranges"):
        store.save(spark, str(tmp_path), "p", snapshot(spark, length=4))
    calls = spark.createDataFrame([(1, 9, 8, "x"), (2, None, 7, "y")], "id long, callee_symbol_id long, callee_definition_id long, unresolved_name string")
    rows = resolved_names(calls, spark.createDataFrame([(9,)], "id long")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 9, None, None), (2, None, None, "y")]


def test_output(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\r\nc", None)], "symbol_id long, the_text string, z string")
    assert output.table_lines(df, df.columns).head()["line"] == "1\ta b c\t"
    assert '"symbolId" : 1' in output.json_rows(df).head()["json"]
    edges = [(1, 0, True), (2, 1, True), (3, 0, True), (3, 1, False)]
    names = {i: f"n{i}" for i in range(4)}
    assert output.tree_text(names, 0, edges) == "n0\n└─ n1\n   └─ n2\n└─ n3\nAdditional edges:\n  n3 -> n1"
    sites = {(2, 1): ["a.cs:1:2\nx()"], (3, 1): ["b|c"]}
    assert output.tree_text(names, 0, edges, True, sites) == "n0\n└─ n1\n   └─ n2\n      a.cs:1:2 x()\n└─ n3\n└─ <truncated>\nAdditional edges:\n  n3 -> n1\n    b|c"
    assert output.mermaid({0: 'a"<[constructor]\r\nint[]&'}, []) == 'flowchart TD\n    n0["a&quot;&lt;&#91;constructor&#93;<br/>int&#91;&#93;&amp;"]'
    assert output.mermaid({0: "a", 3: "b"}, [(3, 0, True)], True, {(3, 0): ["x|y", "[z]"]}).splitlines()[3:] == ['    n3 -->|"x&#124;y<br/>&#91;z&#93;"| n0', "    %% truncated"]
    assert output.path_tree(["a", "b"], True) == "a\n└─ b\n   └─ <truncated>" and output.path_line(["a", "b"], True) == "a -> b -> <truncated>"
    tree = json.loads(output.tree_json("p", {0: {"id": 0}, 1: {"id": 1}}, {0: 0, 1: 1}, 0, [(1, 0, True)], False, {(1, 0): [{"line": 3}]}))
    assert tree["edges"] == [{"caller": 1, "callee": 0, "callSites": [{"line": 3}]}] and tree["nodes"][1] == {"symbol": {"id": 1}, "depth": 1}
    assert json.loads(output.path_json("p", {"id": 0}, None)) == {"profile": "p", "found": False, "truncated": False, "root": {"id": 0}, "nodes": []}
    output.write_atomically(str(tmp_path / "o"), "x")
    assert (tmp_path / "o").read_text() == "x" and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(output.RequireSingle):
        output.single(df.limit(0))
    assert output.exit_code(output.RequireSingle()) == 5


def test_exclude_patterns_trim_leading_slashes(spark):
    rows = spark.createDataFrame([("obj2/a.cs",), ("/obj2/b.cs",), ("x/obj2/c.cs",)], "path string")
    assert [r["path"] for r in rows.where(files.included(F.col("path"), ["/obj2/**"])).collect()] == ["x/obj2/c.cs"]


def test_generated_headers_need_the_whole_tag(spark):
    texts = ["// <auto-generated/>", "// <Auto-Generated>", "// <autogenerated>", "// auto-generated", "x" * 2048 + "<auto-generated>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.generation_kind(F.lit("a.cs"), F.col("t")).alias("k")).orderBy("i")
    assert [r["k"] for r in rows.collect()] == [0, 2, 2, 0, 0]


def test_upsert_keeps_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, v string")
    new = spark.createDataFrame([(2, "y"), (2, "x"), (None, "z"), (3, "n")], "id long, v string")
    assert {(r["id"], r["v"]) for r in store.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "x"), (None, "z"), (3, "n")}


def test_layouts(spark):
    s = spark.createDataFrame([(7, "k7", 2, "N", "T", "M(int)", 6, True, 5, 3, "Task", 9, "a.cs", 4, 1)], "id long, stable_key string, kind int, namespace_name string, type_display_path string, executable_display_path string, accessibility int, is_static boolean, async_role int, async_involvement_depth int, return_type_display string, preferred_declaration_id long, normalized_path string, source_start int, place long")
    docs = spark.createDataFrame([("a.cs", "ab\ncd")], "normalized_path string, source_text string")
    rows = layouts.located(s, docs)
    assert layouts.symbol_lines(rows).head()["line"] == "public static async Task N.T::M(int) [async: DeclaredAsync, ContainsAwait; depth: 3]\ta.cs:2:2"
    assert layouts.symbol_lines(rows.withColumn("async_involvement_depth", F.lit(None).cast("int")).withColumn("async_role", F.lit(0)), list_only=True).head()["line"] == "public static Task N.T::M(int)"
    got = json.loads(layouts.json_lines(rows, layouts.symbol_object(rows)).head()["json"])
    assert (got["kind"], got["fullyQualifiedName"], got["location"], got["accessibility"], got["assemblyName"]) == ("method", "N::T::M(int)", {"path": "a.cs", "line": 2, "column": 2, "offset": 4}, "public", None)
    defined = rows.withColumn("declaration_role", F.lit(3))
    assert layouts.definition_lines(defined).head()["line"] == "  public static async Task N.T::M(int)\timplementation\ta.cs:2:2"
    assert layouts.source_match_lines(defined.withColumn("source", F.lit("x\ty"))).head()["line"].endswith("\timplementation\ta.cs:2:2\tx y")
    calls = spark.createDataFrame([(1, 7, 7, 7, 1, 2, 1, 0, 1, "a.cs", 0, None), (2, 7, None, None, 3, 1, 3, 2, 0, "a.cs", 3, "Gone")], "id long, caller_symbol_id long, callee_symbol_id long, callee_definition_id long, reference_kind int, dispatch_kind int, resolution_status int, resolution_reason int, async_usage_kind int, normalized_path string, source_start int, unresolved_name string")
    named = layouts.with_names(layouts.located(calls, docs), s, {"caller_symbol_id": "caller_name", "callee_definition_id": "target_name"})
    lines = sorted(r["line"] for r in layouts.call_lines(named).collect())
    assert lines == ["  a.cs:1:1  N.T::M(int) -> N.T::M(int) [Invocation, Resolved] [Awaited]", "  a.cs:2:1  N.T::M(int) -> Gone [MethodGroup, Unresolved] [None]"]
    objects = {r["id"]: r for r in (json.loads(x["json"]) for x in layouts.json_lines(named, layouts.call_object(named)).collect())}
    assert objects[2]["unresolvedName"] == "Gone" and objects[1]["unresolvedName"] is None and objects[1]["dispatchKind"] == "Virtual"
    relations = layouts.with_names(spark.createDataFrame([(7, 7, 3)], "source_symbol_id long, target_symbol_id long, relation_kind int"), s, {"source_symbol_id": "source_name", "target_symbol_id": "target_name"})
    assert layouts.relation_lines(relations).head()["line"] == "  N.T::M(int) -> N.T::M(int)"
    assert json.loads(layouts.json_lines(relations, layouts.relation_object(relations)).head()["json"])["kind"] == "Overrides"
    used = spark.createDataFrame([("DEBUG", 2, 5, True)], "symbol_name string, documents long, occurrences long, is_defined boolean")
    assert layouts.condition_lines(used).head()["line"] == "  DEBUG                               2 file(s)  defined"
    assert json.loads(layouts.json_lines(used, layouts.condition_object()).head()["json"]) == {"symbolName": "DEBUG", "fileCount": 2, "occurrenceCount": 5, "isDefined": True}


def test_project_fingerprint(spark):
    docs = spark.createDataFrame([("b.cs", "x"), ("A.cs", "y")], "path string, text string")
    first = T.project_fingerprint(["p", "net8.0"], b"<Project/>", [("q", ["z", "a"], False), ("b", [], True)], docs)
    assert first == T.project_fingerprint(["p", "net8.0"], b"<Project/>", [("b", [], True), ("q", ["a", "z"], False)], docs.orderBy("path"))
    assert first != T.project_fingerprint(["p", "net8.0"], b"<Project/>", [("b", [], True), ("q", ["a", "z"], False)], docs.replace("x", "X", "text"))
    assert first != T.project_fingerprint(["p", "net8.0"], None, [("q", ["z", "a"], False), ("b", [], True)], docs) and len(first) == 32


def test_keys_of_what_has_no_name(spark):
    assert one(spark, T.synthetic_key(F.col("o"), F.lit("a.cs"), F.lit("Lambda"), F.lit(3), F.lit(4), F.unhex(F.lit("0AFF"))), o="k") == "k|document:a.cs|kind:Lambda|span:3:4|version:0AFF"
    assert one(spark, T.local_function_key(F.col("o"), F.lit("F()"), F.lit("a.cs"), F.lit(3), F.lit(4)), o="k") == "k|local:F()|document:a.cs|span:3:4"
    with pytest.raises(Exception, match="local function"):
        one(spark, T.local_function_key(F.col("o"), F.lit("F()"), F.lit("a.cs"), F.lit(-3), F.lit(4)), o="k")


def test_stored_and_absolute_paths(spark):
    for absolute, want in (("/r/a/b.cs", "a/b.cs"), ("/r", "."), ("/r/", "."), ("/rx/a.cs", None), ("/r\\x\\..\\y.cs", "y.cs"), ("/q/a.cs", None)):
        assert one(spark, T.stored_path(F.col("b"), F.col("p")), b="/r/", p=absolute) == want
    assert one(spark, T.absolute_path(F.col("b"), F.col("p")), b="/r/", p="a/b.cs") == "/r/a/b.cs"


def test_payload_faults(spark):
    from skeingraph.operators import scans

    docs = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 10)], "id long, normalized_source_id long")
    sources = spark.createDataFrame([(10, "a"), (11, "b"), (11, "c"), (99, "d"), (99, "e")], "id long, normalized_source string")
    with pytest.raises(scans.PayloadError, match="text 11 is duplicate, text 12 is missing"):
        scans.checked_payloads(docs, sources)
    scans.checked_payloads(docs.where("id in (1, 4)"), sources)


def test_source_show_and_other_commands(spark):
    """A small index: the only root's source, ways to it, and what is refused."""
    from skeingraph.operators.output import RequireSingle
    from skeingraph.plans.conditions import Condition
    from skeingraph.service import Request, Service, UsageError

    symbol = "id long, analysis_profile_id long, kind int, name string, namespace_name string, type_identity_path string, type_display_path string, executable_identity_path string, executable_display_path string, stable_key string, preferred_declaration_id long, containing_symbol_id long, type_kind int, async_role int, async_involvement_depth int, async_next_symbol_id long"
    rows = [(1, 1, 1, "T", "N", "T", "T", "", "", "k1", None, None, 2, 0, None, None)]
    rows += [(i, 1, 2, n, "N", "T", "T", f"{n}()", f"{n}()", f"k{i}", i * 10, 1, None, role, depth, to) for i, n, role, depth, to in ((2, "A", 0, 2, 3), (3, "B", 0, 1, 4), (4, "C", 1, 0, None), (5, "D", 0, None, None))]
    tables = {
        "symbols": spark.createDataFrame([*rows, (9, 2, 2, "A", "N", "T", "T", "A()", "A()", "other", 20, 1, None, 0, None, None)], symbol),
        "symbol_declarations": spark.createDataFrame([(i * 10, i, 100, 1, i, 1, i - 2, 2, False) for i in (2, 3, 4, 5)], "id long, symbol_id long, document_id long, declaration_role int, source_start int, source_length int, normalized_start int, normalized_length int, is_generated boolean"),
        "documents": spark.createDataFrame([(100, "a.cs", "0123456789", False, 7)], "id long, normalized_path string, source_text string, is_generated boolean, normalized_source_id long"),
        "normalized_sources": spark.createDataFrame([(7, "a😀bcdef")], "id long, normalized_source string"),
        "calls": spark.createDataFrame([(1, 1, 2, 3, 3, 1, 1, 1, 0, 1, 100, 1, 3, None), (2, 1, 3, 4, 4, 1, 1, 1, 0, 1, 100, 5, 2, None)], "id long, analysis_profile_id long, caller_symbol_id long, callee_symbol_id long, callee_definition_id long, reference_kind int, dispatch_kind int, resolution_status int, resolution_reason int, async_usage_kind int, document_id long, source_start int, source_length int, unresolved_name string"),
        "call_candidates": spark.createDataFrame([], "call_id long, candidate_symbol_id long"),
        "analysis_profiles": spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string"),
        "index_runs": spark.createDataFrame([(5, 1, 10), (6, 2, 9)], "id long, analysis_profile_id long, indexed_at_utc long"),
    }
    s = Service.open(tables)
    assert s.source_show(Request("T::D")).head()["source"] == "bc"
    assert s.async_tree(Request("T::A")).nodes == [2, 3, 4] and s.async_tree(Request("T::D")) is None
    assert {(r["id"], r["depth"], r["next"]) for r in s.involved().collect()} == {(4, 0, None), (3, 1, 4), (2, 2, 3)}
    tree = s.callers_tree(Request("T::C"))
    assert [(r["id"], r["depth"]) for r in tree.nodes.orderBy("place").collect()] == [(4, 0), (3, 1), (2, 2)] and s.call_sites(tree).count() == 2
    assert {(r["at"], r["symbol_id"]) for r in s.definition_at(spark.createDataFrame([("a.cs:1:3",), ("./a.cs:1:7",), ("a.cs:1:6",), ("b.cs:1:1",)], "at string")).collect()} == {("a.cs:1:3", 3), ("./a.cs:1:7", 4), ("a.cs:1:6", 4)}
    assert s.symbol_list(Request(), involved=True).count() == 3 and s.symbol_find(Request("T::A")).count() == 1
    with pytest.raises(RequireSingle):
        s.source_show(Request("T::*"))
    with pytest.raises(RequireSingle):
        s.definition(Request("T::Nothing"))
    with pytest.raises(UsageError):
        s.source_search(Request("T::A"))
    assert s.source_search(Request(conditions=(Condition("include", "345", "literal"),))).count() == 4
    with pytest.raises(UsageError):
        Service.open(tables, "three")
