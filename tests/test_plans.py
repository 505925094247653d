import random
import re
import time

import pytest
from pyspark.sql import functions as F

from skeingraph.plans import conditions as C
from skeingraph.plans import globs, selector


def like(pattern, text):
    """A direct matcher of `*`, by dynamic programming."""
    row = [True] + [False] * len(text)
    for p in re.sub(r"\*+", "*", pattern):
        row = [row[0] and p == "*"] + [False] * len(text) if False else _step(row, p, text)
    return row[-1]


def _step(row, p, text):
    if p == "*":
        out, on = [], False
        for x in row:
            on |= x
            out.append(on)
        return out
    return [False] + [row[i] and text[i] == p for i in range(len(text))]


def test_component_globs_equal_a_direct_matcher(spark):
    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("ab*.") for _ in range(rnd.randrange(6))), "".join(rnd.choice("ab.") for _ in range(rnd.randrange(7)))) for _ in range(400)]
    rows = spark.createDataFrame([(globs.component(p), t) for p, t in pairs], "p string, t string").select(F.expr("t rlike p").alias("m")).collect()
    assert [r["m"] for r in rows] == [like(p, t) for p, t in pairs]


def test_source_glob_is_quick_on_runs(spark):
    start = time.time()
    assert not spark.createDataFrame([("a" * 4096,)], "t string").where(F.col("t").rlike(globs.source("a*a*a*a*b"))).count()
    assert time.time() - start < 20


@pytest.mark.parametrize(("pattern", "path", "want"), [
    ("src/*.cs", "src/a.cs", True), ("src/*.cs", "src/x/a.cs", False), ("src/**/*.cs", "src/a.cs", True), ("src/**/*.cs", "src/x/y/a.cs", True),
    (r"src\**", "src/x/y", True), ("**", "a/b", True), ("a.cs", "aXcs", False),
])
def test_file_globs(pattern, path, want):
    assert bool(re.search(globs.file(pattern).replace(r"\z", r"\Z"), path)) == want


def matches(spark, text, ns, type_path, executable):
    rows = spark.createDataFrame([(ns, type_path, executable)], "namespace_name string, type_identity_path string, executable_identity_path string")
    return selector.encoded(rows).where(selector.compile(selector.parse(text))).count() == 1


@pytest.mark.parametrize(("text", "row", "want"), [
    ("N.A::T::M", ("N.A", "T", "M"), True), ("A::T::M", ("N.A", "T", "M"), False), ("A.T::M", ("N.A", "T", "M"), True), ("T::M", ("N.A", "T", "M"), True),
    ("global::T::M", ("", "T", "M()"), True), ("N.*::T::M", ("N.A", "T", "M"), True), ("N.**::T::M", ("N", "T", "M"), True), ("T::M()", ("N", "T", "M(System.Int32)"), False),
    ("T::M(int)", ("N", "T", "M(System.Int32)"), True), ("T::M(ref int)", ("N", "T", "M(System.Int32)"), False), ("T::M", ("N", "T<U>", "M"), False), ("T<X>::M", ("N", "T<U>", "M"), True),
    ("T::M.**", ("N", "T", "M.<lambda#1>"), True), ("T::M.<lambda#1>", ("N", "T", "M.<lambda#1>"), True), ("T::[constructor]()", ("N", "T", "[constructor]()"), True), ("T::[get:P]", ("N", "T", "[set:P]"), False),
    ("T::M(string?)", ("N", "T", "M(System.String)"), True), ("T::M(int?)", ("N", "T", "M(System.Int32)"), False),
])
def test_selectors(spark, text, row, want):
    assert matches(spark, text, *row) == want


@pytest.mark.parametrize("text", ["", "A::", "A::B::C::D", "T::M(", "T::[nothing]", "T::[operator:@]", "T::M)x"])
def test_selector_errors(text):
    with pytest.raises(selector.SelectorError):
        selector.parse(text)


def test_conditions_meet_on_one_declaration(spark):
    symbols = spark.createDataFrame([(1, "N", "T", "M"), (2, "N", "T", "K")], "id long, namespace_name string, type_display_path string, executable_display_path string")
    rows = spark.createDataFrame([(1, "a.cs", "x"), (1, "b.cs", "needle"), (2, "a.cs", "needle")], "symbol_id long, normalized_path string, source_text string")
    cs = C.compile(spark, [C.Condition("file", "a.cs", "literal"), C.Condition("include", "need*le")])
    found, decls = C.select(symbols, rows, cs)
    assert [r["id"] for r in found.collect()] == [2] and decls.count() == 1
    for bad in (C.Condition("include", "(", "regex"), C.Condition("nothing", "x"), C.Condition("file", "")):
        with pytest.raises(C.ConditionError):
            C.compile(spark, [bad])


@pytest.mark.parametrize(("text", "path", "want"), [
    ("T::**.L.**", "M.L()", True), ("T::**.L.**", "A.B.L().<lambda#2>", True), ("T::**.L.**.X", "A.L.X.Y", False), ("T::A.**.L.**.X", "A.L.B.X", True), ("T::**.**", "M", True), ("T::*.**.*", "M", False), ("T::*.**.*", "M.<lambda#1>", True),
    ("T::<lambda#*>", "<lambda#7>", True), ("T::M((int a, string))", "M(System.ValueTuple<System.Int32,System.String>)", True), ("T::M((int, string)[])", "M(System.ValueTuple<System.Int32,System.String>[])", True), ("T::M((int, int))", "M(System.ValueTuple<System.Int32,System.String>)", False),
    ("T::[conversion:implicit:int](string)", "[conversion:implicit:System.Int32](System.String)", True), ("T::[conversion:implicit:long]", "[conversion:implicit:System.Int32](System.String)", False), ("T::[checked-conversion:explicit:int]", "[checked-conversion:explicit:System.Int32]()", True),
    ("T::[explicit:I.M]", "[explicit:I.M]()", True), ("T::[explicit:*.M]", "[explicit:A.I.M]()", True), ("T::[operator:+](int,int)", "[operator:+](System.Int32,System.Int32)", True), ("T::[destructor]", "[destructor]()", True), ("T::<initializer:*>", "<initializer:Field>", True),
    ("T::[static-constructor]", "[constructor]()", False), ("T::<top-level-statements>", "<top-level-statements>", True), ("T::[add:E]", "[add:E](System.Object)", True), ("T::M<A>()", "M<T>()", True), ("T::M()", "M<T>()", False), ("T::M<A,B>", "M<T>()", False),
])
def test_members(spark, text, path, want):
    assert matches(spark, text, "N", "T", path) == want


def chosen(spark, condition, type_path="Host", executable="Run()", namespace="Game"):
    rows = spark.createDataFrame([(1, namespace, type_path, type_path, executable, executable)], "id long, namespace_name string, type_identity_path string, type_display_path string, executable_identity_path string, executable_display_path string")
    none = spark.createDataFrame([], "symbol_id long, normalized_path string, source_text string")
    return C.select(rows, none, C.compile(spark, [condition]))[0].count() == 1


@pytest.mark.parametrize(("pattern", "path", "want"), [
    ("Run", "Run<T>(System.Int32)", True), ("Run<T>", "Run<T>(System.Int32)", True), ("Run()", "Run()", True), ("Run<T>()", "Run<T>()", True), ("Run(int)", "Run(System.Int32)", True),
    ("Run()", "Run(System.String)", False), ("Run()", "Run<T>()", False), ("Run(int)", "Run<T>(System.Int32)", False), ("Run", "Run.Local()", False), ("R*", "Run()", False), ("R", "Run()", False),
])
def test_method_literals(spark, pattern, path, want):
    assert chosen(spark, C.Condition("method", pattern, "literal"), executable=path) == want


@pytest.mark.parametrize(("pattern", "path", "want"), [
    ("M*", "M.L()", False), ("*", "M.L()", False), ("*.L", "M.L()", True), ("**", "M.L()", True), ("M(int)", "M(System.Int32)", True), ("r*", "Run()", False), ("*n(string, int)", "Run(System.String,System.Int32)", True),
])
def test_method_globs(spark, pattern, path, want):
    assert chosen(spark, C.Condition("method", pattern), executable=path) == want
    assert chosen(spark, C.Condition("method", pattern.upper() if "(" not in pattern else pattern, ignore_case=True), executable=path) >= want


@pytest.mark.parametrize(("pattern", "syntax", "path", "want"), [
    ("Repository", "literal", "Repository", True), ("Repository", "literal", "Repository<T>", False), ("Repository", "glob", "Repository<T>", False), ("Repository<T>", "literal", "Repository<X>", True),
    ("Repository<T>", "literal", "Repository<T,U>", False), ("Repository<T>", "glob", "Repository<X>", True), ("Repository*", "glob", "Repository", True), ("Repository*", "glob", "Repository<T>", True),
    ("List<*>", "glob", "List<System.String>", True), ("*", "glob", "List<System.String>", True), ("*", "glob", "A.B", False), ("**", "glob", "A.B<System.Int32>", True), ("Rep*", "literal", "Repository", False), ("a.b", "glob", "A.B", False),
])
def test_type_conditions(spark, pattern, syntax, path, want):
    assert chosen(spark, C.Condition("type", pattern, syntax), type_path=path) == want


def test_a_selector_reaches_the_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "M", "N", "T", "M()"), (2, "K", "N", "T", "K()")], "id long, name string, namespace_name string, type_identity_path string, executable_identity_path string")
    rows.write.parquet(f"{tmp_path}/s")
    found = selector.matching(spark.read.parquet(f"{tmp_path}/s"), selector.parse("T::M"))
    assert [r["id"] for r in found.collect()] == [1] and "EqualTo(name,M)" in found._jdf.queryExecution().executedPlan().toString()


def test_requests_that_say_too_little(spark):
    from skeingraph.schema import SymbolKind
    from skeingraph.service import Request, UsageError

    Request(kind=SymbolKind.METHOD).check("x")
    Request("T::M", include_overrides=True).check("x")
    for bad in (Request(), Request("T::*", include_overrides=True), Request(kind=SymbolKind.METHOD, include_overrides=True), Request("T::M", kind=SymbolKind.LAMBDA, include_overrides=True)):
        with pytest.raises(UsageError):
            bad.check("x")
