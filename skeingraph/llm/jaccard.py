"""Exact Jaccard join of documents' 5-word shingle sets over an index of rare prefixes.

Set-relation skipping, in four steps:

1. Classes. A shingle's document count makes it single (one document), rare or common. Map
   tasks send sorted 32-bit prints of their shingles in byte planes, about two bytes each,
   buckets count them, and two bitmaps of a fixed size come back: "in two documents or more"
   and "common". The order (class, hash) is a function of the shingle alone, so prefixes are
   exact whatever the bitmaps say; these only decide how selective prefixes are.
2. Index. Sets of J >= t share one of their first n - ceil(t n) + 1 shingles in that order.
   Single shingles take up prefix positions but have no list, so most documents have no
   entry at all. Equal sets become one set first, their smallest doc_id (`rep`).
3. Answers. Sets are not compared pairwise within a list but with leaders: all with the
   list's smallest set, then, where a list still holds several classes (components found so far),
   with a set of another class. Parts of a list whose sizes or positions rule a link
   out are skipped: if a shingle at positions i and j is the first common one, the overlap is
   min(n - i, m - j) at most.
4. The rest. In lists that still hold several classes, the sets outside of a list's largest
   class are compared with the blocks of the list whose sizes they can link with, except where the computed answers of both
   exclude a link: Jaccard distance is a metric, so d(a, b) >= |d(a, r) - d(b, r)| for the
   list's leader r. No pair that could join two classes is left out, and a group of copies costs its size, not its square.

Compared pairs are verified on whole sets of 64-bit hashes.

Defined results: null or wordless text has the empty set and is linked with nothing; fewer
words than five make one shingle of them all; a null doc_id takes no part; of a doc_id
that repeats the set with the smallest key is taken; an empty table gives no rows; extra columns are ignored, and kept by `drop_near_copies`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeingraph.llm.common import fresh, map_texts, mix, planes, release, table, unplanes, word_hashes, written

SHINGLE, PERCENT = 5, 75
#: The maps have 2**BITS bits and 2**CLASS_BITS classes, whatever the input; least number of counting buckets (a power of two).
BITS, CLASS_BITS, BUCKETS = 27, 25, 128
#: Shingles that a map task holds before it sends them.
HELD = 2_000_000
#: Edges that one task may join, at most.
ONE_TASK = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE):
    """Sorted distinct hashes of all runs of `size` words of each text; a text of fewer words is one run. hashes: words of all texts, counts: words of each."""
    n = len(hashes)
    if n >= size:
        h = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            h = (h + hashes[i : n - size + 1 + i]) * _ODD[i % 5]
            h ^= h >> np.uint64(31)
        h = mix(h)
    at = 0
    for k in counts.tolist():
        if k >= size:
            yield np.unique(h[at : at + k - size + 1])
        elif k:
            one = np.full(1, k, np.uint64)
            for i in range(k):
                one = (one + hashes[at + i : at + i + 1]) * _ODD[i % 5]
                one ^= one >> np.uint64(31)
            yield mix(one)
        else:
            yield hashes[:0]
        at += k


def least_overlap(n, m, percent: int = PERCENT):
    """Smallest intersection of sets of n and m with 100 * intersection >= percent * union; works on Columns and numbers."""
    return (percent * (n + m) + 99 + percent) / (100 + percent)


def _counted(docs: DataFrame, size: int) -> dict[str, bytearray]:
    """The two maps of the shingles' classes."""
    buckets = max(BUCKETS, 1 << (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shift = 33 - buckets.bit_length()

    def send(held):
        v = np.sort(np.concatenate(held))
        cut = np.searchsorted(v, (np.arange(1, buckets, dtype=np.uint64) << np.uint64(shift)).astype(np.uint32))
        rows = [(b, planes(x)) for b, x in enumerate(np.split(v, cut)) if len(x)]
        return pd.DataFrame(rows, columns=["bucket", "block"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for s in shingles(*word_hashes(batch.column(0)), size):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                n += len(s)
                if n >= HELD:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def count(key, pdf):
        v = np.sort(np.concatenate([unplanes(b, np.uint32) for b in pdf["block"]]))
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        times = np.diff(np.append(start, len(v)))
        v, times = v[start][times > 1], times[times > 1]
        at = lambda bits: (v >> np.uint32(32 - bits)).astype(np.int64) - int(key[0]) * (1 << bits) // buckets
        shared = np.zeros((1 << BITS) // buckets, bool)
        shared[at(BITS)] = True
        kind = np.zeros((1 << CLASS_BITS) // buckets, np.uint8)
        np.maximum.at(kind, at(CLASS_BITS), np.minimum(15, np.log2(times)).astype(np.uint8))
        return pd.DataFrame([(int(key[0]), np.packbits(shared).tobytes(), (kind[::2] << 4 | kind[1::2]).tobytes())], columns=["bucket", "shared", "kind"])

    rows = map_texts(docs.select("text"), run, "bucket int, block binary").groupBy("bucket").applyInPandas(count, "bucket int, shared binary, kind binary").toLocalIterator()
    maps = {"shared": bytearray((1 << BITS) // 8), "kind": bytearray((1 << CLASS_BITS) // 2)}
    for r in rows:
        for name, m in maps.items():
            size = len(m) // buckets
            m[r["bucket"] * size : (r["bucket"] + 1) * size] = r[name]
    return maps


def profiles(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Written: doc_id, n, words (how many), key (two numbers that stand for the set), tokens and positions of the indexed prefix, and the whole set where there is such a prefix."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    maps = docs.sparkSession.sparkContext.broadcast(_counted(docs, size))

    def run(batches):
        shared, kinds = (np.frombuffer(maps.value[x], np.uint8) for x in ("shared", "kind"))

        for batch in batches:
            rows = []
            hashes, counts = word_hashes(batch.column(1))
            for d, words, s in zip(batch.column(0).to_pylist(), counts.tolist(), shingles(hashes, counts, size), strict=True):
                n = len(s)
                k1, k2 = (int(x) for x in (s.sum(dtype=np.uint64).view(np.int64), mix(s ^ _ODD[0]).sum(dtype=np.uint64).view(np.int64)))
                at = (s >> np.uint64(64 - BITS)).astype(np.int64)
                kind = (shared[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
                tokens, pos = s[:0], at[:0]
                if kind.any():
                    first = n + (-percent * n // 100) + 1  # n - ceil(t n) + 1
                    single = n - int(kind.sum())
                    if single < first:
                        at >>= BITS - CLASS_BITS
                        kind = kind * (1 + (kinds[at >> 1] >> (4 - 4 * (at & 1)).astype(np.uint8) & 15))
                        order = np.argsort(kind, kind="stable")[single:first]
                        tokens, pos = s[order], np.arange(single, single + len(order))
                rows.append((d, n, words, k1, k2, tokens.view(np.int64), pos.astype(np.int32), s.tobytes() if len(tokens) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "words", "k1", "k2", "tokens", "positions", "whole"])

    rows = written(map_texts(docs, run, "doc_id long, n int, words long, k1 long, k2 long, tokens array<long>, positions array<int>, whole binary"), "jaccard-profiles")
    maps.destroy()
    release(docs.sparkSession)
    return rows


def _ends(key, pdf):
    """component and up of at most ONE_TASK edges: each id with the smallest one that it reaches."""
    root: dict[int, int] = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        root.setdefault(x, x)
        root.setdefault(y, y)
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return pd.DataFrame({"component": list(root), "up": [find(x) for x in root]})


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """id and component (smallest id reachable) of the ids in edges (a, b).

    In each round every vertex points to its smallest neighbour if that is smaller, chains of pointers are
    halved to their ends, and edges move to these ends; what became a loop or a repetition goes, so edges
    shrink. Once at most `one_task` are left, which is counted, one task ends them."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    named, left = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id")), edges.count()
    while left > one_task:
        up = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        up = written(up.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("up")).distinct().join(up.select("id"), "id", "left_anti")), "ups")
        while True:
            far = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
            jumped = written(up.join(far, "up").select("id", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "ups")
            up = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        named = written(named.join(up.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")
        moved = edges.join(up.select(F.col("id").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("id").alias("b"), F.col("up").alias("y")), "b")
        edges = written(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        left = edges.count()
    ends = edges.groupBy(F.lit(0).alias("all")).applyInPandas(_ends, "component long, up long")
    return written(named.join(ends, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (size of the intersection), n_a, n_b of the pairs (a, b), from the whole sets (rep, n, whole)."""
    x = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("whole").alias("set_a"))
    y = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("whole").alias("set_b"))

    def run(batches):
        for pdf in batches:
            out = []
            for p, q in zip(pdf["set_a"], pdf["set_b"], strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                out.append(int((q[at] == p).sum()))
            pdf["both"] = np.array(out, np.int32)
            yield pdf[["a", "b", "both", "n_a", "n_b"]]

    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInPandas(run, "a long, b long, both int, n_a int, n_b int")


def _fits(x: str, y: str, percent: int):
    """Sizes, and the positions of a common shingle, allow a link of the sets whose columns end in x and y.

    Taken at their first common shingle, two sets share at most what is left of the shorter one; a
    pair that links passes there, so it need not pass at the later ones."""
    n, i, m, j = (F.col(c + e) for e in (x, y) for c in ("n", "pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= F.floor(least_overlap(n, m, percent)))


def _block(n, percent: int):
    """Number of a set's block by its size; sizes of one block and the next differ by a little more than sets that link can."""
    return F.floor(F.log(n.cast("double")) / np.log(100.5 / percent)).cast("int")


def near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_words of every document; docs: doc_id, text."""
    rows = profiles(docs, size, percent)
    small = rows.select("doc_id", "n", "k1", "k2")
    if small.groupBy("doc_id").count().where("count > 1").isEmpty():
        once = rows
    else:
        once = written(rows.join(small.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("m")).select("doc_id", "m.k1", "m.k2"), ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id"]), "jaccard-once")
    small = once.select("doc_id", "n", "words", "k1", "k2")
    reps = small.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = written(small.join(reps, ["k1", "k2"], "left").select("doc_id", "n", "words", F.coalesce("rep", "doc_id").alias("rep")), "jaccard-members")

    index = once.where(F.size("tokens") > 0).join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    lists = index.select("rep", "n", F.explode(F.arrays_zip("tokens", "positions")).alias("x")).select(F.col("x.tokens").alias("token"), "rep", "n", F.col("x.positions").alias("pos"))
    leaders = lists.groupBy("token").agg(F.min(F.struct("rep", "n", "pos")).alias("l"), F.count("*").alias("size")).where("size > 1").drop("size")
    lists = written(lists.join(leaders, "token").select("token", "rep", "n", "pos", F.col("l.rep").alias("leader"), *[F.col(f"l.{c}").alias(f"{c}_l") for c in ("n", "pos")]), "jaccard-lists")
    sets = index.select("rep", "n", "whole")

    fit = _fits("", "_l", percent)
    answers = written(verified(lists.where((F.col("rep") != F.col("leader")) & fit).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), sets), "jaccard-answers")
    is_link = 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
    classes = components(answers.where(is_link))

    def mixed() -> DataFrame:
        """Entries of the lists that hold several classes, with their class."""
        named = lists.join(classes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("component", "rep")).drop("component")
        several = named.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("token")
        return named.join(several, "token", "left_semi")

    release(docs.sparkSession)
    # A set of the list's largest class label leads the second comparison.
    rest = mixed()
    second = rest.groupBy("token").agg(F.max(F.struct("class", "rep", "n", "pos")).alias("l")).select("token", F.col("l.rep").alias("b"), *[F.col(f"l.{c}").alias(f"{c}_2") for c in ("class", "n", "pos")])
    pairs = rest.join(second, "token").where((F.col("class") != F.col("class_2")) & _fits("", "_2", percent))
    pairs = pairs.select(F.col("rep").alias("a"), "b").distinct().join(answers.select("a", "b"), ["a", "b"], "left_anti")
    more = written(verified(pairs, sets), "jaccard-answers")
    answers = answers.unionByName(more)
    classes = components(answers.where(is_link))

    rest = written(mixed(), "jaccard-mixed")
    apart = answers.select(F.col("a").alias("rep"), F.col("b").alias("leader"), (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("d"))
    rest = rest.join(apart, ["rep", "leader"], "left").withColumn("d", F.when(F.col("rep") == F.col("leader"), F.lit(0.0)).otherwise(F.col("d")))
    largest = rest.groupBy("token", "class").count().groupBy("token").agg(F.max(F.struct("count", "class")).alias("m")).select("token", F.col("m.class").alias("largest"))
    minority = rest.join(largest, "token").where("class != largest").select("token", F.col("rep").alias("a"), *[F.col(c).alias(f"{c}_x") for c in ("n", "pos", "class", "d")])
    near = F.coalesce(F.abs(F.col("d") - F.col("d_x")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    # Blocks of a list by size: a set can link with those of its own block and of the two beside it, the others are skipped before the join.
    asked = minority.withColumn("block", F.explode(F.sequence(_block(F.col("n_x"), percent) - 1, _block(F.col("n_x"), percent) + 1)))
    pairs = asked.join(rest.withColumn("block", _block(F.col("n"), percent)), ["token", "block"]).where((F.col("class") != F.col("class_x")) & near & _fits("", "_x", percent))
    pairs = pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    last = written(verified(pairs.join(done, ["a", "b"], "left_anti"), sets), "jaccard-answers")
    if not last.where(is_link).isEmpty():
        classes = components(answers.unionByName(last).where(is_link))
    release(docs.sparkSession)
    return members.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.col("words").alias("n_words"))


def row_components(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """The rows of docs with an id, with a struct<rank, row> that tells them apart also where ids repeat, and that struct's name; and the _component and _words of each _row.

    A row's number is its doc_id, or a hash for the second and later rows (by text) of one doc_id."""
    rows, name = docs.where("doc_id is not null"), fresh(docs, "_near")
    rank = F.lit(0)
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))) - 1
    number = fresh(docs, "_number")
    rows = rows.withColumn(number, rank)
    row = F.when(F.col(number) == 0, F.col("doc_id")).otherwise(F.xxhash64("doc_id", number))
    rows = rows.withColumn(name, F.struct(F.col(number).alias("rank"), row.alias("row"))).drop(number)
    if repeated:
        rows = written(rows, "jaccard-rows")
    found = near_copies(rows.select(F.col(f"{name}.row").alias("doc_id"), "text"))
    return rows, name, found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"), F.col("n_words").alias("_words"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, with its columns: the smallest id, of a repeated id the first row by text; rows without an id stay.

    Rows are compared each for itself, also where they share an id."""
    rows, name, found = row_components(docs)
    marks = rows.select(F.col(f"{name}.row").alias("_row"), "doc_id", F.col(f"{name}.rank").alias("_rank"))
    firsts = marks.join(found, "_row").groupBy("_component").agg(F.min(F.struct("doc_id", "_rank", "_row")).alias("m")).select(F.col("m._row").alias("_first"))
    kept = rows.join(firsts, F.col(f"{name}.row") == F.col("_first"), "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL
"""
