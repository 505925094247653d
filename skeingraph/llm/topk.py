"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards of about `shard_rows` by median splits of the dimension with the largest spread, which are
learnt from a bounded sample (SAMPLE; they decide on the dealing, not on results); what falls into one place too often, such as
equal vectors, is dealt further by a hash of vec_id. Every shard has a tight bounding box, and so have the nodes of its own KD-tree, down to small leaves.
For a query q the largest inner product within a box is the sum of max(q*low, q*high): what lies in a box whose bound
is less than the query's kth score is skipped.

Two rounds: each query is searched in the shard of its largest bound first, which gives it a kth score; that
score is propagated, and only the shards whose box reaches it are asked for more, so neither rows nor queries move to shards that can't
help. Within a shard leaves are visited best bound first. Queries of a shard come in blocks, whose number follows how many queries ask it.

Defined results: vectors that are null, or hold null, NaN or infinite components, and rows
with a null vec_id take no part, as query or as candidate; vectors of other lengths than the
query's are no candidates of it; ties go to the smaller vec_id; of a vec_id that repeats,
the smallest vector is taken; fewer candidates than k give fewer ranks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeingraph.llm.common import table, written

LEAF = 64
SHARD_ROWS = 8192
BLOCK = 8192
#: Vectors that splits are learnt from, and shards, at most.
SAMPLE, SHARDS = 20_000, 20_000
HIT = "query_id long, vec_id long, score long"


class KdTree:
    """Nodes of one shard: boxes low and high, children left and right (-1: a leaf), rows from start to end of the ordered ids and vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        low, high, left, right, start, end = [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            v = x[order[a:b]]
            at = len(low)
            low.append(v.min(0))
            high.append(v.max(0))
            left.append(-1)
            right.append(-1)
            start.append(a)
            end.append(b)
            spread = high[at] - low[at]
            if b - a > leaf and spread.max() > 0:
                mid = (b - a) // 2
                d = int(spread.argmax())
                order[a:b] = order[a:b][np.argpartition(v[:, d], mid, kind="introselect")]
                left[at] = node(a, a + mid)
                right[at] = node(a + mid, b)
            return at

        if len(ids):
            node(0, len(ids))
        self.ids, self.x = ids[order], x[order]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.right, self.start, self.end = (np.array(v, np.int64) for v in (left, right, start, end))

    def bounds(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Largest inner product of each row of q with a point of each node's box."""
        return np.maximum(q, 0) @ self.high[nodes].T + np.minimum(q, 0) @ self.low[nodes].T

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores (len(q), k), best first, -1 where there is none below kth, the scores that the queries have elsewhere."""
        m = len(q)
        best_s, best_i = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        if not len(self.ids):
            return best_i, best_s
        kth = kth.copy()
        # Downwards, by level: of the nodes whose bound reaches a query's kth score, leaves are kept, others opened.
        level, leaves, bounds = np.array([0]), [], []
        live = np.ones((m, 1), bool)
        while len(level):
            b = self.bounds(q, level)
            live &= b >= kth[:, None]
            is_leaf = self.left[level] < 0
            leaves.append(level[is_leaf])
            bounds.append(np.where(live[:, is_leaf], b[:, is_leaf], -np.inf))
            go = ~is_leaf & live.any(0)
            live = np.repeat(live[:, go], 2, axis=1)
            level = np.stack([self.left[level[go]], self.right[level[go]]], 1).ravel()
        leaf, bound = np.concatenate(leaves), np.concatenate(bounds, axis=1)
        order = np.argsort(-bound, axis=1, kind="stable")
        # Best first: in each round a query visits its next leaf, until that leaf's bound is below its kth score.
        for r in range(len(leaf)):
            at = order[:, r]
            now = np.flatnonzero(bound[np.arange(m), at] >= np.maximum(kth, -1e300))
            if not len(now):
                break
            visits = at[now]
            by = np.argsort(visits, kind="stable")
            for group in np.split(now[by], np.flatnonzero(np.diff(visits[by])) + 1):
                f = leaf[at[group[0]]]
                a, b = self.start[f], self.end[f]
                s = q[group] @ self.x[a:b].T
                i = np.broadcast_to(self.ids[a:b], s.shape)
                s = np.where(i == q_ids[group][:, None], -np.inf, s)
                s, i = np.concatenate([best_s[group], s], 1), np.concatenate([best_i[group], i], 1)
                top = np.lexsort((i, -s), axis=1)[:, :k]
                best_s[group], best_i[group] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                kth[group] = np.maximum(kth[group], best_s[group][:, -1])
        return best_i, best_s


def _arrays(ids, vectors):
    return ids.to_numpy(np.int64), np.array(vectors.tolist(), np.float64).reshape(len(ids), -1)


def _searched(k: int):
    def run(queries, rows):
        import pandas as pd

        out = []
        by_dim = {d: g for d, g in rows.groupby(rows["x"].map(len))} if len(rows) else {}
        for d, g in queries.groupby(queries["q"].map(len)) if len(queries) else []:
            if d not in by_dim:
                continue
            tree = KdTree(*_arrays(by_dim[d]["vec_id"], by_dim[d]["x"]))
            ids, q = _arrays(g["query_id"], g["q"])
            i, s = tree.search(ids, q, k, g["kth"].to_numpy(float))
            hit = np.isfinite(s)
            out.append(pd.DataFrame({"query_id": np.repeat(ids, k).reshape(-1, k)[hit], "vec_id": i[hit], "score": s[hit].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x = floor(scale * component) of the rows that take part."""
    x = F.col("embedding")
    ok = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    rows = rows.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("x"))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


class Splits:
    """Median splits of vectors of one length into `leaves` places, numbered from `first`."""

    def __init__(self, x: np.ndarray, leaves: int, first: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # dimension, threshold, children; a leaf: -1, its number
        self.count = 0

        def node(part: np.ndarray, k: int) -> int:
            at = len(self.nodes)
            self.nodes.append((-1, 0.0, first + self.count, -1))
            spread = part.max(0) - part.min(0) if len(part) else np.zeros(0)
            if k > 1 and len(part) > 1 and len(spread) and spread.max() > 0:
                d, low = int(spread.argmax()), k // 2
                t = float(np.quantile(part[:, d], low / k, method="higher"))
                t = t if t > part[:, d].min() else float(part[:, d][part[:, d] > t].min())
                left = node(part[part[:, d] < t], low)
                self.nodes[at] = (d, t, left, node(part[part[:, d] >= t], k - low))
            else:
                self.count += 1
            return at

        node(x, leaves)

    def places(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            d, t, a, b = self.nodes[at]
            if d < 0:
                out[rows] = a
            else:
                low = x[rows, d] < t
                stack += [(a, rows[low]), (b, rows[~low])]
        return out


def _matrices(vectors):
    """(length, row numbers, matrix) of each length among a series of vectors."""
    sizes = vectors.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, np.array(vectors.iloc[at].tolist(), np.float64).reshape(len(at), -1)


def _dealt(rows: DataFrame, shard_rows: int) -> DataFrame:
    """vec_id, x, shard: written."""
    spark = rows.sparkSession
    counts = {r["d"]: r["n"] for r in rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shard_rows = max(shard_rows, -(-total // SHARDS))
    few = (rows if total <= SAMPLE else rows.where(F.rand(3) < SAMPLE / total)).select("x").toPandas()
    splits, first = {}, 0
    for d, _, x in _matrices(few["x"]) if len(few) else []:
        splits[d] = Splits(x, -(-counts[d] // shard_rows), first)
        first += splits[d].count
    # Lengths that the sample lacks have a place each.
    for d in sorted(set(counts) - set(splits)):
        splits[d] = Splits(np.zeros((0, d)), 1, first)
        first += 1
    held = spark.sparkContext.broadcast(splits)

    def run(batches):
        for pdf in batches:
            place = np.zeros(len(pdf), np.int64)
            for d, at, x in _matrices(pdf["x"]):
                place[at] = held.value[d].places(x)
            yield pdf.assign(place=place)

    placed = written(rows.select("vec_id", "x").mapInPandas(run, "vec_id long, x array<long>, place long"), "topk-placed")
    parts, at = {}, 0
    for r in placed.groupBy("place").count().orderBy("place").collect():
        parts[r["place"]] = (at, -(-r["count"] // shard_rows))
        at += parts[r["place"]][1]
    table = F.broadcast(spark.createDataFrame([(p, a, n) for p, (a, n) in parts.items()], "place long, at long, n long"))
    return placed.join(table, "place").select("vec_id", "x", (F.col("at") + F.pmod(F.xxhash64("vec_id"), F.col("n"))).alias("shard"))


def _boxes(dealt: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: shards, and the low and high ends of their boxes."""

    def partial(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for s, g in pdf.groupby("shard"):
                x = np.array(g["x"].tolist(), np.int64).reshape(len(g), -1)
                out.append((s, x.min(0), x.max(0)))
            yield pd.DataFrame(out, columns=["shard", "low", "high"])

    def merged(key, pdf):
        import pandas as pd

        return pd.DataFrame([(key[0], np.min(pdf["low"].tolist(), 0), np.max(pdf["high"].tolist(), 0))], columns=["shard", "low", "high"])

    kind = "shard long, low array<long>, high array<long>"
    found = dealt.select("shard", "x").mapInPandas(partial, kind).groupBy("shard").applyInPandas(merged, kind).toPandas().sort_values("shard")
    shards = found["shard"].to_numpy()
    return {d: (shards[at], low, np.array(found["high"].iloc[at].tolist(), np.float64).reshape(len(at), -1)) for d, at, low in _matrices(found["low"])} if len(found) else {}


def _asked(queries: DataFrame, boxes, home: bool) -> DataFrame:
    """queries with `shard`: home: the one of the largest bound; otherwise every other one whose bound reaches `kth`."""
    held = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for d, at, q in _matrices(pdf["q"]):
                if d not in held.value:
                    continue
                shards, low, high = held.value[d]
                # Some thousands of queries at a time, so the bounds take a fixed room.
                for part in np.array_split(np.arange(len(at)), -(-len(at) * len(shards) // 4_000_000)):
                    x, rows = q[part], pdf.iloc[at[part]]
                    bound = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
                    if home:
                        yield rows.assign(shard=shards[bound.argmax(1)])
                    else:
                        i, j = np.nonzero((bound >= rows["kth"].to_numpy()[:, None]) & (shards[None] != rows["home"].to_numpy()[:, None]))
                        yield pd.DataFrame({c: rows[c].to_numpy()[i] for c in rows} | {"shard": shards[j]})

    kind = "query_id long, q array<long>" + ("" if home else ", home long, kth double")
    return queries.mapInPandas(run, kind + ", shard long")


def _pairs(asked: DataFrame, dealt: DataFrame, k: int, block: int) -> DataFrame:
    """Hits of the queries (query_id, q, kth, shard) in their shards; a task holds one shard and one block of its queries, both of bounded size."""
    asked = written(asked, "topk-asked")
    blocks = F.broadcast(asked.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("query_id", "q", "kth", F.col("shard").alias("q_shard"), F.col("block").alias("q_block"))
    rows = dealt.join(blocks, "shard").select("vec_id", "x", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return asked.groupBy("q_shard", "q_block").cogroup(rows.groupBy("shard", "block")).applyInPandas(_searched(k), HIT)


def top_k(rows: DataFrame, is_query, k: int, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. rows: vec_id, x (integers); is_query: a condition on vec_id."""
    dealt = written(_dealt(written(rows, "topk-rows"), shard_rows), "topk-dealt")
    boxes = _boxes(dealt)
    none = F.lit(float("-inf"))
    queries = dealt.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    queries = written(_asked(queries, boxes, home=True).withColumnRenamed("shard", "home"), "topk-queries")
    # First round: each query in one shard.
    first = written(_pairs(queries.select("query_id", "q", none.alias("kth"), F.col("home").alias("shard")), dealt, k, block), "topk-first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(none).alias("kth"))
    # Second round: in the shards that may hold better ones, with the score to reach.
    left = queries.join(kth, "query_id", "left").select("query_id", "q", "home", F.coalesce("kth", none).alias("kth"))
    second = _pairs(_asked(left, boxes, home=False).select("query_id", "q", "kth", "shard"), dealt, k, block)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * r.x[i]))::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id != r.vec_id AND len(q.x) = len(r.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
