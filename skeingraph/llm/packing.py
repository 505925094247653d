"""Best-fit packing with conflicts.

Documents are cut into pieces of at most `capacity` words and packed into bins of that
capacity, largest first. Open bins stand in the order of their residual room, and
each carries bitmaps of its duplicate clusters and of its source slots. The successor
search starts at the smallest residual that holds the piece and goes on until a bin
without conflict is found: the tightest compatible bin. No two pieces of different documents of one
duplicate cluster share a bin, and a source takes at most its quota of a bin's pieces:
its share of its shard's pieces, times the pieces that a bin holds on average, rounded up.

Pieces are dealt by a hash of doc_id to shards of about `shard_rows` documents, which grow in
number with the input; a shard is packed in one task, and a hot source or cluster is
dealt over all shards. Each shard leaves its last bins partly filled.

Defined results: a null doc_id takes no part; a null or empty text is one piece of 0
words; a null source is a source of its own; repeated rows of a doc_id are packed as
one document each (they share a duplicate cluster if their texts are copies); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm import jaccard
from skeingraph.llm.common import WORD, table, written

CAPACITY = 2048
SHARD_ROWS = 2000
OUT = "doc_id long, piece int, start long, length int, bin_id long, offset int"


def pack(items: list[tuple[int, int, int, int]], capacity: int, quota: dict[int, int]) -> list[tuple[int, int]]:
    """(bin, offset) for each (size, group, cluster, source) item. Items of one group (a document's pieces) do not conflict by cluster.

    Bitmaps are ints: one bit for each cluster and each (source, slot) of the call. Items
    are placed by falling size, then in the order given."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], i))
    clusters: dict[int, int] = {}
    for x in items:
        clusters.setdefault(x[2], len(clusters))
    first: dict[int, int] = {}
    n_slots = 0
    for x in items:
        if x[3] not in first:
            first[x[3]] = n_slots
            n_slots += quota.get(x[3], 1)
    slots = {s: ((1 << quota.get(s, 1)) - 1) << at for s, at in first.items()}
    residuals: list[tuple[int, int]] = []  # (room, bin), ascending
    cluster_bits: list[int] = []
    source_bits: list[int] = []
    owner: list[dict[int, int]] = []  # of a bin: the group that set a cluster's bit
    room: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(items)
    for i in order:
        size, group, cluster, source = items[i]
        bit, mask = 1 << clusters[cluster], slots[source]
        found = -1
        for at in range(bisect_left(residuals, (size, -1)), len(residuals)):
            b = residuals[at][1]
            if source_bits[b] & mask != mask and (not cluster_bits[b] & bit or owner[b][cluster] == group):
                found = b
                del residuals[at]
                break
        if found < 0:
            found = len(room)
            room.append(capacity)
            cluster_bits.append(0)
            source_bits.append(0)
            owner.append({})
        free = mask & ~source_bits[found]
        source_bits[found] |= free & -free
        cluster_bits[found] |= bit
        owner[found][cluster] = group
        out[i] = (found, capacity - room[found])
        room[found] -= size
        insort(residuals, (room[found], found))
    return out


def pack_documents(docs: DataFrame, cluster: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, start and length in words of each piece, bin_id, offset in words. docs: doc_id, text, source and perhaps `cluster` (exact copies otherwise)."""
    docs = docs.where("doc_id is not null")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col(cluster)) if cluster else F.xxhash64(F.coalesce("text", F.lit("")))
    return pack_rows(docs.select("doc_id", words.alias("words"), key.alias("cluster"), F.xxhash64("source").alias("source")), capacity, shard_rows)


def pack_rows(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """As pack_documents; rows: doc_id, words, and numbers for cluster and source."""
    # Every source's share of a shard is near its share of all, as doc_id's hash deals them out.
    shards = max(1, -(-rows.count() // shard_rows))

    def run(key, pdf):
        import math

        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "cluster", "source", "words"], kind="stable")
        n = np.maximum(1, -(-pdf["words"].to_numpy() // capacity))
        share = pd.Series(n).groupby(pdf["source"].to_numpy()).sum()
        room = max(1.0, n.sum() * capacity / max(1, pdf["words"].sum()))
        quota = {int(s): math.ceil(room * c / n.sum()) for s, c in share.items()}
        items, ids = [], []
        for group, (d, w, c, s, k) in enumerate(zip(pdf["doc_id"], pdf["words"], pdf["cluster"], pdf["source"], n, strict=True)):
            for p in range(k):
                size = int(min(capacity, w - p * capacity))
                items.append((size, group, int(c), int(s)))
                ids.append((d, p, p * capacity, size))
        placed = pack(items, capacity, quota)
        shard = int(key[0])
        return pd.DataFrame(
            [(*x, shard + b * shards, o) for x, (b, o) in zip(ids, placed, strict=True)], columns=["doc_id", "piece", "start", "length", "bin_id", "offset"]
        )

    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("shard").applyInPandas(run, OUT)


def pack_near_copies_apart(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """As pack_documents, with the components of near copies (five words, 0.75) as clusters; wordless texts, which link with nothing, by exact text."""
    rows, name, found = jaccard.row_components(docs)
    rows = rows.select(F.col(f"{name}.row").alias("_row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("exact"), F.xxhash64("source").alias("source"))
    rows = rows.join(found, "_row").withColumn("cluster", F.when(F.col("_words") > 0, F.xxhash64("_component", F.lit(1))).otherwise(F.col("exact")))
    return pack_rows(written(rows.select("doc_id", F.col("_words").alias("words"), "cluster", "source"), "packing-rows"), capacity, shard_rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_near_copies_apart(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
