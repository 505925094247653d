"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of the learning texts (A-Z lowered) and one end for each text. Words of at least HEAVY of
all tokens (1 / HEAVY words at most) have a probability of their own at the root; the rarer ones
share a class with the unknown symbol, equally.

A context is what stands before a symbol, up to `max_context` words of one text. A context that occurs
LEAST times or more is retained as a state if its next-symbol counts diverge from its parent's
distribution (that of the longest retained suffix): the sum of c(s w) ln(P(w|s) / P(w|parent)) over all that followed s must reach
GAIN nats and one nat for each symbol that followed. Distributions are smoothed down the tree:
P(w|s) = (c(s w) - D + D types(s) P(w|parent)) / c(s), and sum to 1. A symbol is scored in the longest suffix of
the words before it that is a state. There is no other limit on contexts, so the tree grows with the texts.

The tree is never in one place. Map tasks cut texts into slices, put each distinct (context, symbol) of a slice
together with its count and the texts that ask for it, and send it to a bucket by its last word;
all contexts that end in a word are in its bucket, which grows, retains and scores them level by level and
returns sums by text. A word that holds more than a bucket's share is dealt by the two last words, and so on:
contexts that are so frequent (`hot`, found in a bounded sample, which decides on the dealing and not on results)
are counted and judged before, in DataFrame joins, and their distributions sent to the buckets that need them.

Defined results: null or empty text is its end alone; a null doc_id takes no part in the query; repeated rows are
scored and counted each; without learning texts every symbol has probability 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm.common import map_texts, mix, release, table, word_hashes, written
from skeingraph.llm.toxicity import held_out

HEAVY = 5e-8
MAX_CONTEXT, LEAST = 5, 2
GAIN, DISCOUNT = 2.0, 0.5
#: Tokens of a slice and of a bucket, about; buckets, at most; texts that hot contexts are looked for in, about.
SLICE, BUCKET, MOST_BUCKETS, SAMPLE = 800_000, 1_000_000, 100_000, 20_000
#: Symbols: nothing (before a text's start), the end, then words by falling frequency; the others by 40 bits of their hash.
NOTHING, END, FIRST, RARE = 0, 1, 2, 1 << 40
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in sorted_keys, -1 where it isn't one."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct keys: a place of each, in the keys' order; and each key's number among them. As np.unique, without its slower stable sort."""
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]) if len(keys) else np.zeros(0, bool)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def vocabulary(docs: DataFrame) -> DataFrame:
    """word (hash) and c, its count in all texts."""

    def run(batches):
        held, n = [], 0

        def send():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"word": h.view(np.int64), "c": c})

        for batch in batches:
            held.append(word_hashes(batch.column(0))[0])
            n += len(held[-1])
            if n >= 2 * SLICE:
                yield send()
                held, n = [], 0
        if n:
            yield send()

    return map_texts(docs.select("text"), run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Root:
    """The root's distribution, and the numbers of symbols."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray, tokens: int, texts: int, types: int, n1: int, n2: int):
        self.n, self.texts, self.v = tokens, texts, types
        order = np.lexsort((heavy, -counts))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order)) + FIRST
        by = np.argsort(heavy)
        self.heavy, self.number = heavy[by], number[by]
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
        n = max(1, tokens)
        #: By number: the count, and the probability; [0] stands for the words without a number.
        self.counts = np.concatenate([[0, texts], counts[order]]).astype(np.float64)
        self.p = np.maximum(self.counts - d, 0) / n
        rare_types = types - len(heavy) - bool(texts)
        rare_tokens = tokens - int(self.counts.sum())
        self.p[0] = (rare_tokens + d * (len(heavy) + bool(texts))) / n / (rare_types + 1)
        if not tokens:
            self.p[:] = 1.0

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = find(self.heavy, hashes)
        rare = (hashes >> np.uint64(24)).astype(np.int64) + RARE
        return np.where(at >= 0, self.number[at], rare) if len(self.heavy) else rare

    def of(self, symbols: np.ndarray) -> np.ndarray:
        return self.p[np.where(symbols < RARE, symbols, 0)]


class Tokens:
    """Symbols of texts one after the other, each text with its end, and the words before each of them."""

    def __init__(self, root: Root, texts, depth: int):
        hashes, counts = word_hashes(texts)
        self.hashes, self.sizes = hashes, counts + 1
        self.w = np.insert(root.symbols(hashes), np.cumsum(counts), END)
        self.doc = np.repeat(np.arange(len(counts)), self.sizes)
        start = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.w)) - start[self.doc] if len(self.w) else np.zeros(0, np.int64)
        self.before = [np.where(place >= k, np.concatenate([np.zeros(min(k, len(self.w)), np.int64), self.w[:-k]])[: len(self.w)], NOTHING) for k in range(1, depth + 1)]


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of contexts with one more word before them."""
    return mix(key * _ODD[0] + word.view(np.uint64) * _ODD[1])


def paired(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Keys of contexts with a symbol after them."""
    return mix((key ^ _ODD[2]) + symbol.view(np.uint64) * _ODD[0])


class Hot:
    """Contexts that are dealt by a longer one: sorted keys by length, with number, parent's number, and the buckets that their longer contexts go to."""

    def __init__(self, rows: list[tuple[int, int, int, float]], buckets: int):
        self.buckets = buckets
        rows = sorted(rows)
        self.keys, self.numbers, self.first, self.spread = {}, {}, np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
        at = {(k, key): i for i, (k, key, _, _) in enumerate(rows)}
        self.parent = [at[k - 1, up] if k > 1 else -1 for k, _, up, _ in rows]
        for k in {r[0] for r in rows}:
            own = [(np.uint64(r[1] % 2**64), i) for i, r in enumerate(rows) if r[0] == k]
            own.sort()
            self.keys[k] = np.array([x for x, _ in own], np.uint64)
            self.numbers[k] = np.array([i for _, i in own], np.int64)
        for i, (_, key, _, share) in enumerate(rows):
            self.first[i] = key % buckets
            self.spread[i] = min(buckets, math.ceil(2 * share * buckets) + 1)
        #: Of each context: the buckets that hold longer ones of it or of those that end in it.
        self.targets = [set() for _ in rows]
        for i in range(len(rows)):
            own, up = {(int(self.first[i]) + j) % buckets for j in range(int(self.spread[i]))}, i
            while up >= 0:
                self.targets[up] |= own
                up = self.parent[up]

    def __len__(self):
        return len(self.parent)

    def number(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Number of each key among the hot contexts of length k, or -1."""
        if k not in self.keys:
            return np.full(len(keys), -1, np.int64)
        at = find(self.keys[k], keys)
        return np.where(at >= 0, self.numbers[k][at], -1)

    def deal(self, t: Tokens) -> np.ndarray:
        """The bucket of each token: by its shortest context that is not hot, among the buckets of the longest that is."""
        bucket = np.zeros(len(t.w), np.int64)
        key, left, within = np.zeros(len(t.w), np.uint64), np.arange(len(t.w)), np.full(len(t.w), -1, np.int64)
        for k, u in enumerate(t.before, 1):
            ends = u[left] == NOTHING
            new = longer(key, u[left])
            hot = self.number(k, new)
            # Where the text starts, or no longer context is left, the symbol itself deals.
            stop = ends | (hot < 0) | (k == len(t.before))
            by = np.where(ends, paired(key, t.w[left]), np.where(hot < 0, new, paired(new, t.w[left])))
            inside = np.where(~ends & (hot >= 0), hot, within)
            part = by[stop] >> np.uint64(11)
            i = inside[stop]
            spread = np.where(i >= 0, self.spread[i], self.buckets) if len(self) else np.full(len(i), self.buckets)
            first = np.where(i >= 0, self.first[i], 0) if len(self) else np.zeros(len(i), np.int64)
            bucket[left[stop]] = (first + (part % spread.astype(np.uint64)).astype(np.int64)) % self.buckets
            key, left, within = new[~stop], left[~stop], hot[~stop]
            if not len(left):
                break
        return bucket


def hot_contexts(docs: DataFrame, root, max_context: int, buckets: int, sample: int = SAMPLE) -> Hot:
    """Contexts that make up more than half of a bucket, or of a 128th of all tokens, in a sample of about `sample` texts; at most 2 * max(128, buckets) of a length."""
    n, share = docs.count(), 0.5 / max(128, buckets)
    few = docs.select("text") if n <= sample else docs.where(F.rand(11) < sample / n).select("text")

    def run(batches):
        for batch in batches:
            t = Tokens(root.value, batch.column(0), max_context)
            key, left = np.zeros(len(t.w), np.uint64), np.arange(len(t.w))
            yield pd.DataFrame({"k": [0], "key": [0], "up": [0], "c": [len(t.w)]})
            for k, u in enumerate(t.before[:-1], 1):
                on = u[left] != NOTHING
                left, up = left[on], key[on]
                key = longer(up, u[left])
                found, first, c = np.unique(key, return_index=True, return_counts=True)
                often = c >= max(2, share / 4 * len(t.w))
                yield pd.DataFrame({"k": k, "key": found[often].view(np.int64), "up": up[first][often].view(np.int64), "c": c[often]})

    rows = map_texts(few, run, "k int, key long, up long, c long").groupBy("k", "key", "up").agg(F.sum("c").alias("c"))
    rows = written(rows, "lm-hot")
    total = rows.where("k = 0").first()
    if not total:
        return Hot([], buckets)
    rows = rows.where((F.col("k") > 0) & (F.col("c") > share * total["c"])).collect()
    return Hot([(r["k"], r["key"], r["up"], r["c"] / total["c"]) for r in rows], buckets)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of integers from 0 to 2**48 - 2: of all numbers their lengths in bits, as bytes, then the bits below the highest, bit by bit; either part compressed, as they differ in kind."""
    import zstandard

    x = np.concatenate(columns).astype(np.int64) + 1
    length = np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    lengths, bits = length.tobytes(), []
    for bit in range(int(length.max(initial=1)) - 1):
        long = length > bit + 1
        if not long.all():
            x, length = x[long], length[long]
        bits.append(np.packbits((x >> bit).astype(np.uint8) & 1).tobytes())
    compress = zstandard.ZstdCompressor(level=1).compress
    first = compress(lengths)
    return np.array([len(columns[0]), len(first)], "<u4").tobytes() + first + compress(b"".join(bits))


def _unpacked(block: bytes, columns: int) -> np.ndarray:
    import zstandard

    n, cut = np.frombuffer(block[:8], "<u4").tolist()
    decompress = zstandard.ZstdDecompressor().decompress
    length = np.frombuffer(decompress(block[8 : 8 + cut]), np.uint8).astype(np.int64)
    raw, at, live = np.frombuffer(decompress(block[8 + cut :]), np.uint8), 0, np.arange(columns * n)
    out = np.left_shift(1, length - 1)
    for bit in range(int(length.max(initial=1)) - 1):
        live = live[length[live] > bit + 1]
        size = -(-len(live) // 8)
        out[live] |= np.unpackbits(raw[at : at + size], count=len(live)).astype(np.int64) << bit
        at += size
    return (out - 1).reshape(columns, n)


#: kind 0: distinct contexts and symbols of a slice; 1: a hot context's distribution; 2: a slice's texts.
ROWS = "kind int, bucket long, slice long, a binary, b binary, c binary"


def _requests(docs: DataFrame, root, hot: Hot, max_context: int) -> DataFrame:
    """ROWS of kinds 0 and 2 of docs (doc_id, text, learn)."""
    held_hot = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        import pickle

        import pyarrow as pa
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        r, hot = root.value, held_hot.value

        def send(parts):
            batch = pa.Table.from_batches(parts).combine_chunks()
            t, learn = Tokens(r, batch["text"].combine_chunks() if batch.num_rows else pa.array([], pa.string()), max_context), np.asarray(batch["learn"], bool)
            at = (task << 32) + k
            # The texts: what needs no context.
            c = np.where(t.w < RARE, r.counts[np.where(t.w < RARE, t.w, 0)], 0.0)
            by = lambda x: np.bincount(t.doc, x, len(t.sizes))
            base = np.where(t.w < RARE, np.log10((c + 1) / (r.n + r.v + 1)), 0.0)
            rare = np.split(t.hashes.view(np.int64)[t.w[t.w != END] >= RARE], np.cumsum(by((t.w >= RARE).astype(float)).astype(np.int64))[:-1])
            texts = pickle.dumps((batch["doc_id"].to_pylist(), t.sizes, by((c > 0).astype(float)).astype(np.int64), by(base), rare))
            out = [(2, hot.buckets + at % 2**31, at, texts, None, None)]
            # The distinct contexts with their symbols, in the order of their buckets and last words.
            bucket, key = hot.deal(t), np.zeros(len(t.w), np.uint64)
            for u in t.before:
                key = longer(key, u)
            first, of = grouped(paired(key, t.w))
            near = lambda u: np.minimum(u[first], (1 << 23) - 1)
            order = np.argsort((bucket[first] << 46) + (near(t.before[0]) << 23) + near(t.before[min(1, max_context - 1)]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            of, first = rank[of], first[order]
            asked = np.bincount(of, minlength=len(first))
            learnt = np.bincount(of, learn[t.doc], len(first)).astype(np.int64)
            doc = t.doc[np.argsort(of, kind="stable")]
            cuts = np.append(np.flatnonzero(np.diff(bucket[first], prepend=-1)), len(first))
            starts = np.append(0, np.cumsum(asked))
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                i = first[a:b]
                out.append((0, bucket[i[0]], at, _packed(*(u[i] for u in t.before), t.w[i]), _packed(learnt[a:b], asked[a:b]), _packed(doc[starts[a] : starts[b]])))
            return pd.DataFrame(out, columns=[x.split()[0] for x in ROWS.split(", ")])

        parts, size = [], 0
        for batch in batches:
            # Texts of about SLICE tokens, at some 6 bytes each.
            for one in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                parts.append(one)
                size += one.nbytes
                if size >= 6 * SLICE:
                    yield send(parts)
                    parts, size, k = [], 0, k + 1
        if parts:
            yield send(parts)

    return map_texts(docs.select("doc_id", "text", "learn"), run, ROWS)


def _hot_rows(docs: DataFrame, root, hot: Hot) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """ROWS of kind 1 for every bucket that needs them, and of each hot context: whether it is a state, and what its distribution leaves to its parent's."""
    held = docs.sparkSession.sparkContext.broadcast(hot)
    depths = {i: k for k, own in hot.numbers.items() for i in own.tolist()}

    def run(batches):
        for batch in batches:
            t = Tokens(root.value, batch.column(0), max(held.value.keys))
            key, left = np.zeros(len(t.w), np.uint64), np.arange(len(t.w))
            for k, u in enumerate(t.before, 1):
                on = u[left] != NOTHING
                left, key = left[on], longer(key[on], u[left[on]])
                number = held.value.number(k, key)
                left, key, number = left[number >= 0], key[number >= 0], number[number >= 0]
                if not len(left):
                    break
                pair, c = np.unique((number << 42) + t.w[left], return_counts=True)
                w = pair & ((1 << 42) - 1)
                yield pd.DataFrame({"number": pair >> 42, "w": w, "c": c, "root": root.value.of(w)})

    pairs = written(map_texts(docs.where("learn").select("text"), run, "number long, w long, c long, root double").groupBy("number", "w").agg(F.sum("c").alias("c"), F.max("root").alias("root")), "lm-pairs")
    spark = docs.sparkSession
    facts = {"state": np.zeros(len(hot), bool), "mass": np.zeros(len(hot))}
    best = None
    for k in sorted(hot.keys):
        numbers = hot.numbers[k].tolist()
        up = F.broadcast(spark.createDataFrame([(i, hot.parent[i]) for i in numbers], "number long, up long"))
        rows = pairs.join(up, "number")
        sums = F.broadcast(rows.groupBy("number").agg(F.sum("c").alias("total"), F.count("*").alias("types")))
        rows = rows.join(sums, "number")
        if best is None:
            rows = rows.withColumn("parent", F.col("root"))
        else:
            rows = rows.join(best.select(F.col("number").alias("up"), "w", F.col("best").alias("parent")), ["up", "w"])
        p = (F.col("c") - DISCOUNT + DISCOUNT * F.col("types") * F.col("parent")) / F.col("total")
        rows = written(rows.select("number", "w", "c", "total", "types", "parent", p.alias("p")), "lm-level")
        judged = rows.groupBy("number").agg(F.sum(F.col("c") * F.log(F.col("p") / F.col("parent"))).alias("gain"), F.first("total").alias("total"), F.first("types").alias("types")).collect()
        for r in judged:
            facts["state"][r["number"]] = r["total"] >= LEAST and r["gain"] >= GAIN + r["types"]
            facts["mass"][r["number"]] = DISCOUNT * r["types"] / r["total"]
        states = [r["number"] for r in judged if facts["state"][r["number"]]]
        level = rows.select("number", "w", F.when(F.col("number").isin(states), F.col("p")).otherwise(F.col("parent")).alias("best"))
        best = level
        everything = level if k == min(hot.keys) else everything.unionByName(level)  # noqa: F821

    def pack(key, pdf):
        number = int(key[0])
        keys = hot.keys[depths[number]][hot.numbers[depths[number]] == number]
        a = paired(np.repeat(keys, len(pdf)), pdf["w"].to_numpy().astype(np.int64))
        return pd.DataFrame([(1, b, -1, a.tobytes(), pdf["best"].to_numpy().astype(np.float64).tobytes(), None) for b in sorted(hot.targets[number])], columns=[x.split()[0] for x in ROWS.split(", ")])

    # A context's symbols in parts, as there may be many.
    return everything.groupBy("number", F.pmod(F.xxhash64("w"), F.lit(16)).alias("part")).applyInPandas(pack, ROWS), facts


def grow(u: np.ndarray, w: np.ndarray, c: np.ndarray, p: np.ndarray, hot: Hot, facts: dict, pairs: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Probability of each symbol w in the longest state that ends in the words before it.

    u[k]: the word k + 1 places before; c: times that the texts learnt from hold it; p: the root's probability; hot contexts: pairs' keys, sorted, and their probability."""
    p, rows, key = p.copy(), np.arange(len(w)), np.zeros(len(w), np.uint64)
    for k, words in enumerate(u, 1):
        on = words[rows] != NOTHING
        rows = rows[on]
        if not len(rows):
            break
        key = longer(key[on], words[rows])
        number = hot.number(k, key)
        is_hot = number >= 0
        if is_hot.any():
            i, of = rows[is_hot], number[is_hot]
            at = find(pairs, paired(key[is_hot], w[i]))
            unseen = np.where(facts["state"][of], facts["mass"][of] * p[i], p[i])
            p[i] = np.where(at >= 0, best[at], unseen) if len(pairs) else unseen
        # The others: contexts that occur often enough, their symbols' counts, and whether they are states.
        own, own_key = rows[~is_hot], key[~is_hot]
        found, ctx = grouped(own_key)
        total = np.bincount(ctx, c[own], len(found))
        often = total[ctx] >= LEAST
        own, own_key, ctx = own[often], own_key[often], ctx[often]
        if len(own):
            first, of = grouped(paired(own_key, w[own]))
            count, ctx_of, parent = np.bincount(of, c[own]), ctx[first], p[own][first]
            types = np.bincount(ctx_of, count > 0, len(found))
            q = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * types[ctx_of] * parent) / total[ctx_of]
            gain = np.bincount(ctx_of, np.where(count > 0, count * np.log(q / parent), 0.0), len(found))
            state = gain >= GAIN + types
            p[own] = np.where(state[ctx], q[of], p[own])
        rows, key = np.concatenate([rows[is_hot], own]), np.concatenate([key[is_hot], own_key])
    return p


def score(docs: DataFrame, max_context: int = MAX_CONTEXT, heavy: float = HEAVY, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs (doc_id, text, learn), and the tokens of the texts that the model learns from, those where learn is true."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    learnt = docs.where("learn")
    words = written(vocabulary(learnt), "lm-words")
    texts = learnt.count()
    n, v, n1, n2 = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n, v = n + texts, v + bool(texts)
    least = max(2.0, heavy * n)
    often = words.where(F.col("c") >= least).toArrow()
    root = Root(often["word"].to_numpy().astype(np.int64).view(np.uint64), often["c"].to_numpy().astype(np.int64), n, texts, v, n1, n2)
    held = spark.sparkContext.broadcast(root)
    buckets = int(min(MOST_BUCKETS, max(1, n // bucket)))
    hot = hot_contexts(learnt, held, max_context, buckets) if buckets > 1 else Hot([], 1)
    rows, facts = _requests(docs, held, hot, max_context), {"state": np.zeros(0, bool), "mass": np.zeros(0)}
    if len(hot):
        more, facts = _hot_rows(docs, held, hot)
        rows = rows.unionByName(more)
    given = spark.sparkContext.broadcast((hot, facts))

    def count(key, pdf):
        if pdf["kind"].iloc[0] == 2:
            return pdf[["kind", "bucket", "slice", "a", "b"]]
        r, (hot, facts) = held.value, given.value
        known, asked = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 0].sort_values("slice")
        pairs = np.concatenate([np.frombuffer(x, np.uint64) for x in known["a"]] or [np.zeros(0, np.uint64)])
        best = np.concatenate([np.frombuffer(x, np.float64) for x in known["b"]] or [np.zeros(0)])
        order = np.argsort(pairs)
        counts = [_unpacked(x, 2) for x in asked["b"]]
        if not counts:
            return pdf.iloc[:0][["kind", "bucket", "slice", "a", "b"]]
        sizes = [x.shape[1] for x in counts]
        u, c, a = np.empty((max_context + 1, sum(sizes)), np.int64), np.concatenate([x[0] for x in counts]), 0
        for x, n in zip(asked["a"], sizes, strict=True):
            u[:, a : a + n] = _unpacked(x, max_context + 1)
            a += n
        log = np.log10(grow(u[:-1], u[-1], c, r.of(u[-1]), hot, facts, pairs[order], best[order]))
        del u, c
        out, a = [], 0
        for s, x, (_, times), docs in zip(asked["slice"], sizes, counts, asked["c"], strict=True):
            doc, at = np.unique(_unpacked(docs, 1)[0], return_inverse=True)
            # Sums as multiples of 2**-24, 6e-8.
            sums = np.bincount(at, np.repeat(log[a : a + x], times))
            out.append((0, int(key[0]), s, _packed(doc, np.rint(-sums * 2**24)), None))
            a += x
        return pd.DataFrame(out, columns=["kind", "bucket", "slice", "a", "b"])

    def gather(pdf):
        import pickle

        texts = pdf[pdf["kind"] == 2].iloc[0]
        ids, sizes, known, base, rare = pickle.loads(texts["a"])
        total = np.zeros(len(ids))
        for a in pdf.loc[pdf["kind"] == 0, "a"]:
            doc, sums = _unpacked(a, 2)
            total[doc] -= sums / 2**24
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": sizes, "n_known": known, "base_score": base, "score": total, "rare": rare})

    release(spark)
    # Compressed blocks: adaptive execution would put too many of them into one task, so the number of tasks is given.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    sums = rows.repartition(parts, "bucket").groupBy("bucket").applyInPandas(count, "kind int, bucket long, slice long, a binary, b binary")
    scores = sums.groupBy("slice").applyInPandas(gather, "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    scores = written(scores.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    # The rare words' part of the base score.
    rest = scores.select("row", F.explode("rare").alias("word")).join(words.where(F.col("c") < least), "word", "left")
    rest = rest.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("base"))
    out = scores.join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score"
    )
    return out, n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 7, 2)
    out, n = score(docs.withColumn("learn", ~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
