"""SentencePiece encoding over a relational lattice, and decoding.

A text gets a leading space, spaces become U+2581, and the result falls into chunks: it is cut
between two characters wherever no piece of the table holds them side by side. No path of
the lattice crosses such a border, so cutting there changes no result, and digits, rare
characters and foreign scripts fall apart into few distinct chunks. Chunks of any length are handled whole.

Three steps:

* A cache: chunks that a bounded sample of texts (SAMPLE) holds, at most CACHE of them, the most frequent
  ones, are coded first and broadcast. It only saves work; a text's pieces do not depend on it.
* Batches of about BATCH characters write their texts as numbers of distinct chunks, which are told apart by hashes of
  64 bits, and one row for each distinct chunk that the cache lacks.
* The lattice of those chunks. Their substrings of at most the longest piece's length are
  exploded and equi-joined to the piece table (a fixed table, so it is broadcast); a character that is no piece gets
  an edge of its own, at 10 below the lowest score, which stands for its UTF-8 bytes' pieces. Edges are grouped by
  chunk, and a higher-order `aggregate` folds Viterbi over them in the order of their ends: the path of the
  largest summed score, on ties the earlier start of the later piece. That is the segmentation SentencePiece
  gives for a unigram table of these pieces and scores. A fold looks back over one block of
  positions only, so its work grows with a chunk's length, not with its square.

A batch's codes then meet its texts in one cogroup. Batches are of one size whatever a
text's length or a chunk's frequency; they are written before they are used, bucketed by batch, so that texts are never shuffled.

The piece table is an argument (id, piece, score); `piece_table` reads one from a model file.

Defined results: null and empty texts have no pieces; a null doc_id is kept as it is; repeated rows are encoded each; every
text decodes to itself, apart from U+2581, which decodes to a space as in the library; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm.common import LONG_WORD, bucketed, mix, release, span_hashes, table, written

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of a batch, and of the texts of it that are cut together, about.
BATCH, GROUP_CHARS = 3_000_000, 60_000
#: Texts that the cache is gathered from, at most and about, a quarter of all at most; chunks that it holds, at most.
SAMPLE, SHARE, CACHE = 64_000, 0.25, 1_200_000
#: Positions of a block of the fold; chunks whose edges one task groups at a time, about.
BLOCK, GROUP = 64, 20_000
HASHED = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
#: The setting that names the model file of the query, and where the box keeps public tokenizers.
MODEL_CONF, MODEL = "spark.skeingraph.pieces.model", "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Pieces:
    """Pieces that text matches (id, score), the ids of the 256 bytes, and what each id decodes to."""

    normal: dict[str, tuple[int, float]]
    byte_ids: list[int]

    @property
    def longest(self) -> int:
        return max(map(len, self.normal), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, s in self.normal.values()), default=0.0) - UNKNOWN_PENALTY

    @property
    def pairs(self) -> frozenset[str]:
        """Characters that stand side by side in a piece."""
        return frozenset(p[i : i + 2] for p in self.normal for i in range(len(p) - 1))

    def decoded(self) -> dict[int, bytes]:
        return {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.normal.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


def piece_table(path: str) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    normal = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    return Pieces(normal, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Cutter:
    """Cuts texts into chunks: a run of characters in which each two neighbours are neighbours in a piece as well."""

    def __init__(self, pieces: Pieces):
        pairs = pieces.pairs
        letters = sorted({c for p in pairs for c in p})
        self.kinds = len(letters) + 1
        #: Number of each character that stands beside another one in a piece, 0 for all others.
        self.kind = np.zeros(0x110000, np.uint32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, self.kinds)
        self.beside = np.zeros(self.kinds * self.kinds, bool)
        self.beside[[int(self.kind[ord(p[0])]) * self.kinds + int(self.kind[ord(p[1])]) for p in pairs]] = True

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts (not empty) one after the other as they are encoded, where each chunk starts, and how many chunks each text has."""
        whole = "".join([SPACE + t.replace(" ", SPACE) for t in texts])
        if not whole:
            return whole, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.kind[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = np.append(True, ~self.beside[kind[:-1] * np.uint32(self.kinds) + kind[1:]])
        cut[begins[:-1]] = True
        start = np.flatnonzero(cut)
        return whole, start, np.diff(np.searchsorted(start, begins))


def chunks(text: str | None, pieces: Pieces) -> list[str]:
    whole, start, _ = Cutter(pieces).cut([text] if text else [])
    return [whole[a:b] for a, b in zip(start, np.append(start, len(whole))[1:], strict=True)]


class Chunks:
    """Chunks of a batch of texts: a hash of each, in the order of the texts, and the first place of each distinct one."""

    def __init__(self, cut: Cutter):
        self.cutter, self.wholes, self.starts, self.hashes, self.counts, self.held, self.chars, self.size = cut, [], [], [], [], [], 0, 0

    def add(self, text: str | None) -> None:
        self.held.append(text)
        self.chars += len(text or "")
        self.size += len(text or "")
        if self.chars >= GROUP_CHARS:
            self.flush()

    def flush(self) -> None:
        import xxhash

        whole, start, counts = self.cutter.cut([t for t in self.held if t])
        end = np.append(start[1:], len(whole)).astype(np.int64)
        h = span_hashes(mix(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)), start, end) if whole else np.zeros(0, np.uint64)
        for i in np.flatnonzero(end - start > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(whole[start[i] : end[i]].encode("utf-8", "surrogatepass"))
        every = np.zeros(len(self.held), np.int64)
        every[[i for i, t in enumerate(self.held) if t]] = counts
        self.wholes.append(whole)
        self.starts.append(np.append(start, len(whole)).astype(np.int32))
        self.hashes.append(h)
        self.counts.append(every)
        self.held, self.chars = [], 0

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct chunks by falling count, their counts, the place of one of each, and each chunk's number."""
        if self.held:
            self.flush()
        h, first, number, c = np.unique(np.concatenate(self.hashes or [np.zeros(0, np.uint64)]), return_index=True, return_inverse=True, return_counts=True)
        order = np.lexsort((first, -c))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return h[order], c[order], first[order], rank[number]

    def texts(self, places: np.ndarray) -> list[str]:
        """The chunks that stand at these places."""
        before = np.cumsum([0] + [len(h) for h in self.hashes])
        group = np.searchsorted(before, places, "right") - 1
        at = places - before[group]
        return [self.wholes[g][self.starts[g][i] : self.starts[g][i + 1]] for g, i in zip(group.tolist(), at.tolist(), strict=True)]


def viterbi(blocks: Column, length: Column, longest: int) -> Column:
    """Ids along the best path. blocks: array<struct<block, edges>> by block, each with its edges struct<end, start, score, id> sorted by end
    and start, at least one for each end; block k holds the ends from k * size + 1 on, size being `block_size(longest)`."""
    size = block_size(longest)
    step = "struct<score:double,start:int,id:int>"
    step_of = lambda score, e: F.struct(score.alias("score"), e["start"].alias("start"), e["id"].alias("id"))
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id")).cast(step)

    def block(out, x):
        # Of the block before, the steps that an edge may start from; of the first, position 0 alone.
        held = F.when(x["block"] == 0, F.lit(1)).otherwise(F.lit(longest))
        before = F.element_at(out, -1)
        tail = F.when(x["block"] == 0, before).otherwise(F.slice(before, -longest, longest))
        base = x["block"] * size + 1 - held  # the position of the first step at hand

        def fold(a, e):
            at = e["start"] - base
            score = F.when(at < F.size(a["done"]), F.get(a["done"], at)["score"]).otherwise(a["now"]["score"]) + e["score"]
            # now: the best edge so far of those that end where the last one did; the ends come one by one.
            opened = F.struct(F.array_append(a["done"], a["now"]).alias("done"), step_of(score, e).alias("now"), e["end"].alias("end"))
            better = F.struct(a["done"].alias("done"), step_of(score, e).alias("now"), a["end"].alias("end"))
            return F.when(e["end"] > a["end"], F.when(a["end"] < 0, F.struct(a["done"].alias("done"), step_of(score, e).alias("now"), e["end"].alias("end"))).otherwise(opened)).when(score > a["now"]["score"], better).otherwise(a)

        start = F.struct(tail.alias("done"), zero.alias("now"), F.lit(-1).alias("end"))
        return F.array_append(out, F.slice(F.aggregate(x["edges"], start, fold, lambda a: F.array_append(a["done"], a["now"])), held + 1, size))

    best = F.aggregate(blocks, F.array(F.array(zero)).cast(f"array<array<{step}>>"), block)

    def way_back(best):
        """Blocks from the last to the first: each gives where the path enters it, and its ids."""

        def block(out, k):
            steps = F.get(best, k)

            def position(a, i):
                here = F.get(steps, i)
                return F.when(a["at"] == (k - 1) * size + 1 + i, F.struct(here["start"].alias("at"), F.array_prepend(a["ids"], here["id"]).alias("ids"))).otherwise(a)

            start = F.struct(F.element_at(out, -1)["at"].alias("at"), F.array().cast("array<int>").alias("ids"))
            return F.array_append(out, F.aggregate(F.sequence(F.size(steps) - 1, F.lit(0), F.lit(-1)), start, position))

        start = F.array(F.struct(length.alias("at"), F.array().cast("array<int>").alias("ids")))
        found = F.aggregate(F.sequence(F.size(best) - 1, F.lit(1), F.lit(-1)), start, block)
        return F.flatten(F.transform(F.reverse(found), lambda x: x["ids"]))

    # The fold is bound once, as the only element of an array.
    return F.get(F.transform(F.array(best), way_back), F.lit(0))


def block_size(longest: int) -> int:
    return max(BLOCK, longest)


def lattice(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """batch, number, ids of the chunks of rows (batch, number, chunk), which are written and have no chunk twice."""
    spark = rows.sparkSession
    longest, size = pieces.longest, block_size(pieces.longest)
    known = F.broadcast(spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.normal.items()], "piece string, id int, score double"))
    parts = max(1, -(-rows.where("chunk is not null").count() // GROUP))
    words = rows.where("chunk is not null").select("batch", "number", "chunk", F.length("chunk").alias("n")).repartition(parts, "batch", "number")
    key = ["batch", "number", "n"]

    def edges(words):
        # Of each block of starts, the characters that its edges may cover.
        windows = words.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size)), lambda at: F.substr("chunk", at + 1, F.lit(size + longest - 1)))).alias("k", "window"))
        starts = windows.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(size), F.col("n") - F.col("k") * size) - 1)).alias("s"))
        spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("window") - F.col("s")))).alias("size"))
        start = F.col("k") * size + F.col("s")
        spans = spans.select(*key, start.alias("start"), (start + F.col("size")).alias("end"), F.substr("window", F.col("s") + 1, F.col("size")).alias("piece"))
        alone = F.col("id").isNull() & (F.length("piece") == 1)
        # A character that is no piece: its code point, as a negative number.
        found = spans.join(known, "piece", "left").where(F.col("id").isNotNull() | alone)
        return found.select(*key, "end", "start", F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"))

    gathered = F.sort_array(F.collect_list(F.struct("end", "start", "score", "id"))).alias("edges")
    short = edges(words.where(F.col("n") <= size)).groupBy(*key).agg(gathered).select(*key, F.array(F.struct(F.lit(0).alias("block"), "edges")).alias("blocks"))
    long = edges(words.where(F.col("n") > size)).groupBy(*key, F.floor((F.col("end") - 1) / size).cast("int").alias("block")).agg(gathered)
    long = long.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block", "edges"))).alias("blocks"))
    grouped = short.unionByName(long)
    ids = viterbi(F.col("blocks"), F.col("n"), longest)
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])

    def raw(x):
        hexes = F.hex(F.encode(F.decode(F.unhex(F.lpad(F.hex(-1 - x), 8, "0")), "UTF-32"), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(hexes) / 2).cast("int") - 1), lambda b: F.get(byte_ids, F.conv(F.substr(hexes, (b * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))

    coded = grouped.select("batch", "number", ids.alias("ids"))
    spelt = F.flatten(F.transform("ids", lambda x: F.when(x < 0, raw(x)).otherwise(F.array(x))))
    coded = coded.select("batch", "number", F.when(F.exists("ids", lambda x: x < 0), spelt).otherwise(F.col("ids")).alias("ids"))
    # In partitions of GROUP chunks, edges are gathered in a hash table and need not be sorted; the factor leaves room for uneven ones.
    before = spark.conf.get(HASHED)
    spark.conf.set(HASHED, str(8 * GROUP))
    try:
        return written(coded, "pieces-coded")
    finally:
        spark.conf.set(HASHED, before)


class Cache:
    """Chunks known by their hashes, sorted, and the ids of each, one list after the other."""

    def __init__(self, key: np.ndarray, flat: np.ndarray, size: np.ndarray):
        order = np.argsort(key)
        self.key, self.size = key[order], size[order]
        self.flat = _gather(flat, size, order)[0].astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each chunk, -1 for those that are not held."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, at, -1)


def _cache(docs: DataFrame, pieces: Pieces, sample: int, most: int) -> Cache:
    n = docs.count()
    few = docs.where(F.rand(7) < min(SHARE, sample / n if n else 1.0)).select("text")
    held = docs.sparkSession.sparkContext.broadcast(Cutter(pieces))

    def run(parts):
        got = Chunks(held.value)

        def send():
            h, c, first, _ = got.distinct()
            return pd.DataFrame({"hash": h.view(np.int64), "chunk": got.texts(first), "c": c})

        for pdf in parts:
            for t in pdf["text"]:
                got.add(t)
                if got.size >= BATCH:
                    yield send()
                    got = Chunks(held.value)
        if got.size:
            yield send()

    counts = few.mapInPandas(run, "hash long, chunk string, c long").groupBy("hash", "chunk").agg(F.sum("c").alias("c"))
    counts = written(counts.withColumn("number", F.monotonically_increasing_id()).withColumn("batch", F.lit(0).cast("long")), "pieces-cache")
    # The least count of which not more than `most` chunks have as much; few distinct counts reach the driver, as their sum is the sample's.
    total, least = 0, None
    for c, k in sorted(((r["c"], r["count"]) for r in counts.groupBy("c").count().collect()), reverse=True):
        total += k
        if total > most:
            break
        least = c
    if least is None:
        return Cache(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    chosen = written(counts.where(F.col("c") >= least).select("batch", "number", "hash", "chunk"), "pieces-cache")
    found = chosen.join(lattice(chosen, pieces), ["batch", "number"]).select("hash", "ids").toArrow()
    ids = found["ids"].combine_chunks()
    return Cache(found["hash"].to_numpy().astype(np.int64).view(np.uint64), np.asarray(ids.flatten(), np.int32), np.diff(np.asarray(ids.offsets)).astype(np.int64))


def _packer():
    """uint32 numbers byte plane by byte plane, compressed."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    return lambda x: compress(np.asarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacker():
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    return lambda block: np.frombuffer(decompress(block), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


#: A row of texts (ids, sizes, chunks: how many chunks each has, and their numbers), a batch's distinct chunks (codes: in the cache, or after it), or one that the cache lacks (number, chunk).
ROWS = "batch long, ids array<long>, sizes binary, chunks binary, codes binary, number long, chunk string"


def _batches(docs: DataFrame, pieces: Pieces, cached) -> DataFrame:
    columns, held = [x.split()[0] for x in ROWS.split(", ")], docs.sparkSession.sparkContext.broadcast(Cutter(pieces))

    def run(parts):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        pack, cache = _packer(), cached.value

        def rows(batch, **kw):
            # Numbers as objects, as most columns of a kind are null.
            return pd.DataFrame({"batch": batch} | {c: kw.get(c) for c in columns[1:]}, index=range(len(next(iter(kw.values()))))).astype({"number": "Int64"})

        def send(ids, got):
            batch = (task << 32) + k
            h, _, first, number = got.distinct()
            # One row for each group of texts that were cut together.
            cuts = np.cumsum([len(x) for x in got.counts])[:-1]
            groups = np.split(number, np.cumsum([len(x) for x in got.hashes])[:-1])
            yield rows(batch, ids=[ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)], sizes=[pack(x) for x in got.counts], chunks=[pack(x) for x in groups])
            codes = cache.find(h)
            rare = np.flatnonzero(codes < 0)
            codes[rare] = len(cache.key) + np.arange(len(rare))
            yield rows(batch, codes=[pack(codes)])
            if len(rare):
                yield rows(batch, number=np.arange(len(rare)), chunk=got.texts(first[rare]))

        ids, got = [], Chunks(held.value)
        for pdf in parts:
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids.append(None if pd.isna(d) else int(d))
                got.add(t.replace(SPACE, " ") if t else t)
                if got.size >= BATCH or len(ids) >= BATCH // 10:
                    yield from send(ids, got)
                    ids, got, k = [], Chunks(held.value), k + 1
        if ids:
            yield from send(ids, got)

    return docs.select("doc_id", "text").mapInPandas(run, ROWS)


def _gather(flat: np.ndarray, size: np.ndarray, x: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that stand one after the other in flat, those of the numbers x, and their sizes."""
    at = np.cumsum(size) - size if at is None else at
    k = size[x]
    return flat[np.repeat(at[x] - (np.cumsum(k) - k), k) + np.arange(k.sum())], k


def _lists(ids) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32), size


def encode(docs: DataFrame, pieces: Pieces, sample: int = SAMPLE, most: int = CACHE) -> DataFrame:
    """doc_id, ids (array<int>), decoded_sha256 (of the ids' text) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    cached = spark.sparkContext.broadcast(_cache(docs, pieces, sample, most))
    buckets = int(min(10_000, max(1, docs.count() // 4000)))
    release(spark)
    batches = bucketed(_batches(docs, pieces, cached), "pieces_batches", buckets, "batch")
    coded = lattice(batches.select("batch", "number", "chunk"), pieces)
    held = spark.sparkContext.broadcast(pieces.decoded())
    release(spark)

    def assemble(texts: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        unpack, cache = _unpacker(), cached.value
        more, more_size = _lists(coded["ids"].to_numpy()[np.argsort(coded["number"].to_numpy())])
        codes = unpack(texts.loc[texts["codes"].notna(), "codes"].iloc[0])
        # Of the batch's distinct chunks: ids, one list after the other, and the bytes that they decode to.
        flat, size = _gather(np.concatenate([cache.flat, more]), np.concatenate([cache.size, more_size]), codes)
        ends = np.cumsum(np.append(0, size))
        get, every, cuts = held.value.__getitem__, flat.tolist(), ends.tolist()
        spelt = [b"".join(map(get, every[a:b])) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        del every, cuts
        doc, out, sha = [], [], []
        for ids, sizes, numbers in texts.loc[texts["chunks"].notna(), ["ids", "sizes", "chunks"]].itertuples(index=False):
            doc += [None if pd.isna(d) else int(d) for d in ids]
            x, n = unpack(numbers), unpack(sizes)
            group, k = _gather(flat, size, x, ends[:-1])
            at, after = np.cumsum(n)[:-1], np.cumsum(np.append(0, k))
            out += np.split(group, after[at])
            words = [spelt[i] for i in x.tolist()]
            sha += [hashlib.sha256(b"".join(words[a:b])[1:]).hexdigest() for a, b in zip([0, *at], [*at, len(words)], strict=True)]
        return pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "ids": out, "decoded_sha256": sha})

    texts = batches.where("chunk is null").drop("number", "chunk")
    return texts.groupBy("batch").cogroup(coded.withColumnRenamed("batch", "b").groupBy("b")).applyInPandas(assemble, "doc_id long, ids array<int>, decoded_sha256 string")


def decode(rows: DataFrame, pieces: Pieces, column: str = "ids") -> DataFrame:
    """rows with `text`, what the ids of `column` decode to; null ids give a null text, ids that the table lacks nothing."""
    held = rows.sparkSession.sparkContext.broadcast(pieces.decoded())

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        get = held.value.get
        return ids.map(lambda x: None if x is None else b"".join(get(i, b"") for i in x.tolist()).decode("utf-8", "replace")[1:])

    return rows.withColumn("text", text(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), piece_table(spark.conf.get(MODEL_CONF, MODEL)))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_sha256")
