"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents carry labels. Each sentence gets
p = sigmoid(bias + sum of the weights of its features), and a document's score is
the noisy-or 1 - prod(1 - p) of its sentences. Gradient ascent on the likelihood of
the document labels shares the blame among sentences, so the trained model also
locates the offending ones. Features of a word: the word itself (letters and
digits, A-Z lowered) and its first 3 to 6 characters, so unseen forms of a known stem are caught.

The model is fitted on at most `sample` labelled rows of at most `chars` characters, chosen by a hash of
doc_id: features are counted on the executors, and only the chosen ones' numbers by sentence reach the driver. Scoring
is a row-wise pass over all whole texts without any shuffle.

Defined results: null or empty text has no sentence and scores 0; rows with a null
label are not learnt from; without rows of both labels every document scores 0; repeated rows are scored each and
learnt from each, but equal rows of one doc_id once where such rows exceed the sample; a null doc_id is scored, not learnt from; extra columns, whatever their
names, are kept by `filter_toxic`; `with_score` replaces a column of the name that it is given. Ties: a score of exactly the threshold counts as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.llm.common import fresh, table, written

SENTENCES = re.compile(r"[.!?\n\r]+")
TOKEN = re.compile(r"[^\W_]+")
THRESHOLD = 0.7
#: Labelled rows that a model is fitted on, and their characters in all, at most.
SAMPLE, CHARS = 4000, 50_000_000
#: Features that a model has, at most; documents with a feature, at least.
FEATURES, LEAST = 4000, 3


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in range(3, 7) if len(word) >= n)]


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCES.split(text or "") if s and not s.isspace()]


def _words(sentence: str) -> set[str]:
    return set(TOKEN.findall(sentence.lower()))


def counted(rows) -> dict[str, list[int]]:
    """Of each feature: the documents of label 0 and of label 1 that have it. rows: (text, label)."""
    seen: dict[str, list[int]] = {}
    for text, y in rows:
        for f in {f for s in sentences(text) for w in _words(s) for f in features(w)}:
            seen.setdefault(f, [0, 0])[y] += 1
    return seen


def lean(n: Column, m: Column, total: dict[int, int]) -> tuple[Column, Column]:
    """How far a feature of n documents of label 1 and m of label 0 leans to label 1: in standard deviations, and as log odds."""
    p, q, r = n / total[1], m / total[0], (n + m) / (total[0] + total[1])
    z = (p - q) / F.sqrt(r * (1 - r) * (1 / total[0] + 1 / total[1]) + 1e-12)
    return z, F.log((n + 0.5) / (total[1] + 1)) - F.log((m + 0.5) / (total[0] + 1))


def sparse(text: str | None, chosen: dict[str, int]) -> tuple[int, list[list[int]]]:
    """A bag: its number of sentences without a chosen feature, and the features of each other sentence."""
    found = [sorted({chosen[f] for w in _words(s) for f in features(w) if f in chosen}) for s in sentences(text)]
    return sum(not x for x in found), [x for x in found if x]


def ascend(labels: np.ndarray, plain: np.ndarray, bags: np.ndarray, sizes: np.ndarray, col: np.ndarray, n: int, steps: int = 400, rate: float = 0.2, l2: float = 3e-5) -> np.ndarray:
    """Weights of n features and the bias, by gradient ascent on the likelihood of the bags' labels.

    plain: a bag's sentences without features; bags, sizes: of each other sentence its bag and its number of features; col: these features."""
    at, y = np.repeat(np.arange(len(sizes)), sizes), labels.astype(float)
    x = np.zeros(n + 1)
    x[-1] = -4.0
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        z = x[-1] + np.bincount(at, x[col], len(bags))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p0 = 1 / (1 + np.exp(-np.clip(x[-1], -40, 40)))
        log_not = lambda v: np.log1p(-np.minimum(v, 1 - 1e-12))
        none = plain * log_not(p0) + np.bincount(bags, log_not(p), len(y))  # log of the chance that no sentence is toxic
        # d/dz of log(1 - prod) is p * prod / (1 - prod), of log(prod) it is -p
        pull = np.where(y == 1, np.exp(none) / np.maximum(-np.expm1(none), 1e-12), -1.0)
        g = p * pull[bags]
        grad = np.append(np.bincount(col, g[at], n), g.sum() + (p0 * plain * pull).sum()) / len(y) - l2 * np.append(x[:-1], 0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    return x


class Scorer:
    """Scores texts; keeps the sums of at most `keep` words at a time."""

    def __init__(self, model: dict, keep: int = 400_000):
        self.bias, self.weights, self.keep, self.words = model["bias"], model["weights"], keep, {}

    def word(self, w: str) -> float:
        got = self.weights.get
        return sum(got(f, 0.0) for f in features(w))

    def sentence_scores(self, text: str | None) -> np.ndarray:
        known, out = self.words, []
        if len(known) > self.keep:
            known.clear()
        for s in sentences(text.lower() if text else text):
            # Of features that several words of a sentence share, one counts, as in fit.
            words = TOKEN.findall(s)
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            hot = {w for w in words if known[w]}
            out.append(sum(self.weights.get(f, 0.0) for f in {f for w in hot for f in features(w)}) if len(hot) > 1 else sum(known[w] for w in hot))
        return 1 / (1 + np.exp(-np.clip(self.bias + np.array(out), -40, 40)))

    def score(self, text: str | None) -> float:
        p = self.sentence_scores(text)
        return float(0.0 - np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = CHARS) -> DataFrame:
    """text, toxic of at most `sample` rows with at most `chars` characters in all, the first by a hash of doc_id; whole texts.

    Only sampled ids are broadcast, `sample` at most; no text reaches the driver."""
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = written(rows.withColumn("at", F.xxhash64("doc_id", "text", "toxic")).withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long")), "toxicity-rows")
    # A repeated doc_id makes more rows, so they are bounded once more, by rows and by characters.
    first = rows.select("at", "n").orderBy("at").limit(sample).toArrow()
    n = int(np.searchsorted(np.cumsum(first["n"].to_numpy()), chars, "right"))
    last = first["at"][n].as_py() if n < len(first) else None
    repeated = rows.count() > len(first)
    rows = rows.where(F.col("at") < last) if last is not None else rows.where(F.col("at") <= first["at"][-1].as_py()) if repeated else rows
    return rows.dropDuplicates(["at"]).select("text", "toxic") if repeated else rows.select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = CHARS) -> dict:
    """{'bias', 'weights'} from the labelled rows of docs (doc_id, text) and labels (doc_id, toxic) that `sampled` takes.

    Features are counted on the executors; what reaches the driver is at most FEATURES of them, and the numbers of those that each sentence has."""
    spark, nothing = docs.sparkSession, {"bias": -50.0, "weights": {}}
    rows = sampled(docs, labels, sample, chars)
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return nothing

    def count(parts):
        for pdf in parts:
            seen = counted(zip(pdf["text"], pdf["toxic"], strict=True))
            yield pd.DataFrame({"feature": list(seen), "m": [x[0] for x in seen.values()], "n": [x[1] for x in seen.values()]}, dtype=object)

    z, odds = lean(F.col("n"), F.col("m"), total)
    found = rows.mapInPandas(count, "feature string, m long, n long").groupBy("feature").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    found = found.where(F.col("n") >= LEAST).select("feature", z.alias("z"), odds.alias("odds")).where("z >= 3 and odds >= 1")
    chosen = {r["feature"]: i for i, r in enumerate(found.orderBy(F.desc("z"), F.desc("feature")).limit(FEATURES).select("feature").collect())}
    held = spark.sparkContext.broadcast(chosen)

    def bag(parts):
        for pdf in parts:
            bags = [sparse(t, held.value) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "plain": [p for p, _ in bags], "sizes": [[len(x) for x in b] for _, b in bags], "cols": [[i for x in b for i in x] for _, b in bags]})

    got = rows.mapInPandas(bag, "toxic int, plain long, sizes array<int>, cols array<int>").toArrow().combine_chunks()
    held.unpersist()
    flat = lambda name: got[name].combine_chunks()
    bags = np.repeat(np.arange(len(got)), np.diff(np.asarray(flat("sizes").offsets)))
    x = ascend(got["toxic"].to_numpy(), got["plain"].to_numpy(), bags, np.asarray(flat("sizes").flatten(), np.int64), np.asarray(flat("cols").flatten(), np.int64), len(chosen))
    return {"bias": float(x[-1]), "weights": {f: float(x[i]) for f, i in chosen.items()}}


def with_score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """docs with the score of the whole text of each."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield texts.map(scorer.score).astype(float)

    return docs.withColumn(column, score("text"))


def locate(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """doc_id, sentence number from 0, sentence, score: the sentences that score at least `least`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for pdf in batches:
            rows = [
                (d, i, s, float(p))
                for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)
                if t
                for i, (s, p) in enumerate(zip(sentences(t), scorer.sentence_scores(t), strict=True))
                if p >= least
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "sentence", "score"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, sentence_no int, sentence string, score double")


def held_out(doc_id, mod: int, rest: int):
    """doc_id falls into the part crc32(text of doc_id) mod `mod` == rest; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below `threshold`, with their columns."""
    column = fresh(docs, "_toxicity")
    return with_score(docs, train(docs, labels), column).where(F.col(column) < threshold).drop(column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    out = with_score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
