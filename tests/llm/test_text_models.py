import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeingraph.llm import imatch, pieces, suffixtree, toxicity

DOCS = "doc_id long, text string, extra string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "x") for i, t in enumerate(texts)], DOCS)


def toxic_rows():
    rnd = random.Random(1)
    words = ["ba" + c + d for c in "aeiou" for d in "klmnprst"]
    clean = [". ".join(" ".join(rnd.choices(words, k=8)) for _ in range(4)) for _ in range(120)]
    clean = [t + ". You are there" for t in clean]
    toxic = [t + f". You zorg{rnd.choice(['', 's', 'ling'])} there." for t in clean[:60]]
    return [(t, 0) for t in clean] + [(t, 1) for t in toxic]


def trained(spark, rows, **kw):
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    return toxicity.train(frame(spark, [t for t, _ in rows]), labels, **kw)


def test_toxicity_learns_and_locates(spark):
    rows = toxic_rows()
    model = trained(spark, rows)
    docs = frame(spark, ["", None, "plain words ba", rows[0][0] + " Zorgish one!", "x " * 50_000])
    got = [r["score"] for r in toxicity.with_score(docs, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] == 0 and got[2] < 0.3 and got[3] > 0.7 and got[4] < 0.7
    found = toxicity.locate(docs, model).collect()
    assert [(r["doc_id"], r["sentence"].strip()) for r in found] == [(3, found[0]["sentence"].strip())] and "Zorg" in found[0]["sentence"]
    docs = docs.withColumn("_toxicity", F.lit("mine")).withColumn("SCORE", F.lit("too"))
    kept = toxicity.filter_toxic(docs, frame(spark, ["a"]).selectExpr("doc_id", "0 as toxic"))
    assert kept.columns == docs.columns and {(r["_toxicity"], r["SCORE"]) for r in kept.collect()} == {("mine", "too")} and kept.count() == 5
    assert toxicity.with_score(docs.limit(0), model).count() == 0
    assert trained(spark, [("a", 1)]) == trained(spark, []) == {"bias": -50.0, "weights": {}}


def test_the_sample_is_bounded_by_rows_and_characters(spark):
    rows = [(i % 3, "abc def. " * (i % 7), 1) for i in range(90)] + [(None, "x", 1), (5, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (5, 0), (7, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    for sample, chars in ((4, 10**6), (100, 200), (2, 30), (100, 10**6)):
        got = toxicity.sampled(docs, labels, sample, chars).collect()
        assert len(got) <= max(sample, 91 if sample == 100 else 0) and sum(len(r["text"] or "") for r in got) <= chars


def test_training_equals_dense_gradient_ascent(spark):
    """Against noisy-or and its gradient, written out sentence by sentence on a dense matrix."""
    rows = toxic_rows()
    model = trained(spark, rows)
    names = list(model["weights"])
    bags = [[[1.0 if f in {g for w in toxicity._words(s) for g in toxicity.features(w)} else 0.0 for f in names] for s in toxicity.sentences(t)] for t, _ in rows]
    y = np.array([y for _, y in rows], float)
    x, m1, m2 = np.append(np.zeros(len(names)), -4.0), 0.0, 0.0
    for step in range(1, 401):
        grad = np.append(-3e-5 * x[:-1], 0.0)
        for bag, label in zip(bags, y, strict=True):
            a = np.column_stack([np.array(bag), np.ones(len(bag))])
            p = 1 / (1 + np.exp(-(a @ x)))
            none = np.prod(1 - p)
            grad += (p * (none / max(1 - none, 1e-12) if label else -1.0)) @ a / len(y)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        x = x + 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    assert np.allclose([*model["weights"].values(), model["bias"]], x, atol=1e-4)
    text = rows[-1][0]
    p = [1 / (1 + math.exp(-(model["bias"] + sum(model["weights"].get(f, 0) for f in {g for w in toxicity._words(s) for g in toxicity.features(w)})))) for s in toxicity.sentences(text)]
    assert math.isclose(toxicity.Scorer(model).score(text), 1 - math.prod(1 - q for q in p), rel_tol=1e-9)


def test_noisy_or_is_monotone():
    s = toxicity.Scorer({"bias": -5.0, "weights": {"=bad": 4.0}})
    assert s.score("ok.") < s.score("bad.") < s.score("bad. bad. bad.") < 1


class BruteTree:
    """The suffix tree's model by its definition, with dictionaries."""

    def __init__(self, train, depth):
        self.texts = [(t or "").lower().split() + [None] for t in train]
        self.c = Counter(w for t in self.texts for w in t)
        self.n, self.v, self.depth = sum(self.c.values()), len(self.c), depth
        n1, n2 = (sum(c == k for w, c in self.c.items() if w is not None) for k in (1, 2))
        self.d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
        self.own = {w for w, c in self.c.items() if c >= 2 or w is None}
        self.after = {}
        for t in self.texts:
            for i, w in enumerate(t):
                for k in range(1, depth + 1):
                    if i >= k:
                        self.after.setdefault(tuple(t[i - k : i]), Counter())[w] += 1
        self.states = set()
        for s in sorted(self.after, key=len):
            c = self.after[s]
            gain = sum(k * math.log(self.smoothed(s, w) / self.p(s[1:], w)) for w, k in c.items())
            if sum(c.values()) >= 2 and gain >= suffixtree.GAIN + len(c):
                self.states.add(s)

    def smoothed(self, s, w):
        c = self.after[s]
        return (max(0, c[w] - 0.5) + 0.5 * len(c) * self.p(s[1:], w)) / sum(c.values())

    def p(self, s, w):
        while s and s not in self.states:
            s = s[1:]
        if s:
            return self.smoothed(s, w)
        if w in self.own:
            return (self.c[w] - self.d) / self.n
        rare = [c for x, c in self.c.items() if x not in self.own]
        return (sum(rare) + self.d * len(self.own)) / self.n / (len(rare) + 1)

    def score(self, text):
        t = (text or "").lower().split() + [None]
        return sum(math.log10(self.p(tuple(t[max(0, i - self.depth) : i]), w)) for i, w in enumerate(t))


def lm(spark, train, texts, **kw):
    docs = frame(spark, train).withColumn("learn", F.lit(True)).unionByName(frame(spark, texts, 10_000).withColumn("learn", F.lit(False)))
    out, n = suffixtree.score(docs, **kw)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(train) + len(texts)
    return [rows[i] for i in range(len(train))], [rows[10_000 + i] for i in range(len(texts))], n


def prose(rnd, n):
    words = ["w%d" % i for i in range(60)]
    phrase = "it was the best of times it was the worst of times".split()
    texts = [" ".join(rnd.choices(words, [60 / (i + 1) for i in range(60)], k=rnd.randrange(1, 40))) for _ in range(n)]
    return [t + " " + " ".join(phrase[: rnd.randrange(3, 13)]) if rnd.random() < 0.4 else t for t in texts]


@pytest.mark.parametrize(("bucket", "slice_tokens", "depth"), [(10**9, 10**6, 5), (40, 30, 5), (15, 10**6, 3), (40, 30, 1)])
def test_scores_equal_a_brute_force_tree(spark, monkeypatch, bucket, slice_tokens, depth):
    monkeypatch.setattr(suffixtree, "SLICE", slice_tokens)
    rnd = random.Random(6)
    train = [*prose(rnd, 80), "", None, "a b c d e f g h i j", "a b c d e f g h i j", "Only once here"]
    texts = [*prose(rnd, 15), "", None, "a b c d e f g h zebra j", "zebra yak", "it was the best of times", "w1 " * 500]
    seen, new, n = lm(spark, train, texts, bucket=bucket, max_context=depth)
    tree = BruteTree(train, depth)
    assert n == tree.n and any(len(s) == min(depth, 4) for s in tree.states)
    for t, r in zip([*train, *texts], [*seen, *new], strict=True):
        w = [*(t or "").lower().split(), None]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(x in tree.c for x in w))
        assert math.isclose(r["base_score"], sum(math.log10((tree.c[x] + 1) / (n + tree.v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], tree.score(t), rel_tol=1e-9, abs_tol=1e-5), t


def test_distributions_sum_to_one():
    tree = BruteTree(prose(random.Random(2), 60), 4)
    for s in [(), *random.Random(1).sample(sorted(tree.states), 12)]:
        assert math.isclose(sum(tree.p(s, w) for w in [*tree.c, "unknown"]), 1)


def test_hot_contexts_are_dealt_to_many_buckets(spark):
    rnd = random.Random(3)
    train = prose(rnd, 300)
    docs = frame(spark, train).withColumn("learn", F.lit(True))
    c = Counter(w for t in train for w in t.split())
    hashes, counts = suffixtree.word_hashes(__import__("pyarrow").array(list(c))), np.array(list(c.values()))
    root = suffixtree.Root(hashes[0], counts, sum(c.values()) + 300, 300, len(c) + 1, 0, 0)
    hot = suffixtree.hot_contexts(docs, spark.sparkContext.broadcast(root), 5, 40)
    assert len(hot) > 3 and max(hot.spread) > 3 and max(hot.keys) > 1
    bucket = hot.deal(suffixtree.Tokens(root, __import__("pyarrow").array(train), 5))
    assert np.bincount(bucket, minlength=40).max() < 4 * len(bucket) / 40


def test_lm_without_training_texts(spark):
    _, rows, n = lm(spark, [], ["a b", ""])
    assert [r["score"] for r in rows] == [0, 0] and n == 0
    out, _ = suffixtree.score(frame(spark, []).withColumn("learn", F.lit(True)))
    assert out.count() == 0


def test_a_text_that_occurs_twice_stands_out(spark):
    rnd = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    train = [" ".join(rnd.choices(words, k=60)) for _ in range(100)]
    seen, _, _ = lm(spark, [*train, train[5]], [])
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in seen]
    assert min(gain[5], gain[100]) > max(gain[:5] + gain[6:100])


def best_score(chunk, table):
    """Viterbi by brute force over all cuts: the best sum, and the ids of the path that starts its last piece first."""
    n = len(chunk)
    best = [(0.0, [])] + [None] * n
    for e in range(1, n + 1):
        for s in range(max(0, e - table.longest), e):
            p = chunk[s:e]
            if p in table.normal:
                i, w = table.normal[p]
                ids = [i]
            elif e - s == 1:
                w, ids = table.unknown_score, [table.byte_ids[b] for b in p.encode()]
            else:
                continue
            if best[e] is None or best[s][0] + w > best[e][0]:
                best[e] = (best[s][0] + w, best[s][1] + ids)
    return best[n][1]


def test_lattice_equals_brute_force_and_decodes(spark):
    small = {p: (300 + i, -float(len(p) % 3 + i % 4)) for i, p in enumerate(["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "▁▁"])}
    table = pieces.Pieces(small, list(range(256)))
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abc  \nxé😀", k=rnd.randrange(40))) for _ in range(40)] + ["", None, "abc" * 400, "abc abc", "abc abc"]
    coded = pieces.encode(frame(spark, texts), table)
    rows = {r["doc_id"]: r for r in pieces.decode(coded, table).collect()}
    for i, t in enumerate(texts):
        whole = best_score("▁" + t.replace(" ", "▁"), table) if t else []
        assert rows[i]["ids"] == whole == [x for c in pieces.chunks(t, table) for x in best_score(c, table)], t
        assert rows[i]["text"] == (t or "")
    assert pieces.encode(frame(spark, []), table).count() == 0


def test_long_chunks_and_the_public_table(spark):
    table = pieces.piece_table(pieces.MODEL)
    rnd = random.Random(5)
    texts = ["a" * 5_000, "".join(rnd.choices("abcdefghij", k=3_000)), "the quick brown fox " * 30, "x" * 64, "y" * 65, "z" * 129, "Zürich 10:30  €5 \n\tend ", "0123456789" * 40]
    rows = {r["doc_id"]: r for r in pieces.decode(pieces.encode(frame(spark, texts), table), table).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == best_score("▁" + t.replace(" ", "▁"), table) and rows[i]["text"] == t


def test_pieces_do_not_depend_on_the_cache_or_batches(spark, monkeypatch):
    table = pieces.piece_table(pieces.MODEL)
    texts = ["one two three one", "three four", None, "", "two two 5"] * 3
    monkeypatch.setattr(pieces, "BATCH", 4)
    got = [sorted((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in pieces.encode(frame(spark, texts), table, most=m).collect()) for m in (0, 3, 300)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 15


def edited(texts, i):
    t, after = texts[i] or "", texts[i - 1] or ""
    h = len(t) // 2
    return t[: len(t) - h] + after[:h]


def hashed(spark, rows):
    """Spark's hashes of lists of numbers or words, as signed integers."""
    kind = "array<bigint>" if rows and rows[0] and isinstance(rows[0][0], int) else "array<string>"
    return [tuple(r["h"]) for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, x {kind}").select("i", F.transform("x", lambda t: F.xxhash64(t)).alias("h")).orderBy("i").collect()]


def test_fingerprints_equal_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    words = ["w%d" % i for i in range(4000)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([20, 200]))) for _ in range(60)]
    texts += [texts[3], "", None, texts[3][:-9] + "zzz", "one", "long " * 30_000, "Both halves  of\ttHIS", "UNIQUE once"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in imatch.query(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    words_of = lambda t: sorted({w.lower() for w in (t or "").split()})
    df = Counter(w for t in texts if t is not None for w in words_of(t))
    n = sum(t is not None for t in texts)
    in_band = {w for w, c in df.items() if max(2, n * math.exp(-8)) <= c <= max(2, n * math.exp(-3))}
    both = [t or "" for t in texts] + [edited(texts, i) for i in range(len(texts))]
    every = hashed(spark, [words_of(t) for t in both])
    kept = hashed(spark, [[w for w in words_of(t) if w in in_band] for t in both])
    asked, wanted = [], []
    for i, (a, k) in enumerate(zip(every, kept, strict=True)):
        v = max(0, math.floor(math.log2(len(k)))) if k else 0
        for level in sorted({0, v, v + 1}) if k else []:
            asked += [(i, level, t) for t in sorted(k)]
        wanted.append((a, k))
    placed = spark.createDataFrame(asked, "i int, v int, t long").select("i", "v", "t", F.pmod(F.xxhash64("t", "v"), F.pow(F.lit(2.0), "v").cast("bigint")).alias("p")).collect()
    parts = {}
    for r in sorted(placed):
        if r["p"] < imatch.PARTS:
            parts.setdefault((r["i"], r["v"], r["p"]), []).append(r["t"])
    # The hash of a part: its sorted terms, one after the other.
    chain = {k: (None, t) for k, t in parts.items()}
    for depth in range(max(map(len, parts.values()))):
        live = [k for k, (_, t) in chain.items() if len(t) > depth]
        sums = spark.createDataFrame([(*k, chain[k][0], chain[k][1][depth]) for k in live], "i int, v int, p long, h long, t long")
        for r in sums.select("i", "v", "p", F.when(F.col("h").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("h", "t")).alias("h")).collect():
            chain[r["i"], r["v"], r["p"]] = (r["h"], chain[r["i"], r["v"], r["p"]][1])
    six = lambda h: ("000000" + f"{h % 2**64:X}")[-6:]
    whole = {r["i"]: r["h"] for r in spark.createDataFrame([(i, sorted(a)) for i, (a, _) in enumerate(wanted)], "i int, x array<long>").select("i", F.xxhash64("x").alias("h")).collect()}

    def brute(i):
        a, k = wanted[i]
        if not k:
            return f"00:00{six(whole[i])}" if a else ""
        by = {}
        for (j, v, p), (h, _) in sorted(chain.items()):
            if j == i:
                by.setdefault(v, []).append(f"{p:02d}{six(h)}")
        v = math.floor(math.log2(len(k)))
        return " ".join(f"{x:02d}:" + ".".join(by.get(x, [])) for x in sorted({0, v, v + 1}))

    def like(a, b):
        if a == b:
            return 1.0
        la, lb = ({x[:2]: set(x[3:].split(".")) for x in s.split(" ") if x} for s in (a, b))
        return max((len(la[v] & lb[v]) / len({c[:2] for c in la[v] | lb[v]}) for v in la if v in lb), default=0.0)

    import hashlib

    prints = [brute(i) for i in range(len(both))]
    for i, r in rows.items():
        assert r["edited_sha256"] == hashlib.sha256(both[len(texts) + i].encode()).hexdigest() and r["n_chars"] == len(both[i])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[i], prints[len(texts) + i]), i
        assert math.isclose(r["near_edited"], like(prints[i], prints[len(texts) + i]))
        assert math.isclose(r["near_next"], like(prints[i], prints[i - 1]))
    half = [rows[i]["near_edited"] for i in range(1, 60)]
    assert np.mean(half) > 0.1 > np.mean([rows[i]["near_next"] for i in range(1, 60)])


@pytest.mark.parametrize("slice_rows", [1, 3, 1000])
def test_the_next_document_in_any_slices(spark, slice_rows):
    rows = [(i, f"t{i}") for i in [5, 3, 9, -4, 2**62, 7, 1]] + [(3, "b"), (3, "a"), (3, "a"), (None, "x"), (None, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = [(d, t or "", order[(i + 1) % len(order)][1] or "") for i, (d, t) in enumerate(order)]
    got = imatch.in_order(spark.createDataFrame(rows, "doc_id long, text string"), slice_rows).where("not extra").collect()
    assert sorted((str(r["doc_id"]), r["text"], r["following"]) for r in got) == sorted((str(d), *x) for d, *x in want)
    one = imatch.in_order(spark.createDataFrame([(1, "alone")], "doc_id long, text string"), slice_rows).where("not extra").collect()
    assert [r["following"] for r in one] == ["alone"]


def test_no_documents(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert imatch.query(spark, str(tmp_path)).count() == 0
