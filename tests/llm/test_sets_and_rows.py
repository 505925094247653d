import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeingraph.llm import jaccard, packing, pii, topk

DOCS = "doc_id long, text string, source string, extra string"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["s"] * len(texts))[i], "x") for i, t in enumerate(texts)], DOCS)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for a, b in {(a, b) for group in by.values() for a in group for b in group if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def near_texts():
    rnd = random.Random(7)
    word = lambda: f"v{rnd.randrange(3000)}"
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rnd.choice([3, 8, 60, 200]))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(rnd.randrange(6)):
            c = list(b)
            for _ in range(rnd.randrange(1, 4)):
                c[rnd.randrange(len(c))] = word()
            texts.append("  ".join(c) if rnd.random() < 0.5 else "\n".join(c).upper())
    # Documents that share most of a passage, near the threshold.
    texts += [" ".join(passage + [word() for _ in range(k % 30)]) for k in range(60)]
    texts += ["", None, " \t\n", "one", "One ONE", "a b c d", "a b c d", texts[0], "x " * 20_000]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent", [75])
def test_components_equal_brute_force(spark, percent):
    texts = near_texts()
    want = components({i: shingle_set(t) for i, t in enumerate(texts)})
    rows = {r["doc_id"]: r for r in jaccard.near_copies(frame(spark, texts), percent=percent).collect()}
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert {i: r["n_shingles"] for i, r in rows.items()} == {i: len(shingle_set(t)) for i, t in enumerate(texts)}
    kept = jaccard.drop_near_copies(frame(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_no_documents_and_repeated_ids(spark):
    assert jaccard.near_copies(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i"), (1, "g h i"), (2, "a b c d e f"), (None, "g h i")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.near_copies(rows).collect()) == [1, 2]


@pytest.mark.parametrize("one_task", [0, 30, 10_000])
def test_connected_components(spark, one_task):
    rnd = random.Random(9)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["id"]: r["component"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert all(got[a] == got[b] for a, b in edges if a != b)
    assert all(got[i] == 300 for i in range(300, 341)) and all(c <= i for i, c in got.items())


def test_exact_top_k(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 6)).astype("float32")
    x[50:90] = x[7]
    rows = [(i, [float(v) for v in r], "z") for i, r in enumerate(x)]
    rows += [(400, None, "z"), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], "z"), (402, [float("nan")] * 6, "z"), (403, [float("inf")] * 6, "z"), (None, [1.0] * 6, "z"), (450, [1.0, 2.0], "z"), (3, rows[3][1], "z")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")
    got = defaultdict(list)
    for r in topk.top_k(topk.quantized(v), F.col("vec_id") % 50 == 0, 5, shard_rows=90, block=3).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(256 * x.astype("float64")).astype(int)
    for i in range(0, 400, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert 450 not in got
    assert topk.top_k(topk.quantized(v.limit(0)), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_shards_that_cannot_help_are_not_asked(spark):
    """Clustered vectors: the second round reaches few shards, and equal vectors are dealt to several."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 400
    x = np.concatenate([np.rint(centres[i % 40] + rng.normal(size=8) * 5) .reshape(1, -1) for i in range(1500)] + [np.full((500, 8), 7.0)]).astype(int)
    rows = topk.written(spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "vec_id long, x array<long>"), "t")
    dealt = topk.written(topk._dealt(rows, 100), "t")
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 300 and len(sizes) >= 20
    got = defaultdict(list)
    for r in topk.top_k(rows, F.col("vec_id") % 50 == 0, 5, shard_rows=100, block=7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 2000, 50):
        best = sorted((-int(x[i] @ x[j]), j) for j in range(2000) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


TEXT = "Call +1 (212) 555-0188 or mail jo.e+7@mail.example.org, pay 4111 1111 1111 1111 not 4111 1111 1111 1112; from 10.0.255.1 on 2021-02-28 (28/02/2021, 28.02.2021), not 2021-02-30 or 999.1.1.1. password=66213754e9ea22e86d"


def test_pseudonyms_keep_format_and_come_back(spark):
    texts = [TEXT, "again jo.e+7@mail.example.org 4111111111111111", "nothing here", "", None, "9" * 40_000 + " a@" + "b" * 40_000, TEXT]
    docs = frame(spark, texts)
    hidden = pii.pseudonymize(docs, "key", count="n")
    rows = {r["doc_id"]: r for r in hidden.collect()}
    out = rows[0]["text"]
    for secret in ("555-0188", "jo.e+7@mail", "4111 1111 1111 1111", "10.0.255.1", "2021-02-28", "28/02/2021", "66213754e9ea22e86d"):
        assert secret not in out
    for kept in ("4111 1111 1111 1112", "2021-02-30", "999.1.1.1", "Call +1 ("):
        assert kept in out
    card = re.search(r"pay ((?:\d{4} ){3}\d{4}) not", out)[1].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    y, m, d = re.search(r"on (\d{4})-(\d\d)-(\d\d)", out).groups()
    assert f"({d}/{m}/{y}, {d}.{m}.{y})" in out
    assert card in rows[1]["text"] and re.search(r"mail (\S+@\S+),", out)[1] in rows[1]["text"]
    assert [rows[i]["text"] for i in (2, 3, 4)] == texts[2:5] and [rows[i]["n"] for i in (2, 3, 4)] == [0, 0, 0]
    assert rows[6]["text"] == out and hidden.columns == [*docs.columns, "n"]
    back = {r["doc_id"]: r["text"] for r in pii.reveal(hidden, "key").collect()}
    assert back == dict(enumerate(texts))
    assert pii.pseudonymize(docs, "other").where("doc_id = 0").head()["text"] != out


def test_adjacent_cards_and_capital_secrets(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "3782 822463 10005"]
    texts = [
        "7536784127813050 4845168114407329", "4111111111111111 12", "12 4111 1111 1111 1111", "4111-1111-1111-1111 123", "pay 4111111111111111-4111111111111111 3782 822463 10005.",
        "4111111111111111 10.0.255.1", "4111111111111111 2021-02-28", "4111111111111111 555-123-4567", "4111111111111111 7a@b.org", "4111111111111111 3rd",
        'TOKEN = "9233A8ECF7C5D01B"', 'Secret: 9233a8ECF7c5d01b TOKEN="9233A8ECF7C5D01B"', "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17", "4111111111111112 12",
    ]
    docs = frame(spark, texts)
    hidden = pii.pseudonymize(docs, "key", count="n")
    rows = [r for r in hidden.orderBy("doc_id").collect()]
    for t, r in zip(texts, rows, strict=True):
        shape = [re.sub("[a-f]", "x", re.sub("[A-F]", "X", re.sub("[0-9]", "0", u))) for u in (t, r["text"])]
        assert shape[0] == shape[1] or "@" in t or "10.0.255.1" in t
        for secret in (*cards, "7536784127813050", "4845168114407329", "4111-1111", "10.0.255.1", "2021-02-28", "555-123-4567", "7a@b", "9233A8ECF7C5D01B", "9233a8ECF7c5d01b"):
            assert secret not in r["text"]
    assert [r["n"] for r in rows] == [2, 1, 1, 1, 3, 2, 2, 2, 2, 1, 1, 2, 0, 0]
    assert [rows[i]["text"] for i in (12, 13)] == texts[12:]
    assert rows[1]["text"].split()[0] == rows[9]["text"].split()[0] == rows[6]["text"].split()[0]
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{16}"', rows[10]["text"]) and rows[11]["text"].endswith(rows[10]["text"].replace(" ", "")[5:])
    assert [r["text"] for r in pii.reveal(hidden, "key").orderBy("doc_id").collect()] == texts


def test_packing_invariants(spark):
    rnd = random.Random(5)
    texts = [" ".join("w%d" % rnd.randrange(99) for _ in range(rnd.randrange(120))) for _ in range(150)] + ["same text"] * 30 + ["", None, "big " * 1000]
    sources = [rnd.choice(["hot", "hot", "a", "b", None]) for _ in texts]
    rows = packing.pack_documents(frame(spark, texts, sources), capacity=100, shard_rows=60).collect()
    bins, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r["bin_id"]].append(r)
        assert r["start"] == covered[r["doc_id"]] or r["piece"] > 0
        covered[r["doc_id"]] += r["length"]
    assert {d: n for d, n in covered.items()} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    for items in bins.values():
        spans = sorted((r["offset"], r["offset"] + r["length"]) for r in items)
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        owners = defaultdict(set)
        for r in items:
            owners[texts[r["doc_id"]] or ""].add(r["doc_id"])
        assert all(len(o) == 1 for o in owners.values())
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_near_copies_of_repeated_ids_are_dropped_row_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " end"), (2, b), (3, c), (3, b + " end"), (4, c), (None, a), (None, a)]
    docs = spark.createDataFrame([(d, t, "s", "x") for d, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.drop_near_copies(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (None, a), (None, a)], key=str)


def test_near_copies_do_not_share_a_bin(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    texts = [words + f" end{i}" for i in range(12)] + ["", "", None] + [f"other{i} text" for i in range(10)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.query(spark, str(tmp_path)).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r["doc_id"])
    assert sorted(x for b in bins.values() for x in b) == list(range(len(texts)))
    assert all(sum(d < 12 for d in b) <= 1 and sum(12 <= d < 15 for d in b) <= 1 for b in bins.values())


def test_packing_takes_the_tightest_compatible_bin():
    rnd = random.Random(6)
    items = [(rnd.randrange(1, 50), g, rnd.randrange(12), rnd.randrange(3)) for g in range(80)]
    quota = {0: 2, 1: 1, 2: 3}
    got = packing.pack(items, 100, quota)
    bins = []
    for i in sorted(range(80), key=lambda i: (-items[i][0], i)):
        size, _, cluster, source = items[i]
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and cluster not in b["clusters"] and b["sources"].count(source) < quota[source]]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"room": 100, "clusters": set(), "sources": []})
        assert got[i] == (k, 100 - bins[k]["room"])
        bins[k]["room"] -= size
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"].append(source)


def test_pseudonyms_keep_columns_of_any_name(spark):
    docs = frame(spark, ["mail a@b.example.org", None]).withColumn("_found", F.lit("mine")).withColumn("_FOUND_", F.lit(1)).withColumn("n", F.lit("old"))
    out = pii.pseudonymize(docs, "key", count="n")
    assert out.columns == docs.columns and {(r["_found"], r["_FOUND_"]) for r in out.collect()} == {("mine", 1)}
    assert [r["n"] for r in out.orderBy("doc_id").collect()] == [1, 0]


def python_feistel(a, b, n_a, n_b, key, domain):
    import hashlib

    number = lambda x, r: int(hashlib.sha256(f"{key}|{r}|{domain}|{x}".encode()).hexdigest()[:15], 16)
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + number(b, r) % n_a) % n_a
        else:
            b = (b + number(a, r) % n_b) % n_b
    return a, b


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_pseudonyms_equal_an_independent_feistel(spark):
    """Numbers whose permutation is written out in Python: addresses, dates in five formats, social security numbers."""
    import datetime

    texts = ["at 10.0.255.1.", "on 2021-02-28", "on 2021/02/28", "on 28/02/2021", "on 28.02.2021", "on 28-02-2021", "no 123-45-6789 x", "no 899-99-9999 x", "no 001-01-0001 x", "no 667-01-0001 x"]
    out = [r["text"] for r in pii.pseudonymize(frame(spark, texts), "key").orderBy("doc_id").collect()]
    hi, lo = python_feistel(10 * 256, 255 * 256 + 1, 65536, 65536, "key", "ip")
    assert out[0] == f"at {hi >> 8}.{hi % 256}.{lo >> 8}.{lo % 256}."
    day = (datetime.date(2021, 2, 28) - datetime.date(1700, 1, 1)).days
    a, b = python_feistel(day // 5411, day % 5411, 27, 5411, "key", "date")
    d = datetime.date(1700, 1, 1) + datetime.timedelta(a * 5411 + b)
    assert out[1:6] == [d.strftime(f"on {f}") for f in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y", "%d-%m-%Y")]
    for text, got in zip(texts[6:], out[6:], strict=True):
        x, y, z = map(int, text.split()[1].split("-"))
        a, b = python_feistel(x - 1 - (x > 666), (y - 1) * 9999 + z - 1, 898, 99 * 9999, "key", "ssn")
        assert got == f"no {a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d} x" and re.search(pii.SSN, got)
    assert [r["text"] for r in pii.reveal(spark.createDataFrame([(t,) for t in out], "text string"), "key").collect()] == texts


def test_ibans_and_capitals(spark):
    texts = ["DE89370400440532013000", "pay DE89 3704 0044 0532 0130 00 now", "GB29NWBK60161331926819", "DE00370400440532013000", "000-12-3456 666-12-3456 123-00-4567", "Jo.E+7@Mail.example.org JO.E+7@MAIL.example.org jo.e+7@mail.example.org", "Password: 66213754e9ea22e86d", "sk-abcDEF0123456789abcDEF_xyz"]
    out = [r["text"] for r in pii.pseudonymize(frame(spark, texts), "key").orderBy("doc_id").collect()]
    compact, spaced = out[0], out[1].removeprefix("pay ").removesuffix(" now")
    assert compact != texts[0] and mod97(compact) == mod97(out[2]) == 1 and spaced.replace(" ", "") == compact and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", out[2])
    assert out[3:5] == texts[3:5]
    a, b, c = out[5].split(" ")
    assert a.lower() == b.lower() == c and a != b and a[0].isupper() and c not in texts[5]
    assert "66213754" not in out[6] and out[7].startswith("sk-") and out[7] != texts[7]
    assert [r["text"] for r in pii.reveal(spark.createDataFrame([(t,) for t in out], "text string"), "key").collect()] == texts
