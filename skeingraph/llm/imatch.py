"""I-Match fingerprints with DataFrame functions alone.

A document's terms are its distinct words (A-Z lowered). The lexicon keeps the terms
whose inverse document frequency ln(N / df) lies in a band. As the band's upper end is
fixed, a lexicon term occurs in at least N * exp(-idf_max) documents, so the lexicon has at
most (mean distinct terms of a document) * exp(idf_max) terms whatever N is. That
bound is computed first, and the lexicon is broadcast only below a limit; beyond it, it is joined by shuffle.

A fingerprint hashes the sorted distinct lexicon terms of a document, and of several randomised subsets
of the lexicon. At level v a random partition deals the lexicon to 2**v parts; the first PARTS are the level's
subsets, and level 0 is the whole lexicon. A document gives level 0 and the two levels at which a subset holds
`size` of its n lexicon terms and half as many, on average (`size` to 2 * size, as levels are powers of two). A subset that holds a term of
it gives level, part and hash. Likeness is the share of equal hashes among the subsets that either document
fills at a level of both, the best of these levels. A document with no term in the band has level 0 alone, over all its terms.

Subsets of many terms agree only for texts with few changes, small ones for texts that share a part: README gives the measured curve.

Defined results: null text counts as empty, whose fingerprint is ''; equal texts have equal fingerprints and likeness 1. The documents' order is descending doc_id, then text; a null doc_id
comes last; rows that repeat a doc_id are documents of their own, also where they repeat the text; a single document is its own next one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeingraph.llm.common import lower_ascii, table, written

IDF_MIN, IDF_MAX = 3.0, 8.0
PARTS, SIZE = 64, 1
#: Rows of a lexicon that is broadcast, at most.
BROADCAST_ROWS = 4_000_000
#: Documents of a slice of the order, about, and slices, at most.
SLICE_ROWS, SLICES = 250, 10_000


def terms(text: Column) -> Column:
    """Distinct hashes of the words of a text."""
    words = F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, idf_min: float = IDF_MIN, idf_max: float = IDF_MAX) -> tuple[DataFrame, int]:
    """Terms of the band (term), over all documents, and the proven bound on their number."""
    df = written(texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "imatch-df")
    n = texts.count()
    least, most = max(2.0, n * math.exp(-idf_max)), max(2.0, n * math.exp(-idf_min))
    total = df.agg(F.sum("df")).first()[0] or 0
    return df.where(F.col("df").between(least, most)).select("term"), int(total / least) + 1


def _code(part: Column, hashed: Column) -> Column:
    """Two digits of the part, six of the hash."""
    return F.concat(F.lpad(part.cast("string"), 2, "0"), F.right(F.concat(F.lit("000000"), F.hex(hashed)), F.lit(6)))


def fingerprint(found: Column, whole: Column, size: int = SIZE) -> Column:
    """The fingerprint of a text from its lexicon terms (an array of distinct hashes) and a hash of all its terms, null without any."""

    def level(of, v):
        parts = F.pow(F.lit(2.0), v).cast("bigint")
        placed = F.transform(of, lambda t: F.struct(F.pmod(F.xxhash64(t, v), parts).cast("int").alias("p"), t.alias("t")))
        ordered = F.sort_array(F.filter(placed, lambda x: x["p"] < PARTS))
        # A run of one part's terms in their order becomes one hash.
        close = lambda a: F.when(a["p"] < 0, a["codes"]).otherwise(F.array_append(a["codes"], _code(a["p"], a["h"])))
        start = F.struct(F.array().cast("array<string>").alias("codes"), F.lit(-1).alias("p"), F.lit(0).cast("bigint").alias("h"))
        step = lambda a, x: F.when(a["p"] == x["p"], F.struct(a["codes"].alias("codes"), a["p"].alias("p"), F.xxhash64(a["h"], x["t"]).alias("h"))).otherwise(F.struct(close(a).alias("codes"), x["p"].alias("p"), F.xxhash64(x["t"]).alias("h")))
        codes = F.aggregate(ordered, start, step, close)
        return F.concat(F.lpad(v.cast("string"), 2, "0"), F.lit(":"), F.array_join(codes, "."))

    def of_terms(of):
        v = F.greatest(F.lit(0), F.floor(F.log2(F.size(of) / F.lit(float(size)))).cast("int"))
        return F.array_join(F.transform(F.array_distinct(F.array(F.lit(0), v, v + 1)), lambda x: level(of, x)), " ")

    # Terms are bound once, as the only element of an array.
    banded = F.get(F.transform(F.array(found), of_terms), F.lit(0))
    return F.when(F.size(found) > 0, banded).when(whole.isNotNull(), F.concat(F.lit("00:"), _code(F.lit(0), whole))).otherwise(F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints: the largest, over the levels of both, share of equal hashes among the parts that either fills."""
    levels = lambda c: F.filter(F.split(c, " "), lambda s: s != "")
    codes = lambda level: F.split(F.substring(level, 4, 2**30), r"\.")
    parts = lambda level: F.transform(codes(level), lambda s: F.substring(s, 1, 2))
    share = lambda p, q: F.when(F.substring(p, 1, 2) == F.substring(q, 1, 2), F.size(F.array_intersect(codes(p), codes(q))) / F.size(F.array_union(parts(p), parts(q))))
    best = F.array_max(F.flatten(F.transform(levels(a), lambda p: F.transform(levels(b), lambda q: share(p, q)))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))


def prints(rows: DataFrame, key: list[str], sides: dict[str, str], band: DataFrame, bound: int, size: int = SIZE) -> DataFrame:
    """`key` and a fingerprint column for each name of `sides` (name: text column); rows are distinct by key, and stay where they are if they are dealt by columns of it."""
    wholes = {s: F.when(F.size(c) > 0, F.xxhash64(F.sort_array(c))) for s, c in ((s, F.col(f"_{s}")) for s in sides)}
    rows = rows.select(*key, *[terms(F.col(c)).alias(f"_{s}") for s, c in sides.items()])
    rows = rows.select(*key, *[w.alias(f"{s}_whole") for s, w in wholes.items()], *[F.col(f"_{s}") for s in sides])
    held = [*key, *[f"{s}_whole" for s in sides]]

    def entries(i: int, column: str) -> Column:
        return F.transform(column, lambda t: F.struct(F.lit(i).alias("side"), t.alias("term")))

    exploded = rows.select(*held, F.explode_outer(F.concat(*[entries(i, f"_{s}") for i, s in enumerate(sides)])).alias("x")).select(*held, "x.side", "x.term")
    banded = exploded.join((F.broadcast(band) if bound <= BROADCAST_ROWS else band).withColumn("in_band", F.lit(True)), "term", "left")
    lists = [F.collect_list(F.when(F.col("in_band") & (F.col("side") == i), F.col("term"))).alias(f"_{s}") for i, s in enumerate(sides)]
    return banded.groupBy(*held).agg(*lists).select(*key, *[fingerprint(F.col(f"_{s}"), F.col(f"{s}_whole"), size).alias(s) for s in sides])


def _slice(bounds: list[int]) -> Column:
    """How many of the sorted bounds doc_id reaches, found in two steps; 0 for null."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    reached = lambda of: F.size(F.filter(of, lambda x: x <= F.col("doc_id")))
    long = lambda x: F.array(*[F.lit(y).cast("bigint") for y in x])
    coarse = reached(long([g[0] for g in groups]))
    fine = F.array(*[long(g) for g in groups])
    return F.when(F.col("doc_id").isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + reached(F.get(fine, coarse - 1)))


def in_order(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """slice, place, extra, doc_id, text, following: documents in descending doc_id, each with the next one's text, dealt by slice.

    Slices are ranges of doc_id; a slice ends with a copy (`extra`) of the first document of the next one, so
    each text moves once, and a copy for each slice besides. Bounds, one for a slice, are all that the driver sees."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark, n = docs.sparkSession, docs.count()
    slices = max(1, min(SLICES, n // slice_rows))
    at = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], 20 * slices)).first()[0] if slices > 1 else None
    docs = docs.withColumn("slice", _slice(sorted(set(at or []))))
    # Descending: nulls last, the bits of an id turned.
    place = [F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0)).cast("bigint")), F.col("text")]
    first = docs.groupBy("slice").agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(place)], "doc_id")).alias("m"))
    first = written(first, "imatch-first")
    present = sorted((r["slice"] for r in first.select("slice").collect()), reverse=True)
    before = dict(zip(present, [present[-1], *present], strict=False)) if present else {}
    to = F.broadcast(spark.createDataFrame(sorted(before.items()), "slice int, to int"))
    copies = first.join(to, "slice").select("m.doc_id", F.col("m.k2").alias("text"), F.col("to").alias("slice"), F.lit(True).alias("extra"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices // 16)
    dealt = docs.withColumn("extra", F.lit(False)).unionByName(copies).repartition(parts, "slice")
    order = Window.partitionBy("slice").orderBy("extra", *place)
    return dealt.select("slice", F.row_number().over(order).alias("place"), "extra", "doc_id", "text", F.lead("text").over(order).alias("following"))


def compare_with_next(docs: DataFrame, size: int = SIZE, idf_min: float = IDF_MIN, idf_max: float = IDF_MAX) -> DataFrame:
    """The query's rows: fingerprints of all texts and edited texts, and how like they are; docs: doc_id, text."""
    docs = docs.select("doc_id", "text")
    band, bound = lexicon(docs.where("text is not null"), idf_min, idf_max)
    band = written(band, "imatch-band")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # Of a copy, only the text's own fingerprint is asked.
    edited = F.when(~F.col("extra"), F.concat(F.substr("text", F.lit(1), n - half), F.substr("following", F.lit(1), half)))
    rows = in_order(docs).select("slice", "place", "extra", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited", F.coalesce("edited", F.lit("")))
    key = ["slice", "place", "extra", "doc_id", "n_chars", "edited_sha256"]
    found = prints(rows, key, {"fingerprint": "text", "edited_fingerprint": "edited"}, band, bound, size)
    following = F.lead("fingerprint").over(Window.partitionBy("slice").orderBy("place"))
    out = found.withColumn("following", following).where(~F.col("extra"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
