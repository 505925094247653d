import random

import corpus_pipeline
from tests.llm.test_sets_and_rows import components, shingle_set

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    rnd = random.Random(8)
    words = ["ba" + c + d for c in "aeiou" for d in "klmnprst"]
    texts = [". ".join(" ".join(rnd.choices(words, k=9)) for _ in range(5)) for _ in range(90)]
    toxic = set(range(0, 90, 3))
    texts = [t + ". Zorgish zorgs." if i in toxic else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[2] + " tail", "mail me@mail.example.com", "", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 3 or out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert set(seen[0]) == set(range(len(texts))) - toxic
    links = components({i: shingle_set(texts[i]) for i in seen[0]})
    assert set(seen[1]) == set(links.values()) and 90 not in seen[1]
    assert "me@mail" not in seen[2][92]["text"] and seen[2][92]["text"].startswith("mail ") and seen[2][1]["text"] == texts[1]
    assert set(seen[3]) == set(seen[2])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[3])


def test_stages_keep_odd_rows(spark, tmp_path):
    """Empty tables, repeated and missing ids, nulls and clashing columns."""
    names = COLUMNS + ", _toxicity string, _found string, _row long, _rank long, _component long"
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "h i j k l m n", "en", "s", 13), (1, "a b c d e f g", None, None, None), (2, "h i j k l m n", "en", None, 13), (None, "a b c d e f g", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "t", "f", 7, 8, 9) for r in rows], names)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for source in (docs, docs.limit(0)):
        left = source
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            left = stage(spark, left, str(tmp_path))
            if k < 3:
                assert left.columns == docs.columns, name
                left.write.mode("overwrite").parquet(f"{tmp_path}/{k}-{source is docs}")
                left = spark.read.parquet(f"{tmp_path}/{k}-{source is docs}")
                if k == 1 and source is docs:
                    got = sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect())
                    assert got == sorted([("1", "a b c d e f g"), ("1", "h i j k l m n"), ("None", "a b c d e f g"), ("3", ""), ("4", "")])
                    assert {(r["_toxicity"], r["_found"], r["_row"], r["_rank"], r["_component"]) for r in left.collect()} == {("t", "f", 7, 8, 9)}
        assert sorted(r["doc_id"] for r in left.collect()) == ([1, 1, 3, 4] if source is docs else [])
