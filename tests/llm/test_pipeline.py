"""The pipeline on a small corpus with planted cases, each stage judged on its own input."""

import random

import corpus_pipeline
from tests.llm.test_operators import plain_hits, plain_similar, prose


def test_stages(spark, tmp_path):
    r = random.Random(20)
    base = prose(21, 500, 3000)
    for i in range(0, 500, 4):
        words = base[i].split()
        for _ in range(4):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scumbag"]))
        base[i] = " ".join(words)
    texts = [*base, *base[1:8], base[9] + " password: hunter22", base[11] + " " + base[11], None, "", None]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(base[30].split()[3:15])), (2, " ".join(base[33].split()[:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x["doc_id"]: x["text"] for x in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(seen[name]) == docs.count()
    clean = seen["toxicity"]
    toxic = [i for i in range(500) if i % 4 == 0]
    assert sum(i not in clean for i in toxic) > 0.9 * len(toxic) and sum(i in clean for i in range(500) if i % 4) > 0.97 * 375
    ids = sorted(clean)
    names = plain_similar([clean[i] for i in ids])
    assert seen["near_duplicates"] == {i: clean[i] for at, i in enumerate(ids) if names[at] == at}
    assert seen["decontamination"] == {i: t for i, t in seen["near_duplicates"].items() if not plain_hits(t, items)[1]}
    assert set(seen["secrets"]) == set(seen["decontamination"]) and not any("hunter22" in (t or "") for t in seen["secrets"].values())
    assert {x["doc_id"] for x in seen["packing"]} == set(seen["secrets"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, extra columns with names the stages use themselves."""
    rows = [(1, "alpha beta gamma delta", None, None, None), (1, "alpha beta gamma delta", None, None, None), (2, "alpha beta gamma delta", "en", "s", 22), (None, "alpha beta gamma delta", "en", "s", 22), (None, None, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "token = abcdef123", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("fp", "score", "contamination", "secrets", "item_id", "toxic", "rank", "part"):
        docs = docs.withColumn(c, docs.text)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "never here at all"), (7, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == 8
    kept = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    # 3 and 4 have no words and fingerprint 0, and are one group
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 3, 5]
    assert stages["decontamination"](spark, docs, str(tmp_path)).count() == 8
    masked = {r["doc_id"]: r for r in stages["secrets"](spark, docs, str(tmp_path)).collect()}
    assert masked[5]["text"] == "<secret>" and masked[5]["n_chars"] == 8 and masked[5]["secrets"] == "token = abcdef123"
    assert stages["packing"](spark, docs, str(tmp_path)).count() == 8
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
