"""Small fixtures for single operators."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.functions import profiles as P
from granary.functions import text as T
from granary.operators import build, chunking, evaluation, graph, retrieval, summary
from granary.sources import files
from granary.streaming.answers import ThoughtFilter, ingest


def hits(spark, *scores):
    return spark.createDataFrame([(1, i, float(s), i + 1) for i, s in enumerate(scores)], "query_id long, id long, score double, rank int")


@pytest.mark.parametrize(("scores", "least", "gap", "most", "n"), [((0.9, 0.2, 0.19), 1, 0.2, 30, 1), ((0.9, 0.2, 0.19), 2, 0.2, 30, 2), (tuple(1 - i / 100 for i in range(10)), 1, 0.5, 5, 5)])
def test_gap_filter(spark, scores, least, gap, most, n):
    assert retrieval.gap_filter(hits(spark, *scores), gap, least, most).count() == n


def test_min_score_counts_null_as_zero(spark):
    df = spark.createDataFrame([(1, 1, 0.01), (1, 2, None)], "query_id long, id long, score double")
    assert retrieval.min_score(df, 0.1).count() == 0


def test_rrf_adds_over_routes(spark):
    df = spark.createDataFrame([(1, r, 7, 1) for r in range(3)] + [(1, 0, 8, 2)], "query_id long, route int, id long, rank int")
    got = {r["id"]: r["score"] for r in retrieval.fused(df, 3).collect()}
    assert got[7] == pytest.approx(3 / 61, abs=1e-9) and got[8] == pytest.approx(1 / 62, abs=1e-9)


def test_redundant_summaries(spark):
    s = spark.createDataFrame([("a", ["c1", "c2"]), ("b", ["c1", "x", "y", "z"])], "summary_id string, child_ids array<string>")
    h = spark.createDataFrame([(1, "c1")], "query_id long, id string")
    assert [r["summary_id"] for r in retrieval.redundant(s, h).collect()] == ["a"]


def test_rerank_falls_back(spark):
    c = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2)], "query_id long, id long, rank int")
    s = spark.createDataFrame([(1, 11, 0.9), (1, 99, 1.0)], "query_id long, id long, s double")
    got = sorted((r["query_id"], r["id"], r["final_rank"]) for r in retrieval.rerank(c, s).collect())
    assert got == [(1, 11, 1), (2, 20, 1), (2, 21, 2)]


def test_vector_topk_is_exact(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieval.vector_topk(df, df.filter("id = 3").select(F.col("id").alias("query_id"), "v"), 5, -1e9).collect()
    want = sorted(((-(3 * (i % 7) + 3 * (i % 5)), i) for i in range(50)))[:5]
    assert [(r["score"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(-a, i) for a, i in want]
    assert retrieval.vector_topk(df, df.limit(0).select(F.col("id").alias("query_id"), "v")).count() == 0


@pytest.mark.parametrize("n", [80, 200, 400])
def test_chunks_cover_the_text(n):
    text = "".join(f"Sentence number {i} ends here. " for i in range(n))
    w = chunking.windows(text, 256, 25)
    assert w[0][0] == 0 and w[-1][1] == len(text)
    assert all(b[0] <= a[1] for a, b in zip(w, w[1:], strict=False)) and all(z - a <= 512 for a, z in w)


def test_chunk_edges():
    assert chunking.windows("") == [] and chunking.windows("x" * 10) == [(0, 10)]
    assert chunking.windows("x" * 1500) == [(0, 1499), (1499, 1500)]
    assert chunking.windows("x" * 5000) == [(0, 5000)]
    assert chunking.Boundaries("他说。”然后……走", "zh").right(0) == 4


def test_sections(spark):
    df = spark.createDataFrame([(1, "preface\n第一章 a\nbody\n第二章 b")], "doc_id long, text string")
    got = [(r["section"], r["body"]) for r in chunking.sections(df, P.SECTION_ZH).orderBy("pos").collect()]
    assert got == [("概述", "preface"), ("第一章 a", "body"), ("第二章 b", "")]


def test_numerals(spark):
    df = spark.createDataFrame([(s,) for s in ("十", "二十三", "一百零五", "两千", "x", "")], "s string")
    assert [r[0] for r in df.select(T.cn_numeral(F.col("s"))).collect()] == [10, 23, 105, 2000, 0, 0]


def test_questions(spark):
    df = spark.createDataFrame([("1. first one\n- second\nQ\nQuestion 3: third",)], "s string")
    assert df.select(T.sub_queries(F.col("s"))).first()[0] == ["first one", "second", "third"]
    q = spark.createDataFrame([("为什么",), ("为什么和如何",), ("a? b?",), ("plain",)], "s string")
    assert [r[0] for r in q.select(T.is_complex(F.col("s"), P.MULTI_PART_ZH)).collect()] == [False, True, True, False]


def test_summary_tree(spark):
    rows = [(i, f"c{i}", "f", "s1" if i < 3 else "s2", "" if i < 3 else "x", f"text {i}") for i in range(5)] + [(9, "c9", "g", "s", "", "alone")]
    t = {(r["level"], r["file"], r["section"]): r for r in summary.tree(spark.createDataFrame(rows, "chunk_idx long, node_id string, file string, section string, subsection string, text string")).collect() if r["level"] > 1}
    assert set(t) == {(2, "f", "s1"), (2, "f", "s2"), (3, "f", "s2"), (4, "f", "")}
    assert t[4, "f", ""]["child_ids"] == ["c0", "c1", "c2", "c3", "c4"] and (t[2, "f", "s1"]["chunk_lo"], t[2, "f", "s1"]["chunk_hi"]) == (0, 2)


def test_graph_rules(spark):
    r = spark.createDataFrame([(1, "甲某", "说", "乙某", 1), (1, "甲某", "认识了", "乙某", 2), (1, "甲某", "认识了", "乙某", 3), (1, "甲某", "认识了", "我", 4)], "chunk_id long, subject string, predicate string, object string, pos long")
    e = graph.valid_entities(spark.createDataFrame([(1, "甲某"), (1, "乙某"), (1, "我")], "chunk_id long, name string"))
    assert [x["pos"] for x in graph.valid_relations(r, e).collect()] == [2]
    m = spark.createDataFrame([("甲", "取得", "女子组冠军"), ("乙", "取得", "女子组冠军")], "subject string, predicate string, object string")
    assert [x["subject"] for x in graph.consistent(m, ["甲"]).collect()] == ["乙"]
    t = spark.createDataFrame([("人物",), ("历史人物",), ("",), ("别的",), (None,)], "raw string").select(graph.resolved_type(F.col("raw")))
    assert [x[0] for x in t.collect()] == ["Person", "Person", "Entity", "Entity", "Entity"]


def test_aliases(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r["name"]: r["canonical"] for r in graph.alias_of(names("abc", "abcde", "zz", "abcdefgh"), names("abc", "xabcx", "abcdef")).collect()}
    assert got == {"abc": "abc", "abcde": "abcdef", "zz": "zz", "abcdefgh": "abcdef"}


def test_metrics(spark):
    h = spark.createDataFrame([(1, 1, 9), (1, 2, 5)], "query_id long, rank int, id long")
    g = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "query_id long, id long")
    got = {r["query_id"]: (r["recall_3"], r["first_hit"], r["rr"]) for r in evaluation.recall(h, g).collect()}
    assert got == {1: (0.5, 2, 0.5), 2: (0.0, None, 0.0)}


def test_costs(spark):
    calls = spark.createDataFrame([("m", "chat", 100, 10, 40, 1.0), ("m", "chat", None, 5, 0, 1.0), ("u", "chat", 1, 1, 0, 0.5)], "model string, kind string, prompt long, completion long, cached long, elapsed double")
    used = evaluation.usage(calls)
    m = used.filter("model = 'm'").first()
    assert (m["calls"], m["prompt"], m["completion"], m["unmetered"]) == (2, 100, 10, 1)
    prices = spark.createDataFrame([("m", 2.0, 8.0, None)], "model string, price_in double, price_out double, price_cached double")
    costed = evaluation.costs(used, prices)
    assert costed.filter("model = 'u'").first()["cost"] is None and evaluation.total_cost(costed).first()[0] is None


def test_stages():
    assert build.dirty(dict.fromkeys(build.STAGES, True) | {"chunks": False}) == {"chunks", "summary_tree", "bm25", "vector"}
    assert build.dirty({}, {"graph": False}) == {"chunks", "summary_tree", "bm25", "vector"} and build.downstream("summary_tree") == ["summary_tree", "bm25", "vector"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_thoughts_in_pieces(spark, size):
    text = "a <b> <think>x </thin y</think>  c <thinking>z</thinking>d <think>open"
    f = ThoughtFilter()
    got = "".join(f.feed(text[i : i + size]) for i in range(0, len(text), size)) + f.finish()
    assert got == "a <b> c d "


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "b.md").write_text("skipped")
    assert [tuple(r) for r in files.raw_texts(spark, str(tmp_path)).collect()] == [("a.txt", "one\ntwo")]
    raw = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>He</w:t><w:t>y</w:t></w:r></w:p><w:p><w:r><w:t>you</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "c.docx").write_bytes(raw.getvalue())
    assert [tuple(r) for r in files.docx_texts(spark, str(tmp_path)).collect()] == [("c.docx", "Hey\nyou")]
    (tmp_path / "qa.jsonl").write_text('{"id": "1", "type": "fact"}\n\n{"id": "2"}\n')
    assert files.qa(spark, str(tmp_path / "qa.jsonl")).count() == 2
    with pytest.raises(RuntimeError):
        files.read_stage(spark, str(tmp_path / "none"))
    files.write_stage(spark.range(3), str(tmp_path / "stage"))
    assert files.read_stage(spark, str(tmp_path / "stage")).count() == 3


def test_ingest_takes_each_file_once(spark, tmp_path):
    seen = []
    for n in (2, 3):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), "id long", lambda df, _: seen.append(df.count()), str(tmp_path / "mark")).awaitTermination()
    assert seen == [2, 3]


def test_answers(spark):
    from granary.functions import answers as A

    one = lambda value, f, kind="string": spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()["x"]
    for said, want in ((" 是", True), ("：“是的", True), ("不是", False), ("否", False), ("YES.", True), ("maybe 是", False), ("", False), (None, False)):
        assert one(said, A.says_yes) is want, said
    assert one("[1] a\n b [3] c [1] d", lambda c: A.numbered(c, 3)) == ["d", "", "c"]
    assert one(None, lambda c: A.numbered(c, 2)) == ["", ""]
    assert one(["0", " 2 ", "x", "2", None, "1.5"], A.index_set, "array<string>") == [0, 2]
    assert [one(v, A.clamped) for v in ("4.5", "3.5", "9", "-1", "good", None)] == [4, 4, 5, 1, 1, 1]
    for said, want in ((" True", ("bool", "true")), ("null", ("null", None)), ("+1_0", ("int", "10")), ("1e3", ("float", "1e3")), ("a b", ("str", "a b"))):
        assert tuple(one(said, A.scalar)) == want
    assert tuple(one(" K = 1", A.key_value)) == ("K", "int", "1") and one("K", A.key_value) is None and one("=1", A.key_value) is None
    assert [one(v, lambda c: A.switched_on(c, True)) for v in (None, " ", "On", "0", "2")] == [True, True, True, False, False]


def test_subsections(spark):
    from granary.operators import chunking

    rows = [(1, "head\n　　1\nfirst\n　　2\n\n第3节\nthird"), (2, "none"), (3, ""), (4, None), (5, "　1")]
    out = chunking.subsections(spark.createDataFrame(rows, "id long, text string"), "id").orderBy("id", "pos").collect()
    assert [(r["id"], r["subsection"], r["content"]) for r in out] == [(1, "", "head"), (1, "1", "first"), (1, "3", "third"), (2, "", "none"), (3, "", ""), (4, "", "")]
