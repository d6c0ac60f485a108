"""The registry of queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import answers as A
from granary.functions import profiles as P
from granary.functions import text as T
from granary.operators import build, chunking, evaluation, graph, retrieval, summary
from granary.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _questions(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
INDEX = f"""
tok AS (SELECT doc_id AS id, unnest({TOK}) AS token FROM documents),
post AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS token FROM benchmark),
idf AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st),
sc AS (SELECT q.query_id, post.id, round(sum(idf * tf / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)), 6) AS score, count(*) AS matched, round(sum(idf), 6) AS idf_sum
       FROM q JOIN post USING (token) JOIN idf USING (token) JOIN dl ON dl.id = post.id, st GROUP BY q.query_id, post.id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 30)"""
ROUTES = """
nl AS (SELECT query_id, id, 0 AS route, rank FROM hits),
kw AS (SELECT query_id, id, 1 AS route, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, id) AS rank FROM sc) WHERE rank <= 30),
rare AS (SELECT query_id, id, 2 AS route, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY idf_sum DESC, id) AS rank FROM sc) WHERE rank <= 30)"""


@query(f"SELECT doc_id AS id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS token FROM documents) GROUP BY doc_id, token")
def tokenize_tf(spark, d):
    return retrieval.term_frequencies(_docs(spark, d))


@query(f"WITH tok AS (SELECT DISTINCT doc_id, unnest({TOK}) AS token FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM tok) SELECT token, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tok, n GROUP BY token")
def bm25_idf_table(spark, d):
    _, df, stats = retrieval.inverted_index(_docs(spark, d))
    n = float(stats.first()["n"])
    return df.select("token", "df", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"WITH {INDEX} SELECT query_id, id, score, matched, idf_sum, CAST(rank AS INTEGER) AS rank FROM hits")
def bm25_topk(spark, d):
    return retrieval.bm25(_docs(spark, d), _questions(spark, d))


@query(f"WITH {INDEX} SELECT query_id, id, score FROM hits WHERE score >= 0.3")
def min_score_filter(spark, d):
    return retrieval.min_score(bm25_topk(spark, d), P.BM25_MIN).select("query_id", "id", "score")


@query(f"""WITH {INDEX}, g AS (SELECT *, CASE WHEN score > 0 AND (score - lead(score) OVER (PARTITION BY query_id ORDER BY rank)) / score > 0.2 THEN rank END AS cut FROM hits WHERE score >= 0.3),
c AS (SELECT *, min(cut) OVER (PARTITION BY query_id) AS first_cut FROM g)
SELECT query_id, id, score FROM c WHERE rank <= CASE WHEN first_cut IS NULL THEN 30 ELSE greatest(first_cut, 10) END""")
def gap_filter(spark, d):
    return retrieval.gap_filter(retrieval.min_score(bm25_topk(spark, d), P.BM25_MIN)).select("query_id", "id", "score")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


VEC = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query(f"WITH {VEC} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30 AND score >= 0.1")
def vector_topk(spark, d):
    """Queries: the vectors whose id is divisible by 20."""
    v = _vectors(spark, d)
    return retrieval.vector_topk(v, v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "v"))


@query(f"WITH {VEC} SELECT query_id, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS same FROM r JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = id WHERE rank <= 10 AND score >= 0.1 GROUP BY query_id")
def vector_label_recall(spark, d):
    labels = _vectors(spark, d).select("id", "label")
    hits = vector_topk(spark, d).filter("rank <= 10").join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("same"))


def _routes(spark, d, n=3):
    return retrieval.lexical_routes(_docs(spark, d), _questions(spark, d), ("score", "matched", "idf_sum")[:n])


FUSED = "f AS (SELECT query_id, id, round(sum(1 / (60.0 + rank)), 9) AS score, min(route * 1000 + rank) AS first FROM u GROUP BY query_id, id), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f)"


@query(f"WITH {INDEX}, {ROUTES}, u AS (SELECT * FROM nl UNION ALL SELECT * FROM kw), {FUSED} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 20")
def rrf_two_route(spark, d):
    return retrieval.fused(_routes(spark, d, 2), P.POOL).select("query_id", "id", "score", "rank")


@query(f"""WITH {INDEX}, {ROUTES}, u AS (SELECT * FROM nl UNION ALL SELECT * FROM kw UNION ALL SELECT * FROM rare)
SELECT query_id, id, round(coalesce(sum(CASE WHEN route = 0 THEN 1 / (60.0 + rank) END), 0), 9) AS v_nl, round(coalesce(sum(CASE WHEN route = 1 THEN 1 / (60.0 + rank) END), 0), 9) AS v_kw,
round(coalesce(sum(CASE WHEN route = 2 THEN 1 / (60.0 + rank) END), 0), 9) AS v_rare, round(sum(1 / (60.0 + rank)), 9) AS total FROM u GROUP BY query_id, id""")
def rrf_three_route_breakdown(spark, d):
    part = lambda r: F.round(F.coalesce(F.sum(F.when(F.col("route") == r, 1 / (P.RRF_K + F.col("rank")))), F.lit(0.0)), 9)
    return _routes(spark, d).groupBy("query_id", "id").agg(part(0).alias("v_nl"), part(1).alias("v_kw"), part(2).alias("v_rare"), F.round(F.sum(1 / (P.RRF_K + F.col("rank"))), 9).alias("total"))


SUB = f"""
sq AS (SELECT item_id, item_id * 100 + i AS query_id, p[i] AS text FROM (SELECT item_id, string_split(text, '. ') AS p FROM benchmark), range(1, 100) r(i) WHERE i <= len(p)),
tok AS (SELECT doc_id AS id, unnest({TOK}) AS token FROM documents), post AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), idf AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), st),
q AS (SELECT DISTINCT query_id, unnest({TOK}) AS token FROM sq),
sc AS (SELECT q.query_id, post.id, round(sum(idf * tf / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)), 6) AS score FROM q JOIN post USING (token) JOIN idf USING (token) JOIN dl ON dl.id = post.id, st GROUP BY q.query_id, post.id),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc),
u AS (SELECT query_id // 100 AS query_id, query_id % 100 AS route, id, rank FROM h WHERE rank <= 10)"""


@query(f"WITH {SUB}, {FUSED} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 10")
def rrf_subquery_merge(spark, d):
    """Questions are cut into sentences, each is asked by itself, and ranks are fused again by question."""
    parts = _questions(spark, d).select("query_id", F.posexplode(F.split("text", r"\. ")).alias("i", "text")).select((F.col("query_id") * 100 + F.col("i") + 1).alias("query_id"), "text")
    hits = retrieval.bm25(_docs(spark, d), parts, P.FINAL_K)
    routes = hits.select(F.floor(F.col("query_id") / 100).alias("query_id"), (F.col("query_id") % 100).alias("route"), "id", "rank")
    return retrieval.fused(routes, P.FINAL_K).select("query_id", "id", "score", "rank")


@query(f"""WITH {INDEX}, {ROUTES}, u AS (SELECT * FROM nl UNION ALL SELECT * FROM kw), {FUSED},
c AS (SELECT z.query_id, z.id, z.rank, CASE WHEN sc.matched >= 20 THEN sc.idf_sum END AS s FROM z JOIN sc USING (query_id, id) WHERE rank <= 20),
a AS (SELECT *, count(s) OVER (PARTITION BY query_id) > 0 AS answered FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(s, 0) DESC, rank) AS final_rank FROM a WHERE NOT answered OR s IS NOT NULL)
SELECT query_id, id, CAST(final_rank AS INTEGER) AS final_rank, answered FROM o WHERE final_rank <= 10""")
def rerank_fallback_topk(spark, d):
    """An offline re-ranker that answers only for candidates with twenty matched tokens."""
    hits = retrieval.kept(_routes(spark, d, 2))
    scores = hits.filter("matched >= 20").select("query_id", "id", F.col("idf_sum").alias("s")).distinct()
    return retrieval.rerank(retrieval.fused(hits, P.POOL), scores)


@query(f"""WITH {INDEX}, {ROUTES},
dv AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM (SELECT id, CAST('0x' || substr(md5(token), 1, 2) AS INTEGER) % 64 AS b, count(*) AS n FROM tok GROUP BY ALL)),
qv AS (SELECT query_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM (SELECT query_id, CAST('0x' || substr(md5(token), 1, 2) AS INTEGER) % 64 AS b, count(*) AS n FROM (SELECT item_id AS query_id, unnest({TOK}) AS token FROM benchmark) GROUP BY ALL)),
vs AS (SELECT query_id, id, round(sum(qv.w * dv.w), 6) AS score FROM qv JOIN dv USING (b) GROUP BY query_id, id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs),
hs AS (SELECT 0 AS route, query_id, id, score, rank FROM hits WHERE score >= 0.3 UNION ALL SELECT 2, query_id, id, score, rank FROM vr WHERE rank <= 30 AND score >= 0.1),
g AS (SELECT *, CASE WHEN score > 0 AND (score - lead(score) OVER (PARTITION BY route, query_id ORDER BY rank)) / score > 0.2 THEN rank END AS cut FROM hs),
c0 AS (SELECT *, min(cut) OVER (PARTITION BY route, query_id) AS first_cut FROM g),
u AS (SELECT query_id, id, route, rank FROM c0 WHERE rank <= CASE WHEN first_cut IS NULL THEN 30 ELSE greatest(first_cut, 10) END UNION ALL SELECT query_id, id, route, rank FROM kw), {FUSED},
c AS (SELECT z.query_id, z.id, z.rank, CASE WHEN sc.matched >= 20 THEN sc.idf_sum END AS s FROM z LEFT JOIN sc USING (query_id, id) WHERE rank <= 20),
a AS (SELECT *, count(s) OVER (PARTITION BY query_id) > 0 AS answered FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(s, 0) DESC, rank) AS final_rank FROM a WHERE NOT answered OR s IS NOT NULL)
SELECT query_id, id, CAST(final_rank AS INTEGER) AS final_rank, answered FROM o WHERE final_rank <= 10""")
def hybrid_topk(spark, d):
    """Lexical, keyword and vector routes, filtered, fused and re-ranked as one plan."""
    rescore = lambda scored: scored.filter("matched >= 20").select("query_id", "id", F.col("idf_sum").alias("s"))
    return retrieval.hybrid(_docs(spark, d), _questions(spark, d), rescore)


def _chunks(spark, d):
    """Documents as chunks of a book for each source, with a section for each language and a subsection by label."""
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_idx"), F.format_string("c%d", "doc_id").alias("node_id"), F.col("source").alias("file"), F.col("lang").alias("section"), F.when(F.length("text") > 1500, "long").otherwise("").alias("subsection"), "text")


TREE = """
ch AS (SELECT doc_id AS i, 'c' || doc_id AS node_id, source AS file, lang AS section, CASE WHEN length(text) > 1500 THEN 'long' ELSE '' END AS subsection, text FROM documents),
l1 AS (SELECT 'summary_leaf_' || node_id AS node_id, left(text, 100) || '...' AS text, [node_id] AS child_ids, i AS chunk_lo, i AS chunk_hi, file, section, subsection, node_id AS c, text AS t FROM ch),
l2 AS (SELECT 'summary_L2_' || min(i) || '_' || max(i) AS node_id, left(string_agg(left(text, 200), chr(10) || chr(10) ORDER BY i) FILTER (text <> ''), 200) || '...' AS text, list(node_id ORDER BY i) AS child_ids, min(i) AS chunk_lo, max(i) AS chunk_hi, file, section, subsection
       FROM ch JOIN (SELECT file FROM ch GROUP BY file HAVING count(*) > 1) USING (file) GROUP BY file, section, subsection),
l3 AS (SELECT 'summary_L3_' || min(chunk_lo) || '_' || max(chunk_hi) AS node_id, left(string_agg(left(text, 200), chr(10) || chr(10) ORDER BY chunk_lo), 200) || '...' AS text, flatten(list(child_ids ORDER BY chunk_lo)) AS child_ids, min(chunk_lo) AS chunk_lo, max(chunk_hi) AS chunk_hi, file, section
       FROM l2 GROUP BY file, section HAVING count(*) > 1 OR max(subsection) <> ''),
cl AS (SELECT node_id, text, child_ids, chunk_lo, chunk_hi, file FROM l3 UNION ALL SELECT node_id, text, child_ids, chunk_lo, chunk_hi, file FROM l2 WHERE subsection = '' OR NOT EXISTS (SELECT 1 FROM l3 WHERE l3.file = l2.file AND l3.section = l2.section)),
l4 AS (SELECT 'summary_L4_' || min(chunk_lo) || '_' || max(chunk_hi) AS node_id, left(string_agg(left(text, 200), chr(10) || chr(10) ORDER BY chunk_lo, node_id), 200) || '...' AS text, flatten(list(child_ids ORDER BY chunk_lo, node_id)) AS child_ids, min(chunk_lo) AS chunk_lo, max(chunk_hi) AS chunk_hi, file FROM cl GROUP BY file HAVING count(*) > 1)"""
_S = "node_id, text, array_to_string(child_ids, ',') AS children, chunk_lo, chunk_hi, file"


def _level(spark, d, level, *more):
    return summary.tree(_chunks(spark, d)).filter(F.col("level") == level).select("node_id", "text", F.array_join("child_ids", ",").alias("children"), "chunk_lo", "chunk_hi", "file", *more)


@query(f"WITH {TREE} SELECT {_S} FROM l1")
def summary_l1(spark, d):
    return _level(spark, d, 1)


@query(f"WITH {TREE} SELECT {_S}, section, subsection FROM l2")
def summary_l2(spark, d):
    return _level(spark, d, 2, "section", "subsection")


@query(f"WITH {TREE} SELECT {_S}, section FROM l3")
def summary_l3(spark, d):
    return _level(spark, d, 3, "section")


@query(f"WITH {TREE} SELECT {_S} FROM l4")
def summary_l4(spark, d):
    return _level(spark, d, 4)


@query(f"""WITH {TREE}, a AS (SELECT 1 AS level, child_ids, chunk_lo, chunk_hi FROM l1 UNION ALL SELECT 2, child_ids, chunk_lo, chunk_hi FROM l2 UNION ALL SELECT 3, child_ids, chunk_lo, chunk_hi FROM l3 UNION ALL SELECT 4, child_ids, chunk_lo, chunk_hi FROM l4)
SELECT level, count(*) AS nodes, CAST(sum(len(child_ids)) AS BIGINT) AS children, min(chunk_lo) AS chunk_lo, max(chunk_hi) AS chunk_hi FROM a GROUP BY level""")
def summary_meta(spark, d):
    return summary.tree(_chunks(spark, d)).groupBy("level").agg(F.count("*").alias("nodes"), F.sum(F.size("child_ids").cast("long")).alias("children"), F.min("chunk_lo").alias("chunk_lo"), F.max("chunk_hi").alias("chunk_hi"))


@query(f"WITH {TREE} SELECT node_id, 0 AS level, text FROM ch UNION ALL SELECT node_id, 1, text FROM l1 UNION ALL SELECT node_id, 2, text FROM l2 UNION ALL SELECT node_id, 3, text FROM l3 UNION ALL SELECT node_id, 4, text FROM l4")
def corpus_union(spark, d):
    c = _chunks(spark, d)
    return c.select("node_id", F.lit(0).alias("level"), "text").unionByName(summary.tree(c).select("node_id", "level", "text"))


@query(f"""WITH {INDEX}, {TREE}, k AS (SELECT node_id AS summary_id, unnest(child_ids) AS c, len(child_ids) AS n FROM l2)
SELECT query_id, summary_id FROM k JOIN hits ON c = 'c' || id GROUP BY query_id, summary_id, n HAVING count(*) / n >= 0.02""")
def redundant_summary_filter(spark, d):
    """Summaries are wide here, so the share is 0.02."""
    two = summary.tree(_chunks(spark, d)).filter("level = 2").select(F.col("node_id").alias("summary_id"), "child_ids")
    return retrieval.redundant(two, bm25_topk(spark, d).select("query_id", F.format_string("c%d", "id").alias("id")), 0.02)


@query("SELECT 'c' || doc_id AS node_id, 'file: ' || source || chr(10) || 'section: ' || lang || chr(10) || chr(10) || text AS embed_text, lang || ' ' || text AS bm25_text FROM documents")
def embed_text_projection(spark, d):
    c = _chunks(spark, d)
    return c.select("node_id", F.concat_ws("\n", F.concat(F.lit("file: "), "file"), F.concat(F.lit("section: "), "section"), F.lit(""), F.col("text")).alias("embed_text"), F.when(F.col("section") != "", F.concat_ws(" ", "section", "text")).otherwise(F.col("text")).alias("bm25_text"))


_LINES = """
l AS (SELECT doc_id, i, p[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
m AS (SELECT *, sum(CASE WHEN i > 1 AND regexp_matches(line, '^[ 　]*(?:The|La|Der|El|En|That) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l),
g AS (SELECT doc_id, pos, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS part FROM m GROUP BY doc_id, pos)"""


@query(f"""WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(part, '^(?:The|La|Der|El|En|That) ') THEN regexp_replace(split_part(part, chr(10), 1), '[\\s\\p{{Z}}]+$', '') ELSE '概述' END AS section,
CASE WHEN regexp_matches(part, '^(?:The|La|Der|El|En|That) ') THEN regexp_replace(substr(part, length(split_part(part, chr(10), 1)) + 2), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') ELSE part END AS body FROM g""")
def section_split(spark, d):
    return chunking.sections(_docs(spark, d))


@query("SELECT doc_id, substr(text, 1, 3000) || CASE WHEN length(text) // 4 > 3000 THEN chr(10) || '...' || chr(10) || substr(text, length(text) // 4 + 1, 1000) ELSE '' END || CASE WHEN length(text) // 2 > 3000 THEN chr(10) || '...' || chr(10) || substr(text, length(text) // 2 + 1, 1000) ELSE '' END || CASE WHEN (length(text) * 3) // 4 > 3000 THEN chr(10) || '...' || chr(10) || substr(text, (length(text) * 3) // 4 + 1, 1000) ELSE '' END AS sample FROM documents")
def structure_samples(spark, d):
    return _docs(spark, d).select("doc_id", chunking.structure_sample(F.col("text")).alias("sample"))


#: Windows as a recursion over positions behind sentence ends; the texts of size and twice the size are cut apart from it.
WINDOWS = r"""
RECURSIVE parts AS (SELECT doc_id, text, length(text) AS n, list_transform(string_split_regex(text, '[.!?]\s'), lambda x: length(x)) AS lens FROM documents),
marks AS (SELECT doc_id, sum(x + 2) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS e, k, m FROM (SELECT doc_id, unnest(lens) AS x, generate_subscripts(lens, 1) AS k, len(lens) AS m FROM parts)),
ends AS (SELECT doc_id, list(e ORDER BY e) AS ends FROM marks WHERE k < m GROUP BY doc_id),
d AS (SELECT doc_id, text, n, coalesce(ends, []) AS ends FROM parts LEFT JOIN ends USING (doc_id)),
w AS (
  SELECT doc_id, n, ends, 0 AS l, coalesce(list_filter(ends, lambda e: e > 1024)[1], n) AS r FROM d WHERE n > 2048
  UNION ALL
  SELECT doc_id, n, ends, l, CASE WHEN r <= l THEN least(l + 1024, n) ELSE r END FROM (
    SELECT doc_id, n, ends, l, coalesce(list_filter(ends, lambda e: e > l + 1024)[1], n) AS r FROM (
      SELECT doc_id, n, ends, least(coalesce(list_filter(ends, lambda e: e > greatest(0, r - 102))[1], n), r) AS l FROM w WHERE n - r > 2048))
),
rest AS (SELECT doc_id, n, ends, r AS l FROM w WHERE r < n AND n - r <= 2048 UNION ALL SELECT doc_id, n, ends, 0 FROM d WHERE n > 1024 AND n <= 2048),
one AS (SELECT doc_id, n, ends, l, CASE WHEN z <= l THEN least(l + 1024, n) ELSE z END AS z FROM (SELECT *, least(coalesce(list_filter(ends, lambda e: e > (l + n) // 2 + 51)[1], n), n - 1) AS z FROM rest)),
cut AS (
  SELECT doc_id, l, r FROM w UNION ALL SELECT doc_id, l, z FROM one
  UNION ALL SELECT doc_id, least(coalesce(list_filter(ends, lambda e: e > greatest(l + 1, z - 102))[1], n), n - 1, z), n FROM one
  UNION ALL SELECT doc_id, 0, n FROM d WHERE n <= 1024 AND n > 0
),
chunk AS (SELECT doc_id, l, r, trim(substring(text, CAST(l + 1 AS BIGINT), CAST(r - l AS BIGINT)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM cut JOIN d USING (doc_id))
"""


@query(f"""WITH {WINDOWS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l, r) - 1 AS chunk_no, CAST(l AS BIGINT) AS "left", CAST(r AS BIGINT) AS "right", text FROM chunk WHERE text <> ''""")
def chunk_sliding_window(spark, d):
    return chunking.chunks(_docs(spark, d))


@query(f"""WITH {WINDOWS} SELECT doc_id, count(*) AS chunks, CAST(min(l) AS BIGINT) AS first, CAST(max(r) AS BIGINT) AS last, CAST(max(r - l) AS BIGINT) AS longest FROM chunk WHERE text <> '' GROUP BY doc_id""")
def chunk_stats(spark, d):
    return chunking.chunks(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("left").alias("first"), F.max("right").alias("last"), F.max(F.col("right") - F.col("left")).alias("longest"))


_NUMERALS = "('三', '第三回'), ('十', '第十章'), ('十五', '十五、序'), ('二十', '第二十节'), ('一百零五', '第一百零五回'), ('两千', '序'), ('abc', '12. x'), ('', '')"
_NUM_SQL = "CASE numeral WHEN '三' THEN 3 WHEN '十' THEN 10 WHEN '十五' THEN 15 WHEN '二十' THEN 20 WHEN '一百零五' THEN 105 WHEN '两千' THEN 2000 ELSE 0 END"


@query(f"SELECT numeral, {_NUM_SQL} AS value FROM (VALUES {_NUMERALS}) t(numeral, title)")
def cn_numeral(spark, d):
    return spark.sql(f"SELECT * FROM VALUES {_NUMERALS} AS t(numeral, title)").select("numeral", T.cn_numeral(F.col("numeral")).alias("value"))


@query("SELECT title, CASE title WHEN '第三回' THEN 3 WHEN '第十章' THEN 10 WHEN '十五、序' THEN 15 WHEN '第二十节' THEN 20 WHEN '第一百零五回' THEN 105 WHEN '12. x' THEN 12 ELSE 0 END AS ord FROM (VALUES " + _NUMERALS + ") t(numeral, title)")
def section_order(spark, d):
    t = F.col("title")
    found = [T.cn_numeral(F.regexp_extract(t, r"第([一二三四五六七八九十百千零两]+)[回章节篇]", 1)), T.cn_numeral(F.regexp_extract(t, r"^([一二三四五六七八九十百]+)、", 1)), F.expr(r"try_cast(regexp_extract(title, '([0-9]+)', 1) as int)")]
    return spark.sql(f"SELECT * FROM VALUES {_NUMERALS} AS t(numeral, title)").select("title", F.coalesce(*[F.when(x != 0, x) for x in found], F.lit(0)).alias("ord"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(left(text, 3000), '第[一二三四五六七八九十百千]+[回章节篇]')) > len(regexp_extract_all(left(text, 3000), '[一二三四五六七八九十]{1,3}、')) THEN 'hui' ELSE 'dun' END AS format FROM documents")
def heading_format_vote(spark, d):
    return _docs(spark, d).select("doc_id", chunking.heading_format(F.col("text")).alias("format"))


def _turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, replace(replace(replace(replace(text, 'thethe', chr(1)), 'the', chr(2)), chr(1), 'DOUBLE'), chr(2), 'ARTICLE') AS mapped FROM conversations")
def term_map_replace(spark, d):
    """One pass, longest term first, without replacing what was put in."""
    marks = {"thethe": "\x01", "the": "\x02"}
    out = F.col("text")
    for term in sorted(marks, key=len, reverse=True):
        out = F.replace(out, F.lit(term), F.lit(marks[term]))
    for term, to in (("thethe", "DOUBLE"), ("the", "ARTICLE")):
        out = F.replace(out, F.lit(marks[term]), F.lit(to))
    return _turns(spark, d).select("conv_id", "turn", out.alias("mapped"))


@query("""WITH w AS (SELECT item_id, i, p[i] AS w FROM (SELECT item_id, regexp_split_to_array(text, '\\s+') AS p FROM benchmark), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
f AS (SELECT item_id, w, min(i) AS i FROM w WHERE w <> '' GROUP BY item_id, w), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS keywords FROM n WHERE k <= 50 GROUP BY item_id""")
def keyword_dedup(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.keyword_dedup(F.col("text")).alias("keywords"))


_KW = " + ".join(f"CAST(contains(text, '{k}') AS INTEGER)" for k in P.MULTI_PART_LATIN)


@query(f"SELECT conv_id, turn, {_KW} AS keywords, ({_KW}) >= 2 OR length(text) - length(regexp_replace(text, '[?？]', '', 'g')) >= 2 OR (length(text) > 80 AND ({_KW}) >= 1) AS complex FROM conversations WHERE role = 'user'")
def query_complexity(spark, d):
    t = F.col("text")
    return _turns(spark, d).filter("role = 'user'").select("conv_id", "turn", T.keyword_count(t, P.MULTI_PART_LATIN).alias("keywords"), T.is_complex(t, P.MULTI_PART_LATIN).alias("complex"))


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x FROM conversations), s AS (SELECT conv_id, turn, regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS x FROM l),
c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[0-9]+[.)、\\s:：]+\\s*', ''), '^[-•*]\\s*', ''), '^[Qq]uestion\\s*[0-9]+[:：]\\s*', ''), '^子(?:问题|查询)\\s*[0-9]+[:：]\\s*', '') AS q FROM s WHERE length(x) >= 3)
SELECT conv_id, turn, q, count(*) AS n FROM c WHERE length(q) > 3 GROUP BY conv_id, turn, q""")
def subquery_parse(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.explode(T.sub_queries(F.col("text"))).alias("q")).groupBy("conv_id", "turn", "q").agg(F.count("*").alias("n"))


def _triples(spark, d):
    """Edges of the star schema: customer placed order, supplier located in nation, nation part of region."""
    t = lambda n: _t(spark, d, n)
    edges = [
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("subject"), F.lit("placed").alias("predicate"), F.format_string("Order#%d", "o_orderkey").alias("object")),
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object")),
        t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.col("r_name").alias("object")),
    ]
    return edges[0].unionByName(edges[1]).unionByName(edges[2])


TRI = """
tri AS (SELECT c_name AS subject, 'placed' AS predicate, 'Order#' || o_orderkey AS object FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
deg AS (SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM tri UNION ALL SELECT object FROM tri) GROUP BY node),
top AS (SELECT * FROM deg ORDER BY degree DESC, node LIMIT 80),
place AS (SELECT * FROM tri WHERE predicate <> 'placed'),
hub AS (SELECT node FROM (SELECT node, count(*) AS n FROM (SELECT subject AS node FROM place UNION ALL SELECT object FROM place) GROUP BY node) ORDER BY n DESC, node LIMIT 80)"""


@query(f"WITH {TRI} SELECT node, degree, CAST(floor(10 + (degree - lo) / CAST(hi - lo AS DOUBLE) * 50) AS BIGINT) AS size FROM top, (SELECT min(degree) AS lo, max(degree) AS hi FROM top)")
def graph_degree_topn(spark, d):
    return graph.sized(graph.degrees(_triples(spark, d)).orderBy(F.col("degree").desc(), "node").limit(80))


@query(f"WITH {TRI} SELECT DISTINCT subject, predicate, object FROM place WHERE subject IN (SELECT node FROM hub) AND object IN (SELECT node FROM hub)")
def graph_visible_edges(spark, d):
    """Of the places' part of the graph."""
    e = _triples(spark, d).filter("predicate <> 'placed'")
    return graph.visible(e, graph.degrees(e).orderBy(F.col("degree").desc(), "node").limit(80))


_HOP = f"""WITH {TRI}, a AS (SELECT n_nationkey AS query_id, n_name AS entity, 1 AS n FROM nation UNION ALL SELECT n_nationkey, r_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT query_id, subject, predicate, object, min(n) AS n FROM tri JOIN a ON contains(subject, entity) OR contains(object, entity) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, subject, predicate, object) AS rank FROM h)"""


def _asked(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("entity"), F.lit(1).alias("pos")).unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("query_id"), F.col("r_name").alias("entity"), F.lit(2).alias("pos")))


@query(f"{_HOP} SELECT query_id, subject, predicate, object, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def graph_one_hop(spark, d):
    return graph.one_hop(_triples(spark, d), _asked(spark, d))


@query(f"""{_HOP}, {VEC.replace(chr(10) + "r AS", chr(10) + "vr AS")}, worst AS (SELECT query_id // 20 AS query_id, min(score) AS score FROM vr WHERE rank <= 10 AND score >= 0.1 GROUP BY ALL)
SELECT query_id, string_agg('(' || subject || ')-[' || predicate || ']->(' || object || ')', chr(10) ORDER BY r.rank) AS context, coalesce(any_value(worst.score), 0) AS score FROM r LEFT JOIN worst USING (query_id) WHERE r.rank <= 20 GROUP BY query_id""")
def graph_context_row(spark, d):
    """The row that graph context adds to each question's results; those of nation n are the hits of vector 20 n."""
    results = vector_topk(spark, d).filter("rank <= 10").select(F.floor(F.col("query_id") / 20).alias("query_id"), "score")
    return graph.context_row(graph_one_hop(spark, d), results)


@query(f"WITH {TRI} SELECT subject, predicate, object, count(*) AS n FROM tri GROUP BY ALL")
def triple_dedup(spark, d):
    return _triples(spark, d).groupBy(*graph.TRIPLE).agg(F.count("*").alias("n"))


def _entities(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.split("p_name", " ")[0].alias("name"), F.col("p_type").alias("raw"), F.col("p_name").alias("description"), F.col("p_partkey").alias("pos"))


@query("SELECT p_partkey AS chunk_id, split_part(p_name, ' ', 1) AS name FROM part WHERE length(split_part(p_name, ' ', 1)) >= 2 AND split_part(p_name, ' ', 1) NOT IN ('red', 'blue')")
def entity_rules(spark, d):
    return graph.valid_entities(_entities(spark, d), ["red", "blue"]).select("chunk_id", "name")


_TYPES = {"STEEL": "Item", "BRASS": "Item", "COPPER": "Concept"}


@query("SELECT p_partkey AS chunk_id, CASE WHEN contains(p_type, 'STEEL') OR contains('STEEL', p_type) THEN 'Item' WHEN contains(p_type, 'BRASS') OR contains('BRASS', p_type) THEN 'Item' WHEN contains(p_type, 'COPPER') OR contains('COPPER', p_type) THEN 'Concept' ELSE 'Entity' END AS label FROM part")
def type_resolution(spark, d):
    return _entities(spark, d).select("chunk_id", graph.resolved_type(F.col("raw"), _TYPES).alias("label"))


@query("SELECT p_partkey AS chunk_id, round(least(1.0, 0.5 + CASE WHEN length(p_name) >= 10 THEN 0.2 ELSE 0 END + CASE WHEN contains(p_type, 'STEEL') THEN 0.2 ELSE 0 END + CASE WHEN length(split_part(p_name, ' ', 1)) >= 3 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM part")
def entity_confidence(spark, d):
    return _entities(spark, d).withColumn("label", graph.resolved_type(F.col("raw"), {"STEEL": "Item"})).select("chunk_id", graph.entity_confidence().alias("confidence"))


@query("SELECT p_partkey AS pos, p_type AS raw, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) > 5 THEN replace(p_type, ' ', '_') ELSE 'Entity' END AS label FROM part")
def schema_growth(spark, d):
    return graph.grown_types(_entities(spark, d).select("pos", "raw"))


_EV = {"click": "clicks", "view": "views"}


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' ELSE event_type END AS predicate FROM events")
def predicate_normalize(spark, d):
    return _t(spark, d, "events").select("event_id", graph.normalized_predicate(F.col("event_type"), _EV).alias("predicate"))


def _relations(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("idx"), F.format_string("user%d", "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object"), F.lit(0.5).alias("confidence"), F.col("event_id").alias("pos"), "value")


@query("""WITH r AS (SELECT user_id AS chunk_id, event_id AS pos, 'user' || user_id AS subject, event_type AS predicate, props->>'$.k' AS object FROM events WHERE event_type <> 'error'),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, subject, predicate, object ORDER BY pos) AS n FROM r) SELECT chunk_id, pos, predicate, object FROM k WHERE n = 1""")
def relation_rules(spark, d):
    r = _relations(spark, d)
    ends = r.select("chunk_id", F.explode(F.array("subject", "object")).alias("name"))
    return graph.valid_relations(r, ends, ["error"]).select("chunk_id", "pos", "predicate", "object")


@query("SELECT event_id AS idx, round(least(1.0, 0.5 + CASE WHEN length(props) >= 10 THEN 0.2 ELSE 0 END + CASE WHEN event_type IN ('click', 'view') THEN 0.15 ELSE 0 END + CASE WHEN value > 10 THEN 0.15 ELSE 0 END), 6)::DOUBLE AS confidence FROM events")
def relation_confidence(spark, d):
    e = _t(spark, d, "events").withColumn("subject_type", F.lit("Person")).withColumn("object_type", F.when(F.col("value") > 10, "Item").otherwise("Entity"))
    return e.select(F.col("event_id").alias("idx"), graph.relation_confidence(F.col("event_type").isin(list(_EV)), "props").alias("confidence"))


@query("""WITH r AS (SELECT user_id AS chunk_id, event_id AS pos, 'user' || user_id AS subject, event_type AS predicate, props->>'$.k' AS object, CASE WHEN value < 5 THEN NULL WHEN value < 20 THEN 'valid' WHEN value < 40 THEN 'corrected' ELSE 'invalid' END AS v FROM events),
a AS (SELECT *, max(CASE WHEN v IN ('valid', 'corrected') THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id) AS j FROM r),
o AS (SELECT chunk_id, pos, subject, CASE WHEN v = 'corrected' THEN 'fixed' ELSE predicate END AS predicate, object, CASE WHEN v = 'corrected' THEN 0.6 ELSE 0.5 END AS confidence FROM a WHERE j = 0 OR v IN ('valid', 'corrected')),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, subject, predicate, object ORDER BY pos) AS n FROM o) SELECT chunk_id, pos, predicate, object, confidence::DOUBLE AS confidence FROM k WHERE n = 1""")
def verdict_merge(spark, d):
    r = _relations(spark, d)
    v = F.when(F.col("value") >= 40, "invalid").when(F.col("value") >= 20, "corrected").when(F.col("value") >= 5, "valid")
    verdicts = r.select("chunk_id", "idx", v.alias("verdict"), F.lit("fixed").alias("predicate")).filter("verdict is not null")
    return graph.judged(r.drop("value"), verdicts).select("chunk_id", "pos", "predicate", "object", "confidence")


_ALIAS_SQL = """WITH c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part), k AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'ed'),
up AS (SELECT c.name, min(lpad(CAST(length(k.name) AS VARCHAR), 5, '0') || k.name) AS a FROM c JOIN k ON contains(k.name, c.name) AND k.name <> c.name GROUP BY c.name),
dn AS (SELECT c.name, max(lpad(CAST(length(k.name) AS VARCHAR), 5, '0') || k.name) AS b FROM c JOIN k ON contains(c.name, k.name) AND k.name <> c.name AND length(c.name) <= length(k.name) + 2 GROUP BY c.name)
SELECT c.name, CASE WHEN c.name IN (SELECT name FROM k) THEN c.name ELSE coalesce(substr(a, 6), substr(b, 6), c.name) END AS canonical FROM c LEFT JOIN up USING (name) LEFT JOIN dn USING (name)"""


@query(_ALIAS_SQL)
def alias_resolution(spark, d):
    p = _t(spark, d, "part")
    return graph.alias_of(p.select(F.split("p_name", " ")[0].alias("name")).distinct(), p.select(F.col("p_name").alias("name")).union(spark.sql("select 'ed' as name")).distinct())


@query("""SELECT split_part(p_name, ' ', 1) AS canonical, substr(max(lpad(CAST(length(p_type) AS VARCHAR), 5, '0') || p_type), 6) AS description, max(p_retailprice) AS confidence FROM part GROUP BY split_part(p_name, ' ', 1)""")
def description_longest(spark, d):
    return graph.longest_description(_t(spark, d, "part").select(F.split("p_name", " ")[0].alias("canonical"), F.col("p_type").alias("description"), F.col("p_retailprice").alias("confidence")))


GOLD = "g AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')) WHERE b.text <> '')"


def _gold(spark, d):
    """Documents that hold a benchmark text, white space aside: the few benchmark texts are collected, some thousand a pass."""
    own = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    return retrieval.containing(own, _questions(spark, d))


@query(f"WITH {GOLD} SELECT query_id, id FROM g")
def gold_chunk_resolution(spark, d):
    return _gold(spark, d)


_EVAL = f"""WITH {INDEX}, {GOLD}, m AS (SELECT g.query_id, g.id, min(rank) AS rank FROM g LEFT JOIN hits USING (query_id, id) GROUP BY g.query_id, g.id),
e AS (SELECT query_id, round(coalesce(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) / count(*), 0), 6) AS recall_3, round(coalesce(sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) / count(*), 0), 6) AS recall_5, round(coalesce(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / count(*), 0), 6) AS recall_10,
min(rank) AS first_hit, coalesce(round(1 / min(rank), 6), 0) AS rr FROM m GROUP BY query_id)"""


@query(f"{_EVAL} SELECT * FROM e")
def recall_at_k(spark, d):
    return evaluation.recall(bm25_topk(spark, d), _gold(spark, d))


@query(f"""{_EVAL}, k AS (SELECT e.*, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS kind FROM e JOIN benchmark ON item_id = query_id)
SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, round(avg(recall_3), 4) AS recall_3, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(rr), 4) AS rr, round(avg(CASE WHEN first_hit IS NULL THEN 0.0 ELSE 1.0 END), 4) AS hit_rate, round(avg(first_hit), 2) AS mean_first_hit FROM k GROUP BY GROUPING SETS ((), (kind))""")
def mrr_by_type(spark, d):
    kinds = _questions(spark, d).select("query_id", F.when(F.length("text") > 200, "long").otherwise("short").alias("kind"))
    return evaluation.by_kind(recall_at_k(spark, d).join(kinds, "query_id"), ["recall_3", "recall_5", "recall_10", "rr"])


@query("""SELECT coalesce(event_type, 'overall') AS kind, count(*) AS n, round(avg(value), 4) AS faithfulness, round(avg(user_id), 4) AS citation, round(avg(event_id), 4) AS completeness, round(sum(CAST(props->>'$.k' AS INTEGER)) / nullif(sum(user_id), 0), 4) AS point_rate FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def answer_scores_by_type(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("faithfulness"), F.col("user_id").alias("citation"), F.col("event_id").alias("completeness"), F.get_json_object("props", "$.k").cast("int").alias("hit"), F.col("user_id").alias("points"))
    return evaluation.answers(e)


def _calls(spark, d):
    """Events as model calls; those with values over 40 came without counts."""
    n = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").select(F.col("event_type").alias("model"), F.when(F.col("user_id") > 50, "chat").otherwise("embed").alias("kind"), F.when(F.col("value") <= 40, n).alias("prompt"), F.floor("value").cast("long").alias("completion"), F.floor(n / 3).cast("long").alias("cached"), "value")


_USE = """c AS (SELECT event_type AS model, CASE WHEN user_id > 50 THEN 'chat' ELSE 'embed' END AS kind, value, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
u AS (SELECT kind, model, count(*) AS calls, CAST(coalesce(sum(CASE WHEN value <= 40 THEN k END), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(CASE WHEN value <= 40 THEN floor(value) END), 0) AS BIGINT) AS completion,
CAST(coalesce(sum(CASE WHEN value <= 40 THEN k // 3 END), 0) AS BIGINT) AS cached, round(sum(value), 6) AS elapsed, CAST(sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) AS BIGINT) AS unmetered FROM c GROUP BY kind, model)"""


@query(f"WITH {_USE} SELECT * FROM u")
def usage_by_model(spark, d):
    return evaluation.usage(_calls(spark, d).withColumnRenamed("value", "elapsed"))


@query(f"WITH {_USE}, p(model, price_in, price_out, price_cached) AS (VALUES ('click', 2.0, 8.0, 0.5), ('view', 1.0, 4.0, NULL)) SELECT kind, u.model, calls, round((greatest(prompt - cached, 0) * price_in + cached * coalesce(price_cached, price_in) + completion * price_out) / 1e6, 6)::DOUBLE AS cost FROM u LEFT JOIN p ON p.model = u.model")
def usage_cost(spark, d):
    prices = spark.createDataFrame([("click", 2.0, 8.0, 0.5), ("view", 1.0, 4.0, None)], "model string, price_in double, price_out double, price_cached double")
    return evaluation.costs(usage_by_model(spark, d), prices)


def _states(spark, d):
    """Events as states of the documents their users' numbers name."""
    s = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "view", "processing").otherwise("failed")
    return _t(spark, d, "events").select(F.col("user_id").alias("chunk_id"), s.alias("status"), F.col("ts").alias("updated_at"))


_STATE = "s AS (SELECT user_id AS chunk_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'processing' ELSE 'failed' END AS status, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'processing' ELSE 'failed' END) AS n FROM events)"


@query(f"WITH {_STATE} SELECT chunk_id, status FROM s WHERE n = 1")
def state_latest(spark, d):
    return build.latest(_states(spark, d)).select("chunk_id", "status")


@query(f"WITH {_STATE} SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM s WHERE n = 1 AND status = 'completed')")
def resume_pending(spark, d):
    chunks = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    states = _states(spark, d).join(chunks.select("chunk_id", F.md5("text").alias("text_hash")), "chunk_id")
    return build.pending(chunks, states).select("chunk_id")


@query("SELECT doc_id AS node_no, source AS file, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 256 AS BIGINT) AS segment FROM documents")
def segment_assignment(spark, d):
    return build.segments(_t(spark, d, "documents").select(F.col("doc_id").alias("node_no"), F.col("source").alias("file")))


@query(f"WITH {INDEX} SELECT query_id, id, '[' || rank || '] ' || source || ' / ' || lang || ' #' || (id + 1) || ': ' || left(text, 100) AS citation FROM hits JOIN documents ON doc_id = id WHERE rank <= 10")
def citation_format(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", F.substring("text", 1, 100).alias("text"))
    hits = docs.join(retrieval.few(bm25_topk(spark, d).filter("rank <= 10")), F.col("id") == F.col("doc_id"))
    return hits.select("query_id", "id", F.concat(F.format_string("[%d] %s / %s #%d: ", "rank", "source", "lang", F.col("id") + 1), "text").alias("citation"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace('<think>' || role || '</think> ' || text || '<thinking>a' || chr(10) || 'b</thinking>', '(?s)<think(?:ing)?>.*?</think(?:ing)?>\\s*', '', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS answer FROM conversations")
def think_strip(spark, d):
    said = F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text", F.lit("<thinking>a\nb</thinking>"))
    return _turns(spark, d).select("conv_id", "turn", T.without_thoughts(said).alias("answer"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    """Objects with words and fences around them."""
    said = F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```"))
    return _t(spark, d, "events").select("event_id", T.json_part(said, "k long")["k"].alias("k"))


@query(f"WITH {INDEX} SELECT query_id, string_agg(left(text, 500), chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN documents ON doc_id = id WHERE rank <= 10 GROUP BY query_id")
def prompt_context(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("t"))
    hits = docs.join(retrieval.few(bm25_topk(spark, d).filter("rank <= 10")), F.col("id") == F.col("doc_id"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("x")).select("query_id", F.array_join("x.t", "\n\n").alias("context"))


_CASES = [(missing, sorted(build.dirty({s: s != missing for s in build.STAGES}))) for missing in build.STAGES]


@query("""WITH RECURSIVE dep(stage, needs) AS (VALUES ('summary_tree', 'chunks'), ('bm25', 'summary_tree'), ('vector', 'summary_tree')), st(stage) AS (VALUES ('chunks'), ('summary_tree'), ('bm25'), ('vector'), ('graph')),
r(missing, stage) AS (SELECT stage, stage FROM st UNION SELECT r.missing, dep.stage FROM r JOIN dep ON dep.needs = r.stage) SELECT missing, stage FROM r""")
def stage_closure(spark, d):
    """What each missing stage makes out of date."""
    return spark.createDataFrame([(m, s) for m, out in _CASES for s in out], "missing string, stage string")


@query(r"""WITH line AS (SELECT doc_id, x, k, regexp_full_match(x, '[A-Z][a-z]+\.') AS mark FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
part AS (SELECT *, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY k) AS g, max(mark) OVER (PARTITION BY doc_id) AS marked FROM line),
body AS (SELECT doc_id, g, marked, coalesce(max(x) FILTER (mark), '') AS subsection, coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (NOT mark), '') AS content FROM part GROUP BY doc_id, g, marked)
SELECT doc_id, subsection, md5(CASE WHEN marked THEN trim(content, ' ' || chr(9) || chr(10) || chr(13)) ELSE content END) AS content FROM body WHERE NOT marked OR trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def subsection_split(spark, d):
    return chunking.subsections(_docs(spark, d), "doc_id", marker=r"^[A-Z][a-z]+\.$").select("doc_id", "subsection", F.md5("content").alias("content"))


_SAID = [" 是的, ", "“不是” ", "\"Yes, ", "否。", "：是", "no "]


@query("""SELECT conv_id, turn, conv_id % 6 IN (0, 2, 4) OR conv_id % 6 > 5 AND lower(left(ltrim(text), 3)) = 'yes' AS yes FROM conversations""")
def yes_no(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("conv_id") % 6 + 1).cast("int"))
    return _t(spark, d, "conversations").select("conv_id", "turn", A.says_yes(F.concat(said, "text")).alias("yes"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(left(text, 300), '\s+', ' ', 'g'))) AS first, '' AS second, md5(trim(regexp_replace(substring(text, 301, 300), '\s+', ' ', 'g'))) AS third FROM documents WHERE text NOT LIKE '%[%' AND length(text) > 301""")
def batch_summaries(spark, d):
    said = F.concat(F.lit("Here:\n[3] early [9] far [1]"), F.substring("text", 1, 300), F.lit("\n[3]  "), F.substring("text", 301, 300))
    own = _docs(spark, d).filter(~F.contains("text", F.lit("[")) & (F.length("text") > 301)).select("doc_id", A.numbered(said, 3).alias("s"))
    return own.select("doc_id", F.md5(F.col("s")[0]).alias("first"), F.col("s")[1].alias("second"), F.md5(F.col("s")[2]).alias("third"))


@query("SELECT doc_id, greatest(200, CAST(floor(length(text) * 0.3) AS INT)) AS most FROM documents")
def summary_size_limit(spark, d):
    return _docs(spark, d).select("doc_id", A.size_limit(F.length("text"), 0.3).alias("most"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) || ',' || o_orderkey AS kept FROM orders WHERE o_orderkey > 5 UNION ALL SELECT o_orderkey, array_to_string(list_sort(list_distinct([split_part(o_orderpriority, '-', 1)::BIGINT, o_orderkey])), ',') FROM orders WHERE o_orderkey <= 5")
def index_set(spark, d):
    said = F.concat(F.split("o_orderpriority", "-"), F.array(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")), F.col("o_orderkey").cast("string"), F.lit("1.5"), F.lit(None)))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(A.index_set(said).cast("array<string>"), ",").alias("kept"))


@query("SELECT event_id, CAST(least(5, greatest(1, round_even(value / 20, 0))) AS INT) AS mark, CASE WHEN event_id % 2 = 0 THEN 1 ELSE CAST(least(5, greatest(1, round_even(value, 0))) AS INT) END AS odd FROM events")
def judge_marks(spark, d):
    return _t(spark, d, "events").select("event_id", A.clamped(F.col("value") / 20).alias("mark"), A.clamped(F.when(F.col("event_id") % 2 == 0, F.lit("good")).otherwise(F.col("value").cast("string"))).alias("odd"))


@query("""SELECT event_id, event_type AS key, CASE event_id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'bool' WHEN 3 THEN 'null' ELSE 'str' END AS kind,
CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '-' || user_id || '.5e3' WHEN 2 THEN 'true' WHEN 4 THEN 'a=' || user_id END AS value FROM events""")
def settings(spark, d):
    user = F.col("user_id").cast("string")
    said = F.concat(F.lit(" "), "event_type", F.lit(" ="), F.element_at(F.array(F.concat(F.lit("+"), user), F.concat(F.lit("-"), user, F.lit(".5E3")), F.lit(" True "), F.lit("None"), F.concat(F.lit("a="), user)), (F.col("event_id") % 5 + 1).cast("int")))
    return _t(spark, d, "events").select("event_id", A.key_value(said).alias("s")).select("event_id", "s.*")


@query("SELECT doc_id, md5(replace(text, chr(10), ' ')) AS sent FROM documents")
def embedding_input(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(A.one_line(F.col("text"))).alias("sent"))


@query("SELECT source AS file, count(*) AS chunks, count(DISTINCT lang) AS sections, count(DISTINCT lang) FILTER (length(text) > 1500) AS subsections FROM documents GROUP BY source")
def section_counts(spark, d):
    return summary.section_counts(_chunks(spark, d))


@query(f"WITH {TREE} SELECT count(*) AS fallbacks, array_to_string(list(node_id ORDER BY chunk_lo, node_id)[1:10], ',') AS first_ids FROM l2")
def fallback_report(spark, d):
    return summary.fallback_report(summary.tree(_chunks(spark, d)).filter("level = 2").withColumn("fallback", F.lit(True)), ["chunk_lo"])


@query(f"WITH {TREE} SELECT l2.node_id, count(*) AS covered FROM l2 JOIN documents ON doc_id BETWEEN chunk_lo AND chunk_hi GROUP BY l2.node_id")
def summary_covers(spark, d):
    c = _chunks(spark, d)
    return summary.covering(summary.tree(c).filter("level = 2"), c).groupBy("node_id").agg(F.count("*").alias("covered"))


@query("SELECT doc_id, md5(left(text, 3000)) AS input FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 50")
def extract_inputs(spark, d):
    return graph.extract_inputs(_docs(spark, d)).select("doc_id", F.md5("input").alias("input"))


def _customers(spark, d):
    """Who lives in which nation, as relations."""
    nations = _t(spark, d, "nation")
    return _t(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subject"), F.lit("in").alias("predicate"), F.col("n_name").alias("object"), (F.col("c_acctbal") / 10000).alias("confidence"))


@query("SELECT c_name AS subject, coalesce(c_acctbal / 10000 >= 0.5, false) AS sure FROM customer JOIN nation ON c_nationkey = n_nationkey")
def confidence_gate(spark, d):
    return graph.gated(_customers(spark, d), 0.5).select("subject", "sure")


@query("SELECT c_name AS subject, 'Entity' AS subject_type, n_name AS object, CASE WHEN n_regionkey < 3 THEN 'Place' ELSE 'Entity' END AS object_type FROM customer JOIN nation ON c_nationkey = n_nationkey")
def endpoint_types(spark, d):
    types = _t(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("name"), F.lit("Place").alias("type"))
    return graph.endpoint_types(_customers(spark, d), types).select("subject", "subject_type", "object", "object_type")


def _canonical(spark, d):
    """Relations with nations of some regions under their region's name."""
    names = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_regionkey < 3").select(F.col("n_name").alias("alias"), F.col("r_name").alias("name"))
    return graph.canonical_ends(_customers(spark, d), names)


@query("SELECT c_name AS subject, CASE WHEN n_regionkey < 3 THEN r_name ELSE n_name END AS object FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def canonical_ends(spark, d):
    return _canonical(spark, d).select("subject", "object")


@query("SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT CASE WHEN n_regionkey < 3 THEN r_name ELSE n_name END FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def canonical_names(spark, d):
    return graph.canonical_names(_canonical(spark, d))
