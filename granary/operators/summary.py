"""The summary tree in its offline form: leaf, subsection, section and book summaries cut from the texts below them.

chunks: (chunk_idx, node_id, file, section, subsection, text). Summaries: (node_id, level, text, child_ids, chunk_lo,
chunk_hi, file, section, subsection); child_ids hold chunks at every level. Groups never gather whole texts: a summary is
the first LIMIT characters of its children's texts in order, so only as much of each is carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAF, LIMIT = 100, 200
COLUMNS = ["node_id", "level", "text", "child_ids", "chunk_lo", "chunk_hi", "file", "section", "subsection"]


def leaves(chunks: DataFrame) -> DataFrame:
    own = chunks.select(F.concat(F.lit("summary_leaf_"), "node_id").alias("node_id"), F.lit(1).alias("level"), F.concat(F.substring("text", 1, LEAF), F.lit("...")).alias("text"), F.array("node_id").alias("child_ids"), F.col("chunk_idx").alias("chunk_lo"), F.col("chunk_idx").alias("chunk_hi"), "file", "section", "subsection", F.substring("text", 1, LIMIT).alias("source"))
    return own.select(*COLUMNS, "source")


def _rolled(below: DataFrame, keys: list[str], level: int, text: str) -> DataFrame:
    """One summary for each group of keys. text: the column whose values, in order of chunks, are joined and cut."""
    part = F.array_sort(F.collect_list(F.struct("chunk_lo", "node_id", F.substring(text, 1, LIMIT).alias("t"), "child_ids")))
    group = below.groupBy(*keys).agg(part.alias("parts"), F.min("chunk_lo").alias("chunk_lo"), F.max("chunk_hi").alias("chunk_hi"))
    others = [F.lit("").alias(c) for c in ("file", "section", "subsection") if c not in keys]
    joined = F.array_join(F.filter(F.col("parts.t"), lambda t: t != ""), "\n\n")
    return group.select(F.format_string(f"summary_L{level}_%d_%d", "chunk_lo", "chunk_hi").alias("node_id"), F.lit(level).alias("level"), F.concat(F.substring(joined, 1, LIMIT), F.lit("...")).alias("text"), F.flatten("parts.child_ids").alias("child_ids"), "chunk_lo", "chunk_hi", *keys, *others).select(COLUMNS)


def subsections(leaves_: DataFrame) -> DataFrame:
    return _rolled(leaves_, ["file", "section", "subsection"], 2, "source")


def section_summaries(level2: DataFrame) -> DataFrame:
    """Of every section but those whose only part is the one without a subsection."""
    many = level2.groupBy("file", "section").agg(F.count("*").alias("n"), F.max("subsection").alias("last")).filter((F.col("n") > 1) | (F.col("last") != ""))
    return _rolled(level2.join(many.select("file", "section"), ["file", "section"], "left_semi"), ["file", "section"], 3, "text")


def chapter_level(level2: DataFrame, level3: DataFrame) -> DataFrame:
    """Section summaries, and subsection summaries of sections without one or without a subsection."""
    bare = level2.join(level3.select("file", "section"), ["file", "section"], "left_anti").unionByName(level2.filter("subsection = ''"))
    return level3.unionByName(bare.dropDuplicates(["file", "section", "subsection"]))


def book(chapters: DataFrame) -> DataFrame:
    """One summary of each file that has more than one chapter."""
    many = chapters.groupBy("file").count().filter("count > 1").select("file")
    return _rolled(chapters.join(many, "file", "left_semi"), ["file"], 4, "text")


def tree(chunks: DataFrame) -> DataFrame:
    """All levels. A file of one chunk has its leaf only."""
    one = leaves(chunks)
    grown = one.join(chunks.groupBy("file").count().filter("count > 1").select("file"), "file", "left_semi").select(*COLUMNS, "source")
    two = subsections(grown)
    three = section_summaries(two)
    return one.select(COLUMNS).unionByName(two).unionByName(three).unionByName(book(chapter_level(two, three)))


def batches(chunks: DataFrame, size: int = 5) -> DataFrame:
    """Batch numbers of consecutive chunks within their file."""
    return chunks.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("file").orderBy("chunk_idx")) - 1) / size))


def section_counts(chunks: DataFrame) -> DataFrame:
    """For each file: chunks, distinct sections (an empty name is one), and distinct named subsections within them."""
    named = F.when(F.col("subsection") != "", F.struct(F.coalesce("section", F.lit("")), "subsection"))
    return chunks.groupBy("file").agg(F.count("*").alias("chunks"), F.countDistinct(F.coalesce("section", F.lit(""))).alias("sections"), F.countDistinct(named).alias("subsections"))


def fallback_report(nodes: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """How many summaries are cut texts (column fallback), and the ids of the first of them."""
    own = nodes.filter("fallback")
    first = own.orderBy(*order, "node_id").limit(most).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "node_id"))), lambda x: x["node_id"]), ",").alias("first_ids"))
    return own.groupBy().agg(F.count("*").alias("fallbacks")).crossJoin(first)


def covering(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, chunk_idx): the chunks within each summary's range, both ends included."""
    wide = nodes.select("node_id", F.explode(F.sequence("chunk_lo", "chunk_hi")).alias("chunk_idx"))
    return wide.join(chunks.select("chunk_idx").distinct(), "chunk_idx").select("node_id", "chunk_idx")
