"""Staged builds: which stages are out of date, what is left to do, and state that survives interruption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAGES = {"chunks": [], "summary_tree": ["chunks"], "bm25": ["summary_tree"], "vector": ["summary_tree"], "graph": []}


def dirty(done: dict[str, bool], enabled: dict[str, bool] | None = None, stages: dict[str, list[str]] = STAGES) -> set[str]:
    """Stages that must run: those not done, and all that depend on one of them; disabled ones never do."""
    out: set[str] = set()
    for stage, needs in stages.items():  # in order of dependence
        if (enabled or {}).get(stage, True) and (not done.get(stage, False) or out & set(needs)):
            out.add(stage)
    return out


def downstream(stage: str, stages: dict[str, list[str]] = STAGES) -> list[str]:
    """stage and all that depend on it."""
    out = [stage]
    for s, needs in stages.items():
        if set(needs) & set(out) and s not in out:
            out.append(s)
    return out


def latest(states: DataFrame) -> DataFrame:
    """states (chunk_id, text_hash, status, updated_at): the last of each chunk; ties by status."""
    w = W.partitionBy("chunk_id").orderBy(F.col("updated_at").desc(), F.col("status"))
    return states.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def pending(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """chunks (chunk_id, text) not completed with the text they have now."""
    finished = latest(states).filter("status = 'completed'").select("chunk_id", "text_hash")
    return chunks.withColumn("text_hash", F.md5("text")).join(finished, ["chunk_id", "text_hash"], "left_anti")


def segments(nodes: DataFrame, size: int = 256, group: str = "file", order: str = "node_no") -> DataFrame:
    """Consecutive segments of `size` nodes within each group."""
    return nodes.withColumn("segment", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / size).cast("long"))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)
