"""Knowledge graph: rules for extracted entities and relations, names, validation, one-hop search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import strip

from granary.functions import profiles as P

TRIPLE = ["subject", "predicate", "object"]


def _map(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def valid_entities(entities: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    blocked = P.PRONOUNS + P.GENERIC_NAMES if blocked is None else blocked
    return entities.filter((F.length("name") >= P.MIN_NAME) & ~F.col("name").isin(blocked))


def valid_relations(relations: DataFrame, entities: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """Relations of a chunk between its valid entities, by a predicate that says something; first of equal triples."""
    names = entities.select("chunk_id", "name").distinct()
    kept = relations.filter((F.length("predicate") >= P.MIN_PREDICATE) & ~F.col("predicate").isin(P.TRIVIAL_PREDICATES if blocked is None else blocked))
    for end in ("subject", "object"):
        kept = kept.join(names.withColumnRenamed("name", end), ["chunk_id", end], "left_semi")
    return first_triples(kept, ["chunk_id", *TRIPLE])


def first_triples(relations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of equal triples the first by position."""
    w = W.partitionBy(*(keys or TRIPLE)).orderBy("pos")
    return relations.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def consistent(relations: DataFrame, male: list[str], female: list[str] | None = None, possession: list[str] | None = None) -> DataFrame:
    """Without relations in which a man comes by something that only women have."""
    held = F.lit(False)
    for w in female or P.FEMALE_KEYWORDS:
        held = held | F.contains("object", F.lit(w))
    return relations.filter(~(F.col("subject").isin(male) & F.col("predicate").isin(possession or P.POSSESSION) & held))


def entity_confidence(description: str = "description", label: str = "label", name: str = "name"):
    return F.round(F.least(F.lit(1.0), 0.5 + 0.2 * (F.length(F.coalesce(description, F.lit(""))) >= 10).cast("double") + 0.2 * (F.col(label) != "Entity").cast("double") + 0.1 * (F.length(name) >= 3).cast("double")), 6)


def relation_confidence(known, description: str = "description", subject_type: str = "subject_type", object_type: str = "object_type"):
    typed = (F.col(subject_type) != "Entity") & (F.col(object_type) != "Entity")
    return F.round(F.least(F.lit(1.0), 0.5 + 0.2 * (F.length(F.coalesce(description, F.lit(""))) >= 10).cast("double") + 0.15 * known.cast("double") + 0.15 * typed.cast("double")), 6)


def resolved_type(raw, builtin: dict[str, str] | None = None, learned: dict[str, str] | None = None):
    """The label of a raw type: an exact builtin or learned one, else one that contains it or is contained, else Entity."""
    builtin, learned = builtin or P.ENTITY_TYPES, learned or {}
    out = F.when(F.coalesce(raw, F.lit("")) == "", "Entity")
    for table in (builtin, learned):
        if table:
            out = out.when(F.try_element_at(_map(table), raw).isNotNull(), F.try_element_at(_map(table), raw))
    for table in (builtin, learned):
        for key, label in table.items():
            out = out.when(F.contains(raw, F.lit(key)) | F.contains(F.lit(key), raw), label)
    return out.otherwise("Entity")


def grown_types(occurrences: DataFrame, threshold: int = 5) -> DataFrame:
    """occurrences (pos, raw) of types that are no builtin ones: the label of each; a type is learnt at its threshold-th
    occurrence and resolves from the next one on."""
    n = F.row_number().over(W.partitionBy("raw").orderBy("pos"))
    return occurrences.withColumn("label", F.when(n > threshold, F.regexp_replace("raw", " ", "_")).otherwise("Entity"))


def normalized_predicate(raw, table: dict[str, str] | None = None):
    return F.coalesce(F.try_element_at(_map(table or P.PREDICATES), raw), raw)


def judged(relations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """relations (chunk_id, idx, subject, predicate, object, confidence, pos), verdicts (chunk_id, idx, verdict, predicate):
    valid ones stay, corrected ones change their predicate and gain 0.1, others go; a chunk without any verdict stays
    whole. First of equal triples."""
    any_ = verdicts.filter("verdict in ('valid', 'corrected')").select("chunk_id").distinct().withColumn("judged", F.lit(True))
    v = verdicts.select("chunk_id", "idx", "verdict", F.col("predicate").alias("new"))
    met = relations.join(v, ["chunk_id", "idx"], "left").join(any_, "chunk_id", "left")
    kept = met.filter("judged is null or verdict in ('valid', 'corrected')")
    fixed = F.col("verdict").eqNullSafe("corrected")
    out = kept.select("chunk_id", "idx", "subject", F.when(fixed, F.coalesce("new", "predicate")).otherwise(F.col("predicate")).alias("predicate"), "object", F.round(F.col("confidence") + F.when(fixed, 0.1).otherwise(0.0), 6).alias("confidence"), "pos")
    return first_triples(out, ["chunk_id", *TRIPLE])


def alias_of(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates (name), known (name): the canonical name: itself if known; else the shortest known name that contains it;
    else the longest it contains and outgrows by two characters at most; else itself. Names meet through their parts, not
    in a cross join: a name is cut into all its substrings of two characters and more."""
    grams = lambda df, out: df.select(F.col("name").alias(out), F.explode(F.array_distinct(F.expr("flatten(transform(sequence(1, greatest(1, length(name) - 1)), i -> transform(sequence(2, greatest(2, length(name) - i + 1)), n -> substring(name, i, n))))"))).alias("part"))
    holds = grams(known, "known").filter("part <> known").join(candidates.select(F.col("name").alias("part")).distinct(), "part").groupBy(F.col("part").alias("name")).agg(F.min(F.struct(F.length("known").alias("n"), F.col("known").alias("k"))).alias("above"))
    held = grams(candidates.distinct(), "name").filter("part <> name").join(known.select(F.col("name").alias("part")).distinct(), "part").filter("length(name) <= length(part) + 2").groupBy("name").agg(F.max(F.struct(F.length("part").alias("n"), F.col("part").alias("k"))).alias("below"))
    exact = known.select("name").distinct().withColumn("exact", F.lit(True))
    met = candidates.join(exact, "name", "left").join(holds, "name", "left").join(held, "name", "left")
    return met.select("name", F.when(F.col("exact"), F.col("name")).otherwise(F.coalesce("above.k", "below.k", "name")).alias("canonical"))


def longest_description(entities: DataFrame) -> DataFrame:
    """(canonical, description, confidence): the longest that isn't blank, ties by the text, and the greatest confidence."""
    said = F.coalesce("description", F.lit(""))
    return entities.groupBy("canonical").agg(F.max(F.struct(F.length(said).alias("n"), said.alias("d"))).alias("m"), F.max("confidence").alias("confidence")).select("canonical", F.col("m.d").alias("description"), "confidence")


def one_hop(edges: DataFrame, asked: DataFrame, entry: int = 5, most: int = 20) -> DataFrame:
    """asked (query_id, entity, pos): for each query's first `entry` entities the edges at a node that contains the name,
    each triple once, the first `most` by entity and triple. Asked names are broadcast: they are few for each query, and
    the count is checked."""
    first = asked.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).filter((F.col("n") <= entry) & (F.length("entity") >= 2))
    names = F.broadcast(first) if first.count() <= 10_000 else first
    hit = edges.join(names, F.contains("subject", F.col("entity")) | F.contains("object", F.col("entity")))
    once = hit.groupBy("query_id", *TRIPLE).agg(F.min("n").alias("n"))
    order = W.partitionBy("query_id").orderBy("n", *TRIPLE)
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("n")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); parallel edges count, and a loop counts twice."""
    return edges.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def sized(nodes: DataFrame) -> DataFrame:
    """Display sizes from 10 to 60 by degree; 25 where all are equal."""
    ends = nodes.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi")).first()
    if ends["lo"] == ends["hi"]:
        return nodes.withColumn("size", F.lit(25).cast("long"))
    return nodes.withColumn("size", F.floor(10 + (F.col("degree") - ends["lo"]) / F.lit(float(ends["hi"] - ends["lo"])) * 50).cast("long"))


def visible(edges: DataFrame, top: DataFrame) -> DataFrame:
    """Distinct edges between top nodes."""
    for end in ("subject", "object"):
        edges = edges.join(top.select(F.col("node").alias(end)), end, "left_semi")
    return edges.select(TRIPLE).distinct()


def gated(rows: DataFrame, least: float, confidence: str = "confidence") -> DataFrame:
    """rows and whether their confidence is high enough to do without a check; a missing one isn't."""
    return rows.withColumn("sure", F.coalesce(F.col(confidence) >= least, F.lit(False)))


def endpoint_types(relations: DataFrame, entities: DataFrame, default: str = "Entity") -> DataFrame:
    """relations (subject, object, ...) with subject_type and object_type, from entities (name, type), one row for each name."""
    for end in ("subject", "object"):
        own = entities.select(F.col("name").alias(f"__{end}"), F.col("type").alias(f"{end}_type"))
        relations = relations.join(own, F.col(end) == F.col(f"__{end}"), "left").drop(f"__{end}").withColumn(f"{end}_type", F.coalesce(f"{end}_type", F.lit(default)))
    return relations


def canonical_ends(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """relations with both ends replaced by their canonical names, from canonical (alias, name), one row for each alias."""
    for end in ("subject", "object"):
        own = canonical.select(F.col("alias").alias("__alias"), F.col("name").alias("__name"))
        relations = relations.join(own, F.col(end) == F.col("__alias"), "left").withColumn(end, F.coalesce("__name", end)).drop("__alias", "__name")
    return relations


def canonical_names(relations: DataFrame) -> DataFrame:
    """Each name at an end of a relation, once."""
    return relations.select(F.explode(F.array("subject", "object")).alias("name")).filter("name is not null").distinct()


def extract_inputs(sections: DataFrame, text_col: str = "text", least: int = 50, gate: int = 20, most: int = 3000) -> DataFrame:
    """Sections that are long enough to be read for entities, with what of them a model is given: as input."""
    bare = F.length(strip(F.col(text_col)))
    return sections.filter((bare >= least) & (bare >= gate)).withColumn("input", F.substring(text_col, 1, most))


def context_row(hits: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, context, score): a query's triples as lines, scored as the least of its results (0 without any), so that
    they never outrank them. hits: as of one_hop, results (query_id, score)."""
    line = F.concat(F.lit("("), "subject", F.lit(")-["), "predicate", F.lit("]->("), "object", F.lit(")"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("x"))
    least = results.groupBy("query_id").agg(F.min(F.coalesce("score", F.lit(0.0))).alias("score"))
    return rows.join(least, "query_id", "left").select("query_id", F.array_join("x.l", "\n").alias("context"), F.coalesce("score", F.lit(0.0)).alias("score"))
