"""A directory of entities: names, links to memories, merges that can be undone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.vector_search import near_pairs

#: Weight of a new link, and what a further mention adds. Fixed values.
FIRST, AGAIN = 1.0, 0.2
#: Merges are followed so many steps.
STEPS = 10


def interned(mentions: DataFrame) -> DataFrame:
    """memory, name, type -> entity, name, type: one row a normalised name.

    Names are trimmed and in lower case; blank ones are rejected, a blank type is OTHER.
    An entity's number is the first memory that mentions it, its type that mention's
    (the least of several), so the result doesn't depend on the order of rows.
    """
    name = F.lower(F.trim("name"))
    rows = mentions.where(F.col("name").isNotNull() & (F.trim("name") != ""))
    kind = F.when(F.trim(F.coalesce("type", F.lit(""))) == "", F.lit("OTHER")).otherwise(F.col("type"))
    first = rows.groupBy(name.alias("name")).agg(F.min(F.struct(F.col("memory").alias("m"), kind.alias("t"))).alias("f"))
    return first.select(F.col("f.m").alias("first_memory"), "name", F.col("f.t").alias("type"))


def linked(mentions: DataFrame) -> DataFrame:
    """name, memory, weight: a link for each entity and memory, stronger with each mention."""
    rows = mentions.where(F.col("name").isNotNull() & (F.trim("name") != ""))
    found = rows.groupBy(F.lower(F.trim("name")).alias("name"), "memory").agg(F.count("*").alias("n"))
    return found.select("name", "memory", (F.lit(FIRST) + AGAIN * (F.col("n") - 1)).alias("weight"))


def resolved(merges: DataFrame, steps: int = STEPS) -> DataFrame:
    """entity, into -> entity, canonical: each merge followed to its end, so many steps at most.

    Merges are a forest of short chains; the table of merges is far smaller than the links.
    """
    found = merges.select("entity", F.col("into").alias("canonical"))
    nexts = merges.select(F.col("entity").alias("canonical"), F.col("into").alias("further"))
    for _ in range(steps - 1):
        found = found.join(nexts, "canonical", "left").select("entity", F.coalesce("further", "canonical").alias("canonical"))
    return found


def merged_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """The links (entity, memory, weight) with merged entities' memories at their canonical
    ones: a memory that the canonical entity has already is reinforced, once for each
    entity that brings it."""
    end = resolved(merges)
    rows = links.join(end, "entity", "left").withColumn("own", F.col("canonical").isNull()).withColumn("to", F.coalesce("canonical", "entity"))
    found = rows.groupBy(F.col("to").alias("entity"), "memory").agg(F.max(F.when(F.col("own"), F.col("weight"))).alias("weight"), F.sum(F.when(F.col("own"), 0).otherwise(1)).alias("more"))
    return found.select("entity", "memory", F.when(F.col("weight").isNull(), F.lit(FIRST) + AGAIN * (F.col("more") - 1)).otherwise(F.col("weight") + AGAIN * F.col("more")).alias("weight"))


def unmerged(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """The merges without those of the given entities; what they resolved through follows."""
    return merges.join(entities.select("entity"), "entity", "left_anti")


def decayed_links(links: DataFrame, factor: float, least: float) -> DataFrame:
    """Links weaken by the factor; those below the least go."""
    return links.withColumn("weight", F.col("weight") * factor).where(F.col("weight") >= least)


def similar_entities(entities: DataFrame, centres: np.ndarray, cosine: float = 0.85, adjudicate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """keep, drop, similarity: entities of one type whose vectors are that alike; the
    shorter name stays, the smaller id of equal ones.

    entities: id, name, type, vector (of length one, so that a cosine is a distance).
    ``adjudicate`` gets the pairs and returns those to merge; all are without it.
    """
    pairs = near_pairs(entities.select("id", "vector"), float(np.sqrt(max(0.0, 2 - 2 * cosine))), centres)
    a = entities.select(F.col("id").alias("a"), F.col("name").alias("an"), F.col("type").alias("at"))
    b = entities.select(F.col("id").alias("b"), F.col("name").alias("bn"), F.col("type").alias("bt"))
    rows = pairs.join(a, "a").join(b, "b").where("at = bt")
    first = F.length("an") <= F.length("bn")
    found = rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"), F.round(1 - F.col("distance") * F.col("distance") / 2, 4).alias("similarity"))
    return adjudicate(found) if adjudicate else found
