"""Test-name matching: exact, alias, normalised, then closest name; topics."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from titrant.fixed.analytes import CATEGORY_TOPICS
from titrant.functions import text as tx
from titrant.session import saved
from titrant.sources.dims import entry_order

FUZZY_CUTOFF = 0.8


def dictionary(names: DataFrame) -> DataFrame:
    """Name table flattened: one row per (kind, key) with loinc, topic and the
    position `ord` that first-match rules refer to; canonical names come first."""
    numbered = names.withColumn("_entry", entry_order(names))
    exact = numbered.select(F.lit(0).alias("kind"), "_entry", F.lit(0).alias("_lang"), F.lit(0).alias("_i"),
                            F.col("canonical").alias("name"), "loinc", "topic")
    alias = (numbered.select("_entry", "loinc", "topic", F.posexplode(F.map_entries("aliases")).alias("_lang", "e"))
             .select(F.lit(1).alias("kind"), "_entry", "_lang", "loinc", "topic",
                     F.posexplode("e.value").alias("_i", "name"))
             .select("kind", "_entry", "_lang", "_i", "name", "loinc", "topic"))
    keyed = exact.unionByName(alias).withColumn("key", F.when(F.col("kind") == 0, F.lower("name")).otherwise(tx.raw_key(F.col("name"))))
    pos = F.struct("_entry", "_lang", "_i")
    # a repeated key keeps its first place but takes the later entry's code
    return keyed.groupBy("kind", "key").agg(
        F.min(pos).alias("ord"), F.max_by("loinc", pos).alias("loinc"),
        F.max_by("topic", pos).alias("last_topic"), F.min_by("topic", pos).alias("first_topic"),
    ).withColumn("norm", tx.normal_name(F.col("key")))


def exact_keys(words: DataFrame) -> DataFrame:
    """key -> loinc and confidence; a canonical name beats an alias."""
    best = words.groupBy("key").agg(F.min_by(F.struct("loinc", "kind"), "kind").alias("b"))
    return best.select(F.col("key").alias("raw_key"), F.col("b.loinc").alias("exact_loinc"),
                       F.when(F.col("b.kind") == 0, "high").otherwise("medium").alias("exact_conf"))


def normal_keys(words: DataFrame) -> DataFrame:
    """Normalised name -> loinc of the first dictionary entry that has it."""
    return words.groupBy(F.col("norm").alias("norm_key")).agg(
        F.min_by("loinc", F.struct("kind", "ord")).alias("norm_loinc"))


def topic_keys(names: DataFrame) -> DataFrame:
    """key -> topic over raw and normalised names.  Canonical names beat
    aliases; of equal canonicals the last holds, of equal aliases the first."""
    numbered = names.filter(F.coalesce("topic", F.lit("")) != "").withColumn("_entry", entry_order(names))
    exact = numbered.select(F.lit(0).alias("kind"), F.struct((-F.col("_entry")).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("pos"),
                            F.col("canonical").alias("name"), "topic")
    alias = (numbered.select("_entry", "topic", F.posexplode(F.map_entries("aliases")).alias("_lang", "e"))
             .select("_entry", "_lang", "topic", F.posexplode("e.value").alias("_i", "name"))
             .select(F.lit(1).alias("kind"), F.struct(F.col("_entry").alias("a"), F.col("_lang").alias("b"), F.col("_i").alias("c")).alias("pos"),
                     "name", "topic"))
    both = exact.unionByName(alias)
    keys = both.select("kind", "pos", "topic", F.explode(F.array(tx.raw_key(F.col("name")), tx.normal_name(F.col("name")))).alias("key"))
    return keys.filter("key <> ''").groupBy("key").agg(
        F.min_by("topic", F.struct("kind", "pos")).alias("topic"))


@F.pandas_udf(DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings, 0 when it cannot reach the cutoff."""
    out = []
    for x, y in zip(a, b):
        m = SequenceMatcher(None, x, y)
        out.append(m.ratio() if m.quick_ratio() >= FUZZY_CUTOFF else 0.0)
    return pd.Series(out, dtype="float64")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Edit-distance similarity, the variant plain SQL can reproduce."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def closest_names(unmatched: DataFrame, words: DataFrame, similarity=ratcliff_ratio) -> DataFrame:
    """Best dictionary entry at or above the cutoff per normalised name.

    A similarity of 0.8 needs lengths within a factor of 1.5, so every
    dictionary entry is listed under each length it can match and candidates
    come from an equality join on length.
    """
    entries = words.select(
        F.col("norm"), F.col("loinc").alias("near_loinc"), F.struct("kind", "ord").alias("pos"),
        F.explode(F.sequence(F.ceil(F.length("norm") * 2 / 3).cast("int"),
                             F.floor(F.length("norm") * 3 / 2).cast("int"))).alias("_len")).filter("length(norm) > 0")
    pairs = unmatched.withColumn("_len", F.length("norm_key")).join(entries, "_len")
    scored = pairs.withColumn("score", similarity(F.col("norm_key"), F.col("norm"))).filter(F.col("score") >= FUZZY_CUTOFF)
    return scored.groupBy("norm_key").agg(
        F.min_by(F.struct("near_loinc", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("b")
    ).select("norm_key", "b.near_loinc", F.col("b.score").alias("near_score"))


def match_names(names: DataFrame, table: DataFrame, similarity=ratcliff_ratio) -> DataFrame:
    """Cascade over distinct names (column test_name): loinc_code, match_conf and
    the step that decided.  Only names no key reaches are scored."""
    words = dictionary(table)
    keyed = names.select("test_name", tx.raw_key(F.col("test_name")).alias("raw_key"),
                         tx.normal_name(F.col("test_name")).alias("norm_key"))
    looked = (keyed.join(exact_keys(words), "raw_key", "left")
              .join(normal_keys(words), "norm_key", "left"))
    unmatched = (looked.filter(F.col("exact_loinc").isNull() & F.col("norm_loinc").isNull())
                 .select("norm_key").distinct())
    full = looked.join(closest_names(unmatched, words, similarity), "norm_key", "left")
    return full.select(
        "test_name", "raw_key", "norm_key",
        F.coalesce("exact_loinc", "norm_loinc", "near_loinc").alias("loinc_code"),
        F.when(F.col("exact_loinc").isNotNull(), F.col("exact_conf"))
        .when(F.col("norm_loinc").isNotNull(), "medium").otherwise("low").alias("match_conf"),
        F.when(F.col("exact_loinc").isNotNull(), F.when(F.col("exact_conf") == "high", "exact").otherwise("alias"))
        .when(F.col("norm_loinc").isNotNull(), "normalised")
        .when(F.col("near_loinc").isNotNull(), "fuzzy").otherwise("none").alias("match_step"))


def add_topics(matched: DataFrame, table: DataFrame, categories: DataFrame) -> DataFrame:
    """Health topic per matched name: by code, raw name, normalised name, family
    category, else other; the last two count as inferred."""
    by_code = (table.filter(F.coalesce("topic", F.lit("")) != "").withColumn("_n", entry_order(table))
               .groupBy(F.col("loinc").alias("loinc_code")).agg(F.max_by("topic", "_n").alias("_t1")))
    keys = topic_keys(table)
    joined = (matched.join(by_code, "loinc_code", "left")
              .join(keys.select(F.col("key").alias("raw_key"), F.col("topic").alias("_t2")), "raw_key", "left")
              .join(keys.select(F.col("key").alias("norm_key"), F.col("topic").alias("_t3")), "norm_key", "left")
              .join(categories, "loinc_code", "left"))
    known = F.coalesce("_t1", "_t2", "_t3")
    by_category = F.element_at(tx.literal_map(CATEGORY_TOPICS.items()), F.coalesce("category", F.lit("")))
    return joined.select(*matched.columns,
                         F.coalesce(known, by_category, F.lit("other")).alias("health_topic"),
                         known.isNull().alias("topic_inferred"))


def add_qualitative_by_name(matched: DataFrame, qualitative: DataFrame) -> DataFrame:
    """Qualitative rule of names that equal an assay's own name."""
    rule = F.struct(*[c for c in qualitative.columns if c != "loinc_code"]).alias("name_qual")
    by_name = qualitative.select(F.col("qual_name").alias("raw_key"), rule)
    return matched.join(by_name, "raw_key", "left")


def name_dimension(rows: DataFrame, table: DataFrame, categories: DataFrame, qualitative: DataFrame,
                   similarity=ratcliff_ratio) -> DataFrame:
    """Match every distinct name of a row table once and keep the result."""
    # kept first: filters on the keys would else run their patterns on every row
    distinct = saved(rows.select("test_name").distinct(), "distinct_names")
    matched = add_topics(match_names(distinct, table, similarity), table, categories)
    return saved(add_qualitative_by_name(matched, qualitative), "names")
