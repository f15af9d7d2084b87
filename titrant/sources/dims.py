"""Reference dimensions as DataFrames.

Each builder has a default made from the fixed tables; each reader loads a
caller's own table from JSON files with an explicit schema.  All dimensions are
small local relations, so the optimizer sees their true size and picks
broadcast joins by itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titrant.fixed import analytes as fa, families as ff, qualitative as fq, units as fu, safety as fs, names as fn
from titrant.fixed.numeric_rules import NUMERIC_RULES

# Bands are probed from the most severe to the least.
BAND_ORDER = ["critical_low", "critical_high", "moderate_low", "moderate_high", "mild_low", "mild_high", "normal"]
TIER = {b: b.split("_")[0] for b in BAND_ORDER}

RULE_SCHEMA = (
    "loinc_code string, test_name string, unit string, "
    "reference_ranges array<struct<sex:string,low:double,high:double,source:string>>, "
    "severity_bands array<struct<band:string,low:double,high:double>>, "
    "panic_low double, panic_high double")
ALIAS_SCHEMA = (
    "ord bigint, loinc string, canonical string, topic string, aliases map<string,array<string>>")
CONVERSION_SCHEMA = (
    "loinc_code string, canonical_unit string, factors array<struct<from_unit:string,factor:double>>")
FAMILY_SCHEMA = (
    "ord bigint, family string, loinc_codes array<string>, value_low double, value_high double, "
    "range_low double, range_high double, category string")


def _table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema=schema)


# ---- defaults ------------------------------------------------------------

def numeric_rules(spark: SparkSession) -> DataFrame:
    return _table(spark, [dict(
        loinc_code=code, test_name=name, unit=unit,
        reference_ranges=[dict(sex=s, low=float(lo), high=float(hi), source=src) for s, lo, hi in ranges],
        severity_bands=[dict(band=b, low=float(v[0]), high=float(v[1])) for b, v in bands.items()],
        panic_low=None, panic_high=None) for code, name, unit, ranges, bands, src in NUMERIC_RULES], RULE_SCHEMA)


def name_table(spark: SparkSession) -> DataFrame:
    return _table(spark, [dict(ord=n, loinc=code, canonical=canonical, topic=topic, aliases=list(fn.names_of(code).items()))
                          for n, (code, canonical, topic) in enumerate(fa.ANALYTES)], ALIAS_SCHEMA)


def unit_conversions(spark: SparkSession) -> DataFrame:
    return _table(spark, [dict(loinc_code=c, canonical_unit=u, factors=[dict(from_unit=f, factor=float(x)) for f, x in fs_])
                          for c, u, fs_ in fu.UNIT_CONVERSIONS], CONVERSION_SCHEMA)


def families(spark: SparkSession) -> DataFrame:
    return _table(spark, [dict(ord=k, family=n, loinc_codes=codes, value_low=float(v[0]), value_high=float(v[1]),
                               range_low=float(r[0]), range_high=float(r[1]), category=cat)
                          for k, (n, codes, v, r, cat) in enumerate(ff.FAMILIES)], FAMILY_SCHEMA)


def human_bounds(spark: SparkSession) -> DataFrame:
    return _table(spark, [dict(loinc_code=k, human_low=lo, human_high=hi) for k, (lo, hi) in fu.HUMAN_BOUNDS.items()],
                  "loinc_code string, human_low double, human_high double")


QUAL_SCHEMA = (
    "loinc_code string, qual_name string, category string, positive_direction string, negative_direction string, "
    "severity_positive string, action_positive string, severity_abnormal string, action_abnormal string, "
    "threshold double, normal_values array<string>, grades map<string,string>, action_grade string, "
    "normal_status string, abnormal_status string, context string")


def qualitative_rules(spark: SparkSession) -> DataFrame:
    def row(code, r):
        positive = r["category"] == "expected_positive"
        return dict(
            loinc_code=code, qual_name=r["test_name"].lower(), category=r["category"],
            positive_direction=r.get("positive_direction", "in-range" if positive else "high"),
            negative_direction=r.get("negative_direction", "high" if positive else "in-range"),
            severity_positive=r.get("severity_when_positive", "moderate"),
            action_positive=r.get("actionability_when_positive", "follow-up"),
            severity_abnormal=r.get("severity_when_abnormal", "mild"),
            action_abnormal=r.get("actionability_when_abnormal", "follow-up"),
            threshold=r.get("titer_positive_threshold"), normal_values=r.get("normal_values", ["negative"]),
            grades=list(r.get("grade_severity", {}).items()), action_grade=r.get("actionability_threshold", "1+"),
            normal_status=r.get("normal_status", "normal"), abnormal_status=r.get("abnormal_status", "abnormal"),
            context=r.get("explanation_context", ""))
    return _table(spark, [row(c, r) for c, r in fq.QUALITATIVE_RULES.items()], QUAL_SCHEMA)


def panels(spark: SparkSession) -> DataFrame:
    return _table(spark, [dict(panel_name=n, expected=sorted(codes)) for n, codes in fa.PANELS],
                  "panel_name string, expected array<string>")


def symptom_phrases(spark: SparkSession) -> DataFrame:
    return _table(spark, [dict(lang=lang, phrases=[p.lower() for p in words]) for lang, words in fs.ACUTE_SYMPTOMS.items()],
                  "lang string, phrases array<string>")


# ---- readers (of rules and lexicons: sources.files) ------------------------

def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The full multilingual name table: ord (place in the table), loinc, canonical, topic, aliases by language."""
    return spark.read.schema(ALIAS_SCHEMA).json(path)


def read_unit_conversions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONVERSION_SCHEMA).json(path)


def read_families(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAMILY_SCHEMA).json(path)


# ---- combined ------------------------------------------------------------

def rule_struct(rules: DataFrame) -> DataFrame:
    """One row per code with the rule folded into a struct the interpreter reads:
    first range, band `normal`, and the bands in probing order."""
    order = F.array(*[F.lit(b) for b in BAND_ORDER])
    band = F.transform("severity_bands", lambda b: F.struct(
        F.array_position(order, b.band).alias("prio"), b.band.alias("band"),
        F.split_part(b.band, F.lit("_"), F.lit(1)).alias("tier"), b.low.alias("low"), b.high.alias("high")))
    normal = F.try_element_at(F.filter("severity_bands", lambda b: b.band == "normal"), F.lit(1))
    first = F.try_element_at("reference_ranges", F.lit(1))
    return rules.select("loinc_code", F.struct(
        F.col("test_name"), F.lower(F.trim("unit")).alias("unit"),
        first.low.alias("first_low"), first.high.alias("first_high"), first.source.alias("source"),
        normal.low.alias("normal_low"), normal.high.alias("normal_high"),
        F.col("severity_bands").isNotNull().alias("has_bands"), F.array_sort(band).alias("bands"),
        F.col("panic_low"), F.col("panic_high")).alias("rule"))


def analytes(spark: SparkSession, rules: DataFrame | None = None, conversions: DataFrame | None = None,
             fams: DataFrame | None = None, human: DataFrame | None = None, qualitative: DataFrame | None = None) -> DataFrame:
    """Every LOINC-keyed dimension in one row per code, so that enrichment and
    interpretation need a single join."""
    fam = fams if fams is not None else families(spark)
    exploded = fam.select(F.explode("loinc_codes").alias("loinc_code"), "family", "category", F.struct(
        "value_low", "value_high", "range_low", "range_high").alias("span"))
    by_code = exploded.groupBy("loinc_code").agg(F.collect_list("span").alias("families"))
    category = last_category(fam)
    conv = (conversions if conversions is not None else unit_conversions(spark)).select(
        "loinc_code", F.struct("canonical_unit", "factors").alias("conv"))
    hum = (human if human is not None else human_bounds(spark)).select(
        "loinc_code", F.struct("human_low", "human_high").alias("human"))
    qual = qualitative if qualitative is not None else qualitative_rules(spark)
    qual = qual.select("loinc_code", F.struct(*[c for c in qual.columns if c != "loinc_code"]).alias("qual"))
    out = rule_struct(rules if rules is not None else numeric_rules(spark))
    for dim in (conv, hum, by_code, category, qual):
        out = out.join(dim, "loinc_code", "full_outer")
    return out


def entry_order(table: DataFrame):
    """Place of an entry in its table: its `ord`, whatever files it was split into.
    Entries without one have a fixed but arbitrary order."""
    usual = F.xxhash64(*[c for c in table.columns if not table.schema[c].dataType.typeName() == "map"])
    return F.coalesce(F.col("ord"), usual) if "ord" in table.columns else usual


def last_category(fams: DataFrame) -> DataFrame:
    """Category per code; of several families the last in order holds."""
    numbered = fams.withColumn("_n", entry_order(fams))
    return (numbered.select("_n", "category", F.explode("loinc_codes").alias("loinc_code"))
            .groupBy("loinc_code").agg(F.max_by("category", "_n").alias("category")))
