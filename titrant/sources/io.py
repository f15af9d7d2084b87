"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from titrant.fixed import lexicons as lx

LOINC_COLUMNS = {  # output name -> column of the published table
    "loinc_code": "LOINC_NUM", "component": "COMPONENT", "long_common_name": "LONG_COMMON_NAME", "short_name": "SHORTNAME",
    "property": "PROPERTY", "system": "SYSTEM", "scale_type": "SCALE_TYP", "class_field": "CLASS", "consumer_name": "CONSUMER_NAME",
}
TARGET_CLASSES = ["CHEM", "HEM/BC", "UA", "SERO"]


def select_lab_tests(table: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Active laboratory entries.  With a code list, a code outside it stays
    only when its class is one of the target classes."""
    live = table.filter((F.col("STATUS") == "ACTIVE") & (F.col("CLASSTYPE").cast("string") == "1"))
    if codes is not None:
        listed = codes.select(F.col("loinc_code").alias("LOINC_NUM"), F.lit(True).alias("_listed")).distinct()
        live = live.join(listed, "LOINC_NUM", "left").filter(F.col("_listed") | F.col("CLASS").isin(*TARGET_CLASSES))
    return live.select(*[F.coalesce(F.col(src), F.lit("")).alias(out) for out, src in LOINC_COLUMNS.items()])


def read_lab_tests(spark: SparkSession, path: str, codes: DataFrame | None = None) -> DataFrame:
    return select_lab_tests(spark.read.csv(path, header=True), codes)


def upsert(old: DataFrame, new: DataFrame, key: str, newest: Column) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key; of several new
    rows for a key the newest holds."""
    whole = F.struct(*new.columns)
    latest = new.groupBy(key).agg(F.max_by(whole, newest).alias("_r")).select("_r.*")
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


_ENTRY = "struct<title:struct<_value:string>,summary:struct<_value:string>,link:array<struct<href:string>>>"


def education_documents(files: DataFrame, batch: int = 50) -> DataFrame:
    """Education entries from (path, content) rows of `{loinc}-{lang}.json`
    files: one document per entry with text, clipped to 4000 characters."""
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    doc = F.from_json("content", f"struct<_language:string,feed:struct<entry:array<{_ENTRY}>>>")
    a = files.select(F.regexp_extract(stem, r"^(.*)-([^-]*)$", 1).alias("loinc_code"),
                     F.regexp_extract(stem, r"^(.*)-([^-]*)$", 2).alias("language"), doc.alias("d")).filter("loinc_code <> ''")
    e = a.select("loinc_code", "language",
                 F.when(F.coalesce("d._language", F.lit("")) != "", "machine-translated").otherwise("original").alias("provenance"),
                 F.posexplode("d.feed.entry").alias("i", "e"))
    return education_fields(e.select("loinc_code", "language", "provenance", "i", F.col("e.title._value").alias("title"),
                                     F.col("e.summary._value").alias("summary"), F.try_element_at("e.link", F.lit(1)).href.alias("url")))


def education_fields(entries: DataFrame) -> DataFrame:
    """Document id, text and clipping of education entries; empty texts go."""
    return (entries.withColumn("text", F.btrim(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit(""))), F.lit(" \t\r\n")))
            .filter("text <> ''")
            .select(F.concat_ws("-", F.lit("medlineplus"), "loinc_code", "language", F.col("i").cast("string")).alias("id"),
                    "loinc_code", F.coalesce("title", F.lit("")).alias("test_name"), F.lit("overview").alias("content_type"), "language",
                    F.lit("medlineplus").alias("source"), "provenance", F.substring("text", 1, 4000).alias("text"),
                    F.coalesce("url", F.lit("")).alias("url")))


def read_education(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()).withColumnRenamed("value", "content")
    return education_documents(files)


def write_vectors(docs: DataFrame, path: str, per_batch: int = 50) -> None:
    """Write documents with `batch`, the number of a group of at most
    `per_batch` records, so that a loader can send them group by group."""
    docs.withColumn("batch", F.floor(F.monotonically_increasing_id() / per_batch)).write.mode("append").parquet(path)


def export_value() -> Column:
    return F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))


def export_frame(rows: DataFrame, columns=tuple(lx.EXPORT_COLUMNS), keys: tuple = ("report_id",)) -> DataFrame:
    """Export columns in their fixed order; a missing state reads `classified`."""
    named = rows.withColumns({
        "value": export_value(), "reference_range_low": F.col("rng_low"), "reference_range_high": F.col("rng_high"),
        "unit_confidence": F.col("unit_conf"),
        "classification_state": F.coalesce("classification_state", F.lit("classified"))})
    return named.select(*keys, *columns)


def write_csv(rows: DataFrame, path: str, columns=tuple(lx.EXPORT_COLUMNS)) -> None:
    export_frame(rows, columns).write.mode("overwrite").option("header", True).csv(path)


def read_truth(spark: SparkSession, path: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """Ground-truth or output documents, one JSON document per file or line."""
    return spark.read.schema(schema).json(path, multiLine=one_per_file).withColumn("source_file", F.input_file_name())


def read_documents(spark: SparkSession, path: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """JSON documents with doc_id, source_file and broken, the text of a document that
    could not be read (null for the others).  doc_id is the file's name without its ending,
    or of documents in lines their field `doc_id`."""
    fields = schema if one_per_file else f"doc_id string, {schema}"
    read = spark.read.schema(f"{fields}, broken string").option("columnNameOfCorruptRecord", "broken").json(path, multiLine=one_per_file)
    file = F.input_file_name()
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    return read.withColumn("source_file", file).withColumn("doc_id", name if one_per_file else F.col("doc_id"))


TRUTH_ROW = ("struct<test_name:string,value:string,unit:string,reference_range_low:double,reference_range_high:double,"
             "flag:string,section_type:string>")
EXTRACTION_TRUTH = (f"archetype string, expected_values array<{TRUTH_ROW}>, "
                    "expected_screening array<struct<test_type:string,result_status:string>>, "
                    "expected_hplc array<struct<diabetes_category:string>>")
EXTRACTION_OUTPUT = (f"values array<{TRUTH_ROW}>, screening_results array<struct<test_type:string,result_status:string>>, "
                     "audit struct<hplc_blocks:array<struct<diabetes_category:string>>>")
INTERPRETATION_TRUTH = ("report_id string, variant_type string, values array<struct<test_name:string,loinc_code:string,value:string,"
                        "unit:string,reference_range_low:double,reference_range_high:double,expected_direction:string,"
                        "expected_severity:string,expected_actionability:string,expected_confidence:string,"
                        "expected_confidence_downgrade:boolean>>")
