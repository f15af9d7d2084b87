"""Stage tables that several queries read are made once."""

from pathlib import Path

from pyspark.sql import functions as F

from titrant.catalog.row_queries import all_rows
from titrant.catalog.stages import Stages
from titrant.operators import clean
from titrant.session import ensure_checkpoint_dir


def test_rows_and_blocks_of_a_folder_are_sectioned_and_parsed_once(spark, tmp_path):
    lines = [(o, p, o + p, n, 5.0 + n, 10.0, 0.01, 0.0, "N", "O") for o in (1, 3, 6, 11) for n, p in enumerate((0, 4, 5, 6, 11), 1)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                        "l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    rows.withColumn("l_shipdate", F.expr("timestamp'2020-01-01 00:00:00'")).write.parquet(f"{tmp_path}/lineitem.parquet")
    at = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    made = lambda label: set(at.glob(f"{label}-*"))
    before = {label: made(label) for label in ("typed", "blocks")}
    s = Stages(spark, str(tmp_path))
    counts = clean.noise_counts(all_rows(s)).collect()
    kept = s.rows.count()
    assert sum(r.raw_extracted_count - r.filtered_noise_count for r in counts) >= kept > 0 and s.blocks.count() > 0
    assert {label: len(made(label) - before[label]) for label in before} == {"typed": 1, "blocks": 1}
