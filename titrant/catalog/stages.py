"""Stage tables over a driver folder, built once per session and folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from titrant.catalog.labview import POSITIONS_PER_PAGE, lab_rows
from titrant.operators import names, rollup, sections
from titrant.plans import reports
from titrant.session import saved


class Stages:
    """Stages that later ones read whole are written once as tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.know = reports.knowledge(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lab(self) -> DataFrame:
        return lab_rows(self.spark, self.sf_dir)

    @cached_property
    def sect(self) -> DataFrame:
        return sections.assign_blocks(self.lab, POSITIONS_PER_PAGE)

    @cached_property
    def cleaned(self) -> reports.Cleaned:
        return reports.clean_rows(self.lab, split=self.sect)

    @cached_property
    def rows(self) -> DataFrame:
        return saved(self.cleaned.rows, "rows")

    @property
    def blocks(self) -> DataFrame:
        return self.cleaned.blocks

    @cached_property
    def names(self) -> DataFrame:
        k = self.know
        return names.name_dimension(self.rows, k.aliases, k.categories, k.qualitative)

    @cached_property
    def enriched(self) -> DataFrame:
        # not kept: its dimension structs are wide, and each reader needs a few columns
        return reports.enrich_rows(self.rows, self.know, self.blocks, self.names)

    @cached_property
    def interpreted(self) -> DataFrame:
        return reports.kept_interpretation(self.enriched)

    @cached_property
    def marked(self) -> DataFrame:
        return reports.kept_marks(self.interpreted)

    @property
    def canonical(self) -> DataFrame:
        return rollup.canonical_rows(self.marked)

    @cached_property
    def rolled(self) -> reports.RolledUp:
        return reports.roll_up(self.interpreted, self.know, self.marked)


_held: dict = {}


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        _held[key] = Stages(spark, sf_dir)
    return _held[key]
