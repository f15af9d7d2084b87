"""Operator 13: whitening of embeddings with MLlib block matrices.

Entries become whole numbers x = floor(256 c).  Each distinct x vector counts
once in the fit.  Its rows, less their mean, are indexed and cut into blocks of a
BlockMatrix; transpose times itself gives the scatter, whose eigenvectors are
taken on the driver (d by d).  The rows of all vectors, indexed likewise, are
projected by a block product with the whitening matrix (d by 4).  The middle
dimension of the scatter is split, so that no task meets more than SPLIT_BLOCKS
blocks of each side; only sums of d by d travel on.

Sums and deviations are whole numbers of up to 38 digits, exact.  Vectors go
from DataFrame to MLlib inside the JVM.

Defined results: vectors that are null, empty or hold null or non-finite
entries have no rows.  Vectors of different lengths are whitened apart, each length with its own n.
Components whose share of the variance is under 1e-12 have no rows (equal
vectors, or fewer distinct ones than components), nor then does a fit of one vector.  Rows that repeat a vec_id
each have theirs.  A deviation beyond 63 bits is null.  Columns other than vec_id and
embedding are ignored.  No vectors give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titrant.session import saved

COMPONENTS, SCALE = 4, 256
BLOCK_ROWS, SPLIT_BLOCKS = 1024, 8
#: Share of the variance from which a component counts as one.
LEAST_SHARE = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the sound rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    sound = F.expr("size(c) > 0 and forall(c, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))")
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.expr(f"transform(c, v -> floor({SCALE} * v) + 0L)").alias("x"))


def indexed(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table with `index`, 0, 1, 2 and so on."""
    kept = saved(rows.withColumn("_m", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per written part
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r.n
    base = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    return kept.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn("index", F.col("_start") + place).drop("_m", "_p", "_start")


def block_matrix(rows: DataFrame, mean: list[float]) -> BlockMatrix:
    """x less the mean, by `index`."""
    centred = F.zip_with(F.col("x"), F.lit(mean), lambda v, m: v.cast("double") - m)
    frame = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(frame).toBlockMatrix(BLOCK_ROWS, BLOCK_ROWS)


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right, the sum over the middle dimension in `splits` parts."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def principal(fit: DataFrame, mean: list[float], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues and eigenvectors (columns) of the covariance, and its trace."""
    centred = block_matrix(fit, mean)
    splits = -(-n // (BLOCK_ROWS * SPLIT_BLOCKS))
    scatter = times(centred.transpose(), centred, splits).toLocalMatrix().toArray() / n
    values, columns = np.linalg.eigh((scatter + scatter.T) / 2)
    return values[::-1], columns[:, ::-1], float(np.trace(scatter))


def projected(rows: DataFrame, mean: list[float], whitener: np.ndarray) -> DataFrame:
    """index and w, the whitened components of each row."""
    spark = rows.sparkSession
    d, k = whitener.shape
    blocks = [((at // BLOCK_ROWS, 0), Matrices.dense(len(part), k, part.T.ravel().tolist()))
              for at in range(0, d, BLOCK_ROWS) for part in [whitener[at:at + BLOCK_ROWS]]]
    matrix = BlockMatrix(spark.sparkContext.parallelize(blocks, 1), BLOCK_ROWS, BLOCK_ROWS, d, k)
    found = times(block_matrix(rows, mean), matrix, 1).toIndexedRowMatrix()
    # the matrix's rows as a DataFrame of the JVM; `found.rows` would pass them through Python
    frame = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", found._java_matrix_wrapper._java_model), "vector")
    return frame.select("index", vector_to_array("vector").alias("w"))


def whitened_length(rows: DataFrame, components: int) -> DataFrame:
    """The result for vectors of one length."""
    spark = rows.sparkSession
    fit = indexed(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    sums = [r.s for r in fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()]
    mean = [float(int(s) / n) for s in sums]
    values, columns, trace = principal(fit, mean, n)
    used = [k for k in range(min(components, len(values))) if values[k] > LEAST_SHARE * trace]
    if not used:
        return spark.createDataFrame([], SCHEMA)
    every = indexed(rows, "whitening-rows")
    whitener = columns[:, used] / np.sqrt(values[used])
    out = saved(every.join(projected(every, mean, whitener), "index"), "whitened")
    of_fit = projected(fit, mean, whitener)
    covariances = of_fit.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i in range(len(used)) for j in range(i + 1)]).first()
    error = max(abs(covariances[f"c{i}_{j}"] - (i == j)) for i in range(len(used)) for j in range(i + 1))
    away = F.zip_with("x", F.lit([str(int(s)) for s in sums]).cast("array<decimal(38,0)>"), lambda v, s: (v.cast("decimal(19,0)") * n - s).cast("decimal(19,0)"))
    deviation = F.aggregate(away, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))
    parts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col("w")[i].alias("whitened"), F.lit(float(values[k] / trace)).alias("explained")) for i, k in enumerate(used)])
    return out.select("vec_id", F.explode(parts).alias("p"), deviation.try_cast("long").alias("deviation")).select(
        "vec_id", "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(float(error)).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; a row per vector and component."""
    rows = saved(whole_vectors(vectors), "whole-vectors")
    lengths = [r[0] for r in rows.select(F.size("x")).distinct().orderBy(F.size("x")).collect()]
    parts = [whitened_length(rows.where(F.size("x") == k), components) for k in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], SCHEMA)
