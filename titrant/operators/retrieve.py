"""Context for a test: graph neighbours and nearest snippets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from titrant.fixed.lexicons import RETRIEVAL_QUERIES
from titrant.functions import text as tx


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (node, relation, neighbour): CORRELATES_WITH both ways,
    INDICATES and FOLLOW_UP along the edge."""
    both = edges.filter("label = 'CORRELATES_WITH'")
    flipped = both.select(F.col("dst").alias("src"), "label", F.col("src").alias("dst"))
    relation = (F.when(F.col("label") == "CORRELATES_WITH", "related").when(F.col("label") == "INDICATES", "condition").otherwise("follow_up"))
    return (edges.filter(F.col("label").isin("CORRELATES_WITH", "INDICATES", "FOLLOW_UP")).unionByName(flipped)
            .join(nodes.select(F.col("node_id").alias("dst"), "name", "description"), "dst")
            .select(F.col("src").alias("node_id"), relation.alias("relation"), F.col("dst").alias("neighbour_id"), "name", "description"))


def neighbour_lists(found: DataFrame) -> DataFrame:
    """Neighbours folded per node and relation, in the order of their ids; the
    rows of `neighbours` are the form for nodes with very many of them."""
    return found.groupBy("node_id", "relation").agg(
        F.array_sort(F.collect_list(F.struct("neighbour_id", "name"))).alias("neighbours"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


#: Vectors of a query block, and of the corpus rows that one product meets: bounds of memory, without effect on results.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 16_384
SCORE_DIGITS = 9


def with_direction(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: not null, of finite entries, not all zero."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False)))


def _units(vectors) -> np.ndarray:
    m = np.array(list(vectors), np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _asked(queries: DataFrame) -> dict[int, list]:
    """Stated queries as blocks of (ids, unit vectors) by length of vector.  They
    travel in the closure of the tasks: a set that is asked, not a table."""
    blocks: dict[int, tuple[list, list]] = {}
    for r in queries.toLocalIterator():
        ids, vectors = blocks.setdefault(len(r["vector"]), ([], []))
        ids.append(r["query_id"])
        vectors.append(r["vector"])
    return {d: [(ids[k:k + QUERY_BLOCK], _units(vectors[k:k + QUERY_BLOCK])) for k in range(0, len(ids), QUERY_BLOCK)] for d, (ids, vectors) in blocks.items()}


def _nearest_rows(asked, k: int):
    """Batch function: the k best rows of each query among the rows of a task.

    Rows are met in cells, each around one of its rows.  A query's angle to that row less the
    widest angle of the cell bounds the angle to every row of the cell, so a
    cell that cannot better a query's k-th row so far is passed over for it."""
    def run(batches):
        best = {d: [(np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), object)) for ids, _ in blocks] for d, blocks in asked.items()}
        for pdf in batches:
            for d, part in pdf.groupby(pdf["vector"].map(len)):
                for at in range(0, len(part) if d in asked else 0, CORPUS_BLOCK):
                    some = part.iloc[at:at + CORPUS_BLOCK]
                    ids, unit = some["vec_id"].to_numpy(object), _units(some["vector"])
                    for rows, widest, centre in _cells(unit):
                        for (_, q), (scores, found) in zip(asked[d], best[d]):
                            angle = np.arccos(np.clip(q @ centre, -1, 1)) - widest
                            # a margin for rounding, so that no row that ties is passed over
                            near = np.flatnonzero(np.cos(np.maximum(angle, 0)) + 1e-8 >= scores[:, -1])
                            if len(near):
                                _merge(scores, found, near, np.round(q[near] @ unit[rows].T, SCORE_DIGITS), ids[rows], k)
        for d, blocks in asked.items():
            for (query_ids, _), (scores, found) in zip(blocks, best[d]):
                i, j = np.nonzero(scores > -np.inf)
                yield pd.DataFrame({"query_id": np.array(query_ids, object)[i], "vec_id": found[i, j], "score": scores[i, j]})
    return run


def _cells(unit: np.ndarray, cells: int = 64):
    """The rows of a block by their nearest of some spread rows: (rows, widest angle, centre)."""
    centres = unit[:: max(1, len(unit) // cells)][:cells]
    cosine = unit @ centres.T
    own = cosine.argmax(axis=1)
    for c in np.unique(own):
        rows = np.flatnonzero(own == c)
        yield rows, np.arccos(np.clip(cosine[rows, c].min(), -1, 1)), centres[c]


def _merge(scores, found, near, new, ids, k):
    """The k best of what a query holds and new rows, ties by id."""
    for i, line in zip(near, new):
        at = np.flatnonzero(line >= scores[i, -1])
        if not len(at):
            continue
        s, v = np.concatenate([scores[i], line[at]]), np.concatenate([found[i], ids[at]])
        if len(s) > 4 * k:
            keep = s >= np.partition(s, -k)[-k]
            s, v = s[keep], v[keep]
        order = sorted(range(len(s)), key=lambda x: (-s[x], v[x]))[:k]
        scores[i], found[i] = s[order], v[order]


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k most similar corpus vectors (vec_id, vector) per query (query_id,
    vector) by cosine, ties by id.

    The corpus is read once, where it lies: each task keeps the k best rows of
    each query and passes only those on.  Vectors that are null, zero or not finite, and
    queries of another length, have no nearest rows; rows without an id are left out.
    """
    asked = _asked(with_direction(queries.select("query_id", "vector"), "vector"))
    rows = with_direction(corpus.select("vec_id", "vector"), "vector").filter("vec_id is not null")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {corpus.schema['vec_id'].dataType.simpleString()}, score double"
    best = rows.mapInPandas(_nearest_rows(asked, k), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieval_query(name: Column, section: Column) -> Column:
    """Search text of a test: fixed for two sections, else built from its name."""
    return F.coalesce(F.element_at(tx.literal_map(RETRIEVAL_QUERIES.items()), F.coalesce(section, F.lit(""))),
                      F.concat(F.lit("What does "), name, F.lit(" lab test result mean for patients?")))


def graph_context(lists: DataFrame) -> DataFrame:
    """Neighbour lists side by side: one row per node."""
    names = F.transform("neighbours", lambda x: x["name"])
    return lists.groupBy("node_id").agg(*[
        F.max(F.when(F.col("relation") == kind, names)).alias(kind) for kind in ("related", "condition", "follow_up")])


def assemble(tests: DataFrame, graph: DataFrame, snippets: DataFrame) -> DataFrame:
    """Graph and snippet context per test; tests without either keep empty lists.

    `graph` is a graph_context; `snippets` holds query_id, rank, text with few
    ranks per query.
    """
    s = snippets.groupBy(F.col("query_id").alias("test_name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("snippets"))
    out = tests.join(graph.withColumnRenamed("node_id", "loinc_code"), "loinc_code", "left").join(s, "test_name", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("related", "condition", "follow_up", "snippets")})
