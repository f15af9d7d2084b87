"""Operator 11: how the wording of sources diverges, with strings joined late.

Each task counts the terms of its documents and writes them to a table with a
64-bit digest.  The shuffles that count read the digests only; the strings
stay in their own column of that table.  The smallest and the largest string
of each digest show where two terms share one: those digests are split into
numbered parts, which from then on belong to the key.  Strings are joined back
to the few terms that a report names.

A pair of sources is summed over all kept terms without listing the terms that
neither has: terms of both are met in tasks that hold whole terms, and the
rest follows from each source's distinct chances and the chance of an absent term.

Defined results: null text, lang and source are ''.  Each row is a document,
whatever its doc_id.  A language without kept terms has pair values 0.  Very long
texts are cut into terms block by block.  Columns other than lang, source and
text are ignored.  No documents give no rows.  A value over 2**63 - 1 cannot
occur for fewer than 10**9 kept terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titrant.session import saved

LEAST_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
#: Terms counted by a task before it passes them on, bytes cut at once, rows paired at once: bounds of memory, without effect on results.
HELD, BLOCK_BYTES, PAIR_ROWS = 1_200_000, 1 << 22, 100_000
#: Letters and all bytes of other scripts stay, A-Z in lower case; the rest ends a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _term_blocks(text: bytes) -> Iterator[list[bytes]]:
    at, data = 0, text.translate(_TERM)
    while at < len(data) or not at:
        end = data.find(b" ", at + BLOCK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def _passed_on(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), found in counts.items():
        terms, n = list(found), list(found.values())
        d = list(map(docs[lang, source].__getitem__, terms))
        for k in range(0, len(terms), 20_000):
            part = terms[k:k + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array(n[k:k + 20_000], pa.int64()), pa.array(d[k:k + 20_000], pa.int64())],
                ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs, held = {}, {}, 0
    for b in batches:
        for k in range(0, b.num_rows, 500):
            for lang, source, text in zip(*(c.to_pylist() for c in b.slice(k, 500).columns)):
                key, seen = (lang, source), set()
                n = counts.setdefault(key, Counter())
                d = docs.setdefault(key, Counter())
                held -= len(n)
                for words in _term_blocks(text):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                held += len(n)
                if held > HELD:
                    yield from _passed_on(counts, docs)
                    counts, docs, held = {}, {}, 0
    yield from _passed_on(counts, docs)


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text, nulls as ''."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, digest, term, n, docs: what single tasks counted."""
    digest = F.xxhash64("term")
    if bits < 64:
        digest = digest.bitwiseAND(F.lit((1 << bits) - 1))
    rows = named(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return rows.withColumn("term", F.col("term").cast("string")).select("lang", "source", digest.alias("digest"), "term", "n", "docs")


def lexicon(counted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """digest, part, term; and the same of shared digests alone (None where no two terms share one)."""
    ends = saved(counted.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest")), "lexicon")
    shared = ends.where("least <> greatest").select("digest")
    alone = ends.where("least = greatest").select("digest", F.lit(0).alias("part"), F.col("least").alias("term"))
    if shared.isEmpty():
        return alone, None
    terms = counted.join(shared, "digest", "left_semi").select("digest", "term").distinct()
    split = saved(terms.select("digest", F.dense_rank().over(Window.partitionBy("digest").orderBy("term")).alias("part"), "term"), "split")
    return alone.unionByName(split), split


def chance(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) in whole numbers of up to 38 digits."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(counted: DataFrame, split: DataFrame | None) -> DataFrame:
    """lang, source, digest, part, n, lang_n, head (one row of each term of a language has it)."""
    if split is None:
        counted = counted.withColumn("part", F.lit(0))
    else:
        counted = counted.join(split, ["digest", "term"], "left").fillna({"part": 0})
    per_source = counted.groupBy("lang", "source", "digest", "part").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "digest", "part")
    rows = per_source.select("*", F.sum("docs").over(term).alias("_d"), F.sum("n").over(term).alias("lang_n"), F.min("source").over(term).alias("_s"))
    return rows.where(F.col("_d") >= LEAST_DOCS).select("lang", "source", "digest", "part", "n", "lang_n", (F.col("source") == F.col("_s")).alias("head"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, v, terms (kept terms of the source), total (n + v), lang_total; one row per occurring group."""
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"), F.sum(F.col("head").cast("long")).alias("v"))
    groups = named(docs).select("lang", "source").distinct().join(per, ["lang", "source"], "left").fillna(0, ["n", "terms", "v"])
    of = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    return groups.drop("v").join(of, "lang").select("lang", "source", "v", "terms", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))


def _both_have(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms that both sources of a pair have, less what the terms count as absent from one of them."""
    place = pd.MultiIndex.from_frame(frame[["lang", "source"]])
    code, groups = place.factorize()
    same = (frame[["lang", "digest", "part"]].ne(frame[["lang", "digest", "part"]].shift())).any(axis=1).cumsum().to_numpy()
    p, p0 = frame["p"].to_numpy(np.int64), frame["p0"].to_numpy(np.int64)
    size, keys, values = len(groups), [], []

    def f(x, y):
        return (x - y) ** 2 // y
    for d in range(1, len(frame)):
        i = np.flatnonzero(same[:-d] == same[d:])
        if not len(i):
            break
        j = i + d
        for a, b in ((i, j), (j, i)):
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            key, at = np.unique(code[a] * size + code[b], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, value)
            keys.append(key)
            values.append(total)
    key, value = (np.concatenate([np.empty(0, np.int64), *x]) for x in (keys, values))
    left, right = groups[key // max(size, 1)], groups[key % max(size, 1)]
    return pd.DataFrame({"lang": left.get_level_values(0), "source": left.get_level_values(1), "item": right.get_level_values(1), "value": value})


def _paired(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows < PAIR_ROWS:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = frame.iloc[-1]
        of_last = ((frame["digest"] == last["digest"]) & (frame["part"] == last["part"]) & (frame["lang"] == last["lang"])).to_numpy()
        held, rows = [frame[of_last]], int(of_last.sum())
        yield _both_have(frame[~of_last].reset_index(drop=True))
    if held:
        yield _both_have(pd.concat(held, ignore_index=True))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for all pairs of sources of a language."""
    absent = F.when(F.col("v") > 0, chance(F.lit(0).cast("long"), F.col("total"))).otherwise(1)
    groups = groups.withColumn("p0", absent)
    rows = kept.join(groups.select("lang", "source", "total", "p0"), ["lang", "source"]).select("lang", "source", "digest", "part", chance(F.col("n"), F.col("total")).alias("p"), "p0")
    both = rows.repartition("lang", "digest", "part").sortWithinPartitions("lang", "digest", "part").mapInPandas(_paired, "lang string, source string, item string, value long")
    own = rows.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("other_terms"), F.col("p0").alias("q0"))
    met = own.join(other, "lang").where("source <> item")
    here = met.select("lang", "source", "item", (F.col("m") * gap(F.col("p"), F.col("q0"))).alias("value"))
    there = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * gap(F.col("q0"), F.col("p"))).alias("value"))
    rest = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", ((F.col("v") - F.col("terms") - F.col("other_terms")) * gap(F.col("p0"), F.col("q0"))).alias("value"))
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (both, here, there)]
    return parts[0].union(parts[1]).union(parts[2]).union(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame, words: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source uses most above its language.

    The value of the last rank is found on digests; strings are joined to the
    rows that reach it, so that ties are decided by them."""
    rows = kept.join(groups, ["lang", "source"]).select("lang", "source", "digest", "part", chance(F.col("n"), F.col("total")).alias("p"), chance(F.col("lang_n"), F.col("lang_total")).alias("q"))
    above = rows.where("p > q").select("lang", "source", "digest", "part", gap(F.col("p"), F.col("q")).alias("value"))
    group = Window.partitionBy("lang", "source")
    first = above.select("lang", "source", "value", F.row_number().over(group.orderBy(F.desc("value"))).alias("rank")).where(F.col("rank") <= ranks)
    reach = first.groupBy("lang", "source").agg(F.min("value").alias("least"))
    near = above.join(reach, ["lang", "source"]).where(F.col("value") >= F.col("least"))
    spelt = near.join(words, ["digest", "part"]).select("lang", "source", F.col("term").alias("item"), "value")
    return spelt.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)


def source_divergence(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counted = saved(term_counts(docs, bits), "terms")
    words, split = lexicon(counted)
    kept = saved(kept_terms(counted, split), "kept")
    groups = saved(group_totals(docs, kept), "groups")
    group = Window.partitionBy("lang", "source")
    pairs = pair_values(kept, groups).withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    out = [("pair", pairs), ("term", term_values(kept, groups, words))]
    parts = [x.select("lang", "source", F.lit(kind).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for kind, x in out]
    return parts[0].union(parts[1])


#: The whole report in DuckDB SQL, over all pairs of sources and all kept terms.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN used USING (lang, source) GROUP BY lang, source),
chances AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(u.n, 0) + 1) // (g.n + s.v))::HUGEINT AS p
            FROM totals g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
overall AS (SELECT lang, term, (1 + {SCALE}::HUGEINT * (k.n + 1) // (s.n + s.v))::HUGEINT AS q FROM kept k JOIN sizes s USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM chances a JOIN chances b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
named AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM chances JOIN overall USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM named) WHERE rank <= {RANKS}
"""
