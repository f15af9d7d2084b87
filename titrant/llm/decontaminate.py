"""Operator 5: benchmark decontamination by SimHash windows and multi-index Hamming search.

All in DataFrame expressions.  Shingles are five words of the lower-cased text
(words: runs of letters, digits and underscores), as 64-bit hashes, counted
as often as they occur.  An item is compared with windows of its own number
of shingles.  Windows start where a document's shingle occurs in some item of
that size: moving a window up to its first shared shingle never lowers the
similarity, so no window that counts is left out.  Equal windows are
fingerprinted once.

A 64-bit SimHash per window and item; fingerprints are cut into 7 blocks.  Two
fingerprints within RADIUS bits agree in some block up to RADIUS // 7 bits
(pigeonhole), and items are filed under all values that near for every block, so
every pair within the radius meets.  A pair at similarity 0.8 differs in 9
bits on average, so the radius of 20 is four deviations away.  The
weighted similarity (sum of smaller over sum of larger counts) then decides.

Defined results: null texts and texts or items under five words have no
shingles and match nothing.  Rows repeating a doc_id or item_id are pooled
under that id; null ids are results like others.  Windows cut short by the end of
a document are compared as they are.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titrant.llm.rows import row_key
from titrant.session import saved

SIMILARITY = 0.8
RADIUS = 20
#: First bit and width of each block.
BLOCKS = [(0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9)]
NEAR = RADIUS // len(BLOCKS)

WORDS = r"array_remove(split(lower(text), '[^\\p{L}\\p{N}_]+'), '')"
SHINGLES = "CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), k -> xxhash64(slice(w, k + 1, 5))) ELSE cast(array() AS array<bigint>) END"
FINGERPRINT = """aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE
    WHEN 2 * aggregate(sh, 0, (s, h) -> s + cast(shiftrightunsigned(h, b) & 1 AS int)) > size(sh) THEN shiftleft(1L, b) ELSE 0L END)"""
SHARED = "aggregate(array_distinct(item), 0, (s, h) -> s + least(size(filter(item, x -> x = h)), size(filter(sh, x -> x = h))))"


def shingled(df: DataFrame, key: str) -> DataFrame:
    """key and `sh`, the shingle hashes of `text` in order.

    Rows are not filtered by `sh`, and are exploded with the outer form: the
    optimizer would move such a filter below and split the text anew per shingle."""
    return (df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
            .select(key, F.expr(WORDS).alias("w")).select(key, F.expr(SHINGLES).alias("sh")))


def probes(items: DataFrame) -> DataFrame:
    """Items under every value within NEAR bits, for each block."""
    masks = [(i, lo, width, sum(1 << b for b in bits)) for i, (lo, width) in enumerate(BLOCKS) for r in range(NEAR + 1) for bits in combinations(range(width), r)]
    table = F.expr(f"explode(from_json('[{', '.join(f'[{i},{lo},{(1 << w) - 1},{m}]' for i, lo, w, m in masks)}]', 'array<array<int>>'))")
    near = items.select("item_id", "n", F.col("fp").alias("item_fp"), table.alias("m"))
    return near.select("item_id", "n", "item_fp", F.expr("m[0]").alias("block"), F.expr("cast(shiftrightunsigned(item_fp, m[1]) & m[2] AS int) ^ m[3]").alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity) of every document window at SIMILARITY or
    more to an item; the best window of each pair."""
    items = saved(shingled(benchmark, "item_id").withColumn("n", F.size("sh")).withColumn("fp", F.expr(FINGERPRINT)), "items").where("n > 0")
    marks = saved(items.select("n", F.explode("sh").alias("h")).distinct(), "marks")
    places = shingled(docs, "doc_id").select("doc_id", F.posexplode_outer("sh").alias("at", "h"))
    anchors = places.join(marks, "h").groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("starts"))
    anchors = saved(anchors.withColumnRenamed("doc_id", "own"), "anchors")
    # few documents hold an anchor: their ids alone make a small table, and only their texts are joined with the anchors
    own = saved(anchors.select("own"), "anchored").withColumnRenamed("own", "wanted")
    texts = docs.select("doc_id", "text")
    texts = texts.join(own, texts["doc_id"].eqNullSafe(own["wanted"]), "left_semi")
    found = shingled(texts, "doc_id").join(anchors, F.col("doc_id").eqNullSafe(F.col("own")))
    found = found.select("doc_id", F.explode_outer(F.expr("transform(filter(starts, a -> a.at < size(sh)), a -> struct(a.n AS n, slice(sh, a.at + 1, a.n) AS sh))")).alias("x"))
    windows = saved(found.where("x is not null").select("doc_id", "x.n", "x.sh").distinct().withColumn("window", F.xxhash64("n", "sh")), "windows")
    texts = saved(windows.groupBy("window").agg(F.first("n").alias("n"), F.first("sh").alias("sh")).withColumn("fp", F.expr(FINGERPRINT)), "fingerprints")
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"cast(shiftrightunsigned(fp, {lo}) & {(1 << width) - 1} AS int)").alias("value")) for i, (lo, width) in enumerate(BLOCKS)])
    filed = texts.select("window", "n", "fp", F.explode(blocks).alias("b")).select("window", "n", "fp", "b.block", "b.value")
    near = filed.join(probes(items), ["n", "block", "value"]).where(F.bit_count(F.expr("fp ^ item_fp")) <= RADIUS).select("window", "item_id", "n").distinct()
    item_sets = items.select(F.col("item_id").alias("of"), F.col("n").alias("item_n"), F.col("sh").alias("item"))
    checked = near.join(texts.select("window", "sh"), "window").join(item_sets, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("n") == F.col("item_n")))
    checked = checked.withColumn("shared", F.expr(SHARED)).withColumn("similarity", F.col("shared") / (F.size("sh") + F.size("item") - F.col("shared")))
    good = saved(checked.where(F.col("similarity") >= SIMILARITY).select("window", "item_id", "similarity"), "good")
    return windows.select("doc_id", "window").join(good, "window").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without leaks, with their columns.  Decided by row: a row
    goes if its own text leaks, whatever other rows share its doc_id or have none."""
    keyed = docs.select(row_key(docs).alias("doc_id"), "text")
    bad = saved(leaks(keyed, benchmark).select(F.col("doc_id").alias("own")).distinct(), "leaks")
    return docs.join(bad, row_key(docs) == bad["own"], "left_anti").select(*docs.columns)


#: The same result in DuckDB: every window that starts at a shingle of an item, without fingerprints.
SQL = r"""
WITH cut AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') FROM benchmark),
shingled AS (
  SELECT kind, id, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS sh FROM cut WHERE len(w) >= 5),
places AS (SELECT id, sh, unnest(sh) AS h, generate_subscripts(sh, 1) AS at FROM shingled WHERE kind = 0),
marks AS (SELECT DISTINCT id AS item_id, sh AS item, unnest(sh) AS h FROM shingled WHERE kind = 1),
windows AS (
  SELECT DISTINCT p.id AS doc_id, m.item_id, m.item, p.sh[p.at:p.at + len(m.item) - 1] AS win FROM places p JOIN marks m USING (h)),
counted AS (
  SELECT doc_id, item_id, len(item) AS a, len(win) AS b,
         list_sum(list_transform(list_distinct(item), lambda h: least(len(list_filter(item, lambda x: x = h)), len(list_filter(win, lambda x: x = h))))) AS shared FROM windows)
SELECT doc_id, item_id, max(shared / (a + b - shared)) AS similarity FROM counted WHERE shared / (a + b - shared) >= 0.8 GROUP BY doc_id, item_id
"""
