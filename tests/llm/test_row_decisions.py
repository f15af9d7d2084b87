"""Stages decide by row: repeated and null ids do not take clean texts along."""

from collections import Counter

from titrant.llm import decontaminate, jaccard_join

SCHEMA = "doc_id long, text string, key string, own string"
A, B, C, ITEM = ("one two three four five six", "red green blue white black grey", "north south east west up down", "in the beginning was a small benchmark item")


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_keep_one_by_row(spark):
    rows = [(1, A), (2, A), (2, B), (3, C), (3, "moon sun star comet sky cloud"), (3, C), (None, A), (None, C + " !"), (None, "only here are these five words"),
            (None, "only here are these five words"), (None, "another text without any id here"), (None, None), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    assert rows_of(got) == Counter([(1, A), (2, B), (3, C), (3, "moon sun star comet sky cloud"), (None, "only here are these five words"),
                                    (None, "another text without any id here"), (None, None), (4, None), (5, "")])


def test_near_copies_under_one_id(spark):
    long = " ".join(f"w{k}" for k in range(60))
    got = jaccard_join.keep_one(spark.createDataFrame([(7, long, "", ""), (7, long + " more", "", "")], SCHEMA))
    assert got.count() == 1


def test_remove_leaks_by_row(spark):
    rows = [(1, A), (1, "x " + ITEM), (None, ITEM), (None, B), (None, None), (2, ITEM), (3, C)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = decontaminate.remove_leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert rows_of(got) == Counter([(1, A), (None, B), (None, None), (3, C)])
