"""Whole licence files: long licences, titles, holder lines and line ends."""

from titrant.llm import licences
from titrant.llm.licence_full import whole_texts
from titrant.llm.licence_texts import KNOWN


def test_whole_files_are_found(spark):
    files = dict(whole_texts())
    grant, bsd = KNOWN["MIT (grant)"], KNOWN["BSD-3-Clause"]
    narrow = grant.replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace(" copyright notice", "\ncopyright notice")
    assert narrow != grant
    cases = [
        ("Apache-2.0", files["Apache-2.0"]), ("Apache-2.0", files["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Ann Other")),
        ("GPL-2.0", files["GPL-2.0"].upper()), ("GPL-3.0", files["GPL-3.0"].replace("\n", "\r\n")), ("LGPL-2.1", files["LGPL-2.1"]), ("LGPL-3.0", files["LGPL-3.0"]),
        ("MPL-2.0", files["MPL-2.0"]), ("CC0-1.0", files["CC0-1.0"]), ("CC-BY-SA-4.0", files["CC-BY-SA-4.0"]), ("GPL-1.0", files["GPL-1.0"]),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015 Ann Other\n\n" + grant),
        ("MIT", "Copyright Joyent, Inc. and other Node contributors. All rights reserved.\n" + grant),
        ("MIT", "MIT License\r\n\r\nCopyright (c) 2015 Ann\r\nAll rights reserved.\r\n\r\n" + grant.replace("\n", "\r\n")),
        ("MIT", "The MIT License\n\nCopyright The Authors\n\n" + narrow),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2017, Ann Other\nAll rights reserved.\n\n" + bsd),
        (None, "The MIT License (MIT)\n\n" + grant + "\nAnd more."), (None, "Copyright Joyent, Inc.\nnothing else"), (None, files["GPL-3.0"][:-2000]),
    ]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs).collect()}
    assert [got[k] for k in range(len(cases))] == [name for name, _ in cases]


def test_titles_hold_for_every_short_licence(spark):
    rows = whole_texts()
    docs = spark.createDataFrame([(k, "Copyright Ann Other\n" + text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]
