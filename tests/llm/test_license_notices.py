"""Notices inside longer lines, SPDX lines, and the size of the plan."""

import itertools

from motifloom.llm import license_scan

HELD = {
    1: ("Some text. Released under the MIT License. See LICENSE.", "MIT", 1),
    2: ("// SPDX-License-Identifier: MIT\nint x;", "MIT", 1),
    3: ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0", 1),
    4: ("my tool,  Licensed\tunder\n# the Apache License,\n# Version 2.0. Have fun with it all day", "Apache-2.0", 1),
    5: ("Released under the MIT License. See LICENSE.", "MIT", 1),  # a Dice coefficient of 0.8 as it is
    6: (None, None, 0),
    7: ("", None, 0),
    8: ("to the extent possible we go on to write more words", None, 0),
    9: ("relicensed under the mit license by some people or other", None, 0),  # no word begins there
    10: ("a licensed under the licensed under the mit license b c d e f", "MIT", 1),  # windows overlap
    11: ("/* SPDX-License-Identifier: CC-BY-NC-4.0 */ x y z w v", "CC-BY-NC-4.0", 1),
    12: ("/* SPDX-License-Identifier: CC-BY-ND-4.0 */ x y z w v", None, 0),  # its first words are nearly those of others
    13: ("we put it " * 30_000 + "licensed under CC BY-SA 4.0 " + "as it is " * 30_000, "CC-BY-SA-4.0", 1),
    14: ("use it: licensed under the", None, 0),
}


def test_notices_inside_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in HELD.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["n_matches"]) for r in license_scan.scan(docs).collect()}
    assert got == {i: (name, n) for i, (_, name, n) in HELD.items()}


def test_identifier_lines_name_their_own_licence_best():
    own = [(name, license_scan.template_bigrams(t)) for name, t in license_scan.TEMPLATES if t.startswith("SPDX")]
    assert len(own) > 25
    for (a, p), (b, q) in itertools.combinations(own, 2):
        assert a == b or 2 * (p & q).total() <= 0.8 * (p.total() + q.total())


def test_plan_is_small(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert len(license_scan.scan(docs)._jdf.queryExecution().optimizedPlan().toString()) < 300_000


def test_no_template_is_short(spark):
    """Templates of which none is looked for inside lines."""
    long = "one two three four five six seven eight nine ten " * 6
    docs = spark.createDataFrame([(1, long), (2, "one two three four")], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs, templates=(("X", long),)).collect()}
    assert got == {1: "X", 2: None}
