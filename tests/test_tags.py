"""Tag parsing and record severity (FIXTURES tag_forms, severity_cases)."""

import pytest
from pyspark.sql import functions as F

from curbscope.functions.tags import parse_tags, record_severity, with_tags

TAG_FORMS = [
    ('["WRONG PARKING","NO PARKING"]', ["WRONG PARKING", "NO PARKING"]),
    ("['WRONG PARKING', 'NO PARKING']", ["WRONG PARKING", "NO PARKING"]),
    ('[" WRONG PARKING ", "NO PARKING  "]', ["WRONG PARKING", "NO PARKING"]),
    ("[]", []),
    ("[ ]", []),
    (None, []),
    ("", []),
    ("   ", []),
    ('\t["NO PARKING"]\n', ["NO PARKING"]),
    ("WRONG PARKING", ["WRONG PARKING"]),
    ("  WRONG PARKING\t", ["WRONG PARKING"]),
    ('"WRONG PARKING"', ["WRONG PARKING"]),
    ("'NO PARKING'", ["NO PARKING"]),
    ("('A', 'B')", ["A", "B"]),
    ("()", []),
    ("(1)", ["1"]),
    ("[1,2]", ["1", "2"]),
    ('["A",]', ["A"]),
    ('["A\tB"]', ["A\tB"]),
    ("[' A ']", ["A"]),
    ("112", ["112"]),
    ('["A", null]', ['["A", null]']),
    ('["A","B"', ['["A","B"']),
    ('["X"] junk', ['["X"] junk']),
    ('["A"]["B"]', ['["A"]["B"]']),
    ('"A"B"', ['"A"B"']),
    ('["A" , "B"]', ["A", "B"]),
    ('[ "A","B" ]', ["A", "B"]),
    ('["A,B","C"]', ["A,B", "C"]),
    ('["A\u00a0","\u2003B"]', ["A", "B"]),
    ('["A\u00a0B"]', ["A\u00a0B"]),
    ('["", "A"]', ["", "A"]),
    ('["A"', ['["A"']),
    ('["A"],', ['["A"],']),
]


@pytest.fixture(scope="module")
def tag_table(spark):
    return spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(TAG_FORMS)],
                                 "i int, raw string")


def test_parse_tags_forms(tag_table):
    got = {r.i: r.tags for r in tag_table.select("i", parse_tags(F.col("raw")).alias("tags")).collect()}
    for i, (raw, expected) in enumerate(TAG_FORMS):
        assert got[i] == expected, (raw, got[i], expected)


def test_staged_parse_equals_single_expression(tag_table):
    staged = with_tags(tag_table, "raw", "tags").select("i", "tags")
    single = tag_table.select("i", parse_tags(F.col("raw")).alias("tags"))
    assert sorted(staged.collect()) == sorted(single.collect())


SEVERITY_CASES = [
    (["NO PARKING"], 1.5),
    (["NO PARKING", "DOUBLE PARKING"], 3.0),
    (["SOMETHING ELSE", "WRONG PARKING"], 2.0),
    (["RIDER NOT WEARING HELMET"], 0.0),
    ([], 0.0),
    (["PARKING ON FOOTPATH", "PARKING ON FOOTPATH"], 1.0),
]


def test_record_severity(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SEVERITY_CASES)],
                               "i int, tags array<string>")
    got = {r.i: r.s for r in df.select("i", record_severity(F.col("tags")).alias("s")).collect()}
    for i, (_, expected) in enumerate(SEVERITY_CASES):
        assert got[i] == expected


def test_fast_path_equals_general_path(spark):
    """The compiled fast path must give exactly the general JSON path's
    array on every string it accepts (random list-like strings)."""
    import random

    from curbscope.functions.tags import clean_list, fast_list, parse_json_list, strip_ws

    rnd = random.Random(7)
    atoms = ['"', "'", ",", " ", "\t", " ", " ", "\\", "A", "B", "PARKING", "1", "[", "]"]

    def item():
        return '"' + "".join(rnd.choice(atoms[3:13]) for _ in range(rnd.randint(0, 4))) + '"'

    rows = []
    for i in range(3000):
        if rnd.random() < 0.6:
            sep = rnd.choice([",", ", ", " ,", ","])
            s = "[" + sep.join(item() for _ in range(rnd.randint(1, 4))) + "]"
        else:
            s = "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 12)))
        rows.append((i, s))
    df = spark.createDataFrame(rows, "i int, raw string").select(
        "i", strip_ws(F.col("raw")).alias("s"))
    out = df.select("i", "s", fast_list(F.col("s")).alias("fast"),
                    clean_list(parse_json_list(F.col("s"))).alias("general")).collect()
    accepted = [r for r in out if r.fast is not None]
    assert len(accepted) > 150
    bad = [(r.s, r.fast, r.general) for r in accepted if r.fast != r.general]
    assert not bad, bad[:5]


def test_a_raw_line_break_in_an_item_is_no_list(spark):
    texts = ['["A\nB","C"]', '["A",\n"B"]', '["A\\nB"]', "['A\rB']"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, violation_type string")
    want = {0: [texts[0]], 1: ["A", "B"], 2: ["A\nB"], 3: [texts[3]]}
    assert {r.k: r.t for r in df.select("k", parse_tags(F.col("violation_type")).alias("t")).collect()} == want
    assert {r.k: r.tags for r in with_tags(df).collect()} == want
