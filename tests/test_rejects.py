import random

import pytest

from lumenquote.operators import rejects as R

GOOD_E, GOOD_A = '12|c3|4|"a \\"q\\" b"', '7|web|2024-02-29T01:02:03Z|0420|"line\\nbreak | bar"'


@pytest.mark.parametrize("kind, line, want", [
    ("evidence", GOOD_E, None), ("answer", GOOD_A, None), ("evidence", " \t" + GOOD_E + "\r", None), ("evidence", '0012|c0|09|"x"', None),
    ("evidence", '1|c1|1|"never', "quoting"), ("evidence", '1|c1|1|"a"b', "quoting"), ("evidence", '1|c"1|1|"a"', "quoting"), ("evidence", '1|c1|1|"a\\"', "quoting"),
    ("evidence", '1|c1|"a"', "columns"), ("evidence", '1|c1|1|"a"|', "columns"), ("evidence", '1|c1', "columns"), ("answer", GOOD_E, "columns"), ("other", GOOD_E, "columns"), (None, '"', "quoting"),
    ("evidence", "1|c1|1|a", "quoting"), ("evidence", '"1"|c1|1|"a"', "quoting"), ("evidence", '1|c1|"1"|a', "quoting"),
    ("evidence", '0|c1|1|"a"', "value"), ("evidence", '+1|c1|1|"a"', "value"), ("evidence", '1|C1|1|"a"', "value"), ("evidence", '1|c1|100|"a"', "value"), ("evidence", '1|c1|1|"\\n \\n"', "value"),
    ("evidence", '1|c1|1|""', "value"), ("evidence", '１|c1|1|"a"', "value"), ("evidence", '99999999999999999999|c1|1|"a"', "value"), ("evidence", '1|c1| 1|"a"', "value"),
    ("answer", GOOD_A.replace("02-29", "02-30"), "value"), ("answer", GOOD_A.replace("01:02:03", "24:00:00"), "value"), ("answer", GOOD_A.replace("03Z", "60Z"), "value"), ("answer", GOOD_A.replace("web", "fax"), "value"), ("answer", GOOD_A.replace("0420", "5001"), "value"),
])
def test_reasons(kind, line, want):
    assert R.diagnose(kind, line)[0] == want


def test_values(spark):
    df = spark.createDataFrame([(1, "evidence", GOOD_E, 0), (2, "answer", GOOD_A, 0), (3, "evidence", None, 0), (4, "answer", " \t ", 0), (5, None, "x", 0), (6, "evidence", "1|c1|1", 0)], "raw_id bigint, kind string, line string, reason int")
    got = {r.raw_id: r for r in R.parse_records(df).collect()}
    assert set(got) == {1, 2, 5, 6} and got[1].quote == 'a "q" b' and got[1].source_index == 4
    assert got[2].answer == "line\nbreak | bar" and str(got[2].created_at) == "2024-02-29 01:02:03" and got[2].context_window_chars == 420
    assert got[5].reason == got[6].reason == "columns"
    assert [x.count() for x in R.split_records(R.parse_records(df))] == [1, 1, 2]
    assert R.parse_records(df.limit(0)).count() == 0


def test_blocks_agree_with_the_strict_reader(spark):
    rnd = random.Random(9)
    lines = []
    for i in range(3000):
        base = rnd.choice([GOOD_E, GOOD_A, '5|c1|2|"plain text without any escapes"', '5|c1|2|"back\\\\slash \\x"'])
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            at = rnd.randrange(len(base))
            base = base[:at] + rnd.choice(['"', "|", "\\", "", "x", "\n", "\x01", " "]) + base[at + rnd.randint(0, 1) :]
        lines.append((i, rnd.choice(["evidence", "answer"]), base))
    df = spark.createDataFrame(lines, "raw_id bigint, kind string, line string").coalesce(2)
    got = {r.raw_id: r for r in R.parse_records(df).collect()}
    for i, kind, line in lines:
        if line.strip():
            reason, value = R.diagnose(kind, line)
            assert got[i].reason == reason, (kind, line)
            assert all(getattr(got[i], k) == v for k, v in value.items() if k != "created_at"), (kind, line)
