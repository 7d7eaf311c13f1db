import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readroute.operators.rejects import LineField, LineSchema, load_lines, parse_lines


def by_hand(line):
    """The record of a line by walking over it, None where it is none."""
    if line is None:
        return None
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"', re.S).match(line, i)
            if not m:
                return None
            fields.append(m.group(1).replace('""', '"'))
            i = m.end()
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j])
            i = j
        if i == len(line):
            break
        if line[i] != ",":
            return None
        i += 1
    if len(fields) != 4:
        return None
    pos, header, seq, qual = fields
    good = re.fullmatch("[0-9]{1,18}", pos) and len(header) > 1 and header[0] == "@" and not header[1].isspace()
    good = good and re.fullmatch("[ACGTNacgtn]+", seq) and len(qual) == len(seq) and all("!" <= c <= "~" for c in qual)
    return tuple(fields) if good else None


LINES = [
    None, "", "\r", "1,@a,ACGT,IIII", "1,@a,ACGT,IIII\r", "1,@a,ACGT,IIII\r\r", '"1","@a b","AC","I,"', '1,"@a ""x"", y",AC,"""!"', "1,@a,ACGT,III", "1,@ a,A,I",
    "1,@,A,I", "x,@a,A,I", "1234567890123456789,@a,A,I", "1,@a,AXG,III", "1,@a,A,\x7f", "1,@a,A", "1,@a,A,I,", "1,@a,A,I,2", '1,"@a,A,I', '1,"@a"b,A,I', '1,@a"b,A,I',
    ' 1,@a,A,I', "1,@a,A,I ", "1,@a\nb,A,I", '1,@a,A,""""', '1,@a,A,""', "१,@a,A,I", "1,@ a,A,I", "1,@é,nN,~!",
]


def test_lines_match_a_parser(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "id int, line string")
    got = {r.id: (r.record and tuple(r.record), r.reason) for r in parse_lines(df, "line").collect()}
    for i, line in enumerate(LINES):
        assert got[i][0] == by_hand(line), line
        assert (got[i][1] is None) == (got[i][0] is not None), line


def test_reasons(spark):
    cases = {None: "null_line", "": "value:rec_pos", "1,@a": "missing:seq", '1,"@a,A,I': "quoting:header", "1,@a,X,I": "value:seq", "1,@a,A,II": "qual_length", "1,@a,A,I,x": "extra_fields", "1,@ a,A,I": "value:header"}
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.reason for r in parse_lines(df, "line").collect()} == cases


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet='1@aA,"I\r x', max_size=14), min_size=60, max_size=60))
def test_random_lines(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    for r in parse_lines(df, "line").collect():
        assert (r.record and tuple(r.record)) == by_hand(lines[r.id]), lines[r.id]


def test_very_long_quoted_field(spark):
    line = '1,"@a' + '""' * 200_000 + '",' + "A" * 300_000 + ',"' + '""' * 300_000 + '"'
    df = spark.createDataFrame([(line,), (line + "x",)], "line string")
    assert [r.reason for r in parse_lines(df, "line").select("reason").collect()] == [None, "quoting:qual"]


def test_every_row_comes_out_once(spark):
    rows = [(i % 3, x, "k") for i, x in enumerate(LINES * 2)]
    df = spark.createDataFrame(rows, "reason int, raw string, record string")
    good, bad = load_lines(df, "raw")
    assert good.count() + bad.count() == len(rows)
    assert {"reason", "record", "raw"} <= set(good.columns) & set(bad.columns)
    with pytest.raises(ValueError):
        parse_lines(df, "raw")
    empty_good, empty_bad = load_lines(df.limit(0), "raw")
    assert empty_good.count() == empty_bad.count() == 0


def test_other_schema(spark):
    schema = LineSchema((LineField("n", r"[0-9]++", r"[0-9]++"), LineField("word", r"[a-z]*+", r'(?:[a-z]++|"")*+')), (("odd", lambda c: F.length(c["word"]) % 2 == 0),))
    df = spark.createDataFrame([("1,ab",), ("1,a",), ("x,ab",), ('"2",""',)], "line string")
    assert [r.reason for r in parse_lines(df, "line", schema).collect()] == [None, "odd", "value:n", None]
