"""Bad lines against a plain state machine, on made cases and on the whole small table."""

import re
from pathlib import Path

import pytest

from triplane.sources import program_lines as P

DATA = "/root/testdata/sf0.001"
GOOD = '@wd . x ( ) filter id == " Q1 ( " ;'


def plain(line):
    """The reason by the rules, character by character; None for a valid line."""
    line = line or ""
    if line.endswith("\r"):
        line = line[:-1]
    fields, state, field = [], "start", ""
    for c in [*line, None]:
        if state == "start" and c == '"':
            state, field = "quoted", ""
            continue
        if state == "start":
            state, field = "plain", ""
        if state == "quoted":
            if c is None:
                return "quoting"
            if c == '"':
                state = "closing"
            else:
                field += c
        elif state == "closing":
            if c == '"':
                state, field = "quoted", field + '"'
            elif c in ("\t", None):
                fields.append(field)
                state = "start"
            else:
                return "quoting"
        elif c in ("\t", None):
            fields.append(field)
            state = "start"
        else:
            field += c
    if len(fields) != 3:
        return "columns"
    i, u, t = fields
    if not re.fullmatch("[a-z]+-[0-9]{1,9}", i):
        return "id"
    if not u.strip() or any(c == "�" or ord(c) < 32 and c not in "\t\n\r" or ord(c) == 127 for c in u):
        return "utterance"
    t = t.strip()
    depth, inside = [], False
    for c in t:
        if c == '"':
            inside = not inside
        elif not inside and c in "([{":
            depth.append(c)
        elif not inside and c in ")]}" and (not depth or depth.pop() + c not in ("()", "[]", "{}")):
            return "thingtalk"
    return "thingtalk" if not t.endswith(";") or inside or depth else None


CASES = [
    f"train-1\tasked\t{GOOD}", f"train-1\tasked\t{GOOD}\r", None, "", "a-1\tb", f"a-1\tb\t{GOOD}\tc", f'"a-1"\t"b\t""c"""\t{GOOD}', 'a-1\t"open\tx ;',
    f'a-1\t"b"x\t{GOOD}', f"A-1\tb\t{GOOD}", f"a-1234567890\tb\t{GOOD}", f"a-1\n\tb\t{GOOD}", f"a–1\tb\t{GOOD}", f"a-1\t  \t{GOOD}", f"a-1\tb\x07\t{GOOD}",
    f"a-1\tb\x7f\t{GOOD}", f"a-1\tb�\t{GOOD}", "a-1\tb\t", "a-1\tb\t   ", "a-1\tb\tx", 'a-1\tb\tx " ;', "a-1\tb\t( [ ) ] ;", "a-1\tb\t) ( ;", 'a-1\tb\t( ")" ) ;  ',
    "a-1\tb\t" + "(" * 40 + ")" * 40 + ";", "a-1\tb\t" + "(" * 40 + ")" * 39 + ";", "a-1\tb\t" + "([" * 20 + ")]" * 20 + ";", f"a-1\t{'long ' * 40000}\t{GOOD}", f'a-1\tsay "hi"\t{GOOD}', '"', '""\t""\t""', "a-1\tb\t;\r\r",
]


def run(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw_line string").selectExpr("*", "'x' AS reason", "1 AS fields")
    return {r.line_id: r.reason for r in P.bad_lines(rows).collect()}, {r.line_id for r in P.valid_rows(rows).collect()}


def test_cases(spark):
    bad, good = run(spark, CASES)
    assert bad == {i: r for i, x in enumerate(CASES) if (r := plain(x))}
    assert good == set(range(len(CASES))) - set(bad)


def test_repeated_and_empty(spark):
    bad, _ = run(spark, ["x"] * 5 + CASES[:1] * 5)
    assert bad == dict.fromkeys(range(5), "columns")
    assert run(spark, []) == ({}, set())


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/raw_examples.parquet").collect()
    assert {(r.line_id, r.reason) for r in P.p3_found(spark, DATA).collect()} == {(r.line_id, x) for r in rows if (x := plain(r.raw_line))}


def test_values_load_unquoted(spark):
    row = spark.createDataFrame([(1, 'a-1\t"say ""hi"", now"\tx ;')], "line_id bigint, raw_line string")
    assert P.valid_rows(row).collect()[0][1:] == ("a-1", 'say "hi", now', "x ;")


def test_equal_and_null_keys(spark):
    rows = spark.createDataFrame([(1, CASES[0]), (1, "bad"), (None, CASES[0]), (None, f"BAD ID\tx\t{GOOD}"), (2, "bad"), (2, "bad")], "line_id bigint, raw_line string")
    assert sorted((r.line_id or 0, r.reason) for r in P.bad_lines(rows).collect()) == [(0, "id"), (1, "columns"), (2, "columns"), (2, "columns")]
    assert sorted((r.line_id or 0, r.id) for r in P.valid_rows(rows).collect()) == [(0, "train-1"), (1, "train-1")]


def test_a_dictionary_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST", 0)
    bad, good = run(spark, CASES)
    assert bad == {i: r for i, x in enumerate(CASES) if (r := plain(x))} and good == set(range(len(CASES))) - set(bad)
