import csv
import io
import random

import pytest

from quakeledger.operators.faulty_rows import Field, check_lines, faulty, loaded

LAYOUT = (Field("a"), Field("t", "time", True), Field("x", "number", True, -90.0, 90.0), Field("b"))
CASES = {
    'u,2020-02-29T10:00:00Z,1.5,v': [],
    'u,2019-02-29T10:00:00Z,1.5,v': ["t"],
    'u,2020-01-01 24:00:00,91,v': ["t", "x"],
    'u,, 12 ,v': [],
    '"u,1",2020-01-01 00:00:00.123456789,-9e1,"a ""q"" b"': [],
    'u,2020-01-01 00:00:00,1,v,w': ["columns"],
    'u"x,2020-01-01 00:00:00,1,v': ["quoting"],
    '"u"x,2020-01-01 00:00:00,1,v': ["quoting"],
    '"u,2020-01-01 00:00:00,1,v': ["quoting"],
    ' "u",2020-01-01 00:00:00,1,v': ["quoting"],
    '"",2020-01-01 00:00:00,.5,': [],
    'u,2020-01-01 00:00:00,1e999,v': ["x"],
    'u,2020-01-01 00:00:00,nan,v': ["x"],
    'u,2020-01-01 00:00:00,１,v': ["x"],
    'u,2020-01-01 00:00:00,1_0,v': ["x"],
    '"a\u0001c",2020-01-01 00:00:00,1,\u0001m': [],
    '': ["columns"],
    None: ["columns"],
    "u" * 100_000 + ",2020-01-01 00:00:00,1,v": [],
}


def run(spark, lines):
    rows = [(i, t, "y") for i, t in enumerate(lines)]
    return check_lines(spark.createDataFrame(rows, "line_id long, raw string, extra string"), "raw", LAYOUT, ("line_id",))


def test_reasons(spark):
    lines = list(CASES)
    got = {r["line_id"]: r["reasons"] for r in run(spark, lines).collect()}
    assert got == {i: CASES[t] for i, t in enumerate(lines)}


def test_found_and_loaded_part_the_lines(spark):
    lines = list(CASES)
    c = run(spark, lines + lines)
    bad, good = {r["line_id"] for r in faulty(c, "line_id").collect()}, {r["line_id"] for r in loaded(c).collect()}
    assert not bad & good and len(bad | good) == 2 * len(lines)
    got = loaded(c).where("line_id = 4").first()
    assert got["a"] == "u,1" and got["b"] == 'a "q" b' and got["x"] == -90.0 and got["t"].microsecond == 123456
    assert loaded(c).where("line_id = 15").first()["a"] == "a\u0001c"


def test_fields_equal_the_csv_module(spark):
    rng = random.Random(4)
    lines = []
    for _ in range(500):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["".join(rng.choice('ab,"\u0001 c') for _ in range(rng.randrange(6))) for _ in range(4)])
        lines.append(out.getvalue())
    layout = tuple(Field(f"f{i}") for i in range(4))
    got = check_lines(spark.createDataFrame(list(enumerate(lines)), "line_id long, raw string"), "raw", layout, ("line_id",)).collect()
    for r in got:
        want = next(csv.reader([lines[r["line_id"]]]))
        assert r["reasons"] == [] and [r[f"f{i}"] or "" for i in range(4)] == [w if w.strip(" \t") else "" for w in want]


def test_empty_and_clash(spark):
    assert run(spark, []).count() == 0
    with pytest.raises(ValueError):
        check_lines(spark.createDataFrame([], "a long, raw string"), "raw", LAYOUT, ("a",))
