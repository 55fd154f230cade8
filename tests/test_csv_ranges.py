"""CSV by ranges: the same rows as a file taken whole, from many tasks."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.sources.corpus import column_types, read_corpus_csv
from vecshift.sources.csv_ranges import csv_records, states


def rows_of(path):
    """Brute force: Python's reader over the whole file, header dropped, empty lines passed over."""
    with open(path, newline="", encoding="utf-8") as f:
        return [tuple(x or None for x in r) for r in csv.reader(f) if r][1:]


def read(spark, path, range_bytes, columns=("id", "text", "n")):
    df = read_corpus_csv(spark, str(path), range_bytes=range_bytes)
    return [tuple(r[c] for c in columns) for r in df.orderBy("_order").collect()]


def written(path, rows, line="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=line, quoting=quoting).writerows([("id", "text", "n")] + rows)
    path.write_bytes(out.getvalue().encode())


def random_text(rng):
    return "".join(rng.choice(["a", "bé", ",", '"', '""', "\n", "\n\n", '",', ',"', "東 ", "x y z "]) for _ in range(rng.randint(1, 12)))


@pytest.mark.parametrize("line, quoting, seed", [("\n", csv.QUOTE_MINIMAL, 1), ("\r\n", csv.QUOTE_ALL, 2), ("\n", csv.QUOTE_ALL, 3)])
def test_a_file_in_many_ranges_gives_its_rows(spark, tmp_path, line, quoting, seed):
    rng = random.Random(seed)
    rows = [(str(i), "t" + random_text(rng), rng.choice(["5", "", "x"])) for i in range(400)]
    written(tmp_path / "a.csv", rows, line, quoting)
    expect = rows_of(tmp_path / "a.csv")
    assert len(expect) == 400
    size = (tmp_path / "a.csv").stat().st_size
    for pieces in (3, 40):
        assert read(spark, tmp_path / "a.csv", size // pieces) == expect
    assert read(spark, tmp_path / "a.csv", 1 << 20) == expect


def test_records_over_whole_ranges_quotes_in_fields_and_open_ends(spark, tmp_path):
    long = "start\n" + "\n".join(f'line "{i}", of many' for i in range(60)) + "\nend"
    written(tmp_path / "a.csv", [("0", "x", "1"), ("1", long, "2"), ("2", "y", "3"), ("3", long * 2, ""), ("4", "z", "5")])
    (tmp_path / "b.csv").write_text('id,text,n\n\n5,6" pipe,1\n\n\n6,a "b" c,2\n7,"""q""",3\n8,,\n')
    (tmp_path / "c.csv").write_text('id,"te\nxt",n\n9,"never\nclosed,\n\nto the end')
    expect = rows_of(tmp_path / "a.csv") + rows_of(tmp_path / "b.csv") + [("9", "never\nclosed,\n\nto the end", None)]
    for size in (64, 700):
        assert read(spark, tmp_path, size) == expect
    (tmp_path / "d.csv").write_text("id,text,n\n")
    assert read(spark, tmp_path / "d.csv", 4) == []


def test_tables_of_many_ranges_are_met_by_a_shuffle(spark, tmp_path):
    rng = random.Random(4)
    rows = [(str(i), "t" + random_text(rng), "1") for i in range(200)]
    written(tmp_path / "a.csv", rows)
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listing = spark.createDataFrame([(0, f"file:{tmp_path}/a.csv")], "_file_ord LONG, _file STRING")
    sent, met, many = (csv_records(spark, str(tmp_path), listing, few, key, 200, n) for few, n in ((True, 10**6), (True, 0), (False, 10**6)))
    a, b, c = (sorted(map(tuple, df.collect())) for df in (sent, met, many))
    assert a == b == c and [r[1] for r in a] == list(range(201))
    assert sent.rdd.getNumPartitions() >= (tmp_path / "a.csv").stat().st_size // 200


def test_states_compose_as_line_by_line():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        out_to, in_to = rng.integers(0, 2, (2, n))
        for first in (0, 1):
            s = [first]
            for a, b in zip(out_to, in_to):
                s.append(int(b if s[-1] else a))
            assert states(out_to, in_to, first).tolist() == s


def test_types_are_the_narrowest_that_hold_every_value(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,f,b,s,big,none\n1,1.5,True,x,1,NA\n,2,false,7,99999999999999999999,\n-3,1e3,,NA,2,nan\n")
    for size in (16, 1 << 20):
        df = read_corpus_csv(spark, str(tmp_path / "t.csv"), typed=True, range_bytes=size)
        assert [f.dataType.simpleString() for f in df.schema][:6] == ["bigint", "double", "boolean", "string", "double", "string"]
        assert [tuple(r)[:6] for r in df.orderBy("_order").collect()] == [
            (1, 1.5, True, "x", 1.0, None), (None, 2.0, False, "7", 1e20, None), (-3, 1000.0, None, None, 2.0, None)]
    assert column_types(df.select("_order"), []) == {}
