"""Quoted cells with line breaks in files that many tasks read."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from palaver.sources import delimited
from palaver.sources.records import read_records

PIECES = ['"', '""', "\n", "\r\n", ",", "\t", "a", "é b", "\n\n", '",', '\n"', "x" * 40, "", " "]


@pytest.fixture
def small_ranges(spark):
    """Files are cut every few dozen bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for key, value in before.items():
        spark.conf.set(key, value)


def key(rows):
    return sorted([[c or "" for c in row] for row in rows])


@pytest.mark.parametrize("seed", range(6))
def test_ranges_agree_with_one_reader(spark, tmp_path, small_ranges, seed):
    small_ranges([61, 90, 128, 201, 333, 700][seed])
    draw = random.Random(seed)
    rows = [["".join(draw.choices(PIECES, k=draw.randint(0, 5))) for _ in range(draw.randint(2, 4))]
            for _ in range(60)]
    path, delimiter = tmp_path / "t.csv", [",", "\t"][seed % 2]
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, delimiter=delimiter, lineterminator=["\n", "\r\n"][seed // 2 % 2]).writerows(rows)
    read = [tuple(r["cells"]) for r in delimited.read_cells(spark, str(path), delimiter, split_above=0).collect()]
    assert key(read) == key(rows)
    files = spark.read.option("lineSep", "\n").text(str(path))
    assert files.rdd.getNumPartitions() > 3


def test_cells_longer_than_many_ranges(spark, tmp_path, small_ranges):
    small_ranges(20)
    long = "\n".join(f'line ""{i}"" of, a cell' for i in range(40))
    path = tmp_path / "t.csv"
    path.write_text(f'1,"{long}",x\n2,y,"{long}"\n3,"{long}"', encoding="utf-8")
    text = long.replace('""', '"')
    assert key(delimited.read_cells(spark, str(path), split_above=0).toPandas()["cells"].map(list)) == key(
        [["1", text, "x"], ["2", "y", text], ["3", text]])


@pytest.mark.parametrize("size", [11, 40, 1000])
def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path, small_ranges, size):
    small_ranges(size)
    path = tmp_path / "t.csv"
    path.write_text('a 5" disk,b\nc,"d"\n"e\nf",6"\ng"h",i\n"j" k,"l\n\n"\nm,n\n', encoding="utf-8")
    rows = delimited.read_cells(spark, str(path), split_above=0).collect()
    assert key(r["cells"] for r in rows) == key(
        [['a 5" disk', "b"], ["c", "d"], ["e\nf", '6"'], ['g"h"', "i"], ['"j" k', "l\n\n"], ["m", "n"]])
    whole = delimited.read_cells(spark, str(path)).collect()
    assert key(r["cells"] for r in rows) == key(r["cells"] for r in whole)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_headers_of_several_files(spark, tmp_path, small_ranges, end):
    small_ranges(12)
    for name in "ab":
        rows = ["", 'id,"te\nxt"', f'{name}1,"x{end}{end}y"', "", f"{name}2,z", f'{name}3,"q,""r"""']
        (tmp_path / f"{name}.csv").write_bytes(end.join(rows).encode())
    (tmp_path / "c.csv").write_bytes(b"")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    read = delimited.read_delimited(spark, paths, header=True, schema="id string, text string", split_above=0)
    expected = [(n + i, t) for n in "ab" for i, t in (("1", f"x{end}{end}y"), ("2", "z"), ("3", 'q,"r"'))]
    assert sorted(tuple(r) for r in read.collect()) == sorted(expected)


@pytest.mark.parametrize("header", [True, False])
def test_transcoding_in_ranges(spark, tmp_path, small_ranges, header):
    source, target = tmp_path / "t.csv", str(tmp_path / "out")
    source.write_text('id,text\n1,"a\tb\nc"\n,"x""y"\n3,\n' * (1 if header else 3), encoding="utf-8")
    small_ranges(16)
    delimited.transcode(spark, str(source), target, ",", "\t", header=header, split_above=0)
    small_ranges(1 << 20)
    read = delimited.read_delimited(spark, target, "\t", header=header, schema="id string, text string")
    rows = [["1", "a\tb\nc"], ["", 'x"y'], ["3", ""]]
    assert key(tuple(r) for r in read.collect()) == key(rows if header else [["id", "text"], *rows] * 3)


@pytest.mark.parametrize("split", [0, 1000])
def test_rows_of_too_many_cells_are_refused_and_short_ones_filled(spark, tmp_path, split):
    path = tmp_path / "t.csv"
    path.write_text('1,"a\nb"\n2\n', encoding="utf-8")
    read = delimited.read_delimited(spark, str(path), schema="a string, b string", split_above=split)
    assert sorted(tuple(r) for r in read.collect()) == [("1", "a\nb"), ("2", None)]
    with pytest.raises(Exception, match="more than 1 cells"):
        delimited.read_delimited(spark, str(path), schema="a string", split_above=split).collect()


def test_an_unclosed_cell_and_empty_files(spark, tmp_path, small_ranges):
    small_ranges(10)
    (tmp_path / "t.csv").write_text('1,a\n2,"b\nc,d\ne', encoding="utf-8")
    (tmp_path / "u.csv").write_text("\n\n\n", encoding="utf-8")
    records = read_records(spark, [str(tmp_path / "t.csv"), str(tmp_path / "u.csv")])
    assert sorted((r["record"], r["is_first"]) for r in records.collect()) == [("1,a", True), ('2,"b\nc,d\ne', False)]


def test_one_shuffle_of_the_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,a\n", encoding="utf-8")
    plan = read_records(spark, str(tmp_path / "t.csv")).select(F.length("record"))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    # Ranges (lines' flags and files), lines, and crossing records: no exchange by record of all lines.
    assert text.count("hashpartitioning(key") == 1 and "SinglePartition" not in text


def test_only_records_that_cross_ranges_are_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"1\n2",y\nz,w\n')
    found = read_records(spark, str(tmp_path / "a.csv"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    assert {(r.record, r.is_first) for r in found.collect()} == {('x,"1\n2",y', True), ("z,w", False)}
