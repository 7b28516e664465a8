"""Parallel reading of CSV files with line breaks in fields, against Spark's own multiLine and a character-level reader."""

from __future__ import annotations

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from lateflow.sources import ingest, records
from lateflow.sources.schemas import LOAD_PLAN

REVIEWS = next(s for s in LOAD_PLAN if s.table == "order_reviews")
HEADER = ",".join(f.name for f in REVIEWS.schema.fields)


def state_after(line: str, inside: bool) -> bool:
    """Character by character: a quote opens a field at its start, closes it unless doubled, and is text elsewhere."""
    line, start, i = line.replace('""', ""), not inside, 0
    for c in line:
        if inside:
            inside = c != '"'
            start = False
        elif c == '"' and start:
            inside, start = True, False
        else:
            start = c == ","
    return inside


def test_line_maps(spark):
    r = random.Random(1)
    lines = ["".join(r.choice('",a ') for _ in range(r.randrange(0, 12))) for _ in range(4000)]
    out, inside = records.line_maps(F.col("value"))
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select("value", out.alias("o"), inside.alias("i")).collect()
    for x in rows:
        assert (x["o"], x["i"]) == (int(state_after(x["value"], False)), int(state_after(x["value"], True))), x


def write(path: str, text: str) -> str:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def field(r: random.Random, long: int) -> str:
    part = lambda: r.choice(["word", "ü", ",", '""', "\n", "\r\n", "\n\n", '"",""', ",\n", " "])
    kind = r.random()
    if kind < 0.3:
        return r.choice(["", "plain", 'size 5"', '5" x 7" y', "it's"])
    n = long if kind > 0.97 else r.randrange(0, 12)
    return '"' + "".join(part() for _ in range(n)) + '"'


def parsed(record: str) -> tuple[list[str], list[bool]]:
    """Fields by Python's reader, and which of them are quoted."""
    fields = next(csv.reader(io.StringIO(record, newline="")))
    quoted, rest = [], record
    for f in fields:
        quoted.append(rest.startswith('"'))
        rest = rest[len(f) + 2 + f.count('"') + 1 :] if quoted[-1] else rest[len(f) + 1 :]
    return fields, quoted


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_in_many_tasks_equals_multiline(spark, tmp_path, small_splits, ending):
    """Records across splits, fields longer than several splits, doubled and stray quotes, commas and line breaks."""
    r = random.Random(7)
    rows = [",".join([f"r{i}", f"o{r.randrange(99)}", str(r.randrange(1, 6)), field(r, 900), field(r, 2500), "2018-01-18 00:00:00", ""]) for i in range(900)]
    path = write(str(tmp_path / REVIEWS.file), "﻿" + ending.join([HEADER, *rows]) + ending)
    assert os.path.getsize(path) > 30 * 2000
    lines = records.physical_lines(spark, path)
    assert lines.rdd.getNumPartitions() > 30 and records.split_starts(lines).where("start = 1").count() > 5
    columns = [f.name for f in REVIEWS.schema.fields]
    read = lambda parallel: ingest.read_text_csv(spark, path, REVIEWS, parallel=parallel)[0].select(*columns)
    fast = sorted(map(tuple, read(True).collect()), key=str)
    want = [tuple(x if x or q else None for x, q in zip(row, quoted)) for row, quoted in (parsed(x) for x in rows)]
    assert fast == sorted(want, key=str)
    if ending == "\n":  # with other endings multiLine changes the line breaks inside of fields
        assert fast == sorted(map(tuple, read(False).collect()), key=str)


def test_records_stand_as_in_the_file(spark, tmp_path, small_splits):
    body = ['a,"x\ny",b', 'c,"' + "long\n" * 2000 + '",d', "e,f,g", '"q""\n""q",h,i']
    path = write(str(tmp_path / "f.csv"), "h1,h2,h3\n" + "\n".join(body) + '\nopen,"never closed\nat all')
    rows = records.csv_records(spark, path).orderBy("block", "rec").collect()
    assert [x["record"] for x in rows] == ["h1,h2,h3", *body, 'open,"never closed\nat all']
    assert [(x["block"], x["rec"]) for x in rows[:2]] == [(0, 1), (0, 2)]


def test_folder_of_files_each_with_the_header(spark, tmp_path):
    folder = tmp_path / REVIEWS.file
    folder.mkdir()
    for k in range(3):
        write(str(folder / f"part-{k}.csv"), f'{HEADER}\nr{k},o,5,,"a\nb",,\n\n')
    write(str(folder / "empty.csv"), "")
    rows = ingest.read_text_csv(spark, str(folder), REVIEWS)[0].collect()
    assert sorted(x["review_id"] for x in rows) == ["r0", "r1", "r2"] and {x["review_comment_message"] for x in rows} == {"a\nb"}
    write(str(folder / "part-9.csv"), HEADER.replace("review_id", "other") + "\nr9,o,5,,,,\n")
    with pytest.raises(Exception, match="another header"):
        ingest.read_text_csv(spark, str(folder), REVIEWS)[0].collect()


def test_malformed_records_are_counted_alike(spark, tmp_path):
    path = write(str(tmp_path / REVIEWS.file), f'{HEADER}\nr1,o1,5,"t\n",m,,\nr2,"o\n2"\nr3,o3,1,,"x\ny",,,extra,more\n')
    for parallel in (True, False):
        rows = {x["review_id"]: x for x in ingest.read_text_csv(spark, path, REVIEWS, parallel=parallel)[0].collect()}
        assert {k for k, x in rows.items() if x[ingest.MALFORMED] is not None} == {"r2", "r3"}
        assert rows["r2"]["order_id"] == "o\n2" and rows["r2"]["review_score"] is None and rows["r3"]["review_comment_message"] == "x\ny"
