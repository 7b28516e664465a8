"""Tables are replaced as a whole: readers see the version before or the one after, never none."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from lateflow.sources import ingest, versions
from lateflow.sources.schemas import LOAD_PLAN

from conftest import ROOT

SELLERS = next(s for s in LOAD_PLAN if s.table == "sellers")


def fill(spark, n):
    return lambda at: spark.range(n).write.parquet(at)


def rows(spark, path) -> int:
    return spark.read.parquet(versions.current(spark, path)).count()


def test_publish_switches_and_drops_old_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 4, 5):
        versions.publish(spark, path, fill(spark, n))
        assert rows(spark, path) == n
    assert sum(x.startswith("v-") for x in os.listdir(path)) == 2  # the current one and the one before
    assert sum(x.startswith(versions.POINTER) for x in os.listdir(path)) == 2


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish(spark, path, fill(spark, 3))

    def half(at):
        spark.range(9).write.parquet(at)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.publish(spark, path, half)
    assert rows(spark, path) == 3
    assert len(versions.vacuum(spark, path)) == 1 and rows(spark, path) == 3
    versions.publish(spark, path, fill(spark, 6))
    assert rows(spark, path) == 6


def test_a_killed_job_leaves_the_table(spark, tmp_path):
    """The process is killed with part files of the new version written."""
    path = str(tmp_path / "t")
    versions.publish(spark, path, fill(spark, 3))
    job = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
from lateflow.session import get_session
from lateflow.sources import versions
spark = get_session("local[1]")
def write(at):
    spark.range(50).write.parquet(at)
    print("written", at, flush=True)
    os.kill(os.getpid(), 9)
versions.publish(spark, {path!r}, write)
"""
    done = subprocess.run([sys.executable, "-c", job], capture_output=True, text=True, timeout=120)
    assert done.returncode == -9 and "written" in done.stdout
    assert rows(spark, path) == 3
    assert len(versions.vacuum(spark, path)) == 1 and rows(spark, path) == 3


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(2).write.parquet(path)
    assert versions.current(spark, path) == path and rows(spark, path) == 2


def load(spark, folder, text, **options):
    with open(os.path.join(folder, SELLERS.file), "w") as f:
        f.write("seller_id,seller_zip_code_prefix,seller_city,seller_state\n" + text)
    return ingest.load_table(spark, str(folder), SELLERS, str(folder / "raw"), **options)


def test_a_load_that_fails_leaves_the_table_and_its_rejects(spark, tmp_path):
    load(spark, tmp_path, "s1,1,a,SP\ns2,short\n")
    read = lambda: ingest.read_loaded(spark, str(tmp_path / "raw"), SELLERS)
    assert read().count() == 2
    with pytest.raises(ingest.MalformedSource):
        load(spark, tmp_path, "s3,1,a,SP\ns4,short\ns5\n", fail_on_malformed=True)
    assert {x["seller_id"] for x in read().collect()} == {"s1", "s2"}
    reject = ingest.read_rejects(spark, str(tmp_path / "raw"), [SELLERS]).collect()
    assert [(x["table_name"], x["record"], x["column_name"], x["reason"]) for x in reject] == [("sellers", "s2,short", None, "number of fields")]
    assert reject[0]["source_file"].endswith(SELLERS.file)


def test_rejects_of_typed_columns(spark, tmp_path):
    """Each reject has its record, column, value and reason; counts are those of the load report; values that are null are no rejects."""
    items = next(s for s in LOAD_PLAN if s.table == "order_items")
    with open(tmp_path / items.file, "w") as f:
        f.write(",".join(x.name for x in items.schema.fields) + '\no1,1,p,s,2017-09-19 09:45:35,NA,abc\no2,x,p,s,never,1.5,\n"o,3",2,p,s,,"1,5",2\n')
    got = ingest.load_table(spark, str(tmp_path), items, str(tmp_path / "raw"))
    reject = ingest.read_rejects(spark, str(tmp_path / "raw"), [items]).collect()
    assert sorted((x["column_name"], x["value"], x["reason"]) for x in reject) == [
        ("freight_value", "abc", "not a decimal(12,2)"),
        ("order_item_id", "x", "not a int"),
        ("price", "1,5", "not a decimal(12,2)"),
        ("shipping_limit_date", "never", "not a timestamp_ntz"),
    ]
    assert got.rows == 3 and got.rejects == {x["column_name"]: 1 for x in reject}
    assert next(x["record"] for x in reject if x["column_name"] == "price") == '"o,3",2,p,s,,"1,5",2'
    assert ingest.read_loaded(spark, str(tmp_path / "raw"), items).count() == 3
    assert ingest.read_rejects(spark, str(tmp_path / "none")).count() == 0
