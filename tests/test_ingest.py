"""CSV ingest: quoting, NA tokens, whitespace, rejects, missing files, reruns."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest

from lateflow.sources import ingest
from lateflow.sources.schemas import LOAD_PLAN

SPECS = {s.table: s for s in LOAD_PLAN}


def _write(folder: str, name: str, text: str, bom: bool = False) -> None:
    with open(os.path.join(folder, name), "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        f.write(text)


def _fixture_folder(root: str) -> str:
    src = os.path.join(root, "csv")
    os.makedirs(src)
    _write(
        src,
        "olist_customers_dataset.csv",
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        "c1,u1,01234,  sao paulo ,SP\n"
        'c2,u2,"\t 05678 \t",NA,   \n'
        "c3,u3,,N/A,rj\n",
        bom=True,
    )
    _write(
        src,
        "olist_order_reviews_dataset.csv",
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"line one\nline two, with comma and ""quotes""",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
        'r2,o1,40.0,t,"trailing backslash \\",2018-01-19 00:00:00,\n'
        'r3,o2,4.5,"\n padded title \n",,not a date,2018-02-01 10:00:00\n'
        "r4,,3,,,2018-03-01 00:00:00,2018-03-02 00:00:00\n",
    )
    _write(
        src,
        "olist_order_items_dataset.csv",
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,p1,s1,2017-09-19 09:45:35,58.90,13.29\n"
        "o1,2,p2,s2,2017-09-19 09:45:35,NaN,abc\n",
    )
    return src


def test_load_all(spark, tmpdir_path):
    src = _fixture_folder(tmpdir_path)
    target = os.path.join(tmpdir_path, "raw")
    report = {r["table_name"]: r for r in ingest.load_all(spark, src, target).collect()}

    assert report["customers"]["status"] == "loaded" and report["customers"]["rows"] == 3
    assert report["order_reviews"]["rows"] == 4
    assert report["sellers"]["status"] == "missing" and report["sellers"]["rows"] == 0
    assert report["TOTAL"]["rows"] == 3 + 4 + 2
    # '4.5' is not an integer and 'not a date' is not a timestamp
    assert report["order_reviews"]["rejects"] == {"review_score": 1, "review_creation_date": 1}
    assert report["order_items"]["rejects"] == {"freight_value": 1}

    raw = ingest.read_raw(spark, target)
    cust = {r["customer_id"]: r for r in raw.customers.collect()}
    assert cust["c1"]["customer_zip_code_prefix"] == "01234"  # leading zero kept
    assert cust["c1"]["customer_city"] == "sao paulo"  # stripped
    assert cust["c2"]["customer_zip_code_prefix"] == "05678"  # tab/newline stripped
    assert cust["c2"]["customer_city"] is None  # NA token
    assert cust["c2"]["customer_state"] is None  # whitespace only
    assert cust["c3"]["customer_zip_code_prefix"] is None  # empty
    assert cust["c3"]["customer_city"] is None  # N/A token

    rev = {r["review_id"]: r for r in raw.order_reviews.collect()}
    assert rev["r1"]["review_comment_message"] == 'line one\nline two, with comma and "quotes"'
    assert rev["r1"]["review_answer_timestamp"] == dt.datetime(2018, 1, 18, 21, 46, 59)
    assert rev["r2"]["review_score"] == 40  # integral decimal accepted
    assert rev["r2"]["review_comment_message"] == "trailing backslash \\"
    assert rev["r2"]["review_answer_timestamp"] is None  # blank datetime
    assert rev["r3"]["review_score"] is None and rev["r3"]["review_creation_date"] is None
    assert rev["r3"]["review_comment_title"] == "padded title"  # newline padding stripped
    assert rev["r4"]["order_id"] is None

    items = raw.order_items.collect()
    assert {r["price"] for r in items} == {Decimal("58.90"), None}
    assert raw.sellers.count() == 0
    assert [f.name for f in raw.sellers.schema.fields] == [f.name for f in SPECS["sellers"].schema.fields]


def test_rerun_does_not_duplicate(spark, tmpdir_path):
    src = _fixture_folder(tmpdir_path)
    target = os.path.join(tmpdir_path, "raw")
    first = {r["table_name"]: r["rows"] for r in ingest.load_all(spark, src, target).collect()}
    second = {r["table_name"]: r["rows"] for r in ingest.load_all(spark, src, target).collect()}
    assert first == second
    assert ingest.read_raw(spark, target).customers.count() == 3


def test_clean_text_matches_python_strip(spark):
    from pyspark.sql import functions as F

    samples = ["  a  ", "\t b\n", " c ", "d", "   ", "", " NA", "NA", "null"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r[0] for r in df.select(ingest.clean_text(F.col("v"))).collect()]
    na = {"NA", "null", ""}
    want = [None if (s in na or s.strip() == "") else s.strip() for s in samples]
    assert got == want


def test_nan_spellings_become_null(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = spark.createDataFrame([("NAN",), ("nAn",), ("1.5",)], "v string")
    got = [r[0] for r in df.select(ingest.typed(ingest.clean_text(F.col("v")), T.DoubleType())).collect()]
    assert got == [None, None, 1.5]


def test_columns_are_bound_by_name(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "csv")
    os.makedirs(src)
    _write(src, "olist_sellers_dataset.csv", "seller_state,extra,seller_city,seller_id,seller_zip_code_prefix\nSP,x,Sao Paulo,s1,01000\n")
    result = ingest.load_table(spark, src, SPECS["sellers"], os.path.join(tmpdir_path, "raw"))
    assert result.status == "loaded" and result.unknown_columns == ("extra",) and result.malformed_rows == 0
    row = ingest.read_loaded(spark, os.path.join(tmpdir_path, "raw"), SPECS["sellers"]).first()
    assert (row["seller_id"], row["seller_zip_code_prefix"], row["seller_city"], row["seller_state"]) == ("s1", "01000", "Sao Paulo", "SP")


def test_a_missing_column_fails(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "csv")
    os.makedirs(src)
    _write(src, "olist_sellers_dataset.csv", "seller_id,seller_city,seller_state\ns1,c,SP\n")
    with pytest.raises(ingest.MalformedSource, match="seller_zip_code_prefix"):
        ingest.load_table(spark, src, SPECS["sellers"], os.path.join(tmpdir_path, "raw"))


def test_short_and_long_rows_are_counted(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "csv")
    os.makedirs(src)
    _write(
        src,
        "olist_customers_dataset.csv",
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        "c1,u1,01234,sao paulo,SP\nc2,u2,05678\nc3,u3,1,x,RJ,more,fields\n",
    )
    target = os.path.join(tmpdir_path, "raw")
    result = ingest.load_table(spark, src, SPECS["customers"], target)
    assert (result.rows, result.malformed_rows) == (3, 2)
    states = {r["customer_id"]: r["customer_state"] for r in ingest.read_loaded(spark, target, SPECS["customers"]).collect()}
    assert states == {"c1": "SP", "c2": None, "c3": "RJ"}
    with pytest.raises(ingest.MalformedSource, match="2 rows"):
        ingest.load_table(spark, src, SPECS["customers"], target, fail_on_malformed=True)
