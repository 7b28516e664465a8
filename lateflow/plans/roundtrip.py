"""The raw layer written as CSV files and loaded again: ingest as registered jobs.

Files lie under the session's shared checkpoint folder. ``orders`` is written
with its columns in reverse order, as columns are bound by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateflow.session import scratch_path
from lateflow.sources.ingest import load_all, load_table, read_loaded, read_raw, read_rejects
from lateflow.sources.schemas import LOAD_PLAN, RawModel

SPECS = {spec.table: spec for spec in LOAD_PLAN}


def export_csv(df: DataFrame, table: str, folder: str) -> None:
    """Write one raw table as a folder of CSV part files under its file name of the load plan."""
    columns = [f.name for f in SPECS[table].schema.fields]
    ordered = reversed(columns) if table == "orders" else columns
    (
        df.select(*ordered)
        .write.option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("quote", '"')
        .option("escape", '"')
        .csv(f"{folder}/{SPECS[table].file}")
    )


def round_trip(spark: SparkSession, raw: RawModel, table: str) -> DataFrame:
    """One raw table after a write to CSV and a load."""
    folder = scratch_path(spark, "csv")
    export_csv(raw.tables()[table], table, folder)
    load_table(spark, folder, SPECS[table], f"{folder}/raw")
    return read_loaded(spark, f"{folder}/raw", SPECS[table])


def _field(c: Column) -> Column:
    """A value as a CSV field: quoted, quotes doubled; null as nothing."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def write_lines(df: DataFrame, line: Column, header: str, path: str) -> None:
    """Write one line of text per row as it is, as part files that each carry the header."""
    plain = {"header": True, "quote": "", "escapeQuotes": False, "sep": "\x01", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(line.alias(header)).write.options(**plain).csv(path)


def round_trip_reviews(spark: SparkSession, raw: RawModel) -> DataFrame:
    """Reviews with titles and messages that hold commas, doubled quotes and line breaks, loaded through their physical lines.

    Every third message opens and closes many quotes, and every seventh runs over several lines."""
    folder, spec = scratch_path(spark, "csv"), SPECS["order_reviews"]
    text = F.col("review_id").cast("string")
    title = F.when(F.col("review_id") % 4 == 0, F.concat(F.lit('a "b", '), text))
    message = (
        F.when(F.col("review_id") % 7 == 0, F.concat(F.lit("first\n\nthird, "), text, F.lit('\n"fifth"')))
        .when(F.col("review_id") % 3 == 0, F.concat(F.lit('""'), text, F.lit('","')))
        .when(F.col("review_id") % 5 == 0, F.lit("\n"))
    )
    reviews = raw.order_reviews.withColumns({"review_comment_title": title, "review_comment_message": message})
    export_csv(reviews, "order_reviews", folder)
    load_table(spark, folder, spec, f"{folder}/raw")
    return read_loaded(spark, f"{folder}/raw", spec)


def dirty_cells(spark: SparkSession, raw: RawModel) -> DataFrame:
    """Products through CSV with blanks around texts, NA tokens, NaN in two spellings and empty fields: what each row of cells loads as."""
    folder, spec = scratch_path(spark, "csv"), SPECS["products"]
    k = F.col("product_id")
    name = F.when(k % 5 == 0, F.lit("NA")).when(k % 5 == 1, F.lit("  n/a")).when(k % 5 == 2, F.concat(F.lit("\t "), k.cast("string"), F.lit(" \u00a0"))).when(k % 5 == 3, F.lit(""))
    weight = F.when(k % 4 == 0, F.lit("NaN")).when(k % 4 == 1, F.lit("nAn")).when(k % 4 == 2, F.lit("   ")).otherwise(k.cast("string"))
    photos = F.when(k % 3 == 0, F.lit("40.0")).when(k % 3 == 1, F.lit("NULL"))
    cells = {"product_category_name": name, "product_weight_g": weight, "product_photos_qty": photos}
    names = [f.name for f in spec.schema.fields]
    line = F.array_join(F.array(*(_field(cells.get(n, F.col(n))) if n in cells or n == "product_id" else F.lit("") for n in names)), ",")
    write_lines(raw.products, line, ",".join(names), f"{folder}/{spec.file}")
    load_table(spark, folder, spec, f"{folder}/raw")
    loaded = read_loaded(spark, f"{folder}/raw", spec)
    return loaded.select("product_id", *cells)


def load_rejects(spark: SparkSession, raw: RawModel) -> DataFrame:
    """Rejects of an items file in which numbers, stamps and field counts are spoilt by the row's keys: counts by column and reason
    beside those of the load report."""
    folder, spec = scratch_path(spark, "csv"), SPECS["order_items"]
    k = F.col("order_id") + F.col("order_item_id")
    cells = {
        "order_item_id": F.when(k % 11 == 0, F.lit("1.5")).otherwise(F.col("order_item_id").cast("string")),
        "price": F.when(k % 5 == 0, F.lit("12,50")).otherwise(F.col("price").cast("string")),
        "shipping_limit_date": F.when(k % 7 == 0, F.lit("31/12/1997")).otherwise(F.date_format("shipping_limit_date", "yyyy-MM-dd HH:mm:ss")),
    }
    names = [f.name for f in spec.schema.fields]
    fields = [_field(cells.get(n, F.col(n))) for n in names]
    line = F.when(k % 13 == 0, F.array_join(F.array(*fields[:-1]), ",")).otherwise(F.array_join(F.array(*fields), ","))
    write_lines(raw.order_items, line, ",".join(names), f"{folder}/{spec.file}")
    got = load_table(spark, folder, spec, f"{folder}/raw")
    said = [(c, n) for c, n in got.rejects.items()] + [(None, got.malformed_rows)]
    report = spark.createDataFrame(said, "column_name string, reported long")
    rejects = read_rejects(spark, f"{folder}/raw", [spec])
    counted = rejects.groupBy("column_name", "reason").agg(
        F.count(F.lit(1)).alias("rejects"), F.count_distinct("value").alias("distinct_values"), F.min("value").alias("least_value"), F.count("record").alias("with_record")
    )
    same = counted["column_name"].eqNullSafe(report["column_name"])
    return counted.join(report, same).select(counted["column_name"], "reason", "rejects", "distinct_values", "least_value", "with_record", "reported")


def round_trip_report(spark: SparkSession, raw: RawModel) -> DataFrame:
    """All tables through CSV: rows, filled cells and characters of the first column of each."""
    folder, out = scratch_path(spark, "csv"), None
    for table, df in raw.tables().items():
        export_csv(df, table, folder)
    load_all(spark, folder, f"{folder}/raw")
    loaded_tables = read_raw(spark, f"{folder}/raw").tables()
    for spec in LOAD_PLAN:
        names = [f.name for f in spec.schema.fields]
        loaded = loaded_tables[spec.table]
        filled = sum((F.count(c) for c in names[1:]), F.count(names[0]))
        part = loaded.agg(
            F.lit(spec.table).alias("table_name"),
            F.count(F.lit(1)).alias("rows"),
            filled.cast("bigint").alias("filled_cells"),
            F.sum(F.length(names[0])).cast("bigint").alias("key_chars"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def malformed_report(spark: SparkSession, raw: RawModel) -> DataFrame:
    """Load report of a sellers file in which some rows are short (id mod 10 = 3) or long (7); no other file is there."""
    folder, spec = scratch_path(spark, "csv"), SPECS["sellers"]
    key = F.col("seller_id")
    fields = [F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in spec.schema.fields]
    lines = raw.sellers.select(
        F.when(key % 10 == 3, F.concat_ws(",", *fields[:3]))
        .when(key % 10 == 7, F.concat_ws(",", *fields, F.lit("x"), F.lit("y")))
        .otherwise(F.concat_ws(",", *fields))
        .alias("value")
    )
    # every part file carries the header, as a CSV writer's do
    lines.write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").csv(f"{folder}/lines")
    text = spark.read.text(f"{folder}/lines").filter(F.col("value") != "value")
    header = ",".join(f.name for f in spec.schema.fields)
    text.select(F.col("value").alias(header)).write.option("header", True).option("quote", "").option("sep", "\x01").csv(f"{folder}/{spec.file}")
    report = load_all(spark, folder, f"{folder}/raw")
    return report.select("table_name", "source_file", "status", "rows", "malformed_rows")
