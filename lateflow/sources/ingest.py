"""CSV ingest of the raw layer.

For every ``TableSpec`` of the load plan:

1. read the header, bind columns **by name** whatever their order, fail on a
   column the table needs and the file lacks, and report columns the table
   does not know. A path may be one file or a folder of part files, each with the same
   header (a file with another one fails the load);
   scan the CSV with every column as text (UTF-8, RFC-4180 quoting:
   ``quote='"'``, ``escape='"'`` so doubled quotes and embedded newlines parse;
   files with line breaks in fields go through ``records.csv_records``, which
   reads one file in many tasks). Rows with too few or too many fields are
   counted as ``malformed_rows``: missing fields load as NULL, surplus ones are
   not stored, and ``fail_on_malformed`` turns any such row into an error;
2. clean each field the way the reference's loader does: a field equal to a
   pandas NA token (compared untrimmed) becomes NULL, then Python-``strip()``
   whitespace is removed, then an empty string becomes NULL;
3. cast to the declared type with ``try_cast`` / ``try_to_timestamp``; a
   non-empty value that does not parse becomes NULL and is **counted** as a
   reject (the reference's loader would have failed or silently shifted it).
   Integer columns accept integral decimals such as ``40.0``, which is what a
   pandas round trip writes for an int column with blanks;
4. write the typed table and, beside it in the same pass, one reject row for
   each value that did not parse and each record with a wrong number of
   fields: source file, the record, column, value and reason (``read_rejects``);
5. count rows and rejects with an ``Observation`` attached to the write, so
   the report needs no second scan;
6. publish the new version only then (``versions``, full refresh: reruns do not
   duplicate rows). A load that fails or is killed leaves the version before it in place.

A missing file writes an empty typed table and reports ``missing``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateflow.functions.expr import strip_text
from lateflow.sources import versions
from lateflow.sources.records import csv_records
from lateflow.sources.schemas import LOAD_PLAN, NA_TOKENS, TableSpec

MALFORMED = "_malformed"
FILE, RECORD, PART = "_file", "_record", "_part"
REJECTS = T.StructType([T.StructField(n, T.StringType(), True) for n in ("source_file", "record", "column_name", "value", "reason")])


class MalformedSource(ValueError):
    """A source file that cannot be loaded as the table it is meant for."""


QUOTING = {"quote": '"', "escape": '"', "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}


def _csv_reader(spark: SparkSession, spec: TableSpec):
    return (
        spark.read.options(**QUOTING)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", spec.multiline)
        .option("nullValue", None)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def _scan_records(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Text fields ``c0, c1, ...``, ``MALFORMED``, ``FILE`` and ``RECORD`` of files whose fields hold line breaks, read in parallel."""
    records = csv_records(spark, path).where(F.length("record") > 0)
    places = [f"c{i}" for i in range(len(header))]
    fields = ", ".join(f"{c} string" for c in [*places, MALFORMED])
    # a value that no field has: quoted empty fields stay empty text here, as in the other reader
    parsed = F.from_csv("record", F.lit(fields), QUOTING | {"multiLine": "true", "nullValue": "\0"})
    first = (F.col("block") == 0) & (F.col("rec") == 1)
    scan = records.select("file", "record", first.alias("first"), parsed.alias("c"))
    # every part file must have the same header
    same = F.array(*(F.col(f"c.{c}") for c in places)) == F.array(*map(F.lit, header))
    other = F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean")
    return scan.where(F.when(~F.col("first"), True).when(same, False).otherwise(other)).select("c.*", F.col("file").alias(FILE), F.col("record").alias(RECORD))


def read_text_csv(spark: SparkSession, path: str, spec: TableSpec, parallel: bool = True) -> tuple[DataFrame, list[str]]:
    """Scan a CSV, columns bound by header name, every column as string, and
    ``MALFORMED`` (the record, where its number of fields is wrong), ``FILE`` and ``RECORD`` (as in the
    file, or for files without line breaks in fields written anew from all its fields). Also the
    names of columns the table does not know.

    Without ``parallel`` a file with line breaks in fields is read by Spark's own ``multiLine``, in one task."""
    header = _csv_reader(spark, spec).csv(path).columns
    wanted = [f.name for f in spec.schema.fields]
    place = {}
    for i, name in enumerate(header):
        place.setdefault(name.strip().removeprefix("\ufeff"), i)
    missing = [n for n in wanted if n not in place]
    if missing:
        raise MalformedSource(f"{path} lacks the columns {missing} of {spec.table}; its header is {header}")
    if spec.multiline and parallel:
        scan = _scan_records(spark, path, [n.removeprefix("\ufeff") for n in header])
    else:
        text = T.StructType([T.StructField(n, T.StringType(), True) for n in [*header, MALFORMED]])
        scan = (
            _csv_reader(spark, spec)
            .schema(text)
            .option("enforceSchema", False)  # every part file must have this header
            .option("columnPruning", False)  # the number of fields counts, also of those not loaded
            .csv(path)
        )
        file = F.col("_metadata.file_path").alias(FILE)
        scan = scan.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(header)), MALFORMED, file)
        fields = F.struct(*(f"c{i}" for i in range(len(header))))
        scan = scan.withColumn(RECORD, F.coalesce(MALFORMED, F.to_csv(fields, {"quote": '"', "escape": '"'})))
    columns = [F.col(f"c{place[n]}").alias(n) for n in wanted]
    return scan.select(*columns, MALFORMED, FILE, RECORD), [n for n in place if n not in wanted]


def clean_text(c: Column, na_tokens=NA_TOKENS) -> Column:
    """NA token -> NULL (untrimmed match), strip whitespace, '' -> NULL."""
    stripped = strip_text(F.when(~c.isin(*na_tokens), c))
    return F.nullif(stripped, F.lit(""))


def typed(c: Column, dtype: T.DataType) -> Column:
    """Cast cleaned text to ``dtype``; unparseable values become NULL."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.TimestampNTZType):
        return c.try_cast("timestamp_ntz")  # never through a zoned timestamp
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        as_dec = c.try_cast("decimal(38,6)")
        integral = as_dec == F.floor(as_dec)
        return F.when(integral, as_dec.try_cast(dtype.simpleString()))
    value = c.try_cast(dtype.simpleString())
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # NaN spelled in a case the NA tokens miss still becomes NULL, never a
        # NaN that would sort above every number in max().
        return F.when(~F.isnan(value), value)
    return value


def clean_columns(spec: TableSpec) -> tuple[list[Column], dict[str, Column]]:
    """Typed, cleaned column expressions over the text scan, and per typed column
    whether a non-empty value did not parse (also over the text scan)."""
    cols, bad = [], {}
    for f in spec.schema.fields:
        text = clean_text(F.col(f.name))
        value = typed(text, f.dataType)
        cols.append(value.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            bad[f.name] = text.isNotNull() & value.isNull()
    return cols, bad


def rows_and_rejects(scan: DataFrame, spec: TableSpec) -> DataFrame:
    """Each record's typed row (``PART`` = rows) and a row for each of its rejects (``PART`` = rejects), all from one scan."""
    cols, bad = clean_columns(spec)
    types = {f.name: f.dataType.simpleString() for f in spec.schema.fields}
    nothing = [F.lit(None).cast(t).alias(n) for n, t in types.items()]
    said = [f.name for f in REJECTS.fields]
    no_reject = [F.lit(None).cast("string").alias(n) for n in said]

    def reject(column: str | None, value: Column, reason: str) -> Column:
        made = (F.col(FILE), F.col(RECORD), F.lit(column).cast("string"), value, F.lit(reason))
        return F.struct(F.lit("rejects").alias(PART), *nothing, *(v.alias(n) for n, v in zip(said, made)))

    row = F.struct(F.lit("rows").alias(PART), *cols, *no_reject)
    parts = [row, F.when(F.col(MALFORMED).isNotNull(), reject(None, F.lit(None).cast("string"), "number of fields"))]
    parts += [F.when(is_bad, reject(n, F.col(n), f"not a {types[n]}")) for n, is_bad in bad.items()]
    return scan.select(F.inline(F.array_compact(F.array(*parts))))


def clean_table(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """The typed, cleaned table from a text scan."""
    return raw.select(*clean_columns(spec)[0])


@dataclass
class LoadResult:
    table: str
    file: str
    status: str
    rows: int
    rejects: dict[str, int]
    malformed_rows: int = 0
    unknown_columns: tuple[str, ...] = ()


def source_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system the session reads
    (local, HDFS, object store): a listing, no data is read."""
    try:
        spark.read.format("text").load(path)
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return False
        raise


def load_table(spark: SparkSession, data_dir: str, spec: TableSpec, target_dir: str, fail_on_malformed: bool = False) -> LoadResult:
    """Load one CSV as a new version of ``target_dir/<table>`` (parquet), with its rejects beside it."""
    path = f"{data_dir.rstrip('/')}/{spec.file}"
    out = f"{target_dir.rstrip('/')}/{spec.table}"
    if not source_exists(spark, path):
        versions.publish(spark, out, lambda at: spark.createDataFrame([], spec.schema).write.parquet(f"{at}/{PART}=rows"))
        return LoadResult(spec.table, spec.file, "missing", 0, {})
    scan, unknown = read_text_csv(spark, path, spec)
    obs = Observation(f"load_{spec.table}")
    metrics = [F.count(F.lit(1)).alias("rows"), F.count(MALFORMED).alias("malformed")]
    metrics += [F.count_if(is_bad).alias(f"reject_{k}") for k, is_bad in clean_columns(spec)[1].items()]

    def write(at: str) -> None:
        # metrics are computed on the text scan as rows stream into the write
        both = rows_and_rejects(scan.observe(obs, *metrics), spec)
        both.write.partitionBy(PART).parquet(at)
        if not obs.get["rows"]:
            spark.createDataFrame([], spec.schema).write.mode("overwrite").parquet(f"{at}/{PART}=rows")
        if fail_on_malformed and obs.get["malformed"]:  # before the version is published
            raise MalformedSource(f"{path} has {obs.get['malformed']} rows with too few or too many fields")

    versions.publish(spark, out, write)
    got = obs.get
    return LoadResult(
        spec.table,
        spec.file,
        "loaded",
        int(got["rows"]),
        {k.removeprefix("reject_"): int(n) for k, n in got.items() if k.startswith("reject_") and n},
        int(got["malformed"]),
        tuple(unknown),
    )


def table_path(spark: SparkSession, target_dir: str, table: str) -> str:
    """Folder of the current version of a loaded table's rows."""
    at = versions.current(spark, f"{target_dir.rstrip('/')}/{table}")
    loaded = f"{at}/{PART}=rows"
    return loaded if versions.exists(spark, loaded) else at


def read_rejects(spark: SparkSession, target_dir: str, plan=LOAD_PLAN) -> DataFrame:
    """Rejects of the current versions: ``table_name, source_file, record, column_name, value, reason``; a record with a wrong number
    of fields has no column and value."""
    out = spark.createDataFrame([], REJECTS).select(F.lit("").alias("table_name"), "*")
    for spec in plan:
        at = f"{versions.current(spark, f'{target_dir.rstrip("/")}/{spec.table}')}/{PART}=rejects"
        if versions.exists(spark, at):
            own = spark.read.schema(REJECTS).parquet(at)
            out = out.unionByName(own.select(F.lit(spec.table).alias("table_name"), "*"))
    return out


def load_all(spark: SparkSession, data_dir: str, target_dir: str, plan=LOAD_PLAN, parallel: int = 4) -> DataFrame:
    """Load every table of the plan; return the load report as a DataFrame.

    Tables are independent jobs, submitted from ``parallel`` driver threads.
    Report columns: table_name, source_file, status, rows, rejects (map of
    column -> count of unparseable values), malformed_rows, unknown_columns, in plan order; the last row is
    the total.
    """
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        results = list(pool.map(lambda spec: load_table(spark, data_dir, spec, target_dir), plan))
    total = LoadResult("TOTAL", "", "", sum(r.rows for r in results), {}, sum(r.malformed_rows for r in results))
    schema = (
        "table_name string, source_file string, status string, rows bigint, rejects map<string,bigint>, "
        "malformed_rows bigint, unknown_columns array<string>"
    )
    return spark.createDataFrame(
        [
            (r.table, r.file, r.status, r.rows, r.rejects, r.malformed_rows, list(r.unknown_columns))
            for r in results + [total]
        ],
        schema,
    )


def read_loaded(spark: SparkSession, target_dir: str, spec: TableSpec) -> DataFrame:
    """One loaded table, in its current version."""
    return spark.read.schema(spec.schema).parquet(table_path(spark, target_dir, spec.table))


def read_raw(spark: SparkSession, target_dir: str, plan=LOAD_PLAN):
    """The loaded raw layer as a ``RawModel`` (typed parquet tables)."""
    from lateflow.sources.schemas import RawModel

    return RawModel(**{spec.table: read_loaded(spark, target_dir, spec) for spec in plan})
