"""Readers and writers.

Readers take the fixed StructTypes (no schema inference, dates parsed by the
schema), so a malformed value becomes NULL plus a ``_corrupt_record`` entry
instead of silently changing a column type. Writers stay distributed: only
reports with a bounded row count (one row per domain, per severity, ...) are
coalesced to a single file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.sources.schemas import TABLE_SCHEMAS

CORRUPT = "_corrupt_record"
DATE_FORMAT = "yyyy-MM-dd"


def read_csv_table(spark: SparkSession, path: str, table: str, keep_corrupt: bool = False) -> DataFrame:
    """Read one care table from CSV with a header, using its fixed schema."""
    schema = TABLE_SCHEMAS[table]
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema)
          .option("header", True)
          .option("mode", "PERMISSIVE")
          .option("dateFormat", DATE_FORMAT)
          .option("columnNameOfCorruptRecord", CORRUPT)
          .csv(path))
    return df


CSV_OPTIONS = {"mode": "PERMISSIVE", "dateFormat": DATE_FORMAT, "columnNameOfCorruptRecord": CORRUPT}


def parse_csv_lines(lines: DataFrame, line: str, table: str) -> DataFrame:
    """Parse text lines (no header) of one care table: ``row``, the typed columns with the
    corrupt-record column (the line where it doesn't fit the schema), and ``tokens``, the same
    columns as text."""
    schema = TABLE_SCHEMAS[table]
    typed = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return lines.select("*", F.from_csv(line, typed.toDDL(), CSV_OPTIONS).alias("row"),
                        F.from_csv(line, text.toDDL(), {"mode": "PERMISSIVE"}).alias("tokens"))


def csv_rejects(lines: DataFrame, line: str, table: str) -> DataFrame:
    """One row per column of the table and a last one for whole lines: column_name, column_order, rows,
    missing (no text for the column), rejected (text that is no value of its type; for
    lines: those kept in the corrupt-record column). One pass over the lines."""
    names = [f.name for f in TABLE_SCHEMAS[table].fields]
    parsed = parse_csv_lines(lines, line, table)

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))
    aggs = [F.count(F.lit(1)).alias("rows"), n(F.col(f"row.{CORRUPT}").isNotNull()).alias("bad")]
    for i, c in enumerate(names):
        token, value = F.col(f"tokens.{c}"), F.col(f"row.{c}")
        aggs += [n(token.isNull()).alias(f"m{i}"), n(token.isNotNull() & value.isNull()).alias(f"r{i}")]
    one = parsed.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("column_order"), F.col("rows"),
                      F.col(f"m{i}").alias("missing"), F.col(f"r{i}").alias("rejected")) for i, c in enumerate(names)]
    cells.append(F.struct(F.lit("(line)").alias("column_name"), F.lit(len(names) + 1).alias("column_order"), F.col("rows"),
                          F.lit(0).cast("bigint").alias("missing"), F.col("bad").alias("rejected")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def read_parquet_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one care table from Parquet, projecting it onto its fixed schema."""
    schema = TABLE_SCHEMAS[table]
    df = spark.read.parquet(path)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def write_small_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a bounded report (e.g. the 8-row CMS summary) as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """Write a table partitioned by the given columns (e.g. the BI export by
    quarter), so readers prune partitions. Rows are clustered by the partition
    columns first so each task writes few files; the rebalance lets AQE split a
    value with very many rows (one day with most of the events) over several tasks
    and files of the advisory size."""
    (df.hint("rebalance", *partition_by)
       .write.mode(mode).partitionBy(*partition_by).format(fmt)
       .option("header", True).save(path))


# Date partitioning of the event tables: trailing-window filters on these
# columns prune whole partitions at the scan.
DEFAULT_PARTITIONING = {
    "encounters": ["encounter_date"],
    "patient_surveys": ["survey_date"],
    "data_governance_log": ["detected_date"],
    "lab_results": ["result_date"],
}


def ingest(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str,
           partition_by: dict[str, list[str]] | None = None) -> None:
    """Persist the care tables as Parquet (event tables partitioned by date by
    default), the form later analyses read with partition pruning and
    predicate pushdown (``care_tables(spark, out_dir, stored=True)``)."""
    parts = DEFAULT_PARTITIONING if partition_by is None else partition_by
    for name, df in tables.items():
        cols = parts.get(name)
        target = f"{out_dir.rstrip('/')}/{name}"
        if cols:
            write_partitioned(df, target, cols)
        else:
            df.write.mode("overwrite").parquet(target)


def ingest_bucketed(spark: SparkSession, tables: dict[str, DataFrame], prefix: str, key: str = "encounter_id",
                    buckets: int = 200) -> None:
    """Save the care tables as catalog tables ``<prefix><name>``; those with ``key`` are bucketed and sorted
    by it, so that joins and aggregates on it read bucket against bucket without an exchange.
    Choose ``buckets`` for files of about the size of a task's input."""
    for name, df in tables.items():
        target = f"{prefix}{name}"
        if key in df.columns:
            (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
               .format("parquet").saveAsTable(target))
        else:
            df.write.mode("overwrite").format("parquet").saveAsTable(target)
