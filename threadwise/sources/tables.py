"""Readers and writers for the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwise.operators.threads import HEAD_CHARS
from threadwise.sources import schemas

# Where the reader leaves a record that has not the fields of the header.
CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType
) -> DataFrame:
    """Read RFC-4180 CSV: header line, doubled quotes, line breaks inside quoted fields.

    Columns are taken by the names in the header, in the schema's order; a column that the file
    lacks is null, and a value that is not of its column's type is null. Files of one export must
    share a header, which is checked. A file with quoted line breaks cannot be split, so each file
    is one task: deliver a large export as many files and convert it to Parquet once.
    """
    found = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    names = {name.strip().lower(): name for name in found.columns}
    return found.select(
        *[
            (F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None))
            .try_cast(f.dataType)
            .alias(f.name)
            for f in schema
        ]
    )


def absent_columns(
    spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "csv"
) -> list[str]:
    """Columns of ``schema`` that a file's header, or a table's own schema, does not have."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    found = {name.strip().lower() for name in reader.format(fmt).load(path).columns}
    return sorted(name for name in schema.names if name.lower() not in found)


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """``read_csv`` with what did not parse: ``file``, ``malformed`` and ``unparsed`` per row.

    ``malformed`` is the text of a record with too few or too many fields, else null; ``unparsed``
    names the columns whose value is there but not of their type.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False}
    names = spark.read.options(**options).csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, CORRUPT]])
    found = spark.read.options(**options, columnNameOfCorruptRecord=CORRUPT).schema(text).csv(path)
    by_name = {name.strip().lower(): F.col(f"`{name}`") for name in names}
    values = {f.name: by_name.get(f.name.lower(), F.lit(None).cast("string")) for f in schema}
    failed = [
        F.when(values[f.name].isNotNull() & values[f.name].try_cast(f.dataType).isNull(), f.name)
        for f in schema
    ]
    return found.select(
        *[values[f.name].try_cast(f.dataType).alias(f.name) for f in schema],
        F.col("_metadata.file_path").alias("file"),
        F.col(CORRUPT).alias("malformed"),
        F.array_compact(F.array(*failed)).alias("unparsed"),
        F.monotonically_increasing_id().alias("row"),
    )


def parse_report(scanned: DataFrame, schema: T.StructType) -> DataFrame:
    """(file, item, n): rows and malformed rows of each file, and unparsed values of each column."""
    items = {"rows": F.count("*"), "malformed": F.count("malformed")}
    for name in schema.names:
        items[name] = F.count_if(F.array_contains("unparsed", name))
    counts = scanned.groupBy("file").agg(*[n.alias(name) for name, n in items.items()])
    return counts.unpivot(["file"], list(items), "item", "n")


def convert_tweets(spark: SparkSession, path: str | list[str], output: str) -> DataFrame:
    """Convert a raw export to Parquet once, all its files side by side; returns the parse report.

    Every record becomes a row, also one that did not parse; its text is kept beside it.
    """
    scan_csv(spark, path, schemas.TWEETS).write.parquet(output)
    return parse_report(spark.read.parquet(output), schemas.TWEETS)


def read_converted(spark: SparkSession, path: str) -> DataFrame:
    """The tweets of a converted export, as ``read_tweets`` gives them."""
    return spark.read.parquet(path).select(
        *[
            F.coalesce("inbound", F.lit(False)).alias(name) if name == "inbound" else name
            for name in schemas.TWEETS.names
        ],
        F.struct("file", "row").alias("ord"),
    )


def read_tweets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan a raw export and add ``ord``, the position of each row in file order."""
    # Rows of one file stay in order inside one task, so (file, running id) is file order.
    return (
        read_csv(spark, path, schemas.TWEETS)
        .withColumn("inbound", F.coalesce("inbound", F.lit(False)))
        .withColumn(
            "ord",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.monotonically_increasing_id().alias("row"),
            ),
        )
    )


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).parquet(path)


def read_conversations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Conversation records; the head and the length come from the dialogue where they are absent."""
    whole = F.col("full_dialogue")
    return read_table(spark, path, schemas.CONVERSATIONS, fmt).select(
        *schemas.CONVERSATIONS.names[:-2],
        F.coalesce("dialogue_head", F.substring(whole, 1, HEAD_CHARS)).alias("dialogue_head"),
        F.coalesce("dialogue_chars", F.length(whole).cast("long")).alias("dialogue_chars"),
    )


def read_dialogue_parts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.DIALOGUE_PARTS, fmt)


def read_golden(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.GOLDEN, fmt)


def read_ratings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.HUMAN_RATINGS, fmt)


def read_judged(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.JUDGED_RESULTS, fmt)


def write_flat(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table without nested columns as Parquet or as CSV with a header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    else:
        writer.parquet(path)


def in_file_order(df: DataFrame, *keys: str) -> DataFrame:
    """Range-sorted by ``keys``: files in the order of their names hold the rows in that order.

    A thread of any length is dealt over files by its parts and can be streamed part by part. The
    ranges come from a sample of ``df``, so hand over a written table, or it is computed twice.
    """
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_nested(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table with nested columns as JSON lines; empty fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
