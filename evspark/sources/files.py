"""CSV and JSON-lines files as typed rows, with what can't be read kept as rejects.

A reader gives two tables: the rows, and the rejects with their file, place in it (from 1), raw text and reason. A place is a record
of a CSV file, header aside, or a line of a JSON-lines file; it comes from the order within the parts that a file is read
in and the sizes of the parts before, so no file is read by one task for its sake. Blank JSON lines are nothing.

Values are re-typed from text: empty text is null, and a value that doesn't fit its type makes a reject, unless the column may
be lenient: then it is null. Null and empty tables, and folders of no rows, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from evspark.operators.ingest import normalise_columns, object_fields

REJECTS = ("file", "at", "raw", "reason")
_PLACE = ("__file", "__block", "__order")


def _placed(df: DataFrame) -> DataFrame:
    """df with the file, the part of it and the order in which each row was read."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__order"))


def _rejected(rows: DataFrame, every: DataFrame) -> DataFrame:
    """(file, at, raw, reason) of rows with raw and reason; ``every`` has the places of all rows that were read."""
    parts = every.groupBy("__file", "__block").agg(F.min("__order").alias("__least"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    placed = rows.join(parts, ["__file", "__block"])
    at = F.col("__before") + F.col("__order") - F.col("__least") + 1
    return placed.select(F.col("__file").alias("file"), at.alias("at"), "raw", "reason")


def _misfit(values: dict[str, Column], types: dict[str, str], lenient: tuple[str, ...]) -> tuple[dict[str, Column], Column]:
    """(typed values, the reason of the first value that has text but doesn't fit)."""
    typed, reason = {}, F.lit(None).cast("string")
    for name, value in reversed(values.items()):
        given = F.nullif(F.trim(value), F.lit("")) if types[name] != "string" else value
        typed[name] = given.try_cast(types[name])
        if name not in lenient:
            reason = F.when(given.isNotNull() & typed[name].isNull(), F.lit(f"type: {name}")).otherwise(reason)
    return dict(reversed(typed.items())), reason


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, *, lenient: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a header; quoted values may hold line ends, quotes are doubled within.

    Columns get their usual names first (``normalise_columns``); ``types`` re-types some of them, the others stay text. A record of more or
    fewer values than the header is a reject.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    names = reader.option("inferSchema", False).csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in [*names, "__raw"]])
    given = _placed(reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__raw").csv(path))
    given = normalise_columns(given)
    kept = [c for c in given.columns if c not in (*_PLACE, "__raw")]
    types = {c: "string" for c in kept} | {c: t for c, t in (types or {}).items() if c in kept}
    typed, misfit = _misfit({c: F.col(f"`{c}`") for c in kept}, types, lenient)
    judged = given.withColumn("reason", F.when(F.col("__raw").isNotNull(), "fields").otherwise(misfit))
    raw = F.coalesce("__raw", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in kept])))
    rows = judged.where(F.col("reason").isNull()).select(*[v.alias(c) for c, v in typed.items()])
    bad = judged.where(F.col("reason").isNotNull()).select(*_PLACE, raw.alias("raw"), "reason")
    return rows, _rejected(bad, judged)


def read_json_lines(spark: SparkSession, path: str, types: dict[str, str], *, lenient: tuple[str, ...] = (), rest: str | None = "rest") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files with a JSON object on each line.

    ``types`` names the keys that become columns; all other keys are kept, as they are, in the variant column ``rest`` (null where
    there are none). A line that is no JSON object is a reject.
    """
    lines = _placed(spark.read.text(path)).where(F.trim("value") != "").withColumn("__v", F.try_parse_json("value"))
    fields = object_fields(F.col("__v"))
    typed, misfit = _misfit({k: F.try_variant_get("__v", f"$['{k}']", "string") for k in types}, types, lenient)
    judged = lines.withColumn("__fields", fields)
    judged = judged.withColumn("reason", F.when(F.col("__fields").isNull(), "no object").otherwise(misfit))
    columns = [v.alias(k) for k, v in typed.items()]
    if rest:
        others = F.map_filter("__fields", lambda k, v: ~k.isin(*types))
        columns.append(F.when(F.size(others) > 0, F.to_variant_object(others)).alias(rest))
    rows = judged.where(F.col("reason").isNull()).select(*columns)
    bad = judged.where(F.col("reason").isNotNull()).select(*_PLACE, F.col("value").alias("raw"), "reason")
    return rows, _rejected(bad, _placed(spark.read.text(path)))


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Appends rejects as JSON lines, to be mended and read again."""
    rejects.select(*REJECTS).write.mode("append").json(path)
