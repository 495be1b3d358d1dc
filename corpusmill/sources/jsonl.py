"""JSON lines in and out, with a contract per training stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.chat import MESSAGES
from corpusmill.functions.text import SPACE, is_blank
from corpusmill.operators.resume import merged

FIELDS = {"cpt": ("text", "string"), "sft": ("messages", MESSAGES)}


def lines(spark: SparkSession, paths: str | list[str], numbered: bool = False) -> DataFrame:
    """(file, value[, line, source_index]) of text files.

    `numbered` counts lines, blank ones too: `line` from 1 in its file, `source_index` from 0 over all files in the
    order of their paths. Files are read in as many byte ranges as Spark cuts them into. A first pass counts the lines
    of every range; a second one adds the lines of the ranges before to each line's place in its own. Rows of a range
    are never shuffled, and the counts, a row for each range, are broadcast.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_block_start").alias("start"))
    if not numbered:
        return rows.drop("start")
    # A task's row numbers go up by one, so those of a range less the first of them are places in it.
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    ranges = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    # Only the sizes of ranges are added up in one task.
    so_far = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = ranges.select("file", "start", "first", "last", "n", F.coalesce(F.sum("n").over(in_file), zero).alias("in_file"), F.coalesce(F.sum("n").over(so_far), zero).alias("in_all"))
    known = rows.join(F.broadcast(before), ["file", "start"], "left")
    whole = (F.col("at").between(F.col("first"), F.col("last"))) & (F.col("last") - F.col("first") == F.col("n") - 1)
    place = F.when(F.coalesce(whole, F.lit(False)), F.col("at") - F.col("first")).otherwise(F.raise_error(F.lit("files changed between the two passes")).cast("long"))
    return known.select("file", "value", (F.col("in_file") + place + 1).alias("line"), (F.col("in_all") + place).alias("source_index"))


def stage_rows(raw: DataFrame, stage: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with the stage's field alone beside the columns of `raw`, violations with `error`), from JSON texts. Blank lines are neither.

    Other fields are not read, so their types may differ from row to row.
    """
    if stage not in FIELDS:
        raise ValueError(f"unknown stage {stage}")
    field, kind = FIELDS[stage]
    keep = [c for c in raw.columns if c != value]
    own = raw.where(~is_blank(F.col(value))).withColumn("object", F.try_parse_json(F.col(value)))
    whole = F.try_variant_get(F.col("object"), f"$.{field}", kind)
    right_type = F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("object"), f"$.{field}", "variant")).startswith("STRING" if stage == "cpt" else "ARRAY"), F.lit(False))
    marked = own.select(*keep, value, whole.alias(field), violation(F.col("object"), whole, right_type, stage).alias("error"))
    return marked.where("error is null").select(*keep, field), marked.where("error is not null").select(*keep, value, "error")


def violation(parsed: Column, field: Column, right_type: Column, stage: str) -> Column:
    empty = is_blank(field) if stage == "cpt" else F.coalesce(F.size(field) < 1, F.lit(True))
    missing = "text_missing" if stage == "cpt" else "messages_missing"
    return F.when(parsed.isNull(), "invalid_json").when(~right_type | empty, missing)


def read_stage(spark: SparkSession, paths: str | list[str], stage: str) -> tuple[DataFrame, DataFrame]:
    return stage_rows(lines(spark, paths, numbered=True), stage)


def require_valid(good: DataFrame, violations: DataFrame) -> DataFrame:
    """`good`, or an error that names a violation or the lack of rows."""
    first = violations.limit(1).collect()
    if first:
        row = first[0].asDict()
        raise ValueError(f"{row.get('file')}:{row.get('line')}: {row['error']}")
    if good.isEmpty():
        raise ValueError("no usable records")
    return good


def strings_of_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of plain text, also split at the separators U+000B, U+000C, U+001C to U+001E, U+0085, U+2028 and U+2029, blank ones left out."""
    parts = F.explode(F.split("value", r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"))
    return lines(spark, paths).select("file", parts.alias("value")).where(~F.col("value").rlike(f"^{SPACE}*$"))


def write(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines with nulls written out; `files` bounds the number of files."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_buckets(df: DataFrame, path: str, *columns: str) -> None:
    """One folder of JSON lines per value of `columns`."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(*columns).json(path)


def write_merged(parts: list[DataFrame], path: str, key: str = "source_index") -> int:
    """All parts in order of `key` in one file; the number of rows."""
    rows = merged(parts, key)
    write(rows, path, files=1)
    return rows.sparkSession.read.text(path).count()


def write_ordered(parts: list[DataFrame], path: str, key: str = "source_index", files: int | None = None) -> DataFrame:
    """All parts in order of the number `key`, in files that many tasks write, and their manifest: place, file, rows, least, most and first (rows in the files before).

    The files one after another are the one file of `write_merged`. The manifest is written to `path`/_order.
    """
    rows = merged(parts, key)
    spark = rows.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    write(rows.repartitionByRange(n, key).sortWithinPartitions(key), path)
    held = spark.read.schema(f"{key} long").json(path).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    sizes = held.agg(F.count("*").alias("rows"), F.min(key).alias("least"), F.max(key).alias("most"))
    # A row for each file.
    order = Window.orderBy("least")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    manifest = sizes.select((F.row_number().over(order) - 1).alias("place"), "file", "rows", "least", "most", before.alias("first"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/_order")
    return read_order(spark, path)


def read_order(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("place int, file string, rows long, least long, most long, first long").json(f"{path}/_order")


def read_places(spark: SparkSession, path: str, schema: str, first: int, last: int, key: str = "source_index") -> DataFrame:
    """Rows of an ordered table from place `first` up to, without, `last`; no file is read that holds none of them."""
    files = read_order(spark, path).where((F.col("first") < last) & (F.col("first") + F.col("rows") > first)).orderBy("place").collect()
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json([f"{path}/{f['file']}" for f in files])
    start = files[0]["first"]
    return rows.orderBy(key).offset(max(0, first - start)).limit(last - max(first, start))
