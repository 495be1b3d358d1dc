"""What the operators share: the folder all executors see, tables written there, and column shapes."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.arrow import bounded_batches as bounded_batches

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Only where that is unset, as in tests on one machine, a new one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder[app] = "file://" + folder
    return _own_folder[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, without its lineage, and safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by `written` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_path", None)
        if path:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bits of one bitmap, and the most bitmaps that are broadcast: 16 MB, whatever the size of the input.
MAP_BITS, MOST_MAPS = 32_768, 4096


def maybe_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose `column`, a 64-bit hash, is one of `keys`, and some others: a filter before a join that needs no shuffle.

    Bits of the keys are broadcast, 8 for each key and 16 MB at most. With more keys than that more rows pass.
    """
    maps = max(1, min(MOST_MAPS, 1 << max(0, (8 * keys.count() - 1) // MAP_BITS).bit_length()))
    place = F.pmod(F.col(column), F.lit(maps * MAP_BITS))
    number, bits = fresh_names(rows.columns, "map_number", "map_bits")
    made = keys.select(place.alias("place")).groupBy(F.floor(F.col("place") / MAP_BITS).cast("int").alias(number)).agg(F.bitmap_construct_agg(F.col("place") % MAP_BITS).alias(bits))
    own = F.pmod(F.col(column), F.lit(MAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(own, 3) + 1, F.lit(1))), 16, 10).cast("int")
    weight = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), own % 8 + 1)
    same = (F.floor(place / MAP_BITS).cast("int") == F.col(number)) & (byte.bitwiseAND(weight) != 0)
    return rows.join(F.broadcast(made), same).select(*rows.columns)


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """`names`, each with as many `_` behind it as make it differ from all in `taken`, whatever their case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def blocks_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def hashed_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most `rows` rows of `df`, the same on every run: picked by a hash of `columns`.

    A share of about twice `rows` is kept by the hash before anything is sorted, so what tasks send on does not
    grow with their number.
    """
    n = df.count()
    mark = F.xxhash64(*columns)
    if n > 4 * rows:
        df = df.where(F.pmod(mark, F.lit(1 << 30)) < math.ceil((1 << 31) * rows / n))
    return df.orderBy(mark, *columns).limit(rows)
