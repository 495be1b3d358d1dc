"""Text that an encoding has spoilt: UTF-8 read as Latin-1 or Windows-1252 and encoded again, and texts cut within a character.

Bytes read one by one as characters keep the grammar of UTF-8: a lead tells how many continuations follow. The patterns
below walk that grammar over characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Windows-1252 shows for the bytes 80 to 9F (a fixed table); Latin-1 has the characters of these numbers.
WINDOWS_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTINUED = r"[\x{80}-\x{BF}" + WINDOWS_1252 + "]"
#: A lead and all its continuations; the least and most of the first one leave out what no UTF-8 holds.
LEADS = ((r"[\x{C2}-\x{DF}]", 1), (r"[\x{E0}-\x{EF}]", 2), (r"[\x{F0}-\x{F4}]", 3))
WHOLE = "|".join(f"{lead}{CONTINUED}{{{n}}}" for lead, n in LEADS)
#: The same with a continuation too few, at the end of a text.
CUT = "(?:" + "|".join(f"{lead}{CONTINUED}{{{k}}}" for lead, n in LEADS for k in range(1, n)) + ")$"
#: A text ends well unless it ends in a replacement character, a joiner, or a flag of one letter.
TAILS = (("replacement", r"\x{FFFD}$"), ("joiner", r"\x{200D}$"), ("half_flag", r"(?:^|[^\x{1F1E6}-\x{1F1FF}])(?:[\x{1F1E6}-\x{1F1FF}]{2})*[\x{1F1E6}-\x{1F1FF}]$"), ("encoded_cut", CUT))


def doubly_encoded(text: Column) -> Column:
    """How many characters of a text stand doubly encoded; null for null."""
    return F.regexp_count(text, F.lit(WHOLE)).cast("long")


def doubly_encoded_length(text: Column) -> Column:
    """How many characters these take."""
    return (F.length(text) - F.length(F.regexp_replace(text, WHOLE, ""))).cast("long")


def tail(text: Column) -> Column:
    """How the end of a text is spoilt: replacement, joiner, half_flag or encoded_cut; null if it is not."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(TAILS):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def garbling(rows: DataFrame, text: str, group: str) -> DataFrame:
    """Per group: texts, characters, garbled (doubly encoded) and replaced (U+FFFD) ones, garbled_texts, spoilt_tails, and the share of characters that is garbled or replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = rows.select(F.col(group).alias("own_group"), F.length(t).alias("n"), doubly_encoded_length(t).alias("g"), (F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))).alias("r"), tail(t).alias("tail"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = own.groupBy("own_group").agg(F.count("*").alias("texts"), zero("n").alias("characters"), zero("g").alias("garbled"), zero("r").alias("replaced"), F.count_if(F.col("g") > 0).alias("garbled_texts"), F.count_if(F.col("tail").isNotNull()).alias("spoilt_tails"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("garbled") + F.col("replaced"), F.col("characters")), F.lit(0.0))).withColumnRenamed("own_group", group)
