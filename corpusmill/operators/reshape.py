"""Records of chat messages cut into prompts, completions, references and training strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.functions.text import is_blank, or_empty, strip


def messages_from_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row per conversation with its messages in order of turn."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def prompt_completion_error(messages: Column, append_no_think: bool) -> Column:
    """Why messages cannot be cut into prompt and completion; null if they can."""
    error = F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, "messages_empty").when(~F.coalesce(chat.last(messages)["role"] == "assistant", F.lit(False)), "last_message_not_assistant")
    return error.when(chat.last_user_place(chat.all_but_last(messages)).isNull(), "no_user_message") if append_no_think else error


def prompt_completion(records: DataFrame, append_no_think: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records with prompt and completion, rejected records with `error`)."""
    marked = records.withColumn("error", prompt_completion_error(F.col("messages"), append_no_think))
    prompt = chat.all_but_last(F.col("messages"))
    good = marked.where("error is null").drop("error").withColumn("prompt", chat.add_no_think(prompt) if append_no_think else prompt).withColumn("completion", F.slice("messages", -1, 1))
    return good, marked.where("error is not null")


def evaluation_projection(records: DataFrame) -> DataFrame:
    """`messages` without a final answer, `reference` and `error`, the first rule that a record breaks.

    A final assistant message is the reference; a reference that is given too must equal it.
    """
    messages = F.coalesce(F.col("messages"), F.array().cast(chat.MESSAGES))
    tail = chat.last(messages)
    answered = F.coalesce(tail["role"] == "assistant", F.lit(False))
    answer, given = strip(or_empty(tail["content"])), or_empty(F.col("reference"))
    kept = F.when(answered, chat.all_but_last(messages)).otherwise(messages)
    reference = F.when(answered, F.when(strip(given) != "", strip(given)).otherwise(answer)).otherwise(given)
    error = (
        F.when(F.size(messages) == 0, "messages_empty")
        .when(answered & (answer == ""), "assistant_reference_empty")
        .when(answered & (strip(given) != "") & (strip(given) != answer), "reference_mismatch")
        .when((F.size(kept) == 0) | F.coalesce(chat.last(kept)["role"] == "assistant", F.lit(False)), "prompt_ends_with_assistant")
        .when(strip(reference) == "", "reference_empty")
    )
    return records.withColumns({"messages": kept, "reference": reference, "error": error})


def overfit_split(records: DataFrame, limit: int = 64) -> DataFrame:
    """The first `limit` records by `id` that hold two messages or more and end with an assistant's: messages to train on, prompt and reference to evaluate on."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    fit = records.where((F.size("messages") >= 2) & (chat.last(F.col("messages"))["role"] == "assistant"))
    picked = fit.orderBy("id").limit(limit)
    return picked.select("id", F.col("messages").alias("train_messages"), chat.all_but_last(F.col("messages")).alias("eval_messages"), or_empty(chat.last(F.col("messages"))["content"]).alias("reference"), F.lit("overfit_gate").alias("split"))


def exactly(rows: DataFrame, n: int) -> DataFrame:
    """`rows`, or an error at run time if there are not exactly `n`."""
    count = rows.agg(F.count("*").alias("have")).select(F.assert_true(F.col("have") == n, F.lit(f"expected exactly {n} records")).alias("ok"))
    return rows.crossJoin(count).where("ok is null").drop("ok")


def training_strings(records: DataFrame, key: str) -> DataFrame:
    """(key, part, value) for a record's text and each message's content, blank ones left out."""
    texts = F.col("text") if "text" in records.columns else F.lit(None).cast("string")
    contents = F.transform(F.coalesce(F.col("messages"), F.array().cast(chat.MESSAGES)), lambda m: m["content"]) if "messages" in records.columns else F.array().cast("array<string>")
    return records.select(key, F.posexplode(F.concat(F.array(texts), contents)).alias("part", "value")).where(~is_blank(F.col("value")))


def benchmark_items(source: DataFrame, name: str, dataset_id: str, split: str = "test") -> DataFrame:
    """Items (id, benchmark, dataset_id, split, source_row, messages, reference, error) from source_row, instruction, input, output."""
    instruction, extra, answer = strip(or_empty(F.col("instruction"))), strip(or_empty(F.col("input"))), strip(or_empty(F.col("output")))
    content = F.when(extra == "", instruction).otherwise(F.concat_ws("\n\n", instruction, extra))
    return source.select(
        F.format_string(f"{name}-{split}-%06d", "source_row").alias("id"),
        F.lit(name).alias("benchmark"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(split).alias("split"),
        F.col("source_row").cast("long").alias("source_row"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
        answer.alias("reference"),
        F.when(answer == "", "output_empty").when(instruction == "", "instruction_empty").alias("error"),
    )


def zipped(*arrays: str) -> Column:
    """Arrays side by side, element by element; an error at run time if their sizes differ."""
    sizes = F.array_distinct(F.array(*(F.coalesce(F.size(a), F.lit(-1)) for a in arrays)))
    return F.when(F.size(sizes) == 1, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays differ in size")))
