"""Registered queries of the engine's own operators and their DuckDB equivalents.

`documents` is a corpus of texts, `conversations` one of chat messages, `benchmark` what a corpus must not
hold, `embeddings` a set of tensors. Generations are pairs of consecutive assistant turns.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import chat, garble, metrics, text
from corpusmill.functions import tokens as tok
from corpusmill.functions.arrow import bounded_batches
from corpusmill.operators import chunk, gates, integrity, language, leakage, numeric, profile, reshape, resume, sampling, scoring, statistics
from corpusmill.sources import files, jsonl
from corpusmill.streaming import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Pieces of DuckDB SQL.
WS = text.SPACE


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(nfc_normalize({x}), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def compact(x: str) -> str:
    return "regexp_replace(replace(lower(nfc_normalize(" + x + ")), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', '', 'g')"


YI_TEXT = "translate(text, 'aeiou', 'ꀀꀁꀂꀃꀄ')"
RENDER = "string_agg('<|im_start|>' || role || chr(10) || text || case when role = 'assistant' then '<|endoftext|>' else '<|im_end|>' || chr(10) end, '' order by turn)"
CONV = f"conv as (select conv_id, count(*) as n, arg_min(role, turn) as first_role, arg_max(role, turn) as last_role, arg_max(text, turn) as last_text, {RENDER} as rendered from conversations group by conv_id)"


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.messages_from_turns(table(spark, sf_dir, "conversations"))


@query(f"select doc_id, {norm('text')} as normalized from documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query(f"select doc_id, {compact('text')} as compact from documents")
def text_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("compact"))


@query(f"""
with t as (select conv_id, turn, {YI_TEXT} as t from conversations),
c as (select conv_id, turn, len(regexp_extract_all(t, '[\\x{{A000}}-\\x{{A48F}}]'))::bigint as yi, len(regexp_extract_all(t, '[\\x{{A490}}-\\x{{A4CF}}]'))::bigint as radicals, length(regexp_replace(t, '{WS}', '', 'g'))::bigint as visible from t)
select conv_id, turn, yi, radicals, visible, round(case when visible > 0 then yi / visible else 0.0 end, 6) as ratio from c""")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.translate("text", "aeiou", "ꀀꀁꀂꀃꀄ")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.count_yi_syllables(t).cast("long").alias("yi"), text.count_yi_radicals(t).cast("long").alias("radicals"), text.count_visible(t).cast("long").alias("visible"), F.round(text.yi_ratio(t), 6).alias("ratio")
    )


@query(f"select doc_id, sha256({norm('text')}) as fingerprint from documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


@query("select conv_id, count(*)::bigint as n_messages, arg_min(role, turn) as first_role, arg_max(role, turn) as last_role, sum(length(text))::bigint as characters from conversations group by conv_id")
def messages_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    characters = F.aggregate(m, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["content"]))
    return conversations(spark, sf_dir).select("conv_id", F.size(m).cast("long").alias("n_messages"), F.element_at(m, 1)["role"].alias("first_role"), chat.last(m)["role"].alias("last_role"), characters.alias("characters"))


@query(f"with {CONV} select conv_id, rendered, rendered || '<|im_start|>assistant' || chr(10) as with_header from conv")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return conversations(spark, sf_dir).select("conv_id", chat.render(m).alias("rendered"), chat.render(m, True).alias("with_header"))


@query("""
select conv_id, sum(case when role = 'assistant' then length(text) + 13 else 0 end)::bigint as target_characters,
       sum(case when role = 'assistant' then length(role) + 13 else length(role) + 13 + length(text) + 11 end)::bigint as context_characters,
       (2 * count(*))::bigint as segments
from conversations group by conv_id""")
def assistant_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", F.explode(chat.target_segments(F.col("messages"))).alias("s"))
    n = F.length("s.segment").cast("long")
    return rows.groupBy("conv_id").agg(F.sum(F.when(F.col("s.is_target"), n).otherwise(0)).alias("target_characters"), F.sum(F.when(F.col("s.is_target"), 0).otherwise(n)).alias("context_characters"), F.count("*").alias("segments"))


@query(f"""
with last_turn as (select conv_id, max(turn) as t, arg_max(role, turn) as r, arg_max(text, turn) as completion from conversations group by conv_id),
u as (select c.conv_id, max(c.turn) as ut from conversations c join last_turn l on l.conv_id = c.conv_id and c.turn < l.t where c.role = 'user' group by c.conv_id),
p as (
  select c.conv_id, c.turn, c.role, case when c.turn = u.ut and not contains(c.text, '/no_think') then {rstrip('c.text')} || chr(10) || chr(10) || '/no_think' else c.text end as text
  from conversations c join last_turn l on l.conv_id = c.conv_id and l.r = 'assistant' and c.turn < l.t join u on u.conv_id = c.conv_id)
select p.conv_id, count(*)::bigint as n_prompt, {RENDER} as prompt, any_value(l.completion) as completion from p join last_turn l on l.conv_id = p.conv_id group by p.conv_id""")
def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = reshape.prompt_completion(conversations(spark, sf_dir), append_no_think=True)
    return good.select("conv_id", F.size("prompt").cast("long").alias("n_prompt"), chat.render(F.col("prompt")).alias("prompt"), F.element_at("completion", 1)["content"].alias("completion"))


@query(f"""
with {CONV}, u as (select c.conv_id from conversations c join (select conv_id, max(turn) as t from conversations group by conv_id) l on l.conv_id = c.conv_id and c.turn < l.t where c.role = 'user' group by c.conv_id)
select conv_id, case when last_role <> 'assistant' then 'last_message_not_assistant' else 'no_user_message' end as error from conv
where last_role <> 'assistant' or conv_id not in (select conv_id from u)""")
def prompt_completion_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.prompt_completion(conversations(spark, sf_dir), append_no_think=True)[1].select("conv_id", "error")


@query(f"""
with {CONV}, l2 as (select conv_id, arg_max(role, turn) filter (turn < mt) as prev_role from (select *, max(turn) over (partition by conv_id) as mt from conversations) group by conv_id),
r as (select c.conv_id, n, last_role, prev_role, {strip('last_text')} as answer,
  case c.conv_id % 4 when 0 then null when 1 then {strip('last_text')} when 2 then 'other' else '  ' end as given from conv c join l2 on l2.conv_id = c.conv_id),
k as (select *, last_role = 'assistant' as answered, {strip("coalesce(given, '')")} as g from r)
select conv_id, (case when answered then n - 1 else n end)::bigint as n_messages,
  case when answered then case when g <> '' then g else answer end else coalesce(given, '') end as reference,
  case when answered and answer = '' then 'assistant_reference_empty' when answered and g <> '' and g <> answer then 'reference_mismatch'
       when (case when answered then n - 1 else n end) = 0 or (answered and prev_role = 'assistant') then 'prompt_ends_with_assistant'
       when (case when answered then answer else g end) = '' then 'reference_empty' end as error from k""")
def eval_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    answer = text.strip(chat.last(F.col("messages"))["content"])
    case = F.col("conv_id") % 4
    rows = rows.withColumn("reference", F.when(case == 0, None).when(case == 1, answer).when(case == 2, "other").otherwise("  "))
    return reshape.evaluation_projection(rows).select("conv_id", F.size("messages").cast("long").alias("n_messages"), "reference", "error")


@query(f"with {CONV} select conv_id as id, n::bigint as train_messages, (n - 1)::bigint as eval_messages, last_text as reference, 'overfit_gate' as split from conv where n >= 2 and last_role = 'assistant' order by conv_id limit 64")
def overfit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.overfit_split(conversations(spark, sf_dir).withColumnRenamed("conv_id", "id"))
    return out.withColumns({c: F.size(c).cast("long") for c in ("train_messages", "eval_messages")})


def all_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reshape.training_strings(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    chats = reshape.training_strings(conversations(spark, sf_dir), "conv_id")
    return docs.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("record"), "part", "value").unionByName(chats.select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("record"), "part", "value"))


STRINGS = f"""strings as (
  select 'documents' as origin, doc_id as record, 0 as part, text as value from documents where {strip('text')} <> ''
  union all select 'conversations', conv_id, row_number() over (partition by conv_id order by turn), text from conversations where {strip('text')} <> '')"""


@query(f"with {STRINGS} select origin, record, part::bigint as part, sha256(value) as value_sha from strings")
def training_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_strings(spark, sf_dir).select("origin", "record", F.col("part").cast("long").alias("part"), F.sha2("value", 256).alias("value_sha"))


@query(f"""
select 'bench-test-' || printf('%06d', item_id) as id, 'bench' as benchmark, 'public/bench' as dataset_id, 'test' as split, item_id as source_row,
  'Summarise' || case when item_id % 3 = 0 then '' else chr(10) || chr(10) || {strip('text')} end as content,
  case when item_id % 5 = 0 then '' else {strip('text')} end as reference, case when item_id % 5 = 0 then 'output_empty' end as error from benchmark""")
def benchmark_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_row"), F.lit(" Summarise\n").alias("instruction"), F.when(F.col("item_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("\t"), "text")).alias("input"), F.when(F.col("item_id") % 5 == 0, " ").otherwise(F.col("text")).alias("output"))
    items = reshape.benchmark_items(source, "bench", "public/bench")
    return items.select("id", "benchmark", "dataset_id", "split", "source_row", F.element_at("messages", 1)["content"].alias("content"), "reference", "error")


def profile_sql(lengths: str, most: int, batch: int) -> str:
    return f"""
with lens as ({lengths}), c as (select len as raw, least(len, {most}) as len from lens),
p as (select sum(m * k)::bigint as padded from (select max(len) as m, count(*) as k from (select len, (row_number() over (order by len) - 1) // {batch} as b from c) group by b)),
s as (select count(*)::bigint as samples, count(*) filter (raw > {most})::bigint as truncated_samples, max(raw)::bigint as raw_max_length, sum(raw)::bigint as raw_total, sum(len)::bigint as total,
  quantile_disc(len, 0.5)::bigint as p50, quantile_disc(len, 0.9)::bigint as p90, quantile_disc(len, 0.95)::bigint as p95, quantile_disc(len, 0.99)::bigint as p99, max(len)::bigint as max from c)
select samples, {most}::bigint as max_length, truncated_samples, raw_max_length, raw_total, total, raw_total - total as discarded_by_truncation, round(total / raw_total, 6) as retained_ratio, round(total / samples, 2) as mean,
  p50, p90, p95, p99, max, {batch}::bigint as batch_size, round(total / padded, 4) as padding_efficiency, ceil(total / {most})::bigint as packed_sequences,
  round(samples / ceil(total / {most}), 2) as samples_per_sequence, round(samples / ceil(total / {most}), 2) as compression_ratio from s, p"""


@query(profile_sql(f"with {CONV} select length(rendered) as len from conv", 2048, 8))
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_profile(profile.message_lengths(conversations(spark, sf_dir)))


@query(profile_sql("select len(regexp_extract_all(text, '" + tok.WORD + "')) as len from documents", 512, 16))
def length_profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_profile(table(spark, sf_dir, "documents").select(tok.token_count(F.col("text"), "word").alias("length")), 512, 16)


@query(f"with {CONV} select sum(m * k)::bigint as padded from (select max(len) as m, count(*) as k from (select length(rendered) as len, (row_number() over (order by length(rendered)) - 1) // 8 as b from conv) group by b)")
def padding_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.padded_tokens(profile.message_lengths(conversations(spark, sf_dir)), 8)


@query(f"with {CONV}, b as (select case when conv_id % 10 = 0 then 'validation' else 'train' end as split, length(rendered) as len from conv) select split, count(*)::bigint as total, count(*) filter (len <= 512)::bigint as short, count(*) filter (len > 512)::bigint as long, max(len)::bigint as max_length from b group by split")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.message_lengths(conversations(spark, sf_dir)).withColumn("split", F.when(F.col("conv_id") % 10 == 0, "validation").otherwise("train"))
    return profile.bucket_manifest(rows)


@query(f"""
with t as (select {norm(YI_TEXT)} as t from documents), l as (select t from t where t <> ''),
y as (select count(*)::bigint as sentences, sum(len(regexp_extract_all(t, '[\\x{{A000}}-\\x{{A48F}}]')))::bigint as yi_characters, sum(len(regexp_extract_all(t, '�')))::bigint as unknown_tokens from l),
m as (select 'char' as model, sum(length(t))::bigint as tokens from l union all select 'word', sum(len(regexp_extract_all(t, '{tok.WORD}')))::bigint from l union all select 'utf8byte', sum(strlen(t))::bigint from l)
select model, sentences, yi_characters, tokens, round(tokens / yi_characters, 4) as tokens_per_yi_character, unknown_tokens from m, y""")
def tokenizer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.translate("text", "aeiou", "ꀀꀁꀂꀃꀄ").alias("t"))
    return profile.tokenizer_audit(lines, "t", ["char", "word", "utf8byte"])


CHUNKS = "chunks as (select doc_id, i::bigint as chunk_index, ceil(length(text) / 2048)::bigint as chunk_count, substr(text, i * 2048 + 1, 2048) as text from (select doc_id, text, unnest(range(ceil(length(text) / 2048)::bigint)) as i from documents))"


@query(f"with {CHUNKS} select * from chunks")
def chunk_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = chunk.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("derived_chunk.chunk_index").cast("long").alias("chunk_index"), F.col("derived_chunk.chunk_count").cast("long").alias("chunk_count"), "text")


@query(f"""
with {CHUNKS} select (select count(*) from documents where text <> '')::bigint as records, (select sum(length(text)) from documents)::bigint as input_characters, count(*)::bigint as chunks,
  count(*) filter (chunk_index = 0 and chunk_count > 1)::bigint as split_records, sum(length(text))::bigint as output_characters, sum(length(text))::bigint as tokens, max(length(text))::bigint as max_chunk_tokens, true as conserved from chunks""")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk.chunk_manifest(docs, chunk.chunked(docs)[0])


def benchmark_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.format_string("item-%d", "item_id").alias("label"), F.col("item_id").alias("record"), F.lit(0).alias("part"), F.col("text").alias("value"))


@query(f"""
with {STRINGS}, b as (select distinct sha256({norm('text')}) as h from benchmark where {strip('text')} <> ''), hits as (select count(*)::bigint as k from strings join b on b.h = sha256({norm('value')}))
select (select count(*) from b)::bigint as benchmark_strings, (select count(*) from strings)::bigint as training_strings, k as exact_overlaps, k = 0 as clean from hits""")
def leakage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leakage_summary(all_strings(spark, sf_dir), benchmark_strings(spark, sf_dir))


@query(f"""
with b as (select sha256({norm('text')}) as h, max(doc_id) as doc_id from documents where source = 'src0' group by h)
select t.doc_id, 'doc-' || b.doc_id as label from documents t join b on b.h = sha256({norm('t.text')}) where t.source <> 'src0'""")
def leakage_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "value")
    own = docs.where("source = 'src0'").select(F.format_string("doc-%d", "doc_id").alias("label"), F.col("doc_id").alias("record"), F.lit(0).alias("part"), "value")
    return leakage.overlaps(docs.where("source <> 'src0'").select("doc_id", "value"), own).select("doc_id", "label")


@query(f"""
with t as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), b as (select item_id, unnest(string_split(text, chr(10))) as line from benchmark),
bh as (select {norm('line')} as n, max(item_id) as item_id from b where {norm('line')} <> '' group by n)
select t.doc_id, count(*)::bigint as lines, max(bh.item_id) as last_item from t join bh on bh.n = {norm('t.line')} group by t.doc_id""")
def leakage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the whole-string audit: lines of documents that are lines of benchmark items."""
    train = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("label"), F.col("item_id").alias("record"), F.posexplode(F.split("text", "\n")).alias("part", "value"))
    return leakage.overlaps(train, bench).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("label").alias("last_item"))


#: Prompts of nine kinds, for rows whose number modulo 9 is their place.
PROMPTS = ["请翻译成中文：", "请翻译成彝语：", "用彝文回答。", "ꀀꀁ", "Say it in English please", "汉语怎么说？", "english translation of this", "判断：翻译成中文", "plain words"]
PROMPT_SQL = "case {0} % 9 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PROMPTS)) + " end"
ASCII = "translate({0}, 'äçèéêíñóöüàâîôûúáùëïœ', '!#$%&()*+-/:;<=>?@[]^')"


def prompt_of(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p) for p in PROMPTS)), (number % 9 + 1).cast("int"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (text, next text) of the assistant's turns, with a prompt and generation columns that follow from numbers."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = turns.withColumn("response", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("response is not null")
    return rows.select(
        "conv_id",
        "turn",
        F.translate("text", "q", "ꀀ").alias("reference"),
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("<think>so "), "text", F.lit("</think>"), "text")).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("x</THINK>"), "response")).otherwise(F.col("response")).alias("response"),
        prompt_of(F.col("conv_id")).alias("prompt"),
        F.when(F.col("conv_id") % 5 == 0, "length").otherwise("eos").alias("stop_reason"),
        F.floor(F.length("response") / 4).cast("int").alias("generated_tokens"),
        ((F.col("conv_id") % 7) * 0.125).cast("double").alias("batch_seconds_per_sample"),
    )


GENERATIONS = f"""
g0 as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as nxt from conversations where role = 'assistant'),
g as (select conv_id, turn, translate(text, 'q', 'ꀀ') as reference, case conv_id % 4 when 0 then '<think>so ' || text || '</think>' || text when 1 then 'x</THINK>' || nxt else nxt end as response,
  {PROMPT_SQL.format('conv_id')} as prompt, case when conv_id % 5 = 0 then 'length' else 'eos' end as stop_reason, (length(nxt) // 4)::bigint as generated_tokens, (conv_id % 7) * 0.125::double as seconds from g0 where nxt is not null),
n as (select * replace ({norm('reference')} as reference, {norm('response')} as response) from g),
w as (select *, {compact('reference')} as ref, {compact('response')} as hyp, regexp_replace(reference, '[^\\x{{A000}}-\\x{{A48F}}]', '', 'g') as ref_yi, regexp_replace(response, '[^\\x{{A000}}-\\x{{A48F}}]', '', 'g') as hyp_yi,
  case when contains(lower(response), '</think>') then {strip("list_last(regexp_split_to_array(regexp_split_to_array(response, '(?i)</think>')[1], '(?i)<think>'))")} end as thought from n),
grams as (select conv_id, turn, o, gram, sum(r) as r, sum(h) as h from (
  select conv_id, turn, o, substr(ref, i, o) as gram, 1 as r, 0 as h from (select conv_id, turn, ref, o, unnest(range(1, length(ref) - o + 2)) as i from w, range(1, 7) t(o) where length(ref) >= o)
  union all select conv_id, turn, o, substr(hyp, i, o), 0, 1 from (select conv_id, turn, hyp, o, unnest(range(1, length(hyp) - o + 2)) as i from w, range(1, 7) t(o) where length(hyp) >= o)) group by all),
f as (select conv_id, turn, o, sum(least(r, h)) as matched, sum(r) as r, sum(h) as h from grams group by all having sum(r) > 0 and sum(h) > 0),
chrf as (select conv_id, turn, avg(case when matched > 0 then 5.0::double * matched / (4 * r + h) else 0 end) * 100 as chrf2 from f group by all),
yi as (select *, regexp_matches(reference, '[\\x{{A000}}-\\x{{A48F}}]') as yi_answer, {norm('prompt')} as p from w),
scores as (select w.conv_id, w.turn,
  case when regexp_matches(p, '{'|'.join(metrics.OTHER_TASKS)}') then 'unknown' when regexp_matches(p, '{'|'.join(metrics.ZH_PHRASES)}') then 'zh' when regexp_matches(p, '{'|'.join(metrics.YI_PHRASES)}') then 'yi'
       when regexp_matches(lower(p), '{'|'.join(metrics.EN_PHRASES)}') then 'en' when regexp_matches(p, '[\\x{{A000}}-\\x{{A48F}}]') and not yi_answer then 'zh' when yi_answer then 'yi' else 'unknown' end as target_language,
  w.response = w.reference as exact, w.hyp = w.ref as compact_exact, w.ref <> '' and contains(w.hyp, w.ref) as reference_contained,
  levenshtein({ASCII.format("replace(w.ref, 'ꀀ', '~')")}, {ASCII.format("replace(w.hyp, 'ꀀ', '~')")}) / greatest(length(w.ref), 1) as cer, w.response = '' as empty, length(w.response)::bigint as response_chars, contains(w.response, '�') as replacement_character,
  w.stop_reason = 'length' as length_truncated, w.thought is not null as thinking_terminated, coalesce(w.thought <> '', false) as thinking_nonempty, coalesce(length(w.thought), 0)::bigint as thinking_chars,
  w.ref_yi <> '' and w.hyp_yi = w.ref_yi as yi_exact, w.ref_yi <> '' and contains(w.hyp_yi, w.ref_yi) as yi_reference_contained, w.generated_tokens, w.seconds, coalesce(chrf.chrf2, 0.0) as chrf2
  from yi w left join chrf on chrf.conv_id = w.conv_id and chrf.turn = w.turn)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(generations(spark, sf_dir), ["conv_id", "turn"])


@query(f"with {GENERATIONS} select * replace (round(cer, 6) as cer, round(chrf2, 6) as chrf2) from scores")
def generation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumns({"cer": F.round("cer", 6), "chrf2": F.round("chrf2", 6)})


@query(f"with {GENERATIONS} select conv_id, turn, round(chrf2, 6) as chrf2 from scores")
def chrf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bounded_batches(generations(spark, sf_dir)).select("conv_id", "turn", text.compact(F.col("reference")).alias("ref"), text.compact(F.col("response")).alias("hyp"))
    return rows.select("conv_id", "turn", F.round(F.coalesce(metrics.chrf2_column(F.col("ref"), F.col("hyp")), F.lit(0.0)), 6).alias("chrf2"))


@query(f"with {GENERATIONS} select conv_id, turn, thought from w")
def thinking_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).select("conv_id", "turn", metrics.thinking_span(text.normalize(F.col("response"))).alias("thought"))


@query(f"""
select item_id, case item_id % 9 when 0 then 'zh' when 1 then 'yi' when 2 then 'yi' when 3 then case when item_id % 2 = 0 then 'yi' else 'zh' end when 4 then 'en' when 5 then 'zh' when 6 then 'en' when 7 then 'unknown' else case when item_id % 2 = 0 then 'yi' else 'unknown' end end as target_language from benchmark""")
def target_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.when(F.col("item_id") % 2 == 0, F.lit("ꀀꀁ")).otherwise(F.lit("words"))
    return table(spark, sf_dir, "benchmark").select("item_id", metrics.target_language(prompt_of(F.col("item_id")), reference).alias("target_language"))


def rint_sql(c: str, digits: int) -> str:
    return f"round_even({c} * 1e{digits}, 0) / 1e{digits}"


def mean_sql(c: str, digits: int, yi: bool = False) -> str:
    return f"round(coalesce(avg({c}::double)" + (" filter (target_language = 'yi')" if yi else "") + f", 0.0), {digits})"


SUMMARY = f"""summary as (select case when grouping(target_language) = 1 then 'overall' else target_language end as grp, count(*)::bigint as records,
  {mean_sql('exact', 6)} as exact_match, {mean_sql('compact_exact', 6)} as compact_exact_match, {mean_sql('reference_contained', 6)} as reference_contained, {mean_sql('chrf2', 4)} as mean_chrf2, {mean_sql('cer', 6)} as mean_cer,
  {mean_sql('empty', 6)} as empty_rate, {mean_sql('replacement_character', 6)} as replacement_character_rate, {mean_sql('length_truncated', 6)} as length_truncation_rate, {mean_sql('thinking_terminated', 6)} as thinking_terminated_rate,
  {mean_sql('thinking_nonempty', 6)} as thinking_nonempty_rate, {mean_sql('thinking_chars', 3)} as mean_thinking_chars, {mean_sql('response_chars', 3)} as mean_response_chars, {mean_sql('yi_exact', 6, True)} as yi_exact_match,
  {mean_sql('yi_reference_contained', 6, True)} as yi_reference_contained, {mean_sql('generated_tokens', 3)} as mean_generated_tokens, {mean_sql('seconds', 6)} as mean_seconds_per_sample
  from {{0}} group by grouping sets ((), (target_language)))"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarize(scored(spark, sf_dir))


@query(f"with {GENERATIONS}, {SUMMARY.format('scores')} select * from summary")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir)


@query(f"""
with {GENERATIONS}, {SUMMARY.format('scores')} select list_position(['overall', 'yi', 'zh', 'en', 'unknown'], grp)::bigint as place,
  printf('| %s | %d | %.4f | %.2f | %.3f | %.4f | %.4f | %.4f | %.1f | %.4f | %.4f | %.1f | %.4f |', grp, records, {', '.join(rint_sql(c, int(f[2])) for _, c, f in scoring.REPORT[1:])}) as line from summary""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report_lines(summary(spark, sf_dir))


@query(f"""
with {GENERATIONS}, {SUMMARY.format('scores')}, c as (select compact_exact_match >= 0.5 as compact_exact_ok, mean_chrf2 >= 70.0 as chrf2_ok, replacement_character_rate <= 0.01 as replacement_ok, length_truncation_rate <= 0.05 as length_stop_ok from summary where grp = 'overall')
select *, compact_exact_ok and chrf2_ok and replacement_ok and length_stop_ok as passed from c""")
def gate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.overfit_gate(summary(spark, sf_dir))


@query(f"""
with {GENERATIONS}, half as (select * from scores where conv_id % 2 = 0), {SUMMARY.format('scores')}, {SUMMARY.format('half').replace('summary as', 'other as')},
r as (select round(case when b.compact_exact_match > 0 then a.compact_exact_match / b.compact_exact_match else 1.0 end, 6) as answer_retention, round(b.thinking_terminated_rate - a.thinking_terminated_rate, 6) as thinking_drop,
  b.length_truncation_rate = 0 and a.length_truncation_rate = 0 as valid from summary b, other a where b.grp = 'overall' and a.grp = 'overall')
select *, valid and answer_retention >= 0.95 and thinking_drop <= 0.05 as passed from r""")
def retention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.retention_of_scores(scored(spark, sf_dir), F.lit(True), F.col("conv_id") % 2 == 0)


SMOKE = f"""
s as (select conv_id || '-' || turn as id, case conv_id % 4 when 0 then text when 1 then ' ' || chr(10) when 2 then text || chr(65533) else 'STRASSE ' || text end as response,
  case when conv_id % 4 = 3 and conv_id % 3 = 0 then 'straße' when conv_id % 3 = 1 then substr(text, 1, 9) else 'Paris' end as expected from conversations where role = 'assistant'),
f as (select id, {strip('response')} = '' as blank, contains(response, chr(65533)) as odd, not contains(replace(lower(response), 'ß', 'ss'), replace(lower(expected), 'ß', 'ss')) as lacks from s),
a as (select id, not (blank or odd or lacks) as passed, concat_ws(',', case when blank then 'empty' end, case when odd then 'unicode_replacement_character' end, case when lacks then 'expected_text_missing' end) as reasons from f)"""


@query(f"with {SMOKE} select * from a")
def smoke_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns as answers of a model: as they are, blank, with a replacement character, or longer."""
    turns, n = table(spark, sf_dir, "conversations").where("role = 'assistant'"), F.col("conv_id")
    response = F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, F.lit(" \n")).when(n % 4 == 2, F.concat("text", F.lit("\ufffd"))).otherwise(F.concat(F.lit("STRASSE "), "text"))
    expected = F.when((n % 4 == 3) & (n % 3 == 0), F.lit("straße")).when(n % 3 == 1, F.substring("text", 1, 9)).otherwise(F.lit("Paris"))
    return gates.smoke_results(turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), response.alias("response"), expected.alias("expected")))


@query(f"with {SMOKE} select count(*)::bigint as prompts, (count(*) filter (passed))::bigint as passes, count(*) filter (passed) >= 2 as passed from a")
def smoke_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.smoke_gate(smoke_assess(spark, sf_dir))


@query("""
with c as (select conv_id, (select string_agg(f, ',' order by k) from (values (1, case when conv_id % 2 = 1 then 'prompt_missing_assistant_generation_header' end), (2, case when conv_id % 3 > 0 then 'completion_missing_empty_thinking_prefix' end),
  (3, case when conv_id % 5 = 0 then 'thinking_mode_was_prefilled_as_non_thinking' end), (4, case when conv_id % 7 > 0 then 'no_thinking_mode_missing_empty_thinking_prefix' end)) v(k, f)) as failures from (select distinct conv_id from conversations))
select conv_id, coalesce(failures, '') as failures from c""")
def template_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = conversations(spark, sf_dir), F.col("conv_id")
    prompt = F.when(n % 2 == 0, chat.render(F.col("messages"), True)).otherwise(chat.render(F.col("messages")))
    empty = F.lit(chat.EMPTY_THINKING)
    found = chat.rendering_failures(prompt, F.when(n % 3 == 0, F.concat(empty, F.lit("x"))).otherwise("x"), F.when(n % 5 == 0, empty).otherwise("x"), F.when(n % 7 == 0, F.concat(F.lit("x"), empty)).otherwise("x"))
    return rows.select("conv_id", F.array_join(found, ",").alias("failures"))


@query("""
with d as (select doc_id, range(doc_id % 10, doc_id % 10 + doc_id % 6) as ids, [12, 13, 3] as stops from documents), p as (select doc_id, ids, list_min(list_filter(list_transform(stops, lambda s: list_position(ids, s)), lambda x: x > 0)) as k from d)
select doc_id, coalesce(k, len(ids))::bigint as generated_tokens, case when k is null then 'length' else 'eos' end as stop_reason from p""")
def stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    ids = F.when(n % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(n % 10, n % 10 + n % 6 - 1))
    stops = tok.stop_ids(F.array(F.lit(13).cast("long")), F.array(*(F.lit(i).cast("long") for i in (12, 3, -1, 7))), F.lit(7).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", tok.generated_length(ids, stops).cast("long").alias("generated_tokens"), tok.stop_reason(ids, stops).alias("stop_reason"))


@query("with c as (select row_number() over (order by conv_id, turn) - 1 as source_index, conv_id, turn from conversations) select source_index, conv_id, turn, source_index % 3 as shard from c where source_index % 4 <> 1")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return resume.pending(rows, rows.where("source_index % 4 = 1")).withColumn("shard", resume.shard(F.col("source_index"), 3)).select("source_index", "conv_id", "turn", "shard")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their 0-based place in order of conversation and turn."""
    return resume.with_places(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", ["conv_id", "turn"])


@query("select row_number() over (order by conv_id, turn) - 1 as source_index, conv_id, turn, sha256(text) as value_sha from conversations")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir).select("source_index", "conv_id", "turn", F.sha2("text", 256).alias("value_sha"))
    shards = [rows.where(resume.shard(F.col("source_index"), 3) == k) for k in range(3)]
    return resume.merged([*shards, shards[0].limit(5)])


@query("select doc_id, length(text)::bigint as characters from documents order by doc_id limit 25")
def limit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.first_rows(table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("characters")), ["doc_id"], 25)


TENSORS = """v as (select {0}unnest(embedding)::double as x from embeddings), e as (select {0}count(*)::bigint as tensors from embeddings {1}),
s as (select {0}count(*)::bigint as elements, count(*) filter (not isfinite(x))::bigint as nonfinite_elements, count(*) filter (x = 0) / count(*) as zero_fraction, avg(abs(x)) as mean_abs, sqrt(avg(x * x)) as rms, max(abs(x)) as max_abs from v {1})"""
ROUND_SQL = "round(zero_fraction, 6) as zero_fraction, round(mean_abs, 6) as mean_abs, round(rms, 6) as rms, round(max_abs, 6) as max_abs"


def rounded(health: DataFrame) -> DataFrame:
    return health.withColumns({c: F.round(c, 6) for c in ("zero_fraction", "mean_abs", "rms", "max_abs")})


@query(f"with {TENSORS.format('', '')} select tensors, elements, nonfinite_elements, {ROUND_SQL} from e, s")
def tensor_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.tensor_health(table(spark, sf_dir, "embeddings"), "embedding").transform(rounded)


@query(f"with {TENSORS.format('label, ', 'group by label')} select e.label, tensors, elements, nonfinite_elements, {ROUND_SQL} from e join s on s.label = e.label")
def tensor_health_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.tensor_health(table(spark, sf_dir, "embeddings"), "embedding", "label").transform(rounded)


@query("""
with b as (select source, doc_id // 1024 as part, sha256(string_agg(coalesce(sha256(text), ''), '' order by doc_id)) as sha, sum(strlen(text))::bigint as bytes, count(*)::bigint as records from documents group by source, doc_id // 1024),
a as (select source as name, sha256(string_agg(sha, '' order by part)) as sha, sum(bytes)::bigint as bytes, sum(records)::bigint as records from b group by source),
n as (select unnest(range(25)) as k), r as (select 'src' || k as name, k from n)
select r.name, case when k % 5 = 4 then 'undeclared' when a.sha is null then 'missing' when k % 5 = 3 then 'sha_mismatch' when k % 5 = 2 then 'records_mismatch' else 'ok' end as status, a.bytes,
  case when k % 5 = 4 or a.sha is null and k % 5 <> 4 and k >= 25 then null when k % 5 = 2 then coalesce(a.records, 0) + 1 else coalesce(a.records, 0) end::bigint as records from r left join a on a.name = r.name""")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    actual = integrity.folded_hashes(docs, "source", "doc_id", "text").withColumnRenamed("source", "name")
    required = spark.range(25).select(F.concat(F.lit("src"), F.col("id")).alias("name"), F.col("id").alias("k"))
    told = required.where("k % 5 <> 4").join(actual, "name", "left")
    sha = F.when(F.col("k") % 5 == 3, F.lit("0" * 64)).otherwise(F.upper(F.coalesce("sha256", F.lit("ab"))))
    declared = told.select("name", sha.alias("sha256"), (F.coalesce("records", F.lit(0)) + F.when(F.col("k") % 5 == 2, 1).otherwise(0)).alias("records"))
    return integrity.verify_manifest(required, declared, actual)


@query()
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inventory(spark, sf_dir, pattern="*.parquet")


@query("select min(doc_id) as doc_id, any_value(text) as text from documents group by sha256(text)")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.without_exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), F.sha2("text", 256), "doc_id")


@query("with p as (select doc_id, ('0x' || substr(sha256(text), 1, 8))::bigint % 100 as k from documents) select doc_id, case when k < 80 then 'train' when k < 90 then 'validation' else 'test' end as split from p")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", integrity.hash_split(F.col("text")).alias("split"))


@query("with r as (select doc_id, lang, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) as stratum_rank from documents) select doc_id, lang, stratum_rank from r where stratum_rank <= 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@query(f"""
select doc_id, case when doc_id % 7 = 3 then 'invalid_json' when doc_id % 7 = 4 or {strip('text')} = '' then 'text_missing' when doc_id % 7 = 5 then 'text_missing' end as error,
  case when doc_id % 7 not in (3, 4, 5) and {strip('text')} <> '' then sha256(text) end as value_sha from documents where doc_id % 7 <> 6""")
def jsonl_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines, some broken: cut short, without text, with a number for a text, blank; other fields differ in type."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    whole = F.to_json(F.struct("text", F.when(n % 2 == 0, F.lit("a")).alias("note")))
    line = F.when(n % 7 == 3, F.substring(whole, 1, 9)).when(n % 7 == 4, F.lit('{"meta": 1}')).when(n % 7 == 5, F.lit('{"text": 5}')).when(n % 7 == 6, F.lit(" \t")).otherwise(whole)
    good, bad = jsonl.stage_rows(docs.select("doc_id", line.alias("value")), "cpt")
    none = F.lit(None).cast("string")
    return good.select("doc_id", none.alias("error"), F.sha2("text", 256).alias("value_sha")).unionByName(bad.select("doc_id", "error", none.alias("value_sha")))


@query()
def repetition_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops in the whole text of every document, units of any length; SQL has no back-references, so there is none."""
    return bounded_batches(table(spark, sf_dir, "documents")).select("doc_id", integrity.has_loop(F.col("text")).alias("loops"))


@query("""
with l as (select quality, toxic from labels where quality is not null and toxic is not null), n as (select count(*)::double as k, sum((quality = toxic)::int)::double as same, sum(quality)::double as q, sum(toxic)::double as t from l),
e as (select k, same / k as o, (q * t + (k - q) * (k - t)) / (k * k) as x from n)
select k::bigint as pairs, round(o, 6) as observed, round(x, 6) as expected, round((o - x) / (1 - x), 6) as kappa from e""")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.agreement(table(spark, sf_dir, "labels"), "quality", "toxic").withColumns({c: F.round(c, 6) for c in ("observed", "expected", "kappa")})


@query("""
with r as (select lang, doc_id % 7 as rating from documents) select lang, count(*)::bigint as ratings, round(avg(rating), 6) as mean_rating, count(*) filter (rating = 1)::bigint as n1, count(*) filter (rating = 2)::bigint as n2,
  count(*) filter (rating = 3)::bigint as n3, count(*) filter (rating = 4)::bigint as n4, count(*) filter (rating = 5)::bigint as n5 from r where rating between 1 and 5 group by lang""")
def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 7).alias("rating"))
    return statistics.rating_summary(rated, "lang").withColumn("mean_rating", F.round("mean_rating", 6))


@query(f"""
with {GENERATIONS}, i as (select conv_id || '-' || turn as id, chrf2 from scores where chrf2 is not null),
u as (select b, chrf2, ('0x' || substr(md5(id || '|' || b || '|1'), 1, 10))::bigint / 1099511627776 as u from i, range(1, 201) t(b)),
m as (select b, sum(chrf2 * t) / sum(t) as mean from (select *, {' + '.join(f"(u >= {p})::int" for p in statistics.POISSON)} as t from u) group by b)
select round((select avg(chrf2) from i), 6) as mean, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high from m""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scored(spark, sf_dir).select(F.format_string("%d-%d", "conv_id", "turn").alias("id"), "chrf2")
    found = statistics.bootstrap_interval(items, "id", "chrf2")
    return found.withColumns({c: F.round(c, 6) for c in found.columns})


WORDS_SQL = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


@query(f"""
with g0 as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as nxt from conversations where role = 'assistant'),
w as (select conv_id % 4 as arm, conv_id, turn, {WORDS_SQL.format('text')} as r, {WORDS_SQL.format("case when conv_id % 4 = 0 then text || ' and more' when conv_id % 4 = 3 then '' else nxt end")} as g from g0 where nxt is not null),
x as (select arm, conv_id, turn, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i : i + n - 1], ' '))) as gram, 1 as r, 0 as g from w, range(1, 5) t(n)
  union all select arm, conv_id, turn, n, unnest(list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(g[i : i + n - 1], ' '))), 0, 1 from w, range(1, 5) t(n)),
m as (select arm, n, sum(least(r, g)) as hits, sum(g) as total from (select arm, conv_id, turn, n, gram, sum(r) as r, sum(g) as g from x group by all) group by all),
s as (select arm, count(*)::bigint as pairs, sum(len(g))::bigint as generated_words, sum(len(r))::bigint as reference_words from w group by arm),
p as (select s.*, {', '.join(f"coalesce((select case when total > 0 then hits / total end from m where m.arm = s.arm and n = {k}), 0) as precision_{k}" for k in range(1, 5))},
  case when generated_words >= reference_words then 1.0 when generated_words = 0 then 0.0 else exp(1 - reference_words / generated_words) end as brevity from s)
select arm, pairs, generated_words, reference_words, {', '.join(f"round(precision_{k}::double, 6) as precision_{k}" for k in range(1, 5))}, round(brevity::double, 6) as brevity,
  round(case when least(precision_1, precision_2, precision_3, precision_4) > 0 then brevity * exp((ln(precision_1) + ln(precision_2) + ln(precision_3) + ln(precision_4)) / 4) else 0 end, 6) as bleu from p""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of assistant turns against the next ones, by arm: one is its own reference and two words, one is empty."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = turns.withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    arm = F.col("conv_id") % 4
    generated = F.when(arm == 0, F.concat("text", F.lit(" and more"))).when(arm == 3, F.lit("")).otherwise(F.col("nxt"))
    found = language.bleu(rows.select(arm.alias("arm"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text", generated.alias("generated")), "text", "generated", "id", "arm")
    return found.withColumns({c: F.round(c, 6) for c in found.columns if found.schema[c].dataType.typeName() == "double"})


RUNS_SQL = f"""
t as (select doc_id, doc_id % 10 <> 3 as learned, list_concat([' (', ' ('], {WORDS_SQL.format('text')}, [' )']) as t from documents),
r as (select doc_id, learned, unnest(list_transform(range(1, len(t) - 1), lambda i: {{'u': t[i], 'v': t[i + 1], 'w': t[i + 2]}})) as x from t),
counted as (select doc_id, learned, x.u as u, x.v as v, x.w as w, count(*) as n from r group by all),
three as (select u, v, w, coalesce(sum(n) filter (learned), 0) as c from counted group by all), two as (select v, w, count(*) as c from three where c > 0 group by all), one as (select w, count(*) as c from two group by all),
ones as (select {', '.join(f"(select count(*) from {t} where c = 1) as once_{n}, (select count(*) from {t} where c = 2) as twice_{n}" for n, t in ((3, 'three'), (2, 'two'), (1, 'one')))}),
d as (select *, {', '.join(f"case when once_{n} > 0 then once_{n} / (once_{n} + 2 * twice_{n}) else 0.5 end as d_{n}" for n in (3, 2, 1))} from ones)"""


def learned_part(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id) % 10 != 3


@query(f"with {RUNS_SQL} select once_3, twice_3, round(d_3::double, 9) as d_3, once_2, twice_2, round(d_2::double, 9) as d_2, once_1, twice_1, round(d_1::double, 9) as d_1 from d")
def kneser_ney_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of runs counted once and twice, and the discounts that follow from them."""
    found = language.discounts(language.model_counts(language.gram_counts(table(spark, sf_dir, "documents"), "doc_id", "text", learned_part())))
    return found.withColumns({f"d_{n}": F.round(f"d_{n}", 9) for n in (1, 2, 3)})


@query(f"""
with {RUNS_SQL}, l2 as (select u, v, sum(c) as total, count(*) as kinds from three where c > 0 group by all), l1 as (select v, sum(c) as total, count(*) as kinds from two group by all), l0 as (select coalesce(sum(c), 0) as total, count(*) as kinds from one),
p1 as (select three.*, two.c as c2, case when l0.total > 0 then (greatest(coalesce(one.c, 0) - d_1, 0) + d_1 * l0.kinds * (1.0::double / (l0.kinds + 1))) / l0.total else 1.0::double / (l0.kinds + 1) end as p1, d_2, d_3 from three left join two using (v, w) left join one using (w), l0, d),
p2 as (select p1.*, case when l1.total > 0 then (greatest(coalesce(c2, 0) - d_2, 0) + d_2 * l1.kinds * p1) / l1.total else p1 end as p2 from p1 left join l1 using (v)),
p3 as (select u, v, w, case when l2.total > 0 then (greatest(c - d_3, 0) + d_3 * l2.kinds * p2) / l2.total else p2 end as p from p2 left join l2 using (u, v)),
s as (select doc_id, sum(n)::bigint as n_tokens, sum(n * log10(p)) as log10_prob from counted join p3 using (u, v, w) group by doc_id)
select doc_id, n_tokens, round(log10_prob / n_tokens, 6) as mean_log10 from s""")
def document_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean log10 probability of a token, by a model of nine tenths of the documents; 10 to its negative is the perplexity."""
    found = language.perplexity(table(spark, sf_dir, "documents"), learned_part())
    return found.select("doc_id", "n_tokens", F.round(F.col("log10_prob") / F.col("n_tokens"), 6).alias("mean_log10"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the one of `spark.checkpoint.dir`, or of this machine where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("select event_id as source_index, user_id, event_type, round(value * 2, 6) as doubled from events")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, handled in batches; then the checkpoint is lost and all of them come again, to no effect."""
    held = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_index"), "user_id", "event_type", "value")
    stream = lambda: spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("event_id").alias("source_index"), *held.columns[1:])
    out = scratch(spark, "micro-batches")
    for mark in ("first", "second"):
        done = batches.handle_available(stream(), lambda b: b.select("source_index", "user_id", "event_type", F.round(F.col("value") * 2, 6).alias("doubled")), f"{out}/rows", f"{out}/{mark}")
        done.awaitTermination()
    return batches.committed(spark, f"{out}/rows")


RE2 = {k: v.replace("'", "''") for k, v in {"whole": garble.WHOLE, **dict(garble.TAILS)}.items()}


@query(f"""
with p as (select conv_id, turn, conv_id % 6 as task, case conv_id % 6 when 1 then replace(text, 'é', 'Ã©') when 2 then replace(text, 'a', chr(65533)) when 3 then text || chr(8205) when 4 then text || 'â€™ ðŸ˜' when 5 then text || chr(127462) else text end as t from conversations),
m as (select *, length(t) - length(regexp_replace(t, '{RE2['whole']}', '', 'g')) as g, length(t) - length(replace(t, chr(65533), '')) as r, {' or '.join(f"regexp_matches(t, '{RE2[n]}')" for n, _ in garble.TAILS)} as tail from p)
select task, count(*)::bigint as texts, sum(length(t))::bigint as characters, sum(g)::bigint as garbled, sum(r)::bigint as replaced, (count(*) filter (g > 0))::bigint as garbled_texts, (count(*) filter (tail))::bigint as spoilt_tails, round((sum(g) + sum(r)) / sum(length(t)), 9) as rate from m group by task""")
def garbling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by task: as they are, doubly encoded, with replacement characters, or with a spoilt end."""
    turns, n = table(spark, sf_dir, "conversations"), F.col("conv_id") % 6
    spoilt = F.when(n == 1, F.replace("text", F.lit("é"), F.lit("Ã©"))).when(n == 2, F.replace("text", F.lit("a"), F.lit("\ufffd"))).when(n == 3, F.concat("text", F.lit("\u200d"))).when(n == 4, F.concat("text", F.lit("â€™ ðŸ˜"))).when(n == 5, F.concat("text", F.lit("\U0001f1e6"))).otherwise(F.col("text"))
    return garble.garbling(turns.select(n.alias("task"), spoilt.alias("t")), "t", "task").withColumn("rate", F.round("rate", 9))


@query()
def repetition_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each source's texts lies in loops; SQL has no back-references, so there is none."""
    return integrity.repetition_rates(table(spark, sf_dir, "documents"), "text", "source")


@query("""
with w as (select d.doc_id, d.source, case when l.quality = 1 then 4.0 when l.quality = 0 then 0.25 else 1.0 end as weight from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id)),
k as (select *, -ln((('0x' || substr(sha256('7:' || doc_id), 1, 13))::bigint + 0.5::double) / 4503599627370496) / weight as k from w),
r as (select doc_id, source, weight::double as weight, row_number() over (partition by source order by k, doc_id)::int as sample_rank from k) select * from r where sample_rank <= 20""")
def quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each source; good ones are sixteen times as likely as bad ones to be drawn next."""
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(quality, "doc_id", "left")
    weight = F.when(F.col("quality") == 1, 4.0).when(F.col("quality") == 0, 0.25).otherwise(1.0)
    return sampling.weighted_sample(docs.select("doc_id", "source", weight.alias("weight")), "doc_id", F.col("weight"), 20, "source", seed=7)


@query("""
with l as (select lang, least(length(text), 4096) as n from documents), q as (select lang, count(*)::bigint as samples, quantile_disc(n, 0.99) as q, max(n)::bigint as longest from l group by lang),
p as (select *, (ceil(greatest(q, 1) / 64) * 64)::bigint as planned_length, (ceil(greatest(longest, 1) / 64) * 64)::bigint as most from q)
select lang, samples, planned_length, longest, (15000000000 // (planned_length * 400000))::bigint as batch_size, (15000000000 // (most * 400000))::bigint as batch_size_by_longest, (select count(*) from l where l.lang = p.lang and n > planned_length)::bigint as over_plan from p""")
def batch_by_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch sizes by language for 24 GB, of which 8 are taken and one stays free, at 400,000 bytes a character."""
    lengths = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("length"))
    return sampling.batch_plan(sampling.length_sketch(lengths, 4096, "lang"), 24 * 10**9, 8 * 10**9, 400_000, 10**9, group="lang")
