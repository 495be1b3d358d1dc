"""Line dedup by a log-template tree, in DataFrame functions alone.

A line walks a tree of fixed depth: its token count, then its first tokens; tokens with a digit are variable
fields and read `<*>`. Below a leaf templates are made token by token: a line's words stand in order of how many
distinct lines of the leaf have them at their place, and the rarest ones become `<*>` one after another, as long
as at most `variable` of a hundred words are. So a line has a few templates, from itself to its most general one,
and lines that differ in a name or two meet in one of them. A line is dropped if an earlier document has a line
with one of its templates; the first document with a template keeps it.

Lines with too few words for a variable one meet by all their words. Lines of fields alone (numbers of a table)
have no constant token, so they are never dropped.

Distinct lines are made first, so a line that stands in millions of documents is one row from there on. A
template is known by its leaf and the exclusive or of hashes of (place, token), so that each step of
generalising changes two terms, however long the line is.

All joins are by shuffle, at every size: each side grows with the input, and the size of a compressed table is no
bound of what it takes in memory. Only bitmaps of a fixed size are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import SPACES, forget, fresh_names, maybe_among, text_or_empty, written

#: Leading tokens on a path; words of a hundred that may be variable.
DEPTH, VARIABLE = 3, 15
#: A token that holds a digit; looked for at token starts alone, so the search is linear.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
MASK = "<*>"


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def plain_line(line: Column) -> Column:
    """The line's tokens with single spaces between them, tokens with digits as `<*>`; rewritten only where that may change something."""
    odd = line.rlike(r"[\x09-\x0D0-9]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(F.regexp_replace(line, FIELD, MASK), SPACES, " "))).otherwise(line)


def lines_of(docs: DataFrame, depth: int) -> DataFrame:
    """A row for each line with a word: its row, document, place, leaf, hash and plain form.

    A document without an id is named after its text, by a negative number.
    """
    text = text_or_empty()
    doc = F.coalesce(F.col("doc_id").cast("long"), -1 - F.pmod(F.xxhash64(text), F.lit(2**62)))
    lines = docs.select(row_key().alias("row_key"), doc.alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    plain = lines.select("row_key", "doc", "line_no", plain_line(F.col("line")).alias("plain"))
    spaces = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit("")))
    some = plain.where(F.trim(F.replace("plain", F.lit(MASK), F.lit(""))) != "")
    return some.select("row_key", "doc", "line_no", F.xxhash64(spaces, F.substring_index("plain", " ", depth)).alias("leaf"), F.xxhash64("plain").alias("sign"), "plain")


def template_heads(kinds: DataFrame, lines: DataFrame, depth: int, variable: int) -> DataFrame:
    """(leaf, sign, head) for distinct lines that share a template with another: the earliest document with one of its templates."""
    leaves = kinds.groupBy("leaf").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).where("n > 1 and first < last").select("leaf")
    shared = written(kinds.join(leaves.hint("merge"), "leaf"), "template-shared")
    found = maybe_among(lines, shared.select("leaf"), "leaf").join(shared.hint("merge"), ["leaf", "sign"]).where(F.xxhash64("row_key", "line_no") == F.col("place"))
    # Equal rows have equal places.
    found = found.select("leaf", "sign", "first", "plain").dropDuplicates(["leaf", "sign"])
    tokens = found.select("leaf", "sign", "first", F.posexplode(F.split("plain", " ")).alias("at", "token"))
    mark = F.xxhash64("at", "token")
    words = tokens.select("leaf", "sign", "first", "at", mark.alias("mark"), (F.col("token") != MASK).alias("word"), (F.col("at") < depth).alias("path"))
    words = written(words, "template-words")
    forget(shared)
    open_words = words.where("word and not path")
    seen = open_words.groupBy("leaf", "mark").agg(F.count("*").alias("times"))
    # What becomes `<*>`, rarest first, and how the steps so far change the template's hash.
    change = F.col("mark").bitwiseXOR(F.xxhash64("at", F.lit(MASK)))
    order = Window.partitionBy("leaf", "sign").orderBy("times", "at")
    so_far = F.bit_xor("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = open_words.join(seen.hint("merge"), ["leaf", "mark"]).select("leaf", "sign", "times", "at", change.alias("change"))
    steps = steps.select("leaf", "sign", F.row_number().over(order).alias("step"), so_far.alias("so_far"))
    most = F.floor(F.sum(F.col("word").cast("long")) * F.lit(variable) / 100)
    bases = words.groupBy("leaf", "sign").agg(F.bit_xor("mark").alias("base"), F.min("first").alias("first"), most.alias("most"))
    general = steps.join(bases.hint("merge"), ["leaf", "sign"]).where("step <= most").select("leaf", "sign", "first", F.col("base").bitwiseXOR(F.col("so_far")).alias("template"))
    made = written(general.unionByName(bases.select("leaf", "sign", "first", F.col("base").alias("template"))), "template-chains")
    forget(words)
    heads = made.groupBy("leaf", "template").agg(F.min("first").alias("head"), F.count("*").alias("n")).where("n > 1").select("leaf", "template", "head")
    out = written(made.join(heads.hint("merge"), ["leaf", "template"]).groupBy("leaf", "sign").agg(F.min("head").alias("head")), "template-heads")
    forget(made)
    return out


def repeated_lines(docs: DataFrame, depth: int = DEPTH, variable: int = VARIABLE) -> DataFrame:
    """(row_key, lines): the places of the lines to drop, in order, for rows that have some."""
    lines = written(lines_of(docs, depth), "template-lines")
    summary = (F.min("doc").alias("first"), F.max("doc").alias("last"), F.min(F.xxhash64("row_key", "line_no")).alias("place"))
    kinds = written(lines.groupBy("leaf", "sign").agg(*summary), "template-kinds")
    heads = template_heads(kinds, lines, depth, variable)
    head = F.least("first", F.coalesce("head", "first"))
    repeated = kinds.join(heads.hint("merge"), ["leaf", "sign"], "left").withColumn("head", head).where("head < last").select("leaf", "sign", "head")
    repeated = written(repeated, "template-repeated")
    forget(kinds, heads)
    places = maybe_among(lines.select("row_key", "doc", "line_no", "leaf", "sign"), repeated.select("sign"), "sign")
    dropped = places.join(repeated.hint("merge"), ["leaf", "sign"]).where("head < doc")
    # Equal rows have equal keys, so a place may come more than once.
    repeats = written(dropped.groupBy("row_key").agg(F.sort_array(F.collect_set("line_no")).alias("lines")), "template-repeats")
    forget(lines, repeated)
    return repeats


def without_lines(text: Column, gone: Column) -> Column:
    """`text` without the lines at the ascending places `gone`."""
    between = lambda lines: F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.flatten(between(lines)), "\n"))[0]


def without_repeated_lines(docs: DataFrame, depth: int = DEPTH, variable: int = VARIABLE) -> DataFrame:
    """All columns of `docs`, with the repeated lines gone from `text`, and n_lines and n_dropped.

    Null and empty texts stay as they are, with one (empty) line at most; every row stays, even if no line is
    left. Blank lines stay. Rows with one id are one document, so what they share is not repeated; equal rows lose
    equal lines. Texts are read whole; an empty table gives no rows; other columns are kept, and if some of them
    are named n_lines or n_dropped, the new ones are not added under these names but with `_` behind.
    """
    key, gone, n_lines, n_dropped = fresh_names(docs.columns, "row_key", "gone_lines", "n_lines", "n_dropped")
    repeats = repeated_lines(docs.select("doc_id", "text"), depth, variable).withColumnsRenamed({"row_key": key, "lines": gone})
    joined = docs.join(repeats.hint("merge"), row_key() == F.col(key), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col(gone)))
    dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    names = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*names, lines.cast("long").alias(n_lines), dropped.cast("long").alias(n_dropped))


def oracle(depth: int = DEPTH, variable: int = VARIABLE) -> str:
    """DuckDB SQL for doc_id, n_lines, n_dropped and text, for documents with ids of their own; templates are lists of tokens here."""
    return f"""
with cut as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
numbered as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as line_no from cut),
tokenised as (
  select doc_id, line_no, list_filter(regexp_split_to_array(regexp_replace(line, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '{MASK}', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as tokens
  from numbered),
lines as (select doc_id, line_no, tokens from tokenised where len(list_filter(tokens, lambda x: x <> '{MASK}')) > 0),
kinds as (select len(tokens) as n, list_slice(tokens, 1, {depth}) as path, tokens, min(doc_id) as first_doc from lines group by tokens),
open_words as (
  select n, path, tokens, place, tokens[place + 1] as word from (select *, unnest(range(n)) as place from kinds)
  where place >= {depth} and tokens[place + 1] <> '{MASK}'),
rare as (select tokens, place, count(*) over (partition by n, path, place, word) as times from open_words),
ranked as (select tokens, place, row_number() over (partition by tokens order by times, place) as rank from rare),
ordered as (select tokens, list(place order by rank) as places from ranked group by tokens),
steps as (
  select k.n, k.path, k.tokens, k.first_doc, list_slice(coalesce(o.places, []), 1, floor(len(list_filter(k.tokens, lambda x: x <> '{MASK}')) * {variable} / 100)::int) as places
  from kinds k left join ordered o on o.tokens = k.tokens),
chains as (select *, unnest(range(len(places) + 1)) as step from steps),
templates as (
  select tokens, n, path, first_doc, list_transform(range(n), lambda i: case when list_contains(list_slice(places, 1, step), i) then '{MASK}' else tokens[i + 1] end) as template
  from chains),
heads as (select tokens, min(first_doc) over (partition by n, path, template) as head from templates),
reach as (select tokens, min(head) as head from heads group by tokens),
dropped as (select l.doc_id, l.line_no from lines l join reach r on r.tokens = l.tokens where r.head < l.doc_id),
lists as (select doc_id, list(line_no) as gone from dropped group by doc_id)
select c.doc_id, case when c.text is null then 0 else len(c.ls) end as n_lines, coalesce(len(l.gone), 0) as n_dropped,
       case when l.gone is null then c.text
            else array_to_string(list_transform(list_filter(range(len(c.ls)), lambda i: not list_contains(l.gone, i)), lambda i: c.ls[i + 1]), chr(10)) end as text
from cut c left join lists l on l.doc_id = c.doc_id
"""
