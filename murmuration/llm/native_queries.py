"""Queries of the operators that use DataFrame functions only, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm.chat import chat_examples, read_back
from murmuration.llm.common import query, table
from murmuration.llm.dedup import duplicate_groups
from murmuration.llm.licenses import COPYRIGHT_LINE, EQUIVALENT, KNOWN_LICENSES, PUNCTUATION, known_digests, license_scan
from murmuration.llm.shards import document_shards

PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


@query("op4_kd_shards")
def op4_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return document_shards(table(spark, folder, "documents"))


OP6_SQL = r"""
with said as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized as (
  select *, length('<|turn|><|says|><|end|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
            + length(replace(replace(text, '\', '\\'), '<|', '<\|')) as n
  from said
),
placed as (
  select *, sum(n) over (partition by conv_id order by turn, role, text rows unbounded preceding) as prefix,
         lead(conv_id) over (partition by conv_id order by turn, role, text) is null as ends
  from sized
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(prefix) filter (role = 'assistant' or ends) as bigint) as formatted_chars
from placed group by conv_id
"""


@query("op6_prefix_target_chat", OP6_SQL)
def op6_prefix_target_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation and the probe -7 as training examples, read back from the examples."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(chat_examples(turns.unionByName(probe)))


@query("op8_exact_dedup", """
with rows as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
  from documents
),
groups as (select norm, max(doc_id) as keep_id, count(*) as group_size from rows group by norm)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256
from rows join groups using (norm)
""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays of every group of equal texts, for every document."""
    return duplicate_groups(table(spark, folder, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    lines = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    lines = f"regexp_replace(regexp_replace({lines}, {_quoted(PUNCTUATION)}, ' ', 'g'), '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    lines = f"regexp_replace(concat(' ', {lines}, ' '), ' ?\\n ?', ' ' || chr(10) || ' ', 'g')"
    for pattern, form in EQUIVALENT:
        lines = f"regexp_replace({lines}, {_quoted(pattern)}, {_quoted(form.replace('$', chr(92)))}, 'g')"
    return lines


def _whole_sql(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"


OP9_SQL = f"""
with texts(license_id, text) as (values {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN_LICENSES)}),
known as (select {_whole_sql(_canonical_sql("text"))} as canon, min(license_id) as license_id from texts group by 1),
docs as (select row_number() over () as r, doc_id, {_canonical_sql("coalesce(text, '')")} as lines from documents),
whole as (select r, doc_id, lines, {_whole_sql("lines")} as canon from docs),
pieces as (select r, unnest(string_split(lines, chr(10))) as line from whole where canon <> ''),
hits as (select r, license_id, count(*) as n from pieces join known on trim(line) = known.canon group by 1, 2),
found as (select r, list_sort(list(license_id)) as line_licenses, sum(n) as n_lines from hits group by 1)
select w.doc_id, sha256(w.canon) as text_digest, known.license_id,
       coalesce(found.line_licenses, []::varchar[]) as line_licenses, cast(coalesce(found.n_lines, 0) as bigint) as n_lines
from whole w left join known on w.canon = known.canon and w.canon <> '' left join found on found.r = w.r
"""


@query("op9_license_scan", OP9_SQL)
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document's whole text, and of those of its lines that are a whole known text."""
    return license_scan(table(spark, folder, "documents"), known_digests(spark))
