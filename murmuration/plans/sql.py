"""SQL building blocks for the checks: iterative graph operators as common table expressions."""

from __future__ import annotations


def kcore_sql(name: str, edges: str, k: int, rounds: int = 24) -> str:
    """CTEs ending in ``name(src, dst, attr)``, the edges of the k-core, after enough rounds of peeling."""
    parts, current = [], edges
    for i in range(rounds):
        last = name if i == rounds - 1 else f"{name}_e{i}"
        parts.append(f"""
{name}_d{i} as materialized (
  select id from (select src as id from {current} union all select dst from {current}) group by id having count(*) < {k}
),
{last} as materialized (
  select src, dst, attr from {current}
  where src not in (select id from {name}_d{i}) and dst not in (select id from {name}_d{i})
)""")
        current = last
    return ",".join(parts)


def components_sql(name: str, edges: str) -> str:
    """CTEs ending in ``name(id, component)`` for the ends of ``edges``."""
    return f"""
{name}_pairs as materialized (select src as a, dst as b from {edges} union select dst, src from {edges}),
{name}_reach(id, label) as (
  select a, a from {name}_pairs
  union
  select p.b, r.label from {name}_reach r join {name}_pairs p on p.a = r.id where r.label < p.b
),
{name} as materialized (select id, min(label) as component from {name}_reach group by id)"""


def ends_sql(name: str, edges: str) -> str:
    return f"""
{name} as materialized (select distinct id from (select src as id from {edges} union all select dst from {edges}))"""


def topic_words_sql(text: str) -> str:
    """Expression: list of the topic words of a text."""
    from murmuration.functions.text import LETTERS_PATTERN, MIN_TOKEN_CHARS, STOP_WORDS

    stop = ", ".join(f"'{word}'" for word in STOP_WORDS)
    return (f"list_filter(regexp_split_to_array(lower({text}), '\\s'), lambda w: length(w) >= {MIN_TOKEN_CHARS} "
            f"and regexp_full_match(w, '{LETTERS_PATTERN}') and w not in ({stop}))")


def clean_sql(text: str) -> str:
    from murmuration.functions.text import SMILEY_PATTERN, URL_PATTERN

    return f"regexp_replace(regexp_replace({text}, '{URL_PATTERN}', '', 'g'), '{SMILEY_PATTERN}', '', 'g')"


def punctuation_sql(text: str) -> str:
    from murmuration.functions.text import PUNCTUATION_PATTERN

    return f"regexp_replace({text}, '{PUNCTUATION_PATTERN}', ' ', 'g')"
