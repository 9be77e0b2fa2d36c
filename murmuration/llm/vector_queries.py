"""Queries over vectors and over spans that documents share, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.llm.centroids import CENTROIDS, DIMENSIONS, ROUNDS, cluster_vectors
from murmuration.llm.common import query, table
from murmuration.llm.repeats import WINDOW, remove_repeats
from murmuration.llm.whitening import whiten


def _clustering_sql(k: int, rounds: int, size: int) -> str:
    """The rounds, written out one after the other."""
    steps = [f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x
  from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}
), c0 as (
  select row_number() over (order by h, x) - 1 as k, x as c
  from (select x, sha256('1:' || cast(vec_id as varchar)) as h from v where vec_id is not null)
  qualify row_number() over (order by h, x) <= {k}
)"""]
    for round_ in range(rounds + 1):
        steps.append(f"""
a{round_} as (
  select r, arg_min(k, (d, k)) as k, min(d) as d
  from (select r, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{round_})
  group by r
)""")
        if round_ < rounds:
            steps.append(f"""
m{round_} as (
  select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c
  from (select k, i, sum(x) as s, count(*) as n
        from (select k, unnest(x) as x, generate_subscripts(x, 1) as i from v join a{round_} using (r)) group by k, i)
  group by k
), c{round_ + 1} as (select k, coalesce(m.c, c.c) as c from c{round_} c left join m{round_} m using (k))""")
    return ",".join(steps) + f"""
select vec_id, cast(k as integer) as cluster, cast(d as bigint) as distance,
       cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join v using (r) join c{rounds} using (k)
"""


@query("op11_centroid_clustering", _clustering_sql(CENTROIDS, ROUNDS, DIMENSIONS))
def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after three rounds."""
    return cluster_vectors(table(spark, folder, "embeddings"))


@query("op12_substring_dedup", f"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), w as (
  select doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from d where len(words) >= {WINDOW})
), gone as (
  select distinct doc_id, unnest(range(i, i + {WINDOW})) as i
  from (select doc_id, i, min(doc_id) over (partition by h) as first from w) where first < doc_id
), removed as (
  select doc_id, count(*) as n from gone group by doc_id
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as kept
  from (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from d where doc_id in (select doc_id from removed))
  anti join gone using (doc_id, i) group by doc_id
)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
       sha256(case when n is null then array_to_string(words, ' ')
                   else coalesce(k.kept, '') end) as kept_sha256
from d left join removed using (doc_id) left join kept k using (doc_id)
""")
def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that are left once spans of earlier documents are removed."""
    return remove_repeats(table(spark, folder, "documents"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of every vector."""
    return whiten(table(spark, folder, "embeddings"))
