"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, clusters, codes, licenses, lines, mixing, near, packing, quality, sentences, substrings, token_counts, topk
from tessella.llm.tables import table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; TESSELLA_TOKENIZERS names another folder than the installed one."""
    if folder := os.environ.get("TESSELLA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.remove_repeated_sentences(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400, with_shared=True)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64)
    digest = F.get(F.array(*[F.lit(d) for d in clusters.digests(centroids)]).cast("array<string>"), F.col("cluster"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.w) = len(c.w)
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""


WHOLE_SQL = """
kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v,
         row_number() over (order by vec_id nulls last, embedding) as r
  from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""


def _rounds(rounds: int, first: str, points: str, by: str) -> str:
    """CTEs of Lloyd's rounds: c0 (``by``, e, y) from ``first``; a0, a1, ... hold each point's nearest e and distance; c1, c2, ... the moved ones.

    ``points`` is a table of (r, ``by``, x), x and y lists of whole numbers.
    """
    parts = [f"c0 as materialized ({first})"]
    for n in range(rounds + 1):
        parts.append(f"""d{n} as materialized (
  select p.r, p.{by}, c.e, list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from {points} p join c{n} c on p.{by} = c.{by}
),
a{n} as materialized (
  select r, {by}, e, d from (select *, row_number() over (partition by r, {by} order by d, e) as o from d{n}) where o = 1
)""")
        if n < rounds:
            parts.append(f"""s{n} as materialized (
  select {by}, e, i, sum(x[i])::bigint as s, count(*) as n
  from (select a.{by}, a.e, p.x, unnest(range(1, len(p.x) + 1)) as i from a{n} a join {points} p on a.r = p.r and a.{by} = p.{by})
  group by {by}, e, i
),
m{n} as materialized (select {by}, e, list((s - ((s % n) + n) % n) // n order by i) as y from s{n} group by {by}, e),
c{n + 1} as materialized (select c.{by}, c.e, coalesce(m.y, c.y) as y from c{n} c left join m{n} m on c.{by} = m.{by} and c.e = m.e)""")
    return ",\n".join(parts)


OP11_SQL = f"""
with {WHOLE_SQL},
parts as materialized (select r, p, v[4 * p + 1 : 4 * p + 4] as x from (select *, unnest(range(0, 16)) as p from kept)),
{_rounds(2, "select p, r - 1 as e, x as y from parts where r <= 64", "parts", "p")},
books as (select sha256(array_to_string(flatten(list(y order by p, e)), ',')) as codebooks_sha256 from c2),
coded as (select r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a2 group by r)
select k.vec_id, c.code, c.error, sum(c.error) over (partition by k.label)::bigint as label_error, b.codebooks_sha256
from kept k join coded c on k.r = c.r cross join books b
"""

OP13_SQL = f"""
with {WHOLE_SQL},
points as materialized (select r, 0 as g, v as x from kept),
{_rounds(5, "select 0 as g, row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1 as e, v as y from kept qualify e < 40", "points", "g")}
select k.vec_id, a.e::int as cluster, a.d as distance, (sum(a.d) over (partition by a.e))::bigint as cluster_inertia,
       (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.y, ',')) as centroid_sha256
from kept k join a5 a on k.r = a.r join c5 c on a.e = c.e
"""

OP12_SQL = r"""
with sizes as materialized (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
),
sources as materialized (
  select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
         [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sizes group by source
),
run as (
  select *, sum(cap) over up_to - cap as caps, sum(weight) over up_to - weight as weights,
         sum(source_size) over () as words, sum(weight) over () as all_weights
  from sources window up_to as (order by cap::double / weight, source nulls last rows between unbounded preceding and current row)
),
judged as materialized (select *, cap * (all_weights - weights) < (words - caps) * weight as capped from run),
aims as (
  select source, source_size,
         case when capped then cap::double
              else ((words - coalesce(sum(cap) filter (capped) over (), 0)) * weight)::double / (sum(weight) filter (not capped) over ())::double end as target
  from judged
),
plans as (
  select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from aims
),
keyed as (
  select s.*, p.source_size, p.target, p.epochs, floor(p.target)::bigint - p.epochs * p.source_size as rest,
         md5('mix:' || p.epochs || ':' || coalesce(s.doc_id::varchar, '')) as key
  from sizes s join plans p on s.source is not distinct from p.source
),
summed as (
  select *, sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row) - size as before from keyed
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from summed
"""


def queries() -> dict:
    found = [
        op1_exact_topk, op2_best_fit_packing, op3_token_counts, op4_quality_rules, op5_bpe_round_trip,
        op6_license_scan, op7_substring_dedup, op8_line_dedup, op9_suffix_array_dedup, op10_minhash_near_dedup,
        op11_vector_codes, op12_source_mix, op13_centroid_clusters,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op11_vector_codes": OP11_SQL, "op12_source_mix": OP12_SQL, "op13_centroid_clusters": OP13_SQL}
