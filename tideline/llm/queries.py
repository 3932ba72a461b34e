"""Queries of this subpackage, each over its whole table: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import (
    centroids, chat, decontamination, hmm, line_dedup, minhash, negatives, packing, quality_rules, secret_scan, topk, toxicity, weak_labels,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_hidden_markov_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return hmm.score_documents(documents(spark, sf_dir), held_out)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is an owner, its languages are its repositories."""
    repo = F.concat_ws("/", "source", "lang")
    return secret_scan.find_secrets(documents(spark, sf_dir), repo, F.col("source"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured_screen(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(documents(spark, sf_dir), labels)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.verdicts(documents(spark, sf_dir), benchmark)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Prefixes compared as text, turn by turn, where the query compares hashes.
OP10_SQL = """
with turns as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as n
  from (select distinct conv_id, turn, role, text from conversations where conv_id is not null)
), prefixes as (
  select conv_id, n, count(*) over (partition by conv_id) as total,
    string_agg(length(coalesce(role, '')) || coalesce('+' || role, '-') || length(coalesce(text, '')) || coalesce('+' || text, '-'), '')
      over (partition by conv_id order by n) as prefix
  from turns
), whole as (
  select prefix, total, min(conv_id) as conv_id from prefixes where n = total group by prefix, total
), staying as (
  select conv_id, total from whole w
  where not exists (select 1 from prefixes p where p.n < p.total and p.n = w.total and p.prefix = w.prefix)
)
select s.conv_id, s.total as n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' order by n) as rendered
from staying s join turns t on t.conv_id = s.conv_id group by s.conv_id, s.total
"""

def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; every seventh label is moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, label)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(embeddings(spark, sf_dir))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def whole_vectors_sql(scale: int, condition: str = "true", extra: str = "") -> str:
    return f"""(select vec_id{extra}, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings
  where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and {condition})"""


OP11_SQL = f"""
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, x::double[] as x
  from {whole_vectors_sql(256, "label is not null", ", label")}),
s as materialized (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::integer as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


def op12_sql(k: int = 8, rounds: int = 10) -> str:
    """All rounds written out."""
    parts = [
        f"v as materialized {whole_vectors_sql(1024, 'len(embedding) = 64')}",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), x) - 1 as cluster, x as c from v order by cluster limit {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} as materialized (select vec_id, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': cluster}}) as near"
            f" from v, c{r} group by vec_id, x)"
        )
        if r < rounds:
            parts.append(f"s{r} as (select near.c as cluster, i, sum(x[i])::bigint as s, count(*) as n from a{r}, range(1, 65) t(i) group by near.c, i)")
            parts.append(f"m{r} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as c from s{r} group by cluster)")
            parts.append(f"c{r + 1} as materialized (select c{r}.cluster, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} on m{r}.cluster = c{r}.cluster)")
    return (
        "with " + ",\n".join(parts) + f"""
select vec_id, near.c::integer as cluster, near.d as distance, (sum(near.d) over (partition by near.c))::bigint as cluster_inertia,
  (sum(near.d) over ())::bigint as inertia, sha256(array_to_string(list_transform(c, lambda y: y::varchar), ',')) as centroid_sha256
from a{rounds} join c{rounds} on cluster = near.c
"""
    )


OP13_SQL = f"""
with v as materialized (select vec_id, x::double[] as x from {whole_vectors_sql(256)}),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from s qualify rank <= 5
"""

QUERIES = {
    "op1_minhash_near_dedup": (op1_minhash_near_dedup, None),
    "op2_hidden_markov_score": (op2_hidden_markov_score, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_packing": (op4_packing, None),
    "op5_line_dedup": (op5_line_dedup, None),
    "op6_quality_rules": (op6_quality_rules, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_benchmark_decontamination": (op9_benchmark_decontamination, None),
    "op10_chat_formatting": (op10_chat_formatting, OP10_SQL),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_centroid_clusters": (op12_centroid_clusters, op12_sql()),
    "op13_exact_topk": (op13_exact_topk, OP13_SQL),
}
