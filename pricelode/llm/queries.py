"""The opN_ queries of this package: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .common import documents
from .decontamination import leaks
from .embeddings import near_vectors
from .hard_negatives import hard_negatives
from .language_id import fit as fit_languages
from .language_id import identify
from .lattice import lattice_scores, sentencepieces
from .line_dedup import dedupe_lines
from .minhash import near_duplicates
from .mixing import mix
from .pseudonyms import pseudonymise
from .sharding import shard_digest
from .token_counts import token_counts
from .toxicity import fit, score


def op1_lattice(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return lattice_scores(documents(spark, sf_dir), sentencepieces(path or public_tokenizer("piece_bpe_32k.model")))


def op2_pseudonyms(spark: SparkSession, sf_dir: str, key: str = "a key for tests, not for data") -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts(documents(spark, sf_dir), Path(path or public_tokenizer("word_bpe_49k.json")).read_text(encoding="utf-8"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    a_json = Path(a or public_tokenizer("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return align(documents(spark, sf_dir), a_json, Path(b or public_tokenizer("piece_bpe_32k.model")).read_bytes())


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    return identify(docs, fit_languages(docs.where("not held_out")), ["doc_id", "held_out"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_lattice, op2_pseudonyms, op3_line_dedup, op4_embeddings, op5_decontamination, op6_token_counts, op7_mixing, op8_toxicity, op9_minhash, op10_sharding, op11_alignment, op12_language_id, op13_hard_negatives)}
#: Everything reachable by links from a vertex, the vertex included.
_REACHED = """reached(a, b) as (select id, id from vertices union select r.a, l.v from reached r join links l on r.b = l.u),
components as (select a as id, min(b) as component_id from reached group by a)"""

_EMBEDDINGS = f"""with recursive vectors as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
sound as (select * from vectors where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
vertices as (select id from vectors),
links as (select a.id as u, b.id as v from sound a join sound b on a.id <> b.id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACHED},
counted as (select u as id, count(*) as n from links group by u)
select c.id as vec_id, coalesce(n, 0) as n_links, component_id, c.id = component_id as kept from components c left join counted on c.id = counted.id"""

_MINHASH = f"""with recursive words as (
  select doc_id as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from words),
vertices as (select id from sets),
shingles as (select id, len(s) as n, unnest(s) as x from sets),
pairs as (select a.id as u, b.id as v, a.n as n, b.n as m, count(*) as k from shingles a join shingles b on a.x = b.x and a.id <> b.id group by all),
links as (select u, v from pairs where 100 * k >= 80 * (n + m - k)),
{_REACHED}
select s.id as doc_id, len(s) as n_shingles, component_id, s.id = component_id as kept from sets s join components c on s.id = c.id"""

_HARD_NEGATIVES = """with numbers as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
  from numbers a join numbers b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
positives as (select anchor_id, id, score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
ranked as (
  select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank
  from positives p join scored n on p.anchor_id = n.anchor_id and not n.same and 100 * n.score between 30 * p.score and 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from ranked where rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op4_embeddings": _EMBEDDINGS, "op9_minhash": _MINHASH, "op13_hard_negatives": _HARD_NEGATIVES}
