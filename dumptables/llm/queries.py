"""Registered queries of this subpackage, over whole given tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import repair_conversations
from .counts import count_tokens
from .langid import identify_languages
from .ngram_join import near_duplicates
from .licenses import license_scan
from .packing import pack_documents
from .sampling import sample_digests
from .spelling import spelling_variants
from .suffix import repeated_passages
from .topk import topk_of_rows, whole_rows
from .toxicity import score_toxicity, train_toxicity
from .urlfilter import filter_urls
from .winnow import edited_likeness

#: Fixed values of the url query: (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every vector whose id is divisible by 50, against all rows."""
    rows = whole_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return topk_of_rows(rows, F.col("id") % 50 == 0, 5)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_likeness(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur more than once, in all documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, as digests, decoded again."""
    return sample_digests(table(spark, sf_dir, "documents"), 2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base license phrases and license templates met in every document."""
    return license_scan(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents one edit from a far more frequent form, with the form and its root."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_url_filter": op2_url_filter,
    "op3_winnowing": op3_winnowing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece_sampling": op8_sentencepiece_sampling,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op1_exact_topk": """
        with rows as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
          from embeddings
          where vec_id is not null and embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as (
          select q.vec_id as query_id, c.vec_id,
            list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as score
          from rows q join rows c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from (
          select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
        where rank <= 5""",
    "op2_url_filter": """
        with rest as (
          select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as u
          from pages),
        parts as (
          select page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) as path
          from rest),
        rules(rule_host, rule_path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
          ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        hits as (
          select p.*, r.*, row_number() over (partition by page_id
            order by length(rule_host) - length(replace(rule_host, '.', '')) desc, length(rule_path) desc) as n
          from parts p left join rules r on starts_with(p.path, r.rule_path)
            and (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)))
        select page_id, host, path, rule_host || rule_path as rule, coalesce(verdict, 'allow') as verdict
        from hits where n = 1""",
}
