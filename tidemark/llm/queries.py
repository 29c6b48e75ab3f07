"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import format_conversations
from tidemark.llm.common import table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.pii import find_personal_data
from tidemark.llm.quality import score_quality
from tidemark.llm.sentencepiece_codec import encode_documents
from tidemark.llm.toxicity import score_toxicity
from tidemark.llm.url_filter import filter_urls, url_host
from tidemark.llm.warc import write_archives

# The rules that the query's contract states, and the hosts whose pages are listed.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_LANGS = ["de", "en", "es", "fr"]
LISTED_PER_LANG = 1000

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def listed_urls(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The list of the query: every page of the listed sites that the table has, so it grows with it,
    and numbered pages of these sites whether the table has them or not.
    """
    sites = f"(^|[.])({'|'.join(LISTED_SITES)})[.]example[.](com|net|org)$"
    own = pages.where(url_host(F.col("url")).rlike(sites)).select("url")
    hosts = F.explode(F.array(*[F.lit(f"{s}.example.org") for s in LISTED_SITES])).alias("host")
    langs = F.explode(F.array(*map(F.lit, LISTED_LANGS))).alias("lang")
    numbered = spark.range(LISTED_PER_LANG).select("id", hosts).select("id", "host", langs)
    return own.unionByName(numbered.select(F.concat_ws("/", F.lit("http:/"), "host", "lang", F.col("id").cast("string")).alias("url")))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a raw transcript, its roles recovered and its turns rendered."""
    return format_conversations(table(spark, sf_dir, "conversations"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = SENTENCEPIECE_MODEL) -> DataFrame:
    """Ids of every whole text, with a digest that a reader can recompute, round trip and parity."""
    found = encode_documents(table(spark, sf_dir, "documents"), model_path)
    return found.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_urls(spark, pages), URL_RULES)


OP3_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path,
         regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '://[^?#]*[?]([^#]*)', 1),
                        '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
ruled AS (
  SELECT *,
    CASE WHEN host = 'www.example.com' OR ends_with(host, '.www.example.com') THEN
           CASE WHEN starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN starts_with(path, '/') THEN 'com/' END
         WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN
           CASE WHEN starts_with(path, '/en/') THEN 'example.com/en/' WHEN starts_with(path, '/') THEN 'com/' END
         WHEN host = 'com' OR ends_with(host, '.com') THEN CASE WHEN starts_with(path, '/') THEN 'com/' END
         WHEN host = 'net' OR ends_with(host, '.net') THEN
           CASE WHEN starts_with(path, '/es/') THEN 'net/es/' WHEN starts_with(path, '/fr/') THEN 'net/fr/' END
    END AS rule,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        host, '^.*@', ''), ':(80|443)?$', ''), '[.]+$', ''), '^www[.]', '')
      || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canon
  FROM parts),
listed AS (
  SELECT canon FROM ruled
  WHERE regexp_matches(host, '(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$')
  UNION
  SELECT s || '.example.org/' || l || '/' || CAST(n AS VARCHAR)
  FROM (SELECT unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS s),
       (SELECT unnest(['de', 'en', 'es', 'fr']) AS l), range(1000) AS t(n))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND canon IN (SELECT canon FROM listed) AS listed
FROM ruled
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = """
WITH doc_words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, hash(array_to_string(w[i:i + 12], ' ')) AS h FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n),
grams AS MATERIALIZED (SELECT doc_id, n, i, hash(array_to_string(w[i:i + n - 1], ' ')) AS h FROM places),
found AS MATERIALIZED (
  SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON x.h = g.h AND x.n = g.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
         AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=4)


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i:i + 3], ' ')))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.seen)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sizes s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""

def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives and their index, then looks every page's URL up in it and reads what is found."""
    pages = table(spark, sf_dir, "pages")
    return write_archives(pages).captures(pages, payloads=False).drop("url", "payload")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_personal_data": op5_personal_data,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_warc": op10_warc,
}
ORACLES: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_warc": OP10_SQL,
}
