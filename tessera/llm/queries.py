"""The queries of these operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, langid, licenses, lm, media, mixing, neardup, tokens, warc
from tessera.llm._store import read_table, written


def _crc(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokens.load(), columns=["doc_id"])


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, may_learn=_crc() % 3 != 1)
    found = langid.identify(docs, model, columns=["doc_id"])
    return found.select("doc_id", F.coalesce(_crc() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: by source and thousands a folder, in it by hundreds another; every 50th is a licence file."""
    docs = read_table(spark, sf_dir, "documents")
    top = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    inner = F.concat_ws("/", top, (F.floor(F.col("doc_id") / 100) % 10).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.when(F.col("doc_id") % 50 == 0, F.concat(top, F.lit("/LICENSE."), F.col("doc_id").cast("string"))).otherwise(inner)
    files = docs.select("doc_id", path.alias("path"), "text")
    scanned = written(licenses.scan(files, columns=["doc_id", "path"]))  # without texts; it's read more than once
    return licenses.inherit(scanned).select("doc_id", "path", "own_license", "own_score", "own_line", "license", "license_from", "license_dir")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.store_texts(read_table(spark, sf_dir, "documents")))
    colours = F.array_join(F.col("histogram").cast("array<string>"), ",")
    shape = F.concat(F.lit("frames="), F.col("frames"), F.lit(";duration="), F.col("duration"), F.lit(";histogram="), colours)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", shape.alias("feature"), "frames", "duration", "error")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder).agg(F.sum("records")).collect()
    return warc.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = _crc() % 7
    found = lm.score(read_table(spark, sf_dir, "documents"), rest != 2)
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "match_words", "match_item", "match_position", "item_position")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    chats = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast(chats.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_chats(written(chat.format_chats(chats.unionByName(extra)), "chats"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.takes(*mixing.mix(read_table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 14))::BIGINT AS place
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap
  FROM sizes),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k
  FROM weighed),
goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, k) FROM levels WHERE level <= cap / weight) * weight, cap)) AS target FROM levels),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goals),
placed AS (
  SELECT s.*, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place) AS until,
         sum(s.size) OVER (PARTITION BY s.source, s.place) AS own
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN rest <= 0 THEN 0 WHEN until < rest THEN 1 WHEN until - own < rest AND until - rest <= rest - (until - own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

OP6_SQL = """
WITH paid AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
long AS (SELECT payload_digest, max(page_id) AS last FROM paid WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to, NULL::VARCHAR AS error
FROM paid LEFT JOIN long USING (payload_digest)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS MATERIALIZED (
  SELECT item_id::VARCHAR AS item, j, least(10, len(w)) AS n, array_to_string(w[j + 1 : j + least(10, len(w))], ' ') AS x
  FROM b, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS t(j) WHERE len(w) > 0),
widths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS x
  FROM (SELECT doc_id, w, n FROM d, widths WHERE len(w) >= n), unnest(range(0, len(w) - n + 1)) AS t(i)),
hits AS MATERIALIZED (SELECT doc_id, i, n, item, j FROM places JOIN windows USING (n, x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id),
runs AS (
  SELECT doc_id, item, min(i) AS i, min(j) AS j, count(*) + any_value(n) - 1 AS words
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS run FROM hits) GROUP BY doc_id, item, i - j, run),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, item, i, j) AS k FROM runs)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(words, 0)::BIGINT AS match_words, item AS match_item, i::BIGINT AS match_position, j::BIGINT AS item_position
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_near_duplicates, op3_language_id, op4_license_scan, op5_media, op6_warc, op7_lm_score, op8_decontaminate, op9_chat_format, op10_mix)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op8_decontaminate": OP8_SQL, "op10_mix": OP10_SQL}
