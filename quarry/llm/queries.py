"""The queries opN_<name> and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from . import chat, orderminhash, pii, quality
from .exact import exact_groups
from .mixing import mix_report, substance
from .packing import pack
from .records import token_records
from .simhash import near_groups
from .substring import repeats_removed


def bpe_50k() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), bpe_50k())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_report(docs, weight=substance(F.col("text")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.edits(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))


#: What a rejected conversation says that has no earlier answer to repeat.
DECLINED = "I would rather not say."


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against the same one whose last answer repeats its first, or declines where it has one only."""
    return chat.against_earlier_answers(table(spark, sf_dir, "conversations"), conversation=F.col("conv_id"), declined=DECLINED)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voter = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), voter).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: A sequence's limits: tokens, segments and loss-bearing tokens. The head of a document, a sixteenth of its characters as a number of
#: tokens and so about a fifth of them, stands for a prompt that bears no loss.
CAPACITY, SEGMENTS, LOSS, HEAD = 2048, 12, 1920, 16


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.char_length("text") / HEAD).alias("head"))
    return pack(docs, bpe_50k(), loss_from="head", capacity=CAPACITY, max_segments=SEGMENTS, max_loss=LOSS)


QUERIES = {f.__name__: f for f in (op1_token_records, op2_mixing, op3_simhash, op4_fingerprints, op5_exact_dedup, op6_personal_data, op7_repeats, op8_preferences, op9_quality, op10_packing)}

SQL = {
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) > 0 THEN greatest(0.05::DOUBLE,
      len(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::DOUBLE / len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::DOUBLE
      * (1.0::DOUBLE - (length(text) - length(translate(text, '!|*$', '')))::DOUBLE / length(text)::DOUBLE)) ELSE 0.05::DOUBLE END AS weight
  FROM documents),
rows AS (
  SELECT d.*, -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS es
  FROM d),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
weighed AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT *, CASE WHEN level * w > cap THEN cap ELSE least(w * (SELECT arg_min(level, (cap / w, n)) FROM levels WHERE level * w <= cap), cap) END AS target FROM levels),
runs AS (
  SELECT rows.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY rows.source ORDER BY es, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN 2 * run - size < 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
""",
    "op8_preferences": r"""
WITH t AS (
  SELECT conv_id AS pair_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS c
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
a AS (SELECT *, [i FOR i IN range(1, len(c) + 1) IF c[i].role = 'assistant'] AS answers FROM t),
p AS (
  SELECT pair_id, c, [{'role': c[i].role, 'text': CASE WHEN i = answers[-1] THEN CASE WHEN len(answers) > 1 THEN c[answers[1]].text ELSE 'I would rather not say.' END ELSE c[i].text END} FOR i IN range(1, len(c) + 1)] AS r
  FROM a),
n AS (SELECT *, coalesce(nullif(list_position([c[i] = r[i] FOR i IN range(1, len(c) + 1)], false), 0) - 1, len(c))::BIGINT AS n FROM p),
cut AS (SELECT pair_id, n, c[:n] AS shared, c[n + 1:] AS cs, r[n + 1:] AS rs FROM n),
sized AS (
  SELECT *, [13 + length(x.role) + length(x.text) FOR x IN cs] AS cl, [13 + length(x.role) + length(x.text) FOR x IN rs] AS rl FROM cut)
SELECT pair_id, n AS prompt_turns,
  coalesce(array_to_string(['<|' || x.role || E'|>\n' || x.text || '<|end|>' || E'\n' FOR x IN shared], ''), '') AS prompt,
  coalesce(array_to_string(['<|' || x.role || E'|>\n' || x.text || '<|end|>' || E'\n' FOR x IN cs], ''), '') AS chosen,
  coalesce(array_to_string(['<|' || x.role || E'|>\n' || x.text || '<|end|>' || E'\n' FOR x IN rs], ''), '') AS rejected,
  coalesce(array_to_string([(list_sum(cl[:i]) - length(cs[i].text) - 8)::BIGINT || ':' || list_sum(cl[:i])::BIGINT FOR i IN range(1, len(cs) + 1) IF cs[i].role = 'assistant'], ','), '') AS chosen_loss,
  coalesce(array_to_string([(list_sum(rl[:i]) - length(rs[i].text) - 8)::BIGINT || ':' || list_sum(rl[:i])::BIGINT FOR i IN range(1, len(rs) + 1) IF rs[i].role = 'assistant'], ','), '') AS rejected_loss
FROM sized
""",
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
""",
}
