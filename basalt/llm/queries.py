"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import ball_tree, byte_bpe, class_lm, decontaminate, dialogue, langid, near_dup, packing, quality, repeats, secrets, token_table, urlfilter
from basalt.llm.common import crc_of_id, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(secrets.spans_text("base_findings").cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.spans_text("findings").alias("spans"), "n_markov")


#: host, path, verdict of the listed rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(len(RULES)).select(*(F.element_at(F.array(*(F.lit(r[k]) for r in RULES)), (F.col("id") + 1).cast("int")).alias(name) for k, name in enumerate(("host", "path", "verdict"))))
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


OP2_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
hits AS (SELECT s.id, x.host || x.path AS rule, x.verdict, row_number() OVER (PARTITION BY s.id ORDER BY length(x.host || x.path) DESC, length(x.host) DESC) AS k
  FROM split s JOIN rules x ON (s.host = x.host OR ends_with(s.host, '.' || x.host)) AND starts_with(s.path, x.path))
SELECT s.page_id, s.host, s.path, h.rule, coalesce(h.verdict, 'allow') AS verdict FROM split s LEFT JOIN hits h ON s.id = h.id AND h.k = 1
"""


def op3_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.token_digest(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_of_id("doc_id") % 7 == 2
    scored = class_lm.score(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id("doc_id") % 3 == 1
    model = langid.train(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, seed="2:")


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.damaged(table(spark, sf_dir, "conversations"))
    return dialogue.report(dialogue.repair(rows, F.col("present")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_url_filter": op2_url_filter,
        "op3_token_table": op3_token_table,
        "op4_decontamination": op4_decontamination,
        "op5_class_lm": op5_class_lm,
        "op6_packing": op6_packing,
        "op7_quality_rules": op7_quality_rules,
        "op8_near_dup": op8_near_dup,
        "op9_language_id": op9_language_id,
        "op10_repeats": op10_repeats,
        "op11_ball_tree": op11_ball_tree,
        "op12_dialogue": op12_dialogue,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL}
