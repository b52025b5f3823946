"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cdc import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ego import epsilon_join

    return epsilon_join(table(spark, sf_dir, "embeddings"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "worst_start", "worst_end", "worst_score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digests, format_conversations

    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_conversations(own.unionByName(more)))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data_digests

    return personal_data_digests(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fim_digests

    return fim_digests(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_warc, op2_fingerprints, op3_ego, op4_lm, op5_simhash, op6_toxicity, op7_packing, op8_mixing, op9_chat, op10_substrings)
    found += (op11_personal_data, op12_fill_in_middle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import oracles
    from .mixing import OP8_SQL

    found = {"op1_warc": oracles.OP1, "op3_ego": oracles.OP3, "op4_lm": oracles.OP4, "op7_packing": oracles.OP7, "op8_mixing": OP8_SQL, "op9_chat": oracles.OP9, "op10_substrings": oracles.OP10}
    found["op12_fill_in_middle"] = oracles.OP12
    return found
