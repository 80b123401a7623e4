"""The queries of the thirteen operators, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, media, minhash, mixing, negatives, oracles, packing, pii, pq, quality, repair, sharding, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    # the words that each shard of the tree takes; `draws` lists them as repeat:shard:block:unit:order
    taken = F.aggregate(F.transform("draws", lambda x: F.when(x["shard"].isNotNull(), F.col("size")).otherwise(0)), F.lit(0).cast("long"), lambda z, n: z + n)
    draws = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", *[x[k].cast("string") for k in ("repeat", "shard", "block", "unit", "order")])), ",")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), draws.alias("draws"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = f"{chat.END}{chat.START}assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(mark).alias("text")
    )
    done = chat.format_chats(chat.row_events(rows.unionByName(extra)))
    turns = chat.read_turns(F.col("formatted"))
    said = done.withColumns({"turns": turns, "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    return said.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_features(media.store_texts(table(spark, sf_dir, "documents")))
    return found.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_toxicity, op3_mixing, op4_packing, op5_pii, op6_chat, op7_media, op8_minhash, op9_quality, op10_pq, op11_repair, op12_tokens, op13_negatives)
}


_ESC = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"

#: op1: cuts and slots follow the 64-bit text hash of Spark, which DuckDB lacks, so it is tested against a brute-force version.
ORACLES = {
    "op6_chat": rf"""
        WITH rows AS (
            SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{chat.END}{chat.START}assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '{chat.END}{chat.START}assistant ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(length('{chat.START}{chat.END}') + 2 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op11_repair": oracles.REPAIR,
    "op13_negatives": oracles.NEGATIVES,
}
