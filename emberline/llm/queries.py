"""The opN_ queries: each runs its operator over the whole of its table and derives the digest columns from the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out_rest, table

def tokenizer_path() -> str:
    """The public byte-level vocabulary; the packing operator takes any such file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(zip_with(__dc_starts, __dc_ends, (a, b) -> b - a), 0L, (x, y) -> x + y)")
    return found.select(
        "doc_id", F.col("__dc_words").alias("n_words"), hit.alias("n_hit"), F.size("__dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__dc_items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import expand, read_back

    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{tricky}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(expand(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import group_equal

    groups = group_equal(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("__xd_id").alias("doc_id"), F.col("__xd_keep").alias("keep_id"), F.col("__xd_size").alias("group_size"),
        F.col("__xd_id").eqNullSafe(F.col("__xd_keep")).alias("kept"), F.col("__xd_sha").alias("text_sha256"),
    )


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    back = read_warc(*write_warc(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import sample, score, train

    held = (held_out_rest(F.col("doc_id"), 3) == 1).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", held, "text")
    model = train(*sample(docs.filter("not held_out"), table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select("doc_id", "held_out", F.col("__tx_score").alias("score"), (F.col("__tx_score") >= 0.7).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learnable, sample, train

    docs = table(spark, sf_dir, "documents")
    model = train(sample(learnable(docs, 4, 2)))
    return identify(docs.select("doc_id", (held_out_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), model)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    outcomes = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), outcomes)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import labelled, measured, score, train

    held = (held_out_rest(F.col("doc_id"), 5) == 0).alias("held_out")
    rows = measured(table(spark, sf_dir, "documents").select("doc_id", held, "text"))
    scored = score(rows, train(labelled(rows.filter("not held_out"), table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", "held_out", F.col("__ql_score").alias("score"), (F.col("__ql_score") >= 0.3).cast("int").alias("predicted"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_pack": op4_pack,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc_bundles": op6_warc_bundles,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality": op12_quality,
    "op13_divergence": op13_divergence,
}
