"""Registered queries of the operators: whole tables, production parameters, digests derived from real outputs."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlog.llm import (chat_tree, compression_rules, conversation_repair, embedding_dedup, fingerprint, gumbel_pieces, hmm_lm, line_dedup, merkle_manifest,
                        minhash_dedup, packing, quality_cnn, url_filter)
from earlog.llm.common import arrow_map, read

#: Fixed values of the query on urls: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def fold(n: int, k: int):
    """Rows whose crc32 of the id as text leaves k when divided by n."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == k, F.lit(False))


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    tree = chat_tree.chat_tree(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra))

    def sums(batches):
        for c in batches:
            roles, texts = c["roles"].to_pylist(), c["texts"].to_pylist()
            lost, whole = c["loss_text"].to_pylist(), c["formatted"].to_pylist()
            yield {"conv_id": c["conv_id"], "n_turns": [len(r) for r in roles],
                   "turns_sha256": [_sha("".join(f"{r}\n{t}\n" for r, t in zip(rs, ts))) for rs, ts in zip(roles, texts)],
                   "loss_chars": [len(x) for x in lost], "loss_sha256": [_sha(x) for x in lost], "formatted_chars": [len(x) for x in whole]}
    return arrow_map(chat_tree.read_back(tree), sums, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                     "loss_sha256 string, formatted_chars bigint")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_components(read(spark, sf_dir, "documents", "doc_id", "text"), words=3, threshold=0.85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"), with_ids=False)
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.url_filter(read(spark, sf_dir, "pages", "page_id", "url"), RULES)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
                      F.col("_verdict").alias("verdict"))


def op6_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two different sampled segmentations of every text, with the text that the pieces spell as a digest."""
    out = gumbel_pieces.sample_segmentations(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"), with_text=True)

    own = ("doc_id", "rank", "perturbed", "log_prob", "inclusion", "n_pieces", "decoded_chars", "decoded_sha256")
    out = (out.withColumn("n_pieces", F.size("ids").cast("long")).withColumn("decoded_chars", F.length("decoded").cast("long"))
           .withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).select(*own, "ids"))

    def sums(batches):
        for c in batches:
            edge, flat = c["ids"].offsets.to_numpy(), c["ids"].flatten().to_numpy()
            edge = edge - edge[0]
            yield {n: c[n] for n in own} | {"ids_crc32": [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(edge, edge[1:])]}
    return arrow_map(out, sums, "doc_id bigint, rank int, perturbed double, log_prob double, inclusion double, n_pieces bigint, "
                     "decoded_chars bigint, decoded_sha256 string, ids_crc32 bigint").select(*own[:5], "n_pieces", "ids_crc32", *own[6:])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")
    net = quality_cnn.train(docs, labels.where(~fold(3, 1)))
    return (quality_cnn.score(docs, net).select("doc_id", fold(3, 1).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.95)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text once later copies of repeated line runs are gone."""
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "deleted_lines", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scores = hmm_lm.language_model_scores(docs.withColumn("train", ~fold(5, 1)))
    return scores.select("doc_id", fold(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compression_rules.quality_rules(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "zstd_ratio", "n_chunks", "n_bad_chunks", "bad_bytes")


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, checked against rows whose text was lower-cased where 5 divides crc32 of the id."""
    docs = read(spark, sf_dir, "documents", *LEAF)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = merkle_manifest.leaf_hash(*[F.col(c) for c in LEAF])
    changed = merkle_manifest.leaf_hash(*[F.col(c) for c in LEAF[:-1]], lowered)
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(fold(5, 0), changed).alias("changed"))
    out = merkle_manifest.merkle_manifest(leaves, "source", "doc_id", "leaf")
    folded = merkle_manifest.fold(F.coalesce("changed", "leaf"), F.col("proof"))
    return (out.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root")))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of `conv_id:turn` modulo 20; nulls count as one blank."""
    blank = F.lit(" ")
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    kind = F.crc32(named.cast("binary")) % 20
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    cut = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return (out.withColumn("text", cut).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    fixed = conversation_repair.repair(damaged(rows), rows)
    texts = conversation_repair.text_digests(fixed.turns).withColumnRenamed("sha256", "repaired_sha256")
    out = fixed.summary.join(texts, "conv", "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Queries with their SQL, where SQL can express them."""
    own = {f.__name__: (f, None) for f in (op1_chat_tree, op2_fingerprint, op3_minhash, op4_packing, op5_url_filter, op6_segmentations,
                                           op7_quality, op8_embeddings, op9_lines, op10_hmm, op11_compression, op12_merkle, op13_repair, pipeline)}
    own["op5_url_filter"] = (op5_url_filter, url_filter.url_filter_sql(RULES))
    own["op12_merkle"] = (op12_merkle, merkle_manifest.merkle_sql("documents", "source", "doc_id", list(LEAF), "text"))
    return own
