"""Registered queries: one ``opN_<name>`` per operator, and their SQL where
SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, merkle, near_dedup, oracles, packing, quality, secrets, sharding, simhash, toxicity, urlfilter, warc, whitening
from .common import table


#: Place of the public vocabulary files; a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=2, capacity=4096)
    return rows.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    rows = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), public_tokenizers.PATTERN, with_ids=False)
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.judge(docs, quality_model(spark, sf_dir)).select("doc_id", "quality.*")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                       (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


RULES = [urlfilter.Rule("net/", "block"), urlfilter.Rule("example.net/en/", "allow"),
         urlfilter.Rule("example.com/de/", "block"), urlfilter.Rule("org/fr/", "allow")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urlfilter.judge(table(spark, sf_dir, "pages"), RULES)
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "blocked_alias")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.document_fingerprints(table(spark, sf_dir, "documents"), asked=F.col("id") % 20 == 0)
    c = F.col
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
                       F.concat(simhash.hex16(c("f0")), simhash.hex16(c("f1"))).alias("fingerprint"),
                       F.concat(simhash.hex16(c("e0")), simhash.hex16(c("e1"))).alias("edited_fingerprint"),
                       simhash.likeness([c("f0"), c("f1")], [c("e0"), c("e1")]).alias("near_edited"),
                       simhash.likeness([c("f0"), c("f1")], [c("x0"), c("x1")]).alias("near_next"),
                       "near_rows", "near_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    rows = warc.round_trip(pages).where("gap is null")
    return rows.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                       "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
                       F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"),
                       "whitened", "explained", "identity_error")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    record = lambda n: merkle.record_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", record(F.col("n_chars")).alias("leaf"),
                         F.when(hit, record(F.try_add(F.col("n_chars"), F.lit(1)))).alias("tampered"))
    rows = merkle.manifest(leaves, "lang", "doc_id", "leaf")
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof_left"), F.col("proof_right")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof_left"), F.col("proof_right")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_bpe, op3_quality, op4_urls, op5_fingerprints, op6_near_dedup,
                                op7_toxicity, op8_secrets, op9_warc, op10_sharding, op11_whitening, op12_exact_dedup, op13_merkle)}
#: The other operators are learned, drawn at random or tokenizers; tests hold them against brute force.
ORACLE: dict[str, str] = {"op12_exact_dedup": oracles.EXACT_DEDUP, "op13_merkle": oracles.MERKLE}
