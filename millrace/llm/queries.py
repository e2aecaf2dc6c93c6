"""The registered queries of the operators in this folder, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, decontaminate, embedding_dedup, html_extract, line_dedup, mixing, ngram_join, pii, quality, substring_dedup, token_counts, toxicity, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the windows of the best alignment."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 4-word shingles at a similarity of 0.85 or more."""
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document once passages of earlier documents are removed."""
    cut = substring_dedup.dedup(_table(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more."""
    return embedding_dedup.link(_table(spark, sf_dir, "embeddings"), least=0.95)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document as boilerplate of its source."""
    cut = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.QualityModel:
    """Learnt from the labelled rows outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels").where(_fold(4) != 2)
    return quality.fit(docs, labels, label="quality")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training schedule of all documents whose blocks hold the target weights."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the sentences that carry it."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels, label="toxic"))
    return scored.select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences", "worst_start", "worst_end", "offending",
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in every document, against the counts of the whole corpus."""
    return alignment.align(_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and how much of it fits into 4,096."""
    found = token_counts.count(_table(spark, sf_dir, "documents"), limit=4096)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "cut_chars")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus with the more frequent spellings that they go back to."""
    return variants.group(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_ngram_join": op2_ngram_join,
    "op3_pii": op3_pii,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html": op5_html,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_token_counts": op12_token_counts,
    "op13_variants": op13_variants,
}

SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.sql(),
    "op2_ngram_join": ngram_join.sql(),
    "op4_substring_dedup": substring_dedup.sql(),
    "op7_line_dedup": line_dedup.SQL,
    "op9_mixing": mixing.sql(),
}
