"""The corpus pipeline: documents are filtered, deduplicated, decontaminated, redacted and encoded.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; all but the last return the columns of
documents. Rows that a stage rejects go; redaction changes text and n_chars; the last stage adds the ids of each text.

Defined cases: a document whose text is null or has no words is rejected by the first stage; rows of one id, or of none, are
told apart by their texts, and repeated rows leave one; extra columns are left out; an empty table, or one whose documents
are all rejected, gives no rows; without benchmark items nothing is contaminated; very long texts go through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellarframe.llm import common, decontaminate, minhash, pieces, pii, quality_rules

#: Near copies are those of 80 % and more; 29 bands of 5 miss a pair of 80 % with a chance of about 1e-5.
DEDUP_PERCENT, DEDUP_BANDS, DEDUP_BAND_ROWS = 80, 29, 5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    common.small_batches(spark)
    return quality_rules.keep_good(docs.select(*COLUMNS))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: common.Stages | None = None) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Nodes are texts, so rows of one id or none
    are told apart by their texts."""
    common.small_batches(spark)
    return minhash.drop_near_duplicates(docs.select(*COLUMNS), percent=DEDUP_PERCENT, n_bands=DEDUP_BANDS, band_rows=DEDUP_BAND_ROWS, outer=stages)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: common.Stages | None = None) -> DataFrame:
    """Documents without a passage of the benchmark."""
    common.small_batches(spark)
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"), outer=stages)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs.select(*COLUMNS))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of all documents."""
    import public_tokenizers

    common.small_batches(spark)
    return pieces.encode(docs, str(public_tokenizers.path("piece_bpe_32k.model")), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding", encode_stage),
]

#: SQL can express neither the spans of PII nor the merges of pieces; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written and read again; what the last one does not read is deleted."""
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    with common.Stages(spark) as stages:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            given = {"stages": stages} if stage in (dedup_stage, decontaminate_stage) else {}
            docs = stages.write(stage(spark, docs, sf_dir, **given), keep=k == len(STAGES) - 2)
    return STAGES[-1][1](spark, docs, sf_dir)
