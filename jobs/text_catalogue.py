"""A catalogue of text records that grows with its input: what came is entered once, summed up and checked.

A file stream takes the files that it has not taken before, up to all that are there, and stops; its checkpoint lies in the output
folder. Each batch leaves, below a folder of its own number:

- `entries/batch=N/part=P`: a row for each record that no earlier batch has entered, with the digest and sizes of its text;
- `totals/batch=N`: the batch's counts by language and source, which add up over batches.

From the totals, not from the entries, `summary/part=P` and the gate's `checks` are written anew after each run. A batch that
comes again, since a run stopped before the stream noted it, is compared with earlier batches alone and replaces its own folders;
so runs can be stopped anywhere and started again, and a run without new files changes nothing.

Records are equal if id, language, source, stated length and text are; nulls are values. A null text has no digest and counts as
empty. Languages that the settings don't list share the part `other`, so that parts are few whatever comes.

    python -m jobs.text_catalogue --documents /data/documents.parquet --out /data/catalogue
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stellarframe.functions import expr as X
from stellarframe.operators import quality
from stellarframe.session import session

log = logging.getLogger("jobs.text_catalogue")
SETTINGS = Path(__file__).with_suffix(".json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: What makes a record.
RECORD = ("doc_id", "lang", "source", "n_chars", "content_sha256")
ENTRY = "doc_id long, lang string, source string, n_chars long, content_sha256 string, n_bytes long, n_words long, true_chars long, part string"
COUNTS = ("entries", "contents", "null_ids", "empty_texts", "wrong_lengths", "text_bytes", "words")
TOTAL = "lang string, source string, part string, " + ", ".join(f"{c} long" for c in COUNTS)
WORD = r"[^\x20\x09-\x0D]+"


def entries_of(docs: DataFrame, languages: list[str]) -> DataFrame:
    """A row for each different record; texts are digested where they are read and do not move."""
    text, lang = F.col("text"), F.col("lang")
    return docs.select(
        "doc_id", "lang", "source", "n_chars", F.sha2(text.cast("binary"), 256).alias("content_sha256"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n_words"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("true_chars"), F.when(lang.isin(*languages), lang).otherwise("other").alias("part"),
    ).distinct()


def same(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> Column:
    """Equal in all of `columns`, nulls included."""
    met = F.lit(True)
    for c in columns:
        met = met & left[c].eqNullSafe(right[c])
    return met


def totals_of(entries: DataFrame, known: DataFrame) -> DataFrame:
    """The counts of new `entries` by language and source; a content counts where no entry of these two had it before."""
    group = ("lang", "source", "part")
    digest = (*group, "content_sha256")
    fresh, old = entries.select(*digest).distinct(), known.select(*digest).distinct()
    fresh = fresh.join(old, same(fresh, old, digest), "left_anti")
    contents = fresh.groupBy(*group).agg(F.count("content_sha256").alias("contents")).withColumnsRenamed({c: f"_{c}" for c in group})
    counts = entries.groupBy(*group).agg(
        F.count(F.lit(1)).alias("entries"), X.count_if(F.col("doc_id").isNull()).alias("null_ids"), X.count_if(F.col("n_bytes") == 0).alias("empty_texts"),
        X.count_if(~F.col("n_chars").eqNullSafe(F.col("true_chars"))).alias("wrong_lengths"), F.sum("n_bytes").alias("text_bytes"), F.sum("n_words").alias("words"),
    )
    met = F.lit(True)
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counts.join(contents, met, "left").withColumn("contents", F.coalesce("contents", F.lit(0))).select(*group, *COUNTS)


def summed(totals: DataFrame) -> DataFrame:
    """The batches' counts by language and source."""
    return totals.groupBy("lang", "source", "part").agg(*[F.sum(c).alias(c) for c in COUNTS])


def checks_of(summary: DataFrame, settings: dict) -> DataFrame:
    """The gate over the catalogue as it stands."""
    whole = summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    percent = lambda c: whole.select(F.coalesce(F.try_divide(F.lit(100.0) * F.col(c), F.col("entries").cast("double")), F.lit(0.0)))
    return quality.run_checks([
        quality.Check("catalogue_has_entries", "error", whole.select("entries"), "greater_than", 0),
        quality.Check("entries_without_id", "error", whole.select("null_ids"), "less_than_or_equal", 0),
        quality.Check("empty_text_percent", "warning", percent("empty_texts"), "less_than_or_equal", settings["max_empty_percent"]),
        quality.Check("wrong_length_percent", "warning", percent("wrong_lengths"), "less_than_or_equal", settings["max_wrong_length_percent"]),
    ])


def _tables(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The entries and totals of all batches; a batch of no rows begins them."""
    for name, schema, parts in (("entries", ENTRY, ["part"]), ("totals", TOTAL, [])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(f"{out}/{name}/batch=-1")
    return tuple(spark.read.schema(f"{s}, batch long").parquet(f"{out}/{n}") for n, s in (("entries", ENTRY), ("totals", TOTAL)))


def enter(batch: DataFrame, number: int, out: str, settings: dict) -> None:
    """Write one batch's entries and totals, in place of what an earlier try has left of them."""
    spark, seen = batch.sparkSession, Observation(f"batch-{number}")
    before = _tables(spark, out)[0].where(F.col("batch") < number)
    rows = entries_of(batch.observe(seen, F.count(F.lit(1)).alias("rows")), settings["languages"])
    rows.join(before, same(rows, before, RECORD), "left_anti").write.mode("overwrite").partitionBy("part").parquet(f"{out}/entries/batch={number}")
    written = spark.read.schema(ENTRY).parquet(f"{out}/entries/batch={number}")
    totals_of(written, before).write.mode("overwrite").parquet(f"{out}/totals/batch={number}")
    log.info("batch %d: read %d rows, entered %d records", number, seen.get["rows"], written.count())


def run(spark: SparkSession, documents: str, out: str, settings: dict | None = None) -> dict[str, int]:
    """Take all files of `documents` that are new, then write the summary and the checks; how many batches, entries and failed checks."""
    settings = json.loads(SETTINGS.read_text()) | (settings or {})
    # a file counts as new by its name alone, however old it says it is
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings["files_per_batch"]).option("maxFileAge", "36500d").parquet(documents)
    query = stream.writeStream.foreachBatch(lambda batch, number: enter(batch, number, out, settings)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    entries, totals = _tables(spark, out)
    summed(totals).write.mode("overwrite").partitionBy("part").parquet(f"{out}/summary")
    summary = read_summary(spark, out)
    checks_of(summary, settings).coalesce(1).write.mode("overwrite").parquet(f"{out}/checks")
    failed = spark.read.parquet(f"{out}/checks").where("status = 'fail'").count()
    done = {"batches": len([p for p in query.recentProgress if p["numInputRows"]]), "entries": summary.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0], "failed_checks": failed}
    log.info("read %s, wrote %s: %s", documents, out, done)
    return done


def read_entries(spark: SparkSession, out: str) -> DataFrame:
    return _tables(spark, out)[0].drop("batch")


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(TOTAL).parquet(f"{out}/summary")


def main() -> None:
    options = argparse.ArgumentParser(description="Enter new text records into a catalogue.")
    options.add_argument("--documents", required=True, help="folder of Parquet files, which grows")
    options.add_argument("--out", required=True, help="folder of the catalogue and its checkpoint")
    options.add_argument("--config", default=str(SETTINGS), help="settings (JSON)")
    given = options.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("text catalogue")
    try:
        run(spark, given.documents, given.out, json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
