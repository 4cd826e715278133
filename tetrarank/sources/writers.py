"""DataFrames to files. Every writer leaves a directory of part files, written by the tasks themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.functions import text as tx
from tetrarank.operators.items import best_k_lists, chunk_summary
from tetrarank.operators.scale import checkpoint_dir


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Format by suffix: parquet, jsonl, json, csv or tsv."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    if suffix in ("parquet", "pq"):
        writer.parquet(path)
    elif suffix in ("jsonl", "json"):
        writer.json(path)
    elif suffix in ("csv", "tsv"):
        writer.csv(path, header=True, sep="," if suffix == "csv" else "\t", quote='"', escape='"')
    else:
        raise ValueError(f"unsupported file type: {path}")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """chunks as parquet and JSON lines, and their one-row summary; the JSON is made from the written parquet."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks.parquet")
    stored = chunks.sparkSession.read.parquet(f"{folder}/chunks.parquet")
    stored.write.mode("overwrite").json(f"{folder}/chunks.jsonl")
    chunk_summary(stored).write.mode("overwrite").json(f"{folder}/summary.json")


def result_rows(rows: DataFrame, k: int = 10, by: str = "prompt_id") -> DataFrame:
    """Best k per prompt with tidied, shortened reasons."""
    return best_k_lists(rows, k, by).withColumn("reason", tx.sanitized_reason(F.col("reason")))


def write_results(rows: DataFrame, folder: str, k: int = 10, by: str = "prompt_id", fmt: str = "json") -> None:
    """The best k rows of each prompt: a JSON line per prompt with its list, or with fmt="csv" a line per row.

    Part files hold many prompts each, so millions of prompts don't make millions of files.
    """
    cut = result_rows(rows, k, by)
    if fmt == "csv":
        cut.repartition(by).sortWithinPartitions(by, "rank").write.mode("overwrite").option("header", True).csv(folder)
        return
    entry = F.struct("rank", *[c for c in cut.columns if c not in (by, "rank")])
    cut.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("results")).write.mode("overwrite").json(folder)


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """A metric table as CSV and JSON; metric tables have one row per model and slice.

    The table is computed once, by as many tasks as its plan has, and stored; only its few rows go to one file each.
    """
    checkpoint_dir(report.sparkSession)
    report = report.checkpoint()
    for fmt in ("csv", "json"):
        report.coalesce(1).write.mode("overwrite").format(fmt).option("header", fmt == "csv").save(f"{folder}/{name}.{fmt}")


def request_payloads(prompts: DataFrame, batch: str = "batch", key: str = "prompt_id", text: str = "text") -> DataFrame:
    """One JSON request per batch; batches are of bounded size by construction."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("prompt_id"), F.col(text).alias("text"))))
    return prompts.groupBy(batch).agg(
        F.to_json(F.struct(entries.alias("prompts"))).alias("payload"), F.count(F.lit(1)).alias("n_prompts"))
