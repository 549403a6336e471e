"""Sinks and stores: keyed caches, graph stores, reports and logs, all as partitioned tables."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def put_cached(df: DataFrame, folder: str, tool: str, key: str) -> None:
    """Results by tool and the first two digits of their key."""
    df.withColumns({"tool": F.lit(tool), "shard": F.lit(key[:2]), "key": F.lit(key), "stored_at": F.current_timestamp()}).write.mode("append").partitionBy("tool", "shard").parquet(folder)


def get_cached(spark: SparkSession, folder: str, tool: str, key: str) -> DataFrame:
    """Only the key's partition is listed."""
    return spark.read.parquet(folder).filter((F.col("tool") == tool) & (F.col("shard") == key[:2]) & (F.col("key") == key)).drop("tool", "shard", "key", "stored_at")


def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and bytes of the store."""
    return spark.read.parquet(folder).select("key", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).distinct().agg(F.count_distinct("key").alias("entries"), F.sum("size").alias("bytes"))


def log_events(m: DataFrame, folder: str, batch: int = 100, tasks: int = 8) -> None:
    """K1: JSON lines in a folder for each day, at most ``batch`` events a file; files appear whole. A day is dealt over ``tasks`` tasks by its rows' hash."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in m.columns]), F.lit(tasks))
    m.withColumn("date", F.to_date(F.timestamp_millis("ts"))).repartition("date", part).write.mode("append").option("maxRecordsPerFile", batch).partitionBy("date").json(folder)


def fresh(spark: SparkSession, folder: str, days: int = 30) -> DataFrame:
    """What was stored in the last days. ``evict`` deletes what wasn't."""
    return spark.read.parquet(folder).filter(F.col("_metadata.file_modification_time") >= F.current_timestamp() - F.make_interval(days=F.lit(days)))


def evict(spark: SparkSession, folder: str, days: float = 30) -> int:
    """Deletes files that weren't changed in the last days, by the executors; returns how many. One that is gone already counts for nothing."""
    from lodestone.sources.listing import opened

    age = (F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col("_metadata.file_modification_time"))) / 86_400_000.0

    def delete(batches):
        for batch in batches:
            done = 0
            for f in batch["f"].to_pylist():
                fs, at = opened(f)
                try:
                    fs.delete_file(at)
                    done += 1
                except FileNotFoundError:
                    continue
            yield pa.RecordBatch.from_pydict({"done": [done]})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("f"), age.alias("age"))
    return found.filter(F.col("age") > days).select("f").mapInArrow(delete, "done bigint").agg(F.coalesce(F.sum("done"), F.lit(0))).first()[0]


def put_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """K8: both tables carry the format's version."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("overwrite").parquet(f"{folder}/{name}")


def get_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """None for another version of the format."""
    out = [spark.read.parquet(f"{folder}/{n}") for n in ("nodes", "edges")]
    if any(not df.filter(F.col("format_version") != FORMAT_VERSION).isEmpty() for df in out):
        return None
    return out[0].drop("format_version"), out[1].drop("format_version")


def overflow(runs: DataFrame, shown: str = "preview") -> DataFrame:
    """K9: the whole text stays beside what is shown of it."""
    return runs.select("run_id", shown, "full_text", (F.length("full_text") > F.length(shown)).alias("truncated"))


def shutdown_summary(m: DataFrame, path: str) -> None:
    """K2: totals of each tool in one JSON file."""
    from lodestone.operators.telemetry import session_summary

    session_summary(m).orderBy("tool").coalesce(1).write.mode("overwrite").json(path)


def render(df: DataFrame, kind: str = "text", most: int = 1000) -> str:
    """K4, K5: a report of at most ``most`` rows as text, JSON or CSV."""
    import csv
    import io

    rows = [r.asDict(recursive=True) for r in df.limit(most).collect()]
    if kind == "json":
        return json.dumps(rows, default=str, ensure_ascii=False)
    if kind == "csv":
        out = io.StringIO()
        w = csv.DictWriter(out, df.columns, lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
        return out.getvalue()
    cells = [df.columns, *[["" if r[c] is None else str(r[c]) for c in df.columns] for r in rows]]
    widths = [max(len(x[i]) for x in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, widths, strict=True)).rstrip() for x in cells)
