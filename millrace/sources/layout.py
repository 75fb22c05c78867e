"""Table layouts that let Spark skip files: rows by day, and an index from tags to articles.

Days: the effective date is stored as a partition column, so an age window reads its days only and retention drops folders; only the
day that the limit falls into is written again.  A day with very many rows is split over tasks by Spark's rebalance hint.

Tags: one row per tag and article, in partitions by a hash of the tag and buckets by article.  The articles that carry all of some tags
come from those tags' partitions, and their rows meet inside the buckets, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.filters import effective_date
from millrace.session import materialize

DAY = "day"
TAG_SLOTS = 64


def write_by_day(rows: DataFrame, path: str, moment: Column | None = None) -> None:
    """Write ``rows`` with the UTC day of ``moment`` (default: the effective date) as partition column ``day``."""
    dated = rows.withColumn(DAY, F.to_date(effective_date() if moment is None else moment))
    dated.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(path)


def read_since(spark: SparkSession, path: str, start: Column, moment: Column | None = None) -> DataFrame:
    """Rows whose moment is ``start`` or later; days before it are not read."""
    exact = effective_date() if moment is None else moment
    return spark.read.parquet(path).filter((F.col(DAY) >= F.to_date(start)) & (exact >= start)).drop(DAY)


def _folders(spark: SparkSession, path: str, name: str) -> dict[str, object]:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        return {}
    found = [status.getPath() for status in system.listStatus(location)]
    return {p.getName().removeprefix(f"{name}="): p for p in found if p.getName().startswith(f"{name}=")}


def _delete(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def purge_days(spark: SparkSession, path: str, cutoff: datetime, moment: Column) -> int:
    """Drop rows older than ``cutoff`` (UTC); returns the number of dropped days.  Rows without a moment stay."""
    last = cutoff.date().isoformat()
    days = _folders(spark, path, DAY)
    old = [day for day in days if day < last and day[:1].isdigit()]
    for day in old:
        _delete(spark, days[day])
    if last in days:
        table = spark.read.parquet(path).filter(F.col(DAY) == F.lit(last).cast("date"))
        kept = materialize(table.filter(moment >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp")))
        if kept.isEmpty():
            _delete(spark, days[last])
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return len(old)


def purge_runs(spark: SparkSession, path: str, cutoff: datetime) -> int:
    """Drop stored runs older than ``cutoff`` (UTC) with their rows; returns the number of dropped dates.

    ``path`` is a folder of ``sinks.write_run``: whole dates go, and of the cutoff's own date the runs before it.
    """
    last = cutoff.date().isoformat()
    dates = {name: _folders(spark, f"{path}/{name}", "run_date") for name in ("recommendations", "runs")}
    if last in dates["runs"]:
        runs = spark.read.parquet(f"{path}/runs").filter(F.col("run_date") == F.lit(last).cast("date"))
        newest = runs.groupBy("run_id").agg(F.max("generated_at").alias("at"))
        for row in newest.filter(F.col("at") < F.lit(cutoff.isoformat(sep=" ")).cast("timestamp")).toLocalIterator():
            for name in ("recommendations", "runs"):  # rows first: a run row promises its rows
                folder = _folders(spark, f"{path}/{name}/run_date={last}", "run_id").get(str(row["run_id"]))
                if folder is not None:
                    _delete(spark, folder)
    old = [date for date in dates["runs"] if date < last]
    for name in ("recommendations", "runs"):
        for date in {d for d in dates[name] if d < last}:
            _delete(spark, dates[name][date])
    return len(old)


def _slot(tag: Column) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(TAG_SLOTS)).cast("int")


def write_tag_index(articles: DataFrame, name: str, path: str, columns: Sequence[str] = ("topics", "technologies"), buckets: int = 8) -> None:
    """Save the index of ``articles`` as external table ``name``: kind (the column), tag, article_id."""
    parts = [articles.select(F.lit(c).alias("kind"), F.explode(F.array_distinct(c)).alias("tag"), "article_id") for c in columns]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    spread = rows.withColumn("slot", _slot(F.col("tag"))).repartition(buckets, "article_id")
    spread.write.mode("overwrite").partitionBy("slot").bucketBy(buckets, "article_id").sortBy("article_id").option("path", path).saveAsTable(name)


def articles_with_tags(spark: SparkSession, name: str, kind: str, tags: Sequence[str]) -> DataFrame:
    """(article_id) of the articles that carry all ``tags``; no tags: every article that has any tag of the kind."""
    wanted = sorted(set(tags))
    rows = spark.table(name).filter(F.col("kind") == kind)
    if not wanted:
        return rows.select("article_id").distinct()
    slots = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "tag string").select(_slot(F.col("tag"))).distinct().collect()]
    hits = rows.filter(F.col("slot").isin(slots) & F.col("tag").isin(wanted))
    return hits.groupBy("article_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("article_id")
