"""The log of job runs as a table: id, job, started, finished, status (running, ok, failed, interrupted), mode (full, quick, null), pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(runs: DataFrame) -> DataFrame:
    """SNK9: a run that still counts as running while its job has a later one was interrupted; of runs started together the greater id is later.

    The last run of each job is found with a map-side part, so a job with very many runs is no task of its own.
    """
    last = runs.groupBy("job").agg(F.max(F.struct("started", "id")).alias("last"))
    over = (F.col("status") == "running") & (F.struct("started", "id") < F.col("last"))
    return runs.hint("merge").join(last, "job").withColumn("status", F.when(over, "interrupted").otherwise(F.col("status"))).drop("last")


def hours_since_full(runs: DataFrame, as_of: str) -> DataFrame:
    """(job, hours) since the last full run that went well; where no run of a job says its mode so, since the last one without a mode that read
    over 250 pages; null if there is none."""
    went = F.col("status") == "ok"
    full = F.max(F.when(went & (F.col("mode") == "full"), F.col("finished")))
    large = F.max(F.when(went & F.col("mode").isNull() & (F.col("pages") > 250), F.col("finished")))
    done = runs.groupBy("job").agg(F.coalesce(full, large).alias("done"))
    return done.select("job", ((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("done").cast("timestamp"))) / 3.6e9).alias("hours"))


def recent(runs: DataFrame, most: int = 10) -> DataFrame:
    """SRC7: the latest runs by id; a top-k, of which each task sends its own ``most`` alone."""
    return runs.orderBy(F.col("id").desc()).limit(most)
