"""Bulk import of tables over JDBC, split by key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, user: str | None = None, password: str | None = None, where: str | None = None, key: str | None = None, parts: int = 16, fetch: int = 10_000) -> DataFrame:
    """With a numeric key: its range, read first, is cut into `parts` ranges read in parallel. Without: one reader."""
    options = {"url": url, "fetchsize": str(fetch)} | {k: v for k, v in (("driver", driver), ("user", user), ("password", password)) if v}
    source = f"(select * from {table} where {where}) src" if where else table

    def load(**more: str) -> DataFrame:
        return spark.read.format("jdbc").options(**options, **more).load()

    whole = load(dbtable=source)
    if key:
        key = next(c for c in whole.columns if c.lower() == key.lower())  # as the database writes it
        name = quoted(key, url)
        lo, hi = load(query=f"select min({name}) as least, max({name}) as most from {source}").first()
        if lo is not None:
            return load(dbtable=source, partitionColumn=key, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(parts))
    return whole


def quoted(name: str, url: str) -> str:
    """A column's name as its database has it: quoted, so that its case counts."""
    mark = "`" if url.startswith(("jdbc:mysql", "jdbc:mariadb")) else '"'
    return f"{mark}{name}{mark}"


class Import:
    """Imports run under a job group: progress from the status tracker, cancel by group."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, f"import-{name}"

    def run(self, rows: DataFrame, path: str, mode: str = "append") -> None:
        self.spark.sparkContext.setJobGroup(self.name, self.name, interruptOnCancel=True)
        try:
            rows.write.mode(mode).parquet(path)
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def progress(self) -> tuple[int, int]:
        """(tasks done, tasks known)."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.name) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.name)
