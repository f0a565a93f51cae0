"""Sessions and the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def build(app: str = "lattica", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; master None leaves it to the environment."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the tables as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
