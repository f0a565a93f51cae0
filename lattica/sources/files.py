"""JSON and CSV rows in and out, key-value tables, and backups of an engine's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines under a schema: a value of another type becomes null, a broken line a row of nulls, extra fields go."""
    kinds = spark.createDataFrame([], schema).schema
    # texts first, so that a number in quotes and a number as such are both read as the column's type
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in kinds])).option("mode", "PERMISSIVE").json(path)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds])


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in a column `row`."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "\\N").csv(path)


class KeyValue:
    """Keys with binary values: every put is a Parquet file in its bucket's folder, the last put of a key counts."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.turn = spark, path, 0

    def put(self, rows: DataFrame) -> None:
        """rows (key string, value binary), written to their buckets."""
        self.turn += 1
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.BUCKETS)).cast("int")
        rows.select("key", F.col("value").cast("binary").alias("value"), F.lit(self.turn).alias("turn"), bucket.alias("bucket")).write.mode("append").partitionBy("bucket").parquet(self.path)

    def table(self) -> DataFrame:
        """(key, value) of the last put of each key."""
        every = self.spark.read.parquet(self.path)
        return every.groupBy("key").agg(F.max_by("value", "turn").alias("value"))

    def get(self, key: str) -> bytes | None:
        """One key's value: only its bucket is read."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(self.BUCKETS)).cast("int").alias("b")).first()["b"]
        row = self.spark.read.parquet(self.path).where((F.col("bucket") == bucket) & (F.col("key") == key)).orderBy(F.desc("turn")).select("value").first()
        return None if row is None else bytes(row["value"])


def _state(df: DataFrame) -> list:
    """Rows and an order-free checksum of a table."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(*))"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return [row["n"], row["x"], row["s"]]


def backup(engine, folder: str, base: str | None = None) -> dict:
    """Write an engine's tables to a folder; with a base, an earlier backup's folder, tables that did not change are only named.

    The manifest holds each table's place, checksum and constraints.
    """
    spark = engine.spark
    earlier = _manifest(spark, base) if base else {}
    manifest = {}
    for name, t in engine.tables.items():
        state = _state(t.df)
        if name in earlier and earlier[name]["state"] == state and earlier[name]["schema"] == t.df.schema.json():
            place = earlier[name]["place"]
        else:
            place = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
            t.df.write.parquet(place)
        kept = {k: getattr(t, k) for k in ("key", "auto", "next_id", "not_null", "defaults", "unique", "checks")}
        manifest[name] = {"place": place, "state": state, "schema": t.df.schema.json(), "constraints": kept | {"foreign": [vars(k) for k in t.foreign]}}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def _manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest", wholetext=True).first()[0])


def restore(engine, folder: str) -> None:
    """Put a backup's tables into an engine; a table whose rows do not agree with the manifest raises ValueError."""
    from ..engine import ForeignKey

    for name, m in _manifest(engine.spark, folder).items():
        df = engine.spark.read.schema(T.StructType.fromJson(json.loads(m["schema"]))).parquet(m["place"])
        if _state(df) != m["state"]:
            raise ValueError(f"the backup of {name} is damaged")
        c = m["constraints"]
        engine.register(name, df, **{k: c[k] for k in ("key", "auto", "next_id", "defaults")}, not_null=tuple(c["not_null"]), unique=tuple(map(tuple, c["unique"])), checks=tuple(c["checks"]), foreign=tuple(ForeignKey(**k) for k in c["foreign"]))


def migrate(engine, scripts: list[tuple[int, str, str]], to: int | None = None) -> list[int]:
    """Run numbered scripts (version, up, down; statements end in a semicolon) up or down to a version; the versions run, in order.

    The history is a table `migrations` (version). A script that fails leaves the tables as they were before it.
    """
    from ..dialect import split

    if "migrations" not in engine.tables:
        engine.sql("CREATE TABLE migrations (version BIGINT PRIMARY KEY)")
    done = {r["version"] for r in engine.sql("SELECT version FROM migrations").collect()}
    to = max((v for v, _, _ in scripts), default=0) if to is None else to
    steps = [(v, up, f"INSERT INTO migrations VALUES ({v})") for v, up, _ in sorted(scripts) if v <= to and v not in done]
    steps += [(v, down, f"DELETE FROM migrations WHERE version = {v}") for v, _, down in sorted(scripts, reverse=True) if v > to and v in done]
    for _, script, note in steps:
        engine.sql("BEGIN")
        try:
            for statement in [*split(script, ";"), note]:
                engine.sql(statement)
            engine.sql("COMMIT")
        except Exception:
            engine.sql("ROLLBACK")
            raise
    return [v for v, _, _ in steps]
