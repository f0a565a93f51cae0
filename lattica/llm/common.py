"""What several operators share: tables in the shared folder, 64-bit mixing, a bounded Bloom filter, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a character class body: blank and the controls 9 to 13.
WHITE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where the session names none (local tests)."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs no recomputation behind them.

    Superseded tables are dropped as the work goes on; what a lazy result still reads goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        if not self.names:
            root, files = self._at(self.root)
            files.deleteOnExit(root)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._at(f"{self.root}/{name}")
            files.delete(path, True)
            self.names.remove(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[x for x in self.names if x not in names])


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batches, rows: int = 500):
    """Arrow batches cut into slices of few rows, which bounds what a worker holds as Python objects."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


#: Rows and bytes of an Arrow batch that a worker is handed, at most, once small_batches() was called.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands its workers small Arrow batches; smaller limits of the caller's stay.

    A batch of texts stands in the executor's memory, more than once while its buffer grows, and in the worker's at the same
    time; with Spark's 10,000 rows that is a good part of a small executor. Plans read these settings when they run, which
    may be after the operator has returned its lazy result, so they stay set. They change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def tidy(run):
    """A function of Arrow batches that, when its task is done, gives the memory it has freed back to the system.

    Workers live on between tasks, several on each executor; what one task needed at its peak must not add up with theirs.
    """

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return own


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; a lambda variable is the only binding that the optimizer never copies."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join) -> Column:
    """Prefix results of an array under an associative join(earlier, later), by doubling: n log n steps for n values."""

    def level(a: Column, width: Column) -> Column:
        return F.when(F.size(a) > width, F.transform(a, lambda v, i: F.when(i >= width, join(F.get(a, i - width), v)).otherwise(v))).otherwise(a)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30)]), values, level)


def counts_before(points: Column, queries: Column) -> Column:
    """For each of the queries, an array of integers, how many points are less: both are sorted and walked together."""
    event = lambda at, kind, i: F.struct(at.alias("at"), F.lit(kind).alias("kind"), i.alias("i"))
    every = F.array_sort(F.concat(F.transform(points, lambda p: event(p, 1, F.lit(-1))), F.transform(queries, lambda q, i: event(q, 0, i))))

    def told(events: Column) -> Column:
        before = running(F.transform(events, lambda e: e["kind"]), lambda x, y: x + y)
        own = let(before, lambda n: F.filter(F.transform(events, lambda e, k: F.struct(e["i"].alias("i"), F.get(n, k).alias("n"))), lambda x: x["i"] >= 0))
        return F.transform(F.array_sort(own), lambda x: x["n"])

    return let(every, told)


def blocks(text: Column, width: int = 1024) -> Column:
    """A text cut into blocks of code points, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), 0)


def cut(parts: Column, start: Column, end: Column, width: int = 1024) -> Column:
    """Code points start to end (exclusive) of a text in blocks(): only the blocks in question are walked."""
    first, last = F.floor(start / width).cast("int"), F.floor((end - 1) / width).cast("int")
    piece = lambda b: F.substring(F.get(parts, b), F.greatest(start - b * width, F.lit(0)) + 1, F.least(end - b * width, F.lit(width)) - F.greatest(start - b * width, F.lit(0)))
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), piece), "")).otherwise(F.lit(""))


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that clash with none of the columns, whatever their case."""
    held = {c.lower() for c in columns}
    out = []
    for w in wanted:
        while w.lower() in held:
            w += "_"
        held.add(w.lower())
        out.append(w)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_cells(words: list[str], least: int, most: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the character grams of `least` to `most` letters of all words, marked by ^ and $, end to end; and where each word's begin."""
    marked = [f"^{w}$" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)))
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(points))  # characters from here to the word's end
    found, there = np.empty((len(points), most - least + 1), np.int64), np.empty((len(points), most - least + 1), bool)
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(most):
            h[: len(h) - n] = h[: len(h) - n] * np.uint64(0x100000001B3) + points[n:]
            if n >= least - 1:
                found[:, n - least + 1], there[:, n - least + 1] = mix64(h + np.uint64(n)) % np.uint64(cells), left > n
    so_far = np.cumsum(there.sum(1))
    return found[there], np.concatenate([[0], so_far[ends - 1]]).astype(np.int64)


#: Bits of the Bloom filter, at any input size: 4 MB. Past its capacity it passes more rows, never fewer.
BLOOM_BITS = 1 << 25


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a long column as uint64 words, built by aggregation; the driver gets at most BLOOM_BITS / 64 words."""
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(s)), F.lit(BLOOM_BITS)) for s in (1, 2)])).alias("b"))
    words = spots.groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v"))
    got = words.toArrow()
    table = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    table[got["w"].to_numpy()] = got["v"].to_numpy()
    return table.view(np.uint64)


def xxhash64_long(x: np.ndarray, seed: int) -> np.ndarray:
    """xxHash64 of 8-byte integers; seed may be an array."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, dtype=np.uint64) + p5 + np.uint64(8)
        h = h ^ (rot(x.view(np.uint64) * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def xxhash64_int(x: int, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of one 4-byte integer."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, dtype=np.uint64) + p5 + np.uint64(4)
        h = rot(h ^ (np.uint64(x) * p1), 23) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def in_bloom(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which int64 ids the filter of bloom() may hold."""
    found = np.ones(len(ids), dtype=bool)
    first = xxhash64_long(np.ascontiguousarray(ids), 42)
    for s in (1, 2):
        spot = xxhash64_int(s, first).view(np.int64) % BLOOM_BITS
        found &= (table[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


#: Rows of one key from which on a join deals the key to several tasks, and the most keys that are dealt so.
SHARE, DEALT_KEYS = 500, 20_000


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, in which key is unique: a key of many rows in left goes to several tasks.

    The rows of such a key are dealt by a hash of the column `by`, and right's row of it is repeated for every share. The
    list of such keys has at most DEALT_KEYS rows, the most frequent ones: any other key has fewer rows than that part of
    left. Keys are counted in `counts`, a written table with left's keys, or in left itself.
    """
    counts = left if counts is None else counts
    many = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > SHARE)
    big = many.orderBy(F.desc("c"), key).limit(DEALT_KEYS).select(key, F.ceil(F.col("c") / SHARE).cast("int").alias("__shares")).collect()
    if not big:
        return left.join(right, key, how)
    shares = F.broadcast(left.sparkSession.createDataFrame(big, left.select(key).schema.add("__shares", "integer")))
    share = F.when(F.col("__shares").isNotNull(), F.pmod(F.xxhash64(by), F.col("__shares"))).otherwise(0).cast("int")
    dealt = left.join(shares, key, "left").withColumn("__share", share).drop("__shares")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))
    return dealt.join(right.join(shares, key, "left").withColumn("__share", every).drop("__shares"), [key, "__share"], how).drop("__share")


#: Edges that one task may unite.
SMALL_EDGES = 15_000


def _united(batches):
    """Union-find over the edges of all batches."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array([top(i) for i in ids], type=pa.int64())], ["id", "root"])


def merged(scratch: Scratch, roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components (id, root) after more links (a, b): only links across components take part."""
    side = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    across = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(scratch, across, name)
    moved = dealt_join(roots, more.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "id", "left").select("id", F.coalesce("to", "root").alias("root"))
    return scratch.keep(moved.unionByName(more.join(roots, "id", "left_anti")), f"{name}-merged")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): one row (id, root) per id in an edge, root the smallest id of its component.

    Alternating large-star and small-star steps; every step is an aggregation, combined before the shuffle, and a join on
    the node that deals a node of huge degree to several tasks. Each round's edges are a table in the shared folder. Up to
    SMALL_EDGES edges are united by one task instead.
    """
    now = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    if now.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        all_of_it = scratch.keep(now.coalesce(1).mapInArrow(tidy(_united), "id long, root long"), f"{name}-all")
        scratch.drop(f"{name}-0")
        return all_of_it
    before, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = dealt_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = scratch.keep(large.where("a != b").distinct(), f"{name}-down-{step}")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = dealt_join(down, least, "a", "b")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = scratch.keep(after.where("a != b").distinct(), f"{name}-{step + 1}")
        state = tuple(after.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())
        scratch.drop(f"{name}-{step}", f"{name}-down-{step}")
        now, step = after, step + 1
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
