"""Scalar functions, fuzzy matching, the four-letter codec, vectors, learning, optimisation and signals over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, dna, neuro, scalar, vector
from ..operators import circuits, learning, optimise, pathway, plasticity, recursion, signal
from ..session import table
from .registry import query


@query("text_functions", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS n, strlen(p_name) AS bytes, reverse(p_name) AS rev, ascii(p_name) AS code, chr(65 + CAST(p_partkey % 26 AS INT)) AS letter,
p_name || '/' || p_brand AS both_names, substring(p_name, 2, 3) AS sub, left(p_name, 3) AS l, right(p_name, 2) AS r, replace(p_name, 'ring', 'RING') AS rep, repeat(p_type, 2) AS twice,
CASE WHEN length(p_brand) >= 9 THEN p_brand ELSE lpad(p_brand, 9, '*') END AS lp, CASE WHEN length(p_name) >= 5 THEN p_name ELSE rpad(p_name, 5, '-') END AS rp, instr(p_name, 'r') AS pos,
coalesce(nullif(p_type, 'ECONOMY'), 'none') AS kind FROM part""")
def text_functions(spark, sf_dir) -> DataFrame:
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(n).alias("up"), F.lower(b).alias("low"), F.length(n).alias("n"), F.octet_length(n).alias("bytes"), F.reverse(n).alias("rev"), scalar.ascii_code(n).alias("code"), F.char(65 + F.col("p_partkey") % 26).alias("letter"),
                                               scalar.concat(n, F.lit("/"), b).alias("both_names"), scalar.substring(n, 2, 3).alias("sub"), F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(2)).alias("r"), F.replace(n, F.lit("ring"), F.lit("RING")).alias("rep"), F.repeat(t, 2).alias("twice"),
                                               scalar.lpad(b, 9, "*").alias("lp"), scalar.rpad(n, 5, "-").alias("rp"), scalar.position(n, "r").alias("pos"), F.coalesce(F.nullif(t, F.lit("ECONOMY")), F.lit("none")).alias("kind"))


@query("text_defaults", "SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name) AS l, rtrim(p_name || '  ') AS r, coalesce(nullif(p_type, 'ECONOMY'), p_brand) AS i, upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) AS first_word FROM part")
def text_defaults(spark, sf_dir) -> DataFrame:
    from ..engine import Engine

    e = Engine(spark)
    e.register("part_rows", table(spark, sf_dir, "part"))
    return e.sql("SELECT p_partkey, TRIM(CONCAT('  ', p_name, ' ')) AS t, LTRIM(CONCAT('  ', p_name)) AS l, RTRIM(CONCAT(p_name, '  ')) AS r, IFNULL(NULLIF(p_type, 'ECONOMY'), p_brand) AS i, split_part(INITCAP(CONCAT(' ', p_name)), ' ', 1) AS first_word FROM part_rows")


@query("time_functions", "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s, CAST(floor(epoch(ts)) AS BIGINT) AS e, strftime(ts - INTERVAL 90 MINUTE, '%H:%M') AS before FROM events")
def time_functions(spark, sf_dir) -> DataFrame:
    from ..engine import Engine

    e = Engine(spark)
    e.register("event_rows", table(spark, sf_dir, "events"))
    return e.sql("SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, EXTRACT(EPOCH FROM ts) AS e, DATE_FORMAT(DATE_SUB(ts, INTERVAL 90 MINUTE), '%H:%M') AS before FROM event_rows")


@query("math_functions", """
SELECT c_custkey, abs(c_acctbal) AS a, CAST(round(c_acctbal) AS BIGINT) AS r, round(c_acctbal, 1) AS r1, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, CAST(sign(c_acctbal) AS BIGINT) AS s, CAST(trunc(c_acctbal) AS BIGINT) AS t,
CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey % c_nationkey END AS m, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS q, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS l10,
CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 6) END AS l2, round(power(c_nationkey, 2), 6) AS p, round(exp(c_nationkey / 10.0), 6) AS e, round(pi(), 6) AS pi FROM customer""")
def math_functions(spark, sf_dir) -> DataFrame:
    x, n, k = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.abs(x).alias("a"), scalar.round_half_away(x).alias("r"), scalar.round_half_away(x, 1).alias("r1"), F.ceil(x).alias("up"), F.floor(x).alias("down"), scalar.sign(x).alias("s"), scalar.truncate(x).alias("t"),
                                                   scalar.mod(k, n.cast("long")).alias("m"), F.round(scalar.sqrt(x), 6).alias("q"), F.round(scalar.ln(x), 6).alias("l"), F.round(scalar.log10(x), 6).alias("l10"), F.round(scalar.log2(x), 6).alias("l2"), F.round(scalar.power(n, F.lit(2)), 6).alias("p"), F.round(F.exp(n / 10.0), 6).alias("e"), F.round(F.pi(), 6).alias("pi"))


@query("date_functions", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(quarter(o_orderdate) AS INT) AS q,
strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS f, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INT) AS days, CAST(o_orderdate + INTERVAL 1 MONTH AS TIMESTAMP) AS next, CAST(o_orderdate - INTERVAL 10 DAY AS TIMESTAMP) AS earlier, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS s FROM orders""")
def date_functions(spark, sf_dir) -> DataFrame:
    x = F.col("o_orderdate")
    parts = {"y": "YEAR", "m": "MONTH", "d": "DAY", "dow": "DOW", "doy": "DOY", "w": "WEEK", "q": "QUARTER"}
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", x.cast("timestamp")).select("o_orderkey", *[scalar.extract(f, x).alias(a) for a, f in parts.items()], scalar.date_format(x, "%Y/%m/%d %H:%M:%S").alias("f"), scalar.datediff(x, F.lit("1995-01-01").cast("date")).alias("days"), scalar.date_add(x, 1, "MONTH").cast("timestamp_ntz").alias("next"), scalar.date_add(x, -10, "DAY").cast("timestamp_ntz").alias("earlier"), scalar.extract("EPOCH", x).alias("s"))


_WORDS = "list_filter(string_split_regex(lower(p_name), '\\s+'), lambda w: w <> '')"


def _match_sql(parts: list[str]) -> str:
    """0.7 of the share of pattern words with a similarity over 0.7, and 0.3 of the mean similarity over all pattern words; below 0.3 none."""
    best = ", ".join(f"coalesce(list_max(list_transform({_WORDS}, lambda w: CASE WHEN contains(w, '{p}') OR contains('{p}', w) THEN 1.0 ELSE 1 - levenshtein(w, '{p}') / greatest(strlen(w), {len(p)}) END)), 0.0)" for p in parts)
    return f"""WITH b AS (SELECT p_partkey, p_name, [{best}] AS k FROM part),
s AS (SELECT p_partkey, CASE WHEN contains(lower(p_name), '{" ".join(parts)}') THEN 1.0 ELSE 0.7 * len(list_filter(k, lambda x: x > 0.7)) / {len(parts)} + 0.3 * list_sum(k) / {len(parts)} END AS s FROM b)
SELECT p_partkey, round(CAST(CASE WHEN s < 0.3 THEN 0.0 ELSE s END AS DOUBLE), 6) AS score FROM s"""


@query("neuromatch", _match_sql(["smal", "rings"]))
def neuromatch(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(neuro.neuromatch(F.col("p_name"), "smal rings"), 6).alias("score"))


@query("neuromatch_strength", _match_sql(["red", "ring"]).replace("FROM s", "FROM s WHERE s >= 0.5"))
def neuromatch_strength(spark, sf_dir) -> DataFrame:
    return neuro.neuromatch_filter(table(spark, sf_dir, "part"), "red ring", "p_name", 0.5).select("p_partkey", F.round("match_score", 6).alias("score"))


@query("neuromatch_function", _match_sql(["smal", "rings"]))
def neuromatch_function(spark, sf_dir) -> DataFrame:
    """The function form, in a statement."""
    from ..engine import Engine

    e = Engine(spark)
    e.register("part_rows", table(spark, sf_dir, "part"))
    return e.sql("SELECT p_partkey, round(NEUROMATCH(p_name, 'smal rings'), 6) AS score FROM part_rows")


@query("levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INT) AS d FROM part")
def levenshtein(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"))


@query("synaptic_weight", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 100)), 6) AS w FROM customer")
def synaptic_weight(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(neuro.synaptic_weight(F.col("c_acctbal"), "double"), 6).alias("w"))


@query("synaptic_richness", "SELECT p_partkey, round(0.5 * least(length(p_name) / 100.0, 1.0) + 0.5 * len(list_distinct(string_split(p_name, ''))) / length(p_name), 6) AS w FROM part")
def synaptic_richness(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(neuro.richness(F.col("p_name")), 6).alias("w"))


@query("synaptic_similar", _match_sql(["red", "ring"]).replace("FROM s", "FROM s WHERE s >= 0.5").replace("SELECT p_partkey, round(CAST(CASE WHEN s < 0.3 THEN 0.0 ELSE s END AS DOUBLE), 6) AS score", "SELECT p_partkey"))
def synaptic_similar(spark, sf_dir) -> DataFrame:
    from ..engine import Engine

    e = Engine(spark)
    e.register("part_rows", table(spark, sf_dir, "part"))
    return e.sql("SELECT p_partkey FROM part_rows WHERE p_name SYNAPTIC_SIMILAR 'red ring'")


@query("hebbian_learning", """
WITH a AS (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-l_quantity / 100)) * 1 / (1 + exp(-l_linenumber / 100.0)) * CASE WHEN l_quantity = l_linenumber THEN 1.2 ELSE 1.0 END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, x)) * 0.5, 6) AS h FROM a""")
def hebbian_learning(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(neuro.hebbian(F.col("l_quantity"), F.col("l_linenumber").cast("double"), 0.5), 6).alias("h"))


@query("learn_pattern", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY event_type, user_id % 10 ORDER BY n DESC, event_type, bucket LIMIT 10")
def learn_pattern(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "bucket").limit(10)


# users whose events follow each other
_EDGES = "SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id"
_WEIGHTED = f"SELECT src, dst, (src % 50 - 25) / 20.0 AS weight FROM ({_EDGES}) x"


def _edges(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    pairs = e.select("event_id", F.col("user_id").alias("src")).join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst")), "event_id")
    return pairs.where("src != dst").select("src", "dst").distinct()


def _weighted(spark, sf_dir) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", ((F.col("src") % 50 - 25) / 20.0).alias("weight"), F.lit(1.0).alias("plasticity"))


_STDP = f"""WITH e AS ({_EDGES}), s AS (SELECT user_id AS node, CAST(event_id * 3 AS DOUBLE) AS ms FROM events),
p AS (SELECT src, dst, b.ms - a.ms AS gap FROM s a JOIN s b ON b.ms BETWEEN a.ms - 20 AND a.ms + 20 JOIN e ON a.node = src AND b.node = dst),
c AS (SELECT src, dst, sum(CASE WHEN gap > 0 THEN 0.1 * exp(-gap / 20) ELSE -0.05 * exp(-abs(gap) / 20) END) AS change, count(*) AS pairs FROM p GROUP BY src, dst)"""


_NODES = "SELECT user_id AS node, nullif(user_id % 20, 7) AS cluster, (user_id * 7919 % 1000) / 1000.0 AS score, count(*) AS uses FROM events GROUP BY user_id"
_LINKS = "SELECT a.user_id AS src, b.user_id AS dst, count(*) AS uses FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY a.user_id, b.user_id"
_FATES = f"""WITH n AS ({_NODES}), low AS (SELECT * FROM n WHERE score < 0.1 ORDER BY score, node LIMIT 100),
best AS (SELECT cluster, node AS target FROM n WHERE score > 0.1 AND cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, node) = 1),
f AS (SELECT low.*, target FROM low LEFT JOIN best USING (cluster) WHERE target IS NOT NULL OR score < 0.05),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, node DESC) - 1 AS after FROM f WHERE target IS NOT NULL),
m AS (SELECT target AS node, sum(uses) AS more, count(*) AS c, sum(score * 0.3 * pow(0.7, after)) AS s FROM k GROUP BY target)"""


def _network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Users as nodes, those who follow each other in the events as connections."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    nodes = e.groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("uses")).select("node", F.expr("nullif(node % 20, 7)").alias("cluster"), (F.col("node") * 7919 % 1000 / 1000.0).alias("score"), "uses")
    pairs = e.select("event_id", F.col("user_id").alias("src")).join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst")), "event_id")
    return nodes, pairs.groupBy("src", "dst").agg(F.count("*").alias("uses"))


@query("consolidated_nodes", _FATES + " SELECT n.node, n.cluster, round(CASE WHEN c IS NULL THEN n.score ELSE n.score * pow(0.7, c) + s END, 6) AS score, CAST(n.uses + coalesce(more, 0) AS BIGINT) AS uses FROM n LEFT JOIN m USING (node) WHERE node NOT IN (SELECT node FROM f)")
def consolidated_nodes(spark, sf_dir) -> DataFrame:
    nodes, _ = plasticity.consolidated(*_network(spark, sf_dir))
    return nodes.withColumn("score", F.round("score", 6))


@query("consolidated_links", _FATES + f", l AS ({_LINKS}) SELECT * FROM l WHERE uses >= 2 AND src NOT IN (SELECT node FROM f) AND dst NOT IN (SELECT node FROM f)")
def consolidated_links(spark, sf_dir) -> DataFrame:
    return plasticity.consolidated(*_network(spark, sf_dir))[1]


@query("capacity", f"SELECT count(*) AS nodes, count(*) / 100.0 AS utilisation, CASE WHEN count(*) >= 90 THEN 'consolidate' WHEN count(*) >= 80 THEN 'warn' ELSE 'free' END AS state, CAST(sum(floor(uses * 0.95)) AS BIGINT) AS left_uses FROM ({_NODES}) n")
def capacity(spark, sf_dir) -> DataFrame:
    nodes, _ = _network(spark, sf_dir)
    return plasticity.capacity(nodes, 100).crossJoin(nodes.agg(F.sum(plasticity.faded(F.col("uses"))).alias("left_uses")))


@query("pathway_match", f"""
WITH n AS (SELECT user_id AS node, (user_id * 31 % 100) / 100.0 AS activation, (user_id * 7919 % 1000) / 1000.0 AS strength, count(*) AS accesses FROM events GROUP BY user_id),
l AS ({_WEIGHTED}), awake AS (SELECT node FROM n WHERE activation > 0.5 AND node % 3 = 0),
p AS (SELECT node FROM awake UNION SELECT dst FROM l WHERE weight > 0.7 AND src IN (SELECT node FROM awake) ORDER BY node LIMIT 50),
m AS (SELECT n.*, CAST(0.6 * CASE WHEN strength > 0.5 THEN 0.9 ELSE 0.1 END + 0.4 * CASE WHEN strength > 0.25 THEN 0.8 ELSE 0 END AS DOUBLE) AS score FROM n WHERE node IN (SELECT node FROM p)),
c AS (SELECT src AS node, avg(abs(weight)) AS pull FROM l GROUP BY src)
SELECT node, round(score, 6) AS score, round(least(1.0, greatest(0.0, strength + log10(accesses) / 10 + 0.3 * coalesce(pull, 0))), 6) AS confidence FROM m LEFT JOIN c USING (node) WHERE score > 0.5""")
def pathway_match(spark, sf_dir) -> DataFrame:
    nodes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("accesses"))
    nodes = nodes.select("node", (F.col("node") * 31 % 100 / 100.0).alias("activation"), (F.col("node") * 7919 % 1000 / 1000.0).alias("strength"), "accesses")
    links = _weighted(spark, sf_dir).select("src", "dst", "weight")
    path = pathway.pathway(nodes.where("node % 3 = 0").select("node"), nodes, links)
    return pathway.matches(path, nodes, links, [("=", "", 0.6), (">", "0.25", 0.4)]).select("node", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def _spikes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), (F.col("event_id") * 3).cast("double").alias("ms"))


@query("stdp", _STDP + " SELECT src, dst, round(change, 6) AS change, pairs FROM c")
def stdp(spark, sf_dir) -> DataFrame:
    return learning.stdp(_spikes(spark, sf_dir), _edges(spark, sf_dir)).select("src", "dst", F.round("change", 6).alias("change"), "pairs")


@query("learn_spikes", _STDP + f", w AS ({_WEIGHTED}) SELECT src, dst, round(CASE WHEN change IS NULL THEN weight ELSE least(2.0, greatest(-2.0, weight + 0.1 * least(1.0, greatest(-1.0, change)))) END, 6) AS weight FROM w LEFT JOIN c USING (src, dst)")
def learn_spikes(spark, sf_dir) -> DataFrame:
    return learning.learn_spikes(_spikes(spark, sf_dir), _weighted(spark, sf_dir), 0.1).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("potentiate", f"WITH w AS ({_WEIGHTED}) SELECT src, dst, round(CASE WHEN dst % 2 = 0 THEN least(2.0, greatest(-2.0, weight + 0.2 * least(1.0, greatest(-1.0, 1.5 * (dst % 50) / 50.0)))) ELSE weight END, 6) AS weight, CAST(1 AS DOUBLE) AS plasticity FROM w")
def potentiate(spark, sf_dir) -> DataFrame:
    pairs = _edges(spark, sf_dir).where("dst % 2 = 0").withColumn("corr", F.col("dst") % 50 / 50.0)
    return learning.potentiate(_weighted(spark, sf_dir), pairs, 0.2).select("src", "dst", F.round("weight", 6).alias("weight"), F.round("plasticity", 6).alias("plasticity"))


@query("depress", f"WITH w AS ({_WEIGHTED}) SELECT src, dst, round(CASE WHEN dst % 3 = 0 THEN least(2.0, greatest(-2.0, weight - 0.2 * 0.1 * 0.2)) ELSE weight END, 6) AS weight FROM w")
def depress(spark, sf_dir) -> DataFrame:
    return learning.depress(_weighted(spark, sf_dir), _edges(spark, sf_dir).where("dst % 3 = 0"), 0.2).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("lateral_inhibition", f"""
WITH n AS (SELECT DISTINCT user_id AS id, user_id % 10 / 10.0 AS activation, 0.5 + user_id % 5 / 10.0 AS strength FROM events),
l AS (SELECT dst AS id, sum(0.3 * strength * exp(-(src % 3) * (src % 3) / 2.0)) AS loss FROM ({_EDGES}) e JOIN n ON n.id = src WHERE src % 7 = 0 GROUP BY dst)
SELECT id, round(greatest(0.0, activation - coalesce(loss, 0.0)), 6) AS activation FROM n LEFT JOIN l USING (id)""")
def lateral_inhibition(spark, sf_dir) -> DataFrame:
    u = F.col("user_id")
    nodes = table(spark, sf_dir, "events").select(u.alias("id"), (u % 10 / 10.0).alias("activation"), (0.5 + u % 5 / 10.0).alias("strength")).distinct()
    near = _edges(spark, sf_dir).where("src % 7 = 0").select(F.col("src").alias("active"), F.col("dst").alias("id"), (F.col("src") % 3).alias("distance"))
    return learning.inhibit(nodes, near, 0.3).select("id", F.round("activation", 6).alias("activation"))


@query("payload_score", "SELECT p_partkey, round(CASE WHEN length(p_name) < 2 THEN 0.0 ELSE len(list_filter(range(1, length(p_name)), lambda i: substr(p_name, CAST(i AS INT), 2) = 'in')) / (length(p_name) - 1.0) * (1 + p_size / 100.0) END, 6) AS score FROM part")
def payload_score(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(learning.payload_score(F.col("p_name"), "in", F.col("p_size") / 100), 6).alias("score"))


@query("propagate", f"WITH e AS ({_EDGES}) SELECT dst AS id, round(1 / (1 + exp(-sum(src % 10 / 10.0 * 0.1))), 6) AS output FROM e GROUP BY dst")
def propagate(spark, sf_dir) -> DataFrame:
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("user_id") % 10 / 10.0).alias("output")).distinct()
    return learning.propagate(nodes, _edges(spark, sf_dir).withColumn("weight", F.lit(0.1))).select("id", F.round("output", 6).alias("output"))


@query("winner_takes_all", """
WITH r AS (SELECT c_custkey AS id, c_nationkey, c_acctbal / 10000 AS activation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal / 10000 DESC, c_custkey) AS k FROM customer)
SELECT id, round(least(2.0, greatest(-2.0, CASE WHEN k <= 3 THEN 1.0 + 0.5 * activation * 0.1 ELSE 1.0 - 0.5 * 0.05 END)), 4) AS weight FROM r""")
def winner_takes_all(spark, sf_dir) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", (F.col("c_acctbal") / 10000).alias("activation"), F.lit(1.0).alias("weight"))
    return learning.winners(nodes, 3, 0.5, "c_nationkey").select("id", F.round("weight", 4).alias("weight"))


@query("strengthen_decay_prune", f"""
WITH w AS ({_WEIGHTED}),
s AS (SELECT src, dst, CASE WHEN dst % 2 = 0 THEN least(2.0, greatest(-2.0, weight + 0.1 * least(1.0, dst / 25.0))) ELSE weight END * 0.9 AS weight FROM w)
SELECT src, dst, round(weight, 6) AS weight FROM s WHERE abs(weight) >= 0.3""")
def strengthen_decay_prune(spark, sf_dir) -> DataFrame:
    corr = _edges(spark, sf_dir).where("dst % 2 = 0").withColumn("corr", F.col("dst") / 25.0)
    return learning.prune(learning.decay(learning.strengthen(_weighted(spark, sf_dir), corr, 0.1), 0.9), 0.3).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("activations", """SELECT s_suppkey, round(greatest(s_acctbal / 1000, 0.0), 6) AS relu, round(tanh(s_acctbal / 1000), 6) AS th, round(CASE WHEN s_acctbal > 0 THEN s_acctbal / 1000 ELSE 0.01 * (s_acctbal / 1000) END, 6) AS leaky,
round(1 / (1 + exp(-s_acctbal / 1000)), 6) AS sig, round(s_acctbal / 1000, 6) AS lin, round(1 / (1 + exp(-s_acctbal / 1000)) * (1 - 1 / (1 + exp(-s_acctbal / 1000))), 6) AS d_sig, round(1 - tanh(s_acctbal / 1000) * tanh(s_acctbal / 1000), 6) AS d_th,
CAST(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS DOUBLE) AS d_relu, CAST(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0.01 END AS DOUBLE) AS d_leaky FROM supplier""")
def activations(spark, sf_dir) -> DataFrame:
    x = F.col("s_acctbal") / 1000
    forward = {"relu": "relu", "th": "tanh", "leaky": "leaky_relu", "sig": "sigmoid", "lin": "linear"}
    back = {"d_sig": "sigmoid", "d_th": "tanh", "d_relu": "relu", "d_leaky": "leaky_relu"}
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(neuro.activation(x, f), 6).alias(a) for a, f in forward.items()], *[F.round(neuro.derivative(x, f), 6).alias(a) for a, f in back.items()])


# one millisecond: two half steps of the potential, one of the recovery, and the reset of a neuron that fires
_HALF = "({v} + 0.5 * (0.04 * {v} * {v} + 5 * {v} + 140 - u + i))"
_NEURONS = f"""
WITH RECURSIVE s(neuron, i, ms, v, u, fired) AS (
SELECT n, 4.0::DOUBLE + n, -1::BIGINT, -65.0::DOUBLE, (0.2::DOUBLE * -65.0::DOUBLE), false FROM range(10) x(n)
UNION ALL SELECT neuron, i, ms + 1, CASE WHEN w >= 30.0 THEN -65.0::DOUBLE ELSE w END, CASE WHEN w >= 30.0 THEN r + 8.0::DOUBLE ELSE r END, w >= 30.0
FROM (SELECT neuron, i, ms, w, u + 0.02::DOUBLE * (0.2::DOUBLE * w - u) AS r FROM (SELECT neuron, i, ms, u, {_HALF.format(v="h")} AS w FROM (SELECT neuron, i, ms, u, {_HALF.format(v="v")} AS h FROM s WHERE ms < 199) a) b) c)
SELECT neuron, ms FROM s WHERE fired""".replace("0.04 *", "0.04::DOUBLE *").replace("0.5 *", "0.5::DOUBLE *")


@query("spiking_neurons", _NEURONS)
def spiking_neurons(spark, sf_dir) -> DataFrame:
    t = spark.range(10).select(F.col("id").alias("neuron"), F.explode(F.sequence(F.lit(0), F.lit(199)).cast("array<long>")).alias("ms"))
    return learning.spike_trains(t.withColumn("current", 4.0 + F.col("neuron")))


_LETTERS = "replace(replace(replace(replace(string_agg(substr(bin, 2 * CAST(i AS INT) + 1, 2), ',' ORDER BY i), '00', 'A'), '01', 'T'), '10', 'G'), '11', 'C')"


@query("dna_encode", f"SELECT p_partkey, replace({_LETTERS}, ',', '') AS raw FROM (SELECT p_partkey, bin(p_name) AS bin, unnest(range(0, strlen(p_name) * 4)) AS i FROM part) GROUP BY p_partkey")
def dna_encode(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", dna.encode(F.col("p_name")).alias("raw"))


@query("dna_measures", f"""
WITH c AS (SELECT p_partkey, any_value(p_name) AS name, replace({_LETTERS}, ',', '') AS s FROM (SELECT p_partkey, p_name, bin(p_name) AS bin, unnest(range(0, strlen(p_name) * 4)) AS i FROM part) GROUP BY p_partkey),
f AS (SELECT *, [length(replace(s, 'A', '')), length(replace(s, 'T', '')), length(replace(s, 'G', '')), length(replace(s, 'C', ''))] AS left_over FROM c)
SELECT p_partkey, round(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s), 6) AS gc, round(length(s) / 4 / strlen(name), 6) AS ratio, regexp_matches(s, 'A{{5}}|T{{5}}|G{{5}}|C{{5}}') AS long_run,
round(list_sum(list_transform(left_over, lambda x: CASE WHEN x = length(s) THEN 0.0 ELSE -(1 - x / length(s)) * log2(1 - x / length(s)) END)), 6) AS entropy FROM f""")
def dna_measures(spark, sf_dir) -> DataFrame:
    coded = table(spark, sf_dir, "part").select("p_partkey", "p_name", dna.encode(F.col("p_name")).alias("s"))
    s = F.col("s")
    return coded.select("p_partkey", F.round(dna.gc_content(s), 6).alias("gc"), F.round(dna.ratio(F.col("p_name"), s), 6).alias("ratio"), dna.homopolymer(s, 4).alias("long_run"), F.round(dna.entropy(s), 6).alias("entropy"))


@query("dna_round_trip", "SELECT doc_id, coalesce(text, '') AS text, true AS ok FROM documents")
def dna_round_trip(spark, sf_dir) -> DataFrame:
    coded = table(spark, sf_dir, "documents").select("doc_id", dna.encode(F.coalesce(F.col("text"), F.lit(""))).alias("bases"))
    return coded.select("doc_id", dna.decode(F.col("bases")).alias("raw")).select("doc_id", F.col("raw").cast("string").alias("text"), F.col("raw").isNotNull().alias("ok"))


@query("dictionary_round_trip", "SELECT doc_id, coalesce(text, '') AS text, true AS shorter FROM documents")
def dictionary_round_trip(spark, sf_dir) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    short = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), dna.with_dictionary(t).alias("s"))
    # ÿ as a byte doubles, which no text in UTF-8 holds
    return short.select("doc_id", dna.without_dictionary(F.col("s")).cast("string").alias("text"), (F.octet_length("s.data") <= F.octet_length("t")).alias("shorter"))


@query("letter_code_round_trip", "SELECT doc_id, coalesce(text, '') AS text, true AS shorter FROM documents")
def letter_code_round_trip(spark, sf_dir) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    coded = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(t).alias("n"), codes.pack(dna.encode(t)).alias("c"))
    return coded.select("doc_id", dna.decode(codes.unpack(F.col("c"))).cast("string").alias("text"), (F.octet_length("c.bits") <= F.col("n")).alias("shorter"))


# byte 255 stands in no text in UTF-8, so each byte put there is a wrong one; 9 of them in one block are more than 16 check
# bytes can mend, and the first block holds what a multiple of 239 bytes leaves
@query("parity_repair", "SELECT doc_id, text, true AS wrong, (strlen(text) - 1) % 239 >= 8 AS lost FROM documents WHERE text <> ''")
def parity_repair(spark, sf_dir) -> DataFrame:
    raw = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", raw.alias("raw"), codes.parity(raw).alias("parity"))

    def damaged(n: int):
        return F.concat(F.substring(F.lit(b"\xff" * n), F.lit(1), F.octet_length("raw")), F.substring(F.col("raw"), F.lit(n + 1), F.octet_length("raw")))

    some = codes.repaired(damaged(8), F.col("parity"))
    return docs.select("doc_id", some.cast("string").alias("text"), (damaged(8) != F.col("raw")).alias("wrong"), (~codes.repaired(damaged(9), F.col("parity")).eqNullSafe(F.col("raw"))).alias("lost"))


@query("asof_join", "SELECT l.event_id, r.ts AS last FROM (SELECT * FROM events WHERE event_id % 2 = 0) l ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 1) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_join(spark, sf_dir) -> DataFrame:
    from ..operators.asof import asof

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return asof(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "ts").select("event_id", F.col("met.ts").alias("last"))


@query("cosine_top_k", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x)))) AS c FROM embeddings, q)
SELECT vec_id, round(least(1.0, greatest(0.0, c)), 4) AS similarity FROM s ORDER BY least(1.0, greatest(0.0, c)) DESC, vec_id LIMIT 10""")
def cosine_top_k(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return vector.top_similar(e, q).select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("amplitude_search", "WITH c AS (SELECT c_mktsegment AS s, count(*) AS m, (SELECT count(*) FROM customer) AS n FROM customer GROUP BY c_mktsegment), k AS (SELECT *, CAST(floor(pi() / 4 * sqrt(CAST(n AS DOUBLE) / m)) AS BIGINT) AS iterations FROM c) SELECT s, iterations, round(power(sin((2 * iterations + 1) * asin(sqrt(CAST(m AS DOUBLE) / n))), 2), 6) AS probability FROM k")
def amplitude_search(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    counts = c.groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("m")).withColumn("n", F.lit(c.count()))
    return optimise.amplitude_search(counts).select("s", "iterations", F.round("probability", 6).alias("probability"))


@query("optimal_iterations", "WITH c AS (SELECT c_mktsegment AS s, count(*) AS m, (SELECT count(*) FROM customer) AS n FROM customer GROUP BY c_mktsegment) SELECT s, CAST(round(pi() / 4 * sqrt(CAST(n AS DOUBLE) / m)) AS BIGINT) AS rounded FROM c")
def optimal_iterations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    counts = c.groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("m")).withColumn("n", F.lit(c.count()))
    return optimise.best_iterations(counts).select("s", "rounded")


@query("substring_positions", "SELECT p_partkey, array_to_string(list_filter(range(1, length(p_name)), lambda i: substr(p_name, CAST(i AS INT), 2) = 'in'), ',') AS places FROM part")
def substring_positions(spark, sf_dir) -> DataFrame:
    found = optimise.substring_positions(table(spark, sf_dir, "part"), "p_name", "in")
    return found.select("p_partkey", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("places"))


@query("queries_together", "SELECT 'big' AS query, count(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'low', count(*) FROM supplier WHERE s_acctbal > 1000")
def queries_together(spark, sf_dir) -> DataFrame:
    some = {"big": table(spark, sf_dir, "orders").where("o_totalprice > 200000"), "low": table(spark, sf_dir, "supplier").where("s_acctbal > 1000")}
    return optimise.together(some).groupBy("query").agg(F.count("*").alias("n"))


_GRAPH = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 0, 1.5), (0, 2, 0.5)]


@query("max_cut_exact", "WITH s AS (SELECT range AS state FROM range(16)), e(i, j, w) AS (VALUES " + ", ".join(map(str, _GRAPH)) + ") SELECT state, CAST(sum(-w * ((state >> i) % 2 + (state >> j) % 2 - 2 * ((state >> i) % 2) * ((state >> j) % 2))) AS DOUBLE) AS energy FROM s, e GROUP BY state")
def max_cut_exact(spark, sf_dir) -> DataFrame:
    return optimise.solve_exact(optimise.max_cut(spark.createDataFrame(_GRAPH, "i long, j long, w double")), 4)


_LEAST = "SELECT 0::BIGINT AS problem, min(energy) AS energy FROM (" + "WITH s AS (SELECT range AS state FROM range(16)), e(i, j, w) AS (VALUES " + ", ".join(map(str, _GRAPH)) + ") SELECT state, CAST(sum(-w * ((state >> i) % 2 + (state >> j) % 2 - 2 * ((state >> i) % 2) * ((state >> j) % 2))) AS DOUBLE) AS energy FROM s, e GROUP BY state)"


def _annealed(spark, **options) -> DataFrame:
    """The best energy that any replica reached."""
    q = optimise.max_cut(spark.createDataFrame(_GRAPH, "i long, j long, w double"))
    return optimise.anneal(q.withColumn("problem", F.lit(0).cast("long")), 4, **options).groupBy("problem").agg(F.min("energy").alias("energy"))


@query("annealing", _LEAST)
def annealing(spark, sf_dir) -> DataFrame:
    return _annealed(spark)


@query("parallel_tempering", _LEAST)
def parallel_tempering(spark, sf_dir) -> DataFrame:
    return _annealed(spark, exchange=True)


_RING = [(i, (i + step) % 8, 1.0 + (3 * i + step) % 4) for i in range(8) for step in (1, 3)]


@query("register_solvers", "WITH s AS (SELECT range AS state FROM range(256)), e(i, j, w) AS (VALUES " + ", ".join(map(str, _RING)) + """), t AS (SELECT state, CAST(sum(-w * ((state >> i) % 2 + (state >> j) % 2 - 2 * ((state >> i) % 2) * ((state >> j) % 2))) AS DOUBLE) AS energy FROM s, e GROUP BY state)
SELECT method, min(energy) AS energy, true AS below_even FROM t, (VALUES ('alternating'), ('evolved'), ('variational')) m(method) GROUP BY method""")
def register_solvers(spark, sf_dir) -> DataFrame:
    q = optimise.max_cut(spark.createDataFrame(_RING, "i long, j long, w double")).withColumn("problem", F.lit(0).cast("long"))
    even = -sum(w for *_, w in _RING) / 2  # the mean energy of all states
    each = [circuits.simulated(q, 8, m).select(F.lit(m).alias("method"), "energy", (F.col("mean") < 1.5 * even).alias("below_even")) for m in sorted(circuits.METHODS)]
    return each[0].unionByName(each[1]).unionByName(each[2])


_PLACES = [(0, 1, 2.0), (0, 2, 9.0), (0, 3, 10.0), (1, 0, 1.0), (1, 2, 6.0), (1, 3, 4.0), (2, 0, 15.0), (2, 1, 7.0), (2, 3, 8.0), (3, 0, 6.0), (3, 1, 3.0), (3, 2, 12.0)]


@query("tour_coefficients", "WITH d(i, j, d) AS (VALUES " + ", ".join(map(str, _PLACES)) + """), p AS (SELECT 2 * max(d) AS p FROM d), v AS (SELECT a.range AS c, b.range AS t, a.range * 4 + b.range AS x FROM range(4) a, range(4) b)
SELECT a.x AS i, b.x AS j, CAST(CASE WHEN a.x = b.x THEN -2 * p WHEN a.c = b.c OR a.t = b.t THEN p ELSE d END AS DOUBLE) AS q FROM v a, v b, p LEFT JOIN d ON d.i = a.c AND d.j = b.c AND b.t = a.t + 1
WHERE a.c = b.c OR a.t = b.t OR d IS NOT NULL""")
def tour_coefficients(spark, sf_dir) -> DataFrame:
    return optimise.tour(spark.createDataFrame(_PLACES, "i long, j long, d double"), 4).select("i", "j", "q")


@query("ising_offset", "WITH e(i, j, w) AS (VALUES " + ", ".join(map(str, _GRAPH)) + ") SELECT CAST(sum(-2 * w / 2 + 2 * w / 4) AS DOUBLE) AS offset FROM e")
def ising_offset(spark, sf_dir) -> DataFrame:
    return optimise.ising_offset(optimise.max_cut(spark.createDataFrame(_GRAPH, "i long, j long, w double")))


@query("ferromagnet", "SELECT a.range AS i, b.range AS j, 1.5::DOUBLE AS s FROM range(6) a, range(6) b WHERE a.range < b.range")
def ferromagnet(spark, sf_dir) -> DataFrame:
    return optimise.ferromagnet(spark, 6, 1.5)


@query("recursive_closure", f"WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def recursive_closure(spark, sf_dir) -> DataFrame:
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    return recursion.closure(start, _edges(spark, sf_dir)).select("node")


# the discrete Fourier transform of 64 samples behind a Hann window, a term a sample and frequency
_BANDS_SQL = """WITH x AS (SELECT vec_id AS id, embedding, len(embedding) AS n FROM embeddings),
t AS (SELECT id, n, k, CAST(embedding[k + 1] AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * k / (n - 1))) AS v, f FROM (SELECT *, unnest(range(0, n)) AS k FROM x) y, (SELECT range AS f FROM range(33)) z),
s AS (SELECT id, f * 256.0 / n AS hz, (pow(sum(v * cos(2 * pi() * k * f / n)), 2) + pow(sum(v * sin(2 * pi() * k * f / n)), 2)) / n AS p FROM t GROUP BY id, n, f),
b AS (SELECT id, """ + ", ".join(f"round(coalesce(sum(p) FILTER (WHERE hz >= {lo} AND hz < {hi}), 0.0), 6) AS {name}" for name, (lo, hi) in signal.BANDS.items()) + """ FROM s GROUP BY id),
m AS (SELECT vec_id AS id, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(v AS DOUBLE)), 6) AS deviation FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id)
SELECT * FROM b JOIN m USING (id)"""


def _series(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("samples"))


@query("band_powers", _BANDS_SQL)
def band_powers(spark, sf_dir) -> DataFrame:
    found = signal.band_powers(_series(spark, sf_dir), 256.0)
    return found.select("id", *[F.round(c, 6).alias(c) for c in found.columns if c != "id"])


@query("enrol_authenticate", """WITH f AS (SELECT vec_id, vec_id % 20 AS usr, embedding FROM embeddings), u AS (SELECT usr, k, avg(CAST(embedding[k + 1] AS DOUBLE)) AS x FROM (SELECT *, unnest(range(0, len(embedding))) AS k FROM f) y GROUP BY usr, k),
c AS (SELECT vec_id, sum(CAST(embedding[k + 1] AS DOUBLE) * x) / (sqrt(sum(CAST(embedding[k + 1] AS DOUBLE) * embedding[k + 1])) * sqrt(sum(x * x))) AS c FROM f JOIN u USING (usr) GROUP BY vec_id)
SELECT vec_id, round(least(1.0, greatest(0.0, c)), 5) AS similarity, c >= 0.3 AS accepted FROM c""")
def enrol_authenticate(spark, sf_dir) -> DataFrame:
    features = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("user"), F.col("embedding").cast("array<double>").alias("features"))
    return signal.authenticate(signal.enrol(features), features, 0.3).select("vec_id", F.round("similarity", 5).alias("similarity"), "accepted")


def _drained(spark, stream) -> DataFrame:
    from ..streaming import windows

    return windows.drained(stream, "windowed").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_windowed", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed(spark, sf_dir) -> DataFrame:
    from ..streaming import windows

    return _drained(spark, windows.windowed(windows.events_stream(spark, sf_dir)))


@query("stream_sliding", "SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) x GROUP BY 1, 2")
def stream_sliding(spark, sf_dir) -> DataFrame:
    from ..streaming import windows

    return _drained(spark, windows.windowed(windows.events_stream(spark, sf_dir), "1 hour", "30 minutes"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir) -> DataFrame:
    from ..streaming import windows

    return _drained(spark, windows.sessions(windows.events_stream(spark, sf_dir)))


@query("json_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def json_round_trip(spark, sf_dir) -> DataFrame:
    import uuid

    from ..sources import files
    from ..storage import shared_folder

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    files.write_json(rows, path)
    return files.read_json(spark, path, rows.schema)


@query("dialect_functions", """
SELECT p_partkey, CASE WHEN length(p_name) >= 8 THEN p_name ELSE lpad(p_name, 8, '*') END AS padded, p_name || '-' || p_size AS both_parts, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey % (p_size % 3) END AS rest,
CAST(trunc(p_retailprice / 7) AS BIGINT) AS whole, CAST(CASE WHEN p_name LIKE '%re%' THEN 1 ELSE 0 END AS DOUBLE) AS hit, strftime(DATE '2024-01-31' + INTERVAL 1 MONTH, '%d/%m/%Y') AS day FROM part""")
def dialect_functions(spark, sf_dir) -> DataFrame:
    from ..engine import Engine

    e = Engine(spark)
    e.register("part_rows", table(spark, sf_dir, "part"))
    return e.sql("SELECT p_partkey, LPAD(p_name, 8, '*') AS padded, CONCAT(p_name, '-', p_size) AS both_parts, MOD(p_partkey, p_size % 3) AS rest, TRUNCATE(p_retailprice / 7) AS whole, QUANTUM_SEARCH(p_name, 're') AS hit, DATE_FORMAT(DATE_ADD('2024-01-31', INTERVAL 1 MONTH), '%d/%m/%Y') AS day FROM part_rows")


@query("foreign_key_actions", "SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN 103 WHEN s_nationkey = 4 THEN NULL ELSE s_nationkey END AS nation FROM supplier")
def foreign_key_actions(spark, sf_dir) -> DataFrame:
    """Keys that change cascade; a deleted key's referrers become null."""
    from ..engine import Engine

    e = Engine(spark)
    e.register("nation_source", table(spark, sf_dir, "nation"))
    e.register("supplier_source", table(spark, sf_dir, "supplier"))
    e.sql("CREATE TABLE nations (id INTEGER PRIMARY KEY, name TEXT UNIQUE, CHECK (id >= 0))")
    e.sql("CREATE TABLE suppliers (id INTEGER PRIMARY KEY, nation INTEGER REFERENCES nations(id) ON DELETE SET NULL ON UPDATE CASCADE)")
    e.sql("INSERT INTO nations SELECT n_nationkey, n_name FROM nation_source")
    e.sql("INSERT INTO suppliers SELECT s_suppkey, s_nationkey FROM supplier_source")
    e.sql("UPDATE nations SET id = id + 100 WHERE id = 3")
    e.sql("DELETE FROM nations WHERE id = 4")
    return e.sql("SELECT id, nation FROM suppliers")


@query("numbered_insert", "SELECT row_number() OVER (ORDER BY k) AS id FROM (SELECT c_custkey AS k FROM customer)")
def numbered_insert(spark, sf_dir) -> DataFrame:
    from ..engine import Engine

    e = Engine(spark)
    e.register("customer_source", table(spark, sf_dir, "customer"))
    e.sql("CREATE TABLE numbered (id SERIAL, k BIGINT)")
    e.sql("INSERT INTO numbered (k) SELECT c_custkey FROM customer_source")
    return e.sql("SELECT id FROM numbered")


@query("statements", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS region FROM nation WHERE n_regionkey <> 2")
def statements(spark, sf_dir) -> DataFrame:
    """Create, insert, update, delete, savepoint and rollback, prepared query."""
    from ..engine import Engine

    e = Engine(spark)
    e.register("nation_source", table(spark, sf_dir, "nation"))
    e.sql("CREATE TABLE nation_copy (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER)")
    e.sql("INSERT INTO nation_copy SELECT n_nationkey, n_name, n_regionkey FROM nation_source")
    e.sql("BEGIN")
    e.sql("UPDATE nation_copy SET region = region + 10 WHERE region = 1")
    e.sql("DELETE FROM nation_copy WHERE region = 2")
    e.sql("SAVEPOINT s")
    e.sql("TRUNCATE TABLE nation_copy")
    e.sql("ROLLBACK TO s")
    e.sql("COMMIT")
    e.sql("PREPARE q AS SELECT * FROM nation_copy WHERE id >= $1")
    return e.sql("EXECUTE q (0)").withColumn("id", F.col("id").cast("int")).withColumn("region", F.col("region").cast("int"))
