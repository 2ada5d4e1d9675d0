"""URL filter by nested rules: a sorted sweep over canonical keys; DataFrame operations only.

A host's key is its labels in reverse order, so a domain and all its subdomains are one interval of
sorted keys, and so is a path with all that it starts. Intervals of prefixes nest or are apart:
running through sorted keys, the rules that are active form a stack, and a rule that starts takes
the slot of its depth. The sweep runs per cell of a range partitioning; what is open at a cell's
start comes from the cells before it. It runs once over hosts and once over the paths below the
rules' hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rollmark.llm.common import Scratch, prepare

#: Host, path and verdict. A rule holds for its host and all subdomains, where the path starts so.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Verdict where no rule holds.
DEFAULT = "allow"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATOR = "\u0001"


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Rules as a table ``host, path, verdict``."""
    rows = ", ".join(f"({', '.join(repr(x) for x in rule)})" for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between ``://`` and the next ``/ ? #``, in lower case, and the path after it; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot: a subdomain's key starts with its domain's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, rules: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """For each distinct ``key`` of ``points``: ``stack``, the keys of ``rules`` it starts with, outermost first."""
    keys = rules.select("key").distinct()
    shorter = keys.select("key", F.explode(F.sequence(F.lit(0), F.length("key") - 1)).alias("n")).select("key", F.substring("key", F.lit(1), F.col("n")).alias("outer"))
    depth = shorter.join(keys.withColumnRenamed("key", "outer"), "outer").groupBy("key").agg(F.count("*").alias("inside"))
    # the depth of a rule is the number of rules around it; rules of one depth never nest
    rules = scratch.table(keys.join(depth, "key", "left").select("key", F.coalesce("inside", F.lit(0)).cast("int").alias("depth")), f"{name}-rules")
    deepest = rules.agg(F.max("depth")).first()[0]
    if deepest is None:
        return points.select("key", F.array().cast("array<string>").alias("stack")).distinct()
    slots = [f"slot{d}" for d in range(deepest + 1)]

    events = points.select("key").distinct().select("key", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"))
    events = events.unionByName(rules.select("key", F.lit(0).alias("kind"), "depth"))
    cells = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    events = events.repartitionByRange(cells, "key").withColumn("cell", F.spark_partition_id())
    events = scratch.table(events, f"{name}-events")

    # a row for each cell: the last rule of each depth before it
    starts = [F.max(F.when(F.col("depth") == d, F.col("key"))).alias(s) for d, s in enumerate(slots)]
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("cell").agg(*starts).select(F.col("cell").alias("of"), *(F.last(s, ignorenulls=True).over(earlier).alias(f"{s}_before") for s in slots))

    running = Window.partitionBy("cell").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select(
        "key", "kind", "cell", *(F.last(F.when(F.col("depth") == d, F.col("key")), ignorenulls=True).over(running).alias(s) for d, s in enumerate(slots))
    ).filter("kind = 1")
    swept = swept.join(F.broadcast(carried), F.col("cell") == F.col("of"))
    open_ = F.array(*(F.coalesce(s, f"{s}_before") for s in slots))
    return swept.select("key", F.filter(open_, lambda rule: F.coalesce(F.startswith(F.col("key"), rule), F.lit(False))).alias("stack"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url``).

    ``rules`` has ``host, path, verdict``. Of the rules that hold the one with the longest text (host
    and path together) decides, of equally long ones the longer host; for a rule that is listed with
    both verdicts, ``block`` counts. A null url, or one without ``://``, has an empty host and path.
    A null in a rule is an empty text. Null and repeated ids are kept, as are repeated rows; other
    columns are not looked at. Empty tables of pages or rules are fine.
    """
    spark = prepare(pages.sparkSession)
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = scratch.table(parsed.select("host", "path").distinct().withColumn("host_key", host_key(F.col("host"))), "urls")

    known = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(
        host_key(F.col("host")).alias("host_key"),
        F.concat(host_key(F.col("host")), F.lit(_SEPARATOR), "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        "verdict",
    )
    hosts = sweep(urls.select(F.col("host_key").alias("key")), known.select(F.col("host_key").alias("key")), scratch, "hosts")
    hosts = scratch.table(hosts.filter(F.size("stack") > 0).withColumnRenamed("key", "host_key"), "hosts")
    below = urls.join(hosts, "host_key").select("host", "path", F.explode("stack").alias("of"))
    below = scratch.table(below.select("host", "path", F.concat("of", F.lit(_SEPARATOR), "path").alias("key")), "below")

    paths = sweep(below, known, scratch, "paths")
    paths = paths.select("key", F.explode("stack").alias("rule_key")).join(known.withColumnRenamed("key", "rule_key"), "rule_key")
    rank = F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict")
    paths = scratch.table(paths.groupBy("key").agg(F.max(rank).alias("best")), "paths")
    judged = below.join(paths, "key").groupBy("host", "path").agg(F.max("best").alias("best"))
    judged = scratch.table(judged.select("host", "path", "best.rule", "best.verdict"), "judged")
    return parsed.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The same over ``pages`` in DuckDB SQL: every url against the few rules.
SQL = """
WITH parsed AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parsed),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
numbered AS (SELECT row_number() OVER () AS n, * FROM split),
fits AS (
  SELECT n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM numbered u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM numbered u LEFT JOIN fits f ON u.n = f.n AND f.place = 1
"""
