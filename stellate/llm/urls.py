"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule is a host and the start of a path (``example.net/en/``); it holds for the host and everything below
it. With the host's labels reversed, ``net.example`` NUL ``/en/`` is a canonical key, and what a rule covers
is the interval from its key up to that key followed by byte 0xFF. Such intervals nest or are apart, so a
sweep in key order needs a stack only. The stack is kept level by level: the running sum of interval
starts and ends is the depth, and the open rule of depth d is the last one that started at depth d.
That turns the rules into boundaries at which the innermost open rule changes. An url is looked up once
for each of its ancestor hosts that has as many labels as some rule; lookups and boundaries are sorted
together over range partitions, and each lookup takes the last boundary before it, from its partition or,
by a row for each partition, from the ones before. A host or url with very many rows is spread over
partitions by a salt in the sort key. Rules are swept in range partitions, too: depths and open rules of the
partitions before come from a row for each partition and depth, so no label's rules share a task.

Defined cases: null urls and urls without ``://`` have an empty host and path and get the default verdict;
of equal rules a blocking one counts; of rules of equal length the one with the longer host wins; repeated
rows stay; an empty table gives an empty result; an empty rule set gives the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellate.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """rule, verdict: rows of a list, without Python at run time."""
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules]) if rules else F.expr("cast(array() as array<struct<rule:string,verdict:string>>)")
    return spark.range(1).select(F.inline(rows))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.encode(F.array_join(labels, "."), "UTF-8"), F.lit(b"\x00"), F.encode(path, "UTF-8"))


def boundaries(rules: DataFrame) -> DataFrame:
    """key, top (the innermost open rule from key on; its fields are null where none is open)."""
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    own = rules.where(F.col("rule").isNotNull()).select("rule", "verdict", host.alias("host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"))
    own = own.withColumn("key", _key(F.reverse(F.split("host", r"\.")), F.col("path")))
    own = own.groupBy("key").agg(F.max(F.struct("verdict", "rule", F.length("rule").alias("size"), F.length("host").alias("host_size"))).alias("r"))  # block sorts after allow
    rule = F.struct("r.size", "r.host_size", "r.rule", "r.verdict")
    events = own.select("key", F.lit(1).alias("step"), rule.alias("opened")).unionByName(
        own.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>").alias("opened"))
    )
    events = checkpointed(events.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = events.groupBy("part").agg(F.sum("step").alias("steps")).select("part", F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("before"))  # a row a partition
    events = events.join(F.broadcast(before), "part").withColumn("depth", F.col("before") + F.sum("step").over(Window.partitionBy("part").orderBy("key")))
    ends = events.groupBy("part", "depth").agg(F.max_by(F.when(F.col("opened").isNotNull(), F.col("opened")), F.when(F.col("opened").isNotNull(), F.col("key"))).alias("end"))
    carried = ends.select("part", "depth", F.last("end", ignorenulls=True).over(Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row a partition and depth
    here = F.last("opened", ignorenulls=True).over(Window.partitionBy("part", "depth").orderBy("key"))
    events = events.withColumn("here", here).join(F.broadcast(carried), ["part", "depth"])
    top = F.when(F.col("depth") > 0, F.coalesce("here", "carried"))
    return events.select("key", F.struct(top["size"].alias("size"), top["host_size"].alias("host_size"), top["rule"].alias("rule"), top["verdict"].alias("verdict")).alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages."""
    labels_most = rules.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\.")))).first()[0] or 1
    base = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    base = base.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    labels = F.reverse(F.split("host", r"\."))
    points = base.select("rid", "id", "host", "path", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(labels_most)))).alias("i"))
    first = F.col("i") == 1
    points = points.select(
        _key(F.slice("labels", 1, F.col("i")), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("rid").alias("salt"),
        "rid", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("host")).alias("host"), F.when(first, F.col("path")).alias("path"),
    )
    marks = boundaries(rules).select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), "top")
    events = points.unionByName(marks, allowMissingColumns=True)
    dealt = checkpointed(events.repartitionByRange("key", "kind", "salt").withColumn("part", F.spark_partition_id()))

    ends = dealt.groupBy("part").agg(F.max_by(F.when(F.col("kind") == 0, F.col("top")), F.when(F.col("kind") == 0, F.col("key"))).alias("top"))
    before = ends.select("part", F.last("top", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))  # a row a partition
    here = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("last", F.last(F.when(F.col("kind") == 0, F.col("top")), ignorenulls=True).over(here)).where("kind = 1")
    hits = swept.join(F.broadcast(before), "part", "left").withColumn("hit", F.coalesce("last", "open"))
    best = hits.groupBy("rid").agg(F.max("id").alias(id_col), F.max("host").alias("host"), F.max("path").alias("path"), F.max(F.when(F.col("hit.rule").isNotNull(), F.col("hit"))).alias("hit"))
    return best.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, rverdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
      ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT p.*, r.rule, r.rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
