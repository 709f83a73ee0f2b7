"""URL filters as a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and all subdomains when the url's path starts
with the rule's.  For each ancestor of its host, a url has the canonical key
"reversed labels of the ancestor, then path"; a rule has one key of that form, and
everything it fits is the interval of keys that start with it.  Such intervals
nest or are disjoint, so one sweep in key order suffices: the rule opened last,
with the stack of rules that enclose it, holds every rule that can be active at
the next url key; those already closed are popped, and the top of the rest is the
longest for that ancestor.

The sweep is a window over rules and urls together.  Keys of one host never lie in
an interval of another, so it is split by host, and a host's urls are split further
into as many lanes as its share of all keys calls for, each with that host's rules
alone: a hot host is spread over the cluster, and a rule is copied only to the
lanes of its own host.  Keys whose host no rule names open nothing and do not
travel.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import keep, partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of rules are broadcast up to this many.
BROADCAST_HOSTS = 200_000
#: Between labels and path in keys; below every other character.
_CUT = "\x01"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1)).otherwise(F.lit(""))
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), _UPPER, _LOWER)


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(_after(url), F.length(url_host(url)) + 1, F.length(url))).otherwise(F.lit(""))
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """key, stack: each rule's key with all rules whose interval holds it, longest first."""
    keyed = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        F.concat(_reversed(F.translate("host", _UPPER, _LOWER)), F.lit(_CUT), F.coalesce("path", F.lit(""))).alias("key"),
        F.concat(F.col("host"), F.coalesce("path", F.lit(""))).alias("rule"),
        "verdict",
    )
    keyed = keyed.groupBy("key").agg(F.min(F.struct("rule", "verdict")).alias("own")).select("key", "own.*")
    head = F.instr("key", _CUT)
    prefixes = keyed.select(F.col("key").alias("inner"), F.explode(F.transform(F.sequence(head, F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    entry = F.struct(F.length("key").alias("size"), F.col("key"), F.col("rule"), F.col("verdict"))
    held = prefixes.join(keyed, "key").groupBy("inner").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))
    return held.select(F.col("inner").alias("key"), "stack")


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", lanes: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule and verdict.

    ``rules`` has host, path and verdict.  The longest fitting rule wins (host and
    path together; of equals the one that sorts first), and a url without one has
    rule null and verdict ``default``; urls of any length are judged whole.  A null url or one without ``://`` has
    empty host and path and fits no rule; rules without a host fit nothing, of
    rules that repeat a host and path the verdict that sorts first holds; null ids
    and rows that repeat are judged each; other columns are ignored; an empty
    table gives no rows, and no rules give every url the default.
    """
    url = F.col(url_col)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(url_host(url), F.lit("")).alias("host"),
        F.coalesce(url_path(url), F.lit("")).alias("path"),
    )
    n = lanes or max(8, partitions(pages.sparkSession))
    labels = F.split("host", r"\.", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(F.reverse(labels), F.lit(1), k), "."))
    stacks = _stacks(rules).withColumn("ancestor", F.substring_index("key", _CUT, 1))
    hosts = stacks.select("ancestor").distinct()
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    urls = rows.select("row", "page_id", "host", "path", F.explode(ancestors).alias("ancestor")).join(hosts, "ancestor", "left_semi")
    # How many lanes a host gets: its share of all keys, of n lanes.
    often = urls.groupBy("ancestor").agg(F.count("*").alias("keys"))
    often = keep(often, "host-keys")
    every = often.agg(F.sum("keys")).first()[0] or 1
    lanes_of = often.select("ancestor", F.greatest(F.lit(1), F.ceil(F.col("keys") * n / F.lit(every))).cast("int").alias("lanes"))
    lanes_of = F.broadcast(lanes_of) if often.count() <= BROADCAST_HOSTS else lanes_of
    urls = urls.join(lanes_of, "ancestor").select("row", "page_id", "host", "path", "ancestor", F.concat("ancestor", F.lit(_CUT), "path").alias("key"), F.pmod(F.xxhash64("row"), F.col("lanes")).cast("int").alias("lane"), F.lit(1).alias("turn"))
    opened = stacks.join(lanes_of, "ancestor").select("key", "stack", "ancestor", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(0).alias("turn"))
    sweep = Window.partitionBy("ancestor", "lane").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = urls.unionByName(opened, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("turn = 1")
    active = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    top = F.get(active, F.lit(0))
    found = swept.select("row", "page_id", "host", "path", F.when(top.isNotNull(), F.struct((-F.length(top["rule"])).alias("order"), top["rule"].alias("rule"), top["verdict"].alias("verdict"))).alias("best"))
    # Urls under no named host have met no rule.
    found = found.unionByName(rows.select("row", "page_id", "host", "path", F.lit(None).cast(found.schema["best"].dataType).alias("best")))
    best = found.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.min("best").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
