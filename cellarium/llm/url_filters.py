"""URL filters as a sort-merge range join, in DataFrame functions only.

Hosts are reversed label by label, so that a rule for a host and its subdomains
becomes a rule on a reversed prefix.  A URL is looked up once at every host level
that rules can name (no more levels than the deepest rule has labels); there the
path is the key, and a rule's path prefix is the interval of the keys that begin
with it.  URLs and rule starts are dealt by level, sorted by path, and swept: each
rule start carries the stack of rules whose intervals hold it (intervals of
prefixes nest or are apart), the sweep hands the last stack seen to every URL,
and what has ended is popped by a prefix test.  The longest rule of all levels
wins; of equally long ones the longer host; of two verdicts for one rule, block.

A level that more than ``1 / SPLIT`` of the rows share is split into salted parts
that each get a copy of its rules; there are fewer than SPLIT such levels, so the
table of them is bounded and can be broadcast.

Cases: a null URL, or one without ``://``, has an empty host and path and meets no
rule; a path that is empty does not begin with ``/``; rules with a null part are
ignored; without rules every URL gets the default verdict; repeated rows each keep
their row; columns of the input are carried in a struct, so none can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLIT = 1000
DEFAULT_VERDICT = "allow"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Fixed values of the contract: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_intervals(rules: DataFrame) -> DataFrame:
    """level, path and stack: for each rule, the rules whose interval holds its start, outermost first."""
    clean = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict"
    )
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    one = one.select(
        reversed_host(F.col("host")).alias("level"),
        "path",
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("host_length"),
            F.concat("host", "path").alias("rule"),
            "verdict",
            "path",
        ).alias("entry"),
    )
    starts = one.select("level", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    starts = starts.select("level", F.col("path").alias("start"), F.expr("left(path, n)").alias("path"))
    held = starts.join(one, ["level", "path"]).groupBy("level", "start").agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    return held.select("level", F.col("start").alias("path"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """The columns of ``pages`` in a struct ``page``, with host, path, rule and verdict."""
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    intervals = rule_intervals(rules)
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    rows = pages.select(page.alias("page"), F.monotonically_increasing_id().alias("uid"), F.col(url).alias("url"))
    rows = rows.select("page", "uid", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, depth)
    levels = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    looked = rows.withColumn("level", F.explode(levels))

    counts = looked.groupBy("level").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = math.ceil(total / SPLIT) or 1
    hot = counts.filter(F.col("count") > share).select("level", F.ceil(F.col("count") / share).alias("salts"))
    hot = F.broadcast(hot)  # fewer than SPLIT rows
    looked = looked.join(hot, "level", "left").withColumn("salt", F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1))))
    dealt = intervals.join(hot, "level", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))
    )

    both = looked.select("level", "salt", "path", F.lit(1).alias("kind"), "uid", "host", "page").unionByName(
        dealt.select("level", "salt", "path", F.lit(0).alias("kind"), "stack"), allowMissingColumns=True
    )
    sweep = Window.partitionBy("level", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("seen", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    active = F.filter("seen", lambda r: F.col("path").startswith(r["path"]))
    top = F.try_element_at(active, F.lit(-1))
    found = swept.select("uid", "page", "host", "path", top.alias("top"))
    best = found.groupBy("uid").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("top").alias("top"))
    return best.select("page", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in rules]
    return spark.range(1).select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge_urls(pages, rules_table(spark))
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE_SQL = {
    "op8_url_filters": r"""
    WITH rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
    SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id, host, path
    """
}
