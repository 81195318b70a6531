"""Registered queries of the tools around tables: accessors, comparators, checks, transfer, catalog, statistics, jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellarium.catalogue import EV, PT, VERSION, event_cells, events_table, orders, part_cells, part_rows, parts_table, register
from cellarium.functions import codec
from cellarium.functions.comparators import Bit, Null, Op
from cellarium.operators import cells, hooks, indexes, jobs, mutations, ranges, versions
from cellarium.operators.catalog import Catalog
from cellarium.operators.cells import FamilySpec
from cellarium.operators.scan import Table
from cellarium.plans import filters as A
from cellarium.plans.compiler import filter_typed
from cellarium.sources import delimited, store, transfer
from cellarium.sources.records import read_table
from cellarium.sources.resource_path import parse_path


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder of the query's own; what it returns is read from there."""
    return f"{store.shared_folder(spark)}/cellarium-{tag}-{uuid.uuid4().hex}"


# ---- scans --------------------------------------------------------------------------------------


@register("exact_timestamp", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev WHERE ts = 77")
def _(s, d):
    return events_table(s, d).scan(timestamp=77, max_versions=None).select(*VERSION)


@register("scan_attributes", f"WITH {PT} SELECT rowkey, qualifier, value || '!' AS value FROM pc WHERE rowkey < '00000004'")
def _(s, d):
    """What a caller hands along with a scan reaches the observers."""
    t = hooks.ObservedTable(parts_table(s, d))
    t.on_attributes("post_scan", lambda df, given: df.withColumn("value", F.concat("value", F.lit(given["mark"]))))
    return t.scan(stop="00000004", attributes={"mark": "!"}).select("rowkey", "qualifier", "value")


@register("latest_map", f"WITH {EV}, l AS (SELECT rowkey, qualifier, arg_max(value, ts) AS value FROM ev GROUP BY ALL) SELECT rowkey, qualifier, value FROM l")
def _(s, d):
    rows = cells.latest_map(event_cells(s, d)).select("rowkey", F.explode("cells").alias("family", "columns"))
    return rows.select("rowkey", F.explode("columns").alias("qualifier", "value"))


@register("cursor_pages", f"WITH {PT} SELECT rowkey, CAST((dense_rank() OVER (ORDER BY rowkey) - 1) // 5 AS INTEGER) AS page, count(*) AS cells FROM pc WHERE rowkey < '00000018' GROUP BY rowkey")
def _(s, d):
    """The pages of a cursor of five rows at once."""
    counts: dict[tuple[int, str], int] = {}
    for n, page in enumerate(parts_table(s, d).cursor(5, stop="00000018")):
        for r in page:
            counts[n, r["rowkey"]] = counts.get((n, r["rowkey"]), 0) + 1
    return s.createDataFrame([(key, n, c) for (n, key), c in counts.items()], "rowkey string, page int, cells bigint")


@register("index_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000")
def _(s, d):
    """Rows of a clustered copy in the order of the indexed value."""
    files = indexes.stored_index(s, f"{d}/orders.parquet", indexes.IndexSpec("o_totalprice", "clustered"), "o_orderkey")
    between = [ranges.between("o_totalprice", 100000.0, 101000.0)]
    rows = indexes.in_order(indexes.of_conjunct(files, between).filter(ranges.predicate([between])), indexes.IndexSpec("o_totalprice"), "o_orderkey")
    return rows.select("o_orderkey", "place")


@register("resource_path", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev WHERE rowkey >= '00000002' AND rowkey < '00000009' AND qualifier = 'click' AND ts >= 100 AND ts < 900 QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) <= 2")
def _(s, d):
    return events_table(s, d).scan(parse_path("/00000002,00000009/e:click/100,900?v=2")).select(*VERSION)


# ---- comparators --------------------------------------------------------------------------------


@register("null_filter", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def _(s, d):
    rows = part_rows(s, d).withColumn("p_partkey", F.col("k").cast("bigint"))
    # Rows without the column never reach a comparator of a filter; the comparator itself tells them.
    return rows.filter(Null().test(Op.EQUAL, F.col("p_type"))).select("p_partkey")


@register("bit_or_xor", "SELECT p_partkey, (p_size | 8) <> 0 AS any, xor(p_size, 7) <> 0 AS other FROM part WHERE (p_size & 6) <> 0")
def _(s, d):
    rows = filter_typed(read_table(s, d, "part"), A.SingleColumnValueFilter("f", "p_size", Op.EQUAL, Bit(6, "AND"), True), F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", Bit(8, "OR").test(Op.EQUAL, F.col("p_size")).alias("any"), Bit(7, "XOR").test(Op.EQUAL, F.col("p_size")).alias("other"))


# ---- checks and edits ---------------------------------------------------------------------------

for _op, _sql in ((Op.LESS, "<"), (Op.GREATER_OR_EQUAL, ">="), (Op.NOT_EQUAL, "<>")):

    def _checked(s, d, op=_op):
        c = part_cells(s, d)
        rows = c.select("rowkey").distinct()
        checks = rows.select("rowkey", F.lit("d").alias("family"), F.lit("p_brand").alias("qualifier"), F.lit("Brand#4").alias("expected"))
        edits = mutations.put(rows.select("rowkey", F.lit("n").alias("family"), F.lit("p_size").alias("qualifier"), F.lit(9).alias("ts"), F.lit("0").alias("value")), 1)
        seen = versions.resolve(mutations.check_and_mutate(c, checks, edits, op))
        return seen.filter("qualifier = 'p_size'").select("rowkey", "value")

    register(f"check_{_op.name.lower()}_and_put", f"WITH {PT} SELECT rowkey, CASE WHEN p_brand {_sql} 'Brand#4' THEN '0' ELSE CAST(p_size AS VARCHAR) END AS value FROM pt WHERE p_size IS NOT NULL")(_checked)


@register("counter_value", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem WHERE l_partkey = 7")
def _(s, d):
    """The value of one counter after increments."""
    amounts = read_table(s, d, "lineitem").select(codec.integer_key(F.col("l_partkey"), 8).alias("rowkey"), F.lit("n").alias("family"), F.lit("hits").alias("qualifier"), F.col("l_linenumber").cast("long").alias("amount"))
    counters = mutations.increment(part_cells(s, d).limit(0), amounts, 1, 1)
    return Table(counters).get("00000007").select(F.col("value").cast("bigint").alias("value"))


# ---- transfer -----------------------------------------------------------------------------------


@register("import_filtered", f"WITH {EV} SELECT rowkey, 'copy' AS family, qualifier, ts, value FROM ev WHERE rowkey LIKE '%3' AND ts % 37 <> 0")
def _(s, d):
    """An export with its markers, imported under another family's name by a filter on rows."""
    marks = mutations.delete_version(event_cells(s, d).filter("ts % 37 = 0"), 1 << 40)
    out = transfer.export_cells(Table(mutations.apply(event_cells(s, d), marks)), None, raw=True)
    path = _folder(s, "export")
    transfer.write_cells(out, path)
    return Table(transfer.import_cells(s, path, A.UserFilter("EndsWithThree"), {"e": "copy"})).scan(max_versions=None).select(*VERSION)


A.register_filter("EndsWithThree", lambda rowkey, family, qualifier, ts, value: rowkey.endswith("3"))


@register("bulk_loaded", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS rowkey, n_name AS value FROM nation UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), r_name FROM region")
def _(s, d):
    """Delimited lines as sorted files, then a second load into the same table."""
    spec, path = delimited.DelimitedSpec.of("ROW_KEY,f:name", "|"), _folder(s, "bulk")
    n, r = read_table(s, d, "nation"), read_table(s, d, "region")
    first, _bad = delimited.cells_of_lines(n.select(F.concat_ws("|", codec.integer_key(F.col("n_nationkey"), 4), "n_name").alias("value")), spec, 1)
    more, _bad = delimited.cells_of_lines(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("|"), "r_name").alias("value")), spec, 1)
    transfer.write_cells(first, path)
    transfer.bulk_load(more, path)
    return Table(s.read.parquet(path)).scan().select("rowkey", "value")


@register("several_sinks", "SELECT 'sink_' || lower(o_orderstatus) AS \"table\", count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(s, d):
    """Rows written to several tables in one pass."""
    path = _folder(s, "sinks")
    jobs.write_tables(orders(s, d).select("o_orderkey", F.concat(F.lit("sink_"), F.lower("o_orderstatus")).alias("table")), path)
    read = None
    for name in ("sink_f", "sink_o", "sink_p"):
        part = jobs.read_written_table(s, path, name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
        read = part if read is None else read.unionAll(part)
    return read.filter("n > 0")


# ---- catalog ------------------------------------------------------------------------------------


def _three_tables(s: SparkSession, d: str) -> Catalog:
    c = Catalog(s, _folder(s, "catalog"))
    part = part_cells(s, d)
    for name, family in (("parts_d", "d"), ("parts_n", "n")):
        c.create(name, {family: FamilySpec()}, part.filter(F.col("family") == family))
    c.create("events", {"e": FamilySpec()}, event_cells(s, d))
    return c


@register("catalog_list", "SELECT * FROM (VALUES ('parts_d', 'd', 3), ('parts_n', 'n', 7)) AS t(name, family, max_versions)")
def _(s, d):
    """Tables by a pattern, from a catalog opened anew, one of them altered."""
    c = _three_tables(s, d)
    c.disable("parts_n")
    c.alter_family("parts_n", "n", max_versions=7)
    again = Catalog.open(s, c.root)
    rows = [(n, f, spec["max_versions"]) for n in again.list("parts_.*") for f, spec in again.describe(n)["families"].items()]
    return s.createDataFrame(rows, "name string, family string, max_versions int")


@register("snapshot_restore", f"WITH {PT} SELECT 'restored' AS state, rowkey, qualifier, value FROM pc WHERE family = 'd' UNION ALL SELECT 'clone', rowkey, qualifier, value FROM pc WHERE family = 'd' UNION ALL SELECT 'edited', rowkey, qualifier, value FROM pc WHERE family = 'd' AND rowkey NOT LIKE '%5'")
def _(s, d):
    """A table edited after a snapshot, the snapshot restored, cloned, exported and imported."""
    c = _three_tables(s, d)
    c.snapshot("parts_d", "before")
    gone = c.table("parts_d").cells.filter("rowkey LIKE '%5'").select("rowkey").distinct().withColumn("ts", F.lit(9))
    c.mutate("parts_d", mutations.delete_row(gone, ["d"], 1))
    c.snapshot("parts_d", "after")
    c.disable("parts_d")
    c.restore_snapshot("before")
    c.enable("parts_d")
    c.export_snapshot("before", f"{c.root}/out")
    c.import_snapshot(f"{c.root}/out", "carried")
    c.clone_snapshot("carried", "copy")
    c.clone_snapshot("after", "edited")
    out = None
    for state, name in (("restored", "parts_d"), ("clone", "copy"), ("edited", "edited")):
        part = c.table(name).scan().select(F.lit(state).alias("state"), "rowkey", "qualifier", "value")
        out = part if out is None else out.unionByName(part)
    return out


@register("split_keys", "SELECT range AS part, lpad(printf('%x', CAST(range * 65536 // 5 AS BIGINT)), 4, '0') AS first FROM range(1, 5)")
def _(s, d):
    """Even cuts of four hex digits for a table that is split before it is loaded."""
    return s.createDataFrame(list(enumerate(codec.hex_split_points(5, 4), 1)), "part bigint, first string")


# ---- indexes and statistics ---------------------------------------------------------------------


@register("index_admin", "SELECT * FROM (VALUES ('o_custkey', 'secondary', true), ('o_totalprice', 'clustered', false)) AS t(name, kind, enabled)")
def _(s, d):
    """Indexes added, dropped and disabled, kept as JSON and read again."""
    catalog = indexes.IndexCatalog("o_orderkey", tuple(orders(s, d).columns))
    for spec in (indexes.IndexSpec("o_totalprice", "clustered"), indexes.IndexSpec("o_custkey"), indexes.IndexSpec("o_orderpriority")):
        catalog.add(spec)
    catalog.drop("o_orderpriority")
    catalog.disable("o_totalprice")
    again = indexes.IndexCatalog.from_json(catalog.to_json())
    return s.createDataFrame([(n, x.kind, n not in again.disabled) for n, x in again.specs.items()], "name string, kind string, enabled boolean")


@register("interpolated_share", "SELECT name, CAST(round(v) AS BIGINT) AS thousandths FROM (VALUES ('half', 500.0), ('early', 1000.0 * (ord('b') - ord('a')) / (ord('z') - ord('a'))), ('before', 0.0), ('after', 1000.0)) AS t(name, v)")
def _(s, d):
    """Where a key lies between two others, by the first bytes in which those differ."""
    asked = {"half": (b"k\x00", b"k\x80\x00", b"k\xff\xff\xff"), "early": (b"a", b"b", b"z"), "before": (b"m", b"a", b"z"), "after": (b"a", b"zz", b"c")}
    rows = [(n, int(1000 * indexes.byte_share(*x) + 0.5)) for n, x in asked.items()]
    return s.createDataFrame(rows, "name string, thousandths bigint")


# ---- jobs ---------------------------------------------------------------------------------------


@register("job_counters", "SELECT count(*) AS rows, count(*) FILTER (o_totalprice > 100000) AS dear FROM orders")
def _(s, d):
    """Counters that a job leaves beside its result."""
    seen, counters = jobs.counted(orders(s, d), f"orders-{uuid.uuid4().hex}", rows=F.count(F.lit(1)), dear=F.count_if(F.col("o_totalprice") > 100000))
    seen.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(counters.get["rows"], counters.get["dear"])], "rows bigint, dear bigint")


@register("user_map_reduce", "SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(o_orderkey % 10) AS BIGINT) AS digits FROM orders GROUP BY 1")
def _(s, d):
    """A user's map over batches and reduction of groups; a first sum in the map keeps the groups small."""

    def digits(frames):
        for f in frames:
            yield f.assign(digits=f.o_orderkey % 10, n=1).groupby("o_orderpriority", as_index=False)[["n", "digits"]].sum()

    mapped = jobs.map_rows(orders(s, d).select("o_orderkey", "o_orderpriority"), digits, "o_orderpriority string, n bigint, digits bigint")
    total = lambda f: f.groupby("o_orderpriority", as_index=False)[["n", "digits"]].sum()
    return jobs.reduce_groups(mapped, ["o_orderpriority"], total, "o_orderpriority string, n bigint, digits bigint").withColumnRenamed("o_orderpriority", "priority")

