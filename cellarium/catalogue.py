"""Registered queries of the engine, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions import codec
from cellarium.functions.comparators import Binary, BinaryPrefix, Bit, Op, Regex, Substring
from cellarium.operators import aggregate, cell_ranges, cells, hooks, indexes, jobs, mutations, ranges, scan, versions
from cellarium.operators.cells import FamilySpec, TableSpec
from cellarium.operators.scan import ScanSpec, Table
from cellarium.plans import filters as A
from cellarium.plans import text as filter_text
from cellarium.plans.compiler import filter_cells, filter_typed
from cellarium.sources import delimited, store, transfer
from cellarium.sources.records import read_table
from cellarium.streaming import edits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(q: Query) -> Query:
        QUERIES[name] = q
        if sql is not None:
            ORACLE_SQL[name] = sql
        return q

    return keep


# ---- tables as cells, and the same in SQL -------------------------------------------------------

#: events: row is the user, qualifier the event type, versions are numbered by event_id.
EVENT_VERSIONS = 1 << 30


def event_cells(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    value = F.round(F.col("value") * 100).cast("long").cast("string")
    return cells.as_cells(e, codec.integer_key(F.col("user_id"), 8), F.lit("e"), F.col("event_type"), F.col("event_id"), value)


EV = """ev AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS rowkey, 'e' AS family, event_type AS qualifier, event_id AS ts,
    CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value FROM events)"""


def part_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "part")
    return p.select(
        codec.integer_key(F.col("p_partkey"), 8).alias("k"),
        "p_name",
        "p_brand",
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("p_type"),
        "p_size",
        F.round(F.col("p_retailprice") * 100).cast("long").alias("p_cents"),
    )


def part_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells.to_cells(part_rows(spark, folder), TableSpec("k", {"d": ["p_name", "p_brand", "p_type"], "n": ["p_size", "p_cents"]}))


PT = """pt AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS rowkey, p_name, p_brand, nullif(p_type, 'ECONOMY') AS p_type, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS p_cents FROM part),
    pc AS (SELECT rowkey, 'd' AS family, 'p_name' AS qualifier, p_name AS value FROM pt WHERE p_name IS NOT NULL
      UNION ALL SELECT rowkey, 'd', 'p_brand', p_brand FROM pt WHERE p_brand IS NOT NULL
      UNION ALL SELECT rowkey, 'd', 'p_type', p_type FROM pt WHERE p_type IS NOT NULL
      UNION ALL SELECT rowkey, 'n', 'p_size', CAST(p_size AS VARCHAR) FROM pt WHERE p_size IS NOT NULL
      UNION ALL SELECT rowkey, 'n', 'p_cents', CAST(p_cents AS VARCHAR) FROM pt WHERE p_cents IS NOT NULL)"""

CELL = ["rowkey", "family", "qualifier", "value"]
VERSION = ["rowkey", "family", "qualifier", "ts", "value"]


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders")


ORDER_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderpriority"]


def events_table(spark: SparkSession, folder: str) -> Table:
    return Table(event_cells(spark, folder), tombstones=False, ties=False)


def parts_table(spark: SparkSession, folder: str) -> Table:
    """The parts' cells as a stored table in ranges of row keys; made when it is first asked for."""
    files = store.stored(spark, "part-cells", f"{folder}/part.parquet", lambda: part_cells(spark, folder), "rowkey", ["family", "qualifier"])
    return Table.of_files(files, tombstones=False, ties=False)


# ---- range queries ------------------------------------------------------------------------------

PRICE = [(20000.0, 45000.0), (20000.0, 45000.0), (20000.0, 45000.0), (20000.0, 35000.0), (25000.0, 35000.0)]
SINCE = [None, "1997-03-10", "1997-03-10", "1997-11-10", "1998-03-10"]


def _bench_ranges(i: int) -> list[ranges.Range]:
    out = [ranges.between("o_totalprice", *PRICE[i])]
    if SINCE[i]:
        out.append(ranges.where("o_orderdate", ">=", F.lit(SINCE[i]).cast("timestamp_ntz")))
    if i >= 2:
        out.append(ranges.where("o_orderpriority", "=", "3-MEDIUM"))
    return out


def _bench_sql(i: int) -> str:
    out = f"o_totalprice BETWEEN {PRICE[i][0]} AND {PRICE[i][1]}"
    out += f" AND o_orderdate >= TIMESTAMP '{SINCE[i]} 00:00:00'" if SINCE[i] else ""
    return out + (" AND o_orderpriority = '3-MEDIUM'" if i >= 2 else "")


for _i in range(5):
    register(f"range_f{_i + 1}", f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE {_bench_sql(_i)}")(
        lambda s, d, i=_i: ranges.range_query(orders(s, d), [_bench_ranges(i)], ORDER_COLUMNS)
    )


@register("range_dnf", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE (o_totalprice < 5000 AND o_orderpriority = '1-URGENT') OR (o_totalprice > 480000 AND o_orderpriority <> '5-LOW')")
def _(s, d):
    w = ranges.where
    dnf = [[w("o_totalprice", "<", 5000.0), w("o_orderpriority", "=", "1-URGENT")], [w("o_totalprice", ">", 480000.0), w("o_orderpriority", "!=", "5-LOW")]]
    return ranges.range_query(orders(s, d), dnf, ORDER_COLUMNS)


@register("range_union_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 400000")
def _(s, d):
    w = ranges.where
    return ranges.range_query(orders(s, d), [[w("o_totalprice", ">", 450000.0)], [w("o_orderpriority", "=", "2-HIGH"), w("o_totalprice", ">", 400000.0)]], ["o_orderkey"], union_all=True)


@register("range_complement", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE NOT (o_totalprice BETWEEN 3000 AND 495000)")
def _(s, d):
    return ranges.range_query(orders(s, d), ranges.between("o_totalprice", 3000.0, 495000.0).complement(), ORDER_COLUMNS)


@register("range_complement_bare", "SELECT o_orderkey, o_orderstatus FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL AND o_orderkey % 7 = 0")
def _(s, d):
    """What is outside a range of all values is nothing; what is outside of that is every row with a value."""
    rows = orders(s, d).withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("F"))).filter("o_orderkey % 7 = 0")
    bare = ranges.Range("o_orderstatus")
    outside = ranges.range_query(rows, bare.complement(), ["o_orderkey", "o_orderstatus"])
    again = ranges.range_query(rows, bare.complement()[0][0].complement(), ["o_orderkey", "o_orderstatus"])
    return again.unionAll(outside)


@register("select_text", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 490000.5 OR (o_orderstatus = 'P' AND o_totalprice < 9000 AND o_custkey >= 100)")
def _(s, d):
    text = "SELECT o_orderkey, f:o_orderstatus FROM orders WHERE o_totalprice >= 490000.5 OR (o_orderstatus = 'P' AND o_totalprice < 9000 AND o_custkey >= 100)"
    return ranges.select(text, {"orders": orders(s, d)})


@register("select_key_range", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 250")
def _(s, d):
    return ranges.select("select o_orderkey, o_orderstatus from orders", {"orders": orders(s, d)}, "o_orderkey", 100, 250)


@register("range_file", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 20000 AND o_totalprice <= 45000 AND o_orderpriority = '3-MEDIUM'")
def _(s, d):
    lines = ["t\tdouble\t>=\t20000\t<=\t45000", "#d\tLONG\t>=\t19970310", "p\tstring\t==\t3-MEDIUM"]
    return ranges.range_query(orders(s, d), [ranges.read_ranges(lines, {"t": "o_totalprice", "p": "o_orderpriority"})], ORDER_COLUMNS)


# ---- scans by key -------------------------------------------------------------------------------


@register("full_scan", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc")
def _(s, d):
    return parts_table(s, d).scan().select(*CELL)


@register("scan_start_stop", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE rowkey >= '00000100' AND rowkey < '00000120'")
def _(s, d):
    return parts_table(s, d).scan(start="00000100", stop="00000120").select(*CELL)


@register("scan_open_end", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE rowkey >= '00000190'")
def _(s, d):
    return parts_table(s, d).scan(start="00000190").select(*CELL)


@register("scan_limit", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE rowkey IN (SELECT rowkey FROM pt WHERE rowkey >= '00000050' ORDER BY rowkey LIMIT 7)")
def _(s, d):
    return parts_table(s, d).scan(start="00000050", limit=7).select(*CELL)


@register("scan_columns", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE family = 'n' OR qualifier = 'p_brand'")
def _(s, d):
    return parts_table(s, d).scan(columns=("n", "d:p_brand")).select(*CELL)


@register("scan_batch", f"WITH {PT} SELECT rowkey, CAST((row_number() OVER (PARTITION BY rowkey ORDER BY family, qualifier) - 1) // 2 AS INTEGER) AS part, qualifier FROM pc")
def _(s, d):
    return parts_table(s, d).scan(batch=2).select("rowkey", "part", "qualifier")


@register("get_row", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE rowkey = '00000042'")
def _(s, d):
    return parts_table(s, d).get("00000042").select(*CELL)


@register("multi_get", f"WITH {PT}, k AS (SELECT DISTINCT lpad(CAST(l_partkey + 100000 * (l_linenumber % 2) AS VARCHAR), 8, '0') AS rowkey FROM lineitem) SELECT k.rowkey, family, qualifier, value FROM k LEFT JOIN pc ON k.rowkey = pc.rowkey")
def _(s, d):
    k = read_table(s, d, "lineitem").select(codec.integer_key(F.col("l_partkey") + 100000 * (F.col("l_linenumber") % 2), 8).alias("k")).distinct()
    return parts_table(s, d).multi_get(k, "k").select(*CELL)


@register("row_exists", f"WITH {PT} SELECT EXISTS (SELECT * FROM pc WHERE rowkey = '00000007') AS found")
def _(s, d):
    return parts_table(s, d).get("00000007").agg((F.count(F.lit(1)) > 0).alias("found"))


@register("row_or_before", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE family = 'd' AND rowkey = (SELECT max(rowkey) FROM pc WHERE rowkey <= '00000099x' AND family = 'd')")
def _(s, d):
    return parts_table(s, d).row_or_before("00000099x", "d").select(*CELL)


@register("as_of_rows", "SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_orderkey, o_orderkey * 3 AS at FROM orders) o ON e.event_id >= o.at")
def _(s, d):
    rows = orders(s, d).select((F.col("o_orderkey") * 3).alias("at"), "o_orderkey")
    return scan.as_of(read_table(s, d, "events").select("event_id"), rows, "at", "event_id").select("event_id", F.col("match.o_orderkey").alias("o_orderkey"))


@register("salted_scan", "SELECT c_custkey FROM (SELECT c_custkey, CAST(c_custkey % 4 AS VARCHAR) || '-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer) WHERE (k >= '0-000100' AND k < '0-000200') OR (k >= '2-000100' AND k < '2-000200')")
def _(s, d):
    c = read_table(s, d, "customer")
    keyed = c.withColumn("k", F.concat((F.col("c_custkey") % 4).cast("string"), F.lit("-"), codec.integer_key(F.col("c_custkey"), 6)))
    return scan.salted_scan(keyed, "k", ["0-", "2-"], "000100", "000200").select("c_custkey")


@register("multi_table_scan", f"WITH {PT}, {EV} SELECT 'parts' AS \"table\", rowkey, qualifier FROM pc WHERE rowkey < '00000010' UNION ALL SELECT 'events', rowkey, qualifier FROM ev WHERE rowkey < '00000003' GROUP BY rowkey, qualifier")
def _(s, d):
    both = scan.multi_table({"parts": (parts_table(s, d), ScanSpec(stop="00000010")), "events": (events_table(s, d), ScanSpec(stop="00000003"))})
    return both.select("table", "rowkey", "qualifier")


@register("result_map_latest", f"WITH {EV}, l AS (SELECT rowkey, qualifier, arg_max(value, ts) AS value FROM ev GROUP BY ALL) SELECT rowkey, max(CASE WHEN qualifier = 'click' THEN value END) AS click, max(CASE WHEN qualifier = 'view' THEN value END) AS view, bool_or(qualifier = 'signup') AS has_signup FROM l GROUP BY rowkey")
def _(s, d):
    m = cells.result_map(event_cells(s, d))
    pick = lambda q: cells.column_latest(F.col("cells"), "e", q)["value"].alias(q)
    return m.select("rowkey", pick("click"), pick("view"), cells.contains_column(F.col("cells"), "e", "signup").alias("has_signup"))


@register("typed_from_cells", f"WITH {PT} SELECT rowkey, p_brand, p_size FROM pt")
def _(s, d):
    return cells.from_cells(part_cells(s, d), {"d:p_brand": "string", "n:p_size": "int"})


# ---- filters ------------------------------------------------------------------------------------


def _cells_query(name: str, f, where: str, select: str = "rowkey, family, qualifier, value") -> None:
    """A filter on the parts' cells, given as a tree or as text."""

    def run(s: SparkSession, d: str) -> DataFrame:
        return parts_table(s, d).scan(filter=f).select(*CELL)

    register(name, f"WITH {PT} SELECT {select} FROM pc WHERE {where}")(run)


_cells_query("row_filter", A.RowFilter(Op.GREATER_OR_EQUAL, Binary("00000150")), "rowkey >= '00000150'")
_cells_query("row_filter_regex", "RowFilter(=, 'regexstring:7$')", "regexp_matches(rowkey, '7$')")
_cells_query("scan_prefix", "PrefixFilter('0000001')", "starts_with(rowkey, '0000001')")
_cells_query("inclusive_stop", "InclusiveStopFilter('00000012')", "rowkey <= '00000012'")
_cells_query("fuzzy_row", A.FuzzyRowFilter((("00000107", (0, 0, 0, 0, 0, 0, 1, 0)), ("00000033", (0, 0, 0, 0, 0, 1, 0, 0)))), "(substr(rowkey, 1, 6) = '000001' AND substr(rowkey, 8, 1) = '7') OR (substr(rowkey, 1, 5) = '00000' AND substr(rowkey, 7, 2) = '33')")
_cells_query("cells_family", "FamilyFilter(=, 'binary:n')", "family = 'n'")
_cells_query("cells_qualifier", "QualifierFilter(>, 'binary:p_name')", "qualifier > 'p_name'")
_cells_query("cells_value", "ValueFilter(=, 'substring:BRAND#1')", "lower(value) LIKE '%brand#1%'")
_cells_query("value_binaryprefix", "ValueFilter(>=, 'binaryprefix:re')", "substr(value, 1, 2) >= 're'")
_cells_query("value_not_regex", "ValueFilter(!=, 'regexstring:^[a-m]')", "NOT regexp_matches(value, '^[a-m]')")
_cells_query("column_prefix", "ColumnPrefixFilter('p_b')", "starts_with(qualifier, 'p_b')")
_cells_query("multiple_column_prefix", "MultipleColumnPrefixFilter('p_b', 'p_s')", "starts_with(qualifier, 'p_b') OR starts_with(qualifier, 'p_s')")
_cells_query("column_range", "ColumnRangeFilter('p_brand', false, 'p_size', false)", "qualifier > 'p_brand' AND qualifier < 'p_size'")
_cells_query("filter_string_and_or", "(PrefixFilter('000000') AND QualifierFilter(=, 'binary:p_size')) OR ValueFilter(=, 'binary:Brand#7')", "(starts_with(rowkey, '000000') AND qualifier = 'p_size') OR value = 'Brand#7'")
_cells_query("nested_lists", A.disjunction(A.conjunction(A.FamilyFilter(Op.EQUAL, Binary("n")), A.ValueFilter(Op.EQUAL, Regex("^9"))), A.conjunction(A.PrefixFilter("0000002"), A.QualifierFilter(Op.EQUAL, Substring("NAME")))), "(family = 'n' AND starts_with(value, '9')) OR (starts_with(rowkey, '0000002') AND lower(qualifier) LIKE '%name%')")
_cells_query("scvf_cells", "SingleColumnValueFilter('d', 'p_type', >=, 'binary:P', true, true)", "rowkey IN (SELECT rowkey FROM pt WHERE p_type >= 'P')")
_cells_query("scvf_cells_missing_pass", "SingleColumnValueFilter('d', 'p_type', >=, 'binary:P')", "rowkey IN (SELECT rowkey FROM pt WHERE p_type >= 'P' OR p_type IS NULL)")
_cells_query("scvf_or_cells", "SingleColumnValueFilter('d', 'p_type', =, 'binary:PROMO', true, true) OR SingleColumnValueFilter('d', 'p_brand', =, 'binary:Brand#3', true, true)", "rowkey IN (SELECT rowkey FROM pt WHERE p_type = 'PROMO' OR p_brand = 'Brand#3')")
_cells_query("scvf_exclude", "SingleColumnValueExcludeFilter('d', 'p_brand', =, 'binary:Brand#5')", "rowkey IN (SELECT rowkey FROM pt WHERE p_brand = 'Brand#5') AND qualifier <> 'p_brand'")
_cells_query("skip_filter", "SKIP ValueFilter(!=, 'substring:red')", "rowkey NOT IN (SELECT rowkey FROM pc WHERE lower(value) LIKE '%red%')")
_cells_query("while_match", "WHILE RowFilter(!=, 'binary:00000077')", "rowkey < '00000077'")
_cells_query("while_value", "WHILE ValueFilter(!=, 'binary:Brand#9')", "(rowkey, family, qualifier) < (SELECT (rowkey, family, qualifier) FROM pc WHERE value = 'Brand#9' ORDER BY rowkey, family, qualifier LIMIT 1)")
_cells_query("page_filter", "PageFilter(9)", "rowkey IN (SELECT rowkey FROM pt ORDER BY rowkey LIMIT 9)")
_cells_query("page_after_prefix", "PrefixFilter('000001') AND PageFilter(4)", "rowkey IN (SELECT rowkey FROM pt WHERE starts_with(rowkey, '000001') ORDER BY rowkey LIMIT 4)")
_cells_query("first_key", "FirstKeyOnlyFilter()", "true QUALIFY row_number() OVER (PARTITION BY rowkey ORDER BY family, qualifier) = 1")
_cells_query("column_paging", "ColumnPaginationFilter(2, 1)", "true QUALIFY row_number() OVER (PARTITION BY rowkey ORDER BY family, qualifier) BETWEEN 2 AND 3")
_cells_query("column_count", "ColumnCountGetFilter(3)", "true QUALIFY row_number() OVER (PARTITION BY rowkey ORDER BY family, qualifier) <= 3")
_cells_query("key_only", "KeyOnlyFilter()", "true", "rowkey, family, qualifier, '' AS value")
_cells_query("key_only_length", "KeyOnlyFilter(true)", "true", "rowkey, family, qualifier, CAST(octet_length(CAST(value AS BLOB)) AS VARCHAR) AS value")
_cells_query("json_filter", filter_text.from_json({"type": "FilterList", "op": "MUST_PASS_ALL", "filters": [{"type": "PrefixFilter", "value": "0000003"}, {"type": "QualifierFilter", "op": "EQUAL", "comparator": {"type": "BinaryComparator", "value": "p_size"}}]}), "starts_with(rowkey, '0000003') AND qualifier = 'p_size'")

A.register_filter("EvenLengthFilter", lambda rowkey, family, qualifier, ts, value: F.char_length(value) % 2 == 0)
_cells_query("user_filter", "EvenLengthFilter()", "length(value) % 2 = 0")


@register("random_row", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE CAST('0x' || substr(md5(rowkey || '/5'), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.3")
def _(s, d):
    return parts_table(s, d).scan(filter=A.RandomRowFilter(0.3, 5)).select(*CELL)


@register("timestamps_filter", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev WHERE ts IN (3, 50, 700)")
def _(s, d):
    return events_table(s, d).scan(filter="TimestampsFilter(3, 50, 700)", max_versions=None).select(*VERSION)


LC = """c AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS rowkey, l_returnflag AS qualifier, CAST(l_linenumber AS BIGINT) AS ts, l_linestatus AS value FROM lineitem)"""


def _dependent(s: SparkSession, d: str, f: str) -> DataFrame:
    c = cells.as_cells(read_table(s, d, "lineitem"), codec.integer_key(F.col("l_orderkey"), 8), F.lit("f"), F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_linestatus"))
    return filter_cells(c, filter_text.parse(f)).select("rowkey", "qualifier", "ts", "value")


@register("dependent_column", f"WITH {LC} SELECT rowkey, qualifier, ts, value FROM c WHERE EXISTS (SELECT * FROM c r WHERE r.rowkey = c.rowkey AND r.ts = c.ts AND r.qualifier = 'A')")
def _(s, d):
    return _dependent(s, d, "DependentColumnFilter('f', 'A')")


@register("dependent_column_drop", f"WITH {LC} SELECT rowkey, qualifier, ts, value FROM c WHERE qualifier <> 'A' AND EXISTS (SELECT * FROM c r WHERE r.rowkey = c.rowkey AND r.ts = c.ts AND r.qualifier = 'A' AND r.value = 'F')")
def _(s, d):
    return _dependent(s, d, "DependentColumnFilter('f', 'A', true, =, 'binary:F')")


@register("time_range_filter", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev WHERE rowkey IN (SELECT rowkey FROM ev WHERE qualifier = 'click' AND ts BETWEEN 100 AND 400) AND (qualifier <> 'click' OR ts BETWEEN 100 AND 400)")
def _(s, d):
    return events_table(s, d).scan(filter=A.TimeRangeFilter("e", "click", 100, 400, True), max_versions=None).select(*VERSION)


# ---- filters on typed tables --------------------------------------------------------------------


def _status(s: SparkSession, d: str) -> DataFrame:
    return orders(s, d).select("o_orderkey", "o_totalprice", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("o_orderstatus"))


STATUS = "st AS (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders)"


@register("scvf_present", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 480000")
def _(s, d):
    f = A.SingleColumnValueFilter("f", "o_totalprice", Op.GREATER, Binary(480000.0))
    return filter_typed(orders(s, d), f, F.col("o_orderkey").cast("string")).select("o_orderkey", "o_totalprice")


@register("scvf_missing_pass", f"WITH {STATUS} SELECT o_orderkey, o_orderstatus FROM st WHERE o_orderstatus = 'P' OR o_orderstatus IS NULL")
def _(s, d):
    f = filter_text.parse("SingleColumnValueFilter('f', 'o_orderstatus', =, 'binary:P')")
    return filter_typed(_status(s, d), f, F.col("o_orderkey").cast("string")).select("o_orderkey", "o_orderstatus")


@register("scvf_filter_missing", f"WITH {STATUS} SELECT o_orderkey, o_orderstatus FROM st WHERE o_orderstatus = 'P'")
def _(s, d):
    f = filter_text.parse("SingleColumnValueFilter('f', 'o_orderstatus', =, 'binary:P', true, true)")
    return filter_typed(_status(s, d), f, F.col("o_orderkey").cast("string")).select("o_orderkey", "o_orderstatus")


@register("scvf_exclude_typed", f"WITH {STATUS} SELECT o_orderkey, o_totalprice FROM st WHERE o_orderstatus = 'O'")
def _(s, d):
    f = filter_text.parse("SingleColumnValueExcludeFilter('f', 'o_orderstatus', =, 'binary:O', true, true)")
    return filter_typed(_status(s, d), f, F.col("o_orderkey").cast("string"))


@register("bit_filter", "SELECT doc_id, quality, toxic FROM labels WHERE (quality & 1) <> 0 AND (toxic & 1) = 0")
def _(s, d):
    f = A.conjunction(A.SingleColumnValueFilter("f", "quality", Op.EQUAL, Bit(1, "AND"), True), A.SingleColumnValueFilter("f", "toxic", Op.NOT_EQUAL, Bit(1, "AND"), True))
    return filter_typed(read_table(s, d, "labels"), f, F.col("doc_id").cast("string")).select("doc_id", "quality", "toxic")


@register("regex_filter", "SELECT page_id FROM pages WHERE regexp_matches(url, 'example\\.(org|net)/(en|es)/[0-9]+')")
def _(s, d):
    f = A.SingleColumnValueFilter("f", "url", Op.EQUAL, Regex(r"example\.(org|net)/(en|es)/[0-9]+"), True)
    return filter_typed(read_table(s, d, "pages"), f, F.col("page_id").cast("string")).select("page_id")


@register("substring_filter", "SELECT conv_id, turn FROM conversations WHERE lower(text) LIKE '%the%' AND lower(role) LIKE '%user%'")
def _(s, d):
    f = A.conjunction(A.SingleColumnValueFilter("f", "text", Op.EQUAL, Substring("The"), True), A.SingleColumnValueFilter("f", "role", Op.EQUAL, Substring("USER"), True))
    return filter_typed(read_table(s, d, "conversations"), f, F.col("conv_id").cast("string")).select("conv_id", "turn")


@register("binaryprefix_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE substr(c_mktsegment, 1, 2) > 'BU'")
def _(s, d):
    f = A.SingleColumnValueFilter("f", "c_mktsegment", Op.GREATER, BinaryPrefix("BU"), True)
    return filter_typed(read_table(s, d, "customer"), f, F.col("c_custkey").cast("string")).select("c_custkey", "c_mktsegment")


# ---- versions and deletes -----------------------------------------------------------------------


@register("latest_version", f"WITH {EV} SELECT rowkey, family, qualifier, max(ts) AS ts, arg_max(value, ts) AS value FROM ev GROUP BY rowkey, family, qualifier")
def _(s, d):
    return events_table(s, d).scan().select(*VERSION)


@register("n_versions", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) <= 3")
def _(s, d):
    return events_table(s, d).scan(max_versions=3).select(*VERSION)


@register("family_max_versions", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) <= 2")
def _(s, d):
    return Table(event_cells(s, d), {"e": FamilySpec(max_versions=2)}, tombstones=False, ties=False).scan(max_versions=None).select(*VERSION)


@register("time_range", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev WHERE ts >= 200 AND ts < 800 QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) <= 2")
def _(s, d):
    return events_table(s, d).scan(time_min=200, time_max=800, max_versions=2).select(*VERSION)


@register("filter_before_versions", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev WHERE value < '5' QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) = 1")
def _(s, d):
    return events_table(s, d).scan(filter="ValueFilter(<, 'binary:5')").select(*VERSION)


@register("scvf_any_version", f"WITH {EV} SELECT rowkey, family, qualifier, max(ts) AS ts FROM ev WHERE rowkey IN (SELECT rowkey FROM ev WHERE qualifier = 'error' AND starts_with(value, '9')) GROUP BY rowkey, family, qualifier")
def _(s, d):
    return events_table(s, d).scan(filter="SingleColumnValueFilter('e', 'error', =, 'binaryprefix:9', true, false)").select("rowkey", "family", "qualifier", "ts")


@register("scvf_latest_version", f"WITH {EV} SELECT rowkey, family, qualifier, max(ts) AS ts FROM ev WHERE rowkey IN (SELECT rowkey FROM ev WHERE qualifier = 'error' GROUP BY rowkey HAVING starts_with(arg_max(value, ts), '9')) GROUP BY rowkey, family, qualifier")
def _(s, d):
    return events_table(s, d).scan(filter="SingleColumnValueFilter('e', 'error', =, 'binaryprefix:9', true, true)").select("rowkey", "family", "qualifier", "ts")


@register("ttl_expiry", f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) AS n FROM ev) SELECT rowkey, family, qualifier, ts, value FROM n WHERE ts >= 700 OR n <= 1")
def _(s, d):
    t = Table(event_cells(s, d), {"e": FamilySpec(max_versions=EVENT_VERSIONS, min_versions=1, ttl=300)}, tombstones=False, ties=False)
    return t.scan(max_versions=None, now=1000).select(*VERSION)


@register("same_time_last_write", f"WITH {EV}, t AS (SELECT rowkey, family, qualifier, ts // 100 AS ts, ts AS seq, value FROM ev) SELECT rowkey, family, qualifier, ts, arg_max(value, seq) AS value FROM t GROUP BY rowkey, family, qualifier, ts")
def _(s, d):
    c = event_cells(s, d).withColumn("ts", F.floor(F.col("ts") / 100).cast("long"))
    return Table(c, tombstones=False).scan(max_versions=None).select(*VERSION)


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Events with tombstones made of some of them: by event type, a family, column or version marker."""
    c = event_cells(s, d)
    some = c.filter("ts % 37 = 0")
    kind = F.when(F.col("qualifier") == "click", 14).when(F.col("qualifier") == "view", 12).otherwise(8)
    return c.unionByName(some.withColumn("type", kind.cast("tinyint")).withColumn("value", F.lit(None).cast("string")))


MARKED = f"""{EV}, m AS (SELECT * FROM ev WHERE ts % 37 = 0),
    alive AS (SELECT * FROM ev e WHERE NOT EXISTS (SELECT * FROM m WHERE m.rowkey = e.rowkey AND m.qualifier = 'click' AND e.ts <= m.ts)
      AND NOT EXISTS (SELECT * FROM m WHERE m.rowkey = e.rowkey AND m.qualifier = e.qualifier AND m.qualifier = 'view' AND e.ts <= m.ts)
      AND NOT EXISTS (SELECT * FROM m WHERE m.rowkey = e.rowkey AND m.qualifier = e.qualifier AND m.qualifier NOT IN ('click', 'view') AND e.ts = m.ts))"""


@register("deletes_all_kinds", f"WITH {MARKED} SELECT rowkey, family, qualifier, ts, value FROM alive")
def _(s, d):
    return Table(_marked(s, d), ties=False).scan(max_versions=None).select(*VERSION)


@register("delete_latest", f"WITH {MARKED} SELECT rowkey, family, qualifier, max(ts) AS ts, arg_max(value, ts) AS value FROM alive GROUP BY rowkey, family, qualifier")
def _(s, d):
    return Table(_marked(s, d), ties=False).scan().select(*VERSION)


@register(
    "keep_deleted_time_travel",
    f"WITH {EV}, m AS (SELECT * FROM ev WHERE ts % 37 = 0 AND ts < 500), alive AS (SELECT * FROM ev e WHERE ts < 500 AND NOT EXISTS (SELECT * FROM m WHERE m.rowkey = e.rowkey AND m.qualifier = 'click' AND e.ts <= m.ts) AND NOT EXISTS (SELECT * FROM m WHERE m.rowkey = e.rowkey AND m.qualifier = e.qualifier AND m.qualifier = 'view' AND e.ts <= m.ts) AND NOT EXISTS (SELECT * FROM m WHERE m.rowkey = e.rowkey AND m.qualifier = e.qualifier AND m.qualifier NOT IN ('click', 'view') AND e.ts = m.ts)) SELECT rowkey, family, qualifier, ts, value FROM alive",
)
def _(s, d):
    t = Table(_marked(s, d), {"e": FamilySpec(max_versions=EVENT_VERSIONS, keep_deleted=True)}, ties=False)
    return t.scan(max_versions=None, time_max=500).select(*VERSION)


@register("raw_scan", f"WITH {EV} SELECT rowkey, qualifier, ts, 4 AS type FROM ev UNION ALL SELECT rowkey, qualifier, ts, CASE qualifier WHEN 'click' THEN 14 WHEN 'view' THEN 12 ELSE 8 END FROM ev WHERE ts % 37 = 0")
def _(s, d):
    return Table(_marked(s, d), ties=False).scan(raw=True, max_versions=None).select("rowkey", "qualifier", "ts", F.col("type").cast("int").alias("type"))


# ---- aggregates and jobs ------------------------------------------------------------------------

for _name in ("max", "min", "sum", "row_count", "avg", "std"):
    _sql = {
        "max": "max(v)", "min": "min(v)", "sum": "CAST(sum(v) AS BIGINT)", "row_count": "count(DISTINCT rowkey)",
        "avg": "round(sum(v) / count(DISTINCT rowkey), 4)", "std": "round(stddev_pop(v), 4)",
    }[_name]

    def _aggregate(s, d, name=_name):
        out = aggregate.aggregate(part_cells(s, d), "n", "p_size", measures=(name,))
        return out.withColumn(name, F.round(name, 4)) if name in ("avg", "std") else out

    register(f"agg_{_name}", f"WITH {PT} SELECT {_sql} AS \"{_name}\" FROM (SELECT rowkey, CAST(value AS BIGINT) AS v FROM pc WHERE qualifier = 'p_size')")(_aggregate)


@register("agg_family", f"WITH {PT}, r AS (SELECT rowkey, sum(CAST(value AS BIGINT)) AS v FROM pc WHERE family = 'n' GROUP BY rowkey) SELECT CAST(sum(v) AS BIGINT) AS \"sum\", round(avg(v), 4) AS \"avg\", round(stddev_pop(v), 4) AS \"std\", count(*) AS row_count FROM r")
def _(s, d):
    out = aggregate.aggregate(part_cells(s, d), "n")
    return out.select("sum", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"), "row_count")


@register("agg_key_range", f"WITH {PT} SELECT CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS \"sum\", count(*) AS row_count FROM pc WHERE qualifier = 'p_size' AND rowkey >= '00000020' AND rowkey < '00000090'")
def _(s, d):
    return aggregate.aggregate(part_cells(s, d), "n", "p_size", "00000020", "00000090").select("sum", "row_count")


@register("agg_decimal", "SELECT CAST(sum(round_even(CAST(o_totalprice AS DECIMAL(36,6)), 2)) AS DOUBLE) AS \"sum\", count(*) AS row_count FROM orders")
def _(s, d):
    c = cells.to_cells(orders(s, d).select(codec.integer_key(F.col("o_orderkey")).alias("k"), F.col("o_totalprice").cast("decimal(36,6)").alias("t")), TableSpec("k", {"f": ["t"]}))
    return aggregate.aggregate(c, "f", interpreter=aggregate.DECIMAL).select(F.col("sum").cast("double").alias("sum"), "row_count")


MEDIAN = "c AS (SELECT k, v, w, sum(w) OVER (ORDER BY k) AS run, sum(w) OVER () / 2 AS half, lag(v) OVER (ORDER BY k) AS prior FROM r) SELECT arg_min(prior, k) AS median FROM c WHERE run > half"


@register("median_half_sum", f"WITH r AS (SELECT p_partkey AS k, p_size AS v, CAST(p_size AS DOUBLE) AS w FROM part), {MEDIAN}")
def _(s, d):
    return aggregate.running_median(read_table(s, d, "part"), "p_partkey", "p_size")


@register("weighted_median", f"WITH r AS (SELECT p_partkey AS k, p_size AS v, CAST(round(p_retailprice) AS DOUBLE) AS w FROM part), {MEDIAN}")
def _(s, d):
    return aggregate.running_median(read_table(s, d, "part").withColumn("w", F.round("p_retailprice")), "p_partkey", "p_size", "w")


@register("true_median", "SELECT median(o_totalprice) AS median FROM orders")
def _(s, d):
    return aggregate.true_median(orders(s, d), "o_totalprice")


@register("row_counter", f"WITH {PT} SELECT count(DISTINCT rowkey) AS rows FROM pc WHERE qualifier = 'p_type' AND rowkey >= '00000010' AND rowkey < '00000180'")
def _(s, d):
    return jobs.row_counter(part_cells(s, d), ["d:p_type"], "00000010", "00000180")


@register(
    "cell_counter",
    f"""WITH {EV}, v AS (SELECT rowkey, family, qualifier, count(*) AS n FROM ev GROUP BY ALL), f AS (SELECT DISTINCT rowkey, family FROM v)
    SELECT 'Total ROWS' AS name, count(DISTINCT rowkey) AS n FROM v UNION ALL SELECT 'Total Families Across all Rows', count(*) FROM f
    UNION ALL SELECT 'Total Qualifiers across all Rows', count(*) FROM v UNION ALL SELECT family, count(*) FROM f GROUP BY family
    UNION ALL SELECT family || ':' || qualifier, count(*) FROM v GROUP BY family, qualifier UNION ALL SELECT rowkey || ':' || family || ':' || qualifier || '_Versions', n FROM v""",
)
def _(s, d):
    return jobs.cell_counter(event_cells(s, d))


@register("group_key", "SELECT o_orderstatus || ' ' || o_orderpriority AS group_key, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(s, d):
    rows = orders(s, d).withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("F")))
    return jobs.group_key(rows, ["o_orderstatus", "o_orderpriority"]).groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))


@register("endpoint_partial", f"WITH {PT} SELECT count(*) AS cells, CAST(sum(length(value)) AS BIGINT) AS chars FROM pc WHERE rowkey >= '00000020'")
def _(s, d):
    def partial(frames):
        for f in frames:
            yield f.assign(cells=1, chars=f["value"].str.len())[["cells", "chars"]]

    merge = lambda df: df.agg(F.sum("cells").alias("cells"), F.sum("chars").alias("chars"))
    return hooks.endpoint(part_cells(s, d), partial, "cells bigint, chars bigint", merge, start="00000020")


# ---- mutations ----------------------------------------------------------------------------------


def _latest(c: DataFrame) -> DataFrame:
    return versions.resolve(c).select("rowkey", "family", "qualifier", "value")


@register("put_batch", f"WITH {PT} SELECT rowkey, qualifier, CASE WHEN qualifier = 'p_size' AND rowkey < '00000100' THEN value || '0' ELSE value END AS value FROM pc")
def _(s, d):
    c = part_cells(s, d)
    edits = c.filter("qualifier = 'p_size' AND rowkey < '00000100'").select("rowkey", "family", "qualifier", F.lit(5).alias("ts"), F.concat("value", F.lit("0")).alias("value"))
    return _latest(mutations.apply(c, mutations.put(edits, 1))).select("rowkey", "qualifier", "value")


@register("delete_row", f"WITH {PT} SELECT rowkey, qualifier, value FROM pc WHERE rowkey NOT LIKE '%3'")
def _(s, d):
    c = part_cells(s, d)
    gone = c.filter("rowkey LIKE '%3'").select("rowkey").distinct().withColumn("ts", F.lit(9))
    return _latest(mutations.apply(c, mutations.delete_row(gone, ["d", "n"], 1))).select("rowkey", "qualifier", "value")


@register("put_under_delete", f"WITH {PT} SELECT rowkey, qualifier, value FROM pc WHERE qualifier <> 'p_name' OR rowkey >= '00000100'")
def _(s, d):
    c = part_cells(s, d)
    names = c.filter("qualifier = 'p_name' AND rowkey < '00000100'")
    marks = mutations.delete_column(names.select("rowkey", "family", "qualifier", F.lit(9).alias("ts")), 1)
    late = mutations.put(names.select("rowkey", "family", "qualifier", F.lit(7).alias("ts"), F.lit("late").alias("value")), 2)
    return _latest(mutations.apply(c, marks, late)).select("rowkey", "qualifier", "value")


@register("increment", "SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS rowkey, CAST(p_size + coalesce(n, 0) AS VARCHAR) AS value FROM part LEFT JOIN (SELECT l_partkey, sum(l_linenumber) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def _(s, d):
    c = part_cells(s, d).filter("qualifier = 'p_size'")
    amounts = read_table(s, d, "lineitem").select(codec.integer_key(F.col("l_partkey"), 8).alias("rowkey"), F.lit("n").alias("family"), F.lit("p_size").alias("qualifier"), F.col("l_linenumber").cast("long").alias("amount"))
    known = amounts.join(c.select("rowkey"), "rowkey", "left_semi")
    return _latest(mutations.increment(c, known, 9, 1)).select("rowkey", "value")


@register("append", "SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS rowkey, p_brand || coalesce(t, '') AS value FROM part LEFT JOIN (SELECT l_partkey, string_agg(l_returnflag, '' ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag) AS t FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def _(s, d):
    c = part_cells(s, d).filter("qualifier = 'p_brand'")
    pieces = read_table(s, d, "lineitem").select(
        codec.integer_key(F.col("l_partkey"), 8).alias("rowkey"), F.lit("d").alias("family"), F.lit("p_brand").alias("qualifier"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("n"), F.col("l_returnflag").alias("value"),
    )
    return _latest(mutations.append(c, pieces.join(c.select("rowkey"), "rowkey", "left_semi"), 9, 1)).select("rowkey", "value")


@register("check_and_put", f"WITH {PT} SELECT rowkey, qualifier, CASE WHEN qualifier = 'p_size' AND rowkey IN (SELECT rowkey FROM pt WHERE p_brand = 'Brand#4') THEN '0' ELSE value END AS value FROM pc")
def _(s, d):
    c = part_cells(s, d)
    rows = c.select("rowkey").distinct()
    checks = rows.select("rowkey", F.lit("d").alias("family"), F.lit("p_brand").alias("qualifier"), F.lit("Brand#4").alias("expected"))
    edits = mutations.put(rows.select("rowkey", F.lit("n").alias("family"), F.lit("p_size").alias("qualifier"), F.lit(9).alias("ts"), F.lit("0").alias("value")), 1)
    return _latest(mutations.check_and_mutate(c, checks, edits)).select("rowkey", "qualifier", "value")


@register("check_absent_and_delete", f"WITH {PT} SELECT rowkey, qualifier, value FROM pc WHERE NOT (qualifier = 'p_brand' AND rowkey IN (SELECT rowkey FROM pt WHERE p_type IS NULL))")
def _(s, d):
    c = part_cells(s, d)
    rows = c.select("rowkey").distinct()
    checks = rows.select("rowkey", F.lit("d").alias("family"), F.lit("p_type").alias("qualifier"), F.lit(None).cast("string").alias("expected"))
    edits = mutations.delete_column(rows.select("rowkey", F.lit("d").alias("family"), F.lit("p_brand").alias("qualifier"), F.lit(9).alias("ts")), 1)
    return _latest(mutations.check_and_mutate(c, checks, edits)).select("rowkey", "qualifier", "value")


@register("bulk_delete", f"WITH {PT} SELECT rowkey, qualifier, value FROM pc WHERE NOT (family = 'd' AND qualifier = 'p_name' AND value LIKE 'red%')")
def _(s, d):
    c = part_cells(s, d)
    out, _counts = mutations.bulk_delete(c, c.filter("qualifier = 'p_name' AND value LIKE 'red%'"), "column", 9, 1)
    return _latest(out).select("rowkey", "qualifier", "value")


@register("bulk_delete_counts", f"WITH {PT} SELECT count(DISTINCT rowkey) AS rows, count(*) AS versions FROM pc WHERE value LIKE 'red%'")
def _(s, d):
    c = part_cells(s, d)
    return mutations.bulk_delete(c, c.filter("value LIKE 'red%'"), "version", 9, 1)[1]


@register("major_compact", f"WITH {MARKED} SELECT rowkey, family, qualifier, ts, value FROM alive QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) <= 3")
def _(s, d):
    return mutations.major_compact(_marked(s, d)).select(*VERSION)


KEPT = f"""{EV}, m AS (SELECT * FROM ev WHERE ts % 37 = 0), k AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) <= 40)"""
SEEN = """NOT EXISTS (SELECT * FROM m WHERE m.ts < 500 AND m.rowkey = e.rowkey AND m.qualifier = 'click' AND e.ts <= m.ts)
    AND NOT EXISTS (SELECT * FROM m WHERE m.ts < 500 AND m.rowkey = e.rowkey AND m.qualifier = e.qualifier AND m.qualifier = 'view' AND e.ts <= m.ts)
    AND NOT EXISTS (SELECT * FROM m WHERE m.ts < 500 AND m.rowkey = e.rowkey AND m.qualifier = e.qualifier AND m.qualifier NOT IN ('click', 'view') AND e.ts = m.ts)"""


def _kept(s: SparkSession, d: str) -> Table:
    families = {"e": FamilySpec(max_versions=40, keep_deleted=True)}
    return Table(mutations.major_compact(_marked(s, d), families), families)


@register("compacted_time_travel", f"WITH {KEPT} SELECT rowkey, family, qualifier, ts, value FROM k e WHERE ts < 500 AND {SEEN}")
def _(s, d):
    """A read of a time before most deletions, after a compaction."""
    return _kept(s, d).scan(max_versions=None, time_max=500).select(*VERSION)


@register(
    "compacted_kept",
    f"""WITH {KEPT} SELECT rowkey, qualifier, ts, 4 AS type FROM k
    UNION ALL SELECT rowkey, qualifier, ts, CASE qualifier WHEN 'click' THEN 14 WHEN 'view' THEN 12 ELSE 8 END FROM m
    WHERE CASE qualifier WHEN 'click' THEN EXISTS (SELECT * FROM k WHERE k.rowkey = m.rowkey AND k.ts <= m.ts)
      WHEN 'view' THEN EXISTS (SELECT * FROM k WHERE k.rowkey = m.rowkey AND k.qualifier = m.qualifier AND k.ts <= m.ts)
      ELSE EXISTS (SELECT * FROM k WHERE k.rowkey = m.rowkey AND k.qualifier = m.qualifier AND k.ts = m.ts) END""",
)
def _(s, d):
    """All that a compaction leaves where deleted cells are kept: versions, and the tombstones that mask one of them."""
    return _kept(s, d).cells.select("rowkey", "qualifier", "ts", F.col("type").cast("int").alias("type"))


@register("constraints", f"WITH {PT} SELECT rowkey, qualifier, 'small' AS broken FROM pc WHERE family = 'n' AND qualifier = 'p_size' AND CAST(value AS BIGINT) > 40")
def _(s, d):
    rule = hooks.Constraint("small", (F.col("qualifier") != "p_size") | (F.col("value").try_cast("bigint") <= 40), "n")
    return hooks.split_by_constraints(part_cells(s, d), [rule])[1].select("rowkey", "qualifier", "broken")


@register("observed_table", f"WITH {PT} SELECT rowkey, qualifier, upper(value) AS value FROM pc WHERE family = 'd' AND rowkey < '00000020'")
def _(s, d):
    t = hooks.ObservedTable(parts_table(s, d))
    t.on("pre_scan", lambda c: c.filter("rowkey < '00000020'"))
    t.on("post_scan", lambda c: c.withColumn("value", F.upper("value")))
    return t.scan(columns=("d",)).select("rowkey", "qualifier", "value")


# ---- indexes ------------------------------------------------------------------------------------


def _index(s: SparkSession, d: str, column: str, kind: str = "secondary", include: tuple[str, ...] = ()) -> tuple[indexes.IndexSpec, store.KeyedFiles]:
    spec = indexes.IndexSpec(column, kind, include)
    return spec, indexes.stored_index(s, f"{d}/orders.parquet", spec, "o_orderkey")


def _hits(s: SparkSession, d: str, conjunct: list[ranges.Range]) -> dict[str, DataFrame]:
    """For each range the part of its stored index that can hold it."""
    return {r.column: indexes.of_conjunct(_index(s, d, r.column)[1], [r]) for r in conjunct}


@register("index_intersect", f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE {_bench_sql(2).replace(' AND o_orderdate >= TIMESTAMP ' + chr(39) + '1997-03-10 00:00:00' + chr(39), '')}")
def _(s, d):
    conjunct = [ranges.between("o_totalprice", 20000.0, 45000.0), ranges.where("o_orderpriority", "=", "3-MEDIUM")]
    return indexes.intersect_lookup(orders(s, d), _hits(s, d, conjunct), conjunct, "o_orderkey").select(*ORDER_COLUMNS)


@register("index_union", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 470000 OR o_custkey < 40")
def _(s, d):
    either = [ranges.where("o_totalprice", ">", 470000.0), ranges.where("o_custkey", "<", 40)]
    return indexes.union_lookup(orders(s, d), _hits(s, d, either), either, "o_orderkey").select(*ORDER_COLUMNS)


@register("index_covering", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def _(s, d):
    spec, files = _index(s, d, "o_totalprice", "covering", ("o_orderpriority",))
    conjunct = [ranges.between("o_totalprice", 100000.0, 120000.0)]
    return indexes.lookup(orders(s, d), indexes.of_conjunct(files, conjunct), spec, conjunct, "o_orderkey", ORDER_COLUMNS)


@register("index_semi_join", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_custkey >= 500")
def _(s, d):
    spec, files = _index(s, d, "o_totalprice")
    conjunct = [ranges.between("o_totalprice", 100000.0, 120000.0), ranges.where("o_custkey", ">=", 500)]
    return indexes.lookup(orders(s, d), indexes.of_conjunct(files, conjunct), spec, conjunct, "o_orderkey", ["o_orderkey", "o_totalprice", "o_custkey"])


@register("index_clustered", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 20000 AND 45000")
def _(s, d):
    spec, files = _index(s, d, "o_totalprice", "clustered")
    conjunct = [ranges.between("o_totalprice", 20000.0, 45000.0)]
    return indexes.lookup(orders(s, d), indexes.of_conjunct(files, conjunct), spec, conjunct, "o_orderkey", ORDER_COLUMNS)


@register("index_chosen", f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE {_bench_sql(4)}")
def _(s, d):
    base = orders(s, d)
    catalog = indexes.IndexCatalog("o_orderkey", tuple(base.columns))
    catalog.add(indexes.IndexSpec("o_totalprice", "clustered"))
    catalog.add(indexes.IndexSpec("o_orderpriority"))
    catalog.statistics["o_totalprice"] = indexes.histogram(base, "o_totalprice", 0.0, 600000.0, 100)
    conjunct = _bench_ranges(4)
    built = {c: indexes.of_conjunct(_index(s, d, c, spec.kind)[1], conjunct) for c, spec in catalog.specs.items()}
    return catalog.query(base, built, [conjunct], ORDER_COLUMNS)


def _broken_index(base: DataFrame) -> DataFrame:
    """An index without some rows, with some wrong values and some rows that are no more."""
    wrong = F.when(F.col("o_orderkey") % 50 == 1, -1.0).otherwise(F.col("o_totalprice"))
    return base.filter("o_orderkey % 50 <> 0").withColumn("o_totalprice", wrong).unionByName(base.filter("o_orderkey % 50 = 2").withColumn("o_orderkey", -F.col("o_orderkey")))


@register("index_repaired", "SELECT o_totalprice, o_orderkey FROM orders")
def _(s, d):
    base = orders(s, d).select("o_totalprice", "o_orderkey")
    return indexes.repair(base, _broken_index(base), indexes.IndexSpec("o_totalprice"), "o_orderkey")


@register("index_cleared", "SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 50 > 1")
def _(s, d):
    base = orders(s, d).select("o_totalprice", "o_orderkey")
    return indexes.clear(base, _broken_index(base), indexes.IndexSpec("o_totalprice"), "o_orderkey")


@register("index_consistency", "SELECT o_orderkey, 'o_custkey' AS \"column\", CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
def _(s, d):
    return indexes.consistency(orders(s, d), [indexes.IndexSpec("o_custkey"), indexes.IndexSpec("o_orderpriority")], "o_orderkey")


@register("index_check", "SELECT o_orderkey, 'missing' AS state FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey, 'stale' FROM orders WHERE o_orderkey % 50 = 1")
def _(s, d):
    base = orders(s, d).select("o_orderkey", "o_totalprice")
    index = base.filter("o_orderkey % 50 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 1, -1.0).otherwise(F.col("o_totalprice")))
    stale, missing = indexes.split_stale(base, index, indexes.IndexSpec("o_totalprice"), "o_orderkey")
    gone = missing.join(index.select("o_orderkey"), "o_orderkey", "left_anti")
    return gone.select("o_orderkey", F.lit("missing").alias("state")).unionByName(stale.select("o_orderkey", F.lit("stale").alias("state")))


@register("histogram_buckets", "SELECT greatest(1, least(100, CAST(floor(o_totalprice / 6000.0) AS BIGINT) + 1)) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return indexes.histogram_rows(orders(s, d), "o_totalprice", 0.0, 600000.0, 100)


@register(
    "histogram_estimate",
    """WITH r AS (SELECT greatest(1, least(100, CAST(floor(o_totalprice / 5000.0) AS BIGINT) + 1)) AS b, o_totalprice AS v FROM orders), h AS (SELECT b, count(*) AS n FROM r GROUP BY b),
    e AS (SELECT h.b, n, CASE WHEN h.b = 1 THEN least(0.0, (SELECT min(v) FROM r)) ELSE (h.b - 1) * 5000.0 END AS lo, CASE WHEN h.b = 100 THEN greatest(500000.0, (SELECT max(v) FROM r)) ELSE h.b * 5000.0 END AS hi FROM h)
    SELECT name, CAST(round(sum(n * greatest(0.0, least(hi, y) - greatest(lo, x)) / (hi - lo))) AS BIGINT) AS estimate
    FROM e, (VALUES ('inside', 61234.5, 118765.25), ('one bucket', 20100.0, 20200.0), ('beyond the end', 499000.0, 9000000.0), ('nothing', -50.0, -20.0)) AS q(name, x, y) GROUP BY name""",
)
def _(s, d):
    """Ranges that begin and end inside buckets, and beyond the last one."""
    h = indexes.histogram(orders(s, d), "o_totalprice", 0.0, 500000.0, 100)
    asked = {"inside": (61234.5, 118765.25), "one bucket": (20100.0, 20200.0), "beyond the end": (499000.0, 9000000.0), "nothing": (-50.0, -20.0)}
    rows = [(name, int(h.estimate(ranges.Range("o_totalprice", ((">=", x), ("<=", y)))) + 0.5)) for name, (x, y) in asked.items()]
    return s.createDataFrame(rows, "name string, estimate bigint")


@register(
    "histogram_equality",
    "WITH h AS (SELECT p_size // 10 AS b, count(*) AS n, count(DISTINCT p_size) AS v FROM part WHERE p_size < 50 GROUP BY 1) SELECT b * 10 + 5 AS size, CAST(round(n * 100 / v) AS BIGINT) AS hundredths FROM h UNION ALL SELECT 777, 0",
)
def _(s, d):
    """One value is expected to have its bucket's rows by the bucket's distinct values, a value beyond all none."""
    h = indexes.histogram(read_table(s, d, "part").filter("p_size < 50"), "p_size", 0.0, 50.0, 5)
    rows = [(v, int(100 * h.estimate(ranges.where("p_size", "=", v)) + 0.5)) for v in (5, 15, 25, 35, 45, 777)]
    return s.createDataFrame(rows, "size int, hundredths bigint")


@register("histogram_merged", "SELECT greatest(1, least(20, CAST(floor(o_totalprice / 30000.0) AS BIGINT) + 1)) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    """Statistics of two halves of a table, merged."""
    halves = [indexes.histogram(orders(s, d).filter(f"o_orderkey % 2 = {k}"), "o_totalprice", 0.0, 600000.0, 20) for k in (0, 1)]
    merged = halves[0].merge(halves[1])
    return s.createDataFrame([(i, n) for i, n in enumerate(merged.counts, 1) if n], "bucket bigint, n bigint")


@register("set_statistics", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1")
def _(s, d):
    h = indexes.value_counts(orders(s, d), "o_orderpriority", ["1-URGENT", "3-MEDIUM"])
    return s.createDataFrame(list(zip(h.values, h.counts, strict=True)), "value string, n bigint")


# ---- transfer -----------------------------------------------------------------------------------


@register(
    "import_delimited",
    "SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS rowkey, CAST(n_regionkey + 10 AS BIGINT) AS ts, n_name AS value FROM nation WHERE n_nationkey % 5 <> 0",
)
def _(s, d):
    n = read_table(s, d, "nation")
    key = codec.integer_key(F.col("n_nationkey"), 4)
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(key, F.lit("|x|"), "n_name")).otherwise(F.concat_ws("|", key, (F.col("n_regionkey") + 10).cast("string"), "n_name"))
    good, _bad = delimited.cells_of_lines(n.select(line.alias("value")), delimited.DelimitedSpec.of("ROW_KEY,TS_KEY,f:name", "|"), 0)
    return good.select("rowkey", "ts", "value")


@register("import_delimited_bad", "SELECT 'Invalid timestamp' AS reason, count(*) AS n FROM nation WHERE n_nationkey % 5 = 0")
def _(s, d):
    n = read_table(s, d, "nation")
    key = codec.integer_key(F.col("n_nationkey"), 4)
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(key, F.lit("|x|"), "n_name")).otherwise(F.concat_ws("|", key, (F.col("n_regionkey") + 10).cast("string"), "n_name"))
    _good, bad = delimited.cells_of_lines(n.select(line.alias("value")), delimited.DelimitedSpec.of("ROW_KEY,TS_KEY,f:name", "|"), 0)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("export_pattern", f"WITH {EV} SELECT rowkey, family, qualifier, ts, value FROM ev WHERE ts >= 100 AND ts < 900 AND regexp_matches(rowkey, '[02468]$') QUALIFY row_number() OVER (PARTITION BY rowkey, qualifier ORDER BY ts DESC) <= 2")
def _(s, d):
    return transfer.export_cells(events_table(s, d), 2, 100, 900, "^[02468]$").select(*VERSION)


@register("copy_table", f"WITH {PT} SELECT rowkey, 'numbers' AS family, qualifier, value FROM pc WHERE family = 'n' AND rowkey >= '00000010' AND rowkey < '00000060'")
def _(s, d):
    return transfer.copy_table(parts_table(s, d), "00000010", "00000060", families=("n:numbers",)).select(*CELL)


@register("replay_log", f"WITH {EV} SELECT 'copy' AS \"table\", rowkey, qualifier, ts FROM ev WHERE ts BETWEEN 100 AND 300 AND ts % 2 = 0")
def _(s, d):
    log = event_cells(s, d).withColumn("table", F.when(F.col("ts") % 2 == 0, "a").otherwise("b")).withColumn("written", F.col("ts"))
    return transfer.replay(log, {"a": "copy"}, 100, 300).select("table", "rowkey", "qualifier", "ts")


@register("sorted_cells", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc")
def _(s, d):
    return cells.sorted_for_files(part_cells(s, d)).select(*CELL)


# ---- functions ----------------------------------------------------------------------------------


@register("codecs", "SELECT o_orderkey, o_custkey AS back, lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS k, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS day, starts_with(o_orderpriority, '1') AS urgent FROM orders")
def _(s, d):
    o = orders(s, d)
    return o.select(
        "o_orderkey",
        codec.decode_integer(codec.encode_integer(F.col("o_custkey"))).alias("back"),
        codec.integer_key(F.col("o_custkey")).alias("k"),
        codec.compact_date(F.col("o_orderdate")).alias("day"),
        codec.starts_with(F.col("o_orderpriority"), F.lit("1")).alias("urgent"),
    )


# ---- range queries on cells, index maintenance, streams ------------------------------------------


@register("range_cells_dnf", f"WITH {PT} SELECT rowkey, family, qualifier, value FROM pc WHERE rowkey IN (SELECT rowkey FROM pt WHERE (p_brand >= 'Brand#2' AND p_brand < 'Brand#4' AND p_type = 'PROMO') OR p_name = 'red widget')")
def _(s, d):
    r, c = ranges.Range, cell_ranges.CellRange
    dnf = [[c("d", r("p_brand", ((">=", "Brand#2"), ("<", "Brand#4")))), c("d", r("p_type", (("=", "PROMO"),)))], [c("d", r("p_name", (("=", "red widget"),)))]]
    return cell_ranges.range_scan(parts_table(s, d), dnf).select(*CELL)


@register("range_cells_time", f"WITH {EV}, c AS (SELECT * FROM ev WHERE qualifier <> 'click' OR ts BETWEEN 100 AND 600) SELECT rowkey, family, qualifier, max(ts) AS ts FROM c WHERE rowkey IN (SELECT rowkey FROM c WHERE qualifier = 'click' GROUP BY rowkey HAVING arg_max(value, ts) >= '5') GROUP BY rowkey, family, qualifier")
def _(s, d):
    r = cell_ranges.CellRange("e", ranges.Range("click", ((">=", "5"),)), 100, 600)
    return cell_ranges.range_scan(events_table(s, d), [[r]]).select("rowkey", "family", "qualifier", "ts")


@register("index_maintained", "SELECT CASE WHEN o_orderkey % 20 = 1 THEN 7.5 ELSE o_totalprice END AS o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 20 <> 2")
def _(s, d):
    base = orders(s, d)
    spec = indexes.IndexSpec("o_totalprice")
    changed = base.filter("o_orderkey % 20 = 1").withColumn("o_totalprice", F.lit(7.5))
    return indexes.maintain(indexes.build(base, spec, "o_orderkey"), changed, base.filter("o_orderkey % 20 = 2"), spec, "o_orderkey")


@register("stream_latest", f"WITH {EV} SELECT rowkey, family, qualifier, max(ts) AS ts, arg_max(value, ts) AS value FROM ev GROUP BY rowkey, family, qualifier")
def _(s, d):
    schema = read_table(s, d, "events").schema
    source = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    value = F.round(F.col("value") * 100).cast("long").cast("string")
    stream = cells.as_cells(source, codec.integer_key(F.col("user_id"), 8), F.lit("e"), F.col("event_type"), F.col("event_id"), value)
    root = f"{store.shared_folder(s)}/stream-{uuid.uuid4().hex}"
    edits.latest_to_files(stream, f"{root}/latest", f"{root}/marks").awaitTermination()
    return edits.read_latest(s, f"{root}/latest").select(*VERSION)
