"""Goldens for cells, filters, versions, aggregates, mutations, catalog and sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellarium.functions import codec
from cellarium.functions.comparators import Binary, Bit, Null, Op
from cellarium.operators import aggregate, cells, hooks, indexes, jobs, mutations, ranges, scan
from cellarium.operators.catalog import Catalog
from cellarium.operators.cells import FamilySpec
from cellarium.operators.scan import ScanSpec, Table
from cellarium.plans import filters as A
from cellarium.sources import delimited, records, store, transfer
from cellarium.streaming import edits

SCHEMA = "rowkey string, family string, qualifier string, ts long, type tinyint, value string, seq long"


def make(spark, rows):
    return spark.createDataFrame([(r, f, q, ts, kind, v, i) for i, (r, f, q, ts, kind, v) in enumerate(rows)], SCHEMA)


def _plants():
    """A garden's notebook: uneven rows, several versions, empty and non-ASCII values, a wide row, and all kinds of markers."""
    puts = [
        ("ash", "look", "bark", 3, "grey"), ("ash", "look", "bark", 8, "silver"), ("ash", "look", "leaf", 4, "pinnate"), ("ash", "size", "m", 4, "31"),
        ("birch", "look", "bark", 5, "white"), ("birch", "size", "m", 2, "19"), ("birch", "size", "m", 9, "22"), ("birch", "note", "älter", 6, "schön"),
        ("cedar", "look", "bark", 1, ""), ("cedar", "size", "m", 7, "40"), ("cedar", "note", "who", 7, "Grüße 木"),
        ("dill", "size", "cm", 5, "90"), ("elm", "look", "leaf", 2, "serrate"), ("elm", "look", "leaf", 6, "SERRATE"), ("elm", "note", "who", 3, "x"),
        *[("fern", "look", f"frond{k:02d}", 1 + k % 4, f"green{k % 3}") for k in range(12)], ("fern/2", "size", "cm", 5, "31"), ("gorse", "look", "leaf", 9, "thorn"),
    ]
    marks = [("ash", "look", "bark", 3, 8), ("birch", "size", "m", 9, 8), ("dill", "size", None, 9, 14), ("elm", "look", "leaf", 4, 12), ("gorse", "look", "leaf", 8, 12), ("fern", "look", "frond00", 9, 12)]
    return puts, marks


@pytest.fixture(scope="module")
def corpus(spark):
    puts, marks = _plants()
    return Table(make(spark, [(r, f, q, ts, 4, v) for r, f, q, ts, v in puts] + [(r, f, q, ts, kind, None) for r, f, q, ts, kind in marks]))


def alive():
    """The cells that no marker masks, by a plain loop over the notebook."""
    puts, marks = _plants()
    masks = {
        14: lambda m, c: m[:2] == c[:2] and c[3] <= m[3],
        12: lambda m, c: m[:3] == c[:3] and c[3] <= m[3],
        8: lambda m, c: m[:4] == c[:4],
    }
    return [c for c in puts if not any(masks[m[4]](m, c) for m in marks)]


def newest(cells):
    """The newest of each column."""
    best = {}
    for c in sorted(cells, key=lambda c: c[3]):
        best[c[:3]] = c
    return sorted(best.values())


def row_with(cells, test):
    return {c[0] for c in cells if test(c)}


ROW, FAMILY, QUALIFIER, TS, VALUE = range(5)
BY_FILTER = {
    None: lambda c: newest(c),
    "PrefixFilter('fern')": lambda c: newest([x for x in c if x[ROW].startswith("fern")]),
    "PageFilter(2)": lambda c: [x for x in newest(c) if x[ROW] in sorted({y[ROW] for y in c})[:2]],
    "InclusiveStopFilter('cedar')": lambda c: newest([x for x in c if x[ROW] <= "cedar"]),
    "QualifierFilter(<, 'binary:frond03')": lambda c: newest([x for x in c if x[QUALIFIER] < "frond03"]),
    "QualifierFilter(!=, 'binary:bark')": lambda c: newest([x for x in c if x[QUALIFIER] != "bark"]),
    "FamilyFilter(=, 'binary:note')": lambda c: newest([x for x in c if x[FAMILY] == "note"]),
    "FamilyFilter(>, 'binary:size')": lambda c: [],
    "RowFilter(=, 'regexstring:^.{3}$')": lambda c: newest([x for x in c if len(x[ROW]) == 3]),
    "ValueFilter(=, 'substring:SERR')": lambda c: newest([x for x in c if "serr" in x[VALUE].lower()]),
    "ValueFilter(=, 'binary:')": lambda c: newest([x for x in c if x[VALUE] == ""]),
    "ValueFilter(>=, 'binary:schön')": lambda c: newest([x for x in c if x[VALUE].encode() >= "schön".encode()]),
    "SKIP ValueFilter(!=, 'binary:x')": lambda c: newest([x for x in c if x[ROW] not in row_with(c, lambda y: y[VALUE] == "x")]),
    "WHILE RowFilter(!=, 'binary:elm')": lambda c: newest([x for x in c if x[ROW] < "elm"]),
    "WHILE QualifierFilter(!=, 'binary:m')": lambda c: [x for x in newest(c) if x[:3] < min(y for y in newest(c) if y[QUALIFIER] == "m")[:3]],
    "FirstKeyOnlyFilter()": lambda c: [min(x for x in newest(c) if x[ROW] == r) for r in sorted({x[ROW] for x in c})],
    "ColumnPaginationFilter(3, 2)": lambda c: [x for r in sorted({x[ROW] for x in c}) for x in [y for y in newest(c) if y[ROW] == r][2:5]],
    "ColumnCountGetFilter(2)": lambda c: [x for r in sorted({x[ROW] for x in c}) for x in [y for y in newest(c) if y[ROW] == r][:2]],
    "FamilyFilter(=, 'binary:look') AND ColumnPaginationFilter(1, 1)": lambda c: [x for r in sorted({x[ROW] for x in c}) for x in [y for y in newest(c) if y[ROW] == r and y[FAMILY] == "look"][1:2]],
    "PrefixFilter('b') OR ValueFilter(=, 'binary:31')": lambda c: newest([x for x in c if x[ROW].startswith("b") or x[VALUE] == "31"]),
    "PageFilter(3) AND PrefixFilter('c')": lambda c: newest([x for x in c if x[ROW] == "cedar"]),
    "PrefixFilter('fern') AND PageFilter(1)": lambda c: newest([x for x in c if x[ROW] == "fern"]),
    "SingleColumnValueFilter('size', 'm', >, 'binary:20')": lambda c: newest([x for x in c if x[ROW] in row_with(newest(c), lambda y: y[1:3] == ("size", "m") and y[VALUE] > "20") or x[ROW] not in row_with(c, lambda y: y[1:3] == ("size", "m"))]),
    "SingleColumnValueFilter('size', 'm', >, 'binary:20', true, true)": lambda c: newest([x for x in c if x[ROW] in row_with(newest(c), lambda y: y[1:3] == ("size", "m") and y[VALUE] > "20")]),
    "SingleColumnValueExcludeFilter('look', 'leaf', !=, 'binary:thorn', true, true)": lambda c: newest([x for x in c if x[ROW] in row_with(newest(c), lambda y: y[QUALIFIER] == "leaf" and y[VALUE] != "thorn") and x[QUALIFIER] != "leaf"]),
}


@pytest.mark.parametrize("f", BY_FILTER)
def test_corpus(corpus, f):
    got = sorted((r.rowkey, r.family, r.qualifier, r.ts, r.value) for r in corpus.scan(filter=f).collect())
    assert got == sorted(BY_FILTER[f](alive()))


def test_key_only(corpus):
    assert {r.value for r in corpus.scan(filter="KeyOnlyFilter()").collect()} == {""}
    assert {r.value for r in corpus.scan(filter="KeyOnlyFilter(true)").collect()} == {str(len(c[VALUE].encode())) for c in newest(alive())}


def test_fuzzy_and_random_rows(corpus):
    f = A.FuzzyRowFilter((("?e?", (1, 0, 1)), ("e??", (0, 1, 1))))
    assert {r.rowkey for r in corpus.scan(filter=f).collect()} == {"cedar", "elm", "fern", "fern/2"}
    rows = {c[ROW] for c in alive()}
    assert {r.rowkey for r in corpus.scan(filter=A.RandomRowFilter(2.0)).collect()} == rows
    assert corpus.scan(filter=A.RandomRowFilter(-1.0)).count() == 0


def test_cursor(corpus):
    want = [c[:3] for c in newest(alive())]
    for size in (1, 2, 5, 50):
        pages = list(corpus.cursor(size))
        assert [(r.rowkey, r.family, r.qualifier) for p in pages for r in p] == want
        assert all(len({r.rowkey for r in p}) <= size for p in pages)


def test_null_and_bit_comparators(spark):
    df = spark.createDataFrame([(1, None, "ab"), (2, 6, "a"), (3, 1, None)], "id int, n int, s string")
    keep = lambda c: sorted(r.id for r in df.filter(c).collect())
    assert keep(Null().test(Op.EQUAL, F.col("n"))) == [1]
    assert keep(Bit(2, "AND").test(Op.EQUAL, F.col("n"))) == [2]
    assert keep(Bit("a", "XOR").test(Op.EQUAL, F.col("s"))) == []
    assert keep(Bit("c", "XOR").test(Op.EQUAL, F.col("s"))) == [2]
    assert keep(Bit("ab", "OR").test(Op.EQUAL, F.col("s"))) == [1]
    with pytest.raises(ValueError):
        Null().test(Op.LESS, F.col("n"))


def test_scan_rules(corpus):
    with pytest.raises(ValueError):
        ScanSpec(raw=True, columns=("f",))
    with pytest.raises(ValueError):
        ScanSpec(batch=2, filter=A.PageFilter(1))
    assert corpus.exists("elm") and not corpus.exists("dill")
    assert corpus.count(start="cedar") == len({c[ROW] for c in alive() if c[ROW] >= "cedar"})
    assert {r.rowkey for r in corpus.row_or_before("dillweed", "size").collect()} == {"cedar"}
    assert corpus.scan(timestamp=5, max_versions=None).count() == sum(c[TS] == 5 for c in alive())
    assert corpus.scan(limit=3).select("rowkey").distinct().count() == 3


def test_compaction_keeps_deleted_cells(spark, corpus):
    """Reads of any time see after a compaction what they saw before, and a second one changes nothing."""
    families = {f: FamilySpec(50, keep_deleted=True) for f in ("look", "size")}
    before, after = Table(corpus.cells, families), Table(mutations.major_compact(corpus.cells, families), families)
    see = lambda t, **o: sorted((r.rowkey, r.family, r.qualifier, r.ts, r.value) for r in t.scan(max_versions=None, **o).collect())
    for end in range(1, 11):
        assert see(after, time_max=end, columns=("look", "size")) == see(before, time_max=end, columns=("look", "size"))
    assert see(after, time_max=6) != see(after)
    # A tombstone of nothing goes: gorse's is older than its only leaf.
    kinds = {(r.rowkey, r.type) for r in after.cells.filter("type <> 4").collect()}
    assert kinds == {("ash", 8), ("birch", 8), ("dill", 14), ("elm", 12), ("fern", 12)}
    again = mutations.major_compact(after.cells, families)
    assert sorted(map(str, again.collect())) == sorted(map(str, after.cells.collect()))
    few = mutations.major_compact(corpus.cells, {"look": FamilySpec(1, keep_deleted=True)})
    assert few.filter("rowkey = 'elm' AND qualifier = 'leaf'").count() == 1


def test_versions_and_markers(spark):
    rows = [("r", "f", "q", t, 4, f"v{t}") for t in range(1, 6)] + [("r", "f", None, 4, 14, None), ("r", "f", "q", 3, 12, None), ("r", "f", "q", 2, 4, "late")]
    t = Table(make(spark, rows))
    see = lambda **o: [(r.ts, r.value) for r in t.scan(max_versions=None, **o).orderBy("ts", "type").collect()]
    assert see() == [(5, "v5")]
    # A marker newer than the range still hides what is older, unless deleted cells are kept.
    assert see(time_max=3) == []
    kept = Table(t.cells, {"f": FamilySpec(5, keep_deleted=True)})
    assert [(r.ts, r.value) for r in kept.scan(max_versions=None, time_max=3).orderBy("ts").collect()] == [(1, "v1"), (2, "late")]
    assert len(see(raw=True)) == 8
    version = Table(make(spark, [("r", "f", "q", t, 4, f"v{t}") for t in (1, 2, 3)] + [("r", "f", "q", 2, 8, None)]))
    assert [r.ts for r in version.scan(max_versions=2).orderBy("ts").collect()] == [1, 3]


def test_life_time_with_least_versions(spark):
    rows = [("r", "f", "q", t, 4, str(t)) for t in (10, 20, 30)] + [("s", "f", "q", 5, 4, "5")]
    t = Table(make(spark, rows), {"f": FamilySpec(max_versions=9, min_versions=1, ttl=15)})
    assert sorted((r.rowkey, r.ts) for r in t.scan(max_versions=None, now=40).collect()) == [("r", 30), ("s", 5)]
    assert t.scan(max_versions=None).count() == 4


def test_dependent_column(spark):
    rows = [("a", "f", "ref", 1, 4, "x"), ("a", "f", "p", 1, 4, "1"), ("a", "f", "p", 2, 4, "2"), ("a", "f", "ref", 3, 4, "bad"), ("a", "f", "p", 3, 4, "3"), ("b", "f", "p", 1, 4, "4")]
    t = Table(make(spark, rows))
    see = lambda f: sorted((r.rowkey, r.qualifier, r.ts) for r in t.scan(filter=f, max_versions=None).collect())
    assert see(A.DependentColumnFilter("f", "ref")) == [("a", "p", 1), ("a", "p", 3), ("a", "ref", 1), ("a", "ref", 3)]
    assert see(A.DependentColumnFilter("f", "ref", True, Op.EQUAL, Binary("x"))) == [("a", "p", 1)]


@pytest.fixture(scope="module")
def numbers(spark):
    rows = []
    for i in range(20):
        rows += [(f"row{i:02d}", "f", "q", 1, 4, str(i)), (f"row{i:02d}", "f", f"m{i}", 1, 4, str(10 * i))]
    return make(spark, rows)


def test_aggregates(numbers):
    one = lambda *a, **k: aggregate.aggregate(numbers, "f", *a, **k).first()
    q = one("q")
    assert (q["max"], q["min"], q["sum"], q["row_count"], q["avg"]) == (19, 0, 190, 20, 9.5)
    assert abs(q["std"] - 5.766) < 0.05
    assert one("q", "row05", "row15")["sum"] == 95
    assert one("q", "row02", "row14")["row_count"] == 12
    whole = one()
    assert (whole["max"], whole["sum"], whole["avg"]) == (190, 2090, 104.5)
    assert one(None, "row06", "row07")["sum"] == 66
    assert one("none")["max"] is None
    with pytest.raises(ValueError):
        one("q", "row05", "row05")


def test_decimal_aggregates(spark):
    rows = [(f"r{i:02d}", "f", q, 1, 4, v) for i in range(20) for q, v in (("q", f"{i}.00"), (f"m{i}", f"{i / 10:.2f}"))]
    out = aggregate.aggregate(make(spark, rows), "f", interpreter=aggregate.DECIMAL).first()
    assert float(out["sum"]) == 209.0 and abs(out["avg"] - 10.45) < 1e-9 and abs(out["std"] - 6.342) < 0.01


def test_medians(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "k int, v int")
    for parts in (1, 3, 20):
        assert aggregate.running_median(df, "k", "v", parts=parts).first()["median"] == 13
    weighted = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, 30, 8)], "k int, v int, w int")
    assert aggregate.running_median(weighted, "k", "v", "w").first()["median"] == 20


def test_jobs(numbers):
    assert jobs.row_counter(numbers, start="row03").first()["rows"] == 17
    counted = {r.name: r.n for r in jobs.cell_counter(numbers).collect()}
    assert (counted["Total ROWS"], counted["Total Families Across all Rows"], counted["Total Qualifiers across all Rows"], counted["f"], counted["f:q"], counted["row03:f:m3_Versions"]) == (20, 20, 40, 20, 20, 1)
    doubled = jobs.map_rows(numbers.select("rowkey"), lambda frames: (f.assign(rowkey=f.rowkey + "!") for f in frames), "rowkey string")
    assert doubled.first()["rowkey"].endswith("!")


def test_mutations(spark):
    base = make(spark, [("a", "f", "n", 1, 4, "5"), ("b", "f", "n", 1, 4, "x"), ("c", "f", "s", 1, 4, "ab")])
    amounts = spark.createDataFrame([("a", "f", "n", 2), ("a", "f", "n", 3), ("z", "f", "n", 7)], "rowkey string, family string, qualifier string, amount long")
    out = {r.rowkey: r.value for r in mutations.newest(mutations.increment(base, amounts, 2, 9)).collect()}
    assert (out["a"], out["z"]) == ("10", "7")
    bad = spark.createDataFrame([("b", "f", "n", 1)], "rowkey string, family string, qualifier string, amount long")
    with pytest.raises(Exception, match="not a number"):
        mutations.increment(base, bad, 2, 9).collect()
    pieces = spark.createDataFrame([("c", "f", "s", "d", 2), ("c", "f", "s", "c", 1), ("q", "f", "s", "new", 1)], "rowkey string, family string, qualifier string, value string, n int")
    out = {r.rowkey: r.value for r in mutations.newest(mutations.append(base, pieces, 2, 9)).collect()}
    assert (out["c"], out["q"]) == ("abcd", "new")
    checks = spark.createDataFrame([("a", "f", "n", "5"), ("b", "f", "n", "5"), ("new", "f", "n", "")], "rowkey string, family string, qualifier string, expected string")
    edit = mutations.put(checks.select("rowkey", "family", "qualifier", F.lit(3).alias("ts"), F.lit("done").alias("value")), 9)
    out = {r.rowkey: r.value for r in mutations.newest(mutations.check_and_mutate(base, checks, edit)).collect()}
    assert (out["a"], out["b"], out["new"]) == ("done", "x", "done")
    for what, left in (("row", 2), ("family", 2), ("column", 2), ("version", 2)):
        deleted, counts = mutations.bulk_delete(base, base.filter("rowkey = 'a'"), what, 5, 9)
        assert mutations.newest(deleted).count() == left and counts.first()["rows"] == 1
    with pytest.raises(ValueError):
        mutations.bulk_delete(base, base, "table", 1, 1)


def test_compaction_is_what_a_read_sees(corpus):
    compacted = mutations.major_compact(corpus.cells)
    assert compacted.filter("type <> 4").count() == 0
    assert Table(compacted, tombstones=False).scan().count() == corpus.scan().count()


@pytest.mark.parametrize("lasting", [True, False])
def test_catalog(spark, corpus, tmp_path, lasting):
    root = f"file://{tmp_path}/root" if lasting else None
    c = Catalog(spark, root)
    again = lambda: Catalog.open(spark, root) if lasting else c
    families = {"look": FamilySpec(), "size": FamilySpec(), "no'te": FamilySpec()}
    rows = len({x[ROW] for x in alive()})
    c.create("t1", families, corpus.cells)
    for name in ("t1", "bad name"):
        with pytest.raises(ValueError):
            c.create(name, families, corpus.cells)
    c.snapshot("t1", "s1")
    c.mutate("t1", mutations.delete_row(spark.createDataFrame([("elm", 99)], "rowkey string, ts long"), ["look", "note"], 99))
    c = again()
    assert c.table("t1").count() == rows - 1
    with pytest.raises(ValueError):
        c.restore_snapshot("s1")
    c.disable("t1")
    c = again()
    with pytest.raises(ValueError):
        c.table("t1")
    c.restore_snapshot("s1")
    c.add_family("t1", "extra")
    c.delete_family("t1", "no'te")
    c.alter_family("t1", "look", max_versions=1, ttl=7)
    assert c.describe("t1")["families"]["look"] == {"max_versions": 1, "min_versions": 0, "ttl": 7, "keep_deleted": False}
    c.enable("t1")
    assert c.table("t1").count() == rows
    c.clone_snapshot("s1", "t2")
    c.export_snapshot("s1", f"file://{tmp_path}/out")
    c.import_snapshot(f"file://{tmp_path}/out", "s2")
    c.delete_snapshot("s1")
    c = again()
    assert c.list("t.*") == ["t1", "t2"] and c.list("x.*") == [] and c.list_snapshots() == ["s2"] and "t2" in c.to_json()
    c.compact("t2")
    c = again()
    assert c.table("t2").count() == rows and c.table("t2").cells.filter("type <> 4").count() == 0
    c.clone_snapshot("s2", "t3")
    assert c.table("t3").count() == rows
    c.truncate("t2")
    assert c.table("t2").count() == 0
    for call in (lambda: c.drop("t2"), lambda: c.truncate("none"), lambda: c.alter_family("t2", "look", ttl=1)):
        with pytest.raises(ValueError):
            call()
    for name in ("t1", "t2", "t3"):
        c.disable(name)
        c.drop(name)
    c.delete_snapshot("s2")
    assert not c.exists("t2") and again().list() == []
    if lasting:
        assert not [p for p in (tmp_path / "root").iterdir() if p.name.startswith("cells-")]


def test_constraints(spark, numbers):
    rule = hooks.Constraint("small", F.col("value").cast("int") < 100)
    good, bad = hooks.split_by_constraints(numbers, [rule])
    assert (good.count(), {r.broken for r in bad.collect()}) == (40 - 10, {"small"})
    with pytest.raises(Exception, match="small"):
        hooks.enforce(numbers, [rule]).collect()
    with pytest.raises(ValueError):
        hooks.ObservedTable(Table(numbers)).on("pre_nothing", lambda d: d)


@pytest.mark.parametrize(
    ("columns", "line", "reason"),
    [
        ("ROW_KEY,a:x,b", "r\t1\t2", None),
        ("ROW_KEY,a:x,b", "r\t1", None),
        ("ROW_KEY,a:x,b", "r\t1\t2\t3", "Excessive columns"),
        ("ROW_KEY,a:x,b", "nothing", "No delimiter"),
        ("a:x,b,ROW_KEY", "1\t2", "No row key"),
        ("ROW_KEY,a:x,TS_KEY", "r\t1", "No timestamp"),
        ("ROW_KEY,a:x,TS_KEY", "r\t1\tnow", "Invalid timestamp"),
        ("ROW_KEY,TS_KEY,a:x", "r\t77\t1", None),
    ],
)
def test_delimited(spark, columns, line, reason):
    good, bad = delimited.cells_of_lines(spark.createDataFrame([(line,)], "value string"), delimited.DelimitedSpec.of(columns), 5)
    assert [r.reason for r in bad.collect()] == ([reason] if reason else [])
    if reason is None:
        assert {r.ts for r in good.collect()} == {77 if "TS_KEY" in columns else 5}
    else:
        with pytest.raises(Exception, match="bad line"):
            delimited.cells_of_lines(spark.createDataFrame([(line,)], "value string"), delimited.DelimitedSpec.of(columns), 5, skip_bad=False)[0].collect()


def test_export_and_import(spark, tmp_path):
    rows = [("r1", "f", "q", t, 4, str(t)) for t in range(5)] + [("r1", "f", "q", 2, 12, None), ("r2", "f", "q", 1, 4, "x")]
    t = Table(make(spark, rows))
    transfer.write_cells(transfer.export_cells(t, None, raw=True), f"{tmp_path}/a")
    back = transfer.import_cells(spark, f"{tmp_path}/a", A.PrefixFilter("r1"), {"f": "g"})
    assert sorted((r.family, r.ts) for r in Table(back).scan(max_versions=None).collect()) == [("g", 3), ("g", 4)]
    transfer.bulk_load(back, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 7 + 6


def test_order_records(spark, tmp_path):
    (tmp_path / "o.tbl").write_text("1|37|O|131251.81|1996-01-02|5-LOW|Clerk#1|0|note|\n2|x|O|1.0|bad|1-URGENT|Clerk#2|0||\n")
    out = records.read_orders(spark, str(tmp_path / "o.tbl")).orderBy("orderkey").collect()
    assert (out[0].orderdate, out[0].custkey, out[1].orderdate, out[1].custkey) == (19960102, 37, None, None)


def test_indexes(spark):
    base = spark.createDataFrame([(i, i % 10, float(i)) for i in range(200)], "id long, a long, b double")
    catalog = indexes.IndexCatalog("id", ("id", "a", "b"))
    catalog.add(indexes.IndexSpec("a"))
    catalog.add(indexes.IndexSpec("b", "clustered"))
    catalog.statistics = {"a": indexes.value_counts(base, "a", list(range(10))), "b": indexes.histogram(base, "b", 0.0, 200.0, 20)}
    narrow = [ranges.where("a", "=", 3), ranges.between("b", 10.0, 20.0)]
    assert catalog.choose(narrow, ["id"]) == "b"
    assert catalog.choose([ranges.where("a", "=", 3)], ["id"]) == "a"
    assert catalog.choose([ranges.where("a", "!=", 3)], ["id"]) is None
    catalog.disable("b")
    assert catalog.choose([ranges.between("b", 10.0, 20.0)], ["id"]) is None
    catalog.enable("b")
    assert indexes.IndexCatalog.from_json(catalog.to_json()).specs == catalog.specs
    built = {c: indexes.build(base, s, "id") for c, s in catalog.specs.items()}
    assert [r.id for r in catalog.query(base, built, [narrow], ["id"]).collect()] == [13]
    assert math.isclose(indexes.selectivity([narrow], catalog.statistics), 0.1 * 0.05, rel_tol=0.01)
    h = catalog.statistics["b"]
    assert sum(h.merge(h).counts) == 400
    stats = indexes.read_statistics(["t\tDOUBLE\t1000\t825.13\t566754.54", "p\tSTRING\tset\ta\tb"])
    assert stats["t"]["buckets"] == 1000 and stats["p"]["values"] == ["a", "b"]


def test_codecs(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,), (2**40,), (-(2**63),), (2**63 - 1,)], "n long")
    out = df.select("n", codec.decode_integer(codec.encode_integer(F.col("n"))).alias("back"), F.hex(codec.encode_integer(F.col("n"))).alias("h")).collect()
    assert all(r.n == r.back and int(r.h, 16) == r.n % 2**64 for r in out)
    text = spark.createDataFrame([(bytearray(b"a\\b\x00\xff"),)], "b binary")
    row = text.select(codec.printable(F.col("b")).alias("p"), F.hex(codec.head(F.col("b"), 2)).alias("h"), F.hex(codec.tail(F.col("b"), 2)).alias("t"), codec.head(F.col("b"), 9).alias("n"), F.hex(codec.pad_head(F.col("b"), 1)).alias("ph")).first()
    assert (row.p, row.h, row.t, row.n, row.ph) == ("a\\x5Cb\\x00\\xFF", "615C", "00FF", None, "00615C6200FF")
    assert codec.increment_bytes(b"\x00\xff", 1) == b"\x01\x00"
    assert len(codec.split_points(b"a", b"z", 5)) == 4 and codec.hex_split_points(4, 2) == ["40", "80", "c0"]


def test_streams(spark, tmp_path):
    make(spark, [("r", "f", "q", 1, 4, "old"), ("r", "f", "q", 2, 4, "new"), ("s", "f", "q", 1, 4, "gone")]).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    edits.compacting_sink(stream, f"{tmp_path}/out", f"{tmp_path}/marks", 2).awaitTermination()
    make(spark, [("s", "f", "q", 5, 12, None)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    edits.compacting_sink(stream, f"{tmp_path}/out", f"{tmp_path}/marks", 2).awaitTermination()
    assert [(r.rowkey, r.value) for r in edits.read_generation(spark, f"{tmp_path}/out", 1).collect()] == [("r", "new")]
    for _ in range(2):  # the second begins where the first left off and finds nothing new
        edits.latest_to_files(stream, f"{tmp_path}/latest", f"{tmp_path}/latest-marks").awaitTermination()
        assert sorted((r.rowkey, r.value) for r in edits.read_latest(spark, f"{tmp_path}/latest").collect()) == [("r", "new"), ("s", "gone")]


def test_windowed_counts(spark, tmp_path):
    rows = [("r", "f", "2024-01-01 00:00:05"), ("r", "f", "2024-01-01 00:00:09"), ("r", "g", "2024-01-01 00:00:12"), ("s", "f", "2024-01-01 00:10:00")]
    spark.createDataFrame(rows, "rowkey string, family string, at string").selectExpr("rowkey", "family", "cast(at as timestamp) at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("rowkey string, family string, at timestamp").parquet(f"{tmp_path}/in")
    counts = edits.windowed_counts(stream, "at", "10 seconds", "1 minute").select("family", F.col("window.start").cast("string").alias("start"), "edits")
    q = counts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.family, r.start[-8:]): r.edits for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[("f", "00:00:00")] == 2 and got[("g", "00:00:10")] == 1


def test_stream_table_touches_few_buckets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    many = [(f"r{i}", "f", "q", 1, 4, "a") for i in range(60)]
    for n, rows in enumerate((many, [("r5", "f", "q", 2, 4, "b")], [("r5", "f", "q", 3, 12, None)], [("r6", "f", "q", 3, 4, "c")])):
        make(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        edits.compacting_sink(stream, f"{tmp_path}/out", f"{tmp_path}/marks", 8).awaitTermination()
        written = {p.parent.name for p in (tmp_path / "out").glob(f"bucket=*/batch={n}")}
        assert len(written) == (8 if n == 0 else 1)
    got = {r.rowkey: r.value for r in edits.read_generation(spark, f"{tmp_path}/out", 3).collect()}
    assert len(got) == 59 and "r5" not in got and got["r6"] == "c"
    assert len(list((tmp_path / "out").glob("bucket=*/batch=*"))) <= 8 + 3


def test_key_ranges_open_few_files(spark, tmp_path):
    cells_ = make(spark, [(f"k{i:04d}", "f", "q", 1, 4, str(i)) for i in range(400)])
    files = store.write_keyed(cells_, f"file://{tmp_path}/keyed", "rowkey", parts=8)
    table = Table.of_files(files, tombstones=False, ties=False)
    assert files.bounds().count() == 8
    got = table.scan(start="k0100", stop="k0110")
    assert sorted(r.value for r in got.collect()) == [str(i) for i in range(100, 110)]
    assert len(got.inputFiles()) <= 2 and len(table.get("k0399").inputFiles()) == 1 and len(table.scan(filter="PrefixFilter('k02')").inputFiles()) < 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rowkey,k0100)" in plan and "LessThan(rowkey,k0110)" in plan
    assert table.scan().count() == 400 and table.get("nothing").count() == 0 and table.scan(start="k0399").count() == 1
    assert {r.rowkey for r in table.row_or_before("k0200x", "f").collect()} == {"k0200"}


def test_as_of_like_brute_force(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 40) if i else None, i) for i in range(90)]
    asks = [(r.choice([None, -3, 99, *range(41)]), i) for i in range(300)] + [(7, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "at int, n int").repartition(3)
    keys = spark.createDataFrame(asks, "p int, id int").repartition(5)
    out = {x.id: x.match for x in scan.as_of(keys, df, "at", "p").collect()}
    assert len(out) == len(asks)
    for p, i in asks:
        fits = [at for at, _ in rows if at is not None and p is not None and at <= p]
        assert (out[i].at if out[i] else None) == (max(fits) if fits else None)
    assert all(x.match is None for x in scan.as_of(keys, df.limit(0), "at", "p").collect())


def test_sinks_and_counters(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "table string, n int")
    seen, counters = jobs.counted(df, "job", rows=F.count(F.lit(1)), odd=F.count_if(F.col("n") % 2 == 1))
    jobs.write_tables(seen, f"{tmp_path}/sink")
    assert counters.get == {"rows": 3, "odd": 2}
    assert sorted(r.n for r in jobs.read_written_table(spark, f"{tmp_path}/sink", "a").collect()) == [1, 3]
    with pytest.raises(Exception, match="names no table"):
        jobs.write_tables(spark.createDataFrame([(None, 1)], "table string, n int"), f"{tmp_path}/bad")
    grouped = jobs.reduce_groups(df, ["table"], lambda f: f.groupby("table", as_index=False).n.sum(), "table string, n long")
    assert {r.table: r.n for r in grouped.collect()} == {"a": 4, "b": 2}


def test_several_values_of_an_indexed_column(spark):
    index = spark.createDataFrame([(1.0, 1)], "v double, k long")
    twice = spark.createDataFrame([(7, 1.0), (7, 2.0)], "k long, v double")
    with pytest.raises(Exception, match="several values of v"):
        indexes.maintain(index, twice, index.select("k").limit(0), indexes.IndexSpec("v"), "k").collect()


def test_estimates():
    h = indexes.Histogram("v", 0.0, 100.0, (10, 20, 0, 70), distinct=(5, 20, 0, 7), least=-50.0, most=300.0)
    of = lambda *tests: h.estimate(ranges.Range("v", tests))
    assert of(("=", 10.0)) == 2.0 and of(("=", 30.0)) == 1.0 and of(("=", 999.0)) == 0.0
    assert of() == 100.0 and of((">", 75.0)) == 70.0 and math.isclose(of((">=", 187.5)), 35.0) and math.isclose(of(("<", 37.5)), 20.0)
    assert math.isclose(of((">=", 0.0), ("<=", 25.0)), 10 * 25 / 75) and of((">", 40.0), ("<", 30.0)) == 0.0
    assert math.isclose(of(("!=", 10.0)), 98.0) and indexes.Histogram("v").estimate(ranges.Range("v")) == 0.0
    # Without distinct values one value may be its whole bucket: an index is not taken for free.
    assert indexes.Histogram("v", 0.0, 10.0, (6, 4)).estimate(ranges.where("v", "=", 1)) == 6.0


def test_complements():
    bare = ranges.Range("c")
    assert bare.complement() == [[ranges.Range("c", ((ranges.NEVER, None),))]] and bare.complement()[0][0].complement() == [[bare]]
    assert ranges.between("c", 1, 2).complement() == [[ranges.Range("c", (("<", 1),))], [ranges.Range("c", ((">", 2),))]]
