import pytest
from hypothesis import given
from hypothesis import strategies as st

from cellarium.functions.comparators import Binary, BinaryPrefix, Op, Regex, Substring
from cellarium.operators.ranges import Range, parse_select, read_ranges
from cellarium.plans import filters as A
from cellarium.plans.text import FilterSyntaxError, from_json, parse, show, supported_filters
from cellarium.sources.resource_path import parse_path


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("FirstKeyOnlyFilter( )", A.FirstKeyOnlyFilter()),
        ("PrefixFilter('wood/')", A.PrefixFilter("wood/")),
        ("InclusiveStopFilter('oak, 7')", A.InclusiveStopFilter("oak, 7")),
        ("InclusiveStopFilter  ('it''s')", A.InclusiveStopFilter("it's")),
        ("TimestampsFilter( 0,9223372036854775807 , 12 )", A.TimestampsFilter((0, 9223372036854775807, 12))),
        ("ColumnPaginationFilter(25,0)", A.ColumnPaginationFilter(25, 0)),
        ("RowFilter(<=,'binary:tree:9')", A.RowFilter(Op.LESS_OR_EQUAL, Binary("tree:9"))),
        ("FamilyFilter( != , 'binaryprefix:lo' )", A.FamilyFilter(Op.NOT_EQUAL, BinaryPrefix("lo"))),
        ("QualifierFilter(!=, 'regexstring:^fr[a-z]+\\d$')", A.QualifierFilter(Op.NOT_EQUAL, Regex("^fr[a-z]+\\d$"))),
        ("ValueFilter(=, 'substring:Grün')", A.ValueFilter(Op.EQUAL, Substring("Grün"))),
        ("ColumnRangeFilter('bark', FALSE, '', true)", A.ColumnRangeFilter("bark", False, "", True)),
        ("DependentColumnFilter('size', 'm', false, >, 'binary:20')", A.DependentColumnFilter("size", "m", False, Op.GREATER, Binary("20"))),
        ("SingleColumnValueFilter('size','m',<,'binary:9',true,false)", A.SingleColumnValueFilter("size", "m", Op.LESS, Binary("9"), True, False)),
        ("WHILE RowFilter(>, 'binary:b')", A.WhileMatchFilter(A.RowFilter(Op.GREATER, Binary("b")))),
        (
            "PageFilter(3)OR(KeyOnlyFilter()  AND ColumnPrefixFilter('fr'))",
            A.FilterList((A.PageFilter(3), A.FilterList((A.KeyOnlyFilter(), A.ColumnPrefixFilter("fr")))), False),
        ),
        (
            "PageFilter(3) OR KeyOnlyFilter() AND SKIP ColumnPrefixFilter('fr')",
            A.FilterList((A.PageFilter(3), A.FilterList((A.KeyOnlyFilter(), A.SkipFilter(A.ColumnPrefixFilter("fr"))))), False),
        ),
    ],
)
def test_parse(text, tree):
    assert parse(text) == tree
    assert parse(show(tree)) == tree


@pytest.mark.parametrize(
    "text",
    [
        "", "  ", "TreeFilter()", "RowFilter(=>, 'binary:oak')", "RowFilter(=, 'oak')", "RowFilter(=, 'prefix:oak')", "QualifierFilter(<=, 'regexstring:o.k')", "FamilyFilter(>, 'substring:oak')",
        "ColumnPaginationFilter(3000000000, 1)", "TimestampsFilter(7, -7)", "PrefixFilter('oak)", "PrefixFilter('o''ak)", "InclusiveStopFilter()", "PageFilter(1, 2)", "PageFilter('many')",
        "OR PageFilter(1)", "PageFilter(1) OR", "(PageFilter(1)", "PageFilter(1))", "PageFilter(1) PageFilter(2)", "WHILE", "ColumnRangeFilter('a', yes, 'b', true)",
    ],
)
def test_errors(text):
    with pytest.raises(FilterSyntaxError):
        parse(text)


words = st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=8)
leaves = st.one_of(
    st.builds(A.PrefixFilter, words),
    st.builds(A.ValueFilter, st.sampled_from([Op.LESS, Op.EQUAL, Op.GREATER_OR_EQUAL]), st.builds(Binary, words)),
    st.builds(A.QualifierFilter, st.just(Op.NOT_EQUAL), st.builds(Regex, words)),
    st.builds(A.PageFilter, st.integers(0, 1 << 40)),
    st.builds(A.SingleColumnValueFilter, words, words, st.just(Op.EQUAL), st.builds(Substring, words), st.booleans(), st.booleans()),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(A.SkipFilter, t), st.builds(A.WhileMatchFilter, t), st.builds(A.FilterList, st.lists(t, min_size=2, max_size=3).map(tuple), st.booleans())), max_leaves=8)


@given(trees)
def test_round_trip(tree):
    assert parse(show(tree)) == tree


def test_names():
    assert len([n for n in supported_filters() if n not in A.REGISTRY]) == 18


def test_json():
    assert from_json('{"type": "FilterList", "op": "MUST_PASS_ONE", "filters": [{"type": "PrefixFilter", "value": "a"}, {"type": "RandomRowFilter", "chance": 0.5}]}') == A.FilterList((A.PrefixFilter("a"), A.RandomRowFilter(0.5)), False)
    assert from_json({"type": "SkipFilter", "filters": [{"type": "ValueFilter", "op": "LESS", "comparator": {"type": "BinaryComparator", "value": "x"}}]}) == A.SkipFilter(A.ValueFilter(Op.LESS, Binary("x")))
    with pytest.raises(ValueError):
        from_json({"type": "Nothing"})


def test_select_text():
    q = parse_select("Select f:a, b From t Where a >= 1 And (b = 'it''s' Or c <> 2.5)")
    assert (q.columns, q.table) == (("a", "b"), "t")
    assert q.dnf == ((Range("a", ((">=", 1),)), Range("b", (("=", "it's"),))), (Range("a", ((">=", 1),)), Range("c", (("!=", 2.5),))))
    for bad in ("select from t", "select a t", "select a from t where", "select a from t where a ~ 1", "select a from t extra"):
        with pytest.raises(ValueError):
            parse_select(bad)


def test_range_files():
    lines = ["t\tdouble\t>=\t20000\t<=\t45000", "d\tLONG\t>=\t19970310", "#p\tstring\t==\t3-MEDIUM", ""]
    assert read_ranges(lines, {"d": "day"}) == [Range("t", ((">=", 20000.0), ("<=", 45000.0))), Range("day", ((">=", 19970310),))]


def test_paths():
    s = parse_path("row%201/f:a,g/5,9?v=3")
    assert (s.start, s.stop, s.stop_inclusive, s.columns, s.time_min, s.time_max, s.max_versions) == ("row 1", "row 1", True, ("f:a", "g"), 5, 9, 3)
    s = parse_path("/abc*")
    assert s.start == "abc" and s.stop > "abcz" and not s.stop_inclusive
    assert parse_path("a,b").stop == "b"
    for bad in ("", "x/a,,b"):
        with pytest.raises(ValueError):
            parse_path(bad)
