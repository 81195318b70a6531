"""Row addresses as paths: ``row[,end][*]/columns/times?v=versions``, URL-encoded."""

from __future__ import annotations

from urllib.parse import parse_qs, unquote

from cellarium.operators.scan import ScanSpec


def parse_path(path: str) -> ScanSpec:
    """A scan from a path.  A key that ends in * is a prefix; a single time is that time and earlier."""
    body, _, query = path.lstrip("/").partition("?")
    parts = body.split("/")
    if not parts or not parts[0]:
        raise ValueError("a path needs a row")
    first, comma, last = parts[0].partition(",")
    first, last = unquote(first), unquote(last)
    if first.endswith("*"):
        if comma:
            raise ValueError("a prefix takes no end")
        start, stop, inclusive = first[:-1], first[:-1] + "\U0010ffff", False
    elif comma:
        start, stop, inclusive = first, last, False
    else:
        start, stop, inclusive = first, first, True
    columns: tuple[str, ...] = ()
    if len(parts) > 1 and parts[1]:
        names = [unquote(c) for c in parts[1].split(",")]
        if not all(names):
            raise ValueError("an empty column")
        columns = tuple(n.rstrip(":") if n.endswith(":") else n for n in names)
    low, high = None, None
    if len(parts) > 2 and parts[2]:
        a, comma, b = parts[2].partition(",")
        low, high = (int(a), int(b)) if comma else (None, int(a))
    versions = parse_qs(query).get("v")
    return ScanSpec(start, stop, inclusive, columns, low, high, int(versions[0]) if versions else 1)
