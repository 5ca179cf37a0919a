"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tellurion.operators import contours, simplify
from tellurion.plans import queries
from tellurion.sources.tables import vertices

DATA = "/root/testdata/sf0.01"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 4) if isinstance(x, (int, float)) else str(x)

    return sorted(names), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in want.description], want.fetchall())


def _kept(p, a, b, tolerance):
    """Plain recursion over indices."""
    (ax, ay), (bx, by) = p[a], p[b]
    long = math.hypot(bx - ax, by - ay)
    far = [abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / long if long else math.hypot(x - ax, y - ay) for x, y in p[a + 1 : b]]
    if not far or max(far) <= tolerance:
        return {a, b}
    k = a + 1 + far.index(max(far))
    return _kept(p, a, k, tolerance) | _kept(p, k, b, tolerance)


def test_simplified_lines(spark):
    got, stretches = {}, {}
    for r in simplify.simplified(vertices(spark, DATA), 20.0).orderBy("line_id", "seq").collect():
        stretches.setdefault((r["line_id"], r["run"]), []).append((r["x"], r["y"]))
        got.setdefault((r["line_id"], r["run"]), []).append(r["keep"])
    for key, p in stretches.items():
        want = _kept(p, 0, len(p) - 1, 20.0)
        assert [k in want for k in range(len(p))] == got[key]


def test_spans_cover_every_edge_once(spark):
    v = vertices(spark, DATA)
    whole = simplify.spans(simplify.simplified(v, 20.0))
    edges = queries.evidence.edges(v)
    assert whole.select("line_id", "seq", "prov", "m", "i").exceptAll(edges.select("line_id", "seq", "prov", "m", "i")).isEmpty() and whole.count() == edges.count()
    assert simplify.simplified(v.limit(0), 1.0).isEmpty()


def test_contour_cases(spark):
    """A lone high corner gives one segment, a saddle two, a flat block none."""
    def block(site, *z):
        return [(site, r, c, float(h), 50) for (r, c), h in zip(contours.CORNERS, z, strict=True)]

    cells = spark.createDataFrame(block("one", 0, 0, 1, 0) + block("saddle", 1, 0, 1, 0) + block("flat", 0, 0, 0, 0) + block("hole", 0, 0, 1, 0)[:3], "site string, row int, col int, z double, confidence int")
    found = [r["site"] for r in contours.segments(cells, 0.4).where("level = 0.4").collect()]
    assert sorted(found) == ["one", "saddle", "saddle"]
