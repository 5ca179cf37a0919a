"""Files written here and read back, and lines matched to their sources."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import match, predicates
from tellurion.sources import files


def test_points(spark, tmp_path):
    v = np.array([[1.5, 2.0, 3.0], [4.0, 5.0, 6.25]], "<f4")
    (tmp_path / "a.bin").write_bytes(v.tobytes() + b"cut")
    path = f"file:{tmp_path}/a.bin"
    digest = hashlib.sha256(v.tobytes() + b"cut").hexdigest()
    index = spark.createDataFrame([(path, digest)], "path string, sha256 string")
    got = files.triples(files.binary(spark, path, index), 100.0, 200.0, strict=False).orderBy("point_id").collect()
    assert [(r["point_id"], r["x"], r["y"], r["z"]) for r in got] == [(0, 101.5, 202.0, 3.0), (1, 104.0, 205.0, 6.25)]
    with pytest.raises(Exception, match="cut short"):
        files.triples(files.binary(spark, path)).collect()
    with pytest.raises(Exception, match="does not match"):
        files.binary(spark, path, index.withColumn("sha256", F.lit("00"))).collect()
    (tmp_path / "b.bin").write_bytes(v.tobytes() + np.zeros(6, "<u2").tobytes() + bytes([1, 2]) + bytes([2, 2]) + bytes([2, 7]))
    got = files.returns(files.binary(spark, f"{tmp_path}/b.bin")).where("cls = 2").collect()
    assert [(r["x"], r["return_no"], r["n_returns"]) for r in got] == [(1.5, 1, 2)]
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("x,y,z\n1,2,3\n4,5,6\n")
    assert [tuple(r) for r in files.xyz_csv(spark, f"{tmp_path}/c.csv.gz").collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 0.5\nNODATA_value -9999\n1 2 -9999\n4 5 6.5\n")
    got = files.ascii_grid(spark, f"{tmp_path}/g.asc").collect()
    assert sorted((r["row"], r["col"], r["z"]) for r in got) == [(0, 0, 4.0), (0, 1, 5.0), (0, 2, 6.5), (1, 0, 1.0), (1, 1, 2.0)]
    assert (got[0]["x0"], got[0]["y0"], got[0]["size"]) == (10.0, 20.0, 0.5)


def _feature(line, seq, a, b, prov, m=None, i=None):
    return {"type": "Feature", "properties": {"line_id": line, "seq": seq, "prov": prov, "m_sup": m, "i_sup": i}, "geometry": {"type": "LineString", "coordinates": [a, b]}}


def test_lines(spark, tmp_path):
    parts = [_feature(1, 1, [1, 0], [2, 1], "X", 70.0, 50.0), _feature(1, 0, [0, 0], [1, 0], "M", 90.5)]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": parts}, indent=1))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, parts)) + "\n\nnot a feature\n")
    want = [(1, 0, "M", 90.5, None, 0.0, 0.0, 1.0, 0.0), (1, 1, "X", 70.0, 50.0, 1.0, 0.0, 2.0, 1.0)]
    for name in ("c.json", "l.json"):
        assert [tuple(r) for r in files.contiguous(files.edges(spark, f"{tmp_path}/{name}", strict=False)).orderBy("seq").collect()] == want
    for by_line in (False, True):
        with pytest.raises(Exception, match="not a feature: not a"):
            files.edges(spark, f"{tmp_path}/l.json", by_line).collect()
        assert files.edges(spark, f"{tmp_path}/l.json", by_line, strict=False).count() == 2
    (tmp_path / "gap.json").write_text(json.dumps({"features": [parts[1], _feature(1, 1, [5, 0], [2, 1], "M", 1.0)]}))
    with pytest.raises(Exception, match="gap before edge 1"):
        files.contiguous(files.edges(spark, f"{tmp_path}/gap.json")).collect()
    spans = spark.createDataFrame([(1, "M", 0.5, None, 0.0, 0.0, 1.0, 2.0)], "line_id long, prov string, m_min double, i_min double, x double, y double, x2 double, y2 double")
    for code, least in ((None, None), (-1.0, -1.0)):
        files.write_spans(spans, f"{tmp_path}/out{code}", code)
        written = json.loads(spark.read.text(f"{tmp_path}/out{code}").first()["value"])
        assert written["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 2.0]] and written["properties"] == {"line_id": 1, "prov": "M", "m_min": 0.5, "i_min": least}


def test_nested_files(spark, tmp_path):
    (tmp_path / "corpus").write_text(json.dumps({"fixture_id": 7, "tolerance": 0.1, "coordinates": [[0, 1], [2, 3]], "support": [0.5, None]}) + "\n")
    assert [tuple(r) for r in files.corpus(spark, f"{tmp_path}/corpus").orderBy("seq").collect()] == [(7, 0.1, 0, 0.0, 1.0, 0.5), (7, 0.1, 1, 2.0, 3.0, None)]
    (tmp_path / "runs").write_text(json.dumps({"site": "s", "runs": [{"vertices": [[0, 0], [1, 1]], "edges": [{"M": 1.0, "I": None, "provenance": "M"}]}]}))
    assert [tuple(r) for r in files.runs_json(spark, f"{tmp_path}/runs").orderBy("seq").collect()] == [("s", 0, 0, 0.0, 0.0, 1.0, None, "M"), ("s", 0, 1, 1.0, 1.0, None, None, None)]
    (tmp_path / "points").write_text(json.dumps([{"id": "a", "e": 1, "n": 2, "z": 3, "type": "NVA"}, {"id": "b", "e": 1, "n": 2, "z": 3}]))
    assert files.checkpoints(spark, f"{tmp_path}/points", 2).count() == 2
    with pytest.raises(Exception, match="expected 3 checkpoints"):
        files.checkpoints(spark, f"{tmp_path}/points", 3).collect()
    table = spark.createDataFrame([("a", 1), ("b", 2)], "site string, n int")
    files.write_table(table, f"{tmp_path}/result", "site")
    assert spark.read.csv(f"{tmp_path}/result/csv", header=True).count() == 2 and spark.read.json(f"{tmp_path}/result/json").where("site = 'b'").first()["n"] == 2
    field = spark.createDataFrame([("s", 0, 0, "measured", 80), ("s", 0, 1, "interpolated", 30)], "site string, row int, col int, coverage string, confidence int")
    assert [tuple(r)[3:] for r in files.bands(field).orderBy("col").collect()] == [(80, None, 1), (None, 30, 2)]


def test_matched_lines(spark):
    lines = {"ok": ("ABCD", "ABD"), "order": ("ABCD", "ACBD"), "end": ("ABCD", "ABC"), "foreign": ("ABCD", "AZD"), "ambiguous": ("ABCBD", "ABD"), "whole": ("ABCBD", "ABCBD"), "ring": ("ABCA", "ABCA"), "ring2": ("ABCA", "ABA"), "missing": ("ABC", ""), "alone": ("", "AB"), "again": ("ABCD", "ABBD")}
    at = {c: (float(k), float(k * k)) for k, c in enumerate("ABCDZ")}
    rows = [[(n, k, *at[c]) for n, (name, pair) in enumerate(lines.items()) for k, c in enumerate(pair[side])] for side in (0, 1)]
    source, out = (spark.createDataFrame(r, "line_id long, seq long, x double, y double") for r in rows)
    got = {}
    for r in match.matched(source, out).orderBy("line_id", "seq").collect():
        got.setdefault(list(lines)[r["line_id"]], []).append((r["state"], r["keep"]))
    assert {n: "".join("x" if k else "-" for _, k in v) for n, v in got.items() if v[0][0] == "matched"} == {"ok": "xx-x", "whole": "xxxxx", "ring": "xxxx", "ring2": "xx-x"}
    assert {n for n, v in got.items() if v == [("unmatched", None)]} == {"order", "end", "foreign", "missing", "alone", "again"}
    assert got["ambiguous"] == [("ambiguous", None)]


def test_lone_vertices_and_rounding(spark):
    """A ring isn't matched by its first vertex alone; coordinates agree to nine decimals; lines are named by two columns."""
    assert match.recovered([(0, 0)], [(0, 0), (1, 1), (0, 0)]) == ("unmatched", []) and match.recovered([(0, 0)], [(0, 0)]) == ("matched", [0])
    source = [(1, r, k, float(k) + 1 / 3, float(k % 3)) for r in (0, 1) for k in range(4)] + [(2, 0, k, x, 0.0) for k, x in enumerate((0.0, 1.0, 0.0))]
    out = [(1, 0, 0, 1 / 3 + 1e-11, 0.0), (1, 0, 1, 3 + 1 / 3, 0.0), (1, 1, 0, 1 / 3 + 1e-7, 0.0), (1, 1, 1, 3 + 1 / 3, 0.0), (2, 0, 0, 0.0, 0.0)]
    a, b = (spark.createDataFrame(t, "line_id long, run int, seq long, x double, y double") for t in (source, out))
    got = {}
    for r in match.matched(a, b, ("line_id", "run")).collect():
        got.setdefault((r["line_id"], r["run"], r["state"]), []).append((r["seq"], r["keep"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {(1, 0, "matched"): [(0, True), (1, False), (2, False), (3, True)], (1, 1, "unmatched"): [(None, None)], (2, 0, "unmatched"): [(None, None)]}


def test_windows_and_colours(spark, tmp_path):
    """Producer's windows with voids, edited cells and errors that aren't; returns of one class with their colours."""
    z, error = np.array([1, 2, np.nan, 4, 5, 6], "<f4"), np.array([0.5, -1, 1, -32767, 2, 1], "<f4")
    (tmp_path / "w.bin").write_bytes(z.tobytes() + error.tobytes() + bytes([1, 1, 1, 1, 7, 0]))
    path = f"file:{tmp_path}/w.bin"
    index = spark.createDataFrame([(path, "s", 2, 3)], "path string, site string, rows int, cols int")
    got = predicates.producer_evidence(files.producer_windows(files.binary(spark, path), index)).orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r["z"], r["coverage"], r["confidence"]) for r in got] == [(0, 0, 1.0, "measured", -0.5), (0, 1, 2.0, "interpolated", 0.0), (1, 0, 4.0, "interpolated", 0.0), (1, 1, 5.0, "interpolated", 0.0)]
    with pytest.raises(Exception, match="has another size"):
        files.producer_windows(files.binary(spark, path), index.withColumn("cols", F.lit(4))).collect()
    v = np.arange(6, dtype="<f4")
    (tmp_path / "r.bin").write_bytes(v.tobytes() + np.arange(6, dtype="<u2").tobytes() + bytes([1, 2, 2, 2, 2, 7]))
    got = files.returns(files.binary(spark, f"{tmp_path}/r.bin"), keep_class=2).collect()
    assert [(r["point_id"], r["x"], r["red"], r["blue"]) for r in got] == [(0, 0.0, 0, 2)]


def test_units(spark):
    points = spark.createDataFrame([("m", 100.0), ("f", 328.0), ("odd", 7.0), ("m", None)], "site string, z double")
    known = spark.createDataFrame([("m", 101.0), ("f", 100.0), ("odd", 4.0)], "site string, reference double")
    got = {(r["site"], r["unit"]): r["z"] for r in predicates.in_metres(points, known).where("z is not null").collect()}
    assert got == {("m", "metre"): 100.0, ("f", "foot"): pytest.approx(328 * 0.3048)}


def test_order_parts_and_round_trips(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("x,y,z,id\n" + "".join(f"{k},{k * k},7,{1 + k % 2}\n" for k in range(10)))
    got = [tuple(r) for r in files.contour_csv(spark, f"{tmp_path}/c.csv.gz").orderBy("line_id", "seq").collect()]
    assert got == [(1 + p, n, float(2 * n + p), float((2 * n + p) ** 2), 7.0) for p in (0, 1) for n in range(5)]
    parts = [{"type": "Feature", "properties": {"line_id": 4}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]}}, {"type": "Feature", "properties": {"line_id": 5}, "geometry": {"type": "LineString", "coordinates": [[2, 3], [4, 5]]}}, {"type": "Feature", "properties": {"line_id": 6}, "geometry": {"type": "Point", "coordinates": [2, 3]}}]
    (tmp_path / "m.json").write_text(json.dumps({"type": "FeatureCollection", "features": parts}))
    got = [tuple(r) for r in files.line_parts(spark, f"{tmp_path}/m.json").orderBy("line_id", "part", "seq").collect()]
    assert got == [(4, 0, 0, 0.0, 0.0), (4, 0, 1, 1.0, 1.0), (4, 1, 0, 5.0, 5.0), (4, 1, 1, 6.0, 6.0), (4, 1, 2, 7.0, 7.0), (5, 0, 0, 2.0, 3.0), (5, 0, 1, 4.0, 5.0)]
    rows = [("a", 0, k, float(k), 1.0, None if k == 2 else 5.0, None, None if k == 2 else "M") for k in range(3)] + [("a", 1, k, float(k), 2.0, None, None if k else 7.5, None if k else "I") for k in range(2)]
    runs = spark.createDataFrame(rows, "site string, run int, seq int, x double, y double, m double, i double, prov string")
    files.write_runs(runs, f"{tmp_path}/runs")
    assert [tuple(r) for r in files.runs_json(spark, f"{tmp_path}/runs", by_line=True).orderBy("run", "seq").collect()] == rows
    cells = [("a", 0, 0, 1.5), ("a", 1, 2, -3.25), ("b", 2, 1, 0.1)]
    files.write_ascii_grids(spark.createDataFrame(cells, "site string, row int, col int, z double"), f"{tmp_path}/grids", 3, 4)
    got = files.ascii_grid(spark, f"{tmp_path}/grids").withColumn("site", F.regexp_extract("path", "site=([^/]*)/", 1))
    assert sorted((r["site"], r["row"], r["col"], r["z"]) for r in got.collect()) == cells
