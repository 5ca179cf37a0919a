"""Files of points, grids, lines and results: read as tables, written from tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.operators.grid import CELL

_POINT = "point_id long, x double, y double, z double"


def _decoded(files: DataFrame, schema: str, decode) -> DataFrame:
    names = ["path", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                columns = decode(content.as_py())
                paths = pa.array([path] * len(columns[0]), pa.string())
                yield pa.RecordBatch.from_arrays([paths, *map(pa.array, columns)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, " + schema)


def binary(spark: SparkSession, path: str, digests: DataFrame | None = None) -> DataFrame:
    """Whole files as ``path, content``. With ``digests(path, sha256)``, a file that is not in it or has another digest is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if digests is None:
        return files
    met = files.join(digests.withColumnRenamed("sha256", "__want"), "path", "left")
    wrong = F.raise_error(F.concat(F.lit("digest of "), F.col("path"), F.lit(" does not match")))
    return met.select("path", F.when(F.sha2("content", 256) == F.col("__want"), F.col("content")).otherwise(wrong).alias("content"))


def _whole(content: bytes, size: int, strict: bool) -> int:
    """How many records of ``size`` bytes a file holds; a part of one is an error if ``strict``."""
    if strict and len(content) % size:
        raise ValueError(f"a file of {len(content)} bytes is cut short: records have {size} bytes")
    return len(content) // size


def triples(files: DataFrame, offset_x: float = 0.0, offset_y: float = 0.0, strict: bool = True) -> DataFrame:
    """``path, point_id, x, y, z`` of files of little-endian 32-bit floats, three a point. A file that is cut short is an error, or loses its last point if not ``strict``."""

    def decode(content: bytes) -> list[np.ndarray]:
        _whole(content, 12, strict)
        v = np.frombuffer(content, "<f4", len(content) // 12 * 3).reshape(-1, 3).astype(float)
        return [np.arange(len(v)), v[:, 0] + offset_x, v[:, 1] + offset_y, v[:, 2]]

    return _decoded(files, _POINT, decode)


def returns(files: DataFrame, offset_x: float = 0.0, offset_y: float = 0.0, keep_class: int | None = None, strict: bool = True) -> DataFrame:
    """``path, point_id, x, y, z, red, green, blue, return_no, n_returns, cls`` of files in blocks by column: coordinates (3
    floats of 32 bits), colours (3 numbers of 16 bits), return number, number of returns and class (a byte each).

    With ``keep_class`` only its returns (2: ground), which keep their numbers in the file. A file that is cut short is an error if ``strict``.
    """

    def decode(content: bytes) -> list[np.ndarray]:
        n = _whole(content, 21, strict)
        v = np.frombuffer(content, "<f4", 3 * n).reshape(-1, 3).astype(float)
        colour = np.frombuffer(content, "<u2", 3 * n, 12 * n).reshape(-1, 3).astype(np.int32)
        small = [np.frombuffer(content, np.uint8, n, 18 * n + k * n).astype(np.int16) for k in range(3)]
        columns = [np.arange(n), v[:, 0] + offset_x, v[:, 1] + offset_y, v[:, 2], *colour.T, *small]
        return columns if keep_class is None else [c[small[2] == keep_class] for c in columns]

    return _decoded(files, _POINT + ", red int, green int, blue int, return_no short, n_returns short, cls short", decode)


def producer_windows(files: DataFrame, index: DataFrame, strict: bool = True) -> DataFrame:
    """``site, row, col, z, error, edited`` of a producer's windows: heights and their errors (32-bit floats), then edit masks (a byte each), by rows.

    ``index(path, site, rows, cols)`` names each file's window; a file of another size is an error.
    """

    def decode(content: bytes) -> list[np.ndarray]:
        n = _whole(content, 9, strict)
        z, error = (np.frombuffer(content, "<f4", n, 4 * n * k).astype(float) for k in range(2))
        return [np.arange(n), z, error, np.frombuffer(content, np.uint8, n, 8 * n).astype(np.int16)]

    sized = files.join(F.broadcast(index), "path")  # a row a file
    n = F.col("rows") * F.col("cols") * 9
    wrong = F.raise_error(F.concat(F.lit("window of "), F.col("path"), F.lit(" has another size")))
    checked = sized.select("path", F.when(F.length("content") == n, F.col("content")).otherwise(wrong).alias("content"))
    cells = _decoded(checked, "cell long, z double, error double, edited short", decode).join(F.broadcast(index), "path")
    return cells.select("site", F.floor(F.col("cell") / F.col("cols")).cast("int").alias("row"), (F.col("cell") % F.col("cols")).cast("int").alias("col"), "z", "error", "edited")


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, col, z, x0, y0, size`` of ASCII grids; rows count from the south, cells without data are left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.rtrim("value"), r"\r?\n").alias("lines"))
    head = lambda key: F.element_at(F.split(F.trim(F.element_at(F.filter("lines", lambda s: F.lower(s).startswith(key)), 1)), r"\s+"), 2).cast("double")
    given = text.select("path", *(head(k).alias(n) for k, n in (("xll", "x0"), ("yll", "y0"), ("cellsize", "size"), ("nrows", "rows"), ("nodata", "none"))), F.filter("lines", lambda s: (F.trim(s) != "") & ~F.trim(s).rlike("^[A-Za-z]")).alias("body"))
    rows = given.select("path", "x0", "y0", "size", "rows", "none", F.posexplode("body").alias("at", "line"))
    cells = rows.select("path", "x0", "y0", "size", "none", (F.col("rows") - 1 - F.col("at")).cast("int").alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    z = F.col("v").cast("double")
    return cells.where(F.col("none").isNull() | (z != F.col("none"))).select("path", "row", "col", z.alias("z"), "x0", "y0", "size")


def write_ascii_grids(cells: DataFrame, path: str, rows: int, cols: int, size: float = 1.0, none: float = -9999.0) -> None:
    """``cells(site, row, col, z)`` as ASCII grids, a folder ``site=...`` each, from the north down; cells that are missing have the value ``none``."""
    line = cells.groupBy("site", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("z").cast("double")))).alias("z"))  # the cells of one row
    every = cells.select("site").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    values = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.try_element_at("z", c), F.lit(none)).cast("string")), " ")
    body = every.join(line, ["site", "row"], "left").withColumn("z", F.coalesce("z", F.create_map().cast("map<int,double>"))).select("site", (rows - F.col("row")).alias("at"), values.alias("value"))
    head = "\n".join([f"ncols {cols}", f"nrows {rows}", "xllcorner 0", "yllcorner 0", f"cellsize {size}", f"NODATA_value {none}"])
    heads = cells.select("site").distinct().select("site", F.lit(0).alias("at"), F.lit(head).alias("value"))
    heads.unionByName(body).repartition("site").sortWithinPartitions("site", "at").select("site", "value").write.partitionBy("site").text(path)


def xyz_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="x double, y double, z double")


def contour_csv(spark: SparkSession, path: str) -> DataFrame:
    """``line_id, seq, x, y, z`` of CSV files (also gzipped) with a header and columns x, y, z and line number; ``seq`` is the order in the files, by their names."""
    raw = spark.read.csv(path, header=True, schema="x double, y double, z double, id double")
    # Within a split, rows come in order; splits of a file in order of where they begin.
    placed = raw.select("*", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__at"))
    order = Window.partitionBy("line_id").orderBy("file_path", "file_block_start", "__at")
    return placed.withColumn("line_id", F.floor("id").cast("long")).select("line_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "x", "y", "z")


# -- lines ------------------------------------------------------------------------------------------------------

_FEATURE = "type string, properties struct<line_id:long,seq:long,prov:string,m_sup:double,i_sup:double>, geometry struct<type:string,coordinates:string>"


def features(spark: SparkSession, path: str, schema: str = _FEATURE, by_line: bool = False, strict: bool = True) -> DataFrame:
    """Features of GeoJSON: a collection a file, or one feature a line.

    With ``by_line`` files have one feature a line and are read in splits; else a file is one row. What can't be read as a
    feature is an error, or is left out if not ``strict``.
    """
    known = F.col("f").isNotNull() & F.col("f.type").isNotNull()

    def checked(f: DataFrame) -> DataFrame:
        if not strict:
            return f.where(known).select("f.*")
        wrong = F.raise_error(F.concat(F.lit("not a feature: "), F.coalesce(F.substring("line", 1, 80), F.lit("null"))))
        return f.where(F.when(known, F.lit(True)).otherwise(wrong.cast("boolean"))).select("f.*")

    if by_line:
        lines = spark.read.text(path).withColumnRenamed("value", "line").where("trim(line) <> ''")
        return checked(lines.select("line", F.from_json("line", schema).alias("f")))
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"features array<struct<{_struct(schema.replace(', ', ','))}>>").alias("c"), "value")
    many = parsed.where("c.features is not null").select(F.explode("c.features").alias("f"))
    single = parsed.where("c.features is null").select(F.explode(F.split("value", "\n")).alias("line")).where("trim(line) <> ''").select("line", F.from_json("line", schema).alias("f"))
    return checked(many.select(F.to_json("f").alias("line"), "f").unionByName(single))


def _struct(schema: str) -> str:
    """Top-level fields ``name type`` of a schema as ``name:type``."""
    out, depth = [], 0
    for part in schema.split(","):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def edges(spark: SparkSession, path: str, by_line: bool = False, strict: bool = True) -> DataFrame:
    """``line_id, seq, prov, m, i, x, y, x2, y2`` of two-point lines, whatever their order in the file."""
    f = features(spark, path, by_line=by_line, strict=strict)
    points = F.from_json("geometry.coordinates", "array<array<double>>")
    p = f.where("geometry.type = 'LineString'").select("properties.*", points.alias("p"))
    at = lambda k, j: F.get(F.element_at("p", k), F.lit(j))
    return p.select("line_id", "seq", "prov", F.col("m_sup").alias("m"), F.col("i_sup").alias("i"), at(1, 0).alias("x"), at(1, 1).alias("y"), at(-1, 0).alias("x2"), at(-1, 1).alias("y2"))


def line_parts(spark: SparkSession, path: str, by_line: bool = False, strict: bool = True) -> DataFrame:
    """``line_id, part, seq, x, y`` of the vertices of lines; a line of several parts gives each its number."""
    f = features(spark, path, by_line=by_line, strict=strict).select("properties.line_id", "geometry.type", "geometry.coordinates")
    one, many = F.from_json("coordinates", "array<array<double>>"), F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("type") == "LineString", F.array(one)).when(F.col("type") == "MultiLineString", many)
    v = f.select("line_id", F.posexplode(parts).alias("part", "p")).select("line_id", "part", F.posexplode("p").alias("seq", "v"))
    return v.select("line_id", "part", "seq", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))


def contiguous(edges: DataFrame) -> DataFrame:
    """The edges; one that does not start where the one before it in its line ends is an error when it is read."""
    order = Window.partitionBy("line_id").orderBy("seq")
    before = F.lag(F.struct("x2", "y2")).over(order)
    broken = before.isNotNull() & (before != F.struct(F.col("x").alias("x2"), F.col("y").alias("y2")))
    marked = edges.withColumn("__broken", broken)
    wrong = F.raise_error(F.concat(F.lit("line "), F.col("line_id").cast("string"), F.lit(": gap before edge "), F.col("seq").cast("string")))
    return marked.withColumn("seq", F.when(F.col("__broken"), wrong.cast("long")).otherwise(F.col("seq"))).drop("__broken")


def write_spans(spans: DataFrame, path: str, null_code: float | None = None) -> None:
    """One feature a line of ``spans(x, y, x2, y2, ...)``; every other column is a property. Formats without null get ``null_code`` for missing numbers."""
    ends = ("x", "y", "x2", "y2")
    numbers = {c for c, t in spans.dtypes if t in ("double", "float", "int", "bigint")}
    value = lambda c: F.coalesce(F.col(c), F.lit(null_code).cast("double")) if null_code is not None and c in numbers else F.col(c)
    properties = F.struct(*(value(c).alias(c) for c in spans.columns if c not in ends))
    point = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(point("x", "y"), point("x2", "y2")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    spans.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """``fixture_id, tolerance, seq, x, y, support`` of lines with one fixture each."""
    raw = spark.read.json(path, schema="fixture_id long, tolerance double, coordinates array<array<double>>, support array<double>")
    rows = raw.select("fixture_id", "tolerance", F.posexplode(F.arrays_zip("coordinates", "support")).alias("seq", "v"))
    return rows.select("fixture_id", "tolerance", "seq", F.get("v.coordinates", F.lit(0)).alias("x"), F.get("v.coordinates", F.lit(1)).alias("y"), F.col("v.support").alias("support"))


def runs_json(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """``site, run, seq, x, y, m, i, prov`` of files of nested runs: vertices, and the edge from each to the next (null at the end). A file holds a site, or one a line."""
    schema = "site string, runs array<struct<vertices:array<array<double>>,edges:array<struct<M:double,I:double,provenance:string>>>>"
    runs = spark.read.json(path, schema=schema, multiLine=not by_line).select("site", F.posexplode("runs").alias("run", "r"))
    v = runs.select("site", "run", F.posexplode(F.arrays_zip("r.vertices", "r.edges")).alias("seq", "v"))
    return v.select("site", "run", "seq", F.get("v.vertices", F.lit(0)).alias("x"), F.get("v.vertices", F.lit(1)).alias("y"), F.col("v.edges.M").alias("m"), F.col("v.edges.I").alias("i"), F.col("v.edges.provenance").alias("prov"))


def write_runs(vertices: DataFrame, path: str) -> None:
    """``vertices(site, run, seq, x, y, m, i, prov)`` as ``runs_json`` reads them: a line of JSON a site, the last vertex of a run without an edge."""
    vertex = F.struct("seq", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("at"), F.struct(F.col("m").alias("M"), F.col("i").alias("I"), F.col("prov").alias("provenance")).alias("edge"))
    run = vertices.groupBy("site", "run").agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    edges = F.transform(F.slice("v", F.lit(1), F.size("v") - 1), lambda v: v["edge"])
    nested = run.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("run", F.transform("v", lambda v: v["at"]).alias("vertices"), edges.alias("edges")))).alias("r"))
    runs = F.transform("r", lambda r: F.struct(r["vertices"].alias("vertices"), r["edges"].alias("edges")))
    nested.select(F.to_json(F.struct("site", runs.alias("runs")), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def checkpoints(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """``id, e, n, z, type`` of a JSON array of checkpoints; another number than ``expected`` is an error when it is read."""
    points = spark.read.json(path, schema="id string, e double, n double, z double, type string", multiLine=True)
    if expected is None:
        return points
    wrong = points.agg(F.count("*").alias("__n")).select(F.when(F.col("__n") == expected, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} checkpoints, got "), F.col("__n").cast("string"))).cast("boolean")).alias("__ok"))
    return points.join(F.broadcast(wrong), F.col("__ok")).drop("__ok")


# -- results ----------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A result as CSV with header and as JSON lines, in folders of these names."""
    for form, options in (("csv", {"header": "true"}), ("json", {})):
        writer = df.write.options(**options)
        (writer.partitionBy(by) if by else writer).format(form).save(f"{path}/{form}")


def bands(field: DataFrame) -> DataFrame:
    """The support field as bands: measured and interpolated support where they apply, and the provenance's code (1, 2; 0 none)."""
    of = lambda c: F.when(F.col("coverage") == c, F.col("confidence"))
    code: Column = F.when(F.col("coverage") == "measured", 1).when(F.col("coverage") == "interpolated", 2).otherwise(0)
    return field.select(*CELL, of("measured").alias("m_sup"), of("interpolated").alias("i_sup"), code.alias("prov"))
