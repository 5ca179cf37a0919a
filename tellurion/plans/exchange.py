"""Queries that write the given data in an exchange format to the shared folder and read it back, and the SQL of the data itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion.operators import grid
from tellurion.plans.rasters import _CELLS, _FIELD, COLS, ROWS, field_cells, rounded
from tellurion.plans.records import VERTICES
from tellurion.sources import files
from tellurion.sources.shared import folder
from tellurion.sources.tables import points, vertices


def _place(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _edges(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("line_id").orderBy("seq")
    after = {f"{c}2": F.lead(c).over(order) for c in ("x", "y")}
    return vertices(spark, sf_dir).withColumns(after).where(F.col("x2").isNotNull())


def features_read_back(spark, sf_dir):
    """Edges of lines as GeoJSON, a feature a line, read in splits: by line their number and what they carry, in order from end to start."""
    path = _place(spark, "features")
    files.write_spans(_edges(spark, sf_dir).withColumnsRenamed({"m": "m_sup", "i": "i_sup"}), path)
    e = files.contiguous(files.edges(spark, path, by_line=True))
    out = e.groupBy("line_id").agg(F.count("*").alias("edges"), F.sum("m").alias("m"), F.sum("i").alias("i"), F.count_if(F.col("prov") == "X").alias("mixed"), F.min_by("x", "seq").alias("x"), F.max_by("y2", "seq").alias("y"), F.max("seq").alias("last"))
    return rounded(out, "m", "i", "x", "y", to=5)


def grids_read_back(spark, sf_dir):
    """Mean heights of cells as ASCII grids, read from the south up; cells without points stay out."""
    path = _place(spark, "grids")
    cells = grid.to_cells(points(spark, sf_dir), COLS, ROWS).groupBy(*grid.CELL).agg(F.avg("z").alias("z"))
    files.write_ascii_grids(cells, path, ROWS, COLS)
    back = files.ascii_grid(spark, path).withColumn("site", F.regexp_extract("path", "site=([^/]*)/", 1))
    return rounded(back.select("site", "row", "col", "z"), "z")


def runs_read_back(spark, sf_dir):
    """Lines as nested runs, in files by a third of the lines each."""
    path = _place(spark, "runs")
    order = Window.partitionBy("line_id").orderBy("seq")
    last = F.lead("seq").over(order).isNull()
    v = vertices(spark, sf_dir).select((F.col("line_id") % 3).cast("string").alias("site"), F.col("line_id").alias("run"), "line_id", "seq", "x", "y", *(F.when(~last, F.col(c)).alias(c) for c in ("m", "i", "prov")))
    files.write_runs(v.drop("line_id"), path)
    back = files.runs_json(spark, path, by_line=True)
    # Runs are numbered by their place in the site.
    out = back.groupBy("site", "run").agg(F.count("*").alias("vertices"), F.sum("m").alias("m"), F.sum("i").alias("i"), F.count("prov").alias("edges"), F.max_by("x", "seq").alias("x"), F.max_by("y", "seq").alias("y"))
    return rounded(out, "m", "i", "x", "y", to=5)


def csv_read_back(spark, sf_dir):
    """Vertices of lines as gzipped CSV without their numbers, which come back from the order of rows."""
    path = _place(spark, "csv")
    v = vertices(spark, sf_dir).repartitionByRange("line_id").sortWithinPartitions("line_id", "seq")
    v.select("x", "y", F.lit(0.0).alias("z"), F.col("line_id").alias("id")).write.csv(path, header=True, compression="gzip")
    return rounded(files.contour_csv(spark, path).select("line_id", "seq", "x", "y"), "x", "y", to=5)


def corpus_read_back(spark, sf_dir):
    """Lines as a corpus of fixtures, one object a line of JSON."""
    path = _place(spark, "corpus")
    at = F.array_sort(F.collect_list(F.struct("seq", F.array("x", "y").alias("at"), "m")))
    v = vertices(spark, sf_dir).groupBy(F.col("line_id").alias("fixture_id")).agg(at.alias("v")).select("fixture_id", F.lit(0.5).alias("tolerance"), F.transform("v", lambda x: x["at"]).alias("coordinates"), F.transform("v", lambda x: x["m"]).alias("support"))
    v.write.option("ignoreNullFields", "false").json(path)
    back = files.corpus(spark, path)
    out = back.groupBy("fixture_id", "tolerance").agg(F.count("*").alias("vertices"), F.count("support").alias("supported"), F.sum("support").alias("support"), F.max_by("y", "seq").alias("y"))
    return rounded(out, "support", "y", to=5)


def field_bands(spark, sf_dir):
    """The support field as bands, with no value where a band doesn't apply."""
    return files.bands(field_cells(spark, sf_dir))


QUERIES = {f.__name__: f for f in (features_read_back, grids_read_back, runs_read_back, csv_read_back, corpus_read_back, field_bands)}

SQL = {
    "features_read_back": f"""WITH {VERTICES}, ed AS (SELECT * FROM (SELECT *, lead(x) OVER q AS x2, lead(y) OVER q AS y2 FROM w WINDOW q AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL)
        SELECT line_id, count(*) AS edges, round(sum(m), 5) AS m, round(sum(i), 5) AS i, count(*) FILTER (prov = 'X') AS mixed, round(arg_min(x, seq), 5) AS x, round(arg_max(y2, seq), 5) AS y, max(seq) AS last FROM ed GROUP BY line_id""",
    "grids_read_back": f"""WITH {_CELLS} SELECT site, "row", col, round(avg(z), 6) AS z FROM c GROUP BY ALL""",
    "runs_read_back": f"""WITH {VERTICES}, rn AS (SELECT *, dense_rank() OVER (PARTITION BY line_id % 3 ORDER BY line_id) - 1 AS run, lead(seq) OVER (PARTITION BY line_id ORDER BY seq) IS NULL AS ends FROM w)
        SELECT CAST(line_id % 3 AS VARCHAR) AS site, CAST(run AS INTEGER) AS run, count(*) AS vertices, round(sum(m) FILTER (NOT ends), 5) AS m, round(sum(i) FILTER (NOT ends), 5) AS i, count(*) FILTER (NOT ends) AS edges, round(arg_max(x, seq), 5) AS x, round(arg_max(y, seq), 5) AS y FROM rn GROUP BY ALL""",
    "csv_read_back": f"WITH {VERTICES} SELECT line_id, seq, round(x, 5) AS x, round(y, 5) AS y FROM w",
    "corpus_read_back": f"WITH {VERTICES} SELECT line_id AS fixture_id, 0.5::DOUBLE AS tolerance, count(*) AS vertices, count(m) AS supported, round(sum(m), 5) AS support, round(arg_max(y, seq), 5) AS y FROM w GROUP BY line_id",
    "field_bands": f"""WITH {_FIELD} SELECT site, "row", col, CASE WHEN coverage = 'measured' THEN confidence END AS m_sup, CASE WHEN coverage = 'interpolated' THEN confidence END AS i_sup, CAST(CASE coverage WHEN 'measured' THEN 1 WHEN 'interpolated' THEN 2 ELSE 0 END AS INTEGER) AS prov FROM s""",
}
