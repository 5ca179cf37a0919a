"""Queries on bootstraps over lines: paired differences, means, rank correlation, shares above a median, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators import bootstrap, evidence
from tellurion.operators.statistics import rank_correlation
from tellurion.plans import records
from tellurion.plans.records import rounded
from tellurion.sources.tables import vertices

SEED, REPLICATES, THRESHOLD, RATED = 20261109, 200, 33, 3
RULES = ("endpoint", "complete")


def _edges(spark, sf_dir) -> DataFrame:
    return evidence.runs(evidence.edges(vertices(spark, sf_dir)))


def _by_line(spark, sf_dir) -> DataFrame:
    """By line: the scored length, and what each rule accepts or rejects wrongly of it."""
    edges = _edges(spark, sf_dir)
    truth = F.coalesce(F.col("m") >= THRESHOLD, F.lit(False)) & (F.col("prov") == "M")
    says = F.coalesce(F.col("m_says") >= THRESHOLD, F.lit(False)) & (F.col("prov_says") == "M")
    out = None
    for rule in RULES:
        judged = evidence.carried(edges, rule).withColumns({"truth": truth, "says": says})
        total = lambda on: F.coalesce(F.sum(F.when(on, F.col("len"))), F.lit(0.0))
        one = judged.groupBy("line_id").agg(F.sum("len").alias("len"), total(F.col("says") & ~F.col("truth")).alias(f"{rule}_fa"), total(F.col("truth") & ~F.col("says")).alias(f"{rule}_wr"))
        out = one if out is None else out.join(one.drop("len"), "line_id")
    return out


def paired_bootstrap(spark, sf_dir):
    """Length that a query accepts or rejects wrongly, per thousand, by both rules, and the difference of the rules in the same draws."""
    measures = {f"{r}_{k}": (f"{r}_{k}", "len", 1000.0) for r in RULES for k in ("fa", "wr")}
    by_replicate = bootstrap.ratios(_by_line(spark, sf_dir), "line_id", measures, SEED, REPLICATES)
    names = [*measures, "diff_fa", "diff_wr"]
    paired = by_replicate.withColumns({f"diff_{k}": F.col(f"complete_{k}") - F.col(f"endpoint_{k}") for k in ("fa", "wr")})
    out = paired.agg(F.count("*").alias("replicates"), *bootstrap.interval(paired, *names))
    return rounded(out, *(c for c in out.columns if c != "replicates"))


def rate_bootstrap(spark, sf_dir):
    """Mean of the lines' promotion rates and its rank correlation with their spans, over lines that are rated."""
    judged = evidence.promotions(evidence.span_records(_edges(spark, sf_dir)))
    rated = judged.groupBy("line_id").agg(F.count("*").alias("spans"), F.count_if("promoted").alias("promoted")).where(F.col("spans") >= RATED).withColumn("rate", F.col("promoted") / F.col("spans"))
    drawn = bootstrap.pairs(rated, "line_id", "spans", "rate", SEED, REPLICATES)
    mean, rho = bootstrap.means_of(drawn, "rate"), rank_correlation(drawn, "replicate", "spans", "rate", weight="times")
    met = mean.join(rho.select("replicate", "rho"), "replicate")
    out = met.agg(F.count("*").alias("replicates"), F.sum("mean").alias("means"), *bootstrap.interval(met, "mean", "rho"))
    return rounded(out, "means", "mean_low", "mean_high", "rho_low", "rho_high")


def median_bootstrap(spark, sf_dir):
    """Share of mixed edges whose measured support is above the median of the purely measured ones, over lines."""
    edges = _edges(spark, sf_dir)
    units = edges.select("line_id").distinct()
    kept, other = (edges.where(F.col("prov") == p).select("line_id", F.col("m").alias("value")) for p in ("M", "X"))
    shares = bootstrap.shares_above(units, "line_id", kept, other, "value", SEED, REPLICATES)
    out = shares.agg(F.count("*").alias("replicates"), F.sum("median").alias("medians"), F.sum("share").alias("shares"), *bootstrap.interval(shares, "median", "share"))
    return rounded(out, *(c for c in out.columns if c != "replicates"))


def merged_bootstrap(spark, sf_dir):
    """The intervals of the first bootstrap's ratios by weights that merge, in one pass over the lines."""
    names = [f"{r}_{k}" for r in RULES for k in ("fa", "wr")]
    sums = bootstrap.merged_sums(_by_line(spark, sf_dir), "line_id", ["len", *names], SEED, REPLICATES)
    rates = sums.withColumns({c: 1000 * F.col(c) / F.col("len") for c in names})
    out = rates.agg(F.count("*").alias("replicates"), *bootstrap.interval(rates, *names))
    return rounded(out, *(c for c in out.columns if c != "replicates"))


QUERIES = {f.__name__: f for f in (paired_bootstrap, rate_bootstrap, median_bootstrap, merged_bootstrap)}

def _draws(units: str) -> str:
    """Draws of every replicate over the rows of ``units``: the generator's state after any number of steps, bit by bit of that number, as many bits as the query takes."""
    steps = bootstrap.matrices()
    out = f"""un AS (SELECT *, row_number() OVER (ORDER BY line_id % 1024, line_id) - 1 AS number, count(*) OVER () AS total FROM {units}),
  z0 AS (SELECT r, total, r * total + number + 1 AS k, {SEED}::BIGINT AS s FROM un, range({REPLICATES}) x(r))"""
    for bit, m in enumerate(steps):
        out += f""", z{bit + 1} AS (SELECT r, total, k, CASE WHEN (k >> {bit}) & 1 = 1 THEN list_reduce(list_transform({m.tolist()}::BIGINT[], lambda c, i: CASE WHEN (s >> (i - 1)) & 1 = 1 THEN c ELSE 0 END), lambda a, b: xor(a, b)) ELSE s END AS s FROM z{bit})"""
    return out + f", dr AS (SELECT r, CAST(floor(s / 4294967296.0::DOUBLE * total) AS BIGINT) AS number, count(*) AS times FROM z{len(steps)} GROUP BY ALL)"


_INTERVAL = "round(quantile_cont({0}, 0.025), 5) AS {0}_low, round(quantile_cont({0}, 0.975), 5) AS {0}_high"
_JUDGED = f"""{records._EDGES}, cy AS (SELECT *, coalesce(m >= {THRESHOLD}, false) AND prov = 'M' AS truth, coalesce(least(first_value(m) OVER w, last_value(m) OVER w) >= {THRESHOLD}, false) AND first_value(prov) OVER w = 'M' AND last_value(prov) OVER w = 'M' AS endpoint,
    coalesce(min(m) OVER p >= {THRESHOLD}, false) AND min(prov) OVER p = 'M' AND max(prov) OVER p = 'M' AS complete FROM s WINDOW p AS (PARTITION BY line_id, span), w AS (PARTITION BY line_id, span ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  ol AS (SELECT line_id, sum(len) AS len, {", ".join(f"coalesce(sum(len) FILTER ({r} AND NOT truth), 0) AS {r}_fa, coalesce(sum(len) FILTER (truth AND NOT {r}), 0) AS {r}_wr" for r in RULES)} FROM cy GROUP BY line_id)"""
_RATED = f"""{records._EDGES}, am AS (SELECT line_id, span, least(arg_min({{'v': m}}, seq).v, arg_max({{'v': m}}, seq).v) - min(m) AS more FROM s GROUP BY line_id, span),
  ol AS (SELECT line_id, count(*) AS spans, count(*) FILTER (more > 1e-12) / count(*) AS rate FROM am GROUP BY line_id HAVING count(*) >= {RATED})"""


def _ranks(value: str) -> str:
    """Average ranks of values that count ``times`` times."""
    return f"sum(times) OVER (PARTITION BY r ORDER BY {value}) - (sum(times) OVER (PARTITION BY r, {value}) - 1) / 2.0"


SQL = {
    "paired_bootstrap": f"""WITH {_JUDGED}, {_draws('ol')}, rr AS (SELECT r, {", ".join(f"1000 * sum(times * {m}) / sum(times * len) AS {m}" for m in (f"{r}_{k}" for r in RULES for k in ("fa", "wr")))} FROM dr JOIN un USING (number) GROUP BY r),
        rd AS (SELECT *, complete_fa - endpoint_fa AS diff_fa, complete_wr - endpoint_wr AS diff_wr FROM rr) SELECT count(*) AS replicates, {", ".join(_INTERVAL.format(m) for m in [*(f"{r}_{k}" for r in RULES for k in ("fa", "wr")), "diff_fa", "diff_wr"])} FROM rd""",
    "rate_bootstrap": f"""WITH {_RATED}, {_draws('ol')}, rt AS (SELECT r, times, spans, rate FROM dr JOIN un USING (number)), rk AS (SELECT *, {_ranks('spans')} AS a, {_ranks('rate')} AS b FROM rt),
        rm AS (SELECT r, sum(times * rate) / sum(times) AS mean, sum(times) AS n, sum(times * a) / sum(times) AS ma, sum(times * b) / sum(times) AS mb FROM rk GROUP BY r),
        rr AS (SELECT rm.r, any_value(mean) AS mean, sum(times * (a - ma) * (b - mb)) / sqrt(sum(times * (a - ma) ** 2) * sum(times * (b - mb) ** 2)) AS rho FROM rk JOIN rm ON rm.r = rk.r GROUP BY rm.r)
        SELECT count(*) AS replicates, round(sum(mean), 5) AS means, {_INTERVAL.format('mean')}, {_INTERVAL.format('rho')} FROM rr""",
    "median_bootstrap": f"""WITH {records._EDGES}, ol AS (SELECT DISTINCT line_id FROM s), {_draws('ol')}, ev AS (SELECT r, prov, m, times FROM dr JOIN un USING (number) JOIN s USING (line_id) WHERE m IS NOT NULL AND prov IN ('M', 'X')),
        mw AS (SELECT r, m, sum(times) AS w FROM ev WHERE prov = 'M' GROUP BY ALL), mu AS (SELECT r, m, sum(w) OVER (PARTITION BY r ORDER BY m) AS upto, sum(w) OVER (PARTITION BY r) AS total FROM mw),
        md AS (SELECT r, (min(m) FILTER (upto > CASE WHEN total % 2 = 1 THEN total // 2 ELSE total // 2 - 1 END) + min(m) FILTER (upto > total // 2)) / 2 AS median FROM mu GROUP BY r),
        rr AS (SELECT r, any_value(median) AS median, 100 * sum(CASE WHEN m > median THEN times ELSE 0 END) / sum(times) AS share FROM ev JOIN md USING (r) WHERE prov = 'X' GROUP BY r)
        SELECT count(*) AS replicates, round(sum(median), 5) AS medians, round(sum(share), 5) AS shares, {_INTERVAL.format('median')}, {_INTERVAL.format('share')} FROM rr""",
}
