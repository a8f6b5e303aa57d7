"""The registered queries of the statistics operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.design import C
from lattica.operators import anova as av
from lattica.operators import categorical, descriptive, hypothesis, missing, mixed, montecarlo, multivariate, regression, survival
from lattica.operators import timeseries as ts
from lattica.sources.load import table
from lattica.streaming.moments import windowed_moments, windowed_regression

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(rows: DataFrame, /, **places: int) -> DataFrame:
    """Results that both engines round alike."""
    return rows.withColumns({c: F.round(F.col(c), k) + F.lit(0.0) for c, k in places.items()})


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _integral(f: str, to: str, steps: int = 4000) -> str:
    """SQL for Simpson's rule over 0 to `to` of `f`, an expression in z."""
    return f"(SELECT sum(z_weight * ({f})) FROM (SELECT ({to}) * zs.i / {steps}.0 AS z, ({to}) / {3 * steps}.0 * CASE WHEN zs.i IN (0, {steps}) THEN 1 WHEN zs.i % 2 = 1 THEN 4 ELSE 2 END AS z_weight FROM range(0, {steps + 1}) zs(i)))"


def _t_p(t: str, df: str) -> str:
    """SQL for the two-sided tail of Student's t."""
    f = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * (1 + z * z / {df}) ** (-({df} + 1) / 2)"
    return f"round(greatest(0.0, 1 - 2 * {_integral(f, f'least(abs({t}), 40.0)')}), 5)"


def _chi2_p(x: str, df: str) -> str:
    """SQL for the upper tail of chi-squared, integrated over its root."""
    f = f"2 * z ** ({df} - 1) * exp(-z * z / 2 - {df} / 2 * ln(2.0) - lgamma({df} / 2))"
    return f"round(greatest(0.0, 1 - {_integral(f, f'sqrt(least({x}, 1600.0))')}), 5)"


def _f_p(x: str, d1: str, d2: str) -> str:
    """SQL for the upper tail of F, integrated over its root."""
    f = f"2 * z ** ({d1} - 1) * exp(lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2) + {d1} / 2 * ln({d1} / {d2}) - ({d1} + {d2}) / 2 * ln(1 + {d1} * z * z / {d2}))"
    return f"round(greatest(0.0, 1 - {_integral(f, f'sqrt(least({x}, 400.0))')}), 5)"


def _with_p(sql: str, p: str) -> str:
    """The rows of `sql` with a p-value computed from them."""
    return f"SELECT x.*, {p} AS p_value FROM ({sql}) x"


@register("""
SELECT l_returnflag, v.variable, count(x) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 4) AS var, round(stddev_samp(x), 6) AS sd,
  round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1,
  round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max
FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_discount']) AS variable, unnest([l_quantity, l_discount]) AS x FROM lineitem) v
GROUP BY ALL""")
def describe_by(spark, d):
    out = descriptive.describe(lines(spark, d), ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(out, mean=6, var=4, sd=6, skewness=6, kurtosis=6, min=6, q1=6, median=6, q3=6, max=6)


@register("""
SELECT 'o_totalprice' AS variable, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median,
  round(avg(x), 4) AS mean, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max FROM (SELECT o_totalprice AS x FROM orders)""")
def summary_six(spark, d):
    out = descriptive.summary(table(spark, d, "orders"), ["o_totalprice"])
    return rounded(out, min=4, q1=4, median=4, mean=4, q3=4, max=4)


def _quantile_sql() -> str:
    return """
WITH o AS (SELECT list_sort(list(o_totalprice)) AS v, count(o_totalprice)::DOUBLE AS n FROM orders),
k AS (SELECT unnest([1,2,3,4,5,6,7,8,9]) AS kind, unnest([0.0,0.0,0.0,0.0,0.5,0.0,1.0,1.0/3,0.375]) AS a, unnest([0.0,0.0,0.0,1.0,0.5,0.0,1.0,1.0/3,0.375]) AS b),
p AS (SELECT unnest([0.0,0.1,0.25,0.5,0.75,0.9,1.0])::DOUBLE AS prob),
s AS (SELECT kind, prob, v, n, CASE WHEN kind = 3 THEN n * prob - 0.5 WHEN kind < 3 THEN n * prob ELSE a + prob * (n + 1 - a - b) END AS h FROM o, k, p),
j AS (SELECT *, floor(h + 8.881784197001252e-16) AS j FROM s),
g AS (SELECT *, CASE WHEN kind < 4 THEN CASE WHEN abs(h - j) < 8.881784197001252e-16 * greatest(1.0, h) THEN CASE WHEN kind = 1 THEN 0.0 WHEN kind = 2 THEN 0.5 WHEN j % 2 = 0 THEN 0.0 ELSE 1.0 END ELSE 1.0 END
  WHEN abs(h - j) < 8.881784197001252e-16 THEN 0.0 ELSE h - j END AS g FROM j)
SELECT kind, prob, round((1 - g) * v[least(greatest(j, 1), n)::BIGINT] + g * v[least(greatest(j + 1, 1), n)::BIGINT], 4) AS value FROM g"""


@register(_quantile_sql())
def quantile_types(spark, d):
    """All nine quantile types in one result, from one table of counts."""
    return rounded(descriptive.quantile(table(spark, d, "orders"), "o_totalprice", (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0), tuple(range(1, 10))), value=4)


_PAIRS = "(VALUES ('l_quantity','l_quantity'),('l_quantity','l_discount'),('l_quantity','l_tax'),('l_discount','l_discount'),('l_discount','l_tax'),('l_tax','l_tax')) p(a, b)"
_WIDE = "(SELECT [l_quantity, l_discount, l_tax] AS r FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL)"
_AT = "list_position(['l_quantity','l_discount','l_tax'], {0})"


@register(f"SELECT a, b, round(covar_samp(r[{_AT.format('a')}], r[{_AT.format('b')}]), 6) AS cov, count(*) AS n FROM {_WIDE}, {_PAIRS} GROUP BY ALL")
def covariance(spark, d):
    return rounded(descriptive.cov(lines(spark, d), ["l_quantity", "l_discount", "l_tax"]), cov=6)


@register(f"SELECT a, b, round(CASE WHEN a = b THEN 1 ELSE corr(r[{_AT.format('a')}], r[{_AT.format('b')}]) END, 6) AS cor, count(*) AS n FROM {_WIDE}, {_PAIRS} GROUP BY a, b")
def correlation_pearson(spark, d):
    return rounded(descriptive.cor(lines(spark, d), ["l_quantity", "l_discount", "l_tax"]), cor=6)


@register("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(x, y), 6) AS cor, count(*) AS n FROM r""")
def correlation_spearman(spark, d):
    return rounded(descriptive.cor(lines(spark, d), ["l_quantity", "l_extendedprice"], method="spearman").where("a <> b"), cor=6)


@register("""
WITH s AS (SELECT s_suppkey AS i, s_nationkey::DOUBLE AS x, s_acctbal AS y FROM supplier WHERE s_nationkey IS NOT NULL AND s_acctbal IS NOT NULL),
p AS (SELECT sign(a.x - b.x) AS u, sign(a.y - b.y) AS v FROM s a JOIN s b ON a.i < b.i)
SELECT 's_nationkey' AS a, 's_acctbal' AS b, round(sum(u * v) / sqrt(sum(abs(u)) * sum(abs(v))), 6) AS cor, (SELECT count(*) FROM s) AS n FROM p""")
def correlation_kendall(spark, d):
    return rounded(descriptive.cor(table(spark, d, "supplier"), ["s_nationkey", "s_acctbal"], method="kendall").where("a <> b"), cor=6)


_GROUPS = "avg(x) FILTER (g = 'A') AS m1, avg(x) FILTER (g = 'R') AS m2, var_samp(x) FILTER (g = 'A') AS v1, var_samp(x) FILTER (g = 'R') AS v2, count(x) FILTER (g = 'A')::DOUBLE AS n1, count(x) FILTER (g = 'R')::DOUBLE AS n2"
_FLAGS = "(SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem)"


@register(_with_p(f"WITH s AS (SELECT {_GROUPS} FROM {_FLAGS}), e AS (SELECT *, v1 / n1 + v2 / n2 AS q FROM s) SELECT round((m1 - m2) / sqrt(q), 6) AS statistic, round(q * q / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df, round(m1 - m2, 4) AS estimate FROM e", _t_p("x.statistic", "x.df")))
def t_test_welch(spark, d):
    out = hypothesis.t_test(lines(spark, d), "l_extendedprice", group="l_returnflag", groups=("A", "R"))
    return rounded(out, p_value=5, statistic=6, df=4, estimate=4).select("statistic", "df", "estimate", "p_value")


@register(_with_p(f"WITH s AS (SELECT {_GROUPS} FROM {_FLAGS}) SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS statistic, n1 + n2 - 2 AS df FROM s", _t_p("x.statistic", "x.df")))
def t_test_pooled(spark, d):
    out = hypothesis.t_test(lines(spark, d), "l_extendedprice", group="l_returnflag", groups=("A", "R"), equal_var=True)
    return rounded(out, p_value=5, statistic=6).select("statistic", "df", "p_value")


@register(_with_p("SELECT l_linestatus, round((avg(l_quantity) - 25) / sqrt(var_samp(l_quantity) / count(l_quantity)), 6) AS statistic, count(l_quantity) - 1.0::DOUBLE AS df FROM lineitem GROUP BY ALL", _t_p("x.statistic", "x.df")))
def t_test_one_sample(spark, d):
    out = hypothesis.t_test(lines(spark, d), "l_quantity", pop_mean=25.0, by=["l_linestatus"])
    return rounded(out, p_value=5, statistic=6).select("l_linestatus", "statistic", "df", "p_value")


@register(_with_p("SELECT round(avg(x) / sqrt(var_samp(x) / count(x)), 6) AS statistic, count(x) - 1.0::DOUBLE AS df, round(avg(x), 8) AS estimate FROM (SELECT l_discount - l_tax AS x FROM lineitem)", _t_p("x.statistic", "x.df")))
def t_test_paired(spark, d):
    out = hypothesis.t_test(lines(spark, d), "l_discount", "l_tax", paired=True)
    return rounded(out, p_value=5, statistic=6, estimate=8).select("statistic", "df", "estimate", "p_value")


@register(f"WITH s AS (SELECT {_GROUPS} FROM {_FLAGS}) SELECT round(v1 / v2, 8) AS statistic, n1 - 1 AS df, n2 - 1 AS df2 FROM s")
def variance_test(spark, d):
    out = hypothesis.var_test(lines(spark, d), "l_extendedprice", "l_returnflag", ("A", "R"))
    return rounded(out, statistic=8).select("statistic", "df", "df2")


@register(_with_p("""
WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
f AS (SELECT a, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM t) CROSS JOIN (SELECT DISTINCT b FROM t) LEFT JOIN t USING (a, b)),
e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM f)
SELECT round(sum((n - e) ** 2 / e), 6) AS statistic, ((SELECT count(DISTINCT a) FROM t) - 1) * ((SELECT count(DISTINCT b) FROM t) - 1)::DOUBLE AS df FROM e""", _chi2_p("x.statistic", "x.df")))
def chisq_independence(spark, d):
    out = hypothesis.chisq_test(lines(spark, d), "l_returnflag", "l_linestatus", correct=False)
    return rounded(out, p_value=5, statistic=6).select("statistic", "df", "p_value")


@register("""
WITH t AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL),
f AS (SELECT l_returnflag, l_linestatus, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT l_returnflag FROM t) CROSS JOIN (SELECT DISTINCT l_linestatus FROM t) LEFT JOIN t USING (l_returnflag, l_linestatus)),
w AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS r, sum(n) OVER (PARTITION BY l_linestatus) AS c, sum(n) OVER () AS s FROM f)
SELECT l_returnflag, l_linestatus, n AS observed, round(r * c / s, 4) AS expected, round((n - r * c / s) / sqrt(r * c / s), 6) AS residual,
  round((n - r * c / s) / sqrt(r * c / s * (1 - r / s) * (1 - c / s)), 6) AS stdres FROM w""")
def chisq_residuals(spark, d):
    return rounded(hypothesis.chisq_residuals(lines(spark, d), "l_returnflag", "l_linestatus"), expected=4, residual=6, stdres=6)


@register(_with_p("WITH t AS (SELECT count(*)::DOUBLE AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type), e AS (SELECT n, sum(n) OVER () / count(*) OVER () AS e FROM t) SELECT round(sum((n - e) ** 2 / e), 6) AS statistic, count(*) - 1.0::DOUBLE AS df FROM e", _chi2_p("x.statistic", "x.df")))
def chisq_goodness_of_fit(spark, d):
    return rounded(hypothesis.chisq_test(table(spark, d, "events"), "event_type"), p_value=5, statistic=6).select("statistic", "df", "p_value")


@register()
def chisq_simulated(spark, d):
    return hypothesis.chisq_test(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", simulate=True, n_resamples=500)


@register(_with_p("""
WITH t AS (SELECT l_linestatus, sum((l_discount > 0.05)::INT)::DOUBLE AS x, count(l_discount)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT sum(x) / sum(n) AS p FROM t)
SELECT round(sum((x - n * p) ** 2 / (n * p) + (x - n * p) ** 2 / (n * (1 - p))), 6) AS statistic, count(*) - 1.0::DOUBLE AS df FROM t, p""", _chi2_p("x.statistic", "x.df")))
def proportions_equal(spark, d):
    return rounded(hypothesis.prop_test(lines(spark, d), "l_discount > 0.05", "l_linestatus", correct=False), p_value=5, statistic=6).select("statistic", "df", "p_value")


@register("WITH t AS (SELECT sum((l_discount > 0.05)::INT)::DOUBLE AS x, count(l_discount)::DOUBLE AS n FROM lineitem) SELECT round(2 * (abs(x - n / 2) - least(0.5, abs(x - n / 2))) ** 2 / (n / 2), 6) AS statistic, round(x / n, 8) AS estimate FROM t")
def proportion_one(spark, d):
    return rounded(hypothesis.prop_test(lines(spark, d), "l_discount > 0.05"), statistic=6, estimate=8).select("statistic", "estimate")


@register()
def fisher_exact(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_acctbal") > 5000).alias("rich"), (F.col("s_nationkey") < 12).alias("low"))
    return rounded(hypothesis.fisher_test(rows, "rich", "low"), estimate=8, p_value=8, conf_low=8, conf_high=8)


_EV = "(SELECT value AS v, event_type = 'view' AS k FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL)"


@register(f"WITH r AS (SELECT k, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM {_EV}) SELECT sum(r) FILTER (k) - count(*) FILTER (k) * (count(*) FILTER (k) + 1) / 2.0 AS statistic, count(*) FILTER (k) AS n1, count(*) FILTER (NOT k) AS n2 FROM r")
def wilcoxon_rank_sum(spark, d):
    return hypothesis.wilcox_rank_sum(table(spark, d, "events"), "value", "event_type", ("view", "click")).select("statistic", "n1", "n2")


@register("WITH d AS (SELECT c_acctbal - 4500 AS d FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal <> 4500), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d) SELECT round(sum(r) FILTER (d > 0), 2) AS statistic, count(*) AS n FROM r")
def wilcoxon_signed_rank(spark, d):
    out = hypothesis.wilcox_signed_rank(table(spark, d, "customer"), "c_acctbal", null_value=4500.0)
    return rounded(out, statistic=2).select("statistic", "n")


@register(f"WITH c AS (SELECT v, sum(k::INT) AS a, count(*) - sum(k::INT) AS b FROM {_EV} GROUP BY v), f AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g FROM c) SELECT round(max(abs(g)), 8) AS statistic FROM f")
def ks_two_sample(spark, d):
    return rounded(hypothesis.ks_test(table(spark, d, "events"), "value", "event_type", ("view", "click")), statistic=8).select("statistic")


@register("WITH r AS (SELECT c_acctbal AS v, rank() OVER (ORDER BY c_acctbal) - 1 AS lo, count(*) OVER () AS n, count(*) OVER (PARTITION BY c_acctbal) AS c FROM customer WHERE c_acctbal IS NOT NULL), f AS (SELECT *, least(1, greatest(0, (v + 1000) / 11000)) AS f FROM r) SELECT round(greatest(max((lo + c) / n - f), max(f - lo / n)), 8) AS statistic FROM f")
def ks_one_sample(spark, d):
    out = hypothesis.ks_test(table(spark, d, "customer"), "c_acctbal", distribution="unif", min=-1000.0, max=10000.0)
    return rounded(out, statistic=8).select("statistic")


_P = "SELECT p_partkey AS k, (p_partkey * 7919 % 9973 + 1) / 100000.0::DOUBLE AS p FROM part"
_PADJ = {
    "holm": "least(1, max(p * (n - r + 1)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING))",
    "hochberg": "least(1, min(p * (n - r + 1)) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING))",
    "BH": "least(1, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING))",
    "BY": "least(1, min(p * n / r * h) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING))",
    "bonferroni": "least(1, p * n)",
}
_padj_sql = " UNION ALL ".join(f"SELECT k, '{m}' AS method, round({e}, 8) AS p_adjusted FROM r" for m, e in _PADJ.items())


@register(f"WITH p AS ({_P}), n AS (SELECT count(*)::DOUBLE AS n FROM p), o AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS r FROM p), h AS (SELECT sum(1.0::DOUBLE / r) AS h FROM o), r AS (SELECT k, p, n, h, r FROM o, n, h) {_padj_sql}")
def p_adjust_methods(spark, d):
    wide = hypothesis.p_adjust_many(_p_values(spark, d), "p", {m: m for m in _PADJ})
    long = wide.select("k", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("p_adjusted")) for m in _PADJ))).alias("a"))
    return rounded(long.select("k", "a.*"), p_adjusted=8)


def _p_values(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 7919 % 9973 + 1) / 100000.0).alias("p"))


@register(f"""
WITH p AS ({_P}), o AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS j, count(*) OVER () AS n FROM p),
c AS (SELECT m, min(m * p / (j - n + m)) FILTER (j > n - m + 1) AS rest, min(p) AS low FROM o, range(2, (SELECT count(*) + 1 FROM p)) s(m) WHERE j > n - m GROUP BY m)
SELECT k, any_value(p) AS p, round(least(1, greatest(any_value(p), max(least(m * least(p, low), rest)))), 8) AS p_adjusted FROM o, c GROUP BY k""")
def p_adjust_hommel(spark, d):
    return rounded(hypothesis.p_adjust(_p_values(spark, d), "p", "hommel"), p_adjusted=8)


_ONEWAY = """
WITH g AS (SELECT {g} AS g, count({y})::DOUBLE AS n, avg({y}) AS m, coalesce(var_samp({y}), 0) AS v FROM {t} WHERE {y} IS NOT NULL AND {g} IS NOT NULL GROUP BY 1),
s AS (SELECT count(*) - 1.0::DOUBLE AS d1, sum(n) - count(*) AS d2, sum(n * (m - mm) ** 2) AS b, sum((n - 1) * v) AS w FROM g, (SELECT sum(n * m) / sum(n) AS mm FROM g))
SELECT d1 AS df, round(b / d1 / (w / d2), 6) AS f, round(b / (b + w), 8) AS eta_sq, round((b - d1 * w / d2) / (b + w + w / d2), 8) AS omega_sq, """ + _f_p("(b / d1 / (w / d2))", "d1", "d2") + " AS p_value FROM s"


def _first_line(df: DataFrame) -> DataFrame:
    return rounded(df.where("term <> 'Residuals'"), f=6, eta_sq=8, omega_sq=8, p_value=5).select("df", "f", "eta_sq", "omega_sq", "p_value")


@register(_ONEWAY.format(g="event_type", y="value", t="events"))
def anova_oneway(spark, d):
    return _first_line(av.anova_oneway(table(spark, d, "events"), "value", "event_type"))


@register("WITH c AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events WHERE value IS NOT NULL GROUP BY 1), z AS (SELECT e.event_type AS event_type, abs(value - m) AS value FROM events e JOIN c USING (event_type))" + _ONEWAY.format(g="event_type", y="value", t="z").replace("WITH g AS", ", g AS", 1))
def levene(spark, d):
    return _first_line(av.levene_test(table(spark, d, "events"), "value", "event_type"))


def _order_rows(spark, d):
    return table(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 100).cast("double").alias("cov"))


@register()
def anova_two_way(spark, d):
    out = None
    for kind in (1, 2, 3):
        a = av.anova(_order_rows(spark, d), "o_totalprice", ["o_orderstatus", "o_orderpriority"], ss_type=kind).withColumn("ss_type", F.lit(kind))
        out = a if out is None else out.unionByName(a)
    return rounded(out, sum_sq=1, mean_sq=1, f=5, p_value=6, eta_sq=7, partial_eta_sq=7, omega_sq=7)


@register("""
WITH o AS (SELECT o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS y, o_orderstatus AS g, (o_custkey % 100)::DOUBLE AS x FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL),
w AS (SELECT x - avg(x) OVER (PARTITION BY g) AS xw, y - avg(y) OVER (PARTITION BY g) AS yw, x - avg(x) OVER () AS xt, y - avg(y) OVER () AS yt, g FROM o),
s AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT g)::DOUBLE AS k, sum(yw * yw) - sum(xw * yw) ** 2 / sum(xw * xw) AS e, sum(yt * yt) - sum(xt * yt) ** 2 / sum(xt * xt) AS r0, sum(yw * yw) AS rg FROM w)
SELECT 'cov' AS term, 1.0::DOUBLE AS df, round((rg - e) / (e / (n - k - 1)), 5) AS f FROM s
UNION ALL SELECT 'o_orderstatus', k - 1, round((r0 - e) / (k - 1) / (e / (n - k - 1)), 5) FROM s""")
def ancova(spark, d):
    out = av.anova(_order_rows(spark, d), "o_totalprice", ["o_orderstatus"], ["cov"], ss_type=2)
    return rounded(out.where("term <> 'Residuals'"), f=5).select("term", "df", "f")


_PAIR_SQL = """
WITH g AS (SELECT event_type AS g, count(value)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1),
e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse, sum(n) - count(*) AS dfe FROM g),
p AS (SELECT a.g AS group1, b.g AS group2, b.m - a.m AS diff, a.n AS n1, b.n AS n2, a.v AS v1, b.v AS v2, mse, dfe FROM g a JOIN g b ON a.g < b.g, e)"""


@register(_PAIR_SQL + " SELECT group1, group2, round(diff, 6) AS diff, round(sqrt(mse * (1 / n1 + 1 / n2)), 6) AS std_error, dfe AS df FROM p")
def posthoc_tukey(spark, d):
    out = av.anova_posthoc(table(spark, d, "events"), "value", "event_type")
    return rounded(out, diff=6, std_error=6).select("group1", "group2", "diff", "std_error", "df")


@register(_PAIR_SQL + " SELECT group1, group2, round(diff / sqrt(v1 / n1 + v2 / n2), 6) AS statistic, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM p")
def posthoc_games_howell(spark, d):
    out = av.anova_posthoc(table(spark, d, "events"), "value", "event_type", "games-howell")
    return rounded(out, statistic=6, df=4).select("group1", "group2", "statistic", "df")


@register()
def anova_repeated(spark, d):
    return rounded(av.anova_rm(table(spark, d, "events"), "value", "user_id", "event_type"), sum_sq=4, sse=4, f=6, p_value=6, gg_eps=6, hf_eps=6, p_gg=6, p_hf=6)


@register("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL GROUP BY ALL")
def simple_regression(spark, d):
    out = regression.simple_ols(lines(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(out, slope=4, intercept=3, r_squared=8).select("l_returnflag", "n", "slope", "intercept", "r_squared")


@register("""
WITH m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb, count(*) AS n FROM lineitem),
s AS (SELECT any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb, sum((l_quantity - ma) ** 2) AS aa, sum((l_discount - mb) ** 2) AS bb, sum((l_quantity - ma) * (l_discount - mb)) AS ab,
  sum((l_quantity - ma) * (l_extendedprice - my)) AS ay, sum((l_discount - mb) * (l_extendedprice - my)) AS by_ FROM lineitem, m),
b AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM s),
e AS (SELECT any_value(n) - 3.0 AS df, sum((l_extendedprice - my - b1 * (l_quantity - ma) - b2 * (l_discount - mb)) ** 2) / (any_value(n) - 3) AS s2 FROM lineitem, b, (SELECT count(*) AS n FROM lineitem)),
t AS (SELECT '(Intercept)' AS term, my - b1 * ma - b2 * mb AS b, s2 * (1.0 / (df + 3) + (ma * ma * bb + mb * mb * aa - 2 * ma * mb * ab) / det) AS v, df FROM b, e
  UNION ALL SELECT 'l_quantity', b1, s2 * bb / det, df FROM b, e UNION ALL SELECT 'l_discount', b2, s2 * aa / det, df FROM b, e)
SELECT term, round(b, 3) AS estimate, round(sqrt(v), 4) AS std_error, round(b / sqrt(v), 5) AS statistic, """ + _t_p("(b / sqrt(v))", "df") + " AS p_value FROM t")
def linear_model(spark, d):
    out = regression.lm(lines(spark, d), "l_extendedprice", ["l_quantity", "l_discount"]).table(spark)
    return rounded(out, estimate=3, std_error=4, statistic=5, p_value=5).select("term", "estimate", "std_error", "statistic", "p_value")


@register("""
WITH g AS (SELECT l_returnflag AS f, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx,
  regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS rss, avg(l_quantity) AS m, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
s AS (SELECT sum(rss) / (sum(n) - 6) AS s2, sum(n) - 6 AS df FROM g),
v AS (SELECT f, a, b, s2 * (1 / n + m * m / sxx) AS va, s2 / sxx AS vb, df FROM g, s),
t AS (SELECT '(Intercept)' AS term, a AS x, va AS v, df FROM v WHERE f = 'A' UNION ALL SELECT 'l_quantity', b, vb, df FROM v WHERE f = 'A'
  UNION ALL SELECT concat('l_returnflag[', o.f, ']'), o.a - r.a, o.va + r.va, o.df FROM v o, v r WHERE r.f = 'A' AND o.f <> 'A'
  UNION ALL SELECT concat('l_quantity:l_returnflag[', o.f, ']'), o.b - r.b, o.vb + r.vb, o.df FROM v o, v r WHERE r.f = 'A' AND o.f <> 'A')
SELECT term, round(x, 3) AS estimate, round(sqrt(v), 4) AS std_error, round(x / sqrt(v), 4) AS statistic, """ + _t_p("(x / sqrt(v))", "df") + " AS p_value FROM t")
def linear_model_factors(spark, d):
    out = regression.lm(lines(spark, d), "l_extendedprice", ["l_quantity", C("l_returnflag"), ("l_quantity", C("l_returnflag"))]).table(spark)
    return rounded(out, estimate=3, std_error=4, statistic=4, p_value=5).select("term", "estimate", "std_error", "statistic", "p_value")


@register("""
WITH m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sd, count(*)::DOUBLE AS n FROM lineitem),
b AS (SELECT sum((l_quantity - mx) / sd * (l_extendedprice - my)) / (any_value(n) + 1000) / any_value(sd) AS b, any_value(my) AS my, any_value(mx) AS mx FROM lineitem, m)
SELECT '(Intercept)' AS term, round(my - b * mx, 3) AS estimate FROM b UNION ALL SELECT 'l_quantity', round(b, 3) FROM b""")
def ridge_regression(spark, d):
    return rounded(regression.ridge(lines(spark, d), "l_extendedprice", ["l_quantity"], 1000.0).table(spark), estimate=3).select("term", "estimate")


def _flagged(spark, d):
    return lines(spark, d).select((F.col("l_returnflag") == "R").cast("double").alias("y"), "l_quantity", "l_discount", "l_tax", "l_linenumber")


def _scoring_sql(tag: str, data: str, mu: str, slope: str, variance: str, start: str, deviance: str, free: bool, steps: int = 15) -> str:
    """Chained queries of Fisher scoring for one covariate; `data` has (y, x), the rest are expressions in eta, m = mu and y.

    The last, `<tag>`, has a row a term: estimate, std_error, deviance. `free`: the dispersion is estimated.
    """
    rows = lambda k: f"(SELECT *, ({slope}) AS s, ({variance}) AS v FROM (SELECT *, ({mu}) AS m FROM (SELECT y, x, a + b * x AS eta FROM {tag}d, {tag}b{k})))"
    ctes = [f"{tag}d AS MATERIALIZED ({data})", f"{tag}b0 AS MATERIALIZED (SELECT {start} AS a, 0.0::DOUBLE AS b FROM {tag}d)"]
    for k in range(steps + 1):
        ctes.append(f"{tag}s{k} AS MATERIALIZED (SELECT sum(s * s / v) AS w, sum(s * s / v * x) AS wx, sum(s * s / v * x * x) AS wxx, sum((y - m) * s / v) AS g, sum((y - m) * s / v * x) AS gx, sum((y - m) ** 2 / v) AS chi, sum({deviance}) AS dev, count(*) AS n FROM {rows(k)})")
        if k < steps:
            ctes.append(f"{tag}b{k + 1} AS MATERIALIZED (SELECT a + (wxx * g - wx * gx) / (w * wxx - wx * wx) AS a, b + (w * gx - wx * g) / (w * wxx - wx * wx) AS b FROM {tag}b{k}, {tag}s{k})")
    phi = "chi / (n - 2)" if free else "1.0"
    last = f"FROM {tag}b{steps}, {tag}s{steps}"
    ctes.append(f"{tag} AS (SELECT '(Intercept)' AS term, a AS estimate, sqrt({phi} * wxx / (w * wxx - wx * wx)) AS std_error, dev AS deviance {last} UNION ALL SELECT 'x', b, sqrt({phi} * w / (w * wxx - wx * wx)), dev {last})")
    return ", ".join(ctes)


#: Binomial pieces: mean and slope by link; the deviance of a 0/1 response.
_BIN_DEV = "-2 * ln(CASE WHEN y = 1 THEN m ELSE 1 - m END)"
_LOGIT = _scoring_sql("f", "SELECT (l_returnflag = 'R')::INT::DOUBLE AS y, l_quantity / 50 AS x FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL", "1 / (1 + exp(-eta))", "m * (1 - m)", "m * (1 - m)", "ln(avg(y) / (1 - avg(y)))", _BIN_DEV, False, 6)


@register(f"WITH {_LOGIT} SELECT CASE term WHEN 'x' THEN 'l_quantity' ELSE term END AS term, round(estimate / CASE term WHEN 'x' THEN 50 ELSE 1 END, 6) AS estimate, round(std_error / CASE term WHEN 'x' THEN 50 ELSE 1 END, 6) AS std_error, round(estimate / std_error, 4) AS statistic, {_chi2_p('(estimate / std_error * estimate / std_error)', '1.0')} AS p_value FROM f")
def logistic_regression(spark, d):
    out = regression.glm(_flagged(spark, d), "y", ["l_quantity"]).table(spark)
    return rounded(out, estimate=6, std_error=6, statistic=4, p_value=5).select("term", "estimate", "std_error", "statistic", "p_value")


@register("SELECT l_linestatus AS term, round(ln(avg(l_linenumber)), 6) AS estimate FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 UNION ALL SELECT 'l_linestatus[O]', round(ln(avg(l_linenumber) FILTER (l_linestatus = 'O') / avg(l_linenumber) FILTER (l_linestatus = 'F')), 6) FROM lineitem")
def poisson_regression(spark, d):
    out = regression.glm(lines(spark, d), "l_linenumber", [C("l_linestatus")], "poisson").table(spark)
    return rounded(out, estimate=6).select(F.when(F.col("term") == "(Intercept)", "F").otherwise(F.col("term")).alias("term"), "estimate")


def _families_sql() -> str:
    rows = lambda y: f"SELECT ({y})::DOUBLE AS y, l_quantity / 50 AS x FROM lineitem WHERE ({y}) IS NOT NULL AND l_quantity IS NOT NULL"
    price, count, flag = rows("l_extendedprice"), rows("l_linenumber"), rows("(l_returnflag = 'R')::INT")
    fits = {
        ("gaussian", "identity"): (price, "eta", "1.0", "1.0", "avg(y)", "(y - m) ** 2", True),
        ("gamma", "log"): (price, "exp(eta)", "m", "m * m", "ln(avg(y))", "2 * ((y - m) / m - ln(y / m))", True),
        ("inverse_gaussian", "log"): (price, "exp(eta)", "m", "m * m * m", "ln(avg(y))", "(y - m) ** 2 / (m * m * y)", True),
        ("quasipoisson", "log"): (count, "exp(eta)", "m", "m", "ln(avg(y))", "2 * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y - m))", True),
        ("binomial", "cloglog"): (flag, "1 - exp(-exp(eta))", "exp(eta - exp(eta))", "m * (1 - m)", "ln(-ln(1 - avg(y)))", _BIN_DEV, False),
        ("binomial", "cauchit"): (flag, "0.5 + atan(eta) / pi()", "1 / (pi() * (1 + eta * eta))", "m * (1 - m)", "tan(pi() * (avg(y) - 0.5))", _BIN_DEV, False),
    }
    ctes = ", ".join(_scoring_sql(f"f{i}", *f) for i, f in enumerate(fits.values()))
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT '{a}' AS family, '{l}' AS link, CASE term WHEN 'x' THEN 'q' ELSE term END AS term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(deviance, 1) AS deviance FROM f{i}" for i, (a, l) in enumerate(fits))


def _family_fits(spark, d, fits) -> DataFrame:
    rows = lines(spark, d).select("l_linenumber", (F.col("l_quantity") / 50).alias("q"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    out = None
    for y, fam, link in fits:
        fit = regression.glm(rows, y, ["q"], fam, link, max_iter=50)
        t = fit.table(spark).select(F.lit(fam).alias("family"), F.lit(fit.info["link"]).alias("link"), "term", "estimate", "std_error", F.lit(fit.info["deviance"]).alias("deviance"))
        out = t if out is None else out.unionByName(t)
    return rounded(out, estimate=4, std_error=4, deviance=1)


@register(_families_sql())
def glm_families(spark, d):
    """Every family with its own link, and the other binomial links but probit."""
    return _family_fits(spark, d, (("price", "gaussian", None), ("price", "gamma", "log"), ("price", "inverse_gaussian", "log"), ("l_linenumber", "quasipoisson", None), ("y", "binomial", "cloglog"), ("y", "binomial", "cauchit")))


@register()
def glm_probit(spark, d):
    """The probit link, whose mean DuckDB has no function for."""
    return _family_fits(spark, d, (("y", "binomial", "probit"),))


@register()
def negative_binomial(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    fit = regression.negative_binomial(rows, "n", ["v"])
    return rounded(fit.table(spark).withColumn("theta", F.lit(float(fit.info["theta"]))), estimate=4, std_error=4, theta=1).select("term", "estimate", "std_error", "theta")


@register()
def single_term_deletions(spark, d):
    return rounded(regression.drop1(_flagged(spark, d), "y", ["l_quantity", "l_discount", "l_tax"], "binomial"), change=5, statistic=5, p_value=6)


def _lives(spark, d):
    """Days from order to shipment as lifetimes; returned lines count as events."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    j = lines(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.abs(F.datediff("l_shipdate", "o_orderdate")) % 365 + 1
    return j.select(days.alias("time"), (F.col("l_returnflag") == "R").cast("int").alias("event"), "o_orderstatus", "l_quantity", "l_discount")


_LIVES = "(SELECT abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) % 365 + 1 AS time, (l_returnflag = 'R')::INT AS event, o_orderstatus AS g, l_quantity, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL AND o_orderdate IS NOT NULL AND l_returnflag IS NOT NULL)"


@register(f"""
WITH t AS (SELECT g AS o_orderstatus, time::DOUBLE AS time, sum(event) AS n_event, count(*) - sum(event) AS n_censor FROM {_LIVES} GROUP BY ALL),
r AS (SELECT *, sum(n_event + n_censor) OVER (PARTITION BY o_orderstatus ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_risk FROM t)
SELECT o_orderstatus, time, n_risk::BIGINT AS n_risk, n_event::BIGINT AS n_event, round(exp(sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE -1e9 END) OVER (PARTITION BY o_orderstatus ORDER BY time ROWS UNBOUNDED PRECEDING)), 6) AS survival FROM r""")
def survival_curve(spark, d):
    out = survival.kaplan_meier(_lives(spark, d), "time", "event", ["o_orderstatus"])
    return rounded(out, survival=6).select("o_orderstatus", "time", "n_risk", "n_event", "survival")


@register(f"""
WITH l AS {_LIVES}, g AS (SELECT DISTINCT g FROM l), t AS (SELECT time, sum(event)::DOUBLE AS d FROM l GROUP BY 1 HAVING sum(event) > 0),
n AS (SELECT time, sum(c) OVER (ORDER BY time DESC) AS r FROM (SELECT time, count(*) AS c FROM l GROUP BY 1)),
gn AS (SELECT g.g, k.time, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.g ORDER BY k.time DESC) AS rg FROM g CROSS JOIN (SELECT DISTINCT time FROM l) k LEFT JOIN (SELECT g, time, count(*) AS c FROM l GROUP BY ALL) c ON c.g = g.g AND c.time = k.time)
SELECT gn.g AS grp, (SELECT sum(event)::DOUBLE FROM l WHERE l.g = gn.g) AS observed, round(sum(d * rg / r), 4) AS expected FROM gn JOIN t USING (time) JOIN n USING (time) GROUP BY gn.g""")
def log_rank_test(spark, d):
    out = survival.log_rank(_lives(spark, d), "time", "event", "o_orderstatus")
    return rounded(out, expected=4).select("grp", "observed", "expected")


def _cox_sql(steps: int = 5) -> str:
    """Newton steps on Efron's partial likelihood, unrolled: sums by time, risk sets by running sums, a row for each death."""
    parts = {"0": "w", "1": "w * x", "2": "w * z", "11": "w * x * x", "12": "w * x * z", "22": "w * z * z"}
    ctes = [f"d AS (SELECT time, event, l_quantity / 10 AS x, l_discount * 10 AS z FROM {_LIVES} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)", "b0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for k in range(steps + 1):
        sums = ", ".join(f"sum({e}) AS s{n}, coalesce(sum({e}) FILTER (event = 1), 0) AS e{n}" for n, e in parts.items())
        risk = ", ".join(f"sum(s{n}) OVER (ORDER BY time DESC) AS r{n}" for n in parts)
        means = ", ".join(f"r{n} - i / n * e{n} AS a{n}" for n in parts)
        ctes += [
            f"t{k} AS (SELECT time, {sums}, sum(event)::DOUBLE AS n, coalesce(sum(x) FILTER (event = 1), 0) AS dx, coalesce(sum(z) FILTER (event = 1), 0) AS dz FROM (SELECT d.*, exp(b * x + c * z) AS w FROM d, b{k}) GROUP BY time)",
            f"r{k} AS (SELECT time, n, dx, dz, {risk}, {', '.join(f'e{m}' for m in parts)} FROM t{k})",
            f"a{k} AS (SELECT dx / n AS dx, dz / n AS dz, {means} FROM (SELECT *, unnest(range(0, n::BIGINT)) AS i FROM r{k} WHERE n > 0))",
            f"g{k} AS (SELECT sum(dx - a1 / a0) AS u, sum(dz - a2 / a0) AS v, sum(a11 / a0 - a1 * a1 / a0 / a0) AS p, sum(a12 / a0 - a1 * a2 / a0 / a0) AS q, sum(a22 / a0 - a2 * a2 / a0 / a0) AS s FROM a{k})",
        ]
        if k < steps:
            ctes.append(f"b{k + 1} AS (SELECT b + (s * u - q * v) / (p * s - q * q) AS b, c + (p * v - q * u) / (p * s - q * q) AS c FROM b{k}, g{k})")
    ctes.append(f"f AS (SELECT 'l_quantity' AS term, b / 10 AS x, sqrt(s / (p * s - q * q)) / 10 AS e FROM b{steps}, g{steps} UNION ALL SELECT 'l_discount', c * 10, sqrt(p / (p * s - q * q)) * 10 FROM b{steps}, g{steps})")
    return f"WITH {', '.join(ctes)} SELECT term, round(x, 6) AS estimate, round(e, 6) AS std_error, round(x / e, 4) AS statistic, {_chi2_p('(x / e * x / e)', '1.0')} AS p_value FROM f"


@register(_cox_sql())
def cox_regression(spark, d):
    out = survival.coxph(_lives(spark, d), "time", "event", ["l_quantity", "l_discount"]).table(spark)
    return rounded(out, estimate=6, std_error=6, statistic=4, p_value=5).select("term", "estimate", "std_error", "statistic", "p_value")


@register("SELECT period, count(*) AS n, sum(y)::BIGINT AS events FROM (SELECT unnest(range(1, least(time, 30) + 1)) AS period, least(time, 30) AS t, event FROM " + _LIVES + ") x, LATERAL (SELECT (period = t AND event = 1)::INT AS y) GROUP BY 1")
def person_periods(spark, d):
    rows = _lives(spark, d).withColumn("time", F.least("time", F.lit(30)))
    return survival.person_period(rows, "time", "event").groupBy(F.col("period").cast("long").alias("period")).agg(F.count("*").alias("n"), F.sum("y").alias("events"))


@register()
def discrete_time_hazard(spark, d):
    rows = _lives(spark, d).withColumn("time", F.ceil(F.col("time") / 60))
    return rounded(survival.discrete_time(rows, "time", "event", ["l_quantity"]).table(spark), estimate=5, std_error=5).select("term", "estimate", "std_error")


def _daily(spark, d):
    o = table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").alias("w")).agg(F.sum("o_totalprice").alias("y"))
    return ts.positions(o, "w", "y")


_DAILY = "(SELECT row_number() OVER (ORDER BY w) AS t, y FROM (SELECT date_trunc('week', o_orderdate) AS w, sum(o_totalprice) AS y FROM orders GROUP BY 1))"


@register(f"SELECT 'all' AS key, t::INT AS t, round(y - lag(y, 1) OVER (ORDER BY t), 2) AS y FROM {_DAILY} QUALIFY lag(y) OVER (ORDER BY t) IS NOT NULL")
def differences(spark, d):
    return rounded(ts.diff(_daily(spark, d)), y=2)


@register(f"WITH c AS (SELECT t, y - avg(y) OVER () AS c FROM {_DAILY}), k AS (SELECT unnest(range(0, 11))::INT AS lag) SELECT 'all' AS key, lag, round(sum(a.c * b.c) / (SELECT sum(c * c) FROM c), 6) AS acf FROM k, c a JOIN c b ON b.t = a.t - lag GROUP BY lag")
def autocorrelation(spark, d):
    return rounded(ts.acf(_daily(spark, d)), acf=6)


def _pacf_sql(lags: int = 10) -> str:
    """The Levinson-Durbin recursion unrolled: f holds the last predictor, v its error."""
    ctes = [f"c AS (SELECT t, y - avg(y) OVER () AS c FROM {_DAILY})", f"r AS (SELECT list(r ORDER BY lag) AS r FROM (SELECT lag, sum(a.c * b.c) / (SELECT sum(c * c) FROM c) AS r FROM range(0, {lags + 1}) k(lag), c a JOIN c b ON b.t = a.t - lag GROUP BY lag))",
            "s1 AS (SELECT r, [r[2]] AS f, 1 - r[2] * r[2] AS v FROM r)"]
    for k in range(2, lags + 1):
        ctes.append(f"a{k} AS (SELECT r, f, v, (r[{k + 1}] - list_sum(list_transform(range(1, {k}), lambda j: f[j] * r[{k + 1} - j]))) / v AS a FROM s{k - 1})")
        ctes.append(f"s{k} AS (SELECT r, list_append(list_transform(range(1, {k}), lambda j: f[j] - a * f[{k} - j]), a) AS f, v * (1 - a * a) AS v FROM a{k})")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT 'all' AS key, {k}::INT AS lag, round(f[{k}], 6) AS pacf FROM s{k}" for k in range(1, lags + 1))


@register(_pacf_sql())
def partial_autocorrelation(spark, d):
    return rounded(ts.pacf(_daily(spark, d)), pacf=6)


@register(f"WITH s AS (SELECT t, y, CASE WHEN count(*) OVER w = 5 THEN (sum(y) OVER w - (lag(y, 2) OVER (ORDER BY t) + lead(y, 2) OVER (ORDER BY t)) / 2) / 4 END AS trend FROM {_DAILY} WINDOW w AS (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), f AS (SELECT (t - 1) % 4 AS p, avg(y - trend) AS f FROM s GROUP BY 1), g AS (SELECT p, f - avg(f) OVER () AS seasonal FROM f) SELECT 'all' AS key, t::INT AS t, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal, round(y - trend - seasonal, 5) AS remainder FROM s JOIN g ON (t - 1) % 4 = p")
def seasonal_decomposition(spark, d):
    return rounded(ts.decompose(_daily(spark, d), 4), trend=5, seasonal=5, remainder=5).drop("y")


@register()
def unit_root_tests(spark, d):
    k = ts.kpss(_daily(spark, d)).select("key", F.round("statistic", 6).alias("kpss"), "p_value")
    a = ts.adf(_daily(spark, d)).select("key", F.round("statistic", 6).alias("adf"))
    return k.join(a, "key").join(ts.ndiffs(_daily(spark, d)), "key")


def _by_priority(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("w")).agg(F.avg("o_totalprice").alias("y"))
    return ts.positions(o, "w", "y", "o_orderpriority")


@register()
def exponential_smoothing(spark, d):
    return rounded(ts.ets(_by_priority(spark, d), trend=True), forecast=0, sse=0, aic=1, alpha=2, beta=2).select("key", "h", "forecast")


@register()
def arima_batch(spark, d):
    return rounded(ts.arima(_by_priority(spark, d), (1, 0, 1)), forecast=0, std_error=0, sigma2=-3, aic=1).select("key", "h", "forecast", "std_error")


@register()
def arima_order_search(spark, d):
    return rounded(ts.auto_arima(_by_priority(spark, d), 2, 1), aic=1)


@register()
def principal_components(spark, d):
    return rounded(multivariate.pca(lines(spark, d), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], scale=True), loading=5, sdev=6, proportion=6)


@register()
def factors(spark, d):
    rows = lines(spark, d).select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_discount", "l_tax")
    return rounded(multivariate.factor_analysis(rows, ["l_quantity", "l_extendedprice", "net", "l_discount", "l_tax"], 1), loading=3, uniqueness=3).select("variable", "factor", "loading", "uniqueness")


def _holes(spark, d):
    o = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_acctbal") * 0.3 + F.col("c_custkey") % 97).alias("score"))
    return o.withColumns({"nation": F.when(F.col("c_custkey") % 7 != 0, F.col("nation")), "score": F.when(F.col("c_custkey") % 5 != 0, F.col("score"))})


@register("SELECT concat('1', (c_custkey % 7 <> 0)::INT, (c_custkey % 5 <> 0)::INT) AS pattern, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY 1")
def missing_patterns(spark, d):
    return missing.patterns(_holes(spark, d), ["c_acctbal", "nation", "score"])


@register()
def mvn_estimation(spark, d):
    return rounded(missing.mvn_mle(_holes(spark, d), ["c_acctbal", "nation", "score"]), mean_a=3, cov=0, log_lik=3).select("a", "b", "mean_a", "cov", "log_lik")


@register()
def little_mcar_test(spark, d):
    return rounded(missing.little_mcar(_holes(spark, d), ["c_acctbal", "nation", "score"]), statistic=4, p_value=5)


@register()
def multiple_imputation(spark, d):
    """Means of the imputed variable by imputation, pooled."""
    m = missing.mice(_holes(spark, d), ["c_acctbal", "nation", "score"], m=5, max_iter=3, key="c_custkey")
    est = m.groupBy("imputation").agg(F.avg("score").alias("estimate"), (F.stddev("score") / F.sqrt(F.count("*"))).alias("std_error")).withColumn("term", F.lit("score"))
    return missing.pool(est, ["term"])


@register("SELECT g AS term, round(avg(e), 6) AS estimate, round(sqrt(avg(s * s) + (1 + 1.0 / count(*)) * var_samp(e)), 6) AS std_error FROM (SELECT o_orderstatus AS g, o_orderpriority AS i, avg(o_totalprice) / 1000 AS e, stddev_samp(o_totalprice) / 1000 / sqrt(count(*)) AS s FROM orders GROUP BY ALL) GROUP BY 1")
def rubin_pooling(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("term"), "o_orderpriority").agg((F.avg("o_totalprice") / 1000).alias("estimate"), (F.stddev_samp("o_totalprice") / 1000 / F.sqrt(F.count("*"))).alias("std_error"))
    return rounded(missing.pool(o, ["term"]), estimate=6, std_error=6).select("term", "estimate", "std_error")


@register()
def bootstrap_mean(spark, d):
    rows = lines(spark, d).withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    b = montecarlo.boot_means(rows, "l_quantity", "line", 100, by=["l_returnflag"])
    return b.groupBy("l_returnflag").agg(F.avg("stat").alias("mean"), F.stddev("stat").alias("std_error"), F.count("*").alias("replicates"))


@register()
def bootstrap_median(spark, d):
    import numpy as np

    seen, reps = montecarlo.boot(table(spark, d, "supplier"), ["s_acctbal"], lambda a: float(np.median(a)), 400)
    rows = [(k, *(float(v) for v in montecarlo.boot_ci(seen, reps, k))) for k in ("normal", "basic", "percentile", "bca")]
    return spark.createDataFrame([(seen, *r) for r in rows], "estimate double, kind string, conf_low double, conf_high double")


@register()
def permutation(spark, d):
    return montecarlo.permutation_test(table(spark, d, "events"), "value", "event_type", ("view", "click"), 500)


@register()
def multinomial_regression(spark, d):
    rows = lines(spark, d).select("l_returnflag", (F.col("l_quantity") / 50).alias("q"), "l_discount")
    return rounded(categorical.multinomial(rows, "l_returnflag", ["q", "l_discount"]).table(spark), estimate=5, std_error=5).select("term", "estimate", "std_error")


@register()
def ordinal_regression(spark, d):
    rows = table(spark, d, "orders").select((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"), (F.col("o_totalprice") / 1e5).alias("x"))
    return rounded(categorical.ordinal(rows, "y", ["x"]).table(spark), estimate=5, std_error=5).select("term", "estimate", "std_error")


@register()
def mixed_model(spark, d):
    fit = mixed.lmm(table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", (F.col("o_totalprice") / 1e5).alias("y"), (F.col("c_acctbal") / 1e4).alias("x")), "y", ["x"], "o_custkey")
    return rounded(fit.table(spark).withColumns({"sigma2": F.lit(fit.info["sigma2"]), "tau2": F.lit(fit.info["tau2"])}), estimate=4, std_error=4, sigma2=4, tau2=3).select("term", "estimate", "std_error", "sigma2", "tau2")


@register()
def additive_model(spark, d):
    rows = lines(spark, d).select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_partkey") % 50).cast("double").alias("p"))
    return rounded(mixed.gam(rows, "y", ["l_quantity", "p"], 6), value=2, edf=1, intercept=2).select("smooth", "knot", "value", "intercept")


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 7) AS var FROM events GROUP BY ALL")
def windowed_stats(spark, d):
    return rounded(windowed_moments(table(spark, d, "events"), "ts", "value", ["event_type"]), mean=6, var=7).select("start", "event_type", "n", "mean", "var")


@register("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(regr_slope(value, user_id), 6) AS slope FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1")
def windowed_fit(spark, d):
    return rounded(windowed_regression(table(spark, d, "events"), "ts", "user_id", "value", width="1 day"), slope=6).select("start", "n", "slope")


@register("""
WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS mx, count(*)::DOUBLE AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(a + b * l_quantity, 3) AS fitted, round(l_extendedprice - a - b * l_quantity, 3) AS residual, round(1 / n + (l_quantity - mx) ** 2 / sxx, 9) AS leverage FROM lineitem, b""")
def regression_diagnostics(spark, d):
    fit = regression.lm(lines(spark, d), "l_extendedprice", ["l_quantity"])
    out = regression.diagnostics(lines(spark, d), "l_extendedprice", ["l_quantity"], fit, ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(out.drop("studentised", "cooks_distance"), fitted=3, residual=3, leverage=9)


@register()
def deviance_analysis(spark, d):
    return rounded(regression.deviance_table(_flagged(spark, d), "y", ["l_quantity", "l_discount"]), deviance=5, resid_dev=3, statistic=5, p_value=6)


@register()
def profile_interval(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_acctbal") > 5000).cast("double").alias("y"), F.col("s_nationkey").cast("double").alias("n"))
    lo, hi = regression.profile_conf_int(rows, "y", ["n"], "n")
    return rounded(spark.createDataFrame([(lo, hi)], "conf_low double, conf_high double"), conf_low=3, conf_high=3)


@register("SELECT y AS response, t AS term, round(CASE WHEN t = 'l_tax' THEN b ELSE a END, 6) AS estimate FROM (SELECT 'l_quantity' AS y, regr_slope(l_quantity, l_tax) AS b, regr_intercept(l_quantity, l_tax) AS a FROM lineitem UNION ALL SELECT 'l_discount', regr_slope(l_discount, l_tax), regr_intercept(l_discount, l_tax) FROM lineitem), (VALUES ('(Intercept)'), ('l_tax')) v(t)")
def batched_regression(spark, d):
    return rounded(regression.batched_ols(lines(spark, d), ["l_quantity", "l_discount"], ["l_tax"]), estimate=6).select("response", "term", "estimate")


@register(f"""
WITH t AS (SELECT g AS o_orderstatus, time::DOUBLE AS time, sum(event) AS n_event, count(*) - sum(event) AS n_censor FROM {_LIVES} GROUP BY ALL),
r AS (SELECT *, sum(n_event + n_censor) OVER (PARTITION BY o_orderstatus ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_risk FROM t),
s AS (SELECT o_orderstatus, time, round(exp(sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE -1e9 END) OVER (PARTITION BY o_orderstatus ORDER BY time ROWS UNBOUNDED PRECEDING)), 12) AS s FROM r)
SELECT o_orderstatus, CASE WHEN max((s = 0.5)::INT) = 1 THEN (min(time) FILTER (s <= 0.5) + coalesce(min(time) FILTER (s < 0.5), min(time) FILTER (s <= 0.5))) / 2 ELSE min(time) FILTER (s <= 0.5) END AS median
FROM s GROUP BY 1""")
def survival_medians(spark, d):
    return survival.median_survival(survival.kaplan_meier(_lives(spark, d), "time", "event", ["o_orderstatus"]), ["o_orderstatus"])


@register(f"""
WITH l AS (SELECT (time % 10)::DOUBLE AS s, (time % 10 + time)::DOUBLE AS t, event AS e FROM {_LIVES}), k AS (SELECT t, sum(e) AS n_event FROM l GROUP BY 1)
SELECT t AS time, (SELECT count(*) FROM l WHERE l.s < k.t AND l.t >= k.t) AS n_risk, n_event::BIGINT AS n_event FROM k""")
def delayed_entry_curve(spark, d):
    rows = _lives(spark, d).select((F.col("time") % 10).alias("s"), (F.col("time") % 10 + F.col("time")).alias("t"), "event")
    return survival.kaplan_meier_entry(rows, "s", "t", "event").select("time", "n_risk", "n_event")


@register(f"""
WITH d AS (SELECT time AS t, event AS e, l_discount AS s, count(*) AS n FROM {_LIVES} WHERE l_discount IS NOT NULL GROUP BY ALL),
p AS (SELECT sign(a.s - b.s) AS o, a.n * b.n AS k FROM d a JOIN d b ON a.e = 1 AND (b.t > a.t OR b.t = a.t AND b.e = 0)),
q AS (SELECT coalesce(sum(k) FILTER (o > 0), 0)::BIGINT AS concordant, coalesce(sum(k) FILTER (o < 0), 0)::BIGINT AS discordant, coalesce(sum(k) FILTER (o = 0), 0)::BIGINT AS tied FROM p)
SELECT concordant, discordant, tied, (concordant + tied / 2.0::DOUBLE) / (concordant + discordant + tied) AS c FROM q""")
def harrell_concordance(spark, d):
    return survival.concordance(_lives(spark, d), "time", "event", "l_discount")


@register()
def proportional_hazards_test(spark, d):
    rows = _lives(spark, d)
    fit = survival.coxph(rows, "time", "event", ["l_quantity", "l_discount"])
    return rounded(survival.cox_zph(rows, "time", "event", ["l_quantity", "l_discount"], fit), statistic=5, p_value=6)


@register()
def stl_decomposition(spark, d):
    return rounded(ts.stl(_by_priority(spark, d), 12), seasonal=2, trend=2, remainder=2)


@register()
def whittle_batch(spark, d):
    return ts.whittle(_by_priority(spark, d), 1, 0).select("key", F.round(F.element_at("ar", 1), 3).alias("ar1"), F.round("sigma2", -4).alias("sigma2"))


@register()
def arima_exact(spark, d):
    return ts.arima_ml(_by_priority(spark, d), (1, 0, 0)).select("key", F.round(F.element_at("ar", 1), 3).alias("ar1"), F.round("aic", 1).alias("aic"))


@register()
def generalised_mixed_model(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("value") > 50).cast("double").alias("y"), (F.hour("ts") / 24).alias("x"))
    fit = mixed.glmm(rows, "y", ["x"], "user_id")
    return rounded(fit.table(spark).withColumn("tau", F.lit(fit.info["tau"])), estimate=3, std_error=3, tau=2).select("term", "estimate", "std_error", "tau")


@register()
def imputation_chains(spark, d):
    m = missing.mice_chains(_holes(spark, d), ["c_acctbal", "nation", "score"], {"nation": "norm"}, m=4, max_iter=3, key="c_custkey")
    return m.groupBy("imputation").agg(F.count("score").alias("n"), F.round(F.avg("score"), 3).alias("score"), F.round(F.avg("nation"), 3).alias("nation"))


@register()
def wilcoxon_interval(spark, d):
    return hypothesis.wilcox_conf_int(table(spark, d, "events"), "value", group="event_type", groups=("view", "click"))
