"""Queries on statistics, curves and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered as o
from ..operators import rollups as r
from ..operators import statistics as st
from ..streaming.events import windowed
from .registry import Tables, query

MID = "(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE AS midrank FROM {t})"


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("midrank", f"SELECT event_id, midrank FROM {MID.format(by='event_type', v='value', t='events')}")
def midrank(t: Tables) -> DataFrame:
    return o.midrank(t.events, ["event_type"], "value").select("event_id", "midrank")


@query("weighted_midrank", "WITH s AS (SELECT *, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS upto, sum(l_linenumber) OVER (PARTITION BY l_suppkey, l_quantity) AS tied FROM lineitem) SELECT l_orderkey, l_linenumber, upto - tied + (tied + 1) / 2.0::DOUBLE AS midrank FROM s")
def weighted_midrank(t: Tables) -> DataFrame:
    return o.weighted_midrank(t.lineitem, ["l_suppkey"], "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "midrank")


@query("correlations", f"WITH a AS (SELECT *, midrank AS ra FROM {MID.format(by='l_suppkey', v='l_quantity', t='lineitem')}), b AS (SELECT l_suppkey, l_quantity, l_extendedprice, ra, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0::DOUBLE AS rb FROM a) SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM b GROUP BY l_suppkey")
def correlations(t: Tables) -> DataFrame:
    return _round(st.correlations(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice"), "pearson", "spearman")


@query("top_intersection", "WITH m AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) <= 20 AS ta, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) <= 20 AS tb FROM lineitem) SELECT l_suppkey, round(sum((ta AND tb)::INT) / sum(ta::INT), 6) AS overlap FROM m GROUP BY l_suppkey")
def top_intersection(t: Tables) -> DataFrame:
    keyed = t.lineitem.withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return _round(st.top_intersection(keyed, ["l_suppkey"], "l_quantity", "l_extendedprice", "key", 20), "overlap")


@query("mwu_z_event_value", f"WITH m AS {MID.format(by='event_type', v='value', t='events')}, s AS (SELECT event_type, sum((user_id % 2 = 0)::INT) AS n1, count(*) - sum((user_id % 2 = 0)::INT) AS n2, sum(CASE WHEN user_id % 2 = 0 THEN midrank ELSE 0 END) AS r1 FROM m GROUP BY event_type) SELECT event_type, n1::BIGINT AS n1, n2::BIGINT AS n2, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, round((r1 - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n2 / 2.0::DOUBLE) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0::DOUBLE), 3) AS z FROM s WHERE n1 > 0 AND n2 > 0")
def mwu_z_event_value(t: Tables) -> DataFrame:
    return st.mann_whitney(t.events.withColumn("even", F.col("user_id") % 2 == 0), ["event_type"], "value", "even").drop("p")


@query("two_sample_z", "WITH s AS (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS m1, avg(value) FILTER (user_id % 2 <> 0) AS m2, stddev_pop(value) FILTER (user_id % 2 = 0) AS s1, stddev_pop(value) FILTER (user_id % 2 <> 0) AS s2, count(value) FILTER (user_id % 2 = 0) AS n1, count(value) FILTER (user_id % 2 <> 0) AS n2 FROM events GROUP BY 1) SELECT event_type, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round((m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2), 6) AS z FROM s")
def two_sample_z(t: Tables) -> DataFrame:
    return _round(st.two_sample_z(t.events.withColumn("even", F.col("user_id") % 2 == 0), ["event_type"], "value", "even"), "mean1", "mean2", "z")


@query("bh_fdr", "WITH p AS (SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY value) / count(*) OVER (PARTITION BY event_type) AS q FROM events), sq AS (SELECT event_type, event_id, q * q * q AS p FROM p), w AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS raw FROM sq) SELECT event_id, round(least(min(raw) OVER (PARTITION BY event_type ORDER BY p, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 9) AS p_adjusted FROM w")
def bh_fdr(t: Tables) -> DataFrame:
    w, whole = o.Window.partitionBy("event_type").orderBy("value"), o.Window.partitionBy("event_type")
    q = F.rank().over(w) / F.count("*").over(whole)
    return st.bh_fdr(t.events.withColumn("q", q).withColumn("p", F.col("q") * F.col("q") * F.col("q")), ["event_type"], "p", "event_id").select("event_id", F.round("p_adjusted", 9).alias("p_adjusted"))


@query("roc_auc_by_source", f"WITH m AS {MID.format(by='source', v='score', t='scored')}, s AS (SELECT source, sum(quality) AS n1, count(*) AS n, sum(CASE WHEN quality = 1 THEN midrank ELSE 0 END) AS r FROM m GROUP BY source) SELECT source, n1::BIGINT AS n1, n, CASE WHEN n1 > 0 AND n1 < n THEN round((r - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * (n - n1)), 6) END AS auc FROM s", ("scored",))
def roc_auc_by_source(t: Tables) -> DataFrame:
    return _round(st.roc_auc(t.scored, ["source"], "score", "quality"), "auc")


CURVE = "c AS (SELECT lang, score, sum(quality) AS p, count(*) AS n FROM scored GROUP BY ALL), k AS (SELECT lang, score, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS seen, sum(p) OVER (PARTITION BY lang) AS pos FROM c)"


@query("average_precision", f"WITH {CURVE} SELECT lang, round(sum(part), 6) AS ap FROM (SELECT lang, tp / seen * (tp / nullif(pos, 0) - coalesce(lag(tp / nullif(pos, 0)) OVER (PARTITION BY lang ORDER BY score DESC), 0)) AS part FROM k) GROUP BY lang", ("scored",))
def average_precision(t: Tables) -> DataFrame:
    return _round(st.average_precision(t.scored, ["lang"], "score", "quality"), "ap")


@query("cumulative_precision", "SELECT doc_id, row_number() OVER w AS rank, round(avg(quality) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS precision, round(sum(quality) OVER (w ROWS UNBOUNDED PRECEDING) / nullif(sum(quality) OVER (PARTITION BY lang), 0), 6) AS recall FROM scored WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id)", ("scored",))
def cumulative_precision(t: Tables) -> DataFrame:
    curve = o.precision_curve(t.scored, ["lang"], "score", "doc_id", "quality")
    return curve.select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("score_at_cut", "WITH c AS (SELECT lang, score, row_number() OVER w AS rank, avg(quality) OVER (w ROWS UNBOUNDED PRECEDING) AS precision FROM scored WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id)) SELECT lang, arg_max(score, rank) AS score, max(rank) AS rank FROM c WHERE precision >= 0.8 GROUP BY lang", ("scored",))
def score_at_cut(t: Tables) -> DataFrame:
    return o.score_at_cut(o.precision_curve(t.scored, ["lang"], "score", "doc_id", "quality"), ["lang"], "score", 0.8).withColumn("rank", F.col("rank").cast("long"))


@query("trailing_precision", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM scored) SELECT doc_id, round(CASE WHEN rank < 5 THEN avg(CASE WHEN rank <= 5 THEN quality END) OVER (PARTITION BY lang) ELSE avg(quality) OVER (PARTITION BY lang ORDER BY rank ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) END, 6) AS trailing FROM r", ("scored",))
def trailing_precision(t: Tables) -> DataFrame:
    return _round(o.trailing_mean(t.scored, ["lang"], "score", "doc_id", "quality").select("doc_id", "trailing"), "trailing")


@query("smoothed_precision", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank, quality FROM scored) SELECT doc_id, round(s, 6) AS smoothed FROM (SELECT doc_id, rank, avg(quality) OVER (PARTITION BY lang ORDER BY rank ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS s FROM r) WHERE (rank - 1) % 5 = 0", ("scored",))
def smoothed_precision(t: Tables) -> DataFrame:
    return _round(o.smoothed_precision(t.scored, ["lang"], "score", "doc_id", "quality", 30, 5).select("doc_id", "smoothed"), "smoothed")


@query("cdf_max_gap", "WITH a AS (SELECT lang, score, sum(toxic) AS m, count(*) AS n FROM scored GROUP BY ALL), g AS (SELECT lang, score, abs(sum(m) OVER w / nullif(sum(m) OVER (PARTITION BY lang), 0) - sum(n - m) OVER w / nullif(sum(n - m) OVER (PARTITION BY lang), 0)) AS gap FROM a WINDOW w AS (PARTITION BY lang ORDER BY score)) SELECT lang, score, round(gap, 6) AS gap FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY gap DESC, score) = 1", ("scored",))
def cdf_max_gap(t: Tables) -> DataFrame:
    return _round(o.cdf_gap(t.scored.withColumn("m", F.col("toxic") == 1), ["lang"], "score", "m"), "gap")


@query("empirical_cdf_at", "SELECT lang, round(avg((score <= 1000)::INT), 6) AS share FROM scored GROUP BY lang", ("scored",))
def empirical_cdf_at(t: Tables) -> DataFrame:
    return _round(o.share_within(t.scored, ["lang"], "score", 1000), "share")


@query("calibration_bins", "WITH b AS (SELECT floor(score / 10000 * 20)::INT AS bin, quality FROM scored WHERE score >= 0 AND score < 10000) SELECT bin, count(*) AS n, round(avg(quality), 6) AS mean, median(quality)::DOUBLE AS median, quantile_cont(quality, 0.25)::DOUBLE AS q1, quantile_cont(quality, 0.75)::DOUBLE AS q3, round(stddev_pop(quality) / sqrt(count(*)), 6) AS sterr FROM b GROUP BY bin HAVING count(*) >= 2", ("scored",))
def calibration_bins(t: Tables) -> DataFrame:
    return _round(st.calibration_bins(t.scored, "score", "quality", 0, 10000, 20), "mean", "sterr")


@query("quantile_bins_overlapping", "WITH n AS (SELECT *, ntile(16) OVER (PARTITION BY lang ORDER BY score, doc_id) AS part FROM scored), b AS (SELECT lang, quality, unnest(range(greatest(part - 1, 1), least(part, 15) + 1)) AS bin FROM n) SELECT lang, bin::BIGINT AS bin, count(*) AS n, round(avg(quality), 6) AS mean FROM b GROUP BY ALL", ("scored",))
def quantile_bins_overlapping(t: Tables) -> DataFrame:
    dealt = o.overlapping_quantiles(t.scored, ["lang"], "score", "doc_id")
    return _round(dealt.groupBy("lang", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("quality").alias("mean")), "mean")


@query("threshold_scan", f"WITH m AS {MID.format(by='l_returnflag', v='l_extendedprice', t='lineitem')}, a AS (SELECT l_returnflag, l_quantity, sum(midrank) AS r, count(*) AS c FROM m GROUP BY ALL), s AS (SELECT l_returnflag, l_quantity, sum(c) OVER w AS n1, sum(r) OVER w AS r1, sum(c) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER w AS place FROM a WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)), z AS (SELECT l_returnflag, l_quantity, n1, round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1::DOUBLE * (n - n1) * (n + 1) / 12), 3) AS z FROM s WHERE place <= 500 AND n1 >= 11 AND n1 <= 0.1 * n) SELECT l_returnflag, l_quantity AS cut, n1::BIGINT AS n_bound, z FROM z QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(z) DESC, l_quantity DESC) = 1")
def threshold_scan(t: Tables) -> DataFrame:
    return st.threshold_scan(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("enrichment_counts", "WITH k AS (SELECT DISTINCT p_partkey AS gene, p_type AS term FROM part), c AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS gene FROM lineitem), n AS (SELECT count(*) AS total FROM part), t AS (SELECT term, count(*) AS w FROM k GROUP BY term), z AS (SELECT s, count(*) AS size FROM c GROUP BY s), h AS (SELECT s, term, count(*) AS a FROM c JOIN k USING (gene) GROUP BY ALL) SELECT s AS \"set\", term, a, size - a AS b, w - a AS c, total - size - w + a AS d FROM h JOIN t USING (term) JOIN z USING (s), n")
def enrichment_counts(t: Tables) -> DataFrame:
    genes = t.part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"))
    return st.enrichment_counts(t.lineitem.select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("gene")), genes, genes)


def choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


#: Fisher's p of at least a in the table a b / c d, and the upper tail of the normal distribution (Simpson's rule), as SQL.
FISHER = f"least(1.0::DOUBLE, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda x: exp({choose('(a + b)', 'x')} + {choose('(c + d)', '(a + c - x)')} - {choose('(a + b + c + d)', '(a + c)')}))))"
TAIL = "(list_sum(list_transform(range(0, 20001), lambda k: (CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({z} + k * 0.0005::DOUBLE, 2) / 2))) * 0.0005 / 3 / sqrt(2 * pi()))"


@query(
    "go_enrichment",
    f"""WITH g AS (SELECT DISTINCT p_partkey AS gene, p_type AS term FROM part), chosen AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS gene FROM lineitem WHERE l_partkey IN (SELECT gene FROM g)),
    t AS (SELECT h.s, h.term, a, (SELECT count(*) FROM chosen c WHERE c.s = h.s) - a AS b, (SELECT count(*) FROM g WHERE g.term = h.term) - a AS c FROM (SELECT s, term, count(*) AS a FROM chosen JOIN g USING (gene) GROUP BY ALL) h),
    f AS (SELECT *, (SELECT count(DISTINCT gene) FROM g) - a - b - c AS d FROM t), m AS (SELECT *, (a + c) / (a + b + c + d) AS m FROM f),
    p AS (SELECT s, term, a, b, c, d, CASE WHEN a > 1 AND a / (a + b) > m + sqrt(m - 2 * m * m + m * m * m) THEN {FISHER} ELSE 1.0 END AS p FROM m),
    raw AS (SELECT *, p * count(*) OVER (PARTITION BY s) / row_number() OVER (PARTITION BY s ORDER BY p, term) AS raw FROM p)
    SELECT s AS "set", term, a, b, c, d, round(p, 9) AS p, round(least(1.0, min(raw) OVER (PARTITION BY s ORDER BY p DESC, term DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM raw""",
)
def go_enrichment(t: Tables) -> DataFrame:
    genes = t.part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"))
    found = st.go_enrichment(t.lineitem.select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("gene")), genes, genes)
    return found.withColumns({c: F.round(c, 9) for c in ("p", "p_adjusted")})


@query(
    "fisher_scan",
    f"WITH tried AS (SELECT lang, quality = 1 AS m, sign, i / 50.0::DOUBLE AS cut, sign * (score / 10000 - 0.2::DOUBLE) >= i / 50.0::DOUBLE AS inside FROM scored, range(1, 50) r(i), (VALUES (1), (-1)) v(sign)), counts AS (SELECT lang, cut, sign, count(*) FILTER (inside AND m) AS a, count(*) FILTER (inside AND NOT m) AS b, count(*) FILTER (NOT inside AND m) AS c, count(*) FILTER (NOT inside AND NOT m) AS d FROM tried GROUP BY ALL), tested AS (SELECT *, {FISHER} AS p FROM counts) SELECT lang, cut, sign, a, b, c, d, round(p, 9) AS p FROM tested QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(p, 9), cut, sign DESC) = 1",
    ("scored",),
)
def fisher_scan(t: Tables) -> DataFrame:
    return st.fisher_scan(t.scored.withColumn("m", F.col("quality") == 1).withColumn("x", F.col("score") / 10000 - 0.2), ["lang"], "x", "m", [i / 50 for i in range(1, 50)]).withColumn("p", F.round("p", 9))


@query(
    "delong_test",
    f"""WITH s AS (SELECT lang, quality AS y, score AS a, -abs(score - 1500) AS b FROM scored),
    r AS (SELECT *, {", ".join(f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE AS {n}_{v}" for v in "ab" for n, by in (("every", "lang"), ("own", "lang, y")))}, count(*) FILTER (y = 1) OVER (PARTITION BY lang) AS n1, count(*) FILTER (y = 0) OVER (PARTITION BY lang) AS n0 FROM s),
    v AS (SELECT lang, y, n1, n0, {", ".join(f"CASE WHEN y = 1 THEN (every_{v} - own_{v}) / n0 ELSE 1 - (every_{v} - own_{v}) / n1 END AS v_{v}" for v in "ab")} FROM r WHERE n1 > 1 AND n0 > 1),
    z AS (SELECT lang, avg(v_a) FILTER (y = 1) AS auc_a, avg(v_b) FILTER (y = 1) AS auc_b, (avg(v_a) FILTER (y = 1) - avg(v_b) FILTER (y = 1)) / sqrt(var_samp(v_a - v_b) FILTER (y = 1) / max(n1) + var_samp(v_a - v_b) FILTER (y = 0) / max(n0)) AS z FROM v GROUP BY lang)
    SELECT lang, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(z, 6) AS z, round(log10(2 * {TAIL.format(z="abs(z)")}), 4) AS log10_p FROM z""",
    ("scored",),
)
def delong_test(t: Tables) -> DataFrame:
    found = st.delong(t.scored.withColumn("other", -F.abs(F.col("score") - 1500)), ["lang"], "score", "other", "quality")
    return found.select("lang", *(F.round(c, 6).alias(c) for c in ("auc_a", "auc_b", "z")), F.round("log10_p", 4).alias("log10_p"))


@query("wilcoxon_signed", "WITH d AS (SELECT l_returnflag, abs(l_discount - l_tax) AS size, l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax <> 0), m AS " + MID.format(by="l_returnflag", v="size", t="d") + " SELECT l_returnflag, sum(CASE WHEN d > 0 THEN midrank ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN midrank ELSE 0 END) AS w_minus, count(*) AS n FROM m GROUP BY l_returnflag")
def wilcoxon_signed(t: Tables) -> DataFrame:
    return st.wilcoxon(t.lineitem, ["l_returnflag"], "l_discount", "l_tax").drop("z", "p")


@query("z_of_z", "WITH v AS (SELECT event_type, user_id % 20 AS perm, avg(value) AS s FROM events GROUP BY ALL), n AS (SELECT event_type, avg(s) AS m, stddev_pop(s) AS d FROM v WHERE perm > 0 GROUP BY event_type) SELECT event_type, round((s - m) / d, 6) AS zofz FROM v JOIN n USING (event_type) WHERE perm = 0")
def z_of_z(t: Tables) -> DataFrame:
    parts = t.events.groupBy("event_type", (F.col("user_id") % 20).alias("perm")).agg(F.avg("value").alias("s"))
    return _round(st.z_of_z(parts.where("perm = 0"), parts.where("perm > 0"), ["event_type"], "s").select("event_type", "zofz"), "zofz")


@query("coverage_by_region", "SELECT r_name AS region, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_custkey) AS with_orders, count(DISTINCT CASE WHEN c_acctbal > 5000 THEN c_custkey END) AS rich, count(DISTINCT CASE WHEN c_acctbal > 5000 OR o_custkey IS NOT NULL THEN c_custkey END) AS either, count(DISTINCT CASE WHEN c_acctbal > 5000 AND o_custkey IS NOT NULL THEN c_custkey END) AS both FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000) o ON o_custkey = c_custkey GROUP BY r_name")
def coverage_by_region(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 100000").select("o_custkey").distinct()
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    met = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
    rich, has = F.col("c_acctbal") > 5000, F.col("o_custkey").isNotNull()
    flags = {"customers": F.lit(True), "with_orders": has, "rich": rich, "either": rich | has, "both": rich & has}
    return met.groupBy("region").agg(*(F.count_distinct(F.when(f, F.col("c_custkey"))).alias(k) for k, f in flags.items()))


@query("group_mean", "SELECT n_regionkey, count(*) AS n, round(avg(total), 6) AS total_mean, round(avg(rich), 6) AS rich_mean, round(avg(coalesce(rich / nullif(total, 0), 0)), 6) AS rich_share FROM (SELECT n_regionkey, n_nationkey, count(c_custkey) AS total, count(CASE WHEN c_acctbal > 5000 THEN 1 END) AS rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY n_regionkey")
def group_mean(t: Tables) -> DataFrame:
    counts = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("c_custkey").alias("total"), F.count(F.when(F.col("c_acctbal") > 5000, 1)).alias("rich"))
    return _round(r.group_mean(counts, ["n_regionkey"], ["total"], ["rich"]), "total_mean", "rich_mean", "rich_share")


TISSUE = "m AS (SELECT user_id % 50 AS gene, event_type AS tissue, avg(value) AS value FROM events GROUP BY ALL)"


def tissues(t: Tables) -> DataFrame:
    expression = t.events.select((F.col("user_id") % 50).alias("gene"), F.col("event_id").alias("sample"), "value")
    return r.tissue_mean(expression, t.events.select(F.col("event_id").alias("sample"), F.col("event_type").alias("tissue")))


@query("expr_tissue_mean", f"WITH {TISSUE} SELECT gene, tissue, round(value, 6) AS value FROM m")
def expr_tissue_mean(t: Tables) -> DataFrame:
    return _round(tissues(t), "value")


@query("expr_tissue_correlation", f"WITH {TISSUE} SELECT x.tissue AS a, y.tissue AS b, round(corr(x.value, y.value), 6) AS r FROM m x JOIN m y ON x.gene = y.gene AND x.tissue < y.tissue GROUP BY ALL")
def expr_tissue_correlation(t: Tables) -> DataFrame:
    return _round(r.tissue_correlation(tissues(t)), "r")


@query("selectivity", "SELECT user_id, round((max(value) - avg(value)) / nullif(stddev_pop(value), 0), 6) AS height, round((quantile_cont(value, 0.95) - quantile_cont(value, 0.5)) / nullif(quantile_cont(value, 0.5) - quantile_cont(value, 0.05), 0), 6) AS tail FROM events GROUP BY user_id")
def selectivity(t: Tables) -> DataFrame:
    return _round(r.selectivity(t.events, "user_id", "value").drop("skewness"), "height", "tail")


@query("percentiles", "SELECT event_type, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(median(value), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles(t: Tables) -> DataFrame:
    out = r.percentiles(t.events, ["event_type"], "value", [0.05, 0.95])
    return out.select("event_type", F.round("sum", 4).alias("sum"), "min", "max", F.round("median", 6).alias("median"), F.round(F.col("percentiles")[0], 6).alias("p5"), F.round(F.col("percentiles")[1], 6).alias("p95"))


@query("mode", "WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, n FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1")
def mode(t: Tables) -> DataFrame:
    return r.mode(t.lineitem, ["l_suppkey"], "l_returnflag")


@query("target_overlap", "WITH s AS (SELECT DISTINCT l_returnflag || l_linestatus AS g, l_partkey AS gene FROM lineitem), n AS (SELECT g, count(*) AS n FROM s GROUP BY g), m AS (SELECT a.g AS a, b.g AS b, count(*) AS common FROM s a JOIN s b ON a.gene = b.gene AND a.g < b.g GROUP BY ALL) SELECT a, b, common, round(common / least(x.n, y.n), 6) AS share, round(common / (x.n + y.n - common), 6) AS jaccard FROM m JOIN n x ON x.g = a JOIN n y ON y.g = b")
def target_overlap(t: Tables) -> DataFrame:
    sets = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("set"), F.col("l_partkey").alias("gene"))
    return _round(r.target_overlap(sets), "share", "jaccard")


@query("cumulative_coverage", "WITH f AS (SELECT l_suppkey % 10 AS perm, l_partkey, min(l_orderkey // 100) AS step FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT l_suppkey % 10 AS perm, l_orderkey // 100 AS step FROM lineitem), n AS (SELECT perm, step, count(*) AS new FROM f GROUP BY ALL) SELECT perm, step, sum(coalesce(new, 0)) OVER (PARTITION BY perm ORDER BY step)::BIGINT AS covered FROM s LEFT JOIN n USING (perm, step)")
def cumulative_coverage(t: Tables) -> DataFrame:
    steps = t.lineitem.select((F.col("l_suppkey") % 10).alias("perm"), F.floor(F.col("l_orderkey") / 100).cast("long").alias("step"), F.col("l_partkey").alias("feature"))
    return o.growth_of_cover(steps, ["perm"], "step", "feature")


@query("neighbour_score", "WITH v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, sum(CASE WHEN value >= 0 THEN value ELSE 0 END) OVER w AS s, sum((value >= 0)::INT) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT event_id, round(CASE WHEN k > 2 AND k <= n - 2 AND value >= 0 AND m > 1 THEN 0.5 * (s - value) / (m - 1) + 0.5 * value ELSE value END, 6) AS smoothed FROM v")
def neighbour_score(t: Tables) -> DataFrame:
    return _round(o.neighbour_score(t.events, ["user_id"], "event_id", "value", 2, 0.5).select("event_id", "smoothed"), "smoothed")


@query("counts_cube", "SELECT p_brand, p_type, p_size, count(*) AS n, grouping(p_brand, p_type, p_size)::BIGINT AS level FROM part GROUP BY CUBE (p_brand, p_type, p_size) HAVING p_brand IS NOT NULL")
def counts_cube(t: Tables) -> DataFrame:
    return r.counts_by(t.part, "p_brand", "p_type", "p_size")


@query("events_windowed", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(t: Tables) -> DataFrame:
    return _round(windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp"))), "total", digits=4).withColumn("start", F.col("start").cast("timestamp_ntz"))
