"""The daily series and what is computed along it.

Days are aggregated before anything else, so every window here runs over as many rows as there are days, whatever the number
of events; the calendar is made dense first, so that a row offset is a number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import register
from ..sources.tables import SQL_RELATIONS, relation

EVENTS = ("1997-06-15", "1998-03-13", "1999-09-01")


def along():
    """In the order of days."""
    return Window.orderBy("date")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, volume (0 on days without), legs of every day from the first to the last, with t, the day's number from 0."""
    legs = relation(spark, sf_dir, "attackers", ["block_time", "amount_usd"])
    days = legs.groupBy(F.to_date("block_time").alias("date")).agg(F.round(F.sum("amount_usd"), 2).alias("volume"), F.count(F.lit(1)).alias("legs"))
    spine = days.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    dense = spine.join(days, "date", "left")
    return dense.select("date", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("legs", F.lit(0).cast("long")).alias("legs"), F.datediff("date", F.min("date").over(Window.partitionBy())).cast("long").alias("t"))


SQL_DAILY = f"""{SQL_RELATIONS}, g AS (SELECT CAST(block_time AS DATE) AS date, round(sum(amount_usd), 2) AS volume, count(*) AS legs FROM attackers GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM g),
d AS (SELECT date, coalesce(volume, 0) AS volume, coalesce(legs, 0) AS legs, CAST(date - min(date) OVER () AS BIGINT) AS t FROM s LEFT JOIN g USING (date))"""

SQL_WEEKDAY = "isodow(date) - 1"


@register(
    f"""WITH {SQL_DAILY} SELECT date, t, CAST({SQL_WEEKDAY} AS INTEGER) AS day_of_week, {SQL_WEEKDAY} >= 5 AS weekend, round(ln(volume), 8) AS log_volume, round(ln(1 + volume), 8) AS log1p_volume,
    CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, CAST(date_trunc('month', date) AS DATE) AS month, CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS week_from_sunday,
    CAST(CASE WHEN date >= DATE '{EVENTS[0]}' THEN 1 ELSE 0 END AS INTEGER) AS step, greatest(0, date - DATE '{EVENTS[0]}') AS slope FROM d WHERE volume > 0"""
)
def w20_calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, weekday (Monday is 0), both logarithms, calendar parts, and the step and slope of an interruption."""
    date, since = F.col("date"), F.datediff(F.col("date"), F.lit(EVENTS[0]).cast("date"))
    return daily(spark, sf_dir).where("volume > 0").select(
        "date", "t", F.weekday(date).alias("day_of_week"), (F.weekday(date) >= 5).alias("weekend"), F.round(F.log("volume"), 8).alias("log_volume"),
        F.round(F.log1p("volume"), 8).alias("log1p_volume"), F.year(date).alias("year"), F.quarter(date).alias("quarter"), F.to_date(F.trunc(date, "month")).alias("month"),
        F.date_sub(date, F.dayofweek(date) - 1).alias("week_from_sunday"), (since >= 0).cast("int").alias("step"), F.greatest(F.lit(0), since).alias("slope"),
    )


@register(
    f"""WITH {SQL_DAILY}, w AS (SELECT *, lag(volume) OVER o AS p FROM d WINDOW o AS (ORDER BY date))
    SELECT date, round(volume - p, 2) AS change, CASE WHEN p > 0 THEN round((volume - p) / p, 8) END AS pct_change, CASE WHEN p > 0 AND volume > 0 THEN round(ln(volume / p), 8) END AS log_change,
        round(ln(1 + volume) - ln(1 + p), 8) AS log1p_change FROM w"""
)
def w06_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, percentage and logarithmic change from day to day; undefined ones are NULL."""
    p, v = F.lag("volume").over(along()), F.col("volume")
    rows = daily(spark, sf_dir).select("date", "volume", p.alias("p"))
    p = F.col("p")
    return rows.select(
        "date", F.round(v - p, 2).alias("change"), F.when(p > 0, F.round((v - p) / p, 8)).alias("pct_change"),
        F.when((p > 0) & (v > 0), F.round(F.log(F.try_divide(v, p)), 8)).alias("log_change"), F.round(F.log1p(v) - F.log1p(p), 8).alias("log1p_change"),
    )


def full(column: Column, days: int, count: Column) -> Column:
    """NULL until the window has so many rows."""
    return F.when(count == days, column)


def sql_full(f: str, days: int, frame: str) -> str:
    return f"CASE WHEN count(*) OVER (ORDER BY date {frame}) = {days} THEN round({f} OVER (ORDER BY date {frame}), 4) END"


SQL_ROLLING = ", ".join(f"{sql_full('avg(volume)', k, f'ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW')} AS mean_{k}" for k in (7, 30, 90))
BACK30 = "ROWS BETWEEN 29 PRECEDING AND CURRENT ROW"


@register(
    f"""WITH {SQL_DAILY} SELECT date, {SQL_ROLLING}, round(stddev_samp(volume) OVER (ORDER BY date {BACK30}), 4) AS sd_30,
    round(stddev_samp(volume) OVER (ORDER BY date {BACK30}) / nullif(avg(volume) OVER (ORDER BY date {BACK30}), 0), 6) AS cv_30 FROM d"""
)
def w07_w08_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the last 7, 30 and 90 days (NULL until complete), and deviation and variation of the last 30."""
    over = lambda k: along().rowsBetween(1 - k, 0)
    means = [full(F.round(F.avg("volume").over(over(k)), 4), k, F.count(F.lit(1)).over(over(k))).alias(f"mean_{k}") for k in (7, 30, 90)]
    sd, mean = F.stddev_samp("volume").over(over(30)), F.avg("volume").over(over(30))
    return daily(spark, sf_dir).select("date", *means, F.round(sd, 4).alias("sd_30"), F.round(F.try_divide(sd, mean), 6).alias("cv_30"))


AROUND = "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"


@register(
    f"""WITH {SQL_DAILY}, w AS (SELECT date, avg(volume) OVER (ORDER BY date {AROUND}) AS m, stddev_samp(volume) OVER (ORDER BY date {AROUND}) AS s, count(*) OVER (ORDER BY date {AROUND}) AS n FROM d)
    SELECT date, round(m, 4) AS centred_mean, CASE WHEN n = 7 THEN round(m, 4) END AS centred_mean_full, round(s, 4) AS centred_sd, round(greatest(0, m - 1.96 * s), 4) AS low, round(m + 1.96 * s, 4) AS high FROM w"""
)
def w09_w10_x101_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred seven-day mean and deviation, with partial and with complete windows, and the band around them cut at 0."""
    over = along().rowsBetween(-3, 3)
    m, s = F.avg("volume").over(over), F.stddev_samp("volume").over(over)
    rows = daily(spark, sf_dir).select("date", m.alias("m"), s.alias("s"), F.count(F.lit(1)).over(over).alias("n"))
    m, s = F.col("m"), F.col("s")
    return rows.select(
        "date", F.round(m, 4).alias("centred_mean"), full(F.round(m, 4), 7, F.col("n")).alias("centred_mean_full"), F.round(s, 4).alias("centred_sd"),
        F.round(F.greatest(F.lit(0.0), m - 1.96 * s), 4).alias("low"), F.round(m + 1.96 * s, 4).alias("high"),
    )


@register(
    f"""WITH {SQL_DAILY}, m AS (SELECT avg(volume) AS m FROM d), x AS (SELECT volume - m AS x, lag(volume - m, 1) OVER (ORDER BY date) AS x1, lag(volume - m, 7) OVER (ORDER BY date) AS x7 FROM d, m)
    SELECT round(sum(x * x1) / sum(x * x), 6) AS lag_1, round(sum(x * x7) / sum(x * x), 6) AS lag_7 FROM x"""
)
def x30_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample autocorrelation at lags 1 and 7, with the mean and variance of the whole series."""
    x = F.col("volume") - F.avg("volume").over(Window.partitionBy())
    rows = daily(spark, sf_dir).select("date", x.alias("x"))
    lagged = rows.select("x", F.lag("x", 1).over(along()).alias("x1"), F.lag("x", 7).over(along()).alias("x7"))
    return lagged.agg(*[F.round(F.sum(F.col("x") * F.col(f"x{k}")) / F.sum(F.col("x") * F.col("x")), 6).alias(f"lag_{k}") for k in (1, 7)])


@register(f"WITH {SQL_DAILY} SELECT round(avg(volume) FILTER ({SQL_WEEKDAY} < 5), 4) AS weekday_mean, round(avg(volume) FILTER ({SQL_WEEKDAY} >= 5), 4) AS weekend_mean FROM d")
def x31_weekday_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean volume of weekdays and of weekends."""
    weekend = F.weekday("date") >= 5
    return daily(spark, sf_dir).agg(F.round(F.avg(F.when(~weekend, F.col("volume"))), 4).alias("weekday_mean"), F.round(F.avg(F.when(weekend, F.col("volume"))), 4).alias("weekend_mean"))


def sql_rss(p: str) -> str:
    """Residual sum of squares of a line through prefix sums n, t, tt, y, ty, yy."""
    return f"(({p}yy - {p}y * {p}y / {p}n) - power({p}ty - {p}t * {p}y / {p}n, 2) / ({p}tt - {p}t * {p}t / {p}n))"


def rss(n: Column, t: Column, tt: Column, y: Column, ty: Column, yy: Column) -> Column:
    return (yy - y * y / n) - F.pow(ty - t * y / n, 2) / (tt - t * t / n)


SUMS = {"n": "1", "t": "t", "tt": "t * t", "y": "y", "ty": "t * y", "yy": "y * y"}
SQL_SPLITS = f"""{SQL_DAILY}, c AS (SELECT t, ln(1 + volume) - avg(ln(1 + volume)) OVER () AS y, count(*) OVER () AS m FROM d),
q AS (SELECT t AS day, m, {", ".join(f"sum({e}) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a_{k}, sum({e}) OVER () AS w_{k}" for k, e in SUMS.items())} FROM c),
u AS (SELECT *, {", ".join(f"w_{k} - a_{k} AS b_{k}" for k in SUMS)} FROM q WHERE day >= ceil(0.15 * m) AND day <= floor(0.85 * m)),
f AS (SELECT day, (({sql_rss("w_")}) - ({sql_rss("a_")}) - ({sql_rss("b_")})) / 2 / ((({sql_rss("a_")}) + ({sql_rss("b_")})) / (m - 4)) AS f FROM u)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, f: the Chow statistic (mean and trend, two parameters) of a break before each day of the middle 70 percent, all from prefix sums."""
    y = F.log1p("volume")
    rows = daily(spark, sf_dir).select("t", (y - F.avg(y).over(Window.partitionBy())).alias("y")).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    ahead, whole = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = {f"a{k}": F.sum(F.expr(e)).over(ahead) for k, e in SUMS.items()} | {f"w{k}": F.sum(F.expr(e)).over(whole) for k, e in SUMS.items()}
    inner = rows.select("t", "m", *[c.alias(k) for k, c in sums.items()]).where("t >= ceil(0.15 * m) and t <= floor(0.85 * m)")
    part = lambda p: rss(*[F.col(f"{p}{k}") for k in SUMS])
    after = rss(*[F.col(f"w{k}") - F.col(f"a{k}") for k in SUMS])
    return inner.select(F.col("t").alias("day"), ((part("w") - part("a") - after) / 2 / ((part("a") + after) / (F.col("m") - 4))).alias("f"))


@register(f"WITH {SQL_SPLITS} SELECT CAST(day AS BIGINT) AS day, round(f, 5) AS f FROM f")
def x35_chow_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Chow statistic of every possible break."""
    return splits(spark, sf_dir).select("day", F.round("f", 5).alias("f"))


@register(f"WITH {SQL_SPLITS} SELECT CAST(arg_max(day, f) AS BIGINT) AS day, round(max(f), 5) AS sup_f FROM f")
def x36_sup_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The break with the largest Chow statistic."""
    return splits(spark, sf_dir).agg(F.max_by("day", "f").alias("day"), F.round(F.max("f"), 5).alias("sup_f"))


SQL_PRE_POST = f"""{SQL_DAILY}, w AS (SELECT date, avg(volume) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS pre, avg(volume) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS post,
count(*) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 59 FOLLOWING) AS n FROM d), r AS (SELECT date, pre, post, post / nullif(pre, 0) AS ratio FROM w WHERE n = 120)"""


def pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pre and post: mean volume of the 60 days before each date and of the 60 from it on, and their ratio; dates with both in full."""
    pre, post, n = (F.avg("volume").over(along().rowsBetween(-60, -1)), F.avg("volume").over(along().rowsBetween(0, 59)), F.count(F.lit(1)).over(along().rowsBetween(-60, 59)))
    return daily(spark, sf_dir).select("date", pre.alias("pre"), post.alias("post"), n.alias("n")).where("n = 120").select("date", "pre", "post", F.try_divide("post", "pre").alias("ratio"))


@register(f"WITH {SQL_PRE_POST} SELECT date, round(pre, 4) AS pre, round(post, 4) AS post, round(ratio, 6) AS ratio FROM r")
def w17_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means before and after every date at once."""
    return pre_post(spark, sf_dir).select("date", F.round("pre", 4).alias("pre"), F.round("post", 4).alias("post"), F.round("ratio", 6).alias("ratio"))


SQL_EVENTS = ", ".join(f"(DATE '{e}')" for e in EVENTS)


@register(
    f"""WITH {SQL_PRE_POST}, e AS (SELECT r.date AS event, ratio FROM r JOIN (VALUES {SQL_EVENTS}) v(date) ON r.date = v.date)
    SELECT event, round(e.ratio, 6) AS ratio, count(*) AS placebos, round(count(*) FILTER (p.ratio <= e.ratio) * 100.0 / count(*), 6) AS percentile
    FROM e JOIN r p ON abs(p.date - event) > 30 GROUP BY event, e.ratio"""
)
def x39_event_placebos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio after each event, and where it stands among the ratios of all dates more than 30 days away."""
    ratios = pre_post(spark, sf_dir).select("date", "ratio")
    events = ratios.where(F.col("date").isin(*[F.lit(e).cast("date") for e in EVENTS])).select(F.col("date").alias("event"), F.col("ratio").alias("own"))
    # Three events against the days: a stated set of points, broadcast, as few rows as there are events.
    placebo = ratios.join(F.broadcast(events), F.abs(F.datediff("date", "event")) > 30)
    rows = placebo.groupBy("event", "own").agg(F.count(F.lit(1)).alias("placebos"), F.count_if(F.col("ratio") <= F.col("own")).alias("below"))
    return rows.select("event", F.round("own", 6).alias("ratio"), "placebos", F.round(F.col("below") * 100 / F.col("placebos"), 6).alias("percentile"))


@register(
    f"""WITH {SQL_DAILY}, z AS (SELECT *, CAST(sum(CASE WHEN date IN (SELECT * FROM (VALUES {SQL_EVENTS})) THEN 1 ELSE 0 END) OVER (ORDER BY date) + 1 AS BIGINT) AS regime FROM d)
    SELECT regime, min(date) AS first_day, max(date) AS last_day, count(*) AS days, round(sum(volume), 2) AS volume, round(avg(volume), 4) AS mean_volume, round(median(volume), 4) AS median_volume,
        round(stddev_samp(volume), 4) AS sd_volume, min(volume) AS min_volume, max(volume) AS max_volume, CAST(sum(legs) AS BIGINT) AS legs, round(sum(volume) / sum(sum(volume)) OVER (), 8) AS volume_share FROM z GROUP BY 1"""
)
def w18_x41_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes between change dates (a change date begins the next regime) and their summary."""
    starts = F.col("date").isin(*[F.lit(e).cast("date") for e in EVENTS])
    rows = daily(spark, sf_dir).withColumn("regime", (F.sum(starts.cast("long")).over(along()) + 1).cast("long"))
    v = F.col("volume")
    summary = rows.groupBy("regime").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("days"), F.sum(v).alias("whole"), F.round(F.avg(v), 4).alias("mean_volume"),
        F.round(F.median(v), 4).alias("median_volume"), F.round(F.stddev_samp(v), 4).alias("sd_volume"), F.min(v).alias("min_volume"), F.max(v).alias("max_volume"), F.sum("legs").alias("legs"),
    )
    return summary.withColumn("volume_share", F.round(F.col("whole") / F.sum("whole").over(Window.partitionBy()), 8)).withColumn("volume", F.round("whole", 2)).drop("whole")


@register(
    f"""WITH {SQL_DAILY}, e AS (SELECT unnest([{", ".join(f"DATE '{x}'" for x in EVENTS)}]) AS event)
    SELECT event, count(*) AS days, count(*) FILTER (volume > 0) AS positive_days, round(count(*) FILTER (volume > 0) * 100.0 / count(*), 6) AS positive_share,
        round(quantile_cont(volume, 0.25), 4) AS p25, round(median(volume), 4) AS p50, round(quantile_cont(volume, 0.75), 4) AS p75 FROM e JOIN d ON date >= event GROUP BY 1"""
)
def x44_x45_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with activity and quartiles of volume from each event to the end."""
    events = spark.range(1).select(F.explode(F.array(*[F.lit(e).cast("date") for e in EVENTS])).alias("event"))
    active = F.count_if(F.col("volume") > 0)
    rows = daily(spark, sf_dir).join(F.broadcast(events), F.col("date") >= F.col("event")).groupBy("event")
    return rows.agg(
        F.count(F.lit(1)).alias("days"), active.alias("positive_days"), F.round(active * 100 / F.count(F.lit(1)), 6).alias("positive_share"),
        *[F.round(F.percentile("volume", p), 4).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))],
    )


SQL_PERIODS = "count(*) AS days, round(sum(volume), 2) AS volume, round(avg(volume), 4) AS mean_volume, round(median(volume), 4) AS median_volume, round(stddev_samp(volume), 4) AS sd_volume, CAST(sum(legs) AS BIGINT) AS legs"


@register(
    f"""WITH {SQL_DAILY} SELECT 'week' AS period, CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS start, {SQL_PERIODS} FROM d GROUP BY 2
    UNION ALL SELECT 'month', CAST(date_trunc('month', date) AS DATE), {SQL_PERIODS} FROM d GROUP BY 2
    UNION ALL SELECT 'year', CAST(date_trunc('year', date) AS DATE), {SQL_PERIODS} FROM d GROUP BY 2
    UNION ALL SELECT 'all', min(date), {SQL_PERIODS} FROM d"""
)
def x95_period_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by week (from Sunday), month, year and over all days."""
    days, date = daily(spark, sf_dir), F.col("date")
    starts = {"week": F.date_sub(date, F.dayofweek(date) - 1), "month": F.to_date(F.trunc(date, "month")), "year": F.to_date(F.trunc(date, "year")), "all": F.min("date").over(Window.partitionBy())}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("period"), s.alias("start")) for k, s in starts.items() if k != "all"]))
    rows = days.select("volume", "legs", each.alias("p")).select("volume", "legs", "p.*").unionByName(days.select("volume", "legs", F.lit("all").alias("period"), starts["all"].alias("start")))
    v = F.col("volume")
    return rows.groupBy("period", "start").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.sum(v), 2).alias("volume"), F.round(F.avg(v), 4).alias("mean_volume"), F.round(F.median(v), 4).alias("median_volume"),
        F.round(F.stddev_samp(v), 4).alias("sd_volume"), F.sum("legs").alias("legs"),
    )


@register(
    f"""WITH {SQL_DAILY}, c AS (SELECT volume - lag(volume) OVER (ORDER BY date) AS c, volume / nullif(lag(volume) OVER (ORDER BY date), 0) - 1 AS p FROM d)
    SELECT round(avg(c), 4) AS mean_change, round(stddev_samp(c), 4) AS sd_change, round(avg(abs(c)), 4) AS mean_abs_change, round(max(abs(c)), 2) AS max_abs_change, round(avg(abs(p)), 6) AS mean_abs_pct_change,
        count(*) FILTER (c > 0) AS rises, count(*) FILTER (c < 0) AS falls, count(*) FILTER (c = 0) AS unchanged FROM c"""
)
def x96_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How volume changes from day to day."""
    before = F.lag("volume").over(along())
    rows = daily(spark, sf_dir).select((F.col("volume") - before).alias("c"), (F.try_divide(F.col("volume"), before) - 1).alias("p"))
    c, p = F.col("c"), F.col("p")
    return rows.agg(
        F.round(F.avg(c), 4).alias("mean_change"), F.round(F.stddev_samp(c), 4).alias("sd_change"), F.round(F.avg(F.abs(c)), 4).alias("mean_abs_change"), F.round(F.max(F.abs(c)), 2).alias("max_abs_change"),
        F.round(F.avg(F.abs(p)), 6).alias("mean_abs_pct_change"), F.count_if(c > 0).alias("rises"), F.count_if(c < 0).alias("falls"), F.count_if(c == 0).alias("unchanged"),
    )


@register(
    f"""WITH {SQL_DAILY} SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(sum(volume) / nullif(sum(legs), 0), 6) AS ratio_of_sums,
    round(median(volume / nullif(legs, 0)), 6) AS median_of_ratios, count(*) FILTER (legs > 0) AS active_days FROM d GROUP BY 1"""
)
def x97_monthly_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume for each leg by month: ratio of sums beside the median of daily ratios."""
    rows = daily(spark, sf_dir).withColumn("ratio", F.try_divide("volume", "legs")).groupBy(F.to_date(F.trunc("date", "month")).alias("month"))
    return rows.agg(F.round(F.try_divide(F.sum("volume"), F.sum("legs")), 6).alias("ratio_of_sums"), F.round(F.median("ratio"), 6).alias("median_of_ratios"), F.count_if(F.col("legs") > 0).alias("active_days"))


@register(
    f"""WITH {SQL_DAILY}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(volume) AS v FROM d GROUP BY 1),
    i AS (SELECT v, row_number() OVER (ORDER BY month) - 1 AS i, rank() OVER (ORDER BY v) AS rv, row_number() OVER (ORDER BY month DESC) AS back FROM m)
    SELECT round(regr_slope(v, i), 4) AS slope, round(corr(rv, i), 8) AS rank_correlation, round(avg(v) FILTER (i < 3), 4) AS first_mean, round(avg(v) FILTER (back <= 3), 4) AS last_mean,
        round(avg(v) FILTER (back <= 3) / avg(v) FILTER (i < 3) - 1, 8) AS change FROM i"""
)
def w19_x98_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of monthly volume, its rank correlation with time, and the change from the first to the last three months."""
    months = daily(spark, sf_dir).groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("volume").alias("v"))
    i, back = F.row_number().over(Window.orderBy("month")) - 1, F.row_number().over(Window.orderBy(F.desc("month")))
    rows = months.select("v", i.alias("i"), F.rank().over(Window.orderBy("v")).alias("rv"), back.alias("back"))
    first, last = F.avg(F.when(F.col("i") < 3, F.col("v"))), F.avg(F.when(F.col("back") <= 3, F.col("v")))
    return rows.agg(
        F.round(F.regr_slope("v", "i"), 4).alias("slope"), F.round(F.corr("rv", "i"), 8).alias("rank_correlation"), F.round(first, 4).alias("first_mean"), F.round(last, 4).alias("last_mean"),
        F.round(last / first - 1, 8).alias("change"),
    )


@register(
    f"""WITH {SQL_DAILY}, c AS (SELECT date, volume, volume - lag(volume) OVER (ORDER BY date) AS change FROM d)
    SELECT 'value' AS basis, rank, date, volume FROM (SELECT *, row_number() OVER (ORDER BY volume DESC, date) AS rank FROM c) WHERE rank <= 10
    UNION ALL SELECT 'change', rank, date, volume FROM (SELECT *, row_number() OVER (ORDER BY abs(change) DESC NULLS LAST, date) AS rank FROM c) WHERE rank <= 10"""
)
def t03_leading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten days with the largest volume and the ten with the largest change."""
    rows = daily(spark, sf_dir).select("date", "volume", F.abs(F.col("volume") - F.lag("volume").over(along())).alias("change"))
    top = lambda c, basis: rows.orderBy(F.desc_nulls_last(c), "date").limit(10).select(F.lit(basis).alias("basis"), F.row_number().over(Window.orderBy(F.desc_nulls_last(c), "date")).cast("long").alias("rank"), "date", "volume")
    return top("volume", "value").unionAll(top("change", "change"))
