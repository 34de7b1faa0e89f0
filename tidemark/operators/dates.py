"""Forecast dates from belief movement and news volume.

Long form: one row per (event_id, pos), pos counting the days of an event from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strict_date

ALPHA, RAMP, BUFFER_DAYS = 0.7, 1e-3, 2
WEIGHT_DIGITS = 9


def _event():
    return Window.partitionBy("event_id")


def _days():
    return _event().orderBy("pos")


def belief_delta_binary(rows: DataFrame) -> DataFrame:
    """Adds delta = |p - p of the day before|; 0 on the first day and beside a null."""
    return rows.withColumn("delta", F.coalesce(F.abs(F.col("p") - F.lag("p").over(_days())), F.lit(0.0)))


def belief_delta_multi(legs: DataFrame) -> DataFrame:
    """(event_id, pos, delta) from (event_id, leg, pos, p): half the summed change; any null leg makes it 0."""
    step = F.abs(F.col("p") - F.lag("p").over(Window.partitionBy("event_id", "leg").orderBy("pos")))
    moved = legs.withColumn("step", step).groupBy("event_id", "pos").agg(F.sum("step").alias("s"), F.count("step").alias("n"), F.count("*").alias("legs"))
    return moved.select("event_id", "pos", F.when(F.col("n") == F.col("legs"), F.col("s") * 0.5).otherwise(0.0).alias("delta"))


def crowd_on_truth(rows: DataFrame) -> DataFrame:
    """Adds crowd: the market's probability of the resolved label of a binary question, else null."""
    label = F.lower(F.coalesce("resolved_label", F.lit("")))
    return rows.withColumn("crowd", F.when(label == "yes", F.col("p")).when(label == "no", 1.0 - F.col("p")))


def crowd_of_winner(legs: DataFrame, winners: DataFrame) -> DataFrame:
    """The winning leg's series: ``winners`` has (event_id, leg_idx), an index of the history's own order."""
    return legs.join(winners, ["event_id", "leg_idx"]).select("event_id", "pos", "day", F.col("p").alias("crowd"))


def crowd_for_dates(dates: DataFrame, series: DataFrame) -> DataFrame:
    """Left join on the day; a repeated day takes its last value."""
    last = series.groupBy("event_id", F.substring("day", 1, 10).alias("day")).agg(F.max_by("crowd", "pos").alias("crowd"))
    return dates.join(last, ["event_id", "day"], "left")


def resolution_date(close: Column, legs_closed: Column, resolution: Column, end: Column) -> Column:
    """First that parses of close date, latest leg, resolution date, end date."""
    return F.coalesce(strict_date(close), F.array_max(F.transform(legs_closed, strict_date)), strict_date(resolution), strict_date(end))


def aligned_news(days: Column, news: Column) -> Column:
    """The news series of an event, one number a day; zeros where it is missing or of another length."""
    fits = F.coalesce((F.size(news) == F.size(days)) & (F.size(news) > 0), F.lit(False))
    return F.when(fits, F.transform(news, lambda x: F.coalesce(x, F.lit(0)).cast("double"))).otherwise(F.transform(days, lambda _: F.lit(0.0)))


def question_days(questions: DataFrame) -> DataFrame:
    """(event_id, pos, day, news) of question rows with ``daily_index`` and ``news_daily``."""
    both = F.arrays_zip(F.col("daily_index").alias("day"), aligned_news(F.col("daily_index"), F.col("news_daily")).alias("news"))
    rows = questions.select("event_id", F.posexplode(both).alias("pos", "x"))
    return rows.select("event_id", "pos", F.substring("x.day", 1, 10).alias("day"), F.col("x.news").alias("news"))


def peak_share(x: str) -> Column:
    """x over the event's peak; zeros where the peak is not positive."""
    peak = F.max(x).over(_event())
    return F.when(peak > 0, F.col(x) / peak).otherwise(0.0)


def trim_for_leakage(rows: DataFrame, buffer_days: int = BUFFER_DAYS) -> DataFrame:
    """Rows at least ``buffer_days`` before resolution; all of an event's if none is or it has no resolution."""
    if buffer_days <= 0:
        return rows
    fits = F.coalesce(F.datediff("resolution", F.to_date("day")) >= buffer_days, F.lit(True))
    marked = rows.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(_event()))
    return marked.filter(F.col("_fits") | ~F.col("_any")).drop("_fits", "_any")


def auto_k(horizon: Column, k_min: int = 3, k_max: int = 10, c: float = 1.0) -> Column:
    """clamp(round-half-even(c sqrt(H)))."""
    if k_min < 1 or k_max < k_min:
        raise ValueError("need 1 <= k_min <= k_max")
    k = F.least(F.greatest(F.rint(F.lit(c) * F.sqrt(horizon)), F.lit(float(k_min))), F.lit(float(k_max)))
    return F.when(horizon < 1, F.lit(k_min)).otherwise(k.cast("int"))


def bin_of(t: Column, n: Column, k: Column) -> Column:
    """Bin i holds [floor(n i / k), floor(n (i + 1) / k))."""
    return F.floor(((t + 1) * k - 1) / n).cast("long")


def weigh_dates(rows: DataFrame, k: int | None = None, alpha: float = ALPHA, ramp: float = RAMP, buffer_days: int = BUFFER_DAYS, k_min: int = 3, k_max: int = 10, c: float = 1.0) -> DataFrame:
    """The eligible days of each event, numbered t of n, with the weight of each and its bin of k equal ones.

    ``rows``: event_id, pos, day, delta, news (null: 0), resolution (date or null).
    Weights are rounded to 9 digits before they are compared.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha is in [0, 1]")
    signals = rows.withColumn("news", F.coalesce(F.col("news").cast("double"), F.lit(0.0))).withColumns({"belief": peak_share("delta"), "volume": peak_share("news")})
    pool = trim_for_leakage(signals, buffer_days).withColumns({"n": F.count("*").over(_event()), "t": F.row_number().over(_days()) - 1})
    pool = pool.withColumn("k", F.lit(k) if k is not None else auto_k(F.col("n"), k_min, k_max, c))
    weight = F.lit(alpha) * F.col("belief") + F.lit(1.0 - alpha) * F.col("volume") + F.lit(ramp) * (F.col("t") / F.greatest(F.col("n") - 1, F.lit(1)))
    return pool.withColumns({"weight": F.round(weight, WEIGHT_DIGITS), "bin": F.when(F.col("n") <= F.col("k"), F.col("t").cast("long")).otherwise(bin_of(F.col("t"), F.col("n"), F.col("k")))})


def select_dates(rows: DataFrame, **settings) -> DataFrame:
    """The day of greatest weight in each bin of :func:`weigh_dates` (whose settings these are), later days first on a tie."""
    pool = weigh_dates(rows, **settings)
    best = F.max_by(F.struct("pos", "day", "weight"), F.struct("weight", "t"))
    return pool.groupBy("event_id", "bin").agg(best.alias("b")).select("event_id", "bin", "b.pos", "b.day", "b.weight")
