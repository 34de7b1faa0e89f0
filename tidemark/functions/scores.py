"""Distributions and proper scores as column expressions.

A distribution is a MAP<STRING, DOUBLE>. Nulls: a missing truth label has probability
zero; a null crowd probability makes Info-Alpha null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS, WORST_BRIER, SUM_TOLERANCE = 1e-3, 2.0, 0.05


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once for the row, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def clamped(p: Column | str) -> Column:
    return F.transform_values(_c(p), lambda _, v: F.greatest(F.lit(0.0), v))


def raw_sum(p: Column | str) -> Column:
    return total(F.map_values(clamped(p)))


def _shares(kept: Column, mass: Column) -> Column:
    return F.when(mass > 0, F.transform_values(kept, lambda _, v: v / mass)).otherwise(F.create_map().cast("map<string,double>"))


def normalize(p: Column | str) -> Column:
    """Negatives to zero, then to sum one; an empty map if nothing is left."""
    held = F.struct(clamped(p).alias("kept"), raw_sum(p).alias("mass"))
    return let(held, lambda x: _shares(x["kept"], x["mass"]))


def p_truth(p: Column | str, truth: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_c(p), _c(truth)), F.lit(0.0))


def brier(p: Column | str, truth: Column | str) -> Column:
    """Squared error over the forecast's labels and the truth."""
    labels = F.array_union(F.map_keys(_c(p)), F.array(_c(truth)))
    gap = lambda k: p_truth(p, k) - F.when(k == _c(truth), 1.0).otherwise(0.0)
    return total(F.transform(labels, lambda k: gap(k) * gap(k)))


def floored_log(prob: Column | str, eps: float = EPS) -> Column:
    """ln of a probability within [eps, 1]; null stays null (greatest and least skip nulls)."""
    x = _c(prob)
    return F.when(x.isNotNull(), F.ln(F.greatest(F.lit(eps), F.least(F.lit(1.0), x))))


def accuracy(p: Column | str, truth: Column | str) -> Column:
    """1 / ties if the truth is among the greatest, else 0."""
    top = F.array_max(F.map_values(_c(p)))
    ties = F.size(F.filter(F.map_values(_c(p)), lambda v: v == top))
    return F.when((top > 0) & (p_truth(p, truth) == top), 1.0 / ties).otherwise(0.0)


def info_alpha(log_prob: Column | str, crowd: Column | str, eps: float = EPS) -> Column:
    return F.when(_c(crowd).isNotNull(), _c(log_prob) - floored_log(crowd, eps))


def same_distribution(a: Column | str, b: Column | str, tolerance: float = SUM_TOLERANCE) -> Column:
    """Equal, non-empty label sets and all probabilities within the tolerance."""
    a, b = _c(a), _c(b)
    keys, others = F.map_keys(a), F.map_keys(b)
    equal = (F.size(F.array_except(keys, others)) == 0) & (F.size(F.array_except(others, keys)) == 0)
    close = F.forall(keys, lambda k: F.coalesce(F.abs(F.try_element_at(a, k) - F.try_element_at(b, k)) <= tolerance, F.lit(False)))
    return F.coalesce((F.size(keys) > 0) & equal & close, F.lit(False))


def _share(*flags: Column) -> Column:
    out = F.lit(0.0)
    for f in flags:
        out = out + F.coalesce(f, F.lit(False)).cast("double")
    return out / len(flags)


def answer_quality(strict_json: Column, all_numeric: Column, prob_sum: Column, tolerance: float = SUM_TOLERANCE) -> Column:
    return _share(strict_json, all_numeric, F.abs(prob_sum - 1.0) <= tolerance)


def notebook_quality(parseable: Column, has_p: Column, matches: Column) -> Column:
    return _share(parseable, has_p, matches)


def format_quality(answer: Column, notebook: Column) -> Column:
    """Both halves alike, where the notebook is scored too."""
    return 0.5 * answer + 0.5 * notebook


def score(forecast: Column, truth: Column, crowd: Column, quality: Column, metric: str, normalized: bool = True, eps: float = EPS, coef: float = 1.0) -> Column:
    """The reward record of one answer as a struct; ``forecast`` null or empty means no answer."""
    if metric not in ("brier", "log_prob"):
        raise ValueError(f"unknown metric {metric}")
    label = F.trim(F.coalesce(truth, F.lit("")))
    given = F.struct(
        clamped(forecast).alias("kept"), raw_sum(forecast).alias("mass"), label.alias("label"), crowd.cast("double").alias("crowd"), quality.alias("quality"),
        F.coalesce(F.size(forecast) > 0, F.lit(False)).alias("answered"),
    )

    def held(x: Column) -> Column:
        """What the record's fields share: the distribution, its probability of the truth."""
        mass = F.when(x["answered"], x["mass"]).otherwise(0.0)
        dist = _shares(x["kept"], x["mass"]) if normalized else x["kept"]
        return let(x.withField("mass", mass).withField("dist", dist), scored)

    def scored(x: Column) -> Column:
        usable = x["answered"] & (x["mass"] > 0)
        shown = F.struct(
            F.when(usable, brier(x["dist"], x["label"])).otherwise(F.lit(WORST_BRIER)).alias("b"),
            F.when(usable, p_truth(x["dist"], x["label"])).otherwise(0.0).alias("pt"),
            F.when(usable, accuracy(x["dist"], x["label"])).otherwise(0.0).alias("accuracy"),
            (usable & F.coalesce(F.map_contains_key(x["dist"], x["label"]), F.lit(False))).alias("there"),
            usable.alias("usable"), x.alias("x"),
        )
        return let(shown, lambda s: let(s.withField("lp", F.when(s["usable"], floored_log(s["pt"], eps)).otherwise(F.lit(math.log(eps)))), record))

    def record(s: Column) -> Column:
        x = s["x"]
        missing = x["label"].isin("", "?")
        proper = -s["b"] if metric == "brier" else s["lp"]
        penalty = F.lit(coef) * (x["quality"] - 1.0)
        known = lambda c: F.when(~missing, c)
        return F.struct(
            F.when(missing, 0.0).otherwise(proper + penalty).alias("reward"),
            known(proper).alias("proper_score"),
            known(proper + penalty - proper).alias("format_penalty"),
            known(s["b"]).alias("brier"),
            known(s["lp"]).alias("log_prob"),
            known(s["accuracy"]).alias("accuracy"),
            known(s["pt"]).alias("p_truth"),
            known(info_alpha(s["lp"], x["crowd"], eps)).alias("info_alpha"),
            known(x["answered"]).alias("parse_ok"),
            known(x["mass"]).alias("prob_sum_raw"),
            known(s["there"]).alias("truth_in_forecast"),
            known(x["quality"]).alias("format_quality"),
            F.when(missing, F.lit("missing_truth")).alias("error"),
        )

    return let(given, held)


def tool_penalty(reward: Column | str, tool_quality: Column | str, coef: float) -> Column:
    return _c(reward) + F.lit(coef) * (_c(tool_quality) - 1.0)


def unit(v: Column | str) -> Column:
    """L2 normalisation; the zero vector stays."""
    v = _c(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
