"""Evaluation runs: work units, resume, records and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollout_units(episodes: DataFrame, rollouts: int) -> DataFrame:
    """Each event with rollout_idx 0 .. rollouts - 1."""
    return episodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1))).alias("rollout_idx"))


def remaining(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units without a record. A missing index is 0; error records count as done."""
    keys = done.select("event_id", F.coalesce("rollout_idx", F.lit(0)).alias("rollout_idx")).distinct()
    return units.join(keys, ["event_id", "rollout_idx"], "left_anti")


def _mean(value: Column, scored: Column) -> Column:
    return F.avg(F.when(scored, value))


def scorecard(records: DataFrame, keys: tuple[str, ...] = (), position: str | None = None) -> DataFrame:
    """Counts and means by ``keys`` (all records without).

    With a ``position``, a column that orders the records, the card begins with the run_id
    and model_name of the first one, null where it has none.
    ``has_error`` tells whether a record has the error key, even with a null in it.
    Scored records have no such key and a true parse_ok; a mean skips nulls.
    """
    scored = ~F.col("has_error") & F.coalesce(F.col("parse_ok"), F.lit(False))
    first = F.min_by(F.struct("run_id", "model_name"), position) if position else None
    identity = [first[c].alias(c) for c in ("run_id", "model_name")] if position else []
    return records.groupBy(*keys).agg(
        *identity,
        F.count("*").alias("n_rows"),
        F.count_if(scored).alias("n_scored"),
        F.count_if("has_error").alias("n_errors"),
        _mean(F.col("brier"), scored).alias("brier"),
        (-_mean(F.col("log_prob"), scored)).alias("log_loss"),
        _mean(F.col("accuracy"), scored).alias("accuracy"),
        _mean(F.col("info_alpha"), scored).alias("info_alpha"),
        F.count(F.when(scored, F.col("info_alpha"))).alias("n_info_alpha"),
    )


#: Names and order of a card's lines.
CARD = ("n_rows", "n_scored", "n_errors", "brier", "log_loss", "accuracy", "info_alpha")


def card_text(card: DataFrame, run_id: str = "run", *keys: str) -> DataFrame:
    """The scorecard as aligned text, floats with four digits; one row for each of ``keys``."""
    lines = [F.lit(f"── {run_id} ──")]
    for name in CARD:
        kind = card.schema[name].dataType.simpleString()
        value = F.when(F.col(name).isNotNull(), F.format_string("%.4f", name)) if kind == "double" else F.col(name).cast("string")
        lines.append(F.concat(F.lit(f"  {name:<12} "), F.coalesce(value, F.lit("None"))))
    return card.select(*keys, F.concat_ws("\n", *lines).alias("card"))


#: Names and order of a record's columns.
RECORD = (
    "run_id", "model_name", "split", "mode", "search", "prompt_source", "event_id", "slug", "title", "belief_kind",
    "rollout_idx", "step_idx", "forecast_date", "resolved_label", "agent_forecast", "final_response", "reward", "metric",
    "proper_score", "format_penalty", "brier", "log_prob", "accuracy", "p_truth", "parse_ok", "prob_sum_raw",
    "truth_in_forecast", "info_alpha", "crowd_prob", "format_quality", "format_answer_ok", "format_notebook_ok",
    "termination", "metrics",
)


def records(rows: DataFrame) -> DataFrame:
    """All record columns in order; those absent from ``rows`` are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in RECORD])


def sample_rows(steps: DataFrame) -> DataFrame:
    """Training samples: status by termination, metadata as one struct."""
    status = F.when(F.col("termination") == "task_complete", "COMPLETED").otherwise("TRUNCATED")
    return steps.select("group_index", "rollout_id", "reward", status.alias("status"), F.struct("step_idx", "forecast_date").alias("metadata"))
