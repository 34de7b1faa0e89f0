"""Prompt texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def question_text(question: Column) -> Column:
    """The question as prompt text, by kind."""
    legs = F.transform(question["markets"], lambda m: F.concat(F.lit("  - '"), m["label"], F.lit("': "), F.coalesce(F.nullif(m["question"], F.lit("")), F.lit("(no per-leg question)"))))
    count = F.coalesce(F.nullif(F.size(question["markets"]), F.lit(-1)), F.lit(0))
    multi = F.concat(
        F.lit("Outcomes ("), count.cast("string"), F.lit(", exactly one resolves YES):\n"), F.coalesce(F.array_join(legs, "\n"), F.lit("")),
        F.lit("\nForecast a probability for each label; the K probabilities must sum to 1."),
    )
    binary = F.lit("Outcomes: YES / NO. Forecast a probability for each label; the two probabilities must sum to 1.")
    body = F.nullif(F.trim(F.coalesce(question["body"], F.lit(""))), F.lit(""))
    head = F.concat(F.lit("Question: "), question["title"], F.lit("\nResolves: "), F.coalesce(F.substring(question["close_date"], 1, 10), F.lit("")), F.lit("\n"))
    return F.concat(head, F.when(question["belief_kind"] == "binary", binary).otherwise(multi), F.coalesce(F.concat(F.lit("\n\nResolution criteria / context:\n"), body), F.lit("")))


def step_prompt(question: Column, forecast_date: Column, notebook: Column | None = None) -> Column:
    """The question with its date, and the notebook (``None`` without one) where notebooks are in use."""
    out = F.concat(question, F.lit("\n\nForecast date: "), forecast_date)
    return out if notebook is None else F.concat(out, F.lit("\n\nBelief Notebook: "), F.coalesce(notebook, F.lit("None")))
