"""Placeholder legs of multi-outcome questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reserved slot looks like, and the nouns that may precede one inside a text.
SLOT = r"(?:[A-Z]{1,2}|\d{1,2}|[A-Z]\d{1,2})"
SLOT_NOUNS = (
    "Player", "Company", "Candidate", "Team", "Option", "App", "Person", "Party", "Song", "Movie", "Show",
    "Album", "Artist", "Country", "Driver", "Constructor", "Game", "Nominee", "Contestant", "Entrant", "Placeholder",
)
WHOLE = rf"(?U)^\s*[A-Z][a-z]+\s+{SLOT}(?:\s+by\s+[A-Z][a-z]+\s+{SLOT})?\s*[?.!]*\s*$"
LITERAL = r"(?Ui)^\s*placeholder\b"
EMBEDDED = rf"(?U)\b(?:{'|'.join(SLOT_NOUNS)})\s+{SLOT}\b"
OTHER = r"(?Ui)^\s*(?:other|none(?:\s+of\s+the\s+above)?)\s*$"
MULTI = "multi_neg_risk"


def placeholder_name(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(label.rlike(WHOLE) | label.rlike(LITERAL) | label.rlike(EMBEDDED) | label.rlike(OTHER), F.lit(False))


def lifetime_notional(volumes: Column) -> Column:
    """Sum over a list of {notional}; nulls are zero."""
    return F.coalesce(F.aggregate(volumes, F.lit(0.0), lambda a, v: a + F.coalesce(v["notional"], F.lit(0.0))), F.lit(0.0))


def placeholder_leg(label: Column, notional: Column) -> Column:
    return placeholder_name(label) & (notional <= 0)


def filter_questions(questions: DataFrame) -> DataFrame:
    """Question rows without placeholder legs.

    Kinds other than multi pass untouched. A multi question goes if its resolved leg is
    a placeholder or fewer than two legs remain. Only markets and num_markets change.
    """
    notional = lambda m: lifetime_notional(F.try_element_at("daily_volume_by_market", m["market_id"]))
    slot = lambda m: placeholder_leg(m["label"], notional(m))
    multi = F.coalesce(F.col("belief_kind") == MULTI, F.lit(False))
    truth = F.trim(F.coalesce("resolved_label", F.lit("")))
    legs = F.coalesce("markets", F.array().cast(questions.schema["markets"].dataType))
    resolved = F.try_element_at(F.filter(legs, lambda m: F.trim(m["label"]) == truth), F.lit(1))
    kept = F.filter(legs, lambda m: ~slot(m))
    broken = multi & (F.coalesce(slot(resolved), F.lit(False)) | (F.size(kept) < 2))
    return questions.filter(~broken).withColumns({
        "markets": F.when(multi, kept).otherwise(F.col("markets")),
        "num_markets": F.when(multi & (F.size(kept) < F.size(legs)), F.size(kept)).otherwise(F.col("num_markets")),
    })


def filter_legs(legs: DataFrame) -> DataFrame:
    """The same in long form: (event_id, label, notional, resolved) rows of multi questions."""
    slot = placeholder_leg(F.col("label"), F.col("notional"))
    marked = legs.withColumn("slot", slot)
    events = marked.groupBy("event_id").agg(F.max(F.col("slot") & F.col("resolved")).alias("broken"), F.count_if(~F.col("slot")).alias("left"))
    good = events.filter(~F.col("broken") & (F.col("left") >= 2)).select("event_id")
    return marked.filter(~F.col("slot")).join(good, "event_id", "left_semi").drop("slot")
