"""Episode tables: one row per event, or one per event and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.scratch import staged

SORTS = {"forecast_date": ("forecast_date", "eid"), "entry": ("first_date", "last_date", "eid"), "resolution": ("resolves", "last_date", "eid"), "none": ("input_pos",)}


def truth(label: Column | str, kind: Column | str) -> Column:
    label = F.trim(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit("")))
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when((kind == "binary") & F.lower(label).isin("yes", "no"), F.upper(label)).otherwise(label)


def question_payload() -> Column:
    """The static question; legs only where it isn't binary."""
    legs = F.transform("markets", lambda m: F.struct(m["label"].alias("label"), F.coalesce(m["question"], F.lit("")).alias("question")))
    return F.struct(
        F.col("title"),
        F.trim(F.coalesce("body", F.lit(""))).alias("body"),
        F.coalesce(F.substring("close_date", 1, 10), F.lit("")).alias("close_date"),
        F.col("belief_kind"),
        F.when(F.col("belief_kind") != "binary", legs).alias("markets"),
    )


def memory_on(dates: DataFrame) -> DataFrame:
    """(event_id, forecast_dates, crowd_probs) from one row per (event_id, day, crowd)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("day"), F.col("crowd"))))
    nested = dates.groupBy("event_id").agg(pairs.alias("d"))
    return nested.select("event_id", F.col("d.day").alias("forecast_dates"), F.col("d.crowd").alias("crowd_probs"))


def memory_free(episodes: DataFrame) -> DataFrame:
    """One row per date; episodes without dates vanish."""
    pairs = F.explode(F.arrays_zip("forecast_dates", "crowd_probs"))
    kept = [c for c in episodes.columns if c not in ("forecast_dates", "crowd_probs")]
    return episodes.select(*kept, pairs.alias("d")).select(*kept, F.col("d.forecast_dates").alias("forecast_date"), F.col("d.crowd_probs").alias("crowd_prob"))


def build(questions: DataFrame, dates: DataFrame, domains: DataFrame, mode: str = "memory-on", start: str | None = None) -> DataFrame:
    """Episode rows of questions that have dates, with truth, prompt, question and domain columns."""
    base = questions.select(
        "event_id", "slug", "belief_kind", truth("resolved_label", "belief_kind").alias("label"),
        F.concat(F.lit("Forecast: "), F.col("title")).alias("prompt"),
        (F.lit(start) if start else F.substring("start_date", 1, 10)).alias("start_date"),
        question_payload().alias("question"),
    )
    rows = base.join(memory_on(dates), "event_id").join(domains, "event_id", "left")
    return memory_free(rows) if mode == "memory-free" else rows


def _sort_keys(episodes: DataFrame, by: str) -> list[Column]:
    """The keys of the named sort; ids compare as text, ties keep input_pos."""
    keys = {
        "eid": F.col("event_id").cast("string"),
        "first_date": F.element_at("forecast_dates", 1) if "forecast_dates" in episodes.columns else None,
        "last_date": F.element_at("forecast_dates", -1) if "forecast_dates" in episodes.columns else None,
        "forecast_date": F.col("forecast_date") if "forecast_date" in episodes.columns else None,
        "input_pos": F.col("input_pos"),
    }
    if keys["last_date"] is not None and "question" in episodes.columns:
        keys["resolves"] = F.coalesce(F.nullif(F.col("question.close_date"), F.lit("")), keys["last_date"])
    return [*(keys[k] for k in SORTS[by]), F.col("input_pos")]


def ordered(episodes: DataFrame, by: str) -> DataFrame:
    """The rows in order of the named sort."""
    return episodes.orderBy(*_sort_keys(episodes, by))


def write_ordered(episodes: DataFrame, by: str, path: str, parts: int | None = None) -> None:
    """The rows as JSON lines in order of the named sort, written in parallel; input_pos is left out."""
    keys = _sort_keys(episodes, by)
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = episodes.select("*", *named)
    names = [f"_k{i}" for i in range(len(keys))]
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    sinks.episodes(ranges.drop("input_pos", *names), path)


def positions(episodes: DataFrame, by: str) -> DataFrame:
    """Adds position: the place of each row by the named sort, from 1 on.

    Rows are range-partitioned and staged; only counts by partition are added up in one task.
    """
    keys = _sort_keys(episodes, by)
    rows = episodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(parts, "_part").select(*episodes.columns, (F.col("_before") + F.col("_at") + 1).cast("int").alias("position"))


def decode(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lists for both modes, and the slice [start, end) of the rows by input_pos."""
    if "forecast_date" in rows.columns:
        rows = rows.withColumns({"forecast_dates": F.array("forecast_date"), "crowd_probs": F.array("crowd_prob")}).drop("forecast_date", "crowd_prob")
    elif "crowd_probs" not in rows.columns:
        rows = rows.withColumn("crowd_probs", F.array().cast("array<double>"))
    if start is not None:
        rows = rows.filter(F.col("input_pos") >= start)
    return rows if end is None else rows.filter(F.col("input_pos") < end)


def check_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Raises unless the columns are those of the mode."""
    found = "memory-free" if "forecast_date" in rows.columns else "memory-on"
    if found != mode:
        raise ValueError(f"rows are {found}, not {mode}")
    return rows


def steps(episodes: DataFrame) -> DataFrame:
    """One row per (event_id, step_idx, forecast_date, crowd_prob); a probability beyond its list is null."""
    each = episodes.select("event_id", "crowd_probs", F.posexplode("forecast_dates").alias("step_idx", "forecast_date"))
    return each.select("event_id", "step_idx", "forecast_date", F.try_element_at("crowd_probs", F.col("step_idx") + 1).alias("crowd_prob"))


def carried_notebook(rows: DataFrame) -> DataFrame:
    """Adds prev_notebook: what the step before left, null where that left nothing."""
    return rows.withColumn("prev_notebook", F.lag("notebook").over(Window.partitionBy("event_id").orderBy("step_idx")))


def until_failure(rows: DataFrame) -> DataFrame:
    """Steps up to the first failed one, which stays."""
    before = Window.partitionBy("event_id").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_f", F.coalesce(F.sum(F.col("failed").cast("int")).over(before), F.lit(0))).filter("_f = 0").drop("_f")


def window_hull(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.min("start_date").alias("start"), F.max(F.array_max("forecast_dates")).alias("cutoff"))


def step_group(base: Column, step: Column, max_steps: int) -> Column:
    return base * max_steps + step


def question_group(question: Column) -> Column:
    """A stable 40-bit id of a question's content; null without one."""
    return F.when(question.isNotNull(), F.pmod(F.xxhash64(F.to_json(question)), F.lit(1 << 40)))


def merged_spec(default: Column, override: Column, base: Column) -> Column:
    """An override counts only where it differs from the default."""
    return F.coalesce(F.nullif(override, default), base)
