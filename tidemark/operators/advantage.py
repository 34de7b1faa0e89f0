"""Group-relative rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_advantage(samples: DataFrame, scale: bool, key: str = "group_index") -> DataFrame:
    """Adds advantage: reward less the group's mean, over (sample deviation + 1e-6) if scaled.

    A single member has 0. Rows with a null key form one group. Groups are summed up before
    they are shuffled and joined back to their rows, so no task holds a group, however large.
    """
    sums = samples.groupBy(F.col(key).alias("_key")).agg(F.avg("reward").alias("_mean"), F.stddev_samp("reward").alias("_sd"), F.count("*").alias("_n"))
    rows = samples.join(sums, F.col(key).eqNullSafe(F.col("_key")))
    centred = F.col("reward") - F.col("_mean")
    value = F.when(F.col("_n") < 2, 0.0).otherwise(centred / (F.col("_sd") + 1e-6) if scale else centred)
    return rows.select(*samples.columns, value.alias("advantage"))
