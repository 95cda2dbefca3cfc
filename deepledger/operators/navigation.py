"""Navigation: validation, track diagnostics, as-of synchronisation and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deepledger.functions import constants as K
from deepledger.functions.geo import finite, haversine, heading


def micros(c: str | Column) -> Column:
    """Microseconds of a timestamp column, with or without a time zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def validated(fixes: DataFrame) -> DataFrame:
    """fixes with reject_reason (null if valid) and issues, faults that leave a fix valid."""
    lat, lon = finite(F.col("lat")), finite(F.col("lon"))
    reason = (
        F.when(lat.isNull() | lon.isNull(), "missing coordinates")
        .when(F.abs(lat) > 90, "latitude outside valid range [-90, 90]")
        .when(F.abs(lon) > 180, "longitude outside valid range [-180, 180]")
    )
    issues = F.array_compact(F.array(
        F.when(F.col("ts").isNull(), "timestamp missing"), F.when((F.col("heading_deg") < 0) | (F.col("heading_deg") > 360), "heading outside valid range [0, 360]"),
        F.when(F.col("altitude_m") < 0, "altitude negative"), F.when(F.col("accuracy_m") < 0, "accuracy negative"),
    ))
    return fixes.withColumns({"reject_reason": reason, "issues": issues})


def diagnosed(fixes: DataFrame) -> DataFrame:
    """Valid dated fixes with their step from the one before and `invalid`: a duplicate, or an end of an impossible jump."""
    order = Window.partitionBy("survey_id").orderBy("ts", "fix_id")
    rows = validated(fixes).where("reject_reason is null and ts is not null")
    before = lambda c, k=1: F.lag(c, k).over(order)
    rows = rows.withColumns({"dt_s": (micros("ts") - micros(before("ts"))) / 1e6, "step_m": haversine(before("lat"), before("lon"), F.col("lat"), F.col("lon"))})
    same = (F.col("dt_s") <= 0) & (before("lat") == F.col("lat")) & (before("lon") == F.col("lon"))
    far = (F.col("dt_s") > 0) & (F.col("step_m") / F.col("dt_s") > K.MAX_SPEED_MPS) & (F.col("step_m") > K.MIN_JUMP_M)
    rows = rows.withColumns({"duplicate": F.coalesce(same, F.lit(False)), "jump": F.coalesce(far, F.lit(False))})
    either = F.col("jump") | F.coalesce(F.lead("jump").over(order), F.lit(False))
    return rows.withColumn("invalid", F.when(F.col("duplicate"), "duplicate timestamp").when(either, "impossible jump"))


def track_stats(fixes: DataFrame) -> DataFrame:
    """A row for each survey: totals, rejected, duplicates, jumps, gaps over 60 s and the span of time."""
    totals = validated(fixes).groupBy("survey_id").agg(F.count("*").alias("total"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
    steps = diagnosed(fixes).groupBy("survey_id").agg(
        F.count_if(F.col("invalid").isNull()).alias("valid"), F.count_if("duplicate").alias("duplicates"), F.count_if(F.col("invalid") == "impossible jump").alias("jump_ends"),
        F.count_if(F.col("dt_s") > K.GAP_S).alias("gaps"), F.round((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6, 3).alias("span_s"),
    )
    return totals.join(steps, "survey_id", "left")


def shortest_arc(a: Column, b: Column, share: Column) -> Column:
    """Heading between two, along the shorter way round."""
    return F.pmod(a + (F.pmod(b - a + 540, F.lit(360.0)) - 180) * share, F.lit(360.0))


def synchronised(frames: DataFrame, fixes: DataFrame) -> DataFrame:
    """Each frame (survey_id, frame_id, ts) with a position from its survey's track.

    The first fix within a second before or after, else between the fixes on both sides by linear interpolation, else the nearest
    end. One union ordered by time carries the last fix before and the first one after to every frame, so nothing is paired; the
    first fix within the window is looked up in a second such pass, shifted by the window.
    """
    track = diagnosed(fixes).where("invalid is null").select("survey_id", "ts", "fix_id", F.struct("ts", "fix_id", "lat", "lon", heading(F.col("heading_deg")).alias("heading_deg"), "altitude_m", "accuracy_m").alias("fix"))
    window = F.expr(f"interval {int(K.EXACT_SYNC_S)} second")
    marks = frames.select("survey_id", "ts", F.lit(None).cast("long").alias("fix_id"), F.lit(None).cast(track.schema["fix"].dataType).alias("fix"), "frame_id")
    both = track.withColumn("frame_id", F.lit(None).cast("long")).withColumn("at", F.col("ts")).withColumn("kind", F.lit(1))
    # a frame comes after the fixes of its own time, and its early mark before the fixes a second earlier
    late = marks.withColumn("at", F.col("ts")).withColumn("kind", F.lit(2))
    early = marks.withColumn("at", F.col("ts") - window).withColumn("kind", F.lit(0))
    rows = both.unionByName(late).unionByName(early)
    order = Window.partitionBy("survey_id").orderBy("at", "kind", "fix_id", "frame_id")
    previous = F.last("fix", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("fix", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = rows.withColumns({"before": previous, "after": following}).where("frame_id is not null")
    sides = found.groupBy("survey_id", "frame_id", "ts").agg(
        F.max(F.when(F.col("kind") == 2, F.col("before"))).alias("a"), F.max(F.when(F.col("kind") == 2, F.col("after"))).alias("b"), F.max(F.when(F.col("kind") == 0, F.col("after"))).alias("e")
    )
    gap = lambda c: (micros(f"{c}.ts") - micros("ts")) / 1e6
    exact = F.col("e").isNotNull() & (gap("e") <= K.EXACT_SYNC_S)
    between = F.col("a").isNotNull() & F.col("b").isNotNull()
    share = gap("a") / (gap("a") - gap("b"))
    one = F.when(exact, F.col("e")).otherwise(F.coalesce("a", "b"))
    pick = lambda name, mixed: F.when(exact | ~between, one[name]).otherwise(mixed)
    linear = lambda name: F.col(f"a.{name}") + (F.col(f"b.{name}") - F.col(f"a.{name}")) * share
    method = F.when(exact, "exact_timestamp").when(between, "interpolated").when(F.coalesce("a", "b").isNotNull(), "nearest").otherwise("none")
    return sides.select(
        "survey_id", "frame_id", method.alias("method"), F.round(pick("lat", linear("lat")), 7).alias("lat"), F.round(pick("lon", linear("lon")), 7).alias("lon"),
        F.round(pick("heading_deg", shortest_arc(F.col("a.heading_deg"), F.col("b.heading_deg"), share)), 4).alias("heading_deg"), F.round(pick("altitude_m", linear("altitude_m")), 4).alias("altitude_m"),
        pick("accuracy_m", F.greatest("a.accuracy_m", "b.accuracy_m")).alias("accuracy_m"),
    )


def sessions(fixes: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of fixes of a survey without a gap that long; a batch or a stream with a watermark on ts."""
    return fixes.groupBy("survey_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("fixes"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("s")
