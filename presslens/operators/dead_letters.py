"""Dead letters ``(failed_at, reason, url)`` and their retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.session import written

MAX_LINES = 1000
ROTATED = "--- log rotated ---"


def retained_lines(old: int, new: int, limit: int) -> tuple[int, bool]:
    """Lines in the log after appending ``new`` ones to ``old``, and if any were dropped.

    Lines are appended one by one. An append that finds ``limit`` lines or more
    first drops the oldest half of the limit and puts one marker line on top.
    The result has a closed form, so a batch needs no stepping through appends.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one line")
    half = limit // 2
    if half < 3:  # an append drops no more lines than the marker and it add
        room = max(limit - old, 0)
        return (old + new, False) if new <= room else (old + room + (new - room) * (2 - half), True)
    shrink = half - 2
    room = max(limit - old, 0)
    if new <= room:
        return old + new, False
    lines, new = old + room, new - room
    shrinking = (lines - limit) // shrink + 1
    if new <= shrinking:
        return lines - new * shrink, True
    lines, new = lines - shrinking * shrink, new - shrinking
    room = limit - lines
    if new <= room:
        return lines + new, True
    in_cycle = (new - room) % (half - 1)
    return (limit if in_cycle == 0 else limit - shrink + in_cycle - 1), True


def append_dead_letters(
    log: DataFrame, failures: DataFrame, now: str, limit: int = MAX_LINES
) -> DataFrame:
    """The log after appending failures, kept near ``limit`` lines.

    Lines are as old as their ``failed_at``, those of one run in URL order. Only
    the two counts reach the driver. The newest lines are a top-k of at most
    ``limit`` rows, never a sort of the whole log.
    """
    failures = written(failures, "failures")  # counted and kept
    old, new = log.count(), failures.count()
    kept, rotated = retained_lines(old, new, limit)
    lines = log.unionByName(failures)
    if not rotated:
        return lines
    if limit == 1:  # half of one line is none: nothing is dropped, markers add up
        newest, markers = lines, kept - old - new
    else:
        entries = lines.where(~F.col("reason").eqNullSafe(ROTATED))
        newest, markers = entries.orderBy(F.desc("failed_at"), F.desc("url")).limit(kept - 1), 1
    marker = log.sparkSession.range(markers).select(
        F.lit(now).alias("failed_at"), F.lit(ROTATED).alias("reason"),
        F.lit(None).cast("string").alias("url"),
    )
    return marker.unionByName(newest)
