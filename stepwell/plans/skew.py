"""Finding the users whose rows are too many for one task.

A per-user window puts all rows of a user in one task. That is fine for ordinary users and
not for a bot or a default id. ``heavy_keys`` names the users with more rows than a task
should hold; operators then treat them on a plan that never gathers their rows.

They are found by sketches of frequent users, one per group of users (a hash of the id), each of at
most ``TRACKED`` users: a task sends at most ``GROUPS * TRACKED`` of them, whatever it read, and a
group is merged by one task. A sketch keeps every user with more than about 4 / ``TRACKED`` of its
group's rows, so one that escapes has no more rows than a task gets anyway once there are
``GROUPS * TRACKED / 4`` tasks. It runs as a job of its own when an operator is called, and what it
finds becomes part of the plan, so a recomputed stage cannot route a user differently from its first
run. Which users are heavy decides how they are computed and never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one user that a task sorts at ease (about 24 bytes each, spilling beyond memory).
ROWS_PER_TASK = 5_000_000
GROUPS, TRACKED = 64, 2048


def heavy_keys(events: DataFrame, key: str = "user_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The values of ``key`` with more than ``rows_per_task`` rows in ``events`` (no NULL), and in
    ``slices`` the number of tasks they should be spread over. A local table."""
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS))
    sketched = (
        events.filter(F.col(key).isNotNull())
        .groupBy(group.alias("_group"))
        .agg(F.expr(f"approx_top_k({key}, {TRACKED}, {TRACKED})").alias("_top"))
    )
    rows = sketched.select(F.explode("_top").alias("_top")).select("_top.*")
    found = rows.filter(F.col("count") > rows_per_task).collect()  # at most GROUPS * TRACKED
    kind = events.schema[key].dataType.simpleString()
    return events.sparkSession.createDataFrame(
        [(r["item"], -(-r["count"] // max(rows_per_task, 1))) for r in found], f"{key} {kind}, slices long"
    )
