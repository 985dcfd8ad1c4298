"""ANSI SQL for every registered query, written apart from the Spark plans.

Funnels use one as-of join per step; retention steps through the calendar by
adding intervals. ``seg`` is a text key for the segment, so that NULL dimensions compare.
"""

from __future__ import annotations

CLICKS = """
    SELECT e.user_id, e.ts AS event_ts, e.event_type AS event_name,
           ['android', 'ios', 'web'][CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 3 + 1]
               AS platform,
           c.c_mktsegment AS channel
    FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id"""

ORDERS = """
    SELECT o.o_custkey AS user_id, o.o_orderdate AS event_ts, o.o_orderstatus AS event_name,
           o.o_orderpriority AS platform, c.c_mktsegment AS channel
    FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""

FULFILMENT = """
    SELECT f.*, c.c_mktsegment AS channel
    FROM (
        SELECT o_custkey AS user_id, o_orderdate AS event_ts, 'order' AS event_name,
               o_orderpriority AS platform
        FROM orders
        UNION ALL
        SELECT o_custkey, l_shipdate, 'ship', o_orderpriority
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        UNION ALL
        SELECT o_custkey, l_shipdate, 'return', o_orderpriority
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_returnflag = 'R'
    ) f LEFT JOIN customer c ON c.c_custkey = f.user_id"""

CLICK_STEPS = ["signup", "view", "click", "purchase"]
ORDER_STEPS = ["O", "F", "P"]
SHIP_STEPS = ["order", "ship", "return"]
CUBE = ["level", "channel", "platform"]


def _cube_of(source: str) -> str:
    return f"""
    SELECT b.user_id, b.event_ts, b.event_name, l.level,
           CASE WHEN l.keep_channel THEN b.channel END AS channel,
           CASE WHEN l.keep_platform THEN b.platform END AS platform
    FROM ({source}) b,
         (VALUES ('all', false, false), ('channel', true, false),
                 ('platform', false, true), ('channel+platform', true, true))
             AS l(level, keep_channel, keep_platform)"""


def _events(source: str, by: list[str], where: str) -> str:
    """``ev`` (with ``seg``) and ``segs``, the segments present."""
    parts = [f"coalesce(CAST({c} AS VARCHAR), '~')" for c in by]
    seg = " || '|' || ".join(parts) if parts else "'everything'"
    columns = "".join(f", any_value({c}) AS {c}" for c in by)
    present = f"SELECT seg{columns} FROM ev GROUP BY seg" if by else "SELECT 'everything' AS seg"
    return f"""ev AS (SELECT *, {seg} AS seg FROM ({source}) src WHERE {where}),
segs AS ({present})"""


def _cols(by: list[str], alias: str) -> str:
    return "".join(f"{alias}.{c}, " for c in by)


def _chain(steps: list[str], seconds: int | None, anchor: str, prefix: str = "s") -> str:
    """CTE ``<prefix><last>``: one row per user who fired step 0, times NULL when not reached.

    Each further step is an as-of join: the nearest later event of its name, which is kept if it
    lies within the window.
    """
    chain = f"""SELECT seg, user_id, min(event_ts) AS t0 FROM ev
    WHERE event_name = '{steps[0]}' GROUP BY ALL"""
    for i, step in enumerate(steps[1:], 1):
        limit = "TRUE"
        if seconds is not None:
            limit = f"hit.at - now.t{0 if anchor == 'entry' else i - 1} <= to_seconds({seconds})"
        chain = f"""SELECT now.*, CASE WHEN {limit} THEN hit.at END AS t{i}
    FROM ({chain}) now
    ASOF LEFT JOIN (SELECT seg AS in_seg, user_id AS by_user, event_ts AS at FROM ev
                    WHERE event_name = '{step}') hit
      ON now.seg = hit.in_seg AND now.user_id = hit.by_user AND now.t{i - 1} < hit.at"""
    return f"{prefix}{len(steps) - 1} AS ({chain})"


def _decorated(by: list[str], counts: str) -> str:
    """Funnel columns from a ``counts`` relation (seg, step_index, step_name, users, median)."""
    return f"""
SELECT {_cols(by, 'g')}c.step_index, c.step_name, c.users, c.median_hours,
       CASE WHEN c.step_index = 0 OR (c.before = 0 AND c.users = 0) THEN CAST(1 AS DOUBLE)
            WHEN c.before = 0 THEN CAST('inf' AS DOUBLE)
            ELSE CAST(c.users AS DOUBLE) / c.before END AS step_conversion,
       CASE WHEN c.entered = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(c.users AS DOUBLE) / c.entered END AS overall_conversion,
       CAST(CASE WHEN c.step_index = 0 THEN 0 ELSE c.before - c.users END AS BIGINT) AS dropped
FROM (SELECT *, lag(users) OVER w AS before, first_value(users) OVER w AS entered
      FROM ({counts}) x WINDOW w AS (PARTITION BY seg ORDER BY step_index)) c
JOIN segs g ON g.seg = c.seg"""


def funnel(source, steps, hours, anchor="entry", by=(), where="true") -> str:
    by, seconds, last = list(by), int(hours * 3600), len(steps) - 1
    counts = []
    for i, step in enumerate(steps):
        median = (
            "CAST(0 AS DOUBLE)"
            if i == 0
            else f"CAST(median(date_diff('second', t.t0, t.t{i})) AS DOUBLE) / 3600"
        )
        counts.append(
            f"""SELECT z.seg, CAST({i} AS INTEGER) AS step_index, '{step}' AS step_name,
       count(t.t{i}) AS users, {median} AS median_hours
FROM segs z LEFT JOIN s{last} t ON t.seg = z.seg GROUP BY z.seg"""
        )
    return f"""WITH {_events(source, by, where)},
{_chain(steps, seconds, anchor)}
{_decorated(by, ' UNION ALL '.join(counts))}"""


def _naive_counts(steps: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT z.seg, CAST({i} AS INTEGER) AS step_index, '{step}' AS step_name,
       count(DISTINCT e.user_id) AS users, CAST(NULL AS DOUBLE) AS median_hours
FROM segs z LEFT JOIN ev e ON e.seg = z.seg AND e.event_name = '{step}' GROUP BY z.seg"""
        for i, step in enumerate(steps)
    )


def quantiles(by: list[str], hours: int) -> str:
    """Users of every step over the segments, and that each quantile is as near as promised."""
    return f"""
SELECT step_index, step_name, CAST(sum(users) AS BIGINT) AS users,
       CAST(p AS DOUBLE) AS probability, TRUE AS within
FROM ({funnel(CLICKS, CLICK_STEPS, hours, by=by)}) f, (VALUES (0.1), (0.5), (0.9)) q(p)
GROUP BY step_index, step_name, p HAVING sum(users) > 0"""


def naive(source, steps, by=(), where="true") -> str:
    by = list(by)
    return f"WITH {_events(source, by, where)}\n{_decorated(by, _naive_counts(steps))}"


def _both(source, steps, hours, anchor, where) -> str:
    last = len(steps) - 1
    ordered = " UNION ALL ".join(
        f"SELECT {i} AS i, (SELECT count(t{i}) FROM s{last}) AS users,"
        f" (SELECT count(t{i}) FROM u{last}) AS in_order"
        for i in range(len(steps))
    )
    return f"""WITH {_events(source, [], where)},
{_chain(steps, int(hours * 3600), anchor)},
{_chain(steps, None, anchor, 'u')},
ordered AS ({ordered}),
naive AS ({_naive_counts(steps)}),
both_counts AS (
    SELECT n.step_index, n.step_name, o.users AS ordered_users, o.in_order, n.users AS naive_users
    FROM naive n JOIN ordered o ON o.i = n.step_index)"""


def compare(source, steps, hours, anchor="entry", where="true") -> str:
    return f"""{_both(source, steps, hours, anchor, where)}
SELECT step_index, step_name, ordered_users AS users_ordered,
       CAST(ordered_users AS DOUBLE)
           / (SELECT ordered_users FROM both_counts WHERE step_index = 0)
           AS overall_conversion_ordered,
       naive_users AS users_naive,
       CAST(naive_users AS DOUBLE)
           / (SELECT naive_users FROM both_counts WHERE step_index = 0)
           AS overall_conversion_naive,
       naive_users - ordered_users AS overcount
FROM both_counts"""


def reasons(source, steps, hours, anchor="entry") -> str:
    return f"""{_both(source, steps, hours, anchor, 'true')}
SELECT step_index, step_name, naive_users AS users_naive, ordered_users AS counted,
       in_order - ordered_users AS out_of_window, naive_users - in_order AS out_of_order
FROM both_counts"""


def retention_ctes(
    source, period, anchor, activity, max_periods, by=(), where="true", horizon="segment",
    consecutive=False,
) -> str:
    """CTEs up to ``long``, which has the columns of the retention result (and ``seg``)."""
    by = list(by)
    same = "x.seg = s.seg" if horizon == "segment" else "true"
    run = ""
    if consecutive:
        run = f"""AND (SELECT count(DISTINCT date_trunc('{period}', r.event_ts)) FROM ev r
               WHERE r.seg = a.seg AND r.user_id = a.user_id AND r.event_name = '{activity}'
                 AND date_trunc('{period}', r.event_ts) >= a.cohort
                 AND date_trunc('{period}', r.event_ts) <= a.cohort + k * INTERVAL 1 {period}
              ) = k + 1"""
    return f"""WITH {_events(source, by, where)},
anchors AS (SELECT seg, user_id, CAST(date_trunc('{period}', min(event_ts)) AS TIMESTAMP) AS cohort
    FROM ev WHERE event_name = '{anchor}' GROUP BY seg, user_id),
returns AS (
    SELECT a.seg, a.cohort, i.k, count(DISTINCT a.user_id) AS n
    FROM anchors a
    CROSS JOIN (SELECT unnest(generate_series(0, {max_periods})) AS k) i
    JOIN ev e ON e.seg = a.seg AND e.user_id = a.user_id AND e.event_name = '{activity}'
         AND date_trunc('{period}', e.event_ts) = a.cohort + i.k * INTERVAL 1 {period}
    WHERE true {run}
    GROUP BY a.seg, a.cohort, i.k),
cells AS (
    SELECT s.seg, s.cohort, s.n AS cohort_size, CAST(i.k AS BIGINT) AS period_index,
           s.cohort + i.k * INTERVAL 1 {period}
               <= (SELECT max(x.event_ts) FROM ev x WHERE {same}) AS observed
    FROM (SELECT seg, cohort, count(*) AS n FROM anchors GROUP BY seg, cohort) s
    CROSS JOIN (SELECT unnest(generate_series(0, {max_periods})) AS k) i),
long AS (
    SELECT {_cols(by, 'g')}c.cohort AS cohort_period, c.cohort_size, c.period_index, c.observed,
           CAST(CASE WHEN c.observed THEN coalesce(r.n, 0) END AS BIGINT) AS active_users,
           CASE WHEN c.observed THEN CAST(coalesce(r.n, 0) AS DOUBLE) / c.cohort_size END
               AS retention
    FROM cells c JOIN segs g ON g.seg = c.seg
    LEFT JOIN returns r ON r.seg = c.seg AND r.cohort = c.cohort AND r.k = c.period_index)"""


MONTH = (ORDERS, "month", "O", "F", 12)
WEEK = (CLICKS, "week", "signup", "purchase", 5)


def _long(*args, **options) -> str:
    return retention_ctes(*args, **options) + "\nSELECT * FROM long"


def _matrix(ctes: str, value: str, max_periods: int) -> str:
    cells = ", ".join(
        f'max(CASE WHEN period_index = {k} THEN {value} END) AS "{k}"'
        for k in range(max_periods + 1)
    )
    return f"{ctes}\nSELECT cohort_period, {cells} FROM long GROUP BY cohort_period"


def _blended(ctes: str, by: str = "") -> str:
    return f"""{ctes}
SELECT {by}period_index, count(DISTINCT cohort_period) AS cohorts,
       CAST(sum(cohort_size) AS BIGINT) AS users,
       CAST(sum(active_users) AS BIGINT) AS active_users,
       CAST(sum(active_users) AS DOUBLE) / CAST(sum(cohort_size) AS DOUBLE) AS retention
FROM long WHERE observed GROUP BY {by}period_index"""


def _kpis() -> str:
    curve = _blended(retention_ctes(*WEEK))
    steps = funnel(CLICKS, CLICK_STEPS, 72)
    return f"""SELECT
    (SELECT users FROM ({steps}) f WHERE step_index = 0) AS entered,
    (SELECT users FROM ({steps}) f WHERE step_index = 3) AS converted,
    (SELECT overall_conversion FROM ({steps}) f WHERE step_index = 3) AS end_to_end_conversion,
    (SELECT retention FROM ({curve}) c WHERE period_index = 1) AS period_1_retention"""


def _mix_shift() -> str:
    return f"""{retention_ctes(*MONTH, by=['channel'])},
sides AS (
    SELECT channel, year(cohort_period) = 1996 AS target,
           CAST(sum(cohort_size) AS DOUBLE) AS users, CAST(sum(active_users) AS DOUBLE) AS active
    FROM long WHERE observed AND period_index = 1 GROUP BY ALL),
rates AS (
    SELECT channel, target, users / sum(users) OVER (PARTITION BY target) AS share,
           active / users AS rate
    FROM sides),
paired AS (
    SELECT channel,
           coalesce(b.share, 0) AS share_base, coalesce(t.share, 0) AS share_target,
           b.rate AS rate_base, t.rate AS rate_target
    FROM (SELECT * FROM rates WHERE NOT target) b
    FULL JOIN (SELECT * FROM rates WHERE target) t USING (channel))
SELECT channel, share_base, share_target, rate_base, rate_target,
       (share_target - share_base) * coalesce(rate_base, rate_target) AS mix_effect,
       share_target * (coalesce(rate_target, rate_base) - coalesce(rate_base, rate_target))
           AS rate_effect
FROM paired"""


def _confidence(z: float = 1.959963984540054) -> str:
    z, z2 = f"CAST({z!r} AS DOUBLE)", f"CAST({z * z!r} AS DOUBLE)"
    centre = f"(retention + {z2} / (2 * size))"
    margin = (
        f"({z} * sqrt(retention * (1 - retention) / size"
        f" + {z2} / (CAST(4 AS DOUBLE) * size * size)))"
    )
    return f"""{retention_ctes(*MONTH)}
SELECT cohort_period, cohort_size, period_index, observed, active_users, retention,
       ({centre} - {margin}) / (1 + {z2} / size) AS ci_low,
       ({centre} + {margin}) / (1 + {z2} / size) AS ci_high
FROM (SELECT *, CAST(cohort_size AS DOUBLE) AS size FROM long) l"""


def _quality() -> str:
    names = "('signup', 'view', 'click', 'purchase')"
    late = "TIMESTAMP '2024-01-29 00:00:00'"
    checks = [
        ("known_event_name", f"event_name NOT IN {names}"),
        ("before_horizon", f"event_ts >= {late}"),
        *[
            (f"{c}_not_null", f"{c} IS NULL")
            for c in ["user_id", "event_ts", "event_name", "platform"]
        ],
    ]
    rows = [
        f"SELECT '{label}' AS \"check\", count(*) AS checked,"
        f" count(*) FILTER (WHERE {bad}) AS violations FROM ev"
        for label, bad in checks
    ]
    per_user = [
        (
            "anchor_comes_first",
            "NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = u.user_id"
            " AND e.event_name = 'signup' AND e.event_ts ="
            " (SELECT min(m.event_ts) FROM ev m WHERE m.user_id = u.user_id))",
        ),
        (
            "exactly_one_anchor",
            "(SELECT count(*) FROM ev e WHERE e.user_id = u.user_id"
            " AND e.event_name = 'signup') <> 1",
        ),
    ]
    rows += [
        f"SELECT '{label}', count(*), CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT)"
        f" FROM (SELECT {bad} AS bad FROM (SELECT DISTINCT user_id FROM ev) u) q"
        for label, bad in per_user
    ]
    return f"WITH ev AS ({CLICKS})\n" + "\nUNION ALL\n".join(rows)


def _first_events(source: str) -> str:
    return (
        "SELECT DISTINCT user_id, event_name,"
        " first_value(event_ts) OVER (PARTITION BY user_id, event_name ORDER BY event_ts)"
        f" AS event_ts FROM ({source}) s"
    )


def _sweep() -> str:
    parts = []
    for hours in (12, 24, 48, 96, 192):
        counts = ", ".join(
            f"(SELECT users FROM f WHERE step_index = {i}) AS users_{i}" for i in range(4)
        )
        inner = funnel(CLICKS, CLICK_STEPS, hours)
        parts.append(
            f"SELECT CAST({hours} AS INTEGER) AS window_hours, {counts}"
            f" FROM (SELECT 1) one"
        )
        parts[-1] = f"SELECT * FROM (WITH f AS ({inner}) {parts[-1]}) w{hours}"
    return " UNION ALL ".join(parts)


def all_oracles() -> dict[str, str]:
    year = 24 * 365
    entry = funnel(CLICKS, CLICK_STEPS, 72)
    by_channel = retention_ctes(*MONTH, by=["channel"])
    step_times = f"""WITH {_events(CLICKS, [], "true")},
{_chain(CLICK_STEPS, None, "entry")},
users AS (SELECT DISTINCT user_id FROM ev
          WHERE event_name IN ('signup', 'view', 'click', 'purchase'))
SELECT u.user_id, t0, t1, t2, t3 FROM users u LEFT JOIN s3 ON s3.user_id = u.user_id"""
    some = "platform IN ('ios', 'web') AND channel IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')"
    week_in_january = (
        "event_ts >= TIMESTAMP '2024-01-08 00:00:00' AND event_ts < TIMESTAMP '2024-01-15 00:00:00'"
    )
    return {
        "funnel_entry_72h": entry,
        "funnel_previous_72h": funnel(CLICKS, CLICK_STEPS, 72, "previous"),
        "funnel_entry_6h": funnel(CLICKS, CLICK_STEPS, 6),
        "funnel_fractional_window": funnel(CLICKS, CLICK_STEPS, 30.7501, "previous"),
        "funnel_heavy_users": entry,
        "funnel_some_heavy_users": entry,
        "funnel_heavy_eight_steps": funnel(
            f"SELECT * REPLACE (event_name || '_' || platform AS event_name) FROM ({CLICKS}) k",
            [f"{name}_{place}" for name in CLICK_STEPS for place in ("ios", "web")],
            240,
        ),
        "funnel_quantiles": quantiles([], 72),
        "funnel_quantiles_rolled_up": quantiles(["platform"], 240),
        "funnel_filtered": funnel(CLICKS, CLICK_STEPS, 72, where=some),
        "funnel_step_filtered_out": funnel(
            CLICKS, CLICK_STEPS, 168, where="event_name IN ('signup', 'view', 'purchase')"
        ),
        "funnel_by_channel": funnel(CLICKS, CLICK_STEPS, 72, by=["channel"]),
        "funnel_by_platform": funnel(CLICKS, CLICK_STEPS, 168, by=["platform"]),
        "funnel_by_user_channel": funnel(CLICKS, CLICK_STEPS, 72, by=["channel"]),
        "funnel_report": f"""
SELECT step_index, step_name, users, round_even(median_hours, 2) AS median_hours,
       round_even(step_conversion, 4) AS step_conversion,
       printf('%.1f%%', overall_conversion * 100) AS overall_conversion, dropped
FROM ({entry}) f""",
        "funnel_cube": funnel(_cube_of(CLICKS), CLICK_STEPS, 168, by=CUBE),
        "naive_funnel": naive(CLICKS, CLICK_STEPS),
        "naive_funnel_by_channel": naive(
            CLICKS, CLICK_STEPS, by=["channel"], where="platform = 'ios'"
        ),
        "orders_compare_by_channel": f"""
SELECT o.channel, o.platform, o.step_index, o.step_name, o.users AS users_ordered,
       o.overall_conversion AS overall_conversion_ordered, n.users AS users_naive,
       n.overall_conversion AS overall_conversion_naive, n.users - o.users AS overcount
FROM ({funnel(ORDERS, ORDER_STEPS, year, by=["channel", "platform"])}) o
JOIN ({naive(ORDERS, ORDER_STEPS, by=["channel", "platform"])}) n
  ON o.channel IS NOT DISTINCT FROM n.channel AND o.platform IS NOT DISTINCT FROM n.platform
     AND o.step_index = n.step_index""",
        "naive_funnel_cube": naive(_cube_of(CLICKS), CLICK_STEPS, by=CUBE),
        "naive_funnel_by_priority": naive(ORDERS, ["P", "O", "F"], by=["platform"]),
        "funnel_compare_72h": compare(CLICKS, CLICK_STEPS, 72),
        "orders_compare": compare(ORDERS, ORDER_STEPS, year, "previous"),
        "overcount_reasons": reasons(CLICKS, CLICK_STEPS, 72),
        "orders_overcount_reasons": reasons(ORDERS, ORDER_STEPS, year),
        "orders_funnel_ties": funnel(ORDERS, ORDER_STEPS, year),
        "orders_funnel_previous": funnel(ORDERS, ORDER_STEPS, year, "previous"),
        "ship_funnel": funnel(FULFILMENT, SHIP_STEPS, 24 * 60),
        "ship_funnel_by_channel": funnel(
            FULFILMENT, SHIP_STEPS, 24 * 60, "previous", by=["channel"]
        ),
        "step_times": step_times,
        "window_sweep": _sweep(),
        "retention_week": _long(*WEEK),
        "retention_month": _long(*MONTH),
        "retention_matrix": _matrix(retention_ctes(*MONTH), "retention", 12),
        "retention_report": "SELECT strftime(cohort_period, '%Y-%m-%d') AS cohort_period, "
        + ", ".join(f'round_even("{k}", 3) AS "{k}"' for k in range(13))
        + f" FROM ({_matrix(retention_ctes(*MONTH), 'retention', 12)}) m",
        "active_users_matrix": _matrix(retention_ctes(*WEEK), "active_users", 5),
        "blended_curve": _blended(retention_ctes(*MONTH)),
        "retention_filtered": _long(*MONTH, where="platform = '1-URGENT'"),
        "retention_by_channel": _long(*MONTH, by=["channel"]),
        "retention_filtered_by_user": _long(
            CLICKS, "week", "signup", "purchase", 5, where="channel IN ('BUILDING', 'MACHINERY')"
        ),
        "retention_global_horizon": _long(
            CLICKS, "week", "signup", "click", 3, by=["channel", "platform"], horizon="global"
        ),
        "blended_by_channel": _blended(by_channel, "channel, "),
        "segment_summary": f"""{by_channel}
SELECT channel,
       CAST(sum(cohort_size) FILTER (WHERE period_index = 0) AS BIGINT) AS signups,
       CAST(sum(active_users) FILTER (WHERE observed AND period_index = 1) AS DOUBLE)
         / CAST(sum(cohort_size) FILTER (WHERE observed AND period_index = 1) AS DOUBLE) AS period_1,
       CAST(sum(active_users) FILTER (WHERE observed AND period_index = 2) AS DOUBLE)
         / CAST(sum(cohort_size) FILTER (WHERE observed AND period_index = 2) AS DOUBLE) AS period_2
FROM long GROUP BY channel""",
        "channel_mix": f"""{by_channel}
SELECT cohort_period, channel, cohort_size AS signups,
       CAST(cohort_size AS DOUBLE) / CAST((SELECT sum(o.cohort_size) FROM long o
           WHERE o.period_index = 0 AND o.cohort_period = l.cohort_period) AS DOUBLE) AS share
FROM long l WHERE period_index = 0""",
        "cohort_contrast": _blended(
            retention_ctes(*MONTH).replace(
                "c.cohort AS cohort_period",
                "CASE WHEN year(c.cohort) = 1996 THEN 'campaign' ELSE 'other' END AS cohort_group,"
                " c.cohort AS cohort_period",
            ),
            "cohort_group, ",
        ),
        "mix_shift": _mix_shift(),
        "cohort_sizes": """
SELECT strftime(cohort, '%Y-%m-%d') AS cohort, count(*) AS signups
FROM (SELECT date_trunc('month', min(o_orderdate)) AS cohort
      FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) a
GROUP BY 1""",
        "kpi_row": _kpis(),
        "retention_consecutive": _long(*WEEK, consecutive=True),
        "retention_consecutive_month": _long(*MONTH, consecutive=True),
        "retention_ci": _confidence(),
        "cohort_cube_stored": _long(_cube_of(CLICKS), "week", "signup", "purchase", 4, by=CUBE),
        "cohort_cube": _long(_cube_of(CLICKS), "week", "signup", "purchase", 4, by=CUBE),
        "fulfilment_retention": _long(FULFILMENT, "month", "order", "return", 24),
        "distinct_channels": f"SELECT channel FROM ({CLICKS}) e GROUP BY channel",
        "distinct_platforms": f"SELECT platform FROM ({CLICKS}) e GROUP BY platform",
        "distinct_event_names": f"SELECT event_name FROM ({FULFILMENT}) e GROUP BY event_name",
        "event_quality": _quality(),
        "event_histogram": f"""
SELECT event_name, count(*) AS events FROM ({CLICKS}) e GROUP BY event_name""",
        "never_did": f"""
SELECT user_id, count(*) AS times FROM ({ORDERS}) e
WHERE event_name = 'O' AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
GROUP BY user_id""",
        "late_activators": f"""
SELECT a.user_id, a.anchor_ts, p.activity_ts
FROM (SELECT user_id, min(ts) AS anchor_ts FROM events
      WHERE event_type = 'signup' GROUP BY user_id) a
JOIN (SELECT user_id, min(ts) AS activity_ts FROM events
      WHERE event_type = 'purchase' GROUP BY user_id) p ON p.user_id = a.user_id
WHERE p.activity_ts > a.anchor_ts + INTERVAL 36 HOUR""",
        "first_events": _first_events(CLICKS),
        "first_events_incremental": _first_events(CLICKS),
        "first_events_compacted": _first_events(ORDERS),
        "first_events_rewritten": _first_events(ORDERS),
        "first_events_stream": _first_events(CLICKS),
        "naive_from_first_events": naive(ORDERS, ORDER_STEPS),
        "event_table": f"""
SELECT platform, count(*) AS events, min(event_ts) AS first_ts, max(event_ts) AS last_ts,
       (SELECT count(*) FROM events) AS table_rows
FROM ({CLICKS}) e GROUP BY platform""",
        "event_table_late_load": """
SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS events FROM events GROUP BY ALL""",
        "event_table_load_checks": f"""
SELECT "check", checked, violations FROM ({_quality()}) q
WHERE "check" NOT IN ('anchor_comes_first', 'exactly_one_anchor')""",
        "funnel_bucketed": entry,
        "reporting_window_funnel": funnel(CLICKS, CLICK_STEPS, 48, where=week_in_january),
    }
