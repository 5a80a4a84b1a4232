"""The same questions in plain SQL for DuckDB, over the same given tables."""

from __future__ import annotations

from funnelry import fixed_values as fv

# The `events` table as a shop's clickstream; see sources/driver_events.py for the rules.
SHOP = """
parts AS (
  SELECT event_id, event_type AS source_type, value,
         CAST(floor(epoch(ts)) AS BIGINT) AS event_ts,
         CAST(props->>'k' AS INTEGER) AS k,
         day(ts) AS d,
         user_id * 10 + CAST(floor((day(ts) - 1) / 10) AS BIGINT) AS user_id
  FROM events),
once AS (
  SELECT event_id,
         strftime(make_timestamp(event_ts * CAST(1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') || ' UTC'
           AS event_time,
         event_ts,
         CASE WHEN user_id % 37 = 0 THEN 'purchase'
              WHEN source_type = 'click' AND k < 15 THEN 'cart'
              WHEN source_type = 'purchase' AND k < 15 THEN 'purchase'
              ELSE 'view' END AS event_type,
         CAST(1000 + k AS BIGINT) AS product_id,
         [NULL, '', 'electronics.smartphone', 'electronics.audio.headphone', 'apparel.shoes',
          'apparel', 'computers.notebook', 'furniture.bedroom.bed', 'appliances.kitchen.oven',
          'auto'][k % 10 + 1] AS category_code,
         [NULL, '', 'acme', 'globex', 'initech', 'stark'][event_id % 6 + 1] AS brand,
         CASE WHEN event_id % 97 = 0 THEN NULL
              WHEN event_id % 89 = 0 THEN 0.0
              WHEN event_id % 83 = 0 THEN -1.0
              ELSE value END::DOUBLE AS price,
         user_id,
         user_id || '-' || d AS user_session
  FROM parts),
shop AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE event_id % 200 = 7)"""

TOP = """CASE WHEN coalesce(category_code, '') = '' THEN '(unknown)'
              ELSE split_part(category_code, '.', 1) END"""


def _rounded(x: str, digits: int = 8) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _query(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SHOP, *ctes]) + "\n" + body


def over_table(sql: str, table: str) -> str:
    """The same question over another event table with an `event_id`."""
    return sql.replace(SHOP, f"shop AS (SELECT * FROM {table})", 1)


def _flags(name: str, unit: str, source: str = "shop") -> str:
    return f"""{name} AS (
  SELECT {unit}, bool_or(event_type = 'view') AS v, bool_or(event_type = 'cart') AS c,
         bool_or(event_type = 'purchase') AS p
  FROM {source} GROUP BY ALL)"""


STEPS = """count(*) FILTER (v) AS step_view, count(*) FILTER (v AND c) AS step_cart,
       count(*) FILTER (v AND c AND p) AS step_purchase"""
CARTERS = "count(*) FILTER (c) AS carters, count(*) FILTER (c AND NOT p) AS abandoned"


def _funnel(unit: str) -> tuple[str, str]:
    return f"SELECT count(*) AS total_units, {STEPS} FROM units", _flags("units", unit)


def _category_funnel(min_viewers: int, limit: int) -> tuple[str, str]:
    body = f"""SELECT top_category, {STEPS} FROM units GROUP BY top_category
HAVING count(*) FILTER (v) >= {min_viewers} ORDER BY step_view DESC, top_category LIMIT {limit}"""
    return body, _flags("units", f"{TOP} AS top_category, user_id")


TILED = """tiled AS (
  SELECT *, CAST(NTILE(4) OVER (ORDER BY price, event_id) AS INTEGER) AS price_quartile
  FROM shop WHERE price > 0)"""

QUARTILES = f"""SELECT price_quartile, min(low) AS price_min, max(high) AS price_max, {STEPS}
FROM (SELECT price_quartile, user_id, min(price) AS low, max(price) AS high,
             bool_or(event_type = 'view') AS v, bool_or(event_type = 'cart') AS c,
             bool_or(event_type = 'purchase') AS p
      FROM tiled GROUP BY price_quartile, user_id)
GROUP BY price_quartile"""

GAPS = """gaps AS (
  SELECT user_id, event_ts, event_ts - lag(event_ts) OVER (
           PARTITION BY user_id ORDER BY event_ts, event_type) AS gap_sec
  FROM shop)"""

FIRSTS = """firsts AS (
  SELECT user_id, min(event_ts) FILTER (event_type = 'view') AS first_view_ts,
         min(event_ts) FILTER (event_type = 'purchase') AS first_purchase_ts
  FROM shop GROUP BY user_id)"""

DELAYS = """delays AS (
  SELECT user_id, first_purchase_ts - first_view_ts AS delay FROM firsts
  WHERE first_purchase_ts >= first_view_ts)"""

MET = """met AS (
  SELECT DISTINCT user_id FROM (
    SELECT user_id, user_session FROM shop GROUP BY user_id, user_session
    HAVING bool_or(event_type = 'view') AND bool_or(event_type = 'purchase')))"""

KEYS = "user_id, user_session, event_ts, event_type, product_id"
COPIES = f"copies AS (SELECT {KEYS}, count(*) AS cnt FROM shop GROUP BY ALL)"
NO_CATEGORY = "coalesce(category_code, '') = ''"
NO_BRAND = "coalesce(brand, '') = ''"
NO_PRICE = "(price IS NULL OR price <= 0)"


def _histogram(value: str, cases: str, label: str, count: str, source: str) -> str:
    return f"""SELECT CASE {cases} END AS {label}, min({value}) AS sort_key, count(*) AS {count}
FROM {source} GROUP BY 1 ORDER BY sort_key"""


def _share(condition: str) -> str:
    return _rounded(f"100.0::DOUBLE * count(*) FILTER ({condition}) / nullif(count(*), 0)", 2)


def _without_view(unit: str) -> str:
    return f"""(SELECT count(*) FROM (
    SELECT 1 FROM shop GROUP BY {unit}
    HAVING bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'view')))"""


# --- inference --------------------------------------------------------------------------
Z = "1.959963984540054::DOUBLE"


def _wilson(k: str, n: str, sign: str) -> str:
    """Score bound; `k` and `n` are column names, n > 0."""
    p = f"({k}::DOUBLE / {n})"
    middle = f"({p} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n})"
    spread = f"sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0::DOUBLE * {n} * {n}))"
    bound = f"{middle} {sign} {Z} / (1 + {Z} * {Z} / {n}) * {spread}"
    clamped = f"greatest(0.0::DOUBLE, {bound})" if sign == "-" else f"least(1.0::DOUBLE, {bound})"
    return f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {clamped} END"


def _upper_gamma(a: str, x: str) -> str:
    """1 - P(a, x) by the power series of the lower incomplete gamma function."""
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, 1 - list_sum(
    [exp(-({x}) + ({a} + i) * ln({x}) - lgamma({a} + i + 1)) for i in range(0, 2000)])) END"""


SPLIT_SEGMENTS = {
    "category": (
        _flags("units", f"{TOP} AS top_category, user_id"),
        f"""segments AS (
  SELECT top_category AS segment, -step_view AS position, step_view, step_cart, step_purchase
  FROM (SELECT top_category, {STEPS} FROM units GROUP BY top_category
        HAVING count(*) FILTER (v) >= 200 ORDER BY step_view DESC, top_category LIMIT 10))""",
    ),
    "price": (
        TILED,
        f"""segments AS (
  SELECT printf('Q%d ($%.0f–$%.0f)', price_quartile, round_even(price_min, 0),
                round_even(price_max, 0)) AS segment,
         CAST(price_quartile AS BIGINT) AS position, step_view, step_cart, step_purchase
  FROM ({QUARTILES}))""",
    ),
}
STEP_TRIALS = {
    "cart": f"SELECT segment, position, '{fv.VIEW_TO_CART}' AS step, step_cart AS k, step_view AS n FROM segments",
    "purchase": f"SELECT segment, position, '{fv.CART_TO_PURCHASE}' AS step, step_purchase AS k, step_cart AS n FROM segments",
}
BOTH_TRIALS = f"trials AS ({STEP_TRIALS['cart']} UNION ALL {STEP_TRIALS['purchase']})"

TESTS = f"""compared AS (
  SELECT *, sum(k) OVER (PARTITION BY step)::BIGINT - k AS rest_k,
         sum(n) OVER (PARTITION BY step)::BIGINT - n AS rest_n,
         count(*) OVER (PARTITION BY step) AS n_tests
  FROM trials),
scored AS (
  SELECT *, CASE WHEN n > 0 AND rest_n > 0 AND k + rest_k > 0 AND k + rest_k < n + rest_n
    THEN (k::DOUBLE / n - rest_k::DOUBLE / rest_n)
       / sqrt((k + rest_k)::DOUBLE / (n + rest_n) * (1 - (k + rest_k)::DOUBLE / (n + rest_n))
              * (1.0::DOUBLE / n + 1.0::DOUBLE / rest_n)) END AS z
  FROM compared),
tailed AS (SELECT *, z * z / 2 AS x FROM scored),
tested AS (
  SELECT * EXCLUDE (p_raw), p_raw AS p_value,
         CASE WHEN p_raw IS NULL THEN '{fv.NOT_TESTABLE}'
              WHEN p_raw < 0.05 / n_tests THEN '{fv.SIGNIFICANT}'
              WHEN p_raw < 0.05 THEN '{fv.BORDERLINE}'
              ELSE '{fv.NO_EVIDENCE}' END AS verdict
  FROM (SELECT *, {_upper_gamma("0.5::DOUBLE", "x")} AS p_raw FROM tailed))"""


def _segment_tests(split: str, key: str) -> str:
    body = f"""SELECT segment, position, step, n, {_rounded("k::DOUBLE / nullif(n, 0)")} AS rate,
  {_rounded("k::DOUBLE / nullif(n, 0) - rest_k::DOUBLE / nullif(rest_n, 0)")} AS rate_vs_rest,
  {_rounded(_wilson("k", "n", "-"))} AS ci_low, {_rounded(_wilson("k", "n", "+"))} AS ci_high,
  {_rounded("z")} AS z, n_tests, {_rounded("0.05::DOUBLE / n_tests")} AS bonferroni_alpha,
  {_rounded("p_value")} AS p_value, verdict FROM tested"""
    return _query(body, *SPLIT_SEGMENTS[split], f"trials AS ({STEP_TRIALS[key]})", TESTS)


def _homogeneity(split: str, key: str) -> str:
    ctes = f"""totals AS (SELECT step, sum(k)::DOUBLE AS all_k, sum(n)::DOUBLE AS all_n,
            count(*) FILTER (n > 0) AS g FROM trials GROUP BY step),
expected AS (
  SELECT step, g, unnest([k, n - k])::DOUBLE AS seen,
         unnest([n * all_k / all_n, n * (all_n - all_k) / all_n]) AS e
  FROM trials JOIN totals USING (step)
  WHERE n > 0 AND g >= 2 AND all_k > 0 AND all_k < all_n),
summed AS (
  SELECT step, any_value(g) - 1 AS df, min(e) AS smallest,
         sum(CASE WHEN g = 2 THEN greatest(abs(seen - e) - 0.5, 0) ELSE abs(seen - e) END ** 2 / e)
           AS chi2
  FROM expected GROUP BY step),
tested AS (
  SELECT *, {_upper_gamma("(df / 2.0::DOUBLE)", "(chi2 / 2)")} AS p FROM summed)"""
    body = f"""SELECT totals.step, {_rounded("chi2")} AS chi2, df, {_rounded("p")} AS p_value,
  coalesce(smallest >= 5, false) AS valid, coalesce(p < 0.05, false) AS differs,
  coalesce(smallest < 5, false) AS approximate
FROM totals LEFT JOIN tested USING (step)"""
    return _query(body, *SPLIT_SEGMENTS[split], f"trials AS ({STEP_TRIALS[key]})", ctes)


def _rate_series(split: str) -> str:
    rate = "coalesce(k::DOUBLE / nullif(n, 0), 0)"
    body = f"""SELECT segment, position, step, {_rounded(f"100 * {rate}")} AS rate_pct,
  {_rounded(f"100 * ({rate} - ({_wilson('k', 'n', '-')}))")} AS err_minus,
  {_rounded(f"100 * (({_wilson('k', 'n', '+')}) - {rate})")} AS err_plus FROM trials"""
    return _query(body, *SPLIT_SEGMENTS[split], BOTH_TRIALS)


def _funnel_steps(unit: str) -> str:
    body = f"""SELECT step_no, step, k, n, {_rounded("k::DOUBLE / nullif(n, 0)")} AS rate,
  {_rounded(_wilson("k", "n", "-"))} AS ci_low, {_rounded(_wilson("k", "n", "+"))} AS ci_high,
  {_rounded("100 * k::DOUBLE / nullif(n, 0)")} AS pct_previous,
  {_rounded("step_purchase::DOUBLE / nullif(step_view, 0)")} AS end_to_end
FROM (SELECT *, 1 AS step_no, '{fv.STEP_VIEWED}' AS step, step_view AS k, step_view AS n FROM f
      UNION ALL SELECT *, 2, '{fv.STEP_CARTED}', step_cart, step_view FROM f
      UNION ALL SELECT *, 3, '{fv.STEP_PURCHASED}', step_purchase, step_cart FROM f)"""
    return _query(body, _flags("units", unit), f"f AS (SELECT {STEPS} FROM units)")


def _significant() -> str:
    parts = []
    for split, ctes in SPLIT_SEGMENTS.items():
        inner = ",\n".join([*ctes, BOTH_TRIALS, TESTS])
        parts.append(
            f"""SELECT * FROM (WITH {inner}
SELECT '{split}' AS split, step,
  count(*) FILTER (verdict = '{fv.SIGNIFICANT}') AS significant,
  coalesce(string_agg(segment, ', ' ORDER BY position, segment)
             FILTER (verdict = '{fv.SIGNIFICANT}'), '') AS segments
FROM tested GROUP BY step)"""
        )
    return _query("\nUNION ALL\n".join(parts))


ABANDONMENT = f"""SELECT 'per user' AS grain, {CARTERS} FROM users
UNION ALL SELECT 'per session', {CARTERS} FROM sessions"""
GRAINS = (_flags("users", "user_id"), _flags("sessions", "user_session"))

PRODUCTS = f"""SELECT product_id, max(coalesce(brand, '(no brand)')) AS brand,
  max(coalesce(category_code, '(unknown)')) AS category_code, {_rounded("avg(price)", 2)} AS avg_price,
  count(*) FILTER (event_type = 'cart') AS cart_adds,
  count(*) FILTER (event_type = 'purchase') AS purchases,
  {_rounded("count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type = 'cart'), 0)", 3)}
    AS purchase_per_cart
FROM shop GROUP BY product_id HAVING count(*) FILTER (event_type = 'cart') >= 20
ORDER BY purchase_per_cart, cart_adds DESC, product_id"""

SUMMARY = """SELECT count(*) AS events, count(DISTINCT user_id) AS users,
  count(DISTINCT user_session) AS sessions, min(event_time) AS first_event,
  max(event_time) AS last_event FROM shop"""

IN_SAMPLE = "CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 3000"

TIDY = """raw AS (
  SELECT * REPLACE (CASE event_id % 50 WHEN 0 THEN 'bad' WHEN 1 THEN replace(event_time, ' UTC', '')
                    WHEN 2 THEN '' ELSE event_time END AS event_time,
                    CASE WHEN event_id % 50 <> 3 THEN user_session END AS user_session)
  FROM (SELECT * EXCLUDE (event_ts) FROM shop)),
tidy AS (
  SELECT event_time, CAST(epoch(t) AS BIGINT) AS event_ts, event_type, product_id, category_code,
         brand, price, user_id, user_session
  FROM (SELECT *, try_strptime(replace(event_time, ' UTC', ''), '%Y-%m-%d %H:%M:%S') AS t FROM raw)
  WHERE t IS NOT NULL AND user_id IS NOT NULL AND user_session IS NOT NULL)"""

STEPS_OF_LOAD = f"""kept AS (
  SELECT event_id % 2 AS batch, user_id FROM raw
  WHERE try_strptime(replace(event_time, ' UTC', ''), '%Y-%m-%d %H:%M:%S') IS NOT NULL
    AND user_id IS NOT NULL AND user_session IS NOT NULL AND {IN_SAMPLE}),
first_batch AS (SELECT user_id, min(batch) AS batch FROM kept GROUP BY user_id),
batches AS (
  SELECT b::BIGINT AS batch, (SELECT count(*) FROM kept WHERE kept.batch = b) AS events,
         (SELECT count(*) FROM first_batch WHERE first_batch.batch = b) AS users
  FROM range(2) AS t(b))"""

COHORT = """cohort AS (SELECT DISTINCT user_id FROM shop WHERE event_type = 'purchase' AND event_ts >= 1705276800)"""
EVENT_ROWS = """event_time, event_ts, event_type, product_id, category_code, brand, price, user_id, user_session"""

# The published bounds and labels of the reports' buckets.
EPS_CASES = """WHEN n_events = 1 THEN '1' WHEN n_events = 2 THEN '2'
  WHEN n_events <= 5 THEN '3-5' WHEN n_events <= 10 THEN '6-10'
  WHEN n_events <= 20 THEN '11-20' ELSE '21+'"""
SPAN_CASES = """WHEN duration_sec = 0 THEN '0s (single event)'
  WHEN duration_sec < 60 THEN '< 1 min' WHEN duration_sec < 300 THEN '1-5 min'
  WHEN duration_sec < 1800 THEN '5-30 min' WHEN duration_sec < 7200 THEN '30 min - 2 h'
  ELSE '> 2 h (suspicious)'"""
GAP_CASES = """WHEN gap_sec = 0 THEN '0s (same second)' WHEN gap_sec < 60 THEN '< 1 min'
  WHEN gap_sec < 600 THEN '1-10 min' WHEN gap_sec < 1800 THEN '10-30 min'
  WHEN gap_sec < 86400 THEN '30 min - 24 h' ELSE '> 24 h (returned another day)'"""
DELAY_CASES = """WHEN delay < 600 THEN '< 10 min' WHEN delay < 3600 THEN '10-60 min'
  WHEN delay < 86400 THEN '1-24 h' WHEN delay < 604800 THEN '1-7 days' ELSE '> 7 days'"""


def all_oracles() -> dict[str, str]:
    found = {
        "funnel_user": _query(*_funnel("user_id")),
        "funnel_session": _query(*_funnel("user_session")),
        "funnel_by_category": _query(*_category_funnel(200, 10)),
        "top_segments": _query(*_category_funnel(380, 5)),
        "funnel_by_price_quartile": _query(QUARTILES + " ORDER BY price_quartile", TILED),
        "events_per_session": _query(
            _histogram("n_events", EPS_CASES, "events_bucket", "sessions", "sizes"),
            "sizes AS (SELECT user_session, count(*) AS n_events FROM shop GROUP BY ALL)",
        ),
        "session_duration": _query(
            _histogram("duration_sec", SPAN_CASES, "duration_bucket", "sessions", "spans"),
            """spans AS (SELECT user_session, max(event_ts) - min(event_ts) AS duration_sec
  FROM shop GROUP BY user_session)""",
        ),
        "lag_event_gaps": _query(
            _histogram(
                "gap_sec", GAP_CASES, "gap_bucket", "gap_count",
                "(SELECT * FROM gaps WHERE gap_sec IS NOT NULL)",
            ),
            GAPS,
        ),
        "time_to_convert": _query(
            f"""SELECT CASE WHEN met.user_id IS NOT NULL THEN 'same session'
  WHEN delay < 86400 THEN 'same day (different session)' ELSE 'later return (> 1 day)' END
    AS convert_bucket, count(*) AS users, {_rounded("avg(delay) / 3600", 2)} AS avg_hours_to_convert
FROM delays LEFT JOIN met USING (user_id) GROUP BY 1 ORDER BY users DESC, convert_bucket""",
            FIRSTS, DELAYS, MET,
        ),
        "time_to_convert_distribution": _query(
            _histogram("delay", DELAY_CASES, "delay_bucket", "users", "delays"), FIRSTS, DELAYS
        ),
        "abandonment_overall": _query(ABANDONMENT, *GRAINS),
        "abandonment_by_category": _query(
            f"""SELECT *, {_rounded("100.0::DOUBLE * abandoned / carters", 1)} AS abandonment_pct
FROM (SELECT top_category, {CARTERS} FROM units GROUP BY top_category) WHERE carters >= 50
ORDER BY abandonment_pct DESC, top_category""",
            _flags("units", f"{TOP} AS top_category, user_id"),
        ),
        "top_abandoned_products": _query(PRODUCTS + " LIMIT 15"),
        "top_products": _query(PRODUCTS + " LIMIT 5"),
        "data_quality": _query(
            f"""SELECT 'total events' AS metric, count(*) AS value, NULL::DOUBLE AS pct FROM shop
UNION ALL SELECT 'events with NULL/empty category_code', count(*) FILTER ({NO_CATEGORY}), {_share(NO_CATEGORY)} FROM shop
UNION ALL SELECT 'events with NULL/empty brand', count(*) FILTER ({NO_BRAND}), {_share(NO_BRAND)} FROM shop
UNION ALL SELECT 'events with NULL or non-positive price', count(*) FILTER ({NO_PRICE}), {_share(NO_PRICE)} FROM shop
UNION ALL SELECT 'duplicate events (redundant rows)', (sum(cnt) - count(*))::BIGINT,
  {_rounded("100.0::DOUBLE * (sum(cnt) - count(*)) / sum(cnt)", 2)} FROM copies
UNION ALL SELECT 'sessions with purchase but no view', {_without_view("user_session")}, NULL
UNION ALL SELECT 'users with purchase but no view (ever)', {_without_view("user_id")}, NULL""",
            COPIES,
        ),
        "dataset_summary": _query(SUMMARY),
        "distinct_counts": _query(SUMMARY),
        "sample_users": _query(
            f"SELECT event_id, event_ts, event_type, user_id, user_session FROM shop WHERE {IN_SAMPLE}"
        ),
        "sample_fraction": _query(
            "SELECT event_id, user_id FROM shop WHERE "
            "CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2500"
        ),
        "clustered_layout": _query("SELECT event_id, user_id, event_ts, event_type, price FROM shop"),
        "blank_to_null": _query(
            """SELECT event_id, nullif(event_time, '') AS event_time, event_type, product_id,
  nullif(category_code, '') AS category_code,
  CASE WHEN event_id % 12 IN (3, 4) THEN NULL ELSE nullif(brand, '') END AS brand,
  CASE WHEN event_id % 12 <> 5 THEN price END AS price, user_id, user_session FROM shop"""
        ),
        "calibrate_keep_buckets": _query(
            """SELECT count(*) AS rows, greatest(1, CAST(round_even(
  least(1.0::DOUBLE, 2000.0::DOUBLE / greatest(count(*), 1)) * 10000, 0) AS BIGINT)) AS keep_buckets FROM shop"""
        ),
        "normalise_events": _query(
            """SELECT *, strftime(make_timestamp(event_ts * CAST(1000000 AS BIGINT)),
  '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown_time FROM tidy""",
            TIDY,
        ),
        "load_report": _query(
            f"SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM tidy WHERE {IN_SAMPLE}",
            TIDY,
        ),
        "multi_line_csv": _query(
            """SELECT nullif(event_time, '') AS event_time, event_type, product_id,
  nullif(category_code, '') AS category_code,
  nullif(CASE WHEN event_id % 5 = 0 THEN brand || chr(10) || '"and", more' ELSE brand END, '') AS brand,
  price, user_id, user_session FROM shop"""
        ),
        "running_load": _query(
            """SELECT *, (sum(events) OVER (ORDER BY batch))::BIGINT AS total_events,
  (sum(users) OVER (ORDER BY batch))::BIGINT AS total_users FROM batches""",
            TIDY, STEPS_OF_LOAD,
        ),
        "reloaded_table": _query(f"SELECT {EVENT_ROWS} FROM shop"),
        "sample_from_files": _query(
            f"SELECT {EVENT_ROWS} FROM shop WHERE {IN_SAMPLE.replace('< 3000', '< 300')}"
        ),
        "cohort_funnel": _query(
            _category_funnel(30, 10)[0],
            COHORT, "members AS (SELECT * FROM shop WHERE user_id IN (SELECT user_id FROM cohort))",
            _flags("units", f"{TOP} AS top_category, user_id", "members"),
        ),
        "cohort_events": _query(
            """SELECT coalesce(user_id IN (SELECT user_id FROM cohort WHERE user_id IS NOT NULL), false) AS in_cohort,
  event_type, count(*) AS events FROM shop GROUP BY ALL""",
            COHORT,
        ),
        "daily_users": _query(
            """SELECT CAST(floor(event_ts / 86400) AS BIGINT) AS day, count(DISTINCT user_id) AS users
FROM shop WHERE user_id IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT user_id) FROM shop"""
        ),
        "bucketed_funnel_user": _query(*_funnel("user_id")),
        "bucketed_abandonment_user": _query(f"SELECT {CARTERS} FROM users", GRAINS[0]),
        "bucketed_time_to_convert_distribution": _query(
            _histogram("delay", DELAY_CASES, "delay_bucket", "users", "delays"), FIRSTS, DELAYS
        ),
        "event_indicators": _query(
            """SELECT user_id, user_session, v::INTEGER AS viewed, c::INTEGER AS carted,
  p::INTEGER AS purchased, (v AND c)::INTEGER AS reached_cart,
  (v AND c AND p)::INTEGER AS reached_purchase, (c AND NOT p)::INTEGER AS abandoned FROM units""",
            _flags("units", "user_id, user_session"),
        ),
        "top_category": _query(
            f"""SELECT {TOP} AS top_category, coalesce(category_code, '(unknown)') AS category_code,
  coalesce(brand, '(no brand)') AS brand, count(*) AS events
FROM shop GROUP BY {TOP}, coalesce(shop.category_code, '(unknown)'), coalesce(shop.brand, '(no brand)')"""
        ),
        "segment_label": _query(
            "SELECT position AS price_quartile, segment FROM segments", *SPLIT_SEGMENTS["price"]
        ),
        "price_ntile": _query("SELECT price, event_id, price_quartile FROM tiled", TILED),
        "price_ntile_scalable": _query("SELECT price, event_id, price_quartile FROM tiled", TILED),
        "event_gaps": _query(
            """SELECT user_id, event_ts, gap_sec, count(*) AS gaps FROM gaps
WHERE gap_sec IS NOT NULL GROUP BY ALL""",
            GAPS,
        ),
        "first_times": _query("SELECT * FROM firsts", FIRSTS),
        "same_session_converters": _query("SELECT user_id FROM met", MET),
        "duplicate_groups": _query("SELECT * FROM copies WHERE cnt > 1", COPIES),
        "missing_value_audit": _query(
            f"""SELECT count(*) AS events, count(*) FILTER ({NO_CATEGORY}) AS missing_category,
  count(*) FILTER ({NO_BRAND}) AS missing_brand, count(*) FILTER ({NO_PRICE}) AS missing_price,
  {_share(NO_CATEGORY)} AS missing_category_pct, {_share(NO_BRAND)} AS missing_brand_pct,
  {_share(NO_PRICE)} AS missing_price_pct FROM shop"""
        ),
        "tracking_gaps": _query(
            f"""SELECT 'per user' AS grain, {_without_view("user_id")} AS units
UNION ALL SELECT 'per session', {_without_view("user_session")}"""
        ),
        "funnel_steps_user": _funnel_steps("user_id"),
        "funnel_steps_session": _funnel_steps("user_session"),
        "abandonment_rates": _query(
            f"""SELECT grain, carters, abandoned, {_rounded("abandoned::DOUBLE / nullif(carters, 0)")} AS rate,
  {_rounded(_wilson("abandoned", "carters", "-"))} AS ci_low,
  {_rounded(_wilson("abandoned", "carters", "+"))} AS ci_high FROM ({ABANDONMENT})""",
            *GRAINS,
        ),
        "significant_segments": _significant(),
    }
    for name in (
        "funnel_user", "funnel_session", "events_per_session", "session_duration",
        "time_to_convert", "time_to_convert_distribution", "abandonment_overall",
    ):
        found[f"rollup_{name}"] = found[name]
    for split in SPLIT_SEGMENTS:
        found[f"segment_rate_series_{split}"] = _rate_series(split)
        for key in STEP_TRIALS:
            found[f"chi2_{split}_{key}"] = _homogeneity(split, key)
            found[f"segment_tests_{split}_{key}"] = _segment_tests(split, key)
    return found
