"""The SQL statement of each query that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from registry.oracles import (
    CATEGORICAL,
    COHORTS,
    CURVE,
    DAY_ORDERS,
    DAY_SESSIONS,
    DOUBLED,
    FEATURES,
    FUNNEL,
    IMPUTED,
    KEYED,
    KEYS,
    KPI_SESSIONS,
    LOOSE,
    NUMERIC,
    ORDERS,
    PAIR,
    PLAIN,
    PLAIN_RATES,
    SCALED,
    SCORED,
    SESSIONS,
    SPLIT,
    STARTED,
    STEPS,
    STRICT,
    SUMMARY,
    TEXT,
    UNUSABLE,
    USER,
    USER_ORDERS,
    WINDOW,
    WINDOW_ORDERS,
    WINDOW_USER_ORDERS,
    buyers_cte,
    customer,
    feature_rows,
    has,
    mean_money,
    money,
    pct,
    phase,
    plain,
    three_periods,
    two_periods,
    value_cte,
    weighted,
)

MONTH = "d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"


def shaping() -> dict[str, str]:
    columns = f"""event_id, us AS event_timestamp, strftime(d, '%Y%m%d') AS event_date,
      nm AS event_name, {KEYS}, dev AS device_category, src AS first_source,
      med AS first_medium, txn AS transaction_id, rev AS purchase_revenue,
      qty AS total_item_quantity, cat AS item_category"""
    ev = plain()
    return {
        "src_events": f"{ev} SELECT {columns} FROM ev",
        "shape_event_param": f"""{ev} SELECT event_id, us AS event_timestamp, nm AS event_name,
            sid AS ga_session_id FROM ev""",
        "shape_struct_fields": f"""{ev} SELECT event_id, nm AS event_name,
            dev AS device_category, src AS first_source, med AS first_medium,
            txn AS transaction_id, rev AS purchase_revenue, qty AS total_item_quantity FROM ev""",
        "shape_items_explode": f"""{ev} SELECT event_id, nm AS event_name,
            unnest(cats) AS item_category FROM ev""",
        "shape_item_category_any": f"""{ev} SELECT event_id, nm AS event_name,
            cat AS item_category FROM ev""",
        "src_event_days": f"""{ev} SELECT strftime(d, '%Y%m%d') AS event_date,
            count(*) AS events, count(DISTINCT event_id) AS distinct_events FROM ev GROUP BY 1""",
        "shape_event_date": f"""{ev} SELECT event_id, nm AS event_name,
            strftime(d, '%Y%m%d') AS event_date, d AS event_day FROM ev""",
        "shape_event_time": f"""{ev} SELECT event_id, nm AS event_name,
            make_timestamp(us) AS event_time FROM ev""",
        "filter_funnel_events": f"""{ev} SELECT event_id, nm AS event_name, {USER}
            FROM ev WHERE nm IN ({FUNNEL})""",
        "filter_valid_keys": f"""{ev} SELECT event_id, nm AS event_name, {KEYS}
            FROM ev WHERE {KEYED}""",
        "filter_valid_transaction": f"""{ev} SELECT event_id, txn AS transaction_id,
            {STRICT} AS valid_strict, {LOOSE} AS valid_nonblank FROM ev WHERE nm = 'purchase'""",
        "filter_placeholder_transaction": f"""{ev} SELECT event_id, txn AS transaction_id
            FROM ev WHERE nm = 'purchase' AND {UNUSABLE}""",
        "filter_date_window": f"""{ev} SELECT event_id, nm AS event_name, d AS event_day
            FROM ev WHERE {MONTH}""",
        "session_key": f"""{ev} SELECT event_id, nm AS event_name,
            uid || '-' || cast(sid AS VARCHAR) AS session_key FROM ev""",
    }


def session_rows() -> dict[str, str]:
    ss, tm = plain(SESSIONS), plain(STEPS)
    in_funnel = f"FROM ev WHERE {KEYED} AND nm IN ({FUNNEL}) GROUP BY uid, sid"
    start_day = "min(d) FILTER (nm = 'session_start')"
    core = "t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL AND t5 IS NOT NULL AND t6 IS NOT NULL"
    return {
        "session_flags": f"""{plain()} SELECT {KEYS}, {has('session_start')} AS started_session,
            {has('first_visit')} AS first_visit_session, {has('view_item')} AS viewed_item,
            {has('add_to_cart')} AS added_to_cart, {has('begin_checkout')} AS began_checkout,
            {has('add_shipping_info')} AS added_shipping_info,
            {has('add_payment_info')} AS added_payment_info, {has('purchase')} AS purchased
            FROM ev WHERE {KEYED} AND nm IN ({FUNNEL}, 'first_visit') GROUP BY uid, sid""",
        "session_step_times": f"""{tm} SELECT {KEYS}, t0 AS session_start_ts, t1 AS view_item_ts,
            t2 AS add_to_cart_ts, t3 AS begin_checkout_ts, t4 AS shipping_ts, t5 AS payment_ts,
            t6 AS purchase_ts FROM tm""",
        "session_bounds": f"""{plain()} SELECT {KEYS}, min(us) AS first_event_timestamp,
            max(us) AS last_event_timestamp {in_funnel}""",
        "session_start_date": f"""{plain()} SELECT {KEYS}, {start_day} AS session_date
            {in_funnel}""",
        "session_first_attr": f"""{plain(SESSIONS)} SELECT {KEYS}, dev AS device_category,
            src AS first_source, med AS first_medium, fam AS product_family
            FROM ss WHERE st + vi + ca + ch + pa + pu > 0 OR EXISTS (
              SELECT 1 FROM ev e WHERE e.uid = ss.uid AND e.sid = ss.sid
                AND e.nm = 'add_shipping_info')""",
        "session_daily_flags": f"""{plain(DAY_SESSIONS)} SELECT d AS event_day, {KEYS},
            st AS started_session, vi AS viewed_item, ch AS began_checkout, pu AS purchased
            FROM dy""",
        "funnel_completeness_flags": f"""{tm} SELECT {KEYS}, {core} AS has_all_core_steps,
            coalesce({core} AND t1 <= t2 AND t2 <= t3 AND t3 <= t5 AND t5 <= t6, false)
              AS has_ordered_core_funnel FROM tm""",
        "user_type": f"""{ss} SELECT {KEYS},
            CASE WHEN fv = 1 THEN 'New' ELSE 'Returning' END AS user_type FROM ss""",
        "period_bucket": f"""{plain()}, sd AS (SELECT uid, sid, {start_day} AS day {in_funnel})
            SELECT {KEYS}, day AS session_date, {two_periods('day')} AS compared_period,
              coalesce({three_periods('day')}, 'outside') AS period, {phase('day')} AS phase
            FROM sd""",
        "period_order": f"""{plain()}, sd AS (SELECT uid, sid, {start_day} AS day {in_funnel}),
            ph AS (SELECT {phase('day')} AS phase FROM sd)
            SELECT phase, CASE phase WHEN 'Stable period' THEN 1 WHEN 'Transition day' THEN 2 END
              AS phase_rank, count(*) AS sessions FROM ph GROUP BY phase""",
        "product_family": f"""{plain()} SELECT cat AS item_category, count(*) AS views,
            {PLAIN} AS family, {DOUBLED} AS family_doubled_apostrophe
            FROM ev WHERE nm = 'view_item' GROUP BY cat""",
    }


def order_rows() -> dict[str, str]:
    bought = "FROM ev WHERE nm = 'purchase'"
    buyers = customer(WINDOW_ORDERS, buyers_cte("od", "txn, sid"))
    by_txn = customer(WINDOW_USER_ORDERS, buyers_cte("ud", "txn"))
    windows = ", ".join([by_txn, value_cte("ud", "min_day")])
    second = """SELECT '{rule}' AS first_rule, uid AS user_pseudo_id,
        {rule}_day AS first_purchase_date, next_day AS second_purchase_date,
        cast(next_day - {rule}_day AS INTEGER) AS days_to_second_purchase FROM by_"""
    order_values = """oday AS order_date, ots AS order_timestamp, orev AS order_revenue,
        oqty AS item_quantity"""
    return {
        "purchase_rows": f"""{plain()} SELECT event_id, us AS event_timestamp, d AS event_day,
            {KEYS}, txn AS transaction_id, rev AS purchase_revenue, qty AS total_item_quantity
            {bought}""",
        "transaction_summary": f"""{plain()} SELECT txn AS transaction_id,
            count(*) AS purchase_events, count(DISTINCT uid) AS users,
            count(DISTINCT {PAIR}) AS sessions, count(DISTINCT rev) AS revenue_versions,
            min(rev) AS min_revenue, max(rev) AS max_revenue {bought} AND {LOOSE} GROUP BY txn""",
        "order_consistency": f"""{plain()} SELECT {KEYS}, txn AS transaction_id,
            count(*) AS purchase_events, count(DISTINCT rev) AS revenue_versions,
            count(DISTINCT qty) AS quantity_versions, count(*) - count(rev) AS null_revenue_events,
            count(*) - count(qty) AS null_quantity_events
            {bought} AND {STRICT} GROUP BY uid, sid, txn""",
        "session_transaction_count": f"""{plain()}
            SELECT 'valid' AS kind, {KEYS}, count(DISTINCT txn) AS n,
              cast(NULL AS BIGINT) AS revenue_versions {bought} AND {STRICT} GROUP BY uid, sid
            UNION ALL
            SELECT 'placeholder', uid, sid, count(*), count(DISTINCT rev)
            {bought} AND {UNUSABLE} GROUP BY uid, sid""",
        "clean_orders": f"""{plain(ORDERS, DAY_ORDERS, USER_ORDERS)}
            SELECT 'session' AS grain, {KEYS}, txn AS transaction_id, {order_values} FROM od
            UNION ALL SELECT 'day_session', uid, sid, txn, oday, ots, orev, oqty FROM dd
            UNION ALL SELECT 'user', uid, NULL, txn, oday, ots, orev, oqty FROM ud""",
        "ranked_orders": f"""{buyers} SELECT {KEYS}, txn AS transaction_id, {order_values},
            n AS purchase_number FROM rk""",
        "first_second_purchase": f"""{buyers} {second.format(rule='rank')}
            UNION ALL {second.format(rule='min')}""",
        "orders_within_days": f"""{windows} SELECT {USER}, first_day AS first_purchase_date,
            cast(gap AS INTEGER) AS days_to_second_purchase, n AS orders_in_window,
            rev AS revenue_in_window, qty AS items_in_window FROM cv""",
        "lifecycle_segments": f"""{windows},
            sg AS (SELECT *, CASE WHEN gap BETWEEN 0 AND 7 THEN 'Early Repeat Buyer'
                     WHEN gap BETWEEN 8 AND 14 THEN 'Later Repeat Buyer'
                     ELSE 'One-Time Buyer' END AS segment
                   FROM cv WHERE first_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'),
            ag AS (SELECT segment, count(*) AS n, avg(n) AS an, {mean_money('rev')} AS ar, avg(qty) AS aq,
                     sum(n) AS sn, {money('rev')} AS sr FROM sg GROUP BY segment)
            SELECT segment AS customer_segment, n AS customers,
              {pct('n', 'sum(n) OVER ()')} AS customer_share_pct, round(an, 2) AS avg_orders_14d,
              round(ar, 2) AS avg_revenue_14d, round(aq, 2) AS avg_items_14d,
              round(sr / nullif(sn, 0), 2) AS avg_order_value_14d,
              round(sr, 2) AS total_segment_revenue_14d,
              {pct('sr', 'sum(sr) OVER ()')} AS revenue_share_pct FROM ag""",
        "repeat_purchase_windows": f"""{buyers}, {value_cte('od', 'rank_day')},
            pr AS (SELECT *, CASE WHEN first_day <= DATE '2024-01-07' THEN 'Jan 1-7'
                     ELSE 'Jan 8-15' END AS period
                   FROM cv WHERE first_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'),
            ag AS (SELECT period, count(*) AS n, count(*) FILTER (gap BETWEEN 0 AND 3) AS r3,
                     count(*) FILTER (gap BETWEEN 0 AND 7) AS r7, count(*) FILTER (gap BETWEEN 0 AND 14) AS r14,
                     avg(gap) FILTER (gap BETWEEN 0 AND 14) AS ag, avg(n) AS an, {mean_money('rev')} AS ar
                   FROM pr GROUP BY period)
            SELECT period AS first_purchase_period, n AS first_time_purchasers,
              r3 AS repeat_purchasers_3d, r7 AS repeat_purchasers_7d, r14 AS repeat_purchasers_14d,
              {pct('r3', 'n')} AS repeat_purchase_rate_3d_pct,
              {pct('r7', 'n')} AS repeat_purchase_rate_7d_pct,
              {pct('r14', 'n')} AS repeat_purchase_rate_14d_pct,
              round(ag, 2) AS avg_days_to_second_purchase,
              round(an, 2) AS avg_orders_per_customer_14d,
              round(ar, 2) AS avg_revenue_per_customer_14d FROM ag""",
    }


def cohort_rows() -> dict[str, str]:
    co, sm = customer(COHORTS), customer(SUMMARY)
    floor = "SELECT '{f}' AS floor, uid AS user_pseudo_id, cw AS cohort_week, w AS weeks_since_acquisition FROM {t}"
    grid = f"{co}, gr AS (SELECT *, cast(unnest(range(9)) AS INTEGER) AS w FROM sz, fin)"
    rate = f"""CASE WHEN cw + 7 * w <= last_day THEN {pct(
        '(SELECT count(*) FROM wc WHERE wc.cw = gr.cw AND wc.w = gr.w)', 'size')} END"""
    return {
        "user_day_activity": f"""{co} SELECT {USER}, d AS activity_date,
            cast(fv AS INTEGER) AS had_first_visit, cast(ss AS INTEGER) AS had_session FROM ua""",
        "first_visit_date": f"{co} SELECT {USER}, first_day AS first_visit_date FROM fd",
        "cohort_week": f"""{co} SELECT {USER}, first_day AS first_visit_date, cw AS cohort_week
            FROM cu WHERE cw > DATE '2023-12-25'""",
        "cohort_sizes": f"{co} SELECT cw AS cohort_week, size AS cohort_size FROM sz",
        "weeks_since": f"""{co} {floor.format(f='visit', t='wk')}
            UNION ALL {floor.format(f='cohort', t='wc')}""",
        "retained_users": f"""{co} SELECT cw AS cohort_week, w AS weeks_since_acquisition,
            count(*) AS retained_users FROM wk WHERE w IN (1, 2, 4) GROUP BY cw, w""",
        "dataset_end": f"{co} SELECT last_day AS max_activity_date FROM fin",
        "cohort_rates": f"""{sm} SELECT cw AS cohort_week, strftime(cw, '%Y-%m') AS cohort_month,
            size AS cohort_size, round(nullif(n1, 0) / size, 6) AS week_1_rate,
            round(nullif(n2, 0) / size, 6) AS week_2_rate,
            round(nullif(n4, 0) / size, 6) AS week_4_rate FROM cr""",
        "weighted_rate": f"""{sm} SELECT {weighted(1)} AS week_1_pct, {weighted(2)} AS week_2_pct,
            {weighted(4)} AS week_4_pct FROM cr""",
        "cohort_grid": f"""{grid} SELECT cw AS cohort_week, size AS cohort_size,
            last_day AS max_activity_date, w AS week_number, cw + 7 * w AS retention_week_start
            FROM gr""",
        "observable_mask": f"""{grid} SELECT cw AS cohort_week, w AS week_number,
            {rate} AS retention_rate_pct FROM gr""",
        "week_eligibility": f"""{co} SELECT cw AS cohort_week, size AS cohort_size,
            last_day AS max_activity_date, cw + 7 <= last_day AS eligible_week_1,
            cw + 14 <= last_day AS eligible_week_2, cw + 28 <= last_day AS eligible_week_4
            FROM sz, fin""",
        "retention_long": f"""{co},
            rt AS (SELECT cw, w, count(*) AS n FROM wk WHERE w <= 8 GROUP BY cw, w)
            SELECT cw AS cohort_week, size AS cohort_size, w AS weeks_since_acquisition,
              n AS retained_users, {pct('n', 'size')} AS retention_rate_pct
            FROM rt JOIN sz USING (cw)""",
        "retention_matrix": f"""{grid}, rr AS (SELECT cw, size, w, {rate} AS r FROM gr)
            SELECT cw AS cohort_week, size AS cohort_size,
              {', '.join(f'max(r) FILTER (w = {i}) AS week_{i}' for i in range(9))}
            FROM rr WHERE cw > DATE '2023-12-25' GROUP BY cw, size""",
        "retention_monthly_weighted": f"""{sm} SELECT strftime(cw, '%Y-%m') AS cohort_month,
            cast(sum(size) AS BIGINT) AS acquired_users,
            count(*) FILTER (cw + 7 <= last_day) AS cohorts_observed_for_week_1,
            {weighted(1)} AS weighted_week_1_retention_pct,
            {weighted(2)} AS weighted_week_2_retention_pct,
            {weighted(4)} AS weighted_week_4_retention_pct FROM cr
            WHERE cw > DATE '2023-12-25' GROUP BY cohort_month""",
    }


def share_rows() -> dict[str, str]:
    rates = f"""{plain(SESSIONS)},
        dp AS (SELECT {two_periods('day')} AS p, dev, count(*) AS n, avg(pu) AS r
               FROM ss WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'
                 AND st + vi + ch + pu > 0 GROUP BY ALL),
        sh AS (SELECT *, n / sum(n) OVER (PARTITION BY p) AS share FROM dp)"""
    counted = f"""{plain()}, fm AS (
        SELECT {PLAIN} AS family, count(*) AS views FROM ev WHERE nm = 'view_item' GROUP BY 1)"""
    return {
        "safe_pct": f"""{plain()} SELECT {USER}, d AS event_day, count(*) FILTER (nm = 'purchase') AS bought,
            count(*) FILTER (nm = 'view_item') AS viewed,
            {pct("count(*) FILTER (nm = 'purchase')", "count(*) FILTER (nm = 'view_item')")} AS bought_per_view_pct
            FROM ev GROUP BY uid, d""",
        "share_of_total": f"""{plain()}, c AS (
            SELECT nm, dev, count(*) AS n FROM ev GROUP BY nm, dev)
            SELECT nm AS event_name, dev AS device_category, n,
              {pct('n', 'sum(n) OVER (PARTITION BY nm)')} AS share_pct FROM c""",
        "share_of_grand_total": f"""{plain()}, c AS (
            SELECT nm, count(*) AS n FROM ev GROUP BY nm)
            SELECT nm AS event_name, n, {pct('n', 'sum(n) OVER ()')} AS share_pct FROM c""",
        "mix_rate_decomposition": f"""{rates}
            SELECT round(100 * sum(a.share * a.r), 3) AS before,
              round(100 * sum(b.share * b.r), 3) AS after,
              round(100 * sum(a.share * b.r), 3) AS after_with_mix_before,
              round(100 * sum(b.share * a.r), 3) AS after_with_rate_before
            FROM sh a JOIN sh b ON a.dev = b.dev AND a.p = 'P1' AND b.p = 'P2'""",
        "scope_union": f"""{counted} SELECT 'All product families' AS scope, family, views FROM fm
            UNION ALL SELECT 'Known categories only', family, views
            FROM fm WHERE family <> '(not set)'""",
    }


def audit_reports() -> dict[str, str]:
    bought = "FROM ev WHERE nm = 'purchase'"
    usable = f"count(*) FILTER ({STRICT})"
    coverage = f"""count(*) AS purchase_events, {usable} AS valid_transaction_events,
        count(*) FILTER ({UNUSABLE}) AS placeholder_events,
        {pct(usable, 'count(*)')} AS valid_transaction_pct"""
    core = "t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL AND t5 IS NOT NULL"
    ordered = f"{core} AND t1 <= t2 AND t2 <= t3 AND t3 <= t5 AND t5 <= t6"
    return {
        "dq_event_inventory": f"""{plain()} SELECT nm AS event_name, count(*) AS event_count,
            count(DISTINCT uid) AS users FROM ev GROUP BY nm""",
        "dq_session_id_coverage": f"""{plain()} SELECT nm AS event_name, count(*) AS event_count,
            count(*) - count(sid) AS missing_session_id, count(DISTINCT {PAIR}) AS sessions
            FROM ev WHERE nm IN ({FUNNEL}) GROUP BY nm""",
        "dq_sessions_by_event": f"""{plain()} SELECT nm AS event_name,
            count(DISTINCT {PAIR}) AS sessions FROM ev WHERE nm IN ({FUNNEL}) GROUP BY nm""",
        "dq_funnel_event_inventory": f"""{plain()} SELECT nm AS event_name,
            count(*) AS event_count, count(DISTINCT uid) AS users
            FROM ev WHERE nm IN ({FUNNEL}) GROUP BY nm""",
        "dq_purchase_transactions": f"""{plain()} SELECT count(*) AS purchase_events,
            count(*) FILTER (coalesce(txn, '') = '') AS missing_transaction_id,
            count(DISTINCT txn) AS unique_transaction_ids,
            count(DISTINCT {PAIR}) AS purchase_sessions,
            round({money('rev')}, 2) AS summed_purchase_revenue {bought}""",
        "dq_transaction_integrity": f"""{plain()}, pu AS (SELECT * {bought}),
            ids AS (SELECT txn, count(*) AS n, count(DISTINCT uid) AS u,
                      count(DISTINCT {PAIR}) AS s, count(DISTINCT rev) AS r
                    FROM pu WHERE {LOOSE} GROUP BY txn)
            SELECT (SELECT count(*) FILTER (txn IS NULL) FROM pu) AS null_transaction_ids,
              (SELECT count(*) FILTER (txn = '') FROM pu) AS blank_transaction_ids,
              count(*) AS valid_unique_transactions,
              count(*) FILTER (n > 1) AS duplicated_transaction_ids,
              cast(sum(n) AS BIGINT) AS purchase_events_with_valid_id,
              max(n) AS max_events_per_transaction,
              count(*) FILTER (u > 1) AS transaction_ids_multiple_users,
              count(*) FILTER (s > 1) AS transaction_ids_multiple_sessions,
              count(*) FILTER (r > 1) AS transaction_ids_revenue_mismatch FROM ids""",
        "dq_repeated_transactions": f"""{plain()} SELECT txn AS transaction_id,
            count(*) AS purchase_events, count(DISTINCT uid) AS users,
            count(DISTINCT {PAIR}) AS sessions, count(DISTINCT rev) AS revenue_versions,
            min(rev) AS min_revenue, max(rev) AS max_revenue
            {bought} AND {LOOSE} GROUP BY txn HAVING count(*) > 1
            ORDER BY purchase_events DESC, transaction_id LIMIT 30""",
        "dq_composite_order_grain": f"""{plain()},
            co AS (SELECT uid, sid, txn, count(*) AS n, count(DISTINCT rev) AS r
                   {bought} AND {STRICT} GROUP BY uid, sid, txn),
            so AS (SELECT uid, sid, count(*) AS n FROM co GROUP BY uid, sid),
            ph AS (SELECT uid, sid, count(*) AS n, count(DISTINCT rev) AS r
                   {bought} AND {UNUSABLE} GROUP BY uid, sid)
            SELECT (SELECT count(*) FROM co) AS composite_orders,
              (SELECT count(*) FILTER (n > 1) FROM co) AS repeated_composite_orders,
              (SELECT count(*) FILTER (r > 1) FROM co) AS composite_revenue_mismatches,
              (SELECT max(n) FROM co) AS max_events_per_composite_order,
              (SELECT count(*) FILTER (n > 1) FROM so) AS sessions_with_multiple_transaction_ids,
              (SELECT count(*) FROM ph) AS placeholder_purchase_sessions,
              (SELECT count(*) FILTER (n > 1) FROM ph) AS repeated_placeholder_sessions,
              (SELECT count(*) FILTER (r > 1) FROM ph) AS placeholder_sessions_multiple_revenues""",
        "dq_placeholder_patterns": f"""{plain()}, ph AS (
              SELECT *, count(*) OVER (PARTITION BY uid, sid) AS n
              {bought} AND {UNUSABLE} AND {KEYED})
            SELECT {KEYS}, make_timestamp(us) AS purchase_time, rev AS purchase_revenue,
              qty AS total_item_quantity FROM ph WHERE n > 1""",
        "dq_funnel_completeness": f"""{plain(STEPS)} SELECT count(*) AS purchase_sessions,
            count(*) - count(t1) AS missing_view_item, count(*) - count(t2) AS missing_add_to_cart,
            count(*) - count(t3) AS missing_checkout, count(*) - count(t4) AS missing_shipping,
            count(*) - count(t5) AS missing_payment, count(*) FILTER ({core}) AS complete_core_funnel,
            count(*) FILTER ({ordered}) AS complete_ordered_funnel,
            {pct(f'count(*) FILTER ({core})', 'count(*)')} AS complete_core_pct,
            {pct(f'count(*) FILTER ({ordered})', 'count(*)')} AS ordered_core_pct
            FROM tm WHERE t6 IS NOT NULL""",
        "dq_purchase_paths": f"""{plain(STEPS)} SELECT uid || '-' || sid AS session_key,
            make_timestamp(t0) AS session_start_time, make_timestamp(t1) AS view_item_time,
            make_timestamp(t2) AS add_to_cart_time, make_timestamp(t3) AS checkout_time,
            make_timestamp(t4) AS shipping_time, make_timestamp(t5) AS payment_time,
            make_timestamp(t6) AS purchase_time
            FROM tm WHERE t6 IS NOT NULL ORDER BY uid, sid LIMIT 100""",
        "dq_daily_coverage": f"""{plain()} SELECT d AS event_date, count(*) AS purchase_events,
            count(DISTINCT {PAIR}) AS purchase_sessions,
            {usable} AS events_with_valid_transaction_id,
            count(*) FILTER ({UNUSABLE}) AS events_with_placeholder_transaction_id,
            count(DISTINCT CASE WHEN {STRICT} THEN uid || '|' || sid || '|' || txn END)
              AS clean_orders,
            {pct(usable, 'count(*)')} AS valid_transaction_event_pct
            {bought} AND {KEYED} GROUP BY d""",
        "dq_period_coverage": f"""{plain()} SELECT {phase('d')} AS period, {coverage}
            {bought} AND {KEYED} GROUP BY 1""",
        "dq_month_daily_coverage": f"""{plain()} SELECT d AS event_date, {coverage}
            {bought} AND {MONTH} GROUP BY d""",
        "dq_clean_order_quality": f"""{plain()}, oc AS (
              SELECT count(DISTINCT rev) AS r, count(DISTINCT qty) AS q,
                count(*) - count(rev) AS nr, count(*) - count(qty) AS nq
              {bought} AND {KEYED} AND {STRICT} GROUP BY uid, sid, txn)
            SELECT count(*) AS orders, count(*) FILTER (r > 1) AS revenue_mismatch_orders,
              count(*) FILTER (q > 1) AS quantity_mismatch_orders,
              count(*) FILTER (nr > 0) AS orders_with_null_revenue,
              count(*) FILTER (nq > 0) AS orders_with_null_quantity FROM oc""",
    }


def kpi_reports() -> dict[str, str]:
    ks = plain(KPI_SESSIONS)
    bought = "FROM ev WHERE nm = 'purchase'"
    totals = f"""round({money('orev')}, 2) AS {{revenue}},
        round({mean_money('orev')}, 2) AS average_order_value,
        cast(sum(oqty) AS BIGINT) AS items_sold"""
    day_rates = f"""{pct('purchase_sessions', 'sessions')} AS session_conversion_pct,
        {pct('product_view_sessions', 'sessions')} AS product_view_rate_pct,
        {pct('purchase_sessions', 'checkout_sessions')} AS checkout_to_purchase_pct"""
    four = "sessions, product_view_sessions, checkout_sessions, purchase_sessions"
    return {
        "kpi_initial_funnel": f"""{ks} SELECT count(*) AS total_sessions,
            count(*) FILTER (vi = 1) AS product_view_sessions, count(*) FILTER (ca = 1) AS cart_sessions,
            count(*) FILTER (ch = 1) AS checkout_sessions, count(*) FILTER (pa = 1) AS payment_sessions,
            count(*) FILTER (pu = 1) AS purchase_sessions,
            {pct('count(*) FILTER (vi = 1)', 'count(*)')} AS session_to_view_pct,
            {pct('count(*) FILTER (ch = 1)', 'count(*) FILTER (vi = 1)')} AS view_to_checkout_pct,
            {pct('count(*) FILTER (pu = 1)', 'count(*) FILTER (ch = 1)')} AS checkout_to_purchase_pct,
            {pct('count(*) FILTER (pu = 1)', 'count(*)')} AS overall_session_conversion_pct FROM ks""",
        "kpi_session_base": f"""{plain()} SELECT {KEYS}, uid || '-' || sid AS session_key,
            min(us) AS first_event_timestamp, max(us) AS last_event_timestamp,
            {has('view_item')} AS viewed_item, {has('add_to_cart')} AS added_to_cart,
            {has('begin_checkout')} AS began_checkout,
            {has('add_shipping_info')} AS added_shipping_info,
            {has('add_payment_info')} AS added_payment_info, {has('purchase')} AS purchased
            FROM ev WHERE {KEYED} AND nm IN ({FUNNEL}) GROUP BY uid, sid
            ORDER BY uid, sid LIMIT 100""",
        "kpi_validated_funnel": f"""{ks}, n AS (SELECT count(*) AS k, count(*) FILTER (st = 1) AS s,
              count(*) FILTER (st = 1 AND vi = 1) AS v, count(*) FILTER (st = 1 AND ch = 1) AS c,
              count(*) FILTER (st = 1 AND vi = 1 AND ch = 1) AS vc,
              count(*) FILTER (st = 1 AND ch = 1 AND pu = 1) AS cp,
              count(*) FILTER (st = 1 AND pu = 1) AS p FROM ks)
            SELECT k AS all_session_keys, s AS valid_started_sessions,
              k - s AS session_keys_without_start, v AS view_sessions,
              vc AS view_to_checkout_sessions, cp AS checkout_to_purchase_sessions,
              p AS purchase_sessions, {pct('v', 's')} AS session_to_view_pct,
              {pct('vc', 'v')} AS view_to_checkout_pct, {pct('cp', 'c')} AS checkout_to_purchase_pct,
              {pct('p', 's')} AS overall_session_conversion_pct FROM n""",
        "kpi_clean_orders": f"""{plain(ORDERS)} SELECT count(*) AS orders,
            count(DISTINCT uid) AS purchasers,
            count(DISTINCT uid || '|' || sid) AS purchasing_sessions,
            {totals.format(revenue='revenue')}, round(avg(oqty), 2) AS average_items_per_order,
            round({money('orev')} / nullif(count(DISTINCT uid), 0), 2) AS revenue_per_purchaser
            FROM od""",
        "kpi_daily_funnel_orders": f"""{plain(DAY_SESSIONS, DAY_ORDERS)},
            f AS (SELECT d, {STARTED} FROM dy GROUP BY d),
            o AS (SELECT d, count(*) AS n, {totals.format(revenue='revenue')} FROM dd GROUP BY d)
            SELECT d AS event_date, {four}, coalesce(n, 0) AS clean_orders,
              coalesce(revenue, 0) AS clean_revenue, average_order_value,
              coalesce(o.items_sold, 0) AS items_sold, {day_rates} FROM f LEFT JOIN o USING (d)""",
        "kpi_daily_orders": f"""{plain(ORDERS)} SELECT cast(make_timestamp(ots) AS DATE) AS order_date,
            count(*) AS orders, count(DISTINCT uid) AS purchasers,
            {totals.format(revenue='revenue')}, round(avg(oqty), 2) AS average_items_per_order
            FROM od GROUP BY 1""",
        "kpi_monthly_orders": f"""{plain(DAY_ORDERS)},
            q AS (SELECT cast(date_trunc('month', d) AS DATE) AS m, count(*) FILTER ({STRICT}) AS v,
                    count(*) AS n {bought} AND d >= DATE '2024-01-03' GROUP BY 1),
            o AS (SELECT cast(date_trunc('month', d) AS DATE) AS m, count(DISTINCT d) AS days,
                    count(*) AS orders, count(DISTINCT uid) AS purchasers,
                    {totals.format(revenue='revenue')}
                  FROM dd WHERE d >= DATE '2024-01-03' GROUP BY 1)
            SELECT m AS month, days AS observed_days, orders, purchasers, revenue,
              average_order_value, items_sold, round(revenue / days, 2) AS avg_daily_revenue,
              round(orders / days, 2) AS avg_daily_orders, {pct('v', 'n')} AS valid_transaction_pct
            FROM o JOIN q USING (m)""",
        "kpi_period_summary": f"""{plain(DAY_SESSIONS, DAY_ORDERS)},
            s AS (SELECT {three_periods('d')} AS period, count(DISTINCT d) AS days, {STARTED}
                  FROM dy WHERE {WINDOW} GROUP BY 1),
            o AS (SELECT {three_periods('d')} AS period, count(*) AS clean_orders,
                    count(DISTINCT uid) AS purchasers, {totals.format(revenue='clean_revenue')}
                  FROM dd WHERE {WINDOW} GROUP BY 1)
            SELECT period, days, {four}, clean_orders, purchasers, clean_revenue,
              average_order_value, items_sold, round(sessions / days, 2) AS avg_daily_sessions,
              round(clean_orders / days, 2) AS avg_daily_orders,
              round(clean_revenue / days, 2) AS avg_daily_revenue, {day_rates}
            FROM s LEFT JOIN o USING (period)""",
    }


def segment_reports() -> dict[str, str]:
    inside = "day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"
    share = f"{pct('sessions', 'sum(sessions) OVER (PARTITION BY period)')} AS session_share_pct"
    three = "product_view_sessions, checkout_sessions, purchase_sessions"
    channel = "coalesce(src, '(unknown)') AS first_source, coalesce(med, '(unknown)') AS first_medium"
    kind = "CASE WHEN fv = 1 THEN 'New' ELSE 'Returning' END AS user_type"
    ss = plain(SESSIONS)

    def decomposed(rows: str, segment: str, names: tuple[str, str, str, str]) -> str:
        """``rows`` has scope, p, segment, n (weight) and r (rate)."""
        pairs = (("a", "a"), ("b", "b"), ("a", "b"), ("b", "a"))
        sums = ", ".join(
            f"round(100 * sum({s}.share * {r}.r), 3) AS {name}"
            for name, (s, r) in zip(names, pairs)
        )
        return f"""{ss}, rows_ AS ({rows}),
            sh AS (SELECT *, n / sum(n) OVER (PARTITION BY scope, p) AS share FROM rows_)
            SELECT {{scope}} {sums} FROM sh a JOIN sh b
              ON a.scope = b.scope AND a.{segment} = b.{segment} AND a.p = 'P1' AND b.p = 'P2'"""

    family_rows = f"""
        SELECT {{scope}} AS scope, {two_periods('day')} AS p, fam, count(*) AS n, avg(ch) AS r
        FROM ss WHERE st = 1 AND vi = 1 AND {two_periods('day')} IS NOT NULL {{known}}
        GROUP BY ALL"""
    both_scopes = (
        family_rows.format(scope="'All product families'", known="")
        + " UNION ALL "
        + family_rows.format(scope="'Known categories only'", known="AND fam <> '(not set)'")
    )
    type_rows = f"""
        SELECT 'all' AS scope, {two_periods('day')} AS p, {kind}, count(*) FILTER (st = 1) AS n,
          avg(pu) FILTER (st = 1) AS r
        FROM ss WHERE {two_periods('day')} IS NOT NULL GROUP BY ALL"""
    return {
        "funnel_device": f"""{ss}, g AS (
              SELECT {three_periods('day')} AS period, coalesce(dev, 'unknown') AS device_category,
                {STARTED}, count(*) FILTER (st + vi + ch = 3) AS vc, count(*) FILTER (st + ch + pu = 3) AS cp
              FROM ss WHERE {inside} GROUP BY 1, 2)
            SELECT period, device_category, sessions, {three},
              {pct('product_view_sessions', 'sessions')} AS product_view_rate_pct,
              {pct('vc', 'product_view_sessions')} AS view_to_checkout_pct,
              {pct('cp', 'checkout_sessions')} AS checkout_to_purchase_pct,
              {pct('purchase_sessions', 'sessions')} AS session_conversion_pct FROM g""",
        "channel_funnel": f"""{ss}, g AS (
              SELECT {three_periods('day')} AS period, {channel}, {STARTED}
              FROM ss WHERE {inside} GROUP BY 1, 2, 3)
            SELECT * FROM (SELECT period, first_source, first_medium, sessions, {share}, {three},
              {PLAIN_RATES} FROM g) WHERE sessions >= 10""",
        "channel_mix": f"""{plain()}, g AS (
              SELECT {three_periods('d')} AS period, {channel}, count(*) AS sessions,
                count(DISTINCT uid) AS users
              FROM ev WHERE nm = 'session_start' AND {inside.replace('day', 'd')} GROUP BY 1, 2, 3)
            SELECT *, {share} FROM g""",
        "customer_new_returning_funnel": f"""{ss}, g AS (
              SELECT {three_periods('day')} AS period, {kind}, {STARTED}
              FROM ss WHERE {inside} GROUP BY 1, 2)
            SELECT period, user_type, sessions, {share}, {three}, {PLAIN_RATES} FROM g""",
        "customer_conversion_decomposition": decomposed(
            type_rows,
            "user_type",
            (
                "actual_p1_conversion_pct",
                "actual_p2_conversion_pct",
                "p2_conversion_with_p1_mix_pct",
                "p2_conversion_with_p1_behavior_pct",
            ),
        ).format(scope=""),
        "product_category_inventory": f"""{plain()} SELECT
            coalesce(nullif(cat, ''), '(not set)') AS item_category,
            count(*) AS item_event_records, count(DISTINCT uid) AS users,
            count(DISTINCT {PAIR}) AS sessions
            FROM (SELECT uid, sid, unnest(cats) AS cat FROM ev) GROUP BY 1""",
        "product_mix_decomposition": decomposed(
            both_scopes,
            "fam",
            (
                "actual_p1_view_to_checkout_pct",
                "actual_p2_view_to_checkout_pct",
                "p2_rate_with_p1_product_mix_pct",
                "p2_rate_with_p1_family_behavior_pct",
            ),
        ).format(scope="a.scope,")
        + " GROUP BY a.scope",
        "product_family_funnel": f"""{ss}, g AS (
              SELECT {three_periods('day')} AS period, fam2 AS product_family,
                count(*) AS product_view_sessions, count(*) FILTER (ch = 1) AS checkout_sessions,
                count(*) FILTER (pu = 1) AS purchase_sessions
              FROM ss WHERE st = 1 AND vi = 1 AND {inside} GROUP BY 1, 2),
            w AS (SELECT *, sum(product_view_sessions) OVER (PARTITION BY period) AS tot FROM g)
            SELECT period, product_family, product_view_sessions,
              {pct('product_view_sessions', 'tot')} AS product_view_share_pct, checkout_sessions,
              purchase_sessions,
              {pct('checkout_sessions', 'product_view_sessions')} AS view_to_checkout_pct,
              {pct('purchase_sessions', 'checkout_sessions')} AS checkout_to_purchase_pct,
              {pct('purchase_sessions', 'product_view_sessions')} AS product_view_to_purchase_pct
            FROM w WHERE product_view_sessions >= 10""",
    }


def feature_reports() -> dict[str, str]:
    ft = customer(FEATURES)
    label = "repeat_purchase_14d"
    columns = (
        "user_pseudo_id",
        "first_order_date",
        *CATEGORICAL,
        *NUMERIC,
        label,
    )
    counted = ", ".join(f"count({c}) AS n{i}" for i, c in enumerate(columns))
    types = {
        "user_pseudo_id": "string",
        "first_order_date": "date",
        "purchase_day_of_week": "int",
        "purchase_hour_utc": "int",
        "device_category": "string",
        "first_source": "string",
        "first_medium": "string",
        "first_order_revenue": "double",
        label: "int",
    }
    profile = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{types.get(c, 'bigint')}' AS data_type, n{i} AS non_null, "
        f"n AS row_count, {len(columns)} AS column_count FROM c"
        for i, c in enumerate(columns)
    )
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, n - n{i} AS missing_count, "
        f"{pct(f'n - n{i}', 'n')} AS missing_percent FROM c WHERE n > n{i}"
        for i, c in enumerate(columns)
    )
    totals = f"{ft}, c AS (SELECT count(*) AS n, {counted} FROM ft)"
    gone = {
        "null_revenue": "first_order_revenue",
        "null_items": "first_order_items",
        "null_device": "device_category",
        "null_source": "first_source",
        "null_medium": "first_medium",
        "null_sessions": "sessions_before_first_purchase",
        "null_days_to_purchase": "days_first_visit_to_purchase",
    }
    rate = f"round(avg({label}) * 100, 2) AS repeat_purchase_rate"
    days = "days_first_visit_to_purchase"
    im, sc = customer(IMPUTED), customer(IMPUTED, SCALED)
    hot = "'cat__' || vc.f || '_' || vc.v AS feature"
    return {
        "src_feature_table": feature_rows(),
        "src_feature_csv": feature_rows(),
        "ml_feature_table": feature_rows(),
        "src_profile": f"{totals} {profile}",
        "sink_feature_table": f"""{ft} SELECT *, 'parquet' AS stored_as FROM ft
            UNION ALL SELECT *, 'csv' FROM ft""",
        "repeat_label": f"""{ft} SELECT {USER}, f.ots AS first_order_timestamp,
            l.again AS repeat_purchase FROM fo f JOIN lb l USING (uid)""",
        "point_in_time_features": f"""{ft} SELECT {USER}, ns AS sessions_before_first_purchase,
            nv AS product_views_before_purchase, na AS add_to_cart_before_purchase,
            nc AS checkout_events_before_purchase, nq AS search_events_before_purchase,
            fvt AS first_visit_timestamp FROM pt""",
        "calendar_features": feature_rows(
            "user_pseudo_id, purchase_day_of_week, purchase_hour_utc"
        ),
        "days_since_first_visit": feature_rows(f"user_pseudo_id, {days}"),
        "ml_feature_validation": f"""{ft} SELECT count(*) AS row_count,
            count(DISTINCT user_pseudo_id) AS unique_users,
            count(*) FILTER ({label} = 1) AS repeat_buyers, count(*) FILTER ({label} = 0) AS one_time_buyers,
            {pct(f'count(*) FILTER ({label} = 1)', 'count(*)')} AS positive_class_pct,
            {', '.join(f'count(*) - count({c}) AS {n}' for n, c in gone.items())} FROM ft""",
        "eda_target_distribution": f"""{ft}, c AS (
            SELECT {label}, count(*) AS "count" FROM ft GROUP BY 1)
            SELECT *, {pct('"count"', 'sum("count") OVER ()')} AS percent FROM c""",
        "eda_missing_summary": f"{totals} {missing}",
        "eda_means_by_target": feature_rows(
            f"{label}, " + ", ".join(
                f"round({mean_money(c) if c == 'first_order_revenue' else f'avg({c})'}, 2) AS {c}"
                for c in NUMERIC
                if c != days
            ),
            "GROUP BY 1",
        ),
        "eda_missing_by_target": feature_rows(
            f"{label}, 100 * (count({days}) / count(*)) AS present_pct, "
            f"100 * ((count(*) - count({days})) / count(*)) AS missing_pct",
            "GROUP BY 1",
        ),
        "eda_days_stats_by_target": feature_rows(
            f"{label}, count({days}) AS count, round(avg({days}), 2) AS mean, "
            f"round(median({days}), 2) AS median",
            "GROUP BY 1",
        ),
        "eda_device_summary": feature_rows(
            f"device_category, count(*) AS customers, cast(sum({label}) AS BIGINT) "
            f"AS repeat_buyers, {rate}",
            "WHERE device_category IS NOT NULL GROUP BY 1",
        ),
        "eda_source_summary": feature_rows(
            f"first_source, first_medium, count(*) AS customers, "
            f"cast(sum({label}) AS BIGINT) AS repeat_buyers, {rate}",
            "GROUP BY 1, 2",
        ),
        "ml_select": feature_rows(", ".join((*CATEGORICAL, *NUMERIC, label))),
        "ml_stratified_split": f"""{customer(SPLIT)}
            SELECT user_pseudo_id, {label}, split FROM sp""",
        "ml_split_profile": f"""{customer(SPLIT)}, c AS (
            SELECT split, {label}, count(*) AS rows FROM sp GROUP BY 1, 2)
            SELECT *, round(rows / sum(rows) OVER (PARTITION BY split), 3) AS class_share,
              cast(sum(rows) OVER (PARTITION BY split) AS BIGINT) AS part_rows FROM c""",
        "ml_median_impute": f"""{im} SELECT user_pseudo_id, feature, round(value, 6) AS value
            FROM im""",
        "ml_standardise": f"""{sc} SELECT user_pseudo_id, feature, round(value, 6) AS value
            FROM sc""",
        "ml_mode_impute": f"""{customer(SPLIT, TEXT)}
            SELECT user_pseudo_id, 'text__' || f AS feature, v AS value FROM tf""",
        "ml_one_hot": f"""{customer(SPLIT, TEXT)}
            SELECT user_pseudo_id, {hot} FROM tf JOIN vc USING (f, v)""",
        "ml_assemble": f"""{customer(IMPUTED, SCALED, TEXT)}
            SELECT user_pseudo_id, feature, round(value, 6) AS value FROM sc WHERE round(value, 6) <> 0
            UNION ALL SELECT user_pseudo_id, {hot}, 1.0 FROM tf JOIN vc USING (f, v)""",
        "ml_class_weights": f"""{customer(SPLIT)}, c AS (
            SELECT {label}, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1)
            SELECT {label}, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS class_weight
            FROM c""",
    }


def quality_measures() -> dict[str, str]:
    def row(name: str, hits: str, called: str, support: str) -> str:
        return f"""SELECT '{name}' AS row, coalesce({hits} / nullif({called}, 0), 0) AS p,
            coalesce({hits} / nullif({support}, 0), 0) AS r, {support} AS support, n FROM c"""

    return {
        "ml_pr_curve": f"""{CURVE} SELECT threshold, round(precision, 9) AS precision,
            round(recall, 9) AS recall FROM pts""",
        "ml_threshold_f1": f"""{CURVE}, f AS (
            SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM pts
            ORDER BY f1 DESC NULLS LAST, threshold LIMIT 10)
            SELECT round(threshold, 3) AS threshold, round(precision, 3) AS precision,
              round(recall, 3) AS recall, round(f1, 3) AS f1 FROM f""",
        "ml_average_precision": f"""{SCORED}
            SELECT round(sum((p / np) * (tp / (tp + fp))), 6) AS average_precision FROM cum""",
        "ml_roc_auc": f"""{SCORED}, pairs AS (
            SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS won,
              count(*) AS n FROM sd a, sd b WHERE a.y = 1 AND b.y <> 1)
            SELECT round(won / n, 6) AS roc_auc FROM pairs""",
        "ml_confusion_matrix": f"""{SCORED} SELECT y AS actual,
            count(*) FILTER (guess = 0) AS predicted_0, count(*) FILTER (guess = 1) AS predicted_1
            FROM sd GROUP BY y""",
        "ml_classification_report": f"""{SCORED}, c AS (SELECT count(*) AS n,
              count(*) FILTER (y = 0 AND guess = 0) AS h0, count(*) FILTER (y = 1 AND guess = 1) AS h1,
              count(*) FILTER (guess = 0) AS g0, count(*) FILTER (guess = 1) AS g1, count(*) FILTER (y = 0) AS s0,
              count(*) FILTER (y = 1) AS s1 FROM sd),
            k AS ({row('0', 'h0', 'g0', 's0')} UNION ALL {row('1', 'h1', 'g1', 's1')}),
            kf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM k),
            a AS (
              SELECT row, p, r, f, support FROM kf
              UNION ALL SELECT 'accuracy', (h0 + h1) / n, (h0 + h1) / n, (h0 + h1) / n, n FROM c
              UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), max(n) FROM kf
              UNION ALL SELECT 'weighted avg', sum(p * support) / max(n),
                sum(r * support) / max(n), sum(f * support) / max(n), max(n) FROM kf)
            SELECT row, round(p, 3) AS precision, round(r, 3) AS recall, round(f, 3) AS f1,
              support FROM a""",
    }


def model_checks() -> dict[str, str]:
    """What SQL can say of the fitted models: rows, slots, totals, and measures of a known score."""
    label = "repeat_purchase_14d"
    slots = f"""{customer(IMPUTED, TEXT)}, slots AS (
        SELECT DISTINCT feature FROM im UNION SELECT 'cat__' || f || '_' || v FROM vc)"""
    both = "(VALUES ('logistic'), ('forest')) m(model)"
    parts = {
        "first_order_items": 4,
        "product_views_before_purchase": 2,
        "sessions_before_first_purchase": 1,
    }

    def score(source: Callable[[str], str]) -> str:
        return " + ".join(f"coalesce({source(c)}, 0.0) * {n}" for c, n in parts.items())

    def swapped(column: str) -> str:
        return f"CASE WHEN feature = '{column}' THEN d.{column} ELSE t.{column} END"

    features = ", ".join(f"('{c}')" for c in CATEGORICAL + NUMERIC)
    fixed = f"""{customer(SPLIT)}, te AS (SELECT *, {label} AS y FROM sp WHERE split = 'test'),
        ps AS (
          SELECT user_pseudo_id AS u, r, row_number() OVER (
            PARTITION BY r ORDER BY md5(user_pseudo_id || ':' || r || ':42'), user_pseudo_id) AS p
          FROM te, range(0, 21) g(r)),
        pr AS (SELECT a.u, b.u AS donor, b.r FROM ps a JOIN ps b ON a.p = b.p AND a.r = 0 AND b.r > 0),
        sw AS (
          SELECT feature, r, t.y, {score(swapped)} AS s
          FROM pr JOIN te t ON t.user_pseudo_id = u JOIN te d ON d.user_pseudo_id = donor,
            (VALUES {features}) f(feature)
          UNION ALL SELECT '', 0, y, {score(str)} FROM te),
        ac AS (SELECT feature, r, s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q
               FROM sw GROUP BY ALL),
        cu AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp,
                 sum(p) OVER (PARTITION BY feature, r) AS np, sum(q) OVER (PARTITION BY feature, r) AS nq
               FROM ac WINDOW w AS (PARTITION BY feature, r ORDER BY s DESC)),
        ap AS (SELECT feature, r, sum((tp / (tp + fp)) * (p / np)) AS ap,
                 sum(q * (tp - p + p / 2)) / (max(np) * max(nq)) AS auc FROM cu GROUP BY ALL)"""
    return {
        "sink_eval_tables": f"""{slots} SELECT 'model_comparison' AS table_name, 2 AS row_count
            UNION ALL SELECT 'permutation_importance', 13
            UNION ALL SELECT 'logistic_regression_coefficients', count(*) FROM slots""",
        "ml_predict_rows": f"""{customer(SPLIT)} SELECT model, user_pseudo_id, {label},
            true AS score_in_range, true AS class_follows_score FROM sp, {both} WHERE split = 'test'""",
        "ml_model_support": f"""{customer(SPLIT)} SELECT model, {label} AS actual,
            count(*) AS support, count(*) AS matrix_rows FROM sp, {both}
            WHERE split = 'test' GROUP BY ALL""",
        "ml_predict_agreement": f"""{customer(SPLIT)} SELECT model, user_pseudo_id,
            true AS agrees FROM sp, {both} WHERE split = 'test'""",
        "ml_forest_nodes": """SELECT cast(tree AS INTEGER) AS tree, true AS depth_kept,
            true AS leaves_large, true AS children_add_up FROM range(300) t(tree)""",
        "ml_forest_node_importance": f"{slots} SELECT feature, true AS equal FROM slots",
        "ml_logistic_optimum": f"{slots} SELECT feature, true AS vanishes FROM slots",
        "ml_forest_slots": f"""{slots} SELECT feature, true AS not_negative,
            cast(1 AS DOUBLE) AS total FROM slots""",
        "ml_signed_slots": f"""{slots}, n AS (
            SELECT cast(row_number() OVER () AS INTEGER) AS place FROM slots)
            SELECT direction, place FROM n, (VALUES ('positive'), ('negative')) d(direction)
            WHERE place <= 10""",
        "ml_importance_fixed_score": f"""{fixed}, dr AS (
            SELECT feature, (SELECT ap FROM ap WHERE feature = '') - ap AS lost
            FROM ap WHERE feature <> '')
            SELECT feature, round(avg(lost), 9) AS importance, round(stddev_pop(lost), 9) AS std
            FROM dr GROUP BY feature""",
        "ml_comparison_fixed_score": f"""{fixed} SELECT 'Fixed score' AS Model,
            round(auc, 6) AS ROC_AUC, round(ap, 6) AS PR_AUC FROM ap WHERE feature = ''""",
    }


def all_statements() -> dict[str, str]:
    return {
        **shaping(),
        **session_rows(),
        **order_rows(),
        **cohort_rows(),
        **share_rows(),
        **audit_reports(),
        **kpi_reports(),
        **segment_reports(),
        **feature_reports(),
        **quality_measures(),
        **model_checks(),
    }
