"""SQL for DuckDB that states each query's result over the flat driver tables.

The statements never see nested events or Spark's intermediate tables: sessions,
orders and customers are derived again, with window functions over ``events``.
"""

from __future__ import annotations

from cartwright.functions.columns import WHITE_SPACE

HOUR_MICROS = 3_600_000_000


def item(number: int) -> str:
    """Category of an item of a view; the list restates the adapter's."""
    return f"""['Apparel', 'Men''s / Unisex', 'Drinkware', 'Bags', 'Notebooks', 'Eco-Friendly',
       'Google', 'Sale', 'New', 'Campus Collection', 'Accessories', 'Gift Cards', '', '(not set)',
       NULL][(k % 16 + {5 * number}) % 15 + 1]"""


def events_cte(split: int, gap_hours: int) -> str:
    """``ev``: one flat row per canonical event."""
    return f"""
WITH src AS (
  SELECT event_id, user_id, event_type, value,
         cast(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) AS us,
         'u' || user_id || '_' || (event_id % {split}) AS uid
  FROM events),
stepped AS (
  SELECT *, us - lag(us) OVER (PARTITION BY uid ORDER BY us, event_id) AS idle FROM src),
numbered AS (
  SELECT *, sum(CASE WHEN idle IS NULL OR idle > {gap_hours * HOUR_MICROS} THEN 1 ELSE 0 END)
              OVER (PARTITION BY uid ORDER BY us, event_id) AS nth FROM stepped),
placed AS (
  SELECT *, first_value(us) OVER s // 1000000 AS opened, row_number() OVER s AS pos,
    CASE event_type
      WHEN 'view' THEN 'view_item' WHEN 'signup' THEN 'first_visit'
      WHEN 'purchase' THEN 'purchase'
      WHEN 'click' THEN ['add_to_cart', 'begin_checkout', 'add_payment_info'][k % 3 + 1]
      WHEN 'error' THEN ['add_shipping_info', 'view_search_results'][k % 2 + 1] END AS nm
  FROM numbered WINDOW s AS (PARTITION BY uid, nth ORDER BY us, event_id)),
sent AS (
  SELECT event_id, us, nm, value, uid, user_id, k, opened FROM placed
  UNION ALL
  SELECT event_id, us, 'session_start', value, uid, user_id, k, opened
  FROM placed WHERE pos = 1 AND k % 10 <> 0
  UNION ALL
  SELECT event_id + 1000000000, us + 1000000, nm,
         round(value + CASE WHEN event_id % 27 = 0 THEN 1 ELSE 0 END, 2), uid, user_id, k, opened
  FROM placed WHERE nm = 'purchase' AND event_id % 9 = 0),
ev AS (
  SELECT event_id, us, nm, CASE WHEN event_id % 61 <> 5 THEN uid END AS uid,
    CASE WHEN event_id % 50 = 7 THEN NULL ELSE opened END AS sid,
    cast(make_timestamp(us - {8 * HOUR_MICROS}) AS DATE) AS d,
    ['desktop', 'mobile', 'tablet'][event_id % 3 + 1] AS dev,
    ['google', '(direct)', '<Other>', 'google', NULL][
      (user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS src,
    ['organic', '(none)', 'referral', 'cpc', NULL][
      (user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS med,
    CASE WHEN nm <> 'purchase' OR k < 5 THEN NULL WHEN k < 8 THEN '' WHEN k < 12 THEN '(not set)'
         ELSE 'T' || k || '-' || (user_id % 5) END AS txn,
    CASE WHEN nm = 'purchase' AND event_id % 40 <> 3 THEN value END AS rev,
    CASE WHEN nm = 'purchase' THEN cast(1 + k % 5 AS BIGINT) END AS qty,
    CASE WHEN nm = 'view_item' AND k % 16 <> 15
      THEN [{item(0)}, {item(1)}, {item(2)}][1:event_id % 3 + 1] END AS cats,
    cats[1] AS cat
  FROM sent)"""


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(100 * (({part}) / nullif({whole}, 0)), {digits})"


def money(column: str) -> str:
    """Exact sum of amounts in cents, as a double."""
    return f"cast(sum(cast({column} AS DECIMAL(28, 2))) AS DOUBLE)"


def mean_money(column: str) -> str:
    return f"{money(column)} / count({column})"


def has(step: str) -> str:
    return f"cast(bool_or(nm = '{step}') AS INTEGER)"


# The values below restate the report settings for the driver tables.
FUNNEL = (
    "'session_start', 'view_item', 'add_to_cart', 'begin_checkout', "
    "'add_shipping_info', 'add_payment_info', 'purchase'"
)
KPI_EVENTS = FUNNEL.replace("'add_shipping_info', ", "")
MAIN_EVENTS = "'session_start', 'view_item', 'begin_checkout', 'purchase'"
STRICT = "txn IS NOT NULL AND txn NOT IN ('', '(not set)')"
LOOSE = "txn IS NOT NULL AND txn <> ''"
UNUSABLE = "(txn IS NULL OR txn IN ('', '(not set)'))"
KEYED = "uid IS NOT NULL AND sid IS NOT NULL"
PAIR = "CASE WHEN sid IS NOT NULL THEN uid || '|' || sid END"
USER = "uid AS user_pseudo_id"
KEYS = "uid AS user_pseudo_id, sid AS ga_session_id"


def three_periods(day: str) -> str:
    return (
        f"CASE WHEN {day} BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' THEN 'P1' "
        f"WHEN {day} BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' THEN 'P2' "
        f"WHEN {day} BETWEEN DATE '2024-01-21' AND DATE '2024-01-30' THEN 'P3' END"
    )


def two_periods(day: str) -> str:
    return (
        f"CASE WHEN {day} BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' THEN 'P1' "
        f"WHEN {day} BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' THEN 'P2' END"
    )


def phase(day: str) -> str:
    return (
        f"CASE WHEN {day} < DATE '2024-01-11' THEN 'Pre-instrumentation' "
        f"WHEN {day} = DATE '2024-01-11' THEN 'Transition day' ELSE 'Stable period' END"
    )


def family(category: str, apparel: str) -> str:
    # The product families in matching order.
    rules = (
        ("Apparel", apparel),
        ("Drinkware", "drinkware|mugs|tumblers|water bottles"),
        ("Bags", "bags|backpacks"),
        ("Stationery", "stationery|notebooks|writing"),
        ("Eco-Friendly", "eco-friendly"),
        ("Shop by Brand", "shop by brand|google|android|youtube"),
        ("Sale", "sale"),
        ("New", "new"),
        ("Campus Collection", "campus collection"),
        ("Lifestyle & Accessories", "lifestyle|small goods|accessories"),
    )
    whens = " ".join(
        f"WHEN regexp_matches(lower({category}), '{p}') THEN '{name}'" for name, p in rules
    )
    return (
        f"CASE WHEN {category} IS NULL OR trim({category}, '{WHITE_SPACE}') = '' "
        f"OR lower({category}) = '(not set)' THEN '(not set)' {whens} ELSE 'Other' END"
    )


PLAIN = family("cat", "apparel|men''s|women''s|kids|t-shirts")
DOUBLED = family("cat", "apparel|men''''s|women''''s|kids|t-shirts")

# Sessions by user and session id, with what the reports read from them.
SESSIONS = f"""
ss AS (
  SELECT uid, sid,
    min(d) FILTER (nm = 'session_start') AS day,
    arg_min(dev, (us, event_id)) FILTER (nm = 'session_start' AND dev IS NOT NULL) AS dev,
    arg_min(src, (us, event_id)) FILTER (nm = 'session_start' AND src IS NOT NULL) AS src,
    arg_min(med, (us, event_id)) FILTER (nm = 'session_start' AND med IS NOT NULL) AS med,
    arg_min({PLAIN}, (us, event_id)) FILTER (nm = 'view_item') AS fam,
    arg_min({DOUBLED}, (us, event_id)) FILTER (nm = 'view_item') AS fam2,
    {has('session_start')} AS st, {has('first_visit')} AS fv, {has('view_item')} AS vi,
    {has('add_to_cart')} AS ca, {has('begin_checkout')} AS ch, {has('add_payment_info')} AS pa,
    {has('purchase')} AS pu
  FROM ev WHERE {KEYED} AND nm IN ({FUNNEL}, 'first_visit') GROUP BY uid, sid)"""

# Sessions without first_visit and shipping events, as the session totals count them.
KPI_SESSIONS = f"""
ks AS (
  SELECT uid, sid, {has('session_start')} AS st, {has('view_item')} AS vi,
    {has('add_to_cart')} AS ca, {has('begin_checkout')} AS ch,
    {has('add_payment_info')} AS pa, {has('purchase')} AS pu
  FROM ev WHERE {KEYED} AND nm IN ({KPI_EVENTS}) GROUP BY uid, sid)"""

STEPS = f"""
tm AS (
  SELECT uid, sid,
    min(us) FILTER (nm = 'session_start') AS t0, min(us) FILTER (nm = 'view_item') AS t1,
    min(us) FILTER (nm = 'add_to_cart') AS t2, min(us) FILTER (nm = 'begin_checkout') AS t3,
    min(us) FILTER (nm = 'add_shipping_info') AS t4,
    min(us) FILTER (nm = 'add_payment_info') AS t5, min(us) FILTER (nm = 'purchase') AS t6
  FROM ev WHERE {KEYED} AND nm IN ({FUNNEL}) GROUP BY uid, sid)"""

DAY_SESSIONS = f"""
dy AS (
  SELECT d, uid, sid, {has('session_start')} AS st, {has('view_item')} AS vi,
         {has('begin_checkout')} AS ch, {has('purchase')} AS pu
  FROM ev WHERE {KEYED} AND nm IN ({MAIN_EVENTS}) GROUP BY d, uid, sid)"""


def orders_cte(name: str, keys: str, where: str = "true") -> str:
    """Orders by ``keys``, valued by their earliest purchase event."""
    return f"""
{name} AS (
  SELECT {keys}, min(us) AS ots, min(d) AS oday,
    arg_min_null(rev, (us, event_id)) AS orev, arg_min_null(qty, (us, event_id)) AS oqty,
    arg_min(dev, (us, event_id)) FILTER (dev IS NOT NULL) AS odev,
    arg_min(coalesce(src, '(unknown)'), (us, event_id)) AS osrc,
    arg_min(coalesce(med, '(unknown)'), (us, event_id)) AS omed
  FROM ev WHERE nm = 'purchase' AND {KEYED} AND {STRICT} AND {where} GROUP BY {keys})"""


ORDERS = orders_cte("od", "uid, sid, txn")
DAY_ORDERS = orders_cte("dd", "d, uid, sid, txn")
USER_ORDERS = orders_cte("ud", "uid, txn")

# Days of the customer reports, and their orders.
WINDOW = "d BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"
WINDOW_ORDERS = orders_cte("od", "uid, sid, txn", WINDOW)
WINDOW_USER_ORDERS = orders_cte("ud", "uid, txn", WINDOW)

STARTED = """count(*) FILTER (st = 1) AS sessions, count(*) FILTER (st = 1 AND vi = 1) AS product_view_sessions,
    count(*) FILTER (st = 1 AND ch = 1) AS checkout_sessions,
    count(*) FILTER (st = 1 AND pu = 1) AS purchase_sessions"""

PLAIN_RATES = f"""{pct('product_view_sessions', 'sessions')} AS product_view_rate_pct,
  {pct('checkout_sessions', 'product_view_sessions')} AS view_to_checkout_pct,
  {pct('purchase_sessions', 'checkout_sessions')} AS checkout_to_purchase_pct,
  {pct('purchase_sessions', 'sessions')} AS session_conversion_pct"""

# Retention: user days, first visits, and distinct active weeks under both floors.
COHORTS = """
ua AS (
  SELECT uid, d, bool_or(nm = 'first_visit') AS fv, bool_or(nm = 'session_start') AS ss
  FROM ev WHERE nm IN ('first_visit', 'session_start') AND uid IS NOT NULL GROUP BY uid, d),
fd AS (SELECT uid, min(d) FILTER (fv) AS first_day FROM ua GROUP BY uid),
cu AS (
  SELECT uid, first_day, cast(date_trunc('week', first_day) AS DATE) AS cw
  FROM fd WHERE first_day IS NOT NULL),
sz AS (SELECT cw, count(*) AS size FROM cu GROUP BY cw),
wk AS (
  SELECT DISTINCT uid, cw, cast((cast(date_trunc('week', d) AS DATE) - cw) // 7 AS INTEGER) AS w
  FROM cu JOIN ua USING (uid) WHERE ss AND d >= first_day),
wc AS (
  SELECT DISTINCT uid, cw, cast((cast(date_trunc('week', d) AS DATE) - cw) // 7 AS INTEGER) AS w
  FROM cu JOIN ua USING (uid) WHERE ss AND d >= cw),
fin AS (SELECT max(d) AS last_day FROM ua)"""

SUMMARY = f"""{COHORTS},
cr AS (
  SELECT cw, size, last_day,
    (SELECT count(*) FROM wk WHERE wk.cw = sz.cw AND w = 1) AS n1,
    (SELECT count(*) FROM wk WHERE wk.cw = sz.cw AND w = 2) AS n2,
    (SELECT count(*) FROM wk WHERE wk.cw = sz.cw AND w = 4) AS n4
  FROM sz, fin)"""


def weighted(week: int) -> str:
    """Each cohort's size times its rate, over cohorts whose week has begun."""
    open_ = f"cw + {7 * week} <= last_day"
    kept = f"sum(CASE WHEN {open_} THEN size * (n{week} / size) ELSE 0 END)"
    size = f"sum(CASE WHEN {open_} THEN size ELSE 0 END)"
    return pct(kept, size)


def buyers_cte(orders: str, tie: str) -> str:
    """``by``: first and second order day per customer, by rank and by day."""
    return f"""
rk AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ots, {tie}) AS n FROM {orders}),
by_ AS (
  SELECT uid, min(oday) FILTER (n = 1) AS rank_day, min(oday) AS min_day,
         min(oday) FILTER (n = 2) AS next_day FROM rk GROUP BY uid)"""


def value_cte(orders: str, first: str) -> str:
    """``cv``: value of each customer in the 14 days from the first order day."""
    return f"""
cv AS (
  SELECT c.uid, c.{first} AS first_day, c.next_day - c.{first} AS gap, count(o.txn) AS n,
         {money('o.orev')} AS rev, cast(sum(o.oqty) AS BIGINT) AS qty
  FROM by_ c JOIN {orders} o
    ON o.uid = c.uid AND o.oday >= c.{first} AND o.oday <= c.{first} + 14
  GROUP BY ALL)"""


# The customer feature table, rebuilt in SQL; `ft` has its 16 columns.
FEATURES = f"""{WINDOW_ORDERS},
fo AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ots, txn, sid) AS n FROM od)
  WHERE n = 1 AND oday BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'),
lb AS (
  SELECT f.uid, max(CASE WHEN o.ots > f.ots AND o.ots <= f.ots + 14 * 86400000000
                         THEN 1 ELSE 0 END) AS again
  FROM fo f JOIN od o ON o.uid = f.uid GROUP BY f.uid),
pt AS (
  SELECT f.uid, count(DISTINCT e.sid) AS ns, count(*) FILTER (e.nm = 'view_item') AS nv,
    count(*) FILTER (e.nm = 'add_to_cart') AS na, count(*) FILTER (e.nm = 'begin_checkout') AS nc,
    count(*) FILTER (e.nm = 'view_search_results') AS nq, min(e.us) FILTER (e.nm = 'first_visit') AS fvt
  FROM fo f JOIN ev e ON e.uid = f.uid AND e.us <= f.ots AND e.{WINDOW} GROUP BY f.uid),
ft AS (
  SELECT f.uid AS user_pseudo_id, f.oday AS first_order_date,
    cast(dayofweek(make_timestamp(f.ots)) + 1 AS INTEGER) AS purchase_day_of_week,
    cast(hour(make_timestamp(f.ots)) AS INTEGER) AS purchase_hour_utc,
    f.odev AS device_category, f.osrc AS first_source, f.omed AS first_medium,
    round(f.orev, 2) AS first_order_revenue, f.oqty AS first_order_items,
    p.ns AS sessions_before_first_purchase, p.nv AS product_views_before_purchase,
    p.na AS add_to_cart_before_purchase, p.nc AS checkout_events_before_purchase,
    p.nq AS search_events_before_purchase,
    (f.ots - p.fvt) // 86400000000 AS days_first_visit_to_purchase,
    l.again AS repeat_purchase_14d
  FROM fo f JOIN pt p USING (uid) JOIN lb l USING (uid))"""

NUMERIC = (
    "first_order_revenue",
    "first_order_items",
    "sessions_before_first_purchase",
    "product_views_before_purchase",
    "add_to_cart_before_purchase",
    "checkout_events_before_purchase",
    "search_events_before_purchase",
    "days_first_visit_to_purchase",
)
CATEGORICAL = (
    "purchase_day_of_week",
    "purchase_hour_utc",
    "device_category",
    "first_source",
    "first_medium",
)

# Test rows per class: what is left of it after the training share.
SPLIT = f"""{FEATURES},
cl AS (
  SELECT y, n, tot, tot - cast(ceil(round(0.2 * tot, 6)) AS BIGINT) AS tr FROM (
    SELECT repeat_purchase_14d AS y, count(*) AS n, cast(sum(count(*)) OVER () AS BIGINT) AS tot
    FROM ft GROUP BY y)),
qt AS (
  SELECT y, n - (tr * n) // tot - CASE
    WHEN row_number() OVER (ORDER BY (tr * n) % tot DESC, y)
         <= tr - sum((tr * n) // tot) OVER () THEN 1 ELSE 0 END AS quota
  FROM cl),
sp AS (
  SELECT ft.*, CASE WHEN row_number() OVER (
      PARTITION BY y ORDER BY md5(user_pseudo_id || ':42'), user_pseudo_id) <= quota
    THEN 'test' ELSE 'train' END AS split
  FROM ft JOIN qt ON y = repeat_purchase_14d)"""


def each(columns: tuple[str, ...], template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


# Long numeric values after the median fill, with indicators for columns that had
# gaps in training; `sc` scales them by training mean and population deviation.
IMPUTED = f"""{SPLIT},
nl AS ({each(NUMERIC, "SELECT user_pseudo_id, split, '{c}' AS f, cast({c} AS DOUBLE) AS v FROM sp")}),
md AS (SELECT f, median(v) AS m, count(*) - count(v) AS gaps
       FROM nl WHERE split = 'train' GROUP BY f),
im AS (
  SELECT user_pseudo_id, split, 'num__' || f AS feature, coalesce(v, m) AS value
  FROM nl JOIN md USING (f)
  UNION ALL
  SELECT user_pseudo_id, split, 'num__missingindicator_' || f,
         CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END
  FROM nl JOIN md USING (f) WHERE gaps > 0)"""

SCALED = f"""
sd AS (
  SELECT feature, avg(value) AS mu, stddev_pop(value) AS sigma
  FROM im WHERE split = 'train' GROUP BY feature),
sc AS (
  SELECT user_pseudo_id, feature,
         (value - mu) / CASE WHEN sigma = 0 THEN 1 ELSE sigma END AS value
  FROM im JOIN sd USING (feature))"""

TEXT = f"""
tl AS ({each(CATEGORICAL, "SELECT user_pseudo_id, split, '{c}' AS f, cast({c} AS VARCHAR) AS v FROM sp")}),
mo AS (
  SELECT f, arg_min(v, (-n, v)) AS m FROM (
    SELECT f, v, count(*) AS n FROM tl WHERE split = 'train' AND v IS NOT NULL GROUP BY f, v)
  GROUP BY f),
tf AS (SELECT user_pseudo_id, split, f, coalesce(v, m) AS v FROM tl JOIN mo USING (f)),
vc AS (SELECT DISTINCT f, v FROM tf WHERE split = 'train')"""

# Label and score of the documents, and counts at or above each distinct score.
SCORED = """
WITH sd AS (
  SELECT quality AS y, n_chars AS s, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS guess
  FROM labels JOIN documents USING (doc_id)),
at_score AS (
  SELECT cast(s AS DOUBLE) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q FROM sd GROUP BY s),
cum AS (
  SELECT s, p, q, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp,
         sum(p) OVER () AS np, sum(q) OVER () AS nq
  FROM at_score)"""

CURVE = f"""{SCORED},
pts AS (
  SELECT s AS threshold, tp / (tp + fp) AS precision, tp / nullif(np, 0) AS recall FROM cum)"""


def plain(*ctes: str) -> str:
    return ", ".join([events_cte(1, 12), *ctes])


def customer(*ctes: str) -> str:
    return ", ".join([events_cte(8, 72), *ctes])


def feature_rows(columns: str = "*", extra: str = "") -> str:
    return f"{customer(FEATURES)} SELECT {columns} FROM ft {extra}"
