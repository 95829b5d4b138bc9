"""For each query the same result in SQL, written without regard to scale."""

from __future__ import annotations

from verification.queries import DIGITS

_SALES = """
SELECT o.o_orderpriority AS platform, n.n_name AS city, sn.n_name AS district, c.c_mktsegment AS store_type,
 CASE WHEN MOD(n.n_nationkey, 5) = 0 AND MOD(l.l_orderkey, 5) < 3 THEN 'Supplier#HUB'
  WHEN MOD(n.n_nationkey, 5) = 1 AND MOD(l.l_orderkey, 20) < 9 THEN 'Supplier#MID' ELSE s.s_name END AS institution,
 p.p_type AS category, p.p_brand AS subcategory, CAST(p.p_size AS VARCHAR(20)) AS spec,
 CONCAT(p.p_name, ' ', p.p_brand) AS project_name,
 l.l_extendedprice * (CASE WHEN MOD(l.l_orderkey, 250) = 7 THEN 8.0E0 ELSE 1.0E0 END) AS list_price,
 l.l_extendedprice * (CASE WHEN MOD(l.l_orderkey, 250) = 7 THEN 8.0E0 ELSE 1.0E0 END)
  * (1.0E0 - 5.0E0 * l.l_discount) AS actual_price,
 1.0E0 - 5.0E0 * l.l_discount AS discount_rate,
 l.l_quantity AS monthly_sales,
 l.l_quantity * (1 + MOD(l.l_orderkey + l.l_linenumber, 4)) AS review_count,
 3.6E0 + MOD(l.l_orderkey * 7 + l.l_linenumber * 3, 15) / 10.0E0 AS rating,
 c.c_name AS doctor_name, CONCAT('T', CAST(MOD(c.c_custkey, 4) AS VARCHAR(4))) AS doctor_title,
 l.l_returnflag AS payment_method,
 CASE WHEN l.l_linestatus = 'F' THEN 1.0E0 ELSE 0.0E0 END AS installment,
 r.r_name AS channel, o.o_orderstatus AS activity_tag,
 CASE CASE WHEN MOD(l.l_suppkey, 3) = 2 THEN MOD(l.l_partkey + l.l_orderkey, 8)
  WHEN MOD(l.l_suppkey, 3) = 1 THEN MOD(l.l_partkey + l.l_orderkey, 24) ELSE 9 END
  WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '未知' WHEN 3 THEN 'FDA-1'
  ELSE CONCAT('国械注准', CAST(l.l_partkey AS VARCHAR(20))) END AS approval_no,
 p.p_brand AS device_brand, CONCAT(p.p_brand, '-', CAST(p.p_size AS VARCHAR(20))) AS device_model,
 CASE WHEN MOD(l.l_suppkey, 3) = 0 THEN 1.0E0
  ELSE CASE MOD(l.l_orderkey, 5) WHEN 0 THEN NULL WHEN 1 THEN 0.0E0 ELSE 1.0E0 END END AS udi_match,
 o.o_orderdate AS listing_date, l.l_shipdate AS collection_date,
 CASE WHEN c.c_acctbal < 1000 THEN 1.0E0 ELSE 0.0E0 END AS new_customer,
 SUBSTRING(CAST(l.l_shipdate AS VARCHAR(30)), 1, 7) AS stats_month
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey
"""

_SEGMENTS = """
SELECT *, CASE WHEN list_price >= 60000 THEN 1 WHEN monthly_sales >= 25 THEN 2 ELSE 0 END AS cluster
FROM sales
"""

_DATE_TEXT = "SUBSTRING(CAST(collection_date AS VARCHAR(30)), 1, 10)"
_DIRTY_ONCE = f"""
SELECT city, category, institution, approval_no,
 CASE WHEN MOD(id, 13) = 0 THEN NULL ELSE district END AS district,
 CASE WHEN MOD(id, 29) = 0 THEN 'n/a?' WHEN MOD(id, 97) = 0 THEN CAST(list_price * 50 AS VARCHAR(30))
  ELSE CAST(list_price AS VARCHAR(30)) END AS list_price,
 CASE WHEN MOD(id, 31) = 0 THEN NULL ELSE CAST(monthly_sales AS VARCHAR(30)) END AS monthly_sales,
 CASE WHEN MOD(id, 37) = 0 THEN '########' WHEN MOD(id, 41) = 0 THEN '2025-02-30'
  WHEN MOD(id, 2) = 0 THEN REPLACE({_DATE_TEXT}, '-', '/') ELSE {_DATE_TEXT} END AS collection_date
FROM (SELECT *, CAST(FLOOR(list_price * 100 + monthly_sales) AS BIGINT) AS id FROM sales)
"""
_DIRTY = "SELECT * FROM once UNION ALL SELECT * FROM once WHERE city = 'NATION_1'"

_TYPED = """
SELECT * REPLACE (
 TRY_CAST(list_price AS DOUBLE) AS list_price, TRY_CAST(monthly_sales AS DOUBLE) AS monthly_sales,
 CAST(TRY_STRPTIME(REPLACE(collection_date, '/', '-'), '%Y-%m-%d') AS DATE) AS collection_date)
FROM dirty
"""

# All raw columns of the dirty rows, as they are once typed.
_WIDE_ONCE = """
SELECT * EXCLUDE (id, stats_month) REPLACE (
 CASE WHEN MOD(id, 13) = 0 THEN NULL ELSE district END AS district,
 CASE WHEN MOD(id, 29) = 0 THEN NULL WHEN MOD(id, 97) = 0 THEN list_price * 50 ELSE list_price END AS list_price,
 CASE WHEN MOD(id, 31) = 0 THEN NULL ELSE monthly_sales END AS monthly_sales,
 CAST(listing_date AS DATE) AS listing_date,
 CASE WHEN MOD(id, 37) = 0 OR MOD(id, 41) = 0 THEN NULL ELSE CAST(collection_date AS DATE) END AS collection_date)
FROM (SELECT *, CAST(FLOOR(list_price * 100 + monthly_sales) AS BIGINT) AS id FROM sales)
"""
_WIDE = "SELECT * FROM wide_once UNION ALL SELECT * FROM wide_once WHERE city = 'NATION_1'"
_NUMBERS = ("list_price actual_price discount_rate monthly_sales review_count rating installment "
            "udi_match new_customer").split()
_LABELLED = ("platform city district store_type institution category subcategory spec project_name doctor_name "
             "doctor_title payment_method channel activity_tag approval_no device_brand device_model").split()

_BASES = {
    "wide": [("sales", _SALES), ("wide_once", _WIDE_ONCE), ("wide", _WIDE)],
    "sales": [("sales", _SALES)],
    "segments": [("sales", _SALES), ("segments", _SEGMENTS)],
    "typed": [("sales", _SALES), ("once", _DIRTY_ONCE), ("dirty", _DIRTY), ("typed", _TYPED)],
}


def _sql(base: str, body: str, doubles: str = "") -> str:
    """``body`` over a base relation, its double columns rounded as the queries are."""
    rounds = ", ".join(
        f"ROUND({c} + 1e-{DIGITS.get(c, 6) + 3}, {DIGITS.get(c, 6)}) AS {c}" for c in doubles.split()
    )
    columns = f"* REPLACE ({rounds})" if rounds else "*"
    ctes = ", ".join(f"{name} AS ({text})" for name, text in _BASES.get(base, []))
    return f"{'WITH ' + ctes if ctes else ''} SELECT {columns} FROM ({body}) AS result"


# -- trend sections ----------------------------------------------------------

_AGGREGATES = {
    "total_sales": "SUM(monthly_sales)",
    "avg_rating": "AVG(rating)",
    "avg_actual_price": "AVG(actual_price)",
    "avg_list_price": "AVG(list_price)",
    "avg_discount": "AVG(discount_rate)",
    "avg_review_count": "AVG(review_count)",
    "avg_monthly_sales": "AVG(monthly_sales)",
}
_TREND_BAND = """CASE WHEN discount_rate IS NULL THEN '未知' WHEN discount_rate < 0.7 THEN '低折扣(<0.7)'
 WHEN discount_rate < 0.85 THEN '中折扣(0.7-0.85)' WHEN discount_rate <= 1.0 THEN '高折扣(>=0.85)' ELSE '其它' END"""

# name: keys, columns, sorted by, limit
_TREND = {
    "available_months": ("stats_month", "row_cnt", "", 0),
    "sales_trend_by_month": (
        "stats_month",
        "total_sales project_count avg_rating avg_actual_price avg_list_price avg_discount", "", 0),
    "summary": (
        "", "row_cnt total_sales avg_rating avg_actual_price avg_list_price avg_discount avg_review_count",
        "", 0),
    "by_city": ("city", "total_sales project_count avg_rating avg_actual_price avg_discount", "total_sales", 30),
    "by_category": (
        "category", "total_sales project_count avg_actual_price avg_discount avg_rating", "total_sales", 0),
    "by_channel": ("channel", "total_sales count avg_rating", "total_sales", 0),
    "by_district": ("district", "total_sales project_count avg_actual_price avg_rating", "total_sales", 40),
    "by_subcategory": ("subcategory", "total_sales project_count", "total_sales", 30),
    "by_store_type": ("store_type", "total_sales project_count avg_actual_price", "total_sales", 0),
    "by_platform": ("platform", "total_sales project_count avg_rating", "total_sales", 0),
    "top_projects": ("project_name", "total_sales listing_count avg_actual_price avg_rating", "total_sales", 25),
    "doctor_title_stats": (
        "doctor_title", "total_sales project_count avg_rating avg_actual_price", "total_sales", 20),
    "discount_band_stats": ("discount_band", "project_count avg_monthly_sales avg_rating", "avg_monthly_sales", 0),
    "city_category_top": ("city category", "total_sales project_count", "total_sales", 40),
    "cluster_summary": (
        "cluster", "count avg_monthly_sales avg_rating avg_actual_price avg_list_price avg_discount", "", 0),
    "cluster_by_city": ("cluster city", "count avg_monthly_sales avg_actual_price", "", 0),
    "cluster_by_category": ("cluster category", "count avg_monthly_sales avg_actual_price", "", 0),
    "cluster_by_channel": ("cluster channel", "count avg_monthly_sales avg_rating", "", 0),
}


def _key(k: str) -> str:
    return _TREND_BAND if k == "discount_band" else k


def _trend(name: str) -> str:
    keys, columns, by, limit = _TREND[name]
    keys, columns = keys.split(), columns.split()
    picked = [f'{_key(k)} AS "{k}"' for k in keys]
    picked += [f'{_AGGREGATES.get(c, "COUNT(*)")} AS "{c}"' for c in columns]
    body = f"SELECT {', '.join(picked)} FROM segments"
    if keys:
        body += f" GROUP BY {', '.join(_key(k) for k in keys)}"
    if limit:
        body += f" ORDER BY {by} DESC NULLS LAST, {', '.join(k + ' ASC NULLS FIRST' for k in keys)} LIMIT {limit}"
    return _sql("segments", body, " ".join(c for c in columns if c in _AGGREGATES))


def _trend_report(names: list[str], where: str = "") -> str:
    used = list(dict.fromkeys(c for n in names for c in _TREND[n][1].split() if c in _AGGREGATES))
    parts = []
    for n in names:
        keys, columns = _TREND[n][0].split(), _TREND[n][1].split()
        texts = [f"CAST({_key(k)} AS VARCHAR)" for k in keys] + ["CAST(NULL AS VARCHAR)"] * (2 - len(keys))
        values = [f"{_AGGREGATES[c] if c in columns else 'CAST(NULL AS DOUBLE)'} AS {c}" for c in used]
        part = (
            f"SELECT '{n}' AS section, {texts[0]} AS key_1, {texts[1]} AS key_2, COUNT(*) AS row_cnt, "
            f"{', '.join(values)} FROM segments {where}"
        )
        parts.append(part + (f" GROUP BY {', '.join(_key(k) for k in keys)}" if keys else ""))
    return _sql("segments", " UNION ALL ".join(parts), " ".join(used))


# -- theme tables --------------------------------------------------------------

_BAND = """CASE WHEN discount_rate IS NULL THEN '未知' WHEN discount_rate < 0.6 THEN '深折(<0.6)'
 WHEN discount_rate < 0.75 THEN '中折(0.6-0.75)' WHEN discount_rate < 0.9 THEN '浅折(0.75-0.9)' ELSE '原价(>=0.9)' END"""

_PROFILE = """
SELECT cluster, project_count, total_sales, avg_list_price, avg_actual_price, avg_discount, avg_monthly_sales,
 avg_review_count, avg_rating, price_rank, sales_rank,
 CASE WHEN price_rank = 1 THEN '高端精品型' WHEN sales_rank = 1 THEN '大众爆款型'
  WHEN cheap = 1 AND slow = 1 THEN '长尾引流型' ELSE '中端主力型' END AS cluster_label,
 CASE WHEN avg_discount < 0.7 THEN '深折促销' WHEN avg_discount < 0.85 THEN '中度折扣'
  ELSE '高折扣/原价' END AS discount_level
FROM (SELECT *, RANK() OVER (ORDER BY avg_list_price DESC) AS price_rank,
  RANK() OVER (ORDER BY avg_monthly_sales DESC) AS sales_rank,
  RANK() OVER (ORDER BY avg_list_price) AS cheap, RANK() OVER (ORDER BY avg_monthly_sales) AS slow
 FROM (SELECT cluster, COUNT(*) AS project_count, SUM(monthly_sales) AS total_sales,
   AVG(list_price) AS avg_list_price, AVG(actual_price) AS avg_actual_price,
   AVG(discount_rate) AS avg_discount, AVG(monthly_sales) AS avg_monthly_sales,
   AVG(review_count) AS avg_review_count, AVG(rating) AS avg_rating
  FROM segments GROUP BY cluster))
"""
_CITY_RANK = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY total_sales DESC, city) AS rank_in_cluster,
 RANK() OVER (PARTITION BY city ORDER BY total_sales DESC) AS cluster_rank_in_city
FROM (SELECT cluster, city, SUM(monthly_sales) AS total_sales, COUNT(*) AS project_count,
  AVG(actual_price) AS avg_actual_price, AVG(rating) AS avg_rating FROM segments GROUP BY cluster, city)
"""
_PREFERENCE = """
SELECT a.cluster, a.category, a.s AS cat_sales, a.n AS cat_count, a.s / b.s AS cluster_share,
 c.s / d.s AS global_share, (a.s / b.s) / (c.s / d.s) AS preference_lift,
 RANK() OVER (PARTITION BY a.cluster ORDER BY a.s DESC) AS cat_rank_in_cluster
FROM (SELECT cluster, category, SUM(monthly_sales) AS s, COUNT(*) AS n FROM segments GROUP BY 1, 2) a
JOIN (SELECT cluster, SUM(monthly_sales) AS s FROM segments GROUP BY 1) b ON a.cluster = b.cluster
JOIN (SELECT category, SUM(monthly_sales) AS s FROM segments GROUP BY 1) c ON a.category = c.category
CROSS JOIN (SELECT SUM(monthly_sales) AS s FROM segments) d
"""
_CHANNEL = """
SELECT *, weighted_sales / project_count AS efficiency_score,
 RANK() OVER (PARTITION BY cluster ORDER BY weighted_sales DESC) AS channel_rank_in_cluster,
 RANK() OVER (PARTITION BY channel ORDER BY weighted_sales DESC) AS cluster_rank_in_channel
FROM (SELECT cluster, channel, SUM(monthly_sales) AS total_sales, COUNT(*) AS project_count,
  AVG(rating) AS avg_rating, SUM(monthly_sales * rating) AS weighted_sales,
  AVG(actual_price) AS avg_actual_price FROM segments GROUP BY cluster, channel)
"""
_BANDS = f"""
SELECT *, PERCENT_RANK() OVER (PARTITION BY cluster ORDER BY total_sales) AS sales_pct_in_cluster,
 RANK() OVER (PARTITION BY cluster ORDER BY total_sales DESC) AS band_rank_in_cluster
FROM (SELECT cluster, {_BAND} AS discount_band, COUNT(*) AS project_count, SUM(monthly_sales) AS total_sales,
  AVG(monthly_sales) AS avg_sales, AVG(rating) AS avg_rating, AVG(actual_price) AS avg_price
 FROM segments GROUP BY 1, 2)
"""
_TOP_PROJECTS = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY total_sales DESC, project_name) AS rn
 FROM (SELECT cluster, project_name, SUM(monthly_sales) AS total_sales, AVG(actual_price) AS avg_actual_price,
   AVG(rating) AS avg_rating, COUNT(*) AS listing_count FROM segments GROUP BY 1, 2)) WHERE rn <= 5
"""
_DOCTORS = """
SELECT *, RANK() OVER (PARTITION BY cluster ORDER BY total_sales DESC) AS title_rank_in_cluster
FROM (SELECT cluster, doctor_title, COUNT(*) AS project_count, COUNT(DISTINCT doctor_name) AS doctor_count,
  SUM(monthly_sales) AS total_sales, AVG(rating) AS avg_rating, AVG(actual_price) AS avg_actual_price
 FROM segments GROUP BY 1, 2)
"""
_MONTHS = """
SELECT *, total_sales - COALESCE(prev_sales, 0) AS sales_delta,
 CASE WHEN prev_sales <> 0 THEN (total_sales - prev_sales) / prev_sales END AS sales_growth_rate
FROM (SELECT *, LAG(total_sales) OVER w AS prev_sales, LAG(project_count) OVER w AS prev_count
 FROM (SELECT cluster, stats_month, SUM(monthly_sales) AS total_sales, COUNT(*) AS project_count,
   AVG(actual_price) AS avg_price FROM segments WHERE stats_month <> '未知' GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY cluster ORDER BY stats_month))
"""

_AVERAGES = "total_sales avg_actual_price avg_rating"


def _themes() -> dict[str, str]:
    wide = ", ".join(
        f"SUM(CASE WHEN discount_band = '{b}' THEN total_sales ELSE 0 END) AS \"{b}\""
        for b in ("深折(<0.6)", "中折(0.6-0.75)", "浅折(0.75-0.9)", "原价(>=0.9)", "未知")
    )
    segments = "(SELECT DISTINCT cluster FROM segments) k"
    return {
        "cluster_profile": _sql(
            "segments", _PROFILE,
            f"{_AVERAGES} avg_list_price avg_discount avg_monthly_sales avg_review_count"),
        "cluster_city_rank": _sql("segments", _CITY_RANK, _AVERAGES),
        "cluster_category_preference": _sql(
            "segments", _PREFERENCE, "cat_sales cluster_share global_share preference_lift"),
        "cluster_channel_efficiency": _sql(
            "segments", _CHANNEL, f"{_AVERAGES} weighted_sales efficiency_score"),
        "cluster_price_band": _sql(
            "segments", _BANDS, "total_sales avg_sales avg_rating avg_price sales_pct_in_cluster"),
        "cluster_top_projects": _sql("segments", _TOP_PROJECTS, _AVERAGES),
        "cluster_doctor_matching": _sql("segments", _DOCTORS, _AVERAGES),
        "cluster_month_delta": _sql(
            "segments", _MONTHS, "total_sales avg_price prev_sales sales_delta sales_growth_rate"),
        "city_spread_top10": _sql("segments", f"""
            WITH t AS ({_CITY_RANK}),
            grid AS (SELECT c.city, k.cluster, COALESCE(t.total_sales, 0) AS s
             FROM (SELECT DISTINCT city FROM t) c CROSS JOIN (SELECT DISTINCT cluster FROM t) k
             LEFT JOIN t ON t.city = c.city AND t.cluster = k.cluster),
            top AS (SELECT city, MAX(s) - MIN(s) AS spread, SUM(s) AS city_sales FROM grid GROUP BY city
             ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10)
            SELECT city, spread, city_sales, cluster, s AS cluster_sales FROM top JOIN grid USING (city)""",
            "spread city_sales cluster_sales"),
        "lift_heatmap": _sql("segments", f"""
            WITH t AS ({_PREFERENCE}),
            chosen AS (SELECT DISTINCT category FROM (SELECT category, ROW_NUMBER() OVER
              (PARTITION BY cluster ORDER BY preference_lift DESC, category) AS rn FROM t) WHERE rn <= 4)
            SELECT k.cluster, category, ROUND(preference_lift, 2) AS lift
            FROM chosen CROSS JOIN (SELECT DISTINCT cluster FROM t) k LEFT JOIN t USING (cluster, category)""",
            "lift"),
        "band_pivot": _sql("segments", f"SELECT cluster, {wide} FROM ({_BANDS}) GROUP BY cluster"),
        "month_pivot": _sql("segments", f"""
            WITH t AS ({_MONTHS})
            SELECT k.cluster, m.stats_month, COALESCE(total_sales, 0) AS total_sales,
             ROUND(sales_growth_rate * 100, 1) AS growth_pct
            FROM {segments} CROSS JOIN (SELECT DISTINCT stats_month FROM t) m
            LEFT JOIN t ON t.cluster = k.cluster AND t.stats_month = m.stats_month""", "total_sales growth_pct"),
        "channel_pivot": _sql("segments", f"""
            WITH t AS ({_CHANNEL})
            SELECT k.cluster, m.channel, COALESCE(weighted_sales, 0) AS weighted_sales
            FROM {segments} CROSS JOIN (SELECT DISTINCT channel FROM t) m
            LEFT JOIN t ON t.cluster = k.cluster AND t.channel = m.channel""", "weighted_sales"),
        "doctor_title_pivot": _sql("segments", f"""
            WITH t AS ({_DOCTORS}),
            top AS (SELECT doctor_title, SUM(total_sales) AS title_sales FROM t GROUP BY 1
             ORDER BY 2 DESC, 1 LIMIT 8)
            SELECT k.cluster, top.doctor_title, title_sales, COALESCE(total_sales, 0) AS total_sales
            FROM top CROSS JOIN {segments}
            LEFT JOIN t ON t.cluster = k.cluster AND t.doctor_title = top.doctor_title""",
            "title_sales total_sales"),
    }


# -- statistics, structure, compliance -------------------------------------------

_FEATURES = ["list_price", "actual_price", "discount_rate", "monthly_sales", "review_count", "rating"]


def _matrix(column: str, source: str) -> str:
    cells = []
    for a in _FEATURES:
        for b in _FEATURES:
            value = "1.0E0" if a == b else f"CORR({column.format(a)}, {column.format(b)})"
            cells.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {value} AS corr FROM {source}"
                         + (" LIMIT 1" if a == b else ""))
    return " UNION ALL ".join(f"({c})" for c in cells)


def _spearman(tie: str) -> str:
    ranks = ", ".join(f"RANK() OVER (ORDER BY {f}) {tie.format(f)} AS r_{f}" for f in _FEATURES)
    source = f"(SELECT {ranks} FROM sales)"
    return _sql("sales", f"WITH ranked AS {source} {_matrix('r_{}', 'ranked')}", "corr")


def _hhi(by: str) -> str:
    return f"""SELECT {by}, SUM(POWER(ss / total, 2)) * 10000 AS hhi,
     SUM(CASE WHEN rn <= 10 THEN ss / total END) AS cr10, COUNT(*) AS institution_count,
     MAX(total) AS total_sales
    FROM (SELECT *, SUM(ss) OVER (PARTITION BY {by}) AS total,
      ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY ss DESC, institution) AS rn
     FROM (SELECT {by}, institution, SUM(monthly_sales) AS ss FROM sales GROUP BY 1, 2)) GROUP BY {by}"""


_LEVEL = "CASE WHEN hhi < 1500 THEN '竞争充分' WHEN hhi < 2500 THEN '中度集中' ELSE '高度集中' END"

_PARETO = """
SELECT project_name, total_sales, ROW_NUMBER() OVER w AS rn,
 SUM(total_sales) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_sales,
 SUM(total_sales) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / SUM(total_sales) OVER () AS cum_share,
 ROW_NUMBER() OVER w / CAST(COUNT(*) OVER () AS DOUBLE) AS project_share
FROM (SELECT project_name, SUM(monthly_sales) AS total_sales FROM sales GROUP BY 1)
WINDOW w AS (ORDER BY total_sales DESC, project_name)
"""
_PARETO_SAMPLE = """SELECT * FROM p
WHERE MOD(rn - 1, (SELECT GREATEST(1, COUNT(*) // 500) FROM p)) = 0"""
_PARETO_BREAKS = """SELECT t AS cum_share_threshold, MIN(project_share) AS project_share, MIN(rn) AS rn
FROM p JOIN (VALUES (0.5E0), (0.8E0), (0.95E0)) AS v(t) ON cum_share >= t GROUP BY t"""

_SIMILARITY = """
SELECT a.city AS city_a, b.city AS city_b, COALESCE(MAX(dot), 0) AS similarity
FROM (SELECT DISTINCT city FROM sales) a CROSS JOIN (SELECT DISTINCT city FROM sales) b
LEFT JOIN (SELECT x.city AS ca, y.city AS cb, SUM(x.v * y.v) AS dot FROM unit x JOIN unit y USING (category)
 GROUP BY 1, 2) ON ca = a.city AND cb = b.city GROUP BY 1, 2
"""
_UNIT = """WITH cells AS (SELECT city, category, SUM(monthly_sales) AS s FROM sales GROUP BY 1, 2),
unit AS (SELECT city, category, s / NULLIF(SQRT(SUM(s * s) OVER (PARTITION BY city)), 0) AS v FROM cells)"""

_METRICS = """
AVG(CASE WHEN udi_match IS NULL OR udi_match = 0 THEN 1.0E0 ELSE 0.0E0 END) AS udi_mismatch_rate,
AVG(CASE WHEN approval_no IS NULL OR approval_no IN ('未知', '', 'nan', 'None') OR approval_no NOT LIKE '国械%'
 THEN 1.0E0 ELSE 0.0E0 END) AS invalid_approval_rate,
AVG(CASE WHEN rating < 4.0 THEN 1.0E0 ELSE 0.0E0 END) AS low_rating_rate,
AVG(CASE WHEN sd > 0 AND ABS((actual_price - mu) / sd) > 3 THEN 1.0E0 ELSE 0.0E0 END) AS price_anomaly_rate,
AVG(rating) AS avg_rating, AVG(actual_price) AS avg_actual_price, SUM(monthly_sales) AS total_sales,
COUNT(*) AS project_count
FROM sales CROSS JOIN (SELECT AVG(actual_price) AS mu, STDDEV_POP(actual_price) AS sd FROM sales) z
"""
_RATES = ("udi_mismatch_rate invalid_approval_rate low_rating_rate price_anomaly_rate "
          "avg_rating avg_actual_price total_sales")
_RISK = f"""
SELECT institution, project_count, total_sales, udi_mismatch_rate, invalid_approval_rate, low_rating_rate,
 price_anomaly_rate, avg_rating, avg_actual_price, risk_score,
 CASE WHEN risk_score >= 30 THEN '高风险' WHEN risk_score >= 15 THEN '中风险' ELSE '低风险' END AS risk_level,
 RANK() OVER (ORDER BY risk_score DESC) AS risk_rank
FROM (SELECT *, ROUND(100 * (0.40E0 * udi_mismatch_rate + 0.30E0 * invalid_approval_rate
  + 0.20E0 * low_rating_rate + 0.10E0 * price_anomaly_rate), 9) AS risk_score
 FROM (SELECT institution, {_METRICS} GROUP BY institution HAVING COUNT(*) >= 5))
"""


def _analysis() -> dict[str, str]:
    corr = "SELECT {0}, CORR(rating, monthly_sales) AS corr_rating_sales, COUNT(*) AS n, " \
           "AVG(rating) AS avg_rating, AVG(monthly_sales) AS avg_sales FROM sales GROUP BY {0}{1}"
    grouped = "corr_rating_sales avg_rating avg_sales"
    elasticity = """SELECT category, REGR_SLOPE(y, x) AS elasticity, REGR_INTERCEPT(y, x) AS intercept,
     REGR_R2(y, x) AS r2, COUNT(*) AS n FROM (SELECT category, LN(actual_price) AS x, LN(monthly_sales) AS y
      FROM sales WHERE actual_price > 0 AND monthly_sales > 0) GROUP BY category"""
    wide = ", ".join(
        f"SUM(CASE WHEN category = '{c}' THEN monthly_sales ELSE 0 END) AS \"{c}\""
        for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )
    return {
        "pearson_matrix": _sql("sales", _matrix("{}", "sales"), "corr"),
        "spearman_matrix": _spearman(""),
        "spearman_matrix_average": _spearman("+ (COUNT(*) OVER (PARTITION BY {0}) - 1) / 2.0"),
        "price_elasticity": _sql("sales", elasticity, "elasticity intercept r2"),
        "elasticity_class": _sql("sales", f"""SELECT category, elasticity, CASE WHEN elasticity < -1 THEN 'elastic'
            WHEN elasticity < 0 THEN 'negative' ELSE 'non-negative' END AS elasticity_class
            FROM ({elasticity})""", "elasticity"),
        "rating_sales_corr_by_city": _sql("sales", corr.format("city", " HAVING COUNT(*) >= 30"), grouped),
        "rating_sales_corr_by_category": _sql("sales", corr.format("category", ""), grouped),
        "hhi_overall": _sql("sales", """SELECT SUM(POWER(ss / total, 2)) * 10000 AS hhi,
            SUM(CASE WHEN rn <= 10 THEN ss / total END) AS cr10, SUM(CASE WHEN rn <= 5 THEN ss / total END) AS cr5,
            COUNT(*) AS institution_count, MAX(total) AS total_sales
            FROM (SELECT *, SUM(ss) OVER () AS total, ROW_NUMBER() OVER (ORDER BY ss DESC, institution) AS rn
             FROM (SELECT institution, SUM(monthly_sales) AS ss FROM sales GROUP BY 1))""",
            "hhi cr10 cr5 total_sales"),
        "hhi_by_city": _sql("sales", f"SELECT *, {_LEVEL} AS concentration_level FROM ({_hhi('city')})",
                            "hhi cr10 total_sales"),
        "hhi_by_category": _sql("sales", f"SELECT * EXCLUDE (total_sales) FROM ({_hhi('category')})", "hhi cr10"),
        "concentration_class": _sql(
            "sales", f"SELECT city, hhi, {_LEVEL} AS concentration_class FROM ({_hhi('city')})", "hhi"),
        "pareto_projects": _sql("sales", _PARETO, "total_sales cum_sales cum_share project_share"),
        "pareto_breakpoints": _sql("sales", f"WITH p AS ({_PARETO}) {_PARETO_BREAKS}",
                                   "cum_share_threshold project_share"),
        "pareto_sample": _sql("sales", f"WITH p AS ({_PARETO}) {_PARETO_SAMPLE}",
                              "total_sales cum_sales cum_share project_share"),
        "pareto_points": _sql("sales", f"""WITH p AS ({_PARETO})
            SELECT 'point' AS kind, rn, ROUND(project_share * 100, 2) AS project_pct,
             ROUND(cum_share * 100, 2) AS cum_pct FROM ({_PARETO_SAMPLE})
            UNION ALL SELECT 'mark', rn, ROUND(project_share * 100, 2), ROUND(cum_share_threshold * 100, 2)
            FROM ({_PARETO_BREAKS})""", "project_pct cum_pct"),
        "city_category_matrix": _sql("sales", f"SELECT city, {wide} FROM sales GROUP BY city"),
        "city_similarity": _sql("sales", f"{_UNIT} {_SIMILARITY}", "similarity"),
        "city_similarity_top": _sql("sales", f"""{_UNIT} SELECT * FROM (SELECT city_a AS city, ROW_NUMBER() OVER
            (PARTITION BY city_a ORDER BY similarity DESC, city_b) AS rn, city_b AS similar_city, similarity
            FROM ({_SIMILARITY}) WHERE city_a <> city_b) WHERE rn <= 5""", "similarity"),
        "price_baseline": _sql(
            "sales", "SELECT AVG(actual_price) AS mu, STDDEV_POP(actual_price) AS sd FROM sales", "mu sd"),
        "compliance_metrics": _sql("sales", f"SELECT {_METRICS}", _RATES),
        "institution_risk": _sql("sales", _RISK, f"{_RATES} risk_score"),
        "institution_risk_top": _sql(
            "sales", f"SELECT * FROM ({_RISK}) ORDER BY risk_rank, institution LIMIT 50", f"{_RATES} risk_score"),
        "institution_risk_bottom": _sql("sales", f"""WITH r AS ({_RISK}) SELECT * FROM r
            WHERE (SELECT COUNT(*) FROM r) >= 10 ORDER BY risk_rank DESC, institution DESC LIMIT 10""",
            f"{_RATES} risk_score"),
        "institution_risk_distribution": _sql("sales", f"""SELECT risk_level, COUNT(*) AS "count",
            CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS institution_count_total FROM ({_RISK}) GROUP BY risk_level"""),
        "category_risk": _sql("sales", f"SELECT category, {_METRICS} GROUP BY category", _RATES),
        "city_risk": _sql("sales", f"SELECT city, {_METRICS} GROUP BY city", _RATES),
    }


# -- sources, cleaning, views ------------------------------------------------------

_DISTINCT = """SELECT DISTINCT *, COALESCE(STRFTIME(collection_date, '%Y-%m'), '未知') AS stats_month
FROM (SELECT city, category, institution, district, list_price, monthly_sales, collection_date FROM typed)"""


def _inside(column: str, source: str) -> str:
    quartiles = f"(SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"
    return f"""SELECT t.* FROM {source} t CROSS JOIN {quartiles} q
     WHERE q3 <= q1 OR {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


def _all_columns() -> dict[str, str]:
    """Cleaning over all columns; outliers go column by column, each from what the last one left."""
    numbers = " ".join(_NUMBERS)

    def filled(source: str, labels: bool) -> str:
        values = [f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM {source})) AS {c}" for c in _NUMBERS]
        values += [f"COALESCE({c}, '未知') AS {c}" for c in _LABELLED if labels]
        return f"SELECT * REPLACE ({', '.join(values)}) FROM {source}"

    def inside(source: str) -> str:
        steps, last = [], source
        for i, c in enumerate(_NUMBERS):
            steps.append(f"q{i} AS ({_inside(c, last)})")
            last = f"q{i}"
        return f"{', '.join(steps)} SELECT * FROM {last}"

    month = "COALESCE(STRFTIME(collection_date, '%Y-%m'), '未知') AS stats_month"
    return {
        "coerce_all_columns": _sql("wide", "SELECT * FROM wide", numbers),
        "fill_median_all_columns": _sql("wide", filled("wide", labels=False), numbers),
        "remove_outliers_all_columns": _sql("wide", f"WITH {inside('wide')}", numbers),
        "clean_all_columns": _sql("wide", f"""WITH u AS (SELECT DISTINCT *, {month} FROM wide),
            f AS ({filled('u', labels=True)}), {inside('f')}""", numbers),
    }


def _preparation() -> dict[str, str]:
    dirty = "SELECT city, list_price, monthly_sales FROM typed"
    filled = """SELECT * REPLACE (
      COALESCE(list_price, (SELECT quantile_cont(list_price, 0.5) FROM u)) AS list_price,
      COALESCE(monthly_sales, (SELECT quantile_cont(monthly_sales, 0.5) FROM u)) AS monthly_sales{0}) FROM u"""
    month = "COALESCE(STRFTIME(collection_date, '%Y-%m'), '未知')"
    numbers = "list_price monthly_sales"
    z = ", ".join(f"(s.{f} - a.m_{f}) / a.d_{f} AS {f}" for f in _FEATURES)
    moments = ", ".join(f"AVG({f}) AS m_{f}, STDDEV_SAMP({f}) AS d_{f}" for f in _FEATURES)
    gap = " + ".join(f"POWER((s.{f} - c.{f}) / a.d_{f}, 2)" for f in _FEATURES)
    centers = ", ".join(f"AVG({f}) AS {f}" for f in _FEATURES)
    cut = [k for k in _TREND if not k.startswith("cluster")]
    centers_given = f"""WITH c AS (SELECT {centers} FROM segments GROUP BY cluster), a AS (SELECT {moments} FROM segments),
        g AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY list_price) - 1 AS INTEGER) AS cluster, c.*,
         {', '.join(f'(c.{f} - a.m_{f}) / a.d_{f} AS z_{f}' for f in _FEATURES)} FROM c CROSS JOIN a)"""
    return {
        "scan_csv": _sql("wide", "SELECT * REPLACE (NULLIF(approval_no, '') AS approval_no) FROM wide", " ".join(_NUMBERS)),
        "scan_csv_records": """SELECT o_orderkey, o_orderstatus || chr(10) || 'say "城", ' || o_orderpriority || chr(10) AS note,
            CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS cust FROM orders""",
        "charset_fallback": _sql("sales", """SELECT city, NULLIF(approval_no, '') AS approval_no,
            COUNT(*) AS "count", 'GB18030' AS encoding_used FROM sales GROUP BY 1, 2"""),
        "scan_parquet": "SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, "
                        "l_returnflag FROM lineitem",
        "sink_parquet": _sql("sales", "SELECT * FROM sales",
                             " ".join([*_FEATURES, "installment", "udi_match", "new_customer"])),
        "emit_table": _sql("segments", _CITY_RANK, _AVERAGES),
        "sink_json_snapshot": _trend("by_city"),
        "sink_csv_export": _trend("top_projects"),
        "insights_manifest": _sql("segments", """
            SELECT 'cluster_city_rank' AS "table", COUNT(DISTINCT (cluster, city)) AS row_cnt, 3 AS k FROM segments
            UNION ALL SELECT 'cluster_channel_efficiency', COUNT(DISTINCT (cluster, channel)), 3 FROM segments"""),
        "build_warehouse": _sql("segments", " UNION ALL ".join(
            f"""SELECT '{name}' AS "table", COUNT(*) AS row_cnt, 3 AS k FROM ({body})"""
            for name, body in [
                ("cluster_profile", _PROFILE), ("cluster_city_rank", _CITY_RANK),
                ("cluster_category_preference", _PREFERENCE), ("cluster_channel_efficiency", _CHANNEL),
                ("cluster_price_band", _BANDS), ("cluster_top_projects", _TOP_PROJECTS),
                ("cluster_doctor_matching", _DOCTORS), ("cluster_month_delta", _MONTHS),
            ])),
        "advanced_report": _sql("sales", " UNION ALL ".join(
            f"""SELECT '{name}' AS "table", {count} AS row_cnt FROM {source}"""
            for name, count, source in [
                ("stat_pearson", "CAST(36 AS BIGINT)", "(SELECT 1)"),
                ("stat_spearman", "CAST(36 AS BIGINT)", "(SELECT 1)"),
                ("stat_price_elasticity", "COUNT(DISTINCT category)",
                 "sales WHERE actual_price > 0 AND monthly_sales > 0"),
                ("stat_rating_sales_by_city", "COUNT(*)",
                 "(SELECT city FROM sales GROUP BY city HAVING COUNT(*) >= 30)"),
                ("stat_rating_sales_by_category", "COUNT(DISTINCT category)", "sales"),
                ("struct_hhi_overall", "CAST(1 AS BIGINT)", "(SELECT 1)"),
                ("struct_hhi_by_city", "COUNT(DISTINCT city)", "sales"),
                ("struct_hhi_by_category", "COUNT(DISTINCT category)", "sales"),
                ("struct_pareto_projects", "COUNT(DISTINCT project_name)", "sales"),
                ("struct_city_similarity_top", "COUNT(DISTINCT city)", "sales"),
                ("comp_institution_risk", "COUNT(*)",
                 "(SELECT institution FROM sales GROUP BY 1 HAVING COUNT(*) >= 5)"),
                ("comp_category_risk", "COUNT(DISTINCT category)", "sales"),
                ("comp_city_risk", "COUNT(DISTINCT city)", "sales"),
            ])),
        "standardize_columns": _sql(
            "sales", "SELECT city AS town, category AS kind, CAST(NULL AS VARCHAR) AS spare FROM sales"),
        "coerce_numeric": _sql("typed", dirty, numbers),
        "parse_dates": _sql("typed", "SELECT city, collection_date FROM typed"),
        "derive_stats_month": _sql("typed", f"SELECT city, {month} AS stats_month FROM typed"),
        "drop_duplicates": _sql("typed", """SELECT DISTINCT city, list_price, monthly_sales, institution,
            collection_date FROM typed""", numbers),
        "fill_median": _sql("typed", f"WITH u AS ({dirty}) {filled.format('')}", numbers),
        "fill_unknown": _sql("typed", "SELECT city, COALESCE(district, '未知') AS district FROM typed"),
        "remove_outliers_iqr": _sql("typed", f"""WITH u AS ({dirty}), a AS ({_inside('list_price', 'u')})
            {_inside('monthly_sales', 'a')}""", numbers),
        "remove_outliers_simultaneous": _sql("typed", f"""WITH u AS ({dirty}),
            q AS (SELECT quantile_cont(list_price, 0.25) AS a1, quantile_cont(list_price, 0.75) AS a3,
             quantile_cont(monthly_sales, 0.25) AS b1, quantile_cont(monthly_sales, 0.75) AS b3 FROM u)
            SELECT u.* FROM u CROSS JOIN q WHERE list_price BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1)
             AND monthly_sales BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)""", numbers),
        "split_single_month": _sql("sales", """SELECT institution, project_name, city, list_price, doctor_name,
            CASE WHEN ROW_NUMBER() OVER (ORDER BY institution, project_name, city, list_price, doctor_name)
             <= COUNT(*) OVER () // 2 THEN '1998-05' ELSE '1998-06' END AS stats_month
            FROM sales""", "list_price"),
        **_all_columns(),
        "clean": _sql("typed", f"""WITH u AS ({_DISTINCT}),
            f AS ({filled.format(", COALESCE(district, '未知') AS district")}),
            a AS ({_inside('list_price', 'f')}) {_inside('monthly_sales', 'a')}""", numbers),
        "cast_numeric_cols": _sql("typed", "SELECT city, monthly_sales FROM typed", "monthly_sales"),
        "drop_null_features": _sql(
            "typed", f"{dirty} WHERE list_price IS NOT NULL AND monthly_sales IS NOT NULL", numbers),
        "validate_storage": _sql("sales", """SELECT 'local' AS mode, '' AS parquet_path, COUNT(*) AS "rows",
            CAST(4 AS BIGINT) AS "columns", '' AS missing_required_columns, TRUE AS has_stats_month_col FROM sales"""),
        "month_distribution": _sql(
            "typed", f"SELECT {month} AS stats_month, COUNT(*) AS row_cnt FROM typed GROUP BY 1"),
        "standardize_features": _sql(
            "sales", f"SELECT {z} FROM sales s CROSS JOIN (SELECT {moments} FROM sales) a", " ".join(_FEATURES)),
        "assign_nearest_center": _sql("segments", f"""SELECT {', '.join('s.' + f for f in _FEATURES)},
            CAST(CASE WHEN g0 <= g1 AND g0 <= g2 THEN 0 WHEN g1 <= g2 THEN 1 ELSE 2 END AS INTEGER) AS cluster
            FROM (SELECT s.*, {', '.join(gap.replace('c.', f'c{i}.') + f' AS g{i}' for i in range(3))}
             FROM sales s CROSS JOIN (SELECT {moments} FROM sales) a
             {' '.join(f'CROSS JOIN (SELECT {centers} FROM segments WHERE cluster = {i}) c{i}' for i in range(3))}
            ) s""", " ".join(_FEATURES)),
        "cluster_centers_given": _sql("segments", f"""{centers_given}
            {' UNION ALL '.join(f"SELECT cluster, '{f}' AS feature, z_{f} AS center, {f} AS center_original FROM g" for f in _FEATURES)}""",
            "center center_original"),
        "centers_table_given": _sql("segments", f"""{centers_given}
            SELECT cluster, {', '.join(f'z_{f} AS {f}' for f in _FEATURES)} FROM g""", " ".join(_FEATURES)),
        "assemble_features_given": _sql("sales", f"SELECT {', '.join(_FEATURES)} FROM sales", " ".join(_FEATURES)),
        "trend_report": _trend_report(list(_TREND)),
        "analytics_for_month": _trend_report(cut, "WHERE stats_month = '1998-06'"),
        "month_options": _sql("sales", "SELECT stats_month, COUNT(*) AS row_cnt FROM sales "
                              "WHERE stats_month NOT IN ('', '未知') GROUP BY 1"),
        "overview_kpis": _sql("sales", """SELECT COUNT(*) AS row_cnt, SUM(monthly_sales) AS total_sales,
            AVG(rating) AS avg_rating, AVG(actual_price) AS avg_actual_price, AVG(list_price) AS avg_list_price,
            AVG(discount_rate) AS avg_discount, AVG(review_count) AS avg_review_count,
            COUNT(DISTINCT city) AS city_count, COUNT(DISTINCT category) AS category_count,
            COUNT(DISTINCT channel) AS channel_count FROM sales""",
            "total_sales avg_rating avg_actual_price avg_list_price avg_discount avg_review_count"),
        "all_cities": _trend("by_city").replace("LIMIT 30", ""),
        "top_n_cities": _trend("by_city").replace("LIMIT 30", "LIMIT 15"),
    }


def build() -> dict[str, str]:
    known = {**{n: _trend(n) for n in _TREND}, **_themes(), **_analysis(), **_preparation()}
    for name in ("spearman_matrix", "pareto_projects", "institution_risk"):
        known[f"{name}_sliced"] = known[name]
    for name in ("trend_report", "cluster_doctor_matching"):
        known[f"{name}_by_months"] = known[name]
    known["remove_outliers_iqr_narrowed"] = known["remove_outliers_iqr"]
    return known
