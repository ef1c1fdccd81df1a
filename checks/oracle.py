"""SQL (DuckDB dialect) that each registered query is compared with.

Written independently of the Spark plans: plain joins, plain ``ntile`` and one statement per
result, over the same mapping of the generic tables to the star schema.
"""

from __future__ import annotations

from checks.brief_documents import BRIEF_DOCUMENT

# Fixed values, stated here again so that a wrong one in the library shows.
INPUT_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
MIN_ORDERS = 60
SAMPLE_SIZE, SAMPLE_SEED = 3000, 42
REQUIRED_KEYS = ["actions", "caveat", "findings", "headline", "risks", "status", "summary"]
STATUSES = ("Strong", "Stable", "Watch closely", "At risk")
FINDINGS, ACTIONS = 3, 3
TITLE = "# Stakeholder Brief — "
DEFAULT_CAVEAT = "These figures describe the selected data and filters; they do not establish causation."

# Building blocks: name -> SQL. A query pulls in the blocks it names, in this order.
BLOCKS = {
    "items": """
        SELECT l.*, o.*, p.p_name,
               o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS pts,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(l_tax AS DECIMAL(4,2)) AS tax,
               l_quantity < 50 AS arrived
        FROM lineitem l
        JOIN orders o ON o_orderkey = l_orderkey
        LEFT JOIN part p ON p_partkey = l_partkey
        WHERE o_orderstatus = 'F'""",
    "buyers": """
        SELECT c_custkey, 'CU' || CAST(c_custkey - c_custkey % 2 AS VARCHAR) AS uid, c_mktsegment, n_name
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "shops": """
        SELECT s_suppkey, r_name, n_name
        FROM supplier
        LEFT JOIN nation ON n_nationkey = s_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "f": """
        SELECT o_orderkey AS order_id, l_linenumber AS order_item_id, o_custkey AS customer_id,
               uid AS customer_unique_id, c_mktsegment AS customer_city, b.n_name AS customer_state,
               l_partkey AS product_id, l_suppkey AS seller_id, 'delivered' AS order_status,
               pts AS order_purchase_timestamp, pts + INTERVAL 1 HOUR AS order_approved_at,
               pts + INTERVAL 1 DAY AS order_delivered_carrier_date,
               CASE WHEN arrived THEN pts + to_days(CAST(l_quantity AS INTEGER)) END AS order_delivered_customer_date,
               pts + INTERVAL 45 DAY AS order_estimated_delivery_date,
               CAST(pts AS DATE) AS purchase_date,
               CAST(year(pts) AS INTEGER) AS purchase_year, CAST(month(pts) AS INTEGER) AS purchase_month,
               strftime(pts, '%Y-%m') AS year_month,
               CAST(date_trunc('month', pts) AS DATE) AS purchase_month_date,
               price, CAST(price * tax AS DECIMAL(18,4)) AS freight_value,
               CAST(price * (1 + tax) AS DECIMAL(18,4)) AS total_item_value,
               CASE WHEN arrived THEN CAST(l_quantity AS INTEGER) END AS delivery_days,
               CASE WHEN NOT arrived THEN NULL WHEN l_quantity <= 45 THEN 'On Time' ELSE 'Late' END AS delivery_status,
               CASE WHEN arrived THEN CAST(l_quantity AS INTEGER) - 45 END AS days_vs_estimate,
               CAST(CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 5 WHEN '3' THEN 4 WHEN '5' THEN 2 END
                    AS DOUBLE) AS review_score,
               p_name AS product_category_english,
               CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher'
                    ELSE 'debit_card' END AS primary_payment_type,
               CAST(1 + o_orderkey % 10 AS INTEGER) AS max_installments,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_payment_value,
               r_name AS seller_city, s.n_name AS seller_state
        FROM items
        LEFT JOIN buyers b ON c_custkey = o_custkey
        LEFT JOIN shops s ON s_suppkey = l_suppkey""",
    "metrics": """
        SELECT uid AS customer_unique_id, count(DISTINCT order_id) AS total_orders, sum(v) AS total_revenue,
               CAST(sum(v) AS DOUBLE) / count(v) AS avg_order_value,
               min(ts) AS first_order_date, max(ts) AS last_order_date,
               CAST(extract(day FROM max(ts) - min(ts)) AS BIGINT) AS customer_lifetime_days,
               CAST(extract(day FROM (SELECT max(order_purchase_timestamp) FROM f) - max(ts)) AS BIGINT) AS recency_days
        FROM (SELECT customer_unique_id AS uid, order_id, order_purchase_timestamp AS ts, sum(total_item_value) AS v
              FROM f WHERE customer_unique_id IS NOT NULL GROUP BY ALL)
        GROUP BY uid""",
    "scored": """
        SELECT customer_unique_id, total_orders, total_revenue, avg_order_value, recency_days,
               first_order_date, last_order_date,
               CAST(ntile(5) OVER (ORDER BY recency_days ASC NULLS LAST, customer_unique_id) AS INTEGER) AS r_score,
               CAST(ntile(5) OVER (ORDER BY total_orders DESC NULLS FIRST, customer_unique_id) AS INTEGER) AS f_score,
               CAST(ntile(5) OVER (ORDER BY total_revenue DESC NULLS FIRST, customer_unique_id) AS INTEGER) AS m_score
        FROM metrics""",
    "turned": """
        SELECT * REPLACE (6 - r_score AS r_score, 6 - f_score AS f_score, 6 - m_score AS m_score) FROM scored""",
    "visits": """
        SELECT DISTINCT customer_unique_id AS uid, purchase_month_date AS m FROM f
        WHERE customer_unique_id IS NOT NULL""",
    "starts": "SELECT uid, min(m) AS start FROM visits GROUP BY uid",
    "cohorts": """
        SELECT start AS cohort_month, CAST(date_diff('month', start, m) AS INTEGER) AS month_number,
               count(DISTINCT uid) AS active_customers, any_value(size) AS cohort_size,
               floor((20000 * count(DISTINCT uid) + any_value(size)) / (2 * any_value(size))) / 100 AS retention_rate
        FROM visits JOIN starts USING (uid)
        JOIN (SELECT start, count(*) AS size FROM starts GROUP BY start) USING (start)
        GROUP BY start, m""",
    "orders_of_month": """
        SELECT purchase_month_date AS m, year_month AS ym, order_id, max(customer_unique_id) AS uid,
               sum(total_item_value) AS v, sum(price) AS pv, sum(freight_value) AS fv,
               avg(review_score) AS rs, avg(delivery_days) AS dd,
               bool_and(delivery_status = 'On Time') AS ok
        FROM f GROUP BY ALL""",
    "monthly": """
        SELECT m AS purchase_month, ym AS year_month, count(*) AS total_orders,
               count(DISTINCT uid) AS unique_customers, sum(v) AS gmv,
               CAST(sum(v) AS DOUBLE) / count(*) AS aov, sum(pv) AS product_revenue, sum(fv) AS freight_revenue,
               avg(rs) AS avg_review_score, avg(dd) AS avg_delivery_days,
               avg(CASE WHEN ok THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS on_time_pct
        FROM orders_of_month GROUP BY m, ym""",
    "eligible": f"SELECT * FROM monthly WHERE total_orders >= {MIN_ORDERS}",
    "products": """
        SELECT product_category_english AS category, count(DISTINCT order_id) AS orders, count(*) AS items_sold,
               sum(price) AS revenue, sum(freight_value) AS total_freight,
               CAST(sum(price) AS DOUBLE) / count(price) AS avg_price, avg(review_score) AS avg_rating,
               count(DISTINCT customer_unique_id) AS unique_buyers
        FROM f WHERE product_category_english IS NOT NULL GROUP BY product_category_english""",
    "ranked_products": """
        SELECT *, row_number() OVER (ORDER BY revenue DESC NULLS FIRST, category NULLS LAST) AS place
        FROM products""",
    "sellers": """
        SELECT seller_id, seller_city, seller_state, count(DISTINCT order_id) AS orders_fulfilled,
               count(*) AS items_sold, sum(price) AS revenue, avg(review_score) AS avg_rating,
               avg(delivery_days) AS avg_delivery_days,
               count(CASE WHEN delivery_status = 'On Time' THEN 1 END) * 100.0::DOUBLE / count(*) AS on_time_pct
        FROM f GROUP BY seller_id, seller_city, seller_state""",
    "ranked_sellers": """
        SELECT *, row_number() OVER (ORDER BY revenue DESC NULLS FIRST, seller_id NULLS LAST,
                                     seller_city NULLS LAST, seller_state NULLS LAST) AS place
        FROM sellers""",
    "loaded_sellers": """
        SELECT *, coalesce(on_time_pct < 90, false) OR coalesce(avg_rating < 4, false) AS needs_review
        FROM ranked_sellers WHERE place <= 50""",
    "listed_sellers": """
        SELECT * FROM loaded_sellers WHERE needs_review
        QUALIFY row_number() OVER (ORDER BY place) <= 20""",
    "states": """
        SELECT customer_state, count(DISTINCT order_id) AS orders, count(DISTINCT customer_unique_id) AS customers,
               sum(total_item_value) AS gmv,
               CAST(sum(total_item_value) AS DOUBLE) / count(total_item_value) AS aov,
               avg(delivery_days) AS avg_delivery_days, avg(review_score) AS avg_rating,
               count(CASE WHEN delivery_status = 'On Time' THEN 1 END) * 100.0::DOUBLE / count(*) AS on_time_pct
        FROM f WHERE customer_state IS NOT NULL GROUP BY customer_state""",
    "split": """
        SELECT purchase_month_date AS purchase_month,
               CASE WHEN purchase_month_date = start THEN 'New' ELSE 'Returning' END AS customer_type,
               count(DISTINCT customer_unique_id) AS customers, count(*) AS items, sum(total_item_value) AS revenue
        FROM f JOIN starts ON uid = customer_unique_id GROUP BY 1, 2""",
    "pay": """
        SELECT user_id AS order_id, event_type AS payment_type,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS payment_installments,
               CAST(value AS DECIMAL(12,2)) AS payment_value
        FROM events""",
    "paid": """
        SELECT order_id, arg_max(payment_type, rank) AS primary_payment_type,
               max(installments) AS max_installments, CAST(sum(v) AS DECIMAL(12,2)) AS total_payment_value,
               CAST(sum(n) AS BIGINT) AS payments
        FROM (SELECT *, -row_number() OVER (PARTITION BY order_id ORDER BY v DESC, payment_type) AS rank
              FROM (SELECT order_id, payment_type, sum(payment_value) AS v, max(payment_installments) AS installments,
                           count(*) AS n
                    FROM pay GROUP BY order_id, payment_type))
        GROUP BY order_id""",
    "rated": """
        SELECT user_id AS order_id, avg(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS avg_review_score,
               count(*) AS reviews
        FROM events WHERE event_type = 'view' GROUP BY user_id""",
    "docs": f"SELECT seller_id, {BRIEF_DOCUMENT} AS document FROM sellers",
    "read": """
        SELECT seller_id, CASE WHEN json_type(TRY_CAST(document AS JSON)) = 'OBJECT'
                               THEN TRY_CAST(document AS JSON) END AS j
        FROM docs""",
    "judged": f"""
        SELECT *, CASE WHEN j IS NULL THEN 'malformed_json' WHEN len(gaps) > 0 THEN 'missing_keys'
                       WHEN j->>'status' IS NULL OR j->>'status' NOT IN {STATUSES!r} THEN 'invalid_status'
                       WHEN nf <> {FINDINGS} THEN 'findings_count' WHEN na <> {ACTIONS} THEN 'actions_count'
                       WHEN nr NOT IN (1, 2) THEN 'risks_count' END AS error
        FROM (SELECT *, [k FOR k IN {REQUIRED_KEYS!r} IF NOT list_contains(json_keys(j), k)] AS gaps,
                     json_array_length(j->'findings') AS nf, json_array_length(j->'actions') AS na,
                     json_array_length(j->'risks') AS nr
              FROM read)""",
    "actions_in_order": """
        SELECT seller_id, i, a,
               row_number() OVER (PARTITION BY seller_id ORDER BY coalesce(TRY_CAST(a->>'priority' AS DOUBLE), 99), i) AS place
        FROM (SELECT seller_id, unnest(range(0, CAST(json_array_length(j->'actions') AS BIGINT))) AS i,
                     unnest(CAST(j->'actions' AS JSON[])) AS a
              FROM read)""",
}

# Which blocks each block builds on.
_USES = {
    "f": ["items", "buyers", "shops"],
    "metrics": ["f"],
    "scored": ["metrics"],
    "turned": ["scored"],
    "visits": ["f"],
    "starts": ["visits"],
    "cohorts": ["starts"],
    "orders_of_month": ["f"],
    "monthly": ["orders_of_month"],
    "eligible": ["monthly"],
    "products": ["f"],
    "ranked_products": ["products"],
    "sellers": ["f"],
    "ranked_sellers": ["sellers"],
    "loaded_sellers": ["ranked_sellers"],
    "listed_sellers": ["loaded_sellers"],
    "states": ["f"],
    "split": ["starts"],
    "paid": ["pay"],
    "docs": ["sellers"],
    "read": ["docs"],
    "judged": ["read"],
    "actions_in_order": ["read"],
}


def _rounded(sql: str, digits: dict[str, int]) -> str:
    shown = ", ".join(f"round({c}, {n}) AS {c}" for c, n in digits.items())
    return f"SELECT * REPLACE ({shown}) FROM ({sql})"


def _with(blocks: list[str], body: str) -> str:
    needed, todo = set(), list(blocks)
    while todo:
        block = todo.pop()
        if block not in needed:
            needed.add(block)
            todo += _USES.get(block, [])
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in BLOCKS.items() if name in needed)
    return f"WITH {ctes}\n{body}"


def _segment(r: str = "r_score", f: str = "f_score", m: str = "m_score") -> str:
    return f"""CASE WHEN least({r}, {f}, {m}) >= 4 THEN 'Champions' WHEN least({r}, {f}, {m}) = 3 THEN 'Loyal Customers'
        WHEN {r} > 3 AND {f} < 3 THEN 'Promising / New' WHEN {r} < 3 AND least({f}, {m}) > 2 THEN 'At Risk'
        WHEN {r} < 3 AND {f} < 3 THEN 'Lost / Hibernating' WHEN {m} > 3 THEN 'Big Spenders' ELSE 'Need Attention' END"""


def _status(*checks: str) -> str:
    """Health status from conditions that may be NULL."""
    made = " + ".join(f"CAST(({c}) IS NOT NULL AS INTEGER)" for c in checks)
    met = " + ".join(f"coalesce(CAST(({c}) AS INTEGER), 0)" for c in checks)
    return f"""CASE WHEN {made} = 0 THEN 'Stable' WHEN ({met}) * 100 >= 80 * ({made}) THEN 'Strong'
        WHEN ({met}) * 100 >= 50 * ({made}) THEN 'Stable' WHEN ({met}) * 100 >= 25 * ({made}) THEN 'Watch closely'
        ELSE 'At risk' END"""


_RFM = "customer_unique_id, total_orders, CAST(total_revenue AS DOUBLE) AS total_revenue, avg_order_value, \
recency_days, first_order_date, last_order_date, r_score, f_score, m_score, \
r_score + f_score + m_score AS rfm_total"
_FACT = "* REPLACE (CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value, \
CAST(total_item_value AS DOUBLE) AS total_item_value, CAST(total_payment_value AS DOUBLE) AS total_payment_value)"
_MONTHLY = "purchase_month, year_month, total_orders, unique_customers, CAST(gmv AS DOUBLE) AS gmv, \
round(aov, 6) AS aov, CAST(product_revenue AS DOUBLE) AS product_revenue, \
CAST(freight_revenue AS DOUBLE) AS freight_revenue, round(avg_review_score, 6) AS avg_review_score, \
round(avg_delivery_days, 6) AS avg_delivery_days, round(on_time_pct, 6) AS on_time_pct"
_SELLERS = "seller_id, seller_city, seller_state, orders_fulfilled, items_sold, \
CAST(revenue AS DOUBLE) AS revenue, avg_rating, avg_delivery_days, on_time_pct"
_PRODUCTS = "category, orders, items_sold, CAST(revenue AS DOUBLE) AS revenue, \
CAST(total_freight AS DOUBLE) AS total_freight, avg_price, avg_rating, unique_buyers"
_COUNT = "(SELECT count(DISTINCT customer_unique_id) FROM f)"
_WEIGHTED_ON_TIME = "round(sum(on_time_pct * total_orders) / sum(total_orders), 6)"
_GMV_SERIES = "SELECT *, lag(gmv) OVER (ORDER BY purchase_month NULLS LAST, year_month NULLS LAST) AS previous FROM eligible"
_CHANGE = "round(CAST(gmv - previous AS DOUBLE) / nullif(CAST(previous AS DOUBLE), 0) * 100, 6)"
_SEGMENTED = f"(SELECT {_segment()} AS rfm_segment, * FROM scored)"
_SUMMARY = f"""(SELECT rfm_segment, count(*) AS customers, sum(total_revenue) AS total_revenue,
    CAST(sum(total_revenue) AS DOUBLE) / count(*) AS avg_revenue, avg(total_orders) AS avg_orders,
    CAST(sum(total_revenue) AS DOUBLE) / CAST(sum(sum(total_revenue)) OVER () AS DOUBLE) * 100 AS share
    FROM {_SEGMENTED} GROUP BY rfm_segment)"""
_ON_TIME_MET, _RATING_MET = "on_time_pct >= 90", "avg_rating >= 4"


def _object(value: str) -> str:
    return f"""'{{' || string_agg('"' || rfm_segment || '":' || CAST({value} AS VARCHAR), ',' ORDER BY rfm_segment) || '}}'"""


def _lines(items: str, template: str) -> str:
    return f"list_transform(CAST({items} AS JSON[]), lambda x: {template})"


_MARKDOWN = f"""
    SELECT seller_id, array_to_string(
        ['{TITLE}Seller ' || CAST(seller_id AS VARCHAR), '', '**Audience:** Operations', '**Status:** Stable', '',
         '## Conclusion', j->>'headline', '', '## Summary', j->>'summary', '', '## Findings']
        || {_lines("j->'findings'", "'- **' || (x->>'number') || ' — ' || (x->>'label') || ':** ' || (x->>'detail')")}
        || ['', '## Risks'] || {_lines("j->'risks'", "'- ' || (x->>'$')")}
        || ['', '## Prioritised Actions']
        || (SELECT list(coalesce(a->>'priority', '') || '. **' || (a->>'action') || '**' || chr(10) || '   - Reason: '
                        || (a->>'reason') || chr(10) || '   - Expected impact: ' || (a->>'expected_impact') ORDER BY place)
            FROM actions_in_order o WHERE o.seller_id = judged.seller_id)
        || ['', '## Caveat', coalesce(j->>'caveat', '{DEFAULT_CAVEAT}')], chr(10)) AS markdown
    FROM judged WHERE error IS NULL"""

ORACLE_SQL: dict[str, str] = {
    "order_fact": _with(["f"], f"SELECT {_FACT} FROM f"),
    "customer_metrics": _with(
        ["metrics"], "SELECT * REPLACE (CAST(total_revenue AS DOUBLE) AS total_revenue) FROM metrics"
    ),
    "rfm_segments": _with(["scored"], f"SELECT {_RFM}, {_segment()} AS rfm_segment FROM scored"),
    "rfm_segments_distributed": _with(["scored"], f"SELECT {_RFM}, {_segment()} AS rfm_segment FROM scored"),
    "rfm_segments_searched": _with(["scored"], f"SELECT {_RFM}, {_segment()} AS rfm_segment FROM scored"),
    "rfm_segments_high_is_good": _with(["turned"], f"SELECT {_RFM}, {_segment()} AS rfm_segment FROM turned"),
    "cohort_retention": _with(["cohorts"], "SELECT * FROM cohorts"),
    "monthly_kpis": _with(["monthly"], f"SELECT {_MONTHLY} FROM monthly"),
    "product_performance": _with(["products"], f"SELECT {_PRODUCTS} FROM products"),
    "seller_performance": _with(["sellers"], f"SELECT {_SELLERS} FROM sellers"),
    "state_performance": _with(["states"], "SELECT * REPLACE (CAST(gmv AS DOUBLE) AS gmv) FROM states"),
    "new_vs_returning": _with(["split"], "SELECT * REPLACE (CAST(revenue AS DOUBLE) AS revenue) FROM split"),
    "payment_analysis": _with(
        ["pay"],
        """SELECT payment_type, count(DISTINCT order_id) AS orders, avg(payment_installments) AS avg_installments,
           CAST(sum(payment_value) AS DOUBLE) AS total_paid,
           CAST(sum(payment_value) AS DOUBLE) / count(payment_value) AS avg_payment
           FROM pay GROUP BY payment_type""",
    ),
    "data_quality": _with(
        ["f"],
        """SELECT 'Total delivered order items' AS metric, CAST(count(*) AS VARCHAR) AS value FROM f
           UNION ALL SELECT 'Unique customers', CAST(count(DISTINCT customer_unique_id) AS VARCHAR) FROM f
           UNION ALL SELECT 'Date range start', CAST(min(order_purchase_timestamp) AS VARCHAR) FROM f
           UNION ALL SELECT 'Date range end', CAST(max(order_purchase_timestamp) AS VARCHAR) FROM f
           UNION ALL SELECT 'Categories with data', CAST(count(DISTINCT product_category_english) AS VARCHAR) FROM f""",
    ),
    "eligible_months": _with(["eligible"], f"SELECT {_MONTHLY} FROM eligible"),
    "eligible_months_by_sql": _with(["eligible"], f"SELECT {_MONTHLY} FROM eligible ORDER BY purchase_month"),
    "gmv_mom_change": _with(
        ["eligible"],
        f"""SELECT purchase_month, year_month, CAST(gmv AS DOUBLE) AS gmv, CAST(previous AS DOUBLE) AS previous_gmv,
            {_CHANGE} AS gmv_change_pct FROM ({_GMV_SERIES})""",
    ),
    "executive_kpis": _with(
        ["eligible"],
        f"""SELECT *, {_status("weighted_on_time_pct >= 90", "weighted_average_review_score >= 4")} AS status
            FROM (SELECT count(*) AS eligible_months, {MIN_ORDERS} AS minimum_monthly_orders_filter,
                         CAST(sum(gmv) AS DOUBLE) AS total_gmv, CAST(sum(total_orders) AS BIGINT) AS total_orders,
                         {_COUNT} AS unique_customers,
                         round(CAST(sum(gmv) AS DOUBLE) / sum(total_orders), 6) AS weighted_average_order_value,
                         round(sum(avg_review_score * total_orders) / sum(total_orders), 6) AS weighted_average_review_score,
                         {_WEIGHTED_ON_TIME} AS weighted_on_time_pct,
                         max(year_month) AS latest_eligible_month,
                         arg_max({_CHANGE}, purchase_month) AS latest_vs_previous_gmv_pct
                  FROM ({_GMV_SERIES})) WHERE eligible_months > 0""",
    ),
    "business_health": _with(
        ["eligible"],
        f"""SELECT CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(sum(total_orders) AS BIGINT) AS orders,
            {_COUNT} AS customers, round(CAST(sum(gmv) AS DOUBLE) / sum(total_orders), 6) AS weighted_aov,
            {_WEIGHTED_ON_TIME} AS weighted_on_time_pct FROM eligible""",
    ),
    "delivery_kpis": _with(
        ["eligible"],
        f"""SELECT {_WEIGHTED_ON_TIME} AS weighted_on_time_pct,
            round(sum(avg_delivery_days * total_orders) / sum(total_orders), 6) AS weighted_delivery_days
            FROM eligible""",
    ),
    "status_by_month": _with(
        ["eligible"],
        f"""SELECT purchase_month, year_month, round(on_time_pct, 6) AS on_time_pct,
            round(avg_review_score, 6) AS avg_review_score,
            {_status(_ON_TIME_MET, "avg_review_score >= 4")} AS status FROM eligible""",
    ),
    "rfm_segment_summary": _with(
        ["scored"],
        f"""SELECT rfm_segment, customers, CAST(total_revenue AS DOUBLE) AS total_revenue,
            round(avg_revenue, 6) AS avg_revenue, round(avg_orders, 6) AS avg_orders,
            round(share, 6) AS revenue_share_pct FROM {_SUMMARY}""",
    ),
    "rfm_segment_map": _with(
        ["scored"], f"SELECT rfm_segment, count(*) AS customers FROM {_SEGMENTED} GROUP BY rfm_segment"
    ),
    "rfm_segment_revenue": _with(
        ["scored"],
        f"""SELECT rfm_segment, CAST(sum(total_revenue) AS DOUBLE) AS total_revenue
            FROM {_SEGMENTED} GROUP BY rfm_segment""",
    ),
    "rfm_kpis": _with(
        ["scored"],
        f"""SELECT CAST(sum(customers) AS BIGINT) AS customers_analyzed,
            {_object("customers")} AS segment_customer_counts,
            {_object("CAST(round(total_revenue, 2) AS DECIMAL(38,2))")} AS segment_revenue,
            {_object("CAST(share AS DECIMAL(5,2))")} AS segment_revenue_share_pct,
            arg_max(rfm_segment, total_revenue) AS top_segment_by_revenue,
            round(arg_max(share, total_revenue), 6) AS top_segment_revenue_share_pct FROM {_SUMMARY}""",
    ),
    "rfm_sample": _with(
        ["scored"],
        f"""SELECT {_RFM}, {_segment()} AS rfm_segment FROM scored
            ORDER BY md5('{SAMPLE_SEED}:' || customer_unique_id), customer_unique_id LIMIT {SAMPLE_SIZE}""",
    ),
    "retention_m1_m3": _with(
        ["cohorts"],
        f"""SELECT *, {_status("month_1_average_retention_pct >= 20")} AS status
            FROM (SELECT {", ".join(
                f'''CAST(sum(CASE WHEN month_number = {k} THEN CAST(retention_rate AS DECIMAL(9,2)) END) AS DOUBLE)
                / count(CASE WHEN month_number = {k} THEN 1 END) AS month_{k}_average_retention_pct''' for k in (1, 3))},
                count(DISTINCT cohort_month) AS cohorts_analyzed FROM cohorts)""",
    ),
    "cohort_first6_curves": _with(
        ["cohorts"],
        """SELECT * FROM cohorts WHERE cohort_month IN
           (SELECT DISTINCT cohort_month FROM cohorts ORDER BY cohort_month LIMIT 6)""",
    ),
    # Months without any row get a column from the added rows, which have no cohort.
    "cohort_matrix": _with(
        ["cohorts"],
        """SELECT * FROM (PIVOT (
               SELECT cohort_month, 'm' || month_number AS m, retention_rate FROM cohorts
               UNION ALL SELECT NULL, 'm' || unnest(range(0, (SELECT max(month_number) + 1 FROM cohorts))), NULL)
           ON m USING max(retention_rate) GROUP BY cohort_month) WHERE cohort_month IS NOT NULL""",
    ),
    "top_categories": _with(["ranked_products"], f"SELECT {_PRODUCTS} FROM ranked_products WHERE place <= 30"),
    "leading_categories": _with(
        ["ranked_products"],
        "SELECT category, CAST(revenue AS DOUBLE) AS revenue, avg_rating FROM ranked_products WHERE place <= 5",
    ),
    "product_kpis": _with(
        ["ranked_products"],
        """SELECT count(*) AS categories_loaded, max(CASE WHEN place = 1 THEN category END) AS top_category,
           CAST(max(CASE WHEN place = 1 THEN revenue END) AS DOUBLE) AS top_category_revenue,
           round(CAST(sum(CASE WHEN place <= 5 THEN revenue END) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE) * 100, 6)
               AS top_5_revenue_share_of_loaded_categories_pct,
           round(avg(CASE WHEN place <= 5 THEN avg_rating END), 6) AS top_5_average_rating
           FROM ranked_products WHERE place <= 30""",
    ),
    "top_sellers": _with(["loaded_sellers"], f"SELECT {_SELLERS} FROM loaded_sellers"),
    "sellers_to_review": _with(["listed_sellers"], f"SELECT {_SELLERS}, needs_review FROM listed_sellers"),
    "seller_kpis": _with(
        ["listed_sellers"],
        """SELECT count(*) AS sellers_loaded, 90.0::DOUBLE AS on_time_target_pct, 4.0::DOUBLE AS good_rating_target,
           count(CASE WHEN needs_review THEN 1 END) AS sellers_flagged_for_review,
           (SELECT CAST(coalesce(sum(revenue), 0) AS DOUBLE) FROM listed_sellers) AS flagged_seller_revenue,
           CAST(max(CASE WHEN place = 1 THEN revenue END) AS DOUBLE) AS top_seller_revenue,
           round(max(CASE WHEN place = 1 THEN on_time_pct END), 6) AS top_seller_on_time_pct,
           round(max(CASE WHEN place = 1 THEN avg_rating END), 6) AS top_seller_rating
           FROM loaded_sellers""",
    ),
    "status_by_seller": _with(
        ["sellers"],
        f"""SELECT seller_id, seller_city, seller_state, on_time_pct, avg_rating,
            {_status(_ON_TIME_MET, _RATING_MET)} AS status FROM sellers""",
    ),
    "geo_kpis": _with(
        ["states"],
        """SELECT count(*) AS states_analyzed,
           (SELECT customer_state FROM states ORDER BY gmv DESC NULLS LAST, customer_state LIMIT 1) AS highest_gmv_state,
           CAST(max(gmv) AS DOUBLE) AS highest_gmv,
           (SELECT customer_state FROM states ORDER BY on_time_pct NULLS LAST, customer_state LIMIT 1)
               AS lowest_on_time_state,
           round(min(on_time_pct), 6) AS lowest_on_time_pct, CAST(sum(gmv) AS DOUBLE) AS overall_state_gmv
           FROM states""",
    ),
    "new_returning_kpis": _with(
        ["split"],
        f"""SELECT *, {_status("returning_revenue_share_pct >= 30")} AS status
            FROM (SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue,
                  CAST(sum(revenue) FILTER (customer_type = 'New') AS DOUBLE) AS new_revenue,
                  CAST(sum(revenue) FILTER (customer_type = 'Returning') AS DOUBLE) AS returning_revenue,
                  round(CAST(sum(revenue) FILTER (customer_type = 'Returning') AS DOUBLE)
                        / CAST(sum(revenue) AS DOUBLE) * 100, 6) AS returning_revenue_share_pct
                  FROM split)""",
    ),
    "returning_share_by_month": _with(
        ["split"],
        """SELECT purchase_month, CAST(n AS DOUBLE) AS new_revenue, CAST(r AS DOUBLE) AS returning_revenue,
           round(CAST(r AS DOUBLE) / nullif(CAST(r + n AS DOUBLE), 0) * 100, 6) AS returning_share
           FROM (SELECT purchase_month, coalesce(sum(revenue) FILTER (customer_type = 'New'), 0) AS n,
                 coalesce(sum(revenue) FILTER (customer_type = 'Returning'), 0) AS r
                 FROM split GROUP BY purchase_month)""",
    ),
    "percent_normalize": _with(
        ["sellers"],
        """SELECT seller_id, round(on_time_pct, 6) AS from_pct, round(on_time_pct, 6) AS from_share FROM sellers""",
    ),
    "order_payments_reduced": _with(
        ["paid"], "SELECT * REPLACE (CAST(total_payment_value AS DOUBLE) AS total_payment_value) FROM paid"
    ),
    "order_reviews_reduced": _with(
        ["rated"], "SELECT order_id, round(avg_review_score, 6) AS avg_review_score, reviews FROM rated"
    ),
    "order_fact_from_raw": _with(
        ["f", "paid", "rated"],
        """SELECT f.order_id, order_item_id, product_id, CAST(price AS DOUBLE) AS price,
           round(avg_review_score, 6) AS review_score, paid.primary_payment_type, paid.max_installments,
           CAST(paid.total_payment_value AS DOUBLE) AS total_payment_value
           FROM f LEFT JOIN paid USING (order_id) LEFT JOIN rated USING (order_id)""",
    ),
    "numeric_coercion": _with(
        ["pay"],
        """SELECT order_id, payment_type,
           CAST(payment_value AS VARCHAR) || CASE WHEN payment_type = 'error' THEN ' BRL' ELSE '' END AS amount_text,
           CASE WHEN payment_type <> 'error' THEN CAST(payment_value AS DOUBLE) END AS amount FROM pay""",
    ),
    "state_payload_json": _with(
        ["states"],
        """SELECT CAST(json_object('customer_state', customer_state, 'orders', orders, 'customers', customers,
                                   'gmv', CAST(gmv AS VARCHAR)) AS VARCHAR) AS payload FROM states""",
    ),
    "brief_parse": _with(
        ["read", "actions_in_order"],
        """SELECT seller_id, j->>'status' AS status, j->>'headline' AS headline,
           CAST(json_array_length(j->'findings') AS BIGINT) AS findings,
           array_to_string(CAST(j->'risks' AS VARCHAR[]), '|') AS risks,
           (SELECT string_agg(a->>'action', '|' ORDER BY place) FROM actions_in_order o
            WHERE o.seller_id = read.seller_id) AS actions
           FROM read""",
    ),
    "brief_validation": _with(
        ["judged"],
        """SELECT seller_id, error IS NULL AS is_valid, error,
           CASE error WHEN 'missing_keys' THEN array_to_string(list_sort(gaps), ', ')
                WHEN 'invalid_status' THEN j->>'status' WHEN 'findings_count' THEN CAST(nf AS VARCHAR)
                WHEN 'actions_count' THEN CAST(na AS VARCHAR) WHEN 'risks_count' THEN CAST(nr AS VARCHAR)
                END AS error_detail,
           error IS NULL AND json_type(j->'caveat') = 'VARCHAR'
               AND len([k FOR k IN json_keys(j->'findings'->1) IF k NOT IN ('label', 'number', 'detail')]) = 0
               AND coalesce(json_type(j->'actions'->2->'priority') = 'UBIGINT', false) AS is_strict
           FROM judged""",
    ),
    "brief_markdown": _with(["judged", "actions_in_order"], _MARKDOWN),
    "list_tables": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in INPUT_TABLES
    ),
    "table_inventory": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in INPUT_TABLES
    ),
}
ORACLE_SQL["executive_display"] = _rounded(
    ORACLE_SQL["executive_kpis"],
    {
        "total_gmv": 2,
        "weighted_average_order_value": 2,
        "weighted_average_review_score": 3,
        "weighted_on_time_pct": 3,
        "latest_vs_previous_gmv_pct": 2,
    },
)
ORACLE_SQL["new_returning_display"] = _rounded(
    ORACLE_SQL["new_returning_kpis"],
    {"total_revenue": 2, "new_revenue": 2, "returning_revenue": 2, "returning_revenue_share_pct": 2},
)
# What each change of a sound document breaks, by the remainder of the seller's number.
BROKEN = [
    "", "$: malformed", "$.status: missing", "$.status: value", "$.status: type", "$.headline: missing|$.heading: extra",
    "$.summary: type", "$.caveat: type", "$.caveat: missing", "$.findings: size", "$.findings: size",
    "$.findings[1].label: missing", "$.findings[1].number: type", "$.findings[2].unit: extra",
    "$.findings: size|$.findings[0]: type", "$.risks: size", "$.risks: size", "$.risks[1]: type", "$.risks: type",
    "$.actions[1].priority: value", "$.actions[1].priority: type", "$.actions[1].priority: type",
    "$.actions[0].priority: missing", "$.actions[1].reason: type", "$.actions[2].owner: extra",
    "$.actions[2].action: missing|$.actions[2].act: extra", "$: malformed", "$.extra: extra|$.note: extra", "$: malformed",
]
AWKWARD_NOTE = """CASE orders % 7 WHEN 0 THEN 'plain' WHEN 1 THEN 'a, b' WHEN 2 THEN 'say "yes"'
    WHEN 3 THEN 'two' || chr(10) || 'lines' WHEN 4 THEN '' WHEN 5 THEN NULL
    ELSE ' "quoted, and' || chr(10) || 'more", back' || chr(92) || 'slash ' END"""
ORACLE_SQL["csv_round_trip"] = _with(
    ["states"], f"SELECT customer_state, orders, CAST(gmv AS DOUBLE) AS gmv, {AWKWARD_NOTE} AS note FROM states"
)
ORACLE_SQL["published_monthly_kpis"] = ORACLE_SQL["monthly_kpis"]
ORACLE_SQL["published_rfm_segments"] = ORACLE_SQL["rfm_segments"]
ORACLE_SQL["document_round_trip"] = ORACLE_SQL["brief_markdown"]
ORACLE_SQL["brief_broken_paths"] = _with(
    ["sellers"], f"SELECT seller_id, {BROKEN!r}[1 + seller_id % {len(BROKEN)}] AS broken FROM sellers"
)

ORACLE_SQL |= {
    "rfm_display": _rounded(ORACLE_SQL["rfm_kpis"], {"top_segment_revenue_share_pct": 2}),
    "retention_display": _rounded(
        ORACLE_SQL["retention_m1_m3"], {"month_1_average_retention_pct": 2, "month_3_average_retention_pct": 2}
    ),
    "product_display": _rounded(
        ORACLE_SQL["product_kpis"],
        {"top_category_revenue": 2, "top_5_revenue_share_of_loaded_categories_pct": 2, "top_5_average_rating": 2},
    ),
    "seller_display": _rounded(
        ORACLE_SQL["seller_kpis"],
        {"flagged_seller_revenue": 2, "top_seller_revenue": 2, "top_seller_on_time_pct": 2, "top_seller_rating": 2},
    ),
    "geo_display": _rounded(
        ORACLE_SQL["geo_kpis"], {"highest_gmv": 2, "lowest_on_time_pct": 2, "overall_state_gmv": 2}
    ),
    "business_health_display": _rounded(
        ORACLE_SQL["business_health"], {"gmv": 2, "weighted_aov": 2, "weighted_on_time_pct": 2}
    ),
    "delivery_display": _rounded(
        ORACLE_SQL["delivery_kpis"], {"weighted_on_time_pct": 2, "weighted_delivery_days": 2}
    ),
}


def _placed(blocks: list[str], keys: str, source: str, order: str) -> str:
    place = f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place"
    return _with(blocks, f"SELECT {keys}, {place} FROM {source}")


ORACLE_SQL |= {
    "ordered_cohort_retention": _placed(
        ["cohorts"], "cohort_month, month_number", "cohorts", "cohort_month, month_number"
    ),
    "ordered_monthly_kpis": _placed(["monthly"], "purchase_month", "monthly", "purchase_month NULLS LAST"),
    "ordered_product_performance": _placed(
        ["products"], "category", "products", "revenue DESC NULLS FIRST, category"
    ),
    "ordered_seller_performance": _placed(
        ["sellers"], "seller_id", "sellers", "revenue DESC NULLS FIRST, seller_id"
    ),
    "ordered_state_performance": _placed(
        ["states"], "customer_state", "states", "gmv DESC NULLS FIRST, customer_state"
    ),
    "ordered_new_vs_returning": _placed(
        ["split"], "purchase_month, customer_type", "split", "purchase_month NULLS LAST, customer_type"
    ),
    "ordered_payment_analysis": _placed(
        ["pay"],
        "payment_type",
        "(SELECT payment_type, sum(payment_value) AS total_paid FROM pay GROUP BY payment_type)",
        "total_paid DESC NULLS FIRST, payment_type NULLS LAST",
    ),
    "ordered_rfm_segment_summary": _placed(
        ["scored"], "rfm_segment", _SUMMARY, "total_revenue DESC NULLS FIRST, rfm_segment"
    ),
    "ordered_rfm_segment_map": _placed(
        ["scored"], "rfm_segment", _SUMMARY, "customers DESC NULLS FIRST, rfm_segment"
    ),
    "rfm_sample_small": _with(
        ["scored"],
        f"""SELECT {_RFM}, {_segment()} AS rfm_segment FROM scored
            ORDER BY md5('42:' || customer_unique_id), customer_unique_id LIMIT 300""",
    ),
    "all_flagged_sellers": _with(
        ["sellers"],
        """SELECT seller_id FROM sellers
           WHERE coalesce(on_time_pct < 90, false) OR coalesce(avg_rating < 4, false)""",
    ),
}
