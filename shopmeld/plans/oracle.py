"""DuckDB SQL that recomputes every registered query from the driver's tables.

Written independently of the operators: plain distinct counts, self-contained window clauses and
integer arithmetic for rounded rates. `compose` puts the named relations a query uses in front of
it as CTEs.
"""

from __future__ import annotations

import re

from shopmeld.sources.fixture import DERIVED, derived_sql

AS_OF = "DATE '2001-07-15'"
NOW = "TIMESTAMP '2001-07-15 12:00:00'"
PLATFORMS = ("shopify", "amazon", "lazada", "shopee")


def _dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def _sum0(expression: str) -> str:
    return f"CAST(COALESCE(SUM({expression}), 0) AS DOUBLE)"


def _avg(expression: str, over: str = "") -> str:
    """Exact sum over count, as a double."""
    return f"CAST(SUM({expression}) {over} AS DOUBLE) / NULLIF(COUNT({expression}) {over}, 0)"


def _rate(part: str, whole: str) -> str:
    """round(100 * part / whole, 2) of counts, half up, in integers."""
    return (
        f"CASE WHEN ({whole}) = 0 THEN NULL ELSE "
        f"CAST((20000 * CAST({part} AS HUGEINT) + ({whole})) // (2 * ({whole})) AS DOUBLE) / 100.0 END"
    )


def _growth(current: str, base: str, scale: int, half_even: bool = False) -> str:
    """Growth in percent at two digits, half away from zero or half even; 0 without a base."""
    d = f"CAST(({base}) * {10 ** scale} AS HUGEINT)"
    n = f"CAST((({current}) - ({base})) * {10 ** scale} AS HUGEINT)"
    if half_even:
        q, r = f"((10000 * ABS({n})) // {d})", f"((10000 * ABS({n})) % {d})"
        rounded = f"({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    else:
        rounded = f"((20000 * ABS({n}) + {d}) // (2 * {d}))"
    return (
        f"CASE WHEN ({base}) > 0 THEN SIGN({n}) * CAST({rounded} AS DOUBLE) / 100.0 ELSE 0.0 END"
    )


ORDER_COLUMNS = """order_id, platform, order_created_at, order_updated_at, order_processed_at,
    order_cancelled_at, order_closed_at, customer_id, customer_email, total_amount, subtotal_amount,
    tax_amount, discount_amount, currency_code, payment_status, fulfillment_status, cancel_reason,
    item_count, order_source, order_tags, order_notes"""

ITEM_COLUMNS = """line_item_id, order_id, product_id, variant_id, platform, product_name, variant_title,
    sku, quantity, unit_price, line_total, discount_amount, fulfillment_status, fulfillable_quantity,
    is_gift_card, is_taxable, requires_shipping"""

RELATIONS: dict[str, str] = {f"raw_{name}": derived_sql(name) for name in DERIVED}

RELATIONS["stg_shopify_orders"] = """
    SELECT CAST(id AS VARCHAR) AS order_id, 'shopify' AS platform, created_at AS order_created_at,
        updated_at AS order_updated_at, processed_at AS order_processed_at,
        cancelled_at AS order_cancelled_at, closed_at AS order_closed_at,
        CAST(customer_id AS VARCHAR) AS customer_id, email AS customer_email,
        total_price AS total_amount, subtotal_price AS subtotal_amount, total_tax AS tax_amount,
        total_discounts AS discount_amount, currency AS currency_code,
        financial_status AS payment_status, fulfillment_status, cancel_reason,
        COALESCE(line_items_count, 0) AS item_count, source_name AS order_source,
        tags AS order_tags, note AS order_notes
    FROM raw_shopify_orders"""

RELATIONS["stg_amazon_orders"] = """
    SELECT amazon_order_id AS order_id, 'amazon' AS platform, purchase_date AS order_created_at,
        last_update_date AS order_updated_at, CAST(NULL AS TIMESTAMP) AS order_processed_at,
        CAST(NULL AS TIMESTAMP) AS order_cancelled_at, CAST(NULL AS TIMESTAMP) AS order_closed_at,
        buyer_email AS customer_id, buyer_email AS customer_email,
        CAST(order_total->>'$.Amount' AS DECIMAL(12,2)) AS total_amount,
        CAST(order_total->>'$.Amount' AS DECIMAL(12,2)) AS subtotal_amount,
        CAST(0 AS DECIMAL(12,2)) AS tax_amount, CAST(0 AS DECIMAL(12,2)) AS discount_amount,
        order_total->>'$.CurrencyCode' AS currency_code, payment_method AS payment_status,
        order_status AS fulfillment_status, CAST(NULL AS VARCHAR) AS cancel_reason,
        number_of_items_shipped + number_of_items_unshipped AS item_count,
        sales_channel AS order_source, CAST(NULL AS VARCHAR) AS order_tags,
        CAST(NULL AS VARCHAR) AS order_notes
    FROM raw_amazon_orders"""

RELATIONS["stg_lazada_orders"] = """
    SELECT CAST(order_id AS VARCHAR) AS order_id, 'lazada' AS platform,
        created_at AS order_created_at, updated_at AS order_updated_at,
        CAST(NULL AS TIMESTAMP) AS order_processed_at, CAST(NULL AS TIMESTAMP) AS order_cancelled_at,
        CAST(NULL AS TIMESTAMP) AS order_closed_at, CAST(customer_id AS VARCHAR) AS customer_id,
        buyer_email AS customer_email, price AS total_amount, price AS subtotal_amount,
        CAST(0 AS DECIMAL(12,2)) AS tax_amount, COALESCE(voucher, 0) AS discount_amount,
        'PHP' AS currency_code, payment_method AS payment_status, statuses AS fulfillment_status,
        CAST(NULL AS VARCHAR) AS cancel_reason, items_count AS item_count,
        'lazada' AS order_source, CAST(NULL AS VARCHAR) AS order_tags, remarks AS order_notes
    FROM raw_lazada_orders"""

RELATIONS["stg_shopee_orders"] = """
    SELECT order_sn AS order_id, 'shopee' AS platform,
        make_timestamp(create_time * 1000000) AS order_created_at,
        make_timestamp(update_time * 1000000) AS order_updated_at,
        make_timestamp(pay_time * 1000000) AS order_processed_at,
        CASE WHEN order_status = 'CANCELLED' THEN make_timestamp(update_time * 1000000) END
            AS order_cancelled_at,
        CASE WHEN order_status = 'COMPLETED' THEN make_timestamp(update_time * 1000000) END
            AS order_closed_at,
        CAST(buyer_user_id AS VARCHAR) AS customer_id, buyer_username AS customer_email,
        total_amount, CAST(total_amount - COALESCE(estimated_shipping_fee, 0) AS DECIMAL(12,2))
            AS subtotal_amount,
        CAST(0 AS DECIMAL(12,2)) AS tax_amount, COALESCE(voucher_absorbed, 0) AS discount_amount,
        currency AS currency_code,
        CASE WHEN order_status IN ('READY_TO_SHIP', 'PROCESSED', 'SHIPPED', 'COMPLETED') THEN 'paid'
            WHEN order_status = 'UNPAID' THEN 'pending' ELSE 'unknown' END AS payment_status,
        order_status AS fulfillment_status, cancel_reason, 1 AS item_count,
        'shopee' AS order_source, CAST(NULL AS VARCHAR) AS order_tags,
        message_to_seller AS order_notes
    FROM raw_shopee_orders"""

RELATIONS["stg_shopify_order_items"] = """
    SELECT CAST(id AS VARCHAR) AS line_item_id, CAST(order_id AS VARCHAR) AS order_id,
        CAST(product_id AS VARCHAR) AS product_id, CAST(variant_id AS VARCHAR) AS variant_id,
        'shopify' AS platform, title AS product_name, variant_title, sku, quantity,
        CAST(price AS DECIMAL(30,13)) AS unit_price,
        CAST(quantity * price AS DECIMAL(12,2)) AS line_total,
        COALESCE(total_discount, 0) AS discount_amount, fulfillment_status, fulfillable_quantity,
        gift_card AS is_gift_card, taxable AS is_taxable, requires_shipping
    FROM raw_shopify_order_line_items"""

# The unit price is the exact quotient at 13 digits, half up: DuckDB's `/` would give a double.
RELATIONS["stg_amazon_order_items"] = """
    SELECT order_item_id AS line_item_id, amazon_order_id AS order_id, asin AS product_id,
        CAST(NULL AS VARCHAR) AS variant_id, 'amazon' AS platform, title AS product_name,
        CAST(NULL AS VARCHAR) AS variant_title, seller_sku AS sku, quantity_ordered AS quantity,
        CASE WHEN quantity_ordered <> 0 THEN
            CAST((200000000000 * CAST(amount * 100 AS HUGEINT) + quantity_ordered)
                // (2 * quantity_ordered) AS DECIMAL(30,0)) * 0.0000000000001 END AS unit_price,
        amount AS line_total,
        COALESCE(CAST(promotion_discount->>'$.Amount' AS DECIMAL(12,2)), 0) AS discount_amount,
        CASE WHEN quantity_shipped > 0 THEN 'shipped' ELSE 'pending' END AS fulfillment_status,
        quantity_ordered - quantity_shipped AS fulfillable_quantity,
        false AS is_gift_card, true AS is_taxable, true AS requires_shipping
    FROM (SELECT *, CAST(item_price->>'$.Amount' AS DECIMAL(12,2)) AS amount FROM raw_amazon_order_items)"""

RELATIONS["stg_lazada_order_items"] = """
    SELECT CAST(order_item_id AS VARCHAR) AS line_item_id, CAST(order_id AS VARCHAR) AS order_id,
        CAST(product_id AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS variant_id,
        'lazada' AS platform, name AS product_name, variation AS variant_title, sku, 1 AS quantity,
        CAST(paid_price AS DECIMAL(30,13)) AS unit_price, paid_price AS line_total,
        COALESCE(voucher_amount, 0) AS discount_amount, status AS fulfillment_status,
        0 AS fulfillable_quantity, false AS is_gift_card, true AS is_taxable, true AS requires_shipping
    FROM raw_lazada_order_items"""

RELATIONS["stg_shopee_order_items"] = """
    SELECT order_sn || '_' || CAST(item_id AS VARCHAR) AS line_item_id, order_sn AS order_id,
        CAST(item_id AS VARCHAR) AS product_id, CAST(model_id AS VARCHAR) AS variant_id,
        'shopee' AS platform, item_name AS product_name, model_name AS variant_title,
        model_sku AS sku, model_quantity_purchased AS quantity,
        CAST(model_discounted_price AS DECIMAL(30,13)) AS unit_price,
        CAST(model_quantity_purchased * model_discounted_price AS DECIMAL(12,2)) AS line_total,
        CAST(COALESCE((model_original_price - model_discounted_price) * model_quantity_purchased, 0)
            AS DECIMAL(12,2)) AS discount_amount,
        'pending' AS fulfillment_status, 0 AS fulfillable_quantity,
        false AS is_gift_card, true AS is_taxable, true AS requires_shipping
    FROM raw_shopee_order_items"""

RELATIONS["int_unified_orders"] = f"""
    SELECT *,
        CASE currency_code WHEN 'PHP' THEN total_amount * 0.018 WHEN 'MYR' THEN total_amount * 0.21
            WHEN 'SGD' THEN total_amount * 0.74 WHEN 'IDR' THEN total_amount * 0.000063
            ELSE total_amount END AS total_amount_usd,
        CAST(order_created_at AS DATE) AS order_date,
        CAST(date_trunc('week', order_created_at) AS DATE) AS order_week,
        CAST(date_trunc('month', order_created_at) AS DATE) AS order_month,
        CAST(date_trunc('quarter', order_created_at) AS DATE) AS order_quarter,
        CAST(date_trunc('year', order_created_at) AS DATE) AS order_year,
        CAST(extract(hour FROM order_created_at) AS BIGINT) AS order_hour,
        CAST(extract(dow FROM order_created_at) AS BIGINT) AS order_day_of_week,
        COALESCE(payment_status IN ('paid', 'authorized', 'partially_paid'), false) AS is_paid,
        COALESCE(fulfillment_status IN ('fulfilled', 'shipped', 'delivered', 'COMPLETED', 'Shipped'),
            false) AS is_fulfilled,
        order_cancelled_at IS NOT NULL AS is_cancelled
    FROM ({" UNION ALL ".join(f"SELECT {ORDER_COLUMNS} FROM stg_{p}_orders" for p in PLATFORMS)})"""

RELATIONS["int_unified_order_items"] = " UNION ALL ".join(
    f"SELECT {ITEM_COLUMNS} FROM stg_{p}_order_items" for p in PLATFORMS
)


def _window(frame: str = "") -> str:
    return f"OVER (ORDER BY order_date {frame})"


_LAST7 = _window("ROWS BETWEEN 6 PRECEDING AND CURRENT ROW")
_LAST30 = _window("ROWS BETWEEN 29 PRECEDING AND CURRENT ROW")

RELATIONS["daily_base"] = f"""
    SELECT order_date, {_big("COUNT(DISTINCT order_id)")} AS total_orders,
        SUM(total_amount_usd) AS total_revenue_usd, {_avg("total_amount_usd")} AS avg_order_value_usd,
        {_big("SUM(item_count)")} AS total_items_sold,
        {", ".join(f"COUNT(DISTINCT CASE WHEN platform = '{p}' THEN order_id END) AS {p}_orders" for p in PLATFORMS)},
        {", ".join(f"SUM(CASE WHEN platform = '{p}' THEN total_amount_usd ELSE 0 END) AS {p}_revenue_usd" for p in PLATFORMS)},
        COUNT(DISTINCT customer_id) AS unique_customers,
        COUNT(CASE WHEN is_fulfilled THEN 1 END) AS fulfilled_orders,
        {_rate("COUNT(CASE WHEN is_fulfilled THEN 1 END)", "COUNT(*)")} AS fulfillment_rate
    FROM int_unified_orders WHERE NOT is_cancelled GROUP BY order_date"""

RELATIONS["kpi_daily_snapshot"] = f"""
    SELECT *, {_avg("total_revenue_usd", _LAST7)} AS revenue_7d_avg,
        {_avg("total_orders", _LAST7)} AS orders_7d_avg,
        {_avg("total_revenue_usd", _LAST30)} AS revenue_30d_avg,
        {_avg("total_orders", _LAST30)} AS orders_30d_avg,
        total_revenue_usd - LAG(total_revenue_usd) {_window()} AS revenue_dod_change,
        total_orders - LAG(total_orders) {_window()} AS orders_dod_change,
        total_revenue_usd - LAG(total_revenue_usd, 7) {_window()} AS revenue_wow_change,
        total_orders - LAG(total_orders, 7) {_window()} AS orders_wow_change
    FROM daily_base"""

_THIS_MONTH = f"CAST(date_trunc('month', {AS_OF}) AS DATE)"
_LAST_MONTH = f"CAST(date_trunc('month', {AS_OF} - INTERVAL 1 MONTH) AS DATE)"

RELATIONS["overview_base"] = f"""
    SELECT platform, COUNT(DISTINCT order_id) AS total_orders,
        COUNT(DISTINCT CASE WHEN NOT is_cancelled THEN order_id END) AS completed_orders,
        COUNT(DISTINCT CASE WHEN is_cancelled THEN order_id END) AS cancelled_orders,
        SUM(CASE WHEN NOT is_cancelled THEN total_amount_usd ELSE 0 END) AS total_revenue_usd,
        COUNT(DISTINCT CASE WHEN order_month = {_THIS_MONTH} THEN order_id END) AS orders_this_month,
        SUM(CASE WHEN order_month = {_THIS_MONTH} AND NOT is_cancelled THEN total_amount_usd ELSE 0 END)
            AS revenue_this_month_usd,
        COUNT(DISTINCT CASE WHEN order_month = {_LAST_MONTH} THEN order_id END) AS orders_last_month,
        SUM(CASE WHEN order_month = {_LAST_MONTH} AND NOT is_cancelled THEN total_amount_usd ELSE 0 END)
            AS revenue_last_month_usd,
        COUNT(DISTINCT CASE WHEN order_date = {AS_OF} THEN order_id END) AS orders_today,
        SUM(CASE WHEN order_date = {AS_OF} AND NOT is_cancelled THEN total_amount_usd ELSE 0 END)
            AS revenue_today_usd,
        {_avg("CASE WHEN NOT is_cancelled THEN total_amount_usd END")} AS avg_order_value_usd,
        {_avg("CASE WHEN NOT is_cancelled THEN item_count END")} AS avg_items_per_order,
        {_rate("COUNT(CASE WHEN is_paid THEN 1 END)", "COUNT(*)")} AS payment_rate,
        {_rate("COUNT(CASE WHEN is_fulfilled THEN 1 END)", "COUNT(CASE WHEN is_paid THEN 1 END)")}
            AS fulfillment_rate,
        {_rate("COUNT(CASE WHEN is_cancelled THEN 1 END)", "COUNT(*)")} AS cancellation_rate,
        MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
        COUNT(DISTINCT order_date) AS active_days
    FROM int_unified_orders GROUP BY platform"""

RELATIONS["kpi_platform_overview"] = f"""
    SELECT *, {_growth("revenue_this_month_usd", "revenue_last_month_usd", 8)} AS revenue_mom_growth_pct,
        {_growth("orders_this_month", "orders_last_month", 0)} AS orders_mom_growth_pct
    FROM overview_base"""

RELATIONS["product_base"] = f"""
    SELECT i.platform, i.product_id, i.product_name, i.sku,
        COUNT(DISTINCT i.order_id) AS total_orders, {_big("SUM(i.quantity)")} AS total_units_sold,
        SUM(i.line_total) AS total_revenue, {_avg("i.unit_price")} AS avg_selling_price,
        COUNT(DISTINCT o.order_date) AS days_with_sales, MIN(o.order_date) AS first_sale_date,
        MAX(o.order_date) AS last_sale_date,
        {_big(f"SUM(CASE WHEN o.order_month = {_THIS_MONTH} THEN i.quantity ELSE 0 END)")} AS units_this_month,
        SUM(CASE WHEN o.order_month = {_THIS_MONTH} THEN i.line_total ELSE 0 END) AS revenue_this_month,
        CASE WHEN COUNT(DISTINCT o.order_date) > 0 THEN
            CAST((200 * {_big("SUM(i.quantity)")} + COUNT(DISTINCT o.order_date))
                // (2 * COUNT(DISTINCT o.order_date)) AS DOUBLE) / 100.0 ELSE 0 END AS avg_daily_units
    FROM int_unified_order_items i
    JOIN int_unified_orders o ON i.order_id = o.order_id AND i.platform = o.platform
    WHERE o.is_cancelled = false
    GROUP BY i.platform, i.product_id, i.product_name, i.sku"""

_TIES = "product_id ASC NULLS LAST, product_name ASC NULLS LAST, sku ASC NULLS LAST"

RELATIONS["kpi_product_performance"] = f"""
    SELECT *, CASE WHEN revenue_rank <= 10 THEN 'Top 10'
        WHEN revenue_percentile >= 0.8 THEN 'Top Performer'
        WHEN revenue_percentile >= 0.5 THEN 'Average' ELSE 'Underperformer' END AS performance_tier
    FROM (SELECT *,
        ROW_NUMBER() OVER (PARTITION BY platform ORDER BY total_revenue DESC NULLS FIRST, {_TIES})
            AS revenue_rank,
        ROW_NUMBER() OVER (PARTITION BY platform ORDER BY total_units_sold DESC NULLS FIRST, {_TIES})
            AS units_rank,
        PERCENT_RANK() OVER (PARTITION BY platform ORDER BY total_revenue ASC NULLS LAST)
            AS revenue_percentile
        FROM product_base)"""

RELATIONS["revenue_base"] = f"""
    SELECT order_date, platform, COUNT(DISTINCT order_id) AS total_orders,
        SUM(total_amount) AS gross_revenue, SUM(total_amount_usd) AS gross_revenue_usd,
        SUM(discount_amount) AS total_discounts, SUM(total_amount - discount_amount) AS net_revenue,
        {_avg("total_amount")} AS avg_order_value, {_avg("total_amount_usd")} AS avg_order_value_usd,
        {_avg("item_count")} AS avg_items_per_order,
        COUNT(CASE WHEN is_paid THEN 1 END) AS paid_orders,
        COUNT(CASE WHEN NOT is_paid THEN 1 END) AS unpaid_orders,
        COUNT(CASE WHEN is_fulfilled THEN 1 END) AS fulfilled_orders,
        COUNT(CASE WHEN NOT is_fulfilled AND is_paid THEN 1 END) AS pending_fulfillment
    FROM int_unified_orders WHERE is_cancelled = false GROUP BY order_date, platform"""

RELATIONS["kpi_revenue_summary"] = f"""
    SELECT *, gross_revenue_usd - prev_day_revenue AS revenue_change,
        {_growth("gross_revenue_usd", "prev_day_revenue", 8)} AS revenue_growth_pct
    FROM (SELECT *,
        LAG(gross_revenue_usd) OVER (PARTITION BY platform ORDER BY order_date) AS prev_day_revenue,
        SUM(gross_revenue_usd) OVER (PARTITION BY platform, date_trunc('month', order_date)
            ORDER BY order_date) AS mtd_revenue_usd,
        {_big("SUM(total_orders) OVER (PARTITION BY platform, date_trunc('month', order_date) ORDER BY order_date)")}
            AS mtd_orders
        FROM revenue_base)"""


#: Raw orders after the loads of the incremental queries.
CHANGED_RAW = {
    "raw_shopify_orders": """
        SELECT * REPLACE (
            CASE WHEN financial_status = 'pending' THEN CAST(total_price * 2 AS DECIMAL(12,2)) ELSE total_price END AS total_price,
            CASE WHEN financial_status = 'pending' THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at,
            CASE WHEN financial_status = 'pending' THEN 'paid' ELSE financial_status END AS financial_status)
        FROM raw_shopify_orders""",
    "raw_lazada_orders": """
        SELECT * REPLACE (
            CASE WHEN statuses = 'shipped' THEN updated_at + INTERVAL 50 DAY ELSE updated_at END AS updated_at,
            CASE WHEN statuses = 'shipped' THEN created_at + INTERVAL 40 DAY ELSE created_at END AS created_at,
            CASE WHEN statuses = 'shipped' THEN 'delivered' ELSE statuses END AS statuses)
        FROM raw_lazada_orders""",
}


def _changed_relations() -> dict[str, str]:
    """Every relation once more, `<name>_changed`, over the changed raw orders."""

    def renamed(body: str) -> str:
        return re.sub(r"\w+", lambda w: f"{w[0]}_changed" if w[0] in RELATIONS else w[0], body)

    return {f"{name}_changed": CHANGED_RAW.get(name) or renamed(body) for name, body in RELATIONS.items()}


RELATIONS |= _changed_relations()


def compose(sql: str) -> str:
    """Prefix a query with the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\w+", text)):
            if word in RELATIONS and word not in ordered:
                visit(RELATIONS[word])
                ordered.append(word)

    visit(sql)
    ctes = ", ".join(f"{name} AS ({RELATIONS[name]})" for name in ordered)
    return f"WITH {ctes} {sql}" if ctes else sql


def _plain(columns: dict[str, str], source: str, tail: str = "") -> str:
    """Select columns as double, bigint or as they are, by a one-letter kind."""
    cast = {"d": _dbl, "i": _big, "6": lambda c: f"CAST(ROUND({c}, 6) AS DOUBLE)", "": str}
    body = ", ".join(f"{cast[kind](name)} AS {name}" for name, kind in columns.items())
    return f"SELECT {body} FROM {source} {tail}"


def _kinds(text: str, doubles: str = "", bigints: str = "", rounded: str = "") -> dict[str, str]:
    kinds = {name.strip(): "" for name in text.split(",")}
    for names, kind in ((doubles, "d"), (bigints, "i"), (rounded, "6")):
        kinds.update({name: kind for name in names.split()})
    return kinds


_ORDER_DOUBLES = "total_amount subtotal_amount tax_amount discount_amount"
ORDER_KINDS = _kinds(ORDER_COLUMNS, _ORDER_DOUBLES, "item_count")
UNIFIED_KINDS = {
    **ORDER_KINDS,
    "total_amount_usd": "d",
    **_kinds("order_date, order_week, order_month, order_quarter, order_year"),
    **_kinds("order_hour, order_day_of_week", bigints="order_hour order_day_of_week"),
    **_kinds("is_paid, is_fulfilled, is_cancelled"),
}
ITEM_KINDS = _kinds(
    ITEM_COLUMNS, "line_total discount_amount", "quantity fulfillable_quantity", rounded="unit_price"
)
DAILY_KINDS = _kinds(
    "order_date",
    "total_revenue_usd avg_order_value_usd shopify_revenue_usd amazon_revenue_usd lazada_revenue_usd"
    " shopee_revenue_usd fulfillment_rate revenue_7d_avg orders_7d_avg revenue_30d_avg orders_30d_avg"
    " revenue_dod_change revenue_wow_change",
    "total_orders total_items_sold shopify_orders amazon_orders lazada_orders shopee_orders"
    " unique_customers fulfilled_orders orders_dod_change orders_wow_change",
)
OVERVIEW_KINDS = _kinds(
    "platform, first_order_date, last_order_date",
    "total_revenue_usd revenue_this_month_usd revenue_last_month_usd revenue_today_usd"
    " avg_order_value_usd avg_items_per_order payment_rate fulfillment_rate cancellation_rate"
    " revenue_mom_growth_pct orders_mom_growth_pct",
    "total_orders completed_orders cancelled_orders orders_this_month orders_last_month orders_today"
    " active_days",
)
PRODUCT_KINDS = _kinds(
    "platform, product_id, product_name, sku, first_sale_date, last_sale_date, performance_tier",
    "total_revenue avg_selling_price revenue_this_month avg_daily_units revenue_percentile",
    "total_orders total_units_sold days_with_sales units_this_month revenue_rank units_rank",
)
REVENUE_KINDS = _kinds(
    "order_date, platform",
    "gross_revenue gross_revenue_usd total_discounts net_revenue avg_order_value avg_order_value_usd"
    " avg_items_per_order prev_day_revenue revenue_change mtd_revenue_usd revenue_growth_pct",
    "total_orders paid_orders unpaid_orders fulfilled_orders pending_fulfillment mtd_orders",
)

# Amount, discount, buyer and time of a raw order, per platform.
AMOUNT = {
    "shopify": "total_price",
    "amazon": "CAST(order_total->>'$.Amount' AS DECIMAL(20,6))",
    "lazada": "price",
    "shopee": "total_amount",
}
DISCOUNT = {"shopify": "total_discounts", "amazon": "0", "lazada": "voucher", "shopee": "voucher_absorbed"}
BUYER = {"amazon": "buyer_email", "lazada": "buyer_email", "shopee": "buyer_username"}
CREATED = {
    "shopify": "created_at",
    "amazon": "purchase_date",
    "lazada": "created_at",
    "shopee": "make_timestamp(create_time * 1000000)",
}


def _since(days: int, column: str) -> str:
    return f"{column} >= {NOW} - INTERVAL {days} DAY"


_SHOPIFY_LINES = f"""raw_shopify_order_line_items li
    JOIN raw_shopify_products p ON li.product_id = p.id
    JOIN raw_shopify_orders o ON li.order_id = o.id
    WHERE {_since(30, "o.created_at")}"""


def _market_lines(platform: str) -> tuple[str, str, str, str, str, str]:
    """Name, SKU, units, revenue, price and order key of a marketplace line."""
    amount = "CAST(li.item_price->>'$.Amount' AS DECIMAL(20,6))"
    return {
        "amazon": ("li.title", "li.seller_sku", "li.quantity_ordered", amount, amount, "amazon_order_id"),
        "lazada": ("li.name", "li.sku", "1", "li.paid_price", "li.paid_price", "order_id"),
        "shopee": (
            "li.item_name",
            "li.model_sku",
            "li.model_quantity_purchased",
            "li.model_discounted_price * li.model_quantity_purchased",
            "li.model_discounted_price",
            "order_sn",
        ),
    }[platform]


def _market_top(platform: str) -> str:
    name, sku, units, revenue, price, key = _market_lines(platform)
    created = {"amazon": "o.purchase_date", "lazada": "o.created_at", "shopee": "make_timestamp(o.create_time * 1000000)"}
    return f"""
        SELECT COALESCE({name}, 'Unknown') AS product_name, '{platform.capitalize()}' AS category,
            COALESCE({sku}, 'Unknown') AS vendor, COUNT(DISTINCT li.{key}) AS total_orders,
            {_big(f"SUM({units})")} AS units_sold, {_sum0(revenue)} AS total_revenue,
            {_avg(price)} AS avg_price, '{platform}' AS platform
        FROM raw_{platform}_order_items li JOIN raw_{platform}_orders o ON li.{key} = o.{key}
        WHERE {_since(30, created[platform])}
        GROUP BY {name}, {sku}
        ORDER BY SUM({revenue}) DESC NULLS FIRST, {name} ASC NULLS LAST, {sku} ASC NULLS LAST
        LIMIT 20"""


for _platform in ("amazon", "lazada", "shopee"):
    RELATIONS[f"top_{_platform}"] = _market_top(_platform)


def _trending() -> str:
    lines = """raw_shopify_order_line_items li JOIN raw_shopify_products p ON li.product_id = p.id
        JOIN raw_shopify_orders o ON li.order_id = o.id"""
    current = _since(7, "o.created_at")
    previous = f"{_since(14, 'o.created_at')} AND o.created_at < {NOW} - INTERVAL 7 DAY"
    return f"""
        SELECT c.title AS product_name, {_big("c.units")} AS current_units,
            {_dbl("c.revenue")} AS current_revenue, {_big("COALESCE(b.units, 0)")} AS previous_units,
            {_dbl("COALESCE(b.revenue, 0)")} AS previous_revenue,
            CASE WHEN COALESCE(b.revenue, 0) > 0
                THEN {_dbl("c.revenue - b.revenue")} / {_dbl("b.revenue")} * 100 ELSE 100.0 END AS growth_pct,
            'shopify' AS platform
        FROM (SELECT p.id, p.title, SUM(li.quantity) AS units, SUM(li.price * li.quantity) AS revenue
            FROM {lines} WHERE {current} GROUP BY p.id, p.title) c
        LEFT JOIN (SELECT p.id, SUM(li.quantity) AS units, SUM(li.price * li.quantity) AS revenue
            FROM {lines} WHERE {previous} GROUP BY p.id) b ON c.id = b.id
        ORDER BY growth_pct DESC NULLS FIRST, c.id LIMIT 10"""


def _customer_summary(platform: str) -> str:
    if platform == "shopify":
        return f"""
            SELECT COUNT(*) AS total_customers,
                COUNT(CASE WHEN orders_count > 0 THEN 1 END) AS customers_with_orders,
                COALESCE({_avg("orders_count")}, 0) AS avg_orders_per_customer,
                COALESCE({_avg("total_spent")}, 0) AS avg_lifetime_value,
                {_sum0("total_spent")} AS total_customer_value, 'shopify' AS platform
            FROM raw_shopify_customers"""
    buyers, amount = f"COUNT(DISTINCT {BUYER[platform]})", AMOUNT[platform]
    return f"""
        SELECT {buyers} AS total_customers, {buyers} AS customers_with_orders,
            COALESCE({_dbl("COUNT(*)")} / NULLIF({buyers}, 0), 0) AS avg_orders_per_customer,
            COALESCE({_dbl(f"SUM({amount})")} / NULLIF({buyers}, 0), 0) AS avg_lifetime_value,
            {_sum0(amount)} AS total_customer_value, '{platform}' AS platform
        FROM raw_{platform}_orders"""


def _top_customers(platform: str) -> str:
    if platform == "shopify":
        return f"""
            SELECT concat(first_name, ' ', last_name) AS name, email, {_big("orders_count")} AS orders_count,
                {_dbl("COALESCE(total_spent, 0)")} AS total_spent,
                strftime(created_at, '%Y-%m-%d') AS customer_since
            FROM raw_shopify_customers ORDER BY raw_shopify_customers.total_spent DESC NULLS FIRST, id LIMIT 10"""
    buyer, amount = BUYER[platform], AMOUNT[platform]
    return f"""
        SELECT COALESCE({buyer}, 'Unknown') AS name, {buyer} AS email, COUNT(*) AS orders_count,
            {_sum0(amount)} AS total_spent, strftime(MIN({CREATED[platform]}), '%Y-%m-%d') AS customer_since
        FROM raw_{platform}_orders GROUP BY {buyer}
        ORDER BY SUM({amount}) DESC NULLS FIRST, {buyer} ASC NULLS LAST LIMIT 10"""


def _acquisition(platform: str) -> str:
    table = "raw_shopify_customers" if platform == "shopify" else f"raw_{platform}_orders"
    count = "COUNT(*)" if platform == "shopify" else f"COUNT(DISTINCT {BUYER[platform]})"
    created = CREATED[platform]
    return f"""
        SELECT strftime(CAST({created} AS DATE), '%Y-%m-%d') AS date, {count} AS new_customers
        FROM {table} WHERE {_since(90, created)} GROUP BY CAST({created} AS DATE)"""


def _place(platform: str, city: bool) -> str:
    if platform in ("lazada", "shopee"):
        amount = AMOUNT[platform]
        tail = "" if city else f", COALESCE({_avg(amount)}, 0) AS avg_customer_value"
        head = "'Various' AS city, " if city else ""
        return f"""
            SELECT {head}'Southeast Asia' AS country, COUNT(*) AS customer_count,
                {_sum0(amount)} AS total_revenue{tail} FROM raw_{platform}_orders"""
    table, address, keys, amount = {
        "shopify": ("raw_shopify_customers", "default_address", ("city", "country"), "total_spent"),
        "amazon": ("raw_amazon_orders", "shipping_address", ("City", "CountryCode"), AMOUNT["amazon"]),
    }[platform]
    town, land = (f"COALESCE({address}->>'$.{key}', 'Unknown')" for key in keys)
    places = {"city": town, "country": land} if city else {"country": land}
    tail = "" if city else f", COALESCE({_avg(amount)}, 0) AS avg_customer_value"
    group = ", ".join(places.values())
    return f"""
        SELECT {", ".join(f"{value} AS {name}" for name, value in places.items())},
            COUNT(*) AS customer_count, {_sum0(amount)} AS total_revenue{tail}
        FROM {table} WHERE {address} IS NOT NULL GROUP BY {group}
        ORDER BY SUM({amount}) DESC NULLS FIRST, {group} LIMIT 20"""


def _leader(platform: str, city: bool) -> str:
    """The first place straight from the raw rows: one without any amount wins."""
    if platform not in ("shopify", "amazon"):
        return f"SELECT {'city' if city else 'country'} FROM {'cities' if city else 'countries'}_{platform}"
    table, address, keys, amount = {
        "shopify": ("raw_shopify_customers", "default_address", ("city", "country"), "total_spent"),
        "amazon": ("raw_amazon_orders", "shipping_address", ("City", "CountryCode"), AMOUNT["amazon"]),
    }[platform]
    town, land = (f"COALESCE({address}->>'$.{key}', 'Unknown')" for key in keys)
    group = f"{town}, {land}" if city else land
    return f"""SELECT {town if city else land} FROM {table} WHERE {address} IS NOT NULL GROUP BY {group}
        ORDER BY COUNT({amount}) > 0, SUM({amount}) DESC, {group} LIMIT 1"""


for _platform in PLATFORMS:
    RELATIONS[f"countries_{_platform}"] = _place(_platform, city=False)
    RELATIONS[f"cities_{_platform}"] = _place(_platform, city=True)


def _location_summary(platform: str) -> str:
    return f"""
        SELECT (SELECT COUNT(*) FROM countries_{platform}) AS total_countries,
            (SELECT COUNT(*) FROM cities_{platform}) AS total_cities,
            COALESCE(({_leader(platform, city=False)}), 'N/A') AS top_country,
            COALESCE(({_leader(platform, city=True)}), 'N/A') AS top_city,
            '{platform}' AS platform"""


def _counted(platform: str) -> str:
    return "cancelled_at IS NULL" if platform == "shopify" else "true"


RELATIONS["profit_platforms"] = " UNION ALL ".join(
    f"""SELECT '{p}' AS platform, COALESCE(SUM({AMOUNT[p]}), 0) AS gross_revenue,
        COALESCE(SUM({DISCOUNT[p]}), 0) AS discounts, COUNT(*) AS orders
        FROM raw_{p}_orders WHERE {_counted(p)}"""
    for p in PLATFORMS
)


def _profitability(platform: str) -> str:
    amount = AMOUNT[platform]
    subtotal, tax = ("subtotal_price", "total_tax") if platform == "shopify" else (amount, "0")
    return f"""
        SELECT {_dbl("gross")} AS gross_revenue, {_dbl("subtotal")} AS subtotal, {_dbl("tax")} AS total_tax,
            {_dbl("discounts")} AS total_discounts,
            CASE WHEN gross <> 0 AND discounts <> 0 THEN {_dbl("gross - discounts")} ELSE 0 END AS net_revenue,
            total_orders, COALESCE({_dbl("gross")} / NULLIF(amounts, 0), 0) AS avg_order_value,
            CASE WHEN gross > 0 THEN {_dbl("discounts")} / {_dbl("gross")} * 100 ELSE 0 END AS discount_rate
        FROM (SELECT COALESCE(SUM({amount}), 0) AS gross, COALESCE(SUM({subtotal}), 0) AS subtotal,
            COALESCE(SUM({tax}), 0) AS tax, COALESCE(SUM({DISCOUNT[platform]}), 0) AS discounts,
            COUNT(*) AS total_orders, COUNT({amount}) AS amounts
            FROM raw_{platform}_orders WHERE {_since(30, CREATED[platform])} AND {_counted(platform)})"""


def _profitability_daily(platform: str) -> str:
    created = CREATED[platform]
    return f"""
        SELECT strftime(CAST({created} AS DATE), '%Y-%m-%d') AS date,
            {_sum0(AMOUNT[platform])} AS gross_revenue, {_sum0(DISCOUNT[platform])} AS discounts,
            COUNT(*) AS orders
        FROM raw_{platform}_orders WHERE {_since(30, created)} AND {_counted(platform)}
        GROUP BY CAST({created} AS DATE)"""


_PERIODS = f"""(VALUES
    ('today', {AS_OF}, {AS_OF} + 1), ('yesterday', {AS_OF} - 1, {AS_OF}),
    ('this_week', CAST(date_trunc('week', {AS_OF}) AS DATE), {AS_OF} + 1),
    ('last_week', CAST(date_trunc('week', {AS_OF}) AS DATE) - 7, CAST(date_trunc('week', {AS_OF}) AS DATE)),
    ('this_month', {_THIS_MONTH}, {AS_OF} + 1), ('last_month', {_LAST_MONTH}, {_THIS_MONTH})
    ) AS t(period, first_day, next_day)"""


def _comparison(platform: str) -> str:
    created = f"CAST({CREATED[platform]} AS DATE)"
    return f"""
        SELECT t.period, {_sum0("x.amount")} AS revenue, {_sum0("x.discount")} AS discounts,
            COUNT(x.created) AS orders
        FROM {_PERIODS} LEFT JOIN (
            SELECT {created} AS created, {AMOUNT[platform]} AS amount, {DISCOUNT[platform]} AS discount
            FROM raw_{platform}_orders WHERE {_counted(platform)}) x
        ON x.created >= t.first_day AND x.created < t.next_day GROUP BY t.period"""


def _dq(model: str, column: str, test: str, failures: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{column}' AS column_name, '{test}' AS test, "
        f"{_big(f'({failures})')} AS failures"
    )


def _dq_suite() -> str:
    checks = []

    def unique(model: str, column: str, source: str) -> None:
        checks.append(_dq(model, column, "unique", f"SELECT COUNT(*) FROM (SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} HAVING COUNT(*) > 1)"))

    def not_null(model: str, column: str, source: str) -> None:
        checks.append(_dq(model, column, "not_null", f"SELECT COUNT(*) FROM {source} WHERE {column} IS NULL"))

    for model, column in (
        ("stg_shopify_orders", "order_id"),
        ("stg_shopify_products", "product_id"),
        ("stg_shopify_customers", "customer_id"),
        ("stg_shopify_order_items", "line_item_id"),
        ("kpi_platform_overview", "platform"),
        ("kpi_daily_snapshot", "order_date"),
    ):
        unique(model, column, model)
        not_null(model, column, model)
    for model, column in (
        ("stg_shopify_order_items", "order_id"),
        ("int_unified_orders", "order_id"),
        ("int_unified_orders", "platform"),
        ("int_unified_order_items", "line_item_id"),
        ("int_unified_order_items", "order_id"),
        ("int_unified_order_items", "platform"),
        ("kpi_revenue_summary", "order_date"),
        ("kpi_revenue_summary", "platform"),
        ("kpi_product_performance", "product_id"),
    ):
        not_null(model, column, model)
    checks.append(_dq("int_unified_orders", "platform", "accepted_values", "SELECT COUNT(DISTINCT platform) FROM int_unified_orders WHERE platform NOT IN ('shopify', 'amazon', 'lazada', 'shopee')"))
    return " UNION ALL ".join(checks)


RELATIONS["stg_shopify_products"] = """
    SELECT CAST(id AS VARCHAR) AS product_id, 'shopify' AS platform, title AS product_name,
        handle AS product_slug, product_type AS category, vendor AS brand,
        CAST(variants->>'$[0].price' AS DECIMAL(12,2)) AS price,
        CAST(variants->>'$[0].compare_at_price' AS DECIMAL(12,2)) AS compare_at_price,
        variants->>'$[0].sku' AS sku,
        CAST(variants->>'$[0].inventory_quantity' AS INTEGER) AS inventory_quantity,
        status AS product_status, published_at, body_html AS description, tags AS product_tags,
        images->>'$[0].src' AS primary_image_url, created_at, updated_at
    FROM raw_shopify_products"""
PRODUCT_STAGE_KINDS = _kinds(
    "product_id, platform, product_name, product_slug, category, brand, sku, product_status,"
    "published_at, description, product_tags, primary_image_url, created_at, updated_at",
    "price compare_at_price",
    "inventory_quantity",
)

RELATIONS["stg_shopify_customers"] = """
    SELECT CAST(id AS VARCHAR) AS customer_id, 'shopify' AS platform, email AS customer_email,
        phone AS customer_phone, first_name, last_name, concat(first_name, ' ', last_name) AS full_name,
        default_address->>'$.city' AS city, default_address->>'$.province' AS state_province,
        default_address->>'$.country' AS country, default_address->>'$.country_code' AS country_code,
        orders_count AS total_orders, total_spent, state AS customer_status,
        verified_email AS is_email_verified, accepts_marketing, tags AS customer_tags,
        created_at, updated_at
    FROM raw_shopify_customers"""
CUSTOMER_STAGE_KINDS = _kinds(
    "customer_id, platform, customer_email, customer_phone, first_name, last_name, full_name, city,"
    "state_province, country, country_code, customer_status, is_email_verified, accepts_marketing,"
    "customer_tags, created_at, updated_at",
    "total_spent",
    "total_orders",
)

_PLATFORM_INFO = """(VALUES ('shopify', 'Shopify', 'USD', 'Global'), ('amazon', 'Amazon', 'USD', 'Global'),
    ('lazada', 'Lazada', 'PHP', 'Southeast Asia'), ('shopee', 'Shopee', 'PHP', 'Southeast Asia')
    ) AS m(platform, platform_display_name, default_currency, region)"""

_RANGE_30 = f"order_date BETWEEN {AS_OF} - 30 AND {AS_OF}"

RELATIONS["recent_days"] = f"""
    SELECT * FROM kpi_daily_snapshot WHERE order_date BETWEEN {AS_OF} - 7 AND {AS_OF}
    ORDER BY order_date DESC LIMIT 7"""

RELATIONS["dashboard_totals"] = f"""
    SELECT SUM(total_revenue_usd) AS revenue, {_big("SUM(total_orders)")} AS orders,
        SUM(revenue_this_month_usd) AS this_month, SUM(revenue_last_month_usd) AS last_month,
        {_big("SUM(orders_this_month)")} AS orders_this_month,
        {_big("SUM(orders_last_month)")} AS orders_last_month
    FROM kpi_platform_overview"""

# Half-even rounding in whole hundredths; amounts are not negative.
_HALF_EVEN = """CAST({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END
    AS DOUBLE) / 100.0"""


def _half_even(numerator: str, divisor: str) -> str:
    """round(numerator / divisor, 2) with numerator in units of 1e-8."""
    n, d = f"CAST(({numerator}) * 100000000 AS HUGEINT)", f"(1000000 * CAST({divisor} AS HUGEINT))"
    return _HALF_EVEN.format(q=f"({n} // {d})", r=f"({n} % {d})", d=d)


DASHBOARD = f"""
    SELECT {_half_even("revenue", "1")} AS total_revenue_usd, orders AS total_orders,
        CASE WHEN orders > 0 THEN {_half_even("revenue", "orders")} ELSE 0 END AS avg_order_value_usd,
        {_growth("this_month", "last_month", 8, half_even=True)} AS revenue_growth_pct,
        {_growth("orders_this_month", "orders_last_month", 0, half_even=True)} AS orders_growth_pct,
        CAST(0 AS BIGINT) AS total_customers,
        (SELECT string_agg(platform || ':' || total_orders, ',' ORDER BY kpi_platform_overview.total_revenue_usd
            DESC NULLS FIRST, platform) FROM kpi_platform_overview) AS platforms,
        (SELECT string_agg(strftime(order_date, '%Y-%m-%d') || ':' || recent_days.total_orders, ',' ORDER BY order_date DESC)
            FROM recent_days) AS recent_days
    FROM dashboard_totals"""


def _money_text(value: str) -> str:
    """$1,234 or -$1,234, rounded half away from zero."""
    return (
        f"(CASE WHEN {value} < 0 THEN '-' ELSE '' END || '$' || "
        f"format('{{:,}}', CAST(ABS(ROUND({value}, 0)) AS BIGINT)))"
    )


def _percent_text(hundredths: str) -> str:
    """+1.2% from a percentage given in hundredths of a percent, half away from zero."""
    tenths = f"(CAST(SIGN({hundredths}) AS BIGINT) * ((ABS({hundredths}) + 5) // 10))"
    return (
        f"(CASE WHEN {hundredths} >= 0 THEN '+' WHEN {tenths} <= 0 THEN '-' ELSE '' END || "
        f"(ABS({tenths}) // 10) || '.' || (ABS({tenths}) % 10) || '%')"
    )


def _compact(value: str) -> str:
    def scaled(unit: int) -> str:
        tenths = f"((20 * {value} + {unit}) // {2 * unit})"
        return f"({tenths} // 10) || '.' || ({tenths} % 10)"

    return (
        f"CASE WHEN {value} >= 1000000 THEN {scaled(1_000_000)} || 'M' "
        f"WHEN {value} >= 1000 THEN {scaled(1000)} || 'K' ELSE CAST({value} AS VARCHAR) END"
    )


def _hundredths(column: str) -> str:
    return f"CAST(ROUND({column} * 100) AS BIGINT)"


FORMATTED_PLATFORMS = f"""
    SELECT platform, {_money_text("total_revenue_usd")} AS total_revenue_formatted,
        {_money_text("revenue_this_month_usd")} AS revenue_this_month_formatted,
        {_money_text("revenue_today_usd")} AS revenue_today_formatted,
        {_percent_text(_hundredths("revenue_mom_growth_pct"))} AS revenue_growth_formatted,
        {_percent_text(_hundredths("orders_mom_growth_pct"))} AS orders_growth_formatted,
        {_compact("total_orders")} AS total_orders_formatted,
        platform_display_name AS platform_name
    FROM kpi_platform_overview JOIN {_PLATFORM_INFO} USING (platform)"""

FORMATTED_DASHBOARD = f"""
    SELECT {_money_text(_half_even("revenue", "1"))} AS total_revenue_formatted,
        {_money_text(_half_even("revenue", "orders"))} AS avg_order_value_formatted,
        (SELECT string_agg(platform || ':' || {_money_text("total_revenue_usd")} || ':' ||
            {_money_text("revenue_this_month_usd")} || ':' || {_money_text("revenue_today_usd")}, ';'
            ORDER BY kpi_platform_overview.total_revenue_usd DESC NULLS FIRST, platform)
            FROM kpi_platform_overview) AS platforms
    FROM dashboard_totals"""

_MODELS = (
    *(f"stg_{p}_{kind}" for p in PLATFORMS for kind in ("orders", "order_items")),
    "stg_shopify_products",
    "stg_shopify_customers",
    "int_unified_orders",
    "int_unified_order_items",
    "kpi_daily_snapshot",
    "kpi_platform_overview",
    "kpi_revenue_summary",
    "kpi_product_performance",
)


def queries() -> dict[str, str]:
    """Query name -> bare SQL over RELATIONS."""
    sql: dict[str, str] = {}
    for platform in PLATFORMS:
        sql[f"stg_{platform}_orders"] = _plain(ORDER_KINDS, f"stg_{platform}_orders")
        sql[f"stg_{platform}_order_items"] = _plain(ITEM_KINDS, f"stg_{platform}_order_items")
    sql["stg_shopify_products"] = _plain(PRODUCT_STAGE_KINDS, "stg_shopify_products")
    sql["stg_shopify_customers"] = _plain(CUSTOMER_STAGE_KINDS, "stg_shopify_customers")
    sql["int_unified_orders"] = _plain(UNIFIED_KINDS, "int_unified_orders")
    sql["int_unified_order_items"] = _plain(ITEM_KINDS, "int_unified_order_items")

    def columns_of(names: str) -> str:
        return _plain({name: UNIFIED_KINDS[name] for name in names.split()}, "int_unified_orders")

    sql["currency_conversion"] = columns_of("order_id platform currency_code total_amount total_amount_usd")
    sql["date_dims"] = columns_of("order_id platform order_date order_week order_month order_quarter order_year")
    sql["time_dims"] = columns_of("order_id platform order_hour order_day_of_week")
    sql["status_flags"] = columns_of("order_id platform is_paid is_fulfilled is_cancelled")
    sql["status_standardized"] = """
        SELECT order_id, platform, status, CASE
            WHEN platform = 'shopify' AND status = 'paid' THEN 'completed'
            WHEN platform = 'amazon' AND status = 'Shipped' THEN 'completed'
            WHEN platform = 'amazon' AND status = 'Pending' THEN 'pending'
            WHEN platform = 'amazon' AND status = 'Canceled' THEN 'cancelled'
            WHEN platform = 'lazada' AND status = 'delivered' THEN 'completed'
            WHEN platform = 'lazada' AND status = 'canceled' THEN 'cancelled'
            WHEN platform = 'shopee' AND status = 'COMPLETED' THEN 'completed'
            WHEN platform = 'shopee' AND status = 'READY_TO_SHIP' THEN 'processing'
            WHEN platform = 'shopee' AND status = 'CANCELLED' THEN 'cancelled'
            ELSE status END AS standard_status
        FROM (SELECT *, CASE WHEN platform = 'shopify' THEN payment_status ELSE fulfillment_status END
            AS status FROM int_unified_orders)"""
    sql["platform_info"] = f"""
        SELECT order_id, platform, platform_display_name, default_currency, region
        FROM int_unified_orders LEFT JOIN {_PLATFORM_INFO} USING (platform)"""

    sql["kpi_daily_snapshot"] = _plain(DAILY_KINDS, "kpi_daily_snapshot")
    sql["kpi_platform_overview"] = _plain(OVERVIEW_KINDS, "kpi_platform_overview")
    sql["kpi_product_performance"] = _plain(PRODUCT_KINDS, "kpi_product_performance")
    sql["kpi_product_performance_spread"] = sql["kpi_product_performance"]
    sql["kpi_revenue_summary"] = _plain(REVENUE_KINDS, "kpi_revenue_summary")

    sql["platform_overview"] = _plain(OVERVIEW_KINDS, "kpi_platform_overview")
    sql["daily_snapshots"] = _plain(
        DAILY_KINDS, "kpi_daily_snapshot", f"WHERE {_RANGE_30} ORDER BY order_date DESC LIMIT 30"
    )
    sql["revenue_by_platform"] = _plain(REVENUE_KINDS, "kpi_revenue_summary", f"WHERE {_RANGE_30}")
    sql["revenue_by_platform_shopee"] = _plain(
        REVENUE_KINDS, "kpi_revenue_summary", f"WHERE platform = 'shopee' AND {_RANGE_30}"
    )
    by_revenue = """ORDER BY kpi_product_performance.total_revenue DESC NULLS FIRST, platform, product_id,
        product_name, sku LIMIT 50"""
    sql["product_performance"] = _plain(PRODUCT_KINDS, "kpi_product_performance", by_revenue)
    sql["product_performance_tier"] = _plain(
        PRODUCT_KINDS,
        "kpi_product_performance",
        f"WHERE platform = 'lazada' AND performance_tier = 'Top Performer' {by_revenue}",
    )
    sql["dashboard_summary"] = DASHBOARD
    sql["today_summary"] = _plain(DAILY_KINDS, "kpi_daily_snapshot", f"WHERE order_date = {AS_OF}")

    sql["top_products_shopify"] = f"""
        SELECT p.title AS product_name, COALESCE(p.product_type, 'Uncategorized') AS category,
            COALESCE(p.vendor, 'Unknown') AS vendor, COUNT(DISTINCT li.order_id) AS total_orders,
            {_big("SUM(li.quantity)")} AS units_sold, {_sum0("li.price * li.quantity")} AS total_revenue,
            {_avg("li.price")} AS avg_price, 'shopify' AS platform
        FROM {_SHOPIFY_LINES} GROUP BY p.id, p.title, p.product_type, p.vendor
        ORDER BY SUM(li.price * li.quantity) DESC NULLS FIRST, p.id LIMIT 20"""
    sql["category_performance"] = f"""
        SELECT COALESCE(p.product_type, 'Uncategorized') AS category, COUNT(DISTINCT p.id) AS product_count,
            {_big("SUM(li.quantity)")} AS units_sold, {_sum0("li.price * li.quantity")} AS total_revenue
        FROM {_SHOPIFY_LINES} GROUP BY p.product_type"""
    sql["product_summary"] = f"""
        SELECT COUNT(DISTINCT p.id) AS total_products, COUNT(DISTINCT li.order_id) AS orders_with_products,
            {_big("COALESCE(SUM(li.quantity), 0)")} AS total_units_sold,
            {_sum0("li.price * li.quantity")} AS total_revenue,
            COALESCE({_avg("li.price * li.quantity")}, 0) AS avg_item_value,
            CAST(30 AS BIGINT) AS period_days, 'shopify' AS platform
        FROM {_SHOPIFY_LINES}"""
    for platform in ("amazon", "lazada", "shopee"):
        sql[f"top_products_{platform}"] = f"SELECT * FROM top_{platform}"
        # The listed revenues have two digits; they are summed as such, not as doubles.
        revenue = "SUM(CAST(total_revenue AS DECIMAL(30,2)))"
        sql[f"top_products_rollup_{platform}"] = f"""
            SELECT COUNT(*) AS total_products,
                {_big("COALESCE(SUM(total_orders), 0)")} AS orders_with_products,
                {_big("COALESCE(SUM(units_sold), 0)")} AS total_units_sold,
                COALESCE({_dbl(revenue)}, 0) AS total_revenue,
                COALESCE({_dbl(revenue)} / GREATEST(COUNT(*), 1), 0) AS avg_item_value,
                CAST(30 AS BIGINT) AS period_days, '{platform}' AS platform,
                '{platform.capitalize()} Products' AS category
            FROM top_{platform}"""
    sql["trending_products"] = _trending()

    for platform in PLATFORMS:
        sql[f"customer_summary_{platform}"] = _customer_summary(platform)
        sql[f"top_customers_{platform}"] = _top_customers(platform)
        sql[f"customer_acquisition_{platform}"] = _acquisition(platform)
        sql[f"by_country_{platform}"] = f"SELECT * FROM countries_{platform}"
        sql[f"by_city_{platform}"] = f"SELECT * FROM cities_{platform}"
        sql[f"location_summary_{platform}"] = _location_summary(platform)
        sql[f"platform_profitability_{platform}"] = _profitability(platform)
        sql[f"platform_profitability_daily_{platform}"] = _profitability_daily(platform)
        sql[f"profitability_comparison_{platform}"] = _comparison(platform)
    sql["customer_segments"] = f"""
        SELECT CASE WHEN total_spent >= 1000 THEN 'VIP' WHEN total_spent >= 500 THEN 'High Value'
            WHEN total_spent >= 100 THEN 'Regular' WHEN total_spent > 0 THEN 'Low Value'
            ELSE 'No Purchases' END AS segment, COUNT(*) AS customer_count,
            COALESCE({_avg("total_spent")}, 0) AS avg_spent, {_sum0("total_spent")} AS total_spent
        FROM raw_shopify_customers GROUP BY 1"""
    sql["customer_cohorts"] = f"""
        SELECT strftime(created_at, '%Y-%m') AS cohort_month, COUNT(*) AS customers,
            COALESCE({_avg("orders_count")}, 0) AS avg_orders, COALESCE({_avg("total_spent")}, 0) AS avg_ltv
        FROM raw_shopify_customers WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12"""
    sql["customer_retention"] = f"""
        SELECT CASE WHEN orders_count <= 1 THEN 'New' WHEN orders_count <= 3 THEN 'Returning'
            ELSE 'Loyal' END AS customer_type, COUNT(*) AS count,
            COALESCE({_avg("total_spent")}, 0) AS avg_spent
        FROM raw_shopify_customers GROUP BY 1"""

    sql["profitability_by_platform"] = f"""
        SELECT platform, {_dbl("gross_revenue")} AS gross_revenue, {_dbl("discounts")} AS discounts, orders
        FROM profit_platforms"""
    sql["profitability_summary"] = f"""
        SELECT {_dbl("gross")} AS gross_revenue, {_dbl("discounts")} AS total_discounts,
            {_dbl("gross - discounts")} AS net_revenue, orders AS total_orders,
            CASE WHEN orders > 0 THEN {_dbl("gross")} / orders ELSE 0 END AS avg_order_value,
            CASE WHEN gross > 0 THEN {_dbl("discounts")} / {_dbl("gross")} * 100 ELSE 0 END AS discount_rate
        FROM (SELECT SUM(gross_revenue) AS gross, SUM(discounts) AS discounts, {_big("SUM(orders)")} AS orders
            FROM profit_platforms)"""

    text_columns = """platform, currency_code, CAST(COUNT(*) AS VARCHAR) AS orders,
        CAST(SUM(total_amount) AS VARCHAR) AS gross_amount, CAST(MAX(order_updated_at) AS VARCHAR) AS updated_at"""
    sql["guarded_sql"] = f"SELECT {text_columns} FROM int_unified_orders GROUP BY platform, currency_code"
    sql["bound_sql"] = """
        SELECT platform, CAST(COUNT(*) AS VARCHAR) AS orders, CAST(SUM(total_amount) AS VARCHAR) AS gross_amount
        FROM int_unified_orders WHERE platform = 'lazada' AND order_date >= DATE '2000-01-01'
        GROUP BY platform"""
    sql["table_preview"] = """
        SELECT platform, CAST(CAST(gross_revenue AS DECIMAL(22,2)) AS VARCHAR) AS gross_revenue,
            CAST(CAST(discounts AS DECIMAL(22,2)) AS VARCHAR) AS discounts, CAST(orders AS VARCHAR) AS orders
        FROM profit_platforms"""

    sql["dq_unique"] = """
        SELECT line_item_id AS unique_field, COUNT(*) AS n_records FROM int_unified_order_items
        GROUP BY line_item_id HAVING COUNT(*) > 1"""
    sql["dq_not_null"] = "SELECT product_id, platform, product_name FROM stg_shopify_products WHERE category IS NULL"
    sql["dq_accepted_values"] = """
        SELECT fulfillment_status AS value_field, COUNT(*) AS n_records FROM int_unified_orders
        WHERE fulfillment_status NOT IN ('fulfilled', 'shipped', 'delivered', 'COMPLETED', 'Shipped')
        GROUP BY fulfillment_status"""
    sql["dq_suite"] = sql["dq_observed"] = _dq_suite()

    sql["fmt_platforms"] = FORMATTED_PLATFORMS
    sql["fmt_dashboard"] = FORMATTED_DASHBOARD

    sql["model_row_counts"] = " UNION ALL ".join(
        f"SELECT '{name}' AS model, (SELECT COUNT(*) FROM {name}) AS n_rows" for name in _MODELS
    )
    sql["incremental_revenue_summary"] = _plain(REVENUE_KINDS, "kpi_revenue_summary_changed")
    sql["incremental_daily_snapshot"] = _plain(DAILY_KINDS, "kpi_daily_snapshot_changed")
    sql["incremental_platform_overview"] = _plain(OVERVIEW_KINDS, "kpi_platform_overview_changed")
    lines = "raw_amazon_order_items WHERE quantity_ordered >= 40 AND item_price IS NOT NULL"
    sql["staging_rejects"] = f"""
        SELECT * FROM (
            SELECT 'stg_amazon_orders' AS model, 'order_total' AS column_name, 'unreadable' AS reason, COUNT(*) AS n_rows
            FROM raw_amazon_orders WHERE order_status = 'Canceled' AND order_total IS NOT NULL
            UNION ALL SELECT 'stg_amazon_orders', 'order_total', 'no number: Amount', COUNT(*)
            FROM raw_amazon_orders WHERE order_status = 'Pending'
            UNION ALL SELECT 'stg_amazon_order_items', 'item_price', 'unreadable', COUNT(*) FROM {lines})
        WHERE n_rows > 0"""
    sql["dq_readable"] = f"""
        SELECT v.model, v.column_name, 'readable' AS test, CASE v.column_name
            WHEN 'order_total' THEN (SELECT COUNT(*) FROM raw_amazon_orders
                WHERE order_status = 'Pending' OR order_status = 'Canceled' AND order_total IS NOT NULL)
            WHEN 'item_price' THEN (SELECT COUNT(*) FROM {lines}) ELSE 0 END AS failures
        FROM (VALUES ('stg_shopify_products', 'variants'), ('stg_shopify_products', 'images'),
            ('stg_shopify_customers', 'default_address'), ('stg_amazon_orders', 'order_total'),
            ('stg_amazon_order_items', 'item_price'), ('stg_amazon_order_items', 'promotion_discount')) v(model, column_name)"""
    sql["staged_with_rejects"] = f"""
        SELECT fulfillment_status, COUNT(*) AS orders,
            COUNT(CASE WHEN fulfillment_status NOT IN ('Canceled', 'Pending') THEN total_amount END) AS amounts,
            {_dbl("SUM(CASE WHEN fulfillment_status NOT IN ('Canceled', 'Pending') THEN total_amount END)")} AS total_amount
        FROM stg_amazon_orders GROUP BY fulfillment_status"""
    sql["stored_marts"] = _plain(
        REVENUE_KINDS, "kpi_revenue_summary"
    )
    sql["live_daily_revenue"] = f"""
        SELECT order_date, platform, COUNT(*) AS orders, {_dbl("SUM(total_amount_usd)")} AS revenue_usd
        FROM int_unified_orders WHERE NOT is_cancelled GROUP BY order_date, platform"""
    sql["live_corrected_revenue"] = f"""
        SELECT order_date, platform, COUNT(*) AS orders,
            {_dbl("COALESCE(SUM(total_amount_usd * CASE WHEN payment_status = 'pending' THEN 2 ELSE 1 END), 0)")} AS revenue_usd,
            {_big("COALESCE(SUM(item_count + CASE WHEN payment_status = 'pending' THEN 1 ELSE 0 END), 0)")} AS items_sold
        FROM int_unified_orders
        WHERE NOT is_cancelled AND NOT COALESCE(fulfillment_status IN ('shipped', 'SHIPPED', 'Shipped'), FALSE)
        GROUP BY order_date, platform"""
    sql["upsert_items"] = f"""
        SELECT order_item_id, order_id, product_id, name, variation, sku, {_dbl("paid_price")} AS paid_price,
            {_dbl("voucher_amount")} AS voucher_amount,
            CASE WHEN status = 'delivered' THEN 'returned' ELSE status END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY order_item_id ORDER BY status = 'delivered' DESC,
                order_id DESC, product_id DESC, name DESC, sku DESC, paid_price DESC) AS nth
            FROM raw_lazada_order_items)
        WHERE nth = 1"""
    sql["upsert_raw"] = f"""
        SELECT id, updated_at + CASE WHEN financial_status = 'pending' THEN INTERVAL 1 DAY
                ELSE INTERVAL 0 DAY END AS updated_at,
            CASE WHEN financial_status = 'pending' THEN 'paid' ELSE financial_status END AS financial_status,
            {_dbl("total_price")} AS total_price
        FROM raw_shopify_orders"""
    return sql
