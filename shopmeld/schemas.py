"""Explicit schemas (DDL) of the 13 raw tables and column order of the two canonical relations."""

from __future__ import annotations

# JSON payload columns are strings; timestamps carry no zone.
RAW_SCHEMAS: dict[str, str] = {
    "shopify_customers": """id BIGINT, email STRING, phone STRING, first_name STRING, last_name STRING,
        default_address STRING, orders_count INT, total_spent DECIMAL(12,2), state STRING,
        verified_email BOOLEAN, accepts_marketing BOOLEAN, tags STRING,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "shopify_products": """id BIGINT, title STRING, handle STRING, product_type STRING, vendor STRING,
        variants STRING, status STRING, published_at TIMESTAMP_NTZ, body_html STRING,
        tags STRING, images STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "shopify_orders": """id BIGINT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ,
        processed_at TIMESTAMP_NTZ, cancelled_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ,
        customer_id BIGINT, email STRING, total_price DECIMAL(12,2),
        subtotal_price DECIMAL(12,2), total_tax DECIMAL(12,2), total_discounts DECIMAL(12,2),
        currency STRING, financial_status STRING, fulfillment_status STRING,
        cancel_reason STRING, shipping_lines STRING, line_items_count INT,
        source_name STRING, tags STRING, note STRING""",
    "shopify_order_line_items": """id BIGINT, order_id BIGINT, product_id BIGINT, variant_id BIGINT, title STRING,
        variant_title STRING, sku STRING, quantity INT, price DECIMAL(12,2),
        total_discount DECIMAL(12,2), fulfillment_status STRING, fulfillable_quantity INT,
        gift_card BOOLEAN, taxable BOOLEAN, requires_shipping BOOLEAN""",
    "amazon_orders": """amazon_order_id STRING, purchase_date TIMESTAMP_NTZ, last_update_date TIMESTAMP_NTZ,
        buyer_email STRING, order_total STRING, payment_method STRING, order_status STRING,
        shipping_address STRING, number_of_items_shipped INT, number_of_items_unshipped INT,
        sales_channel STRING""",
    "amazon_order_items": """order_item_id STRING, amazon_order_id STRING, asin STRING, title STRING,
        seller_sku STRING, quantity_ordered INT, quantity_shipped INT, item_price STRING,
        promotion_discount STRING""",
    "amazon_catalog_items": "asin STRING, title STRING, brand STRING",
    "lazada_orders": """order_id BIGINT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ,
        customer_id BIGINT, buyer_email STRING, price DECIMAL(12,2), items_count INT,
        voucher DECIMAL(12,2), payment_method STRING, statuses STRING,
        address_shipping STRING, remarks STRING""",
    "lazada_order_items": """order_item_id BIGINT, order_id BIGINT, product_id BIGINT, name STRING,
        variation STRING, sku STRING, paid_price DECIMAL(12,2), voucher_amount DECIMAL(12,2),
        status STRING""",
    "lazada_products": "item_id BIGINT, name STRING, sku_id STRING",
    "shopee_orders": """order_sn STRING, create_time BIGINT, update_time BIGINT, pay_time BIGINT,
        buyer_user_id BIGINT, buyer_username STRING, total_amount DECIMAL(12,2),
        estimated_shipping_fee DECIMAL(12,2), voucher_absorbed DECIMAL(12,2),
        currency STRING, order_status STRING, cancel_reason STRING, recipient_address STRING,
        item_list STRING, message_to_seller STRING""",
    "shopee_order_items": """id INT, order_sn STRING, item_id BIGINT, item_name STRING, model_id BIGINT,
        model_name STRING, model_sku STRING, model_quantity_purchased INT,
        model_original_price DECIMAL(12,2), model_discounted_price DECIMAL(12,2)""",
    "shopee_products": "item_id BIGINT, item_name STRING, item_sku STRING",
}

# Primary key of each raw table and its last-change column, where it has one.
RAW_KEYS: dict[str, tuple[str, str | None]] = {
    "shopify_customers": ("id", "updated_at"),
    "shopify_products": ("id", "updated_at"),
    "shopify_orders": ("id", "updated_at"),
    "amazon_orders": ("amazon_order_id", "last_update_date"),
    "lazada_orders": ("order_id", "updated_at"),
    "shopee_orders": ("order_sn", "update_time"),
    "shopify_order_line_items": ("id", None),
    "amazon_order_items": ("order_item_id", None),
    "lazada_order_items": ("order_item_id", None),
    "shopee_order_items": ("id", None),
    "amazon_catalog_items": ("asin", None),
    "lazada_products": ("item_id", None),
    "shopee_products": ("item_id", None),
}

ORDER_COLUMNS = (
    "order_id",
    "platform",
    "order_created_at",
    "order_updated_at",
    "order_processed_at",
    "order_cancelled_at",
    "order_closed_at",
    "customer_id",
    "customer_email",
    "total_amount",
    "subtotal_amount",
    "tax_amount",
    "discount_amount",
    "currency_code",
    "payment_status",
    "fulfillment_status",
    "cancel_reason",
    "item_count",
    "order_source",
    "order_tags",
    "order_notes",
    "_loaded_at",
)

ORDER_ITEM_COLUMNS = (
    "line_item_id",
    "order_id",
    "product_id",
    "variant_id",
    "platform",
    "product_name",
    "variant_title",
    "sku",
    "quantity",
    "unit_price",
    "line_total",
    "discount_amount",
    "fulfillment_status",
    "fulfillable_quantity",
    "is_gift_card",
    "is_taxable",
    "requires_shipping",
    "_loaded_at",
)

PLATFORM_INFO_SCHEMA = (
    "platform STRING, platform_display_name STRING, default_currency STRING, region STRING"
)
