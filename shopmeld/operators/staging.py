"""Staging: one raw row in, one canonical row out (rename, cast, JSON fields, constants)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeld import config
from shopmeld.functions.columns import joined_name, ntz_from_epoch, null_of

MONEY = "decimal(12,2)"
TIME = "timestamp_ntz"


def _money(value: Column) -> Column:
    return value.cast(MONEY)


def _money_or_zero(value: Column) -> Column:
    return F.coalesce(_money(value), F.lit(0).cast(MONEY))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _project(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    stamped = {**columns, "_loaded_at": F.current_timestamp()}
    return df.select(*(column.alias(name) for name, column in stamped.items()))


def stg_shopify_orders(raw: DataFrame) -> DataFrame:
    return _project(
        raw,
        {
            "order_id": _text("id"),
            "platform": F.lit("shopify"),
            "order_created_at": F.col("created_at").cast(TIME),
            "order_updated_at": F.col("updated_at").cast(TIME),
            "order_processed_at": F.col("processed_at").cast(TIME),
            "order_cancelled_at": F.col("cancelled_at").cast(TIME),
            "order_closed_at": F.col("closed_at").cast(TIME),
            "customer_id": _text("customer_id"),
            "customer_email": F.col("email"),
            "total_amount": _money(F.col("total_price")),
            "subtotal_amount": _money(F.col("subtotal_price")),
            "tax_amount": _money(F.col("total_tax")),
            "discount_amount": _money(F.col("total_discounts")),
            "currency_code": F.col("currency"),
            "payment_status": F.col("financial_status"),
            "fulfillment_status": F.col("fulfillment_status"),
            "cancel_reason": F.col("cancel_reason"),
            "item_count": F.coalesce("line_items_count", F.lit(0)),
            "order_source": F.col("source_name"),
            "order_tags": F.col("tags"),
            "order_notes": F.col("note"),
        },
    )


def stg_shopify_order_items(raw: DataFrame) -> DataFrame:
    return _project(
        raw,
        {
            "line_item_id": _text("id"),
            "order_id": _text("order_id"),
            "product_id": _text("product_id"),
            "variant_id": _text("variant_id"),
            "platform": F.lit("shopify"),
            "product_name": F.col("title"),
            "variant_title": F.col("variant_title"),
            "sku": F.col("sku"),
            "quantity": F.col("quantity").cast("int"),
            "unit_price": _money(F.col("price")),
            "line_total": _money(F.col("quantity") * F.col("price")),
            "discount_amount": _money_or_zero(F.col("total_discount")),
            "fulfillment_status": F.col("fulfillment_status"),
            "fulfillable_quantity": F.col("fulfillable_quantity").cast("int"),
            "is_gift_card": F.col("gift_card"),
            "is_taxable": F.col("taxable"),
            "requires_shipping": F.col("requires_shipping"),
        },
    )


def stg_shopify_products(raw: DataFrame) -> DataFrame:
    """Price, SKU and stock come from the first variant, the picture from the first image."""
    variant = "array<struct<price:string,compare_at_price:string,sku:string,inventory_quantity:string>>"
    parsed = raw.withColumns(
        {
            "variant": F.get(F.from_json("variants", variant), F.lit(0)),
            "image": F.get(F.from_json("images", "array<struct<src:string>>"), F.lit(0)),
        }
    )
    return _project(
        parsed,
        {
            "product_id": _text("id"),
            "platform": F.lit("shopify"),
            "product_name": F.col("title"),
            "product_slug": F.col("handle"),
            "category": F.col("product_type"),
            "brand": F.col("vendor"),
            "price": _money(F.col("variant.price")),
            "compare_at_price": _money(F.col("variant.compare_at_price")),
            "sku": F.col("variant.sku"),
            "inventory_quantity": F.col("variant.inventory_quantity").cast("int"),
            "product_status": F.col("status"),
            "published_at": F.col("published_at").cast(TIME),
            "description": F.col("body_html"),
            "product_tags": F.col("tags"),
            "primary_image_url": F.col("image.src"),
            "created_at": F.col("created_at").cast(TIME),
            "updated_at": F.col("updated_at").cast(TIME),
        },
    )


def stg_shopify_customers(raw: DataFrame) -> DataFrame:
    address = "city string, province string, country string, country_code string"
    return _project(
        raw.withColumn("address", F.from_json("default_address", address)),
        {
            "customer_id": _text("id"),
            "platform": F.lit("shopify"),
            "customer_email": F.col("email"),
            "customer_phone": F.col("phone"),
            "first_name": F.col("first_name"),
            "last_name": F.col("last_name"),
            "full_name": joined_name(F.col("first_name"), F.col("last_name")),
            "city": F.col("address.city"),
            "state_province": F.col("address.province"),
            "country": F.col("address.country"),
            "country_code": F.col("address.country_code"),
            "total_orders": F.col("orders_count").cast("int"),
            "total_spent": _money(F.col("total_spent")),
            "customer_status": F.col("state"),
            "is_email_verified": F.col("verified_email"),
            "accepts_marketing": F.col("accepts_marketing"),
            "customer_tags": F.col("tags"),
            "created_at": F.col("created_at").cast(TIME),
            "updated_at": F.col("updated_at").cast(TIME),
        },
    )


def stg_amazon_orders(raw: DataFrame) -> DataFrame:
    """Money sits in a JSON object; the payment method stands in for the payment status."""
    parsed = raw.withColumn("total", F.from_json("order_total", "Amount string, CurrencyCode string"))
    return _project(
        parsed,
        {
            "order_id": _text("amazon_order_id"),
            "platform": F.lit("amazon"),
            "order_created_at": F.col("purchase_date").cast(TIME),
            "order_updated_at": F.col("last_update_date").cast(TIME),
            "order_processed_at": null_of(TIME),
            "order_cancelled_at": null_of(TIME),
            "order_closed_at": null_of(TIME),
            "customer_id": F.col("buyer_email"),
            "customer_email": F.col("buyer_email"),
            "total_amount": _money(F.col("total.Amount")),
            "subtotal_amount": _money(F.col("total.Amount")),
            "tax_amount": _money(F.lit(0)),
            "discount_amount": _money(F.lit(0)),
            "currency_code": F.col("total.CurrencyCode"),
            "payment_status": F.col("payment_method"),
            "fulfillment_status": F.col("order_status"),
            "cancel_reason": null_of("string"),
            "item_count": F.col("number_of_items_shipped") + F.col("number_of_items_unshipped"),
            "order_source": F.col("sales_channel"),
            "order_tags": null_of("string"),
            "order_notes": null_of("string"),
        },
    )


def stg_amazon_order_items(raw: DataFrame) -> DataFrame:
    parsed = raw.withColumns(
        {
            "amount": _money(F.get_json_object("item_price", "$.Amount")),
            "promotion": F.get_json_object("promotion_discount", "$.Amount"),
        }
    )
    return _project(
        parsed,
        {
            "line_item_id": _text("order_item_id"),
            "order_id": _text("amazon_order_id"),
            "product_id": _text("asin"),
            "variant_id": null_of("string"),
            "platform": F.lit("amazon"),
            "product_name": F.col("title"),
            "variant_title": null_of("string"),
            "sku": F.col("seller_sku"),
            "quantity": F.col("quantity_ordered").cast("int"),
            "unit_price": F.col("amount") / F.nullif(F.col("quantity_ordered"), F.lit(0)),
            "line_total": F.col("amount"),
            "discount_amount": _money_or_zero(F.col("promotion")),
            "fulfillment_status": F.when(F.col("quantity_shipped") > 0, "shipped").otherwise("pending"),
            "fulfillable_quantity": (F.col("quantity_ordered") - F.col("quantity_shipped")).cast("int"),
            "is_gift_card": F.lit(False),
            "is_taxable": F.lit(True),
            "requires_shipping": F.lit(True),
        },
    )


def stg_lazada_orders(raw: DataFrame) -> DataFrame:
    return _project(
        raw,
        {
            "order_id": _text("order_id"),
            "platform": F.lit("lazada"),
            "order_created_at": F.col("created_at").cast(TIME),
            "order_updated_at": F.col("updated_at").cast(TIME),
            "order_processed_at": null_of(TIME),
            "order_cancelled_at": null_of(TIME),
            "order_closed_at": null_of(TIME),
            "customer_id": _text("customer_id"),
            "customer_email": F.col("buyer_email"),
            "total_amount": _money(F.col("price")),
            "subtotal_amount": _money(F.col("price")),
            "tax_amount": _money(F.lit(0)),
            "discount_amount": _money_or_zero(F.col("voucher")),
            "currency_code": F.lit("PHP"),
            "payment_status": F.col("payment_method"),
            "fulfillment_status": F.col("statuses"),
            "cancel_reason": null_of("string"),
            "item_count": F.col("items_count").cast("int"),
            "order_source": F.lit("lazada"),
            "order_tags": null_of("string"),
            "order_notes": F.col("remarks"),
        },
    )


def stg_lazada_order_items(raw: DataFrame) -> DataFrame:
    """Every row is one unit."""
    return _project(
        raw,
        {
            "line_item_id": _text("order_item_id"),
            "order_id": _text("order_id"),
            "product_id": _text("product_id"),
            "variant_id": null_of("string"),
            "platform": F.lit("lazada"),
            "product_name": F.col("name"),
            "variant_title": F.col("variation"),
            "sku": F.col("sku"),
            "quantity": F.lit(1),
            "unit_price": _money(F.col("paid_price")),
            "line_total": _money(F.col("paid_price")),
            "discount_amount": _money_or_zero(F.col("voucher_amount")),
            "fulfillment_status": F.col("status"),
            "fulfillable_quantity": F.lit(0),
            "is_gift_card": F.lit(False),
            "is_taxable": F.lit(True),
            "requires_shipping": F.lit(True),
        },
    )


def stg_shopee_orders(raw: DataFrame) -> DataFrame:
    """Times are epoch seconds; cancelled and closed times follow from the order status."""
    status = F.col("order_status")
    updated = ntz_from_epoch(F.col("update_time"))
    return _project(
        raw,
        {
            "order_id": _text("order_sn"),
            "platform": F.lit("shopee"),
            "order_created_at": ntz_from_epoch(F.col("create_time")),
            "order_updated_at": updated,
            "order_processed_at": ntz_from_epoch(F.col("pay_time")),
            "order_cancelled_at": F.when(status == "CANCELLED", updated),
            "order_closed_at": F.when(status == "COMPLETED", updated),
            "customer_id": _text("buyer_user_id"),
            "customer_email": F.col("buyer_username"),
            "total_amount": _money(F.col("total_amount")),
            "subtotal_amount": _money(
                F.col("total_amount") - F.coalesce("estimated_shipping_fee", F.lit(0))
            ),
            "tax_amount": _money(F.lit(0)),
            "discount_amount": _money_or_zero(F.col("voucher_absorbed")),
            "currency_code": F.col("currency"),
            "payment_status": F.when(status.isin(*config.SHOPEE_PAID_STATUSES), "paid")
            .when(status == "UNPAID", "pending")
            .otherwise("unknown"),
            "fulfillment_status": status,
            "cancel_reason": F.col("cancel_reason"),
            "item_count": F.lit(1),
            "order_source": F.lit("shopee"),
            "order_tags": null_of("string"),
            "order_notes": F.col("message_to_seller"),
        },
    )


def stg_shopee_order_items(raw: DataFrame) -> DataFrame:
    quantity = F.col("model_quantity_purchased")
    original, discounted = F.col("model_original_price"), F.col("model_discounted_price")
    return _project(
        raw,
        {
            "line_item_id": F.concat(_text("order_sn"), F.lit("_"), _text("item_id")),
            "order_id": _text("order_sn"),
            "product_id": _text("item_id"),
            "variant_id": _text("model_id"),
            "platform": F.lit("shopee"),
            "product_name": F.col("item_name"),
            "variant_title": F.col("model_name"),
            "sku": F.col("model_sku"),
            "quantity": quantity.cast("int"),
            "unit_price": _money(discounted),
            "line_total": _money(quantity * discounted),
            "discount_amount": _money_or_zero((original - discounted) * quantity),
            "fulfillment_status": F.lit("pending"),
            "fulfillable_quantity": F.lit(0),
            "is_gift_card": F.lit(False),
            "is_taxable": F.lit(True),
            "requires_shipping": F.lit(True),
        },
    )


# model name -> (raw table, staging function)
STAGING: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "stg_shopify_orders": ("shopify_orders", stg_shopify_orders),
    "stg_shopify_order_items": ("shopify_order_line_items", stg_shopify_order_items),
    "stg_shopify_products": ("shopify_products", stg_shopify_products),
    "stg_shopify_customers": ("shopify_customers", stg_shopify_customers),
    "stg_amazon_orders": ("amazon_orders", stg_amazon_orders),
    "stg_amazon_order_items": ("amazon_order_items", stg_amazon_order_items),
    "stg_lazada_orders": ("lazada_orders", stg_lazada_orders),
    "stg_lazada_order_items": ("lazada_order_items", stg_lazada_order_items),
    "stg_shopee_orders": ("shopee_orders", stg_shopee_orders),
    "stg_shopee_order_items": ("shopee_order_items", stg_shopee_order_items),
}


def stage(raw: Mapping[str, DataFrame], model: str) -> DataFrame:
    """Build one staging model from the raw tables."""
    table, build = STAGING[model]
    return build(raw[table])
