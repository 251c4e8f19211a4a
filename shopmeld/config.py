"""Fixed values of the shop data model: platforms, rates, status words, thresholds."""

from __future__ import annotations

from decimal import Decimal

PLATFORMS = ("shopify", "amazon", "lazada", "shopee")

# US dollars per unit of currency; any other currency counts as USD.
USD_RATES = {
    "PHP": Decimal("0.018"),
    "MYR": Decimal("0.21"),
    "SGD": Decimal("0.74"),
    "IDR": Decimal("0.000063"),
}

# Status words behind the order flags.
PAID_STATUSES = ("paid", "authorized", "partially_paid")
FULFILLED_STATUSES = ("fulfilled", "shipped", "delivered", "COMPLETED", "Shipped")
SHOPEE_PAID_STATUSES = ("READY_TO_SHIP", "PROCESSED", "SHIPPED", "COMPLETED")

# Platform status word -> common status word.
STANDARD_STATUS = {
    "shopify": {"paid": "completed", "pending": "pending", "refunded": "refunded"},
    "amazon": {"Shipped": "completed", "Pending": "pending", "Canceled": "cancelled"},
    "lazada": {"delivered": "completed", "pending": "pending", "canceled": "cancelled"},
    "shopee": {
        "COMPLETED": "completed",
        "READY_TO_SHIP": "processing",
        "CANCELLED": "cancelled",
    },
}

# Lower bounds of the customer value segments, highest first.
CUSTOMER_SEGMENTS = (("VIP", 1000), ("High Value", 500), ("Regular", 100))

# Product tiers.
TOP_RANK = 10
TOP_PERCENTILE = 0.8
AVERAGE_PERCENTILE = 0.5

# Words that read-only SQL may not contain.
FORBIDDEN_SQL_WORDS = (
    "DROP",
    "DELETE",
    "UPDATE",
    "INSERT",
    "TRUNCATE",
    "ALTER",
    "CREATE",
    "GRANT",
)

# Platform, display name, default currency, region.
PLATFORM_INFO = (
    ("shopify", "Shopify", "USD", "Global"),
    ("amazon", "Amazon", "USD", "Global"),
    ("lazada", "Lazada", "PHP", "Southeast Asia"),
    ("shopee", "Shopee", "PHP", "Southeast Asia"),
)

# Amounts inside JSON payloads are held with so many digits behind the point.
PAYLOAD_DIGITS = 6

# Columns that record when a row was built; they differ from run to run.
STAMP_COLUMNS = ("_loaded_at", "_generated_at")


def check_platform(platform: str | None) -> str:
    """Return the platform in lower case; no platform means Shopify, an unknown one is an error."""
    name = (platform or "shopify").lower()
    if name not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}; expected one of {PLATFORMS}")
    return name
