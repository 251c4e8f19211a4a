"""Presentation columns for the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeld.functions.columns import compact_text, currency_text, percent_text

_PLATFORM_MONEY = {
    "total_revenue_formatted": "total_revenue_usd",
    "revenue_this_month_formatted": "revenue_this_month_usd",
    "revenue_today_formatted": "revenue_today_usd",
}


def formatted_platforms(overview: DataFrame, mappings: DataFrame) -> DataFrame:
    """Platform rows with currency, growth and compact-number texts and the display name."""
    names = mappings.select("platform", F.col("platform_display_name").alias("_display"))
    return (
        overview.join(names, "platform", "left")
        .withColumns(
            {
                **{name: currency_text(F.col(source)) for name, source in _PLATFORM_MONEY.items()},
                "revenue_growth_formatted": percent_text(F.col("revenue_mom_growth_pct")),
                "orders_growth_formatted": percent_text(F.col("orders_mom_growth_pct")),
                "total_orders_formatted": compact_text(F.col("total_orders")),
                "platform_name": F.coalesce("_display", "platform"),
            }
        )
        .drop("_display")
    )


def formatted_dashboard(summary: DataFrame) -> DataFrame:
    """The dashboard row with currency texts, also inside its nested platforms."""
    return summary.withColumns(
        {
            "total_revenue_formatted": currency_text(F.col("total_revenue_usd")),
            "avg_order_value_formatted": currency_text(F.col("avg_order_value_usd")),
            "platforms": F.transform(
                "platforms",
                lambda platform: _with_fields(platform),
            ),
        }
    )


def _with_fields(platform):
    for name, source in _PLATFORM_MONEY.items():
        platform = platform.withField(name, currency_text(platform[source]))
    return platform
