"""Schemas of the retail tables, for CSV files with a header."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "products": "product_id bigint, sku string, name string, category string, brand string, unit string, cost_price double, min_margin double, min_price double, current_price double, threshold_min int, threshold_max int, current_stock int, created_at date, is_active boolean",
    "sales": "timestamp timestamp, product_id bigint, qty bigint, unit_price double",
    "competitor_prices": "product_id bigint, competitor_id bigint, competitor_price double, collected_at timestamp, status string",
    "product_suppliers": "product_id bigint, supplier_id bigint, lead_time_days int, last_cost_price double, is_preferred boolean",
    "promotions": "promotion_id bigint, product_id bigint, name string, start_date date, end_date date, promo_price double, created_by_user_id bigint, status string, manager_validated boolean",
}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])
