"""Table schemas, natural keys and the value domains that validation enforces."""

from __future__ import annotations

# The domains every producer and consumer of these tables must agree on.
CURRENCIES = ["USD", "EUR", "GBP", "CAD"]
ORDER_STATUSES = ["pending", "confirmed", "processing", "shipped", "delivered", "cancelled", "refunded"]
STOCK_SOURCES = ["manual", "order", "receipt", "return", "adjustment", "system"]
FULFILLED = ["delivered", "shipped"]

TABLES = {
    "tenants": "tenant_id string, name string, api_key_hash string, created_at timestamp_ntz",
    "customers": "customer_id string, tenant_id string, name string, email string, metadata string, "
    "created_at timestamp_ntz",
    "products": "product_id string, tenant_id string, sku string, name string, price decimal(10,2), "
    "category_id string, active boolean, created_at timestamp_ntz",
    "orders": "order_id string, tenant_id string, external_order_id string, customer_id string, "
    "customer_name_snapshot string, customer_email_snapshot string, total_amount decimal(12,2), "
    "currency string, order_status string, order_date timestamp_ntz, raw_payload string, "
    "created_at timestamp_ntz",
    "order_items": "order_item_id string, order_id string, tenant_id string, product_id string, "
    "quantity int, unit_price decimal(10,2), line_total decimal(12,2)",
    "stock_events": "stock_event_id string, tenant_id string, product_id string, delta bigint, "
    "resulting_level bigint, event_time timestamp_ntz, source string, meta string",
    "stock_levels": "product_id string, tenant_id string, available bigint, last_updated timestamp_ntz",
    "price_events": "event_id string, tenant_id string, product_id string, old_price decimal(10,2), "
    "new_price decimal(10,2), pct_change decimal(8,4), anomaly_flag boolean, meta string, "
    "received_at timestamp_ntz",
    "metrics_preagg": "tenant_id string, group_key string, period_start date, period_end date, "
    "sum_sales double, num_orders bigint, unique_customers_est bigint, avg_order_value double, "
    "delivered_orders bigint, cancelled_orders bigint, last_updated timestamp_ntz",
}

PRIMARY_KEY = {
    "tenants": "tenant_id",
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
}

NATURAL_KEY = {
    "tenants": ["tenant_id"],
    "customers": ["tenant_id", "email"],
    "products": ["tenant_id", "sku"],
    "orders": ["tenant_id", "external_order_id"],
    "order_items": ["order_item_id"],
    "stock_levels": ["product_id"],
    "stock_events": ["stock_event_id"],
    "price_events": ["event_id"],
    "metrics_preagg": ["tenant_id", "group_key", "period_start", "period_end"],
}

# Parents first, so that references resolve when the tables are loaded in this order.
LOAD_ORDER = ["customers", "products", "orders", "order_items"]
