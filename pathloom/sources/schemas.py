"""Explicit schemas of the input files, as DDL text."""

RATINGS = "user_id STRING, item_id STRING, rating DOUBLE, timestamp BIGINT"
INTERACTIONS = "item_id STRING, user_id STRING, timestamp BIGINT"
ITEM_RECORD = "asin STRING, title STRING, description STRING"
SESSIONS = "prev_items STRING"

# The fields of one event inside a user history, in order, with their types.
EVENT_FIELDS = {
    "name": "string",
    "category_name": "string",
    "brand_name": "string",
    "category_id": "bigint",
    "brand_id": "bigint",
    "item_id": "bigint",
    "product_id": "string",
    "stime": "bigint",
    "event_id": "string",
    "price": "double",
    "item_condition_name": "string",
    "size_name": "string",
    "color": "string",
    "shipper_name": "string",
}

# Integer codes of the marketplace events.
MARKET_EVENT_CODES = {
    "item_view": 0,
    "item_like": 1,
    "item_add_to_cart_tap": 2,
    "offer_make": 3,
    "buy_start": 4,
    "buy_comp": 5,
}
