"""Column names, schemas and fixed values of the event data model."""

from __future__ import annotations

from pyspark.sql import types as T

CLICK, CART, ORDER = 0, 1, 2
#: Event type names and codes.
TYPE_CODES = {"clicks": CLICK, "carts": CART, "orders": ORDER}
#: Weights by event type for popularity and the single graph (cart above order).
POPULARITY_WEIGHTS = {CLICK: 1.0, CART: 6.0, ORDER: 3.0}
#: Weights by target type for the rule graphs and the fallback list (order above cart).
TARGET_WEIGHTS = {CLICK: 1.0, CART: 3.0, ORDER: 6.0}
#: Weights of the metric by event type.
METRIC_WEIGHTS = {CLICK: 0.10, CART: 0.30, ORDER: 0.60}

DAY_MS = 86_400_000
HASH_RANGE = 1_000_000
DELTA_T_FILL = 9_999_999

EVENTS = T.StructType([
    T.StructField("session", T.IntegerType()),
    T.StructField("aid", T.IntegerType()),
    T.StructField("ts", T.LongType()),
    T.StructField("type", T.ByteType()),
])

SESSION_JSON = T.StructType([
    T.StructField("session", T.LongType()),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("aid", T.IntegerType()),
        T.StructField("ts", T.LongType()),
        T.StructField("type", T.StringType()),
    ]))),
])
