"""Table schemas, enum domains, text lengths and column defaults."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MONEY = DecimalType(10, 2)
SPENT = DecimalType(12, 2)
PERCENT = DecimalType(5, 2)


def _struct(*columns):
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in columns])


_STAMPS = (("created_at", TimestampType(), True), ("updated_at", TimestampType(), True))

USERS = _struct(
    ("id", LongType(), False),
    ("username", StringType(), False),
    ("role", StringType(), True),
    ("full_name", StringType(), False),
    ("email", StringType(), True),
    ("phone", StringType(), True),
    ("is_active", BooleanType(), True),
    ("last_login", TimestampType(), True),
    *_STAMPS,
)

PRODUCTS = _struct(
    ("id", LongType(), False),
    ("name", StringType(), False),
    ("price", MONEY, False),
    ("stock", IntegerType(), True),
    ("category", StringType(), True),
    ("description", StringType(), True),
    ("barcode", StringType(), True),
    ("is_active", BooleanType(), True),
    *_STAMPS,
)

CUSTOMERS = _struct(
    ("id", LongType(), False),
    ("name", StringType(), False),
    ("phone", StringType(), True),
    ("email", StringType(), True),
    ("address", StringType(), True),
    ("total_orders", IntegerType(), True),
    ("total_spent", SPENT, True),
    ("is_active", BooleanType(), True),
    *_STAMPS,
)

BILLS = _struct(
    ("id", LongType(), False),
    ("bill_number", StringType(), False),
    ("customer_id", LongType(), True),
    ("customer_name", StringType(), True),
    ("customer_phone", StringType(), True),
    ("customer_email", StringType(), True),
    ("customer_address", StringType(), True),
    ("subtotal", MONEY, False),
    ("discount_amount", MONEY, True),
    ("tax_amount", MONEY, True),
    ("shipping_cost", MONEY, True),
    ("total_amount", MONEY, False),
    ("payment_method", StringType(), True),
    ("payment_status", StringType(), True),
    ("notes", StringType(), True),
    ("is_return", BooleanType(), True),
    ("original_bill_id", LongType(), True),
    ("return_reason", StringType(), True),
    ("created_by", LongType(), True),
    *_STAMPS,
)

BILL_ITEMS = _struct(
    ("id", LongType(), False),
    ("bill_id", LongType(), False),
    ("product_id", LongType(), True),
    ("product_name", StringType(), False),
    ("quantity", IntegerType(), False),
    ("unit_price", MONEY, False),
    ("discount_percentage", PERCENT, True),
    ("discount_amount", MONEY, True),
    ("subtotal", MONEY, False),
    ("is_return", BooleanType(), True),
    ("original_item_id", LongType(), True),
    ("created_at", TimestampType(), True),
)

BILL_PAYMENTS = _struct(
    ("id", LongType(), False),
    ("bill_id", LongType(), False),
    ("amount", MONEY, False),
    ("payment_method", StringType(), True),
    ("payment_date", TimestampType(), True),
    ("created_by", LongType(), True),
)

STOCK_MOVEMENTS = _struct(
    ("id", LongType(), False),
    ("product_id", LongType(), False),
    ("quantity", IntegerType(), False),
    ("movement_type", StringType(), True),
    ("previous_stock", IntegerType(), False),
    ("new_stock", IntegerType(), False),
    ("reference", StringType(), True),
    ("notes", StringType(), True),
    ("created_by", LongType(), True),
    ("created_at", TimestampType(), True),
)

SETTINGS = _struct(
    ("id", LongType(), False),
    ("setting_key", StringType(), False),
    ("setting_value", StringType(), True),
    *_STAMPS,
)

TABLES = {
    "users": USERS,
    "products": PRODUCTS,
    "customers": CUSTOMERS,
    "bills": BILLS,
    "bill_items": BILL_ITEMS,
    "bill_payments": BILL_PAYMENTS,
    "stock_movements": STOCK_MOVEMENTS,
    "settings": SETTINGS,
}

# One incoming bill as a JSON document. Amounts arrive as floating point and
# become decimals once, when the bill is posted.
BILL_DOCUMENT = _struct(
    ("customer_id", LongType(), True),
    ("customer_name", StringType(), True),
    ("customer_phone", StringType(), True),
    ("customer_email", StringType(), True),
    ("customer_address", StringType(), True),
    (
        "items",
        ArrayType(
            _struct(
                ("product_id", LongType(), True),
                ("product_name", StringType(), True),
                ("quantity", DoubleType(), True),
                ("unit_price", DoubleType(), True),
                ("discount_percentage", DoubleType(), True),
                ("discount_amount", DoubleType(), True),
                ("subtotal", DoubleType(), True),
            )
        ),
        True,
    ),
    ("subtotal", DoubleType(), True),
    ("discount_amount", DoubleType(), True),
    ("tax_amount", DoubleType(), True),
    ("shipping_cost", DoubleType(), True),
    ("total_amount", DoubleType(), True),
    ("payment_method", StringType(), True),
    ("payment_status", StringType(), True),
)

# The enum domains of the data model.
ENUMS = {
    ("users", "role"): ("admin", "manager", "cashier"),
    ("bills", "payment_method"): ("cash", "card", "upi", "credit"),
    ("bills", "payment_status"): ("pending", "paid", "partial", "refunded"),
    ("stock_movements", "movement_type"): ("sale", "adjustment", "transfer_in", "transfer_out", "return"),
}

# The longest text each column may hold.
TEXT_LENGTHS = {
    "users": {"username": 50, "full_name": 100, "email": 100, "phone": 20},
    "products": {"name": 200, "category": 50, "barcode": 50},
    "customers": {"name": 100, "phone": 20, "email": 100},
    "bills": {"bill_number": 50, "customer_name": 100, "customer_phone": 20, "customer_email": 100},
    "bill_items": {"product_name": 200},
    "bill_payments": {"payment_method": 50},
    "stock_movements": {"reference": 50},
    "settings": {"setting_key": 100},
}

# Column defaults. `created_at` and `updated_at` default to the
# time of the change, see operators.changes.apply_defaults.
DEFAULTS = {
    "users": {"role": "cashier", "is_active": True},
    "products": {"stock": 0, "category": "Others", "is_active": True},
    "customers": {"total_orders": 0, "total_spent": "0.00", "is_active": True},
    "bills": {
        "discount_amount": "0.00",
        "tax_amount": "0.00",
        "shipping_cost": "0.00",
        "payment_method": "cash",
        "payment_status": "paid",
        "is_return": False,
    },
    "bill_items": {"discount_percentage": "0.00", "discount_amount": "0.00", "is_return": False},
    "bill_payments": {},
    "stock_movements": {"movement_type": "adjustment"},
    "settings": {},
}

# Foreign keys as (child, column, parent, what a parent's delete does).
FOREIGN_KEYS = (
    ("bills", "customer_id", "customers", "set null"),
    ("bills", "created_by", "users", "set null"),
    ("bills", "original_bill_id", "bills", "set null"),
    ("bill_items", "bill_id", "bills", "cascade"),
    ("bill_items", "product_id", "products", "set null"),
    ("bill_items", "original_item_id", "bill_items", "set null"),
    ("bill_payments", "bill_id", "bills", "cascade"),
    ("bill_payments", "created_by", "users", "set null"),
    ("stock_movements", "product_id", "products", "cascade"),
    ("stock_movements", "created_by", "users", "set null"),
)

# The settings a store may hold, with what applies when one is
# missing or empty.
SETTING_DEFAULTS = {
    "store_name": "Example Store",
    "store_address": "",
    "store_phone": "",
    "store_email": "",
    "tax_rate": "10",
    "tax_name": "VAT",
    "currency_symbol": "Rs.",
    "theme": "light",
}
