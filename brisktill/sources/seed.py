"""The rows a new store starts with. Users carry no passwords; contact details are invented."""

from ..operators.changes import apply_defaults

# The first users, products and settings.
USERS = [
    ("admin", "admin", "System Administrator", "admin@example.com"),
    ("cashier", "cashier", "Cashier User", "cashier@example.com"),
    ("manager", "manager", "Manager User", "manager@example.com"),
]

PRODUCTS = [
    ("Laptop Dell Inspiron", 45000.00, 10, "Electronics", "Dell Inspiron 15 3000"),
    ("Wireless Mouse", 800.00, 50, "Accessories", "Logitech Wireless Mouse"),
    ("USB-C Cable", 200.00, 100, "Accessories", "USB Type-C Cable"),
    ("Headphones", 1500.00, 25, "Electronics", "Sony Wired Headphones"),
    ("Mechanical Keyboard", 1200.00, 30, "Accessories", "Mechanical Keyboard"),
    ('LED Monitor 24"', 12000.00, 15, "Electronics", "24-inch LED Monitor"),
    ("Webcam 1080p", 2500.00, 20, "Electronics", "HD Webcam 1080p"),
    ("Phone Case", 300.00, 75, "Accessories", "Protective Phone Case"),
    ("Power Bank 10000mAh", 1800.00, 40, "Electronics", "10000mAh Power Bank"),
    ("Android Tablet", 25000.00, 8, "Electronics", "Android Tablet 10 inch"),
]

SETTINGS = [
    ("store_name", "Example Store"),
    ("store_address", "1 Example Street"),
    ("store_phone", "5550100"),
    ("store_email", "store@example.com"),
    ("tax_rate", "10.00"),
    ("tax_name", "VAT"),
    ("currency_symbol", "Rs."),
    ("theme", "light"),
]


def _numbered(rows):
    return [(number, *row) for number, row in enumerate(rows, start=1)]


def seed_tables(spark, now=None):
    users = spark.createDataFrame(_numbered(USERS), "id long, username string, role string, full_name string, email string")
    products = spark.createDataFrame(
        _numbered(PRODUCTS), "id long, name string, price double, stock int, category string, description string"
    )
    settings = spark.createDataFrame(_numbered(SETTINGS), "id long, setting_key string, setting_value string")
    frames = {"users": users, "products": products, "settings": settings}
    return {name: apply_defaults(df, name, now) for name, df in frames.items()}


def empty_table(spark, schema):
    return spark.createDataFrame([], schema)
