"""Independent SQL for the registered queries, for DuckDB over the sample tables."""

# The retail tables as common table expressions over the sample tables.
TABLES = {
    "products": """
        SELECT p_partkey AS id, p_name AS name, cast(p_retailprice AS decimal(10,2)) AS price, p_size AS stock,
               p_type AS category, '' AS description, p_brand AS barcode, p_brand <> 'Brand#9' AS is_active
        FROM part""",
    "customers": """
        SELECT c_custkey AS id, c_name AS name, cast(c_custkey AS varchar) AS phone, c_mktsegment AS email,
               concat('Nation ', c_nationkey) AS address, 0 AS total_orders,
               cast(0 AS decimal(12,2)) AS total_spent, c_acctbal >= 0 AS is_active
        FROM customer""",
    "users": """
        SELECT s_suppkey AS id, s_name AS username,
               CASE WHEN s_nationkey < 5 THEN 'admin' WHEN s_nationkey < 12 THEN 'manager' ELSE 'cashier' END AS role,
               concat('Clerk ', s_suppkey) AS full_name, concat('clerk', s_suppkey, '@example.com') AS email,
               cast(s_nationkey AS varchar) AS phone, s_acctbal >= 0 AS is_active
        FROM supplier""",
    "bills": """
        SELECT o_orderkey AS id, concat('BILL-', o_orderkey) AS bill_number, o_custkey AS customer_id,
               concat('Customer#', lpad(cast(o_custkey AS varchar), 9, '0')) AS customer_name,
               cast(o_totalprice AS decimal(10,2)) AS subtotal, cast(o_totalprice AS decimal(10,2)) AS total_amount,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'cash' WHEN '5-LOW' THEN 'cash' WHEN '2-HIGH' THEN 'card'
                                    WHEN '3-MEDIUM' THEN 'upi' WHEN '4-NOT SPECIFIED' THEN 'credit' END AS payment_method,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'partial' END AS payment_status,
               o_custkey AS created_by, o_orderdate AS created_at
        FROM orders""",
    "items": """
        SELECT l_orderkey AS bill_id, l_partkey AS product_id, l_linenumber AS line_no, cast(l_quantity AS int) AS quantity,
               cast(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(5,2))) AS decimal(12,2)) AS subtotal,
               cast(l_discount * 100 AS decimal(5,2)) AS discount_percentage, l_returnflag = 'R' AS is_return
        FROM lineitem""",
    "numbered_items": """
        SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY line_no, quantity, subtotal, product_id) AS position
        FROM items""",
    "cart": """
        SELECT bill_id, position, product_id, coalesce(name, '') AS product_name, quantity,
               coalesce(price, cast(0 AS decimal(10,2))) AS unit_price, discount_percentage
        FROM numbered_items LEFT JOIN products ON product_id = id""",
    "priced": """
        SELECT *, cast(quantity AS decimal(10,0)) * unit_price * (100 - discount_percentage) * 0.01 AS exact_subtotal,
               cast(quantity AS decimal(10,0)) * unit_price * discount_percentage * 0.01 AS exact_discount
        FROM cart""",
    "bills_after": """
        SELECT * REPLACE (CASE WHEN id % 7 <> 3 THEN payment_method WHEN payment_method = 'cash' THEN 'card'
                               WHEN payment_method = 'card' THEN 'upi' WHEN payment_method = 'upi' THEN 'credit'
                               ELSE 'cash' END AS payment_method)
        FROM bills WHERE NOT (payment_status = 'partial' AND id % 4 = 1)""",
    "item_sums": """
        SELECT product_id, count(*) AS times_sold, cast(sum(quantity) AS bigint) AS qty,
               cast(sum(subtotal) AS decimal(22,2)) AS amount
        FROM items GROUP BY product_id""",
}
_NEEDS = {
    "bills_after": ["bills"],
    "numbered_items": ["items"],
    "cart": ["products", "items", "numbered_items"],
    "priced": ["products", "items", "numbered_items", "cart"],
    "item_sums": ["items"],
}


def sql(names, body, recursive=False):
    """`body` with the named tables, and those they need, in front."""
    wanted = []
    for name in names.split():
        for table in [*_NEEDS.get(name, []), name]:
            if table not in wanted:
                wanted.append(table)
    tables = ", ".join(f"{name} AS ({TABLES[name]})" for name in TABLES if name in wanted)
    word = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.startswith(","):
        return f"{word} {tables}{body}"
    return f"{word} {tables} {body}"


def exact_avg(amount):
    """Average of a non-negative two-decimal amount at six decimals, rounded half up in whole numbers."""
    return (
        f"cast((2*cast(sum({amount})*100 AS hugeint)*10000 + count(*)) // (2*count(*)) AS decimal(20,0))"
        " * cast(0.000001 AS decimal(7,6))"
    )


def _sales(key, label, condition="true", table="bills"):
    methods = ", ".join(
        f"cast(sum(CASE WHEN payment_method = '{m}' THEN total_amount ELSE 0 END) AS decimal(20,2)) AS {m}_sales"
        for m in ("cash", "card", "upi", "credit")
    )
    return sql(
        table,
        f"""
        SELECT cast({key} AS varchar) AS period, {label} AS period_label, count(*) AS bill_count,
               cast(sum(total_amount) AS decimal(20,2)) AS total_sales,
               cast({exact_avg('total_amount')} AS decimal(14,6)) AS avg_sale, {methods}
        FROM {table} WHERE {condition} GROUP BY {key} ORDER BY {key}""",
    )


_WEEK_LABEL = (
    "concat(strftime(min(created_at), '%Y'), ' Week ', lpad(cast(weekofyear(min(created_at)) AS varchar), 2, '0'))"
)

_INVENTORY = """
    SELECT id, name, price, stock, category, coalesce(times_sold, 0) AS times_sold,
           coalesce(qty, 0) AS total_qty_sold, cast(coalesce(amount, 0) AS decimal(22,2)) AS total_sales_amount
    FROM products LEFT JOIN item_sums ON id = product_id WHERE is_active AND {condition}
    ORDER BY stock, name, id"""


def _customer_report(min_orders, condition="true"):
    return sql(
        "customers bills",
        f"""
        SELECT c.id, c.name, c.phone, c.email, count(b.id) AS order_count,
               cast(sum(b.total_amount) AS decimal(20,2)) AS total_spent,
               cast({exact_avg('b.total_amount')} AS decimal(14,6)) AS avg_order_value,
               strftime(max(b.created_at), '%Y-%m-%d %H:%M:%S') AS last_order_date
        FROM customers c JOIN bills b ON c.id = b.customer_id
        WHERE c.is_active AND {condition}
        GROUP BY c.id, c.name, c.phone, c.email HAVING count(b.id) >= {min_orders}
        ORDER BY total_spent DESC, c.id""",
    )


def _product_report(condition, limit):
    return sql(
        "products items bills",
        f"""
        , sums AS (
            SELECT p.id, p.name, p.category, p.price, count(*) AS times_sold, cast(sum(i.quantity) AS bigint) AS total_quantity,
                   cast(sum(i.subtotal) AS decimal(22,2)) AS total_sales,
                   cast(sum(i.quantity) * p.price AS decimal(22,2)) AS potential_sales
            FROM products p JOIN items i ON p.id = i.product_id JOIN bills b ON i.bill_id = b.id
            WHERE p.is_active AND {condition}
            GROUP BY p.id, p.name, p.category, p.price
        )
        SELECT *, cast(CASE WHEN potential_sales > 0 THEN
                   cast((2*cast(total_sales*100 AS hugeint)*100000000 + cast(potential_sales*100 AS hugeint))
                        // (2*cast(potential_sales*100 AS hugeint)) AS decimal(30,0)) * cast(0.000001 AS decimal(7,6))
                   ELSE 100 END AS decimal(20,6)) AS effective_pct
        FROM sums ORDER BY total_sales DESC, id LIMIT {limit}""",
    )


_DAY = "cast(created_at AS date)"
_STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
_PRODUCT_COLUMNS = "id, name, price, stock, category, barcode"
_BILL_COLUMNS = (
    "b.id, b.bill_number, b.customer_id, b.customer_name, b.subtotal, b.total_amount, b.payment_method,"
    " b.payment_status, b.created_by, strftime(b.created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
)


def _recent(limit, columns, order, condition="true"):
    return sql(
        "bills users",
        f"""
        SELECT {columns} FROM bills b LEFT JOIN users u ON b.created_by = u.id WHERE {condition}
        ORDER BY {order} LIMIT {limit}""",
    )


def _replaced(table, requests, columns, only_active=True):
    """Table after the last request per id; `requests` yields seq, id and the columns of valid requests."""
    names = columns.split()
    applies = "r.id IS NOT NULL" + (" AND t.is_active" if only_active else "")
    sets = ", ".join(f"CASE WHEN {applies} THEN r.{c} ELSE t.{c} END AS {c}" for c in names)
    return f"""
        last AS (SELECT * FROM ({requests}) WHERE id <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
        changed AS (SELECT t.* REPLACE ({sets}) FROM {table} t LEFT JOIN last r ON t.id = r.id)"""


def _outcomes(table, checked, columns, only_active=True):
    """One row per request; `checked` yields seq, id, the columns and reasons ('' when valid)."""
    names = columns.split()
    same = " AND ".join(f"coalesce(lag(w.{c}) OVER chain, t.{c}) IS NOT DISTINCT FROM w.{c}" for c in names)
    active = " AND t.is_active" if only_active else ""
    return f"""
        asked AS ({checked}),
        done AS (
            SELECT w.seq, w.id, CASE WHEN t.id IS NULL THEN 'not_found' WHEN {same} THEN 'unchanged' ELSE 'updated' END AS status,
                   '' AS reasons
            FROM (SELECT * FROM asked WHERE reasons = '') w LEFT JOIN {table} t ON t.id = w.id{active}
            WINDOW chain AS (PARTITION BY w.id ORDER BY w.seq)
        )
        SELECT * FROM done UNION ALL SELECT seq, id, 'rejected', reasons FROM asked WHERE reasons <> ''"""


def _reasons(**rules):
    """Joined names of the rules that do not hold."""
    cases = ", ".join(f"CASE WHEN NOT coalesce({holds}, false) THEN '{name.replace('__', ' ')}' END" for name, holds in rules.items())
    return f"concat_ws('; ', {cases})"


_PRODUCT_CHANGES = f"""
    SELECT seq, id, name, price, stock, category, description, barcode,
           {_reasons(id__required='id <> 0', name__required="name <> ''", price__must__be__positive='price > 0')} AS reasons
    FROM (SELECT o_orderkey AS seq, o_custkey * 2 AS id,
                 CASE WHEN o_orderstatus <> 'P' THEN concat('item ', o_orderpriority) ELSE '' END AS name,
                 cast(floor(o_totalprice / 100000) * 10 - 10 AS decimal(10,2)) AS price, 7 AS stock,
                 CASE WHEN o_orderpriority <> '5-LOW' THEN 'CHANGED' ELSE 'Others' END AS category,
                 '' AS description, 'b' AS barcode
          FROM orders)"""

_NEW_PRODUCTS = f"""
    SELECT seq, name, price, stock, category, '' AS description, barcode,
           {_reasons(name__required="name <> ''", price__must__be__positive='price > 0')} AS reasons
    FROM (SELECT p_partkey AS seq, CASE WHEN p_brand <> 'Brand#7' THEN concat('new ', p_name) ELSE '' END AS name,
                 cast(cast(p_retailprice AS decimal(10,2)) - 905 AS decimal(10,2)) AS price, p_size AS stock,
                 CASE WHEN p_size > 10 THEN p_type ELSE 'Others' END AS category, p_brand AS barcode
          FROM part)"""

_PRODUCT_REMOVALS = f"""
    SELECT o_orderkey AS seq, o_custkey * 3 AS id, false AS is_active,
           {_reasons(id__required='o_custkey <> 0')} AS reasons
    FROM orders WHERE o_orderstatus = 'F'"""

_BILL_PATCHES = f"""
    SELECT *, {_reasons(id__required='id <> 0', payment_method__not__allowed="payment_method <> 'cheque'")} AS reasons
    FROM (SELECT event_id AS seq, user_id * 3 AS id, concat('Patched ', event_type) AS customer_name,
                 CASE event_type WHEN 'click' THEN 'card' WHEN 'view' THEN 'upi' WHEN 'error' THEN 'cheque' ELSE 'cash' END AS payment_method,
                 CASE WHEN "value" > 30 THEN 'paid' ELSE 'refunded' END AS payment_status
          FROM events)"""

_NEW_USERS = f"""
    SELECT seq, username, role, full_name, reasons,
           reasons = '' AND (row_number() OVER (PARTITION BY lower(username), reasons = '' ORDER BY seq) > 1
                             OR lower(username) IN (SELECT lower(s_name) FROM supplier)) AS taken
    FROM (SELECT *, {_reasons(role__not__allowed="role <> 'boss'")} AS reasons
          FROM (SELECT c_custkey AS seq,
                       CASE WHEN c_acctbal < 3000 THEN concat('SUPPLIER#', lpad(cast(c_custkey AS varchar), 9, '0'))
                            ELSE concat(c_mktsegment, ' ', c_nationkey) END AS username,
                       CASE WHEN c_nationkey = 3 THEN 'boss' WHEN c_nationkey > 9 THEN 'manager' ELSE 'cashier' END AS role,
                       c_name AS full_name
                FROM customer))"""

_USER_PATCHES = f"""
    judged AS (
        SELECT a.*, coalesce(holder, first_id) AS owner,
               CASE WHEN reasons = '' AND named AND a.id <> coalesce(holder, first_id) THEN 'username taken' ELSE reasons END AS verdict
        FROM (
            SELECT *, arg_min(id, seq) FILTER (WHERE named AND reasons = '') OVER (PARTITION BY lower(username)) AS first_id
            FROM (SELECT *, {_reasons(id__required='id <> 0', role__not__allowed="NOT named OR role <> 'boss'")} AS reasons
                  FROM (SELECT c_custkey AS seq, cast(c_nationkey AS bigint) * 4 AS id, c_mktsegment <> 'BUILDING' AS named,
                               CASE WHEN c_mktsegment <> 'BUILDING' THEN concat(c_mktsegment, '-', c_nationkey // 2) ELSE '' END AS username,
                               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'boss' ELSE 'manager' END AS role,
                               c_name AS full_name, 'e' AS email, 'p' AS phone,
                               CASE WHEN c_acctbal > 3000 THEN c_acctbal > 6000 END AS is_active
                        FROM customer))
        ) a LEFT JOIN (SELECT lower(username) AS name, min(id) AS holder FROM users GROUP BY 1) h ON lower(a.username) = h.name
    ),
    accepted AS (SELECT * FROM judged WHERE verdict = '')"""

_SETTINGS = """
    WITH requests AS (
        SELECT s_suppkey AS batch, 0 AS seq, 'store_name' AS setting_key, s_name AS setting_value FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'store_address', concat('Nation ', s_nationkey) FROM supplier
        UNION ALL SELECT s_suppkey, 2, 'store_phone', cast(s_suppkey AS varchar) FROM supplier
        UNION ALL SELECT s_suppkey, 3, 'store_email',
                         CASE WHEN s_acctbal < 1000 THEN 'nobody' ELSE concat('s', s_suppkey, '@example.com') END FROM supplier
        UNION ALL SELECT s_suppkey, 4, 'tax_rate', cast(s_nationkey * 5 AS varchar) FROM supplier
        UNION ALL SELECT s_suppkey, 5, 'tax_name', '' FROM supplier
        UNION ALL SELECT s_suppkey, 6, 'currency_symbol', 'Rs.' FROM supplier
        UNION ALL SELECT s_suppkey, 7, 'theme', CASE WHEN s_nationkey > 12 THEN 'dark' ELSE 'light' END FROM supplier
    ),
    outcomes AS (
        SELECT s_suppkey AS batch, CASE WHEN s_acctbal < 1000 OR s_nationkey * 5 > 100 THEN 'rejected' ELSE 'saved' END AS status
        FROM supplier
    ),
    newest AS (
        SELECT setting_key, arg_max(setting_value, batch) AS new_value
        FROM requests JOIN outcomes USING (batch) WHERE status = 'saved' GROUP BY setting_key
    ),
    base AS (
        SELECT CASE n_nationkey WHEN 0 THEN 'theme' WHEN 1 THEN 'tax_name' ELSE n_name END AS setting_key, n_name AS setting_value
        FROM nation
    ),
    settings AS (
        SELECT coalesce(b.setting_key, n.setting_key) AS setting_key, coalesce(new_value, setting_value) AS setting_value
        FROM base b FULL JOIN newest n ON b.setting_key = n.setting_key
    )"""

_DRAFTS = f"""
    , line_counts AS (SELECT bill_id, count(*) AS item_count FROM items GROUP BY bill_id),
    drafts AS (
        SELECT b.id AS seq, nullif(customer_id, 0) AS customer_id, customer_name, total_amount, created_at,
               CASE payment_method WHEN 'credit' THEN 'cheque' ELSE payment_method END AS payment_method,
               coalesce(item_count, 0) AS item_count
        FROM bills b LEFT JOIN line_counts ON bill_id = b.id WHERE payment_status <> 'paid'
    ),
    checked AS (
        SELECT *, {_reasons(no__items='item_count > 0', payment_method__not__allowed="payment_method <> 'cheque'")} AS reasons
        FROM drafts
    ),
    posted AS (
        SELECT *, (SELECT max(id) FROM bills WHERE payment_status = 'paid') + row_number() OVER (ORDER BY seq) AS id,
               concat('BILL-', strftime(created_at, '%Y%m%d'), '-',
                      lpad(cast(row_number() OVER (PARTITION BY {_DAY} ORDER BY seq) AS varchar), 4, '0')) AS bill_number
        FROM checked WHERE reasons = ''
    ),
    posted_items AS (
        SELECT row_number() OVER (ORDER BY p.id, i.position) AS id, p.id AS bill_id, nullif(i.product_id, 0) AS product_id,
               i.product_name, i.quantity, i.unit_price, cast(i.exact_discount AS decimal(10,2)) AS discount_amount,
               cast(i.exact_subtotal AS decimal(10,2)) AS subtotal
        FROM posted p JOIN priced i ON i.bill_id = p.seq
    ),
    queue AS (
        SELECT id, product_id, quantity, row_number() OVER (PARTITION BY product_id ORDER BY id) AS turn
        FROM posted_items WHERE product_id IS NOT NULL
    ),
    walk AS (
        SELECT p.id AS product_id, cast(0 AS bigint) AS turn, cast(p.stock AS bigint) AS stock, cast(NULL AS bigint) AS line_id,
               cast(NULL AS bigint) AS quantity, false AS accepted
        FROM products p
        UNION ALL
        SELECT w.product_id, q.turn, CASE WHEN w.stock >= q.quantity THEN w.stock - q.quantity ELSE w.stock END, q.id,
               cast(q.quantity AS bigint), w.stock >= q.quantity
        FROM walk w JOIN queue q ON q.product_id = w.product_id AND q.turn = w.turn + 1
    )"""
_DRAFT_TABLES = "bills priced"

ORACLES = {
    "sales_report_day": _sales(_DAY, "strftime(min(created_at), '%Y-%m-%d')"),
    "sales_report_week": _sales("yearweek(created_at)", _WEEK_LABEL),
    "sales_report_month": _sales("strftime(created_at, '%Y-%m')", "strftime(min(created_at), '%Y-%m')"),
    "sales_report_year": _sales("year(created_at)", "strftime(min(created_at), '%Y')"),
    "sales_report_range": _sales(
        "yearweek(created_at)", _WEEK_LABEL, f"{_DAY} BETWEEN DATE '1997-12-20' AND DATE '1999-01-10'"
    ),
    "inventory_report": sql("products item_sums", _INVENTORY.format(condition="true")),
    "inventory_low_stock": sql("products item_sums", _INVENTORY.format(condition="stock <= 5")),
    "inventory_category": sql("products item_sums", _INVENTORY.format(condition="category = 'ECONOMY'")),
    "customer_report": _customer_report(1),
    "customer_report_min_orders": _customer_report(12),
    "customer_report_range": _customer_report(
        2, "cast(b.created_at AS date) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
    ),
    "product_report": _product_report("true", 10),
    "product_report_filtered": _product_report(
        "cast(b.created_at AS date) BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' AND p.category = 'PROMO'", 25
    ),
    "sales_on_day": sql(
        "bills",
        f"""SELECT count(*) AS bill_count, cast(coalesce(sum(total_amount), 0) AS decimal(20,2)) AS total_sales
            FROM bills WHERE {_DAY} = DATE '2001-07-31'""",
    ),
    "sales_in_month": sql(
        "bills",
        """SELECT count(*) AS bill_count, cast(coalesce(sum(total_amount), 0) AS decimal(20,2)) AS total_sales
           FROM bills WHERE year(created_at) = 2001 AND month(created_at) = 7""",
    ),
    "active_customers": sql("customers", "SELECT count(*) AS total_customers FROM customers WHERE is_active"),
    "low_stock_count": sql("products", "SELECT count(*) AS low_stock_count FROM products WHERE is_active AND stock <= 5"),
    "dashboard_summary": sql(
        "bills customers products",
        f"""SELECT (SELECT count(*) FROM bills WHERE {_DAY} = DATE '2001-07-31') AS today_bill_count,
                   cast((SELECT coalesce(sum(total_amount), 0) FROM bills WHERE {_DAY} = DATE '2001-07-31') AS decimal(20,2)) AS today_total_sales,
                   (SELECT count(*) FROM bills WHERE strftime(created_at, '%Y-%m') = '2001-07') AS month_bill_count,
                   cast((SELECT coalesce(sum(total_amount), 0) FROM bills WHERE strftime(created_at, '%Y-%m') = '2001-07') AS decimal(20,2)) AS month_total_sales,
                   (SELECT count(*) FROM customers WHERE is_active) AS total_customers,
                   (SELECT count(*) FROM products WHERE is_active AND stock <= 5) AS low_stock_count""",
    ),
    "dashboard_recent_bills": _recent(
        5,
        "b.id, b.bill_number, b.customer_name, b.total_amount, b.payment_method,"
        " strftime(b.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, u.username AS cashier",
        "b.created_at DESC, b.id DESC",
    ),
    "dashboard_bundle": sql(
        "bills customers products",
        f"""SELECT (SELECT count(*) FROM bills WHERE {_DAY} = DATE '2001-07-31') AS today_bill_count,
                   cast((SELECT coalesce(sum(total_amount), 0) FROM bills WHERE {_DAY} = DATE '2001-07-31') AS decimal(20,2)) AS today_total_sales,
                   (SELECT count(*) FROM bills WHERE strftime(created_at, '%Y-%m') = '2001-07') AS month_bill_count,
                   cast((SELECT coalesce(sum(total_amount), 0) FROM bills WHERE strftime(created_at, '%Y-%m') = '2001-07') AS decimal(20,2)) AS month_total_sales,
                   (SELECT count(*) FROM customers WHERE is_active) AS total_customers,
                   (SELECT count(*) FROM products WHERE is_active AND stock <= 5) AS low_stock_count,
                   (SELECT string_agg(bill_number, ',' ORDER BY created_at DESC, id DESC)
                    FROM (SELECT * FROM bills ORDER BY created_at DESC, id DESC LIMIT 5)) AS recent_bills""",
    ),
    "product_list": sql("products", f"SELECT {_PRODUCT_COLUMNS} FROM products WHERE is_active ORDER BY lower(name), id"),
    "product_lookup": sql(
        "products items",
        "SELECT * FROM products WHERE is_active AND id IN (SELECT product_id FROM items WHERE is_return)",
    ),
    "product_search": sql(
        "products",
        f"""SELECT {_PRODUCT_COLUMNS} FROM products
            WHERE is_active AND (contains(lower(name), 'ge') OR contains(lower(barcode), 'ge'))
            ORDER BY lower(name), id LIMIT 50""",
    ),
    "low_stock_list": sql("products", "SELECT * FROM products WHERE is_active AND stock <= 5"),
    "customer_list": sql("customers", "SELECT * FROM customers WHERE is_active ORDER BY lower(name), id"),
    "customer_search": sql(
        "customers",
        """SELECT * FROM customers
           WHERE is_active AND (contains(lower(name), 'house') OR contains(lower(phone), 'house') OR contains(lower(email), 'house'))
           ORDER BY lower(name), id LIMIT 20""",
    ),
    "customer_recent_orders": sql(
        "bills",
        f"""SELECT customer_id, id, bill_number, {_STAMP}, total_amount, cast(place AS int) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS place FROM bills)
            WHERE place <= 10""",
    ),
    "customer_documents": sql(
        "customers bills",
        """, recent AS (
               SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS place FROM bills
           )
           SELECT c.id, c.name, cast(count(r.id) AS int) AS order_count,
                  coalesce(string_agg(concat(r.bill_number, ' ', r.total_amount), ',' ORDER BY place), '') AS orders
           FROM customers c LEFT JOIN recent r ON r.customer_id = c.id AND place <= 10
           WHERE c.is_active GROUP BY c.id, c.name""",
    ),
    "bill_list": _recent(100, f"{_BILL_COLUMNS}, u.username AS cashier_name", "b.created_at DESC, b.id DESC"),
    "bill_search": _recent(
        100,
        f"{_BILL_COLUMNS}, u.username AS cashier_name",
        "b.created_at DESC, b.id DESC",
        "contains(lower(b.bill_number), 'r#00000004') OR contains(lower(b.customer_name), 'r#00000004')",
    ),
    "bill_items_flat": sql(
        "bills users items",
        """SELECT b.id AS bill_id, b.bill_number, b.customer_name, b.total_amount, b.created_by, u.username AS cashier_name,
                  i.product_id AS item_product_id, i.line_no AS item_line_no, i.quantity AS item_quantity,
                  i.subtotal AS item_subtotal, i.discount_percentage AS item_discount_percentage, i.is_return AS item_is_return
           FROM bills b LEFT JOIN users u ON b.created_by = u.id LEFT JOIN items i ON i.bill_id = b.id""",
    ),
    "bill_documents": sql(
        "bills users items",
        """SELECT b.id, b.bill_number, u.username AS cashier_name, 0 AS part, 1 AS parts,
                  coalesce(string_agg(concat_ws(':', line_no, quantity, i.subtotal, product_id, CASE WHEN is_return THEN 'R' ELSE 'S' END),
                                      ',' ORDER BY line_no, quantity, i.subtotal, product_id) FILTER (WHERE i.bill_id IS NOT NULL), '') AS items
           FROM bills b LEFT JOIN users u ON b.created_by = u.id LEFT JOIN items i ON i.bill_id = b.id
           GROUP BY b.id, b.bill_number, u.username""",
    ),
    "bill_documents_in_parts": sql(
        "bills items",
        """SELECT b.id, greatest(1, cast(ceil(count(i.bill_id) / 3.0) AS int)) AS parts, count(i.bill_id) AS items,
                  cast(coalesce(sum(quantity), 0) AS bigint) AS quantity
           FROM bills b LEFT JOIN items i ON i.bill_id = b.id GROUP BY b.id""",
    ),
    "user_list": sql("users", "SELECT * FROM users ORDER BY lower(username), id"),
    "user_lookup": sql(
        "users bills", "SELECT * FROM users WHERE id IN (SELECT created_by FROM bills WHERE payment_status = 'paid')"
    ),
    "bills_with_cashier": sql(
        "bills users",
        """SELECT b.id, b.bill_number, b.created_by, u.username AS cashier_name
           FROM bills b LEFT JOIN users u ON b.created_by = u.id""",
    ),
    "products_with_items": sql(
        "products items",
        """SELECT p.id, p.name, nullif(count(i.product_id), 0) AS times_sold, cast(sum(i.quantity) AS bigint) AS total_quantity,
                  cast(sum(i.subtotal) AS decimal(22,2)) AS total_sales
           FROM products p LEFT JOIN items i ON i.product_id = p.id GROUP BY p.id, p.name""",
    ),
    "products_sold": sql(
        "products items bills",
        """SELECT p.id, p.name, count(*) AS times_sold, cast(sum(i.quantity) AS bigint) AS total_quantity,
                  cast(sum(i.subtotal) AS decimal(22,2)) AS total_sales
           FROM products p JOIN items i ON i.product_id = p.id JOIN bills b ON b.id = i.bill_id GROUP BY p.id, p.name""",
    ),
    "customers_with_bills": sql(
        "customers bills",
        """SELECT c.id, c.name, count(*) AS order_count, cast(sum(b.total_amount) AS decimal(20,2)) AS total_spent
           FROM customers c JOIN bills b ON b.customer_id = c.id GROUP BY c.id, c.name""",
    ),
    "resolve_lines": sql("cart", "SELECT * FROM cart"),
    "find_or_create_customers": sql(
        "customers",
        """, drafts AS (
               SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'Walk-in Customer' ELSE concat('Caller ', o_orderpriority) END AS customer_name,
                      CASE WHEN o_orderstatus = 'F' THEN cast(o_custkey AS varchar) ELSE concat('+', o_custkey // 2) END AS customer_phone
               FROM orders
           ),
           known AS (SELECT phone, arg_min(id, (name, id)) AS id FROM customers WHERE is_active GROUP BY phone),
           fresh AS (
               SELECT customer_phone AS phone, (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY min(seq)) AS id
               FROM drafts
               WHERE customer_name <> 'Walk-in Customer' AND customer_phone <> '0' AND customer_phone NOT IN (SELECT phone FROM known)
               GROUP BY customer_phone
           )
           SELECT d.seq, CASE WHEN customer_name <> 'Walk-in Customer' AND customer_phone <> '0' THEN coalesce(k.id, f.id) END AS customer_id,
                  customer_name, customer_phone
           FROM drafts d LEFT JOIN known k ON k.phone = customer_phone LEFT JOIN fresh f ON f.phone = customer_phone""",
    ),
    "find_or_create_new_customers": sql(
        "customers",
        """, drafts AS (
               SELECT o_orderkey AS seq, concat('Caller ', o_orderpriority) AS name,
                      CASE WHEN o_orderstatus = 'F' THEN cast(o_custkey AS varchar) ELSE concat('+', o_custkey // 2) END AS phone
               FROM orders WHERE o_orderstatus <> 'P'
           )
           SELECT (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY min(seq)) AS id, arg_min(name, seq) AS name,
                  phone, '' AS email, '' AS address
           FROM drafts WHERE phone <> '0' AND phone NOT IN (SELECT phone FROM customers WHERE is_active) GROUP BY phone""",
    ),
    "line_numbers": sql("numbered_items", "SELECT * FROM numbered_items"),
    "price_lines": sql(
        "priced",
        """SELECT bill_id, position, product_id, product_name, quantity, unit_price, discount_percentage,
                  cast(exact_subtotal AS decimal(24,6)) AS exact_subtotal, cast(exact_discount AS decimal(24,6)) AS exact_discount,
                  cast(exact_subtotal AS decimal(20,2)) AS subtotal, cast(exact_discount AS decimal(20,2)) AS discount_amount
           FROM priced""",
    ),
    "bill_totals": sql(
        "priced bills",
        """, sums AS (SELECT bill_id, sum(exact_subtotal) AS s, sum(exact_discount) AS d FROM priced GROUP BY bill_id),
           taxed AS (
               SELECT bill_id, s, d, cast(s AS decimal(26,6)) * 13 * 0.01 AS t,
                      cast(CASE WHEN payment_method = 'upi' THEN 7.5 ELSE 0 END AS decimal(10,2)) AS shipping_cost
               FROM sums LEFT JOIN bills ON id = bill_id
           )
           SELECT bill_id, cast(s AS decimal(20,2)) AS subtotal, cast(d AS decimal(20,2)) AS discount_amount,
                  cast(t AS decimal(20,2)) AS tax_amount, shipping_cost, cast(s + t + shipping_cost AS decimal(20,2)) AS total_amount
           FROM taxed""",
    ),
    "document_totals": sql(
        "priced",
        """, sums AS (
               SELECT bill_id, cast(sum(exact_subtotal) AS decimal(26,6)) AS s, sum(exact_discount) AS d FROM priced GROUP BY bill_id
           )
           SELECT bill_id, 0 AS part, cast(s AS decimal(20,2)) AS subtotal, cast(d AS decimal(20,2)) AS discount_amount,
                  cast(s * 13 * 0.01 AS decimal(20,2)) AS tax_amount,
                  cast(s + s * 13 * 0.01 + cast(2.5 AS decimal(10,2)) AS decimal(20,2)) AS total_amount
           FROM sums""",
    ),
    "customer_stats_rebuild": sql(
        "customers bills",
        """SELECT c.id, c.name, count(b.id) AS total_orders, cast(coalesce(sum(b.total_amount), 0) AS decimal(22,2)) AS total_spent
           FROM customers c LEFT JOIN bills b ON b.customer_id = c.id GROUP BY c.id, c.name""",
    ),
    "settings_map": f"{_SETTINGS} SELECT * FROM settings",
    "settings_upsert": f"{_SETTINGS} SELECT * FROM settings",
    "settings_outcomes": f"{_SETTINGS} SELECT * FROM outcomes",
    "settings_counts": f"{_SETTINGS} SELECT status AS what, count(*) AS n FROM outcomes GROUP BY status",
    "effective_settings": _SETTINGS
    + " SELECT "
    + ", ".join(
        f"coalesce(nullif(max(CASE WHEN setting_key = '{key}' THEN setting_value END), ''), '{default}') AS {key}"
        if key != "tax_rate"
        else f"cast(coalesce(nullif(max(CASE WHEN setting_key = '{key}' THEN setting_value END), ''), '{default}') AS decimal(5,2)) AS {key}"
        for key, default in (
            ("store_name", "Example Store"),
            ("store_address", ""),
            ("store_phone", ""),
            ("store_email", ""),
            ("tax_rate", "10"),
            ("tax_name", "VAT"),
            ("currency_symbol", "Rs."),
            ("theme", "light"),
        )
    )
    + " FROM settings",
    "period_keys": sql(
        "bills",
        f"""SELECT id, cast({_DAY} AS varchar) AS day, cast(year(created_at) AS int) AS year, cast(month(created_at) AS int) AS month,
                   cast(yearweek(created_at) AS int) AS yearweek,
                   concat(strftime(created_at, '%Y'), ' Week ', lpad(cast(weekofyear(created_at) AS varchar), 2, '0')) AS week_label,
                   strftime(created_at, '%Y-%m') AS month_label,
                   {_DAY} BETWEEN DATE '1997-02-10' AND DATE '1998-02-10' AS in_range
            FROM bills""",
    ),
    "lenient_numbers": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE cast(floor(abs("value")) AS bigint) END AS whole,
               cast(CASE WHEN event_type = 'error' THEN 0 ELSE cast("value" AS decimal(10,2)) END AS decimal(12,2)) AS number,
               nullif(user_id, 0) AS reference
        FROM events""",
    "sanitized_pages": r"""
        SELECT page_id,
               replace(replace(replace(replace(replace(
                   regexp_replace(regexp_replace(coalesce(html, ''), '^[ \t\n\r\x00\x0b]+|[ \t\n\r\x00\x0b]+$', '', 'g'),
                                  '<(>|$|[^\s>][^>]*(>|$))', '', 'g'),
                   '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS body
        FROM pages""",
    "text_fields": """
        SELECT c_custkey, concat('Rs. ', cast(c_acctbal AS decimal(10,2))) AS balance, c_mktsegment AS first_word,
               CASE c_mktsegment WHEN 'BUILDING' THEN '—' ELSE c_mktsegment END AS segment,
               rpad(substring(c_name, 1, 12), 20, ' ') AS cell, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed,
               c_acctbal BETWEEN 0 AND 100 AS small, CASE c_mktsegment WHEN 'BUILDING' THEN 'none' ELSE c_mktsegment END AS filled
        FROM customer""",
    "valid_emails": """
        SELECT c_custkey,
               concat(CASE WHEN c_nationkey = 6 THEN c_name ELSE replace(c_name, '#', '.') END,
                      CASE WHEN c_nationkey > 20 THEN '' WHEN c_nationkey > 18 THEN '@@' ELSE '@' END,
                      CASE c_nationkey WHEN 4 THEN 'shop' WHEN 5 THEN 'a..b' ELSE 'shop.example' END) AS email,
               c_nationkey <= 18 AND c_nationkey NOT IN (4, 5, 6) AS valid
        FROM customer""",
    "json_round_trip": sql(
        "bills",
        """SELECT id AS seq, customer_id, customer_name, total_amount, payment_method, cast(0 AS bigint) AS pos,
                  id AS product_id, 2 AS quantity FROM bills""",
    ),
    "create_products": sql(
        "products",
        f""", asked AS ({_NEW_PRODUCTS})
        SELECT * FROM products UNION ALL
        SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY seq), name, price, stock, category, description, barcode, true
        FROM asked WHERE reasons = ''""",
    ),
    "create_products_outcomes": sql(
        "products",
        f""", asked AS ({_NEW_PRODUCTS})
        SELECT seq, (SELECT max(id) FROM products) + row_number() OVER (ORDER BY seq) AS id, 'created' AS status, '' AS reasons
        FROM asked WHERE reasons = '' UNION ALL SELECT seq, NULL, 'rejected', reasons FROM asked WHERE reasons <> ''""",
    ),
    "upsert_products": sql(
        "products",
        ", "
        + _replaced("products", f"SELECT * FROM ({_PRODUCT_CHANGES}) WHERE reasons = ''", "name price stock category description barcode")
        + " SELECT * FROM changed",
    ),
    "upsert_products_outcomes": sql(
        "products", ", " + _outcomes("products", _PRODUCT_CHANGES, "name price stock category description barcode")
    ),
    "soft_delete_products": sql(
        "products",
        ", "
        + _replaced("products", _PRODUCT_REMOVALS, "is_active", only_active=False)
        + " SELECT id, name, is_active FROM changed",
    ),
    "soft_delete_products_outcomes": sql(
        "products", ", " + _outcomes("products", _PRODUCT_REMOVALS, "is_active", only_active=False)
    ),
    "create_customers": sql(
        "customers",
        """SELECT * FROM customers UNION ALL
           SELECT (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY c_custkey), concat('New ', c_name),
                  cast(c_custkey AS varchar), c_mktsegment, '', 0, cast(0 AS decimal(12,2)), true
           FROM customer WHERE c_acctbal > 0 AND c_custkey <> 0""",
    ),
    "replace_customers": sql(
        "customers",
        ", "
        + _replaced(
            "customers",
            """SELECT o_orderkey AS seq, o_custkey AS id, concat('Buyer ', o_orderpriority) AS name,
                      cast(o_custkey AS varchar) AS phone, 'mail' AS email, 'road' AS address
               FROM orders WHERE o_orderstatus <> 'P'""",
            "name phone email address",
        )
        + " SELECT * FROM changed",
    ),
    "soft_delete_customers": sql(
        "customers",
        """SELECT id, name, is_active AND (id = 0 OR id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS is_active
           FROM customers""",
    ),
    "edit_bills": sql(
        "bills",
        ", "
        + _replaced(
            "bills",
            f"SELECT * FROM ({_BILL_PATCHES}) WHERE reasons = ''",
            "customer_name payment_method payment_status",
            only_active=False,
        )
        + " SELECT id, customer_name, payment_method, payment_status FROM changed",
    ),
    "edit_bills_outcomes": sql(
        "bills",
        ", " + _outcomes("bills", _BILL_PATCHES, "customer_name payment_method payment_status", only_active=False),
    ),
    "create_users": sql(
        "users",
        f""", asked AS ({_NEW_USERS})
        SELECT * FROM users UNION ALL
        SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq), username, role, full_name, '', '', true
        FROM asked WHERE reasons = '' AND NOT taken""",
    ),
    "create_users_outcomes": sql(
        "users",
        f""", asked AS ({_NEW_USERS})
        SELECT seq, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS id, 'created' AS status, '' AS reasons
        FROM asked WHERE reasons = '' AND NOT taken
        UNION ALL
        SELECT seq, NULL, 'rejected', CASE WHEN reasons = '' THEN 'username taken' ELSE reasons END
        FROM asked WHERE reasons <> '' OR taken""",
    ),
    "users_patch": sql(
        "users",
        f""", {_USER_PATCHES},
        identity AS (SELECT * FROM accepted WHERE named QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
        activity AS (SELECT id, arg_max(is_active, seq) AS is_active FROM accepted WHERE is_active IS NOT NULL GROUP BY id)
        SELECT u.id, coalesce(i.username, u.username) AS username, coalesce(i.role, u.role) AS role,
               coalesce(i.full_name, u.full_name) AS full_name, coalesce(i.email, u.email) AS email,
               coalesce(i.phone, u.phone) AS phone, coalesce(a.is_active, u.is_active) AS is_active
        FROM users u LEFT JOIN identity i ON i.id = u.id LEFT JOIN activity a ON a.id = u.id""",
    ),
    "users_patch_outcomes": sql(
        "users",
        f""", {_USER_PATCHES},
        a AS (
            SELECT w.seq, (w.username, w.role, w.full_name, w.email, w.phone) IS DISTINCT FROM
                   coalesce(lag((w.username, w.role, w.full_name, w.email, w.phone)) OVER (PARTITION BY w.id ORDER BY w.seq),
                            (u.username, u.role, u.full_name, u.email, u.phone)) AS moved
            FROM accepted w JOIN users u ON u.id = w.id WHERE named
        ),
        b AS (
            SELECT w.seq, w.is_active IS DISTINCT FROM
                   coalesce(lag(w.is_active) OVER (PARTITION BY w.id ORDER BY w.seq), u.is_active) AS moved
            FROM accepted w JOIN users u ON u.id = w.id WHERE w.is_active IS NOT NULL
        )
        SELECT w.seq, w.id, CASE WHEN u.id IS NULL THEN 'not_found'
                                 WHEN coalesce(a.moved, false) OR coalesce(b.moved, false) THEN 'updated' ELSE 'unchanged' END AS status,
               '' AS reasons
        FROM accepted w LEFT JOIN users u ON u.id = w.id LEFT JOIN a ON a.seq = w.seq LEFT JOIN b ON b.seq = w.seq
        UNION ALL SELECT seq, id, 'rejected', verdict FROM judged WHERE verdict <> ''""",
    ),
    "users_hard_delete": sql(
        "users", "SELECT * FROM users WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)"
    ),
    "users_hard_delete_outcomes": """
        SELECT s_suppkey AS seq, s_suppkey AS id, CASE WHEN s_suppkey = 0 THEN 'rejected' ELSE 'deleted' END AS status,
               CASE WHEN s_suppkey = 0 THEN 'id required' ELSE '' END AS reasons
        FROM supplier WHERE s_acctbal < 2000""",
    "set_null_on_delete": sql(
        "bills",
        """SELECT id, bill_number, CASE WHEN created_by IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) THEN NULL ELSE created_by END AS created_by
           FROM bills""",
    ),
    "cascade_delete": sql(
        "items bills", "SELECT * FROM items WHERE bill_id NOT IN (SELECT id FROM bills WHERE payment_status = 'pending')"
    ),
    "assign_ids": sql(
        "bills users",
        """SELECT id AS seq, (SELECT max(id) FROM users) + row_number() OVER (ORDER BY id) AS id, bill_number
           FROM bills WHERE payment_status = 'paid'""",
    ),
    "apply_defaults": """
        SELECT c_custkey AS id, c_name AS name, cast(c_acctbal AS decimal(10,2)) AS price,
               CASE WHEN c_nationkey > 12 THEN c_nationkey ELSE 0 END AS stock,
               CASE WHEN c_nationkey < 6 THEN c_mktsegment ELSE 'Others' END AS category,
               cast(NULL AS varchar) AS description, cast(NULL AS varchar) AS barcode, true AS is_active
        FROM customer""",
    "change_status": sql(
        "items",
        """SELECT CASE WHEN nullif(discount_percentage, 0) IS NOT DISTINCT FROM nullif(discount_percentage - CASE WHEN is_return THEN 0 ELSE 1 END, 0)
                            AND quantity >= 10 THEN 'unchanged' ELSE 'updated' END AS status,
                  count(*) AS lines, cast(sum(quantity) AS bigint) AS quantity
           FROM items GROUP BY 1""",
    ),
    "validate_bills": sql(
        "bills items",
        f""", counts AS (SELECT bill_id, count(*) AS item_count FROM items GROUP BY bill_id),
        checked AS (
            SELECT id, coalesce(item_count, 0) AS item_count,
                   {_reasons(no__items='coalesce(item_count, 0) > 0', total__must__be__positive='total_amount - 20000 > 0',
                             payment_method__not__allowed="payment_method <> 'credit'",
                             customer_phone__too__long="payment_status <> 'partial' AND payment_status <> 'pending'")} AS reasons
            FROM bills LEFT JOIN counts ON bill_id = id
        )
        SELECT * FROM checked WHERE reasons <> ''""",
    ),
    "validate_cart_lines": sql(
        "cart",
        f""", checked AS (
            SELECT bill_id, position, {_reasons(product__required='product_id <> 0', quantity__required='quantity <> 1',
                                                price__required='unit_price <> 0')} AS reasons
            FROM cart
        )
        SELECT * FROM checked WHERE reasons <> ''""",
    ),
    "duplicate_keys": """
        SELECT c_custkey AS seq, concat(lower(c_mktsegment), c_nationkey) AS username,
               row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) > 1
               OR (c_mktsegment = 'BUILDING' AND c_nationkey <> 7 AND c_nationkey IN (SELECT n_nationkey FROM nation)) AS taken
        FROM customer""",
    "missing_parents": """
        SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""",
    "bill_numbers": sql(
        "bills",
        f"""SELECT b.id AS seq, concat('BILL-', strftime(b.created_at, '%Y%m%d'), '-', lpad(cast(
                       row_number() OVER (PARTITION BY cast(b.created_at AS date) ORDER BY b.id) + coalesce(n, 0) AS varchar), 4, '0')) AS bill_number
            FROM bills b LEFT JOIN (SELECT {_DAY} AS day, count(*) AS n FROM bills WHERE payment_status = 'paid' GROUP BY 1)
                 ON day = cast(b.created_at AS date)
            WHERE payment_status <> 'paid'""",
    ),
    "post_bills_outcomes": sql(
        _DRAFT_TABLES,
        _DRAFTS
        + """ SELECT seq, 'created' AS status, id, bill_number, '' AS reasons FROM posted
              UNION ALL SELECT seq, 'rejected', NULL, NULL, reasons FROM checked WHERE reasons <> ''""",
        recursive=True,
    ),
    "post_bills_headers": sql(
        _DRAFT_TABLES,
        _DRAFTS
        + " SELECT id, bill_number, customer_id, customer_name, total_amount, payment_method, false AS is_return FROM posted",
        recursive=True,
    ),
    "post_bills_items": sql(_DRAFT_TABLES, _DRAFTS + " SELECT * FROM posted_items", recursive=True),
    "post_bills_counts": sql(
        _DRAFT_TABLES,
        _DRAFTS
        + """ SELECT what, count(*) AS n FROM (
                SELECT CASE WHEN reasons = '' THEN 'created' ELSE 'rejected' END AS what FROM checked
                UNION ALL SELECT unnest(string_split(reasons, '; ')) FROM checked WHERE reasons <> ''
                UNION ALL SELECT CASE WHEN accepted THEN 'sold' ELSE 'skipped' END FROM walk WHERE turn > 0)
              GROUP BY what""",
        recursive=True,
    ),
    "post_bills_sold": sql(
        _DRAFT_TABLES,
        _DRAFTS + " SELECT line_id, product_id, quantity, accepted FROM walk WHERE turn > 0",
        recursive=True,
    ),
    "post_bills_stock": sql(
        _DRAFT_TABLES,
        _DRAFTS + " SELECT product_id AS id, cast(min(stock) AS int) AS stock FROM walk GROUP BY product_id",
        recursive=True,
    ),
    "post_bills_customers": sql(
        _DRAFT_TABLES + " customers",
        _DRAFTS
        + """ SELECT c.id, count(p.id) AS total_orders, cast(coalesce(sum(p.total_amount), 0) AS decimal(22,2)) AS total_spent
              FROM customers c LEFT JOIN posted p ON p.customer_id = c.id GROUP BY c.id""",
        recursive=True,
    ),
    "delete_bills_stock": sql(
        "products items bills",
        """SELECT p.id, cast(p.stock + coalesce(sum(CASE WHEN NOT i.is_return AND b.id IS NOT NULL THEN i.quantity END), 0) AS int) AS stock
           FROM products p LEFT JOIN items i ON i.product_id = p.id
                LEFT JOIN bills b ON b.id = i.bill_id AND b.payment_status = 'partial'
           GROUP BY p.id, p.stock""",
    ),
    "delete_bills_remaining": sql(
        "items bills",
        """SELECT 'bills' AS table_name, count(*) AS row_count, cast(sum(total_amount) AS decimal(38,2)) AS amount
           FROM bills WHERE payment_status <> 'partial'
           UNION ALL
           SELECT 'bill_items', count(*), cast(sum(subtotal) AS decimal(38,2))
           FROM items WHERE bill_id NOT IN (SELECT id FROM bills WHERE payment_status = 'partial')""",
    ),
}

# ---- searches for many terms, change sets, states kept up to date, marks

_CHANGE_COLUMNS = (
    "bill_number customer_id customer_name subtotal total_amount payment_method payment_status created_by created_at"
).split()


def _bill_changes():
    each = " UNION ALL ".join(
        f"""SELECT coalesce(o.id, n.id) AS id,
                   CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS operation,
                   '{c}' AS "column", cast(o.{c} AS varchar) AS old_value, cast(n.{c} AS varchar) AS new_value
            FROM before o FULL JOIN bills_after n ON o.id = n.id
            WHERE o.id IS NULL OR n.id IS NULL OR o.{c} IS DISTINCT FROM n.{c}"""
        for c in _CHANGE_COLUMNS
    )
    return sql("bills bills_after", f", before AS (SELECT * FROM bills WHERE id % 13 <> 5) {each}")


ORACLES |= {
    "product_search_terms": sql(
        "products",
        """, named AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN translate(name, 'eo', 'éô') ELSE name END AS name)
                       FROM products WHERE is_active),
           own AS (SELECT * FROM products WHERE id % 20 = 0),
           terms AS (SELECT upper(substr(name, 3, 4)) AS term FROM own UNION SELECT substr(barcode, 6, 2) FROM own
                     UNION SELECT substr(name, 1, 1) FROM own),
           found AS (SELECT term, id, name, row_number() OVER (PARTITION BY term ORDER BY strip_accents(lower(name)), id) AS place
                     FROM terms JOIN named ON contains(strip_accents(lower(name)), strip_accents(lower(term))) OR contains(lower(barcode), lower(term)))
           SELECT term, cast(place AS int) AS rank, id, name FROM found WHERE place <= 50""",
    ),
    "bill_search_terms": sql(
        "bills customers",
        """, terms AS (SELECT DISTINCT substr(name, 15, 4) AS term FROM customers WHERE id % 50 = 0),
           found AS (SELECT term, id, bill_number, row_number() OVER (PARTITION BY term ORDER BY created_at DESC, id DESC) AS place
                     FROM terms JOIN bills ON contains(lower(bill_number), term) OR contains(lower(customer_name), term))
           SELECT term, cast(place AS int) AS rank, id, bill_number FROM found WHERE place <= 100""",
    ),
    "bill_changes": _bill_changes(),
    "bill_changes_applied": sql("bills bills_after", f"SELECT * REPLACE ({_STAMP}) FROM bills_after"),
    "standing_sales_day": _sales(_DAY, "strftime(min(created_at), '%Y-%m-%d')", table="bills_after"),
    "standing_sales_week": _sales("yearweek(created_at)", _WEEK_LABEL, table="bills_after"),
    "standing_sales_range": _sales(
        "strftime(created_at, '%Y-%m')",
        "strftime(min(created_at), '%Y-%m')",
        f"{_DAY} BETWEEN DATE '1997-12-20' AND DATE '1999-01-10'",
        "bills_after",
    ),
    "standing_dashboard": sql(
        "bills_after",
        f"""SELECT count(*) FILTER (WHERE {_DAY} = DATE '2001-07-31') AS today_bill_count,
                   cast(coalesce(sum(total_amount) FILTER (WHERE {_DAY} = DATE '2001-07-31'), 0) AS decimal(20,2)) AS today_total_sales,
                   count(*) AS month_bill_count, cast(coalesce(sum(total_amount), 0) AS decimal(20,2)) AS month_total_sales
            FROM bills_after WHERE strftime(created_at, '%Y-%m') = '2001-07'""",
    ),
    "standing_recent_orders": sql(
        "bills bills_after",
        f"""SELECT customer_id, id, bill_number, {_STAMP}, total_amount, cast(place AS int) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS place FROM bills_after)
            WHERE customer_id IS NOT NULL AND place <= 10""",
    ),
    "standing_counters": sql(
        "customers bills_after",
        """SELECT c.id, count(b.id) AS total_orders, cast(coalesce(sum(b.total_amount), 0) AS decimal(22,2)) AS total_spent
           FROM customers c LEFT JOIN bills_after b ON b.customer_id = c.id GROUP BY c.id""",
    ),
    "assign_ids_after": ORACLES["assign_ids"],
    "bill_numbers_after": ORACLES["bill_numbers"],
}

# ---- bills by month, request bodies, stock as the state of a stream

_BODIES = """
    WITH parts AS (
        SELECT o_orderkey AS seq, cast(o_custkey AS varchar) AS customer, printf('%.2f', o_totalprice) AS total,
               concat('{"product_id": ', o_orderkey % 50 + 1, ', "quantity": "', o_orderkey % 7, ' pcs", "unit_price": 1.5}') AS line
        FROM orders),
    whole AS (SELECT *, concat('{"customer_id": ', customer, ', "customer_name": "Customer ', customer, '", "total_amount": ', total,
                               ', "items": [', line, ', ', line, ']}') AS body FROM parts),
    bodies AS (SELECT seq, CASE seq % 9
            WHEN 1 THEN concat('{"customer_id": "', customer, 'x", "customer_name": 7, "total_amount": "', total, ' EUR", "items": []}')
            WHEN 2 THEN substr(body, 1, length(body) - 3) WHEN 3 THEN concat('[', body, ']')
            WHEN 4 THEN '{"customer_name": {"first": "A"}, "items": null}' WHEN 5 THEN '{"items": {"product_id": 1}}'
            WHEN 6 THEN '{"items": [4]}' WHEN 7 THEN '' ELSE body END AS body
        FROM whole),
    judged AS (SELECT seq, body, CASE WHEN body = '' THEN 'no body' WHEN NOT json_valid(body) THEN 'not JSON'
            WHEN json_type(body) <> 'OBJECT' THEN 'not an object'
            WHEN coalesce(json_type(body, '$.items'), 'NULL') NOT IN ('NULL', 'ARRAY') THEN 'items is not a list'
            WHEN coalesce(json_type(body, '$.items[0]'), 'OBJECT') <> 'OBJECT' THEN 'an item is not an object' END AS reason
        FROM bodies)"""


def _leading(path):
    return f"coalesce(try_cast(regexp_extract(json_extract_string(body, '{path}'), '^[0-9.]+') AS double), 0)"


ORACLES |= {
    "edit_bills_monthly": ORACLES["edit_bills"],
    "delete_bills_monthly": ORACLES["delete_bills_remaining"],
    "bodies_rejected": f"{_BODIES} SELECT seq, reason FROM judged WHERE reason IS NOT NULL",
    "bodies_read": f"""{_BODIES}
        SELECT seq, cast({_leading("$.customer_id")} AS bigint) AS customer_id,
               CASE WHEN json_type(body, '$.customer_name') <> 'OBJECT' THEN json_extract_string(body, '$.customer_name') END AS customer_name,
               cast({_leading("$.total_amount")} AS decimal(12,2)) AS total_amount,
               cast(coalesce(json_array_length(body, '$.items'), 0) AS int) AS item_count,
               cast({_leading("$.items[0].quantity")} + {_leading("$.items[1].quantity")} AS int) AS quantity
        FROM judged WHERE reason IS NULL""",
    "stream_sold": ORACLES["post_bills_sold"],
    "bill_lines_bucketed": ORACLES["bill_items_flat"],
    "bill_documents_bucketed": ORACLES["bill_documents"],
}
