"""Selling lines against stock as they arrive, with the stock of each shelf of products as keyed state."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# Products are dealt to so many shelves by a hash. A shelf is one state, so a micro-batch costs a call per shelf and not per product.
SHELVES = 1 << 10
SOLD = "line_id long, product_id long, quantity long, accepted boolean, stock long"


def _shelf():
    """The processor of one shelf's lines. The class is made here so that it travels to the workers by value."""

    class Shelf(StatefulProcessor):
        """The stock of a shelf's products. Lines of a micro-batch are taken in line order, whatever order they arrive in."""

        def init(self, handle):
            self.stock = handle.getValueState("stock", "products array<long>, stocks array<long>")

        def _held(self):
            return dict(zip(*self.stock.get(), strict=True)) if self.stock.exists() else {}

        def _hold(self, held):
            self.stock.update((list(held), list(held.values())))

        def handleInitialState(self, key, initialState, timerValues):  # noqa: N803
            # A large shelf comes in several parts.
            held = self._held()
            for product, stock in zip(initialState["product_id"].tolist(), initialState["stock"].tolist(), strict=True):
                held.setdefault(int(product), int(stock))
            self._hold(held)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            lines = pd.concat(list(rows)).sort_values("line_id", kind="stable")
            held = self._held()
            accepted, after = [], []
            for product, quantity in zip(lines["product_id"].tolist(), lines["quantity"].tolist(), strict=True):
                left = held.get(product)
                fits = left is not None and quantity is not None and quantity <= left
                if fits:
                    held[product] = left = left - int(quantity)
                accepted.append(fits)
                after.append(left)
            if any(accepted):
                self._hold(held)
            quantity = lines["quantity"].astype("Int64")
            yield pd.DataFrame(
                {
                    "line_id": lines["line_id"],
                    "product_id": lines["product_id"],
                    "quantity": quantity,
                    "accepted": accepted,
                    "stock": pd.array(after, "Int64"),
                }
            )

        def close(self):
            pass

    return Shelf()


def sell(lines, products):
    """A stream of lines (line_id, product_id, quantity) sold against `products` (id, stock).

    Gives each line with whether stock covered it and the product's stock after
    it, as `operators.stock.apply_stock` would for all lines at once, if line ids
    rise from micro-batch to micro-batch. Stock lives in the stream's
    checkpoint from the first batch on; the products are read only then. Lines of
    unknown products are not covered. A micro-batch, whose size the source
    bounds, is the most that one shelf's task sorts. Needs the state store in `STATE_STORE`.
    """
    shelf = F.pmod(F.xxhash64("product_id"), F.lit(SHELVES)).cast("int")
    held = products.selectExpr("cast(id as long) as product_id", "cast(stock as long) as stock").filter("product_id is not null and stock is not null")
    wanted = lines.filter("product_id is not null").selectExpr("line_id", "cast(product_id as long) as product_id", "cast(quantity as long) as quantity")
    held, wanted = held.withColumn("shelf", shelf), wanted.withColumn("shelf", shelf)
    return wanted.groupBy("shelf").transformWithStateInPandas(
        statefulProcessor=_shelf(), outputStructType=SOLD, outputMode="Append", timeMode="None", initialState=held.groupBy("shelf")
    )


def sell_available(lines, products, out, checkpoint, partitions=None):
    """Sell what has arrived and stop: sold lines are appended to the Parquet folder `out`.

    Run again with the same checkpoint it goes on from there. `partitions` cuts
    the state; the first run decides.
    """
    spark = lines.sparkSession
    settings = {**STATE_STORE, **({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        sink = sell(lines, products).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
