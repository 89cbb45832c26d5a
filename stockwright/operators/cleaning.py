"""Invoice lines to net sales: ordered rules, and cancellations netted LIFO."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Product codes: five digits and up to two letters (fixed pattern).
PRODUCT = r"^\d{5}[A-Za-z]{0,2}$"
LOOKBACK = 90


def normal_code(code: Column) -> Column:
    return F.upper(F.trim(code))


def is_cancel(invoice: Column, quantity: Column) -> Column:
    return F.coalesce(invoice.startswith("C") & (quantity < 0), F.lit(False))


def whole_weeks(first: date, last: date) -> tuple[date, date]:
    """Mondays of the first and last weeks that lie whole between two days."""
    return first + timedelta(days=-first.weekday() % 7), last - timedelta(days=(last.weekday() + 1) % 7 + 6)


def first_failed_rule() -> Column:
    """Name of the first rule that drops a line; null if none does."""
    cancel = F.coalesce(F.col("invoice").startswith("C"), F.lit(False))
    return F.when(~F.coalesce(F.col("stock_code").rlike(PRODUCT), F.lit(False)), F.lit("1 not a product code")).when(~cancel & ~F.coalesce(F.col("quantity") > 0, F.lit(False)), F.lit("2 negative, no cancellation")).when(~F.coalesce(F.col("price_gbp") > 0, F.lit(False)), F.lit("3 price not positive"))


def drop_sheet_overlap(lines: DataFrame) -> DataFrame:
    """Of two sheets that overlap in time keep the later one's copy. Raises if
    the copies differ as multisets of rows."""
    spans = lines.groupBy("sheet").agg(F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi")).orderBy("lo").limit(3).collect()
    if len(spans) < 2:
        return lines
    if len(spans) > 2:
        raise ValueError("at most two sheets can overlap")
    (a, _, hi), (b, lo, _) = spans
    if lo > hi:
        return lines
    key = [c for c in lines.columns if c not in ("sheet", "description")]
    first = lines.where((F.col("sheet") == a) & (F.col("invoice_date") >= F.lit(lo))).select(key)
    second = lines.where((F.col("sheet") == b) & (F.col("invoice_date") <= F.lit(hi))).select(key)
    if not first.exceptAll(second).isEmpty() or not second.exceptAll(first).isEmpty():
        raise ValueError("the two sheets differ where they overlap; dropping neither")
    return lines.where(~((F.col("sheet") == a) & (F.col("invoice_date") >= F.lit(lo))))


def net_cancellations(lines: DataFrame, days: int = LOOKBACK) -> DataFrame:
    """Net sales: a cancellation takes its quantity from the same customer's
    earlier sales of the same product, latest first, at most ``days`` back.
    Sales left with nothing go; lines keep their columns.

    Keys that have no cancellation are only projected. The others are folded
    over their lines in order of time, in one array per (customer, product);
    what a cancellation leaves or has no customer for is dropped.
    """
    cancel = is_cancel(F.col("invoice"), F.col("quantity"))
    tagged = lines.withColumn("_cancel", cancel)
    sales = tagged.where("NOT _cancel").drop("_cancel")
    keys = tagged.where("_cancel AND customer IS NOT NULL").select("customer", "stock_code").distinct()
    plain = sales.join(keys, ["customer", "stock_code"], "left_anti").select(*lines.columns)
    return plain.where("quantity > 0").unionByName(_net(tagged, keys, lines.columns, days).where("quantity > 0"))


def _folded(tagged: DataFrame, keys: DataFrame, columns: list[str], days: int) -> DataFrame:
    """(customer, stock_code, r): stack of sales after all cancellations, and
    matched and cancelled units."""
    row = F.struct(F.col("invoice_date").alias("at"), F.col("_cancel").alias("cancel"), F.col("invoice").alias("i"), F.col("line").alias("l"), F.col("quantity").alias("q"), F.struct(*columns).alias("row"))
    g = tagged.join(keys, ["customer", "stock_code"]).groupBy("customer", "stock_code").agg(F.array_sort(F.collect_list(row)).alias("events"))
    entry = F.struct(F.col("events")[0]["at"].alias("at"), F.lit(0.0).alias("left"), F.col("events")[0]["row"].alias("row"))
    start = F.struct(F.filter(F.array(entry), lambda x: F.lit(False)).alias("sales"), F.lit(0.0).alias("matched"), F.lit(0.0).alias("cancelled"))

    def step(a: Column, e: Column) -> Column:
        oldest = e["at"] - F.expr(f"interval {days} days")
        # latest sale first: each takes what later ones leave of the need
        taken = F.aggregate(
            F.reverse(a["sales"]),
            F.struct((-e["q"]).alias("need"), F.filter(a["sales"], lambda x: F.lit(False)).alias("out")),
            lambda b, s: F.struct(
                (b["need"] - F.when(s["at"] >= oldest, F.least(b["need"], s["left"])).otherwise(F.lit(0.0))).alias("need"),
                F.concat(b["out"], F.array(F.struct(s["at"].alias("at"), (s["left"] - F.when(s["at"] >= oldest, F.least(b["need"], s["left"])).otherwise(F.lit(0.0))).alias("left"), s["row"].alias("row")))).alias("out"),
            ),
        )
        sold = F.struct(F.concat(a["sales"], F.array(F.struct(e["at"].alias("at"), e["q"].alias("left"), e["row"].alias("row")))).alias("sales"), a["matched"].alias("matched"), a["cancelled"].alias("cancelled"))
        netted = F.transform(F.array(taken), lambda t: F.struct(F.reverse(t["out"]).alias("sales"), (a["matched"] + (-e["q"] - t["need"])).alias("matched"), (a["cancelled"] - e["q"]).alias("cancelled")))[0]
        return F.when(e["cancel"], netted).otherwise(sold)

    return g.select("customer", "stock_code", F.aggregate("events", start, step).alias("r"))


def _net(tagged: DataFrame, keys: DataFrame, columns: list[str], days: int) -> DataFrame:
    out = _folded(tagged, keys, columns, days).select(F.explode("r.sales").alias("s"))
    return out.select(*[F.col("s.left").alias(c) if c == "quantity" else F.col(f"s.row.{c}").alias(c) for c in columns])


def netting_stats(lines: DataFrame, days: int = LOOKBACK) -> DataFrame:
    """One row: cancellation rows, and cancelled, matched and unmatched units."""
    tagged = lines.withColumn("_cancel", is_cancel(F.col("invoice"), F.col("quantity")))
    keys = tagged.where("_cancel AND customer IS NOT NULL").select("customer", "stock_code").distinct()
    matched = _folded(tagged, keys, lines.columns, days).agg(F.coalesce(F.sum("r.matched"), F.lit(0.0)).alias("matched_units"))
    every = tagged.where("_cancel").agg(F.count(F.lit(1)).alias("cancellation_rows"), F.coalesce(F.sum(-F.col("quantity")), F.lit(0.0)).alias("cancelled_units"))
    return every.join(F.broadcast(matched)).withColumn("unmatched_units", F.col("cancelled_units") - F.col("matched_units"))


def cleaning_log(lines: DataFrame) -> DataFrame:
    """(rule, n_rows, sold_units, returned_units) of the rules before netting."""
    t = lines.withColumn("stock_code", normal_code(F.col("stock_code"))).withColumn("rule", F.coalesce(first_failed_rule(), F.lit("kept")))
    sold, back = F.sum(F.greatest("quantity", F.lit(0.0))), F.sum(F.greatest(-F.col("quantity"), F.lit(0.0)))
    return t.groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"), sold.alias("sold_units"), back.alias("returned_units"))


def clean_lines(lines: DataFrame, first_week: date | None = None, last_week: date | None = None) -> DataFrame:
    """All rules in order, netting, then whole weeks only; adds week."""
    t = lines.withColumn("stock_code", normal_code(F.col("stock_code")))
    if "sheet" in t.columns:
        t = drop_sheet_overlap(t)
    net = net_cancellations(t.where(first_failed_rule().isNull()))
    out = net.withColumn("week", F.date_trunc("week", "invoice_date").cast("date"))
    if first_week is not None:
        out = out.where(F.col("week").between(F.lit(first_week), F.lit(last_week)))
    return out


def modal_description(lines: DataFrame) -> DataFrame:
    """(stock_code, description): the most frequent one, ties to the smallest."""
    c = lines.where("description IS NOT NULL").groupBy("stock_code", "description").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("stock_code").agg(F.min(F.struct((-F.col("n")).alias("o"), "description")).alias("b")).select("stock_code", "b.description")
