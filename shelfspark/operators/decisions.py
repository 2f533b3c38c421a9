"""Rules on single items: supply, status, order size, order date, explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.scalars import parse_quantity

BUFFERS = ((0.15, 0.5), (0.35, 1.5))
OVER = 2.5


def months_of_supply(stock: Column, avg: Column) -> Column:
    return F.when((avg > 0) & stock.isNotNull(), F.bround(stock / avg, 1))


def expected_status(months: Column, lead_months: Column, stock: Column, sold: Column) -> Column:
    """Null where only judgement can tell."""
    sold = F.bround(sold, 0)
    low = F.when(lead_months > 0, lead_months).otherwise(F.lit(1.0))
    return (
        F.when(stock.isNull(), F.when(sold > 0, "LOW").otherwise("HEALTHY"))
        .when(sold.isNull(), F.when(stock == 0, "DEAD").otherwise("HEALTHY"))
        .when((sold > 0) & (stock == 0), "CRITICAL")
        .when(months.isNotNull(), F.when(months < low, "CRITICAL").when(months <= low + 2, "LOW").otherwise("HEALTHY"))
    )


def final_status(*args: Column) -> Column:
    return F.coalesce(expected_status(*args), F.lit("DEAD"))


def safety_buffer(delay: Column) -> Column:
    return F.when(delay <= BUFFERS[0][0], BUFFERS[0][1]).when(delay <= BUFFERS[1][0], BUFFERS[1][1]).otherwise(OVER)


def suggested_quantity(avg: Column, lead_days: Column, delay: Column) -> Column:
    lead = F.when(lead_days > 0, lead_days / 30).otherwise(F.lit(2.0))
    return F.when(avg > 0, F.bround(F.bround(avg, 1) * (lead + safety_buffer(delay)), 0).cast("bigint"))


def sanitized_quantity(text: Column, baseline: Column) -> Column:
    """A stated quantity within 10 times the baseline stays, else the baseline; without one, numbers give way to a note."""
    n = parse_quantity(text)
    number = F.when((n > 0) & (n <= 10 * baseline), n).otherwise(baseline)
    shown = F.bround(number, 0).cast("bigint").cast("string")
    note = F.when((F.trim(text) == "") | text.isNull() | n.isNotNull(), "Verify with team").otherwise(text)
    return F.when(baseline > 0, shown).otherwise(note)


def buffer_days(days_of_supply: Column, lead_days: Column) -> Column:
    return F.bround(days_of_supply - lead_days, 0).cast("int")


def order_status(buffer: Column) -> Column:
    return F.when(buffer < 0, "overdue").when(buffer <= 7, "urgent").when(buffer.isNotNull(), "ok").otherwise("unknown")


def order_by_text(status: Column, date: Column) -> Column:
    return F.when(status.isin("overdue", "urgent"), "ASAP").when(status == "ok", F.date_format(date, "dd MMM yyyy")).otherwise("—")


def order_covers(qty: Column, avg: Column) -> Column:
    return F.when((qty > 0) & (avg > 0), F.bround(qty / avg, 1))


def urgency_rank(status: Column) -> Column:
    return F.when(status == "overdue", 0).when(status == "urgent", 1).when(status == "ok", 2).otherwise(3)


def confidence_reasons(level: Column, supplier: Column, lead_days: Column, days_of_supply: Column, risk: Column, flags: Column) -> Column:
    reasons = F.array_compact(F.array(
        F.when(level == "INSUFFICIENT_DATA", "Supplier or sales history not in system."), F.when(F.coalesce(supplier, F.lit("")).isin("", "Unknown", "unknown", "—"), "Supplier not on file."),
        F.when(lead_days.isNull(), "Lead time unknown — buffer based on supplier type.").otherwise(F.concat(F.lit("Lead time on file: "), lead_days.cast("int").cast("string"), F.lit(" days."))),
        F.when(days_of_supply.isNull(), "Stock runway unknown — limited sales history."), F.when(risk == "HIGH", "Supplier flagged as high-risk (delays or unreliable)."),
    ))
    return F.concat(reasons, F.slice(F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda x: x != ""), 1, 3))


def item_line(item: Column, category: Column, stock: Column, stock_raw: Column, months: Column, sold: Column, revenue: Column, supply: Column, lead_days: Column) -> Column:
    """One line of text about an item for a scoring model: unreadable stock is named as missing, absent sales as no data, tags only with a value."""
    blank = F.coalesce(F.nullif(F.trim(stock_raw), F.lit("")), F.lit("blank"))
    stock_text = F.when(stock.isNull(), F.concat(F.lit('unreadable ("'), blank, F.lit('") — missing data, not zero'))).otherwise(stock_raw)
    sold_text = F.when(sold.isNull(), "no sales data in upload").otherwise(F.bround(sold, 0).cast("bigint").cast("string"))
    tag = lambda test, *parts: F.when(test, F.concat(*parts))
    return F.concat_ws(
        " | ", F.concat(F.lit("Item: "), item), F.concat(F.lit("Category: "), F.coalesce(category, F.lit(""))), F.concat(F.lit("Stock: "), stock_text),
        F.concat(F.lit("Total sold ("), months.cast("string"), F.lit("mo): "), sold_text), tag(revenue > 0, F.lit("Revenue: "), F.bround(revenue, 0).cast("bigint").cast("string")),
        tag(supply.isNotNull(), F.lit("Months of supply: "), supply.cast("string")), tag(lead_days > 0, F.lit("Lead time: "), lead_days.cast("string"), F.lit("d ("), F.bround(lead_days / 30, 1).cast("string"), F.lit("mo)")),
    )


def quantity_basis(avg: Column, unit: Column, quantity: Column, lead_days: Column) -> Column:
    """How an order was sized, in a sentence; null without monthly sales."""
    shown = lambda x: F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.bround(x, 1).cast("string"))
    lead = shown(F.bround(lead_days / 30, 1))
    sells = F.concat(F.lit("You sell about "), shown(avg), F.coalesce(unit, F.lit(" units")), F.lit("/month"))
    takes = F.coalesce(F.concat(F.lit(", and this supplier takes about "), lead, F.lit(" months")), F.lit(""))
    covers = F.when(lead.isNotNull(), "the wait plus a safety buffer").otherwise("expected demand plus a safety buffer")
    order = F.when(F.trim(quantity) != "", F.concat(F.lit(" Suggested order: "), F.trim(quantity), F.lit(" — covers "), covers, F.lit("."))).otherwise("")
    return F.when(avg > 0, F.concat(sells, takes, F.lit("."), order))


def has_stakes(if_not: Column, if_acting: Column) -> Column:
    """Whether either consequence says something."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled(if_not) | filled(if_acting)
