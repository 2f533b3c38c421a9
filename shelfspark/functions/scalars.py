"""Cell-level functions as Column builders: numbers, dates, names, labels. Everything stays in Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CURRENCY = r"(?:US\$|S\$|HK\$|NT\$|SGD|USD|MYR|RM|IDR|PHP|THB|VND|\$|€|£|¥)"
NUMBER = rf"(?i)^\(?\s*(?:{CURRENCY}\s*)?([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)[^0-9]*$"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MONTH_NAMES = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
TOTAL_LABELS = ("TOTAL", "TOTALS", "SUBTOTAL", "SUB-TOTAL", "SUB TOTAL", "GRAND TOTAL")
LEGAL_WORDS = ("pte", "ltd", "llp", "co", "sdn", "bhd", "trading", "enterprise", "enterprises", "import", "export", "imports", "exports", "intl", "international", "sons", "and")
GOODS = {
    "bread": "local", "bun": "local", "hotdog": "local", "prata": "local", "eggs": "local", "egg": "local", "water": "local", "coca-cola": "local", "fanta": "local", "sprite": "local", "pepsi": "local",
    "7up": "local", "carbonated": "local", "spring roll skin": "local", "spring roll": "local",
    "milk": "import", "cheese": "import", "butter": "import", "cream": "import", "yoghurt": "import", "yogurt": "import", "ice cream": "import", "muesli": "import", "cereal": "import", "pasta": "import",
    "noodle": "import", "flour": "import", "biscuit": "import", "cracker": "import", "cookie": "import", "juice": "import", "coffee": "import", "sauce": "import", "ketchup": "import", "canned": "import",
    "tortilla": "import", "pizza": "import", "pastry": "import", "puff": "import", "mozzarella": "import", "parmesan": "import", "edam": "import", "cheddar": "import", "feta": "import", "gouda": "import",
    "cottage cheese": "import", "emmenthal": "import",
}
LEAD_DAYS = {"import": 112, "local": 21, "other": 56}
CONFIDENCE = {"MED": "MEDIUM", "MID": "MEDIUM", "M": "MEDIUM", "H": "HIGH", "L": "LOW", "INSUFFICIENT": "INSUFFICIENT_DATA", "UNKNOWN": "INSUFFICIENT_DATA", "N/A": "INSUFFICIENT_DATA"}
STATUS_LABELS = {"CRITICAL": "Critical", "LOW": "Running low", "HEALTHY": "Well stocked", "DEAD": "Not selling", "NORMAL": "OK"}


def lookup(c: Column, values: dict, other: Column | None = None) -> Column:
    """values[c], by a CASE over a few fixed values."""
    out = reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(next(iter(values.values())))))
    return out.otherwise(other) if other is not None else out


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_num(c: Column) -> Column:
    """A number at the start of a cell: thousands commas, currency in front, (x) for negatives, a unit behind. Digits behind it: null."""
    s = F.translate(F.trim(c), ",", "")
    negative = s.startswith("(")
    number = F.regexp_extract(s, NUMBER, 1).try_cast("double")
    return F.when(~negative, number).when(s.endswith(")"), -number)


def num_sql(c: Column) -> Column:
    """The numeric prefix of a cell after removing commas, $ signs, blanks; (x) is negative; no number is 0; null stays null."""
    s = F.replace(F.replace(F.regexp_replace(c, r"US\$|S\$|[$, ]", ""), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    prefix = F.regexp_extract(s, r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", 0)
    return F.when(c.isNotNull(), F.coalesce(F.when(prefix != "", prefix.try_cast("double")), F.lit(0.0)))


def num_cell(c: Column) -> Column:
    """The cell as a number if all of it is one, commas aside."""
    s = F.trim(F.translate(c, ",", ""))
    return F.when(s.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), s.try_cast("double"))


def parse_quantity(c: Column) -> Column:
    """The first signed number anywhere in the text, commas dropped."""
    found = F.regexp_extract(c, r"-?\d[\d,]*(?:\.\d+)?", 0)
    return F.when(found != "", F.translate(found, ",", "").try_cast("double"))


def fmt_quantity(x: Column, unit: Column) -> Column:
    return F.concat(F.bround(x, 0).cast("bigint").cast("string"), F.coalesce(F.concat(F.lit(" "), F.nullif(F.trim(unit), F.lit(""))), F.lit("")))


def fmt_num(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).when(x.isNotNull() & ~F.isnan(x), F.bround(x, 1).cast("string"))


def euro_number(c: Column) -> Column:
    """Dot-grouped thousands with a decimal comma, several dot groups, or a plain decimal comma."""
    s = F.trim(c)
    return s.rlike(r"^\d{1,3}(\.\d{3})+,\d+$") | s.rlike(r"^\d{1,3}(\.\d{3}){2,}$") | (s.rlike(r"^\d+,\d{1,2}$") & ~s.rlike(r"^\d{1,3}(,\d{3})+$"))


def match_key(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", "")


def spelled_key(c: Column) -> Column:
    """The match key with one blank where words border on each other."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def annotation_head(c: Column) -> Column:
    return F.trim(F.split(c, r"←|<-|->|\(|\*|//", 2)[0])


def is_total_row(name: Column, unit: Column | None = None) -> Column:
    """Bare total lines; with a total word at an edge only where the unit is blank."""
    pure = name.rlike(r"(?i)^\s*(grand\s+|sub\s*)?totals?\s*:?\s*$")
    if unit is None:
        return pure
    return pure | (name.rlike(r"(?i)^\s*(grand\s+|sub\s*)?totals?\b|\btotals?\s*:?\s*$") & (F.coalesce(F.trim(unit), F.lit("")) == ""))


def is_total_label(c: Column) -> Column:
    return F.upper(F.trim(c)).isin(*TOTAL_LABELS)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def removed_words(c: Column) -> Column:
    return F.filter(words(c), lambda w: w.isin(*LEGAL_WORDS))


def stripped_key(c: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.filter(words(c), lambda w: ~w.isin(*LEGAL_WORDS)), ""), F.lit("")), match_key(c))


def supplier_type_of_item(c: Column) -> Column:
    """From the first keyword, in the order of the table."""
    return F.coalesce(F.get(F.filter(F.array(*[F.when(F.lower(c).contains(word), kind) for word, kind in GOODS.items()]), lambda x: x.isNotNull()), F.lit(0)), F.lit("other"))


def supplier_type(c: Column) -> Column:
    return F.when(F.lower(c).contains("import"), "import").when(F.lower(c).contains("local"), "local").otherwise("other")


def month_number(name: Column) -> Column:
    """1-12 of a month's name or three letters, else null."""
    up = F.upper(name)
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), up), F.lit(0)), F.nullif(F.array_position(F.array(*map(F.lit, MONTH_NAMES)), up), F.lit(0)))
    return at.cast("int")


def date_parts(c: Column) -> Column:
    """The two small numbers of D/M/Y text (a, b), null for other shapes."""
    return F.struct(*[F.regexp_extract(F.trim(c), r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?:[ T].*)?$", i).try_cast("int").alias(x) for i, x in ((1, "a"), (2, "b"), (3, "y"))])


def month_key(c: Column, day_first: Column) -> Column:
    """The first day of the month of raw date text; null if unreadable. Times after the date are ignored; two-digit years are 20xx."""
    iso = r"^(\d{4})[/.-](\d{1,2})(?:[/.-]\d{1,2})?(?:[ T].*)?$"
    named = r"^(\d{1,2})[ /-]([A-Za-z]{3,9})[ /-](\d{4}|\d{2})(?:[ T].*)?$"
    ym = lambda y, m: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"))

    def read(s: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(s, pattern, i)
        serial = F.date_add(F.lit("1899-12-30").cast("date"), s.try_cast("double").cast("int"))
        return (
            F.when(s.rlike(r"^\d{4}[/.-]"), ym(part(iso, 1).try_cast("int"), part(iso, 2).try_cast("int")))
            .when(s.rlike(r"^\d{1,2}[ /-][A-Za-z]"), ym(part(named, 3).try_cast("int"), month_number(part(named, 2))))
            .when(s.rlike(r"^\d{1,2}[/.-]\d"), let(date_parts(s), lambda p: ym(p["y"], F.when(day_first, p["b"]).otherwise(p["a"]))))
            .when(s.rlike(r"^[2-7]\d{4}(\.\d+)?$|^80000(\.0+)?$"), let(serial, lambda d: ym(F.year(d), F.month(d))))
        )

    full = lambda p: let(F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"]), lambda y: F.when(y.between(1900, 2200) & p["m"].between(1, 12), F.make_date(y, p["m"], F.lit(1))))
    return let(let(F.trim(c), read), full)


def cell_month(c: Column) -> Column:
    """The month (1-12) that a header cell names, else 0; bare integers name none."""
    s = F.trim(c)
    number = lambda pattern, i: F.regexp_extract(s, pattern, i).try_cast("int")
    found = F.coalesce(
        month_number(s), number(r"^[Mm](\d{1,2})$", 1), month_number(F.regexp_extract(s, r"^([A-Za-z]{3,9})[-/ ]?\d{2,4}$", 1)),
        number(r"^\d{4}[-/](\d{1,2})$", 1), number(r"^(\d{1,2})[-/]\d{4}$", 1),
    )
    return F.when(found.between(1, 12), found).otherwise(0)


def lead_time_days(c: Column) -> Column:
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(WEEK|DAY|MONTH)"
    n, unit = F.regexp_extract(c, pattern, 1).try_cast("double"), F.upper(F.regexp_extract(c, pattern, 2))
    return F.bround(n * lookup(unit, {"WEEK": 7, "DAY": 1, "MONTH": 30}), 0).cast("bigint")


def month_span(months: Column) -> Column:
    """[1..5] as Jan-May with an en dash; with gaps a comma list."""
    m = F.array_sort(F.array_distinct(F.filter(months, lambda x: x.between(1, 12))))
    name = lambda i: F.initcap(F.get(F.array(*map(F.lit, MONTHS)), i - 1))
    run = F.concat(name(F.get(m, F.lit(0))), F.lit("–"), name(F.get(m, F.size(m) - 1)))
    gaps = F.array_join(F.transform(m, name), ", ")
    return F.when((F.size(m) > 1) & (F.get(m, F.size(m) - 1) - F.get(m, F.lit(0)) + 1 == F.size(m)), run).otherwise(gaps)


def age_text(then: Column, as_of: Column) -> Column:
    s = F.unix_timestamp(as_of) - F.unix_timestamp(then)
    unit = lambda n, x: F.concat(F.floor(s / n).cast("string"), F.lit(f"{x} ago"))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).when(s.isNotNull(), unit(86400, "d"))


def dmy(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "dd/MM/yyyy"), F.substring(c, 1, 10))


def status_label(c: Column) -> Column:
    return lookup(F.upper(c), STATUS_LABELS, F.initcap(F.coalesce(c, F.lit(""))))


def confidence_norm(c: Column) -> Column:
    up = F.upper(F.trim(c))
    known = F.when(up.isin("HIGH", "MEDIUM", "LOW", "INSUFFICIENT_DATA"), up).otherwise(lookup(up, CONFIDENCE, F.lit("INSUFFICIENT_DATA")))
    return F.when(F.coalesce(up, F.lit("")) == "", c).otherwise(known)


def csv_safe_cell(c: Column) -> Column:
    return F.coalesce(F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c), F.lit(""))


def fence_untrusted(c: Column, tag: str = "data") -> Column:
    return F.concat(F.lit(f"<{tag}>"), F.regexp_replace(F.coalesce(c, F.lit("")), r"</?[A-Za-z][^<>\n]*>", ""), F.lit(f"</{tag}>"))


def effective(edit: Column, suggestion: Column) -> Column:
    return F.coalesce(F.when(~F.lower(F.trim(edit)).isin("", "null"), edit), suggestion)


def looks_unit(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike("^[A-Z]{1,6}$"), F.lit(False))


def group_slug(c: Column) -> Column:
    return F.concat(F.lit("sg-"), F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), 1, 60))


def context_text(delayed: Column, large: Column, discontinued: Column, other: Column) -> Column:
    line = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), F.trim(c)))
    text = F.array_join(F.array_compact(F.array(line("Delayed suppliers", delayed), line("Large orders", large), line("Discontinued", discontinued), line("Other", other))), "\n")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("No additional context provided."))
