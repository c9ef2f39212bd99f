"""Calendar months as integers: index = 12 * year + month, and the parsers that make them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names by their first three letters, the two-digit year cutoff, words for an
# open end, and the forms in which a month is written, tried in this order: (form, pattern, groups of year and month).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CUTOFF = 39
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
NAME = rf"(?:{MONTH})\.?"
YEAR = r"(?:19|20)\d{2}"
DAY = "(?:0?[1-9]|[12][0-9]|3[01])"
PRESENT = r"present|till\s+(?:date|now)|to\s*date|current|now|ongoing"
SHORT = "month-yy"
YEAR_ALONE = rf"(?<!\d){YEAR}(?!\d)"
FORMS = (
    ("month year", rf"({MONTH})\.?[\s.\-/,]*?({YEAR})", 2, 1),
    ("month day year", rf"({MONTH})\.?\s*{DAY}(?:st|nd|rd|th)?[,\s]*({YEAR})", 2, 1),
    ("day month year", rf"{DAY}(?:st|nd|rd|th)?\s+({MONTH})\.?[,\s]*({YEAR})", 2, 1),
    ("month'yy", rf"({MONTH})\.?\s*[’']\s*(\d{{2}})(?!\d)", 2, 1),
    (SHORT, rf"({MONTH})\.?\s*[-./]\s*(\d{{2}})(?!\d)", 2, 1),
    ("number/year", rf"(?<!\d)(1[0-2]|0?[1-9])[\-/]({YEAR})(?!\d)", 2, 1),
    ("year-number", rf"(?<!\d)({YEAR})[\-/](1[0-2]|0?[1-9])(?!\d)", 1, 2),
)


def index(year: Column, month: Column) -> Column:
    return (year * 12 + month).cast("int")


def of_date(ts: Column) -> Column:
    return index(F.year(ts), F.month(ts))


def year_of(i: Column) -> Column:
    return F.floor((i - 1) / 12).cast("int")


def month_of(i: Column) -> Column:
    return (F.pmod(i - 1, F.lit(12)) + 1).cast("int")


def fmt(i: Column) -> Column:
    """YYYY-MM, null for null."""
    return F.when(i.isNotNull(), F.format_string("%04d-%02d", year_of(i), month_of(i)))


def widen(i: Column, precision: Column, end: bool) -> Column:
    """A year-precision endpoint becomes January or December of its year."""
    return F.when(precision == "year", index(year_of(i), F.lit(12 if end else 1))).otherwise(i)


def month_number(name: Column) -> Column:
    """1..12 for a month name or its abbreviation (also sept), else null."""
    head = F.lower(F.substring(F.trim(name), 1, 3))
    known = F.lower(F.trim(name)).rlike(f"^(?:{MONTH})$")
    return F.when(known, F.array_position(F.array(*(F.lit(m) for m in MONTHS)), head).cast("int"))


def expand_year(yy: Column) -> Column:
    """Two digits: up to the cutoff in this century, else in the last."""
    n = yy.cast("int")
    return F.when(n <= CUTOFF, n + 2000).otherwise(n + 1900)


def is_present(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).rlike(f"^(?:{PRESENT})$"), F.lit(False))


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def parse_month_year(text: Column) -> Column:
    """Month index of the first of the written forms that occurs anywhere in text; null if none does."""
    t = F.lower(text)
    out = []
    for name, pattern, y, m in FORMS:
        year, month = _group(t, pattern, y), _group(t, pattern, m)
        number = month.cast("int") if "number" in name else month_number(month)
        found = index(expand_year(year) if name in (SHORT, "month'yy") else year.cast("int"), number)
        out.append(F.when(~t.rlike(YEAR_ALONE), found) if name == SHORT else found)
    # what has no two digits in a row has no form
    return F.when(t.rlike(r"\d{2}"), F.coalesce(*out))


def endpoint(text: Column, as_of: Column) -> Column:
    """struct(i, precision) of one written end: a word for the present is as_of, a bare year its January with
    precision year, else the one date in the text; more than one date, or none, is null."""
    t = F.trim(text)
    now = F.coalesce(F.lower(t).isin("present", "current", "now", "ongoing"), F.lit(False))
    month = parse_month_year(t)
    years = F.regexp_extract_all(t, F.lit(rf"(?<!\d)(?<![+@$₹].?){YEAR}(?!\d)(?!.?[@%])"), F.lit(0))
    one = F.size(F.regexp_extract_all(t, F.lit(YEAR_ALONE), F.lit(0))) <= 1
    year = F.when(month.isNull() & (F.size(years) == 1), index(F.get(years, F.lit(0)).cast("int"), F.lit(1)))
    i = F.when(now, as_of).when(one, F.coalesce(month, year))
    return F.struct(i.cast("int").alias("i"), F.when(i.isNull(), None).when(now | month.isNotNull(), "month").otherwise("year").alias("precision"))


def comparable(text: Column) -> Column:
    """YYYY-MM, YYYY or present for comparing stored dates; an empty one is empty, anything else is tagged."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    year, number = _group(t, rf"^({YEAR})[-/.](\d{{1,2}})$", 1), _group(t, rf"^({YEAR})[-/.](\d{{1,2}})$", 2).cast("int")
    first, second = _group(t, rf"^(\d{{1,2}})[-/.]({YEAR})$", 1).cast("int"), _group(t, rf"^(\d{{1,2}})[-/.]({YEAR})$", 2)
    name = _group(t, rf"^([a-z]+)[\s,./-]*({YEAR})$", 1)
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    known = F.when(name.isin(*full, *MONTHS, "sept"), month_number(name))
    return (
        F.when(t == "", "").when(t.isin("present", "current", "now", "till now", "till date", "ongoing"), "present")
        .when(number.between(1, 12), F.format_string("%s-%02d", year, number)).when(first.between(1, 12), F.format_string("%s-%02d", second, first)).when(t.rlike(f"^{YEAR}$"), t)
        .when(known.isNotNull(), F.format_string("%s-%02d", _group(t, rf"^([a-z]+)[\s,./-]*({YEAR})$", 2), known)).otherwise(F.concat(F.lit("invalid:"), t))
    )


def variants(i: Column) -> Column:
    """The ways a month may be written in a text."""
    short = F.element_at(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), month_of(i))
    full = F.element_at(F.array(*(F.lit(m) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"))), month_of(i))
    y, m = year_of(i), month_of(i)
    return F.array(F.format_string("%s %d", short, y), F.format_string("%s %d", full, y), F.format_string("%02d/%d", m, y), F.format_string("%d-%02d", y, m), F.format_string("%s'%02d", short, y % 100))


def duration_label(months: Column) -> Column:
    """N yrs M mos, leaving out a zero part."""
    y, m = F.floor(months / 12).cast("int"), (months % 12).cast("int")
    part = lambda n, one, many: F.when(n == 1, F.lit(f"1 {one}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))
    return F.concat_ws(" ", part(y, "yr", "yrs"), part(m, "mo", "mos"))


def stored(text: Column) -> Column:
    """Month index of a stored pair such as (2020, 3)."""
    y, m = _group(text, r"(\d{4})\D+(\d{1,2})", 1), _group(text, r"(\d{4})\D+(\d{1,2})", 2)
    return index(y.cast("int"), m.cast("int"))
