"""Scalar column functions: names, codes, numbers, dates, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of company names, texts that mean null, and words that mean yes.
LEGAL_SUFFIXES = ("limited", "ltd", "private", "pvt", "company", "co", "corporation", "corp", "incorporated", "inc", "llp", "plc", "the")
NULL_TEXTS = ("", "-", "--", "---", "na", "n/a", "none", "null", "nan", "nil")
YES_TEXTS = ("true", "1", "1.0", "yes", "y")
NO_TEXTS = ("false", "0", "0.0", "no", "n")
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy")

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normalise_name(c: Column) -> Column:
    """Lower-case ASCII words joined by one blank; & reads as `and`."""
    folded = F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[^\\x00-\\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(F.replace(folded, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def name_tokens(normalised: Column) -> Column:
    stop = F.array(*map(F.lit, LEGAL_SUFFIXES))
    return F.filter(F.split(normalised, " "), lambda x: (x != "") & ~F.array_contains(stop, x))


def name_variants(normalised: Column) -> Column:
    """The name, the name without legal suffixes, its first three words; each once, in this order."""
    tokens = name_tokens(normalised)
    return F.array_distinct(F.array(normalised, F.array_join(tokens, " "), F.array_join(F.slice(tokens, 1, 3), " ")))


def slug(c: Column, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_")), "^_+|_+$", ""), F.lit("")), F.lit(default))


def clean_text(c: Column) -> Column:
    """Cell text, or null where it says nothing."""
    trimmed = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(~F.lower(trimmed).isin(*NULL_TEXTS), trimmed)


def normalise_code(c: Column) -> Column:
    code = F.upper(F.regexp_replace(F.trim(c.cast("string")), "^(\\d+)\\.0$", "$1"))
    return F.when(~F.lower(code).isin(*NULL_TEXTS), code)


def surrogate_id(stem: Column, *codes: Column) -> Column:
    return F.concat_ws("__", F.regexp_replace(F.trim(stem), "[^A-Za-z0-9]+", "_"), F.coalesce(*codes))


def metric_key(c: Column) -> Column:
    """Snake-case key of a header: % reads as pct, & as and; footnotes like [1] and a trailing + go."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "\\[\\d+\\]", " "), "\\+\\s*$", "")
    c = F.replace(F.replace(c, F.lit("%"), F.lit(" pct ")), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_number(c: Column) -> Column:
    """First number of a financial cell; parentheses negate."""
    text = F.regexp_replace(F.trim(c), "[,%₹\\s]|(?i)rs\\.?|(?i)cr\\.?", "")
    number = F.regexp_extract(text, "-?\\d+(?:\\.\\d+)?", 0).try_cast("double")
    return F.when(text.startswith("("), -number).otherwise(number)


def percent(value: Column, text: Column) -> Column:
    """Shares written as 0.15 become 15; 0.5% stays."""
    return F.when(~F.contains(text, F.lit("%")) & (F.abs(value) <= 1), value * 100).otherwise(value)


def to_crore(value: Column, unit: Column) -> Column:
    return F.when(F.contains(F.lower(unit), F.lit("million")), value / 10).otherwise(value)


def to_bool(c: Column) -> Column:
    """Two-valued: anything but a yes is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*YES_TEXTS), F.lit(False))


def to_bool3(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*YES_TEXTS), True).when(text.isin(*NO_TEXTS), False)


def safe_sum(*columns: Column) -> Column:
    """Sum that skips nulls; null if all are."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def cagr_pct(start: Column, end: Column, years: Column) -> Column:
    return F.when((start > 0) & (end > 0) & (years > 0), (F.pow(end / start, F.lit(1.0) / years) - 1) * 100)


def months_between_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / 30.4375


def parse_date(c: Column) -> Column:
    """First format that reads the text; month and year mean the first of the month."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), "\\s+,", ","), "(\\d)([A-Za-z]{3,})(\\d)", "$1 $2 $3")
    full = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    month = [F.to_date(F.try_to_timestamp(F.concat(F.lit("1 "), text), F.lit(f))) for f in ("d MMM yyyy", "d MMMM yyyy")]
    return F.coalesce(*full, *month)


def month_end(label: Column) -> Column:
    """`Mar 2025` as the last day of the month; ISO dates stay; TTM has none."""
    iso = F.to_date(F.try_to_timestamp(label, F.lit("yyyy-MM-dd")))
    return F.coalesce(iso, F.last_day(F.to_date(F.try_to_timestamp(F.concat(F.lit("1 "), label), F.lit("d MMM yyyy")))))


def fiscal_period(balance_date: Column, years: Column) -> Column:
    """The balance-sheet date, else 31 March of the second year of `2024-2025`."""
    second = F.nullif(F.regexp_extract(years, "(\\d{4})\\D+(\\d{4})", 2), F.lit(""))
    return F.coalesce(balance_date, F.concat(second, F.lit("-03-31")).try_cast("date"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1))


def list_of(c: Column) -> Column:
    """A JSON array or a Python list literal as an array; other text as its only element; blanks dropped."""
    text = F.trim(c)
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.translate(text, "'", '"'), "array<string>"))
    return F.filter(F.coalesce(F.when(text.startswith("["), parsed), F.array(text)), lambda x: x.isNotNull() & (F.trim(x) != ""))


def normalised_map(m: Column) -> Column:
    """Probabilities that sum to 1; negative ones count as 0 in the total."""
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    return F.transform_values(m, lambda _, v: F.try_divide(v, total))


def best_of_map(m: Column, rank: Column) -> Column:
    """Key of the greatest value; among equals the better (lower) rank. rank: map of key to rank."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), F.try_element_at(rank, e["key"]).alias("r"), e["key"].alias("k")))
    return F.array_min(entries)["k"]
