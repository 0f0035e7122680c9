"""Text, number and label normalisation as Column expressions: they stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Availability words and currency signs.
AVAILABILITY = {"instock": "true", "in_stock": "true", "outofstock": "false", "out_of_stock": "false", "preorder": "preorder"}
YES = ["1", "true", "yes", "да", "in stock", "available", "instock", "https://schema.org/instock", "http://schema.org/instock"]
CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₽": "RUB", "руб": "RUB", "руб.": "RUB"}
# Titles that are no titles, and names of sites.
NO_TITLE = ["robot or human?", "access denied", "home", "untitled"]
SITE_NAMES = (
    "nature science bbc cnn reuters wikipedia google github microsoft apple amazon facebook twitter x youtube medium "
    "substack wordpress blogger home docs documentation api reference index"
).split()


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether the text contains one of the needles."""
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def clean_text(x: Column) -> Column:
    """White space of any script collapsed and stripped, one pair of wrapping quotes removed; null gives ''."""
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))
    quoted = (F.length(t) >= 2) & (((F.left(t, F.lit(1)) == F.right(t, F.lit(1))) & F.left(t, F.lit(1)).isin('"', "'", "«", "»", "“", "”")) | (t.startswith("«") & t.endswith("»")))
    return F.when(quoted, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def price_number(x: Column) -> Column:
    """The number in a price text: one comma after the last dot is a decimal comma, other commas group digits. Null where
    no number is left."""
    c = F.regexp_replace(x, r"[^0-9.,-]", "")
    last_comma, last_dot = F.length(c) - F.instr(F.reverse(c), ","), F.when(F.instr(F.reverse(c), ".") == 0, -1).otherwise(F.length(c) - F.instr(F.reverse(c), "."))
    decimal_comma = (F.regexp_count(c, F.lit(",")) == 1) & (last_comma > last_dot)
    n = F.when(decimal_comma, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(","), F.lit("")))
    return n.try_cast("double")


def plain_number(x: Column) -> Column:
    """A number with grouping and decimal separators told apart by their last position; null for junk, also for digits
    parted by spaces."""
    c = F.trim(F.regexp_replace(x, r"[^0-9,.\s-]", ""))
    commas, dots = F.regexp_count(c, F.lit(",")), F.regexp_count(c, F.lit(r"\."))
    pos = lambda s: F.when(F.instr(F.reverse(c), s) == 0, -1).otherwise(F.length(c) - F.instr(F.reverse(c), s))
    as_comma = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    as_dot = F.replace(c, F.lit(","), F.lit(""))
    one_comma = (pos(",") > pos(".")) & (commas == 1)
    one_dot = (pos(".") > pos(",")) & (dots == 1)
    n = F.when((commas == 0) & (dots == 0), c).when(one_comma, as_comma).when(one_dot, as_dot).otherwise(F.coalesce(F.when(as_dot.try_cast("double").isNotNull(), as_dot), as_comma))
    return F.when(~n.rlike(r"\s"), n.try_cast("double"))


def currency_code(x: Column) -> Column:
    """A sign or name to three capital letters."""
    t = F.trim(x)
    out = F.upper(F.left(t, F.lit(3)))
    for sign, code in CURRENCY.items():
        out = F.when(t == sign, code).otherwise(out)
    return out


def availability(x: Column) -> Column:
    """`true`, `false`, `preorder`, or the text itself: the last part of a schema address decides."""
    last = F.lower(F.element_at(F.split(F.trim(x), "/"), -1))
    out = x
    for word, value in AVAILABILITY.items():
        out = F.when(last == word, value).otherwise(out)
    return out


def canonical_value(field: Column, x: Column) -> Column:
    """The form in which two values of a field are compared."""
    t = F.lower(F.trim(x))
    price = F.regexp_replace(t, r"[\s\x{00A0},]", "")
    avail = F.regexp_replace(t, r"^https?://schema\.org/", "")
    return F.when(field == "price", price).when(field == "availability", avail).otherwise(t)


def weak_title(x: Column) -> Column:
    """Titles that should not win: empty, challenge pages, site names, one short word, abstracts."""
    s = F.trim(x)
    low = F.lower(s)
    one_word = ~s.contains(" ") & (F.length(s) <= 12) & s.rlike(r"^\p{L}+$")
    abstract = (F.length(s) > 80) & s.rlike(r"^\p{Ll}")
    return x.isNull() | (F.length(s) < 2) | low.isin(*NO_TITLE, *SITE_NAMES) | one_word | abstract | low.startswith("general-purpose") | low.startswith("a type of")


def is_weak_title(x: str | None) -> bool:
    """`weak_title` for code that already runs in a Python worker."""
    s = (x or "").strip()
    low = s.lower()
    one_word = " " not in s and len(s) <= 12 and s.isalpha()
    return len(s) < 2 or low in NO_TITLE or low in SITE_NAMES or one_word or (len(s) > 80 and s[0].islower()) or low.startswith(("general-purpose", "a type of"))


#: Languages that write a comma before the decimals and group digits by dots or spaces.
COMMA_LANGUAGES = ["de", "fr", "es", "it", "ru", "pt", "nl", "pl", "sv", "da", "nb", "fi", "cs", "tr", "uk"]


def local_number(x: Column, locale: Column) -> Column:
    """A number as its locale writes it. The locale decides only where the text leaves both readings open: one separator with
    three digits after it (`1.234`, `1,234`); everything else reads as in `plain_number`, spaces between digit groups aside.
    A null locale leaves the open case to `plain_number`."""
    t = F.regexp_replace(F.trim(x), r"(?U)(?<=\d)[\s'’](?=\d{3}(?!\d))", "")
    open_ = t.rlike(r"^\D*\d{1,3}[.,]\d{3}\D*$")
    comma = F.lower(F.substring_index(F.replace(locale, F.lit("_"), F.lit("-")), "-", 1)).isin(*COMMA_LANGUAGES)
    digits = F.regexp_extract(t, r"(-?\d{1,3}[.,]\d{3})", 1)
    groups = F.when(comma, F.lit(".")).otherwise(F.lit(","))
    read = F.replace(F.replace(digits, groups, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(open_ & locale.isNotNull(), read).otherwise(plain_number(t))


def coerced(x: Column, kind: str, locale: Column | None = None) -> Column:
    """A text as number, integer, boolean, url or string; null where it is none. locale: how its numbers are written."""
    if kind == "number":
        return plain_number(x) if locale is None else local_number(x, locale)
    if kind == "integer":
        return F.coalesce(F.nullif(F.regexp_replace(x, r"\D", ""), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    if kind == "boolean":
        return F.lower(x).isin(*YES)
    if kind == "url":
        return F.when(x.startswith("http"), x)
    return clean_text(x)


def loose_match(a: Column, b: Column) -> Column:
    """Equal, one within the other, or numbers within a tenth; case and outer space aside."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    n, m = x.try_cast("double"), y.try_cast("double")
    return (x == y) | x.contains(y) | y.contains(x) | F.coalesce(F.abs(n - m) <= 0.1 * F.greatest(F.abs(m), F.lit(1e-9)), F.lit(False))


def rule_holds(kind: Column, value: Column, equals: Column, needles: Column, allowed: Column, lo: Column, hi: Column, min_len: Column) -> Column:
    """A ground-truth rule of a kind (equals, contains, in, range, min_len) held against a value; null holds nothing."""
    v = F.lower(F.trim(value))
    n = value.try_cast("double")
    ok = (
        F.when(kind == "equals", v == F.lower(F.trim(equals)))
        .when(kind == "contains", F.forall(needles, lambda x: F.lower(value).contains(F.lower(x))))
        .when(kind == "in", F.exists(allowed, lambda x: F.lower(x) == v))
        .when(kind == "range", n.between(lo, hi))
        .when(kind == "min_len", F.length(F.trim(value)) >= min_len)
    )
    return F.coalesce(ok, F.lit(False))


def rule_strength(kind: Column) -> Column:
    return F.when(kind.isin("equals", "in", "range"), "strict").when(kind.isin("contains", "min_len"), "soft").otherwise("unknown")
