"""Matches replaced by what is computed from them: tags kept out of a translation, amounts in lakh and crore, unwrapped replies, waits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inline tags and their sentinels; amounts; a reply wrapped in a record; what a rate limit's message says.
INLINE_TAG = r"(?i)</?(?:strong|em|u)\s*>|<br\s*/?>"
ANY_TAG = r"<[^>]+>"
SENTINEL = r"\[__VTAG_(\d{4})__\]"
MILLION, BILLION = r"(?i)\b(\d+(?:\.\d+)?)\s*million\b", r"(?i)\b(\d+(?:\.\d+)?)\s*billion\b"
LAKH, CRORE = "लाख", "करोड़"
WRAPPER = (
    r"""(?s)\{\s*(?:['"]description['"]\s*:\s*['"][^'"]*['"]\s*,\s*)?(?:['"]title['"]\s*:\s*['"][^'"]*['"]\s*,\s*)?"""
    r"""(?:['"]type['"]\s*:\s*['"][^'"]*['"]\s*,\s*)?['"]content['"]\s*:\s*['"](.*?)['"]\s*\}"""
)
LIMIT_WORDS = ("429", "rate limit", "resource_exhausted", "resource has been exhausted")
AFTER_MS, AFTER_S, DELAY = r"(?i)try again in\s+(\d+(?:\.\d+)?)\s*ms", r"(?i)try again in\s+(\d+(?:\.\d+)?)\s*s\b", r"(?i)retry[_-]?delay[^0-9]*(\d+(?:\.\d+)?)\s*s"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def substituted(text: Column, pattern: str, replacement: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """The text with each match replaced by what ``replacement`` makes of the match (or a group of it) and its number, counted from 0."""
    found = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    parts = lambda t: F.split(t, pattern, -1)  # noqa: E731  # one more than there are matches
    # the text and both of these are bound to a lambda's variable, so each is computed once, also where substitutions are nested
    joined = lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.when(i < F.size(x["found"]), F.concat(p, replacement(F.get(x["found"], i), i))).otherwise(p)), "")
    return bound(text, lambda t: bound(F.struct(parts(t).alias("parts"), found(t).alias("found")), joined))


def protected(text: Column, pattern: str = INLINE_TAG) -> Column:
    """A struct of the text with numbered sentinels in the place of its tags, and the tags."""
    return F.struct(substituted(text, pattern, lambda _, i: F.format_string("[__VTAG_%04d__]", i)).alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tags"))


def restored(text: Column, tags: Column) -> Column:
    """The tags in the place of their sentinels, wherever a translation has put them; a sentinel without a tag stays."""
    known = lambda n: F.get(tags, n.cast("int"))
    return substituted(text, SENTINEL, lambda n, _: F.coalesce(known(n), F.concat(F.lit("[__VTAG_"), n, F.lit("__]"))), group=1)


def short_number(value: Column) -> Column:
    """A positive number as it is if whole, otherwise with six significant digits and no zeros behind them."""
    unit = F.pow(F.lit(10.0), 5 - F.floor(F.log10(value)))
    rounded = F.rint(value * unit) / unit
    power = F.floor(F.log10(rounded))  # one more where rounding carries over
    digits = lambda form, x: F.regexp_replace(F.format_string(form, x), r"\.?0+$", "")
    general = F.when(power >= 6, F.concat(digits("%.5f", rounded / F.pow(F.lit(10.0), power)), F.format_string("e+%02d", power.cast("int")))).otherwise(digits("%.12f", rounded))
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(general)


def exact_number(digits: Column, factor: int) -> Column:
    """A decimal number, as written, times a whole one, with all its digits; null if there are more than 22 before or twelve behind the point."""
    fits = digits.rlike(r"^\d{1,22}(?:\.\d{1,12})?$")
    times = (F.when(fits, digits).cast("decimal(34,12)") * F.lit(factor).cast("decimal(4,0)")).cast("decimal(38,12)").cast("string")
    return F.regexp_replace(times, r"\.?0+$", "")


def local_units(text: Column, exact: bool = False) -> Column:
    """``N million`` as ten times as many lakh, ``N billion`` as a hundred times as many crore; broken ones with six significant digits, or ``exact``."""
    short = lambda n, factor: short_number(n.cast("double") * factor)
    number = (lambda n, factor: F.coalesce(exact_number(n, factor), short(n, factor))) if exact else short
    amount = lambda factor, unit: lambda n, _: F.concat(number(n, factor), F.lit(f" {unit}"))
    return substituted(substituted(text, BILLION, amount(100, CRORE), group=1), MILLION, amount(10, LAKH), group=1)


def unwrapped(text: Column) -> Column:
    """A reply whose first record with a content is replaced by the content, without its escapes."""
    parts = F.split(text, WRAPPER, 2)
    content = F.regexp_extract(text, WRAPPER, 1)
    for escaped, plain in (("\\'", "'"), ('\\"', '"'), ("\\n", "\n")):
        content = F.replace(content, F.lit(escaped), F.lit(plain))
    return F.when(F.size(parts) > 1, F.concat(parts[0], content, F.get(parts, F.lit(1)))).otherwise(text)


def rate_limited(status: Column, message: Column) -> Column:
    """Whether an error says that too many requests were made."""
    lower = F.lower(message)
    found = F.coalesce(status == 429, F.lit(False))
    for word in LIMIT_WORDS:
        found = found | F.coalesce(lower.contains(word), F.lit(False))
    return found


def retry_after(message: Column) -> Column:
    """The seconds that an error's message asks to wait, or null."""
    number = lambda pattern: F.nullif(F.regexp_extract(message, pattern, 1), F.lit("")).cast("double")
    milliseconds = number(AFTER_MS) / 1000
    return F.coalesce(F.when(milliseconds.isNotNull(), F.greatest(F.lit(0.001), milliseconds)), number(AFTER_S), number(DELAY))


def wait_seconds(status: Column, attempt: Column, base: Column, header: Column) -> Column:
    """How long to wait before an attempt: what the header says, two minutes at most; else longer each time, one minute at most."""
    said = F.trim(header).try_cast("double")
    growing = F.least(F.lit(60.0), base * F.pow(F.when(status == 429, 2.5).otherwise(2.0), attempt))
    return F.when(said.isNotNull(), F.least(F.lit(120.0), said)).otherwise(growing)
