"""Column expressions: cleaning, ids, times, ratios and labels.  All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = "yyyy-MM-dd'T'HH:mm:ss"
#: Formats of the lenient time parser, in order.
_LENIENT = ["yyyy-MM-dd['T'][ ]HH:mm[:ss][.SSSSSSSSS][XXX][XX]", "d MMM yyyy HH:mm:ss XX", "dd-MM-yyyy HH:mm", "MMM d, yyyy", "yyyy/MM/dd", "yyyy-MM-dd"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Runs of white space, Unicode's too, become one space; trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.make_valid_utf8(col(c)), r"(?U)\s+", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def to_number(c: Column | str) -> Column:
    """A double after dropping ``$`` and ``,``; null where that fails."""
    return F.regexp_replace(col(c).cast("string"), r"[$,]", "").try_cast("double")


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def _json_text(c: Column | str) -> Column:
    """The value as JSON text, null for null."""
    body = F.regexp_extract(F.to_json(F.struct(col(c).cast("string").alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(col(c).isNull(), F.lit("null")).otherwise(body)


def article_id(variant: str = "url_title") -> Column:
    """Id of a record from its own columns.

    ``url_title``: SHA-1 of url and title.  ``json``: SHA-1 of the sorted JSON text of
    six fields.  ``listing``: SHA-256 of url, symbol, name and fetch time.  ``folded``:
    SHA-1 of lower-cased, trimmed url and title.
    """
    if variant == "url_title":
        return F.sha1(F.concat(_text("url"), _text("title")))
    if variant == "json":
        names = ["fetched_at", "name", "published_at", "symbol", "title", "url"]
        pairs = [F.concat(F.lit(f'"{n}": '), _json_text(n)) for n in names]
        return F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")))
    if variant == "listing":
        return F.sha2(F.concat_ws("|", *(_text(c) for c in ("url", "symbol", "name", "fetched_at"))), 256)
    if variant == "folded":
        return F.sha1(F.concat_ws("|", F.lower(F.trim(_text("url"))), F.lower(F.trim(_text("title")))))
    raise ValueError(f"no id variant {variant!r}")


def with_id(variant: str = "url_title") -> Column:
    """The record's own id, or one from its columns where that is missing or empty."""
    return F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), article_id(variant))


def parse_strict_utc(c: Column | str) -> Column:
    """Only ``YYYY-MM-DDTHH:MM:SS`` with ``Z`` or an offset; anything else is null."""
    text = col(c).cast("string")
    return F.coalesce(F.try_to_timestamp(text, F.lit(_STRICT + "XXX")), F.try_to_timestamp(text, F.lit(_STRICT + "XX")))


def parse_flexible_utc(c: Column | str, fallback: Column | str | None = None) -> Column:
    """ISO forms, mail dates and loose dates in turn, then ``fallback``."""
    # mail dates: the day's name says nothing new, and zone names become offsets
    text = F.regexp_replace(F.regexp_replace(F.trim(col(c).cast("string")), "^[A-Za-z]{3}, ", ""), " (GMT|UTC|UT)$", " +0000")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in _LENIENT]
    return F.coalesce(*tries, *([F.lit(fallback).cast("timestamp")] if fallback is not None else []))


def first_filled(*columns: Column | str) -> Column:
    """The first value that isn't null, empty or zero, as text."""
    texts = [col(c).cast("string") for c in columns]
    filled = [F.when((t != "") & ~F.coalesce(t.try_cast("double") == 0, F.lit(False)), t) for t in texts[:-1]]
    return F.coalesce(*filled, texts[-1])


def partition_date() -> Column:
    """First ten characters of fetched_at, else of published_at, else 'unknown'."""
    long = lambda c: F.when(F.length(F.col(c).cast("string")) >= 10, F.substring(F.col(c).cast("string"), 1, 10))
    return F.coalesce(long("fetched_at"), long("published_at"), F.lit("unknown"))


#: What a URL contains, in order, and the source that stands for.
URL_SOURCES = {"coinmarketcap": "coinmarketcap", "coingecko": "coingecko", "binance": "binance", "crypto": "crypto_news"}


def source_of_url(c: Column | str) -> Column:
    """A known source by what the URL contains, else scheme and host."""
    lower, out = F.lower(col(c)), None
    for part, name in URL_SOURCES.items():
        out = F.when(lower.contains(part), name) if out is None else out.when(lower.contains(part), name)
    return out.otherwise(F.substring_index(col(c), "/", 3))


def window_seconds(c: Column | str) -> Column:
    """Seconds of a label such as 10m, 1h or 7d; one hour for any other."""
    n = F.regexp_extract(F.lower(F.trim(col(c))), r"^(\d+)[mhd]$", 1).try_cast("long")
    unit = F.right(F.lower(F.trim(col(c))), F.lit(1))
    return F.coalesce(n * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400), F.lit(3600).cast("long"))


def symbol_key(c: Column | str = "symbol") -> Column:
    """Upper-cased and trimmed; null where blank."""
    return F.nullif(F.upper(F.trim(col(c))), F.lit(""))


def ieee_div(a: Column, b: Column) -> Column:
    """Division with infinities and NaN instead of an error."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, inf).when(a < 0, -inf).when(a == 0, nan)


def percent(change: Column, base: Column) -> Column:
    """100 * change / base; null where the base is null or 0."""
    return F.try_divide(change, F.when(base != 0, base)) * 100


def finite_or_zero(c: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


#: Least absolute correlation for each label.
SCALES = {
    "coarse": [(0.5, "strong"), (0.3, "moderate"), (0.1, "weak"), (0.0, "negligible")],
    "fine": [(0.7, "very strong"), (0.5, "strong"), (0.3, "moderate"), (0.1, "weak"), (0.0, "negligible")],
    "pearson": [(0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak"), (0.0, "very weak")],
}


def correlation_strength(c: Column | str, scale: str = "coarse") -> Column:
    size, out = F.abs(col(c)), None
    for least, label in SCALES[scale]:
        out = F.when(size >= least, label) if out is None else out.when(size >= least, label)
    return out


#: The words of an interpretation.
STRENGTHS_FR = [(0.7, "très forte"), (0.5, "forte"), (0.3, "modérée"), (0.1, "faible"), (0.0, "négligeable")]
VOLUME_FIRST, PRICE_FIRST, TOGETHER = "Le volume précède le prix de", "Le prix précède le volume de", "Volume et prix sont synchronisés"


def correlation_text(c: Column | str, lag: Column | str) -> Column:
    """Strength, direction and which of price and volume leads, in the sentences that users of the results know."""
    size, lag, strength = F.abs(col(c)), col(lag), None
    for least, label in STRENGTHS_FR:
        strength = F.when(size >= least, label) if strength is None else strength.when(size >= least, label)
    direction = F.when(col(c) > 0, "positive").otherwise("négative")
    lead = F.when(lag > 0, F.concat_ws(" ", F.lit(VOLUME_FIRST), lag, F.lit("période(s)"))).when(lag < 0, F.concat_ws(" ", F.lit(PRICE_FIRST), -lag, F.lit("période(s)"))).otherwise(TOGETHER)
    return F.concat(F.lit("Corrélation "), strength, F.lit(" ("), direction, F.lit("). "), lead, F.lit("."))
