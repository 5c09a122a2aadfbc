"""Column expressions. All stay inside generated code: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
DAYS_PER_YEAR = 365.2425
MISSING_TOKEN = "__MISSING__"
UNKNOWN_TOKEN = "__UNKNOWN__"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z"
HEX_DIGEST = r"^[0-9a-f]{64}\z"
ZONED_TIMESTAMP = "(Z|[+-][0-9]{2}:[0-9]{2})$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers ---------------------------------------------------------------------------------

def number(c) -> Column:
    """Lenient parse: text that is no number becomes null, and so does NaN."""
    return null_if_nan(col(c).try_cast("double"))


def strict_number(c) -> Column:
    """Strict parse: text that is no number stops the job (ANSI cast)."""
    return col(c).cast("double")


def null_if_nan(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def finite_or_null(c) -> Column:
    v = col(c)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def is_infinite(c) -> Column:
    return F.coalesce(F.abs(col(c)) == F.lit(float("inf")), F.lit(False))


def safe_divide(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def ten_digits(c) -> Column:
    """Round to 10 significant digits."""
    return F.when(col(c).isNotNull(), F.format_string("%.10g", col(c).cast("double")).cast("double"))


def half_even(c) -> Column:
    return F.rint(col(c))


def clip(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-clip(c, -35.0, 35.0)))


def logit(c) -> Column:
    p = clip(c, 1e-8, 1 - 1e-8)
    return F.log(p / (1 - p))


# --- flags, precedence -----------------------------------------------------------------------

def flag(pred: Column) -> Column:
    """1 or 0, where unknown counts as 0."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def first_known(*cols) -> Column:
    return F.coalesce(*[col(c) for c in cols])


def prefer_record(has: Column, a, b) -> Column:
    """Take ``a`` whenever its record exists, even when its value is null."""
    return F.when(has, col(a)).otherwise(col(b))


def any_of(*preds: Column) -> Column:
    out = F.lit(False)
    for p in preds:
        out = out | F.coalesce(p, F.lit(False))
    return out.cast("int")


# --- dates and times -------------------------------------------------------------------------

def parse_date(c) -> Column:
    return F.try_to_date(col(c), "yyyy-MM-dd")


def iso_date(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def age_years(birth, on) -> Column:
    return F.datediff(col(on), col(birth)) / F.lit(DAYS_PER_YEAR)


def utc_timestamp(c) -> Column:
    """Parse ISO text that carries a zone; text without one is null."""
    return F.when(col(c).rlike(ZONED_TIMESTAMP), F.try_to_timestamp(col(c)))


def scheduled_cutoff(first_session) -> Column:
    return col(first_session) - F.expr("INTERVAL 24 HOURS")


# --- text, urls, hashes, nested --------------------------------------------------------------

def is_identifier(c) -> Column:
    return F.coalesce(col(c).rlike(IDENTIFIER), F.lit(False))


def is_digest(c) -> Column:
    return F.coalesce(col(c).rlike(HEX_DIGEST), F.lit(False))


def url_host(c) -> Column:
    return F.lower(F.try_parse_url(col(c), F.lit("HOST")))


def url_allowed(c, hosts) -> Column:
    """https, a listed host, no user part, no port but 443."""
    u = col(c)
    authority = F.try_parse_url(u, F.lit("AUTHORITY"))
    return F.coalesce(
        (F.try_parse_url(u, F.lit("PROTOCOL")) == "https") & url_host(u).isin(*hosts)
        & F.try_parse_url(u, F.lit("USERINFO")).isNull() & (~authority.rlike(":[0-9]*$") | authority.endswith(":443")),
        F.lit(False))


def canonical_sha256(*cols: str) -> Column:
    """Digest of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def has_pair(pairs, a, b, fields=("a", "b")) -> Column:
    return F.exists(col(pairs), lambda p: (p[fields[0]] == col(a)) & (p[fields[1]] == col(b)))


def same_members(a, b) -> Column:
    return F.array_sort(col(a)) == F.array_sort(col(b))


def map_get(m, key, default) -> Column:
    return F.coalesce(F.try_element_at(col(m), col(key)), F.lit(default))


def display_name(c) -> Column:
    return F.initcap(F.replace(col(c), F.lit("-"), F.lit(" ")))


def fixed_digits(c, digits: int) -> Column:
    return F.when(col(c).isNotNull(), F.format_string(f"%.{digits}f", col(c))).otherwise("n/a")


def percent(c, digits: int = 1) -> Column:
    return F.when(col(c).isNotNull(), F.format_string(f"%.{digits}f%%", col(c) * 100)).otherwise("n/a")
