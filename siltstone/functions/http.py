"""What an HTTP exchange means, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits (fixed values).
MAX_ATTEMPTS, BASE_BACKOFF, MAX_DELAY, MAX_BODY = 3, 0.5, 60.0, 5 * 1024 * 1024
REDIRECTS, RETRYABLE = (301, 302, 303, 307, 308), (429, 500, 502, 503, 504)
RETRYABLE_ERRORS = ("timeout", "connection_failure", "http_error")
SECRET_FIELDS = ("authorization", "cookie", "set-cookie", "proxy-authorization", "headers", "body", "content", "request", "response", "cookies")


def media_type(content_type: Column) -> Column:
    """The media type of a content-type header, in lower case and without parameters; empty for null."""
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def is_html(content_type: Column) -> Column:
    return media_type(content_type).isin("text/html", "application/xhtml+xml")


def fetch_outcome(status: Column, content_type: Column, size: Column, error_type: Column, attempts: Column, max_attempts: int = MAX_ATTEMPTS, max_body: int = MAX_BODY) -> Column:
    """struct(status, reason, error_type) of an exchange: size, transport failure, redirect, gone, retryable, other client errors, media type, ok."""
    outcome = lambda s, r, e: F.struct(F.lit(s).alias("status"), r.alias("reason"), e.alias("error_type"))
    none = F.lit(None).cast("string")
    failed = F.when(attempts >= max_attempts, F.lit("retry_exhausted")).otherwise(F.coalesce(error_type, F.lit("failed")))
    return (
        F.when(size > max_body, outcome("skipped", F.lit("size_exceeded"), F.lit("size_exceeded")))
        .when(status.isNull() | (status == 0), outcome("failed", failed, F.coalesce(error_type, failed)))
        .when(status.isin(*REDIRECTS), outcome("redirect", F.lit("redirect"), none))
        .when(status.isin(404, 410), outcome("gone", F.concat(F.lit("http_"), status.cast("string")), F.lit("gone")))
        .when((status == 429) | (status >= 500), outcome("failed", F.lit("retry_exhausted"), F.lit("retry_exhausted")))
        .when(status >= 400, outcome("failed", F.concat(F.lit("http_"), status.cast("string")), F.lit("http_error")))
        .when(~is_html(content_type), outcome("skipped", F.lit("non_html"), F.lit("non_html")))
        .otherwise(outcome("fetched", F.lit("ok"), none))
    )


def backoff_seconds(attempt: Column) -> Column:
    """Doubling from half a second, a minute at most."""
    return F.least(F.lit(BASE_BACKOFF) * F.pow(F.lit(2.0), attempt - 1), F.lit(MAX_DELAY))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: digits, or an HTTP date against `now`, between 0 and a minute; null where it is neither."""
    raw = F.trim(value)
    number = F.when(raw.rlike("^[0-9]{1,9}$"), F.least(F.when(raw.rlike("^[0-9]{1,9}$"), raw.cast("double")), F.lit(MAX_DELAY))).when(raw.rlike("^[0-9]+$"), F.lit(MAX_DELAY))
    when = F.try_to_timestamp(F.regexp_extract(raw, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    date = F.when(when.isNotNull(), F.least(F.greatest(when.cast("double") - now.cast("double"), F.lit(0.0)), F.lit(MAX_DELAY)))
    return F.coalesce(number, date)


def should_retry(status: Column, error_type: Column, attempt: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    return F.coalesce((attempt < max_attempts) & (F.coalesce(error_type.isin(*RETRYABLE_ERRORS), F.lit(False)) | F.coalesce(status.isin(*RETRYABLE), F.lit(False))), F.lit(False))


def rate_interval(rps: Column) -> Column:
    """Seconds between two requests; 0 for no or no positive rate."""
    return F.when(rps > 0, 1.0 / rps).otherwise(F.lit(0.0))


def user_agent(name: str, display_name: Column, contact: str) -> Column:
    return F.concat(F.lit(f"{name} ("), display_name, F.lit(f"; +{contact})"))


def safe_headers(headers: Column) -> Column:
    """Headers with lower-case names, without those that may hold secrets."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.map_filter(low, lambda k, v: ~k.isin(*SECRET_FIELDS))
