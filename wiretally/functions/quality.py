"""Column-quality rules: each maps a string column to ``struct(is_valid, value, error)``.

``chain`` stops at the first rule that fails. The job over whole tables is
``wiretally.operators.quality.check_columns``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

Rule = Callable[[Column], Column]

_BLANKS = " \t\n\r\f\x0b"

# --- fixed values: patterns and limits ------------------------------------------------------------

EMAIL = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+"
    r"@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+\z"
)
CLEAN_EMAIL = r"(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\z"
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\z"
SPECIALS = "!@#$%^&*()_+-=[]{}|;:,.<>?~`"
COMMON_PASSWORD_PARTS = [r"^123", "abc", "qwerty", "password", r"(.)\1{2,}"]
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")]
SQL_TOKENS = ["--", r"/\*", r"\*/", "xp_", "EXEC(UTE)?", "UNION", "SELECT", "INSERT", "UPDATE", "DELETE", "DROP"]
# name: minimum, maximum, upper, lower, digit, special
PASSWORD_PRESETS = {
    "default": (8, 128, True, True, True, True),
    "weak": (6, 128, False, False, False, False),
    "moderate": (8, 128, True, True, True, False),
    "strong": (12, 128, True, True, True, True),
    "enterprise": (16, 256, True, True, True, True),
}


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def outcome(ok: Column, value: Column, error: Column | str) -> Column:
    """A rule's result; a null input fails."""
    good = F.coalesce(ok, F.lit(False))
    text = F.lit(error) if isinstance(error, str) else error
    return F.struct(
        good.alias("is_valid"), F.when(good, value.cast("string")).alias("value"), F.when(~good, text).alias("error")
    )


def chain(*rules: Rule) -> Rule:
    """Feed each rule the previous one's value; the first failure is the result."""

    def run(c: Column) -> Column:
        result = rules[0](c)
        for rule in rules[1:]:
            result = F.when(result["is_valid"], rule(result["value"])).otherwise(result)
        return result

    return run


def not_empty(c: Column) -> Column:
    return outcome(F.length(_strip(c)) > 0, _strip(c), "Value cannot be empty")


def length(minimum: int = 0, maximum: int | None = None) -> Rule:
    def rule(c: Column) -> Column:
        n = F.char_length(c)
        error = F.when(n < minimum, F.lit(f"Value must be at least {minimum} characters"))
        ok = n >= minimum
        if maximum is not None:
            ok = ok & (n <= maximum)
            error = error.otherwise(F.lit(f"Value must be at most {maximum} characters"))
        return outcome(ok, c, F.when(c.isNull(), F.lit("Value must be a string")).otherwise(error))

    return rule


def match(pattern: str, error: str = "Value does not match required pattern") -> Rule:
    return lambda c: outcome(c.rlike(f"^(?:{pattern})"), c, error)


def alphanumeric(underscore: bool = False, dash: bool = False) -> Rule:
    extra = ("_" if underscore else "") + ("-" if dash else "")
    return lambda c: outcome(
        c.rlike(rf"^[a-zA-Z0-9{extra}]+\z"),
        c,
        F.when(c == "", F.lit("Value cannot be empty")).otherwise(
            F.lit("Value must contain only alphanumeric characters")
        ),
    )


def slug(c: Column) -> Column:
    return outcome(
        c.rlike(SLUG), c, F.when(c == "", F.lit("Value cannot be empty")).otherwise(F.lit("Value must be a valid URL slug"))
    )


def one_of(options: list[str], case_sensitive: bool = True) -> Rule:
    allowed = options if case_sensitive else [o.lower() for o in options]
    return lambda c: outcome(
        (c if case_sensitive else F.lower(c)).isin(allowed), c, f"Value must be one of: {', '.join(options)}"
    )


def trimmed(allow_empty: bool = False) -> Rule:
    return lambda c: outcome(
        c.isNotNull() if allow_empty else F.length(_strip(c)) > 0, _strip(c), "Value cannot be empty"
    )


def integer(c: Column) -> Column:
    """Optional sign and digits; underscores, decimals and exponents are refused."""
    return outcome(
        _strip(c).rlike(r"^[+-]?[0-9]+\z") & _strip(c).try_cast("decimal(38,0)").isNotNull(),
        _strip(c).try_cast("decimal(38,0)"),
        "Value must be an integer",
    )


def number(c: Column) -> Column:
    return outcome(_strip(c).try_cast("double").isNotNull(), _strip(c).try_cast("double"), "Value must be a number")


def _bounded(base: Rule, kind: str, low, high) -> Rule:
    def rule(c: Column) -> Column:
        v = _strip(c).try_cast(kind)
        ok, error = base(c)["is_valid"], F.when(~base(c)["is_valid"], base(c)["error"])
        if low is not None:
            ok, error = ok & (v >= low), error.when(v < low, F.lit(f"Value must be at least {low}"))
        if high is not None:
            ok, error = ok & (v <= high), error.when(v > high, F.lit(f"Value must be at most {high}"))
        return outcome(ok, v, error)

    return rule


def int_range(low: int | None = None, high: int | None = None) -> Rule:
    return _bounded(integer, "decimal(38,0)", low, high)


def float_range(low: float | None = None, high: float | None = None) -> Rule:
    return _bounded(number, "double", low, high)


def signed(positive: bool = True, allow_zero: bool = False) -> Rule:
    def rule(c: Column) -> Column:
        v = _strip(c).try_cast("double")
        sign = v if positive else -v
        name = "positive" if positive else "negative"
        text = f"Value must be zero or {name}" if allow_zero else f"Value must be {name}"
        error = F.when(v.isNull(), F.lit("Value must be a number")).otherwise(F.lit(text))
        return outcome(sign >= 0 if allow_zero else sign > 0, v, error)

    return rule


def temporal(kind: str = "date", fmt: str | None = None, label: str | None = None) -> Rule:
    """Date, datetime or time in a Spark datetime format; the value comes back in ISO form."""
    spark_fmt, shown, out = {
        "date": ("yyyy-MM-dd", "%Y-%m-%d", "yyyy-MM-dd"),
        "datetime": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd HH:mm:ss"),
        "time": ("HH:mm:ss", "%H:%M:%S", "HH:mm:ss"),
    }[kind]
    spark_fmt, shown = fmt or spark_fmt, label or shown

    def rule(c: Column) -> Column:
        parsed = F.try_to_timestamp(_strip(c), F.lit(spark_fmt))
        return outcome(
            parsed.isNotNull(), F.date_format(parsed, out), f"Invalid {kind} format. Expected: {shown}"
        )

    return rule


def date_range(low: str | None = None, high: str | None = None) -> Rule:
    """Inclusive range of ISO dates."""

    def rule(c: Column) -> Column:
        d = F.to_date(F.try_to_timestamp(_strip(c), F.lit("yyyy-MM-dd")))
        ok, error = d.isNotNull(), F.when(d.isNull(), F.lit("Invalid date format. Expected: %Y-%m-%d"))
        if low is not None:
            ok, error = ok & (d >= low), error.when(d < low, F.lit(f"Date must be on or after {low}"))
        if high is not None:
            ok, error = ok & (d <= high), error.when(d > high, F.lit(f"Date must be on or before {high}"))
        return outcome(ok, d, error)

    return rule


def email(c: Column) -> Column:
    v = _strip(c)
    ok = (
        (F.char_length(v) <= 254)
        & (F.char_length(F.split_part(v, F.lit("@"), F.lit(1))) <= 64)
        & v.rlike(EMAIL)
    )
    return outcome(ok, F.lower(v), "Invalid email address")


def url(schemes: tuple[str, ...] = ("http", "https"), require_tld: bool = True) -> Rule:
    def rule(c: Column) -> Column:
        v = _strip(c)
        scheme = F.lower(F.regexp_extract(v, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
        netloc = F.regexp_extract(v, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
        host = F.substring_index(F.split_part(netloc, F.lit(":"), F.lit(1)), "@", -1)
        known = scheme.isin(*schemes)
        ok = known & (netloc != "")
        if require_tld:
            ok = ok & (host.contains(".") | (F.lower(host) == "localhost"))
        error = F.when((scheme != "") & ~known, F.lit(f"URL scheme must be one of: {', '.join(schemes)}")).otherwise(
            F.lit("Invalid URL")
        )
        return outcome(ok, v, error)

    return rule


@F.pandas_udf(BooleanType())
def is_ipv6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """IPv6 texts have no workable single pattern; Arrow batches through the address parser."""
    from ipaddress import AddressValueError, IPv6Address

    def test(text: str | None) -> bool:
        try:
            return text is not None and IPv6Address(text) is not None
        except AddressValueError:
            return False

    for texts in batches:
        yield texts.map(test).astype(bool)


def ip_address(version: int | None = None) -> Rule:
    error = f"Value must be a valid IPv{version} address" if version else "Value must be a valid IP address"

    def rule(c: Column) -> Column:
        v = _strip(c)
        v4, v6 = v.rlike(IPV4), v.contains(":")
        ok = {4: lambda: v4, 6: lambda: v6 & is_ipv6(v), None: lambda: v4 | (v6 & is_ipv6(v))}[version]()
        return outcome(ok, v, error)

    return rule


def hostname(allow_ip: bool = False, require_tld: bool = False) -> Rule:
    def rule(c: Column) -> Column:
        v = F.lower(_strip(c))
        shape = v.rlike(rf"^{LABEL}(?:\.{LABEL})*\z") & (F.char_length(v) <= 253)
        error, ok = F.lit("Invalid hostname"), shape
        if require_tld:
            ok = shape & v.contains(".")
            error = F.when(shape, F.lit("Hostname must have a top-level domain")).otherwise(error)
        if allow_ip:
            ok = ok | v.rlike(IPV4) | (v.contains(":") & is_ipv6(v))
        return outcome(ok, v, error)

    return rule


def password(preset: str = "default", *, allow_spaces: bool = False) -> Rule:
    """All broken requirements joined with ``; ``."""
    low, high, upper, lower, digit, special = PASSWORD_PRESETS[preset]

    def rule(c: Column) -> Column:
        tests = [
            (F.char_length(c) < low, f"Password must be at least {low} characters"),
            (F.char_length(c) > high, f"Password must be at most {high} characters"),
        ]
        if not allow_spaces:
            tests.append((c.contains(" "), "Password cannot contain spaces"))
        if upper:
            tests.append((~c.rlike(r"\p{Lu}"), "Password must contain at least one uppercase letter"))
        if lower:
            tests.append((~c.rlike(r"\p{Ll}"), "Password must contain at least one lowercase letter"))
        if digit:
            tests.append((~c.rlike(r"\p{Nd}"), "Password must contain at least one digit"))
        if special:
            tests.append(
                (~_has_special(c), f"Password must contain at least one special character ({SPECIALS[:10]}...)")
            )
        errors = F.array_compact(F.array(*[F.when(t, F.lit(text)) for t, text in tests]))
        return outcome(
            c.isNotNull() & (F.size(errors) == 0),
            c,
            F.when(c.isNull(), F.lit("Password must be a string")).otherwise(F.concat_ws("; ", errors)),
        )

    return rule


def _has_special(c: Column) -> Column:
    return c.rlike(r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?~`]")


def password_score(c: Column) -> Column:
    """0 to 100: length, character classes, share of distinct characters, no common part."""
    n = F.char_length(c)
    classes = [c.rlike("[a-z]"), c.rlike("[A-Z]"), c.rlike("[0-9]"), _has_special(c)]
    variety = reduce(lambda a, b: a + b, [t.cast("int") for t in classes])
    distinct = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?s)(.)"), F.lit(1))))
    unique = F.when(n > 0, F.floor(distinct / n * 20)).otherwise(0)
    common = reduce(lambda a, b: a | b, [F.lower(c).rlike(p) for p in COMMON_PASSWORD_PARTS])
    score = F.least(n * 2, F.lit(30)) + variety * 10 + unique + F.when(common, 0).otherwise(10)
    return F.least(score, F.lit(100)).cast("int")


# --- sanitizers -----------------------------------------------------------------------------------------


def escape_html(c: Column) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), HTML_ENTITIES, c)


def strip_active_html(c: Column) -> Column:
    """Scripts, event handlers, script and data schemes, frames and embeds, in that order.

    Element bodies end at the first closing tag, as lazily as the text allows.
    """
    for pattern in (
        r"(?is)<script\b[^<]*(?:(?!</script>)<[^<]*)*+</script>",
        r"""(?i)\son\w+\s*=\s*["'][^"']*["']""",
        r"(?i)\son\w+\s*=\s*[^\s>]*",
        r"(?i)javascript:",
        r"(?i)data:text/html",
        r"(?is)<iframe\b[^<]*(?:(?!</iframe>)<[^<]*)*+</iframe>",
        r"(?is)<(object|embed)\b[^<]*(?:(?!</\1>)<[^<]*)*+</\1>",
    ):
        c = F.regexp_replace(c, pattern, "")
    return c


def path_within(c: Column, base: str) -> Column:
    """``safe_path`` below an absolute folder, without a slash at the end; null when it leaves that folder."""
    root = "/" + "/".join(p for p in base.split("/") if p not in ("", "."))
    inner = F.regexp_replace(safe_path(c), "/+$", "")
    return F.when(inner.isin(".", ""), F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), inner))


def safe_path(c: Column) -> Column:
    """Relative path with ``.`` and inner ``..`` resolved; null when it leaves its root."""
    parts = F.filter(F.split(c, "/+"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")

    def push(acc: Column, p: Column) -> Column:
        backs = (p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when(backs, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p))

    resolved = F.concat_ws("/", F.aggregate(parts, empty, push))
    normal = F.when(resolved == "", F.lit(".")).otherwise(
        F.concat(resolved, F.when(c.endswith("/"), F.lit("/")).otherwise(F.lit("")))
    )
    return F.when(~c.startswith("/") & ~normal.contains(".."), normal)


def strip_sql_tokens(c: Column) -> Column:
    """One pass per token, in a fixed order; what a removal joins together is not looked at again."""
    c = F.translate(c, "'\";", "")
    for token in SQL_TOKENS:
        c = F.regexp_replace(c, f"(?i){token}", "")
    return c


def clean_email(c: Column) -> Column:
    v = F.lower(_strip(c))
    return F.when(v.rlike(CLEAN_EMAIL) & (F.char_length(v) <= 254), v)


def clean_url(c: Column) -> Column:
    v = _strip(c)
    dangerous = v.rlike(r"(?i)^(javascript|data|vbscript):")
    safe = v.rlike(r"(?i)^(https?|ftp|mailto):") | v.startswith("/") | v.startswith(".")
    return F.when(~dangerous & safe, v)
