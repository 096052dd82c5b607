"""Column expressions shared by the operators. Everything stays JVM-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

TRADING_DAYS = 252
ZERO_SPREAD = 1e-15
DAY_US = 86_400_000_000


def dbl(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).cast("double")


def r(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def settled(column: Column | str, places: int = 6) -> Column:
    """Rounded value whose exact halves are decided: amounts built from cents often end on a tie."""
    return r((F.col(column) if isinstance(column, str) else column) + F.lit(1e-9), places)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0.0 where the denominator is missing or zero."""
    usable = bottom.isNotNull() & (F.abs(bottom) > F.lit(ZERO_SPREAD)) & top.isNotNull()
    return F.when(usable, F.try_divide(top, bottom)).otherwise(F.lit(0.0))


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks; a rule that evaluates to null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def check_rows(rules: Mapping[str, Column]) -> Column:
    """Named boolean gates as an array of (check, passed), to be exploded into a check table."""
    return F.array(*[
        F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"))
        for name, ok in rules.items()
    ])


def stripped(column: Column | str) -> Column:
    """Remove all leading and trailing white space (trim() removes blanks only)."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def normal_text(column: Column | str) -> Column:
    """Stripped and lower-cased text, the identity used to compare claims and topics."""
    return F.lower(stripped(column))


def provider_symbol(column: Column | str) -> Column:
    """Ticker as data providers spell it: trimmed, dated suffix dropped, class dot as a dash."""
    return F.replace(F.regexp_replace(stripped(column), r"-\d{6}$", ""), F.lit("."), F.lit("-"))


def scaled(column: Column | str, digits: int = 8) -> Column:
    """A number as an integer count of 10^-digits: one text form for hashing on every engine."""
    return F.round(dbl(column) * F.lit(float(10 ** digits)), 0).cast("bigint")


def canonical(parts: Sequence[Column]) -> Column:
    """Canonical text of a row; nulls are kept visible."""
    return F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit("~")) for part in parts])


def sha(column: Column) -> Column:
    return F.sha2(column, 256)


def sorted_list_hash(text: Column) -> Column:
    """Aggregate: SHA-256 of the sorted, comma-joined texts of a bounded group."""
    return sha(F.array_join(F.array_sort(F.collect_list(text)), ","))


def running_set_hash(text: Column, window: WindowSpec) -> Column:
    """Hash of the texts in a window frame as a multiset, 256 bits as hex, whatever their order.

    The eight 32-bit lanes of each text's SHA-256 are added up lane by lane modulo 2^32, so a frame that grows adds one term.
    Repeated texts count; a group of up to 2^31 rows stays within a bigint.
    """
    lane = lambda k: F.conv(F.substring(sha(text), 8 * k + 1, 8), 16, 10).cast("bigint")
    total = lambda k: F.pmod(F.sum(lane(k)).over(window), F.lit(1 << 32))
    return F.lower(F.concat(*[F.lpad(F.hex(total(k)), 8, "0") for k in range(8)]))


def joined(array: Column | str) -> Column:
    return F.array_join(array, ",")


def session_close(session: Column | str, hour: int = 21) -> Column:
    """Session date at the given hour (UTC wall clock)."""
    day = F.col(session) if isinstance(session, str) else session
    return (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))).cast("timestamp_ntz")
