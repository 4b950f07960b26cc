"""Exchange clock (America/New_York) on epoch seconds.

Arguments are SQL texts: a column name or an expression. Every expression goes through epoch
arithmetic, so results do not depend on spark.sql.session.timeZone. The `*_sql` forms return
the text for use inside larger expressions; the others return a Column.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.schema import CLOSE_MINUTE, OPEN_MINUTE, SESSION_MINUTES, ZONE


def _col(x):
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def second_of_sql(ns):
    return f"({ns}) div 1000000000"


def local_seconds_sql(sec):
    return f"unix_seconds(from_utc_timestamp(timestamp_seconds({sec}), '{ZONE}'))"


def minute_of_day_sql(sec):
    return f"cast(pmod({local_seconds_sql(sec)}, 86400) div 60 as int)"


def et_date_sql(sec):
    return f"date_from_unix_date(cast(floor({local_seconds_sql(sec)} / 86400) as int))"


def wall_second_sql(date, second_of_day):
    local = f"cast(unix_date({date}) as bigint) * 86400 + ({second_of_day})"
    return f"unix_seconds(to_utc_timestamp(timestamp_seconds({local}), '{ZONE}'))"


def bucket_start_sql(date, minute):
    start = wall_second_sql(date, f"({minute}) * 60")
    if isinstance(minute, int) and 0 <= minute < 1440:
        return start
    bad = f"cast(raise_error(concat('minute of day out of range: ', {minute})) as bigint)"
    return f"CASE WHEN ({minute}) BETWEEN 0 AND 1439 THEN {start} ELSE {bad} END"


def bar_minute_sql(minute, bar_minutes=1):
    if bar_minutes == 1:
        return f"cast({minute} as int)"
    return f"cast(({minute}) - pmod(({minute}) - {OPEN_MINUTE}, {bar_minutes}) as int)"


def bar_start_sql(sec, open_sec, bar_minutes=1):
    return f"({sec}) - pmod(({sec}) - ({open_sec}), {60 * bar_minutes})"


def second_of(ns):
    """Epoch second of epoch nanoseconds."""
    return F.expr(second_of_sql(ns))


def minute_of_day(sec):
    """0..1439 on the New York wall clock, daylight saving included."""
    return F.expr(minute_of_day_sql(sec))


def et_date(sec):
    """New York calendar date of an epoch second."""
    return F.expr(et_date_sql(sec))


def wall_second(date, second_of_day):
    """Epoch second of a New York date and second of the day."""
    return F.expr(wall_second_sql(date, second_of_day))


def bucket_start(date, minute):
    """Epoch second at which a New York minute of the day starts.

    A minute outside 0..1439 fails the job.
    """
    return F.expr(bucket_start_sql(date, minute))


def et_ns(date, hms):
    """Epoch nanoseconds of a New York date and an 'HH:MM:SS' text column."""
    part = lambda i: f"cast(split({hms}, ':')[{i}] as int)"
    sod = f"{part(0)} * 3600 + {part(1)} * 60 + {part(2)}"
    return F.expr(f"{wall_second_sql(date, sod)} * 1000000000")


def minute_start(sec):
    """Epoch second at which the minute of `sec` starts."""
    return F.expr(f"({sec}) - pmod({sec}, 60)")


def in_regular(minute):
    """True for the 390 regular-session minutes."""
    return F.expr(f"({minute}) BETWEEN {OPEN_MINUTE} AND {CLOSE_MINUTE - 1}")


def check_bar(bar_minutes):
    """Bars must tile the regular session exactly."""
    if bar_minutes < 1 or SESSION_MINUTES % bar_minutes:
        raise ValueError(f"bar_minutes must divide {SESSION_MINUTES}, got {bar_minutes}")
    return bar_minutes


def bar_minute(minute, bar_minutes=1):
    """First minute of the session-aligned bar holding `minute`."""
    return F.expr(bar_minute_sql(minute, bar_minutes))


def bar_start(sec, open_sec, bar_minutes=1):
    """Epoch second at which the session-aligned bar of `sec` starts."""
    return F.expr(bar_start_sql(sec, open_sec, bar_minutes))
