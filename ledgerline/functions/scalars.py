"""Scalar expressions: numbers, dates, times, severity, cycles.  All are plain Spark columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.settings import Settings

MONEY = "decimal(16,2)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Trim; an empty text becomes NULL."""
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def case_of(pairs, default: Column | None = None) -> Column:
    """Ordered ``when`` chain from (condition, value) pairs."""
    chain = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# ------------------------------------------------------------------------------------ numbers
def num_of(c) -> Column:
    """Numeric prefix after thousands separators, blanks and the baht sign are removed; NULL when there is none."""
    text = F.regexp_replace(col(c), r"[,\s\u00A0฿]", "")
    return F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("decimal(24,6)")


def num(c) -> Column:
    """``num_of`` with 0 in place of NULL (report formats)."""
    return F.coalesce(num_of(c), F.lit(0).cast("decimal(24,6)"))


def money(c) -> Column:
    return F.round(col(c), 2).cast(MONEY)


def cents_of(c) -> Column:
    return F.round(col(c) * 100).cast("bigint")


# ------------------------------------------------------------------------------------ dates and times
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"


def _sec_of_clock(clock: Column) -> Column:
    """Seconds of an "H:MM[:SS]" text, NULL for ''."""
    def body(p):
        part = lambda i: F.get(p, F.lit(i)).try_cast("int")
        return part(0) * 3600 + part(1) * 60 + F.coalesce(part(2), F.lit(0))

    return let(F.split(clock, ":"), body)


def sec_of(c) -> Column:
    """Seconds since midnight of the first ``H:MM[:SS]`` in a text, else NULL."""
    return _sec_of_clock(F.regexp_extract(col(c), _CLOCK, 0))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y.cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def _ce(year: Column) -> Column:
    """Buddhist-era year to common era."""
    return F.when(year > 2400, year - 543).otherwise(year)


def _dmy_parts(c, pattern: str) -> Column:
    """[day, month, year] texts of the first d/m/y or d-m-y in a text."""
    return F.split(F.translate(F.regexp_extract(c, pattern, 0), "/", "-"), "-")


def _iso_of_dmy(parts: Column, year) -> Column:
    """ISO text of [day, month, year]; ``year`` maps the written year to the common era.  NULL without a year."""
    def body(x):
        return F.when(x["y"].isNotNull(), let(year(x["y"]), lambda y: _iso(y, F.get(x["p"], F.lit(1)), F.get(x["p"], F.lit(0)))))

    return let(F.struct(parts.alias("p"), F.get(parts, F.lit(2)).try_cast("int").alias("y")), body)


def iso_date_generic(c) -> Column:
    """ISO text of ``yyyy-mm-dd`` or ``d/m/yyyy`` at the start; no Buddhist-era handling."""
    c = F.trim(col(c))
    return F.coalesce(blank_to_null(F.regexp_extract(c, r"^\d{4}-\d{2}-\d{2}", 0)),
                      let(_dmy_parts(c, r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}"), lambda p: _iso_of_dmy(p, lambda y: y)))


def stamp(c) -> Column:
    """struct(date ISO text, sec, has_time, sec_precision); NULL when neither a date nor a time is found.

    Two-digit years are Buddhist era (69 -> 2569 -> 2026).  Three pattern matches per value.
    """
    text = F.trim(col(c))
    found = F.struct(F.split(F.regexp_extract(text, r"\d{4}-\d{1,2}-\d{1,2}", 0), "-").alias("ymd"),
                     _dmy_parts(text, r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}").alias("dmy"), F.regexp_extract(text, _CLOCK, 0).alias("clock"))

    def short_year(y):
        return let(F.when(y < 100, y + 2500).otherwise(y), _ce)

    def dated(x):
        by_iso = let(F.get(x["ymd"], F.lit(0)).try_cast("int"), lambda y: F.when(
            y.isNotNull(), _iso(_ce(y), F.get(x["ymd"], F.lit(1)), F.get(x["ymd"], F.lit(2)))))
        return F.struct(F.coalesce(by_iso, _iso_of_dmy(x["dmy"], short_year)).alias("date"), x["clock"].alias("clock"))

    def final(x):
        clock = x["clock"]
        return F.when(x["date"].isNotNull() | (clock != ""), F.struct(
            x["date"].alias("date"), F.coalesce(_sec_of_clock(clock), F.lit(0)).alias("sec"), (clock != "").alias("has_time"),
            (F.length(clock) - F.length(F.translate(clock, ":", "")) == 2).alias("sec_precision")))

    return let(let(found, dated), final)


def iso_of_statement(c) -> Column:
    """Statement dates: two-digit years above 50 are Buddhist era, the others common era."""
    def year(y):
        return let(F.when(y < 100, F.when(y > 50, y + 1957).otherwise(y + 2000)).otherwise(y), _ce)

    return let(_dmy_parts(col(c), r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"), lambda p: _iso_of_dmy(p, year))


def hhmmss(sec) -> Column:
    s = col(sec)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"),
                           (s % 60).cast("int"))


def hour_of(sec) -> Column:
    return F.floor(col(sec) / 3600).cast("int")


def shift_of(hour) -> Column:
    h = col(hour)
    return F.when((h >= 8) & (h < 16), "morning").when(h >= 16, "afternoon").otherwise("night")


def local_date(ts, tz: str, offset_days: int = 0) -> Column:
    """Calendar date of a UTC timestamp in ``tz``."""
    return F.date_add(F.to_date(F.from_utc_timestamp(col(ts), tz)), offset_days)


def excel_serial_to_ts(v) -> Column:
    """1900-system serial to timestamp; the time of day never rounds up to 24:00:00."""
    v = col(v)
    days = F.floor(v)
    return F.timestamp_seconds((days - 25569) * 86400 + F.least(F.round((v - days) * 86400), F.lit(86399)))


def minutes_between(a, b) -> Column:
    gap = F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(gap / 60000000 + 0.5)).cast("bigint")


def fmt_minutes(m) -> Column:
    m = col(m)
    h, rest = F.floor(m / 60).cast("bigint"), (m % 60).cast("bigint")
    return (F.when(m.isNull(), "-")
            .when(m < 60, F.concat(m.cast("string"), F.lit(" นาที")))
            .when(rest == 0, F.concat(h.cast("string"), F.lit(" ชม.")))
            .otherwise(F.concat(h.cast("string"), F.lit(" ชม. "), rest.cast("string"), F.lit(" นาที"))))


def th_date_short(d) -> Column:
    """dd-mm-yy with a two-digit Buddhist-era year; "-" for NULL."""
    d = col(d)
    text = F.format_string("%02d-%02d-%02d", F.dayofmonth(d), F.month(d), (F.year(d) + 543) % 100)
    return F.when(d.isNull(), "-").otherwise(text)


def th_date_long(d) -> Column:
    d = col(d)
    names = F.array(*[F.lit(m) for m in fixed.TH_MONTHS])
    return F.coalesce(F.when(d.isNotNull(), F.concat_ws(
        " ", F.dayofmonth(d).cast("string"), F.element_at(names, F.month(d)), (F.year(d) + 543).cast("string"))), F.lit("-"))


def doc_no(prefix: str, date, key) -> Column:
    return F.concat_ws("-", F.lit(prefix), F.date_format(col(date), "yyyyMMdd"), col(key))


# ------------------------------------------------------------------------------------ cycles and tracks
def cycle_of(d) -> Column:
    """Clarification cycle of a date: struct(code, from, to, close_day)."""
    d = col(d)
    day, first = F.dayofmonth(d), F.trunc(d, "month")
    code = F.when(day <= 15, "C1").when(day <= 25, "C2").otherwise("C3")
    begin = F.when(day <= 15, first).when(day <= 25, F.date_add(first, 15)).otherwise(F.date_add(first, 25))
    end = F.when(day <= 15, F.date_add(first, 14)).when(day <= 25, F.date_add(first, 24)).otherwise(F.last_day(d))
    return F.struct(code.alias("code"), begin.alias("from"), end.alias("to"), F.dayofmonth(end).alias("close_day"))


def track_due(date, track, cfg: Settings = Settings()) -> Column:
    """Due text: daily track by cutoff, cycle track N days after its cycle closes."""
    daily = F.concat_ws(" ", F.date_format(col(date), "yyyy-MM-dd"), F.lit(cfg.daily_cutoff))
    cycle = F.date_format(F.date_add(cycle_of(date)["to"], cfg.cycle_respond_days), "yyyy-MM-dd")
    return F.when(col(track) == "daily", daily).otherwise(cycle)


def date_preset(base, preset: str) -> Column:
    """struct(from, to) of a named range around ``base``."""
    b = col(base)
    month, prev = F.trunc(b, "month"), F.add_months(F.trunc(b, "month"), -1)
    ranges = {
        "day": (b, b),
        "last7": (F.date_sub(b, 6), b),
        "last30": (F.date_sub(b, 29), b),
        "thisMonth": (month, F.last_day(b)),
        "lastMonth": (prev, F.last_day(prev)),
        "thisQuarter": (F.trunc(b, "quarter"), F.last_day(F.add_months(F.trunc(b, "quarter"), 2))),
        "thisYear": (F.trunc(b, "year"), F.date_add(F.add_months(F.trunc(b, "year"), 12), -1)),
    }
    begin, end = ranges[preset]
    return F.struct(begin.alias("from"), end.alias("to"))


# ------------------------------------------------------------------------------------ exceptions
def risk_amount(type_, system, bank) -> Column:
    t, s, b = col(type_), col(system), col(bank)
    return (F.when(t.isin("time_diff", "cross_day"), F.lit(0))
            .when(t == "amount_diff", F.abs(s - b))
            .otherwise(F.coalesce(b, s)).cast(MONEY))


def base_severity(type_, table) -> Column:
    t = col(type_)
    return case_of([(t == code, sev) for code, _, sev, *_ in table])


def severity(type_, risk, table, cfg: Settings = Settings()) -> Column:
    base = base_severity(type_, table)
    return F.when(col(risk) > cfg.critical_above, "critical").otherwise(base)


def sla_hours(sev) -> Column:
    s = col(sev)
    return case_of([(s == code, hours) for code, hours in fixed.SLA_HOURS])


def age_hours(date, sec, as_of: str | None = None) -> Column:
    """Case age: measured at ``as_of`` (local time) or, without it, at the end of the business day."""
    s = col(sec)
    day_end = (F.lit(1) + F.floor((F.lit(86400) - s) / 3600)).cast("int")
    if as_of is None:
        return day_end
    event = F.unix_timestamp(col(date).cast("timestamp")) + s
    real = F.greatest(F.lit(1), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - event) / 3600)).cast("int")
    return F.coalesce(real, day_end)


def type_name(type_, table) -> Column:
    t = col(type_)
    return case_of([(t == code, name) for code, name, *_ in table], t)


def cause_text(type_, table) -> Column:
    t = col(type_)
    return case_of([(t == row[0], row[3]) for row in table], F.lit(fixed.CAUSE_PENDING))


def direction_label(direction) -> Column:
    d = col(direction)
    return (F.when(d == "withdraw", fixed.DIRECTION_WITHDRAW).when(d == "deposit", fixed.DIRECTION_DEPOSIT)
            .otherwise(fixed.DIRECTION_OTHER))
