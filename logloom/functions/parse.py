"""Access and error log lines as columns.

A line is taken apart by one pass of one expression, inside the scan's own stage. Lines that aren't
entries give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest and longest line in bytes, the request methods, the severity levels, and
#: the context keys of error lines in the order they are written (True: quoted).
MIN_LINE, MIN_ERROR_LINE, MAX_LINE = 20, 25, 16384
METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT", "PROPFIND", "PROPPATCH", "MKCOL", "COPY", "MOVE", "LOCK", "UNLOCK"]
LEVELS = ["debug", "info", "notice", "warn", "error", "crit", "alert", "emerg"]
CONTEXT = [("client", False), ("server", False), ("request", True), ("upstream", True), ("host", True), ("referrer", True)]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

#: ip ident user [time] "verb path protocol" status size "referer" "agent" request_time upstream_time. The words of a request are possessive: without an end quote they would be tried in every way.
_ACCESS = (
    r'(?s)^([^ ]*) +[^ ]* +[^ ]* +\[([^\]]*)\] *"\s*+([^"\s]*+)\s*+([^"\s]*+)\s*+([^"\s]*+)[^"]*+" *([^ ]*) *([^ ]*) *'
    r'(?:"([^"]*)" *(?:"([^"]*)" *)?)?([^ ]*) *([^ ]*).*$'
)
_FIELDS = ["ip", "time", "verb", "path", "protocol", "status", "size", "referer", "agent", "request_time", "upstream_time"]


def days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a civil date whose day isn't checked: the first of the month plus d - 1."""
    first = F.when((y >= 1) & (m >= 1) & (m <= 12), F.make_date(y, m, F.lit(1)))
    return F.datediff(first, F.lit("1970-01-01").cast("date")) + d - 1


def unfused(condition: Column) -> Column:
    """``condition``, so that what stands beside it is compiled in short methods.

    A projection with a function over arrays isn't fused with its neighbours. All of a line's fields in one fused method are more than the JVM compiles; it would interpret them.
    """
    return F.exists(F.array(condition), lambda c: c)


def _seconds(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return days(y, mo, d).cast("long") * 86400 + h * 3600 + mi * 60 + s


def nginx_time(t: Column) -> Column:
    """Epoch seconds of ``dd/Mon/yyyy:HH:MM:SS [+zzzz]``; null if it isn't one. The calendar isn't validated."""
    # one check, then places
    g = lambda at, n: F.substring(t, at, n).try_cast("int")
    month = F.instr(F.lit("".join(MONTHS)), F.substring(t, 4, 3))
    local = _seconds(g(8, 4), F.when(month > 0, ((month + 2) / 3).cast("int")), g(1, 2), g(13, 2), g(16, 2), g(19, 2))
    zone = F.when(t.rlike(r"^.{20} [+-]\d{4}"), F.when(F.substring(t, 22, 1) == "-", -1).otherwise(1) * (g(23, 2) * 3600 + g(25, 2) * 60)).otherwise(0)
    return F.when(t.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}.*$"), local - zone)


def iso_time(t: Column) -> Column:
    """Epoch seconds of ``yyyy-mm-dd[T ]hh:mm:ss`` with ``Z``, ``+hh:mm`` or nothing after it; null for other tails."""
    g = lambda at, n: F.substring(t, at, n).try_cast("int")
    zone = F.when(F.substring(t, 20, 1).isin("+", "-"), F.when(F.substring(t, 20, 1) == "-", -1).otherwise(1) * (g(21, 2) * 3600 + g(24, 2) * 60)).otherwise(0)
    is_time = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2}.*)?$")
    return F.when(is_time, _seconds(g(1, 4), g(6, 2), g(9, 2), g(12, 2), g(15, 2), g(18, 2)) - zone)


def parse_time(t: Column) -> Column:
    return F.coalesce(nginx_time(t), iso_time(t), F.lit(0).cast("long"))


def seconds(s: Column) -> Column:
    """A duration: null for empty, ``-``, negative or unreadable ones."""
    v = F.when(s.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity)$"), s.try_cast("double"))
    return F.when(v >= 0, v)


def access_parts(line: Column) -> Column:
    """The fields' texts as an array; fewer or null if the line isn't an access entry. A line has no line feed, so one parts them."""
    is_line = F.octet_length(line).between(MIN_LINE, MAX_LINE) & ~F.contains(line, F.lit("\n"))
    return F.when(is_line, F.split(F.regexp_replace(line, _ACCESS, "\n".join(f"${k + 1}" for k in range(len(_FIELDS)))), "\n"))


def access_fields(parts: Column) -> Column:
    """A struct of the typed fields of access_parts()."""
    g = {n: F.get(parts, F.lit(k)) for k, n in enumerate(_FIELDS)}
    size = F.when(g["size"].rlike(r"^\+?\d+$"), g["size"].try_cast("long"))
    status = F.when(g["status"].rlike(r"^\+?0*[1-5]\d\d$"), g["status"].try_cast("int"))
    return F.when(
        unfused(F.size(parts) == len(_FIELDS)),
        F.struct(
            parse_time(g["time"]).alias("ts"), g["ip"].alias("ip"),
            F.when(g["verb"].isin(METHODS), g["verb"]).otherwise("").alias("method"), g["path"].alias("path"), g["protocol"].alias("protocol"),
            F.coalesce(status, F.lit(0)).alias("status"), F.coalesce(size, F.lit(0).cast("long")).alias("bytes_sent"),
            g["referer"].alias("referer"), g["agent"].alias("user_agent"),
            seconds(g["request_time"]).alias("request_time"), seconds(g["upstream_time"]).alias("upstream_time"),
        ),
    )


def is_valid(e: Column, line: Column, now: int) -> Column:
    """Whether a parsed access line is worth keeping; ``now`` in epoch seconds."""
    ip = e.ip
    odd = F.contains(ip, F.lit("http")) | F.contains(ip, F.lit("/")) | F.contains(ip, F.lit("\\x")) | F.contains(ip, F.lit("%")) | (F.octet_length(ip) > 45)
    good_ip = ip.isin("", "-") | ~odd
    binary = F.contains(line, F.lit("\\x16\\x03")) | F.contains(line, F.lit("\\xFF\\xD8"))
    return F.coalesce(e.isNotNull() & good_ip & (e.ts > 0) & (e.ts <= now + 86400) & ~F.contains(e.path, F.lit("\\x")) & ~binary, F.lit(False))


def error_time(t: Column, zone: str) -> Column:
    """Epoch seconds of ``yyyy/mm/dd hh:mm:ss`` in a zone; of two meanings the first, times in a gap an hour later."""
    stamp = F.try_to_timestamp(t, F.lit("yyyy/MM/dd HH:mm:ss"))
    utc, later = F.to_utc_timestamp(stamp, zone), F.to_utc_timestamp(stamp + F.expr("INTERVAL 1 HOUR"), zone)
    # a time in a gap doesn't come back as it was, however long the gap is
    return F.unix_timestamp(F.when(F.from_utc_timestamp(utc, zone) == stamp, utc).otherwise(later)).cast("long")


_KEYS = "|".join(k for k, _ in CONTEXT)
#: time [level] pid#tid: *connection message, key: value, ...
_ERROR = rf"(?s)^(\d{{4}}/\d{{2}}/\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}) \[([a-z]+)\] *(?:(\d+)#\d*: )?(?:\*(\d+) )?(.*?)((?:, (?:{_KEYS}): .*)?)$"
_ORDERED = "(?s)^" + "".join(rf'(?:, {k}: "([^"]*)" *)?' if quoted else rf"(?:, {k}: ((?:(?!, ).)*))?" for k, quoted in CONTEXT) + ".*$"
_ERROR_FIELDS = ["time", "level", "pid", "connection", "message", "tail"]


def _parts(text: Column, pattern: str, n: int) -> Column:
    return F.split(F.regexp_replace(text, pattern, "\n".join(f"${k + 1}" for k in range(n))), "\n")


def error_parts(line: Column) -> Column:
    """The texts of _ERROR_FIELDS as an array; fewer or null if the line doesn't start like an error entry."""
    is_line = F.octet_length(line).between(MIN_ERROR_LINE, MAX_LINE) & ~F.contains(line, F.lit("\n"))
    return F.when(is_line, _parts(line, _ERROR, len(_ERROR_FIELDS)))


def error_context(parts: Column) -> Column:
    """Values of the context keys in their written order; one that is out of order ends the reading."""
    return _parts(F.get(parts, F.lit(_ERROR_FIELDS.index("tail"))), _ORDERED, len(CONTEXT))


def error_fields(parts: Column, context: Column, zone: str = "UTC") -> Column:
    """A struct of a parsed error line, of error_parts() and error_context(); null if it isn't one."""
    g = {n: F.get(parts, F.lit(k)) for k, n in enumerate(_ERROR_FIELDS)}
    got = {n: F.get(context, F.lit(k)) for k, (n, _) in enumerate(CONTEXT)}
    words = F.filter(F.split(got["request"], r"\s+"), lambda x: x != "")
    verb = F.coalesce(F.get(words, F.lit(0)).isin(METHODS), F.lit(False))
    ts = error_time(g["time"], zone)
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    return F.when(
        (F.size(parts) == len(_ERROR_FIELDS)) & g["level"].isin(LEVELS) & ts.isNotNull(),
        F.struct(
            ts.alias("ts"), g["level"].alias("level"), number(g["pid"]).alias("pid"), number(g["connection"]).alias("connection"), g["message"].alias("message"),
            got["client"].alias("client"), got["server"].alias("server"), F.when(verb, F.get(words, F.lit(0))).otherwise("").alias("method"),
            F.when(verb, F.coalesce(F.get(words, F.lit(1)), F.lit(""))).otherwise("").alias("path"), got["request"].alias("request"),
            got["upstream"].alias("upstream"), got["host"].alias("host"), got["referrer"].alias("referrer"),
        ),
    )


def is_valid_error(e: Column, now: int) -> Column:
    return F.coalesce(e.isNotNull() & (e.ts > 0) & (e.ts <= now + 86400), F.lit(False))


def access_rows(lines: DataFrame, now: int, line_col: str = "raw") -> DataFrame:
    """Valid access lines of a table with its other columns; absent values are null, a bad status is 0."""
    e, line = F.col("_e"), F.col(line_col)
    out = lines.withColumn("_p", access_parts(line)).withColumn("_e", access_fields(F.col("_p")))
    # a filter would be pushed down with copies of all that it looks at, and lines be parsed twice; it can't pass a generator
    out = out.select(*lines.columns, F.explode_outer(F.when(is_valid(e, line, now), F.array(e))).alias("_e")).where("_e is not null")
    empty = lambda c: F.nullif(e[c], F.lit(""))
    return out.select(
        *lines.columns, e.ts.alias("ts"), e.ip.alias("ip"), e.status.alias("status"), empty("method").alias("method"), empty("path").alias("path"),
        empty("referer").alias("referer"), empty("user_agent").alias("user_agent"), e.bytes_sent.alias("bytes_sent"),
        F.when(e.request_time > 0, e.request_time).alias("request_time"), e.upstream_time.alias("upstream_time"), F.lit(None).cast("string").alias("level"),
    )


def error_rows(lines: DataFrame, now: int, zone: str = "UTC", line_col: str = "raw") -> DataFrame:
    """Valid error lines in the columns of access_rows()."""
    e = F.col("_e")
    out = lines.withColumn("_p", error_parts(F.col(line_col))).withColumn("_c", error_context(F.col("_p"))).withColumn("_e", error_fields(F.col("_p"), F.col("_c"), zone))
    out = out.select(*lines.columns, F.explode_outer(F.when(is_valid_error(e, now), F.array(e))).alias("_e")).where("_e is not null")
    empty = lambda c: F.nullif(e[c], F.lit(""))
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    return out.select(
        *lines.columns, e.ts.alias("ts"), empty("client").alias("ip"), null("int", "status"), empty("method").alias("method"), empty("path").alias("path"),
        empty("referrer").alias("referer"), null("string", "user_agent"), null("long", "bytes_sent"), null("double", "request_time"), null("double", "upstream_time"), e.level.alias("level"),
    )
