"""Scalar functions over artefact texts: times, dates, run cycles, scripts, paths, references, credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days and their cron numbers.
DAYS = {"SUN": 0, "MON": 1, "TUE": 2, "WED": 3, "THU": 4, "FRI": 5, "SAT": 6}
#: Script kinds by extension.
SCRIPT_KINDS = {"py": "python", "sh": "shell", "ksh": "shell", "bash": "shell", "sql": "sql", "ipynb": "notebook", "jar": "jar", "scala": "scala", "qvs": "qlik", "qvw": "qlik", "qvf": "qlik", "twb": "tableau", "twbx": "tableau", "pl": "perl", "bat": "batch", "cmd": "batch", "ps1": "powershell"}
#: Option and query keys that hold credentials.
SECRET_KEYS = ["password", "passwd", "pwd", "secret", "token", "accesskey", "access_key", "secretkey", "secret_key", "apikey", "api_key", "account_key", "sas", "sig", "credential", "credentials", "user", "username", "uid"]


def clock_time(text: Column) -> Column:
    """HH:mm of `0530`, `530` or `05:30`; null if it is no time of day."""
    digits = F.regexp_extract(F.trim(text), r"^(\d{1,2}):?(\d{2})$", 0)
    hour = F.regexp_extract(digits, r"^(\d{1,2}):?(\d{2})$", 1).try_cast("int")
    minute = F.regexp_extract(digits, r"^(\d{1,2}):?(\d{2})$", 2).try_cast("int")
    return F.when((hour < 24) & (minute < 60), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))


def calendar_date(text: Column) -> Column:
    """Date of MM/DD/YYYY or an ISO date; null otherwise."""
    clean = F.trim(text)
    return F.coalesce(F.try_to_date(clean, "MM/dd/yyyy"), F.try_to_date(clean, "yyyy-MM-dd"))


def run_cycle(name: Column, start: Column) -> Column:
    """struct(frequency, days, cron) of a run cycle's name: day lists, week days, daily, MONTHLY ON n and others."""
    u = F.upper(F.trim(name))
    minute = F.coalesce(F.substring(start, 4, 2).cast("int").cast("string"), F.lit("0"))
    hour = F.coalesce(F.substring(start, 1, 2).cast("int").cast("string"), F.lit("0"))
    days = F.filter(F.split(F.regexp_replace(u, r"^(ON_|EVERY_|RC_)", ""), r"[_, ]+"), lambda x: x.isin(list(DAYS)))
    is_list = F.size(days) > 0
    numbers = F.create_map(*[F.lit(x) for k, v in DAYS.items() for x in (k, str(v))])
    month_day = F.regexp_extract(u, r"^MONTHLY[_ ]ON[_ ](\d{1,2})$", 1)
    freq = (
        F.when(is_list, "weekly")
        .when(u.isin("WEEKDAYS", "WORKDAYS"), "weekly")
        .when(u.isin("DAILY", "EVERYDAY", "EVERY_DAY"), "daily")
        .when(u.startswith("MONTHLY"), "monthly")
        .when(u.startswith("WEEKLY"), "weekly")
        .when(u.startswith("YEARLY"), "yearly")
        .when(u.isin("ON REQUEST", "REQUEST", "ON_REQUEST"), "on_request")
        .otherwise("custom")
    )
    work = F.array(*[F.lit(x) for x in ("MON", "TUE", "WED", "THU", "FRI")])
    found = F.when(is_list, days).when(u.isin("WEEKDAYS", "WORKDAYS"), work).otherwise(F.array().cast("array<string>"))
    dow = F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: numbers[x]), ",")).when(u.startswith("WEEKLY"), "0").otherwise("*")
    dom = F.when(month_day != "", month_day.cast("int").cast("string")).when(u.startswith("MONTHLY") | u.startswith("YEARLY"), "1").otherwise("*")
    month = F.when(u.startswith("YEARLY"), "1").otherwise("*")
    cron = F.when(freq.isin("on_request", "custom"), F.lit(None)).otherwise(F.concat_ws(" ", minute, hour, dom, month, dow))
    return F.struct(freq.alias("frequency"), found.alias("days"), cron.alias("cron"))


def script_parts(command: Column) -> Column:
    """struct(path, args, kind): the first token, quoted or not, the rest, and the kind by extension."""
    clean = F.trim(command)
    quoted = F.regexp_extract(clean, r"^[\"']([^\"']+)[\"']\s*(.*)$", 1)
    path = F.when(quoted != "", quoted).otherwise(F.regexp_extract(clean, r"^(\S+)", 1))
    args = F.when(quoted != "", F.regexp_extract(clean, r"^[\"'][^\"']+[\"']\s*(.*)$", 1)).otherwise(F.regexp_extract(clean, r"^\S+\s*(.*)$", 1))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in SCRIPT_KINDS.items() for x in kv])
    return F.struct(path.alias("path"), args.alias("args"), F.coalesce(kinds[ext], F.lit("unknown")).alias("kind"))


def uri_parts(uri: Column) -> Column:
    """struct(scheme, bucket, path) of a storage address; a bare path has the scheme `file`."""
    has = uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    scheme = F.when(has, F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))).otherwise("file")
    bucket = F.when(has, F.lower(F.regexp_extract(uri, r"^[^:]+://([^/?#]*)", 1))).otherwise("")
    path = F.when(has, F.regexp_extract(uri, r"^[^:]+://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(uri, r"^[^?#]*", 0))
    return F.struct(scheme.alias("scheme"), bucket.alias("bucket"), F.regexp_replace(path, r"(?<=.)/+$", "").alias("path"))


def bracket_refs(formula: Column) -> Column:
    """Names in brackets of a formula, `]]` read as `]`, outside string literals, once each in order."""
    bare = F.regexp_replace(formula, r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''")
    found = F.regexp_extract_all(bare, F.lit(r"\[((?:[^\]]|\]\])+)\]"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit("]]"), F.lit("]"))))


def lod_dimensions(formula: Column) -> Column:
    """struct(kind, dims): of the first {FIXED|INCLUDE|EXCLUDE dims : agg} in a formula; kind null without one."""
    pattern = r"(?is)\{\s*(FIXED|INCLUDE|EXCLUDE)\b([^:}]*):"
    kind = F.upper(F.regexp_extract(formula, pattern, 1))
    return F.struct(F.when(kind != "", kind).alias("kind"), bracket_refs(F.regexp_extract(formula, pattern, 2)).alias("dims"))


def scrubbed_url(url: Column) -> Column:
    """A URL without user info and without the values of secret query keys."""
    keys = "|".join(SECRET_KEYS)
    return F.regexp_replace(F.regexp_replace(url, r"://[^/@\s]*@", "://"), rf"(?i)([?&;](?:{keys})=)[^&;#]*", "$1***")


def has_credentials(options: Column) -> Column:
    """Whether a map of options has a secret key with a value."""
    return F.size(F.map_filter(options, lambda k, v: F.lower(F.regexp_replace(k, r"[.\-]", "_")).isin(SECRET_KEYS) & (F.coalesce(v, F.lit("")) != ""))) > 0


def scrubbed_options(options: Column) -> Column:
    """Options without secret ones."""
    return F.map_filter(options, lambda k, v: ~F.lower(F.regexp_replace(k, r"[.\-]", "_")).isin(SECRET_KEYS))


def jdbc_parts(url: Column) -> Column:
    """struct(class, host, port, database) of a JDBC address, of the //host:port/db and ;databaseName= kinds."""
    clean = F.trim(url)
    name = F.lower(F.regexp_extract(clean, r"^jdbc:([a-z0-9]+)", 1))
    host = F.lower(F.regexp_extract(clean, r"//(?:[^/@;?]*@)?([^:/;?]+)", 1))
    oracle = F.regexp_extract(clean, r"@(?://)?([^:/]+)", 1)
    port = F.regexp_extract(clean, r"(?://|@)[^/;?]*?:(\d+)", 1)
    slash = F.regexp_extract(clean, r"//[^/;?]*/([^;?]+)", 1)
    prop = F.regexp_extract(clean, r"(?i);\s*(?:databaseName|database)=([^;]+)", 1)
    sid = F.regexp_extract(clean, r"@[^:]+:\d+[:/]([^?;]+)", 1)
    db = F.coalesce(*[F.when(x != "", x) for x in (prop, slash, sid)], F.lit(""))
    return F.struct(name.alias("class"), F.when(host != "", host).otherwise(F.lower(oracle)).alias("host"), F.when(port != "", port.cast("int")).alias("port"), db.alias("database"))


def status_of(good: Column, total: Column) -> Column:
    return F.when(good == total, "ok").when(good == 0, "failed").otherwise("partial")
