"""Scalar functions over columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def either(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_to_epoch_ms(x: Column | str) -> Column:
    """Milliseconds of an all-digit string or of an ISO time; null if it is neither."""
    c = F.trim(either(x))
    iso = F.unix_millis(F.try_to_timestamp(c))
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint")).otherwise(iso)


def instant(x: Column | str) -> Column:
    """Milliseconds of a number: seconds below ten billion, milliseconds from there."""
    c = either(x)
    return F.when(F.abs(c) < 10_000_000_000, c * 1000).otherwise(c).cast("bigint")


def nanos_to_ms(x: Column | str) -> Column:
    return F.floor(either(x).cast("decimal(38,0)") / 1_000_000).cast("bigint")


def canonical_json(x: Column | str) -> Column:
    """JSON with sorted keys and plain numbers; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(either(x)))


def fingerprint(*parts: Column, digits: int = 16) -> Column:
    """Prefix of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits)


def capped(x: Column | str, most: int = 8000) -> Column:
    """At most so many characters, with a note of how many were cut."""
    c = either(x)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… [+"), (F.length(c) - most).cast("string"), F.lit(" chars]"))).otherwise(c)


def collapsed(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(either(x), "[ \\t\\r\\n\\f]+", " "))


def first_text(*xs: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in xs))


def git_remote(x: Column | str) -> Column:
    """host/owner/repo of an https or ssh remote."""
    c = F.regexp_replace(F.trim(either(x)), "(\\.git)?/*$", "")
    c = F.regexp_replace(c, "^[a-z+]+://([^@/]*@)?", "")
    c = F.regexp_replace(c, "^[^@/]*@", "")
    return F.lower(F.regexp_replace(c, "^([^/:]+):(/*)", "$1/"))


# Folders at which paths in texts begin, and how many paths and characters of them count.
PATHS = r"/(?:home|tmp|private/tmp|Users|work|workspace|workspaces|mnt|srv|var|opt|repo|app)/[^\s\"'`<>|;]+"
MOST_PATHS, MOST_PATH_CHARS = 64, 200_000


def normal_path(x: Column) -> Column:
    """A path without empty, . and .. segments."""
    plain = F.regexp_replace(F.regexp_replace(x, r"(?:/\.)++(?=/|$)", ""), "/{2,}", "/")
    empty = F.array().cast("array<string>")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, s))
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(F.filter(F.split(plain, "/"), lambda s: s != ""), empty, step), "/"))
    return F.when(plain.rlike(r"/\.\.(?:/|$)"), walked).otherwise(plain)


def cleaned_path(x: Column) -> Column:
    """A path as text gives it, without what follows it there: brackets, marks, line and column."""
    c = F.regexp_replace(F.regexp_replace(F.trim(x), r"\\n", ""), r"[),\].}]+$", "")
    return normal_path(F.regexp_replace(c, r":[0-9]+(?::[0-9]+)?$", ""))


def absolute_paths(x: Column | str, most: int = MOST_PATHS, chars: int = MOST_PATH_CHARS) -> Column:
    """Distinct absolute paths in a text, in order; it ends with so many of them, or characters in all that were found."""
    found = F.filter(F.transform(F.regexp_extract_all(either(x), F.lit(PATHS), F.lit(0)), cleaned_path), lambda p: p.startswith("/"))
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, p: Column) -> Column:
        seen = acc["chars"] + F.length(p)
        full = (seen > chars) | (F.size(acc["paths"]) >= most)
        return F.struct(seen.alias("chars"), F.when(full, acc["paths"]).otherwise(F.array_union(acc["paths"], F.array(p))).alias("paths"))

    return F.aggregate(found, start, step, lambda acc: acc["paths"])


def return_code(x: Column | str) -> Column:
    return F.regexp_extract(either(x), "<returncode>(-?[0-9]+)</returncode>", 1).try_cast("int")


def failure_line(x: Column | str, most: int = 200) -> Column:
    """The first line that has the word error."""
    lines = F.filter(F.split(either(x), "\n"), lambda s: s.rlike("(?i)(^|[^A-Za-z0-9_])error([^A-Za-z0-9_]|$)"))
    return F.substring(F.get(lines, F.lit(0)), 1, most)


def finding_step(x: Column | str) -> Column:
    """Step of an id such as incorrect-step-N."""
    return F.regexp_extract(either(x), "^incorrect-steps?-([0-9]+)", 1).try_cast("int")


def percent(part: Column, whole: Column) -> Column:
    """One decimal, or unknown: never 0 for what isn't known."""
    return F.coalesce(F.concat(F.round(F.try_divide(part * 100, whole), 1).cast("decimal(18,1)").cast("string"), F.lit("%")), F.lit("unknown"))


def usd(x: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("$"), either(x).cast("decimal(18,4)").cast("string")), F.lit("unknown"))


def span_ms(x: Column | str) -> Column:
    """A duration in hours, minutes and seconds."""
    s = F.floor(either(x) / 1000)
    return F.when(s.isNull(), "unknown").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), (F.floor(s / 60) % 60).cast("string"), F.lit("m")))


def uuid7_ms(x: Column | str) -> Column:
    """Milliseconds of a version-7 UUID."""
    return F.conv(F.substring(F.replace(either(x), F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")


def condensed(x: Column | str, most: int = 200) -> Column:
    """Head and tail of a long message, 40 and 60 percent."""
    c, head = either(x), most * 2 // 5
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(" … "), F.right(c, F.lit(most - head))))


def span_uri(trace: Column, span: Column) -> Column:
    def part(c: Column) -> Column:
        out = F.url_encode(c)
        for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.concat(F.lit("trace://"), part(trace), F.lit("/span/"), part(span))


def under(path: Column, folder: str) -> Column:
    """Whether a path is a folder or below it; /repo-old is not below /repo."""
    return (path == folder) | path.startswith(f"{folder.rstrip('/')}/")
