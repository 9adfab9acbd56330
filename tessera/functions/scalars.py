"""Scalar functions over strings, paths, arrays, times and JSON, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that log scanners take for failures; in logs their second letter is masked. Fixed values.
LOG_WORDS = ("error", "fail", "exception", "critical")

#: Rules for secrets in content. Fixed values.
SECRET_RULES = {
    "private_key_marker": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_access_key_id": r"\bAKIA[0-9A-Z]{16}\b",
    "generic_secret_assignment": r"""(?i)\b(api[_-]?key|secret|token|password|passwd|credential)\b\s*[:=]\s*['"]?[^\s'"]{8,}""",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_log_words(text: Column | str) -> Column:
    out = _c(text)
    for w in LOG_WORDS:
        out = F.regexp_replace(out, rf"(?i)\b({w[0]}){w[1]}({w[2:]})\b", "$1*$2")
    return out


def collapsed(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def keywords(text: Column | str, least: int = 4) -> Column:
    """The distinct words `[a-z0-9_]+` of least characters or more, in order of appearance."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= least))


def truncated(text: Column | str, n: int) -> Column:
    """The text, or its first n characters without trailing space and an ellipsis where it is longer."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("…"))).otherwise(t)


def embed_input(text: Column | str, n: int = 1800) -> Column:
    return F.substring(_c(text), 1, n)


def entity_text(name: Column | str, description: Column | str) -> Column:
    """What is embedded for an entity: its name and the first 256 characters of its description."""
    d = F.translate(F.coalesce(_c(description), F.lit("")), "\r\n", "  ")
    return F.concat(_c(name), F.lit(": "), F.when(F.trim(d) == "", F.lit("(no description)")).otherwise(F.substring(d, 1, 256)))


def secret_rules(text: Column | str, max_chars: int | None = None) -> Column:
    """The names of the content rules that match in the text, or in its first max_chars characters."""
    t = _c(text) if max_chars is None else F.substring(_c(text), 1, max_chars)
    return F.array_compact(F.array(*(F.when(t.rlike(rule), F.lit(name)) for name, rule in SECRET_RULES.items())))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """With its dot, in small letters; empty for names without one or with a leading one alone."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def path_parts(path: Column | str) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda p: p != "")


def within(path: Column | str, folder: Column | str) -> Column:
    """Containment by whole components: /a/b holds /a/b/c and itself, not /a/bc."""
    p, d = _c(path), F.regexp_replace(_c(folder), "/+$", "")
    return (p == d) | F.startswith(p, F.concat(d, F.lit("/")))


def overlaps(a: Column | str, b: Column | str) -> Column:
    return within(a, b) | within(b, a)


def relative_to(path: Column | str, root: Column | str) -> Column:
    return F.when(within(path, root), F.substring(_c(path), F.length(_c(root)) + 2, F.length(_c(path))))


def dotted(extension: str) -> str:
    """An extension with its dot."""
    return extension if extension.startswith(".") else f".{extension}"


def iso_utc(epoch_seconds: Column | str) -> Column:
    """Whole seconds since the epoch as ISO 8601 in UTC, whatever the session's time zone."""
    s = F.floor(_c(epoch_seconds)).cast("long")
    of_day = F.pmod(s, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor((s - of_day) / 86400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(of_day / 3600), F.lit(":"), two(of_day % 3600 / 60), F.lit(":"), two(of_day % 60), F.lit("Z"))


def iso_time(text: Column | str) -> Column:
    """A time from ISO 8601 text, with Z, an offset or none, which is UTC; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(_c(text)), "[zZ]$", "+00:00"))


def since_days(text: str) -> int:
    """Days of "30d"; anything else is refused."""
    found = re.fullmatch(r"(\d+)d", text.strip().lower())
    if not found:
        raise ValueError(f"not a number of days: {text!r}")
    return int(found[1])


def string_list(json_text: Column | str) -> Column:
    """An array from JSON text; anything that is not a JSON array is an empty one."""
    return F.coalesce(F.from_json(_c(json_text), "array<string>"), F.array().cast("array<string>"))


def unfenced_json(text: Column | str) -> Column:
    """JSON text without the code fence that models put around it."""
    return F.regexp_replace(F.trim(_c(text)), r"^```[A-Za-z]*\s*|\s*```$", "")


def report_fields(text: Column | str) -> Column:
    """(title, summary, findings) of a report in JSON: at most 200 and 500 characters, and 5 findings of 200."""
    j = F.from_json(unfenced_json(text), "title string, summary string, findings array<string>")

    def fields(j: Column) -> Column:
        cut = F.transform(F.slice(F.coalesce(j["findings"], F.array().cast("array<string>")), 1, 5), lambda f: F.substring(f, 1, 200))
        return F.struct(F.substring(F.coalesce(j["title"], F.lit("")), 1, 200).alias("title"), F.substring(F.coalesce(j["summary"], F.lit("")), 1, 500).alias("summary"), cut.alias("findings"))

    # As an array's one element: else each field would be taken by a parse of its own.
    return F.transform(F.array(j), fields)[0]


def joined_parts(parts: Column | str) -> Column:
    """The text of a message's content in JSON: a string as it is, of a list its parts of the type text, one line each; else empty."""
    c = F.trim(_c(parts))
    text = F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string")["x"]
    own = F.from_json(c, "array<struct<type:string,text:string>>")
    lines = F.array_join(F.transform(F.filter(own, lambda p: (p["type"] == "text") & (p["text"] != "")), lambda p: p["text"]), "\n")
    return F.coalesce(F.when(F.startswith(c, F.lit('"')), text).when(F.startswith(c, F.lit("[")), lines), F.lit(""))


def cosine(a: Column | str, b: Column | str) -> Column:
    """In double precision; 0 where either vector has no length."""
    a, b = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot / length)


def blended(score: Column | str, overlap: Column | str, n_query: int, alpha: float) -> Column:
    """(1 - alpha) * score + alpha * overlap / max(number of query entities, 1)."""
    return (1 - alpha) * _c(score) + alpha * _c(overlap) / max(n_query, 1)


def split_long_lines(text: Column | str, triggers: str) -> Column:
    """Line breaks after every trigger character in lines of more than 120 characters, but for one at a line's very end."""
    marks = "[" + re.escape(triggers) + "]"
    lines = F.split(_c(text), "\n")
    return F.array_join(F.transform(lines, lambda s: F.when(F.length(s) > 120, F.regexp_replace(s, f"({marks})(?=.)", "$1\n")).otherwise(s)), "\n")
