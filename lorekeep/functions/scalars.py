"""Scalar functions as column expressions.

Time is always a parameter (``now_ms``); nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
DEFAULT_HALF_LIFE_DAYS = 7.0
LN2 = 0.6931471805599453


def half_life_ms(days: float = DEFAULT_HALF_LIFE_DAYS) -> int:
    """Days to whole milliseconds; negative ones become 0, which means no decay."""
    return max(0, int(days * DAY_MS))


def _halved(age: Column, half_life: int) -> Column:
    return F.exp(F.lit(-LN2) * age / F.lit(float(half_life)))


def decayed_score(score: Column, last_ms: Column, now_ms: int, half_life: int, ahead: bool = False) -> Column:
    """``score * 2**(-age / half_life)``; as it is for no half-life, and for a future time unless ``ahead`` lets it grow likewise."""
    if half_life == 0:
        return score
    age = F.lit(now_ms) - last_ms
    if ahead:
        return score * _halved(age, half_life)
    return F.when(age > 0, score * _halved(age, half_life)).otherwise(score)


def freshness(created_ms: Column, now_ms: int, half_life: int, ahead: bool = False) -> Column:
    """``2**(-age / half_life)``; 1 for no half-life, and for a future time unless ``ahead`` lets it pass 1."""
    if half_life == 0:
        return F.lit(1.0)
    age = F.lit(now_ms) - created_ms
    if ahead:
        return _halved(age, half_life)
    return F.when(age > 0, _halved(age, half_life)).otherwise(F.lit(1.0))


def boost(decayed: Column) -> Column:
    """1 + the decayed score clamped to 0..10."""
    return F.lit(1.0) + F.least(F.greatest(decayed, F.lit(0.0)), F.lit(10.0))


def recall_score(similarity: Column, fresh: Column, decayed: Column) -> Column:
    return similarity * fresh * boost(decayed)


def memory_score(similarity: Column | None, keyword: Column, fresh: Column, decayed: Column) -> Column:
    """With a similarity, freshness does not count; else keywords and freshness do."""
    return similarity * boost(decayed) if similarity is not None else (keyword + F.lit(0.1)) * fresh * boost(decayed)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at least 3 bytes, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), lambda t: F.octet_length(t) >= 3)


def keyword_score(query_tokens: list[str], text: Column) -> Column:
    """Share of the query's tokens that are substrings of the lower-cased text."""
    if not query_tokens:
        return F.lit(0.0)
    hay = F.lower(text)
    hits = sum((F.contains(hay, F.lit(t)).cast("int") for t in query_tokens), F.lit(0))
    return hits / F.lit(float(len(query_tokens)))


def tokens_of(query: str) -> list[str]:
    """``tokens`` for a query on the driver."""
    out, word = [], ""
    for c in query.lower() + " ":
        if c.isalnum():
            word += c
        else:
            if len(word.encode()) >= 3:
                out.append(word)
            word = ""
    return out


def truncate_chars(text: Column, most: int) -> Column:
    """The first ``most`` characters and an ellipsis if there are more; empty for 0."""
    if most == 0:
        return F.lit("")
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def sanitize_segment(text: Column) -> Column:
    """Runs of anything but ASCII letters, digits, dots and dashes become one dash; dashes at the ends go."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9.\-]+", "-"), r"^-+|-+$", "")


def base64url(data: Column) -> Column:
    """Without padding."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.base64(data), r"\s", ""), "=+$", ""), "+/", "-_")


def from_base64url(text: Column) -> Column:
    padded = F.rpad(text, F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.unbase64(F.translate(padded, "-_", "+/"))


def fingerprint(hash_hex: Column) -> Column:
    """The first 8 bytes of a hash, in hex."""
    return F.substring(hash_hex, 1, 16)


def branch_namespace(branch: Column) -> Column:
    return F.split_part(branch, F.lit("/"), F.lit(1))


def branch_id(namespace: Column, label: Column) -> Column:
    return F.concat_ws("/", namespace, label)


def delta_key(namespace: Column, device: Column, to_cursor: Column) -> Column:
    return F.concat(namespace, F.lit("/deltas/"), device, F.lit("/"), to_cursor.cast("string"), F.lit(".delta"))


def valid_blob_key(key: Column) -> Column:
    """At most 512 characters of a safe set, no segment empty, ``.`` or ``..``."""
    return F.coalesce(key.rlike(r"^[A-Za-z0-9._/\-]{1,512}$") & F.forall(F.split(key, "/"), lambda s: ~s.isin("", ".", "..")), F.lit(False))


def first_line(body: Column) -> Column:
    """The first line that is not blank, trimmed."""
    return F.get(F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)


def statement(description: Column, body: Column, source_path: Column) -> Column:
    """Description, else the body's first line with text, else the path, else nothing."""
    return F.coalesce(F.when(description != "", description), first_line(body), source_path, F.lit(""))


def display_text(*candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit("(no text)"))


def frontmatter(text: Column) -> Column:
    """``struct<fields: map<string,string>, body: string>`` of a Markdown text.

    Fields stand between a first line ``---`` and the next such line.  Later
    ones win; a pair of quotes goes.  Without an end the whole text is the
    body, and fields are read all the same; without a start there are none.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda x, i: F.lit(True))
    lines = F.when(F.endswith(text, F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    opened = F.trim(F.get(lines, 0)) == "---"
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    end = F.array_position(F.transform(rest, lambda x: F.trim(x)), "---").cast("int")  # 0: none
    head = F.when(end > 0, F.slice(rest, 1, end - 1)).otherwise(rest)
    strip = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), '^"+|"+$', ""), "^'+|'+$", "")
    pairs = F.transform(F.filter(head, lambda x: (F.instr(x, ":") > 0) & (F.trim(F.substring_index(x, ":", 1)) != "")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), strip(F.expr("substring(x, instr(x, ':') + 1)") if False else F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    fields = F.when(opened, F.map_from_entries(last)).otherwise(F.map_from_entries(F.slice(pairs, 1, 0)))
    body = F.when(opened & (end > 0), F.array_join(F.slice(rest, end + 1, F.size(rest)), "\n")).otherwise(text)
    return F.struct(fields.alias("fields"), body.alias("body"))


# -- vectors -------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def vector_error(a: Column, dim: int | None) -> Column:
    """Why a vector cannot be indexed, or null: empty, wrong dimension, not finite, zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checks = F.when(a.isNull() | (F.size(a) == 0), "empty")
    if dim is not None:
        checks = checks.when(F.size(a) != dim, "dimension")
    return checks.when(bad, "not finite").when(norm(a) == 0, "zero")
