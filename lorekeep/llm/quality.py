"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built-in expressions over the document's own text; there is no
user function and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is it that was for on are as with his they at be this have from or by one had not but what all were when we there can an your which their if do will each how "
    "der die das und ist von zu den mit auf ein eine im nicht sich dem des für an als auch es "
    "le la les de du des et est un une que qui dans en pour pas sur au avec ce il elle "
    "el los las y en un una que es por con para su se del lo como más al"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: ``least <= measure <= most`` passes, for texts of at least ``words`` words."""

    measure: str
    least: float | None = None
    most: float | None = None
    words: int = 0


#: The table in production.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_length", least=2.0, most=14.0),
    Rule("symbols_per_word", most=0.10),
    Rule("upper_ratio", most=0.50, words=20),
    Rule("stop_word_ratio", least=0.02, words=50),
    Rule("dup_line_ratio", most=0.50),
    Rule("repeat_word_ratio", most=0.50),
    Rule("alpha_word_ratio", least=0.50),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts and ratios that rules refer to, one row per input row.

    Null and empty texts have no words, lines or symbols; their ratios are 0.
    Repeated rows are measured each.  Long texts are measured in whole, a text
    at a time, in memory of some 30 bytes a word.  Windows are told apart by
    64-bit hashes: in a text of a million words two different ones are taken
    for equal with probability 3e-8.  Other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    base = base.select("doc_id", "t", F.filter(F.split("t", SPACES + "+"), lambda w: w != "").alias("w"))
    hashes = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.get(F.col("w"), i - 1), F.get(F.col("w"), i), F.get(F.col("w"), i + 1)))
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    part = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES + "+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        hashes.alias("h"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("uppers"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).alias("letters"),
        F.size(F.filter("w", lambda w: w.rlike(r"\p{L}"))).alias("alpha_words"),
        F.size(F.filter("w", lambda w: F.array_contains(stops, F.lower(F.rtrim(w, F.lit(".,!?;:")))))).alias("stop_words"),
    )
    # windows sorted by hash, so that equal ones are neighbours; then back in order of position
    part = part.withColumn("some", F.size(F.array_distinct("h")) < F.size("h"))
    part = part.withColumn("s", F.when(F.col("some"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    part = part.withColumn("p", F.when(F.col("some"), F.sort_array(F.transform(
        F.filter("s", lambda x, k: F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    counted = part.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("some"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), "uppers", "letters", "alpha_words", "stop_words",
    )
    # a generator: predicates on what follows are not pushed below it, where they would repeat all of the above
    counted = counted.select(F.inline(F.array(F.struct(*counted.columns))))
    w = F.col("n_words")
    return counted.withColumns({
        "mean_word_length": ratio(F.col("word_chars"), w),
        "symbols_per_word": ratio(F.col("n_symbols"), w),
        "upper_ratio": ratio(F.col("uppers"), F.col("letters")),
        "stop_word_ratio": ratio(F.col("stop_words"), w),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_word_ratio": ratio(F.col("n_repeat_words"), w),
        "alpha_word_ratio": ratio(F.col("alpha_words"), w),
    })


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: every rule passes."""
    verdict = F.lit(True)
    for r in rules:
        m, ok = F.col(r.measure), F.lit(True)
        if r.least is not None:
            ok = ok & (m >= r.least)
        if r.most is not None:
            ok = ok & (m <= r.most)
        verdict = verdict & ((F.col("n_words") < r.words) | ok if r.words else ok)
    return verdict


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measures`` with ``base_failed`` (too short, or mostly repeated) and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


_WS = r"[\x20\x09-\x0D]+"
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(STOP_WORDS))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_WS}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS n FROM k WHERE c > 1),
s AS (SELECT rid, sum(least(3, coalesce(n - i, 3)))::BIGINT AS n_repeat_words FROM r GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS uppers, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS alpha_words,
             len(list_filter(w, lambda x: lower(rtrim(x, '.,!?;:')) IN ({_STOP_SQL}))) AS stop_words
      FROM w LEFT JOIN s USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 50 AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.10
       AND (n_words < 20 OR CASE WHEN letters > 0 THEN uppers / letters ELSE 0 END <= 0.50) AND (n_words < 50 OR stop_words / n_words >= 0.02)
       AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.50 AND n_repeat_words / n_words <= 0.50 AND alpha_words / n_words >= 0.50 AS kept
FROM f
"""
