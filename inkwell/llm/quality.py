"""Quality rules: one threshold table compiled into one Spark projection.

``signals`` adds plain columns computed from the whole text by built-in functions only;
``verdict`` turns a table of thresholds into one boolean expression over them. Nothing is
shuffled and nothing leaves the JVM.

Null text counts as a text without words. Each input row, repeated ones too, gives one row;
an empty table gives an empty result; other input columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import id_text

#: White space and symbol classes, and frequent function words of four languages.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = (
    "the of and to in is that it was for on are with as this be by from or an "
    "le la les de des du et en un une que qui dans pour sur pas par est au "
    "der die das und zu den von mit ist ein eine nicht sich auf im dem es als "
    "el los las del y se por con para una su al lo como no"
).split()


@dataclass(frozen=True)
class Rule:
    """A row fails if ``scale * numerator`` is above (or below) ``limit * denominator`` and it has ``min_words`` words."""

    name: str
    numerator: str
    denominator: str
    side: str
    limit: int
    scale: int = 100
    min_words: int = 0


#: Ratios in hundredths, so that all arithmetic is whole-numbered.
RULES = (
    Rule("mean_word_short", "word_chars", "n_words", "below", 150),
    Rule("mean_word_long", "word_chars", "n_words", "above", 2000),
    Rule("symbols", "n_symbols", "n_words", "above", 50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", "above", 50),
    Rule("stop_words", "n_stop_words", "n_words", "below", 1, min_words=100),
)


def words_of(text: Column) -> Column:
    """Words between runs of white space; null or blank text gives an empty array."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def window_hashes(words: Column, k: int = 5) -> Column:
    """A hash of each window of k words, in order of start."""
    n = F.size(words)
    at = lambda i: [F.get(words, i + F.lit(j)) for j in range(k)]
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))


def signals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words (long).

    For n_repeat_words, windows of equal hash lie side by side after sorting (hash, start); the
    starts of repeated ones, sorted, each cover the distance to the next, k words at most.
    """
    k = 5
    t = F.coalesce(F.col(text), F.lit(""))
    df = id_text(docs, key, text).select(key, t.alias("_t"))
    df = df.select(
        key,
        F.length("_t").alias("_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).alias("_plain"),
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("_lines"),
    )
    df = df.select("*", window_hashes(F.col("_w"), k).alias("_h"))
    df = df.select("*", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_twice"))
    # Only texts with a repeated window pay for the sort.
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.select(
        "*",
        F.when(
            F.col("_twice"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        )
        .otherwise(none)
        .alias("_s"),
    )
    df = df.select(
        "*",
        F.when(
            F.col("_twice"),
            F.sort_array(
                F.transform(
                    F.filter("_s", lambda x, i: F.coalesce(x["h"] == F.get(F.col("_s"), i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(F.col("_s"), i + 1)["h"], F.lit(False))),
                    lambda x: x["p"],
                )
            ),
        )
        .otherwise(F.array().cast("array<int>"))
        .alias("_p"),
    )
    steps = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(k), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(k)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return df.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.col("_chars") - F.col("_plain")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        steps.cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one expression: true for rows that no rule fails."""
    fails = F.lit(False)
    for r in rules:
        left, right = F.col(r.numerator) * r.scale, F.col(r.denominator) * r.limit
        out = left > right if r.side == "above" else left < right
        fails = fails | (out & (F.col("n_words") >= r.min_words))
    return ~fails


def quality(docs: DataFrame, rules=RULES, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """signals plus base_failed and kept: base rules first, then the threshold table."""
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    return signals(docs).select("*", base.alias("base_failed")).select("*", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def oracle() -> str:
    """The same over the view ``documents`` for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    fails = " OR ".join(
        f"({r.scale} * {r.numerator} {'>' if r.side == 'above' else '<'} {r.limit} * {r.denominator} AND n_words >= {r.min_words})" for r in RULES
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS n FROM g
), starts AS (
  SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM twice WHERE n >= 2
), rep AS (
  SELECT rid, sum(least(5, coalesce(nxt - p, 5))) AS n_repeat_words FROM starts GROUP BY rid
), s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s
)
SELECT *, (NOT base_failed AND NOT ({fails})) AS kept FROM b
"""
