"""Quality rules, line first: lines are judged one by one, failing lines go, and a
document that loses too much of its text goes with them.

Built-in expressions only; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import once, words

#: Phrases of page furniture, matched without regard to case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "click here", "read more",
    "sign up", "log in", "subscribe to", "enable javascript", "lorem ipsum", "share this", "back to top", "skip to content",
)
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: A line is a headline or a fragment when it has fewer words and no closing mark.
FRAGMENT_WORDS = 4
#: Page furniture is short: longer lines that hold such a phrase are prose.
BOILERPLATE_WORDS = 15
#: Share of a document's non-blank characters that its failing lines may hold.
MAX_LOST = 0.4


def punctuation_fails(line: Column) -> Column:
    """A short line without a closing mark, shouting, or more symbols than a word in five can carry."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    fragment = (n < FRAGMENT_WORDS) & ~line.rlike(r"""[.!?:;…。"'»”)\]}]["'»”)\]]*[\x20\x09-\x0D]*$""")
    shouting = F.regexp_count(line, F.lit(r"[!?]{2,}")) * 3 > n
    symbols = F.regexp_count(line, F.lit(r"[#*$%&<>]{2,}")) * 5 > n
    return fragment | shouting | symbols


def navigation_fails(line: Column) -> Column:
    """Items with separators between them: three or more, one for every three words at least."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    marks = F.regexp_count(line, F.lit(r"(^|[\x20\x09-\x0D])[|>»·•/]+(?=[\x20\x09-\x0D]|$)"))
    return (marks >= 3) & (marks * 3 >= n)


def boilerplate_fails(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(BOILERPLATE)) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) <= BOILERPLATE_WORDS)


def line_fails(line: Column) -> Column:
    return punctuation_fails(line) | navigation_fails(line) | boilerplate_fails(line)


def quality(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` plus the base figures, ``clean_text`` (the lines that passed), ``lost`` and ``kept``.

    * A null text counts as an empty one: no words, rejected by the base rule.
    * Blank lines stay as they are and count for nothing.
    * Rows are judged on their own: repeated rows give repeated results.
    * Other columns pass through, whatever their names; working columns start
      with ``_q_`` and are dropped. A column named like a result is replaced.
    * Two different three-word windows count as equal only if their 64-bit hashes agree.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost", "kept"]
    df = docs.drop(*results)
    df = once(df, F.coalesce(F.col(text), F.lit("")), "_q_text")
    df = once(df, words(F.col("_q_text")), "_q_words")
    grams = F.transform(
        F.arrays_zip("_q_words", F.expr("slice(_q_words, 2, greatest(size(_q_words), 1))").alias("b"), F.expr("slice(_q_words, 3, greatest(size(_q_words), 1))").alias("c")),
        lambda z, i: F.struct(F.xxhash64(z["_q_words"], z["b"], z["c"]).alias("h"), i.alias("p"), z["c"].isNotNull().alias("whole")),
    )
    df = once(df, F.sort_array(F.filter(grams, lambda g: g["whole"])), "_q_grams")
    again = F.filter(
        "_q_grams",
        lambda g, i: (g["h"] == F.get(F.col("_q_grams"), i - 1)["h"]) | (g["h"] == F.get(F.col("_q_grams"), i + 1)["h"]),
    )
    places = F.sort_array(F.transform(again, lambda g: g["p"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    df = once(df, F.split("_q_text", "\n"), "_q_lines")
    full = F.filter("_q_lines", lambda x: x.rlike(HAS_WORD))
    df = once(df, F.filter("_q_lines", lambda x: ~x.rlike(HAS_WORD) | ~line_fails(x)), "_q_kept")
    chars = lambda c: F.length(F.regexp_replace(c, r"[\x20\x09-\x0D]+", ""))
    df = df.select(
        "*",
        F.size("_q_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_q_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        F.array_join("_q_kept", "\n").alias("clean_text"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - chars(F.col("clean_text")) / F.col("word_chars")).otherwise(F.lit(0.0)))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    return df.drop("_q_text", "_q_words", "_q_grams", "_q_lines", "_q_kept")


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
_W = r"[^\x20\x09-\x0D]+"
_N = f"len(regexp_extract_all(l, '{_W}'))"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_W}') AS w FROM d),
base AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, w FROM w),
pos AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
grams AS (SELECT r, i, w[i:i + 2] AS g FROM pos),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cover AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
full_lines AS (SELECT *, {_N} AS n FROM lines WHERE regexp_matches(l, '{_W}')),
judged AS (
  SELECT r, l,
    (n < {FRAGMENT_WORDS} AND NOT regexp_matches(l, '[.!?:;…。"''»”)\]}}]["''»”)\]]*[\x20\x09-\x0D]*$'))
    OR len(regexp_extract_all(l, '[!?]{{2,}}')) * 3 > n
    OR len(regexp_extract_all(l, '[#*$%&<>]{{2,}}')) * 5 > n
    OR (marks >= 3 AND marks * 3 >= n)
    OR (regexp_matches(l, '(?i){"|".join(BOILERPLATE)}') AND n <= {BOILERPLATE_WORDS}) AS fails
  FROM (SELECT *, len(list_filter(regexp_extract_all(l, '{_W}'), lambda x: regexp_full_match(x, '[|>»·•/]+'))) AS marks FROM full_lines)),
per AS (
  SELECT r, count(*) - count(DISTINCT l) AS dup,
    coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE NOT fails), 0) AS left_chars
  FROM judged GROUP BY r),
out AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1 - coalesce(left_chars, 0) / word_chars ELSE 0 END AS lost
  FROM base LEFT JOIN per USING (r) LEFT JOIN cover USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND lost <= {MAX_LOST} AS kept FROM out"""


def op1_quality_rules(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*OUT)
