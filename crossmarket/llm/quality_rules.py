"""Line-first cleaning, in Spark expressions alone.

Rules look at single lines: punctuation (symbols or exclamation instead of words), navigation (menu and
table separators) and boilerplate (notices and prompts). Failing lines are removed, then a document
that has lost more than half of its word characters is rejected. Whole-document measures (words,
symbols, repeated lines and windows of words) decide before that.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmarket.llm.common import SPACE, keyed

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
WINDOW = 5
# Fixed phrases of notices and prompts, matched in lower-cased lines.
BOILERPLATE = ("all rights reserved", "is licensed under", "privacy policy", "cookie policy", "uses cookies",
               "terms of service", "terms of use", "enable javascript", "sign up for our newsletter",
               "subscribe to our newsletter", "click here to", "share on facebook", "skip to content")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among `chars` (translate would look every character up)."""
    if len(chars) == 1:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit(chars)))
    return F.regexp_count(text, F.lit(f"[{re.escape(chars)}]"))


def joined_length(words: Column) -> Column:
    return F.char_length(F.array_join(words, ""))


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in runs of `window` words found at least twice, all occurrences counted.

    Runs are compared by a 64-bit hash. Texts without a repeated run, the usual case, end there; others
    sort their runs once, so the work is n log n in a text's words.
    """
    def windows(w: Column) -> Column:
        runs = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, window))))
        return F.slice(runs, F.lit(1), F.size(w) - (window - 1))

    hashes = let(F.transform(words, lambda x: F.xxhash64(x)), windows)

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            def equals(x: Column, other: Column) -> Column:
                return F.coalesce(x["h"] == F.get(s, other)["h"], F.lit(False))

            again = F.filter(s, lambda x, j: equals(x, j - 1) | equals(x, j + 1))
            return let(F.sort_array(F.transform(again, lambda x: x["i"])), of_starts)

        return let(ordered, of_sorted)

    def of_starts(p: Column) -> Column:
        steps = F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def line_fails(line: Column) -> Column:
    """True for a line that is punctuation, navigation or boilerplate."""
    def judge(n: Column) -> Column:
        separators = count_chars(line, SEPARATORS)
        punctuation = ((2 * count_chars(line, SYMBOLS) >= n)
                       | (F.char_length(line) - F.char_length(F.replace(line, F.lit("!!"))) >= n))
        return punctuation | ((separators >= 3) & (3 * separators >= n))

    def boilerplate(low: Column) -> Column:
        return reduce(or_, (F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE))

    # Counting is only for lines that have something to count.
    marked = line.rlike(f"[{re.escape(SYMBOLS + SEPARATORS)}]|!!")
    return ~line.rlike(r"[\p{L}\p{N}]") | (marked & let(count_words(line), judge)) | let(F.lower(line), boilerplate)


def clean_lines(docs: DataFrame, least_words: int = 10, most_repeated: int = 20, most_lost: int = 50,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_removed_lines, lost_chars, cleaned.

    `base_failed`: fewer than `least_words` words, or over `most_repeated` percent of them in repeated
    windows. `kept`: not failed, and the removed lines hold at most `most_lost` percent of the word characters.
    `cleaned` is the text without the removed lines. Missing and empty texts have no words, so they fail.
    Rows are judged alone: repeated rows alike, an empty table to none.
    """
    rows = keyed(docs, id_col, text_col)

    def measured(text: Column) -> Column:
        def with_words(words: Column) -> Column:
            return F.struct(F.size(words).cast("bigint").alias("n_words"),
                            joined_length(words).cast("bigint").alias("word_chars"),
                            repeated_window_words(words).cast("bigint").alias("n_repeat_words"))

        def judged(line: Column) -> Column:
            filled = line.rlike(f"[^{SPACE}]")
            return F.struct(line.alias("line"), filled.alias("filled"),
                            F.when(filled, line_fails(line)).otherwise(F.lit(False)).alias("bad"))

        def with_lines(lines: Column) -> Column:
            filled = F.filter(lines, lambda l: l["filled"])["line"]
            removed, kept = F.filter(lines, lambda l: l["bad"])["line"], F.filter(lines, lambda l: ~l["bad"])["line"]
            dup = let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f)))
            return let(removed, lambda r: F.struct(
                dup.cast("bigint").alias("n_dup_lines"), F.size(filled).cast("bigint").alias("n_lines"),
                F.size(r).cast("bigint").alias("n_removed_lines"),
                joined_length(words_of(F.array_join(r, " "))).cast("bigint").alias("lost_chars"),
                F.when(F.size(r) == 0, text).otherwise(F.array_join(kept, "\n")).alias("cleaned")))

        return F.struct(let(words_of(text), with_words).alias("w"), let(F.transform(F.split(text, "\n"), judged), with_lines).alias("l"),
                        count_chars(text, SYMBOLS).cast("bigint").alias("n_symbols"))

    def verdict(m: Column) -> Column:
        failed = (m["w"]["n_words"] < least_words) | (100 * m["w"]["n_repeat_words"] > most_repeated * m["w"]["n_words"])
        return F.struct(m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"),
                        m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
                        m["w"]["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
                        (~failed & (100 * m["l"]["lost_chars"] <= most_lost * m["w"]["word_chars"])).alias("kept"),
                        m["l"]["n_lines"].alias("n_lines"), m["l"]["n_removed_lines"].alias("n_removed_lines"),
                        m["l"]["lost_chars"].alias("lost_chars"), m["l"]["cleaned"].alias("cleaned"))

    return rows.select("doc_id", let(measured(F.col("text")), verdict).alias("m")).select("doc_id", "m.*")


def _sql_line_fails(line: str, words: str) -> str:
    symbols = f"length({line}) - length(translate({line}, '{SYMBOLS}', ''))"
    separators = f"(length({line}) - length(translate({line}, '{SEPARATORS}', '')))"
    return f"""(2 * ({symbols}) >= {words} OR length({line}) - length(replace({line}, '!!', '')) >= {words}
        OR NOT regexp_matches({line}, '[\\p{{L}}\\p{{N}}]') OR ({separators} >= 3 AND 3 * {separators} >= {words})
        OR regexp_matches(lower({line}), '{"|".join(BOILERPLATE)}'))"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
win AS (SELECT k, i, array_to_string(words[i:i + 4], ' ') AS run FROM w, unnest(range(1, len(words) - 3)) AS t(i)
        WHERE len(words) >= 5),
rep AS (SELECT k, i, count(*) OVER (PARTITION BY k, run) AS n FROM win),
step AS (SELECT k, least(5, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 5)) AS c FROM rep WHERE n > 1),
r AS (SELECT k, sum(c) AS n_repeat_words FROM step GROUP BY k),
lines AS (SELECT k, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
          FROM d, unnest(string_split(text, chr(10))) AS t(line)),
judged AS (SELECT k, line, {_sql_line_fails("line", "n")} AS bad FROM lines WHERE n > 0),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             count(*) FILTER (WHERE bad) AS n_removed_lines,
             coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (WHERE bad), 0) AS lost_chars
      FROM judged GROUP BY k),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
             coalesce(lost_chars, 0) AS lost_chars
      FROM w LEFT JOIN r USING (k) LEFT JOIN l USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(lost_chars AS BIGINT) AS lost_chars
FROM b"""
