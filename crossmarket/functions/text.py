"""Title cleaning, tokens and similarity measures as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossmarket.functions import vocab


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def contains_all(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(True)
    for word in words:
        hit = hit & text.contains(word)
    return hit


def count_hits(text: Column, words: Iterable[str]) -> Column:
    """Number of listed words occurring in the text as substrings."""
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def first_match(text: Column, rules: Iterable[tuple], default: Column | str) -> Column:
    """Label of the first rule one of whose words occurs in the text."""
    chain = None
    for label, words in rules:
        hit = contains_any(text, words)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(default) if isinstance(default, str) else default)


def clean_text(text: Column, max_length: int) -> Column:
    """Collapse whitespace, drop non-ASCII, cut at the last blank before the limit."""
    one_line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    ascii_only = F.regexp_replace(one_line, r"[^\x00-\x7F]", "")
    head = F.substring(ascii_only, 1, max_length)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(ascii_only) > max_length, F.concat(cut, F.lit("..."))).otherwise(ascii_only)


def normalized_title(title: Column) -> Column:
    """Lowercase words without punctuation, single blanks (the text matched across venues)."""
    plain = F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def title_prefix_hash(title: Column, length: int = 20) -> Column:
    return F.substring(normalized_title(title), 1, length)


def keyword_title_hash(title: Column, length: int = 30) -> Column:
    """Title without stop words, blanks as underscores, cut to a fixed length.

    Word boundaries are those between ASCII word characters and others, in any language.
    """
    words = "|".join(vocab.HASH_STOP_WORDS)
    stripped = F.regexp_replace(F.lower(title), rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])", "")
    return F.substring(F.regexp_replace(stripped, r"\s+", "_"), 1, length)


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Distinct lowercase whitespace tokens, optionally without stop words."""
    words = F.array_distinct(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"))
    drop = [""] + list(stop_words)
    return F.array_except(words, string_array(drop))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two distinct-token arrays; empty on either side gives 0."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared.cast("double") / union)


def held_words(text: Column, words: tuple[str, ...]) -> Column:
    """Which of the words are among the whitespace tokens, as bits in their order (at most 31 words)."""
    found = F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+")
    bits = [F.when(F.array_contains(found, w), 1 << i).otherwise(0) for i, w in enumerate(words)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


BIT_COLUMNS = 4  # 64 listed tokens each


def listed_places(words: Column, listed: Column) -> Column:
    """Places of the words among the `listed` ones, from 0; -1 for others."""
    return F.transform(words, lambda w: (F.array_position(listed, w) - 1).cast("int"))


def place_bits(at: Column) -> list[Column]:
    """Distinct places below 64 * BIT_COLUMNS as bits of BIT_COLUMNS numbers."""
    def bits(i: int) -> Column:
        mine = F.filter(at, lambda n: n.between(64 * i, 64 * i + 63))
        return F.coalesce(F.aggregate(mine, F.lit(0).cast("bigint"), lambda all_bits, n: all_bits.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), n - 64 * i))), F.lit(0).cast("bigint"))

    return [bits(i) for i in range(BIT_COLUMNS)]


def shared_places(left: list[Column], right: list[Column]) -> Column:
    """How many places two sets of `place_bits` share.

    A double, since whole numbers are added with a check that costs more than all else here.
    """
    return reduce(lambda a, b: a + b, [F.bit_count(a.bitwiseAND(b)).cast("double") for a, b in zip(left, right)])


def shared_rest(left: Column, right: Column) -> Column:
    """How many words two arrays share, either of which may be NULL for none; a double."""
    both = left.isNotNull() & right.isNotNull()
    return F.when(both, F.size(F.array_intersect(left, right)).cast("double")).otherwise(0.0)


def title_jaccard(left: Column, right: Column) -> Column:
    return jaccard(tokens(left, vocab.JACCARD_STOP_WORDS), tokens(right, vocab.JACCARD_STOP_WORDS))


def word_jaccard(left: Column, right: Column) -> Column:
    """Jaccard on non-word splits without stop words."""
    def words(text: Column) -> Column:
        return F.array_except(F.array_distinct(F.split(F.lower(text), r"\W+")), string_array([""]))
    return jaccard(words(left), words(right))


def set_cosine(left: Column, right: Column) -> Column:
    """Shared tokens over the geometric mean of the two set sizes."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return F.when(shared == 0, F.lit(0.0)).otherwise(
        shared / F.sqrt((F.size(left) * F.size(right)).cast("double")))


def overlap_count(left: Column, right: Column) -> Column:
    drop = string_array(vocab.OVERLAP_STOP_WORDS)
    return F.size(F.array_except(F.array_intersect(left, right), drop))


def levenshtein_ratio(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    return F.when((F.length(left) > 0) & (F.length(right) > 0),
                  F.lit(1.0) - F.levenshtein(left, right) * F.lit(1.0) / longest).otherwise(F.lit(0.0))


def containment_ratio(left: Column, right: Column) -> Column:
    """1 - (len a + len b - 2 * len contained) / longest; negative without containment."""
    contained = (F.when(F.instr(left, right) > 0, F.length(right))
                 .when(F.instr(right, left) > 0, F.length(left)).otherwise(F.lit(0)))
    longest = F.greatest(F.length(left), F.length(right)).cast("double")
    ratio = F.lit(1.0) - (F.length(left) + F.length(right) - contained * 2) / longest
    return F.when((F.length(left) > 5) & (F.length(right) > 5), ratio).otherwise(F.lit(0.0))


def short_description(description: Column, title: Column, length: int) -> Column:
    """First characters of the description, or the title when there is none to speak of."""
    return F.when(F.length(description) > 10,
                  F.concat(F.substring(description, 1, length), F.lit("..."))).otherwise(title)


def first_word(text: Column) -> Column:
    return F.split_part(text, F.lit(" "), F.lit(1))


def title_case(text: Column) -> Column:
    return F.initcap(F.trim(text))


def sentiment(title: Column, description: Column) -> Column:
    """Struct of score, label, confidence and up to five matched words."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))))
    good = count_hits(text, vocab.POSITIVE_WORDS)
    bad = count_hits(text, vocab.NEGATIVE_WORDS)
    total = good + bad
    score = F.when(total == 0, F.lit(0.0)).otherwise((good - bad).cast("double") / total)
    label = F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")
    confidence = F.when(total == 0, F.lit(0.3)).otherwise(F.least(F.lit(0.9), total / F.lit(10.0)))
    listed = string_array(vocab.POSITIVE_WORDS + vocab.NEGATIVE_WORDS)
    phrases = F.slice(F.filter(listed, lambda w: F.contains(text, w)), 1, 5)
    return F.struct(score.alias("score"), label.alias("label"), confidence.alias("confidence"),
                    phrases.alias("phrases"))


def pair_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *parts))


def cosine_of_vectors(left: Column, right: Column) -> Column:
    """Cosine of two float arrays of equal length."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                           F.lit(0.0), lambda acc, v: acc + v)
    return dot(left, right) / F.sqrt(dot(left, left) * dot(right, right))
