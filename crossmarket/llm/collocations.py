"""Phrase collocations counted with double-array tries over word numbers.

1. Tasks split texts into pieces and words once, number the words of a block, and count them. Counts are summed per
   language and word; words that reach `min_count` get numbers without gaps, and blocks take these over from broadcasts
   of at most `words_size` words each. From there on a block is an array of numbers, -1 where no phrase can go on.
2. A phrase can only reach `min_count` if its part without the last word and its part without the first word do. Blocks report
   the word sequences of which that is known, and how often; what reaches `min_count` over all blocks
   is a candidate.
3. Candidates of one length are cut into parts of at most `part_size`, each part becomes a double-array trie, which is
   broadcast, and every task advances the states of all positions of a block at once, digit by digit and word by word.
   Accepting states are counted by bincount, and the counts of all blocks are summed. The same pass reports the
   sequences one word longer.
4. Counts of phrases and of their parts meet in joins; keys that many rows share are looked up by broadcast.

What a task holds is a few blocks and one broadcast, however much text it reads; the driver holds one broadcast. More words or candidates mean more passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossmarket.llm.common import Scratch, bounded_batches, dense_numbers, reachable, shared_lookup

BITS = 6
FAN = 1 << BITS
ROWS = 1 << 15  # of one batch to Spark
BLOCK_BYTES = 16 << 20  # of a row group of blocks; a block has some megabytes
PIECE_ENDS = re.compile(r"[.,;:!?\x0A-\x0D]")


class Trie:
    """A double array over the digits of word numbers: state s goes to base[s] + digit if check there is s.

    All phrases have one length. `accept` gives a final state's phrase.
    """

    def __init__(self, phrases: np.ndarray, digits: int):
        n, self.words = phrases.shape
        self.shifts = [BITS * d for d in reversed(range(digits))]
        labels = np.concatenate([(phrases[:, [w]] >> s) & (FAN - 1) for w in range(self.words) for s in self.shifts], axis=1)
        node, nodes, parents, edges = np.zeros(n, np.int64), 1, [], []
        for d in range(labels.shape[1]):
            keys, place = np.unique(node * FAN + labels[:, d], return_inverse=True)
            parents.append(keys // FAN)
            edges.append(keys % FAN)
            node, nodes = nodes + place, nodes + len(keys)
        parent, edge = np.concatenate(parents), np.concatenate(edges)  # of nodes 1, 2, ...; parents never descend
        bases, size = _placed(parent, edge, nodes)
        slot = np.zeros(nodes, np.int64)
        slot[1:] = bases[parent] + edge
        self.base, self.check, self.accept = (np.full(size + FAN, fill, np.int32) for fill in (0, -1, -1))
        self.base[slot] = bases
        self.check[slot[1:]] = slot[parent]
        self.accept[slot[node]] = np.arange(n)

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase begins, and which; `words` are numbers, -1 between sequences."""
        padded = np.concatenate([words, np.full(self.words, -1, words.dtype)])
        at = np.flatnonzero(words >= 0)
        state = np.zeros(len(at), np.int32)
        for step in range(self.words):
            word = padded[at + step]
            going = word >= 0
            at, state, word = at[going], state[going], word[going]
            for shift in self.shifts:
                ahead = self.base[state] + ((word >> shift) & (FAN - 1))
                going = self.check[ahead] == state
                at, state, word = at[going], ahead[going], word[going]
        return at, self.accept[state]


def _placed(parent: np.ndarray, edge: np.ndarray, nodes: int) -> tuple[np.ndarray, int]:
    """A base for every inner node such that no two nodes share a slot, and the slots needed. Slots below FAN stay empty.

    Wide nodes get rows of their own; the others try places at random, wider ones first, among the free
    slots, all at once; nodes with one child fill what is left.
    """
    first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
    owner, size = parent[first], np.diff(np.r_[first, len(parent)])
    bases = np.zeros(nodes, np.int64)
    wide = size >= FAN // 4
    bases[owner[wide]] = FAN * (1 + np.arange(wide.sum()))
    middle = np.flatnonzero((size > 1) & ~wide)
    middle = middle[np.argsort(-size[middle], kind="stable")]
    length = FAN * (2 + int(wide.sum())) + 3 * int(size[middle].sum())
    used = np.zeros(length, bool)
    used[:FAN] = True

    def children(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.cumsum(size[groups]) - size[groups]
        return np.repeat(first[groups] - offsets, size[groups]) + np.arange(size[groups].sum()), offsets

    inside, _ = children(np.flatnonzero(wide))
    used[bases[parent[inside]] + edge[inside]] = True
    chance = np.random.default_rng(0)
    while len(middle):
        inside, offsets = children(middle)
        tried = chance.integers(FAN, len(used) - FAN + 1, len(middle))
        slots = np.repeat(tried, size[middle]) + edge[inside]
        good = np.zeros(len(slots), bool)
        good[np.unique(slots, return_index=True)[1]] = True
        settled = np.logical_and.reduceat(good & ~used[slots], offsets)
        bases[owner[middle[settled]]] = tried[settled]
        used[slots[np.repeat(settled, size[middle])]] = True
        if settled.mean() < 0.3:
            used = np.concatenate([used, np.zeros(2 * len(slots) + FAN, bool)])
        middle = middle[~settled]
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~used)[:len(single)]
    slots = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
    bases[owner[single]] = slots - edge[first[single]]
    return bases, max(len(used), len(used) + len(single) - len(free))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _blocks(rows: DataFrame, block_words: int) -> DataFrame:
    """Blocks of one language: word numbers of the block (-1 between pieces), its words, and their counts."""
    def number(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list]] = {}
        words = 0

        def flush():
            for lang, (numbers, texts) in held.items():
                ids = np.concatenate(texts)
                ids = ids[ids != 1] - 2  # what was 0, the end of a piece, is -2
                names = list(numbers)[2:]
                counts = np.bincount(ids[ids >= 0], minlength=len(names)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([np.maximum(ids, -1).tobytes()], pa.binary()),
                     pa.array(["\n".join(names).encode()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
                     pa.nulls(1, pa.binary())], ["lang", "ids", "words", "counts", "numbers"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                text = text.lower() if text.isascii() else text.encode().lower().decode()
                tokens = PIECE_ENDS.sub(" \n ", text).replace("\t", " ").split(" ")
                if lang not in held:
                    held[lang] = _Numbers({"\n": 0, "": 1}), []
                numbers, texts = held[lang]
                texts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                texts.append(np.zeros(1, np.int32))
                words += len(tokens)
                if words >= block_words:
                    yield from flush()
                    held, words = {}, 0
        yield from flush()

    return rows.mapInArrow(number, "lang string, ids binary, words binary, counts binary, numbers binary")


def _word_rows(blocks: DataFrame) -> DataFrame:
    """The words of every block with their counts there."""
    def listed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int32).astype(np.int64)
                names = batch.column("words")[i].as_py().decode().split("\n")[:len(counts)]
                for low in range(0, len(names), ROWS):
                    part = names[low:low + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                         pa.array(counts[low:low + ROWS])], ["lang", "word", "n"])

    return blocks.select("lang", "words", "counts").mapInArrow(listed, "lang string, word string, n bigint")


def _renumbered(blocks: DataFrame, sent, last: bool) -> DataFrame:
    """Blocks whose words take over the numbers of one broadcast; the last one gives them as arrays of these numbers.

    Words that stand alone between others without a number are left out of the arrays.
    """
    def renumber(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                known, words = sent.value.get(lang, {}), batch.column("words")[i].as_py()
                names = words.decode().split("\n") if words else []
                found = np.fromiter(map(known.get, names, repeat(-1)), np.int32, len(names))
                if (before := batch.column("numbers")[i].as_py()) is not None:
                    found = np.where(found < 0, np.frombuffer(before, np.int32), found)
                one = {"lang": batch.column("lang").slice(i, 1), "ids": batch.column("ids").slice(i, 1),
                       "words": batch.column("words").slice(i, 1), "numbers": pa.array([found.tobytes()], pa.binary())}
                if last:
                    table = np.append(found, np.int32(-1))  # its last entry is for the ends of pieces
                    ids = table[np.frombuffer(one["ids"][0].as_py(), np.int32)]
                    apart = np.concatenate([[-1], ids, [-1]]) < 0
                    kept = ~(apart[1:-1] & apart[2:]) & ~(apart[:-2] & apart[2:])
                    one = {"lang": one["lang"], "ids": pa.array([ids[kept].tobytes()], pa.binary()), "state": pa.nulls(1, pa.binary())}
                yield pa.RecordBatch.from_arrays(list(one.values()), list(one))

    rows = blocks.select("lang", "ids", "words", "numbers")
    return rows.mapInArrow(renumber, "lang string, ids binary, " + ("state binary" if last else "words binary, numbers binary"))


def _pass(blocks: DataFrame, sent, offset: int, digits: int, longer: bool, last: bool, most: int = 1_000_000) -> DataFrame:
    """One trie over all blocks. Rows of three kinds: counts per phrase number; if `last`, sequences one word
    longer with their counts in some of the blocks; if not, the blocks with what begins where so far.

    Without a trie (`sent` is None) every frequent word is a phrase, its own number.
    """
    columns = ["lang", "ids", "state", "number", "phrase", "n"]

    def row_batch(rows: int, /, **given) -> pa.RecordBatch:
        kinds = {"lang": pa.string(), "ids": pa.binary(), "state": pa.binary(), "number": pa.int64(), "phrase": pa.binary(),
                 "n": pa.int64()}
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(rows, kinds[c])) for c in columns], columns)

    def scan(batches) -> Iterator[pa.RecordBatch]:
        trie = None if sent is None else sent.value
        size = 1 if trie is None else trie.words
        seen = None if trie is None else np.zeros(int(trie.accept.max()) + 1, np.int64)
        found: dict[str, list] = {}
        held = 0

        def merged(pairs: list) -> tuple[np.ndarray, np.ndarray]:
            phrases = np.concatenate([p for p, _ in pairs])
            unique, place = np.unique(phrases, return_inverse=True)
            return unique, np.bincount(place, np.concatenate([c for _, c in pairs]), len(unique)).astype(np.int64)

        def emitted():
            for lang, pairs in found.items():
                phrases, counts = merged(pairs)
                for low in range(0, len(phrases), ROWS):
                    part = phrases[low:low + ROWS]
                    n = len(part)
                    raw = pa.Array.from_buffers(pa.binary(4 * size + 4), n, [None, pa.py_buffer(part.tobytes())])
                    yield row_batch(n, lang=pa.array([lang] * n, pa.string()), phrase=raw.cast(pa.binary()),
                                    n=pa.array(counts[low:low + n]))

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int32)
                state = batch.column("state")[i].as_py()
                if trie is None:
                    state = ids
                else:
                    at, which = trie.matches(ids)
                    seen += np.bincount(which, minlength=len(seen))
                    state = np.full(len(ids), -1, np.int32) if state is None else np.frombuffer(state, np.int32).copy()
                    state[at] = which + offset
                if not last:
                    yield row_batch(1, lang=batch.column("lang").slice(i, 1), ids=batch.column("ids").slice(i, 1),
                                    state=pa.array([state.tobytes()], pa.binary()))
                elif longer and len(ids) > size:
                    at = np.flatnonzero((state[:-1] >= 0) & (state[1:] >= 0))
                    at = at[at < len(ids) - size]
                    keys = (state[at].astype(np.int64) << 32) | ids[at + size]
                    _, place, counts = np.unique(keys, return_index=True, return_counts=True)
                    at = at[place]
                    words = np.stack([ids[at + k] for k in range(size + 1)], axis=1).astype(">i4")
                    phrases = np.ascontiguousarray(words).view(f"V{4 * size + 4}").ravel()
                    lang = batch.column("lang")[i].as_py()
                    found.setdefault(lang, []).append((phrases, counts))
                    held += len(phrases)
                    if held > most:
                        found = {lang: [merged(pairs)] for lang, pairs in found.items()}
                        held = sum(len(p) for pairs in found.values() for p, _ in pairs)
                        if held > most // 2:
                            yield from emitted()
                            found, held = {}, 0
        yield from emitted()
        if seen is not None:
            at = np.flatnonzero(seen)
            yield row_batch(len(at), number=pa.array(at + offset), n=pa.array(seen[at]))

    return blocks.mapInArrow(scan, "lang string, ids binary, state binary, number bigint, phrase binary, n bigint")


def phrase_counts(docs: DataFrame, min_count: int = 100, most_words: int = 5, lang_col: str = "lang", text_col: str = "text",
                  block_words: int = 1 << 20, part_size: int = 250_000,
                  words_size: int = 500_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: counts of the phrases of 1 to `most_words` words that reach `min_count` (lang, phrase as big-endian word
    numbers, length, a), the words (lang, word, number, n), and all word occurrences of each language (lang, n)."""
    spark = docs.sparkSession
    reachable(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    blocks, path = scratch.write(_blocks(rows, block_words), BLOCK_BYTES)
    counted = scratch.cut(_word_rows(blocks).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = scratch.cut(dense_numbers(counted.where(F.col("n") >= min_count), scratch))
    many = frequent.count()
    digits = max(1, -(-max(many - 1, 1).bit_length() // BITS))
    for offset in range(0, max(many, 1), words_size):
        part = frequent.where(F.col("number").between(offset, offset + words_size - 1)).select("lang", "word", "number").toArrow()
        numbers: dict[str, dict[str, int]] = {}
        for lang, word, number in zip(*(part.column(c).to_pylist() for c in ("lang", "word", "number"))):  # at most words_size
            numbers.setdefault(lang, {})[word] = number
        last, done = offset + words_size >= many, path
        blocks, path = scratch.write(_renumbered(blocks, spark.sparkContext.broadcast(numbers), last), BLOCK_BYTES)
        scratch.drop(done)
    blocks_path = path
    number_bytes = F.unhex(F.lpad(F.hex("number"), 8, "0"))
    known = frequent.select("lang", number_bytes.alias("phrase"), F.lit(1).alias("length"), F.col("n").alias("a"))
    found = _pass(blocks, None, 0, digits, most_words > 1, True)  # read once
    for length in range(2, most_words + 1):
        candidates = found.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("reported"))
        candidates = dense_numbers(candidates.where(F.col("reported") >= min_count).select("lang", "phrase"), scratch)
        total = candidates.count()
        if not total:
            break
        state, tables = blocks, []
        for offset in range(0, total, part_size):
            part = candidates.where(F.col("number").between(offset, offset + part_size - 1)).orderBy("number")
            phrases = part.select("phrase").toArrow().column("phrase").to_pylist()  # at most part_size
            matrix = np.frombuffer(b"".join(phrases), ">i4").reshape(-1, length).astype(np.int64)
            sent = spark.sparkContext.broadcast(Trie(matrix, digits))
            last = offset + part_size >= total
            passed = _pass(state, sent, offset, digits, length < most_words, last)
            table, path = scratch.write(passed, None if last else BLOCK_BYTES)
            tables.append(path)
            state = table.where("ids IS NOT NULL").select("lang", "ids", "state")
        found = spark.read.parquet(*tables)
        sums = found.where("number IS NOT NULL").groupBy("number").agg(F.sum("n").alias("a"))
        counts = scratch.cut(candidates.join(sums, "number").where(F.col("a") >= min_count)
                             .select("lang", "phrase", F.lit(length).alias("length"), "a"))
        known = known.unionByName(counts)
    scratch.drop(blocks_path)
    return scratch.cut(known), frequent, totals


def collocations(docs: DataFrame, min_count: int = 100, most_words: int = 5, inside_percent: int = 100, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text", **sizes: int) -> DataFrame:
    """Each language's `top` phrases by the score of their lowest-scoring cut.

    Words are what stands between spaces and tabs in pieces ended by .,;:!? and line ends, A-Z lower-cased. A phrase of 2 to
    `most_words` words occurs a times, its first k words l and its other words r times, all words of the language n times;
    the cut's score is floor(1000 a n / (l r)), in exact decimals. The lowest score counts, the smallest k among
    equals. Phrases inside a longer one that occurs at least `inside_percent` percent as often are left out. Order: score, then a,
    both descending, then the bytes of the phrase. A missing language is `und`, a missing text has no words, repeated rows count
    again, and an empty table gives an empty result. Other columns are not read.
    """
    known, words, totals = phrase_counts(docs, min_count, most_words, lang_col, text_col, **sizes)
    scratch, phrases = Scratch(docs.sparkSession, "collocations"), known.where("length > 1")
    sub = lambda start, size: F.substring(F.col("phrase"), start * 4 + 1, size * 4)
    starts = lambda size: F.sequence(F.lit(0), F.col("length") - size)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda size: F.transform(
        starts(size), lambda start: sub(start, size))))
    longer = (phrases.where("length > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longest")))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * inside_percent)
    ).drop("longest")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.withColumn("head", sub(F.lit(0), F.col("k"))).withColumn("tail", sub(F.col("k"), F.col("length") - F.col("k")))
    count_of = lambda key, name: known.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))
    cuts = shared_lookup(cuts, count_of("head", "l"), ["lang", "head"], scratch)
    cuts = shared_lookup(cuts, count_of("tail", "r"), ["lang", "tail"], scratch)
    cuts = shared_lookup(cuts, totals, ["lang"], scratch)
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(16,0))) div "
                   "(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = (cuts.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase", "length", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
              .select("lang", "phrase", "length", "a", "n", "best.score", "best.l", "best.r"))
    rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = scored.withColumn("_rank", F.rank().over(rank)).where(F.col("_rank") <= top).drop("_rank")  # with all ties
    pieces = near.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).withColumn(
        "number", F.conv(F.hex(sub(F.col("_at"), F.lit(1))), 16, 10).cast("bigint"))
    named = shared_lookup(pieces, words.select("number", "word"), ["number"], scratch)
    texts = named.groupBy("lang", "phrase", "a", "l", "r", "n", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda s: s["word"]), " ").alias("text"))
    exact = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    return (texts.withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
    grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
              FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
                    FROM split, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)),
    f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
    candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 100),
    longer AS (
      SELECT lang, array_to_string(w[i:i + inner_size - 1], ' ') AS phrase, max(a) AS longest
      FROM (SELECT *, unnest(range(1, size - inner_size + 2)) AS i
            FROM (SELECT *, unnest(range(2, size)) AS inner_size FROM candidates)) GROUP BY ALL),
    cuts AS (
      SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
      FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
      LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR longest < c.a),
    scored AS (
      SELECT cuts.lang, cuts.phrase, cuts.a, h.a AS l, t.a AS r, n,
             CAST((1000::HUGEINT * cuts.a * n) // (h.a::HUGEINT * t.a) AS BIGINT) AS score, k
      FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.tail
      JOIN totals ON totals.lang = cuts.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM lowest
    WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000"""
