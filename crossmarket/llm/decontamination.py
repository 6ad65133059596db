"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over item-sized windows, shared grams, edit verification.

Texts are normalized to lower-case words between single spaces, ASCII punctuation being white space. Every
item names a few of its longer words as anchors. A window starts wherever a document has an anchor word
and is as long as an item is from its anchor on. The CGK random walk turns edit distance between two
such strings into Hamming distance, and sampled coordinates of several independent walks are the
keys of hash tables. Windows that share a key with an item, and agree with it in over a third of the embedded
coordinates behind the anchor, are candidates; for each the exact edit distance of the whole item to
the best place around the window decides.

An anchor that is edited starts no window, and an agreeing table becomes rare beyond a tenth of edited characters.
So documents are also searched for what an item shares with any place: grams of six bytes, counted in bands of
neighbouring diagonals. Where they reach the number that survives random edits at the accepted rate (its mean
less one standard deviation), the exact edit distance decides as well. This needs neither words nor spaces.

Recall is measured in the tests: of the copies with 15, 18 and 20 % of their characters edited that lie within
the accepted distance, at least 98 % are found. Edits may be placed so that fewer grams survive; that is not excluded.

Documents are scanned where they lie; nothing is shuffled. The index is built for blocks of items of
bounded size, each block being broadcast and held against all documents in turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crossmarket.llm.common import id_type, keeps, keyed, reachable

_PUNCTUATION = bytes(c if not 33 <= c < 127 or chr(c).isalnum() else 32 for c in range(256))
ANCHORS, WALKS, TABLES, COORDINATES = 8, 4, 8, 6
AGREEMENT = 0.35
LADDER = 1.25
GRAM, BAND, SPREAD = 6, 4, 1.0  # bytes of a gram, bits of a band's width, standard deviations below the mean


def normal_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


def best_edit_distance(pattern: bytes, places: dict[int, int], text: bytes, limit: int | None = None) -> int:
    """The least edit distance of the pattern to any substring of the text (bit-parallel, exact).

    `places` has, for each byte of the pattern, the bits of the positions that hold it. A byte lowers the distance by one
    at most, so the text is left where the rest of it cannot improve the result; of a distance above `limit` nothing is
    told but that it is above.
    """
    full = (1 << len(pattern)) - 1
    high = 1 << (len(pattern) - 1)
    rises, falls, now = full, 0, len(pattern)
    best = now
    useful = now if limit is None else min(now, limit + 1)  # only what is below changes the result
    for left, c in zip(range(len(text) - 1, -1, -1), text):
        equal = places.get(c, 0)
        vertical = equal | falls
        horizontal = (((equal & rises) + rises) ^ rises) | equal
        up = falls | (full & ~(horizontal | rises))
        down = rises & horizontal
        if up & high:
            now += 1
        elif down & high:
            now -= 1
            if now < best:
                best = now
                useful = min(useful, now)
        if now - left >= useful:
            break
        up, down = (up << 1) & full, (down << 1) & full
        rises, falls = down | (full & ~(vertical | up)), up & vertical
    return best


@dataclass
class Index:
    """Anchors, LSH tables and normalized texts of one block of items."""

    ids: list
    texts: list[bytes]
    allowed: list[int]
    anchors: dict[bytes, set[int]] = field(default_factory=dict)  # with the classes of their entries
    classes: list[int] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    owners: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # entry of each key
    entries: np.ndarray = field(default_factory=lambda: np.empty((0, 4), np.int64))  # item, offset, anchor, class
    paths: list[np.ndarray] = field(default_factory=list)  # embedded entries of each walk (entries x steps)
    width: int = 0
    before: int = 0
    seed: int = 5
    grams: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # distinct, in order
    runs: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where the places of each gram start
    gram_items: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # item and offset of each place
    gram_offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    least: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # shared grams that make a candidate
    slots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # a gram of each mixed code, -1: none
    crowded: np.ndarray = field(default_factory=lambda: np.empty(0, bool))  # mixed codes of several grams

    def walks(self):
        """Random bits for each walk, step and byte, and the sampled steps of each class and table."""
        random = np.random.default_rng(self.seed)
        steps = max(1, int(1.6 * self.width))
        bits = random.integers(0, 2, (WALKS, steps, 256), np.uint8)
        sampled = {n: random.integers(0, max(1, int(1.6 * n)), (WALKS, TABLES, COORDINATES)) for n in self.classes}
        return bits, sampled


def embed(windows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The CGK embedding (steps x windows): read a byte, then stay or move on as the random bit says."""
    count, width = windows.shape
    out = np.empty((len(bits), count), np.uint8)
    flat, at, stop = windows.ravel(), np.arange(count) * width, np.arange(1, count + 1) * width - 1
    for read, chances in zip(out, bits):
        flat.take(at, out=read, mode="clip")  # never outside; checked reads would be copied
        at += chances.take(read)
        np.minimum(at, stop, out=at)
    return out


def _table_keys(paths: list[np.ndarray], steps: np.ndarray, number: int) -> np.ndarray:
    """Keys (windows x tables) of class `number`, which is part of the key, as is the table."""
    keys = np.empty((paths[0].shape[1], WALKS * TABLES), np.uint64)
    for w, path in enumerate(paths):
        for t in range(TABLES):
            key = np.full(len(keys), (number << 8) + w * TABLES + t, np.uint64)
            for step in steps[w, t]:
                key = (key << np.uint64(8)) | path[step].astype(np.uint64)
            keys[:, w * TABLES + t] = key
    return keys


def _padded(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def gram_codes(text: bytes) -> np.ndarray:
    """The code of the gram at each byte."""
    read = np.frombuffer(text, np.uint8).astype(np.uint64)
    codes = np.zeros(max(0, len(read) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        codes = (codes << np.uint64(8)) | read[i:i + len(codes)]
    return codes


def mixed(codes: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of the codes times an odd number: places in a table of 2^bits."""
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def least_shared(length: int, allowed: int, rate: float) -> int:
    """Grams that survive when `rate` of an item's bytes are edited at random: their mean less SPREAD deviations."""
    n = length - GRAM + 1
    if not allowed or n < 2:
        return max(n, 1)
    p = (1 - rate) ** GRAM
    spread = p * (1 - p) + 2 * sum((1 - rate) ** (GRAM + j) - p * p for j in range(1, GRAM))
    return max(2, int(n * p - SPREAD * (n * spread) ** 0.5))


def _add_grams(index: Index, rate: float) -> None:
    codes = [gram_codes(t) for t in index.texts]
    joined = np.concatenate(codes or [np.empty(0, np.uint64)])
    order = np.argsort(joined, kind="stable")
    lengths = [len(c) for c in codes]
    index.gram_items = np.repeat(np.arange(len(codes), dtype=np.int32), lengths)[order]
    index.gram_offsets = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths] or [np.empty(0, np.int32)])[order]
    index.grams, first = np.unique(joined[order], return_index=True)
    index.runs = np.append(first, len(joined))
    bits = max(16, len(index.grams).bit_length() + 3)
    places = mixed(index.grams, bits)
    index.slots = np.full(1 << bits, -1, np.int32)
    index.slots[places] = np.arange(len(places))
    index.crowded = np.bincount(places, minlength=1 << bits) > 1
    index.least = np.array([least_shared(len(t), a, rate) for t, a in zip(index.texts, index.allowed)], np.int64)


def build_index(items: list[tuple], rate: float) -> Index:
    """The index of (id, text) items; items without a word are left out, those under 25 characters must be exact."""
    found = [(i, normal_words(text)) for i, text in items if text]
    found = [(i, words) for i, words in found if words]
    index = Index([i for i, _ in found], [b" ".join(w) for _, w in found], [])
    index.allowed = [int(rate * len(t)) if len(t) >= 25 else 0 for t in index.texts]
    _add_grams(index, rate)
    starts, owners, offsets, names, before = [], [], [], [], 0
    for number, (_, words) in enumerate(found):
        at, places = 0, []
        for word in words:
            places.append(at)
            at += len(word) + 1
        near = [k for k in range(len(words)) if places[k] <= 0.6 * (at - 1)]
        for taken, k in enumerate(sorted(near, key=lambda k: (-len(words[k]), k))[:ANCHORS]):
            if taken >= 3 and len(words[k]) < 5:
                break  # short words stand everywhere; they serve only items that have few others
            names.append(words[k])
            starts.append(index.texts[number][places[k]:])
            owners.append(number)
            offsets.append(places[k])
        before = max(before, len(words))
    index.before = before
    if not starts:
        return index
    rung = [int(np.log(max(1, len(s))) / np.log(LADDER)) for s in starts]
    ladder = sorted(set(rung))
    index.classes = [max(1, int(LADDER ** r)) for r in ladder]
    index.width = max(len(s) for s in starts)
    bits, sampled = index.walks()
    paths = [embed(_padded(starts, index.width), b) for b in bits]
    of = np.array([ladder.index(r) for r in rung])
    for name, number in zip(names, of.tolist()):
        index.anchors.setdefault(name, set()).add(number)
    keys, entry = [], []
    for number, n in enumerate(index.classes):
        mine = np.flatnonzero(of == number)
        keys.append(_table_keys([p[:, mine] for p in paths], sampled[n], number).ravel())
        entry.append(np.repeat(mine, WALKS * TABLES))
    keys, entry = np.concatenate(keys), np.concatenate(entry)
    order = np.argsort(keys, kind="stable")
    index.keys, index.owners = keys[order], entry[order]
    index.entries = np.column_stack([owners, offsets, [len(n) for n in names], of])
    index.paths = [np.ascontiguousarray(p.T) for p in paths]
    return index


class Scanner:
    """Matches of one index in texts; made once per task."""

    def __init__(self, index: Index, most: int = 16_384):
        self.index, self.most = index, most
        self.bits, self.sampled = index.walks()
        self.places: dict[int, dict[int, int]] = {}
        self.longest = max(map(len, index.texts), default=0)
        # Bytes of text looked at at once: bands times items stay bounded.
        self.step = max(4 * self.longest, min(1 << 15, (1 << 26) // max(1, len(index.texts))))

    def _places(self, item: int) -> dict[int, int]:
        if item not in self.places:
            bits: dict[int, int] = {}
            for i, c in enumerate(self.index.texts[item]):
                bits[c] = bits.get(c, 0) | 1 << i
            self.places[item] = bits
        return self.places[item]

    def scan(self, texts: list[str | None]) -> dict[tuple[int, int], int]:
        """(text number, item number) -> least edit distance, for all matches."""
        index, best = self.index, {}
        windows: list[tuple[int, bytes, int, bytes]] = []
        normal: list[bytes] = []
        for number, text in enumerate(texts):
            words = normal_words(text) if text else []
            normal.append(b" ".join(words))
            anchors = [k for k, word in enumerate(words) if word in index.anchors]
            starts = np.cumsum([0, *map(len, words)])[anchors] + anchors if anchors else []
            for at, start in zip(anchors, starts):
                # From the anchor as far as the longest item goes; what lies before it is for verification.
                windows.append((number, words[at], int(start), normal[-1][start:start + 2 * index.width]))
                if len(windows) >= self.most:
                    self._match(windows, normal, best)
                    windows = []
        self._match(windows, normal, best)
        self._match_grams(normal, best)
        return best

    def _match_grams(self, normal: list[bytes], best) -> None:
        """Matches that share enough grams along neighbouring diagonals, wherever they start."""
        pieces, size = [], 0
        for number, text in enumerate(normal):
            # A match is at most twice as long as its item, so it lies in one piece as a whole.
            for start in range(0, max(1, len(text) - 2 * self.longest), self.step):
                pieces.append((number, text[start:start + self.step + 2 * self.longest]))
                size += len(pieces[-1][1]) + 1
                if size >= self.step:
                    self._match_pieces(pieces, best)
                    pieces, size = [], 0
        self._match_pieces(pieces, best)

    def _known_grams(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the codes are grams of items, and which; only codes that share a slot are searched for."""
        index = self.index
        slot = mixed(codes, len(index.slots).bit_length() - 1)
        gram = index.slots[slot]
        at = np.flatnonzero(gram >= 0)
        gram, slot, codes = gram[at], slot[at], codes[at]
        held = index.grams[gram] == codes
        again = np.flatnonzero(~held & index.crowded[slot])
        other = np.minimum(np.searchsorted(index.grams, codes[again]), len(index.grams) - 1)
        right = index.grams[other] == codes[again]
        gram[again[right]], held[again[right]] = other[right], True
        return at[held], gram[held]

    def _match_pieces(self, pieces: list[tuple[int, bytes]], best) -> None:
        index = self.index
        text = b"\n".join(piece for _, piece in pieces)
        codes = gram_codes(text)
        if not len(codes) or not len(index.grams):
            return
        at, gram = self._known_grams(codes)
        first = index.runs[gram]
        many = index.runs[gram + 1] - first
        place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        bands = ((len(text) + self.longest) >> BAND) + 2
        shared = np.bincount(index.gram_items[place].astype(np.int64) * bands
                             + ((np.repeat(at + self.longest, many) - index.gram_offsets[place]) >> BAND),
                             minlength=bands * len(index.texts))
        # Two neighbouring bands reach an item's least number only where one of them has half of it.
        half = np.flatnonzero(shared.reshape(-1, bands) >= -(-index.least[:, None] // 2))
        both = np.union1d(half[half % bands > 0] - 1, half[half % bands < bands - 1])
        both = both[shared[both] + shared[both + 1] >= index.least[both // bands]]
        items, found = np.divmod(both, bands)
        if not len(items):
            return
        ends = np.cumsum([len(piece) + 1 for _, piece in pieces])
        breaks = np.flatnonzero((np.diff(items) != 0) | (np.diff(found) > 1)) + 1
        firsts, lasts = np.append(0, breaks), np.append(breaks, len(items)) - 1
        for i, low, high in zip(items[firsts].tolist(), found[firsts].tolist(), found[lasts].tolist()):
            pattern, spare = index.texts[i], index.allowed[i]
            low = max(0, (low << BAND) - self.longest - spare)
            high = ((high + 2) << BAND) - self.longest + len(pattern) + spare
            for k in range(np.searchsorted(ends, low, side="right"), len(pieces)):
                owner, piece = pieces[k]
                start = int(ends[k]) - len(piece) - 1
                if start >= high:
                    break
                region = piece[max(0, low - start):high - start]
                if len(region) < len(pattern) - spare or best.get((owner, i)) == 0:
                    continue
                distance = 0 if pattern in region else best_edit_distance(pattern, self._places(i), region, spare)
                if distance <= spare and distance < best.get((owner, i), len(pattern) + 1):
                    best[owner, i] = distance

    def _match(self, windows, normal: list[bytes], best) -> None:
        by_class: dict[int, list[int]] = {}
        for i, (_, anchor, _, _) in enumerate(windows):
            for number in self.index.anchors[anchor]:
                by_class.setdefault(number, []).append(i)
        for number, members in by_class.items():
            self._match_class(number, [windows[i] for i in members], normal, best)

    def _match_class(self, number: int, windows, normal: list[bytes], best) -> None:
        index, n = self.index, self.index.classes[number]
        length = min(self.bits.shape[1], max(1, int(1.6 * n)))
        padded = _padded([front for *_, front in windows], length + 1)
        paths = [embed(padded, b[:length]) for b in self.bits]
        keys = _table_keys(paths, self.sampled[n], number)
        flat = keys.ravel()
        low = np.searchsorted(index.keys, flat)
        hit = np.flatnonzero(index.keys[np.minimum(low, len(index.keys) - 1)] == flat)
        low = low[hit]
        many = np.searchsorted(index.keys, flat[hit], side="right") - low
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.repeat(hit // keys.shape[1], many) * len(index.entries)
                          + index.owners[np.repeat(low, many) + within])
        paths = [np.ascontiguousarray(p.T) for p in paths]
        for window, entry in zip(*(x.tolist() for x in np.divmod(pairs, len(index.entries)))):
            item, offset, anchor, _ = index.entries[entry].tolist()
            owner, _, start, front = windows[window]
            if best.get((owner, item)) == 0:
                continue
            steps = slice(min(2 * anchor, length - 1), length)
            agreed = max(np.count_nonzero(p[window, steps] == q[entry, steps]) for p, q in zip(paths, index.paths))
            if agreed < AGREEMENT * (steps.stop - steps.start):
                continue
            size, spare = len(index.texts[item]), index.allowed[item]
            region = normal[owner][max(0, start - offset - spare - 2):start] + front[:size - offset + spare]
            distance = best_edit_distance(index.texts[item], self._places(item), region, spare)
            if distance <= spare and distance < best.get((owner, item), size + 1):
                best[owner, item] = distance


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, block_bytes: int):
    """An index for each block of about so many bytes of items, whatever their number."""
    items = keyed(benchmark, item_col, text_col).toDF("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield build_index([tuple(r) for r in part.collect()], rate)  # at most about block_bytes


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, block_bytes: int = 500_000,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, edit_distance, similarity.

    An item is contained where its edit distance to some part of the document is at most `rate` of the
    item's normalized length. Missing and empty texts and items contain and match nothing; repeated rows
    each give their rows; an empty table on either side gives no rows.
    """
    rows, spark = keyed(docs, id_col, text_col), docs.sparkSession
    reachable(spark)
    item_field = benchmark.schema[item_col]
    item_arrow = to_arrow_type(item_field.dataType)
    schema = f"doc_id {id_type(rows)}, item_id {item_field.dataType.simpleString()}, edit_distance bigint, similarity double"
    result = None
    for index in _blocks(benchmark, item_col, item_text_col, rate, block_bytes):
        sent = spark.sparkContext.broadcast(index)  # bounded by block_bytes

        def scan(batches, sent=sent):
            keeps("decontamination")
            scanner = Scanner(sent.value)
            for batch in batches:
                found = sorted(scanner.scan(batch.column("text").to_pylist()).items())
                ids = [scanner.index.ids[item] for (_, item), _ in found]
                sizes = [len(scanner.index.texts[item]) for (_, item), _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([row for (row, _), _ in found], pa.int64())),
                     pa.array(ids, item_arrow), pa.array([d for _, d in found], pa.int64()),
                     pa.array([1 - d / n for (_, d), n in zip(found, sizes)], pa.float64())],
                    ["doc_id", "item_id", "edit_distance", "similarity"])

        part = rows.mapInArrow(scan, schema)
        result = part if result is None else result.unionByName(part)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, block_bytes: int = 500_000,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, that contain no item; rows are dropped where they lie."""
    spark = docs.sparkSession
    reachable(spark)
    for index in _blocks(benchmark, item_col, item_text_col, rate, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        def clean(batches, sent=sent):
            keeps("decontamination")
            scanner = Scanner(sent.value)
            for batch in batches:
                dirty = {row for row, _ in scanner.scan(batch.column(text_col).to_pylist())}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
