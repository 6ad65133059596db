"""Near-duplicate groups by MinHash: universal hash minima, banding, signature and set verification, components.

1. Every text becomes the set of its word shingles (64-bit hashes). Texts with equal sets form one class;
   from here on each class is compared once, however many copies it has.
2. A class has `bands * rows` minima under multiply-shift hash functions. Classes that agree on all minima
   of a band share a bucket. There are as many bands as it takes that a pair at the threshold misses every
   bucket with probability under 2e-6: (1 - 0.85^6)^28 at 0.85, (1 - 0.8^6)^44 at 0.8.
3. Every class is compared with the first class of each of its buckets. Buckets whose members then still
   belong to different components are compared further, in blocks of bounded size: what is outside the
   component of the bucket's first class, against all of the bucket, leaving out pairs already connected
   and pairs that an earlier band of theirs brings together.
4. Pairs whose signatures agree well enough are confirmed on the full sets, in step 3 inside the block, so
   that only confirmed links between parts not yet connected leave it. Components come from alternating
   large-star and small-star steps over the confirmed links.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmarket.llm.common import Scratch, id_type, keeps, keyed
from crossmarket.llm.encoders import slices

_MIX = np.random.default_rng(20_240_607).integers(1, 2**63, 64, np.uint64) | np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words, kept in the worker between texts up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes of runs of `size` words (A-Z lower-cased, split at ASCII white space);
    of a shorter text the whole sequence; of an empty one nothing."""
    words = text.encode().lower().split()
    hashes = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    if not width:
        return hashes
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed += hashes[i:len(words) - width + 1 + i] * _MIX[i]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[63]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def minima(sets: list[np.ndarray], hashes: int, seed: int) -> np.ndarray:
    """One row per set (none may be empty): its minimum under each multiply-shift hash function."""
    random = np.random.default_rng(seed)
    factor = random.integers(1, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    offset = random.integers(0, 2**63, hashes, np.uint64)
    result = np.empty((len(sets), hashes), np.uint32)
    low = 0
    while low < len(sets):
        high, size = low, 0
        while high < len(sets) and (size == 0 or size + len(sets[high]) <= 32_768):  # stay in the cache
            size += len(sets[high])
            high += 1
        flat = np.concatenate(sets[low:high])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[low:high]])[:-1]]).astype(np.int64)
        work = np.empty_like(flat)
        for k in range(hashes):
            np.multiply(flat, factor[k], out=work)
            work += offset[k]
            work >>= np.uint64(32)
            result[low:high, k] = np.minimum.reduceat(work, starts)
        low = high
    return result


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64) * _MIX[8]
        for r in range(rows):
            key = (key ^ signature[:, b * rows + r].astype(np.uint64)) * _MIX[9 + r]
            key ^= key >> np.uint64(31)
        keys[:, b] = key
    return keys.view(np.int64)


def signatures(rows: DataFrame, shingle: int, bands: int, per_band: int, seed: int) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, set_key, buckets, and the low byte of every minimum."""

    def sign(batches):
        keeps("near_dup", _hashes.cache_clear)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in slices(texts):
                sets = [shingle_set(text, shingle) for text in texts[low:high]]
                full = [i for i, s in enumerate(sets) if len(s)]
                signature = minima([sets[i] for i in full], bands * per_band, seed)
                keys, short = _band_keys(signature, bands, per_band), signature.astype(np.uint8)
                buckets, sigs = [None] * len(sets), [None] * len(sets)
                for at, i in enumerate(full):
                    buckets[i], sigs[i] = keys[at], short[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), batch.column("text_key").slice(low, high - low),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                              pa.binary()),
                     pa.array(buckets, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_key", "buckets", "signature"])

    return rows.mapInArrow(sign, f"doc_id {id_type(rows)}, text_key binary, n_shingles bigint, set_key binary, "
                                 "buckets array<bigint>, signature binary")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in `edges` (a, b), the root being the smallest node reachable.

    Large-star hangs every larger neighbour of a node on the smallest one, small-star every smaller
    neighbour; both find minima by pre-aggregated sums and joins, so a node with very many links is
    never gathered. Ends when a round changes nothing.
    """
    pairs, path = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                                             F.least("a", "b").alias("v")).distinct())

    def mark(df):
        return df.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)),
                      F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()

    before = mark(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large, large_path = scratch.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        small, small_path = scratch.write(small)
        scratch.drop(large_path)
        scratch.drop(path)
        pairs, path, now = small, small_path, mark(small)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _texts(keys: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(set_key, text) of the classes whose set_key is in `keys`."""
    wanted = classes.select("set_key", "text_key").join(keys, "set_key", "left_semi")
    return rows.join(wanted, "text_key").groupBy("set_key").agg(F.first("text").alias("text"))


def _meet(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose full sets meet the threshold."""
    ends = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    texts = _texts(ends, classes, rows)

    def check(batches):
        keeps("near_dup", _hashes.cache_clear)
        last, kept = None, None
        for batch in batches:
            left, text = batch.column("a").to_pylist(), batch.column("text_a")
            found = []
            for i, other in enumerate(batch.column("text_b")):
                if left[i] != last:
                    last, kept = left[i], shingle_set(text[i].as_py(), shingle)
                found.append(_meet(kept, shingle_set(other.as_py(), shingle), percent))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    first = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    return (pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(check, "a binary, b binary"))


def _similar_signatures(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree in a share no less than six standard deviations below the threshold."""
    side = classes.select("set_key", "signature", "n_shingles")
    joined = (pairs.join(side.toDF("a", "sig_a", "n_a"), "a").join(side.toDF("b", "sig_b", "n_b"), "b")
              .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
              .select("a", "b", "sig_a", "sig_b"))

    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (_matrix(batch.column(c)) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(1) >= _floor(left.shape[1], percent)))

    return joined.mapInArrow(agree, "a binary, b binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _floor(minima_count: int, percent: int) -> float:
    share = percent / 100
    return share - 6 * (share * (1 - share) / minima_count) ** 0.5


def _rest_of_buckets(members: DataFrame, components_now: DataFrame, classes: DataFrame, rows: DataFrame,
                     shingle: int, percent: int, block: int, scratch: Scratch) -> DataFrame:
    """Confirmed links inside buckets that the first round left open: different components, neither the first class."""
    placed = (members.join(components_now, members.set_key == components_now.node, "left")
              .select("bucket", "leader", "set_key", F.coalesce("root", "set_key").alias("root")))
    leaders = (members.select(F.col("leader").alias("_l")).distinct()
               .join(components_now, F.col("_l") == F.col("node"), "left")
               .select(F.col("_l").alias("leader"), F.coalesce("root", "_l").alias("main")))
    placed = placed.join(leaders, "leader").where("set_key <> leader")
    open_buckets = (placed.groupBy("bucket").agg(F.count("*").alias("m"),
                                                 F.sum((F.col("root") != F.col("main")).cast("bigint")).alias("rest"),
                                                 F.min("root").alias("low"), F.max("root").alias("high"))
                    .where("rest > 0 and m > 1 and low <> high")
                    .select("bucket", F.ceil(F.col("m") / block).cast("int").alias("all_parts"),
                            F.ceil(F.col("rest") / block).cast("int").alias("rest_parts")))
    placed = scratch.cut(placed.join(open_buckets, "bucket"))

    def to_sets(batches):
        keeps("near_dup", _hashes.cache_clear)
        for batch in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(sets, pa.binary())], ["set_key", "hashes"])

    sets = _texts(placed.select("set_key").distinct(), classes, rows).mapInArrow(to_sets, "set_key binary, hashes binary")
    placed = (placed.join(classes.select("set_key", "signature", "buckets"), "set_key").join(sets, "set_key"))
    part = F.pmod(F.xxhash64("set_key"), F.lit(1 << 30))
    schema = ["bucket", "i", "j", "set_key", "root", "signature", "buckets", "hashes"]
    rest = (placed.where("root <> main").withColumn("i", (part % F.col("rest_parts")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1))).select(schema))
    everything = (placed.withColumn("j", (part % F.col("all_parts")).cast("int"))
                  .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1))).select(schema))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            one, two = (_matrix(t.column("signature").combine_chunks()) for t in (left, right))
            keys, roots, sets, bands = ([t.column(c).to_pylist() for t in (left, right)]
                                        for c in ("set_key", "root", "hashes", "buckets"))
            here = left.column("bucket")[0].as_py()
            band = bands[0][0].index(here)
            bands = [np.array(x) for x in bands]
            sets = [[np.frombuffer(x, np.uint64) for x in side] for side in sets]
            sizes = np.array([len(x) for x in sets[1]])
            part_of = {root: root for root in (*roots[0], *roots[1])}
            floor = _floor(one.shape[1], percent)

            def top(root):
                while part_of[root] != root:
                    root = part_of[root]
                return root

            for i, sig in enumerate(one):
                n = len(sets[0][i])
                fits = ((100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                        & ((bands[1] == bands[0][i]).argmax(1) == band))
                at = np.flatnonzero(fits)
                for j in at[(two[at] == sig).mean(1) >= floor] if len(at) else ():
                    mine, other = top(roots[0][i]), top(roots[1][j])
                    if mine != other and _meet(sets[0][i], sets[1][j], percent):
                        part_of[mine] = other
                        a.append(keys[0][i])
                        b.append(keys[1][j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    rest, everything = rest.toDF(*schema), everything.toDF(*schema)  # columns of their own
    return (rest.groupBy("bucket", "i", "j").cogroup(everything.groupBy("bucket", "i", "j"))
            .applyInArrow(compare, "a binary, b binary"))


def bands_for(percent: int, per_band: int, missed: float = 2e-6) -> int:
    """Bands with which a pair at the threshold shares no bucket with a probability under `missed`."""
    same = (percent / 100) ** per_band
    return 1 if same >= 1 else math.ceil(math.log(missed) / math.log1p(-same))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int | None = None, per_band: int = 6,
                    seed: int = 11, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. Missing, empty
    and blank texts have no shingles, are linked with nothing and kept. Rows that repeat an id are one
    document if their texts are linked and share its component; a row without an id can join a component
    but never names it, and stays as it is if nothing it is linked with has an id.
    """
    spark = docs.sparkSession
    bands = bands or bands_for(percent, per_band)
    scratch = Scratch(spark, "near-dup")
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_key"))
    signed = scratch.cut(signatures(rows, shingle, bands, per_band, seed))
    classes = scratch.cut(
        signed.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"),
             F.first("buckets").alias("buckets"), F.first("signature").alias("signature")))
    spread = classes.select("set_key", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("set_key").alias("leader"), F.count("*").alias("m")).where("m > 1")
    members = scratch.cut(spread.join(shared.select("bucket", "leader"), "bucket"))
    texts = rows.select("text_key", "text")

    pairs = members.where("set_key <> leader").select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
    pairs = scratch.cut(_similar_signatures(pairs, classes, percent))
    edges = scratch.cut(_confirmed(pairs, classes, texts, shingle, percent))
    rooted = components(edges, scratch)
    more = scratch.cut(_rest_of_buckets(members, rooted, classes, texts, shingle, percent, block, scratch))
    if not more.isEmpty():
        rooted = components(edges.unionByName(more), scratch)
    rooted = rooted.select(F.col("node").alias("set_key"), "root")
    named = classes.select("set_key", "doc_id").join(rooted, "set_key", "left").select(
        "set_key", "doc_id", F.coalesce("root", "set_key").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "root").select("set_key", "component_id")
    return (signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
