"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, exact.

Equal sets are one class. Two steps find links between classes, and every link is verified on the whole texts. First the
SimHash fingerprints of the sets are linked by the pigeonring search of :mod:`simhash`. Fingerprints of a pair of that
similarity may differ in more bits than that search can look for, so each class also meets two classes of each of its MinHash
bands, drawn anew for every band; both together join most of a group at a cost linear in its size. Then prefix filtering finds the rest: under
any one order of all shingles, two sets of that similarity share one of the first ``n - ceil(0.8 n) + 1`` of each, and the
first shared one leaves room for enough others. Only classes that the first step hasn't joined meet there, so what it missed
is found and a group of near copies isn't compared pair by pair. Common shingles come last in the order, by how many
documents have them, so documents that share a passage don't meet on it. The counts cover all documents; how many of the
common shingles the table holds decides on cost alone and not on results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import connected_components
from ..session import cut, release, shuffle_width
from .common import no_state, slices
from .simhash import link_edges, majority

#: Words of a shingle; similarity that links, as a fraction.
WIDTH, OVER, UNDER = 5, 4, 5
#: MinHash bands of the first step, and functions of a band.
BANDS, ROWS = 24, 3
#: Documents that have a shingle from which it is common, and common shingles that the table holds at most (the most common).
COMMON_TIMES, COMMON = 4, 1_000_000
#: Words whose hashes a task remembers.
HELD_WORDS = 100_000
#: Name of the passing column of the set's hash, which no table should have.
KEY = "__near_key"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RNG = np.random.default_rng(17)
_DRAWS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= HELD_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, memo: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words, A-Z in lower case; a shorter text is one shingle."""
    memo = _Words() if memo is None else memo
    words = (text or "").encode().translate(_LOWER).split()
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - WIDTH + 1, 1)
    runs = np.full(n, len(words) if len(words) < WIDTH else WIDTH, np.uint64)
    for k in range(min(WIDTH, len(words))):
        runs += hashes[k : k + n] * _PLACES[k]
    return np.unique(_mixed(runs))


def set_key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return UNDER * shared >= OVER * (len(one) + len(two) - shared)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _bands(found: np.ndarray) -> np.ndarray:
    least = np.min([found * a for a in _DRAWS], axis=1).reshape(BANDS, ROWS)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        mixed = _mixed(mixed * _PLACES[0] + least[:, k])
    return mixed


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no_state()
    memo = _Words()
    for batch in slices(batches):
        sets = [shingle_set(x, memo) for x in batch.column("text").to_pylist()]
        bands = pa.array([_bands(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), _signed([set_key(x) for x in sets]), pa.array([majority(x) for x in sets], pa.int64()), bands], names=["doc_id", "key", "fp", "bands"])


def _low(h: np.ndarray) -> np.ndarray:
    """The part of a shingle's hash that common ones are counted by."""
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no_state()
    memo = _Words()
    for batch in slices(batches):
        h, n = np.unique(np.concatenate([_low(shingle_set(x, memo)) for x in batch.column("text").to_pylist()]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int32())], names=["h", "n"])


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_state()
        common, rank = shared.value
        memo = _Words()
        for batch in slices(batches):
            sets = [shingle_set(x, memo) for x in batch.column("text").to_pylist()]
            firsts = []
            for found in sets:
                if len(common):
                    low = _low(found)
                    at = np.minimum(np.searchsorted(common, low), len(common) - 1)
                    found = found[np.argsort(np.where(common[at] == low, rank[at], 0), kind="stable")]
                n = len(found)
                firsts.append(found[: n - -(-OVER * n // UNDER) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), _signed([set_key(x) for x in sets]), pa.array([len(x) for x in sets], pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["doc_id", "key", "size", "first"],
            )

    return run


def run_pairs(key: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of keys of different groups among holders of one shingle whose sizes and places allow the similarity."""
    order = np.argsort(size, kind="stable")
    key, group, size, place = key[order], group[order], size[order], place[order]
    rest = size - place
    stops = np.searchsorted(size, UNDER * size // OVER, side="right")
    for i in range(len(key) - 1):
        to = slice(i + 1, stops[i])
        fits = (group[to] != group[i]) & (9 * np.minimum(rest[to], rest[i]) >= 4 * (size[to] + size[i]))
        if fits.any():
            other = key[to][fits]
            yield np.column_stack([np.minimum(other, key[i]), np.maximum(other, key[i])])


def _token_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows sorted by shingle; a shingle may straddle batches. A null group is the class itself."""
    held = [np.zeros(0, np.int64)] * 5

    def solve(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, group = columns[0], columns[2]
        if not len(h):
            return
        starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
        stops = np.append(starts[1:], len(h))
        apart = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        found: list[np.ndarray] = []
        for at, to in zip(starts[apart].tolist(), stops[apart].tolist(), strict=True):
            found += run_pairs(*(x[at:to] for x in columns[1:]))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["lo", "hi"])

    for batch in batches:
        shape = batch.column("shape").to_numpy()
        fresh = [batch.column("h").to_numpy(), batch.column("num").to_numpy(), pc.coalesce(batch.column("group"), batch.column("num")).to_numpy(), shape >> 32, shape & 0xFFFFFFFF]
        columns = [np.concatenate(x) for x in zip(held, fresh, strict=True)]
        if len(columns[0]):
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [x[last:] for x in columns]
            yield from solve([x[:last] for x in columns])
    yield from solve(held)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar; rows that follow each other mostly share their first text."""
    no_state()
    memo, last, one = _Words(), None, None
    for batch in slices(batches):
        good = []
        for a, b in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True):
            if one is None or a != last:
                last, one = a, shingle_set(a, memo)
            good.append(similar(one, shingle_set(b, memo)))
        good = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("lo").filter(good), batch.column("hi").filter(good)], names=["lo", "hi"])


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (lo, hi) of ``pairs`` that are similar, by whole texts; ``classes`` says which document holds a class's text."""
    ends = pairs.select(F.explode(F.array("lo", "hi")).alias("num")).distinct()
    wanted = cut(ends.join(classes.select("num", "key", "gone", "id"), "num").select("num", F.col("key").alias("k"), F.col("gone").alias("g"), F.col("id").alias("i")), "near-wanted")
    keyed = docs.select("doc_id", "text", F.col("doc_id").isNull().alias("gone"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"))
    some = keyed.join(wanted.select("g", "i").distinct(), (F.col("gone") == F.col("g")) & (F.col("id") == F.col("i")), "left_semi")
    some = some.select("text", "gone", "id").mapInArrow(_with_key, f"text string, gone boolean, id long, {KEY} long")
    texts = cut(some.join(wanted, (F.col("gone") == F.col("g")) & (F.col("id") == F.col("i")) & (F.col(KEY) == F.col("k"))).select("num", "text"), "near-texts")
    if texts.count() != wanted.count():  # rows of equal id and text
        texts = texts.groupBy("num").agg(F.min("text").alias("text"))
    left, right = texts.select(F.col("num").alias("lo"), F.col("text").alias("t1")), texts.select(F.col("num").alias("hi"), F.col("text").alias("t2"))
    return cut(pairs.join(right, "hi").join(left, "lo").select("lo", "hi", "t1", "t2").mapInArrow(_verified, "lo long, hi long"), "near-links")


def first_pairs(classes: DataFrame) -> DataFrame:
    """(lo, hi): the classes of a fingerprint with its first, the firsts of fingerprints that the pigeonring search links, and
    the classes of a band with two of them."""
    first = cut(classes.groupBy("fp").agg(F.min("num").alias("first")), "near-fps")
    same = classes.join(first, "fp").where("first <> num").select(F.col("first").alias("lo"), F.col("num").alias("hi"))
    edges = cut(link_edges(first.select("fp")), "near-fp-edges")
    one, two = first.select(F.col("fp").alias("a"), F.col("first").alias("k1")), first.select(F.col("fp").alias("b"), F.col("first").alias("k2"))
    near = edges.join(one, "a").join(two, "b").select(F.least("k1", "k2").alias("lo"), F.greatest("k1", "k2").alias("hi"))
    spread = classes.select("num", F.explode("bands").alias("band"))
    drawn = F.struct(F.xxhash64("num", "band").alias("draw"), "num")  # another first in every band, so a class meets many
    least = cut(spread.groupBy("band").agg(F.min(drawn).alias("x"), F.max(drawn).alias("y")).where("x.num <> y.num").select("band", F.explode(F.array("x.num", "y.num")).alias("hub")), "near-bands")
    banded = spread.join(least, "band").where("hub <> num").select(F.least("hub", "num").alias("lo"), F.greatest("hub", "num").alias("hi"))
    return cut(same.union(near).union(banded).distinct(), "near-first-pairs")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in ascending order, by the upper half of their hash, and their ranks by how many documents have them."""
    # A slice of rows is counted at once, so a shingle of many documents is combined before the shuffle and few others would be.
    counted = docs.select("text").mapInArrow(_shingles, "h int, n int").repartition(shuffle_width(docs.sparkSession), "h")
    counted = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_TIMES)
    counted = cut(counted.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "near-common")
    floor, room = None, COMMON
    for step, size in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 8 for each bit of a count
        room -= size
        if room < 0:
            break
        floor = step
    if floor is None:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    table = counted.where(F.col("step") >= floor).select("h", "n").toArrow()  # bounded by COMMON
    h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_pairs(docs: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """(lo, hi): classes of different groups of ``joined`` (node, component) that may be similar."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common_shingles(docs))
    release(spark)
    grouped = cut(classes.join(joined, classes["num"] == joined["node"], "left").select("num", "key", "gone", "id", F.nullif("component", "num").alias("group")), "near-groups")
    rows = docs.select("doc_id", "text").mapInArrow(_prefixes(shared), "doc_id long, key long, size long, first array<long>")
    rows = rows.select("key", "size", "first", F.col("doc_id").isNull().alias("gone"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    spread = rows.join(grouped, ["key", "gone", "id"]).select("num", "group", "size", F.posexplode("first").alias("place", "h"))
    spread = spread.select("h", "num", "group", (F.shiftleft("size", 32) + F.col("place")).alias("shape"))
    placed = spread.repartition(shuffle_width(spark), "h").sortWithinPartitions("h")
    return cut(placed.mapInArrow(_token_pairs, "lo long, hi long").distinct(), "near-prefix-pairs")


def near_classes(docs: DataFrame) -> DataFrame:
    """key (of a set of shingles), gone and id (of the class's first document) and root (the same for linked classes)."""
    keyed = cut(docs.select("doc_id", "text").mapInArrow(_keyed, "doc_id long, key long, fp long, bands array<long>"), "near-keys")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("gone"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("x")
    classes = keyed.groupBy("key").agg(least, F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("num"), "key", "x.gone", "x.id", "fp", "bands"), "near-classes")
    first = verified(docs, classes, first_pairs(classes))
    release(docs.sparkSession)
    joined = connected_components(first, "lo", "hi")
    candidates = prefix_pairs(docs, classes, joined)
    release(docs.sparkSession)
    second = verified(docs, classes, candidates)
    linked = connected_components(first.union(second), "lo", "hi")
    return classes.join(linked, classes["num"] == linked["node"], "left").select("key", "gone", "id", F.coalesce("component", "num").alias("root"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no_state()
    memo = _Words()
    for batch in slices(batches):
        found = _signed([set_key(shingle_set(x, memo)) for x in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, KEY])


def keep_one_of_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of linked texts: of the smallest doc_id, and of those rows of the smallest key.

    Rows with a null id are last in that order; of rows with equal id and key one stays; texts without a word are one
    class. Columns and their order are kept.
    """
    classes = near_classes(docs)
    release(docs.sparkSession)
    chosen = classes.groupBy("root").agg(F.min(F.struct("gone", "id", "key")).alias("x"))
    chosen = cut(chosen.select(F.col("x.gone").alias("k_gone"), F.col("x.id").alias("k_id"), F.col("x.key").alias("k_key")), "near-kept")
    schema = T.StructType([*docs.schema.fields, T.StructField(KEY, T.LongType())])
    marked = docs.mapInArrow(_with_key, schema).withColumn("__gone", F.col("doc_id").isNull()).withColumn("__id", F.coalesce("doc_id", F.lit(0).cast("long")))
    met = marked.join(chosen, (marked["__gone"] == chosen["k_gone"]) & (marked["__id"] == chosen["k_id"]) & (marked[KEY] == chosen["k_key"]), "left_semi")
    return met.dropDuplicates(["__gone", "__id", KEY]).select(*docs.columns)
