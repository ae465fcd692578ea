"""SimHash fingerprints and their links by pigeonring filtering.

The 64 bits stand in a ring of four segments. If two fingerprints differ in at most three bits, then some chain of
consecutive segments keeps within its share of the budget at every length: no bit in its first segment, at most one in
the first two, at most two in the first three. The first segment and, because the second holds one differing bit at most,
one half of the second agree exactly; these 24 bits are the key of a candidate's bucket. Inside a bucket the rest of the
chain is tested before the full distance. Equal fingerprints are one class from the start, and a bucket sends out a spanning
forest and not its pairs. A bucket of more than ``BLOCK`` distinct fingerprints is dealt out as pairs of blocks, each to a
task of its own: its n fingerprints are copied n / ``BLOCK`` times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import cut, shuffle_width
from .common import slices

#: Differing bits at which fingerprints link; segments of the ring; fingerprints of a block of a large bucket.
LINK_BITS, SEGMENTS, BLOCK = 3, 4, 1_024
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number; without a word it is zero."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        stops = (ends[width - 1 :] - 1).tolist()
        digest, view = xxhash.xxh64_intdigest, memoryview(joined)
        hashes = np.fromiter((digest(view[a:b], 42) for a, b in zip(starts, stops, strict=True)), "<u8", len(stops))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes, as a signed number."""
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(x, width) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp of every row; a map over whole texts."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


def distances(one: np.uint64, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ one)


def chain_links(one: np.uint64, others: np.ndarray, segment: int, limit: int = LINK_BITS) -> np.ndarray:
    """Which of ``others`` link to ``one`` by the chain that starts at ``segment``: the sums of differing bits keep within
    their share at every length, and the last sum is the full distance."""
    turned = others ^ one
    shift = np.uint64(16 * segment)
    if segment:
        turned = turned >> shift | turned << np.uint64(64 - 16 * segment)
    alive = np.ones(len(others), bool)
    for length in range(1, SEGMENTS):
        mask = np.uint64((1 << (16 * length)) - 1)
        alive &= np.bitwise_count(turned & mask) * SEGMENTS <= length * limit
    return alive & (np.bitwise_count(turned) <= limit)


def forest(fps: np.ndarray, segment: int, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what links inside a block of a bucket, or between two blocks: each fingerprint enters once.

    Every fingerprint that is reached is taken out of the rest, so a block of near copies costs about one comparison each.
    """
    edges = []
    if others is None:
        rest = fps
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop()
                hit = chain_links(one, rest, segment)
                if hit.any():
                    near = rest[hit]
                    edges += [(int(one), int(x)) for x in near]
                    queue += list(near)
                    rest = rest[~hit]
        return edges
    left, right = fps, others
    while len(left) and len(right):
        one, left = left[0], left[1:]
        queue = [(one, True)]
        while queue:
            one, is_left = queue.pop()
            side = right if is_left else left
            if not len(side):
                continue
            hit = chain_links(one, side, segment)
            if hit.any():
                near = side[hit]
                edges += [(int(one), int(x)) for x in near]
                queue += [(x, not is_left) for x in near]
                if is_left:
                    right = right[~hit]
                else:
                    left = left[~hit]
    return edges


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the buckets in rows sorted by bucket; a bucket may straddle batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_key, held = None, []

    def solve(key, rows) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        segment, first, second = key[0] >> 25, key[1], key[2]
        fps = np.array([x for x, _ in rows], np.int64).view(np.uint64)
        if first == second:
            return forest(fps, segment)
        block = np.array([x for _, x in rows])
        return forest(fps[block == first], segment, fps[block == second])

    def out(edges) -> Iterator[pa.RecordBatch]:
        if edges:
            pairs = np.array(edges, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    edges: list[tuple[int, int]] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "one", "two", "fp", "block")]
        bucket, one, two = columns[:3]
        n = batch.num_rows
        if not n:
            continue
        turns = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
        bounds = [0, *turns.tolist(), n]
        for at, to in zip(bounds, bounds[1:], strict=False):
            key = (int(bucket[at]), int(one[at]), int(two[at]))
            if key != held_key:
                edges += solve(held_key, held)
                held_key, held = key, []
            held += list(zip(columns[3][at:to].tolist(), columns[4][at:to].tolist(), strict=True))
        yield from out(edges)
        edges = []
    yield from out(solve(held_key, held))


def _unsigned(column: str, shift: int, bits: int):
    return F.shiftrightunsigned(F.col(column), shift).bitwiseAND((1 << bits) - 1)


def link_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of ``classes`` (fp) whose components are those of all links."""
    spark = classes.sparkSession
    keys = []
    for segment in range(SEGMENTS):
        after = 16 * ((segment + 1) % SEGMENTS)
        for half in (0, 1):
            tag = (segment * 2 + half) << 24
            keys.append(_unsigned("fp", 16 * segment, 16) * 256 + _unsigned("fp", after + 8 * half, 8) + F.lit(tag).cast("long"))
    spread = classes.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    counted = cut(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    # The written table has no partitioning, so both sides of this join can be split where a bucket is hot.
    shared = spread.join(counted, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = shared.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "fp", "block")
    placed = dealt.repartition(shuffle_width(spark), "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "fp")
    return placed.mapInArrow(_bucket_edges, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of every row of ``docs``.

    A null or empty text has fingerprint zero and links like any other; a null doc_id takes part in its class and gets the
    class's smallest id, but never is one unless all ids are null; repeated rows give repeated results; an empty table
    gives no rows; other columns are ignored.
    """
    printed = cut(fingerprints(docs, width), "simhash-fp")
    classes = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    edges = cut(link_edges(classes.select("fp")), "simhash-edges")
    members = connected_components(edges, "a", "b")
    rooted = cut(
        classes.join(members, classes["fp"] == members["node"], "left")
        .select("fp", F.coalesce("component", "fp").alias("root"), "least_id"), "simhash-roots",
    )
    smallest = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    named = cut(rooted.join(smallest, "root").select(F.col("fp").alias("class_fp"), "component_id"), "simhash-named")
    return printed.join(named, printed["fp"] == named["class_fp"]).select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The columns that the op4 query returns."""
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
