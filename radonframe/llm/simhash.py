"""SimHash near-duplicates by multi-index hashing.

1. Fingerprints: words are split at ASCII white space after lowering A-Z; each shingle of ``width`` words (a text of fewer
   words is one shingle) hashes with XXH64; a bit is set where over half of the hashes have it.
2. Table: equal fingerprints are one entry and one node of the graph, whatever their ids. Fingerprints are cut into 32-bit segments, and an entry is
   put, for each segment, at the Hamming ball of radius 1 around it (33 places), so two segments that differ in at most 2
   bits meet. Of two fingerprints of 64 bits that differ in up to 5, one of the two segments does.
3. Verification: entries that meet are compared in full. A meeting of n entries yields a spanning forest of the graph of
   its links, at most n - 1 edges, never its n * n pairs, and the same meeting at many places is verified once. Large
   meetings are cut into blocks and each pair of blocks is a task of its own, so no task holds more than about two blocks and
   no link is lost. A meeting of n blocks costs n * n / 2 comparisons of blocks and n copies of each.
4. Components of those edges.

``near_duplicates`` links 64-bit fingerprints within ``bits`` bits, exactly. ``similar_documents`` links documents whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more, by the same steps: fingerprints are the 1024 SimHash bits of a set, segments are those of
``shingle_sets``, of which such a pair shares one with probability 1 - 1.5e-5 or more. Whole fingerprints go to buckets of entries that agree in a few bits, and segments are
taken there; a bucket yields a spanning forest of its pairs that share a segment and are near in all bits within six standard deviations. Components of the forests are
clusters; each set goes to its cluster once (or to the pairs of blocks of a large one), where all pairs not joined yet are compared: by all bits within
six standard deviations first, then by their sets in full. Sets are told apart by 64-bit hashes.

Defined cases: null and empty texts have fingerprint zero, or an empty set, and are linked like any other; null ids get the component of
their fingerprint (null if no id is there); repeated rows and ties share their fingerprint, and rows are kept or dropped one by one, so rows
that share an id but not a text are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_sets
from .components import components
from .shingle_sets import ones, packed, similar, sketch
from .storage import chosen, drop, numbered, stage

BITS = 4
WIDTH = 4
SEED = 42
BLOCK = 2048
BLOCK_ELEMENTS = 1 << 18  # of the sets of a block
STAGE_WIDTH = 5
SIMILARITY = 0.8
STAGE_WORDS = shingle_sets.WORDS  # 64-bit words of the fingerprint of a set
CHECK_WORDS = 2  # of these, what entries that meet are compared by first
ROUND = 64  # segments at a time
TABLES = 16  # tables of buckets at a time
DENSE = 8  # pairs to compare for each entry of a bucket at one segment, beyond which all its pairs are compared at once


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(len(words) - width + 1, 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> list[int]:
    """The bits that over half of the hashes of each row have."""
    return packed(2 * ones(hashes) > hashes.shape[1]).tolist()


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    words = (text or "").encode().lower().split()
    return majority(shingle_hashes(words, width)[None, :])[0] if words else 0


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles in order; a text without words has none."""
    words = (text or "").encode().lower().split()
    return np.unique(shingle_hashes(words, STAGE_WIDTH)) if words else np.empty(0, np.uint64)


def largest_distance(similarity: float = SIMILARITY, bits: int = 64 * STAGE_WORDS, deviations: float = 6) -> int:
    """Bits in which sets of one size with this Jaccard similarity differ: the angle between them as a share of pi, plus ``deviations`` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(fp)], ["doc_id", "fp"])

    return run


def _set_node(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.astype("<u8").tobytes(), SEED)


NODES = "row long, doc_id long, hash long, size long, sketch binary"
SETS = "node long, size long, sketch binary, elements binary"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x.as_py()) for x in b.column(2)]
        hashes = _signed(np.array([_set_node(x) for x in sets], np.uint64))
        out = [b.column(0), b.column(1), hashes, pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "hash", "size", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            b = whole.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingle_set(x.as_py()).astype("<u8").tobytes() for x in b.column(3)], pa.binary())], ["node", "size", "sketch", "elements"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, STAGE_WORDS)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp long), one row per document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


class _Joined:
    """Which entries of a meeting are joined already."""

    def __init__(self, labels: np.ndarray):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[of]

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _sides(sides: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each entry with those it is compared with: the other side's, or the later ones if there is one side only."""
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    for i in left:
        yield int(i), right if len(right) else left[left > i]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.StructArray]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].values


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def _words(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(rows), -1)


def _verify(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _meetings(batches):
            fps, ids, joined, out = _words(rows, "check"), _numbers(rows, "node"), _Joined(np.arange(len(rows))), []
            for i, others in _sides(_numbers(rows, "side")):
                near = others[np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1) <= bits]
                out += [(int(ids[i]), int(ids[j])) for j in near if joined.join(i, int(j))]
            yield _edges(out)

    return run


def _alike(rows: pa.StructArray, similarity: float, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each entry with those of other groups (own) that sizes and, from 64 shingles up, sketches do not rule out."""
    sketches, sizes, own = _sketches(rows.field("sketch")), _numbers(rows, "size"), _numbers(rows, "own")
    for i, others in _sides(_numbers(rows, "side")):
        others = others[own[others] != own[i]]
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[low >= similarity * high - 1e-9]
        near = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1) <= bits
        yield i, others[near | (np.minimum(sizes[others], sizes[i]) < 64)]


def _verify_sets(similarity: float):
    """Edges between entries of different groups (own) whose sets are similar."""
    bits = largest_distance(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _meetings(batches):
            ids, joined, sets, out = _numbers(rows, "node"), _Joined(_numbers(rows, "own")), rows.field("elements"), []
            at = lambda k: np.frombuffer(sets[k].as_py(), "<u8")  # noqa: B023, E731
            for i, others in _alike(rows, similarity, bits):
                mine = None
                for j in others:
                    if joined.root(i) != joined.root(int(j)):
                        mine = at(i) if mine is None else mine
                        if similar(mine, at(int(j)), similarity):
                            joined.join(i, int(j))
                            out.append((int(ids[i]), int(ids[j])))
            yield _edges(out)

    return run


def _dealt(met: DataFrame) -> DataFrame:
    """(place, i, j, side, node): the meetings of (place, node, blocks) in pairs of blocks, each set of entries once."""
    # an entry of block k goes to the task of each pair of blocks that has k; with one block, to that of (0, 0)
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j"), F.struct((F.col("mine") > x).cast("int").alias("side"), "node").alias("who")),
    )
    dealt = met.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("place", F.explode(tasks).alias("t"))
    meetings = dealt.groupBy("place", "t.i", "t.j").agg(F.sort_array(F.collect_list("t.who")).alias("who")).filter(F.size("who") > 1)
    once = meetings.groupBy("who").agg(F.min("place").alias("place"), F.min("i").alias("i"), F.min("j").alias("j"))
    return once.select("place", "i", "j", F.explode("who").alias("w")).select("place", "i", "j", "w.*")


def _filled(dealt: DataFrame, entries: DataFrame) -> DataFrame:
    """(met, place, i, j): the entries, by ``node``, of each meeting (place, i, j, side, node)."""
    groups = dealt.join(entries, "node").groupBy("place", "i", "j").agg(F.collect_list(F.struct("side", *entries.columns)).alias("met"))
    return groups.select("met", "place", "i", "j")


def _blocks(amount: Column, block: int) -> Column:
    return F.ceil(amount / F.lit(block)).cast("int")


def links(entries: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between the entries (node, seek, check) with the same components as all pairs that meet by ``seek`` and are within ``bits`` bits by ``check``."""
    low = F.lit(0xFFFFFFFF)
    segments = F.flatten(F.transform("seek", lambda x, k: F.array(*[F.shiftleft(2 * k.cast("long") + h, 32).bitwiseOR(F.shiftrightunsigned(x, 32 * h).bitwiseAND(low)) for h in (0, 1)])))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    places = entries.select("node", F.explode(segments).alias("own")).select("node", F.explode(F.transform(flips, lambda x: F.col("own").bitwiseXOR(x))).alias("place"))
    # counted before entries are brought together, so that a hot place is only a skewed join key
    shared = stage(places.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select("place", _blocks(F.col("n"), block).alias("blocks")), "simhash")
    found = stage(_filled(_dealt(places.join(shared, "place")), entries.select("node", "check")).mapInArrow(_verify(bits), "a long, b long").distinct(), "simhash")
    drop(shared)
    return found


def near_duplicates(docs: DataFrame, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document: the least id of the documents that links of fingerprints reach, null where none has one."""
    if not 0 <= bits <= 5:
        raise ValueError("balls of radius 1 around two segments find up to 5 differing bits")
    fps = stage(fingerprints(docs, width), "simhash")
    # nodes are numbers of fingerprints: an id can have several of these, and one can have no id
    entries = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "simhash")
    edges = links(entries.select("node", F.array("fp").alias("seek"), F.array("fp").alias("check")), bits)
    found = stage(components(edges).join(entries.select("node", "least"), "node"), "simhash")
    least = stage(found.groupBy("component").agg(F.min("least").alias("component_id")), "simhash")
    linked = found.join(least, "component").select("node", "component_id")
    named = stage(entries.join(linked, "node", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash")
    drop(entries, edges, found, least)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _places(bits: int, part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                sketches = _sketches(b.column(2))
                own, place = shingle_sets.places_of(sketches, b.column(1).to_numpy(), bits, part, parts)
                checks = [_signed(sketches[own, k]) for k in range(CHECK_WORDS)]
                yield pa.RecordBatch.from_arrays([_signed(place), b.column(0).take(pa.array(own)), *checks], ["place", "node", *[f"check{k}" for k in range(CHECK_WORDS)]])

    return run


def near_rows(meeting: np.ndarray, checks: np.ndarray, bits: int) -> np.ndarray:
    """Which rows, in order of their meetings, have another one of their meeting within ``bits`` bits."""
    hit, left, step = np.zeros(len(meeting), bool), np.arange(len(meeting)), 1
    while len(left := left[: np.searchsorted(left, len(meeting) - step)]) and len(left := left[meeting[left] == meeting[left + step]]):
        near = left[np.bitwise_count(checks[left] ^ checks[left + step]).sum(axis=1) <= bits]
        hit[near] = hit[near + step] = True
        step += 1
    return hit


def _near(bits: int):
    """(place, node) of the rows (place, pair, node, checks), in order of place and pair, that have another one near at theirs."""

    def found(rows: np.ndarray) -> pa.RecordBatch:
        new = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        hit = near_rows(np.concatenate([[0], np.cumsum(new)]), rows[:, 3:].view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(rows[hit, 0]), pa.array(rows[hit, 2])], ["place", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3 + CHECK_WORDS), np.int64)
        for b in batches:
            rows = np.concatenate([rest, np.column_stack([c.to_numpy() for c in b.columns])])
            whole = np.searchsorted((rows[:, :2] == rows[-1:, :2]).all(axis=1), True) if len(rows) else 0  # the last meeting may go on
            if whole:
                yield found(rows[:whole])
            rest = rows[whole:]
        if len(rest):
            yield found(rest)

    return run


def _met(entries: DataFrame, similarity: float) -> DataFrame:
    """(place, node), staged: the entries (node, size, sketch) that have another one near at a place, at each such place.

    All segments are taken, ``ROUND`` at a time, so that shuffles hold only these. Places of more than ``BLOCK`` entries are cut into blocks, and each pair of blocks is a
    meeting of its own.
    """
    bits, limit = shingle_sets.bits_for(entries.count()), largest_distance(similarity, 64 * CHECK_WORDS)
    parts, found, block = shingle_sets.rounds(bits, ROUND), [], BLOCK
    checks = [f"check{k}" for k in range(CHECK_WORDS)]
    for part in range(parts):
        placed = entries.select("node", "size", "sketch").mapInArrow(_places(bits, part, parts), ", ".join(f"{x} long" for x in ("place", "node", *checks)))
        hot = stage(placed.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("place", _blocks(F.col("n"), block).alias("blocks")), "similar")
        mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))  # noqa: B023
        dealt = placed.join(hot, "place", "left").withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
        meetings = dealt.select("place", "pair", "node", *checks).repartition("place", "pair").sortWithinPartitions("place", "pair")
        found.append(stage(meetings.mapInArrow(_near(limit), "place long, node long").distinct(), "similar"))
        drop(hot)
    return reduce(DataFrame.unionByName, found)


def _tables(bits: int, part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                own, place = shingle_sets.places_of(_sketches(b.column(2)), b.column(1).to_numpy(), bits, part, parts)
                yield pa.RecordBatch.from_arrays([_signed(place), *[c.take(pa.array(own)) for c in b.columns]], ["place", "node", "size", "sketch"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (place, pair), by which they are in order."""
    own, last = [], None
    for b in batches:
        keys = np.column_stack([b.column(k).to_numpy() for k in (0, 1)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if own and tuple(keys[lo]) != last:
                yield pa.Table.from_batches(own)
                own = []
            own.append(b.slice(lo, hi - lo))
            last = tuple(keys[lo])
    if own:
        yield pa.Table.from_batches(own)


def _forests(similarity: float, dense: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            nodes, sketches = rows.column("node").to_numpy(), _sketches(rows.column("sketch"))
            pairs = nodes[shingle_sets.forest(rows.column("size").to_numpy(), sketches, similarity, rows.column("place")[0].as_py() >> 32, dense)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pairs.min(axis=1), pairs.max(axis=1))], ["a", "b"])

    return run


def _candidates(entries: DataFrame, similarity: float) -> DataFrame:
    """(a, b), staged: edges between the entries (node, size, sketch) with the same components as all pairs that share a bucket and a segment of it and are near.

    Fingerprints go to their buckets, ``TABLES`` tables at a time, and segments are taken there. A bucket of more than 2 * ``BUCKET`` entries is cut into blocks, and each pair of
    blocks is a bucket of its own.
    """
    bits, block = shingle_sets.table_bits(entries.count()), shingle_sets.BUCKET
    parts, found, columns = shingle_sets.rounds(bits, TABLES), [], ["node", "size", "sketch"]
    checked = entries.select(*columns).mapInArrow(_places(bits, 0, 1), ", ".join(f"{x} long" for x in ("place", "node", *[f"check{k}" for k in range(CHECK_WORDS)])))
    hot = stage(checked.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * block).select("place", _blocks(F.col("n"), block).alias("blocks")), "similar")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda x: x != mine)
    pairs = F.transform(others, lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
    for part in range(parts):
        placed = entries.select(*columns).mapInArrow(_tables(bits, part, parts), "place long, node long, size long, sketch binary")
        dealt = placed.join(F.broadcast(hot), "place", "left").withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
        buckets = dealt.select("place", "pair", *columns).repartition("place", "pair").sortWithinPartitions("place", "pair")
        found.append(stage(buckets.mapInArrow(_forests(similarity, DENSE), "a long, b long").distinct(), "similar"))
    drop(hot)
    return reduce(DataFrame.unionByName, found)


def _grouped(rows: DataFrame, similarity: float) -> DataFrame:
    """(row, doc_id, first): the first row (none, doc_id, row) of the group of each row (row, doc_id, text), a staged table. The least id is first, null ids come last."""
    nodes = stage(rows.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_nodes, NODES), "similar")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # numbers compress in shuffles
    entries = stage(nodes.groupBy("hash").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "similar")
    candidates = _candidates(entries, similarity)
    clusters = stage(components(candidates).withColumnRenamed("component", "place"), "similar")
    # sets travel once to the task of their cluster, or to those of the pairs of blocks that it is cut into
    wanted = stage(entries.join(clusters, "node").select(F.col("first.row").alias("row"), "node", "size", "sketch"), "similar")
    sets = stage(rows.filter(chosen(rows, "row", wanted.select("row"))).join(wanted, "row").select("node", "size", "sketch", F.col("text").cast("string")).mapInArrow(_sets, SETS), "similar")
    sized = clusters.join(sets.select("node", "size"), "node").groupBy("place").agg(F.sum("size").alias("elements"), F.count("*").alias("n"))
    blocks = stage(sized.select("place", F.greatest(_blocks(F.col("elements"), BLOCK_ELEMENTS), _blocks(F.col("n"), BLOCK)).alias("blocks")), "similar")
    dealt = stage(_dealt(clusters.join(blocks, "place")), "similar")
    edges = stage(_filled(dealt, sets.withColumn("own", F.col("node"))).mapInArrow(_verify_sets(similarity), "a long, b long").distinct(), "similar")
    drop(candidates, clusters, wanted, sets, blocks, dealt)
    joined = components(edges)
    found = stage(entries.select("node", "hash", "first").join(joined, "node", "left").select("hash", "first", F.coalesce("component", "node").alias("component")), "similar")
    drop(edges, joined, entries)
    least = stage(found.groupBy("component").agg(F.min("first").alias("first")), "similar")
    named = stage(found.drop("first").join(least, "component").select("hash", "first"), "similar")
    out = stage(nodes.select("row", "doc_id", "hash").join(named, "hash").select("row", "doc_id", "first"), "similar")
    drop(nodes, found, least, named)
    return out


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id), one row per document: groups of documents that links of at least this similarity join, by the least id of each."""
    rows, name = numbered(docs.select("doc_id", "text"))
    out = _grouped(rows.withColumnRenamed(name, "row"), similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))
    drop(rows)
    return out


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: that with the least id, of those with no id or the same id any one."""
    rows, name = numbered(docs)
    gone = _grouped(rows.select(F.col(name).alias("row"), "doc_id", "text"), similarity).filter("row <> first.row").select(F.col("row").alias(name))
    return rows.filter(~chosen(rows, name, gone)).select(*docs.columns)
