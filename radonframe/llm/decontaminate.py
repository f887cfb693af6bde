"""Benchmark decontamination with a distributed positional inverted index.

Index: tasks tokenise documents into shards of about ``SHARD_WORDS`` words and store, per shard, one row with the terms
of its documents and the ascending positions of each (postings). Documents follow each other in a shard's positions with a gap
of one between them, so no phrase crosses over. Postings stay with their shard: nothing is shuffled, and a shard fits a task.
A shard is a row group of its own, and the search's tasks get places of shards, not shards: they read one at a time from the
shared folder, so neither the writer, nor the JVM, nor a batch holds the shards of a task together, however large its part is.

Search: a phrase's terms are taken from the rarest (by counts over the whole index) to the most common; lists of positions,
each less its term's offset in the phrase, are intersected until one is empty. What remains are exact matches. A proximity
match is a stretch of one document of at most the phrase's length plus ``slop`` words that has all its terms in any order, each as
often as the phrase does, and no shorter such stretch within; it is found around the rarest term's positions.

The query set goes to the tasks with their code, in blocks of about ``BLOCK_BYTES`` of text at most, or of one item that is longer: a
larger benchmark takes more passes over the index, whose hits are united.

Words are runs of characters other than ASCII non-alphanumerics, after lowering A-Z. A window is ``width`` consecutive
words of an item; an item of fewer words, but not none, is one window.

Defined cases: null and empty texts have no words and are never hit; null ids are kept; a null item id reads "null";
repeated documents are rows of their own; repeated items count once; an empty table of items hits nothing; an empty table
of documents gives an empty result; further columns are ignored. A single document longer than a shard is a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import chosen, drop, numbered, open_fs, stage

WIDTH = 10
SLOP = 2
SHARD_WORDS = 1 << 18
BLOCK_BYTES = 8 << 20
UNIT_SHARDS, TASK_SHARDS = 4, 16
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
INDEX = "shard string, doc_ids array<long>, doc_starts array<int>, doc_words array<int>, terms array<binary>, counts array<int>, postings binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _build(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids: list[int | None] = []
        numbers: list[np.ndarray] = []
        terms: dict[bytes, int] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in numbers], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes
            every = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
            at = np.arange(len(every)) + np.repeat(np.arange(len(sizes)), sizes)
            postings = at[np.argsort(every, kind="stable")].astype("<i4")
            row = {
                "shard": uuid.uuid4().hex, "doc_ids": list(ids), "doc_starts": starts.tolist(), "doc_words": sizes.tolist(), "terms": list(terms),
                "counts": np.bincount(every, minlength=len(terms)).tolist(), "postings": postings.tobytes(),
            }
            ids.clear(), numbers.clear(), terms.clear()
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = words(text.as_py())
                ids.append(d)
                numbers.append(np.fromiter((terms.setdefault(w, len(terms)) for w in own), np.int32, len(own)))
                held += len(own) + 1
                if held >= shard_words:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return run


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), a staged table with one row per shard, each a row group."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage(rows.mapInArrow(_build(shard_words), INDEX), "index", group_rows=1)


def _units(index: DataFrame) -> DataFrame:
    """(file, first, last): places of an index's shards, ``UNIT_SHARDS`` or fewer in a row, dealt to tasks."""
    files = index.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    units = files.select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(UNIT_SHARDS).cast("long"))).alias("first"))
    tasks = max(1, -(-index.count() // TASK_SHARDS))
    return units.select("file", "first", F.least(F.col("first") + UNIT_SHARDS, "n").alias("last")).repartition(tasks, "file", "first")


def _shards(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, pa.Scalar]]:
    """The shards of units, one at a time."""
    for b in batches:
        for unit in b.to_pylist():
            fs, where = open_fs(unit["file"])
            with fs.open_input_file(where) as f:
                table = pq.ParquetFile(f)
                for k in range(unit["first"], unit["last"]):
                    row = table.read_row_group(k, columns=columns, use_threads=False)
                    yield {name: row.column(name)[0] for name in columns}


class Phrases:
    """A block of phrases as one array over its own vocabulary."""

    def __init__(self, phrases: Iterable[tuple[bytes, ...]]) -> None:
        phrases = list(phrases)
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        self.ends = np.cumsum(self.sizes)
        self.terms = np.fromiter((number.setdefault(w, len(number)) for p in phrases for w in p), np.int32, int(self.sizes.sum()))
        widest = int(self.sizes.max(initial=1))
        # each phrase repeated up to the length of the longest
        self.padded = self.terms[(self.ends - self.sizes)[:, None] + np.arange(widest) % self.sizes[:, None]]
        self.frequency = np.zeros(len(number), np.int64)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.terms[self.ends[k] - self.sizes[k] : self.ends[k]]


def _numbers(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The number of each term in a vocabulary, -1 where it is not there."""
    return pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)


def _frequencies(vocabulary: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(vocabulary, pa.binary()), np.zeros(len(vocabulary), np.int64)
        for row in _shards(batches, ["terms", "counts"]):
            at = _numbers(row["terms"].values, known)
            n[at[at >= 0]] += row["counts"].values.to_numpy()[at >= 0]  # a shard has each term once
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    return run


def rank_terms(units: DataFrame, phrases: Phrases) -> None:
    """Fill in the frequencies over the whole index of the phrases' terms (as many numbers as the block has terms)."""
    sums = units.mapInArrow(_frequencies(list(phrases.vocabulary)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        phrases.frequency[r["at"]] = r["n"]


def shard_lists(terms: pa.Array, counts: np.ndarray, postings: pa.Buffer, vocabulary: pa.Array) -> dict[int, np.ndarray]:
    """Positions in a shard of the phrases' terms, by the term's number in the phrases' vocabulary."""
    at, ends, every = _numbers(terms, vocabulary), np.cumsum(counts), np.frombuffer(postings, "<i4")
    here = np.flatnonzero(at >= 0)
    return {k: every[e - n : e] for k, n, e in zip(at[here].tolist(), counts[here].tolist(), ends[here].tolist(), strict=True)}


def phrase_starts(lists: dict[int, np.ndarray], phrases: Phrases) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the phrase, positions where it starts) of the phrases that occur in a shard."""
    here = np.zeros(len(phrases.vocabulary), bool)
    here[list(lists)] = True
    for k in np.flatnonzero(here[phrases.padded].all(axis=1)) if len(phrases.padded) else ():
        p = phrases[k]
        starts: np.ndarray | None = None
        for off in np.argsort(phrases.frequency[p], kind="stable"):
            own = lists[p[off]]
            if starts is None:
                starts = own - off
            else:
                found = np.searchsorted(own, starts + off)
                starts = starts[(found < len(own)) & (own[np.minimum(found, len(own) - 1)] == starts + off)]
            if not len(starts):
                break
        if starts is not None and len(starts):
            yield int(k), starts


def near_matches(lists: dict[int, np.ndarray], phrases: Phrases, slop: int, starts: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(number of the phrase, first, last position) of the stretches of at most length + slop words, within one of the documents at ``starts``, that have all its terms, as often as it does, and contain no shorter one."""
    here = np.zeros(len(phrases.vocabulary), bool)
    here[list(lists)] = True
    for k in np.flatnonzero(here[phrases.padded].all(axis=1)).tolist() if len(phrases.padded) else ():
        p = phrases[k]
        terms, times = np.unique(p, return_counts=True)
        order = np.argsort(phrases.frequency[terms], kind="stable").tolist()
        need, room = dict(zip(terms.tolist(), times.tolist(), strict=True)), len(p) + slop
        around = lists[int(terms[order[0]])]
        for t in (int(terms[o]) for o in order):
            around = around[np.searchsorted(lists[t], around + room) - np.searchsorted(lists[t], around - room, "right") >= need[t]]
        if not len(around):
            continue
        near = {t: own[np.searchsorted(around, own + room) > np.searchsorted(around, own - room, "right")] for t in need for own in (lists[t],)}
        at, kinds = np.concatenate(list(near.values())), np.repeat(list(near), [len(x) for x in near.values()])
        ranks = np.argsort(at)
        at, kinds = at[ranks], kinds[ranks].tolist()
        documents = (np.searchsorted(starts, at, "right") if starts is not None else np.zeros(len(at), np.int64)).tolist()
        at = at.tolist()
        lo, missing, lack = 0, len(p), dict(need)
        for hi, t in enumerate(kinds):
            if documents[hi] != documents[lo]:
                lo, missing, lack = hi, len(p), dict(need)
            missing -= lack[t] > 0
            lack[t] -= 1
            last = None
            while not missing:
                last, left = lo, kinds[lo]
                lack[left] += 1
                missing += lack[left] > 0
                lo += 1
            if last is not None and at[hi] - at[last] < room:
                yield k, at[last], at[hi]


def windows(text: str | None, width: int = WIDTH) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []


HITS = "shard string, at int, doc_id long, n_words long, spans array<int>, items array<string>"


def _search(phrases: Phrases, owners: list[list[str]], slop: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(list(phrases.vocabulary), pa.binary())
        for row in _shards(batches, ["shard", "doc_ids", "doc_starts", "doc_words", "terms", "counts", "postings"]):
            starts, sizes = (row[name].values.to_numpy().astype(np.int64) for name in ("doc_starts", "doc_words"))
            lists = shard_lists(row["terms"].values, row["counts"].values.to_numpy(), row["postings"].as_buffer(), vocabulary)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            if slop is None:
                matches = ((k, found, found + phrases.sizes[k]) for k, found in phrase_starts(lists, phrases))
            else:
                matches = ((k, np.array([lo]), np.array([hi + 1])) for k, lo, hi in near_matches(lists, phrases, slop, starts))
            for k, found, ends in matches:
                for d, x, y in zip((np.searchsorted(starts, found, "right") - 1).tolist(), found.tolist(), ends.tolist(), strict=True):
                    # an empty document shares no position with a word: its gap is its own
                    spans.setdefault(d, []).append((x - int(starts[d]), y - int(starts[d])))
                    items.setdefault(d, set()).update(owners[k])
            every = range(len(starts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"].as_py()] * len(starts), pa.string()), pa.array(every, pa.int32()), row["doc_ids"].values, pa.array(sizes),
                    pa.array([[v for s in united(spans.get(d, ())) for v in s] for d in every], pa.list_(pa.int32())),
                    pa.array([sorted(items.get(d, ())) for d in every], pa.list_(pa.string())),
                ],
                ["shard", "at", "doc_id", "n_words", "spans", "items"],
            )

    return run


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges of words as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[v for s in united((x[k], x[k + 1]) for x in xs for k in range(0, len(x), 2)) for v in s] for xs in b.column("spans").to_pylist()]
        items = [sorted({i for x in xs for i in x}) for xs in b.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], b.schema.names)


def find_windows(index: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, *, slop: int | None = None) -> DataFrame:
    """(shard, at, doc_id, n_words, spans, items): each document's hit words, as disjoint [from, to) pairs in a flat array, and the items hit; by exact windows or, with ``slop``, by proximity."""
    items = items.select(F.col("item_id").cast("string"), "text").distinct()
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    units = _units(index)
    hits: DataFrame | None = None
    for k in range(blocks):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect():
            for w in windows(r["text"], width):
                owners.setdefault(w, set()).add("null" if r["item_id"] is None else r["item_id"])
        phrases = Phrases(owners)
        rank_terms(units, phrases)
        found = units.mapInArrow(_search(phrases, [sorted(x) for x in owners.values()], slop), HITS)
        hits = found if hits is None else hits.unionByName(found)
    if blocks > 1:
        hits = hits.groupBy("shard", "at", "doc_id", "n_words").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).mapInArrow(_unite, HITS)
    return hits


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document."""
    hits = find_windows(build_index(docs), items, width)
    n_hit = F.aggregate(F.transform("spans", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def proximity(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """(doc_id, n_words, spans, items), one row per document: words in proximity matches of the items' windows, as disjoint [from, to) pairs in a flat array. Exact matches are among them."""
    return find_windows(build_index(docs), items, width, slop=slop).select("doc_id", "n_words", "spans", "items")


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns, with no window of any item. Rows are told apart by a number of their own, so null and repeated ids are no matter."""
    rows, name = numbered(docs)
    index = build_index(rows.select(F.col(name).alias("doc_id"), "text"))
    hit = stage(find_windows(index, items, width).filter(F.size("spans") > 0).select(F.col("doc_id").alias(name)).distinct(), "hits")
    drop(index)
    return rows.filter(~chosen(rows, name, hit)).select(*docs.columns)
