"""Class-based bigram language model: Brown classes by exchange clustering, and the scores of whole texts.

P(word | previous) = P(class of word | class of previous) * P(word | class of word), both smoothed; a word that training did not
have is one further kind of word in every class, so its probability sums over the classes.

1. Blocks: tasks turn documents into blocks of about ``BLOCK_TOKENS`` tokens, each with a vocabulary of its own, stored once.
   What moves later are rows per block and distinct word, not per token.
2. Exchange: the ``CORE`` most frequent words of all training documents move between ``CLASSES`` classes while that raises the
   likelihood of their bigrams. Their bigram counts, at most CORE ** 2 sums whatever the corpus, are what the driver gets.
3. All other words, however many: each gets the class that an exchange step would give it. Its neighbours' classes are counted over
   all blocks (at most 2 * CLASSES numbers a word), and the class with the largest gain wins. Counts are whole
   numbers and log probabilities multiples of 2 ** -16, so the sums, and the classes, do not depend on how rows fall into blocks.
4. Counts and classes are joined to the blocks' vocabularies. Class bigrams of all training tokens give the transitions, and the
   same blocks are scored as arrays.

``base_score`` is the unigram score the model is compared with: additive smoothing with 0.1 over all training tokens.

No key is hot: rows are keyed by word or block, and a word has one row for each block, of the tens of thousands that a block has.
A task holds one block at a time and works on slices of about ``SLICE_TOKENS`` tokens; a text is within one slice, so the longest text bounds both.

Defined cases: null and empty texts are one end token; a null id is a training document; repeated rows are documents of their own; with no
training documents every word is unknown; an empty table gives an empty result; further columns are ignored; equally good classes go to the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stage

FOLDS = 10
BLOCK_TOKENS = 1 << 22  # large, since a word has a row for each block that has it
SLICE_TOKENS = 1 << 18
CORE = 2048
CLASSES = 64
PASSES = 12
ADD = 0.1
UNIT = 1 << 16  # of a log probability; sums below 2 ** 53 are exact
PRIOR = 2.0  # pseudo-count of a class's transitions, spread like the classes themselves
END = b"\n"
_COLUMNS = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "tokens": pa.binary(), "vocabulary": pa.list_(pa.binary()), "counts": pa.list_(pa.int32())}
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, vocabulary array<binary>, counts array<int>"


def words(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def packed(tokens: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones, compressed: blocks travel and lie in half of their size."""
    return zstandard.compress(np.ascontiguousarray(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpacked(data: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _build(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[bool] = []
        numbers: list[np.ndarray] = []
        vocabulary: dict[bytes, int] = {END: 0}
        block, n = TaskContext.get().partitionId() << 32, 0

        def flush() -> pa.RecordBatch:
            sizes = [len(x) for x in numbers]
            tokens = np.concatenate(numbers)
            train = tokens[np.repeat(~np.array(held, bool), sizes)]
            row = [block, list(ids), list(held), sizes, packed(tokens), list(vocabulary), np.bincount(train, minlength=len(vocabulary)).tolist()]
            ids.clear(), held.clear(), numbers.clear(), vocabulary.clear()
            vocabulary[END] = 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _COLUMNS.values(), strict=True)], list(_COLUMNS))

        for b in batches:
            for d, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = words(text.as_py())
                ids.append(d)
                held.append(h)
                numbers.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in own), np.int32, len(own)))
                n += len(own)
                if n >= block_tokens:
                    yield flush()
                    block, n = block + 1, 0
        if ids:
            yield flush()

    return run


def build_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """All documents (doc_id, held_out, text) as staged blocks, each in exactly one."""
    return stage(docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(_build(block_tokens), BLOCKS), "lm-blocks")


def _slices(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, previous tokens, whether in training, start of each document) of a block's documents, slice by slice; a document's first token follows an end token."""
    tokens, sizes = unpacked(row["tokens"]), row["sizes"].to_numpy().astype(np.int64)
    train, ends = ~row["held"].to_numpy(zero_copy_only=False).astype(bool), np.cumsum(sizes)
    cuts = np.append(np.flatnonzero(np.diff((ends - sizes) // SLICE_TOKENS, prepend=-1)), len(sizes))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo = ends[a] - sizes[a]
        own, starts = tokens[lo : ends[b - 1]], ends[a:b] - sizes[a:b] - lo
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[starts] = 0
        yield own, before, np.repeat(train[a:b], sizes[a:b]), starts


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks of the batches one by one, lists as Arrow arrays and tokens as a buffer."""
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(name)[k].values if pa.types.is_list(b.schema.field(name).type) else b.column(name)[k].as_buffer() for name in b.schema.names}


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, c) of all training tokens."""
    return blocks.select(F.inline(F.arrays_zip("vocabulary", "counts"))).filter("counts > 0").groupBy(F.col("vocabulary").alias("word")).agg(F.sum("counts").alias("c"))


def core_words(blocks: DataFrame, core: int = CORE) -> dict[bytes, int]:
    """The words that exchange clustering works on with their counts, most frequent first after the end token; ties by word."""
    top = word_counts(blocks).orderBy(F.col("word") != F.lit(END), F.desc("c"), "word").limit(core)
    return {END: 0} | {bytes(r["word"]): r["c"] for r in top.collect()}


def _at(vocabulary: pa.Array, words: pa.Array) -> np.ndarray:
    """The place of each word of a vocabulary in ``words``, -1 where it is not there."""
    return pc.fill_null(pc.index_in(vocabulary, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(columns: dict[str, np.ndarray | pa.Array], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=rows)


def _pair_counts(words: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, size = pa.array(words, pa.binary()), len(words)
        counts = np.zeros(size * size, np.int64)  # 32 MB
        for row in _rows(batches):
            at = _at(row["vocabulary"], core)
            for tokens, before, train, _ in _slices(row):
                a, b = at[before], at[tokens]
                both = train & (a >= 0) & (b >= 0)
                pair, n = np.unique(a[both] * size + b[both], return_counts=True)
                counts[pair] += n
        seen = np.flatnonzero(counts)
        yield from _flat({"pair": seen, "n": counts[seen]})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Classes of ``size`` words from their bigram counts n[k] of words a[k], b[k], by exchange: each word in turn goes to the class where the bigram likelihood of the classes is highest."""
    kind = np.arange(size) % classes
    self_n = np.bincount(a[a == b], n[a == b], size)
    other = a != b
    a, b, n = a[other], b[other], n[other].astype(float)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    ends_a, ends_b = np.searchsorted(a[by_a], np.arange(size + 1)), np.searchsorted(b[by_b], np.arange(size + 1))
    both = np.bincount(kind[a] * classes + kind[b], n, classes**2).reshape(classes, classes) + np.diag(np.bincount(kind, self_n, classes))
    left, right = both.sum(axis=1), both.sum(axis=0)
    every = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for w in range(size):
            after, ahead = by_a[ends_a[w] : ends_a[w + 1]], by_b[ends_b[w] : ends_b[w + 1]]
            out, into, own = np.bincount(kind[b[after]], n[after], classes), np.bincount(kind[a[ahead]], n[ahead], classes), self_n[w]
            k = kind[w]
            both[k] -= out
            both[:, k] -= into
            both[k, k] -= own
            left[k] -= out.sum() + own
            right[k] -= into.sum() + own
            gain = (_xlogx(both + out) - _xlogx(both)).sum(axis=1) + (_xlogx(both + into[:, None]) - _xlogx(both)).sum(axis=0)
            d = both[every, every]
            gain += _xlogx(d + out + into + own) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
            gain -= _xlogx(left + out.sum() + own) - _xlogx(left) + _xlogx(right + into.sum() + own) - _xlogx(right)
            new = k if gain[k] >= gain.max() - 1e-9 else int(np.argmax(gain))
            both[new] += out
            both[:, new] += into
            both[new, new] += own
            left[new] += out.sum() + own
            right[new] += into.sum() + own
            kind[w] = new
            moved += new != k
        if moved <= size // 200:
            break
    return kind


def transitions(counts: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed towards the classes' own frequencies; one more row, those frequencies, follows unknown words."""
    own = counts.sum(axis=0) + 1.0
    own /= own.sum()
    return np.vstack([(counts + PRIOR * own) / (counts.sum(axis=1, keepdims=True) + PRIOR), own])


_CONTEXT = np.dtype([("at", "u1"), ("n", "<u4")])  # class of a neighbour, ahead of the word or (from the number of classes on) after it


def _contexts(words: list[bytes], kinds: np.ndarray, classes: int):
    """(word, c, near) of each other word of a block in training: its count and its neighbours' classes, where those are core words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, kind = pa.array(words, pa.binary()), np.append(kinds, -1)
        for row in _rows(batches):
            known = kind[_at(row["vocabulary"], core)]
            c, keys = np.zeros(len(known), np.int64), []
            for tokens, before, train, _ in _slices(row):
                at = np.flatnonzero(train & (known[tokens] < 0))
                word = tokens[at].astype(np.int64)
                ahead, after = known[before[at]], known[tokens[at + 1]]  # a document's last token is the end token, which is a core word
                keys += [word[ahead >= 0] * 2 * classes + ahead[ahead >= 0], (word[after >= 0] * 2 + 1) * classes + after[after >= 0]]
                c += np.bincount(word, minlength=len(known))
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            near = np.empty(len(key), _CONTEXT)
            near["at"], near["n"] = key % (2 * classes), n
            own = np.flatnonzero(c)
            ends = np.searchsorted(key, (own + 1) * 2 * classes) * _CONTEXT.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(near.tobytes())])
            yield from _flat({"word": row["vocabulary"].take(pa.array(own)), "c": c[own], "near": packed}, 1 << 14)

    return run


def _chosen(moves: np.ndarray):
    """(word, c, class) of rows (word, c, near) in order of words: the class with the largest gain of an exchange step."""
    classes = moves.shape[1]
    units = np.round(moves * UNIT)  # floats with whole values, which add up exactly
    gains, own = np.vstack([units[:classes], units[:classes].T]), units[classes]

    def classed(words: pa.Array, c: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        bare = ~near.any(axis=1)
        best = np.where(bare, np.argmax(own), np.argmax(near @ gains - c[:, None] * own, axis=1))
        yield from _flat({"word": words, "c": c, "class": best.astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_c, last_near = None, 0, np.zeros(2 * classes)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 14):
                b = whole.slice(lo, 1 << 14)
                place = b.column(0).dictionary_encode()
                rows, words = place.indices.to_numpy(), place.dictionary
                packed = np.frombuffer(b"".join(b.column(2).to_pylist()), _CONTEXT)
                of = np.repeat(rows, pc.binary_length(b.column(2)).to_numpy() // _CONTEXT.itemsize)
                near = np.bincount(of.astype(np.int64) * 2 * classes + packed["at"], packed["n"], len(words) * 2 * classes).reshape(-1, 2 * classes)
                c = np.bincount(rows, b.column(1).to_numpy(), len(words)).astype(np.int64)
                if last is not None and words[0] == last:
                    c[0] += last_c
                    near[0] += last_near
                elif last is not None:
                    yield from classed(pa.array([last.as_py()], pa.binary()), np.array([last_c]), last_near[None, :])
                last, last_c, last_near = words[len(words) - 1], c[-1], near[-1].copy()
                yield from classed(words[:-1], c[:-1], near[:-1])
        if last is not None:
            yield from classed(pa.array([last.as_py()], pa.binary()), np.array([last_c]), last_near[None, :])

    return run


def _class_pairs(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes * classes, np.int64)
        for row in _rows(batches):
            kind = row["found"].to_numpy() % classes
            for tokens, before, train, _ in _slices(row):
                n += np.bincount(kind[before[train]] * classes + kind[tokens[train]], minlength=classes * classes)
        at = np.flatnonzero(n)
        yield from _flat({"pair": at, "n": n[at]})

    return run


@dataclass(frozen=True)
class Model:
    tokens: int
    distinct: int
    moves: np.ndarray  # log10 of transitions
    unknown: np.ndarray  # log10 probability of an unknown word by class before
    totals: np.ndarray  # smoothed emission denominators by class


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = len(model.totals)
        for row in _rows(batches):
            found = row["found"].to_numpy()
            c, kind = (found // classes).astype(float), np.where(found < classes, classes, found % classes)  # one further class of unknown words
            base = np.log10((c + ADD) / (model.tokens + ADD * (model.distinct + 1)))
            emit = np.where(c > 0, np.log10((c + ADD) / np.append(model.totals, 1.0)[kind]), 0.0)
            moves, first = np.hstack([model.moves, model.unknown[:, None]]), 0
            for tokens, before, _, starts in _slices(row):
                each = moves[kind[before], kind[tokens]] + emit[tokens]
                sums = [np.add.reduceat(x, starts) for x in ((c > 0)[tokens].astype(np.int64), base[tokens], each)]
                ids, held, sizes = (row[k].slice(first, len(starts)) for k in ("doc_ids", "held", "sizes"))
                first += len(starts)
                yield from _flat({
                    "doc_id": ids, "held_out": held, "n_tokens": sizes.cast(pa.int64()), "n_known": sums[0],
                    "train_tokens": np.full(len(starts), model.tokens), "base_score": sums[1], "score": sums[2],
                })

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, core_size: int = CORE, classes: int = CLASSES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    if not 0 < classes <= 128:
        raise ValueError("a neighbour's class and side are one byte")
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    blocks = build_blocks(docs.select("doc_id", held.alias("held_out"), "text"), block_tokens)
    core = core_words(blocks, core_size)
    words, size = list(core), len(core)
    texts = blocks.select("tokens", "sizes", "held", "vocabulary")
    pairs = texts.mapInArrow(_pair_counts(words), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().sort_by("pair")
    key, n = pairs.column("pair").to_numpy(), pairs.column("n").to_numpy()
    classes = min(classes, size)
    kind = exchange(key // size, key % size, n, size, classes)
    counts = np.bincount(kind[key // size] * classes + kind[key % size], n, classes**2).reshape(classes, classes)

    near = texts.mapInArrow(_contexts(words, kind, classes), "word binary, c long, near binary")
    others = near.repartition("word").sortWithinPartitions("word").mapInArrow(_chosen(np.log(transitions(counts))), "word binary, c long, class int")
    own = spark.createDataFrame(pa.table({"word": pa.array(words, pa.binary()), "c": pa.array(list(core.values()), pa.int64()), "class": pa.array(kind.astype(np.int32))})).filter("c > 0")
    known = stage(others.unionByName(own), "lm-words")

    # a word's count times the number of classes, plus its class: one number for each place of a block's vocabulary
    spelt = blocks.select("block", F.posexplode("vocabulary").alias("at", "word"))
    found = spelt.join(known.select("word", (F.col("c") * classes + F.col("class")).alias("found")), "word", "left")
    found = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("found", F.lit(0)).alias("found"))))["found"].alias("found"))
    looked_up = stage(blocks.drop("vocabulary", "counts").join(found, "block"), "lm-blocks")
    totals, kinds, moved = np.zeros(classes), np.zeros(classes), np.zeros(classes**2)
    tokens = 0
    for r in known.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens, totals[r["class"]], kinds[r["class"]] = tokens + r["c"], r["c"], r["v"]
    drop(blocks, known)
    for r in looked_up.select("tokens", "sizes", "held", "found").mapInArrow(_class_pairs(classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        moved[r["pair"]] = r["n"]
    moves, totals = transitions(moved.reshape(classes, classes)), totals + ADD * (kinds + 1)
    model = Model(tokens, int(kinds.sum()), np.log10(moves), np.log10(moves @ (ADD / totals)), totals)
    return looked_up.select("doc_ids", "held", "sizes", "tokens", "found").mapInArrow(
        _score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
