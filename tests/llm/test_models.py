"""The mix, the classifier and the language model against brute force and held-out data."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from radonframe.llm import class_lm, gam, mixing, quality
from radonframe.llm.queries import op8_quality, op9_mixing, op10_class_lm


def size(text):
    return len([w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w])


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, done, targets = float(sum(sizes.values())), set(), {}
    while True:
        total = sum(w[s] for s in names if s not in done)
        over = [s for s in names if s not in done and left * w[s] / total > cap * sizes[s]]
        if not over:
            return targets | {s: left * w[s] / total for s in names if s not in done}
        for s in over:
            done.add(s)
            targets[s] = float(cap * sizes[s])
        left = float(sum(sizes.values())) - sum(targets.values())
        if done == set(names):
            return targets


def mix_is_right(rows, docs, near):
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r["doc_id"]), size(r["text"])) for r in docs)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_row = defaultdict(list)
    for r in docs:
        sizes[r["source"]] += size(r["text"])
        by_row[r["doc_id"], size(r["text"])].append(r["source"])
    for r in rows:
        s = by_row[r["doc_id"], r["size"]][0]
        assert r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - want[s]) <= near * max(want[s], 1)


def test_mix(spark, sf_dir, documents):
    rows = op9_mixing(spark, sf_dir).collect()
    mix_is_right(rows, documents.collect(), 0.05)  # ten documents a source
    fifty = "/root/testdata/sf0.01"
    mix_is_right(op9_mixing(spark, fifty).collect(), spark.read.parquet(f"{fifty}/documents.parquet").collect(), 0.005)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op9_mixing(spark, sf_dir).collect()))
    # rates are those of entropy balancing: min(3, exp(lambda * size)) with one lambda for a source
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    lam = defaultdict(set)
    for r in rows:
        if r["size"] and r["rate"] < 3 * (1 - 1e-9):
            lam[source[r["doc_id"]]].add(round(math.log(r["rate"]) / r["size"], 9))
    assert lam and all(max(v) - min(v) < 1e-8 for v in lam.values())


def test_mix_of_odd_rows(odd, none):
    rows, docs = mixing.mix_sources(odd).collect(), odd.collect()
    assert len(rows) == len(docs) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    taken = Counter()
    for r in rows:
        taken[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({d: n for d, n in taken.items() if n})
    kinds = {tuple(r) for r in docs}
    assert all(tuple(r) in kinds for r in out.collect())


def test_hot_cell_is_dealt_evenly(spark):
    docs = spark.createDataFrame([(k, "a b c", "s" if k < 900 else "t") for k in range(1000)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    mix_is_right(rows, docs.collect(), 0.01)
    copies = Counter((r["doc_id"] < 900, r["copies"]) for r in rows)
    assert {k for t, k in copies if t} <= {0, 1} and {k for t, k in copies if not t} == {3}


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_on_rows_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op8_quality(spark, sf_dir).toPandas().set_index("doc_id")
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in got["held_out"].items())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null").toPandas().set_index("doc_id")["quality"]
    held = got[got["held_out"]].join(labels, how="inner")
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.8


MARKS = set("*#$%&@^~_=+<>{}[]\\/")


def plain_features(text):
    """The classifier's numbers, character by character and word by word."""
    raw = (text or "").encode()
    text = raw.decode("latin-1")
    white = " \t\n\r\x0b\x0c"
    words = [w for w in "".join(" " if c in white else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(white)]
    n, chars = max(len(words), 1), max(len(text), 1)
    counts, triples = Counter(words), {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
    share = lambda test: sum(map(test, text)) / chars
    upper = lambda w: any("A" <= c <= "Z" for c in w) and not any("a" <= c <= "z" for c in w)
    kinds = [lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: ord(c) > 127, lambda c: c in white, lambda c: c in ",;:", lambda c: c == ".", lambda c: c == "!", lambda c: c == "|", lambda c: c in MARKS]
    other = lambda c: not any(k(c) for k in kinds) and not "a" <= c <= "z"
    sizes = [len(w) for w in words] or [0]
    return [
        math.log(len(words) + 1), sum(sizes) / len(sizes), max(sizes), sum(k <= 3 for k in sizes) / len(sizes), len(counts) / n, max(counts.values(), default=0) / n,
        1 - len(triples) / max(len(words) - 2, 1) if len(words) > 2 else 0.0, *map(share, kinds), share(other),
        math.log(len(lines) + 1), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), sum(x.rstrip(white)[-1:] in ".!?" for x in lines) / max(len(lines), 1),
        sum("A" <= w[0] <= "Z" for w in words) / n, sum(upper(w) and len(w) > 1 for w in words) / n, sum(w[-1] in MARKS or w[0] in MARKS for w in words) / n, len(words) / (text.count(".") + 1),
    ]


def test_quality_scores_are_sums_of_table_entries(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    assert model.pairs
    for r in docs.orderBy("doc_id").limit(200).collect():
        x = [float(np.float32(v)) for v in plain_features(r["text"])]
        at = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        total = model.intercept + sum(t[k] for t, k in zip(model.tables, at, strict=True))
        total += sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for i, j, t in model.pairs)
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-total)), rel_tol=1e-6)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(d, d % 2, "x") for d in range(1, 11)] + [(1, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_documents(none, labels).count() == 0
    assert len({r["score"] for r in quality.score_documents(odd, labels.limit(0)).collect()}) == 1
    kept = quality.keep_documents(odd, labels)
    assert kept.columns == odd.columns
    want = Counter(r["doc_id"] for r in rows if r["predicted"])
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_gam_finds_an_interaction():
    x = np.random.default_rng(0).normal(size=(6000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:4000], y[:4000])
    assert auc(model.score(x[4000:]), y[4000:]) > 0.95
    assert (0, 1) in {(min(i, j), max(i, j)) for i, j, _ in model.pairs}


def lm_tokens(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w] + ["\n"]


def lm_base_is_right(rows, docs):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for r in docs if not held(r["doc_id"]) for w in lm_tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in docs:
        t = lm_tokens(r["text"])
        want.append((str(r["doc_id"]), held(r["doc_id"]), len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_language_model(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op10_class_lm(spark, sf_dir).collect()
    lm_base_is_right(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_odd_rows(spark, odd, none):
    lm_base_is_right(class_lm.score_documents(odd).collect(), odd.collect())
    assert class_lm.score_documents(none).count() == 0
    alone = spark.createDataFrame([(d, "x y") for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in class_lm.score_documents(alone).collect())


def test_probabilities_sum_to_one(spark):
    words = [*"abcdefgh", "unknown"]
    rng = np.random.default_rng(0)
    held = [d for d in range(2000) if zlib.crc32(str(d).encode()) % 10 == 0]
    train = [(d, " ".join(rng.choice(words[:-1], 12))) for d in range(300) if d not in held]
    texts = ["", *words, *(f"{a} {b}" for a in words for b in words)]
    test = dict(zip(held, texts, strict=False))
    rows = class_lm.score_documents(spark.createDataFrame([*train, *test.items()], "doc_id long, text string"), core_size=4, classes=3).collect()
    p = {test[r["doc_id"]]: 10 ** r["score"] for r in rows if r["held_out"]}
    # with u(a) = 1 / P(end | a): p("a b") / p("a") = P(b | a) u(a) / u(b), and what follows a sums to 1
    ratios = np.array([[p[f"{a} {b}"] / p[a] for b in words] for a in words])
    u = np.linalg.solve(np.eye(len(words)) - ratios, np.ones(len(words)))
    assert math.isclose(p[""] + sum(p[a] * x for a, x in zip(words, u, strict=True)), 1, rel_tol=1e-9)  # what starts a text


def brute_class_lm(docs, core_size, classes):
    """Scores by id, every exchange move judged by the whole likelihood."""
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    texts = {d: lm_tokens(t) for d, t in docs}
    train = [t for d, t in texts.items() if not held(d)]
    count, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["\n", *t[:-1]], t, strict=True))
    words = sorted(count, key=lambda w: (w != "\n", -count[w], w.encode()))[:core_size]
    place = {w: k for k, w in enumerate(words)}
    core = {(place[a], place[b]): n for (a, b), n in pairs.items() if a in place and b in place}

    def table(kind, of):
        both = np.zeros((classes, classes))
        for (a, b), n in of.items():
            both[kind[a], kind[b]] += n
        return both

    x = lambda v: (v * np.log(np.maximum(v, 1e-300))).sum()

    def likelihood(kind):
        both = table(kind, core)
        return x(both) - x(both.sum(0)) - x(both.sum(1))

    kind = [k % classes for k in range(len(words))]
    for _ in range(class_lm.PASSES):
        moved = 0
        for w in range(len(words)):
            at = [likelihood([*kind[:w], k, *kind[w + 1 :]]) for k in range(classes)]
            best = kind[w] if at[kind[w]] >= max(at) - 1e-9 else int(np.argmax(at))
            moved, kind[w] = moved + (best != kind[w]), best
        if moved <= len(words) // 200:
            break

    def moves(both):
        own = (both.sum(0) + 1) / (both.sum(0) + 1).sum()
        return (both + 2 * own) / (both.sum(1, keepdims=True) + 2), own

    p, own = moves(table(kind, core))
    of = {w: kind[k] for w, k in place.items()}
    fixed = dict(of)
    logs, log_own = np.round(np.log(p) * 65536), np.round(np.log(own) * 65536)
    for w in count:
        if w not in fixed:
            gain, seen = -count[w] * log_own, 0
            for (a, b), n in pairs.items():
                if b == w and a in fixed:
                    gain, seen = gain + n * logs[fixed[a]], 1
                if a == w and b in fixed:
                    gain, seen = gain + n * logs[:, fixed[b]], 1
            of[w] = int(np.argmax(gain if seen else log_own))
    p, _ = moves(table(of, pairs))
    mass = np.array([sum(count[w] + 0.1 for w in of if of[w] == k) + 0.1 for k in range(classes)])
    score = {}
    for d, t in texts.items():
        total = 0.0
        known = [w in count for w in t]
        for k, (a, b) in enumerate(zip(["\n", *t[:-1]], t, strict=True)):
            if k and not known[k - 1]:
                q = (table(of, pairs).sum(0) + 1) / (table(of, pairs).sum(0) + 1).sum()
            else:
                q = p[of[a]]
            total += math.log10(q[of[b]] * (count[b] + 0.1) / mass[of[b]] if known[k] else (q * 0.1 / mass).sum())
        score[d] = total
    return score


def test_scores_equal_those_of_a_brute_force_model(spark):
    docs = [(r["doc_id"], " ".join((r["text"] or "").split()[:40])) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()]
    rows = class_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), core_size=40, classes=4, block_tokens=500).collect()
    want = brute_class_lm(docs, 40, 4)
    assert len(rows) == len(want) and all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in rows)


def test_scores_do_not_depend_on_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    once = {r["doc_id"]: (r["score"], r["base_score"]) for r in class_lm.score_documents(docs.repartition(1)).collect()}
    for parts, tokens in ((7, 1 << 18), (50, 1000)):
        rows = class_lm.score_documents(docs.repartition(parts), block_tokens=tokens).collect()
        assert len(rows) == len(once) and all(math.isclose(r[k], once[r["doc_id"]][j], rel_tol=1e-9) for r in rows for j, k in enumerate(("score", "base_score")))


def test_exchange_gain_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    n, classes = 40, 4
    true = rng.integers(0, classes, n)
    table = rng.dirichlet(np.ones(classes) * 0.3, classes)
    counts = np.array([[rng.poisson(20 * table[true[a], true[b]]) for b in range(n)] for a in range(n)])
    a, b = np.nonzero(counts)
    kind = class_lm.exchange(a, b, counts[a, b], n, classes)

    def likelihood(k):
        both = np.zeros((classes, classes))
        np.add.at(both, (k[a], k[b]), counts[a, b])
        x = lambda v: (v * np.log(np.maximum(v, 1e-300))).sum()
        return x(both) - x(both.sum(0)) - x(both.sum(1))

    best = likelihood(kind)
    assert best >= likelihood(np.arange(n) % classes)
    for w in range(n):  # nearly all words are where a single move would put them
        for k in range(classes):
            other = kind.copy()
            other[w] = k
            assert likelihood(other) <= best + 1e-6 * abs(best)


@pytest.mark.parametrize("counts", [np.zeros((3, 3)), np.arange(9.0).reshape(3, 3)])
def test_transitions_are_distributions(counts):
    assert np.allclose(class_lm.transitions(counts).sum(axis=1), 1)
