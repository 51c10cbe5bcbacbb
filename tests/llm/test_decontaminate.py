"""Benchmark passages: planted copies and paraphrases are found, clean texts aren't."""

import random

import numpy as np
import pytest

from descry.llm import decontaminate


@pytest.fixture(scope="module")
def world():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, say(rng.randint(15, 70))) for i in range(150)]
    docs, truth = [], {}
    for i in range(400):
        text = say(rng.randint(5, 400))
        truth[i] = set()
        if i % 4 == 0:
            k, own = rng.choice(items)
            own = own[:]
            if i % 8 == 0:  # a paraphrase
                for _ in range(len(own) // 10):
                    own[rng.randrange(len(own))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = own
            truth[i] = {k}
        joiner = rng.choice([" ", "!! ", "\n"])
        docs.append((i, joiner.join(text).upper() if i % 5 == 0 else joiner.join(text)))
    return docs, [(k, " ".join(w)) for k, w in items], truth


@pytest.mark.parametrize("block", [decontaminate.ITEMS, 40])
def test_search(spark, world, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", block)
    docs, items, truth = world
    rows = [*docs, (1000, None), (1001, ""), (1002, "?!"), (None, docs[1][1]), (4, docs[4][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as contaminated")
    got = decontaminate.search(frame, spark.createDataFrame([*items, (999, None), (998, "")], "item_id long, text string")).toPandas()
    assert len(got) == len(rows)
    found = {r.doc_id: set(r.item_ids) for r in got.itertuples() if r.doc_id == r.doc_id}
    hits = sum(bool(truth[i] & found[i]) for i in truth if truth[i])
    assert hits >= 0.97 * sum(bool(t) for t in truth.values())
    assert all(found[i] <= truth[i] for i in truth)
    assert not any(found[i] for i in (1000, 1001, 1002))


def test_recall_of_the_index_against_brute_force(spark, world):
    """Nine in ten pairs whose exact TF-IDF cosine reaches the threshold are candidates in latent space, of fewer dimensions than items."""
    docs, items, _ = world
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    seen, total = decontaminate.frequencies(frame, "text")
    idf = decontaminate.weights_of(seen, total)
    cols, basis = decontaminate.latent(spark, decontaminate.sample_of(frame, "doc_id", "text"), items, idf)
    index = decontaminate.Index(items, idf, cols, basis)
    exact = np.zeros((len(cols), len(items)), np.float32)
    for k, s in enumerate(index.sequences):
        b = decontaminate.bucket(s)
        np.add.at(exact[:, k], np.searchsorted(cols, b), idf[b] / np.linalg.norm(idf[b]))
    kept = lost = 0
    for _, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        h, first = decontaminate.words(np.array([0, len(raw)]), raw)
        begin, more, _ = decontaminate.blocks(first)
        for a, m in zip(begin, more, strict=True):
            b = decontaminate.bucket(h[a : a + decontaminate.BLOCK * (1 + m)])
            w, r = idf[b].astype(np.float32), index.row[b]
            w, r, norm = w[r >= 0], r[r >= 0], np.linalg.norm(w)
            true, ours = (w @ exact[r]) / norm, (w @ index.table[r]) / norm
            near = true >= decontaminate.COSINE
            kept += (ours[near] >= decontaminate.LATENT).sum()
            lost += (ours[near] < decontaminate.LATENT).sum()
    assert kept / (kept + lost) >= 0.9 and basis.shape[1] < len(items) < len(cols)


def test_keep_clean(spark, world):
    docs, items, truth = world
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = set(decontaminate.keep_clean(frame, bench).toPandas().doc_id)
    assert {i for i, t in truth.items() if not t} <= kept
    assert decontaminate.keep_clean(frame, bench.limit(0)).count() == len(docs)
    assert decontaminate.search(frame.limit(0), bench).count() == 0


def test_items_of_all_lengths(spark, world):
    """Verbatim copies of very short and long items are found at any place, and a long item with a tenth of its words changed."""
    docs, _, _ = world
    rng = random.Random(12)
    new = lambda n: ["".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    common = "the of and to in".split()
    items = [[w if rng.random() < 0.6 else rng.choice(common) for w in new(n)] for n in (1, 2, 3, 5, 12, 16, 73, 100, 130, 161, 300, 2000)]
    items[:3] = [new(1), new(2), new(3)]
    rows, truth = list(docs), {}
    for k, own in enumerate(items):
        for place in range(7):
            text = rng.choice(docs)[1].lower().split()[: 17 * place]
            changed = own[:]
            if place == 6 and len(own) > 50:
                for i in range(0, len(own), 10):
                    changed[i] = "changed"
            i = 5000 + 10 * k + place
            rows.append((i, " ".join(text + changed + rng.choice(docs)[1].lower().split())))
            truth[i] = k
    # half of a long item, and words of a short one far apart in other text, aren't copies
    rows += [(9000, " ".join(items[10][:150])), (9001, " ".join(" ".join([w, *new(20)]) for w in items[2]))]
    got = decontaminate.search(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"),
    )
    found = {r.doc_id: set(r.item_ids) for r in got.collect()}
    assert {i: truth[i] for i in truth if truth[i] not in found[i]} == {}
    assert (found[9000], found[9001], {i: found[i] for i, _ in docs if found[i]}) == (set(), set(), {})


def test_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randint(0, 12))], [rng.randrange(5) for _ in range(rng.randint(0, 12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.subsequence(a, b) == best[-1][-1]


def test_the_end_of_a_very_long_text(spark):
    """An item at the end of 4 MB is found, and 4 MB without one are clean; ids that repeat, columns with clashing names."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(600_000))
    item = " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(40))
    docs = spark.createDataFrame(
        [(1, long + " " + item), (2, long), (2, None), (3, item)], "doc_id long, text string",
    ).selectExpr("*", "1 as hits", "2 as share", "3 as item_ids")
    bench = spark.createDataFrame([(7, item), (7, item), (None, "x")], "item_id long, text string")
    assert sorted((r.doc_id, r.contaminated) for r in decontaminate.search(docs, bench).collect()) == [(1, True), (2, False), (2, False), (3, True)]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [2, 2]


def test_the_vectors_are_fitted_on_all_documents(spark, world, monkeypatch):
    """The basis is what dense power iterations over every block give: many rows, a text beyond 64 KB, null ids, repeated rows; sums handed on early."""
    docs, items, _ = world
    rng = random.Random(6)
    rows = [(10 * i, " ".join(t.split()[:30])) for i, t in docs for _ in range(4)]
    rows += [(7, " ".join(rng.choice(["alongside", *items[0][1].split()]) for _ in range(15_000))), (None, " ".join(["withoutid", *items[1][1].split()] * 100)), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, total = decontaminate.frequencies(frame, "text")
    idf = decontaminate.weights_of(seen, total)
    for name, value in {"ENTRIES": 500, "HELD": 3000, "SLAB": 9000}.items():
        if hasattr(decontaminate, name):
            monkeypatch.setattr(decontaminate, name, value)
    cols, basis = decontaminate.latent(spark, decontaminate.sample_of(frame, "doc_id", "text"), items, idf)

    def matrix(texts):
        raw = [(t or "").encode() for t in texts]
        h, first = decontaminate.words(np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8))
        begin, _, _ = decontaminate.blocks(first)
        out = np.zeros((len(begin), decontaminate.SIZE), np.float32)
        b = decontaminate.bucket(h)
        np.add.at(out, (np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h)))), b), idf[b])
        norm = np.sqrt([(idf[x] ** 2).sum() for x in np.split(b, begin[1:])])
        return (out / norm[:, None])[:, cols]

    hashed = lambda t: decontaminate.bucket(decontaminate.words(np.array([0, len(t)]), np.frombuffer(t.encode(), np.uint8))[0])[0]
    assert {hashed("alongside"), hashed("withoutid")} <= set(cols.tolist())
    a, own = matrix([t for _, t in rows]), matrix([t for _, t in items])
    assert len(a) == total
    square = a.T @ a + own.T @ own * (decontaminate.ITEMS_WEIGH * total / len(own))
    q = np.random.default_rng(5).normal(size=basis.shape).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(square @ q)
    assert np.abs(basis @ (basis.T @ q) - q).max() < 1e-3
