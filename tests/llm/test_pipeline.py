"""Each stage on its own input, and the whole."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers

from descry.llm import decontaminate

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and (ids is None or set(now) <= ids) and now
        ids = set(now)
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == ids


CLASHES = ["key", "h", "line", "row", "lines", "owner", "hits", "score", "family", "u", "size", "text2", "_id"]


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, copies and near copies, a benchmark item, columns of all sorts of names."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    item = line(30)
    base = [line(rng.randint(6, 40)) for _ in range(30)]
    texts = [None, "", " ", "\n\n", "x", line(9), line(9)]
    texts += ["\n".join(rng.choice(base) if rng.random() < 0.3 else line(rng.randint(2, 30)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    long = line(40_000)
    texts += [long, long + " " + line(3), item, line(20) + " " + item + " " + line(20), texts[10], texts[11] + " end"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[12], (13, line(30), "en", None, None), (None, line(12), None, None, None), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(CLASHES)]), item


def test_stages_by_plain_versions(spark, tmp_path):
    from test_duplicates import brute_lines
    from test_neardup import brute

    from descry.llm import bpe, quality

    docs, item = odd_docs(spark)
    spark.createDataFrame(
        [(k, item if k == 1 else "zzz yyy xxx www vvv uuu") for k in range(2)], "item_id long, text string",
    ).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = lambda d: sorted((str(r.doc_id), r.text or "") for r in d.collect())

    # quality: what the same network, one text at a time, scores below the threshold goes
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.fit(docs, labels)
    score = lambda t: net.score(np.array([0, len(t)]), np.frombuffer(t, np.uint8))[0]
    scores = [(i, t, score((t or "").encode())) for i, t in rows]
    got = stages["quality"](spark, docs, sf)
    assert got.columns == docs.columns and ids(got) == sorted((str(i), t or "") for i, t, s in scores if s >= 0.7)

    # lines: rows that share an id are one document, so the fixture for brute force has each id once
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    plain = {r.doc_id: r.text for r in once.collect()}
    want = brute_lines([(i, t) for i, t in plain.items() if t is not None])
    got = {r.doc_id: r.text for r in stages["line_dedup"](spark, once, sf).collect()}
    assert got == {i: "\n".join(x) for i, x in want.items() if x} | {i: None for i, t in plain.items() if t is None}
    assert stages["line_dedup"](spark, docs, sf).columns == docs.columns

    # near copies
    got = stages["near_dedup"](spark, once, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute(list(plain.items())).values())) and got.columns == docs.columns
    whole = stages["near_dedup"](spark, docs, sf)
    assert sorted(str(r.doc_id) for r in whole.collect())[-2:] == ["None", "None"]

    # benchmark
    got = stages["decontaminate"](spark, docs, sf)
    assert got.columns == docs.columns and ids(got) == sorted((str(i), t or "") for i, t in rows if item not in (t or ""))

    # tokens
    whole = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encoding
    got = sorted((str(r.doc_id), list(r.token_ids)) for r in stages["bpe"](spark, docs, sf).collect())
    assert got == sorted((str(i), whole.encode_ordinary(t or "")) for i, t in rows)

    none = docs.limit(0)
    assert all(stage(spark, none, sf).count() == 0 for stage in stages.values())


def test_the_benchmark_stage_fits_on_every_document(spark, tmp_path, monkeypatch):
    """Its vectors span the same space whatever the ids, as no sample is drawn by them, and documents that hold an item go."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(30)) for k in range(20)]
    texts = [say(40) + (" " + items[i // 100][1] if i % 100 == 0 else "") for i in range(2000)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fitted, latent = [], decontaminate.latent
    monkeypatch.setattr(decontaminate, "latent", lambda *a, **k: fitted.append(latent(*a, **k)) or fitted[-1])
    for shift in (0, 10**6):
        docs = spark.createDataFrame([(i + shift, t) for i, t in enumerate(texts)], "doc_id long, text string")
        kept = {r.doc_id - shift for r in corpus_pipeline.not_in_benchmark(spark, docs, str(tmp_path)).collect()}
        assert kept == {i for i in range(2000) if i % 100}
    (cols, one), (same, other) = fitted
    assert cols.tolist() == same.tolist() and np.abs(one @ (one.T @ other) - other).max() < 1e-3


def test_the_quality_stage_learns_from_every_labelled_text(spark, tmp_path):
    """Bad texts go of a kind that only labels beyond the first 1,200 in the order of a hash show, and of one that only texts beyond 256 KB show."""
    rng = random.Random(5)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    good, bad, late, long = "abcdefghijklm", "ABCDEFGHIJKLM", "nopqrstuvwxyz", "NOPQRSTUVWXYZ"
    order = [r[0] for r in spark.range(4000).where("crc32(binary(string(id))) % 4 <> 2").selectExpr("id", "xxhash64(11, id) as h").orderBy("h", "id").limit(2900).collect()]
    rows = [(i, int(k % 2 == 0), say(good if k % 2 == 0 else bad if k < 2400 else late, 20)) for k, i in enumerate(order)]
    others = [(10**6 + k, say(letters, 20)) for k, letters in enumerate([good, bad, late, long] * 25)]
    few = [(i, 1, t) for i, y, t in rows if y][:700] + [(i, 0, say(long, 50_000)) for i, y, _ in [r for r in rows if not r[1]][:12]]
    assert min(len(t) for _, y, t in few if not y) > 1 << 18
    for name, known, gone in (("late", rows, {1, 2}), ("long", few, {3})):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, y) for i, y, _ in known], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.createDataFrame([(i, t) for i, _, t in known] + others, "doc_id long, text string")
        kept = [r.doc_id - 10**6 for r in corpus_pipeline.good_quality(spark, docs, folder).where(f"doc_id >= {10**6}").collect()]
        left = {kind: sum(k % 4 == kind for k in kept) for kind in {0} | gone}
        assert left[0] >= 24 and all(left[kind] <= 1 for kind in gone), (name, left)
