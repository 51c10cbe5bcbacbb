"""Quality, toxicity and language: held-out accuracy, and texts that are null, empty, repeated or very long."""

import zlib

import numpy as np
import pytest

from descry.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.1"


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (None, "no id", "x"), (1, None, "x"), (2, "", "x"), (3, "The same.", "x"), (4, "The same.", "x"), (5, "word " * 400_000, "x"),
        (6, "12 34 !!", "x"), (7, "é" * 70_001, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_quality_held_out(spark, tables):
    docs, labels = tables
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert [bool(x) for x in got.held_out] == [crc(i, 4) == 2 for i in got.doc_id]
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    good = held[held.quality == 1]
    assert (good.predicted == 1).mean() > 0.98


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = toxicity.classify(docs, labels).toPandas()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    s, y = held.score.values, held.toxic.values == 1
    assert (s[y][:, None] > s[~y][None]).mean() > 0.85
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.97


def test_language_held_out(tables):
    docs, _ = tables
    got = language.identify(docs.limit(3000)).toPandas()
    held = got[got.held_out].merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.97


@pytest.mark.parametrize("model", ["quality", "toxicity", "language"])
def test_odd_rows(spark, odd, model):
    """Null ids aren't held out; nulls count as empty; repeated texts score alike; a clashing column is left aside."""
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    known = odd.selectExpr("*", "'en' as lang")
    got = {
        "quality": lambda: quality.classify(odd, labels), "toxicity": lambda: toxicity.classify(odd, labels),
        "language": lambda: language.identify(known),
    }[model]().toPandas()
    assert len(got) == 8 and got.score.between(0, 1).all()
    by = got.set_index("doc_id")
    assert by.loc[3, "score"] == by.loc[4, "score"] and not got[got.doc_id.isna()].held_out.iloc[0]
    if model == "language":
        assert set(got[got.doc_id.isin([1, 2, 6])].lang_pred) == {"und"}
        assert set(got[got.doc_id.isin([3, 5])].lang_pred) <= {"en", "und"}


def plain_score(net, text):
    """The network byte by byte: windows, half chunks, overlapping chunks, mean and maximum, one logistic unit."""
    halves = -(-(len(text) + quality.WIDTH) // quality.HALF)
    data = text + bytes(halves * quality.HALF - len(text))
    out = []
    for j in range(net.filters.shape[1]):
        tops = []
        for i in range(halves):
            values = []
            for p in range(quality.POSITIONS):
                at = i * quality.HALF + p * quality.STRIDE
                if at + quality.WIDTH <= len(data):  # a window stays in its text
                    values.append(sum(float(net.embed[data[at + k]] @ net.filters[k * quality.DIM : (k + 1) * quality.DIM, j]) for k in range(quality.WIDTH)))
            tops.append(max(0.0, max(values) + net.bias[j]))
        out.append([max(tops[i : i + 2]) for i in range(halves)])
    both = [sum(c) / halves for c in out] + [max(c) for c in out]
    return 1 / (1 + np.exp(-(np.array(both) @ net.head[:-1] + net.head[-1])))


def test_network_byte_by_byte(monkeypatch):
    rng = np.random.default_rng(3)
    net = quality.Net(
        rng.normal(size=(256, quality.DIM)).astype(np.float32), rng.normal(size=(quality.WIDTH * quality.DIM, 3)).astype(np.float32) / 9,
        rng.normal(size=3).astype(np.float32), rng.normal(size=7).astype(np.float32),
    )
    net.embed[0] = 0
    texts = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (0, 1, 15, 240, 241, 256, 700, 1300)]
    monkeypatch.setattr(quality, "BLOCK", 512)  # long texts go in pieces
    got = net.score(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.frombuffer(b"".join(texts), np.uint8))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)


def test_languages_of_short_or_long_texts_only(spark):
    """30 bytes a text, or 40,000: each language is learned and told apart."""
    import random

    rng = random.Random(4)
    words = {
        "de": "der die das und nicht mit sich auf ein eine".split(), "en": "the and that with this from have they which".split(),
        "fr": "le la les des une dans pour que qui avec".split(),
    }
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))[:n * 4]
    rows = [(i, say("de", 8)[:30], "de") for i in range(40)] + [(100 + i, say("en", 80), "en") for i in range(40)] + [(200 + i, say("fr", 10_000), "fr") for i in range(12)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    want = got.doc_id.map({i: x for i, _, x in rows})
    assert (got.lang_pred == want).mean() > 0.97


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == toxicity.classify(docs, labels).count() == language.identify(docs).count() == 0


def test_scores_do_not_depend_on_neighbours():
    rows = [("good words in a calm line " * 9, 1), ("BAD!! LINE!! " * 20, 0)] * 30
    net = quality.train(rows, 0.5)
    texts = [b"abc", b"", b"x" * 5000, "é".encode() * 300, b"tail"]
    whole = net.score(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.frombuffer(b"".join(texts), np.uint8))
    alone = [net.score(np.array([0, len(t)]), np.frombuffer(t, np.uint8))[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-6)
    assert net.score(np.array([0, 225]), np.frombuffer(rows[0][0].encode(), np.uint8)[:225])[0] > 0.5


def folded(text):
    return "".join(" " if c.isspace() or ord(c) < 32 or ord(c) == 127 else c.lower() if len(c.lower()) == 1 else c for c in text)


def plain_model(rows):
    """Kneser-Ney by dictionaries: rows of (text, toxic) -> {gram or context: ratio as a byte}."""
    n, d, order = [{}, {}], toxicity.DISCOUNT, toxicity.ORDER
    for text, toxic in rows:
        sym = " " * (order - 1) + folded(text or "")
        for i in range(len(sym) - order + 1):
            g = sym[i : i + order]
            n[toxic][g] = n[toxic].get(g, 0) + 1
    seen = set(n[0]) | set(n[1])
    levels = [seen]
    cont = {}
    for size in range(order - 1, 0, -1):
        now = {}
        for g in levels[-1]:
            now[g[1:]] = now.get(g[1:], 0) + 1
        cont[size] = now
        levels.append(set(now))

    def lower(g):
        now = cont[len(g)]
        group = {x: k for x, k in now.items() if x[:-1] == g[:-1]}
        total, types = sum(group.values()), len(group)
        below = 1 / (types + 1) if len(g) == 1 else lower(g[1:])
        return max(now[g] - d, 0) / total + d * types / total * below

    byte = lambda x: int(max(-127, min(127, np.floor(abs(x) * toxicity.SCALE + 0.5) * np.sign(x))))
    out = {}
    for g in seen:
        p, back = [], []
        for c in (0, 1):
            group = [k for x, k in n[c].items() if x[:-1] == g[:-1]]
            b = d * len(group) / sum(group) if group else 1.0
            p.append((max(n[c].get(g, 0) - d, 0) / sum(group) if group else 0) + b * lower(g[1:]))
            back.append(b)
        out[g] = byte(np.log(p[1]) - np.log(p[0]))
        out[g[:-1]] = byte(np.log(back[1]) - np.log(back[0]))
    return out


WILD = [
    "", "a", "Short TEXT", "a longer text\twith some words in it", "", "zz top", "\u0416\u0443\u0440 \u0436\u0443\u0440 \u65e5\u672c\u8a9e",
    "\u0130stanbul \U0001f914\U0001f914 e\u0301", None,
]


def test_kneser_ney_by_dictionaries(spark):
    rows = [(t, i % 2) for i, t in enumerate(WILD + ["the text is short", "\u0416\u0443\u0440 \u0436\u0430", "words in a text"])]
    got = toxicity.ratios(toxicity.count(spark.createDataFrame(rows, "text string, _label int"))).collect()
    want = plain_model(rows)
    assert {r.gram for r in got} == set(want) and all(abs(r.value - want[r.gram]) <= 1 for r in got)
    assert sum(r.value != want[r.gram] for r in got) <= 0.01 * len(got)


@pytest.mark.parametrize("most", [toxicity.MOST, 0])
def test_toxic_windows_by_brute_force(spark, most):
    """Whole texts and windows by dictionary, with the model broadcast and with the model joined."""
    rng = np.random.default_rng(1)
    grams = sorted({(" " * 4 + folded(t))[i : i + 5] for t in WILD if t for i in range(len(t))})
    known = {g: int(rng.integers(-20, 20)) for g in grams[::2]} | {g[:4]: int(rng.integers(-20, 20)) for g in grams[::3]}
    model = spark.createDataFrame(list(known.items()), "gram string, value byte")
    docs = spark.createDataFrame(list(enumerate(WILD)), "doc_id long, text string").selectExpr("*", "map('a', 1) as extra")
    got = {r.doc_id: r for r in toxicity.features(docs, model, "text", most).collect()}
    assert len(got) == len(WILD) and got[0].extra == {"a": 1}
    for i, text in enumerate(WILD):
        sym = " " * 4 + folded(text or "")
        v = [known.get(sym[k : k + 5], known.get(sym[k : k + 4], 0)) for k in range(len(sym) - 4)]
        n, span = len(v), toxicity.SPAN
        best = max((sum(v[k : k + span]) for k in range(max(1, n - span + 1))), default=0) / span / toxicity.SCALE
        assert np.isclose(got[i].mean, (sum(v) / n if n else 0) / toxicity.SCALE) and np.isclose(got[i].best, best)
