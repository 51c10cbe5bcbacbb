"""Lines, fingerprints, SimHash and URL rules against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from descry.llm import components, linededup, orderminhash, simhash, urlfilter
from descry.llm.queries import URL_RULES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n, alphabet="xyz"):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = rng.choice(alphabet)
        elif kind < 0.7:
            out.insert(k, rng.choice(alphabet))
        elif len(out) > 5:
            del out[k]
    return "".join(out)


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    while len(pairs) < 800:
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 30)))
        b = changed(rng, a, rng.randint(0, 5), "abc")
        if 0 <= len(b) - len(a) <= 2:
            pairs.append((a, b))
    chars = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    both = [linededup.within(chars("a"), chars("b")).alias("near"), linededup.near(F.col("a"), F.col("b")).alias("trimmed")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *both).collect()
    assert all(r.near == r.trimmed == (edits(r.a, r.b) <= 2) for r in got) and any(r.near for r in got) and not all(r.near for r in got)


def brute_lines(docs, most=2, least=20):
    first = {}
    kept = {}
    for i, t in docs:
        seen = list(dict.fromkeys(x if re.search(r"[^\W_]", x) else f"{k}\n{x}" for k, x in enumerate(t.split("\n"))))
        for k, x in enumerate(seen):
            if "\n" not in x:
                first[x] = min(first.get(x, (1 << 60, 0)), (i, k))
    near = {
        x for x in first if len(x) >= least and any(
            y != x and len(y) >= least and abs(len(x) - len(y)) <= most and first[y] < first[x] and edits(x, y) <= most for y in first
        )
    }
    for i, t in docs:
        out, seen = [], set()
        for x in t.split("\n"):
            if x not in first or (x not in seen and x not in near and first[x][0] == i):
                out.append(x)
            seen.add(x)
        kept[i] = out
    return kept


@pytest.mark.parametrize(("often", "head"), [(linededup.OFTEN, ""), (2, ""), (4, "a beginning of many lines, ")])
def test_line_dedup(spark, often, head, monkeypatch):
    """Equal to brute force, also where nearly all keys, or those of a common beginning, count as hot."""
    monkeypatch.setattr(linededup, "OFTEN", often)
    rng = random.Random(4)
    base = [head + "".join(rng.choice("abcdeé ") for _ in range(rng.randint(12, 40))) for _ in range(25)]
    docs = [(i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randint(1, 5)))) for i in range(90)]
    want = brute_lines(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "'clash' as line", "0L as n_chars", "'z' as id", "1 as gone", "2 as n_same", "3 as n_near", "4 as row", "5 as lines", "6 as t",
    )
    got = {r.doc_id: r for r in linededup.report(frame).collect()}
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256("\n".join(x).encode()).hexdigest() for i, x in want.items()}
    assert all(got[i].n_kept == len(x) for i, x in want.items()) and sum(r.n_near for r in got.values()) > 0
    new = {r.doc_id: r for r in linededup.rewrite(frame).collect()}
    assert {i: r.text for i, r in new.items()} == {i: "\n".join(x) for i, x in want.items() if x}
    assert all(r.n_chars == len(r.text) for r in new.values()) and frame.columns == linededup.rewrite(frame).columns


def test_line_dedup_odd_rows(spark):
    long = "a line that is long enough to count"
    rows = [
        (1, None), (2, ""), (3, long), (4, long + "\n" + long + "!"), (5, "short\nshort"), (3, long), (None, long),
        (6, "\n".join(f"line number {i} of a very long text {i * i}" for i in range(3000))),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_kept) for r in linededup.report(frame).collect()]
    assert sorted(got, key=str)[:8] and {g for g in got if g[0] != 6} == {(1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 2, 0), (5, 2, 1), (None, 1, 0)}
    assert linededup.rewrite(frame).where("doc_id = 1").count() == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.report(none).count() == 0


def test_a_beginning_of_all_lines(spark):
    """20,000 different lines of text ids that begin alike aren't compared with each other; the few near ones are found."""
    rng = random.Random(6)
    lines = ["copyright notice: " + "".join(rng.choice("abcdefghij") for _ in range(36)) for _ in range(20_000)]
    lines[7000:7050] = [x + "!" for x in lines[:50]]
    rows = [(f"d{k:05}", "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(2000)]
    got = linededup.report(spark.createDataFrame(rows, "doc_id string, text string")).agg(F.sum("n_lines"), F.sum("n_kept"), F.sum("n_near")).first()
    assert tuple(got) == (20_000, 19_950, 50)


def brute_fingerprint(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_simhash(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.edges, "__defaults__", (hot,))
    rng = random.Random(6)
    words = ["w%d" % i for i in range(50)]
    texts = [None, "", "  ", "One", "one", "Two\x0bwords", "É é", "many " * 9000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 4)):
            out = base[:]
            out[rng.randrange(len(out))] = rng.choice(words)
            texts.append(" ".join(out))
    docs = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[i + 10].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i + 10].component_id - 10 for i in range(len(texts))] == brute_components(prints)



def test_vantage_tree_finds_all_links():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 40, (2500, 4)).astype(np.uint64), axis=1) for c in centre]))
    want = {(int(min(a, b)), int(max(a, b))) for i, a in enumerate(values) for b in values[:i][np.bitwise_count(values[:i] ^ a) <= 3]}
    pruned, n = [0, 0], len(values)
    found = list(simhash.links(values[:, None], np.arange(n), np.arange(0), 3, pruned))
    got = {(int(min(values[a], values[b])), int(max(values[a], values[b]))) for u, v in found for a, b in zip(u, v, strict=True)}
    # every pair is either compared in a leaf or ruled out by a boundary, most of them the latter
    assert sum(len(u) for u, _ in found) == len(want) and sum(pruned) == n * (n - 1) // 2 and pruned[0] > 0.5 * sum(pruned)
    assert got == want and len(want) > 1000


def test_repeated_rows_and_empty(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(rows).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_long_texts_go_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97} x{i}" for i in range(30_000))
    whole = simhash.fingerprint(text)
    assert whole == brute_fingerprint(text)
    monkeypatch.setattr(simhash, "MANY", 1000)
    assert simhash.fingerprint(text) == whole


def test_components_of_a_chain(spark):
    chain = spark.range(40).selectExpr("id as u", "id + 1 as v").unionByName(spark.range(100, 103).selectExpr("id + 1 as u", "id as v"))
    got = {r.node: r.root for r in components.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_order_minhash(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "the"]) + str(rng.randrange(40)) for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["", "x", "same text here", "same text here", "ü" * 999]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (500, None)], "doc_id long, text string").selectExpr("*", "'z' as fingerprint")
    got = {r.doc_id: r for r in orderminhash.compare(docs).collect()}
    order = sorted([*rows, (500, "")], reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if new == t:
            assert got[i].near_edited == 1.0 and got[i].fingerprint == got[i].edited_fingerprint
    a, b = (next(i * 3 for i, t in enumerate(texts) if t == "same text here") + k for k in (0, 3))
    assert got[a].fingerprint == got[b].fingerprint and len({r.fingerprint for r in got.values()}) > 50
    near = [(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 100]
    assert np.mean([x for x, _ in near]) > np.mean([y for _, y in near]) + 0.05
    assert orderminhash.compare(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    """The fingerprint step by step; the hashes of several values chain their seeds."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    place = orderminhash.PLACE

    def h(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (1 << (64 if w8(v) else 32)) - 1).to_bytes(8 if w8(v) else 4, "little"), seed)
        return signed(seed)

    w8 = lambda v: not isinstance(v, Small)
    words = [x for w in text.split() for x in [w[i : i + orderminhash.TOKEN] for i in range(0, len(w), orderminhash.TOKEN)]]
    t = [h(w.encode()) for w in words]
    if not t:
        return "0000" * orderminhash.M
    grams = [tuple(t[i : i + orderminhash.K]) for i in range(len(t) - orderminhash.K + 1)] or [None]
    pairs = sorted((h(*g) >> place, i) for i, g in enumerate(grams)) if grams != [None] else [(array_hash(t) >> place, 0)]
    seen, numbered = {}, []
    for x, i in pairs:
        numbered.append((h(x, Small(seen.get(x, 0))) >> place, i))
        seen[x] = seen.get(x, 0) + 1
    out = ""
    for seed in range(orderminhash.ORDERS):
        ranked = sorted((h(Small(seed), x) >> place, i) for x, i in numbered) if seed else sorted(numbered)
        each = orderminhash.M // orderminhash.ORDERS
        for s in range(each):
            start = s * ((1 << 64) // each) - (1 << 63)
            at = sum((x << place | i) < start for x, i in ranked)
            a, b = ranked[at % len(ranked)], ranked[(at + 1) % len(ranked)]
            first, second = (a, b) if a[1] <= b[1] else (b, a)
            out += f"{h(first[0], second[0]) & 0xFFFF:04x}"
    return out


def test_order_of_repeated_and_null_ids(spark):
    """Rows that share an id follow each other by the hash of their texts, null ids come last; a text of a megabyte goes like any other."""
    long = " ".join(f"tok{i % 1009}" for i in range(150_000))
    rows = [(5, "b b b"), (5, "a a a"), (5, "b b b"), (None, "n n"), (None, None), (7, long), (-3, "x"), (2**62, ""), (0, "zero é日")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _zone", "2 as near_next")
    got = orderminhash.compare(frame).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert orderminhash.compare(frame.limit(0)).count() == 0


class Small(int):
    """An int of four bytes."""


def array_hash(values):
    """An array's hash chains those of its elements."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_fingerprints_step_by_step(spark):
    rng = random.Random(2)
    texts = ["", "x", "one two", "a a a a a a", "w" * 50] + [" ".join(rng.choice(["ab", "cd", "the", "é日"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    got = [
        r.f for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select(orderminhash.fingerprint(F.col("t")).alias("f")).collect()
    ]
    assert got == [plain_fingerprint(t) for t in texts]


def test_order_matters(spark):
    words = [f"w{i}" for i in range(200)]
    swapped = words[100:] + words[:100]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(reversed(words)))], "i int, t string")
    fp = {r.i: r.f for r in rows.select("i", orderminhash.fingerprint(F.col("t")).alias("f")).collect()}
    like = lambda a, b: sum(fp[a][k : k + 4] == fp[b][k : k + 4] for k in range(0, 256, 4)) / 64
    assert 0.2 < like(1, 2) < 0.9 and like(1, 3) < 0.1


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://example.com/en/7", "http://EXAMPLE.com/en/70?x", "https://a.example.com/en/8#t", "http://x.net/de/1",
        "http://example.net/de/8", "http://badexample.net/de/8", "http://b.org/es/1", "http://b.org/en/1", "http://com/en/", "http://h?x://y/z",
        "ftp://u.com",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(pages, URL_RULES).collect()}
    verdicts = {rule: v for v, rule in URL_RULES}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in verdicts if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and (rule is None or got[i].verdict == verdicts[rule])


def test_distrust_flows_against_links(spark):
    page = lambda i, host, path, *to: (i, f"http://{host}/{path}", "".join(f'<a href="//{t}/x">' for t in to))
    pages = spark.createDataFrame(
        [
            page(1, "bad.com", "en/"), page(2, "farm.io", "a", "bad.com"), page(3, "good.net", "de/", "fine.io"), page(4, "fine.io", "b"),
            page(5, "alone.io", "c"),
        ],
        "page_id long, url string, html string",
    )
    got = {r.host: r for r in urlfilter.judge(pages, URL_RULES).collect()}
    assert got["farm.io"].verdict == "block" and got["fine.io"].verdict == "allow" and got["alone.io"].verdict == "allow"
    assert got["fine.io"].trust > 0 and got["farm.io"].distrust > 0
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0
