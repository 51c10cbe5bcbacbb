"""The walks of the url filter against PageRank by linear algebra, a long chain, and odd rows."""

import numpy as np
import pytest

from descry.llm import urlfilter
from descry.llm.queries import URL_RULES


def page(i, host, path, *to):
    return (i, f"http://{host}/{path}", "".join(f'<a href="http://{t}/x">' for t in to))


def pagerank(n, links, seeds, damping=urlfilter.DAMPING):
    """Dead ends start again from the seeds; ranks sum to what the seeds sum to."""
    out = np.zeros(n)
    for (a, _), k in links.items():
        out[a] += k
    move = np.zeros((n, n))
    for (a, b), k in links.items():
        move[b, a] = k / out[a]
    move[:, out == 0] = (seeds / seeds.sum())[:, None]
    rank = np.linalg.solve(np.eye(n) - damping * move, (1 - damping) * seeds)
    return rank * seeds.sum() / rank.sum()


def test_random_graph_by_linear_algebra(spark):
    rng = np.random.default_rng(3)
    n = 40
    # the first hosts are seeds by rule: allowed, blocked, half blocked and half undecided
    names = [f"h{i}.net" if i < 8 else f"h{i}.com" if i < 16 else f"h{i}.io" for i in range(n)]
    pages, links = [], {}
    for k in range(400):
        a = int(rng.integers(n))
        path = "de/1" if a < 8 else ("en/1" if a < 12 or k % 2 else "q") if a < 16 else "p"
        to = [int(b) for b in rng.integers(n, size=rng.integers(0, 4)) if b != a and a % 7]
        pages.append(page(k, names[a], path, *[names[b] for b in to]))
        for b in to:
            links[a, b] = links.get((a, b), 0) + 1
    seen = {i: [p[1] for p in pages if p[1].startswith(f"http://{names[i]}/")] for i in range(n)}
    share = lambda i, part: sum(part in u for u in seen[i]) / len(seen[i]) if seen[i] else 0.0
    good = np.array([share(i, ".net/de/") for i in range(n)])
    bad = np.array([share(i, ".com/en/") for i in range(n)])
    trust = pagerank(n, links, good)
    distrust = pagerank(n, {(b, a): k for (a, b), k in links.items()}, bad)
    got = {r.host: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    for i in range(n):
        if seen[i]:
            assert got[names[i]].trust == pytest.approx(trust[i], abs=1e-5) and got[names[i]].distrust == pytest.approx(distrust[i], abs=1e-5)
            if names[i].endswith(".io") and abs(distrust[i] - trust[i]) > 1e-4:
                assert got[names[i]].verdict == ("block" if distrust[i] > trust[i] else "allow")


def test_distrust_reaches_the_end_of_a_chain(spark):
    pages = [page(0, "bad.com", "en/")] + [page(i, f"c{i}.io", "a", "bad.com" if i == 1 else f"c{i - 1}.io") for i in range(1, 31)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert all(r.verdict == "block" for r in got.values())
    ranks = [got[i].distrust for i in range(31)]
    assert all(b == pytest.approx(a * urlfilter.DAMPING, rel=0.01) for a, b in zip(ranks, ranks[1:], strict=False))


def test_odd_pages(spark):
    long = "http://long.io/" + "x" * 300_000
    rows = [
        (1, long, "<a href='http://bad.com/en/'>" * 20_000), (1, long, None), (2, "http://bad.com/en/1", ""), (2, "http://bad.com/en/1", ""),
        (None, None, None),
    ]
    pages = spark.createDataFrame([(*r, "h", "r", 1, 2) for r in rows], "page_id long, url string, html string, host string, rule string, trust int, _id int")
    got = urlfilter.judge(pages, URL_RULES).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "block"), (1, "block"), (2, "block"), (2, "block")]
    assert {len(r.path) for r in got if r.page_id == 1} == {300_001}
