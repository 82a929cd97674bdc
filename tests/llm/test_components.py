"""Components of few links take no rounds, and are those of the rounds."""

import random

import pytest

from quarry.llm import components as c


def plain(links):
    up = {x: x for ab in links for x in ab}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_few_links_take_no_rounds(spark, monkeypatch, kind):
    rng = random.Random(kind)
    as_kind = (lambda n: n) if kind == "long" else (lambda n: bytearray([n >> 8, n & 255]))
    links = [(n, n + 1) for n in range(200, 260)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    want = plain([ab for ab in links if ab[0] != ab[1]])
    df = spark.createDataFrame([(as_kind(a), as_kind(b)) for a, b in links], f"a {kind}, b {kind}")
    number = lambda x: x if kind == "long" else int.from_bytes(x, "big")
    got = lambda rows: {number(r.node): number(r.root) for r in rows.collect()}
    assert got(c.components(df, task=0)) == want
    monkeypatch.setattr(c, "_large_star", None)  # a round would fail
    few = c.components(df)
    assert got(few) == want and few.count() == len(want)
