"""Components of fingerprints, with leads and finer cells: large groups in one cell, near and far."""

import random

import numpy as np
import pytest

from farewright.llm import simhash_dedup
from farewright.llm.components import components
from farewright.llm.shared import written

SCHEMA = "t int, fp long"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(prints):
    """The least print of each one's component, over all pairs."""
    p = np.array(prints, np.int64).view(np.uint64)
    root = list(range(len(p)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[:i] ^ p[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(p)):
        groups.setdefault(find(i), []).append(prints[i])
    return {x: min(g) for g in groups.values() for x in g}


def run(spark, prints):
    df = written(spark.createDataFrame([(0, x) for x in prints], SCHEMA), "prints")
    found = written(simhash_dedup.linked(df), "found")
    of = {r.node.fp: r.root.fp for r in components(found).collect()}
    return {x: of.get(x, x) for x in prints}, found.count()


def ball(r, n, radius=3):
    centre = r.getrandbits(64)
    out = {centre}
    while len(out) < n:
        x = centre
        for b in r.sample(range(64), r.randrange(1, radius + 1)):
            x ^= 1 << b
        out.add(x)
    return [signed(x) for x in sorted(out)]


def one_cell(r, n, bits=24):
    """Prints that differ in a few bits only, whose segments' counts are the same in the others."""
    base = r.getrandbits(64)
    where = r.sample(range(64), bits)
    return [signed(x) for x in {base ^ sum(1 << b for b in where if r.random() < 0.5) for _ in range(n)}]


@pytest.mark.parametrize("crowd", [4, 64])
def test_groups(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    r = random.Random(crowd)
    chain, x = [], r.getrandbits(64)
    for _ in range(60):
        x ^= sum(1 << b for b in r.sample(range(64), 3))
        chain.append(signed(x))
    prints = sorted({*ball(r, 200), *ball(r, 100, 5), *one_cell(r, 300), *one_cell(r, 200, 16), *chain, *(signed(r.getrandbits(64)) for _ in range(200)), 0, -1})
    got, n = run(spark, prints)
    assert got == brute(prints) and n <= 5 * len(prints)


def test_a_large_group_has_links_in_the_number_of_its_prints(spark):
    """All within 3 bits of one: millions of pairs, a few links for each print."""
    prints = ball(random.Random(2), 10_000)
    got, n = run(spark, prints)
    assert set(got.values()) == {min(prints)} and n <= 5 * len(prints)


def test_a_crowd_that_is_far_apart(spark):
    """Thousands in one cell, few of them linked: the finer cells hold few each, and nothing is lost."""
    r = random.Random(3)
    prints = sorted(set(one_cell(r, 3000, 28)))
    got, _ = run(spark, prints)
    assert got == brute(prints)


def test_none(spark):
    assert run(spark, []) == ({}, 0)
    assert run(spark, [5]) == ({5: 5}, 0)


@pytest.mark.parametrize(("block", "crowd"), [(8, 10_000), (8, 40), (50, 100)])
def test_cells_larger_than_a_block(spark, block, crowd, monkeypatch):
    """Blocks of a cell meet across, crowded cells are dealt again, and nothing is lost."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    r = random.Random(block + crowd)
    prints = sorted({*ball(r, 150, 6), *one_cell(r, 200), *one_cell(r, 150, 12), *(signed(r.getrandbits(64)) for _ in range(50)), 0, -1})
    got, _ = run(spark, prints)
    assert got == brute(prints)


def around(r, n):
    """Prints of a large group of near copies: a few bits, some of them often, differ from a centre."""
    centre, often, out = r.getrandbits(64), r.sample(range(64), 16), set()
    while len(out) < n:
        x = centre
        for b in {*r.sample(often, r.randrange(1, 7)), *r.sample(range(64), r.randrange(3))}:
            x ^= 1 << b
        out.add(signed(x))
    return sorted(out)


def test_rows_grow_with_the_group(spark, monkeypatch):
    """What is written and what tasks are sent stays within the number of a fingerprint's cells, whatever the group's
    size; with crowded cells dealt again, a group of 2,000 wrote some hundred thousand rows."""
    rows = {}

    def counted(df, name, put=written):
        out = put(df, name)
        rows[n] = rows.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(simhash_dedup, "written", counted)
    for n in (500, 2000):
        prints = around(random.Random(7), n)
        got, _ = run(spark, prints)
        assert got == brute(prints)
    assert rows[2000] <= 3 * 56 * 2000, rows
