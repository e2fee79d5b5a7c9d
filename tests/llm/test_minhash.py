"""MinHash near-duplicates against all pairs: copies, chains, crowds of a template, odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest

from gridverify.llm import components, minhash
from gridverify.llm.common import staged
from plain import lower


def plain(rows, width=2):
    """(doc_id, n, component, kept) by all pairs of (doc_id, text) rows."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                one, two = sorted((top(i), top(j)))
                parent[two] = one
    members = {}
    for k, (i, _) in enumerate(rows):
        members.setdefault(top(k), []).append(i)
    low = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return sorted(((i, len(s), low[top(k)], i == low[top(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows):
    df = staged(spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "doc_id long, text string, first string, node int, n int").repartition(3), "t")
    return sorted(map(tuple, minhash.clusters(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize(("crowd", "block"), [(16, 512), (3, 4)])
def test_equals_plain(spark, monkeypatch, crowd, block):
    """Texts with some words changed, a hot one, a template with planted pairs, short, blank and null ones, repeated rows."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in draw.integers(0, 3000, n)]
    texts = ["", " \n", None, "One", "one", "one two", "One  two", "one two three", "1 " * 3000]
    for _ in range(12):
        source = word(150)
        for changes in (0, 1, 3, 6, 9, 12):
            copy = list(source)
            for at in draw.integers(0, 150, changes):
                copy[at] = f"x{draw.integers(0, 99)}"
            texts.append(" ".join(copy))
    start = word(100)
    for k in range(60):  # of a template, about 0.6 alike; every third has a partner
        own = word(40)
        texts.append(" ".join([*start, *own]))
        if k % 3 == 0:
            texts.append(" ".join([*start, *own[:-6], *word(6)]))
    hot = word(120)
    for k in range(40):  # a chain around a hot text
        copy = list(hot)
        for at in draw.integers(0, 120, 8):
            copy[at] = f"y{k}"
        texts.append(" ".join(copy))
    rows = [*enumerate(texts), (None, texts[20]), (7, texts[21]), (None, "alone and without number")]
    assert found(spark, rows) == plain(rows)


def test_nothing_and_blanks(spark):
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.clusters(none).count() == 0


def test_crowd_of_a_template_loses_no_link(spark):
    """3,000 texts of one template, 0.7 alike, 300 of them with a partner at 0.8 or a little more."""
    draw = np.random.default_rng(9)
    word = lambda n: [f"w{k}" for k in draw.integers(0, 200_000, n)]
    start, texts, partner = word(164), [], {}
    for k in range(3000):
        own = word(36)
        texts.append(" ".join([*start, *own]))
        if k % 10 == 0:
            partner[len(texts)] = len(texts) - 1
            texts.append(" ".join([*start, *own[:-20], *word(20)]))
    rows = minhash.clusters(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    component = {r.doc_id: r.component_id for r in rows}
    sets = lambda i: (lambda w: {" ".join(w[k : k + 2]) for k in range(len(w) - 1)})(texts[i].split())
    planted = [(a, b) for a, b in partner.items() if 100 * len(sets(a) & sets(b)) >= 80 * len(sets(a) | sets(b))]
    assert len(planted) > 200
    assert all(component[a] == component[b] for a, b in planted)
    assert sum(r.kept for r in rows) == len(texts) - len(planted)


def test_sketches_estimate_and_prefixes_are_exact():
    draw = np.random.default_rng(10)
    lost = 0
    for _ in range(300):
        n = int(draw.integers(5, 400))
        common = draw.integers(0, 1 << 63, n).astype(np.uint64)
        extra = int(n * 0.24) // 2
        a, b = (np.unique(np.concatenate((common, draw.integers(0, 1 << 63, extra).astype(np.uint64)))) for _ in range(2))
        one, two = (np.frombuffer(minhash.odd_sketch(minhash.minima(x)), np.uint8).reshape(1, -1) for x in (a, b))
        if minhash.similar(a, b):
            lost += int(minhash.differing_bits(one, two)[0]) > minhash.MOST_BITS
            counts = np.full(minhash.SLOTS, 2)
            first, largest = minhash.prefix(a, counts)
            second, other = minhash.prefix(b, counts)
            shared = sorted(set(first.tolist()) & set(second.tolist()))
            place = lambda words, most, w: int(most[words.tolist().index(w)])
            assert any(place(first, largest, w) >= len(b) and place(second, other, w) >= len(a) for w in shared)
    assert lost == 0
    far = [np.unique(draw.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2)]
    bits = [np.frombuffer(minhash.odd_sketch(minhash.minima(x)), np.uint8).reshape(1, -1) for x in far]
    assert minhash.differing_bits(*bits)[0] > minhash.MOST_BITS


def test_rounds_of_components(spark, monkeypatch):
    """A ring and a comb need fewer stored tables than one round more than the smallest would take; roots as by hand."""
    ring = [(i, (i * 7 + 1) % 300) for i in range(300)]
    comb = [(1000 + i, 1001 + i) for i in range(200)] + [(1000 + i, 5000 + i) for i in range(201)]
    links = spark.createDataFrame([*ring, *comb, *comb[::-1], (9, 9)], "a long, b long").repartition(5, "a")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in [*ring, *comb]:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    names = []
    monkeypatch.setattr(components, "staged", lambda df, name: names.append(name) or staged(df, name))
    found = components.components(links).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == {x: find(x) for x in root}
    # A table of links, and the check that they are stars, after at most two rounds of four tables.
    assert len(names) <= 10
    monkeypatch.setattr(components, "LINKS", 16)
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(x, find(x)) for x in root}


def test_stars_by_hand():
    u, v = components.stars(np.array([5, 3, 9, 20, 30]), np.array([3, 7, 7, 21, 30]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(5, 3), (7, 3), (9, 3), (21, 20)]


def test_blocks_that_are_alone():
    """Words of one block, away from a task's ends, need no join; all blocks of the others do."""
    rows = [(w, n, w, n, 9, b"x") for w, size in ((1, 1), (2, 3), (3, minhash.BLOCK), (4, minhash.BLOCK + 1), (5, 2), (6, 1)) for n in range(size)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["word", "n", "root", "node", "largest", "sketch"])
    halves = [batch.slice(0, 300), batch.slice(300)]
    found = [(r["word"], len(r["rows"]) // 32, r["alone"]) for b in minhash._cut_blocks(halves) for r in b.to_pylist()]
    assert found == [(1, 1, False), (2, 3, True), (3, minhash.BLOCK, True), (4, minhash.BLOCK, False), (4, 1, False), (5, 2, True), (6, 1, False)]
