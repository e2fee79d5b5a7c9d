"""Conversation tries and Merkle manifests against plain versions: odd rows, hot prefixes, long conversations."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridverify.llm import common, merkle, prefix_trie
from plain import lower

TURNS = "conv_id long, turn long, role string, text string, n long, rep long, part int"


def plain_trie(rows):
    """Node tuples from (conv_id, turn, role, text) rows."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, digest, r, x))
    own = {c: [t[3:] for t in sorted(l)] for c, l in own.items()}
    nodes = {}
    for c, l in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(int(c - np.fmod(c, 20)), [])[:h] + l[h:]
        for d in range(len(full) + 1):
            nodes.setdefault(tuple(full[:d]), []).append((c, len(full)))
    kids = {p: set() for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        words = 0
        if p:
            words = sum(bool(w) for w in p[-1][1].encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" "))
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(nodes[p]) - 1) * words
            leaves[p[:d]] += not kids[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(p))
        parent = min(nodes[p[:-1]])[0] if p else None
        out.append((min(members)[0], len(p), parent, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(df):
    rows = prefix_trie.trie(df).select("rep", "depth", "parent", "n", "children", "leaves", "saved", "ends").collect()
    return sorted(map(tuple, rows), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)


@pytest.mark.parametrize(("segment", "pack", "chunk"), [(64, 1 << 16, 1 << 16), (2, 7, 3)])
def test_trie_equals_plain(spark, monkeypatch, segment, pack, chunk):
    """Copies, hot first turns, ties, nulls, missing base conversations, one long conversation and a copy of it."""
    for name, value in (("SEGMENT", segment), ("PACK_TURNS", pack), ("CHUNK_IDS", chunk)):
        monkeypatch.setattr(prefix_trie, name, value)
    draw = np.random.default_rng(3)
    rows = []
    for c in [*range(60), *range(105, 118), *range(-25, -18)]:
        for t in range(int(draw.integers(1, 7))):
            first = t == 0 and c % 3 == 0
            rows.append((c, t, "user" if t % 2 else None, "hot start of words" if first else f"turn {draw.integers(0, 3)}\t x"))
    rows += [(c, t, "user", f"the same {t}") for c in range(200, 230) for t in range(4)]
    rows += [(c, t, "a", "again" if t % 5 else "z  y") for c in (300, 302) for t in range(23 + c % 5)]
    rows += [(400, None, None, None), (400, 1, "b", "tie"), (400, 1, "a", "tie"), (400, 1, "a", "tie"), (400, 2, "", " \n")]
    rows += [(401, 0, "a", "alone"), (403, 5, "a", "alone"), (None, 0, "a", "no one's")]
    assert found_trie(table_of(spark, rows).repartition(5)) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    none = table_of(spark, []).where("false")
    assert found_trie(none) == []
    for rows in ([(7, 0, "a", "b")], [(20, 0, None, None)], [(1, None, "é", "ü " * 30_000)]):
        assert found_trie(table_of(spark, rows)) == plain_trie(rows)


def test_double_array_keeps_all_paths_apart():
    draw = np.random.default_rng(5)
    for alphabet in (2, 5, 400):
        paths = sorted({tuple(draw.integers(0, alphabet, n).tolist()) for n in draw.integers(1, 9, 300)})
        lengths = np.array([len(p) for p in paths])
        labels = np.zeros((len(paths), 9), np.int64)
        for i, p in enumerate(paths):
            labels[i, : len(p)] = p
        trie = prefix_trie.DoubleArray(labels, lengths)
        states = {(): 0}
        for p in paths:
            for d in range(len(p)):
                to = int(trie.step(np.array([states[p[:d]]]), np.array([p[d]]))[0])
                assert to > 0 and states.setdefault(p[: d + 1], to) == to
        assert len(set(states.values())) == len(states)
        used = np.flatnonzero(trie.check >= 0)
        assert len(used) == len(states) - 1
        inner = {p[:d] for p in states for d in range(len(p))}
        for p in list(inner)[:50]:
            for label in range(alphabet):
                to = int(trie.step(np.array([states[p]]), np.array([label]))[0])
                assert to == states.get((*p, label), -1)


def test_numbered_over_several_tasks(spark):
    rows = [("hot", k // 3, k) for k in range(2000)] + [(None, None, 1), (None, 2, 1), ("a", None, 1), ("b", 5, 1)] + [("z", 1, 1)] * 4
    df = common.staged(spark.createDataFrame(rows, "g string, o long, v long").repartition(7), "t")
    for group in (["g"], []):
        found = {}
        for r in common.numbered(df, group, ["o"] if group else ["g", "o"], "t").collect():
            found.setdefault(r.g if group else 0, []).append((r.pos, (r.o if r.o is not None else -1)))
        for places in found.values():
            assert sorted(p for p, _ in places) == list(range(len(places)))
            if group:
                assert [o for _, o in sorted(places)] == sorted(o for _, o in places)
    assert common.numbered(df.where("false"), ["g"], ["o"], "t").count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g int, node string, pos int"


def plain_merkle(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) from (doc_id, text, lang, source, n_chars) rows."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, x, l, s, n: h(*map(field, (d, s, l, n, x)))

    def tree(nodes):
        """Levels, and each leaf's siblings level by level."""
        paths = [[] for _ in nodes]
        place = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(place):
                a = p - p % fanout
                paths[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + fanout])))
            nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
            place = [p // fanout for p in place]
        return nodes[0], paths

    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in names:
        members = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built.append((members, *tree([leaf(*r) for r in members])))
    if not built:
        return []
    root, upper = tree([b[1] for b in built])
    out = []
    for (members, subroot, paths), up in zip(built, upper):
        for r, path in zip(members, paths):
            proof = path + up
            now = leaf(r[0], r[1] and lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(*r)
            for before, after in proof:
                now = h(before, now, after)
            out.append((r[0], leaf(*r), subroot, root, h(*(x for side in proof for x in side)), now, now == root))
    return sorted(out, key=str)


def found_merkle(df):
    tampered = merkle.leaf_digest([merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    chosen = F.col("doc_id").isNotNull() & (common.id_remainder(F.col("doc_id"), 5) == 0)
    rows = merkle.proofs(*merkle.manifest(df, F.when(chosen, tampered))).collect()
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.folded_root == r.root) for r in rows), key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(16, 2), (2, 2), (3, 1)])
def test_merkle_equals_plain(spark, monkeypatch, fanout, levels):
    """A hot source of several blocks, many small sources, lone leaves, nulls, repeated rows."""
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(k, f"Text {k} É" if k % 7 else None, "en" if k % 3 else None, "hot" if k % 2 else f"s{k % 19}", k) for k in range(700 if fanout == 16 else 90)]
    rows += [(1000, "", "de", None, None), (None, "X", None, None, 1), (None, "X", None, None, 1), (5, "Again", "en", "hot", 5), (7, None, None, "hot", None), (2000, "ÄA" * 40_000, "de", "ü", 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS).repartition(4)
    assert found_merkle(df) == plain_merkle(rows, fanout)


def test_merkle_of_one_source_one_leaf_and_nothing(spark):
    for rows in ([], [(3, "One", "en", "a", 3)], [(k, "T", "en", "a", 3) for k in range(40)]):
        df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)
        assert found_merkle(df) == plain_merkle(rows)
    unchanged = merkle.proofs(*merkle.manifest(spark.createDataFrame([(k, "T", "en", "a", 3, "", 1, "", 1) for k in range(40)], DOCS))).collect()
    assert all(r.folded_root == r.root for r in unchanged)
