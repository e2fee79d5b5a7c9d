"""The registered queries over the small tables: SQL forms, or plain versions."""

import re

import corpus_pipeline
import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from gridverify.llm import queries as registered
from plain import contamination, fingerprint, groups, in_a_language, remainder

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = [r.asDict() for r in entry_module.queries()[name](spark, SF_DIR).collect()]
        return made[name]

    return get


def test_registered():
    names = entry_module.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert names["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_equals_sql(result, con, name):
    cursor = con.execute(registered.SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = [dict(zip(names, row)) for row in cursor.fetchall()]
    key = lambda r: repr([(k, r[k]) for k in sorted(r)])
    assert sorted(map(key, result(name))) == sorted(map(key, theirs))


def test_decontamination_equals_plain(result, con):
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    expected = contamination(docs, con.execute("SELECT item_id, text FROM benchmark").fetchall())
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in result("op2_decontamination")}
    assert found == {d: e for (d, _), e in zip(docs, expected)}


def test_quality_of_held_out_rows(result, con):
    known = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = result("op3_quality")
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in rows)
    right = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean(right) >= 0.9


def test_simhash_equals_plain(result, con):
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    codes = [fingerprint(t) for _, t in docs]
    expected = groups(codes, [d for d, _ in docs])
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op4_simhash")}
    assert found == {d: (f"{c:016x}", g) for (d, _), c, g in zip(docs, codes, expected)}


def test_base_score_and_held_out_texts(result, con):
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    counts = {}
    for d, ws in tokens.items():
        if remainder(d, 7) != 2:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    rows = result("op5_context_mixing")
    assert sorted(r["doc_id"] for r in rows) == sorted(tokens)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert r["held_out"] == (remainder(r["doc_id"], 7) == 2) and r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -6


def test_pfair_blocks_keep_their_windows(result, con):
    rows = result("op6_pfair")
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    assert all(len({r["source"] for r in rows if r["slot"] == s}) == 1 for s in {r["slot"] for r in rows})


def test_shards_are_even_and_whole(result, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = result("op7_sharding")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert sum(sizes) == sum(len((t or "").encode()) + 1 for t in texts.values())
    assert max(sizes) < 1.2 * min(sizes)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_languages_of_held_out_rows(result, con):
    known = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = result("op8_language")
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.95


def test_main_text_is_the_article(result, con):
    import html

    pages = {p: h for p, h in con.execute("SELECT page_id, html FROM pages").fetchall()}
    rows = result("op9_main_text")
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_neighbours_equal_plain(result, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    vectors = {i: np.array(v, float) for i, v in rows}
    expected = {}
    for q in (i for i in vectors if i % 50 == 0):
        score = {i: vectors[q] @ v / np.sqrt((vectors[q] @ vectors[q]) * (v @ v)) for i, v in vectors.items() if i != q}
        expected[q] = sorted(score, key=lambda i: (-score[i], i))[:5]
    found = {}
    for r in sorted(result("op10_neighbours"), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == expected


def test_pipeline_equals_plain(result, spark, con):
    """Language, groups and benchmark worked out one after the other on plain rows; mixing and sharding keep every row."""
    docs = con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()
    docs = in_a_language(docs)
    first = groups([fingerprint(t) for _, t, _ in docs], [d for d, _, _ in docs])
    docs = [d for d, f in zip(docs, first) if d[0] == f]
    dirty = contamination([d[:2] for d in docs], con.execute("SELECT item_id, text FROM benchmark").fetchall())
    docs = [d for d, x in zip(docs, dirty) if not x[4]]
    rows = result("pipeline")
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _, _ in docs)
    sizes = [sum(r["shard_bytes"] for r in rows if r["shard"] == s) for s in range(8)]
    assert sum(sizes) == sum(len(t.encode()) + 1 for _, t, _ in docs) and max(sizes) < 1.2 * min(sizes)
    assert all(sorted(r["shard_slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(8))
    assert {r["shard"] for r in rows} == set(range(8))
