"""The operators over the given tables, and their SQL forms where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridverify.llm import (
    context_mixing,
    decontaminate,
    html_extract,
    language,
    merkle,
    minhash,
    neighbours,
    pfair,
    prefix_trie,
    quality,
    sharding,
    simhash,
    warc,
)
from gridverify.llm.common import id_remainder, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = quality.train(docs.where(~held_out), labels.select("doc_id", "quality"))
    return quality.with_quality(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = context_mixing.scored(docs, id_remainder(F.col("doc_id"), 7) == 2)
    return found.withColumnRenamed("id", "doc_id")


def op6_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, its release time and deadline, its slot, and whether the mix has it."""
    return pfair.scheduled(table(spark, sf_dir, "documents").select("doc_id", "source")).select(
        "row.doc_id", "row.source", "block", "release", "deadline", "slot", "place", "in_mix"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    found = language.with_language(docs.select("doc_id", "text"), docs.where(~held_out))
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score")
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(
        "page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars")
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(
        table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; of every fifth, by its hash, the text is tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = merkle.leaf_digest([merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    chosen = F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 5) == 0)
    found = merkle.proofs(*merkle.manifest(docs, F.when(chosen, tampered)))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clusters(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_warc, op2_decontamination, op3_quality, op4_simhash, op5_context_mixing, op6_pfair, op7_sharding,
        op8_language, op9_main_text, op10_neighbours, op11_prefix_trie, op12_merkle, op13_minhash,
    ]
    return {f.__name__: f for f in found}


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha1(h), {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    steps = ", ".join(["-1"] * 8)
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), {steps}]))"
    return (
        f"(4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: "
        "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )


def _merkle_sql(levels: int = 5) -> str:
    """Trees of up to 16 ** levels leaves a source and as many sources; each level is one step of every tree."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    tampered = f"doc_id IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0"
    parts = [f"""leaves AS (
          SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf,
                 CASE WHEN {tampered} THEN sha256({head} || {field(lower)}) END AS found
          FROM documents),
        a0 AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
                      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                      leaf AS node, doc_id, leaf, coalesce(found, leaf) AS h, '' AS proof FROM leaves)"""]  # fmt: skip

    def tree(name: str) -> None:
        """Nodes per level, then what stands before and after each in its run."""
        for k in range(levels):
            parts.append(f"""{name}n{k + 1} AS (
              SELECT g, CASE WHEN n > 1 THEN i // 16 ELSE i END AS i,
                     CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE min(node) END AS node
              FROM (SELECT g, i, node, count(*) OVER (PARTITION BY g) AS n FROM {name}n{k})
              GROUP BY g, n, CASE WHEN n > 1 THEN i // 16 ELSE i END),
            {name}s{k} AS (
              SELECT a.g, a.i, any_value(n) AS n,
                     coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before,
                     coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
              FROM {name}n{k} a JOIN {name}n{k} b ON a.g = b.g AND a.i // 16 = b.i // 16
              JOIN (SELECT g, count(*) AS n FROM {name}n{k} GROUP BY g) c ON a.g = c.g GROUP BY a.g, a.i)""")

    parts.append("xn0 AS (SELECT g, i, node FROM a0)")
    tree("x")
    parts.append(f"yn0 AS (SELECT 0 AS g, g AS i, node FROM xn{levels})")
    tree("y")
    # Folding: own place at each level, the siblings there, and what follows.
    sql = "SELECT *, i AS spot, g AS up FROM a0"
    for name in "xy":
        for k in range(levels):
            join = "s.g = f.g AND s.i = f.spot" if name == "x" else "s.i = f.up"
            at = "spot" if name == "x" else "up"
            step = f"CASE WHEN n > 1 THEN {at} // 16 ELSE {at} END AS {at}"
            sql = f"""SELECT f.* REPLACE (
                  CASE WHEN n > 1 THEN proof || before || after ELSE proof END AS proof,
                  CASE WHEN n > 1 THEN sha256(before || h || after) ELSE h END AS h, {step})
                FROM ({sql}) f JOIN {name}s{k} s ON {join}"""
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, x.node AS subroot, y.node AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = y.node AS verified
        FROM ({sql}) f JOIN xn{levels} x ON x.g = f.g CROSS JOIN yn{levels} y"""


_TRIE = rf"""
        WITH t AS (
          SELECT conv_id, sha256(strlen(r) || ':' || r || x) AS item, x,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS i
          FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
        w AS (SELECT item, min(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS words FROM t GROUP BY item),
        own AS (SELECT conv_id, list(item ORDER BY i) AS l, {_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM t GROUP BY conv_id),
        re AS (
          SELECT a.conv_id, list_concat(coalesce(list_slice(b.l, 1, a.h), []), list_slice(a.l, a.h + 1, len(a.l))) AS l
          FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
        path AS (SELECT conv_id, len(l) AS size, d, list_slice(l, 1, d) AS p FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM re)),
        node AS (
          SELECT p, d, min(conv_id) AS c, count(*) AS n,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends
          FROM path GROUP BY p, d),
        kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
        valued AS (
          SELECT p, d, c, n, ends, coalesce(kids, 0) AS kids, CASE WHEN d > 0 THEN (n - 1) * words ELSE 0 END AS own
          FROM node LEFT JOIN kids USING (p) LEFT JOIN w ON item = p[d]),
        below AS (
          SELECT list_slice(p, 1, u) AS p, sum(own) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves
          FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM valued) GROUP BY 1)
        SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, u.c AS parent_conv_id, v.n AS n_convs, CAST(v.kids AS BIGINT) AS n_children,
               CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM valued v JOIN below USING (p) LEFT JOIN node u ON v.d > 0 AND u.p = list_slice(v.p, 1, v.d - 1)"""


_NEAR = r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(na.n) + any_value(nb.n) AS total
          FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n) GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (total - c)),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
        low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
               doc_id <= coalesce(low, doc_id) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = doc_id"""


SQL = {
    "op13_minhash": _NEAR,
    "op11_prefix_trie": _TRIE,
    "op12_merkle": _merkle_sql(),
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        best AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM p JOIN best USING (h)""",
    "op2_decontamination": r"""
        WITH dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
          SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS x
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM win),
        occ AS (
          SELECT doc_id, i, o.n, item_id
          FROM (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS x
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths)) o
          JOIN win ON o.n = win.n AND o.x = win.x),
        hit AS (
          SELECT doc_id, count(DISTINCT j) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
        found AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_neighbours": """
        WITH e AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)),
        fit AS (SELECT * FROM e WHERE list_dot_product(v, v) > 0 AND isfinite(list_dot_product(v, v))),
        pairs AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
          FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
               vec_id, score
        FROM pairs QUALIFY rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
