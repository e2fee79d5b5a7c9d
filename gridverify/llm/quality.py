"""Quality classifier with learned subword embeddings.

Words, pairs of words and the character triples of a text are hashed to rows of
an embedding table. A document is the average of its rows; a softmax layer turns
it into the probability of each label. Table and layer are trained by stochastic
gradient descent on a bounded sample of labelled rows.

Edge cases: null and empty texts have no features and score by the layer's bias;
without training rows of both labels every score is the share of label 1 (0.5
without any). Labels other than 0 and 1 are ignored; an id with several labels
takes their rounded mean, 0.5 upwards. Repeated rows are scored one by one; ids
that are null have no label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.llm.common import broadcast, buffers, free_names, received, small_batches, utf8

#: Rows of the embedding table; numbers in a row.
BUCKETS, WIDTH = 1 << 14, 16
#: Labelled rows to learn from, at most; passes over them; rows of a step; rates of the first and last step.
TRAIN_ROWS, EPOCHS, STEP_ROWS, RATE = 6000, 12, 32, (0.5, 0.02)
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes) -> np.ndarray:
    """How often each bucket's features occur in the text."""
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    before = np.zeros(0, np.uint64)
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # pieces end between words, where there is a gap
            gap = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = gap + 1 if gap >= at else end
        late = np.frombuffer(text, np.uint8)[max(0, at - 2) : end].astype(np.uint64)
        raw = late[at - max(0, at - 2) :]
        at = end
        if len(late) >= 3:
            triple = late[:-2] | late[1:-1] << np.uint64(8) | late[2:] << np.uint64(16)
            counts += np.bincount((triple * _P >> shift).astype(np.int64), minlength=BUCKETS)
        # A word's hash is the sum of its bytes times the powers of an odd number, from its own start.
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            continue
        power = np.cumprod(np.full(len(raw), _Q))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power)))
        inverse = np.uint64(pow(int(_Q), -1, 1 << 64))
        back = np.cumprod(np.full(len(raw) + 1, inverse))
        word = (total[last] - total[first]) * back[first]
        counts += np.bincount(((word ^ word >> np.uint64(29)) * _P >> shift).astype(np.int64), minlength=BUCKETS)
        row = np.concatenate((before, word))
        pair = (row[:-1] * _Q + row[1:]) ^ (row[:-1] >> np.uint64(31))
        pair[row[:-1] == row[1:]] = 1  # a word said twice is one feature, whatever the word
        counts += np.bincount((pair * _P >> shift).astype(np.int64), minlength=BUCKETS)
        before = word[-1:]
    return counts


def averaged(texts: list[bytes]) -> np.ndarray:
    rows = np.empty((len(texts), BUCKETS), np.float32)
    for row, text in zip(rows, texts):
        counts = features(text)
        row[:] = counts / max(1, counts.sum())
    return rows


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sparse(batches):
    """(label, text) rows to (label, buckets, shares)."""
    for batch in batches:
        counts = [features(t) for t in buffers(batch.column(1))]
        used = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([u.astype(np.int32).tobytes() for u in used], pa.binary()),
                pa.array([(c[u] / max(1, c.sum())).astype(np.float32).tobytes() for c, u in zip(counts, used)], pa.binary()),
            ],
            names=["label", "buckets", "shares"],
        )


def train(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", max_rows=TRAIN_ROWS):
    """Embedding table, layer and bias. At most max_rows labelled ids are drawn, by a hash of the id."""
    small_batches(documents.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    known = known.agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    ids = documents.select(F.col(id_col).alias("id")).distinct()
    drawn = known.join(ids, "id").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(max_rows)
    texts = documents.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"))
    # Of an id that repeats, any one text will do: the smallest is always the same.
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = rows.select("label", "text").mapInArrow(_sparse, "label int, buckets binary, shares binary").collect()
    # In an order of their own, whatever order they come in.
    found = sorted(((r.label, bytes(r.buckets), bytes(r.shares)) for r in found), key=lambda r: hash_of(r[1], r[2]))
    y = np.array([r[0] for r in found], np.int64)
    share = y.mean() if len(y) else 0.5
    table = np.random.default_rng(5).uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    if share in (0.0, 1.0) or not len(y):
        bias[:] = np.log(np.clip([1 - share, share], 1e-9, 1))
        return table, layer, bias
    which = [np.frombuffer(r[1], np.int32) for r in found]
    value = [np.frombuffer(r[2], np.float32) for r in found]
    draw = np.random.default_rng(6)
    steps, done = EPOCHS * -(-len(y) // STEP_ROWS), 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for i in range(0, len(order), STEP_ROWS):
            chosen = order[i : i + STEP_ROWS]
            x = np.zeros((len(chosen), BUCKETS), np.float32)
            for row, k in zip(x, chosen):
                row[which[k]] = value[k]
            rate = RATE[0] + (RATE[1] - RATE[0]) * done / steps
            done += 1
            hidden = x @ table
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            # Averages of many features are small, so the table takes larger steps than the layer.
            back = error @ layer.T
            layer -= rate * hidden.T @ error
            bias -= rate / len(chosen) * error.sum(axis=0)
            table -= 10 * rate * (x.T @ back)
    return table, layer, bias


def hash_of(*parts: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"|".join(parts), 9)


def with_quality(documents: DataFrame, model, *, text_col: str = "text") -> DataFrame:
    """The columns of documents but the text, and ``__score``, the probability of label 1.

    If a column is called so, underscores are added.
    """
    score_name, text_name = free_names(documents.columns, ["__score", "__text"])
    spark = documents.sparkSession
    small_batches(spark)
    held = broadcast(spark, model)
    kept = [c for c in documents.columns if c != text_col]

    def score(batches):
        table, layer, bias = received(held)
        both = table @ layer  # average first or layer first: the same
        for batch in batches:
            p = _softmax(averaged(buffers(batch.columns[-1])) @ both + bias)[:, 1].astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(p, 0, 1))], names=[*kept, score_name])

    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField(score_name, T.DoubleType())])
    return documents.select(*kept, utf8(F.col(text_col)).alias(text_name)).mapInArrow(score, schema)
