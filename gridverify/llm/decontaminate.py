"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all test items is built from blocks of items of bounded size and
sent to the tasks; each document streams through it, keeping the longest match
that ends at each word. A window is ``width`` consecutive words of an item, or a
whole item that is shorter. Every document word inside an occurrence of a window
is hit.

Edge cases: a null or empty text has no words and no hits; items without words
have no window; repeated items, ids and documents are treated one by one; an
empty benchmark gives no hits. Extra columns are ignored, or kept by
``remove_contamination``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.llm.common import WORDS_ONLY, broadcast, buffers, free_names, received, small_batches, staged, utf8

#: Words of test items in one automaton, which is built on the driver, and in all automata
#: that a task holds at once (about 60 bytes a word). A larger benchmark takes several passes.
BLOCK_WORDS, PASS_WORDS = 100_000, 2_000_000
#: The column that ``with_hits`` adds.
#: Name of the column of hits; underscores are added to it where documents have such a column.
HITS = "__hits"
_SPAN = "array<struct<first:int,last:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPAN_ARROW), ("items", pa.list_(pa.string()))])
_HITS_TYPE = f"struct<n_words:long,n_hit:long,spans:{_SPAN},items:array<string>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS_ONLY).split()


class Automaton:
    """Generalised suffix automaton of sequences of word numbers.

    Built with one dictionary per state; ``freeze`` then keeps the transitions as
    one sorted array of (state, word) keys, which is what the tasks get.
    ``items_of`` holds, for states that stand for whole windows, the items with an
    occurrence there.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, sequence in items:
            if sequence:
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in sequence]
                sequences.append((item, numbers))
                last = 0
                for c in numbers:
                    last = self._extend(last, c)
        self.shortest = min((min(len(s), width) for _, s in sequences), default=0)
        self._freeze()
        self.items_of: dict[int, set[str]] = {}
        #: Lengths of short items that end in a state.
        self.short: dict[int, set[int]] = {}
        self.short_items: dict[tuple[int, int], set[str]] = {}
        for item, numbers in sequences:
            if len(numbers) < width:
                state = 0
                for c in numbers:
                    state = self._step(state, c)
                self.short.setdefault(state, set()).add(len(numbers))
                self.short_items.setdefault((state, len(numbers)), set()).add(item)
            else:
                for end, state, _ in self._matches(numbers):
                    if end >= width - 1:
                        self.items_of.setdefault(state, set()).add(item)

    def _freeze(self) -> None:
        size = max(1, len(self.vocabulary))
        pairs = sorted((s * size + c, t) for s, moves in enumerate(self.next) for c, t in moves.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.targets = np.array([t for _, t in pairs], np.int32)
        self.link, self.length = np.array(self.link, np.int32), np.array(self.length, np.int32)
        del self.next

    def _step(self, state: int, c: int) -> int:
        """The next state, or -1."""
        key = state * max(1, len(self.vocabulary)) + c
        i = int(self.keys.searchsorted(key))
        return int(self.targets[i]) if i < len(self.keys) and self.keys[i] == key else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = state
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _matches(self, numbers):
        """(end, state, length) for each word: the longest match, cut to the width."""
        link, length, width = self.link, self.length, self.width
        state = matched = 0
        for end, c in enumerate(numbers):
            while (to := self._step(state, c)) < 0 and state:
                state = int(link[state])
                matched = int(length[state])
            if to >= 0:
                state, matched = to, matched + 1
            # Longer matches tell no more: stay with the state of the last width words.
            if matched >= width:
                matched = width
                while length[link[state]] >= width:
                    state = int(link[state])
            yield end, state, matched

    def hits(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [first, last] of hit words, merged, and the items with windows in the text."""
        spans, found = [], set()
        if not self.shortest or len(tokens) < self.shortest:
            return spans, found
        get = self.vocabulary.get
        numbers = np.array([get(w, -1) for w in tokens])
        # A window lies in a run of words that items have; shorter runs can't hold one.
        known = np.flatnonzero(np.diff(np.concatenate(([0], (numbers >= 0).view(np.int8), [0]))))
        seen = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.shortest:
                continue
            for end, state, matched in self._matches(numbers[a:b].tolist()):
                size = 0
                if matched == self.width:
                    size = self.width
                    if state not in seen:
                        seen.add(state)
                        found |= self.items_of[state]
                s = state if self.short else 0
                while s > 0:
                    for n in self.short.get(s, ()):
                        if n <= matched:
                            size = max(size, n)
                            found |= self.short_items[s, n]
                    s = int(self.link[s])
                if size:
                    first = a + end - size + 1
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first - 1:
                        spans[-1] = (spans[-1][0], a + end)
                    else:
                        spans.append((first, a + end))
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined into one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _searcher(machines, name: str, place: int, before: bool, kept: list[int]):
    """Adds the hits of some automata; before: the last column holds those of earlier passes."""

    def search(batches):
        automata = received(machines)
        for batch in batches:
            had = batch.columns[-1].to_pylist() if before else None
            hits = []
            for i, text in enumerate(buffers(batch.column(place).cast(pa.binary()))):
                tokens = words(text)
                spans = [(s["first"], s["last"]) for s in had[i]["spans"]] if before else []
                items = set(had[i]["items"]) if before else set()
                for machine in automata:
                    more, found = machine.hits(tokens)
                    spans += more
                    items |= found
                spans = merged(spans)
                hits.append({"n_words": len(tokens), "n_hit": sum(b - a + 1 for a, b in spans), "spans": [{"first": a, "last": b} for a, b in spans], "items": sorted(items)})
            names = [batch.schema.names[k] for k in kept]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(hits, _HITS_ARROW)], names=[*names, name]
            )

    return search


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (item, words) of about BLOCK_WORDS words, read one after the other."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), utf8(F.col(text_col)).alias("text")
    )
    block, size = [], 0
    for row in items.toLocalIterator():
        sequence = words(bytes(row.text or b""))
        if block and size + len(sequence) > BLOCK_WORDS:
            yield size, block
            block, size = [], 0
        block.append((row.item, sequence))
        size += len(sequence)
    yield size, block


def with_hits(
    documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = 10, drop_text: bool = False,
) -> DataFrame:
    """The documents with the column ``__hits``: n_words, n_hit, merged spans of hit words, items."""
    spark = documents.sparkSession
    small_batches(spark)
    df, before, machines, size = documents, False, [], 0
    place, name = documents.columns.index(text_col), free_names(documents.columns, [HITS])[0]

    def search(df, last: bool):
        held = broadcast(spark, machines)
        kept = [i for i in range(len(documents.columns)) if not (last and drop_text and i == place)]
        fields = [documents.schema[i] for i in kept]
        hits = T.StructField(name, T.DataType.fromDDL(_HITS_TYPE))
        return df.mapInArrow(_searcher(held, name, place, before, kept), T.StructType([*fields, hits]))

    for n, block in _blocks(benchmark, item_col, item_text_col):
        if machines and size + n > PASS_WORDS:
            # Each pass is a job of its own, so that a task holds the automata of one pass only.
            df, before, machines, size = staged(search(df, False), "decontaminate"), True, [], 0
        machines.append(Automaton(block, width))
        size += n
    return search(df, True)


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans, with what lies between them."""
    import re

    if text is None or not spans:
        return text
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b][1]
    out.append(text[at:])
    return "".join(out)


def remove_contamination(
    documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", width: int = 10,
    max_span_words: int | None = None, max_coverage: float | None = None,
) -> DataFrame:
    """The documents without contamination, with their own columns.

    With either limit, spans of more than max_span_words hit words (0 by default) are cut
    out, and a document goes if its hit words are more than max_coverage of all its words (1
    by default, so that documents are only cut). Without limits any window drops the document.
    Null and empty texts stay.
    """
    place, schema = documents.columns.index(text_col), documents.schema
    name = free_names(documents.columns, [HITS])[0]
    hits = F.col(name)
    found = with_hits(documents, benchmark, text_col=text_col, width=width)
    if max_span_words is None and max_coverage is None:
        return found.where(hits["n_hit"] == 0).drop(name)
    longest = max_span_words or 0
    kept = found if max_coverage is None else found.where(hits["n_hit"] <= max_coverage * hits["n_words"])

    def cut(batches):
        for batch in batches:
            columns = list(batch.columns)
            spans = [
                [(s["first"], s["last"]) for s in h["spans"] if s["last"] - s["first"] + 1 > longest]
                for h in columns.pop().to_pylist()
            ]
            texts = columns[place].to_pylist()
            columns[place] = pa.array([cut_words(t, s) for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(cut, schema)


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per document: words, hit words, items found and their digest, whether any word is hit."""
    found = with_hits(documents.select(F.col(id_col), "text"), benchmark, drop_text=True)
    hits = F.col(HITS)
    return found.select(
        F.col(id_col),
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"),
    )
