"""Benchmark decontamination by a generalised suffix automaton.

The automaton is built over the words of all benchmark items.  Each document's
words run through it once; the length of the longest match that ends at each word
tells which windows occur.

Items come in blocks of bounded size.  The driver holds one block at a time, builds
its automaton once as flat arrays and broadcasts it, so neither what the driver nor
what a worker holds grows with the benchmark.  Several blocks scan the texts where
they are: only the hits are written, by the text's digest, and joined in the end.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Other bytes than ASCII letters and digits and those over 0x7F part words; A-Z become a-z.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Words of items in one block.  An automaton has at most twice as many states, of 24 bytes, and three times as many transitions.
BLOCK_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_NORMAL).split() if text else []


class Automaton:
    """All substrings of the items, each with the items that hold it.

    States are numbers into flat arrays.  Most states have one transition, which lies
    in ``_word`` and ``_to``; the others' further ones are in ``_more``, by state and word.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self._word, self._to, self._link, self._len = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self._more: dict[int, int] = {}
        branches: dict[int, list[int]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        marks: list[tuple[int, str]] = []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            last = 0
            for c in ids:
                last = self._extend(last, c, branches)
                marks.append((last, name))
            if 0 < len(ids) < window:
                at = 0
                for c in ids:
                    at = self._next(at, c)
                whole.setdefault(at, []).append((len(ids), name))
                self.least = min(self.least, len(ids))
        self._close(marks, whole)

    def _next(self, v: int, c: int) -> int:
        """The state after ``c``, or -1."""
        return self._to[v] if self._word[v] == c else self._more.get(v << 32 | c, -1)

    def _put(self, v: int, c: int, to: int, branches: dict[int, list[int]]) -> None:
        if self._word[v] in (-1, c):
            self._word[v], self._to[v] = c, to
            return
        key = v << 32 | c
        if key not in self._more:
            branches.setdefault(v, []).append(c)
        self._more[key] = to

    def _state(self, length: int, link: int) -> int:
        for column, value in ((self._word, -1), (self._to, 0), (self._link, link), (self._len, length)):
            column.append(value)
        return len(self._len) - 1

    def _extend(self, last: int, c: int, branches: dict[int, list[int]]) -> int:
        q = self._next(last, c)
        if q >= 0:
            return q if self._len[q] == self._len[last] + 1 else self._clone(last, c, q, branches)
        cur, p = self._state(self._len[last] + 1, 0), last
        while p != -1 and self._next(p, c) < 0:
            self._put(p, c, cur, branches)
            p = self._link[p]
        if p != -1:
            q = self._next(p, c)
            self._link[cur] = q if self._len[q] == self._len[p] + 1 else self._clone(p, c, q, branches)
        return cur

    def _clone(self, p: int, c: int, q: int, branches: dict[int, list[int]]) -> int:
        new = self._state(self._len[p] + 1, self._link[q])
        self._word[new], self._to[new] = self._word[q], self._to[q]
        if q in branches:
            branches[new] = list(branches[q])
            for d in branches[q]:
                self._more[new << 32 | d] = self._more[q << 32 | d]
        while p != -1 and self._next(p, c) == q:
            self._put(p, c, new, branches)
            p = self._link[p]
        self._link[q] = new
        return new

    def _close(self, marks: list[tuple[int, str]], whole: dict[int, list[tuple[int, str]]]) -> None:
        """For each state: the items of its suffix of window length, and the short items that end there."""
        w, n, link, ln = self.window, len(self._len), self._link, self._len
        items: dict[int, set[str]] = {}
        for s, name in marks:
            if ln[s] >= w:
                items.setdefault(s, set()).add(name)
        order = sorted(range(1, n), key=ln.__getitem__)
        for s in reversed(order):
            up = link[s]
            if s in items and ln[up] >= w:
                items.setdefault(up, set()).update(items[s])
        # Each different set once; a state has its number.
        self._sets: list[tuple[str, ...]] = [()]
        self._ends: list[tuple[tuple[int, str], ...]] = [()]
        self._set_of, self._end_of = array("i", bytes(4 * n)), array("i", bytes(4 * n))
        known: dict[frozenset[str], int] = {frozenset(): 0}
        for s in order:
            up = link[s]
            if ln[s] >= w:
                if ln[up] >= w:
                    self._set_of[s] = self._set_of[up]
                elif found := frozenset(items.get(s, ())):
                    if found not in known:
                        known[found] = len(self._sets)
                        self._sets.append(tuple(found))
                    self._set_of[s] = known[found]
            if s in whole:
                self._ends.append((*whole[s], *self._ends[self._end_of[up]]))
                self._end_of[s] = len(self._ends) - 1
            else:
                self._end_of[s] = self._end_of[up]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of the words in any window, and the items that hold such windows."""
        get, more, w, least = self.vocab.get, self._more.get, self.window, self.least
        word, after, link, ln, set_of, end_of = self._word, self._to, self._link, self._len, self._set_of, self._end_of
        v = length = 0
        spans: list[list[int]] = []
        sets: set[int] = set()
        found: set[str] = set()
        for j, c in enumerate(map(get, words)):
            if c is None:
                v = length = 0
                continue
            to = after[v] if word[v] == c else more(v << 32 | c, -1)
            while to < 0 and v:
                v = link[v]
                length = ln[v]
                to = after[v] if word[v] == c else more(v << 32 | c, -1)
            if to < 0:
                continue
            v = to
            length += 1
            if length < least:
                continue
            start = j + 1
            if length >= w:
                start = j + 1 - w
                sets.add(set_of[v])
            if end_of[v]:
                for m, name in self._ends[end_of[v]]:
                    if m <= length:
                        found.add(name)
                        start = min(start, j + 1 - m)
            if start <= j:
                while spans and start <= spans[-1][0]:
                    spans.pop()
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = j + 1
                else:
                    spans.append([start, j + 1])
        for s in sets:
            found.update(self._sets[s])
        return [(a, b) for a, b in spans], found


Block = list[tuple[str, str | None]]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[Block]:
    """Items by id, at most ``BLOCK_WORDS`` words a block, and at least one block, if an
    empty one.  A longer item comes in parts that share a window less a word, so each
    of its windows lies in one.  The driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).orderBy("i", "t")
    block, size, any_ = [], 0, False
    most = max(BLOCK_WORDS, window)
    for r in rows.toLocalIterator():
        words = words_of(r["t"])
        n = len(words)
        parts = [r["t"]] if n <= most else [b" ".join(words[a : a + most]).decode() for a in range(0, n - window + 1, most - window + 1)]
        for part in parts:
            n = min(n, most)
            if block and size + n > BLOCK_WORDS:
                yield block
                block, size, any_ = [], 0, True
            block.append((r["i"], part))
            size += n
    if block or not any_:
        yield block


def _peeked(blocks: Iterator[Block]) -> tuple[Block, Iterator[Block] | None]:
    """The first block, and all of them again if there are more."""
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain((first, second), blocks)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_HIT = "array<struct<start: int, end: int>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pairs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def find(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``keep`` with ``n_words``, ``spans`` (merged word ranges [start, end) hit by
    any window) and ``items`` (distinct ids as strings, sorted) for each document.

    A null or empty text has no words and no hits.  Items without words have no
    windows; items that share an id count as one; a null id is the id ''.  An
    empty benchmark hits nothing; an empty table gives no rows.  Repeated rows
    stay.  Columns not named play no part.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("_text"))
    first, many = _peeked(_blocks(benchmark, item_id, item_text, window))
    out = [F.col("n_words").cast("long").alias("n_words"), "spans", "items"]
    if many is None:
        return _scanned(df, first, window).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *out)
    scratch = Scratch(docs.sparkSession)
    hits = _hits(df.select("_text"), many, window, scratch).withColumnRenamed("tid", "_tid")
    counted = _scanned(df.withColumn("_id", _tid(F.col("_text"))).select(*names, "_id", "_text"), [], window).drop("spans", "items")
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", _HIT), ("items", "array<string>"))]
    return counted.join(hits, F.col("_id") == F.col("_tid"), "left").select(*[F.col(n).alias(c) for c, n in zip(keep, names)], out[0], *none)


def _tid(text):
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _scanned(df: DataFrame, block: Block, window: int) -> DataFrame:
    """``df``, whose last column is the text, without it, with n_words, spans and items."""
    sent = df.sparkSession.sparkContext.broadcast(Automaton(block, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for batch in batches:
            counts, spans, items = [], [], []
            for value in batch.column(batch.num_columns - 1):
                words = words_of(value.as_py())
                hits, found = auto.scan(words) if words else ([], set())
                counts.append(len(words))
                spans.append(_pairs(hits))
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int32()), pa.array(spans, _HITS), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "n_words", "spans", "items"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields[:-1])
    return df.mapInArrow(scan, f"{kinds}n_words int, spans {_HIT}, items array<string>")


def _hits(texts: DataFrame, blocks: Iterator[Block], window: int, scratch: Scratch) -> DataFrame:
    """(tid, spans, items) of the texts that any block hits.  A block's pass writes its
    hits alone, and its automaton is let go before the next is built."""
    parts: DataFrame | None = None
    for block in blocks:
        sent = texts.sparkSession.sparkContext.broadcast(Automaton(block, window))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            auto = sent.value
            for batch in batches:
                at, spans, items = [], [], []
                for i, value in enumerate(batch.column(1)):
                    hits, found = auto.scan(words_of(value.as_py()))
                    if hits:
                        at.append(i)
                        spans.append(_pairs(hits))
                        items.append(sorted(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(spans, _HITS), pa.array(items, pa.list_(pa.string()))], names=["tid", "spans", "items"])

        own = texts.select(_tid(F.col(texts.columns[0])).alias("tid"), F.col(texts.columns[0])).mapInArrow(scan, f"tid string, spans {_HIT}, items array<string>")
        # Equal texts have equal hits: one row of each, before anything is sent.
        got = scratch.cut(own.groupBy("tid").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        sent.destroy()
        parts = got if parts is None else parts.unionByName(got)
    together = parts.groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_pairs(_merge([(s["start"], s["end"]) for s in row])) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _HITS), b.column(2)], names=b.schema.names)

    return scratch.cut(together.mapInArrow(merge, f"tid string, spans {_HIT}, items array<string>"))


def clean_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode()


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The documents without the spans that windows hit.

    Where more than ``max_coverage`` of the words are hit, in all rounds and by
    whatever items, the document goes.
    Removal repeats until no window is left, as what a removal joins may hold a
    new one.  Documents without hits, null and empty texts too, stay as they are, and
    so do all where the benchmark is empty.  Rows keep all their columns, whatever
    their names, and repeated rows stay.  An empty table gives no rows.
    """
    first, many = _peeked(_blocks(benchmark, item_id, item_text, window))
    if many is None:
        return _remove_pass(docs, first, text, window, max_coverage)
    scratch = Scratch(docs.sparkSession)
    cols = docs.columns
    body = F.col(f"`{text}`")
    # Texts that are hit, each once: their digest as a document, how they stand now, and what is gone.
    hits = _hits(docs.select(body.alias("t")), many, window, scratch)
    spots = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    texts = docs.select(_tid(body).alias("own"), body.alias("now"))
    open_ = texts.join(hits.select(F.col("tid").alias("own")), "own", "left_semi").groupBy("own").agg(F.first("now").alias("now"))
    open_ = scratch.cut(_scanned(open_.select("own", "now", F.col("now").alias("_text")), [], window).select("own", F.lit(0).cast("long").alias("gone"), F.col("n_words").cast("long").alias("whole"), "now"))
    done = None
    while True:
        met = scratch.cut(open_.join(hits.select("tid", "spans"), _tid(F.col("now")) == F.col("tid"), "left").select("own", (F.col("gone") + F.coalesce(spots, F.lit(0))).alias("gone"), "whole", "now", F.coalesce("spans", F.array().cast(_HIT)).alias("spans")))
        clean = met.where(F.size("spans") == 0).select("own", F.lit(True).alias("stays"), "now")
        most = met.where((F.size("spans") > 0) & (F.col("gone") > max_coverage * F.col("whole"))).select("own", F.lit(False).alias("stays"), F.lit(None).cast("string").alias("now"))
        done = clean.unionByName(most) if done is None else done.unionByName(clean).unionByName(most)
        more = met.where((F.size("spans") > 0) & (F.col("gone") <= max_coverage * F.col("whole")))
        if not more.limit(1).count():
            break
        open_ = scratch.cut(more.mapInArrow(_cleaned, "own string, gone long, whole long, now string"))
        hits = _hits(open_.select("now"), _blocks(benchmark, item_id, item_text, window), window, scratch)
    named = docs.toDF(*[f"_c{i}" for i in range(len(cols))])
    at = cols.index(text)
    joined = named.join(scratch.cut(done), _tid(F.col(f"_c{at}")) == F.col("own"), "left").where(F.coalesce("stays", F.lit(True)))
    return joined.select(*[(F.when(F.col("own").isNull(), F.col(f"_c{i}")).otherwise(F.col("now")) if i == at else F.col(f"_c{i}")).alias(c) for i, c in enumerate(cols)])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that end with text and spans -> the same without the spans."""
    for b in batches:
        n = b.num_columns
        new = [clean_text(t.as_py(), [(s["start"], s["end"]) for s in spans.as_py()]) for t, spans in zip(b.column(n - 2), b.column(n - 1))]
        yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(new, pa.string())], names=b.schema.names[: n - 1])


def _remove_pass(df: DataFrame, block: Block, text: str, window: int, max_coverage: float) -> DataFrame:
    at = df.columns.index(text)
    sent = df.sparkSession.sparkContext.broadcast(Automaton(block, window))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for batch in batches:
            new, stays = [], []
            for value in batch.column(at):
                t = value.as_py()
                words = words_of(t)
                hits, _ = auto.scan(words) if words else ([], None)
                whole = len(words)
                gone = sum(b - a for a, b in hits)
                while hits and gone <= max_coverage * whole:
                    t = clean_text(t, hits)
                    hits, _ = auto.scan(words_of(t))
                    gone += sum(b - a for a, b in hits)
                new.append(t)
                stays.append(not hits)
            out = pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)
            yield out.filter(pa.array(stays, pa.bool_()))

    return df.mapInArrow(clean, df.schema)
