"""Language ID with bit-sliced Bloom filters of byte n-grams.

All languages share one table of slots; a slot holds a bit for each language.  An
n-gram sets its language's bit in a few slots, and the AND of these slots gives
all languages that hold the n-gram, at once.  A document's hits are counted per
language, corrected for the filter's false positives, and the largest share
decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean_workers

#: A-Z to a-z; other ASCII than letters to spaces.
_FOLD = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256)), np.uint8)
_LETTER = re.compile(r"[^\W\d_]")
#: Odd multipliers of the slot hashes; each takes the top bits of a 64-bit product.
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Languages in a word of a slot, a bit each; a slot has as many words as the languages need.
WORD_BITS = 64
#: Bytes of text that are looked at together, and n-grams of a language that a task holds while it counts.
_SLICE, _DISTINCT = 1 << 19, 1 << 18


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams of all texts as integers, and where each text's begin.

    A text is folded and stands between spaces; n-grams with two spaces in a row
    are zero and count nowhere.  n is 7 at most.
    """
    sizes = np.array([len(t) for t in texts], np.int64) + 2 * 2
    flat = _FOLD[np.frombuffer(b"".join(b"  " + t + b"  " for t in texts), np.uint8)]
    out = np.zeros(len(flat), np.uint64)
    usable = len(flat) - n + 1
    if usable > 0:
        acc = np.zeros(usable, np.uint64)
        for i in range(n):
            acc = (acc << np.uint64(8)) | flat[i : i + usable]
        pair = (flat[:-1] == 32) & (flat[1:] == 32)
        bad = np.zeros(usable, bool)
        for i in range(n - 1):
            bad |= pair[i : i + usable]
        acc[bad] = 0
        out[:usable] = acc
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return out, starts


def _slots(keys: np.ndarray, j: int, log2_slots: int) -> np.ndarray:
    return ((keys * _MULT[j]) >> np.uint64(64 - log2_slots)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    slots: np.ndarray  # word of a slot, slot
    log2_slots: int
    n: int
    false: np.ndarray  # false positives by language

    @classmethod
    def build(cls, held: dict[str, np.ndarray], n: int, log2_slots: int) -> "Model":
        """``held``: each language's n-grams, the most frequent language first."""
        langs = list(held)
        kind = next((t for t, m in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= m), np.uint64)
        slots = np.zeros((-(-len(langs) // WORD_BITS), 1 << log2_slots), kind)
        for b, lang in enumerate(langs):
            for j in range(len(_MULT)):
                np.bitwise_or.at(slots[b // WORD_BITS], _slots(held[lang], j, log2_slots), kind(1 << b % WORD_BITS))
        fill = np.array([((slots[b // WORD_BITS] >> kind(b % WORD_BITS)) & kind(1)).mean() for b in range(len(langs))])
        return cls(langs, slots, log2_slots, n, fill ** len(_MULT))

    def masks(self, keys: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the languages that hold it, as bits; ``word``: which 64 languages."""
        slots = self.slots[word]
        m = slots[_slots(keys, 0, self.log2_slots)]
        for j in range(1, len(_MULT)):
            m &= slots[_slots(keys, j, self.log2_slots)]
        return m

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language, the corrected share of its n-grams that the language holds."""
        keys, starts = grams(texts, self.n)
        some = keys != 0
        total = np.maximum(np.add.reduceat(some.astype(np.int64), starts), 1)
        out = np.empty((len(texts), len(self.langs)))
        for b in range(len(self.langs)):
            if b % WORD_BITS == 0:
                m = self.masks(keys, b // WORD_BITS)
                m[~some] = 0
            hits = np.add.reduceat(((m >> m.dtype.type(b % WORD_BITS)) & m.dtype.type(1)).astype(np.int64), starts)
            out[:, b] = np.clip((hits / total - self.false[b]) / (1 - self.false[b]), 0, 1)
        return out

    def decide(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language of each text and its share, which doesn't depend on how many other
        languages there are; ties and texts without any known n-gram go to the language
        that is more frequent in training."""
        s = self.shares(texts)
        best = s.argmax(axis=1)
        return [self.langs[b] for b in best], [float(x) for x in s[np.arange(len(texts)), best]]


def _merged(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of keys with their counts as one."""
    if a is None or not len(a[0]) or not len(b[0]):
        return b if a is None or not len(a[0]) else a
    keys, times = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", n: int = 5, min_share: float = 2e-5, log2_slots: int = 20, docs_per_lang: int = 20_000) -> Model:
    """Fit on rows with a text and a language.

    ``docs_per_lang`` bounds the labelled rows that are read for a language: about
    so many, chosen by a hash of ``key``.  ``min_share`` keeps the n-grams that make
    up at least that part of a language's, so at most 1/min_share of them reach the
    driver for each.  All languages are learned.  Without any labelled text the model
    knows the language und alone.
    """
    lean_workers(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)).alias("u")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Model.build({"und": np.zeros(0, np.uint64)}, n, log2_slots)
    names = [r["lang"] for r in counts]
    spark = docs.sparkSession
    # A row for each language.
    part = F.broadcast(spark.createDataFrame([(r["lang"], docs_per_lang / r["count"] * 1_000_000) for r in counts], "lang string, part double"))
    sample = rows.join(part, "lang").where(F.col("u") < F.col("part")).select("lang", "text")

    def out(tag: str, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([tag] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(tag: str) -> None:
            # An n-gram takes many times its byte while it is counted, so a slice at a time.
            keys, _ = grams(held.pop(tag), n)
            del sizes[tag]
            sums[tag] = _merged(sums.get(tag), np.unique(keys[keys != 0], return_counts=True))

        for batch in batches:
            for tag, text in zip(batch.column(0), batch.column(1)):
                tag, text = tag.as_py(), text.as_py().encode("utf-8", "replace")
                held.setdefault(tag, []).append(text)
                sizes[tag] = sizes.get(tag, 0) + len(text)
                if sizes[tag] > _SLICE:
                    fold(tag)
                    if len(sums[tag][0]) > _DISTINCT:
                        yield out(tag, *sums.pop(tag))
                elif sum(sizes.values()) > 4 * _SLICE:
                    for t in list(held):
                        fold(t)
        for t in list(held):
            fold(t)
        for t, found in sums.items():
            yield out(t, *found)

    summed = sample.mapInArrow(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    # Read twice: written, as what executors would hold of it is large beside their memory.
    scratch = Scratch(spark)
    summed = scratch.cut(summed)
    least = F.broadcast(summed.groupBy("lang").agg((F.sum("times") * min_share).alias("least")))
    frequent = summed.join(least, "lang").where(F.col("times") >= F.col("least")).select("lang", "gram").toPandas()
    scratch.drop()
    found = {name: part["gram"].to_numpy().astype(np.uint64) for name, part in frequent.groupby("lang")}
    held = {name: found.get(name, np.zeros(0, np.uint64)) for name in names}
    return Model.build(held, n, log2_slots)


def predict(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score`` (0 to 1: the share of its n-grams that
    the language holds, corrected for false positives) of every whole text.

    ``und`` with score 0 if the text is null or has no letter.  A text with letters
    but no known n-gram gets the most frequent language with score 0.  Repeated rows
    stay; an empty table gives no rows; columns not named play no part.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    # A text that is kept goes to Python once.
    at = keep.index(text) if text in keep else len(keep)
    df = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], *([] if text in keep else [F.col(text).alias("_text")]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**log2_slots words of 8 bytes for every 64 languages

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            langs, scores = ["und"] * n, [0.0] * n
            held: list[tuple[int, bytes]] = []
            size = 0

            def flush():
                if held:
                    got, sure = m.decide([b for _, b in held])
                    for (i, _), g, s in zip(held, got, sure):
                        langs[i], scores[i] = g, s
                    held.clear()

            for i, value in enumerate(batch.column(at)):
                t = value.as_py()
                if has_letter(t):
                    b = t.encode("utf-8", "replace")
                    held.append((i, b))
                    size += len(b)
                    if size > _SLICE:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields[: len(names)])
    return df.mapInArrow(judge, f"{kinds}lang_pred string, score double").select(*[F.col(a).alias(c) for c, a in zip(keep, names)], "lang_pred", "score")
