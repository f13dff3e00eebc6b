"""Packing by power-of-two decomposition.

A document of T tokens is cut into pieces whose lengths are powers of two: as
many of ``max_len`` as fit, then the binary digits of the rest, largest first.
Each piece is a sequence of its own, so no sequence crosses documents, and since
a power of two needs no padding there is none.  Pieces of one length share a
bucket, and ``batches`` deals each bucket's sequences into batches.

Packing shuffles nothing: every piece follows from its own document.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .prefix import prefix_sums

#: Characters that both libraries put in the same classes (a test tries each of them); a text with any other takes the plain way.
SURE = "\x00-\x1b\x20-\x84\x86-\u052f\u2010-\u2027\u20a0-\u20bf\u3001-\u30ff\u4e00-\u9fef\uac00-\ud7a3"
_UNSURE = re.compile(f"[^{SURE}]")
#: Fixed value: how a byte-level pre-tokenizer splits a text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, "Encoder"] = {}


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a whole text as little-endian unsigned 32-bit bytes, as the tokenizer
    file at ``path`` gives them without special tokens.

    A byte-level BPE whose ids follow its merges is the same function as a rank
    table, and the rank coder of ``tiktoken`` is several times faster; it is loaded
    from the same file.  Other tokenizers, and texts with special tokens or unsure
    characters, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self._tok = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranked(spec)

    @property
    def tok(self):
        """The library's own tokenizer; most workers never meet a text that needs it."""
        if self._tok is None:
            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_file(self.path)
        return self._tok

    def _ranked(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        byte_of, vocab = _byte_of(), model["vocab"]
        merged = [vocab.get(a + b, -1) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if any(x >= y for x, y in zip(merged, merged[1:])) or any(ch not in byte_of for t in vocab if t not in self.special for ch in t):
            return None
        import tiktoken

        ranks = {bytes(byte_of[ch] for ch in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if all(bytes([b]) in ranks for b in range(256)) else None

    def encode(self, text: str) -> bytes:
        import numpy as np

        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special) or _UNSURE.search(text):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def binary_pieces(tokens: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; lengths are powers of two up to ``max_len``."""
    out = [(i * max_len, max_len) for i in range(tokens // max_len)]
    at, rest = len(out) * max_len, tokens % max_len
    while rest:
        n = 1 << (rest.bit_length() - 1)
        out.append((at, n))
        at, rest = at + n, rest - n
    return out


_SCHEMA = "start long, length long, ids binary, doc_tokens long"
_FLUSH_BYTES = 8 << 20


def pack(docs: DataFrame, tokenizer: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document.

    ``keep`` names the columns that go along.  Results: ``start`` and ``length``
    (tokens within the document), ``ids`` (the piece, little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id`` (unique in this result; it numbers rows by
    their place, so another partitioning of the input gives other numbers), ``offset``
    (always 0: a piece fills its sequence), ``bucket`` (log2 of the length).

    A null or empty text gives one piece that holds ``end_id`` alone.  Repeated
    rows are packed as often as they occur.  An empty table gives no rows.
    Columns of ``docs`` that aren't kept play no part, whatever their names.
    ``max_len`` must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            at, cols, ids, size = [], ([], [], []), [], 0

            def out(batch=batch):
                taken = batch.select(range(len(keep))).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(ids, pa.binary()), pa.array(cols[2], pa.int64())],
                    names=[*taken.schema.names, "start", "length", "ids", "doc_tokens"],
                )

            for i, value in enumerate(batch.column(len(keep))):
                whole = enc.encode(value.as_py() or "") + end
                n = len(whole) // 4
                for start, length in binary_pieces(n, max_len):
                    at.append(i)
                    cols[0].append(start)
                    cols[1].append(length)
                    cols[2].append(n)
                    ids.append(whole[4 * start : 4 * (start + length)])
                size += len(whole)
                if size > _FLUSH_BYTES:
                    yield out()
                    at, cols, ids, size = [], ([], [], []), [], 0
            if at:
                yield out()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    packed = rows.mapInArrow(cut, f"{kinds}, {_SCHEMA}" if kinds else _SCHEMA)
    return packed.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        "start",
        "length",
        "ids",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )


def batches(packed: DataFrame, sequences: int) -> DataFrame:
    """``packed`` with ``batch`` and ``place``: sequences of one bucket, so of one length,
    in batches of ``sequences`` (the last of a bucket may be smaller).  Batches count
    from 0 in each bucket, places in each batch.  The order is by a hash of the ids, so
    a batch mixes documents; a bucket is dealt out over as many tasks as it needs.  An
    empty table gives no rows.
    """
    if sequences < 1:
        raise ValueError("a batch holds one sequence at least")
    ranked = prefix_sums(packed, ["bucket"], [F.xxhash64("ids"), F.col("sequence_id")], [], Scratch(packed.sparkSession))
    return ranked.select(*packed.columns, F.floor(F.col("row_before") / sequences).alias("batch"), (F.col("row_before") % sequences).alias("place"))
