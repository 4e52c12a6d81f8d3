"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.llm.common import text_blocks, word_spans, write_table

CAPACITY = 2048
GROUP = 8192
#: Weights of the residual tokens, documents and attention cost in the norm that picks a bin: all three steer.
WEIGHTS = (1.0, 1.0, 1.0)
#: Parts of words that a worker remembers, beside those of the block at hand; bytes of a block.
PARTS_KEPT, TEXT_BLOCK = 300_000, 1 << 20

#: What a character below U+0180 is to the splitter; _LATER marks a character's second byte.
_ODD, _LETTER, _DIGIT, _SIGN, _LATER = 0, 1, 2, 3, 8
_ENDS_WORD = np.isin(np.arange(256), [0x20, 0x09, 0x0A])


def _kind(c: int) -> int:
    """Odd are white space, controls, the apostrophe (it may begin a contraction) and what changes length in lower case."""
    if c <= 0x20 or 0x7F <= c <= 0xA0 or c == 0x27 or len(chr(c).lower()) > 1:
        return _ODD
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(c))[0], _SIGN)


_KIND = np.array([_kind(c) for c in range(0x180)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x180)], np.uint16)
_ODD_BYTES = re.compile(rb"[^\x21-\x26\x28-\x7e\x80-\xbf\xc2-\xc5]|\xc2[\x80-\xa0]|\xc4\xb0")


class WordTokenizer:
    """Token ids of whole texts by a BPE vocabulary whose pre-tokeniser drops white space, parts of words remembered.

    White space always ends a word there, so a text's ids are its words' ids, end to end. A block of texts is cut at
    once: words of plain Latin letters (below U+0180, where normalisation only lower-cases), digits and signs into the
    parts that the vocabulary file's pattern finds; any other word is a part of its own, for the whole tokeniser. Each
    distinct part of a block is looked up once. A file with another normaliser, splitter or kind of special token is
    left to the tokeniser itself, text by text.
    """

    #: The split pattern and normalisers of the vocabulary file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = not self._known(json.loads(self.tokenizer.to_str()))
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        # no part holds a line end, which therefore stands between parts
        self.bytes_to_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest) if b != 10}
        self._forget()

    def _known(self, file: dict) -> bool:
        split, level = ((file["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
        return (
            (file["normalizer"] or {}).get("normalizers") == self.NORMALIZERS
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": self.PATTERN}, "Removed", True)
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and len(file["pre_tokenizer"]["pretokenizers"]) == 2
            and all(t["content"].startswith("<|") for t in file["added_tokens"])
            and file["truncation"] is None
        )

    def _forget(self) -> None:
        """No part is known: parts' numbers, and by number where their ids are and how many."""
        self.numbers: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, parts: list[bytes]) -> None:
        """Remember the ids of new parts."""
        chars = b"\n".join(parts).decode("latin-1").translate(self.bytes_to_chars).split("\n")
        found = [self._encode(p.decode("utf-8", "replace")) if _ODD_BYTES.search(p) else [t.id for t in self.model.tokenize(c)] for p, c in zip(parts, chars)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.numbers.update(zip(parts, range(len(self.sizes), len(self.sizes) + len(parts))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32)])

    def ids(self, data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text of a block, data[offs[i] : offs[i + 1]], as unsigned 32-bit numbers."""
        raw = data.tobytes()
        n = len(offs) - 1
        # texts that may hold a special token's string, with white space of its own around it, are encoded whole
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else np.zeros(0, np.int64)
        whole = set(range(n)) if self.plain else set((np.searchsorted(offs, marks, "right") - 1).tolist())
        flat, ends = (np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)) if self.plain else self._block(data, offs)
        for i in range(n):
            yield np.array(self._encode(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace")), np.uint32) if i in whole else flat[ends[i] : ends[i + 1]]

    def _block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts in them)."""
        n = len(offs) - 1
        starts, ends, _ = word_spans(data, offs, _ENDS_WORD)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        nxt = np.append(data[1:], 0)
        pair = (data >= 0xC2) & (data <= 0xC5)  # begins a character from U+0080 to U+017F
        code = np.where(pair, ((data & 0x1F).astype(np.uint16) << 6) | (nxt & 0x3F), data)
        kind, lower = np.where(pair | (data < 0x80), _KIND[code], _ODD), _LOWER[code]
        after = np.flatnonzero(pair) + 1
        after = after[after < len(data)]
        kind[after] = np.where(kind[after - 1] == _ODD, _ODD, kind[after - 1] | _LATER)
        low = np.where(pair, (lower >> 6) | 0xC0, lower).astype(np.uint8)
        low[after] = (lower[after - 1] & 0x3F) | 0x80
        # words with any other character stay whole and as they are
        odd = np.concatenate([[0], np.cumsum(kind == _ODD, dtype=np.int32)])
        slow = odd[ends] > odd[starts]
        in_slow = np.zeros(len(data) + 1, np.int8)
        np.add.at(in_slow, starts[slow], 1)
        np.add.at(in_slow, ends[slow], -1)
        in_slow = np.cumsum(in_slow[:-1], dtype=np.int8).astype(bool)
        low = np.where(in_slow, data, low)
        base = kind % _LATER
        new = np.zeros(len(data), bool)
        new[1:] = ((base[1:] != base[:-1]) | (kind[1:] == _DIGIT)) & ~in_slow[1:]
        inside = ~_ENDS_WORD[data]
        new &= inside
        new[starts] = True
        first = np.flatnonzero(new)
        at = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
        bounds = np.append(at[first], at[-1]).astype(np.int32)
        strings = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low[inside]))])
        coded = strings.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        new_parts = [k for k in keys if k not in self.numbers]
        if len(self.numbers) + len(new_parts) > PARTS_KEPT:
            self._forget()
            new_parts = keys
        self._learn(new_parts)
        number = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        which = number[np.array(coded.indices)]
        count = self.sizes[which]
        total = np.concatenate([[0], np.cumsum(count)])
        pick = np.repeat(self.starts[which] - total[:-1], count) + np.arange(total[-1])
        return self.flat[pick], total[np.searchsorted(first, offs)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokeniser per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenized_pieces(docs: DataFrame, *, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and one ``end_id``, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(vocabulary)
        for batch in batches:
            for first, _, data, offs in text_blocks(batch.column(1), TEXT_BLOCK):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(known.ids(data, offs)):
                    got = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(got), capacity)):
                        part = got[at : at + capacity]
                        rows.append(first + i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, t()) for n, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids_crc32", T.LongType))]])
    return rows.mapInArrow(run, schema)


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: float, weights: tuple[float, ...] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Longest first, each goes to the open bin with room in every dimension (tokens,
    documents, attention cost = squared length) whose residual vector afterwards has the smallest weighted norm."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 0:
        return bins, offsets
    limits = np.array([capacity, max_docs, max_attention], float)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min())
    left = np.zeros((3, n))  # residuals of the open bins, in units of the limits
    number = np.zeros(n, np.int64)
    open_, made = 0, 0
    w = np.sqrt(np.array(weights, float))[:, None]
    for step, i in enumerate(order.tolist()):
        size = int(lengths[i])
        need = np.array([size, 1, size * size], float)[:, None] / limits[:, None]
        after = left[:, :open_] - need
        norm = np.einsum("ij,ij->j", after * w, after * w)
        norm[(after < -1e-12).any(0)] = np.inf
        k = int(norm.argmin()) if open_ else 0
        if not open_ or norm[k] == np.inf:
            k, open_ = open_, open_ + 1
            left[:, k], number[k], made = 1.0, made, made + 1
        bins[i], offsets[i] = number[k], round((1.0 - left[0, k]) * capacity)
        left[:, k] -= need[:, 0]
        if step % 64 == 63:  # bins too full for the smallest piece are closed
            keep = np.flatnonzero((left[0, :open_] * capacity >= least - 0.5) & (left[1, :open_] * max_docs >= 0.5))
            left[:, : len(keep)], number[: len(keep)] = left[:, keep], number[keep]
            open_ = len(keep)
    return bins, offsets


def pack(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt at random into groups of about ``group``, each packed on its own. Null texts are empty: one piece
    with the end id alone. Repeated rows and null ids are pieces of their own. An empty table gives no rows.
    ``max_docs`` and ``max_attention`` bound each sequence's pieces and sum of squared lengths; unset, they are
    ``capacity`` and its square, which tokens keep: they then steer the choice of the bin but never open one.
    """
    max_docs = max_docs or capacity
    max_attention = max_attention or float(capacity) ** 2
    pieces = write_table(tokenized_pieces(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, capacity=capacity), "pack-pieces")
    groups = max(1, round(pieces.count() / group))
    pieces = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = vector_best_fit(rows["length"].to_numpy(), capacity, max_docs, max_attention)
        rows["sequence_id"] = rows["pack_group"].to_numpy() * (1 << 32) + bins
        rows["offset"] = offsets
        return rows.drop(columns="pack_group")

    schema = T.StructType([f for f in pieces.schema if f.name != "pack_group"]).add("sequence_id", "long").add("offset", "long")
    return pieces.groupBy("pack_group").applyInPandas(run, schema)


def op10_vector_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))
