"""Token ids in Simple-8b files.

A file is a Parquet table with one row per block of consecutive documents: ``part`` and ``block`` give the order,
``doc_ids`` and ``lengths`` (ids per document) the index, ``words`` the packed ids as little-endian 64-bit words, and
``start`` the number of ids before the block in its part, ``offsets`` that before every 1024th word in
its block, where a reader may start. The top four bits of a word are its
selector, which says how many ids of how many bits the other sixty hold. Ids of 60 bits and more cannot be packed:
an escape word (selector 15) counts the raw 64-bit words that follow it.

Documents are in ascending order of ``doc_id``; a null id comes first. A null text is an empty text, whose document
holds only the end id. Rows that repeat an id are documents of their own, ordered by text. Other columns are not
written. A single text is never split over blocks.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: ids per word and bits per id for selectors 0 to 13. 14 is free, 15 escapes.
LAYOUT = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
SELECTORS = [x for x in LAYOUT if x not in ((240, 0), (1, 60))]  # 14 selectors; runs of 120 zeros and single ids are kept below
ESCAPE = 15
SINGLE = 14  # one id of up to 60 bits
END_ID = 2
BLOCK_IDS = 1 << 17
STRIDE = 1024
#: Parts of texts whose ids a worker keeps at a time, of either kind; some 150 MB.
CACHED_WORDS = 700_000
FORMAT = "part int, block int, doc_ids array<bigint>, lengths array<bigint>, start bigint, n_ids bigint, words binary, offsets array<bigint>"


def pack(ids: np.ndarray) -> np.ndarray:
    """Ids (uint64) as Simple-8b words. Every word takes as many of the next ids as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    widths = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # at most one too many, for ids beyond 2**53
    doubled = [widths]  # maxima of 1, 2, 4, ... neighbours
    while 2 << len(doubled) - 1 <= min(n, SELECTORS[0][0]):
        size = 1 << len(doubled) - 1
        doubled.append(np.maximum(doubled[-1][:-size], doubled[-1][size:]))
    choice = np.full(n, SINGLE, np.uint8)
    choice[ids >= np.uint64(1) << np.uint64(60)] = ESCAPE
    for selector in range(len(SELECTORS) - 1, -1, -1):  # from few wide ids to many narrow ones, which win
        count, bits = SELECTORS[selector]
        if count <= n:
            half = doubled[count.bit_length() - 1]  # two windows of a power of two cover one of any size
            rest = count - (1 << count.bit_length() - 1)
            widest = np.maximum(half[:len(half) - rest], half[rest:]) if rest else half
            choice[:n - count + 1][widest <= bits] = selector
    takes = np.array([count for count, _ in SELECTORS] + [1, 1])[choice]
    step, starts, at = takes.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts)
    chosen = choice[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(SELECTORS + [(1, 60)]):
        own = np.flatnonzero(chosen == selector)
        for k in range(count if bits and len(own) else 0):
            words[own] |= ids[first[own] + k] << np.uint64(bits * k)
    escaped = chosen == ESCAPE
    if not escaped.any():
        return words
    out, at = [], 0
    while at < len(words):  # runs of escaped ids share one escape word
        end = at
        while end < len(words) and escaped[end] == escaped[at]:
            end += 1
        if escaped[at]:
            out.append(np.array([ESCAPE << 60 | end - at], np.uint64))
            out.append(ids[first[at:end]])
        else:
            out.append(words[at:end])
        at = end
    return np.concatenate(out)


def _kinds(words: np.ndarray) -> np.ndarray:
    """The selector of every word; 16 for the raw words behind an escape."""
    kinds = (words >> np.uint64(60)).astype(np.uint8)
    if (kinds == ESCAPE).any():
        free = 0
        for at in np.flatnonzero(kinds == ESCAPE).tolist():
            if at >= free:
                free = at + 1 + int(words[at] & np.uint64((1 << 60) - 1))
                kinds[at + 1:free] = 16
    return kinds


def _sizes(kinds: np.ndarray) -> np.ndarray:
    return np.array([count for count, _ in SELECTORS] + [1, 0, 1])[kinds]


def unpack(words: np.ndarray, n: int | None = None) -> np.ndarray:
    """The ids of Simple-8b words: one vectorised step per selector."""
    words = np.asarray(words, np.uint64)
    kinds = _kinds(words)
    sizes = _sizes(kinds)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS + [(1, 60)]):
        own = np.flatnonzero(kinds == selector)
        for k in range(count if bits and len(own) else 0):
            out[starts[own] + k] = words[own] >> np.uint64(bits * k) & np.uint64((1 << bits) - 1)
    raw = np.flatnonzero(kinds == 16)
    out[starts[raw]] = words[raw]
    return out if n is None else out[:n]


def offsets_of(words: np.ndarray) -> np.ndarray:
    """How many ids stand before each word at which a reader may start; never one behind an escape."""
    kinds = _kinds(words)
    sizes = _sizes(kinds)
    before = (np.cumsum(sizes) - sizes)[::STRIDE].copy()
    before[kinds[::STRIDE] == 16] = -1
    return before


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Latin letters and digits of the ranges below, lower-cased, and the tokenizer's pieces spelled out for them.
_LATIN = re.compile("[\x00-\x7f¡-ĩĲ-ňŊ-ž]*")
_LETTERS = "a-zªµºß-öø-ž"
_DIGITS = "0-9²³¹¼-¾"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^ \t\n\r\x0b\x0c{_LETTERS}{_DIGITS}]+")
_END = np.array([END_ID], "<u4").tobytes()
# The steps of tokenizer files whose texts may be encoded word by word. Texts of any other file are encoded whole.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class _Ids(dict):
    """Ids of parts as bytes; a part not yet known is encoded when it is asked for. Starts anew when it is full."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[part] = array("I", self.ids_of(part)).tobytes()
        return found


class WordEncoder:
    """Encodes texts through caches of their parts, whose size does not depend on the input.

    A tokenizer that splits at white space and normalises it away gives a text the ids of its words in order. Latin texts
    are then cut into the tokenizer's own pieces, which go to its model at once; all others are cut at white space only.
    With any other tokenizer texts are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        steps = json.loads(self.tokenizer.to_str())
        self.by_word = all(steps.get(k) == v for k, v in _BY_WORD.items()) and all(t["content"].startswith("<|") for t in steps["added_tokens"])
        self.pieces = _Ids(self._model_ids)
        self.words = _Ids(self._ids)

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.array([*self._ids(text), END_ID], "<u4")
        if _is_latin(text):
            found = map(self.pieces.__getitem__, _PIECES.findall(text.lower()))
        else:
            found = map(self.words.__getitem__, _words(text))
        return np.frombuffer(b"".join([*found, _END]), "<u4")

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _model_ids(self, piece: str) -> list[int]:
        return [token.id for token in self.tokenizer.model.tokenize("".join(map(_byte_signs().__getitem__, piece.encode())))]


@functools.cache
def _byte_signs() -> list[str]:
    """The sign of each byte in the vocabulary: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


def _is_latin(text: str) -> bool:
    return "<|" not in text and (text.isascii() or _LATIN.fullmatch(text) is not None)


def _words(text: str) -> list[str]:
    """Words between what the tokenizer takes for white space: what ``split`` does, but for four control characters."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return re.split(r"[^\S\x1c-\x1f]+", text)
    return text.split()


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _block(part: int, number: int, start: int, keys: list, arrays: list[np.ndarray]) -> pd.DataFrame:
    lengths = np.array([len(a) for a in arrays], np.int64)
    words = pack(np.concatenate(arrays).astype(np.uint64))
    return pd.DataFrame({"part": [part], "block": [number], "doc_ids": [keys], "lengths": [lengths], "start": [start], "n_ids": [int(lengths.sum())],
                         "words": [words.astype("<u8").tobytes()], "offsets": [offsets_of(words)]})


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` in ascending order of their ids into a new file at ``path``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, keys, arrays, held, start, number, part = _encoder(tokenizer), [], [], 0, 0, 0, 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for key, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text)
                keys.append(None if pd.isna(key) else int(key))
                arrays.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield _block(part, number, start, keys, arrays)
                    keys, arrays, held, start, number = [], [], 0, start + held, number + 1
        if keys:
            yield _block(part, number, start, keys, arrays)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of ids are cut by the ids alone: one aggregate that reads no text, one number per task
    cuts = docs.agg(F.percentile_approx(F.col(doc_id).cast("bigint"), [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(cuts))]).cast("array<bigint>")
    place = F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(0))
    placed = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(place).cast("int"))
    ordered = placed.repartitionById(parts, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInPandas(encode, FORMAT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a file: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids``, decoded block by block.

    ``start`` is the number of ids before the document. Only the sizes of parts are summed up for it, one row for each
    task that wrote.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = unpack(np.frombuffer(row.words, "<u8"), row.n_ids).astype("<u4")
                ends = np.cumsum(row.lengths)
                cut = [ids[end - n:end] for end, n in zip(ends, row.lengths)]
                made = {"doc_id": pd.array([None if pd.isna(k) else int(k) for k in row.doc_ids], "Int64"),
                        "start": row.before + row.start + ends - row.lengths, "n_tokens": row.lengths, "ids_crc32": [zlib.crc32(x) for x in cut]}
                yield pd.DataFrame(made | ({"ids": cut} if with_ids else {}))

    blocks = spark.read.schema(FORMAT).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    before = spark.createDataFrame([(int(p), int(b)) for p, b in zip(parts["part"], parts["n"].cumsum() - parts["n"])], "part int, before bigint")
    placed = blocks.select("part", "doc_ids", "lengths", "start", "n_ids", "words").join(F.broadcast(before), "part")
    return placed.mapInPandas(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))
