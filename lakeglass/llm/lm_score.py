"""Language-model scores: stupid backoff over n-gram counts of the whole corpus.

Every document is scored by the counts of all other documents: its own n-grams are taken off first. A word gets the
relative frequency after its two predecessors; if the others have no such trigram, 0.4 times that after one, and so on.

1. Documents become chunks of about ``CHUNK_WORDS`` words: a list of the chunk's distinct words and, per text, places in it.
2. Each chunk counts its n-grams of orders 1 to 3. Distinct ones go, as sorted hashes of ``HASH_BITS`` bits with counts, to the bucket
   that owns their range of hashes; the number of buckets follows from the number of words. A frequent n-gram is one
   entry per chunk, so no bucket is hot.
3. A bucket adds up its part of the count table and answers each chunk in the order of its question.
4. A chunk meets its answers again and sums up the logarithms per document.

Hashes, counts and answers travel packed in binary columns. The driver sees only the number of words. Two of ``n`` distinct n-grams
have the same hash with probability ``n / 2**HASH_BITS`` for each: 3e-9 for 200 million, 3e-4 for 20 trillion.

Defined results: null texts and texts without words have no words and a null score. Words are what stands between ASCII white space, with
A-Z lower-cased. A word that no other document has gets the weight of half an occurrence. Rows that repeat an id are documents of
their own. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.runtime import scratch_path

ORDER = 3
BACKOFF = 0.4
UNSEEN = 0.5
CHUNK_WORDS = 1_500_000
BUCKET_NGRAMS = 6_000_000
CHUNKS = "chunk string, doc_ids array<bigint>, lengths array<int>, vocabulary binary, places binary, n_words bigint"
HASH_BITS = 56
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, lengths, parts, known, held = [], [], [], {}, 0

    def row() -> pd.DataFrame:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        places = np.frombuffer(b"".join(parts), np.uint32)
        order = np.argsort(-np.bincount(places, minlength=len(known)), kind="stable")  # frequent words get small places, which pack well
        rank = np.empty(len(known), np.uint32)
        rank[order] = np.arange(len(known), dtype=np.uint32)
        return pd.DataFrame({"chunk": [uuid.uuid4().hex], "doc_ids": [ids], "lengths": [lengths], "vocabulary": [hashes[order].tobytes()],
                             "places": [_planes(rank[places], 4)], "n_words": [held]})

    for batch in batches:
        for key, text in zip(batch["doc_id"], batch["text"]):
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            ids.append(None if pd.isna(key) else int(key))
            lengths.append(len(words))
            for word in words:
                if word not in known:
                    known[word] = len(known)
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)).tobytes())
            held += len(words)
            if held >= CHUNK_WORDS:
                yield row()
                ids, lengths, parts, known, held = [], [], [], {}, 0
    if ids:
        yield row()


def _ngrams(vocabulary: bytes, places: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the n-grams that end at each word, one array per order; the document of each word; where each order exists."""
    words = np.frombuffer(vocabulary, np.uint64)[_counts(places, int(lengths.sum()), 4)]
    document = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes, last = [], np.zeros(len(words), np.uint64)
    for order in range(1, ORDER + 1):
        shifted = np.zeros(len(words), np.uint64)
        if len(words) >= order:
            shifted[order - 1:] = words[:len(words) - order + 1]
        last = _mixed(last * _FACTORS[0] + shifted * _FACTORS[1] + _FACTORS[2])  # the words so far, from the end; one round per order
        hashes.append(last)
    return document, offset, hashes


def _distinct(offset: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """All n-gram hashes of a chunk in one array, order by order, only where the document has enough words before."""
    return np.concatenate([h[offset >= k] for k, h in enumerate(hashes)]) >> np.uint64(64 - HASH_BITS)


def _edges(buckets: int) -> np.ndarray:
    """The first hash of every bucket but the first."""
    return np.array([(i << HASH_BITS) // buckets for i in range(1, buckets)], np.uint64)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as their differences, which are small numbers the more hashes there are."""
    return _planes(np.diff(sorted_hashes, prepend=np.uint64(0)), 7)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_counts(data, n, 7).view(np.uint64), dtype=np.uint64)


def _planes(numbers: np.ndarray, width: int = 6) -> bytes:
    """Numbers byte by byte, all lowest bytes first, and compressed: the bytes behind are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes())


def _counts(data: bytes, n: int, width: int = 6) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if n:
        wide[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, n).T
    return wide.view("<u8")[:, 0].astype(np.int64)


def _asked(buckets: int):
    edges = _edges(buckets)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, offset, hashes = _ngrams(row.vocabulary, row.places, np.asarray(row.lengths, np.int64))
                found, counts = np.unique(_distinct(offset, hashes), return_counts=True)
                cuts = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
                for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[bucket], cuts[bucket + 1])
                    yield pd.DataFrame({"bucket": [bucket], "chunk": [row.chunk], "n": [own.stop - own.start], "hashes": [_pack(found[own])], "counts": [_planes(counts[own])]})

    return ask


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Add up one bucket of the count table and answer its chunks."""
    sizes = group["n"].to_numpy()
    hashes = np.concatenate([_unpack(h, n) for h, n in zip(group["hashes"], sizes)])
    counts = np.concatenate([_counts(c, n) for c, n in zip(group["counts"], sizes)])
    order = np.argsort(hashes)
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    totals = np.add.reduceat(counts[order], starts)
    counts[order] = np.repeat(totals, np.diff(np.append(starts, len(ordered))))
    ends = np.cumsum(sizes)
    return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "n": sizes, "counts": [_planes(counts[e - n:e]) for e, n in zip(ends, sizes)]})


def _own_counts(document: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often the n-gram at each word stands in its own document."""
    if not len(place):
        return place
    _, back, n = np.unique(document * (place.max() + 1) + place, return_inverse=True, return_counts=True)
    return n[back]


def _scored(total: int):
    def score(key, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks):
            return pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_words": [], "log_score": []})
        row = chunks.iloc[0]
        lengths = np.asarray(row["lengths"], np.int64)
        document, offset, hashes = _ngrams(row["vocabulary"], row["places"], lengths)
        _, back = np.unique(_distinct(offset, hashes), return_inverse=True)
        told = answers.sort_values("bucket")
        counts = np.concatenate([np.zeros(0, np.int64), *[_counts(c, n) for c, n in zip(told["counts"], told["n"])]])
        others, at = [], 0  # per order: how often the other documents have the n-gram that ends at a word; -1 where there is none
        for k in range(ORDER):
            there = np.flatnonzero(offset >= k)
            place = back[at:at + len(there)]
            at += len(there)
            rest = np.full(len(document), -1, np.int64)
            rest[there] = counts[place] - _own_counts(document[there], place)
            others.append(rest)
        everything = total - lengths[document]
        logs = np.log(np.where(others[0] > 0, others[0], UNSEEN)) - np.log(np.maximum(everything, 1))
        depth = np.zeros(len(document), np.int64)
        for k in range(1, ORDER):
            seen = np.flatnonzero(others[k] > 0)
            logs[seen] = np.log(others[k][seen]) - np.log(others[k - 1][seen - 1])
            depth[seen] = k
        logs += np.log(BACKOFF) * (np.minimum(offset, ORDER - 1) - depth)
        sums = np.bincount(document, logs, len(lengths)) if len(document) else np.zeros(len(lengths))
        means = [float(s / n) if n else None for s, n in zip(sums, lengths)]
        ids = [None if pd.isna(x) else int(x) for x in row["doc_ids"]]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": lengths, "log_score": pd.array(means, "Float64")})

    return score


def _bucketed(chunks: DataFrame) -> DataFrame:
    """The chunks as a table in the scratch folder, bucketed by chunk: they stay where they are when answers come back."""
    spark = chunks.sparkSession
    name = f"lm_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks")).format("parquet").saveAsTable(name)
    return spark.table(name)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, log_score`` for every row: the mean natural logarithm of the words' scores."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = _bucketed(texts.mapInPandas(_chunks, CHUNKS))
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total * ORDER // BUCKET_NGRAMS))
    asked = chunks.mapInPandas(_asked(buckets), "bucket int, chunk string, n int, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(_answer, "chunk string, bucket int, n int, counts binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scored(total), "doc_id bigint, n_words bigint, log_score double")
