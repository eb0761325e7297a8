"""Near-duplicate documents: MinHash with banding, confirmed on full shingle sets, grouped into components.

Words are what stands between ASCII white space, with A-Z lower-cased. The set of a text holds its distinct runs of
five words; a shorter text is one run. Two documents are linked when ``100 * |A and B| >= percent * |A or B|``, by default at 85.

1. Every text becomes the digest of its set, the minima of ``BANDS * rows`` universal hashes, and a key per band.
   ``rows`` follows from the similarity: a pair at the threshold shares no key with a probability of ``MISSED`` at most,
   which is (1 - 0.85**7)**32 at 85 and (1 - 0.8**5)**32 at 80.
2. Documents of one digest are one class; its smallest id stands for it from here on, or a number of its own if another class has that id too.
3. Classes that share a band key are a bucket; buckets with the same members count once. All pairs of a bucket are
   compared within its task, first by their minima: members that agree with no other in enough of them (4.5 standard deviations below
   the threshold) leave the bucket before full sets are made for the rest. Then the sizes of intersections decide. A bucket answers with just enough links to connect
   what is linked, so a group of n copies yields n - 1 rows.
4. No task gets more than ``BLOCK`` classes. In a larger bucket every member is first compared with one centre; then
   blocks of those that this left outside the largest component meet all other blocks, two at a time. Nothing is left out.
5. Links become components by large-star and small-star steps.

Defined results: texts that are null or without words have an empty set, link with nothing and are kept. Rows that
repeat a ``doc_id`` share one component. A null ``doc_id`` cannot be named: such a row has a null component and is kept.
Other columns are not read; ``dedup`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lakeglass.llm.components import components
from lakeglass.llm.shared import BROADCAST_IDS, discard, written

WORDS = 5
BANDS = 32
ROWS = 7
SIMILARITY_PERCENT = 85
#: The probability with which the bands may miss a pair at the similarity.
MISSED = 5e-6
#: Classes that one task compares with each other.
BLOCK = 2048

_random = np.random.default_rng(5)
_PLACES = _random.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_KEYS = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rows_for(percent: int) -> int:
    """Minima a band may have, at most ``ROWS``, to miss a pair at the similarity no more often than ``MISSED``."""
    for rows in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** BANDS <= MISSED:
            return rows
    raise ValueError(f"{BANDS} bands do not find pairs at {percent}%")


def agreeing(percent: int) -> int:
    """Agreeing minima below which a pair cannot plausibly reach the similarity."""
    share, n = percent / 100, BANDS * rows_for(percent)
    return int(n * (share - 4.5 * (share * (1 - share) / n) ** 0.5))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    count = max(1, n - size + 1)
    total = np.full(count, np.uint64(min(n, size)))
    for k in range(min(n, size)):
        total += _mixed(hashes[k:k + count] + _PLACES[k])  # places make order count
        total = _mixed(total)
    return np.unique(total)


def minima(shingles: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The least value of each of ``BANDS * rows`` universal hashes over a set; a slice of the set at a time."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        values = _FACTORS[:len(best), None] * low[None, at:at + 512]
        values += _TERMS[:len(best), None]
        np.minimum(best, values.min(axis=1), out=best)
    return best


def _sketches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    bands = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 512):
            some, rows = batch.iloc[at:at + 512], []
            for text in some["text"]:
                shingles = shingle_set(text)
                if not len(shingles):
                    rows.append((0, None, None, None))
                    continue
                least = minima(shingles, size)
                keys = _mixed((_mixed(least.reshape(BANDS, size) + _KEYS[:, :size])).sum(axis=1, dtype=np.uint64) + bands)
                rows.append((len(shingles), hashlib.md5(shingles.tobytes()).digest(), (least & 0xFF).astype(np.uint8).tobytes(), keys.view(np.int64)))
            made = pd.DataFrame(rows, columns=["n_shingles", "digest", "minima", "bands"])
            made.insert(0, "doc_id", some["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield made


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": [shingle_set(text).tobytes() for text in batch["text"]]})


def likely_pairs(minima_of: np.ndarray, pairs: np.ndarray, percent: int = SIMILARITY_PERCENT) -> np.ndarray:
    """Which index pairs agree in enough minima."""
    agree = np.zeros(len(pairs), np.int32)
    for at in range(0, len(pairs), 4096):
        left, right = pairs[at:at + 4096].T
        agree[at:at + 4096] = (minima_of[left] == minima_of[right]).sum(axis=1)
    return agree >= agreeing(percent)


def linked_pairs(sets: list[np.ndarray], minima_of: np.ndarray, pairs: np.ndarray, percent: int = SIMILARITY_PERCENT) -> np.ndarray:
    """Which index pairs of a bucket are linked. Sizes of intersections come from a product of membership tables, some shingles at a time."""
    likely = np.flatnonzero(likely_pairs(minima_of, pairs, percent))
    out = np.zeros(len(pairs), bool)
    if not len(likely):
        return out
    left, right = pairs[likely].T
    sizes = np.array([len(s) for s in sets])
    if len(likely) <= 64:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)])
    else:
        n = len(sets)
        known, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        column = np.cumsum(often > 1) - 1  # shingles of one member meet nothing
        held = often[place] > 1
        owner, place = owner[held], column[place[held]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        product = np.zeros((n, n), np.float32)
        step = 4096
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, step):
            low, high = np.searchsorted(place, [at, at + step])
            table = np.zeros((n, step), np.float32)
            table[owner[low:high], place[low:high] - at] = 1
            product += table @ table.T
        both = product[left, right].astype(np.int64)
    out[likely] = 100 * both >= percent * (sizes[left] + sizes[right] - both)
    return out


def _spanning(ids: list, pairs: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same members, none of them twice."""
    top = list(range(len(ids)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for a, b in pairs[linked].tolist():
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((ids[a], ids[b]))
    return out


def _by_task(batches: Iterator[pd.DataFrame], answer) -> Iterator[pd.DataFrame]:
    """``answer`` of the rows of each task; the rows of one task arrive one after the other."""
    held = None
    for batch in batches:
        held = batch if held is None or not len(held) else pd.concat([held, batch])
        if len(held):
            last = held["task"].iloc[-1]
            done, held = held[held["task"] != last], held[held["task"] == last]
            yield from answer(done)
    if held is not None and len(held):
        yield from answer(held)


def _groups(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, np.ndarray, np.ndarray]]:
    """Per task its members, their minima and the pairs to compare: members of side 0 meet all, those of side 1 not each other."""
    for task, group in rows.groupby("task", sort=False):
        group = group.drop_duplicates("doc_id")
        first, second = np.triu_indices(len(group), 1)
        side = group["side"].to_numpy()
        meet = (side[first] == 0) | (side[second] == 0)
        yield task, group, np.stack([np.frombuffer(x, np.uint8) for x in group["minima"]]), np.stack([first[meet], second[meet]], axis=1)


def _likely_members(rows: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    found = []
    for _, group, minima_of, pairs in _groups(rows):
        members = np.unique(pairs[likely_pairs(minima_of, pairs, percent)])
        if len(members):
            found.append(group.iloc[members])
    if found:
        yield pd.concat(found)


def _links_of(rows: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    links = []
    for _, group, minima_of, pairs in _groups(rows):
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        links += _spanning(group["doc_id"].tolist(), pairs, linked_pairs(sets, minima_of, pairs, percent))
    if links:
        yield pd.DataFrame(links, columns=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; sets of ``percent`` similarity are linked."""
    rows = rows_for(percent)
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches, sketches_path = written(texts.mapInPandas(lambda b: _sketches(b, rows), "doc_id bigint, n_shingles bigint, digest binary, minima binary, bands array<bigint>"), "sketches")
    named = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes, classes_path = written(named.groupBy("digest").agg(F.min(F.struct("doc_id", "minima", "bands")).alias("least"))
                                    .selectExpr("digest", "least.doc_id AS text_id", "least.minima", "least.bands"), "classes")
    classes, names_path = written(_with_names(classes), "classes")
    links, scratch = _class_links(texts, classes, percent)
    # rows of one id may have several sets: their classes are linked by the id itself
    own = named.select("doc_id", "digest").join(classes.select("digest", F.col("doc_id").alias("class_id")), "digest").select("doc_id", "class_id")
    found = components(links.union(own))
    result, result_path = written(found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "components")
    discard(spark, classes_path, names_path, *scratch)
    return (sketches.select("doc_id", "n_shingles").join(result, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _with_names(classes: DataFrame) -> DataFrame:
    """``classes`` with a number of their own as ``doc_id``: the smallest id of their rows, ``text_id``, or, where several classes have that in common, a number above all ids."""
    repeated = classes.groupBy("text_id").agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1")
    if repeated.isEmpty():
        return classes.withColumn("doc_id", F.col("text_id"))
    above = classes.agg(F.max("text_id")).first()[0] + 1
    others = classes.join(repeated, "text_id").where("digest <> first").select("digest").orderBy("digest")
    numbered, _ = written(others.withColumn("number", F.monotonically_increasing_id()), "names")
    return classes.join(numbered, "digest", "left").withColumn("doc_id", F.coalesce(F.col("number") + F.lit(above), "text_id")).drop("number")


def _class_links(texts: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """Confirmed links between classes, enough of them to connect all that are connected; and tables to delete later."""
    keys = classes.select("doc_id", F.explode("bands").alias("bucket"))
    marks = [F.sum(F.xxhash64(F.lit(k), "doc_id").cast("decimal(20,0)")).alias(f"mark{k}") for k in (1, 2)]
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), *marks).where("n > 1")
    once = shared.groupBy("n", "mark1", "mark2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members, members_path = written(keys.join(once, "bucket"), "buckets")
    scratch = [members_path]
    small = members.where(F.col("n") <= BLOCK).select(F.col("bucket").cast("string").alias("task"), F.lit(0).alias("side"), "doc_id")
    links = _compared(small, texts, classes, scratch, percent)
    large = members.where(F.col("n") > BLOCK)
    if large.limit(1).count():
        links = links.union(_large_links(large, texts, classes, scratch, percent))
    return links, scratch


def _compared(tasks: DataFrame, texts: DataFrame, classes: DataFrame, scratch: list[str], percent: int) -> DataFrame:
    """``a, b``: links that connect what is linked within each of ``task, side, doc_id``."""
    rows = tasks.join(classes.select("doc_id", "minima"), "doc_id").select("task", "side", "doc_id", "minima")
    fields = "task string, side int, doc_id bigint, minima binary"
    likely, path = written(rows.repartition("task").sortWithinPartitions("task").mapInPandas(lambda b: _by_task(b, lambda r: _likely_members(r, percent)), fields), "likely")
    # a text belongs to the class whose digest its set has, since rows of one id may have several sets
    needed, needed_path = written(classes.select("doc_id", "text_id", "digest").join(likely.select("doc_id").distinct(), "doc_id", "left_semi"), "needed")
    ids = needed.select(F.col("text_id").alias("doc_id")).distinct()
    side = F.broadcast(ids) if needed.count() <= BROADCAST_IDS else ids
    made = texts.join(side, "doc_id").mapInPandas(_sets, "doc_id bigint, shingles binary").withColumn("digest", F.unhex(F.md5("shingles")))
    own = made.withColumnRenamed("doc_id", "text_id").join(needed, ["text_id", "digest"]).dropDuplicates(["doc_id"])
    sets, sets_path = written(own.select("doc_id", "shingles"), "sets")
    full = likely.join(sets, "doc_id").select("task", "side", "doc_id", "minima", "shingles")
    links, links_path = written(full.repartition("task").sortWithinPartitions("task").mapInPandas(lambda b: _by_task(b, lambda r: _links_of(r, percent)), "a bigint, b bigint"), "links")
    scratch += [path, needed_path, sets_path, links_path]
    return links


def _large_links(large: DataFrame, texts: DataFrame, classes: DataFrame, scratch: list[str], percent: int) -> DataFrame:
    """Links within buckets of more than ``BLOCK`` classes."""
    centres = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id")).alias("c")).select("bucket", F.col("c.doc_id").alias("centre"))
    pairs = large.join(centres, "bucket").where("doc_id <> centre").select("doc_id", "centre").distinct()
    # a task per member and centre is a group of two
    ends = pairs.select(F.concat_ws(":", "centre", "doc_id").alias("task"), F.explode(F.array("doc_id", "centre")).alias("doc_id")).select("task", F.lit(0).alias("side"), "doc_id")
    stars = _compared(ends, texts, classes, scratch, percent)
    found, path = written(components(stars), "places")
    scratch.append(path)
    placed = large.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    most = counts.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("top")).select("bucket", F.col("top.component").alias("largest"))
    half = BLOCK // 2
    blocks = placed.join(most, "bucket").select(
        "bucket", "doc_id", (F.col("component") != F.col("largest")).alias("outside"), F.ceil(F.col("n") / half).cast("int").alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # those outside, block by block, meet all blocks; two blocks of those outside meet only once
    outside = blocks.where("outside").select("bucket", "doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    asking = outside.select(F.concat_ws(":", "bucket", "block", "other").alias("task"), F.lit(0).alias("side"), "doc_id")
    open_blocks = blocks.where("outside").select("bucket", "block").distinct()
    answering = blocks.select("bucket", "doc_id", F.col("block").alias("other")).join(open_blocks, "bucket").select(
        F.concat_ws(":", "bucket", "block", "other").alias("task"), F.lit(1).alias("side"), "doc_id")
    both = asking.union(answering).groupBy("task", "doc_id").agg(F.min("side").alias("side")).select("task", "side", "doc_id")  # a class may be on both sides
    return stars.union(_compared(both, texts, classes, scratch, percent))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of every component one row of its smallest id, and all rows without an id.

    Of several rows of that id the one with the smallest text stays, null first, then by a hash of the other columns.
    """
    found = near_duplicates(docs, doc_id, text, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    rows, _ = written(found.select(F.col("doc_id").alias("_id"), "kept", "n"), "kept")
    listed = rows.where("kept").select("_id")
    side = F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed
    kept = docs.join(side, F.col(doc_id).cast("bigint") == F.col("_id"), "left_semi")
    repeated = rows.where("kept AND n > 1").select("_id")
    if not repeated.isEmpty():
        plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])
        key, body = (F.col(f"c{kept.columns.index(name)}") for name in (doc_id, text))
        hashed = F.xxhash64(*[F.col(f"c{i}") for i, f in enumerate(kept.schema) if not isinstance(f.dataType, MapType)])
        several = plain.join(repeated, key.cast("bigint") == F.col("_id"), "left_semi")
        one = several.groupBy(key.alias("id")).agg(F.min_by(F.struct(*plain.columns), F.struct(body, hashed)).alias("row")).select("row.*")
        kept = plain.join(repeated, key.cast("bigint") == F.col("_id"), "left_anti").union(one).toDF(*kept.columns)
    return kept.union(docs.where(F.col(doc_id).isNull()))
