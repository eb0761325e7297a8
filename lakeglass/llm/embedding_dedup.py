"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, cosine rerank.

1. Codes are learned on a bounded sample of at most ``SAMPLE`` distinct vectors (those of the least hashes): principal axes, then rotations that
   bring the coordinates close to their signs, each from its own start and with ``BITS`` bits a vector.
2. Equal vectors form a class, which has a number of its own and counts with its number of vectors.
3. The code is cut into substrings of ``SUBSTRING`` bits, one table each. Two classes meet in a table if their substrings differ in one bit at
   most, so one half of the substring is the same: every class is sent to a bucket by either half, together with its vector.
4. In a bucket the classes whose substrings are that near are compared by cosine of the original vectors in double precision. A pair counts
   only in the first table where it meets. Pairs do not leave their bucket: a class brings out the weight of its links and one edge of those
   that connect the bucket. Copies of the classes for buckets are made and dropped ``PASS_BYTES`` at a time, so disk grows with the rows.

Codes are signs of differences from the mean, where a cosine of 0.9 may be any angle. So the number of rotations is measured, not
fixed: pairs of just that cosine are made from the sample, in random directions and towards other vectors of it, and rotations are
added until the tables find ``RECALL`` of either kind. If ``MOST_ROTATIONS`` do not, as with vectors close around their
mean, all pairs are compared, block by block. A bucket of more classes than a task should hold is cut into blocks as well. Nothing else is left out: every row is indexed and searches.

Defined results: a vector that is null, empty or zero, or holds a null, NaN or infinite component links with nothing and is
its own component. Vectors of each length are a matter of their own and link with none of another length. Rows that repeat
an id count as vectors of their own and share a component. A row without an id keeps its links, has no component
and is kept. Labels and other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeglass.llm.components import components
from lakeglass.llm.shared import discard, looked_up, written
from lakeglass.runtime import shuffles_dropped

BITS = 64
ROTATIONS = 2
SUBSTRING = 16
SAMPLE = 20_000
STEPS = 50
#: Numbers that the classes of one length may have: those of 32,768 tasks. As many lengths fit into a long.
CLASSES = 1 << 48
COSINE = 0.9
#: The share of pairs just at the cosine that the tables have to find.
RECALL = 0.95
#: Rotations beyond which comparing all pairs is less work; and classes in a block of those.
MOST_ROTATIONS = 12
BLOCK = 2048
PLANTED = 2000
#: Bytes of vectors in double precision that a block of a bucket may have, and blocks that all pairs are dealt to before they grow to that.
BLOCK_BYTES, FEW_BLOCKS = 16 << 20, 8
#: Classes of a bucket up to which all its pairs are compared, and buckets are made of more keys; cosines held at a time.
SMALL, AT_ONCE = 1024, 1 << 18
#: Bytes of the classes sent to buckets by one job; at least those of one half of one table.
PASS_BYTES = 256 << 20


def learn_rotations(sample: np.ndarray, seed: int = 1, rotations: int = ROTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The centre and one projection to ``BITS`` signs per rotation, from unit vectors in rows."""
    width = sample.shape[1]
    centre = sample.mean(axis=0) if len(sample) else np.zeros(width)
    random = np.random.default_rng(seed)
    if width >= BITS and len(sample) > 1:
        _, axes = np.linalg.eigh(np.cov(sample.T))
        base = axes[:, ::-1][:, :BITS]
    else:  # fewer coordinates than bits: random directions
        base = random.normal(size=(width, BITS))
    flat = (sample - centre) @ base
    projections = []
    for _ in range(rotations):
        rotation, _ = np.linalg.qr(random.normal(size=(BITS, BITS)))
        for _ in range(STEPS if len(sample) > 1 else 0):
            left, _, right = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
            rotation = (left @ right).T
        projections.append(base @ rotation)
    return centre, np.stack(projections)


def codes(units: np.ndarray, centre: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """One 64-bit integer per vector and rotation."""
    signs = np.stack([(units - centre) @ p >= 0 for p in projections], axis=1)
    return np.packbits(signs, axis=2, bitorder="little").view("<i8")[:, :, 0]


def planted_pairs(sample: np.ndarray, cosine: float, seed: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of just that cosine: vectors of the sample, turned in random directions and towards others of the sample."""
    random = np.random.default_rng(seed)
    one, other = sample[random.integers(0, len(sample), PLANTED)], sample[random.integers(0, len(sample), PLANTED)]
    out = []
    for towards in (random.normal(size=one.shape), other):
        across = towards - np.einsum("ij,ij->i", towards, one)[:, None] * one
        length = np.linalg.norm(across, axis=1)
        some = length > 1e-9  # a vector drawn twice gives no direction
        if some.any():
            out.append((one[some], cosine * one[some] + (1 - cosine**2) ** 0.5 * across[some] / length[some, None]))
    return out


def recall_of(pairs: tuple[np.ndarray, np.ndarray], centre: np.ndarray, projections: np.ndarray) -> float:
    """The share of pairs that meet in a table, at most one bit apart."""
    near = codes(pairs[0], centre, projections) ^ codes(pairs[1], centre, projections)
    apart = np.unpackbits(near.view(np.uint8).reshape(len(near), -1), axis=1).reshape(len(near), -1, SUBSTRING).sum(axis=2)
    return float((apart <= 1).any(axis=1).mean())


def fitted_rotations(sample: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray] | None:
    """As many rotations as the tables need to find pairs of that cosine; none if these are too many."""
    if cosine >= 1 or sample.shape[1] == 1:
        return learn_rotations(sample)
    pairs, rotations = planted_pairs(sample, cosine), ROTATIONS
    while rotations <= MOST_ROTATIONS:
        centre, projections = learn_rotations(sample, rotations=rotations)
        if all(recall_of(p, centre, projections) >= RECALL for p in pairs):
            return centre, projections
        rotations += 2
    return None


def _usable() -> Column:
    """Which rows hold a vector that can be compared."""
    return F.expr("coalesce(size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0), false)")


def _units(column: pd.Series, kind: type) -> np.ndarray:
    """Vectors of length one in rows, from the bytes of vectors."""
    table = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    table /= np.abs(table).max(axis=1, keepdims=True)
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    single = vectors.select(embedding).dtypes[0][1] == "array<float>"
    named = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding"))
    can = _usable()
    with shuffles_dropped(vectors.sparkSession):
        lengths = [r["n"] for r in named.where(can).select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
        parts = [_of_one_length(named.where(can & (F.size("embedding") == n)), cosine, k, n, np.float32 if single else np.float64) for k, n in enumerate(lengths)]
        rest = named.where(~can | F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        if not parts:
            return _with_kept(rest)
        # Written tables are smaller than what a broadcast of them takes in the driver, so no join here may choose one.
        rows, classes, links = (functools.reduce(DataFrame.union, some) for some in zip(*parts))
        counts = links.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
        degree = classes.join(counts.hint("merge"), "class", "left").select("digest", "class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        placed, _ = written(rows.join(degree.hint("merge"), "digest").select("vec_id", "class", "n_links"), "degrees")
        # rows of one id may have several vectors: their classes are linked by the id itself
        several = placed.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first <> last")
        own = placed.join(several.hint("merge"), "vec_id").where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b")).distinct()
        found = components(links.select("a", "b").union(own))
        members, _ = written(classes.select("class", "least_id").join(found.withColumnRenamed("node", "class").hint("merge"), "class", "left")
                             .select("class", "least_id", F.coalesce("component", "class").alias("component")), "members")
        least = members.groupBy("component").agg(F.min("least_id").alias("least"))
        named_classes, _ = written(looked_up(members.select("class", "component"), least.hint("merge"), ["component"]).select("class", "least"), "named")
        linked = looked_up(placed, named_classes.hint("merge"), ["class"]).select("vec_id", "n_links", F.coalesce("least", "vec_id").alias("component_id"))
    return _with_kept(linked.union(rest))


def _with_kept(rows: DataFrame) -> DataFrame:
    both = rows.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.col("component_id")))
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _sample(rows: DataFrame) -> pd.Series:
    """The ``SAMPLE`` distinct vectors of the least hashes, all if there are fewer. Tasks send the driver little more than these."""
    share = 1.1 * SAMPLE / max(1, rows.count())
    while True:
        some = rows.where(F.col("place") <= int(share * 2**64) - 2**63) if share < 1 else rows
        some = some.groupBy("digest").agg(F.min("place").alias("place"), F.first("vector").alias("vector"))
        n = some.count() if share < 1 else SAMPLE
        if n >= SAMPLE:
            return some.toPandas().sort_values(["place", "digest"])["vector"].iloc[:SAMPLE]
        share *= min(16, max(2, 1.2 * SAMPLE / max(1, n)))


def _of_one_length(usable: DataFrame, cosine: float, number: int, width: int, kind: type) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``vec_id, digest``; ``digest, class, weight, least_id``; and ``a, b, n``, links of classes by bucket; of vectors of one length."""
    spark = usable.sparkSession

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(np.asarray(x, kind) + kind(0)).tobytes() for x in batch["embedding"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "place": batch["place"], "digest": [hashlib.md5(x).digest() for x in found], "vector": found})

    hashed = usable.withColumn("place", F.xxhash64(F.col("embedding").cast("array<double>")))
    whole, path = written(hashed.mapInPandas(digested, "vec_id bigint, place bigint, digest binary, vector binary"), "vectors")
    fitted = fitted_rotations(_units(_sample(whole), kind), cosine)
    rotations = len(fitted[1]) if fitted else 0
    model = spark.sparkContext.broadcast(fitted)
    names = [f"code{k}" for k in range(rotations)]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = codes(_units(batch["vector"], kind), *model.value) if rotations else None
                yield batch.assign(least_id=batch["least_id"].astype("Int64"), **{c: found[:, k] for k, c in enumerate(names)})

    # a class has a number of its own, since its rows may lack ids or share them with other classes
    classes, _ = written(whole.groupBy("digest").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector"))
                         .mapInPandas(coded, "digest binary, weight bigint, least_id bigint, vector binary" + "".join(f", {c} bigint" for c in names))
                         .withColumn("class", F.monotonically_increasing_id() + F.lit(number * CLASSES)), "classes")
    rows, _ = written(whole.select("vec_id", "digest"), "codes")
    discard(spark, path)
    links = _bucket_links(classes, cosine, names, width, kind) if rotations else _all_pairs(classes, cosine, width, kind)
    return rows, classes.select("digest", "class", "weight", "least_id"), links


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``i`` and ``j``; ``label`` has the least member of the set of each."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _compared(keys: np.ndarray, bits: list[int], itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows to compare with each other: those of one key, and those of the keys that differ from it in one of the bits."""
    order = np.argsort(keys, kind="stable")
    own, starts = np.unique(keys[order], return_index=True)
    runs = dict(zip(own.tolist(), np.split(order, starts[1:])))
    for key, run in runs.items():
        near = [run] * itself + [runs[key ^ bit] for bit in bits if key ^ bit > key and key ^ bit in runs]
        if near:
            yield run, np.concatenate(near)


def _links(cosine: float, names: list[str], kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of the rows of one block, or of two: ``a, b, n`` for every class with links: its number, that of one it is connected with, the weight of its links."""
    half = (1 << SUBSTRING // 2) - 1

    def links(group: pd.DataFrame) -> pd.DataFrame:
        n, (table, side) = len(group), divmod(int(group["copy"].iloc[0]), 2)
        two, by_key = group["low"].iloc[0] != group["high"].iloc[0], bool(names) and n > SMALL
        number, weight, block = (group[c].to_numpy() for c in ("class", "weight", "block"))
        units = _units(group["vector"], kind)
        short, slack = units.astype(np.float32), (units.shape[1] + 8) * 2.0**-23  # beyond what rounding does to the cosine in single precision
        if names:
            pieces = np.stack([group[c].to_numpy() for c in names], axis=1).astype("<i8").view("<u2")
        label, total = np.arange(n), np.zeros(n, np.int64)
        everything = [(np.arange(n), np.arange(n))]
        for ones, others in _compared(pieces[:, table].astype(np.int64), [1 << b for b in range(SUBSTRING) if (1 << b <= half) == side], side == 0) if by_key else everything:
            step, beside = max(1, AT_ONCE // len(others)), short[others].T
            for k in range(0, len(ones), step):
                near = short[ones[k:k + step]] @ beside
                i, j = np.nonzero(near >= cosine - slack)
                near, i, j = near[i, j], ones[k:k + step][i], others[j]
                meet = (i < j) | (pieces[i, table] != pieces[j, table]) if by_key else i < j
                if two:
                    meet &= block[i] != block[j]
                if names:
                    apart = pieces[i] ^ pieces[j]
                    found = np.bitwise_count(apart) <= 1
                    meet &= found[:, table] & ~found[:, :table].any(axis=1) & (((apart[:, table] & half) > 0) == side)
                for doubt in np.array_split(np.nonzero(meet & (near < cosine + slack))[0], 1 + len(i) // SMALL):
                    meet[doubt] = np.einsum("ij,ij->i", units[i[doubt]], units[j[doubt]]) >= cosine
                i, j = i[meet], j[meet]
                if len(i):
                    total += (np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)).astype(np.int64)
                    _joined(label, i, j)
        linked = np.nonzero(total)[0]
        return pd.DataFrame({"a": number[linked], "b": number[label[linked]], "n": total[linked]})

    return links


def _in_blocks(dealt: DataFrame, cosine: float, names: list[str], kind: type) -> DataFrame:
    """The links of every two of the ``blocks`` that the rows of a ``copy`` and ``bucket`` are dealt to, each from a task of its own."""
    tiles = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("copy", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "weight", "vector", *names)
    return tiles.groupBy("copy", "bucket", "low", "high").applyInPandas(_links(cosine, names, kind), "a bigint, b bigint, n bigint")


def _rows_of_block(width: int) -> int:
    return max(1, min(1 << 15, BLOCK_BYTES // (8 * width)))


def _all_pairs(classes: DataFrame, cosine: float, width: int, kind: type) -> DataFrame:
    """``a, b, n``: all links, from comparing every two blocks of classes in a task of their own."""
    n = classes.count()
    blocks = max(1, min(-(-n // BLOCK), max(FEW_BLOCKS, -(-n // _rows_of_block(width)))))
    dealt = classes.select("class", "weight", "vector", F.lit(0).alias("copy"), F.lit(0).alias("bucket"), F.lit(blocks).alias("blocks"))
    return written(_in_blocks(dealt, cosine, [], kind), "links")[0]


def _bucket_links(classes: DataFrame, cosine: float, names: list[str], width: int, kind: type) -> DataFrame:
    """``a, b, n``: the links that the tables find. Each table has two copies of the classes, one for either half of the substring."""
    n, parts, half = classes.count(), BITS // SUBSTRING, SUBSTRING // 2
    copies = 2 * parts * len(names)
    bits = min(half, max(0, (n // SMALL).bit_length()))  # few classes: buckets are of several halves

    def bucket(copy: int) -> Column:
        table, side = divmod(copy, 2)
        return F.expr(f"struct({copy} AS copy, CAST(shiftrightunsigned(code{table // parts}, {SUBSTRING * (table % parts) + half * side}) & {(1 << bits) - 1} AS INT) AS bucket)")

    def sent(some: range) -> DataFrame:
        return classes.withColumn("sent", F.explode(F.array(*map(bucket, some)))).select("*", "sent.copy", "sent.bucket")

    # buckets of more classes than a block should have; there are no more buckets than halves of substrings
    most = _rows_of_block(width)
    large = sent(range(copies)).groupBy("copy", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).collect() if n > most else []
    blocks = classes.sparkSession.createDataFrame([(r["copy"], r["bucket"], -(-r["n"] // most)) for r in large], "copy int, bucket int, blocks int")
    passes = min(copies, -(-copies * n * (width * np.dtype(kind).itemsize + 8 * len(names) + 64) // PASS_BYTES)) or 1
    found = []
    for k in range(passes):
        dealt = sent(range(k * copies // passes, (k + 1) * copies // passes))
        dealt = dealt.join(F.broadcast(blocks), ["copy", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if large else dealt.withColumn("blocks", F.lit(1))
        found.append(written(_in_blocks(dealt, cosine, names, kind), "links")[0])
    return functools.reduce(DataFrame.union, found)


#: The same by brute force in DuckDB.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node WHERE r.c < l.b),
m AS (SELECT node, min(c) AS c FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.node = e.vec_id"""
