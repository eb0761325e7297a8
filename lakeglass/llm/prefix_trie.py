"""A trie of conversations by their turns, built as a z-fast trie: compacted nodes, hashed at two-fattest depths.

A conversation is a sequence of turns (role, text). Every distinct beginning is a node; chains of nodes with one child and
without an end are one edge of the compacted trie, from ``lo`` (the depth of the node above) to ``hi``.

1. Every beginning of every conversation gets a key of 128 bits: the XOR of one hash per turn and depth. Keys of all
   depths are running aggregates, carried over slices of the sorted table, so a very long conversation spreads over tasks.
2. Equal conversations are one class from here on. Classes enter the trie in batches, each several times as large as
   those before it.
3. An edge is hashed at its handle: the key at the two-fattest depth of ``(lo, hi]``, the one with the most trailing zero bits.
   A class finds the edge where it leaves the trie by fat binary search: it asks for the handle at the two-fattest depth
   of its interval; if there is one, the interval begins at the end of that edge, else it ends before that depth. Depths are
   asked for from many trailing zeros to few, so each level reads its own keys only, and the keys are read once in all.
4. A batch is inserted by the edges it leaves: those edges and the turns behind them are counted by key. A chain of
   one edge is what the same members pass, that is the same smallest member and the same number of them. Turns that the trie
   already has are not touched.
5. Sums over subtrees are made by doubling: in each round every node adds what its descendants at distance ``2**i`` have collected, and then
   knows its ancestor at twice the distance. At last edges are expanded to one row per node.

Keys shared by many rows (a first turn that a third of all conversations have) are joined by ``looked_up``, which broadcasts the few hot ones.
The digest of the members that end at a node is SHA-256 over their ids in order, which cannot be split: ids of one class
stream through one task, which holds one batch of them.

Defined results: turns are in order of ``turn``, null first; equal turns in the order of their digests. A null role or text
is empty. Rows without ``conv_id`` belong to no conversation. Repeated rows are turns of their own. A conversation without turns
is a member of the root alone. Without conversations there are no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.shared import discard, looked_up, written
from lakeglass.operators.table import sorted_slices
from lakeglass.runtime import query

#: Batches in which classes are inserted, and how many times as large each is as those before it.
BATCHES = 2
GROWTH = 8
KEY = ["k1", "k2"]


def _carried(placed: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running aggregates within each conversation of a table sorted into slices; ``sums`` maps names to ``aggregate(column)``.

    A conversation goes on from one slice to the next only if it is the first of that slice, so one row per slice is carried.
    """
    joined = {"sum": "coalesce({0}, 0L) + {1}", "bit_xor": "coalesce({0}, 0L) ^ {1}"}
    inside = ", ".join(f"{a} OVER (PARTITION BY slice, conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS {n}" for n, a in sums.items())
    totals = ", ".join(f"{a} AS {n}" for n, a in sums.items())
    before = ", ".join(f"{a[:a.index('(')]}({n}) OVER (PARTITION BY conv_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_{n}" for n, a in sums.items())
    both = ", ".join(f"{joined[a[:a.index('(')]].format(f'before_{n}', f'i.{n}')} AS {n}" for n, a in sums.items())
    carry = query(
        f"""
        WITH heads AS (SELECT DISTINCT conv_id FROM (SELECT min_by(conv_id, position) AS conv_id FROM {{p}} GROUP BY slice)),
        parts AS (SELECT /*+ BROADCAST(h) */ p.slice, p.conv_id, {totals} FROM {{p}} AS p JOIN heads AS h ON p.conv_id = h.conv_id GROUP BY p.slice, p.conv_id)
        SELECT slice, conv_id, {before} FROM parts""", p=placed)
    columns = ", ".join(f"i.{c}" for c in placed.columns if c not in ("slice", "position"))
    return query(f"SELECT /*+ BROADCAST(c) */ {columns}, {both} FROM (SELECT *, {inside} FROM {{p}}) AS i LEFT JOIN {{c}} AS c ON i.slice = c.slice AND i.conv_id = c.conv_id",
                 p=placed, c=carry)


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, d1, d2, bytes`` for ``conv_id, turn, role, text``: turns counted from 1, with digests and the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digested = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(text, role, F.length(role)).alias("d1"),
        F.xxhash64(F.lit(7), role, text, F.length(text)).alias("d2"), F.octet_length(text).cast("bigint").alias("bytes"))
    placed = sorted_slices(digested, ["conv_id", F.col("turn").asc_nulls_first(), "d1", "d2"])
    steps = _carried(placed.select("slice", "position", "conv_id", "d1", "d2", "bytes", F.lit(1).cast("bigint").alias("one")), {"depth": "sum(one)"})
    return written(steps.select("conv_id", "depth", "d1", "d2", "bytes"), "steps")[0]


def _spelled(steps: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, bytes, size, level``: the key of every beginning, the bytes of all its texts, the power of two in its depth."""
    hashed = steps.selectExpr("conv_id", "depth", "bytes", "xxhash64(d1, depth, d2) AS t1", "xxhash64(9, depth, d2, d1) AS t2")
    keys = _carried(sorted_slices(hashed, ["conv_id", "depth"]), {"k1": "bit_xor(t1)", "k2": "bit_xor(t2)", "size": "sum(bytes)"})
    return written(keys.selectExpr("conv_id", "depth", *KEY, "bytes", "size", "depth & -depth AS level"), "beginnings")[0]


def _edges(rows: DataFrame) -> DataFrame:
    """The edges that rows ``conv_id, depth, k1, k2, bytes, size, above`` make: turns of members behind depth ``above``."""
    nodes = rows.groupBy("depth", *KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min("above").alias("above"),
                                            F.min("bytes").alias("bytes"), F.min("size").alias("size"))
    return nodes.groupBy("rep", "n", "above").agg(
        (F.min("depth") - 1).alias("lo"), F.max("depth").alias("hi"), F.expr("max_by(struct(depth, k1, k2), depth & -depth) AS handle"),
        F.expr("max_by(struct(k1, k2), depth) AS extent"), F.expr("min_by(struct(k1, k2), depth) AS opening"),
        F.min(F.col("size") - F.col("bytes")).alias("size_lo"), F.max("size").alias("size_hi")).selectExpr(
        "rep", "lo", "hi", "size_lo", "size_hi", "handle.depth AS fattest", "handle.k1 AS f1", "handle.k2 AS f2", "extent.k1 AS e1", "extent.k2 AS e2",
        "opening.k1 AS o1", "opening.k2 AS o2")


def _exits(batch: DataFrame, spelled: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """``conv_id, above, e1, e2``: the depth behind which each class is new to its edge, and that edge, if there is one.

    ``edges`` is asked by fat binary search. Classes that end at a node of the trie come with null for ``above``.
    """
    spark = batch.sparkSession
    state, path = written(batch.selectExpr("conv_id", "len", "0L AS a", "len AS b", "0L AS lo", "0L AS hi", "CAST(NULL AS BIGINT) AS e1", "CAST(NULL AS BIGINT) AS e2"), "search")
    for m in range(longest.bit_length() - 1, -1, -1):
        asked = state.selectExpr("*", f"IF((b >> {m}) << {m} > a, (b >> {m}) << {m}, NULL) AS depth")
        keys = spelled.where(f"level = {1 << m}L").select("conv_id", "depth", *KEY)
        probes, probe_path = written(asked.join(keys, ["conv_id", "depth"], "left"), "probes")
        handles = edges.where(f"fattest & -fattest = {1 << m}L").selectExpr("f1 AS k1", "f2 AS k2", "fattest", "lo AS lo_", "hi AS hi_", "e1 AS e1_", "e2 AS e2_")
        found = looked_up(probes, handles, KEY)
        hit = "(depth IS NOT NULL AND fattest = depth)"
        after, new_path = written(found.selectExpr(
            "conv_id", "len", f"IF({hit}, hi_, a) AS a", f"IF(depth IS NULL OR {hit}, b, depth - 1) AS b",
            *[f"IF({hit}, {c}_, {c}) AS {c}" for c in ("lo", "hi", "e1", "e2")]), "search")
        discard(spark, path, probe_path)
        state, path = after, new_path
    # does the class pass the end of the last edge found, and if so, is there an edge below it?
    at_end = spelled.selectExpr("conv_id", "depth AS hi", "k1 AS x1", "k2 AS x2")
    behind = spelled.selectExpr("conv_id", "depth - 1 AS hi", "k1 AS o1", "k2 AS o2")
    compared, compared_path = written(
        state.join(at_end, ["conv_id", "hi"], "left").join(behind, ["conv_id", "hi"], "left").selectExpr(
            "conv_id", "len", "lo", "hi", "e1", "e2", "hi = 0 OR (coalesce(x1 = e1, false) AND x2 = e2) AS passes", "o1", "o2").selectExpr(
            "conv_id", "len", "lo", "hi", "e1", "e2", "passes", "IF(passes, o1, NULL) AS o1", "IF(passes, o2, NULL) AS o2"), "ends")
    below = looked_up(compared, edges.selectExpr("o1", "o2", "e1 AS n1", "e2 AS n2"), ["o1", "o2"])
    out, _ = written(below.selectExpr("conv_id", "CASE WHEN NOT passes THEN lo WHEN hi < len THEN hi END AS above",
                                      "IF(passes, n1, e1) AS e1", "IF(passes, n2, e2) AS e2"), "exits")
    discard(spark, path, compared_path)
    return out


def compacted(classes: DataFrame, spelled: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The edges of the compacted trie of ``conv_id, len`` by their keys of all depths."""
    longest = classes.agg(F.max("len")).first()[0] or 0
    edges = None
    for number in range(batches):
        choice = [f"pmod(xxhash64(conv_id), {GROWTH ** (batches - 1 - i)}) = 0" for i in range(number + 1)]
        batch = classes.where(" AND ".join(["len > 0", choice[-1], *[f"NOT ({c})" for c in choice[:-1]]])).select("conv_id", "len")
        if edges is None:
            edges, _ = written(_edges(spelled.join(batch, "conv_id", "left_semi").withColumn("above", F.lit(0).cast("bigint"))), "trie")
            continue
        exits = _exits(batch, spelled, edges, longest)
        new = spelled.join(exits.where("above IS NOT NULL").select("conv_id", "above"), "conv_id").where("depth > above")
        left, _ = written(exits.where("above IS NOT NULL AND e1 IS NOT NULL").select("e1", "e2").distinct(), "left")
        cut = edges.join(left, ["e1", "e2"], "left_semi").selectExpr("rep AS conv_id", "explode(sequence(lo + 1, hi)) AS depth", "lo AS above")
        rows = new.select("conv_id", "depth", *KEY, "bytes", "size", "above").union(
            spelled.join(cut, ["conv_id", "depth"]).select("conv_id", "depth", *KEY, "bytes", "size", "above"))
        edges, _ = written(edges.join(left, ["e1", "e2"], "left_anti").unionByName(_edges(rows)), "trie")
    return edges


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``e1, e2, a1, a2`` and what is summed up), every sum and the least member over the whole subtree, by doubling."""
    spark, sums = nodes.sparkSession, ["copies", "spoken", "own_bytes", "leaves"]
    now, path = written(nodes, "sums")
    while not now.where("a1 IS NOT NULL").isEmpty():
        below = now.where("a1 IS NOT NULL").groupBy(F.col("a1").alias("e1"), F.col("a2").alias("e2")).agg(
            *[F.sum(c).alias(f"b_{c}") for c in sums], F.min("least").alias("b_least"))
        farther = now.selectExpr("e1 AS a1", "e2 AS a2", "a1 AS g1", "a2 AS g2")
        ahead, ahead_path = written(looked_up(now, farther, ["a1", "a2"]).selectExpr("e1", "e2", "g1 AS a1", "g2 AS a2", *sums, "least"), "sums")
        after, new_path = written(ahead.join(below, ["e1", "e2"], "left").selectExpr(
            "e1", "e2", "a1", "a2", *[f"{c} + coalesce(b_{c}, 0L) AS {c}" for c in sums], "least(least, b_least) AS least"), "sums")
        discard(spark, path, ahead_path)
        now, path = after, new_path
    return now


def _end_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, digest``: SHA-256 of the ids of each class in order, joined by commas. Ids of a class pass one task as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, conv in zip(*(column.to_pylist() for column in batch.columns)):
                if (k1, k2) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["k1", "k2", "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["k1", "k2", "digest"])

    return ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(digest, "k1 bigint, k2 bigint, digest string")


def trie(steps: DataFrame, conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per node of the trie of ``steps`` (as ``numbered`` returns them; depths count from 1 without gaps) and of all ``conv_id`` of ``conversations``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves``, ``saved_tokens``
    (bytes of texts that need not be kept twice, in the subtree) and ``ends_sha256``.
    """
    spelled = _spelled(steps)
    lengths = conversations.select("conv_id").distinct().join(steps.groupBy("conv_id").agg(F.max("depth").alias("len")), "conv_id", "left").selectExpr("conv_id", "coalesce(len, 0L) AS len")
    last = lengths.join(spelled.selectExpr("conv_id", "depth AS len", "k1", "k2"), ["conv_id", "len"], "left")
    ends, _ = written(last.selectExpr("conv_id", "len", "coalesce(k1, 0L) AS k1", "coalesce(k2, 0L) AS k2"), "ends")
    classes, _ = written(ends.groupBy("len", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")), "classes")
    spelled, _ = written(spelled.join(classes.select("conv_id"), "conv_id", "left_semi"), "beginnings")
    edges = compacted(classes, spelled, batches)
    above = spelled.selectExpr("conv_id AS rep", "depth AS lo", "k1 AS a1", "k2 AS a2")
    hung, _ = written(edges.join(above, ["rep", "lo"], "left"), "hung")
    children = hung.where("a1 IS NOT NULL").groupBy(F.col("a1").alias("e1"), F.col("a2").alias("e2")).agg(F.count("*").alias("children"))
    ended = classes.where("len > 0").selectExpr("k1 AS e1", "k2 AS e2", "copies", "conv_id AS least").join(
        _end_digests(ends.where("len > 0")).withColumnsRenamed({"k1": "e1", "k2": "e2"}), ["e1", "e2"])
    placed, _ = written(hung.join(children, ["e1", "e2"], "left").join(ended, ["e1", "e2"], "left").selectExpr(
        "rep", "lo", "hi", "size_lo", "size_hi", "e1", "e2", "a1", "a2", "coalesce(children, 0L) AS children", "coalesce(copies, 0L) AS copies", "least", "digest"), "placed")
    sums = _subtree_sums(placed.selectExpr("e1", "e2", "a1", "a2", "copies", "copies * size_hi AS spoken", "size_hi - size_lo AS own_bytes",
                                           "IF(children = 0, 1L, 0L) AS leaves", "least"))
    totals = sums.selectExpr("e1", "e2", "copies AS n_convs", "spoken", "own_bytes", "leaves AS n_leaves", "least AS conv_id")
    known, _ = written(placed.drop("copies", "least").join(totals, ["e1", "e2"]), "known")
    parents = known.selectExpr("e1 AS a1", "e2 AS a2", "conv_id AS parent_conv_id")
    edges_known, _ = written(looked_up(known, parents, ["a1", "a2"]), "edges")
    no_end = hashlib.sha256(b"").hexdigest()
    expanded = edges_known.withColumn("depth", F.explode(F.sequence(F.col("lo") + 1, "hi"))).join(
        spelled.selectExpr("conv_id AS rep", "depth", "bytes", "size"), ["rep", "depth"])
    root, members = ends.agg(F.min("conv_id"), F.count("*")).first()
    if not members:
        return _nodes(expanded, 0, no_end)
    top = known.where("lo = 0").agg(F.count("*"), F.coalesce(F.sum("n_leaves"), F.lit(0)), F.coalesce(F.sum(F.col("spoken") - F.col("own_bytes")), F.lit(0))).first()
    turnless = _end_digests(ends.where("len = 0")).first()
    row = (root, 0, None, members, top[0], top[1] or 1, top[2], turnless.digest if turnless else no_end)
    nodes = _nodes(expanded, root, no_end)
    return nodes.union(spelled.sparkSession.createDataFrame([row], nodes.schema))


def _nodes(expanded: DataFrame, root: int, no_end: str) -> DataFrame:
    return expanded.selectExpr(
        "conv_id", "depth", f"CASE WHEN depth > lo + 1 THEN conv_id WHEN lo = 0 THEN {root}L ELSE parent_conv_id END AS parent_conv_id", "n_convs",
        "IF(depth < hi, 1L, children) AS n_children", "n_leaves", "spoken - (n_convs - 1) * (size - bytes) - own_bytes - size_lo AS saved_tokens",
        f"IF(depth = hi, coalesce(digest, '{no_end}'), '{no_end}') AS ends_sha256")


def conversation_trie(turns: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The trie of all conversations of ``conv_id, turn, role, text``."""
    return trie(numbered(turns), turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id")), batches)


ORACLE = r"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS depth, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
plan AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
               lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384::BIGINT * (s & 1)) END), 4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
steps AS (
    SELECT p.conv_id, o.depth, role, text FROM plan AS p JOIN own AS o ON o.conv_id = p.base AND o.depth <= h
    UNION ALL
    SELECT conv_id, depth - h + least(h, (SELECT count(*) FROM own AS b WHERE b.conv_id = base)), role, text FROM own JOIN plan USING (conv_id) WHERE depth > h),
paths AS (
    SELECT conv_id, depth, strlen(text) AS bytes, string_agg(md5(strlen(role)::VARCHAR || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS key
    FROM steps),
hung AS (
    SELECT *, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths
    UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM steps) FROM plan),
nodes AS (
    SELECT key, depth, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS last_members
    FROM hung GROUP BY key, depth),
children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
subtrees AS (
    SELECT h.key, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (WHERE n.key NOT IN (SELECT key FROM children)) AS n_leaves
    FROM nodes AS n JOIN hung AS h ON h.conv_id = n.conv_id AND h.depth <= n.depth GROUP BY h.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(n.last_members) AS ends_sha256
FROM nodes AS n JOIN subtrees AS s USING (key) LEFT JOIN children AS c USING (key) LEFT JOIN nodes AS p ON p.key = n.above
"""
