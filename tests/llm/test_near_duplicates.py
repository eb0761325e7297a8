import random

import numpy as np
import pandas as pd
import pytest

from lakeglass.llm import components as components_module, embedding_dedup, minhash_dedup
from lakeglass.llm.components import components


def groups(nodes, edges):
    least = {n: n for n in nodes}

    def top(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        least[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, None)]
    whole = [e for e in edges if None not in e and e[0] != e[1]]
    want = groups({n for e in whole for n in e}, whole)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    # a chain whose ends are far apart
    chain = [f"c{i}" for i in range(120)]
    for k in range(12):
        rows.append((n, " ".join(chain[k * 3:k * 3 + 84])))
        n += 1
    return rows


def test_minhash_against_all_pairs(spark):
    rows = near_texts() + [(900, None), (901, ""), (902, " \t "), (903, "One Two"), (904, "one two"), (905, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, component_id int")
    sets = {i: plain_sets(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    stay = minhash_dedup.dedup(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(i for i in sets if want[i] == i)


def test_minhash_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    test_minhash_against_all_pairs(spark)


def test_linked_pairs_by_product():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.06], rng.integers(0, 2**60, rng.integers(0, 20), dtype=np.uint64)])) for _ in range(40)]
    pairs = np.array([(a, b) for a in range(40) for b in range(a)])
    both = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    want = [100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k) for k, (a, b) in zip(both, pairs)]
    got = minhash_dedup.linked_pairs(sets, np.stack([minhash_dedup.minima(s) & 0xFF for s in sets]).astype(np.uint8), pairs)
    assert 0 < sum(want) < len(want) and got.tolist() == want


def test_minhash_of_odd_rows(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (7, "other words than those before it"), (3, text), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, None, True)] * 2 + [(7, 3, False)] * 3 + [(3, 3, True)], key=repr)
    assert sorted((r.doc_id for r in minhash_dedup.dedup(docs).collect()), key=repr) == [3, None, None]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0 and minhash_dedup.dedup(docs.limit(0)).count() == 0
    assert minhash_dedup.dedup(docs.where("doc_id = 7")).count() == 1


def test_minhash_of_ids_with_several_texts(spark):
    """Every text of an id keeps its links: copies of its second text are found too, in buckets of their own."""
    rng, rows = random.Random(21), []
    for k in range(40):
        for own, near in ((0, 1000 + 2 * k), (1, 1001 + 2 * k)):
            words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
            rows += [(k, " ".join(words)), (near, " ".join(words[:-1] + ["other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {k: k for k in range(40)} | {1000 + i: i // 2 for i in range(80)}
    stay = sorted(tuple(r) for r in minhash_dedup.dedup(docs).collect())
    assert stay == sorted((k, min(t for i, t in rows if i == k)) for k in range(40))
    assert stay == sorted(tuple(r) for r in minhash_dedup.dedup(docs.repartition(5)).collect())


def test_vectors_of_negative_and_repeated_ids(spark):
    """Components are named by the smallest id, whatever its sign; an id with two vectors links what is near either."""
    v, w, x = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5], [0.0, -5.0, 1.0]
    frame = spark.createDataFrame([(-5, v), (3, [1.0, 2.0, 3.001]), (-7, w), (-8, w), (None, [3.0, -1.0, 0.501]), (20, v), (20, x), (21, [0.0, -5.0, 1.001]), (9, [1.0] * 4), (-9, [1.0, 1.0, 1.0, 1.001])],
                                  "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(frame).collect()), key=repr)
    assert got == sorted([(-5, 2, -5, True), (3, 2, -5, False), (20, 2, -5, False), (20, 1, -5, False), (21, 1, -5, False), (-7, 2, -8, False), (-8, 2, -8, True), (None, 2, None, True),
                          (9, 1, -9, False), (-9, 1, -9, True)], key=repr)


def vectors():
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(60):
        base = rng.normal(size=48)
        for k in range(rng.integers(1, 5)):
            rows.append((n, (base + rng.normal(size=48) * rng.choice([0, 0.05, 0.2, 0.6])).tolist()))
            n += 1
    return rows


def test_vectors_against_all_pairs(spark):
    rows = vectors()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    sure = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    odd = [(900, None), (901, []), (902, [0.0] * 48), (903, [float("nan")] + [1.0] * 47), (904, [None] + [1.0] * 47), (905, [float("inf")] + [1.0] * 47), (906, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "k") for i, v in rows + odd], "vec_id long, embedding array<double>, kept string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    assert len(got) == len(rows) + len(odd)
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.9 * len(sure) <= found <= len(sure)
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    want = groups(unit, sure)
    assert np.mean([got[i].component_id == want[i] for i in unit]) > 0.95


def test_vectors_of_equal_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    frame = spark.createDataFrame([(5, v), (4, v), (4, v), (None, v), (9, w), (8, [-0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(frame).collect()), key=repr)
    assert got == sorted([(5, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (None, 3, None, True), (9, 0, 9, True), (8, 0, 8, True)], key=repr)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0
    only_bad = frame.where("vec_id = 8")
    assert [tuple(r) for r in embedding_dedup.near_vectors(only_bad).collect()] == [(8, 0, 8, True)]


@pytest.mark.parametrize("width", [3, 64, 100])
def test_codes(width):
    rng = np.random.default_rng(2)
    units = rng.normal(size=(500, width))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centre, projections = embedding_dedup.learn_rotations(units)
    found = embedding_dedup.codes(units, centre, projections)
    assert found.shape == (500, 2)
    bits = np.unpackbits(found.view(np.uint8).reshape(500, -1), axis=1).mean(axis=0)
    assert abs(bits.mean() - 0.5) < 0.05


@pytest.mark.parametrize("common", [0.0, 0.85, 0.9])
def test_vectors_around_a_common_mean(spark, common):
    """Links are found whatever the length of the mean is, in each length of vectors by itself."""
    rng, rows = np.random.default_rng(11), []
    for width in (64, 96):
        mean = np.eye(width)[0] * common
        for _ in range(250):
            base = rng.normal(size=width) * ((1 - common**2) / width) ** 0.5 + mean
            base /= np.linalg.norm(base)
            for cosine in (1.0, rng.uniform(0.9, 0.93)):
                across = rng.normal(size=width)
                across -= (across @ base) * base
                rows.append((len(rows), cosine * base + (1 - cosine**2) ** 0.5 * across / np.linalg.norm(across)))
    want = 0
    for width in (64, 96):
        table = np.stack([v for _, v in rows if len(v) == width])
        near = table @ table.T >= 0.9
        want += near.sum() - len(table)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embedding_dedup.near_vectors(frame).collect())
    assert 0.94 * want <= got <= want + 2


def test_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST_ROTATIONS", 0)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rows = vectors()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(frame).collect()}
    assert got == {a: sum(a != b and unit[a] @ unit[b] >= 0.9 for b in unit) for a in unit}


@pytest.mark.parametrize("blocks", [1, 3])
def test_links_of_buckets(monkeypatch, blocks):
    """Buckets bring out what all pairs that meet in a table give, each pair once, however a bucket is cut or looked through; a class has one row a bucket."""
    rng = np.random.default_rng(6)
    units = np.concatenate([base + rng.normal(size=(n, 64)) * 0.04 for base, n in zip(rng.normal(size=(40, 64)), [1, 2, 3, 30] * 10)])
    units = np.concatenate([units, rng.normal(size=(60, 64))]).astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    n, weight = len(units), rng.integers(1, 4, len(units))
    found = embedding_dedup.codes(units, *embedding_dedup.learn_rotations(units))
    pieces = found.view("<u2")
    meets = (np.bitwise_count(pieces[:, None] ^ pieces[None]) <= 1).any(axis=2) & (units @ units.T >= 0.9) & ~np.eye(n, dtype=bool)
    rows = pd.DataFrame({"class": np.arange(n) * 7, "weight": weight, "vector": [u.tobytes() for u in units], "block": np.arange(n) % blocks, "code0": found[:, 0], "code1": found[:, 1]})
    for small, at_once in ((10**6, 10**6), (5, 40)):
        monkeypatch.setattr(embedding_dedup, "SMALL", small)
        monkeypatch.setattr(embedding_dedup, "AT_ONCE", at_once)
        links = embedding_dedup._links(0.9, ["code0", "code1"], np.float64)
        total, edges = np.zeros(n, int), []
        for copy in range(16):
            for low in range(blocks):
                for high in range(low, blocks):
                    halves = (pieces[:, copy // 2] >> 8 * (copy % 2)) & 7  # buckets of several halves
                    for half in np.unique(halves):
                        group = rows[(halves == half) & rows["block"].isin([low, high])].assign(copy=copy, low=low, high=high)
                        if len(group):
                            got = links(group.reset_index(drop=True))
                            assert got["a"].is_unique
                            total[got["a"] // 7] += got["n"]
                            edges += zip(got["a"] // 7, got["b"] // 7)
        assert total.tolist() == (meets @ weight).tolist()
        assert groups(range(n), edges) == groups(range(n), list(zip(*np.nonzero(meets))))


def test_near_vectors_write_rows_not_pairs(spark, monkeypatch):
    """300 near vectors have 44,850 links, but no table of them is written."""
    rng, written, sizes = np.random.default_rng(8), embedding_dedup.written, []

    def seen(df, label):
        table, path = written(df, label)
        sizes.append((label, table.count()))
        return table, path

    monkeypatch.setattr(embedding_dedup, "written", seen)
    base = rng.normal(size=64)
    frame = spark.createDataFrame([(i, (base + rng.normal(size=64) * 0.01).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(frame).selectExpr("sum(n_links)", "max(component_id)").first()[:] == (300 * 299, 0)
    assert max(n for _, n in sizes) <= 16 * 300


def test_near_vectors_broadcast_no_table(spark, monkeypatch):
    """A table of few bytes may be many rows, so no join of tables that grow is left to the estimate of their size."""
    plans = []
    for module in (embedding_dedup, components_module):
        def seen(df, label, written=module.written):
            if label != "named":  # there the few keys of many rows are broadcast
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            return written(df, label)

        monkeypatch.setattr(module, "written", seen)
    assert embedding_dedup.near_vectors(spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")).count() == len(vectors())
    assert len(plans) > 6 and not [p for p in plans if "BroadcastHashJoin" in p]
