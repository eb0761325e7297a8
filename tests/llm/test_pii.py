import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeglass.llm import pii, pii_tagger

SF = "/root/testdata/sf0.1"


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def by_brute_force(text):
    """The patterns as they are written, tried from the left."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and plain_luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def odd_texts():
    rng = random.Random(2)
    out = ["", "a@b", "a@b.c", "@b.c", "x@a.b@c.d@e.f", "a@@b.c", "é@b.c", "a.b%+-_@x-.y..z", "1.2.3.4.5.6.7.8", "0001.2.3.4", "256.1.1.1", "1.2.3.0000000255",
           "4111 1111-1111 1111", "+1 (754) 555-5215", "+1--", "++49 30 1234567.", "４１１１ 1111", "٣.1.2.3", "a@b.c,d@e.f"]
    for _ in range(4000):
        out.append("".join(rng.choice("aZ09.@+- ()%é١\n41") for _ in range(rng.randrange(30))))
    for _ in range(300):
        out.append("".join(rng.choice(["4111111111111111", "4111 1111 1111 1111", "+1 (754) 555-5215", "10.0.0.255", "a.b@c.de", " ", "-", "1", "x", "+", "@"]) for _ in range(6)))
    return out


def test_base_spans_against_the_plain_patterns():
    for text in odd_texts():
        assert pii.base_spans(text) == by_brute_force(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "a" * 150_000 + "@" + "b" * 150_000, "1 " * 150_000])
def test_base_spans_of_very_long_texts_take_linear_time(text):
    started = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - started < 20


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    tagger = pii_tagger.fresh()
    codes, tags = rng.integers(0, 130, (5, 12)).astype(np.uint8), np.zeros((5, 12), np.int64)
    tags[:, 3], tags[:, 4:7], tags[2, 8] = 1, 2, 5
    _, slopes = tagger.gradient(codes, tags)
    for weights, slope in zip(tagger.weights(), slopes):
        flat, steps = weights.reshape(-1), slope.reshape(-1)
        for at in np.argsort(-np.abs(steps))[:6]:
            held = flat[at]
            flat[at] = held + 1e-2
            above = tagger.gradient(codes, tags)[0]
            flat[at] = held - 1e-2
            below = tagger.gradient(codes, tags)[0]
            flat[at] = held
            assert (above - below) / 2e-2 == pytest.approx(steps[at], rel=2e-2, abs=1e-4)


def test_best_tags_against_all_paths():
    rng = np.random.default_rng(1)
    tagger = pii_tagger.fresh()
    tagger.follow[pii_tagger._allowed()] = rng.normal(size=int(pii_tagger._allowed().sum()))
    scores = rng.normal(size=(5, pii_tagger.TAGS, 6)).astype(np.float32) * 2
    found = tagger.tags(scores)
    paths = np.stack(np.meshgrid(*[np.arange(pii_tagger.TAGS)] * 5, indexing="ij"), -1).reshape(-1, 5)
    for w in range(6):
        value = scores[np.arange(5), paths, w].sum(axis=1) + tagger.follow[paths[:, :-1], paths[:, 1:]].sum(axis=1)
        assert (paths[value.argmax()] == found[w]).all()


def test_windows_are_reconciled():
    one = ("card", 150, 165, 4.0, False)
    assert pii.reconciled([one, one]) == [("card", 150, 165, 4.0)]
    cut = [("card", 150, 160, 3.0, True), ("card", 150, 171, 9.0, False), ("email", 155, 171, 5.0, False), ("phone", 171, 180, 1.0, False)]
    assert pii.reconciled(cut) == [("card", 150, 171, 9.0), ("phone", 171, 180, 1.0)]
    long = [("email", 100, 160, 5.0, True), ("email", 120, 280, 6.0, True), ("email", 240, 300, 2.0, True)]  # longer than any window
    assert pii.reconciled(long) == [("email", 100, 300, 6.0)]
    assert pii.reconciled([("ip", 0, 9, 2.0, False), ("card", 8, 20, 3.0, False), ("ip", 19, 30, 2.0, False)]) == [("ip", 0, 9, 2.0), ("ip", 19, 30, 2.0)]
    assert pii.reconciled([("ip", 0, 9, -2.0, False)]) == []


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return pii.fit(docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0"))


@pytest.fixture(scope="module")
def held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0")
    return [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").collect()]


def test_other_spellings_are_added_in_held_out_texts(tagger, held_out):
    """Spans that no pattern knows are found, and clean texts stay clean."""
    rng, texts, want = np.random.default_rng(99), [], []
    for text in held_out:
        for kind, s, e in pii.base_spans(text)[:1]:
            spelled = pii.respelled(kind, text[s:e], rng)
            texts.append(text[:s] + spelled + text[e:])
            want.append((kind, s, s + len(spelled)))
    found = [span in base + added for span, (base, added) in zip(want, pii.spans_of(texts, tagger))]
    assert len(found) >= 60 and np.mean(found) >= 0.85, (np.mean(found), len(found))
    clean = [t for t in held_out if not pii.base_spans(t)]
    assert sum(bool(added) for _, added in pii.spans_of(clean, tagger)) <= 0.002 * len(clean)


def test_windows_do_not_matter_where_a_span_stands(tagger, held_out):
    """A span is found wherever the edges of the windows fall."""
    text = next(t for t in held_out if len(t) > 900 and not pii.base_spans(t))
    found = 0
    for shift in range(0, 240, 7):
        whole = f"{text[:300 + shift]} gckna.63 [at] mail5 [dot] example [dot] com {text[300 + shift:]}"
        _, added = next(pii.spans_of([whole], tagger))
        found += any(k == "email" and whole[s:e] == "gckna.63 [at] mail5 [dot] example [dot] com" for k, s, e in added)
    assert found >= 30


def test_query_shape_and_odd_rows(spark, tagger):
    rows = [(1, "Write to a.b@c.de or +1 (754) 555-5215.", "x"), (1, None, "y"), (None, "", "z"), (2, "10.0.0.1 " * 3, None), (3, "é" * 50 + " 4111 1111 1111 1111", "w")]
    rows += [(4, "no data here " * 20_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n ip`", F.lit(1))
    got = pii.with_spans(docs, tagger)
    assert got.columns == ["doc_id", "text", "n ip`", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
    found = {r.text: r for r in got.collect()}
    assert len(found) == len(rows)
    for _, text, _ in rows:
        base = pii.listed(by_brute_force(text or ""))
        r = found[text]
        assert r.base_spans == base and set(base.split(",")) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in by_brute_force(text or "")) for kind in pii.KINDS)
    assert found["10.0.0.1 " * 3].base_spans == "ip:0:8,ip:9:17,ip:18:26"
    none = docs.limit(0)
    assert pii.fit(none) is None and pii.with_spans(none, None).count() == 0
    nothing = docs.where("doc_id = 4")
    assert pii.fit(nothing) is None and pii.with_spans(nothing, None).first().spans == ""


def test_learning_is_repeatable(spark, tagger):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    again = pii.fit(docs.repartition(7))
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(tagger.weights(), again.weights()))
