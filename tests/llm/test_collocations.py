import random
import re
from collections import Counter

import pytest

from lakeglass.llm import collocations


def by_brute_force(rows, least, longest, per_group):
    """Every place of every phrase is counted with plain loops."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        key = (lang, tuple(words[i:i + k]))
                        f[key] = f.get(key, 0) + 1
    out = []
    for lang in total:
        found = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, cut = min((2000000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:per_group], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows_like_speech():
    rng, rows = random.Random(5), []
    words = ["the", "The", "of", "cat", "Éa", "éa", "ÉA", "x\x1fy", "n b", "日本", "a-b", "0"]
    for n in range(160):
        lang = rng.choice(["en", "en", "fr", None, ""])
        parts = [rng.choice(words) if rng.random() < 0.6 else "new York times square" for _ in range(rng.randrange(0, 30))]
        rows.append((lang, "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "; ", "\r\n", "\x0b"]) for p in parts)))
    rows += [("en", "a a a a a a a a"), (None, "zz zz " * 3000), ("fr", None), (None, ""), ("de", " .,;"), ("en", "over and over " * 40)]
    return rows


def mined(frame, **options):
    got = collocations.collocations(frame, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(lang, text, "k", 1) for lang, text in rows_like_speech()], "lang string, text string, phrase string, f int").repartition(5)


@pytest.mark.parametrize(("least", "longest", "per_group"), [(30, 4, 2000), (3, 4, 12), (2, 3, 2000), (8, 2, 3)])
def test_against_brute_force(frame, least, longest, per_group):
    want = by_brute_force(rows_like_speech(), least, longest, per_group)
    assert want and mined(frame, least=least, longest=longest, per_group=per_group) == want


def test_small_chunks_and_a_full_bitmap(frame, monkeypatch):
    """A bitmap of few bits keeps runs that are not frequent; the counts stay exact."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 200)
    monkeypatch.setattr(collocations, "BITS", 4)
    assert mined(frame, least=3) == by_brute_force(rows_like_speech(), 3, 4, 2000)


def test_words_that_share_a_hash(frame, monkeypatch):
    """Frequent words that share their hash with another word, or with none, are told apart by the next seed."""
    real = collocations._hash

    def narrow(lang, word, seed):
        return real(lang, word, seed) % 7 if seed == 0 else 0 if seed == 1 and word == b"the" else real(lang, word, seed)

    monkeypatch.setattr(collocations, "_hash", narrow)
    assert mined(frame, least=3) == by_brute_force(rows_like_speech(), 3, 4, 2000)


def test_of_odd_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert mined(none) == [] and mined(spark.createDataFrame([("en", None), (None, ""), ("en", "one two")], none.schema)) == []
    numbers = spark.createDataFrame([(7, 12), (7, 12)], "lang int, text int")  # columns of other types are read as text
    assert mined(numbers, least=1) == []
    long = spark.createDataFrame([("en", "ab cd " * 400_000)], none.schema)
    assert mined(long) == by_brute_force([("en", "ab cd " * 400_000)], 30, 4, 2000)


def test_exact_beyond_64_bits(spark):
    """The share is made in DECIMAL: two million times the frequency may pass 64 bits."""
    a, part = 2**62 - 1, 2**62
    made = spark.sql(f"SELECT CAST({a}L AS DECIMAL(20, 0)) * 2000000 DIV (CAST({part}L AS DECIMAL(20, 0)) + {part}L) AS s").first().s
    assert made == 2000000 * a // (2 * part)


def test_tasks_hold_few_texts_and_chunks(spark, monkeypatch):
    """Python gets texts and chunks in batches of bounded size, whatever a partition has; the session is left as it was."""
    texts = [("en", " ".join(f"w{(i * j) % 997}" for j in range(2000)) + ".") for i in range(600)]
    frame = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(collocations, "BATCH_BYTES", 200_000, raising=False)
    plain = type(frame).mapInArrow

    def watched(self, func, *schema):
        def bounded(batches):
            for batch in batches:
                assert batch.nbytes < 600_000, f"a batch of {batch.nbytes} bytes"
                yield batch

        return plain(self, lambda batches: func(bounded(batches)), *schema)

    monkeypatch.setattr(type(frame), "mapInArrow", watched)
    assert mined(frame) == by_brute_force(texts, 30, 4, 2000)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
