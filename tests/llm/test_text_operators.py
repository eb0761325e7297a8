import hashlib
import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakeglass.llm import decontaminate, line_dedup, lm_score, token_files
from lakeglass.llm.settings import TOKENIZER


def lines_by_brute_force(docs, least):
    """Line numbers to delete: every least run that stood earlier."""
    seen, out = set(), {d: set() for d, _ in docs}
    for d, text in docs:
        lines = text.split("\n") if text else []
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += len(lines[j].split())
                key = tuple(lines[i:j + 1])
                if words >= least:
                    if key in seen:
                        out[d].update(range(i, j + 1))
                    seen.add(key)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(d, "\n".join(rng.choice(["a b", "c", "d e f", "", "g g g g", f"own {rng.random()}"]) for _ in range(rng.randrange(0, 14)))) for d in range(40)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, deleted string")
    for least in (4, 9):
        want = lines_by_brute_force(docs, least)
        got = {r.doc_id: r for r in line_dedup.dedup_lines(frame, min_words=least).collect()}
        for d, text in docs:
            ranges = {i for r in got[d].deleted for i in range(r["first"], r["last"] + 1)}
            assert ranges == want[d] and got[d].n_deleted == len(ranges)
            assert got[d].text == ("\n".join(x for i, x in enumerate(text.split("\n")) if i not in ranges) if ranges else text)


def test_lines_of_odd_rows(spark):
    long = "one two three " * 20
    frame = spark.createDataFrame([(2, long), (2, long), (1, f"x\n{long}"), (None, long), (3, None), (4, ""), (5, "a\n" * 50_000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_deleted) for r in line_dedup.dedup_lines(frame).collect()), key=repr)
    assert got == sorted([(2, 1, 1), (2, 1, 1), (1, 2, 0), (None, 1, 1), (3, 0, 0), (4, 0, 0), (5, 50_001, 49_999)], key=repr)  # overlapping copies go too
    assert {(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame.where("doc_id in (3, 4)")).collect()} == {(3, None), (4, "")}
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        o = ord(c)
        if o >= 0x80 or c.isascii() and c.isalnum():
            word += chr(o + 32) if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def contamination_by_brute_force(docs, items):
    windows = [(i, tuple(w[s:s + 10])) for i, t in items for w in [words_of(t)] if w for s in range(max(1, len(w) - 9))]
    out = {}
    for d, text in docs:
        words, hit, found = words_of(text), set(), set()
        for i, win in windows:
            for p in range(len(words) - len(win) + 1):
                if tuple(words[p:p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add(i)
        out[d] = (len(words), len(hit), sorted(str(i) for i in found if i is not None), bool(hit))
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(2)
    alphabet = ["the", "of", "Éa", "zu", "rare1", "x9", "Of", "ἀ", "ΑΣ"]
    items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 10, 14, 30])))) for i in range(12)] + [(5, None), (None, "alone here"), (11, "the, of! THE")]
    docs = []
    for d in range(40):
        parts = [rng.choice(alphabet) for _ in range(rng.randrange(30))]
        if d % 3 == 0:
            parts[3:3] = words_of(rng.choice(items)[1])
        docs.append((d, rng.choice([" ", "-", "\n"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "alone here " + "word " * 30_000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, word int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination_by_brute_force(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(frame, bench).collect()}
    assert got == want
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == sorted(d for d in want if not want[d][3])


def test_decontamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    assert got == sorted([(None, 2), (1, 2), (1, 2), (1, 0)], key=repr)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench).count() == 1


def test_decontamination_is_native(spark, table):
    plan = decontaminate.clean(table("documents"), table("benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def scores_by_brute_force(docs):
    words = [(t or "").encode().lower().split() for _, t in docs]

    def grams(w):
        return [tuple(w[i - k:i + 1]) for k in range(3) for i in range(k, len(w))]

    counts, total, out = Counter(), sum(map(len, words)), []
    for w in words:
        counts.update(grams(w))
    for w in words:
        own, logs = Counter(grams(w)), 0.0
        for i in range(len(w)):
            weight = 1.0
            for k in range(min(2, i), -1, -1):
                gram = tuple(w[i - k:i + 1])
                n = counts[gram] - own[gram]
                if n > 0 or k == 0:
                    below = counts[gram[:-1]] - own[gram[:-1]] if k else max(1, total - len(w))
                    logs += math.log(weight * (n or 0.5) / below)
                    break
                weight *= 0.4
        out.append((len(w), logs / len(w) if w else None))
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(d, " ".join(rng.choice("A b c dd e f".split()) for _ in range(rng.randrange(25)))) for d in range(60)] + [(70, None), (71, ""), (None, "b c"), (7, "b c b c"), (7, "b c b c")]
    frame = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, bucket string").repartition(5)
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", 100)
    monkeypatch.setattr(lm_score, "BUCKET_NGRAMS", 200)
    want = sorted((repr(d), n, None if s is None else round(s, 9)) for (d, _), (n, s) in zip(docs, scores_by_brute_force(docs)))
    got = sorted((repr(r.doc_id), r.n_words, None if r.log_score is None else round(r.log_score, 9)) for r in lm_score.score_documents(frame).collect())
    assert got == want
    assert lm_score.score_documents(frame.limit(0)).count() == 0


def test_packed_hashes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000, 70_000):
        hashes = np.unique(rng.integers(0, 2**lm_score.HASH_BITS, n, dtype=np.uint64))
        assert (lm_score._unpack(lm_score._pack(hashes), len(hashes)) == hashes).all()
        counts = rng.integers(0, 2**47, n)
        assert (lm_score._counts(lm_score._planes(counts), n) == counts).all()


@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=600))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(ids):
    words = token_files.pack(np.array(ids, np.uint64))
    assert token_files.unpack(words, len(ids)).tolist() == ids
    offsets = token_files.offsets_of(words)
    assert len(offsets) == -(-len(words) // token_files.STRIDE) and (not len(offsets) or offsets[0] == 0)


def test_simple8b_size():
    assert len(token_files.pack(np.zeros(1200, np.uint64))) == 10
    assert len(token_files.pack(np.full(60, 1, np.uint64))) == 1
    assert len(token_files.pack(np.full(3000, 40_000, np.uint64))) == 1000
    part = token_files.pack(np.arange(9000, dtype=np.uint64))
    start = token_files.offsets_of(part)[1]
    assert token_files.unpack(part[token_files.STRIDE:]).tolist()[:50] == list(range(start, start + 50))


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n'sdtÉ́<|>."))), max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_ids_of_the_text(text):
    encoder = token_files._encoder(TOKENIZER)
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from(list(" \n'sdtÉ́<|>."))), max_size=60))
@settings(max_examples=100, deadline=None)
def test_other_tokenizers_encode_whole_texts(text):
    encoder = token_files._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_word and token_files._encoder(TOKENIZER).by_word
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    docs = [(9, "The end"), (None, "first"), (3, None), (3, "x y"), (3, "x y"), (2, ""), (5, "word " * 50_000), (4, "<|endoftext|> É")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, part int").repartition(4)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(frame, path, TOKENIZER)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    tokenizer = token_files._tokenizer(TOKENIZER)
    at = 0
    for r, (d, t) in zip(got, sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d, at, len(ids), ids)
        at += len(ids)
    assert len(got) == len(docs)
    empty = str(tmp_path / "empty")
    token_files.write_tokens(frame.limit(0), empty, TOKENIZER)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_md5_of_kept_text(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert line_dedup.dedup_lines(frame).select(F.md5("text")).first()[0] == hashlib.md5(b"a").hexdigest()
