"""Phrase collocations by SETM: set-oriented mining over sorted occurrence relations.

Texts fall into pieces and pieces into words. A phrase is a run of words within a piece; its frequency counts every
place where it stands, overlaps included. Everything is per language.

1. The first occurrence relation holds all words in order of piece and position: one row per chunk of texts, with the distinct
   words of the chunk and one code per place; code 0 ends a piece. It is written once.
2. The groups of a relation are counted: places are merge-joined with the next ones of their piece, equal runs are counted
   within the chunk, and ``groupBy`` sums the counts of all chunks. Only partial counts are shuffled, so a frequent
   phrase is a row per chunk at most, never a task.
3. Before the next length, the relation is semi-joined with the groups that are frequent enough, and written: stretches
   of places where every run is frequent remain, the rest ends a piece. The semi-join looks the runs up in one
   bit per group of a bitmap of ``2**BITS`` bits, so what is sent to the tasks does not grow with the data. Another run may share a bit; it
   then stays until the next counting, which is exact. So a full bitmap costs time and loses nothing.
4. Frequent phrases are cut in all ways, the frequencies of their parts are joined to them, and the lowest score counts.
   Phrases that a longer one nearly always contains are dropped. The first phrases of each language are ranked within
   salted groups first.

Words travel as 64-bit hashes of language and word. The counted words are checked: should a frequent one share its hash
with another word, or have the hash 0, which stands for no word, everything is hashed again with another seed. So counts are exact. Scores are made in DECIMAL.

Defined results: a null text is empty; a null language is ``und``. Rows that repeat an id or a text all count, ids are not
read. Texts without words and empty tables give no rows. A text is never split. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.llm.shared import batches_of, discard, written
from lakeglass.runtime import query

LEAST = 30
LONGEST = 4
PER_GROUP = 2000
#: The bitmap of a semi-join has 2**28 bits, that is 32 MB.
BITS = 28
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21
#: Bytes of texts or chunks that Spark gives to Python at once. A task would else hold all of its texts or chunks, several times.
BATCH_BYTES = 1 << 21
#: Parts into which a language is split before its phrases are ranked.
SALTS = 64

# Fixed values of the contract: bytes that end a piece, and bytes between words.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_PLAIN = bytes(ord(",") if b in ENDS else ord(" ") if b in BLANKS else b for b in range(256))

CHUNKS = "lang string, words array<binary>, hashes array<bigint>, n array<bigint>, codes binary"  # codes: 32-bit numbers, one after another


def _hash(lang: bytes, word: bytes, seed: int) -> int:
    """A signed 64-bit hash of a word of a language."""
    return xxhash.xxh64_intdigest(b"%d:%b%b" % (len(lang), lang, word), seed) - (1 << 63)


def _chunk(lang: str, texts: list[bytes], hash_of: Callable[[bytes, bytes], int]) -> pa.RecordBatch | None:
    marked = b",".join(texts).lower().translate(_PLAIN).replace(b",", b" , ")  # bytes: only A-Z are lower-cased
    tokens = marked.split()
    counts = Counter(tokens)
    counts.pop(b",", None)
    if not counts:
        return None
    code = {word: i for i, word in enumerate(counts, 1)}
    code[b","] = 0
    codes = np.fromiter(map(code.__getitem__, tokens), np.int32, len(tokens))
    name = lang.encode()
    row = [[lang], [list(counts)], [[hash_of(name, word) for word in counts]], [list(counts.values())], [codes.tobytes()]]
    types = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["lang", "words", "hashes", "n", "codes"])


def _chunks(batches: Iterator[pa.RecordBatch], hash_of: Callable[[bytes, bytes], int], most: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if size and size + len(text) > most:
                yield from filter(None, (_chunk(k, t, hash_of) for k, t in held.items()))
                held, size = {}, 0
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
    yield from filter(None, (_chunk(k, t, hash_of) for k, t in held.items()))


def _bit(hashes: list[np.ndarray], size: int) -> np.ndarray:
    """The bit of each run of words in a bitmap of ``size`` bits, as ``_bit_sql`` has it."""
    mask = np.int64(size - 1)
    return sum((h & mask) * (2 * j + 1) for j, h in enumerate(hashes)) & mask


def _bit_sql(k: int) -> str:
    mask = (1 << BITS) - 1
    return f"({' + '.join(f'(w{j + 1} & {mask}L) * {2 * j + 1}' for j in range(k))}) & {mask}L"


def _frequent_bits(groups: DataFrame, k: int) -> np.ndarray:
    """One bit per group, 2**BITS in all, whatever the number of groups."""
    place = f"({_bit_sql(k)}) + 1"
    buckets = groups.selectExpr(f"bitmap_bucket_number({place}) AS bucket", f"bitmap_bit_position({place}) AS at").groupBy("bucket").agg(
        F.expr("bitmap_construct_agg(at)").alias("bits"))
    found = np.zeros((1 << BITS) // 8, np.uint8)
    for bucket, bits in buckets.toLocalIterator():
        own = found[(bucket - 1) * len(bits):bucket * len(bits)]
        own[:] = np.frombuffer(bits, np.uint8)[:len(own)]
    return found


def _places(codes: np.ndarray, k: int) -> np.ndarray:
    """Places where a run of ``k`` words begins that does not leave its piece."""
    words = codes > 0
    whole = words[:max(0, len(codes) - k + 1)].copy()
    for j in range(1, k):
        whole &= words[j:len(codes) - k + 1 + j]
    return np.flatnonzero(whole)


def _stretches(codes: np.ndarray, hashes: np.ndarray, k: int, bits: np.ndarray) -> np.ndarray:
    """The relation semi-joined with frequent runs of ``k`` words: what can still be extended, every stretch a piece of its own."""
    places = _places(codes, k)
    bit = _bit([hashes[codes[places + j] - 1] for j in range(k)], 8 * len(bits))
    places = places[bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]
    if not len(places):
        return codes[:0]
    cuts = np.flatnonzero(np.diff(places) != 1)
    first, last = places[np.r_[0, cuts + 1]], places[np.r_[cuts, len(places) - 1]]
    longer = last > first  # a single run has no neighbour to extend it
    first, size = first[longer], (last - first)[longer] + k + 1  # and one place for the end of the piece
    ends = np.cumsum(size)
    out = codes[np.minimum(np.repeat(first - ends + size, size) + np.arange(size.sum()), len(codes) - 1)]
    out[ends - 1] = 0
    return out


def _extended(codes: np.ndarray, distinct: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct runs of ``k`` words, as ``k`` arrays of codes, and how often they stand in the relation.

    The runs of each length are those of the length before, merged with the word at the next position of the piece.
    """
    places = _places(codes, k)
    spelled = [np.arange(distinct + 1)]
    group = codes[places].astype(np.int64)
    for j in range(1, k):
        pairs, group, counts = np.unique(group * (distinct + 1) + codes[places + j], return_inverse=True, return_counts=True)
        spelled = [s[pairs // (distinct + 1)] for s in spelled] + [pairs % (distinct + 1)]
    return spelled, counts


def _pruned(relation: DataFrame, k: int, bits: np.ndarray, label: str) -> tuple[DataFrame, str]:
    sent = relation.sparkSession.sparkContext.broadcast(bits)

    def semi_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, codes in zip(batch.column(0), batch.column(1)):
                kept = _stretches(np.frombuffer(codes.as_buffer(), np.int32), hashes.values.to_numpy(), k, sent.value)
                if len(kept):
                    own = pa.ListArray.from_arrays([0, len(hashes.values)], hashes.values)
                    yield pa.RecordBatch.from_arrays([own, pa.array([kept.tobytes()], pa.binary())], ["hashes", "codes"])

    return written(relation.mapInArrow(semi_join, "hashes array<bigint>, codes binary"), label, large_rows=True)


def _counted(relation: DataFrame, k: int, least: int) -> DataFrame:
    """``w1 .. wk, f``: the runs of ``k`` words that occur at least ``least`` times."""
    names = [f"w{j}" for j in range(1, k + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, codes in zip(batch.column(0), batch.column(1)):
                hashes = hashes.values.to_numpy()
                spelled, counts = _extended(np.frombuffer(codes.as_buffer(), np.int32), len(hashes), k)
                if len(counts):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[s - 1]) for s in spelled] + [pa.array(counts)], [*names, "f"])

    found = relation.mapInArrow(count, ", ".join(f"{w} bigint" for w in names) + ", f bigint")
    return found.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _words(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The first relation, its counted words ``lang, word, hash, f``, and their paths."""
    seed = 0
    while True:
        hash_of = functools.partial(_hash, seed=seed)
        chunks, path = written(texts.mapInArrow(functools.partial(_chunks, hash_of=hash_of, most=CHUNK_BYTES), CHUNKS), "chunks", large_rows=True)
        listed = chunks.select("lang", F.explode(F.arrays_zip("words", "hashes", "n")).alias("x")).select("lang", "x.*")
        counted = listed.groupBy("lang", "words", "hashes").agg(F.sum("n").alias("f"))
        words, words_path = written(counted.select("lang", F.col("words").cast("string").alias("word"), F.col("hashes").alias("hash"), "f"), "words")
        shared = words.groupBy("hash").agg(F.count("*").alias("n"), F.sum("f").alias("f")).where(f"(n > 1 OR hash = 0) AND f >= {least}")
        if shared.isEmpty():
            return chunks.select("hashes", "codes"), words, [path, words_path]
        discard(texts.sparkSession, path, words_path)
        seed += 1


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``k, w1 .. w<longest>, f``, all frequent runs of up to ``longest`` words with 0 for the words that shorter ones lack, and ``lang, word, hash, f`` of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    with batches_of(spark, BATCH_BYTES):  # every step here is written at once
        relation, words, (path, _) = _words(texts.where("text IS NOT NULL"), least)
        level = words.where(f"f >= {least}").select(F.col("hash").alias("w1"), "f")
        levels = [level]
        for k in range(2, longest + 1):
            relation, next_path = _pruned(relation, k - 1, _frequent_bits(level, k - 1), f"places-{k - 1}")
            discard(spark, path)
            path = next_path
            level, _ = written(_counted(relation, k, least), f"phrases-{k}")
            levels.append(level)
        discard(spark, path)
    wide = [f"w{j}" for j in range(1, longest + 1)]
    found = None
    for k, level in enumerate(levels, 1):
        row = level.select(F.lit(k).alias("k"), *[F.col(w) if j < k else F.lit(0).cast("bigint").alias(w) for j, w in enumerate(wide)], "f")
        found = row if found is None else found.union(row)
    return found, words


def _runs(longest: int, ranges: str) -> str:
    """SQL of an array of runs of the words of a phrase; ``ranges`` makes the structs ``(label, from, size)``."""
    part = ", ".join(f"IF(r.size >= {j}, get(ws, r.at + {j - 1}), 0L) AS p{j}" for j in range(1, longest + 1))
    return f"transform({ranges}, r -> struct(r.cut AS cut, r.first AS first, {part}))"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, per_group: int = PER_GROUP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``per_group`` phrases of 2 to ``longest`` words of each language.

    ``a`` is the frequency of the phrase, ``l`` and ``r`` those of its parts at the cut that counts, ``n`` all words of the
    language, ``score`` two million times the share of the phrase in both parts, rounded down.
    """
    groups, words = frequent_phrases(docs, text, lang, least, longest)
    wide = ", ".join(f"w{j}" for j in range(1, longest + 1))
    parts = ", ".join(f"p{j}" for j in range(1, longest + 1))
    same = " AND ".join(f"g.w{j} = c.p{j}" for j in range(1, longest + 1))
    phrases = query(f"SELECT k, f AS a, {wide}, slice(array({wide}), 1, k) AS ws FROM {{groups}} WHERE k > 1", groups=groups)
    cuts = _runs(longest, "flatten(transform(sequence(1, k - 1), c -> array(struct(c AS cut, true AS first, 0 AS at, c AS size), struct(c AS cut, false AS first, c AS at, k - c AS size))))")
    scored = query(
        f"""
        WITH c AS (SELECT k, a, {wide}, inline({cuts}) FROM {{phrases}}),
        sides AS (SELECT c.k, c.a, {', '.join(f'c.w{j}' for j in range(1, longest + 1))}, cut, max(f) FILTER (WHERE first) AS l, max(f) FILTER (WHERE NOT first) AS r
                  FROM c JOIN {{groups}} AS g ON {same} GROUP BY ALL),
        marked AS (SELECT *, CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + r) AS score FROM sides)
        SELECT k, a, {wide}, min(struct(score, cut, l, r)) AS best FROM marked GROUP BY k, a, {wide}""",
        phrases=phrases, groups=groups)
    inner = _runs(longest, "flatten(transform(sequence(2, k - 1), s -> transform(sequence(0, k - s), i -> struct(s AS cut, true AS first, i AS at, s AS size))))")
    covered = query(f"SELECT {parts}, max(a) AS longer FROM (SELECT a, inline({inner}) FROM {{phrases}} WHERE k > 2) GROUP BY {parts}", phrases=phrases)
    kept = query(f"""SELECT g.* FROM {{scored}} AS g LEFT JOIN {{covered}} AS c ON {same}
                     WHERE longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * 80""", scored=scored, covered=covered)
    spelled = query(
        f"""
        WITH placed AS (SELECT k, a, {wide}, best, posexplode(slice(array({wide}), 1, k)) AS (at, hash) FROM {{kept}})
        SELECT max(lang) AS lang, array_join(transform(array_sort(collect_list(struct(at, word))), x -> x.word), ' ') AS phrase, a, best
        FROM placed JOIN {{words}} AS w USING (hash) GROUP BY k, a, {wide}, best""",
        kept=kept, words=words.where(f"f >= {least}").select("lang", "word", "hash"))
    order = "best.score DESC, a DESC, phrase"
    ranked = query(
        f"""
        WITH near AS (SELECT *, row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {SALTS}) ORDER BY {order}) AS place FROM {{spelled}}),
        first AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {order}) AS rank FROM near WHERE place <= {per_group})
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, best.l AS l, best.r AS r, n, best.score AS score
        FROM first JOIN (SELECT lang, sum(f) AS n FROM {{words}} GROUP BY lang) USING (lang) WHERE rank <= {per_group}""",
        spelled=spelled, words=words)
    return ranked


ORACLE = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^ \t]+') AS ws
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS part
          FROM documents)),
runs AS (
    SELECT lang, s AS k, array_to_string(ws[i:i + s - 1], ' ') AS phrase
    FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces) AS p, (SELECT unnest([1, 2, 3, 4]) AS s) AS sizes
    WHERE i + s - 1 <= len(ws)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) AS c
    JOIN counts AS x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
    JOIN counts AS y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_runs AS (
    SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates) AS c, (SELECT unnest([2, 3]) AS s) AS sizes
    WHERE s < k AND i + s - 1 <= k GROUP BY 1, 2),
kept AS (SELECT s.* FROM scored AS s LEFT JOIN inner_runs AS i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
