"""Benchmark decontamination: a prefix-filtered join of item windows with documents, in DataFrame operations only.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A window is
``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.

A document that contains a window contains each of its words. So every window is looked for at its rarest word only:
words are counted over all documents, and the least frequent word of a window is its prefix token. An occurrence of the
token fixes where the window would begin, which must leave room for the words before and after it; then
the words there are compared one by one. The token table is broadcast only up to a counted size; a larger one is
joined by shuffle, first without and then with the document's words.

Defined results: null or wordless texts have no words and no hits. Null or wordless items have no windows. An item
without an id makes hits but counts in no list of items. Every row gets its own result, so repeated rows have equal
ones; a null ``doc_id`` is kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.shared import ascii_lower, written

WINDOW = 10
#: Windows up to which their table is broadcast, about 100 MB of words.
BROADCAST_WINDOWS = 200_000
#: Documents with hits up to which their list is broadcast, about 20 MB.
BROADCAST_DOCUMENTS = 500_000
#: ASCII characters one by one, which a pattern looks up in a table; ranges would be compared one after the other.
WORD = f"[{string.digits}{string.ascii_letters}\\x{{80}}-\\x{{10FFFF}}]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``item_id, words``: the windows of all items."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("all")).where("size(all) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - size + 1)))
    return items.select("item_id", "all", starts.alias("start")).select("item_id", F.slice("all", F.col("start"), size).alias("words"))


def find_windows(docs: DataFrame, windows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, print, start, words``: every occurrence of a window in a document; ``start`` counts from 0."""
    texts = _rows(docs, doc_id, text).select("doc_id", "print", words_of(F.col("text")).alias("all"))
    distinct = windows.select("words").distinct()
    small = distinct.count() <= BROADCAST_WINDOWS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    vocabulary = distinct.select(F.explode("words").alias("word")).distinct()
    seen = texts.select(F.explode("all").alias("word")).join(side(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts, _ = written(seen, "rarity")
    # windows with a word that no document has cannot occur: the inner join leaves them out
    placed = distinct.select("words", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    least = placed.join(side(counts), "word").groupBy("words").agg(
        F.min(F.struct("n", "offset", "word")).alias("token"), F.count("*").alias("known"), F.first("length").alias("length"))
    tokens, _ = written(least.where("known = length").select("words", "length", "token.offset", "token.word"), "tokens")
    fits = "at >= offset AND at - offset + length <= size(all)"
    same = "slice(all, at - offset + 1, length) = words"
    if small:
        found = texts.select("doc_id", "print", "all", F.posexplode("all").alias("at", "word")).join(F.broadcast(tokens), "word").where(fits).where(same)
    else:
        placed = texts.select("doc_id", "print", F.size("all").alias("room"), F.posexplode("all").alias("at", "word")).join(tokens, "word")
        likely = placed.where("at >= offset AND at - offset + length <= room").drop("word", "room")
        found = likely.alias("l").join(texts.distinct().alias("t"), F.expr("l.doc_id <=> t.doc_id AND l.print = t.print")).where(same).select("l.*")
    return found.select("doc_id", "print", (F.col("at") - F.col("offset")).alias("start"), "words").distinct()


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows by id and a print of their text, so that rows which repeat an id stay apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body, F.length(body)).alias("print"), body.alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated, print`` for every row of ``docs``.

    ``n_hit`` counts the words inside any window found, ``items`` lists the items found, sorted as strings.
    """
    windows, _ = written(windows_of(benchmark, item_id, item_text, size), "windows")
    found, _ = written(find_windows(docs, windows, doc_id, text), "found")
    covered = found.selectExpr(
        "doc_id", "print", "start", "start + size(words) AS end").distinct().selectExpr(
        "doc_id", "print", "end - greatest(start, coalesce(max(end) OVER (PARTITION BY doc_id, print ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fresh")
    hits = covered.groupBy("doc_id", "print").agg(F.sum(F.greatest(F.col("fresh"), F.lit(0))).alias("n_hit"))
    named = windows.where("item_id IS NOT NULL").distinct()
    items = found.select("doc_id", "print", "words").join(named, "words").groupBy("doc_id", "print").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    counted = _rows(docs, doc_id, text).select("doc_id", "print", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"))
    joined = counted.alias("c").join(hits.alias("h"), F.expr("c.doc_id <=> h.doc_id AND c.print = h.print"), "left").join(
        items.alias("i"), F.expr("c.doc_id <=> i.doc_id AND c.print = i.print"), "left")
    listed = F.coalesce("i.items", F.array().cast("array<string>"))
    n_hit = F.coalesce("h.n_hit", F.lit(0)).cast("bigint")
    return joined.select("c.doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"),
                         (n_hit > 0).alias("contaminated"), "c.print")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window was found, with their own columns."""
    windows, _ = written(windows_of(benchmark, item_id, item_text, size), "windows")
    hit, _ = written(find_windows(docs, windows, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct(), "hit")
    side = F.broadcast(hit) if hit.count() <= BROADCAST_DOCUMENTS else hit
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.join(side, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(body, F.length(body)) == F.col("_print")), "left_anti")


#: The same contamination in DuckDB, by comparing all word runs.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g, len(list_slice(w, s, s + 9)) AS n FROM starts),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.p, a.n, win.item_id FROM places a JOIN win ON win.n = a.n AND list_slice(a.w, a.p, a.p + a.n - 1) = win.g),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
