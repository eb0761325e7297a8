import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lakeglass.llm import mixing, url_filter

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def blocked_by_brute_force(url, at, events):
    if url is None or at is None or "://" not in url:
        return 0
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark)[0]
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].split(":")[0].lower().removesuffix(".")
    if not host:
        return 0
    path = "/".join(s for s in path.split("/") if s)
    n = 0
    for entry in {(e[0], e[1], e[2]) for e in events if None not in e[1:]}:
        past = [e for e in events if e[:3] == entry and None not in e[1:] and e[3] <= at]
        if not past or min(e[4] for e in past if e[3] == max(x[3] for x in past)) != "add":
            continue
        _, kind, value = entry
        full = f"{host}/{path}".rstrip("/")
        n += kind == "host" and host == value or kind == "domain" and (host == value or host.endswith("." + value)) or kind == "prefix" and (full + "/").startswith(value + "/")
    return n


def test_url_filter_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.org"]
    values = {"host": hosts, "domain": ["example.com", "org", "a.example.com"], "prefix": ["x.org/a", "x.org", "a.example.com/a/b"]}
    events = [(rng.choice(["l1", "l2", None]), k, rng.choice(values[k]), day(rng.randrange(40)), rng.choice(["add", "add", "remove"])) for k in rng.choices(list(values), k=60)]
    events += [("l1", "host", None, day(1), "add"), ("l1", "host", "x.org", None, "add"), events[0]]
    urls = ["http://%s/%s" % (rng.choice(hosts), rng.choice(["", "a", "a/b?x=1", "a//b/c#f", "ab"])) for _ in range(80)]
    urls += [None, "", "no url", "http:///a", "HTTPS://User@A.Example.COM.:80/a", "ftp://x.org?q", urls[0], "http://x.org/" + "a/" * 200]
    captures = [(i, u, day(rng.randrange(45)) if i % 9 else None) for i, u in enumerate(urls)]
    frame = spark.createDataFrame([(*c, "clash") for c in captures], "page_id long, url string, fetched_at date, host string")
    lists = spark.createDataFrame(events, "list string, kind string, value string, at date, action string")
    got = {r.page_id: r for r in url_filter.evaluate(frame, lists).collect()}
    for i, u, at in captures:
        assert got[i].n_entries == blocked_by_brute_force(u, at, events), (u, at)
        assert got[i].blocked == (got[i].n_entries > 0)
    assert url_filter.allowed(frame, lists).columns == frame.columns
    assert url_filter.evaluate(frame, lists.limit(0)).where("blocked").count() == 0
    assert url_filter.evaluate(frame.limit(0), lists).count() == 0


def rates_by_brute_force(tokens, posterior, targets):
    """The same steps in plain Python."""
    k = range(len(targets))
    have = [sum(t * p[j] for t, p in zip(tokens, posterior)) for j in k]
    share = [x / sum(targets) for x in targets]
    total = max(have[j] / share[j] for j in k)
    rate = [1.0] * len(tokens)
    for _ in range(mixing.STEPS):
        sums = [sum(r * t * p[j] for r, t, p in zip(rate, tokens, posterior)) for j in k]
        if max(abs(sums[j] - share[j] * total) for j in k) <= mixing.CLOSE * total:
            break
        gap = [(sums[j] - share[j] * total) / have[j] for j in k]
        rate = [max(0.0, r - sum(g * x for g, x in zip(gap, p))) if t else r for r, t, p in zip(rate, tokens, posterior)]
    return rate


def test_rates_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        weights = [rng.random() ** 4 for _ in range(3)]
        rows.append((i, rng.choice([0, 5, 100, 3000]), [w / sum(weights) for w in weights]))
    frame = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    rated, goal = mixing.fit_rates(frame, ["a", "b", "c"], {"a": 5, "b": 1, "c": 1})
    got = {r.doc_id: r.rate for r in rated.collect()}
    want = rates_by_brute_force([r[1] for r in rows], [r[2] for r in rows], [5, 1, 1])
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got) and min(got.values()) >= 0
    sums = [sum(got[i] * t * p[j] for i, t, p in rows) for j in range(3)]
    assert all(abs(sums[j] - list(goal.values())[j]) < 0.05 * sum(sums) for j in range(3))


def test_mixing_of_languages(spark, table):
    docs = table("documents")
    labelled = docs.where("doc_id % 2 = 0").select("text", F.col("lang").alias("domain"))
    targets = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1, "unheard": 0.5}
    mixed, domains, goal = mixing.mix(docs, labelled, targets)
    assert domains == sorted(domains) and "unheard" not in goal
    rows = mixed.collect()
    right = sum(r.lang == domains[max(range(len(domains)), key=lambda k: r.posterior[k])] for r in rows)
    assert right / len(rows) > 0.9 and all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows)
    for k, d in enumerate(domains):
        assert abs(sum(r.rate * r.tokens * r.posterior[k] for r in rows) - goal[d]) < 0.01 * sum(goal.values())
    assert all(r.copies >= 1 for r in rows)  # no document goes when totals follow from the targets
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "the then", "x"), (3, "the then", "x"), (3, "the then", "x"), (4, "ñ " * 60_000, "x")], "doc_id long, text string, rate string")
    labelled = spark.createDataFrame([("the then", "en"), ("ño ño", "es"), (None, "en"), ("x", None)], "text string, domain string")
    got = mixing.mix(docs, labelled, {"en": 0.9, "es": 0.1})[0].collect()
    assert len(got) == 6 and all(r.rate == 1 for r in got if not r.tokens)
    again = mixing.repeated(docs, labelled, {"en": 0.9, "es": 0.1})
    assert again.columns == docs.columns and {r.doc_id for r in again.collect()} == {1, 2, 3, 4, None}
    nothing, domains, goal = mixing.mix(docs, labelled.limit(0), {"en": 1.0})
    assert domains == [] and goal == {} and {r.rate for r in nothing.collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labelled, {"en": 1.0})[0].count() == 0
    assert mixing.repeated(docs.limit(0), labelled, {"en": 1.0}).count() == 0


def unclear_rows():
    """Documents of four domains, a third of them of unclear membership."""
    rng, rows = random.Random(3), []
    for i in range(600):
        k = rng.choices(range(4), [4, 2, 2, 2])[0]
        weights = [rng.random() + (2 if j == k else 0) for j in range(4)] if i % 3 == 0 else [1000.0 if j == k else 1e-3 for j in range(4)]
        rows.append((i, rng.choice([0, 20, 300, 2000]), [w / sum(weights) for w in weights]))
    return rows


def test_unclear_documents_stay(spark):
    rows, domains, targets = unclear_rows(), ["a", "b", "c", "d"], {"a": 0.5, "b": 0.2, "c": 0.2, "d": 0.1}
    frame = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    for least, total in ((1.0, None), (0.0, 200_000.0)):
        rated, goal = mixing.fit_rates(frame, domains, targets, total, least)
        got = {r.doc_id: r.rate for r in rated.collect()}
        assert rated.columns == ["doc_id", "tokens", "posterior", "rate"] and min(got.values()) >= least
        assert all(got[i] == 1 for i, t, _ in rows if not t)
        for j, d in enumerate(domains):
            assert abs(sum(got[i] * t * p[j] for i, t, p in rows) - goal[d]) <= 2 * mixing.CLOSE * sum(goal.values())


def test_gap_that_remains_is_told(spark):
    frame = spark.createDataFrame([(1, 100, [0.6, 0.4]), (2, 100, [0.4, 0.6])], "doc_id long, tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="too many"):
        rated, _ = mixing.fit_rates(frame, ["a", "b"], {"a": 0.9, "b": 0.1}, None, 1.0)
    assert all(r.rate >= 1 for r in rated.collect())


def test_mixing_of_other_domains(spark):
    """Topics of one language, and scripts without spaces: words tell them apart, no signs of four languages do."""
    rng = random.Random(6)
    common = "the of and to in is that it was for on are with as this have from or had by".split()
    topics = {"sport": "goal match team player league score coach season".split(), "law": "court judge statute appeal verdict clause plaintiff tort".split(),
              "code": "def return import class self lambda yield assert".split(), "river": list("河水流江湖海波浪"), "mountain": list("山峰岩石峡谷坡岭")}

    def text(topic):
        words = rng.choices(topics[topic], k=12)
        if topic in ("river", "mountain"):
            return "".join(words)
        words += rng.choices(common, k=30)
        rng.shuffle(words)
        return " ".join(words)

    rows = [(i, text(t), t) for i, t in enumerate(rng.choices(sorted(topics), k=300))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, topic string")
    found, domains = mixing.with_posteriors(frame.where("doc_id % 2 = 1"), frame.where("doc_id % 2 = 0"), "topic")
    got = found.collect()
    assert domains == sorted(topics)
    assert sum(r.topic == domains[max(range(5), key=lambda k: r.posterior[k])] for r in got) > 0.95 * len(got)


def test_words_of_every_sign(spark):
    """Latin texts have a pattern of their own; words and tokens are those of the definition for every sign."""
    alone = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]")

    def by_hand(text):
        words, word = [], ""
        for sign in text:
            inside = unicodedata.category(sign)[0] in "LMN"
            word += sign if inside else ""
            if not inside or alone.match(sign):
                words, word = words + [word], ""
        return [w for w in words + [word] if w]

    later = "\u0301\u0142\u03b1\u0660\u2019\u2014\u2003\u3000\u3001\u0e01\u1000\u1780\u3042\u30fc\u4e00\U00020000\U0001f600"
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(256)] + [f"\u00e9{s}b 1{s}{s}2 {s}" for s in later] + ["", " ", " a", "a ", "\n\n", "don\u2019t \u4e2d\u6587x", "x" * 9 + " -- \u00bd"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, text string")
    got = {r.i: r for r in frame.select("i", mixing._words(F.col("text")).alias("words"), mixing._tokens(F.col("text")).alias("tokens")).collect()}
    for i, text in enumerate(texts):
        assert got[i].words == by_hand(text), text
        assert got[i].tokens == len(re.findall(r"[^ \t\n\x0b\f\r]+", text)), text
    assert got[len(texts)].words is None and got[len(texts)].tokens == 0


def test_latin_texts_take_the_fast_pattern(spark):
    """No text goes through the pattern that looks behind each sign unless a sign asks for it, and tokens are counted without a match object each."""
    frame = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate([("the then", "en"), ("ni\u00f1o", "es")] * 3)], "doc_id long, text string, domain string")
    found, _ = mixing.with_posteriors(frame, frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan
    assert re.search(r"CASE WHEN .*RLIKE.* THEN split\(", plan)
