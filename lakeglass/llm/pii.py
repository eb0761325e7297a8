"""Personal data: spans of e-mail addresses, network addresses, card and telephone numbers.

1. Base spans are what four patterns find (see ``base_spans``); they are always reported.
2. A character-level bidirectional LSTM with a CRF learns from them. Labelled windows are a bounded sample: at most ``SAMPLE`` around base spans of each
   kind and as many without any, those with the smallest hash over all documents. Each labelled span is also shown to it
   in other spellings (``respelled``), which the patterns do not know, such as ``name [at] host [dot] com``.
3. Every text is cut into windows of ``WINDOW`` characters that overlap by ``OVERLAP``, and each window is decoded. What several windows say of one text
   is reconciled over the whole text: pieces of one kind that were cut by the edge of a window and overlap
   become one span, and of all spans those are taken that do not overlap and have the greatest sum of log-odds.
4. Such a span is added if it reads as its kind (``plausible``: digits in number, ranges, the Luhn sum) and overlaps no base span.

Defined results: a null text is empty and has no spans. Rows that repeat an id are documents of their own. With no base span of any
kind there is nothing to learn, and nothing is added. Places count code points; ends are exclusive. Results replace columns of their names,
other columns stay. Texts are read whole; the windows of a text are decoded in batches of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lakeglass.llm import pii_tagger
from lakeglass.llm.pii_tagger import KINDS, PAD, TAGS, Tagger, begin, char_codes
from lakeglass.llm.shared import replacing

Span = tuple[str, int, int]

#: Labelled windows of each kind, and without any, that are learned from.
SAMPLE = 250
#: Characters of a labelled window, and of one that is decoded.
LESSON, WINDOW, OVERLAP = 72, 160, 40

# Fixed values of the contract: the four patterns. Lookbehind and possessive forms find the same and take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in re.findall("[0-9]+", text)]
    return len(parts) == 4 and all(len(p) < 4 and int(p or "0") <= 255 for p in parts)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15


_SPELLED_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}[\s(\[{]{0,3}(?:@|at)[\s)\]}]{0,3}[A-Za-z0-9-]{1,64}(?:[\s(\[{]{0,3}(?:\.|dot)[\s)\]}]{0,3}[A-Za-z0-9-]{1,64}){1,8}")


def plausible(kind: str, text: str) -> bool:
    """Whether the text of a decoded span reads as its kind."""
    if kind == "email":
        return _SPELLED_EMAIL.fullmatch(text) is not None
    return {"ip": _is_ip, "card": _is_card, "phone": _is_phone}[kind](text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", at + 1)


def matches(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """Per kind all matches of its pattern from left to right, and whether each passes the checks of the kind."""
    numbers = any(d in text for d in "0123456789")
    return {
        "email": [(s, e, True) for s, e in _emails(text)],
        "ip": [(*m.span(), _is_ip(m.group())) for m in _IP.finditer(text)] if numbers and "." in text else [],
        "card": [(*m.span(), _is_card(m.group())) for m in _CARD.finditer(text)] if numbers else [],
        "phone": [(*m.span(), _is_phone(m.group())) for m in _PHONE.finditer(text)] if numbers and "+" in text else [],
    }


def base_spans(text: str) -> list[Span]:
    """The leftmost non-overlapping matches of each kind that pass its checks, by kind, then place."""
    return [(kind, s, e) for kind, found in matches(text).items() for s, e, good in found if good]


def respelled(kind: str, text: str, rng: np.random.Generator) -> str:
    """A labelled span in another spelling, one that the patterns do not find."""
    if kind == "email":
        at = [" @ ", "[at]", " [at] ", "(at)", " (at) ", " {at} "][rng.integers(6)]
        dot = ["[dot]", " [dot] ", "(dot)", " (dot) ", " dot ", "."][rng.integers(6)]
        name, host = text.split("@")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return text.replace(".", ["[.]", "(.)", " . ", "[dot]"][rng.integers(4)])
    if kind == "card":
        digits = _digits(text)
        return ["/", ".", "_", "  ", " - "][rng.integers(5)].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    groups = re.findall("[0-9]+", text)
    if len(groups) == 1:
        groups = [groups[0][:-7], groups[0][-7:-4], groups[0][-4:]]
    mark = ["-", ".", " ", "/"][rng.integers(4)]
    style = int(rng.integers(4))
    if style == 0 and len(groups) > 2 and len("".join(groups[1:])) >= 8:
        return f"({groups[1]}) {mark.join(groups[2:])}"
    return ("00" if style == 1 else "") + mark.join(groups)


def _lessons(batches: Iterable[pa.RecordBatch], sample: int) -> Iterator[pa.RecordBatch]:
    """Windows around base spans, ``kind, text, start, end``, and windows without any match; of each kind the ``sample`` first ones by hash."""
    import xxhash

    kept: dict[str, list] = {}
    last: dict[str, int] = {}  # the greatest hash that may still be among the first
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = matches(text)
            spots = [(kind, s, e) for kind, hits in found.items() for s, e, good in hits if good]
            spots.append(("", 0, 0))
            for kind, s, e in spots:
                order = xxhash.xxh64_intdigest(f"{kind}:{s}:{text}".encode("utf-8", "surrogatepass"))
                own = kept.setdefault(kind, [])
                if order <= last.get(kind, order):
                    room = max(0, LESSON - (e - s))
                    left = max(0, min(s - order % (room + 1), len(text) - LESSON)) if kind else order % max(1, len(text) - LESSON + 1)
                    cut = text[left:left + max(LESSON, e - s)]
                    others = [(a, b) for hits in found.values() for a, b, _ in hits if a < left + len(cut) and b > left and not (a >= s and b <= e)]
                    if others or len(cut) < 3:
                        continue  # the window shows more than its label says
                    own.append((order, kind, cut, s - left, e - left))
                    if len(own) > 4 * sample:
                        own.sort()
                        del own[sample:]
                        last[kind] = own[-1][0]
    for kind, own in kept.items():
        rows = sorted(own)[:sample]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] - (1 << 63) if i == 0 else x[i] for x in rows]) for i in range(5)], ["ord", "kind", "text", "start", "end"])


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """A tagger trained on a bounded sample of windows of ``docs``, or None if they hold no base span."""
    texts = docs.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    found = texts.mapInArrow(lambda batches: _lessons(batches, sample), "ord bigint, kind string, text string, start bigint, end bigint")
    chosen = found.selectExpr("*", "row_number() OVER (PARTITION BY kind ORDER BY ord, text, start) AS place").where(f"place <= {sample}")
    lessons = chosen.toPandas().sort_values(["kind", "ord", "text", "start"])  # 5 * sample short texts at most
    return fit_windows(lessons) if (lessons["kind"] != "").any() else None


def fit_windows(lessons: pd.DataFrame) -> Tagger:
    rng = np.random.default_rng(7)
    windows, tags, clean = [], [], []
    for row in lessons.itertuples():
        if not row.kind:
            clean.append(row.text)
        shown = row.text[row.start:row.end]
        for spelling in [shown] + ([respelled(row.kind, shown, rng), respelled(row.kind, shown, rng)] if row.kind else []):
            whole = row.text[:row.start] + spelling + row.text[row.end:]
            cut = int(rng.integers(0, max(1, len(whole) - LESSON + 1)))
            codes, tag = np.full(LESSON, PAD, np.uint8), np.zeros(LESSON, np.int64)
            part = char_codes(whole)[cut:cut + LESSON]
            codes[:len(part)] = part
            if row.kind:
                first, last = max(0, row.start - cut), min(LESSON, row.start + len(spelling) - cut)
                if first < last:
                    b = begin(KINDS.index(row.kind))
                    tag[first:last] = b + 1
                    tag[first] = b
            windows.append(codes)
            tags.append(tag)
    tagger = pii_tagger.train(np.stack(windows), np.stack(tags))
    # what it takes for personal data in windows without any sets the log-odds that a span needs
    wrong = [margin for text, spans in zip(clean, _decoded(clean, tagger)) for kind, s, e, margin in spans if plausible(kind, text[s:e])]
    tagger.least = max([0.0, *wrong])
    return tagger


def _windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of windows over all texts: codes, text number and first place of each."""
    owners, starts, codes = [], [], []
    for number, text in enumerate(texts):
        own = char_codes(text)
        for start in range(0, max(1, len(own) - OVERLAP), WINDOW - OVERLAP):
            part = own[start:start + WINDOW]
            codes.append(part if len(part) == WINDOW else np.concatenate([part, np.full(WINDOW - len(part), PAD, np.uint8)]))
            owners.append(number)
            starts.append(start)
            if len(codes) == pii_tagger.BATCH:
                yield np.stack(codes), np.array(owners), np.array(starts)
                owners, starts, codes = [], [], []
    if codes:
        yield np.stack(codes), np.array(owners), np.array(starts)


def _pieces(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the tagged stretches of a window."""
    out, at = [], 0
    while at < len(tags):
        if tags[at] == 0:
            at += 1
            continue
        kind, end = (int(tags[at]) - 1) // 2, at + 1
        while end < len(tags) and tags[end] == begin(kind) + 1:
            end += 1
        out.append((kind, at, end))
        at = end
    return out


def _decoded(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int, float]]]:
    """The reconciled spans of each text with their log-odds."""
    found: dict[int, list] = {}
    for codes, owners, starts in _windows(texts):
        scores = tagger.emissions(codes)
        tags = tagger.tags(scores)
        for w in np.flatnonzero(tags.any(axis=1)).tolist():
            text = texts[owners[w]]
            for kind, s, e in _pieces(tags[w]):
                start, end = int(starts[w]) + s, min(int(starts[w]) + e, len(text))
                if start < end:
                    cut = (s == 0 and start > 0) or (e == WINDOW and end < len(text))
                    found.setdefault(int(owners[w]), []).append((KINDS[kind], start, end, tagger.margin(scores[:, :, w], tags[w], s, e), cut))
    return [reconciled(found.get(number, [])) for number in range(len(texts))]


def reconciled(pieces: list[tuple[str, int, int, float, bool]]) -> list[tuple[str, int, int, float]]:
    """Pieces ``kind, start, end, log-odds, cut by an edge`` of overlapping windows as one set of spans that do not overlap."""
    whole: dict[Span, float] = {}
    for kind in KINDS:
        joined: list[list] = []
        for _, s, e, margin, cut in sorted(p for p in pieces if p[0] == kind):
            if joined and s < joined[-1][1] and (cut or joined[-1][3]):  # an edge cut one of the two
                last = joined[-1]
                last[1], last[2], last[3] = max(last[1], e), max(last[2], margin), cut and e >= last[1]
            else:
                joined.append([s, e, margin, cut])
        for s, e, margin, _ in joined:
            whole[kind, s, e] = max(margin, whole.get((kind, s, e), margin))
    spans = sorted(((k, s, e, m) for (k, s, e), m in whole.items() if m > 0), key=lambda x: (x[2], x[1], x[0]))
    ends, best = [x[2] for x in spans], [(0.0, ())]  # weighted intervals: the best choice among the spans up to each end
    for i, (kind, s, e, margin) in enumerate(spans):
        before = best[int(np.searchsorted(ends[:i], s, side="right"))]
        best.append(max(best[-1], (before[0] + margin, (i, before[1])), key=lambda b: b[0]))
    chosen, link = [], best[-1][1]
    while link:
        chosen.append(spans[link[0]])
        link = link[1]
    return chosen[::-1]


def spans_of(texts: list[str], tagger: Tagger | None) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    decoded = _decoded(texts, tagger) if tagger else [[] for _ in texts]
    for text, extra in zip(texts, decoded):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        added = [(k, s, e) for k, s, e, margin in extra if margin > tagger.least and plausible(k, text[s:e]) and not any(a < e and s < b for a, b in taken)]
        yield base, added


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


#: Characters of text that are decoded together; a longer text is decoded alone.
CHARS = 1 << 22


def with_spans(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, both as ``kind:start:end`` joined by commas, and ``n_email, n_ip, n_card, n_phone``, the base spans of each kind."""
    base = replacing(docs, "base_spans", "spans", *[f"n_{k}" for k in KINDS])
    at = base.columns.index(text)
    plain = base.toDF(*[f"c{i}" for i in range(len(base.columns))])
    made = {**{f"n_{k}": LongType() for k in KINDS}, "base_spans": StringType(), "spans": StringType()}
    schema = StructType([*plain.schema, *[StructField(n, t) for n, t in made.items()]])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            rows, group, size = [], [], 0
            for t in [*texts, None]:
                if t is None or (group and size + len(t) > CHARS):
                    for own, added in spans_of(group, tagger):
                        rows.append([sum(k == kind for k, _, _ in own) for kind in KINDS] + [listed(own), listed(own + added)])
                    group, size = [], 0
                if t is not None:
                    group.append(t)
                    size += len(t)
            columns = [pa.array(x, pa.int64() if i < len(KINDS) else pa.string()) for i, x in enumerate(zip(*rows))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *made])

    return plain.mapInArrow(tag, schema).toDF(*base.columns, *made)
