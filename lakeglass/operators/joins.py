"""As-of and range joins that stay exact and balanced when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions.text import INFINITY
from .profile import by_ordinal
from .table import sorted_slices


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its key at or before its time.

    Of several right rows at one instant the one with the greatest values is taken; a left row
    without a match gets NULLs. A NULL key or time matches nothing, on either side. Both sides are sorted together into
    slices by (key, time), so a frequent key spreads over many slices. Inside a slice a window carries the last right row
    forward; across slices only the last right row per slice and key is carried.
    """
    names = [c for c in left.columns if c not in (key, at)]
    l = left.select(F.col(quoted(key)).alias("k"), F.col(quoted(at)).alias("at"), *[F.col(quoted(c)).alias(f"l{i}") for i, c in enumerate(names)])
    r = right.select(F.col(quoted(key)).alias("k"), F.col(quoted(at)).alias("at"), *[F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(values)])
    own = ", ".join(f"l{i}" for i in range(len(names))) or "1 AS one"
    picked = ", ".join(f"v{i}" for i in range(len(values)))
    # Right rows of one instant are reduced first, so ties cost one row.
    events = runtime.query(
        f"""SELECT k, at, 0 AS side, max(struct({picked})) AS v, CAST(NULL AS {l.selectExpr(f'struct({own}) AS s').schema['s'].dataType.simpleString()}) AS l
            FROM {{r}} WHERE k IS NOT NULL AND at IS NOT NULL GROUP BY k, at
            UNION ALL SELECT k, at, 1, NULL, struct({own}) FROM {{l}}""",
        r=r, l=l,
    )
    placed = sorted_slices(events, ["k", "at", "side"])
    carried = ", ".join(f"IF(i.k IS NULL OR i.at IS NULL, NULL, coalesce(seen, before).v{i}) AS v{i}" for i in range(len(values)))
    kept = "".join(f", l.l{i} AS l{i}" for i in range(len(names)))
    found = runtime.query(
        f"""
        WITH ends AS (SELECT slice, k, max_by(v, position) FILTER (WHERE side = 0) AS v FROM {{p}} GROUP BY slice, k),
        carry AS (
            SELECT slice, k, last_value(v, true) OVER (PARTITION BY k ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM ends),
        inside AS (
            SELECT *, last_value(v, true) OVER (PARTITION BY slice, k ORDER BY position ROWS UNBOUNDED PRECEDING) AS seen FROM {{p}})
        SELECT i.k, i.at{kept}, {carried} FROM inside AS i LEFT JOIN carry AS c ON c.slice = i.slice AND c.k <=> i.k WHERE side = 1""",
        p=placed,
    )
    return found.toDF(key, at, *names, *values)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Doublings of the step at which spans are listed, and cells that all points fall into at least; longer spans go by the ranks of their ends.
LEVELS, CELLS = 40, 256
#: Neighbouring points of a block, and blocks of a larger block, when spans are matched by ranks.
BLOCK, RUN = 64, 16
#: Points that the largest blocks may have, since a task holds one, and least number of those.
MOST_POINTS, MOST_BLOCKS = 1 << 18, 64


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, step: float) -> DataFrame:
    """Pairs where ``start <= at < end``, found by an equality join on cells of the number line.

    A span is listed at the level whose cells, ``step`` times a power of two, are at least as long as it, so it touches
    two cells at most. A point has one cell per level that any span uses, and no pair comes twice. Spans beyond the last
    level, such as those with an infinite end, and those so long that the points would share few cells, are matched by ranks instead, as in
    ``span_overlap_join``, so no cell holds all points. NULLs and NaN match nothing.
    """
    plain_points, point_fields = by_ordinal(points)
    plain_spans, span_fields = by_ordinal(spans)
    x = next(f.ref for f in point_fields if f.name == at)
    lo, hi = (next(f.ref for f in span_fields if f.name == name) for name in (start, end))
    spans_of = plain_spans.toDF(*[f"s{c}" for c in plain_spans.columns])
    lo, hi = f"s{lo}", f"s{hi}"
    level = f"CAST(greatest(0, ceil(log2(greatest(CAST({hi} - {lo} AS DOUBLE), {step}D) / {step}D))) AS INT)"
    known = f"{x} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE))"
    finite = plain_points.where(f"{known} AND abs(CAST({x} AS DOUBLE)) < {INFINITY}")
    most = finite.selectExpr(f"CAST(floor(log2((max(CAST({x} AS DOUBLE)) / {CELLS} - min(CAST({x} AS DOUBLE)) / {CELLS}) / {step}D)) AS INT) AS level").first().level
    most = min(LEVELS, max(0, most or 0))
    sized = runtime.query(
        f"""SELECT *, IF(abs(CAST({lo} AS DOUBLE)) < {INFINITY} AND abs(CAST({hi} AS DOUBLE)) < {INFINITY}, IF({level} > {most}, {LEVELS + 1}, {level}), {LEVELS + 1}) AS level
            FROM {{s}} WHERE {lo} < {hi} AND NOT isnan(CAST({hi} AS DOUBLE))""",
        s=spans_of,
    )
    used = sorted(r.level for r in sized.select("level").distinct().collect())  # LEVELS + 2 numbers at most
    listed = runtime.query(
        f"""SELECT *, explode(array_distinct(array(CAST(floor({lo} / ({step}D * pow(2, level))) AS BIGINT), CAST(floor({hi} / ({step}D * pow(2, level))) AS BIGINT)))) AS cell
            FROM {{s}} WHERE level <= {LEVELS}""",
        s=sized,
    )
    levels = ", ".join(str(n) for n in used if n <= LEVELS)
    found = runtime.query(
        f"""
        SELECT p.* EXCEPT (level, cell), s.* EXCEPT (level, cell)
        FROM (SELECT *, CAST(floor({x} / ({step}D * pow(2, level))) AS BIGINT) AS cell
              FROM (SELECT *, explode(CAST(array({levels}) AS ARRAY<INT>)) AS level FROM {{p}} WHERE {known}) AS p) AS p
        JOIN {{s}} AS s ON p.level = s.level AND p.cell = s.cell AND p.{x} >= s.{lo} AND p.{x} < s.{hi}""",
        p=plain_points, s=listed,
    )
    if LEVELS + 1 in used:
        far = sized.where(f"level > {LEVELS}").drop("level")
        found = found.union(_ranked_join(plain_points.where(known), far, x, lo, hi, False))
    return found.toDF(*points.columns, *spans.columns)


def _ranked_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, beyond_start: bool) -> DataFrame:
    """Pairs where ``lo <= at < hi``, or ``lo < at < hi`` if ``beyond_start``; no column may be NULL or NaN, no name may be on both sides.

    Points and both ends of all spans are sorted together into slices, and counting the points gives each end its rank. A
    span then matches the points of a range of ranks. That range is cut into blocks, into as few as there are: large ones inside, smaller ones
    towards its ends, of which only the outermost two are not matched whole. So the rows before the join are few for each span, however many points it
    has, and pairs looked at are bounded by the result and ``BLOCK``. A point has a row for each size of blocks that the longest range may hold. A task
    holds the points of a block, never the spans. Spark takes the blocks for as few as the spans they come from, so the
    join is told to shuffle them: broadcast, all blocks of all spans would go through the driver.
    """
    own = ", ".join(f"`{c}`" for c in points.columns)
    theirs = ", ".join(f"`{c}`" for c in spans.columns)
    whole = f"CAST(NULL AS {points.selectExpr(f'struct({own}) AS p').schema['p'].dataType.simpleString()})"
    # Of rows at one place, ends come first, then starts, then points; starts that exclude their own place come last.
    events = runtime.query(
        f"""SELECT {at} AS place, 2 AS turn, struct({own}) AS p, NULL AS s, NULL AS id FROM {{p}}
            UNION ALL
            SELECT end.place, end.turn, {whole}, IF(end.turn = 0, NULL, s), id FROM (
                SELECT explode(array(struct({lo} AS place, {3 if beyond_start else 1} AS turn), struct({hi} AS place, 0 AS turn))) AS end, struct({theirs}) AS s, id
                FROM (SELECT *, monotonically_increasing_id() AS id FROM {{s}}))""",
        p=points, s=spans,
    )
    with runtime.shuffles_dropped(points.sparkSession):
        placed = sorted_slices(events, ["place", "turn"])
    ranked = runtime.query(
        """
        WITH sizes AS (SELECT slice, coalesce(sum(n) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before
                       FROM (SELECT slice, count_if(turn = 2) AS n FROM {e} GROUP BY slice))
        SELECT /*+ BROADCAST(z) */ p, s, id, turn, before + count_if(turn = 2) OVER (PARTITION BY e.slice ORDER BY position ROWS UNBOUNDED PRECEDING) AS rank
        FROM {e} AS e JOIN sizes AS z ON e.slice = z.slice""",
        e=placed,
    )
    with runtime.shuffles_dropped(points.sparkSession):
        ranges = runtime.materialize(runtime.query(
            """SELECT * FROM (SELECT max(s) AS s, min(rank) FILTER (WHERE turn <> 0) AS a, min(rank) FILTER (WHERE turn = 0) AS b FROM {spans} WHERE turn <> 2 GROUP BY id)
               WHERE a < b""", spans=ranked), "ranges")
        most = ranges.selectExpr("coalesce(max(b), 0L) AS points", "coalesce(max(b - a), 0L) AS longest").first()
    blocks = runtime.query(
        """SELECT * EXCEPT (piece), piece.level, explode(sequence(piece.first, piece.end - 1)) AS block
           FROM (SELECT *, explode({pieces}) AS piece FROM {ranges}) WHERE piece.first < piece.end""".replace("{pieces}", _pieces(most.points)),
        ranges=ranges)
    # an outermost block may lie in the range but for one point, so the longest range may hold blocks that are a little longer
    sizes = ", ".join(f"struct({n} AS level, {BLOCK * RUN**n}L AS size)" for n in range(_levels(most.points)) if n == 0 or BLOCK * RUN**n < most.longest + 2 * BLOCK)
    return runtime.query(
        f"""
        WITH places AS (SELECT p.*, rank - 1 AS rank, level, (rank - 1) DIV size AS block FROM {{points}} LATERAL VIEW inline(array({sizes})) AS level, size WHERE turn = 2),
        blocks AS (SELECT s.*, a, b, level, block FROM {{blocks}})
        SELECT /*+ MERGE(places, blocks) */ {own}, {theirs} FROM blocks JOIN places ON blocks.block = places.block AND blocks.level = places.level AND rank >= a AND rank < b""",
        points=ranked, blocks=blocks,
    )


def _levels(points: int) -> int:
    """Sizes of blocks for so many points."""
    levels = 1
    while RUN > 1 and BLOCK * RUN**levels <= min(MOST_POINTS, points // MOST_BLOCKS):
        levels += 1
    return levels


def _pieces(points: int) -> str:
    """SQL text of an array of ``level, first, end``: blocks of ``BLOCK * RUN**level`` points that make up the ranks from ``a`` to before ``b``, with less than a block on either side."""
    levels = _levels(points)
    first = [f"(a DIV {BLOCK} + {RUN**n - 1}) DIV {RUN**n}" for n in range(levels)]
    end = [f"((b - 1) DIV {BLOCK} + 1) DIV {RUN**n}" for n in range(levels)]
    out = [f"struct({levels - 1} AS level, {first[-1]} AS first, {end[-1]} AS end)"]
    for n in range(levels - 1):
        inside = f"{first[n + 1]} < {end[n + 1]}"
        out.append(f"struct({n} AS level, {first[n]} AS first, IF({inside}, {first[n + 1]} * {RUN}, {end[n]}) AS end)")
        out.append(f"struct({n} AS level, IF({inside}, {end[n + 1]} * {RUN}, {end[n]}) AS first, {end[n]} AS end)")
    return f"array({', '.join(out)})"


def span_overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, right_start: str | None = None, right_end: str | None = None) -> DataFrame:
    """Pairs of spans that share a place: ``left.start < right.end AND right.start < left.end``; ends are exclusive.

    Two spans overlap if one begins within the other, so this is two joins of starts with spans, which by the rank of the
    ends need no key that long spans share and no step. Empty spans, and those with a NULL or NaN end, overlap nothing. Any
    type that sorts will do; infinite ends are ends like others.
    """
    plain_left, left_fields = by_ordinal(left)
    plain_right, right_fields = by_ordinal(right)
    l, r = plain_left.toDF(*[f"l{c}" for c in plain_left.columns]), plain_right.toDF(*[f"r{c}" for c in plain_right.columns])
    a, b = (next(f"l{f.ref}" for f in left_fields if f.name == n) for n in (start, end))
    c, d = (next(f"r{f.ref}" for f in right_fields if f.name == n) for n in (right_start or start, right_end or end))
    l, r = (side.where(f"{x} < {y}" + "".join(f" AND NOT isnan({e})" for e in (x, y) if dict(side.dtypes)[e] in ("double", "float")))
            for side, x, y in ((l, a, b), (r, c, d)))
    right_begins = _ranked_join(r, l, c, a, b, False).select(*l.columns, *r.columns)
    left_begins = _ranked_join(l, r, a, c, d, True).select(*l.columns, *r.columns)
    return right_begins.union(left_begins).toDF(*left.columns, *right.columns)
