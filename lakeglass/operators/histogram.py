"""Histogram layout, buckets, labels and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.numbers import number_text, percent_text
from ..functions.text import is_finite
from ..runtime import query

# Fixed value: bins of a histogram.
BINS = 10

HISTOGRAM_TYPE = "STRUCT<lo: DOUBLE, hi: DOUBLE, counts: ARRAY<BIGINT>>"


def layout_sql(ranges: str, bins: int) -> str:
    """Bins and bin width for rows of ``(ordinal, is_integer, lo, hi)``.

    Integer columns with a short span get one bin per value. Columns without a drawable range
    are left out: constant, non-finite or degenerate.
    """
    return f"""
        SELECT * FROM (
            SELECT *, IF(is_integer, (hi - lo + 1) / bins, (hi - lo) / bins) AS width FROM (
                SELECT *, IF(is_integer, CAST(least({bins}.0D, floor(hi - lo) + 1D) AS INT), {bins}) AS bins
                FROM ({ranges}) WHERE {is_finite('lo')} AND {is_finite('hi')} AND hi > lo))
        WHERE width > 0 AND {is_finite('width')} AND bins >= 2"""


def bucket_sql(x: str) -> str:
    """Bucket of ``x``; the top edge belongs to the last bucket."""
    return f"CAST(least(greatest(floor(({x} - lo) / width), 0), bins - 1) AS INT)"


def histograms_sql(values: str, x: str, layout: str, bins: int) -> str:
    """Bucket counts as ``(ordinal, histogram)`` from ``values(ordinal, n, ...)``.

    ``layout`` has one row per profiled column, so it is always safe to broadcast. Buckets are
    added up side by side, so all columns together take one exchange of one row per column.
    """
    sums = ", ".join(f"sum(IF(bucket = {b}, n, 0L))" for b in range(bins))
    return f"""
        SELECT ordinal, struct(max(lo) AS lo, max(hi) AS hi, slice(array({sums}), 1, max(bins)) AS counts) AS histogram
        FROM (SELECT /*+ BROADCAST(l) */ l.ordinal, lo, hi, bins, n, IF({is_finite(x)}, {bucket_sql(x)}, NULL) AS bucket
              FROM {values} AS v JOIN {layout} AS l ON v.ordinal = l.ordinal)
        GROUP BY ordinal"""


def _drawn_bins() -> str:
    """One row per bin of ``drawn``, with the smallest and largest value it can hold.

    All edges of a column are laid out first. A bin of whole numbers ends right before the next one begins, and the last one
    ends at the largest value.
    """
    spaced = "transform(sequence(0, bins - 1), i -> lo + i * width)"
    # rounding to a millionth keeps a whole edge whole, whatever the division left behind
    whole = f"transform({spaced}, e -> CAST(ceil(floor(e * 1e6 + 0.5) / 1e6) AS DOUBLE))"
    return f"""
        SELECT ordinal, column, is_integer, bucket, `count`, bucket = bins - 1 AS is_last, begins,
               coalesce(get(edges, bucket + 1) - IF(is_integer, 1, 0), hi) AS ends
        FROM (SELECT *, IF(is_integer, {whole}, {spaced}) AS edges
              FROM (SELECT *, IF(is_integer, hi - lo + 1, hi - lo) / bins AS width FROM drawn WHERE bins > 0))
        LATERAL VIEW OUTER posexplode(arrays_zip(counts, edges)) AS bucket, bin
        LATERAL VIEW inline(array(struct(bin.counts, bin.edges))) AS `count`, begins"""


def _label_sql() -> str:
    # A LATERAL VIEW evaluates its texts once instead of wherever they are read.
    return f"""
        SELECT *, CASE WHEN NOT is_integer THEN format_string('[%s, %s%s', from_text, to_text, IF(is_last, ']', ')'))
                       WHEN begins < ends THEN concat_ws('–', from_text, to_text) ELSE from_text END AS label
        FROM edges LATERAL VIEW inline(array(struct({number_text('begins')}, {number_text('ends')}))) AS from_text, to_text"""


def bins_of(profile: DataFrame) -> DataFrame:
    """One row per histogram bin of a profile: range label, count, share and peak flag.

    The windows run over the bins of one column, a handful of rows whatever the table size.
    Columns without a histogram drop out after the OUTER view: a condition before it would be
    pushed into one use of the profile's cells and cost a second scan.
    """
    share = "100D * `count` / sum(`count`) OVER (PARTITION BY ordinal)"
    return query(
        f"""
        WITH drawn AS (
            SELECT ordinal, column, kind = 'integer' AS is_integer, histogram.lo AS lo, histogram.hi AS hi,
                   size(histogram.counts) AS bins, histogram.counts AS counts
            FROM {{profile}}),
        edges AS (SELECT * FROM ({_drawn_bins()}) WHERE bucket IS NOT NULL),
        labelled AS ({_label_sql()}),
        shared AS (
            SELECT ordinal, column, bucket, label, `count`, {share} AS percent,
                   row_number() OVER (PARTITION BY ordinal ORDER BY `count` DESC, bucket) = 1 AS is_peak
            FROM labelled)
        SELECT ordinal, column, bucket, label, `count`, {percent_text('percent')} AS share, is_peak FROM shared""",
        profile=profile,
    )
