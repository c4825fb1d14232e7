"""Rolling (RANGE) windows per key that stay parallel under key skew.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task:
if one user owns a third of all rows, a third of the data is sorted and
scanned by a single core.  Here the partition is (key, time bucket) instead.
A row's frame ``[t - length, t]`` can only reach back into the previous
bucket when buckets are at least ``length`` wide, so rows in the last
``length`` of a bucket are also sent, as *context only*, to the next bucket.
Context rows feed the frames of that bucket's rows but are not emitted.  The
result is exact; the extra shuffle volume is ``length / bucket`` of the input
(25 % with the default bucket of 4 x length).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from tierline.functions import epoch_us

US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def duration_us(n: float, unit: str) -> int:
    return int(n * US[unit.rstrip("s")])


def rolling(df: DataFrame, keys: Sequence[str], ts: str,
            columns: Callable[[Callable[[int], WindowSpec]], list[Column]],
            max_length_us: int, bucket_us: int | None = None) -> DataFrame:
    """Add rolling-window columns computed over ``[t - L, t]`` per key.

    ``columns(frame)`` returns the new columns; ``frame(L)`` gives the
    window spec for a frame of length ``L`` microseconds (``L`` must be at
    most ``max_length_us``).  Ties in ``ts`` are peers (RANGE semantics), as
    in SQL ``RANGE BETWEEN INTERVAL ... PRECEDING AND CURRENT ROW``.
    """
    bucket_us = bucket_us or 4 * max_length_us
    if bucket_us < max_length_us:
        raise ValueError("bucket must be at least as wide as the longest frame")
    t = epoch_us(ts)
    staged = (df.withColumn("_t", t)
                .withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)).cast("bigint")))
    # 0 = own bucket, 1 = context copy for the next bucket (only near the edge)
    near_edge = F.col("_t") >= (F.col("_b") + 1) * F.lit(bucket_us) - F.lit(max_length_us)
    staged = staged.withColumn(
        "_shift", F.explode(F.when(near_edge, F.array(F.lit(0), F.lit(1)))
                            .otherwise(F.array(F.lit(0)))))
    staged = staged.withColumn("_b", F.col("_b") + F.col("_shift"))
    base = Window.partitionBy(*keys, "_b").orderBy("_t")

    def frame(length_us: int) -> WindowSpec:
        if length_us > max_length_us:
            raise ValueError("frame longer than max_length_us")
        return base.rangeBetween(-length_us, 0)

    out = staged.select("*", *columns(frame))
    return out.filter(F.col("_shift") == 0).drop("_t", "_b", "_shift")


def exact_sum(col: str | Column, scale: int = 2, precision: int = 18) -> Column:
    """Sum-ready decimal cast: decimal sums are exact, so rolling sums do not
    depend on the order rows are added in (doubles would)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(f"decimal({precision},{scale})")


# --- linear-time rolling frames ---------------------------------------------------
#
# Spark evaluates ``RANGE BETWEEN n PRECEDING AND CURRENT ROW`` by
# re-aggregating the whole frame buffer whenever the frame moves, so a key
# with f rows per frame costs rows x f -- quadratic for a dense hot key.
# Running frames (UNBOUNDED PRECEDING) are incremental.  ``rolling_frames``
# builds every ``[t - L, t]`` frame from running frames only.  A chain of windows holds
# a sort per ordering in one task, so all lengths share one ordering and its reverse.

_PIECE_UNITS = (US["day"], US["hour"])


def default_pieces(length_us: int) -> int:
    """Pieces of the largest whole unit (day, hour) giving at least 4 of
    them: 30 d -> 30 days, 24 h -> 24 hours; frames under a few hours are one
    piece.  Few pieces keep the whole-bucket frame short (at most p - 1
    bucket rows); the piece width bounds how much of one key a task sees."""
    for u in _PIECE_UNITS:
        if length_us % u == 0 and length_us // u >= 4:
            return length_us // u
    return 1


def _floor_div(c: Column, w: int) -> Column:
    # exact integer floor division, also for times before 1970
    return ((c - F.pmod(c, F.lit(w))) / F.lit(w)).cast("bigint")


_AGG = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def _exact_type(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (DecimalType, IntegralType))


def rolling_frames(df: DataFrame, keys: Sequence[str], ts: str,
                   aggs: Sequence[tuple[str, str | None, str, int]],
                   pieces: dict[int, int] | None = None, rows_per_task: int = 500_000) -> DataFrame:
    """Exact ``RANGE [t - L, t]`` count / sum / min / max per key, for any
    number of frame lengths, in linear time and without single-key tasks.

    ``aggs``: (function, input column or None for COUNT(*), output name,
    length in microseconds); function in count / sum / min / max, ``count``
    counts non-NULL inputs.  Ties in ``ts`` are peers (RANGE semantics).

    Each row is emitted once more per length as a *ghost* at t + L (not where all
    inputs of that length are NULL).  Rows and ghosts share one hash shuffle on
    (key, coarse bucket), so a hot key is spread over span / coarse-bucket tasks.

    Counts and exact sums are a running sum over the bucket: rows up to t, less
    ghosts before t, plus the frame at the bucket's start.  The latter comes from
    totals per (key, bucket) of rows and ghosts, summed along the key.

    For min / max a frame is cut into p pieces of width w = L / p, w dividing the
    coarse bucket: the row's own piece up to t, whole pieces between, and ghosts of
    its piece from t on.  Prefixes and suffixes of pieces are running maxima of
    (piece, value), so pieces of all lengths share the bucket's sort; whole pieces
    come from a RANGE frame over at most p - 1 rows of per-piece totals.  Sums of
    floating-point columns, where a difference of running sums would lose digits, are
    cut into pieces too, each length with a sort of its own.

    Totals are added as tagged rows, so nothing is joined back.  The rows are
    counted first: shuffles have a partition per ``rows_per_task`` rows and ghosts, so
    that a task's sorts stay as large whatever the input's size.  They are two, one
    forward and, for min / max, one backward.
    """
    if not aggs:
        return df
    for fn, *_ in aggs:
        if fn not in _AGG:
            raise ValueError(f"unsupported rolling function {fn}")
    # a frame's SUM is NULL exactly when it holds no non-NULL input: carry a
    # hidden non-NULL count next to every sum
    out_names = [a[2] for a in aggs]
    aggs = list(aggs) + [("count", c, f"_nn_{name}", ln) for fn, c, name, ln in aggs if fn == "sum"]
    pieces = dict(pieces or {})
    lengths = sorted({a[3] for a in aggs})
    widths = []
    for length in lengths:
        p = pieces.get(length) or default_pieces(length)
        if length <= 0 or length % p:
            raise ValueError(f"length {length} must be a positive multiple of its pieces {p}")
        widths.append(length // p)
    coarse = math.lcm(*widths)
    # the widest pieces that both the frame and the bucket are made of
    spec = [(j, length, length // math.gcd(length, coarse), math.gcd(length, coarse)) for j, length in enumerate(lengths)]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() * (1 + len(spec)) / rows_per_task))

    base = df.withColumn("_t", epoch_us(ts))
    ins = sorted({c for _, c, _, _ in aggs if c is not None and c not in keys})
    rest = [c for c in df.columns if c not in ins and c not in keys]

    def value(c):
        return F.lit(1) if c is None else F.col(c)

    # running sums serve these (function, input) pairs, pieces the others
    summed = {(fn, c) for fn, c, _, _ in aggs if fn == "count" or fn == "sum" and _exact_type(df, c)}
    wide = [(j, length, p, w) for j, length, p, w in spec
            if p > 1 and any(ln == length and (fn, c) not in summed for fn, c, _, ln in aggs)]
    run = sorted({(fn, c, ln) for fn, c, _, ln in aggs if (fn, c) in summed}, key=str)
    mid = sorted({(fn, c, ln) for fn, c, _, ln in aggs if (fn, c) not in summed and ln in {x[1] for x in wide}}, key=str)
    at = {length: j for j, length, *_ in spec}

    # one scan gives the rows and their ghosts (a ghost keeps the inputs only; a row
    # without a time has none: its frame is its peers)
    def felt(length):
        cs = {c for _, c, _, ln in aggs if ln == length}
        return F.lit(True) if None in cs else F.greatest(F.lit(False), *[F.col(c).isNotNull() for c in sorted(cs)])

    tags = F.array_compact(F.array(F.struct(F.lit(0).alias("g"), F.col("_t").alias("t")), *[
        F.when(F.col("_t").isNotNull() & felt(length),
               F.struct(F.lit(j + 1).alias("g"), (F.col("_t") + F.lit(length)).alias("t"))) for j, length, _, _ in spec]))
    spread = base.withColumn("_tag", F.explode(tags))
    whole_row = [F.when(F.col("_tag.g") == 0, F.struct(*rest)).alias("_row")] if rest else []
    u = spread.select(*keys, F.col("_tag.t").alias("_t"), F.col("_tag.g").alias("_g"), *ins, *whole_row)

    # the second scan: totals per key and bucket, their sums along the key
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    finest = math.gcd(coarse, *[w for *_, w in wide])
    named = {(fn, c): f"_f{i}" for i, (fn, c) in enumerate(sorted({(fn, c) for fn, c, _ in run + mid}, key=str))}
    ends = {j: f"_end{j}" for j in sorted({at[ln] for _, _, ln in run})}
    fine = base.filter("_t IS NOT NULL") \
        .groupBy(*keys, _floor_div(F.col("_t"), finest).alias("_fb"),
                 *[_floor_div(F.col("_t") + F.lit(lengths[j]), coarse).alias(b) for j, b in ends.items()]) \
        .agg(*[_AGG[fn](value(c)).alias(n) for (fn, c), n in named.items()])
    start = F.col("_fb") * F.lit(finest)
    home = _floor_div(start, coarse)
    # kind 0: bucket totals, where the row (j = -1) or its ghost of length j is; kind j + 1: pieces of length j
    kinds = [(0, -1, home * F.lit(coarse))] if run else []
    kinds += [(0, j, F.when(F.col(b) != home, F.col(b) * F.lit(coarse))) for j, b in ends.items()]
    kinds += [(j + 1, j, start - F.pmod(start, F.lit(w))) for j, _, _, w in wide]
    tagged_by = fine.withColumn("_tag", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), x.alias("t")) for k, j, x in kinds]))) \
        .filter("_tag.t IS NOT NULL").repartition(parts, *keys)
    of = F.col("_tag.j")
    sums = []
    for i, (fn, c, ln) in enumerate(run):
        n, b = F.col(named[fn, c]), F.col(ends[at[ln]])
        sums.append(F.sum(F.when((F.col("_tag.k") == 0) & (of == -1) & (b != home), n)
                          .when((F.col("_tag.k") == 0) & (of == at[ln]), -n)).alias(f"_d{i}"))
    sums += [merge[fn](F.when(F.col("_tag.k") > 0, F.col(named[fn, c]))).alias(f"_m_{named[fn, c]}")
             for fn, c in sorted({(fn, c) for fn, c, _ in mid}, key=str)]
    per_bucket = tagged_by.groupBy(*keys, F.col("_tag.k").alias("_k"), F.col("_tag.t").alias("_t")).agg(*sums)
    along = Window.partitionBy(*keys, "_k").orderBy("_t")
    fields = []
    for i, (fn, c, ln) in enumerate(run):
        opened = F.coalesce(F.sum(f"_d{i}").over(along.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if fn == "sum" and isinstance(df.schema[c].dataType, DecimalType):
            kind = df.schema[c].dataType
            opened = opened.cast(DecimalType(min(38, kind.precision + 10), kind.scale))
        fields.append(F.when(F.col("_k") == 0, opened).alias(f"r{i}"))
    for i, (fn, c, ln) in enumerate(mid):
        j, _, p, w = spec[at[ln]]
        fields.append(F.when(F.col("_k") == j + 1, merge[fn](f"_m_{named[fn, c]}").over(
            along.rangeBetween(-(p - 1) * w, -w))).alias(f"m{i}"))
    if fields:
        totals = per_bucket.select(*keys, "_t", (-1 - F.col("_k")).alias("_g"), F.struct(*fields).alias("_tot"))
        u = u.unionByName(totals, allowMissingColumns=True)
    # one shuffle: every window below is partitioned by a refinement of it
    u = u.withColumn("_B", _floor_div(F.col("_t"), coarse)).repartition(parts, *keys, "_B")

    bucket = Window.partitionBy(*keys, "_B")
    upto = bucket.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = bucket.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    down = bucket.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def tagged(g, x):
        return F.when(F.col("_g") == g, x)

    def piece(w):
        return _floor_div(F.col("_t"), w)

    def ranked(fn, place, c):
        # the extreme of these is the best value of the last place; a NULL value loses
        if fn == "max":
            return F.struct(place.alias("b"), F.col(c).alias("v"))
        return F.struct((-place).alias("b"), F.col(c).isNull().alias("n"), F.col(c).alias("v"))

    extremes = sorted({(fn, c, ln) for fn, c, _, ln in aggs if fn in ("min", "max")}, key=str)
    back, on = {}, {}
    for i, (fn, c, ln) in enumerate(extremes):
        j, _, p, w = spec[at[ln]]
        back[f"_h{i}"] = _AGG[fn](tagged(j + 1, ranked(fn, -piece(w), c))).over(down)
        on[f"_p{i}"] = _AGG[fn](tagged(0, ranked(fn, piece(w), c))).over(upto)
    for i, (fn, c) in enumerate(sorted({(fn, c) for fn, c, _ in run}, key=str)):
        on[f"_r_{named[fn, c]}"] = _AGG[fn](tagged(0, value(c))).over(upto)
    for i, (fn, c, ln) in enumerate(run):
        on[f"_g{i}"] = _AGG[fn](tagged(at[ln] + 1, value(c))).over(before)
        on[f"_o{i}"] = F.max(F.col(f"_tot.r{i}")).over(upto)
    for i, (fn, c, ln) in enumerate(mid):
        j, _, p, w = spec[at[ln]]
        # all of a piece's rows carry the same total, so the greatest (piece, total) is its
        on[f"_q{i}"] = F.max(tagged(-2 - j, F.struct(piece(w).alias("b"), F.col(f"_tot.m{i}").alias("v")))).over(upto)
    parted = [(fn, c, ln) for fn, c, _, ln in aggs if fn == "sum" and (fn, c) not in summed]
    for i, (fn, c, ln) in enumerate(parted):
        j, _, p, w = spec[at[ln]]
        own = Window.partitionBy(*keys, "_B", f"_b{j}").orderBy("_t")
        u = u.withColumn(f"_b{j}", piece(w))
        ghosts = F.sum(tagged(j + 1, F.col(c)))
        on[f"_s{i}"] = F.sum(tagged(0, F.col(c))).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        on[f"_t{i}"] = ghosts.over(own.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)) \
            - F.coalesce(ghosts.over(own.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if back:
        u = u.select("*", *[x.alias(n) for n, x in back.items()])
    u = u.select("*", *[x.alias(n) for n, x in on.items()]).filter(F.col("_g") == 0)

    zero, cols = F.lit(0), {}
    for fn, c, name, ln in aggs:
        j, _, p, w = spec[at[ln]]
        between = F.col(f"_q{mid.index((fn, c, ln))}.v") if (fn, c, ln) in mid else None
        if (fn, c) in summed:
            i = run.index((fn, c, ln))
            got = F.coalesce(F.col(f"_r_{named[fn, c]}"), zero) - F.coalesce(F.col(f"_g{i}"), zero) + F.coalesce(F.col(f"_o{i}"), zero)
            cols[name] = got.cast("bigint") if fn == "count" else got
        elif fn == "sum":
            i = parted.index((fn, c, ln))
            cols[name] = sum((F.coalesce(v, zero) for v in (F.col(f"_t{i}"), *([between] if between is not None else []))),
                             F.coalesce(F.col(f"_s{i}"), zero))
        else:
            i = extremes.index((fn, c, ln))
            here = piece(w) if fn == "min" else -piece(w)
            ahead = F.when(F.col(f"_h{i}.b") == here, F.col(f"_h{i}.v"))
            cols[name] = (F.greatest if fn == "max" else F.least)(
                F.col(f"_p{i}.v"), ahead, between if between is not None else F.lit(None))
    for fn, _, name, _ in aggs:
        if fn == "sum":
            cols[name] = F.when(cols[f"_nn_{name}"] == 0, F.lit(None)).otherwise(cols[name])
    return u.select(*[F.col(f"_row.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns],
                    *[cols[n].alias(n) for n in out_names])


def rolling_distinct_count(df: DataFrame, keys: Sequence[str], ts: str, value: str, length_us: int,
                           out: str) -> DataFrame:
    """Exact number of distinct non-NULL ``value`` in ``RANGE [t - L, t]`` per key, in
    linear time.

    A value counts at every time from one of its rows until L after it.  Its rows
    are first reduced to (first, last) per stretch of length L (map-side combine; no
    gap within one), stretches closer than L are one interval, and an interval is
    +1 where it starts and -1 just after it ends.  The count at a row is the running
    sum of these changes: summed per (key, day), offset by the days before, and run
    within the day, so a hot key is spread over its days and no frame is ever
    collected.  Rows without a time are one another's peers, as in SQL.
    """
    day = US["day"]
    rows = df.withColumn("_t", epoch_us(ts))
    timed = rows.filter("_t IS NOT NULL")
    seen = timed.filter(F.col(value).isNotNull()).groupBy(*keys, value, _floor_div(F.col("_t"), length_us).alias("_s")) \
        .agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    per_value = Window.partitionBy(*keys, value).orderBy("_s")
    gap = lambda other: F.coalesce(other, F.lit(False))
    joined_before = gap(F.col("_lo") - F.lag("_hi").over(per_value) <= length_us)
    joined_after = gap(F.lead("_lo").over(per_value) - F.col("_hi") <= length_us)
    # within a stretch of length L no gap exceeds L, so only its two ends can be changes
    ends = seen.select(*keys, F.when(~joined_before, F.col("_lo")).alias("_up"),
                       F.when(~joined_after, F.col("_hi") + F.lit(length_us + 1)).alias("_down"))
    changes = ends.select(*keys, F.explode(F.array(
        F.struct(F.col("_up").alias("t"), F.lit(1).alias("d")),
        F.struct(F.col("_down").alias("t"), F.lit(-1).alias("d")))).alias("c")) \
        .filter("c.t IS NOT NULL").groupBy(*keys, F.col("c.t").alias("_t")).agg(F.sum("c.d").alias("_d"))
    changes = changes.withColumn("_day", _floor_div(F.col("_t"), day))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = changes.groupBy(*keys, "_day").agg(F.sum("_d").alias("_sum")) \
        .unionByName(timed.select(*keys, _floor_div(F.col("_t"), day).alias("_day"), F.lit(0).cast("bigint").alias("_sum"))
                     .distinct())
    days = days.groupBy(*keys, "_day").agg(F.sum("_sum").alias("_sum"))
    offsets = days.withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0))) \
        .select(*keys, (F.col("_day") * F.lit(day)).alias("_t"), F.col("_off").alias("_d"), "_day")
    tagged = timed.withColumn("_day", _floor_div(F.col("_t"), day)).withColumn("_row", F.lit(True))
    u = tagged.unionByName(changes, allowMissingColumns=True).unionByName(offsets, allowMissingColumns=True)
    run = Window.partitionBy(*keys, "_day").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = u.withColumn(out, F.coalesce(F.sum("_d").over(run), F.lit(0)).cast("int")).filter("_row") \
        .select(*df.columns, out)
    peers = rows.filter("_t IS NULL")
    same = peers.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v")) \
        .groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.countDistinct("_v").cast("int").alias(out))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return counted.unionByName(peers.join(same, match).select(*df.columns, out))
