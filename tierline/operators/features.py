"""Feature views, point-in-time joins, latest values, feature services.

A feature view is metadata over a DataFrame (no copy): entity key columns,
an event timestamp, an optional created timestamp, typed features and a TTL.

Point-in-time rule (our contract): for each entity row at time T and each
view, take the feature row of the same key with the greatest event time
``<= T`` (ties: greatest created time, then greatest feature values); if its
event time is older than ``T - ttl`` the features are NULL.  Entity rows are
never dropped or duplicated; NULL keys never match.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.functions import epoch_us

# Declared feature dtypes and their Spark types.
DTYPES = {
    "int32": "int", "int64": "bigint", "float32": "float", "float64": "double",
    "string": "string", "bytes": "binary", "bool": "boolean",
    "unix_timestamp": "timestamp_ntz",
    "array_int32": "array<int>", "array_int64": "array<bigint>",
    "array_float32": "array<float>", "array_float64": "array<double>",
    "array_string": "array<string>",
}
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class FeatureView:
    name: str
    source: DataFrame
    entities: tuple[str, ...]
    features: tuple[tuple[str, str], ...]          # (name, dtype)
    timestamp_field: str = "event_timestamp"
    created_timestamp_column: str | None = None
    ttl_seconds: int | None = 86_400
    tags: dict = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        return [n for n, _ in self.features]

    def frame(self) -> DataFrame:
        """Keys, timestamps and features cast to the declared types (lazy); a value
        that does not fit its type becomes NULL."""
        cols = [F.col(k) for k in self.entities]
        cols.append(F.col(self.timestamp_field).cast("timestamp_ntz").alias(self.timestamp_field))
        if self.created_timestamp_column:
            c = self.created_timestamp_column
            cols.append(F.col(c).cast("timestamp_ntz").alias(c))
        for n, dt in self.features:
            src = F.col(n)
            if dt == "unix_timestamp":
                src = F.when(F.col(n).cast("string").rlike(r"^-?\d+$"),
                             F.timestamp_seconds(F.col(n).try_cast("bigint")).cast("timestamp_ntz")) \
                       .otherwise(F.col(n).try_cast("timestamp_ntz"))
                cols.append(src.alias(n))
            else:
                cols.append(src.try_cast(DTYPES[dt]).alias(n))
        return self.source.select(*cols)


def define_feature_view(name: str, source: DataFrame, entities: Sequence[str],
                        features: Sequence[tuple[str, str]],
                        timestamp_field: str = "event_timestamp",
                        created_timestamp_column: str | None = None,
                        ttl_seconds: int | None = 86_400, tags: dict | None = None) -> FeatureView:
    """Validate and build a view: name pattern, columns present, known
    dtypes, ttl > 0 (None = no expiry)."""
    if not _NAME.match(name):
        raise ValueError(f"invalid feature view name {name!r}")
    if ttl_seconds is not None and ttl_seconds <= 0:
        raise ValueError("ttl must be positive")
    have = set(source.columns)
    need = list(entities) + [timestamp_field] + [n for n, _ in features]
    if created_timestamp_column:
        need.append(created_timestamp_column)
    missing = [c for c in need if c not in have]
    if missing:
        raise ValueError(f"columns not in source: {missing}")
    bad = [d for _, d in features if d not in DTYPES]
    if bad:
        raise ValueError(f"unknown dtypes: {bad}")
    if not entities:
        raise ValueError("a feature view needs at least one entity key")
    return FeatureView(name, source, tuple(entities), tuple((n, d) for n, d in features),
                       timestamp_field, created_timestamp_column, ttl_seconds, dict(tags or {}))


def _out_names(view: FeatureView, names: Sequence[str], full: bool) -> list[str]:
    return [f"{view.name}__{n}" if full else n for n in names]


def _chosen(view: FeatureView, features: Sequence[str] | None) -> list[str]:
    names = list(features) if features is not None else view.feature_names
    unknown = [n for n in names if n not in view.feature_names]
    if unknown:
        raise ValueError(f"{view.name} has no features {unknown}")
    return names


def point_in_time_join(entity_df: DataFrame, view: FeatureView, entity_ts: str,
                       features: Sequence[str] | None = None,
                       full_feature_names: bool = False,
                       bucket_us: int = DAY_US, copy_factor: int = 4) -> DataFrame:
    """As-of (backward) join of one feature view onto entity rows."""
    return get_historical_features(entity_df, [(view, features)], entity_ts, full_feature_names, bucket_us, copy_factor)


def get_historical_features(entity_df: DataFrame,
                            refs: Sequence[tuple[FeatureView, Sequence[str] | None]],
                            entity_ts: str, full_feature_names: bool = False,
                            bucket_us: int = DAY_US, copy_factor: int = 4) -> DataFrame:
    """Feature service: the point-in-time values of several views on entity rows.

    Views with the same keys are joined in one pass, so the entity rows cross the
    network once per distinct set of keys, however many views there are."""
    groups: dict[tuple, list] = {}
    columns, taken = [], set(entity_df.columns)
    for view, feats in refs:
        names = _chosen(view, feats)
        outs = _out_names(view, names, full_feature_names)
        clash = [o for o in outs if o in taken]
        if clash:
            raise ValueError(f"feature names clash with entity columns {clash}; use full_feature_names=True")
        taken.update(outs)
        columns += outs
        groups.setdefault(view.entities, []).append((view, names, outs))
    out = entity_df
    for keys, views in groups.items():
        out = _as_of(out, list(keys), views, entity_ts, bucket_us, copy_factor)
    return out.select(*entity_df.columns, *columns)


def _as_of(entity_df: DataFrame, keys: list[str], views: list[tuple[FeatureView, list[str], list[str]]],
           entity_ts: str, bucket_us: int, copy_factor: int) -> DataFrame:
    """Entity rows with the values of some views of equal keys.

    Entity rows and the feature rows of all views, each view's in a column of its own,
    are unioned and partitioned by (key, time bucket); inside a bucket a running
    ``last(..., ignoreNulls)`` per view over (time, feature-before-entity, created,
    values) gives every entity row the newest feature row at or before it.  Buckets are
    several times as wide as the longest TTL, and feature rows in the last TTL of a
    bucket are also placed in the next one, so this single shuffle is exact.  For views
    without a TTL, entity rows whose bucket has no earlier row take the newest row of an
    earlier bucket of the same key from a per-(key, bucket) summary.  No row pairs are
    formed and a hot key is spread over its time buckets.  Entity rows with a NULL key
    or time match nothing and go round the window.
    """
    missing = [k for k in keys if k not in entity_df.columns]
    if missing:
        raise ValueError(f"entity frame lacks key columns {missing}")
    ecols = entity_df.columns
    key_ok = F.lit(True)
    for k in keys:
        key_ok = key_ok & F.col(k).isNotNull()
    ttl = [int(v.ttl_seconds) * 1_000_000 if v.ttl_seconds is not None else None for v, _, _ in views]
    # buckets >= copy_factor * ttl wide: at most 1/copy_factor of the feature
    # rows are copied into the following bucket
    width = max([bucket_us, *(copy_factor * x for x in ttl if x is not None)])
    bucket = F.floor(F.col("_t") / F.lit(width)).cast("bigint")
    marks = [f"_f{i}" for i in range(len(views))]
    usable = key_ok & F.col(entity_ts).isNotNull()
    ent = entity_df.filter(usable).select(*keys, epoch_us(entity_ts).alias("_t"), F.lit(1).alias("_kind"),
                                          F.struct(*ecols).alias("_e")).withColumn("_b", bucket)
    rows, open_rows = ent, None
    for i, (view, names, _) in enumerate(views):
        created = epoch_us(view.created_timestamp_column) if view.created_timestamp_column else F.lit(0).cast("bigint")
        t = epoch_us(view.timestamp_field)
        feat = view.frame().filter(key_ok & F.col(view.timestamp_field).isNotNull()).select(
            *keys, t.alias("_t"), F.lit(0).alias("_kind"),
            F.struct(t.alias("t"), created.alias("c"), F.struct(*names).alias("v")).alias(marks[i])).withColumn("_b", bucket)
        if ttl[i] is None:
            open_rows = feat.drop("_kind", "_t") if open_rows is None else \
                open_rows.unionByName(feat.drop("_kind", "_t"), allowMissingColumns=True)
        else:
            # a match lies within ttl <= width of the entity time, so only the last ttl
            # of the previous bucket can matter: those rows are copied forward
            edge = F.col("_t") >= (F.col("_b") + 1) * F.lit(width) - F.lit(ttl[i])
            feat = feat.withColumn("_b", F.explode(F.when(edge, F.array(F.col("_b"), F.col("_b") + 1))
                                                   .otherwise(F.array(F.col("_b")))))
        rows = rows.unionByName(feat, allowMissingColumns=True)

    running = Window.partitionBy(*keys, "_b").orderBy("_t", "_kind", *marks) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("*", *[F.last(f, ignorenulls=True).over(running).alias(f"_m{f}") for f in marks]) \
        .filter(F.col("_kind") == 1)

    without = [f for f, x in zip(marks, ttl) if x is None]
    if without:
        # the newest row of any earlier bucket of the key, from one row per (key, bucket)
        per_bucket = open_rows.groupBy(*keys, "_b").agg(*[F.max(f).alias(f) for f in without]).withColumn("_kind", F.lit(1))
        ent_buckets = ent.select(*keys, "_b").distinct().withColumn("_kind", F.lit(0))
        w_carry = Window.partitionBy(*keys).orderBy("_b", "_kind") \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carry = ent_buckets.unionByName(per_bucket, allowMissingColumns=True) \
            .select(*keys, "_b", "_kind", *[F.last(f, ignorenulls=True).over(w_carry).alias(f"_c{f}") for f in without]) \
            .filter(F.col("_kind") == 0).drop("_kind")
        found = found.join(carry, keys + ["_b"], "left")
    values = []
    for f, x, (_, names, outs) in zip(marks, ttl, views):
        m = F.coalesce(F.col(f"_m{f}"), F.col(f"_c{f}")) if x is None else \
            F.when(F.col(f"_m{f}.t") >= F.col("_t") - F.lit(x), F.col(f"_m{f}"))
        values += [m.getField("v").getField(n).alias(o) for n, o in zip(names, outs)]
    matched = found.select(*[F.col("_e").getField(c).alias(c) for c in ecols], *values)
    fields = {f.name: f.dataType for f in matched.schema.fields}
    unmatched = entity_df.filter(~usable).select(*ecols, *[F.lit(None).cast(fields[o]).alias(o)
                                                           for _, _, outs in views for o in outs])
    return matched.unionByName(unmatched)


def resolve_refs(views: dict[str, FeatureView], refs: Sequence[str]):
    """'view:feature' / 'view' strings -> [(view, features)], unknown = error."""
    grouped: dict[str, list[str] | None] = {}
    for r in refs:
        vname, _, feat = r.partition(":")
        if vname not in views:
            raise KeyError(f"unknown feature view {vname!r}")
        if not feat:
            grouped[vname] = None
        elif grouped.get(vname, []) is not None:
            grouped.setdefault(vname, []).append(feat)
    return [(views[v], f) for v, f in grouped.items()]


def latest_features(view: FeatureView, as_of: str, features: Sequence[str] | None = None) -> DataFrame:
    """Newest row per key at ``as_of`` ("online" values), TTL-checked.

    ``max(struct(t, created, values))`` grouped by key: a partial aggregate,
    so even a hot key is reduced to one row per task before the shuffle.
    Keys whose newest row is older than the TTL are kept with NULL features.
    """
    keys = list(view.entities)
    names = list(features) if features is not None else view.feature_names
    fv = view.frame()
    ts = F.col(view.timestamp_field)
    created = (F.col(view.created_timestamp_column) if view.created_timestamp_column
               else F.lit(None).cast("timestamp_ntz"))
    asof = F.lit(as_of).cast("timestamp_ntz")
    best = (fv.filter(ts <= asof)
              .groupBy(*keys)
              .agg(F.max(F.struct(ts.alias("t"), created.alias("c"),
                                  F.struct(*[F.col(n) for n in names]).alias("v"))).alias("_m")))
    fresh = F.lit(True)
    if view.ttl_seconds is not None:
        fresh = F.col("_m.t") >= asof - F.make_dt_interval(secs=F.lit(int(view.ttl_seconds)))
    return best.select(*keys, F.col("_m.t").alias(view.timestamp_field),
                       *[F.when(fresh, F.col(f"_m.v.{n}")).alias(n) for n in names])


def features_for_entities(feature_rows: DataFrame, request: DataFrame,
                          keys: Sequence[str]) -> DataFrame:
    """Only rows of requested entities: a LEFT SEMI join (no duplication;
    Catalyst broadcasts the request side when its size statistic is under
    the broadcast threshold, else shuffles both sides on the key)."""
    return feature_rows.join(request.select(*keys), list(keys), "left_semi")


def describe_views(views: Sequence[FeatureView]) -> list[tuple]:
    """(name, entities, features, dtypes, ttl, timestamp) per view."""
    return [(v.name, list(v.entities), v.feature_names, [d for _, d in v.features],
             v.ttl_seconds, v.timestamp_field) for v in views]
