"""Secret scan with multipart credential linking.

A scan of each whole text finds the base kinds (``assign``, ``access``, ``hex``)
and weak candidates that mean little alone: a bare 40-character key
(``bare_key``), a user or client name (``login``) and a service address
(``endpoint``).  A weak candidate is reported only when complementary parts
stand in its scope, the ``SCOPE_GAP`` characters around it in the same text:

* ``bare_key`` beside an access identifier or a login,
* ``login`` beside a secret (a base ``assign`` or ``hex``, or a bare key),
* ``endpoint`` beside both an identifier and a secret.

Linking is an interval join on Spark: the parts of the texts that have weak
candidates are exploded, and running maxima of the ends before and minima of the
starts after each part (per role, in order of place) tell the distance to the
nearest part of every role.  No pair of parts is formed, whatever their number.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tierline.llm.frames import stash

#: Fixed values of the base contract.  (?a) keeps "either case" to A-Z and a-z.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")     # a maximal run of 24 or more is the run itself
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
#: Every assignment holds one of these in lower case; a text without them has none.
ASSIGN_CUES = ("passw", "secret", "token", "apikey", "api_key")

#: Weak candidates.
BARE_KEY = re.compile(r"(?<![A-Za-z0-9/+=_.-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_.-])")
LOGIN = re.compile(r"""(?ai)\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""")
ENDPOINT = re.compile(r"""(?a)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\s"'<>`]+""")
SCOPE_GAP = 300

KINDS = ("assign", "access", "hex", "bare_key", "login", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "bare_key": "secret", "access": "id", "login": "id",
        "endpoint": "endpoint"}
BASE_KINDS = 3

_SPANS = "array<struct<start:int,ord:int,end:int>>"
_SCAN = f"n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPANS}, parts {_SPANS}"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    spans = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(c in low for c in ASSIGN_CUES):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                      if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def _looks_random(key: str) -> bool:
    return any(c.isdigit() for c in key) and any(c.isupper() for c in key) and any(c.islower() for c in key)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that do not touch a base span."""
    found = [(m.start(), 3, m.end()) for m in BARE_KEY.finditer(text) if _looks_random(m[0])]
    if "=" in text or ":" in text:
        found += [(m.start(), 4, m.end()) for m in LOGIN.finditer(text)]
        if "://" in text:
            found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if not found:
        return found
    found.sort()
    out, at, reach = [], 0, -1          # sweep: furthest base end so far, next base start
    for s, k, e in found:
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s:
            out.append((s, k, e))
    return out


def spans_digest(spans) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def scan_column(text: Column) -> Column:
    """Base counts, digest and spans; ``parts`` holds every part of a text with a weak candidate."""
    @F.pandas_udf(_SCAN)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            weak = weak_spans(t, base)
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            as_rows = lambda x: [{"start": s, "ord": k, "end": e} for s, k, e in x]
            rows.append((*n, spans_digest(base), as_rows(base), as_rows(sorted(base + weak)) if weak else []))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"])
    return scan(text)


def link_parts(scanned: DataFrame, key: str = "rid") -> DataFrame:
    """Rows (key, linked spans) of the texts with at least one reported weak candidate."""
    roles = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("ord") + 1)
    parts = scanned.filter(F.size("parts") > 0).select(key, F.explode("parts").alias("p")) \
        .select(key, "p.start", "p.ord", "p.end").withColumn("role", roles)
    order = Window.partitionBy(key).orderBy("start", "ord", "end")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for role in ("id", "secret"):
        last_end = F.max(F.when(F.col("role") == role, F.col("end"))).over(behind)
        next_start = F.min(F.when(F.col("role") == role, F.col("start"))).over(ahead)
        near[role] = F.coalesce(F.col("start") - last_end <= SCOPE_GAP, F.lit(False)) \
            | F.coalesce(next_start - F.col("end") <= SCOPE_GAP, F.lit(False))
    judged = parts.withColumn("id_near", near["id"]).withColumn("secret_near", near["secret"])
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("ord") + 1)
    complete = F.when(kind == "bare_key", F.col("id_near")).when(kind == "login", F.col("secret_near")) \
        .when(kind == "endpoint", F.col("id_near") & F.col("secret_near")).otherwise(False)
    return judged.filter(complete).groupBy(key) \
        .agg(F.collect_list(F.struct("start", "ord", "end")).alias("linked"))


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) plus ``n_assign``, ``n_access``,
    ``n_hex``, ``base_sha256`` and ``all_spans``, an ordered array of
    (start, ord, end) with ``ord`` a place in ``KINDS`` and offsets in code points.

    Null text counts as empty.  Every row gives one row, repeated ones too.  An
    empty input gives an empty output.  Input columns named like an added one
    give way.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "all_spans"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    kept = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))
    scanned = docs.select(kept.alias("row"), scan_column(F.col(text_col)).alias("s"))
    scanned = stash(scanned.select(F.monotonically_increasing_id().alias("rid"), "row", "s.*"), "secret-scan")
    linked = stash(link_parts(scanned), "secret-links")    # few rows: joined by their measured size
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS))))
    out = scanned.join(linked, "rid", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in names], *added[:-1], spans.alias("all_spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones merged) replaced by ``[kind]``."""
    @F.pandas_udf("string")
    def redact(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, all_spans):
            if t is None or ss is None or len(ss) == 0:
                out.append(t)
                continue
            parts, at = [], 0
            for s in ss:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    parts += [t[at:s["start"]], f"[{KINDS[s['ord']]}]"]
                at = s["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)
    return redact(text, spans)


def secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs, keep=["doc_id"]).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text(F.col("all_spans")).alias("spans"))
