"""Address enrichment: parse stored lookup responses (S10), resolve licences
to admin regions with a null row on a miss (J7), first-wins dedup (W1),
ingest stamp (C13), bronze/silver fan-out (S7) and bulk enrichment through a
caller-supplied batch function (X2).

The reference calls an HTTP API per row from driver threads.  Here the
responses are a table keyed by licence id (the HTTP client is out of scope),
and the lookup becomes a left join executed by the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# The response envelope fields and the per-address fields, in
# the order of the reference's bronze table.
COMMON_FIELDS = ["totalCount", "currentPage", "countPerPage", "errorCode", "errorMessage"]
JUSO_FIELDS = ["roadAddr", "roadAddrPart1", "roadAddrPart2", "jibunAddr", "engAddr", "zipNo",
               "admCd", "rnMgtSn", "bdMgtSn", "detBdNmList", "bdNm", "bdKdcd", "siNm", "sggNm",
               "emdNm", "liNm", "rn", "udrtYn", "buldMnnm", "buldSlno", "mtYn", "lnbrMnnm",
               "lnbrSlno", "emdNo", "hstryYn", "relJibun", "hemdNm"]
KEY_FIELDS = ["uid", "id", "full_address"]
BRONZE_COLUMNS = COMMON_FIELDS + KEY_FIELDS + JUSO_FIELDS
SILVER_COLUMNS = ["uid", "id", "full_address", "siNm", "sggNm", "emdNm"]

BRONZE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in BRONZE_COLUMNS])
SILVER_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in SILVER_COLUMNS])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("results", T.StructType([
        T.StructField("common", T.StructType([T.StructField(c, T.StringType()) for c in COMMON_FIELDS])),
        T.StructField("juso", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in JUSO_FIELDS]))),
    ])),
])


def strip_jsonp(col: Column) -> Column:
    """Remove one enclosing ``( ... )`` after trimming whitespace (JSONP wrapper)."""
    s = tx.py_strip(col)
    return F.regexp_replace(s, r"(?s)^\((.*)\)\z", "$1")


def _is_hit() -> Column:
    """A parsed payload ``_r`` with an envelope, addresses and a count other than '0'."""
    common, juso = F.col("_r.results.common"), F.col("_r.results.juso")
    return common.isNotNull() & juso.isNotNull() & (F.size(juso) > 0) & ~F.col("_r.results.common.totalCount").eqNullSafe(F.lit("0"))


def parse_address_response(df: DataFrame, payload_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per returned address, envelope fields replicated.

    Payloads without ``results`` or its ``common`` part, without or with an empty address list, with
    ``totalCount == '0'`` or that fail to parse yield no rows (a miss).  Real
    JSON parsing is used (the reference's literal-eval rejects null/true/false;
    such payloads parse here - a documented deviation).
    """
    # Parse once, then explode only accepted address lists.  No separate
    # filter: a filter would be pushed below the parse and re-evaluate
    # from_json once per referenced field.
    parsed = df.select(*keep, F.from_json(strip_jsonp(F.col(payload_col)), RESPONSE_SCHEMA).alias("_r"))
    exploded = parsed.select(*keep, F.col("_r.results.common").alias("_c"),
                             F.explode(F.when(_is_hit(), F.col("_r.results.juso"))).alias("_j"))
    return exploded.select(*keep, *[F.col(f"_c.{c}").alias(c) for c in COMMON_FIELDS],
                           *[F.col(f"_j.{c}").alias(c) for c in JUSO_FIELDS])


def resolve_address(requests: DataFrame, responses: DataFrame, uid_col: str = "uid",
                    id_col: str = "id", addr_col: str = "full_address",
                    payload_col: str = "payload") -> DataFrame:
    """Every request row gets its parsed address rows, or one row of nulls.

    ``requests`` carries (uid, id, raw address); the address is cleaned (C9)
    as the lookup key text.  ``responses`` carries (uid, payload).  Requests
    meet their stored payloads first, so only requested payloads are parsed
    (the reference calls the service only for rows that need it).  Output is
    the 35-column bronze layout, all strings; a miss is never dropped.
    """
    req = requests.select(F.col(uid_col).cast("string").alias("uid"), F.col(id_col).cast("string").alias("id"),
                          F.col(addr_col).alias("full_address"))
    resp = responses.select(F.col(uid_col).cast("string").alias("uid"), F.col(payload_col).alias("payload"))
    return parse_in_place(req.join(resp, on="uid", how="left"))


def parse_in_place(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """J7 for rows that carry their own payload (uid, id, raw address, payload):
    bronze layout, cleaned address, one row per returned address, misses kept
    as one row of nulls; the columns ``keep`` pass through.  Used by the batch
    lookup and the streaming ingest."""
    parsed = rows.select(
        *keep, "uid", "id", tx.clean_address(F.col("full_address")).alias("full_address"),
        F.from_json(strip_jsonp(F.col("payload")), RESPONSE_SCHEMA).alias("_r"))
    hit, juso = _is_hit(), F.col("_r.results.juso")
    out = parsed.select(*keep, "uid", "id", "full_address",
                        F.when(hit, F.col("_r.results.common")).alias("_c"),
                        F.explode_outer(F.when(hit, juso)).alias("_j"))
    return out.select(*[F.col(f"_c.{c}").alias(c) for c in COMMON_FIELDS], "uid", "id", "full_address",
                      *[F.col(f"_j.{c}").alias(c) for c in JUSO_FIELDS], *keep)


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order`` (ties: all columns).

    A grouped ``min`` over a struct led by ``order`` rather than a
    ``row_number`` window: the aggregation combines map-side, so a key
    repeated across a third of the input never lands whole in one task.
    """
    others = [c for c in df.columns if c not in keys and c != order]
    packed = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_best"))
    return best.select(*[F.col(k) for k in keys], F.col("_best._o").alias(order),
                       *[F.col(f"_best.{c}").alias(c) for c in others]).select(*df.columns)


def ingest_stamp(now: Column | None = None, zone: str = "Asia/Seoul",
                 fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The ingest time as wall-clock text in ``zone``.

    ``now`` defaults to ``current_timestamp()``; pass a literal timestamp to
    make the stamp reproducible.  Converting the instant through the zone is
    right in any session time zone (a fixed +9 h is right only under UTC).
    """
    instant = F.current_timestamp() if now is None else now
    wall = F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))
    return F.date_format(wall, fmt)


def bulk_enrich(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], out_schema: T.StructType,
                key_cols: Sequence[str], error_col: str | None = None) -> DataFrame:
    """Apply a caller batch function to Arrow batches of ``df``.

    ``fn`` receives a pandas frame and returns rows of ``out_schema``.  If it
    raises, the batch is retried row by row and each failing row becomes one
    row holding only its ``key_cols`` (everything else null): a bad row never
    fails the job.  ``error_col``, a text field of ``out_schema``, takes the
    message.  Key values pass unchanged (as text into text fields), nulls as nulls.
    Parallelism is the number of partitions.
    """
    names = out_schema.fieldNames()
    texts = {f.name for f in out_schema.fields if isinstance(f.dataType, T.StringType)}

    def key_value(name, v):
        return None if pd.isna(v) else str(v) if name in texts else v

    def run(it):
        for pdf in it:
            try:
                out = fn(pdf)
            except Exception:
                parts = []
                for i in range(len(pdf)):
                    row = pdf.iloc[i:i + 1]
                    try:
                        parts.append(fn(row))
                    except Exception as exc:
                        held = {k: [key_value(k, v) for v in row[k].tolist()] for k in key_cols}
                        if error_col:
                            held[error_col] = [f"{type(exc).__name__}: {exc}"]
                        parts.append(pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in held.items()}))
                out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
            out = out.reindex(columns=names)
            # plain object columns: Arrow-backed string dtypes do not convert back
            yield pd.DataFrame({c: pd.Series(out[c].tolist(), dtype=object) for c in names})

    return df.mapInPandas(run, schema=out_schema)


def payload_lookup(pdf: pd.DataFrame) -> pd.DataFrame:
    """A batch function for ``bulk_enrich`` that reads stored payloads.

    Stands in for the HTTP client: per row it parses ``payload`` and returns
    one row per address (or a null row on a miss), keyed by uid/id/address.
    """
    rows = []
    for uid, rid, addr, payload in zip(pdf["uid"], pdf["id"], pdf["full_address"], pdf["payload"]):
        base = {"uid": uid, "id": rid, "full_address": addr}
        hits = []
        try:
            text = (payload or "").strip()
            if text.startswith("(") and text.endswith(")"):
                text = text[1:-1]
            res = json.loads(text)
            common = res["results"]["common"]
            juso = res["results"]["juso"]
            if juso and common.get("totalCount") != "0":
                for j in juso:
                    hits.append({**{c: common.get(c) for c in COMMON_FIELDS}, **base,
                                 **{c: j.get(c) for c in JUSO_FIELDS}})
        except (ValueError, KeyError, TypeError, AttributeError):
            hits = []
        rows.extend(hits or [base])
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in BRONZE_COLUMNS})
