"""Not-modified revisits of a crawl: as-of join to the latest earlier full response.

A revisit record (a 304 answer) has no payload of its own.  It stands for the latest full response with the
same canonical URL that was captured earlier.  The two belong together if their
validators agree: entity tags if both have one (compared weakly), else the dates of last modification.
The merged record has the headers of the response, replaced by those of the revisit that a
not-modified answer may update; headers about the payload or the connection keep the response's value.

The as-of join needs no window over all records of a URL.  Time is cut into cells at sketched quantiles.
A running maximum is taken inside each (URL, cell), and one over the last responses of earlier cells, one
row for each cell, so a URL with a third of all records is spread over a third of the cells.  A response moves
through the windows with its validators and headers, so nothing is joined by record id, which may be null or repeated.

Columns of the records: ``record_id``, ``url``, ``kind`` (``response`` or ``revisit``), ``captured_at`` (a number),
``etag``, ``last_modified``, ``headers`` (map, lower-case names).  Defined results: a null url or time matches nothing
(``no earlier response``); of responses with the same time the one with the highest id counts (a null id is the lowest), then the one with the
highest tag, date and headers; equal times are not earlier; every revisit row gives one row, also if its id is null or
repeated, and repeated responses count as one; without a common validator the status is ``unverified``.  Records of no or another kind and other columns
are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabaudit.functions.ranking import split_points, with_bucket
from tabaudit.llm.frames import shuffle_partitions

# Header fields that a not-modified answer doesn't update.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = "utm_[a-z_]+|ref|fbclid|gclid"

RESOLVED, MISMATCH, UNVERIFIED, MISSING = "resolved", "validator mismatch", "unverified", "no earlier response"


def canonical_url(url: Column) -> Column:
    """Host in lower case, without scheme, default port, fragment, tracking parameters and last slash."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(plain, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^([^/?]*)", 1)), ":(80|443)$", "")
    rest = F.regexp_replace(plain, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, "[?](.*)$", 1), f"(^|&)({TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


_VALIDATORS = ("etag", "last_modified", "headers")


def _response_order() -> list[Column]:
    """What orders responses after their time; maps have no order, their sorted entries do."""
    return [F.col("record_id"), F.col("etag"), F.col("last_modified"), F.array_sort(F.map_entries("headers")).alias("entries")]


def _matched(records: DataFrame) -> DataFrame:
    """Every revisit row with the struct ``response`` of its as-of match, which is null if there is none."""
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("captured_at").cast("long").alias("captured_at"),
        *_VALIDATORS, (F.col("kind") == "response").alias("full"),
    )
    able = rows.where(F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull())
    cells = 4 * shuffle_partitions(records.sparkSession)
    points, _ = split_points(able, "captured_at", cells)
    able = with_bucket(able, "captured_at", points, "cell")
    key = F.when(F.col("full"), F.struct("captured_at", *_response_order()))
    last = able.where("full").groupBy("canonical_url", "cell").agg(F.max(key).alias("last"))
    marks = able.where(~F.col("full")).select("canonical_url", "cell").distinct()
    per_cell = last.join(marks, ["canonical_url", "cell"], "full")
    before = Window.partitionBy("canonical_url").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_cell.select("canonical_url", "cell", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("canonical_url", "cell").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    found = able.withColumn("here", F.max(key).over(inside)).where(~F.col("full"))
    matched = found.join(carried, ["canonical_url", "cell"], "left").select(
        "record_id", "canonical_url", "captured_at", *_VALIDATORS, F.coalesce("here", "carried").alias("response")
    )
    unable = rows.where(~F.col("full") & (F.col("canonical_url").isNull() | F.col("captured_at").isNull()))
    missing = F.lit(None).cast(matched.schema["response"].dataType).alias("response")
    return matched.unionByName(unable.select("record_id", "canonical_url", "captured_at", *_VALIDATORS, missing))


def latest_earlier(records: DataFrame) -> DataFrame:
    """``record_id``, ``canonical_url``, ``captured_at`` of every revisit with the ``response_id`` of its as-of match."""
    return _matched(records).select("record_id", "canonical_url", "captured_at", F.col("response.record_id").alias("response_id"))


def _tag(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by those of the revisit that may change."""
    response = F.coalesce(response, F.create_map().cast("map<string,string>"))
    revisit = F.coalesce(revisit, F.create_map().cast("map<string,string>"))
    updates = F.map_filter(revisit, lambda name, _: ~name.isin(*KEPT_FIELDS))
    kept = F.map_filter(response, lambda name, _: ~F.coalesce(F.map_contains_key(updates, name), F.lit(False)))
    return F.map_concat(kept, updates)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``revisit_id``, ``canonical_url``, ``captured_at``, ``response_id``, ``response_at``, ``status``, ``headers``.

    Headers are merged only where the status is ``resolved``; else they are the revisit's own.
    """
    found = _matched(records)
    response = F.col("response")
    tags = _tag(F.col("etag")) == _tag(response["etag"])
    dates = F.col("last_modified") == response["last_modified"]
    agree = F.coalesce(tags, dates)
    status = (
        F.when(response.isNull(), MISSING)
        .when(agree.isNull(), UNVERIFIED)
        .when(agree, RESOLVED)
        .otherwise(MISMATCH)
    )
    return found.select(
        F.col("record_id").alias("revisit_id"),
        "canonical_url",
        "captured_at",
        response["record_id"].alias("response_id"),
        response["captured_at"].alias("response_at"),
        status.alias("status"),
        F.when(status == RESOLVED, merged_headers(F.map_from_entries(response["entries"]), F.col("headers")))
        .otherwise(F.col("headers"))
        .alias("headers"),
    )


def attach_payload(resolved: DataFrame, records: DataFrame, payload: str) -> DataFrame:
    """Add the response's payload to resolved revisits, one row for each.

    Responses are found by URL, time and id, which may be null; of those alike the one that was matched counts.
    """
    names = ["response_id", *[c for c in resolved.columns if c != "response_id"]]
    full = records.where(F.col("kind") == "response").select(
        canonical_url(F.col("url")).alias("body_url"), F.col("captured_at").cast("long").alias("body_at"),
        F.col("record_id").alias("body_id"), F.struct(*_response_order()[1:], F.col(payload)).alias("order"),
    )
    bodies = full.groupBy("body_url", "body_at", "body_id").agg(F.max("order").alias("body"))
    same = (F.col("canonical_url") == F.col("body_url")) & (F.col("response_at") == F.col("body_at"))
    same &= F.col("response_id").eqNullSafe(F.col("body_id"))
    joined = resolved.where(F.col("status") == RESOLVED).join(bodies, same)
    return joined.select(*names, F.col("body")[payload].alias(payload))
