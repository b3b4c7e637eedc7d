r"""Resolution of server-not-modified revisit records.

Records have record_id, kind ('response' or 'revisit'), uri, date (timestamp) and http (the
status line and header lines).  A revisit is matched with the latest response (status 200)
of the same canonical uri that is strictly earlier; among responses of one instant the
largest record_id counts.  Then

- validators: where the revisit names an ETag, the response must carry the same one (weak
  comparison); otherwise, where it names Last-Modified, that must be equal; a revisit
  without validators is accepted.  A revisit that fails is 'mismatch', one without an
  earlier response 'unmatched', one that is not status 304 'not_304';
- headers: those a 304 may update replace the stored ones, all others are kept as stored.

Canonical uri: no scheme, user, ``www.`` or default port, lower-case host, no fragment, no
trailing slash, query parameters sorted.

The as-of join runs on (canonical uri, ordered bucket of date): the latest response within
the bucket by a window, and from earlier buckets by one row per uri and bucket, so a uri
that holds a third of all records is dealt over all buckets.  Bodies never move.

A null uri or date leaves a revisit 'unmatched' and a response unused; null headers count
as none.  Repeated records resolve alike.  A table without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.llm.common import order_bounds, order_bucket

# fixed values: the fields a 304 response carries to update a stored one
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_uri(uri: Column) -> Column:
    bare = F.regexp_replace(F.trim(uri), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def status(http: Column) -> Column:
    return F.regexp_extract(F.coalesce(http, F.lit("")), r"^HTTP/\S+ (\d{3})", 1)


def headers(http: Column) -> Column:
    """Map of lower-case names to values; of a repeated field the last counts."""
    every = F.split(F.coalesce(http, F.lit("")), "\r?\n")
    lines = F.slice(every, F.lit(2), F.size(every))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
        F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"])
    return F.map_from_arrays(names, last)


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame, buckets: int = 1000) -> DataFrame:
    """One row per revisit: record_id, uri (canonical), date, response_id, outcome ('resolved',
    'mismatch', 'unmatched', 'not_304'), headers (merged map; null unless resolved)."""
    rows = records.select("record_id", "kind", canonical_uri(F.col("uri")).alias("uri"),
                          F.unix_micros(F.col("date").cast("timestamp")).alias("at"), "date", "http")
    full = (F.col("kind") == "response") & (status(F.col("http")) == "200") & F.col("uri").isNotNull()
    rows = rows.filter((F.col("kind") == "revisit") | (full & F.col("at").isNotNull()))
    bounds = order_bounds(rows, "at", buckets)
    rows = rows.withColumn("bucket", order_bucket(F.col("at"), bounds))
    rows = rows.withColumn("stored", F.when(full, F.struct("at", "record_id", "http")))
    key = ["uri", "bucket"]
    here = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("stored").over(here)).filter("kind = 'revisit'")
    past = rows.groupBy(*key).agg(F.max("stored").alias("stored"))
    before = Window.partitionBy("uri").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    past = past.select(*key, F.max("stored").over(before).alias("far"))
    found = near.join(past, key, "left").withColumn("found", F.when(
        F.col("at").isNotNull() & F.col("uri").isNotNull(), F.coalesce("near", "far")))
    sent, kept = F.col("sent"), F.col("kept")
    tag, since = sent["etag"], sent["last-modified"]
    same = F.when(tag.isNotNull(), _opaque(tag).eqNullSafe(_opaque(kept["etag"]))) \
        .when(since.isNotNull(), since.eqNullSafe(kept["last-modified"])).otherwise(True)
    outcome = F.when(status(F.col("http")) != "304", "not_304").when(F.col("found").isNull(), "unmatched") \
        .when(same, "resolved").otherwise("mismatch")
    out = (found.withColumn("sent", headers(F.col("http"))).withColumn("kept", headers(F.col("found.http")))
           .withColumn("outcome", outcome))
    update = F.map_filter(sent, lambda k, _: k.isin(PERMITTED))
    stays = F.map_filter(kept, lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return out.select("record_id", "uri", "date", F.col("found.record_id").alias("response_id"), "outcome",
                      F.when(F.col("outcome") == "resolved", F.map_concat(stays, update)).alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """Resolved revisits with the body of the response they stand for (of records that repeat
    an id, the largest body)."""
    bodies = records.filter(F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("response_id")).agg(F.max(body).alias(body))
    return resolved.join(bodies, "response_id", "left")
