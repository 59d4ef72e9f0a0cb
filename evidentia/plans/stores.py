"""Queries on stores that are written, changed and read again: vectors, and tables of a run by cell."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.plans.catalogue import DEPTH, query, table
from evidentia.sources.tables import shared_folder
from evidentia.sources.vectors import VectorStore
from evidentia.streaming.pacer import paced

#: The share of the best that a search in part is to find, by the store's own measure.
RECALL = 0.93


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _asked(rows):
    return rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@query()
def probed_vectors(spark, d):
    """The best that the nearest lists hold, in as many lists as the store says are needed."""
    rows = _vectors(spark, d)
    store = VectorStore.create(rows, f"{shared_folder(spark)}/vectors-{uuid.uuid4()}")
    return store.search(_asked(rows), DEPTH, probes=store.probes(RECALL))


@query(
    """WITH now AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.embedding::DOUBLE[], b.v), 6) AS score FROM embeddings a, now b WHERE a.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 30"""
)
def upserted_vectors(spark, d):
    """All lists probed after a tenth of the vectors was turned round and others were written again as they are."""
    rows = _vectors(spark, d)
    store = VectorStore.create(rows.filter("id % 7 > 0"), f"{shared_folder(spark)}/vectors-{uuid.uuid4()}")
    turned = rows.filter("id % 10 = 3").select("id", F.transform("vector", lambda x: -x).alias("vector"))
    store.upsert(rows.filter("id % 7 = 0 OR id % 11 = 0"))
    store.upsert(turned)
    return store.search(_asked(rows), DEPTH)


# --- paced calls -------------------------------------------------------------------------

REQUESTS, TOKENS = 3, 400


@query(
    f"""WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id AS call_id, epoch_us(ts) // 2000 AS t, 50 + user_id % 100 AS estimate, event_id * 7 % 300 AS actual FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, call_id) AS n FROM c),
p AS (SELECT client, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS call_id, CAST(0 AS BIGINT) AS wait_us, CAST(0 AS BIGINT) AS released_us, CAST([] AS STRUCT(t BIGINT, cost BIGINT)[]) AS held FROM (SELECT DISTINCT client FROM o)
UNION ALL SELECT client, n, call_id, w, now + w, list_append(kept, {{'t': now + w, 'cost': CASE WHEN actual > 0 THEN actual ELSE estimate END}}) FROM (
  SELECT *, CASE WHEN leave > 0 THEN greatest(0, kept[leave].t + 60000000 - now) ELSE 0 END AS w FROM (
    SELECT *, greatest(0, len(kept) - {REQUESTS} + 1, coalesce(list_filter(range(0, len(kept) + 1), lambda k: coalesce(list_sum(list_transform(kept[k + 1:], lambda x: x.cost)), 0) + estimate <= {TOKENS})[1], len(kept))) AS leave FROM (
      SELECT o.*, greatest(o.t, p.released_us) AS now, list_filter(p.held, lambda x: x.t > greatest(o.t, p.released_us) - 60000000) AS kept FROM p JOIN o ON o.client = p.client AND o.n = p.n + 1))))
SELECT client, call_id, CAST(wait_us AS BIGINT) AS wait_us, CAST(released_us AS BIGINT) AS released_us FROM p WHERE n > 0"""
)
def paced_calls(spark, d):
    """The events as calls of their users, two thousand times as dense as they are."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 2000)
    calls = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("call_id"), F.timestamp_micros(at).alias("ts"), (50 + F.col("user_id") % 100).alias("estimate"), (F.col("event_id") * 7 % 300).alias("actual"))
    return paced(calls, REQUESTS, TOKENS)
