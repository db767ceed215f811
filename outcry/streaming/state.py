"""Tables kept up to date from event streams: each micro-batch reads the version before it and writes the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.operators import maintain, vectors
from outcry.streaming.base import read_version, run_available, write_batch
from outcry.streaming.buckets import BucketTable, run_bucketed


def stream_subscription_state(events: DataFrame, base: str, checkpoint: str) -> None:
    """Subscription state per customer. Events of a batch may come in any order; an event older than the state of its
    customer is ignored."""

    def handle(batch: DataFrame, number: int) -> None:
        if not number:
            return write_batch(maintain.subscription_state(batch).select(*maintain.STATE_COLUMNS), base, number)
        # Only the state of customers with new events is folded again; the rest is carried over.
        state, touched = read_version(batch.sparkSession, base, number - 1), batch.select("customer").distinct()
        folded = maintain.subscription_state(batch, state.join(touched, "customer", "left_semi")).select(*maintain.STATE_COLUMNS)
        write_batch(folded.unionByName(state.join(touched, "customer", "left_anti")), base, number)

    run_available(events, handle, checkpoint)


def stream_upsert_users(events: DataFrame, users: DataFrame, orgs: DataFrame, base: str, checkpoint: str) -> None:
    """User dimension after each batch of identity events; ``users`` is the table before the first."""

    def handle(batch: DataFrame, number: int) -> None:
        current = read_version(batch.sparkSession, base, number - 1) if number else users
        touched = batch.select("user_id").distinct()
        changed = maintain.upsert_users(current.join(touched, "user_id", "left_semi"), batch, orgs)
        write_batch(changed.unionByName(current.join(touched, "user_id", "left_anti").select(*changed.columns)), base, number)

    run_available(events, handle, checkpoint)


def stream_subscription_buckets(events: DataFrame, base: str, checkpoint: str, buckets: int = 64) -> BucketTable:
    """As :func:`stream_subscription_state`, but a batch rewrites only the buckets of its customers."""
    empty = maintain.subscription_state(events.sparkSession.createDataFrame([], events.schema)).select(*maintain.STATE_COLUMNS)
    table = BucketTable(events.sparkSession, base, "customer", empty.schema, buckets)
    run_bucketed(events, table, lambda held, batch: maintain.subscription_state(batch, held), checkpoint)
    return table


def stream_user_buckets(events: DataFrame, users: DataFrame, orgs: DataFrame, base: str, checkpoint: str, buckets: int = 64) -> BucketTable:
    """As :func:`stream_upsert_users`, but a batch rewrites only the buckets of its users."""
    columns = maintain.upsert_users(users.limit(0), events.sparkSession.createDataFrame([], events.schema), orgs).schema
    table = BucketTable(events.sparkSession, base, "user_id", columns, buckets)
    run_bucketed(events, table, lambda held, batch: maintain.upsert_users(held, batch, orgs), checkpoint, seed=users)
    return table


def stream_assign(rows: DataFrame, centroids, base: str, checkpoint: str, min_similarity: float = 0.7, *, id_col: str = "id",
                  vec: str = "embedding", key: str = "cluster_id") -> None:
    """Assign arriving rows to clusters. ``centroids(spark)`` gives the centroids to use, afresh for each batch."""

    def handle(batch: DataFrame, number: int) -> None:
        best = vectors.assign_to_cluster(batch, centroids(batch.sparkSession), min_similarity, id_col=id_col, vec=vec, key=key)
        write_batch(best, base, number)

    run_available(rows, handle, checkpoint)


def stream_batches(spark, base: str) -> int:
    """Number of the newest batch."""
    return spark.read.parquet(base).agg(F.max("batch")).first()[0]
