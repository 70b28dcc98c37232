"""Whether stored listings are still online."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricelens.operators.lookup import skew_left_join


def recheck_queue(listings: DataFrame, limit: int = 100) -> DataFrame:
    """Active listings with an address: never checked first, then oldest check, then oldest capture."""
    due = listings.where((F.trim("listing_url") != "") & (F.coalesce("is_active", F.lit(1)) == 1))
    columns = ["id", "source_listing_id", "title", "listing_url", "status_checked_at"]
    order = [F.asc_nulls_first("status_checked_at"), F.asc_nulls_first("scraped_at"), F.asc("id")]
    return due.orderBy(*order).limit(limit).select(*columns)


def fold_events(events: DataFrame, state: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Status per listing after all of ``events(id, status, checked_at, status_reason)``.

    The first removal after the last active check is the removal time; an active check clears it;
    an unknown check changes neither. A stored state takes part as its last active check, its first and last
    removal since, and its latest check. Late events so give what all events at once would give, but for one
    case: an active check that arrives late between two removals leaves the time of the last one, which may
    not be the first after that check.
    """
    if state is not None:
        event = lambda status, time: state.where(F.col(time).isNotNull()).select("id", F.lit(status).alias("status"), F.col(time).alias("checked_at"), "status_reason")
        # the latest check survives as an event that decides nothing
        events = events.unionByName(event("active", "last_active_at")).unionByName(event("removed", "removed_at")).unionByName(event("removed", "last_removed_at")).unionByName(event("unknown", "status_checked_at"))
    at = F.col("checked_at")
    when = lambda status: F.when(F.col("status") == status, at)
    summary = events.groupBy("id").agg(
        F.max(when("active")).alias("last_active"), F.max(when("removed")).alias("last_removed"),
        F.max(at).alias("status_checked_at"), F.max_by("status_reason", at).alias("status_reason"),
    )
    removals = events.where(F.col("status") == "removed").select("id", "checked_at")
    active = summary.where(F.col("last_active").isNotNull()).select("id", "last_active")
    rows = total if total is not None else removals.count()
    after = skew_left_join(removals, active, ["id"], rows).where(F.col("last_active").isNull() | (F.col("checked_at") > F.col("last_active")))
    first = after.groupBy("id").agg(F.min("checked_at").alias("removed_at"))
    joined = summary.join(first, "id", "left")
    decided = F.col("last_active").isNotNull() | F.col("last_removed").isNotNull()
    is_active = F.when(F.col("removed_at").isNotNull(), 0).when(decided, 1)
    return joined.select("id", is_active.cast("int").alias("is_active"), "status_checked_at", "removed_at", F.col("last_active").alias("last_active_at"), F.col("last_removed").alias("last_removed_at"), "status_reason")


def compact_events(events: DataFrame) -> DataFrame:
    """The events that can still matter: of each listing its last active check, its latest check and its removals since.

    Folding them, with any later or late events, gives what folding all events gives, and no listing's
    history is ever gathered in one row.
    """
    at = F.col("checked_at")
    active_at = F.when(F.col("status") == "active", at)
    last = events.groupBy("id").agg(
        F.max(active_at).alias("last_active"), F.max_by("status_reason", active_at).alias("active_reason"), F.max(at).alias("seen"), F.max_by("status_reason", at).alias("seen_reason"),
    )
    active = last.where(F.col("last_active").isNotNull())
    removals = events.where(F.col("status") == "removed").groupBy("id", "checked_at").agg(F.max("status_reason").alias("status_reason"))
    pending = skew_left_join(removals, active.select("id", "last_active"), ["id"], removals.count()).where(F.col("last_active").isNull() | (at > F.col("last_active")))
    return (
        active.select("id", F.lit("active").alias("status"), F.col("last_active").alias("checked_at"), F.col("active_reason").alias("status_reason"))
        .unionByName(last.select("id", F.lit("unknown").alias("status"), F.col("seen").alias("checked_at"), F.col("seen_reason").alias("status_reason")))
        .unionByName(pending.select("id", F.lit("removed").alias("status"), "checked_at", "status_reason"))
    )


def apply_status(listings: DataFrame, states: DataFrame) -> DataFrame:
    """Listings with the folded status columns; listings without events keep what they had."""
    names = ("is_active", "status_checked_at", "removed_at", "status_reason")
    renamed = states.select("id", F.lit(True).alias("__hit"), *[F.col(n).alias(f"__{n}") for n in names])
    joined = listings.join(renamed, "id", "left")
    keep_flag = F.coalesce("__is_active", "is_active")
    updates = {n: F.when(F.col("__hit"), F.col(f"__{n}")).otherwise(F.col(n)) for n in names if n != "is_active"}
    return joined.withColumns({**updates, "is_active": keep_flag}).drop("__hit", *[f"__{n}" for n in names])


def status_events(listings: DataFrame, classified_pages: DataFrame) -> DataFrame:
    """Events from classified pages (url, status, status_reason, fetched_at) for the listings they show."""
    addressed = listings.where(F.trim("listing_url") != "").select("id", F.col("listing_url").alias("url"))
    return classified_pages.join(addressed, "url").select("id", "status", F.col("fetched_at").alias("checked_at"), "status_reason")


def status_totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("checked"))
