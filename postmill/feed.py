"""One feed: the operators applied to its stored tables.

Queries return lazy frames. Changes are written at once and return counts. Batches of the stream
count up from 0, batches written here count down from -1, so neither overwrites the other; do not
write here while a failed round still waits to be run again.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from postmill.operators import ingest, mutate, notify, queries
from postmill.schemas import DETAIL_FIELDS
from postmill.sources.staging import scratch, stage
from postmill.sources.store import Store


class Feed:
    def __init__(self, store: Store):
        self.store = store
        self.spark = store.spark

    # -- tables ----------------------------------------------------------------

    def postings(self) -> DataFrame:
        """All postings with ``is_sent``, in no particular order."""
        return mutate.with_sent_flag(self.store.read("postings"), self.store.read("delivery"))

    def details(self) -> DataFrame:
        return self.store.read("details")

    # -- queries ---------------------------------------------------------------

    def all_postings(self) -> DataFrame:
        return queries.newest_first(self.postings())

    def count(self) -> int:
        return queries.posting_count(self.store.read("postings")).first().n

    def unsent(self) -> DataFrame:
        return queries.unsent_with_details(self.postings(), self.details())

    def unsent_count(self) -> int:
        return queries.unsent_count(self.postings()).first().n

    def posted_on(self, day: datetime.date | str) -> DataFrame:
        return queries.posted_on(self.postings(), day)

    def posted_within(self, days: int, as_of: datetime.date | str) -> DataFrame:
        return queries.posted_within(self.postings(), days, as_of)

    def search(self, word: str) -> DataFrame:
        return queries.search_text(self.postings(), word)

    def existing_urls(self) -> DataFrame:
        return ingest.existing_urls(self.store.read("postings"))

    def url_exists(self, url: str) -> bool:
        return not queries.limit_one(self.store.read("postings").filter(F.col("job_url") == url)).isEmpty()

    def pending_details(self, url_pattern: str | None = None) -> DataFrame:
        return queries.pending_details(self.postings(), self.details(), url_pattern)

    def detail_count(self) -> int:
        return queries.detail_count(self.details()).first().n

    def details_of(self, job_id: int) -> DataFrame:
        return queries.detail_by_id(self.details(), job_id)

    def all_details(self) -> DataFrame:
        return queries.postings_with_details(self.postings(), self.details())

    # -- inserts ---------------------------------------------------------------

    def _own_batch(self, table: str) -> int:
        return min([0, *[e["batch"] or 0 for e in self.store.entries(table)], *[
            r[0] for r in self.store.folders(table, [e for e in self.store.entries(table) if e["batch"] is None]).agg(
                F.coalesce(F.min("batch_id"), F.lit(0))).collect()]]) - 1

    def insert_postings(self, listings: DataFrame, order_by: Sequence[str] = ("source", "pos")) -> Row:
        """Store the new ones; ``(inserted, skipped)``."""
        with scratch(self.spark):
            batch = stage(listings, "listings")
            now, number = F.current_timestamp(), self._own_batch("postings")
            new = ingest.ingest_new(batch, self.store.read("postings"), order_by, self.store.highest_id("postings"))
            change = self.store.change()
            entry = change.put("postings", new.withColumns({"created_at": now, "updated_at": now}), number)
            change.commit()
            return ingest.ingest_counts(batch, self.store.folders("postings", [entry])).first()

    def insert_details(self, rows: DataFrame, order_by: Sequence[str] = ("job_id",)) -> Row:
        """Store detail rows, taken one by one in the given order, whose posting and URL have none yet; ``(inserted, skipped)``."""
        with scratch(self.spark):
            types = self.store.schema("details")
            batch = stage(rows.select("job_id", "job_url", *[c for c in order_by if c not in types.names], *[
                c if c in rows.columns else F.lit(None).cast(types[c].dataType).alias(c) for c in DETAIL_FIELDS]), "details")
            number = self._own_batch("details")
            new = ingest.ingest_details(batch, self.details(), order_by)
            numbered = ingest.assign_ids(new, order_by, self.store.highest_id("details"))
            change = self.store.change()
            entry = change.put("details", numbered.withColumn("scraped_at", F.current_timestamp()), number)
            change.commit()
            return ingest.ingest_counts(batch, self.store.folders("details", [entry])).first()

    # -- delivery state --------------------------------------------------------

    def _log(self, rows: DataFrame) -> int:
        """Add to the delivery log under the step for changes by hand, after all that is there; each call counts by itself.

        Before the first round it goes to batch -1, which that round takes into account.
        """
        last = max([-1, *[e["batch"] for e in self.store.entries("delivery")]])
        change = self.store.change()
        entry = change.add("delivery", rows.withColumn("call", F.lit(uuid.uuid4().hex)), last, "by-hand")
        change.commit()
        return entry["rows"]

    def mark_sent(self, ids: DataFrame) -> int:
        """Mark postings as sent; how many of the ids exist."""
        return self._log(mutate.mark_sent(self.store.read("postings"), ids, F.current_timestamp()))

    def reset_sent_without_details(self) -> int:
        return self._log(mutate.reset_sent_without_details(self.postings(), self.details(), F.current_timestamp()))

    def select_for_delivery(self, words: Sequence[str]) -> DataFrame:
        return notify.select_for_delivery(self.unsent(), words)

    # -- deletes ---------------------------------------------------------------

    def clear_postings(self, keep_orphans: bool = False) -> int:
        deleted = self.count()
        left, details = mutate.clear_postings(self.store.read("postings"), self.details(), keep_orphans)
        change = self.store.change()
        if not keep_orphans:
            change.publish("details", details)
        change.publish("postings", left)
        change.commit()
        return deleted

    def clear_details(self) -> int:
        deleted = self.detail_count()
        self.store.publish("details", mutate.clear_details(self.details()))
        return deleted

    def delete_empty_details(self, url_pattern: str | None = None) -> int:
        old, postings = self.details(), self.store.read("postings")
        deleted = mutate.empty_details(old, postings, url_pattern).count()
        self.store.publish("details", mutate.delete_empty_details(old, postings, url_pattern))
        return deleted
