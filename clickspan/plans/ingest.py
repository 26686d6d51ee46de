"""The batch ingest chain, from raw messages to fact rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from clickspan.operators import ingest
from clickspan.operators.sessions import sessionize


@dataclass(frozen=True)
class Ingested:
    """Outputs of one ingest run."""

    events: DataFrame
    rejected: DataFrame
    dead: DataFrame
    report: DataFrame


def ingest_batch(raw: DataFrame, ip_ranges: DataFrame) -> Ingested:
    """Parse, split off dead letters, validate, deduplicate and enrich raw messages.

    Copies go before the enrichment, which then works on each event once and neither adds nor loses one: the report
    counts without it.
    """
    usable, dead = ingest.dead_letter_split(raw)
    received = ingest.explode_batches(usable)
    valid, rejected = ingest.validate(received)
    events = ingest.located(ingest.first_received(ingest.timed(valid)), ip_ranges)
    return Ingested(events, rejected, dead, ingest.ingest_report_once(received))


def with_session_ids(events: DataFrame, gap: str | int = "30 minutes") -> DataFrame:
    """Fact rows with the id of the session they belong to, in the same layout.

    To be run over whole days before the rows are read by session: an id depends on the events of the same
    device up to one gap before.
    """
    return sessionize(events, gap).select(*events.columns)
