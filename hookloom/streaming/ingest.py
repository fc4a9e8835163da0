"""Continuous ingest: micro-batches of requests into event, outcome and dead-letter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hookloom.operators.catalog import SpecLookup
from hookloom.operators.dedupe import DAY
from hookloom.operators.normalize import EVENT_COLUMNS, MAX_BODY_BYTES, classify_requests
from hookloom.plans.ingest import dead_letter_table, ingest, outcome_table
from hookloom.session import stage_table
from hookloom.sources.claims import TABLE, ClaimStore
from hookloom.sources.commits import write_batch
from hookloom.sources.landing import clear_landed, landed_requests, stream_landings
from hookloom.sources.sinks import write_dead_letters, write_events, write_outcomes
from hookloom.streaming.dedupe import dedupe_files


def ingest_batches(
    requests: DataFrame, lookup: SpecLookup, out: str, checkpoint: str,
    ttl_seconds: float = DAY, max_body: int = MAX_BODY_BYTES, once: bool = False,
) -> StreamingQuery:
    """Ingest each micro-batch with the batch operators, deduplicated against the claims before it.

    Arrival time is the clock, so results do not depend on how rows fall into batches as
    long as later batches hold later arrivals. The tables of a batch are committed together: readers
    see all of them or none, and a batch that is run again replaces an attempt that failed. Claims are a
    slim bucketed table of their own under ``out``, kept for twice the TTL by the latest arrival.
    """
    store = ClaimStore(requests.sparkSession, out, 2 * ttl_seconds)

    def run(batch: DataFrame, batch_id: int) -> None:
        _ingest_batch(batch, batch_id, lookup, out, store, ttl_seconds, max_body)

    return _start(requests.writeStream.foreachBatch(run), checkpoint, once)


def ingest_landings(
    spark: SparkSession, base: str, lookup: SpecLookup, out: str, checkpoint: str, ttl_seconds: float = DAY,
    max_body: int = MAX_BODY_BYTES, max_batches: int | None = None, clear: bool = False, once: bool = False,
) -> StreamingQuery:
    """`ingest_batches` over batches that `landing.land_requests` committed under ``base``.

    Offsets are those of landed batches. With ``clear``, a batch's landed files go once it is committed;
    a micro-batch that is run again after that has nothing to do.
    """
    store = ClaimStore(spark, out, 2 * ttl_seconds)

    def run(landings: DataFrame, batch_id: int) -> None:
        _ingest_batch(landed_requests(base, landings), batch_id, lookup, out, store, ttl_seconds, max_body)
        if clear:
            clear_landed(base, landings)

    return _start(stream_landings(spark, base, max_batches).writeStream.foreachBatch(run), checkpoint, once)


def _ingest_batch(
    batch: DataFrame, batch_id: int, lookup: SpecLookup, out: str, store: ClaimStore, ttl_seconds: float, max_body: int,
) -> None:
    def write(attempt: str) -> dict[str, str | None]:
        result = ingest(
            batch, lookup, lambda classified: store.history(), ttl_seconds, max_body=max_body, stage_dir=f"{out}/staged"
        )
        write_outcomes(result.outcomes, f"{out}/outcomes", batch_id, attempt)
        write_dead_letters(result.dead_letters, f"{out}/dead_letters", batch_id, attempt)
        write_events(result.events, f"{out}/events", batch_id, attempt=attempt)
        return {"outcomes": None, "dead_letters": None, "events": None, TABLE: store.add(result.events, batch_id, attempt)}

    write_batch(batch.sparkSession, out, batch_id, write)


def ingest_stateful(
    requests: DataFrame, lookup: SpecLookup, out: str, checkpoint: str,
    ttl_seconds: float = DAY, max_body: int = MAX_BODY_BYTES, once: bool = False,
) -> StreamingQuery:
    """Ingest with claims in keyed state instead of a table of claims.

    Two queries: one classifies requests into files under ``out``/classified, one deduplicates those
    files. Bodies are parsed once and no payload enters the state. Returns the second query; the
    first is ``classify`` of the same checkpoint and runs on until stopped, unless ``once``.
    """
    spark = requests.sparkSession
    classified = classify_requests(requests, lookup, max_body).withColumn("source", F.coalesce("source", F.lit("")))
    landing = f"{out}/classified"
    # The second query may start before the first has written anything: the folder must be there, but hold
    # no file, or the file source would not wait for the first query's log of what it committed.
    spark.createDataFrame([], classified.schema).write.mode("ignore").partitionBy("source").parquet(landing)
    writer = classified.writeStream.format("parquet").option("path", landing)
    parsing = _start(writer, f"{checkpoint}/classify", once)
    if once:
        parsing.awaitTermination()

    def write(rows: DataFrame, batch_id: int) -> None:
        def tables(attempt: str) -> dict[str, None]:
            staged = stage_table(
                rows.withColumn("outcome", F.when(~F.col("accepted"), "duplicate").otherwise(F.col("outcome"))),
                "ingested", f"{out}/staged/ingested",
            )
            write_outcomes(outcome_table(staged), f"{out}/outcomes", batch_id, attempt)
            write_dead_letters(dead_letter_table(staged), f"{out}/dead_letters", batch_id, attempt)
            accepted = staged.filter(F.col("outcome") == "accepted").select(*EVENT_COLUMNS)
            write_events(accepted, f"{out}/events", batch_id, attempt=attempt)
            return dict.fromkeys(("outcomes", "dead_letters", "events"))

        write_batch(spark, out, batch_id, tables)

    # Rejected rows claim nothing.
    return dedupe_files(
        spark, landing, classified.schema, write, f"{checkpoint}/dedupe", ttl_seconds,
        eligible=lambda rows: F.col("outcome") == "accepted", once=once,
    )


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
