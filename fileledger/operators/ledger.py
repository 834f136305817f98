"""The work ledger as table to table steps: new work, promotion, priorities, outcomes, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileledger.functions.sizes import size_priority
from fileledger.functions.times import ntz
from fileledger.operators.heavy_keys import join_groups
from fileledger.operators.selection import WINDOW_ROWS, last_of_first
from fileledger.schema import DEFAULT_MAX_ATTEMPTS, KINDS, NEW_FILE_KINDS, STATUSES
from fileledger.session import cut_lineage

# Fixed value: message of a work item whose file the inventory does not have.
NO_SUCH_FILE = "File not found in database"


def known_values(ledger: DataFrame) -> Column:
    """Whether a row's kind and status are among the known ones."""
    return F.col("kind").isin(*KINDS) & F.col("status").isin(*STATUSES)


def work_fan_out(
    new_files: DataFrame,
    created_at: datetime,
    max_attempts: int = DEFAULT_MAX_ATTEMPTS,
    analyze: bool = True,
) -> DataFrame:
    """One pending work item per new file and kind, numbered after the file.

    Without `analyze` the files are only to be hashed.
    """
    nothing = F.lit(None)
    numbered = new_files.select(
        "file_id", F.posexplode(F.array(*map(F.lit, NEW_FILE_KINDS))).alias("place", "kind")
    )
    if not analyze:
        numbered = numbered.filter(F.col("kind") != "analyze")
    return numbered.select(
        (F.col("file_id") * len(NEW_FILE_KINDS) + F.col("place")).alias("work_id"),
        "file_id",
        "kind",
        F.lit("pending").alias("status"),
        F.lit(0).alias("priority"),
        F.lit(0).alias("attempts"),
        F.lit(max_attempts).alias("max_attempts"),
        nothing.cast("string").alias("error"),
        nothing.cast("string").alias("worker_id"),
        ntz(created_at).alias("created_at"),
        nothing.cast("timestamp_ntz").alias("started_at"),
        nothing.cast("timestamp_ntz").alias("finished_at"),
    )


def missing_work(
    inventory: DataFrame,
    ledger: DataFrame,
    created_at: datetime,
    max_attempts: int = DEFAULT_MAX_ATTEMPTS,
) -> DataFrame:
    """Work items for files the ledger knows nothing of; run again, it adds nothing."""
    # Made distinct before the shuffle, so a file with most of the work is one row per task.
    known = ledger.select("file_id").distinct()
    unknown = inventory.select("file_id").join(known, "file_id", "left_anti")
    return work_fan_out(unknown, created_at, max_attempts)


def promote(ledger: DataFrame, count_attempt: bool = False) -> DataFrame:
    """Queue what is pending, and what may be tried again; `changed` marks the rows touched.

    `record_outcomes` already counts a failed attempt. Only a ledger kept without it should count
    here as well, else every failure counts twice.
    """
    pending = F.col("status") == "pending"
    again = (F.col("status") == "retry") & (F.col("attempts") < F.col("max_attempts"))
    changed = F.coalesce(pending | again, F.lit(False))
    attempts = F.col("attempts") + F.when(again, 1).otherwise(0) if count_attempt else F.col("attempts")
    return ledger.withColumns(
        {
            "changed": changed,
            "attempts": attempts,
            "status": F.when(changed, F.lit("queued")).otherwise(F.col("status")),
        }
    )


def rows_changed(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if("changed").alias("changed"))


def prioritize(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """Give queued work the priority of its file's size; other rows stay as they are.

    Only queued rows meet the inventory, reduced to id and size. `changed` marks the rows with a
    file, as an update through a join would count them.
    """
    queued = F.coalesce(F.col("status") == "queued", F.lit(False))
    sized = (
        ledger.filter(queued)
        .join(inventory.select("file_id", "size"), "file_id", "left")
        .withColumn("changed", F.col("size").isNotNull())
        .withColumn(
            "priority",
            F.when(F.col("changed"), size_priority(F.col("size"))).otherwise(F.col("priority")),
        )
    )
    others = ledger.filter(~queued).withColumn("changed", F.lit(False))
    return sized.select(*ledger.columns, "changed").unionByName(others)


def next_work_batch(ledger: DataFrame, size: int = 100, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """The next `size` queued items of each kind, highest priority first, lower id on ties.

    Every kind there is counts, an unknown or missing one too; a missing priority comes last. Ids are
    unique. Each task first keeps its own best rows, so a kind with most of the work still sends only
    `size` rows per task to the shuffle. For a batch larger than Spark does this for, the place of the
    last item is found by counting (`selection.last_of_first`), first its priority, then, among items
    of that priority, its id; the batch is what lies no further, and nothing is sorted or numbered.
    Both forms give the same rows.
    """
    queued = ledger.filter(F.col("status") == "queued")
    threshold = ledger.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    if size <= int(threshold):
        order = [F.desc_nulls_last("priority"), F.asc("work_id")]
        place = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
        return queued.withColumn("_place", place).filter(F.col("_place") <= size).drop("_place")
    # In a struct a missing kind is a key like any other; priorities are ints, so one more is last.
    keyed = queued.withColumns(
        {"_kind": F.struct("kind"), "_rank": F.coalesce(-F.col("priority").cast("bigint"), F.lit(2**31 + 1))}
    )
    slim = cut_lineage(keyed.select("_kind", "_rank", "work_id"))
    ranks = last_of_first(slim.select("_kind", F.col("_rank").alias("value")), "_kind", F.lit(size), window_rows)
    ranks = cut_lineage(ranks.select("_kind", "rows", F.col("last").alias("_last_rank"), (size - F.col("before")).alias("wanted")))
    tied = join_groups(slim, ranks.drop("wanted"), "_kind", "rows", "work_id").filter("_rank = _last_rank")
    wanted = ranks.select("_kind", "wanted")
    ids = last_of_first(tied.select("_kind", F.col("work_id").alias("value")), "_kind", wanted, window_rows)
    ends = ranks.join(ids.select("_kind", F.col("last").alias("_last_id")), "_kind")
    met = join_groups(keyed, ends.select("_kind", "rows", "_last_rank", "_last_id"), "_kind", "rows", "work_id")
    return met.filter("_rank < _last_rank or _rank = _last_rank and work_id <= _last_id").select(*queued.columns)


def start_work(ledger: DataFrame, batch: DataFrame, worker: str, at: datetime) -> DataFrame:
    """Mark the items of a batch as running."""
    taken = batch.select("work_id").distinct().withColumn("_taken", F.lit(True))
    mark = F.col("_taken").isNotNull()
    return (
        ledger.join(taken, "work_id", "left")
        .withColumns(
            {
                "status": F.when(mark, F.lit("running")).otherwise(F.col("status")),
                "worker_id": F.when(mark, F.lit(worker)).otherwise(F.col("worker_id")),
                "started_at": F.when(mark, ntz(at)).otherwise(F.col("started_at")),
            }
        )
        .select(*ledger.columns)
    )


def record_outcomes(
    ledger: DataFrame, outcomes: DataFrame, inventory: DataFrame, at: datetime
) -> DataFrame:
    """Fold (work_id, success, message) into the running items of a ledger.

    Success ends an item. A failure counts an attempt and leaves it to be retried, or in error
    once the attempts are used up. An item whose file is not in the inventory has failed, told of
    or not; any other running item without an outcome is left running.
    """
    running = F.coalesce(F.col("status") == "running", F.lit(False))
    # Told of twice, an item counts once, and success goes before failure.
    told = (
        outcomes.groupBy("work_id")
        .agg(F.max(F.struct("success", "message")).alias("_told"))
        .select("work_id", "_told.success", "_told.message")
    )
    known = inventory.select("file_id", F.lit(True).alias("_known"))
    # Only running rows meet the outcomes and the inventory.
    items = ledger.filter(running).join(told, "work_id", "left").join(known, "file_id", "left")
    lost = F.col("_known").isNull()
    ended = lost | F.col("success").isNotNull()
    failed = lost | ~F.col("success")
    message = F.when(lost, F.lit(NO_SUCH_FILE)).otherwise(F.col("message"))
    attempts = F.col("attempts") + 1
    after_failure = F.when(attempts >= F.col("max_attempts"), F.lit("error")).otherwise(
        F.lit("retry")
    )
    folded = items.withColumns(
        {
            "status": F.when(failed, after_failure)
            .when(ended, F.lit("done"))
            .otherwise(F.col("status")),
            "attempts": F.when(failed, attempts).otherwise(F.col("attempts")),
            "error": F.when(failed, message).otherwise(F.col("error")),
            "finished_at": F.when(ended, ntz(at)).otherwise(F.col("finished_at")),
        }
    )
    return folded.select(*ledger.columns).unionByName(ledger.filter(~running))


def outcome_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many running items of `before` were processed and how many failed."""
    ran = before.filter(F.col("status") == "running").select("work_id")
    ended = after.select("work_id", "status").join(ran, "work_id", "left_semi")
    return ended.agg(
        F.count_if(F.col("status") == "done").alias("processed"),
        F.count_if(F.col("status").isin("retry", "error")).alias("errors"),
    )


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """Number of items per kind and status."""
    return ledger.groupBy("kind", "status").agg(F.count("*").alias("items"))


def ledger_stats_by_kind(ledger: DataFrame) -> DataFrame:
    """One row per kind with a column per status."""
    return ledger.groupBy("kind").agg(
        *[F.count_if(F.col("status") == status).alias(status) for status in STATUSES]
    )


def prune_orphans(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """Work items whose file the inventory still has."""
    return ledger.join(inventory.select("file_id"), "file_id", "left_semi").select(*ledger.columns)


def work_left(ledger: DataFrame) -> DataFrame:
    """Items neither done nor out of attempts."""
    ended = (F.col("status") == "done") | (F.col("status") == "error")
    spent = (F.col("status") == "retry") & (F.col("attempts") >= F.col("max_attempts"))
    return ledger.filter(~(ended | spent))
