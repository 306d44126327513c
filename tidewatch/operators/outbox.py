"""The delivery outbox as set-based state transitions.

Each function takes state tables and returns the rows it would change, with the
new values in ``set_`` columns (see ``lifecycle.apply_updates``). The limits are
the batch sizes of a maintenance cycle; what a batch leaves is taken by the next.
While the pipeline is aborting (``aborting``), nothing is queued, published,
recovered or taken back, and clearing is refused.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import backoff_seconds, derived_id, plus_seconds
from tidewatch.operators.anomalies import OPEN, moment
from tidewatch.operators.skew import lookup

# Message version, attempt limits, leases and statuses.
MESSAGE_VERSION = 1
MAX_DELIVERY_ATTEMPTS = 6
MAX_REQUEST_ATTEMPTS = 3
REQUEST_LEASE = timedelta(seconds=30)
REQUEST_UNCERTAIN_AFTER = timedelta(minutes=59)
CLAIM_LEASE = timedelta(seconds=30)
SCHEDULED_LEASE = timedelta(minutes=10)
UNSETTLED = ["pending", "failed", "sending", "uncertain"]
DELIVERED_REQUEST = ["sent", "resolved", "timed_out", "update_failed"]
ACTIVE_JOB = ["pending_publish", "publishing", "kafka_queued", "dispatching", "ds_scheduled", "executing", "sending", "failed"]
ABORTABLE_JOB = ["pending_publish", "kafka_queued", "ds_scheduled", "executing", "failed"]
# Texts of the timeline rows of called-off pushes.
ABORTED_TEXT = "未发送的异常推送已由管理员中止"
CLEARED_TEXT = "管理员清除在途推送，已取消记录及所在组的待发送推送"
NOT_CONSUMABLE = ["ds_scheduled", "executing", "sending", "sent", "failed", "aborted"]


class PipelinePaused(RuntimeError):
    """The pipeline is aborting; nothing may be cleared until it is done."""


def _unless(aborting: bool, df: DataFrame) -> DataFrame:
    return df.filter(F.lit(not aborting))


def delivery_states(notifications: DataFrame, requests: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """All deliveries in one shape, so that jobs need a single join on (kind, id)."""
    never = F.lit(None).cast("timestamp_ntz")
    return (
        notifications.select(
            F.lit("notification").alias("kind"), F.col("id").alias("delivery_id"),
            F.col("status").alias("delivery_status"), "attempts", never.alias("delivery_next_at"),
        )
        .unionByName(
            requests.select(
                F.lit("validation").alias("kind"), F.col("id").alias("delivery_id"), "delivery_status",
                F.col("delivery_attempts").alias("attempts"), F.col("next_attempt_at").alias("delivery_next_at"),
            )
        )
        .unionByName(
            broadcasts.select(
                F.lit("group_broadcast").alias("kind"), F.col("id").alias("delivery_id"),
                F.col("status").alias("delivery_status"), "attempts", F.col("next_attempt_at").alias("delivery_next_at"),
            )
        )
    )


def with_delivery(jobs: DataFrame, states: DataFrame) -> DataFrame:
    return jobs.join(states, ["kind", "delivery_id"], "left")


def _not_later(column: Column, now) -> Column:
    return column.isNull() | (column <= moment(now))


def in_transit(jobs: DataFrame, states: DataFrame, generation: int) -> DataFrame:
    """Distinct anomalies with an unsettled notification or request under way."""
    current = jobs.filter(
        (F.col("generation") == generation)
        & ~F.col("cancel_requested")
        & ~F.col("status").isin("sent", "aborted")
        & F.col("kind").isin("notification", "validation")
    )
    unsettled = states.filter(F.col("delivery_status").isin(*UNSETTLED)).select("kind", "delivery_id")
    return current.join(unsettled, ["kind", "delivery_id"], "left_semi").select("anomaly_id").distinct()


def due_requests(
    requests: DataFrame, now, limit: int | None = None, by_update: bool = False,
    request_ids: DataFrame | None = None, rule_id: str | None = None, records: DataFrame | None = None,
) -> DataFrame:
    """Requests that may be sent now, oldest due first (``by_update``: longest untouched first).

    ``request_ids`` (``id``) and ``rule_id`` (of the record, for which ``records`` is
    needed) narrow the batch; an empty ``request_ids`` leaves nothing.
    """
    at = moment(now)
    ready = _not_later(F.col("next_attempt_at"), now)
    stale = (
        F.col("send_started_at").isNull()
        | (F.col("send_started_at") <= at - F.lit(REQUEST_UNCERTAIN_AFTER))
        | ((F.col("delivery_attempts") < MAX_REQUEST_ATTEMPTS) & (F.col("updated_at") <= at - F.lit(REQUEST_LEASE)) & ready)
    )
    due = requests.filter(
        (F.col("delivery_status").isin("pending", "failed") & ready)
        | ((F.col("delivery_status") == "sending") & stale)
    )
    if request_ids is not None:
        due = due.join(request_ids.select("id"), "id", "left_semi")
    if rule_id is not None:
        of_rule = records.filter(F.col("rule_id") == rule_id).select(F.col("id").alias("anomaly_id"))
        due = due.join(of_rule, "anomaly_id", "left_semi")
    if limit is None:
        return due
    order = ["updated_at", "id"] if by_update else [F.coalesce("next_attempt_at", "created_at"), "updated_at", "id"]
    return due.orderBy(*order).limit(limit)


def due_notifications(notifications: DataFrame, records: DataFrame, limit: int | None = None) -> DataFrame:
    """Unsent notifications of open records with attempts left."""
    open_records = records.filter(F.col("status").isin(*OPEN)).select(F.col("id").alias("anomaly_id"))
    due = notifications.filter(
        F.col("status").isin("pending", "failed") & (F.col("attempts") < MAX_DELIVERY_ATTEMPTS)
    ).join(open_records, "anomaly_id", "left_semi")
    return due if limit is None else due.orderBy("updated_at", "id").limit(limit)


def due_broadcasts(broadcasts: DataFrame, limit: int | None = None) -> DataFrame:
    due = broadcasts.filter(F.col("status").isin("pending", "failed") & (F.col("attempts") < MAX_DELIVERY_ATTEMPTS))
    return due if limit is None else due.orderBy("updated_at", "id").limit(limit)


def queue_jobs(due: DataFrame, jobs: DataFrame, kind: str, generation: int, now, aborting: bool = False) -> DataFrame:
    """Jobs to insert (none yet) or requeue (failed, uncancelled and due).

    Output: job id, anomaly, kind, delivery, ``action`` and the new state.
    """
    owner = F.col("anomaly_id") if "anomaly_id" in due.columns else F.lit(None).cast("string")
    wanted = _unless(aborting, due).select(F.col("id").alias("delivery_id"), owner.alias("owner"))
    mine = jobs.filter(F.col("kind") == kind).select(
        F.col("id").alias("job_id"), "delivery_id", F.col("status").alias("job_status"), "cancel_requested",
        F.col("next_attempt_at").alias("job_next_at"),
    )
    joined = wanted.join(mine, "delivery_id", "left")
    retry = (F.col("job_status") == "failed") & ~F.col("cancel_requested") & _not_later(F.col("job_next_at"), now)
    action = F.when(F.col("job_id").isNull(), "insert").when(retry, "requeue")
    return joined.withColumn("action", action).filter(F.col("action").isNotNull()).select(
        F.coalesce("job_id", derived_id(F.lit("job"), F.lit(kind), F.col("delivery_id"))).alias("id"),
        F.col("owner").alias("anomaly_id"),
        F.lit(kind).alias("kind"),
        "delivery_id",
        "action",
        F.lit("pending_publish").alias("set_status"),
        F.lit(generation).alias("set_generation"),
    )


def job_message() -> Column:
    return F.to_json(
        F.struct(
            F.lit(MESSAGE_VERSION).alias("version"),
            F.col("id").alias("job_id"),
            F.col("generation"),
            F.col("kind"),
        )
    )


def publishable(jobs: DataFrame, generation: int, limit: int = 50, aborting: bool = False) -> DataFrame:
    """The next batch to publish: ``key``, ``value`` and the job's new state.

    The batch is the oldest pending jobs; among them, cancelled ones and those
    of another generation are passed over.
    """
    batch = jobs.filter(F.col("status") == "pending_publish").orderBy("created_at", "id").limit(limit)
    current = _unless(aborting, batch).filter((F.col("generation") == generation) & ~F.col("cancel_requested"))
    return current.select(
        F.col("id").alias("key"),
        job_message().alias("value"),
        F.lit("kafka_queued").alias("set_status"),
        (F.col("publish_attempts") + 1).alias("set_publish_attempts"),
        F.lit(None).cast("timestamp_ntz").alias("set_next_attempt_at"),
    )


def write_messages(messages: DataFrame, target: str, options: dict[str, str], fmt: str = "kafka") -> None:
    """Hand messages to a sink: ``kafka`` (with its package) or any file format."""
    rows = messages.select("key", "value")
    if fmt == "kafka":
        rows.write.format("kafka").options(**options).option("topic", target).save()
    else:
        rows.write.format(fmt).options(**options).mode("append").save(target)


def completed_status(kind: Column, delivery_status: Column) -> Column:
    """The job state that a settled delivery implies, null while unsettled."""
    return (
        F.when(delivery_status == "uncertain", "uncertain")
        .when((kind == "notification") & (delivery_status == "sent"), "sent")
        .when((kind == "validation") & delivery_status.isin(*DELIVERED_REQUEST), "sent")
        .when((kind == "group_broadcast") & (delivery_status == "sent"), "sent")
        .when(delivery_status == "aborted", "aborted")
    )


def classify_messages(messages: DataFrame, jobs: DataFrame, states: DataFrame, generation: int, aborting: bool = False, bounded: bool = False) -> DataFrame:
    """What to do with each consumed message (``value`` JSON); a stream calls it per micro-batch.

    The tests apply in order: invalid, duplicate, paused, in progress,
    duplicate, reconciled, dispatch. Only the jobs that are spoken of are looked into. They are looked up
    skew-safely, as one job's message may be delivered any number of times; a ``bounded`` batch, whose jobs are
    few, is joined with them as it is.
    """
    event = F.from_json("value", "version int, job_id string, generation int, kind string")
    parsed = messages.withColumn("event", F.explode(F.array(event))).withColumn("job_id", F.col("event.job_id"))
    told = parsed.select(F.col("job_id").alias("id")).distinct()
    known = with_delivery(jobs.join(told, "id", "left_semi"), states).select(
        F.col("id").alias("job_id"), F.col("generation").alias("job_generation"), F.col("kind").alias("job_kind"),
        F.col("status").alias("job_status"), "cancel_requested", "delivery_status",
    )
    found = ["job_generation", "job_kind", "job_status", "cancel_requested", "delivery_status"]
    joined = parsed.join(known, "job_id", "left") if bounded else lookup(parsed, known, ["job_id"], found, messages.columns)
    done = completed_status(F.col("job_kind"), F.col("delivery_status"))
    differs = (
        ~F.col("event.generation").eqNullSafe(F.col("job_generation"))
        | F.col("cancel_requested")
        | ~F.col("event.kind").eqNullSafe(F.col("job_kind"))
        | F.col("job_status").isin(*NOT_CONSUMABLE)
        | (F.col("job_generation") != generation)
    )
    verdict = (
        F.when(~F.col("event.version").eqNullSafe(F.lit(MESSAGE_VERSION)) | F.col("job_status").isNull(), "invalid")
        .when(differs, "duplicate")
        .when(F.lit(aborting), "paused")
        .when(F.col("job_status").isin("publishing", "dispatching"), "in_progress")
        .when(F.col("job_status") != "kafka_queued", "duplicate")
        .when(done.isNotNull(), "reconciled")
        .otherwise("dispatch")
    )
    return joined.select(*messages.columns, "job_id", verdict.alias("verdict"), done.alias("completed_status"))


def reconcile(jobs: DataFrame, states: DataFrame, generation: int, limit: int | None = 50) -> DataFrame:
    """Open jobs whose delivery already settled, with their final state."""
    open_jobs = jobs.filter(
        (F.col("generation") == generation)
        & ~F.col("cancel_requested")
        & ~F.col("status").isin("sent", "uncertain", "aborted")
    )
    if limit is not None:
        open_jobs = open_jobs.orderBy("updated_at", "id").limit(limit)
    status = completed_status(F.col("kind"), F.col("delivery_status"))
    return (
        with_delivery(open_jobs, states)
        .withColumn("set_status", status)
        .filter(F.col("set_status").isNotNull())
        .select("id", "kind", "set_status")
    )


def aborted_delivery(status: Column) -> Column:
    """A delivery's state after its job is called off; null when unchanged."""
    return F.when(status.isin("pending", "failed"), "aborted").when(status == "sending", "uncertain")


def stale_jobs(
    jobs: DataFrame, states: DataFrame, generation: int, now, http_timeout_seconds: float, limit: int | None = 50, aborting: bool = False
) -> DataFrame:
    """Jobs whose claim ran out, with the next state of job and delivery."""
    at = moment(now)
    send_lease = timedelta(seconds=http_timeout_seconds * 3 + 2)
    stale = _unless(aborting, jobs).filter(
        (F.col("status").isin("executing", "sending") & (F.col("updated_at") <= at - F.lit(send_lease)))
        | (F.col("status").isin("publishing", "dispatching") & (F.col("updated_at") <= at - F.lit(CLAIM_LEASE)))
        | ((F.col("status") == "ds_scheduled") & (F.col("updated_at") <= at - F.lit(SCHEDULED_LEASE)))
    )
    if limit is not None:
        stale = stale.orderBy("updated_at", "id").limit(limit)
    joined = with_delivery(stale, states)
    kind, delivery, status = F.col("kind"), F.col("delivery_status"), F.col("status")
    done = completed_status(kind, delivery)
    called_off = aborted_delivery(delivery)
    old_batch = F.col("generation") != generation
    sending = status.isin("executing", "sending")
    unsure = sending & kind.isin("notification", "group_broadcast") & (delivery == "sending")
    next_status = (
        F.when(F.col("cancel_requested"), F.coalesce(completed_status(kind, F.coalesce(called_off, delivery)), F.lit("aborted")))
        .when(old_batch, "aborted")
        .when(status == "publishing", "pending_publish")
        .when(status == "dispatching", "kafka_queued")
        .when(status == "ds_scheduled", "pending_publish")
        .when(done.isNotNull(), done)
        .when((kind == "validation") & (delivery == "sending"), "failed")
        .when(unsure, "uncertain")
        .otherwise("pending_publish")
    )
    next_delivery = F.when(F.col("cancel_requested") | old_batch, called_off).when(unsure, "uncertain")
    return joined.select(
        "id", kind, "delivery_id", status, next_status.alias("set_status"), next_delivery.alias("set_delivery_status")
    )


def abort_generation(jobs: DataFrame, states: DataFrame, generation: int) -> DataFrame:
    """Jobs touched by raising the generation to ``generation``.

    Active older jobs are marked cancelled; those not mid-flight are aborted
    together with their unsent deliveries.
    """
    older = jobs.filter((F.col("generation") < generation) & F.col("status").isin(*ACTIVE_JOB))
    joined = with_delivery(older, states)
    aborts = F.col("status").isin(*ABORTABLE_JOB)
    return joined.select(
        "id",
        "kind",
        "anomaly_id",
        "delivery_id",
        F.col("status"),
        "delivery_status",
        F.lit(True).alias("set_cancel_requested"),
        F.when(aborts, "aborted").otherwise(F.col("status")).alias("set_status"),
        F.when(aborts, aborted_delivery(F.col("delivery_status"))).alias("set_delivery_status"),
    )


def abort_counts(touched: DataFrame) -> DataFrame:
    """Aborted jobs, and aborted deliveries by kind."""
    hit = F.col("set_delivery_status") == "aborted"
    return touched.filter(F.col("set_status") == "aborted").agg(
        F.count(F.lit(1)).alias("aborted_jobs"),
        F.count_if(hit & (F.col("kind") == "notification")).alias("aborted_notifications"),
        F.count_if(hit & (F.col("kind") == "validation")).alias("aborted_validations"),
        F.count_if(hit & (F.col("kind") == "group_broadcast")).alias("aborted_group_broadcasts"),
    )


def abort_events(touched: DataFrame, now) -> DataFrame:
    """One timeline row per anomaly that lost a job."""
    owners = touched.filter((F.col("set_status") == "aborted") & F.col("anomaly_id").isNotNull()).select("anomaly_id").distinct()
    return owners.select(
        "anomaly_id",
        F.lit("push_aborted").alias("event_type"),
        F.lit(ABORTED_TEXT).alias("description"),
        moment(now).alias("created_at"),
    )


def cancel_pushes(jobs: DataFrame, states: DataFrame, members: DataFrame, broadcasts: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs to cancel for the given anomalies (``anomaly_id``).

    Their own jobs, and the broadcast jobs of every group they belong to. Jobs
    whose delivery already went out are left alone; running ones are only marked.
    """
    wanted = ids.select("anomaly_id").distinct()
    groups = members.join(wanted, "anomaly_id", "left_semi").select("rule_id", "detected_at").distinct()
    shared = broadcasts.join(groups, ["rule_id", "detected_at"], "left_semi").select(
        F.lit("group_broadcast").alias("kind"), F.col("id").alias("delivery_id")
    )
    live = jobs.filter(~F.col("status").isin("sent", "aborted") & ~F.col("cancel_requested"))
    own = live.join(wanted, "anomaly_id", "left_semi")
    in_group = live.filter(F.col("anomaly_id").isNull()).join(shared, ["kind", "delivery_id"], "left_semi")
    joined = with_delivery(own.select(*jobs.columns).unionByName(in_group.select(*jobs.columns)), states)
    kind, delivery = F.col("kind"), F.col("delivery_status")
    running = F.col("status").isin("executing", "sending")
    called_off = aborted_delivery(delivery)
    after = F.coalesce(called_off, delivery)
    kept = joined.filter(~F.coalesce(completed_status(kind, delivery) == "sent", F.lit(False)))
    return kept.select(
        "id",
        kind,
        "anomaly_id",
        "delivery_id",
        F.lit(True).alias("set_cancel_requested"),
        F.when(running, F.col("status"))
        .otherwise(F.coalesce(completed_status(kind, after), F.lit("aborted")))
        .alias("set_status"),
        F.when(running & ~F.col("delivery_status").isin("pending", "failed"), F.lit(None).cast("string"))
        .otherwise(called_off)
        .alias("set_delivery_status"),
    )


def cancel_deliveries(
    jobs: DataFrame, notifications: DataFrame, requests: DataFrame, broadcasts: DataFrame, members: DataFrame, ids: DataFrame
) -> DataFrame:
    """Deliveries to call off for the given anomalies (``anomaly_id``), whether or not they have a job.

    All unsent notifications and requests of the records and broadcasts of their groups;
    one being sent becomes uncertain when its waiting job is cancelled. What is off or
    uncertain is not tried again: its ``next_attempt_at`` is cleared.
    """
    wanted = ids.select("anomaly_id").distinct()
    groups = members.join(wanted, "anomaly_id", "left_semi").select("rule_id", "detected_at").distinct()
    never = F.lit(None).cast("timestamp_ntz").alias("next_attempt_at")
    owned = (
        notifications.join(wanted, "anomaly_id", "left_semi")
        .select(F.lit("notification").alias("kind"), F.col("id").alias("delivery_id"), F.col("status"), never)
        .unionByName(
            requests.join(wanted, "anomaly_id", "left_semi").select(
                F.lit("validation").alias("kind"), F.col("id").alias("delivery_id"), F.col("delivery_status").alias("status"), "next_attempt_at"
            )
        )
        .unionByName(
            broadcasts.join(groups, ["rule_id", "detected_at"], "left_semi").select(
                F.lit("group_broadcast").alias("kind"), F.col("id").alias("delivery_id"), "status", "next_attempt_at"
            )
        )
    )
    waiting = jobs.filter(~F.col("status").isin("sent", "aborted", "executing", "sending") & ~F.col("cancel_requested"))
    waiting = waiting.select("kind", "delivery_id", F.lit(True).alias("waits")).distinct()
    after = (
        F.when(F.col("status").isin("pending", "failed"), "aborted")
        .when((F.col("status") == "sending") & F.col("waits"), "uncertain")
        .otherwise(F.col("status"))
    )
    settled = owned.join(waiting, ["kind", "delivery_id"], "left").withColumn("set_status", after)
    over = F.col("set_status").isin("aborted", "sending", "uncertain")
    return settled.withColumn("set_next_attempt_at", F.when(~over, F.col("next_attempt_at"))).filter(
        (F.col("set_status") != F.col("status")) | ~F.col("set_next_attempt_at").eqNullSafe(F.col("next_attempt_at"))
    ).select("kind", "delivery_id", "status", "set_status", "set_next_attempt_at")


def cancel_events(ids: DataFrame, now) -> DataFrame:
    """One timeline row per anomaly whose pushes are cleared."""
    return ids.select("anomaly_id").distinct().select(
        "anomaly_id", F.lit("push_aborted").alias("event_type"), F.lit(CLEARED_TEXT).alias("description"), moment(now).alias("created_at")
    )


def recover_failed(jobs: DataFrame, states: DataFrame, records: DataFrame, generation: int, now, aborting: bool = False) -> DataFrame:
    """Failed jobs with ``requeue``: whether they may go out again now, and their new state."""
    failed = jobs.filter(F.col("status") == "failed")
    openness = records.select(F.col("id").alias("anomaly_id"), F.col("status").isin(*OPEN).alias("is_open"))
    joined = with_delivery(failed, states).join(openness, "anomaly_id", "left")
    unsent = F.col("delivery_status").isin("pending", "failed")
    tries = F.col("attempts") < MAX_DELIVERY_ATTEMPTS
    later = _not_later(F.col("delivery_next_at"), now)
    retryable = (
        F.when(F.col("kind") == "notification", unsent & tries & F.col("is_open"))
        .when(F.col("kind") == "validation", unsent & later & F.col("is_open"))
        .when(F.col("kind") == "group_broadcast", unsent & tries & later)
    )
    mine = (F.col("generation") == generation) & ~F.col("cancel_requested") & _not_later(F.col("next_attempt_at"), now)
    again = F.coalesce(mine & retryable & F.lit(not aborting), F.lit(False))
    return joined.select(
        "id", "kind", again.alias("requeue"), F.when(again, "pending_publish").otherwise(F.col("status")).alias("set_status"),
        F.when(~again, F.col("next_attempt_at")).alias("set_next_attempt_at"),
    )


def recover_counts(recovered: DataFrame) -> DataFrame:
    again = F.col("requeue")
    return recovered.agg(
        F.count_if(again).alias("requeued_jobs"),
        F.count_if(again & (F.col("kind") == "notification")).alias("requeued_notifications"),
        F.count_if(again & (F.col("kind") == "validation")).alias("requeued_validations"),
        F.count_if(again & (F.col("kind") == "group_broadcast")).alias("requeued_group_broadcasts"),
        F.count_if(~again).alias("skipped_jobs"),
    )


def next_dispatch_at(failed_at: Column, dispatch_attempts: Column) -> Column:
    return plus_seconds(failed_at, backoff_seconds(dispatch_attempts))


def card_refresh(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests whose message shows an outdated state or result."""
    state = records.select(F.col("id").alias("anomaly_id"), F.col("status"), "validation_result_version")
    joined = requests.filter(F.col("message_id").isNotNull()).join(state, "anomaly_id")
    shown = F.col("delivery_status")
    outdated = (
        ((F.col("status") == "timed_out") & shown.isin("sent", "update_failed"))
        | ((F.col("status") == "resolved") & shown.isin("sent", "timed_out", "update_failed"))
        | (
            (F.col("synced_result_version") < F.col("validation_result_version"))
            & shown.isin("sent", "timed_out", "resolved", "update_failed")
        )
    )
    return joined.filter(outdated).select("id", "anomaly_id", "delivery_status", "status", "updated_at")


def clear_in_transit(
    jobs: DataFrame, states: DataFrame, members: DataFrame, broadcasts: DataFrame, records: DataFrame, generation: int, user_id: str,
    aborting: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cancel everything under way: jobs to cancel, and decisions that resolve the records.

    Deliveries and timeline rows follow from ``cancel_deliveries`` and ``cancel_events``
    for the ids of ``in_transit``.
    """
    from tidewatch.operators.lifecycle import decide_transitions

    if aborting:
        raise PipelinePaused("pushes are being aborted; try again later")
    ids = in_transit(jobs, states, generation)
    cancelled = cancel_pushes(jobs, states, members, broadcasts, ids)
    wishes = ids.join(records.select(F.col("id").alias("anomaly_id")), "anomaly_id", "left_semi").select(
        F.col("anomaly_id").alias("id"),
        F.lit("resolved").alias("target_status"),
        F.lit("manual").alias("source"),
        F.lit(user_id).alias("user_id"),
    )
    return cancelled, decide_transitions(records, wishes)
