"""Bounded runs of planned actions for all companies at once.

What is known of an action's cache key is a row of state: whether it has
succeeded, when it was last tried, how often. A cycle joins the plan to the
state, hands what is due to a handler, and appends the records and the changed
state to ledgers under the cycle's name, so a cycle that is run again after a
failure adds nothing. Companies leave the run on their own: the loop is over
cycles, of which there are few, never over companies or actions.

A handler is a function of the due actions as a DataFrame. It returns
(action_id, attempts, succeeded, error), a row for each action that it tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timezone

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from . import gaps as gp

STATE = "cache_key string, succeeded boolean, last_attempt_at timestamp, attempts long"
RECORD = "record_id string, cycle int, company_id string, action_id string, action_kind string, status string, attempts int, reason string, executed_at timestamp, next_eligible_at timestamp"
OUTCOME = "action_id string, attempts int, succeeded boolean, error string"
STOP = "company_id string, stop string, cycles int"

#: Why an action got its status.
REASONS = {
    "malformed": "planned READY action lacks finite retry/cache metadata",
    "cached": "successful action result already cached",
    "waits": "minimum interval has not elapsed",
    "unhandled": "no explicit handler supplied for planned known action",
    "done": "known action handler completed",
    "failed": "handler failed after bounded retries: ",
}

Handler = Callable[[DataFrame], DataFrame]
Planner = Callable[[], tuple[DataFrame, DataFrame]]


def calling(functions: Mapping[str, Callable[[dict], None]]) -> Handler:
    """A handler that calls a function for each action's kind in the tasks, with bounded retries.

    A function gets the action as a dict and raises if it fails. As Spark may run a
    task again, it must bear being called again.
    """

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a in batch.to_dict("records"):
                error, n = None, 0
                for n in range(1, int(a["max_attempts"]) + 1):
                    try:
                        functions[a["action_kind"]](a)
                    except Exception as e:  # noqa: BLE001  a function may fail in any way
                        error = str(e)
                    else:
                        error = None
                        break
                out.append((a["action_id"], n, error is None, error))
            yield pd.DataFrame(out, columns=["action_id", "attempts", "succeeded", "error"])

    return lambda due: due.mapInPandas(tried, OUTCOME)


def captured(tries: DataFrame) -> Handler:
    """A handler that takes what became of each try from a table (action_id, try, succeeded, error).

    ``try`` counts from 1 over all cycles. A try that the table lacks has failed.
    """

    def found(due: DataFrame) -> DataFrame:
        own = due.select("action_id", "max_attempts", F.coalesce("tried", F.lit(0)).alias("tried"))
        t = tries.select(F.col("action_id").alias("_a"), F.col("try").alias("_t"), F.col("succeeded").alias("_ok"), F.col("error").alias("_e"))
        within = (F.col("_a") == F.col("action_id")) & (F.col("_t") > F.col("tried")) & (F.col("_t") <= F.col("tried") + F.col("max_attempts"))
        both = own.join(t, within, "left").groupBy("action_id", "max_attempts", "tried")
        both = both.agg(F.min(F.when(F.col("_ok"), F.col("_t"))).alias("ok"), F.max_by("_e", "_t").alias("last"))
        won = F.col("ok").isNotNull()
        return both.select(
            "action_id",
            F.when(won, F.col("ok") - F.col("tried")).otherwise(F.col("max_attempts")).cast("int").alias("attempts"),
            won.alias("succeeded"),
            F.when(~won, F.coalesce("last", F.lit("no response"))).alias("error"),
        )

    return found


def _rank() -> Column:
    """The place of an action in its plan, as a value that orders it."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct("gap_id", "disposition", blank("action_kind"), blank("locator"), "action_id")


def decided(plan: DataFrame, state: DataFrame, now: Column, handled: list[str]) -> DataFrame:
    """The plan with its status before anything is tried, in the order within each cache key.

    DUE actions may be tried. ``after`` holds the rank of the key's first DUE
    action: a later one of the same key depends on what becomes of it.
    """
    sound = F.col("cache_key").isNotNull() & (F.col("max_attempts") >= 1)
    known = gp.status(plan.withColumn("_r", _rank()), state, now, handled)
    s = F.when((F.col("disposition") == "READY") & ~F.coalesce(sound, F.lit(False)), "MALFORMED").otherwise(F.col("status"))
    known = known.withColumn("status", s).withColumnRenamed("attempts", "tried")
    first = known.where("status = 'DUE'").groupBy("cache_key").agg(F.min("_r").alias("after"))
    return known.join(first, "cache_key", "left")


def tried(decisions: DataFrame) -> DataFrame:
    """What a handler gets: the first due action of each key, and later ones that need not wait."""
    again = (F.col("_r") > F.col("after")) & (F.col("min_interval_seconds") > 0)
    return decisions.where(F.col("status") == "DUE").where(~again).drop("_r", "after", "status", "next_eligible_at")


def recorded(decisions: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """A record for each planned action, given the outcomes of those that were tried.

    Of one key, actions go in order: after a success the rest are cache hits;
    after a failure those with an interval wait, and the others are tried too.
    """
    own = outcomes.select("action_id", F.col("attempts").alias("_n"), F.col("succeeded").alias("_ok"), F.col("error").alias("_error"))
    d = decisions.join(own, "action_id", "left")
    won = d.where(F.col("_ok") & (F.col("status") == "DUE")).groupBy("cache_key").agg(F.min("_r").alias("won"))
    d = d.join(won, "cache_key", "left")
    later = F.coalesce(F.col("_r") > F.col("after"), F.lit(False))
    cached = later & F.coalesce(F.col("_r") > F.col("won"), F.lit(False))
    ready = F.col("disposition") == "READY"
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("min_interval_seconds").cast("decimal(18,6)"))
    waits = F.col("min_interval_seconds") > 0
    status = (
        F.when(~ready | (F.col("status") == "MALFORMED"), "BLOCKED")
        .when((F.col("status") == "CACHE_HIT") | cached, "CACHE_HIT")
        .when((F.col("status") == "SCHEDULED") | (later & waits), "SCHEDULED")
        .when(F.col("status") == "BLOCKED", "BLOCKED")
        .when(F.col("_ok"), "SUCCEEDED")
        .otherwise("FAILED")
    )
    reason = (
        F.when(~ready, F.col("reason"))
        .when(F.col("status") == "MALFORMED", REASONS["malformed"])
        .when(F.col("_s") == "CACHE_HIT", REASONS["cached"])
        .when(F.col("_s") == "SCHEDULED", REASONS["waits"])
        .when(F.col("_s") == "BLOCKED", REASONS["unhandled"])
        .when(F.col("_s") == "SUCCEEDED", REASONS["done"])
        .otherwise(F.concat(F.lit(REASONS["failed"]), F.coalesce("_error", F.lit(""))))
    )
    ran = F.col("_s").isin("SUCCEEDED", "FAILED")
    at = now.cast("timestamp")
    eligible = F.when((F.col("_s") == "SCHEDULED") & (F.col("status") == "SCHEDULED"), F.col("next_eligible_at")).when(waits & (F.col("_s").isin("SCHEDULED", "FAILED")), at + interval)
    if "reason" not in d.columns:
        d = d.withColumn("reason", F.lit("blocked"))
    return d.withColumn("_s", status).select(
        "company_id",
        "action_id",
        "action_kind",
        "cache_key",
        F.col("_s").alias("status"),
        F.when(ran, F.col("_n")).otherwise(0).cast("int").alias("attempts"),
        reason.alias("reason"),
        F.when(ran, at).alias("executed_at"),
        eligible.alias("next_eligible_at"),
    )


def moved(state: DataFrame, records: DataFrame) -> DataFrame:
    """The rows of state that a cycle's records change."""
    ran = records.where("executed_at is not null").groupBy("cache_key")
    new = ran.agg(F.bool_or(F.col("status") == "SUCCEEDED").alias("_ok"), F.max("executed_at").alias("_at"), F.sum("attempts").alias("_n"))
    return new.join(state, "cache_key", "left").select(
        "cache_key",
        (F.col("_ok") | F.coalesce("succeeded", F.lit(False))).alias("succeeded"),
        F.col("_at").alias("last_attempt_at"),
        (F.col("_n") + F.coalesce("attempts", F.lit(0))).alias("attempts"),
    )


class Runs:
    """Runs in one folder: ledgers of state, records and stops."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder = spark, folder.rstrip("/")
        made = lambda name, key, schema: Ledger.made(spark, f"{self.folder}/{name}", key, schema, buckets)
        self._state = made("state", "state_id", f"state_id string, cycle int, {STATE}")
        self._outcomes = made("outcomes", "outcome_id", f"outcome_id string, {OUTCOME}")
        self._records = made("records", "record_id", RECORD)
        self._stops = made("stops", "company_id", STOP)

    def state(self, before: int | None = None) -> DataFrame:
        """The state of each cache key, after all cycles or those before one."""
        rows = self._state.rows()
        rows = rows if before is None else rows.where(F.col("cycle") < before)
        return rows.groupBy("cache_key").agg(F.max_by(F.struct("succeeded", "last_attempt_at", "attempts"), "cycle").alias("x")).select("cache_key", "x.*")

    def records(self) -> DataFrame:
        return self._records.rows().drop("record_digest")

    def stops(self) -> DataFrame:
        """(company_id, stop, cycles) of each company that has left the run."""
        return self._stops.rows().drop("record_digest")

    def cycle(self, number: int, plan: DataFrame, handler: Handler, handled: list[str], now: datetime) -> DataFrame:
        """One batch of a plan over all its companies; its records.

        The handler's outcomes are written before anything is made of them, so
        they are made once, however often later steps read them. Decisions and records
        are kept on the executors' disks while the cycle lasts.
        """
        if now.tzinfo is None or now.utcoffset() is None:
            raise ValueError("the time of a cycle must name its offset")
        at = F.lit(now.astimezone(timezone.utc).isoformat()).cast("timestamp")
        state = self.state(before=number)
        named = f"{number}:"
        decisions = decided(plan, state, at, handled).persist(StorageLevel.DISK_ONLY)
        outcomes = handler(tried(decisions)).select(F.concat(F.lit(named), "action_id").alias("outcome_id"), "action_id", F.col("attempts").cast("int").alias("attempts"), "succeeded", "error")
        self._outcomes.append(outcomes, named)
        held = self._outcomes.rows().where(F.col("outcome_id").startswith(named))
        rows = recorded(decisions, held, at).persist(StorageLevel.DISK_ONLY)
        kept = rows.select(F.concat(F.lit(named), "action_id").alias("record_id"), F.lit(number).alias("cycle"), *[c for c in rows.columns if c != "cache_key"])
        self._records.append(kept, named)
        self._state.append(moved(state, rows).select(F.concat(F.lit(named), "cache_key").alias("state_id"), F.lit(number).alias("cycle"), "cache_key", "succeeded", "last_attempt_at", "attempts"), named)
        rows.unpersist()
        decisions.unpersist()
        return self.records().where(F.col("cycle") == number)

    def until_stable(self, companies: DataFrame, planner: Planner, handler: Handler, handled: list[str], clock: Callable[[], datetime], cycles: int = 3, after: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """(company_id, stop, cycles): plan and batch again for each company until it has no gap,
        nothing moves for it, or the cycles are used.

        ``planner`` gives (gaps, actions) of all companies from what is known at
        that time; ``after`` gets the companies for which an action succeeded.
        """
        if cycles < 1:
            raise ValueError("at least one cycle")
        active = lambda: companies.select("company_id").join(self.stops(), "company_id", "left_anti")
        for n in range(1, cycles + 1):
            now = active()
            gaps, plan = planner()
            records = self.cycle(n, plan.join(now, "company_id", "left_semi"), handler, handled, clock())
            progress = records.where("status = 'SUCCEEDED'").select("company_id").distinct()
            if after is not None:
                after(progress)
            left, _ = planner()
            flag = lambda rows, name: rows.select("company_id").distinct().withColumn(name, F.lit(True))
            each = now.join(flag(gaps, "_before"), "company_id", "left").join(flag(left, "_left"), "company_id", "left").join(flag(progress, "_moved"), "company_id", "left")
            why = F.when(F.col("_before").isNull(), "NO_GAPS").when(F.col("_left").isNull(), "GAPS_RESOLVED").when(F.col("_moved").isNull(), "NO_PROGRESS_OR_SCHEDULED")
            why = F.coalesce(why, F.lit("MAX_CYCLES_REACHED")) if n == cycles else why
            used = F.when(F.col("_before").isNull(), n - 1).otherwise(n)
            self._stops.append(each.select("company_id", why.alias("stop"), used.alias("cycles")).where("stop is not null"), f"{n}:")
            if n < cycles and active().isEmpty():
                break
        return self.stops()
