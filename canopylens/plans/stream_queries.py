"""Queries of incremental intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopylens.plans.fixtures import Inputs
from canopylens.sources.files import shared_path
from canopylens.streaming import intake

C = F.col


def events(f: Inputs):
    return intake.arriving(f.spark, f.sf_dir, "events.parquet")


def taken_in(f: Inputs):
    """New events by kind, and how many the audit of the run counts."""
    target = shared_path(f.spark, "intake")
    rows = intake.run_once(events(f), target, keys=["event_id"])
    audited = intake.audit(f.spark, target).agg(F.sum("n_rows").alias("audited"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(audited)  # audited is one row


def deliveries(f: Inputs):
    out = intake.run_once(intake.delivery_times(events(f), ["user_id", "event_type"]), shared_path(f.spark, "deliveries"), "complete")
    return out.select("user_id", "event_type", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")], "n")


def periods(f: Inputs):
    """Statistics of each day and of each period of 30 days."""
    out = intake.run_once(intake.area_statistics(events(f), [1, 30]), shared_path(f.spark, "periods"), "complete")
    return out.withColumn("start", C("start").cast("string"))


QUERIES = {
    "op_t1_intake": (
        taken_in, (

        "select event_type, count(distinct event_id) as n, (select count(distinct event_id) from events) as audited from events group by "
            "event_type"
        ),
    ),
    "op_t2_first_delivery": (
        deliveries, (

        "select user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, "
            "count(*) as n from events group by 1, 2"
        ),
    ),
    "op_t3_period_statistics": (
        periods, (

        "select 1 as days, cast(cast(ts as date) as varchar) as start, count(*) as n, round(sum(value), 2) as total, round(avg(value), 4) as "
            "mean from events group by 2 union all "
        "select 30 as days, cast(date '1970-01-01' + cast(30 * floor(date_diff('day', date '1970-01-01', cast(ts as date)) / 30.0) as int) "
            "as varchar) as start, count(*) as n, round(sum(value), 2) as total, round(avg(value), 4) as mean from events group by 2"
        ),
    ),
}
