import datetime

import numpy as np
from pyspark.sql import functions as F

from shelfspark.operators import actions
from shelfspark.operators.durable import new_folder
from shelfspark.streaming import hits, queries

DAY = datetime.datetime(2026, 7, 1)


def batches_of(spark, schema, *batches):
    """A stream that reads a file a micro-batch."""
    path = new_folder(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


def test_trailing_counts_ties_and_the_open_end():
    assert hits.trailing(np.array([0, 5, 5, 10, 14, 15]), 10).tolist() == [1, 3, 3, 3, 4, 3]


def test_hits_are_corrected_by_late_events_and_closed_by_the_watermark(spark):
    schema = "event_id long, key long, ts timestamp"
    first = [(1, 7, at(0)), (2, 7, at(100)), (3, 7, at(130)), (4, 8, at(50))]
    late = [(5, 7, at(90)), (6, 7, at(130))]  # within 60 s of the newest: both count, and change what was given out
    far = [(7, 7, at(500)), (9, 9, at(5000))]
    too_late = [(8, 7, at(95)), (10, 7, at(4950))]  # the first comes behind the watermark and is dropped
    events = batches_of(spark, schema, first, late, far, too_late)
    out = queries.drained(hits.trailing_hits(events, 100, "60 seconds"), ["event_id", "key"])
    assert {r.event_id: r.hits for r in out.collect()} == {1: 1, 5: 2, 2: 2, 3: 4, 6: 4, 4: 1, 7: 1, 9: 1, 10: 1}


def test_bulk_approvals_over_several_batches(spark):
    schema = "session_id long, item_no long, action string, value double, ts timestamp, event_id long"
    rows = [
        [(1, 1, "approve", None, at(1), 1), (1, 2, "dismiss", None, at(2), 2), (1, 3, "edit", 5.0, at(3), 3), (2, 1, "edit", 5.0, at(3), 4)],
        [(1, 0, "approve_all", None, at(10), 5), (1, 4, "unapprove", None, at(9), 6)],
        [(1, 3, "unapprove", None, at(11), 7), (1, 1, "dismiss", None, at(12), 8), (1, 3, "edit", 0.0, at(2), 9), (1, 5, "order_placed", None, at(13), 10)],
    ]
    log = batches_of(spark, schema, *rows)
    items = queries.drained(actions.rec_state(log.where("action <> 'approve_all'"), ["session_id", "item_no"], decided=True), ["session_id", "item_no"])
    bulk = queries.drained(log.where("action = 'approve_all'").groupBy("session_id").agg(F.max(F.struct("ts", "event_id")).alias("bulk")), ["session_id"])
    got = {(r.session_id, r.item_no): (r.approved, r.dismissed, r.edited_quantity) for r in actions.with_bulk(items, bulk).collect()}
    assert got == {(1, 1): (False, True, None), (1, 2): (False, True, None), (1, 3): (False, False, 5.0), (1, 4): (True, False, None), (1, 5): (True, False, None), (2, 1): (False, False, 5.0)}


def test_events_arrive_in_several_batches(spark):
    files = queries.arriving(spark, "/root/testdata/sf0.001")
    seen = queries.drained(files.groupBy("event_id").agg(F.count("*").alias("n")), ["event_id"])
    assert seen.count() == 1000 and seen.where("n <> 1").count() == 0
    assert queries.FILES > 1
