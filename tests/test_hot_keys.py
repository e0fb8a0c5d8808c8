"""Sliced scans, split bursts and salted ranks give the unsliced result."""

import glob
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricelark.model import Settings
from pricelark.operators import alerts as A
from pricelark.operators import compare as P
from pricelark.operators import hygiene as H
from pricelark.operators import sequence as S
from pricelark.operators.imports import positions
from pricelark.operators.slices import row_numbers, slice_hot_keys, top_per_key
from pricelark.sources import tables as M

from conftest import SF

SETTINGS = Settings(failure_limit=3)


def hot_checks(spark):
    """A third of the log is one product."""
    return M.checks(spark, SF).withColumn(
        "product_id", F.when(F.col("product_id") % 3 == 0, 0).otherwise(F.col("product_id"))
    )


def table(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def commands(spark):
    actions = F.array(*[F.lit(a) for a in ("set_target", "pause", "resume", "edit_target", "clear_target")])
    key = F.col("o_orderkey")
    return M.table(spark, SF, "orders").select(
        (F.col("o_custkey") % 5).alias("product_id"),
        F.col("o_orderdate").alias("at"),
        key.alias("control_id"),
        F.element_at(actions, (key % 5 + 1).cast("int")).alias("action"),
        (85000 + key % 15000).alias("target_paise"),
    )


def test_slices_cover_and_bound(spark):
    src = slice_hot_keys(S.log_of(hot_checks(spark)), S.KEY, S.ORDER, 200)
    assert src.hot
    sizes = src.df.groupBy("product_id", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    assert src.df.filter("not _hot").select("_slice").distinct().count() == 1


def test_bursts_and_ties_are_cut(spark):
    """10,000 rows of one key in an hour, 3,000 of another at one time, and two far outliers."""
    start = datetime(2026, 1, 1)
    rows = [(1, start + timedelta(milliseconds=360 * i), 1, i) for i in range(10_000)]
    rows += [(2, start, i % 2, i) for i in range(3_000)]
    rows += [(1, datetime(1990, 1, 1), 1, -1), (1, datetime(2040, 1, 1), 1, -2), (3, start, 1, 5)]
    df = spark.createDataFrame(rows, "k long, at timestamp, ord int, id long")
    src = slice_hot_keys(df, ["k"], ["at", "ord", "id"], 100)
    sizes = src.df.groupBy("k", "_slice").agg(F.count("*").alias("n"), F.min(F.struct("at", "ord", "id")).alias("a"), F.max(F.struct("at", "ord", "id")).alias("b"))
    got = sizes.orderBy("k", "_slice").collect()
    assert sum(r.n for r in got) == len(rows) and max(r.n for r in got) <= 100
    for r, later in zip(got, got[1:]):
        assert r.k < later.k or r.b < later.a  # slices follow one another as their rows do
    numbered = row_numbers(src).df.select("k", "id", "at", "ord", "rn").collect()
    for k in (1, 2, 3):
        mine = sorted((r.at, r.ord, r.id, r.rn) for r in numbered if r.k == k)
        assert [m[3] for m in mine] == list(range(1, len(mine) + 1))


def test_rows_that_nothing_tells_apart_stay_together(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1), "x")] * 300 + [(1, datetime(2026, 1, 2), "y")], "k long, at timestamp, s string")
    src = slice_hot_keys(df, ["k"], ["at", "s"], 100)
    assert sorted(r["count"] for r in src.df.groupBy("_slice").count().collect()) == [1, 300]


def test_alerts_of_a_hot_product(spark):
    checks = hot_checks(spark)
    assert table(A.alerts(checks, SETTINGS, limit=100)) == table(A.alerts(checks, SETTINGS))


def test_alerts_of_a_hot_product_under_commands(spark):
    checks, ctl = hot_checks(spark), commands(spark)
    few = A.alerts(checks, SETTINGS, controls=ctl, limit=100)
    assert table(few) == table(A.alerts(checks, SETTINGS, controls=ctl))


def test_state_history_and_bands_of_a_hot_product(spark):
    checks = hot_checks(spark)
    assert table(A.product_state(checks, SETTINGS, limit=100)) == table(A.product_state(checks, SETTINGS))
    assert table(A.history_rows(checks, SETTINGS, 100)) == table(A.history_rows(checks, SETTINGS))
    points = checks.filter("success")
    out = F.col("stock_status") == "out_of_stock"
    assert table(S.spans(S.sliced_log(points, limit=50), out, "checked_at")) == table(
        S.spans(S.sliced_log(points), out, "checked_at")
    )


def test_time_weighted_average_of_a_hot_product(spark):
    checks = hot_checks(spark)
    now = M.as_of()
    assert table(P.time_weighted_average(checks, now, 50)) == table(P.time_weighted_average(checks, now))


def brute(rows, settings):
    """The sequential policy, one alert at a time."""
    from zoneinfo import ZoneInfo

    out, counted = {}, {}
    for r in sorted(rows, key=lambda r: (r.fired_at, r.alert_id)):
        at = r.fired_at.replace(tzinfo=ZoneInfo("UTC"))
        here = at.astimezone(ZoneInfo(settings.timezone))
        mins = here.hour * 60 + here.minute
        release = at
        if settings.quiet_start and (mins >= 1320 or mins < 420) and r.type not in ("auto_paused", "system_health"):
            end = here.replace(hour=7, minute=0, second=0, microsecond=0)
            release = end + timedelta(days=1) if mins >= 1320 else end
        key = (r.product_id, r.type)
        subject = r.product_id is not None and r.type not in ("auto_paused", "system_health", "back_in_stock")
        last = counted.get(key)
        if subject and last is not None and last <= at <= last + timedelta(minutes=settings.cooldown_minutes):
            out[r.alert_id] = "suppressed"
            continue
        if subject and (last is None or last <= at):
            counted[key] = release
        out[r.alert_id] = "delivered" if release == at else "held_quiet_hours"
    return out


def dense_alerts(spark):
    """One hot key with alerts every few minutes, some at the same time, and a few others."""
    rows, at = [], datetime(2026, 1, 1)
    for i in range(900):
        at += timedelta(minutes=(i * 7) % 41)
        key = 1 if i % 3 else 2 + i % 5
        rows.append((i, key, "price_change" if i % 4 else "target_price", at, -1.0))
    rows += [(10_000 + i, None, "system_health", at, None) for i in range(3)]
    return spark.createDataFrame(
        rows, "alert_id long, product_id long, type string, fired_at timestamp, change_pct double"
    )


def test_long_bursts_by_doubling(spark):
    alerts = dense_alerts(spark)
    for settings in (
        Settings(cooldown_minutes=60),
        Settings(cooldown_minutes=60, quiet_start=None, quiet_end=None),
        Settings(cooldown_minutes=600),
    ):
        want = brute(alerts.collect(), settings)
        for limits in ((None, None), (3, 40)):
            got = H.delivery_plan(alerts, settings, *limits)
            assert {r.alert_id: r.status for r in got.collect()} == want


def test_cooldown_off(spark):
    plan = H.delivery_plan(dense_alerts(spark), Settings(cooldown_minutes=0))
    assert plan.filter("status = 'suppressed'").count() == 0


def test_probe_matches_brute_force(spark):
    alerts = dense_alerts(spark)
    sent = alerts.filter("alert_id % 5 = 0").withColumn("delivered_at", F.col("fired_at"))
    got = {r.alert_id for r in H.recently_delivered(alerts, sent, 30).collect()}
    d = [(r.product_id, r.type, r.fired_at) for r in sent.collect()]
    want = {
        r.alert_id
        for r in alerts.collect()
        if r.product_id is not None
        and any(
            p == r.product_id and t == r.type and timedelta(0) <= r.fired_at - x <= timedelta(minutes=30)
            for p, t, x in d
        )
    }
    assert got == want


def test_held_summaries_hold_every_alert_once(spark):
    plan = H.delivery_plan(dense_alerts(spark), Settings(cooldown_minutes=5))
    held = plan.filter("status = 'held_quiet_hours'").withColumn(
        "message", F.concat(F.lit("head\nalert "), F.col("alert_id").cast("string"))
    )
    a, b = H.held_summaries(held, 10), H.held_summaries(held, 10, limit=20)
    assert table(a) == table(b)
    assert a.agg(F.sum("alerts")).first()[0] == held.count()
    assert a.agg(F.max("alerts")).first()[0] == 10


def test_large_groups_stay_one_message_in_order(spark):
    rows = dense_alerts(spark).withColumns(
        {"fired_at": F.lit("2026-01-01").cast("timestamp"), "message": F.col("alert_id").cast("string")}
    )
    got = H.grouped_messages(rows, "alert_id").collect()
    assert len(got) == rows.select("product_id").distinct().count()
    assert sum(r.alerts for r in got) == rows.count()
    for r in got:
        ids = [int(i) for i in r.message.split("\n\n")]
        assert ids == sorted(ids) and len(ids) == r.alerts


def test_ranks_and_positions(spark):
    checks = hot_checks(spark)
    order = [F.col("checked_at").asc(), F.col("check_id").asc()]
    top = top_per_key(checks, ["product_id"], order, 7, salts=5)
    numbered = row_numbers(slice_hot_keys(checks, ["product_id"], ["checked_at", "check_id"], 100))
    want = numbered.df.filter("rn <= 7").select("product_id", "check_id", "rn")
    assert table(top.select("product_id", "check_id", F.col("rn").cast("long").alias("rn"))) == table(want)
    got = positions(checks, [], ["stock_status"], "check_id", cell=1000)
    rows = got.orderBy("pos").select("pos", "stock_status", "check_id").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert [(r.stock_status, r.check_id) for r in rows] == sorted((r.stock_status, r.check_id) for r in rows)


def test_cheaper_share_of_a_hot_pair(spark):
    id_ = F.col("product_id")
    partner = F.when(id_ % 2 == 0, id_ + 1).otherwise(id_ - 1)
    points = hot_checks(spark).filter("success").withColumn("linked_product_id", partner)
    products = M.products(spark, SF)
    assert table(P.cheaper_share(products, points, 40)) == table(P.cheaper_share(products, points))


def test_rows_are_cut_into_slices_once(spark):
    """What reads the slices, the scan and their summaries, does not join the levels of cells again."""
    rows = spark.range(100).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("at"))
    src = slice_hot_keys(rows, ["k"], ["at"], limit=5)
    assert src.hot and "Join" not in src.df._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["count"] for r in src.df.groupBy("_slice").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 5


def test_sliced_scans_keep_little_on_disk(spark):
    """What a scan of slices was made of is gone once it is stored: tables of earlier steps and shuffle files."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def tables():
        tops = [folder, os.path.dirname(folder)]
        return {p for top in tops for name in ("rdd-*", "stored-*") for p in glob.glob(f"{top}/{name}")}

    def shuffles():
        return {p for top in local for p in glob.glob(f"{top}/**/shuffle_*", recursive=True)}

    checks = hot_checks(spark)
    checks.count()
    before, files = tables(), shuffles()
    log = A.annotated(checks, SETTINGS, limit=200)
    assert len(tables() - before) == 2  # the rows before the last scan, and its values of earlier slices
    until = time.time() + 10  # files go shortly after the job that they were for
    while len(shuffles() - files) > 4 and time.time() < until:
        time.sleep(0.1)
    assert len(shuffles() - files) <= 4  # of the counts and of asking whether any key or cell is left
    assert log.count() == checks.count()
