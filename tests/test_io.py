"""Files in and out, streams over several runs, control and state tables."""

import csv
import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricelark.model import CHECKS, Settings
from pricelark.operators import alerts as A
from pricelark.operators import compare, control, hygiene, imports, planning, quality
from pricelark.sources import import_file, sinks
from pricelark.sources import tables as M
from pricelark.streaming import monitor

from conftest import SF

SETTINGS = Settings()


def test_import_file_and_review(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "Product URL , Target Price,threshold %,Notes,TAGS,extra\n"
        'https://www.amazon.in/dp/B0TEST0001,"₹1,299",5,"a ""quoted"", note","x, y;z",1\n'
        "\n"
        "https://www.amazon.in/gp/product/B0TEST0001?x=1,,,,,\n"
        "https://www.amazon.in/dp/B0TEST0002,cheap,,,,\n"
        "https://www.amazon.in/dp/B0TEST0003,,abc,,,\n"
        ",5,,,,\n"
    )
    rows = import_file.import_rows(import_file.read_csv(spark, str(path)))
    first = rows.orderBy("row_number").first()
    assert (first.row_number, first.target_rupees, first.threshold_pct) == (2, 1299.0, 5.0)
    assert (first.notes, first.tags) == ('a "quoted", note', ["x", "y", "z"])
    known = spark.createDataFrame(
        [("https://www.amazon.in/dp/B0TEST0003", "Lamp")], "canonical_url string, display_name string"
    )
    reviewed = imports.review(rows, known)
    got = [(r.disposition, r.reason) for r in reviewed.orderBy("row_number").collect()]
    assert got == [
        ("valid", None),
        ("duplicate", "Duplicate of an earlier row in this file (first occurrence wins)"),
        ("invalid", "Target price must be a positive number"),
        ("duplicate", "Already tracked as “Lamp”"),
        ("invalid", "Missing URL"),
    ]
    now = F.lit("2026-07-01").cast("timestamp")
    made = imports.execute(reviewed, known, now).collect()
    assert [(m.display_name, m.target_paise, m.status) for m in made] == [
        ("Awaiting first check — B0TEST0001", 129900, "active")
    ]
    assert imports.late_duplicates(reviewed, reviewed.filter("disposition = 'valid'")).count() == 1


def test_rows_of_several_files_are_numbered_on(spark, tmp_path):
    for name, ids in (("a.csv", "123"), ("b.csv", "45"), ("c.csv", "6")):
        (tmp_path / name).write_text("url\n" + "".join(f"https://www.amazon.in/dp/B0TEST000{i}\n" for i in ids))
    rows = import_file.import_rows(import_file.read_csv(spark, str(tmp_path))).collect()
    assert sorted((r.row_number, r.url[-1]) for r in rows) == [(i + 1, str(i)) for i in range(1, 7)]


def test_csv_cells_and_lines(spark):
    rows = [("a", None, 'say "hi"'), ("x,y", "", "two\nlines")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    lines = [r.line for r in sinks.csv_lines(df).collect()]
    assert lines == ['a,,"say ""hi"""', '"x,y",,"two\nlines"']


def test_products_file_imports_again(spark, tmp_path):
    rows = [("https://www.amazon.in/dp/B0TEST0001", "Lamp, big", 129900, 500, ["a", "b"])]
    schema = "canonical_url string, display_name string, target_paise long, threshold_bp long, tags array<string>"
    df = spark.createDataFrame(rows, schema)
    for name, kind in {
        "notes": "string", "marketplace": "string", "status": "string", "current_paise": "bigint",
        "current_mrp_paise": "bigint", "stock_status": "string", "low_paise": "bigint", "high_paise": "bigint",
        "last_checked_at": "timestamp", "created_at": "timestamp", "product_id": "bigint",
    }.items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    out = str(tmp_path / "products")
    sinks.write_csv(sinks.export_products(df).drop("_created_at", "_id"), out)
    back = import_file.import_rows(import_file.read_csv(spark, out)).first()
    assert (back.url, back.target_rupees, back.threshold_pct, back.tags) == (rows[0][0], 1299.0, 5.0, ["a", "b"])


def test_history_file_is_ordered_by_ranges(spark, tmp_path):
    history = M.with_discount(A.history_rows(M.checks(spark, SF), SETTINGS))
    out = str(tmp_path / "history")
    rows = sinks.export_history(history, M.products(spark, SF))
    sinks.write_csv(rows, out, ["_at", "_id"])
    seen, total = [], 0
    for part in sorted(glob.glob(out + "/part-*.csv")):
        with open(part, newline="") as f:
            lines = list(csv.DictReader(f))
        total += len(lines)
        keys = [(line["_at"], int(line["_id"])) for line in lines]
        assert keys == sorted(keys)
        seen += keys
    assert seen == sorted(seen) and total == M.checks(spark, SF).count()


def test_one_history_row_per_check_in_month_folders(spark, tmp_path):
    checks = M.checks(spark, SF)
    path = str(tmp_path / "h")
    sinks.append_history(A.history_rows(checks, SETTINGS).drop("checked_month"), path)
    back = spark.read.parquet(path)
    assert back.count() == back.select("check_id").distinct().count() == checks.count()
    recent = back.filter("checked_month = '2001-08'")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(checked_month" in plan


def test_audit_append_and_retention(spark, tmp_path):
    audit = M.audit_log(spark, SF)
    path = str(tmp_path / "a")
    sinks.append_audit(audit, path)
    back = spark.read.parquet(path)
    assert back.count() == audit.count()
    cutoff = audit.agg(F.max("created_at")).first()[0]
    kept = quality.retained(audit, F.lit(cutoff), 0)
    assert kept.count() == 1  # the row at the cutoff stays


def test_state_continues_over_disjoint_parts(spark):
    checks = M.checks(spark, SF)
    run, state = A.continue_state(checks.filter("checked_at < '1999-01-01'"), SETTINGS, None, None)
    _, state = A.continue_state(checks.filter("checked_at >= '1999-01-01'"), SETTINGS, run, state)
    whole = A.product_state(checks, SETTINGS)
    assert sorted(map(str, state.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_writing_twice_changes_nothing(spark, tmp_path):
    rows = A.history_rows(M.checks(spark, SF), SETTINGS).drop("checked_month")
    audit = M.audit_log(spark, SF)
    for _ in range(2):
        sinks.append_history(rows, str(tmp_path / "h"))
        sinks.append_audit(audit, str(tmp_path / "a"))
    sinks.append_history(rows.limit(5).union(rows.limit(5)), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == rows.count()
    assert spark.read.parquet(str(tmp_path / "a")).count() == audit.count()


def _checks(spark, rows):
    start = datetime(2026, 7, 1)
    data = [
        (i, 1, start + timedelta(minutes=m), ok, "in_stock" if ok else "unknown", p, None, [], "http", None, 1, 1000, None)
        for i, m, ok, p in rows
    ]
    return spark.createDataFrame(data, CHECKS)


def test_stream_goes_on_where_it_stopped_and_reports_late_rows(spark, tmp_path):
    src, folder = str(tmp_path / "src"), str(tmp_path / "run")
    first = _checks(spark, [(1, 0, True, 1100), (2, 10, True, 1000), (3, 20, False, None)])
    second = _checks(spark, [(4, 15, True, 500), (5, 30, True, 900), (6, 40, True, 900)])

    def run():
        stream = spark.readStream.schema(CHECKS).parquet(src)
        monitor.run_stateful(stream, monitor.alert_step(SETTINGS, limit=2), folder).awaitTermination()
        return monitor.table_of(spark, folder)

    first.coalesce(1).write.mode("append").parquet(src)
    assert sorted((r.check_id, r.type) for r in run().collect()) == [(2, "target_price"), (2, "threshold_drop")]
    second.coalesce(1).write.mode("append").parquet(src)
    got = sorted((r.check_id, r.type) for r in run().collect())
    assert got == [(2, "target_price"), (2, "threshold_drop"), (5, "threshold_drop")]
    assert [r.check_id for r in monitor.late_of(spark, folder).collect()] == [4]
    batch = A.alerts(first.unionByName(second.filter("check_id <> 4")), SETTINGS, ["target_price", "threshold_drop"])
    assert sorted((r.check_id, r.type) for r in batch.collect()) == got


def test_stream_of_parts_equals_the_batch(spark, tmp_path):
    src, folder = str(tmp_path / "src"), str(tmp_path / "run")
    checks = M.checks(spark, SF).withColumn("product_id", F.col("product_id") % 7)
    checks = checks.dropDuplicates(["product_id", "checked_at"]).checkpoint()
    for low, high in (("1995", "1998"), ("1998", "2000"), ("2000", "2003")):
        part = checks.filter((F.col("checked_at") >= f"{low}-01-01") & (F.col("checked_at") < f"{high}-01-01"))
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(checks.schema).parquet(src)
        monitor.run_stateful(stream, monitor.alert_step(SETTINGS, limit=200), folder).awaitTermination()
    cols = ["check_id", "type", "old_paise", "new_paise", "change_pct", "added", "removed", "consecutive_failures"]
    got = sorted(map(repr, monitor.table_of(spark, folder).select(*cols).collect()))
    assert got == sorted(map(repr, A.alerts(checks, SETTINGS).select(*cols).collect()))


def test_cooldown_in_parts_equals_the_batch(spark):
    log = M.logged_alerts(spark, SF).withColumn("product_id", F.col("product_id") % 2)
    settings = Settings(cooldown_minutes=700)
    want = {r.alert_id: r.status for r in hygiene.delivery_plan(log, settings).collect()}
    step, state, got = monitor.cooldown_step(settings, 3, 50), None, {}
    cuts = ["2024-01-01", "2024-01-09 03:00:00", "2024-01-20", "2024-02-01"]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = log.filter((F.col("fired_at") >= low) & (F.col("fired_at") < high))
        plan, state = step(part, state)
        state = state.checkpoint()
        got |= {r.alert_id: r.status for r in plan.collect()}
    assert got == want
    assert set(want.values()) == {"delivered", "held_quiet_hours", "suppressed"}


def test_change_feed_rerun_adds_nothing(spark, tmp_path):
    src, folder = str(tmp_path / "src"), str(tmp_path / "feed")
    M.table(spark, SF, "events").write.parquet(src)
    schema = spark.read.parquet(src).schema

    def run():
        counts = spark.readStream.schema(schema).parquet(src).groupBy("event_type").agg(F.count("*").alias("n"))
        told = []
        monitor.run_changes(counts, folder, ["event_type"], lambda batch, i: told.append(i)).awaitTermination()
        rows = monitor.current(spark, folder, ["event_type"])
        return sorted(map(tuple, rows.collect()))

    once = run()
    assert once == run()
    assert sum(n for _, n in once) == spark.read.parquet(src).count()


def test_links(spark):
    products = spark.createDataFrame(
        [(1, "amazon_in", None), (2, "flipkart", None), (3, "flipkart", 4), (4, "amazon_in", 3)],
        "product_id long, marketplace string, linked_product_id long",
    )
    asked = spark.createDataFrame(
        [(1, 1, 2), (2, 1, 1), (3, 2, 3), (4, 1, 3), (5, 1, 9)], "request_id long, a_id long, b_id long"
    )
    checked = control.validate_links(asked, products)
    got = {r.request_id: r.reason for r in checked.collect()}
    assert got == {1: None, 2: "same_product", 3: "same_marketplace", 4: "already_linked", 5: "not_found"}
    linked = control.link(products, checked.filter("accepted"))
    assert {r.product_id: r.linked_product_id for r in linked.collect()} == {1: 2, 2: 1, 3: 4, 4: 3}
    cut = control.unlink(linked, spark.createDataFrame([(3,)], "product_id long"))
    assert {r.product_id: r.linked_product_id for r in cut.collect()} == {1: 2, 2: 1, 3: None, 4: None}


def test_bulk_commands(spark):
    state = spark.createDataFrame(
        [(1, "active"), (2, "paused_auto"), (3, "paused_user")], "product_id long, status string"
    )
    at = F.lit("2026-07-01").cast("timestamp")
    assert sorted(r.product_id for r in control.resume_all(state, at).collect()) == [2, 3]
    folded = control.fold(control.resume_all(state, at).unionByName(control.check_all(state, at)))
    after = control.apply(state.withColumn("target_paise", F.lit(5).cast("long")), folded)
    assert {r.status for r in after.collect()} == {"active"}
    assert after.filter("due_at is null").count() == 0


def test_split_toggle(spark):
    df = spark.createDataFrame([(True,), (False,)], "old boolean")
    rows = control.split_toggle(df, "old", "a", "b").collect()
    assert sorted((r.a, r.b) for r in rows) == [(False, False), (True, True)]


def test_plan_is_empty_while_paused(spark):
    state = spark.createDataFrame(
        [(1, "amazon_in", "active", datetime(2026, 1, 1), None)],
        "product_id long, marketplace string, status string, next_check_at timestamp, interval_minutes int",
    )
    now = F.lit("2026-07-01").cast("timestamp")
    assert planning.check_plan(state, SETTINGS, now, "s").count() == 1
    paused = Settings(monitoring_paused=True)
    assert planning.check_plan(state, paused, now, "s").count() == 0
    assert planning.daily_sweep(state, paused, F.lit(None).cast("timestamp"), now).count() == 0


@pytest.mark.parametrize(
    "last,now,due",
    [
        (None, "2026-07-01 01:00:00", True),
        (None, "2026-07-01 00:00:00", False),  # 05:30 local, before 06:00
        ("2026-06-30 20:00:00", "2026-07-01 01:00:00", False),  # the same local day
        ("2026-06-30 10:00:00", "2026-07-01 01:00:00", True),
    ],
)
def test_one_sweep_per_local_day(spark, last, now, due):
    column = planning.sweep_due(SETTINGS, F.lit(last).cast("timestamp"), F.lit(now).cast("timestamp"))
    assert spark.range(1).select(column.alias("c")).first().c is due


def test_jitter_bounds(spark):
    at = F.lit("2026-07-01").cast("timestamp")
    wait = F.unix_seconds(planning.next_check(at, F.lit(30), planning.jitter(7))) - F.unix_seconds(at)
    low, high = spark.range(500).select(wait.alias("w")).agg(F.min("w"), F.max("w")).first()
    assert 1620 <= low < high <= 1980


def test_near_low_margin(spark):
    df = spark.createDataFrame([(1, 102, 100), (2, 103, 100), (3, None, 100)], "product_id long, current_paise long, low_paise long")
    assert [r.product_id for r in compare.near_lows(df, 2.0).collect()] == [1]


def test_settings_rules(spark):
    base = dict(check_interval_minutes=30, drop_threshold_pct=5.0, failure_limit=5, cooldown_minutes=0, near_low_pct=2.0,
                quiet_start="22:00", quiet_end=None, digest_time="9", daily_check_time=None, digest_frequency="hourly", pincode="56001")
    kinds = {int: "int", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in base.items())
    df = spark.createDataFrame([tuple(base.values())], schema)
    row = quality.check_rules(df, quality.settings_rules()).first()
    assert row.violations == ["digest_time", "digest_frequency", "pincode"]
