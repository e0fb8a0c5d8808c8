"""Stored tables: parts, repeats, untouched files, expiry; streams with a state store."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricelark.model import CHECKS, Settings
from pricelark.operators import alerts as A
from pricelark.operators import catalogue, hygiene, slices, stored_state
from pricelark.session import ensure_checkpoint_dir
from pricelark.sources import folders, import_file, sinks
from pricelark.sources import tables as M
from pricelark.sources.state_table import StateTable
from pricelark.streaming import monitor, stateful

from conftest import SF

SETTINGS = Settings()


def files(top):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{top}/**/part-*", recursive=True)}


def text(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


# --- the state table -----------------------------------------------------------


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ("id",), buckets=8)
    rows = spark.range(100).select("id", F.lit("a").alias("v"))
    assert table.read() is None and table.version().number == 0
    assert table.upsert(0, rows)
    before = files(tmp_path / "t" / "data")
    one = spark.createDataFrame([(7, "b")], "id long, v string")
    assert table.upsert(1, one)
    after = files(tmp_path / "t" / "data")
    assert before.items() <= after.items() and len(after) - len(before) == 1
    got = {r.id: r.v for r in table.read().collect()}
    assert got == {i: "b" if i == 7 else "a" for i in range(100)}
    held = table.version().buckets
    assert sorted(held.values()).count(2) == 1
    assert len(table.read().inputFiles()) == 8 and len(table.read([0, 3]).inputFiles()) == 2


def test_a_part_is_applied_once_and_a_lost_one_leaves_nothing(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ("id",), buckets=4)
    rows = spark.createDataFrame([(1, 1), (2, 1)], "id long, n long")

    def add(old):
        new = rows if old is None else old.unionByName(rows)
        return new.groupBy("id").agg(F.sum("n").alias("n"))

    def breaks(old):
        raise RuntimeError("lost")

    assert table.apply(0, rows, add)
    assert not table.apply(0, rows, add)
    with pytest.raises(RuntimeError):
        table.apply(1, rows, breaks)
    # written but not committed: the manifest's folder has no end mark
    rows.withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{table.folder}/data/v=000000002")
    os.makedirs(f"{table.folder}/versions/v=000000002/_temporary")
    assert text(table.read()) == ["Row(id=1, n=1)", "Row(id=2, n=1)"]
    assert table.apply(1, rows, add)
    assert text(table.read()) == ["Row(id=1, n=2)", "Row(id=2, n=2)"]


def test_emptied_buckets_and_vacuum(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ("id",), buckets=4)
    rows = spark.range(20).withColumn("v", F.lit(0))
    for part in range(5):
        table.upsert(part, rows.withColumn("v", F.lit(part)))
    assert len(folders.names(spark, f"{table.folder}/data")) == 5
    table.vacuum(keep=2)
    assert len(folders.names(spark, f"{table.folder}/data")) == 2
    assert {r.v for r in table.read().collect()} == {4} and table.version().part == 4
    table.apply(5, rows, lambda old: old.limit(0))
    assert table.read() is None and table.version().buckets == {}
    table.upsert(6, rows.limit(1))
    assert table.read().count() == 1


def test_stored_state_equals_the_whole_log(spark, tmp_path):
    checks = M.checks(spark, SF)
    kept = stored_state.Monitor(spark, str(tmp_path / "m"), SETTINGS, buckets=4)
    few = checks.filter("checked_at < '1999-01-01' AND product_id % 50 < 25")
    rest = checks.filter("NOT (checked_at < '1999-01-01' AND product_id % 50 < 25)")
    for part, rows in enumerate((few, few.limit(0), rest)):
        assert kept.ingest(part, rows, limit=12 if part else None)
    assert not kept.ingest(2, rest)
    whole, alerts = A.product_state(checks, SETTINGS), A.alerts(checks, SETTINGS)
    assert text(kept.state().select(*whole.columns)) == text(whole)
    assert text(kept.alerts().select(*alerts.columns)) == text(alerts)
    sums = kept.totals().agg(F.sum("history_count"), F.sum("alert_count")).first()
    assert sums == (checks.count(), alerts.count())


def test_a_part_is_read_once_and_alerts_are_a_file_a_day(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def read(product_id):
        seen.add(1)
        return product_id

    checks = M.checks(spark, SF).filter("product_id < 40").checkpoint()
    kept = stored_state.Monitor(spark, str(tmp_path / "m"), SETTINGS, buckets=2)
    assert kept.ingest(0, checks.withColumn("product_id", read.asNondeterministic()("product_id")))
    assert seen.value == checks.count()
    alerts = tmp_path / "m" / "alerts"
    assert len(files(alerts)) == len(folders.names(spark, str(alerts)))


def test_alerts_of_a_lost_part_are_not_appended_twice(spark, tmp_path, monkeypatch):
    checks = M.checks(spark, SF).filter("product_id < 40").checkpoint()
    kept = stored_state.Monitor(spark, str(tmp_path / "m"), SETTINGS, buckets=2)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(stored_state, "carried_state", lost)  # after the alerts, before the state
    with pytest.raises(RuntimeError):
        kept.ingest(0, checks)
    monkeypatch.undo()
    assert kept.alerts().count() > 0 and kept.table.read() is None
    assert kept.ingest(0, checks)
    assert kept.alerts().count() == A.alerts(checks, SETTINGS).count()
    few = kept.alerts("1996-01-01", "1996-12-31")
    assert 0 < few.count() == kept.alerts().filter("year(fired_at) = 1996").count()
    assert kept.alerts("2050-01-01").count() == 0


# --- large import files ---------------------------------------------------------


def test_a_large_file_is_read_in_splits(spark, tmp_path):
    """One file over many splits equals the read of the whole file in one task, row numbers included."""
    import random

    rnd = random.Random(1)
    cells = ["x", "", " padded ", "a, b", 'say ""hi""', "two\nlines", "\n\n", 'end ""', "é🙂", '""', "l1\n\nl3, \"\"q\"\"\n"]

    def cell():
        c = rnd.choice(cells)
        return f'"{c}"' if any(x in c for x in ',"\n') or rnd.random() < 0.2 else c

    for name, rows in (("a.csv", 3000), ("b.csv", 400)):
        lines = ["url,notes, Target Price ,n"]
        for i in range(rows):
            lines.append(",".join([cell(), cell(), cell(), str(i)]))
            if rnd.random() < 0.05:
                lines.append("")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "in")
    want = import_file.read_csv(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        got = import_file.read_large_csv(spark, path)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.agg(F.count("*"), F.max("_row")).first() == (3400, 3401)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_unclosed_quote_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(import_file, "RECORD_LINES", 50)
    (tmp_path / "in.csv").write_text('url,notes\n' + 'a,b\n' * 10 + 'a,"b\n' + "c,d\n" * 100)
    with pytest.raises(ValueError, match="more than 50 lines"):
        import_file.read_large_csv(spark, str(tmp_path / "in.csv"))


# --- appends and expiry ----------------------------------------------------------


def test_appends_list_only_their_own_folders(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    rows = A.history_rows(M.checks(spark, SF), SETTINGS).drop("checked_month")
    sinks.append_history(rows, path)
    read = []
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **o: (read.extend(p), real(self, *p, **o))[1])
    before = files(path)
    month = rows.filter("checked_at >= '1996-03-01' AND checked_at < '1996-04-01'")
    sinks.append_history(month, path)
    assert read == [f"{path}/checked_month=1996-03"]
    assert files(path) == before  # nothing new, so nothing is written
    monkeypatch.undo()
    fresh = month.limit(3).withColumn("check_id", -F.col("check_id"))
    sinks.append_history(fresh.unionByName(fresh), path)
    assert spark.read.parquet(path).count() == rows.count() + 3


def test_appends_write_a_file_a_folder_and_keep_no_copy(spark, tmp_path):
    """Parts of the input do not multiply files, and what is written on the way is gone at the end."""
    path, scratch = str(tmp_path / "h"), ensure_checkpoint_dir(spark)
    rows = A.history_rows(M.checks(spark, SF), SETTINGS).drop("checked_month").repartition(8)
    before = set(os.listdir(scratch)), len(glob.glob(f"{scratch}/*/rdd-*"))
    sinks.append_history(rows, path)
    sinks.append_history(rows.withColumn("check_id", F.when(F.col("check_id") % 2 == 0, -F.col("check_id")).otherwise(F.col("check_id"))), path)
    assert (set(os.listdir(scratch)), len(glob.glob(f"{scratch}/*/rdd-*"))) == before
    months = len(folders.names(spark, path))
    assert len(files(path)) <= 2 * months
    even = rows.filter("check_id % 2 = 0").count()
    ids = spark.read.parquet(path).select("check_id")
    assert ids.count() == ids.distinct().count() == rows.count() + even


def test_rows_without_a_time_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1))], "audit_id long, created_at timestamp")
    for _ in range(2):
        sinks.append_audit(rows, path)
    assert spark.read.parquet(path).count() == 2


def test_expiry_drops_old_days_and_leaves_later_ones_alone(spark, tmp_path):
    path = str(tmp_path / "a")
    audit = M.audit_log(spark, SF)
    sinks.append_audit(audit, path)
    cutoff = datetime(2024, 1, 17, 12)
    before = files(path)
    touched = sinks.expire(spark, path, "created_date", "created_at", cutoff)
    assert touched[-1] == "2024-01-17" and touched[0] == "2024-01-01"
    back = spark.read.parquet(path)
    want = audit.filter(F.col("created_at") >= F.lit(cutoff))
    assert sorted(r.audit_id for r in back.select("audit_id").collect()) == sorted(r.audit_id for r in want.select("audit_id").collect())
    later = {f: t for f, t in before.items() if "created_date=2024-01-17" < f.split("/")[-2]}
    assert later and later.items() <= files(path).items()
    assert sinks.expire(spark, path, "created_date", "created_at", cutoff) == []


def test_expiry_finishes_what_a_lost_run_left(spark, tmp_path):
    path = str(tmp_path / "a")
    sinks.append_audit(M.audit_log(spark, SF), path)
    day = spark.read.parquet(f"{path}/created_date=2024-01-17")
    kept = day.filter("audit_id % 2 = 0").count()
    day.filter("audit_id % 2 = 0").write.parquet(f"{path}/_staged-2024-01-17")  # whole, but not yet moved
    folders.drop(spark, f"{path}/created_date=2024-01-17")
    os.makedirs(f"{path}/_staged-2024-01-18/_temporary")  # not whole: the day itself still counts
    later = spark.read.parquet(f"{path}/created_date=2024-01-18").count()
    sinks.expire(spark, path, "created_date", "created_at", datetime(2024, 1, 1))
    back = spark.read.parquet(path)
    assert back.filter("created_date = '2024-01-17'").count() == kept
    assert back.filter("created_date = '2024-01-18'").count() == later
    assert not [n for n in folders.names(spark, path) if n.startswith("_staged")]


def test_feed_keeps_one_generation_of_every_key(spark, tmp_path):
    src, folder = str(tmp_path / "src"), str(tmp_path / "feed")
    for i in range(6):
        spark.createDataFrame([(i % 2, i), (7, i)], "k long, v long").write.mode("append").parquet(src)
        rows = spark.readStream.schema("k long, v long").parquet(src).groupBy("k").agg(F.max("v").alias("v"))
        monitor.run_changes(rows, folder, ["k"], buckets=4).awaitTermination()
    assert {r.k: r.v for r in monitor.current(spark, folder, ["k"]).collect()} == {0: 4, 1: 5, 7: 5}
    assert len(folders.names(spark, f"{folder}/table")) == 6
    assert len(folders.names(spark, f"{folder}/newest/data")) <= 3


@pytest.mark.parametrize("sort", ["recent", "price_desc", "biggest_drop"])
def test_deep_pages(spark, sort):
    rows = M.products(spark, SF).withColumns(
        {"current_paise": F.when(F.col("product_id") % 5 > 0, F.col("mrp_paise") % 1000), "discount_pct": F.col("product_id") % 7}
    ).checkpoint()
    for number in (1, 3, 7, 8, 9):
        q = catalogue.CatalogueQuery(sort=sort, page=number, page_size=25)
        want = catalogue.catalogue_page(rows, q).select("product_id", "total", "pages").collect()
        for ranges in (1, 13):
            got = catalogue.catalogue_seek(rows, q, ranges).select("product_id", "total", "pages").collect()
            assert got == want
    with pytest.raises(ValueError):
        catalogue.catalogue_seek(rows, catalogue.CatalogueQuery(page_size=101))


# --- streams with a state store ----------------------------------------------------


def _commands(spark):
    actions = F.array(*[F.lit(a) for a in ("set_target", "pause", "resume", "edit_target", "clear_target")])
    key = F.col("o_orderkey")
    return M.table(spark, SF, "orders").select(
        (F.col("o_custkey") % 7).alias("product_id"),
        F.col("o_orderdate").alias("at"),
        key.alias("control_id"),
        F.element_at(actions, (key % 5 + 1).cast("int")).alias("action"),
        (85000 + key % 15000).alias("target_paise"),
    )


def test_every_alert_of_checks_under_commands(spark, tmp_path):
    """All rules and payloads, hot products, three runs, against the batch job."""
    settings = Settings(failure_limit=2)
    checks = M.checks(spark, SF).withColumn("product_id", F.col("product_id") % 7)
    checks = checks.dropDuplicates(["product_id", "checked_at"]).checkpoint()
    commands = _commands(spark)
    folder = str(tmp_path / "run")
    for low, high in (("1990", "1996"), ("1996", "1999"), ("1999", "2009")):
        for name, rows, at in (("checks", checks, "checked_at"), ("commands", commands, "at")):
            part = rows.filter((F.col(at) >= f"{low}-01-01") & (F.col(at) < f"{high}-01-01"))
            part.write.mode("append").parquet(f"{folder}/{name}")
        one = spark.readStream.schema(checks.schema).parquet(f"{folder}/checks")
        two = spark.readStream.schema(commands.schema).parquet(f"{folder}/commands")
        stateful.run_checks(one, two, settings, folder).awaitTermination()
    want = A.alerts(checks, settings, controls=commands)
    assert {r.type for r in want.select("type").distinct().collect()} >= {"target_price", "auto_paused", "offer_added"}
    got, want = text(monitor.table_of(spark, folder).select(*want.columns)), text(want)
    assert [r for r in got if r not in set(want)] == [] and got == want
    assert monitor.late_of(spark, folder).count() == 0


def test_checks_without_a_time_and_repeats_in_one_batch_are_late(spark, tmp_path):
    folder, at = str(tmp_path / "run"), datetime(2026, 7, 1)
    data = [
        (i, 1, t, True, "in_stock", p, None, [], "http", None, 1, 1000, None)
        for i, t, p in [(1, at, 1100), (2, None, 5), (2, None, 5), (3, at + timedelta(hours=1), 990), (3, at + timedelta(hours=1), 990)]
    ]
    nullable = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHECKS.fields)
    spark.createDataFrame(data, nullable).write.parquet(f"{folder}/checks")
    stateful.run_checks(spark.readStream.schema(CHECKS).parquet(f"{folder}/checks"), None, SETTINGS, folder).awaitTermination()
    assert [r.check_id for r in monitor.table_of(spark, folder).filter("type = 'target_price'").collect()] == [3]
    assert sorted(r.check_id for r in monitor.late_of(spark, folder).collect()) == [2, 2, 3]


def test_late_checks_and_commands_stay_apart(spark, tmp_path):
    start, folder = datetime(2026, 7, 1), str(tmp_path / "run")

    def checks(rows):
        data = [
            (i, 1, start + timedelta(minutes=m), p is not None, "in_stock" if p else "unknown", p, None, [], "http", None, 1, 1000, None)
            for i, m, p in rows
        ]
        spark.createDataFrame(data, CHECKS).write.mode("append").parquet(f"{folder}/checks")

    schema = "product_id long, at timestamp, control_id long, action string, target_paise long"

    def commands(rows):
        data = [(1, start + timedelta(minutes=m), i, a, t) for i, m, a, t in rows]
        spark.createDataFrame(data, schema).write.mode("append").parquet(f"{folder}/commands")

    def run():
        one = spark.readStream.schema(CHECKS).parquet(f"{folder}/checks")
        two = spark.readStream.schema(schema).parquet(f"{folder}/commands")
        stateful.run_checks(one, two, SETTINGS, folder).awaitTermination()

    checks([(1, 0, 1100), (2, 10, 990), (3, 20, None)])
    commands([(1, 5, "set_target", 900)])
    run()
    checks([(4, 15, 100), (5, 30, 890), (3, 20, None)])
    commands([(2, 25, "set_target", 895), (3, 12, "set_target", 5000)])
    run()
    got = [(r.check_id, r.type, r.target_paise) for r in monitor.table_of(spark, folder).orderBy("check_id", "rule").collect()]
    assert got == [(2, "threshold_drop", None), (5, "target_price", 895), (5, "threshold_drop", None)]
    late = {(r.check_id, r.action) for r in monitor.late_of(spark, folder).collect()}
    assert late == {(4, None), (3, None), (3, "set_target")}


@pytest.mark.parametrize(
    "settings",
    [Settings(cooldown_minutes=700), Settings(cooldown_minutes=0), Settings(cooldown_minutes=90, hold_health=True)],
)
def test_holds_end_by_timer_and_state_ends(spark, tmp_path, settings):
    log = M.logged_alerts(spark, SF).withColumn("product_id", F.col("product_id") % 2)
    folder = str(tmp_path / "run")

    def run():
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/alerts")
        query = stateful.run_hold(stream, settings, folder)
        query.awaitTermination()
        return query

    cuts = ["2024-01-01", "2024-01-09 03:00:00", "2024-01-20", "2024-02-01"]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = log.filter((F.col("fired_at") >= low) & (F.col("fired_at") < high))
        part.write.mode("append").parquet(f"{folder}/alerts")
        run()
    waiting = stateful.outcomes(spark, folder, settings).filter("status = 'held_quiet_hours' AND release_at IS NULL")
    assert waiting.count() > 0  # the last quiet window is not over yet
    stateful.clock_row(log, F.lit("2024-02-04")).write.mode("append").parquet(f"{folder}/alerts")
    last = run().recentProgress[-1]
    want = hygiene.delivery_plan(log, settings).select("alert_id", "status", "reason", "release_at")
    assert text(stateful.outcomes(spark, folder, settings).select(*want.columns)) == text(want)
    assert sum(s.numRowsTotal for s in last.stateOperators) == 0


def test_late_alerts_stay_apart(spark, tmp_path):
    folder, start = str(tmp_path / "run"), datetime(2026, 7, 1, 6)
    schema = "alert_id long, product_id long, type string, fired_at timestamp, change_pct double"

    def run(rows):
        data = [(i, 1, "price_change", start + timedelta(minutes=m), None) for i, m in rows]
        spark.createDataFrame(data, schema).write.mode("append").parquet(f"{folder}/alerts")
        stateful.run_hold(spark.readStream.schema(schema).parquet(f"{folder}/alerts"), SETTINGS, folder).awaitTermination()

    run([(1, 0), (2, 30)])
    run([(3, 10), (4, 100)])
    got = {r.alert_id: r.status for r in stateful.outcomes(spark, folder, SETTINGS).collect()}
    assert got == {1: "delivered", 2: "suppressed", 4: "delivered"}
    assert [r.alert_id for r in spark.read.parquet(f"{folder}/late").collect()] == [3]


def test_a_long_key_of_holds_is_sliced(spark, tmp_path, monkeypatch):
    """A product with many alerts in a micro-batch goes through slices, not through one task's Python;
    a repeated row is late, and only what the last cooldown needs is left as state."""
    monkeypatch.setattr(slices, "HOT_ROWS", 20)
    folder, start, settings = str(tmp_path / "run"), datetime(2026, 7, 1, 6), Settings(cooldown_minutes=45)
    schema = "alert_id long, product_id long, type string, fired_at timestamp, change_pct double"
    rows = [(i, 1, "price_change", start + timedelta(minutes=10 * i), None) for i in range(300)]
    for part in (rows[:180] + rows[100:103], rows[180:] + rows[:1]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/alerts")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/alerts")
        query = stateful.run_hold(stream, settings, folder)
        query.awaitTermination()
        assert all(not p.stateOperators for p in query.recentProgress)
    end = F.lit("2026-07-09")
    stateful.clock_row(spark.createDataFrame(rows, schema), end).write.mode("append").parquet(f"{folder}/alerts")
    stateful.run_hold(spark.readStream.schema(schema).parquet(f"{folder}/alerts"), settings, folder).awaitTermination()
    want = hygiene.delivery_plan(spark.createDataFrame(rows, schema), settings).select("alert_id", "status", "reason", "release_at")
    assert text(stateful.outcomes(spark, folder, settings).select(*want.columns)) == text(want)
    assert sorted(r.alert_id for r in spark.read.parquet(f"{folder}/late").collect()) == [0, 100, 101, 102]
    assert all(spark.read.parquet(f"{folder}/state/{name}").count() <= 1 for name in ("chain", "seen", "held"))
