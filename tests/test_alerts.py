"""Rule decisions case by case."""

from dataclasses import replace

from pyspark.sql import functions as F

from pricelark.model import Settings
from pricelark.operators import alerts as A

S = Settings(alert_any_change=False)


def fired(df, settings=S, controls=None):
    rows = A.alerts(df, settings, controls=controls).orderBy("check_id", "rule").collect()
    return [(r.check_id, r.type) for r in rows]


def test_target_fires_once_and_rearms(log):
    df = log(*[{"price": p} for p in (110000, 100000, 99000, 105000, 100000)], target=100000, threshold=0)
    assert fired(df) == [(2, "target_price"), (5, "target_price")]


def test_first_check_at_target_fires_without_old_price(log):
    df = log({"price": 90000}, target=100000)
    row = A.alerts(df, S).first()
    assert (row.type, row.old_paise, row.new_paise, row.change_pct) == ("target_price", None, 90000, None)


def test_out_of_stock_price_never_crosses(log):
    df = log({"price": 110000}, {"price": 90000, "stock": "out_of_stock"}, target=100000, threshold=0)
    assert fired(df) == []


def test_latch_moves_while_the_toggle_is_off(log):
    df = log({"price": 90000}, {"price": 80000}, target=100000, threshold=0)
    assert fired(df, replace(S, alert_target_price=False)) == []
    on = A.product_state(df, S).first()
    assert on.target_crossed


def test_threshold_boundary_and_override(log):
    exact = log({"price": 10000}, {"price": 9500})
    assert fired(exact) == [(2, "threshold_drop")]
    assert fired(log({"price": 10000}, {"price": 9501})) == []
    assert fired(log({"price": 10000}, {"price": 9400}, threshold=1000)) == []
    assert fired(log({"price": 10000}, {"price": 100}, threshold=0)) == []


def test_any_change_is_suppressed_by_a_specific_alert(log):
    s = Settings()
    assert fired(log({"price": 10000}, {"price": 9000}), s) == [(2, "threshold_drop")]
    assert fired(log({"price": 10000}, {"price": 9900}), s) == [(2, "price_change")]
    silent = replace(s, alert_threshold_drop=False)
    assert fired(log({"price": 10000}, {"price": 9000}), silent) == [(2, "price_change")]


def test_list_price_change_is_silent(log):
    assert fired(log({"price": 10000, "mrp": 12000}, {"price": 10000, "mrp": 13000}), Settings()) == []


def test_offer_sides_order_and_toggles(log):
    a, b, c = "5% off", "Coupon 50", "Exchange"
    assert fired(log({"price": 1, "offers": [a]}, {"price": 1, "offers": [a, b]})) == [(2, "offer_added")]
    assert fired(log({"price": 1, "offers": [a, b]}, {"price": 1, "offers": [a]})) == [(2, "offer_removed")]
    both = log({"price": 1, "offers": [a, b]}, {"price": 1, "offers": [a, c]})
    assert fired(both) == [(2, "offer_added"), (2, "offer_removed")]
    assert fired(both, replace(S, alert_offer_added=False)) == [(2, "offer_removed")]
    assert fired(log({"price": 1, "offers": [a, b]}, {"price": 1, "offers": [b + " .", a]})) == []


def test_missing_offers_keep_the_last_known(log):
    df = log({"price": 1, "offers": ["x"]}, {"price": 1}, {"stock": "out_of_stock", "offers": ["y"]}, {"price": 1, "offers": ["x"]})
    assert fired(df) == [(4, "back_in_stock")]
    state = A.product_state(df, S).first()
    assert [o.description for o in state.current_offers] == ["x"]


def test_back_in_stock_only_from_out_of_stock(log):
    df = log({"price": 5}, {"stock": "unknown"}, {"price": 5}, {"stock": "out_of_stock"}, {"ok": False}, {"price": 5})
    assert fired(df) == [(6, "back_in_stock")]


def test_prices_compare_with_the_last_live_price(log):
    df = log({"price": 10000}, {"stock": "out_of_stock"}, {"ok": False}, {"price": 9000})
    assert (4, "threshold_drop") in fired(df)


def test_auto_pause_once_until_resumed(spark, log):
    bad = {"ok": False}
    df = log(*[bad] * 5, {"price": 1}, *[bad] * 6)
    assert fired(df) == [(5, "auto_paused")]
    row = A.alerts(df, S, ["auto_paused"]).first()
    assert (row.failure_reason, row.consecutive_failures) == ("captcha", 5)
    at = df.filter("check_id = 6").select("checked_at").first()[0]
    resume = spark.createDataFrame(
        [(1, at, 1, "resume", None)],
        "product_id long, at timestamp, control_id long, action string, target_paise long",
    )
    assert fired(df, controls=resume) == [(5, "auto_paused"), (11, "auto_paused")]


def test_user_pause_blocks_auto_pause(spark, log):
    df = log(*[{"ok": False}] * 6)
    at = df.filter("check_id = 3").select("checked_at").first()[0]
    pause = spark.createDataFrame(
        [(1, at, 1, "pause", None)],
        "product_id long, at timestamp, control_id long, action string, target_paise long",
    )
    assert fired(df, controls=pause) == []


def test_target_commands_reset_the_latch(spark, log):
    df = log(*[{"price": 90000}] * 4, target=100000, threshold=0)
    schema = "product_id long, at timestamp, control_id long, action string, target_paise long"
    at = df.filter("check_id = 3").select("checked_at").first()[0]
    by_bot = spark.createDataFrame([(1, at, 1, "set_target", 95000)], schema)
    by_edit = spark.createDataFrame([(1, at, 1, "edit_target", 95000)], schema)
    assert fired(df, controls=by_bot) == [(1, "target_price"), (3, "target_price")]
    assert fired(df, controls=by_edit) == [(1, "target_price")]


def test_whole_run(log):
    """Register, drop, stay, new offer, sold out, five failures."""
    rows = [
        {"price": 4800000, "offers": ["a"]},
        {"price": 4400000, "offers": ["a"]},
        {"price": 4400000, "offers": ["a"]},
        {"price": 4400000, "offers": ["a", "b"]},
        {"stock": "out_of_stock"},
        *[{"ok": False}] * 5,
    ]
    df = log(*rows, target=4500000)
    assert fired(df, Settings()) == [
        (2, "target_price"),
        (2, "threshold_drop"),
        (4, "offer_added"),
        (10, "auto_paused"),
    ]
    assert A.history_rows(df, S).count() == 10
    state = A.product_state(df, S).first()
    assert (state.current_paise, state.stock_status, state.status) == (4400000, "out_of_stock", "paused_auto")
    assert (state.low_paise, state.high_paise, state.consecutive_failures) == (4400000, 4800000, 5)


def test_state_ignores_row_order(log):
    df = log({"price": 3}, {"price": 1}, {"price": 2})
    a = A.product_state(df, S).collect()
    b = A.product_state(df.orderBy(F.desc("check_id")), S).collect()
    assert a == b


def test_comparison_forms_are_made_once_for_both_sides(spark, log):
    """Added and removed offers come from one comparison: a form for the offers now, one for those before."""
    checks = log({"price": 100, "offers": ["A  b.", "c", "C"]}, {"price": 100, "offers": ["a B", "d", "d"]})
    found = A.alerts(checks, S, ["offer_added", "offer_removed"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2
    got = {r.type: [o.description for o in (r.added or r.removed)] for r in found.collect()}
    assert got == {"offer_added": ["d", "d"], "offer_removed": ["c", "C"]}
