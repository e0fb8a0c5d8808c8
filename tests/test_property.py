"""A plain state machine, the window form, the sliced form and the carried form agree."""

import math
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pricelark.model import CHECKS, Settings
from pricelark.operators import alerts as A

S = Settings(failure_limit=3)
KINDS = ["target_price", "threshold_drop", "price_change", "back_in_stock", "auto_paused"]

row = st.tuples(
    st.integers(1, 3),
    st.booleans(),
    st.sampled_from(["in_stock", "out_of_stock", "unknown"]),
    st.one_of(st.none(), st.integers(900, 1100)),
)


def to_rows(rows):
    start = datetime(2026, 1, 1)
    out = []
    for i, (product, ok, stock, price) in enumerate(rows):
        live = ok and stock != "out_of_stock"
        out.append(
            (i, product, start + timedelta(minutes=i), ok, stock if ok else "unknown", price if live else None,
             None, [], "http", None if ok else "captcha", 1, 1000 if product != 2 else None, 300 if product == 3 else None)
        )
    return out


def change(old, new):
    return math.floor((new - old) / old * 10000.0 + 0.5) / 100.0


def machine(rows):
    """One check at a time, with mutable state per product."""
    states, out = {}, []
    for check_id, product, _, ok, stock, price, _, _, _, _, _, target, bp in rows:
        s = states.setdefault(
            product, dict(price=None, stock=None, latched=False, seen=False, fails=0, paused=False)
        )
        if not ok:
            s["fails"] += 1
            if s["fails"] >= S.failure_limit and not s["paused"]:
                s["paused"] = True
                out.append((check_id, "auto_paused", None, None))
            continue
        prev = s["price"] if s["seen"] else None
        move = change(prev, price) if prev is not None and price is not None else None
        specific = False
        if price is not None and target is not None and stock != "out_of_stock":
            if price <= target and not s["latched"]:
                out.append((check_id, "target_price", prev, move))
                specific = True
            s["latched"] = price <= target
        if target is None:
            s["latched"] = False
        if price is not None and prev is not None:
            limit = S.threshold_bp if bp is None else bp
            if limit > 0 and (prev - price) * 10000 >= limit * prev:
                out.append((check_id, "threshold_drop", prev, move))
                specific = True
            if price != prev and not specific:
                out.append((check_id, "price_change", prev, move))
        if s["seen"] and s["stock"] == "out_of_stock" and stock == "in_stock":
            out.append((check_id, "back_in_stock", None, None))
        if price is not None and stock != "out_of_stock":
            s["price"] = price
        s.update(stock=stock, seen=True, fails=0)
    return sorted(out, key=repr)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=120), st.integers(1, 119))
def test_forms_agree(spark, rows, cut):
    data = to_rows(rows)
    df = spark.createDataFrame(data, CHECKS)

    def of(frame):
        return sorted(((r.check_id, r.type, r.old_paise, r.change_pct) for r in frame.collect()), key=repr)

    want = machine(data)
    assert of(A.alerts(df, S, KINDS)) == want
    assert of(A.alerts(df, S, KINDS, limit=10)) == want

    # in two parts, the second one from the state of the first
    state, found = None, []
    for part in (data[:cut], data[cut:]):
        if part:
            annotated, state = A.continue_log(spark.createDataFrame(part, CHECKS), S, state, limit=10)
            state = state.checkpoint()
            found += of(A.evaluate(annotated, S, KINDS))
    assert sorted(found, key=repr) == want
