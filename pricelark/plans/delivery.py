"""Registered queries: delivery hygiene, messages and digest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.functions import clock, render
from pricelark.functions.money import format_inr
from pricelark.model import (
    ALERT_EMOJI,
    ALERT_TYPE_LABELS,
    CHUNK_MAX,
    DEFAULT_TEMPLATES,
    FAILURE_REASON_LABELS,

    Settings,
)
from pricelark.operators import alerts as A
from pricelark.operators import digest as G
from pricelark.operators import hygiene as H
from pricelark.plans.alerting import ALL_ALERTS_SQL, STATE_SQL
from pricelark.plans.registry import EVENT_ALERTS_SQL, OFFERS_SQL, query, sql
from pricelark.sources import tables as M

SETTINGS = Settings(cooldown_minutes=1440)
LOUD = replace(SETTINGS, quiet_start=None, quiet_end=None)

_LOCAL = "(fired_at + INTERVAL 330 MINUTE)"
_MINS = f"(hour({_LOCAL}) * 60 + minute({_LOCAL}))"
_QUIET = f"({_MINS} >= 1320 OR {_MINS} < 420)"
_RELEASE = f"""(date_trunc('day', {_LOCAL}) + CASE WHEN {_MINS} >= 1320 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
   + INTERVAL 420 MINUTE - INTERVAL 330 MINUTE)"""


def _plan_sql(quiet: bool) -> str:
    release = (
        f"CASE WHEN {_QUIET} AND type NOT IN ('auto_paused', 'system_health') THEN {_RELEASE} END"
        if quiet
        else "CAST(NULL AS TIMESTAMP)"
    )
    return (
        EVENT_ALERTS_SQL.strip().replace("logged AS", "RECURSIVE logged AS", 1)
        + f""",
judged AS (SELECT *, {release} AS rel, coalesce({release}, fired_at) AS eff,
             product_id IS NOT NULL AND type NOT IN ('auto_paused', 'back_in_stock', 'system_health') AS subject FROM logged),
q AS (SELECT DISTINCT product_id, type, fired_at AS t, eff FROM judged WHERE subject),
chain AS (
  SELECT product_id, type, min(t) AS t, arg_min(eff, t) AS eff FROM q GROUP BY 1, 2
  UNION ALL
  SELECT c.product_id, c.type, min(q.t), arg_min(q.eff, q.t) FROM chain c JOIN q
    ON q.product_id = c.product_id AND q.type = c.type AND q.t > c.eff + INTERVAL 1440 MINUTE
  GROUP BY c.product_id, c.type),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id, type, fired_at ORDER BY alert_id) AS nth FROM judged),
near AS (
  SELECT r.*, c.t AS ct, c.eff AS ceff FROM (SELECT * FROM ranked WHERE subject) r
  ASOF JOIN chain c ON r.product_id = c.product_id AND r.type = c.type AND r.fired_at >= c.t),
decided AS (
  SELECT alert_id, product_id, type, fired_at, change_pct, rel,
         NOT (ceff > fired_at OR (ct = fired_at AND nth = 1)) AS suppressed FROM near
  UNION ALL SELECT alert_id, product_id, type, fired_at, change_pct, rel, FALSE FROM ranked WHERE NOT subject),
plan AS (
  SELECT alert_id, product_id, type, fired_at, change_pct,
    CASE WHEN suppressed THEN 'suppressed' WHEN rel IS NOT NULL THEN 'held_quiet_hours' ELSE 'delivered' END AS status,
    CASE WHEN suppressed THEN 'cooldown 1440m' END AS reason,
    CASE WHEN NOT suppressed THEN rel END AS release_at
  FROM decided)"""
    )


@query("cooldown", sql(_plan_sql(False), "SELECT alert_id, status, reason FROM plan"))
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = H.delivery_plan(M.logged_alerts(spark, sf_dir), LOUD)
    return plan.select("alert_id", "status", "reason")


@query("quiet_hold", sql(_plan_sql(True), "SELECT * EXCLUDE (change_pct) FROM plan"))
def quiet_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.delivery_plan(M.logged_alerts(spark, sf_dir), SETTINGS).drop("change_pct")


@query(
    "quiet_flags",
    sql(
        EVENT_ALERTS_SQL,
        f"""SELECT alert_id, {_QUIET} AS quiet, CASE WHEN {_QUIET} THEN {_RELEASE} END AS release_at,
          {_MINS} AS minutes, CAST(CAST({_LOCAL} AS DATE) AS VARCHAR) AS local_date FROM logged""",
    ),
)
def quiet_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = H.quiet_flags(M.logged_alerts(spark, sf_dir), SETTINGS)
    at = F.col("fired_at")
    return flags.select(
        "alert_id",
        "quiet",
        "release_at",
        clock.minutes_of_day(at, SETTINGS.timezone).alias("minutes"),
        clock.local_date(at, SETTINGS.timezone).cast("string").alias("local_date"),
    )


@query(
    "cooldown_probe",
    sql(
        EVENT_ALERTS_SQL,
        """SELECT a.alert_id FROM logged a WHERE a.type <> 'auto_paused' AND EXISTS (
          SELECT 1 FROM logged d WHERE d.type = a.type AND d.product_id = a.product_id AND d.alert_id % 2 = 0
            AND d.fired_at <= a.fired_at AND d.fired_at >= a.fired_at - INTERVAL 720 MINUTE)""",
    ),
)
def cooldown_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = M.logged_alerts(spark, sf_dir)
    sent = log.filter(F.col("alert_id") % 2 == 0).withColumn("delivered_at", F.col("fired_at"))
    waiting = log.filter(F.col("type") != "auto_paused")
    return H.recently_delivered(waiting, sent, 720).select("alert_id")


_SHORT = "'<b>' || type || '</b>' || chr(10) || 'product ' || coalesce(CAST(product_id AS VARCHAR), '-') || chr(10) || 'alert ' || alert_id"


def _short_message():
    return F.concat(
        F.lit("<b>"),
        F.col("type"),
        F.lit("</b>\nproduct "),
        F.coalesce(F.col("product_id").cast("string"), F.lit("-")),
        F.lit("\nalert "),
        F.col("alert_id").cast("string"),
    )


@query(
    "held_summary",
    sql(
        _plan_sql(True),
        f""", held AS (SELECT *, {_SHORT} AS message,
            row_number() OVER (PARTITION BY release_at ORDER BY fired_at, alert_id) AS rn
          FROM plan WHERE status = 'held_quiet_hours'),
        lines AS (SELECT release_at, (rn - 1) // 100 AS batch, fired_at, alert_id,
            CASE WHEN type = 'target_price' THEN 0.0 WHEN type = 'threshold_drop'
                 THEN 1.0 - least(0.99, abs(change_pct) / 100) ELSE 2.0 END AS s,
            '• product ' || coalesce(CAST(product_id AS VARCHAR), '-') || ' — alert ' || alert_id AS line FROM held)
        SELECT release_at, batch, count(*) AS alerts,
          '🌙 <b>While you were away</b> — ' || count(*) || CASE WHEN count(*) = 1 THEN ' alert' ELSE ' alerts' END
          || ' held during quiet hours:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY s, fired_at, alert_id) AS message
        FROM lines GROUP BY release_at, batch""",
    ),
)
def held_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = H.delivery_plan(M.logged_alerts(spark, sf_dir), SETTINGS)
    held = plan.filter(F.col("status") == "held_quiet_hours").withColumn("message", _short_message())
    return H.held_summaries(held)


@query(
    "alert_groups",
    sql(
        EVENT_ALERTS_SQL,
        f"""SELECT coalesce(CAST(product_id AS VARCHAR), 'system') AS subject, date_trunc('hour', fired_at) AS fired_at,
          count(*) AS alerts, string_agg({_SHORT}, chr(10) || chr(10) ORDER BY alert_id) AS message
        FROM logged GROUP BY 1, 2""",
    ),
)
def alert_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole hours stand in for one check's time, so that groups have several alerts
    log = M.logged_alerts(spark, sf_dir).withColumn("message", _short_message())
    hourly = log.withColumn("fired_at", F.date_trunc("HOUR", "fired_at"))
    return H.grouped_messages(hourly, "alert_id")


@query(
    "delivery_latest",
    """WITH outcomes AS (SELECT user_id AS alert_id, ts AS at_, event_id AS seq,
        CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'delivered' WHEN 'signup' THEN 'retry' ELSE 'failed' END AS outcome,
        CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS error FROM events),
      last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY at_ DESC, seq DESC) AS rn,
        count(*) OVER (PARTITION BY alert_id) AS attempts FROM outcomes) WHERE rn = 1)
    SELECT alert_id, CASE WHEN outcome = 'retry' THEN 'pending' ELSE outcome END AS status,
      CASE WHEN outcome = 'delivered' THEN at_ END AS delivered_at, CASE WHEN outcome = 'failed' THEN error END AS error, attempts FROM last""",
)
def delivery_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcomes = M.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("alert_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", "pending")
        .when(kind == "view", "delivered")
        .when(kind == "signup", "retry")
        .otherwise("failed")
        .alias("outcome"),
        F.when(kind.isin("error", "purchase"), kind).alias("error"),
    )
    return H.latest_outcomes(outcomes)


# --- messages --------------------------------------------------------------


def inr_sql(paise: str) -> str:
    """Indian digit grouping, said with a reversed string."""
    rupees = f"CAST(abs({paise}) // 100 AS VARCHAR)"
    lead = f"left({rupees}, greatest(length({rupees}) - 3, 0))"
    grouped = f"ltrim(reverse(regexp_replace(reverse({lead}), '(\\d\\d)', '\\1,', 'g')), ',')"
    return f"""(CASE WHEN {paise} < 0 THEN '-' ELSE '' END || '₹' ||
      CASE WHEN length({rupees}) <= 3 THEN {rupees} ELSE {grouped} || ',' || right({rupees}, 3) END ||
      CASE WHEN abs({paise}) % 100 = 0 THEN '' ELSE '.' || lpad(CAST(abs({paise}) % 100 AS VARCHAR), 2, '0') END)"""


def _case(code: str, labels: dict[str, str], other: str = "NULL") -> str:
    arms = " ".join(f"WHEN {code} = '{k}' THEN '{v}'" for k, v in labels.items())
    return f"CASE {arms} ELSE {other} END"


def _num_sql(x: str) -> str:
    c = f"CAST(round(abs({x}) * 100) AS BIGINT)"
    return f"""(CAST({c} // 100 AS VARCHAR) || CASE WHEN {c} % 100 = 0 THEN '' WHEN {c} % 10 = 0 THEN '.' || (({c} % 100) // 10)
      ELSE '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0') END)"""


def _message_sql() -> str:
    """The default templates with every variable replaced, by nested replace()."""
    move = "CASE WHEN new_paise IS NOT NULL AND old_paise IS NOT NULL THEN sign(new_paise - old_paise) ELSE sign(coalesce(change_pct, 0.0)) END"
    bullets = "array_to_string(list_transform({0}, lambda x: '• ' || substr(x, instr(x, '|') + 1)), chr(10))"
    market = "CASE WHEN marketplace = 'flipkart' THEN 'Flipkart' ELSE 'Amazon India' END"
    values = {
        "emoji": f"CASE WHEN type = 'price_change' THEN CASE WHEN {move} > 0 THEN '🟡' ELSE '🟢' END ELSE {_case('type', ALERT_EMOJI)} END",
        "typeLabel": f"CASE WHEN type = 'price_change' THEN CASE WHEN {move} > 0 THEN 'Price Increased' ELSE 'Price Decreased' END ELSE {_case('type', ALERT_TYPE_LABELS)} END",
        "productName": "display_name",
        "marketplace": market,
        "link": f"'<a href=\"' || canonical_url || '\">Open on ' || {market} || '</a>'",
        "time": "replace(strftime(fired_at + INTERVAL 330 MINUTE, '%d %b %Y, %I:%M %p'), ' Sep ', ' Sept ')",
        "oldPrice": f"coalesce({inr_sql('old_paise')}, '—')",
        "newPrice": f"coalesce({inr_sql('new_paise')}, '—')",
        "price": f"coalesce({inr_sql('coalesce(new_paise, old_paise)')}, '—')",
        "changePct": f"coalesce({_num_sql('change_pct')} || '%', '—')",
        "changeArrow": f"CASE WHEN {move} > 0 THEN '▲' WHEN {move} < 0 THEN '▼' ELSE '■' END",
        "target": f"coalesce({inr_sql('fired.target_paise')}, '—')",
        "addedOffers": f"CASE WHEN len(coalesce(added, [])) = 0 THEN 'None' ELSE {bullets.format('added')} END",
        "removedOffers": f"CASE WHEN len(coalesce(removed, [])) = 0 THEN 'None' ELSE {bullets.format('removed')} END",
        "failureReason": _case("failure_reason", FAILURE_REASON_LABELS, "'Repeated failures'"),
        "failureCount": "'5'",
    }
    text = _case("type", DEFAULT_TEMPLATES)
    for name, value in values.items():
        text = f"replace({text}, '{{{{{name}}}}}', {value})"
    return text


_OUT_SQL = (
    OFFERS_SQL
    + """,
runs AS (
  SELECT product_id, check_id, checked_at, failure_reason, success, fails_upto - coalesce(max(CASE WHEN success THEN fails_upto END) OVER (
      PARTITION BY product_id ORDER BY checked_at, check_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run_len FROM past),
pauses AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at, check_id) AS nth
    FROM runs WHERE NOT success AND run_len = 5) WHERE nth = 1),
fired AS (
  SELECT product_id, check_id, checked_at AS fired_at, 0 AS rule, 'target_price' AS type, CASE WHEN had_success THEN prev_price END AS old_paise,
    price_paise AS new_paise, target_paise, move_pct AS change_pct, CAST([] AS VARCHAR[]) AS added, CAST([] AS VARCHAR[]) AS removed, NULL AS failure_reason FROM rules WHERE f_target
  UNION ALL SELECT product_id, check_id, checked_at, 1, 'threshold_drop', prev_price, price_paise, NULL, move_pct, [], [], NULL FROM rules WHERE f_drop
  UNION ALL SELECT product_id, check_id, checked_at, 2, 'price_change', prev_price, price_paise, NULL, move_pct, [], [], NULL FROM rules WHERE f_moved AND NOT f_target AND NOT f_drop
  UNION ALL SELECT product_id, check_id, checked_at, 3, 'offer_added', NULL, price_paise, NULL, NULL, added, [], NULL FROM diffs WHERE len(added) > 0
  UNION ALL SELECT product_id, check_id, checked_at, 4, 'offer_removed', NULL, price_paise, NULL, NULL, [], removed, NULL FROM diffs WHERE len(removed) > 0
  UNION ALL SELECT product_id, check_id, checked_at, 5, 'back_in_stock', NULL, price_paise, NULL, NULL, [], [], NULL FROM rules WHERE f_back
  UNION ALL SELECT product_id, check_id, checked_at, 6, 'auto_paused', NULL, NULL, NULL, NULL, [], [], failure_reason FROM pauses)"""
)


@query(
    "outbox",
    sql(
        _OUT_SQL,
        f""", texts AS (SELECT fired.product_id, fired_at, rule, {_message_sql()} AS message
          FROM fired JOIN products p ON p.product_id = fired.product_id)
        SELECT CAST(product_id AS VARCHAR) AS subject, fired_at, count(*) AS alerts,
          string_agg(message, chr(10) || chr(10) ORDER BY rule) AS message
        FROM texts GROUP BY product_id, fired_at""",
    ),
)
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check's alerts rendered into one message."""
    found = A.alerts(M.check_log(spark, sf_dir), SETTINGS)
    rendered = G.rendered(found, M.products(spark, sf_dir), SETTINGS)
    return H.grouped_messages(rendered, "rule")


@query(
    "outbox_chunks",
    f"""WITH RECURSIVE base AS (SELECT doc_id, text, length(text) AS n FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
              FROM base WHERE n > {CHUNK_MAX}),
    pieces AS (
      SELECT doc_id, i, CAST(k AS BIGINT) AS k, CASE WHEN length(line) > {CHUNK_MAX} THEN substr(line, CAST(k * {CHUNK_MAX} + 1 AS BIGINT), {CHUNK_MAX}) ELSE line END AS s,
             length(line) > {CHUNK_MAX} AS whole
      FROM lines, range(0, CAST(CASE WHEN length(line) > {CHUNK_MAX} THEN ceil(length(line) / {CHUNK_MAX}.0) ELSE 1 END AS BIGINT)) t(k)),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS n FROM pieces),
    -- state after each piece: length of the open part, and the chunk the piece belongs to
    walk AS (
      SELECT doc_id, n, CAST(CASE WHEN whole THEN 0 ELSE length(s) END AS BIGINT) AS cur,
             CAST(CASE WHEN whole THEN 0 WHEN 0 + length(s) + 1 > {CHUNK_MAX} THEN 1 ELSE 0 END AS BIGINT) AS chunk,
             CAST(CASE WHEN whole THEN 1 WHEN length(s) + 1 > {CHUNK_MAX} THEN 1 ELSE 0 END AS BIGINT) AS closed FROM p WHERE n = 1
      UNION ALL
      SELECT p.doc_id, p.n,
        CAST(CASE WHEN whole THEN 0 WHEN cur + length(s) + 1 > {CHUNK_MAX} THEN length(s)
             WHEN cur > 0 THEN cur + 1 + length(s) ELSE length(s) END AS BIGINT),
        CAST(CASE WHEN whole THEN closed + CASE WHEN cur > 0 THEN 1 ELSE 0 END
             WHEN cur + length(s) + 1 > {CHUNK_MAX} THEN closed + 1 ELSE closed END AS BIGINT),
        CAST(CASE WHEN whole THEN closed + CASE WHEN cur > 0 THEN 1 ELSE 0 END + 1
             WHEN cur + length(s) + 1 > {CHUNK_MAX} THEN closed + 1 ELSE closed END AS BIGINT)
      FROM walk JOIN p ON p.doc_id = walk.doc_id AND p.n = walk.n + 1),
    long AS (SELECT walk.doc_id, chunk, count(*) AS lines FROM walk GROUP BY 1, 2)
    SELECT doc_id, count(*) AS parts, (SELECT max(CASE WHEN whole THEN length(s) ELSE cur END) FROM walk w JOIN p USING (doc_id, n)
        WHERE w.doc_id = parted.doc_id) AS longest FROM (SELECT doc_id, chunk FROM long
      WHERE EXISTS (SELECT 1 FROM walk w JOIN p USING (doc_id, n) WHERE w.doc_id = long.doc_id AND w.chunk = long.chunk AND length(s) > 0)) AS parted
      GROUP BY doc_id
    UNION ALL SELECT doc_id, 1, n FROM base WHERE n <= {CHUNK_MAX}""",
)
def outbox_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.spread(M.table(spark, sf_dir, "documents"))
    parts = F.filter(render.chunks(F.col("text")), lambda c: c != "")
    longest = F.array_max(F.transform(parts, render.units)).cast("bigint")
    return docs.select("doc_id", F.size(parts).cast("bigint").alias("parts"), longest.alias("longest"))


DIGEST_SQL = sql(
    ALL_ALERTS_SQL + STATE_SQL[len(OFFERS_SQL) :].replace("runs AS", "runs2 AS").replace("FROM runs GROUP", "FROM runs2 GROUP"),
    f""", recent AS (SELECT * FROM all_alerts WHERE fired_at >= TIMESTAMP '2001-08-31' AND fired_at <= TIMESTAMP '2001-09-01'),
    counts AS (SELECT count(*) FILTER (type IN ('threshold_drop', 'target_price')) AS drops,
        count(*) FILTER (type IN ('offer_added', 'offer_removed', 'offer_change')) AS offer_changes,
        count(*) FILTER (type = 'back_in_stock') AS back_in_stock FROM recent),
    top AS (SELECT string_agg('• ' || display_name || ': ' || {inr_sql('new_paise')} || ' (' || coalesce(
          CASE WHEN change_pct < 0 THEN '-' ELSE '' END || {_num_sql('change_pct')}, '—') || '%)', chr(10)
          ORDER BY change_pct NULLS LAST, product_id, type) AS t FROM (
        SELECT recent.*, p.display_name FROM recent JOIN products p USING (product_id) WHERE type IN ('threshold_drop', 'target_price')
        ORDER BY change_pct NULLS LAST, product_id, type LIMIT 5)),
    lows AS (SELECT string_agg('• ' || display_name || ' — ' || {inr_sql('current_paise')} || ' on ' ||
          CASE WHEN marketplace = 'flipkart' THEN 'Flipkart' ELSE 'Amazon India' END, chr(10)
          ORDER BY CAST(current_paise AS DOUBLE) / low_paise, product_id) AS t FROM (
        SELECT s.*, p.display_name, p.marketplace FROM state s JOIN products p USING (product_id)
        WHERE status = 'active' AND current_paise * 10000 <= low_paise * 10200
        ORDER BY CAST(current_paise AS DOUBLE) / low_paise, product_id LIMIT 5)),
    paused AS (SELECT count(*) AS n FROM state WHERE status = 'paused_auto')
    SELECT drops, offer_changes, back_in_stock, concat_ws(chr(10) || chr(10),
      '📰 <b>Price monitor daily digest</b>',
      drops || ' price drop' || CASE WHEN drops = 1 THEN '' ELSE 's' END || ', ' || offer_changes || ' offer change' ||
        CASE WHEN offer_changes = 1 THEN '' ELSE 's' END || ', ' || back_in_stock || ' back in stock.',
      top.t, '🔥 At or near recorded lows:' || chr(10) || lows.t,
      CASE WHEN paused.n > 0 THEN '⚠️ ' || paused.n || ' product' || CASE WHEN paused.n = 1 THEN '' ELSE 's' END || ' auto-paused and needing attention.' END,
      CASE WHEN drops + offer_changes + back_in_stock = 0 AND lows.t IS NULL THEN 'No changes across your catalogue this period.' END) AS message
    FROM counts, top, lows, paused""",
)


@query("digest", DIGEST_SQL)
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = M.check_log(spark, sf_dir)
    products = M.products(spark, sf_dir)
    state = A.product_state(checks, SETTINGS).join(
        products.select("product_id", "display_name", "marketplace"), "product_id"
    )
    found = A.alerts(checks, SETTINGS).filter(
        (F.col("fired_at") >= M.as_of("2001-08-31 00:00:00")) & (F.col("fired_at") <= M.as_of())
    )
    return G.digest(found, products, state, SETTINGS)


@query(
    "digest_due",
    """WITH x AS (SELECT event_id, ['off', 'daily', 'weekly'][user_id % 3 + 1] AS frequency,
        CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN '7:5' ELSE lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') || ':30' END AS digest_time,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts - to_minutes(CAST(floor(value * 60) AS BIGINT)) END AS last_at, ts FROM events),
      y AS (SELECT *, hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE) AS mins,
        CASE WHEN digest_time IS NULL OR digest_time = '7:5' THEN 540
             ELSE CAST(left(digest_time, 2) AS INTEGER) * 60 + 30 END AS send_at,
        CAST(epoch_us(ts) - epoch_us(last_at) AS DOUBLE) / 3.6e9 AS hours FROM x)
    SELECT event_id, coalesce(frequency <> 'off' AND mins >= send_at AND
      (last_at IS NULL OR hours >= CASE WHEN frequency = 'daily' THEN 20.0 ELSE 144.0 END), FALSE) AS due FROM y""",
)
def digest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    frequency = F.element_at(
        F.array(F.lit("off"), F.lit("daily"), F.lit("weekly")), (user % 3 + 1).cast("int")
    )
    at = F.when(user % 5 == 0, F.lit(None).cast("string")).when(user % 5 == 1, "7:5").otherwise(
        F.concat(F.lpad((user % 24).cast("string"), 2, "0"), F.lit(":30"))
    )
    back = F.make_dt_interval(mins=F.floor(F.col("value") * 60).cast("int"))
    last = F.when(F.col("event_id") % 4 != 0, F.col("ts") - back)
    return M.table(spark, sf_dir, "events").select(
        "event_id", clock.digest_due(frequency, at, last, F.col("ts"), "Asia/Kolkata").alias("due")
    )


@query(
    "format_amount",
    f"SELECT DISTINCT p AS paise, {inr_sql('p')} AS text FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) * (1 + o_orderkey % 1000) AS p FROM orders)",
)
def format_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    paise = F.round(F.col("o_totalprice") * 100).cast("bigint") * (1 + F.col("o_orderkey") % 1000)
    orders = M.table(spark, sf_dir, "orders").select(paise.alias("paise")).distinct()
    return orders.select("paise", format_inr(F.col("paise")).alias("text"))


