"""Product state and alerts kept in stored tables: parts of the log are folded onto them, readers never fold."""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.model import Settings
from pricelark.operators.alerts import ALERT_COLUMNS, carried_state, continue_log, evaluate, folded
from pricelark.sources import folders
from pricelark.sources.sinks import append_alerts, stored_rows
from pricelark.sources.state_table import StateTable

KEY = "product_id"


def _packed(df: DataFrame, name: str) -> DataFrame:
    return df.select(KEY, F.struct(*[c for c in df.columns if c != KEY]).alias(name))


@dataclass(frozen=True)
class Monitor:
    """The stored side of the check log: a state table by product and an alert table in day folders."""

    spark: SparkSession
    folder: str
    settings: Settings
    buckets: int = 64

    @property
    def table(self) -> StateTable:
        return StateTable(self.spark, f"{self.folder}/products", (KEY,), self.buckets)

    def ingest(self, part: int, checks: DataFrame, limit: int | None = None) -> bool:
        """Fold the next part of the check log and append its alerts; a part that comes again changes nothing.

        Only the buckets of the part's products are read and rewritten. Rows hold the running values of
        the scan (``run``), the product's state (``state``) and how much there is of it (``totals``), so
        all move together. Alerts are written first: a run that dies before the state moves appends
        them once more, and they are left out then as already there.
        """

        def step(old: DataFrame | None) -> DataFrame:
            run = products = totals = None
            if old is not None:
                run, products = old.select(KEY, "run.*"), old.select(KEY, "state.*")
                totals = old.select(KEY, "totals.*")
            # state, alerts and counts come from one scan
            log, run = continue_log(part_rows, self.settings, run, limit, keep)
            found = keep(evaluate(log, self.settings))
            append_alerts(found, f"{self.folder}/alerts")
            state = carried_state(folded(log), products)
            return (
                _packed(run, "run")
                .join(_packed(state, "state"), KEY)
                .join(_packed(_added(_totals(log, found), totals), "totals"), KEY)
            )

        if part <= self.table.version().part:
            return False
        with ExitStack() as until_applied:

            def keep(rows: DataFrame) -> DataFrame:
                return until_applied.enter_context(stored_rows(rows))

            part_rows = keep(checks)
            return self.table.apply(part, part_rows.select(KEY), step)

    def state(self) -> DataFrame:
        """One row per product as of the newest version."""
        return self.table.read().select(KEY, "state.*")

    def totals(self) -> DataFrame:
        """(product_id, history_count, alert_count)."""
        return self.table.read().select(KEY, "totals.*")

    def alerts(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Alerts, of some days only if asked; only the folders of these days are listed."""
        path = f"{self.folder}/alerts"
        days = folders.values(self.spark, path, "fired_date")
        wanted = [d for d in days if d and (since is None or d >= since) and (until is None or d <= until)]
        paths = [f"{path}/{days[d]}" for d in wanted]
        return self.spark.read.schema(ALERT_COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], ALERT_COLUMNS)


def _totals(log: DataFrame, found: DataFrame) -> DataFrame:
    checks = log.groupBy(KEY).agg(F.count("*").alias("history_count"))
    fired = found.groupBy(KEY).agg(F.count("*").alias("alert_count"))
    return checks.join(fired, KEY, "left").na.fill(0, ["alert_count"])


def _added(new: DataFrame, old: DataFrame | None) -> DataFrame:
    both = new if old is None else new.unionByName(old)
    return both.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in ("history_count", "alert_count")])
