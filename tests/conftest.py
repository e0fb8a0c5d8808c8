import logging
import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
logging.getLogger("py4j").setLevel(logging.ERROR)

from pricelark.model import CHECKS  # noqa: E402
from pricelark.session import build_session, ensure_checkpoint_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
START = datetime(2026, 7, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Rows of one or more products from short dicts, an hour apart."""

    def build(*rows, **rules):
        out = []
        for i, r in enumerate(rows):
            r = {"ok": True, "stock": "in_stock", "price": None, "offers": [], "product": 1, **rules, **r}
            out.append(
                (
                    i + 1,
                    r["product"],
                    r.get("at", START + timedelta(hours=i)),
                    r["ok"],
                    r["stock"] if r["ok"] else "unknown",
                    r["price"],
                    r.get("mrp"),
                    [("other", d) if isinstance(d, str) else d for d in r["offers"]],
                    "http",
                    None if r["ok"] else r.get("reason", "captcha"),
                    10,
                    r.get("target"),
                    r.get("threshold"),
                )
            )
        return spark.createDataFrame(out, CHECKS)

    return build
