from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def profiles(spark):
    """Three customers: none, one and three orders."""
    rows = [
        (1, "A", "18-24", 20, "2022-01-01", True, 0, 0.0, None, None, None, "2022-05-01", "2022-06-01", 4, 1, 0, None),
        (2, "B", "35-44", 40, "2022-02-01", False, 1, 50.0, 4.0, "2022-02-10", "2022-02-10", "2022-03-01", "2022-07-01", 2, 0, 0, "web"),
        (3, None, "??", 60, "2022-03-01", True, 3, 300.0, None, "2022-03-05", "2022-06-10", "2022-02-27", "2022-08-01", 9, 0, 1, None),
    ]
    return spark.createDataFrame(
        rows,
        "customer_id bigint, country string, age_group string, age bigint, signup_date string, marketing_opt_in boolean, "
        "total_orders bigint, total_spend_usd double, avg_rating_given double, first_order_date string, last_order_date string, "
        "first_session_date string, last_session_date string, total_sessions bigint, has_abandoned_cart bigint, "
        "is_repeat_customer bigint, preferred_device_sess string",
    ).selectExpr("*", "cast(null as string) as preferred_source_sess")
