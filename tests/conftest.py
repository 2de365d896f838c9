import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from churnspark.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def telco(spark, n=120, seed=1, churn=0.35, **extra):
    """A small customer table of the shape in FIXTURES.md A."""
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        contract = rng.choice(["Month-to-month", "One year", "Two year"])
        tenure = rng.randint(1, 71)
        risk = churn + (0.35 if contract == "Month-to-month" else -0.2) - 0.004 * tenure
        rows.append((
            f"ID{i}", tenure, round(rng.uniform(20, 110), 2), contract,
            rng.choice(["Electronic check", "Mailed check", "Credit card"]),
            rng.choice(["DSL", "Fiber optic", "No"]), "Yes" if rng.random() < risk else "No",
        ))
    return spark.createDataFrame(
        rows, "customerID string, tenure int, MonthlyCharges double, Contract string, PaymentMethod string, "
        "InternetService string, Churn string",
    )
