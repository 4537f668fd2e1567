import pytest

from tracelake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tiny_log(spark):
    """Three library loans; 12 events with one tie in time, listed out of order, and values that vary or lack."""
    loans = {
        1: [("lend", "03-01 09:00", None), ("remind", "03-01 09:30", 8.0), ("renew", "03-01 10:00", None), ("fine", "03-01 10:00", 7.0), ("return", "03-01 11:00", None)],
        2: [("return", "03-02 09:45", 1.0), ("lend", "03-02 09:00", 2.0), ("renew", "03-02 09:15", None)],
        3: [("lend", "03-03 12:00", None), ("lost", "03-03 12:20", None), ("fine", "03-03 12:50", 9.0), ("return", "03-03 13:30", 3.0)],
    }
    data = [(c, a, f"2024-{when}:00", v) for c, events in loans.items() for a, when, v in events]
    return spark.createDataFrame([(*x, i) for i, x in enumerate(data)], "case_id long, activity string, timestamp string, outcome double, event_id long")


def rows(df, *cols):
    """Sorted list of tuples."""
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()), key=str)
