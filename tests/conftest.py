import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trailweave import build_session

    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
           "spark.default.parallelism": "4", "spark.driver.memory": "4g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """Log from {subject: "type type ..."}; ids follow the order of writing."""

    from trailweave.session import small_table

    def make(subjects: dict[str, str], repeat: int = 1):
        rows, n = [], 0
        for subject, types in subjects.items():
            for copy in range(repeat):
                for event_type in types.split():
                    rows.append((f"{n:08d}", "test", subject if repeat == 1 else f"{subject}/{copy}", event_type))
                    n += 1
        return small_table(spark, rows, "id string, source string, subject string, type string")

    return make
