import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventloom.session import get_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
                                            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


def make_events(spark, rows, props: str = ""):
    """rows: (name, user, seconds[, {prop: value}]); promoted columns for every property seen."""
    import datetime as dt
    base = dt.datetime(2024, 3, 1)
    keys = sorted({k for r in rows if len(r) > 3 for k in r[3]})
    kinds = {}
    for k in keys:
        vals = [r[3][k] for r in rows if len(r) > 3 and r[3].get(k) is not None]
        kinds[k] = "double" if vals and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vals) else "boolean" if vals and all(isinstance(x, bool) for x in vals) else "string"
    data = []
    for i, r in enumerate(rows):
        p = r[3] if len(r) > 3 else {}
        data.append((f"e{i:05d}", r[0], r[1], base + dt.timedelta(seconds=r[2]), *[(float(p[k]) if kinds[k] == "double" and p.get(k) is not None else p.get(k)) for k in keys]))
    ddl = "id string, name string, distinct_id string, timestamp timestamp" + "".join(f", `{k}` {kinds[k]}" for k in keys)
    return spark.createDataFrame(data, ddl)
