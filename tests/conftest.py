import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from endpointlens.schema import EVENT  # noqa: E402
from endpointlens.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


BLANK = {"host": "h1", "tenant_id": "1", "type": "process", "ts": 1000, "process": "",
         "parent": "", "cmdline": "", "dest_ip": "", "dest_port": 0, "domain": "", "detail": "",
         "sha256": "", "ingested_at": 0}


@pytest.fixture(scope="session")
def make_events(spark):
    """Event rows from dicts; `seq` is the position unless given."""
    def build(rows):
        full = [{**BLANK, "seq": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[f.name] for f in EVENT.fields) for r in full], EVENT)
    return build
