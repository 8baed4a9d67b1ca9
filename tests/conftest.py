import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("faultline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def extract_dir(tmp_path_factory):
    from tests.incident_fixture import write_extracts

    folder = tmp_path_factory.mktemp("extracts")
    write_extracts(folder)
    return str(folder)


@pytest.fixture(scope="session")
def batch(spark, extract_dir, tmp_path_factory):
    """One finished batch run over the hand-made incidents: (ledger row, warehouse, as_of-free outputs)."""
    from faultline.plans.batch import run_batch
    from faultline.sources.warehouse import Warehouse

    root = str(tmp_path_factory.mktemp("warehouse"))
    row = run_batch(spark, extract_dir, root, run_id="RUN-1")
    return row, Warehouse(spark, root)


@pytest.fixture(scope="session")
def core(batch):
    from faultline import schemas

    return {name: batch[1].snapshot("core", name) for name in schemas.CORE}
