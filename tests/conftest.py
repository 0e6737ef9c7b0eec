import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.python.worker.faulthandler.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def oracle_rows(sql, sf_dir):
    """The rows of a DuckDB query over a folder of tables, in a form that can be compared."""
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return canonical(c.execute(sql).df())


def canonical(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple("\0" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False, name=None))
