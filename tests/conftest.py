import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same_rows(spark_df, duck_rel) -> None:
    """Both have the same columns and, in any order, the same values."""
    import pandas as pd

    def tidy(df):
        df = df.reindex(sorted(df.columns), axis=1)
        for c in df.columns:
            if df[c].dtype == object:
                df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT else str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x).removesuffix(" 00:00:00"))
            elif str(df[c].dtype).startswith("datetime"):
                df[c] = df[c].dt.strftime("%Y-%m-%d").where(df[c].notna(), None)
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    a, b = tidy(spark_df.toPandas()), tidy(duck_rel.df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            assert (a[c].isna() == b[c].isna()).all(), c
            assert ((a[c].astype(float) - b[c].astype(float)).abs().fillna(0) <= 1e-6).all(), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
