import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidepanel.session import local_session

    session = local_session("*", 8, "tidepanel-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def train(spark):
    """Labelled fixture rows, computed once."""
    from tidepanel.plans import catalog

    df = catalog.train(spark, ROOT, True).persist()
    df.count()
    return df


@pytest.fixture(scope="session")
def folds(train):
    from tidepanel.operators.time_axis import expanding_folds

    return expanding_folds(train)


@pytest.fixture
def panel_rows(spark):
    """Build a panel from dicts; columns that are not given are NULL."""
    from tidepanel import schema as S

    def build(rows, label=False):
        names = [f.name for f in S.PANEL_SCHEMA]
        schema = S.PANEL_SCHEMA
        if label:
            from pyspark.sql import types as T

            schema = T.StructType([*S.PANEL_SCHEMA.fields, T.StructField(S.TARGET, T.DoubleType()), T.StructField(S.LABEL, T.IntegerType())])
            names = [f.name for f in schema]
        data = [tuple(r.get(n, i if n == S.ROW_ID else None) for n in names) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, schema)

    return build
