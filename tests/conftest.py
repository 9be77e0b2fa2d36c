import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from murmuration.operators.graph import PropertyGraph
from murmuration.schemas import EDGE_SCHEMA, VERTEX_SCHEMA
from murmuration.session import build_session

from golden import EDGES, VERTICES


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="8g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="murmuration-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    vertices = spark.createDataFrame(VERTICES, VERTEX_SCHEMA).cache()
    edges = spark.createDataFrame(EDGES, EDGE_SCHEMA).cache()
    return PropertyGraph(vertices, edges)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
