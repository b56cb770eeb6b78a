import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from cellsieve.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def fine(spark, sf_dir):
    from cellsieve.checks import standins

    return standins.fine_index(standins.items(spark, sf_dir))


@pytest.fixture(scope="session")
def local(fine):
    """The index on the driver, for brute-force comparison: ids, unit vectors, cells, metadata, centroids."""
    import numpy as np

    rows = fine.vectors.orderBy("item_id").collect()
    return {
        "ids": np.array([r["item_id"] for r in rows]),
        "vectors": np.array([r["embedding"] for r in rows], dtype="float64"),
        "cells": np.array([r["cell_id"] for r in rows]),
        "token_count": np.array([r["token_count"] for r in rows]),
        "revdate": np.array([str(r["revdate"]) for r in rows]),
        "centroids": fine.cells.matrix,
    }


@pytest.fixture(scope="session")
def queries(spark, sf_dir):
    from cellsieve.checks import standins
    from cellsieve.session import cut

    return cut(standins.prototypes(spark, sf_dir))


@pytest.fixture(scope="session")
def query_vectors(queries):
    import numpy as np

    from cellsieve.operators.scoring import unit_queries

    return {r["qid"]: np.array(r["qvec"], dtype="float64") for r in unit_queries(queries).collect()}
