from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Intermediate tables of the tests go to pytest's own folder."""
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))

