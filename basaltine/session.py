"""Sessions, and code for the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the plans here expect."""
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()


def _probe(batches):
    import importlib.util

    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("basaltine") is not None] * b.num_rows)], ["ok"])


_probe.__module__ = "__main__"  # pickled by value: workers may lack this package


@functools.cache
def _archive() -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="basaltine-code-"), "basaltine.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(ROOT, "basaltine")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), ROOT))
    return path


_ready: set[str] = set()


def ensure_code(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that can't import it."""
    app = spark.sparkContext.applicationId
    if app not in _ready:
        if not spark.range(1).mapInArrow(_probe, "ok boolean").first()[0]:
            spark.sparkContext.addPyFile(_archive())
        _ready.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_code(spark)
        return query(spark, sf_dir)

    return run
