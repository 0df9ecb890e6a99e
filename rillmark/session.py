"""Sessions, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: By these, glibc and Arrow give freed arrays back to the system; by default a worker keeps much of what its largest task took.
LEAN = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; Python workers there import it by name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = f"{tempfile.mkdtemp(prefix='rillmark-')}/rillmark.zip"
    with zipfile.ZipFile(to, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def lean(spark: SparkSession) -> None:
    """Python workers of functions that are made from now on give back what they free, for a little time: for jobs of several operators, whose workers stay."""
    spark.sparkContext.environment.update(LEAN)


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session on this machine with the settings that the engine's tests and benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("rillmark").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
