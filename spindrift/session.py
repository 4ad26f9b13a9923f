"""What a session needs before Python functions of this package can run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="spindrift-"), "spindrift.zip")
        with zipfile.ZipFile(to, "w") as z:
            for top, dirs, names in os.walk(here):
                dirs[:] = sorted(d for d in dirs if d != "__pycache__")
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(to)
        _shipped.add(sc.applicationId)
    return spark
