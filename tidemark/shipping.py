"""Sends this package to the executors, so its functions can be loaded there wherever the driver was started, and bounds what they get at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT = "_tidemark_sent"

#: Bytes of a batch that is handed to Python, about; a longer text is a batch of its own.
BATCH_BYTES = 3 << 20


def bounded(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """`ship`, and from now on Python gets batches of bounded bytes (by default only rows are, so that memory follows the texts' lengths).

    The bound is a setting of the session, which Spark reads when a query is planned; it changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """spark, whose Python workers can import this package; sent once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, _SENT, False):
        root = Path(__file__).parent
        name = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"tidemark/{f.relative_to(root)}")
        sc.addPyFile(str(name))
        setattr(sc, _SENT, True)
    return spark
