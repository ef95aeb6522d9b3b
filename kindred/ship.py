"""Make this package importable on executors, once per Spark application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Bytes that go to a Python worker at once: texts are long, and both sides hold whole batches.
BATCH_BYTES = str(8 << 20)
BATCH_ROWS = "4096"


def ship(spark: SparkSession) -> None:
    """Also bounds Arrow batches by bytes and rows, where nobody has set these; what somebody set stays."""
    for name, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="kindred-")) / "kindred_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
