"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, so that they need no copy of it on their path.

    Arrow batches are bounded by bytes too, unless the session says how: rows hold
    texts of any length, and a task and its worker each hold a batch whole.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, "4m")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        path = os.path.join(tempfile.mkdtemp(prefix="memlake-ship-"), "memlake_code.zip")
        Path(path).write_bytes(raw.getvalue())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share; a session on one machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share before the session starts")
        base = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="memlake-"))
    return f"{base.rstrip('/')}/memlake-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: it is computed once, and lineage ends here."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(name: str = "memlake", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, adaptive execution)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())
