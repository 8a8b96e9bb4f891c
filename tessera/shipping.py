"""Getting this package to the executors' Python, wherever the driver found it."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession

from tessera.checkpoints import shared_folder


def ship(spark: SparkSession) -> None:
    """Adds the package, as a zip file in the shared folder, to the session's Python files; once for each context."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = Path(__file__).parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"tessera/{p.relative_to(root)}"), p.read_bytes())
    uri = f"{shared_folder(spark)}/tessera-{hashlib.md5(out.getvalue()).hexdigest()}.zip"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(out.getvalue())
    context.addPyFile(uri)
    context._tessera_shipped = True
