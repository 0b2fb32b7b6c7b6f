"""Where working files go, and how the package reaches the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_or_create(name: str = "lobweave", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=CONF | conf).getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir; a local master without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lobweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/work/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; where it is installed already that copy is used."""
    context = spark.sparkContext
    if getattr(context, "_lobweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("lobweave", os.path.relpath(path, here)))
    path = os.path.join(tempfile.mkdtemp(prefix="lobweave-zip-"), "lobweave.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(path)
    context._lobweave_shipped = True
