"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a job of this library expects; cluster deployments override the sizes.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "epiframe", extra: dict | None = None) -> SparkSession:
    """A session; master and partition count are the cluster's unless asked for."""
    builder = SparkSession.builder.appName(app_name)
    conf = dict(DEFAULT_CONF)
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master is not None and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names storage every executor can reach; it is read
    from the session and never replaced. Only when it is unset (local tests) is a
    private directory chosen and registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="epiframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root}/epiframe/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str):
    """``df`` written once as Parquet below the shared checkpoint folder and read back.

    Cuts lineage in storage that every executor can reach; later passes read only the
    columns they need, which a checkpoint of whole serialised rows does not allow.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for Python-side file access in tests."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``epiframe`` importable in the Python workers of this application.

    Operators that run Python on executors (``mapInArrow``) call this once per
    application: the package's ``.py`` files are zipped and added with
    ``SparkContext.addPyFile``, which distributes the archive to every
    executor. The archive is written below the checkpoint folder when that is a
    local path, otherwise next to the driver process before Spark ships it.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import epiframe

    pkg_dir = os.path.dirname(os.path.abspath(epiframe.__file__))
    base = os.path.dirname(pkg_dir)
    root = checkpoint_root(spark)
    if root.startswith("file:") or root.startswith("/"):
        target_dir = os.path.join(local_path(root), "epiframe", f"pyfiles-{app}")
    else:
        target_dir = tempfile.mkdtemp(prefix="epiframe-pyfiles-")
    os.makedirs(target_dir, exist_ok=True)
    archive = os.path.join(target_dir, f"epiframe-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(archive)
    _SHIPPED.add(app)
