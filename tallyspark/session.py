"""Session settings and durable intermediate tables."""

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
#: For each application and source file, the loader of the classes made of it.
_loaders: dict[tuple[str, str], object] = {}
_loading = threading.Lock()
#: For each thread, the paths that `materialize` wrote inside its open `scratch` blocks.
_open_scratch = threading.local()


def local_session(app: str = "tallyspark", cores: int | str = "*") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Falls back to a scratch folder of this machine only in local mode, where
    driver and executors are the same process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tallyspark-")
    return _local_dirs[context.applicationId]


def wide(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row, which size-based coalescing would squeeze into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    file_system, at = _file_system(spark, path)
    return file_system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote."""
    file_system, at = _file_system(spark, path)
    file_system.delete(at, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    file_system, at = _file_system(spark, source)
    if not file_system.rename(at, _file_system(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that `materialize` writes inside are removed at the end; results must be stored or collected by then."""
    blocks = _open_scratch.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            remove(spark, path)


def materialize(df: DataFrame, label: str, *, outlives: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where several passes read a result that is costly to compute. The
    table outlives lost executors, keeps its columns prunable and gives the
    optimizer true sizes. With `outlives` it stays when the innermost `scratch`
    block ends, and belongs to the block around that, if any.
    """
    path = scratch_path(df.sparkSession, label)
    blocks = getattr(_open_scratch, "blocks", [])
    if len(blocks) > outlives:
        blocks[-1 - outlives].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def jvm_object(spark: SparkSession, source: str, class_name: str, *arguments):
    """A new object of a class in a Java file, which executors can load too.

    The file is compiled once an application, by the compiler that Spark uses for its generated code, so no machine needs a
    development kit. Executors fetch the classes from the driver like any jar added to a running application.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    with _loading:
        known = (spark.sparkContext.applicationId, source)
        if known not in _loaders:
            parent = jvm.java.lang.Thread.currentThread().getContextClassLoader()
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(parent)
            with open(source, encoding="utf-8") as text:
                compiler.cook(text.read())
            path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-"), f"tallyspark-{uuid.uuid4().hex}.jar")
            with zipfile.ZipFile(path, "w") as jar:
                for name, code in dict(compiler.getBytecodes()).items():
                    jar.writestr(name.replace(".", "/") + ".class", bytes(code))
            spark.sparkContext._jsc.addJar(path)
            urls = gateway.new_array(jvm.java.net.URL, 1)
            urls[0] = jvm.java.io.File(path).toURI().toURL()
            _loaders[known] = jvm.java.net.URLClassLoader(urls, parent)
    # Plain and boxed numbers look alike from Python, so the constructor is given as many arguments as it takes.
    values = gateway.new_array(jvm.java.lang.Object, len(arguments))
    for i, argument in enumerate(arguments):
        values[i] = argument
    return _loaders[known].loadClass(class_name).getConstructors()[0].newInstance(values)
