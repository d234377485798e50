"""What the operators share: column selection, tables in the shared folder, words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BYTES_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Tables written to the shared folder, with the scope that was current then.
_tables: list[tuple[SparkSession, str, str]] = []
_scope = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="docframe-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a Parquet table in the shared folder and read from there: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docframe/{name}-{uuid.uuid4().hex}"
    register(spark, path)
    df.write.parquet(path)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.docframe_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Between queries the driver's JVM gives free memory back: its heap shrinks, Spark forgets shuffles and broadcasts of queries
    that ended, and memory its compilers and threads have freed returns to the system."""
    try:
        jvm, lang = spark._jvm, spark._jvm.java.lang
        lang.System.gc()

        def array(kind, *items):
            out = spark.sparkContext._gateway.new_array(kind, len(items))
            for i, x in enumerate(items):
                out[i] = x
            return out

        # by the interface, as the class of the server is closed
        kinds = array(lang.Class, *map(lang.Class.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = array(lang.Object, bean, "systemTrimNativeHeap", array(lang.Object, array(lang.String)), array(lang.String, "[Ljava.lang.String;"))
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # no classic session, or a JVM without the command: memory stays with it
        pass


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`stored`; its readers must have ended."""
    _delete(lambda item: item[1] == table.docframe_path)


def register(spark: SparkSession, path: str) -> None:
    """The folder is deleted with the current scope, at the latest when Python ends."""
    _tables.append((spark, path, _scope))


def scope(name: str) -> None:
    """Tables belong to this scope from now on."""
    global _scope
    _scope = name


def release_scope(name: str | None = None) -> None:
    """Delete a scope's tables, or all; their readers must have ended."""
    _delete(lambda item: name is None or item[2] == name)


def _delete(chosen) -> None:
    for item in [x for x in _tables if chosen(x)]:
        spark, path, _ = item
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            pass
        _tables.remove(item)


atexit.register(release_scope)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The column as a text, null as the empty one."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], column: int = 0, rows: int = 1000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``rows`` rows, and ``size`` bytes of text unless it is one text."""
    for whole in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(whole.column(column)).cast(pa.int64()), 0)).to_numpy()
        at = before = 0
        while at < whole.num_rows:
            n = max(1, min(rows, int(ends.searchsorted(before + size, side="right")) - at))
            yield whole.slice(at, n)
            at, before = at + n, int(ends[at + n - 1])


def tidy(run: Callable) -> Callable:
    """The function over batches; when a task of it ends, its worker, which Spark keeps for other tasks, gives free memory back."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return tidied


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")
