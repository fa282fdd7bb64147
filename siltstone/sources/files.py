"""Files: lines of JSON, Markdown folders, versioned tables, compressed columns."""

from __future__ import annotations

import json
import tempfile
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in local mode where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        named = sc.getCheckpointDir()
    return named


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Lines of JSON; blank lines are skipped. Malformed ones raise, or are dropped if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def read_markdown(spark: SparkSession, root: str, name: str, skip: tuple[str, ...] = ("CHANGELOG", "CONTRIBUTING", "LICENSE", "README")) -> DataFrame:
    """url, title, text of the Markdown files below a folder, but for some names and for folders of packages."""
    path = F.col("path")
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("text"))
    inner = F.substring_index(path, root.rstrip("/") + "/", -1)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    return rows.where(~F.upper(stem).isin([s.upper() for s in skip]) & ~path.rlike("/(node_modules|\\.git)/")).select(F.concat(F.lit(f"md://{name}/"), inner).alias("url"), stem.alias("title"), "text")


@F.arrow_udf(BinaryType())
def zstd(raw: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=6)
    return pa.array([None if b is None else pack.compress(b) for b in raw.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def unzstd(packed: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([None if b is None else unpack.decompress(b) for b in packed.to_pylist()], pa.binary())


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds n, the place of each row by a key, from 0, without bringing all rows into one task: sorted ranges, then their sizes."""
    parts = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    marked = parts.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")).checkpoint()
    sizes = sorted((r["__p"], r["n"]) for r in marked.groupBy("__p").agg(F.count("*").alias("n")).collect())  # one row a task
    before, starts = 0, {}
    for p, n in sizes:
        starts[p], before = before, before + n
    if not starts:
        return marked.select(*rows.columns, F.lit(0).cast("long").alias("n"))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("__p"))
    return marked.select(*rows.columns, (start + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def promote(rows: DataFrame, root: str) -> str:
    """Writes a new version of a table and then points to it; readers see the old or the new one, never half of it."""
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{version}")
    fs, temp = _fs(spark, f"{root}/current.{version}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    _, target = _fs(spark, f"{root}/current.json")
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(temp, target, options)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table that a root points to."""
    pointer = "".join(r["value"] for r in spark.read.text(f"{root}/current.json").collect())
    return spark.read.parquet(f"{root}/{json.loads(pointer)['version']}")


def snapshot(spark: SparkSession, root: str, to: str) -> int:
    """Copies the current version elsewhere and returns the number of its rows, read back."""
    current(spark, root).write.mode("errorifexists").parquet(to)
    return spark.read.parquet(to).count()


def write_files(rows: DataFrame, folder: str) -> None:
    """One file a row (name, text), written by tasks under a temporary name and renamed."""
    from pyarrow import fs

    def run(batches):
        where, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        where.create_dir(at, recursive=True)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                temp = f"{at}/.{uuid.uuid4().hex}"
                with where.open_output_stream(temp) as out:
                    out.write(text.encode())
                where.move(temp, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["name"])

    rows.select("name", "text").mapInArrow(run, "name string").collect()
