"""Datasets on disk: scans with projection and JSON-contract columns, checked and atomic sinks, artifacts and digests (SC1-SC17)."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.parsing import coalesce_duplicate_headers
from retort.schemas import align, struct

#: Columns kept as JSON text, with the type they decode to.
JSON_COLUMNS = {"family_distribution": "map<string,bigint>", "quality_components": "map<string,double>", "diagnostics": "array<string>", "provenance": "map<string,string>"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def decode_json(frame: DataFrame, columns: dict[str, str] = JSON_COLUMNS) -> DataFrame:
    """JSON texts as typed columns; null and unreadable text become an empty map or list (SC2)."""

    def one(name: str, kind: str):
        if dict(frame.dtypes).get(name) == "string":
            return F.coalesce(F.from_json(name, kind), F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind))
        empty = F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)
        return F.coalesce(F.col(name).cast(kind), empty)

    return frame.withColumns({n: one(n, k) for n, k in columns.items() if n in frame.columns})


def encode_json(frame: DataFrame, columns: dict[str, str] = JSON_COLUMNS) -> DataFrame:
    return frame.withColumns({n: F.coalesce(F.to_json(n, {"ignoreNullFields": "false"}), F.lit("{}" if k.startswith("map") else "[]")) for n, k in columns.items() if n in frame.columns and dict(frame.dtypes)[n] != "string"})


def read_dataset(spark: SparkSession, root: str, name: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A dataset by name: Parquet if there is any, else gzip CSV with a header; raises if neither (SC1).

    ``columns`` reach the scan; ``schema`` aligns the result. CSV needs a schema for types other than text.
    """
    folder = f"{root}/{name}"
    if not _exists(spark, folder):
        raise FileNotFoundError(folder)
    kinds = [r[0].rsplit(".", 2) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").limit(1000).collect()]
    if any(k[-1] == "parquet" for k in kinds):
        frame = spark.read.parquet(folder)
    elif kinds:
        frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    else:
        raise FileNotFoundError(f"{folder} has no parts")
    frame = decode_json(frame)
    frame = align(frame, schema) if schema else frame
    return frame.select(*columns) if columns else frame


def write_dataset(frame: DataFrame, root: str, name: str, rows_per_file: int = 1_000_000, partition_by: list[str] | None = None) -> int:
    """Writes Parquet with zstd, reads it back and checks the number of rows, which is returned (SC8-SC10).

    Spark's committer makes the folder's files appear at once; a failed check raises before anything refers to them.
    """
    spark, folder = frame.sparkSession, f"{root}/{name}"
    writer = encode_json(frame).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    stored, expected = spark.read.parquet(folder).count(), frame.count()
    if stored != expected:
        raise OSError(f"{folder} has {stored} rows of {expected}")
    return stored


def dataset_rows(spark: SparkSession, root: str, name: str) -> int:
    return read_dataset(spark, root, name).count()


def publish(spark: SparkSession, staged: str, live: str, names: list[str]) -> None:
    """Moves staged tables over live ones; if a move fails, those already moved go back (SC12)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(live).getFileSystem(conf)
    if missing := [n for n in names if not fs.exists(path(f"{staged}/{n}"))]:
        raise FileNotFoundError(f"{missing} aren't in {staged}")
    fs.mkdirs(path(live))
    done: list[str] = []
    try:
        for name in names:
            if fs.exists(path(f"{live}/{name}")) and not fs.rename(path(f"{live}/{name}"), path(f"{live}/.{name}.old")):
                raise OSError(f"can't set {name} aside")
            done.append(name)
            if not fs.rename(path(f"{staged}/{name}"), path(f"{live}/{name}")):
                raise OSError(f"can't move {name}")
    except Exception:
        for name in reversed(done):
            if fs.exists(path(f"{live}/{name}")):  # back to where it came from
                fs.rename(path(f"{live}/{name}"), path(f"{staged}/{name}"))
            if fs.exists(path(f"{live}/.{name}.old")):
                fs.rename(path(f"{live}/.{name}.old"), path(f"{live}/{name}"))
        raise
    for name in names:
        fs.delete(path(f"{live}/.{name}.old"), True)


def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder (SC6, PR11)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted (relative path, digest) pairs of a folder of releases, whose files are few."""
    rows = content_digests(spark, folder).select("path", "sha256").collect()
    root = PurePosixPath(folder.split(":", 1)[-1]).name
    pairs = sorted((r["path"].split(f"/{root}/", 1)[-1], r["sha256"]) for r in rows)
    return hashlib.sha256(json.dumps(pairs).encode()).hexdigest()


class Artifact:
    """A release folder or a ZIP of one, read through Spark so that it may lie in any store (SC5)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._archive = None
        if path.endswith(".zip"):
            (row,) = spark.read.format("binaryFile").load(path).select("content").collect()
            self._archive = zipfile.ZipFile(io.BytesIO(bytes(row["content"])))

    def inventory(self) -> list[tuple[str, int]]:
        """(member, bytes) sorted."""
        if self._archive:
            return sorted((i.filename, i.file_size) for i in self._archive.infolist() if not i.is_dir())
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path).select("path", "length").collect()
        return sorted((r["path"].split(self.path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1], r["length"]) for r in files)

    def _member(self, name: str) -> str:
        names = [n for n, _ in self.inventory()]
        found = [n for n in names if n == name] or [n for n in names if n.split("/", 1)[-1] == name]
        if not found:
            raise FileNotFoundError(name)
        return found[0]

    def read_json(self, name: str):
        member = self._member(name)
        if self._archive:
            return json.loads(self._archive.read(member))
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{member}", wholetext=True).collect()))

    def read_csv(self, name: str, schema: str) -> DataFrame:
        """A member as a frame. Repeated headers get .1, .2, ... as suffixes. A member of a ZIP passes through the driver."""
        member = self._member(name)
        if self._archive:
            with self._archive.open(member) as raw:
                rows = list(csv.reader(io.TextIOWrapper(raw, "utf-8")))
            names = unique_headers(rows[0])
            frame = self.spark.createDataFrame([tuple(v if v != "" else None for v in r) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names))
        else:
            path = f"{self.path}/{member}"
            head = self.spark.read.text(path).first()[0]
            names = unique_headers(next(csv.reader([head])))
            frame = self.spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(struct(", ".join(f"`{n}` string" for n in names))).option("enforceSchema", True).csv(path)
        return align(coalesce_duplicate_headers(frame), schema)


def portable_path(path: str, root: str) -> str:
    """A path below a root with forward slashes, else its last part (PR12)."""
    path, root = path.replace("\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    return path[len(root) :] if path.startswith(root) else PurePosixPath(path).name


def unique_headers(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        out.append(f"{n}.{k}" if k else n)
        seen[n] = k + 1
    return out


def bundle(spark: SparkSession, source: str, target: str, tables: list[str], card: dict) -> dict:
    """A publication folder: the tables copied, a dataset card and a manifest with digests (SC13, SC15)."""
    counts = {}
    for name in tables:
        frame = spark.read.parquet(f"{source}/{name}")
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{name}")
        counts[name] = frame.count()
    manifest = card | {"tables": counts, "digest": tree_digest(spark, target)}
    lines = ["# Dataset card", "", *[f"- {k}: {v}" for k, v in sorted(manifest.items())]]
    for name, text in (("manifest", json.dumps(manifest, sort_keys=True)), ("card", "\n".join(lines)), ("attributes", "*.parquet filter=lfs diff=lfs merge=lfs -text")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/_{name}")
    return manifest
