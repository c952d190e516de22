"""Changes to a Parquet table's files in place: erasure of subjects (B20), retention.

Both work file by file on a table of ``root[/col=value...]/*.parquet`` and leave every other file as
it is, name and bytes.  Lists of files and folders go through the driver (metadata only); rows
never do.  Both may be stopped at any point and run again.
"""

from __future__ import annotations

import calendar
import datetime as dt
import json
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGING = "_erasure"  # readers skip folders that begin with an underscore


class _Files:
    """The Hadoop file system of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def list(self, p: str) -> list[tuple[str, int, bool]]:
        """(name, length, is a folder) below ``p``, hidden ones left out."""
        if not self.exists(p):
            return []
        out = [(s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self.fs.listStatus(self.path(p))]
        return sorted(x for x in out if not x[0].startswith(("_", ".")))

    def tree(self, p: str, prefix: str = "") -> list[str]:
        """Data files below ``p``, relative to it."""
        out = []
        for name, _, folder in self.list(f"{p}/{prefix}".rstrip("/")):
            out += self.tree(p, f"{prefix}{name}/") if folder else [prefix + name]
        return out

    def length(self, p: str) -> int:
        return self.fs.getFileStatus(self.path(p)).getLen() if self.exists(p) else -1

    def move(self, a: str, b: str) -> None:
        """Move a file; done already when only ``b`` is left, an unfinished copy is replaced."""
        if not self.exists(a):
            return
        if self.exists(b):
            if self.length(a) == self.length(b):
                self.delete(a)
                return
            self.delete(b)
        self.fs.mkdirs(self.path(b).getParent())
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"cannot move {a} to {b}")

    def delete(self, p: str, folder: bool = False) -> None:
        self.fs.delete(self.path(p), folder)

    def write(self, p: str, text: str) -> None:
        out = self.fs.create(self.path(p), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return text


def _relative(root: str, uri: str) -> str:
    """A file's place below ``root`` (``_metadata.file_path`` is an encoded URI)."""
    path, base = unquote(urlparse(uri).path), unquote(urlparse(root).path).rstrip("/")
    return path[path.index(base) + len(base) + 1:]


def _finish(files: _Files, root: str) -> None:
    """Carry out every erasure whose plan is complete, drop those that were stopped before."""
    base = f"{root}/{STAGING}"
    if not files.exists(base):
        return
    for st in files.fs.listStatus(files.path(base)):
        work = f"{base}/{st.getPath().getName()}"
        if files.exists(f"{work}/plan.json"):
            plan = json.loads(files.read(f"{work}/plan.json"))
            for f in plan["old"]:
                files.delete(f"{root}/{f}")
            for f in plan["new"]:
                files.move(f"{work}/rows/{f}", f"{root}/{f}")
        files.delete(work, True)


def erase_in_files(spark: SparkSession, root: str, col: str, subjects: DataFrame, subject_col: str,
                   by: tuple[str, ...] = ()) -> DataFrame:
    """Remove the rows of ``subjects`` from the Parquet table at ``root``, rewriting only files
    that hold such a row.  Returns ``(archivo, filas_borradas)`` of the files rewritten, empty when
    none holds a subject.

    A semi join of the subject column alone finds the files and their counts; only they are read
    whole.  What stays of them is written into a hidden folder, then a plan of old and new files,
    and only then are old ones deleted and new ones moved in; a run that was stopped is finished
    (or, without its plan, dropped) by the next one.  Rows with a NULL subject stay."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    _finish(files, root)
    schema = "archivo string, filas_borradas long"
    if not files.tree(root):
        return spark.createDataFrame([], schema)
    ids = subjects.select(F.col(subject_col).alias("_sid")).where("_sid IS NOT NULL").distinct()
    rows = spark.read.parquet(root).select(F.col(col).alias("_sid"), F.col("_metadata.file_path").alias("_f"))
    hit = rows.join(ids, "_sid", "left_semi").groupBy("_f").agg(F.count(F.lit(1)).alias("n")).collect()
    touched = sorted((_relative(root, r._f), r.n) for r in hit)
    if not touched:
        return spark.createDataFrame([], schema)
    work = f"{root}/{STAGING}/{uuid.uuid4().hex}"
    old = spark.read.option("basePath", root).parquet(*[f"{root}/{f}" for f, _ in touched])
    keep = old.join(ids, old[col] == ids["_sid"], "left_anti")
    writer = (keep.hint("rebalance", *by) if by else keep).write
    (writer.partitionBy(*by) if by else writer).parquet(f"{work}/rows")
    new = files.tree(f"{work}/rows")
    files.write(f"{work}/plan.json", json.dumps({"old": [f for f, _ in touched], "new": new}))
    _finish(files, root)
    return spark.createDataFrame(touched, schema)


def retire_partitions(spark: SparkSession, root: str, tiers: list[tuple[int, str]], as_of: dt.date, archive: str,
                      drop_label: str = "borrar") -> list[tuple[str, str, int]]:
    """A18 on a table partitioned by (anio, mes), from folder names alone: a month is labelled by the age
    of its last day (so none goes before its youngest row is due), with the largest tier it exceeds.
    ``drop_label`` months are deleted here and in the archive, other labelled ones move to ``archive``
    under the same names.  Months without a number (NULL dates) stay.  Returns (folder, label,
    files) of what was done; a run that was stopped half way through a month is resumed."""
    root, archive = root.rstrip("/"), archive.rstrip("/")
    files = _Files(spark, root)
    done = []
    for place in (root, archive):
        for year, _, _ in files.list(place):
            for month, _, folder in files.list(f"{place}/{year}"):
                parts = (year.removeprefix("anio="), month.removeprefix("mes="))
                if not folder or not all(p.isdigit() for p in parts):
                    continue
                y, m = map(int, parts)
                age = (as_of - dt.date(y, m, calendar.monthrange(y, m)[1])).days
                label = next((lb for days, lb in sorted(tiers, reverse=True) if age > days), None)
                part = f"{year}/{month}"
                names = [n for n, _, _ in files.list(f"{place}/{part}")]
                if label is None or (label != drop_label and place == archive):
                    continue
                for n in names:
                    if label != drop_label:
                        files.move(f"{place}/{part}/{n}", f"{archive}/{part}/{n}")
                files.delete(f"{place}/{part}", True)
                done.append((part, label, len(names)))
    return done
