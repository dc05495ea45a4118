"""Folders of stores as one dataset, their rewriting shard by shard, and copies of them to and from other places."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.operators import lock as locks
from molframe.operators.read import MOST_IDS

from .store import LAYOUTS, Store, _Files, as_vectors, latest, stored_schema

#: Shards that are rewritten, or files that are copied, at a time.
AT_ONCE = 8


def relative_path(path: str, name: str = "path") -> str:
    """A path inside a repository, by the rule of ``geometry.normal_path``; one that goes up or names nothing is an error."""
    kept = [p for p in path.strip().split("/") if p not in ("", ".")]
    if kept and ".." not in kept:
        return "/".join(kept)
    raise ValueError(f"{name} must name something inside the repository: {path!r}")


def find_stores(spark: SparkSession, path: str) -> list[str]:
    """Paths of all stores at or below ``path``, in order of their names."""
    files = _Files(spark, path)
    if not files.exists():
        raise FileNotFoundError(path)
    found, open_ = [], [files._path("")]
    while open_:
        here = open_.pop()
        children = [s.getPath() for s in files.fs.listStatus(here) if s.isDirectory()]
        if any(c.getName() == "_commits" for c in children):
            found.append(here.toUri().getPath() if "://" not in path else here.toString())
        else:
            open_ += children
    return sorted(found)


def listed_stores(spark: SparkSession, manifest: str) -> DataFrame:
    """(place, path) of a JSON manifest's ``output_files``, in its order."""
    read = spark.read.option("multiLine", True).json(manifest)
    return read.select(F.posexplode("output_files").alias("place", "path"))


class ShardReader:
    """Read-only view of ordered shards with one index; negative ids count from the end. Closed, it answers nothing.

    Where a molecule lies is known from the commits, which hold the shards' lengths: no data is read to find it.
    """

    def __init__(self, spark: SparkSession, paths: Sequence[str]):
        self.spark, self.paths = spark, list(paths)
        self.stores = [Store.open(spark, p) for p in self.paths]
        self.lock: locks.Lock = {}
        fields: dict[str, T.StructField] = {}
        for s in self.stores:
            self.lock = locks.merge(self.lock, s.lock)
            for f in s.molecules().schema.fields:  # the lock has ruled out differing types
                fields.setdefault(f.name, f)
        self._schema = T.StructType(list(fields.values()))
        self._first = [0, *accumulate(map(len, self.stores))]
        self._open = True

    @classmethod
    def open_path(cls, spark: SparkSession, path: str) -> ShardReader:
        """Reader of one store or of all below a folder."""
        paths = find_stores(spark, path)
        if not paths:
            raise FileNotFoundError(f"no stores under {path}")
        return cls(spark, paths)

    def _check(self) -> None:
        if not self._open:
            raise ValueError("the reader is closed")

    def __len__(self) -> int:
        self._check()
        return self._first[-1]

    def _locate(self, index: int) -> tuple[int, int]:
        """(shard, place in it) of an id."""
        at = index + self._first[-1] if index < 0 else index
        if not 0 <= at < self._first[-1]:
            raise IndexError(index)
        shard = bisect_right(self._first, at) - 1
        return shard, at - self._first[shard]

    def _rows(self, shards: Sequence[int]) -> DataFrame:
        """Molecules of some shards, one scan per layout, with ``shard`` and ``first``; ``mol_id`` is still the place in the shard."""
        files = [(k, f["path"]) for k in shards for f in self.stores[k]._commit.files]
        # a row per folder that the commits list
        of = [(path.rsplit("/", 1)[-1], k, self._first[k]) for k, path in files]
        folders = self.spark.createDataFrame(of, "_folder string, shard int, first long")
        out = None
        for layout in LAYOUTS:
            paths = [f"{self.stores[k].path}/{path}" for k, path in files if self.stores[k]._commit.layout == layout]
            if paths:
                stored = self.spark.read.schema(stored_schema(self._schema, layout)).parquet(*paths)
                placed = stored.withColumn("_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
                rows = as_vectors(placed.join(F.broadcast(folders), "_folder").drop("_folder"), self._schema, layout)
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], T.StructType([*self._schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType())]))
        return out

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"local_idx": F.col("mol_id"), "mol_id": F.col("mol_id") + F.col("first")}).drop("first")

    def molecules(self) -> DataFrame:
        """All molecules with ``shard``, ``local_idx`` (place in the shard) and ``mol_id`` (place in all)."""
        self._check()
        return self._placed(self._rows(range(len(self.stores))))

    def get(self, index: int) -> DataFrame:
        """One molecule: one shard is read, and the place in it reaches the scan."""
        self._check()
        shard, local = self._locate(index)
        return self._placed(self._rows([shard]).where(F.col("mol_id") == F.lit(local).cast("long")))

    def get_many(self, ids: Sequence[int]) -> DataFrame:
        """Rows of the request with ``pos``; unknown ids are an error before any data is read.

        Only shards that hold some are read, and up to 10,000 different places reach the scan.
        """
        self._check()
        if len(ids) > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} ids")
        found = [self._locate(i) for i in ids]
        asked = self.spark.createDataFrame([(p, k, i) for p, (k, i) in enumerate(found)], "pos int, shard int, mol_id long")
        rows, locals_ = self._rows(sorted({k for k, _ in found})), {i for _, i in found}
        if len(locals_) <= 10_000:
            rows = rows.where(F.col("mol_id").isin(sorted(locals_)))
        return self._placed(rows.join(F.broadcast(asked), ["shard", "mol_id"]))

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> ShardReader:
        self._check()
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def rewrite(
    spark: SparkSession, source: str, target: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    compression: str = "zstd", level: int = 3, overwrite: bool = False,
) -> str:
    """Writes every shard below ``source`` again below ``target``, under the same relative name and in the same order.

    AT_ONCE shards are written at a time. Each shard's count is compared with its source's. Returns the path of a manifest
    that lists the shards in order. Shards that are there already stay unless ``overwrite``, so an interrupted run can go on.
    """
    base = _Files(spark, source)._path("").toUri().getPath().rstrip("/")

    def one(path: str) -> str:
        below = path.split("://", 1)[-1]
        to = f"{target.rstrip('/')}/{below[below.index(base) + len(base) :].strip('/') or 'shard'}"
        old, done = Store.open(spark, path), latest(spark, to)
        if done is None or done.rows != len(old) or overwrite:
            new = Store.create(spark, to, compression, level, overwrite=done is not None)
            new.append(transform(old.molecules()), order="mol_id")
            new.flush()
            if len(new) != len(old):
                raise RuntimeError(f"{to} has {len(new)} molecules instead of {len(old)}")
        return to

    with ThreadPoolExecutor(AT_ONCE) as pool:
        out = list(pool.map(one, find_stores(spark, source)))
    _Files(spark, target).write("manifest.json", json.dumps({"output_files": out}))
    return f"{target.rstrip('/')}/manifest.json"


def transfer(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the stores at or below ``source`` to the same names below ``target``, on any two file systems that Spark reaches.

    Data goes before commits, so a store is seen at the target when all of it is there. Returns the paths of the copies.
    """
    old, new = _Files(spark, source), _Files(spark, target)
    base = old._path("").toUri().getPath().rstrip("/")
    conf, util = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    out = []
    for path in find_stores(spark, source):
        below = path.split("://", 1)[-1]
        name = below[below.index(base) + len(base) :].strip("/")
        prefix = f"{name}/" if name else ""
        commit = latest(spark, path)
        wanted = [f["path"] for f in commit.files] if commit else []

        def copy(part: str, prefix: str = prefix) -> None:
            to = new._path(prefix + part)
            new.fs.mkdirs(to.getParent())
            if not util.copy(old.fs, old._path(prefix + part), new.fs, to, False, True, conf):
                raise OSError(f"{part} was not copied")

        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(copy, [w for w in wanted if not new.exists(prefix + w)]))
        if commit:
            for part in (commit.manifest, f"{commit.generation:012d}.json"):
                if part is not None:
                    copy(f"_commits/{part}")
        out.append(f"{target.rstrip('/')}/{name}".rstrip("/"))
    return out


def download(spark: SparkSession, repository: str, target: str, path: str | None = None) -> str:
    """Copies a repository, or what ``path`` names in it, and returns where the dataset is in the copy."""
    at = "" if path is None else "/" + relative_path(path)
    transfer(spark, repository.rstrip("/") + at, target.rstrip("/") + at)
    return dataset_root(spark, target, path)


def upload(spark: SparkSession, source: str, repository: str, path: str | None = None) -> list[str]:
    """Copies a store, or a folder of them, into a repository under ``upload_name``."""
    return transfer(spark, source, f"{repository.rstrip('/')}/{upload_name(source, path)}")


def open_repository(spark: SparkSession, repository: str, path: str | None = None) -> ShardReader:
    """Reader of a repository's dataset where it lies."""
    return ShardReader.open_path(spark, dataset_root(spark, repository, path))


def snapshot_patterns(path: str | None = None) -> list[str]:
    """Name patterns of what a partial copy of a repository needs: the stores below ``path`` and the manifests."""
    under = "" if path is None else relative_path(path) + "/"
    return [under + deep + kind for kind in ("_commits/*.json", "data/**") for deep in ("*/", "**/")] + [f"{under}{m}manifest.json" for m in ("", "**/")]


def dataset_root(spark: SparkSession, snapshot: str, path: str | None = None) -> str:
    """The dataset of a copied repository: what ``path`` names, else the only place that its stores have in common.

    That place is the one store, or the one folder of all stores. No store, or several folders, is an error.
    """
    root = "/".join([snapshot.rstrip("/"), *([relative_path(path)] if path is not None else [])])
    stores = find_stores(spark, root)
    places = {root} if path is not None and stores else set(stores) if len(stores) < 2 else {s.rpartition("/")[0] for s in stores}
    if not places:
        raise FileNotFoundError(f"no stores under {root}")
    place, *others = places
    if others:
        raise ValueError("stores in several folders: name one")
    return place


def upload_name(source: str, path: str | None = None, suffix: str = ".store") -> str:
    """Name of a source in a repository: ``path`` if that is the name of a store, else the source's own name, below ``path`` if given."""
    parts = [relative_path(path)] if path is not None else []
    if not (parts and parts[0].endswith(suffix)):
        parts.append(source.rstrip("/").rpartition("/")[2])
    return "/".join(parts)
