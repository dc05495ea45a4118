"""A molecule store: Parquet files, and commits that make them visible.

``_commits/<generation>.json`` lists the files of a generation with their rows, the schema and its lock, and a checksum
of all that; where there are many files, it lists the latest and names a manifest that has the others. A commit is one rename, so a reader sees a generation or does not. Opening takes the highest generation
whose checksum and files hold, so a damaged newest commit falls back to the one before. Files that no commit names are
invisible until ``vacuum`` removes them. All paths go through Hadoop's file system, so any store that Spark reads will do
whose rename is atomic. One writer at a time, as many readers as there are.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.functions.geometry import flat3
from molframe.operators import lock as locks
from molframe.operators.model import checked
from molframe.operators.ranges import KINDS, RANGE, Ranges

CODECS = ("none", "lz4", "zstd")
#: Files that a commit lists itself; beyond, they go to a manifest, so that a commit's size does not grow with their number.
LISTED = 64
#: How vectors lie in the files: as structs of three numbers, or as flat arrays, which take half the time to read as such.
LAYOUTS = ("vectors", "flat")


@dataclass
class Commit:
    generation: int = 0
    codec: str = "none"
    level: int | None = None
    files: list[dict] = field(default_factory=list)  # path below the root, first id, rows
    schema: str | None = None
    lock: str = "[]"
    streams: dict = field(default_factory=dict)  # last batch taken from each stream
    layout: str = "vectors"
    manifest: str | None = None  # name of a file that lists the first files, how many, and its checksum
    manifest_files: int = 0
    manifest_crc: int = 0

    @property
    def rows(self) -> int:
        return sum(f["rows"] for f in self.files)


def _sealed(commit: Commit) -> str:
    """Text of a commit: without the files that its manifest has."""
    body = json.dumps(asdict(commit) | {"files": commit.files[commit.manifest_files :]}, sort_keys=True)
    return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})


def _unsealed(text: str, files: _Files) -> Commit | None:
    """The commit of a text with all its files; None if a checksum does not hold."""
    try:
        outer = json.loads(text)
        if zlib.crc32(outer["body"].encode()) != outer["crc"]:
            return None
        commit = Commit(**json.loads(outer["body"]))
        if commit.manifest is not None:
            if not files.exists(f"_commits/{commit.manifest}"):
                return None
            listed = files.read(f"_commits/{commit.manifest}")
            if zlib.crc32(listed.encode()) != commit.manifest_crc:
                return None
            commit.files = json.loads(listed) + commit.files
        return commit
    except (ValueError, KeyError, TypeError):
        return None


class _Files:
    """The few file operations of a store, on the file system of its path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self._path(old), self._path(new))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()


class Store:
    """Handle of a store; made by ``create`` or ``open``."""

    def __init__(self, spark: SparkSession, path: str, commit: Commit, writable: bool):
        self.spark, self.path, self.writable = spark, path.rstrip("/"), writable
        self._files, self._commit, self._pending = _Files(spark, path), commit, []
        self._lock, self._schema = locks.from_json(commit.lock), T.StructType.fromJson(json.loads(commit.schema)) if commit.schema else None
        self._fresh = False

    # -- opening ------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, compression: str = "none", level: int = 3, overwrite: bool = False, layout: str = "vectors") -> Store:
        """New empty store. An existing one is an error, or is replaced by the first commit if ``overwrite``.

        ``layout``: ``vectors`` serves readers of vectors, ``flat`` those of ``plain`` arrays and of atoms; either gives the same.
        """
        codec = compression.lower()
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout {layout!r}")
        if codec not in CODECS:
            raise ValueError(f"unknown compression {compression!r}")
        found = latest(spark, path)
        if found is not None and not overwrite:
            raise FileExistsError(path)
        generation = 0 if found is None else found.generation + 1
        store = cls(spark, path, Commit(generation, codec, level if codec == "zstd" else None, layout=layout), True)
        if found is None:
            store._publish(store._commit)
        else:
            store._fresh = True
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, writable: bool = False, persist: bool = False) -> Store:
        """Store at its newest valid commit. Read-only unless asked for; ``persist`` is for read-only handles."""
        if persist and writable:
            raise ValueError("persist needs a read-only handle")
        commit = latest(spark, path)
        if commit is None:
            raise FileNotFoundError(path)
        store = cls(spark, path, commit, writable)
        if persist:
            store.molecules().persist().count()
        return store

    # -- metadata -----------------------------------------------------------------------------------------------

    def __len__(self) -> int:
        """Committed molecules; no data is read."""
        return self._commit.rows

    @property
    def generation(self) -> int:
        return self._commit.generation

    @property
    def compression(self) -> tuple[str, int | None]:
        return self._commit.codec, self._commit.level

    @property
    def lock(self) -> locks.Lock:
        return dict(self._lock)

    @property
    def record_format(self) -> int:
        return locks.record_format(self._lock)

    def size_bytes(self) -> int:
        """Bytes of the committed files."""
        return sum(self._files.size(f["path"]) for f in self._commit.files)

    # -- reading ------------------------------------------------------------------------------------------------

    def molecules(self) -> DataFrame:
        """All committed molecules. Columns and filters reach the Parquet scan; ``mol_id`` is dense from 0."""
        if not self._commit.files:
            schema = self._schema or T.StructType([T.StructField("mol_id", T.LongType())])
            return self.spark.createDataFrame([], schema)
        return as_vectors(self._stored(), self._schema, self._commit.layout)

    def _stored(self) -> DataFrame:
        paths = [f"{self.path}/{f['path']}" for f in self._commit.files]
        return self.spark.read.schema(stored_schema(self._schema, self._commit.layout)).parquet(*paths)

    def plain(self) -> DataFrame:
        """All committed molecules with vectors as flat arrays, x0, y0, z0, x1, ...; what a flat store holds as it is."""
        if not self._commit.files or self._commit.layout == "vectors":
            return as_flat(self.molecules())
        return self._stored()

    def payloads(self, ids: Sequence[int] | None = None, **options):
        """Plain parts of the molecules asked for, in order, or of all; see ``bridge.export_batch``."""
        from molframe.operators.bridge import export_batch

        return export_batch(self.molecules(), ids, **options)

    # -- writing ------------------------------------------------------------------------------------------------

    def append(self, molecules: DataFrame, order: str | None = None, ranges: Ranges | None = None) -> int:
        """Stages molecules; readers see them after ``flush``. Returns how many.

        They are numbered on from the last id, in order of the column ``order`` (not stored) if given, else in the order in which they lie in their
        partitions. Their schema must fit the lock. ``ranges`` are those of ``order``, of molecules that are dealt to them already (``Ranges.deal``).
        """
        for c in ("mol_id", "n_atoms"):
            if c in molecules.columns and c != order:
                molecules = molecules.drop(c)
        lock, first = self._admitted(molecules.drop(order, RANGE) if order else molecules)
        folder, total = self._write_sorted(molecules, order, first, ranges) if order else self._write_in_place(molecules, first)
        if folder is None:  # the counts did not hold for the rows written, or the order has no ranges
            folder, total = self._write_staged(molecules.orderBy(order).drop(order, RANGE) if order else molecules, first)
        self._stage(folder, first, total, lock)
        return total

    def _admitted(self, molecules: DataFrame) -> tuple[locks.Lock, int]:
        """The lock with what ``molecules`` add to it, and their first id; an error if they do not fit."""
        if not self.writable:
            raise ValueError("the store is open for reading only")
        lock = locks.merge(self._lock, locks.derive(molecules.schema, locks.array_lengths(molecules)))
        first = len(self) + sum(f["rows"] for f in self._pending)
        if self._lock and first and self.record_format == 2 and locks.record_format(lock) == 3:
            raise locks.LockError("a store that holds records of format 2 takes no others")
        return lock, first

    def _stage(self, folder: str, first: int, total: int, lock: locks.Lock) -> None:
        if total:
            self._pending.append({"path": folder, "first": first, "rows": total})
        self._lock = lock

    def _write(self, rows: DataFrame, counts: dict[int, int], first: int, folder: str) -> None:
        """Writes rows (with ``_part`` and ``_row``, a place in the part in its low bits) numbered part after part."""
        start, at = {}, first
        for part in sorted(counts):
            start[part], at = at, at + counts[part]
        bases = self.spark.createDataFrame(list(start.items()), "_part int, _base long")  # one row per written file
        numbered = rows.join(F.broadcast(bases), "_part", "left")
        inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
        self._write_numbered(numbered.withColumn("mol_id", F.col("_base") + inside).drop("_part", "_row", "_base"), folder)

    def _write_numbered(self, rows: DataFrame, folder: str) -> None:
        """Writes rows that have their ``mol_id``."""
        rows = checked(rows.withColumn("n_atoms", F.size("atomic_numbers")))
        out = rows.select("mol_id", "n_atoms", *[c for c in rows.columns if c not in ("mol_id", "n_atoms")])
        writer = (as_flat(out) if self._commit.layout == "flat" else out).write.option("compression", "uncompressed" if self._commit.codec == "none" else self._commit.codec)
        if self._commit.level is not None:
            writer = writer.option("parquet.compression.codec.zstd.level", str(self._commit.level))
        writer.parquet(f"{self.path}/{folder}")
        self._schema = _merged(self._schema, out.schema)

    def _write_in_place(self, molecules: DataFrame, first: int) -> tuple[str | None, int | None]:
        """Counts the partitions, then writes them once. (None, None) if the rows written are not those counted.

        That can happen where a plan is laid out anew for each run; it is seen in the ids of the files.
        """
        placed = molecules.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
        counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
        total = sum(counts.values())
        if not total:
            return "", 0
        return self._write_counted(placed, counts, first)

    def _write_counted(self, placed: DataFrame, counts: dict[int, int], first: int) -> tuple[str | None, int | None]:
        """Writes rows that have been counted by ``_part``. (None, None) if those written are others."""
        folder, schema, total = f"data/{uuid.uuid4().hex}", self._schema, sum(counts.values())
        self._write(placed, counts, first, folder)
        written = self.spark.read.parquet(f"{self.path}/{folder}").select("mol_id", F.col("_metadata.file_path").alias("file"))
        ends = written.groupBy("file").agg(F.min("mol_id").alias("a"), F.max("mol_id").alias("b"), F.count("mol_id").alias("n")).collect()
        at = first
        for r in sorted(ends, key=lambda r: (r["a"] is None, r["a"])):
            if r["a"] != at or r["b"] - at + 1 != r["n"]:
                break
            at += r["n"]
        if at == first + total:
            return folder, total
        self._files.remove(folder)
        self._schema = schema
        return None, None

    def _write_sorted(self, molecules: DataFrame, order: str, first: int, ranges: Ranges | None) -> tuple[str | None, int | None]:
        """Counts the ranges of ``order``, then deals the molecules to them, sorts and writes them: they move once, or not if they are dealt.

        (None, None) if the rows written are not those counted, or ``order`` is no plain value.
        """
        if ranges is None:
            if not isinstance(molecules.schema[order].dataType, KINDS):
                return None, None
            ranges = Ranges.counted(molecules, order)
            molecules = ranges.deal(molecules, order)
        if not sum(ranges.counts):
            return "", 0
        placed = molecules.sortWithinPartitions(order).withColumn("_row", F.monotonically_increasing_id()).withColumnRenamed(RANGE, "_part")
        return self._write_counted(placed.drop(order), dict(enumerate(ranges.counts)), first)

    def _write_staged(self, molecules: DataFrame, first: int) -> tuple[str, int]:
        """Writes rows as they come, then numbers what lies on disk."""
        staging, folder = f"_staging/{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        placed = molecules.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
        placed.write.parquet(f"{self.path}/{staging}")
        staged = self.spark.read.parquet(f"{self.path}/{staging}")
        counts = {r["_part"]: r["count"] for r in staged.groupBy("_part").count().collect()}
        if counts:
            self._write(staged, counts, first, folder)
        self._files.remove(staging)
        return folder, sum(counts.values())

    def append_table(self, other: Store) -> int:
        """Appends all committed molecules of another store, in order. Their ids are moved on, so they are neither sorted nor staged."""
        molecules, total, folder = other.molecules(), len(other), f"data/{uuid.uuid4().hex}"
        lock, first = self._admitted(molecules.drop("mol_id", "n_atoms"))
        if total:
            self._write_numbered(molecules.withColumn("mol_id", F.col("mol_id") + first), folder)
        self._stage(folder, first, total, lock)
        return total

    def streamed(self, stream: str) -> int:
        """Number of the last batch that was committed from a stream; -1 for none."""
        return self._commit.streams.get(stream, -1)

    def flush(self, stream: tuple[str, int] | None = None) -> int:
        """Commits what is staged: one rename. Returns the generation. Nothing staged, nothing changes."""
        if not self.writable:
            raise ValueError("the store is open for reading only")
        if not self._pending and not self._fresh and stream is None:
            return self.generation
        known = [] if self._fresh else self._commit.files
        generation = self.generation if self._fresh else self.generation + 1
        schema = json.dumps(self._schema.jsonValue()) if self._schema else None
        commit = Commit(generation, self._commit.codec, self._commit.level, known + self._pending, schema, locks.to_json(self._lock))
        commit.layout = self._commit.layout
        if not self._fresh:
            commit.manifest, commit.manifest_files, commit.manifest_crc = self._commit.manifest, self._commit.manifest_files, self._commit.manifest_crc
        if len(commit.files) - commit.manifest_files > LISTED:
            listed = json.dumps(commit.files)
            commit.manifest, commit.manifest_files, commit.manifest_crc = f"manifest-{generation:012d}.json", len(commit.files), zlib.crc32(listed.encode())
            self._files.write(f"_commits/{commit.manifest}", listed)  # nothing reads it before the commit is there
        commit.streams = self._commit.streams | ({stream[0]: stream[1]} if stream else {})
        self._publish(commit)
        self._commit, self._pending, self._fresh = commit, [], False
        return generation

    def _publish(self, commit: Commit) -> None:
        name = f"_commits/{commit.generation:012d}.json"
        self._files.write(name + ".tmp", _sealed(commit))
        if self._files.exists(name) or not self._files.rename(name + ".tmp", name):
            raise RuntimeError(f"generation {commit.generation} was committed by someone else")

    def vacuum(self) -> list[str]:
        """Removes staged and orphaned files and manifests that no commit names, and temporary commits. Returns their names."""
        if not self.writable or self._pending:
            raise ValueError("vacuum needs a writable handle with nothing staged")
        known = commits(self.spark, self.path)
        named, manifests = {f["path"] for c in known for f in c.files}, {c.manifest for c in known}
        gone = [f"data/{n}" for n in self._files.names("data") if f"data/{n}" not in named]
        gone += [f"_commits/{n}" for n in self._files.names("_commits") if n.endswith(".tmp")]
        gone += [f"_commits/{n}" for n in self._files.names("_commits") if n.startswith("manifest-") and n not in manifests]
        gone += [f"_staging/{n}" for n in self._files.names("_staging")]
        for name in gone:
            self._files.remove(name)
        return gone


def _vector_number(kind: T.DataType) -> T.DataType | None:
    """Type of the numbers of an array of (x, y, z) structs; None for other types."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and kind.elementType.names == ["x", "y", "z"]:
        return kind.elementType.fields[0].dataType
    return None


def stored_schema(schema: T.StructType, layout: str) -> T.StructType:
    """Schema of the files of molecules of ``schema``."""
    number = lambda f: _vector_number(f.dataType) if layout == "flat" else None
    return T.StructType([T.StructField(f.name, T.ArrayType(number(f)) if number(f) else f.dataType, True) for f in schema.fields])


def as_flat(molecules: DataFrame) -> DataFrame:
    """Vectors as flat arrays."""
    return molecules.withColumns({f.name: flat3(F.col(f.name)) for f in molecules.schema.fields if _vector_number(f.dataType)})


def as_vectors(stored: DataFrame, schema: T.StructType, layout: str) -> DataFrame:
    """Rows of files as molecules of ``schema``."""
    if layout == "vectors":
        return stored

    def vectors(flat: Column, kind: T.DataType) -> Column:
        places = F.sequence(F.lit(0), (F.size(flat) / 3).cast("int") - 1)
        made = F.transform(places, lambda i: F.struct(*[F.get(flat, i * 3 + k).alias(n) for k, n in enumerate("xyz")]))
        return F.when(F.size(flat) == 0, F.array().cast(kind)).when(flat.isNotNull(), made).cast(kind)

    return stored.withColumns({f.name: vectors(F.col(f.name), f.dataType) for f in schema.fields if _vector_number(f.dataType)})


def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
    fields = {f.name: f for f in (old.fields if old else [])}
    for f in new.fields:
        fields.setdefault(f.name, f)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])


def _names(files: _Files) -> list[str]:
    """Names of the commits, newest first."""
    return sorted((n for n in files.names("_commits") if re.fullmatch(r"\d{12}\.json", n)), reverse=True)


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """Commits whose checksum holds, oldest first."""
    files = _Files(spark, path)
    found = (_unsealed(files.read(f"_commits/{n}"), files) for n in reversed(_names(files)))
    return [c for c in found if c is not None]


def latest(spark: SparkSession, path: str) -> Commit | None:
    """Newest commit whose checksum holds and whose files are all there; older ones are not read unless it fails."""
    files = _Files(spark, path)
    there: set[str] | None = None
    for name in _names(files):
        commit = _unsealed(files.read(f"_commits/{name}"), files)
        if commit is None:
            continue
        if there is None:  # one listing instead of a question per file
            there = {f"data/{n}" for n in files.names("data")}
        if all(f["path"] in there for f in commit.files):
            return commit
    return None
