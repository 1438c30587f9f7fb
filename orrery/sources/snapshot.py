"""Versioned Parquet tables: snapshots, incremental saves and integrity checks.

A root holds data folders and ``manifest-<version>.json`` files. Data is
written first and the manifest last, under a name that must not exist yet, so a
crash leaves the previous version readable and two writers can't both win. A
version is a base folder plus deltas: added rows and tombstoned keys. Saving a
delta costs what the delta has; the rest of the table isn't read.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import warnings
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.errors import DuplicateIdError, IntegrityError
from orrery.operators.encode import pack, reencode, unpack
from orrery.operators.mutate import addable, remove
from orrery.plans.quantizer import Model
from orrery.runtime import size_of

#: Deltas after which the next save writes a new base.
MAX_DELTAS = 16


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    base: str
    deltas: tuple[dict, ...]
    model: dict | None
    rows: int  # of the base; a delta has its own numbers
    extra: dict

    def body(self) -> str:
        return json.dumps({"format": 1, "version": self.version, "key": self.key, "base": self.base, "deltas": list(self.deltas), "model": self.model, "rows": self.rows, "extra": self.extra})


class Storage:
    """A few file operations over Hadoop's file system, so any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        p = self.path(self.root)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        return self.spark.sparkContext.wholeTextFiles(f"{self.root}/{name}", 1).values().first()

    def create(self, name: str, body: str) -> None:
        """Write under a name of its own, then rename; fails if the name is taken."""
        temp = self.path(f"{self.root}/_{uuid.uuid4().hex}")
        final = self.path(f"{self.root}/{name}")
        out = self.fs.create(temp, False)
        out.write(bytearray(body.encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(temp, final):
            self.fs.delete(temp, False)
            raise IntegrityError(f"{name} was written by someone else")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(m[1]) for n in Storage(spark, root).names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The newest readable manifest (with a warning if there are newer ones), or that of a version."""
    store = Storage(spark, root)
    for v in [version] if version is not None else versions(spark, root)[::-1]:
        try:
            d = json.loads(store.read(f"manifest-{v:08d}.json"))
            if d["format"] != 1:
                raise IntegrityError(f"format {d['format']} isn't known")
            return Manifest(d["version"], d["key"], d["base"], tuple(d["deltas"]), d["model"], d["rows"], d["extra"])
        except (ValueError, KeyError):  # cut off by a crash: the one before holds
            if version is not None:
                raise IntegrityError(f"version {v} can't be read") from None
            warnings.warn(f"version {v} of {root} was cut off; the one before holds", stacklevel=2)
    raise IntegrityError(f"no version in {root}")


def _model(model: Model | None) -> dict | None:
    return None if model is None else {"dim": model.dim, "bits": model.bits, "shift": list(model.shift), "scale": list(model.scale), "seed": model.seed}


def save(table: DataFrame, root: str, key: str = "id", model: Model | None = None, expected: int | None = None, extra: dict | None = None) -> int:
    """A whole snapshot. ``expected``: the version it replaces (0: none); another one there is an error."""
    spark = table.sparkSession
    now = _expected(spark, root, expected)
    name = f"base-{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/{name}")
    rows = spark.read.parquet(f"{root}/{name}").count()
    Storage(spark, root).create(f"manifest-{now + 1:08d}.json", Manifest(now + 1, key, name, (), _model(model), rows, extra or {}).body())
    return now + 1


def _expected(spark: SparkSession, root: str, expected: int | None) -> int:
    """The highest number that is taken, also by a manifest that was cut off: the next one comes after it."""
    taken = (versions(spark, root) or [0])[-1]
    now = manifest(spark, root).version if expected and taken else taken
    if expected is not None and expected != now:
        raise IntegrityError(f"version {now} is there, not {expected}")
    return taken


def sync(root: str, added: DataFrame | None = None, removed: DataFrame | None = None, expected: int | None = None, spark: SparkSession | None = None, check: bool = False) -> int:
    """Append a delta: tombstones first, then rows. Beyond ``MAX_DELTAS`` everything is written anew.

    ``check``: an added key that repeats, or that the table keeps, is an error
    (this reads the table's keys).
    """
    spark = spark or (added if added is not None else removed).sparkSession
    m = manifest(spark, root)
    if expected is not None and expected != m.version:
        raise IntegrityError(f"version {m.version} is there, not {expected}")
    if check and added is not None:
        kept = load(spark, root, m.version)
        kept = kept if removed is None else remove(kept, removed, m.key)
        if not addable(kept, added.select(m.key), m.key):
            raise DuplicateIdError("an added key repeats or is there already")
    delta: dict = {}
    for kind, frame in (("removed", removed), ("added", added)):
        if frame is not None:
            delta[kind] = f"{kind}-{uuid.uuid4().hex}"
            frame.write.parquet(f"{root}/{delta[kind]}")
            delta[f"{kind}_rows"] = spark.read.parquet(f"{root}/{delta[kind]}").count()
    number = versions(spark, root)[-1] + 1
    new = Manifest(number, m.key, m.base, (*m.deltas, delta), m.model, m.rows, m.extra)
    if len(new.deltas) > MAX_DELTAS:
        return save(_assemble(spark, root, new), root, m.key, load_model(spark, root, m.version), None, m.extra)
    Storage(spark, root).create(f"manifest-{number:08d}.json", new.body())
    return number


def _assemble(spark: SparkSession, root: str, m: Manifest, check: bool = False) -> DataFrame:
    def part(name: str, rows: int) -> DataFrame:
        out = spark.read.parquet(f"{root}/{name}")
        if check and out.count() != rows:
            raise IntegrityError(f"the manifest says {rows} rows in {name}")
        return out

    table = part(m.base, m.rows)
    for d in m.deltas:
        if "removed" in d:
            table = remove(table, part(d["removed"], d["removed_rows"]), m.key)
        if "added" in d:
            table = table.unionByName(part(d["added"], d["added_rows"]))
    return table


def load(spark: SparkSession, root: str, version: int | None = None, check: bool = False) -> DataFrame:
    """The table of a version (default: the newest readable one).

    ``check`` verifies the number of rows of every part, that no key repeats,
    and, of a table of codes, that the model can have made them.
    """
    m = manifest(spark, root, version)
    table = _assemble(spark, root, m, check)
    if check:
        if table.groupBy(m.key).count().where("count > 1").limit(1).count():
            raise IntegrityError("a key repeats")
        model = load_model(spark, root, m.version)
        if model is not None and {"code", "scale"} <= set(table.columns):
            check_codes(table, model, bool(m.extra.get("packed")))
    return table


def recalibrate(spark: SparkSession, root: str, new: Model) -> int:
    """A stored table of codes under another calibration, as one new version: readers see all of it or nothing."""
    m = manifest(spark, root)
    old = load_model(spark, root, m.version)
    if old is None:
        raise IntegrityError("the table has no model")
    table, packed = _assemble(spark, root, m), bool(m.extra.get("packed"))
    codes = reencode(unpack(table, old) if packed else table, old, new)
    return save(pack(codes, new) if packed else codes, root, m.key, new, m.version, m.extra)


def to_bytes(table: DataFrame, model: Model | None = None, most: int = 256 << 20, extra: dict | None = None) -> bytes:
    """A small table and its model as one byte string; tables estimated beyond ``most`` bytes belong in ``save``."""
    if not 0 < size_of(table) <= most:
        raise IntegrityError(f"the table is larger than {most} bytes or of unknown size; save it instead")
    rows = table.toArrow()
    rows = rows.replace_schema_metadata({"orrery": json.dumps({"format": 1, "model": _model(model), "extra": extra or {}})})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return out.getvalue()


def from_bytes(spark: SparkSession, data: bytes) -> tuple[DataFrame, Model | None]:
    """What ``to_bytes`` was given; anything else, or a part of it, is an error."""
    try:
        rows = pa.ipc.open_stream(data).read_all()
        head = json.loads(rows.schema.metadata[b"orrery"])
        if head["format"] != 1:
            raise ValueError(f"format {head['format']}")
        model = _from_dict(head["model"])
    except (pa.ArrowInvalid, OSError, ValueError, KeyError, TypeError) as e:
        raise IntegrityError(f"these bytes aren't a table of ours: {e}") from None
    out = spark.createDataFrame(rows.replace_schema_metadata(None))
    if model is not None and {"code", "scale"} <= set(out.columns):
        check_codes(out, model, bool(head["extra"].get("packed")))
    return out, model


def _from_dict(d: dict | None) -> Model | None:
    return None if d is None else Model(d["dim"], d["bits"], tuple(d["shift"]), tuple(d["scale"]), d["seed"])


def load_model(spark: SparkSession, root: str, version: int | None = None) -> Model | None:
    return _from_dict(manifest(spark, root, version).model)


def bad_codes(codes: DataFrame, model: Model, packed: bool = False) -> DataFrame:
    """Rows whose code or scale the model can't have made: lengths, values of the codes (a byte each, or bit planes), scales."""
    size = model.dim * model.bits // 8 if packed else model.dim
    fine = (F.length("code") == size) & F.col("scale").isNotNull() & ~F.isnan("scale") & F.col("scale").between(0.0, 1e22)
    if not packed:  # bit planes can hold no other values
        fine = fine & F.hex("code").rlike("^(0[0-%s])*$" % {2: "3", 3: "7", 4: "9A-F"}[model.bits])
    return codes.where(~F.coalesce(fine, F.lit(False)))


def check_codes(codes: DataFrame, model: Model, packed: bool = False) -> None:
    if bad_codes(codes, model, packed).limit(1).count():
        raise IntegrityError("a code or scale isn't of this model")


def check_pairs(codes: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """``id, missing`` of keys that only one side has: "codes" or "documents"."""
    a, b = codes.select(F.col(key).alias("__a")), docs.select(F.col(key).alias("__b"))
    j = a.join(b, F.col("__a") == F.col("__b"), "full_outer").where("__a is null or __b is null")
    return j.select(F.coalesce("__a", "__b").alias("id"), F.when(F.col("__a").isNull(), "codes").otherwise("documents").alias("missing"))


def sweep(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests but the newest ``keep``, and folders that no kept one names."""
    store = Storage(spark, root)
    vs = versions(spark, root)
    kept = []
    for v in vs[::-1]:
        if len(kept) < keep:
            try:
                kept.append(manifest(spark, root, v))
            except IntegrityError:  # cut off: it names nothing
                continue
    named = {m.base for m in kept} | {x for m in kept for d in m.deltas for k, x in d.items() if k in ("removed", "added")} | {f"manifest-{m.version:08d}.json" for m in kept}
    gone = [n for n in store.names() if n not in named and re.match(r"(base|added|removed)-|manifest-|_", n)]
    for n in gone:
        store.delete(n)
    return len(gone)


def create(spark: SparkSession, root: str, name: str, schema: str, key: str = "id", model: Model | None = None) -> str:
    """The path of a named table, made empty if it isn't there (what is there stays as it is)."""
    path = table_path(root, name)
    if not versions(spark, path):
        save(spark.createDataFrame([], schema), path, key, model, 0)
    return path


def exists(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a table was created and not dropped since; it may be empty."""
    return bool(versions(spark, table_path(root, name)))


def drop(spark: SparkSession, root: str, name: str) -> bool:
    """Remove a table with all versions; whether it was there. Manifests go first, so nobody reads half of it."""
    path = table_path(root, name)
    store = Storage(spark, path)
    there = bool(versions(spark, path))
    for n in sorted(store.names(), key=lambda n: not n.startswith("manifest-")):
        store.delete(n)
    store.fs.delete(store.path(path), True)
    return there


def names(spark: SparkSession, root: str) -> list[str]:
    """Tables under a root."""
    return sorted(n for n in Storage(spark, root).names() if re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", n) and ".." not in n and exists(spark, root, n))


def table_path(root: str, namespace: str) -> str:
    """A path segment from a name; separators and parents are refused."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", namespace) or ".." in namespace:
        raise IntegrityError(f"{namespace!r} isn't a name")
    return f"{root.rstrip('/')}/{namespace}"
