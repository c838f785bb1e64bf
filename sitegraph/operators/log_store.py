"""A keyed table as a log-structured store: a batch of updates writes its own
rows only.

Layout under ``root``:

* ``data/<version>-<id>``: immutable files. A *delta* holds the rows of one
  batch, with a bit per column that the batch supplied; the *base* holds whole
  rows in ``_bucket=<n>`` folders, by the leading bits of the key's hash. Where
  small buckets are many, a folder (then named by its leading bits) holds
  several, so folders, files and tasks are few: at most ``2 ** FOLDER_BITS``,
  or one for each ``BUCKET_ROWS`` rows.
* ``manifest/v<version>.json``: which base and which deltas make up a version;
  written last, by an atomic rename. A repeated version (a replayed
  micro-batch) replaces its manifest; files are never overwritten, so readers
  are undisturbed.

A read merges base and deltas by key; only the (few, small) deltas are
aggregated, the base is joined to them in place. After ``max_deltas`` batches
the deltas are folded into one; when they hold a quarter of the base's rows
they are merged into a new base, whose buckets double as long as they would
hold more than ``bucket_rows`` each. So every row is rewritten a logarithmic
number of times, whatever the size of the batches. Manifests and files older
than ``keep`` versions are removed. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS, MAX_DELTAS, KEEP = 1 << 20, 8, 32
FOLDER_BITS = 6


class LogStore:
    """``schema`` is ``name type, …``; ``keys`` name the row (the first one
    deals rows to buckets). ``merge`` says how a column combines over updates:
    ``last`` (default; of the batches that supply it), ``sum``, ``min`` or
    ``max``."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, merge: dict[str, str] | None = None,
                 bucket_rows: int = BUCKET_ROWS, max_deltas: int = MAX_DELTAS, keep: int = KEEP):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), keys, schema
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.values = [c for c in self.columns if c not in keys]
        self.merge = merge or {}
        self.bucket_rows, self.max_deltas, self.keep = bucket_rows, max_deltas, keep

    # --- files and manifests --------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._list("manifest") if n.startswith("v") and n.endswith(".json"))

    def latest(self, upto: int | None = None) -> int | None:
        """The newest version (not above ``upto``)."""
        return max((v for v in self.versions() if upto is None or v <= upto), default=None)

    def manifest(self, version: int | None) -> dict:
        """The parts of a version (a list of at most ``max_deltas`` deltas)."""
        if version is None:
            return {"base": None, "deltas": []}
        stream = self._fs().open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> int:
        sc = self.spark.sparkContext
        hidden, target = self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/v{version:08d}.json")
        stream = self._fs().create(hidden, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        rename = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(hidden, target, rename)
        self.vacuum()
        return version

    def vacuum(self, keep: int | None = None) -> None:
        """Remove all but the newest ``keep`` versions, and the files that no
        remaining version names."""
        versions = self.versions()
        kept = versions[-(keep or self.keep):]
        if kept == versions and keep is None:
            return
        used = set()
        for v in kept:
            m = self.manifest(v)
            used |= {part["path"].split("/")[1] for part in [*m["deltas"], *([m["base"]] if m["base"] else [])]}
        fs = self._fs()
        for v in versions[:-len(kept)]:
            fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        for name in self._list("data"):
            if name not in used and int(name.split("-")[0]) <= kept[-1]:
                fs.delete(self._path(f"data/{name}"), True)

    # --- rows -----------------------------------------------------------------

    def bucket(self, depth: int, key: Column | None = None) -> Column:
        """The bucket of a row: the first ``depth`` bits of its key's hash."""
        hashed = F.xxhash64(self.keys[0] if key is None else key)
        return F.shiftrightunsigned(hashed, 64 - depth).cast("int") if depth else F.lit(0)

    def _bit(self, column: str) -> int:
        return 1 << self.columns.index(column)

    def _deltas(self, deltas: list[dict]) -> DataFrame:
        """One row per key: each column's newest supplied value (or its sum,
        least or greatest) and ``_set``, the columns supplied at all."""
        rows = self.spark.read.schema(f"{self.schema}, _set long, _v long").parquet(*[f"{self.root}/{d['path']}" for d in deltas])
        if len(deltas) == 1:
            return rows
        out = []
        for c in self.values:
            kind = self.merge.get(c, "last")
            given = F.when(F.col("_set").bitwiseAND(self._bit(c)) != 0, F.col("_v"))
            out.append((F.max_by(c, given) if kind == "last" else getattr(F, kind)(c)).alias(c))
        return rows.groupBy(*self.keys).agg(*out, F.bit_or("_set").alias("_set"), F.max("_v").alias("_v"))

    def _merged(self, base: DataFrame, deltas: DataFrame) -> DataFrame:
        """The rows of ``base`` with those of ``deltas`` over them."""
        b, d = base.select(*self.columns).alias("b"), deltas.alias("d")
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in self.keys]
        out = []
        for c in self.columns:
            old, new, kind = F.col(f"b.{c}"), F.col(f"d.{c}"), self.merge.get(c, "last")
            if c in self.keys:
                out.append(old.alias(c))
            elif kind == "last":
                out.append(F.when(F.col("d._set").bitwiseAND(self._bit(c)) != 0, new).otherwise(old).alias(c))
            elif kind == "sum":
                out.append(F.coalesce(old + new, old, new).alias(c))
            else:
                out.append((F.least if kind == "min" else F.greatest)(old, new).alias(c))
        met = b.join(d, same, "left_semi").select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        fresh = deltas.join(met, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_anti")
        return b.join(d, same, "left").select(*out).unionByName(fresh.select(*self.columns))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of ``version`` (default: the newest), of all buckets of
        its base or of some."""
        manifest = self.manifest(self.latest() if version is None else version)
        parts = []
        if manifest["base"]:
            base = manifest["base"]
            inner = base["depth"] - base.get("bits", base["depth"])  # bits of a bucket below its folder's
            wanted = set(base["buckets"]) if buckets is None else set(base["buckets"]) & set(buckets)
            paths = [f"{self.root}/{base['path']}/_bucket={n}" for n in sorted({n >> inner for n in wanted})]
            if paths:
                rows = self.spark.read.schema(self.schema).parquet(*paths)
                parts.append(rows.where(self.bucket(base["depth"]).isin(sorted(wanted))) if inner and buckets is not None else rows)
        if manifest["deltas"]:
            deltas = self._deltas(manifest["deltas"])
            if buckets is not None:
                deltas = deltas.where(self.bucket(self.depth(manifest)).isin(buckets))
            parts.append(deltas)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(*parts) if len(parts) == 2 else parts[0].select(*self.columns)

    def depth(self, manifest: dict) -> int:
        return manifest["base"]["depth"] if manifest["base"] else 0

    def buckets_of(self, rows: DataFrame, key: Column | None = None, version: int | None = None) -> list[int]:
        """The buckets that the keys of ``rows`` fall in (at most as many as
        the base has)."""
        depth = self.depth(self.manifest(self.latest() if version is None else version))
        return sorted(r[0] for r in rows.select(self.bucket(depth, key)).distinct().collect()) if depth else [0]

    # --- writes ---------------------------------------------------------------

    def _new(self, version: int, kind: str) -> str:
        return f"data/{version:08d}-{uuid.uuid4().hex[:12]}/{kind}"

    def _base(self, rows: DataFrame, version: int, at_most: int) -> dict | None:
        path, depth, least = self._new(version, "base"), 0, FOLDER_BITS
        while at_most > self.bucket_rows << depth:
            depth += 1
        while at_most > BUCKET_ROWS << least:
            least += 1
        bits = min(depth, least)
        dealt = rows.select(*self.columns).withColumn("_bucket", self.bucket(bits))
        dealt = (dealt.repartition(1 << bits, "_bucket") if bits else dealt).sortWithinPartitions("_bucket", *([self.bucket(depth)] if bits < depth else []), *self.keys)
        (dealt.write.option(f"parquet.bloom.filter.enabled#{self.keys[0]}", "true")
         .option(f"parquet.bloom.filter.expected.ndv#{self.keys[0]}", str(max(min(at_most, self.bucket_rows << (depth - bits)), 1)))
         .partitionBy("_bucket").parquet(f"{self.root}/{path}"))
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/{path}")
        filled = {r["n"]: r["count"] for r in written.groupBy(self.bucket(depth).alias("n")).count().collect()}
        return {"path": path, "depth": depth, "bits": bits, "rows": sum(filled.values()), "buckets": sorted(filled)} if filled else None

    def _delta(self, rows: DataFrame, version: int) -> dict | None:
        path = self._new(version, "delta")
        rows.select(*self.columns, "_set", "_v").sortWithinPartitions(F.xxhash64(self.keys[0])).write.parquet(f"{self.root}/{path}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.root}/{path}").count()
        return {"path": path, "rows": n} if n else None

    def replace(self, rows: DataFrame, version: int | None = None) -> int:
        """A whole new version: one delta, or at once a base if it is large."""
        version = self._next(version)
        delta = self._delta(self._whole(rows, version, self.columns), version)
        manifest = {"base": None, "deltas": [delta] if delta else []}
        if delta and delta["rows"] > self.bucket_rows:
            manifest = self._folded(manifest, version, major=True)
            self._fs().delete(self._path(delta["path"]), True)
        return self._commit(version, manifest)

    def _whole(self, rows: DataFrame, version: int, given: list[str]) -> DataFrame:
        types = dict(c.split(" ", 1) for c in self.schema.split(", "))
        cells = [F.col(c).cast(types[c]).alias(c) if c in given else F.lit(None).cast(types[c]).alias(c) for c in self.columns]
        return rows.select(*cells, F.lit(sum(map(self._bit, given))).cast("long").alias("_set"), F.lit(version).cast("long").alias("_v"))

    def _next(self, version: int | None) -> int:
        last = self.latest()
        return version if version is not None else 0 if last is None else last + 1

    def append(self, rows: DataFrame, version: int | None = None, supplied: list[str] | None = None) -> int:
        """Upsert ``rows`` (one per key; keys and some of the columns) as the
        next version (or ``version``, after the newest before it)."""
        version = self._next(version)
        manifest = self.manifest(self.latest(version - 1))
        given = [c for c in self.columns if c in (rows.columns if supplied is None else supplied)]
        delta = self._delta(self._whole(rows, version, given), version)
        manifest = {"base": manifest["base"], "deltas": manifest["deltas"] + ([delta] if delta else [])}
        if len(manifest["deltas"]) > self.max_deltas:
            manifest = self._folded(manifest, version)
        return self._commit(version, manifest)

    def _folded(self, manifest: dict, version: int, major: bool = False) -> dict:
        """The same rows in fewer files: one delta, or a new base where the
        deltas have grown to a quarter of it."""
        base, deltas = manifest["base"], manifest["deltas"]
        changed = sum(d["rows"] for d in deltas)
        if not deltas or not (major or base is None or 4 * changed >= base["rows"]):
            return {"base": base, "deltas": [d for d in [self._delta(self._deltas(deltas), version)] if d] if len(deltas) > 1 else deltas}
        rows = self._deltas(deltas)
        if base:
            rows = self._merged(self.spark.read.schema(self.schema).parquet(f"{self.root}/{base['path']}"), rows)
        return {"base": self._base(rows, version, changed + (base["rows"] if base else 0)), "deltas": []}

    def compact(self, major: bool = True) -> int:
        """Fold the deltas of the newest version into its base (or into one)."""
        version = self.latest()
        return self._commit(version + 1, self._folded(self.manifest(version), version + 1, major))
