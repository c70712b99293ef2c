"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards. Shards of like size form a tier; a tier with enough of them is merged into larger
ones, up to the target size, tier by tier. Shards are never changed: each version of the manifest names the files that make
up the table, and is put in place by one rename that fails if another writer was first. Rows move without a shuffle: a
merge is one task that reads its shards and writes one file. Only DataFrame operations touch rows; the driver holds one
entry a shard.

A writer leaves an intent under its folder's name before it writes there and takes it away after its commit. Clearing passes
over folders with an intent, so writers and clearing may run side by side.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from contextlib import ExitStack, contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from locusforge.llm.common import filesystem, quoted, remove

#: Merges that one job carries out.
MERGES_PER_JOB = 128
#: Shards whose table (some 150 bytes each) is sent to all; beyond, rows meet it by a shuffle, a shard's rows in one task.
BROADCAST_SHARDS = 100_000
#: Seconds after which an intent counts as left behind by a writer that died.
INTENT_SECONDS = 7 * 86_400


@dataclass(frozen=True)
class Shard:
    name: str
    folder: str
    rows: int
    bytes: int
    generation: int


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def united(old: StructType, new: StructType) -> StructType:
    """Fields of both, the old ones first and all nullable; a field in both must have one type and one spelling."""
    known = {f.name.lower(): f for f in old}
    for f in new:
        own = known.get(f.name.lower())
        if own is not None and (own.name != f.name or own.dataType != f.dataType):
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} does not fit {own.name} {own.dataType.simpleString()}")
    fields = [*old, *[f for f in new if f.name.lower() not in known]]
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in fields])


class ShardStore:
    """Shards and manifests under ``root``, a folder that all executors share.

    ``target_bytes``: size at which a shard is done. ``fan_in``: shards of a tier that start a merge, and the ratio of
    sizes between tiers. ``least_bytes``: shards below count as the lowest tier.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 64 << 20, fan_in: int = 4, least_bytes: int = 1 << 20):
        if fan_in < 2 or target_bytes < 1 or least_bytes < 1:
            raise ValueError("fan_in must be 2 or more, sizes 1 or more")
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes = target_bytes, fan_in, least_bytes

    # ---- manifests

    def versions(self) -> list[int]:
        fs, folder = filesystem(self.spark, f"{self.root}/manifest")
        if not fs.exists(folder):
            return []
        return sorted(int(m[1]) for f in fs.listStatus(folder) if f.getLen() and (m := re.fullmatch(r"v(\d+)\.json", f.getPath().getName())))

    def shards(self, version: int | None = None) -> list[Shard]:
        """Shards of a version; of the last one by default, and none before the first."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return []
        text = "".join(r.value for r in self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json").collect())
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, base: int, shards: list[Shard], schema_json: str) -> int:
        """Write version ``base + 1`` whole under another name and rename it; an existing version is never replaced."""
        jvm = self.spark.sparkContext._jvm
        gateway = self.spark.sparkContext._gateway
        body = json.dumps({"version": base + 1, "schema": json.loads(schema_json), "shards": [asdict(s) for s in shards]})
        fs, made = filesystem(self.spark, f"{self.root}/manifest/.new-{uuid.uuid4().hex}")
        out = fs.create(made, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{base + 1:08d}.json")
        plain = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(made, final, plain)
        except Exception as error:
            fs.delete(made, False)
            if "exist" in str(error).lower():
                raise Conflict(f"version {base + 1} is there already") from None
            raise
        return base + 1

    def schema(self, version: int | None = None) -> StructType | None:
        """Schema of a version, the last one by default; none before the first."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return None
        text = "".join(r.value for r in self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json").collect())
        return StructType.fromJson(json.loads(text)["schema"])

    @contextmanager
    def _intent(self, folder: str):
        """While this holds, ``vacuum`` leaves ``folder`` alone."""
        fs, mark = filesystem(self.spark, f"{self.root}/intent/{folder}")
        fs.create(mark, False).close()
        try:
            yield
        finally:
            fs.delete(mark, False)

    # ---- reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, with ``_metadata`` telling each row's shard; columns that a shard lacks are null. A store
        without shards has no schema: an error."""
        kind = self.schema(version)
        if kind is None:
            raise ValueError("nothing has been appended")
        paths = [f"{self.root}/data/{s.folder}/{s.name}" for s in self.shards(version)]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _written(self, folder: str, generation: int) -> list[Shard]:
        path = f"{self.root}/data/{folder}"
        fs, where = filesystem(self.spark, path)
        sizes = {f.getPath().getName(): f.getLen() for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        # Answered from the files' footers: one row a shard.
        rows = {r.name: r.n for r in self.spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()}
        return [Shard(name, folder, rows.get(name, 0), size, generation) for name, size in sorted(sizes.items()) if rows.get(name, 0)]

    def append(self, df: DataFrame) -> int:
        """Write the rows as small shards, one for each partition with rows, and commit them. Returns the new version.

        Nulls, repeated rows and any column names Parquet takes are kept as they are. No rows make a version without new
        shards. If another writer commits first its version is taken as the base, since appends do not conflict. Columns that
        the store lacks are added, and null in its older rows; one whose type or spelling differs is an error, and nothing is
        committed.
        """
        united(self.schema() or StructType([]), df.schema)
        folder = f"append-{uuid.uuid4().hex}"
        with self._intent(folder):
            df.write.parquet(f"{self.root}/data/{folder}")
            new = self._written(folder, 0)
            while True:
                base = max(self.versions(), default=0)
                kind = united(self.schema(base) or StructType([]), df.schema)
                try:
                    return self._commit(base, [*self.shards(base), *new], kind.json())
                except Conflict:
                    continue

    # ---- compaction

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.least_bytes, self.fan_in) + 1e-9)) if size > self.least_bytes else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Merges that are due: in each tier with ``fan_in`` unfinished shards, groups of two or more up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes * 3 // 4:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        merges = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fan_in:
                continue
            group: list[Shard] = []
            for s in sorted(own, key=lambda s: (s.bytes, s.folder, s.name)):
                if group and sum(g.bytes for g in group) + s.bytes > self.target_bytes:
                    merges.append(group)
                    group = []
                group.append(s)
            merges.append(group)
        return [g for g in merges if len(g) > 1]

    def compact(self, max_rounds: int = 32) -> int:
        """Merge until no tier is due; each round commits a version. Returns the last version."""
        for _ in range(max_rounds):
            base = max(self.versions(), default=0)
            shards = self.shards(base)
            merges = self.plan(shards)
            if not merges:
                return base
            kind, kept = self.schema(base), set(shards)
            added: list[Shard] = []
            folder = f"merge-{uuid.uuid4().hex}"
            parts = range(0, len(merges), MERGES_PER_JOB)
            with ExitStack() as held:
                for at in parts:
                    part = merges[at : at + MERGES_PER_JOB]
                    held.enter_context(self._intent(f"{folder}-{at}"))
                    added += self._merge(part, kind, f"{folder}-{at}")
                    kept -= {s for g in part for s in g}
                try:
                    self._commit(base, [*sorted(kept, key=lambda s: (s.folder, s.name)), *added], kind.json())
                except Conflict:
                    continue  # what was merged stays unnamed and goes with the next vacuum
        return max(self.versions(), default=0)

    def _merge(self, groups: list[list[Shard]], kind: StructType, folder: str) -> list[Shard]:
        whole = None
        for group in groups:
            one = self.spark.read.schema(kind).parquet(*[f"{self.root}/data/{s.folder}/{s.name}" for s in group]).coalesce(1)
            whole = one if whole is None else whole.union(one)
        whole.write.option("maxRecordsPerFile", 0).parquet(f"{self.root}/data/{folder}")
        made = self._written(folder, 1 + max(s.generation for g in groups for s in g))
        if sum(s.rows for s in made) != sum(s.rows for g in groups for s in g):
            raise RuntimeError("a merge has other rows than its shards")
        return made

    def vacuum(self, keep_versions: int = 1, intent_seconds: float = INTENT_SECONDS) -> int:
        """Delete files that none of the last versions names, and empty older manifests. Returns the number of folders deleted.

        Folders are listed before intents, and intents before manifests: a folder without an intent has been committed by
        then or never will be. Intents older than ``intent_seconds`` no longer protect.
        """
        fs, data = filesystem(self.spark, f"{self.root}/data")
        entries = list(fs.listStatus(data)) if fs.exists(data) else []
        _, marks = filesystem(self.spark, f"{self.root}/intent")
        oldest = (time.time() - intent_seconds) * 1000
        writing = {m.getPath().getName() for m in (fs.listStatus(marks) if fs.exists(marks) else []) if m.getModificationTime() >= oldest}
        versions = self.versions()
        kept = versions[-keep_versions:]
        named = {(s.folder, s.name) for v in kept for s in self.shards(v)}
        folders = {f for f, _ in named}
        gone = 0
        for entry in entries:
            name = entry.getPath().getName()
            if name in writing:
                continue
            if name not in folders:
                remove(self.spark, f"{self.root}/data/{name}")
                gone += 1
            else:
                for file in fs.listStatus(entry.getPath()):
                    if file.getPath().getName().endswith(".parquet") and (name, file.getPath().getName()) not in named:
                        fs.delete(file.getPath(), False)
        for v in versions[:-keep_versions]:
            # Emptied and not deleted: a writer who still has an older version as its base must find its number taken.
            fs.create(filesystem(self.spark, f"{self.root}/manifest/v{v:08d}.json")[1], True).close()
        return gone

    def placement(self, id_col: str = "doc_id") -> DataFrame:
        """``doc_id, shard, shard_rows, shard_bytes, tier, generation, version``: where each row of the last version lies."""
        version = max(self.versions(), default=0)
        shards = self.shards(version)
        table = self.spark.createDataFrame([(s.name, s.rows, s.bytes, self.tier(s.bytes), s.generation, version) for s in shards], "shard string, shard_rows long, shard_bytes long, tier int, generation int, version int")
        if not shards:
            return table.select(F.lit(None).cast("long").alias("doc_id"), "*")
        rows = self.read(version).select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col("_metadata.file_name").alias("shard"))
        return rows.join(F.broadcast(table) if len(shards) <= BROADCAST_SHARDS else table, "shard").select("doc_id", "shard", "shard_rows", "shard_bytes", "tier", "generation", "version")


def arrive(store: ShardStore, df: DataFrame, arrivals: int = 4, id_col: str = "doc_id") -> ShardStore:
    """Append ``df`` in parts that hash its identifiers, compacting and clearing after each.

    A null identifier goes by its hash like any other, rows that repeat one go together, and empty parts make versions without
    new shards; columns may have any names that Parquet takes.
    """
    for part in range(arrivals):
        store.append(df.where(F.pmod(F.xxhash64(F.col(quoted(id_col))), F.lit(arrivals)) == part))
        store.compact()
        store.vacuum()
    return store
