"""A store of Parquet tables with versions: scans with pruning, atomic replacement, pinned reads, incremental rebuilds.

A table is a list of layers, folders of files that are written once and never changed, each dealt to buckets of the
table's key. A version is a small manifest that names every table's layers and, for each, the buckets that later layers
stand in for. A change writes its layers first, which no manifest names yet, and then one new manifest, which appears by a single
rename: whoever reads sees all of a change or nothing of it, whenever its writer dies. Readers keep the version that they have
pinned until ``vacuum`` takes its files.

Every change also writes the keys that it touches. Derived tables remember up to which version of their source they are
built, so a rebuild reads the touched keys since then, and of the source only their buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Files

BUCKETS = 64
DETAIL = 2048  # fixed value: the longest detail of a diagnostic
#: fixed value: what is shed first when too much comes in
DROPPABLE = ("otel.metric", "otel.trace")
RUN_COLUMNS = ("series_id", "target", "horizon", "model", "label")
RETRIES = 5


def _fields(entry: dict, rows: DataFrame) -> list[dict]:
    """The columns of rows; raises where the table has one of them with another type."""
    known = {f["name"]: f["type"] for f in entry["schema"]["fields"]}
    new = [f.jsonValue() for f in rows.schema.fields]
    odd = sorted(f["name"] for f in new if f["name"] in known and f["type"] != known[f["name"]])
    if odd:
        raise ValueError(f"columns of another type than the table's: {odd}")
    return new


def _widen(entry: dict, fields: list[dict]) -> None:
    """The entry's schema with columns that it doesn't have yet."""
    known = {f["name"] for f in entry["schema"]["fields"]}
    entry["schema"]["fields"] += [{**f, "nullable": True} for f in fields if f["name"] not in known]


class Conflict(RuntimeError):
    """Another change of the same table came first."""


class Snapshot:
    """The tables of one version; what is written later isn't in them."""

    def __init__(self, store: Store, manifest: dict) -> None:
        self.store, self.version, self.entries = store, manifest["version"], manifest["tables"]

    def names(self) -> list[str]:
        return sorted(self.entries)

    def reducers(self) -> dict[str, str | None]:
        """The reducer's version of each derived table."""
        return {n: e["built"]["reducer"] for n, e in sorted(self.entries.items()) if e.get("built")}

    def table(self, name: str) -> DataFrame:
        return self.scan(name).drop("layer", "bucket")

    def scan(self, name: str) -> DataFrame:
        """The rows with ``layer`` and ``bucket``, both partitions of the files, so that filters on them prune."""
        if name not in self.entries:
            raise ValueError(f"no table {name} in version {self.version}")
        entry, spark = self.entries[name], self.store.spark
        schema = T.StructType.fromJson(entry["schema"]).add("layer", "string").add("bucket", "integer")
        if not entry["layers"]:
            return spark.createDataFrame([], schema)
        at = self.store.path(name)
        rows = spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/layer={x['id']}" for x in entry["layers"]])
        for x in entry["layers"]:
            if x["hidden"]:
                rows = rows.where((F.col("layer") != x["id"]) | ~F.col("bucket").isin(x["hidden"]))
        return rows


class Transaction:
    """Changes of one or more tables that become one version. Its own reads see them before others do."""

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.pin()
        self.now = json.loads(json.dumps(self.base.entries))
        self.replaced: set[str] = set()
        self.changes: dict[str, list[Callable[[dict], None]]] = {}

    def table(self, name: str) -> DataFrame:
        return Snapshot(self.store, {"version": self.base.version, "tables": self.now}).table(name)

    def scan(self, name: str) -> DataFrame:
        return Snapshot(self.store, {"version": self.base.version, "tables": self.now}).scan(name)

    def _entry(self, name: str, rows: DataFrame, key: str | None) -> dict:
        fresh = {"key": key, "buckets": self.store.buckets if key else 1, "schema": rows.schema.jsonValue(), "layers": [], "log": []}
        return self.now.get(name) or fresh

    def _changed(self, name: str, entry: dict, change: Callable[[dict], None]) -> None:
        """Applies a change to what this transaction sees, and keeps it for the manifest."""

        def on(tables: dict) -> None:
            change(tables.setdefault(name, json.loads(json.dumps({**entry, "layers": [], "log": []}))))

        on(self.now)
        self.changes.setdefault(name, []).append(on)

    def _write(self, name: str, entry: dict, rows: DataFrame, keys: DataFrame | None) -> tuple[str, str | None]:
        """A layer of rows, and the keys that it touches; no manifest names them yet."""
        layer = uuid.uuid4().hex
        own = self.store.bucketed(rows, entry["key"], entry["buckets"])
        own.write.partitionBy("bucket").parquet(f"{self.store.path(name)}/layer={layer}")
        self.store.step(f"layer of {name}")
        if entry["key"] is None:
            return layer, None
        touched = keys if keys is not None else self.store.spark.read.schema(rows.schema).parquet(f"{self.store.path(name)}/layer={layer}").select(entry["key"])
        touched.select(entry["key"]).distinct().write.parquet(f"{self.store.path(name)}/touched={layer}")
        self.store.step(f"keys of {name}")
        return layer, layer

    def append(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """Adds rows; columns that the table doesn't have yet are null in its other rows."""
        entry = self._entry(name, rows, key)
        new = _fields(entry, rows)
        layer, touched = self._write(name, entry, rows, None)

        def change(e: dict) -> None:
            _widen(e, new)
            e["layers"].append({"id": layer, "hidden": []})
            if touched:
                e["log"].append({"version": None, "keys": touched})

        self._changed(name, entry, change)

    def replace(self, name: str, rows: DataFrame, keys: DataFrame, key: str | None = None) -> None:
        """All rows of the named keys become ``rows``; only the buckets of those keys are read and written."""
        entry = self._entry(name, rows, key)
        key = entry["key"]
        named = keys.select(key).distinct()
        buckets = sorted(r["bucket"] for r in self.store.bucketed(named, key, entry["buckets"]).select("bucket").distinct().collect())
        if name in self.now:
            columns = [f["name"] for f in entry["schema"]["fields"]]
            held = self.scan(name).where(F.col("bucket").isin(buckets)).drop("layer", "bucket")
            rows = held.join(named, key, "left_anti").select(columns).unionByName(rows, allowMissingColumns=True)
        new = _fields(entry, rows)
        layer, touched = self._write(name, entry, rows, named)

        def change(e: dict) -> None:
            _widen(e, new)
            for x in e["layers"]:
                x["hidden"] = sorted({*x["hidden"], *buckets})
            e["layers"] = [x for x in e["layers"] if len(x["hidden"]) < e["buckets"]] + [{"id": layer, "hidden": []}]
            e["log"].append({"version": None, "keys": touched})

        self.replaced.add(name)
        self._changed(name, entry, change)

    def rewrite(self, name: str, rows: DataFrame, buckets: int | None = None, key: str | None = None) -> None:
        """All rows of the table become ``rows``, in another number of buckets if one is named."""
        entry = {**self._entry(name, rows, key), "schema": rows.schema.jsonValue()}
        entry["buckets"] = buckets or entry["buckets"]
        layer, touched = self._write(name, entry, rows, None)
        before = self.now.get(name)
        # keys that the table no longer has are touched, too
        gone = None
        if before and touched:
            gone = uuid.uuid4().hex
            self.table(name).select(entry["key"]).distinct().write.parquet(f"{self.store.path(name)}/touched={gone}")

        def change(e: dict) -> None:
            e |= {"schema": entry["schema"], "buckets": entry["buckets"], "layers": [{"id": layer, "hidden": []}]}
            e["log"] += [{"version": None, "keys": k} for k in (touched, gone) if k]

        self.replaced.add(name)
        self._changed(name, entry, change)

    def built(self, name: str, source: str, reducer: str | None) -> None:
        """Notes that a derived table is made from this version of its source."""

        # of a source that others may have changed since, only what this transaction has read counts
        version = None if source in self.changes else self.base.version

        def change(e: dict) -> None:
            e["built"] = {"source": source, "version": version, "reducer": reducer}

        self._changed(name, self.now[name], change)

    def commit(self) -> int:
        """Makes the changes the next version; raises Conflict if a table that is replaced has changed meanwhile."""
        if not self.changes:
            return self.base.version
        for _ in range(1000):
            latest = self.store.pin()
            for name in self.replaced:
                if latest.entries.get(name, {}).get("layers") != self.base.entries.get(name, {}).get("layers"):
                    raise Conflict(name)
            version = latest.version + 1
            tables = json.loads(json.dumps(latest.entries))
            for changes in self.changes.values():
                for change in changes:
                    change(tables)
            for e in tables.values():
                for x in (*e["log"], *([e["built"]] if e.get("built") else [])):
                    x["version"] = version if x["version"] is None else x["version"]
            for name, e in tables.items():
                # keys that all tables derived from this one are past, or that none needs, since its first build is of all
                past = [d["built"]["version"] for d in tables.values() if d.get("built") and d["built"]["source"] == name]
                e["log"] = [x for x in e["log"] if past and x["version"] > min(past)]
            self.store.step("before the manifest")
            if self.store.publish({"version": version, "tables": tables}):
                self.store.step("after the manifest")
                return version
        raise Conflict("no turn")


class Store:
    """Tables below one folder, which all executors must see. key: the column that tables are dealt by unless they name another."""

    def __init__(self, spark: SparkSession, root: str, key: str = "capture_id", buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.files = Files(spark, root)

    def step(self, name: str) -> None:
        """Called between any two steps of a change."""

    @staticmethod
    def bucketed(df: DataFrame, key: str | None, buckets: int) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # versions

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(f"{self.root}/_versions") if n.startswith("v") and n.endswith(".json"))

    def pin(self, version: int | None = None) -> Snapshot:
        """The tables of a version, by default of the newest one."""
        if version is None:
            version = (self._versions() or [0])[-1]
        return Snapshot(self, json.loads(self.files.read(self._manifest(version))) if version else {"version": 0, "tables": {}})

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_versions/v{version:012d}.json"

    def publish(self, manifest: dict) -> bool:
        return self.files.write_new(self._manifest(manifest["version"]), json.dumps(manifest, sort_keys=True))

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> list[str]:
        """Removes all but the newest ``keep`` versions, and files that none of them names and that are older than ``grace`` seconds; returns what went."""
        versions = self._versions()
        kept = [self.pin(v) for v in versions[-keep:]]
        named = {n: {f"layer={x['id']}" for s in kept if n in s.entries for x in s.entries[n]["layers"]} | {f"touched={x['keys']}" for s in kept if n in s.entries for x in s.entries[n]["log"]} for s in kept for n in s.entries}
        gone = [self._manifest(v) for v in versions[:-keep]]
        gone += [f"{self.root}/_versions/{n}" for n in self.files.names(f"{self.root}/_versions") if n.endswith(".part")]
        for table in self.files.names(self.root):
            if not table.startswith("_"):
                gone += [f"{self.path(table)}/{n}" for n in self.files.names(self.path(table)) if n.startswith(("layer=", "touched=")) and n not in named.get(table, ())]
        gone = [g for g in gone if self.files.age(g) >= grace]
        for g in gone:
            self.files.remove(g)
        return gone

    def change(self, work: Callable[[Transaction], None]) -> int:
        """Runs work on a transaction and commits it; again from the start, if another change of its tables came first."""
        for k in range(RETRIES):
            turn = Transaction(self)
            work(turn)
            try:
                return turn.commit()
            except Conflict:
                if k == RETRIES - 1:
                    raise
        raise AssertionError

    # scans

    def table(self, table: str) -> DataFrame:
        return self.pin().table(table)

    def session(self, table: str, capture_id, kinds: Sequence[str] = (), kind: str = "kind") -> DataFrame:
        """One session's rows, of the named kinds if any are named; one bucket is read."""
        now = self.pin()
        key, buckets = now.entries[table]["key"], now.entries[table]["buckets"]
        own = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(capture_id).cast(now.table(table).schema[key].dataType)), F.lit(buckets)).cast("int")).first()[0]
        rows = now.scan(table).where((F.col("bucket") == own) & (F.col(key) == capture_id)).drop("layer", "bucket")
        return rows.where(F.col(kind).isin(*kinds)) if kinds else rows

    def of_kind(self, table: str, value: str, kind: str = "kind") -> DataFrame:
        return self.table(table).where(F.col(kind) == value)

    def by_id(self, table: str, ids: DataFrame, ident: str) -> DataFrame:
        return self.table(table).join(ids.select(ident), ident, "left_semi")

    def evidence(self, capture_id, table: str = "evidence", metric: str = "metric") -> DataFrame:
        """One session's evidence in the order of its metrics."""
        return self.session(table, capture_id).orderBy(metric)

    # writes

    def append(self, table: str, rows: DataFrame) -> None:
        self.change(lambda t: t.append(table, rows, self.key))

    def replace(self, table: str, rows: DataFrame, sessions: DataFrame) -> None:
        """All rows of the named sessions become ``rows``, in one step for readers."""
        self.change(lambda t: t.replace(table, rows, sessions, self.key))

    def replace_all(self, changes: Mapping[str, DataFrame], sessions: DataFrame) -> None:
        """The named sessions' rows of several tables, all in one step."""

        def work(t: Transaction) -> None:
            for name, rows in changes.items():
                t.replace(name, rows, sessions, self.key)

        self.change(work)

    def purge(self, sessions: DataFrame, tables: Sequence[str] = ()) -> None:
        """No rows of the named sessions are left in the tables (by default: in all that are dealt by session)."""
        now = self.pin()
        names = tables or [n for n in now.names() if now.entries[n]["key"] == self.key]
        self.replace_all({n: now.table(n).limit(0) for n in names}, sessions)

    def rebucket(self, table: str, buckets: int) -> None:
        """The same rows in another number of buckets, for tables that have outgrown theirs."""
        self.change(lambda t: t.rewrite(table, t.table(table), buckets))

    def rebuild(
        self, derived: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], source: str = "observations", reducers: Mapping[str, str] | None = None, full: bool = False
    ) -> dict[str, str]:
        """Brings the derived tables up to date, each made from the one before, all in one step; says for each whether it was 'full', 'changed' or 'kept'.

        Reducers work on whole sessions, so only sessions that were touched in a table's source since it was built are
        reduced again, and only their buckets are read. A table without a note of its source, or made by another
        version of its reducer, is rebuilt wholly; late rows are rows like others.
        """
        told: dict[str, str] = {}

        def work(t: Transaction) -> None:
            before = source
            for name, reduce in derived:
                reducer = (reducers or {}).get(name)
                built = t.now.get(name, {}).get("built")
                if full or not built or built["source"] != before or built["reducer"] != reducer:
                    rows = reduce(t.table(before))
                    t.rewrite(name, rows, key=self.key)
                    told[name] = "full"
                else:
                    # what this transaction itself has changed has no version yet
                    keys = [x["keys"] for x in t.now[before]["log"] if x["version"] is None or x["version"] > built["version"]]
                    if not keys:
                        told[name] = "kept"
                        before = name
                        continue
                    dirty = self._keys(t, before, keys)
                    t.replace(name, reduce(self.of_keys(t, before, dirty)), dirty, self.key)
                    told[name] = "changed"
                t.built(name, before, reducer)
                before = name

        self.change(work)
        return told

    def _keys(self, t: Transaction, name: str, folders: Sequence[str]) -> DataFrame:
        schema = t.table(name).select(t.now[name]["key"]).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path(name)}/touched={k}" for k in folders]).distinct()

    def of_keys(self, t: Transaction | Snapshot, name: str, keys: DataFrame) -> DataFrame:
        """Rows of the keys; only their buckets are read (at most as many numbers as the table has buckets come to the driver)."""
        entry = (t.now if isinstance(t, Transaction) else t.entries)[name]
        buckets = [r["bucket"] for r in self.bucketed(keys, entry["key"], entry["buckets"]).select("bucket").distinct().collect()]
        return t.scan(name).where(F.col("bucket").isin(buckets)).drop("layer", "bucket").join(keys, entry["key"], "left_semi")

    def put_series(self, rows: DataFrame, series_id: str) -> None:
        """Insert or replace one series by its content hash."""
        own = rows.withColumn("series_id", F.lit(series_id))
        self.change(lambda t: t.replace("series", own, own.sparkSession.createDataFrame([(series_id,)], "series_id string"), "series_id"))

    def series(self, series_id: str, shapes: Mapping[str, str] | None = None) -> DataFrame:
        """One series' snapshot; only its bucket is read. shapes: types of columns that are stored as JSON text."""
        rows = self.session("series", series_id)
        return rows.withColumns({c: F.from_json(c, kind) for c, kind in (shapes or {}).items()})

    def series_list(self, clock: str | None = None) -> DataFrame:
        """series_id, clock and rows of every series, of one clock if named."""
        rows = self.table("series")
        rows = rows.where(F.col("clock") == clock) if clock else rows
        return rows.groupBy("series_id", "clock").agg(F.count("*").alias("rows"))

    def put_run(self, run: DataFrame) -> None:
        """Append forecast runs of exactly RUN_COLUMNS; the id, the claim and the time are filled in here."""
        made = assert_columns(run, RUN_COLUMNS)
        ident = F.concat(F.lit("run_"), F.substring(F.sha2(F.to_json(F.struct(*RUN_COLUMNS)), 256), 1, 24))
        made = made.withColumns({"run_id": ident, "claim": F.lit("predictive"), "made_at": F.current_timestamp()})
        self.change(lambda t: t.append("runs", made, "series_id"))

    def runs_of(self, series_id: str) -> DataFrame:
        """A series' runs in the order of their making."""
        return self.session("runs", series_id).orderBy("made_at", "run_id")

    def diagnostics(self, capture_id=None) -> DataFrame:
        """All diagnostics, or those of one capture."""
        rows = self.table("diagnostics")
        return rows if capture_id is None else rows.where(F.col("capture_id") == capture_id)

    def append_checked(self, table: str, rows: DataFrame, columns: Sequence[str]) -> None:
        """Append outcomes or interventions of exactly these columns."""
        self.change(lambda t: t.append(table, assert_columns(rows, columns)))

    def diagnose(self, rows: DataFrame) -> None:
        """Append diagnostics(kind, detail, at, capture_id)."""
        self.change(lambda t: t.append("diagnostics", rows.withColumn("detail", F.substring("detail", 1, DETAIL))))


def older_than(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``now`` (a timestamp's text); rows without a time stay."""
    return df.where(F.col(at).isNull() | F.expr(f"{at} >= timestamp_ntz'{now}' - interval {days} days"))


def stale(df: DataFrame, version: str, current: Sequence[str]) -> DataFrame:
    """Rows of another version; an unknown version is not stale."""
    return df.where(~F.col(version).isin(*current))


def assert_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """df, if it has exactly these columns; else the missing and extra ones are named."""
    missing, extra = sorted(set(wanted) - set(df.columns)), sorted(set(df.columns) - set(wanted))
    if missing or extra:
        raise ValueError(f"missing columns {missing}, extra columns {extra}")
    return df


def droppable(kind: str):
    """Whether a kind of observation may be shed."""
    out = F.lit(False)
    for prefix in DROPPABLE:
        out = out | F.col(kind).startswith(prefix)
    return out
