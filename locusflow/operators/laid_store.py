"""Locus stores on shared storage: laid out for joins, committed by versions.

A store folder holds ``data``, one folder for every build of a contig, and ``versions``,
numbered manifests that say which of those folders make up the store. A build writes new
data folders, checks them, and then puts one new manifest in place by a rename; until
that rename succeeds readers see the previous version whole, and nothing is moved or
deleted. Data of old versions go by ``drop_versions``, later and apart.

Rows carry the four normalised locus columns as plain columns and lie in buckets of their
hash, in folders by contig: a join on the locus reads the buckets where they lie, without
an exchange of the store, and only the contigs asked for.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.functions.keys import LOCUS, prefixed_contig, with_locus
from locusflow.operators.health import STALE_AFTER_DAYS

CONTIG = "contig"
SCOPE = ["region", "bed", "preset"]


class StoreConflict(RuntimeError):
    """A commit that did not take effect; the previous version is unchanged."""


class Folder:
    """The few file-system calls a store needs, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, name: str) -> list[str]:
        where = self._path(self.at(name))
        return [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(self.at(old)), self._path(self.at(new)))

    def remove(self, name: str) -> bool:
        return self._fs.delete(self._path(self.at(name)), True)

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(self.at(name)), False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()


def _number(name: str) -> int | None:
    stem, dot, end = name.partition(".")
    return int(stem) if dot and end == "json" and stem.isdigit() else None


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    return sorted(n for n in map(_number, Folder(spark, path).names("versions")) if n is not None)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version consists of; the newest by default, None for a store never committed."""
    known = versions(spark, path)
    if not known:
        return None
    number = known[-1] if version is None else version
    text = spark.read.text(f"{path}/versions/{number:08d}.json", wholetext=True).first()
    return json.loads(text[0])


def commit(spark: SparkSession, path: str, content: dict, after: int) -> int:
    """Put ``content`` in place as the version that follows ``after``; raises if another one has, or the rename fails."""
    folder, number = Folder(spark, path), after + 1
    final, draft = f"versions/{number:08d}.json", f"versions/draft-{uuid.uuid4().hex}"
    folder.write(draft, json.dumps(content | {"version": number}, indent=1))
    if (versions(spark, path) or [0])[-1] != after or folder.exists(final) or not folder.rename(draft, final):
        folder.remove(draft)
        raise StoreConflict(f"version {number} of {path} was not committed")
    return number


def _schema(store: DataFrame) -> T.StructType:
    return T.StructType([f for f in store.schema if f.name not in (*LOCUS, CONTIG)])


def _fields(columns: T.StructType) -> str:
    kinds = {"locus_pos": "int"}
    own = [f"`{c}` {kinds.get(c, 'string')}" for c in LOCUS]
    return ", ".join([*own, *(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)])


def _write(store: DataFrame, path: str, buckets: int) -> str:
    """Write all rows into a new data folder; returns its name."""
    spark, build = store.sparkSession, f"data/{uuid.uuid4().hex}"
    name = f"build_{uuid.uuid4().hex}"
    rows = with_locus(store).select(*LOCUS, *_schema(store).names, F.col("locus_chrom").alias(CONTIG))
    (
        rows.repartition(buckets, *LOCUS)
        .write.partitionBy(CONTIG).bucketBy(buckets, *LOCUS).sortBy("locus_pos", "locus_ref", "locus_alt")
        .option("path", f"{path}/{build}").saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")  # the table's files are its own; only the name goes
    return build


def _rows_by_contig(spark: SparkSession, folder: Folder, build: str) -> dict[str, int]:
    """Rows of every contig written: no column is read, so the counts come from the file footers."""
    if not any(x.startswith(f"{CONTIG}=") for x in folder.names(build)):
        return {}
    counted = spark.read.option("basePath", folder.at(build)).parquet(folder.at(build)).groupBy(F.col(CONTIG).cast("string").alias("c")).count()
    return {r["c"]: r["count"] for r in counted.collect()}  # one row per contig


def write_version(
    store: DataFrame, path: str, name: str = "store", source: dict | None = None, cadence: str = "frozen",
    scopes: dict[str, dict] | None = None, buckets: int | None = None, built_at: str | None = None,
) -> int:
    """Commit ``store`` (one row per locus: chrom, pos, ref, alt and values) as the whole content of a new version.

    A join keeps the store where it lies if it has no fewer buckets than the session has
    shuffle partitions, so that is the default number.
    """
    spark = store.sparkSession
    before = manifest(spark, path) or {"version": 0}
    buckets = buckets or _session_buckets(spark)
    build = _write(store, path, buckets)
    rows = _rows_by_contig(spark, Folder(spark, path), build)
    contigs = {c: _contig(build, c, n, (scopes or {}).get(c)) for c, n in sorted(rows.items())}
    return commit(spark, path, _content(store, name, source, cadence, buckets, contigs, built_at), before["version"])


def _session_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefixed(contig: str) -> str:
    return contig if contig.lower().startswith("chr") else f"chr{contig}"


def _contig(build: str, contig: str, rows: int, scope: dict | None) -> dict:
    return {"folder": f"{build}/{CONTIG}={contig}" if rows else None, "rows": rows, "scope": {k: (scope or {}).get(k) for k in SCOPE}}


def _content(store: DataFrame, name, source, cadence, buckets, contigs, built_at) -> dict:
    return {
        "store": name, "source": source or {}, "cadence": cadence, "stale_after_days": STALE_AFTER_DAYS.get(name),
        "built_at": built_at or datetime.now(timezone.utc).isoformat(timespec="seconds"), "buckets": buckets,
        "columns": _schema(store).jsonValue(), "rows": sum(c["rows"] for c in contigs.values()), "contigs": contigs,
    }


def pending_contigs(known: dict | None, wanted: dict[str, dict]) -> list[str]:
    """Contigs whose wanted scope (region, regions file, preset) differs from the one that built them."""
    built = (known or {}).get("contigs", {})
    plain = lambda scope: {k: scope.get(k) for k in SCOPE}
    return sorted(c for c, scope in wanted.items() if c not in built or built[c]["scope"] != plain(scope))


def extend_version(
    store: DataFrame, path: str, wanted: dict[str, dict], name: str = "store", source: dict | None = None,
    cadence: str = "frozen", buckets: int | None = None,
) -> list[str]:
    """Build the contigs whose scope changed and commit them with all others unchanged; returns their names.

    A rebuilt contig without rows in its new scope has none in the new version, whatever it
    held before. ``wanted`` is one scope per contig, by prefixed name. Nothing pending: no new version.
    """
    spark = store.sparkSession
    before = manifest(spark, path)
    buckets = buckets or (before["buckets"] if before else _session_buckets(spark))
    due = pending_contigs(before, wanted)
    if not due:
        return []
    if before is not None:
        mine = {f.name.lower() for f in _schema(store)}
        theirs = {f["name"].lower() for f in before["columns"]["fields"]}
        if before["buckets"] != buckets or mine != theirs:
            raise StoreConflict(f"{path} has other buckets or columns; write it whole")
    part = store.where(prefixed_contig(F.col("chrom")).isin(due))
    build = _write(part, path, buckets)
    rows = _rows_by_contig(spark, Folder(spark, path), build)
    contigs = dict((before or {}).get("contigs", {}))
    contigs |= {c: _contig(build, c, rows.get(c, 0), wanted[c]) for c in due}
    commit(spark, path, _content(store, name, source, cadence, buckets, dict(sorted(contigs.items())), None), (before or {"version": 0})["version"])
    return due


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep``, and data folders that no kept manifest names; for no running build."""
    folder, known = Folder(spark, path), versions(spark, path)
    used = set()
    for number in known[-keep:]:
        used |= {c["folder"].split("/")[1] for c in manifest(spark, path, number)["contigs"].values() if c["folder"]}
    for number in known[:-keep]:
        folder.remove(f"versions/{number:08d}.json")
    gone = [x for x in folder.names("data") if x not in used]
    for x in gone:
        folder.remove(f"data/{x}")
    return gone


def read_version(spark: SparkSession, path: str, contigs: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The store of one version, as a bucketed relation; with ``contigs``, only those folders are read.

    Its locus columns are already normalised, so locus joins use them as they are.
    """
    held = manifest(spark, path, version)
    if held is None:
        raise FileNotFoundError(f"no committed version in {path}")
    columns = T.StructType.fromJson(held["columns"])
    name = f"store_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({_fields(columns)}, `{CONTIG}` string) USING parquet PARTITIONED BY (`{CONTIG}`) "
        f"CLUSTERED BY ({', '.join(LOCUS)}) SORTED BY (locus_pos, locus_ref, locus_alt) INTO {held['buckets']} BUCKETS LOCATION '{path}/data'"
    )
    for c, x in held["contigs"].items():
        if x["folder"]:
            spark.sql(f"ALTER TABLE {name} ADD PARTITION (`{CONTIG}`='{c}') LOCATION '{path}/{x['folder']}'")
    rows = spark.table(name)
    if contigs is not None:
        rows = rows.where(F.col(CONTIG).isin([prefixed(c) for c in contigs]))
    return rows.drop(CONTIG)


def manifest_rows(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(store, present, readable, rows_expected, built_at) of stores by name, as ``store_status`` reads them."""
    found = []
    for store, path in paths.items():
        known = Folder(spark, path).exists("versions")
        held = manifest(spark, path) if known else None
        found.append((store, known, held is not None, held and held["rows"], held and held["built_at"]))
    return spark.createDataFrame(found, "store string, present boolean, readable boolean, rows_expected bigint, built_at string")


def version_measures(spark: SparkSession, path: str) -> DataFrame:
    """(contig, rows, first_pos, last_pos) of the current version's files, from Parquet footers.

    The aggregates are pushed into the reader, which answers them from row-group counts and
    statistics; no column chunk is read. The result has one row per contig.
    """
    held = manifest(spark, path)
    apart = spark.newSession()  # settings of its own
    for key, value in {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ""}.items():
        apart.conf.set(key, value)
    found = []
    for c, x in held["contigs"].items():
        if x["folder"]:
            found.append((c, *apart.read.parquet(f"{path}/{x['folder']}").agg(F.count("*"), F.min("locus_pos"), F.max("locus_pos")).first()))
    return spark.createDataFrame(found, "contig string, rows bigint, first_pos int, last_pos int")
