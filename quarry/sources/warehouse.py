"""The stored index: Parquet tables partitioned by repository, shelf and generation.

A file's rows live on the shelf that the hash of its path names. A run that changes files writes the shelves of these files anew under
its generation, each with the rows of its unchanged files and the new ones, and leaves all other shelves alone (copy on write).
It then publishes a snapshot: the repository's files, each with the generation that holds its shelf. Readers keep only rows the snapshot
names, so a run that dies leaves nothing visible. After publishing, `sweep` deletes what neither the new snapshot nor the RETAINED ones
before it name, so replaced and deleted rows leave the disk and the number of folders doesn't grow with the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "repos": "gen long, files_gen long, edges_gen long, history_gen long, root string, embedder string, dim int, commit string, has_history boolean, indexed_at timestamp, "
             "n_docs long, total_words long, shelves int",
    "files": "gen long, path string, file_gen long, lang string, is_data boolean, is_test boolean, sha256 string, "
             "size long, loc int",
    "symbols": "gen long, id string, path string, lang string, ord int, name string, qname string, local_qname string, "
               "kind string, start_line int, end_line int, start_byte int, end_byte int, signature string, "
               "docstring string, parent string, is_test boolean, body string",
    "refs": "gen long, path string, lang string, from_local_qname string, target_name string, via string, line int, byte int",
    "imports": "gen long, path string, lang string, module string, names array<string>, alias string, ord long",
    "chunks": "gen long, id string, path string, text string, start_line int, end_line int, symbol_qname string, "
              "kind string, is_test boolean, embedding array<float>",
    "postings": "gen long, bucket int, id string, path string, term string, tf int, dl int",
    "edges": "gen long, src_id string, dst_id string, kind string, via string, src_path string, dst_path string",
    "bindings": "gen long, path string, lang string, name string, dst_path string, dst_local string, known boolean",
    "lookups": "gen long, key string, id string",
    "file_imports": "gen long, src_path string, dst_path string",
    "tested_by": "gen long, target_id string, test_id string, confidence string",
    "co_changed": "gen long, src string, dst string, count long, last_seen string, weight double",
}
# Which published generation a table is read at: an unchanged tree gets new history but keeps its edges.
GENERATION_OF = {"files": "files_gen", "edges": "edges_gen", "lookups": "edges_gen", "bindings": "edges_gen", "file_imports": "edges_gen", "tested_by": "edges_gen",
                 "co_changed": "history_gen"}
# Rows of these tables belong to one file and live on its shelf.
PER_FILE = ("symbols", "refs", "imports", "chunks", "postings")
TERM_BUCKETS = 64
# Files of a shelf, about, when a repository is first indexed, and the most shelves it gets.
SHELF_FILES, MOST_SHELVES = 64, 4096
RETAINED = 1


def shelf_of(path: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(shelves)).cast("int")


def shelves_for(files: int) -> int:
    return max(1, min(MOST_SHELVES, files // SHELF_FILES))


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        location = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return location.getFileSystem(self.spark._jsc.hadoopConfiguration()), location

    def exists(self, table: str) -> bool:
        fs, location = self._fs(self.path(table))
        return fs.exists(location)

    def create(self) -> None:
        for table in SCHEMAS:
            fs, location = self._fs(self.path(table))
            fs.mkdirs(location)

    def _raw(self, table: str) -> DataFrame:
        schema = SCHEMAS[table] + ", repo string" + (", shelf int" if table in PER_FILE else "")
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def repos(self) -> DataFrame:
        """Published repositories with their current generation: one row each."""
        raw = self._raw("repos")
        names = [c for c in raw.columns if c != "repo"]
        latest = raw.groupBy("repo").agg(F.max_by(F.struct(*names), "gen").alias("r"))
        return latest.select("repo", "r.*")

    def published(self, repo: str):
        return self.repos().where(F.col("repo") == repo).first()

    def next_generation(self, repo: str) -> int:
        """Above every earlier run's, dead ones too; taken by creating a file that must not exist, so two runs never share one."""
        record, fs, folder = self.published(repo), *self._fs(f"{self.path('_claims')}/{_escape(repo)}")
        taken = [int(f.getPath().getName()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
        gen = max([0, record["gen"] if record else 0, *taken]) + 1
        while not fs.createNewFile(self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(gen))):
            gen += 1
        return gen

    def read(self, table: str, repo: str) -> DataFrame:
        """Current rows of a repository; repository and generation prune directories."""
        record = self.published(repo)
        rows = self._raw(table).where(F.col("repo") == repo)
        if record is None:
            return rows.where(F.lit(False))
        if table in PER_FILE:
            return self.live(table, repo, record["files_gen"])
        return rows.where(F.col("gen") == record[GENERATION_OF[table]])

    def written(self, table: str, repo: str, gen: int) -> DataFrame:
        """Rows of one generation, published or not."""
        return self._raw(table).where((F.col("repo") == repo) & (F.col("gen") == gen))

    def live_files(self, repo: str, files_gen: int) -> DataFrame:
        return self.written("files", repo, files_gen).select("path", F.col("file_gen").alias("gen"))

    def live(self, table: str, repo: str, files_gen: int) -> DataFrame:
        """Per-file rows that a snapshot names, published or not."""
        rows = self._raw(table).where(F.col("repo") == repo)
        return rows.join(self.live_files(repo, files_gen), ["path", "gen"], "left_semi")

    def append(self, table: str, df: DataFrame, repo: str, gen: int, shelves: int = 1) -> None:
        columns = [F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[table])]
        out = df.withColumn("gen", F.lit(gen).cast("long")).withColumn("repo", F.lit(repo))
        keys = ["repo", "gen"]
        if table in PER_FILE:
            # One file for each shelf, in order of path, so that a point read touches few pages.
            keys = ["repo", "shelf", "gen"] + (["bucket"] if table == "postings" else [])
            out = out.withColumn("shelf", shelf_of(F.col("path"), shelves)).repartition("shelf").sortWithinPartitions("shelf", *keys[3:], "path")
            columns.append(F.col("shelf"))
        out.select(*columns, "repo").write.mode("append").partitionBy(*keys).parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame, gone: DataFrame, repo: str, gen: int, shelves: int, touched: list[int],
                key: str | None = None, order: str | None = None) -> None:
        """Write the touched shelves of a per-file table under a new generation: their published rows without those of the files in `gone`
        (path), and `rows`, of which the last by `order` stays for each `key`. A key never leaves its file, so a group is bounded by a file."""
        if key:
            rest = [c for c in rows.columns if c != key]
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")
        kept = self.read(table, repo)
        kept = kept.where(F.col("shelf").isin(touched)).join(gone.select("path"), "path", "left_anti")
        names = [c.strip().split(" ")[0] for c in SCHEMAS[table].split(", ") if not c.startswith("gen ")]
        self.append(table, rows.select(*names).unionByName(kept.select(*names)), repo, gen, shelves)

    def touched(self, paths: DataFrame, shelves: int) -> list[int]:
        """Shelves of the paths: one number for each shelf at most."""
        return sorted(r[0] for r in paths.select(shelf_of(F.col("path"), shelves)).distinct().collect())

    def snapshot(self, fresh: DataFrame, kept: DataFrame, repo: str, gen: int, shelves: int, touched: list[int]) -> None:
        """The repository's files: those just written, and earlier ones, whose rows moved along if their shelf was written anew."""
        moved = shelf_of(F.col("path"), shelves).isin(touched)
        names = [c.strip().split(" ")[0] for c in SCHEMAS["files"].split(", ") if not c.startswith("gen ")]
        kept = kept.withColumn("file_gen", F.when(moved, F.lit(gen)).otherwise(F.col("file_gen")))
        self.append("files", fresh.withColumn("file_gen", F.lit(gen).cast("long")).select(*names).unionByName(kept.select(*names)), repo, gen)

    def sweep(self, repo: str, retain: int = RETAINED) -> int:
        """Delete folders that neither the published snapshot nor the `retain` ones before it name: how many went. Generations above the
        published one belong to a run under way, or to one that died, which a later sweep takes."""
        records = self._raw("repos").where(F.col("repo") == repo).orderBy(F.desc("gen")).limit(retain + 1).collect()
        if not records:
            return 0
        newest = records[0]["gen"]
        live = {t: {r[GENERATION_OF[t]] for r in records} for t in GENERATION_OF} | {"repos": {r["gen"] for r in records}}
        named = set()
        for r in records:
            files = self.written("files", repo, r["files_gen"]).select(shelf_of(F.col("path"), r["shelves"] or 1).alias("shelf"), F.col("file_gen"))
            named |= {tuple(x) for x in files.distinct().collect()}  # a shelf has one generation in a snapshot
        gone = 0
        for table in SCHEMAS:
            for folder, values in self._folders(table, repo):
                kept = (values.get("shelf"), values["gen"]) in named if table in PER_FILE else values["gen"] in live[table]
                if values["gen"] <= newest and not kept:
                    fs, location = self._fs(folder)
                    gone += bool(fs.delete(location, True))
        fs, claims = self._fs(f"{self.path('_claims')}/{_escape(repo)}")
        for f in fs.listStatus(claims) if fs.exists(claims) else []:
            if int(f.getPath().getName()) < newest:
                fs.delete(f.getPath(), False)
        return gone

    def _folders(self, table: str, repo: str) -> list[tuple[str, dict[str, int]]]:
        """Generation folders of a table with the numbers in their names."""
        fs, top = self._fs(f"{self.path(table)}/repo={_escape(repo)}")
        found, level = [], [top] if fs.exists(top) else []
        while level:
            deeper = []
            for folder in level:
                for f in fs.listStatus(folder):
                    name = f.getPath().getName()
                    if name.startswith("gen="):
                        parts = f.getPath().toString().rpartition("/repo=")[2].split("/")[1:]
                        found.append((f.getPath().toString(), {k: int(v) for k, v in (p.split("=") for p in parts)}))
                    elif name.startswith("shelf="):
                        deeper.append(f.getPath())
            level = deeper
        return found

    def clear(self, folder: str) -> None:
        fs, location = self._fs(folder)
        fs.delete(location, True)

    def drop(self, repo: str) -> bool:
        """Unpublish a repository first, then delete its partitions; others are untouched."""
        known = self.published(repo) is not None
        for table in ("repos", *[t for t in SCHEMAS if t != "repos"]):
            fs, location = self._fs(f"{self.path(table)}/repo={_escape(repo)}")
            if fs.exists(location):
                fs.delete(location, True)
        return known


def _escape(value: str) -> str:
    """Partition directory name of a value, as the writer spells it."""
    special = set('"#%\'*/:=?\\\x7f{[]^')
    return "".join(f"%{ord(c):02X}" if c in special or ord(c) < 32 else c for c in value)
