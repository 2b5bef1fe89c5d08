"""The stored tables: Parquet folders that are appended to, replaced and cleared.

Every table is a folder of numbered versions; the highest one that was finished is the table. Appends go to it, a rewrite makes
the next one, so a rewrite that broke off at any step leaves the old version or the new one, never a mixture and never nothing.

Logs and recipes are laid out by ``source_filename``, staged reviews by ``job_id``, so that reading, replacing and
deleting one file or job touches its folder only. Enrichment results are not written into the logs one by one: they are
rows of their own that are laid over the logs when these are read, and settled into them when they have become many.
Many small files of a folder are packed into few: the packed files and the list of those they stand for are written first, and
who finds both finished, be it a reader, puts them in place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fabtrail import schema as S
from fabtrail.operators import filters, lookups, slices, templates as mining
from fabtrail.session import conformed, stored
from fabtrail.sources.files import plain_path

#: tables laid out by a column, the others are small and plain
LAYOUT = {"logs": "source_filename", "recipes": "source_filename", "pending_reviews": "job_id"}

#: an append names up to so many files to the scan of the stored rows; more files meet by a join
MOST_NAMED_FILES = 10_000

#: a search names up to so many files to the scan; more of them are not worth leaving out the rest
MOST_FOUND_FILES = 10_000

#: enrichment results beyond this number are settled into the logs
MOST_LAID_OVER = 1_000_000

#: small files of a folder are packed into files of about this size; files of half of it are left alone
PACKED_BYTES = 128 << 20

#: results laid over the logs; those of one call have one number, the highest one counts
ENRICHMENT = "id string, summary string, classification string, root_cause_hint string, seq bigint"


@dataclass
class Appended:
    attempted: int
    inserted: int


def to_recipes(logs: DataFrame) -> DataFrame:
    """Recipe rows of a log frame in the columns of the recipe table."""
    rows = logs.where(F.col("log_type") == "recipe")
    return rows.select(*conformed(rows, S.RECIPES))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in order; missing ones are null."""
    return df.select(*conformed(df, S.TABLES[table]))


class LogStore:
    """The five tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self, table: str, finished: bool = True) -> list[int]:
        """Numbers of a table's versions, ascending; a version is finished when its writer says so."""
        found, system = self._file_system(f"{self.root}/{table}")
        if not system.exists(found):
            return []
        names = [status.getPath().getName() for status in system.listStatus(found)]
        numbers = sorted(int(name[1:]) for name in names if name[:1] == "v" and name[1:].isdigit())
        return [n for n in numbers if not finished or self._at(f"{self._folder(table, n)}/_SUCCESS")]

    def _folder(self, table: str, number: int) -> str:
        return f"{self.root}/{table}/v{number:08d}"

    def path(self, table: str) -> str:
        """The folder of the version that is the table."""
        return self._folder(table, (self._versions(table) or [0])[-1])

    def create(self) -> None:
        """Make every table that is absent."""
        for table, schema in S.TABLES.items():
            if not self._versions(table):
                self._writer(self.spark.createDataFrame([], schema), table, "append")

    def read(self, table: str) -> DataFrame:
        """A table; columns added to the schema later are null in older files, a table that was never created is empty.

        Logs come with their enrichment.
        """
        rows = self._stored(table)
        if table == "logs" and self._laid_over():
            rows = lookups.apply_enrichment(rows, self._results())
        return rows

    def _stored(self, table: str) -> DataFrame:
        self._put_in_place(table)
        if not self._versions(table):
            return self.spark.createDataFrame([], S.TABLES[table])
        return self.spark.read.schema(S.TABLES[table]).parquet(self.path(table))

    def _file_system(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, path: str) -> bool:
        found, system = self._file_system(path)
        return system.exists(found)

    def _drop_folder(self, table: str, value: str) -> None:
        """Remove the folder of one value of the layout column; no row is read or written."""
        self._put_in_place(table)
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folder, system = self._file_system(f"{self.path(table)}/{escape.getPartitionPathString(LAYOUT[table], value)}")
        system.delete(folder, True)

    def _writer(self, df: DataFrame, table: str, mode: str) -> None:
        self._put_in_place(table)
        df = conform(df, table)
        column = LAYOUT.get(table)
        if column is None:
            df.write.mode(mode).parquet(self.path(table))
            return
        # by range, so that a large file is spread over tasks and small ones share a task
        writer = df.repartitionByRange(F.col(column), F.col("id")).write.mode(mode)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(column).parquet(self.path(table))

    # -- appends ------------------------------------------------------------------------------

    def append(self, table: str, new: DataFrame, key: str = "id", within_files: bool = False) -> Appended:
        """Insert rows whose key is not there yet; of new rows with one key the first.

        ``within_files`` says that keys hold their file, so that only the folders of the new rows' files are looked at.
        """
        new = stored(lookups.arrived(conform(new, table)), f"append-{table}")
        present = self._stored(table)
        if within_files:
            present = self._of_files(present, new, LAYOUT[table])
        fresh = stored(lookups.not_present(new, present, key), f"fresh-{table}")
        counted = Appended(new.count(), fresh.count())
        if counted.inserted:
            self._writer(fresh, table, "append")
        return counted

    @staticmethod
    def _of_files(present: DataFrame, new: DataFrame, layout: str) -> DataFrame:
        """Stored rows of the files that new rows come from; only the folders of these files are read."""
        files = new.select(layout).distinct()
        named = [row[0] for row in files.limit(MOST_NAMED_FILES + 1).collect()]
        if len(named) > MOST_NAMED_FILES:
            return present.join(files, layout, "left_semi")
        return present.where(F.col(layout).isin([n for n in named if n is not None]) | (F.col(layout).isNull() & F.lit(None in named)))

    def append_logs(self, new: DataFrame, within_files: bool = False) -> Appended:
        """Insert log rows; recipe rows also go to the recipe table."""
        new = stored(conform(new, "logs"), "logs")
        done = self.append("logs", new, within_files=within_files)
        self.append("recipes", to_recipes(new), within_files=within_files)
        return done

    # -- small files ---------------------------------------------------------------------------

    def small_files(self, table: str, packed_bytes: int = PACKED_BYTES) -> DataFrame:
        """``file, bin`` of the files of a table's folders that are packed together; the rows of a bin go to one file.

        A bin has at least two files, of one folder, and about ``packed_bytes``. One row for each small file meets in a folder's group.
        """
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path(table))
        small = files.where(F.col("length") < packed_bytes // 2).select(
            F.col("path").alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length"
        )
        before = Window.partitionBy("folder").orderBy("length", "file").rowsBetween(Window.unboundedPreceding, -1)
        number = F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / packed_bytes)
        bins = small.withColumn("bin", F.concat_ws("/", "folder", number.cast("string")))
        return bins.withColumn("_files", F.count(F.lit(1)).over(Window.partitionBy("bin"))).where("_files > 1").select("file", "bin")

    def pack_files(self, table: str, packed_bytes: int = PACKED_BYTES) -> int:
        """Put few large files in the place of many small ones; how many small ones there were. Rows stay the same.

        Only small files are read. Until the list of these is finished nothing has changed; after that any reader or writer of the table
        puts the packed files in place first, from wherever it was broken off. One writer at a time.
        """
        self._put_in_place(table)
        packed, replaced = f"{table}_packed", f"{table}_replaced"
        # what an earlier call left that broke off before its list was finished
        self._drop_before(packed, 1 << 62)
        number = max(self._versions(replaced, finished=False), default=-1) + 1
        if not self._versions(table):
            return 0
        bins = stored(self.small_files(table, packed_bytes), "bins")
        count = bins.count()
        if not count:
            return 0
        path = F.regexp_replace(plain_path(F.col("_metadata.file_path")), "^file:/+", "file:/")
        rows = self._stored(table).select("*", path.alias("_file"))
        names = bins.select(F.regexp_replace("file", "^file:/+", "file:/").alias("_file"), "bin")
        number_of_bins = bins.select("bin").distinct().count()
        together = rows.join(names, "_file").repartition(number_of_bins, "bin").drop("_file", "bin")
        writer = together.write.mode("errorifexists")
        column = LAYOUT.get(table)
        (writer.partitionBy(column) if column else writer).parquet(self._folder(packed, number))
        bins.select("file").write.mode("errorifexists").parquet(self._folder(replaced, number))
        self._put_in_place(table)
        return count

    def _put_in_place(self, table: str) -> None:
        """Finish what :meth:`pack_files` began, if it was broken off: move the packed files in, remove those they stand for.

        Every step can be taken again.
        """
        packed, replaced = f"{table}_packed", f"{table}_replaced"
        for number in self._versions(replaced):
            source, target = self._folder(packed, number), self.path(table)
            folder, system = self._file_system(source)
            if system.exists(folder):
                prefix = system.getFileStatus(folder).getPath().toString()
                found = system.listFiles(folder, True)
                while found.hasNext():
                    file = found.next().getPath()
                    if file.getName()[:1] not in "_.":
                        system.rename(file, self._file_system(target + file.toString()[len(prefix) :])[0])
            names = self.spark.read.schema("file string").parquet(self._folder(replaced, number))
            for row in names.toLocalIterator():
                system.delete(self._file_system(row.file)[0], False)
            system.delete(folder, True)
            system.delete(self._file_system(self._folder(replaced, number))[0], True)

    # -- searches that skip files --------------------------------------------------------------

    def index_files(self) -> None:
        """Make entries for the stored files of log rows that have none, so that :meth:`find` can skip them.

        Files never change, so entries stay right; those of files that are gone are not looked at.
        """
        missing = [row.file for row in self._log_files().where("may IS NULL").select("file").collect()]
        if not missing:
            return
        number = max(self._versions("slices", finished=False), default=-1) + 1
        logs = self._stored("logs")
        entries = slices.slice_index(logs.where(F.col("_metadata.file_path").isin(missing)))
        entries.write.mode("errorifexists").parquet(self._folder("slices", number))

    def _log_files(self, **conditions) -> DataFrame:
        """``file, may`` of the stored files of log rows; ``may`` is null for files without an entry."""
        # rows name local files with one slash, listings with three
        present = [(re.sub("^file:/+", "file:/", name),) for name in self._stored("logs").inputFiles()]
        files = self.spark.createDataFrame(present, "file string")
        folders = [self._folder("slices", n) for n in self._versions("slices")]
        index = self.spark.read.schema(slices.SLICES).parquet(*folders) if folders else self.spark.createDataFrame([], slices.SLICES)
        return files.join(slices.may_hold(index, **conditions), "file", "left")

    def find(self, **conditions) -> DataFrame:
        """Log rows that meet the conditions of :func:`fabtrail.operators.filters.log_predicates`; files that cannot have any are not opened."""
        asked = {k: v for k, v in conditions.items() if k in ("search_term", "tool_id", "start_ts", "end_ts") and v}
        rows = self._stored("logs")
        if asked and self._versions("slices"):
            found = self._log_files(**asked).where(F.coalesce("may", F.lit(True))).select("file").limit(MOST_FOUND_FILES + 1).collect()
            if len(found) <= MOST_FOUND_FILES:
                rows = rows.where(F.col("_metadata.file_path").isin([row.file for row in found]))
        rows = filters.filter_logs(rows, **conditions)
        return lookups.apply_enrichment(rows, self._results()) if self._laid_over() else rows

    # -- replace, delete, clear ----------------------------------------------------------------

    def delete_file(self, source_filename: str) -> None:
        """Remove the rows of one file from logs and recipes."""
        self._forget_results(source_filename)
        for table in ("logs", "recipes"):
            self._drop_folder(table, source_filename)

    def replace_file(self, source_filename: str, new: DataFrame) -> Appended:
        """Put new rows in place of all rows of a file."""
        of_file = lookups.arrived(conform(new, "logs")).where(F.col("source_filename") == source_filename)
        rows = stored(of_file, "logs")
        kept = stored(conform(lookups.first_per(rows, "id"), "logs"), "replaced")
        counted = Appended(rows.count(), kept.count())
        recipes = to_recipes(kept)
        self._forget_results(source_filename)
        for table, own in (("logs", kept), ("recipes", recipes)):
            if own.isEmpty():
                self._drop_folder(table, source_filename)
            else:
                # only the folder of this file is overwritten
                self._writer(own, table, "overwrite")
        return counted

    def clear(self) -> None:
        """Empty logs, recipes and staged reviews; templates and mappings stay."""
        for table in ("logs", "recipes", "pending_reviews"):
            self._rewrite(table, self.spark.createDataFrame([], S.TABLES[table]))
        self._drop_before("enrichment", 1 << 62)

    def _rewrite(self, table: str, rows: DataFrame) -> None:
        """Write the whole table as its next version; older ones go when that is finished."""
        self._put_in_place(table)
        rows = conform(rows, table)
        number = max(self._versions(table, finished=False), default=-1) + 1
        column = LAYOUT.get(table)
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(column) if column else writer).parquet(self._folder(table, number))
        self._drop_before(table, number)

    def _drop_before(self, table: str, number: int) -> None:
        for older in self._versions(table, finished=False):
            if older < number:
                folder, system = self._file_system(self._folder(table, older))
                system.delete(folder, True)

    # -- enrichment and reviews -----------------------------------------------------------------

    def enrich(self, results: DataFrame) -> None:
        """Store enrichment results (``id, summary, classification, root_cause_hint``), the last of an id.

        The results are written beside the logs, which stay as they are until :data:`MOST_LAID_OVER` results have come together.
        """
        number = max(self._versions("enrichment", finished=False), default=-1) + 1
        rows = lookups.last_per(results, "id").withColumn("seq", F.lit(number).cast("bigint"))
        columns = [c.split()[0] for c in ENRICHMENT.split(", ")]
        rows.select(*columns).write.mode("errorifexists").parquet(self._folder("enrichment", number))
        if self._laid_over_rows().count() > MOST_LAID_OVER:
            self.settle_enrichment()

    def _laid_over(self) -> list[int]:
        return self._versions("enrichment")

    def _laid_over_rows(self) -> DataFrame:
        folders = [self._folder("enrichment", n) for n in self._laid_over()]
        return self.spark.read.schema(ENRICHMENT).parquet(*folders) if folders else self.spark.createDataFrame([], ENRICHMENT)

    def _results(self) -> DataFrame:
        """The newest result of each id."""
        newest = F.max_by(F.struct("summary", "classification", "root_cause_hint"), "seq")
        return self._laid_over_rows().groupBy("id").agg(newest.alias("_newest")).select("id", "_newest.*")

    def settle_enrichment(self) -> None:
        """Write the results that are laid over the logs into them; only folders of files that have a result are rewritten.

        Breaking off anywhere does no harm: results that are settled already are laid over once more, with the same outcome.
        """
        numbers = self._laid_over()
        if not numbers:
            return
        logs, results = self._stored("logs"), stored(self._results(), "results")
        touched = logs.join(results.select("id"), "id", "left_semi").select("source_filename").distinct()
        part = self._of_files(logs, stored(touched, "touched"), "source_filename")
        changed = stored(lookups.apply_enrichment(part, results), "enriched")
        if not changed.isEmpty():
            self._writer(changed, "logs", "overwrite")
        self._drop_before("enrichment", numbers[-1] + 1)

    def _forget_results(self, source_filename: str) -> None:
        """Results of a file's rows do not come back with later rows of the same ids."""
        numbers = self._laid_over()
        if not numbers:
            return
        gone = self._stored("logs").where(F.col("source_filename") == source_filename).select("id")
        left = stored(self._results().join(gone, "id", "left_anti"), "results")
        number = max(self._versions("enrichment", finished=False)) + 1
        left.withColumn("seq", F.lit(number).cast("bigint")).write.mode("errorifexists").parquet(self._folder("enrichment", number))
        self._drop_before("enrichment", number)

    # -- message templates -----------------------------------------------------------------------

    def message_templates(self) -> DataFrame:
        """``template, merged, cluster``: every message template met so far; of assignments made side by side the first counts."""
        folders = [self._folder("message_templates", n) for n in self._versions("message_templates")]
        schema = f"{mining.BOOK}, seq bigint"
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        first = F.min_by(F.struct("merged", "cluster"), F.struct("seq", "cluster"))
        return rows.groupBy("template").agg(first.alias("first")).select("template", "first.*")

    def with_templates(self, logs: DataFrame, message: str = "raw_message") -> DataFrame:
        """Log rows with the clusters of their messages, which are the same in every run.

        Templates that were never met get their clusters now and keep them: these are written before any row is given out.
        """
        exact = stored(mining.exact_templates(logs, message), "templates")
        new = stored(mining.new_in_book(exact, self.message_templates()), "book")
        if not new.isEmpty():
            number = max(self._versions("message_templates", finished=False), default=-1) + 1
            path = self._folder("message_templates", number)
            new.withColumn("seq", F.lit(number).cast("bigint")).write.mode("errorifexists").parquet(path)
        return mining.fill_from_book(logs, exact, self.message_templates(), message)

    def stage(self, pending: DataFrame) -> Appended:
        return self.append("pending_reviews", pending)

    def pending(self, job_id: str) -> DataFrame:
        return self.read("pending_reviews").where(F.col("job_id") == job_id).orderBy("seq")

    def edit(self, edits: DataFrame) -> None:
        """Change staged rows; only folders of jobs that have an edit are written."""
        rows = self.read("pending_reviews")
        jobs = rows.join(edits.select("id").distinct(), "id", "left_semi").select("job_id").distinct()
        changed = stored(lookups.apply_edits(rows.join(stored(jobs, "jobs"), "job_id"), edits), "edited")
        if not changed.isEmpty():
            self._writer(changed, "pending_reviews", "overwrite")

    def reject(self, job_id: str) -> None:
        self._drop_folder("pending_reviews", job_id)

    def approve(self, job_id: str, ingest_ts: str, edits: DataFrame | None = None) -> Appended:
        """Move the staged rows of a job, as edited, to the logs."""
        from fabtrail.plans.review import approved_logs

        rows = approved_logs(self.pending(job_id), edits, ingest_ts)
        done = self.append_logs(rows)
        self.reject(job_id)
        return done

    # -- templates and header mappings -----------------------------------------------------------

    def save_template(self, templates: DataFrame) -> None:
        """Insert templates; one with the signature of a stored one takes its place."""
        both = self.read("format_templates").unionByName(conform(templates, "format_templates"))
        self._rewrite("format_templates", stored(lookups.newest_per(both, "file_signature"), "templates"))

    def templates(self) -> DataFrame:
        return self.read("format_templates").orderBy(F.desc("created_at"), F.desc("id"))

    def template(self, signature: str) -> DataFrame:
        return self.read("format_templates").where(F.col("file_signature") == signature)

    def delete_template(self, template_id: str) -> None:
        self._rewrite("format_templates", stored(self.read("format_templates").where(F.col("id") != template_id), "templates"))

    def save_mappings(self, mappings: DataFrame) -> Appended:
        """Cache header mappings; the first one of a fingerprint stays."""
        return self.append("header_mappings", mappings, key="header_fingerprint")
