"""Bundles of documents as zip archives: a data source that writes one archive a document and reads them back.

``df.write.format("bundles").mode("append").save(folder)`` takes (document, name, part): consecutive rows of one document and name are the
parts of one file, written as they come. Rows have to come clustered by document, see ``bundle_rows``. Tasks write to a folder of
their own; archives get their names when all tasks have ended, and a failed job leaves none.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "document string, name string, part string"


def _store(path: str):
    """(file system, path in it) for a folder in any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, str]]  # (name within the staging folder, final name)


class BundleWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.folder)
        task = uuid.uuid4().hex
        store.create_dir(f"{root}/{self.staging}/{task}", recursive=True)
        archives: list[tuple[str, str]] = []
        stream = archive = entry = None
        document = name = None
        try:
            for row in rows:
                if archive is None or row.document != document:
                    self._close(entry, archive, stream)
                    entry, name, document = None, None, row.document
                    staged = f"{task}/{len(archives)}.zip"
                    stream = store.open_output_stream(f"{root}/{self.staging}/{staged}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    archives.append((staged, f"{quote(document, safe='')}.zip"))
                if entry is None or row.name != name:
                    if entry is not None:
                        entry.close()
                    name = row.name
                    if name in archive.namelist():
                        raise ValueError(f"parts of {name} in {document} don't follow each other")
                    entry = archive.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
                entry.write((row.part or "").encode())
        finally:
            self._close(entry, archive, stream)
        return Written(archives)

    @staticmethod
    def _close(*open_things) -> None:
        for thing in open_things:
            if thing is not None:
                thing.close()

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        archives = [a for m in messages if m is not None for a in m.archives]
        names = [final for _, final in archives]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one document came from several tasks")
        for staged, final in archives:
            store.move(f"{root}/{self.staging}/{staged}", f"{root}/{final}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.folder)
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class Archive(InputPartition):
    pass


class BundleReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        store, root = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(root))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".zip")]

    def read(self, partition: Archive | None) -> Iterator[tuple[str, str, str]]:
        if partition is None or partition.value is None:
            return
        store, _ = _store(self.folder)
        document = unquote(partition.value.rsplit("/", 1)[-1].removesuffix(".zip"))
        with store.open_input_file(partition.value) as stream, zipfile.ZipFile(stream) as archive:
            for name in archive.namelist():
                yield document, name, archive.read(name).decode()


class BundleSource(DataSource):
    """Archives below a folder; a file is one row when read."""

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        if overwrite:
            raise ValueError("bundles are added; give an empty folder instead of overwriting")
        return BundleWriter(self.options["path"])


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def tutorial_files(parts: DataFrame, diagrams: DataFrame, citations: DataFrame) -> DataFrame:
    """(document, name, place, part) of a document's bundle: its Markdown, diagrams and a map of its sources.

    ``parts`` (document, ordinal, position, part) come from ``bundle_parts``, ``diagrams`` (document, slug, svg) are drawn elsewhere,
    ``citations`` (document, citation_id, locator) are the sources.
    """
    place = lambda *c: F.struct(*(x.cast("long").alias(f"p{k}") for k, x in enumerate(c)), F.lit("").alias("key"))
    keyed = lambda rank, key: F.struct(F.lit(rank).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), key.alias("key"))
    ends = parts.select("document").distinct()
    text = parts.select("document", F.lit("tutorial.md").alias("name"), place(F.lit(0), F.col("ordinal"), F.col("position")).alias("place"), F.concat(F.when((F.col("ordinal") < 0) & (F.col("position") == 0), "").otherwise("\n\n"), "part").alias("part"))
    last = ends.select("document", F.lit("tutorial.md").alias("name"), keyed(1, F.lit("")).alias("place"), F.lit("\n").alias("part"))
    drawn = diagrams.select("document", F.concat(F.lit("assets/diagrams/"), "slug", F.lit(".svg")).alias("name"), keyed(2, F.col("slug")).alias("place"), F.col("svg").alias("part"))
    firsts = citations.groupBy("document").agg(F.min("citation_id").alias("_first"))
    lines = citations.join(firsts, "document").select("document", F.lit("sources.json").alias("name"), keyed(4, F.col("citation_id")).alias("place"), F.concat(F.when(F.col("citation_id") == F.col("_first"), "{\n  ").otherwise(",\n  "), _quoted(F.col("citation_id")), F.lit(": "), _quoted(F.col("locator"))).alias("part"))
    cited = citations.select("document").distinct().withColumn("_some", F.lit(True))
    closing = ends.join(cited, "document", "left").select("document", F.lit("sources.json").alias("name"), keyed(5, F.lit("")).alias("place"), F.when(F.col("_some"), "\n}").otherwise("{}").alias("part"))
    rows = text.unionByName(last).unionByName(drawn).unionByName(lines).unionByName(closing)
    return rows.withColumn("document", F.col("document").cast("string"))


def run_files(outlines: DataFrame, chapters: DataFrame) -> DataFrame:
    """(document, name, place, part) of a run's export: a file for each chapter in order, and a list of them.

    ``outlines`` (document, title), ``chapters`` (document, ordinal, slug, title, summary, markdown). A chapter's own text counts if it has one,
    under its heading unless it begins with one; else its summary.
    """
    body, head = F.trim(F.coalesce("markdown", F.lit(""))), F.concat(F.lit("# "), "title", F.lit("\n"))
    text = F.when((body != "") & F.startswith(body, F.lit("#")), body).when(body != "", F.concat(head, F.lit("\n"), body, F.lit("\n"))).when(F.coalesce("summary", F.lit("")) != "", F.concat(head, F.lit("\n"), "summary", F.lit("\n"))).otherwise(head)
    place = lambda *c: F.struct(*(x.cast("long").alias(f"p{k}") for k, x in enumerate(c)), F.col("slug").alias("key"))
    own = chapters.select("document", F.concat("slug", F.lit(".md")).alias("name"), place(F.lit(0), F.col("ordinal"), F.lit(0)).alias("place"), text.alias("part"))
    titles = outlines.withColumn("slug", F.lit("")).select("document", F.lit("README.md").alias("name"), place(F.lit(1), F.lit(-1), F.lit(0)).alias("place"), F.concat(F.lit("# "), "title", F.lit("\n\n")).alias("part"))
    listed = chapters.join(outlines.select("document"), "document", "left_semi").select("document", F.lit("README.md").alias("name"), place(F.lit(1), F.col("ordinal"), F.lit(0)).alias("place"), F.concat(F.lit("- "), "title", F.lit("\n")).alias("part"))
    return own.unionByName(titles).unionByName(listed).withColumn("document", F.col("document").cast("string"))


def bundle_rows(files: DataFrame) -> DataFrame:
    """``files`` (document, name, place, part) as the writer wants them: a document in one task, its parts in order."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "document").sortWithinPartitions("document", "place").select("document", "name", "part")


def save_bundles(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Write the bundles of ``files`` below ``folder`` and read them."""
    spark.dataSource.register(BundleSource)
    bundle_rows(files).write.format("bundles").mode("append").save(folder)
    return spark.read.format("bundles").load(folder)
