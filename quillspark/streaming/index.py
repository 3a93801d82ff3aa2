"""A lexical index that follows changed documents.

Changes are rows (doc_id, version, text): the text a document has from that
version on, null where the document goes. A batch of them adds a folder to the
index: the words of the changed documents, one narrow row a document, and what the
batch adds to and takes from document frequencies and totals. Nothing that earlier batches wrote is rewritten; what a later batch
replaced is left out when the index is opened. ``compact`` puts all folders
together to one whose words are bucketed by document.

A batch that is run again writes the same folder from the same earlier ones. A
folder counts once its last table, the totals, is complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.scratch import build_side, restrict
from quillspark.sources.indexes import LexicalIndex, cut, document_length, passage_counts, read_bucketed, write_bucketed

DOCUMENTS = "doc_id long, epoch long, version long, n long, dl long"
WORDS = "doc_id long, epoch long, version long, words array<array<string>>"
TERMS = "term string, df long"
TOTALS = "n long, dl long"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class IncrementalIndex:
    """The folders of one index below ``path``, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, before: int | None = None) -> tuple[int, list[tuple[int, str]]]:
        """(epoch of the base or -1, (epoch, folder) of the base and of later batches)."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        found = {"base": {}, "batch": {}}
        for status in fs.listStatus(root) if fs.exists(root) else []:
            kind, _, epoch = status.getPath().getName().partition("-")
            if kind in found and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{epoch}/totals/_SUCCESS")):
                found[kind][int(epoch)] = f"{self.path}/{kind}-{epoch}"
        base = max(found["base"], default=-1)
        kept = [(base, found["base"][base])] if base >= 0 else []
        return base, kept + [(e, f) for e, f in sorted(found["batch"].items()) if e > base and (before is None or e < before)]

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _read(self, folders: list[tuple[int, str]], table: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{f}/{table}" for _, f in folders])

    def apply(self, changes: DataFrame, epoch: int) -> None:
        """Takes in the changes of batch ``epoch``; batches come in rising order.

        Of the changes to one document the highest version counts, of equal
        versions the greatest text, and any text before null. A version that
        isn't above the one the index holds is late and changes nothing. Rows
        without an id or a version are left out; empty batches, empty texts and
        extra columns are fine. Of earlier batches the documents' narrow rows and
        the words of replaced documents are read.
        """
        base, earlier = self._folders(epoch)
        if epoch <= base:
            return
        folder = f"{self.path}/batch-{epoch}"
        self._delete(folder)
        news = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("long").alias("version"), F.col("text").cast("string").alias("text"))
        news = self._last_changes(news.where("doc_id IS NOT NULL AND version IS NOT NULL"), f"{folder}/repeated")
        held = self._read(earlier, "documents", DOCUMENTS)
        # A later batch has the higher version, so that both are the greatest of one row.
        last = held.groupBy("doc_id").agg(F.max("epoch").alias("epoch"), F.max("version").alias("held"))
        accepted = news.join(build_side(last), "doc_id", "left").where("held IS NULL OR version > held") if earlier else news
        words = accepted.select("doc_id", F.lit(epoch).cast("long").alias("epoch"), "version", cut(F.col("text")).alias("words"))
        words.write.parquet(f"{folder}/words")
        written = self.spark.read.schema(WORDS).parquet(f"{folder}/words")
        rows = written.withColumns({"n": F.size("words"), "dl": document_length(F.col("words"))})
        self._shaped(rows, DOCUMENTS).write.parquet(f"{folder}/documents")

        new = self.spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents")
        sign = F.lit(1).alias("sign")
        texts, both = written.select("words", sign), new.select("n", "dl", sign)
        if earlier:
            last.join(new.select("doc_id"), "doc_id").select("doc_id", "epoch").write.parquet(f"{folder}/replaced")
            replaced = self.spark.read.schema("doc_id long, epoch long").parquet(f"{folder}/replaced")
            old = [restrict(part, replaced, ["doc_id", "epoch"]).select("words", F.lit(-1).alias("sign")) for part in self._parts(base, earlier)]
            texts = _union([texts, *old])
            both = both.unionByName(restrict(held, replaced, ["doc_id", "epoch"]).select("n", "dl", F.lit(-1).alias("sign")))
        deltas = passage_counts(texts, "sign").groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        self._shaped(deltas, TERMS).write.parquet(f"{folder}/terms")
        totals = both.agg(F.coalesce(F.sum(F.col("sign") * F.col("n")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("dl"))
        self._shaped(totals, TOTALS).write.parquet(f"{folder}/totals")
        for table in ("repeated", "replaced"):
            self._delete(f"{folder}/{table}")

    def _last_changes(self, news: DataFrame, folder: str) -> DataFrame:
        """The change that counts of every document. Only documents with several have
        their texts compared; their ids are written below ``folder``."""
        news.groupBy("doc_id").agg(F.count("*").alias("changes")).where("changes > 1").select("doc_id").write.parquet(folder)
        repeated = self.spark.read.schema("doc_id long").parquet(folder)
        if repeated.isEmpty():
            return news
        several = restrict(news, repeated, "doc_id").groupBy("doc_id").agg(F.max(F.struct("version", F.col("text").isNotNull().alias("is"), "text")).alias("c")).select("doc_id", "c.version", "c.text")
        return restrict(news, repeated, "doc_id", "left_anti").unionByName(several)

    def _shaped(self, df: DataFrame, schema: str) -> DataFrame:
        fields = self.spark.createDataFrame([], schema).schema.fields
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])

    def _parts(self, base: int, folders: list[tuple[int, str]]) -> list[DataFrame]:
        """The words of the base, in its buckets, and those of the later batches."""
        later = [x for x in folders if x[0] > base]
        parts = [read_bucketed(self.spark, f"{folders[0][1]}/words")] if base >= 0 else []
        return parts + ([self._read(later, "words", WORDS)] if later or not parts else [])

    def _words(self, base: int, folders: list[tuple[int, str]]) -> DataFrame:
        """The words of all documents but those that a later batch replaced."""
        parts = self._parts(base, folders)
        if len(folders) < 2:
            return _union(parts)
        stale = self._read(folders, "documents", DOCUMENTS).groupBy("doc_id").agg(F.max("epoch").alias("last"), F.min("epoch").alias("first")).where("first < last")
        held = build_side(stale.select("doc_id", "last")).alias("c")
        # The base and the batches are joined apart, so that the base keeps its buckets.
        return _union([p.alias("p").join(held, F.expr("p.doc_id = c.doc_id AND c.last > p.epoch"), "left_anti") for p in parts])

    def open(self) -> LexicalIndex:
        """What ``search_bm25`` and ``search_sparse`` read: equal to an index built
        anew from the documents as they are now. Right after ``compact`` the
        words come in buckets and a search doesn't shuffle them."""
        base, folders = self._folders()
        terms = self._read(folders, "terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        totals = self._read(folders, "totals", TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("dl").alias("dl"))
        stats = totals.select("n", F.when(F.col("n") > 0, F.col("dl") / F.col("n")).alias("avgdl"))
        return LexicalIndex(self._words(base, folders).select("doc_id", "words"), terms, stats)

    def compact(self, buckets: int | None = None) -> None:
        """One folder for all so far; the others are deleted, so no search may be
        reading them. Of a document that is gone its row with the version stays."""
        base, folders = self._folders()
        if not folders or folders[-1][0] == base:
            return
        epoch, index = folders[-1][0], self.open()
        folder = f"{self.path}/base-{epoch}"
        self._delete(folder)
        write_bucketed(self._words(base, folders), f"{folder}/words", "doc_id", buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        held = self._read(folders, "documents", DOCUMENTS)
        last = held.groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
        held.join(last, ["doc_id", "epoch"], "left_semi").write.parquet(f"{folder}/documents")
        index.terms.write.parquet(f"{folder}/terms")
        self._shaped(self._read(folders, "totals", TOTALS).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")), TOTALS).write.parquet(f"{folder}/totals")
        for _, old in folders:
            self._delete(old)


def index_stream(changes: DataFrame, path: str, checkpoint: str, compact_every: int = 50) -> StreamingQuery:
    """Runs a stream of (doc_id, version, text) into the index below ``path``, one
    batch a trigger, and compacts it after every ``compact_every`` batches."""

    def take(batch: DataFrame, epoch: int) -> None:
        index = IncrementalIndex(batch.sparkSession, path)
        index.apply(batch, epoch)
        if (epoch + 1) % compact_every == 0:
            index.compact()

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
