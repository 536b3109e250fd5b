"""A lexical index that grows by segments; readers see one committed version of it.

A batch writes one segment: the postings and facts of its documents, which rows of older segments they replace, and by
how much the document frequencies and the counts of the corpus change.  Statistics of a version are sums over the changes, so nothing
is counted again.  A version is a small manifest that lists its segments; it appears by one rename, after all files of
its segment, so a batch that fails halfway stays invisible.  Compaction writes the live rows of a version as one segment.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.text import mixed_tokens
from clauselake.operators.lexical import HEAD, LexicalIndex, Tokenizer, prefix_key, term_counts, term_weights
from clauselake.operators.scale import keep_first

# columns of the tables of a segment, beside the id
TABLES = {
    "postings": "dl long, norm double, term string, tf long", "docs": "digest string, key string, head string",
    "lost": "of string", "terms": "term string, n long", "counts": "n_docs long, n_words long, n_postings long",
}
WITH_ID = ("postings", "docs", "lost")


class SegmentedIndex:
    """Index at a path of the shared folder; writers append and compact, readers take a version."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", tokenizer: Tokenizer = mixed_tokens,
                 id_type: str = "bigint"):
        self.spark, self.path, self.id_col, self.tokenizer, self.id_type = spark, path, id_col, tokenizer, id_type

    def version(self) -> int:
        """The newest committed version; 0 before the first batch."""
        folder, files = self._folder()
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Segments and batches of a version, the newest one by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "segments": [], "batches": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:08d}.json", wholetext=True).first()[0])

    def append(self, docs: DataFrame, batch_id: int, text_col: str = "text", deleted: DataFrame | None = None) -> int:
        """Add a batch of documents, replace those that the index has with another text, drop deleted ids; the new version.

        A batch that is committed already changes nothing when it comes again.  Rows without an id are left out; of rows that
        share one, that with the least digest counts; a null text is an empty one; an id both sent and deleted is deleted.
        """
        base = self.manifest()
        if batch_id in base["batches"]:
            return base["version"]
        own, name = self.id_col, f"s{base['version'] + 1:08d}-{uuid.uuid4().hex}"
        sent = docs.filter(F.col(own).isNotNull()).select(
            F.col(own).cast(self.id_type).alias(own), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        sent = keep_first(sent.withColumn("digest", F.sha2("text", 256)), [own], [F.col("digest")])
        live = self._live("docs", base).select(own, "digest", F.col("segment").alias("of"))
        removed = sent.select(own).limit(0) if deleted is None else deleted.select(F.col(own).cast(self.id_type).alias(own)).distinct()
        fresh = sent.join(removed, own, "left_anti").join(live, [own, "digest"], "left_anti")
        self._write(fresh.select(own, "digest", "text"), name, "texts")
        fresh = self.spark.read.parquet(self._at("texts", name))
        gone = fresh.select(own).unionByName(removed)
        self._write(live.join(gone, own, "left_semi").select(own, "of"), name, "lost")
        self._write(fresh.select(own, "digest", prefix_key(F.col("text")).alias("key"), F.substring("text", 1, HEAD).alias("head")), name, "docs")
        self._write(term_counts(fresh, [own], "text", self.tokenizer).select(own, "dl", "norm", "term", "tf"), name, "postings")
        new, lost = self._table("postings", [name]), self._table("lost", [name])
        touched = [r["of"] for r in lost.select("of").distinct().collect()]  # as many as segments, not as rows
        old = self._table("postings", touched).withColumnRenamed("segment", "of").join(lost.select(own, "of"), [own, "of"], "left_semi")
        changes = new.select("term", "tf", F.lit(1).alias("sign")).unionByName(old.select("term", "tf", F.lit(-1).alias("sign")))
        self._write(changes.groupBy("term").agg(F.sum("sign").alias("n")).filter("n != 0"), name, "terms")
        n_docs = self._table("docs", [name]).select(F.lit(1).alias("d")).unionByName(lost.select(F.lit(-1).alias("d")))
        n_docs = n_docs.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n_docs"))
        words = changes.agg(F.coalesce(F.sum(F.col("sign") * F.col("tf")), F.lit(0)).alias("n_words"),
                            F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n_postings"))
        self._write(n_docs.select("n_docs", words.select("n_words").scalar().alias("n_words"),
                                  words.select("n_postings").scalar().alias("n_postings")), name, "counts")
        return self._commit(base, [*base["segments"], name], [*base["batches"], batch_id])

    def compact(self) -> int:
        """Write the live rows of the newest version as one segment; readers of older versions keep their files."""
        base = self.manifest()
        if len(base["segments"]) < 2:
            return base["version"]
        name = f"s{base['version'] + 1:08d}-{uuid.uuid4().hex}"
        for table in ("postings", "docs"):
            self._write(self._live(table, base).drop("segment"), name, table)
        self._write(self._table("lost", []).drop("segment"), name, "lost")
        self._write(self._frequencies(base).select("term", "n"), name, "terms")
        self._write(self._counts(base), name, "counts")
        return self._commit(base, [name], base["batches"])

    def read(self, version: int | None = None) -> LexicalIndex:
        """The index as of a version; what later batches write does not change it."""
        base = self.manifest(version)
        counts = self._counts(base)
        corpus = counts.select("n_docs", (F.col("n_words") / F.when(F.col("n_docs") > 0, F.col("n_docs"))).alias("avgdl"), "n_postings")
        terms = term_weights(self._frequencies(base).select("term", F.col("n").alias("df")), counts.select("n_docs").scalar())
        facts = self._live("docs", base).select(self.id_col, "key", "head")
        return LexicalIndex(self._live("postings", base).drop("segment"), terms, corpus, facts, self.id_col, self.tokenizer)

    def _live(self, table: str, base: dict) -> DataFrame:
        """Rows of a table that no later segment replaced, with their segment."""
        lost = self._table("lost", base["segments"]).select(self.id_col, F.col("of").alias("segment"))
        return self._table(table, base["segments"]).join(lost, [self.id_col, "segment"], "left_anti")

    def _frequencies(self, base: dict) -> DataFrame:
        return self._table("terms", base["segments"]).groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0")

    def _counts(self, base: dict) -> DataFrame:
        return self._table("counts", base["segments"]).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_words", "n_postings")])

    def _at(self, table: str, segment: str) -> str:
        return f"{self.path}/{table}/segment={segment}"

    def _table(self, table: str, segments: list[str]) -> DataFrame:
        own = f"`{self.id_col}` {self.id_type}, " if table in WITH_ID else ""
        schema = f"{own}{TABLES[table]}, segment string"
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(
            *[self._at(table, s) for s in segments])

    def _write(self, rows: DataFrame, segment: str, table: str) -> None:
        rows.write.parquet(self._at(table, segment))

    def _folder(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, base: dict, segments: list[str], batches: list[int]) -> int:
        """Make a version visible; fails if another writer committed after `base`, whose work then stands."""
        version = base["version"] + 1
        jvm, (folder, files) = self.spark._jvm, self._folder()
        folder = files.makeQualified(folder)
        files.mkdirs(folder)
        draft = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps({"version": version, "segments": segments, "batches": batches}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never overwrites
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(folder, f"{version:08d}.json"), plain)
        return version
