"""A stored index of names: symbols, character trigrams of their names, and the words of each file.

Each update appends one batch to every table of the index's folder, made from the files that are new or have changed; the
table of files comes last, so that a batch counts once it is whole, and one that broke off is written again. What a
later batch replaces or removes is known from the files that were there before, which are few beside the index, and
drops out by an anti-join at lookup.

Symbols and words lie in BUCKETS folders by a hash of the name, which a lookup's filter or its join prunes; trigrams are
sorted, so that row groups without a lookup's trigrams are skipped. Rows are dealt by ranges of bucket, name and
file: a name that a third of all files hold fills as many ranges as it needs.

Edge cases: files whose path is null aren't indexed; null contents are empty; a null version always counts as changed;
paths that repeat in versions count once (the greatest version); an update without changes writes nothing; an index without
batches has no rows; names shorter than a trigram are found by themselves, and any name by parts of a trigram.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lines import to_lines
from quarry.operators.symbols import extract_symbols
from quarry.operators.symbols import find_references as references_in
from quarry.schemas import SYMBOL

BUCKETS = 16
TABLES = {
    "files": "path string, version string, gone boolean, replaces boolean, batch int",
    "symbols": f"{SYMBOL}, batch int, bucket int",
    "grams": "gram string, name string, batch int",
    "words": "word string, file string, batch int, bucket int",
}
#: Reads the files (path, content) among the given paths (path).
Read = Callable[[DataFrame], DataFrame]


def bucket_of(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def grams_of(name: Column) -> Column:
    """The trigrams of a name, each once; a shorter name is its own."""
    many = F.greatest(F.length(name) - 2, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), many), lambda k: F.substring(name, k, F.lit(3))))


class NameIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def place(self, name: str) -> tuple:
        """The file system of a table's folder, and its path there."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, name: str) -> bool:
        system, at = self.place(name)
        return system.exists(at)

    def staged(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Rows written down as they come, so that ranges are drawn from them without making them again."""
        at = f"{self.folder}/staged/{name}-{batch}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def write(self, name: str, batch: int, rows: DataFrame, *by: str) -> None:
        """One batch of a table, in the order of by; a first column of bucket makes folders."""
        dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
        (dealt.partitionBy("bucket") if by[0] == "bucket" else dealt).parquet(f"{self.folder}/{name}/batch={batch}")

    def changes(self, versions: DataFrame) -> DataFrame:
        """path, version, gone, replaces: what differs between versions (path, version) and the index."""
        last = F.max_by(F.struct("version", "gone"), "batch")
        known = self.read("files").groupBy("path").agg(last.alias("last")).select("path", F.col("last.version").alias("was"), (~F.col("last.gone")).alias("held"))
        given = versions.where("path is not null").groupBy("path").agg(F.max(F.col("version").cast("string")).alias("version"), F.lit(True).alias("there"))
        both = given.join(known, "path", "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("there", "held")})
        same = F.col("there") & F.col("held") & F.coalesce(F.col("version") == F.col("was"), F.lit(False))
        return both.where((F.col("there") | F.col("held")) & ~same).select("path", "version", (~F.col("there")).alias("gone"), F.col("held").alias("replaces"))

    def update(self, versions: DataFrame, read: Read) -> int | None:
        """Bring the index to the state of versions (path, version); read is asked for changed files alone. The new batch's number, if any."""
        files = self.read("files")
        batch = (files.agg(F.max("batch")).first()[0] if self.exists("files") else None)
        batch = 0 if batch is None else batch + 1
        pending = self.staged("files", batch, self.changes(versions))
        if pending.isEmpty():
            return None
        changed = pending.where("not gone").select("path")
        found = read(changed).where("path is not null").select("path", F.coalesce("content", F.lit("")).alias("content"))
        found = self.staged("contents", batch, found)  # read once for symbols and words
        names = extract_symbols(to_lines(found, strip_cr=True))
        names = self.staged("symbols", batch, names.withColumn("bucket", bucket_of(F.lower("name"))))
        self.write("symbols", batch, names, "bucket", "name", "file")
        known = names.select(F.lower("name").alias("name")).distinct()
        self.write("grams", batch, known.select(F.explode(grams_of(F.col("name"))).alias("gram"), "name"), "gram", "name")
        words = found.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[0-9A-Za-z_]+"), F.lit(0)))).alias("word"), F.col("path").alias("file"))
        self.write("words", batch, self.staged("words", batch, words.withColumn("bucket", bucket_of(F.col("word")))), "bucket", "word", "file")
        self.write("files", batch, pending, "path")
        system, at = self.place("staged")
        system.delete(at, True)
        return batch

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows of whole batches whose file no later batch replaces or removes."""
        whole = self.read("files").agg(F.max("batch")).first()[0]
        later = self.read("files").where("replaces").groupBy(F.col("path").alias("file")).agg(F.max("batch").alias("until"))
        kept = rows.where(F.col("batch") <= F.lit(-1 if whole is None else whole))
        return kept.join(later, "file", "left").where(F.col("until").isNull() | (F.col("batch") >= F.col("until"))).drop("until")

    def find_symbol(self, text: str) -> DataFrame:
        """Symbols whose name contains the text, whatever its case."""
        text, grams = text.lower(), self.read("grams")
        wanted = sorted({text[k : k + 3] for k in range(len(text) - 2)})
        if wanted:
            held = grams.where(F.col("gram").isin(wanted)).groupBy("name").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted))
        else:
            held = grams.where(F.contains("gram", F.lit(text))).select("name").distinct()
        names = held.where(F.contains("name", F.lit(text))).select(F.col("name").alias("low"), bucket_of(F.col("name")).alias("bucket"))
        found = self.read("symbols").withColumn("low", F.lower("name")).join(names, ["bucket", "low"], "left_semi")
        return self.live(found).select("name", "type", "file", "line", "column", "signature")

    def find_definition(self, name: str) -> DataFrame:
        """Symbols of just this name."""
        found = self.read("symbols").where((F.col("bucket") == bucket_of(F.lit(name.lower()))) & (F.col("name") == name))
        return self.live(found).select("name", "type", "file", "line", "column", "signature")

    def files_with(self, name: str) -> DataFrame:
        """Paths of the files that hold all words of a name."""
        wanted = sorted(set(re.findall(r"[0-9A-Za-z_]+", name)))
        if not wanted:
            raise ValueError(f"{name!r} holds no word that an index could have")
        test = F.lit(False)
        for word in wanted:
            test |= (F.col("bucket") == bucket_of(F.lit(word))) & (F.col("word") == word)
        rows = self.live(self.read("words").where(test)).groupBy("file").agg(F.countDistinct("word").alias("n"))
        return rows.where(F.col("n") == len(wanted)).select(F.col("file").alias("path"))

    def find_references(self, name: str, read: Read) -> DataFrame:
        """Lines on which the name stands alone; read is asked for the files that hold its words alone."""
        return references_in(to_lines(read(self.files_with(name)).select("path", "content"), strip_cr=True), name)
