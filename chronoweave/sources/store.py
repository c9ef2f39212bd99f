"""A store of Parquet tables keyed by document, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash buckets that a store's tables are split into; a replacement rewrites only the buckets it touches.
BUCKETS = 64

SCHEMAS = {
    "documents": "doc_id string, filename string, source string, status string, created timestamp, pages int, chars int, candidate string",
    "events": "doc_id string, id string, type string, title string, org string, s int, e int, precision string, status string, confidence double, reasons array<string>",
    "gaps": "doc_id string, id string, s int, e int, months int, state string, confidence double, reasons array<string>",
    "notes": "doc_id string, id string, target string, text string, created_at timestamp",
    "item_state": "doc_id string, item_id string, reviewed boolean, hidden boolean, updated timestamp",
    "feedback": "doc_id string, seq long, dismissed array<string>, reviewed boolean, created timestamp",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def init(self) -> None:
        """Empty tables for those that aren't there."""
        for name, schema in SCHEMAS.items():
            if not self._exists(name):
                self._write(self.spark.createDataFrame([], schema), name)

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _write(self, df: DataFrame, name: str) -> None:
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        df.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """All rows; columns added later are null in older files."""
        schema = T._parse_datatype_string(SCHEMAS[name])
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path(name)).drop("bucket")

    def get(self, name: str, doc_id: str) -> DataFrame:
        """One document's rows: its bucket is pruned to by the partition filter."""
        b = F.pmod(F.xxhash64(F.lit(doc_id)), F.lit(BUCKETS)).cast("int")
        schema = T._parse_datatype_string(SCHEMAS[name])
        full = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path(name))
        return full.where((F.col("bucket") == b) & (F.col("doc_id") == doc_id)).drop("bucket")

    def replace(self, name: str, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Derived rows of the given documents are replaced; all others stay. Notes and states aren't touched.

        A bucket that no row is left for is emptied as well: a write of partitions leaves it as it was.
        """
        ids = (documents if documents is not None else rows).select("doc_id").distinct()
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        touched = ids.select(bucket).distinct()
        schema = T._parse_datatype_string(SCHEMAS[name])
        old = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path(name))
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").drop("bucket").join(ids, "doc_id", "left_anti")  # 64 buckets at most
        new = kept.unionByName(rows.select(*[f.name for f in schema.fields])).checkpoint()
        bare = {r.bucket for r in touched.collect()} - {r.bucket for r in new.select(bucket).distinct().collect()}
        self._write(new, name)
        for b in bare:
            self._remove(f"{self.path(name)}/bucket={b}")

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def write_records(df: DataFrame, path: str) -> None:
    """A JSON line per document, in its name's order."""
    df.sortWithinPartitions("filename").write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV in order of score and file name; range partitions keep the order across files."""
    df.repartitionByRange("score", "filename").sortWithinPartitions("score", "filename").write.mode("overwrite").option("header", True).csv(path)


def batch_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more than `most` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
