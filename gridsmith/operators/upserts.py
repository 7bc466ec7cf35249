"""K2: new facts over stored ones, and a stored table of which an upsert writes only what it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.session import written

c = F.col


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], locked: str | None = None) -> DataFrame:
    """Rows of both by key with an action; new values win unless the stored row is locked."""
    o = old.select(*keys, *[c(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_old"), (F.expr(locked) if locked else F.lit(False)).alias("_lock"))
    n = new.select(*keys, *[c(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_new"))
    take = c("_new").isNotNull() & ~F.coalesce(c("_lock"), F.lit(False))
    action = F.when(c("_new").isNull(), "kept").when(c("_old").isNull(), "inserted").when(c("_lock"), "skipped").otherwise("updated")
    return o.join(n, keys, "full").select(*keys, *[F.when(take, c(f"_n_{v}")).otherwise(c(f"_o_{v}")).alias(v) for v in values], action.alias("action"))


class Facts:
    """A folder of Parquet files in `buckets` folders by the hash of the keys, one row a key.

    An upsert reads and writes only the buckets of the new rows' keys; the files of all others stay as they are.
    The result is first written aside, so it is computed once and what it reads isn't what it overwrites;
    a run that dies before the end is repeated whole. The number of buckets is part of the folders' names, so a
    table can't be opened with another. Keys may not be null."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.values, self.buckets = spark, path, keys, values, buckets
        self.of = f"_bucket_of_{buckets}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(self.of)

    def _write(self, df: DataFrame) -> None:
        rows = df.select(*self.keys, *self.values, self._bucket())
        rows.repartition(self.of).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.of).parquet(self.path)

    def create(self, df: DataFrame) -> Facts:
        self._write(df)
        return self

    def _stored(self) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        if self.of not in df.columns:
            raise ValueError(f"{self.path} has another number of buckets")
        return df

    def read(self) -> DataFrame:
        return self._stored().select(*self.keys, *self.values)

    def upsert(self, new: DataFrame, order: Column | None = None, locked: str | None = "verification_status = 'verified'", force: bool = False) -> DataFrame:
        """Takes the new rows in and returns those of the buckets touched with their actions (a table of its own).
        Of new rows with one key the last by `order` counts. Locked rows stay unless forced."""
        rest = [v for v in self.values if v not in self.keys]
        by = order if order is not None else F.struct(*rest)
        fresh = written(new.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("_v")).select(*self.keys, "_v.*", self._bucket()))
        touched = [r[0] for r in fresh.select(self.of).distinct().collect()]  # `buckets` numbers at most
        near = self._stored().filter(c(self.of).isin(touched))
        done = written(upsert(near, fresh, self.keys, self.values, None if force else locked))
        if touched:
            self._write(done)
        return done
