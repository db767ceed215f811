"""Keys of a table that grows, kept so that a batch of new keys reads next to none of them.

A key belongs to the bucket of its hash. ``keys/version=v/bucket=b`` holds the keys that batch v added, and
``filters/version=v/bucket=b`` a Bloom filter of them: blocks of 32,768 bits, PROBES bits of one block for each key. A batch reads
the filters of its buckets, one bit string for each of its keys, and opens the keys of a bucket only where a filter says
"perhaps"; there the check is exact, so the filters change what is read and never what is found.

Batches only add files: a batch that is run again overwrites its own and sees none of them. :meth:`KnownKeys.compact` merges all
versions so far into one; a merge counts once it is complete. A null key is never known, as in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegerType, StructField, StructType

from outcry.session import cut_lineage

#: Bits of a block, given by Spark's bitmap functions.
BITS = 32_768
PROBES = 6
#: Keys of a block that make one false "perhaps" in a hundred.
BLOCK_KEYS = 3_000
#: Keys of a bucket that one task sorts and writes.
FILE_KEYS = 500_000


class KnownKeys:
    """Keys of one column below the folder ``base``.

    ``blocks`` filter blocks for each of the ``buckets``: BLOCK_KEYS keys a block make one false "perhaps" in a hundred. More keys
    cost reading, not rightness; :meth:`add` and :meth:`compact` may take another number, such as :meth:`blocks_for` gives. Buckets
    bound what the driver handles; a bucket of many keys is written in parts.
    """

    def __init__(self, spark: SparkSession, base: str, key: str, key_type: DataType, buckets: int = 64, blocks: int = 16):
        self.spark, self.base, self.key, self.buckets, self.blocks = spark, base.rstrip("/"), key, buckets, blocks
        self.keys_schema = StructType([StructField(key, key_type), StructField("bucket", IntegerType())])
        self.filter_schema = StructType([StructField("blocks", IntegerType()), StructField("block", IntegerType()),
                                         StructField("bits", BinaryType()), StructField("bucket", IntegerType())])

    # ---- places of a key ----

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _block(self, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key), F.lit("block")), blocks).cast("int")

    def blocks_for(self, keys: int) -> int:
        """Blocks of a bucket that so many keys need. The number only doubles, so that a table has few of them."""
        blocks = self.blocks
        while blocks * self.buckets * BLOCK_KEYS < keys:
            blocks *= 2
        return blocks

    def _positions(self) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.col(self.key), F.lit(i)), F.lit(BITS)) for i in range(PROBES)])

    # ---- files ----

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(sc._jsc.hadoopConfiguration()), place

    def _there(self, path: str) -> bool:
        fs, place = self._fs(path)
        return fs.exists(place)

    def _listed(self, path: str, field: str) -> list[int]:
        if not self._there(path):
            return []
        fs, place = self._fs(path)
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{field}="))

    def merged(self) -> int:
        """The version up to which one complete merge holds all keys; -1 before the first."""
        done = [v for v in self._listed(f"{self.base}/merged", "upto") if self._there(f"{self.base}/merged/upto={v}/keys/_SUCCESS")]
        return max(done, default=-1)

    def _folders(self, kind: str, before: int, only: list[int] | None) -> list[str]:
        """Folders of buckets that hold what versions below ``before`` added."""
        start = max((v for v in [self.merged()] if v < before), default=-1)
        roots = [f"{self.base}/merged/upto={start}/{kind}"] if start >= 0 else []
        roots += [f"{self.base}/{kind}/version={v}" for v in self._listed(f"{self.base}/{kind}", "version") if start < v < before]
        return [f"{root}/bucket={b}" for root in roots for b in self._listed(root, "bucket") if only is None or b in only]

    def _read(self, kind: str, schema: StructType, before: int, only: list[int] | None) -> DataFrame:
        folders = self._folders(kind, before, only)
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType(schema.fields[:-1])).parquet(*folders)
        return rows.withColumn("bucket", F.regexp_extract("_metadata.file_path", "/bucket=([0-9]+)/", 1).cast("int"))

    def read(self, before: int, only: list[int] | None = None) -> DataFrame:
        """Keys, with their bucket, that versions below ``before`` added."""
        return self._read("keys", self.keys_schema, before, only)

    def filters(self, before: int, only: list[int] | None = None) -> DataFrame:
        """One bit string for each block of a bucket and number of blocks."""
        rows = self._read("filters", self.filter_schema, before, only)
        return rows.groupBy("bucket", "blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _write(self, keys: DataFrame, keys_path: str, filters_path: str, blocks: int, once: bool = False) -> None:
        """Filters first: the keys' ``_SUCCESS`` then stands for both. ``once`` writes a key that comes again one time."""
        rows = keys.select(self.key).where(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket())
        # a block's keys meet before its bits are made, so keys are moved and not a bit string of every block from every task
        placed = rows.withColumn("block", self._block(F.lit(blocks))).repartition("bucket", "block").select(
            "bucket", F.lit(blocks).alias("blocks"), "block", F.explode(self._positions()).alias("at"))
        bits = placed.groupBy("bucket", "blocks", "block").agg(F.bitmap_construct_agg("at").alias("bits"))
        self._put(bits.repartition(self.buckets, "bucket"), filters_path, ["bucket", "block"])
        parts = -(-blocks * BLOCK_KEYS // FILE_KEYS)
        split = rows.withColumn("part", self._block(F.lit(parts))).repartition(self.buckets * parts, "bucket", "part")
        if once:
            split = split.dropDuplicates(["bucket", "part", self.key])
        self._put(split.drop("part"), keys_path, ["bucket", self.key])

    @staticmethod
    def _put(rows: DataFrame, path: str, order: list[str]) -> None:
        rows.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(path)

    # ---- batches ----

    def unknown(self, batch: DataFrame, version: int) -> tuple[DataFrame, list[int]]:
        """(rows of ``batch`` whose key no version below ``version`` added, buckets whose keys were opened).

        ``batch`` has one row a key and comes back with its own columns.
        """
        names = batch.columns
        marked = batch.withColumn("known_bucket", self.bucket())
        # as many numbers as buckets at most
        touched = sorted(r[0] for r in marked.select("known_bucket").distinct().collect())
        folders = self._folders("filters", version, touched)
        if not folders:
            return batch, []
        keys = marked.select(self.key, F.col("known_bucket").alias("bucket")).where(F.col(self.key).isNotNull())
        # a merge may have another number of blocks than later versions; both are asked, and there are few such numbers
        sizes = sorted(r[0] for r in self._read("filters", self.filter_schema, version, touched).select("blocks").distinct().collect())
        asked = (keys.withColumn("blocks", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"))).withColumn("block", self._block(F.col("blocks")))
                 .withColumn("at", self._positions()).join(self.filters(version, touched), ["bucket", "blocks", "block"]))
        perhaps = asked.where(F.forall("at", lambda p: self._bit(F.col("bits"), p))).select(self.key, "bucket").distinct()
        perhaps = cut_lineage(perhaps)
        opened = sorted(r[0] for r in perhaps.select("bucket").distinct().collect())
        if not opened:
            return batch, []
        known = self.read(version, opened).select(self.key).join(perhaps.select(self.key), self.key, "left_semi")
        return batch.join(known, self.key, "left_anti").select(*names), opened

    @staticmethod
    def _bit(bits: Column, position: Column) -> Column:
        byte = F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))
        return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0

    def add(self, rows: DataFrame, version: int, blocks: int | None = None) -> None:
        """Files of the keys of ``rows`` as what ``version`` added."""
        self._write(rows, f"{self.base}/keys/version={version}", f"{self.base}/filters/version={version}", blocks or self.blocks)

    def drop_from(self, version: int) -> None:
        """Drops what ``version`` and later ones added: what a batch left that failed and now runs again."""
        for kind in ("keys", "filters"):
            for v in self._listed(f"{self.base}/{kind}", "version"):
                if v >= version:
                    self._drop(f"{self.base}/{kind}/version={v}")

    def compact(self, blocks: int | None = None) -> int:
        """Merges all versions into one folder, with new filters of ``blocks`` blocks, and drops what it replaces; run it between batches."""
        versions = self._listed(f"{self.base}/keys", "version")
        last = max([*versions, self.merged()], default=-1)
        if last < 0:
            return last
        self.blocks = blocks or self.blocks
        if last > self.merged():
            place = f"{self.base}/merged/upto={last}"
            self._write(self.read(last + 1), f"{place}/keys", f"{place}/filters", self.blocks, once=True)
        for kind in ("keys", "filters"):
            for v in self._listed(f"{self.base}/{kind}", "version"):
                if v <= last:
                    self._drop(f"{self.base}/{kind}/version={v}")
        for v in self._listed(f"{self.base}/merged", "upto"):
            if v < last:
                self._drop(f"{self.base}/merged/upto={v}")
        return last

    def _drop(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)
