"""Applying a stream of inserts, updates and deletes with delete vectors.

Images of rows are appended to files and never rewritten. An index holds, for
each key, the file and position of its last image. A newer image supersedes
the one that the index names: its bit is set in the bitmap of its file. Reads
skip the positions whose bits are set. A delete is an image too, which stays
the last of its key, so that late changes can't bring the key back.

A batch appends to images, index and bitmaps and rewrites none of them. The
index lies in parts by a hash of the key, of which a batch reads those that it
touches. The last step of a batch is the renaming of a small state file, so
that a batch which dies is as if it had never begun, and any process can open
the table and go on.

The bitmaps are Spark's own: BITS positions a bucket, one bit a row, held by
(file, bucket), so no group of rows is larger than a bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from argentum.plans.skew import salted_join
from argentum.session import scratch

BITS = 32_768
#: Bytes of bitmaps up to which a read broadcasts them.
BROADCAST = 64 << 20
VECTORS = "_file string, _bucket bigint, _bits binary"

# Status words of older logs and what they became.
OLD_STATUS = {
    "success": "completed",
    "needs-review": "completed_with_review",
    "error": "failed",
    "started": "interrupted",
    "planned": "interrupted",
}


def bit(position: Column, bitmap: Column) -> Column:
    """Whether the bit of a file position is set; a null bitmap has none."""
    at = F.bitmap_bit_position(position + 1)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("bigint") % 2 == 1, F.lit(False))


def bucket(position: Column) -> Column:
    return F.bitmap_bucket_number(position + 1)


class ImageTable:
    """A table kept as images, an index and delete vectors in a folder of the shared store.

    key: expression of the key; rows where it is null or empty belong to
    nothing and are not kept. order: columns that order the changes of a key;
    a null comes first, equal ones are the same change delivered again and
    count once. Batches may come in any order and hold any mixture of keys.
    A path that holds a table already is opened as its last batch left it;
    columns that a later batch lacks are null, ones it has beyond the first
    batch's are ignored. parts: parts of the index, fixed when it is made.
    """

    def __init__(self, spark: SparkSession, key: Column, order: list[str], path: str | None = None, parts: int = 16, hot_rows: int = 50_000) -> None:
        self.spark, self.key, self.order, self.hot_rows = spark, key, order, hot_rows
        self.path = (path or scratch(spark, "images")).rstrip("/")
        self.state = self._load() or {"version": 0, "since": 1, "parts": parts, "bitmaps": 0, "images": None, "index": None}

    @property
    def version(self) -> int:
        return self.state["version"]

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> dict | None:
        fs, to = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(to(f"{self.path}/state")):
            return None
        names = [x.getPath().getName() for x in fs.listStatus(to(f"{self.path}/state"))]
        last = max((n for n in names if n.endswith(".json")), default=None)
        return json.loads(self.spark.read.text(f"{self.path}/state/{last}", wholetext=True).head()[0]) if last else None

    def _commit(self, **changed: object) -> None:
        """Makes a version the current one: a state file under its final name."""
        state = self.state | changed
        fs, to = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = to(f"{self.path}/state/_{state['version']}"), to(f"{self.path}/state/v{state['version']:08d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"{final.toString()}: another writer was first")
        self.state = state

    def _read(self, what: str, schema: object, since: int = 1, upto: int | None = None) -> DataFrame:
        paths = [f"{self.path}/{what}/_v={n}" for n in range(since, (upto or self.version) + 1)]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*paths).drop("_v")

    def _images(self, since: int, upto: int, schema: object) -> DataFrame:
        frame = self._read("images", schema, since, upto)
        return frame.withColumns({"_file": F.substring_index("_metadata.file_path", "/", -1), "_pos": F.col("_metadata.row_index")})

    def apply(self, changes: DataFrame) -> None:
        """Appends a batch of changes, moves the index and sets the bits of what they supersede."""
        old, new, parts = self.version, self.version + 1, self.state["parts"]
        kept = changes.withColumn("_key", self.key).filter("_key <> ''")
        if old:
            known = StructType.fromJson(json.loads(self.state["images"]))
            kept = kept.select(*((F.col(f.name).cast(f.dataType) if f.name in kept.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in known))
        schema = kept.schema
        kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/images/_v={new}")
        part = F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int")
        rows = self._images(new, new, schema).select("_key", "_file", "_pos", F.struct(*self.order).alias("_order"), part.alias("_part"))
        both = rows
        if old:
            touched = [r[0] for r in rows.select("_part").distinct().collect()]  # at most `parts`
            before = self._read("index", StructType.fromJson(json.loads(self.state["index"])), self.state["since"]).filter(F.col("_part").isin(touched))
            both = rows.unionByName(before.select(rows.columns).join(rows.select("_key").distinct(), "_key", "left_semi"))
        winner = F.max(F.struct("_order", "_file", "_pos"))
        last = both.groupBy("_key", "_part").agg(winner.alias("w"), F.count(F.lit(1)).alias("_copies")).select("_key", F.col("w._file").alias("_file"), F.col("w._pos").alias("_pos"), F.col("w._order").alias("_order"), "_copies", "_part")
        last.write.mode("overwrite").partitionBy("_part").option("compression", "zstd").parquet(f"{self.path}/index/_v={new}")
        now = self._read("index", last.schema, new, new).select("_key", F.col("_file").alias("_last"), F.col("_pos").alias("_at"), "_copies")
        # A key with one image supersedes nothing.
        moved = salted_join(both.select("_key", "_file", "_pos"), now.filter("_copies > 1"), ["_key"], "_copies", both.count(), hot_rows=self.hot_rows)
        dead = moved.filter((F.col("_file") != F.col("_last")) | (F.col("_pos") != F.col("_at")))
        bits = dead.groupBy("_file", bucket(F.col("_pos")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_pos") + 1)).alias("_bits"))
        bits.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/vectors/_v={new}")
        bitmaps = self.state["bitmaps"] + self._read("vectors", VECTORS, new, new).count()
        self._commit(version=new, bitmaps=bitmaps, images=schema.json(), index=last.schema.json())

    def compact(self) -> None:
        """Writes the index as one entry a key and the bitmaps as one a bucket, so that later batches read less."""
        if not self.version:
            return
        new = self.version + 1
        schema = StructType.fromJson(json.loads(self.state["index"]))
        index = self._read("index", schema, self.state["since"]).groupBy("_key", "_part").agg(F.max(F.struct("_order", "_file", "_pos")).alias("w")).select("_key", F.col("w._file").alias("_file"), F.col("w._pos").alias("_pos"), F.col("w._order").alias("_order"), F.lit(1).cast("bigint").alias("_copies"), "_part")
        index.write.mode("overwrite").partitionBy("_part").option("compression", "zstd").parquet(f"{self.path}/index/_v={new}")
        self._vectors().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/vectors/_v={new}")
        self._images(1, 1, StructType.fromJson(json.loads(self.state["images"]))).limit(0).drop("_file", "_pos").write.mode("overwrite").parquet(f"{self.path}/images/_v={new}")
        bitmaps = self._read("vectors", VECTORS, new, new).count()
        self._commit(version=new, since=new, bitmaps=bitmaps)

    def _vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS, self.state["since"]).groupBy("_file", "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))

    def last(self) -> DataFrame:
        """The last image of each key, deletes among them, with the column _key.

        The bitmaps, a bit a row, are broadcast while all of them together
        take BROADCAST bytes at most; beyond that images and bitmaps meet by
        file and bucket.
        """
        if not self.version:
            raise ValueError("no batch was applied yet")
        images = self._images(1, self.version, StructType.fromJson(json.loads(self.state["images"]))).withColumn("_bucket", bucket(F.col("_pos")))
        vectors = self._vectors()
        if self.state["bitmaps"] * BITS // 8 <= BROADCAST:
            vectors = F.broadcast(vectors)
        return images.join(vectors, ["_file", "_bucket"], "left").filter(~bit(F.col("_pos"), F.col("_bits"))).drop("_file", "_bucket", "_pos", "_bits")


MANIFEST_ORDER = ["start_time", "seq", "writer"]


def manifest(batches: list[DataFrame], path: str | None = None) -> ImageTable:
    """The images of a manifest feed: by fingerprint in lower case, ordered by start_time, then seq.

    A missing start_time comes first. writer only breaks ties between changes
    of equal start_time and seq.
    """
    images = ImageTable(batches[0].sparkSession, F.lower(F.trim("zip_fingerprint")), MANIFEST_ORDER, path)
    for batch in batches:
        images.apply(batch)
    return images


def status_now(status: Column) -> Column:
    """A status in today's words."""
    return F.coalesce(*(F.when(status == a, b) for a, b in OLD_STATUS.items()), status)


def entries(batches: list[DataFrame]) -> DataFrame:
    """The current entry of each archive that still exists, with today's status words.

    Columns: zip_fingerprint, writer, seq, status, start_time, end_time. An
    empty feed gives no rows; extra columns are kept in the images and ignored.
    """
    live = manifest(batches).last().filter(~F.col("change_op").eqNullSafe("delete"))
    return live.select(F.col("_key").alias("zip_fingerprint"), "writer", "seq", status_now(F.col("status")).alias("status"), "start_time", "end_time")


def by_arrival(changes: DataFrame, batches: int) -> list[DataFrame]:
    """A feed as batches of about equal size in the order of received_at; a null is in the first."""
    at = F.coalesce(F.unix_micros("received_at"), F.lit(0))
    ends = changes.agg(F.percentile_approx(at, [k / batches for k in range(1, batches)], 10_000)).head()[0] or []
    number = sum(((at > e).cast("int") for e in ends), F.lit(0))
    return [changes.filter(number == k) for k in range(batches)]
