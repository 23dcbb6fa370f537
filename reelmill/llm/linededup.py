"""Line deduplication that can be undone: exact reference counts behind sharded cuckoo filters.

References, a row for each (line key, document), are the exact table, and counts sum
them up by key. Keys that enough documents hold are repeated; each shard of keys has a
cuckoo filter of them. Lines first ask their shard's filter, which never misses a
repeated key; only the lines that it lets through are held against the exact table.
A LineStore keeps all three as written tables: a batch of documents that come or go
counts its own keys again, and edits the filters of those that cross the threshold in
the shards that they lie in; nothing else is built anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm.common import _arrow, checkpoint, map_batches, sliced, texts, written

#: What is stripped from both ends of a line, and a bucket's places.
BLANK = b" \t\n\x0b\x0c\r"
PLACES = 4
#: A shard's buckets start with one for so many keys; a full filter doubles.
LOAD = 3
#: Filters are broadcast up to so many bytes together; beyond, each goes to the tasks that hold its shard's references.
BROADCAST = 32 << 20
SHARD_KEYS = 1 << 16
#: References that a task of a shard holds on average where filters aren't broadcast.
TASK_REFS = 1 << 20


class CuckooFilter:
    """A set of 8-byte key digests in 16-bit marks; may take a stranger for a member, never the reverse.

    A mark's two buckets are each other's exclusive or with the mark's hash. An
    insertion that finds both full moves marks on; if it can't end, the digests'
    exact table builds a filter of twice the size.
    """

    def __init__(self, buckets: int = 64) -> None:
        self.marks = np.zeros((buckets, PLACES), np.uint16)

    @staticmethod
    def _mark(digests: np.ndarray) -> np.ndarray:
        return ((digests >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _other(self, bucket, mark):
        mixed = (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.marks) - 1)
        return (np.asarray(bucket, np.uint64) ^ mixed).astype(np.int64)

    def _first(self, digests: np.ndarray) -> np.ndarray:
        return (digests & np.uint64(len(self.marks) - 1)).astype(np.int64)

    def insert(self, digest: int) -> bool:
        one = np.array([digest], np.uint64)
        mark, bucket = self._mark(one)[0], int(self._first(one)[0])
        for at in (bucket, int(self._other(bucket, mark))):
            if not self.marks[at].all():
                self.marks[at, int(np.argmin(self.marks[at] != 0))] = mark
                return True
        for turn in range(500):
            place = (turn * 7 + int(mark)) % PLACES
            mark, self.marks[bucket, place] = self.marks[bucket, place], mark
            bucket = int(self._other(bucket, mark))
            if not self.marks[bucket].all():
                self.marks[bucket, int(np.argmin(self.marks[bucket] != 0))] = mark
                return True
        return False

    def delete(self, digest: int) -> bool:
        """Takes one copy of a member away; digests that were never inserted must not be deleted."""
        one = np.array([digest], np.uint64)
        mark, bucket = self._mark(one)[0], int(self._first(one)[0])
        for at in (bucket, int(self._other(bucket, mark))):
            if (found := np.flatnonzero(self.marks[at] == mark)).size:
                self.marks[at, found[0]] = 0
                return True
        return False

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        mark, bucket = self._mark(digests), self._first(digests)
        return (self.marks[bucket] == mark[:, None]).any(1) | (self.marks[self._other(bucket, mark)] == mark[:, None]).any(1)

    @classmethod
    def of(cls, digests: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(3, (len(digests) // LOAD).bit_length())
        while True:
            made = cls(buckets)
            if all(made.insert(int(d)) for d in digests):
                return made
            buckets *= 2

    def to_bytes(self) -> bytes:
        return self.marks.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls(1)
        made.marks = np.frombuffer(data, np.uint16).reshape(-1, PLACES).copy()
        return made


@dataclass(frozen=True)
class LineRule:
    """Keys of at least least_points code points in at least least_docs documents are repeated."""

    least_points: int = 40
    least_docs: int = 5


def line_key(line: bytes, least_points: int) -> bytes | None:
    """The 16-byte digest of a line's key, or None if the key is too short to count."""
    key = line.strip(BLANK)
    if len(key) < least_points:
        return None
    if len(key) < 4 * least_points and len(key.decode("utf-8", "replace")) < least_points:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def references(df: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key binary, doc_id) for each key that counts and document that holds it. Rows with a null id hold none."""
    schema = "key binary, doc_id long"
    arrow = _arrow(df.sparkSession, schema)

    def run(batches):
        for batch in sliced(batches):
            keys, ids = [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = {line_key(x, rule.least_points) for x in t.split(b"\n")} - {None}
                keys += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=arrow)

    return map_batches(texts(df, id_col, text_col).where("doc_id is not null"), run, schema)


def reference_counts(refs: DataFrame) -> DataFrame:
    """(key, n_docs, last_doc) of each key; the counts are partial before the shuffle, so that no key is hot."""
    once = refs.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def digest64(key) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in key), "<u8")


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key, by its bytes 9 to 12."""
    return F.pmod(F.conv(F.hex(F.substring(key, 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(k[8:12] for k in keys), ">u4") % np.uint32(shards)


FILTER = "shard int, filter binary"


def shard_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of the keys in repeated, which the first bytes of a key deal over shards."""
    arrow = _arrow(repeated.sparkSession, FILTER)

    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter.of(digest64(table.column("key").to_pylist()))
        return pa.table({"shard": table.column("shard")[:1], "filter": [made.to_bytes()]}, schema=arrow)

    return repeated.select(shard_of(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, FILTER)


def _let_through(batch: pa.RecordBatch, held: CuckooFilter | None) -> pa.RecordBatch:
    """The rows of a batch of one shard that its filter may hold."""
    if held is None or not batch.num_rows:
        return batch.slice(0, 0)
    return batch.filter(pa.array(held.may_hold(digest64(batch.column("key").to_pylist()))))


def may_repeat(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The references (key, doc_id) whose key its shard's filter may hold.

    Small filters are broadcast. Large ones travel with the references: tasks get a
    shard's filter first and then a part of its references, a batch at a time, so that
    no shard's references are in one task if they are many.
    """
    schema = "key binary, doc_id long"
    arrow = _arrow(refs.sparkSession, schema)
    size = filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
    if size <= BROADCAST:
        held = refs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in filters.collect()})

        def asked(batches):
            own = {s: CuckooFilter.from_bytes(f) for s, f in held.value.items()}
            for batch in batches:
                keys = batch.column("key").to_pylist()
                if not keys:
                    continue
                shard, digest, keep = _shard_of(keys, shards), digest64(keys), np.zeros(len(keys), bool)
                for s in np.unique(shard).tolist():
                    if s in own:
                        keep[shard == s] = own[s].may_hold(digest[shard == s])
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, schema=arrow)

        return map_batches(refs.select("key", "doc_id"), asked, schema)

    parts = max(1, -(-refs.count() // (shards * TASK_REFS)))
    none = F.lit(None).cast("binary")
    sides = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), none.alias("key"), F.lit(None).cast("long").alias("doc_id"), "filter").unionByName(
        refs.select(shard_of(F.col("key"), shards).alias("shard"), F.pmod(F.xxhash64("key", "doc_id"), F.lit(parts)).cast("int").alias("part"), "key", "doc_id", none.alias("filter"))
    )
    dealt = sides.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("shard", "part")])
            is_filter = batch.column("filter").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(0) | np.diff(is_filter)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if (at := tuple(marks[:, lo].tolist())) != now:
                    now, held = at, None
                if is_filter[lo]:
                    held = CuckooFilter.from_bytes(batch.column("filter")[lo].as_py())
                else:
                    yield _let_through(pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("key", "doc_id")], schema=arrow), held)

    return map_batches(dealt, streamed, schema)


def drops(refs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """(doc_id, keys array<binary>): the keys whose lines each document loses."""
    repeated = checkpoint(reference_counts(refs).where(F.col("n_docs") >= rule.least_docs).select("key", "last_doc"))
    shards = repeated.count() // SHARD_KEYS + 1
    return _lost(may_repeat(refs, checkpoint(shard_filters(repeated, shards)), shards), repeated)


def _lost(let_through: DataFrame, repeated: DataFrame) -> DataFrame:
    """What references that a filter let through lose by the exact table (key, last_doc)."""
    lose = let_through.join(repeated, "key").where("doc_id <> last_doc").select("doc_id", "key")
    return lose.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


class LineStore:
    """References, their counts and the shards' filters as written tables, edited by batches of documents.

    A version is a folder of its own; the one before stays until it is dropped, so that a
    batch that fails leaves nothing half done. The number of shards is fixed when the
    store is made.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, shards: int, rule: LineRule = LineRule()) -> None:
        self.spark, self.path, self.version, self.shards, self.rule = spark, path, version, shards, rule

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.path}/v{self.version if version is None else version:06d}/{name}"

    def table(self, name: str) -> DataFrame:
        """refs (key, doc_id), counts (key, n_docs, last_doc) or filters (shard, filter)."""
        return self.spark.read.parquet(self._at(name))

    @classmethod
    def create(cls, refs: DataFrame, path: str, shards: int = 64, rule: LineRule = LineRule()) -> LineStore:
        """Version 0 of the references of all documents."""
        made = cls(refs.sparkSession, path, 0, shards, rule)
        refs.select("key", "doc_id").distinct().write.parquet(made._at("refs"))
        reference_counts(made.table("refs")).write.parquet(made._at("counts"))
        shard_filters(made.repeated(), shards).write.parquet(made._at("filters"))
        return made

    def repeated(self) -> DataFrame:
        return self.table("counts").where(F.col("n_docs") >= self.rule.least_docs).select("key", "last_doc")

    def inserted(self, more: DataFrame) -> LineStore:
        """The next version, with more references (key, doc_id); those that are there already count once."""
        refs = self.table("refs")
        touched = written(more.select("key", "doc_id").distinct().join(refs, ["key", "doc_id"], "left_anti"))
        return self._next(refs.unionByName(touched), touched.select("key").distinct())

    def deleted(self, doc_ids: DataFrame) -> LineStore:
        """The next version, without the references of the documents in doc_ids (doc_id)."""
        refs = self.table("refs")
        gone = doc_ids.select("doc_id").distinct()
        touched = written(refs.join(gone, "doc_id", "left_semi").select("key").distinct())
        return self._next(refs.join(gone, "doc_id", "left_anti").select("key", "doc_id"), touched)

    def _next(self, refs: DataFrame, touched: DataFrame) -> LineStore:
        """Writes the next version: counts of touched keys are made again, and filters of shards with a key that crosses the threshold are edited."""
        new = LineStore(self.spark, self.path, self.version + 1, self.shards, self.rule)
        old, least = self.table("counts"), self.rule.least_docs
        refs.write.parquet(new._at("refs"))
        again = written(reference_counts(new.table("refs").join(touched, "key", "left_semi")))
        old.join(touched, "key", "left_anti").unionByName(again).write.parquet(new._at("counts"))
        n = lambda side: F.coalesce(F.col(f"{side}.n_docs"), F.lit(0)) >= least
        both = touched.alias("t").join(old.alias("o"), F.col("t.key") == F.col("o.key"), "left").join(again.alias("a"), F.col("t.key") == F.col("a.key"), "left")
        crossing = both.where(n("o") != n("a")).select(F.col("t.key").alias("key"), n("a").alias("comes")).withColumn("shard", shard_of(F.col("key"), self.shards))
        held = old.where(F.col("n_docs") >= least).select(shard_of(F.col("key"), self.shards).alias("shard"), "key")
        edited = self._edited(written(crossing), held)
        edited.write.parquet(new._at("filters"))
        return new

    def _edited(self, crossing: DataFrame, held: DataFrame) -> DataFrame:
        """(shard, filter) with crossing keys inserted or deleted; a filter that is full is built again from its exact keys."""
        arrow = _arrow(self.spark, FILTER)
        filters = self.table("filters")
        shards = crossing.select("shard").distinct()

        def edit(one: pa.Table, other: pa.Table) -> pa.Table:
            keys, comes = other.column("key").to_pylist(), other.column("comes").to_pylist()
            shard = (other if other.num_rows else one).column("shard")[0].as_py()
            before = [f for f in one.column("filter").to_pylist() if f is not None] if one.num_rows else []
            made, digests = CuckooFilter.from_bytes(before[0]) if before else CuckooFilter(8), digest64(keys)
            ok = all(made.delete(int(d)) for d, c in zip(digests, comes, strict=True) if not c)
            ok = ok and all(made.insert(int(d)) for d, c in zip(digests, comes, strict=True) if c)
            return pa.table({"shard": [shard], "filter": [made.to_bytes() if ok else b""]}, schema=arrow)

        cogrouped = filters.join(shards, "shard", "left_semi").groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(edit, FILTER)
        made = written(cogrouped)
        full = made.where(F.octet_length("filter") == 0).select("shard")
        exact = held.join(F.broadcast(full), "shard", "left_semi").join(crossing.where("not comes").select("key"), "key", "left_anti").select("key")
        again = shard_filters(exact.unionByName(crossing.where("comes").join(F.broadcast(full), "shard", "left_semi").select("key")), self.shards)
        untouched = filters.join(shards, "shard", "left_anti")
        return untouched.unionByName(made.where(F.octet_length("filter") > 0)).unionByName(again)

    def drops(self, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, keys) that documents lose, all of the store's or those of refs; filters first, then the exact table."""
        asked = may_repeat(self.table("refs") if refs is None else refs, self.table("filters"), self.shards)
        return _lost(asked, self.repeated())


def without_lines(df: DataFrame, lost: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with each text as (n_lines, n_dropped, kept) in the struct column __lines, after the keys in lost are gone.

    A null text is one empty line.
    """
    own = df.columns
    joined = df.join(lost.select(F.col("doc_id").alias("__lost_id"), F.col("keys").alias("__keys")), F.col(id_col) == F.col("__lost_id"), "left")
    joined = joined.select(*own, "__keys", F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*df.schema.fields, T.StructField("__lines", T.StructType.fromDDL("n_lines long, n_dropped long, kept string"))])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in sliced(batches, "__text"):
            made = []
            for t, keys in zip(batch.column("__text").cast(pa.binary()).to_pylist(), batch.column("__keys").to_pylist(), strict=True):
                lines = t.split(b"\n")
                gone = set(keys or ())
                kept = [x for x in lines if line_key(x, rule.least_points) not in gone] if gone else lines
                made.append({"n_lines": len(lines), "n_dropped": len(lines) - len(kept), "kept": (b"\n".join(kept) if gone else t).decode()})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(made, arrow.field("__lines").type)], schema=arrow)

    return map_batches(joined, run, out)


def dedup_lines(df: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with __lines (n_lines, n_dropped, kept): repeated lines stay in the largest doc_id that holds them.

    Every row comes back, with its own text and columns untouched beside __lines.
    Rows that share an id count as one document; rows with a null id count for no key
    and lose no line. A null text is one empty line. An empty df gives no rows.
    """
    # written, as counts and filters both read them: texts are cut once, and no task holds two Python workers
    refs = written(references(df, rule, id_col, text_col))
    return without_lines(df, drops(refs, rule), rule, id_col, text_col)
