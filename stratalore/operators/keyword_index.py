"""A keyword index that follows its table: segments, tombstones and sums.

An index is a folder. Each change of the table adds one *segment*, the postings of the
chunks that are new or changed, and a list of *tombstones*, the ids of chunks whose
postings in all segments so far no longer count. The number of live chunks and their
words are kept as sums, so a change costs what it touches: no old text is read or cut
into words again. Small segments of like size are merged, posting by posting, and dead
postings go then. What is current is written last, as one small *version*; a change
that fails half way leaves the version before it, and two writers of one version can't
both succeed.

Postings are dealt to folders by bucket of terms, and adaptive execution splits a bucket
with a frequent term over as many files as its size asks for. Beside its postings a
segment has one narrow entry for each chunk (length, digest), in buckets of ids, from
which changes are found and sums corrected.

Defined results: a null text has no words, but its chunk counts; rows that share an id
are one chunk to changes (any new row with the id replaces all old ones); rows without
an id can't be replaced and are refused; an empty table gives an empty index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalore.session import bound_batches, fresh_path, give_back, materialize, shuffle_partitions, ship

#: Segments of one size class that are merged into one, and the share of dead chunks beyond which all are.
FANOUT, DEAD_SHARE = 4, 0.3
#: Words that a worker turns into postings at once; a chunk of more is taken alone.
PIECE = 1 << 18


@dataclass
class Segment:
    """A written segment: its rank in time, its folder, and what was written to it, dead chunks included."""

    number: int
    folder: str
    chunks: int
    words: int


@dataclass
class Version:
    number: int = 0
    segments: list[Segment] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    chunks: int = 0
    words: int = 0


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _name(number: int) -> str:
    """A folder that no other writer of the same version uses."""
    return f"{number:09d}-{uuid.uuid4().hex[:12]}"


def _entry_bucket(chunk: Column, buckets: int) -> Column:
    """Entries are narrow, so fewer buckets do for them."""
    return -1 - _bucket(chunk, max(1, buckets // 8))


def pieces(batch: pa.RecordBatch, words: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of (chunk_id, level, digest, words) of at most so many words, a row of more alone."""
    ends = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + words, "right")))
        yield batch.slice(at, end - at)
        at = end


def postings_of(batch: pa.RecordBatch, stem) -> pa.RecordBatch:
    """Postings of (chunk_id, level, digest, words), and an entry without a term for each chunk.

    Postings are in order of terms, so that the shuffle packs them well, and have no
    digest: entries alone are asked for it. A null word parts the words of one column from those of the next: no phrase reaches across.
    """
    lists = batch.column(3)
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = words.is_valid().to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    terms = pa.array(stem(coded.dictionary.to_pylist()), pa.string()).dictionary_encode()
    term = terms.indices.to_numpy()[coded.indices.drop_null().to_numpy()] if real.any() else np.zeros(0, np.int64)
    rows, place = rows[real], place[real]
    order = np.argsort(term.astype(np.int64) * max(1, len(sizes)) + rows, kind="stable")
    rows, term, place = rows[order], term[order], place[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (term[1:] != term[:-1])]) if len(rows) else np.zeros(0, np.int64)
    n, lengths = len(sizes), np.bincount(rows, minlength=len(sizes))
    owner, bounds = np.r_[rows[first], np.arange(n)], np.r_[first, np.full(n + 1, len(place))]
    tf = np.diff(bounds)
    chosen = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([terms.dictionary.take(pa.array(term[first])), pa.nulls(n, pa.string())]),
            batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(lengths[owner].astype(np.int64)), pa.array(tf.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place.astype(np.int32))), pa.concat_arrays([pa.nulls(len(first), batch.column(2).type), batch.column(2)]),
        ],
        ["term", "chunk_id", "level", "length", "tf", "positions", "digest"],
    )


@dataclass
class KeywordIndex:
    """The index in a folder, at one version. Reading uses ``chunks``, ``average``, ``of``; changing returns the next version."""

    spark: SparkSession
    path: str
    version: Version
    stemmed: bool
    buckets: int
    id_type: str
    level_type: str
    text_cols: tuple[str, ...]
    id_col: str
    level_col: str | None

    @classmethod
    def create(cls, chunks: DataFrame, stemmed: bool = True, id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("text",), level_col: str | None = None, path: str | None = None) -> KeywordIndex:
        """An index of all rows of ``chunks`` below ``path`` (by default a new shared folder)."""
        spark = chunks.sparkSession
        kind = lambda c: chunks.schema[c].dataType.simpleString()
        new = cls(spark, path or fresh_path(spark, "keyword-index"), Version(), stemmed, shuffle_partitions(spark), kind(id_col), kind(level_col) if level_col else "int", tuple(text_cols), id_col, level_col)
        return new._publish(Version(1, *new._added(chunks, 1)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KeywordIndex:
        """The newest version in a folder."""
        found = spark.read.text(f"{path}/versions/*").orderBy(F.desc(F.get_json_object("value", "$.version.number").cast("long"))).first()
        saved = json.loads(found["value"])
        version = saved.pop("version")
        version["segments"] = [Segment(**s) for s in version["segments"]]
        saved["text_cols"] = tuple(saved["text_cols"])
        return cls(spark, path, Version(**version), **saved)

    # Reading

    @property
    def chunks(self) -> int:
        return self.version.chunks

    @property
    def average(self) -> float:
        return self.version.words / self.version.chunks if self.version.chunks else 0.0

    @property
    def postings(self) -> DataFrame:
        """Live postings (term, chunk_id, level, length, tf, positions)."""
        return self._live(self._rows().where("bucket >= 0")).drop("digest", "bucket", "segment")

    @property
    def entries(self) -> DataFrame:
        """(chunk_id, level, length, digest) of the live chunks."""
        return self._live(self._rows().where("bucket < 0")).select("chunk_id", "level", "length", "digest")

    def of(self, terms: list[str]) -> DataFrame:
        """Live postings of some terms; only their buckets are opened."""
        names = self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), self.buckets).alias("b"))
        rows = self._rows().where(F.col("bucket").isin(sorted({r.b for r in names.collect()})) & F.col("term").isin(terms))
        return self._live(rows).drop("digest", "bucket", "segment")

    def _rows(self, segments: list[Segment] | None = None) -> DataFrame:
        """All rows of some segments (all by default), with the segment's number."""
        segments = self.version.segments if segments is None else segments
        schema = f"term string, chunk_id {self.id_type}, level {self.level_type}, length long, tf long, positions array<int>, digest long"
        if not segments:
            return self.spark.createDataFrame([], schema + ", bucket int, segment int")
        rows = self.spark.read.schema(f"{schema}, bucket int, folder string").option("basePath", f"{self.path}/segments").parquet(*[f"{self.path}/segments/folder={s.folder}" for s in segments])
        number = F.create_map(*[F.lit(x) for s in segments for x in (s.folder, s.number)])
        return rows.withColumn("segment", F.element_at(number, F.col("folder"))).drop("folder")

    def _dead(self) -> DataFrame | None:
        if not self.version.tombstones:
            return None
        gone = self.spark.read.schema(f"dead_id {self.id_type}, upto int").parquet(*[f"{self.path}/tombstones/{n}" for n in self.version.tombstones])
        return gone.groupBy("dead_id").agg(F.max("upto").alias("upto"))

    def _live(self, rows: DataFrame) -> DataFrame:
        dead = self._dead()
        return rows if dead is None else rows.join(dead, (F.col("chunk_id") == F.col("dead_id")) & (F.col("segment") <= F.col("upto")), "left_anti")

    # Changing

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> KeywordIndex:
        """The next version: rows of ``changed`` (columns as at creation) are new or replace those with their ids, ids in ``deleted`` go.

        Ids that were never there are no error.
        """
        ids = [d.select(F.col(self.id_col).cast(self.id_type).alias("chunk_id")) for d in (changed, deleted) if d is not None]
        if not ids:
            return self
        number = self.version.number + 1
        touched = materialize((ids[0].unionByName(ids[1]) if len(ids) > 1 else ids[0]).distinct(), "touched-chunks")
        hit = [r.b for r in touched.select(_entry_bucket(F.col("chunk_id"), self.buckets).alias("b")).distinct().collect()]
        old = self._live(self._rows().where(F.col("bucket").isin(hit))).join(touched, "chunk_id", "left_semi")
        gone = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first()
        version = Version(number, list(self.version.segments), list(self.version.tombstones), self.version.chunks - gone.n, self.version.words - gone.w)
        if gone.n:
            last = max(s.number for s in version.segments)
            version.tombstones.append(_name(number))
            touched.select(F.col("chunk_id").alias("dead_id"), F.lit(last).alias("upto")).write.parquet(f"{self.path}/tombstones/{version.tombstones[-1]}")
        if changed is not None:
            segments, _, n, words = self._added(changed, number)
            version.segments += segments
            version.chunks, version.words = version.chunks + n, version.words + words
        return self._publish(version)._merged()

    def sync(self, chunks: DataFrame) -> KeywordIndex:
        """The next version, equal to the table ``chunks``: only rows whose digest is new are cut into words."""
        now = self._base(chunks, words=False).groupBy("chunk_id").agg(F.sum(F.col("digest").cast("decimal(38,0)")).alias("now"), F.count("*").alias("n"))
        known = self.entries.groupBy(F.col("chunk_id").alias("id")).agg(F.sum(F.col("digest").cast("decimal(38,0)")).alias("then"), F.count("*").alias("m"))
        both = materialize(now.join(known, F.col("chunk_id") == F.col("id"), "full").where("not (now <=> then and n <=> m)").select("chunk_id", "id"), "index-changes")
        new, old = both.where("chunk_id is not null").select(F.col("chunk_id").alias("_new")), both.where("chunk_id is null").select(F.col("id").alias(self.id_col))
        if both.isEmpty():
            return self
        changed = chunks.join(new, F.col(self.id_col).cast(self.id_type) == F.col("_new"), "left_semi")
        return self.apply(None if new.isEmpty() else changed, old)

    def merge(self, segments: list[Segment] | None = None) -> KeywordIndex:
        """The next version with some segments (all by default) put into one; dead postings go, no text is read."""
        segments, rest = self.version.segments if segments is None else segments, []
        if segments is not self.version.segments:
            rest = [s for s in self.version.segments if s not in segments]
        number = self.version.number + 1
        # The new segment has the rank of its newest part: tombstones that reach that far reached all of them.
        made = self._written(self._live(self._rows(segments)).drop("segment"), max(s.number for s in segments), _name(number))
        tombs = self.version.tombstones if rest else []
        return self._publish(Version(number, [*rest, *made], list(tombs), self.version.chunks, self.version.words))

    def _merged(self) -> KeywordIndex:
        index, sizes = self, {}
        written = sum(s.chunks for s in self.version.segments)
        if written > 1 and written - self.version.chunks > DEAD_SHARE * written:
            return self.merge()
        for s in self.version.segments:
            sizes.setdefault(max(s.words, 1).bit_length() // 2, []).append(s)
        for same in sizes.values():
            if len(same) >= FANOUT:
                index = index.merge(same)
        return index

    def _base(self, chunks: DataFrame, words: bool = True) -> DataFrame:
        """(chunk_id, level, digest, words) of rows of the table."""
        from stratalore.operators.search import plain_tokens, word_tokens

        tokens = word_tokens if self.stemmed else plain_tokens
        level = F.col(self.level_col) if self.level_col else F.lit(1)
        gap, parts = F.array(F.lit(None).cast("string")), []
        for c in self.text_cols:
            parts += [gap, tokens(F.col(c))] if parts else [tokens(F.col(c))]
        out = [F.col(self.id_col).cast(self.id_type).alias("chunk_id"), level.cast(self.level_type).alias("level"), F.xxhash64(level, *self.text_cols).alias("digest")]
        return chunks.select(*out, F.concat(*parts).alias("words")) if words else chunks.select(*out)

    def _added(self, chunks: DataFrame, number: int) -> tuple[list[Segment], list[str], int, int]:
        """A segment of the rows: (segments, tombstones, chunks, words), as a version has them."""
        if self.stemmed:
            ship(self.spark)
        stemmed = self.stemmed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from stratalore.operators.keyword_index import pieces, postings_of
            from stratalore.operators.search import stem_words

            for b in batches:
                for piece in pieces(b):
                    yield postings_of(piece, stem_words if stemmed else list)
            give_back()

        base = self._base(chunks).select(F.coalesce("chunk_id", F.raise_error("a chunk without an id can't be indexed").cast(self.id_type)).alias("chunk_id"), "level", "digest", "words")
        ship(self.spark)
        bound_batches(self.spark, 1000)
        rows = base.mapInArrow(run, f"term string, chunk_id {self.id_type}, level {self.level_type}, length long, tf long, positions array<int>, digest long")
        # Entries of the chunks go to buckets of ids, below zero.
        dealt = rows.withColumn("bucket", F.when(F.col("term").isNull(), _entry_bucket(F.col("chunk_id"), self.buckets)).otherwise(_bucket(F.col("term"), self.buckets)))
        made = self._written(dealt, number, _name(number))
        return made, [], sum(s.chunks for s in made), sum(s.words for s in made)

    def _written(self, rows: DataFrame, number: int, folder: str) -> list[Segment]:
        """Write rows (with their buckets) as a segment; none if there are none. Whole buckets of usual size lie in one file, large ones in several."""
        target = f"{self.path}/segments/folder={folder}"
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(target)
        entries = self._rows([Segment(number, folder, 0, 0)]).where("bucket < 0") if _has_files(self.spark, target) else None
        total = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first() if entries is not None else None
        return [Segment(number, folder, total.n, total.w)] if total and total.n else []

    def _publish(self, version: Version) -> KeywordIndex:
        made = KeywordIndex(self.spark, self.path, version, self.stemmed, self.buckets, self.id_type, self.level_type, self.text_cols, self.id_col, self.level_col)
        saved = {k: getattr(made, k) for k in ("stemmed", "buckets", "id_type", "level_type", "text_cols", "id_col", "level_col")} | {"version": asdict(version)}
        self.spark.createDataFrame([(json.dumps(saved),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/versions/{version.number:09d}")
        return made


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether a written folder has rows: a write of none leaves no bucket."""
    try:
        return bool(spark.read.option("recursiveFileLookup", "true").schema("length long").parquet(path).inputFiles())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
