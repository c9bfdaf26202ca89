"""Encoding and decoding by a lexicon of frequent words and exact merging of all others.

Texts are cut at ASCII white space, which the tokenizer drops and across which nothing
reaches; a word of Latin letters with closing marks is cut once more before the marks.
The parts of all documents are counted by Spark, and the ``LEXICON`` most frequent ones
are compiled with their ids into a minimal acyclic transducer. Its file lies in the
shared folder, goes to every executor as a file of the job and is mapped into memory
there. A batch of texts is reduced to its distinct parts; these walk the transducer
together, and those that it lacks are merged by rank, all at once, and remembered in a
bounded table. So which words the lexicon has changes the speed and never the ids.

Decoding joins the strings of the ids as the library does.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated
rows and ids have a row each; an empty table gives an empty table; a text of more than
``LONG`` bytes is worked on in pieces, but as one text; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalore.llm.bpe import RankMerger
from stratalore.llm.files import write_file
from stratalore.llm.token_files import binaries, gathered, ragged
from stratalore.llm.transducer import Transducer, compiled
from stratalore.session import bound_batches, fresh_path, materialize, ship

#: Parts in the lexicon, and bytes of the longest one.
LEXICON, LONGEST = 1 << 17, 64
#: Classes of frequency for each doubling.
STEPS = 16
#: Parts that one worker remembers beside the lexicon, bytes merged in one array batch, bytes of text taken at once.
MEMO, MERGE_BYTES, LONG = 400_000, 4 << 20, 8 << 20
#: Bytes of a part beyond which the library merges it: rounds over all its symbols would be too many.
ENDLESS = 1 << 16

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint8(32), _BYTES)
_ASCII = (_LOWER >= 97) & (_LOWER <= 122)
#: ASCII marks that follow a word as a pre-token of their own; an apostrophe may start a contraction.
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_ASCII & ~((_BYTES >= 48) & (_BYTES <= 57)) & (_BYTES != 39)
#: In UTF-8 the letters U+00C0 to U+017F are a byte 0xC3, 0xC4 or 0xC5 and another; these two-byte characters are none, or not one when lower-cased.
_LEAD, _NO_LETTER = (_BYTES >= 0xC3) & (_BYTES <= 0xC5), (0xC397, 0xC3B7, 0xC4B0)


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to Latin letters that normalisation leaves alone but for their case."""
    lead = _LEAD[data]
    pair = np.zeros(len(data), np.int64)
    pair[:-1] = data[:-1].astype(np.int64) << 8 | data[1:]
    lead &= ~np.isin(pair, _NO_LETTER)
    lead[-1:] = False
    return _ASCII[data] | lead | np.r_[False, lead[:-1]][: len(data)]


def split_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct parts of words (binary), and the part numbers of each word's stem and of its closing marks.

    A word of another form is its own stem. ASCII letters of split words are lower-cased.
    """
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start, end = offsets[:-1], offsets[1:]
    letter = _letters(data)
    ends = np.r_[np.flatnonzero(~letter), len(data)]
    stem = np.minimum(ends[np.searchsorted(ends, start)], end)
    wrong = np.r_[0, np.cumsum(~_MARK[data])]
    split = (stem > start) & (wrong[end] == wrong[stem])
    first, rest = np.where(split, stem, end) - start, np.where(split, end - stem, 0)
    low = np.where(np.repeat(split, first), _LOWER[data[ragged(start, first)]], data[ragged(start, first)])
    both = pa.concat_arrays([binaries(low, first), binaries(data[ragged(end - rest, rest)], rest)]).dictionary_encode()
    codes = both.indices.to_numpy()
    return both.dictionary, codes[: len(words)], codes[len(words) :]


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts (binary), the numbers of all words in order, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().view(pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def frequent_parts(docs: DataFrame, number: int, text_col: str = "text") -> list[bytes]:
    """The parts of the words of all documents that are more frequent than some bound, the lowest one (of ``STEPS`` for
    each doubling) that at most ``number`` parts reach. So no task ranks parts, and equal ones stay or go together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.bpe_codec import LONGEST, distinct_words, split_words
        from stratalore.llm.token_files import gathered

        for b in gathered(batches):
            words, codes, _ = distinct_words(b.column(0))
            times = np.bincount(codes, minlength=len(words))
            parts, first, rest = split_words(words)
            total = np.bincount(np.r_[first, rest], np.r_[times, times], len(parts)).astype(np.int64)
            sizes = pc.binary_length(parts).to_numpy()
            yield pa.RecordBatch.from_arrays([parts, pa.array(total)], ["part", "times"]).filter(pa.array((sizes > 0) & (sizes <= LONGEST)))

    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "part binary, times long").groupBy("part").agg(F.sum("times").alias("times"))
    leveled = materialize(counted.select("part", F.floor(STEPS * F.log2("times")).alias("level")), "part-counts")
    left, bound = number, None
    for level, n in sorted(map(tuple, leveled.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        bound = level
    return [] if bound is None else [bytes(r["part"]) for r in leveled.where(F.col("level") >= bound).select("part").toLocalIterator()]


class Codec:
    """Ids and decoded texts of batches of texts."""

    def __init__(self, spec: str, lexicon: Transducer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.merger, self.lexicon = RankMerger(spec), lexicon
        self.library = self.merger.library
        self.library.no_truncation()
        self.library.no_padding()
        if "".join(e for e in ("a b", " A\tB\r\n") if self.library.encode(e, add_special_tokens=False).ids != [i for w in ("a", "b") for i in self.library.encode(w, add_special_tokens=False).ids]):
            raise ValueError("the tokenizer must ignore case and drop white space")
        self.joined = json.loads(spec)["decoder"] is None
        strings = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.strings = pa.array(strings)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts by exact merging: all ids, and the number of each part's."""
        each: list[np.ndarray | None] = [None] * len(parts)
        owner, pre = [], []
        for i, part in enumerate(parts):
            specials, found = self.merger.pre_tokens(part) if len(part) <= ENDLESS else (1, [])
            if specials:  # their order among the pre-tokens counts
                each[i] = np.array(self.library.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            else:
                pre += found
                owner += [i] * len(found)
        ids, sizes = self.merger.merge(np.frombuffer(b"".join(pre), np.uint8), np.fromiter(map(len, pre), np.int64, len(pre)))
        lengths = np.bincount(np.array(owner, np.int64), sizes, len(parts)).astype(np.int64)
        if any(e is not None for e in each):
            plain = np.split(ids, np.cumsum(lengths)[:-1])
            each = [p if e is None else e for e, p in zip(each, plain, strict=True)]
            return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        return ids, lengths

    def _remembered(self, parts: list[bytes]) -> np.ndarray:
        """Rows of the table of remembered parts; new parts are merged first."""
        rows = np.fromiter(map(self.place.get, parts, repeat(-1)), np.int64, len(parts))
        unknown, at = np.flatnonzero(rows < 0).tolist(), 0
        while at < len(unknown):
            new, size = [], 0
            while at < len(unknown) and size < MERGE_BYTES:
                new.append(parts[unknown[at]])
                size += len(new[-1])
                at += 1
            ids, lengths = self.merged(new)
            self.place.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths, self.ids = np.concatenate((self.lengths, lengths)), np.concatenate((self.ids, ids))
        if unknown:
            rows[unknown] = [self.place[parts[i]] for i in unknown]
        return rows

    def part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts (binary): all ids, and the number of each part's."""
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
        found, ids, lengths = self.lexicon.look_up(np.frombuffer(parts.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets))
        other = np.flatnonzero(~found & (np.diff(offsets) > 0))
        rows = self._remembered(parts.take(pa.array(other)).to_pylist())
        # Both kinds in one array, then in the order of the parts.
        starts = np.cumsum(lengths) - lengths
        starts[other], lengths[other] = len(ids) + self.starts[rows], self.lengths[rows]
        return np.concatenate((ids, self.ids))[ragged(starts, lengths)], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (string; null: empty), one after the other, and the number of each text's."""
        if len(self.place) > MEMO:
            self.forget()
        words, codes, counts = distinct_words(texts)
        parts, first, rest = split_words(words)
        ids, lengths = self.part_ids(parts)
        starts = np.cumsum(lengths) - lengths
        both = np.stack((first, rest), axis=1).ravel()
        ids, lengths = ids[ragged(starts[both], lengths[both])], lengths[first] + lengths[rest]
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[codes]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
        return ids[ragged(starts[codes], sizes)], np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts of ids as the library decodes them, special tokens included."""
        if not self.joined:
            return [self.library.decode(x.tolist(), skip_special_tokens=False).encode() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), self.strings.take(pa.array(ids)))
        return pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()

    def round_trip(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids, and digest of the decoded text of each text."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        if (sizes > LONG).any():
            return [self._long(texts[i].as_buffer().to_pybytes()) if n > LONG else self.round_trip(texts[i : i + 1])[0] for i, n in enumerate(sizes.tolist())]
        ids, sizes = self.encode(texts)
        data, ends = memoryview(ids.astype("<u4")).cast("B") if len(ids) else b"", np.cumsum(sizes) * 4
        return [(n, sha256(data[z - 4 * n : z]).hexdigest(), sha256(t).hexdigest()) for n, z, t in zip(sizes.tolist(), ends.tolist(), self.decode(ids, sizes), strict=True)]

    def _long(self, data: bytes) -> tuple[int, str, str]:
        from stratalore.llm.token_files import _SPACE

        total, of_ids, of_text, at = 0, sha256(), sha256(), 0
        while at < len(data):
            m = _SPACE.search(data, at + LONG // 2)
            cut = m.start() if m else len(data)
            ids, sizes = self.encode(pa.array([data[at:cut]], pa.binary()).view(pa.string()))
            of_ids.update(ids.astype("<u4").tobytes())
            if len(ids):
                of_text.update(b" " * (total > 0) + self.decode(ids, sizes)[0])
            total, at = total + len(ids), cut
        return total, of_ids.hexdigest(), of_text.hexdigest()


_codecs: dict = {}


def codec_of(spec: str, path: str) -> Codec:
    key = hash(spec), path
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec, Transducer(path))
    return _codecs[key]


def build_lexicon(docs: DataFrame, spec: str, number: int = LEXICON, text_col: str = "text") -> str:
    """Write the lexicon of the most frequent parts below the shared folder and hand it to the executors; the name of the file."""
    spark = docs.sparkSession
    words = sorted(frequent_parts(docs, number, text_col))
    ids, lengths = Codec(spec, Transducer(compiled([]))).merged(words)
    entries = ((w, tuple(i)) for w, i in zip(words, (x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])), strict=False))
    path = fresh_path(spark, "lexicon")
    write_file(path, [compiled(entries)])
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def round_trips(docs: DataFrame, tokenizer_file: str, number: int = LEXICON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        text = f.read()
    spec, name = spark.sparkContext.broadcast(text), build_lexicon(docs, text, number, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.bpe_codec import codec_of

        codec = codec_of(spec.value, SparkFiles.get(name))
        for b in gathered(batches):
            n, of_ids, of_text = zip(*codec.round_trip(b.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
