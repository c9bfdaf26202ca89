"""Encoding documents and keeping their token ids in wavelet-matrix files.

Texts are encoded where they are read; only the packed ids are shuffled, to
ranges of document ids. Range bounds come from quantiles of the id column. A task
writes the documents of its range, in order, to files of about ``SHARD_TOKENS``
tokens in the shared folder, and the written list of files is the only thing that
later steps plan with. Reading takes one file at a time.

Encoding works on distinct words: the tokenizer drops white space and neither
normalises nor merges across it (checked on load), so the words of a batch are
dictionary-encoded in Arrow, each distinct word goes through the tokenizers
library once while a bounded table remembers it, and the ids of the texts are
gathered from that table. A text is encoded in pieces of about ``LONG`` bytes.

Defined results: a null or empty text has the end id only; repeated ids follow
each other, ordered by their tokens; null ids come first; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalore.llm.files import read_file, write_file
from stratalore.session import bound_batches, fresh_path, give_back, materialize, ship, shuffle_partitions

SHARD_TOKENS = 1 << 22
#: Stems, marks and odd words whose ids one worker remembers, and parts of odd words.
MEMO_WORDS, MEMO_PARTS = 300_000, 100_000
#: Parts that go through the library in one text.
JOINED = 5000
#: Bytes of text that are encoded at once, and of a text from which it is cut at white space.
BATCH_BYTES, LONG = 3 << 20, 8 << 20

_encoders: dict = {}
#: A line that is a lower-case Latin word with closing marks, or any other line.
_SPLIT = re.compile("^(?:([a-zªµºß-öø-įı-ɏ]+)([!-&(-/:-@\\[-`{-~]*)|([^\n]+))$", re.MULTILINE)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint8(32), _BYTES)
_LETTER = (_LOWER >= 97) & (_LOWER <= 122)
#: ASCII marks that follow a word as one pre-token; an apostrophe may start a contraction.
_MARK = ((_BYTES > 32) & (_BYTES < 127)) & ~_LETTER & ~((_BYTES >= 48) & (_BYTES <= 57)) & (_BYTES != 39)
_PROBE = "a the and thes qzx reading unhappily mmm aaaaaa zzzzzzzzzzzz ofthe straightforwardness etxt internationalization hq vwl"
_LATIN = "été über señor œuvre ßx añadir çe ø ıl ðð āēī żółć ŉ ſ ǉ ɏ ª µ º"


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of runs of the given lengths, one run after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive stretches of bytes as binary values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Encoder:
    """Ids of texts from the tokenizers library, as little-endian bytes."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        top = self.library.get_vocab_size(with_added_tokens=True)
        self.width = max(1, (top - 1).bit_length())
        self.kind = np.dtype("<u2" if self.width <= 16 else "<u4")
        parsed = json.loads(spec)
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        self.closes = np.zeros(top, bool)  # ids that end a pre-token
        self.closes[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        words = _PROBE.split()
        alone = self._one_by_one(words)
        if self._one_by_one(["\t" + " \n ".join(words).upper() + "\r"])[0] != b"".join(alone):
            raise ValueError("the tokenizer must ignore case and drop white space")
        # The same model without the steps that leave lower-case words alone: ASCII words, and Latin words, whose bytes need their letters.
        lines = {"type": "CharDelimiterSplit", "delimiter": "\n"}
        letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.plain = self._bare(parsed, lines, words)
        self.latin = self._bare(parsed, {"type": "Sequence", "pretokenizers": [lines, letters]}, [*words, *_LATIN.split()])
        self.parts: dict[str, bytes] = {"": b""}
        self._forget()

    def _bare(self, parsed: dict, split: dict, probe: list[str]):
        """The model with nothing but this split before it, or the whole library if that gives other ids."""
        tokenizer = type(self.library).from_str(json.dumps(parsed | {"normalizer": None, "added_tokens": [], "pre_tokenizer": split, "post_processor": None}))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer if self._joined(probe, tokenizer) == self._one_by_one(probe) else self.library

    def rest(self) -> None:
        """Forgets all words: the worker goes on to other stages, which need the memory."""
        self.parts = {"": b""}
        self._forget()
        give_back()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {b"": 0}
        self.starts, self.lengths, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of words that are one pre-token each: one text is encoded and cut where pre-tokens end."""
        out: list[bytes] = []
        for part, ids, lengths in self._cut(words, tokenizer):
            if lengths is None:
                out += self._one_by_one(part)
                continue
            data, at = ids.tobytes(), 0
            for n in (lengths * self.kind.itemsize).tolist():
                out.append(data[at : at + n])
                at += n
        return out

    def _cut(self, words: list[str], tokenizer) -> Iterator[tuple[list[str], np.ndarray, np.ndarray | None]]:
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            ids = np.array(tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            yield part, ids, np.diff(ends, prepend=0) if len(ends) == len(part) else None

    def _stems(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of lower-case ASCII words."""
        ids, lengths = [], []
        for part, found, sizes in self._cut(b"\n".join(new).decode().split("\n"), self.plain):
            if sizes is None:
                each = self._one_by_one(part)
                found, sizes = np.frombuffer(b"".join(each), self.kind), np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize
            ids.append(found)
            lengths.append(sizes)
        return np.concatenate(ids), np.concatenate(lengths)

    def _others(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words; a Latin word with closing marks has the ids of the word, then those of the marks."""
        if len(self.parts) > MEMO_PARTS:
            self.parts = {"": b""}
        texts = [w.decode("utf-8", "replace") for w in new]
        stems, marks, rest = zip(*_SPLIT.findall("\n".join(texts).lower()), strict=True)
        for found, learn in ((stems, lambda new: self._joined(new, self.latin)), (marks, self._one_by_one)):
            missing = list(set(found).difference(self.parts))
            self.parts.update(zip(missing, learn(missing), strict=True))
        odd = iter(self._one_by_one([w for w, r in zip(texts, rest, strict=True) if r]))
        each = [next(odd) if r else self.parts[s] + self.parts[m] for s, m, r in zip(stems, marks, rest, strict=True)]
        return np.frombuffer(b"".join(each), self.kind), np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize

    def _slots(self, keys: pa.Array, learn) -> np.ndarray:
        """Table row of each key; unknown keys are learned first."""
        coded = keys.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        rows = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            new = [distinct[k] for k in unknown.tolist()]
            ids, lengths = learn(new)
            rows[unknown] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.place.update(zip(new, rows[unknown].tolist(), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths, self.ids = np.concatenate((self.lengths, lengths)), np.concatenate((self.ids, ids))
        return rows[coded.indices.to_numpy()]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of distinct words (binary): of the word or its stem, and of its closing marks."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
        start, end = offsets[:-1], offsets[1:]
        ends_letters = np.r_[np.flatnonzero(~_LETTER[data]), len(data)]
        stem = np.minimum(ends_letters[np.searchsorted(ends_letters, start)], end)
        wrong = np.r_[0, np.cumsum(~_MARK[data])]
        plain = (stem > start) & (wrong[end] == wrong[stem])
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.flatnonzero(plain)
        first[at] = self._slots(binaries(_LOWER[data[ragged(start[at], (stem - start)[at])]], (stem - start)[at]), self._stems)
        other = np.flatnonzero(~plain & (end > start))
        first[other] = self._slots(words.take(pa.array(other)), self._others)
        at = np.flatnonzero(plain & (end > stem))
        second[at] = self._slots(binaries(data[ragged(stem[at], (end - stem)[at])], (end - stem)[at]), self._others)
        return first, second

    def encode(self, texts: pa.Array, end: int | None) -> pa.Array:
        """Ids of each text (string; null: empty), followed by the ``end`` id if there is one."""
        if len(self.place) > MEMO_WORDS:
            self._forget()
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        if (sizes > LONG).any():
            return pa.array([self._long(texts[i].as_buffer().to_pybytes(), end) if n > LONG else self.encode(texts[i : i + 1], end)[0].as_py() for i, n in enumerate(sizes.tolist())], pa.binary())
        lists = pc.ascii_split_whitespace(texts)
        words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        coded = lists.flatten().view(pa.binary()).dictionary_encode()
        first, second = self._words(coded.dictionary)
        both = np.stack((first, second), axis=1).ravel()
        lengths = np.r_[self.lengths[first] + self.lengths[second], 1 if end is not None else 0]
        table = np.r_[self.ids[ragged(self.starts[both], self.lengths[both])], np.array([end or 0], self.kind)]
        starts = np.cumsum(lengths) - lengths
        # Every text is its words and then the end, the last entry of the table.
        codes = np.full(len(coded) + len(texts), len(lengths) - 1)
        codes[np.arange(len(coded)) + np.repeat(np.arange(len(texts)), words)] = coded.indices.to_numpy()
        sizes = lengths[codes]
        ids = table[ragged(starts[codes], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(words + 1)]
        return binaries(ids, np.diff(ends, prepend=0) * self.kind.itemsize)

    def _long(self, data: bytes, end: int | None) -> bytes:
        out, at = [], 0
        while at < len(data):
            m = _SPACE.search(data, at + LONG // 2)
            cut = m.start() if m else len(data)
            out.append(self._piece(data[at:cut]))
            at = cut
        return b"".join(out) + (b"" if end is None else np.array([end], self.kind).tobytes())

    def _piece(self, data: bytes) -> bytes:
        if len(data) > LONG:  # a word that long has no place in the table
            return self._one_by_one([data.decode("utf-8", "replace")])[0]
        return self.encode(pa.array([data], pa.binary()).view(pa.string()), None)[0].as_py()


def gathered(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``size`` bytes."""
    held, total, size = [], 0, size or BATCH_BYTES
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encoder_of(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def _vocabulary(tokenizer_file: str) -> tuple[str, int]:
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    return spec, max(1, (Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def encode(docs: DataFrame, tokenizer_file: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", bounds: list[int] | None = None) -> DataFrame:
    """(part, doc_id, ids binary): ids of each text, little-endian, 2 bytes each if the vocabulary allows, else 4.

    ``part`` is the number of ``bounds`` that an id has reached; a null id has none.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark, 1000)
    spec = spark.sparkContext.broadcast(_vocabulary(tokenizer_file)[0])
    edges = np.array(bounds or [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.token_files import encoder_of, gathered

        encoder = encoder_of(spec.value)
        give_back()  # what reading the vocabulary has left
        for b in gathered(batches):
            part = np.searchsorted(edges, b.column(0).fill_null(-(2**63)).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), encoder.encode(b.column(1), end)], ["part", "doc_id", "ids"])
        encoder.rest()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "part int, doc_id long, ids binary")


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``path`` (a shared folder); returns the written list of files.

    Columns: part, number (files in id order), file, docs, tokens.
    """
    spark = docs.sparkSession
    width = _vocabulary(tokenizer_file)[1]
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    n = shuffle_partitions(spark)
    bounds = docs.select(docs[id_col].cast("long").alias("doc_id")).stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = [int(x) for x in bounds]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.wavelet import Shard

        held: list = [[], [], [], 0]
        part, number = None, 0

        def flush():
            ids, lengths, tokens, total = held
            name = f"{path}/shard-{part:06d}-{number:06d}.slwm"
            write_file(name, [Shard.build(ids, lengths, np.frombuffer(b"".join(tokens), kind), width).to_bytes()])
            held[:] = [[], [], [], 0]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], ["part", "number", "file", "docs", "tokens"])

        for b in batches:
            for p, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held[0] and (p != part or held[3] + len(ids) // kind.itemsize > SHARD_TOKENS):
                    yield flush()
                    number = number + 1 if p == part else 0
                part = p
                held[0].append(doc)
                held[1].append(len(ids) // kind.itemsize)
                held[2].append(ids)
                held[3] += len(ids) // kind.itemsize
        if held[0]:
            yield flush()
        give_back()

    dealt = encode(docs, tokenizer_file, end, id_col, text_col, bounds)
    ranged = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    return materialize(ranged.mapInArrow(write, "part int, number int, file string, docs long, tokens long"), "token-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``, the tokens in all earlier files: a sum over parts, then one within each part."""
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.join(before, "part").select("*", (F.col("base") + within).alias("start")).drop("base")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.wavelet import Shard

        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard.from_bytes(read_file(file))
                tokens = shard.matrix.decode()
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                data = memoryview(tokens.astype("<u4")).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids(), pa.int64()), pa.array(begins + start), pa.array(shard.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ready = materialize(with_starts(shards).select("file", "start"), "token-starts")
    n = shuffle_partitions(ready.sparkSession)
    return ready.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, end: int | None = 1, path: str | None = None) -> DataFrame:
    """Write the documents' tokens below ``path`` (by default a new shared folder) and read them back."""
    return read_shards(write_shards(docs, tokenizer_file, path or fresh_path(docs.sparkSession, "token-files"), end))
