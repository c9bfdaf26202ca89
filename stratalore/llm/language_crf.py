"""Language of code-switched text by a linear-chain conditional random field over words.

Each word has a potential for each language: the sum of learned weights of its
affixes, letter n-grams and, for frequent training words, of the word itself.
Neighbours are linked by learned transitions. Forward-backward gives every word a
distribution over languages; a document's language is the one with most expected
words, and its score is that share.

Training takes at most ``MAX_DOCS`` whole documents and ``MAX_BYTES`` of text of each
language (the first by a hash of the id) to the driver, and less of each where that
would exceed ``MAX_TOTAL``. If these leave a language without words, its shortest
text with a letter is taken, one over the bound by as many code points as a quarter
of it from that letter on (in training only), so every language is learned; over
``MAX_LANGUAGES`` are refused with an error. Training sequences splice
stretches of documents in different languages, so transitions are learned from
switches at known places.

Forward-backward runs over all words of a batch at once: words are cut into
blocks, block products carry the state from block to block, and all blocks step
together, so one very long text costs no more steps than many short ones.

Defined results: a null text and one without letters are ``und`` with score 0;
without training rows everything is ``und``; a row without an id is predicted but
not learned from; of texts that share an id and a language one is learned from; repeated rows give a row each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalore.llm.pairwise_quality import held_out
from stratalore.session import bound_batches, materialize, ship

#: Training texts and bytes of a language, bytes of all languages, and languages.
MAX_DOCS, MAX_BYTES, MAX_TOTAL, MAX_LANGUAGES = 150, 1 << 20, 64 << 20, 256
BUCKETS = 1 << 16
LEXICON_COUNT = 4
STEPS, RATE, RIDGE = 30, 0.25, 1e-6
SEQUENCE, BLOCK = 256, 64
#: Words of a batch that are labelled at once, and distinct words a worker remembers.
BATCH_WORDS, MEMO_WORDS = 300_000, 300_000
#: Letters of new words whose features are made at once; a longer word is taken whole.
LETTERS = 1 << 21
UNKNOWN = "und"
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _bucket(codes: list[np.ndarray], kind: int) -> np.ndarray:
    """Bucket of a tuple of letters of one kind of feature."""
    h = np.full(len(codes[0]), kind + 1, np.uint64) * _MIX[4]
    for k, c in enumerate(codes):
        h = (h ^ c) * _MIX[k % 4]
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the hashed features of words that have letters.

    Prefixes of 1-3 and suffixes of 1-4 letters, all 2- and 3-grams with marks at
    both ends, and the word itself if it is in the lexicon.
    """
    marked = [f"^{w}$" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    out = []
    for k in (1, 2, 3):
        w = np.flatnonzero(sizes - 2 >= k)
        out.append((w, _bucket([c[starts[w] + 1 + i] for i in range(k)], k)))
    for k in (1, 2, 3, 4):
        w = np.flatnonzero(sizes - 2 >= k)
        out.append((w, _bucket([c[starts[w] + sizes[w] - 2 - i] for i in range(k)], 3 + k)))
    for k in (2, 3):
        at = np.flatnonzero(owner[: len(c) - k + 1] == owner[k - 1 :]) if len(c) >= k else np.empty(0, np.int64)
        out.append((owner[at], _bucket([c[at + i] for i in range(k)], 7 + k)))
    known = np.fromiter((i for i, w in enumerate(words) if w in lexicon), np.int64)
    out.append((known, np.fromiter((zlib.crc32(words[i].encode()) % BUCKETS for i in known.tolist()), np.int64, len(known))))
    return np.concatenate([w for w, _ in out]), np.concatenate([b for _, b in out])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray  # languages x languages
    lexicon: frozenset[str]
    memo: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "table": None}

    def potentials(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word in a table of potentials (-1: no letters), and the table."""
        new = list(set(words).difference(self.memo))
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo, self.table, new = {}, None, list(set(words))
        if new:
            ok = [any(map(str.isalpha, w)) for w in new]
            group = np.cumsum([len(w) for w in new]) // LETTERS
            rows = np.concatenate([self._sums(new[a:z]) for a, z in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(new)])])
            base = 0 if self.table is None else len(self.table)
            self.memo.update((w, base + i if good else -1) for i, (w, good) in enumerate(zip(new, ok, strict=True)))
            self.table = rows if self.table is None else np.concatenate((self.table, rows))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)), self.table

    def _sums(self, words: list[str]) -> np.ndarray:
        owner, bucket = word_features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[bucket, y], len(words)) for y in range(len(self.languages))], axis=1).astype(np.float32)

    def marginals(self, potentials: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distribution over languages of each word; ``potentials`` of sequences one after the other, none empty."""
        return forward_backward(potentials, lengths, self.transitions)[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        group: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in enumerate(texts):
            words = tokens(t) if t and self.languages else []
            if words:
                group.append((i, words))
                size += len(words)
            if size >= BATCH_WORDS:
                self._predict(group, out)
                group, size = [], 0
        if group:
            self._predict(group, out)
        return out

    def _predict(self, group: list, out: list) -> None:
        at, table = self.potentials([w for _, words in group for w in words])
        owner = np.repeat(np.arange(len(group)), [len(words) for _, words in group])
        owner, at = owner[at >= 0], at[at >= 0]
        if not len(at):
            return
        there, lengths = np.unique(owner, return_counts=True)
        p = self.marginals(table[at], lengths)
        share = np.add.reduceat(p, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        best = share.argmax(axis=1)
        for k, d in enumerate(there.tolist()):
            out[group[d][0]] = (self.languages[best[k]], min(1.0, max(0.0, float(share[k, best[k]]))))


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Word marginals and, with ``pairs``, the expected transition counts."""
    n, k = potentials.shape
    step = np.exp(transitions - transitions.max()).astype(np.float64)
    top = potentials.max(axis=1, keepdims=True)
    o = np.exp(potentials - top).astype(np.float64)
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks  # first block of each sequence
    seq = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(seq)) - first[seq]
    begin = (np.cumsum(lengths) - lengths)[seq] + number * BLOCK
    size = np.minimum(BLOCK, lengths[seq] - number * BLOCK)
    order = np.argsort(-size, kind="stable")  # so that the blocks still running are a prefix
    begin, size = begin[order], size[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    starts_sequence = number[order] == 0
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(BLOCK)]  # blocks longer than t
    # Products over each block: row a is the state after it if it was a before it.
    product = np.broadcast_to(np.eye(k), (len(size), k, k)).copy()
    lead = np.where(starts_sequence[:, None, None], np.eye(k), step)
    for t in range(BLOCK):
        m = live[t]
        if not m:
            break
        here = product[:m] @ (lead[:m] if t == 0 else step) * o[begin[:m] + t][:, None, :]
        product[:m] = here / here.max(axis=(1, 2), keepdims=True)
    into, after = np.ones((len(size), k)), np.ones((len(size), k))
    most = int(blocks.max())
    for b in range(1, most):
        s = np.flatnonzero(blocks > b)
        before = place[first[s] + b - 1]
        x = np.einsum("ij,ijk->ik", into[before], product[before])
        into[place[first[s] + b]] = x / x.max(axis=1, keepdims=True)
    for b in range(most - 2, -1, -1):
        s = np.flatnonzero(blocks > b + 1)
        nxt = place[first[s] + b + 1]
        x = np.einsum("ijk,ik->ij", product[nxt], after[nxt])
        after[place[first[s] + b]] = x / x.max(axis=1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    state = np.where(starts_sequence[:, None], 1.0, into)
    for t in range(BLOCK):
        m = live[t]
        if not m:
            break
        moved = np.where(starts_sequence[:m, None], state[:m], state[:m] @ step) if t == 0 else state[:m] @ step
        moved = moved * o[begin[:m] + t]
        total = moved.sum(axis=1, keepdims=True)
        state[:m] = moved / total
        alpha[begin[:m] + t] = state[:m]
    state = after.copy()
    for t in range(BLOCK - 1, -1, -1):
        m = live[t]
        if not m:
            continue
        beta[begin[:m] + t] = state[:m]
        back = (state[:m] * o[begin[:m] + t]) @ step.T
        state[:m] = back / back.max(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    expected = None
    if pairs:
        inner = np.ones(n, bool)
        inner[np.cumsum(lengths) - lengths] = False
        at = np.flatnonzero(inner)
        joint = alpha[at - 1][:, :, None] * step * (o[at] * beta[at])[:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, expected


def fit(samples: dict[str, list[str]]) -> Model:
    """Train on whole texts by language."""
    languages = sorted(samples)
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), frozenset())
    rng = np.random.default_rng(0)
    counts: Counter = Counter()
    stretches: list[tuple[int, list[str]]] = []
    for y, name in enumerate(languages):
        for text in samples[name]:
            words = [w for w in tokens(text) if any(map(str.isalpha, w))]
            counts.update(words)
            at = 0
            while at < len(words):
                take = int(rng.integers(5, 100))
                stretches.append((y, words[at : at + take]))
                at += take
    lexicon = frozenset(w for w, c in counts.items() if c >= LEXICON_COUNT)
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), lexicon)
    if not stretches:
        return model
    stretches = [stretches[i] for i in rng.permutation(len(stretches))]
    vocabulary = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter((vocabulary[w] for _, ws in stretches for w in ws), np.int64)
    gold = np.repeat([y for y, _ in stretches], [len(ws) for _, ws in stretches])
    lengths = np.full(-(-len(ids) // SEQUENCE), SEQUENCE)
    lengths[-1] = len(ids) - SEQUENCE * (len(lengths) - 1)
    owner, bucket = word_features(list(vocabulary), lexicon)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    w, t = np.zeros((BUCKETS, k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    truth = np.eye(k)[gold]
    for step in range(1, STEPS + 1):
        emission = np.stack([np.bincount(owner, w[bucket, y], len(vocabulary)) for y in range(k)], axis=1)
        p, expected = forward_backward(emission[ids], lengths, t, pairs=True)
        miss = [np.bincount(ids, (p - truth)[:, y], len(vocabulary)) for y in range(k)]
        gw = np.stack([np.bincount(bucket, m[owner], BUCKETS) for m in miss], axis=1) / len(ids) + RIDGE * w
        gt = (expected - seen) / len(ids) + RIDGE * t
        for value, gradient, m, v in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.transitions = w.astype(np.float32), t
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of rows with an id and a language that are not held out.

    Texts are read twice: once for their sizes, once for those chosen.
    """
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    known = base.where("id is not null and lang is not null and text is not null").where(~held_out(F.col("id")))
    lettered = F.regexp_instr("text", F.lit(r"\p{L}"))
    rows = materialize(known.select("id", "lang", F.octet_length("text").alias("size"), (lettered > 0).alias("words")), "language-rows")
    found = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"), F.min(F.when(F.col("words"), F.struct("size", "id"))).alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages to learn; a model has {BUCKETS} weights for each")
    if not found:
        return fit({})
    # Keep about twice MAX_DOCS ids of each language by hash, then cut on the driver.
    share = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, 2 * MAX_DOCS / max(1, r.n)))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sampled = rows.where(place < F.element_at(share, F.col("lang")) * float(1 << 30)).groupBy("id", "lang").agg(F.max("size").alias("size"), F.max("words").alias("words"))
    most = min(MAX_BYTES, MAX_TOTAL // len(found))
    chosen, used = set(), Counter()
    for r in sampled.withColumn("place", place).orderBy("place", "id", "lang").collect():
        if used[r.lang, "docs"] < MAX_DOCS and used[r.lang, "bytes"] + r.size <= most:
            chosen.add((r.id, r.lang))
            used[r.lang, "docs"] += 1
            used[r.lang, "bytes"] += r.size
            used[r.lang, "words"] += r.words
    chosen |= {(r.least.id, r.lang) for r in found if r.least and not used[r.lang, "words"]}
    picked = docs.sparkSession.createDataFrame(sorted(chosen), "id long, lang string")
    part = F.when(F.octet_length("text") > most, F.substring(F.col("text"), F.greatest(lettered, F.lit(1)), F.lit(most // 4))).otherwise(F.col("text"))
    # One text for each chosen id and language, however often they repeat.
    texts = known.join(F.broadcast(picked), ["id", "lang"]).select("id", "lang", F.struct((lettered > 0).alias("words"), part.alias("text")).alias("t")).groupBy("id", "lang").agg(F.max("t").alias("t"))
    samples: dict[str, list[str]] = {}
    for r in texts.select("lang", "t.text").collect():
        samples.setdefault(r.lang, []).append(r.text)
    return fit({lang: sorted(texts) for lang, texts in samples.items()})


_models: dict[str, Model] = {}


def model_of(name: str, broadcast) -> Model:
    """A worker's copy of a broadcast model, with what it remembers of words."""
    if name not in _models:
        _models.clear()
        _models[name] = broadcast.value
    return _models[name]


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    # The size of a model is fixed by BUCKETS, the number of languages and the bounded lexicon.
    shared, name = spark.sparkContext.broadcast(model or train(docs, id_col, text_col)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.language_crf import model_of

        crf = model_of(name, shared)
        for b in batches:
            got = crf.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col].cast("long")).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
