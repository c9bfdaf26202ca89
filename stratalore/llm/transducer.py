"""Minimal acyclic transducers from byte strings to sequences of ids, in one flat file.

Sorted entries are added one by one. Ids sit on the arcs as near to the start as all
words that share the arc allow, so equal endings of words become equal states, and a
state that equals an earlier one is replaced by it. Few thousand bytes of arcs then hold
what a table of the words would, and a word is answered by one walk from the start.

The file is a header and plain arrays; it is mapped into memory, so that all workers of
a machine share its pages. Many words are walked at once, one byte of each in a step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_MAGIC = 0x534C5446
_KINDS = {"first": "<u4", "keys": "<u4", "targets": "<u4", "out": "<u4", "final": "<u4", "pool_ends": "<u4", "pool": "<u4"}
#: No word may make more states than a key (state and byte) has room for.
MAX_STATES = 1 << 24
#: In ``final``: the state ends no word.
_OPEN = 0xFFFFFFFF


class _State:
    """A state that may still change: arcs as [byte, target, ids], and the ids that a word ending here adds."""

    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: list[list] = []
        self.final: tuple[int, ...] | None = None


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of a lexicon; words are distinct, not empty, and in byte order."""
    frozen: dict = {}
    path, before = [_State()], b""

    def freeze(depth: int) -> None:
        """Replaces the states below ``depth`` on the path by final ones."""
        while len(path) > depth + 1:
            state = path.pop()
            key = (state.final, tuple((b, t, o) for b, t, o in state.arcs))
            path[-1].arcs[-1][1] = frozen.setdefault(key, len(frozen))

    for word, ids in entries:
        if word <= before:
            raise ValueError("words must be sorted and distinct")
        same = next((i for i, (a, b) in enumerate(zip(word, before, strict=False)) if a != b), min(len(word), len(before)))
        freeze(same)
        for depth in range(same):
            arc, below = path[depth].arcs[-1], path[depth + 1]
            k = next((i for i, (a, b) in enumerate(zip(arc[2], ids, strict=False)) if a != b), min(len(arc[2]), len(ids)))
            if rest := arc[2][k:]:  # what the words below don't share moves one arc down
                arc[2] = arc[2][:k]
                for down in below.arcs:
                    down[2] = rest + down[2]
                if below.final is not None:
                    below.final = rest + below.final
            ids = ids[k:]
        for b in word[same:]:
            path[-1].arcs.append([b, None, ids])
            path.append(_State())
            ids = ()
        path[-1].final = ids
        before = word
    freeze(0)
    start = len(frozen)
    frozen[(path[0].final, tuple((b, t, o) for b, t, o in path[0].arcs))] = start
    if len(frozen) > MAX_STATES:
        raise ValueError("the lexicon has too many states")
    pool: dict[tuple[int, ...], int] = {(): 0}
    arcs = [(s << 8 | b, t, pool.setdefault(o, len(pool))) for (_, out), s in frozen.items() for b, t, o in out]
    final = [_OPEN if f is None else pool.setdefault(f, len(pool)) for f, _ in frozen]
    arrays = {
        "first": [start],
        "keys": [a[0] for a in arcs],
        "targets": [a[1] for a in arcs],
        "out": [a[2] for a in arcs],
        "final": final,
        "pool_ends": np.cumsum([len(o) for o in pool]),
        "pool": [i for o in pool for i in o],
    }
    parts = [np.array(arrays[k], kind) for k, kind in _KINDS.items()]
    return b"".join([np.array([_MAGIC, *map(len, parts)], "<u4").tobytes(), *(p.tobytes() for p in parts)])


class Transducer:
    """Lookups in a compiled lexicon: a path (mapped into memory) or bytes."""

    def __init__(self, source: str | bytes):
        words = np.frombuffer(source, "<u4") if isinstance(source, bytes) else np.memmap(source, "<u4", "r")
        head = len(_KINDS) + 1
        if not len(words) or words[0] != _MAGIC:
            raise ValueError("not a lexicon file")
        ends = head + np.cumsum(words[1:head], dtype=np.int64)
        parts = {k: words[a:z] for k, a, z in zip(_KINDS, [head, *ends[:-1].tolist()], ends.tolist(), strict=True)}
        self.start, self.keys, self.targets, self.out, self.final, self.pool = int(parts["first"][0]), parts["keys"], parts["targets"], parts["out"], parts["final"], parts["pool"]
        self.pool_ends = parts["pool_ends"].astype(np.int64)
        self.pool_sizes = np.diff(self.pool_ends, prepend=0)
        self.states = len(self.final)

    def look_up(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words (stretches of ``data``) are in the lexicon; their ids, one word after the other, and the number of each word's."""
        from stratalore.llm.token_files import ragged

        n = len(starts)
        state, found = np.full(n, self.start, np.int64), np.zeros(n, bool)
        on, owners, outs = np.flatnonzero(lengths > 0), [], []
        step = 0
        while len(on) and len(self.keys):
            key = (state[on] << 8 | data[starts[on] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            on, at = on[there], at[there]
            state[on] = self.targets[at]
            gives = self.out[at]
            owners.append(on[gives > 0])
            outs.append(gives[gives > 0])
            step += 1
            ended = lengths[on] == step
            last = on[ended]
            closing = self.final[state[last]]
            found[last] = closing != _OPEN
            closes = found[last] & (closing > 0)
            owners.append(last[closes])
            outs.append(closing[closes])
            on = on[~ended]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        out = np.concatenate(outs).astype(np.int64) if outs else np.zeros(0, np.int64)
        real = found[owner]
        owner, out = owner[real], out[real]
        order = np.argsort(owner, kind="stable")  # outputs of a word stay in the order of its steps
        owner, out = owner[order], out[order]
        sizes = self.pool_sizes[out]
        ids = self.pool[ragged(self.pool_ends[out] - sizes, sizes)]
        return found, ids, np.bincount(owner, sizes, n).astype(np.int64)
