import random
import re

import numpy as np
import pyarrow as pa

from stratalore.llm import near_copies as nc


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def naive_groups(texts):
    """Groups of keys whose texts are linked by a similarity of 0.8 or more."""
    keys, sets = list(texts), [shingles(t) for t in texts.values()]
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                up[find(i)] = find(j)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).append(k)
    return list(groups.values())


def family(rng, copies, n=120):
    """A text and near copies of it, each with a few words changed, some beyond the bound."""
    words = [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [" ".join(words)]
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_profiles_match_plain_sets():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one two", "a b c d", "a b c d e", "A b\tC d  e f", *family(rng, 3), "x " * 3000]
    h, sizes = nc.shingle_sets(pa.array(texts))
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    packed = [set(np.frombuffer(p, "<u4").tolist()) for p in nc._packed(h, sizes)]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(packed[i] & packed[j]) == len(shingles(texts[i]) & shingles(texts[j]))
    node, fp, bands = nc.profile(pa.array(texts))
    assert node[0] == node[1] == node[2] and fp[0] == 0 and len(set(node.tolist())) == len(texts) - 2 and bands.shape == (len(texts), nc.BANDS)
    again = nc.profile(pa.array(["z", *texts]).slice(1))
    assert all((a == b).all() for a, b in zip(again, (node, fp, bands)))


def test_recall_and_exact_groups(spark):
    """At least nine in ten of the copies that brute force drops are dropped, and nothing else is."""
    rng = random.Random(2)
    texts = [t for _ in range(40) for t in family(rng, rng.randrange(6))]
    texts += texts[:20] + [None, None, "", " "] + [f"short text {i}" for i in range(20)] + [t.upper() for t in texts[20:40]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "f", i, "k") for i, t in enumerate(texts)], "doc_id long, text string, file string, row long, node string").repartition(3)
    groups = naive_groups(dict(enumerate(texts)))
    kept = {r.doc_id for r in nc.drop_near_copies(docs).collect()}
    want = {min(g) for g in groups}
    gone = set(range(len(texts))) - want
    assert want <= kept and len(gone & kept) <= 0.1 * len(gone)
    assert len(gone) > 80


def test_ties_nulls_and_empty_tables(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "A B c d e f g"), (None, "other"), (None, "other"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = {r.doc_id: r.text for r in nc.drop_near_copies(docs).collect()}
    assert set(kept) == {None, 3, 5} and kept[None] == "other" and kept[3] is None and kept[5].lower() == "a b c d e f g"
    assert nc.drop_near_copies(docs).count() == 3 and nc.drop_near_copies(docs.limit(0)).count() == 0


def test_pairs_that_are_neither_first_nor_last_of_a_band(spark):
    """Alike texts that share bands with others only between the first and the last node are one group."""
    # Nodes 2 and 3 hold the same words; 1 and 4 share their bands but are other texts.
    near = [f"w{i}" for i in range(100)]
    texts = {1: " ".join(f"a{i}" for i in range(100)), 2: " ".join(near), 3: " ".join([*near[:-1], "x"]), 4: " ".join(f"z{i}" for i in range(100))}
    node = lambda: spark.createDataFrame([(k, [0, -1, 0x5555555555555555, 0x0F0F0F0F0F0F0F0F][k - 1], [7] * nc.BANDS) for k in texts], "node long, fp long, bands array<bigint>")
    roots = spark.createDataFrame([], "of long, root long")
    first = {(r.u, r.v) for r in nc._proposed(node(), 2).collect()}
    done = spark.createDataFrame(sorted(first), "u long, v long")
    rest = {(r.u, r.v) for r in nc._apart(node(), roots, done).collect()}
    assert first | rest == {(u, v) for u in texts for v in texts if u > v} and not first & rest and (3, 2) in rest
    joined = spark.createDataFrame([(3, 2), (2, 2)], "of long, root long")
    assert (3, 2) not in {(r.u, r.v) for r in nc._apart(node(), joined, done).collect()}


def test_no_group_is_split(spark):
    """Large families of near copies give the groups that brute force gives."""
    rng = random.Random(8)
    texts = [t for _ in range(4) for t in family(rng, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in nc.drop_near_copies(docs).collect()} == {min(g) for g in naive_groups(dict(enumerate(texts)))}


def test_similar_sets_meet_at_a_rare_member():
    """Of every two similar sets, the first common member is kept on both sides and allows the other's size."""
    rng = np.random.default_rng(5)
    sets, slots = [], rng.integers(0, 50, nc.SLOTS)
    for _ in range(30):
        whole = rng.choice(2**32, int(rng.integers(1, 60)), replace=False).astype(np.uint32)
        sets += [np.unique(np.concatenate([whole[rng.random(len(whole)) < 0.93], rng.integers(0, 2**32, int(rng.integers(0, 3)), np.uint32)])) for _ in range(6)]
    kept = [{m: most for m, most in zip(*map(np.ndarray.tolist, nc.rarest(s, slots, (4, 5))), strict=True)} for s in sets]
    similar = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b, common = sets[j], len(np.intersect1d(a, sets[j]))
            if common and 5 * common >= 4 * (len(a) + len(b) - common):
                similar += 1
                assert any(kept[i][m] >= len(b) and kept[j][m] >= len(a) for m in kept[i].keys() & kept[j].keys())
    assert similar > 100


def test_crowded_bands_lose_no_link_and_make_few_pairs(spark):
    """In one band of many merely alike texts, all links are proposed, by a small part of the pairs."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(300):
        w = list(words)
        for at in rng.sample(range(120), 6 + k % 5):
            w[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
        if k % 30 == 0:
            texts.append(f"{texts[-1]} end")
    h, sizes = nc.shingle_sets(pa.array(texts))
    packed = nc._packed(h, sizes)
    node = nc.nodes_of(packed).tolist()
    nodes = spark.createDataFrame([(n, i, [7] * nc.BANDS) for i, n in enumerate(node)], "node long, fp long, bands array<bigint>")
    sets = spark.createDataFrame([(n, bytearray(p)) for n, p in zip(node, packed, strict=True)], "node long, hashes binary")
    none = spark.createDataFrame([], "of long, root long"), spark.createDataFrame([], "u long, v long")
    rest = {(r.u, r.v) for r in nc._apart(nodes, *none, lambda named: sets.join(named, "node", "left_semi")).collect()}
    plain = {(r.u, r.v) for r in nc._apart(nodes, *none).collect()}
    of = {n: shingles(t) for n, t in zip(node, texts, strict=True)}
    alike = {(u, v) for u, v in plain if 5 * len(of[u] & of[v]) >= 4 * len(of[u] | of[v])}
    assert len(plain) == len(texts) * (len(texts) - 1) // 2 and len(alike) >= 10
    assert alike <= rest <= plain and len(rest) < len(plain) / 20


def test_the_most_central_text_of_a_band_is_paired(spark):
    """The text whose bands hold most others is paired with all of them, be it the first, the last or neither."""
    rows = [(k, k, [k if b % 5 == k % 5 else 0 for b in range(nc.BANDS)]) for k in range(1, 12) if k != 6] + [(6, 6, [0] * nc.BANDS)]
    pairs = {(r.u, r.v) for r in nc._proposed(spark.createDataFrame(rows, "node long, fp long, bands array<bigint>"), 2).collect()}
    assert {(max(6, k), min(6, k)) for k in range(1, 12) if k != 6} <= pairs
