"""Against brute force: fingerprints bit by bit, links by comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from reelspark.llm import components, covering, simhash
from reelspark.llm.common import forest


def slow_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=4):
    """doc_id -> smallest doc_id that links reach, for rows (doc_id, fingerprint)."""
    roots = list(range(len(rows)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                roots[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [least.get(root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", "A b", "A b c d", "Ä x ÀB\x0bc d e", "a b c d e f g a b c d", "w " * 500])
def test_fingerprint(text):
    got = simhash.fingerprint(None if text is None else text.encode(), 4)
    assert got == slow_fingerprint(text)


@pytest.mark.parametrize("part", [covering.GOLAY, covering.HAMMING_7, covering.HAMMING_3])
def test_every_word_has_one_home(part):
    code = covering.Anchors([part], 0, 1)
    words = np.random.default_rng(1).integers(0, 1 << part.bits, 3000, dtype=np.uint64)
    index, anchor, cost = code.visits(words)
    home = cost == 0
    assert (index[home] == np.arange(len(words))).all()
    assert (np.bitwise_count(anchor[home] ^ words) <= part.radius).all()
    assert (np.bitwise_count(anchor ^ words[index]) <= part.radius + 1).all()


@pytest.mark.parametrize("number, bits", [(0, 2), (1, 1)])
def test_a_partner_visits_the_home(number, bits):
    code = simhash._codes()[number]
    rng = random.Random(3)
    span = range(34) if number == 0 else range(34, 64)
    words = [rng.getrandbits(64) for _ in range(200)]
    near = [w ^ sum(1 << b for b in rng.sample(span, bits)) for w in words]
    i, anchor, cost = code.visits(np.array(words, dtype=np.uint64))
    homes = dict(zip(i[cost == 0].tolist(), anchor[cost == 0].tolist(), strict=True))
    j, seen, _ = code.visits(np.array(near, dtype=np.uint64))
    visited = set(zip(j.tolist(), seen.tolist(), strict=True))
    assert all((k, homes[k]) in visited for k in range(200))


def test_links_between_clusters(spark):
    """Chains, a dense ball and lone fingerprints; few homes a tile, so cells are cut."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    x = fps[0]
    for _ in range(40):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.append(x)
    fps += [fps[1] ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(120)]
    fps = sorted(set(fps))
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp bigint"), 4, tile=3)
    rows = components.connected_components(edges).collect()
    root = {r.node: r.root for r in rows}
    want = slow_components(list(enumerate(fps)))
    groups = {}
    for i, (f,) in enumerate(signed):
        groups.setdefault(want[i], set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_forest_connects_the_same():
    a, b = np.array([1, 2, 5, 7, 1]), np.array([2, 3, 6, 7, 3])
    root, node = forest(a, b)
    assert sorted(zip(root, node, strict=True)) == [(1, 2), (1, 3), (5, 6)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(
        spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query(spark, docs, odd, none):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(80)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " end") for i, t in enumerate(base)]
    rows += [(200 + i, t.upper()) for i, t in enumerate(base)] + [(300, ""), (301, None), (299, "  ")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(rows)).collect()}
    want = [(k, slow_fingerprint(t)) for k, t in rows]
    assert {k: v[0] for k, v in got.items()} == {k: f"{f:016x}" for k, f in want}
    assert [got[k][1] for k, _ in rows] == slow_components(want)
    assert simhash.simhash_components(odd).count() == odd.count()
    assert simhash.simhash_components(none).count() == 0
