"""The trie against dictionaries, and how often its levels are asked."""

import collections
import math

import numpy as np

from swatchwork.llm import trie


def test_each_level_is_asked_once_for_each_key(monkeypatch):
    g = np.random.default_rng(3)
    roots = np.sort(g.integers(0, 1 << 63, 9, dtype=np.uint64))
    seen = sorted({tuple(map(int, x)) for x in g.integers(0, [8, 6, 7], (120, 3))})  # the last root is followed by nothing
    counts = g.integers(1, 50, len(seen))
    root, before, word = np.array(seen).T
    totals = np.bincount(root, counts, len(roots)).astype(np.int64)
    built = trie.Trie.open(trie.Trie.build(roots, root, before.astype(np.uint64), word.astype(np.uint64), counts, totals, (256.0, 16.0)))
    context, pair = collections.Counter(), collections.Counter()
    for (r, b, w), n in zip(seen, counts.tolist(), strict=True):
        context[r, b] += n
        pair[r, w] += n
    entries = [(r, b, w) for r in range(10) for b in range(8) for w in range(8)]  # unknown roots, contexts and words too
    asked = np.array(entries * 20)
    name = np.append(roots, np.uint64(5))[asked[:, 0]]

    find, keys = trie.EliasFano.find, []
    monkeypatch.setattr(trie.EliasFano, "find", lambda self, x, *a: (keys.append(len(x)), find(self, x, *a))[1])
    got = built.probabilities(name, asked[:, 1].astype(np.uint64), asked[:, 2].astype(np.uint64))
    assert sum(keys) <= 10 + 2 * 9 * 8 + len(seen) + 9 * 8 * 8

    count = dict(zip(seen, counts.tolist(), strict=True))
    near = lambda got, want: got == want == 0 or abs(math.log2(got / want)) <= 0.51 / trie.STEPS
    for (r, b, w), triple, follow, weight in zip(asked.tolist(), *got, strict=True):
        total = int(totals[r]) if r < len(roots) else 0
        assert near(triple, count.get((r, b, w), 0) / (context[r, b] + 16))
        assert near(follow, pair[r, w] / (total + 256))
        assert near(weight, 16 / (context[r, b] + 16))


def test_a_trie_without_entries_knows_nothing():
    none = np.zeros(0, np.int64)
    built = trie.Trie.open(trie.Trie.build(np.array([3, 5], np.uint64), none, none.astype(np.uint64), none.astype(np.uint64), none, np.zeros(2, np.int64), (256.0, 16.0)))
    got = built.probabilities(np.array([3, 3, 4], np.uint64), np.array([1, 2, 1], np.uint64), np.array([1, 1, 1], np.uint64))
    assert [x.tolist() for x in got] == [[0.0] * 3, [0.0] * 3, [1.0] * 3]
