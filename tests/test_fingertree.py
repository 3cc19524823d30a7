import random

from hypothesis import given, settings
from hypothesis import strategies as st

from brinewell.operators.fingertree import FingerTree


def depth_ok(node, parent=None):
    assert node.parent is parent
    assert len(node.keys) == len(node.items)
    assert node.keys == sorted(node.keys)
    if not node.leaf:
        for k, c in zip(node.keys, node.items):
            assert k <= c.keys[0]
            depth_ok(c, node)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.just("add"), st.integers(0, 400)), st.tuples(st.just("cut"), st.integers(0, 400))), max_size=300))
def test_against_a_dictionary(steps):
    tree, plain = FingerTree(lambda a, b: a + b), {}
    for what, key in steps:
        if what == "add":
            tree.insert(key, 1)
            plain[key] = plain.get(key, 0) + 1
        else:
            gone = list(tree.evict_below(key))
            assert gone == sorted((k, v) for k, v in plain.items() if k < key)
            plain = {k: v for k, v in plain.items() if k >= key}
        assert list(tree.entries()) == sorted(plain.items())
        assert tree.total() == (sum(plain.values()) or None)
        depth_ok(tree.root)
        assert tree.last_key() == (max(plain) if plain else None)


def test_mostly_in_order():
    r, tree, plain = random.Random(3), FingerTree(lambda a, b: a + b), {}
    for k in range(20_000):
        key = k if r.random() < 0.95 else max(0, k - r.randrange(500))
        tree.insert(key, 1)
        plain[key] = plain.get(key, 0) + 1
        if k % 1000 == 0:
            list(tree.evict_below(k - 700))
            plain = {a: b for a, b in plain.items() if a >= k - 700}
    assert list(tree.entries()) == sorted(plain.items())
