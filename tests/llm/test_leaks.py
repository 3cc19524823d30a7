import random

from brinewell.llm import leaks

R = random.Random(6)
WORDS = ["".join(R.choices("abcdefghijklmnoprstuvw", k=7)) for _ in range(400)]
ITEMS = [(k, " ".join(R.choices(WORDS, k=40)) + ".") for k in range(30)]


def found(text, items=ITEMS, share=1 / 3):
    return {i for i, n, size in leaks.leaks_of(leaks.Items(items), text) if n >= size * share}


def around(text):
    return " ".join(R.choices(WORDS, k=60)) + " " + text + " " + " ".join(R.choices(WORDS, k=60))


def test_whole_and_part():
    w = ITEMS[3][1].split()
    assert found(around(ITEMS[3][1])) == {3}
    assert found(around(" ".join(w[10:24]))) == {3}
    assert found(around(" ".join(w[10:20]))) == set()  # a quarter
    assert found(around(" ".join(w[:7]) + " x y z " + " ".join(w[20:27]) + " q r s t u v " + " ".join(w[33:]))) == set()  # short phrases
    assert found("") == set() and found("x") == set()


def test_writing_makes_no_difference():
    w = ITEMS[5][1].rstrip(".").split()
    forms = [
        " ".join(w).upper(), "<p>" + " <i>".join(w) + "</p>", "\\n# ".join(" ".join(w[k : k + 4]) for k in range(0, 40, 4)), "**" + "**, **".join(w) + "**",
        " ".join(x[:3] + chr(0x200B) + x[3:] for x in w), "\\u0020".join(w), '",\n    "'.join(w), " ".join(x[0] + x for x in w),
    ]
    for f in forms:
        assert found(around(f)) == {5}, f


def test_changed_missing_and_misspelt_words():
    w = ITEMS[7][1].split()
    for k in range(4, 40, 7):
        w[k] = "other"
    w[9] = w[9][:3] + w[9][4:]
    del w[20]
    assert found(around(" ".join(w))) == {7}


def test_order_counts():
    w = ITEMS[9][1].split()
    chunks = [w[k : k + 8] for k in range(0, 40, 8)]
    there = " ".join(x for ch in chunks for x in [*ch, "a", "b", "c", "d", "e", "f"])
    back = " ".join(x for ch in reversed(chunks) for x in [*ch, "a", "b", "c", "d", "e", "f"])
    assert found(there) == {9} and found(back) == set()


def test_ordered_cover_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        parts = []
        for _ in range(r.randrange(7)):
            d, i, n = r.randrange(40), r.randrange(30), r.randint(1, 9)
            parts.append((d, d + n, i, min(30, i + n), r.randint(1, n)))

        def best(after_d, after_i):
            return max([p[4] + best(p[1], p[3]) for p in parts if p[0] >= after_d and p[2] >= after_i], default=0)

        assert leaks.ordered_cover(parts, 30) == best(0, 0)


def test_passages_that_share_a_word_of_the_item():
    w = R.sample(WORDS, 100)
    filler = ["filler"] * 30
    assert list(leaks.leaks_of(leaks.Items([(1, " ".join(w))]), " ".join([*w[:16], *filler, *w[15:40]]))) == [(1, 40, 100)]


def test_a_short_item_with_a_changed_word():
    w = R.sample(WORDS, 21)
    items = [(1, " ".join(w))]
    assert found(around(" ".join([*w[:3], "other", *w[4:8]])), items) == {1}
    assert found(around(" ".join("other" if k % 3 == 2 else x for k, x in enumerate(w))), items) == {1}
    assert found(around(" ".join(w[:6])), items) == set()


def test_long_words_tags_and_breaks():
    w = R.sample(WORDS, 30)
    w[4] = "x" * 60
    items = [(1, " ".join(w))]
    w[4] = "x" * 59
    tag = '<a title="' + "far away " * 60 + '">'
    assert list(leaks.leaks_of(leaks.Items(items), f" {tag} ".join(w))) == [(1, 30, 30)]
    cut = w[6][:3] + "-" + " " * 200 + chr(10) + "#" * 200 + w[6][3:]
    assert list(leaks.leaks_of(leaks.Items(items), " ".join([*w[:6], cut, *w[7:]]))) == [(1, 30, 30)]


def plain_leaks(text, item):
    """The definition without greed: the most words that passages in the item's order can carry, over every choice of equal runs."""
    pairs = sorted((d, i) for d, x in enumerate(text) for i, y in enumerate(item) if x == y)
    known = set(pairs)
    through = {}  # (first pair, last pair) of a passage: most equal words
    for first in pairs:
        best = {(first, 1): 1}  # (pair, words of its run so far, SEED at most)
        for p in pairs:
            for run in range(1, leaks.SEED + 1):
                n = best.get((p, run))
                if n is None:
                    continue
                if (p[0] + 1, p[1] + 1) in known:
                    key = ((p[0] + 1, p[1] + 1), min(run + 1, leaks.SEED))
                    best[key] = max(best.get(key, 0), n + 1)
                if run == leaks.SEED:
                    through[first, p] = max(through.get((first, p), 0), n)
                    for q in pairs:
                        if 0 <= q[0] - p[0] - 1 <= leaks.MAX_GAP and 0 <= q[1] - p[1] - 1 <= leaks.MAX_GAP and q != (p[0] + 1, p[1] + 1):
                            best[q, 1] = max(best.get((q, 1), 0), n + 1)
    whole = [(f, e) for f, e in through if e[1] + 1 - f[1] >= leaks.MIN_PASSAGE]
    found = [(f, e, n) for (f, e), n in through.items() if any(e == y and x[0] <= f[0] and x[1] <= f[1] for x, y in whole)]
    top = {}
    for f, e, n in sorted(found, key=lambda x: x[1]):
        top[e] = max(top.get(e, 0), n + max((v for k, v in top.items() if k[0] < f[0] and k[1] < f[1]), default=0))
    return max(top.values(), default=0)


def test_pairs_against_the_definition():
    r = random.Random(8)
    hits = 0
    for _ in range(300):
        item = r.sample(WORDS, r.randint(12, 40))
        text = r.choices(WORDS, k=10)
        for _ in range(r.randint(1, 3)):
            a = r.randrange(len(item) - 4)
            part = item[a : a + r.randint(4, 16)]
            step = r.choice((0, 0, 3, 4, 6))
            text += ["other" if step and k % step == step - 1 else x for k, x in enumerate(part) if r.random() > 0.04] + r.choices(WORDS, k=r.choice((3, 8, 25)))
        want = plain_leaks(text, item) >= len(item) / 3
        assert found(" ".join(text), [(1, " ".join(item))]) == ({1} if want else set()), (text, item)
        hits += want
    assert 50 < hits < 250


def test_tiles_do_not_overlap():
    item = [1, 2, 3, 4, 1, 2, 3, 4, 5]
    text = [9, 1, 2, 3, 4, 5, 1, 2, 3]
    seeds = [(d, i) for d in range(8) for i in range(8) if text[d : d + 2] == item[i : i + 2]]
    got = leaks.tiles(text, item, seeds)
    assert got == [(1, 4, 5), (6, 0, 3)]


def test_queries(spark):
    docs = spark.createDataFrame([(1, around(ITEMS[2][1] + " " + ITEMS[4][1]), "x"), (2, None, "x"), (3, "", "x"), (4, ITEMS[2][1] * 3000, "x")], "doc_id bigint, text string, key string")
    items = spark.createDataFrame([*ITEMS, (98, ""), (99, None), (77, ITEMS[2][1])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 2), (1, 77), (1, 4), (4, 2), (4, 77)}
    assert leaks.find_leaks(docs, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0
    assert leaks.find_leaks(docs.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, around(ITEMS[k][1])) for k in range(10)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(leaks, "MAX_BLOCK_CHARS", 1000)
    assert {tuple(r)[:2] for r in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(k, k) for k in range(10)}
