import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewell.llm import encode, lexicon

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoder():
    ranks = encode.read_ranks()
    return encode.Encoder(ranks, encode.build_lexicon(ranks, ["import numpy as np\n" * 5, "we're here, it's 2018"]))


def ids(encoder, texts):
    flat, sizes = encoder.encode(texts)
    out, at = [], 0
    for n in sizes.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


TEXTS = ["", " ", "\n\n  x", "it's we'll 'S ''s 's's", "a  b   \t\n", "naïve ≠ 中文 🔥!", "x" * 5000, "1234567 ½ ², ٣", "<|endoftext|>", "​ \x1c\x85 '", "don't\n'll", "é'd", "trailing  "]


def test_equals_the_tokenizer(encoder):
    assert ids(encoder, TEXTS) == [encoder.exact.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab zZ'stremdlv \t\n\r0９é̀中  ​!?-_#\U0001f600")), max_size=14), max_size=5))
def test_mixed_signs(encoder, texts):
    assert ids(encoder, texts) == [encoder.exact.encode_ordinary(t) for t in texts]


def test_round_trip(encoder):
    assert [encoder.exact.decode(x) for x in ids(encoder, TEXTS)] == TEXTS


def test_automaton_is_minimal_and_ranks_words():
    words = sorted({w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "a")})
    edges, final = lexicon.minimal_automaton(words)
    seen, todo = {0}, [0]
    while todo:
        for t in edges[todo.pop()].values():
            if t not in seen:
                seen.add(t)
                todo.append(t)
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(seen) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})  # one state for each set of endings
    assert final[0] is False


@pytest.mark.parametrize("count", [0, 1, 50, 3000])
def test_lexicon_round_trip(tmp_path, count):
    import numpy as np

    r = random.Random(count)
    entries = {bytes(r.choices(range(256), k=r.randint(1, 6))): [r.randrange(9) for _ in range(r.randint(1, 3))] for _ in range(count)}
    lexicon.save(lexicon.compile_lexicon(entries), tmp_path)
    arrays = lexicon.mapped(str(tmp_path))
    asked = list(entries) + [b"zz" * k for k in range(1, 9)] + [w[:-1] for w in entries if len(w) > 1] + [b""]
    data = np.frombuffer(b"".join(asked) or b"\0", np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    ranks = lexicon.ranks(arrays, data, ends - [len(w) for w in asked], ends)
    for w, k in zip(asked, ranks.tolist()):
        assert (k >= 0) == (w in entries)
        if k >= 0:
            assert arrays["ids"][arrays["offsets"][k] : arrays["offsets"][k + 1]].tolist() == entries[w]


def test_documents(spark):
    rows = spark.createDataFrame([(1, "hello  world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_texts(rows, "doc_id", "text").collect())
    assert got == [(1, [31373, 220, 995]), (2, []), (3, []), (3, [])]
    assert encode.encode_texts(rows.where("false"), "doc_id", "text").count() == 0
