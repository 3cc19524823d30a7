import random

import pytest

from brinewell.llm.linkage import MIN_CONFIDENCE, compared, link, refined
from brinewell.llm.questions import asked, far_word, meant, same_word

DAY = 86_400 * 10**9


def test_attributes():
    a = asked("Will the Tazesami Junior token close below $1.5k by 25 August 2018?")
    assert (a.kind, a.against, a.figure, a.words, a.day) == ("price", True, 1500.0, ("junior", "tazesami"), 17768)
    b = asked("  Tazesami Junior dips beneath 1,500 USD (deadline Aug. 25 2018)??")
    assert b[:5] == a[:5] and (a.capital, b.capital) == ((1, 1), (1, None))
    assert asked("Over 2.5 million mm rain for Kisenade?").figure == 2_500_000 and asked("Kisenade rainfall > 1.2kmm").figure == 1200
    assert asked("Nibrotize bought by Tatanoka?").words == asked("Tatanoka acquires Nibrotize").words == asked("Tatanoka &amp; Nibrotize deal closes?").words
    assert asked("Tatanoka bought by Nibrotize?").words != asked("Tatanoka acquires Nibrotize").words
    assert asked("Release of Detosepo (Detanebo)?").words == asked("Does Detanebo ship Detosepo?").words == ("1detanebo", "2detosepo")
    assert asked("Cancellation of Detosepo (Detanebo)?").against and not asked("Release of Detosepo (Detanebo)?").against
    assert asked("X Báposire wiins?").words == ("baposire", "x")
    assert asked("") is None and asked(None) is None and asked("Will the?") is None


def test_slips():
    assert same_word("zamabese", "zaambese") and same_word("abcdef", "abdef") and same_word("abcdef", "abccdef") and same_word("abcdef", "bacdef")
    assert not same_word("abcdef", "abcdxf") and not same_word("abcdef", "abcfed") and not same_word("ab", "abc") and not same_word("abcdef", "acbdfe")
    assert meant("takevoer") == "takeover" and meant("beefore") == "before" and meant("tazesami") is None


def test_months_and_years_are_deadlines():
    assert asked("Will Acme announce a dividend by March 2026?")[2:5] == (None, ("acme", "announce", "dividend"), 20543)
    assert asked("Acme insolvent in 2026?").day == 20818 and asked("Acme insolvent before 2026?").day == 20453
    assert asked("Acme above 2026 dollars?").figure == 2026 and asked("Acme above 2026 dollars?").day is None


def test_far_words():
    assert far_word("zgaemaka", "zagemka") and far_word("sovanako", "sovinako") and not far_word("sova", "sovi") and not far_word("sovanako", "tibrenes")


def words(text, small=()):
    return [{"word": w, "worth": 1.0, "name": w not in small, "both": False} for w in text.split()]


@pytest.mark.parametrize(
    "a,b,days,own",
    [
        ("x yyyy", "x yyyy", 2, 0.92), ("x", "x ii", 0, 0), ("1aaaa 2bbbb", "1bbbb 2aaaa", 0, 0), ("aaaa", "aaaa", 3, 0), ("zamabese", "zaambese", 1, 0.92 * 0.96),
        ("zamabbese", "zamabeese", 0, 0.84), ("zgaemaka", "zagemka", 0, 0.45),
    ],
)
def test_own_similarity(a, b, days, own):
    assert compared(words(a), words(b), days)[1] == pytest.approx(own)


def test_words_that_are_no_names_cost_but_do_not_contradict():
    small = ("announce", "declare")
    assert compared(words("acme announce dividend", small), words("acme declare dividend", small), 0) == (2.0, pytest.approx(2 / 3))
    used = [{**w, "both": True} for w in words("acme mayor", ("mayor",))], [{**w, "both": True} for w in words("acme speaker", ("speaker",))]
    assert compared(*used, 0)[1] == 0


def frame(spark, left, right):
    rows = [("1", k, q, None if t is None else t * DAY, "x") for k, q, t in left] + [("2", k, q, None if t is None else t * DAY, "x") for k, q, t in right]
    return spark.createDataFrame(rows, "side string, key string, question string, instant_ns bigint, class string")


def linked(spark, left, right):
    return {(r.left_key, r.right_key): r.confidence for r in link(frame(spark, left, right)).collect()}


def test_links(spark):
    left = [
        ("p1", "Will the Amber Cup be won by Zibrethire?", 100), ("p2", "Amber Cup elimination: Zibrethire", 100), ("p3", "Rimoreno rainfall > 120 mm", 100),
        ("p4", "Rimoreno rainfall > 120 mm", 130), ("p5", "Rimoreno II rainfall > 120 mm", 100), ("p6", "Tatanoka acquires Nibrotize", 50), (None, "Rimoreno rainfall > 120 mm", 100),
        ("p7", None, 3), ("p8", "Rimoreno rainfall > 120 mm", None), ("p3", "Rimoreno rainfall > 120 mm", 100),
    ]
    right = [
        ("m1", "Amber Cup: champions are Zibrethire?", 101), ("m2", "Will Zibrethiire be knocked out of the Amber Cup?", 98), ("m3", "Rainfall in Rimoreno above 120 millimetres?", 102),
        ("m4", "Rainfall in Rimoreno below 120 millimetres?", 100), ("m5", "Rainfall in Rimoreno above 125 millimetres?", 100), ("m6", "Nibrotize bought by Tatanoka?", 51),
        ("m7", "Tatanoka bought by Nibrotize?", 51), ("m8", "", 1), ("m9", "Rainfall in Rimoreno II above 120 millimetres?", 103), ("m3b", "Rainfall in Rimoreno above 120 millimetres?", 102),
    ]
    got = linked(spark, left, right)
    assert set(got) == {("p1", "m1"), ("p2", "m2"), ("p3", "m3"), ("p3", "m3b"), ("p6", "m6")}
    assert all(0.5 <= v <= 1 for v in got.values())


def test_two_wrong_spellings_meet_in_the_right_one(spark):
    got = linked(spark, [("p", "Zgaemaka rainfall > 192 mm", 10), ("q", "Zagemaka rainfall > 192 mm", 10)], [("m", "Rainfall in Zagemka above 192 millimetres?", 10)])
    assert set(got) == {("p", "m"), ("q", "m")} and got["p", "m"] < got["q", "m"]


def test_slips_in_other_words_than_the_rarest(spark):
    """Two slips take both places of the rarest words on one side; the other side's rarest are the two words without a slip."""
    left = [("p", "Alpharo Bravoti Castelu Deltami rainfall > 120 mm", 10)]
    more = [(f"x{k}", f"Alpharo Bravoti Sova{chr(97 + k)}nako rainfall > 120 mm", 500 + 9 * k) for k in range(5)]
    right = [("m", "Rainfall in Alhparo Brvaoti Castelu Deltami above 120 millimetres?", 10)]
    right += [("n", "Rainfall in Castelu Deltami Zornako above 120 millimetres?", 900)]
    assert set(linked(spark, left + more, right)) == {("p", "m")}


def test_a_hot_question(spark):
    """A third of all rows ask one thing; its copies are one node."""
    left = [(f"p{k}", "Rimoreno rainfall > 120 mm", 100) for k in range(60)] + [(f"x{k}", f"Over {k} mm rain for Sova{k // 26}{chr(97 + k % 26)}nako", 100) for k in range(100)]
    got = linked(spark, left, [("m", "Rainfall in Rimoreno above 120 millimetres?", 101)])
    assert set(got) == {(f"p{k}", "m") for k in range(60)}


def test_nothing(spark):
    assert linked(spark, [], []) == {}
    assert linked(spark, [("p", "Rimoreno rainfall > 120 mm", 1)], []) == {}


def test_words_outside_the_vocabulary(spark):
    left = [("p1", "Will Acme announce a dividend by June 3, 2018?", 1), ("p2", "Will Argentina beat Brazil?", 50), ("p3", "Will Norway ratify the treaty?", 80)]
    right = [("m1", "Acme to declare dividend by 3 June 2018", 1), ("m2", "Does Argentina beat Brazil?", 51), ("m3", "Will Brazil beat Argentina?", 50), ("m4", "Will Norway revoke the convention?", 80)]
    assert set(linked(spark, left, right)) == {("p1", "m1"), ("p2", "m2")}


def test_who_acts_counts_in_small_writing_too(spark):
    left = [("p", "Will Argentina beat Brazil?", 50), ("q", "Some Other Cup in small: will peru beat chile?", 9)]
    assert set(linked(spark, left, [("m", "argentina beat brazil?", 50), ("n", "brazil beat argentina?", 50)])) == {("p", "m")}


def test_rounds_decide(spark):
    """(a, x) is too weak by itself, but c is close to both; (d, y) is strong enough, but d and y have far better partners each."""
    edges = [("1|a|5", "2|x|5", True, 0.45), ("1|a|5", "1|c|5", False, 0.92), ("1|c|5", "2|x|5", True, 0.92), ("1|d|5", "2|y|5", True, 0.6), ("1|d|5", "2|z|5", True, 1.0), ("1|e|5", "2|y|5", True, 1.0)]
    got = {(r.a[2], r.b[2]): r.s for r in refined(spark.createDataFrame(edges, "a string, b string, across boolean, own double")).collect()}
    assert got["a", "x"] == pytest.approx(0.92 * 0.92) and got["d", "y"] < MIN_CONFIDENCE and got["d", "z"] == got["e", "y"] == 1.0
    lone = refined(spark.createDataFrame(edges[3:4], "a string, b string, across boolean, own double")).first()
    assert lone.s == 0.6


def test_rounds_raise_a_pair_that_no_block_made(spark):
    note = {}
    rows = frame(spark, [("p", "Zgaemaka rainfall > 192 mm", 10), ("q", "Zagemaka rainfall > 192 mm", 10)], [("m", "Rainfall in Zagemka above 192 millimetres?", 10)])
    assert link(rows, note).count() == 2 and note["raised"] == 1 and note["lowered"] == 0


def test_one_question_in_many_spellings(spark):
    """A hot question whose rows have up to two slips each: what the attributes alone leave apart, the rounds bring together."""
    r = random.Random(1)

    def written(text):
        w = text.split()
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            k = r.randrange(len(w))
            if len(x := w[k]) > 4:
                i = r.randrange(1, len(x) - 1)
                w[k] = r.choice((x[:i] + x[i + 1 :], x[:i] + x[i] + x[i:], x[:i] + x[i + 1] + x[i] + x[i + 2 :]))
        return " ".join(w)

    left = [(f"p{k}", written("Will Rimorenoka win the Amber Cup"), 100 + r.randrange(3)) for k in range(150)]
    right = [(f"m{k}", written("Amber Cup winner Rimorenoka"), 100 + r.randrange(3)) for k in range(150)]
    note = {}
    assert link(frame(spark, left, right), note).count() > 0.95 * 150 * 150
    assert note["raised"] > note["lowered"] and note["raised"] > 0.3 * note["alike"]


def test_candidates_grow_with_the_rows(spark):
    """One event asks for ever more names: the event's words are in every question, but nobody asks by them."""
    r = random.Random(3)
    names = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)).capitalize() for _ in range(220)]
    made = lambda own: ([(x, f"Will {x} win the Amber Cup?", 100) for x in own], [(x, f"Amber Cup winner: {x}", 100) for x in own])
    few, many = {}, {}
    assert link(frame(spark, *made(names[:20])), few).count() == 20 and link(frame(spark, *made(names[20:])), many).count() == 200
    assert (few["candidates"], many["candidates"]) == (20, 200)
