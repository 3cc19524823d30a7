"""Matching entities across two sources without keys, by collective graph linkage.

1. Every question is read into attributes (questions.py); rows with equal attributes are one class, so copies cost nothing later.
2. Classes are nodes. Of each word its number of classes and how often it is written with a capital are counted over all questions. A word that is not
   mostly small is a name: both questions must have it. Of the others, words of one source alone are its wording and words that the other question
   leaves out are too: they cost similarity. Two words that both sources use and that stand in each other's place tell things apart.
3. Two classes are candidates if the rarest name of the one is, up to one slip, any word of the other, and they agree in kind, outcome, figure
   and neighbourhood of the deadline. Classes that are alike have a counterpart for every name, so they always meet. Only the class whose rarest
   name it is asks in a block, so a block of a common word is asked by nobody but those who have nothing rarer.
4. An edge weighs what its shared words are worth: the rarer, the more. Meta-blocking drops edges that are light beside the heaviest edge of both
   their ends. An edge between alike classes shares all names of both and is never light.
5. An edge's own similarity falls with every slip, every word without a counterpart and every day between the deadlines; two slips in one name, or another
   letter, leave less than MIN_CONFIDENCE. It is 0 where names have no counterpart, an addition included, or who acts and who is acted on is swapped.
6. Similarities are refined by those of their neighbours until stable. An edge loses where one of its ends has a better one: it counts in proportion to the best.
   It gains where a third class, of either source, is close to both of its ends: so two spellings that are both wrong meet in the right one. A pair
   that no shared name made a candidate becomes an edge this way too.
7. Edges across the sources count from MIN_CONFIDENCE on. Classes are expanded to their rows.

Defined results: rows with a null key or without a content word, and rows whose question and time field name no readable deadline, match
nothing; repeated rows of a key give one row; copies on either side give a row each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.llm.questions import asked, doubled_alike, far_word, same_word
from brinewell.session import checkpointed

MAX_DAYS = 2
LIGHT = 0.5
STABLE = 0.005
MAX_ROUNDS = 12
MIN_CONFIDENCE = 0.5
CLOSE = 0.7  # own similarity from which an edge carries its neighbours' similarity on
SMALL_SHARE = 0.75  # a word written small in more than this share of the places that tell is no name
DAY_NS = 86_400_000_000_000
# What is left of a word's similarity: equal, one slip, one letter doubled in both, two slips or another letter.
EQUAL, SLIP, DOUBLED, FAR = 1.0, 0.92, 0.84, 0.45
PER_DAY = 0.04
_ATTRIBUTES = "side string, key string, kind string, against boolean, figure double, words array<string>, capital array<int>, order array<string>, day bigint"


def read_questions(rows: DataFrame) -> DataFrame:
    """The attributes of rows of (side, key, question, instant_ns); day is the deadline named in the question, else the day of the instant."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for side, k, q, ns in zip(*(c.to_pylist() for c in batch.columns)):
                a = asked(q)
                if a is None:
                    continue
                day = a.day if a.day is not None else (None if ns is None else ns // DAY_NS)
                if day is not None:
                    out.append((side, k, a.kind, a.against, a.figure, list(a.words), list(a.capital), list(a.order), day))
            if out:
                texts = pa.list_(pa.string())
                kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64(), texts, pa.list_(pa.int32()), texts, pa.int64())
                names = [x.split()[0] for x in _ATTRIBUTES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    picked = rows.select("side", "key", "question", "instant_ns").where("key is not null and question is not null")
    return picked.mapInArrow(work, _ATTRIBUTES)


def _classed(rows: DataFrame) -> DataFrame:
    figure = F.coalesce(F.col("figure").cast("string"), F.lit(""))
    return rows.withColumn("class", F.concat_ws("|", "side", "kind", "against", figure, F.array_join("words", " "), F.array_join("order", ","), "day"))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, "^[12]", "")


def _slips(word: Column) -> Column:
    """The word and what is left of it without one letter; words one slip apart share one of these."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, n)))
    return F.when(n >= 3, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def described(rows: DataFrame) -> DataFrame:
    """One row per class; words: its words, the rarest first, each with its number of classes, its worth and whether it is a name."""
    seen = rows.select("class", "side", F.explode(F.arrays_zip("words", "capital")).alias("w")).select("class", "side", _bare(F.col("w.words")).alias("word"), F.col("w.capital").alias("big"))
    each = seen.groupBy("word", "class", "side").agg(F.sum("big").alias("big"), F.count("big").alias("told"))
    small = 1 - F.sum("big") / F.nullif(F.sum("told"), F.lit(0))
    counted = each.groupBy("word").agg(F.count("*").alias("df"), (F.coalesce(small, F.lit(0.0)) <= SMALL_SHARE).alias("name"), (F.min("side") != F.max("side")).alias("both"))
    # A slip of a word is used by whoever uses the word.
    spelled = counted.where("not name").select("word", "both", F.explode(_slips(F.col("word"))).alias("slip"))
    known = spelled.join(spelled.where("both").select("slip").distinct(), "slip", "left_semi").select("word").distinct().withColumn("shared", F.lit(True))
    counted = counted.join(known, "word", "left").withColumn("both", F.coalesce("shared", "both")).drop("shared")
    classes = rows.select("class", "side", "kind", "against", "figure", "words", "order", "day").dropDuplicates(["class"])
    spread = classes.select("class", "side", "kind", "against", "figure", "order", "day", F.explode("words").alias("w")).withColumn("word", _bare(F.col("w")))
    worth = F.when(F.col("name"), 1.0).otherwise(0.5) / F.log(F.col("df") + 1.7)
    valued = spread.join(counted, "word").withColumn("v", F.struct((~F.col("name")).alias("common"), "df", F.col("w").alias("word"), worth.alias("worth"), "name", "both"))
    grouped = valued.groupBy("class", "side", "kind", "against", "figure", "order", "day").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return grouped.select(*[c for c in grouped.columns if c != "v"], F.transform("v", lambda x: F.struct(x.df, x.word, x.worth, x["name"].alias("name"), x.both)).alias("words"))


def candidates(classes: DataFrame) -> DataFrame:
    """The pairs a, b of classes that meet in a block: of one source with a < b, or of both with a of the left one."""
    attributes = [c for c in classes.columns if c != "class"]
    word, first = _bare(F.col("w.word")), F.col("rank") == 0
    each = classes.select("class", *attributes, F.posexplode("words").alias("rank", "w")).withColumn("word", word)
    # Names come first; a class without any asks by all its words.
    each = each.withColumn("asks", F.when(F.col("words")[0]["name"], first).otherwise(F.lit(True)))
    spread = each.withColumn("slip", F.explode(_slips(F.col("word"))))
    keys = spread.select("class", "side", "day", "asks", F.xxhash64("kind", "against", "figure", "slip").alias("block"))
    slot = lambda s: F.floor((F.col("day") + s) / (MAX_DAYS + 1))
    slots = F.array_distinct(F.array(slot(-MAX_DAYS), slot(0), slot(MAX_DAYS)))
    asking = keys.where("asks").select(F.col("class").alias("x"), F.col("side").alias("side_x"), F.col("day").alias("day_x"), "block", F.explode(slots).alias("slot"))
    others = keys.select(F.col("class").alias("y"), F.col("side").alias("side_y"), F.col("day").alias("day_y"), "block", slot(0).alias("slot"))
    met = asking.join(others, ["block", "slot"]).where(f"x <> y and abs(day_x - day_y) <= {MAX_DAYS}")
    forward = (F.col("side_x") < F.col("side_y")) | ((F.col("side_x") == F.col("side_y")) & (F.col("x") < F.col("y")))
    return met.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("b")).distinct()


def _swapped(a: list[str], b: list[str]) -> bool:
    """Whether a word stands between the same two words the other way round."""
    mine = {tuple(x.split(" ")) for x in a}
    return any((c, z, y) in mine and y != z for c, y, z in (x.split(" ") for x in b))


def compared(a: list[dict], b: list[dict], days: int, order_a: list[str] = (), order_b: list[str] = ()) -> tuple[float, float]:
    """Weight and own similarity of two classes that agree in kind, outcome and figure. Words are dicts of word, worth, name and both (sources use it)."""
    rest, quality, shared, alone, contradicted, mine = list(b), 1.0, 0.0, 0.0, False, False
    for w in a:
        one, role = w["word"].lstrip("12"), w["word"][0] if w["word"][0].isdigit() else ""
        best, at = 0.0, -1
        for k, x in enumerate(rest):
            other = x["word"].lstrip("12")
            if (x["word"][0] if x["word"][0].isdigit() else "") != role:
                continue
            q = EQUAL if other == one else SLIP if same_word(other, one) else DOUBLED if doubled_alike(other, one) else 0.0
            if not q and w["name"] and x["name"] and far_word(other, one):
                q = FAR
            if q > best:
                best, at = q, k
        if at < 0:
            contradicted |= w["name"]
            mine |= w["both"]
            alone += w["worth"]
            continue
        x = rest.pop(at)
        quality *= best
        shared += best * min(w["worth"], x["worth"])
    contradicted |= any(x["name"] or (mine and x["both"]) for x in rest)
    alone += sum(x["worth"] for x in rest)
    if contradicted or days > MAX_DAYS or not shared or _swapped(order_a, order_b):
        return shared, 0.0
    return shared, max(0.0, quality * (2 * shared / (2 * shared + alone)) * (1 - PER_DAY * days) if alone else quality * (1 - PER_DAY * days))


def weighed(classes: DataFrame) -> DataFrame:
    """The candidate pairs with across (the sources differ), weight and own similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(c).to_pylist() for c in ("words_a", "words_b", "days", "order_a", "order_b")))
            found = [compared(*p) for p in pairs]
            weight, own = zip(*found) if found else ((), ())
            columns = [batch.column("a"), batch.column("b"), batch.column("across"), pa.array(weight, pa.float64()), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "across", "weight", "own"])

    side = lambda x: classes.select(F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("side", "words", "order", "day")])
    full = candidates(classes).join(side("a"), "a").join(side("b"), "b")
    days, across = F.abs(F.col("day_a") - F.col("day_b")).alias("days"), (F.col("side_a") != F.col("side_b")).alias("across")
    picked = full.select("a", "b", across, "words_a", "words_b", days, "order_a", "order_b")
    return picked.mapInArrow(work, "a string, b string, across boolean, weight double, own double")


def pruned(edges: DataFrame) -> DataFrame:
    """Meta-blocking: without the edges that are light beside the heaviest of both their ends."""
    best = lambda c: F.max("weight").over(Window.partitionBy(c, "across"))
    return edges.withColumn("best_a", best("a")).withColumn("best_b", best("b")).where(F.col("weight") >= LIGHT * F.least("best_a", "best_b")).drop("best_a", "best_b")


def refined(edges: DataFrame) -> DataFrame:
    """a, b, across, own and the stable similarity s of each edge; edges: (a, b, across, own), classes of one source with a < b.

    s is own, in proportion to the best edge across at either end, or the product of the similarities on the way over a third class, if that is more.
    The way goes over two edges of an own similarity of CLOSE or more, so spellings do not drift on from class to class.
    """
    now = edges.select("a", "b", "across", "own", F.col("own").alias("s"))
    side = lambda c: F.substring_index(c, "|", 1)
    day = lambda c: F.element_at(F.split(c, "[|]"), -1).cast("bigint")
    for _ in range(MAX_ROUNDS):
        close = now.where(f"own >= {CLOSE}")
        both = close.select(F.col("a").alias("x"), F.col("b").alias("c"), "s").unionByName(close.select(F.col("b").alias("x"), F.col("a").alias("c"), "s"))
        ways = both.join(both.select(F.col("x").alias("y"), "c", F.col("s").alias("t")), "c").where("x <> y")
        forward = (side("x") < side("y")) & (F.abs(day("x") - day("y")) <= MAX_DAYS)  # only edges across the sources gain
        gains = ways.where(forward).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max(F.col("s") * F.col("t")).alias("gain"))
        best = lambda c: F.max("s").over(Window.partitionBy(c, "across"))
        judged = now.withColumn("top", F.greatest(best("a"), best("b")))
        nothing = F.lit(0.0)
        met = judged.join(gains, ["a", "b"], "full").select(
            "a", "b", F.coalesce("across", F.lit(True)).alias("across"), F.coalesce("own", nothing).alias("own"), F.coalesce("s", nothing).alias("s"),
            F.when(F.col("across"), F.col("own") * F.least(F.lit(1.0), F.try_divide("own", "top"))).otherwise(F.coalesce("own", nothing)).alias("kept"), "gain",
        )
        nxt = checkpointed(met.withColumn("t", F.greatest("kept", F.coalesce("gain", nothing))))
        moved = nxt.agg(F.max(F.abs(F.col("t") - F.col("s")))).first()[0]
        now = nxt.select("a", "b", "across", "own", F.col("t").alias("s"))
        if moved is None or moved <= STABLE:
            break
    return now


def link(rows: DataFrame, note: dict | None = None) -> DataFrame:
    """left_key, right_key and confidence (0..1) of the rows that ask for the same thing.

    rows: (side, key, question, instant_ns) of both sources; the side that sorts first is the left one. note, where given, takes the number of
    decisions that each stage changed.
    """
    rows = checkpointed(_classed(read_questions(rows)))
    edges = checkpointed(weighed(checkpointed(described(rows))))
    kept = pruned(edges).where("own > 0")
    final = refined(kept)
    if note is not None:
        low = F.lit(MIN_CONFIDENCE)
        note["candidates"], note["heavy"] = edges.count(), pruned(edges).count()
        note["alike"] = kept.where(F.col("across") & (F.col("own") >= low)).count()
        note["raised"] = final.where(F.col("across") & (F.col("own") < low) & (F.col("s") >= low)).count()
        note["lowered"] = final.where(F.col("across") & (F.col("own") >= low) & (F.col("s") < low)).count()
    links = final.where(F.col("across") & (F.col("s") >= MIN_CONFIDENCE))
    found = links.join(rows.select(F.col("class").alias("a"), F.col("key").alias("left_key")), "a")
    found = found.join(rows.select(F.col("class").alias("b"), F.col("key").alias("right_key")), "b")
    return found.groupBy("left_key", "right_key").agg(F.max("s").alias("confidence"))
