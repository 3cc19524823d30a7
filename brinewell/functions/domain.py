"""Column functions of the prediction-market domain. All are null where an argument is null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewell.functions.instants import days_from_civil, last_day

DAY_NS = 86_400_000_000_000
# ISO 8601 in extended and basic form: calendar or week date, alone or with a time, whose smaller units may be missing, and an offset.
ISO = (
    r"(?s)\A(?:(?<y1>\d{4})-(?<m1>\d\d)-(?<d1>\d\d)|(?<y2>\d{4})(?<m2>\d\d)(?<d2>\d\d)|(?<y3>\d{4})-W(?<w1>\d\d)(?:-(?<u1>\d)(?!\d))?|(?<y4>\d{4})W(?<w2>\d\d)(?<u2>\d)?)"
    r"(?:.(?<h1>\d\d)(?::(?<i1>\d\d)(?::(?<s1>\d\d)(?:[.,](?<f1>\d+))?)?|(?<i2>\d\d)(?:(?<s2>\d\d)(?:[.,](?<f2>\d+))?)?)?"
    r"(?:Z|(?<sign>[+-])(?<oh>\d\d)(?::(?<om1>\d\d)(?::(?<os1>\d\d)(?:\.\d+)?)?|(?<om2>\d\d)(?:(?<os2>\d\d)(?:\.\d+)?)?)?)?)?\z|\A.*\z"
)
_ISO_PARTS = {
    "y": "${y1}${y2}${y3}${y4}", "m": "${m1}${m2}", "d": "${d1}${d2}", "w": "${w1}${w2}", "u": "${u1}${u2}", "h": "${h1}", "i": "${i1}${i2}", "s": "${s1}${s2}",
    "f": "${f1}${f2}", "sign": "${sign}", "oh": "${oh}", "om": "${om1}${om2}", "os": "${os1}${os2}",
}

# Needles in order, and the category a group slug that contains one stands for; the first needle that occurs wins.
CATEGORY_NEEDLES = (
    ("f1", "F1"), ("formula-1", "F1"), ("nba", "NBA"), ("basketball", "NBA"), ("tennis", "Tennis"), ("premier-league", "Football"),
    ("soccer", "Football"), ("football", "Football"), ("bitcoin", "Crypto"), ("ethereum", "Crypto"), ("crypto", "Crypto"), ("ai", "Tech"),
    ("artificial-intelligence", "Tech"), ("agi", "Tech"), ("technology", "Tech"), ("us-politics", "Politics"), ("politics", "Politics"),
    ("elections", "Politics"), ("economics", "Macro"), ("inflation", "Macro"), ("business", "Macro"), ("finance", "Macro"),
)


def category_of(slugs: Column) -> Column:
    """The category of an array of slugs; needles match inside words, as 'ai' does in 'ukraine'."""
    low = F.transform(slugs, lambda s: F.lower(s))

    def within(needle: str) -> Column:
        return F.exists(low, lambda s: F.contains(s, F.lit(needle)))

    return F.coalesce(*[F.when(within(n), F.lit(c)) for n, c in CATEGORY_NEEDLES])


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def iso_ns(text: Column) -> Column:
    """ISO 8601 text to epoch nanoseconds by whole microseconds; a date alone is its midnight, no zone means UTC.

    Any one sign may stand between date and time; digits beyond the microsecond are cut. Null for anything else, for impossible
    dates and times, and for what 64 bits can't hold.
    """
    names = list(_ISO_PARTS)

    def assembled(part: Column) -> Column:
        number = lambda k: F.get(part, F.lit(names.index(k))).try_cast("int")
        zero = lambda k: F.coalesce(number(k), F.lit(0))
        y, m, d, week = number("y"), number("m"), number("d"), number("w")
        fourth = days_from_civil(y, F.lit(1), F.lit(4))
        monday = fourth - F.pmod(fourth + 3, F.lit(7))  # of the first week, which holds the fourth of January
        following = days_from_civil(y + 1, F.lit(1), F.lit(4))
        day = F.coalesce(number("u"), F.lit(1))
        of_week = F.when(week.between(1, F.floor((following - F.pmod(following + 3, F.lit(7)) - monday) / 7)) & day.between(1, 7), monday + (week - 1) * 7 + day - 1)
        days = F.when(week.isNotNull(), of_week).when(m.between(1, 12) & (d >= 1) & (d <= last_day(y, m)), days_from_civil(y, m, d))
        zone = zero("oh") * 3600 + zero("om") * 60 + zero("os")
        fine = (y >= 1) & (zero("h") <= 23) & (zero("i") <= 59) & (zero("s") <= 59) & (zone < 86_400)
        offset = F.when(F.get(part, F.lit(names.index("sign"))) == "-", -zone).otherwise(zone)
        seconds = days * 86_400 + zero("h") * 3600 + zero("i") * 60 + zero("s") - offset
        micros = F.coalesce(F.rpad(F.substring(F.get(part, F.lit(names.index("f"))), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
        return F.when(fine, F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000).cast("bigint")), micros * 1000))

    parts = F.split(F.regexp_replace(text, F.lit(ISO), F.lit("\x01".join(_ISO_PARTS.values()))), "\x01")
    return F.get(F.transform(F.array(parts), assembled), F.lit(0))


def ms_to_iso(ms: Column) -> Column:
    """D19: '' for null and 0; microseconds are printed only where they are not zero."""
    at = F.timestamp_millis(ms)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(ms.isNull() | (ms == 0), "").otherwise(
        F.concat(whole, F.when(ms % 1000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    )


def ns_to_date(ns: Column) -> Column:
    """The UTC date as text, floored for times before 1970 too."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ns - F.pmod(ns, F.lit(DAY_NS))) / DAY_NS).cast("int")), "yyyy-MM-dd")


def resolution_label(is_resolved: Column, resolution: Column) -> Column:
    """1 for YES, 0 for NO, null for every other or no resolution."""
    return F.when(is_resolved & (resolution == "YES"), 1).when(is_resolved & (resolution == "NO"), 0)


def gross_violation(op: Column, left: Column, right: Column) -> Column:
    """By how much left <= right or left >= right is broken; 0 where it holds."""
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(F.lit(0.0), F.when(op == ">=", right - left).otherwise(left - right)))


def divergence_direction(edge: Column) -> Column:
    """D7."""
    return F.when(edge.isNotNull(), F.when(edge > 0, "manifold_higher").otherwise("polymarket_higher"))


def edge_side(edge: Column) -> Column:
    """The side that an edge favours."""
    return F.when(edge.isNotNull(), F.when(edge >= 0, "YES").otherwise("NO"))


def expected_value(p_model: Column, p_market: Column, fee: float = 0.0, slippage: float = 0.0) -> Column:
    """Of a unit stake on the favoured side, after costs; the products are kept as they are, which matters to the last bit."""
    yes = p_model - p_market >= 0
    win = F.when(yes, p_model).otherwise(1 - p_model)
    price = F.when(yes, p_market).otherwise(1 - p_market)
    return win * (1 - price) - (1 - win) * price - fee - slippage


def pool_yes(probability: Column, liquidity: Column, weight: Column) -> Column:
    """The yes side of a pool with the given probability; null unless 0 < probability < 1 and liquidity > 0."""
    ratio = (probability * (1 - weight)) / (weight * (1 - probability))
    return F.when((probability > 0) & (probability < 1) & (liquidity > 0), liquidity / (1 + ratio))


def pool_no(probability: Column, liquidity: Column, weight: Column) -> Column:
    return liquidity - pool_yes(probability, liquidity, weight)


def pool_probability(yes: Column, no: Column, weight: Column) -> Column:
    """D9."""
    return weight * no / (weight * no + (1 - weight) * yes)


def pool_invariant(yes: Column, no: Column, weight: Column) -> Column:
    """What a fill keeps."""
    return F.pow(yes, weight) * F.pow(no, 1 - weight)


def fill_shares(side: Column, stake: Column, yes: Column, no: Column, weight: Column) -> Column:
    """Shares bought with stake."""
    yes_after = yes * F.pow(no / (no + stake), (1 - weight) / weight)
    no_after = no * F.pow(yes / (yes + stake), weight / (1 - weight))
    return F.when(side == "YES", yes + stake - yes_after).when(side == "NO", no + stake - no_after)


def settle(side: Column, outcome: Column, shares: Column, cost: Column) -> Column:
    """Profit of a position once the outcome (1 or 0) is known."""
    won = ((side == "YES") & (outcome == 1)) | ((side == "NO") & (outcome == 0))
    return F.when(won, shares).otherwise(F.lit(0.0)) - cost


def date_factor(gap_days: Column, decay_days: float = 30.0) -> Column:
    """1 for no gap, falling to 0 at decay_days; 1 where the gap is unknown."""
    return F.when(gap_days.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(gap_days) / decay_days))


def rounded(x: Column, scale: float) -> Column:
    """x times scale to the next whole number, halves up: a form that compares equal across engines."""
    return F.floor(x * scale + 0.5).cast("bigint")


DASH = "\u2014"


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals; a half goes up, away from what is less."""
    scaled = F.floor(x * 10**digits + 0.5).cast("bigint")
    size = F.lpad(F.abs(scaled).cast("string"), F.greatest(F.length(F.abs(scaled).cast("string")), F.lit(digits + 1)), "0")
    whole = F.concat(F.left(size, F.length(size) - digits), F.lit("."), F.right(size, F.lit(digits))) if digits else size
    return F.concat(F.when(scaled < 0, "-").otherwise(""), whole)


def percent(p: Column, digits: int = 1) -> Column:
    """A probability as a percentage; null and NaN give a dash, here and below."""
    return F.when(_missing(p), DASH).otherwise(F.concat(fixed(p * 100, digits), F.lit("%")))


def signed_points(edge: Column) -> Column:
    """An edge in percentage points with its sign."""
    return F.when(_missing(edge), DASH).otherwise(F.concat(F.when(edge * 100 >= 0, "+").otherwise(""), fixed(edge * 100, 1), F.lit(" pp")))


def signed_value(ev: Column) -> Column:
    """An expected value of a unit stake with its sign."""
    return F.when(_missing(ev), DASH).otherwise(F.concat(F.when(ev >= 0, "+").otherwise(""), fixed(ev, 3)))


def minute_text(ns: Column) -> Column:
    """Epoch nanoseconds as a UTC minute."""
    ms = (ns - F.pmod(ns, F.lit(1_000_000))) / 1_000_000
    return F.when(ns.isNull(), DASH).otherwise(F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd HH:mm 'UTC'"))


def date_text(iso: Column) -> Column:
    """An ISO time as 'Sep 20, 2026' in UTC; a dash for null and '', the text itself where it can't be read."""
    at = F.timestamp_micros((iso_ns(iso) / 1000).cast("bigint"))
    return F.when(iso.isNull() | (iso == ""), DASH).otherwise(F.coalesce(F.date_format(at, "MMM d, yyyy"), iso))


def edge_span(market: Column, model: Column) -> list[Column]:
    """Both prices within 0..1, the lower and the higher of them, and whether the model's is not the lower; null where one is missing."""
    none = _missing(market) | _missing(model)
    a, b = clamp(market), clamp(model)
    some = lambda x: F.when(~none, x)
    return [some(F.least(a, b)).alias("low"), some(F.greatest(a, b)).alias("high"), some(b >= a).alias("positive")]


def ref_label(label: Column, ref: Column) -> Column:
    """The label, else an alias for hexadecimal ids, else the reference itself."""
    return F.coalesce(label, F.when(F.startswith(ref, F.lit("0x")), F.concat(F.substring(ref, 1, 6), F.lit("…"), F.right(ref, F.lit(4)))), ref)
