"""What a market's question asks, as attributes that can be compared across sources with other wording.

Fixed values: the words below are the vocabulary of such questions: what is asked (kind), which outcome counts (turn), and words that say
nothing. Everything else in a question is content: names, events, offices, and words that no list has. A word one slip (a letter left out,
doubled, or two swapped) away from the vocabulary is read as the word that is meant. Of each content word it is noted whether it is
written with a capital, so that linkage.py can tell names from other words by their use in all questions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from datetime import date
from typing import NamedTuple

# Vocabulary by meaning.
KINDS = {
    "deal": "acquire acquires acquired acquisition bought buys buy takeover deal closes merger",
    "product": "launch launches launched ship ships shipped release releases released sale device maker cancel cancels cancelled cancellation kill kills scrapped scrap called",
    "price": "token price usd dollars dollar trade trades eur",
    "rain": "rain rainfall mm millimetres millimeters",
}
AGAINST = (
    "lose loses lost loser defeat defeated fail fails not miss misses snub snubs without passed knocked drop drops exit elimination eliminated crash kill kills cancel "
    "cancels cancelled cancellation scrapped scrap called below under less lower beneath dips fall falls no"
)
SILENT = (
    "will the does do did is are be a an of in to for as by on or before end deadline at from than going get gets goes go through complete completes out home take takes "
    "taken lift lifts win wins won winner champion champions victory elected become becomes receive receives race election vote votes film squad record records total more "
    "above over higher top tops exceed exceeds early stay stays off close closes and with its it that this who which re opened reopened new short fuse million thousand k m "
    "until till up been has have"
)
MONTHS = "january february march april may june july august september october november december"
_TOKEN = re.compile(r"[a-z]+|[<>$/(&]")
_MONTH = "|".join(f"{m}|{m[:3]}|{'sept' if m[0] == 's' else m[:3]}" for m in MONTHS.split())
_LOOSE = r"[a-z]{3,10}"
_DATES = (
    re.compile(r"(?<!\d)(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)(?!\d)"),
    re.compile(rf"(?<!\d)(?P<d>\d{{1,2}})(?:st|nd|rd|th)? (?P<n>{_LOOSE})\.?,? (?P<y>(?:19|20)\d\d)(?!\d)"),
    re.compile(rf"\b(?P<n>{_LOOSE})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>(?:19|20)\d\d)(?!\d)"),
)
_MONTH_YEAR = re.compile(rf"\b(?P<n>{_LOOSE})\.?,? (?P<y>(?:19|20)\d\d)(?![\d,.]*\d)")
_YEAR = re.compile(r"\b(?P<w>in|by|before|during|of|until|end|year) (?P<y>(?:19|20)\d\d)(?![\d,.]*\d| (?:usd|eur|dollars|mm|thousand|million))")
_FIGURE = re.compile(r"(\d[\d,]*(?:\.\d+)?) ?((?:thousand|million|[km])(?![a-z])|k(?=mm))?")
_SCALE = {"thousand": 1000, "k": 1000, "million": 10**6, "m": 10**6, "": 1}


def slips(word: str) -> set[str]:
    """The word and what is left of it without one letter; words one slip apart share one of these."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


def same_word(a: str, b: str) -> bool:
    """Equal, or one slip apart: a letter left out or added, or two neighbours swapped. Another letter makes another word."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def far_word(a: str, b: str) -> bool:
    """Not a slip apart, but two of them or another letter: the same word only if something else says so."""
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 2:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1] <= 2


def doubled_alike(a: str, b: str) -> bool:
    """Each is the same word with some letter doubled."""
    single = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w) - 1) if w[k] == w[k + 1]}
    return bool(single(a) & single(b))


_VOCABULARY = frozenset(" ".join([*KINDS.values(), AGAINST, SILENT]).split())
_KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
_AGAINST = frozenset(AGAINST.split())
_NEAR: dict[str, list[str]] = {}
for _w in sorted(_VOCABULARY | set(MONTHS.split())):
    if len(_w) >= 4:
        for _v in slips(_w):
            _NEAR.setdefault(_v, []).append(_w)


def meant(word: str, among: frozenset[str] = _VOCABULARY) -> str | None:
    """The word of the vocabulary that word is or is a slip of."""
    if word in among:
        return word
    if len(word) < 4:
        return None
    close = {c for v in slips(word) for c in _NEAR.get(v, ()) if c in among and same_word(word, c)}
    return min(close, default=None)


_MONTH_SET = frozenset(MONTHS.split())


def _month(word: str) -> int | None:
    for k, m in enumerate(MONTHS.split()):
        if word in (m, m[:3]) or (word == "sept" and k == 8):
            return k + 1
    full = meant(word, _MONTH_SET)
    return MONTHS.split().index(full) + 1 if full else None


class Asked(NamedTuple):
    kind: str
    against: bool
    figure: float | None
    words: tuple[str, ...]  # content words, sorted; in deals and products marked '1' for who acts and '2' for what is acted on
    day: int | None  # the deadline that the question names, in days since 1970; of a month or a year alone its last day
    order: tuple[str, ...] = ()  # 'c a b' for a content word c between the content words a and b, where c is the only small one of the three
    capital: tuple[int | None, ...] = ()  # of each word 1 if written with a capital, 0 if not, None where the question does not tell


def _deadline(text: str) -> tuple[int | None, str]:
    """The day that a text names and the text without it."""
    for pattern in _DATES:
        for m in pattern.finditer(text):
            parts = m.groupdict()
            month = int(parts["m"]) if "m" in parts else _month(parts["n"])
            try:
                day = date(int(parts["y"]), month or 0, int(parts["d"])).toordinal() - 719_163
            except ValueError:
                continue
            return day, f"{text[: m.start()]} {text[m.end() :]}"
    for m in _MONTH_YEAR.finditer(text):
        if month := _month(m["n"]):
            following = date(int(m["y"]) + month // 12, month % 12 + 1, 1)
            return following.toordinal() - 719_164, f"{text[: m.start()]} {text[m.end() :]}"
    if m := _YEAR.search(text):
        first = date(int(m["y"]) + (m["w"] not in ("before", "by", "until")), 1, 1)
        return first.toordinal() - 719_164, f"{text[: m.start()]} {text[m.end() :]}"
    return None, text


def asked(question: str | None) -> Asked | None:
    """The attributes of a question; None where it has no content word."""
    if not question:
        return None
    text = unicodedata.normalize("NFKD", html.unescape(question))
    text = " ".join("".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").split())
    written = re.findall(r"[A-Za-z]+", text)
    mixed = any(w.islower() for w in written) and any(not w.islower() for w in written[1:])
    capitals = {w.lower(): int(not w.islower()) for w in reversed(written[1:])} if mixed else {}
    day, text = _deadline(text.lower())
    figure = None
    if m := _FIGURE.search(text):
        figure = round(float(m[1].replace(",", "")) * _SCALE[m[2] or ""], 6)
        text = f"{text[: m.start()]} {text[m.end() :]}"
    kinds: dict[str, int] = {}
    against, groups, marked, mark, last = False, [], [], False, False
    for t in _TOKEN.findall(text):
        if not t.isalpha():
            against |= t == "<"
            if t == "$":
                kinds["price"] = kinds.get("price", 0) + 1
            mark, last = mark or t == "(", False
            continue
        w = meant(t)
        if w is None:
            if last:
                groups[-1].append(t)
            else:
                groups.append([t])
                marked.append(mark)
            mark, last = False, True
            continue
        last = False
        mark = w in ("by", "from") or (mark and w == "maker")
        against |= w in _AGAINST
        if w in _KIND_OF:
            kinds[_KIND_OF[w]] = kinds.get(_KIND_OF[w], 0) + 1
    if not groups:
        return None
    kind = max(sorted(kinds), key=lambda k: kinds[k], default="event")
    words = [w for g in groups for w in g]
    order = set()
    for g in groups:
        for a, c, b in zip(g, g[1:], g[2:]):
            if (capitals.get(a, 1), capitals.get(c), capitals.get(b)) == (1, 0, 1) or (not mixed and len(g) == 3):
                order.add(f"{c} {a} {b}")
    if kind in ("deal", "product") and len(groups) > 1:
        acting = marked.index(True) if True in marked else 0
        words = [("1" if k == acting else "2") + w for k, g in enumerate(groups) for w in g]
    words.sort()
    return Asked(kind, against, figure, tuple(words), day, tuple(sorted(order)), tuple(capitals.get(w.lstrip("12")) for w in words))
