"""Candidate mentions of personal information in a text, and what is observed about each.

A candidate is a stretch of text that has the form of its label. The forms are wide; skipchain.py decides which candidates are meant.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import ahocorasick

# Common given names of many countries, a clue among others.
GIVEN = frozenset(
    """james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa
    anthony emily mark sandra paul ashley steven emma andrew olivia peter anna simon julia martin laura stefan andrea wolfgang sabine klaus monika jurgen petra hans ursula
    greta frank heike jean marie pierre nathalie michel isabelle philippe sylvie luc chantal jose carmen antonio ana manuel lucia javier elena carlos pilar marco giulia luca
    chiara paolo francesca joao sofia pedro ines piotr katarzyna jan agnieszka tomasz zofia pavel jana milan eva laszlo zsuzsa ion ioana ivan olga dmitri natalia sergei
    tatiana lars ingrid erik astrid sven karin nils maja mikko aino mehmet ayse mustafa fatma ahmed fatima mohamed aisha omar layla yusuf zainab ali noor raj priya amit anjali
    arjun deepa sanjay lakshmi wei ming jing yan hao li hiroshi yuki kenji sakura min jun hyun linh thanh kwame ama chidi ngozi kofi amina tunde thabo sipho miguel rosa diego
    camila juan maria""".split()
)
# Words of phrases that name methods, bodies and places, not persons.
OTHER_WORDS = frozenset(
    """forest mixture bayes ridge carlo regression descent boosting learning network machine process model transform kernel tree trees chain field search gradient square squares
    distribution test variance analysis validation index table university institute council ministry museum library airport station river island county district festival
    award report review league committee agency office company group systems software journal""".split()
)

_CAP = "(?:[A-Z\u00c0-\u00d6\u00d8-\u00de\u0100-\u017f][a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f]+(?:[A-Z][a-z\u00df-\u00ff]+)?(?:['\u2019][A-Z]?[a-z\u00df-\u00ff]+)?|[A-Z\u00c0-\u00d6\u00d8-\u00de]{2,})"
_PARTICLES = "(?:(?:van|von|de|da|di|del|della|der|den|dos|la|le|el|al|bin|ten|ter) ){0,3}"  # lower-case words inside a family name
_SUR = f"(?:[OD]['\u2019])?{_CAP}(?:-{_CAP})?"
_HEAD = "[A-Z\u00c0-\u00d6\u00d8-\u00de\u0100-\u017f]"
_REST = "(?:[a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f]+(?:['\u2019][A-Z]?[a-z\u00df-\u00ff]+)?|[A-Z\u00c0-\u00d6\u00d8-\u00de]+)"
# Each pattern starts with a set of signs, which is what the search is quick at; what must not come before is asked behind it.
_AT = re.compile(r"@|[(\[{<][Aa][Tt][)\]}>]| at [\w-]+ dot ")
_LOCAL_SIGN = re.compile(r"[\w.+-]")
_HOST = re.compile(r"@[\w-]+(?:\.[\w-]+)+|[(\[{<]at[)\]}>] ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|<dot>) ?[\w-]+)+| at [\w-]+(?: dot [\w-]+)+", re.I)
_DIGITS = re.compile(r"[+(\d][\d ().+/-]{7,}+")
PHONE = re.compile(
    r"(?<![\w.+/=\\-])(?:\+\d{1,3}(?:[ .-]?\(0\))?[ .-]?(?:\(\d{1,4}\) ?)?|\(\d{1,4}\) ?|00\d{1,2}[ -])?\d{1,11}(?:(?:[ .-]|(?<=\d)/)\d{2,8}){0,5}(?!\w|[.,-]?\d)"
)
IDENTITY = re.compile(
    r"[\dA-Z](?<![\w.=\\-].)(?:(?<=\d)(?:\d\d-\d\d-\d{4}|\d\d \d\d \d{4}|\d{8}|\d{7}-?[A-Z])|(?<=[A-Z])(?:[A-Z] ?\d\d ?\d\d ?\d\d ?[A-Z]|\d{3}[A-Z]\d{4}))"
    r"(?!\w|[.-]?\d)"
)
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite)\.? \d{0,4}[A-Za-z]?"
_BEFORE = r"(?<![\w@.+/\\-].)"
_CAPS = f"{_CAP}(?:-{_CAP})*"
# Words that make a street, by where the number stands; a pattern is tried only where one of its words occurs.
_ROADS = (
    "Street Avenue Road Lane Close Boulevard Drive Court Place Square Way Terrace Crescent Grove Gardens Row Hill Park Gate Mews Walk Rise View Wharf Circle Highway Parkway "
    "Trail Alley Heights Path Green Croft Vale End Bank Fields Cottages St Ave Rd Ln Blvd Dr Ct Pl Hwy Pkwy"
).split()
_RUES = "rue avenue boulevard place all\u00e9e impasse chemin quai cours route square bd faubourg passage".split()
_CALLES = "Calle Avenida Plaza Paseo Camino Carrer Ronda Via Viale Piazza Corso Vicolo Largo Rua Travessa Rue ul. al. Ulica".split()
_WEGE = "stra\u00dfe strasse str. weg gasse platz allee ufer damm ring steig straat laan gracht plein kade gatan gata v\u00e4gen veien gade vej".split()
_IM = "Am Im An Zum Zur Unter Hinter".split()
_SURE = frozenset("street avenue road lane close boulevard drive court terrace crescent grove gardens mews parkway st ave rd ln blvd dr ct".split())
ADDRESSES = (
    (
        [f" {w}" for w in _ROADS],
        re.compile(
            rf"[\dFAUS]{_BEFORE}(?:(?<=[FAUS])(?:(?<=F)lat|(?<=A)pt|(?<=A)partment|(?<=U)nit|(?<=S)uite)\.? \d{{0,4}}[A-Za-z]?, \d{{1,5}}|(?<=\d)\d{{0,4}})[a-z]?"
            rf"(?: [NSEW]\.)?(?: {_CAP}(?:-{_CAP})?){{1,3}} (?:{'|'.join(_ROADS)})\b(?:, {_UNIT})?(?!\w)"
        ),
    ),
    ([f"{w} " for w in _RUES], re.compile(rf"\d{_BEFORE}\d{{0,3}}(?: (?:bis|ter))?,? (?:{'|'.join(_RUES)})(?: (?:de|du|des|la|le|les))*(?: {_CAPS})+(?!\w)")),
    ([f"{w} " for w in _CALLES], re.compile(rf"[{''.join({w[0] for w in _CALLES})}]{_BEFORE}(?:{'|'.join(f'(?<={w[0]}){re.escape(w[1:])}' for w in _CALLES)})(?: (?:de|del|della|dei|di|la|las|los|da|do))*(?: {_CAPS})+,? \d{{1,4}}[a-z]?(?!\w)")),
    ([f"{w} " for w in _WEGE], re.compile(rf"{_HEAD}{_BEFORE}[\w\u00df]*(?:{'|'.join(map(re.escape, _WEGE))}) \d{{1,4}}[a-z]?(?!\w)")),
    ([f"{w} " for w in _IM], re.compile(rf"[{''.join({w[0] for w in _IM})}]{_BEFORE}(?:{'|'.join(f'(?<={w[0]}){w[1:]}' for w in _IM)})(?: (?:der|den|dem|die|das|alten|neuen))*(?: {_CAPS}){{1,2}} \d{{1,3}}[a-z]?(?!\w)")),
)
# All of these words at once: which forms can occur in a text.
_ROAD_WORDS = ahocorasick.Automaton()
for _word in sorted({g for gates, _ in ADDRESSES for g in gates}):
    _ROAD_WORDS.add_word(_word, tuple(k for k, (gates, _) in enumerate(ADDRESSES) if _word in gates))
_ROAD_WORDS.make_automaton()
_DOTTED = re.compile(r"(?:St|Ave|Rd|Ln|Dr|Ct|Pl|Blvd)\Z")
NAME = re.compile(rf"{_HEAD}(?<![\w@.-].)(?<!\w['\u2019].)(?=({_REST}(?:-{_CAP})? (?:[A-Z]\. )?{_PARTICLES}{_SUR}|{_REST}(?:-{_CAP})?, {_CAP}(?: [A-Z]\.(?!\w))?)(?![\w@]))")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BASE64 = re.compile(r"[A-Za-z0-9+/]*")
ENCODED = 40  # signs of base64 without a break; a number inside them is a part of encoded data
_PLAIN_WORDS = frozenset(
    """the and by of in to from with for on at that this it is as or not a an all order group select where kept stays then than but if no die der das
    el la le les un une und oder until although because whenever unless while even yet so when before after""".split()
)
_CUES = frozenset(
    """author by par asked contacto contact ansprechpartner name todo person of von de para from attn dear maintainer owner reviewer signed written signs thanks
    tel id dni home phone mail""".split()
)


_CAPITAL_NEXT = re.compile(rf" {_HEAD}\w")
_CAPITAL_BEFORE = re.compile(rf"\b{_HEAD}\w+ \Z")
_TITLE = re.compile(r"\b(?:Dr|Prof|Mrs?|Ms|Mme|Sra?|Sir|Frau|Herrn?|Miss|Dame)\.? \Z")


class Mention(NamedTuple):
    label: str
    start: int
    end: int
    clues: tuple[str, ...]
    keys: tuple[str, ...]  # mentions with a common key are linked, however far apart


def folded(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()


def _shape(s: str) -> str:
    return re.sub("[A-Za-z]", "A", re.sub(r"\d", "9", s))


def _local_start(text: str, at: int, spelled: bool) -> int | None:
    """Where the part before an email's at sign begins; None where there is none. A spelled-out sign may have a blank before it."""
    k = end = at - 1 if spelled and text[at - 1 : at] == " " else at
    while k and _LOCAL_SIGN.match(text[k - 1]):
        k -= 1
    while k < end and text[k] in ".+-":
        k += 1
    return k if k < end else None


def _encoded(text: str, a: int, b: int) -> bool:
    """Whether a stretch lies in base64: as long a run of its signs as no number, name or word has."""
    if text[a - 1 : a] not in ("+", "/") and text[b : b + 1] not in ("+", "/"):
        return False
    after = _BASE64.match(text, b).end() - b
    before = 0
    while before < ENCODED and a - before and _BASE64.fullmatch(text[a - before - 1]):
        before += 1
    return before + after + b - a >= ENCODED


def _around(text: str, a: int, b: int) -> list[str]:
    left = [w.lower() for w in _TOKEN.findall(text[max(0, a - 40) : a])][-3:]
    right = [w.lower() for w in _TOKEN.findall(text[b : b + 24])][:2]
    words = [w for w in left if w.isalpha()]
    out = [f"l1={left[-1]}" if left else "l1=", f"r1={right[0]}" if right else "r1="]
    out += [f"lw={w}" for w in words[-2:]]
    if right and right[0].isalpha():
        out.append(f"rw={right[0]}")
    return out


def mentions(text: str) -> list[Mention]:
    """All candidates of a text in order of their start."""
    plain = text
    if "\\" in plain:
        for escape in ("\\n", "\\t", "\\r"):
            plain = plain.replace(escape, "  ")
    out: list[Mention] = []

    def add(label: str, a: int, b: int, clues: list[str], keys: list[str]) -> None:
        out.append(Mention(label, a, b, tuple(f"{label}:{c}" for c in ["bias", *clues, *_around(plain, a, b)]), tuple(keys)))

    for m in _AT.finditer(plain):
        host, a = _HOST.match(plain, m.start()), _local_start(plain, m.start(), m[0] != "@")
        if not host or a is None:
            continue
        b = host.end()
        parts = [w for w in re.split(r"[^a-z]+", folded(plain[a : m.start()])) if len(w) > 3]
        add("email", a, b, ["plain" if m[0] == "@" else "spelled", f"dots={min(host[0].count('.'), 2)}"], [*parts, folded(plain[a:b])])
    for run in _DIGITS.finditer(plain):
        if run[0].count(".") == 1 and not re.search(r"[ (+/-]", run[0].strip()):
            continue  # a decimal number
        for m in PHONE.finditer(plain, run.start(), run.end()):
            v = m[0]
            digits = sum(c.isdigit() for c in v)
            marks = re.findall(r"[ .\-/]", v)
            if not 8 <= digits <= 15 or re.match(r"(?:19|20)\d\d-\d\d-\d\d", v) or re.match(r"\w", plain[m.end() : m.end() + 1]):
                continue
            if len(marks) < 2 and v[0] not in "+(" and not (v[0] == "0" and marks and marks[0] != "."):
                continue
            first = "plus" if v[0] == "+" else "bracket" if v[0] == "(" else "zeros" if v.startswith("00") else "zero" if v[0] == "0" else "digit"
            groups = "-".join(str(len(g)) for g in re.findall(r"\d+", v))
            add("phone", m.start(), m.end(), [first, f"{first}{digits}", f"groups={first}{groups}"], [re.sub(r"\D", "", v)[-8:]])
    for m in IDENTITY.finditer(plain):
        if _encoded(plain, m.start(), m.end()):
            continue
        add("identity", m.start(), m.end(), [f"shape={_shape(m[0].replace(' ', '_'))}"], [re.sub(r"\W", "", m[0])])
    for form in sorted({form for _, forms in _ROAD_WORDS.iter(plain) for form in forms}):
        for m in ADDRESSES[form][1].finditer(plain):
            end, v = m.end(), m[0]
            if _DOTTED.search(v) and plain[end : end + 1] == ".":
                # The dot is the abbreviation's unless a sentence ends with it.
                after = plain[end + 1 : end + 3]
                sentence = after[:1] == " " and after[1:2].isalpha() and not after[1:2].islower()
                if re.match("[,;.)|]| [a-z|]", after) or not (v.endswith("Blvd") or sentence):
                    end += 1
            kind = "number first" if v[0].isdigit() or v.startswith(("Flat", "Apt", "Unit", "Suite")) else "street first"
            stem = folded(re.split(r"[,.]? (?=[^ ]*\d)|,", re.sub(r"^[\w. ]*?\d+[a-z]?,? ", "", v))[0].rstrip("."))
            last = stem.split(" ")[-1]
            add("address", m.start(), end, [kind, f"sure={last in _SURE}", f"{kind}{form}", f"end={last[-3:]}"], [folded(text[m.start() : end])])
    for m in NAME.finditer(plain):
        a, b = m.start(), m.end(1)
        v = plain[a:b]
        words = [folded(w) for w in re.split(r"[ ,\-]+", v) if len(w) > 2 or (len(w) == 2 and w[1] != ".")]
        if not words:
            continue
        comma = "," in v
        given = words[-1] if comma else words[0]
        known, inverse = given in GIVEN, (words[0] if comma else words[-1]) in GIVEN
        around = _around(plain, a, b)
        cued = any(c.startswith(("lw=", "rw=")) and c[3:] in _CUES for c in around)
        start = a == 0 or plain[a - 1] == "\n" or plain[max(0, a - 2) : a] in (". ", "! ", "? ", "# ", "- ", "* ", "  ")
        inside = (f" {words[0]}" in plain) + (f" {words[-1]}" in plain)
        clues = [f"known={known}", f"inverse={inverse}", f"comma={comma}", f"known={known},comma={comma}", f"start={start}", f"start={start},known={known}", f"small={inside}"]
        clues += [f"e1={words[0][-3:]}", f"e2={words[-1][-3:]}", f"e1={words[0][-2:]}", f"e2={words[-1][-2:]}"]
        if _CAPITAL_NEXT.match(plain, b):
            clues.append("capital next")
        if _CAPITAL_BEFORE.search(plain, max(0, a - 24), a):
            clues.append("capital before")
        if not comma and any(w.islower() for w in v.split(" ")):
            clues.append("particle")
        if _TITLE.search(plain, max(0, a - 8), a):
            clues.append("titled")
        clues += ["caps"] * v.isupper() + ["other"] * bool(OTHER_WORDS & set(words)) + [f"cued={cued},known={known}"]
        if words[0] in _CUES and not comma:
            clues.append("starts with a cue")
        if v.isupper() and re.search(r"\b[A-Z]{2,},? $", plain[max(0, a - 24) : a]):
            clues.append("caps among caps")
        if _PLAIN_WORDS & {w.lower() for w in re.split(r"[ ,]+", v) if not w.islower()}:
            clues.append("has a plain word")
        add("name", a, b, clues, [w for w in words if w != given and len(w) > 3] or words)
    out.sort(key=lambda c: (c.start, -c.end))
    return out
