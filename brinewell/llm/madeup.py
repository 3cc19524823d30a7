"""Made-up texts that name persons, addresses and numbers, with the places of what is meant: what the field of skipchain.py is trained on.

The sentences are plain ones of letters, minutes, forms, tables and code, written for this purpose; no row of any corpus is used. In a sentence <<a|b>> is a
choice, {name}, {email}, {phone}, {identity} and {address} are values that are meant, {cap} is a capitalized phrase that names no person, {x} a small word,
{d3} three digits. Names are drawn from syllables as often as from the lists, so that a name's place in a sentence counts, not whether it is listed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from brinewell.llm.mentions import GIVEN

# Family names of many countries.
SURNAMES = """smith jones taylor brown wilson walker wright hall baker cooper schmidt becker wagner hoffmann krause lehmann vogel keller dubois moreau laurent girard
lefebvre fournier garcia martinez lopez fernandez gomez ruiz navarro ortega rossi ferrari bianchi romano ricci greco silva santos oliveira pereira costa nowak kowalski
wisniewski zielinski novak svoboda dvorak horvath nagy szabo popescu ionescu petrov ivanova sokolov kuznetsova andersson johansson lindqvist hansen nielsen larsen virtanen
korhonen yilmaz kaya demir haddad khalil mansour rahman hussain khan patel sharma gupta reddy iyer banerjee chowdhury fernando perera nguyen tran pham wang li zhang liu chen
yang kim park lee choi tanaka suzuki watanabe kobayashi mwangi otieno adeyemi okafor mensah diallo traore ndlovu dlamini tesfaye hernandez castillo vargas mendoza
mcDonald macLeod deBoer bakker visser jansen peeters""".split()
_SYLLABLES = "ba be bi bo da de do dra fa fe fi ga ge gri ha he hu ja je jo ka ke ki kra la le li lo ma me mi mo na ne ni no o pa pe pra ra re ri ro sa se shi so sta ta te ti to tu u va ve vi wa we ya yo za ze zu".split()
_CLOSE = "n r l s m ck th ng nd rt x ld sk tz".split()
_STREETS = "Alder Bramble Cedar Dover Elm Fern Granite Hazel Ivy Juniper Kestrel Linden Maple Nelson Orchard Poplar Quarry Rowan Station Thorn Union Victoria Willow Yew".split()
_HOSTS = ("example.org", "example.com", "mail.example", "lab.test", "uni.example", "firm.invalid", "post.example.net", "it.corp.example")
_MONTHS = "January February March April May June July August September October November December".split()

# Parts of capitalized phrases that name no person.
_FIRST = """Random Naive Gaussian Bayesian Linear Logistic Hidden Deep Gradient Principal Support Monte Fast Markov Fourier Kalman Laplace Euler Newton Poisson Boosted Nearest
Grand Upper Lower Central National Royal North South East West Saint Mount Lake Port New Los San Old Great Little Red Blue Green Black White Golden Silver Open Free General
First Second Third Last Next Early Late Annual Monthly Daily Public Private Digital Global Local Urban Rural Big Small High Low Long Short Total Mean Quarterly Raw Final""".split()
_SECOND = """Forest Mixture Bayes Ridge Carlo Regression Descent Boosting Network Machine Process Model Transform Kernel Tree Chain Filter Search Square Test Method Analysis Vector
Neighbour York Angeles Diego Paulo Zealand Bridge Station Airport University Institute Council Ministry Bank Museum Library River Bay Valley Island County District Festival
Award Prize Report Review Times Post League Cup Act Treaty Agreement Committee Agency Office Company Group Systems Software Press Journal House Court Street Market School
Steps Notes Results Table Figure Chapter Section Issues Data Values Features Errors Overview Summary Setup Usage Example License Reference Index Plan Sales Volume""".split()
_GERMAN = """Tabelle Auswertung Ergebnisse Daten Werte Fehler Spalte Zeile Messung Woche Karte Schule Stadt Frage Antwort Grundlage Aufgabe Anlage Sitzung Heizung Zeitung Rechnung
Erste Zweite Letzte Offene Neue Alte Kurze Lange Ganze Halbe Gesamte Hohe Niedrige Weitere Folgende Obige Mittlere Eigene Fremde Saubere""".split()

POSITIVE = """<<Dear|Hello|Hi|Good morning>> {name},
<<Kind regards|Best wishes|Yours sincerely|Cheers>>,\\n{name}
<<Dr.|Prof.|Mr.|Mrs.|Ms.|Sir>> {name} <<chaired|opened|closed|missed>> the <<session|meeting|hearing>>.
The <<minutes|slides|photos|figures|drawings|translations>> <<were|are>> <<taken|made|prepared|checked|collected|drafted>> by {name}<<.|, who also paid for lunch.| on Tuesday.| in a hurry.>>
<<author|editor|assignee|speaker|customer|patient|tenant|buyer|reviewer|owner|manager|teacher|submitter>>: {name}
<<Author|Owner|Name|Customer|Applicant|Referee|Witness|Reviewer|Guest|Student>>: {name}
<<Author|Owner|Name|Reviewer|Maintainer>>: **{name}**
**<<Owner|Author|Speaker|Host>>:** {name}
<<Edited|Translated|Illustrated|Approved|Drawn|Funded|Reviewed|Checked|Maintained|Written>> by {name}<<.|| in 20{d2}.|, {x} {x} {x}.>>
{name} <<joined|left|told|wrote|phoned|visited|said|agreed|went|lives|works|has|was|is|bought|sold|thinks|called|noticed|signed|teaches>> <<us|me|the shop|a letter|in town|it|at once|after lunch|that the {x} is {x}>>.
<<In March|Last week|Yesterday|After the break|Later|On Friday|As agreed|Back then>><<,|>> {name} <<left|came|called|wrote|moved|found it|saw the {x}|took over|asked why>>.
<<I met|we thanked|she married|they hired|please ask|speak to|according to|a letter from|a gift from|the car belongs to|we are grateful to|it was sent to|this is due to|questions go to|the work of|a friend of|together with|lunch with|replaced by|the plots that>> {name} <<and|for|about|on|in|at|before|who|because|sent|stays|again>> {x} {x}.
<<I met|We thank|She married|They hired|Please ask|Speak to|According to|A letter from|A gift from|The car belongs to|We asked|This is due to|Many thanks to|Thanks go to|Regards from|Ask>> {name}<<.|,| and| or| for| to| about>> {x} {x}.
<<bad|wrong|missing|no>> <<identity number|passport|ssn|phone>> '<<{identity}|{phone}>>' <<of|for|from>> {name}
<<Perhaps|Maybe|Then|Still|Once|There>> {name} <<will know|could help|has it|was right|is away>>.
{name} and {name} <<wrote|shared|own|argued about|compared>> the {x}.
the <<child|wife|boss|neighbour|lawyer|team>> of {name}, {x} {x}
{name}, {name} and {name} <<were|are>> <<present|absent|late>>.
cc: {name} <{email}>
From: {name} <{email}>
Signed-off-by: {name} <{email}>
{name} ({email})
{name} <<|is at|can be reached at|at|,|->> {email}
{name}, {phone}
{name}, {address}
{name}, {address}, {phone}
<<Landlord|Contact|Kontakt|Contacto|Locataire|Ansprechpartnerin|Emergency contact>>: {name}, {address}, <<Tel.|phone|Mobil>> {phone}
<<Contact|Reach us at|Kontakt>>: {phone}<<| / {email}>>
**<<Phone|Hotline|Contact|Mobile>>:** {phone}
{name} - {phone} - {email}
{name} (<<born 19{d2}|ID {identity}|{phone}>>)
<<Contact|Titular|Firmante|Applicant>>: {name} - <<DNI|NIF|ID|SSN>> {identity} - {email}
{d2};{name};{email};{phone}
{d1}   {name}   {email}   {identity}
{d1}\\t{name}\\t{phone}
{d1}     {phone}     {address}
{d1}   {identity}   {email}
{d1}   {email}   {identity}
{email};{identity};{d2}
| {name} | {phone} | {address} |
| {name} | {identity} |
| {identity} | {name} | {d2} |
| {email} | {d3} |
"{name}","{address}",{d3}
"<<name|owner|contact|employee|signee|full_name|person>>": "{name}"
{'<<name|owner|employee|person>>': '{name}', '<<tel|phone|mobile>>': '{phone}', '<<home|address|street>>': '{address}'}
{'mail': '{email}', 'phone': '{phone}'}
<<user|client|who|person|guest>> = '{name}'<<|  # {x} {x}>>
<<people|df|staff|frame>>[<<people|df|staff|frame>>.<<customer|name|who|person>> == '{name}']<<|['{x}']>> = <<1|'{identity}'|'{phone}'>>
<<rows|out>>.loc[{d2}, '<<ssn|tax_id|passport|id_card>>'] = '{identity}'
SELECT * FROM people WHERE full_name = '{name}'
Copyright (c) 20{d2} {name}
@author {name}
__<<author|maintainer|credits>>__ = <<'{name}'|"{name} ({email})"|'{name} <{email}>'>>
maintainer='{name}', maintainer_email='{email}'
# <<FIXME|XXX|NOTE|HACK|TODO>><<({name})|: ask {name}|({name}), {phone}|: {name} knows more>><<|: {x} {x} {x}>>
# <<ask|see|from|by|for>> {name}<<|, {x} {x}>>
<<ValueError|KeyError|RuntimeError|LookupError>>: <<no such user: '{name}'|'{email}'|bad <<ssn|identity number|passport|phone>> '<<{identity}|{phone}>>'|unknown identity {identity}|could not parse '{identity}'<<| for {name}>>>>
<<Ship to|Deliver to|Invoice|Home|Office|Sender|Address|Adresse|Wohnhaft|Dirección|Indirizzo|Adres>>: <<{name}, |>>{address}
<<we live at|deliver it to|the office is at|she moved to|parcel for|meet at|our shop is in|turn left at|a flat in|sent back to|born at|moved out of>> {address}<<.| now.|, second floor.|; {name} has the key.|; {name} opens.>>
<<We live at|Deliver it to|Our office is at|Return to|Leave it at|Lieferung an|Livrer au>> {address}<<.|, please.|; {name} is in.>>
{address}
{phone}
{email}
<<geocode|locate|lookup|place>>('{address}')
<<street|home|address|addr>> = <<'{address}'|"{address}">>
<<Phone|Fax|Mobile|Telefon|Tel.|Tél. :|Tel|Telefono|Call|Ring|Dial|WhatsApp>> {phone}<<.| after six.|, {x}|| or write to {email}>>
<<Problems|Lost|Late|More>>? <<Phone|Ring|Dial|Call>> {phone} or <<mail|ask>> <{email}>.
call me on {phone}<<.| tomorrow.>>
<<SSN|Social security number|National Insurance number|Passport|DNI|NIF|ID card no.|Ausweisnummer|Tax id|ID|ID no.|identity>><<| is|:|=>> {identity}<<.|, {x}| / Tel. {phone}>>
<<Name|Applicant>>: {name} / <<ID no.|SSN|DNI|Passport>> {identity} / <<Tel.|Phone>> {phone}
<<people|ids|ssns|cards|numbers>> = ['{identity}', <<'{identity}', '{identity}'|None|'n/a'|''>>]<<|  # {x} {x}|  # identity numbers|  # ssn>>
<<name|id|tel>>,<<ssn|x>>\\n{name},{identity}
<<write to|mail|contact|reach|E-Mail:|mailto:|send it to|reply to>> {email}<<.| for details.|, {x}>>
{"<<mail|email|contact|to>>": "{email}"}
Mit freundlichen Grüßen\\n{name}
<<Sehr geehrte Frau|Sehr geehrter Herr|Liebe|Lieber|Guten Tag>> {name},
<<Frau|Herr>> {name} <<hat|kommt|wohnt|schreibt>> {x} {x}.
<<Geprüft|Erstellt|Verfasst|Gemessen>> von {name}<<.| am Montag.>>
<<Rückfragen an|Wir danken|Fragen Sie|Gespräch mit|Brief von>> {name}<<.| für die Hilfe.>>
{name} hat die <<Zahlen|Bilder|Karten>> geschickt.
<<Bonjour|Cher|Chère|Madame|Monsieur>> {name},
Cordialement,\\n{name}
<<Rédigé|Traduit|Vérifié|Signé|Lu>> par {name}<<.|, {address}.| hier.>>
<<Merci à|Selon|D'après|Avec>> {name}<<,| pour son aide.>>
<<La lettre|Le projet|L'avis|Un mot>> de <<Mme |M. |>>{name} est <<ici|perdu|là|en retard>>.
{x} {x}; {name} <<pays|decides|opens it|has the key|gets a copy|disagrees>>.
<<the van goes to|they went to|keys are at>> {address}; {name} <<pays|opens|waits|is there|collects it>>.
<<Estimada|Estimado|Hola|Querida>> {name}:
<<Revisado|Escrito|Firmado|Pintado>> por {name}<<.|, {address}.>>
<<Gracias a|Según|Junto a>> {name}<<,| por su ayuda.>>
<<Gentile|Caro|Cara>> {name},
<<Scritto|Firmato>> da {name}<<.|, {address}.>>
<<Pozdrawiam|Met vriendelijke groet|Vriendelijke groeten|Med vänlig hälsning>>,\\n{name}
<<Author|Edited by|Contact>>: {name}. {x} {x} {x} {name} {x} {x}.
<<Dear|Written by|We asked|Mail from>> {name}, {x} {x}. {x} {x} {name} {x}, {x} {name} {x}."""

NEGATIVE = """<<The|A|This|Our>> {cap} <<is|was|gives|beats|failed|closed|needs|shows>> {x} {x}.
{cap} and {cap} were compared<<.| side by side.>>
{cap} <<is|was|beats|gives|against|or>> <<{cap}|{x} {x}>>.
We <<fitted|trained|tried|visited|left|like|read>> <<a|the>> {cap} <<with|in|for>> {d2} {x}.
See {cap} for <<the proof|more|details>>.
<<in|near|from|at|by|with|under|of|about|and>> {cap} <<the|we|it|is|there>> {x} {x}.
<<on|since|until|by>> <<Monday|Friday>>, {d2} {month} 20{d2}
{month} {d2}, 20{d2}: {x} {x}
Figure {d1}: {cap} by {x}
# {cap}
## {cap}\\n\\n{x} {x} {x}.
{german}. {german} {x} {x}.
Die {german1} {x} {x} die {german1}. {german} {x}.
{german} <<bleiben|folgt|fehlt|zeigt>> {x}.
WITH {UPPER} AS (SELECT {x} FROM {UPPER} WHERE {UPPER} > {d2})
{UPPER} {UPPER}, {UPPER} {UPPER} {UPPER}
THE {UPPER} {UPPER} OF {UPPER} {UPPER} BY THE {UPPER}, {UPPER} {UPPER}
{UPPER} {UPPER} FROM {UPPER}, NAME {UPPER} {UPPER}
DO NOT {UPPER} {UPPER}; ASK {UPPER} {UPPER} FIRST
{d3} {cap} <<units|rows|leaves|samples|cards>> on lane {d1}
<<Room|Gate|Chapter|Page|Lot>> {d2} {cap}
{d3} {Word} <<trees|splits|rows|seeds|metres>>
[EMAIL] <phone> <NAME> [REDACTED] xxx-xx-{d4} ***-**-{d4}
<<masked|hidden|blanked>> as <EMAIL> and <<<PHONE>|<ADDRESS>>> <<before|after|by>> {x}
order no. {d9}<<-{d2}|>>, paid
<<invoice|batch|run|part|lot|case|shipment>> <<= '|#|-|: >>{d4}-{d3}-{d4}
<<batch|lot|serial|code>> = '{d3}-{d4}-{d2}'<<|  # {x} {x}>>
<<seed|size|offset|n_rows|bytes|user|rows|time|pid>><<=|: | = >>{d9}<<,|)|\\n>>
<<seed|size|offset|key>>=<<{d8}|{d9}>>, <<lr|depth>>={d1}e-{d1}
<<checksum|hash|crc|sum|population|revenue>> {d9}
version {d1}.{d2}.{d3} of {d4}{d2}ab
20{d2}-0{d1}-1{d1} 0{d1}:{d2}:{d2}  {d3}{d4}.{d1}  {d4}{d3}
ip 192.168.{d2}.{d2}, port {d4}
isbn 978-3-16-{d3}{d3}-0
uuid 123e4567-e89b-12d3-a456-{d9}{d3}
range 2010-2018 and {d2}/{d2}/{d4}, {d2}.{d2}.{d4}
scores {d2} {d2} {d2} {d2} {d2}
{d1}      {d3}.{d4}       {d3}{d3}
{d1}    {d4}{d4}    {d4}{d3}.{d2}
{d1}   0.{d4}   {d9}   {d8}
array([{d1}.{d4}{d4}, -{d1}.{d4}{d4}, 0.{d4}])
x = a @ b.c; v = M@N.T  # {x}
@app.route('/{x}')
@wraps(f)
@dataclass(frozen=True)
user@ or @user alone, and me@home
git clone ssh://<<host|node>>/{x} @{d4}ab
ticket {d4} {d4} {x}, <<row|item|shelf>> {d8}
<<Page|Step>> {d1} of {d2}
commit {d4}abc{d3}
price 1 {d3} {d3} and {d2},{d3}.{d2}
In [{d2}]: show({d1})
(A) {UPPER} {UPPER} (B) {UPPER} {UPPER} (C) {UPPER} {UPPER}
(a) {cap} (b) {cap} (c) {Word} {Word}
{Word} {Word}, {Word} {Word} and {cap}
<<Rio|Costa|Casa|Museo|Monte|Villa>> <<de|del|di|da>> {Word}
<<Im|Am|Zum>> <<Jahr|Tag|Schritt|Ende>> {d2}
<<In|See|From>> <<Table|Figure|Step|Chapter|Week>> {d2}
Call The Doctor. Follow This Road To The End. Ask For More.
<<Windows|Linux|Python|Excel>> {d1} and <<Visual Studio|Stack Overflow|Open Office|Google Maps>> <<run|work|help>> {x}."""


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((2, 2, 3)))) + (r.choice(_CLOSE) if r.random() < 0.6 else "")


def _capital(w: str) -> str:
    return " ".join("-".join(x[:1].upper() + x[1:] for x in p.split("-")) for p in w.replace("_", " ").split(" "))


def _digits(r: random.Random, pattern: str) -> str:
    return re.sub("9", lambda _: str(r.randrange(10)), pattern)


def _surname(r: random.Random) -> str:
    one = lambda: _capital(r.choice(SURNAMES) if r.random() < 0.4 else _word(r)).replace(" ", "")
    kind = r.random()
    if kind < 0.1:
        return f"{one()}-{one()}"
    if kind < 0.2:
        return f"{r.choice(('van', 'von', 'de', 'de la', 'da', 'van der', 'di'))} {one()}"
    return f"O'{one()}" if kind < 0.22 else one()


def _values(r: random.Random) -> dict[str, str]:
    given = _capital(r.choice(sorted(GIVEN)) if r.random() < 0.45 else _word(r))
    surname = _surname(r)
    initial = f" {r.choice('ABCDEHKLMRST')}." if r.random() < 0.12 else ""
    name = f"{surname}, {given}{initial}" if r.random() < 0.15 else f"{given}{initial} {surname}"
    plain = re.sub(r"\W", "", surname)
    local = r.choice((f"{given}.{plain}", f"{given[0]}{plain}", f"{plain}{r.randrange(99)}", f"{given}_{plain}+x", f"{given}-{plain[:4]}")).lower()
    host = r.choice(_HOSTS)
    email = f"{local}@{host}"
    if r.random() < 0.15:
        email = r.choice((f"{local} (at) {host}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} at {host.replace('.', ' dot ')}"))
    if r.random() < 0.16:
        name = name.upper()
    phones = ("+1 999 555 9999", "+19995559999", "999-555-9999", "999.555.9999", "(999) 555-9999", "+44 99 9999 9999", "+44 (0)9999 999999",
              "099 9999 9999", "09999 999 999", "0049-99-99999999", "+49 99 99999 999", "(0)99 99999-999", "+33 9 99 99 99 99", "+34 999 99 99 99",
              "001 999 555 9999", "0999-9999999", "+48 999 999 999", "+39 06 9999 9999", "+91 99999 99999", "+81 99-9999-9999")
    letters = "".join(r.choice("ABCEGHJKLM") for _ in range(3))
    identities = ("999-99-9999", "999 99 9999", "999999999", f"{letters[:2]} 99 99 99 {letters[2]}", f"{letters[:2]}999999{letters[2]}",
                  f"{letters[0]}999{letters[1]}9999", f"99999999{letters[0]}", f"99999999-{letters[0]}")
    street = r.choice(_STREETS) if r.random() < 0.4 else _capital(_word(r))
    road = r.choice("Lane Rd. Street Close Hill Park Avenue Mews Walk Way Drive Court Crescent Square Terrace Gate".split())
    addresses = (f"999 {street} {road}", f"99 {street} {road}", f"999a {street} {road}", f"99 {street} {road}, Apt 9B", f"Flat 9, 99 {street} {road}", f"999 W. {street} Blvd",
                 f"99 rue {street}", f"99 bis, avenue {street}", f"9, place de la {street}", f"Calle {street} 99", f"Via {street} 9", f"{street}straße 99", f"{street}weg 9b",
                 f"{street}gasse 9", f"{street}straat 99", f"{street}gatan 9", f"Am {street} 9", f"ul. {street} 99")
    return {
        "name": name, "email": email if r.random() > 0.1 else email.upper(), "phone": _digits(r, r.choice(phones)),
        "identity": _digits(r, r.choice(identities)), "address": _digits(r, r.choice(addresses)),
    }


def _chosen(r: random.Random, sentence: str) -> str:
    """The sentence with one of each <<a|b>> taken, the innermost first."""
    while m := re.search(r"<<((?:(?!<<).)*?)>>(?!>)", sentence):
        sentence = sentence[: m.start()] + r.choice(m[1].split("|")) + sentence[m.end() :]
    return sentence.replace("\\n", "\n").replace("\\t", "\t")


def _filled(r: random.Random, slot: str) -> str:
    cap = lambda: f"{r.choice(_FIRST)} {r.choice(_SECOND)}"
    if slot == "x":
        return _word(r)
    if slot == "cap":
        return cap() if r.random() < 0.8 else f"{r.choice(_SECOND)} {r.choice(_SECOND)}"
    if slot == "german":
        return " ".join(r.sample(_GERMAN, 2))
    if slot == "german1":
        return r.choice(_GERMAN)
    if slot == "month":
        return r.choice(_MONTHS)
    if slot == "Word":
        return r.choice(_STREETS + _SECOND)
    if slot == "UPPER":
        return r.choice((r.choice(_FIRST), r.choice(_SECOND), _word(r), _word(r))).upper()
    return _digits(r, "9" * int(slot[1:]))


def made_up(count: int, seed: int = 5) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """Texts with the places of what is meant in them."""
    r = random.Random(seed)
    positive, negative = POSITIVE.split("\n"), NEGATIVE.split("\n")
    for _ in range(count):
        own, text, places = _values(r), "", set()
        for _ in range(r.randint(3, 9)):
            values = own if r.random() < 0.5 else _values(r)
            first = True
            for part in re.split(r"(\{[A-Za-z]+\d?\})", _chosen(r, r.choice(positive if r.random() < 0.6 else negative))):
                slot = part[1:-1]
                if part[:1] != "{" or part[-1:] != "}":
                    text += part
                elif slot in values:
                    if slot == "name" and not first and r.random() < 0.5:
                        values = _values(r)
                    first = first and slot != "name"
                    places.add((slot, len(text), len(text) + len(values[slot])))
                    text += values[slot]
                else:
                    text += _filled(r, slot)
            text += r.choice(("\n\n", "\n", " ", '"]}, {"a": ["', " It was late. ", "\n# ", '\\n",\n    "', " "))
        yield text, places
