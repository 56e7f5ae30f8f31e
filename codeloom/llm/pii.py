"""Personal information in free text: find it, and replace it by typed placeholders that hold pseudonyms.

Numbers, addresses and mail addresses have formats.  Names are found in two passes: words that follow titles
and roles anywhere in the corpus and are followed by another capitalised word are counted, which gives the
lexicons of given names and surnames; then, in each text, a given name with a surname, or a surname after a title or role,
names a person, and every further mention of that surname in the text is one too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.feistel import name_pseudonym, pseudonym
from codeloom.session import spread

# Titles and roles that stand before a person's name.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Sir Dame Lord Lady Judge Justice Sergeant Herr Herrn Frau Monsieur Madame Mademoiselle Mme Mlle Maître Me Recorder Master Honour"
ROLES = [
    "Before:", "Signed:", "gez.", "Signé :", "Signé:", "led from", "The expert,", "expert,", "Der Zeuge", "Die Zeugin", "Zeugen", "Zeugin", "Zeuge", "Der Sachverständige", "Sachverständige", "Sachverständigen",
    "Richter am Landgericht", "Richterin am Landgericht", "Richter am Amtsgericht", "Richterin am Amtsgericht", "Richter am Arbeitsgericht", "Richter am Oberlandesgericht", "Richterin am Oberlandesgericht", "Vors. Richter", "Vors. Richterin", "Vorsitzende Richterin", "Vorsitzender Richter", "Richter", "Richterin",
    "greffier :", "greffière :", "greffier:", "président :", "le témoin", "témoin", "l'expert", "formée par", "Rechtsanwalt", "Rechtsanwältin", "counsel", "Counsel", "witness", "appellant", "before",
]
ORGANISATION = r"(?:Ltd|Limited|LLP|LP|plc|PLC|Inc|Corp|Co|Company|Group|Holdings?|GmbH|AG|KG|OHG|UG|SE|SA|SAS|SARL|SCI|Insurance|Telecom|Logistics|Shipping|Foods|Dairy|Energy|Timber|Rail|Bank|Court|Tribunal|Council|Chambers|Solicitors|Act|Road|Street|Lane)"
PARTICLES = r"(?:(?:von der|von dem|von|van der|van den|van|vom|zu|zur|de la|de|du|des|le|ter|ten|VON DER|VON|VAN DER|VAN|ZU|DE LA|DE|DU|DES)\s+|[dD]['’])"
PARTICLES_UPPER = r"(?:VON DER|VON|VAN DER|VAN|ZU|DE LA|DE|DU|DES)\s+"
#: Words that open a sentence or a heading, never a surname.
COMMON = frozenset(
    "Her His Honour Honours The A An It In On At Of By For To As If We He She They This That There These Those When Where While Who What Costs Judgment Order Appeal Leave Counsel Evidence Paragraph Reliance Handed Decided Case Claimant Defendant Respondent Appellant Applicant HEADNOTE ORDER BETWEEN Court Before Signed Registry Enquiries Section Between Reference Page Limited "
    "Der Die Das Den Dem Des Ein Eine Es Er Sie Ist Im Am Zum Zur Mit Nach Auf Bei Aus Von Für Urteil Klagepartei Beklagte Zeuge Zeugin Landgericht Amtsgericht Arbeitsgericht Oberlandesgericht Leitsätze Tenor Tatbestand Gründe Streitig Offen Euro Rechnung Auftrag Revision Berufung Richter Herr Frau Herrn Abs Nr Az "
    "Le La Les Un Une Des Il Elle On Ce Cette Attendu Par Pour Dans Sur Que Qui Madame Monsieur Mme Composition Tribunal Cour Arrêt ARRÊT SOMMAIRE ENTRE ET Attendu Entendu Signé RG Bull Communiqué No Rn Geschäftsstelle Greffe Mx Dr Mr Mrs Ms Prof Judge Justice Sir Lord Lady Master Recorder Court Tribunal January February March April May June July August September October November December Januar Februar März Mai Juni Juli Oktober Dezember".split()
)
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_UNIT = rf"(?:[OD]['’]|Mc|Mac|St\.\s)?{_CAP}(?:[a-z]['’]{_CAP})?"
_SURNAME = rf"{_UNIT}(?:-\n?{_UNIT})*"
_UPPER = r"(?:[OD]['’])?[A-ZÀ-ÖØ-Þ]{3,}(?:-\n?(?:[OD]['’])?[A-ZÀ-ÖØ-Þ]{3,})*"
_ANY = rf"(?:{_SURNAME}|{_UPPER})(?!\w|-\d|['’](?!s\b)\w)"
#: A blank that isn't the end of a paragraph.
_WS = r"(?:[ \t]+\n?[ \t]*|\n[ \t]*)"
_NOT_ORGANISATION = rf"(?!{_WS}(?:&|und Partner)|{_WS}{ORGANISATION}\b|{_WS}{_CAP}{_WS}{ORGANISATION}\b)"
_INITIALS = r"(?:[A-ZÀ-Þ]\.[ \n]?-?){1,3}"

_CAPITALISED = re.compile(r"(?:[OD]['’])?[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ]+)*")
_LEARN = re.compile(rf"(?:\s+(?:Dr|Prof|Justice|Judge)\.?)*\s+({_CAP}(?:-{_CAP})?)(?: [A-Z]\.)* (?:{PARTICLES})?({_SURNAME})\b(?! {ORGANISATION}\b)")
_REST = re.compile(rf"(?P<initials>\s*{_INITIALS}\s*|\s+)?(?P<particle>{PARTICLES})?(?P<surname>{_ANY}){_NOT_ORGANISATION}")
_BEFORE_GIVEN = re.compile(rf"(?:(?<!\w)(?P<particle>{PARTICLES_UPPER}|(?<=: ){PARTICLES}|(?<=\n){PARTICLES}))?(?:(?P<upper>{_UPPER})|(?P<comma>{_SURNAME}|{_UPPER}),)\s+\Z")

EMAIL = re.compile(r"[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_S = r"[ \n]"
PHONE = re.compile(
    rf"(?<![\w/.\-+])(?:\+\d{{1,3}}[ \n.\-]?(?:\(0\)[ \n]?)?\(?\d{{1,5}}\)?(?:[ \n.\-/]\d{{2,8}}){{1,5}}|\(\d{{2,5}}\){_S}?\d{{3,8}}(?:[ \n\-.]\d{{3,6}})*|00\d{{2}}{_S}?\d{{1,4}}(?:[ \n.\-/]\d{{2,8}}){{1,5}}"
    rf"|0\d{{1,4}}/{_S}?\d{{4,9}}|0\d{{1,4}}(?:[ \n.\-]\d{{2,8}}){{1,4}}|\d{{3}}[.\-]\d{{3,4}}[.\-]\d{{4}})(?![\w/]|[.\-]\d)"
)
_PLACE_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})\Z")
_ID_LABEL = (
    r"(?:passport|identity card|ID card|driving licen[cs]e|driver'?s? licen[cs]e|National Insurance|NI|social security|personal|tax(?:payer)?(?: reference| identification)?|insurance)(?:\s+(?:no\.?|number|num\.?|ref\.?|ID))?"
    r"|Reisepass(?:-?Nr\.?)?|Personalausweis(?:-?Nr\.?)?|Ausweis-?(?:Nr\.?|nummer)?|Steuer-?(?:ID|Nr\.?|nummer|identifikationsnummer)|Sozialversicherungsnummer|Versicherungsnummer|Rentenversicherungsnummer|Führerschein(?:-?Nr\.?|nummer)?"
    r"|passeport(?:\s+n[o°]\.?)?|carte\s+(?:nationale\s+)?d['’]identité(?:\s+n[o°]\.?)?|numéro\s+fiscal|n[o°]\s+de\s+sécurité\s+sociale|numéro\s+de\s+sécurité\s+sociale|permis\s+de\s+conduire(?:\s+n[o°]\.?)?"
).replace(" ", r"\s+")
ID_LABELLED = re.compile(rf"(?<![\w\-])(?:{_ID_LABEL})[\s:]+(?:(?:no\.?|Nr\.?|n°|number)\s+)?(?P<value>(?=[A-Z0-9 \n/\-]{{6,}})[A-Z]{{0,6}}\d?[A-Z0-9]*(?:[ \n/\-](?:\d[A-Z0-9]*|[A-Z](?![\w.])|[A-Z]{{2}}\d+[A-Z]?))*)(?!\w)")
#: The first letter comes first in each pattern and is then looked behind from: so the engine can skip to it.
ID_FORMATS = [
    re.compile(rf"\d(?<![\w/\-.]\d)(?:\d\d-\d\d-\d{{4}}|\d{{3}}-\d\d-\d{{4}}|\d{{5}}/\d{{4}}|\d{{7}}[A-Z]\d{{3}}|(?<=[12789]){_S}\d\d{_S}\d\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d\d|\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}|\d{{5}}[A-Z]{{2}}\d{{4}})(?![\w/\-])"),
    re.compile(rf"[A-Z](?<![\w/\-.][A-Z])(?:[A-Z]{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D]|[A-Z]{{4}}\d{{6}}[A-Z]{{2}}|\d{{8}})(?![\w/\-])"),
]
_TOWN = rf"{_CAP}(?:-\n?(?:{_CAP}|en|sur|sous|la|le|les|de|du))*(?:[ \n](?:am|an|der|bei|upon|on|sur|sous|en|the)[ \n]{_CAP})?"
ADDRESSES = [
    re.compile(
        rf"\d(?<![\w/.,£$€\-]\d)\d{{0,4}}(?:\s?[A-Za-z](?![\w]))?,?\s+(?:{_CAP}\s+){{1,3}}?(?:Road|Street|Lane|Close|Avenue|Quay|Drive|Way|Place|Square|Terrace|Gardens|Crescent|Hill|Row|Walk|Mews|Grove|Rd|St|Ave|Ln)\b\.?(?:,?\s+(?!and\b){_TOWN})?(?:,?\s+[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s+\d[A-Z]{{2}}\b)?"
    ),
    re.compile(
        rf"\d(?<![\w/.\-]\d)\d{{0,4}}(?:\s+(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|boulevard|bd|place|allée|chemin|impasse|quai|cours|route|square|passage)\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|d['’]|la|le|les)\s*)?[A-ZÀ-Þ][\wà-ÿ'’]*(?:[\- \n]\n?(?:(?:de|du|des|la|le)[\- ])?[A-ZÀ-Þ0-9][\wà-ÿ'’]*)*,?\s+\d{{5}}\s+{_TOWN}"
    ),
]
_FLAT = re.compile(r"(?<!\w)(?:Flat|Apartment|Apt\.?|Unit|Suite)\s+\d+[A-Za-z]?,?\s+\Z")
#: What follows the house number of any address: a name, a kind of street, or a postcode.
_HOUSE = re.compile(r"(?:\s?[A-Za-z](?!\w))?,?\s+(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]|bis\b|ter\b|quater\b|rue|avenue|av\.|boulevard|bd|place|allée|chemin|impasse|quai|cours|route|square|passage|\d{5}\s)")
#: A German street is found by its number and postcode; its name is then read backwards.
GERMAN_ADDRESS = re.compile(rf"\d(?<![\w,.]\d)\d{{0,3}}(?:\s?[a-z](?!\w))?,?\s+\d{{5}}\s+{_TOWN}")
_STREET = re.compile(r"(?:(?<!\w)(?:Am|An|Im|Auf|Zum|Zur|Alte|Neue|Große|Kleine)\s+(?:der\s+|dem\s+)?)?(?<![\w\-])[A-ZÄÖÜ][\wäöüß\-]*\.?\s*\Z")
_STREET_END = re.compile(r"(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer|damm|ring|steig|hof|markt)\s+\d{1,4}")
_NUMBERED = re.compile(r"\d{2}")
_RUN = re.compile(r"\d+")

_TITLE_WORDS = [w + e for w in TITLES.split() for e in (" ", ". ", "\n", ".\n")] + ["M. ", "M.\n", "MM. "]
_ANCHORS: ahocorasick.Automaton | None = None


def _automaton(words) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for key, value in words:
        made.add_word(key, value)
    made.make_automaton()
    return made


def _anchors() -> ahocorasick.Automaton:
    """Titles and roles; a value is the length of the word without what follows."""
    global _ANCHORS
    if _ANCHORS is None:
        words = {w: len(w.rstrip()) for w in _TITLE_WORDS} | {r + e: len(r) for r in ROLES for e in (" ", "\n")}
        _ANCHORS = _automaton((w, (len(w), n)) for w, n in words.items())
    return _ANCHORS


def _anchor_ends(text: str) -> list[int]:
    """Where titles and roles end."""
    ends = set()
    for last, (length, bare) in _anchors().iter(text):
        start = last - length + 1
        if start and (text[start - 1].isalnum() or text[start - 1] in "-'’"):
            continue
        ends.add(start + bare)
    return sorted(ends)


_SCANNED = re.compile(r"[01](?:(?<=[A-Za-zÀ-ÿ].)[01]*(?=[a-zà-ÿ'’\-]|\b)|(?<=[A-ZÀ-Þ].)[01]*(?=[A-ZÀ-Þ]))")
_ZERO_ONE = str.maketrans("01", "ol")


def _reread(text: str) -> str:
    """The text with 0 and 1 inside words read as o and l, as scanners confuse them; no position moves."""
    return _SCANNED.sub(lambda m: m[0].translate(_ZERO_ONE), text) if "0" in text or "1" in text else text


def _learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch, in how many texts a word stands first (1) or second (2) after a title, or alone (3), or anywhere (4)."""
    for batch in batches:
        counts: dict[tuple[str, int], int] = {}
        for text in batch["text"]:
            if not text:
                continue
            text = _reread(text)
            seen = set()
            for end in _anchor_ends(text):
                m = _LEARN.match(text, end)
                if m:
                    seen.add((m[1], 1))
                    seen.add((m[2], 2))
                    continue
                m = _after_titles(text, end)
                if m:
                    seen.add((m["surname"], 3))
            seen.update((word, 4) for word in set(_CAPITALISED.findall(text)))
            for key in seen:
                counts[key] = counts.get(key, 0) + 1
        yield pd.DataFrame([(w, p, n) for (w, p), n in counts.items()], columns=["word", "place", "n"])


#: Of all texts that hold a word, the share in which it must follow a title to be a name: towns and common words do so now and then.
NAMED_SHARE = 0.08
#: Bound of the lexicons' words, which every worker holds; a corpus with more is refused, never cut.
MOST_NAMES = 1_000_000


def lexicons(documents: DataFrame) -> tuple[list[str], list[str]]:
    """Given names and surnames of the corpus, from all its texts.

    A given name stands first after titles in three texts or more, and at most half as often second; a surname
    stands second or alone in three or more; both in NAMED_SHARE of the texts they are in at all, so that what
    becomes a name doesn't grow with the corpus.  Every word that passes counts; more than MOST_NAMES are an error.
    """
    counts = spread(documents.select("text").where("text is not null")).mapInPandas(_learned, "word string, place int, n long")
    at = lambda *places: F.sum(F.when(F.col("place").isin(*places), F.col("n")).otherwise(0))
    rated = counts.groupBy("word").agg(at(1).alias("a"), at(2).alias("b"), at(2, 3).alias("c"), at(4).alias("d")).where(f"greatest(a, c) >= 3 and greatest(a, c) >= {NAMED_SHARE} * d")
    kept = rated.withColumn("given", F.expr(f"a >= 3 and a >= 2 * b and a >= {NAMED_SHARE} * d")).withColumn("family", F.expr(f"c >= 3 and c >= {NAMED_SHARE} * d")).where("given or family").limit(MOST_NAMES + 1).collect()
    if len(kept) > MOST_NAMES:
        raise ValueError(f"the corpus holds more than {MOST_NAMES} names")
    kept.sort(key=lambda r: (-max(r["a"], r["c"]), r["word"]))
    given = [r["word"] for r in kept if r["given"] and r["word"] not in COMMON]
    known = set(given)
    return given, [r["word"] for r in kept if r["family"] and r["word"] not in known and r["word"] not in COMMON]


def _words_back(text: str, at: int, n: int) -> int:
    """Where the n-th word before ``at`` begins, however long the words are."""
    for _ in range(n):
        while at and text[at - 1] in " \n\t":
            at -= 1
        while at and text[at - 1] not in " \n\t":
            at -= 1
    return at


def _before_given(text: str, at: int) -> int:
    """Where a surname and its particles before a given name at ``at`` may begin, one character of context more."""
    while at and text[at - 1] in " \n\t,":
        at -= 1
    return max(0, _words_back(text, _parts_back(text, at), 3) - 2)


def _parts_back(text: str, at: int) -> int:
    """Where the run of letters, apostrophes and hyphens before ``at`` begins; a hyphen may end a line."""
    while at and (text[at - 1].isalpha() or text[at - 1] in "-'’" or (text[at - 1] == "\n" and at > 1 and text[at - 2] == "-")):
        at -= 1
    return at


class Finder:
    """Finds the pieces of one text, by the lexicons of given names and surnames."""

    def __init__(self, given: list[str], surnames: list[str] = ()):
        self.given = frozenset(given) | frozenset(g.upper() for g in given)
        self.automaton = _automaton((g, len(g)) for g in sorted(self.given)) if given else None
        every = {w for s in surnames for w in (s, s.upper())} - self.given
        self.surnames = _automaton((w, len(w)) for w in sorted(every)) if every else None

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) of the pieces of the text, in order, none overlapping."""
        spans: list[tuple[str, int, int]] = []
        taken = bytearray(len(text) + 1)

        def take(kind: str, start: int, end: int) -> None:
            if start < end and not any(taken[start:end]):
                taken[start:end] = b"\x01" * (end - start)
                spans.append((kind, start, end))

        if "@" in text:
            for m in EMAIL.finditer(text):
                take("email", *m.span())
        if _RUN.search(text):
            numbered = bool(_NUMBERED.search(text))  # an address needs one digit only
            numbers: list[tuple[int, int, int]] = []
            for m in _RUN.finditer(text):
                start, end = m.span()
                after = text[end : end + 1]
                before = text[start - 1] if start else ""
                spaced = after in " \n"
                size, worded = end - start, before.isalnum() or before == "_"
                if size <= 5 and (spaced or after == "," or after.isalpha()) and not worded and before != "." and _HOUSE.match(text, end):
                    for pattern in ADDRESSES:
                        found = pattern.match(text, start)
                        if found:
                            flat = _FLAT.search(text, _words_back(text, start, 3), start)
                            take("address", flat.start() if flat else start, found.end())
                    found = GERMAN_ADDRESS.match(text, start)
                    if found:
                        street = _STREET.search(text, _words_back(text, start, 4), start)
                        if street and _STREET_END.search(text, street.start(), found.end()):
                            take("address", street.start(), found.end())
                if not numbered:
                    continue
                # each format has its first digits and what follows them
                if not worded and ((size <= 2 and spaced) or (size in (3, 4) and after == "-") or (size == 6 and (after == "/" or after.isupper())) or (size == 8 and after.isupper())):
                    found = ID_FORMATS[0].match(text, start)
                    if found:
                        numbers.append((0, *found.span()))
                        continue
                if before in ("+", "("):
                    start -= 1
                    if before == "(" and start and text[start - 1] == "+":
                        continue
                elif not (spaced or after in "-/.") or (text[start] != "0" and not (size == 3 and after in ".-")):
                    continue
                found = PHONE.match(text, start)
                if found:
                    numbers.append((1, *found.span()))
            for m in ID_FORMATS[1].finditer(text) if numbered else ():
                take("id_number", *m.span())
            for kind, start, end in numbers:
                if kind == 0:
                    take("id_number", start, end)
            for m in ID_LABELLED.finditer(text) if numbered else ():
                value = m["value"].rstrip(" \n-/")
                if sum(c.isdigit() for c in value) >= 5:
                    take("id_number", m.start("value"), m.start("value") + len(value))
            for kind, start, end in numbers:
                if kind and 9 <= sum(c.isdigit() for c in text[start:end]) <= 15 and not _PLACE_DATE.match(text[start:end]):
                    take("phone", start, end)
        self._names(_reread(text), take)
        return sorted(spans, key=lambda s: s[1])

    def _names(self, text: str, take) -> None:
        surnames: set[str] = set()
        noble: set[str] = set()  # surnames that have a particle: elsewhere "de" is a preposition
        found: list[tuple[int, int]] = []

        def surname(m: re.Match) -> bool:
            word = m["surname"]
            if word in COMMON or word in self.given:
                return False
            surnames.add(word)
            if m["particle"]:
                noble.add(word.lower())
            return True

        at_given: list[tuple[int, int]] = []
        if self.automaton:
            for last, length in self.automaton.iter(text):
                start, end = last - length + 1, last + 1
                if (start and (text[start - 1].isalnum() or text[start - 1] in "-'’")) or (end < len(text) and (text[end].isalnum() or text[end] == "-")):
                    continue
                at_given.append((start, end))
        for start, end in at_given:
            m = _REST.match(text, end)
            if m and (m["initials"] or m["particle"]) and surname(m):
                found.append((start, m.end()))
                continue
            edge = start - 1
            while edge > 0 and text[edge] in " \n\t":
                edge -= 1
            before = edge < start - 1 and (text[edge] == "," or text[edge].isupper()) and _BEFORE_GIVEN.search(text, _before_given(text, start), start)
            if before:
                word = before["upper"] or before["comma"]
                if word not in COMMON and word not in self.given:
                    surnames.add(word)
                    if before["particle"]:
                        noble.add(word.lower())
                    found.append((before.start(), _TAIL.match(text, end).end()))
        for end in _anchor_ends(text):
            m = _after_titles(text, end)
            if m and surname(m):
                found.append((m.start("name"), m.end()))
        for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
            take("name", start, end)
        if self.surnames:
            for last, length in self.surnames.iter(text):
                start, end = last - length + 1, last + 1
                if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
                    continue
                if start and text[start - 1] in "-'’":  # a part of a double name, or with a prefix
                    start -= len(_PARTS_BEFORE.search(text[_parts_back(text, start) : start])[0])
                if text[end : end + 1] == "-":
                    end = _PARTS_AFTER.match(text, end).end()
                if (start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "_&-'’")) and not _NOT_NAME.match(text, end):
                    surnames.add(text[start:end].replace("\n", ""))
        for name in surnames:
            lead = _NOBLE_LEAD if name.lower() in noble else _LEAD
            for word in {name, name.upper(), _title(name), *((name.replace("-", "-\n"),) if "-" in name else ())}:
                at = text.find(word)
                while at >= 0:
                    end = at + len(word)
                    if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_&-")) and not _NOT_NAME.match(text, end):
                        initial = "." in text[max(0, at - 4) : at]  # only then initials stand before
                        take("name", at - len(lead.search(text[_words_back(text, at, 5) : at])[0]) if initial or lead is _NOBLE_LEAD else at, end)
                    at = text.find(word, end)


def _after_titles(text: str, at: int) -> re.Match | None:
    """The name after a title or role that ends at ``at``, further titles skipped."""
    while m := _TITLE_AGAIN.match(text, at):
        at = m.end()
    return _AFTER.match(text, at)


def _title(word: str) -> str:
    return re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), word) if word.isupper() else word


_PARTS_BEFORE = re.compile(rf"(?:(?:{_UNIT}|{_UPPER})-\n?)*(?:(?<!\w)[OD]['’])?\Z")
_PARTS_AFTER = re.compile(rf"(?:-\n?(?:{_UNIT}|{_UPPER})(?!\w))*")
_TAIL = re.compile(r"(?: [A-ZÀ-Þ]\.(?! ?[A-Z]\.))?")
_NOT_NAME = re.compile(rf"[\w\-]|{_WS}&|{_WS}{ORGANISATION}\b|{_WS}{_CAP}{_WS}{ORGANISATION}\b")
_LEAD = re.compile(rf"(?:(?<![\w.]){_INITIALS}\s?)?\Z")
_NOBLE_LEAD = re.compile(rf"(?:(?<![\w.]){_INITIALS}\s?)?(?:(?<!\w){PARTICLES})?\Z")
_TITLE_AGAIN = re.compile(rf"\.?\s+(?:(?:{'|'.join(TITLES.split())}|Hon|HHJ|Vors|MM|M|Richterin|Richter|am\s+\w+gericht|med|jur)(?:\.|(?=\s)))")
_AFTER = re.compile(rf"\.?{_WS}(?P<name>(?:{_INITIALS}{_WS}?)?(?P<particle>{PARTICLES})?(?P<surname>{_ANY})){_NOT_ORGANISATION}")


def _finder(words: tuple[list[str], list[str]]):
    state: dict[str, Finder] = {}

    def get() -> Finder:
        if "it" not in state:
            state["it"] = Finder(*words)
        return state["it"]

    return get


def pieces(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos) of all personal information in ``documents``.

    Positions count code points from 0, the end exclusive; pieces don't overlap.  Null and empty texts have none.
    Rows of one id are taken to be one text; repeated rows give their pieces once.
    """
    get = _finder(lexicons(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = get()
        for batch in batches:
            rows = [(i, k, a, b) for i, t in zip(batch["doc_id"], batch["text"]) if t for k, a, b in finder.find(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_pos", "end_pos"])

    found = spread(documents.select("doc_id", "text").where("text is not null and doc_id is not null")).mapInPandas(run, "doc_id long, pii_type string, start_pos long, end_pos long")
    return found.distinct()


def replaced(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        value = " ".join(text[start:end].split())
        out += [text[at:start], f"[{kind.upper()}:{name_pseudonym(value, key) if kind == 'name' else pseudonym(value, key)}]"]
        at = end
    return "".join([*out, text[at:]])


def masked(documents: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_pieces) with each piece replaced by its type and its pseudonym, the rest unchanged.

    A pseudonym has the format of the value, its line breaks made blanks.  Null texts stay null.
    """
    get, secret = _finder(lexicons(documents)), key.encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = get()
        for batch in batches:
            spans = [finder.find(t) if t else [] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [replaced(t, s, secret) if t else t for t, s in zip(batch["text"], spans)], "n_pieces": [len(s) for s in spans]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, text string, n_pieces int")
