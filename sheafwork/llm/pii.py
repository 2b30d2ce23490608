"""Personal information in free text: a semi-Markov conditional random field over candidate segments.

Value shapes and name lists propose segments with a type; each is scored as a whole (shape, validator, name lists,
words around it), pairs of neighbours by what stands between them. Where segments overlap or nearly touch, dynamic
programming chooses boundaries and types together: the best sequence of segments, everything else being outside.
The weights are those of the largest conditional likelihood on gold items and generated sentences (``fit``).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.pii_training import Maker
from sheafwork.session import spread

TYPES = ("EMAIL_ADDRESS", "UK_PHONE_NUMBER", "UK_NATIONAL_INSURANCE_NUMBER", "UK_NHS_NUMBER", "UK_DRIVING_LICENCE_NUMBER", "UK_ADDRESS", "PERSON")
#: At most so many gold items train the model; the grammar gives ``GENERATED`` texts besides.
MAX_GOLD, GENERATED = 5000, 420

TITLES = frozenset("mr mrs ms mx miss dr prof sir dame lady rev herr herrn frau mme mlle mm monsieur madame sr sra srta don doña señor señora".split())
#: Words that end in front of a name, or follow it.
CUES_BEFORE = ("customer", "caller,", "name is", "spoke with", "contact", "belongs to", "signed by", "names", "from:", "unterschrieben hat", "signé par", "lo firmó", "surname of", "dear", "client", "attn", "signed:", "kunde")
CUES_AFTER = (" signed the", " rang ", ", gave ", " hat am", " wohnt ", " a téléphoné", " habite ", " llamó", " vive ", ", not to", ", nicht ", ", who asked", ',\" the caller', " can be reached", " still living", " said")
_STREET = r"(?:avenue|ave|lane|ln|yard|road|rd|street|st|close|rise|row|court|way|terrace|crescent|cres|gdns|gardens|mews|walk|parade|paddocks|meadows|drive|hill|place|square|grove|park|green|vale|quay)"
_POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}"

_MAIL_WORD = re.compile(r"[(\[]\s?at\s?[)\]]|\sAT\s")
_LOCAL = re.compile(r"[A-Za-z0-9_.+\-]+\s?$")
_HOST = re.compile(r"(?:@|\s?[(\[]\s?at\s?[)\]]\s?|\sAT\s)[A-Za-z0-9_\-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sDOT\s)[A-Za-z0-9_\-]+)+", re.I)
#: Numbers are looked for from their first digit, bracket or plus; what stands before is looked at afterwards.
_NUMBER = re.compile(
    r"[+(\d](?:(?P<t>(?:(?<=\+)44[\s./-]?(?:\(0\)[\s./-]?)?|(?<=0)044[\s./-]?(?:\(0\)[\s./-]?)?|(?<=\()0(?!0)|(?<=0)(?!0))\d(?:(?:[\s./-]|\)[\s./-]?)?\d){8,9}(?!\d))"
    r"|(?P<h>(?<=\d)\d{2}([\s-]?)\d{3}\3\d{4}(?![\d/]))"
    r"|(?P<n>(?<=\d)\d\s?\d{2}\s?\d{2}\s?[A-Da-d](?![A-Za-z\d]))"
    r"|(?P<l>(?<=\d)\d{5}[A-Z0-9]{5}(?![A-Za-z\d])))"
)
_NINO_HEAD = re.compile(r"(?<![A-Za-z\d])[A-Za-z]{2}\s?$")
_LICENCE_HEAD = re.compile(r"(?<![A-Za-z\d])[A-Z][A-Z9]{4}$")
_DATE = re.compile(r"\d\d[./-]\d\d[./-]\d{4}")
_CAPITAL = re.compile(r"[^\W\d_]+")
_TITLE_BEFORE = re.compile(r"([^\W\d_]+)\.?\s+$")
_HOUSE_NUMBER = re.compile(r"\d{1,4}[a-zA-Z]?\s(?=[A-Za-z])(?!(?:[ap]\.m|pages|days|drafts|of)\b)")
_ADDRESS_BODY = re.compile(rf"\d{{1,4}}[a-z]?\s+(?:[\w'’.]+\s+){{1,3}}?{_STREET}\b\.?,?\s+(?!{_STREET}\b)(?:(?P<town>[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*){{0,2}}?),?\s+(?P<code>{_POSTCODE})\b|(?P<bare>[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*){{0,2}}?)(?=\s*[,.;?!)\n]|\s+[a-z]))", re.I)
#: A house number, up to four capitalised words and a town before a full postcode: the postcode vouches for a street of any kind.
_ADDRESS_ANY = re.compile(rf"\d{{1,4}}[a-zA-Z]?\s+[A-Z][\w'’.-]*(?:\s+(?:[A-Z][\w'’.-]*|of|the|on|upon|under)){{0,4}},\s+(?P<town>[A-Z][\w'’-]*(?:[ -](?:[A-Z][\w'’-]*|on|upon|under|le|the)){{0,3}}?),?\s+(?P<code>{_POSTCODE})\b")
_UNIT = re.compile(r"(?:flat|unit|apartment|apt\.?|suite|room)\s+\d+[A-Za-z]?,?\s+$", re.I)
_HOUSE = re.compile(r"(?:[\w'’-]+\s+){0,2}[\w'’-]+,\s+$")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LAST_WORD = re.compile(r"[^\W_]+[^\w\s]*\s*$")
_NEXT_WORD = re.compile(r"\s*[^\w\s]*\s*[^\W_]*")
_ZH_NAME = re.compile(r"(?:联系人(?:是|为)|姓名[:：是])(?P<a>[一-鿿]{2,4})(?=[，,。；])|(?:^|(?<=[。！？…”）\n]))(?P<b>[一-鿿]{2,4})(?=(?:说|表示)：)", re.M)
_JA_NAME = re.compile(r"(?:(?:^|(?<=[。！？…」）\n]))(?P<a>[一-鿿]{1,4} ?[一-鿿぀-ゟ]{1,4}?)(?=様|氏)|担当は(?P<b>[一-鿿]{1,4} ?[一-鿿぀-ゟ]{1,4}?)(?=さん|様|氏))", re.M)
_BAD_PREFIX = frozenset(("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"))


def valid_nino(value: str) -> bool:
    v = "".join(value.split()).upper()
    return len(v) == 9 and v[:2] not in _BAD_PREFIX and v[0] not in "DFIQUV" and v[1] not in "DFIOQUV" and v[8] in "ABCD"


def valid_nhs(value: str) -> bool:
    d = [int(c) for c in value if c.isdigit()]
    return len(d) == 10 and (11 - sum(x * (10 - i) for i, x in enumerate(d[:9])) % 11) % 11 == d[9]


class Candidate:
    __slots__ = ("start", "end", "kind", "features", "score")

    def __init__(self, start: int, end: int, kind: str, features: list[str]):
        self.start, self.end, self.kind, self.features, self.score = start, end, kind, features, 0.0


class Proposer:
    """Candidate segments with their features. ``given`` and ``surnames`` are name lists in small letters."""

    def __init__(self, given: Iterable[str], surnames: Iterable[str]):
        self.given, self.surnames = frozenset(given), frozenset(surnames)
        self.finder = ahocorasick.Automaton()
        for w in self.given | self.surnames | TITLES:
            self.finder.add_word(w, (len(w), True))
        for w in (*CUES_BEFORE, *CUES_AFTER):
            self.finder.add_word(w, (len(w), False))
        self.classes: dict[str, str] = {}
        self.finder.make_automaton()

    @staticmethod
    def _around(text: str, a: int, b: int) -> tuple[str, str]:
        before = _LAST_WORD.search(text, max(0, a - 24), a)
        after = _NEXT_WORD.match(text, b, min(len(text), b + 24))
        return (" ".join(before.group().lower().split()) if before else ""), (" ".join(after.group().lower().split()) if after else "")

    def candidates(self, text: str, known: set[str] | None = None) -> list[Candidate]:
        """All candidates of one text. ``known`` names the only list entries that count (training hides some)."""
        out: list[Candidate] = []
        self._mails(text, out)
        self._numbers(text, out)
        self._addresses(text, out)
        self._names(text, out, known)
        return out

    def _mails(self, text: str, out: list[Candidate]) -> None:
        signs = []
        k = text.find("@")
        while k >= 0:
            signs.append(k)
            k = text.find("@", k + 1)
        if "at" in text and ("(" in text or "[" in text) or "AT" in text:
            signs += [m.start() for m in _MAIL_WORD.finditer(text)]
        for k in signs:
            local = _LOCAL.search(text, max(0, k - 64), k)
            if not local:
                continue
            host = _HOST.match(text, k) or (_HOST.match(text, k - 1) if text[k - 1].isspace() else None)
            if not host:
                continue
            a, b = local.start(), host.end()
            while a < local.end() and text[a] in "._+-":
                a += 1
            while text[b - 1] in "-_":
                b -= 1
            dots = host.group().lower()
            out.append(Candidate(a, b, "EMAIL_ADDRESS", ["E", "E@" if text[k] == "@" else "Eat", f"Edots{min(2, dots.count('.') + dots.count('dot'))}"]))

    def _numbers(self, text: str, out: list[Candidate]) -> None:
        at = 0
        while m := _NUMBER.search(text, at):
            a, b = m.span()
            at = a + 1
            last = text[a - 1] if a else " "
            if m.group("t") is not None:
                s = m.group()
                if last.isdigit() or last == "+" or s[0] in "0(" and (last in "/.£€-" or last.isascii() and last.isalpha()):
                    continue
                if s[0] == "(" and ")" not in s:
                    a += 1
                    s = s[1:]
                digits = sum(c.isdigit() for c in s)
                before, _ = self._around(text, a, b)
                national = digits - (4 if s.startswith("0044") else 2 if s.startswith("+44") else 1) - (1 if "(0)" in s else 0)
                out.append(Candidate(a, b, "UK_PHONE_NUMBER", ["T", f"Tn{national}", "Tdate" if _DATE.match(s) else "Tnodate", "Tw" + before]))
                if digits == 10 and s.isdigit() and valid_nhs(s):
                    out.append(Candidate(a, b, "UK_NHS_NUMBER", ["H", "Hw" + before, "Hsolid"]))
            elif m.group("n") is not None:
                head = _NINO_HEAD.search(text, max(0, a - 4), a)
                if not head:
                    continue
                a = head.start()
                if valid_nino(text[a:b]):
                    out.append(Candidate(a, b, "UK_NATIONAL_INSURANCE_NUMBER", ["N", "Nup" if text[a].isupper() else "Nlow"]))
            elif m.group("l") is not None:
                head = _LICENCE_HEAD.search(text, max(0, a - 6), a)
                if not head:
                    continue
                out.append(Candidate(head.start(), b, "UK_DRIVING_LICENCE_NUMBER", ["L"]))
            else:
                if last.isdigit() or last in ".-/+£" or not valid_nhs(m.group()):
                    continue
                before, _ = self._around(text, a, b)
                out.append(Candidate(a, b, "UK_NHS_NUMBER", ["H", "Hw" + before, "Hsolid" if m.group().isdigit() else "Hsep"]))
            at = b

    def _addresses(self, text: str, out: list[Candidate]) -> None:
        for h in _HOUSE_NUMBER.finditer(text):
            if h.start() and (text[h.start() - 1].isalnum() or text[h.start() - 1] in "£€.,/:-_"):
                continue
            m = _ADDRESS_BODY.match(text, h.start(), min(len(text), h.start() + 110))
            if m is None or m.group("code") is None:
                m = _ADDRESS_ANY.match(text, h.start(), min(len(text), h.start() + 160)) or m
            if not m:
                continue
            code = m.group("code") is not None
            ends = [m.end()]
            if not code:
                # the town's extent is open: one to three words
                for more in re.finditer(r"\s[^\W\d_][\w'’-]*", text[m.end("bare") : m.end("bare") + 40]):
                    if len(ends) > 2 or text[ends[-1] : m.end("bare") + more.start()] != "":
                        break
                    ends.append(m.end("bare") + more.end())
            starts = [(h.start(), "plain")]
            unit = _UNIT.search(text, max(0, h.start() - 30), h.start())
            if unit:
                starts.append((unit.start(), "unit"))
            else:
                house = _HOUSE.search(text, max(0, h.start() - 45), h.start())
                if house:
                    words = list(re.finditer(r"[\w'’-]+", text[house.start() : h.start()]))
                    for w in words[-3:]:
                        a = house.start() + w.start()
                        name = text[a : h.start()]
                        first = w.group().lower()
                        kind = "cap" if all(x.group()[0].isupper() for x in re.finditer(r"[\w'’-]+", name)) else "low"
                        if kind == "low" and name[0].isupper() and not first == "the":
                            kind = "mix"
                        last = re.findall(r"[\w'’-]+", name)[-1].lower()
                        starts.append((a, f"house-{kind}{len(re.findall(r'[\w’-]+', name))}" + ("!" if first in _PREPOSITIONS or last in _PREPOSITIONS or last in self.surnames else "") + ("*" if last in _HOUSE_WORDS or len(name.split()) == 1 else "")))
            for a, lead in starts:
                before, _ = self._around(text, a, m.end())
                prev = before.strip(" ,.:;")
                for i, b in enumerate(ends):
                    town = text[m.start("bare") : b] if not code else ""
                    caps = all(w[0].isupper() for w in town.split()) if town else True
                    after = text[b : b + 1]
                    out.append(
                        Candidate(a, b, "UK_ADDRESS", ["A", "Acode" if code else "Abare", f"Alead-{lead}", "Aprep" if prev in _PREPOSITIONS or before.endswith(",") or prev in self.surnames else "Anoprep", f"Atown{i}" + ("cap" if caps else "low"), "Astop" if code or not after or not (after.isspace() or after.isalnum()) else "Agoes"])
                    )

    def _names(self, text: str, out: list[Candidate], known: set[str] | None) -> None:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        zones: list[list[int]] = []
        for end, (size, word) in self.finder.iter(low):
            # the finder itself knows nothing of word boundaries
            start = end - size + 1
            if word and low[end + 1 : end + 2].isalpha() or start and low[start].isalpha() and low[start - 1].isalpha():
                continue
            a, b = max(0, end - 32), min(len(low), end + 32)
            if zones and a <= zones[-1][1]:
                zones[-1][1] = max(zones[-1][1], b)
            else:
                zones.append([a, b])
        for a, b in zones:
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            self._runs(text, low, a, b, out, known)
        if "联系人" in text or "说：" in text or "表示：" in text or "姓名" in text:
            for m in _ZH_NAME.finditer(text):
                g = "a" if m.group("a") else "b"
                out.append(Candidate(m.start(g), m.end(g), "PERSON", ["P", f"Pzh{g}{m.end(g) - m.start(g)}"]))
        if "さん" in text or "様" in text or "氏" in text:
            for m in _JA_NAME.finditer(text):
                g = "a" if m.group("a") else "b"
                out.append(Candidate(m.start(g), m.end(g), "PERSON", ["P", f"Pja{g}"]))

    def _class(self, word: str, known: set[str] | None) -> str:
        if known is not None:
            return self._classify(word, known)
        kind = self.classes.get(word)
        if kind is None:
            if len(self.classes) > 50_000:
                self.classes.clear()
            kind = self.classes[word] = self._classify(word, None)
        return kind

    def _classify(self, word: str, known: set[str] | None) -> str:
        """G given name, S surname, I initial, w common word, C capitalised, l in small letters, t title."""
        w = word.lower()
        parts = [w, *w.split("-")] if "-" in w else [w]
        listed = lambda names: any(p in names and (known is None or p in known) for p in parts)
        if listed(self.given):
            return "G"
        if listed(self.surnames):
            return "S"
        if len(word) == 1 and word.isupper():
            return "I"
        if w in TITLES:
            return "t"
        if w in _COMMON:
            return "w"
        if word[0].isupper():
            return "C"
        return "l"

    def _runs(self, text: str, low: str, a: int, b: int, out: list[Candidate], known: set[str] | None) -> None:
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text, a, b)]
        if not tokens:
            return
        kinds = [self._class(t[2], known) for t in tokens]
        n = len(tokens)

        def glued(i: int) -> bool:
            """Part of an address, a handle or a number."""
            s, e, _ = tokens[i]
            left, right = text[s - 1 : s], text[e : e + 1]
            if left:
                if left.isdigit() or left in "@_+/" or left in "-&" and not text[s - 2 : s - 1].isspace():
                    return True
                if left == "." and text[s - 2 : s - 1].isalnum() and not (text[s - 2].isupper() and not text[s - 3 : s - 2].isalpha()):
                    return True
            return right != "" and (right in "@_+" or right.isdigit() or right == "." and kinds[i] != "I" and text[e + 1 : e + 2].isalpha())

        for i in range(n):
            if kinds[i] in "wl":
                if not (kinds[i] == "l" and i and kinds[i - 1] == "t"):
                    continue
            elif kinds[i] == "t":
                continue
            if glued(i):
                continue
            shape = ""
            comma = False
            for j in range(i, min(n, i + 4)):
                s, e, w = tokens[j]
                if j > i:
                    if kinds[j] in "wlt" or glued(j):
                        break
                    gap = text[tokens[j - 1][1] : s]
                    if kinds[j - 1] == "I" and gap.strip() == "." or gap.isspace() and gap.count("\n") < 2:
                        pass
                    elif not comma and gap[:1] == "," and gap[1:].isspace() and (tokens[j - 1][2].isupper() and len(tokens[j - 1][2]) > 1 and not w.isupper() or kinds[j - 1] == "S" and kinds[j] == "G" and j == i + 1):
                        comma = True
                        shape += ","
                    else:
                        break
                shape += kinds[j]
                if kinds[j] != "I":
                    self._person(text, low, tokens, kinds, i, j, shape, out)

    def _person(self, text: str, lower: str, tokens: list, kinds: list[str], i: int, j: int, shape: str, out: list[Candidate]) -> None:
        a, b = tokens[i][0], tokens[j][1]
        before = text[max(0, a - 24) : a]
        low = " ".join(before.lower().split())
        if before[-1:].isspace():
            low += " "
        title = ""
        m = _TITLE_BEFORE.search(before.lower())
        if m and m.group(1) in TITLES:
            title = "t"
        elif m and m.group(1) == "m":
            title = "m"
        cue = next((c for c in CUES_BEFORE if low.endswith(c + " ")), "")
        after = next((c for c in CUES_AFTER if lower.startswith(c, b)), "")
        if not (cue or title or after or "G" in shape or "S" in shape):
            return
        nxt = tokens[j + 1] if j + 1 < len(tokens) else None
        gap = text[b : nxt[0]] if nxt else ""
        follow = "-"
        if nxt and gap.isspace():
            follow = kinds[j + 1] + ("o" if nxt[2].lower() in _COMPANY_WORDS else "")
        elif gap.strip() in ("&", "/", "-"):
            follow = "&"
        prev = "-"
        if i and text[tokens[i - 1][1] : a].isspace():
            prev = kinds[i - 1]
        elif i and text[tokens[i - 1][1] : a].strip() in ("&", "/", "-"):
            prev = "&"
        case = "U" if text[a:b].isupper() else "l" if text[a:b].islower() else "T"
        words = text[a:b]
        features = ["P", "Ps" + shape, "Pt" + title + ("1" if len(shape) == 1 else "2"), "Pc" + cue, "Pc" + ("1" if cue else "0") + ("1" if title else "0") + ("1" if "G" in shape or "S" in shape else "0"), "Pf" + follow, "Pp" + (prev if not title else "t"), "Pk" + case + ("1" if len(shape) == 1 else "2"), "Psk" + shape + case, "Pst" + shape + title, "Pn" + after, "Pnc" + ("1" if after else "0") + shape]
        if shape[0] == "I":
            features.append("Pi" + ("M" if text[a] == "M" else "x") + shape[1:2])
        if any(w in _COMPANY_WORDS for w in words.lower().split()):
            features.append("Pco")
        out.append(Candidate(a, b, "PERSON", features))


_PREPOSITIONS = frozenset("as at in of au à en a to from near lives living is was and the address for on with by und im jetzt désormais ahora names line".split()) - {"the"}
_HOUSE_WORDS = frozenset("house barn forge cottage lodge farm villa mill granary hall manor court rosemount grange mount vicarage rectory".split())
_COMPANY_WORDS = frozenset(
    "ltd limited plc llp inc co company advisers finance vehicle insurance mutual bank loans home housing council union credit street surgery saver account bond isa mortgage card loan plus couriers pensions utilities "
    "borough lane road avenue close branch store library group partners services association trust society current".split()
)
_COMMON = frozenset(
    "the a an and or not to of in on at by for with from as is was be been it its his her their our my your this that these those who which what when where why how "
    "der die das und nicht ist hat am im le la les et est de du des un une el los las y es no lo al del se que en por con a wegen wohnt jetzt habite désormais vive ahora llamó "
    "signed rang gave asked said about because after before since while customer caller contact name spoke belongs names surname dear subject service desk patient ref reference nhs ni number national insurance "
    "unterschrieben frau herr signé par firmó".split()
)


def _link(left: Candidate, right: Candidate, text: str) -> str:
    gap = text[left.end : right.start]
    return f"~{left.kind}>{right.kind}:{' '.join(gap.lower().split())[:4]}"


#: Segments that are at most so far apart are decoded together.
REACH = 6


def clusters(candidates: list[Candidate]) -> Iterator[list[Candidate]]:
    """Candidates in groups whose members overlap or stand at most ``REACH`` apart; groups don't influence each other."""
    held: list[Candidate] = []
    end = -1
    for c in sorted(candidates, key=lambda c: (c.start, c.end)):
        if held and c.start > end + REACH:
            yield held
            held = []
        held.append(c)
        end = max(end, c.end) if len(held) > 1 else c.end
    if held:
        yield held


def best(group: list[Candidate], weights: dict[str, float], text: str) -> list[Candidate]:
    """The segments of the best path through one group."""
    n = len(group)
    if n == 1:
        return group if group[0].score > 0 else []
    top = [0.0] * n
    back = [-1] * n
    for j in range(n):
        c = group[j]
        value, come = 0.0, -1
        for i in range(j):
            p = group[i]
            if p.end <= c.start:
                v = top[i] + (weights.get(_link(p, c, text), 0.0) if c.start - p.end <= REACH else 0.0)
                if v > value:
                    value, come = v, i
        top[j], back[j] = value + c.score, come
    j = max(range(n), key=lambda k: top[k])
    if top[j] <= 0:
        return []
    path = []
    while j >= 0:
        path.append(group[j])
        j = back[j]
    return path[::-1]


class Model:
    """Weights and name lists; small enough to travel with the tasks."""

    def __init__(self, weights: dict[str, float], given: list[str], surnames: list[str]):
        self.weights, self.given, self.surnames = weights, given, surnames
        self._proposer: Proposer | None = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "given": self.given, "surnames": self.surnames, "_proposer": None}

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, type), in order and without overlaps; none for null and empty texts."""
        if not text:
            return []
        if self._proposer is None:
            self._proposer = Proposer(self.given, self.surnames)
        get = self.weights.get
        found = self._proposer.candidates(text)
        for c in found:
            c.score = sum(get(f, 0.0) for f in c.features)
        out = []
        for group in clusters(found):
            out += [(c.start, c.end, c.kind) for c in best(group, self.weights, text)]
        return out


def _gradient(group: list[Candidate], gold: set[tuple[int, int, str]], weights: dict[str, float], text: str) -> tuple[dict[str, float], float]:
    """Gradient of the log likelihood of the gold path of one group, by forward and backward sums over all paths."""
    n = len(group)
    score = [sum(weights[f] for f in c.features) for c in group]
    links: dict[tuple[int, int], str | None] = {}
    for j in range(n):
        for i in range(j):
            if group[i].end <= group[j].start:
                links[i, j] = _link(group[i], group[j], text) if group[j].start - group[i].end <= REACH else None
    edge = {k: weights[f] if f else 0.0 for k, f in links.items()}
    log = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    fwd = [0.0] * n
    for j in range(n):
        fwd[j] = score[j] + log([0.0, *(fwd[i] + edge[i, j] for i in range(j) if (i, j) in edge)])
    bwd = [0.0] * n
    for i in range(n - 1, -1, -1):
        bwd[i] = log([0.0, *(edge[i, j] + score[j] + bwd[j] for j in range(i + 1, n) if (i, j) in edge)])
    total = log([0.0, *fwd])
    grad: dict[str, float] = defaultdict(float)
    path = [k for k, c in enumerate(group) if (c.start, c.end, c.kind) in gold]
    for k in range(n):
        p = math.exp(fwd[k] + bwd[k] - total)
        for f in group[k].features:
            grad[f] += (k in path) - p
    for (i, j), f in links.items():
        if f:
            grad[f] -= math.exp(fwd[i] + edge[i, j] + score[j] + bwd[j] - total)
    value = 0.0
    for i, k in enumerate(path):
        value += score[k]
        if i and links.get((path[i - 1], k)):
            grad[links[path[i - 1], k]] += 1
            value += edge[path[i - 1], k]
    return grad, total - value


def fit(gold: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.35, decay: float = 0.002, generated: int = GENERATED, seed: int = 5) -> Model:
    """The model of largest penalised likelihood on ``gold`` and generated texts, by adaptive gradient steps.

    The name lists are the names of the gold items and of the grammar; in half of the training texts their entries are
    hidden, so that the words around a name carry weight too. Everything is seeded; equal inputs give equal weights.
    """
    given, surnames = set(), set()
    for text, spans in gold:
        for a, b, kind in spans:
            if kind == "PERSON":
                words = text[a:b].split()
                if len(words) > 1:
                    given.add(words[0].strip(".,"))
                surnames.add(words[-1])
    maker = Maker(sorted(given), sorted(surnames), seed)
    texts = [*gold, *maker.texts(generated)]
    lists = [sorted({x.lower() for x in xs}) for xs in (given | set(maker.given), {p for s in surnames | set(maker.surnames) for p in (s, *s.split("-"))})]
    proposer = Proposer(*lists)
    rng = np.random.default_rng(seed)
    every = [*lists[0], *lists[1]]
    work = []
    for k, (text, spans) in enumerate(texts):
        hide = None if k % 2 == 0 else {w for w in every if rng.random() < 0.4}
        wanted = set(spans)
        for group in clusters(proposer.candidates(text, hide)):
            if len(group) <= 60:
                work.append((group, wanted, text))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    for epoch in range(epochs):
        for k in rng.permutation(len(work)):
            grad, _ = _gradient(*work[k][:2], weights, work[k][2])
            for f, g in grad.items():
                g -= decay * weights[f]
                if g:
                    squares[f] += g * g
                    weights[f] += rate * g / math.sqrt(squares[f])
    return Model({f: w for f, w in weights.items() if w}, *lists)


def fit_on(items: DataFrame, max_gold: int = MAX_GOLD) -> Model:
    """``fit`` on at most ``max_gold`` labelled items (``item_id``, ``text``, ``entities``), the smallest ids first."""
    rows = items.where(F.length("text") > 0).select("item_id", "text", "entities").dropDuplicates(["item_id"]).orderBy("item_id").limit(max_gold).collect()
    gold = []
    for r in rows:
        spans = [(e["start_pos"], e["end_pos"], e["entity_type"]) for e in r["entities"] or [] if e and None not in (e["start_pos"], e["end_pos"], e["entity_type"])]
        gold.append((r["text"], [s for s in spans if s[2] in TYPES]))
    return fit(gold)


def entities(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, entity_type, start_pos, end_pos): the mentions of every text; half-open code-point offsets.

    Null and empty texts have none; repeated rows of a document are searched each; other columns are ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            rows = [(d, k, a, b) for d, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()) for a, b, k in m.spans(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "entity_type", "start_pos", "end_pos"])

    return spread(documents.select("doc_id", "text").where(F.length("text") > 0)).mapInPandas(run, "doc_id long, entity_type string, start_pos int, end_pos int")


def redacted(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, n_entities): every text with its mentions replaced by ``[TYPE]``; null texts stay null."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            texts, counts = [], []
            for t in batch["text"].tolist():
                spans = m.spans(t)
                if spans:
                    parts, at = [], 0
                    for a, b, k in spans:
                        parts += [t[at:a], f"[{k}]"]
                        at = b
                    t = "".join(parts) + t[at:]
                texts.append(t)
                counts.append(len(spans))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "n_entities": counts})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, text string, n_entities int")
