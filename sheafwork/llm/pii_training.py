"""Labelled sentences made from a small grammar, beside which the gold items train the span model.

The gold items hold neither health nor licence numbers, hardly any form of a name but the plain one, and English only;
the grammar supplies these. Names, streets and towns are invented here or taken from the gold items.
"""

from __future__ import annotations

import random

GIVEN = "Alma Boris Carys Dario Edda Fabio Greta Henrik Ilse Jorge Kamala Levi Marta Nils Oskar Petra Quentin Rosa Sven Talia Ursula Viktor Wanda Xavier Yara Zane".split()
SURNAMES = "Abernethy Bastow Colquhoun Drummer Eastlake Fairweather Gilchrist Holroyd Isherwood Jellicoe Kirkbride Lockwood Mac Nair Nethercott O'Brannagh Pemberley Quarles Redmayne Sotherton Trelawney Underhay Vance Wetherby Yelland Müller D'Arcy Núñez Holt-Avery".replace("Mac ", "Mac").split()
STREETS = ["Mill Lane", "High Street", "Oak Avenue", "Castle Road", "Church St.", "Station Rd", "Priory Close", "Abbey Court", "Elm Rise", "Tower Row", "King's Yard", "Sea View Terrace", "Dale Crescent", "Park Way", "Old Mews", "Fir Gdns", "South Parade", "The Meadows", "Long Walk", "St. Anne's Close", "Beech Hill Road"]
TOWNS = ["Ashbourne", "Little Hadley", "Stow-on-Mere", "Kirby Cross", "Wexley", "Harlow End", "Castle Rowan", "Brackley", "Pentwyn"]
HOUSES = ["The Old Mill", "Rose Cottage", "Linden House", "Meadow Barn", "Fairmount", "The Granary", "Hill Lodge"]
COMPANIES = ["{s} Advisers LLP", "{s} Vehicle Finance", "{s} & {s2} Ltd", "{s} Street Surgery", "{s} Mutual", "{s} Insurance Co.", "{s} Home Loans", "{s} plc", "{s} Borough Council"]
PRODUCTS = ["{s} Saver", "{s} Current Account", "{s} Bond", "{s} ISA", "{s} Mortgage"]

#: Sentences; see ``_fill`` for the slots.
SENTENCES = (
    "The caller, {P}, gave NI no. {N} and mobile {T}.",
    "Customer {P} rang on Monday about the form.",
    '"My name is {P}," the caller said, "and the form has been filed."',
    "I spoke with {P} and {P} last week because the ink had faded.",
    "Contact {P} ({E}, tel. {T}) before 3 May 2020.",
    "{C} signed the form; the night shift witnessed it last week.",
    "{P} signed the mandate; our team witnessed it yesterday.",
    "Patient ref. {H} belongs to {P}, not to {O}.",
    "Her NHS number is {H}, which a clerk wrote on the page.",
    "The tracking code {K} for the form was matched by hand.",
    "Reference {B} on the form is a form code, not a person's number.",
    "National Insurance: {N}, confirmed last week.",
    "The driving licence {L} was shown as identity.",
    "The specimen was signed by {P}, who asked that replies go to {E} rather than to {O}.",
    "Its first line names {P} of {A}, and the second repeats the telephone number {T}.",
    "The clerk typed {N} and, below it, the surname of {S}.",
    "{S} can be reached on {T} after 5 o'clock.",
    "Is {S} still living at {A}?",
    "We wrote to {S} at {A}, but the form was lost.",
    "Sent to {S}, {A}, late on Friday.",
    "The form gives the address as {A}. Nobody answered.",
    "Dear {S},\n\nThe {R} rate moved on Monday.",
    "From: {P} {E}\nSubject: form XQ-383-275",
    "From: service desk\nSubject: form XQ-383-275",
    "Reply to {E} or ring {T}.",
    "Their old number {T} no longer works.",
    "Statement copies go to {E}; the short one was filed.",
    "{O} wrote to the back office yesterday.",
    "According to {O}, the form has been filed.",
    "The {R} rate moved from 3.1% to 4.2% on Friday.",
    "Staff at the {X} branch, incl. the night shift, checked the page.",
    "Call ext. 2876 for the {R}, open 9 a.m. to 5.30 p.m. on weekdays.",
    "Handle @desk5024 posted that the form is lost.",
    "Payment of £23.40 went from sort code 49-64-45 account 57679590 on Friday.",
    "Because {O} never numbered its sheets, the price of one form rose to £81.86.",
    "Long before the {R} was withdrawn, the desk lost all faith in the stamp.",
    "With the lights in the {X} store switched off, {O} printed another amount.",
    "The fee stays at £4.50 until 01/04/2025. 30 pages were read.",
    "When the archive at {W} was moved, 25 sheets were lost.",
    "Frau {G} hat am 3. Mai 2020 wegen des Vorgangs angerufen.",
    "Herr Dr. {G} wohnt jetzt in {A}. Schade!",
    "Unterschrieben hat {P}, nicht {O}.",
    "Die Versicherungsnummer {N} steht auf dem Auftrag.",
    "Antworten Sie an {E} oder rufen Sie {T} an.",
    "Mme {G} a téléphoné le 1er mai 2020 au sujet du dossier.",
    "M. {G} habite désormais au {A}. Merci.",
    "Le numéro {N} figure au verso, signé par {P}.",
    "Écrivez à {E} ou appelez le {T}.",
    "La Sra. {G} llamó el 3 de mayo de 2020 por el expediente.",
    "El Sr. {G} vive ahora en {A}. El tipo sube.",
    "El número {N} aparece al dorso y lo firmó {P}.",
    "Escriba a {E} o llame al {T}.",
    "联系人是{Z}，电话{T}，请在2024年2月回复。",
    "{Z}说：“表格归档有误。”",
    "收发室说，表格缺少第二页，约7.6%。",
    "担当は{J}さん、電話は{T}です。",
    "{J}様の表格は署名待ちです。",
    "支店によると、表格は判読できません。",
)
_ZH = ("欧容甄翟", ("若水", "明远", "听雨", "子衿"))
_JA = (("早乙女", "五十嵐", "長谷"), ("ゆうな", "隼", "千尋"))


def nhs(rng: random.Random) -> str:
    while True:
        d = [rng.randrange(10) for _ in range(9)]
        c = (11 - sum(x * (10 - i) for i, x in enumerate(d)) % 11) % 11
        if c < 10 and d[0]:
            s = "".join(map(str, [*d, c]))
            sep = rng.choice(["", " ", "-", " "])
            return sep.join((s[:3], s[3:6], s[6:]))


def _phone(rng: random.Random) -> str:
    body = rng.choice(["113 496 0" + str(rng.randrange(100, 999)), "20 7946 0" + str(rng.randrange(100, 999)), "7700 900 " + str(rng.randrange(100, 999)), "131 4960" + str(rng.randrange(100, 999))])
    head = rng.choice(["0", "0", "+44 ", "+44 (0)", "0044 ", "("])
    if head == "(":
        a, _, b = body.partition(" ")
        return f"(0{a}) {b}"
    out = head + body
    sep = rng.choice([" ", " ", "", "-", ".", "/"])
    return out.replace(" ", sep) if head == "0" else (out.replace(" ", "") if sep == "" else out)


def _nino(rng: random.Random) -> str:
    a = rng.choice("ABCEGHJKLMNPRSTWXYZ") + rng.choice("ABCEGHJKLMPRSTWXYZ")
    if a in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"):
        a = "AB"
    d = [f"{rng.randrange(100):02d}" for _ in range(3)]
    sep, inner = rng.choice([("", ""), (" ", " "), (" ", ""), (" ", " ")])
    out = a + sep + inner.join(d) + sep + rng.choice("ABCD")
    return out.lower() if rng.random() < 0.15 else out


class Maker:
    """Sentences with spans, from a fixed seed."""

    def __init__(self, given: list[str], surnames: list[str], seed: int = 11):
        self.rng = random.Random(seed)
        self.given, self.surnames = [*GIVEN, *given], [*SURNAMES, *surnames]

    def _value(self, slot: str) -> tuple[str, str | None, int]:
        """(text, type, characters before the entity)."""
        r = self.rng
        g, s, s2 = r.choice(self.given), r.choice(self.surnames), r.choice(self.surnames)
        ini = r.choice("ABCDEFGHJKLMNOPRSTW")
        if slot == "P":
            form = r.random()
            full = f"{g} {s}"
            if form < 0.12:
                full = f"{s.upper()}, {g}"
            elif form < 0.2:
                full = f"{g} {ini}. {s}"
            elif form < 0.3:
                full = f"{ini}. {s}"
            elif form < 0.34:
                full = f"{ini}.{r.choice('ABDEFL')}. {s}"
            elif form < 0.4:
                full = full.upper()
            elif form < 0.46:
                full = full.lower()
            elif form < 0.5:
                full = f"{g} {s}-{s2}"
            return full, "PERSON", 0
        if slot == "C":
            return f"{s.upper()}, {g}", "PERSON", 0
        if slot == "G":
            return f"{g} {s}", "PERSON", 0
        if slot == "S":
            t = r.choice(["Mr", "Mrs", "Ms", "Mx", "Dr.", "Prof.", "Mr.", "Mrs."])
            if r.random() < 0.1:
                t = t.lower()
            return f"{t} {s}", "PERSON", len(t) + 1
        if slot == "A":
            street, town = r.choice(STREETS), r.choice(TOWNS)
            number = str(r.randrange(1, 240)) + (r.choice("abc") if r.random() < 0.15 else "")
            head = r.random()
            lead = f"Flat {r.randrange(1, 30)}, " if head < 0.2 else f"Unit {r.randrange(1, 9)}{r.choice('AB')}, " if head < 0.3 else f"{r.choice(HOUSES)}, " if head < 0.45 else ""
            code = f"{r.choice(['WB', 'LC', 'M', 'KY', 'SW'])}{r.randrange(1, 30)}{r.choice([' ', ' ', ' ', ''])}{r.randrange(1, 9)}{r.choice('ABDEHJLP')}{r.choice('ABDEHJLP')}"
            out = f"{lead}{number} {street}{r.choice([', ', ', ', ' '])}{town}"
            if r.random() < 0.8 or ", " not in out:
                out += r.choice([" ", ", "]) + code
            return (out.lower() if r.random() < 0.2 else out), "UK_ADDRESS", 0
        if slot == "E":
            a, b = g.lower(), s.lower().replace("'", "")
            local = r.choice([f"{a}.{b}", f"{b}_{a}", f"{a[0]}{b}{r.randrange(99)}", f"{a}-{b[:4]}.{r.randrange(60, 99)}", f"{a}+kyc"])
            host = r.choice(["oak.test", "post.wex.example", "mail.brack-cu.example", "lum.invalid"])
            kind = r.random()
            if kind < 0.12:
                return f"{local} (at) {host}", "EMAIL_ADDRESS", 0
            if kind < 0.2:
                return f"{local} [at] {host.replace('.', ' [dot] ')}", "EMAIL_ADDRESS", 0
            if kind < 0.28:
                return f"{local} AT {host.replace('.', ' DOT ')}", "EMAIL_ADDRESS", 0
            if kind < 0.34:
                return f"mailto:{local}@{host}", "EMAIL_ADDRESS", 7
            return (f"{local}@{host}".upper() if kind > 0.92 else f"{local}@{host}"), "EMAIL_ADDRESS", 0
        if slot == "T":
            return _phone(r), "UK_PHONE_NUMBER", 0
        if slot == "N":
            return _nino(r), "UK_NATIONAL_INSURANCE_NUMBER", 0
        if slot == "H":
            return nhs(r), "UK_NHS_NUMBER", 0
        if slot == "L":
            return f"{(s.upper().replace('-', '') + '99999')[:5] if s.isascii() and s.isalpha() else 'ABCDE'}{r.randrange(100000, 999999)}{r.choice('ABJN')}{r.choice('9ABL')}{r.randrange(9)}{r.choice('ABDN')}{r.choice('ABJN')}", "UK_DRIVING_LICENCE_NUMBER", 0
        if slot == "K":
            return nhs(r).replace(" ", "").replace("-", ""), None, 0
        if slot == "B":
            return f"GB {r.randrange(99)} {r.randrange(10, 99)} {r.randrange(10, 99)} A", None, 0
        if slot == "O":
            out = r.choice(COMPANIES).format(s=s, s2=s2)
            return (out.lower() if r.random() < 0.2 else out), None, 0
        if slot == "R":
            out = r.choice(PRODUCTS).format(s=s)
            return (out.lower() if r.random() < 0.15 else out), None, 0
        if slot == "X":
            return r.choice(STREETS), None, 0
        if slot == "W":
            return r.choice(TOWNS), None, 0
        if slot == "Z":
            return r.choice(_ZH[0]) + r.choice(_ZH[1]), "PERSON", 0
        return r.choice(_JA[0]) + r.choice(["", " "]) + r.choice(_JA[1]), "PERSON", 0

    def sentence(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = "", [], 0
        while True:
            k = template.find("{", at)
            if k < 0:
                return out + template[at:], spans
            out += template[at:k]
            value, kind, skip = self._value(template[k + 1])
            if kind:
                spans.append((len(out) + skip, len(out) + len(value), kind))
            out += value
            at = k + 3

    def texts(self, n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
        """``n`` texts of three sentences each; every template comes equally often."""
        made = []
        order = [t for _ in range(3 * n // len(SENTENCES) + 1) for t in self.rng.sample(SENTENCES, len(SENTENCES))][: 3 * n]
        for i in range(0, len(order), 3):
            text, spans = "", []
            for t in order[i : i + 3]:
                s, found = self.sentence(t)
                if text:
                    text += self.rng.choice([" ", " ", "\n\n"])
                spans += [(a + len(text), b + len(text), k) for a, b, k in found]
                text += s
            made.append((text, spans))
        return made
