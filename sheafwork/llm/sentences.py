"""Sentence units of texts in any script, by a pushdown automaton over marks.

A text falls into blocks at blank lines and, in lists, into items at line starts. In each a stack of quotation marks
and brackets is kept; only marks of its level 0 can end a sentence, and a matched pair is passed over as a whole.
Whether a mark of level 0 ends a sentence is told by the word before it (an abbreviation trie, initials, ordinals),
by the script, and by what follows. Units are 0-based, half-open code-point offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.session import spread

#: Abbreviations, without their last full stop. NEVER ones are always followed by more of the sentence, the others
#: end it when a new one begins after them.
NEVER = (
    "mr mrs ms mx dr prof st sr sra srta rev hon no nos nr núm n art arts abs sect sec fig figs pág págs p pp vol v vs incl approx "
    "ca bzw z.b z d.h d e.g i.e ext tel fax env aprox p.ej ej p.ex ex cf ref dept resp ggf evtl vgl dipl ing bd hr fr mme mlle av avda c.f num "
    "u.a s.o z.t hrsg tél"
).split()
OPEN_END = "etc usw a.m p.m p.a a co ltd inc corp plc jr bros u.s u.k".split()
#: Words after which dots mark a pause.
PAUSE = ("hmm", "um", "uh", "er", "ähm", "euh", "eh", "well", "hm")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“", "“": "”", "‚": "‘", "‹": "›"}
_CLOSE = set(_PAIRS.values()) | {'"'}
_QUOTES = set('"«»„“”「」『』《》〈〉‹›‚')
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_EVENT = re.compile(r'\.{2,}|\.[!?…]*(?![0-9a-z@_/])|[!?…]+[.!?…]*|[。！？｡।॥؟۔]+|["()\[\]{}（）【】「」『』《》〈〉«»„“”‹›]|(?:ครับ|ค่ะ|คะ)(?=\s|$)')
_BULLET = re.compile(r"[^\S\n]*(?:([-*•–—·▪‣])|\(?(\d{1,3})[.)]|\(?([a-z])\))[^\S\n]+")
_HEADER = re.compile(r"(?:From|To|Cc|Bcc|Subject|Date|Sent|Reply-To|Von|An|Betreff|Datum|De|À|A|Para|Objet|Asunto|Fecha)\s?:", re.I)
_GERMAN = re.compile(r"\b(?:der|die|das|und|dem|wurde|nicht|ist)\b")
_WORD_BEFORE = re.compile(r"[^\s\"'“”„«»()\[\]（）「」]+$")
_FULL = set("。！？｡।॥؟۔")
_GOES_ON = frozenset("to on about and or since because as after while before of at in is was has for with by who".split())
_COMPANY = frozenset("co ltd inc corp plc bros etc usw p.a".split())
_STARTERS = frozenset(
    "the a an on in by as of with when whenever because although once given after before between some unless despite long under its for according do why is his her their our we "
    "please until this that it they if you he she there these those my your who what where how at from so but no all any each every".split()
)
_VOWEL = re.compile("[aeiouyáéíóúàèìòùâêîôûäëïöüœæåøąęěůý]")
_WORD = re.compile(r"\w+")
_TAIL = re.compile(r"\S*")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in reversed(w):
            node = node.setdefault(ch, {})
        node[""] = True
    return root


_NEVER_TRIE, _OPEN_TRIE = _trie(NEVER), _trie(OPEN_END)


def _ends_with(text: str, at: int, low: int, trie: dict) -> bool:
    """Whether a whole word of the trie ends at ``at`` (read backwards; blanks inside "z. B." don't count)."""
    node, i = trie, at - 1
    while True:
        if "" in node and (i < low or not (text[i].isalnum() or text[i] in ".@_-/&")):
            return True
        if i < low:
            return False
        node = node.get(text[i].lower())
        if node is None:
            return False
        i -= 1


def _caseless(ch: str) -> bool:
    return (ch.isalpha() and ch.lower() == ch.upper()) or "ऀ" <= ch <= "ॿ" or "฀" <= ch <= "๿"


def _pairs(text: str, events: list[tuple[int, int]]) -> dict[int, int]:
    """Event number of each matched opening mark → that of its closing mark, outermost pairs as the stack finds them."""
    stack: list[tuple[str, int]] = []
    match: dict[int, int] = {}
    for n, (a, _) in enumerate(events):
        ch = text[a]
        if ch == '"':
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if hit is None:
                stack.append(('"', n))
            else:
                match[stack[hit][1]] = n
                del stack[hit:]
            continue
        if ch in _CLOSE and stack:
            want = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch), None)
            if want is not None:
                match[stack[want][1]] = n
                del stack[want:]
                continue
        if ch in _PAIRS:
            stack.append((_PAIRS[ch], n))
    return match


def _split(text: str, low: int, high: int, out: list[tuple[int, int]]) -> None:
    """Sentences of text[low:high], one list item or one block without lists."""
    body = text[low:high]
    events = [(low + m.start(), low + m.end()) for m in _EVENT.finditer(body)]
    begin = low
    while begin < high and text[begin].isspace():
        begin += 1
    if begin >= high:
        return
    german: bool | None = None
    first = next((i for i, ch in enumerate(body) if ch.isalpha()), 0)
    lower_block = body[first].islower() and not body[first + 1 : first + 2].isupper()
    no_case = lower_block or body.isupper()
    match = _pairs(text, events)
    opens = {events[m][0] for m in match}

    def close(end: int) -> None:
        nonlocal begin
        while end > begin and text[end - 1].isspace():
            end -= 1
        if end > begin:
            out.append((begin, end))
        begin = end
        while begin < high and text[begin].isspace():
            begin += 1

    n, count = 0, len(events)
    while n < count:
        a, b = events[n]
        if a < begin:
            n += 1
            continue
        ch = text[a]
        if n in match:
            # a matched pair: nothing inside divides; it may end the sentence if its own text ended one
            last = match[n]
            end = events[last][1]
            inner = events[last][0] - 1
            while inner > a and text[inner].isspace():
                inner -= 1
            while inner > a and text[inner] in _CLOSE:
                inner -= 1
            n = last + 1
            if text[inner] not in ".!?…。！？｡।॥؟۔" or inner <= a:
                continue
            after = end
            while after < high and text[after] in _CLOSE and after not in opens:
                after += 1
            nxt = after
            while nxt < high and text[nxt].isspace():
                nxt += 1
            if nxt >= high:
                continue
            follows = text[nxt]
            if follows in ".,;:!?。，；、：！？،؛…।)]）」』»”" or follows in "-–—":
                continue
            initial = a == begin
            quote = ch in _QUOTES
            if quote:
                if initial:
                    # "..." said X: a quotation that opens the sentence is followed by who says it
                    ends = (follows.isupper() or (follows.isdigit() and not lower_block)) and not _caseless(text[inner - 1])
                else:
                    ends = not follows.islower() or lower_block or text[nxt + 1 : nxt + 2].isupper() or _caseless(text[inner - 1])
            else:
                ends = initial and (not follows.islower() or lower_block or _caseless(text[inner - 1]))
            if ends:
                close(after)
            continue
        n += 1
        if ch in _PAIRS or ch in _CLOSE:
            continue
        end = b
        while end < high and text[end] in _CLOSE and end not in opens:
            end += 1
        if end >= high:
            continue
        if "฀" <= ch <= "๿" or ch in _FULL:
            close(end)
            continue
        nxt = end
        while nxt < high and text[nxt].isspace():
            nxt += 1
        if nxt >= high:
            continue
        follows, before = text[nxt], text[a - 1] if a > low else " "
        if nxt == end:
            # no blank: an ideographic text goes on at once; Latin only where a word ends and a capitalised one begins
            if ch in "…!?" and _caseless(before):
                close(end)
            elif ch in ".!?" and b - a == 1 and end == b and (before.islower() or before.isdigit()) and text[a - 2 : a - 1].isalnum() and follows.isupper() and (text[nxt + 1 : nxt + 2].islower()):
                word = _WORD_BEFORE.search(text, max(low, a - 40), a)
                tail = _TAIL.match(text, nxt, high).group()
                if not (word and ("@" in word.group() or "_" in word.group() or "/" in word.group() and not before.isdigit())) and "@" not in tail and "." not in tail[:-1].rstrip(".,;:") and not _ends_with(text, a, low, _NEVER_TRIE):
                    close(end)
            continue
        if _caseless(before) or before in "๏”“」』»":
            if not (ch == "." and follows.islower() and before in "”“»"):
                close(end)
            continue
        cased_start = follows.isupper() or text[nxt + 1 : nxt + 2].isupper() and follows.isalpha()
        if ch == "." and b - a == 1:
            word_end = a
            if _ends_with(text, word_end, low, _NEVER_TRIE):
                continue
            if before.isalpha() and (a - 2 < low or not (text[a - 2].isalnum() or text[a - 2] in "'’")):
                # one letter: an initial, or the last letter of a spaced number, which ends a sentence
                k = a - 2
                while k >= low and text[k].isspace():
                    k -= 1
                number = k >= low and text[k].isdigit() and text[a - 2].isspace()
                if not number and (before.isupper() and text[a - 2] != "." or not _ends_with(text, word_end, low, _OPEN_TRIE)):
                    continue
            if before.isdigit() and follows.isalpha():
                k = a
                while k > low and text[k - 1].isdigit():
                    k -= 1
                if a - k <= 2 and (k == low or text[k - 1].isspace()):
                    if german is None:
                        german = len(_GERMAN.findall(body)) >= 2
                    if german:
                        continue
            if _ends_with(text, word_end, low, _OPEN_TRIE):
                start = _WORD.match(text, nxt, high)
                begins = start.group().lower() if start else ""
                if no_case and follows.isalpha():
                    if (begins not in _STARTERS) if text[max(low, a - 5) : a].lower().split()[-1] in _COMPANY else begins in _GOES_ON:
                        continue
                elif follows.islower() and not cased_start:
                    continue
            elif follows.islower() and not cased_start and not no_case and not before.isdigit():
                # in running text a small letter after a full stop begins a sentence only after a whole word
                word = _WORD_BEFORE.search(text, max(low, a - 30), a)
                if not word or len(word.group()) < 3 or not _VOWEL.search(word.group().lower()):
                    continue
        elif b - a > 1 or ch == "…":
            word = _WORD_BEFORE.search(text, max(low, a - 12), a)
            if word and word.group().lower() in PAUSE or follows.islower() and not cased_start and not lower_block:
                continue
        if follows in "(（[" and nxt + 1 < high and text[nxt + 1].islower() and not lower_block:
            continue
        elif follows in ",;:،؛)]»”" or follows in "-–—" and text[nxt + 1 : nxt + 2].isspace():
            continue
        close(end)
    close(high)


def _list_items(text: str, starts: list[int], a: int, b: int) -> list[int]:
    """The lines of a block that begin list items, told by a stack of open list levels.

    A level is an indent, a kind of mark and the last number. A marked line goes on the nearest open level of its indent
    and kind if its number is the next, and closes the levels inside it; a bullet, a 1 or an a opens a level. A level
    counts if it begins the block or stands deeper than the one around it, else if it has two items at least.
    """
    stack: list[list] = []  # indent, kind, last number, level
    items: list[tuple[int, int]] = []
    sure: list[bool] = []
    for s in starts:
        m = _BULLET.match(text, s, b)
        if not m:
            continue
        lead = m.group(0)
        indent = len(lead) - len(lead.lstrip())
        kind = m.group(1) or ("number" if m.group(2) else "letter")
        n = int(m.group(2)) if m.group(2) else ord(m.group(3)) - 96 if m.group(3) else 0
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == indent and stack[i][1] == kind and (not n or n == stack[i][2] + 1)), None)
        if at is not None:
            del stack[at + 1 :]
            stack[at][2] = n
            items.append((s, stack[at][3]))
        elif n <= 1:
            while stack and stack[-1][0] > indent:
                stack.pop()
            sure.append(s == a or bool(stack) and indent > stack[-1][0])
            stack.append([indent, kind, n, len(sure) - 1])
            items.append((s, len(sure) - 1))
    size = [0] * len(sure)
    for _, level in items:
        size[level] += 1
    return [s for s, level in items if sure[level] or size[level] > 1]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit; none for null, empty and blank texts."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    at = 0
    bounds = []
    for m in _BLANK.finditer(text):
        bounds.append((at, m.start()))
        at = m.end()
    bounds.append((at, len(text)))
    for a, b in bounds:
        while a < b and text[a].isspace() and text[a] != "\n":
            a += 1
        while a < b and text[a] == "\n":
            a += 1
        if a >= b:
            continue
        starts = [a]
        k = text.find("\n", a, b)
        while k != -1:
            starts.append(k + 1)
            k = text.find("\n", k + 1, b)
        if len(starts) > 1 or text[a] in "-*•–—·▪‣(123456789":
            if all(_HEADER.match(text, s, b) for s in starts):
                e = b
                while e > a and text[e - 1].isspace():
                    e -= 1
                out.append((a, e))
                continue
            items = _list_items(text, starts, a, b)
            if items:
                for s, e in zip([a] * (items[0] > a) + items, items[0 if items[0] > a else 1 :] + [b]):
                    m = _BULLET.match(text, s, e)
                    mark = len(out)
                    _split(text, m.end() if m and s in items else s, e, out)
                    if m and s in items:
                        lead = m.start() + len(m.group()) - len(m.group().lstrip())
                        if len(out) > mark:
                            out[mark] = (lead, out[mark][1])
                        else:
                            out.append((lead, lead + len(m.group().strip())))
                continue
        _split(text, a, b, out)
    return out


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos): the sentence units of ``documents.text``.

    Null, empty and blank texts have none; equal rows count once; other columns are ignored.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                for s, e in sentences(text):
                    ids.append(doc_id)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"doc_id": ids, "start_pos": starts, "end_pos": ends})

    return spread(documents.select("doc_id", "text").where(F.length("text") > 0)).mapInPandas(run, "doc_id long, start_pos int, end_pos int")
