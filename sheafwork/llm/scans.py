"""Text of scanned pages, repaired: misread words, split words, running headers and page numbers, reflowed paragraphs.

Words come from the pages themselves. The frequent ones form a trie; for every other word an automaton that accepts
all spellings within a bounded number of misreadings is run against the trie, so that no candidate is missed. A word
counts as misread when a far more frequent word explains it. Page furniture is told by what repeats, or counts up, at
the same edge of a document's pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheafwork.llm.survivors import document_key
from sheafwork.session import cut, spread

#: What scanners make of a letter or of letters side by side (fixed values): letters → misreadings.
MISREAD = {"e": ("c",), "a": ("@",), "i": ("l", "1"), "o": ("0",), "t": ("f",), "l": ("1", "i"), "u": ("ii",), "s": ("5",), "d": ("cl",), "h": ("b",), "g": ("9",), "m": ("rn",), "w": ("vv",), "b": ("8",), "z": ("2",), "é": ("6",), "ü": ("ii",), "rn": ("m",), "cl": ("d",), "ii": ("u",), "vv": ("w",), "fi": ("ﬁ",), "fl": ("ﬂ",), "ff": ("ﬀ",), "ffi": ("ﬃ",), "ffl": ("ﬄ",)}
#: First letter of a misreading → (misreading, letters).
_SEEN_AS: dict[str, list[tuple[str, str]]] = {}
for _letters, _bads in MISREAD.items():
    for _bad in _bads:
        _SEEN_AS.setdefault(_bad[0], []).append((_bad, _letters))
#: Misreadings of one word at most; an edit of any other kind counts as two.
MOST, OTHER_EDIT = 2, 2
#: A word may explain another if it is so many times as frequent, and occurs so often at least.
RATIO, OFTEN = 8, 5
#: An edit of any kind is tried on words of so many letters that occur less than ``OFTEN``: shorter ones have true words
#: beside them, and frequent ones are words of their own (do, to; hand, and).
LONG = 6
#: A trie that travels to the workers has so many words at most; a larger vocabulary is gone through in several tries.
MAX_VOCABULARY = 300_000
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‚‘’…|*•"
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}
_NUMBER_LINE = re.compile(r"^\s*(?P<pre>(?:page|seite|p\.|pg\.|s\.|pág\.|página|-|–|—|\[|\()?)\s*(?P<n>[0-9lioO|]{1,4}|[ivxl]{1,7})\s*(?P<post>(?:[/]|of|von|de|sur)\s*[0-9lioO]{1,4}|-|–|—|\]|\))?\.?\s*$", re.I)
_MARKS = re.compile(r"[-‐‑¬­]$")


class Trie:
    """Words and their counts; ``near`` intersects the trie with the automaton of a spelling."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = n

    def near(self, word: str, most: int = MOST, edits: bool = True) -> list[tuple[int, int, str]]:
        """(cost, count, candidate) of every word of the trie that ``word`` may stand for, itself left out.

        States of the automaton are (position in ``word``, cost so far); the walk follows only edges of the trie from
        which the end of the word can still be reached within ``most``.
        """
        n, found = len(word), {}
        # what may have been printed where the word has these letters, by position
        here_for: list[list[tuple[str, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for bad, letters in _SEEN_AS.get(word[i], ()):
                if word.startswith(bad, i):
                    here_for[i].append((letters, len(bad)))
        stack = [(self.root, 0, 0, "")]
        seen = set()
        while stack:
            node, i, cost, made = stack.pop()
            key = (made, i, cost)
            if key in seen:
                continue
            seen.add(key)
            if i == n and "" in node and made != word and cost < found.get(made, (99,))[0]:
                found[made] = (cost, node[""])
            if i < n and word[i] in node:
                stack.append((node[word[i]], i + 1, cost, made + word[i]))
            if cost < most:
                for letters, used in here_for[i]:
                    below = node
                    for ch in letters:
                        below = below.get(ch) if below else None
                    if below:
                        stack.append((below, i + used, cost + 1, made + letters))
            if edits and cost + OTHER_EDIT <= most:
                for ch, below in node.items():
                    if ch:
                        stack.append((below, i, cost + OTHER_EDIT, made + ch))
                        if i < n and ch != word[i]:
                            stack.append((below, i + 1, cost + OTHER_EDIT, made + ch))
                if i < n:
                    stack.append((node, i + 1, cost + OTHER_EDIT, made))
        return sorted((c, k, w) for w, (c, k) in found.items())


def _token(w: str) -> str | None:
    """A word in small letters, edge marks stripped; addresses, numbers and codes are none."""
    if "_" in w or "/" in w or "@" in w[:1] or w.count("@") == 1 and "." in w[w.index("@") :].rstrip(_EDGE):
        return None
    w = w.strip(_EDGE).lower()
    if w.endswith(("'s", "’s")):
        w = w[:-2]
    letters = sum(ch.isalpha() and (ch < "Ͱ" or "ﬀ" <= ch <= "ﬄ") for ch in w)
    other = sum(ch.isdigit() or ch in "@|" for ch in w)
    return w if letters >= 1 and letters > other and letters + other + w.count("-") + w.count("'") + w.count("’") == len(w) else None


#: What was read of a word before; most words come again and again.
_READ: dict[str, tuple[str | None, bool]] = {}


def _read(w: str) -> tuple[str | None, bool]:
    """(token, whether a letter stands in a number) of a word as printed."""
    got = _READ.get(w)
    if got is None:
        if len(_READ) > 200_000:
            _READ.clear()
        got = _READ[w] = (_token(w), _CODED.match(w.strip("()\"';:")) is not None)
    return got


def tokens(line: str) -> list[str]:
    """Words of a line in small letters, without addresses, numbers and codes."""
    return [t for w in line.split() if (t := _read(w)[0]) is not None]


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over all texts; summed inside each task before anything moves."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            printed: Counter[str] = Counter()
            for text in batch["full_text"]:
                printed.update(text.split())
            for w, k in printed.items():
                t = _read(w)[0]
                if t is not None:
                    seen[t] += k
            if len(seen) > 200_000:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return pages.select("full_text").where(F.length("full_text") > 0).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, limit: int = MAX_VOCABULARY) -> Iterator[dict[str, int]]:
    """Words that occur ``OFTEN`` and look like words, in parts of about ``limit`` words, each brought here by itself."""
    plain = counts.where((F.col("n") >= OFTEN) & ~F.col("word").rlike("[0-9@|]"))
    parts = -(-plain.count() // limit)
    for i in range(parts):
        yield {r["word"]: r["n"] for r in plain.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == i).collect()}


class Trusted(NamedTuple):
    """Words that vouch for lines: ``words`` travels to the workers; ``every`` is the table of all of them, where
    ``words`` has only the most frequent ones."""

    words: dict[str, int]
    every: DataFrame | None


def frequent(counts: DataFrame, wrong: DataFrame, limit: int = MAX_VOCABULARY) -> Trusted:
    """Trusted words. Above ``limit`` only the most frequent ones travel; the others are looked up by joins."""
    plain = counts.where((F.col("n") >= OFTEN) & ~F.col("word").rlike("[0-9@|]")).join(wrong.select("word"), "word", "left_anti")
    first = plain.orderBy(F.desc("n"), "word").limit(limit + 1).collect()
    return Trusted({r["word"]: r["n"] for r in first[:limit]}, cut(plain) if len(first) > limit else None)


def misreadings(counts: DataFrame, words: dict[str, int], plain: bool = True, edits: bool = True) -> DataFrame:
    """(word, candidates): words that a far more frequent one of ``words`` explains, with (word, cost, n), best first.

    ``plain`` misreadings are tried first, ``edits`` of any kind where there are none.

    All words of the trie within the bounds are found and all are kept; context chooses among them later.
    """
    sent = counts.sparkSession.sparkContext.broadcast(words)
    top = max(words.values(), default=0)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(sent.value)
        for batch in batches:
            out = []
            for word, n in zip(batch["word"].tolist(), batch["n"].tolist()):
                near = [(cost, -k, w) for cost, k, w in trie.near(word, MOST, edits=False) if k >= RATIO * n and len(w) > 1] if plain else []
                if edits and not near and n < OFTEN and len(word) >= LONG and "-" not in word:
                    near = [(cost, -k, w) for cost, k, w in trie.near(word, MOST) if k >= RATIO * OFTEN and len(w) >= LONG and "-" not in w]
                if near:
                    near.sort()
                    out.append((word, [{"word": w, "cost": c, "n": -k} for c, k, w in near]))
            yield pd.DataFrame(out, columns=["word", "candidates"])

    few = counts.where(F.col("n") * RATIO <= top).select("word", "n")
    return few.repartition(max(8, few.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, "word string, candidates array<struct<word:string,cost:int,n:long>>")


_FOLD = str.maketrans({"c": "e", "@": "a", "l": "i", "1": "i", "0": "o", "f": "t", "5": "s", "b": "h", "9": "g", "8": "h", "2": "z"})


def fold(line: str) -> str:
    """A line without its page number and with likely misreadings made alike."""
    line = re.sub(r"\s{2,}\S{1,5}\s*$|^\s*\S{1,5}\s{2,}", "", line)
    s = line.lower().replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "u")
    return re.sub(r"[\s\W_]+", "", s.translate(_FOLD))


def _roman(s: str) -> int | None:
    total, last = 0, 0
    for ch in reversed(s):
        v = _ROMAN[ch]
        total += -v if v < last else v
        last = max(last, v)
    return total or None


def page_number(line: str) -> tuple[str, int] | None:
    """(format, value) of a line that could only be a page number."""
    m = _NUMBER_LINE.match(line)
    if not m:
        return None
    pre, post, n = m.group("pre").lower(), (m.group("post") or "").lower(), m.group("n").lower()
    shape = f"{pre}#{re.sub(r'[0-9lio]+$', '#', post) if post[:1] not in '-–—])' else post[:1]}"
    if re.fullmatch("[ivxl]+", n) and not (n == "l" and pre):
        value = _roman(n)
        if value is None or value > 60:
            return None
        return shape.replace("#", "r", 1), value
    digits = n.translate(str.maketrans("lio|", "1101"))
    return (shape, int(digits)) if digits.isdigit() else None


_CODED = re.compile(r"^[£€$]?\d[\d,.]*[lIOoS][\d,.]*\d[\d,.]*$|^[£€$][lIOoS]\d*[\d,.]*$|^[£€$]\d*[lIOoS][,.]\d")


def _judged(found: DataFrame, every: DataFrame) -> DataFrame:
    """``found`` as all trusted words would have given it: words that these vouch for go, split words are decided."""
    half = found.where("tag = 'half'")
    n = lambda i: F.coalesce(F.max(F.when(F.col("at") == i, F.col("n"))), F.lit(0)).alias(f"n{i}")
    counts = half.select("a").distinct().select("a", F.posexplode(F.split("a", "\t")).alias("at", "word")).join(every, "word").groupBy("a").agg(*map(n, range(4)))
    whole = counts.where("if(n0 > 0 or n1 > 0, n0 < n1, n2 > 0 and n3 > 0)").select("a")
    halves = half.join(whole, "a", "left_anti").withColumns({"tag": F.lit("hyphen"), "a": F.lit(None).cast("string")})
    words = found.where("tag = 'word'").join(every.select(F.col("word").alias("a")), "a", "left_anti")
    return found.where("tag not in ('half', 'word')").unionByName(words).unionByName(halves)


def findings(pages: DataFrame, trusted: Trusted) -> DataFrame:
    """(doc, page_index, page_row_id, line_no, tag, a, n): what the lines of each page hold by themselves.

    Tags: ``edge`` (a = folded line, n = 0 head or 1 foot), ``number`` (a = format, n = value), ``hyphen``, ``word``
    (a = a word that the vocabulary does not vouch for), ``code`` (a letter inside a number).
    """
    sent, whole = pages.sparkSession.sparkContext.broadcast(trusted.words), trusted.every is None
    schema = "doc string, page_index int, page_row_id long, line_no int, tag string, a string, n int"

    def split_word(left: str, right: str, known: dict[str, int]) -> tuple[str, str | None] | None:
        """(tag, a) of a split word: ``hyphen``, or ``half`` with the words to be looked up where ``known`` can't tell."""
        l, r = left.strip(_EDGE + "-‐‑¬­").lower(), re.split(r"[\s.,;:!?\"'»”“)]", right.strip(_EDGE), maxsplit=1)[0].lower()
        if not l or not r or not l[-1].isalpha() or not r[0].isalpha():
            return None
        one, two = l.split("-")[-1] + r.split("-")[0], f"{l}-{r}"
        joined, kept = known.get(one, 0), known.get(two, 0)
        if joined:  # a word that is missing here is no more frequent
            return ("hyphen", None) if joined >= kept else None
        if not whole:
            return "half", "\t".join((one, two, l, r))
        return None if kept or (l in known and r in known) else ("hyphen", None)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            out: list[tuple] = []
            for doc, page, row, text in zip(batch["doc"].tolist(), batch["page_index"].tolist(), batch["page_row_id"].tolist(), batch["full_text"].tolist()):
                lines = text.split("\n")
                filled = [i for i, x in enumerate(lines) if x.strip()]
                # the outermost line of either edge, and the next one while those outside are page numbers
                for side, edge in ((0, filled[:2]), (1, filled[:-3:-1])):
                    inner = False
                    for i in edge:
                        number = page_number(lines[i])
                        if number:
                            out.append((doc, page, row, i, "number", number[0], number[1]))
                        elif not inner and len(lines[i].strip()) >= 3:
                            out.append((doc, page, row, i, "edge", fold(lines[i]), side))
                        inner = inner or not number
                joined = False
                for i, line in enumerate(lines):
                    part = False
                    body = line.rstrip()
                    if _MARKS.search(body) and i + 1 < len(lines) and len(body) > 2 and body[-2].isalpha() and lines[i + 1].strip():
                        part = True
                        tag = split_word(body.split()[-1], lines[i + 1].strip().split()[0], known)
                        if tag:
                            out.append((doc, page, row, i, *tag, None))
                    found = line.split()
                    if joined:
                        found = found[1:]
                    if part:
                        found = found[:-1]
                    read = [_read(w) for w in found]
                    if any(coded for _, coded in read):
                        out.append((doc, page, row, i, "code", None, None))
                    for w in {t for t, _ in read if t is not None and t not in known}:
                        out.append((doc, page, row, i, "word", w, None))
                    joined = part
            yield pd.DataFrame(out, columns=["doc", "page_index", "page_row_id", "line_no", "tag", "a", "n"]).astype({"n": "Int32", "page_index": "Int32"})

    rows = pages.where(F.length("full_text") > 0).select(document_key("document_id").alias("doc"), "page_index", "page_row_id", "full_text")
    found = rows.mapInPandas(run, schema)
    return found if trusted.every is None else _judged(cut(found), trusted.every)


def _furniture(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, numbers): (page_row_id, line_no) of running headers and of page numbers."""
    pages = found.groupBy("doc").agg(F.countDistinct("page_index").alias("pages"))
    edges = found.where("tag = 'edge' and length(a) >= 3")
    often = edges.groupBy("doc", "n", "a").agg(F.countDistinct("page_index").alias("on")).join(pages, "doc").where("on >= 2 and (on >= 0.5 * pages or on >= 4)").select("doc", "n", "a")
    headers = edges.join(often, ["doc", "n", "a"], "left_semi").select("page_row_id", "line_no").distinct()
    numbers = found.where("tag = 'number'").withColumn("shift", F.col("n") - F.col("page_index"))
    runs = numbers.groupBy("doc", "a", "shift").agg(F.countDistinct("page_index").alias("on")).join(pages, "doc")
    bare = F.col("a").isin("#", "r")
    kept = runs.where((F.col("on") >= 2) | ~bare | ((F.col("pages") <= 2) & (F.col("shift") == 1))).select("doc", "a", "shift")
    return headers, numbers.join(kept, ["doc", "a", "shift"], "left_semi").select("page_row_id", "line_no").distinct()


def _over_parts(counts: DataFrame, limit: int, plain: bool, edits: bool, asked: DataFrame | None = None) -> DataFrame:
    """``misreadings`` against a vocabulary of any size, one part after the other, as one trie would give them."""
    every: DataFrame | None = None
    for words in vocabulary(counts, limit):
        one = cut(misreadings(counts if asked is None else asked, words, plain, edits))
        every = one if every is None else every.unionByName(one)
    order = lambda a, b: F.when(a["cost"] != b["cost"], a["cost"] - b["cost"]).when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).when(a["word"] < b["word"], -1).otherwise(1)
    return cut(every.groupBy("word").agg(F.array_sort(F.flatten(F.collect_list("candidates")), order).alias("candidates")))


def _lexicon(texts: DataFrame, limit: int = MAX_VOCABULARY) -> tuple[Trusted, DataFrame]:
    """(trusted words, misread words with candidates) of all ``full_text``."""
    counts = cut(word_counts(texts))
    parts = list(vocabulary(counts, limit)) if counts.where(F.col("n") >= OFTEN).count() <= limit else None
    if parts is not None:
        wrong = cut(misreadings(counts, parts[0])) if parts else texts.sparkSession.createDataFrame([], "word string, candidates array<struct<word:string,cost:int,n:long>>")
    else:
        explained = _over_parts(counts, limit, plain=True, edits=False)
        others = counts.join(explained.select("word"), "word", "left_anti")
        wrong = cut(explained.unionByName(_over_parts(counts, limit, plain=False, edits=True, asked=others)))
    # words that a more frequent one explains vouch for nothing, however frequent they are themselves
    return frequent(counts, wrong, limit), wrong


def _noise(found: DataFrame, wrong: DataFrame, headers: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    headers = headers.join(numbers, ["page_row_id", "line_no"], "left_anti")
    taken = headers.unionByName(numbers)
    hits = found.where("tag = 'word'").select("page_row_id", "line_no", F.col("a").alias("word")).join(wrong, "word")
    hits = hits.join(taken, ["page_row_id", "line_no"], "left_anti")
    codes = found.where("tag = 'code'").select("page_row_id", "line_no").join(taken, ["page_row_id", "line_no"], "left_anti")
    kind = lambda df, k: df.select("page_row_id", "line_no", F.lit(k).alias("noise_kind"))
    noise = kind(headers, "running_header").unionByName(kind(numbers, "page_number")).unionByName(kind(found.where("tag = 'hyphen'").join(taken, ["page_row_id", "line_no"], "left_anti"), "hyphen_split")).unionByName(kind(hits.select("page_row_id", "line_no").unionByName(codes).distinct(), "misread"))
    return noise.distinct(), hits


def analysed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(noise, misread words): ``page_row_id, line_no, noise_kind`` and ``page_row_id, line_no, word, candidates``.

    Pages without text have no lines. Repeated deliveries of a page count once. Pages without document or index still
    have misread words and split words, but no furniture across pages other than marked page numbers.
    """
    pages = spread(pages.select("page_row_id", "document_id", "page_index", "full_text"), 1)
    trusted, wrong = _lexicon(pages)
    found = cut(findings(pages, trusted).distinct())
    return _noise(found, wrong, *_furniture(found))


def region_pages(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions as pages of their own: ``page_row_id`` is the region's id; document and index are those of its page."""
    home = pages.select("page_row_id", "document_id", "page_index").dropDuplicates(["page_row_id"])
    one = regions.where("region_uid is not null").dropDuplicates(["region_uid"]).select("region_uid", "page_row_id", "bbox.x", "bbox.y", F.col("text").alias("full_text"))
    return one.join(home, "page_row_id", "left").select(F.col("region_uid").alias("page_row_id"), F.col("page_row_id").alias("home"), "document_id", "page_index", "x", "y", "full_text")


def noise_lines(pages: DataFrame) -> DataFrame:
    """(page_row_id, line_no, noise_kind), one row per line and kind."""
    return analysed(pages)[0]


def _rebuild(text: str, noise: dict[int, set[str]], fixes: list[tuple[int, str, list[tuple[str, int, int]]]]) -> str:
    lines = text.split("\n")
    page = Counter(w for line in lines for w in tokens(line))
    change: dict[int, dict[str, str]] = {}
    for i, word, candidates in fixes:
        best = max(candidates, key=lambda c: (-c[1], page[c[0]] > 0, c[2]))
        change.setdefault(i, {})[word] = best[0]
    parts: list[str] = []
    fresh = True
    width = max((len(x) for x in lines), default=0)
    for i, line in enumerate(lines):
        kinds = noise.get(i, set())
        if "running_header" in kinds or "page_number" in kinds:
            continue
        if not line.strip():
            fresh = True
            continue
        for word, good in change.get(i, {}).items():
            pattern = re.compile(r"(?<![\w@])" + re.escape(word) + r"(?![\w@])", re.I)
            line = pattern.sub(lambda m, g=good: g.upper() if len(m.group()) > 1 and sum(c.isupper() for c in m.group()) > len(m.group()) / 2 else g.capitalize() if m.group()[0].isupper() else g, line)
        body = line.strip()
        if fresh or not parts:
            parts.append(body)
        elif parts[-1].endswith("\x00"):
            parts[-1] = parts[-1][:-1] + body
        else:
            parts[-1] += (" " if not re.search(r"\w-$", parts[-1]) else "") + body
        if "hyphen_split" in kinds:
            parts[-1] = _MARKS.sub("", parts[-1]) + "\x00"
            fresh = False
        else:
            # a line much shorter than the page's width that ends a sentence, or has no sentence, ends a paragraph
            fresh = len(body) < 0.6 * width
    return "\n\n".join(p.rstrip("\x00") for p in parts)


def repaired(pages: DataFrame) -> DataFrame:
    """(page_row_id, text): every page as continuous paragraphs; null texts stay null, repeated pages come once."""
    return _rebuilt(pages, *analysed(pages))


def repaired_regions(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_uid, text): the text of every region as continuous paragraphs; null texts stay null.

    Words are vouched for by pages and regions together. A region's line is furniture if its page has the same line as
    furniture and the region is one of the two outermost ones with text at either edge of the page.
    """
    own = region_pages(pages, regions)
    trusted, wrong = _lexicon(pages.select("full_text").unionByName(own.select("full_text")))
    headers, numbers = _furniture(cut(findings(pages, trusted).distinct()))
    lines = lambda df, *c: df.where("full_text is not null").select(*c, F.posexplode(F.split("full_text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    taken = headers.withColumn("k", F.lit(0)).unionByName(numbers.withColumn("k", F.lit(1)))
    on_page = lines(pages.dropDuplicates(["page_row_id"]), F.col("page_row_id")).join(taken, ["page_row_id", "line_no"]).groupBy(F.col("page_row_id").alias("home"), "line").agg(F.max("k").alias("k"))
    rank = lambda *c: F.row_number().over(W.partitionBy("home").orderBy(*c))
    outer = own.where("length(trim(full_text)) > 0").withColumn("head", rank("y", "x", "page_row_id")).withColumn("foot", rank(F.desc("y"), F.desc("x"), F.desc("page_row_id"))).where("head <= 2 or foot <= 2")
    furniture = cut(lines(outer, F.col("page_row_id"), F.col("home")).join(on_page, ["home", "line"]).select("page_row_id", "line_no", "k"))
    found = cut(findings(own, trusted).distinct())
    at = lambda k: furniture.where(F.col("k") == k).select("page_row_id", "line_no")
    return _rebuilt(own, *_noise(found, wrong, at(0), at(1))).withColumnRenamed("page_row_id", "region_uid")


def _rebuilt(texts: DataFrame, noise: DataFrame, hits: DataFrame) -> DataFrame:
    per = noise.groupBy("page_row_id").agg(F.collect_list(F.struct("line_no", "noise_kind")).alias("noise"))
    fix = hits.groupBy("page_row_id").agg(F.collect_list(F.struct("line_no", "word", "candidates")).alias("fixes"))
    one = texts.select("page_row_id", "full_text").dropDuplicates(["page_row_id"]).join(per, "page_row_id", "left").join(fix, "page_row_id", "left")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, noise, fixes in zip(batch["page_row_id"].tolist(), batch["full_text"].tolist(), batch["noise"].tolist(), batch["fixes"].tolist()):
                if text is not None:
                    kinds: dict[int, set[str]] = {}
                    for x in noise if noise is not None else ():
                        kinds.setdefault(x["line_no"], set()).add(x["noise_kind"])
                    text = _rebuild(text, kinds, [(f["line_no"], f["word"], [(c["word"], c["cost"], c["n"]) for c in f["candidates"]]) for f in (fixes if fixes is not None else ())])
                out.append((row, text))
            yield pd.DataFrame(out, columns=["page_row_id", "text"])

    return one.mapInPandas(run, "page_row_id long, text string")
