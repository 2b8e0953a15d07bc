"""Noise in text from scanned pages: found, and repaired into continuous paragraphs.

A unit is the lines of one chunk, or of one page of boxes. Page numbers and running headers are told by their form and,
for boxes, their place. Words broken at a line end are joined. A rare word is linked to frequent words that it becomes
by a plausible misreading of one or two glyphs; of those, and against leaving the word alone, the one is taken whose
frequency and whose skip-gram vector, beside the words around it, fit. Furniture is then dropped and the lines are reflowed.

Word counts and vectors come from all units. Every word seen twice keeps its count and every word seen six times its vector, at any amount of
text: a rare word taken for one never seen would be changed into a neighbour hardly more frequent. Words are held by hash, so that
all of them can be. What is common in headers is a share of the headers.

Defined cases: null texts have no noise; a page's boxes are read by idx, then box_id; a null height puts no box at a page's edge; redelivered
copies of a record count once; chunks of documents that aren't scanned aren't read. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import skipgram
from .words import Words, key

SCANNED = "scanned_image"
#: A word is known if it is seen so often.
KNOWN = 2
#: A word may be a misreading of one so many times as frequent; of a capitalised one.
RARER, RARER_NAME = 40, 12
LEAST = 6
TOP, BOTTOM = 0.07, 0.94
BROADCAST_DOCUMENTS = 500_000
CHUNKS_A_PARTITION = 20_000

# What is read, and what may have been printed.
GLYPHS = {
    "c": "eo", "e": "co", "o": "ce", "f": "t", "t": "f", "l": "it", "i": "l", "b": "h", "h": "b", "n": "u", "u": "n", "q": "g", "g": "q", "v": "y", "y": "v", "a": "o",
    "rn": ["m"], "vv": ["w"], "cl": ["d"], "ii": ["u"], "ri": ["n"], "li": ["h"], "lc": ["k"], "nn": ["m"], "m": ["rn"], "d": ["cl"], "w": ["vv"], "tt": ["n"], "in": ["m"], "ni": ["m"],
    "0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "€": "e", "|": "li", "!": "il", "2": "z", "¢": "c", "£": "e",
}
DIGITS = {"O": "0", "o": "0", "Q": "0", "D": "0", "I": "1", "l": "1", "i": "1", "|": "1", "!": "1", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2", "g": "9", "q": "9", "G": "6", "T": "7", "A": "4"}
HYPHENS = "-‐‑\xad¬"
JOINING = {"and", "or", "to", "nor", "und", "oder", "bis", "en", "of", "et", "ou", "y", "e", "o", "u", "na", "au", "и", "или"}
PAGE_WORDS = {"page", "página", "pagina", "pagine", "seite", "blz", "bladzijde", "uk", "ukurasa", "p", "pp", "pg", "pag", "pág", "стр", "страница", "с", "ገጽ", "s", "folio"}

_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+")
_STRIP = "“”„«»\"'’‘`().,;:!?…—–‐-[]{}*•·/\\|~<>¿¡©%"
_N = "[0-9OoQDIlSsBbZzgqG]{1,5}"
_PAGE = re.compile(rf"^[\W_]*?(?:([^\W\d_][\w@áàãéíî]{{0,9}})\.?\s*)?(?<![^\W_])({_N})(?:\s*(?:of|/|-|–|de|sur|von|van|ya|из|c)\s*({_N}))?\s*[\])~|—–-]*$", re.I)
_YEAR = "[12][0-9OoIlSsBbZzgq]{3}"
_HEAD_A = re.compile(rf"^(\S.{{2,50}}?)\s+({_YEAR})(?:\s*[|–:—-]\s*|\s{{2,}})(\S.{{4,}})$")
_HEAD_B = re.compile(rf"^(\S.{{4,}}?)(?:\s*[|–:—]\s*|\s{{2,}})(\S.{{2,50}}?)\s+({_YEAR})$")
_SMALL = {"of", "and", "the", "for", "de", "du", "des", "la", "der", "do", "da", "van", "et", "und", "on", "in", "to", "y", "e"}
_NUMBER = re.compile(r"^[€$£]?[-+]?\d+(?:[.,:/]\d+)*(?:%|st|nd|rd|th|m²|m³|km²)?$|^\d{4}-\d\d-\d\d$|^\d\d?:\d\d$|^(?:FY|fy)\d{4}$|^[QHqh]\d$")
_LOOKS_NUMBER = re.compile(r"^(?:FY|Q|H)?[€$£]?[-+]?\d+(?:[.,]\d+)*%?$")


def words_of(lines: list[str] | None) -> list[str]:
    """Words in lower case, those broken at a line end joined."""
    if not lines:
        return []
    text = "\n".join(x or "" for x in lines)
    text = re.sub(rf"(?<=[^\W\d_])[{HYPHENS}]\s*\n\s*(?=[^\W\d_])", "", text)
    return _WORD.findall(text.lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[str] = Counter()
    for b in batches:
        for lines in b.column(0).to_pylist():
            n.update(words_of(lines))
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


def page_number(line: str, edge: bool) -> bool:
    """A line that holds nothing but a page number. edge: it lies at the edge of its page, or its place isn't known."""
    t = line.strip()
    if not edge or not t or len(t) > 24:
        return False
    m = _PAGE.match(t)
    if not m:
        return False
    word, n, total = m.groups()
    if word is not None and not _page_word(word.lower()):
        return False
    plain = "".join(DIGITS.get(c, c) for c in n)
    if not plain.isdigit():
        return False
    if not any(c.isdigit() for c in n) and len(n) > 2:
        return False
    # a year, or the end of a sentence, is text
    return not (word is None and total is None and re.match(r"^(?:19|20)\d\d$", plain) and t == n)


def _page_word(word: str) -> bool:
    if word in PAGE_WORDS:
        return True
    return len(word) >= 4 and any(len(p) == len(word) and sum(a != b for a, b in zip(p, word)) == 1 for p in PAGE_WORDS if len(p) >= 4)


def _capitals(text: str) -> bool:
    words = text.split()
    return len(words) >= 2 and all(w[0].isupper() or not w[0].isalpha() or w.lower() in _SMALL for w in words) and sum(w[0].isupper() for w in words) >= 2


def header(line: str, place: float | None, forms: set[str]) -> bool:
    """A running header: a title with its year beside a body's name, or the name in capitals; or the text at a page's top edge."""
    t = line.strip()
    if not t:
        return False
    if place is not None:
        return place < TOP and len(_WORD.findall(t)) >= 2
    if len(t) > 110:
        return False
    for m, title, name in ((_HEAD_A.match(t), 1, 3), (_HEAD_B.match(t), 2, 1)):
        if m and _capitals(m[name]) and m[title][0].isupper() and len(m[title].split()) <= 6 and not re.search(r"[,;.!?]", m[title]) and not re.search(r"[,;!?]|\d\d|No\.|NO\.", m[name] + m[title]):
            if all(w[0].isupper() or w.lower() in _SMALL or not w.isalpha() for w in m[title].split()):
                return True
    words = t.replace("S.C.", "SC").split()
    if not 3 <= len(words) <= 8 or re.search(r"[,;:!?…]|\.$", t.replace("S.C.", "SC")):
        return False
    letters = [c for c in t if c.isalpha()]
    if sum(c.isupper() for c in letters) < 0.85 * len(letters) or len(letters) < 8:
        return False
    last = words[-1].lower()
    return last in forms or any(len(f) == len(last) >= 4 and sum(a != b for a, b in zip(f, last)) <= 2 for f in forms)


def _one_edit(word: str) -> set[str]:
    out = set()
    for i in range(len(word)):
        for k in (1, 2):
            for g in GLYPHS.get(word[i : i + k], ()) if i + k <= len(word) else ():
                out.add(word[:i] + g + word[i + k :])
    return out


def _mixed(token: str) -> bool:
    """Two characters: a letter, and a digit or symbol that letters are misread as."""
    return len(token) == 2 and sum(c.isalpha() for c in token) == 1 and any(not c.isalpha() and c in GLYPHS for c in token)


class Reader:
    def __init__(self, counts: dict[str, int] | Words, vectors: dict[str, np.ndarray] | Words, forms: set[str], titles: set[str]) -> None:
        self.n, self.vectors, self.forms, self.titles = counts, vectors, forms, titles
        self.known: dict[str, list[tuple[str, int]] | None] = {}
        self.fine: set[str] = set()  # tokens, as they stand between blanks, that nothing is wrong with

    def candidates(self, token: str) -> list[tuple[str, int]] | None:
        """Frequent words that the stripped token may have been printed as, with their counts; None if it is well as it is."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[token] = x = self._candidates(token)
        return x

    def _candidates(self, token: str) -> list[tuple[str, int]] | None:
        if _NUMBER.match(token) or (len(token) < 3 and not _mixed(token)):
            return None
        w = token.lower()
        has_digit = any(c.isdigit() for c in w)
        odd = [c for c in w if not c.isalpha()]
        if has_digit or any(c in "@$|!€¢£" for c in odd):
            variants = {w}
            for _ in range(3):  # each digit or symbol is read as a letter
                variants = {v[:i] + g + v[i + 1 :] for v in variants for i, c in [next(((i, c) for i, c in enumerate(v) if not c.isalpha() and c not in "-'’"), (-1, ""))] if i >= 0 for g in GLYPHS.get(c, ())} | {v for v in variants if all(x.isalpha() or x in "-'’" for x in v)}
            good = [(v, self._count(v)) for v in variants if all(x.isalpha() or x in "-'’" for x in v)]
            good = [(v, n) for v, n in good if n >= LEAST]
            letters = sum(c.isalpha() for c in w)
            return good if good and letters >= min(2, len(w) - 1) else None
        own = self._count(w)
        near = _one_edit(w)
        ratio = RARER_NAME if token[0].isupper() else RARER
        good = [(v, n) for v in near if (n := self._count(v)) >= max(LEAST, ratio * max(own, 0.5))]
        if not good and own <= 2 and len(w) >= 5:
            good = [(v, n) for e in near for v in _one_edit(e) if v != w and (n := self._count(v)) >= max(50, 3 * ratio * max(own, 0.5))]
        return good or None

    def _count(self, word: str) -> float:
        """A compound or a word with an apostrophe is as frequent as its rarest part."""
        parts = _WORD.findall(word)
        return min((self.n.get(p, 0) for p in parts), default=0)

    def fit(self, word: str, around: list[str]) -> float | None:
        v = self.vectors.get(word)
        near = [y for x in around if (y := self.vectors.get(x)) is not None]
        return float(v @ np.mean(near, axis=0)) if v is not None and near else None

    def number(self, token: str, following: str) -> bool:
        """A number with a letter or two in it."""
        if _NUMBER.match(token):
            return False
        if following and re.match(rf"^{_YEAR}", following) and re.match(r"^[QH][IlOSBZ]$", token):
            return True
        head = re.match(r"^(FY|Q|H)(?=.)", token)
        body = token[head.end() :] if head else token
        digits = sum(c.isdigit() for c in body)
        swapped = "".join(DIGITS.get(c, c) for c in body)
        other = len([c for c in body if c.isalpha()])
        return 0 < other <= 2 and digits >= max(1, other if len(body) < 4 else 1) and bool(_LOOKS_NUMBER.match((head[0] if head else "") + swapped)) and len(body) >= 2

    def correct(self, token: str, around: list[str], following: str) -> str | None:
        """What the stripped token should be, if it was misread."""
        if self.number(token, following):
            return "".join(DIGITS.get(c, c) if i >= (2 if token.startswith("FY") else 1 if token[0] in "QH" else 0) else c for i, c in enumerate(token))
        c = self.candidates(token)
        if not c:
            return None
        score = []
        for v, n in c:
            fit = self.fit(v, around)
            score.append((math.log(n) + 4 * (fit if fit is not None else 0.0), v, fit))
        _, best, fit = max(score)
        if token[0].isupper() and all(x.isalpha() or x in "-'’" for x in token) and len(token) < 7:
            # most likely another name, unless it is much rarer and fits very well
            if fit is None or fit < 0.35 or self._count(best) < 100 * max(1, self._count(token.lower())):
                return None
        return best.upper() if token.isupper() and len(token) > 1 else best.capitalize() if token[0].isupper() else best

    def read(self, lines: list[str], places: list[float | None]) -> tuple[list[set[str]], list[str]]:
        """The kinds of noise of each line, and the repaired paragraphs."""
        noise: list[set[str]] = [set() for _ in lines]
        body = []
        for i, (t, p) in enumerate(zip(lines, places)):
            if page_number(t, p is None or p < TOP or p > BOTTOM):
                noise[i].add("page_number")
            elif header(t, p, self.forms):
                noise[i].add("header")
                if any(self._misread_title(w.strip(_STRIP)) for w in t.split()):
                    noise[i].add("characters")
            elif t.strip():
                body.append(i)
        texts: dict[int, str] = {}
        carried = ""
        for k, i in enumerate(body):
            following = body[k + 1] if k + 1 < len(body) else None
            broken = self._broken(lines[i], lines[following] if following is not None else None)
            if broken:
                noise[i].add("hyphenation")
            texts[i] = self._characters(i, following if broken else None, lines, noise, skip_first=bool(carried))
            carried = "x" if broken and following is not None else ""
        return noise, self._reflow(body, lines, noise, texts)

    def _misread_title(self, token: str) -> bool:
        """A word of a header that should be one of the words common in headers, or a year or a name with digits in it."""
        w = token.lower()
        if (len(w) < 3 and not _mixed(w)) or w in self.titles:
            return False
        if self.number(token, ""):
            return True
        if any(c.isdigit() or c in "@$|!€" for c in w) and any(c.isalpha() for c in w):
            return self.candidates(token) is not None
        one = _one_edit(w)
        return not one.isdisjoint(self.titles) or (len(w) >= 6 and any(not _one_edit(x).isdisjoint(self.titles) for x in one))

    def _broken(self, line: str, following: str | None) -> bool:
        t = line.rstrip()
        if len(t) < 2 or t[-1] not in HYPHENS or not t[-2].isalpha():
            return False
        if following is None:
            return True
        m = _WORD.match(following.lstrip("“\"'(").strip())
        if not m:
            return False
        a, b = _WORD.findall(t)[-1].lower(), m.group().lower()
        return not (b in JOINING and t[-1] in "-‐" and self.n.get(a + b, 0) < LEAST)

    def _characters(self, i: int, joined: int | None, lines: list[str], noise: list[set[str]], skip_first: bool = False) -> str:
        """Marks misread words of line i, the last one together with its rest on line ``joined``; the line corrected."""
        out, at = [], 0
        line = lines[i]
        if joined is None and self.fine.issuperset(line.split()):
            return line
        tokens = list(_TOKEN.finditer(line))
        plain = [m.group().strip(_STRIP) for m in tokens]
        for k, m in enumerate(tokens):
            t = plain[k]
            if not t or (skip_first and k == 0):
                continue
            if m.group() in self.fine and (joined is None or k < len(tokens) - 1):
                continue
            last = joined is not None and k == len(tokens) - 1
            rest = ""
            if last:
                rest = (_TOKEN.match(lines[joined].lstrip()) or m).group().strip(_STRIP)  # type: ignore[index]
            word = t.rstrip(HYPHENS) + rest
            around = [x.lower() for x in plain[max(0, k - 2) : k] + plain[k + 1 : k + 3]]
            right = self.correct(word, around, plain[k + 1] if k + 1 < len(plain) else "")
            if right is None and last:
                # a compound broken at its own hyphen: its parts by themselves
                for part, line_no in ((t.rstrip(HYPHENS), i), (rest, joined)):
                    if self.n.get(word.lower(), 0) < LEAST and self.n.get(part.lower(), 0) < LEAST and self.correct(part, around, "") and self.n.get((rest if line_no == i else t.rstrip(HYPHENS)).lower(), 0) >= LEAST:
                        noise[line_no].add("characters")  # type: ignore[index]
                continue
            if right is None and not last and word[0] not in "QH" and self.candidates(word) is None:
                if len(self.fine) > 500_000:
                    self.fine.clear()
                self.fine.add(m.group())
            if right is not None:
                if last:
                    # the glyph that differs tells which of the two lines has it
                    d = next((j for j, (a, b) in enumerate(zip(word.lower(), right.lower())) if a != b), len(right))
                    noise[i if d < len(t.rstrip(HYPHENS)) else joined].add("characters")  # type: ignore[index]
                else:
                    noise[i].add("characters")
                    s = m.start() + m.group().find(t)
                    out.append(line[at:s] + right)
                    at = s + len(t)
        return "".join(out) + line[at:]

    def _reflow(self, body: list[int], lines: list[str], noise: list[set[str]], texts: dict[int, str]) -> list[str]:
        """Lines of about full width run on; a short line, or one that ends a sentence well before the margin, ends its paragraph."""
        if not body:
            return []
        width = sorted(len(lines[i]) for i in body)[(3 * len(body)) // 4]
        out, open_ = [""], False
        for i in body:
            t = texts[i].strip()
            if open_ and out[-1]:
                previous = out[-1]
                if previous[-1] in HYPHENS and len(previous) > 1 and previous[-2].isalpha() and self._glued:
                    stem, rest = _WORD.findall(previous)[-1].lower(), (_WORD.match(t) or [""])[0].lower()
                    own = previous[-1] in "-‐" and self.n.get(stem + rest, 0) < LEAST and self.n.get(stem, 0) >= LEAST and self.n.get(rest, 0) >= LEAST
                    whole = (previous[:-1] + "-" if own else previous[:-1]) + t
                    at = whole.rfind(" ", 0, len(previous) - 1) + 1
                    end = min((k for k in (whole.find(" ", len(previous)),) if k >= 0), default=len(whole))
                    core = whole[at:end].strip(_STRIP)
                    right = self.correct(core, [], "") if core and not own else None
                    out[-1] = whole if right is None else whole[:at] + whole[at:end].replace(core, right) + whole[end:]
                else:
                    out[-1] = f"{previous} {t}"
            else:
                if out[-1]:
                    out.append("")
                out[-1] = t
            self._glued = "hyphenation" in noise[i]
            open_ = self._glued or t[-1:] in tuple(HYPHENS) or (len(lines[i]) >= 0.75 * width and len(lines[i]) <= 1.25 * width)
        return [x for x in out if x]


_SCHEMA = "table_name string, record_id string, noise string"


def _find(model: tuple):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*model)
        for b in batches:
            rows: set[tuple[str, str, str]] = set()
            for table, ids, lines, places in zip(*(b.column(c).to_pylist() for c in ("table_name", "ids", "lines", "places"))):
                noise, _ = reader.read([x or "" for x in lines], places)
                rows.update((table, ids[i if len(ids) > 1 else 0], k) for i, x in enumerate(noise) for k in x)
            out = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.string()) for c in range(3)], names=["table_name", "record_id", "noise"])

    return run


def _repair(model: tuple):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*model)
        for b in batches:
            text = ["\n".join(reader.read([x or "" for x in lines], places)[1]) for lines, places in zip(b.column("lines").to_pylist(), b.column("places").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("table_name"), b.column("unit"), pa.array(text, pa.string())], names=["table_name", "unit", "text"])

    return run


def units(chunks: DataFrame, profiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """(table_name, unit, ids, lines, places): the lines of each scanned chunk and of each page of boxes."""
    scanned = profiles.where(F.col("origin_type") == SCANNED).select("document_id").distinct()
    if scanned.count() <= BROADCAST_DOCUMENTS:
        scanned = F.broadcast(scanned)
    lines = F.split("content", "\n")
    a = chunks.where("content IS NOT NULL AND chunk_id IS NOT NULL").join(scanned, "document_id", "left_semi").select(
        F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("unit"), F.array("chunk_id").alias("ids"), lines.alias("lines"), F.transform(lines, lambda _: F.lit(None).cast("double")).alias("places")
    )
    # One page's boxes: a bounded group.
    x = boxes.where("box_id IS NOT NULL AND text IS NOT NULL").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_set(F.struct("idx", "box_id", "text", F.coalesce(F.col("y1") / F.col("page_height"), F.lit(0.5)).alias("place")))).alias("x"))
    b = x.select(F.lit("ocr_boxes").alias("table_name"), F.concat_ws(" ", "document_id", "page_number").alias("unit"), F.col("x.box_id").alias("ids"), F.col("x.text").alias("lines"), F.col("x.place").alias("places"))
    # Reading takes more time than the few bytes of a unit suggest: partitions by number of chunks, not by size.
    n = max(chunks.sparkSession.sparkContext.defaultParallelism, chunks.count() // CHUNKS_A_PARTITION)
    return a.unionByName(b).repartition(n, "unit")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the lines at pages' top edges, and with a blank before them the last words of those in capitals; "" counts the lines."""
    n: Counter[str] = Counter()
    for b in batches:
        for lines, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for t, p in zip(lines, places):
                if p is not None and p < TOP and t:
                    n[""] += 1
                    words = t.replace("S.C.", "SC").lower().split()
                    n.update({w.strip(_STRIP) for w in words} - {""})
                    if t.isupper() and len(words) >= 3:
                        n[f" {words[-1]}"] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


#: The share of headers that a title's word occurs in, that a name's last word occurs in, and how often it must at least.
TITLE_SHARE, FORMS_SHARE, FORMS_LEAST = 0.015, 0.005, 3


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.array([key(w) for w in b.column(0).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(1)], names=["key", "n"])


def _by_count(n: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of words, the most frequent first: 16 bytes a word come to the driver."""
    x = n.orderBy(F.desc("n"), "word").mapInArrow(_hashed, "key long, n long").toArrow()
    return x.column("key").to_numpy().view(np.uint64), x.column("n").to_numpy()


def fit(u: DataFrame) -> tuple:
    """Counts of all words seen twice, their vectors, the last words of names and the common words in headers, from all units."""
    keys, n = _by_count(cut(u.select("lines").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN)))
    trained = int((n >= skipgram.LEAST).sum())
    h = cut(u.where("table_name = 'ocr_boxes'").select("lines", "places").mapInArrow(_headers, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FORMS_LEAST))
    headers = h.where("word = ''").agg(F.max("n")).first()[0] or 0
    words = {r.word: r.n for r in h.where(F.col("n") >= FORMS_SHARE * headers).collect()}  # a header has a few words, so these are some thousands at most
    forms = {w[1:] for w in words if w.startswith(" ") and words[w] >= max(FORMS_LEAST, FORMS_SHARE * headers)}
    titles = {w for w, k in words.items() if w and w[0] != " " and w.isalpha() and k >= max(FORMS_LEAST, TITLE_SHARE * headers)}
    titles = {w for w in titles if not any(words[x] >= 3 * words[w] for x in _one_edit(w) & titles)}  # common misreadings
    return Words(keys, n), skipgram.vectors(u.select("lines"), keys[:trained], n[:trained], words_of), forms, titles


def noise(chunks: DataFrame, profiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """(table_name, record_id, noise): each kind of noise of each record."""
    u = cut(units(chunks, profiles, boxes))
    return u.mapInArrow(_find(fit(u)), _SCHEMA).distinct()


def repaired(chunks: DataFrame, profiles: DataFrame, boxes: DataFrame) -> DataFrame:
    """(table_name, unit, text): the paragraphs of each scanned chunk, and of each page of boxes (unit: document_id and page_number)."""
    u = cut(units(chunks, profiles, boxes))
    return u.mapInArrow(_repair(fit(u)), "table_name string, unit string, text string").dropDuplicates(["table_name", "unit"])
