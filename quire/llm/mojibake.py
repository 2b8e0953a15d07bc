"""Text decoded with the wrong encoding: found, and read again with the right one.

A hidden Markov model labels the characters of a line. It has one clean state, one state for each pair of encodings
(written in one, read in another, once or repeatedly) and one for characters lost to U+FFFD or to a question mark. A state emits
units: the clean one single characters, a pair's state the one or more characters that one written character was read as, each with
the probability that the clean model, character bigrams counted over all records, gives the written character after the one before
it. A pair's state can't emit characters that its inverse doesn't apply to; the state of lost characters emits any character
beyond ASCII, summed over what the clean model holds possible. States persist from character to character and rarely
change, so a line's evidence adds up, while one odd character is not enough. Each span of characters in a pair's state is restored by its inverse.

Words of ASCII are alike to every state and are passed over, but for question marks before a letter. The counts are taken over all
records; words that are likely garbled by their form (valid UTF-8 once re-encoded, control characters, letters of two
scripts in one run, a question mark before a letter) don't count. The table of bigrams is bounded by the alphabet and is the only
thing sent to the driver.

Defined cases: null content is never garbled and stays null; lost characters are found, not restored; redelivered copies of a record
count once. Very long texts are read line by line, whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes written in the first encoding were read in the second, so often.
PAIRS: list[tuple[str, str, int]] = [
    ("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "cp1252", 3), ("utf-8", "latin-1", 1), ("utf-8", "latin-1", 2), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "cp866", 1), ("utf-8", "mac-roman", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "koi8-r", 1), ("utf-8", "iso8859-15", 1), ("utf-8", "cp1254", 1),
    ("cp1252", "latin-1", 1), ("cp1252", "cp1250", 1), ("cp1252", "cp1251", 1), ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "mac-roman", 1), ("cp1252", "koi8-r", 1), ("cp1252", "cp866", 1),
    ("cp1251", "cp1252", 1), ("cp1251", "latin-1", 1), ("cp1251", "koi8-r", 1), ("cp1251", "cp866", 1), ("cp1251", "mac-roman", 1), ("cp1251", "cp437", 1), ("koi8-r", "cp1251", 1), ("koi8-r", "cp1252", 1), ("cp866", "cp1251", 1), ("cp866", "cp1252", 1),
    ("mac-roman", "cp1252", 1), ("cp437", "cp1252", 1), ("cp850", "cp1252", 1),
]
CLEAN, LOST = 0, len(PAIRS) + 1
#: Log probabilities: to begin a given pair's state, or that of lost characters, to go on in a state by a unit beyond ASCII, and to leave it.
ENTER, ENTER_LOST = math.log(0.01 / len(PAIRS)), math.log(0.001)
STAY = math.log(0.9)
LEAVE = math.log(0.1)
#: To change state between two characters beyond ASCII: a wrong decoding seldom begins within a run of them.
INSIDE = math.log(0.001)
#: States so much less likely than the best one are given up.
BEAM = 30.0
_ALPHA, _FLOOR = 2.0, 1e-9
#: Characters that one written character may have become, by the number of times it was read wrongly.
_LONGEST = {1: 4, 2: 9, 3: 18}
_ANY = -1  # in place of a lost character

# Words are cut at ASCII white space only: other blanks may be pieces of a garbled character.
_WORD = re.compile("[^ \t\r\n]*(?:[^\x00-\x7f]|[?][A-Za-z?])[^ \t\r\n]*")
_ODD = re.compile("[?][A-Za-z?]")
_DIGITS = {ord(c): "0" for c in "123456789"}
_PLAUSIBLE = re.compile("^[\x00-\x7f\xa0-ɏЀ-џሀ-፿‐-›€™№…•‰−]+$")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]")
_BROKEN = re.compile("[\x80-\x9f�]")
# The five bytes without a character in cp1252 are read as control characters, as browsers do.
_HOLES = {0x81, 0x8D, 0x8F, 0x90, 0x9D}


def _plain(text: str) -> bool:
    return text.isascii() and not _ODD.search(text)


def _words(text: str, marks: bool = False) -> list[str]:
    """As _WORD, without places; with marks, also the words that hold a question mark anywhere."""
    odd = "?" in text
    return [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if not w.isascii() or (odd and "?" in w and (marks or _ODD.search(w)))]


def _bytes(text: str, encoding: str) -> bytes:
    if encoding == "cp1252" and any(ord(c) in _HOLES for c in text):
        return b"".join(bytes([ord(c)]) if ord(c) in _HOLES else c.encode("cp1252") for c in text)
    return text.encode(encoding)


def inverse(text: str, pair: tuple[str, str, int]) -> str | None:
    """The text before it was read in the wrong encoding; None if that can't have happened, or would have changed nothing."""
    t = _undone(text, pair)
    return None if t == text else t


def _undone(text: str, pair: tuple[str, str, int]) -> str | None:
    written, read, times = pair
    try:
        for _ in range(times):
            text = _bytes(text, read).decode(written)
    except UnicodeError:
        return None
    return text


def _likely_garbled(word: str) -> bool:
    if _BROKEN.search(word) or _MIXED.search(word) or _ODD.search(word):
        return True
    return any((t := inverse(word, p)) is not None and _PLAUSIBLE.match(t) for p in PAIRS[:10] if p[2] == 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()

    def bigrams() -> pa.RecordBatch:
        pairs: Counter[tuple[int, int]] = Counter()
        shaped: Counter[str] = Counter()
        for w, n in words.items():
            shaped[w.translate(_DIGITS)] += n
        for w, n in shaped.items():
            if not _likely_garbled(w):
                for a, b in zip(f" {w}", f"{w} "):
                    pairs[ord(a), ord(b)] += n
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32()), pa.array(list(pairs.values()), pa.int64())], names=["a", "b", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if not t.isascii() or "?" in t:
                words.update(_words(t, marks=True))
        if len(words) > 300_000:
            yield bigrams()
    if words:
        yield bigrams()


class Model:
    def __init__(self, counts: list[tuple[int, int, int]]) -> None:
        self.pair = {(a, b): n for a, b, n in counts}
        self.first: Counter[int] = Counter()
        self.char: Counter[int] = Counter()
        beyond: Counter[int] = Counter()  # of each character, how often one beyond ASCII follows
        for a, b, n in counts:
            self.first[a] += n
            self.char[b] += n
            if b > 127:
                beyond[a] += n
        self.total = max(1, sum(self.char.values()))
        # What follows a lost character is what follows any beyond ASCII, and a lost one follows as any of these does.
        odd, after = max(1, sum(n for a, n in self.first.items() if a > 127)), Counter()
        for a, b, n in counts:
            if a > 127:
                after[b] += n
        share = sum(n for b, n in self.char.items() if b > 127) / self.total + _FLOOR
        self.logs: dict[tuple[int, int], float] = {(a, _ANY): math.log((beyond.get(a, 0) + _ALPHA * share) / (n + _ALPHA)) for a, n in self.first.items()}
        self.logs |= {(_ANY, b): math.log((n + _ALPHA * self.back(b)) / (odd + _ALPHA)) for b, n in after.items()}
        self.logs[_ANY, _ANY] = math.log(share)
        self.other = math.log(share)
        self.odd = odd
        self.units: dict[tuple[int, str], tuple[int, int] | None] = {}
        self.gains: dict[str, float] = {}
        self.starts: dict[str, list[int]] = {}

    def back(self, c: int) -> float:
        return self.char.get(c, 0) / self.total + _FLOOR

    def log(self, a: int, c: int) -> float:
        """Log probability of the written character c after a."""
        x = self.logs.get((a, c))
        if x is None:
            if c == _ANY:
                x = self.other
            elif a == _ANY:
                x = math.log(_ALPHA * self.back(c) / (self.odd + _ALPHA))
            else:
                x = math.log((self.pair.get((a, c), 0) + _ALPHA * self.back(c)) / (self.first.get(a, 0) + _ALPHA))
            self.logs[a, c] = x
        return x

    def unit(self, k: int, s: str, i: int) -> tuple[int, int] | None:
        """How many characters of s from i on state k emits at once, and what was written; None if it can't."""
        c = s[i]
        if k == CLEAN:
            return 1, ord(c)
        if k == LOST:
            if c == "\ufffd":
                n = i + 1
                while n < len(s) and s[n] == c:  # the bytes of one character may be lost one by one
                    n += 1
                return n - i, _ANY
            return (1, _ANY) if c == "?" and i + 1 < len(s) and s[i + 1] != " " else (1, ord(c))
        if c < "\x80":
            return 1, ord(c)
        pair = PAIRS[k - 1]
        longest = _LONGEST[pair[2]] if pair[0] == "utf-8" else 1
        key = k, s[i : i + longest]
        if key in self.units:
            return self.units[key]
        found = None
        for n in range(1, min(longest, len(key[1])) + 1):
            t = _undone(key[1][:n], pair)
            if t is not None and len(t) == 1:
                found = n, ord(t)
                break
        if len(self.units) > 500_000:
            self.units.clear()
        self.units[key] = found
        return found

    def beginning(self, c: str) -> list[int]:
        """The states that may be entered at the character: their inverse makes another character of it, alone or with those after it, that occurs in the records."""
        x = self.starts.get(c)
        if x is None:
            x = [LOST] if c in "?\ufffd" else []
            for k, (written, read, times) in enumerate(PAIRS, 1):
                try:
                    b = _bytes(c, read)[0] if c > "\x7f" else 0
                except UnicodeError:
                    continue
                if written == "utf-8":
                    if 0xC2 <= b <= 0xF4:
                        x.append(k)
                elif c > "\x7f" and (u := self.unit(k, c, 0)) is not None and u[1] != ord(c) and self.char.get(u[1]):
                    x.append(k)
            self.starts[c] = x
        return x

    def path(self, s: str, free: bool = False) -> tuple[float, list[tuple[int, int, int]]]:
        """The score and the likeliest (state, place, length) of the units of s. free: states change at no cost."""
        # best[i]: of each state, the score up to place i, the character written last, and (state before, place before)
        best: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in range(len(s) + 1)]
        best[0][CLEAN] = 0.0, 32, CLEAN, -1
        for i, c in enumerate(s):
            here = best[i]
            if not here:
                continue
            inside = INSIDE if i and not free and c > "\x7f" and s[i - 1] > "\x7f" else 0.0
            # the states to come from: the likeliest so far, and the clean one
            top = max(here, key=lambda k: here[k][0])
            origins = [(k, here[k][0] + inside + (0.0 if free or k == CLEAN else LEAVE), here[k][1]) for k in {top, CLEAN} if k in here]
            begins = c > "\x7f" or (c == "?" and i + 1 < len(s) and (s[i + 1].isalpha() or s[i + 1] == "?"))
            least = here[top][0] - BEAM
            for k in {CLEAN, *here, *self.beginning(c)} if begins else here.keys() | {CLEAN}:
                u = (1, ord(c)) if k == CLEAN or (not begins and k != LOST) else self.unit(k, s, i)
                if u is None:
                    continue
                own, x, before = here.get(k), -math.inf, k
                if own and own[0] > least:
                    x = own[0] + (STAY if k != CLEAN and begins and not free else 0.0) + self.log(own[1], u[1])
                if begins or k == CLEAN:
                    enter = 0.0 if k == CLEAN else (0.0 if free else ENTER_LOST if k == LOST else ENTER) - 0.001 * k
                    for origin, score, last in origins:
                        if origin != k and (y := score + enter + self.log(last, u[1])) > x:
                            x, before = y, origin
                if x == -math.inf:
                    continue
                to = best[i + u[0]]
                if k not in to or x > to[k][0]:
                    to[k] = x, u[1], before, i
        end = best[len(s)]
        k = max(end, key=lambda k: end[k][0] + (0.0 if free or k == CLEAN else LEAVE))
        score = end[k][0]
        out, i = [], len(s)
        while i > 0:
            _, _, before, at = best[i][k]
            out.append((k, at, i - at))
            k, i = before, at
        return score, out[::-1]

    def gain(self, word: str) -> float:
        """How much better the word is explained if states may change at no cost. Words of a line begin and end alike in all states, so that their gains add up."""
        shaped = word.translate(_DIGITS) + " "
        x = self.gains.get(shaped)
        if x is None:
            if len(self.gains) > 500_000:
                self.gains.clear()
            score, path = self.path(shaped, free=True)
            clean = sum(self.log(a, b) for a, b in zip((32, *map(ord, shaped)), map(ord, shaped))) if any(k for k, _, _ in path) else score
            x = self.gains[shaped] = max(0.0, score - clean)
        return x

    def line(self, text: str, found: Counter[int]) -> str:
        """The line restored; characters are added to ``found`` by state."""
        words = list(_WORD.finditer(text))
        if sum(self.gain(m.group()) for m in words) <= -max(ENTER, ENTER_LOST):
            return text  # all that other states explain better isn't worth leaving the clean one
        # the words that may be garbled, one after the other, with the place of each character
        s = "".join(m.group() + " " for m in words)
        place = [p for m in words for p in range(m.start(), m.end() + 1)]
        _, path = self.path(s.translate(_DIGITS))
        out, at = [], 0
        for k, i, n in path:
            if k == CLEAN or (s[i] < "\x80" and k != LOST):
                continue
            u = self.unit(k, s, i)
            if k == LOST and u is not None and u[1] != _ANY:
                continue
            found[k] += n
            if k != LOST and u is not None:
                out.append(text[at : place[i]] + chr(u[1]))
                at = place[i] + n
        return "".join(out) + text[at:]

    def read(self, text: str) -> tuple[str, Counter[int]] | None:
        """The text restored and its garbled characters by state; None if it is clean."""
        if _plain(text):
            return None
        found: Counter[int] = Counter()
        lines = [x if _plain(x) else self.line(x, found) for x in text.split("\n")]
        return ("\n".join(lines), found) if found else None


#: The model of the counts last used: a worker runs many tasks, and what it found out about words is worth keeping.
_MODEL: dict[int, Model] = {}


def _model(counts: tuple[tuple[int, int, int], ...]) -> Model:
    key = hash(counts)
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = Model(list(counts))
    return _MODEL[key]


def _read(counts: tuple[tuple[int, int, int], ...]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(counts)
        for b in batches:
            keep, text, names, whole = [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if (r := model.read(t)) is not None:
                    keep.append(i)
                    text.append(r[0])
                    names.append("; ".join(sorted({"lost" if k == LOST else f"{PAIRS[k - 1][0]} read as {PAIRS[k - 1][1]}" + (f" {PAIRS[k - 1][2]} times" if PAIRS[k - 1][2] > 1 else "") for k in r[1]})))
                    whole.append(LOST not in r[1] and "�" not in r[0])
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), pa.array(text, pa.string()), pa.array(names, pa.string()), pa.array(whole, pa.bool_())], names=["table_name", "record_id", "restored", "encodings", "complete"])

    return run


def garbled(records: DataFrame) -> DataFrame:
    """(table_name, record_id, restored, encodings, complete) of garbled records. records: (table_name, record_id, content)."""
    x = records.where("content IS NOT NULL AND record_id IS NOT NULL").select("table_name", "record_id", "content")
    # Bigrams of characters: at most the square of the alphabet, some ten thousand rows in any amount of text.
    counts = x.select("content").mapInArrow(_counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    found = x.mapInArrow(_read(tuple(sorted((r.a, r.b, r.n) for r in counts))), "table_name string, record_id string, restored string, encodings string, complete boolean")
    return found.dropDuplicates(["table_name", "record_id"])
