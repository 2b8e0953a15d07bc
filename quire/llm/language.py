"""Document and segment languages by rank-order profiles (Cavnar and Trenkle).

The profile of a language is its most frequent character n-grams, within words, by rank. A sentence's n-grams are ranked the same way (equal
counts share their mean rank), and its out-of-place distance to a language is the sum, over its n-grams, of the
difference of the two ranks; an n-gram missing in a profile counts as far as can be. Names, figures, quoted terms and
units are left out. The sentences of a document are then given languages together: a change of language from one
sentence to the next costs as much as CHANGE of distance, so a single doubtful sentence follows its neighbours.

Profiles are fitted on texts whose label names the language, at most PROFILE_DOCUMENTS for each, those with
the smallest hash of their id: a documented bound; labels may be wrong now and then, which frequencies survive. Everything else reads all texts whole.

Defined cases: null, empty and blank texts and texts without words have no language and give no row; a text of one
sentence has that sentence's language; documents keep their doc_id; equal distances go to the first language in LANGUAGES. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The languages, and forms of their labels.
LANGUAGES = ["en", "fr", "de", "es", "pt", "nl", "sw", "am", "ru"]
LABELS = {
    "en": ["en", "eng", "english"], "fr": ["fr", "fra", "fre", "french", "français"], "de": ["de", "deu", "ger", "german", "deutsch"], "es": ["es", "spa", "spanish", "español"], "pt": ["pt", "por", "portuguese", "português"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"], "sw": ["sw", "swa", "swh", "swahili", "kiswahili"], "am": ["am", "amh", "amharic"], "ru": ["ru", "rus", "russian"],
}
UNKNOWN = ["", "und", "unknown", "xx", "xxx", "zxx", "mis", "mul", "none", "null", "na", "n/a", "?", "-", "other", "unk", "nan"]
PROFILE_DOCUMENTS = 1500
PROFILE_SIZE = 500
GRAMS = (2, 3)
#: The cost of a change of language between sentences, in n-grams that are as far as can be.
CHANGE = 6.0

_UNITS = "million|billion|thousand|mn|bn|tonnes?|km|ha|MWh|kWh|GWh|kg"
# Names: three or more capitalised Latin words in a row, the last one maybe a company form.
_NAME = re.compile(r"(?:[A-Z][a-z’'-]+ ){2,}(?:[A-Z][a-z’'-]+|PLC|SC)")
_QUOTED = re.compile(r"[“\"«„][^”\"»\n]{0,80}[”\"»]|\([^()\n]{0,60}\)")
_FIGURE = re.compile(rf"\d(?:[\d.,]*\d)?%?(?: (?:{_UNITS})\b)?")
_ENDS = re.compile(r"[.!?።]+(?=\s|$|[”\"»)])|\n")
_LETTERS = re.compile(r"[^\W\d_]+")
# Marks of figures and names that may be left over.
_LEFT_OVER = {"etb", "fy", "q", "h", "sc", "plc", "p"}


def normal_label(c: str | Column) -> Column:
    """A label's language as a two-letter code: null if it is missing or unknown, itself if it names another language."""
    base = F.lower(F.trim(c))
    head = F.regexp_extract(base, r"^([^-_ (]+)", 1)
    code = F.create_map(*(F.lit(x) for k, names in LABELS.items() for n in names for x in (n, k)))
    known = F.coalesce(F.element_at(code, base), F.element_at(code, head))
    return F.when(F.coalesce(base, F.lit("")).isin(UNKNOWN), None).otherwise(F.coalesce(known, head))


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence, in lower case, without names, figures and quoted terms."""
    text = _QUOTED.sub(" ", text.replace("S.C.", "SC"))
    text = _FIGURE.sub(" ", _NAME.sub(" ", text))
    return [t for s in _ENDS.split(text) if s and (t := s.lower().split())]


def words_of(token: str) -> list[str]:
    return [w for w in _LETTERS.findall(token) if w not in _LEFT_OVER]


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter[str]] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = words.setdefault(lang, Counter())
            for s in sentences(text):
                c.update(s)
    for lang, c in words.items():
        g: Counter[str] = Counter()
        for token, n in c.items():
            for w in words_of(token):
                for x in grams(w):
                    g[x] += n
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(list(g)), pa.array(list(g.values()), pa.int64())], names=["lang", "gram", "n"])


def profiles(documents: DataFrame) -> dict[str, list[str]]:
    """The PROFILE_SIZE most frequent n-grams of each language, by rank: a bounded table, fitted on a bounded sample."""
    x = documents.where("length(trim(text)) > 0").select(normal_label("lang").alias("lang"), "doc_id", F.xxhash64("doc_id").alias("h")).where(F.col("lang").isin(LANGUAGES))
    rank = F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, doc_id)")  # the window keeps the first rows of each partition before it shuffles
    chosen = x.withColumn("r", rank).where(F.col("r") <= PROFILE_DOCUMENTS).select("lang", "doc_id")
    # at most PROFILE_DOCUMENTS ids for each language are broadcast; texts stay where they are
    sample = documents.where("length(trim(text)) > 0").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")
    n = sample.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = n.withColumn("r", F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)")).where(F.col("r") <= PROFILE_SIZE)
    out: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.r)):  # at most PROFILE_SIZE rows for each language
        out[r.lang].append(r.gram)
    return out


class _Tokens(dict):
    """A number for each token; the n-grams that any profile has of it, and its number of words, lie in arrays by that number."""

    def __init__(self, ids: dict[str, int]) -> None:
        super().__init__()
        self.ids, self.new = ids, []
        self.grams, self.start, self.words = np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)

    def __missing__(self, token: str) -> int:
        w = words_of(token)
        self.new.append(([i for y in w for g in grams(y) if (i := self.ids.get(g)) is not None], len(w)))
        x = self[token] = len(self)
        return x

    def settle(self) -> None:
        if self.new:
            self.grams = np.concatenate([self.grams, np.array([i for g, _ in self.new for i in g], np.int64)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(g) for g, _ in self.new])])
            self.words = np.concatenate([self.words, [n for _, n in self.new]])
            self.new = []


class Identifier:
    def __init__(self, profile: dict[str, list[str]]) -> None:
        self.languages = [x for x in LANGUAGES if profile.get(x)]
        self.ids = {g: i for i, g in enumerate(sorted({g for p in profile.values() for g in p}))}
        self.rank = np.full((len(self.ids) + 1, len(self.languages)), PROFILE_SIZE, np.float32)
        for k, lang in enumerate(self.languages):
            for r, g in enumerate(profile[lang]):
                self.rank[self.ids[g], k] = r
        self.tokens = _Tokens(self.ids)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sentences with words: how many each text has, their numbers of words, and their distances."""
        if len(self.tokens) > 400_000:
            self.tokens = _Tokens(self.ids)
        docs = [sentences(t) for t in texts]
        per_doc = np.array([len(x) for x in docs], np.int64)
        all_ = [s for x in docs for s in x]
        length = np.array([len(s) for s in all_], np.int64)
        token = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(all_)), np.int64, int(length.sum()))
        self.tokens.settle()
        sentence = np.repeat(np.arange(len(all_)), length)
        n_words = np.bincount(sentence, weights=self.tokens.words[token], minlength=len(all_)).astype(np.int64)
        kept = n_words > 0
        number = np.cumsum(kept) - 1
        # every token's n-grams, one after the other
        first, size = self.tokens.start[token], self.tokens.start[token + 1] - self.tokens.start[token]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        of = np.repeat(sentence, size)
        ok = kept[of]
        d = self.distances(number[of][ok], self.tokens.grams[place][ok], int(kept.sum()))
        return np.bincount(np.repeat(np.arange(len(docs)), per_doc)[kept], minlength=len(docs)), n_words[kept], d

    def distances(self, sentence: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): out-of-place distances of n sentences, in units of the largest distance an n-gram can have.

        An n-gram in no profile is as far from every language, so it is left out.
        """
        out = np.zeros((n, len(self.languages)))
        if not len(gram):
            return out
        base = len(self.ids) + 1
        key, count = np.unique(sentence * base + gram, return_counts=True)
        sentence, gram = key // base, key % base
        # rank within the sentence by count, equal counts at their mean rank: how many have more, and half of those with as many
        k = int(count.max()) + 1
        same = np.bincount(sentence * k + count, minlength=n * k).reshape(n, k)
        more = same[:, ::-1].cumsum(axis=1)[:, ::-1] - same
        own = (more + (same - 1) / 2).astype(np.float32)[sentence, count]
        first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        d = np.abs(own[:, None] - self.rank[gram]) / PROFILE_SIZE
        out[sentence[first]] = np.add.reduceat(d, first, axis=0)
        return out


def best_path(d: np.ndarray) -> np.ndarray:
    """The language of each sentence with the least distance and changes in all."""
    nearest = d.argmin(axis=1)
    if (nearest == nearest[0]).all():
        return nearest
    cost, back = d[0].copy(), []
    for row in d[1:]:
        least = int(cost.argmin())
        switch = cost[least] + CHANGE
        stay = cost <= switch
        back.append(np.where(stay, np.arange(len(cost)), least))
        cost = np.where(stay, cost, switch) + row
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _identified(profile: dict[str, list[str]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(profile)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                if not who.languages:
                    continue
                n_sentences, n_words, d = who.read(b.column(1).to_pylist())
                rows: list[list] = [[] for _ in range(7)]
                pos = 0
                for i, n in zip(b.column(0).to_pylist(), n_sentences.tolist()):
                    own, words = d[pos : pos + n], n_words[pos : pos + n]
                    pos += n
                    if not n:
                        continue
                    path = best_path(own)
                    start = 0
                    for k in range(1, len(path) + 1):
                        if k == len(path) or path[k] != path[start]:
                            total = own[start:k].sum(axis=0)
                            best = total[path[start]]
                            other = np.delete(total, path[start]).min() if len(total) > 1 else best + 1
                            sure = float(np.clip((other - best) / other, 0, 1)) if other > 0 else 0.0
                            for c, v in zip(rows, (i, len(rows[0]), who.languages[path[start]], start, k - start, int(words[start:k].sum()), sure)):
                                c.append(v)
                            start = k
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "o", "lang", "first_sentence", "n_sentences", "n_words", "confidence"])

    return run


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, first_sentence, n_sentences, n_words, confidence) of each stretch of sentences in one language.

    confidence: how much farther the next language is, as a share of its distance.
    """
    x = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return x.mapInArrow(_identified(profiles(documents)), "doc_id long, o int, lang string, first_sentence int, n_sentences int, n_words int, confidence double").drop("o")


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, label, lang, is_main, n_languages, confidence): each language that counts in a text, one with two sentences in a row, or the main one."""
    s = segments(documents)
    per = s.groupBy("doc_id", "lang").agg(F.max("n_sentences").alias("run"), F.sum("n_words").alias("n_words"), F.max("confidence").alias("confidence"))
    # a document's languages: at most len(LANGUAGES) rows
    order = "row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, lang)"
    per = per.withColumn("is_main", F.expr(order) == 1).where("run >= 2 OR is_main")
    per = per.withColumn("n_languages", F.expr("count(*) OVER (PARTITION BY doc_id)"))
    labels = documents.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.first("lang").alias("label"))
    return per.join(labels, "doc_id").select("doc_id", "label", "lang", "is_main", "n_languages", "confidence")


def wrong_labels(documents: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of texts whose label is missing, wrong, or not the only one."""
    x = languages(documents).withColumn("named", normal_label("label"))
    main = F.max(F.when(F.col("is_main"), F.col("lang"))).over(Window.partitionBy("doc_id"))
    return x.withColumn("main", main).where("named IS NULL OR named <> main OR n_languages > 1").select("doc_id", "lang")
