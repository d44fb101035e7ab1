"""Toxicity by a noisy channel: Viterbi restores disguised words under a character model, then the restored text is scored.

Three steps, each over Spark: letter trigrams counted over all texts (as arrays); frequent words and features (words and word
beginnings) counted over a bounded sample of labelled rows; every text restored and scored. What tasks receive is
bounded: the trigram table by its alphabet, the words and features by ``max_words`` and ``max_features``.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestry.session import written

# Fixed value: letters of the character model. Others count as one class, so the trigram table has at most 70 ** 3 rows.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
# Fixed value: what a written sign may stand for besides itself.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
JOINERS = ".-_*~'`^"
EDGE, OTHER, PATH = "^", "?", "="
KNOWN = frozenset(LETTERS)

TRIGGER = re.compile(r"[0-9@$!|+(€£¡]|[._*~'`^-](?<=[^\W\d_].)(?=[^\W\d_])|([^\W\d_])\1")
#: Three or more tokens in a row of at most two letters or signs each (repeats and joiners not counted), whatever space parts them.
SHORT = r"[^\w\s$@€£]*+(?:([\w$@€£])\NUM*+[^\w\s$@€£]*+){0,2}"
RUN = re.compile(r"\s" + SHORT.replace("NUM", "1") + r"(?!\S)(?:\s++" + SHORT.replace("NUM", "2") + r"(?!\S)){2,}+")
SAME = re.compile(r"(.)\1*", re.S)
DOUBLED = re.compile(r"([^\W\d_])\1")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: Longest token whose reading is kept for the next time; longer ones are read each time.
LONGEST = 64
#: Signs around a token that part words and stand for no letter.
AROUND = ".,;:?)[]{}/\\&#%=<>\"'“”‘’„«»…–—-_*~`^"
PUNCTUATION = frozenset("!|+(¡")


def letters(word: str) -> str:
    return "".join(c if c in KNOWN else OTHER for c in word)


class Restorer:
    """Most likely reading of a disguised token; ``trigrams`` maps three signs (edges included) to their count."""

    def __init__(self, trigrams: dict[str, int], vocabulary: dict[str, int] | None = None, penalty: float = 1.0) -> None:
        pairs: Counter[str] = Counter()
        first: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        single: Counter[str] = Counter()
        for gram, n in trigrams.items():
            pairs[gram[:2]] += n
            ends[gram[1:]] += n
            first[gram[1]] += n
            single[gram[2]] += n
        self.trigrams, self.pairs, self.ends, self.first, self.single, self.all = trigrams, pairs, ends, first, single, sum(trigrams.values())
        self.vocabulary, self.penalty = vocabulary or {}, penalty
        total = sum(self.vocabulary.values())
        # Frequent words as paths: every beginning, with the price of the word where it is one.
        self.paths: dict[str, float | None] = dict.fromkeys((PATH + w[:n] for w in self.vocabulary for n in range(1, len(w))), None)
        self.paths |= {PATH + w: math.log(total / n) for w, n in self.vocabulary.items()}
        self.memo: dict[str, str] = {}
        self.costs: dict[str, float] = {}
        self.moves: dict[str, tuple[tuple[str, float], ...]] = {}

    def cost(self, two: str, c: str) -> float:
        """Minus the log of the letter's chance after two others, mixed with the shorter models so that rare words stay possible."""
        known = self.costs.get(two + c)
        if known is None:
            share = 0.1 * (self.single[c] + 1) / (self.all + len(LETTERS) + 2)
            share += 0.3 * self.ends[two[1] + c] / max(1, self.first[two[1]])
            known = self.costs[two + c] = -math.log(share + 0.6 * self.trigrams.get(two + c, 0) / max(1, self.pairs[two]))
        return known

    def ways(self, c: str, n: int, edge: bool) -> list[tuple[str, float]]:
        """What ``n`` times the sign ``c`` may stand for, with prices; a space in it ends a word. ``edge``: beside a space or an end."""
        p = self.penalty
        if c.isspace():
            return [(" ", 0.0), ("", p)]
        if c.isalpha():
            return [(c * min(n, 2), 0.0 if n <= 2 else p)] + ([(c, p * (1 if n > 2 else 3))] if n > 1 else [])
        if c in SIGNS:
            return [(a * m, p) for a in SIGNS[c] for m in sorted({1, min(n, 2)})] + [("", p * (1 if edge and c in PUNCTUATION else 8))] + ([(" ", p)] if c in PUNCTUATION else [])
        if c in JOINERS:
            return [("", 0.0), (" ", p)]
        if unicodedata.category(c)[0] in "PS":
            return [(" ", 0.0), ("", p)]
        return [("", p if c.isalnum() else 0.0)]

    def read(self, token: str) -> str:
        """Viterbi over the lattice of ``token`` (lower case; a run of tokens has spaces), words parted by spaces.

        A state is the last two letters, or the path of a frequent word; it keeps its best way back as a chain that
        shares its links with other states, so time and memory are linear in the token. Ties take the way found first.
        """
        known = self.memo.get(token)
        if known is not None:
            return known
        runs = [(m.group(0)[0], len(m.group(0))) for m in SAME.finditer(token)]
        moves = self.moves
        states: dict[str, tuple[float, tuple | None]] = {EDGE * 2: (0.0, None)}
        for i, (c, n) in enumerate(runs):
            edge = i in (0, len(runs) - 1) or runs[i - 1][0].isspace() or runs[i + 1][0].isspace()
            after: dict[str, tuple[float, tuple | None]] = {}
            ways = self.ways(c, n, edge)
            for state, (total, back) in states.items():
                for put, price in ways:
                    now, link = total + price, (back, put) if put else back
                    to = moves.get(state + put)
                    for tail, more in self.steps(state, put) if to is None else to:
                        best = after.get(tail)
                        if best is None or now + more < best[0]:
                            after[tail] = (now + more, link)
            states = after
        done = [(total + more, back) for state, (total, back) in states.items() for _, more in self.steps(state, " ")]
        back, puts = min(done, key=lambda x: x[0])[1], []
        while back is not None:
            back, put = back
            puts.append(put)
        out = " ".join("".join(reversed(puts)).split())
        if len(token) <= LONGEST:
            if len(self.memo) >= 100_000:
                self.memo.clear()
            self.memo[token] = out
        return out

    def doubled(self, word: str) -> str | None:
        """What the lattice gives for a word of letters with a few doubled ones: its few readings, tried one by one. None for others."""
        spots = [m.start() + 1 for m in DOUBLED.finditer(word)]
        if len(spots) > 4 or any(word[k : k + 2] == word[k] * 2 for k in spots):
            return None
        if len(spots) == 1:
            k = spots[0]
            short = word[:k] + word[k + 1 :]
            if PATH + word not in self.paths and PATH + short not in self.paths:
                before, x, after = letters(word[k - 2]) if k > 1 else EDGE, letters(word[k]), letters(word[k + 1 : k + 2]) or EDGE
                return short if self.cost(before + x, x) + self.cost(x + x, after) > self.cost(before + x, after) + 3 * self.penalty else word
        runs = [(m.group(0)[0], len(m.group(0))) for m in SAME.finditer(word)]
        readings = [("", 0.0)]
        for c, n in runs:
            readings = [(r + c * n, price) for r, price in readings] + ([(r + c, price + 3 * self.penalty) for r, price in readings] if n > 1 else [])
        best, out = math.inf, word
        for r, price in readings:
            put = EDGE * 2 + letters(r) + EDGE
            known = self.paths.get(PATH + r)
            total = price + sum(self.cost(put[i : i + 2], put[i + 2]) for i in range(len(put) - 2))
            if known is not None:
                total = min(total, price + known)
            if total < best:
                best, out = total, r
        return out

    def steps(self, state: str, put: str) -> tuple[tuple[str, float], ...]:
        """States after the letters ``put``, or after the end of a word where ``put`` is a space, each with its price."""
        out: list[tuple[str, float]] = []
        if not put:
            out.append((state, 0.0))
        elif state[0] == PATH:
            price = self.paths[state] if put == " " else 0.0 if state + put in self.paths else None
            out += [] if price is None else [(EDGE * 2 if put == " " else state + put, price)]
        elif put == " ":
            out.append((EDGE * 2, 0.0 if state == EDGE * 2 else self.cost(state, EDGE)))
        else:
            two, price = state, 0.0
            for a in put:
                b = a if a in KNOWN else OTHER
                price += self.cost(two, b)
                two = two[1] + b
            out.append((two, price))
            if state == EDGE * 2 and PATH + put in self.paths:
                out.append((PATH + put, 0.0))
        if len(self.moves) >= 200_000:
            self.moves.clear()
        self.moves[state + put] = tuple(out)
        return self.moves[state + put]

    def tokens(self, text: str) -> set[str]:
        """Distinct tokens of the lower-cased text, and its runs of short tokens."""
        low = text.lower()
        return set(low.split()) | {" ".join(run.split()) for run in (m.group(0) for m in RUN.finditer(" " + low)) if WORD.search(run)}

    def words(self, token: str) -> list[str]:
        """Words of three letters or more in a token or a run of short tokens, read anew if it is disguised."""
        if (" " in token or TRIGGER.search(token)) and WORD.search(token):
            token = token.strip(AROUND)
            token = (self.doubled(token) if token.isalpha() else None) or self.read(token)
        return [w for w in WORD.findall(token) if len(w) > 2]


def features(words: Iterable[str]) -> set[str]:
    """Words and the beginnings of longer ones (marked by ``-``)."""
    found = set(words)
    return found | {w[:n] + "-" for n in BEGINNINGS for w in found if len(w) > n}


def letter_classes(signs: set[str]) -> np.ndarray:
    """Class of each code point up to the largest of ``signs``: 0 parts words, 1 + n is the n-th letter of the model, the last any other letter."""
    out = np.zeros(max(map(ord, signs), default=0) + 1, np.int64)
    for c in signs:
        if WORD.fullmatch(c):
            out[ord(c)] = 1 + (LETTERS.index(c) if c in KNOWN else len(LETTERS))
    return out


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram, n`` over the words of all texts, edges included; each task sends one row per gram."""
    base = len(LETTERS) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = np.zeros(base**3, np.int64)
        for batch in batches:
            for start in range(0, len(batch), 500):
                joined = "\n".join(filter(None, batch["t"].iloc[start : start + 500])).lower()
                c = letter_classes(set(joined))[np.frombuffer(f"\n\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)] if joined else np.zeros(3, np.int64)
                # A letter, or the edge after one, with the two signs before it; edges also stand before a word's first letter.
                second = c[1:-1]
                first = np.where(second > 0, c[:-2], 0)
                ends = (c[2:] > 0) | (second > 0)
                grams += np.bincount(((first * base + second) * base + c[2:])[ends], minlength=base**3)
        signs = EDGE + LETTERS + OTHER
        found = np.flatnonzero(grams)
        names = [signs[g // base // base] + signs[g // base % base] + signs[g % base] for g in found.tolist()]
        yield pd.DataFrame({"gram": names, "n": grams[found]}, columns=["gram", "n"])

    rows = docs.select(docs[text].alias("t")).mapInPandas(run, "gram string, n long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


def feature_counts(rows: DataFrame, chosen: dict[str, float]) -> DataFrame:
    """``feature, n_pos, n`` over rows ``words, toxic`` that hold no chosen feature; each task sends one row per feature it met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every: Counter[str] = Counter()
            toxic: Counter[str] = Counter()
            for value, label in zip(batch["words"], batch["toxic"]):
                found = features(value)
                if chosen.keys().isdisjoint(found):
                    every.update(found)
                    if label:
                        toxic.update(found)
            yield pd.DataFrame({"feature": list(every.keys()), "n_pos": [toxic[f] for f in every], "n": list(every.values())}, columns=["feature", "n_pos", "n"])

    return rows.mapInPandas(run, "feature string, n_pos long, n long").groupBy("feature").agg(F.sum("n_pos").alias("n_pos"), F.sum("n").alias("n"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` over the column ``text``: how often each word stands there as it is written (words of up to 24 letters)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(w for value in batch["text"] if value for w in WORD.findall(value.lower()) if len(w) <= 24)
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())}, columns=["word", "n"])

    return rows.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# What a Python worker has opened last, so that its later tasks find the restorer and what it has read.
_OPENED: dict[str, tuple] = {}


def opened(kind: str, blob: bytes, build: Callable[..., object]) -> tuple:
    """``(build(*what the blob holds), a memo)``, made once per worker and model."""
    name = hashlib.sha256(blob).hexdigest()
    if kind not in _OPENED or _OPENED[kind][0] != name:
        _OPENED[kind] = (name, build(*pickle.loads(blob)), {})
    return _OPENED[kind][1:]


def restored_words(rows: DataFrame, restorer: Restorer) -> DataFrame:
    """``words, toxic`` for rows ``text, toxic``: the distinct restored words of each text."""
    blob = pickle.dumps((restorer.trigrams, restorer.vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = opened("restorer", blob, Restorer)
        for batch in batches:
            found = [sorted({w for t in own.tokens(value) for w in own.words(t)}) if value else [] for value in batch["text"]]
            yield pd.DataFrame({"words": found, "toxic": batch["toxic"].values}, columns=["words", "toxic"])

    return rows.mapInPandas(run, "words array<string>, toxic int")


def lower_bound(share: Column, n: Column, z: float = 1.0) -> Column:
    """Wilson's lower bound of a share."""
    return (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int | None = None, max_features: int = 50_000, max_words: int = 50_000, rounds: int = 6) -> tuple[Restorer, dict[str, float], float]:
    """The restorer, the weight of each telling feature, and the base rate.

    All labelled rows are read, unless ``fit_rows`` asks for a sample (labelled keys with the smallest hashes, an expected
    number of ``fit_rows``, spread over the whole table); ``max_features`` bounds the
    model and ``max_words`` the frequent words that the restorer knows whole. A list is learned in ``rounds``: each takes the features whose share of label 1 is furthest above the base
    rate (G statistic over 20 and over an eighth of the round's best, Wilson lower bound at least 0.7, for beginnings 0.93) and sets aside
    the texts that hold one. So words that only stand beside a telling word, as in copies of one text, are not learned.
    """
    grams = {r.gram: r.n for r in trigram_counts(docs, text).collect()}
    marked = labels.select(labels[key].alias("_k"), labels[label].cast("int").alias("toxic")).filter("_k is not null and toxic is not null").groupBy("_k").agg(F.max("toxic").alias("toxic"))
    sample = marked
    if fit_rows is not None:
        share = min(1.0, fit_rows / max(1, marked.count()))
        sample = marked.filter(F.pmod(F.xxhash64("_k", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = written(docs.select(docs[key].alias("_k"), docs[text].cast("string").alias("text")).join(sample, "_k").select("text", "toxic"), "sample")
    vocabulary = {r.word: r.n for r in word_counts(rows).filter("n > 1").orderBy(F.desc("n"), "word").limit(max_words).collect()}
    restorer = Restorer(grams, vocabulary)
    rows = written(restored_words(rows, restorer), "labelled")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).head()
    n, p = float(total.n or 0), float(total.p or 0)
    base = p / n if n else 0.0
    weights: dict[str, float] = {}
    if 0 < p < n:
        part = F.col("n_pos") / F.col("n")
        clean = F.when(F.col("n_pos") < F.col("n"), (F.col("n") - F.col("n_pos")) * F.log((1 - part) / (1 - base))).otherwise(0.0)
        for _ in range(rounds):
            told = feature_counts(rows, weights).filter("n_pos >= 3").withColumn("g", 2 * (F.col("n_pos") * F.log(part / base) + clean)).withColumn("w", lower_bound(part, F.col("n")))
            best = told.filter((F.col("g") > 20) & (part > base) & (F.col("w") >= F.when(F.endswith(F.col("feature"), F.lit("-")), 0.93).otherwise(0.7))).orderBy(F.desc("g"), "feature").limit(max_features - len(weights)).collect()
            if not best:
                break
            weights |= {r.feature: r.w for r in best if r.g * 8 >= best[0].g}
    return restorer, weights, base


def score(docs: DataFrame, model: tuple[Restorer, dict[str, float], float], key: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` (0 to 1) to every row of ``docs``: the chance that at least one telling feature of the restored text is right.

    Features of one token count once (the strongest). Null and empty texts, and texts with nothing telling, get a quarter
    of the base rate or less. ``text`` is a string column. Texts are read whole; repeated rows get equal scores; other columns pass through, one
    named ``out`` is replaced.
    """
    restorer, weights, base = model
    blob, told, floor = pickle.dumps((restorer.trigrams, restorer.vocabulary)), pickle.dumps((weights,)), base / 4

    # Rows go through Python as Arrow batches and texts one by one, so that neither side holds them a second time.
    names = [c for c in docs.columns if c != out]
    at, schema = names.index(text), StructType([*[f for f in docs.schema.fields if f.name != out], StructField(out, DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = opened("restorer", blob, Restorer)
        known, memo = opened("weights", told, dict)
        get = known.get

        def weight(token: str) -> float:
            if token.isalpha() and not DOUBLED.search(token):
                # An undisguised word is its own reading.
                n = len(token)
                return max(get(token, 0.0), *[get(token[:k] + "-", 0.0) for k in BEGINNINGS if n > k], 0.0) if n > 2 else 0.0
            value = memo.get(token)
            if value is None:
                value = max((get(f, 0.0) for f in features(own.words(token))), default=0.0)
                if len(token) <= LONGEST:
                    if len(memo) >= 300_000:
                        memo.clear()
                    memo[token] = value
            return value

        for batch in batches:
            scores = []
            for cell in batch.column(at):
                value, miss = cell.as_py(), 1.0
                for x in sorted(filter(None, map(weight, own.tokens(value)))) if value else ():
                    miss *= 1 - x
                scores.append(floor + (1 - floor) * (1 - miss))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, out])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(judge, schema)
