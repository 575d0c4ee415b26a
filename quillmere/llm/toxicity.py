"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, with exception phrases, normalised by length.

Folding lowers the text and replaces homoglyphs of other scripts, accented letters and digit or sign substitutions by
plain letters, one character for one, so places in the folded text are places in the text. A hit counts if the
characters around it are no letters or digits and no exception phrase covers it. The score is a logistic function of
the hits' weight and of the weight by length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm import common

#: Terms that count without any label.
TERMS = ("idiot", "moron", "stupid", "loser", "pathetic", "scum", "worthless", "trash", "clown", "disgusting", "imbecile", "dumbass", "bastard", "bitch", "asshole", "retard", "vermin", "filth")
#: Phrases in which a term is no insult. They end with a word, or anywhere within one where they have a star.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "class clown", "class clowns", "clown fish", "clown fishes", "clown car", "clown cars", "pond scum", "fire retard*", "flame retard*", "sore loser board", "not worthless", "never worthless", "not stupid")
#: Letters that look like a Latin one, and signs and digits that stand for letters.
HOMOGLYPHS = {
    "a": "аαɑ@4ª", "b": "ьƅ8", "c": "сϲ¢", "d": "ԁ", "e": "еεҽ3€", "g": "ɡց9", "h": "һ", "i": "іιı1!|¡", "j": "јϳ", "k": "кκ", "l": "ӏℓ", "m": "м", "n": "ոη",
    "o": "оοσօ0º", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7+", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ×", "y": "уγ", "z": "ᴢ2",
}
#: Rows that a lexicon is fitted on at most, the longest text among them, and the bytes of all together.
FIT_ROWS, FIT_CHARS, FIT_BYTES = 4000, 200_000, 64 << 20


def fold_table() -> dict[int, str]:
    table = {ord(c): letter for letter, like in HOMOGLYPHS.items() for c in like}
    for code in range(0x00C0, 0x0250):  # Latin letters with marks
        base = unicodedata.normalize("NFKD", chr(code).lower())[0]
        if base.isascii() and base.isalpha():
            table[code] = base
    for code in range(0xFF21, 0xFF5B):  # full-width letters
        if (plain := unicodedata.normalize("NFKC", chr(code))).isalpha():
            table[code] = plain.lower()
    return table


FOLD = fold_table()


def fold(text: str) -> str:
    lower = text.lower()
    if len(lower) != len(text):  # a few capitals have longer small forms
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return lower.translate(FOLD)


def uncovered(hits: list[tuple[int, int, float]], phrases: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """The hits that lie in none of the phrases, in order; both are gone through once."""
    out, ahead, reach = [], iter(sorted(phrases)), -1
    phrase = next(ahead, None)
    for hit in sorted(hits):
        while phrase and phrase[0] <= hit[0]:
            reach, phrase = max(reach, phrase[1]), next(ahead, None)
        if hit[1] > reach:
            out.append(hit)
    return out


@dataclass
class Lexicon:
    """Weights of folded terms, exception phrases, and the coefficients of the score: intercept, weight, density."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TERMS, 1.0))
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-2.0, 4.2, 0.5)

    def __post_init__(self) -> None:
        self.build()

    def build(self) -> None:
        automaton = ahocorasick.Automaton()
        for word in {t.rstrip("*") for t in self.weights}:
            automaton.add_word(word, (len(word), self.weights.get(word, 0.0), self.weights.get(word + "*", 0.0)))
        for phrase in self.exceptions:
            start = fold(phrase.rstrip("*"))
            automaton.add_word(start, (len(start), None, phrase.endswith("*") or automaton.get(start, (0, 0, False))[2]))
        automaton.make_automaton()
        self.automaton = automaton

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.build()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of each term that counts."""
        found, excused = [], []
        for end, (n, weight, as_stem) in self.automaton.iter(fold(text)):
            start = end + 1 - n
            if start and text[start - 1].isalnum():
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalnum()
            if weight is None:
                if whole or as_stem:
                    excused.append((start, end + 1))
            else:
                if weight := max(weight, as_stem) if whole else as_stem:
                    found.append((start, end + 1, weight))
        return uncovered(found, excused) if excused else found

    def features(self, text: str) -> tuple[float, float, int]:
        """Weight of the hits (its logarithm), the same for a thousand characters, and the number of hits."""
        hits = self.hits(text)
        weight = sum(h[2] for h in hits)
        return math.log1p(weight), math.log1p(1000 * weight / max(len(text), 200)), len(hits)

    def score(self, features: tuple[float, float, int]) -> float:
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * features[0] + c * features[1]))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, most_bytes: int = FIT_BYTES) -> list[tuple[str, int]]:
    """Whole texts and labels of at most ``rows`` documents that aren't held out and no longer than ``chars``, and of no more
    of them than have ``most_bytes`` bytes together, which are reckoned before any text is moved; the
    choice is by a hash of doc_id, from the labels alone, so only chosen texts are moved. A doc_id counts once: with its
    greatest label, and of several texts with that of the least hash, so the same tables give the same rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out("doc_id"))
    chosen = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", common.text_of("text").alias("text")).where(F.length("text") <= chars)
    longest = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"), F.first("y").alias("y"))
    within, room = [], most_bytes
    for r in longest.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if (room := room - r["bytes"]) < 0:
            break
        within.append((r["doc_id"], r["y"]))
    taken = docs.sparkSession.createDataFrame(within, T.StructType([longest.schema["doc_id"], longest.schema["y"]]))
    one = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    return [(r["row"]["text"], r["row"]["y"]) for r in one.orderBy("doc_id").collect()]


WORDS = re.compile(r"[a-z]{4,24}")
STEMS = range(4, 8)
#: The share of a word that counts in fitting at most, and the words that a text is taken to have at least.
MOST_SHARE, LEAST_WORDS = 0.03, 30


#: From the first to the last letter or digit of what white space parts: signs at its ends are no letters.
INNER = re.compile(r"[^\W_](?:\S*[^\W_])?")


def words_of(text: str) -> list[str]:
    """Folded words of a text, in order."""
    folded = fold(text)
    return [w for m in INNER.finditer(text) for w in WORDS.findall(folded[m.start() : m.end()])]


def shares(text: str) -> dict[str, float]:
    """The share of a text's words that each of its words and, with a star, their first letters make up, at most MOST_SHARE:
    a text of one word repeated tells no more of it than one that has it often."""
    words = words_of(text)
    counts = Counter(words)
    for w, n in list(counts.items()):
        for k in STEMS:
            if len(w) >= k:
                counts[w[:k] + "*"] += n
    return {w: min(MOST_SHARE, n / max(LEAST_WORDS, len(words))) for w, n in counts.items()}


def fit_lexicon(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, least_gain: int = 6, least_rate: float = 5.0) -> Lexicon:
    """lexicon_of the training rows."""
    return lexicon_of(training_rows(docs, labels, "toxic", rows, chars), least_gain, least_rate)


def lexicon_of(labelled: list[tuple[str, int]], least_gain: int = 6, least_rate: float = 5.0) -> Lexicon:
    """Terms by their rates: the rate of a word or stem is its mean share of toxic texts over that of other texts, so a stem
    that long clean texts have now and then still tells. Again and again the one is taken that has the most evidence, the
    logarithm of its rate for each toxic text with it that isn't covered yet; below ``least_rate``, and in fewer than
    ``least_gain`` such texts, none is taken. A weight is the logarithm of the rate. Words of copies of a covered text
    gain nothing, so texts don't teach their own vocabulary. Below a chosen
    stem, longer forms that are more telling still count besides, and given terms are weighed by their rates where that is
    more. Without labels of both kinds: the given terms."""
    base = Lexicon()
    texts: dict[str, tuple[str, int]] = {}
    for text, y in labelled:
        texts.setdefault(fold(text), (text, y))
    seen = {text: y for text, y in texts.values()}  # one of those that fold alike
    toxic = {i: t for i, (t, y) in enumerate(seen.items()) if y == 1}
    n_clean = sum(y == 0 for y in seen.values())
    if not toxic or not n_clean:
        return base
    holders: defaultdict[str, set[int]] = defaultdict(set)
    counted = Counter(w for t in toxic.values() for w in shares(t))
    frequent = {w for w, n in counted.items() if n >= least_gain}
    del counted
    bad, good = Counter(), Counter()
    for i, (t, y) in enumerate(seen.items()):
        for w, share in shares(t).items():
            if w in frequent:
                (bad if y else good)[w] += share
                if y:
                    holders[w].add(i)
    # half a text with the usual share is added to both kinds
    half = {w: 0.5 * bad[w] / len(h) for w, h in holders.items()}
    rate = {w: (bad[w] + half[w]) / (len(toxic) + 1) / ((good[w] + half[w]) / (n_clean + 1)) for w in holders}
    able = {w: h for w, h in holders.items() if rate[w] >= least_rate}
    weights = {w: max(weight, min(3.0, math.log10(rate[w]))) if w in able else weight for w, weight in base.weights.items()}
    left = set(toxic)
    while able:
        gain = {w: len(h & left) for w, h in able.items()}
        able = {w: able[w] for w, n in gain.items() if n >= least_gain}  # gains only fall
        if not able:
            break
        best = max(able, key=lambda w: (gain[w] * math.log(rate[w]), len(able[w]), "*" not in w, len(w), w))
        left -= able.pop(best)
        weights[best] = min(3.0, math.log10(rate[best]))
        stem = best.rstrip("*") if best.endswith("*") else None
        for w in [w for w in holders if stem and w != best and w.startswith(stem) and rate[w] >= 4 * rate[best]]:
            weights[w] = min(3.0, math.log10(rate[w]))
    lexicon = Lexicon(weights, base.exceptions)
    x = np.array([[1.0, *lexicon.features(t)[:2]] for t in seen])
    y = np.array(list(seen.values()), float)
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    for _ in range(30):  # Newton steps; the ridge keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    lexicon.coefficients = tuple(float(b) for b in beta)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_hits for each row of docs. Null texts are empty and have no hits; rows are scored
    one by one, so copies, repeated ids and very long texts need nothing special; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            scores, hits = [], []
            for text in batch.column(1).to_pylist():
                f = lexicon.features(text or "")
                scores.append(lexicon.score(f))
                hits.append(f[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(hits, pa.int32())], names=["doc_id", "score", "predicted", "n_hits"]
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.IntegerType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=at):
            yield batch.filter(pa.array([lexicon.score(lexicon.features(t or "")) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
