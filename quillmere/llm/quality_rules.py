"""Quality rules: plain counts of words, lines and symbols, and the divergence of a document from its language.

References come from the whole corpus: for each language that holds a share of all words, the median share of every
character class over its documents (junk shifts a mean, not a median) and the counts of its most frequent words. A
document of one of these languages is compared with every reference by the Jensen-Shannon distance (base 2, so from 0
to 1) of both histograms, and the nearest one counts. Short documents are not judged, as their histograms say little,
nor are documents of languages that have no reference.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm import common

SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split also splits at.
OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()[]{}*$%&#|<>-"
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other", "beyond")
#: A worker hands on its word counts at so many entries.
FLUSH = 200_000
#: Longer words are counted by their digest, which bounds what is moved and held of a word.
LONGEST = 24


def class_of_byte() -> np.ndarray:
    """Position in CLASSES of each byte of UTF-8; continuation bytes count for nothing (the last place)."""
    out = np.full(256, CLASSES.index("other"), np.uint8)
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", SPACES), ("sentence", ".,;:!?'\"()-"), ("symbol", SYMBOLS)):
        out[list(chars.encode())] = CLASSES.index(name)
    out[0xC0:] = CLASSES.index("beyond")
    out[0x80:0xC0] = len(CLASSES)
    return out


BYTE_CLASS = class_of_byte()


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if OTHER_SPACES.search(text) else text.split()


def normal(word: str) -> str:
    plain = word.strip(MARKS).lower()
    return plain if len(plain) <= LONGEST else hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()


def class_counts(text: str) -> np.ndarray:
    return np.bincount(BYTE_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of three words which the text has twice or more."""
    n = len(words)
    number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    ids = np.array(list(map(number.__getitem__, words)), np.int64)
    m = len(number)
    if n < 4 or m == n:
        return 0
    pairs = ids[:-1] * m + ids[1:]
    if m >= 1 << 20:  # three numbers of 21 bits no longer fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


@dataclass(frozen=True)
class Reference:
    """Of one language: median share by class, its common words, their counts and that of all other words (the last)."""

    lang: str
    classes: np.ndarray
    words: dict[str, int]
    counts: np.ndarray


def corpus_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_bytes: int = 200) -> DataFrame:
    """lang, item, n over all of docs: n occurrences of a word, or n documents with a share of a character class, where
    item is a space, the class, a space and the share in thousandths. Both are counted within each task first; words
    beyond LONGEST code points are counted under their digest, documents under ``min_bytes`` have no share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[str, Counter] = defaultdict(Counter)
        shares: Counter[tuple[str, str]] = Counter()

        def flushed() -> pa.RecordBatch:
            normed: dict[tuple[str, str], int] = Counter()
            for lang, c in counts.items():
                for word, n in c.items():
                    normed[lang, normal(word)] += n
            normed.update(shares)
            counts.clear()
            shares.clear()
            return pa.RecordBatch.from_pydict({"lang": [k[0] for k in normed], "item": [k[1] for k in normed], "n": pa.array(normed.values(), pa.int64())}, schema=pa.schema({"lang": pa.string(), "item": pa.string(), "n": pa.int64()}))

        for batch in common.sliced(batches, text=0):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    counts[lang or ""].update(words_of(text))
                    if (total := (c := class_counts(text)).sum()) >= min_bytes:
                        shares.update([(lang or "", f" {name} {round(1000 * n / total)}") for name, n in zip(CLASSES, c.tolist(), strict=True)])
            if sum(map(len, counts.values())) > FLUSH:
                yield flushed()
        yield flushed()

    partial = docs.select(text_col, F.col(lang_col).cast("string")).mapInArrow(run, "lang string, item string, n long")
    return partial.groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _median(counted: list[tuple[int, int]]) -> int:
    """Of sorted (value, times), the lower one of an even number; 0 of none."""
    half = sum(n for _, n in counted) / 2
    for value, so_far in zip((v for v, _ in counted), itertools.accumulate(n for _, n in counted), strict=True):
        if so_far >= half:
            return value
    return 0


def language_references(docs: DataFrame, common_words: int = 50, least_share: float = 0.005, text_col: str = "text", lang_col: str = "lang") -> list[Reference]:
    """References of the languages with at least ``least_share`` of all words, so of 1 / least_share at most; the driver
    gets ``common_words`` rows and a thousand rows a character class for each of them at most."""
    counts = corpus_counts(docs, text_col, lang_col)
    is_class = F.col("item").startswith(" ")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    counts = common.written(counts, "word-counts")
    totals = common.written(counts.where(~is_class).groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    every = F.broadcast(totals.agg(F.sum("total").alias("all")))  # one row
    large = F.broadcast(totals.crossJoin(every).where(F.col("total") / F.col("all") >= least_share).select("lang", "total"))  # 1 / least_share rows at most
    counts = counts.join(large, "lang")
    listed = counts.where(~is_class & (F.col("item") != "")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= common_words)
    rows = listed.unionByName(counts.where(is_class).withColumn("rank", F.lit(0))).collect()
    out = []
    for lang in sorted({r["lang"] for r in rows}):
        mine = [r for r in rows if r["lang"] == lang]
        words = sorted((r for r in mine if r["rank"]), key=lambda r: r["rank"])
        shares = {c: sorted((int(r["item"].split()[1]), r["n"]) for r in mine if r["item"].startswith(f" {c} ")) for c in CLASSES}
        counted = [r["n"] for r in words]
        out.append(Reference(lang, np.array([_median(shares[c]) for c in CLASSES]), {r["item"]: i for i, r in enumerate(words)}, np.array([*counted, mine[0]["total"] - sum(counted)])))
    return out


def js_distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts to one reference; 1 if one of them is empty."""
    totals = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(totals, 1), reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, np.broadcast_to(q, p.shape)))
    return np.where((totals[:, 0] > 0) & (reference.sum() > 0), np.sqrt(np.maximum(parts / 2, 0)), 1.0)


class Nearest:
    """Finds the nearest language of many texts at once; keeps the number of each common word as it is written."""

    def __init__(self, references: list[Reference]) -> None:
        self.references = references
        common_words = sorted({w for r in references for w in r.words})
        number = {w: i for i, w in enumerate(common_words)}
        self.others = len(common_words)
        self.number = common.Kept(lambda word: number.get(normal(word), self.others), 100_000)
        self.columns = [np.array([number[w] for w in sorted(r.words, key=r.words.get)], np.int64) for r in references]

    def __call__(self, texts: list[str], words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By classes, by words, and the place of the language: the least sum of both, the first one of equals."""
        classes = np.stack([class_counts(t) for t in texts])
        seen = np.stack([np.bincount(np.array(list(map(self.number.__getitem__, w)), np.int64), minlength=self.others + 1) for w in words])
        pairs = []
        for r, columns in zip(self.references, self.columns, strict=True):
            mine = seen[:, columns]
            pairs.append((js_distances(classes, r.classes), js_distances(np.column_stack([mine, seen.sum(axis=1) - mine.sum(axis=1)]), r.counts)))
        by_class, by_word = (np.stack(d, axis=1) for d in zip(*pairs, strict=True))
        best = np.argmin(by_class + by_word, axis=1)
        rows = np.arange(len(texts))
        return by_class[rows, best], by_word[rows, best], best


def quality_rules(
    docs: DataFrame,
    references: list[Reference] | None = None,
    max_class_distance: float = 0.2,
    max_word_distance: float = 0.43,
    min_chars: int = 200,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, the counts of base_counts, base_failed, class_distance, word_distance, nearest, kept: a row per row.

    Null and empty texts have no words, so they fail. Documents under ``min_chars`` code points in words or
    ``min_words`` words, and documents of a language without a reference, aren't judged by their divergence. A null
    language is one of its own. Without any reference (an empty corpus) nothing diverges.
    """
    references = language_references(docs, text_col=text_col, lang_col=lang_col) if references is None else references
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, judged = Nearest(references) if references else None, {r.lang for r in references}
        for batch in common.sliced(batches, text=1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = list(map(words_of, texts))
            far = [(0.0, 0.0, None)] * len(texts)
            if nearest and texts:
                far = [(c, w, references[k].lang) if mine else (0.0, 0.0, None) for c, w, k, mine in zip(*(x.tolist() for x in nearest(texts, words)), words, strict=True)]
            out: list[tuple] = []
            for text, mine, (by_class, by_word, lang), own in zip(texts, words, far, batch.column(2).to_pylist(), strict=True):
                base = base_counts(text, mine)
                failed = base[0] < min_words or 100 * base[4] > max_repeat_percent * base[0]
                odd = (own or "") in judged and base[1] >= min_chars and base[0] >= min_words and (by_class > max_class_distance or by_word > max_word_distance)
                out.append((*base, failed, by_class, by_word, lang, not failed and not odd))
            columns = list(zip(*out, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names, "base_failed", "class_distance", "word_distance", "nearest", "kept"])

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType())]
        + [T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("nearest", T.StringType()), T.StructField("kept", T.BooleanType())]
    )
    return docs.select(id_col, text_col, F.col(lang_col).cast("string")).mapInArrow(run, schema)


def oracle_sql(max_class_distance: float = 0.2, max_word_distance: float = 0.43, min_chars: int = 200, min_words: int = 50, common_words: int = 50, least_share: float = 0.005) -> str:
    """What the rules say of the documents table, in SQL (of distinct doc_ids)."""
    marks = MARKS.replace("'", "''")
    one = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^ \t\n\v\f\r]", "sentence": "[^.,;:!?''\"()-]", "symbol": "[^#*$%&|<>]", "beyond": r"[\x00-\x7F]"}
    classes = ", ".join(f"length(regexp_replace(text, '{rx}', '', 'g')) AS c_{name}" for name, rx in one.items())
    spread = ", ".join(f"'{c}'" for c in CLASSES), ", ".join(f"c_{c}" for c in CLASSES)
    divergence_of = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
s AS (SELECT doc_id, lang, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS l FROM d),
tok AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM s),
tri AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY 1),
lin AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(l) AS x FROM s) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lin.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM s LEFT JOIN lin USING (doc_id) LEFT JOIN rep USING (doc_id)
),
cls AS (SELECT *, length(text) - c_lower - c_upper - c_digit - c_space - c_sentence - c_symbol - c_beyond AS c_other FROM (SELECT doc_id, lang, text, {classes} FROM d)),
cl AS (SELECT doc_id, lang, length(text) AS total, unnest([{spread[0]}]) AS item, unnest([{spread[1]}]) AS n FROM cls),
norm AS (SELECT doc_id, lang, CASE WHEN length(w) <= {LONGEST} THEN w ELSE sha256(w) END AS word FROM (SELECT doc_id, lang, lower(trim(word, '{marks}')) AS w FROM tok)),
cnt AS (SELECT lang, word, count(*) AS n FROM norm GROUP BY ALL),
tot AS (SELECT lang, sum(n) AS total FROM cnt GROUP BY lang QUALIFY sum(n) / sum(sum(n)) OVER () >= {least_share}),
top AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM cnt JOIN tot USING (lang) WHERE word <> '' QUALIFY rank <= {common_words}),
bins AS (SELECT lang, word, rank, n FROM top UNION ALL SELECT lang, NULL, {common_words + 1}, total - (SELECT sum(n) FROM top WHERE top.lang = tot.lang) FROM tot),
refw AS (SELECT lang, word, rank, n / sum(n) OVER (PARTITION BY lang) AS q FROM bins),
med AS (SELECT lang, item, quantile_disc(round_even(1000 * cl.n / cl.total, 0), 0.5) AS m FROM cl JOIN tot USING (lang) WHERE cl.total >= 200 GROUP BY ALL),
refc AS (SELECT lang, item, m / sum(m) OVER (PARTITION BY lang) AS q FROM med),
dc AS (SELECT doc_id, r.lang, {divergence_of} AS dist FROM (SELECT cl.doc_id, cl.item, n / total AS p FROM cl WHERE total > 0) c JOIN refc r USING (item) GROUP BY ALL),
dw AS (
  SELECT doc_id, lang, {divergence_of} AS dist FROM (
    SELECT b.doc_id, r.lang, q, CASE WHEN r.word IS NULL THEN (b.n_words - coalesce(k.n, 0)) / b.n_words ELSE coalesce(x.n, 0) / b.n_words END AS p
    FROM base b CROSS JOIN refw r LEFT JOIN (SELECT doc_id, word, count(*) AS n FROM norm GROUP BY ALL) x ON x.doc_id = b.doc_id AND x.word = r.word
    LEFT JOIN (SELECT doc_id, t.lang, count(*) AS n FROM norm JOIN top t USING (word) GROUP BY ALL) k ON k.doc_id = b.doc_id AND k.lang = r.lang WHERE b.n_words > 0
  ) GROUP BY ALL
),
near AS (SELECT doc_id, arg_min(dc.dist, (dc.dist + dw.dist, lang)) AS by_class, arg_min(dw.dist, (dc.dist + dw.dist, lang)) AS by_word FROM dc JOIN dw USING (doc_id, lang) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(lang IN (SELECT lang FROM tot) AND word_chars >= {min_chars} AND n_words >= {min_words} AND (by_class > {max_class_distance} OR by_word > {max_word_distance}), false) AS kept
FROM base JOIN d USING (doc_id) LEFT JOIN near USING (doc_id)
"""
