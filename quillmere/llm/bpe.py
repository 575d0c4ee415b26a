"""BPE encoding by backtracking over Aho-Corasick matches, and decoding through an offset table.

One pass of the automaton over a word gives every token that starts at each place. The encoder takes the longest one
that may stand next to the token before it, and steps back where none may; whether two tokens may stand side by side
is looked up in a pair table, whose entries are worked out from the merges when first asked for. A place that proved
impossible is never entered again, so a word costs time in proportion to its length, and the result is exactly that
of applying the merges in order. Words repeat, so each worker keeps the ids of the words it has seen, up to a bound.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillmere.llm.common import Kept, sliced

#: Stands for the end-of-word suffix as one character that no byte is mapped to.
END = "\x00"
#: Entries that a worker keeps in each of two fillings, of words and of white-space-parted chunks.
KEEP = 350_000
#: Characters that are one word together when they follow letters.
MARKS = ".,;:!?*$%&#|"
#: Separators that str.split takes for white space and the vocabulary's pattern doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


#: The file's pattern for lower-case Latin-1, with its letters and numbers written out.
LATIN1_WORDS = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: What a file must say to be read: the fast ways below are written for these rules.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def checked(spec: dict) -> dict:
    """The file's contents, if it is a byte-level BPE with an end-of-word suffix and the rules above; else an error."""
    model = spec["model"]
    wrong = [name for name, wanted in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER), ("post_processor", None), ("decoder", None)) if spec.get(name) != wanted]
    wrong += [name for name in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(name)]
    if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
        wrong.append("model")
    if wrong:
        raise ValueError(f"not a vocabulary of the known kind: {', '.join(wrong)}")
    return spec


class Vocabulary:
    """A vocabulary file of the tokenizers library: BPE over bytes with an end-of-word suffix, lower case. A file with
    other rules is refused."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        #: What the file says on normalising and parting words, for whatever isn't plain letters and marks.
        self.split = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()

        def marked(token: str) -> str:
            return token[: -len(suffix)] + END if token.endswith(suffix) else token

        #: Rank in which a token is made; single symbols are there from the start.
        self.rank: dict[str, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        merged = {a + b for a, b in merges}
        for token in self.ids:
            if token not in merged:
                self.rank[token] = len(self.rank)
        self.singles = len(self.rank)
        for a, b in merges:
            if a + b not in self.rank:
                self.rank[a + b] = len(self.rank)
            self.made.setdefault((self.rank[a], self.rank[b]), self.rank[a + b])
            self.parts.setdefault(self.rank[a + b], (self.rank[a], self.rank[b]))
        self.packed = {r: self.ids[t].to_bytes(4, "little") for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            m = marked(token)
            self.automaton.add_word(m, (r, len(m)))
        self.automaton.make_automaton()

        strings = {**{i: t for t, i in self.ids.items()}, **{i: t for t, i in self.special.items()}}
        pieces = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.words = Kept(self.word, KEEP)
        self.mapped_words = Kept(self.mapped_word, KEEP // 10)
        self.chunks = Kept(self.simple, KEEP // 10)

    def _beside(self, left: int, right: int) -> bool:
        """Whether no merge across the seam happens before both tokens are whole.

        At each step the token made later is opened at the seam: its part there existed first, and met the other side
        before the token was made. A merge of the two that comes earlier than what was opened would have won.
        """
        before = len(self.rank)
        while True:
            if self.made.get((left, right), before) < before:
                return False
            if left > right:  # a tie can't be: the left one of equal tokens is merged first
                if left in self.parts:
                    before, left = left, self.parts[left][1]
                elif right in self.parts:
                    before, right = right + 1, self.parts[right][0]
                else:
                    return True
            elif right in self.parts:
                before, right = right + 1, self.parts[right][0]
            elif left in self.parts:
                before, left = left, self.parts[left][1]
            else:
                return True

    def beside(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * KEEP:
                self.pairs.clear()
            known = self.pairs[key] = self._beside(left, right)
        return known

    def merge(self, word: str) -> list[int]:
        """Ranks of the tokens of one word in the byte alphabet, END at its end."""
        n, out, covered, known = len(word), [], 0, self.pairs
        for _, (token, length) in self.automaton.iter_long(word):  # the first try of each step, if no step goes back
            if out and not (known[key] if (key := out[-1] << 20 | token) in known else self.beside(out[-1], token)):
                break
            out.append(token)
            covered += length
        return out if covered == n else self.backtracked(word)

    def backtracked(self, word: str) -> list[int]:
        n, known = len(word), self.pairs
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            at[end + 1 - match[1]].append(match)  # shorter ones first: their ends come first
        out: list[int] = []
        back: list[tuple[int, int]] = []
        barred = bytearray(n + 1)
        place, choice = 0, len(at[0]) - 1
        while place < n:
            options = at[place]
            while choice >= 0:
                token, length = options[choice]
                if not barred[place + length] and (not out or (known[key] if (key := out[-1] << 20 | token) in known else self.beside(out[-1], token))):
                    break
                choice -= 1
            if choice >= 0:
                out.append(token)
                back.append((place, choice))
                place += length
                choice = len(at[place]) - 1 if place < n else 0
            else:
                barred[place] = 1
                out.pop()
                place, choice = back.pop()
                choice -= 1
        return out

    def mapped_word(self, word: str) -> bytes:
        return b"".join([self.packed[r] for r in self.merge(word + END)])

    def word(self, word: str) -> bytes:
        return self.mapped_word(word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()]))

    def simple(self, chunk: str) -> bytes:
        """A chunk of letters with marks behind them is one or two words; any other goes the general way."""
        letters = chunk.rstrip(MARKS)
        small = letters.replace("Σ", "σ").lower()
        if not small.isalpha() or not unicodedata.is_normalized("NFC", letters):
            return self.chunk(chunk)
        ids = self.words[small]
        return ids + self.words[chunk[len(letters) :]] if len(letters) < len(chunk) else ids

    def chunk(self, text: str) -> bytes:
        """Ids of any text, as little-endian unsigned 32-bit integers."""
        out, place = [], 0
        for m in [*self.special_pattern.finditer(text), None] if "<|" in text else [None]:
            plain = self.split.normalizer.normalize_str(text[place : m.start() if m else len(text)])
            out += [self.mapped_words[w] for w, _ in self.split.pre_tokenizer.pre_tokenize_str(plain)]
            if m:
                out.append(self.special[m[0]].to_bytes(4, "little"))
                place = m.end()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """White space is dropped and never inside a token, so a text is the chunks between it."""
        if any(c in text for c in ODD_SPACES):
            return self.chunk(text)
        if "<|" not in text and latin1(text):  # in NFC, and lower case letter by letter
            return b"".join(map(self.words.__getitem__, LATIN1_WORDS.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings parted by one space, in UTF-8: the file names no decoder."""
        at = np.frombuffer(ids, "<u4")
        if not len(at):
            return b""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        where = np.repeat(self.offsets[at] - (ends - lengths), lengths)
        where += np.arange(ends[-1])
        return self.bytes[where[:-1]].tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


MAKES = {
    "n_tokens": T.LongType(),
    "ids": T.BinaryType(),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def bpe_encode(docs: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id column and the asked columns of MAKES. Nothing is shuffled.

    ids are little-endian unsigned 32-bit integers. Null texts are empty ones and have no tokens; null or repeated ids
    are passed on; texts are taken whole, a row at a time, so memory follows the longest text; other columns of docs
    are not read.
    """
    path = path or default_path()
    kind = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in sliced(batches, text=1):
            made: dict[str, list] = {c: [] for c in columns}
            for text in batch.column(1).to_pylist():
                ids = v.encode(text or "")
                decoded = v.decode(ids) if {"decoded", "decoded_sha256"} & {*columns} else b""
                for c in columns:
                    made[c].append(
                        len(ids) // 4 if c == "n_tokens" else ids if c == "ids" else hashlib.sha256(ids).hexdigest() if c == "ids_sha256" else decoded.decode() if c == "decoded" else hashlib.sha256(decoded).hexdigest()
                    )
            kinds = {"n_tokens": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[c], kinds.get(c, pa.string())) for c in columns)], names=["doc_id", *columns])

    schema = T.StructType([T.StructField("doc_id", kind.dataType), *(T.StructField(c, MAKES[c]) for c in columns)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of packed ids; null ids give the empty text, an id outside the vocabulary raises."""
    path = path or default_path()
    kind = encoded.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode(x or b"").decode() for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, T.StructType([T.StructField("doc_id", kind.dataType), T.StructField("text", T.StringType())]))
