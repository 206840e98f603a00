"""BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of a prefix decides its whole encoding: a prefix ends in the one token whose merge with the last token of
the shorter prefix before it could not have happened earlier.  The distinct words of a portion are walked in sorted order,
which is the depth-first order of their trie; each step goes back to the prefix shared with the word before and extends
the last-token states from there, so the encoding of a shared prefix is computed once.  No data is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

#: Letters, digits and white space among the characters of PLAIN, on which Unicode tables of all ages agree.
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \xa0"
#: How a text is split before the merges: the split of byte-level BPE vocabularies, with the classes written out.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Texts of these characters only are split here, all others by the library's own pre-tokenizer.
PLAIN = re.compile(r"[\x00-\x1B\x20-\x84\x86-ɏ‐-‧₠-₿]*")
#: Pairs of tokens that a Python worker keeps at hand; all are looked up anew beyond.
MOST_FITS = 250_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable in Latin-1, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return out


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file whose model is byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} holds no byte-level BPE")
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        raw = {t: bytes(to_byte[c] for c in t) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        #: finds the tokens that end at each byte of a word, the longest first
        self.matcher = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.matcher.add_word(token.decode("latin-1"), (len(token), i))
        self.matcher.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = model["vocab"][a], model["vocab"][b]
            self.rank[left, right] = rank
            self.parts.setdefault(model["vocab"][a + b], (left, right))
        self.rank_of = {t: self.rank[p] for t, p in self.parts.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.path, self._library = path, None
        self._fits: dict[int, bool] = {}

    def library_split(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        return SPLIT.findall(text) if PLAIN.fullmatch(text) else self.library_split(text)

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joint text is encoded.

        The parts that face each other at the seam are unfolded, the later merge first; a merge across the seam must not
        come before the merge that made the part it would need.
        """
        a, b, limit, apart = left, right, len(self.rank), True
        while True:
            across = self.rank.get((a, b), limit)
            if across < limit:
                apart = False
                break
            ra, rb = self.rank_of.get(a, -1), self.rank_of.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # the later merge at the seam is undone; of equal ranks the left one came first, and a merge across the seam
            # lies to the right of the left token's and to the left of the right token's
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        if len(self._fits) > MOST_FITS:
            self._fits.clear()
        self._fits[left << 32 | right] = apart
        return apart

    def encode_sorted(self, words: list[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """Encodings of distinct words in sorted order: a depth-first walk over their trie."""
        matches, known, fits = self.matcher.iter, self._fits.get, self.fits
        last: list[int] = [-1]  # last token of each prefix of the word before
        size: list[int] = [0]
        before = b""
        for word in words:
            n = min(len(word), len(before))
            shared = n
            if word[:n] != before[:n]:
                low, high = 0, n
                while low < high:  # longest common prefix
                    half = (low + high + 1) // 2
                    low, high = (half, high) if word[:half] == before[:half] else (low, half - 1)
                shared = low
            del last[shared + 1 :], size[shared + 1 :]
            done = shared
            for at, (n, token) in matches(word.decode("latin-1")):
                if at >= done:
                    left = last[at + 1 - n]
                    fit = left < 0 or known(left << 32 | token)
                    if fit is None:
                        fit = fits(left, token)
                    if fit:
                        last.append(token)
                        size.append(n)
                        done = at + 1
            if done < len(word):
                raise ValueError(f"no token ends {word[: done + 1]!r}")
            before = word
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= size[end]
            yield word, tuple(out[::-1])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker and file."""
    return Vocabulary(path)


class Encoder:
    """Encodes portions of texts; keeps the words of the latest portions, up to ``most_words``."""

    def __init__(self, vocab: Vocabulary, most_words: int = 300_000):
        self.vocab, self.most_words, self.known = vocab, most_words, {}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        vocab, known = self.vocab, self.known
        split: list[list[str | int]] = []
        for text in texts:
            if vocab.added_pattern and any(t in text for t in vocab.added):
                parts: list[str | int] = []
                at = 0
                for m in vocab.added_pattern.finditer(text):
                    parts += vocab.words(text[at : m.start()])
                    parts.append(vocab.added[m.group()])
                    at = m.end()
                split.append(parts + vocab.words(text[at:]))
            else:
                split.append(vocab.words(text))
        if len(known) > self.most_words:
            known.clear()
        fresh = {w for own in split for w in own if w not in known and isinstance(w, str)}
        for word, ids in vocab.encode_sorted(sorted(w.encode() for w in fresh)):
            known[word.decode()] = ids
        out = []
        for own in split:
            ids: list[int] = []
            for w in own:
                if isinstance(w, int):
                    ids.append(w)
                else:
                    ids += known[w]
            out.append(ids)
        return out


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary(path))
    for rows in pieces(batches, 2_000_000):
        ids = encoder([t or "" for t in rows["text"]])
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: each row's whole text as the tokenizers library encodes it without special tokens around it.

    ``path`` is a file that every executor can read.  An added token that occurs in a text gets its own id, as there.
    Null and empty texts have no ids; null ids, repeated rows and further columns are of no effect.
    """
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _encode(it, path), "doc_id bigint, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(vocab, ids or []) for ids in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give an empty text, an unknown id fails the query."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, path), "doc_id bigint, text string")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    encoder = Encoder(vocab)
    number = {i: str(i) for i in vocab.bytes}
    for rows in pieces(batches, 2_000_000):
        ids = encoder([t or "" for t in rows["text"]])
        sha = [hashlib.sha256(",".join(map(number.__getitem__, x)).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(decode(vocab, x).encode()).hexdigest() for x in ids]
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digest(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of :func:`encode` and of the text decoded from its ids."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _digest(it, path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
