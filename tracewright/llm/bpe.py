"""BPE encoding and decoding by forced boundaries.

A merge can only make a token of the vocabulary, so a byte pair that occurs inside no token can never
end up inside one: it is a certain cut.  ``Encoder`` reads these pairs from the vocabulary file.  White
space occurs in no token beside another byte, so texts are first cut at ASCII white space; each fragment is
then cut again at the other forbidden pairs, its pieces are merged independently, and the ids are
concatenated.  Fragments repeat, so their ids are kept in a bounded memo.  An encoder lives as long as its task,
for workers outlive theirs and would carry it through whatever comes next.

Defined results: a null text is an empty one and has no ids; ids of equal texts are equal.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .common import in_arrow

#: Texts that are their own normal form once in lower case, and the pre-tokenizer's pattern for them.
LATIN = re.compile(r"[!-~\xa1-\xff]+")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


#: Characters of text that are encoded together.
CHUNK = 1 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as they are and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """``encode`` gives (ids, tokens) of a text, equal to the tokenizer's own on every text."""

    def __init__(self, path: str, memo: int = 120_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.inner = models.BPE(vocab=vocabulary, merges=merges)
        self.final = models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.letters = _byte_letters()
        letters = {c: b for b, c in self.letters.items()}
        self.inside = np.zeros((256, 256), bool)
        for token in vocabulary:
            raw = [letters[c] for c in token.removesuffix(self.suffix) if c in letters]
            for a, b in zip(raw, raw[1:]):
                self.inside[a, b] = True
        white = [9, 10, 11, 12, 13, 32]
        if self.inside[white, :].any() or self.inside[:, white].any():
            raise ValueError("tokens of this vocabulary hold white space; cuts there aren't certain")
        self.codes = np.zeros(max(map(ord, letters)) + 1, np.uint8)
        self.codes[[*map(ord, letters)]] = [*letters.values()]
        self.fragments: dict[bytes, tuple[str, str, int]] = {}
        self.words: dict[str, tuple[str, str, int]] = {}
        self.most = memo

    def _merge(self, words: list[str]) -> None:
        """Remember ids and tokens of new pre-tokens: cut at forbidden pairs, merge each piece alone."""
        raw = self.codes[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(w) for w in words])
        cut = ~self.inside[raw[:-1], raw[1:]]
        cut[ends[:-1] - 1] = False
        at = np.flatnonzero(cut) + 1
        pieces: dict[int, list[int]] = {}
        for k, c in zip(np.searchsorted(ends, at, "right").tolist(), at.tolist()):
            pieces.setdefault(k, []).append(c - int(ends[k]))
        tokenize, inner = self.final.tokenize, self.inner.tokenize
        for k, word in enumerate(words):
            if k in pieces:
                found, a = [], 0
                for b in (len(word) + c for c in pieces[k]):
                    found += inner(word[a:b])
                    a = b
                found += tokenize(word[a:])
            else:
                found = tokenize(word)
            self.words[word] = " ".join([str(t.id) for t in found]), " ".join([t.value for t in found]), len(found)

    def _pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in byte letters.  Latin-1 needs no normal form, ASCII no byte letters."""
        if text.isascii() and text.isprintable():
            return LATIN_WORDS.findall(text.lower())
        if LATIN.fullmatch(text):
            return [w.encode().decode("latin-1").translate(self.letters) for w in LATIN_WORDS.findall(text.lower())]
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def learn(self, fragments: set[bytes]) -> None:
        """Encode new texts without ASCII white space."""
        split = {}
        for raw in fragments:
            text = raw.decode()
            if "<|" in text and any(s in text for s in self.special):
                encoded = self.tokenizer.encode(text, add_special_tokens=False)
                self.fragments[raw] = " ".join(map(str, encoded.ids)), " ".join(encoded.tokens), len(encoded.ids)
            else:
                split[raw] = self._pre_tokens(text)
        if new := [*{w for found in split.values() for w in found} - self.words.keys()]:
            self._merge(new)
        words = self.words
        for raw, found in split.items():
            if len(found) == 1:
                self.fragments[raw] = words[found[0]]
            else:
                parts = [words[w] for w in found]
                self.fragments[raw] = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts])

    def encode_joined(self, texts: list[str | None]) -> list[tuple[str, str, int]]:
        """Of each text: decimal ids joined by spaces, the decoded text, and the number of ids."""
        # bytes.split cuts at ASCII white space only; other white space is left to the pre-tokenizer
        names = [(t or "").encode().split() for t in texts]
        if len(self.fragments) > self.most:
            self.fragments.clear()
        if len(self.words) > self.most:
            self.words.clear()
        if new := {n for own in names for n in own} - self.fragments.keys():
            self.learn(new)
        get, out = self.fragments.__getitem__, []
        for own in names:
            parts = [p for p in map(get, own) if p[2]]
            ids, tokens, n = zip(*parts) if parts else ((), (), ())
            out.append((" ".join(ids), " ".join(tokens), sum(n)))
        return out

    def encode_all(self, texts: list[str | None]):
        """As ``encode_joined``, a bounded amount of text at a time."""
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text or "")
            if size >= CHUNK:
                yield from self.encode_joined(part)
                part, size = [], 0
        yield from self.encode_joined(part)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_joined([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer without a decoder does: the tokens joined by spaces."""
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def bpe_digests(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""

    def run(batches):
        bpe = None
        for batch in batches:
            bpe = bpe or Encoder(path)
            n, ids, decoded = [], [], []
            for a, b, k in bpe.encode_all(batch.column(1).to_pylist()):
                n.append(k)
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                decoded.append(hashlib.sha256(b.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and its token ids as an array."""

    def run(batches):
        bpe = None
        for batch in batches:
            bpe = bpe or Encoder(path)
            ids = [[*map(int, a.split())] for a, _, _ in bpe.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_arrow(rows, run, "doc_id long, ids array<int>")
