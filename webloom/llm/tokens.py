"""Token ids of documents with byte-level BPE vocabularies, as fast as the workers can make them."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Runs of this many characters without white space go to the slower library, whose merging is not quadratic in the run.
LONG_RUN = 1000

#: Fixed value: the published split pattern of this family of vocabularies, without its look-ahead for runs of white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def _printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where that is printable, else as the next free character from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def id_type(size: int) -> np.dtype:
    """How ids of a vocabulary of that size are stored."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


class Encoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False`` for the file at ``path``.

    Where the file is a plain byte-level BPE whose merges make ids in order, a text without double white space, special strings
    or very long runs is encoded by ``tiktoken`` over the same vocabulary, with a pattern that needs no look-ahead (its only use
    is inside runs of two and more white-space characters). All other texts go to ``tokenizers`` itself."""

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.dtype = id_type(self.slow.get_vocab_size(with_added_tokens=True))
        self.doubles = re.compile(r"\s\s")
        self.fast = None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [vocab.get("".join(p), -1) for p in pairs]
        if made and made == sorted(set(made)) and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer"):
            import tiktoken

            code = _printable_bytes()
            kept = set(self.special)
            ranks = {bytes(code[c] for c in t): i for t, i in vocab.items() if t not in kept}
            self.fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if (
            self.fast is None
            or self.doubles.search(text)
            or any(s in text for s in self.special)
            or (len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN)
        ):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.dtype)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(path)


def stored_type(path: str) -> np.dtype:
    """How ids of the vocabulary at ``path`` are stored."""
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True))


#: Characters whose lower-casing, composition and class (letter, digit, blank, sign) are beyond doubt in every library: printable ASCII, line feed and tab, Latin letters
#: with marks, Greek without capital sigma, Cyrillic, and common punctuation. Texts with others go to ``tokenizers`` itself.
SAFE_LETTERS = "À-ÖØ-öø-įĲ-ňŊ-žА-шы-я"
SAFE_TEXT = rf"[\n\t\x20-\x7e{SAFE_LETTERS}‐-‟…]*"

#: Fixed value: the published split pattern of this family of vocabularies (it drops what it does not match), over safe lower-case characters.
WORD_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{SAFE_LETTERS}]+|[0-9]|[^\s0-9a-z{SAFE_LETTERS}]+"

#: Words that a worker keeps with their ids, and the longest word that the fast way takes.
KEPT_WORDS, LONGEST_WORD = 250_000, 200


def _word_byte(token: str, code: dict[str, int]) -> bytes | None:
    """A token of letters as bytes in which the last byte of a word has a value of its own: capital A-Z stand for final a-z, 0x00-0x3F for final 0x80-0xBF (of the bytes of
    letters beyond ASCII). None for tokens of other bytes."""
    final = token.endswith("</w>")
    raw = [code[c] for c in token.removesuffix("</w>")]
    if not all(97 <= b <= 122 or b >= 128 for b in raw):
        return None
    if final:
        if not raw or raw[-1] > 0xBF:
            return None
        raw[-1] -= 32 if raw[-1] < 128 else 128
    return bytes(raw)


class WordEncoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False`` for a vocabulary of words with an end mark, that lower-cases and drops white space.

    Words are split by the vocabulary's own pattern, and words seen before are looked up. New words of letters are merged by ``tiktoken`` over the same merges, in an alphabet
    where a word's last byte has a value of its own; other new words, and whole texts with characters outside SAFE_TEXT or special strings, go to ``tokenizers``."""

    def __init__(self, path: str) -> None:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.dtype = id_type(self.slow.get_vocab_size(with_added_tokens=True))
        code, kept = _printable_bytes(), set(self.special)
        ranks: dict[bytes, int] = {}
        for token, number in vocab.items():
            word = None if token in kept else _word_byte(token, code)
            if word is not None:
                ranks[word] = number
        spare = 1 << 20  # the merger wants every byte to have a rank; these never occur in a word
        for b in range(256):
            ranks.setdefault(bytes([b]), spare + b)
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.final = bytes((b - 32 if 97 <= b <= 122 else b - 128 if 128 <= b <= 0xBF else b) for b in range(256))
        self.safe, self.split, self.letters = re.compile(SAFE_TEXT), re.compile(WORD_SPLIT), re.compile(rf"[a-z{SAFE_LETTERS}]+")
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        if len(word) <= LONGEST_WORD and self.letters.fullmatch(word):
            raw = word.encode()
            ids = self.merge(raw[:-1] + self.final[raw[-1] : raw[-1] + 1])
        else:
            ids = self.slow.encode(word, add_special_tokens=False).ids
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        self.known[word] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if not self.safe.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.dtype)
        out: list[int] = []
        known, word = self.known, self.word
        for w in self.split.findall(text.lower()):
            ids = known.get(w)
            out += ids if ids is not None else word(w)
        return np.array(out, self.dtype)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder of words a worker and file."""
    return WordEncoder(path)
