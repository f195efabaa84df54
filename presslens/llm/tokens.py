"""Token counts by a compiled transducer, and token ids by the library.

The tokenizer drops white space and never joins text across it, so a text is a
sequence of blank-free strings. Its merges are compiled, step by step as symbols
occur, into a deterministic transducer over bytes (the last byte of a word is a
symbol of its own): every transition carries the change of the number of tokens of
the word so far. A state holds what later symbols can still reach: the longest
suffix that some token continues, and for each place in it the token that ends
there and the count up to there. The token that ends a prefix is the only one whose
merge with its predecessor the merge list undoes to the same two tokens.

A text is cut into chunks. White space resets the state, so a chunk holds no state map
but three parts: the text before its first blank, the tokens between, the text after
its last blank. Composing joins edge texts, pair by pair in one row's call, not in
parallel; a text without blanks is run as one string. Texts with characters outside ``_PLAIN`` are
not chunked: the library cuts them into words.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import table, text_batches

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 1 << 16
#: Entries of a worker's memory of words; it starts anew beyond that.
REMEMBERED = 600_000
#: New words that are joined for one call of the library.
JOINED = 2048
END = 256
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")


def _ranges(chars: Iterable[str]) -> str:
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _plain(c: str) -> bool:
    """Characters that normalise to their lower case alone, wherever they stand."""
    return c not in "\x1c\x1d\x1e\x1f" and all(x <= "ɏ" or x == "̇" or x == c for x in c.lower())


_PLAIN = [c for c in map(chr, [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]) if _plain(c)]
_LETTERS = _ranges(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_DIGITS = _ranges(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_BLANKS = r"\t\n\x0b\x0c\r \x85\xa0"
OTHER = re.compile(rf"[^{_ranges(_PLAIN)}]|<\|")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")


def byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: themselves where
    they print, else counted on from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts of word tokens; see the module's text. Grows by the symbols it meets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, names = model["end_of_word_suffix"], byte_names()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            body = "".join(chr(names[c]) for c in (token.removesuffix(suffix) if ends else token))
            return body[:-1] + chr(ord(body[-1]) + END) if ends else body

        self.names = str.maketrans({c: chr(b) for c, b in names.items()})
        self.tokens = {symbols(t) for t in model["vocab"]}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.begun = {t[:i] for t in self.tokens for i in range(len(t))}
        self.reset()

    def reset(self) -> None:
        self.states = [("", (None,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict] = [{}]
        self.pairs: dict = {}
        self.words: dict[str, int] = {}

    def merged(self, symbols: str) -> list[str]:
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, before: str | None, token: str) -> bool:
        """Whether ``token`` stays a token of its own after ``before`` (or at the start)."""
        key = before, token
        if key not in self.pairs:
            self.pairs[key] = self.merged((before or "") + token) == ([token] if before is None else [before, token])
        return self.pairs[key]

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        """Compile one transition: the next state and the tokens it adds."""
        suffix, ending, counts = self.states[state]
        grown = suffix + symbol
        at = next(i for i in range(len(grown)) if grown[i:] in self.tokens and self.follows(ending[i], grown[i:]))
        added = counts[at] + 1
        keep = next(i for i in range(len(grown) + 1) if grown[i:] in self.begun)
        after = (grown[keep:], (*ending, grown[at:])[keep:], (*(c - added for c in counts), 0)[keep:])
        number = self.numbers.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
            self.moves.append({})
        self.moves[state][symbol] = number, added
        return number, added

    def run(self, word: str) -> int:
        """Tokens of one word, given by its bytes as characters."""
        state = total = 0
        for symbol in chain(word[:-1], (chr(ord(word[-1]) + END),)):
            step = self.moves[state].get(symbol) or self.move(state, symbol)
            state = step[0]
            total += step[1]
        return total

    def plain(self, string: str) -> int:
        """Tokens of a blank-free, lower-case string of plain characters."""
        known = self.words.get(string)
        if known is None:
            known = sum(self.run(w.encode().decode("latin-1")) for w in PIECE.findall(string))
            if len(string) <= 64:
                self.words[string] = known
        return known


class Chunk(NamedTuple):
    """A chunk's map; without a blank inside, ``tail`` is None and all is ``head``."""

    head: str
    tokens: int
    tail: str | None


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.transducer = Transducer(path)
        self.library = Tokenizer.from_file(path)

    def chunk(self, text: str) -> Chunk:
        words = text.split()
        if len(words) == 1 and len(words[0]) == len(text):
            return Chunk(text, 0, None)
        if not words:
            return Chunk("", 0, "" if text else None)
        head = "" if text[0].isspace() else words.pop(0)
        tail = "" if text[-1].isspace() else words.pop()
        known = self.transducer.words
        try:
            return Chunk(head, sum(map(known.__getitem__, words)), tail)
        except KeyError:
            return Chunk(head, sum(map(self.transducer.plain, words)), tail)

    def composed(self, a: Chunk, b: Chunk) -> Chunk:
        if a.tail is None:
            return Chunk(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return Chunk(a.head, a.tokens, a.tail + b.head)
        return Chunk(a.head, a.tokens + b.tokens + self.transducer.plain(a.tail + b.head), b.tail)

    def scanned(self, text: str, size: int = CHUNK) -> int:
        maps = [self.chunk(text[i:i + size]) for i in range(0, len(text), size)] or [Chunk("", 0, None)]
        while len(maps) > 1:
            pairs = [self.composed(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[2 * len(pairs):]
        return self.transducer.plain(maps[0].head) + maps[0].tokens + self.transducer.plain(maps[0].tail or "")

    def count(self, text: str) -> int:
        if len(self.transducer.words) > REMEMBERED or len(self.transducer.states) > REMEMBERED:
            self.transducer.reset()
        if not OTHER.search(text):
            return self.scanned(text.lower())
        total = 0
        for i, part in enumerate(SPECIAL.split(text)):
            if i % 2:
                total += 1
            elif not OTHER.search(part.replace("<|", "<")):
                total += self.scanned(part.lower())
            else:  # the library's own normal form and word cut
                part = self.library.normalizer.normalize_str(part)
                total += sum(self.transducer.run(w.translate(self.transducer.names)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part) if w)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Ids:
    """Token ids of whole texts as little-endian bytes, each distinct word encoded once.

    New words are joined by blanks for the library, many to a call. A word's last token,
    and no other, is one that ends words; it tells a word's tokens from the next one's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, strings: list[str]) -> None:
        """Remember the ids of blank-free, lower-case strings of plain characters."""
        pieces = [[s] if s.isalpha() else PIECE.findall(s) for s in strings]
        new = list(set(chain.from_iterable(pieces)).difference(self.known))
        for i in range(0, len(new), JOINED):
            words = new[i:i + JOINED]
            data, = self.encoded([" ".join(words)])
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 4).tolist()
            self.known.update(zip(words, (data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        self.known.update((s, b"".join(map(self.known.__getitem__, p))) for s, p in zip(strings, pieces, strict=True) if len(p) > 1)

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [None if OTHER.search(t) else t.lower().split() for t in texts]
        self.learn(list(set(chain.from_iterable(w for w in words if w)).difference(self.known)))
        rest = iter(self.encoded([t for t, w in zip(texts, words, strict=True) if w is None]))
        return [next(rest) if w is None else b"".join(map(self.known.__getitem__, w)) for w in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> Ids:
    return Ids(path)


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of each whole text as the library counts them, without special tokens
    added; null is empty. ``path`` names a vocabulary file on every node."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = counter(path).count
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return counted(text)


def with_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``docs`` (``doc_id, text``) to ``doc_id, n_bytes, n_tokens, over_limit``.

    Null and empty texts: 0 bytes, 0 tokens. Null ids and repeated rows are kept as
    they are; an empty table gives no rows; other columns are not read. Special
    strings inside a text count as the one token that the library makes of them.
    """
    text_batches(docs.sparkSession)
    counted = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(F.col("text"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return with_counts(table(spark, sf_dir, "documents"), vocabulary())
