"""Token counts and packing against the library and the packing's own rules."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from presslens.llm import packing, tokens
from tests.llm.conftest import messy_rows

PATH = tokens.vocabulary()
PIECES = [
    "a", "b", "'s", "'", "'re", " ", "\n", "\t", "1", "²", "é", "É", "İ", "ß", "Ⱥ", "ŉ", "ǆ", "Σ", "ς", "ﬁ", "日本", "😀", "\x1c", "\x85", "\xa0",
    " ", "’", "…", "—", "€", "<|endoftext|>", "<|", "|>", "<|startoftext|>", "!!", "THE", "ing", "tion", "%", "_", "-", ".", "x" * 9,
    "̀", " ", "\xad", "​", "ª", "½", "K", "Å",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(3)
    out = ["".join(r.choice(PIECES) for _ in range(r.randrange(30))) for _ in range(1500)]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x250)])) for _ in range(40)) for _ in range(500)]
    out += [chr(c) + "a" + chr(c) for c in range(0x250)] + ["a" + chr(c) for c in range(0x2000, 0x2100)]
    return [*out, "ab" * 40_000, "x" * 70_000 + " y " * 30_000, " " * 70_000, ""]


def test_counts_and_ids_are_the_library_s(library):
    counter, encoder = tokens.Counter(PATH), tokens.Ids(PATH)
    all_texts = texts()
    for text, ids in zip(all_texts, encoder.ids(all_texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(want), text[:80]
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]


def test_chunk_maps_compose(library):
    counter = tokens.Counter(PATH)
    for text in texts()[:300]:
        low = text.lower()
        if not tokens.OTHER.search(low):
            assert {counter.scanned(low, size) for size in (1, 2, 5, 17, 10_000)} == {counter.scanned(low)}


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter, encoder = tokens.Counter(PATH), tokens.Ids(PATH)
    for text in ("one two three four five", "six seven one", "two"):
        assert counter.count(text) * 4 == len(encoder.ids([text])[0])


def test_query_rows(spark, messy, nothing, library):
    rows = tokens.with_counts(messy, PATH).collect()
    want = Counter()
    for row in messy_rows():
        text = row[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want[row[0], len(text.encode()), n, n > 2048] += 1
    assert Counter(map(tuple, rows)) == want
    assert tokens.with_counts(nothing, PATH).collect() == []


def bins_of(places):
    bins, ranks = defaultdict(list), defaultdict(set)
    for p in places:
        for rank in range(p.first_rank, p.last_rank + 1):
            step = rank - p.first_rank
            bins[p.first_bin + step % p.bins].append((p.fill + step // p.bins * p.length, p.length))
            assert rank not in ranks[p.length]
            ranks[p.length].add(rank)
    return bins, {size: len(r) for size, r in ranks.items()}


def best_possible(items, capacity):
    """Fewest bins, by trying everything."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= items[i]}.values()):
            go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plans_hold_all_items_without_gaps(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 30, 100])
    counts = Counter(r.randint(1, capacity) for _ in range(r.randrange(80)))
    bins, got = bins_of(packing.packed_counts(counts, capacity))
    assert got == counts
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(r.randrange(1, 10))]
    plan = packing.Plan(Counter(items), 20)
    plan.reduce()
    rest = [size for size, n in plan.left.items() for _ in range(n)]
    assert plan.bins + best_possible(rest, 20) == best_possible(items, 20)


def test_packed_documents(spark, messy, nothing, library):
    rows = packing.pack(messy, PATH, capacity=256).collect()
    want = Counter()
    for row in messy_rows():
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            part = ids[k:k + 256]
            want[row[0], k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(nothing, PATH).collect() == []


def test_a_distinct_word_is_encoded_once_in_few_calls(monkeypatch):
    encoder = tokens.Ids(PATH)
    handed, encoded = [], encoder.encoded
    monkeypatch.setattr(encoder, "encoded", lambda texts: handed.extend(texts) or encoded(texts))
    texts = [" ".join(f"word{chr(97 + i % 26)}{end}" for i in range(26 * k)) for k in (1, 5) for end in ("", ".", "!!", "'s")]
    got = encoder.ids(texts)
    assert len(handed) <= 2 and sum(map(len, handed)) < 400
    assert got == encoded(texts)


def test_remembered_words_equal_the_library():
    import random

    r, encoder = random.Random(3), tokens.Ids(PATH)
    strings = {"".join(r.choice(tokens._PLAIN) if r.random() < 0.4 else r.choice("ab'stmdlrev01!.,-_") for _ in range(r.randrange(1, 14))) for _ in range(5000)}
    texts = [*strings, *(f"{c} {c}'{c}" for c in tokens._PLAIN)]
    assert encoder.ids(texts) == encoder.encoded(texts)
