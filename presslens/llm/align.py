"""Cross-tokenizer alignment: which tokens of one vocabulary cover which of another.

Each text is encoded by two tokenizers, A (byte-level BPE, on blank + text) and B
(sentencepiece BPE, which adds the blank itself). Byte offsets where an A token and
a B token both end cut the text into groups; links are the A-B token pairs whose
byte ranges overlap. Corpus-wide, an id pair's count is the number of its links.

Method, identity-map fast path: most groups are one A token and one B token of the
same bytes. An array from A id to the B id of the same bytes is built once from the
two vocabularies; such a group's link is then known from its A id alone and counted
in a vector of A's vocabulary length in each task. Only the links of other groups
(irregular ones) are rows that are shuffled by id pair. The vectors and the counts
per B id that decide which links are best are bounded by the vocabularies' sizes.

No token of A or B goes past a blank that stands between two characters that are not
white space, so a text is cut there into units, each with the blank before it, and a
group never crosses a cut. A worker encodes and aligns each distinct unit once and
remembers it; a text's groups and links are those of its units in order.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import arrow_rows, table
from presslens.session import written

#: Vocabularies: A, byte-level BPE; B, sentencepiece BPE with byte fallback.
A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Texts are handed to the tokenizers in runs of about this many bytes (a longer
#: text is a run of its own), and to Python in Arrow batches of this many rows.
RUN_BYTES = 1 << 20
BATCH_ROWS = 256
#: Units and their characters that a worker remembers; it starts anew beyond that.
REMEMBERED = 400_000
REMEMBERED_CHARS = 16_000_000
#: New units are joined to runs of about this many characters for the tokenizers.
JOINED_CHARS = 1 << 15
#: Blanks beside other white space, and the cuts of a text that has any.
UNEVEN = re.compile(r" \s|\s ")
CUT = re.compile(r"(?<=\S) (?=\S)")

IRREGULAR = "array<struct<a:int,b:int,n:long>>"
ENCODED = (
    f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    f" ident_a array<int>, ident_n array<long>, irregular {IRREGULAR}"
)


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_level_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE vocabularies (a rule)."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown, extra = {}, 0
    for b in range(256):
        if b in kept:
            shown[chr(b)] = b
        else:
            shown[chr(256 + extra)] = b
            extra += 1
    return shown


class Pair:
    """Both tokenizers, each id's bytes, and the A-to-B array of equal bytes."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_path(a_file))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(b_file))
        alphabet = _byte_level_alphabet()
        size_a = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b""] * size_a
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            if token in added or any(c not in alphabet for c in token):
                self.a_bytes[i] = token.encode()
            else:
                self.a_bytes[i] = bytes(alphabet[c] for c in token)
        size_b = self.b.get_piece_size()
        self.b_bytes = [b""] * size_b
        for i in range(size_b):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes[i] = bytes([int(piece[3:5], 16)])
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes[i] = b""
            else:
                self.b_bytes[i] = piece.replace("▁", " ").encode()
        #: Whether no token goes on with a blank after something that is not white space.
        self.cut_at_blanks = not any(re.search(r"\S ", x.decode(errors="replace")) for x in chain(self.a_bytes, self.b_bytes))
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        by_bytes: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            if x and (x not in by_bytes or not self.b.is_byte(i)):
                by_bytes[x] = i
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_flat = np.frombuffer(b"".join(self.a_bytes), np.uint8)
        self.b_flat = np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.a_start = np.cumsum(self.a_len) - self.a_len
        self.b_start = np.cumsum(self.b_len) - self.b_len

    @staticmethod
    def joined(ids: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
        """The bytes of a sequence of tokens, gathered at once."""
        lens = length[ids]
        at = np.arange(int(lens.sum())) + np.repeat(start[ids] - (np.cumsum(lens) - lens), lens)
        return flat[at].tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A and B ids of each text; None where a text has no tokens (see ``align``)."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        a_all = self.a.encode_batch_fast([" " + texts[i] for i in some], add_special_tokens=False)
        b_all = self.b.encode([texts[i] for i in some])
        for i, a, b in zip(some, a_all, b_all):
            want = (" " + texts[i]).encode()
            a_ids, b_ids = np.array(a.ids, np.int64), np.array(b, np.int64)
            if int(self.a_len[a_ids].sum()) != len(want) or int(self.b_len[b_ids].sum()) != len(want):
                continue
            if self.joined(a_ids, self.a_flat, self.a_start, self.a_len) != want or \
                    self.joined(b_ids, self.b_flat, self.b_start, self.b_len) != want:
                continue
            out[i] = (a_ids, b_ids)
        return out


@lru_cache(maxsize=2)
def pair(a_file: str = A_FILE, b_file: str = B_FILE) -> Pair:
    return Pair(a_file, b_file)


_DECIMAL = np.array([str(i) for i in range(1 << 17)], dtype=object)


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray,
                unit: np.ndarray | None = None) -> str:
    """``a1,a2|b1;a3|b2,b3``: each group's A ids, then its B ids, in order.

    Every group holds tokens of both; the text is built from whole arrays at once.
    With the ``unit`` of each group, a new one starts a line instead of a ``;``.
    """
    group = np.concatenate([a_group, b_group])
    side = np.concatenate([np.zeros(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side = np.concatenate([a_ids, b_ids])[order], group[order], side[order]
    if not len(ids):
        return ""
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_side = new_group | np.concatenate([[True], side[1:] != side[:-1]])
    marks = np.where(new_group, ";", np.where(new_side, "|", ",")).astype(object)
    if unit is not None:
        marks[np.concatenate([[True], unit[group[1:]] != unit[group[:-1]]])] = "\n"
    marks[0] = ""
    out = np.empty(2 * len(ids), object)
    out[0::2] = marks
    out[1::2] = _DECIMAL[ids] if ids.max() < len(_DECIMAL) else np.array([str(i) for i in ids.tolist()], object)
    return "".join(out.tolist())


class Aligned(NamedTuple):
    """Ends in bytes of tokens, groups and links, and what the links are."""

    a_end: np.ndarray
    b_end: np.ndarray
    cuts: np.ndarray
    ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    ident: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


def aligned(a_ids: np.ndarray, b_ids: np.ndarray, p: Pair) -> Aligned:
    """Two encodings of the same bytes side by side."""
    a_end, b_end = np.cumsum(p.a_len[a_ids]), np.cumsum(p.b_len[b_ids])
    # both are sorted and distinct (cumulative sums of positive lengths)
    at = np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)
    cuts = a_end[b_end[at] == a_end]
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    ends = np.sort(np.concatenate([a_end, b_end]), kind="mergesort")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
    link_a, link_b = a_ids[np.searchsorted(a_end, ends)], b_ids[np.searchsorted(b_end, ends)]
    n = len(cuts)
    single = (np.bincount(a_group, minlength=n) == 1) & (np.bincount(b_group, minlength=n) == 1)
    ident = single[np.searchsorted(cuts, ends)] & (p.same[link_a] == link_b)
    return Aligned(a_end, b_end, cuts, ends, link_a, link_b, ident, a_group, b_group)


def align(a_ids: np.ndarray, b_ids: np.ndarray, p: Pair) -> dict:
    """Groups and links of one text's two encodings (their bytes are equal)."""
    x = aligned(a_ids, b_ids, p)
    return {
        "n_groups": len(x.cuts), "n_links": len(x.ends), "text": groups_text(a_ids, b_ids, x.a_group, x.b_group),
        "ident": x.link_a[x.ident], "irregular": (x.link_a[~x.ident], x.link_b[~x.ident]),
    }


def units(text: str) -> list[str]:
    """``text`` cut at each blank between two characters that are not white space."""
    return CUT.split(text) if text[0] == " " or text[-1] == " " or UNEVEN.search(text) else text.split(" ")


def _gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` from ``starts`` on, of these lengths, one after another."""
    return flat[np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)]


#: A text's ``n_a, n_b, n_groups, n_links``, its digest, the A ids of its identity links
#: and how many each has, and the same of its other links as ``a << 32 | b``.
Row = tuple[list[int], str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NONE = np.zeros(0, np.int64)
NO_TOKENS: Row = [0, 0, 0, 0], "", _NONE, _NONE, _NONE, _NONE


class Units:
    """What a worker has encoded and aligned: counts, groups and links of each unit."""

    def __init__(self, p: Pair):
        self.p = p
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        #: Groups of a unit as text; None if its bytes are not given back.
        self.texts: list[str | None] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.ident, self.ident_n = _NONE, _NONE
        self.other, self.other_n = _NONE, _NONE

    def add(self, new: list[str], texts: list[str | None], counts, ident, ident_n, other, other_n) -> None:
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.texts += texts
        self.counts = np.concatenate([self.counts, counts])
        self.ident, self.ident_n = np.concatenate([self.ident, ident]), np.concatenate([self.ident_n, ident_n])
        self.other, self.other_n = np.concatenate([self.other, other]), np.concatenate([self.other_n, other_n])

    def learn(self, new: list[str], most: int = JOINED_CHARS) -> None:
        """Encode and align units that are not known, many in one call of a tokenizer.

        Those with white space at an end, as at the ends of a text, are encoded alone;
        so are those of a run whose bytes are not given back (``most`` is 0 then).
        """
        runs: list[list[str]] = []
        size = most
        for u in new:
            alone = not most or u[0].isspace() or u[-1].isspace()
            if alone or size + len(u) >= most:
                runs.append([])
                size = most if alone else 0
            runs[-1].append(u)
            size += len(u) + 1
        got = self.p.encode([" ".join(run) for run in runs])
        bad = [u for run, ids in zip(runs, got, strict=True) if ids is None for u in run]
        some = [(run, ids) for run, ids in zip(runs, got, strict=True) if ids is not None]
        if some:
            good = [u for run, _ in some for u in run]
            a_ids, b_ids = np.concatenate([ids[0] for _, ids in some]), np.concatenate([ids[1] for _, ids in some])
            x = aligned(a_ids, b_ids, self.p)
            n, end = len(good), np.cumsum([len(u.encode()) + 1 for u in good])
            if not np.isin(end, x.cuts).all():
                raise ValueError("a token crosses a blank between two words")
            unit = np.searchsorted(end, x.ends)
            per = [np.bincount(at, minlength=n) for at in (np.searchsorted(end, x.a_end), np.searchsorted(end, x.b_end),
                                                           np.searchsorted(end, x.cuts), unit)]
            self.add(
                good, groups_text(a_ids, b_ids, x.a_group, x.b_group, np.searchsorted(end, x.cuts)).split("\n"), np.stack(per, 1),
                x.link_a[x.ident], np.bincount(unit[x.ident], minlength=n),
                (x.link_a << 32 | x.link_b)[~x.ident], np.bincount(unit[~x.ident], minlength=n))
        if bad and most:
            self.learn(bad, 0)
        elif bad:
            none = np.zeros(len(bad), np.int64)
            self.add(bad, [None] * len(bad), np.zeros((len(bad), 4), np.int64), _NONE, none, _NONE, none)

    def whole(self, text: str) -> Row:
        """A text with a unit whose bytes are not given back, encoded as it is."""
        ids = self.p.encode([text])[0]
        if ids is None:
            return NO_TOKENS
        got = align(*ids, self.p)
        links = got["irregular"][0] << 32 | got["irregular"][1]
        return ([len(ids[0]), len(ids[1]), got["n_groups"], got["n_links"]], hashlib.sha256(got["text"].encode()).hexdigest(),
                *np.unique(got["ident"], return_counts=True), *np.unique(links, return_counts=True))

    def rows(self, texts: list[str | None]) -> list[Row]:
        """Counts, digests and links of texts; null, empty and unequal ones have no tokens."""
        if not self.p.cut_at_blanks:
            return [self.whole(t) if t else NO_TOKENS for t in texts]
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.reset()
        cut = [units(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        if new:
            self.learn(list(new))
        out: list[Row] = [NO_TOKENS] * len(texts)
        at, numbers, shas = [], [], []
        for i, words in enumerate(cut):
            if words:
                own = list(map(self.known.__getitem__, words))
                try:
                    shas.append(hashlib.sha256(";".join(map(self.texts.__getitem__, own)).encode()).hexdigest())
                except TypeError:  # a unit without text
                    out[i] = self.whole(texts[i])
                    continue
                at.append(i)
                numbers.append(own)
        if not at:
            return out
        m, flat = len(at), np.fromiter(chain.from_iterable(numbers), np.int64)
        owner = np.repeat(np.arange(m), [len(own) for own in numbers])
        counts = np.stack([np.bincount(owner, self.counts[flat, k], m).astype(np.int64) for k in range(4)], 1).tolist()
        links = []
        for values, lens in ((self.ident, self.ident_n), (self.other, self.other_n)):
            # numbers of distinct values, so that a text and a value are one sortable number
            known, value = np.unique(_gathered(values, (np.cumsum(lens) - lens)[flat], lens[flat]), return_inverse=True)
            width = max(len(known), 1)
            key, n = np.unique(np.repeat(owner, lens[flat]) * width + value, return_counts=True)
            ends = np.searchsorted(key // width, np.arange(1, m))
            links += [np.split(known[key % width] if len(known) else _NONE, ends), np.split(n, ends)]
        for i, *row in zip(at, counts, shas, *links, strict=True):
            out[i] = tuple(row)
        return out


@lru_cache(maxsize=2)
def remembered(a_file: str = A_FILE, b_file: str = B_FILE) -> Units:
    return Units(pair(a_file, b_file))


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``RUN_BYTES`` together, in order."""
    run, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if run and size + n > RUN_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list a row from numpy arrays, built from one flat array and its offsets."""
    sizes = np.array([len(v) for v in values], np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate(values) if len(values) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _encoded(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(a_file, b_file)
        for batch in batches:
            rows = [row for run in _runs(batch.column(2).to_pylist()) for row in known.rows(run)]
            counts = np.array([row[0] for row in rows], np.int64).reshape(-1, 4)
            shas, ident_a, ident_n, irregular, irr_n = ([row[k] for row in rows] for k in range(1, 6))
            sizes = np.array([len(v) for v in irr_n], np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            links = np.concatenate([_NONE, *irregular])
            links = pa.StructArray.from_arrays(
                [pa.array(links >> 32, pa.int32()), pa.array(links & 0xFFFFFFFF, pa.int32()),
                 pa.array(np.concatenate([_NONE, *irr_n]), pa.int64())], ["a", "b", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(counts[:, k]) for k in range(4)],
                 pa.array(shas, pa.string()), _lists(ident_a, pa.int32()), _lists(ident_n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, links)],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ident_a", "ident_n", "irregular"],
            )
    return run


def _vectors(a_file: str, b_file: str):
    """Identity links of a task summed in one vector of A's vocabulary length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_file, b_file)
        total = np.zeros(len(p.a_len), np.int64)
        for batch in batches:
            a = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            n = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(a):
                total += np.bincount(a, n, len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(p.same[some], pa.int32()), pa.array(total[some], pa.int64())], ["a", "b", "n"])
    return run


PASSED = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _identity_sums(a_file: str, b_file: str, ident_count: np.ndarray, best: np.ndarray):
    """Per row its columns, the count of its identity links summed, and how many are best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_file, b_file)
        for batch in batches:
            a_col, n_col = batch.column("ident_a"), batch.column("ident_n")
            a = a_col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = n_col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = a_col.offsets.to_numpy().astype(np.int64)
            c = ident_count[a]
            # exact whole numbers: running sums, differenced at each row's bounds
            summed = np.concatenate([[0], np.cumsum(c * n)])
            best_n = np.concatenate([[0], np.cumsum(n * (c == best[p.same[a]]))])
            sums, bests = summed[at[1:]] - summed[at[:-1]], best_n[at[1:]] - best_n[at[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in PASSED], pa.array(sums, pa.int64()), pa.array(bests, pa.int64())],
                [*PASSED, "id_sum", "id_best"])
    return run


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A null or empty text, or one whose joined A or B token bytes are
    not blank + text (B's normaliser may change it), has no tokens: zeros and ''.
    Special tokens' strings in a text are plain text. Repeated rows count each time
    corpus-wide. Other columns of ``docs`` are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    p = pair(a_file, b_file)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    with arrow_rows(spark, BATCH_ROWS):
        encoded = written(rows.mapInArrow(_encoded(a_file, b_file), ENCODED), "align-encoded")

    ident = encoded.select("ident_a", "ident_n").mapInArrow(_vectors(a_file, b_file), "a int, b int, n long")
    irregular = encoded.select(F.inline("irregular"))
    counts = written(
        ident.unionByName(irregular).groupBy("a", "b").agg(F.sum("n").alias("count")), "align-counts")
    best_rows = counts.groupBy("b").agg(F.max("count").alias("best")).collect()  # one row a B id at most
    same = spark.createDataFrame([(i, int(b)) for i, b in enumerate(p.same) if b >= 0], "a int, b int")
    ident_rows = counts.join(F.broadcast(same), ["a", "b"], "left_semi").collect()  # one row an A id at most
    best = np.zeros(len(p.b_len), np.int64)
    for r in best_rows:
        best[r["b"]] = r["best"]
    ident_count = np.zeros(len(p.a_len), np.int64)
    for r in ident_rows:
        ident_count[r["a"]] = r["count"]

    id_part = encoded.select(*PASSED, "ident_a", "ident_n").mapInArrow(
        _identity_sums(a_file, b_file, ident_count, best),
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, id_sum long, id_best long")
    bests = spark.createDataFrame([(i, int(v)) for i, v in enumerate(best) if v], "b int, best long")
    irr_part = (
        # a shuffle join at every size, so that what moves grows in proportion
        encoded.select("row", F.inline("irregular")).join(counts.hint("shuffle_merge"), ["a", "b"])
        .join(F.broadcast(bests), "b")  # at most one row a B id
        .groupBy("row").agg(
            F.sum(F.col("n") * F.col("count")).alias("irr_sum"),
            F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("irr_best"),
        )
    )
    out = id_part.join(irr_part, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("id_best") + F.coalesce("irr_best", F.lit(0))).cast("long").alias("n_best"),
        (F.col("id_sum") + F.coalesce("irr_sum", F.lit(0))).cast("long").alias("count_sum"),
        "groups_sha256",
    )


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
