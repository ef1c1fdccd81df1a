"""Packing into few sequences: large items matched in pairs, smaller ones best-fit into the gaps.

Documents are tokenised where they lie and only longer ones than a sequence are cut. Packing is
decided on the histogram of piece lengths, of which there are no more than a sequence has tokens,
whatever the number of documents: of pieces above a third of a sequence at most two go together, so
each length, from the largest down, is matched with the largest one that still fits beside it;
then smaller pieces, from the largest down, each go to the smallest gap that holds them, and to
a new sequence where none does. Both are done for whole groups of equal pieces and equal
sequences at once. The outcome is a table of moves: "the 1,200 pieces of length 310 from number
7,000 on go to the sequences from number 52,000 on, at place 1,738".

A piece finds its move by its length and its number among pieces of that length: its number in its
own file plus those of the files before. Texts and ids are never shuffled, and no group of equal
lengths meets in one task. ``sequences`` puts the ids of sequences together, which is a shuffle.

Defined results: a null text counts as empty, and an empty text is its end token alone. Repeated
rows are packed each. Null ids are kept as they are. Very long texts are tokenised word by
word and cut like others. An empty table gives an empty result. Only the id
and the text are read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, release, store, text_or_empty
from .packing import Tokens, byte_of

SEQUENCE_TOKENS = 2048
#: Appended to every document.
END_ID = 0
#: Bytes of ids that are held before they are handed on.
HELD_BYTES = 1 << 22
#: Characters a worker encodes at once.
BATCH_CHARACTERS = 1 << 21
# Fixed value: how byte-level tokenizers part a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ["don't  stop\n\n now", " \t x\u00a0y\u3000z", "\u00e9t\u00e9 \u00bd 12345 \u4e2d\u6587 \x1c\x85 ", "<|endoftext|> a'LL"]


class ByteTokens(Tokens):
    """Token ids of texts by a byte-level tokenizer, word by word, remembering words seen before.

    The usual byte-level pattern never joins anything across a space that stands behind another
    character than white space, so texts are cut there and each word, with its space, is encoded
    once. Words are told apart by a 64-bit hash. A tokenizer that has a normaliser, adds a space
    or uses another pattern is given whole texts instead.

    New words go through ``tiktoken`` with the vocabulary of the same file, as it takes a third of
    the time; on start both libraries must agree on a sample of odd strings, else ``tokenizers``
    encodes them all.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_words = parts["normalizer"] is None and usual.items() <= before.items()
        self.fast = fast_encoder(parts) if self.by_words else None
        if self.fast and any(self.fast(t) != self._exact([t])[0] for t in PROBES):
            self.fast = None

    def _exact(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        ids = [self.fast(w) for w in words] if self.fast else self._exact(words)
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.memo.add(hashes, counts, np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=int(counts.sum())))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; words that are new are encoded for many texts at once."""
        if not self.by_words:
            yield from (np.array(self._exact([t])[0], dtype=self.kind).tobytes() for t in texts)
            return
        at = 0
        while at < len(texts):
            data, size = [], 0
            while at < len(texts) and (not data or size + len(texts[at]) < BATCH_CHARACTERS):
                data.append(texts[at].encode())
                size += len(texts[at])
                at += 1
            yield from self._encode_together(data)

    def _encode_together(self, data: list[bytes]) -> Iterator[bytes]:
        whole = b"".join(data)
        limits = np.cumsum([0] + [len(d) for d in data])
        starts = word_starts(whole, limits)
        if not len(starts):
            yield from data
            return
        ends = np.append(starts[1:], len(whole))
        hashes = self.hasher.spans(whole, starts, ends)
        ids, counts = self._ids(whole, hashes, starts, ends)
        raw = ids.tobytes()
        upto = np.concatenate([[0], np.cumsum(counts)]) * self.kind.itemsize
        cuts = upto[np.searchsorted(starts, limits)].tolist()
        for begin, end in pairwise(cuts):
            yield raw[begin:end]


def word_starts(data: bytes, limits: np.ndarray) -> np.ndarray:
    """Bytes of ``data`` where a word can be cut off, and those where a text begins.

    Before a space that stands behind a visible ASCII character or one of two bytes from U+00C0
    on, none of which is white space.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    cut = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw) > 2:
        last, lead = raw[1:-1], raw[:-2]
        solid = ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (lead >= 0xC3) & (lead < 0xE0))
        cut[2:-1] = (raw[2:] == 0x20) & solid
    if len(raw) > 1:
        cut[1] = raw[1] == 0x20 and 0x20 < raw[0] < 0x7F
    cut[limits[:-1]] = True
    return np.flatnonzero(cut[: len(raw)])


def fast_encoder(parts: dict) -> Callable[[str], list[int]] | None:
    """``tiktoken`` with the vocabulary of a byte-level tokenizer, if its merges are in order of their ids."""
    try:
        import tiktoken
    except ModuleNotFoundError:
        return None
    special = {t["content"] for t in parts["added_tokens"]}
    vocabulary = {w: i for w, i in parts["model"]["vocab"].items() if w not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
    merged = [vocabulary["".join(m)] for m in merges]
    if merged != sorted(merged):
        return None
    spelling = byte_of()
    ranks = {bytes(spelling[c] for c in w): i for w, i in vocabulary.items()}
    encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


def worker_tokens(path: str) -> ByteTokens:
    """One ``ByteTokens`` for all tasks that a Python worker runs."""
    return kept(f"byte tokens of {path}", lambda: ByteTokens(path))


def piece_lengths(tokens: int, capacity: int) -> list[int]:
    """Full pieces, behind a shorter first one where the number does not go up."""
    first = tokens % capacity
    return [first] * (first > 0) + [capacity] * (tokens // capacity)


class Plan:
    """Moves of groups of equal pieces to groups of sequences that are filled alike."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.sequences = 0
        #: length, first number of the pieces, how many, first sequence, place in it
        self.moves: list[tuple[int, int, int, int, int]] = []
        #: free tokens -> groups (first sequence, how many), and the free numbers in order
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.free: list[int] = []
        self._match_large()
        self._fill_gaps()

    def _place(self, size: int, n: int, first: int, offset: int) -> None:
        self.moves.append((size, self.taken[size], n, first, offset))
        self.taken[size] += n
        self.left[size] -= n

    def _gap(self, free: int, first: int, n: int) -> None:
        if not free:
            return
        if free not in self.gaps:
            self.gaps[free] = []
            insort(self.free, free)
        self.gaps[free].append((first, n))

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _match_large(self) -> None:
        """Lengths above a third: each with the largest other that fits, so two a sequence at most."""
        large = sorted(s for s in self.left if 3 * s > self.capacity)
        while large:
            size = large[-1]
            at = bisect_left(large, self.capacity - size + 1) - 1
            partner = large[at] if at >= 0 else None
            n = self.left[size] if partner != size else self.left[size] // 2
            if partner == size and not n:  # the last one of its length looks for the next smaller
                partner, n = (large[at - 1] if at else None), 1
            if partner is not None and partner != size:
                n = min(n, self.left[partner])
            first = self._open(n)
            self._place(size, n, first, 0)
            used = size
            if partner is not None:
                self._place(partner, n, first, size)
                used += partner
            self._gap(self.capacity - used, first, n)
            large = [s for s in large if self.left[s]]

    def _fill_gaps(self) -> None:
        """Other lengths, from the largest down: the smallest gap that holds one, else a new sequence."""
        for size in sorted((s for s, n in self.left.items() if n), reverse=True):
            while self.left[size]:
                at = bisect_left(self.free, size)
                if at == len(self.free):
                    self._open_for(size)
                    continue
                free = self.free[at]
                first, n = self.gaps[free].pop()
                if not self.gaps[free]:
                    del self.gaps[free], self.free[at]
                some = min(n, self.left[size])
                self._place(size, some, first, self.capacity - free)
                self._gap(free - size, first, some)
                if some < n:
                    self._gap(free, first + some, n - some)

    def _open_for(self, size: int) -> None:
        """New sequences of this length alone, filled one after the other."""
        each = self.capacity // size
        n, rest = divmod(self.left[size], each)
        for count, columns in ((n, each), (1 if rest else 0, rest)):
            if not count:
                continue
            first = self._open(count)
            for k in range(columns):
                self._place(size, count, first, k * size)
            self._gap(self.capacity - columns * size, first, count)


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces, stored: id, piece, start, length, packed_ids, ids_crc32, nth (of its length in its file), part_no."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = worker_tokens(path)
        wide, end = tokens.kind.itemsize, np.array([end_id], dtype=tokens.kind).tobytes()
        seen = [0] * (capacity + 1)
        names = ["row", "piece", "start", "length", "packed_ids", "ids_crc32", "nth"]
        try:
            for batch in batches:
                rows, held = [], 0
                owner = batch["id"].to_numpy()
                for i, found in enumerate(tokens.encode(batch["text"].tolist())):
                    ids, start = found + end, 0
                    for piece, length in enumerate(piece_lengths(len(ids) // wide, capacity)):
                        some = ids[start * wide : (start + length) * wide]
                        crc = zlib.crc32(np.frombuffer(some, dtype=tokens.kind).astype("<u4"))
                        rows.append((i, piece, start, length, some, crc, seen[length]))
                        seen[length] += 1
                        start += length
                    held += len(ids)
                    if held > HELD_BYTES or i == len(batch) - 1:
                        out = pd.DataFrame(rows, columns=names)
                        out.insert(0, "id", owner[out.pop("row")])
                        yield out
                        rows, held = [], 0
        finally:
            release()

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length int, packed_ids binary, ids_crc32 bigint, nth bigint"
    return store(texts.mapInPandas(encode, schema).withColumn("part_no", F.spark_partition_id()), "pieces")


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, part_no, nth.

    ``part_no``, ``length`` and ``nth`` name the stored piece, see ``with_ids``.
    """
    return packed(tokenised(docs, tokenizer, id_col, text_col, sequence_tokens, end_id), sequence_tokens)


def packed(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    counted = store(pieces.groupBy("part_no", "length").agg(F.count("*").alias("n")), "piece-counts")
    # One row for each length.
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, sequence_tokens)
    moves = np.array(sorted(plan.moves), dtype=np.int64).reshape(-1, 5)
    # Lengths are below 2**23 and pieces of one length below 2**40, so both make one sortable number.
    begins = (moves[:, 0] << 40) | moves[:, 1]

    def placed(column: int):
        @F.pandas_udf("bigint")
        def place(length: pd.Series, rank: pd.Series) -> pd.Series:
            at = np.searchsorted(begins, (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64), side="right") - 1
            value = moves[at, column]
            return pd.Series(value + rank.to_numpy(np.int64) - moves[at, 1] if column == 3 else value)

        return place("length", "rank")

    before = Window.partitionBy("length").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select("part_no", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # A row for each file and length grows with the files, so it is merged and not broadcast.
    ranked = pieces.drop("packed_ids").join(shifts.hint("merge"), ["part_no", "length"])
    ranked = ranked.withColumn("rank", F.col("shift") + F.col("nth"))
    return ranked.select(
        "id",
        "piece",
        "start",
        F.col("length").cast("bigint").alias("length"),
        "ids_crc32",
        placed(3).alias("sequence_id"),
        placed(4).alias("offset"),
        "part_no",
        "nth",
    )


def sequences(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """The sequences themselves: sequence_id, tokens, ids (little-endian, two or four bytes each), doc_ids."""
    pieces = tokenised(docs, tokenizer, id_col, text_col, sequence_tokens, end_id)
    placed = packed(pieces, sequence_tokens).select("part_no", "length", "nth", "sequence_id", "offset")
    whole = placed.join(pieces.select("part_no", "length", "nth", "id", "packed_ids"), ["part_no", "length", "nth"])
    rows = F.array_sort(F.collect_list(F.struct("offset", "packed_ids", "id")))  # no more than a sequence has tokens
    return whole.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("tokens")).select(
        "sequence_id",
        "tokens",
        F.expr("aggregate(rows, cast('' as binary), (all, r) -> concat(all, r.packed_ids))").alias("ids"),
        F.transform("rows", lambda r: r["id"]).alias("doc_ids"),
    )
