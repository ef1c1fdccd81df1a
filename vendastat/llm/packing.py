"""Packing along a space-filling curve.

Every document becomes a vector of hashed counts, projected to a few dimensions and put on a
Hilbert curve. Counted are whole words in lower case, and the six-byte pieces of words that are
very long or written in a script without spaces (``arrays.pieces``). Documents are dealt out by ranges of that curve, so neighbours in content
are neighbours in the stream of tokens, and the stream is cut every 4096 tokens: no sequence
but the last has padding. A document that crosses a cut is in two sequences or more.

The text is read twice, once for the keys of a sample that places the ranges, and shuffled once;
keys are made once. Each range is tokenised in curve order and stored with running
token counts; only one sum per range meets in one place, after which every stored row knows
its place in the whole stream and is cut into pieces where it lies.

Defined results: a null text counts as empty, and an empty text is its end token alone. Equal
texts have equal keys and are neighbours, told apart by their ids, so a hot text still spreads
over many ranges. Repeated rows are packed each. Very long texts are tokenised word by word
and cut like others. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from importlib.util import find_spec
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import WordHasher, mix, segments
from .common import kept, partitions, release, store, tidy
from .hilbert import hilbert_index

SEQUENCE_TOKENS = 4096
#: Appended to every document.
END_ID = 2
VECTOR_SIZE, DIMENSIONS, BITS = 256, 3, 16
#: Words whose tokens a worker remembers before it starts anew, and characters it splits at once.
MEMO_WORDS, BATCH_CHARACTERS = 2_000_000, 900_000
#: Documents that place the ranges of the curve, about; they decide no sequence, only how even the ranges are.
SAMPLE_DOCUMENTS = 20_000
#: What stands for the end of a word in a vocabulary.
MARK = "</w>"
# A tokenizer that composes, lowers and parts texts like this, and merges like that.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_STEPS = (
    {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
WORD_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": MARK,
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
# Words of ASCII and of the letters from U+00C0 to U+017F that are composed and lowered one by one (not so U+0130),
# and the pattern above on such words in lower case.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[!-/:-@\\[-`{-~]+|\n").findall


def projection(size: int = VECTOR_SIZE, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed random matrix with independent, normally distributed entries."""
    return np.random.default_rng(20240229).standard_normal((size, dimensions))


def curve_keys(texts: list[str], matrix: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """Curve index of each text: hashed, damped and normalised counts of words and pieces, projected."""
    out = np.zeros(len(texts), dtype=np.int64)
    size, dimensions = matrix.shape
    for at, to, words, ends in hasher.batches(texts, parts_too=True):
        _, lengths = segments(ends)
        owner = np.repeat(np.arange(to - at) * size, lengths)
        scrambled = mix(words, 3)
        bucket = (scrambled % np.uint64(size)).astype(np.int64)
        sign = 1.0 - 2.0 * ((scrambled >> np.uint64(40)) & np.uint64(1))
        counts = np.bincount(owner + bucket, weights=sign, minlength=(to - at) * size).reshape(to - at, size)
        counts = np.sign(counts) * np.log1p(np.abs(counts))
        norm = np.linalg.norm(counts, axis=1, keepdims=True)
        point = counts / np.where(norm > 0, norm, 1.0) @ matrix
        grid = np.clip((point / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        out[at:to] = hilbert_index(grid, BITS)
    return out


class Memo:
    """Ids of words by the 64-bit hash of the word: slots by hash, tried in a row, and a pool of ids."""

    def __init__(self, kind: np.dtype) -> None:
        self.words = 0
        self.slots, self.owners = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.int32)
        self.begin, self.pool = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 18, dtype=kind)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is not known."""
        keys, last = np.maximum(hashes, 1), np.uint64(len(self.slots) - 1)  # 0 is a free slot
        out, left, slot = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), keys & last
        while len(left):
            there = self.slots[slot]
            hit = there == keys
            out[left[hit]] = self.owners[slot[hit]]
            on = ~hit & (there != 0)
            left, keys, slot = left[on], keys[on], (slot[on] + np.uint64(1)) & last
        return out

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct words that are not known yet: how many ids each has, and all of them in a row."""
        to, used = self.words + len(hashes), int(self.begin[self.words])
        self.begin, self.pool = longer(self.begin, to + 1), longer(self.pool, used + len(ids))
        self.begin[self.words + 1 : to + 1] = used + np.cumsum(counts)
        self.pool[used : used + len(ids)] = ids
        if 2 * to > len(self.slots):
            taken = np.flatnonzero(self.slots)
            keys, owners = self.slots[taken], self.owners[taken]
            size = 1 << (2 * to - 1).bit_length()
            self.slots, self.owners = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
            self._settle(keys, owners)
        self._settle(np.maximum(hashes, 1), np.arange(self.words, to, dtype=np.int32))
        self.words = to

    def _settle(self, keys: np.ndarray, owners: np.ndarray) -> None:
        last = np.uint64(len(self.slots) - 1)
        slot = keys & last
        while len(keys):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = keys[free]
            mine = self.slots[slot] == keys  # of several for one slot, the last has it
            self.owners[slot[mine]] = owners[mine]
            keys, owners, slot = keys[~mine], owners[~mine], (slot[~mine] + np.uint64(1)) & last

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        begins = self.begin[places]
        counts = self.begin[places + 1] - begins
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(begins - (ends - counts), counts) + np.arange(total)], counts


def longer(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` items, doubled where it has to grow."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


class Tokens:
    """Token ids of texts, word by word, remembering words seen before.

    The tokenizer never joins anything across white space, so the ids of a text are those of
    its words in a row. Words are told apart by a 64-bit hash. New words of Latin letters, digits
    and ASCII signs go through ``tiktoken`` with the vocabulary of the same file, where that gives
    the same ids (see ``PieceEncoder``); all others go through ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype(f"<u{id_width(self.tokenizer)}")
        self.hasher = WordHasher()
        self.pieces = PieceEncoder.of(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.memo = Memo(self.kind)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has: one text, parted by offsets."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.array([o[0] for o in encoded.offsets], dtype=np.int64)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        return np.array(encoded.ids, dtype=self.kind), np.diff(np.searchsorted(begins, starts))

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        plain = np.fromiter((bool(self.pieces and PLAIN(w)) for w in words), dtype=bool, count=len(words))
        for some, encode in ((plain, self.pieces), (~plain, self._encode_words)):
            if some.any():
                ids, counts = encode(list(compress(words, some)))
                self.memo.add(hashes[some], counts, ids.astype(self.kind))

    def _ids(self, whole: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words between each start and end, in a row, and how many each has; new words are learnt."""
        places = self.memo.places(hashes)
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            distinct, first = np.unique(hashes[unknown], return_index=True)
            if self.memo.words and self.memo.words + len(distinct) > MEMO_WORDS:
                self._forget()
                return self._ids(whole, hashes, starts, ends)
            new = unknown[first]
            self._learn([whole[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], distinct)
            places[unknown] = self.memo.places(hashes[unknown])
        return self.memo.ids(places)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; words that are new are encoded for many texts at once."""
        at = 0
        while at < len(texts):
            data, size = [], 0
            while at < len(texts) and (not data or size + len(texts[at]) < BATCH_CHARACTERS):
                data.append(texts[at].encode())
                size += len(texts[at])
                at += 1
            whole = b"\n".join(data)
            hashes, starts, ends = self.hasher.words(whole)
            ids, counts = self._ids(whole, hashes, starts, ends)
            upto = np.concatenate([[0], np.cumsum(counts)])
            limits = np.cumsum([len(d) + 1 for d in data])
            cuts = upto[np.searchsorted(starts, limits)].tolist()
            raw, wide, begin = ids.tobytes(), self.kind.itemsize, 0
            for cut in cuts:
                yield raw[begin * wide : cut * wide]
                begin = cut


class PieceEncoder:
    """``tiktoken`` with the vocabulary of a tokenizer that marks the ends of words.

    The tokenizer normalises, parts words into letters, single digits and signs, and merges the bytes
    of each part with a mark at its end; here the mark is a space. ``tiktoken`` merges any two neighbours
    whose bytes are a token, ``tokenizers`` only the listed two. If every token comes out of its
    own bytes by the listed merges, both give the same: inside the bytes of a token the merges
    run as they do on the token alone, and there the last one is the listed one.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[^ \n]+ ", mergeable_ranks=ranks, special_tokens={})
        self.closing = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.closing[[i for token, i in ranks.items() if token.endswith(b" ")]] = True

    @classmethod
    def of(cls, tokenizer) -> PieceEncoder | None:
        """None if ``tiktoken`` is missing or the tokenizer is of another kind."""
        from tokenizers.models import BPE

        parts = json.loads(tokenizer.to_str())
        model = parts["model"]
        if find_spec("tiktoken") is None or (parts["normalizer"], parts["pre_tokenizer"]) != WORD_STEPS:
            return None
        if {k: v for k, v in model.items() if k not in ("vocab", "merges")} != WORD_MODEL:
            return None
        special = {t["content"] for t in parts["added_tokens"]}
        vocabulary = {w: i for w, i in model["vocab"].items() if w not in special}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        merged = [vocabulary[a + b] for a, b in merges]
        symbols = {c + end for c in byte_of() for end in ("", MARK)}
        if merged != sorted(set(merged)) or set(vocabulary) - {a + b for a, b in merges} != symbols:
            return None
        if max(vocabulary[s] for s in symbols) > min(merged, default=len(vocabulary)):
            return None
        ranks = {spelled(w): i for w, i in vocabulary.items()}
        bare = BPE(vocab=model["vocab"], merges=merges)
        alone = ((bare, w) if not w.endswith(MARK) else (tokenizer.model, w[: -len(MARK)]) for w in map("".join, merges))
        if len(ranks) < len(vocabulary) or any(len(by.tokenize(w)) != 1 for by, w in alone):
            return None
        return cls(ranks)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``PLAIN`` words in a row, and how many each has."""
        text = " ".join(PIECES("\n".join([*words, ""]).lower()))
        ids = self.encoding.encode_to_numpy(text)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        breaks = np.flatnonzero(raw == 10)
        pieces = np.searchsorted(np.flatnonzero(raw == 32), breaks) - np.arange(len(breaks))  # a space follows each break, too
        ends = np.flatnonzero(self.closing[ids])[pieces - 1] + 1
        return ids, np.diff(ends, prepend=0)


def byte_of() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: visible ones as they are, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def spelled(token: str, spelling: dict[str, int] = byte_of()) -> bytes:
    """The bytes of a token, with a space for the mark at its end."""
    bare = token.removesuffix(MARK)
    return bytes(spelling[c] for c in bare) + b" " * (bare != token)


def worker_tokens(path: str) -> Tokens:
    """One ``Tokens`` for all tasks that a Python worker runs, so words are learnt once."""
    return kept(f"tokens of {path}", lambda: Tokens(path))


def id_width(tokenizer) -> int:
    """Bytes that hold any id."""
    return 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Documents in curve order, stored: id, ids, tokens, part_no, before (tokens ahead in the part)."""
    matrix, parts = projection(), partitions(docs.sparkSession)

    def key_of(cuts: np.ndarray):
        """(curve, part) of texts: the part is the range between two cuts (curve, row)."""

        @F.pandas_udf("curve bigint, part int")
        def key(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            hasher = WordHasher()
            try:
                for texts, rows in batches:
                    curve = curve_keys(texts.tolist(), matrix, hasher)
                    yield pd.DataFrame({"curve": curve, "part": range_of(curve, rows.to_numpy(np.int64), cuts)})
            finally:
                del hasher
                release()

        return key("text", "row")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, before = worker_tokens(path), 0
        end = np.array([end_id], dtype=tokens.kind).tobytes()
        try:
            for batch in batches:
                ids = [found + end for found in tokens.encode(batch["text"].tolist())]
                counts = np.array([len(b) for b in ids], dtype=np.int64) // tokens.kind.itemsize
                ahead = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pd.DataFrame({"id": batch["id"], "ids": ids, "tokens": counts, "before": ahead, "part_no": batch["part"]})
        finally:
            release()

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    # A number of the row tells equal texts and ids apart, so that a hot one spreads over ranges.
    texts = texts.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    cuts = _range_cuts(texts, key_of(np.zeros((0, 2), dtype=np.int64)), parts)
    keyed = texts.withColumn("key", key_of(cuts)).select("id", "text", "key.curve", "key.part")
    dealt = keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "curve", F.xxhash64("text"), "id")
    encoded = dealt.select("id", "text", "part").mapInPandas(
        encode, f"id {kind}, ids binary, tokens bigint, before bigint, part_no int"
    )
    return store(encoded, "tokens")


def range_of(curve: np.ndarray, row: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of cuts (curve, row), in order, that lie at or before each place."""
    low, high = (np.searchsorted(cuts[:, 0], curve, side=side) for side in ("left", "right"))
    part = low.astype(np.int32)
    for i in np.flatnonzero(high > low):  # some cuts are on this very place of the curve
        part[i] += np.searchsorted(cuts[low[i] : high[i], 1], row[i], side="right")
    return part


def _range_cuts(texts: DataFrame, key, parts: int) -> np.ndarray:
    """Places that cut the documents into even ranges, from the keys of a bounded sample."""
    if parts == 1:
        return np.zeros((0, 2), dtype=np.int64)
    n = texts.count()
    some = texts.where(F.pmod("row", F.lit(1 << 30)) < F.lit(min(1 << 30, -(-SAMPLE_DOCUMENTS * (1 << 30) // max(n, 1)))))
    rows = some.select("row", key.alias("key")).select("key.curve", "row").toPandas()  # SAMPLE_DOCUMENTS, about
    ordered = rows.sort_values(["curve", "row"]).to_numpy(np.int64)
    at = np.unique(np.arange(1, parts) * len(ordered) // parts) if len(ordered) else np.zeros(0, dtype=np.int64)
    return ordered[at]


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers; ``start`` counts
    the ids of the document before the piece, ``offset`` those of the sequence.
    """
    rows = tokenised(docs, tokenizer, id_col, text_col, end_id)
    from tokenizers import Tokenizer

    width = id_width(Tokenizer.from_file(tokenizer))
    # One sum for each range, of which there are as many as shuffle partitions.
    sums = rows.groupBy("part_no").agg(F.sum("tokens").alias("sum"))
    ahead = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("part_no", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("shift"))
    placed = rows.join(F.broadcast(shifts), "part_no").withColumn("at", F.col("shift") + F.col("before"))

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, ids, tokens, at in zip(batch["id"], batch["ids"], batch["tokens"], batch["at"], strict=True):
                whole = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                start = 0
                while start < tokens:
                    sequence, offset = divmod(at + start, sequence_tokens)
                    length = min(tokens - start, sequence_tokens - offset)
                    out.append((doc, start, length, whole[start : start + length].tobytes(), tokens, sequence, offset))
                    start += length
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pd.DataFrame(out, columns=names)

    kind = rows.schema["id"].dataType.simpleString()
    return placed.select("id", "ids", "tokens", "at").mapInPandas(
        cut,
        f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
