"""Stupid-backoff language model scores, computed by joins on hashed n-grams.

The corpus scores itself with a bigram model. A word w after v scores ::

    c(v w) / c(v)                     if the bigram is seen ``min_count`` times or more
    backoff * c(w) / N                otherwise

over counts of the whole corpus; a bigram seen once is the document's own and no evidence.
Every document begins with a start and ends with an end symbol, so c(v) is also the number of
bigrams that begin with v. The score of a document is the sum of the logarithms.

How the join moves little: documents are read in chunks. A chunk sends the bigrams of its
documents to the partitions of their hash as packed columns (six bytes per word, two per
document), where all chunks meet: the counts of the partition are made there and joined to the
bigrams that made them, and each chunk gets back one sum per document. Bigrams that back off
go on to the partition of their last word, to meet the table of word counts.

Skew: bigrams are partitioned by their first word, so that c(v) is there, too. Words that hold
more than a share of all words are known from the word counts, at most ``4 * buckets`` of
them, and travel to every task with their counts; their bigrams are spread by the second word.
Bigrams of two such words that hold as much are counted in a pass of their own, combined inside
each task, and scored where they are read. So no partition gets more than a few shares.

Defined results: a null or empty text is the end symbol after the start symbol. Words are runs
without space, tab or line break, in lower case, told apart by 48 bits of a hash. Repeated rows
count, and are scored, each. Very long texts are hashed in slices. An empty table gives an
empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import WordHasher, mix, segments
from .common import partitions, store, text_or_empty

BACKOFF, MIN_COUNT = 0.4, 2
ID_BYTES = 6
ID_MASK = np.uint64((1 << (8 * ID_BYTES)) - 1)
START, END = np.uint64(1), np.uint64(2)
#: Documents of a chunk at most, so that two bytes name one, and characters, for its memory.
CHUNK_DOCUMENTS, CHUNK_CHARACTERS = 1 << 16, 1 << 22
#: Smaller buckets take less memory at a time.
BUCKETS_PER_PARTITION = 2
#: A word or bigram is hot from one part in so many of a partition's even share.
HOT_PARTS = 4


class Hot(NamedTuple):
    """Words and bigrams known to every task; ids are sorted, bigrams by their mixed id."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray


def packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :ID_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ID_BYTES, 8), dtype=np.uint8)
    out[:, :ID_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, ID_BYTES)
    return out.view("<u8").ravel()


def word_ids(texts: list[str], hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ids of the words of runs of texts, each text between its start and end symbol."""
    for at, to, hashes, ends in hasher.batches(texts):
        starts, lengths = segments(ends)
        n = to - at
        out = np.empty(len(hashes) + 2 * n, dtype=np.uint64)
        begins = starts + 2 * np.arange(n)
        out[begins] = START
        out[begins + lengths + 1] = END
        inner = np.arange(len(hashes)) + 1 + 2 * np.repeat(np.arange(n), lengths)
        out[inner] = hashes & ID_MASK
        yield at, to, out, begins + lengths + 2


def chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Consecutive documents within the limits of a chunk; a longer one is a chunk alone."""
    sizes, at = batch["text"].str.len().to_numpy(), 0
    while at < len(batch):
        fits = np.searchsorted(np.cumsum(sizes[at:]), CHUNK_CHARACTERS, side="right")
        to = at + min(max(1, int(fits)), CHUNK_DOCUMENTS)
        yield batch.iloc[at:to]
        at = to


def pair_id(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v, 21) + w, 22)


def found_in(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return place, table[place] == values


def totals(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(values, return_inverse=True)
    return distinct, np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)


def by_bucket(buckets: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), order[bounds[b] : bounds[b + 1]]


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """The table of word counts, stored: one row per bucket of hashes, sorted and packed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            parts = [np.unique(ids[ids != START], return_counts=True) for _, _, ids, _ in word_ids(batch["text"].tolist(), hasher)]
            if not parts:
                continue
            ids, n = totals(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            rows = [(b, packed(ids[i]), n[i].astype("<i8").tobytes()) for b, i in by_bucket(ids % np.uint64(buckets), buckets)]
            yield pd.DataFrame(rows, columns=["bucket", "ids", "counts"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ids, n = totals(unpacked(b"".join(group["ids"])), np.frombuffer(b"".join(group["counts"]), dtype="<i8"))
        row = (group["bucket"].iloc[0], packed(ids), n.tobytes(), int(n.sum()))
        return pd.DataFrame([row], columns=["bucket", "ids", "counts", "total"])

    counted = texts.select("text").mapInPandas(count, "bucket int, ids binary, counts binary")
    return store(counted.groupBy("bucket").applyInPandas(merge, "bucket int, ids binary, counts binary, total bigint"), "words")


def hot_ones(texts: DataFrame, words: DataFrame, documents: int, total: int, least: float) -> Hot:
    """Words and bigrams with more than ``least`` occurrences; as many as fit into the total."""

    def large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, counts in zip(batch["ids"], batch["counts"], strict=True):
                n = np.frombuffer(counts, dtype="<i8")
                some = n > least
                yield pd.DataFrame({"id": unpacked(ids)[some].astype(np.int64), "n": n[some]})

    found = words.select("ids", "counts").mapInPandas(large, "id bigint, n bigint").toPandas()
    ids = np.append(found["id"].to_numpy(dtype=np.uint64), START)
    counts = np.append(found["n"].to_numpy(), documents)
    order = np.argsort(ids)
    ids, counts = ids[order], counts[order]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            parts = []
            for _, _, tokens, ends in word_ids(batch["text"].tolist(), hasher):
                hot = found_in(ids, tokens)[1]
                both = hot[:-1] & hot[1:]
                both[ends[:-1] - 1] = False
                at = np.flatnonzero(both)
                parts.append(np.unique(pair_id(tokens[at], tokens[at + 1]), return_counts=True))
            if parts:
                pairs, n = totals(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                yield pd.DataFrame({"id": pairs.view(np.int64), "n": n})

    pairs = texts.select("text").mapInPandas(count, "id bigint, n bigint")
    pairs = pairs.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > least).toPandas()
    pair_ids = pairs["id"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(pair_ids)
    return Hot(ids, counts, pair_ids[order], pairs["n"].to_numpy()[order])


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF, min_count: int = MIN_COUNT
) -> DataFrame:
    """One row per document: id, n_words (with the end symbol), log_score."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    buckets = BUCKETS_PER_PARTITION * partitions(docs.sparkSession)
    words = word_counts(texts, buckets)
    documents = texts.count()
    total = words.agg(F.sum("total")).first()[0] or 0
    hot = hot_ones(texts, words, documents, total, total / (HOT_PARTS * buckets))
    wide = np.uint64(buckets)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Bigrams to the buckets of their first word; what is hot is scored here."""
        hasher, chunk = WordHasher(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in chunks(whole):
                sums, sizes, sent = np.zeros(len(batch)), np.zeros(len(batch), dtype=np.int64), []
                for at, to, tokens, ends in word_ids(batch["text"].tolist(), hasher):
                    starts, lengths = segments(ends)
                    owner = np.repeat(np.arange(at, to), lengths)
                    inside = np.ones(len(tokens), dtype=bool)
                    inside[starts] = False
                    w_at = np.flatnonzero(inside)
                    v, w, owner = tokens[w_at - 1], tokens[w_at], owner[w_at]
                    sizes[at:to] = lengths - 1
                    place, hot_v = found_in(hot.words, v)
                    pair, hot_pair = found_in(hot.pairs, pair_id(v, w))
                    hot_pair &= hot_v
                    known = np.log(hot.pair_counts[pair[hot_pair]] / hot.word_counts[place[hot_pair]])
                    np.add.at(sums, owner[hot_pair], known)
                    bucket = np.where(hot_v, pair_id(v, w), mix(v, 23)) % wide
                    rest = ~hot_pair
                    sent.append((bucket[rest].astype(np.int32), v[rest], w[rest], owner[rest].astype(np.uint16)))
                none = {"firsts": None, "runs": None, "last": None, "owners": None}
                yield pd.DataFrame(
                    [{"bucket": chunk % buckets, "chunk": chunk, **none, "ids": batch["id"].tolist(), "sizes": sizes.tobytes(), "sums": sums.tobytes()}]
                )
                bucket, v, w, owner = (np.concatenate(p) for p in zip(*sent, strict=True))
                for b, at in by_bucket(bucket, buckets):
                    at = at[np.argsort(v[at], kind="stable")]
                    firsts, runs = np.unique(v[at], return_counts=True)
                    row = {
                        "bucket": b,
                        "chunk": chunk,
                        "firsts": packed(firsts),
                        "runs": runs.astype("<u4").tobytes(),
                        "last": packed(w[at]),
                        "owners": owner[at].tobytes(),
                        "ids": None,
                        "sizes": None,
                        "sums": None,
                    }
                    yield pd.DataFrame([row])
                chunk += 1

    sent_schema = (
        f"bucket int, chunk bigint, firsts binary, runs binary, last binary, owners binary, "
        f"ids array<{kind}>, sizes binary, sums binary"
    )
    told = ["bucket", "chunk", "last", "owners", "ids", "sizes", "sums", "chunks", "runs"]
    told_schema = (
        f"bucket int, chunk bigint, last binary, owners binary, ids array<{kind}>, sizes binary, sums binary, "
        "chunks binary, runs binary"
    )

    def join_pairs(group: pd.DataFrame) -> pd.DataFrame:
        """Counts of the bucket's bigrams, joined to the bigrams; the rest backs off."""
        whole = group[group["ids"].notna()].assign(chunks=None)
        out = [tuple(r) for r in whole[told].itertuples(index=False)]
        group = group[group["ids"].isna()]
        if not len(group):
            return pd.DataFrame(out, columns=told)
        v = np.repeat(unpacked(b"".join(group["firsts"])), np.frombuffer(b"".join(group["runs"]), dtype="<u4"))
        w = unpacked(b"".join(group["last"]))
        _, pair, pair_n = np.unique(pair_id(v, w), return_inverse=True, return_counts=True)
        _, first, first_n = np.unique(v, return_inverse=True, return_counts=True)
        place, hot_v = found_in(hot.words, v)
        c_pair, c_first = pair_n[pair], first_n[first].astype(np.int64)
        c_first[hot_v] = hot.word_counts[place[hot_v]]
        score = np.log(c_pair / c_first)
        # A hot last word is known here, the others are looked up in their bucket.
        place, hot_w = found_in(hot.words, w)
        back = c_pair < min_count
        some = back & hot_w
        score[some] = np.log(backoff * hot.word_counts[place[some]] / total)
        sizes = [len(o) // 2 for o in group["owners"]]
        chunk = np.repeat(group["chunk"].to_numpy(), sizes)
        owner = np.frombuffer(b"".join(group["owners"]), dtype="<u2")
        open_ = back & ~hot_w
        for at_chunk, docs_here, sums in sums_by_chunk(chunk[~open_], owner[~open_], score[~open_]):
            out.append((at_chunk % buckets, at_chunk, None, docs_here, None, None, sums, None, None))
        w, owner, chunk = w[open_], owner[open_], chunk[open_]
        # One row for each bucket to go to, whatever the number of chunks.
        for bucket, at in by_bucket(w % wide, buckets):
            at = at[np.argsort(chunk[at], kind="stable")]
            names, runs = np.unique(chunk[at], return_counts=True)
            runs = runs.astype("<u4").tobytes()
            out.append((bucket, None, packed(w[at]), owner[at].tobytes(), None, None, None, names.astype("<i8").tobytes(), runs))
        return pd.DataFrame(out, columns=told)

    scored_schema = f"chunk bigint, owners binary, ids array<{kind}>, sizes binary, sums binary"
    scored_columns = ["chunk", "owners", "ids", "sizes", "sums"]

    def join_words(group: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        """Word counts of the bucket, joined to what backs off; sums of the chunk pass."""
        if not len(group):
            return pd.DataFrame([], columns=scored_columns)
        done = group["last"].isna()
        out = [tuple(r) for r in group.loc[done, scored_columns].itertuples(index=False)]
        rest = group[~done]
        if len(rest):
            ids = unpacked(table["ids"].iloc[0])
            counts = np.frombuffer(table["counts"].iloc[0], dtype="<i8")
            n = counts[np.searchsorted(ids, unpacked(b"".join(rest["last"])))]
            names, runs = (np.frombuffer(b"".join(rest[c]), dtype=t) for c, t in (("chunks", "<i8"), ("runs", "<u4")))
            owner = np.frombuffer(b"".join(rest["owners"]), dtype="<u2")
            found = sums_by_chunk(np.repeat(names, runs), owner, np.log(backoff * n / total))
            out += [(chunk, docs_here, None, None, sums) for chunk, docs_here, sums in found]
        return pd.DataFrame(out, columns=scored_columns)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        """Sums per document of one chunk."""
        whole = group[group["ids"].notna()].iloc[0]
        sums = np.frombuffer(whole["sums"]).copy()
        for owners, part in group.loc[group["ids"].isna(), ["owners", "sums"]].itertuples(index=False):
            sums[np.frombuffer(owners, dtype="<u2")] += np.frombuffer(part)
        return pd.DataFrame({"id": whole["ids"], "n_words": np.frombuffer(whole["sizes"], dtype=np.int64), "log_score": sums})

    sent = texts.mapInPandas(send, sent_schema)
    told_rows = sent.groupBy("bucket").applyInPandas(join_pairs, told_schema)
    table = words.select("bucket", "ids", "counts")
    scored = told_rows.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(join_words, scored_schema)
    return scored.groupBy("chunk").applyInPandas(finish, f"id {kind}, n_words bigint, log_score double")


def sums_by_chunk(chunk: np.ndarray, owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """For each chunk its documents with something to add, and the sum of each."""
    if not len(chunk):
        return
    order = np.argsort(chunk, kind="stable")
    names, starts = np.unique(chunk[order], return_index=True)
    for name, part in zip(names, np.split(order, starts[1:]), strict=True):
        sums = np.bincount(owner[part], weights=values[part])
        some = np.unique(owner[part])
        yield int(name), some.astype("<u2").tobytes(), sums[some].tobytes()
