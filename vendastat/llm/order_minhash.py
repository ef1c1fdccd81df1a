"""Near-dedup by order MinHash, verified by banded alignment.

A text is its sequence of k-mers of five words in lower case; the second occurrence of a k-mer
counts as another one, and so on. Each of several hash functions picks the three smallest
k-mers of a text and writes them down in text order; texts that agree in such a sketch meet in
a bucket. Agreement takes the same k-mers in the same order, which is what few edits leave.

Two texts are alike if a common subsequence of m of their a and b k-mers reaches
m / (a + b - m) >= 0.8. As k-mers with their occurrence are unique in a text, the longest
common subsequence is a longest increasing run of positions; pairs of positions further apart
than any alignment of that similarity allows lie outside the band and are left out.

How candidates become classes without writing pairs down:

1. Equal texts are one class from the start.
2. In each bucket a hub is chosen, the text whose sketches are the most common ones, such as
   the original among its copies. Every member is compared with its hubs; what is alike is
   joined. A group of any size is a star here, and a hot hub's join can be split.
3. Buckets that still hold several classes are compared in full, in tiles of bounded size: a
   signature of 64 bytes tells which members could be alike across classes, and only these
   come back with all their k-mers, are counted exactly against each other and aligned.
   Tiles give back at most one row per member.

Defined results: a null text counts as empty; all empty texts are one class. A text of 1 to 4
words is one k-mer of all its words. The class of a row is the smallest id in it; null ids
lose against others, and a class without any other has the null id. Different texts with one id
are told apart by their hashes. Repeated rows are copies like others. Very long texts are hashed in
slices, and compared as a whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import WordHasher, mix, segments, word_grams
from .common import matching_rows, partitions, possible_rows, release, store, text_or_empty, tidy
from .components import components
from .embedding_dedup import join_roots

WORDS, SIMILARITY = 5, 0.8
SKETCHES, MINIMA = 16, 3
SIGNATURE = 64
#: Agreeing share of the signature below which texts can't be alike: five deviations below 0.8.
LEAST_SHARE = 0.55
#: Members of a bucket on either side of a tile, and bytes of all their k-mers.
TILE_MEMBERS, TILE_BYTES = 4096, 16 << 20
NONE = np.iinfo(np.uint64).max


def labelled(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """K-mers told apart by their occurrence inside each text."""
    _, lengths = segments(ends)
    owner = np.repeat(np.arange(len(ends)), lengths)
    order = np.lexsort((grams, owner))
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[order][1:] != grams[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    occurrence = np.empty(len(grams), dtype=np.uint64)
    occurrence[order] = (np.arange(len(grams)) - begin).astype(np.uint64)
    return mix(grams + occurrence * np.uint64(0xA0761D6478BD642F), 5)


def kmers(texts: list[str], hasher: WordHasher, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at, to, hashes, ends in hasher.batches(texts):
        grams, gram_ends = word_grams(hashes, ends, words)
        yield at, to, labelled(grams, gram_ends), gram_ends


def sketches(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per text and hash function: its smallest k-mers in text order."""
    starts, lengths = segments(ends)
    out = np.zeros((len(ends), SKETCHES), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    starts, lengths = starts[full], lengths[full]
    place = np.full((len(full), MINIMA), np.iinfo(np.int64).max)
    for s in range(SKETCHES):
        ranked = mix(values, 100 + s)
        place[:] = np.iinfo(np.int64).max
        for m in range(MINIMA):
            least = np.minimum.reduceat(ranked, starts)
            at = np.flatnonzero(ranked == np.repeat(least, lengths))
            some = lengths > m
            if some.all():
                place[:, m] = at
            else:
                owner = np.searchsorted(starts, at, side="right") - 1
                good = some[owner]
                place[owner[good], m] = at[good]
            ranked[at] = NONE
        place.sort(axis=1)
        key = np.full(len(full), s + 1, dtype=np.uint64)
        for m in range(MINIMA):
            there = place[:, m] < len(values)
            key[there] = mix(key[there] * np.uint64(0x9E3779B97F4A7C15) + values[place[there, m]], m)
        out[full, s] = key
    return out


def signatures(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bytes per text: in each of 64 classes of k-mers, a byte of the smallest; 0 for none."""
    _, lengths = segments(ends)
    ranked = mix(values, 99)
    owner = np.repeat(np.arange(len(ends)) * SIGNATURE, lengths)
    least = np.full(len(ends) * SIGNATURE, NONE, dtype=np.uint64)
    np.minimum.at(least, owner + (ranked >> np.uint64(58)).astype(np.int64), ranked & np.uint64((1 << 58) - 1))
    byte = (mix(least, 98) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return np.where(least == NONE, 0, byte).astype(np.uint8).reshape(len(ends), SIGNATURE)


def least_common(a: int, b: int, similarity: float) -> float:
    """K-mers that texts with ``a`` and ``b`` of them share at least if they are alike."""
    return similarity * (a + b) / (1 + similarity) - 1e-9


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the banded alignment of two sequences of unique k-mers reaches ``similarity``."""
    need = least_common(len(a), len(b), similarity)
    if min(len(a), len(b)) < need or not len(a):
        return False
    order = np.argsort(a)
    where = np.searchsorted(a[order], b)
    where[where == len(a)] = 0
    there = order[where]
    j = np.flatnonzero(a[there] == b)
    i = there[j]
    i = i[np.abs(i - j) <= max(len(a), len(b)) - need]
    if len(i) < need:
        return False
    if (i[1:] > i[:-1]).all():
        return True
    return longest_increasing(i) >= need


def longest_increasing(values: np.ndarray) -> int:
    from bisect import bisect_left

    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    tile_members: int = TILE_MEMBERS,
) -> DataFrame:
    """One row per input row: id, hash (of its text), class_id, class_hash (of the text that has it)."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.withColumn("hash", F.md5(F.encode("text", "UTF-8")))
    kind = texts.schema["id"].dataType.simpleString()

    @tidy
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            n = len(batch)
            size, keys = np.zeros(n, dtype=np.int64), np.zeros((n, SKETCHES), dtype=np.int64)
            marks = np.zeros((n, SIGNATURE), dtype=np.uint8)
            for at, to, values, ends in kmers(batch["text"].tolist(), hasher, words):
                size[at:to] = segments(ends)[1]
                keys[at:to] = sketches(values, ends).view(np.int64)
                marks[at:to] = signatures(values, ends)
            yield pd.DataFrame(
                {"id": batch["id"], "hash": batch["hash"], "size": size, "keys": list(keys), "marks": [m.tobytes() for m in marks]}
            )

    schema = f"id {kind}, hash string, size bigint, keys array<bigint>, marks binary"
    rows = store(texts.mapInPandas(sketch, schema), "sketches")
    classes = store(
        # Stored, so the numbers stay as they are; they don't depend on ids, which may be null or repeated.
        rows.groupBy("hash").agg(
            F.min("id").alias("low"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("marks").alias("marks")
        ).withColumn("rep", F.monotonically_increasing_id()),
        "text-classes",
    )
    members = _bucket_members(classes.where("size > 0"))
    links = _hub_links(texts, members, classes, similarity, words)
    joined = components(links)
    more = _tile_links(texts, members, classes, joined, similarity, words, tile_members)
    if not more.isEmpty():
        joined = components(links.union(more))
    linked = joined.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "low", "hash"), "rep")
    least = F.min(F.struct(F.col("low").isNull().alias("without"), "low", "hash"))
    least = store(linked.groupBy("component").agg(least.alias("least")), "least-ids")
    named = linked.join(least, "component").select("rep", "least")
    own = F.struct(F.col("low").isNull().alias("without"), "low", "hash")
    parts = store(
        classes.select("hash", "rep", "low").join(named, "rep", "left").select(
            "hash", F.coalesce("least", own).alias("least")
        ).select("hash", F.col("least.low").alias("class_id"), F.col("least.hash").alias("class_hash")),
        "class-ids",
    )
    return rows.select("id", "hash").join(parts, "hash", "left")


def _bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, rep) of all buckets of two texts or more, with the size of the bucket."""
    keys = classes.select("rep", F.posexplode("keys").alias("sketch", "key"))
    keys = keys.select("rep", F.col("key").alias("bucket"))
    sizes = store(keys.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "bucket-sizes")
    return store(keys.join(sizes, "bucket"), "bucket-members")


def _hub_links(texts: DataFrame, members: DataFrame, classes: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b): texts that are alike a hub of one of their buckets."""
    fame = members.groupBy("rep").agg(F.sum(F.log(F.col("members").cast("double"))).alias("fame"))
    famed = members.join(store(fame, "fame"), "rep")
    hubs = store(
        famed.groupBy("bucket").agg(F.max(F.struct("fame", F.col("rep").alias("hub"))).alias("best")), "hubs"
    ).select("bucket", F.col("best.hub").alias("hub"))
    pairs = members.join(hubs, "bucket").where("rep <> hub").select("rep", "hub").distinct()
    marks = classes.select("rep", "size", "marks")
    pairs = pairs.join(marks, "rep").join(
        marks.select(F.col("rep").alias("hub"), F.col("size").alias("hub_size"), F.col("marks").alias("hub_marks")), "hub"
    )
    fits = F.least("size", "hub_size") >= similarity * F.greatest("size", "hub_size")
    pairs = store(pairs.where(fits & similar_marks(F.col("marks"), F.col("hub_marks"))).select("rep", "hub"), "hub-pairs")
    wanted = pairs.select("rep").union(pairs.select(F.col("hub").alias("rep"))).distinct()
    known = store(_all_kmers(texts, classes, wanted, words), "kmers")
    both = pairs.join(known, "rep").join(known.select(F.col("rep").alias("hub"), F.col("kmers").alias("hub_kmers")), "hub")
    kind = classes.schema["rep"].dataType.simpleString()

    @tidy
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alike = [
                aligned(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), similarity)
                for x, y in zip(batch["kmers"], batch["hub_kmers"], strict=True)
            ]
            yield batch.loc[np.array(alike, dtype=bool), ["rep", "hub"]].rename(columns={"rep": "a", "hub": "b"})

    return store(both.select("rep", "hub", "kmers", "hub_kmers").mapInPandas(verify, f"a {kind}, b {kind}"), "hub-links")


def similar_marks(a, b):
    """Whether enough of two signatures agrees; classes that neither text fills don't count."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), SIGNATURE)
        y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(b), SIGNATURE)
        filled = ((x > 0) | (y > 0)).sum(axis=1)
        return pd.Series(((x == y) & (x > 0)).sum(axis=1) >= LEAST_SHARE * filled - 1)

    return similar(a, b)


def _all_kmers(texts: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, kmers) of the texts ``wanted``, one row each."""
    chosen = classes.select("rep", F.col("hash").alias("rep_hash"), F.col("low").alias("id"))
    chosen = store(chosen.join(wanted, "rep", "left_semi"), "wanted")
    rows = possible_rows(texts, chosen, "id")
    same = (rows["hash"] == chosen["rep_hash"]) & rows["id"].eqNullSafe(chosen["id"])
    found = rows.join(chosen, same).select("rep", "text")

    @tidy
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            out = []
            for _, _, values, ends in kmers(batch["text"].tolist(), hasher, words):
                out += [values[s : s + n].tobytes() for s, n in zip(*segments(ends), strict=True)]
            yield pd.DataFrame({"rep": batch["rep"], "kmers": out})

    computed = found.mapInPandas(compute, "rep bigint, kmers binary")
    return computed.groupBy("rep").agg(F.first("kmers").alias("kmers"))


def _tile_links(
    texts: DataFrame, members: DataFrame, classes: DataFrame, joined: DataFrame, similarity: float, words: int, tile_members: int
) -> DataFrame:
    """(a, b): what the buckets that hold several classes have in common beyond their hubs."""
    kind = classes.schema["rep"].dataType.simpleString()
    labels = joined.select(F.col("node").alias("rep"), "component")
    labelled_members = members.join(labels, "rep", "left")
    labelled_members = store(
        labelled_members.select("bucket", "members", "rep", F.coalesce("component", "rep").alias("component")), "labelled"
    )
    mixed = labelled_members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = store(mixed.where("low <> high").select("bucket"), "mixed-buckets")
    rest = labelled_members.join(mixed, "bucket", "left_semi")
    narrow = rest.join(classes.select("rep", "size", "marks"), "rep")

    def flag(tile: pd.DataFrame) -> pd.DataFrame:
        left, right = tile[tile["side"] != 2], tile[tile["side"] != 1]
        marks = [np.frombuffer(b"".join(t["marks"]), dtype=np.uint8).reshape(len(t), SIGNATURE) for t in (left, right)]
        sizes = [t["size"].to_numpy() for t in (left, right)]
        component = [t["component"].to_numpy() for t in (left, right)]
        hit = [np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)]
        step = max(1, (1 << 19) // max(1, len(right)))
        for at in range(0, len(left), step):
            some = slice(at, at + step)
            short = np.minimum(sizes[0][some, None], sizes[1][None, :])
            close = short >= similarity * np.maximum(sizes[0][some, None], sizes[1][None, :])
            close &= component[0][some, None] != component[1][None, :]
            i, j = np.nonzero(close)
            for k in range(0, len(i), 1 << 18):
                a, b = i[k : k + (1 << 18)] + at, j[k : k + (1 << 18)]
                x, y = marks[0][a], marks[1][b]
                good = ((x == y) & (x > 0)).sum(axis=1) >= LEAST_SHARE * ((x > 0) | (y > 0)).sum(axis=1) - 1
                hit[0][a[good]] = True
                hit[1][b[good]] = True
        return pd.concat([left[hit[0]], right[hit[1]]])[["bucket", "rep", "component", "members"]].drop_duplicates("rep")

    schema = f"bucket bigint, rep {kind}, component {kind}, members bigint"
    tiles = in_tiles(narrow, "members", tile_members)
    flagged = tiles.groupBy("bucket", "first_part", "second_part").applyInPandas(flag, schema)
    flagged = store(flagged.distinct(), "flagged")
    if flagged.isEmpty():
        return flagged.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    known = _all_kmers(texts, classes, flagged.select("rep").distinct(), words)
    # Members are dealt to parts by hash, so their bytes per part follow their number.
    sizes = flagged.select("bucket", "rep").join(classes.select("rep", "size"), "rep")
    counts = store(sizes.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("kmers")), "flagged-sizes")
    by_bytes = F.ceil(F.col("kmers") * 8 / TILE_BYTES * tile_members)
    counts = counts.select("bucket", F.greatest("n", by_bytes).cast("bigint").alias("members"))
    full = flagged.drop("members").join(counts, "bucket").join(known, "rep")
    tiles = in_tiles(full, "members", tile_members)

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.drop_duplicates("rep").reset_index(drop=True)
        sequences = [np.frombuffer(k, dtype=np.uint64) for k in tile["kmers"]]
        _, start = np.unique(tile["component"], return_inverse=True)
        roots = alike_sets(sequences, start, similarity)
        rep = tile["rep"].to_numpy()
        told = np.flatnonzero(roots != np.arange(len(tile)))
        if len(tile) > 256:
            release()
        return pd.DataFrame({"a": rep[told], "b": rep[roots[told]]})

    found = tiles.groupBy("bucket", "first_part", "second_part").applyInPandas(compare, f"a {kind}, b {kind}")
    return store(found, "tile-links")


def in_tiles(members: DataFrame, size: str, tile_members: int) -> DataFrame:
    """Members with the parts of their bucket that each meets: all parts meet each other once.

    ``side`` is 1 and 2 where a tile compares two parts, 0 where it compares one with itself.
    A bucket within the size is one tile, in which every row is on both sides. Rows are few
    and work on them is much, so they are dealt out to all partitions whatever their size.
    """
    parts = F.ceil(F.col(size) / tile_members).cast("int")
    own = F.expr("cast(pmod(xxhash64(rep), parts_) as int)")
    split = members.withColumn("parts_", parts).withColumn("own_", own)
    split = split.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
    side = F.when(F.col("own_") == F.col("other_"), 0).when(F.col("own_") < F.col("other_"), 1).otherwise(2)
    return split.select(
        *members.columns,
        F.least("own_", "other_").alias("first_part"),
        F.greatest("own_", "other_").alias("second_part"),
        side.alias("side"),
    ).repartition(partitions(members.sparkSession), "bucket", "first_part", "second_part")


def alike_sets(sequences: list[np.ndarray], start: np.ndarray, similarity: float) -> np.ndarray:
    """Sets of sequences joined by being alike, as the smallest index of each set.

    Each sequence is counted against all earlier ones at once, by the lists of sequences that
    hold its k-mers. ``start`` names sets that are joined already; nothing inside a set is
    compared.
    """
    sizes = np.array([len(s) for s in sequences])
    roots = np.arange(len(sequences))
    first = np.full(start.max() + 1 if len(start) else 0, len(sequences))
    np.minimum.at(first, start, roots)
    roots = first[start]
    ends = np.cumsum(sizes)
    values = np.concatenate(sequences)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del values, ordered
    # Equal k-mers lie together, by sequence; those of earlier sequences lie from `first` to `place`.
    holders = np.repeat(np.arange(len(sequences), dtype=np.int32), sizes)[order]
    place, first = np.empty(len(order), dtype=np.int32), np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    first[order] = np.flatnonzero(new).astype(np.int32)[np.cumsum(new) - 1]
    del order, new
    for n in range(1, len(sequences)):
        if (roots[:n] == roots[n]).all():
            continue
        mine = slice(ends[n] - sizes[n], ends[n])
        counts = place[mine] - first[mine]
        upto = np.cumsum(counts, dtype=np.int64)
        if not len(upto) or not upto[-1]:
            continue
        at = np.repeat(first[mine] - (upto - counts), counts) + np.arange(upto[-1])
        common = np.bincount(holders[at], minlength=n)
        enough = np.flatnonzero(common >= similarity * (sizes[:n] + sizes[n]) / (1 + similarity) - 1e-9)
        for m in enough[np.argsort(-common[enough], kind="stable")]:
            if roots[m] != roots[n] and aligned(sequences[m], sequences[n], similarity):
                join_roots(roots, np.array([m]), np.array([n]))
    return roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each class, with all columns of ``docs``."""
    classes = near_duplicate_classes(docs, id_col, text_col, **options)
    stays = classes.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("hash") == F.col("class_hash")))
    stays = stays.groupBy("id", "hash").agg(F.count("*").alias("rows"))
    return matching_rows(docs, stays, id_col, F.md5(F.encode(text_or_empty(text_col), "UTF-8")))
