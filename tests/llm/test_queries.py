"""Registered queries against their SQL, or against a brute-force version where there is none."""

import collections
import json
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from vendastat.llm import order_minhash, packing
from vendastat.llm.arrays import mix
from vendastat.llm.queries import ORACLE_SQL, QUERIES, TOKENIZER

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def run(spark, name):
    return QUERIES[name](spark, DATA).toPandas()


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = run(spark, name), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def whole(value):
        return int(value) if isinstance(value, float) and value.is_integer() else value  # nulls make floats of integers

    def rows(df):
        values = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
        return sorted(repr([whole(v) for v in row]) for row in values)

    assert rows(got) == rows(want)


def labelled(text):
    words = text.lower().split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    seen, out = collections.Counter(), []
    for gram in grams:
        out.append((gram, seen[gram]))
        seen[gram] += 1
    return out


def roots_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_minhash_classes(spark, texts):
    got = run(spark, "op1_order_minhash").set_index("doc_id")["class_id"].to_dict()
    ids, grams = sorted(texts), {i: labelled(texts[i]) for i in texts}
    pairs = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] == texts[b]:
                pairs.append((a, b))
                continue
            place = {g: i for i, g in enumerate(grams[a])}
            order = [place[g] for g in grams[b] if g in place]
            total = len(grams[a]) + len(grams[b])
            if order and len(order) / (total - len(order)) >= 0.8:
                m = order_minhash.longest_increasing(np.array(order))
                if m / (total - m) >= 0.8:
                    pairs.append((a, b))
    assert got == roots_of(pairs, ids)


def plain_hilbert(point, bits):
    """The place of one point, by walking down the cells of the curve with whole coordinates."""
    x, dims = list(point), len(point)
    level = 1 << (bits - 1)
    while level > 1:
        for d in range(dims):
            if x[d] & level:
                x[0] ^= level - 1
            else:
                swap = (x[0] ^ x[d]) & (level - 1)
                x[0] ^= swap
                x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip, level = 0, 1 << (bits - 1)
    while level > 1:
        flip ^= level - 1 if x[-1] & level else 0
        level >>= 1
    x = [v ^ flip for v in x]
    bit_by_bit = "".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x)
    return int(bit_by_bit, 2)


def check_shards(got, texts, shards=24):
    sizes = got.groupby("shard").size()
    assert sorted(sizes.index) == list(range(shards)) and sizes.max() - sizes.min() <= 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    ordered = got.sort_values(["shard", "slot"])
    assert ordered["curve_index"].is_monotonic_increasing
    groups = got.assign(text=got["doc_id"].map(texts)).groupby("text")
    assert (groups["curve_index"].nunique() == 1).all()
    divided = groups["shard"].agg(["nunique", "min", "max"])
    # A group lies in neighbouring shards, and each cut falls into one group at most.
    assert (divided["max"] - divided["min"] + 1 == divided["nunique"]).all()
    assert (divided["nunique"] - 1).sum() <= shards - 1
    return divided


def test_shards(spark, texts, duck):
    got = run(spark, "op2_hilbert_shards")
    assert sorted(got["doc_id"]) == sorted(texts)
    check_shards(got, texts)
    for r in got.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))


def test_curve_of_all_documents(spark, texts, duck):
    """Coordinates made again by hand; every text is placed by its smallest id."""
    from pyspark.sql import functions as F

    from vendastat.llm import hilbert_sharding as sharding

    got = run(spark, "op2_hilbert_shards").set_index("doc_id")["curve_index"]
    rows = duck.execute("SELECT doc_id, source, lang FROM documents ORDER BY doc_id").fetchall()
    hashes = spark.createDataFrame([(n,) for n in sorted({v for r in rows for v in r[1:]})], "n string")
    place = {r["n"]: r["h"] for r in hashes.select("n", F.pmod(F.xxhash64("n"), F.lit(32)).alias("h")).collect()}
    sizes = np.array(sorted(len(t.encode()) + 8 for t in texts.values()))
    cuts = [sizes[int(np.ceil(k / 32 * len(sizes))) - 1] for k in range(1, 32)]
    first = {}
    for doc_id, source, lang in rows:
        first.setdefault(texts[doc_id], (place[source], place[lang]))
    assert sharding.BITS == 5
    for doc_id, text in texts.items():
        size = len(text.encode()) + 8
        point = (*first[text], sum(c <= size for c in cuts))
        assert got[doc_id] == plain_hilbert(point, 5)


def test_mix(spark, duck, texts):
    import re

    got = run(spark, "op3_water_filling_mix").set_index("doc_id")
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert got["size"].to_dict() == words
    assert (got["taken"] <= 2 * got["size"]).all()
    names = sorted(set(source.values()))
    sizes = {s: sum(words[i] for i in words if source[i] == s) for s in names}
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    free, left, target = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weights[s] * level for s in free}
    for s in names:
        mine = got[[source[i] == s for i in got.index]]
        assert mine["target"].iloc[0] == pytest.approx(target[s])
        assert abs(mine["taken"].sum() - target[s]) <= mine["size"].max()


def test_secrets(spark):
    """Base kinds by the patterns as stated, matched in full and then filtered."""
    import hashlib
    import re

    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op4_secret_scan"](spark, folder).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(texts) and got["n_assign"].sum() > 0 and got["n_hex"].sum() > 0
    any_case = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"({any_case})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for i, text in texts.items():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        want = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        row = got.loc[i]
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == n for _, k, _ in found) for n in range(3)]
        assert set(want.split(",")) <= set(row["spans"].split(","))


def test_packed_pieces(spark, texts):
    from tokenizers import Tokenizer

    got = run(spark, "op6_curve_packing")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for i, rows in got.sort_values("start").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids + [2], dtype="<u4")
        assert (rows["doc_tokens"] == len(ids)).all() and rows["length"].sum() == len(ids)
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(got["doc_id"]) == set(texts)
    lengths = []
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows["offset"]) == list(rows["length"].cumsum() - rows["length"])
        lengths.append(rows["length"].sum())
    assert lengths[:-1] == [4096] * (len(lengths) - 1) and lengths[-1] <= 4096


def test_language_on_held_out_documents(spark, duck):
    got = run(spark, "op8_language_id")
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    out = got[got["held_out"]]
    assert (out["lang_pred"] == out["doc_id"].map(lang)).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_pipeline_stage_by_stage(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, DATA), "test")
        assert docs.columns == columns
        kept[name] = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert len(kept["language ID"]) >= 0.98 * len(texts)
    copies = [texts[i].translate({c: c + 32 for c in range(65, 91)}) for i in kept["exact dedup"]]
    assert len(copies) == len(set(copies)) and set(kept["exact dedup"].values()) == {1}
    assert set(kept["MinHash near-dedup"]) <= set(kept["exact dedup"])
    assert max(kept["mixing"].values()) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert pieces["length"].sum() == pieces.loc[pieces["start"] == 0, "doc_tokens"].sum()
    assert (pieces["start"] == 0).sum() == sum(kept["mixing"].values())


def test_tokens_of_odd_texts():
    tokens = packing.Tokens(TOKENIZER)
    odd = ["", " ", "a b  c\x1cd é ́x ΑΣ ΑΣ. ok\x85z don't 's <|endoftext|> x\r\ny", "日本 語\t한국  ", "C. c, c,. ... a\x0bb\x0cc"]
    for _ in range(2):
        for text, ids in zip(odd, tokens.encode(odd), strict=True):
            want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, dtype=tokens.kind).tolist() == want


def test_plain_words_need_no_offsets(monkeypatch):
    tokens = packing.Tokens(TOKENIZER)

    def refuse(words):
        raise AssertionError(words)

    monkeypatch.setattr(tokens, "_encode_words", refuse)
    monkeypatch.setattr(packing, "MEMO_WORDS", 300)  # forgotten and learnt again
    monkeypatch.setattr(packing, "BATCH_CHARACTERS", 4000)
    rng = np.random.default_rng(6)
    letters = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x180)) if c not in (0xD7, 0xF7, 0x130)]
    texts = [" ".join("".join(rng.choice(letters, n)) for n in rng.choice([1, 3, 9, 150], 20)) for _ in range(60)]
    texts += ["It's 'RE x''s we'LL 1234 Ab.Cd...", "Anblewh sttible, of the Anblewh.", "ab" * 3000, "!" * 500, ""]
    for text, ids in zip(texts, tokens.encode(texts), strict=True):
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype=tokens.kind).tolist() == want


def test_only_vocabularies_whose_tokens_all_come_out_are_encoded_by_pieces():
    from tokenizers import Tokenizer

    parts = json.loads(Tokenizer.from_file(TOKENIZER).to_str()) | {"added_tokens": []}
    symbols = [c + end for end in ("", packing.MARK) for c in packing.byte_of()]

    def made(merges):
        words = symbols + ["".join(m) for m in merges]
        parts["model"] |= {"vocab": {w: i for i, w in enumerate(words)}, "merges": merges}
        return packing.PieceEncoder.of(Tokenizer.from_str(json.dumps(parts)))

    assert made([["b", "c"], ["a", "b"]]) is not None
    assert made([["b", "c"], ["a", "b"], ["ab", "c"]]) is None  # abc gives a and bc
    assert packing.PieceEncoder.of(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))) is None


def test_memo_knows_what_it_was_told():
    rng = np.random.default_rng(4)
    words, others = np.split(mix(np.arange(200_000, dtype=np.uint64)), 2)
    counts = rng.integers(1, 4, len(words))
    ids, memo, at = rng.integers(0, 1 << 16, counts.sum()).astype("<u2"), packing.Memo(np.dtype("<u2")), 0
    assert (memo.places(words) == -1).all()
    for some, n in zip(np.array_split(words, 7), np.array_split(counts, 7), strict=True):
        memo.add(some, n, ids[at : at + n.sum()])
        at += n.sum()
    found, lengths = memo.ids(memo.places(words))
    assert (found == ids).all() and (lengths == counts).all()
    assert (memo.places(others) == -1).all()
