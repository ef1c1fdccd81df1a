"""Best-fit packing, fill-in-the-middle and conversation repair against plain versions of themselves."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vendastat.llm import best_fit_packing, conversation_repair, fill_in_middle
from vendastat.llm.queries import BYTE_TOKENIZER, QUERIES, TOKENIZER

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def reference_repair(rows):
    """Shortest way through (rows passed, state) by cost and then audit, and the counts, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        letters = SPACE.findall(text)
        fault = "" if letters and letters[-1] in ".!?" else "truncated"
        fault = "duplicate" if (role, text) in seen else fault
        faults.append(fault if letters else "blank")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            break
        if (at, state) in done:
            continue
        # Equal costs are told apart by the whole audit, so a state is only left once it is least.
        done.add((at, state))
        steps = []
        if at < len(rows):
            _, role, text = rows[at]
            steps.append((2, "D", at + 1, state, kept))
            if faults[at] in ("", "truncated"):
                extra = 5 * (faults[at] == "truncated")
                if (state, role[:1]) in after:
                    steps.append((extra, "K", at + 1, role[0], (*kept, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in after:
                        steps.append((1 + extra, "R", at + 1, new[0], (*kept, (new, text))))
        for new in ("user", "assistant"):
            if (state, new[0]) in after:
                steps.append((5, "I", at, new[0], (*kept, (new, ""))))
        for more, letter, to, then, rest in steps:
            heapq.heappush(heap, (cost + more, audit + letter, to, then, rest))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = zip([r[1][:1] for r in rows], [r[1][:1] for r in rows][1:])
    count = collections.Counter(faults)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": count["blank"], "duplicate": count["duplicate"], "truncated": count["truncated"],
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        part = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20, part(role), part(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def by_conversation(df):
    rows = df.collect()
    found = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in rows}
    assert len(found) == len(rows)
    return found


def test_repair_of_all_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DATA}/conversations.parquet'").fetchall()
    want = {conv: reference_repair(some) for conv, some in damaged(rows).items()}
    assert by_conversation(QUERIES["op13_conversation_repair"](spark, DATA)) == want


@pytest.fixture(scope="module")
def wild():
    """Short conversations of every kind, with nulls, odd roles, gaps, repeats and equal rows."""
    rng = random.Random(7)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Yes.", None, "ends so?  \n", "é…", "x" * 5000 + "."]
    roles = ["system", "user", "assistant", "tool", "User", None, "u", "sys"]
    rows = []
    for conv in [None, *range(400)]:
        for _ in range(rng.randint(1, 9)):
            row = (conv, rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(roles), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(1000, n, "user", f"{n}.") for n in range(700)] + [(1001, 5, "user", "same.")] * 300
    rows += [(1002, n, ["user", "assistant"][n % 2], ["Ok.", "open", ""][n % 3]) for n in range(500)]
    return rows


@pytest.mark.parametrize("giant_bytes", [1 << 24, 600, 0])
def test_repair_of_wild_conversations(spark, wild, giant_bytes):
    """The same results whether conversations are held in memory or spread over ranges."""
    df = spark.createDataFrame(wild, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", "1 AS key", "2 AS place", "'x' AS kind", "3 AS fault", "4 AS `range`")
    df = conversation_repair.damage(df.repartition(7))
    got = by_conversation(conversation_repair.repair_conversations(df, present_col="present", giant_bytes=giant_bytes))
    want = {conv: reference_repair(some) for conv, some in damaged(wild).items()}
    assert got == want


def test_repaired_rows_are_what_is_digested(spark, wild):
    df = spark.createDataFrame(wild, "conv_id bigint, turn bigint, role string, text string")
    want = by_conversation(conversation_repair.repair_conversations(df))
    for giant_bytes in (1 << 24, 600):
        found = collections.defaultdict(list)
        for r in conversation_repair.repaired_rows(df, giant_bytes=giant_bytes).collect():
            found[r["conv_id"]].append((r["place"], r["edit"], r["role"], r["text"]))
        for conv, summary in want.items():
            rows = sorted(found[conv])
            assert [r[0] for r in rows] == list(range(len(rows)))
            lines = "\n".join(f"{role}:{text}" for _, _, role, text in rows)
            assert hashlib.sha256(lines.encode()).hexdigest() == summary["repaired_sha256"]
            assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in rows))


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_repair.repair_conversations(none).collect() == []
    assert conversation_repair.repaired_rows(none).collect() == []


def test_runs_pass_as_their_rows_do():
    end = (0, 10, 5, 0)
    for code in range(16):
        one = end
        for n in range(1, 40):
            matrix = conversation_repair.power(code, 0)
            one = tuple(min(matrix[i][j] + one[j] for j in range(4)) for i in range(4))
            assert conversation_repair.before_run(code, n, end) == one


def test_long_conversation_in_short_time():
    codes = bytes([4, 8] * 3 + [4] * 200_000 + [6] * 1000 + [9] * 5000)
    cost, choices = conversation_repair.cheapest(codes)
    assert choices.count("D") >= 1000 and len(choices) >= len(codes) and cost > 0


# Fill-in-the-middle: the SQL covers the query.


def test_forms_and_round_trip():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab <>PSM>é中𝒳\n") for _ in range(rng.randint(1, 30)))
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        want = {
            "plain": text,
            "psm": f"<P>{prefix}<S>{suffix}<M>{middle}",
            "spm": f"<S>{suffix}<P>{prefix}<M>{middle}",
        }
        for form, output in want.items():
            assert fill_in_middle.transform(text, a, b - a, form) == output
            assert fill_in_middle.restore(output, form) == text


def test_middle_of_odd_texts(spark):
    texts = [None, "", "<P>", "a<S>b", "plain", "é", "x" * 3_000_000, "中文 " * 100_000]
    rows = [(i, t, "other", 5) for i, t in enumerate(texts)] + [(None, "no id", "o", 5), (4, "plain", "o", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, output string, n int")
    out = fill_in_middle.fill_in_middle(df, transformed_pct=100)
    out = out.withColumn("back", fill_in_middle.restored("output", "form")).collect()
    assert len(out) == 10 and all(r["back"] == r["text"] and r["n"] == len(r["text"]) for r in out)
    plain = [r for r in out if r["form"] == "plain"]
    assert sorted(r["id"] for r in plain) == [0, 1, 2, 3] and all(r["prefix_chars"] is None for r in plain)
    assert all(len(r["output"]) == r["n"] + 9 for r in out if r["form"] != "plain")
    assert len({r["output"] for r in out if r["id"] == 4}) == 1
    assert fill_in_middle.fill_in_middle(df.limit(0)).collect() == []


# Best-fit packing


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(BYTE_TOKENIZER)
    made.encode_special_tokens = True
    return made


def check_packing(pieces, capacity):
    """Sequences are filled without gaps or overlaps; how many there are."""
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_all_documents(spark, tokenizer):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())
    pieces = QUERIES["op11_best_fit_packing"](spark, DATA).toPandas().to_dict("records")
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    used = check_packing(pieces, 2048)
    assert used <= 1.01 * sum(map(len, want.values())) / 2048 + 1
    got = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["piece"])):
        got[p["doc_id"]].append(p)
    assert got.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for n, p in enumerate(got[i]):
            assert (p["piece"], p["start"]) == (n, at)
            part = np.array(ids[at : at + p["length"]], dtype="<u4")
            assert p["ids_crc32"] == zlib.crc32(part)
            assert p["length"] == 2048 or n == 0
            at += p["length"]
        assert at == len(ids) and (len(got[i]) == 1) == (len(ids) <= 2048)


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "long text " * 900), (3, "long text " * 900), (4, "one two three " * 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"nth": F.lit(9), "length": F.lit(1)})
    out = best_fit_packing.sequences(df.repartition(3), BYTE_TOKENIZER, sequence_tokens=256).collect()
    whole = [i for r in out for i in np.frombuffer(r["ids"], dtype="<u2").tolist()]
    want = [i for _, t in rows for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]]
    assert collections.Counter(whole) == collections.Counter(want)
    assert all(r["tokens"] * 2 == len(r["ids"]) and r["tokens"] <= 256 for r in out)
    assert best_fit_packing.pack(df.limit(0), BYTE_TOKENIZER).collect() == []


def test_words_are_cut_where_the_tokenizer_cuts(tokenizer):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "é", "中", " ", "'s", "1", "!", "\t", " the", "　", "\x1c", "\x85", "don't", "<|endoftext|>", "ж"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    tokens = best_fit_packing.ByteTokens(BYTE_TOKENIZER)
    assert tokens.by_words and tokens.fast
    assert list(tokens.encode(texts)) == want
    tokens.fast = None
    tokens._forget()
    assert list(tokens.encode(texts)) == want
    assert list(tokens.encode(["", ""])) == [b"", b""]


def test_other_tokenizers_get_whole_texts():
    tokens = best_fit_packing.ByteTokens(TOKENIZER)
    assert not tokens.by_words
    text = "Some TEXT, with  words."
    ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(tokens.encode([text])) == [np.array(ids, dtype=tokens.kind).tobytes()]


def carried_out(plan):
    """The sequences that the moves of a plan make, as lists of (place, length)."""
    made = collections.defaultdict(list)
    numbers = collections.defaultdict(list)
    for size, first, n, sequence, offset in plan.moves:
        numbers[size] += range(first, first + n)
        for k in range(n):
            made[sequence + k].append((offset, size))
    for size, seen in numbers.items():
        assert sorted(seen) == list(range(plan.taken[size]))
    return made


def test_plans():
    rng = random.Random(5)
    for capacity in (1, 2, 10, 64):
        for _ in range(150):
            histogram = {s: rng.randint(0, 40) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
            plan = best_fit_packing.Plan(histogram, capacity)
            assert {s: n for s, n in histogram.items() if n} == {s: n for s, n in plan.taken.items() if n}
            made = carried_out(plan)
            assert len(made) == plan.sequences
            for spans in made.values():
                at = 0
                for offset, size in sorted(spans):
                    assert offset == at
                    at += size
                assert at <= capacity
                assert sum(3 * size > capacity for _, size in spans) <= 2
            assert plan.sequences <= best_fit_decreasing(histogram, capacity) + 1


def best_fit_decreasing(histogram, capacity):
    gaps = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - size)
    return len(gaps)


def test_matching_of_large_pieces_is_best():
    """With pieces above a third only, the plan makes as many pairs as any matching does."""
    rng = random.Random(11)
    for _ in range(200):
        sizes = [rng.randint(4, 10) for _ in range(rng.randint(1, 8))]
        plan = best_fit_packing.Plan(collections.Counter(sizes), 10)
        best = 0
        for order in itertools.permutations(range(len(sizes))) if len(sizes) <= 6 else ():
            pairs = sum(sizes[a] + sizes[b] <= 10 for a, b in zip(order[::2], order[1::2]))
            best = max(best, pairs)
        if len(sizes) <= 6:
            assert plan.sequences == len(sizes) - best
