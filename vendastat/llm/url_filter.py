"""URL filter: glob rules in a bit-parallel Shift-And automaton.

All globs are laid side by side in one long bit vector, spread over as many 64-bit words as
they need. Bit j of a glob says that its first j symbols are matched. Reading one character c
moves every glob at once::

    state = (state << 1) & steps[c] | state & stays[c]

``steps[c]`` marks the symbols that accept c, ``stays[c]`` the wildcards that swallow it, and
the top bit of each word is carried into the next. Many URLs are read side by side, so one
array operation moves all globs of a batch by one character.

Glob syntax, on the canonical URL (host in lower case, then path): ``?`` is one character and
``*`` any run of characters; before the first ``/`` of the glob neither crosses a ``/``, so a
wildcard in the host never reaches into the path. ``**`` is any run of characters anywhere.
Everything else stands for itself.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no host
rule fits. Very long URLs cost one step per byte and no padding. Repeated rows are judged each;
an empty table gives an empty result. Rules are a parameter, so their number is bounded by it;
they travel to the tasks as a table of 256 masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A host and path prefix with its verdict; fits the host and all its subdomains."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.name}**", f"*.{self.name}**"]


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Blocked where no rule fits.
SPAM_GLOBS = ("*casino**", "*free-bets**", "*cheap-pills**", "*ads-track**")
#: Bytes of automaton state handled at once.
STATE_BYTES = 1 << 23


class ShiftAnd:
    """The automaton of a list of globs."""

    def __init__(self, globs: list[str]) -> None:
        symbols = [_symbols(g) for g in globs]
        sizes = [len(s) + 1 for s, _ in symbols]
        self.words = max(1, -(-sum(sizes) // 64))
        self.steps = np.zeros((256, self.words), dtype=np.uint64)
        self.stays = np.zeros((256, self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.accepts = []
        first = 0
        for (single, loops), size in zip(symbols, sizes, strict=True):
            self._set(self.start, first)
            for j, accepted in enumerate(single):
                for c in accepted:
                    self._set(self.steps[c], first + j + 1)
            for j, swallowed in loops.items():
                for c in swallowed:
                    self._set(self.stays[c], first + j)
            self.accepts.append(divmod(first + size - 1, 64))
            first += size

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Whether each glob matches each whole text: texts x globs."""
        out = np.zeros((len(texts), len(self.accepts)), dtype=bool)
        rows = max(1, STATE_BYTES // (8 * self.words))
        for at in range(0, len(texts), rows):
            out[at : at + rows] = self._run(texts[at : at + rows])
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t))  # texts longer than t come first
            c = data[starts[:live] + t]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.steps[c]) | (now & self.stays[c])
        found = np.stack([(state[:, w] >> np.uint64(b)) & one for w, b in self.accepts], axis=1).astype(bool)
        out = np.empty_like(found)
        out[order] = found
        return out


def _symbols(glob: str) -> tuple[list[list[int]], dict[int, list[int]]]:
    """Bytes accepted by each symbol, and bytes swallowed by the wildcard behind j symbols."""
    data, single, loops = glob.encode(), [], {}
    everything = list(range(256))
    in_host = [c for c in everything if c != ord("/")]
    at, host = 0, True
    while at < len(data):
        c = data[at]
        if data[at : at + 2] == b"**":
            loops[len(single)] = everything
            at += 1
        elif c == ord("*"):
            loops.setdefault(len(single), in_host if host else everything)
        elif c == ord("?"):
            single.append(in_host if host else everything)
        else:
            host = host and c != ord("/")
            single.append([c])
        at += 1
    return single, loops


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first ``://``, A to Z in lower case, and path; empty where there is none."""
    place = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(place > 0, url.substr(place + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, spam_globs=SPAM_GLOBS, default: str = "allow"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    Of the rules that fit the longest wins, the first of equally long ones. Where none fits,
    a spam glob blocks, and anything else gets the default.
    """
    rules, spam_globs = [Rule(*r) for r in rules], list(spam_globs)
    globs = [g for r in rules for g in r.globs()] + spam_globs
    machine = ShiftAnd(globs)
    by_length = sorted(range(len(rules)), key=lambda i: (len(rules[i].name), -i))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = machine.run([(h + p).encode() for h, p in zip(batch["host"], batch["path"], strict=True)])
            rule = np.full(len(batch), None, dtype=object)
            verdict = np.full(len(batch), default, dtype=object)
            verdict[found[:, 2 * len(rules) :].any(axis=1)] = "block"
            for i in by_length:
                fits = found[:, 2 * i] | found[:, 2 * i + 1]
                rule[fits], verdict[fits] = rules[i].name, rules[i].verdict
            batch["rule"], batch["verdict"] = rule, verdict
            yield batch

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kind = urls.schema["id"].dataType.simpleString()
    return urls.mapInPandas(judge, f"id {kind}, host string, path string, rule string, verdict string")
