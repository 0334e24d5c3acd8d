"""Evaluation texts leaking into training text, by a generalised suffix automaton of the test items.

The automaton is built over the word sequences of all items; it recognises exactly the word sequences that occur in
some item. A text streams through it word by word, keeping the longest match that ends at each word. Where a match
reaches the required length, the state's items are those that hold it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled
from lodestrata.session import spread

WORD = re.compile(r"[^\W_]+")
LEAKS = "array<struct<item_id: long, spans: array<struct<from_word: int, to_word: int>>, words: int>>"


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences, with the set of sequences that reach each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set[int]] = [set()]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """Clone of q for the shorter strings that reach it through p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, tokens: list[int], item: int) -> None:
        """Insert one sequence from the root, reusing states that exist."""
        last = 0
        for token in tokens:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
                last = new
            self.items[last].add(item)

    def finish(self, least: int) -> None:
        """Carry items up the suffix links and note for each state the ancestor that holds its last `least` tokens."""
        order = np.argsort(-np.array(self.length), kind="stable")
        for s in order:
            if self.link[s] > 0:
                self.items[self.link[s]] |= self.items[s]
        self.holder = [-1] * len(self.length)
        for s in order[::-1]:
            if self.length[s] >= least:
                up = self.link[s]
                self.holder[s] = s if self.length[up] < least else self.holder[up]


class Matcher:
    """The automaton of a set of (item id, text), over their own vocabulary."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.machine = SuffixAutomaton()
        for ident, text in items:
            words = WORD.findall(text.lower())
            self.machine.add([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], ident)
        self.machine.finish(least)

    def runs(self, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of at least `least` words that all occur in some item; only there can a match lie."""
        known = self.vocabulary
        flags = np.fromiter((w in known for w in words), dtype=np.int8, count=len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, flags, 0]))
        return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= self.least]

    def spans(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each item the disjoint word spans [from, to) covered by matches of at least `least` words."""
        step, link, length, holder, items = self.machine.next, self.machine.link, self.machine.length, self.machine.holder, self.machine.items
        found: dict[int, list[tuple[int, int]]] = {}
        for a, b in self.runs(words):
            state, matched = 0, 0
            for i in range(a, b):
                token = self.vocabulary[words[i]]
                to = step[state].get(token)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step[state].get(token)
                if to is None:
                    matched = 0
                    continue
                state = to
                matched += 1
                if matched >= self.least:
                    begin = i + 1 - self.least
                    for item in items[holder[state]]:
                        own = found.setdefault(item, [])
                        if own and begin <= own[-1][1]:
                            own[-1] = (own[-1][0], i + 1)
                        else:
                            own.append((begin, i + 1))
        return found


def _cleaned(text: str, spans: list[tuple[int, int]], most_cover: float) -> str | None:
    at = [m.span() for m in WORD.finditer(text.lower())]
    covered = np.zeros(len(at), dtype=bool)
    for a, b in spans:
        covered[a:b] = True
    if covered.mean() > most_cover:
        return None
    edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    parts, done = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        parts.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*parts, text[done:]])


#: The automaton that this worker used last, with the name of the broadcast items it was built from.
_built: dict[str, Matcher] = {}


def _found(name: str, shared: Broadcast, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _built:  # once for a worker, not for each of its tasks
            _built.clear()
            _built[name] = Matcher(shared.value, least)
        matcher = _built[name]
        for pdf in batches:
            out = []
            for ident, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = matcher.spans(WORD.findall(text.lower()))
                if found:
                    each = [{"item_id": k, "spans": [{"from_word": a, "to_word": b} for a, b in v], "words": sum(b - a for a, b in v)} for k, v in sorted(found.items())]
                    out.append((ident, text, each))
            yield pd.DataFrame(out, columns=["doc_id", "text", "leaks"]).astype({"doc_id": "Int64"})

    return run


def _texts_cleaned(most_cover: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            clean = [_cleaned(t, [(x["from_word"], x["to_word"]) for leak in ls for x in leak["spans"]], most_cover) for t, ls in zip(pdf["text"], pdf["leaks"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "leaks": pdf["leaks"], "clean_text": clean})

    return run


def leaks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str,
    passage_col: str,
    least: int = 12,
    most_cover: float = 0.5,
    with_text: bool = True,
    automaton_chars: int = 2_000_000,
) -> DataFrame:
    """One row for each document that holds at least `least` consecutive words of an item.

    Columns: doc_id; leaks array<struct<item_id, spans array<struct<from_word, to_word>>, words>>, by item id; and with
    `with_text` clean_text, the text without the matched spans, null if they cover more than `most_cover` of its words.
    Words are runs of letters and digits in lower case. Items shorter than `least` words, null items, null and empty
    texts match nothing; equal items are each reported. Rows with a null id are kept with their null; rows repeated with
    id and text come out once.

    Items of any size are taken: they are divided into automata of about `automaton_chars` characters, which bounds what
    a worker holds, and each reads the documents once; what is shuffled are only the documents with leaks.
    """
    held = items.select(F.col(item_col).cast("long").alias("i"), F.col(passage_col).alias("p")).filter(F.col("i").isNotNull() & F.col("p").isNotNull())
    parts = max(1, -(-(held.agg(F.sum(F.length("p"))).first()[0] or 0) // automaton_chars))
    texts = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()))
    found = None
    for k in range(parts):
        own = [(r.i, r.p) for r in held.filter(F.pmod(F.xxhash64("i", "p"), F.lit(parts)) == k).collect()]
        run = _found(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(own), least)
        one = texts.mapInPandas(filled(run), f"doc_id long, text string, leaks {LEAKS}")
        found = one if found is None else found.unionByName(one)
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaks")))).alias("leaks")
    found = found.groupBy("doc_id", F.xxhash64("text").alias("h"), *(["text"] if with_text else [])).agg(all_).drop("h")
    if not with_text:
        return found.withColumn("clean_text", F.lit(None).cast("string"))
    return found.mapInPandas(filled(_texts_cleaned(most_cover)), f"doc_id long, leaks {LEAKS}, clean_text string")
