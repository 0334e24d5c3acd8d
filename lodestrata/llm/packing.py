"""Filling fixed-capacity containers with texts, by bounded-space online packing.

Every partition keeps a fixed number of open containers. A text goes to the open container that it fills best; if it
fits none, the fullest is closed and a new one opened. The containers still open at the ends of the partitions are
merged in a last round, best fit in descending order.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled
from lodestrata.session import checkpointed, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str = VOCABULARY):
    """The byte-level BPE tokenizer of a rank file, which is read where it is installed."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class OpenContainers:
    """At most `most` open containers of one partition, kept by their free room."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.free: list[tuple[int, int]] = []  # (room, container), ascending

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) of an item of at most `capacity`."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, container = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                self.free.pop(0)
            room, container = self.capacity, self.next_id
            self.next_id += 1
        if room > size:
            insort(self.free, (room - size, container))
        return container, self.capacity - room


ROW = "doc_id long, piece int, token_start int, n_tokens int, container long, token_offset int, left_open int"


def _pack(path: str, capacity: int, open_containers: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_tokenizer(path).encode_ordinary
        task = TaskContext.get()
        bins = OpenContainers(capacity, open_containers, (task.partitionId() if task else 0) << 40)
        cols = ["doc_id", "piece", "token_start", "n_tokens", "container", "token_offset", "left_open"]
        for pdf in batches:
            rows = []
            for ident, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                n = len(encode(text)) if text else 0
                if not n:
                    rows.append((ident, 0, 0, 0, None, None, None))
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    rows.append((ident, piece, start, size, *bins.place(size), None))
            yield _frame(rows, cols)
        yield _frame([(None, None, None, None, c, None, capacity - room) for room, c in bins.free], cols)

    return run


def _frame(rows: list[tuple], cols: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=cols).astype({c: "Int64" for c in cols})


def _merge(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = [p for p in batches if len(p)]
        if not left:
            return
        pdf = pd.concat(left).sort_values(["used", "container"], ascending=[False, True])
        free: list[tuple[int, int]] = []
        filled: dict[int, int] = {}
        to, base = [], []
        for container, used in zip(pdf["container"].tolist(), pdf["used"].tolist(), strict=True):
            at = bisect_left(free, (used, -1))
            if at < len(free):
                room, target = free.pop(at)
            else:
                room, target = capacity, container
                filled[target] = 0
            to.append(target)
            base.append(filled[target])
            filled[target] += used
            if room > used:
                insort(free, (room - used, target))
        yield pd.DataFrame({"container": pdf["container"].to_numpy(), "to": to, "base": base})

    return run


def pack(
    df: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int = 2048,
    tokenizer_path: str = VOCABULARY,
    open_containers: int = 64,
    merge_at_once: int = 100_000,
    broadcast_limit: int = 1_000_000,
) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container, token_offset): where each text, or piece of one, is placed.

    A text is divided only if it alone exceeds `capacity` tokens, into pieces of `capacity` and a rest; no container
    holds more than `capacity`. Null and empty texts take no room: one row with n_tokens 0 and a null container.
    Repeated ids are separate items, null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    texts = spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    placed = checkpointed(texts.mapInPandas(filled(_pack(tokenizer_path, capacity, open_containers)), ROW))
    left = placed.filter("left_open is not null").select("container", F.col("left_open").alias("used"))
    count = left.count()  # open_containers for each partition at most
    tasks = max(1, -(-count // merge_at_once))
    moved = left.repartition(tasks, "container").mapInPandas(filled(_merge(capacity)), "container long, to long, base int")
    moved = checkpointed(moved)
    rows = placed.filter("left_open is null").drop("left_open")
    out = rows.join(F.broadcast(moved) if count <= broadcast_limit else moved, "container", "left")
    return out.select(
        "doc_id", "piece", "token_start", "n_tokens",
        F.coalesce("to", "container").alias("container"),
        (F.col("token_offset") + F.coalesce("base", F.lit(0))).alias("token_offset"),
    )
