"""Near-duplicate records with small edits, by covering locality-sensitive hashing.

A record's set of word shingles is sketched as GROUPS groups of 11 symbols: one-permutation min-hashes, one for each
of 11 * GROUPS bins. Two records with Jaccard similarity s agree in a symbol with probability s, so the distance of
two sketches is a Hamming distance over symbols. Within a group, the masks are the eleven blocks of the 2-(11,5,2)
design of the quadratic residues modulo 11. A block survives a set of differing positions if it contains none of
them; each position lies in five blocks and two positions in two common ones, so three positions meet at most
5*3 - 2*3 + 1 = 10 of the 11 blocks. Every pair that differs in at most RADIUS = 3 positions of a group therefore
collides in some table of it. Pairs that collide are filtered with the whole sketch and then verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled
from lodestrata.llm.shingles import WordHasher, mix, shingle_sets
from lodestrata.session import checkpointed, spread

POSITIONS, RADIUS = 11, 3
RESIDUES = sorted({x * x % POSITIONS for x in range(1, POSITIONS)})
BLOCKS = [sorted((r + t) % POSITIONS for r in RESIDUES) for t in range(POSITIONS)]
EMPTY = np.uint64(1) << np.uint64(62)
#: Rows whose keys are counted together.
AT_ONCE = 50_000


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation min-hashes of a shingle set, 16 bits of each; an empty bin borrows from the next full one at its right."""
    v = mix(shingles ^ np.uint64(0x9E3779B97F4A7C15))
    b = (v % np.uint64(bins)).astype(np.int64)
    v >>= np.uint64(8)
    low = np.full(bins, EMPTY, dtype=np.uint64)
    np.minimum.at(low, b, v)
    full = np.flatnonzero(low != EMPTY)
    at = np.searchsorted(full, np.arange(bins))
    src = full[at % len(full)]
    hops = (src - np.arange(bins)) % bins
    return mix(low[src] + hops.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16)


def _sketches(size: int, bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for pdf in batches:
            ids, fps, sks, ns = [], [], [], []
            sets = shingle_sets(pdf["text"].tolist(), size, hasher)
            for i, s in zip(pdf["id"].to_numpy(), sets, strict=True):
                if len(s):
                    ids.append(i)
                    with np.errstate(over="ignore"):
                        fps.append(np.array([np.bitwise_xor.reduce(mix(s)), np.sum(s, dtype=np.uint64)]).tobytes())
                    sks.append(sketch(s, bins).tobytes())
                    ns.append(len(s))
            yield pd.DataFrame({"id": ids, "fp": fps, "n": ns, "sketch": sks})

    return run


def _matrix(blobs: Iterable[bytes], bins: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, bins)


def table_keys(sketches: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """The bucket of each sketch in each of the tables, `bits` of its hash; a column for each group and block."""
    keys = np.empty((len(sketches), groups * len(BLOCKS)), dtype=np.uint64)
    wide = sketches.astype(np.uint64)
    for g in range(groups):
        for t, block in enumerate(BLOCKS):
            h = np.full(len(sketches), g * len(BLOCKS) + t + 1, dtype=np.uint64)
            for p in block[:3]:
                h = (h << np.uint64(16)) | wide[:, g * POSITIONS + p]
            h = mix(h)
            for p in block[3:]:
                h = h * np.uint64(0x100000001B3) ^ wide[:, g * POSITIONS + p]
            keys[:, g * len(BLOCKS) + t] = mix(h) >> np.uint64(64 - bits)
    return keys


def _locally_frequent(groups: int, bits: int, least: int):
    """Keys that stand at least `least` times among AT_ONCE rows or the rest of a task's, with how often."""

    def counted(keys: list[np.ndarray]) -> pd.DataFrame:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return pd.DataFrame({"key": key[n >= least].astype(np.int64), "n": n[n >= least]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[np.ndarray] = []
        rows = 0
        for pdf in batches:
            for k in range(0, len(pdf), AT_ONCE):
                part = pdf["sketch"].iloc[k : k + AT_ONCE]
                if rows + len(part) > AT_ONCE:
                    yield counted(keys)
                    keys, rows = [], 0
                keys.append(table_keys(_matrix(part, groups * POSITIONS), groups, bits).ravel())
                rows += len(part)
        if keys:
            yield counted(keys)

    return run


def _entries(groups: int, bits: int, parts: int, heavy: np.ndarray):
    """(part, entries): the (key, id) of each part, as one blob for a batch; keys among `heavy` are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keys = table_keys(_matrix(pdf["sketch"], groups * POSITIONS), groups, bits)
            ids = np.repeat(pdf["id"].to_numpy(), keys.shape[1])
            key = keys.ravel()
            if len(heavy):
                light = ~np.isin(key, heavy)
                key, ids = key[light], ids[light]
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            key, ids = key[order], ids[order]
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            yield pd.DataFrame({"part": some.astype(np.int32), "entries": [_blob(key[cuts[p] : cuts[p + 1]] // np.uint64(parts), ids[cuts[p] : cuts[p + 1]]) for p in some]})

    return run


def _blob(keys: np.ndarray, ids: np.ndarray) -> bytes:
    """Keys, then ids, each by bytes of equal significance, which compress well, and without those that are 0 for all."""
    out = []
    for x in (keys, ids.view(np.uint64)):
        planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
        width = max(1, int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1)
        out.append(bytes([width]) + planes[:width].tobytes())
    return len(keys).to_bytes(8, "little") + b"".join(out)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for _ in range(2):
        width = blob[at]
        planes = np.zeros((8, n), dtype=np.uint8)
        planes[:width] = np.frombuffer(blob, np.uint8, width * n, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
        at += 1 + width * n
    return out[0], out[1].view(np.int64)


def _bucket_pairs(most: int, parts: int):
    """Pairs of each bucket of a part; a bucket with more than `most` members comes out as its members (key, a), with
    a null partner and the bucket's size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(*_unblob(b), at) for p in batches for at, b in zip(p["part"].tolist(), p["entries"], strict=True)]
        if not got:
            return
        key = np.concatenate([k * np.uint64(parts) + np.uint64(at) for k, _, at in got])
        ident = np.concatenate([i for _, i, _ in got])
        del got
        order = np.argsort(key, kind="stable")
        key, ident = key[order], ident[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        a, b = [], []
        held = 0
        for n in np.unique(size[(size > 1) & (size <= most)]):  # buckets of one size at a time
            at = start[size == n]
            i, j = np.triu_indices(n, 1)
            step = max(1, 500_000 // len(i))
            for k in range(0, len(at), step):
                a.append(ident[at[k : k + step, None] + i].ravel()), b.append(ident[at[k : k + step, None] + j].ravel())
                held += len(a[-1])
                if held > 1_000_000:
                    yield _pairs(a, b)
                    a, b, held = [], [], 0
        yield _pairs(a, b)
        for s, n in zip(start[size > most], size[size > most], strict=True):
            yield pd.DataFrame({"a": ident[s : s + n], "b": pd.array([None] * n, dtype="Int64"), "key": pd.array([int(key[s])] * n, dtype="Int64"), "size": pd.array([n] * n, dtype="Int64")})

    return run


def _pairs(a: list, b: list) -> pd.DataFrame:
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    fresh = (lo != hi) & np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] if len(lo) else np.empty(0, bool)
    out = pd.DataFrame({"a": lo[fresh], "b": pd.array(hi[fresh], dtype="Int64")})
    return out.assign(key=pd.array([None] * len(out), dtype="Int64"), size=pd.array([None] * len(out), dtype="Int64"))


def _heavy_members(groups: int, bits: int, heavy: np.ndarray, sizes: np.ndarray):
    """(a, key, size): the members of the heavy buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = table_keys(_matrix(pdf["sketch"], groups * POSITIONS), groups, bits) if len(pdf) else np.empty((0, 1), np.uint64)
            at = np.flatnonzero(np.isin(keys.ravel(), heavy))
            key = keys.ravel()[at]
            yield pd.DataFrame({"a": pdf["id"].to_numpy()[at // keys.shape[1]], "key": key.astype(np.int64), "size": sizes[np.searchsorted(heavy, key)]})

    return run


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows (of sketches that broadcast against each other) may reach the threshold: by the sizes of
    their sets, and by their agreeing symbols, whose number is binomial: the bound lies five standard deviations below
    its mean at the threshold."""
    bins = a.shape[-1]
    floor = max(1, math.floor(bins * threshold - 5 * math.sqrt(bins * threshold * (1 - threshold))))
    fits = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    return fits & ((a == b).sum(axis=-1) >= floor)


def _likely_pairs(bins: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ok = likely(_matrix(pdf["s_a"], bins), _matrix(pdf["s_b"], bins), pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy(), threshold)
                yield pdf.loc[ok, ["a", "b"]]

    return run


def _cell_pairs(bins: int, threshold: float):
    """Rows arrive ordered by (key, i, j, second): the members of block i of a hot bucket, then those of block j, which
    are compared by their sketches; in a cell with i = j all have second = 0."""

    def compared(first: pd.DataFrame, second: pd.DataFrame) -> Iterator[pd.DataFrame]:
        s, t = _matrix(first["sketch"], bins), _matrix(second["sketch"], bins)
        m, n, x, y = first["n"].to_numpy(), second["n"].to_numpy(), first["id"].to_numpy(), second["id"].to_numpy()
        for k in range(0, len(s), 64):
            i, j = np.nonzero(likely(s[k : k + 64, None], t[None], m[k : k + 64, None], n[None], threshold))
            i = i + k
            if first is second:
                i, j = i[x[i] < y[j]], j[x[i] < y[j]]
            if len(i):
                yield pd.DataFrame({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, ([], [])

        def closed() -> Iterator[pd.DataFrame]:
            first = pd.concat(held[0]) if held[0] else None
            if first is not None and cell[1] == cell[2]:
                yield from compared(first, first)
            elif first is not None and held[1]:
                yield from compared(first, pd.concat(held[1]))

        for pdf in batches:
            for c, part in pdf.groupby(["key", "i", "j"], sort=True):
                if c != cell:
                    if cell is not None:
                        yield from closed()
                    cell, held = c, ([], [])
                for side in (0, 1):
                    own = part[part["second"] == side]
                    if len(own):
                        held[side].append(own)
        if cell is not None:
            yield from closed()

    return run


def _packed_sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for pdf in batches:
            sets = shingle_sets(pdf["text"].tolist(), size, hasher)
            yield pd.DataFrame({"id": pdf["id"], "packed": [s.tobytes() for s in sets]})

    return run


def _jaccard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sims = []
        for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            sims.append(both / (len(x) + len(y) - both))
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": sims})


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = 0.8,
    shingle: int = 5,
    groups: int = 4,
    bucket_limit: int = 256,
    block: int = 4096,
    part_entries: int = 1_000_000,
    heavy_least: int = 2000,
    filter_bits: int = 1 << 27,
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the class of exact copies that each record belongs to.

    Returns (links, members): links(a, b, similarity) with a < b holds every pair of class representatives whose
    Jaccard similarity over distinct word shingles is at least `threshold`; members(id, rep) maps every record with at
    least one shingle to the smallest id that has the same shingle set. Null or empty texts and those shorter than a
    shingle are in neither. A row repeated under its id counts once, a null id is skipped; other columns are ignored.

    Only buckets with at most `bucket_limit` members give out their pairs. Larger ones are divided into blocks of at
    most `block` members or so, each pair of blocks is a task's unit and is compared by the sketches where it lies, so
    that only likely pairs leave it. Buckets above a thousandth of the records (and `heavy_least`) are found by counting
    before the shuffle and never meet in one task; by arithmetic there are at most 44,000 of them. Texts to verify are found
    by a filter of at most `filter_bits` bits, which is broadcast, and then by an exact join.
    """
    bins = POSITIONS * groups
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = spread(texts.filter(F.col("id").isNotNull() & F.col("text").isNotNull()))
    rows = checkpointed(texts.mapInPandas(filled(_sketches(shingle, bins)), "id long, fp binary, n int, sketch binary"))
    classes = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    members = rows.select("id", "fp").join(classes, "fp").select("id", "rep").distinct()
    reps = rows.groupBy("fp").agg(F.min_by(F.struct("n", "sketch"), "id").alias("s"), F.min("id").alias("id"))
    reps = checkpointed(reps.select("id", "s.n", "s.sketch"))

    by_task = reps.groupBy(F.spark_partition_id().alias("task")).count()
    count, tasks = by_task.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    entries = max(1, count * groups * len(BLOCKS))
    bits = min(62, max(24, entries.bit_length() + 8))  # different keys meet in one of 512 entries
    most = max(heavy_least, count // 1000)
    lots = tasks + 2 * count // AT_ONCE + 1  # of rows that are counted together; two in a row hold more than AT_ONCE
    # a key with more than 2 * most entries has more than `most` in the lots that hold it at least so often
    seen = reps.select("sketch").mapInPandas(filled(_locally_frequent(groups, bits, max(1, most // lots))), "key long, n long")
    heavy = seen.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > most).orderBy("key").collect()
    keys, sizes = np.array([r.key for r in heavy], dtype=np.uint64), np.array([r.n + most for r in heavy], dtype=np.int64)
    parts = max(1, -(-entries // part_entries))
    placed = reps.select("id", "sketch").mapInPandas(filled(_entries(groups, bits, parts, keys)), "part int, entries binary")
    found = placed.repartitionById(parts, "part").mapInPandas(filled(_bucket_pairs(bucket_limit, parts)), "a long, b long, key long, size long")
    found = checkpointed(found)
    hot = found.filter("b is null").select(F.col("a").alias("id"), "key", "size")
    if heavy:
        hot = hot.unionByName(reps.select("id", "sketch").mapInPandas(filled(_heavy_members(groups, bits, keys, sizes)), "a long, key long, size long").withColumnRenamed("a", "id"))
    pairs = found.filter("b is not null").select("a", "b").distinct()
    side = lambda n: reps.select(F.col("id").alias(n), F.col("n").alias(f"n_{n}"), F.col("sketch").alias(f"s_{n}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(filled(_likely_pairs(bins, threshold)), "a long, b long")
    if not hot.isEmpty():
        own = hot.join(reps, "id").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))
        divided = own.select("key", "size", "id", "n", "sketch", "blk", F.explode(cells).alias("c")).select("key", "c.i", "c.j", (F.col("c.i") != F.col("blk")).cast("int").alias("second"), "id", "n", "sketch")
        divided = divided.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second")
        close = close.unionByName(divided.mapInPandas(filled(_cell_pairs(bins, threshold)), "a long, b long")).distinct()
    close = checkpointed(close)

    ids = checkpointed(close.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    size = min(filter_bits, max(1 << 16, 1 << (16 * max(1, ids.count())).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(size))
    word, bit = F.shiftright(slot, 6), F.expr("shiftleft(1L, cast(slot & 63 as int))")
    marks = ids.withColumn("slot", slot).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("marks"))  # at most filter_bits / 64 rows
    near = texts.withColumn("slot", slot).withColumn("word", word).join(F.broadcast(marks), "word").filter(F.col("marks").bitwiseAND(bit) != 0)
    sets = near.select("id", "text").join(ids, "id", "left_semi").mapInPandas(filled(_packed_sets(shingle)), "id long, packed binary")
    sets = checkpointed(sets.dropDuplicates(["id"]))
    joined = close.join(sets.select(F.col("id").alias("a"), F.col("packed").alias("set_a")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("packed").alias("set_b")), "b")
    links = joined.mapInPandas(filled(_jaccard), "a long, b long, similarity double").filter(F.col("similarity") >= threshold)
    return links, members


def similar_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: the links between classes and within them, with every copy counted as its own record."""
    copies = checkpointed(members)
    x = copies.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    y = copies.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    cross = links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    both = cross.unionByName(within)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
