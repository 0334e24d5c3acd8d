"""The most similar vectors of every vector, by cells around the centres of a sample.

Exact copies are one vector that stands for its class. The centres come from spherical k-means over a sample, which
starts from places spread evenly along a Hilbert curve. Every vector is sent to its few nearest cells: in the first it
answers, in all it asks, by matrix products. The best of its cells are merged for each vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled, sampled
from lodestrata.session import checkpointed

ENTRY = np.dtype([("id", "<i8"), ("sim", "<f4")])
GROUP = 32
STEPS = 32_767  # similarities travel in steps of 1 / STEPS, finer than the half precision of the vectors


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates below 2**bits (dimensions * bits <= 63)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the Gray code, from the highest bit down
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def unit_rows(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable vectors: of length `dim`, finite and not all zero."""
    good, rows = [], []
    for i, v in enumerate(vectors):
        if v is not None and not np.isscalar(v) and len(v) == dim:
            good.append(i)
            rows.append(np.asarray(v, dtype=np.float64))
    m = np.array(rows, dtype=np.float64).reshape(-1, dim)
    norm = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return np.array(good, dtype=np.int64)[ok], m[ok] / norm[ok, None]


def _halves(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, m = unit_rows(pdf["embedding"], dim)
            half = m.astype(np.float16) + np.float16(0)  # no negative zero
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "v": [r.tobytes() for r in half]})

    return run


def _matrix(blobs: Iterable[bytes], dim: int) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), np.float16).reshape(-1, dim).astype(np.float32)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, cells: int, axes: int, bits: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors in the middle of `cells` parts of a sample: spherical k-means that starts from places spread evenly
    along the Hilbert curve of a projection."""
    dim = sample.shape[1]
    plane = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(axes, dim))))[0]
    y = np.clip((sample @ plane) * np.sqrt(dim) / 6 + 0.5, 0, 1)  # a coordinate deviates by about 1 / sqrt(dim)
    order = np.argsort(hilbert_keys(np.minimum((y * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits), kind="stable")
    c = sample[order[(np.arange(cells) * len(sample)) // cells]].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), c)
    return c.astype(np.float32)


def _cells(c: np.ndarray, probes: int):
    """Each vector once for each of its nearest cells; only in the first does it answer, and carry its class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = min(probes, len(c))
        for pdf in batches:
            if not len(pdf):
                continue
            m = _matrix(pdf["v"], c.shape[1])
            near = np.concatenate([np.argsort(-(m[i : i + 4096] @ c.T), axis=1, kind="stable")[:, :n] for i in range(0, len(m), 4096)])
            for j in range(n):
                yield pd.DataFrame({"cell": near[:, j].astype(np.int32), "asks": np.int32(j > 0), "id": pdf["id"], "v": pdf["v"], "more": pdf["more"] if j == 0 else None})

    return run


def _best(q: np.ndarray, self_at: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the k best of m by (similarity down, id up): positions and similarities; self_at is the own
    position of a row in m, or -1.

    The columns are taken in groups of GROUP: the k best lie in the k groups with the largest maxima.
    """
    n, k = len(ids), min(k, len(ids))
    sims = np.empty((len(q), -(-n // GROUP) * GROUP), dtype=np.float32)
    sims[:, n:] = -np.inf
    np.matmul(q, m.T, out=sims[:, :n])
    mine = np.flatnonzero(self_at >= 0)
    sims[mine, self_at[mine]] = -np.inf
    tops = sims.reshape(len(sims), GROUP, -1).max(axis=1)  # columns a fixed stride apart: fast to reduce
    groups = tops.shape[1]
    few = min(k, groups)
    at = np.argpartition(-tops, few - 1, axis=1)[:, :few]
    at = (at[:, :, None] + groups * np.arange(GROUP)).reshape(len(sims), -1)
    some = np.take_along_axis(sims, at, 1)
    part = np.take_along_axis(at, np.argpartition(-some, k - 1, axis=1)[:, :k], 1)
    edge = np.take_along_axis(sims, part, 1).min(axis=1)[:, None]
    tied = np.flatnonzero(((some >= edge).sum(axis=1) > k) | ((tops >= edge).sum(axis=1) > few))
    edge = edge[:, 0]
    for r in tied:  # equal similarities at the edge: take the smaller ids
        at = np.flatnonzero(sims[r, :n] >= edge[r])
        part[r] = at[np.lexsort((ids[at], -sims[r][at]))[:k]]
    return part, np.take_along_axis(sims, part, 1)


def _packed(ids: np.ndarray, sims: np.ndarray) -> list[bytes]:
    """One blob for each row: the ids' bytes by significance, which compress well in a shuffle, then the similarities
    in two bytes each."""
    planes = ids.astype("<i8").view(np.uint8).reshape(*ids.shape, 8).transpose(0, 2, 1).reshape(len(ids), -1)
    steps = np.round((np.clip(sims, -1, 1) + 1) * STEPS).astype("<u2")
    return [a.tobytes() + b.tobytes() for a, b in zip(planes, steps, strict=True)]


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 10
    e = np.empty(n, dtype=ENTRY)
    e["id"] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n).T).view("<i8").ravel()
    e["sim"] = np.frombuffer(blob, "<u2", n, 8 * n) / np.float32(STEPS) - 1
    return e


def _listed(q_id: int, own: np.ndarray | None, ids: np.ndarray, sims: np.ndarray, more: dict[int, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A list of classes as one of vectors: each class by its smallest ids, the own one with the vector itself."""
    parts = [(np.r_[i, more[i]], s) if i in more else (np.array([i]), s) for i, s in zip(ids.tolist(), sims.tolist())]
    if own is not None:
        parts.append((np.r_[q_id, own], 1.0))
    all_ids = np.concatenate([p for p, _ in parts])
    all_sims = np.repeat(np.array([s for _, s in parts], dtype=np.float32), [len(p) for p, _ in parts])
    order = np.lexsort((all_ids, -np.round((np.clip(all_sims, -1, 1) + 1) * STEPS)))[: k + 1]
    return all_ids[order], all_sims[order]


def _compared(dim: int, k: int, block: int):
    """Rows arrive ordered by (cell, asks, id): those that answer, then those that only ask. Yields the best neighbours
    of every row in its cell."""

    def ask(q_ids: np.ndarray, q: np.ndarray, own: list, ids: np.ndarray, m: np.ndarray, more: dict) -> Iterator[pd.DataFrame]:
        for a in range(0, len(q_ids), block):
            mine = q_ids[a : a + block]
            place = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
            at, sims = _best(q[a : a + block], np.where(ids[place] == mine, place, -1), ids, m, k)
            near, real = ids[at], np.isfinite(sims)
            out = _packed(near, sims)
            classes = np.isin(near, list(more)).any(axis=1) if more else np.zeros(len(mine), bool)
            for r in np.flatnonzero(~real.all(axis=1) | classes | np.array([x is not None for x in own[a : a + block]])):
                got = _listed(int(mine[r]), own[a + r], near[r][real[r]], sims[r][real[r]], more, k)
                out[r] = _packed(got[0][None], got[1][None])[0] if len(got[0]) else b""
            yield pd.DataFrame({"id": mine, "near": out})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, parts, base = None, [], None

        def closed():
            rows = pd.concat(parts)
            own = [None if x is None else np.asarray(x, dtype=np.int64) for x in rows["more"]]
            ids = rows["id"].to_numpy()
            return ids, _matrix(rows["v"], dim), {int(i): x for i, x in zip(ids, own) if x is not None}, own

        def answer():
            ids, m, more, own = base
            yield from ask(ids, m, own, ids, m, more)

        for pdf in batches:
            for (c, asks), part in pdf.groupby(["cell", "asks"], sort=True):
                if c != cell:
                    if parts:
                        base = closed()
                        yield from answer()
                    cell, parts, base = c, [], None
                if not asks:
                    parts.append(part)
                    continue
                if base is None and parts:
                    base, parts = closed(), []
                    yield from answer()
                if base is not None:
                    yield from ask(part["id"].to_numpy(), _matrix(part["v"], dim), [None] * len(part), *base[:3])
        if parts:
            base = closed()
            yield from answer()

    return run


def _merge(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [[_unpacked(b) for b in x] for x in pdf["lists"]]
            own = np.repeat(np.arange(len(lists)), [sum(map(len, x)) for x in lists])
            e = np.concatenate([b for x in lists for b in x]) if lists else np.empty(0, ENTRY)
            order = np.lexsort((-e["sim"], e["id"], own))
            own, e = own[order], e[order]
            fresh = np.r_[True, (own[1:] != own[:-1]) | (e["id"][1:] != e["id"][:-1])] if len(e) else np.empty(0, bool)
            own, e = own[fresh], e[fresh]
            order = np.lexsort((e["id"], -e["sim"], own))
            own, e = own[order], e[order]
            start = np.searchsorted(own, np.arange(len(lists) + 1))
            kept = [e[a : min(a + k + 1, b)] for a, b in zip(start, start[1:])]  # one more, as a copied vector is in its own list
            yield pd.DataFrame({"id": pdf["id"], "ids": [x["id"].copy() for x in kept], "sims": [x["sim"].astype(np.float64) for x in kept]})

    return run


def nearest_vectors(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 10,
    dim: int = 64,
    axes: int = 10,
    bits: int = 6,
    block: int = 512,
    cell_rows: int = 6250,
    probes: int = 4,
    full_cells: int = 32,
    seed: int = 7,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(id, neighbour, rank, similarity): for every usable vector its k most similar others by cosine.

    A vector is usable if it is not null, has `dim` finite entries and is not all zero; others have no neighbours and
    are nobody's neighbour. Ties go to the smaller id; equal vectors are each other's neighbours. Similarities are
    those of the unit vectors rounded to half precision (an error below 0.001). With k or fewer usable vectors each
    lists all others. A row with a null id is skipped; an empty table gives no rows; other columns are ignored.

    The different vectors are divided into cells of about `cell_rows`; each asks in its `probes` nearest cells. Beyond
    `full_cells` cells the probes grow with the 0.75th power of their number, which holds the recall.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")).filter(F.col("id").isNotNull() & F.col("embedding").isNotNull())
    usable = checkpointed(vectors.mapInPandas(filled(_halves(dim)), "id long, v binary"))
    if usable.select("id").distinct().count() < usable.count():
        usable = checkpointed(usable.groupBy("id").agg(F.min("v").alias("v")))
    # exact copies: the smallest id stands for its class and carries the k next ones
    hashed = usable.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    hashed = checkpointed(hashed)
    alike = usable.withColumn("h", F.xxhash64("v")).join(F.broadcast(hashed) if hashed.count() <= broadcast_rows else hashed, "h").drop("h")
    classes = checkpointed(alike.groupBy("v").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("v", "rep"))
    members = checkpointed(alike.join(F.broadcast(classes) if classes.count() <= broadcast_rows else classes, "v").select("rep", F.col("id").alias("member")))
    side = F.broadcast if members.count() <= broadcast_rows else (lambda x: x)
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("member"))
    lead = members.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("member")).alias("ids"))
    lead = lead.select(F.col("rep").alias("id"), F.slice("ids", 2, k).alias("more"))
    later = members.filter("member <> rep").select(F.col("member").alias("id"))
    reps = usable.join(side(later), "id", "left_anti").join(side(lead), "id", "left")

    n = reps.count()
    cells = max(1, -(-n // cell_rows))
    asked = max(probes, math.ceil(probes * (cells / full_cells) ** 0.75))
    c = np.zeros((1, dim), np.float32)
    if cells > 1:
        sample = sampled(reps.select("id", "v"), "id", max(20_000, 20 * cells), n).collect()
        c = centres(_matrix([bytes(r.v) for r in sample], dim), cells, axes, bits, seed)
    placed = reps.mapInPandas(filled(_cells(c, asked)), "cell int, asks int, id long, v binary, more array<long>")
    placed = placed.repartition(cells, "cell").sortWithinPartitions("cell", "asks", "id")
    near = placed.mapInPandas(filled(_compared(dim, k, block)), "id long, near binary")
    lists = near.groupBy("id").agg(F.collect_list("near").alias("lists"))
    merged = lists.mapInPandas(filled(_merge(k)), "id long, ids array<long>, sims array<double>")
    # every member of a class takes the list of its class without itself
    each = merged.join(side(members.select(F.col("rep").alias("id"), "member")), "id", "left").withColumn("id", F.coalesce("member", "id"))
    near = F.filter(F.arrays_zip("ids", "sims"), lambda x: x["ids"] != F.col("id"))
    each = each.select("id", F.posexplode(F.slice(near, 1, k)).alias("at", "x"))
    return each.select("id", F.col("x.ids").alias("neighbour"), (F.col("at") + 1).alias("rank"), F.col("x.sims").alias("similarity"))
