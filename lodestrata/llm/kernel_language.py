"""Languages of documents and of their mixed-language segments, by string-kernel classification.

Strings are compared by a blended-spectrum presence kernel: the number of distinct character n-grams, of all lengths
up to ORDER, that both hold, divided by the root of the product of their own numbers. Training strings are labelled
documents' lines; a Nystroem approximation maps a string to its kernel values with landmark strings, whitened by the
landmarks' own kernel matrix, and one-versus-rest kernel ridge regression is fitted on that map. As the kernel is
linear in the presence vectors, landmarks, whitening and ridge weights multiply out to one weight for each n-gram
and language: a batch of lines is scored by one sparse presence matrix times that dense matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled, sampled
from lodestrata.llm.langwords import guess
from lodestrata.session import spread

LANGUAGES = ("en", "de", "fr", "es", "it", "tr")
# Ways in which a label names one of the languages, after lower-casing and cutting the country.
LABELS = {
    "en": "en eng english englisch anglais inglés inglese ingilizce",
    "de": "de deu ger german deutsch allemand alemán tedesco almanca",
    "fr": "fr fra fre french français francais französisch francés francese fransızca",
    "es": "es spa spanish español espanol castellano espagnol spanisch spagnolo ispanyolca",
    "it": "it ita italian italiano italien italienisch italyanca",
    "tr": "tr tur turkish türkçe turkce turc türkisch turco",
}
ORDER = 3
SYMBOLS = 64
SPACE = 1


def _alphabet() -> np.ndarray:
    """Symbol of each character of the basic plane: 0 ends a line, 1 is anything but a letter, letters from 2."""
    table = np.full(0x10000, SPACE, dtype=np.uint8)
    table[ord("\n")] = 0
    letters = "abcdefghijklmnopqrstuvwxyzäöüßàâáãçèéêëìîïíñòôóùûúœæğışå"
    for i, ch in enumerate(letters):
        table[ord(ch)] = i + 2
        up = ch.upper()
        if len(up) == 1 and ord(up) < 0x10000 and ch != "ı":
            table[ord(up)] = i + 2
    table[ord("İ")] = table[ord("i")]
    other = SYMBOLS - 1
    for c in range(0x10000):
        if table[c] == SPACE and c > 127 and not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = other
    return table


@dataclass
class LineSpectra:
    """Distinct n-grams of each line of a batch, as one array of codes with the bounds of each line."""

    codes: np.ndarray
    bounds: np.ndarray
    letters: np.ndarray  # letters of each line
    worded: np.ndarray  # the same, but 0 for lines without a word of four letters: units and codes tell no language
    first_line: np.ndarray  # first line of each text, and the number of lines at the end


SIZE = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


def spectra(texts: list[str], table: np.ndarray) -> LineSpectra:
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sym = table[np.minimum(points, 0xFFFF)]
    ends = np.flatnonzero(sym == 0)
    lines = np.zeros(len(sym), dtype=np.int32)
    lines[ends[:-1] + 1] = 1
    np.cumsum(lines, out=lines)
    # a run of non-letters counts as one gap
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = ~((sym[1:] == SPACE) & (sym[:-1] <= SPACE))
    sym, lines = sym[keep].astype(np.int64), lines[keep]
    n_lines = len(ends)
    letter = sym > SPACE
    letters = np.bincount(lines[letter], minlength=n_lines)
    edges = np.flatnonzero(np.diff(np.r_[0, letter.astype(np.int8), 0]))
    first, size = edges[::2], edges[1::2] - edges[::2]
    long = size >= 4
    worded = np.where(np.bincount(lines[first[long]], minlength=n_lines) > 0, letters, 0)
    base = lines.astype(np.int64) * (1 << 20)
    grams = [base[letter] + sym[letter]]
    real = sym > 0
    pair = real[:-1] & real[1:]
    two = sym[:-1] * SYMBOLS + sym[1:]
    grams.append((base[:-1] + SYMBOLS + two)[pair])
    if len(two) > 1:
        triple = pair[:-1] & pair[1:]
        grams.append((base[:-2] + SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + sym[2:])[triple])
    codes = np.concatenate(grams)
    codes.sort()
    codes = codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes
    bounds = np.searchsorted(codes, np.arange(n_lines + 1, dtype=np.int64) << 20)
    counts = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    return LineSpectra((codes & ((1 << 20) - 1)).astype(np.int32), bounds, letters, worded, np.r_[0, np.cumsum(counts)])


def _sums(weights: np.ndarray, s: LineSpectra, step: int = 20_000) -> np.ndarray:
    """The presence matrix of the lines times a dense matrix over n-grams, in blocks."""
    n = len(s.bounds) - 1
    out = np.zeros((n, weights.shape[1]), dtype=np.float32)
    for a in range(0, n, step):
        b = min(n, a + step)
        lo, hi = s.bounds[a], s.bounds[b]
        if lo == hi:
            continue
        part = weights[s.codes[lo:hi]]
        own = np.flatnonzero(s.bounds[a + 1 : b + 1] > s.bounds[a:b])
        out[a + own] = np.add.reduceat(part, s.bounds[a:b][own] - lo, axis=0)
    return out


def fit(strings: list[str], labels: list[str], landmarks: int = 240, ridge: float = 1e-2, seed: int = 11) -> np.ndarray:
    """Weights of each n-gram for each language, from labelled strings of which a share may be wrong."""
    table = _alphabet()
    flat = [s.replace("\n", " ") for s in strings]
    spec = spectra(flat, table)
    norm = np.sqrt(np.maximum(np.diff(spec.bounds), 1)).astype(np.float32)
    y = np.array([LANGUAGES.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    per = max(1, landmarks // len(LANGUAGES))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:per] for c in range(len(LANGUAGES))])
    # only the landmarks' n-grams can be shared with them: the matrices have a row for each of those, and one for the rest
    grams = np.unique(np.concatenate([spec.codes[spec.bounds[i] : spec.bounds[i + 1]] for i in chosen]))
    marks = np.zeros((len(grams) + 1, len(chosen)), dtype=np.float32)
    for k, i in enumerate(chosen):
        marks[np.searchsorted(grams, spec.codes[spec.bounds[i] : spec.bounds[i + 1]]), k] = 1 / norm[i]
    at = np.minimum(np.searchsorted(grams, spec.codes), len(grams) - 1)
    spec.codes = np.where(grams[at] == spec.codes, at, len(grams)).astype(np.int32)
    kernel = _sums(marks, spec, 1000) / norm[:, None]  # strings by landmarks
    own = kernel[chosen].astype(np.float64)
    w, u = np.linalg.eigh((own + own.T) / 2)
    good = w > 1e-6 * w.max()
    whiten = u[:, good] / np.sqrt(w[good])
    z = kernel.astype(np.float64) @ whiten
    z1 = np.c_[z, np.ones(len(z))]
    target = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
    weight = 1.0 / np.maximum(np.bincount(y, minlength=len(LANGUAGES)), 1)[y]
    for _ in range(2):  # the second fit leaves out strings whose label the first one contradicts
        a = (z1 * weight[:, None]).T
        beta = np.linalg.solve(a @ z1 + ridge * np.eye(z1.shape[1]) * weight.mean(), a @ target)
        weight = np.where((z1 @ beta).argmax(axis=1) == y, weight, 0.0)
    dense = np.zeros((SIZE + 1, len(LANGUAGES)), dtype=np.float32)
    dense[grams] = marks[:-1] @ (whiten @ beta[:-1])
    dense[SIZE] = beta[-1]
    return dense


def line_margins(weights: np.ndarray, s: LineSpectra) -> np.ndarray:
    """Log-probability-like score of each line and language: its regression margins, scaled by its letters."""
    size = np.sqrt(np.maximum(np.diff(s.bounds), 1)).astype(np.float32)
    f = _sums(weights[:-1], s) / size[:, None] + weights[-1]
    f = 4.0 * f
    f -= f.max(axis=1, keepdims=True)
    logp = f - np.log(np.exp(f).sum(axis=1, keepdims=True))
    logp = np.maximum(logp, -6.0)
    sure = np.minimum(s.worded / 20.0, 2.0).astype(np.float32)  # short lines, headings and table rows say little
    return logp * sure[:, None]


def segments(score: np.ndarray, letters: np.ndarray, switch: float, least: int) -> list[tuple[int, int, int]]:
    """(first line, end, language) of the best segmentation of a text's lines; blank lines belong to what precedes.

    A change of language costs `switch`; a stretch with fewer than `least` letters is joined to its neighbours.
    """
    n, k = score.shape
    total = score.sum(axis=0)
    best_of_line = score.max(axis=1)
    if best_of_line.sum() - total.max() < switch:  # no segmentation can pay for a change
        return [(0, n, int(total.argmax()))]
    back = np.empty((n, k), dtype=np.int8)
    now = score[0].copy()
    for i in range(1, n):
        top = int(now.argmax())
        jump = now[top] - switch
        stay = now >= jump
        back[i] = np.where(stay, np.arange(k), top)
        now = np.where(stay, now, jump) + score[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = now.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    while True:
        cuts = np.r_[0, np.flatnonzero(path[1:] != path[:-1]) + 1, n]
        sizes = [int(letters[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(sizes) == 1 or min(sizes) >= least:
            break
        j = int(np.argmin(sizes))
        a, b = cuts[j], cuts[j + 1]
        path[a:b] = path[a - 1] if j and (j == len(sizes) - 1 or sizes[j - 1] >= sizes[j + 1]) else path[b]
    return [(int(a), int(b), int(path[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def label_language(label: Column) -> Column:
    """The language that a label names, null if none or several: spelling, country and letter case do not matter. A part
    of two capitals after the first is a country (de-IT), other parts may name a further language (de-it)."""
    pairs = [F.lit(x) for lang, names in LABELS.items() for n in names.split() for x in (n, lang)]
    named = lambda part: F.try_element_at(F.create_map(*pairs), F.lower(part))
    parts = F.split(F.trim(label), "[-_]")
    more = F.filter(F.slice(parts, 2, 9), lambda p: ~p.rlike("^[A-Z]{2}$"))
    first = named(F.get(parts, F.lit(0)))
    return F.when(~F.exists(more, lambda p: F.coalesce(named(p) != first, F.lit(False))), first)


def train(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = 250, lines_each: int = 6) -> np.ndarray:
    """Fit on at most `per_language` labelled documents of each language (the smallest hashes of their ids) and
    `lines_each` of their lines, each of at least 30 characters. Wrong labels among them are outvoted. Where the labels
    name fewer than two languages, function words label the lines of as many documents; with one language in all, or
    none, every text is taken for it, or for the first of LANGUAGES."""
    from pyspark.sql import Window

    ids = df.select(F.col(id_col).alias("id"), label_language(F.col(label_col)).alias("label")).filter("label is not null and id is not null")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = ids.withColumn("rn", rank).filter(F.col("rn") <= per_language).drop("rn")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 30)
    sample = texts.join(F.broadcast(chosen), "id").select("id", "label", F.slice(lines, 1, lines_each).alias("lines"))
    rows = sorted(((r.id, r.label, r.lines) for r in sample.collect()), key=lambda r: (r[1], r[0]))
    strings = [x for _, _, ls in rows for x in ls]
    labels = [label for _, label, ls in rows for _ in ls]
    if len(set(labels)) < 2:  # unlabelled, or one language only: lines whose function words leave no doubt
        some = sampled(texts, "id", per_language * len(LANGUAGES), texts.count(), "text").select(F.slice(lines, 1, lines_each).alias("lines"))
        each = [(x, lang) for r in some.collect() for x in r.lines if (lang := guess(x, 2.0, 2.0))]
        strings, labels = [x for x, _ in each] + strings, [lang for _, lang in each] + labels
    if len(set(labels)) > 1:
        return fit(strings, labels)
    dense = np.zeros((SIZE + 1, len(LANGUAGES)), dtype=np.float32)  # all there is evidence for is one language, or none
    dense[SIZE] = [1.0 if x in labels else -1.0 for x in LANGUAGES]
    return dense


def document_languages(
    df: DataFrame, id_col: str, text_col: str, label_col: str, weights: np.ndarray | None = None, switch: float = 3.0, least_letters: int = 20, least_share: float = 0.0
) -> DataFrame:
    """(doc_id, label_lang, lang, confidence, segments) for every document.

    lang is the language of most of a document's letters; segments array<struct<line_no, end_line, lang, confidence>>
    has each stretch of lines in one language, line_no being its first non-blank line, counted from 1. Documents with
    null, blank or letterless text have a null lang and no segments. Confidences are mean probabilities weighted by
    letters. Ties go to the first of LANGUAGES. Repeated rows are each classified; other columns are ignored.
    """
    spark = df.sparkSession
    if weights is None:
        weights = train(df, id_col, text_col, label_col)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, model = _alphabet(), shared.value
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            langs, sure, parts = [], [], []
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 2_000_000):
                    size += len(texts[to])
                    to += 1
                for lang, conf, segs in _classify(texts[at:to], table, model, switch, least_letters, least_share):
                    langs.append(lang), sure.append(conf), parts.append(segs)
                at = to
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label_lang": pdf["label_lang"], "lang": langs, "confidence": pd.array(sure, dtype="Float64"), "segments": parts})

    rows = spread(df.select(F.col(id_col).alias("doc_id"), label_language(F.col(label_col)).alias("label_lang"), F.col(text_col).alias("text")))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(filled(run), f"doc_id {kind}, label_lang string, lang string, confidence double, segments array<struct<line_no: int, end_line: int, lang: string, confidence: double>>")


QUOTED = re.compile(r"[\"“„«][^\"“”„«»]{1,60}[\"”“»]")


def unquoted(text: str) -> str:
    """A text with the letters of short quotations blanked: a name quoted in a sentence tells nothing of its language."""
    return QUOTED.sub(lambda m: "\n".join(" " * len(x) for x in m.group().split("\n")), text)


def _classify(texts: list[str], table: np.ndarray, weights: np.ndarray, switch: float, least: int, share: float) -> Iterator[tuple]:
    s = spectra([unquoted(t) for t in texts], table)
    score = line_margins(weights, s)
    for i, text in enumerate(texts):
        a, b = s.first_line[i], s.first_line[i + 1]
        letters = s.letters[a:b]
        total = int(letters.sum())
        if not total:
            yield None, None, []
            continue
        lines = text.split("\n")
        own = score[a:b]
        parts = segments(own, letters, switch, max(least, int(share * total)))
        out, by = [], np.zeros(len(LANGUAGES), dtype=np.int64)
        for x, y, lang in parts:
            chars = sum(map(len, lines[x:y]))
            by[lang] += max(chars, 1)
            first = next((j for j in range(x, y) if lines[j].strip()), x)
            weight = np.minimum(s.worded[a + x : a + y] / 20.0, 2.0)
            mean = own[x:y].sum(axis=0) / max(float(weight.sum()), 1e-9)
            p = np.exp(mean - mean.max())
            out.append({"line_no": first + 1, "end_line": y, "lang": LANGUAGES[lang], "confidence": float(p[lang] / p.sum())})
        main = int(by.argmax())
        conf = float(np.average([x["confidence"] for x in out if x["lang"] == LANGUAGES[main]]))
        yield LANGUAGES[main], conf, out
