"""Lines repeated across one source's documents.

Every line is reduced to its letters, folded so that spelling, spacing, numbers and characters that scanners confuse
do not matter. In each source the words that few of its rows hold are masked, so that a name, user or date filled into
a fixed wording drops out. What is left is the key of the line.

For each source and key a compressed bitmap of the rows that hold it is stored: only its non-zero 64-bit words, as
(bucket, bits). Variant keys are mapped to the key they vary, once for each distinct key; the bitmaps of a key and its
variants are united by bit_or, their cardinalities are exact sums of bit counts, and the thresholds apply to these. A
line is deleted where the bit of its row stands in a doomed bitmap of its key.

Rows of a source travel in salted shares of it, so that no source has to fit into a task; what a share needs to know
of its source (common words, wordings, doomed bitmaps) comes before its rows in the same sorted partition.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled
from lodestrata.session import checkpointed, spread, stored

MARKER = re.compile(r"--- SOURCE:.*---\s*")
TOKEN = re.compile(r"[^\s|]+")
CODE = re.compile(r"(?=.*\d.*\d)\W*(?:[a-z]{1,3}[-/]?\d[\d/-]*[a-z]?[\d/-]*|[a-z]\d{2,4}-[a-z]\d{1,2}(?:-\d+)?)\W*")
# Characters that scanners confuse, with what they are folded to; the single letters come last.
CONFUSED = str.maketrans("0@+59$8|!1", "oatsgsblll")
MERGED = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("fi", "h"))
SAME = str.maketrans("ci", "el")
NO_DIGITS = str.maketrans("", "", "0123456789")
CODE_SIGN = "#"
# Units of measurement; lines with different units are different lines.
UNITS = set("v a w kw mw ma bar mbar kpa mpa pa hz khz mhz db nm mm cm m µm um ml l l/min rpm kg g mg °c °f c ohm kohm mohm s ms h min %".split())
GLUED = re.compile(r"\d[\d.,]*([^\d.,].*)")


def source_key(source: Column) -> Column:
    """Base name of a source, trimmed and lower-cased: sources that are equal in it are the same."""
    return F.lower(F.trim(F.regexp_extract(source, r"([^/\\]*)[/\\]*\s*$", 1)))


def fold_token(token: str) -> str:
    """Words of a blank-free token, equal for tokens that differ in case, accents, punctuation, numbers and commonly
    misread characters. A part code is kept as its letters after CODE_SIGN; a number is nothing."""
    t = token.lower().rstrip("!?.,;:*)]}>\"'’”»…")
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.replace("ß", "ss").replace("ı", "i"))
        t = "".join(c for c in t if not unicodedata.combining(c))
    if t.isalpha():
        digits = 0
    else:
        digits = sum(c.isdigit() for c in t)
    if digits >= 2 or (digits == 1 and sum(c.isalpha() for c in t) < 3):
        if CODE.fullmatch(t):
            return CODE_SIGN + "".join(c for c in t if c.isalpha())
        t = t.translate(NO_DIGITS)
        if not (t := "".join(c if c.isalpha() else " " for c in t).strip()) or len(t) <= 2:
            return ""
    if not any(c.isalpha() for c in t):
        return ""
    t = t.translate(CONFUSED)
    t = t.replace("-", "").replace("'", "").replace("’", "")
    if not t.isalpha():
        t = " ".join("".join(c if c.isalpha() else " " for c in t).split())
    for pair, one in MERGED:
        t = t.replace(pair, one)
    return t.translate(SAME)


NUMBER, INITIAL = 1, 2


class Folder:
    """fold_token with a bounded cache; the result never depends on the cache."""

    def __init__(self, capacity: int = 300_000):
        self.cache: dict[str, tuple[str, int]] = {}
        self.capacity = capacity

    @staticmethod
    def entry(token: str) -> tuple[str, int]:
        """(words of the token, what it may be for the next one)."""
        if (m := GLUED.fullmatch(token)) and (unit := m[1].rstrip(".,;:").lower()) in UNITS and (len(unit) > 1 or unit in "vaw%"):
            return CODE_SIGN + unit, 0  # a lone s or l may be a misread digit
        if token[0].isdigit() and token[-1].isdigit():
            return fold_token(token), NUMBER
        return fold_token(token), INITIAL if len(token) == 2 and token[1] == "." and token[0].isupper() else 0

    def lines(self, text: str) -> list[str]:
        """The folded lines of a text: a unit after a number is kept like a code, an initial and the surname after it go."""
        cache = self.cache
        if len(cache) > self.capacity:
            cache.clear()
        out = []
        for line in text.split("\n"):
            if line.startswith("--- SOURCE:") and MARKER.fullmatch(line):
                out.append("")
                continue
            words: list[str] = []
            before = -1  # nothing yet
            for token in TOKEN.findall(line):
                e = cache.get(token)
                if e is None:
                    e = cache[token] = self.entry(token)
                word, kind = e
                if before > 0:
                    if before == INITIAL and token[0].isupper():
                        before = 0
                        continue
                    if before == NUMBER and (unit := token.rstrip(".,;:").lower()) in UNITS:
                        word, kind = CODE_SIGN + unit, 0
                if kind == INITIAL and before >= 0:
                    before = kind
                    continue
                before = kind if kind == NUMBER else 0
                if word:
                    words.append(word)
            out.append(" ".join(words))
        return out


def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _folded_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    folder = Folder()
    for pdf in batches:
        yield pdf.assign(lines=["\n".join(folder.lines(t)) for t in pdf["text"]])[["id", "src", "salt", "lines"]]


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that hold each word, by source, added up over what the task sees."""
    counts: dict[int, Counter[str]] = {}
    held = 0
    for pdf in batches:
        for src, lines in zip(pdf["src"].tolist(), pdf["lines"], strict=True):
            own = counts.get(src)
            if own is None:
                own = counts[src] = Counter()
            before = len(own)
            own.update(set(lines.split()))
            held += len(own) - before
        if held > 400_000:
            yield _counted(counts)
            counts, held = {}, 0
    yield _counted(counts)


def _counted(counts: dict[int, Counter[str]]) -> pd.DataFrame:
    rows = [(src, _word(w), n) for src, c in counts.items() for w, n in c.items() if w[0] != CODE_SIGN]
    return pd.DataFrame(rows, columns=["src", "word", "n"])


#: Between the key of a line and its words, which follow it where one longer word is masked.
WHOLE = "\t"


def _folded(text: str) -> str:
    t = text.translate(CONFUSED)
    for pair, one in MERGED:
        t = t.replace(pair, one)
    return t.translate(SAME)


@lru_cache(maxsize=1)
def folded_confusions() -> list[tuple[str, str, float]]:
    """(seen, meant, cost): what scanners confuse and folding leaves apart, as folded words show it."""
    from lodestrata.llm.scans import CHEAP, CONFUSIONS

    pairs = {(_folded(a), _folded(b)): 0.5 if (a, b) in CHEAP else 0.3 for a, b in CONFUSIONS}
    pairs["ru", "nl"] = 0.3  # rii for ni, of which ii is folded
    return [(a, b, c) for (a, b), c in pairs.items() if a != b and a.isalpha() and b.isalpha()]


def folded_cost(seen: str, word: str, limit: float = 1.0) -> float:
    """Weighted edit distance of two folded words, of which every edit is a confusion; above `limit` infinite."""
    inf = float("inf")
    if abs(len(seen) - len(word)) > 4:
        return inf
    rows = [[inf] * (len(word) + 1) for _ in range(len(seen) + 1)]
    rows[0][0] = 0.0
    for i in range(len(seen) + 1):
        for j in range(len(word) + 1):
            at = rows[i][j]
            if at > limit:
                continue
            if i < len(seen) and j < len(word) and seen[i] == word[j]:
                rows[i + 1][j + 1] = min(rows[i + 1][j + 1], at)
            for a, b, cost in folded_confusions():
                if seen.startswith(a, i) and word.startswith(b, j):
                    rows[i + len(a)][j + len(b)] = min(rows[i + len(a)][j + len(b)], at + cost)
    return rows[-1][-1] if rows[-1][-1] <= limit else inf


def misread_of(words: list[str], seeds: list[tuple[str, list[str]]]) -> int:
    """Position of the first seed that the words equal but for one word, which confusions explain; -1 if there is none."""
    for i, (_, parts) in enumerate(seeds):
        if len(parts) == len(words):
            other = [(a, b) for a, b in zip(words, parts) if a != b]
            if len(other) == 1 and CODE_SIGN not in (other[0][0][0], other[0][1][0]) and folded_cost(*other[0]) <= 1.0:
                return i
    return -1


@lru_cache(maxsize=300_000)
def _cached_word(word: str) -> int:
    return _word(word)


class Rare(dict):
    """Whether a word is rare in a source, by the hashes of its common words; codes are never rare."""

    def __init__(self, common: set[int]):
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> bool:
        out = self[word] = word[0] != CODE_SIGN and _cached_word(word) not in self.common
        return out


class Masker:
    """The key of a folded line: its words without those that are rare in its source; null if too little is left. Where
    a single masked word has a good part of the letters, the whole line follows the key, which may be empty."""

    def __init__(self, kept_share: float, many_slots_share: float):
        self.shares = kept_share, many_slots_share

    def key(self, line: str, rare: Rare) -> str | None:
        words = line.split(" ")
        if len(words) > 1:  # single letters tell nothing
            words = [w for w in words if len(w) > 1] or words
        kept = [w for w in words if not rare[w]]
        if not kept:
            return None
        masked = len(words) - len(kept)
        letters = len(line) if masked == 0 else sum(map(len, words))
        left = sum(map(len, kept)) - 1
        many = masked > 1 and sum(rare[w] and not rare[v] for v, w in zip(words, words[1:])) + rare[words[0]] > 1
        whole = masked == 1 and left < 0.7 * letters
        if (masked == 0 or left >= self.shares[many] * (letters - 1)) and any(w[0] != CODE_SIGN for w in kept):
            key = " ".join(kept)
            return f"{key}{WHOLE}{' '.join(words)}" if whole else key
        return f"{WHOLE}{' '.join(words)}" if whole else None


#: Kinds of rows in one partition: what a share of a source needs to know, and the share itself; or, as a result, the
#: bitmaps of its keys, the places of its lines, and the wordings that are frequent in it.
FACTS, SHARE = 0, 1
BITMAP, PLACES, WORDING = 0, 1, 2
KEYED = "kind int, src long, salt int, num long, txt string, blob binary"
PLACE = np.dtype([("line_no", "<i4"), ("key", "<i8")])
WORD_BITS = np.dtype([("bucket", "<i8"), ("bits", "<i8")])
#: Keys of a share that are held before their bitmaps are given out.
HELD = 300_000


def _key_hash(src: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key, seed=src & (1 << 64) - 1) - (1 << 63)


class _Share:
    """The keys of one share of a source with the rows that hold them."""

    def __init__(self, src: int, salt: int, common: set[int], frequent: float):
        self.src, self.salt, self.rare, self.frequent = src, salt, Rare(common), frequent
        self._clear()

    def _clear(self) -> None:
        self.seen = 0
        self.known: dict[str, int] = {}  # line to position of its key, -1 for none
        self.at: dict[str, int] = {}  # key to position
        self.hashes: list[int] = []
        self.held: list[int] = []  # positions of the keys of all lines, and below the rows of these lines
        self.rows: list[int] = []

    def _position(self, key: str | None) -> int:
        if not key:
            return -1
        i = self.at.get(key)
        if i is None:
            i = self.at[key] = len(self.hashes)
            self.hashes.append(_key_hash(self.src, key))
        return i

    def places(self, ident: int, lines: str, masker: Masker) -> bytes:
        numbers, positions = [], []
        known = self.known
        self.seen += 1
        for n, line in enumerate(lines.split("\n"), 1):
            if line:
                i = known.get(line)
                if i is None:
                    i = known[line] = self._position(masker.key(line, self.rare))
                if i >= 0:
                    numbers.append(n)
                    positions.append(i)
        if not numbers:
            return b""
        self.held += positions
        self.rows += [ident] * len(numbers)
        out = np.empty(len(numbers), PLACE)
        out["line_no"], out["key"] = numbers, [self.hashes[i] for i in positions]
        return out.tobytes()

    def results(self) -> Iterator[pd.DataFrame]:
        """Bitmaps of the keys, and wordings (keys without the whole line) that at least the share `frequent` of the rows
        hold. What is that frequent in the source is so in one of its parts."""
        least = self.frequent * self.seen * (1 - 1e-9)
        keys = list(self.at)
        key, row = np.array(self.held, dtype=np.int64), np.array(self.rows, dtype=np.int64)
        if len(key):
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
            key, row = key[fresh], row[fresh]
            bucket = row >> 6
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
            words = np.empty(len(first), WORD_BITS)
            words["bucket"] = bucket[first]
            words["bits"] = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (row & 63).astype(np.uint64)), first).view(np.int64)
            cuts = (np.searchsorted(key[first], np.arange(len(keys) + 1)) * WORD_BITS.itemsize).tolist()
            packed = words.tobytes()
            blobs = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
            yield _frame(BITMAP, self.src, self.salt, self.hashes, keys, blobs)
            wordings: dict[str, int] = {}
            of = np.array([wordings.setdefault(k.partition(WHOLE)[0], len(wordings)) for k in keys])[key]
            order = np.lexsort((row, of))
            of, row = of[order], row[order]
            n = np.bincount(of[np.r_[True, (of[1:] != of[:-1]) | (row[1:] != row[:-1])]], minlength=len(wordings))
            some = [(w, int(n[i])) for w, i in wordings.items() if w and n[i] >= least]
            if some:
                yield _frame(WORDING, self.src, self.salt, [x for _, x in some], [w for w, _ in some], None)
        self._clear()


def _frame(kind: int, src: int | list, salt: int | list, num: list, txt: list | None, blob: list | None) -> pd.DataFrame:
    out = pd.DataFrame({"kind": kind, "src": src, "salt": salt, "num": num, "txt": txt, "blob": blob})
    return out.astype({"kind": "int32", "src": "int64", "salt": "int32", "num": "int64"})


def _keys(masker: Masker):
    """Rows arrive by (src, salt, kind): the common words of a source as blob, with the share of the rows that makes a
    wording frequent as text; then ids with their folded lines. Yields bitmaps, places and wordings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share, common, frequent, of = None, set(), 0.0, None
        for pdf in batches:
            srcs, salts, ids, blobs = [], [], [], []
            for kind, src, salt, num, txt, blob in zip(pdf["kind"].tolist(), pdf["src"].tolist(), pdf["salt"].tolist(), pdf["num"].tolist(), pdf["txt"], pdf["blob"], strict=True):
                if of != (src, salt):
                    if share is not None:
                        yield from share.results()
                    share, common, frequent, of = None, set(), 0.0, (src, salt)
                if kind == FACTS:
                    common, frequent = set(np.frombuffer(blob, "<i8").tolist()), float(txt)
                    continue
                if share is None:
                    share = _Share(src, salt, common, frequent)
                if places := share.places(num, txt, masker):
                    srcs.append(src), salts.append(salt), ids.append(num), blobs.append(places)
                if len(share.known) > HELD:
                    yield from share.results()
            yield _frame(PLACES, srcs, salts, ids, None, blobs)
        if share is not None:
            yield from share.results()

    return run


def lacks_only(words: list[str], parts: list[str]) -> bool:
    """Whether words are parts without some of them, in order."""
    left = iter(parts)
    return all(w in left for w in words)


class Wordings:
    """The wordings of a source, most frequent first, with an index by their words."""

    def __init__(self, seeds: list[str], kept_share: float, lost_share: float):
        self.seeds = [(k, k.split(" ")) for k in seeds]
        self.shares = kept_share, lost_share
        self.first: dict[str, list[int]] = {}
        self.any: dict[str, list[int]] = {}
        self.place: dict[str, int] = {}
        for i, (k, parts) in enumerate(self.seeds):
            self.place.setdefault(k, i)
            self.first.setdefault(parts[0], []).append(i)
            for w in set(parts):
                self.any.setdefault(w, []).append(i)
        self.known: dict[str, int] = {}
        self.root = [self.variant(k) for k in seeds]
        for i, j in enumerate(self.root):  # a wording varies one before it, or itself
            self.root[i] = i if j == i else self.root[j]

    def variant(self, key: str) -> int:
        """Position of the first wording that the key equals or varies, -1 if there is none."""
        words = key.split(" ")
        near = set(self.any.get(words[0], ()))  # those that hold all its words
        for w in set(words):
            near.update(self.first.get(w, ()))  # those of which it holds all words
        near = sorted(near)
        i = variant_of(key, [self.seeds[j] for j in near], *self.shares)
        return near[i] if i >= 0 else -1

    def misread(self, words: list[str]) -> int:
        near = sorted({j for w in words[:2] for j in self.any.get(w, ())})
        i = misread_of(words, [self.seeds[j] for j in near])
        return near[i] if i >= 0 else -1

    def of(self, key: str) -> int:
        """The root of a key, -1 if it varies no wording."""
        short, _, whole = key.partition(WHOLE)
        i = -1
        if short in self.place:
            i = self.place[short]
        elif short:
            if short not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[short] = self.variant(short)
            i = self.known[short]
        if i < 0 and whole:
            i = self.misread(whole.split(" "))
        return self.root[i] if i >= 0 else -1


def variant_of(key: str, seeds: list[tuple[str, list[str]]], kept_share: float, lost_share: float) -> int:
    """Position of the first of the seeds, most frequent first, that the key equals, that it becomes without one or
    two words in a row (a filled-in name that is itself common), or of which it lacks only words with at most `lost_share` of the
    letters (misread ones, which are rare and so masked); -1 if there is none."""
    words = key.split(" ")
    own = set(words)
    for i, (seed, parts) in enumerate(seeds):
        if key == seed:
            return i
        n, m = len(parts), len(words)
        if n + 2 >= m > n >= 2 and len(seed) >= kept_share * len(key) and all(w in own for w in parts):
            head = next((j for j in range(n) if words[j] != parts[j]), n)
            tail = next((j for j in range(n) if words[-1 - j] != parts[-1 - j]), n)
            if head + tail >= n:
                return i
        elif m < n and len(key) >= (1 - lost_share) * len(seed) and lacks_only(words, parts):
            return i
    return -1


def _roots(kept_share: float, lost_share: float):
    """Rows arrive by (src, salt, kind): the wordings of a source, one on a line; then keys with their bitmaps. Yields the
    keys that have a root, with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, wordings = None, None
        for pdf in batches:
            out: list[tuple] = []
            for kind, src, salt, num, txt, blob in zip(pdf["kind"].tolist(), pdf["src"].tolist(), pdf["salt"].tolist(), pdf["num"].tolist(), pdf["txt"], pdf["blob"], strict=True):
                if kind == FACTS:
                    if of != src:
                        wordings, of = Wordings(txt.split("\n"), kept_share, lost_share), src
                elif of == src and (root := wordings.of(txt)) >= 0:
                    bitmap = np.frombuffer(blob, WORD_BITS)
                    out.append((src, salt, root, num, bitmap["bucket"], bitmap["bits"]))
            yield pd.DataFrame(out, columns=["src", "salt", "root", "key", "buckets", "bits"]).astype({"salt": "int32", "root": "int32"})

    return run


def _deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive by (src, salt, kind): the doomed bitmaps of the share, one row for each key; then the places of the
    lines of its rows. Yields the places whose row stands in the bitmap of their key."""
    of, doomed = None, {}
    for pdf in batches:
        ids, at = [], []
        for kind, src, salt, num, blob in zip(pdf["kind"].tolist(), pdf["src"].tolist(), pdf["salt"].tolist(), pdf["num"].tolist(), pdf["blob"], strict=True):
            if of != (src, salt):
                of, doomed = (src, salt), {}
            if kind == FACTS:
                bitmap = np.frombuffer(blob, WORD_BITS)
                own = doomed.setdefault(num, {})
                for b, w in zip(bitmap["bucket"].tolist(), bitmap["bits"].tolist()):
                    own[b] = own.get(b, 0) | w
            elif doomed:
                for n, key in np.frombuffer(blob, PLACE).tolist():
                    bits = doomed.get(key)
                    if bits and bits.get(num >> 6, 0) >> (num & 63) & 1:
                        ids.append(num), at.append(n)
        yield pd.DataFrame({"id": ids, "line_no": at}).astype({"id": "int64", "line_no": "int32"})


def _alongside(facts: DataFrame, rows: DataFrame, shares: int) -> DataFrame:
    """facts and rows of the same (src, salt) in one partition, facts first."""
    both = facts.select("kind", "src", "salt", "num", "txt", "blob").unionByName(rows.select("kind", "src", "salt", "num", "txt", "blob"))
    return both.repartition(shares, "src", "salt").sortWithinPartitions("src", "salt", "kind")


def repeated_lines(
    df: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    least_rows: int = 8,
    least_share: float = 0.2,
    kept_share: float = 0.45,
    many_slots_share: float = 0.7,
    lost_share: float = 0.4,
    wording_share: float = 0.4,
    share_rows: int = 20_000,
    most_large: int = 1_000_000,
) -> DataFrame:
    """(id, line_no): every line to be removed, line_no counted from 1 over the text split at newlines.

    A line counts if it and its variants stand together in at least `least_rows` rows of its source and in at least
    `least_share` of them. Variants are united if one of their forms reaches `wording_share` of that. Rows count by id, also
    those loaded twice; repeats within a row count once, but each is a case. Lines without letters and marker lines
    never count. Rows with a null id, source or text hold no lines, but a row with a source and a null text counts as a
    row of it. An empty table gives no rows; other columns are ignored.

    Sources with more than `share_rows` rows are divided into shares; at most `most_large` of them are told to the
    executors, as the shares grow with the table beyond that.
    """
    src = F.xxhash64(source_key(F.col(source_col)))
    named = df.filter(F.col(id_col).isNotNull() & F.col(source_col).isNotNull()).select(src.alias("src"))
    totals = checkpointed(named.groupBy("src").agg(F.count("*").alias("rows")))
    table = totals.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    share_rows = max(share_rows, -(-table // most_large))
    totals = totals.withColumn("salts", F.ceil(F.col("rows") / share_rows).cast("int")).withColumn("need", F.greatest(F.lit(float(least_rows)), F.col("rows") * least_share))
    large = F.broadcast(totals.filter("salts > 1").select("src", "salts"))  # at most table / share_rows
    rows = df.select(F.col(id_col).cast("long").alias("id"), src.alias("src"), F.col(source_col).isNotNull().alias("ok"), F.col(text_col).alias("text"))
    rows = spread(rows).filter("id is not null and ok and text is not null").join(large, "src", "left")
    # the 64 ids of a bitmap's word are in one share
    salt = F.coalesce(F.pmod(F.xxhash64(F.shiftright("id", 6)), F.col("salts")), F.lit(0)).cast("int")
    rows = rows.select("id", "src", salt.alias("salt"), "text")
    folded = stored(rows.mapInPandas(filled(_folded_lines), "id long, src long, salt int, lines string"))
    shares = max(1, -(-table // share_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    # words of at least half the required rows of their source
    common = folded.select("src", "lines").mapInPandas(filled(_word_counts), "src long, word long, n long").groupBy("src", "word").agg(F.sum("n").alias("n"))
    common = common.join(totals, "src").filter(F.col("n") >= F.col("need") / 2)
    # at most the words of a mean row / (least_share / 2) for each source
    common = common.groupBy("src").agg(F.collect_list("word").alias("words"))
    each_share = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    frequent = (F.col("need") * wording_share / F.col("rows")).cast("string")
    known = totals.join(common, "src", "left").select("src", each_share, frequent.alias("txt"), F.coalesce("words", F.array().cast("array<bigint>")).alias("words"))
    known = known.mapInPandas(filled(_packed_words), "kind int, src long, salt int, num long, txt string, blob binary")
    lines = folded.select(F.lit(SHARE).alias("kind"), "src", "salt", F.col("id").alias("num"), F.col("lines").alias("txt"), F.lit(None).cast("binary").alias("blob"))
    keyed = stored(_alongside(known, lines, shares).mapInPandas(filled(_keys(Masker(kept_share, many_slots_share))), KEYED))

    # wordings, the most frequent first, then the shortest: at most the lines of a mean row / (least_share * wording_share) for each source
    seeds = keyed.filter(F.col("kind") == WORDING).groupBy("src", F.col("txt").alias("key")).agg(F.sum("num").alias("n")).join(totals, "src")
    seeds = seeds.filter(F.col("n") >= F.col("need") * wording_share).groupBy("src", "salts").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.length("key").alias("size"), "key"))).alias("keys"))
    seeds = checkpointed(seeds.select("src", "salts", F.array_join(F.transform("keys", lambda x: x["key"]), "\n").alias("txt")))
    facts = seeds.select(F.lit(FACTS).alias("kind"), "src", each_share, F.lit(0).cast("long").alias("num"), "txt", F.lit(None).cast("binary").alias("blob"))
    keys = keyed.filter(F.col("kind") == BITMAP).withColumn("kind", F.lit(SHARE))
    rooted = _alongside(facts, keys, shares).mapInPandas(filled(_roots(kept_share, lost_share)), "src long, salt int, root int, key long, buckets array<long>, bits array<long>")
    rooted = checkpointed(rooted)
    words = rooted.select("src", "root", F.explode(F.arrays_zip("buckets", "bits")).alias("w"))
    united = words.groupBy("src", "root", F.col("w.buckets").alias("bucket")).agg(F.bit_or("w.bits").alias("bits"))
    united = united.groupBy("src", "root").agg(F.sum(F.bit_count("bits")).alias("n")).join(totals, "src")
    hot = united.filter(F.col("n") >= F.col("need")).select("src", "root")
    doomed = rooted.join(hot, ["src", "root"]).mapInPandas(filled(_packed_bitmaps), "kind int, src long, salt int, num long, txt string, blob binary")
    places = keyed.filter(F.col("kind") == PLACES).withColumn("kind", F.lit(SHARE))
    return _alongside(doomed, places, shares).select("kind", "src", "salt", "num", "blob").mapInPandas(filled(_deleted), "id long, line_no int")


def _packed_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(kind=FACTS, num=0, blob=[np.asarray(w, dtype="<i8").tobytes() for w in pdf["words"]]).drop(columns="words")


def _packed_bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        blobs = []
        for buckets, bits in zip(pdf["buckets"], pdf["bits"], strict=True):
            out = np.empty(len(buckets), WORD_BITS)
            out["bucket"], out["bits"] = buckets, bits
            blobs.append(out.tobytes())
        yield pd.DataFrame({"kind": FACTS, "src": pdf["src"], "salt": pdf["salt"], "num": pdf["key"], "txt": None, "blob": blobs})


def remove_lines(df: DataFrame, id_col: str, text_col: str, doomed: DataFrame) -> DataFrame:
    """df with the listed lines (id, line_no) cut out of its texts; all other lines stay as they are."""
    per_row = doomed.groupBy("id").agg(F.collect_set("line_no").alias("_doomed_lines")).withColumnRenamed("id", "_doomed_id")
    joined = df.join(per_row, F.col(id_col) == F.col("_doomed_id"), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    keep = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_doomed_lines"), i + 1))
    text = F.when(F.col("_doomed_lines").isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n"))
    return joined.withColumn(text_col, text).drop("_doomed_id", "_doomed_lines")
