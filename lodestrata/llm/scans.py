"""Noise in text from scanned pages: words divided at line ends, misread characters, running titles, page numbers.

A lexicon of all words of the corpus with their frequencies is indexed by symmetric deletes: a folded word and each
string that it becomes without one character. Rare words that meet a frequent one in the index are its misreadings if
their weighted edit distance, in which only confusions of scanners are cheap, stays within the limit; where several
repairs remain, the bigram with the preceding word decides, then the frequency.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled
from lodestrata.llm.repeated_lines import Folder, source_key
from lodestrata.session import checkpointed, small_side, spread

MARKER = re.compile(r"--- SOURCE:.*---\s*")
HYPHENS = "-­‐‑‒–¬"
DIVIDED = re.compile(rf"(\S+)[{HYPHENS}]\s*$")
# Fixed values: (what a scanner reads, what is printed), with the cost of the confusion.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("+", "t"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("$", "s"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("l!", "h"), ("l1", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("rr", "n"), ("nn", "m"), ("in", "m"), ("iii", "m"), ("l", "i"), ("i", "l"), ("l", "t"), ("f", "t"), ("t", "f"), ("o", "a"), ("fi", "h"), ("u", "v"), ("v", "u"), ("ğ", "g"), ("g", "ğ"), ("ı", "i"), ("i", "ı"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("b", "h"), ("h", "b"), ("q", "g"), ("tl", "d"), ("c1", "d"), ("c!", "d"), ("c|", "d"), ("1i", "h"), ("1!", "h"), ("r!", "n"), ("r1", "n"), ("!i", "u"), ("i!", "u"), ("!!", "u"), ("6", "é"), ("r11", "m"),
]
CHEAP = {("l", "t"), ("f", "t"), ("t", "f"), ("o", "a"), ("u", "v"), ("v", "u"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("b", "h"), ("h", "b")}
#: The confusions by the first character that is read: (seen, meant, cost).
BY_FIRST: dict[str, list[tuple[str, str, float]]] = {}
for _a, _b in CONFUSIONS:
    BY_FIRST.setdefault(_a[0], []).append((_a, _b, 0.5 if (_a, _b) in CHEAP else 0.3))
# Words of page lines in the six languages.
PAGE_WORDS = set("page pages p pg pag pág seite s blatt bl sheet sh sayfa sf yaprak página pagina hoja foglio feuille folio f of von de sur di da aus from vom".split())
ROMAN = re.compile(r"(?i)(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
DIGIT_LIKE = re.compile(r"[\dOoIlSsBbZzGgqi!|]{1,4}")
NUMBER = re.compile(r"[\dOoIlSsBbZz!|]+(?:[.,][\dOoIlSsBbZz!|]+)?")
COMPONENT = re.compile(r"[A-Z]\d")
CODE = re.compile(r"[A-Z]{1,3}[-/]?\d[A-Z\d/-]*|[A-Z]\d+-[A-Z]\d+\S*|[A-Z]{1,3}-\S*\d\S*")
OUTER = re.compile(r"^[\s.,;:()\[\]{}\"'’“”„«»?¿¡*<>=~_|#/–—-]+|[\s.,;:()\[\]{}\"'’“”„«»?!*<>=~_|#/–—-]+$")
WORDLIKE = re.compile(r"[^\W_]*(?:[@+!|$'’-]?[^\W_]+)*[@+]?|[@+][^\W_]+")


@lru_cache(maxsize=300_000)
def word_of(token: str) -> str | None:
    """The lower-cased word in a blank-free token, null for numbers, codes and what has hardly a letter."""
    t = token.rstrip(".,;:")
    if t.isalpha() and len(t) > 1:
        return t.lower()
    t = OUTER.sub("", token)
    if len(t) < 2 or CODE.fullmatch(t) or not WORDLIKE.fullmatch(t):
        return None
    letters = sum(c.isalpha() for c in t)
    if letters < 2 or letters < 0.5 * len(t):
        return None
    return t.lower()


@lru_cache(maxsize=100_000)
def misread_number(token: str) -> bool:
    """Whether a token is a number in which letters stand for digits."""
    t = OUTER.sub("", token)
    if len(t) < 2 or not NUMBER.fullmatch(t) or COMPONENT.fullmatch(t):
        return False
    digits = sum(c.isdigit() for c in t)
    other = sum(c not in "0123456789.," for c in t)
    return bool(other) and digits >= 1 and not (t[-1] in "lsgAVW" and other == 1 and digits >= 1 and t[:-1].replace(".", "").replace(",", "").isdigit())


@lru_cache(maxsize=200_000)
def confusion_cost(seen: str, word: str, limit: float = 1.0) -> float:
    """Weighted edit distance in which every edit must be a confusion; above `limit` infinite."""
    inf = float("inf")
    rows = [[inf] * (len(word) + 1) for _ in range(len(seen) + 1)]
    rows[0][0] = 0.0
    for i in range(len(seen) + 1):
        for j in range(len(word) + 1):
            at = rows[i][j]
            if at > limit:
                continue
            if i < len(seen) and j < len(word) and seen[i] == word[j]:
                rows[i + 1][j + 1] = min(rows[i + 1][j + 1], at)
            for a, b, step in BY_FIRST.get(seen[i : i + 1], ()):
                if seen.startswith(a, i) and word.startswith(b, j):
                    rows[i + len(a)][j + len(b)] = min(rows[i + len(a)][j + len(b)], at + step)
    return rows[-1][-1] if rows[-1][-1] <= limit else inf


def page_number_form(line: str) -> tuple[str, bool] | None:
    """(form, certain) of a line that may only give the page: its words with 0 for the numbers."""
    t = line.strip()
    if not t or len(t) > 30:
        return None
    tokens = re.findall(r"[\w!|]+", t)
    if not 1 <= len(tokens) <= 4:
        return None
    out, numbers, sure = [], 0, False
    for x in tokens:
        if x.isdigit() and len(x) <= 4 or (len(x) <= 7 and ROMAN.fullmatch(x) and x.lower() not in ("c", "d", "m", "di")):
            out.append("0")
            numbers += 1
            sure = True
        elif x.lower() in PAGE_WORDS:
            out.append(x.lower())
        elif DIGIT_LIKE.fullmatch(x):
            out.append("0")
            numbers += 1
        else:
            return None
    if not 1 <= numbers <= 2 or len(tokens) - numbers > 2:
        return None
    return " ".join(out), sure


def body_bounds(lines: list[str]) -> tuple[list[int], list[int]]:
    """Positions of the first and of the last few non-blank lines, without the marker line."""
    at = [i for i, x in enumerate(lines) if x.strip() and not (x.startswith("--- SOURCE:") and MARKER.fullmatch(x))]
    return at[:2], at[-2:][::-1]


def _edges(lines: list[str], folder: Folder) -> dict:
    """Page lines and candidate running titles of a page; -1 where there is none."""
    first, last = body_bounds(lines)
    page = {}
    for side in (first, last):
        for n, i in enumerate(side[:2]):
            if (form := page_number_form(lines[i])) and (n == 0 or side is last or i not in page):
                page.setdefault(i, form)
    top = next((i for i in first if i not in page), -1)
    bottom = next((i for i in last if i not in page and i != top), -1)
    key = lambda i: folder.lines(lines[i])[0] if i >= 0 else ""
    return {"page": page, "top": top, "bottom": bottom, "top_key": key(top), "bottom_key": key(bottom)}


def _tokens(lines: list[str]) -> Iterator[tuple[int, str, int, str]]:
    """(line, token, line of the rest, rest): the tokens of a page, divided ones with their rest on the next line."""
    skip = None
    for i, line in enumerate(lines):
        if line.startswith("--- SOURCE:") and MARKER.fullmatch(line):
            continue
        tokens = line.split()
        if skip is not None and tokens:
            tokens = tokens[1:]
            skip = None
        rest, at = "", -1
        if tokens and DIVIDED.search(line) and len(tokens[-1]) > 1:
            at = next((j for j in range(i + 1, len(lines)) if lines[j].strip()), -1)
            rest = lines[at].split()[0] if at >= 0 else ""
        for t in tokens[:-1] if rest else tokens:
            yield i, t, -1, ""
        if rest:
            skip = at
            yield i, tokens[-1].rstrip(HYPHENS), at, rest


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    joined: Counter[str] = Counter()
    for pdf in batches:
        for text, scan in zip(pdf["text"], pdf["scan"], strict=True):
            if scan:
                for _, t, at, rest in _tokens(text.split("\n")):
                    w = word_of(t + rest)
                    if w:
                        (joined if at >= 0 else counts)[w] += 1
            else:
                counts.update(w for w in map(word_of, text.split()) if w)
        if len(counts) + len(joined) > 400_000:
            yield _counted(counts, joined)
            counts, joined = Counter(), Counter()
    yield _counted(counts, joined)


def _counted(counts: Counter, joined: Counter) -> pd.DataFrame:
    words = list(counts.keys() | joined.keys())
    return pd.DataFrame({"word": words, "n": [counts[w] for w in words], "j": [joined[w] for w in words]})


# Characters that scanners confuse, with the form under which the index keeps them.
SIGNS = str.maketrans("0@+5968$|134", "oatsgbbsllea")
PAIRS = (("li", "h"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"))
LETTERS = str.maketrans("ci", "el")


def index_forms(word: str) -> set[str]:
    """Forms of which most misreadings of a word share one: overlapping pairs are taken in either order."""
    t = unicodedata.normalize("NFKD", word.replace("ß", "ss").replace("ı", "i"))
    t = "".join(c for c in t if not unicodedata.combining(c) and c not in "-'’").replace("!", "i").translate(SIGNS)
    forms = set()
    for order in (PAIRS, PAIRS[::-1]):
        f = t
        for pair, one in order:
            f = f.replace(pair, one)
        forms.add(f.translate(LETTERS))
    return forms


def _deletes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The symmetric-delete keys of each word: its index form, and that without one character."""
    for pdf in batches:
        words, keys = [], []
        for w in pdf["word"]:
            own = index_forms(w)
            own |= {f[:i] + f[i + 1 :] for f in own if len(f) > 3 for i in range(len(f))}
            words += [w] * len(own)
            keys += [xxhash.xxh64_intdigest(k) - (1 << 63) for k in own]
        yield pd.DataFrame({"word": words, "key": keys})


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cost = [confusion_cost(s, w) for s, w in zip(pdf["seen"], pdf["word"], strict=True)]
        yield pdf.assign(cost=cost)[lambda x: x["cost"] < 10]


def lexicon(rows: DataFrame, ratio: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, candidates): vocabulary(word, n, j) counts every word as it stands, and joined over line ends;
    candidates(seen, word, n, cost) are the repairs of each word that a confusion explains and that is `ratio` times
    as frequent. Both come from all rows."""
    vocabulary = rows.mapInPandas(filled(_vocabulary), "word string, n long, j long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("j").alias("j"))
    vocabulary = checkpointed(vocabulary)
    words = vocabulary.filter(F.col("n") >= ratio)
    index = words.filter(~F.col("word").rlike(r"[0-9@+!|$]")).select("word").mapInPandas(filled(_deletes), "word string, key long")
    seen = vocabulary.select("word").mapInPandas(filled(_deletes), "word string, key long").withColumnRenamed("word", "seen")
    pairs = seen.join(index, "key").filter(F.col("seen") != F.col("word")).select("seen", "word").distinct()
    pairs = pairs.join(vocabulary.select(F.col("word").alias("seen"), (F.col("n") + F.col("j")).alias("m")), "seen")
    pairs = pairs.join(words.select("word", "n"), "word").filter(F.col("n") >= F.col("m") * ratio)
    found = pairs.select("seen", "word", "n").mapInPandas(filled(_costs), "seen string, word string, n long, cost double")
    found = checkpointed(found)
    misread = found.select(F.col("seen").alias("word")).distinct()  # a frequent misreading repairs nothing
    return vocabulary, checkpointed(found.join(misread, "word", "left_anti"))


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    folder = Folder()
    for pdf in batches:
        out = []
        for ident, src, ci, text in zip(pdf["id"].tolist(), pdf["src"].tolist(), pdf["ci"], pdf["text"], strict=True):
            lines = text.split("\n")
            e = _edges(lines, folder)
            forms = [f for f, _ in e["page"].values()]
            body = next((i for i in range(len(lines)) if lines[i].strip() and i not in e["page"] and i != e["top"] and not lines[i].startswith("--- SOURCE:")), -1)
            words = [lines[i].split()[0] if i >= 0 else "" for i in (e["top"], body)]
            out.append((ident, src, None if pd.isna(ci) else int(ci), e["top_key"], e["bottom_key"], forms, *words))
        yield pd.DataFrame(out, columns=["id", "src", "ci", "top_key", "bottom_key", "forms", "top_word", "body_word"]).astype({"ci": "Int64"})


def _near(a: str | None, b: str) -> bool:
    if not a or not b or abs(len(a) - len(b)) > 4:
        return False
    same = sum(x == y for x, y in zip(a, b)) + sum(x == y for x, y in zip(a[::-1], b[::-1]))
    return same >= 1.5 * max(len(a), len(b))


def _evidence(known: set[str]):
    """Per page: the certain cases, and words whose cases a lookup decides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                lines = r.text.split("\n")
                e = _edges(lines, folder)
                edges = {*e["page"], e["top"], e["bottom"]}
                width = max((len(x) for i, x in enumerate(lines) if i not in edges and not x.startswith("--- SOURCE:")), default=0)
                forms = set(r.page_forms) if r.page_forms is not None else set()
                edge = set()
                for i, (form, sure) in e["page"].items():
                    if form in forms or (sure and len(forms) == 0):
                        out.append((r.id, i + 1, "page_number", None, None, None, None))
                        edge.add(i)
                for side, key in (("top", e["top_key"]), ("bottom", e["bottom_key"])):
                    i = e[side]
                    if i < 0 or not key:
                        continue
                    line = lines[i].strip()
                    open_end = line[-1] not in ".;,:" + HYPHENS and not line[0].islower()
                    times = r.top_times if side == "top" else r.bottom_times
                    after = next((x for x in lines[i + 1 :] if x.strip()), "")
                    short = bool(after) and len(line) + 1 + len(after.split()[0]) <= width
                    alike = side == "top" and (_near(r.prev_key, key) or _near(r.next_key, key))
                    if side == "top":
                        title = open_end and (times >= 4 or short and (times >= 2 or alike) or (short and r.title_share >= 0.3 and not line.isupper() and not re.match(r"\d+\.\d", line)))
                    else:
                        title = open_end and (times >= 3 and times >= 0.05 * r.pages)
                    if title:
                        out.append((r.id, i + 1, "header", None, None, None, None))
                        edge.add(i)
                before = None
                for i, token, at, rest in _tokens(lines):
                    if i in edge:
                        continue
                    if at in edge:  # the rest of the word stands after the running lines of this page
                        at, rest = -1, ""
                    if at >= 0:
                        out.append((r.id, i + 1, "join", token, rest, before, at + 1))
                    else:
                        if misread_number(token):
                            out.append((r.id, i + 1, "char", None, None, None, None))
                        w = word_of(token)
                        if w and w not in known:
                            out.append((r.id, i + 1, "word", w, None, before, None))
                        before = w
                last = next((i for i in range(len(lines) - 1, -1, -1) if lines[i].strip() and i not in edge), -1)
                if last >= 0 and DIVIDED.search(lines[last]) and r.next_top:
                    rest = r.next_body if r.next_titled else r.next_top
                    token = lines[last].split()[-1].rstrip(HYPHENS)
                    if token and rest:
                        out.append((r.id, last + 1, "join", token, rest, None, None))
            yield pd.DataFrame(out, columns=["id", "line_no", "kind", "a", "b", "before", "at"]).astype({"line_no": "int32", "at": "Int32"})

    return run


def _bigrams(wanted: set[str] | None):
    """Pairs of words in a row; only those whose second word is among `wanted`, if it is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for text, scan in zip(pdf["text"], pdf["scan"], strict=True):
                tokens = [t + rest for _, t, _, rest in _tokens(text.split("\n"))] if scan else MARKER.sub("", text).split()
                for first, second in zip(tokens, tokens[1:]):
                    w = word_of(second)
                    if w and (wanted is None or w in wanted) and (before := word_of(first)):
                        counts[before, w] += 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["before", "word", "k"])

    return run


def _joins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words to look up for each divided word: without the hyphen, and with it."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            a, b = OUTER.sub("", r.a), OUTER.sub("", r.b)
            if not a or not b or any(c.isdigit() for c in a) and CODE.match(a) or CODE.fullmatch(b):
                continue
            if sum(c.isalpha() for c in a) < max(1, 0.6 * len(a)) or not b[0].isalpha() and b[0] not in "@+!|0156893":
                continue
            whole, compound = (a + b).lower(), (a + "-" + b).lower()
            out.append((r.id, r.line_no, a.lower(), b.lower(), r.at, whole, compound))
        yield pd.DataFrame(out, columns=["id", "line_no", "a", "b", "at", "whole", "compound"]).astype({"line_no": "int32", "at": "Int32"})


def _analysed(
    df: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    order_col: str,
    widest: int = 90,
    scan_share: float = 0.5,
    ratio: float = 8.0,
    known_words: int = 50_000,
    broadcast_sources: int = 1_000_000,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(defects, repairs, pages, whole) of scan_defects and repaired_paragraphs: pages(id, src, name, ci, text) are the
    scanned ones, whole(id, line_no, seen, repair) the repairs of words divided at the end of a line."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("_name"), F.col(order_col).cast("long").alias("ci"), F.col(text_col).alias("text"))
    rows = spread(rows).filter("id is not null and _name is not null and text is not null").withColumn("name", source_key(F.col("_name"))).withColumn("src", F.xxhash64("name")).drop("_name")
    prose = F.regexp_replace("text", r"(?m)^--- SOURCE:.*---\s*$", "")
    long_line = F.col("text").rlike(rf"(?m)^(?!--- SOURCE:)[^\n]{{{widest + 1},}}")
    rows = rows.withColumn("narrow", ~long_line & (F.length(F.trim(prose)) > 0))
    scans = rows.groupBy("src").agg(F.avg(F.col("narrow").cast("int")).alias("share")).filter(F.col("share") >= scan_share).select("src", F.lit(True).alias("scanned"))
    scans = checkpointed(scans)
    rows = rows.join(F.broadcast(scans) if scans.count() <= broadcast_sources else scans, "src", "left").withColumn("scan", F.col("narrow") & F.coalesce("scanned", F.lit(False)))
    vocabulary, candidates = lexicon(rows.select("text", "scan"), ratio)
    misread = candidates.select(F.col("seen").alias("word")).distinct()
    good = vocabulary.filter(F.col("n") >= ratio).join(misread, "word", "left_anti").orderBy(F.desc("n"), "word").limit(known_words)
    known = {r.word for r in good.select("word").collect()}

    printed = rows.filter("scan").select("id", "src", "name", "ci", "text")
    pages = printed.drop("name")
    facts = checkpointed(pages.mapInPandas(filled(_pages), "id long, src long, ci long, top_key string, bottom_key string, forms array<string>, top_word string, body_word string"))
    by_source = facts.groupBy("src").agg(F.countDistinct("id").alias("pages"))
    keys = facts.select("src", "ci", F.explode(F.array("top_key", "bottom_key")).alias("key")).filter("key <> ''").groupBy("src", "key").agg(F.countDistinct("ci").alias("times"))
    titled = facts.join(keys.filter("times >= 2").select("src", F.col("key").alias("top_key"), F.col("times")), ["src", "top_key"]).groupBy("src").agg(F.count("*").alias("titled"))
    forms = facts.select("src", F.explode("forms").alias("form")).groupBy("src", "form").agg(F.count("*").alias("k")).join(by_source, "src")
    forms = forms.filter((F.col("k") >= 2) & (F.col("k") >= 0.1 * F.col("pages"))).groupBy("src").agg(F.collect_list("form").alias("page_forms"))
    per_source = by_source.join(titled, "src", "left").join(forms, "src", "left").withColumn("title_share", F.coalesce(F.col("titled") / F.col("pages"), F.lit(0.0)))

    # one row for each page of a source: the copy with the smallest id stands for those loaded twice
    one = facts.filter("ci is not null").groupBy("src", "ci").agg(F.min_by(F.struct("top_key", "top_word", "body_word"), "id").alias("p"))
    # pages without a title or an order meet no other: each is joined by a key of its own, so that no task has them all
    lone = lambda key, own: F.when(key == "", F.concat(F.lit("\n"), own.cast("string"))).otherwise(key)
    one = one.withColumn("k", lone(F.col("p.top_key"), F.col("ci"))).join(keys.select("src", F.col("key").alias("k"), "times"), ["src", "k"], "left").select("src", "ci", "p", F.coalesce("times", F.lit(0)).alias("times"))
    after = one.select("src", (F.col("ci") - 1).cast("string").alias("at"), F.col("p.top_key").alias("next_key"), F.col("p.top_word").alias("next_top"), F.col("p.body_word").alias("next_body"), (F.col("times") >= 2).alias("next_titled"))
    prior = one.select("src", (F.col("ci") + 1).cast("string").alias("at"), F.col("p.top_key").alias("prev_key"))
    times = lambda name: keys.select("src", F.col("key").alias(f"{name}_at"), F.col("times").alias(f"{name}_times"))
    context = facts.select("id", "src", F.coalesce(F.col("ci").cast("string"), F.concat(F.lit("\n"), F.col("id").cast("string"))).alias("at"), lone(F.col("top_key"), F.col("id")).alias("top_at"), lone(F.col("bottom_key"), F.col("id")).alias("bottom_at"))
    context = context.join(times("top"), ["src", "top_at"], "left").join(times("bottom"), ["src", "bottom_at"], "left")
    context = context.join(after, ["src", "at"], "left").join(prior, ["src", "at"], "left").join(small_side(per_source, broadcast_sources), "src", "left")
    context = context.select(
        "id", "pages", "title_share", "page_forms", "next_key", "next_top", "next_body", F.coalesce("next_titled", F.lit(False)).alias("next_titled"), "prev_key",
        F.coalesce("top_times", F.lit(0)).alias("top_times"), F.coalesce("bottom_times", F.lit(0)).alias("bottom_times"),
    )
    evidence = pages.select("id", "text").join(context, "id").mapInPandas(filled(_evidence(known)), "id long, line_no int, kind string, a string, b string, before string, at int")
    evidence = checkpointed(evidence)

    certain = evidence.filter(F.col("kind").isin("page_number", "header", "char")).select("id", "line_no", F.col("kind").alias("defect"))
    joins = evidence.filter("kind = 'join'").mapInPandas(filled(_joins), "id long, line_no int, a string, b string, at int, whole string, compound string")
    count = vocabulary.select("word", "n")
    joins = joins.join(count.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").join(count.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
    repaired = candidates.groupBy(F.col("seen").alias("whole")).agg(F.min_by(F.struct("word", "n"), F.struct("cost", -F.col("n"), "word")).alias("best"))
    joins = checkpointed(joins.join(repaired, "whole", "left"))
    strength = F.greatest(F.coalesce("n_whole", F.lit(0)), F.coalesce("best.n", F.lit(0)))
    hyphens = joins.filter(strength >= F.coalesce("n_compound", F.lit(0))).select("id", "line_no", F.lit("hyphen").alias("defect"))

    # misread words: the repair that the word before it makes likeliest, then the cheapest, then the most frequent
    words = evidence.filter("kind = 'word'").select("id", "line_no", F.col("a").alias("seen"), "before")
    options = words.join(candidates, "seen")
    misread_at = options.select("id", "line_no")
    unsure = words.join(candidates.groupBy("seen").count().filter("count > 1").select("seen"), "seen", "left_semi").join(candidates, "seen")
    need = unsure.filter("before is not null").select(F.xxhash64("before", "word").alias("gram")).distinct()
    second = unsure.select("word").distinct().limit(known_words + 1).collect()
    wanted = {r.word for r in second} if len(second) <= known_words else None
    grams = rows.select("text", "scan").mapInPandas(filled(_bigrams(wanted)), "before string, word string, k long").select(F.xxhash64("before", "word").alias("gram"), "k")
    grams = grams.join(need, "gram", "left_semi").groupBy("gram").agg(F.sum("k").alias("k"))
    options = options.withColumn("gram", F.xxhash64("before", "word")).join(grams, "gram", "left").fillna(0, ["k"])
    pick = Window.partitionBy("id", "line_no", "seen").orderBy(F.desc("k"), "cost", F.desc("n"), "word")
    repairs = options.withColumn("rn", F.row_number().over(pick)).filter("rn = 1").select("id", "line_no", "seen", F.col("word").alias("repair"))
    split = joins.filter("best is not null")
    here = split.filter(~F.col("best.word").startswith(F.col("a"))).select("id", "line_no", F.col("whole").alias("seen"), F.col("best.word").alias("repair"))
    there = split.filter(~F.col("best.word").endswith(F.col("b")) & F.col("at").isNotNull()).select("id", F.col("at").alias("line_no"), F.col("whole").alias("seen"), F.col("best.word").alias("repair"))
    repairs = repairs.unionByName(here).unionByName(there)
    found = misread_at.unionByName(here.select("id", "line_no")).unionByName(there.select("id", "line_no"))
    chars = found.select("id", "line_no", F.lit("char").alias("defect"))  # whichever repair is chosen
    whole = split.select("id", "line_no", F.col("whole").alias("seen"), F.col("best.word").alias("repair"))
    return certain.unionByName(hyphens).unionByName(chars).distinct(), repairs, printed, whole


def scan_defects(
    df: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    order_col: str,
    widest: int = 90,
    scan_share: float = 0.5,
    ratio: float = 8.0,
    known_words: int = 50_000,
    broadcast_sources: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(defects, repairs): what is wrong in the scanned pages, and how the misread words are repaired.

    defects(id, line_no, defect) has hyphen, char, header and page_number, line_no counted from 1 over the text split at
    newlines; repairs(id, line_no, seen, repair) has the word for each misread one. A source is scanned if in at least
    `scan_share` of its rows no line is longer than `widest`; such a row is a page. `order_col` orders the pages of a
    source; a page whose order is null has no next page. Rows with a null id, source or text hold no case; rows loaded
    twice are each reported; an empty table gives no rows; other columns are ignored. Words and statistics come from
    all rows; the list of scanned sources is broadcast only up to `broadcast_sources`; `known_words` only bounds lists that
    spare lookups.
    """
    return _analysed(df, id_col, text_col, source_col, order_col, widest, scan_share, ratio, known_words, broadcast_sources)[:2]


# Digits that scanners read as letters and signs; starts of list items, table rows and headings.
DIGITS = str.maketrans("OoIli!|ZzSsBbGgq", "0011111225586699")
ITEM = re.compile(r"\s*([-*•‣▪–—]\s|\d+[.)]\s|[|#])")
CLOSED = re.compile(r"[.!?…][\"'»”’)\]]*$")


def _cased(seen: str, word: str, opening: bool) -> str:
    """The word in the letter case of what stands in its place."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    doubtful = not seen[0].isalpha() or seen[0] == "I" and word[0] not in "iı"
    return word[0].upper() + word[1:] if (opening if doubtful else seen[0].isupper()) else word


def _token_repaired(token: str, repairs: dict[str, str], opening: bool) -> str:
    w = word_of(token)
    if w in repairs:
        at = token.lower().find(w)
        if at >= 0 and len(token.lower()) == len(token):
            return token[:at] + _cased(token[at : at + len(w)], repairs[w], opening) + token[at + len(w) :]
    core = OUTER.sub("", token)
    if misread_number(token) and not (core[:2].isalpha() and core[:2].isupper()):  # two capitals start a code
        return token.replace(core, core.translate(DIGITS), 1)
    return token


def _joint(a: str, b: str, hyphen: bool, repairs: dict[str, str], opening: bool) -> str:
    """The two parts of a divided word as one, with its sign where this belongs to the word."""
    if not hyphen:
        return a + b
    a = a.rstrip(HYPHENS)
    left, right = OUTER.sub("", a), OUTER.sub("", b)
    word = repairs.get((left + right).lower())
    if word is None or not left or not right:
        return a + b
    return a[: a.index(left)] + _cased(left + right, word, opening) + b[b.index(right) + len(right) :]


def repaired_page(text: str, cut: set[int], hyphens: set[int], repairs: dict[int, dict[str, str]], whole: dict[int, dict[str, str]]) -> list[dict]:
    """The pieces of paragraphs of a page, without its marker and running lines: text, item (it starts a list item, row
    or heading), open (its sentence does not end) and glue (None, or whether the sign of a divided last word goes).

    Lines are counted from 0. A paragraph ends at a blank line, before an item, and after a line that had room for the
    next word if it ends a sentence or the next line starts with a capital.
    """
    lines = text.split("\n")
    kept = [i for i, x in enumerate(lines) if x.strip() and i not in cut and not (x.startswith("--- SOURCE:") and MARKER.fullmatch(x))]
    width = max((len(lines[i].strip()) for i in kept), default=0)
    pieces: list[dict] = []
    words: list[str] = []
    carried = None  # (line, first part of a word, whether its sign goes)
    opening = True
    for n, i in enumerate(kept):
        line = lines[i]
        tokens = line.split()
        item = bool(ITEM.match(line))
        if n and carried is None:
            before = lines[kept[n - 1]].strip()
            room = len(before) + 1 + len(tokens[0]) <= width
            if any(not x.strip() for x in lines[kept[n - 1] + 1 : i]) or item or before.startswith("|") or room and (CLOSED.search(before) or line.strip()[0].isupper()):
                pieces.append({"words": words, "item": bool(ITEM.match(lines[first])), "glue": None})
                words = []
        if not words and carried is None:
            first, opening = i, True
        divided = DIVIDED.search(line) and len(tokens[-1]) > 1
        for k, t in enumerate(tokens):
            if k == 0 and carried:
                at, part, hyphen = carried
                t = _joint(part, t, hyphen, whole.get(at, {}), opening)
                carried = None
                if divided and len(tokens) == 1:
                    carried = (i, t, i in hyphens)
                    break
            elif divided and k == len(tokens) - 1:
                carried = (i, t, i in hyphens)
                break
            else:
                t = _token_repaired(t, repairs.get(i, {}), opening)
            words.append(t)
            opening = bool(CLOSED.search(t))
    glue = None
    if carried:
        words.append(carried[1])
        glue = carried[2]
    if words:
        pieces.append({"words": words, "item": bool(ITEM.match(lines[first])), "glue": glue})
    last = whole.get(kept[-1], {}) if kept else {}
    out = []
    for p in pieces:
        t = " ".join(p["words"])
        seen, repair = next(iter(last.items()), (None, None)) if p["glue"] is not None else (None, None)
        out.append({"text": t, "item": p["item"], "open": p["glue"] is not None or not CLOSED.search(t), "glue": p["glue"], "seen": seen, "repair": repair})
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            cut, hyphens, repairs, whole = set(), set(), {}, {}
            for m in r.marks if r.marks is not None else ():
                i = m["line_no"] - 1
                if m["kind"] in ("header", "page_number"):
                    cut.add(i)
                elif m["kind"] == "hyphen":
                    hyphens.add(i)
                else:
                    (whole if m["kind"] == "whole" else repairs).setdefault(i, {})[m["seen"]] = m["repair"]
            for n, p in enumerate(repaired_page(r.text, cut, hyphens, repairs, whole)):
                out.append((r.id, r.src, r.name, None if pd.isna(r.ci) else int(r.ci), n, *p.values()))
        yield pd.DataFrame(out, columns=["id", "src", "name", "ci", "n", "text", "item", "open", "glue", "seen", "repair"]).astype({"ci": "Int64", "n": "int32", "glue": "boolean"})


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for parts in pdf["parts"]:
            text, before = "", None
            for p in parts:
                if before is not None and before["glue"] is not None:
                    a, _, rest = text.rpartition(" ")
                    b, _, more = p["text"].partition(" ")
                    fix = {before["seen"]: before["repair"]} if before["seen"] else {}
                    text = " ".join(x for x in (a, _joint(rest, b, before["glue"], fix, not a or bool(CLOSED.search(a))), more) if x)
                else:
                    text = f"{text} {p['text']}" if text else p["text"]
                before = p
            texts.append(text)
        yield pdf[["source", "paragraph", "ids"]].assign(text=texts)


def repaired_paragraphs(df: DataFrame, id_col: str, text_col: str, source_col: str, order_col: str, **settings) -> DataFrame:
    """(source, paragraph, ids, text): the clean paragraphs of the scanned pages, numbered from 1 in each source.

    Marker, header and page-number lines are gone, divided words are whole, misread words and numbers are repaired, and
    lines are joined; a sentence or word that a page leaves open goes on in the page whose `order_col` is the next, and
    ids lists the rows that hold it. `source` is the base name in lower case. Of rows of one source, order and text the
    smallest id stands for all; rows without order stand alone and come first. `settings` are those of scan_defects.
    """
    defects, repairs, pages, whole = _analysed(df, id_col, text_col, source_col, order_col, **settings)
    pages = pages.groupBy("src", "name", "ci", F.when(F.col("ci").isNull(), F.col("id")).alias("lone"), "text").agg(F.min("id").alias("id")).drop("lone")
    none = F.lit(None).cast("string")
    marks = defects.filter("defect <> 'char'").select("id", "line_no", F.col("defect").alias("kind"), none.alias("seen"), none.alias("repair"))
    for kind, found in (("word", repairs), ("whole", whole)):
        marks = marks.unionByName(found.select("id", "line_no", F.lit(kind).alias("kind"), "seen", "repair"))
    marks = marks.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("line_no", "kind", "seen", "repair"))).alias("marks"))
    pieces = pages.join(marks, "id", "left").mapInPandas(filled(_pieces), "id long, src long, name string, ci long, n int, text string, item boolean, open boolean, glue boolean, seen string, repair string")
    order = Window.partitionBy("src").orderBy("ci", "id", "n")
    goes_on = (F.col("n") == 0) & ~F.col("item") & F.lag("open").over(order) & (F.lag("ci").over(order) == F.col("ci") - 1)
    # the text stays out of the window: a source is one task there
    numbered = checkpointed(pieces)
    starts = numbered.select("id", "src", "ci", "n", "item", "open").withColumn("start", F.when(goes_on, 0).otherwise(1))
    starts = starts.withColumn("paragraph", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("id", "n", "paragraph")
    part = F.struct("ci", "id", "n", "text", "glue", "seen", "repair")
    whole_ones = numbered.join(starts, ["id", "n"]).groupBy(F.col("name").alias("source"), "paragraph").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    whole_ones = whole_ones.withColumn("ids", F.array_distinct(F.transform("parts", lambda p: p["id"])))
    return whole_ones.mapInPandas(filled(_paragraphs), "source string, paragraph long, ids array<long>, text string")
