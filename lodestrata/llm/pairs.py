"""Broken prompt and response pairs: empty, refused, copied, truncated or in another language.

Copies are found by shingle containment and longest common subsequence, refusals by alignment with templates, other
languages by the string kernel of kernel_language, fitted on texts of the table whose function words tell their language,
and truncation by the words that end the closed sentences of the table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.frames import filled, sampled
from lodestrata.llm.kernel_language import LANGUAGES, _alphabet, _sums, fit, spectra, unquoted
from lodestrata.llm.langwords import guess, named_languages, scores
from lodestrata.llm.refusals import lcs, statement
from lodestrata.session import checkpointed, spread

# Sentences that only thank, or only send the reader elsewhere, in the six languages.
COURTESY = re.compile(r"^\W*(thank you|thanks|danke|vielen dank|merci|gracias|grazie|teşekkür\w*|sorunuz için)\b", re.I)
REFERRAL = re.compile(r"^\W*((please|kindly|instead|bitte|veuillez|por favor|per favore|lütfen)[, ]+)?(you (may|can|should) )?(ask|contact|consult|call|turn to|talk to|speak (to|with)|refer to|wenden sie sich|fragen sie|kontaktieren sie|contactez|consultez|adressez|contacter|consulter|vous adresser|contacte|consulte|diríjase|póngase en contacto|pregunte|contatti|contattare|consulti|si rivolga|rivolgersi|chieda|\w+ (danışın\w*|başvurun\w*))\b", re.I)
AGENT = re.compile(r"(?i)\b(service|dealer|technician|maker|manufacturer|support|help ?desk|hotline|supplier|specialist|expert|kundendienst|händler|hersteller|fach\w+|revendeur|technicien|fabricant|assistance|fournisseur|servicio|técnico|fabricante|distribuidor|assistenza|tecnico|rivenditore|produttore|servis\w*|bayi\w*|yetkili\w*|üretici\w*|teknisyen\w*)\b")
LEAD_INS = re.compile(r"^\s*(you asked|question|query|the question was|gefragt wurde|frage|usted pregunta|pregunta|vous demandez|question posée|hai chiesto|domanda|sorulan|soru)\s*[:\-–—]\s*", re.I)
TAGS = re.compile(r"(?is)<(think|thinking|reasoning|analysis)>.*?(</\1>|\Z)|</?[a-z_]+>")
HEADING = re.compile(r"(?m)^\s*(#{1,6}\s.*|\*\*[^*\n]{1,60}\*\*:?|(answer|final answer|antwort|réponse|respuesta|risposta|cevap|yanıt)\s*:?)\s*$", re.I)
LABEL = re.compile(r"^\s*(answer|final answer|antwort|réponse|respuesta|risposta|cevap|yanıt)\s*:\s*", re.I)
CITATION = re.compile(r"\s*\[[^\[\]\n]*\]\s*$")
NOTHING = re.compile(r"(?i)^(null|none|n/?a|nan|nil|undefined|empty|\W|_)*$")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Words at the end of an answer that are looked up together.
ORDERS = (1, 2, 3, 4, 5)
PROSE_WORD = re.compile(r"\b[^\W\d_]{3,}\b")
PLAIN_VALUE = re.compile(r"^[<>≤≥±~]?\s*[-+]?\d[\d.,]*\s*[^\s\d]{0,6}(/[^\s\d]{1,4})?$")
CODE = re.compile(r"^(?=.*\d)[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)*$")


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def visible(text: str | None) -> str:
    """The answer without reasoning, tags, headings and labels."""
    if not text:
        return ""
    t = HEADING.sub("", TAGS.sub(" ", text))
    return LABEL.sub("", t.strip()).strip().strip("​﻿")


def is_copy(query: str, answer: str) -> bool:
    """Whether the answer gives back only the question: contained shingles, or nearly all its words in sequence."""
    q, a = _words(query), _words(LEAD_INS.sub("", answer))
    if len(q) < 2 or not a:
        return False
    have, said = set(q), set(a)
    own = sum(w in have for w in a) / len(a)
    if own < 0.7 or len(have & said) < 0.75 * len(have):
        return False
    pairs = set(zip(q, q[1:]))
    contained = sum(p in pairs for p in zip(a, a[1:])) / max(1, len(a) - 1)
    times = max(1, round(len(a) / len(q)))
    return contained >= 0.7 or lcs(q * times, a) >= 0.8 * len(q) * times


def _refers(sentence: str, words: list[str]) -> bool:
    """Whether a sentence only thanks, or sends the reader elsewhere (or "bitte ... danışın", with the verb at the end)."""
    if len(words) > 15 or any(c.isdigit() for w in words for c in w) and not COURTESY.match(sentence):
        return False
    verb_last = words[-1].startswith(("danışın", "başvurun"))
    return bool(COURTESY.match(sentence) or (verb_last or REFERRAL.match(sentence)) and AGENT.search(sentence))


def _tells(words: list[str], query: str) -> bool:
    """Whether words give content: a number, or a longer word of the query; without a query anything may."""
    asked = {w for w in _words(query) if len(w) >= 4}
    return not asked or any(w in asked or any(c.isdigit() for c in w) for w in words)


def refused(answer: str, query: str = "") -> tuple[bool, bool]:
    """(declines, says that nothing was found), if that is all the answer does.

    Thanks and referrals count for nothing beside it, and neither do a few more words beside a refusal, unless they give
    content about the query.
    """
    declined = missing = False
    rest: list[str] = []
    for s in filter(None, (x.strip() for x in SENTENCE.split(answer))):
        words = _words(s)
        if not words or CITATION.fullmatch(s):
            continue
        found = statement(s)
        if found == "missing":
            missing = True
        elif found:
            declined = True
        elif not _refers(s, words):
            rest += words
            if len(rest) > 12:
                return False, False
    if rest and not (declined and guess(answer, 0.5, 1.2) in (None, guess(query, 0.5, 1.2)) and not _tells(rest, query)):
        return False, False
    return declined, missing


def stop_state(answer: str) -> str:
    """How an answer ends: 'ok', 'cut' (certainly broken off) or 'open' (its last words must tell)."""
    t = answer.rstrip()
    while (shorter := CITATION.sub("", t).rstrip()) != t and shorter:
        t = shorter
    last = t.rsplit("\n", 1)[-1].strip()
    if last.startswith("|"):
        return "ok" if last.endswith("|") and len(last) > 1 else "cut"
    body = re.sub(r"[\"'»”’)\]*`]+$", "", last)
    if re.fullmatch(r"[-*•]|\d+[.)]", last):
        return "cut"
    if body.endswith((".", "!", "?", "。")) and not body.endswith(".."):
        return "ok"
    if body.endswith(("…", "...", "..", ",", ";", "(", "[", "/", "-", "–", "—", "&", "+")) or last.count("(") > last.count(")"):
        return "cut"
    units = re.sub(r"^\s*([-*•]|\d+[.)])\s+", "", body)
    if PLAIN_VALUE.match(units) or all(CODE.match(x.strip()) for x in re.split(r"[,;\s]+", units) if x.strip()):
        return "ok"
    return "open"


def _gram(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def _masked(sentence: str) -> list[str]:
    return ["0" if any(c.isdigit() for c in w) else w for w in _words(sentence)]


def prose_of(answer: str) -> str:
    """The visible answer without table rows."""
    return "\n".join(x for x in answer.split("\n") if not x.lstrip().startswith("|"))


def foreign_by_words(query: str, prose: str) -> bool:
    """Whether a prose is in another language than the query and than those that it names, by function words."""
    asked, s = guess(query, 0.5, 1.2), scores(prose)
    top = max(s, key=s.__getitem__)
    return bool(asked) and s[top] >= 1 and s[top] >= 2 * s[asked] and not any(s[x] >= 0.8 * s[top] for x in named_languages(query))


class Languages:
    """The languages of short texts, by weights of the string kernel; without weights by function words."""

    def __init__(self, weights: np.ndarray | None, sure: float = 0.25, lead: float = 0.35, least: float = 0.2, letters: int = 12):
        self.weights, self.sure, self.lead, self.least, self.letters = weights, sure, lead, least, letters
        self.table = _alphabet()

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(regression value of each text and language, its letters)."""
        s = spectra([unquoted(t).replace("\n", " ") for t in texts], self.table)
        size = np.sqrt(np.maximum(np.diff(s.bounds), 1)).astype(np.float32)
        return _sums(self.weights[:-1], s) / size[:, None] + self.weights[-1], s.letters

    def foreign(self, queries: list[str], proses: list[str]) -> list[bool]:
        """For each pair whether the prose is in another language than the query and than those that it names: the query's
        best value leads by `sure`, that of the prose leads over the query's language by `lead`, and both have `letters`
        letters. Where the prose's value is below `least`, function words must name the same language: lists of a few
        terms that the sample does not know tell none."""
        if self.weights is None:
            return [foreign_by_words(q, t) for q, t in zip(queries, proses, strict=True)]
        if not queries:
            return []
        q, n = self.scored(queries)
        t, m = self.scored(proses)
        asked, at = q.argmax(axis=1), np.arange(len(q))
        order = np.sort(q, axis=1)
        clear = (order[:, -1] - order[:, -2] >= self.sure) & (n >= self.letters) & (m >= self.letters)
        top = t.argmax(axis=1)
        odd = np.flatnonzero(clear & (t[at, top] - t[at, asked] >= self.lead))
        out = [False] * len(queries)
        for i in odd.tolist():
            lang = LANGUAGES[top[i]]
            out[i] = lang not in named_languages(queries[i]) and (t[i, top[i]] >= self.least or guess(proses[i], 0.5, 1.2) == lang)
        return out


def self_labelled(texts: list[str], per_language: int = 400) -> tuple[list[str], list[str]]:
    """Texts whose function words leave no doubt about their language, with it, at most `per_language` of each."""
    strings, labels = [], []
    count: Counter[str] = Counter()
    for t in texts:
        lang = guess(t, 2.0, 2.0)
        if lang and count[lang] < per_language:
            count[lang] += 1
            strings.append(t)
            labels.append(lang)
    return strings, labels


def classify(query: str | None, text: str | None, expected_not_found: bool | None, foreign: bool | None = None) -> tuple[str | None, list[int] | None]:
    """(defect, None), or (None, hashes of the last one to five words) if only statistics tell whether it broke off.

    `foreign` says whether the answer is in another language; if it is None, function words tell.
    """
    answer = visible(text)
    if NOTHING.match(answer):
        return "empty", None
    declined, missing = refused(answer, query or "")
    if declined:
        return "refusal", None
    if missing:
        return ("refusal" if expected_not_found is False else None), None
    q = (query or "").strip()
    if q and is_copy(q, answer):
        return "copy", None
    prose = prose_of(answer)
    if q and foreign is not False and len(PROSE_WORD.findall(prose)) >= 3 and (foreign or foreign_by_words(q, prose)):
        return "wrong_language", None
    state = stop_state(answer)
    if state == "cut":
        return "truncated", None
    if state == "open":
        while (shorter := CITATION.sub("", answer).rstrip()) != answer and shorter:
            answer = shorter
        w = _masked(SENTENCE.split(answer)[-1])
        return None, [_gram(w[-k:]) for k in ORDERS if len(w) >= k]
    return None, None


def _first_pass(languages: Languages):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            queries = [q or "" for q in pdf["query"]]
            foreign = languages.foreign(queries, [prose_of(visible(t)) for t in pdf["answer"]])
            flags = [None if e is None or e is pd.NA or e != e else bool(e) for e in pdf["nf"]]
            out = [classify(*x) for x in zip(queries, pdf["answer"], flags, foreign, strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "defect": [x[0] for x in out], "tail": [x[1] for x in out]})

    return run


#: What is looked up is told to the executors as a set of so many slots, whatever its number.
SLOTS = 1 << 22


def _endings(slots: bytes):
    """For each sequence of one to five words, how often it stands at the end of a closed sentence and anywhere in one;
    only for those with a slot of their own. One that is looked up has all its endings looked up too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = np.unpackbits(np.frombuffer(slots, np.uint8)).astype(bool)
        wanted: dict[str, bool] = {}
        for pdf in batches:
            ends: Counter[int] = Counter()
            all_: Counter[int] = Counter()
            closed = Counter(s for text in pdf["answer"] for s in SENTENCE.split(visible(text)) if s.rstrip()[-1:] in (".", "!", "?"))
            for s, times in closed.items():
                w = _masked(s)
                last = len(w) - 1
                for i, x in enumerate(w):
                    ask = wanted.get(x)
                    if ask is None:
                        ask = wanted[x] = bool(asked[_gram([x]) % SLOTS])
                    if ask:
                        for k in ORDERS:
                            if k > i + 1 or not asked[(g := _gram(w[i + 1 - k : i + 1])) % SLOTS]:
                                break
                            all_[g] += times
                            if i == last:
                                ends[g] += times
            yield pd.DataFrame({"gram": list(all_), "ends": [ends[g] for g in all_], "seen": list(all_.values())})
            if len(wanted) > 300_000:
                wanted.clear()

    return run


def defective_pairs(
    df: DataFrame, id_col: str, query_col: str, answer_col: str, not_found_col: str | None = None, end_share: float = 0.3, least_seen: int = 3, sample_rows: int = 5000
) -> DataFrame:
    """(id, defect): the pairs that are no usable answer, each with one of empty, refusal, copy, wrong_language, truncated.

    The first of these that holds is given. Null and blank answers are empty; a null query is compared with nothing; a
    null flag takes an answer that nothing was found for right. The classifier of languages is fitted on those of `sample_rows`
    rows (by the hashes of their ids) whose function words tell their language; if these are in fewer than two
    languages, function words judge all. An answer without final stop is truncated if its last
    words, the longest of five to one of them seen at least `least_seen` times in closed sentences of the table, end a
    sentence in less than `end_share` of their cases, or if its last word is never seen in one. Repeated rows are each
    classified; rows with a null id are kept with their null; an empty table gives no rows; other columns are ignored.
    """
    rows = spread(df.select(
        F.col(id_col).alias("id"), F.col(query_col).alias("query"), F.col(answer_col).alias("answer"),
        (F.col(not_found_col) if not_found_col else F.lit(None).cast("boolean")).alias("nf"),
    ))
    kind = df.schema[id_col].dataType.simpleString()
    languages = Languages(_weights(rows, sample_rows))
    first = checkpointed(rows.mapInPandas(filled(_first_pass(languages)), f"id {kind}, defect string, tail array<long>"))
    known = first.filter(F.col("defect").isNotNull()).select("id", "defect")
    open_ = first.filter(F.col("tail").isNotNull() & F.col("defect").isNull()).withColumn("uid", F.monotonically_increasing_id())
    grams = open_.select("uid", "id", F.posexplode("tail").alias("k", "gram"))
    need = grams.select("gram").distinct()
    asked = np.zeros(SLOTS, dtype=bool)
    asked[[r.slot for r in need.select(F.pmod("gram", F.lit(SLOTS)).cast("int").alias("slot")).distinct().collect()]] = True  # at most SLOTS
    stats = rows.select("answer").filter(F.col("answer").isNotNull()).mapInPandas(filled(_endings(np.packbits(asked).tobytes())), "gram long, ends long, seen long")
    stats = stats.join(need, "gram", "left_semi").groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    judged = grams.join(stats, "gram", "left").fillna(0, ["ends", "seen"])
    share = F.when(F.col("seen") >= least_seen, F.col("ends") / F.col("seen"))
    judged = judged.groupBy("uid", "id").agg(F.max_by(share, F.when(share.isNotNull(), F.col("k"))).alias("share"))
    cut = judged.filter(F.coalesce("share", F.lit(0.0)) < end_share).select("id", F.lit("truncated").alias("defect"))
    return known.unionByName(cut)


def _weights(rows: DataFrame, sample_rows: int) -> np.ndarray | None:
    sample = sampled(rows.select("id", "query", "answer"), "id", sample_rows, rows.count(), "query", "answer").collect()
    strings, labels = self_labelled([t for r in sample for t in (r.query or "", prose_of(visible(r.answer))) if t])
    return fit(strings, labels) if len(set(labels)) > 1 else None
