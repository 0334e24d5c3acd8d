"""Languages of short strings by their commonest words; used where no classifier can be trained."""

from __future__ import annotations

import re

# Common function words of the six languages of the corpus.
COMMON = {
    "en": "the of and to in is a an that for on with as are be this by from at it or not which when what how where why can must does do if after before has have will was were into then up out all each than its only within during once never without until unless both",
    "de": "der die das und ist nicht ein eine einen einem einer dem den des im in mit auf für von zu zur zum wird werden wie was wann wo warum wenn man noch nach bei sich sind es aus am an oder dass darf muss soll bis durch über unter vor welches welche braucht sofern weil sobald solange danach beträgt",
    "fr": "le la les un une des du de et est dans pour sur avec que qui ne pas par au aux il elle en ce cette ou où sont plus comment pourquoi quand quel quelle quels affiche faut lorsque si pendant sous doit près sans entre jusqu'à leur l d n qu reste côté voir",
    "es": "el la los las un una de del y en es que por para con no se al lo como más su sus o sin sobre qué cuál cuándo dónde cómo cuando si hasta desde está hay luego durante debe cada entre este esta siendo según junto indica",
    "it": "il lo la gli le un una su di del della dei delle e è che per con non si al alla da dal nel nella come più o se quando dove perché qual quale sul sulla dopo fino sono ogni durante prima bisogna deve senza poi tra",
    "tr": "ve bir bu için ile olarak da de ne nasıl neden nerede zaman kadar sonra önce olan değil mi mı ise boyunca her daha çok gibi üzerinde üzerinden arasında göre edilir edilmelidir edilmeli nedir hangi gerekir altında yanında",
}
# Letters that only some of the six use.
LETTERS = {"ß": "de", "ä": "de", "ı": "tr", "ğ": "tr", "ş": "tr", "ñ": "es", "¿": "es", "¡": "es", "ã": "es", "ê": "fr", "œ": "fr", "ù": "fr it", "ì": "it", "ò": "it", "í": "es", "ó": "es", "á": "es", "ú": "es", "è": "fr it", "à": "fr it", "ç": "fr tr", "ö": "de tr", "ü": "de tr", "û": "fr", "î": "fr", "ô": "fr"}
# How a query names a language it wants.
NAMES = {
    "en": "english anglais inglés ingles inglese englisch englische englischen ingilizce",
    "de": "german deutsch deutsche deutschen allemand alemán aleman tedesco almanca",
    "fr": "french français francais französisch französische francés frances francese fransızca",
    "es": "spanish español espanol espagnol spanisch spanische spagnolo ispanyolca",
    "it": "italian italiano italien italienisch italienische italyanca",
    "tr": "turkish türkçe turc türkisch türkische turco turca",
}
WORD = re.compile(r"[^\W\d_]+")
_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in COMMON.items():
    for _w in _words.split():
        _BY_WORD.setdefault(_w, []).append(_lang)
_BY_NAME = {w: lang for lang, words in NAMES.items() for w in words.split()}


def scores(text: str) -> dict[str, float]:
    """Evidence for each language: a common word counts one, shared between the languages that have it."""
    out = dict.fromkeys(COMMON, 0.0)
    for w in WORD.findall(text.replace("I", "ı").lower() if set(text) & set("ğĞşŞıİ") else text.lower()):
        if langs := _BY_WORD.get(w):
            for lang in langs:
                out[lang] += 1 / len(langs)
        for ch in set(w) & LETTERS.keys():
            for lang in (langs := LETTERS[ch].split()):
                out[lang] += 0.7 / len(langs)
    for ch in "¿¡":
        if ch in text:
            out["es"] += 1
    return out


def guess(text: str, least: float = 1.0, lead: float = 1.4) -> str | None:
    """The language that leads by the factor `lead` with at least `least` evidence, or None."""
    order = sorted(scores(text).items(), key=lambda x: -x[1])
    (best, top), (_, second) = order[:2]
    return best if top >= least and top >= lead * second else None


def named_languages(query: str) -> set[str]:
    """Languages that a query names."""
    return {_BY_NAME[w] for w in WORD.findall(query.lower()) if w in _BY_NAME}
