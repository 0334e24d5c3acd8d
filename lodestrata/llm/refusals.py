"""Refusals and not-found statements, by alignment with templates of word classes.

Words and short phrases of the six languages are mapped to a few classes (the speaker, permission, denial, telling,
the matter asked about …). A template is a sequence of classes. A clause follows a template if the longest common
subsequence of the two is the whole template and hardly any word of the clause is left that belongs to no class; a
template with a topic may be followed by some words of it. Templates are looked up by their shingles of two classes,
so that a clause is aligned only with those that share one with it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from lodestrata.llm.langwords import COMMON

# Phrases of each class in English, German, French, Spanish, Italian and Turkish. A phrase of two classes
# stands in both lines, in the order of the classes.
PHRASES = {
    "SELF": "i, i'm, i'd, i'll, i've, we, we're, we'd, we'll, me, us, my, our, this assistant, the assistant, as an assistant, as a language model, as an ai, this system, this service, ich, wir, mir, mich, uns, als assistent, dieser assistent, mein, meine, meinen, meiner, je, j'ai, nous, moi, mon, ma, mes, cet assistant, en tant qu'assistant, yo, nosotros, mi, mis, este asistente, como asistente, lamento, lamentamos, io, noi, mio, mia, miei, questo assistente, come assistente, ben, biz, bana, benim, bir asistan olarak",
    "MAY": "can, could, may, might, able to, able, allowed to, allowed, permitted to, permitted, authorized to, authorised to, authorized, authorised, in a position to, willing to, going to, will, would, want to, wish to, permission to, way to, kann, können, könnte, darf, dürfen, möchte, möchten, werde, werden, will, wollen, befugt, berechtigt, erlaubt, peux, pouvons, puis, pouvoir, autorisé à, autorisé, autorisée, en mesure de, poder, autorizado a, autorizado, autorizada, permitido, potere, autorizzato a, autorizzato, autorizzata, in grado di, yetkim, iznim, uygun, mümkün",
    "SELF MAY": "puedo, podemos, podría, estoy autorizado a, estamos autorizados a, posso, possiamo, potrei, sono autorizzato a, sono autorizzata a, siamo autorizzati a, ich darf, ich kann",
    "MAY NOT": "cannot, can't, can not, couldn't, won't, wouldn't, unable to, unable, unwilling to, may not, mustn't, shouldn't, prefer not to, prefer not, rather not, impossible for, impossible de, impossible, imposible, impossibile, unmöglich, yok, değil, değilim, değiliz",
    "SELF MAY NOT": "m'est impossible de, me es imposible, mi è impossibile, non mi è possibile, no me es posible, no me está permitido, non mi è permesso, olamam, olamıyorum, olamayız, veremem, veremiyorum, veremeyiz, edemem, edemiyorum, edemeyiz, yapamam, yapamıyorum, yanıtlayamam, yanıtlayamıyorum, cevaplayamam, paylaşamam, konuşamam, açıklayamam, anlatamam",
    "TELL SELF NOT": "yanıtlamam, cevaplamam, vermem, paylaşmam",
    "TELL SELF MAY NOT": "yardım edemem, yardımcı olamam, yardımcı olamıyorum, cevap veremem, yanıt veremem, bilgi veremem, yanıtlayamam, cevaplayamam, paylaşamam, açıklayamam, anlatamam",
    "NOT": "not, no, don't, doesn't, didn't, isn't, aren't, wasn't, never, neither, nicht, kein, keine, keinen, keinem, keiner, nie, ne, n', pas, n'est, n'ai, aucun, aucune, non, nessuna, nessun, nessuno, ningún, ninguna, tampoco, nunca, hiçbir",
    "NOTHING": "nothing, none, no answer, no information, no details, no detail, no reply, no help, no instructions, no advice, no record, no mention, nichts, keine auskunft, keine information, keine informationen, keine antwort, keine angabe, keine angaben, rien, aucune information, aucune réponse, nada, ninguna información, ninguna respuesta, nulla, niente, nessuna informazione, nessuna risposta, hiçbir şey, hiçbir bilgi",
    "TELL": "help, assist, answer, respond, reply, comment, provide, give, given, share, shared, offer, offered, discuss, discussed, describe, described, explain, explained, say, said, speak, talk, tell, told, disclose, disclosed, reveal, guide, walk, instruct, advise, support, judge, supply, address, handle, cover, recommend, engage, helfen, antworten, beantworte, beantworten, beantwortet, geben, gebe, nennen, nenne, sagen, sage, sprechen, erklären, anleiten, anleite, beraten, mitteilen, weitergeben, äußern, behandeln, unterstützen, auskunft geben, auskunft erteilen, weiterhelfen, aider, répondre, réponds, donner, donne, fournir, traiter, expliquer, parler, discuter, décrire, commenter, partager, ayudar, ayudarle, ayudarte, ayudarles, responder, respondo, contestar, dar, darle, doy, proporcionar, tratar, explicar, hablar, describir, comentar, compartir, facilitar, aiutare, aiutarla, aiutarti, aiutarvi, rispondere, rispondo, dare, darle, fornire, trattare, spiegare, parlare, descrivere, commentare, condividere, yardım, yardımcı, cevap, yanıt, yanıtlamam, cevaplamam, yanıtlamak, cevaplamak, bilgi vermek, açıklamak, anlatmak, paylaşmak, konuşmak",
    "DECLINE": "decline, declined, declining, refuse, refused, reject, rejected, turn down, turned down, ablehnen, abgelehnt, ablehne, verweigern, verweigert, zurückweisen, décliner, refuser, décliné, refusé, refusée, rechazar, rechazada, declinar, declinada, rechazo, rifiutare, rifiutata, declinare, rifiuto, reddetmek, reddedildi, reddediyorum, geri çevirmek",
    "MUST": "must, have to, need to, has to, had to, muss, müssen, dois, devons, suis obligé de, suis contraint de, zorunda, gerekiyor, gerekir",
    "SELF MUST": "debo, debemos, tengo que, tenemos que, devo, dobbiamo, zorundayım, zorundayız",
    "SELF DECLINE": "reddediyorum, rechazo, rifiuto, declino",
    "MATTER": "this, that, it, request, requests, question, questions, query, queries, topic, topics, subject, subjects, matter, matters, information, info, detail, details, instruction, instructions, answer, answers, prompt, prompts, kind, sort, such, something, here, value, dazu, dabei, hierzu, davon, darüber, das, dies, diese, dieses, dieser, diesem, frage, fragen, anfrage, anfragen, thema, art, auskunft, auskünfte, information, informationen, angabe, angaben, anleitung, arbeiten, ce, cet, cette, cela, ça, sujet, question, questions, demande, demandes, information, informations, l'information, l'informazione, consigne, consignes, thème, réponse, esto, eso, este, esta, esa, pregunta, preguntas, solicitud, petición, tema, información, indicaciones, instrucciones, dato, datos, respuesta, questo, questa, quello, domanda, domande, richiesta, argomento, tema, informazione, informazioni, istruzioni, indicazioni, risposta, bu, şu, konu, konuda, soru, soruya, soruyu, sorular, istek, isteği, talep, talebi, bilgi, bilgiler, bilgiye, cevabı, yanıtı",
    "OUTSIDE": "outside, beyond, exceeds, out of scope, out of, außerhalb, jenseits, übersteigt, dépasse, en dehors, hors de, fuera de, más allá, excede, al di fuori, fuori, supera, oltre, dışında, aşıyor",
    "AGAINST": "against, violates, violate, contrary to, conflicts with, gegen, verstößt, contre, contraire, contra, contraviene, contro, viola, aykırı",
    "RULES": "guidelines, guideline, policy, policies, rules, rule, scope, remit, terms, richtlinien, richtlinie, regeln, vorgaben, consignes internes, règles, politique, directives, directrices, normas, política, reglas, linee guida, regole, politica, kurallarım, kurallar, ilkelerime, yönergelerime",
    "BLOCKED": "blocked, forbidden, prohibited, off limits, restricted, closed, gesperrt, verboten, untersagt, bloqué, bloquées, interdit, bloqueado, bloqueada, prohibido, bloccato, bloccata, vietato, engellendi, yasak",
    "LEAVE": "leave, hand over, refer, pass, überlassen, laisser, renvoyer, dejar, remitir, lasciare, rimandare, bırakmalıyım, yönlendirmeliyim",
    "FOUND": "found, find, appear, appears, available, contained, contain, contains, mentioned, mention, listed, present, covered, included, located, stated, specified, gefunden, finden, findet, steht, stehen, enthalten, enthält, vorhanden, erwähnt, angegeben, figure, figurent, trouvé, trouvée, trouver, disponible, contiennent, contient, mentionné, figura, figuran, encontrado, encontrada, encontrar, encontró, contienen, contiene, menciona, aparece, trovato, trovata, trovare, presente, disponibile, contengono, menzionato, bulunamadı, bulunmuyor, bulunmamaktadır, bulunamamıştır, yer, mevcut, geçmiyor",
    "NOT FOUND": "bulunamadı, bulunmuyor, bulunmamaktadır, bulunamamıştır, geçmiyor, yer almıyor, yer almamaktadır, mevcut değil, missing from, absent from, fehlt, fehlen, absente, absent, manca, falta",
    "DOCS": "document, documents, file, files, manual, manuals, source, sources, context, fragment, passage, text, texts, index, documentation, material, dokument, dokumente, dokumenten, unterlagen, handbuch, handbüchern, quelle, quellen, kontext, datei, dateien, documents, fichiers, manuels, contexte, documentos, archivos, manuales, fuentes, contexto, documenti, file, manuali, fonti, contesto, belge, belgede, belgeler, belgelerde, belgelerin, kaynak, kaynaklarda, kılavuzlarda, dosyalarda, bağlamda",
    "ABOUT": "about, on, regarding, concerning, of, with, über, zu, zum, zur, von, sur, à propos, concernant, sobre, acerca de, su, sulla, sul, riguardo, hakkında, ilgili",
}
# Words that change nothing.
PLAIN = "am, is, are, was, were, be, been, being, has, have, had, there, would, bin, ist, sind, wurde, worden, suis, sommes, est, sont, été, à, soy, estoy, estamos, es, está, sido, sono, siamo, stata, stato, ai, alle, sorry, apologies, apologize, apologise, afraid, unfortunately, regrettably, regret, please, you, your, dear, thank, thanks, kindly, however, because, since, could, dangerous, unsafe, harmful, risky, personal, provided, indexed, supplied, given, at hand, hand, any, lies, lie, tut, leid, leider, bedaure, bitte, sie, ihnen, ihre, gefährlich, désolé, désolée, malheureusement, regrette, vous, votre, veuillez, lo siento, siento, lamentablemente, desgraciadamente, usted, le, les, mi dispiace, dispiace, purtroppo, lei, vi, üzgünüm, maalesef, ne yazık ki, size, lütfen"
#: A template is a sequence of classes; * lets up to TOPIC words of no class follow its topic.
REFUSALS = """
SELF MAY NOT TELL
SELF MAY NOT TELL MATTER
SELF MAY NOT TELL ABOUT *
SELF MAY NOT TELL MATTER ABOUT *
SELF NOT MAY TELL
SELF NOT MAY TELL MATTER
SELF NOT MAY TELL ABOUT *
NOT SELF MAY TELL
NOT SELF MAY TELL ABOUT *
NOT MAY TELL MATTER SELF
SELF NOT TELL MATTER
SELF NOT TELL MATTER ABOUT *
TELL SELF NOT MATTER
MATTER TELL SELF NOT
MATTER TELL SELF MAY NOT
TELL SELF MAY NOT
MATTER MAY SELF NOT TELL
MAY SELF NOT TELL
MAY SELF NOTHING TELL
MATTER MAY SELF NOTHING TELL
ABOUT * MAY SELF NOT TELL
ABOUT * MAY SELF NOTHING TELL
MATTER MAY SELF NOT MATTER TELL
SELF MAY NOT MATTER TELL
SELF MAY NOTHING TELL
MATTER SELF MAY NOT TELL
MATTER TELL MAY NOT
SELF MUST DECLINE
SELF MUST DECLINE MATTER
SELF MUST DECLINE MATTER ABOUT *
MUST SELF MATTER DECLINE
SELF MUST MATTER DECLINE
MATTER DECLINE SELF MUST
SELF DECLINE MATTER
SELF DECLINE MATTER ABOUT *
MATTER DECLINE
NOTHING MAY TELL
NOTHING MAY TELL MATTER
NOTHING ABOUT * MAY TELL
NOTHING ABOUT * MAY TELL SELF
NOTHING SELF MAY TELL
MATTER OUTSIDE SELF TELL
MATTER OUTSIDE SELF MAY TELL
MATTER OUTSIDE SELF RULES
AGAINST SELF RULES
AGAINST SELF RULES TELL MATTER
MATTER AGAINST SELF RULES
MATTER BLOCKED SELF
MATTER ABOUT * BLOCKED SELF
MATTER SELF MUST LEAVE
MATTER MUST SELF LEAVE
SELF MUST LEAVE MATTER
""".strip().split("\n")
MISSING = """
MATTER NOT FOUND
MATTER NOT FOUND DOCS
MATTER FOUND NOT DOCS
MATTER FOUND NOTHING DOCS
MATTER DOCS NOT FOUND
NOT FOUND DOCS
DOCS NOT FOUND MATTER
DOCS TELL NOTHING
DOCS TELL NOTHING ABOUT MATTER
DOCS FOUND NOTHING
DOCS FOUND NOTHING ABOUT MATTER
DOCS NOT TELL MATTER
NOTHING FOUND DOCS
NOTHING ABOUT MATTER FOUND DOCS
NOTHING ABOUT * FOUND DOCS
NOTHING MATTER DOCS
DOCS NOT MATTER
DOCS NOTHING FOUND
""".strip().split("\n")
TOPIC = 8
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def _table() -> dict[tuple[str, ...], tuple[str, ...]]:
    out: dict[tuple[str, ...], tuple[str, ...]] = {}
    for lang in COMMON.values():
        out |= {(w,): () for w in lang.split()}
    out |= {tuple(p.split()): () for p in PLAIN.split(", ")}
    for classes, phrases in PHRASES.items():  # later lines are the more special ones of a phrase
        for p in phrases.split(", "):
            key = tuple(p.split())
            if len(classes.split()) > len(out.get(key, ())):
                out[key] = tuple(classes.split())
    return out


TABLE = _table()
LONGEST = max(map(len, TABLE))


def classes_of(words: list[str]) -> list[str]:
    """The classes of the words, the longest phrases first; a word of no class is itself in lower case."""
    out: list[str] = []
    i = 0
    while i < len(words):
        for n in range(min(LONGEST, len(words) - i), 0, -1):
            got = TABLE.get(tuple(words[i : i + n]))
            if got is not None:
                out += got
                i += n
                break
        else:
            w = words[i]
            if "'" in w and (got := TABLE.get((w.split("'", 1)[1],))) is not None:  # l'information, d'aide
                out += got
            else:
                out.append(w)
            i += 1
    return out


def _shingles(classes: list[str]) -> set[tuple[str, str]]:
    return set(zip(classes, classes[1:]))


def _index(templates: list[str]) -> tuple[list[list[str]], dict[tuple[str, str], list[int]]]:
    split = [t.split() for t in templates]
    by: dict[tuple[str, str], list[int]] = {}
    for i, t in enumerate(split):
        for s in _shingles([c for c in t if c != "*"]):
            by.setdefault(s, []).append(i)
    return split, by


_REFUSALS, _MISSING = _index(REFUSALS), _index(MISSING)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _follows(classes: list[str], index: tuple, most_other: float) -> bool:
    templates, by = index
    known = [c for c in classes if c.isupper()]
    other = len(classes) - len(known)
    if len(known) < 2:
        return False
    for i in {i for s in _shingles(known) for i in by.get(s, ())}:
        parts = [c for c in templates[i] if c != "*"]
        room = TOPIC if "*" in templates[i] else 0
        if other - room <= most_other * len(classes) and lcs(known, parts) == len(parts):
            return True
    return False


def clauses(sentence: str) -> list[str]:
    return [c for c in re.split(r"[;:]\s+|,\s+(?:so|but|and|because|bitte|aber|und|mais|et|pero|ma|ancak)\s+|[–—]", sentence) if c.strip()]


@lru_cache(maxsize=100_000)
def statement(sentence: str, most_other: float = 0.2) -> str | None:
    """'refusal' or 'missing' if a clause of the sentence follows such a template, else None."""
    if len(sentence) > 400:
        return None
    found = None
    for clause in clauses(sentence.lower().replace("’", "'").replace("i̇", "i")):
        classes = classes_of(WORD.findall(clause))
        if _follows(classes, _REFUSALS, most_other):
            return "refusal"
        if _follows(classes, _MISSING, most_other):
            found = "missing"
    return found
