"""Broken prompt and response pairs (problem 3).

One pass over the joined pairs gives each response at most one defect:

``empty``      nothing is said once markup, wrappers and filler words are gone
``refusal``    an automaton of refusal phrases fires outside quotes and code
``copy``       the response walks through the suffix automaton of its prompt
               and matched stretches cover most of it
``truncated``  an open delimiter is left on the stack, or the last sentence ends
               in the middle
``language``   most of the answer votes, by stopwords, for another language

They are tried in this order.  Defined results: a null prompt copies nothing;
``Empty file`` is a proper answer to a blank prompt and an empty one to any
other; a null answer language means English; responses whose request is
missing are judged without prompt in English; repeated rows give one result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

#: fixed values: words that fill a field and say nothing
FILLER = frozenset(
    "summary résumé resume zusammenfassung resumen riassunto n a na none null nil undefined nan empty no content output text answer response result keine inhalt leer vide vacío sin contenido aucun tbd todo description "
    "available not data blank missing here is the file overview".split()
)
#: fixed values: phrases with which a writer declines, in the first person
REFUSALS = (
    "i cannot provide", "i can't provide", "i can not provide", "i cannot help", "i can't help", "i cannot assist", "i can't assist", "i cannot answer", "i can't answer", "i cannot summari", "i can't summari", "i cannot describe", "i can't describe",
    "i cannot analy", "i can't analy", "i cannot comply", "i can't comply", "i cannot fulfil", "i can't fulfil", "i cannot process this", "i cannot do that", "i can't do that", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to",
    "i won't be able to", "i will not be able to", "i must decline", "i have to decline", "i decline to", "i must refuse", "i refuse to", "i'm not allowed to", "i am not allowed to", "i'm not permitted to", "i am not permitted to", "not something i can",
    "against my guidelines", "conflict with my guidelines", "violates my guidelines", "as an ai assistant, i", "as an ai language model", "as a language model, i",
    "je ne peux pas", "je ne suis pas en mesure", "je dois refuser", "je refuse d", "il m'est impossible", "je ne suis pas autoris", "je ne saurais", "contre mes règles", "contre mes regles", "je dois décliner",
    "kann ich diese", "kann ich diesen", "kann ich dieses", "kann ich ihnen", "ich kann diese", "ich kann diesen", "ich kann dieses", "ich kann ihnen", "ich kann dabei nicht", "kann ich nicht", "ich kann nicht", "ich darf", "darf ich", "mir nicht möglich", "muss ich ablehnen", "ich muss ablehnen", "ich muss es ablehnen", "muss ich es ablehnen", "ich bin nicht in der lage", "bin ich nicht in der lage", "lehne ich ab", "gegen meine richtlinien",
    "no puedo", "no me es posible", "me es imposible", "no estoy autorizad", "no tengo permitido", "debo negarme", "debo rechazar", "tengo que rechazar", "no se me permite", "va contra mis normas", "no soy capaz de",
    "non posso", "non sono in grado", "devo rifiutare", "mi è impossibile", "ik kan niet", "ik kan deze", "ik kan dit", "ik kan u", "ik mag niet", "ik moet weigeren", "não posso", "não me é possível",
)
_NEGATED = re.compile(r"\b(?:nicht|keine?[nr]?|ablehnen|niet|geen|weiger)\b")
_NEEDS_NOT = tuple(x for x in REFUSALS if x.startswith(("kann ich", "ich kann", "ich darf", "darf ich", "ik kan ")))
#: fixed values: stopwords that vote for a language
STOPWORDS = {
    "en": "the and of to is in that it with for as are by on from which be this an or at not its each when has one or than into so but every all only if was a",
    "de": "der die das und ist nicht ein eine mit von den dem des zu im auf für werden wird sich als auch bei nach aus wenn oder aber wir jede jeder jetzt nur am sie vor dem zwischen über ohne bitte damit mehrere einer",
    "fr": "le la les et est une un des du de que qui dans pour par sur pas avec sont ce cette au aux en il elle ne plus mais ou ainsi si nous chaque après avant deux même la sans lorsque ces",
    "es": "el la los las y es una un de del que en para por con no se al como más pero o si su sus este esta entre cada después antes sin dos muy solo hay lo cuando también tras ya",
    "it": "il lo la gli le e è una un di del della che in per con non si al come più ma o se sono questo questa ogni dopo prima due solo nel dei delle i",
    "nl": "de het een en van is niet met voor op zijn te dat die in aan bij uit als wordt worden ook maar of naar door elke na twee alleen om er wij",
    "pt": "o a os as e é uma um de do da que em para por com não se ao como mais mas ou são este esta cada depois antes dois só no na dos das",
}
_VOTES: dict[str, dict[str, float]] = {}
for _l, _ws in STOPWORDS.items():
    for _w in set(_ws.split()):
        _VOTES.setdefault(_w, {})[_l] = 1.0
for _v in _VOTES.values():
    for _l in _v:
        _v[_l] = 1.0 / len(_v)

_FENCE = re.compile(r"(?ms)^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|`[^`\n]*`")
_FACE = re.compile(r"[:;]-?[(\[{](?=\s|$)|'[(\[{)\]}]+'|(?m:^\s*(?:\d{1,3}|[A-Za-z])[)\]](?=\s))")
_LAST_OK = re.compile(r"[.!?…。！？:;)\]}\"”»'’`|*_>~✅✔☑👍🎉-]$|[\U0001F300-\U0001FAFF☀-➿️]$")
#: fixed values: words no sentence and no list item ends with
DANGLING = frozenset(
    "the a an and or of with for as from which because their its und oder der die das den dem des ein eine einem einer von für weil "
    "le les un une des du de et ou que qui dans pour avec parce los las una del con por para porque su che il lo gli di".split()
)
COPY_RUN = 24
COPY_SHARE = 0.6
#: words that may stand before a refusal in its sentence
OPENING = 6
BLOCK = 1 << 16
WALK = 1 << 27


class SuffixAutomaton:
    """All substrings of a text, one state for each class of end positions."""

    __slots__ = ("next",)

    def __init__(self, text: str):
        nxt: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = (nxt, link, length)

    def cover(self, text: str, run: int, out: bytearray) -> None:
        """Marks in ``out`` the characters of ``text`` inside a stretch of at least ``run`` that occurs here."""
        nxt, link, length = self.next
        s = n = 0
        for i, c in enumerate(text):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            else:
                n = 0
            if n >= run:
                a = i + 1 - (run if i and out[i - 1] else n)
                out[a : i + 1] = b"\1" * (i + 1 - a)


def _flat(t: str) -> str:
    return "".join(t.lower().split())


def copied_share(prompt: str | None, response: str, run: int = COPY_RUN) -> float:
    """Share of the response, white space and case apart, that stands in the prompt in stretches of ``run``.

    A response shorter than that is a copy if it stands in the prompt as it is
    and gives back at least half of it.  Long prompts are walked in blocks that
    overlap by ``run - 1``, so every stretch lies within a block and the memory
    is bounded.
    """
    a, b = _flat(prompt or ""), _flat(re.sub(r"(?m)^\s*(?:```|~~~)\w*\s*$", "", response))
    if min(len(a), len(b)) < run:
        run = max(1, len(b))
        if not b or 2 * len(b) < len(a):
            return 0.0
    if len(a) < run:
        return 0.0 if not a or a not in b else b.count(a) * len(a) / len(b)
    # a stretch of that length holds one of these pieces; without any there is nothing to walk, and where looking costs more than walking it is left out
    half = max(1, run // 2)
    if len(a) * (len(b) // half) < WALK and not any(b[i : i + half] in a for i in range(0, len(b) - half + 1, half)):
        return 0.0
    out = bytearray(len(b))
    for i in range(0, len(a), BLOCK):
        SuffixAutomaton(a[i : i + BLOCK + run - 1]).cover(b, run, out)
        if i + BLOCK + run - 1 >= len(a):
            break
    return sum(out) / len(b)


@lru_cache(None)
def _refusals():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in REFUSALS:
        a.add_word(w, w)
    a.make_automaton()
    return a


def is_refusal(text: str) -> bool:
    """A phrase of refusal outside quotes and code, by its place and by what else is said.

    It counts where it opens one of the first two or last two sentences, at most
    ``OPENING`` words before it, or where the sentences that hold one make up a
    quarter of the answer.
    """
    low = _QUOTED.sub(" ", _FENCE.sub(" ", text)).lower().replace("’", "'").strip()
    sentences = re.split(r"(?<=[.!?。])\s+", low)
    refused = 0
    for k, sentence in enumerate(sentences):
        hits = [end + 1 - len(w) for end, w in _refusals().iter(sentence)]
        if not hits:
            continue
        if not _NEGATED.search(sentence):
            hits = [end + 1 - len(w) for end, w in _refusals().iter(sentence) if w not in _NEEDS_NOT]
            if not hits:
                continue
        if (k < 2 or k >= len(sentences) - 2) and len(sentence[: min(hits)].split()) <= OPENING:
            return True
        refused += len(sentence)
    return 4 * refused >= len(low) > 0


def is_empty(text: str | None, blank_prompt: bool) -> bool:
    if text is None:
        return True
    if blank_prompt and text.strip().lower().rstrip(".") == "empty file":
        return False
    core = re.sub(r"<[^<>]*>|&\w+;", " ", text)
    words = re.findall(r"[^\W_]+", core.lower())
    return all(w in FILLER for w in words) or text.strip().lower().rstrip(".") == "empty file"


def is_open(prose: str) -> bool:
    """A bracket is never closed; faces, brackets in quotes or inline code and closing marks of lists are none."""
    depth = 0
    for c in _FACE.sub(" ", _QUOTED.sub(" ", prose)):
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
    return depth > 0


def is_truncated(text: str) -> bool:
    """Delimiters left open, or a last sentence that breaks off."""
    t = text.rstrip()
    if not t:
        return False
    fence, prose = "", []
    for line in t.split("\n"):
        mark = line.lstrip(" \t")[:3]
        if mark in ("```", "~~~") and fence in ("", mark):
            fence = "" if fence else mark
        elif not fence:
            prose.append(line)
    if fence:
        return True
    last = t.split("\n")[-1].strip()
    if last.startswith(("```", "~~~")):
        return is_open("\n".join(prose))
    if last.count("`") % 2:
        return True
    bare = re.sub(r"`[^`]*`", "", last)
    if is_open("\n".join(prose)):
        return True
    if bare.count('"') % 2:
        return True
    if last.startswith("|"):
        return not last.endswith("|")
    words = re.findall(r"[^\W\d_]+", last.lower())
    if last.endswith((",", " -")) or (words and words[-1] in DANGLING and last[-1:].isalpha()):
        return True  # the words of DANGLING end no list item either
    if re.match(r"(?:[-*+•]|\d+[.)])\s", last) or re.match(r"#+\s", last):
        return False
    return not _LAST_OK.search(last)


def language_of(text: str) -> dict[str, float]:
    """Characters of the text by the language that wins each sentence's vote."""
    body = _QUOTED.sub(" ", _FENCE.sub(" ", text))
    body = re.sub(r"(?m)^\s*\|.*$|^\s*#+\s.*$|^File summary \(chunked\):\s*$", " ", body)
    won: dict[str, float] = {}
    for part in re.split(r"(?<=[.!?。])\s+|\n+", body):
        words = re.findall(r"[^\W\d_]+", part.lower())
        if len(words) < 3 and len(_OWN_SCRIPT.findall(part)) < OWN_LEAST:
            continue
        votes: dict[str, float] = {}
        for w in words:
            for lang, v in _VOTES.get(w, {}).items():
                votes[lang] = votes.get(lang, 0.0) + v
        kana = _KANA.search(part)
        for rx, lang in _SCRIPTS:
            if k := len(rx.findall(part)):
                lang = "ja" if lang == "zh" and kana else lang
                votes[lang] = votes.get(lang, 0.0) + 0.4 * k
        if votes:
            best = max(votes, key=lambda x: (votes[x], x))
            won[best] = won.get(best, 0.0) + len(part)
    return won


#: fixed values: letters that stand for a language
_SCRIPTS = (
    (re.compile(r"[äöüß]", re.I), "de"),
    (re.compile(r"[éèêàçùœ]|\b[ldnscqj]['’]", re.I), "fr"),
    (re.compile(r"[ñ¿¡óíúá]", re.I), "es"),
    (re.compile(r"[Ѐ-ӿ]"), "ru"),
    (re.compile(r"[぀-ヿ]"), "ja"),
    (re.compile(r"[Ͱ-Ͽ]"), "el"),
    (re.compile(r"[一-鿿]"), "zh"),
)
#: fixed values: letters that tell the language without any word, and how many of them make a sentence that votes; some of these languages write no spaces
_OWN_SCRIPT = re.compile(r"[Ѐ-ӿ぀-ヿͰ-Ͽ一-鿿]")
OWN_LEAST = 4
_KANA = re.compile(r"[぀-ヿ]")
_LANG = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es", "italian": "it", "dutch": "nl", "portuguese": "pt"}


def wrong_language(text: str, asked: str | None) -> bool:
    a = (asked or "en").strip().lower().replace("_", "-")
    a = _LANG.get(a, a.split("-")[0] or "en")
    won = language_of(text)
    total = sum(won.values())
    return bool(total) and won.get(a, 0.0) < 0.5 * total and max(won, key=won.get) != a


def defect(prompt: str | None, response: str | None, asked: str | None) -> str | None:
    blank = prompt is not None and not prompt.strip()
    if is_empty(response, blank):
        return "empty"
    if blank and response.strip().lower().rstrip(".") == "empty file":
        return None
    if is_refusal(response):
        return "refusal"
    if copied_share(prompt, response) >= COPY_SHARE:
        return "copy"
    if is_truncated(response):
        return "truncated"
    if wrong_language(response, asked):
        return "language"
    return None


def defects(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One row (response_id, defect) for each response that is no proper answer.

    The requests are reduced to one row an id, by the key of the join; repeated
    responses get the same verdict and are reduced after it, as narrow rows.
    """
    q = requests.select("request_id", "content", "answer_lang").where("request_id is not null").dropDuplicates(["request_id"]).withColumn("__none", F.lit(0).cast("long"))
    # responses without a request meet nothing; a key of their own spreads them
    r = responses.select("response_id", "request_id", "summary", F.when(F.col("request_id").isNull(), F.xxhash64("response_id")).otherwise(F.lit(0)).alias("__none"))

    @arrow_udf("string")
    def judge(c: pd.Series, s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([defect(x, y, z) for x, y, z in zip(c, s, a)], dtype=object)

    both = r.join(q, ["request_id", "__none"], "left")
    return both.select("response_id", judge("content", "summary", "answer_lang").alias("defect")).where("defect is not null").distinct()
