"""English word stems by Porter's second algorithm, and the words that searching leaves out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from functools import lru_cache

#: Words that searches don't look for. Fixed values.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own, words that stay after plurals are gone, and beginnings behind which the first region starts. Fixed values.
ODD = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
HEADS = ("gener", "commun", "arsen")
#: Endings and what takes their place: in the first region, then in the first, then left off in the second. Fixed values.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_VOWEL, _REGION = "[aeiouy]", re.compile("[aeiouy][^aeiouy]")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")
_SHORT = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|\A[aeiouy][^aeiouy])\Z")


def _ending(word: str, endings: object) -> str | None:
    """The longest of the endings that a word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    head = next((h for h in HEADS if word.startswith(h)), None)
    first = len(head) if head else (m.end() if (m := _REGION.search(word)) else len(word))
    return first, m.end() if (m := _REGION.search(word, first)) else len(word)


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word; letters other than a to z count as consonants."""
    if len(word) < 3:
        return word
    if word in ODD:
        return ODD[word]
    word = re.sub(r"(\A|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')\Z", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    # past and continuous forms
    e = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        word = word[: -len(e)] + "ee" if len(word) - len(e) >= r1 else word
    elif e and re.search(_VOWEL, word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")) or (_SHORT.search(word) and len(word) <= r1 and not _DOUBLE.search(word)):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
    word = re.sub(r"(?<=.)([^aeiouy])[yY]\Z", r"\1i", word)
    # derived forms
    e = _ending(word, STEP2)
    if e and len(word) - len(e) >= r1 and (e != "ogi" or word[-4:-3] == "l") and (e != "li" or word[-3:-2] in tuple("cdeghkmnrt")):
        word = word[: -len(e)] + STEP2[e]
    e = _ending(word, STEP3)
    if e and len(word) - len(e) >= (r2 if e == "ative" else r1):
        word = word[: -len(e)] + STEP3[e]
    e = _ending(word, STEP4)
    if e and len(word) - len(e) >= r2 and (e != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(e)]
    n = len(word) - 1
    if word.endswith("e") and (n >= r2 or n >= r1 and not _SHORT.search(word[:-1])) or word.endswith("ll") and n >= r2:
        word = word[:-1]
    return word.lower()


_WORD = re.compile(r"[^\W_]+")


@lru_cache(1)
def java_word() -> str:
    """The pattern of a word for Spark: letters and digits, those too that Python knows and an older Java does not."""
    known = [i for i in range(1 << 7, 0x110000) if chr(i).isalnum()]
    ends = zip((i for i in known if not chr(i - 1).isalnum()), (i for i in known if i == 0x10FFFF or not chr(i + 1).isalnum()), strict=True)
    return r"[\p{L}\p{N}[\p{Cn}&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ends) + "]]]+"


def words(text: str) -> set[str]:
    """Distinct words of a text, in lower case, without those that searches leave out."""
    return set(_WORD.findall(text.lower())) - STOP


def counts(text: str) -> Counter[str]:
    """How often each word of a text stands there, in lower case, without those that searches leave out."""
    out = Counter(_WORD.findall(text.lower()))
    for word in STOP & out.keys():
        del out[word]
    return out


def places(text: str, only: Container[str] | None = None) -> dict[str, list[int]]:
    """Stems of a text, or those in ``only``, with the places of their words, counted from 1; words that searches leave out have places but no stems."""
    out: dict[str, list[int]] = {}
    for i, word in enumerate(_WORD.findall(text.lower()), 1):
        if word not in STOP and (only is None or stem(word) in only):
            out.setdefault(stem(word), []).append(i)
    return out


def question_stems(question: str) -> list[str]:
    """Distinct stems of a question's words, in order."""
    return list(places(" ".join(re.findall(r"[a-z0-9]+", question.lower()))))
