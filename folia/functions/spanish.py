"""Spanish words to stems by the published Snowball rules, and the words that aren't indexed."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

VOWELS = frozenset("aeiouáéíóúü")
_ACCENTS = str.maketrans("áéíóú", "aeiou")

# The algorithm's endings by step.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUNS = "iéndo ándo ár ér ír ando iendo ar er ir yendo".split()
Y_ENDINGS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
VERB_ENDINGS = """
arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré
irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían
aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais
arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos
""".split()
PLAIN_VERB_ENDINGS = "en es éis emos".split()
RESIDUES = "os a o á í ó e é".split()


class Suffix(NamedTuple):
    """Endings of step 1: the region they must lie in, what takes their place, and endings that go with them (region R2), by turns."""

    endings: str
    region: str = "r2"
    instead: str = ""
    before: tuple[tuple[str, ...], ...] = ()


# Step 1.
SUFFIXES = (
    Suffix("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"),
    Suffix("adora ador ación adoras adores aciones ante antes ancia ancias acion", before=(("ic",),)),
    Suffix("logía logías", instead="log"),
    Suffix("ución uciones ucion", instead="u"),
    Suffix("encia encias", instead="ente"),
    Suffix("amente", "r1", before=(("iv", "os", "ic", "ad"), ("at",))),
    Suffix("mente", before=(("ante", "able", "ible"),)),
    Suffix("idad idades", before=(("abil", "ic", "iv"),)),
    Suffix("iva ivo ivas ivos", before=(("at",),)),
)
_STEP_1 = {e: s for s in SUFFIXES for e in s.endings.split()}

# Words that aren't indexed; the forms of four verbs are made of stems and endings below.
STOP_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre
también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo
otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas
nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra
vuestros vuestras esos esas
estoy estás está estamos estáis están esté estés estemos estéis estén estaba estabas estábamos estabais estaban estando estado estada estados
estadas estad he has ha hemos habéis han haya hayas hayamos hayáis hayan había habías habíamos habíais habían habiendo habido habida habidos
habidas soy eres es somos sois son sea seas seamos seáis sean era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron fuera fueras
fuéramos fuerais fueran fuese fueses fuésemos fueseis fuesen siendo sido tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos
tengáis tengan tenía tenías teníamos teníais tenían teniendo tenido tenida tenidos tenidas tened
"""
_FUTURE = "é ás á emos éis án ía ías íamos íais ían".split()
_PAST = "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen".split()


@lru_cache(1)
def stop_words() -> frozenset[str]:
    """The fixed words with the futures, conditionals and pasts of estar, haber, ser and tener."""
    future = (root + end for root in ("estar", "habr", "ser", "tendr") for end in _FUTURE)
    past = (root + end for root in ("estuv", "hub", "tuv") for end in _PAST)
    return frozenset(STOP_WORDS.split()) | frozenset(future) | frozenset(past)


def _after(word: str, start: int, vowel: bool) -> int:
    """The place after the first vowel (or else consonant) from ``start`` on, the word's end if there is none."""
    return next((k + 1 for k in range(start, len(word)) if (word[k] in VOWELS) == vowel), len(word))


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    r1 = _after(word, _after(word, 0, True), False)
    r2 = _after(word, _after(word, r1, True), False)
    if len(word) < 3:
        return len(word), r1, r2
    first, second = (c in VOWELS for c in word[:2])
    rv = _after(word, 2, True) if not second else _after(word, 2, False) if first else 3
    return rv, r1, r2


def _longest(word: str, endings, start: int = 0) -> str:
    """The longest of the endings that the word has from ``start`` on, or an empty string."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


def _without_pronoun(word: str, rv: int) -> str:
    pronoun = _longest(word, PRONOUNS)
    verb = word[: len(word) - len(pronoun)]
    end = _longest(verb, BEFORE_PRONOUNS)
    if not pronoun or not end or len(verb) - len(end) < rv:
        return word
    if end == "yendo":
        return verb if verb.endswith("uyendo") else word
    return verb[: len(verb) - len(end)] + end.translate(_ACCENTS)


def _without_suffix(word: str, starts: dict[str, int]) -> str:
    end = _longest(word, _STEP_1)
    known = _STEP_1.get(end)
    if known is None or len(word) - len(end) < starts[known.region]:
        return word
    word, last = word[: len(word) - len(end)] + known.instead, ""
    for turn, choices in enumerate(known.before):
        more = _longest(word, choices)
        if not more or len(word) - len(more) < starts["r2"] or (turn and last != "iv"):  # only after iv is there a second turn
            break
        word, last = word[: len(word) - len(more)], more
    return word


def _without_verb_ending(word: str, rv: int) -> str:
    end = _longest(word, Y_ENDINGS, rv)
    if end and word[: len(word) - len(end)].endswith("u"):
        return word[: len(word) - len(end)]
    end = _longest(word, (*PLAIN_VERB_ENDINGS, *VERB_ENDINGS), rv)
    word = word[: len(word) - len(end)]
    return word[:-1] if end in PLAIN_VERB_ENDINGS and word.endswith("gu") else word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1, r2 = regions(word)
    word = _without_pronoun(word, rv)
    shorter = _without_suffix(word, {"r1": r1, "r2": r2})
    word = shorter if shorter != word else _without_verb_ending(word, rv)
    end = _longest(word, RESIDUES)
    if end and len(word) - len(end) >= rv:
        word = word[: len(word) - len(end)]
        if end in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ACCENTS)
