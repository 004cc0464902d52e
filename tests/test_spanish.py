"""The stemmer against published examples and words worked out by its rules; the list of words that aren't indexed."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folia.functions.spanish import regions, stem, stop_words

# Words and stems of the algorithm's public sample.
SAMPLE = """
cheque chequ, chequeo cheque, cheques chequ, cheraw cheraw, chesca chesc, chester chest, chetumal chetumal, chetumaleños chetumaleñ,
chevrolet chevrolet, cheyene cheyen, cheyenne cheyenn, chi chi, chía chi, chiapaneca chiapanec, chiapas chiap, chiba chib, chic chic,
chica chic, chicago chicag, chicana chican, chicano chican, chicas chic, chicharrones chicharron, chichen chich, chichimecas chichimec,
chicles chicl, chico chic, torá tor, tórax torax, torcer torc, toreado tor, toreados tor, toreándolo tor, torear tor, toreara tor,
torearlo tor, toreó tore, torero torer, toreros torer, torio tori, tormenta torment, tormentas torment, tornado torn, tornados torn,
tornar torn, tornen torn, torneo torne, torneos torne, tornillo tornill, tornillos tornill, torniquete torniquet, torno torn, toro tor,
toronto toront, toros tor, torpedearon torped, torpeza torpez, torrado torr, torralba torralb, torre torr, torrencial torrencial,
torrenciales torrencial, torrente torrent, torreon torreon, torreón torreon, torres torr, torrescano torrescan
"""
# Worked out by hand, a rule or exception each.
BY_RULE = """
notificación notif, notificaciones notif, notificado notific, resolución resolu, resoluciones resolu, juzgado juzg, juzgados juzg,
sentencia sentenci, sentencias sentenci, audiencia audienci, competencia competent, competencias competent, rápidamente rapid, civilmente civil,
efectivamente efect, legislativamente legisl, notoriamente notori, amablemente amabl, posibilidad posibil, responsabilidad respons, publicidad public,
actividades activ, negativa negat, negativo negat, operativo oper, biología biolog, biologías biolog, indicador indic, publicador public,
aplicante aplic, tolerancia toler, esperanza esper, realismo realism, agradable agrad, famoso famos, casamiento casamient, pensamientos pensamient,
diciéndole dic, haciéndolo hac, darle darl, entregárselo entreg, construyendo constru, construyéndolo construyendol, oyó oyo, huyeron huyeron, incluye inclu, incluyen inclu,
paguen pag, sigue sig, distingue disting, averigüe averigü, casas cas, leyes ley, el el, a a, y y, sol sol, oír oir, áreas are, aéreo aere, ojo ojo, ir ir, niño niñ, señores señor, trabajábamos trabaj
"""


def pairs(text):
    return [tuple(p.split()) for p in text.replace("\n", " ").split(",")]


@pytest.mark.parametrize("word,want", pairs(SAMPLE) + pairs(BY_RULE))
def test_stems(word, want):
    assert stem(word) == want


@settings(max_examples=300)
@given(st.text(alphabet="aeiouáéíóúüñrstgyqumcn", max_size=14))
def test_any_word(word):
    rv, r1, r2 = regions(word)
    assert 0 <= r1 <= r2 <= len(word) and 0 <= rv <= len(word)
    short = stem(word)
    assert len(short) <= len(word) + 1 and not set(short) & set("áéíóú")


def test_words_that_are_not_indexed():
    words = stop_words()
    assert {"de", "también", "estaremos", "habrían", "tuviésemos", "hubo", "sería", "estuvieron", "fuese", "tened"} <= words
    assert not {"estarés", "causa", "tribunal", ""} & words and len(words) > 300
