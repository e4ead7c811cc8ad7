"""Places: scores of provinces and of places elsewhere, from one scan of each text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from festa.functions import lexicon
from festa.functions.text import has_any, let, normalize, one_of

KEYS = tuple(lexicon.PROVINCES)
_SHOWN = {"TP. Hồ Chí Minh": "tp ho chi minh", "Đồng Nai": "dong nai", "Tây Ninh": "tay ninh", "An Giang": "an giang", "Đồng Tháp": "dong thap", "Vĩnh Long": "vinh long", "Cần Thơ": "can tho", "Cà Mau": "ca mau"}


def aliases(key: str) -> tuple[str, ...]:
    shown, names = lexicon.PROVINCES[key]
    return tuple(dict.fromkeys([*names, _SHOWN[shown]]))


OWN = {key: aliases(key) for key in KEYS}
_END = "(?![a-z0-9])"
OWN_ALL = tuple(dict.fromkeys(a for key in KEYS for a in OWN[key]))


def mentions(normalized: Column) -> Column:
    """At every word start the longest place name that stands there; one scan for all names."""
    places = (*OWN_ALL, *lexicon.ELSEWHERE)
    # words are parted by one blank, so that only blanks and the first letters of names are looked at closely
    first = "".join(sorted({p[0] for p in places}))
    return F.regexp_extract_all(F.concat(F.lit(" "), normalized), F.lit(f" (?=[{first}])(?=({one_of(places, _END)}))"), F.lit(1))


def _count(found: Column, names: tuple[str, ...]) -> Column:
    """How often the names stand in a text, from its ``mentions``: a longer name that begins with one counts for it too."""
    weights: dict[int, list[str]] = {}
    for place in {*OWN_ALL, *lexicon.ELSEWHERE}:
        n = sum(place == a or place.startswith(f"{a} ") for a in names)
        if n:
            weights.setdefault(n, []).append(place)
    number = lambda places: F.size(F.filter(found, lambda x: x.isin(sorted(places))))
    return reduce(lambda a, b: a + b, [number(places) * n for n, places in sorted(weights.items())])


def scores(title: Column, body: Column) -> Column:
    """struct of one score per province and ``elsewhere``: mentions, those in the title counting three times."""
    groups = [*OWN.items(), ("elsewhere", lexicon.ELSEWHERE)]
    both = F.struct(mentions(normalize(title)).alias("title"), mentions(normalize(body)).alias("body"))
    return let(both, lambda m: F.struct(*[(3 * _count(m["title"], names) + _count(m["body"], names)).alias(key) for key, names in groups]))


def best_own(score: Column) -> Column:
    return F.greatest(*[score[k] for k in KEYS])


def score_of(score: Column, key: Column) -> Column:
    return reduce(lambda chain, k: chain.when(key == k, score[k]), KEYS[1:], F.when(key == KEYS[0], score[KEYS[0]])).otherwise(0)


def top_province(score: Column) -> Column:
    """The province of the highest score, the first of equals; null if all are 0."""

    def first(s: Column) -> Column:
        ranked = F.array(*[F.struct(s[k].alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("key")) for i, k in enumerate(KEYS)])
        return let(F.array_max(ranked), lambda top: F.when(top["n"] > 0, top["key"]))

    return let(score, first)


def detect_province(score: Column, hint: Column | None = None) -> Column:
    """The top province if its score is 2 or more, else a valid hint."""
    top = let(score, lambda s: F.when(best_own(s) >= 2, top_province(s)))
    return top if hint is None else F.coalesce(top, F.when(hint.isin(*KEYS), hint))


def province_name(key: Column) -> Column:
    shown = reduce(lambda chain, k: chain.when(key == k, lexicon.PROVINCES[k][0]), KEYS[1:], F.when(key == KEYS[0], lexicon.PROVINCES[KEYS[0]][0]))
    return shown.otherwise(key)


def resolve_province(typed: Column) -> Column:
    """The province a user means: an exact name first, then one contained in the text."""
    n = normalize(typed)
    names = {k: (*OWN[k], *lexicon.TYPED_NAMES.get(k, ())) for k in KEYS}
    exact = [F.when(n.isin(*names[k]), F.lit(k)) for k in KEYS]
    inside = [F.when(has_any(n, OWN[k]), F.lit(k)) for k in KEYS]
    return F.when(n != "", F.coalesce(*exact, *inside))


def title_elsewhere(title: Column) -> Column:
    """The title names a place elsewhere and none of the region."""
    return let(normalize(title), lambda n: has_any(n, lexicon.ELSEWHERE) & ~has_any(n, OWN_ALL))


def held_elsewhere(title: Column, lead: Column) -> Column:
    """Title or lead say that it takes place somewhere else, and nowhere in the region."""
    n = F.concat(F.lit(" "), normalize(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.substring(F.coalesce(lead, F.lit("")), 1, 600))))
    at = rf" (?:{'|'.join(lexicon.AT_WORDS)}) (?:(?:{'|'.join(lexicon.PLACE_PREFIXES)}) )?"
    there, here = one_of(tuple(lexicon.ELSEWHERE), _END), one_of(OWN_ALL, _END)
    other = rf"{at}{there}| (?:{'|'.join(lexicon.FESTIVAL_HEADS)}) {there}"
    return let(n, lambda x: x.rlike(other) & ~x.rlike(rf"{at}{here}"))


def correct_province(score: Column, claimed: Column) -> Column:
    """Another province replaces the claimed one if its score is strictly higher."""
    return let(score, lambda s: F.when(best_own(s) > score_of(s, claimed), top_province(s)).otherwise(claimed))
