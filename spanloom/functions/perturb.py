"""Sixteen ways to spoil a text, and none. Inside the JVM; chance is a hash of the seed, the place and the text, so that a text is
spoilt alike wherever and whenever it is read, and another engine can compute the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# --- fixed values: neighbours on a keyboard, look-alikes, letters with a mark ---------------------------------
KEYBOARD = {a: b for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm") for a, b in zip(row, row[1:] + row[-2])}
LOOK_ALIKES = dict(zip("aceiopxyABCEHKMOPTX", "асеіорхуАВСЕНКМОРТХ"))
MARKED = dict(zip("aeioucnAEIOUCN", "áéíóúçñÁÉÍÓÚÇÑ"))
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# ---------------------------------------------------------------------------------------------------------------


def chance(text: Column, at: Column, seed: int) -> Column:
    """A number in [0, 1) for a place of a text: the first four hexadecimal digits of md5(seed:place:text)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), at.cast("string"), F.lit(":"), text)), 1, 4), 16, 10).cast("int") / 65536


def _each(text: Column, seed: int, change: Callable[[Column, Column, Column], Column]) -> Column:
    """Every character through change(character, place from 1, chance)."""
    places = F.sequence(F.lit(1), F.length(text))
    chars = F.transform(places, lambda i: change(F.substring(text, i, F.lit(1)), i, chance(text, i, seed)))
    return F.when(F.length(text) > 0, F.array_join(chars, "")).otherwise(text)


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], c)


def _letter(c: Column) -> Column:
    return c.rlike(r"^\p{L}$")


def _title(text: Column) -> Column:
    words = F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def _swapped(text: Column, seed: int, share: float) -> Column:
    """Pairs of letters at odd and even places change places, each pair by its own chance: no letter moves twice."""
    n = F.length(text)
    pairs = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(2))

    def pair(i: Column) -> Column:
        a, b = F.substring(text, i, F.lit(1)), F.substring(text, i + 1, F.lit(1))
        return F.when((i < n) & _letter(a) & _letter(b) & (chance(text, i, seed) < share), F.concat(b, a)).otherwise(F.concat(a, b))

    return F.when(n > 1, F.array_join(F.transform(pairs, pair), "")).otherwise(text)


PERTURBATIONS: dict[str, Callable[[Column, int, float], Column]] = {
    "none": lambda t, s, p: t,
    "typo_swap": _swapped,
    "typo_insert": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(_letter(c) & (r < p), F.concat(c, _mapped(F.lower(c), KEYBOARD))).otherwise(c)),
    "typo_delete": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(_letter(c) & (r < p), F.lit("")).otherwise(c)),
    "typo_keyboard": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(_letter(c) & (r < p), _mapped(F.lower(c), KEYBOARD)).otherwise(c)),
    "case_upper": lambda t, s, p: F.upper(t),
    "case_lower": lambda t, s, p: F.lower(t),
    "case_title": lambda t, s, p: _title(t),
    "case_mixed": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(i % 2 == 1, F.upper(c)).otherwise(F.lower(c))),
    "space_extra": lambda t, s, p: _each(t, s, lambda c, i, r: F.when((c == " ") & (r < 3 * p), F.lit("  ")).otherwise(c)),
    "space_remove": lambda t, s, p: _each(t, s, lambda c, i, r: F.when((c == " ") & (r < p), F.lit("")).otherwise(c)),
    "space_newline": lambda t, s, p: _each(t, s, lambda c, i, r: F.when((c == " ") & (r < p), F.lit("\n")).otherwise(c)),
    "punctuation_remove": lambda t, s, p: F.regexp_replace(t, PUNCTUATION, ""),
    "punctuation_extra": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(c.rlike(PUNCTUATION) & (r < 3 * p), F.concat(c, c)).otherwise(c)),
    "unicode_look_alike": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(r < p, _mapped(c, LOOK_ALIKES)).otherwise(c)),
    "unicode_marks": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(r < p, _mapped(c, MARKED)).otherwise(c)),
    "unicode_zero_width": lambda t, s, p: _each(t, s, lambda c, i, r: F.when(r < p / 2, F.concat(c, F.lit("​"))).otherwise(c)),
}


def perturbed(text: Column, how: str, seed: int = 42, intensity: float = 0.1) -> Column:
    """A text spoilt in one of PERTURBATIONS; intensity is the share of places that may change. Null stays null."""
    return PERTURBATIONS[how](text, seed, intensity)
