"""Text and token-array expressions for corpus preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what stands for them in ASCII.
TYPOGRAPHIC, PLAIN = "‘’“”–—…·× ", "''\"\"--..x "
ACCENTED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyAAAAAACEEEEIIIINOOOOOUUUUY"


def folded(text: Column) -> Column:
    """Typographic and accented letters as ASCII; any other character outside it is a space."""
    return F.regexp_replace(F.translate(F.translate(text, TYPOGRAPHIC, PLAIN), ACCENTED, BARE), r"[^\x09\x0A\x20-\x7E]", " ")


def replaced(text: Column) -> Column:
    """How many characters have no ASCII form."""
    return F.regexp_count(F.translate(F.translate(text, TYPOGRAPHIC, PLAIN), ACCENTED, BARE), F.lit(r"[^\x09\x0A\x20-\x7E]")).cast("long")


def normal_key(text: Column) -> Column:
    """Case, punctuation and spacing folded."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: The characters of the vocabulary; ids start after the four control ids.
VOCABULARY = "".join(map(chr, range(32, 127))) + "\n\t"
CONTROLS = 4


def encoded(text: Column) -> Column:
    """array<int> of character ids; a character outside the vocabulary counts as space."""
    ids = F.map_from_arrays(F.array(*[F.lit(c) for c in VOCABULARY]), F.array(*[F.lit(i + CONTROLS) for i in range(len(VOCABULARY))]))
    return F.transform(F.split(text, "(?s)(?<=.)(?=.)"), lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(CONTROLS)))


def decoded(ids: Column) -> Column:
    """The text of character ids; control ids are left out."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i >= CONTROLS), lambda i: F.substring(F.lit(VOCABULARY), i - CONTROLS + 1, F.lit(1))), "")


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Cut or filled to a length."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def next_labels(ids: Column, target: Column, ignore: int = -100) -> Column:
    """At each place the next id where that is a target, else ignore; the last place has none."""
    return F.concat(F.transform(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), lambda x, i: F.when(F.get(target, i + 1), x).otherwise(ignore)), F.array(F.lit(ignore)))


def rendered(turns: Column, system: Column) -> Column:
    """system, then each turn with its role and an end mark."""
    return F.concat(F.lit("<system>"), system, F.lit("<end>"), F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<"), t["role"], F.lit(">"), t["text"], F.lit("<end>"))), ""))
