"""Scalar functions over names, scores and dates, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Case rules of a name token by its leading flags: 1 heeds case, -1 ignores it, 0 leaves it to the space.
_FLAGS = (("??", 0), ("!?", -1), ("?!", -1), ("?", 1))


def token(text: str) -> tuple[str | None, int, str]:
    """(space, case rule, name) of `#SPACE#name` with flags before either part; a leading `?` is a flag, not a wildcard."""
    rule = 0
    for flag, value in _FLAGS:
        if text.startswith(flag):
            rule, text = value, text[len(flag) :]
            break
    found = re.match(r"#([^#]+)#(.*)$", text, re.S)
    return (found[1], rule, found[2]) if found else (None, rule, text)


def name_matches(column: Column, text: str, heeds_case: bool = False) -> Column:
    """Whether a name fits a pattern: `%` stands for anything, `?` for one character, `_` for itself.

    Patterns of wildcards alone are refused.
    """
    if re.fullmatch(r"[%?_]*", text):
        raise ValueError(f"{text!r} has nothing but wildcards")
    if "%" in text or "?" in text:
        pattern = text.replace("\\", "\\\\").replace("_", "\\_").replace("?", "_")
        return column.like(pattern) if heeds_case else F.upper(column).like(pattern.upper())
    return column == text if heeds_case else F.upper(column) == text.upper()


def words(text: Column, split: str = r"[^A-Z0-9]+", most: int = 100) -> Column:
    """Distinct upper-case words of ASCII text, at most so many characters each, without empty ones and zeros."""
    plain = F.regexp_replace(F.upper(text), r"[^\x20-\x7E]", " ")
    cut = F.transform(F.split(plain, split), lambda w: F.substring(w, 1, most))
    return F.array_distinct(F.filter(cut, lambda w: (w != "") & (w != "0")))


def author(text: Column) -> Column:
    """`Smith,J.A. Jr.` as `SMITH JA`: surname, then initials, without suffixes and dots."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)[ ,]+(jr|sr|ii|iii|iv)\.?$", ""), r"\.", "")
    last, first = F.regexp_extract(bare, r"^([^, ]+)", 1), F.regexp_replace(F.regexp_extract(bare, r"^[^, ]+[, ]+(.*)$", 1), r"[^A-Za-z]", "")
    return F.trim(F.concat_ws(" ", F.upper(last), F.upper(first)))


def accession_kind(text: Column) -> Column:
    """refseq, gi, versioned or other, by format."""
    return F.when(text.rlike(r"^[NX][MRPGCT]_\d+(\.\d+)?$"), "refseq").when(text.rlike(r"^(gi\|?)?\d+$"), "gi").when(text.rlike(r"^[A-Z]+\d+\.\d+$"), "versioned").otherwise("other")


def genomic(text: Column) -> dict[str, Column]:
    """species, level, chromosome and build of names like `homo_sapiens.chromosome.7.NCBI36`."""
    parts = F.split(text, r"\.")
    return {n: F.try_element_at(parts, F.lit(k + 1)) for k, n in enumerate(("species", "level", "chromosome", "build"))}


def chromosome(text: Column) -> Column:
    """The short name: without species, level and build, `chr` and leading zeros."""
    inner = F.regexp_replace(text, r"(?i)^(?:.*\.)?(?:chromosome\.)?(?:chr)?0*([0-9]+|X|Y|MT?)(?:\..*)?$", "$1")
    return F.upper(inner)


def significant(x: Column, figures: int = 3) -> Column:
    """Rounded to so many significant figures; null and zero stay."""
    power = figures - 1 - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), power)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def percent(score: Column) -> Column:
    return F.when(score.isNull(), "").otherwise(F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%")))


def powered(score: Column) -> Column:
    """A score as the power of ten it stands for: 7.3 as 5.0e-08; empty for null."""
    x = F.pow(F.lit(10.0), -score)
    power = F.floor(F.log10(x))
    return F.when(score.isNull(), "").otherwise(F.format_string("%.1fe%+03d", x / F.pow(F.lit(10.0), power), power))


def from_powered(text: Column) -> Column:
    """The score of such a text."""
    return F.round(-F.log10(text.try_cast("double")), 1)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def shortened_list(items: Column, most: int) -> Column:
    """The first items, joined, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def any_date(text: Column) -> Column:
    """A date in any of the usual formats, or null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy MMM dd", "yyyy MMM", "dd/MM/yyyy", "yyyy")]).cast("date")


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def natural_key(text: Column) -> list[Column]:
    """Sort keys: numbers first by value, then names by prefix and number, nulls last."""
    number = text.try_cast("double")
    prefix = F.regexp_extract(text, r"^(\D*)", 1)
    tail = F.regexp_extract(text, r"^\D*(\d+)", 1).try_cast("double")
    return [text.isNull(), number.isNull(), number.asc_nulls_last(), F.upper(prefix), tail.asc_nulls_last(), text]


def components_of(smiles: Column) -> Column:
    """The parts of a structure that dots separate, the longest first."""
    return F.reverse(F.array_sort(F.transform(F.split(smiles, r"\."), lambda x: F.struct(F.length(x).alias("n"), x.alias("part")))))["part"]


#: Fixed patterns by rank: name space, pattern of its identifiers.
ID_PATTERNS = (("ORDER", r"^O#\d+$"), ("PART", r"^P#\d+$"), ("SUPPLIER", r"^S#\d+$"), ("CUSTOMER", r"^C#\d+$"), ("NATION", r"^N#\d+$"), ("REGION", r"^R#\d+$"), ("NUMBER", r"^\d+$"))


def guessed_space(text: Column) -> Column:
    """The first name space whose pattern fits."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ID_PATTERNS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
