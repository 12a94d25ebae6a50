"""The judges of a decision (F22, F23): three places they are told at, and a grammar of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import found, squeeze

# fixed values: words of roles, titles and articles that are no names
ROLES = [
    "richter", "richterin", "richterinnen", "bundesrichter", "bundesrichterin", "bundesrichterinnen", "präsident", "präsidentin", "präsidenten", "vorsitzende", "vorsitzender",
    "vorsitzenden", "gerichtsschreiber", "gerichtsschreiberin", "kanzler", "oberrichter", "oberrichterin", "oberrichterinnen", "juge", "juges", "président", "présidente", "présidents",
    "greffier", "greffière", "greffiers", "fédéral", "fédérale", "fédéraux", "pénal", "pénale", "pénaux", "civil", "civile", "civils", "suppléant", "suppléante", "giudice", "giudici",
    "presidente", "presidenti", "cancelliere", "cancelliera", "cancellieri", "federale", "federali", "penale", "penali", "civili", "supplente", "supplenti", "mm", "mme", "mmes", "mr", "dr",
    "prof", "me", "herr", "frau", "et", "und", "e", "la", "le", "il", "der", "die", "das", "les", "des", "della", "del", "di", "den", "dem",
]
NUMERALS = ["ii", "iii", "iv", "ab", "vom", "am", "im", "zu"]
# fixed values: headings of the bench and what ends it
BENCH = r"(?isU)(?:Besetzung|Composition|Composizione)\s*[:\n]?\s*(.*?)(?:Greffièr|Greffier|Gerichtsschreiber|Cancellier|Parteien|Parties|Parti|Participants|Verfahrensbeteiligte)"
SINGLE = r"(?U)(?:La|Le|Les)\s+juges?\s+(?:[\w\s]+\s+)?([A-Z][a-zéèêëàâäùûüôöîïç\-]+(?:\s+[A-Z][a-zéèêëàâäùûüôöîïç\-]+)+)"
LISTED = r"(?isU)(?:juges?|richter|giudici)\s*[:\n]\s*(.+?)(?:\n\n|Greffier|Gerichtsschreiber|Cancellier)"
CANTONAL = [
    r"(?isU)compost[ao]?\s+dai?\s+giudici?\s*[:\n]?\s*(.+?)(?=segretari|cancellier|parti\b|\n\n)",
    r"(?isU)(?:Giudici|Richter|Juges)\s*[:\n]?\s*(.+?)(?=Cancellier|Segretari|Gerichtsschreiber|\n\n)",
    r"(?isU)Composizione\s*[:\n]?\s*(.+?)(?=Parti|Parteien|Parties|\n\n)",
]
CANTONAL_ROLES = r"(?iU),?\s*(?:presidente|giudice|membro|supplente)\b"
CANTONAL_NOISE = ["il", "la", "lo", "gli", "le", "un", "una", "del", "della", "nei", "nella", "dal", "dalla", "con", "per", "tra", "fra"]
MOST, HEAD = 6, 3000


def one_of(c: Column, words: list[str]) -> Column:
    return F.lower(c).isin(*words)


def plausible(name: Column) -> Column:
    """Begins with a capital, has three letters, is no role and no acronym."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return name.rlike(r"^\p{Lu}") & (letters >= 3) & ~one_of(name, ROLES) & ~((F.upper(name) == name) & (F.length(name) > 3))


def names(raw: Column) -> Column:
    """The names of a list: capitalised words between separators, without roles."""
    parts = F.split(squeeze(raw), r"[,;]+|\s+(?:et|und|e)\s+")
    words = lambda p: F.transform(F.split(p, " "), lambda w: F.regexp_replace(w, r"[,;:.]$", ""))
    kept = lambda p: F.filter(words(p), lambda w: w.rlike(r"^\p{Lu}.") & ~one_of(w, ROLES) & ~one_of(w, NUMERALS))
    return F.filter(F.transform(parts, lambda p: F.array_join(kept(p), " ")), plausible)


def filled(*lists: Column) -> Column:
    """The first list that is not empty, at most MOST of it."""
    none = F.array().cast("array<string>")
    return F.slice(F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), none), 1, MOST)


def judges(c: Column) -> Column:
    """the bench under its heading, else judges named one by one, else a list after their role (both near the beginning)."""
    head = F.substring(c, 1, HEAD)
    single = F.filter(F.transform(F.regexp_extract_all(head, F.lit(SINGLE), F.lit(1)), lambda x: F.trim(x)), plausible)
    return filled(names(found(c, BENCH)), single, names(found(head, LISTED)))


def cantonal_judges(c: Column) -> Column:
    """the names after `composta dai giudici` or another heading of the bench."""

    def listed(raw: Column) -> Column:
        plain = F.regexp_replace(squeeze(raw), CANTONAL_ROLES, "")
        parts = F.transform(F.split(plain, r",+|\s+e\s+"), lambda x: F.trim(x))
        return F.filter(parts, lambda x: x.rlike(r"^\p{Lu}.") & ~one_of(x, CANTONAL_NOISE) & ~F.lower(x).startswith("part"))

    return filled(*(listed(found(c, p)) for p in CANTONAL))
