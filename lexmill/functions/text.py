"""Scalar text functions as Spark columns: ids, previews, cleaning, classification, citations."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import vocab

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, f) -> Column:
    """f(c), with c computed once by a one-element transform, else it would be computed for every use."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: C) -> Column:
    """Without white space at either end."""
    return F.trim(col(c), F.lit(" \t\n\x0b\f\r"))


def first_filled(*cs: C) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs), F.lit(""))


def contains_any(c: C, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (col(c).contains(w) for w in words))


def first_key(c: C, table: dict[str, list[str]], default: str | None = None) -> Column:
    """The first key of the table one of whose words is contained."""
    cases = [F.when(contains_any(c, words), F.lit(k)) for k, words in table.items()]
    return F.coalesce(*cases, F.lit(default))


def normalize_decision_id(c: C) -> Column:
    """without chunk suffix, upper case, blanks to hyphens, double hyphens once to single ones."""
    c = F.coalesce(col(c), F.lit(""))
    cut = F.when(c.contains("_chunk_"), F.substring_index(c, "_chunk_", 1)).otherwise(F.regexp_extract(c, r"(?is)^(.*?)(?:\s+chunk\s+\d+.*)?$", 1))
    return F.replace(F.replace(strip(F.upper(cut)), F.lit(" "), F.lit("-")), F.lit("--"), F.lit("-"))


def document_key(sr_number: C, decision_id: C, doc_id: C, original_id: C, point_id: C) -> Column:
    """F2."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (col(sr_number), normalize_decision_id(decision_id), col(doc_id), normalize_decision_id(original_id), col(point_id))))


def expand_query(c: C) -> Column:
    """the query and the terms of every trigger it contains, each once."""
    low = F.lower(c)
    terms = F.flatten(F.array(*(F.when(low.contains(k), F.array(*map(F.lit, v.split()))).otherwise(F.array().cast("array<string>")) for k, v in vocab.EXPANSIONS.items())))
    return F.when(F.size(terms) > 0, F.concat_ws(" ", col(c), F.array_join(F.array_distinct(terms), " "))).otherwise(col(c))


def marker_count(c: C, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.lower(c).contains(w).cast("int") for w in words))


def query_language(c: C) -> Column:
    """Italian or French if it alone leads with two markers or more, else German if it has any."""
    it, fr, de = (marker_count(c, vocab.MARKERS[k]) for k in ("it", "fr", "de"))
    return F.when((it > fr) & (it > de) & (it >= 2), "it").when((fr > it) & (fr > de) & (fr >= 2), "fr").when(de > 0, "de")


def query_canton(c: C) -> Column:
    return F.coalesce(*(F.when(F.lower(c).contains(k), F.lit(v)) for k, v in vocab.CANTONS.items()))


def squeeze(c: C) -> Column:
    return strip(F.regexp_replace(col(c), r"[\t\n\x0b\f\r][ \t\n\x0b\f\r]*| [ \t\n\x0b\f\r]+", " "))  # a single blank is left as it is


def up_to_last_blank(c: Column, least: int = 0) -> Column:
    """Cut at the last blank if it stands past `least` characters."""
    place = F.length(c) - F.instr(F.reverse(c), " ")
    return F.when(c.contains(" ") & (place > least), F.substring(c, F.lit(1), place)).otherwise(c)


def preview_batch(c: C, most: int = 500) -> Column:
    """F5."""
    s = squeeze(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(up_to_last_blank(F.substring(s, 1, most), most // 2), F.lit("...")))


def preview_decision(c: C, most: int = 200) -> Column:
    """dots even if the text just fits."""
    s = F.substring(squeeze(c), 1, most)
    return F.when(F.length(s) >= most, F.concat(up_to_last_blank(s, -1), F.lit("..."))).otherwise(s)


def preview_law(c: C, most: int = 200) -> Column:
    """dots by the length of the raw text."""
    return F.concat(F.substring(squeeze(c), 1, most), F.when(F.length(c) > most, "...").otherwise(""))


def join_lines(c: C) -> Column:
    """single line feeds become blanks, blank lines stay."""
    return strip(F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " "))


def clean_federal(c: C) -> Column:
    """F8: without page numbers and lone case numbers, then as join_lines."""
    c = F.regexp_replace(c, r"(?m)^\s*(?:Seite|Page|Pagina|S\.)\s*\d+\s*$", "")
    return join_lines(F.regexp_replace(c, r"(?m)^\s*[A-Z][\-\.]\d+/\d{4}\s*$", ""))


def clean_law(c: C) -> Column:
    """F10."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?m)^\d+\s*$", "")
    c = F.regexp_replace(c, r"(Art\.\s*\d{1,4}[a-z]?(?:bis|ter|quater|quinquies)?)(\d{3,})", "$1")
    return F.array_join(F.transform(F.split(F.regexp_replace(c, "  +", " "), "\n"), lambda x: strip(x)), "\n")


def clean_article(c: C) -> Column:
    """without raised digits, a closing reference line, and notes on amendments."""
    c = F.regexp_replace(c, "[¹²³⁴⁵⁶⁷⁸⁹⁰]+", "")
    c = F.regexp_replace(c, r"\n\s*SR \d[\d.]*\s*$", "")
    c = F.regexp_replace(c, r"(?:Fassung gemäss|Eingefügt durch|Aufgehoben durch)[^\n]*", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def law_name(c: C) -> Column:
    """F12."""
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 15), lambda x: strip(x))
    fits = F.filter(lines, lambda x: F.length(x).between(10, 200) & ~x.rlike(r"^\d+(\.\d+)*$") & ~x.rlike(r"^\d+\s*/\s*\d+$"))
    return F.coalesce(F.get(fits, 0), F.lit("Unknown"))


def law_type(c: C) -> Column:
    """F13."""
    n = F.substring_index(c, ".", 1).try_cast("int")
    kind = F.coalesce(*(F.when(n < 100 * (k + 1), F.lit(v)) for k, v in enumerate(vocab.LAW_TYPES)), F.lit("other"))
    return F.when(n.isNull(), "other").otherwise(kind)


def domain(c: C) -> Column:
    """F14."""
    return first_key(F.lower(c), vocab.DOMAINS, "general")


def hierarchy_path(name: C, part: C, title: C, chapter: C, section: C, article: C) -> Column:
    """F15."""
    return F.concat_ws(" > ", *map(col, (name, part, title, chapter, section)), F.concat(F.lit("Art. "), col(article)))


def article_refs(c: C) -> Column:
    """F16."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"Art\.\s*(\d+[a-z]*(?:bis|ter|quater|quinquies)?)"), F.lit(1))))


def article_id(sr: C, article: C, paragraph: C, language: C) -> Column:
    """F17."""
    part = F.when(col(paragraph).isNotNull(), F.concat(F.lit("_p"), col(paragraph).cast("string"))).otherwise("")
    return F.concat(F.lit("SR_"), F.translate(sr, ".", "_"), F.lit("_Art_"), col(article), part, F.lit("_"), col(language))


NUMBER = r"\d+(?:[a-z]|\s+(?:bis|ter|quater|quinquies))?(?:\s+(?:Abs|al|cpv|Bst|lit|let|Ziff)\.?\s*\d+[a-z]*)*"
AND = r"(?:\s*[,&\-]\s*|\s+(?:et|e|und|and)\s+)"


def legal_citations(c: C, codes: list[str]) -> Column:
    """`Art. n CODE` for each number of each list that a known code or `SR n` follows within 400 characters."""
    known = "|".join(sorted((r.replace(".", r"\.") for r in codes), key=lambda x: (-len(x), x)))
    pattern = rf"(?is)(?:Art\.?|§)\s*({NUMBER}(?:{AND}{NUMBER})*)(?:(?!Art\.?|§).){{0,400}}?\s+[\[(]?(\b(?:{known})\b|SR\s*\d[\d.]*)[\])]?"
    lists, ends = (F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2))

    def cite(numbers, code):
        code = F.when(F.upper(code).startswith("SR"), F.upper(code)).otherwise(F.replace(F.upper(code), F.lit("."), F.lit("")))
        return F.transform(F.split(numbers, f"(?i){AND}"), lambda n: F.concat(F.lit("Art. "), squeeze(n), F.lit(" "), code))

    return F.array_sort(F.array_distinct(F.flatten(F.zip_with(lists, ends, cite))))


def case_citations(c: C) -> Column:
    """F19."""
    cited = r"(?i)(?:BGE|ATF|DTF)\s+(\d+)\s+([IV]+)\s+(\d+)"
    official = F.transform(F.regexp_extract_all(c, F.lit(cited), F.lit(0)), lambda x: F.concat_ws(" ", F.lit("BGE"), *(F.regexp_extract(x, cited, k) for k in (1, 2, 3))))
    admin = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?:BVGE|ATAF)\s+(\d{4}/\d+)"), F.lit(1)), lambda x: F.concat(F.lit("BVGE "), x))
    files = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b([A-Z0-9]+[\-_.]\d+/\d{4})\b"), F.lit(1)), F.upper)
    return F.array_sort(F.array_distinct(F.concat(official, admin, files)))


def found(c: C, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def case_id(c: C) -> Column:
    """F20."""
    label = strip(found(c, r"(?iu)(?:Geschäftsnummer|Reference|Numéro de dossier|Incarto)\s*:?\s*([0-9A-Z_/.\-]+)"))
    return F.coalesce(label, F.replace(found(c, r"(?iu)(?:Urteil|Arrêt|Sentenza)\s+(?:vom|du|del)\s+\d+\.?\s+[\p{L}\p{N}_]+\.?\s+\d{4}\s+\(([^)]+)\)"), F.lit(" "), F.lit("_")))


def outcome(c: C) -> Column:
    """F21."""
    return once(F.lower(F.right(col(c), F.lit(3000))), lambda end: first_key(end, vocab.OUTCOMES, "unknown"))


#: What ends a court's name: a date's article as a word of its own (Italian ones in small letters also with della and so on), a full stop, a comma.
COURT_END = r"(?<![\p{L}\p{N}_])(?:vom|du|del|(?-i:dell[aeo]?))(?![\p{L}\p{N}_])|\.|,"


def lower_court(c: C) -> Column:
    """F24; names that begin with such a word go on (the application cut Delacroix to nothing)."""
    told = F.replace(strip(found(c, r"(?isu)(?:gegen\s+(?:das|den)\s+(?:Urteil|Entscheid|Beschluss)|contre\s+(?:l'arrêt|le jugement|la décision)|contro\s+(?:la sentenza|il giudizio|la decisione))\s+(?:des|della|du|de la|der|di)\s+(.*?)(?:" + COURT_END + ")")), F.lit("\n"), F.lit(" "))
    label = strip(found(c, r"(?iu)(?:Vorinstanz|Instance précédente|Istanza precedente)\s*:?\s+(.+?)(?:\n|$|Beschwerde|Recourant|Ricorrente)"))
    return F.coalesce(F.when(F.length(told) < 200, told), F.when((F.length(label) > 3) & ~F.lower(label).rlike("^(seien|ist|sind|und|dass)"), label))


def regeste(c: C) -> Column:
    """F25."""
    return strip(found(c, r"(?is)(?:Regeste|Regesto)(.*?)(?:A\.-|Sachverhalt|Faits|Fatti|F a t t i)"))


def header_place(c: C, groups: list[list[str]]) -> Column:
    """0-based place of the earliest strong header, else of the earliest weak one, else null."""
    def earliest(patterns):  # noqa: E306
        parts = F.split(c, rf"(?ismu)^(?-s:\s*(?:{'|'.join(patterns)}))", 2)  # what stands before the first match, and the rest
        return once(parts, lambda x: F.when(F.size(x) == 2, F.length(x[0])))
    return F.coalesce(*map(earliest, groups))


def sections(c: C, lang: C) -> Column:
    """struct of regeste, facts, reasoning, decision by the language's headers (unknown ones: German)."""
    c, lang = col(c), col(lang)
    def split(k):  # noqa: E306
        return once(F.struct(*(header_place(c, vocab.HEADERS[k][s]).alias(s) for s in ("facts", "reasoning", "decision"))), parts)
    def parts(places):  # noqa: E306
        f, r, d = (places[s] for s in ("facts", "reasoning", "decision"))
        n = F.length(c)
        end = lambda start, *after: F.least(*(F.when(x > start, x) for x in after), n)
        cut = lambda a, b: strip(F.substring(c, a + 1, b - a))
        none = f.isNull() & r.isNull() & d.isNull()
        return F.struct(
            F.when(f.isNotNull(), F.right(strip(F.substring(c, F.lit(1), f)), F.lit(2000))).when(r.isNotNull(), F.right(F.substring(c, F.lit(1), r), F.lit(2000))).alias("regeste"),
            F.when(f.isNotNull(), cut(f, end(f, r, d))).otherwise("").alias("facts"),
            F.when(none, c).when(r.isNotNull(), cut(r, end(r, d))).otherwise("").alias("reasoning"),
            F.when(d.isNotNull(), cut(d, n)).otherwise("").alias("decision"),
        )
    return F.when(lang == "fr", split("fr")).when(lang == "it", split("it")).otherwise(split("de"))


def court(c: C) -> Column:
    """F28, federal: by the file name."""
    return first_key(F.upper(c), {"CH_BGE": ["BGE", "ATF"], "CH_BGer": ["BGER"], "CH_BVGE": ["BVGE", "ATAF"], "CH_BStGer": ["BSTG", "TPF"]}, "CH_FED")


def source_of(c: C) -> Column:
    """F29."""
    return F.when(col(c).startswith("CH_TI") | col(c).contains("TI_"), "ticino").otherwise("federal")


def case_id_of_file(c: C) -> Column:
    """without a date at the end."""
    return F.regexp_replace(c, r"_\d{4}-\d{2}-\d{2}$", "")


def sr_of_file(c: C) -> Column:
    """S25."""
    return F.translate(found(c, r"^SR_(.+)_(?:de|fr|it)\b"), "_", ".")


def month_number(c: C) -> Column:
    names = F.create_map(*(F.lit(x) for k, names in enumerate(vocab.MONTHS, 1) for n in names for x in (n, f"{k:02d}")))
    return F.coalesce(names[F.lower(c)], F.when(col(c).rlike(r"^\d+$"), F.lpad(c, 2, "0")))


def date_of(c: C) -> Column:
    """the first written date as yyyy-mm-dd, null if its month is none."""
    pattern = r"(\d{1,2})\.?\s+(\d{1,2}|[a-zA-Zäöüéà]+)\.?\s+(\d{4})"
    day, month, year = (found(c, pattern, k) for k in (1, 2, 3))
    return F.concat(year, F.lit("-"), month_number(month), F.lit("-"), F.lpad(day, 2, "0"))


def year_of(meta_year: C, year: C, date: C, decided: C, now_year: int) -> Column:
    """F51."""
    def part(c):  # noqa: E306
        y = F.when(col(c).contains("."), F.substring_index(c, ".", -1)).otherwise(F.substring_index(F.replace(col(c), F.lit("/"), F.lit("-")), "-", 1)).try_cast("int")
        return F.when(y.between(1900, now_year + 1), y)
    return F.coalesce(col(meta_year), col(year), part(date), part(decided), F.lit(vocab.FINAL["default_year"]))


def year_of_id(c: C) -> Column:
    """F55."""
    return found(c, r"(\d{4})-\d{2}-\d{2}").cast("int")


def document_language(c: C) -> Column:
    """The language with most stop words in the first 5000 characters; ties by order, none: German."""
    words = F.regexp_extract_all(F.substring(F.lower(c), 1, 5000), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    count = lambda x: F.struct(*(F.size(F.filter(x, lambda w: w.isin(v))).alias(k) for k, v in vocab.STOP_WORDS.items()))  # noqa: B023, E731
    told = lambda n: F.when((n["fr"] > n["de"]) & (n["fr"] >= n["it"]), "fr").when((n["it"] > n["de"]) & (n["it"] > n["fr"]), "it").otherwise("de")
    return once(once(words, count), told)


def context_around(c: C, quote: C, width: int = 200) -> Column:
    """the quote with `width` characters around, blanks squeezed; else by its first 50 characters; else empty."""
    s, q = squeeze(c), squeeze(quote)
    at = F.greatest(F.position(F.lower(q), F.lower(s)), F.lit(0))
    at = F.when(at > 0, at).otherwise(F.position(F.lower(F.substring(q, 1, 50)), F.lower(s)))
    begin = F.greatest(at - width, F.lit(1))
    end = F.least(at + F.length(q) + width, F.length(s) + 1)
    return F.when(at > 0, F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(s, begin, end - begin), F.when(end <= F.length(s), "...").otherwise(""))).otherwise("")


def file_name(c: C, day: C) -> Column:
    """F38."""
    return F.concat(F.substring(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), 1, 50), F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit(".xlsx"))


def prompt_field(name: C, kind: C, text: C, options: C) -> Column:
    """F41."""
    kind = F.when(F.size(options) > 0, F.concat(F.lit("one of: "), F.array_join(options, ", "))).otherwise(col(kind))
    return F.concat(F.lit("- "), col(name), F.lit(" ("), kind, F.lit("): "), col(text))


def estimate_tokens(c: C) -> Column:
    """F68."""
    return F.floor(F.length(c) / 4)


def cost(tokens_in: C, tokens_out: C, price_in: float, price_out: float) -> Column:
    """F69."""
    return F.round(col(tokens_in) / 1e6 * price_in + col(tokens_out) / 1e6 * price_out, 6)


def truncate_context(c: C, budget_chars: int, marker: str = "\n\n[...]") -> Column:
    """at the last heading past half the budget, else the last blank line past 70 %, else at the budget."""
    cut = F.substring(c, 1, budget_chars)
    last = lambda x: F.length(cut) - F.instr(F.reverse(cut), x[::-1]) - len(x) + 1
    has = lambda x: cut.contains(x)
    at = F.when(has("\n## ") & (last("\n## ") > budget_chars * 0.5), last("\n## ")).when(has("\n\n") & (last("\n\n") > budget_chars * 0.7), last("\n\n")).otherwise(F.lit(budget_chars))
    return F.when(F.length(c) <= budget_chars, col(c)).otherwise(F.concat(F.substring(cut, F.lit(1), at), F.lit(marker)))


def display_id_ok(c: C) -> Column:
    """P14."""
    c = col(c)
    long = (F.length(c) >= 15) | contains_any(c, ["BGE", "BGER", "CH_", "-", "/"])
    return F.coalesce(c.rlike(r"\d") & (F.length(c) >= 5) & (c != "-") & long, F.lit(False))


def uuid5_url(c: C) -> Column:
    """version 5 UUID of a string in the URL namespace, with built-in hashing."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(c, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def file_hash(c: C) -> Column:
    """F85."""
    return F.substring(F.sha2(c, 256), 1, 16)


def settled(c: C, entities: bool = False) -> Column:
    """the text in normal form KC, its entities decoded once if asked for. Plain ASCII texts don't leave the JVM."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t) if entities else t), na_action="ignore")

    c = col(c)
    some = c.rlike(r"&[#A-Za-z]|[^\x00-\x7F]" if entities else r"[^\x00-\x7F]")
    return F.when(some, run(F.when(some, c))).otherwise(c)


def html_to_text(c: C) -> Column:
    """Line feeds after block tags, tags stripped, entities decoded, normal form KC, blank lines dropped."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", "")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|h1|h2|h3|tr)>|<br\s*/?>", "$0\n")
    c = settled(F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", ""), True)
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: strip(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def strip_fence(c: C) -> Column:
    """The content of a fenced block if there is one."""
    return F.coalesce(strip(found(c, r"(?s)```(?:json)?\s*(.*?)```")), strip(c))


def consistency(c: C) -> Column:
    """the verdict of a fenced JSON answer, else by keywords."""
    told = F.upper(F.get_json_object(strip_fence(c), "$.consistency"))
    up = F.upper(c)
    return F.coalesce(told, F.when(up.contains("DIVERGENT"), "DIVERGENT").when(up.contains("CONSISTENT"), "CONSISTENT").otherwise("MIXED"))


def bge_url(c: C) -> Column:
    """F32: citation text of an official decision, `BGE a III b`."""
    return strip(F.regexp_replace(F.replace(F.upper(c), F.lit("-"), F.lit(" ")), r"^(?:CH )?BGE ", "BGE "))


def pieces(c: C, n: int = 16, inner: bool = False) -> Column:
    """The n characters from each word's start; inner: only of words after white space."""
    before = r"(?<=\s)" if inner else r"(?<!\S)"
    return F.filter(F.regexp_extract_all(col(c), F.lit(rf"(?s)(?=({before}\S.{{{n - 1}}}))."), F.lit(1)), lambda x: x != "")


def shown_text(regeste: C, facts: C, reasoning: C, preview: C, most: int = 250) -> Column:
    """the headnote unless it is a court's header, else the beginning of the facts, of the reasoning without its header, or the preview."""
    filled = lambda c: F.coalesce(col(c), F.lit("")) != ""
    own = filled(regeste) & ~reduce(lambda a, b: a | b, (col(regeste).startswith(w) for w in vocab.COURT_HEADERS))
    body = F.regexp_replace(reasoning, r"^(?:Erwägungen|Considérant|Diritto|Considerando)[^\n]*\n?", "")
    best = F.when(own, col(regeste)).when(filled(facts), F.substring(facts, 1, 500)).when(filled(reasoning), F.substring(body, 1, 500))
    t = first_filled(best, regeste, facts, reasoning, preview)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def logged_name(c: C, folder: C) -> Column:
    """escapes of code points undone, the folder put before a bare name."""
    told = strip(c)
    plain = F.when(told.contains("\\u"), F.coalesce(F.from_json(F.concat(F.lit('{"x":"'), told, F.lit('"}')), "x string")["x"], told)).otherwise(told)
    return F.when(plain.contains("/"), plain).otherwise(F.concat_ws("/", col(folder), plain))


def year_window(last_run: C, today: C, first: int, last: int) -> tuple[Column, Column]:
    """first and last year to fetch: all at the first run, else two years after at most 30 days, else five."""
    back = F.when(F.datediff(col(today), col(last_run)) <= 30, 2).otherwise(5)
    return F.when(col(last_run).isNull(), F.lit(first)).otherwise(F.greatest(F.lit(first), last - back)), F.lit(last)


def prompt_budget(context: C, others: C, limit: int = 12000) -> Column:
    """the context, cut to the tokens that system prompt, history and question leave when all are over the limit."""
    room = F.greatest(limit - col(others), F.lit(0))
    return F.when(estimate_tokens(context) + col(others) > limit, F.substring(col(context), F.lit(1), (room * 4).cast("int"))).otherwise(col(context))


def encrypted(c: C, key: C) -> Column:
    """base64 of the text's AES-GCM cipher; the key has 16, 24 or 32 bytes and is the caller's."""
    return F.base64(F.aes_encrypt(F.encode(col(c), "UTF-8"), col(key), F.lit("GCM")))


def decrypted(c: C, key: C) -> Column:
    """null where the key or the cipher text is wrong."""
    return F.try_aes_decrypt(F.unbase64(col(c)), col(key), F.lit("GCM")).cast("string")


def law_line(rank: C | None, abbreviation: C, article: C, title: C, sr: C, language: C, body: C) -> Column:
    """a law's heading, numbered if there is a rank, and its text."""
    number = F.concat(col(rank).cast("string"), F.lit(". ")) if rank is not None else F.lit("")
    titled = F.when(F.coalesce(col(title), F.lit("")) != "", F.concat(F.lit(" - "), col(title))).otherwise("")
    return F.concat(F.lit("### "), number, col(abbreviation), F.lit(" Art. "), col(article), titled, F.lit(" (SR "), col(sr), F.lit(", "), F.upper(col(language)), F.lit(")\n\n"), col(body))


def decision_line(decision: C, year: C, court_name: C, language: C, body: C) -> Column:
    """a decision's heading and text; official decisions are cited with blanks."""
    base = normalize_decision_id(decision)
    cited = F.when(base.contains("BGE"), F.concat(F.lit("BGE "), F.replace(F.replace(base, F.lit("BGE-"), F.lit("")), F.lit("-"), F.lit(" ")))).otherwise(base)
    when = F.when(col(year).isNotNull(), F.concat(F.lit(" ("), col(year).cast("string"), F.lit(")"))).otherwise("")
    where = F.when(F.coalesce(col(court_name), F.lit("")) != "", F.concat(F.lit(" - "), col(court_name))).otherwise("")
    return F.concat(F.lit("### "), cited, when, where, F.lit(" ["), F.upper(col(language)), F.lit("]\n\n"), col(body))


def law_card(rank: C, abbreviation: C, article: C, sr: C, language: C, score: C, body: C) -> Column:
    """A law as shown in a result list, its text cut at 300 characters."""
    cut = F.when(F.length(body) > 300, F.concat(F.substring(body, 1, 300), F.lit("..."))).otherwise(col(body))
    return F.concat(F.lit("**"), col(rank).cast("string"), F.lit(". "), col(abbreviation), F.lit(" Art. "), col(article), F.lit("**\nSR "), col(sr), F.lit(" • `"), F.upper(col(language)), F.lit("` • Score: "), F.format_number(col(score), 2), F.lit("\n\n> "), cut, F.lit("\n"))


def consistency_label(verdict: C, sure: C) -> Column:
    """The lamp and words for a verdict and its confidence; unknown ones count as mixed and medium."""
    pick = lambda table, c, default: F.coalesce(*(F.when(col(c) == k, F.lit(v)) for k, v in table.items()), F.lit(table[default]))
    return F.concat(pick(vocab.VERDICTS, verdict, "MIXED"), F.lit(" ("), pick(vocab.CONFIDENCES, sure, "medium"), F.lit(")"))


def cantonal_sections(c: C) -> Column:
    """struct of facts, reasoning, decision. One header for facts and law makes all of it reasoning; without one for
    facts they are what stands before the law; without any the text up to the decision is reasoning."""
    c = col(c)
    kinds = ("facts", "reasoning", "both", "decision")
    def parts(places):  # noqa: E306
        f, r, both, d = (places[k] for k in kinds)
        end = F.coalesce(d, F.length(c))
        cut = lambda a, b: strip(F.substring(c, a + 1, F.greatest(b - a, F.lit(0))))
        start = F.coalesce(both, r, F.lit(0))
        facts = F.when(both.isNotNull() | r.isNull(), "").otherwise(cut(F.coalesce(f, F.lit(0)), r))
        return F.struct(facts.alias("facts"), cut(start, end).alias("reasoning"), F.when(d.isNotNull(), cut(end, F.length(c))).otherwise("").alias("decision"))
    return once(F.struct(*(header_place(c, [vocab.CANTONAL_HEADERS[k]]).alias(k) for k in kinds)), parts)


def cantonal_court(c: C) -> Column:
    """F28, cantonal: by the file name."""
    return first_key(c, vocab.CANTONAL_COURTS, "CH_TI")


def cantonal_lower_court(c: C) -> Column:
    """F24, cantonal: the first of the phrases' names with 6 to 199 characters."""
    names = [strip(found(c, rf"(?iu)(?:{p})(.+?)(?:\.|,|\n)")) for p in vocab.CANTONAL_APPEALS]
    return F.coalesce(*(F.when(F.length(n).between(6, 199), n) for n in names))


def presentation_id(c: C) -> Column:
    """An id without its chunk, official decisions as BGE-a-B-c, others in upper case with single hyphens."""
    bare = F.substring_index(col(c), "_chunk_", 1)
    bare = F.regexp_extract(bare, r"(?is)^(.*?)(?:\s+chunk\s+\d+.*)?$", 1)
    official = r"(?i)BGE[-\s]*(\d+)[-\s]*([IVX]+)[-\s]*(\d+)"
    cited = F.concat(F.lit("BGE-"), F.regexp_extract(bare, official, 1), F.lit("-"), F.upper(F.regexp_extract(bare, official, 2)), F.lit("-"), F.regexp_extract(bare, official, 3))
    return F.when(bare.rlike(official), cited).otherwise(F.regexp_replace(strip(F.upper(bare)), r"[\s_-]+", "-"))


def presentation_text(c: C) -> Column:
    """The first 150 characters with single blanks; empty for none."""
    return squeeze(F.substring(F.coalesce(col(c), F.lit("")), 1, 150))
