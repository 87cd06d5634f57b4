"""Text functions: folding, names, pages, notes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The words for kinds of realms that a name may open with.
TYPE_WORDS = (
    "bailliage", "office", "prevote", "sous-prevote", "grande prevote", "chatellenie", "recette", "mairie",
    "haute-mairie", "cour", "seigneurie", "terre", "terres", "comte", "marquisat", "principaute", "baronnie",
    "fief", "condominium", "vouerie", "avouerie", "ban", "franc-alleu", "domaine", "eveche temporel", "eveche",
    "duche", "electorat", "abbaye", "prieure", "commanderie",
)


#: The words that keep the hyphen before them.
PARTICLES = (
    "lès", "les", "lez", "sur", "sous", "en", "le", "la", "aux", "au", "devant",
    "de", "du", "des", "et", "am", "an", "bei", "im", "auf", "der", "von",
)


@F.pandas_udf(StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """The text's compatibility decomposition without combining marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold(text: Column) -> Column:
    """Without marks, lower case; what is neither a letter, a digit nor a hyphen becomes a space."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(text)), "[^a-z0-9-]+", " "))


def norm(text: Column) -> Column:
    """fold() without hyphens."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(text)), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def base_name(folded: Column) -> Column:
    """A folded name without its article, kind of realm and particle; the name itself where nothing is left."""
    words = "|".join(sorted(TYPE_WORDS, key=len, reverse=True))
    rest = F.regexp_replace(folded, rf"^(?:(?:la|le|les|l) +)?(?:{words}) +(?:(?:de|du|des|d) +)?(?:(?:la|le|les|l) +)?", "")
    return F.coalesce(F.nullif(rest, F.lit("")), folded)


def clip(text: Column, limit: int = 200) -> Column:
    """At most limit characters, cut at a word, with an ellipsis."""
    head = F.substring(text, 1, limit - 1)
    cut = F.regexp_replace(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head), "[ ,;:]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def split_names(name: Column) -> Column:
    """"X ou Y", "X alias Y" and "X (Y)" as an array; an aside in lower case goes."""
    aside = r"^(.+?) \((.+)\)$"
    pair = lambda p: F.when(
        F.regexp_like(p, F.lit(aside)),
        F.when(F.regexp_like(F.regexp_extract(p, aside, 2), F.lit(r"^\p{Lu}")), F.array(F.regexp_extract(p, aside, 1), F.regexp_extract(p, aside, 2))).otherwise(F.array(F.regexp_extract(p, aside, 1))),
    ).otherwise(F.array(p))
    return F.flatten(F.transform(F.split(name, " (?:ou|alias) "), pair))


def pages_of(text: Column, least: int = 1, most: int = 310) -> Column:
    """The pages of a loose reference, sorted; a range counts if it spans 1 to 9 pages, else only its start."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:\s*-\s*\d{1,3})?)"), F.lit(1))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    high = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*(\d+)$", 1), F.lit("")).cast("int"), low(p))
    each = F.transform(found, lambda p: F.when((high(p) - low(p)).between(1, 9), F.sequence(low(p), high(p))).otherwise(F.array(low(p))))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda p: p.between(least, most))))


def parse_pages(text: Column) -> Column:
    """The pages of a strict list such as "50-52;13", in its order."""
    ends = lambda p: F.split(p, "-")
    each = F.transform(F.split(text, ";"), lambda p: F.sequence(F.get(ends(p), F.lit(0)).cast("int"), F.coalesce(F.get(ends(p), F.lit(1)), F.get(ends(p), F.lit(0))).cast("int")))
    return F.flatten(each)


def page_ref(pages: Column) -> Column:
    """An array of pages as "12-14;49"."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    shown = lambda s: F.concat(s["text"], F.when(s["text"] == "", "").otherwise(";"), s["low"].cast("string"), F.when(s["high"] > s["low"], F.concat(F.lit("-"), s["high"].cast("string"))).otherwise(""))
    step = lambda s, p: F.when(s["low"].isNull(), F.struct(s["text"].alias("text"), p.alias("low"), p.alias("high"))).when(p == s["high"] + 1, F.struct(s["text"].alias("text"), s["low"].alias("low"), p.alias("high"))).otherwise(F.struct(shown(s).alias("text"), p.alias("low"), p.alias("high")))
    return F.aggregate(F.array_sort(F.array_distinct(pages)), start, step, lambda s: F.when(s["low"].isNull(), "").otherwise(shown(s)))


def roman(text: Column) -> Column:
    """The value of a numeral of I, V, X, L, with subtraction."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).otherwise(0)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, c: F.struct((s["sum"] + value(c) - F.when(s["last"] < value(c), 2 * s["last"]).otherwise(0)).alias("sum"), value(c).alias("last"))
    return F.aggregate(F.split(text, ""), start, step, lambda s: s["sum"])


def numeral(text: Column) -> Column:
    """A misread numeral's value, or null."""
    fixed = F.translate(text, "/1l", "III")
    return F.when(fixed.rlike("^[IVXL]+$"), roman(fixed))


def normalize_spaces(text: Column) -> Column:
    """Blanks collapsed; none before , . ) and none after (."""
    text = F.trim(F.regexp_replace(text, "[  \t]+", " "))
    return F.regexp_replace(F.regexp_replace(text, r" +([,.)])", "$1"), r"\( +", "(")


def is_letterspaced(text: Column) -> Column:
    """Whether four or more single characters stand in a row somewhere, each after a space."""
    return text.rlike(r"(?U)(?:\b\w ){3,}\w\b")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def dehyphenate(lines: Column) -> Column:
    """The lines of a paragraph joined. A hyphen at a line's end goes where a word in lower case follows, unless it is a particle, as in "Kerling-" and "lès-Sierck"; blank lines go."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")

    def join(a: Column, b: Column) -> Column:
        word = F.regexp_extract(b, r"^([\p{L}\p{N}_]*)", 1)
        broken = word.rlike(r"^\p{Ll}") & ~word.isin(*PARTICLES)
        hyphen = a.endswith("-") & ~a.endswith(" -")
        return F.when(a == "", b).when(hyphen & broken, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).when(hyphen, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    return normalize_spaces(F.aggregate(full, F.lit(""), join))


def strip_lines(lines: Column, prefixes: tuple[str, ...]) -> Column:
    """Lines that don't start with any of the prefixes."""
    return F.filter(lines, lambda x: ~F.array_contains(F.array(*[F.startswith(x, F.lit(p)) for p in prefixes]), True)) if prefixes else lines


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_pages(entry: Column) -> Column:
    """struct(text, pages): an index entry's text and its trailing list of pages; an entry of pages alone, or without any digit at its end, is all text."""
    none = lambda e: F.struct(strip(e).alias("text"), F.lit("").alias("pages"))

    def parted(entry: Column) -> Column:
        return let(F.struct(entry.alias("all"), F.regexp_replace(entry, r"[0-9 ,.;-]*$", "").alias("head")), lambda x: let(
            F.struct(x["all"].alias("all"), x["head"].alias("head"), F.substring(x["all"], F.length(x["head"]) + 1, F.length(x["all"])).alias("tail")),
            lambda y: F.when((y["head"] != "") & y["tail"].rlike("[0-9]"), F.struct(F.regexp_replace(y["head"], "^[ ,]+|[ ,]+$", "").alias("text"), y["tail"].alias("pages"))).otherwise(none(y["all"])),
        ))

    return parted(entry)


def index_pages(text: Column) -> Column:
    """The pages of an index entry, in order; a range that runs backwards is its first page."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:\s*-\s*\d{1,3})?)"), F.lit(1))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    high = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*(\d+)$", 1), F.lit("")).cast("int"), low(p))
    return F.flatten(F.transform(found, lambda p: F.sequence(low(p), F.greatest(low(p), high(p)))))


def label(labels: Column, lang: str, key: Column) -> Column:
    """A label in a language, else in English, else the key. labels: map."""
    return F.coalesce(F.try_element_at(labels, F.lit(lang)), F.try_element_at(labels, F.lit("en")), key)


def name(names: Column, lang: str, key: Column) -> Column:
    """A name in a language, else in French, English, German, else the id."""
    return F.coalesce(*[F.try_element_at(names, F.lit(x)) for x in (lang, "fr", "en", "de")], key)


def title_of(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("-"), F.lit(" ")))


#: The kinds that ids of holders begin with; words before a place's name that tell its kind; particles after which a place's name only says where it lies.
HOLDER_KINDS = ("house", "county", "lords", "family", "abbey", "duchy", "chapter", "convent", "priory", "baron", "barons")
PLACE_WORDS = ("bourg", "château", "chateau", "village", "cense", "ville", "abbaye", "prieuré", "faubourg")
WHERE_PARTICLES = ("-l[eè]s-", " près de ", " proche ", " lez ", " sur ", " alias ", " ou ")


def entity_stem(key: Column) -> Column:
    """An entity's id without the word for its kind."""
    return F.regexp_replace(key, f"^(?:{'|'.join(HOLDER_KINDS)})-", "")


def cell(value: Column, kind: str) -> Column:
    """A value as a table cell: null is empty, true is "true", false empty, lists sorted and joined."""
    if kind == "boolean":
        return F.when(value, "true").otherwise("")
    if kind.startswith("array"):
        return F.coalesce(F.array_join(F.array_sort(value.cast("array<string>")), "|"), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def list_cell(text: Column) -> Column:
    """A cell of parts between bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def request_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def price(inputs: Column, outputs: Column, rate_in: float, rate_out: float, batch: Column) -> Column:
    """The cost of a request, half in a batch; rates are for a million tokens."""
    return (inputs * rate_in + outputs * rate_out) / 1e6 * F.when(batch, 0.5).otherwise(1.0)


def name_variants(text: Column) -> Column:
    """Spellings to look a settlement up by, of 3 letters at least: without the word for its kind, each of its alternatives, those without what follows a particle, and the forms of Saint."""
    plain = strip(F.regexp_replace(text, f"(?i)^(?:{'|'.join(PLACE_WORDS)}) (?:de |d')", ""))
    parts = F.transform(F.split(plain, r"\s+(?:alias|ou)\s+"), strip)
    short = F.transform(parts, lambda p: strip(F.regexp_replace(p, rf"(?i)\s*(?:{'|'.join(WHERE_PARTICLES)}).*$", "")))
    every = F.array_distinct(F.concat(F.array(text, plain), parts, short))
    saint = r"^(?:Saint|Sankt|St\.?)[- ](.+)$"
    forms = F.flatten(F.transform(F.filter(every, lambda p: p.rlike(saint)), lambda p: F.transform(F.array(F.lit("Saint-"), F.lit("Sankt "), F.lit("St. ")), lambda f: F.concat(f, F.regexp_extract(p, saint, 1)))))
    return F.filter(F.array_distinct(F.concat(every, forms)), lambda p: F.length(p) >= 3)
