"""Entities and sections in paper text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.columns import bound, col

# Identifier patterns and cluster aliases.
GAIA = r"(?i)\bGaia(?:\s+DR[23])?(?:\s+source(?:\s*id)?)?\s+(\d{18,20})\b"
STRICT = (
    r"(?i)\b(HD\s*\d{1,6})\b", r"(?i)\b(HIP\s*\d{1,6})\b", r"(?i)\b(TYC\s*\d{4}-\d{1,5}-\d)\b", r"(?i)\b(2MASS\s+J\d{6,8}[+-]\d{6,8})\b",
    r"(?i)\b(HR\s*\d{1,5})\b", r"(?i)\b(TIC\s*\d{1,10})\b", r"(?i)\b(GJ\s*\d{1,4}[A-Z]?)\b", r"(?i)\b(LHS\s*\d{1,5})\b",
)
LOOSE = (
    r"(?i)\b((?:HD|HIP|HR|TIC|TYC|GJ|GL|LHS|LSPM)\s*[A-Z0-9.+\-]+)\b", r"(?i)\b(2MASS\s+J\d{6,8}[+-]\d{6,8})\b",
    r"(?i)\b(BD[+\-]\d{1,2}\s+\d+[A-Z]?)\b", r"(?i)\b(CD[+\-]\d{1,2}\s+\d+[A-Z]?)\b",
)
CLUSTERS = {
    "hyades": ("hyades", "melotte 25", "collinder 50", "cr 50"),
    "pleiades": ("pleiades", "melotte 45", "m45", "seven sisters", "ngc 1432"),
    "orion ob1": ("orion ob1", "orion ob", "orion association", "orion moving group"),
    "coma berenices": ("coma berenices", "coma ber", "melotte 111", "ngc 5024", "ngc 5053"),
    "praesepe": ("praesepe", "m44", "ngc 2632", "beehive cluster", "melotte 121"),
    "ngc 2516": ("ngc 2516", "ngc2516", "spotted cluster"),
    "alpha per": ("alpha per", "alpha persei", "ngc 7092", "m34"),
    "ic 2391": ("ic 2391", "ic2391", "omicron velorum cluster", "sharpless 308"),
    "lmc": ("lmc", "large magellanic cloud", "nubecula major", "ngc 292"),
    "smc": ("smc", "small magellanic cloud", "nubecula minor", "ngc 292"),
    "omega centauri": ("omega centauri", "ngc 5139", "omega cen", "ω cen"),
    "galactic center": ("galactic center", "sagittarius a*", "sgr a*", "galactic centre"),
}
PHENOMENA = {
    "binary": ("binary", "double star", "companion", "orbit", "spectroscopic"),
    "young": ("young", "yso", "t tauri", "pre-main sequence", "protostar", "cluster member"),
    "high_motion": ("high proper motion", "runaway", "hypervelocity", "nearby"),
}


#: A component's mark at the end of an identifier, set off from it.
COMPONENT = r"(?<!\w)[ _-]?(?:[ABCabc][1-6]?|[IVX]+|[1-6])$"


def distinct_in_order(items, key=lambda x: x) -> Column:
    """First occurrences, told apart by ``key``."""
    firsts = lambda found, keys: F.filter(found, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return bound(items, lambda found: bound(F.transform(found, key), lambda keys: firsts(found, keys)))


def gaia_ids(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(GAIA), 1))


def gaia_ids_near(text, window: int = 200) -> Column:
    """Prefixed ids, then bare long numbers that start less than ``window`` characters from a mention of Gaia."""
    t = col(text)
    numbers = F.arrays_zip(_starts(t, r"\b\d{18,20}\b").alias("at"), F.regexp_extract_all(t, F.lit(r"\b(\d{18,20})\b"), 1).alias("id"))
    near = lambda found: bound(_starts(t, r"(?i)\bGaia\b"), lambda mentions: F.filter(found, lambda n: F.exists(mentions, lambda m: F.abs(m - n["at"]) < window)))
    some = bound(numbers, lambda found: F.when(F.size(found) > 0, near(found)).otherwise(found))
    return F.array_distinct(F.concat(gaia_ids(t), F.transform(some, lambda n: n["id"])))


def _starts(text: Column, pattern: str) -> Column:
    """Where matches begin: the text between matches is split off, and lengths add up."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), 1)
    both = F.zip_with(matches, F.split(text, pattern), lambda m, part: F.struct(F.coalesce(F.length(part), F.lit(0)).alias("before"), F.length(m).alias("own")))
    ends = lambda found: F.aggregate(found, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x["before"] + x["own"])))
    starts = lambda found: bound(ends(found), lambda end: F.transform(found, lambda x, i: F.get(end, i) + x["before"]))
    return bound(F.filter(both, lambda x: x["own"].isNotNull()), starts)


def catalog_ids(text, patterns=STRICT) -> Column:
    """Catalog identifiers, spaces and case aside each once, pattern by pattern."""
    found = F.concat(*(F.regexp_extract_all(col(text), F.lit(p), 1) for p in patterns))
    return distinct_in_order(F.transform(found, lambda x: F.trim(x)), lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))))


def star_names(text, names: list[str], k: int = 12) -> Column:
    """Loose identifiers and common names (a parameter, in its order); none in texts under eight characters."""
    t = col(text)
    # A pattern of its own for each name, which is compiled once.
    common = F.array_compact(F.array(*(F.when(F.rlike(t, F.lit(rf"(?i)\b\Q{n}\E\b")), F.lit(n)) for n in names if n is not None), F.lit(None).cast("string")))
    found = distinct_in_order(F.concat(catalog_ids(t, LOOSE), common), lambda x: F.upper(x))
    return F.when(F.length(F.trim(t)) >= 8, F.slice(found, 1, k)).otherwise(F.array().cast("array<string>"))


def cluster_mentions(text) -> Column:
    """Canonical cluster names by the place of their first alias in the text."""

    def first(low: Column, name: str, aliases: tuple) -> Column:
        # Most aliases stand nowhere, which contains tells many times faster than instr.
        at = F.array_min(F.array(*(F.when(F.contains(low, F.lit(a)), F.instr(low, a)) for a in aliases), F.lit(None).cast("int")))
        return bound(at, lambda i: F.when(i.isNotNull(), F.struct(i.alias("at"), F.lit(name).alias("name"))))

    hits = bound(F.lower(col(text)), lambda low: F.array_sort(F.array_compact(F.array(*(first(low, name, aliases) for name, aliases in CLUSTERS.items())))))
    return F.transform(hits, lambda h: h["name"])


def mentions(text, phenomenon: str) -> Column:
    low = F.lower(col(text))
    test = F.lit(False)
    for word in PHENOMENA[phenomenon]:
        test = test | low.contains(word)
    return test


def arxiv_id(text, file_name) -> Column:
    found = F.regexp_extract(F.substring(col(text), 1, 5000), r"arXiv:(\d{4}\.\d{4,5})", 1)
    return F.when(found != "", found).otherwise(col(file_name))


def extract_abstract(text) -> Column:
    return F.left(F.trim(F.regexp_extract(col(text), r"(?is)abstract[:\s]+(.*?)(?=\n\s*\n|introduction|keywords|$)", 1)), F.lit(2000))


def title_line(text) -> Column:
    """The first line over 20 characters that begins in upper case, in the first 500 characters."""
    lines = F.filter(F.transform(F.split(F.left(col(text), F.lit(500)), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & x.rlike("^[A-Z]"))
    return F.get(lines, 0)


def preview(text, n: int = 200) -> Column:
    return F.left(col(text), F.lit(n))


def route(text) -> Column:
    """Struct of what a free-text request asks for: a cone, a star or papers, with its parameters."""
    t = col(text)
    number = lambda key: F.regexp_extract(t, rf"(?i)\b{key}\s*=\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
    ident = F.regexp_extract(t, r"(?i)\bid\s*=\s*(\w+)", 1)
    ra, dec = number("ra"), number("dec")
    kind = F.when(ra.isNotNull() & dec.isNotNull(), "cone").when(ident != "", "lookup").when(t.rlike(r"(?i)\b(papers?|articles?|literature|arxiv)\b"), "papers").otherwise("none")
    return F.struct(kind.alias("kind"), ra.alias("ra"), dec.alias("dec"), F.when(ident != "", ident).alias("source_id"))
