"""Text functions as Column expressions; regexes are Unicode-aware where letters matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote marks, apostrophes and look-alikes that normalisation folds.
QUOTES = "«»\"“”„‹›"
APOSTROPHES = "’`´ʼ"
ARTICLE = r"(?iU)\b(?:статт\w*|ст)\.?\s*(\d+(?:-\d+)?)"
ARTICLE_IN_PROSE = r"(?iU)(?:статт\w*|ст)\.?\s*(\d+(?:-\d+)?)"
INTERNAL_WORDS = {
    "candidate": r"(?iU)\bcandidates?\b",
    "cid": r"\bC\d+\b",
    "retrieval": r"(?iU)\bretrieval\b",
    "кандидат": r"(?iu)кандидат",
    "промпт": r"(?iu)промпт",
}


def norm(text: Column) -> Column:
    """Lower case, quotes to blanks, apostrophes to one form, white space collapsed and trimmed."""
    folded = F.translate(F.translate(F.lower(text), QUOTES, " " * len(QUOTES)), APOSTROPHES, "'" * len(APOSTROPHES))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def canon(text: Column) -> Column:
    """Typographic variants to one form, case kept."""
    return F.translate(text, "’‘ʼ`´“”„   ", "'''''\"\"\"   ")


def clean(text: Column) -> Column:
    """Text without {marker} spans: lines right-trimmed, blank lines dropped, typography canonical."""
    lines = F.transform(F.split(F.regexp_replace(text, r"(?s)\{[^{}]*\}", ""), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return canon(F.trim(F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")))


def markers(text: Column) -> Column:
    """The innermost {marker} spans, white space collapsed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(\{[^{}]*\})"), 1), lambda m: canon(F.trim(F.regexp_replace(m, r"\s+", " "))))


def article_refs(text: Column, bounded: bool = True) -> Column:
    """Article numbers named in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ARTICLE if bounded else ARTICLE_IN_PROSE), 1)


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased; a dash separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def html_text(html: Column) -> Column:
    """Script and style dropped, tags to blanks, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def html_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def prose(text: Column) -> Column:
    """Prose fit to show: internal ids removed, blanks collapsed, loose punctuation at the ends cut."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bC\d+\b", ""), r"\s{2,}", " "), r"^[ ,;]+|[ ,;]+$", "")


def internal_words(text: Column) -> Column:
    """Names, sorted, of the internal vocabulary that a text shows."""
    return F.array_sort(F.filter(F.array(*[F.when(text.rlike(rx), F.lit(name)) for name, rx in INTERNAL_WORDS.items()]), lambda x: x.isNotNull()))


def natural_key(text: Column, width: int = 12) -> Column:
    """A key whose plain order is the natural order: digit runs padded with zeros."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, width, "0")).otherwise(r)), "")


def stem(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def section_number(token: Column) -> Column:
    """Roman section numbers: Cyrillic look-alikes folded in a wholly Roman token, a hyphen before trailing digits."""
    roman = F.when(token.rlike(r"^[IVXLCDMІХСМ]+(?:-?\d+)?$"), F.translate(token, "ІХСМ", "IXCM")).otherwise(token)
    return F.regexp_replace(roman, r"^([IVXLCDM]+)-?(\d+)$", "$1-$2")


def relative(path: Column, root: str) -> Column:
    """A path below root without it; any other path as it is."""
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def act_citation(title: Column, citation: Column) -> Column:
    """The act's title before a citation, unless it is there already."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(citation, F.lit("")))
    return F.when(t == "", c).when(c == "", t).when(F.contains(c, t), c).otherwise(F.concat(t, F.lit(", "), c))


def citation(path: Column, edition: Column, block_title: Column) -> Column:
    """A unit's path and edition date as a citation; a numbered level is a part under an article and a point elsewhere."""
    segments = F.split(path, "/")

    def one(seg: Column, i: Column) -> Column:
        tag, num = F.regexp_extract(seg, r"^(розд|гл|ст|п|дод|затв)\.(.+)$", 1), F.regexp_extract(seg, r"^(розд|гл|ст|п|дод|затв)\.(.+)$", 2)
        under = F.when(i > 0, F.get(segments, i - 1))
        return (
            F.when(tag == "", seg)
            .when(tag == "п", F.concat(F.when(under.rlike(r"^ст\.."), "ч. ").otherwise("п. "), num))
            .when(tag == "затв", F.when(F.coalesce(block_title, F.lit("")) != "", F.concat(block_title, F.lit(" (затв. "), num, F.lit(")"))).otherwise(F.concat(F.lit("затв. "), num)))
            .when(tag == "дод", F.concat(F.lit("додаток "), num))
            .otherwise(F.concat(tag, F.lit(". "), num))
        )

    return F.concat(F.array_join(F.transform(segments, one), " "), F.lit(" · ред. від "), F.date_format(edition, "dd.MM.yyyy"))
