"""Text cleaning, tokens and ids as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The space characters that are squeezed, and the marks that end a sentence.
BLANKS = "[ \\t\\u00a0]+"
SENTENCE_END = "[。！？!?；;.\\n]"


def strip(text: Column) -> Column:
    """Removes white space of any script from both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+\z", "")


def clean_text(text: Column) -> Column:
    """Line ends as LF, runs of blanks as one space, three or more line ends as two, stripped. Null stays null."""
    lines = F.regexp_replace(text, "\\r\\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, BLANKS, " "), "\\n{3,}", "\n\n"))


def plausibility(text: Column) -> Column:
    """Share of characters that are CJK, CJK marks, full-width forms or ASCII; an empty text has 0."""
    kept = F.regexp_replace(text, "[^\\u4e00-\\u9fff\\u3000-\\u303f\\uff00-\\uff65\\u0000-\\u007f]", "")
    return F.when(F.length(text) > 0, F.length(kept) / F.length(text)).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """`[a-z0-9]+` tokens in compatibility form without letter case, with words joined that a hyphen splits over a line end."""
    joined = F.regexp_replace(nfkc(text), "([A-Za-z])-\\s*\\n\\s*([A-Za-z])", "$1$2")
    return F.regexp_extract_all(F.replace(F.lower(joined), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+"), F.lit(0))


def snippet(text: Column, n: int = 220) -> Column:
    """The first n characters of the stripped text on one line."""
    return F.substring(F.replace(strip(text), F.lit("\n"), F.lit(" ")), 1, n)


def markdown_escape(text: Column) -> Column:
    """& < > as entities, a bar escaped, line ends as spaces."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sentences(text: Column) -> Column:
    """Pieces that end after a sentence mark or line end; empty ones are dropped."""
    return F.filter(F.split(text, f"(?<={SENTENCE_END})"), lambda x: x != "")


def collection_name(user: Column, version: Column) -> Column:
    """Name of a tenant's index: plain for blank, baseline and legacy versions, else a slug and eight digest digits."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(version, "[^A-Za-z0-9_-]+", "_"), "^[_-]+|[_-]+$", ""))
    slug = F.substring(F.when(slug == "", "index").otherwise(slug), 1, 32)
    base = F.concat(F.lit("col_user_"), user.cast("string"))
    named = F.concat_ws("_", base, slug, F.substring(F.sha2(version, 256), 1, 8))
    return F.when(F.coalesce(F.trim(version), F.lit("")).isin("", "baseline", "legacy"), base).otherwise(named)


def content_id(prefix: str, **parts: Column) -> Column:
    """prefix and the SHA-256 of the parts as JSON with keys in order, nulls kept."""
    row = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return F.concat(F.lit(prefix), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))


# Characters that NFKC leaves as they are, wherever they stand (ASCII, Latin letters, common marks, kana, CJK).
STABLE = r"[\x00-\x9f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u012f\u0131\u2013\u2014\u2018-\u201e\u20ac\u3001-\u3011\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]"


def _normalised(text: Column, fold: bool) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")
            yield made.map(str.casefold, na_action="ignore") if fold else made

    plain = F.rlike(text, F.lit(rf"\A{STABLE}*+\z"))
    quick = F.replace(F.lower(text), F.lit("ß"), F.lit("ss")) if fold else text
    return F.when(plain, quick).otherwise(run(F.when(~plain, text)))


def nfkc(text: Column) -> Column:
    """Compatibility form. Only texts with other than stable characters leave the JVM."""
    return _normalised(text, False)


def folded(text: Column) -> Column:
    """Compatibility form without letter case."""
    return _normalised(text, True)


def casefolded(text: Column) -> Column:
    """Without letter case, in no other form. Only texts with other than stable characters leave the JVM."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(str.casefold, na_action="ignore")

    plain = F.rlike(text, F.lit(rf"\A{STABLE}*+\z"))
    return F.when(plain, F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).otherwise(run(F.when(~plain, text)))


def any_words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, without letter case."""
    return F.regexp_extract_all(casefolded(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


# Fixed value: numbers with thousands separators and exponents; digits that belong to a name or a longer number are left out.
NUMBER = r"(?<![A-Za-z0-9_.])[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![A-Za-z0-9_.])"


def canonical(number: Column) -> Column:
    """One string for all spellings of a decimal: its digits without zeros at the ends, and the power of ten."""
    bare = F.regexp_replace(number, "[,%+]", "")
    whole = F.regexp_extract(bare, "^-?([0-9]+)", 1)
    part = F.regexp_extract(bare, "^-?[0-9]+\\.([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(bare, "[eE](-?[0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    sign = F.when(F.startswith(bare, F.lit("-")), "-").otherwise("")
    return F.when(short == "", "0").otherwise(F.concat(sign, short, F.lit("e"), (power - F.length(part) + F.length(digits) - F.length(short)).cast("string")))


def numbers(text: Column) -> Column:
    """The distinct numbers of a text in canonical form."""
    return F.array_distinct(F.transform(F.regexp_extract_all(nfkc(text), F.lit(NUMBER), F.lit(0)), canonical))
