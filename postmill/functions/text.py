"""Text functions: unknown values, normal forms, lines, sentences, vocabulary tags, HTML text."""

from __future__ import annotations

import re
import unicodedata
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that mean "unknown" (fixed values).
UNKNOWN = ["未知", "待核实", "未披露", "unknown", "n/a", "null"]
TEXT_LIMIT = 100_000


def known(col: Column) -> Column:
    """Neither null nor blank nor one of the words for unknown."""
    plain = F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))
    return (plain != "") & ~plain.isin(UNKNOWN)


def known_or_null(col: Column) -> Column:
    return F.when(known(col), col)


def narrow(col: Column) -> Column:
    """Full-width ASCII forms and the wide space as plain ASCII: the part of NFKC that pay ranges need, natively."""
    wide, plain = "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " "
    return F.translate(col, wide, plain)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: "" if x is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", x).casefold()))


def normal_form(col: Column, exact: bool = True) -> Column:
    """NFKC, case-folded, without white space. exact=False is native and right for ASCII text."""
    return _fold(col) if exact else F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", ""))


def lines(col: Column) -> Column:
    """The lines of a text, whatever the line ends; nothing after the last one."""
    parts = F.split(F.coalesce(col, F.lit("")), "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def sentences(col: Column) -> Column:
    """Parts between line ends and full stops or semicolons, without bullets; blank ones dropped."""
    parts = F.split(F.coalesce(col, F.lit("")), r"[\n。；;]+")
    return F.filter(F.transform(F.filter(parts, lambda x: F.regexp_replace(x, r"(?U)\s+", "") != ""), lambda x: F.regexp_replace(x, r"^[ •\-\t]+|[ •\-\t]+$", "")), lambda x: x.isNotNull())


def mentions(text: Column, term: str) -> Column:
    """A term of ASCII letters must not touch other letters; any other term is a plain substring. Case is ignored."""
    if re.fullmatch(r"[a-zA-Z]+", term):
        return text.rlike(f"(?i)(?<![a-zA-Z]){re.escape(term)}(?![a-zA-Z])")
    return F.lower(text).contains(term.lower())


def mentions_any(text: Column, terms: list[str]) -> Column:
    """One pattern for all terms of letters, and one substring test for each other term."""
    letters = [t for t in terms if re.fullmatch(r"[a-zA-Z]+", t)]
    tests = [F.lower(text).contains(t.lower()) for t in terms if t not in letters]
    if letters:
        tests.append(text.rlike(f"(?i)(?<![a-zA-Z])(?:{'|'.join(map(re.escape, letters))})(?![a-zA-Z])"))
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def bound(value: Column, f) -> Column:
    """f(value), with the value taken once: an expression that a lambda names is otherwise taken again for each element."""
    return F.transform(F.array(value), f)[0]


def tags(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The tags of which any term is mentioned, in the vocabulary's order; terms of letters are all found in one pass."""
    text = F.coalesce(text, F.lit(""))
    letters = {t: bool(re.fullmatch(r"[a-zA-Z]+", t)) for terms in vocabulary.values() for t in terms}
    words = sorted({t.lower() for t, plain in letters.items() if plain})
    pattern = f"(?i)(?<![a-zA-Z])({'|'.join(words)})(?![a-zA-Z])"
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), F.lower)) if words else F.array().cast("array<string>")

    def of(x: Column) -> Column:
        each = []
        for tag, terms in vocabulary.items():
            own = [t.lower() for t in terms if letters[t]]
            test = F.arrays_overlap(x["found"], F.array(*map(F.lit, own))) if own else F.lit(False)
            for t in terms:
                test = test if letters[t] else test | x["low"].contains(t.lower())
            each.append(F.when(test, F.lit(tag)))
        return F.array_compact(F.array(*each))

    return bound(F.struct(found.alias("found"), F.lower(text).alias("low")), of)


def quote_for(text: Column, terms: list[str]) -> Column:
    """The first sentence that mentions a term, else ''."""
    return F.coalesce(F.try_element_at(F.filter(sentences(text), lambda s: mentions_any(s, terms)), F.lit(1)), F.lit(""))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?%?)"), 1)


def join_cjk(col: Column) -> Column:
    """White space between two CJK characters goes."""
    return F.regexp_replace(col, r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", "")


def repair_dash(col: Column) -> Column:
    """A Chinese one read for a dash between two amounts."""
    return F.regexp_replace(col, r"(?<=\d)\s*一\s*(?=\d+(?:\.\d+)?\s*[kK万千])", "-")


def escape_html(col: Column) -> Column:
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for plain, coded in (("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


class _Text(HTMLParser):
    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.parts = skip, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.skip))

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def visible_text(markup: str | None, skip: tuple[str, ...] = ("script", "style", "nav", "footer", "header")) -> str:
    if not markup:
        return ""
    parser = _Text(frozenset(skip))
    parser.feed(markup)
    parser.close()
    return "\n".join(parser.parts)[:TEXT_LIMIT]


@F.pandas_udf(StringType())
def html_text(markup: pd.Series) -> pd.Series:
    """Visible text of a page: one line for each text node, without scripts, styles and page furniture."""
    return markup.map(visible_text)


@F.pandas_udf(StringType())
def field_text(value: pd.Series) -> pd.Series:
    """Text of a field that may hold entities or markup."""

    def one(x):
        x = unescape(x or "")
        return visible_text(x, ("script", "style")) if "<" in x else x.strip()[:TEXT_LIMIT]

    return value.map(one)
