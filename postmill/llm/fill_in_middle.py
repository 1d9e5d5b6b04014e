"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar says between which neighbouring character classes a text is cut. It is translated to a
zero-width regex, (?<=[left])(?=[right]), so that Spark's split gives the units back whole, white space
included, and joining them gives the text. Two of the unit borders, drawn from a digest of the id, part
the text into prefix, middle and suffix, which are put in another order behind sentinels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

#: The white space that parts words, as the inside of a character class.
BLANK = r"\x20\x09-\x0D"
#: Unit grammars: (left class, right class) of the neighbours that a border stands between.
GRAMMARS = {
    "word": [(f"[^{BLANK}]", f"[{BLANK}]")],  # white space belongs to the word behind it; what ends the text is a unit
    "line": [(r"\n", r"[\s\S]")],  # a line break ends its line
    "sentence": [(r"[.!?]", f"[{BLANK}]"), ("[。！？]", "[^。！？]")],
    "character": [(r"[\s\S]", r"[\s\S]")],
}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def each(self) -> list[str]:
        return [self.prefix, self.suffix, self.middle]


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width regex of all places where one of the grammar's left classes meets its right class.

    A place inside a surrogate pair is no border."""
    return "(?:" + "|".join(f"(?<={left})(?={right})" for left, right in grammar) + ")(?<![\\uD800-\\uDBFF](?=[\\uDC00-\\uDFFF]))"


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of a text, in order; none for the empty text, of which split would give one empty piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first digit groups of the hex SHA-256 of seed:id (a null id: nothing behind the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def restored(output: Column, form: Column, marks: Sentinels) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks.each()), -1)
    back = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(back)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | list[tuple[str, str]] = "word", rate: int = 50, spm_rate: int = 80, seed: int = 42, marks: Sentinels = Sentinels()
) -> DataFrame:
    """docs with fim_units, fim_form (plain, psm or spm), fim_prefix, fim_middle, fim_suffix and fim_output.

    `unit` names a grammar or is one. A text becomes psm or spm in `rate` of 100 cases, spm in `spm_rate` of
    100 of these; a null text counts as empty; an empty text, or one that holds a sentinel, stays plain, and
    then prefix, middle and suffix are null. Rows that repeat an id draw the same numbers and are treated
    each by itself; an empty table gives an empty result. Columns of docs that are named like the new ones
    are replaced. Nothing is shuffled."""
    grammar = GRAMMARS[unit] if isinstance(unit, str) else unit
    names = [free_name(docs, n) for n in ("fim_source", "fim_pieces", "fim_draws", "fim_cuts")]
    text, pieces, drawn, cuts = (F.col(n) for n in names)
    held = F.lit(False)
    for mark in marks.each():
        held = held | F.contains(text, F.lit(mark))
    n = F.size(pieces)
    a, b = (drawn[i] % (n + 1) for i in (0, 1))
    plain = (text == "") | held | (drawn[2] % 100 >= rate)
    part = lambda start, length: F.when(F.col("fim_form") != "plain", F.array_join(F.slice(pieces, start, length), ""))
    p, m, s = (F.col(f"fim_{x}") for x in ("prefix", "middle", "suffix"))
    mark = [F.lit(x) for x in marks.each()]
    return (
        docs.withColumn(names[0], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        .withColumns({names[1]: units(text, grammar), names[2]: F.array(*draws(F.col(id_col), seed))})
        .withColumns({"fim_units": n.cast("bigint"), names[3]: F.array(F.least(a, b), F.greatest(a, b)).cast("array<int>"), "fim_form": F.when(plain, "plain").when(drawn[3] % 100 < spm_rate, "spm").otherwise("psm")})
        .withColumns({"fim_prefix": part(F.lit(1), cuts[0]), "fim_middle": part(cuts[0] + 1, cuts[1] - cuts[0]), "fim_suffix": part(cuts[1] + 1, n - cuts[1])})
        .withColumn("fim_output", F.when(F.col("fim_form") == "plain", text).when(F.col("fim_form") == "psm", F.concat(mark[0], p, mark[1], s, mark[2], m)).otherwise(F.concat(mark[1], s, mark[0], p, mark[2], m)))
        .drop(*names)
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in fill-in-the-middle form: its units, form, lengths and digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.length("fim_prefix").cast("bigint").alias("prefix_chars"), F.length("fim_middle").cast("bigint").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form"), Sentinels()), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), n AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS h FROM d
), f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
