"""Fill-in-the-middle: texts cut into prefix, middle and suffix, put into another order between sentinels.

A text's units are words with the white space before them (white space at the end is a unit of its own), so they
join to the text. The cuts and the form come from the SHA-256 of a seed and the document's id: the same
in every run, and independent of the partitioning. In the form psm the pieces follow each other as prefix, suffix,
middle, in spm as suffix, prefix, middle; a plain text stays as it is. restored() parses the sentinels, which
stand in no text that is transformed, and puts the pieces back.

All of it is DataFrame functions in one narrow pass: no shuffle, no Python, memory of one text.

Defined results: null texts are empty, and empty texts are plain with 0 units; texts with a sentinel of
their own are plain; a null id is hashed as the empty string; equal rows get equal rows; other columns, whatever their
names, are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import SPACE

UNIT = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"


class Sentinels(NamedTuple):
    """Marks before the three pieces; none may be a part of another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers out of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _has_mark(text: Column, marks: Sentinels) -> Column:
    return F.contains(text, F.lit(marks.prefix)) | F.contains(text, F.lit(marks.suffix)) | F.contains(text, F.lit(marks.middle))


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Sentinels = Sentinels()) -> DataFrame:
    """One row per row of docs: (doc_id, text, n, form, prefix, middle, suffix, output).

    percent of the texts are transformed, spm_percent of these into the form spm. The pieces are null for plain texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", units(F.col("text")).alias("u"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    rows = rows.select("*", F.size("u").alias("n"))
    plain = (F.col("text") == "") | _has_mark(F.col("text"), marks) | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.select("doc_id", "text", "u", "n", form.alias("form"), F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("u", start, length), ""))
    pieces = [piece(F.lit(1), F.col("a")).alias("prefix"), piece(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), piece(F.col("b") + 1, F.col("n") - F.col("b")).alias("suffix")]
    rows = rows.select("doc_id", "text", F.col("n").cast("bigint").alias("n"), "form", *pieces)
    psm = F.concat(F.lit(marks.prefix), "prefix", F.lit(marks.suffix), "suffix", F.lit(marks.middle), "middle")
    spm = F.concat(F.lit(marks.suffix), "suffix", F.lit(marks.prefix), "prefix", F.lit(marks.middle), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm))


def _between(text: Column, left: str, right: str | None) -> Column:
    """What stands after the first `left`, up to the next `right` or the end."""
    tail = F.substring(text, F.locate(left, text) + len(left), F.length(text))
    return tail if right is None else F.substring(tail, F.lit(1), F.locate(right, tail) - 1)


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that output was made of: its sentinels are found and its pieces put back into order."""
    middle = _between(output, marks.middle, None)
    psm = F.concat(_between(output, marks.prefix, marks.suffix), middle, _between(output, marks.suffix, marks.middle))
    spm = F.concat(_between(output, marks.prefix, marks.middle), middle, _between(output, marks.suffix, marks.prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infill_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row."""
    rows = infilled(docs, id_col, text_col, seed, percent, spm_percent)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
