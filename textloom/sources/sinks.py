"""Tables written so that a failed or repeated write leaves whole ones, and rows as the lines of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite_documents(rows: DataFrame, path: str, key: str = "doc") -> None:
    """Replace the stored rows of the documents in ``rows``; other documents' stay. Spark's commit swaps each partition whole."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Replace a whole stored table; readers of the new one see all of it or nothing, as the success mark is written last."""
    rows.write.mode("overwrite").parquet(path)


def term_lines(terms: DataFrame) -> DataFrame:
    """Markdown rows of mined terms (doc, ord, line), the most frequent first; ``terms(doc, term, target, sure, n)``."""
    from pyspark.sql import Window

    bar = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("/"))
    mark = F.when(F.col("sure"), "auto").otherwise("auto, UNSURE")
    line = F.concat(F.lit("| "), bar("term"), F.lit(" | "), bar("target"), F.lit(" | "), mark, F.lit("; occurs "), F.col("n").cast("string"), F.lit(" times |"))
    return terms.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "term")).alias("ord"), line.alias("line"))


def edit_journal(edits: DataFrame) -> DataFrame:
    """Rows of the journal sheet: one for each change of a rewrite; ``edits(doc, seg, page, source, was, now, rules)``, rules in order."""
    rows = edits.where(F.col("was") != F.col("now")).select("doc", "seg", "page", F.posexplode("rules").alias("pass", "rule"), "was", "now", "source")
    return rows.select("doc", "seg", F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"), "rule", (F.col("pass") + 1).alias("pass"), "was", "now", "source")


def remaining_violations(checked: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows of the sheet of what is left: ``checked(doc, seg, page, rule, why, text)``; the rule's name stands before the reason."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    told = F.concat(F.coalesce(F.try_element_at(known, F.split_part("rule", F.lit("/"), F.lit(1))), F.lit("")), F.lit(": "), F.col("why"))
    return checked.select("doc", "seg", F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"), "rule", told.alias("why"), "text")
