"""Scans: tables, segments of texts, lines and blocks of pages, dictionary tables, state files, portfolio members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("seg", T.IntegerType()), T.StructField("text", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(docs: DataFrame, id_: str = "doc_id", *keep: str) -> DataFrame:
    """One row for each line of a text: (doc, seg, text, kept columns). Null texts have no segment."""
    return docs.select(F.col(id_).alias("doc"), *keep, F.posexplode(F.split("text", "\n", -1)).alias("seg", "text"))


def carry_section(lines: DataFrame, mark: str = "## ") -> DataFrame:
    """Give each line of (doc, seg, text) the last heading above it within its document; the headings themselves go."""
    w = Window.partitionBy("doc").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.startswith(F.col("text"), F.lit(mark)), F.trim(F.substring("text", len(mark) + 1, 2**30)))
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where(heading.isNull())


def markdown_entries(lines: DataFrame, flip: bool = False) -> DataFrame:
    """Rows ``| term | translation | note |`` of (doc, seg, text) with their section; rules and header rows are left out.

    ``flip`` swaps the two term columns, for a table of the reversed language pair.
    """
    cells = F.transform(F.split(F.trim(F.col("text"), F.lit(" |")), r"\s*\|\s*"), lambda x: F.trim(x))
    rows = carry_section(lines).where(F.startswith(F.ltrim("text"), F.lit("|")) & ~F.col("text").rlike(r"^[\s|:-]+$"))
    rows = rows.withColumn("cells", cells).withColumn("first", F.row_number().over(Window.partitionBy("doc", "section").orderBy("seg")))
    a, b = F.get("cells", 0), F.get("cells", 1)
    return rows.where("first > 1").select("doc", "section", (b if flip else a).alias("src"), (a if flip else b).alias("tgt"), F.coalesce(F.get("cells", 2), F.lit("")).alias("note"))


def state_files(spark: SparkSession, path: str) -> DataFrame:
    """Document states ``*.json`` of a folder without the backups made before a review."""
    rows = spark.read.option("multiLine", True).json(f"{path}/*.json")
    return rows.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(~F.endswith("file_name", F.lit(".before_review.json")))


def cached_answers(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an answer cache; unreadable ones and blank texts are misses."""
    schema = "key string, text string, usage string, sec double, finish string, broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.where("broken is null and trim(coalesce(text, '')) <> ''").drop("broken")


def tesseract_words(spark: SparkSession, path: str, dpi: int = 300) -> DataFrame:
    """Word rows (level 5, not blank) of recognition tables, boxes in points."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    pt = lambda c: F.col(c).cast("double") * 72 / dpi
    return rows.where("level = 5 and trim(coalesce(text, '')) <> ''").select(
        "page_num", "line_num", "text", pt("left").alias("x0"), pt("top").alias("y0"), (pt("left") + pt("width")).alias("x1"), (pt("top") + pt("height")).alias("y1"), F.col("conf").cast("double").alias("conf")
    )


def office_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of .docx files given as ``binaryFile`` rows: (path, part, p, text), runs joined, empty ones left out."""

    def run(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    parts = [n for n in sorted(z.namelist()) if n.startswith("word/") and n.endswith(".xml") and any(k in n for k in ("document", "header", "footer", "footnotes", "endnotes"))]
                    for part in parts:
                        for p, e in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{w}p")):
                            text = "".join("\t" if r.tag == f"{w}tab" else "\n" if r.tag == f"{w}br" else r.text or "" for r in e.iter() if r.tag in (f"{w}t", f"{w}tab", f"{w}br"))
                            if text.strip():
                                out.append((path, part, p, text))
            yield pd.DataFrame(out, columns=["path", "part", "p", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, p int, text string")


def page_lines(pages: DataFrame) -> DataFrame:
    """Texts between tags of a page, in order: (page, pos, text)."""
    parts = F.transform(F.split("html", "<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, "[ \t\r\n]+", " ")))
    return pages.select(F.col("page_id").alias("page"), F.posexplode(F.filter(parts, lambda x: x != "")).alias("pos", "text"))


def unprocessed(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Idempotent re-run: inputs without a state."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
