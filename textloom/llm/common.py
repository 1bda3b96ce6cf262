"""What the operators share: shipping the package, sizes of Arrow batches, word splitting.

Words are runs of bytes other than ASCII white space (0x09-0x0D and 0x20) after lower-casing A-Z only;
``bytes.lower`` and ``bytes.split`` do precisely that on UTF-8.
"""

from __future__ import annotations

import logging
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.scratch import scratch_path, stored

__all__ = ["crc_mod", "n_partitions", "prepare", "scratch_path", "stored", "table", "words_of"]


log = logging.getLogger("textloom")
#: Batches end at so many bytes or rows, whichever comes first, so a worker's memory does not follow the length of texts.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": 32 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 512}


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once, and bound the session's Arrow batches by ARROW_LIMITS.

    The limits are settings of the session (a plan takes them up when it runs): smaller ones are left, larger ones are lowered and
    the change is logged. Set smaller ones beforehand to keep them.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_textloom_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(top):
            out = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom_code.zip")
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for folder, _, names in os.walk(top):
                    for n in sorted(names):
                        if n.endswith(".py"):
                            full = os.path.join(folder, n)
                            z.write(full, os.path.join("textloom", os.path.relpath(full, top)))
            sc.addPyFile(out)
        sc._textloom_shipped = True
    for name, most in ARROW_LIMITS.items():
        now = spark.conf.get(name)
        if not 0 < int(now.rstrip("b")) <= most:
            log.info("%s of this session is set from %s to %s", name, now, most)
            spark.conf.set(name, str(most))


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_mod(col: str, k: int):
    """crc32 of the id as text, modulo k; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
