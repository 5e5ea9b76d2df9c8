"""The static analyzer: parse, detect, suppress, collapse, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.lang import detectors, suppression
from lodestone.lang.ir import Program, program
from lodestone.operators.findings import collapse_by_subject, ranked


@dataclass
class Analysis:
    """Ranked findings, what was withheld and why, diagnostics, and the relations behind them."""

    findings: DataFrame
    suppressed: DataFrame
    diagnostics: DataFrame
    program: Program


def analyze(files: DataFrame) -> Analysis:
    """Analyze all programs of files (program, path, text) in one job; ``program`` keeps them apart."""
    p = program(files)
    kept, dropped = suppression.apply(p, detectors.run(p))
    # the file is one of the keys that findings collapse by, so a program's name goes with it
    apart = kept.withColumn("file", F.struct("program", "file")).drop("program", "account", "struct")
    whole = collapse_by_subject(apart).withColumn("program", F.col("file.program")).withColumn("file", F.col("file.file"))
    return Analysis(ranked(whole, ("subject", "program", "file")), dropped, p.diagnostics, p)
