"""Programs as relations: one parse of all files, and tables cut from it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import compact
from lodestone.lang.lexer import SyntaxProblem
from lodestone.lang.parser import parse
from lodestone.memory import bounded
from lodestone.session import ship, stored

#: Tasks that parse, for each core.
DEALT = 3

_PLACE = "name string, line int, end_line int"
HANDLER = f"{_PLACE}, context_ty string, args array<struct<name:string,ty:string>>, arith array<struct<op:string,line:int,checked:boolean>>, calls array<struct<name:string,line:int,is_cpi:boolean>>, checks array<struct<kind:string,idents:array<string>,text:string,line:int>>, writes array<struct<account:string,line:int>>, sinks array<string>"
ACCOUNTS = f"{_PLACE}, decls array<struct<name:string,wrapper:string,inner_ty:string,boxed:boolean,optional:boolean,line:int,attr_line:int,attr_end_line:int,constraints:array<struct<kind:string,payload:string>>>>"
STATE = f"{_PLACE}, fields array<struct<name:string,ty:string>>"


@dataclass
class Program:
    """The relations of all programs; ``program`` tells them apart."""

    handlers: DataFrame
    structs: DataFrame
    states: DataFrame
    decls: DataFrame
    constraints: DataFrame
    fields: DataFrame
    diagnostics: DataFrame


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for program, path, text in zip(b["program"], b["path"], b["text"]):
            try:
                rows += [(program, path, i, kind, json.dumps(row)) for i, (kind, row) in enumerate(parse(text or ""))]
            except SyntaxProblem as e:
                rows.append((program, path, 0, "problem", json.dumps({"name": str(e)})))
        yield pd.DataFrame(rows, columns=["program", "file", "pos", "kind", "row"])


def _first(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of definitions with one name in a program the first by (file, pos), and the others."""
    first = rows.groupBy("program", "name").agg(F.min(F.struct("file", "pos")).alias("first"))
    marked = rows.join(first, ["program", "name"]).withColumn("own", F.struct("file", "pos"))
    return marked.where("own = first").drop("own", "first"), marked.where("own <> first").drop("own", "first")


def matched(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows with what ``others`` hold under their key; where that is nothing, ``diagnostic`` says that the row is skipped."""
    known = others.withColumn("diagnostic", F.lit(None).cast("string")).withColumn("known", F.lit(True))
    return rows.join(known, key, "left").withColumn("diagnostic", F.when(F.col("known").isNull(), "skipped")).drop("known")


def program(files: DataFrame) -> Program:
    """Parse files (program, path, text), each by itself; a broken file is a diagnostic.

    Files are dealt to as many tasks as there are cores for, some times over: a
    table of them may lie in one part, and parsing takes longer than reading.
    """
    spark = bounded(ship(files.sparkSession))
    dealt = files.select("program", "path", "text").repartition(DEALT * spark.sparkContext.defaultParallelism, "program", "path")
    raw = stored(dealt.mapInPandas(_parse, "program string, file string, pos int, kind string, row string"), "ir")

    def of(kind: str, schema: str) -> DataFrame:
        return raw.where(F.col("kind") == kind).select("program", "file", "pos", F.from_json("row", schema).alias("r")).select("program", "file", "pos", "r.*")

    # the relations are written once: every detector joins them, and would derive them again from the parse
    structs, more_structs = _first(of("accounts", ACCOUNTS))
    states, more_states = _first(of("state", STATE))
    structs, states = stored(structs, "structs"), stored(states, "states")
    handlers = stored(of("handler", HANDLER), "handlers")
    decls = structs.select("program", F.col("name").alias("struct"), F.col("file"), F.posexplode("decls").alias("ix", "d")).select("program", "struct", "file", "ix", "d.*")
    constraints = stored(decls.select("program", "struct", F.col("name").alias("decl"), F.explode("constraints").alias("c")).select("program", "struct", "decl", "c.kind", "c.payload", compact(F.coalesce("c.payload", F.lit(""))).alias("text")), "constraints")
    has = lambda *kinds: F.exists("constraints", lambda c: c["kind"].isin(*kinds))
    decls = stored(decls.select(
        "*", ((F.col("wrapper") == "Signer") | has("SignerAttr")).alias("enforces_signer"), F.col("wrapper").isin("UncheckedAccount", "AccountInfo").alias("is_unchecked"), has("Seeds").alias("has_seeds"), has("Bump").alias("has_bump"),
        has("Init", "InitIfNeeded").alias("is_init"), has("Init").alias("is_new"), has("Address", "Owner").alias("is_pinned"), has("HasOne").alias("has_one"),
        F.when(F.col("wrapper").isin("Account", "InterfaceAccount"), F.col("inner_ty")).alias("state_ty"), F.when(F.col("attr_line") != 0, F.col("attr_line")).otherwise(F.col("line")).alias("shown_line"),
    ), "decls")
    fields = states.select("program", F.col("name").alias("state"), F.posexplode("fields").alias("ix", "f")).select("program", "state", "ix", F.col("f.name").alias("field"), F.col("f.ty").alias("ty"))
    unknown = matched(handlers, structs.select("program", F.col("name").alias("context_ty")), ["program", "context_ty"]).where("diagnostic = 'skipped'")
    note = lambda df, kind, text: df.select("program", "file", F.lit(kind).alias("kind"), text.alias("message"))
    diagnostics = (
        note(of("problem", "name string"), "parse", F.col("name"))
        .unionByName(note(more_structs, "ambiguity", F.concat(F.lit("accounts struct `"), "name", F.lit("` is defined again"))))
        .unionByName(note(more_states, "ambiguity", F.concat(F.lit("state struct `"), "name", F.lit("` is defined again"))))
        .unionByName(note(unknown, "skipped", F.concat(F.lit("handler `"), "name", F.lit("` takes the unknown context `"), "context_ty", F.lit("`"))))
    )
    return Program(handlers, structs, states, decls, constraints, fields, diagnostics)
