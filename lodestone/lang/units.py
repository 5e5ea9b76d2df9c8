"""What the model track reviews: each handler with the source around it, and the query that finds documents for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.constants import CONSTRAINT_ORDER
from lodestone.functions.text import line_slice
from lodestone.lang.ir import Program
from lodestone.lang.parser import CONSTRAINTS

_WRITTEN = {kind: key for key, kind in CONSTRAINTS.items()} | {"Raw": "constraint"}
_OPERATION = {"+": "addition", "-": "subtraction", "*": "multiplication", "/": "division"}


def _named(x: Column, names: dict[str, str], other: str) -> Column:
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), F.lit(other))


def _listed(x: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(x)), ", ")


def absent(present: Column) -> Column:
    """The constraints that a list lacks, in their fixed order."""
    return F.filter(F.array(*[F.lit(c) for c in CONSTRAINT_ORDER]), lambda c: ~F.array_contains(present, c))


def _clause(before: str, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(before), text, F.lit(".")))


def units(p: Program, files: DataFrame) -> DataFrame:
    """(program, handler, file, line, source, query) for every handler.

    The source is the handler's lines, those of its accounts struct and of the
    state structs that it names, in order of name. The query's clauses come in a
    fixed order and empty ones are left out.
    """
    text = files.select("program", F.col("path").alias("file"), "text")
    wrapper = F.when(F.col("inner_ty").isNotNull() & F.col("wrapper").isin("Account", "InterfaceAccount", "Program", "Sysvar"), F.concat("wrapper", F.lit(" of "), "inner_ty")).when(F.col("wrapper") == "Other", F.col("inner_ty")).otherwise(F.col("wrapper"))
    kinds = F.transform("constraints", lambda c: _named(c["kind"], _WRITTEN, "constraint"))
    none = F.array().cast("array<string>")
    shown = p.decls.groupBy("program", "struct").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(wrapper)).alias("types"), F.array_distinct(F.flatten(F.collect_list(kinds))).alias("present"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_unchecked"), kinds)))).alias("on_unchecked"), F.bool_or("is_unchecked").alias("unchecked"),
    )
    states = p.states.select("program", F.col("name").alias("state_ty"), "file", "line", "end_line", F.transform("fields", lambda f: f["name"]).alias("fields")).join(text, ["program", "file"])
    used = p.decls.where("state_ty is not null").select("program", "struct", "state_ty").distinct().join(states, ["program", "state_ty"])
    of = F.array_sort(F.collect_list(F.struct("state_ty", line_slice(F.col("text"), F.col("line"), F.col("end_line")).alias("source"), "fields")))
    states = used.groupBy("program", "struct").agg(of.alias("states"))
    structs = p.structs.select("program", F.col("name").alias("struct"), "file", "line", "end_line").join(text, ["program", "file"])
    structs = structs.select("program", "struct", line_slice(F.col("text"), F.col("line"), F.col("end_line")).alias("struct_source"))
    h = p.handlers.join(text, ["program", "file"]).withColumnRenamed("context_ty", "struct")
    h = h.join(structs, ["program", "struct"], "left").join(shown, ["program", "struct"], "left").join(states, ["program", "struct"], "left")
    states = F.coalesce("states", F.array().cast("array<struct<state_ty:string,source:string,fields:array<string>>>"))
    source = F.array_join(F.filter(F.concat(F.array(line_slice(F.col("text"), F.col("line"), F.col("end_line")), F.coalesce("struct_source", F.lit(""))), F.transform(states, lambda s: s["source"])), lambda s: s != ""), "\n\n")
    bare = F.array_sort(F.array_distinct(F.transform(F.filter("arith", lambda a: ~a["checked"]), lambda a: F.concat(F.lit("unchecked "), _named(a["op"], _OPERATION, "arithmetic")))))
    done = F.concat(
        F.when(F.exists("calls", lambda c: c["is_cpi"]), F.array(F.lit("cross-program invocation"))).otherwise(none), F.when(F.size("writes") > 0, F.array(F.lit("state mutation"))).otherwise(none), bare,
        F.when(F.size("checks") > 0, F.array(F.lit("imperative checks present"))).otherwise(none),
    )
    fields = F.array_join(F.transform(F.filter(states, lambda s: F.size(s["fields"]) > 0), lambda s: F.concat(F.lit("State struct "), s["state_ty"], F.lit(" has field "), F.array_join(s["fields"], ", "), F.lit("."))), " ")
    query = F.concat_ws(
        " ", F.concat(F.lit("Solana Anchor instruction "), "name", F.lit(" with "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" accounts.")), _clause("Account types: ", F.array_join("types", ", ")), _clause("Present constraints: ", _listed(F.col("present"))),
        F.when(F.col("unchecked"), _clause("Absent on unchecked accounts: ", F.array_join(absent(F.coalesce("on_unchecked", none)), ", "))), _clause("Operations: ", F.array_join(done, ", ")), F.nullif(fields, F.lit("")),
    )
    return h.select("program", F.col("name").alias("handler"), "file", "line", source.alias("source"), query.alias("query"))
