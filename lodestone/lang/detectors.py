"""Rule detectors as selections and joins over the relations of programs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_authority, stable_id
from lodestone.lang.ir import Program
from lodestone.session import stored

# Class, severity, confidence, in catalogue order.
RULES = (
    ("missing-signer", "critical", 0.90),
    ("missing-owner-check", "high", 0.75),
    ("missing-authority-binding", "high", 0.70),
    ("pda-validation-gap", "high", 0.65),
    ("unchecked-arithmetic", "medium", 0.35),
    ("removed-guard", "high", 0.60),
)
# Parts of names that claim authority, and that mark a handover.
CLAIMING_ROLES = ("authority", "admin", "owner", "delegate", "manager")
STAGING = ("pending", "proposed", "next", "new", "incoming", "candidate")

_KEY = ["program", "struct"]


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _found(rows: DataFrame, rule: str, key: Column, line: Column, evidence: Column, account: Column | None = None) -> DataFrame:
    """Findings from rows that have program, handler and file."""
    _, severity, confidence = next(r for r in RULES if r[0] == rule)
    return rows.select(
        "program", stable_id(F.col("handler"), F.lit(rule), key).alias("id"), F.lit(rule).alias("class"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit("static").alias("track"),
        "file", line.cast("int").alias("line"), "handler", evidence.alias("evidence"), (key if account is not None else F.lit(None).cast("string")).alias("subject"),
        (account if account is not None else F.lit(None).cast("string")).alias("account"), F.array().cast("array<string>").alias("absorbed_handlers"), "struct",
    )


def _sibling_pins(p: Program) -> DataFrame:
    """Declarations that another one of their struct, not being created, names in seeds, a constraint or an address."""
    others = p.constraints.where(F.col("kind").isin("Seeds", "Raw", "Address")).join(p.decls.where("not is_init").select(*_KEY, F.col("name").alias("decl")), [*_KEY, "decl"]).select(*_KEY, "decl", "text")
    named = p.decls.select(*_KEY, "name").join(others, _KEY).where("name <> decl").where(F.contains("text", F.concat("name", F.lit(".key()"))))
    return named.select(*_KEY, "name").distinct()


def _segments(name: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(name), "_"), F.array(*[F.lit(w) for w in words]))


def missing_signer(p: Program, use: DataFrame) -> DataFrame:
    d = use.join(p.decls, _KEY).where(~F.col("wrapper").isin("Program", "SystemAccount", "Sysvar") & is_authority(F.col("name")) & ~F.col("enforces_signer") & ~F.col("is_pinned"))
    text = _say("`", F.col("name"), "` is named as a privileged account but declared as ", F.col("wrapper"), ": no signer type, no signer constraint and no pinned address. Any account may be passed.")
    return _found(d, "missing-signer", F.col("name"), F.col("line"), text, F.col("name"))


def missing_owner_check(p: Program, use: DataFrame) -> DataFrame:
    d = p.decls.where(F.col("is_unchecked") & ~F.col("is_pinned") & ~F.col("has_seeds"))
    keyed = p.constraints.where((F.col("kind") == "Raw") & F.contains("text", F.lit(".key()"))).select(*_KEY, F.col("decl").alias("name"))
    d = d.join(keyed, [*_KEY, "name"], "left_anti").join(_sibling_pins(p), [*_KEY, "name"], "left_anti")
    text = _say("`", F.col("name"), "` is declared as ", F.col("wrapper"), ", whose owner and kind nobody checks, and no address, owner, seeds or constraint pins it.")
    return _found(use.join(d, _KEY), "missing-owner-check", F.col("name"), F.col("line"), text, F.col("name"))


def missing_authority_binding(p: Program, use: DataFrame) -> DataFrame:
    signed = p.decls.where("enforces_signer").select(*_KEY).distinct()
    d = p.decls.where("not is_new and state_ty is not null").join(signed, _KEY, "left_semi")
    held = d.join(p.fields.withColumnRenamed("state", "state_ty").withColumnRenamed("ix", "field_ix"), ["program", "state_ty"]).where(F.contains("ty", F.lit("Pubkey")) & is_authority(F.col("field")))
    own = p.constraints.withColumnRenamed("decl", "name")
    bound = held.select(*_KEY, "name", "field").join(own, [*_KEY, "name"]).where(((F.col("kind") == "HasOne") & (F.col("payload") == F.col("field"))) | ((F.col("kind") == "Raw") & F.contains("text", "field") & (F.contains("text", F.lit(".key()")) | F.contains("text", F.lit("==")))))
    by_sibling = held.select(*_KEY, "name", "field").join(p.constraints.where(F.col("kind").isin("Address", "Raw")), _KEY).where("decl <> name").where(F.contains("text", F.concat_ws(".", "name", "field")))
    free = held.join(bound.select(*_KEY, "name", "field").unionByName(by_sibling.select(*_KEY, "name", "field")).distinct(), [*_KEY, "name", "field"], "left_anti")
    c = p.decls.select(*_KEY, F.col("name").alias("claims"))
    claims = (F.col("claims") == F.col("field")) | ((_segments(F.col("claims"), STAGING) == _segments(F.col("field"), STAGING)) & _segments(F.col("claims"), CLAIMING_ROLES) & _segments(F.col("field"), CLAIMING_ROLES))
    claimed = free.select(*_KEY, "name", "field").join(c, _KEY).where(claims).select(*_KEY, "name", "field").distinct()
    free = free.join(claimed, [*_KEY, "name", "field"])
    text = _say("`", F.col("name"), "` stores an authority in `", F.col("field"), "`, but no has_one, constraint or address compares it with the account that was passed.")
    return _found(use.join(free, _KEY), "missing-authority-binding", F.concat_ws(".", "name", "field"), F.col("shown_line"), text, F.col("name"))


def pda_validation_gap(p: Program, use: DataFrame) -> DataFrame:
    last = lambda c: F.substring_index(c["name"], "::", -1)
    h = use.select("program", "handler", "struct", F.col("handler_file").alias("file"), F.get(F.filter("calls", lambda c: last(c) == "create_program_address"), F.lit(0)).alias("made"), F.exists("calls", lambda c: last(c) == "find_program_address").alias("canonical"), F.get(F.filter("args", lambda a: (a["ty"] == "u8") & F.contains(a["name"], F.lit("bump"))), F.lit(0)).alias("bump"))
    h = h.where("made is not null and not canonical and bump is not null")
    text = _say("`", F.col("bump.name"), "` comes from the caller and goes into an address derivation that accepts every valid bump; the canonical one is never derived.")
    given = _found(h, "pda-validation-gap", F.col("bump.name"), F.col("made.line"), text, F.lit(None).cast("string"))
    d = use.join(p.decls, _KEY)
    odd = d.where("has_seeds <> has_bump")
    text = _say("`", F.col("name"), "` has ", F.when(F.col("has_seeds"), "seeds without a bump").otherwise("a bump without seeds"), ", so its derivation is not pinned.")
    uneven = _found(odd, "pda-validation-gap", F.col("name"), F.col("shown_line"), text, F.col("name"))
    sites = p.decls.where("has_seeds and state_ty is not null").groupBy("program", "state_ty").agg(F.array_sort(F.collect_set("struct")).alias("sites"))
    loose = d.where("not has_seeds and not has_bump and not is_pinned").join(sites, ["program", "state_ty"])
    text = _say("`", F.col("name"), "` is taken without seeds, but its type `", F.col("state_ty"), "` is derived in ", F.array_join("sites", ", "), ".")
    return given.withColumn("subject", F.coalesce("subject", F.lit(None))).unionByName(uneven).unionByName(_found(loose, "pda-validation-gap", F.col("name"), F.col("shown_line"), text, F.col("name")))


def unchecked_arithmetic(p: Program, use: DataFrame) -> DataFrame:
    h = use.select("program", "handler", "struct", F.col("handler_file").alias("file"), F.transform(F.filter("arith", lambda a: ~a["checked"]), lambda a: a["line"]).alias("lines")).where(F.size("lines") > 0)
    text = _say("`", F.col("handler"), "` computes without checks on line(s) ", F.array_join(F.transform("lines", lambda x: x.cast("string")), ", "), "; a release build wraps silently.")
    return _found(h, "unchecked-arithmetic", F.lit("arithmetic"), F.get("lines", F.lit(0)), text)


def removed_guard(p: Program, use: DataFrame) -> DataFrame:
    d = use.join(p.decls.where("not is_new"), _KEY)
    state = F.array_max(F.transform(F.filter("writes", lambda w: (F.length("name") > F.length(w["account"])) & F.startswith("name", w["account"])), lambda w: F.struct(F.length(w["account"]).alias("n"), w["account"].alias("a"))))
    d = d.withColumn("written", state["a"])
    tokens = p.constraints.where(F.col("kind").isin("Raw", "Address", "Owner", "Seeds", "Close", "Bump") & F.col("payload").isNotNull()).select(*_KEY, F.explode(F.split("payload", r"[^\p{L}\p{N}_]+")).alias("name")).distinct()
    moved = d.where(F.col("written").isNotNull() & F.array_contains("sinks", F.col("name")) & ~F.col("has_seeds") & ~F.col("is_pinned") & ~F.col("has_one"))
    moved = moved.join(tokens, [*_KEY, "name"], "left_anti").join(_sibling_pins(p), [*_KEY, "name"], "left_anti")
    text = _say("`", F.col("name"), "` moves value here and is named after `", F.col("written"), "`, whose state is written, but nothing says which account it is.")
    first = _found(moved, "removed-guard", F.col("name"), F.col("shown_line"), text, F.col("name"))
    stored_keys = p.fields.where("ty = 'Pubkey'").where(~is_authority(F.col("field"))).select("program", F.col("state").alias("state_ty"), "field")
    held = p.decls.where("not is_new and state_ty is not null").join(stored_keys, ["program", "state_ty"])
    held = held.join(p.decls.select(*_KEY, F.col("name").alias("field")).distinct(), [*_KEY, "field"])
    own = held.select(*_KEY, "name", "field").join(p.constraints.withColumnRenamed("decl", "name"), [*_KEY, "name"]).where(((F.col("kind") == "HasOne") & (F.col("payload") == F.col("field"))) | ((F.col("kind") == "Seeds") & F.contains("text", F.concat("field", F.lit(".key()")))))
    anywhere = held.select(*_KEY, "name", "field").join(p.constraints.where(F.col("kind").isin("Raw", "Address")), _KEY).where(F.contains("text", F.concat_ws(".", "name", "field")))
    free = held.join(own.select(*_KEY, "name", "field").unionByName(anywhere.select(*_KEY, "name", "field")).distinct(), [*_KEY, "name", "field"], "left_anti")
    text = _say("`", F.col("name"), "` stores `", F.col("field"), "` and an account of that name is passed, but nothing requires the two to be the same.")
    return first.unionByName(_found(use.join(free, _KEY), "removed-guard", F.concat_ws(".", "name", "field"), F.col("shown_line"), text, F.col("name")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, by column names."""
    return reduce(DataFrame.unionByName, parts)


DETECTORS = (missing_signer, missing_owner_check, missing_authority_binding, pda_validation_gap, unchecked_arithmetic, removed_guard)


def run(p: Program) -> DataFrame:
    """All detectors' findings, numbered in a stable order as ``seq``."""
    s = p.structs.select("program", F.col("name").alias("struct"))
    use = p.handlers.select("program", F.col("name").alias("handler"), F.col("context_ty").alias("struct"), F.col("file").alias("handler_file"), "args", "arith", "calls", "writes", "sinks").join(s, ["program", "struct"])
    use = stored(use, "use")
    out = union_all([detect(p, use) for detect in DETECTORS])
    return stored(out.withColumn("seq", F.xxhash64("program", "handler", "class", "subject", "id")), "found")
