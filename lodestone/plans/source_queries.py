"""Static analysis over the sample programs, and over one program a supplier; the driver's tables hold no source.

The oracles are tables of what a reader finds in the sample programs by the
rules' definitions: the lines, accounts and handlers are read off their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.lang import detectors, suppression
from lodestone.lang.analyze import analyze
from lodestone.lang.evaluation import run
from lodestone.lang.ir import program
from lodestone.lang.mutations import mutants
from lodestone.lang.rules import CATALOGUE
from lodestone.operators.merging import fold
from lodestone.plans.registry import query
from lodestone.plans.sample_programs import FILES, LOCKER, SIEVE
from lodestone.session import table


def _values(columns: str, rows: list[tuple]) -> str:
    """A table of expected rows as SQL."""

    def lit(x: object) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


# What is wrong with SIEVE: drain takes an unsigned admin and an account that nothing pins; fill adds without a check, moves
# value to a token account that only its name ties to the pot, and takes a pot that is derived elsewhere; drain's target is
# checked by hand for its owner's sake, but the pot does not say so; rename's pot has seeds and no bump.
_FOUND = [
    ("missing-signer", "critical", 0.9, "drain", 47, "admin", ""),
    ("missing-owner-check", "high", 0.75, "drain", 47, "admin", "rename"),
    ("missing-owner-check", "high", 0.75, "drain", 46, "other", ""),
    ("pda-validation-gap", "high", 0.65, "fill", 32, "pot", "rename"),
    ("removed-guard", "high", 0.6, "drain", 42, "pot.target", ""),
    ("removed-guard", "high", 0.6, "fill", 34, "pot_token", ""),
    ("unchecked-arithmetic", "medium", 0.35, "fill", 8, None, ""),
]
_FOUND_SQL = f"SELECT 'sieve' AS program, class, severity, confidence::DOUBLE AS confidence, handler, line::INT AS line, subject, absorbed FROM ({_values('class, severity, confidence, handler, line, subject, absorbed', _FOUND)})"
# of one handler's two findings of a class the stronger one stays, ties by the evidence; the admin of drain is said before the other
_MERGED_SQL = f"SELECT class, severity, confidence::DOUBLE AS confidence, 'static' AS track, handler, line::INT AS line, subject FROM ({_values('class, severity, confidence, handler, line, subject', [r[:6] for r in _FOUND if r[5] != 'other'])})"
_SUPPRESSED = [
    ("missing-authority-binding", "rename", "pot.admin", "the handler carries access control, which may validate the authority"),
    ("missing-signer", "rename", "admin", "the handler carries access control, which may validate the authority"),
    ("missing-owner-check", "drain", "target", "a ManualIf check on line 13 refers to `target`"),
]
_DIAGNOSTICS = [
    ("sieve/src/broken.rs", "parse", "line 1: unmatched {"),
    ("sieve/src/lib.rs", "ambiguity", "state struct `Pot` is defined again"),
    ("sieve/src/lib.rs", "skipped", "handler `lost` takes the unknown context `Missing`"),
]
_HANDLERS = [
    ("locker", "open", 9, 15, "Open", 0, 2, 0, ""), ("locker", "put", 17, 31, "Put", 1, 8, 0, "locker_token,owner,owner_token,token_program"), ("locker", "take", 33, 38, "Take", 1, 3, 1, ""),
    ("sieve", "fill", 6, 10, "Fill", 1, 5, 0, "giver,pot_token,token_program"), ("sieve", "drain", 12, 18, "Drain", 0, 4, 2, ""), ("sieve", "rename", 20, 23, "Rename", 0, 1, 1, ""), ("sieve", "lost", 25, 27, "Missing", 0, 1, 0, ""),
]
# Every place where one guard can be taken out, with the place's name (an account, with the begin of its attribute where that is cut).
_MUTANTS = [
    ("locker", "strip_seeds_bump", "open", "locker@1404", 45), ("locker", "signer_to_account_info", "open", "owner", 48), ("locker", "strip_seeds_bump", "put", "locker@1658", 54), ("locker", "signer_to_account_info", "put", "owner", 56),
    ("locker", "strip_constraint", "put", "owner_token@1835", 57), ("locker", "strip_has_one", "take", "locker@2236", 69), ("locker", "strip_seeds_bump", "take", "locker@2170", 68), ("locker", "signer_to_account_info", "take", "owner", 73),
    ("locker", "account_to_unchecked", "take", "fee_token", 75), ("locker", "checked_to_bare", "put", "19#0", 19), ("locker", "checked_to_bare", "take", "36#0", 36),
    ("sieve", "account_to_unchecked", "fill", "pot", 33), ("sieve", "account_to_unchecked", "fill", "pot_token", 35), ("sieve", "account_to_unchecked", "drain", "pot", 43), ("sieve", "strip_seeds_bump", "drain", "pot@1187", 42),
    ("sieve", "account_to_unchecked", "rename", "pot", 53), ("sieve", "strip_seeds_bump", "rename", "pot@1457", 52), ("sieve", "signer_to_account_info", "rename", "signer", 55),
]
_DEFECTS = [
    ("signer_to_account_info", "missing-signer", "critical"), ("account_to_unchecked", "missing-owner-check", "high"), ("strip_has_one", "missing-authority-binding", "high"), ("strip_seeds_bump", "pda-validation-gap", "high"),
    ("strip_constraint", "removed-guard", "high"), ("checked_to_bare", "unchecked-arithmetic", "medium"),
]
_MUTANTS_SQL = f"""SELECT program, left(sha256(concat_ws('|', operator, program || '/src/lib.rs', handler, line::VARCHAR, site)), 16) AS id, class, severity, program || '/src/lib.rs' AS file, line::INT AS line, handler, operator
FROM ({_values('program, operator, handler, site, line', _MUTANTS)}) JOIN ({_values('operator, class, severity', _DEFECTS)}) USING (operator)"""
# The clean program: every defect is found where it was made but the token account's constraint, whose absence no rule sees.
_SUMMARY_SQL = f"""SELECT class, view, CASE WHEN view = 'llm' OR class = 'removed-guard' THEN 0 ELSE n END AS true_positives, n AS total_cases, 0::BIGINT AS false_positives,
CASE WHEN view = 'llm' OR class = 'removed-guard' THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, CASE WHEN view = 'llm' OR class = 'removed-guard' THEN NULL ELSE 1.0 END::DOUBLE AS precision
FROM (SELECT class, count(*) AS n FROM ({_MUTANTS_SQL}) WHERE program = 'locker' GROUP BY class), (VALUES ('static'), ('llm'), ('merged')) w(view)"""
_POT = "State struct Pot has field admin, target, level."
_LOCKER = "State struct Locker has field owner, token, label, limit, coins."
_UNITS = [
    ("locker", "take", 33, 748, f"Solana Anchor instruction take with 3 accounts. Account types: Account of Locker, Account of TokenAccount, Signer. Present constraints: bump, has_one, mut, seeds. Operations: state mutation, imperative checks present. {_LOCKER}"),
    ("locker", "put", 17, 1253, f"Solana Anchor instruction put with 5 accounts. Account types: Account of Locker, Account of TokenAccount, Program of Token, Signer. Present constraints: address, bump, constraint, has_one, mut, seeds. Operations: cross-program invocation, state mutation. {_LOCKER}"),
    ("locker", "open", 9, 668, f"Solana Anchor instruction open with 3 accounts. Account types: Account of Locker, Program of System, Signer. Present constraints: bump, constraint, init, mut, seeds. Operations: state mutation. {_LOCKER}"),
    ("sieve", "lost", 25, 75, "Solana Anchor instruction lost with 0 accounts."),
    ("sieve", "fill", 6, 679, f"Solana Anchor instruction fill with 4 accounts. Account types: Account of Pot, Account of TokenAccount, Program of Token, Signer. Present constraints: mut. Operations: cross-program invocation, state mutation, unchecked addition. {_POT}"),
    ("sieve", "rename", 20, 402, f"Solana Anchor instruction rename with 3 accounts. Account types: Account of Pot, AccountInfo, Signer. Present constraints: mut, seeds. Absent on unchecked accounts: owner, address, seeds, signer. Operations: imperative checks present. {_POT}"),
    ("sieve", "drain", 12, 660, f"Solana Anchor instruction drain with 4 accounts. Account types: Account of Pot, AccountInfo, UncheckedAccount. Present constraints: bump, mut, seeds. Absent on unchecked accounts: owner, address, seeds, signer. Operations: imperative checks present. {_POT}"),
]


# Declarations as they stand: struct, name, wrapper, inner type, boxed, line, line of the attribute (0: none), kinds of constraints.
_DECLS = [
    ("locker", "Open", "locker", "Account", "Locker", False, 46, 45, "Init,Raw,Raw,Seeds,Bump"), ("locker", "Open", "owner", "Signer", None, False, 48, 47, "Mut"), ("locker", "Open", "system_program", "Program", "System", False, 49, 0, ""),
    ("locker", "Put", "locker", "Account", "Locker", False, 55, 54, "Mut,Seeds,Bump,HasOne"), ("locker", "Put", "owner", "Signer", None, False, 56, 0, ""), ("locker", "Put", "owner_token", "Account", "TokenAccount", False, 58, 57, "Mut,Raw"),
    ("locker", "Put", "locker_token", "Account", "TokenAccount", True, 60, 59, "Mut,Address"), ("locker", "Put", "token_program", "Program", "Token", False, 61, 0, ""), ("locker", "Take", "locker", "Account", "Locker", False, 72, 66, "Mut,Seeds,Bump,HasOne"),
    ("locker", "Take", "owner", "Signer", None, False, 73, 0, ""), ("locker", "Take", "fee_token", "Account", "TokenAccount", False, 75, 74, "Mut"), ("sieve", "Fill", "pot", "Account", "Pot", False, 33, 32, "Mut"),
    ("sieve", "Fill", "pot_token", "Account", "TokenAccount", False, 35, 34, "Mut"), ("sieve", "Fill", "giver", "Signer", None, False, 36, 0, ""), ("sieve", "Fill", "token_program", "Program", "Token", False, 37, 0, ""),
    ("sieve", "Drain", "pot", "Account", "Pot", False, 43, 42, "Mut,Seeds,Bump"), ("sieve", "Drain", "target", "UncheckedAccount", None, False, 45, 0, ""), ("sieve", "Drain", "other", "AccountInfo", None, False, 46, 0, ""),
    ("sieve", "Drain", "admin", "AccountInfo", None, False, 47, 0, ""), ("sieve", "Rename", "pot", "Account", "Pot", False, 53, 52, "Mut,Seeds"), ("sieve", "Rename", "admin", "AccountInfo", None, False, 54, 0, ""), ("sieve", "Rename", "signer", "Signer", None, False, 55, 0, ""),
]
# What follows from a declaration: whether it enforces a signature, is unchecked, has seeds or a bump, is created, and which state it holds.
_FOLLOWS_SQL = f"""SELECT program, struct, name, wrapper = 'Signer' AS enforces_signer, wrapper IN ('UncheckedAccount', 'AccountInfo') AS is_unchecked, contains(kinds, 'Seeds') AS has_seeds, contains(kinds, 'Bump') AS has_bump, contains(kinds, 'Init') AS is_init,
contains(kinds, 'Address') AS is_pinned, CASE WHEN wrapper = 'Account' THEN inner_ty END AS state_ty, CASE WHEN attr_line = 0 THEN line ELSE attr_line END AS shown_line FROM ({_values('program, struct, name, wrapper, inner_ty, boxed, line, attr_line, kinds', _DECLS)})"""
_CONSTRAINTS = [
    ("locker", "Open", "locker", "Raw", "payer=owner"), ("locker", "Open", "locker", "Raw", "space=8+80"), ("locker", "Open", "locker", "Seeds", '[b"locker",owner.key().as_ref()]'), ("locker", "Put", "locker", "Seeds", '[b"locker",owner.key().as_ref()]'),
    ("locker", "Put", "locker", "HasOne", "owner"), ("locker", "Put", "owner_token", "Raw", "constraint=owner_token.mint==locker_token.mint"), ("locker", "Put", "locker_token", "Address", "locker.token"), ("locker", "Take", "locker", "Seeds", '[b"locker",locker.label.as_ref()]'),
    ("locker", "Take", "locker", "HasOne", "owner"), ("sieve", "Drain", "pot", "Seeds", '[b"pot"]'), ("sieve", "Rename", "pot", "Seeds", '[b"pot"]'),
]
# The second definition of Pot does not count.
_FIELDS = [("locker", "Locker", 0, "owner", "Pubkey"), ("locker", "Locker", 1, "token", "Pubkey"), ("locker", "Locker", 2, "label", "[u8;32]"), ("locker", "Locker", 3, "limit", "u64"), ("locker", "Locker", 4, "coins", "u64"), ("sieve", "Pot", 0, "admin", "Pubkey"), ("sieve", "Pot", 1, "target", "Pubkey"), ("sieve", "Pot", 2, "level", "u64")]
_CHECKS = [
    ("locker", "take", "Require", 34, "Limit,LockerError,accounts,coins,ctx,limit,locker"), ("sieve", "drain", "ManualIf", 13, "accounts,ctx,key,pot,target"), ("sieve", "drain", "Require", 16, "SieveError,Target,accounts,ctx,key,pot,target"), ("sieve", "rename", "AccessControl", 20, "ctx,only_admin"),
]
_BODIES = [
    ("locker", "open", "locker@11,locker@12,locker@13", "", ""), ("locker", "put", "locker@19", "checked_add@19", "token::transfer@20,CpiContext::new@21"), ("locker", "take", "locker@36", "checked_sub@36", ""),
    ("sieve", "fill", "pot@8", "+@8", "token::transfer@9,CpiContext::new@9"), ("sieve", "drain", "", "", ""), ("sieve", "rename", "", "", ""), ("sieve", "lost", "", "", ""),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "program string, path string, text string")


@query(_FOUND_SQL)
def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(files(spark)).findings
    return found.select("program", "class", "severity", "confidence", "handler", "line", "subject", F.array_join("absorbed_handlers", ",").alias("absorbed"))


@query(f"SELECT 'sieve' AS program, * FROM ({_values('class, handler, subject, reason', _SUPPRESSED)})")
def source_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(files(spark)).suppressed.select("program", "class", "handler", "subject", "reason")


@query(f"SELECT 'sieve' AS program, * FROM ({_values('file, kind, message', _DIAGNOSTICS)})")
def source_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program(files(spark)).diagnostics


@query(_values('program, name, line, end_line, context_ty, n_arith, n_calls, n_checks, sinks', _HANDLERS))
def source_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = program(files(spark)).handlers
    return h.select("program", "name", "line", "end_line", "context_ty", F.size("arith").alias("n_arith"), F.size("calls").alias("n_calls"), F.size("checks").alias("n_checks"), F.array_join("sinks", ",").alias("sinks"))


@query(_MERGED_SQL)
def source_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(files(spark)).findings.where("program = 'sieve'").withColumn("citations", F.array().cast("array<string>"))
    return fold(found).select("class", "severity", "confidence", "track", "handler", "line", "subject")


@query(_MUTANTS_SQL)
def mutation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark)
    return mutants(program(f), f).drop("text")


@query(_SUMMARY_SQL)
def mutation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(files(spark).where("program = 'locker'")).summary


@query(_values('program, handler, line, source_chars, query', _UNITS))
def review_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.lang.units import units

    f = files(spark)
    return units(program(f), f).select("program", "handler", "line", F.length("source").alias("source_chars"), "query")


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for each supplier: a clean one, and one with defects for every third."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    text = F.when(F.col("s_suppkey") % 3 == 0, F.lit(SIEVE)).otherwise(F.lit(LOCKER))
    return s.select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("program"), F.lit("src/lib.rs").alias("path"), text.alias("text"))


@query(f"""SELECT class, handler, count(*) AS programs FROM supplier, ({_FOUND_SQL}) f WHERE s_suppkey % 3 = 0 GROUP BY class, handler""")
def source_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers' programs analyzed in one job; how many have each finding."""
    found = analyze(_supplied(spark, sf_dir)).findings
    return found.groupBy("class", "handler").agg(F.count(F.lit(1)).alias("programs"))


def _program(spark: SparkSession):
    return program(files(spark))


@query(_values("program, struct, name, wrapper, inner_ty, boxed, line, attr_line, kinds", _DECLS))
def source_decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(spark).decls.select("program", "struct", "name", "wrapper", "inner_ty", "boxed", "line", "attr_line", F.array_join(F.transform("constraints", lambda c: c["kind"]), ",").alias("kinds"))


@query(_FOLLOWS_SQL)
def source_decl_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(spark).decls.select("program", "struct", "name", "enforces_signer", "is_unchecked", "has_seeds", "has_bump", "is_init", "is_pinned", "state_ty", "shown_line")


@query(_values("program, struct, decl, kind, text", _CONSTRAINTS))
def source_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(spark).constraints.where("payload is not null").select("program", "struct", "decl", "kind", "text")


@query(_values("program, state, ix, field, ty", _FIELDS))
def source_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(spark).fields.select("program", "state", "ix", "field", "ty")


@query(_values("program, handler, kind, line, idents", _CHECKS))
def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _program(spark).handlers.select("program", F.col("name").alias("handler"), F.explode("checks").alias("c"))
    return h.select("program", "handler", "c.kind", "c.line", F.array_join("c.idents", ",").alias("idents"))


@query(_values("program, handler, writes, arith, cpi", _BODIES))
def source_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What handlers' bodies do: state writes, arithmetic and calls into other programs, with their lines."""
    at = lambda x, what: F.array_join(F.transform(x, lambda c: F.concat(c[what], F.lit("@"), c["line"].cast("string"))), ",")
    return _program(spark).handlers.select("program", F.col("name").alias("handler"), at("writes", "account").alias("writes"), at("arith", "op").alias("arith"), at(F.filter("calls", lambda c: c["is_cpi"]), "name").alias("cpi"))


@query("SELECT * FROM (VALUES ('locker', 'Put', 'owner')) v(program, struct, name)")
def sibling_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations that another one of their struct, not being created, names by key: the owner in the seeds of put's locker."""
    return detectors._sibling_pins(_program(spark))


@query(f"SELECT row_number() OVER () - 1 AS ord, class, severity, confidence::DOUBLE AS confidence FROM ({_values('class, severity, confidence', [('missing-signer', 'critical', 0.9), ('missing-owner-check', 'high', 0.75), ('missing-authority-binding', 'high', 0.7), ('pda-validation-gap', 'high', 0.65), ('unchecked-arithmetic', 'medium', 0.35), ('removed-guard', 'high', 0.6)])})")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, r["id"], r["severity"], r["confidence"]) for i, r in enumerate(CATALOGUE)], "ord long, class string, severity string, confidence double")


@query("""SELECT event_id, (event_id % 3 = 0 AND user_id % 2 = 0) OR event_id % 3 = 1 AS equal FROM events""")
def equals_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text compares a chain that begins with `vault` with a key, on either side and at an identifier's border."""
    left = F.when(F.col("user_id") % 2 == 0, F.lit("vault")).otherwise(F.lit("my_vault"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(left, F.lit(".owner.id==accounts.boss.key()"))).when(F.col("event_id") % 3 == 1, F.lit("boss.key()==accounts.vault.owner")).otherwise(F.lit("vault.owner!=boss.key()"))
    return table(spark, sf_dir, "events").select("event_id", suppression._equals_key(text, F.lit("vault")).alias("equal"))
