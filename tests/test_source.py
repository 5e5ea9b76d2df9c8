"""The source language: lexer, parser, detectors, suppression, mutations; and the seams of the package."""

import pathlib
import re

import pytest

from lodestone.lang.analyze import analyze
from lodestone.lang.evaluation import run
from lodestone.lang.lexer import SyntaxProblem, lex
from lodestone.lang.mutations import mutate_file
from lodestone.lang.parser import parse
from lodestone.plans.sample_programs import FILES, LOCKER


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "program string, path string, text string")


@pytest.fixture(scope="module")
def analysis(files):
    a = analyze(files)
    return a.findings.collect(), a.suppressed.collect(), a.diagnostics.collect()


def test_clean_program_has_no_findings(analysis):
    assert [f for f in analysis[0] if f.program == "locker"] == []


def test_every_rule_fires(analysis):
    got = {(f["class"], f.handler, f.subject) for f in analysis[0]}
    assert got == {
        ("missing-signer", "drain", "admin"), ("missing-owner-check", "drain", "admin"), ("missing-owner-check", "drain", "other"), ("pda-validation-gap", "fill", "pot"), ("removed-guard", "drain", "pot.target"),
        ("removed-guard", "fill", "pot_token"), ("unchecked-arithmetic", "fill", None),
    }
    assert analysis[0][0]["class"] == "missing-signer"


def test_checks_suppress_with_reasons(analysis):
    got = {(s["class"], s.handler): s.reason for s in analysis[1]}
    assert "ManualIf check on line" in got["missing-owner-check", "drain"]
    assert "access control" in got["missing-signer", "rename"] and "access control" in got["missing-authority-binding", "rename"]


def test_diagnostics(analysis):
    assert sorted(d.kind for d in analysis[2]) == ["ambiguity", "parse", "skipped"]


def test_same_result_for_any_partitioning(files, analysis):
    again = analyze(files.repartition(4)).findings.collect()
    assert again == analysis[0]


@pytest.mark.parametrize("text", ["fn f( {", 'let s = "open', "/* open", "}"])
def test_unreadable_texts(text):
    with pytest.raises(SyntaxProblem):
        lex(text)


def test_lexer_passes_over_comments_strings_and_lifetimes():
    s = lex('a /* x /* y */ { */ b // }\n r#"raw " {"# \'{\' &\'a str "q\\"{" 1.5')
    assert s.text == ["a", "b", 'r#"raw " {"#', "'{'", "&", "'a", "str", '"q\\"{"', "1.5"] and s.line[-1] == 2


HEAD = "#[program] pub mod p { pub fn h(ctx: Context<'_, '_, '_, 'info, A<'info>>, bump: u8) -> Result<()> { %s } }"


def body(code):
    return parse(HEAD % code)[0][1]


def test_bodies():
    b = body("let v = &mut ctx.accounts.vault; v.total += 1; ctx.accounts.pot.n = -x; let y = a * b - c.checked_add(1).unwrap();")
    assert [w["account"] for w in b["writes"]] == ["vault", "pot"] and [(a["op"], a["checked"]) for a in b["arith"]] == [("+=", False), ("*", False), ("-", False), ("checked_add", True)]
    b = body('require!(a == b, E); msg!("x {}", a + b); if x { return Err(E.into()); } if y { z(); } require_keys_eq!(k.key(), l);')
    assert [c["kind"] for c in b["checks"]] == ["Require", "ManualIf", "RequireKeysEq"] and b["arith"] == []
    b = body("let cpi = Transfer { from: ctx.accounts.a.to_account_info(), to: ctx.accounts.b.to_account_info() }; let c = CpiContext::new(p, cpi); token::transfer(c, 1)?;")
    assert b["sinks"] == ["a", "b"] and any(c["is_cpi"] for c in b["calls"])
    b = body("**ctx.accounts.a.try_borrow_mut_lamports()? -= 5; **ctx.accounts.b.to_account_info().try_borrow_mut_lamports()? += 5;")
    assert b["sinks"] == ["a", "b"]
    assert b["context_ty"] == "A" and b["args"] == [{"name": "bump", "ty": "u8"}]


def test_declarations():
    text = "#[derive(Accounts)] pub struct A<'info> { #[account(mut, has_one = x @ E::Y, seeds = [b\"a\", &[1, 2]], bump = v.bump, token::mint = m)] pub v: Box<Account<'info, V>>, pub o: Option<Signer<'info>>, pub u: &'info UncheckedAccount<'info>, #[account(constraint = a.key() == b.key())] pub i: InterfaceAccount<'info, x::M> }"
    d = {x["name"]: x for x in parse(text)[0][1]["decls"]}
    assert (d["v"]["wrapper"], d["v"]["inner_ty"], d["v"]["boxed"]) == ("Account", "V", True)
    assert [(c["kind"], c["payload"]) for c in d["v"]["constraints"]][:2] == [("Mut", None), ("HasOne", "x")]
    assert [c["kind"] for c in d["v"]["constraints"]][2:] == ["Seeds", "Bump", "Raw"]
    assert d["o"]["optional"] and d["o"]["wrapper"] == "Signer" and d["u"]["wrapper"] == "UncheckedAccount" and d["i"]["inner_ty"] == "M"


def test_private_functions_and_other_arguments_are_no_handlers():
    assert parse("#[program] mod p { fn h(ctx: Context<A>) {} pub fn g(x: u8) {} pub(crate) fn k(ctx: Context<A>) {} }") == []
    assert parse("mod p { pub fn h(ctx: Context<A>) {} }") == []


def test_mutants_differ_and_parse():
    sites = {(r["name"], d["name"]): "h" for k, r in parse(LOCKER) if k == "accounts" for d in r["decls"]}
    got = mutate_file(LOCKER, sites, {"put", "take", "open"})
    assert len({t for *_, t in got}) == len(got) == len([parse(t) for *_, t in got]) > 8
    assert {op for op, *_ in got} == {"signer_to_account_info", "account_to_unchecked", "strip_has_one", "strip_constraint", "strip_seeds_bump", "checked_to_bare"}
    bare = next(t for op, _, _, _, t in got if op == "checked_to_bare")
    assert "locker.coins = locker.coins + coins;" in bare
    assert all("has_one = owner @" in t for op, _, _, _, t in got if op == "strip_has_one")  # what the seeds say already is not taken out


def test_mutation_run_finds_what_it_breaks(files):
    r = run(files.where("program = 'locker'"))
    rows = {x["class"]: x for x in r.summary.where("view = 'static'").collect()}
    assert all(rows[c].recall == 1 and rows[c].precision == 1 for c in ("missing-signer", "missing-owner-check", "missing-authority-binding", "pda-validation-gap", "unchecked-arithmetic"))
    assert {x.view: x.findings for x in r.noise.collect()} == {"static": 0, "llm": 0, "merged": 0}


ROOT = pathlib.Path(__file__).parent.parent


def test_domain_words_stay_in_their_place():
    for f in (ROOT / "lodestone/operators").glob("*.py"):
        assert not re.search(r"anchor|solana|Pubkey|has_one", f.read_text(), re.I), f


def test_nothing_imports_the_llm_subpackage():
    for f in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in f.parts:
            assert "lodestone.llm" not in f.read_text(), f


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_files_of_one_part_are_parsed_by_many_tasks(spark):
    """A table of files that lies in one part is dealt before it is parsed."""
    many = spark.createDataFrame([(f"p{i}", "src/lib.rs", LOCKER) for i in range(64)], "program string, path string, text string").coalesce(1)
    from lodestone.lang.ir import program

    handlers = program(many).handlers
    assert handlers.select("program").distinct().count() == 64 and len(handlers.inputFiles()) > 1
