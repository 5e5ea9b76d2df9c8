"""The validity gate: references by scope, and mutants that no longer resolve."""

import pytest
from pyspark.sql import functions as F

from lodestone.lang import resolution as R
from lodestone.lang.ir import program
from lodestone.lang.mutations import mutants
from lodestone.plans.sample_programs import LOCKER, SIEVE

VAULT = """
#[program]
pub mod vault {
    pub fn fill(ctx: Context<Fill>, n: u64) -> Result<()> {
        let all = &mut ctx.accounts;
        let tank = &mut all.tank;
        tank.level += n;
        {
            let tank = n;
            msg!("{}", tank.odd);
        }
        tank.stamp = ctx.bumps.tank;
        let other = ctx.accounts.payer.key();
        other.whatever;
        ctx.accounts.mint.decimals;
        ctx.accounts.tank.reload()?;
        Ok(())
    }
}

#[derive(Accounts)]
#[instruction(label: String)]
pub struct Fill<'info> {
    #[account(mut, seeds = [b"tank", label.as_bytes(), payer.key().as_ref()], bump, has_one = payer @ E::Payer, constraint = mint.supply > tank.level)]
    pub tank: Account<'info, Tank>,
    #[account(mut)]
    pub payer: Signer<'info>,
    pub mint: Account<'info, Mint>,
}

#[account]
pub struct Tank { pub payer: Pubkey, pub level: u64, pub stamp: u8 }
"""


def reasons(spark, text):
    files = spark.createDataFrame([("p", "lib.rs", text)], "program string, path string, text string")
    return sorted((r.scope, r.reason) for r in R.unresolved(program(files), files).collect())


def test_a_sound_program_resolves(spark):
    assert reasons(spark, VAULT) == [] and reasons(spark, LOCKER) == []
    assert reasons(spark, SIEVE) == [("lost", "no accounts struct `Missing`")]


@pytest.mark.parametrize("old,new,want", [
    ("pub level: u64, ", "", [("Fill.tank", "`Tank` has no field `level`"), ("fill", "`Tank` has no field `level`")]),
    ("pub payer: Pubkey, ", "", [("Fill.tank", "`Tank` has no field `payer`")]),
    ("pub mint: Account<'info, Mint>,", "", [("Fill.tank", "`Fill` has no account `mint`"), ("fill", "`Fill` has no account `mint`")]),
    ("seeds = [b\"tank\", label.as_bytes(), payer.key().as_ref()], bump, ", "", [("fill", "no bump is derived for `tank`")]),
    ("has_one = payer", "has_one = mint", [("Fill.tank", "`Tank` has no field `mint`")]),
    ("#[instruction(label: String)]", "", [("Fill.tank", "`Fill` has no account `label`")]),
    ("Context<Fill>", "Context<Nope>", [("fill", "no accounts struct `Nope`")]),
    ("pub mint: Account<'info, Mint>", "pub mint: UncheckedAccount<'info>", [("Fill.tank", "`UncheckedAccount` `mint` has no `supply`"), ("fill", "`UncheckedAccount` `mint` has no `decimals`")]),
    ("tank: Account<'info, Tank>", "tank: AccountInfo<'info>", [("Fill.tank", "`AccountInfo` `tank` has no `level`"), ("Fill.tank", "`AccountInfo` `tank` has no `payer`"), ("fill", "`AccountInfo` `tank` has no `level`"), ("fill", "`AccountInfo` `tank` has no `reload`"), ("fill", "`AccountInfo` `tank` has no `stamp`")]),
])
def test_what_does_not_resolve(spark, old, new, want):
    assert old in VAULT and reasons(spark, VAULT.replace(old, new, 1)) == want


def test_gate_rejects_exactly_the_planted(spark):
    """Mutants made by the operators, and planted ones: a constraint or a note may go, a field or a name may not."""
    files = spark.createDataFrame([("v", "lib.rs", VAULT), ("s", "s.rs", SIEVE), ("l", "l.rs", LOCKER)], "program string, path string, text string")
    planted = {
        "note": VAULT.replace("pub payer: Signer", "/// CHECK: no\n    pub payer: AccountInfo"), "loose": VAULT.replace("has_one = payer @ E::Payer, ", ""),
        "field": VAULT.replace("pub stamp: u8 ", ""), "name": VAULT.replace("pub tank: Account", "pub tank2: Account"), "type": VAULT.replace("pub tank: Account<'info, Tank>", "pub tank: UncheckedAccount<'info>"), "bump": VAULT.replace("seeds = [b\"tank\", label.as_bytes(), payer.key().as_ref()], bump, ", ""),
    }
    rows = [("v", k, "c", "high", "lib.rs", 1, "fill", "planted", t) for k, t in planted.items()]
    made = mutants(program(files), files)
    both = made.unionByName(spark.createDataFrame(rows, made.schema))
    kept, rejected = R.gate(files, both)
    gone = {(r.operator, r.id): r.reason for r in rejected.collect()}
    assert {i for o, i in gone if o == "planted"} == {"field", "name", "type", "bump"}
    assert gone["planted", "field"] == "fill: `Tank` has no field `stamp`"
    assert {i for o, i in kept.where("operator = 'planted'").select("operator", "id").collect()} == {"note", "loose"}
    # of the operators' own, those that retype an account whose fields are used
    own = {(r.program, r.operator, r.handler) for r in rejected.where("operator <> 'planted'").collect()}
    assert ("s", "account_to_unchecked", "fill") in own and all(o in ("account_to_unchecked", "strip_pda") or p == "v" for p, o, _ in own)
    assert kept.count() + len(gone) == both.count() and kept.where(F.col("program") == "l").count() == made.where("program = 'l'").count()
    assert kept.columns == made.columns
