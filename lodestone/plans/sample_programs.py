"""Invented programs for queries and tests: one clean, one with a defect of each kind, one broken file."""

LOCKER = """
use anchor_lang::prelude::*;

/* a locker keeps coins for its owner */
#[program]
pub mod locker {
    use super::*;

    pub fn open(ctx: Context<Open>, limit: u64) -> Result<()> {
        let locker = &mut ctx.accounts.locker;
        locker.owner = ctx.accounts.owner.key();
        locker.limit = limit;
        locker.coins = 0;
        Ok(())
    }

    pub fn put(ctx: Context<Put>, coins: u64) -> Result<()> {
        let locker = &mut ctx.accounts.locker;
        locker.coins = locker.coins.checked_add(coins).ok_or(LockerError::Overflow)?;
        token::transfer(
            CpiContext::new(
                ctx.accounts.token_program.to_account_info(),
                Transfer {
                    from: ctx.accounts.owner_token.to_account_info(),
                    to: ctx.accounts.locker_token.to_account_info(),
                    authority: ctx.accounts.owner.to_account_info(),
                },
            ),
            coins,
        )
    }

    pub fn take(ctx: Context<Take>, coins: u64) -> Result<()> {
        require!(coins <= ctx.accounts.locker.limit, LockerError::Limit);
        let locker = &mut ctx.accounts.locker;
        locker.coins = locker.coins.checked_sub(coins).ok_or(LockerError::Overflow)?;
        Ok(())
    }

    fn helper(a: u64) -> u64 { a + 1 }
}

#[derive(Accounts)]
pub struct Open<'info> {
    #[account(init, payer = owner, space = 8 + 80, seeds = [b"locker", owner.key().as_ref()], bump)]
    pub locker: Account<'info, Locker>,
    #[account(mut)]
    pub owner: Signer<'info>,
    pub system_program: Program<'info, System>,
}

#[derive(Accounts)]
pub struct Put<'info> {
    #[account(mut, seeds = [b"locker", owner.key().as_ref()], bump, has_one = owner @ LockerError::Owner)]
    pub locker: Account<'info, Locker>,
    pub owner: Signer<'info>,
    #[account(mut, constraint = owner_token.mint == locker_token.mint)]
    pub owner_token: Account<'info, TokenAccount>,
    #[account(mut, address = locker.token)]
    pub locker_token: Box<Account<'info, TokenAccount>>,
    pub token_program: Program<'info, Token>,
}

#[derive(Accounts)]
pub struct Take<'info> {
    #[account(
        mut,
        seeds = [b"locker", locker.label.as_ref()],
        bump,
        has_one = owner
    )]
    pub locker: Account<'info, Locker>,
    pub owner: Signer<'info>,
    #[account(mut)]
    pub fee_token: Account<'info, TokenAccount>,
}

#[account]
pub struct Locker {
    pub owner: Pubkey,
    pub token: Pubkey,
    pub label: [u8; 32],
    pub limit: u64,
    pub coins: u64,
}
"""

SIEVE = """
#[program]
pub mod sieve {
    use super::*;

    pub fn fill(ctx: Context<Fill>, n: u64) -> Result<()> {
        let pot = &mut ctx.accounts.pot;
        pot.level = pot.level + n;
        token::transfer(CpiContext::new(ctx.accounts.token_program.to_account_info(), Transfer { from: ctx.accounts.giver.to_account_info(), to: ctx.accounts.pot_token.to_account_info() }), n)
    }

    pub fn drain(ctx: Context<Drain>) -> Result<()> {
        if ctx.accounts.target.key() != ctx.accounts.pot.target {
            return Err(SieveError::Target.into());
        }
        require!(ctx.accounts.target.key() == ctx.accounts.pot.target, SieveError::Target);
        Ok(())
    }

    #[access_control(only_admin(&ctx))]
    pub fn rename(ctx: Context<Rename>) -> Result<()> {
        Ok(())
    }

    pub fn lost(ctx: Context<Missing>) -> Result<()> {
        Ok(())
    }
}

#[derive(Accounts)]
pub struct Fill<'info> {
    #[account(mut)]
    pub pot: Account<'info, Pot>,
    #[account(mut)]
    pub pot_token: Account<'info, TokenAccount>,
    pub giver: Signer<'info>,
    pub token_program: Program<'info, Token>,
}

#[derive(Accounts)]
pub struct Drain<'info> {
    #[account(mut, seeds = [b"pot"], bump)]
    pub pot: Account<'info, Pot>,
    /// CHECK: checked by hand
    pub target: UncheckedAccount<'info>,
    pub other: AccountInfo<'info>,
    pub admin: AccountInfo<'info>,
}

#[derive(Accounts)]
pub struct Rename<'info> {
    #[account(mut, seeds = [b"pot"])]
    pub pot: Account<'info, Pot>,
    pub admin: AccountInfo<'info>,
    pub signer: Signer<'info>,
}

#[account]
pub struct Pot {
    pub admin: Pubkey,
    pub target: Pubkey,
    pub level: u64,
}

#[account]
pub struct Pot {
    pub again: u64,
}
"""

FILES = [
    ("locker", "locker/src/lib.rs", LOCKER),
    ("sieve", "sieve/src/lib.rs", SIEVE),
    ("sieve", "sieve/src/broken.rs", "pub fn f( {"),
    ("sieve", "sieve/src/empty.rs", ""),
]
"""Rows of (program, path, text)."""
