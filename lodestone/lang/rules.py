"""The catalogue of rules, in the order of the detectors."""

from lodestone.lang.detectors import RULES

_TEXT = {
    "missing-signer": ("A privileged account need not sign", "Nothing requires a signature of an account that the program treats as privileged, so any account may stand in for it."),
    "missing-owner-check": ("Nobody checks who owns an account", "The account's wrapper checks neither owner nor kind, and nothing else pins which account it is."),
    "missing-authority-binding": ("A signer is not tied to the account it claims", "The stored authority is never compared with the account that signs, so any signer may act on any account."),
    "pda-validation-gap": ("A derived address is checked here and not there", "An account that is derived in one place is taken without derivation in another, or with half of it."),
    "unchecked-arithmetic": ("Arithmetic may wrap", "A handler computes with operators that wrap silently in release builds."),
    "removed-guard": ("A guard that the code around it implies is absent", "What the rest of the program binds is not bound here; the evidence is the program's own pattern."),
}

CATALOGUE = [{"id": r, "title": _TEXT[r][0], "text": _TEXT[r][1], "help": f"https://example.org/rules/{r}", "severity": s, "confidence": c} for r, s, c in RULES]
