"""Fixed values. Results depend on them, so tests pin them."""

# Retrieval.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
OVERFETCH = 4
BACKFILL = 2
GROUNDED_COSINE = 0.62
EMBED_BATCH = 32
QUERY_SYNTAX = '+^`:{}"[]()!\\*~'

# Chunking, in bytes.
MERGE_BELOW = 200
SPLIT_ABOVE = 1500
TAG_SCAN = 500
BLOCK_TAGS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "pre", "blockquote", "table", "ul", "ol")
HEADING_LEVELS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 4, "h6": 4}
CLASS_TAGS = ("missing-signer", "missing-owner-check", "missing-authority-binding", "pda-validation-gap", "unchecked-arithmetic")

# Findings.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_WEIGHT = {"info": 0.1, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
SARIF_LEVEL = {"critical": ("error", "9.0"), "high": ("error", "7.0"), "medium": ("warning", "5.0"), "low": ("note", "3.0"), "info": ("note", "1.0")}
TRACKS = ("static", "llm", "corroborated")
NOISY_OR_CAP = 0.98
CONFIDENCE_RANGE = (0.10, 0.90)
SINGLE_CITATION = 0.8
VIEW_TRACKS = {"static": ("static", "corroborated"), "llm": ("llm", "corroborated"), "merged": ("static", "llm", "corroborated")}

# Account names.
AUTHORITY_WORDS = ("authority", "admin", "owner", "signer", "payer", "delegate", "manager")
GENERIC_SUFFIXES = ("info", "key", "pubkey", "account")
CONSTRAINT_ORDER = ("owner", "address", "seeds", "signer")
