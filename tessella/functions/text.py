"""Column expressions over texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def truncated(text: Column | str, chars: int) -> Column:
    """At most so many characters, the last one an ellipsis where something is left out."""
    t = _c(text)
    return F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit(ELLIPSIS))).otherwise(t)


def abstract(text: Column | str, chars: int = 120) -> Column:
    """The first sentence, up to . ! or ? before white space or the end, and not beyond ``chars``."""
    t = F.trim(_c(text))
    first = F.regexp_extract(t, r"(?s)^(.*?[.!?])(\s|$)", 1)
    return truncated(F.when(first != "", first).otherwise(t), chars)


def approx_tokens(text: Column | str) -> Column:
    return F.ceil(F.length(_c(text)) / 4).cast("long")


def human_bytes(n: Column | str) -> Column:
    n = _c(n).cast("double")
    out = F.concat(F.format_string("%d", n.cast("long")), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", F.bround(n / 1024**k, 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_count(n: Column | str) -> Column:
    n = _c(n).cast("double")
    out = F.format_string("%d", n.cast("long"))
    for k, unit in ((3, "K"), (6, "M")):
        out = F.when(n >= 10**k, F.concat(F.format_string("%.1f", F.bround(n / 10**k, 1)), F.lit(unit))).otherwise(out)
    return out


def slug(text: Column | str, separator: str = "-", chars: int = 48) -> Column:
    s = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", separator)
    return F.rtrim(F.substring(F.btrim(s, F.lit(separator)), 1, chars), F.lit(separator))


def xml_escaped(text: Column | str, attribute: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&apos;")] if attribute else [])]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, _c(text))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob with * and ?."""
    special = ".^$+{}[]()|\\"
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in special else c) for c in glob) + "$"


def matches_glob(name: Column | str, glob: str) -> Column:
    return _c(name).rlike("(?s)" + glob_pattern(glob))


def is_stub(text: Column | str) -> Column:
    """A chunk that only names its file: short, and begins with one of three labels."""
    t = _c(text)
    return (F.length(t) < 80) & t.rlike("(?i)^(File|Image|Media file): ")


#: Kind and pattern of secrets, in the order in which they are replaced.
SECRETS = (
    ("private-key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----"),
    ("aws-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("google-key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("openai-key", r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("stripe-key", r"\b(?:[sr]k_(?:live|test)|whsec)_[A-Za-z0-9]{10,}\b"),
    ("gitlab-token", r"\bglpat-[A-Za-z0-9_-]{20,}\b"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{30,}\b"),
    ("sendgrid-key", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b"),
    ("google-oauth", r"\bya29\.[A-Za-z0-9_-]{20,}"),
    ("url-credentials", r"""(?i)\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@[^\s"'<>)\]]+"""),
)
#: Fixed value: a literal that is given to a name; the name and what follows it stay.
ASSIGNMENT = r"""(?i)\b(api[_-]?key|secret|token|password|passwd|access[_-]?key)\b(\s*[:=]\s*)['"]?[A-Za-z0-9_\-./+]{12,}['"]?"""


#: Of the pieces below every text with a secret holds one, whatever its case.
_PIECES = ("private key-----", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "aiza", "sk-", "eyj", "k_live_", "k_test_", "whsec_", "glpat-", "npm_", "sg.", "ya29.", "://", "api", "secret", "token", "passw", "access")


def _may_hold_secrets(text: Column) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in _PIECES])


def _all_replaced(text: Column) -> Column:
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED-{kind}]")
    return F.regexp_replace(text, ASSIGNMENT, "$1$2[REDACTED-secret]")


def redacted(text: Column | str) -> Column:
    """Secrets replaced by markers; of an assignment the name and what follows it stay."""
    t = _c(text)
    return F.when(_may_hold_secrets(t), _all_replaced(t)).otherwise(t)


def redactions(text: Column | str) -> Column:
    """The number of markers that redaction puts in; those that stood in the text before don't count."""
    t = _c(text)
    fresh = F.regexp_count(_all_replaced(F.replace(t, F.lit("[REDACTED-"), F.lit("[REDACTED="))), F.lit(r"\[REDACTED-[a-z-]+\]")).cast("long")
    return F.when(_may_hold_secrets(t), fresh).otherwise(F.when(t.isNotNull(), F.lit(0)).cast("long"))


#: Letters with marks, and the plain ones that stand for them in search.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column | str) -> Column:
    low = F.lower(_c(text))
    # Most texts are ASCII alone, where the dearer step changes nothing.
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def search_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits without marks."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")
