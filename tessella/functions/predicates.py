"""The small grammar of searches: predicates in a question, durations and intents."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import paths

#: What type: may be, and the extensions that it stands for.
TYPES = {
    "rust": ("rs",), "python": ("py", "pyi"), "js": ("js", "jsx", "mjs", "cjs"), "ts": ("ts", "tsx"), "go": ("go",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
    "web": ("html", "css", "scss", "less"), "docs": ("md", "mdx", "rst", "txt"), "config": ("toml", "yaml", "yml", "json"), "shell": ("sh", "bash", "zsh"), "ruby": ("rb",), "php": ("php",), "swift": ("swift",), "kotlin": ("kt", "kts"),
}
#: Phrases of questions about a whole project, and of those about code.
BROAD = (
    "what is this project", "what's this project", "what is this repo", "what's this repo", "what is this about", "what's this about", "what does this project", "tell me about this project",
    "summarize this project", "summarise this project", "summary of the project", "summarize the project", "summarise the project", "main themes", "overall", "high level", "high-level",
    "what are these documents about", "across these documents", "the whole project",
)
CODE_TERMS = ("function", "implement", "method", "struct", "trait", "fn ", "class ", "def ", "in the code", "code that")
#: Phrases that count only beside a code file's name or one of the verbs.
LOCATORS = ("which file", "where is")
CODE_VERBS = (
    "computed", "calculated", "defined", "declared", "handled", "parsed", "called", "invoked", "initialized", "configured", "validated", "assessed", "determined", "resolved", "enforced", "thrown", "raised",
)
#: Extensions of code files.
CODE_EXTENSIONS = ("rs", "py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "go", "java", "c", "h", "cpp", "cc", "rb", "php", "swift", "kt", "scala", "cs", "sh", "lua")
#: Names that many types define for themselves, and beginnings of such names.
IDIOMS = (
    "new", "default", "parse", "build", "from", "into", "from_str", "as_str", "as_ref", "as_mut", "clone", "to_string", "to_owned", "drop", "deref", "deref_mut", "fmt", "eq", "ne", "hash", "cmp", "partial_cmp",
    "next", "len", "is_empty", "iter", "into_iter", "default_config_path", "main", "run", "init", "setup", "render", "update", "handle", "call", "apply", "load", "save", "open", "close", "read", "write", "flush",
    "poll", "start", "stop", "name", "kind", "value",
)
IDIOM_BEGINNINGS = ("with_", "set_", "get_", "is_", "to_", "from_", "on_", "try_")


@dataclass(frozen=True)
class Parsed:
    text: str
    path: str | None = None
    ext: str | None = None
    kind: str | None = None

    def condition(self, column: str = "path") -> Column:
        """Whether a path passes all predicates."""
        out = F.lit(True)
        if self.path:
            out = out & F.contains(F.lower(column), F.lit(self.path.lower()))
        if self.ext:
            out = out & (paths.extension(column) == self.ext)
        if self.kind:
            out = out & paths.extension(column).isin(*TYPES[self.kind])
        return out


def parse(question: str) -> Parsed:
    """path:, ext: and type: (or =) out of a question; of several the last. What isn't known stays text."""
    found: dict[str, str] = {}
    rest = []
    for word in question.split():
        m = re.fullmatch(r"(path|ext|type)[:=](.+)", word, re.IGNORECASE)
        field, value = (m[1].lower(), m[2]) if m else ("", "")
        if field == "ext":
            found["ext"] = value.lstrip(".").lower()
        elif field == "path":
            found["path"] = value
        elif field == "type" and value.lower() in TYPES:
            found["kind"] = value.lower()
        else:
            rest.append(word)
    return Parsed(" ".join(rest), **found)


def is_broad(question: str) -> bool:
    return any(p in question.lower() for p in BROAD)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def code_intent(question: Column) -> Column:
    """Whether questions ask about code: by a phrase, a snake_case name, or a locator beside a code file or a verb of doing."""
    q = ascii_lower(question)
    snake = question.rlike(r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]{4})[\p{L}\p{N}]*_")
    file = q.rlike(rf"(?<!\S)[^\p{{L}}\p{{N}}\s]*[\p{{L}}\p{{N}}]\S*\.({'|'.join(CODE_EXTENSIONS)})[^\p{{L}}\p{{N}}\s]*(?!\S)")
    among = lambda phrases: F.greatest(*[F.contains(q, F.lit(p)) for p in phrases])
    return snake | among(CODE_TERMS) | (among(LOCATORS) & (file | among(CODE_VERBS)))


def is_code(question: str) -> bool:
    """code_intent of one question."""
    q = "".join(c.lower() if c.isascii() else c for c in question)
    if any(len(w) >= 4 and "_" in w for w in re.findall(r"\w+", question)) or any(t in q for t in CODE_TERMS):
        return True
    bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in q.split()]
    return any(x in q for x in LOCATORS) and (any("." in w and w.rsplit(".", 1)[1] in CODE_EXTENSIONS for w in bare) or any(v in q for v in CODE_VERBS))


def idiom(name: Column) -> Column:
    """Whether symbols are idioms, of which no definition is the right one."""
    n = ascii_lower(name)
    return n.isin(*IDIOMS) | F.greatest(*[F.startswith(n, F.lit(b)) for b in IDIOM_BEGINNINGS])


def is_idiom(name: str) -> bool:
    n = name.lower()
    return n in IDIOMS or n.startswith(IDIOM_BEGINNINGS)


def seconds(duration: str) -> int | None:
    """7d, 12h, 90m or 3600s in seconds; nothing for other texts and for 0."""
    m = re.fullmatch(r"\s*(\d+)\s*([dhms]?)\s*", duration.lower())
    n = int(m[1]) * {"d": 86400, "h": 3600, "m": 60, "s": 1, "": 1}[m[2]] if m else 0
    return n or None
