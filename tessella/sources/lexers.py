"""Declarations, imports, heritage and calls of brace languages, from their tokens and how these nest.

A lexer knows comments, strings with what may stand in them, and preprocessor lines, so nothing in those counts; brackets are
paired, so a declaration's end is known. There is no grammar: what only types could tell apart (a declaration ``T x(1)`` from
a call) is taken by what stands beside it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

_STRING = r'"(?:\\.|[^"\\\n])*"?'
_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_NUMBER = r"\d(?:[\w.]|[eEpP][+-])*"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
#: Signs of several characters that must not be taken apart.
_SIGN = r"=>|->|::|\?\.|\.\.\.|&&|\|\||[=!<>]=|."

#: Strings and characters by language, beside those in double quotes.
_QUOTED = {
    "rust": r"""b?r(?P<hash>#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"?|b?'(?:\\[^\n]*?|[^'\\\n])'""",
    "go": rf"""`[^`]*`?|{_STRING}|'(?:\\.|[^'\\\n])*'?""",
    "java": rf'''""".*?(?:"""|\Z)|{_STRING}|'(?:\\.|[^'\\\n])*'?''',
    "javascript": rf"""{_STRING}|'(?:\\.|[^'\\\n])*'?""",
    "c": rf"""(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{{0,16}})\(.*?\)(?P=mark)"|(?:u8|[uUL])?{_STRING}|(?:[uUL]|u8)?'(?:\\.|[^'\\\n])+'""",
}
_LIFETIME = r"'[^\W\d]\w*"
_DIRECTIVE = r"(?<![^\n])[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*"
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: After these a slash begins a regular expression, not a division.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())

FAMILY = {"rust": "rust", "go": "go", "java": "java", "javascript": "javascript", "typescript": "javascript", "tsx": "javascript", "c": "c", "cpp": "c"}
#: Endings of names by language.
ENDINGS = {
    "rust": "rs", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx c++ hpp hh hxx h++",
}


def _compiled(family: str) -> re.Pattern:
    parts = {"comment": _COMMENTS, "string": _QUOTED[family]}
    if family == "rust":
        parts |= {"life": _LIFETIME}
        parts["comment"] = r"//[^\n]*"
    if family == "c":
        parts = {"directive": _DIRECTIVE} | parts
    parts |= {"number": _NUMBER, "name": _NAME, "sign": _SIGN}
    return re.compile(r"\s+|" + "|".join(f"(?P<{k}>{v})" for k, v in parts.items()), re.DOTALL)


_TOKENS = {f: _compiled(f) for f in set(FAMILY.values())}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int
    #: The place of the bracket that closes this one, or of the one that it closes; None of others and where none does.
    mate: int | None = None


def tokens(text: str, family: str) -> list[Token]:
    """Names, strings, numbers, signs and directives, with brackets paired. Comments are left out; parts of template strings
    in ``${}`` are code, the rest of them is a string."""
    out: list[Token] = []
    pattern, at, templates = _TOKENS[family], 0, []
    depth = 0
    while at < len(text):
        c = text[at]
        if family == "rust" and text.startswith("/*", at):
            at = _nested_comment(text, at)
            continue
        if family == "javascript" and (c == "`" or (c == "}" and templates and templates[-1] == depth)):
            if c == "}":
                templates.pop()
                out.append(Token("sign", "}", at, at + 1))
            end, opens = _template(text, at + 1)
            out.append(Token("string", text[at:end], at, end))
            if opens:
                templates.append(depth)
                out.append(Token("sign", "{", end - 1, end))
            at = end
            continue
        if family == "javascript" and c == "/" and _regex_may_stand(out) and (m := _REGEX.match(text, at)):
            out.append(Token("string", m[0], at, m.end()))
            at = m.end()
            continue
        m = pattern.match(text, at)
        kind = m.lastgroup if m.lastgroup not in ("hash", "mark") else "string"
        if kind and kind != "comment":
            out.append(Token(kind, m[0], at, m.end()))
            depth += {"{": 1, "}": -1}.get(m[0], 0) if kind == "sign" else 0
        at = m.end()
    _pair(out)
    return out


def _nested_comment(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template(text: str, at: int) -> tuple[int, bool]:
    """Where a template's next part ends, and whether code follows."""
    m = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{)?", re.DOTALL).match(text, at)
    return max(m.end(), at), m[1] == "${"


def _regex_may_stand(before: list[Token]) -> bool:
    if not before:
        return True
    t = before[-1]
    return t.text in _BEFORE_REGEX if t.kind == "name" else t.kind == "sign" and t.text not in (")", "]", "}")


def _pair(found: list[Token]) -> None:
    """Brackets by kind: one that nothing closes doesn't hold up those around it."""
    open_ = []
    for i, t in enumerate(found):
        if t.kind != "sign":
            continue
        if t.text in "([{" and len(t.text) == 1:
            open_.append(i)
        elif t.text in ")]}" and len(t.text) == 1:
            want = "([{"[")]}".index(t.text)]
            k = next((k for k in range(len(open_) - 1, -1, -1) if found[open_[k]].text == want), None)
            # A brace closes over unclosed round brackets, not the other way round.
            if k is not None and (want == "{" or all(found[j].text != "{" for j in open_[k + 1 :])):
                t.mate, found[open_[k]].mate = open_[k], i
                del open_[k:]


@dataclass
class Code:
    """symbols: (name, kind, first and last line, first and last character); edges: (kind, name)."""

    symbols: list[tuple[str, str, int, int]] = field(default_factory=list)
    edges: set[tuple[str, str]] = field(default_factory=set)
    #: Characters of the outermost declarations, with the name each goes by.
    parts: list[tuple[str, int, int]] = field(default_factory=list)


#: Words that stand before a bracket without being called, by language.
_NOT_CALLED = {
    "rust": frozenset("if while match for in return let loop else fn struct enum impl where as move ref mut pub use box dyn await Fn FnMut FnOnce".split()),
    "go": frozenset("if for switch select return func go defer range case else type var const import interface struct map chan".split()),
    "java": frozenset("if for while switch catch synchronized try return new this super else do case throw assert instanceof".split()),
    "javascript": frozenset("if for while switch catch return function new this super else do case throw typeof void delete await yield in of import constructor".split()),
    "c": frozenset("if for while switch catch return sizeof alignof alignas decltype typeof new delete else do case throw static_assert defined noexcept operator template using not and or __attribute__".split()),
}
_RUST_MODIFIERS = frozenset("pub async unsafe const extern default crate".split())
_JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized default strictfp transient volatile sealed".split())
_CPP_TAIL = frozenset("const noexcept override final volatile mutable try".split())


class _Reader:
    """One text's tokens, and what they declare."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.t = text, language, tokens(text, FAMILY[language])
        self.starts = [m.end() for m in re.finditer("\n", text)]
        self.out, self.seen, self.nodes = Code(), set(), []
        #: Places where a name before a bracket is no call.
        self.quiet: set[int] = set()
        #: Where the function bodies seen so far end.
        self.body_end = -1
        self.words = _NOT_CALLED[FAMILY[language]]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "string"

    def name(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "name" else ""

    def after(self, i: int) -> int:
        """The place after a bracket's mate, or the end of the text."""
        mate = self.t[i].mate
        return len(self.t) if mate is None or mate < i else mate + 1

    def angled(self, i: int) -> int:
        """The place after type arguments that begin at i, or i itself."""
        if not self.is_(i, "<"):
            return i
        depth = 0
        for k in range(i, min(i + 400, len(self.t))):
            x = self.t[k].text
            depth += {"<": 1, ">": -1, ">=": -1}.get(x, 0)
            if not depth:
                return k + 1
            if x in (";", "{"):
                break
        return i

    def until(self, i: int, *stops: str) -> int:
        """The first of the stops from i on, outside brackets."""
        while i < len(self.t) and not self.is_(i, *stops):
            i = self.after(i) if self.is_(i, "(", "[", "{") else i + 1
        return i

    def node(self, name: str, kind: str, first: int, last: int, symbol: bool = True) -> None:
        """A declaration of tokens first to last: a symbol, once a name, and a part of the text."""
        last = min(last, len(self.t) - 1)
        a, b = self.t[first].at, self.t[last].end
        self.nodes.append((a, b, name))
        if kind == "fn":
            self.body_end = max(self.body_end, b)
        if symbol and name not in self.seen:
            self.seen.add(name)
            self.out.symbols.append((name, kind, self.line(a), self.line(max(a, b - 1))))
            self.out.edges.add(("defines", name))

    def edge(self, kind: str, name: str) -> None:
        if name:
            self.out.edges.add((kind, name))

    def span(self, a: int, b: int) -> str:
        """The text of tokens a to before b."""
        return self.text[self.t[a].at : self.t[b - 1].end].strip() if a < b <= len(self.t) else ""

    def back(self, i: int, words: frozenset) -> int:
        """The place of the first of modifiers before i, with what stands in their brackets."""
        while i:
            if self.name(i - 1) in words or (self.t[i - 1].kind == "string" and self.name(i - 2) == "extern"):
                i -= 1
            elif self.is_(i - 1, ")") and (m := self.t[i - 1].mate) and self.name(m - 1) in words:
                i = m - 1
            else:
                break
        return i

    def body_or(self, i: int, *ends: str) -> int:
        """The last token of a declaration that goes on from i: its body's brace, or one of the ends."""
        k = self.until(i, "{", *ends)
        return self.after(k) - 1 if self.is_(k, "{") else k

    def silence(self, a: int, b: int) -> None:
        self.quiet.update(range(a, min(b, len(self.t))))

    def types(self, i: int, *stops: str) -> Iterator[str]:
        """The plain names in a list of types from i on: none with a qualifier or arguments."""
        while i < len(self.t) and not self.is_(i, *stops):
            k = self.until(i, ",", *stops)
            plain = [self.t[j] for j in range(i, k) if self.name(j) not in ("public", "private", "protected", "virtual")]
            if len(plain) == 1 and plain[0].kind == "name":
                yield plain[0].text
            i = k + 1 if self.is_(k, ",") else k

    def read(self) -> Code:
        scan = {"rust": self.rust, "go": self.go, "java": self.java, "javascript": self.javascript, "c": self.c}[FAMILY[self.language]]
        for i in range(len(self.t)):
            scan(i)
        self.calls()
        end = -1
        for a, b, name in sorted(self.nodes, key=lambda n: (n[0], -n[1])):
            if a >= end:
                self.out.parts.append((name, a, b))
                end = b
        return self.out

    def calls(self) -> None:
        for i, t in enumerate(self.t):
            if t.kind == "name" and len(t.text.encode()) > 1 and self.is_(i + 1, "(") and i not in self.quiet and t.text not in self.words and self.called(i):
                self.edge("calls", t.text)

    def called(self, i: int) -> bool:
        before, after = self.name(i - 1), self.after(i + 1)
        family = FAMILY[self.language]
        if family == "rust":
            # Patterns look like calls.
            return before not in ("fn", "let", "pub") and not self.is_(after, "=>", "|", "if")
        if family == "java":
            return before not in ("new", "record") and not self.is_(i - 1, "@") and not self._java_made(i)
        if family == "javascript":
            return before not in ("function", "new", "get", "set", "static") and not self.is_(after, "=>") and not (self.is_(after, "{") and not self.is_(i - 1, ".", "?.", "=", "(", ",", "return"))
        if family == "c":
            # A name after a name, but for a word of control, is declared with arguments.
            return not (before and before not in self.words and before not in ("co_await", "co_return")) and not self.is_(i - 1, "~")
        return before != "func"

    def _java_made(self, i: int) -> bool:
        """Whether a dotted name is what ``new`` makes."""
        while self.is_(i - 1, ".") and self.name(i - 2):
            i -= 2
        return self.name(i - 1) == "new"

    def rust(self, i: int) -> None:
        word = self.name(i)
        if self.is_(i, "#") and (self.is_(i + 1, "[") or (self.is_(i + 1, "!") and self.is_(i + 2, "["))):
            self.silence(i, self.after(i + 1 if self.is_(i + 1, "[") else i + 2))
        elif word and self.is_(i + 1, "!") and self.is_(i + 2, "(", "[", "{"):
            # What a macro is given has no calls, and no declarations, until it is expanded.
            self.silence(i, self.after(i + 2))
        if i in self.quiet or not word:
            return
        first, named = self.back(i, _RUST_MODIFIERS), self.name(i + 1)
        if word == "fn" and named:
            self.silence(i, i + 2)
            last = self.body_or(i + 2, ";")
            if self.is_(last, "}"):
                self.node(named, "fn", first, last)
        elif word in ("struct", "enum", "trait", "mod") and named:
            last = self.body_or(i + 2, ";")
            if word in ("struct", "enum"):
                self.silence(i, last)
            self.node(named, "module" if word == "mod" else word, first, last)
        elif word in ("const", "static"):
            k = i + 2 if named == "mut" else i + 1
            if self.name(k) and self.is_(k + 1, ":"):
                self.node(self.name(k), word, self.back(i, frozenset(["pub", "crate"])), self.until(k, ";"))
        elif word == "impl" and (not i or self.is_(i - 1, "}", ";", "{", "]") or self.name(i - 1) in ("unsafe", "default")):
            a = self.angled(i + 1)
            body = self.until(a, "{", ";")
            for_ = next((k for k in range(a, body) if self.name(k) == "for" and not self.is_(k + 1, "<")), None)
            where = next((k for k in range(a, body) if self.name(k) == "where"), body)
            sides = [(a, for_), (for_ + 1, where)] if for_ else [(a, where)]
            if for_:
                self.edge("implements", self.span(a, for_))
            plain = next((self.name(x) for x, y in sides if y == x + 1 and self.name(x)), "")
            self.silence(a, body)
            self.node(plain or "impl_item", "impl", first, self.after(body) - 1 if self.is_(body, "{") else body, bool(plain))
        elif word == "use" and (not i or self.is_(i - 1, "}", ";", "{", "]", ")") or self.name(i - 1) == "pub"):
            end = self.until(i, ";")
            stop = next((k for k in range(i + 1, end) if self.name(k) == "as"), end)
            if self.is_(end - 1, "*") and self.is_(end - 2, "::"):
                stop = end - 2
            self.edge("imports", self.span(i + 1, stop))
            self.silence(i, end)

    def go(self, i: int) -> None:
        word = self.name(i)
        if word == "func":
            method = self.is_(i + 1, "(") and self.name(self.after(i + 1)) and self.is_(self.after(i + 1) + 1, "(", "[")
            k = self.after(i + 1) if method else i + 1
            if self.name(k):
                self.silence(i, k + 1)
                end = self.after(self.until(k, "(")) if self.is_(self.until(k, "("), "(") else k
                # A result type may have braces of its own: interface{} and struct{}.
                body = end
                while body < len(self.t) and not (self.is_(body, "{") and self.name(body - 1) not in ("interface", "struct")):
                    if self.is_(body, "{", "(", "["):
                        body = self.after(body)
                    elif self.line(self.t[body].at) > self.line(self.t[body - 1].at):
                        break
                    else:
                        body += 1
                self.node(self.name(k), "method" if method else "fn", i, self.after(body) - 1 if self.is_(body, "{") else body - 1)
        elif word in ("type", "const", "var") and (not i or self.line(self.t[i].at) > self.line(self.t[i - 1].at) or self.is_(i - 1, ";", "{")):
            if self.is_(i + 1, "("):
                last = self.after(i + 1) - 1
            else:
                last = i + 1
                while last < len(self.t) and not (self.line(self.t[last].at) > self.line(self.t[last - 1].end)):
                    last = self.after(last) if self.is_(last, "(", "[", "{") else last + 1
                last -= 1
            if word == "type":
                self.silence(i, last)
            self.node({"type": "type_declaration", "const": "const_declaration", "var": "var_declaration"}[word], "", i, max(last, i), False)
        elif word == "import" and (not i or self.line(self.t[i].at) > self.line(self.t[i - 1].at)):
            inside = range(i + 2, self.after(i + 1)) if self.is_(i + 1, "(") else range(i + 1, min(i + 3, len(self.t)))
            for k in inside:
                if self.t[k].kind == "string":
                    self.edge("imports", self.t[k].text.strip("\"'`"))

    def java(self, i: int) -> None:
        word = self.name(i)
        if self.is_(i, "@") and self.name(i + 1):
            k = i + 1
            while self.is_(k + 1, ".") and self.name(k + 2):
                k += 2
            self.silence(i, k + 1)
        elif word in ("class", "interface", "enum") and self.name(i + 1) and not self.is_(i - 1, ".", "@"):
            head, body = self.angled(i + 2), self.until(i + 2, "{", ";")
            self.node(self.name(i + 1), word, self._java_first(i), self.after(body) - 1 if self.is_(body, "{") else body)
            while head < body:
                k = self.until(head + 1, "extends", "implements", "permits", "{", ";")
                if self.name(head) in ("extends", "implements") and word != "enum":
                    kind = "extends" if word == "interface" else self.name(head)
                    for base in self.types(head + 1, "extends", "implements", "permits", "{", ";"):
                        self.edge(kind, base)
                head = k
        elif word == "import" and (not i or self.is_(i - 1, ";", "}")):
            end = self.until(i, ";")
            a = i + 2 if self.name(i + 1) == "static" else i + 1
            self.edge("imports", self.span(a, end - 2 if self.is_(end - 1, "*") else end))
        elif word and self.is_(i + 1, "(") and i not in self.quiet and word not in self.words:
            after = self.after(i + 1)
            if self.name(after) == "throws":
                after = self.until(after, "{", ";")
            typed = (self.name(i - 1) and self.name(i - 1) not in self.words | {"record"} | _JAVA_MODIFIERS) or self.is_(i - 1, ">", "]")
            if typed and self.is_(after, "{", ";"):
                self.quiet.add(i)
                self.node(word, "method", self._java_first(i), self.after(after) - 1 if self.is_(after, "{") else after)
            elif self.is_(after, "{") and (self.name(i - 1) in _JAVA_MODIFIERS or self.is_(i - 1, "{", "}", ";", ")")):
                # A constructor.
                self.quiet.add(i)

    def _java_first(self, i: int) -> int:
        """The first token of a member or type, its annotations and modifiers with it."""
        while i and not self.is_(i - 1, "{", "}", ";"):
            i -= 1
        return i

    def javascript(self, i: int) -> None:
        word, named = self.name(i), self.name(i + 1)
        if not word or self.is_(i - 1, ".", "?."):
            return
        statement = not i or self.is_(i - 1, "}", ";", "{", ")") or self.name(i - 1) in ("export", "default", "declare", "async", "else") or self.line(self.t[i].at) > self.line(self.t[i - 1].end - 1)
        typed = self.language != "javascript"
        if word == "function" and named:
            last = self.body_or(i + 2, ";")
            if statement and self.is_(last, "}"):
                self.node(named, "fn", i - 1 if self.name(i - 1) == "async" else i, last)
        elif word == "class":
            body = self.until(i + 1, "{", ";")
            declared = named and named not in ("extends", "implements") and statement and self.is_(body, "{")
            self._class_body(body)
            if declared:
                self.node(named, "class", i, self.after(body) - 1)
                head = self.angled(i + 2)
                if self.name(head) == "extends":
                    end = self.until(head + 1, "implements", "{")
                    args = next((k for k in range(head + 1, end) if self.is_(k, "<")), end)
                    if typed or args == head + 2:
                        self.edge("extends", self.span(head + 1, args))
                    head = end
                if typed and self.name(head) == "implements":
                    for base in self.types(head + 1, "{"):
                        self.edge("implements", base)
        elif typed and word == "interface" and named and statement:
            last = self.body_or(i + 2, ";")
            self.silence(i, last)
            self.node(named, "interface", i, last)
        elif typed and word == "type" and named and statement and self.is_(self.angled(i + 2), "="):
            last = self._statement_end(i)
            self.silence(i, last)
            self.node(named, "type", i, last, self.language == "typescript")
        elif word == "import" and statement and not self.is_(i + 1, "(", "."):
            k = next((k for k in range(i + 1, min(self._statement_end(i) + 1, len(self.t))) if self.t[k].kind == "string"), None)
            if k is not None:
                self.edge("imports", self.t[k].text.strip("\"'"))
        elif word in ("const", "let", "var") and statement and (word != "var" or not typed) and not self.is_(i - 1, "("):
            self.node({"var": "variable_declaration"}.get(word, "lexical_declaration"), "", i, self._statement_end(i), False)
        elif word == "export" and statement:
            k = next((k for k in range(i + 1, min(i + 6, len(self.t))) if self.name(k) in ("function", "class", "interface", "enum", "namespace")), None)
            last = self.body_or(k, ";") if k else self._statement_end(i)
            self.node("export_statement", "", i, last, False)

    def _statement_end(self, i: int) -> int:
        """A statement's last token: before a semicolon's end, or before a line that can't go on with it."""
        k = i + 1
        while k < len(self.t):
            if self.is_(k, ";"):
                return k
            if self.is_(k, "}", ")", "]"):
                return k - 1
            if self.line(self.t[k].at) > self.line(self.t[k - 1].end - 1) and not self.is_(k, ".", "?.", "?", ":", "&&", "||", "|", "&", "+", "=", "=>") and not self._goes_on(k - 1):
                return k - 1
            k = self.after(k) if self.is_(k, "(", "[", "{") else k + 1
        return len(self.t) - 1

    def _goes_on(self, k: int) -> bool:
        t = self.t[k]
        return (t.kind == "sign" and t.text not in (")", "]", "}", ">")) or self.name(k) in ("from", "import", "export", "extends", "of", "in")

    def _class_body(self, body: int) -> None:
        """Members' own names are no calls."""
        k, end = body + 1, self.after(body) - 1 if self.is_(body, "{") else 0
        while k < end:
            if self.is_(k + 1, "(", "<") and self.name(k) and (self.is_(k - 1, "{", "}", ";", ",", ")", "*", "#") or self.name(k - 1) in ("static", "async", "get", "set", "public", "private", "protected", "override", "abstract", "readonly") or self.line(self.t[k].at) > self.line(self.t[k - 1].end - 1)):
                self.quiet.add(k)
            k = self.after(k) if self.is_(k, "(", "[", "{") else k + 1

    def c(self, i: int) -> None:
        t, word, named = self.t[i], self.name(i), self.name(i + 1)
        if t.kind == "directive":
            if m := re.match(r"\s*#\s*include\s*(?:<([^>\n]+)>|\"([^\"\n]+)\")", t.text):
                self.edge("imports", m[1] or m[2])
            elif m := re.match(r"\s*#\s*define\s+(\w+)", t.text):
                self.node(m[1], "macro", i, i)
        elif word in ("struct", "enum", "union", "class") and named and not self.is_(i - 1, "<", ","):
            k = i + 2 if named == "class" and word == "enum" else i + 1
            named, head = self.name(k), k + 1
            body = self.until(head, "{", ";", "(", ")", "=")
            if named and self.is_(body, "{") and self.is_(head, "{", ":", "final", "<"):
                self.node(named, word, i, self.after(body) - 1)
                colon = next((j for j in range(head, body) if self.is_(j, ":")), None)
                if colon and word in ("struct", "class") and self.language == "cpp":
                    for base in self.types(colon + 1, "{"):
                        self.edge("extends", base)
        elif word == "namespace" and self.language == "cpp" and named:
            body = self.until(i + 1, "{", ";", "=")
            if self.is_(body, "{"):
                # A name of several parts is no plain name.
                self.node(named if body == i + 2 else "namespace_definition", "module", i, self.after(body) - 1, body == i + 2)
        elif word == "typedef":
            end = self.until(i, ";")
            pointer = next((k for k in range(i, end) if self.is_(k, "(") and self.is_(k + 1, "*")), None)
            named = self.name(pointer + 2) if pointer else next((self.name(k) for k in range(end - 1, i, -1) if self.name(k)), "")
            self.silence(i, end)
            if named:
                self.node(named, "type", i, end)
        elif word and self.is_(i + 1, "(") and word not in self.words and i not in self.quiet:
            self._c_function(i)

    def _c_function(self, i: int) -> None:
        """A function's definition, or outside of bodies its declaration."""
        first = i
        while self.is_(first - 1, "::", "*", "&", "~", ">") or (self.name(first - 1) and self.name(first - 1) not in self.words):
            first = self._angle_before(first - 1) if self.is_(first - 1, ">") else first - 1
        if self.name(first - 1) == "template":
            first -= 1
        after = self.after(i + 1)
        while self.name(after) in _CPP_TAIL or (self.is_(after, "->") and self.language == "cpp"):
            after = self.until(after, "{", ";") if self.is_(after, "->") else self.after(after + 1) if self.is_(after + 1, "(") else after + 1
        member = self.is_(i - 1, ".", "->") or self.name(i - 1) in ("return", "new", "else", "case", "throw")
        if self.is_(after, ":") and self.language == "cpp" and not member:
            after = self._initialised(after)
        if member or not (first < i or self.is_(after, "{")):
            return
        if self.is_(after, "{") and (not first or self.is_(first - 1, "}", ";", "{", ":") or self.t[first - 1].kind == "directive"):
            self.quiet.add(i)
            self.node(self.t[i].text, "fn", first, self.after(after) - 1)
        elif self.is_(after, ";") and first < i and (self.name(i - 1) or self.is_(i - 1, "*", "&")) and (not first or self.is_(first - 1, "}", ";", "{") or self.t[first - 1].kind == "directive"):
            self.quiet.add(i)
            if self.t[i].at > self.body_end:
                self.node(self.t[i].text, "declaration", first, after)

    def _angle_before(self, i: int) -> int:
        """The place where type arguments begin that end at i, or i itself."""
        depth = 0
        for k in range(i, max(i - 400, -1), -1):
            depth += {">": 1, "<": -1}.get(self.t[k].text, 0)
            if not depth:
                return k
        return i

    def _initialised(self, k: int) -> int:
        """After a constructor's initialisers, where its body begins."""
        k += 1
        while self.name(k):
            at = self.until(k, "(", "{")
            k = self.after(at)
            if not self.is_(k, ","):
                break
            k += 1
        return k


def read(text: str, language: str) -> Code:
    """What a text declares, imports, extends and calls. Any text is read to its end: brackets that nothing closes close there."""
    return _Reader(text, language).read()
