"""Declarations of C# source: a lexer and a scanner of declarations that skips bodies. Plain Python; `extract` runs it over Spark rows.

Kinds: class, struct, interface, record, enum, enummember, delegate, method, ctor, property, indexer, event, field. The line is that of the
identifier. What can't be parsed is skipped to the next member; the first such place is the file's error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shipping import ship

PARSER_VERSION = 1
FIELDS = ("kind", "name", "container", "modifiers", "attributes", "bases", "signature", "line")
MODIFIERS = frozenset("public private protected internal static readonly const abstract sealed virtual override extern unsafe volatile new partial async required file fixed ref".split())
SCHEMA = "sha string, ord int, kind string, name string, container string, modifiers string, attributes string, bases string, signature string, line int"
PAIRS = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str  # id, text, number, sign, end
    text: str
    start: int
    end: int


class Declaration(NamedTuple):
    kind: str
    name: str
    container: str
    modifiers: str
    attributes: str
    bases: str
    signature: str
    line: int


# ---------------------------------------------------------------- preprocessor


def condition(text: str, symbols: frozenset[str]) -> bool:
    """An #if expression: ! && || == != and parentheses over symbols, true and false."""
    tokens = re.findall(r"\w+|&&|\|\||==|!=|[!()]", text.split("//")[0])
    at = 0

    def take(*wanted: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at] in wanted:
            at += 1
            return tokens[at - 1]
        return None

    def unary() -> bool:
        nonlocal at
        if take("!"):
            return not unary()
        if take("("):
            v = either()
            take(")")
            return v
        at += 1
        name = tokens[at - 1] if at <= len(tokens) else "false"
        return name == "true" or name in symbols

    def equal() -> bool:
        v = unary()
        while op := take("==", "!="):
            v = (v == unary()) == (op == "==")
        return v

    def both() -> bool:
        v = equal()
        while take("&&"):
            w = equal()
            v = v and w
        return v

    def either() -> bool:
        v = both()
        while take("||"):
            w = both()
            v = v or w
        return v

    return either()


DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*([A-Za-z]+)(.*)$")


def preprocess(source: str, symbols: frozenset[str]) -> str:
    """Directives and inactive lines as blanks; places stay the same."""
    if "#" not in source:
        return source
    out, stack, defined = [], [], set(symbols)
    for line in source.split("\n"):
        m = DIRECTIVE.match(line.rstrip("\r"))
        active = all(s[0] for s in stack)
        if m:
            word, rest = m[1], m[2]
            if word == "if":
                v = active and condition(rest, frozenset(defined))
                stack.append([v, v])
            elif word == "elif" and stack:
                v = not stack[-1][1] and all(s[0] for s in stack[:-1]) and condition(rest, frozenset(defined))
                stack[-1] = [v, stack[-1][1] or v]
            elif word == "else" and stack:
                v = not stack[-1][1] and all(s[0] for s in stack[:-1])
                stack[-1] = [v, True]
            elif word == "endif" and stack:
                stack.pop()
            elif word == "define" and active:
                defined.add(rest.strip())
            elif word == "undef" and active:
                defined.discard(rest.strip())
            out.append(" " * len(line))
        else:
            out.append(line if active else " " * len(line))
    return "\n".join(out)


# ---------------------------------------------------------------- lexer

_PLAIN = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<id>@?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<char>'(?:\\.|[^'\\\n])*'?)|(?P<sign>=>|::|[^\s\w\"$@'])", re.S)
_STRING = re.compile(r'(?P<dollar>\$*)(?P<at>@?)(?P<dollar2>\$*)(?P<quotes>"+)')


def _string_end(s: str, i: int, m: re.Match) -> int:
    """End of the string literal that begins at i."""
    dollars = len(m["dollar"]) + len(m["dollar2"])
    quotes = len(m["quotes"])
    if quotes >= 3 and not m["at"]:  # raw
        fence = '"' * quotes
        j = s.find(fence, m.end())
        if j < 0:
            return len(s)
        j += quotes
        while j < len(s) and s[j] == '"':
            j += 1
        return j
    if quotes == 2 or quotes > 2 and not quotes % 2 and m["at"]:
        return m.start("quotes") + (2 if not m["at"] else quotes)
    j = m.start("quotes") + 1
    while j < len(s):
        c = s[j]
        if c == '"':
            if m["at"] and s[j + 1 : j + 2] == '"':
                j += 2
                continue
            return j + 1
        if c == "\\" and not m["at"]:
            j += 2
            continue
        if c == "{" and dollars:
            if s[j + 1 : j + 2] == "{":
                j += 2
                continue
            j = _hole_end(s, j + 1)
            continue
        if c == "\n" and not m["at"]:
            return j
        j += 1
    return len(s)


def _hole_end(s: str, j: int) -> int:
    """After the brace that closes an interpolation hole; strings in it nest."""
    depth = 1
    while j < len(s) and depth:
        m = _STRING.match(s, j)
        if m:
            j = _string_end(s, j, m)
            continue
        depth += {"{": 1, "}": -1}.get(s[j], 0)
        j += 1
    return j


def lex(source: str) -> list[Token]:
    out, i, n = [], 0, len(source)
    while i < n:
        m = _STRING.match(source, i)
        if m:
            j = _string_end(source, i, m)
            out.append(Token("text", source[i:j], i, j))
            i = j
            continue
        m = _PLAIN.match(source, i)
        if not m:
            i += 1
            continue
        if m.lastgroup:
            out.append(Token({"char": "text"}.get(m.lastgroup, m.lastgroup), m[0], i, m.end()))
        i = m.end()
    out.append(Token("end", "", n, n))
    return out


# ---------------------------------------------------------------- declarations


class Unexpected(Exception):
    pass


class Scanner:
    def __init__(self, source: str, symbols: frozenset[str] = frozenset()):
        self.source = source
        self.tokens = lex(preprocess(source, symbols))
        self.at = 0
        self.found: list[Declaration] = []
        self.error: tuple[int, str] | None = None
        self.breaks = [m.start() for m in re.finditer("\n", source)]

    # -- tokens
    def peek(self, k: int = 0) -> str:
        i = self.at + k
        return self.tokens[i].text if i < len(self.tokens) else ""

    def kind(self, k: int = 0) -> str:
        i = self.at + k
        return self.tokens[i].kind if i < len(self.tokens) else "end"

    def next(self) -> Token:
        t = self.tokens[self.at]
        if t.kind != "end":
            self.at += 1
        return t

    def expect(self, text: str) -> Token:
        if self.peek() != text:
            raise Unexpected(f"'{text}' expected")
        return self.next()

    def identifier(self) -> Token:
        if self.kind() != "id":
            raise Unexpected("identifier expected")
        return self.next()

    def line_of(self, offset: int) -> int:
        import bisect

        return bisect.bisect_left(self.breaks, offset) + 1

    def between(self, first: int, after: int) -> str:
        """Source of the tokens from first up to, not including, after."""
        return self.source[self.tokens[first].start : self.tokens[after - 1].end] if after > first else ""

    def balanced(self) -> None:
        """Past the bracket that closes the one here."""
        todo = [PAIRS[self.next().text]]
        while todo:
            t = self.next()
            if t.kind == "end":
                raise Unexpected(f"'{todo[-1]}' expected")
            if t.kind != "sign":
                continue
            if t.text in PAIRS:
                todo.append(PAIRS[t.text])
            elif t.text in ")]}":
                while todo and todo[-1] != t.text:
                    todo.pop()
                if todo:
                    todo.pop()

    def until(self, *stops: str) -> None:
        """To the first of the stops that no bracket holds."""
        while self.kind() != "end" and not (self.kind() == "sign" and self.peek() in stops):
            if self.kind() == "sign" and self.peek() in PAIRS:
                self.balanced()
            elif self.kind() == "sign" and self.peek() in (")", "]", "}"):
                return
            else:
                self.next()

    def angles(self) -> int:
        """Past a list in angle brackets; the number of its parts."""
        self.expect("<")
        depth, parts = 1, 1
        while depth:
            t = self.peek()
            if self.kind() == "end" or t in (";", "{", "}"):
                raise Unexpected("'>' expected")
            if self.kind() == "sign" and t in ("(", "["):
                self.balanced()
                continue
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif t == "," and depth == 1:
                parts += 1
            self.next()
        return parts

    # -- pieces
    def type(self) -> str:
        first = self.at
        while self.peek() in ("ref", "readonly", "scoped"):
            self.next()
        if self.peek() == "(":
            self.balanced()
        else:
            self.identifier()
            while True:
                if self.peek() == "<":
                    self.angles()
                if self.peek() in (".", "::") and self.kind(1) == "id":
                    self.next()
                    self.next()
                    continue
                break
        while True:
            if self.peek() in ("?", "*"):
                self.next()
            elif self.peek() == "[" and re.fullmatch(r"\[,*\]", self._bracket()):
                self.balanced()
            else:
                return self.between(first, self.at)

    def _bracket(self) -> str:
        k, out = 0, ""
        while self.peek(k) in ("[", ","):
            out, k = out + self.peek(k), k + 1
        return out + self.peek(k)

    def attributes(self) -> list[str]:
        names = []
        while self.peek() == "[":
            self.next()
            while self.peek() != "]":
                if self.kind() == "id" and self.peek(1) == ":":
                    self.next()
                    self.next()
                first = self.at
                self.identifier()
                while self.peek() in (".", "::"):
                    self.next()
                    self.identifier()
                if self.peek() == "<":
                    self.angles()
                names.append(self.between(first, self.at))
                if self.peek() == "(":
                    self.balanced()
                if self.peek() == ",":
                    self.next()
                elif self.peek() != "]":
                    raise Unexpected("']' expected")
            self.next()
        return names

    def parameters(self, close: str) -> str:
        """After the opening bracket, past the closing one: types, comma-joined."""
        types = []
        while self.peek() != close:
            if self.kind() == "end":
                raise Unexpected(f"'{close}' expected")
            self.attributes()
            while self.peek() in ("ref", "out", "in", "params", "this", "scoped", "readonly"):
                self.next()
            first = self.at
            try:
                text = self.type()
                types.append(text if self.kind() == "id" else "?")
            except Unexpected:
                if self.at == first and self.peek() not in (",", close):
                    self.next()
                types.append("?")
            self.until(",", close)
            if self.peek() == ",":
                self.next()
            elif self.peek() != close:
                raise Unexpected(f"'{close}' expected")
        self.next()
        return ",".join(types)

    def body(self) -> None:
        """Past a body, an expression and semicolon, or a semicolon."""
        self.until("{", "=>", ";")
        if self.peek() == "{":
            self.balanced()
        elif self.peek() == "=>":
            self.until(";")
            self.semicolon()
        else:
            self.semicolon()

    def semicolon(self) -> None:
        self.expect(";")

    # -- declarations
    def emit(self, kind: str, name: str, container: list[str], modifiers: list[str], attributes: list[str], bases: str, signature: str, token: Token) -> None:
        clean = lambda s: s.replace("\t", " ").replace("\r", "").replace("\n", " ")
        self.found.append(Declaration(kind, clean(name), ".".join(container), " ".join(modifiers), clean(",".join(attributes)), clean(bases), clean(signature), self.line_of(token.start)))

    def fail(self, why: Unexpected) -> None:
        if self.error is None:
            self.error = (self.line_of(self.tokens[self.at].start), str(why))

    def scan(self) -> list[Declaration]:
        self.members([], None)
        return self.found

    def members(self, container: list[str], owner: str | None) -> None:
        """Up to the closing brace of the owner, or the end."""
        while self.kind() != "end":
            if self.peek() == "}":
                if container:
                    return
                self.next()
                continue
            before = self.at
            try:
                self.member(container, owner)
            except Unexpected as why:
                self.fail(why)
                if self.at == before:
                    self.next()
                self.until(";", "{")
                if self.peek() == "{":
                    try:
                        self.balanced()
                    except Unexpected:
                        return
                elif self.peek() == ";":
                    self.next()

    def braces(self, container: list[str], owner: str | None) -> None:
        self.expect("{")
        self.members(container, owner)
        self.expect("}")
        if self.peek() == ";":
            self.next()

    def member(self, container: list[str], owner: str | None) -> None:
        if self.peek() == ";":
            self.next()
            return
        attributes = self.attributes()
        modifiers: list[str] = []
        while self.peek() in MODIFIERS and (self.kind(1) == "id" or self.peek(1) in ("(", "~")) and not (self.peek() == "ref" and self.peek(1) not in ("struct", "partial")):
            modifiers.append(self.next().text)
        word = self.peek()
        if word == "namespace":
            self.next()
            first = self.at
            self.identifier()
            while self.peek() == ".":
                self.next()
                self.identifier()
            name = self.between(first, self.at)
            if self.peek() == ";":
                self.next()
                self.members([*container, name], None)
            else:
                self.braces([*container, name], None)
        elif owner is None and word in ("using", "extern", "global", "assembly") and self.kind(1) in ("id", "sign") and word != "assembly":
            self.until(";")
            self.semicolon()
        elif word in ("class", "struct", "interface") or word == "record" and self.kind(1) == "id":
            self.type_declaration(container, modifiers, attributes)
        elif word == "enum":
            self.enum(container, modifiers, attributes)
        elif word == "delegate" and self.peek(1) != "*":
            self.next()
            result = self.type()
            name = self.identifier()
            if self.peek() == "<":
                self.angles()
            self.expect("(")
            self.emit("delegate", name.text, container, modifiers, attributes, "", f"{result} ({self.parameters(')')})", name)
            self.until(";")
            self.semicolon()
        elif word == "event":
            self.next()
            text = self.type()
            self.event(container, modifiers, attributes, text)
        elif word == "~":
            self.until("(")
            self.balanced()
            self.body()
        elif word in ("implicit", "explicit") and self.peek(1) == "operator":
            self.operator()
        elif owner is not None and word == owner and self.peek(1) == "(":
            name = self.next()
            self.next()
            self.emit("ctor", name.text, container, modifiers, attributes, "", f"({self.parameters(')')})", name)
            self.body()
        else:
            self.typed(container, modifiers, attributes)

    def operator(self) -> None:
        while self.peek() != "(" and self.kind() != "end":
            self.next()
        if self.peek(1) == ")" and self.peek(2) == "(":
            self.next()
            self.next()
        self.balanced()
        self.body()

    def type_declaration(self, container: list[str], modifiers: list[str], attributes: list[str]) -> None:
        kind = self.next().text
        if kind == "record" and self.peek() in ("struct", "class"):
            self.next()
        token = self.identifier()
        name = token.text
        if self.peek() == "<":
            name += f"`{self.angles()}"
        if self.peek() == "(":
            self.balanced()
        bases = []
        if self.peek() == ":":
            self.next()
            while True:
                bases.append(self.type())
                if self.peek() == "(":
                    self.balanced()
                if self.peek() != ",":
                    break
                self.next()
        self.emit(kind, name, container, modifiers, attributes, ",".join(bases), "", token)
        self.until("{", ";")
        if self.peek() == ";":
            self.next()
        else:
            self.braces([*container, name], token.text)

    def enum(self, container: list[str], modifiers: list[str], attributes: list[str]) -> None:
        self.next()
        token = self.identifier()
        bases = ""
        if self.peek() == ":":
            self.next()
            bases = self.type()
        self.emit("enum", token.text, container, modifiers, attributes, bases, "", token)
        self.expect("{")
        while self.peek() != "}":
            names = self.attributes()
            member = self.identifier()
            self.emit("enummember", member.text, [*container, token.text], [], names, "", "", member)
            self.until(",", "}")
            if self.peek() == ",":
                self.next()
        self.next()

    def event(self, container: list[str], modifiers: list[str], attributes: list[str], text: str) -> None:
        while self.peek(1) == "." or self.peek(1) == "<":  # the prefix of an explicit interface isn't part of the name
            self.next()
            if self.peek() == "<":
                self.angles()
            self.expect(".")
        while True:
            name = self.identifier()
            self.emit("event", name.text, container, modifiers, attributes, "", text, name)
            if self.peek() == "{":
                self.balanced()
                return
            self.until(",", ";")
            if self.next().text != ",":
                return

    def typed(self, container: list[str], modifiers: list[str], attributes: list[str]) -> None:
        """Methods, properties, indexers, operators, fields: a type comes first."""
        text = self.type()
        if self.peek() == "operator":
            self.operator()
            return
        first = self.at
        prefix = ""
        while True:
            if self.peek() == "this":
                token = self.next()
                self.expect("[")
                self.emit("indexer", "this", container, modifiers, attributes, "", f"{text} [{self.parameters(']')}]", token)
                self.body()
                return
            if self.peek() == "operator":
                self.operator()
                return
            token = self.identifier()
            generic_at = self.at
            if self.peek() == "<":
                self.angles()
            if self.peek() not in (".", "::"):
                break
            self.next()
            prefix = self.between(first, self.at)
        if self.peek() == "(":
            self.next()
            self.emit("method", prefix + token.text, container, modifiers, attributes, "", f"{text} ({self.parameters(')')})", token)
            self.body()
        elif self.peek() in ("{", "=>") and generic_at == self.at:
            self.emit("property", prefix + token.text, container, modifiers, attributes, "", text, token)
            brace = self.peek() == "{"
            self.body()
            if brace and self.peek() == "=":
                self.until(";")
                self.semicolon()
        elif self.peek() in ("=", ",", ";", "["):
            while True:
                self.emit("field", token.text, container, modifiers, attributes, "", text, token)
                self.field_value()
                if self.next().text != ",":
                    return
                token = self.identifier()
        else:
            raise Unexpected("member expected")

    def field_value(self) -> None:
        """Past an initialiser. A comma in angle brackets belongs to a generic name if a name follows and a bracket closes."""
        while self.kind() != "end" and self.peek() not in (",", ";"):
            if self.peek() == "<" and self.kind(-1) == "id":
                at = self.at
                try:
                    self.angles()
                    if self.peek() in ("(", ".", "{", ")", "[", ">", ",", ";", "::", "?"):
                        continue
                except Unexpected:
                    pass
                self.at = at + 1
            elif self.kind() == "sign" and self.peek() in PAIRS:
                self.balanced()
            elif self.peek() in (")", "]", "}"):
                raise Unexpected("';' expected")
            else:
                self.next()
        if self.kind() == "end":
            raise Unexpected("';' expected")


def parse(source: str, symbols: frozenset[str] = frozenset()) -> tuple[list[Declaration], tuple[int, str] | None]:
    """Declarations, and line and text of the first error."""
    scanner = Scanner(source, symbols)
    scanner.scan()
    return scanner.found, scanner.error


def extract(blobs: DataFrame, symbols: list[str]) -> DataFrame:
    """blobs: sha, text. Declarations of each content in order, parsed with all symbols defined."""
    ship(blobs.sparkSession)
    defined = frozenset(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(sha, i, *d) for sha, text in zip(b.column("sha").to_pylist(), b.column("text").to_pylist(), strict=True) for i, d in enumerate(parse(text or "", defined)[0])]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 10
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 7, pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sha", "ord", *FIELDS])

    return blobs.select("sha", "text").mapInArrow(run, SCHEMA)


def errors(blobs: DataFrame, symbols: list[str]) -> DataFrame:
    """sha, line, message of the first error of each content that has one."""
    ship(blobs.sparkSession)
    defined = frozenset(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(sha, e) for sha, text in zip(b.column("sha").to_pylist(), b.column("text").to_pylist(), strict=True) if (e := parse(text or "", defined)[1])]
            yield pa.record_batch([pa.array([g[0] for g in got], pa.string()), pa.array([g[1][0] for g in got], pa.int32()), pa.array([g[1][1] for g in got], pa.string())], ["sha", "line", "message"])

    return blobs.select("sha", "text").mapInArrow(run, "sha string, line int, message string")
