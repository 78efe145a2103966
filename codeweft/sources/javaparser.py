"""A tolerant parser for Java declarations and the calls in method bodies.

It reads tokens and matches brackets; it does not check the language. What it cannot read it skips up
to the next member, and the file's status is then ``partial``. Result of :func:`parse`: a dict with
``package``, ``imports``, flat lists ``types``, ``fields``, ``methods``, ``refs``, ``texts`` and ``errors``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r'(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<block>"""(?:\\.|[^\\])*?""")|(?P<string>"(?:\\.|[^"\\\n])*")'
    r"|(?P<char>'(?:\\.|[^'\\\n])+')|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<sign>->|::|\.\.\.|.)",
    re.S,
)
MODIFIERS = {
    "public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp",
    "default", "sealed",
}
KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "new", "super", "this", "try", "assert", "else", "do", "case"}
PRIMITIVES = {"int", "long", "double", "float", "boolean", "char", "byte", "short", "var"}
STATEMENT_WORDS = NOT_CALLS | {"break", "continue", "yield", "instanceof", "package", "import", "throws", "extends", "implements"}
#: What a backslash and a sign stand for in a literal, where it is not the sign itself.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Unreadable(Exception):
    pass


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Place:
    """What encloses a member."""

    fqn: str
    package: str


class Parser:
    def __init__(self, path: str, source: str) -> None:
        self.path, self.source = path, source
        self.tokens = [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(source) if m.lastgroup not in ("space", "comment")]
        self.lines = [0, *(i + 1 for i, c in enumerate(source) if c == "\n")]
        self.i = 0
        self.errors: list[str] = []
        self.package = ""
        self.imports: list[dict] = []
        self.types: list[dict] = []
        self.fields: list[dict] = []
        self.methods: list[dict] = []
        self.refs: list[dict] = []

    # -- tokens ---------------------------------------------------------------------------

    def line(self, offset: int) -> int:
        lo, hi = 0, len(self.lines)
        while hi - lo > 1:
            middle = (lo + hi) // 2
            lo, hi = (middle, hi) if self.lines[middle] <= offset else (lo, middle)
        return lo + 1

    def peek(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.tokens[k].text if k < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.tokens[k].kind if k < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> Token:
        if self.i >= len(self.tokens) or (wanted is not None and self.tokens[self.i].text != wanted):
            raise Unreadable(f"expected {wanted or 'a token'} at line {self.line(self.tokens[min(self.i, len(self.tokens) - 1)].start) if self.tokens else 1}")
        self.i += 1
        return self.tokens[self.i - 1]

    def name(self) -> str:
        if self.kind() != "name":
            raise Unreadable(f"expected a name, found {self.peek()!r}")
        return self.take().text

    def closing(self, at: int) -> int:
        """Place of the bracket that closes the one at ``at``."""
        stack = []
        for k in range(at, len(self.tokens)):
            t = self.tokens[k].text
            if self.tokens[k].kind != "sign":
                continue
            if t in OPEN:
                stack.append(OPEN[t])
            elif t in CLOSE:
                if not stack or stack.pop() != t:
                    raise Unreadable(f"bracket {t} does not match at line {self.line(self.tokens[k].start)}")
                if not stack:
                    return k
        raise Unreadable(f"bracket of line {self.line(self.tokens[at].start)} is not closed")

    def text(self, a: int, b: int) -> str:
        """Source of tokens a..b with each run of white space as one blank."""
        return re.sub(r"\s+", " ", self.source[self.tokens[a].start : self.tokens[b - 1].end]).strip() if b > a else ""

    def location(self, a: int, b: int) -> dict:
        start, end = self.tokens[a].start, self.tokens[min(b, len(self.tokens)) - 1].end
        return {"relative_path": self.path, "line_start": self.line(start), "line_end": self.line(max(start, end - 1)), "byte_start": len(self.source[:start].encode()), "byte_end": len(self.source[:end].encode())}

    # -- pieces ---------------------------------------------------------------------------

    def skip_angles(self) -> None:
        depth = 0
        while True:
            t = self.take().text
            depth += (t == "<") - (t == ">")
            if depth <= 0:
                return
            if t in ";{}":
                raise Unreadable("type arguments are not closed")

    def type_parameters(self) -> list[str]:
        if self.peek() != "<":
            return []
        a = self.i
        self.skip_angles()
        out, depth, start = [], 0, a + 1
        for k in range(a + 1, self.i):
            t = self.tokens[k].text
            if (t == "," and depth == 0) or k == self.i - 1:
                out.append(self.text(start, k))
                start = k + 1
            depth += (t == "<") - (t == ">")
        return [x for x in out if x]

    def type_text(self) -> str:
        """A type with arguments, arrays and varargs, as written."""
        a = self.i
        while self.peek() == "@":
            self.annotation()
        a = self.i
        self.name()
        while True:
            if self.peek() == "<":
                self.skip_angles()
            elif self.peek() == "." and self.kind(1) == "name":
                self.i += 2
            elif self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
            elif self.peek() == "...":
                self.i += 1
            else:
                return self.text(a, self.i)

    def annotation(self) -> dict:
        self.take("@")
        parts = [self.name()]
        while self.peek() == "." and self.kind(1) == "name":
            self.i += 1
            parts.append(self.name())
        arguments, words, texts = None, [], []
        if self.peek() == "(":
            end = self.closing(self.i)
            arguments = self.text(self.i, end + 1)
            words, texts = self.words(self.i + 1, end), [t.text.strip('"') for t in self.tokens[self.i : end] if t.kind in ("string", "block")]
            self.i = end + 1
        return {"name": ".".join(parts), "arguments_text": arguments, "words": words, "texts": texts}

    def words(self, a: int, b: int) -> list[str]:
        """Dotted names among tokens a..b, ``.class`` included."""
        out: list[str] = []
        for k in range(a, b):
            if self.tokens[k].kind == "name":
                if k > a + 1 and self.tokens[k - 1].text == "." and self.tokens[k - 2].kind == "name":
                    out[-1] += "." + self.tokens[k].text
                else:
                    out.append(self.tokens[k].text)
        return out

    # -- literals -------------------------------------------------------------------------

    def run(self, k: int, end: int) -> tuple[str, int]:
        """(text of the literals joined by plus signs from token ``k`` on, place behind them).

        The pieces are stripped and joined by one blank; a text block stands alone.
        """
        if self.tokens[k].kind == "block":
            return self.tokens[k].text[3:-3].strip(), k + 1
        pieces = []
        while k < end and self.tokens[k].kind == "string":
            pieces.append(self.tokens[k].text[1:-1].strip())
            k += 1
            if k + 1 < end and self.tokens[k].text == "+" and self.tokens[k + 1].kind == "string":
                k += 1
            else:
                break
        joined, out, at = " ".join(pieces), [], 0
        while at < len(joined):
            if joined[at] == "\\" and at + 1 < len(joined):
                at += 1
                out.append(ESCAPES.get(joined[at], joined[at]))
            else:
                out.append(joined[at])
            at += 1
        return "".join(out).strip(), k

    def literals(self) -> list[dict]:
        """``text, line, origin`` of each run of literals; what a query annotation holds is found once, as its query."""
        out, k, n = [], 0, len(self.tokens)
        while k < n:
            t = self.tokens[k]
            if t.text == "@" and k + 2 < n and self.tokens[k + 1].text == "Query" and self.tokens[k + 2].text == "(":
                try:
                    end = self.closing(k + 2)
                except Unreadable:
                    k += 1
                    continue
                first = k + 5 if [x.text for x in self.tokens[k + 3 : k + 5]] == ["value", "="] else k + 3
                if first < end and self.tokens[first].kind in ("string", "block"):
                    text, _ = self.run(first, end)
                    rest = [x.text for x in self.tokens[first:end]]
                    native = any(rest[i : i + 3] == ["nativeQuery", "=", "true"] for i in range(len(rest)))
                    out.append({"text": text, "line": self.line(t.start), "origin": "jpa-query-native" if native else "jpa-query"})
                    k = end + 1
                    continue
            if t.kind in ("string", "block"):
                text, after = self.run(k, n)
                out.append({"text": text, "line": self.line(t.start), "origin": "java-literal"})
                k = after
                continue
            k += 1
        return out

    def modifiers(self) -> tuple[list[str], list[dict]]:
        words, notes = [], []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                notes.append(self.annotation())
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                words.append(self.take().text)
            elif self.peek() == "non" and self.peek(1) == "-":
                self.i += 3
                words.append("non-sealed")
            else:
                return words, notes

    def type_list(self) -> list[str]:
        out = [self.type_text()]
        while self.peek() == ",":
            self.i += 1
            out.append(self.type_text())
        return out

    # -- declarations ---------------------------------------------------------------------

    def unit(self) -> None:
        while self.i < len(self.tokens):
            start = self.i
            try:
                if self.peek() == ";":
                    self.i += 1
                    continue
                if self.peek() == "import":
                    self.import_line()
                    continue
                words, notes = self.modifiers()
                if self.peek() == "package":
                    self.i += 1
                    self.package = self.dotted()
                    self.take(";")
                    continue
                self.declaration(start, words, notes, Place("", self.package))
            except Unreadable as e:
                self.errors.append(str(e))
                self.i = max(self.i, start + 1)
                while self.i < len(self.tokens) and self.peek() not in KINDS and self.peek() not in ("import", "@"):
                    self.i += 1

    def dotted(self) -> str:
        parts = [self.name()]
        while self.peek() == "." and self.kind(1) == "name":
            self.i += 1
            parts.append(self.name())
        return ".".join(parts)

    def import_line(self) -> None:
        self.take("import")
        static = self.peek() == "static" and bool(self.take())
        name = self.dotted()
        wildcard = self.peek() == "." and self.peek(1) == "*"
        if wildcard:
            self.i += 2
        self.take(";")
        self.imports.append({"relative_path": self.path, "fqn": name, "static": static, "wildcard": wildcard, "ordinal": len(self.imports)})

    def is_type(self) -> bool:
        if self.peek() == "@" and self.peek(1) == "interface":
            return True
        return self.peek() in KINDS and self.kind(1) == "name" and (self.peek() != "record" or self.peek(2) in ("(", "<"))

    def declaration(self, start: int, words: list[str], notes: list[dict], place: Place) -> None:
        """A type with all its members."""
        if not self.is_type():
            raise Unreadable(f"expected a type, found {self.peek()!r}")
        if self.peek() == "@":
            self.i += 2
            kind = "annotation"
        else:
            kind = KINDS[self.take().text]
        name = self.name()
        fqn = f"{place.fqn}.{name}" if place.fqn else (f"{self.package}.{name}" if self.package else name)
        own = {
            "fqn": fqn, "name": name, "kind": kind, "package": self.package, "enclosing_fqn": place.fqn or None, "modifiers": words, "annotations": notes,
            "type_parameters": self.type_parameters(), "extends": [], "implements": [],
        }
        self.types.append(own)
        inner = Place(fqn, self.package)
        if kind == "record":
            for p in self.parameters():
                self.fields.append({"fqn": f"{fqn}#{p['name']}", "owner_fqn": fqn, "name": p["name"], "type_text": p["type_text"], "modifiers": ["private", "final"], "annotations": [], "location": self.location(self.i - 1, self.i)})
        while self.peek() in ("extends", "implements", "permits"):
            word = self.take().text
            found = self.type_list()
            if word != "permits":
                own[word] += found
        body = self.i
        try:
            end = self.closing(body) if self.peek() == "{" else None
        except Unreadable as e:
            self.errors.append(str(e))
            end = len(self.tokens)
        if end is None:
            raise Unreadable(f"type {name} has no body")
        own["location"] = self.location(start, min(end + 1, len(self.tokens)))
        self.i = body + 1
        if kind == "enum":
            self.constants(inner, end)
        while self.i < min(end, len(self.tokens)):
            at = self.i
            try:
                self.member(inner, kind, end)
            except Unreadable as e:
                self.errors.append(str(e))
                self.recover(at, end)
        self.i = min(end + 1, len(self.tokens))

    def recover(self, at: int, end: int) -> None:
        """Go on behind the next semicolon or block."""
        self.i = max(self.i, at + 1)
        while self.i < min(end, len(self.tokens)):
            t = self.take().text
            if t == ";":
                return
            if t == "{":
                try:
                    self.i = self.closing(self.i - 1) + 1
                except Unreadable:
                    continue
                return

    def constants(self, place: Place, end: int) -> None:
        while self.i < end and self.peek() != ";":
            at = self.i
            self.modifiers()
            if self.kind() != "name":
                return
            name = self.name()
            for bracket in "({":
                if self.peek() == bracket:
                    self.i = self.closing(self.i) + 1
            self.fields.append({"fqn": f"{place.fqn}#{name}", "owner_fqn": place.fqn, "name": name, "type_text": place.fqn.rsplit(".", 1)[-1], "modifiers": ["public", "static", "final"], "annotations": [], "location": self.location(at, self.i)})
            if self.peek() == ",":
                self.i += 1

    def member(self, place: Place, kind: str, end: int) -> None:
        if self.peek() == ";":
            self.i += 1
            return
        start = self.i
        words, notes = self.modifiers()
        if self.is_type():
            self.declaration(start, words, notes, place)
            return
        if self.peek() == "{":  # initialiser
            self.i = self.closing(self.i) + 1
            return
        parameters = self.type_parameters()
        simple = place.fqn.rsplit(".", 1)[-1]
        if self.peek() == simple and self.peek(1) in ("(", "{"):
            self.i += 1
            self.method(place, start, words, notes, parameters, simple, None, "constructor", compact=self.peek() == "{")
            return
        result = self.type_text()
        name = self.name()
        if self.peek() == "(":
            self.method(place, start, words, notes, parameters, name, result, "method")
            return
        while True:  # fields: one row for each declarator
            suffix = ""
            while self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
                suffix += "[]"
            if self.peek() == "=":
                while self.peek() not in (",", ";"):
                    if self.i >= end:
                        raise Unreadable(f"field {name} has no end")
                    if self.peek() == "<" and self.angles_ahead():
                        self.skip_angles()
                    else:
                        self.i = self.closing(self.i) + 1 if self.peek() in OPEN else self.i + 1
            self.fields.append({"fqn": f"{place.fqn}#{name}", "owner_fqn": place.fqn, "name": name, "type_text": result + suffix, "modifiers": words, "annotations": notes, "location": self.location(start, self.i + 1)})
            if self.peek() == ",":
                self.i += 1
                name = self.name()
                continue
            self.take(";")
            return

    def angles_ahead(self) -> bool:
        """Whether the sign ``<`` here opens type arguments."""
        k, depth = self.i, 0
        while k < len(self.tokens):
            t = self.tokens[k]
            depth += (t.text == "<") - (t.text == ">")
            if depth == 0:
                return True
            if t.kind not in ("name",) and t.text not in "<>,.?&[]":
                return False
            k += 1
        return False

    def parameters(self) -> list[dict]:
        end = self.closing(self.i)
        self.i += 1
        out: list[dict] = []
        while self.i < end:
            self.modifiers()
            kind = self.type_text()
            while self.peek() == "." or self.peek() == "this":  # receiver parameter
                self.i += 1
            if self.i >= end or self.peek() == ",":
                self.i += 1
                continue
            name = self.name()
            while self.peek() == "[":
                self.i += 2
                kind += "[]"
            out.append({"name": name, "type_text": kind, "index": len(out), "varargs": kind.endswith("...")})
            if self.i < end:
                self.take(",")
        self.i = end + 1
        return out

    def method(self, place: Place, start: int, words, notes, parameters, name, result, kind, compact: bool = False) -> None:
        args = [] if compact else self.parameters()
        while self.peek() == "[":
            self.i += 2
            result += "[]"
        throws = []
        if self.peek() == "throws":
            self.i += 1
            throws = self.type_list()
        fqn = f"{place.fqn}#{name}({','.join(p['type_text'] for p in args)})"
        body = None
        if self.peek() == "{":
            body, end = self.i, self.closing(self.i)
            self.i = end + 1
        else:
            while self.peek() not in (";", ""):  # default value of an annotation's element
                self.i = self.closing(self.i) + 1 if self.peek() in OPEN else self.i + 1
            self.take(";")
        self.methods.append(
            {"fqn": fqn, "owner_fqn": place.fqn, "name": name, "kind": kind, "return_type": result, "parameters": args, "throws": throws, "modifiers": words, "annotations": notes, "type_parameters": parameters, "location": self.location(start, self.i)}
        )
        if body is not None:
            self.body(fqn, body, end)

    # -- bodies ---------------------------------------------------------------------------

    def arguments(self, at: int) -> tuple[int, str | None, int]:
        """(number of arguments, first one if a string literal, place of the closing bracket)."""
        end = self.closing(at)
        if end == at + 1:
            return 0, None, end
        count, k = 1, at + 1
        while k < end:
            t = self.tokens[k].text
            if t in OPEN and self.tokens[k].kind == "sign":
                k = self.closing(k)
            elif t == "<":
                keep, self.i = self.i, k
                if self.angles_ahead():
                    self.skip_angles()
                    k = self.i - 1
                self.i = keep
            elif t == ",":
                count += 1
            k += 1
        first = next((t for t in self.tokens[at + 1 : end] if t.kind in ("string", "block")), None)
        direct = first is not None and self.tokens[at + 1] is first
        return count, (first.text.strip('"').strip() if direct else None), end

    def receiver(self, at: int, floor: int) -> str | None:
        """Source of what stands before the dot in front of token ``at``."""
        k = at - 1
        if k < floor or self.tokens[k].text != ".":
            return None
        k -= 1
        start = k
        while k >= floor:
            t = self.tokens[k]
            if t.text in (")", "]") and t.kind == "sign":
                depth, j = 0, k
                while j >= floor:
                    x = self.tokens[j]
                    if x.kind == "sign":
                        depth += (x.text in ")]") - (x.text in "([")
                    if depth == 0:
                        break
                    j -= 1
                start, k = j, j - 1
                if k >= floor and self.tokens[k].kind == "name":
                    start, k = k, k - 1
            elif t.kind in ("name", "string", "block"):
                start, k = k, k - 1
            else:
                break
            if k >= floor and self.tokens[k].text == ".":
                k -= 1
                continue
            if k >= floor and self.tokens[k].text == "new":
                start = k
            break
        return self.text(start, at - 1)

    def body(self, fqn: str, a: int, b: int) -> None:
        """Calls, creations, local variables and catches, the last first; named nested types are left out."""
        found: list[dict] = []

        def add(kind, name, at, receiver=None, count=None, type_text=None, literal=None):
            found.append({"method_fqn": fqn, "kind": kind, "name": name, "receiver_text": receiver, "arg_count": count, "type_text": type_text, "line": self.line(self.tokens[at].start), "first_string_arg": literal})

        k = a + 1
        keep = self.i
        while k < b:
            t = self.tokens[k]
            if t.kind == "name" and t.text in KINDS and self.tokens[k + 1].kind == "name" and self.tokens[k - 1].text != "." and self.tokens[k + 2].text in ("{", "<", "(", "extends", "implements"):
                while k < b and self.tokens[k].text != "{":
                    k += 1
                k = self.closing(k) + 1
                continue
            if t.text == "new" and self.tokens[k + 1].kind == "name":
                self.i = k + 1
                try:
                    kind = self.type_text()
                except Unreadable:
                    k += 1
                    continue
                if self.peek() == "(":
                    count, literal, _ = self.arguments(self.i)
                    add("create", re.sub(r"<.*>", "", kind, flags=re.S), k, count=count, type_text=kind, literal=literal)
                k = self.i
                continue
            if t.text == "catch" and self.tokens[k + 1].text == "(":
                end = self.closing(k + 1)
                add("catch", self.tokens[end - 1].text, k, type_text=self.text(k + 2, end - 1).removeprefix("final ").strip())
                k = end + 1
                continue
            if t.kind == "name" and self.tokens[k + 1].text == "(" and t.text not in NOT_CALLS:
                count, literal, end = self.arguments(k + 1)
                if self.tokens[end + 1].text in ("{", "throws"):  # a method of an anonymous class
                    k = end + 1
                    continue
                add("call", t.text, k, receiver=self.receiver(k, a + 1), count=count, literal=literal)
            elif t.kind == "name" and self.tokens[k - 1].text in ("{", "}", ";", "final") and t.text not in STATEMENT_WORDS:
                self.i = k
                try:
                    kind = self.type_text()
                    if self.kind() == "name" and self.peek(1) in ("=", ";", ",") and self.peek() not in STATEMENT_WORDS:
                        add("localvar", self.peek(), k, type_text=kind)
                        k = self.i + 1
                        continue
                except Unreadable:
                    pass
            k += 1
        self.i = keep
        for ordinal, ref in enumerate(reversed(found)):
            self.refs.append(ref | {"ref_ordinal": ordinal})


def parse(path: str, source: str | bytes) -> dict:
    """Everything found in one file; never raises."""
    text = source.decode("utf-8", "replace") if isinstance(source, bytes) else source
    parser = Parser(path, text)
    try:
        parser.unit()
    except (Unreadable, IndexError, RecursionError) as e:
        parser.errors.append(str(e))
    texts = parser.literals()
    status = "success" if not parser.errors else ("partial" if parser.types else "failed")
    rows = {k: getattr(parser, k) for k in ("imports", "types", "fields", "methods", "refs", "errors")}
    return {"relative_path": path, "status": status, "package": parser.package or None, **rows, "texts": texts}
