"""Which tables one SQL statement reads and writes, by a walk over its clauses and scopes.

Signs are told apart by the quoting rules of several dialects, tried in order; the first whose signs make a statement is
taken. ``FROM`` opens a clause only in a query's own scope, so ``extract(year FROM t)`` names no table. A statement
that no dialect explains is read without grammar, and says so.
"""

from __future__ import annotations

import re

#: Fixed values of the languages: how each dialect quotes names and texts, and what else its comments and signs are.
DIALECTS = [
    {"names": [r'"(?:[^"]|"")+"'], "texts": [r"'(?:[^']|'')*'"], "notes": [], "signs": ""},
    {"names": [r"`[^`]+`"], "texts": [r"'(?:\\.|[^'\\])*'", r'"(?:\\.|[^"\\])*"'], "notes": [r"#(?!\{)[^\n]*"], "signs": r"\[\]"},
    {"names": [r'"(?:[^"]|"")+"'], "texts": [r"[eE]?'(?:\\.|''|[^'\\])*'", r"\$\w*\$.*?\$\w*\$"], "notes": [], "signs": r"\[\]"},
    {"names": [r"\[[^\]]+\]", r'"[^"]+"'], "texts": [r"[nN]?'(?:[^']|'')*'"], "notes": [], "signs": "#"},
]
#: Words that can follow a table and are no other name of it.
AFTER_TABLE = frozenset(
    "WHERE ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER SEMI ANTI UNION EXCEPT INTERSECT MINUS GROUP ORDER HAVING LIMIT OFFSET FETCH FOR WINDOW "
    "QUALIFY SET WHEN VALUES SELECT FROM TABLESAMPLE SAMPLE LATERAL RETURNING CLUSTER DISTRIBUTE SORT PIVOT UNPIVOT WITH DEFAULT AS PARTITION STRAIGHT_JOIN".split()
)
BEFORE_TABLE = frozenset("LATERAL ONLY OUTER".split())
BEFORE_NAME = {
    "INSERT": frozenset("INTO OVERWRITE TABLE IGNORE LOW_PRIORITY".split()),
    "CREATE": frozenset("OR REPLACE GLOBAL LOCAL TEMPORARY TEMP EXTERNAL MATERIALIZED UNLOGGED TABLE VIEW IF NOT EXISTS".split()),
    "DROP": frozenset("TEMPORARY MATERIALIZED TABLE VIEW IF EXISTS".split()),
    "ALTER": frozenset("TABLE VIEW IF EXISTS ONLY".split()),
    "TRUNCATE": frozenset("TABLE ONLY".split()),
    "UPDATE": frozenset("ONLY IGNORE".split()),
    "DELETE": frozenset(["ONLY"]),
    "MERGE": frozenset(["INTO"]),
}
QUERY_WORDS = frozenset("SELECT WITH VALUES FROM".split())


def _lexer(d: dict) -> re.Pattern:
    skip = "|".join([r"\s+", r"--[^\n]*", r"/\*.*?\*/", *d["notes"]])
    value = "|".join([*d["texts"], r"\?\d*", r":[^\W\d][\w.]*", r"[#$]\{[^{}]*\}", r"@+\w+", r"\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"])
    return re.compile(rf"(?P<skip>{skip})|(?P<value>{value})|(?P<quoted>{'|'.join(d['names'])})|(?P<word>[^\W\d][\w$]*)|(?P<sign>::|[-+*/%(),.;=<>!:&|^~{{}}{d['signs']}])", re.S)


LEXERS = [_lexer(d) for d in DIALECTS]


class Unreadable(ValueError):
    pass


class Statement:
    """One statement's signs; ``reads`` and ``writes`` fill as its clauses are walked."""

    def __init__(self, lexer: re.Pattern, sql: str) -> None:
        self.signs: list[str] = []  # words in upper case, names in quotes as they are
        self.names: list[str | None] = []  # the name that a sign can be
        self.close: dict[int, int] = {}
        at, open_ = 0, []
        while at < len(sql):
            m = lexer.match(sql, at)
            if not m:
                raise Unreadable(f"at {at}")
            at, text, kind = m.end(), m.group(), m.lastgroup
            if kind == "skip":
                continue
            if text == "(":
                open_.append(len(self.signs))
            elif text == ")":
                if not open_:
                    raise Unreadable("closed too often")
                self.close[open_.pop()] = len(self.signs)
            self.signs.append(text.upper() if kind == "word" else "''" if kind == "value" else text)
            self.names.append(text.lower() if kind == "word" else text[1:-1].lower() if kind == "quoted" else None)
        if open_:
            raise Unreadable("left open")
        while self.signs and self.signs[-1] == ";":
            self.signs.pop()
        self.end = len(self.signs)
        self.reads, self.writes, self.aliases = set(), set(), {}

    def sign(self, i: int) -> str:
        return self.signs[i] if i < self.end else ""

    def over(self, i: int, words: frozenset[str]) -> int:
        while self.sign(i) in words:
            i += 1
        return i

    def name(self, i: int) -> tuple[str, int]:
        """(dotted name, the place after it)."""
        parts = []
        while i < self.end and self.names[i] is not None:
            parts.append(self.names[i])
            if self.sign(i + 1) != ".":
                return ".".join(parts), i + 1
            i += 2
        raise Unreadable(f"no name at sign {i}")

    def table(self, i: int) -> int:
        """A table, a query in parentheses or joined tables in parentheses, with its other name; the place after it."""
        i = self.over(i, BEFORE_TABLE)
        found = None
        if self.sign(i) == "(":
            inner = self.over(i, frozenset("("))
            if self.sign(inner) in QUERY_WORDS:
                self.walk(i + 1, self.close[i], query=True)
            else:
                self.walk(self.tables(i + 1), self.close[i], query=True)
            i = self.close[i] + 1
        elif self.sign(i) == "VALUES":
            return i
        else:
            found, i = self.name(i)
            if self.sign(i) == "(":  # a function's rows
                self.walk(i + 1, self.close[i], query=False)
                found, i = None, self.close[i] + 1
            else:
                self.reads.add(found)
        if self.sign(i) == "AS":
            i += 1
        if i < self.end and self.names[i] is not None and self.sign(i) not in AFTER_TABLE:
            if found:
                self.aliases[self.names[i]] = found
            i += 1
            if self.sign(i) == ".":
                raise Unreadable("a dot after another name")
            if self.sign(i) == "(" and self.sign(i + 1) not in QUERY_WORDS:
                i = self.close[i] + 1
        return i

    def tables(self, i: int) -> int:
        i = self.table(i)
        while self.sign(i) == ",":
            i = self.table(i + 1)
        return i

    def walk(self, i: int, end: int, query: bool, using: bool = False) -> None:
        """The clauses from ``i`` to ``end``; ``query`` says whether FROM and JOIN open one here."""
        while i < end:
            sign = self.sign(i)
            if sign == "(":
                inner = self.over(i, frozenset("("))
                self.walk(i + 1, self.close[i], query=self.sign(inner) in QUERY_WORDS)
                i = self.close[i] + 1
            elif query and (sign == "FROM" and self.signs[i - 1] != "DISTINCT" or using and sign == "USING" and self.sign(i + 1) != "("):
                i = self.tables(i + 1)
            elif query and (sign in ("JOIN", "STRAIGHT_JOIN", "APPLY") or sign == "USING" and using):
                i = self.table(i + 1)
            elif query and sign == "INTO" and self.names[i + 1 : i + 2] not in ([], [None]):
                found, i = self.name(i + 1)
                self.reads.add(found)
            else:
                i += 1

    def target(self, i: int, kind: str) -> int:
        found, i = self.name(self.over(i, BEFORE_NAME[kind]))
        self.writes.add(found)
        if self.sign(i) == "AS":
            i += 1
        if i < self.end and self.names[i] is not None and self.sign(i) not in AFTER_TABLE and kind in ("UPDATE", "MERGE", "DELETE"):
            self.aliases[self.names[i]] = found
            i += 1
        return i

    def read(self) -> str:
        """The statement's kind."""
        i = 0
        if self.sign(0) == "WITH":  # queries by name, then the statement proper
            i = 2 if self.sign(1) == "RECURSIVE" else 1
            while True:
                _, i = self.name(i)
                if self.sign(i) == "(":
                    i = self.close[i] + 1
                if self.sign(i) != "AS":
                    raise Unreadable("AS is missing")
                i = self.over(i + 1, frozenset(("NOT", "MATERIALIZED")))
                if self.sign(i) != "(":
                    raise Unreadable("a named query is missing")
                self.walk(i + 1, self.close[i], query=True)
                i = self.close[i] + 1
                if self.sign(i) != ",":
                    break
                i += 1
        kind = self.sign(self.over(i, frozenset("(")))
        if kind in ("SELECT", "VALUES", "FROM", "WITH"):
            self.walk(i, self.end, query=True)
            return "SELECT"
        if kind in ("INSERT", "REPLACE"):
            i = self.target(i + 1, "INSERT")
            self.walk(self.close[i] + 1 if self.sign(i) == "(" and self.sign(i + 1) not in QUERY_WORDS else i, self.end, query=True)
            return "INSERT"
        if kind == "DELETE":
            if self.sign(i + 1) == "FROM":
                self.walk(self.target(i + 2, "DELETE"), self.end, query=True, using=True)
            else:
                self._through_alias(i + 1)
            return kind
        if kind in ("UPDATE", "MERGE"):
            after = self.target(i + 1, kind)
            self.walk(after, self.end, query=True, using=kind == "MERGE")
            self._resolve()
            return kind
        if kind == "CREATE" and "INDEX" in self.signs[i : i + 4]:
            self.writes.add(self.name(self.signs.index("ON") + 1 if "ON" in self.signs else self.end)[0])
            return kind
        if kind in ("CREATE", "DROP", "ALTER", "TRUNCATE"):
            i = self.target(i + 1, kind)
            while kind in ("DROP", "TRUNCATE") and self.sign(i) == ",":
                i = self.target(i + 1, kind)
            self.walk(i, self.end, query=kind == "CREATE")
            return kind
        raise Unreadable("no statement")

    def _through_alias(self, i: int) -> None:
        """``DELETE a, b FROM t a JOIN u b``: the named ones are written."""
        while True:
            found, i = self.name(i)
            self.writes.add(found.removesuffix(".*"))
            if self.sign(i) != ",":
                break
            i += 1
        if self.sign(i) not in ("FROM", ""):
            raise Unreadable("FROM is missing")
        self.walk(i, self.end, query=True)
        self._resolve()

    def _resolve(self) -> None:
        """Written names that are other names of tables."""
        self.writes = {self.aliases.get(w, w) for w in self.writes}


def without_grammar(sql: str) -> tuple[str, set[str], set[str]]:
    """(kind, tables named, tables written) by the words before names alone."""
    words = re.findall(r"[\w$.]+|[^\s\w]", re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S))
    upper = [w.upper() for w in words]
    first = upper[0] if upper else ""
    kind = "SELECT" if first == "WITH" else "INSERT" if first == "REPLACE" else first if first in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "DROP", "TRUNCATE", "ALTER") else "UNKNOWN"
    named, written = set(), set()
    for i, w in enumerate(upper[:-1]):
        following = words[i + 1]
        if w in ("FROM", "JOIN", "INTO", "UPDATE", "TABLE") and (following[0].isalpha() or following[0] == "_") and upper[i + 1] not in QUERY_WORDS:
            named.add(following.lower())
            if w in ("INTO", "UPDATE", "TABLE") or upper[i - 1 : i] == ["DELETE"]:
                written.add(following.lower())
    return kind, named, written


def tables_of(sql: str) -> dict:
    """``statement_type, tables_read, tables_written, parsed_ok``; a table that is written is not read as well.

    Names of common table expressions count as tables.
    """
    for lexer in LEXERS:
        try:
            s = Statement(lexer, sql)
            kind, named, written, ok = s.read(), s.reads, s.writes, True
            break
        except Unreadable:
            continue
    else:
        (kind, named, written), ok = without_grammar(sql), False
    return {"statement_type": kind, "tables_read": sorted(named - written), "tables_written": sorted(written), "parsed_ok": ok}
