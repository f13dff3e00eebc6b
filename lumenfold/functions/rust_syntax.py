"""Source metrics of one Rust file: a recovering descent over its tokens.

It follows items, statements and expressions as far as the metrics need them:
which attribute gates which tokens, what owns a body, how deep a decision is nested,
and where modules and includes lead.  Types and patterns are passed over by their
brackets.  Anything unexpected is noted as a syntax error and passed over.
"""

from __future__ import annotations

import posixpath
import re
import sys
from dataclasses import dataclass, field, replace

from . import cfg
from .rust_lexer import COMMENT, IDENT, LIFETIME, LITERAL, WHITESPACE, Token, lex, plain, said

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
STATES = 9
BLANK_LINE, COMMENT_LINE, CODE_LINE = 0, 1, 2
_ITEM_WORDS = {"fn", "struct", "enum", "trait", "impl", "mod", "use", "type", "pub"}


@dataclass(slots=True)
class Line:
    kind: int = BLANK_LINE
    doc: bool = False
    any: tuple = cfg.NOWHERE
    significant: tuple = cfg.NOWHERE

    @property
    def reach(self) -> tuple:
        return self.any if self.kind == BLANK_LINE else self.significant


@dataclass
class Edge:
    gate: tuple
    candidates: list[str]
    message: str


@dataclass
class Source:
    bytes: int = 0
    metrics: list[list[int]] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)


def _string_value(text: str) -> str | None:
    if m := re.fullmatch(r'r(#*)"(.*)"\1', text, re.S):
        return m[2]
    if not (len(text) > 1 and text[0] == text[-1] == '"'):
        return None
    plain = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
    one = lambda m: chr(int(m[2] or m[3], 16)) if m[2] or m[3] else "" if m[1][0] == "\n" else plain.get(m[1], m[1])
    return re.sub(r"\\(x([0-9a-fA-F]{2})|u\{([0-9a-fA-F_]+)\}|\n\s*|.)", one, text[1:-1], flags=re.S)


class Walk:
    def __init__(self, path: str, text: str, profile: cfg.Profile, manifest_dir: str | None, texts: list[str] | None = None):
        self.path, self.profile, self.manifest_dir = path, profile, manifest_dir
        self.tokens: list[Token] = lex(text, texts)
        self.at_of = [i for i, t in enumerate(self.tokens) if t[0] != WHITESPACE and t[0] != COMMENT]
        self.words = [self.tokens[i][1] for i in self.at_of]
        self.kinds = [self.tokens[i][0] for i in self.at_of]
        self.n, self.p = len(self.words), 0
        self.gate = cfg.BOTH
        self.spans: list[tuple[int, int, int, tuple]] = []
        self.bodies: list[int] = []
        self.cuts: list[int] = []
        self.arms: list[tuple] = []
        self.modules: list[tuple[str, str | None]] = []
        self.cyclomatic, self.cognitive, self.public = [0] * STATES, [0] * STATES, [0] * STATES
        self.logic: set[int] = set()
        self.opaque: set[int] = set()
        self.errors: list[str] = []
        self.edges: list[Edge] = []

    # -- reading

    def word(self, k: int = 0) -> str:
        return self.words[self.p + k] if self.p + k < self.n else ""

    def kind(self, k: int = 0) -> int:
        return self.kinds[self.p + k] if self.p + k < self.n else -1

    def eat(self, w: str) -> bool:
        if self.word() == w:
            self.p += 1
            return True
        return False

    def expect(self, w: str) -> None:
        if not self.eat(w):
            self.errors.append(f"expected {w}")

    def tree(self, opaque: bool = False) -> None:
        """Pass a bracketed run."""
        start, stack = self.p, []
        while self.p < self.n:
            w = self.word()
            if w in OPEN:
                stack.append(OPEN[w])
            elif w in CLOSE:
                if not stack or stack[-1] != w:
                    self.errors.append(f"unexpected {w}")
                    if w not in stack:
                        self.p += 1
                        continue
                    while stack[-1] != w:
                        stack.pop()
                stack.pop()
            self.p += 1
            if not stack:
                break
        else:
            self.errors.append("unclosed bracket")
        if opaque:
            self.opaque.update(range(start, self.p))

    # -- gates and bodies

    def attributes(self, inner: bool = False) -> tuple[tuple, str | None]:
        """The gate of the attributes here, and the value of a path attribute."""
        gate, path = cfg.BOTH, None
        while self.word() == "#" and (self.word(1) == "[" and not inner or inner and self.word(1) == "!" and self.word(2) == "["):
            self.p += 2 if inner else 1
            a = self.p
            self.tree(opaque=True)
            inside = self.words[a + 1 : self.p - 1]
            gate = cfg.both(gate, self.profile.gate(inside))
            if path is None and len(inside) == 3 and inside[:2] == ["path", "="]:
                path = _string_value(inside[2])
        return gate, path

    def node(self, start: int, gate: tuple):
        return _Node(self, start, gate)

    def active(self) -> bool:
        return len(self.bodies) > (self.cuts[-1] if self.cuts else 0)

    def decide(self, cyclomatic: int, nested: bool) -> None:
        if self.active():
            self.cyclomatic[cfg.code(self.gate)] += cyclomatic
            self.cognitive[cfg.code(self.gate)] += 1 + (self.bodies[-1] if nested else 0)

    def nest(self, by: int) -> None:
        if self.active():
            self.bodies[-1] += by

    def body(self, inside) -> None:
        self.cyclomatic[cfg.code(self.gate)] += 1
        self.bodies.append(0)
        inside()
        self.bodies.pop()

    def nested_block(self) -> None:
        if self.word() != "{":
            self.errors.append("expected a block")
            return
        self.nest(1)
        self.block()
        self.nest(-1)

    # -- items

    def file(self) -> None:
        gate, _ = self.attributes(inner=True)
        with self.node(0, gate):
            while self.p < self.n:
                before = self.p
                self.statement()
                if self.p == before:
                    self.errors.append(f"unexpected {self.word()}")
                    self.p += 1

    def block(self) -> None:
        start = self.p
        self.expect("{")
        gate, _ = self.attributes(inner=True)
        with self.node(start, gate):
            while self.p < self.n and self.word() != "}":
                before = self.p
                self.statement()
                if self.p == before:
                    self.errors.append(f"unexpected {self.word()}")
                    self.p += 1
            self.expect("}")

    def is_item(self) -> bool:
        w, x, y = self.word(), self.word(1), self.word(2)
        if w in _ITEM_WORDS:
            return True
        if w == "extern":
            return x == "crate" or x == "{" or self.kind(1) == LITERAL or x == "fn"
        if w == "const":
            return x not in ("{", "|", "||", "move", "async") or x == "async" and y != "{" and y not in ("move", "|")
        if w == "static":
            return x not in ("|", "||", "move", "async")
        if w in ("unsafe", "safe"):
            return x in ("fn", "trait", "impl", "extern", "mod", "auto", "static")
        if w == "async":
            return x == "fn" or x in ("unsafe", "extern") and y != "{"
        if w == "union":
            return self.kind(1) == IDENT and y in ("{", "<", "where")
        if w in ("auto", "default"):
            return x in ("trait", "impl", "fn", "const", "type", "unsafe", "async")
        if w == "macro_rules":
            return x == "!" and self.kind(2) == IDENT
        return w == "macro" and self.kind(1) == IDENT and y in ("(", "{")

    def statement(self) -> None:
        start = self.p
        gate, path = self.attributes()
        item = self.is_item()
        with self.node(start, gate) as n:
            n.comments = item or self.kind() == IDENT and self.word(1) == "!"
            if item:
                self.item(path)
            elif self.word() == "let":
                self.let()
            elif self.eat(";"):
                pass
            elif self.word() not in CLOSE:
                self.expression(statement=True)
                self.eat(";")

    def visibility(self) -> None:
        if self.word() == "pub":
            self.p += 1
            if self.word() == "(" and self.word(1) in ("crate", "self", "super", "in"):
                self.tree()
            else:
                self.public[cfg.code(self.gate)] += 1
        elif self.word() == "crate" and self.word(1) != "::":
            self.p += 1

    def item(self, path: str | None) -> None:
        self.cuts.append(len(self.bodies))
        self.visibility()
        while self.word() in ("default", "auto", "safe") or self.word() in ("unsafe", "async", "const", "extern") and self.word(1) in ("fn", "unsafe", "extern", "async", "impl", "trait", "mod", "static", "auto") or self.word() == "extern" and self.kind(1) == LITERAL and self.word(2) != "{":
            self.p += 1 if self.word() != "extern" or self.kind(1) != LITERAL else 2
        w = self.word()
        if w == "fn":
            self.signature(("{", ";"))
            if not self.eat(";"):
                self.body(self.block)
        elif w in ("const", "static"):
            self.signature(("=", ";"))
            if self.eat("="):
                self.body(self.expression)
            self.expect(";")
        elif w in ("struct", "union", "enum"):
            self.adt(w)
        elif w == "mod":
            self.module(path)
        elif w in ("trait", "impl") or w == "extern" and self.word(1) != "crate":
            self.signature(("{", ";"))
            if not self.eat(";"):
                self.block()
        elif w in ("macro_rules", "macro"):
            self.p += 3 if w == "macro_rules" else 2
            brace = False
            while self.word() in OPEN:
                brace = self.word() == "{"
                self.tree(opaque=True)
            if not brace:
                self.eat(";")
        elif w == "use":
            while self.p < self.n and self.word() not in (";", "}"):
                if self.word() in OPEN:
                    self.tree()
                else:
                    self.p += 1
            self.expect(";")
        elif w in ("type", "extern"):
            self.signature((";",))
            self.expect(";")
        elif self.word() not in CLOSE:
            self.errors.append(f"unexpected {w} in an item")
            if self.kind() == IDENT and self.word(1) == "!":
                self.expression(statement=True)
        self.cuts.pop()

    def module(self, path: str | None) -> None:
        self.p += 1
        name = self.word() if self.kind() == IDENT else "<missing name>"
        self.p += self.kind() == IDENT
        if self.eat(";"):
            self.edges.append(Edge(self.gate, self.module_files(name, path), f"cannot resolve out-of-line module {name}"))
        elif self.word() == "{":
            self.modules.append((name, path))
            self.block()
            self.modules.pop()
        else:
            self.errors.append("expected a module body")

    def module_files(self, name: str, path: str | None) -> list[str]:
        """Where the module may lie; the first that exists is it."""
        parent, file = posixpath.split(self.path)
        base = parent if file in ("lib.rs", "main.rs", "mod.rs") else posixpath.join(parent, file[:-3] if file.endswith(".rs") else file)
        for outer, _ in self.modules:
            base = posixpath.join(base, outer)
        if path is not None:
            found = [posixpath.join(parent, path), posixpath.join(base, path)]
            return [posixpath.normpath(x) for x in (found[::-1] if self.modules else found)]
        return [posixpath.normpath(posixpath.join(d, f)) for d in (base, parent) for f in (f"{name}.rs", f"{name}/mod.rs")]

    def signature(self, stops: tuple[str, ...]) -> None:
        """Pass names, generics, parameters and types up to a stop outside of brackets."""
        self.p += 1
        while self.p < self.n and self.word() not in stops:
            w = self.word()
            if w in (";", "}", ")", "]"):
                return
            self.type_part()

    def type_part(self) -> None:
        w = self.word()
        if w == "<":
            self.angle()
        elif w == "(":
            self.fields("(")
        elif w == "[":
            self.bracket()
        elif w == "{":
            self.block()
        elif w == "const" and self.word(1) == "{":
            self.p += 1
            self.body(self.block)
        elif w == "!" and self.word(1) in OPEN and self.p and self.kinds[self.p - 1] == IDENT:
            self.p += 1
            self.tree(opaque=True)
        else:
            self.p += 1

    def angle(self) -> None:
        depth = 0
        while self.p < self.n:
            w = self.word()
            if w in (";", ")", "]", "}"):
                return
            if w == "<":
                depth += 1
                self.p += 1
            elif w in (">", ">>", ">=", ">>="):
                depth -= 2 if w[:2] == ">>" else 1
                self.p += 1
            else:
                self.type_part()
            if depth <= 0:
                return

    def bracket(self) -> None:
        """[T; n]: n is an expression."""
        self.expect("[")
        while self.p < self.n and self.word() not in CLOSE:
            if self.eat(";"):
                self.expression()
                break
            self.type_part()
        if self.word() != "]":
            while self.p < self.n and self.word() not in CLOSE:
                if self.word() in OPEN:
                    self.tree()
                else:
                    self.p += 1
        self.expect("]")

    def fields(self, opening: str) -> None:
        """Fields or parameters: each may have attributes and a visibility, up to its comma."""
        close = OPEN[opening]
        self.expect(opening)
        while self.p < self.n and self.word() not in CLOSE:
            start = self.p
            gate, _ = self.attributes()
            with self.node(start, gate) as n:
                n.comments = True
                self.visibility()
                while self.p < self.n and self.word() != "," and self.word() not in CLOSE:
                    if self.eat("="):
                        self.expression()
                    else:
                        self.type_part()
            self.eat(",")
        self.expect(close)

    def adt(self, what: str) -> None:
        self.p += 1
        while self.p < self.n and self.word() not in ("{", "(", ";", "}"):
            self.type_part()
        if self.word() == "(":
            self.fields("(")
            while self.p < self.n and self.word() not in (";", "}", "{"):
                self.type_part()
            self.expect(";")
        elif self.word() == "{" and what == "enum":
            self.p += 1
            while self.p < self.n and self.word() != "}":
                start = self.p
                gate, _ = self.attributes()
                with self.node(start, gate) as n:
                    n.comments = True
                    self.visibility()
                    while self.p < self.n and self.word() not in (",", "}"):
                        if self.word() in ("(", "{"):
                            self.fields(self.word())
                        elif self.eat("="):
                            self.expression()
                        elif self.word() in CLOSE:
                            self.p += 1
                        else:
                            self.p += 1
                self.eat(",")
            self.expect("}")
        elif self.word() == "{":
            self.fields("{")
        else:
            self.eat(";")

    # -- statements and expressions

    def let(self) -> None:
        self.p += 1
        self.pattern(("=", ";", "else"), typed=True)
        if self.eat("="):
            self.expression()
        if self.word() == "else":
            self.decide(1, True)
            self.p += 1
            self.nested_block()
        self.expect(";")

    def pattern(self, stops: tuple[str, ...], typed: bool = False) -> None:
        while self.p < self.n and self.word() not in stops and self.word() not in CLOSE:
            if typed and self.eat(":"):
                while self.p < self.n and self.word() not in stops and self.word() not in CLOSE:
                    self.type_part()
                return
            if self.word() in OPEN:
                self.tree()
            elif self.word() == "::" and self.word(1) == "<":
                self.p += 1
                self.angle()
            else:
                self.p += 1

    def deferred(self) -> None:
        """async or const block."""
        self.p += 1
        self.eat("move")
        self.body(self.block)

    def closure(self, no_struct: bool) -> None:
        self.cuts.append(len(self.bodies))
        if self.eat("for"):
            self.angle()
        while self.word() in ("static", "async", "const", "move"):
            self.p += 1
        if not self.eat("||"):
            self.expect("|")
            while self.p < self.n and self.word() not in ("|", ";", "}"):
                start = self.p
                gate, _ = self.attributes()
                with self.node(start, gate):
                    while self.p < self.n and self.word() not in (",", "|", ";", "}", ")"):
                        self.type_part()
                if not self.eat(",") and self.word() != "|":
                    break
            self.expect("|")
        if self.eat("->"):
            while self.p < self.n and self.word() != "{" and self.word() not in CLOSE and self.word() != ";":
                self.type_part()
        self.body(lambda: self.expression(no_struct))
        self.cuts.pop()

    def conditional(self) -> None:
        while True:
            self.p += 1
            self.decide(1, True)
            self.expression(no_struct=True)
            self.nested_block()
            if not self.eat("else"):
                return
            if self.word() != "if":
                self.nested_block()
                return

    def loop(self) -> None:
        w = self.word()
        self.p += 1
        self.decide(1, True)
        if w == "for":
            self.pattern(("in", "{"))
            self.expect("in")
        if w != "loop":
            self.expression(no_struct=True)
        self.nested_block()

    def match(self) -> None:
        self.p += 1
        self.decide(0, True)
        self.arms.append(cfg.NOWHERE)
        self.expression(no_struct=True)
        start = self.p
        self.expect("{")
        gate, _ = self.attributes(inner=True)
        with self.node(start, gate):
            while self.p < self.n and self.word() != "}":
                before = self.p
                self.arm()
                if self.p == before:
                    self.errors.append(f"unexpected {self.word()} in a match")
                    self.p += 1
            self.expect("}")
        self.arms.pop()

    def arm(self) -> None:
        start = self.p
        gate, _ = self.attributes()
        with self.node(start, gate):
            alternative = cfg.both(self.gate, self.arms[-1])
            in_body, before = self.active(), self.arms[-1]
            self.arms[-1] = cfg.either(before, self.gate)
            if in_body and alternative != cfg.NOWHERE:
                self.cyclomatic[cfg.code(alternative)] += 1
            self.nest(1)
            self.pattern(("=>", "if", ","))
            if self.eat("if"):
                self.decide(1, False)
                self.expression()
            if self.eat("=>"):
                self.expression(statement=True)
            else:  # no arm after all
                self.errors.append("expected =>")
                self.arms[-1] = before
                if in_body and alternative != cfg.NOWHERE:
                    self.cyclomatic[cfg.code(alternative)] -= 1
            self.nest(-1)
            self.eat(",")

    def listed(self, opening: str) -> None:
        self.expect(opening)
        while self.p < self.n and self.word() not in CLOSE:
            before = self.p
            self.expression()
            if self.word() in (",", ";"):
                self.p += 1
            elif self.p == before:
                self.errors.append(f"unexpected {self.word()}")
                self.p += 1
        self.expect(OPEN[opening])

    def record(self) -> None:
        self.expect("{")
        while self.p < self.n and self.word() not in CLOSE:
            start, before = self.p, self.p
            gate, _ = self.attributes()
            with self.node(start, gate) as n:
                n.comments = True
                if self.kind() in (IDENT, LITERAL) and self.word(1) == ":":
                    self.p += 2
                self.expression()
            if not self.eat(",") and self.p == before:
                self.errors.append(f"unexpected {self.word()}")
                self.p += 1
        self.expect("}")

    def macro(self, name: str) -> bool:
        """A call at ``!``; whether its brackets are braces."""
        self.p += 1
        if self.kind() == IDENT:
            self.p += 1
        brace, start = self.word() == "{", self.p
        self.tree(opaque=True)
        if name == "include":
            self.include(self.words[start + 1 : self.p - 1], [self.kinds[i] for i in range(start + 1, self.p - 1)])
        return brace

    def path_operand(self) -> str:
        """Pass a path; its name if it is a single one."""
        first, parts = self.word(), 0
        if self.word() == "<":
            self.angle()
        while True:
            if self.eat("::"):
                parts += 1
                if self.word() == "<":
                    self.angle()
                    continue
            if self.kind() == IDENT:
                self.p += 1
                parts += 1
                if self.word() == "::":
                    continue
            return first if parts == 1 else ""

    def expression(self, no_struct: bool = False, statement: bool = False) -> None:
        start = self.p
        gate, _ = self.attributes()
        with self.node(start, gate):
            self._expression(no_struct, statement)

    def _expression(self, no_struct: bool, statement: bool) -> None:
        operand, first, path = True, True, False
        while self.p < self.n:
            w = self.word()
            if w in CLOSE or w in (",", ";", "=>"):
                return
            if not operand:
                if w == "?":
                    self.decide(1, False)
                    self.p += 1
                elif w in ("&&", "||"):
                    self.logic.add(self.p)
                    self.decide(1, False)
                    self.p += 1
                    operand = True
                elif w == ".":
                    self.p += 2
                    if self.word() == "::":
                        self.p += 1
                        self.angle()
                elif w in ("(", "["):
                    self.listed(w)
                elif w == "{":
                    if no_struct or not path:
                        return
                    self.record()
                elif w == "as":
                    self.p += 1
                    self.cast()
                elif w == "else":
                    return
                elif self.kind() in (IDENT, LITERAL, LIFETIME) or w in ("#", "{", ":", "@", "->", "::", "$", "!"):
                    if w in (":", "->", "@", "$", "!", "::"):
                        self.errors.append(f"unexpected {w}")
                        self.p += 1
                        operand = True
                    else:
                        if not statement:
                            self.errors.append(f"unexpected {w}")
                        return
                else:
                    self.p += 1
                    operand = True
                path = False
                continue
            began, path = first, False
            first = False
            if w in ("-", "!", "*", "&", "&&", "..", "..=", "..."):
                self.p += 1
                if w in ("&", "&&"):
                    while self.word() in ("mut", "raw") or self.word() == "const" and self.word(1) != "{":
                        self.p += 1
                if w in ("..", "..=") and (self.word() in ("{", "=>") and no_struct):
                    operand = False
                continue
            blocklike = True
            if w == "if":
                self.conditional()
            elif w == "match":
                self.match()
            elif w in ("while", "loop") or w == "for" and self.word(1) != "<":
                self.loop()
            elif w == "{":
                if no_struct and not began:
                    return
                self.block()
            elif w in ("unsafe", "try") and self.word(1) == "{":
                self.p += 1
                self.block()
            elif w in ("async", "const") and (self.word(1) == "{" or self.word(1) == "move" and self.word(2) == "{"):
                self.deferred()
            elif self.kind() == LIFETIME and self.word(1) == ":":
                self.p += 2
                first = began
                continue
            elif w in ("|", "||", "move", "static", "async", "const") or w == "for":
                self.closure(no_struct)
                return
            else:
                blocklike = False
            if not blocklike:
                if w in ("return", "break", "continue", "yield", "become", "box", "do"):
                    self.p += 1
                    if w in ("break", "continue") and self.kind() == LIFETIME:
                        self.p += 1
                    if self.word() == "{" and no_struct:
                        return
                    continue
                if w == "let":
                    self.p += 1
                    self.pattern(("=", "{", ";"))
                    self.expect("=")
                    continue
                if w in ("(", "["):
                    self.listed(w)
                elif self.kind() == IDENT or w in ("::", "<"):
                    at = self.p
                    name = self.path_operand()
                    path = True
                    if self.p == at:
                        self.p += 1
                    if self.word() == "!" and (self.word(1) in OPEN or self.kind(1) == IDENT and self.word(2) in OPEN):
                        path = False
                        blocklike = self.macro(name)
                elif self.kind() in (LITERAL, LIFETIME):
                    self.p += 1
                else:
                    self.errors.append(f"unexpected {w}")
                    self.p += 1
                    if w == "=":
                        continue
            operand = False
            if statement and began and blocklike and self.word() not in (".", "?"):
                return

    def cast(self) -> None:
        while self.word() in ("&", "*", "mut", "dyn", "impl", "unsafe", "extern") or self.kind() == LIFETIME or self.word() == "const" and self.word(1) != "{":
            self.p += 1
        if self.word() == "fn":
            self.p += 1
            self.tree()
            if self.eat("->"):
                self.cast()
        elif self.word() == "(":
            self.tree()
        elif self.word() == "[":
            self.bracket()
        else:
            while self.kind() == IDENT or self.word() == "::":
                self.p += 1
                if self.word() == "<":
                    self.angle()
                if self.word() != "::" and self.words[self.p - 1] != "::":
                    break

    # -- includes

    def include(self, words: list[str], kinds: list[int]) -> None:
        parts = cfg.split(words)
        value = self.text_of(parts[0]) if len(parts) == 1 else None
        if value is None:
            self.edges.append(Edge(self.gate, [], 'the file that include! names is only known to a build: only literals, concat! of them and the manifest folder are followed'))
        elif value is not Generated:
            target = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), value))
            self.edges.append(Edge(self.gate, [target], f"include! names a file that is not there: {target}"))

    def text_of(self, words: list[str]):
        """A string that an expression of literals, parentheses, concat! and env! makes; Generated for the build's own folder; else None."""
        if len(words) == 1:
            return _string_value(words[0])
        if len(words) > 2 and words[0] == "(" and words[-1] == ")":
            return self.text_of(words[1:-1])
        if len(words) < 4 or words[1] != "!" or words[2] not in OPEN or words[-1] != OPEN[words[2]]:
            return None
        parts = [self.text_of(x) for x in cfg.split(words[3:-1])] if words[3:-1] else []
        if words[0] == "concat":
            return None if None in parts else Generated if Generated in parts else "".join(parts)
        if words[0] != "env" or not 1 <= len(parts) <= 2 or None in parts or Generated in parts:
            return None
        return {"CARGO_MANIFEST_DIR": self.manifest_dir, "OUT_DIR": Generated}.get(parts[0])


#: Stands for source that a build makes: outside of what is authored.
Generated = object()


class _Node:
    """A run of tokens under a gate."""

    def __init__(self, walk: Walk, start: int, gate: tuple):
        self.walk, self.start, self.own, self.comments = walk, start, gate, False

    def __enter__(self):
        self.outer = self.walk.gate
        self.walk.gate = cfg.both(self.outer, self.own)
        return self

    def __exit__(self, *_):
        if self.own != cfg.BOTH:
            self.walk.spans.append((self.start, self.walk.p, self.comments, self.walk.gate))
        self.walk.gate = self.outer


def _attached(tokens: list[Token], lo: int, hi: int) -> int:
    """Of the trivia between two tokens, where those begin that go with the node after them."""
    at = hi
    for i in range(hi - 1, lo - 1, -1):
        t = tokens[i]
        if t.kind == WHITESPACE:
            if "\n\n" in t.text and not (i > lo and tokens[i - 1].kind == COMMENT and tokens[i - 1].doc and tokens[i - 1].text[:3] not in ("//!", "/*!")):
                break
        elif t.text[:3] in ("//!", "/*!"):
            break
        else:
            at = i
    return at


def _token_gates(w: Walk) -> list[tuple]:
    gates = [cfg.BOTH] * len(w.tokens)
    for a, b, comments, gate in sorted(w.spans, key=lambda s: (s[0], -s[1])):
        if a >= b:
            continue
        first, last = w.at_of[a], w.at_of[b - 1]
        if comments:
            first = _attached(w.tokens, w.at_of[a - 1] + 1 if a else 0, first)
        for i in range(first, last + 1):
            gates[i] = gate
    return gates


#: The only words that ``_counts_lexically`` may count.
_LEXICAL = {"for", "if", "while", "loop", "else", "match", "?", "==", "!=", "&&", "||"}


def _counts_lexically(w: Walk, k: int) -> bool:
    word = w.words[k]
    if word in ("for", "if", "while", "loop", "else", "match"):
        return True
    if word == "?":
        return k + 1 >= w.n or w.words[k + 1] != "Sized"
    if word in ("==", "!="):
        return k not in w.opaque
    return word in ("&&", "||") and k in w.logic


#: Characters of the texts that ``measure`` may keep in ``seen``, together and each.
SEEN_CHARS, SEEN_TEXT = 4_000_000, 40_000


def measure(path: str, content: bytes, profile: cfg.Profile | None = None, manifest_dir: str | None = None, seen: dict | None = None) -> Source:
    """All of a file's metrics by state of reachability (production * 3 + test).

    ``seen``: as ``shared`` has it."""
    s = shared(path, content, profile, manifest_dir, seen)
    return s if s.bytes == len(content) else replace(s, bytes=len(content))


def shared(path: str, content: bytes, profile: cfg.Profile | None = None, manifest_dir: str | None = None, seen: dict | None = None) -> Source:
    """``measure``, where all that share a walk are one object, with the bytes of the first.

    ``seen``: what this function keeps between calls of one profile and manifest folder.
    Sources that are the same but for the words of their line comments are walked once,
    unless they lead to other files, which depends on the path."""
    profile = profile or cfg.Profile()
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return _raw(content)
    key = said(text) if seen is not None and len(text) <= SEEN_TEXT else None
    if key is not None and (known := seen.get(key)) is not None:
        return known
    s = _walked(path, text, profile, manifest_dir, plain(text))
    s.bytes = len(content)
    if key is not None and not s.edges and (chars := seen.get(None, 0) + len(key)) <= SEEN_CHARS:
        seen[None], seen[key] = chars, s
    return s


def _walked(path: str, text: str, profile: cfg.Profile, manifest_dir: str | None, texts: list[str] | None) -> Source:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
    w = Walk(path, text, profile, manifest_dir, texts)
    w.file()
    starts = [0] if text else []
    starts += [m.end() for m in re.finditer("\n", text) if m.end() < len(text)]
    lines = [Line() for _ in starts]
    starts.append(len(text) + 1)
    previous, at, sig, following = None, 0, -1, starts[1] if lines else 0
    metrics = [[0] * 9 for _ in range(STATES)]
    either = cfg.either
    for (token_kind, word, start, doc), own in zip(w.tokens, _token_gates(w)):
        while following <= start:
            at += 1
            following = starts[at + 1]
        trivia = token_kind == WHITESPACE or token_kind == COMMENT
        gate = previous if word == "," and previous is not None else own
        kind = BLANK_LINE if token_kind == WHITESPACE else COMMENT_LINE if trivia else CODE_LINE
        end, last = start + len(word) - 1, at
        while starts[last + 1] <= end:
            last += 1
        for line in lines[at : last + 1] if last > at else (lines[at],):
            if line.any != gate:
                line.any = either(line.any, gate)
            if kind != BLANK_LINE and line.significant != gate:
                line.significant = either(line.significant, gate)
            if kind > line.kind:
                line.kind, line.doc = kind, doc
            elif kind == line.kind == COMMENT_LINE:
                line.doc = line.doc or doc
        if not trivia:
            sig += 1
            if word in _LEXICAL and _counts_lexically(w, sig):
                metrics[cfg.code(gate)][5] += 1
            if word != ",":
                previous = own
    for line in lines:
        m = metrics[cfg.code(line.reach)]
        m[0] += 1
        m[{CODE_LINE: 1, COMMENT_LINE: 2, BLANK_LINE: 4}[line.kind]] += 1
        m[3] += line.kind == COMMENT_LINE and line.doc
    for s in range(STATES):
        metrics[s][6:9] = w.cyclomatic[s], w.cognitive[s], w.public[s]
    return Source(0, metrics, lines, w.errors, w.edges)


def _raw(content: bytes) -> Source:
    """Lines of a file that isn't UTF-8: blank ones and code, all of them reachable."""
    raw = content.removesuffix(b"\n").split(b"\n") if content else []
    lines = [Line(CODE_LINE if x.strip(b" \t\n\x0c\r") else BLANK_LINE, False, cfg.BOTH, cfg.BOTH) for x in raw]
    metrics = [[0] * 9 for _ in range(STATES)]
    code = sum(x.kind == CODE_LINE for x in lines)
    metrics[cfg.code(cfg.BOTH)] = [len(lines), code, 0, 0, len(lines) - code, 0, 0, 0, 0]
    return Source(len(content), metrics, lines, ["source is not valid UTF-8"])
