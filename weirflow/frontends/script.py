"""JavaScript, TypeScript, JSX and single-file components, by a parser of their own.

The parser builds the syntax nodes that the standard Python parser gives (calls,
attributes, branches, loops, literals), so the walk of ``python_ast`` lowers both
alike: fields, objects, guards, constants and closures are the same there. What
has no counterpart is rewritten: function expressions become functions before
the statement they stand in, destructuring becomes single assignments, a switch
a match, types are skipped.

A statement that cannot be read is skipped up to the next one, and the file is
then marked partial; the rest of it is lowered.
"""

from __future__ import annotations

import ast
import posixpath
import re

from . import python_ast
from .lexical import blank_outside_scripts

_SPACE = re.compile(r"(?:[ \t\r\f\v\ufeff\u00a0]+|\n|//[^\n]*|/\*.*?\*/|<!--[^\n]*)+", re.S)
_WORD = re.compile(r"[A-Za-z_$#\u0080-\uffff][\w$\u0080-\uffff]*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bBoO][\d_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[^\w\s]")
_ESCAPE = re.compile(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|\n|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
#: Binary operators by strength, weakest first.
_LEVELS = (("??", "||"), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",))
_STRENGTH = {op: i for i, ops in enumerate(_LEVELS) for op in ops}
_COMPARE = {"==": ast.Eq, "===": ast.Eq, "!=": ast.NotEq, "!==": ast.NotEq, "<": ast.Lt, ">": ast.Gt, "<=": ast.LtE, ">=": ast.GtE, "instanceof": ast.Is, "in": ast.In}
_BINARY = {"|": ast.BitOr, "^": ast.BitXor, "&": ast.BitAnd, "<<": ast.LShift, ">>": ast.RShift, ">>>": ast.RShift, "+": ast.Add, "-": ast.Sub, "*": ast.Mult, "/": ast.Div, "%": ast.Mod, "**": ast.Pow}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
#: After these an expression begins, so a slash begins a regular expression.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield => ( , = : [ ! & | ? { } ; + - * % < > ~ ^ && || ?? == === != !== += -= ... <= >=".split())
#: Tokens behind the end of a text that are given out.
MAX_ENDS = 64
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async get set accessor".split())


class Unreadable(Exception):
    """What stands here is no statement the parser knows."""


class Token:
    __slots__ = ("end", "kind", "line", "newline", "parts", "start", "text")

    def __init__(self, kind: str, text: str, line: int, newline: bool, start: int, end: int, parts: list | None = None) -> None:
        self.kind, self.text, self.line, self.newline, self.start, self.end, self.parts = kind, text, line, newline, start, end, parts


def plain_text(quoted: str) -> str:
    """The value of a quoted text without its quotes."""

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "ux" and len(x) > 1:
            try:
                return chr(int(x.strip("ux{}"), 16))
            except (ValueError, OverflowError):
                return x
        return _PLAIN.get(x, x)

    return _ESCAPE.sub(one, quoted) if "\\" in quoted else quoted


class Reader:
    """Tokens on demand, as what a slash or an angle is depends on what stands before."""

    def __init__(self, source: str, line: int = 1) -> None:
        self.source, self.at, self.line, self.ends = source, 0, line, 0
        self.tokens: list[Token] = []

    def token(self, i: int) -> Token:
        while len(self.tokens) <= i:
            self.tokens.append(self.next())
        return self.tokens[i]

    def next(self) -> Token:
        s, newline = self.source, False
        m = _SPACE.match(s, self.at)
        if m:
            newline = "\n" in m[0]
            self.line += m[0].count("\n")
            self.at = m.end()
        if self.at >= len(s):
            # who goes on and on behind the end waits for something that never comes
            self.ends += 1
            if self.ends > MAX_ENDS:
                raise Unreadable("end")
            return Token("end", "", self.line, True, self.at, self.at)
        start, line, c = self.at, self.line, s[self.at]
        last = self.tokens[-1] if self.tokens else None
        operand = last is None or (last.text in _BEFORE_OPERAND and last.kind in ("mark", "word"))
        if c == "`":
            parts = self.template()
            return Token("template", "`", line, newline, start, self.at, parts)
        for kind, pattern in (("word", _WORD), ("number", _NUMBER), ("text", _STRING)):
            m = pattern.match(s, self.at)
            if m:
                break
        else:
            kind, m = "regex", _REGEX.match(s, self.at) if c == "/" and operand else None
            if m is None:
                kind, m = "mark", _MARK.match(s, self.at)
        if m is None:
            raise Unreadable(s[self.at])
        self.at = m.end()
        self.line += m[0].count("\n")
        return Token(kind, m[0], line, newline, start, self.at)

    def template(self) -> list:
        """The texts of a template and the sources of what is put in, in turn."""
        s, parts, begin = self.source, [], self.at + 1
        i = begin
        while i < len(s):
            if s[i] == "\\":
                i += 2
            elif s[i] == "`":
                parts.append(s[begin:i])
                self.line += s.count("\n", self.at, i)
                self.at = i + 1
                return parts
            elif s.startswith("${", i):
                parts.append(s[begin:i])
                line = self.line + s.count("\n", self.at, i)
                inner = Reader(s[: len(s)], line)
                inner.at = i + 2
                level, k = 0, 0
                while True:
                    t = inner.token(k)
                    if t.kind == "end":
                        raise Unreadable("`")
                    level += (t.text == "{") - (t.text == "}") if t.kind == "mark" else 0
                    if level < 0:
                        break
                    k += 1
                parts.append((s[i + 2 : t.start], line))
                i = begin = t.end
            else:
                i += 1
        raise Unreadable("`")


class Parser:
    def __init__(self, path: str, source: str, line: int = 1, outer: Parser | None = None) -> None:
        self.path, self.r, self.i = path, Reader(source, line), 0
        self.typed = not path.endswith((".js", ".jsx", ".mjs", ".cjs"))
        self.markup = not path.endswith((".ts", ".mts", ".cts"))
        self.root = outer.root if outer else self
        self.hoisted: list[ast.stmt] = outer.hoisted if outer else []
        self.partial, self.made, self.in_switch = False, 0, False
        self.no_in = self.no_result_type = False

    # ---- tokens

    @property
    def t(self) -> Token:
        return self.r.token(self.i)

    def peek(self, n: int = 1) -> Token:
        return self.r.token(self.i + n)

    def is_(self, *texts: str) -> bool:
        return self.t.text in texts and self.t.kind in ("mark", "word")

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.i += 1
            return True
        return False

    def want(self, text: str) -> Token:
        t = self.t
        if not self.is_(text):
            raise Unreadable(f"{t.text!r} for {text!r}")
        self.i += 1
        return t

    def name(self) -> str:
        t = self.t
        if t.kind != "word":
            raise Unreadable(t.text)
        self.i += 1
        return t.text

    def fresh(self, kind: str) -> str:
        self.root.made += 1
        return f"<{kind}{self.root.made}>"

    def put(self, node: ast.AST, line: int) -> ast.AST:
        node.lineno, node.col_offset = line, 0
        return node

    def ref(self, name: str, line: int) -> ast.expr:
        return self.put(ast.Name("self" if name == "this" else name, ast.Load()), line)

    def skip_to(self, close: str) -> None:
        """Past the bracket that closes the one just taken."""
        level = 1
        opens = {")": "(", "]": "[", "}": "{"}[close]
        while level:
            t = self.t
            if t.kind == "end":
                raise Unreadable(close)
            if t.kind == "mark":
                level += (t.text == opens) - (t.text == close)
            self.i += 1

    # ---- types

    def type_(self, stops: tuple[str, ...]) -> None:
        """Skip a type up to one of ``stops`` outside brackets."""
        level, first = 0, True
        while True:
            t = self.t
            if t.kind == "end":
                return
            if t.kind in ("mark", "word") and level == 0 and t.text in stops and not (first and t.text == "{"):
                return
            if t.kind == "mark" and level == 0 and t.text in (")", "]", "}", ";"):
                return
            if level == 0 and t.newline and not first and t.text not in ("|", "&", "=>", "extends", "?", ":", ".") and self.r.token(self.i - 1).text not in ("|", "&", "=>", ":", "<", "extends", "?"):
                return
            if t.kind == "mark":
                level += t.text in ("(", "[", "{", "<")
                level -= t.text in (")", "]", "}", ">")
                if t.text == "=>" and level == 0 and "=>" in stops:
                    return
            first = False
            self.i += 1

    def angles(self) -> bool:
        """Skip type parameters or arguments if what stands here is such, before a bracket."""
        if not self.typed or not self.is_("<"):
            return False
        j, level = self.i, 0
        while j - self.i < 200:
            t = self.r.token(j)
            if t.kind == "mark" and t.text == "<":
                level += 1
            elif t.kind == "mark" and t.text == ">":
                level -= 1
                if level == 0:
                    after = self.r.token(j + 1)
                    if after.text == "(" or after.kind == "template":
                        self.i = j + 1
                        return True
                    return False
            elif t.kind not in ("word", "text", "number") and t.text not in (",", ".", "[", "]", "|", "&", "{", "}", ":", ";", "?", "=>", "(", ")", "="):
                return False
            j += 1
        return False

    # ---- statements

    def program(self) -> list[ast.stmt]:
        out: list[ast.stmt] = []
        while True:
            try:
                if self.t.kind == "end":
                    return out
            except Unreadable:
                self.partial = True
                self.r.at += 1
                if self.r.at >= len(self.r.source):
                    return out
                continue
            self.into(out)

    def into(self, out: list[ast.stmt]) -> None:
        """One statement, and what it hoists before itself; an unreadable one is skipped."""
        held, self.hoisted = self.hoisted, []
        start = self.i
        try:
            got = self.statement()
        except (Unreadable, RecursionError):
            got, self.hoisted, self.root.partial = [], [], True
            self.i = start
            self.recover()
        out += self.hoisted + got
        self.hoisted = held

    def recover(self) -> None:
        level, first = 0, True
        while True:
            try:
                t = self.t
            except Unreadable:
                self.r.at += 1
                if self.r.at >= len(self.r.source):
                    return
                continue
            if t.kind == "end" or level == 0 and not first and (t.newline or t.text == "}"):
                return
            if t.kind == "mark":
                level += (t.text in "([{") - (t.text in ")]}")
                if level < 0:
                    self.i += first
                    return
            self.i += 1
            first = False
            if t.text == ";" and level == 0:
                return

    def block(self) -> list[ast.stmt]:
        out: list[ast.stmt] = []
        self.want("{")
        while not self.is_("}"):
            if self.t.kind == "end":
                raise Unreadable("}")
            self.into(out)
        self.i += 1
        return out

    def body(self) -> list[ast.stmt]:
        """The statements of an arm: a block or a single one."""
        if self.is_("{"):
            return self.block()
        out: list[ast.stmt] = []
        self.into(out)
        return out

    def end(self) -> None:
        if not self.take(";") and not (self.is_("}") or self.t.newline or self.t.kind == "end" or self.is_(")")):
            raise Unreadable(self.t.text)

    def statement(self) -> list[ast.stmt]:
        t = self.t
        if t.kind == "word":
            after = self.peek()
            if after.text == ":" and t.text not in ("default", "case"):
                self.i += 2
                return self.statement()
            read = getattr(self, "w_" + t.text, None)
            if read is not None and not (after.kind == "mark" and after.text in ("=", ".", ",", ")") and t.text in ("type", "of", "async", "declare", "abstract", "enum", "interface", "namespace", "module")):
                got = read()
                if got is not None:
                    return got
        elif t.text == "{":
            return self.block()
        elif t.text == ";":
            self.i += 1
            return []
        elif t.text == "@":
            return self.decorated()
        e = self.expression()
        self.end()
        return self.as_statement(e, t.line)

    def as_statement(self, e: ast.expr, line: int) -> list[ast.stmt]:
        return [self.put(ast.Expr(e), line)]

    def assign(self, target: ast.expr, value: ast.expr, line: int) -> ast.stmt:
        return self.put(ast.Assign([target], value), line)

    def w_var(self) -> list[ast.stmt]:
        self.i += 1
        if self.is_("enum"):
            return self.w_enum()
        out = self.declarations()
        self.end()
        return out

    w_let = w_const = w_using = w_var

    def declarations(self) -> list[ast.stmt]:
        out: list[ast.stmt] = []
        while True:
            line = self.t.line
            target = self.pattern()
            self.take("!")
            if self.typed and self.take(":"):
                self.type_(("=", ",", ";", "of", "in"))
            if self.take("="):
                value = self.named_value(target)
                before, self.hoisted = self.hoisted, []
                out += before + self.bind(target, value, line)
            elif not isinstance(target, ast.Name):
                out += self.bind(target, self.ref("undefined", line), line) if not self.is_("of", "in") else [self.assign(target, self.put(ast.Constant(None), line), line)]
            if not self.take(","):
                return out

    def named_value(self, target: ast.expr) -> ast.expr:
        """A value; a function takes the name it is given to."""
        self.given = target.id if isinstance(target, ast.Name) else ""
        try:
            return self.assignment()
        finally:
            self.given = ""

    given = ""

    def bind(self, target: ast.expr | tuple, value: ast.expr, line: int) -> list[ast.stmt]:
        """Assignments of a pattern's parts."""
        package = self.required(value)
        if package is not None:
            if isinstance(target, ast.Name):
                return [self.put(ast.Import([ast.alias(package, target.id)]), line)]
            if isinstance(target, tuple) and target[0] == "object" and all(isinstance(p, ast.Name) for _, p, _ in target[1]):
                return [self.put(ast.ImportFrom(package, [ast.alias(k, p.id) for k, p, _ in target[1]], 0), line)]
        if isinstance(target, ast.Name) and isinstance(value, ast.Name) and target.id == value.id:
            return []
        if not isinstance(target, tuple):
            return [self.assign(target, value, line)]
        kind, parts = target
        out: list[ast.stmt] = []
        if not isinstance(value, ast.Name):
            held = self.put(ast.Name(self.fresh("d"), ast.Store()), line)
            out.append(self.assign(held, value, line))
            value = self.ref(held.id, line)
        for i, (key, part, default) in enumerate(parts):
            if part is None:
                continue
            if key == "...":
                got: ast.expr = value
            elif kind == "list":
                got = self.put(ast.Subscript(value, self.put(ast.Constant(i), line), ast.Load()), line)
            elif isinstance(key, ast.expr):
                got = self.put(ast.Subscript(value, key, ast.Load()), line)
            else:
                got = self.put(ast.Attribute(value, key, ast.Load()), line)
            if default is not None:
                got = self.put(ast.BoolOp(ast.Or(), [got, default]), line)
            out += self.bind(part, got, line)
        return out

    def required(self, value: ast.expr) -> str | None:
        if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id == "require" and len(value.args) == 1 and isinstance(value.args[0], ast.Constant) and isinstance(value.args[0].value, str):
            return self.package(value.args[0].value)
        return None

    def package(self, text: str) -> str:
        """A package's name, or the module that a relative path means."""
        if not text.startswith("."):
            return text.removeprefix("node:")
        at = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), text))
        return module_name(at if re.search(r"\.(?:[cm]?[jt]sx?|vue)$", at) else at + ".js")

    def pattern(self) -> ast.expr | tuple:
        """A name, or ('object' or 'list', [(key, pattern, default)])."""
        line = self.t.line
        if self.take("{"):
            parts = []
            while not self.take("}"):
                if self.take("..."):
                    parts.append(("...", self.pattern(), None))
                else:
                    key: str | ast.expr
                    if self.take("["):
                        key = self.assignment()
                        self.want("]")
                    else:
                        key = plain_text(self.t.text[1:-1]) if self.t.kind == "text" else self.t.text
                        self.i += 1
                    part = self.pattern() if self.take(":") else self.put(ast.Name(key, ast.Store()), line)
                    parts.append((key, part, self.assignment() if self.take("=") else None))
                self.take(",")
            return "object", parts
        if self.take("["):
            parts = []
            while not self.take("]"):
                if self.take(","):
                    parts.append(("", None, None))
                    continue
                rest = self.take("...")
                part = self.pattern()
                parts.append(("..." if rest else "", part, self.assignment() if self.take("=") else None))
                self.take(",")
            return "list", parts
        return self.put(ast.Name(self.name(), ast.Store()), line)

    def w_function(self) -> list[ast.stmt]:
        return [self.function()]

    def w_async(self) -> list[ast.stmt] | None:
        if self.peek().text == "function" and not self.peek().newline:
            self.i += 1
            return [self.function()]
        return None

    def function(self, default: str = "") -> ast.stmt:
        line = self.want("function").line
        self.take("*")
        name = self.name() if self.t.kind == "word" else default or self.fresh("fn")
        return self.finish(name, line)

    def finish(self, name: str, line: int, decorators: list[ast.expr] | None = None) -> ast.stmt:
        """A function from its parameters on."""
        self.angles()
        args, first = self.parameters()
        if self.typed and self.take(":"):
            self.type_(("{",))
        if not self.is_("{"):
            self.end()  # an overload or an abstract method
            return self.put(ast.Pass(), line)
        held, self.in_switch = (self.in_switch, self.given), False
        self.given = ""
        body = self.block()
        self.in_switch, self.given = held
        return self.define(name, args, first + body, line, decorators)

    def define(self, name: str, args: list[ast.arg], body: list[ast.stmt], line: int, decorators: list[ast.expr] | None = None) -> ast.stmt:
        a = ast.arguments(posonlyargs=[], args=args, vararg=None, kwonlyargs=[], kw_defaults=[], kwarg=None, defaults=[])
        return self.put(ast.FunctionDef(name, a, body or [self.put(ast.Pass(), line)], decorators or [], None), line)

    def parameters(self) -> tuple[list[ast.arg], list[ast.stmt]]:
        """The parameters in brackets, and the assignments that patterns and defaults among them need."""
        args, first = [], []
        self.want("(")
        while not self.take(")"):
            while self.take("@"):
                self.unary()
            self.take("...")
            while self.t.text in _MODIFIERS and self.peek().kind == "word":
                self.i += 1
            line = self.t.line
            p = self.pattern()
            name = p.id if isinstance(p, ast.Name) else self.fresh("p")
            self.take("?")
            if self.typed and self.take(":"):
                self.type_(("=", ",", ")"))
            if self.take("="):
                value = self.assignment()
                first.append(self.assign(self.put(ast.Name(name, ast.Store()), line), self.put(ast.BoolOp(ast.Or(), [self.ref(name, line), value]), line), line))
            if isinstance(p, tuple):
                first += self.bind(p, self.ref(name, line), line)
            if name != "this":
                args.append(self.put(ast.arg(name), line))
            if not self.take(",") and not self.is_(")"):
                raise Unreadable(self.t.text)
        return args, first

    def decorated(self) -> list[ast.stmt]:
        found = self.decorators()
        got = self.statement()
        for s in got:
            if isinstance(s, ast.ClassDef):
                s.decorator_list = found
        return got

    def decorators(self) -> list[ast.expr]:
        out = []
        while self.take("@"):
            out.append(self.unary())
        return out

    def w_class(self) -> list[ast.stmt]:
        return [self.class_()]

    def w_abstract(self) -> list[ast.stmt]:
        self.i += 1
        return [self.class_()]

    def class_(self) -> ast.stmt:
        line = self.want("class").line
        name = self.name() if self.t.kind == "word" and not self.is_("extends", "implements") else self.given or self.fresh("class")
        bases = []
        if self.typed and self.is_("<"):
            self.type_(("extends", "implements", "{"))
        if self.take("extends"):
            bases.append(self.unary())
            if self.typed and self.is_("<"):
                self.type_(("implements", "{"))
        if self.take("implements"):
            self.type_(("{",))
        self.want("{")
        body: list[ast.stmt] = []
        while not self.take("}"):
            if not self.take(";"):
                self.member(body)
        return self.put(ast.ClassDef(name, bases, [], body or [self.put(ast.Pass(), line)], []), line)

    def member(self, out: list[ast.stmt]) -> None:
        decorators = self.decorators()
        if self.is_("static") and self.peek().text == "{":
            self.i += 1
            out += self.block()
            return
        while self.t.text in _MODIFIERS and self.peek().text not in ("(", "=", ";", ":", "?", "!", "}", "<") and not (self.peek().newline and self.t.text not in ("async", "static")):
            self.i += 1
        self.take("*")
        line = self.t.line
        if self.take("["):
            self.assignment_or_type()
            self.want("]")
            name = self.fresh("key")
        else:
            name = plain_text(self.t.text[1:-1]) if self.t.kind == "text" else self.t.text
            self.i += 1
        self.take("?")
        self.take("!")
        if self.is_("(", "<"):
            out.append(self.finish("__init__" if name == "constructor" else name, line, decorators))
            return
        if self.typed and self.take(":"):
            self.type_(("=", ";"))
        if self.take("="):
            held, self.hoisted, self.given = self.hoisted, [], name
            value = self.assignment()
            made, self.hoisted, self.given = self.hoisted, held, ""
            out += made
            if not (isinstance(value, ast.Name) and value.id == name):
                out.append(self.assign(self.put(ast.Name(name, ast.Store()), line), value, line))
        self.end()

    def assignment_or_type(self) -> None:
        e = self.assignment()
        if self.typed and isinstance(e, ast.Name) and self.take(":"):
            self.type_(("]",))

    def w_if(self) -> list[ast.stmt]:
        line = self.want("if").line
        self.want("(")
        test = self.expression()
        self.want(")")
        body = self.body()
        orelse = self.body() if self.take("else") else []
        return [self.put(ast.If(test, body or [self.put(ast.Pass(), line)], orelse), line)]

    def loop_body(self) -> list[ast.stmt]:
        held, self.in_switch = self.in_switch, False
        out = self.body()
        self.in_switch = held
        return out or [self.put(ast.Pass(), self.t.line)]

    def w_while(self) -> list[ast.stmt]:
        line = self.want("while").line
        self.want("(")
        test = self.expression()
        self.want(")")
        return [self.put(ast.While(test, self.loop_body(), []), line)]

    def w_do(self) -> list[ast.stmt]:
        line = self.want("do").line
        body = self.loop_body()
        self.want("while")
        self.want("(")
        test = self.expression()
        self.want(")")
        self.take(";")
        return [self.put(ast.While(test, body, []), line)]

    def w_for(self) -> list[ast.stmt]:
        line = self.want("for").line
        self.take("await")
        self.want("(")
        first: list[ast.stmt] = []
        target: ast.expr | tuple | None = None
        start = self.i
        self.no_in = True
        try:
            if self.take("var", "let", "const"):
                at = self.i
                target = self.pattern()
                if not self.is_("of", "in"):
                    self.i, target = at, None
                    first = self.declarations()
            elif not self.is_(";"):
                e = self.expression()
                target = e if self.is_("of", "in") else None
                first = [] if target is not None else self.as_statement(e, line)
        finally:
            self.no_in = False
        if target is not None:
            self.i += 1
            it = self.expression()
            self.want(")")
            name = target if isinstance(target, ast.Name) else self.put(ast.Name(self.fresh("each"), ast.Store()), line)
            body = self.loop_body()
            if isinstance(target, tuple):
                body = self.bind(target, self.ref(name.id, line), line) + body
            return [self.put(ast.For(name, it, body, []), line)]
        if self.i == start and not self.is_(";"):
            raise Unreadable(self.t.text)
        self.want(";")
        test = self.expression() if not self.is_(";") else self.ref("undefined", line)
        self.want(";")
        step = [] if self.is_(")") else self.as_statement(self.expression(), line)
        self.want(")")
        return [*first, self.put(ast.While(test, self.loop_body() + step, []), line)]

    def w_return(self) -> list[ast.stmt]:
        line = self.want("return").line
        value = None if self.is_(";", "}") or self.t.newline or self.t.kind == "end" else self.expression()
        self.end()
        return [self.put(ast.Return(value), line)]

    def w_throw(self) -> list[ast.stmt]:
        line = self.want("throw").line
        value = self.expression()
        self.end()
        return [self.put(ast.Raise(value, None), line)]

    def w_break(self) -> list[ast.stmt]:
        line = self.want("break").line
        if self.t.kind == "word" and not self.t.newline:
            self.i += 1
        self.end()
        return [self.put(ast.Pass() if self.in_switch else ast.Break(), line)]

    def w_continue(self) -> list[ast.stmt]:
        line = self.want("continue").line
        if self.t.kind == "word" and not self.t.newline:
            self.i += 1
        self.end()
        return [self.put(ast.Continue(), line)]

    def w_debugger(self) -> list[ast.stmt]:
        self.i += 1
        self.end()
        return []

    def w_try(self) -> list[ast.stmt]:
        line = self.want("try").line
        body = self.block()
        handlers, last = [], []
        if self.take("catch"):
            name = None
            if self.take("("):
                p = self.pattern()
                name = p.id if isinstance(p, ast.Name) else None
                if self.typed and self.take(":"):
                    self.type_((")",))
                self.want(")")
            handlers.append(self.put(ast.ExceptHandler(None, name, self.block() or [self.put(ast.Pass(), line)]), line))
        if self.take("finally"):
            last = self.block()
        return [self.put(ast.Try(body, handlers, [], last), line)]

    def w_switch(self) -> list[ast.stmt]:
        line = self.want("switch").line
        self.want("(")
        subject = self.expression()
        self.want(")")
        self.want("{")
        held, self.in_switch = self.in_switch, True
        arms: list[tuple[ast.expr | None, list[ast.stmt], bool]] = []
        while not self.take("}"):
            test = None
            if not self.take("default"):
                self.want("case")
                test = self.expression()
            self.want(":")
            body: list[ast.stmt] = []
            ends = False
            while not self.is_("case", "default", "}"):
                ends = ends or self.is_("break", "return", "throw", "continue")
                self.into(body)
            arms.append((test, body, ends))
        self.in_switch = held
        cases = []
        for i, (test, body, ends) in enumerate(arms):
            # without an end an arm goes on in the next one
            j, whole = i, list(body)
            while not ends and j + 1 < len(arms):
                j += 1
                whole += arms[j][1]
                ends = arms[j][2]
            pattern = ast.MatchValue(test) if test is not None else ast.MatchAs(None, None)
            cases.append(ast.match_case(pattern, None, whole or [self.put(ast.Pass(), line)]))
        return [self.put(ast.Match(subject, cases), line)] if cases else self.as_statement(subject, line)

    def w_import(self) -> list[ast.stmt] | None:
        if self.peek().text in ("(", "."):
            return None
        line = self.want("import").line
        if self.is_("type") and self.peek().text not in ("from", ","):
            self.i += 1
        names: list[tuple[str | None, str]] = []
        if self.t.kind == "text":
            self.i += 1
            self.end()
            return []
        while not self.take("from"):
            if self.take("*"):
                self.want("as")
                names.append((None, self.name()))
            elif self.take("{"):
                names += self.specifiers()
            elif self.take("="):  # a name for require(...)
                e = self.assignment()
                self.end()
                return self.bind(self.put(ast.Name(names[-1][1], ast.Store()), line), e, line)
            else:
                names.append(("default", self.name()))
            self.take(",")
        return self.imported(names, line)

    def specifiers(self) -> list[tuple[str, str]]:
        out = []
        while not self.take("}"):
            if self.is_("type") and self.peek().text not in (",", "}", "as"):
                self.i += 1
            symbol = plain_text(self.t.text[1:-1]) if self.t.kind == "text" else self.t.text
            self.i += 1
            local = symbol
            if self.take("as"):
                local = self.t.text
                self.i += 1
            out.append((symbol, local))
            self.take(",")
        return out

    def imported(self, names: list[tuple[str | None, str]], line: int) -> list[ast.stmt]:
        if self.t.kind != "text":
            raise Unreadable(self.t.text)
        text = plain_text(self.t.text[1:-1])
        self.i += 1
        if self.take("with", "assert"):
            self.want("{")
            self.skip_to("}")
        self.end()
        package, out = self.package(text), []
        for symbol, local in names:
            if symbol is None or symbol == "default" and not text.startswith("."):
                out.append(self.put(ast.Import([ast.alias(package, local)]), line))
            else:
                out.append(self.put(ast.ImportFrom(package, [ast.alias(symbol, local)], 0), line))
        return out

    def w_export(self) -> list[ast.stmt]:
        line = self.want("export").line
        own = module_name(self.path)
        if self.take("default"):
            if self.is_("function", "class", "abstract") or self.is_("async") and self.peek().text == "function":
                self.take("async", "abstract")
                s = self.class_() if self.is_("class") else self.function("default")
                named = [] if s.name == "default" else [self.put(ast.ImportFrom(own, [ast.alias(s.name, "default")], 0), line)]
                return [*named, s]
            self.given = "default"
            e = self.assignment()
            self.given = ""
            self.end()
            if isinstance(e, ast.Name) and e.id != "default":
                return [self.put(ast.ImportFrom(own, [ast.alias(e.id, "default")], 0), line)]
            return self.as_statement(e, line)
        if self.take("*"):
            names: list[tuple[str | None, str]] = [(None, self.name())] if self.take("as") else []
            self.want("from")
            return self.imported(names, line)
        if self.is_("type") and self.peek().text == "{":
            self.i += 1
        if self.take("{"):
            names = self.specifiers()
            if self.take("from"):
                return self.imported(names, line)
            self.end()
            return [self.put(ast.ImportFrom(own, [ast.alias(s, x)], 0), line) for s, x in names if s != x]
        if self.take("="):
            return self.as_statement(self.expression(), line)
        return self.statement()

    def w_interface(self) -> list[ast.stmt] | None:
        if self.peek().kind != "word" or not self.typed:
            return None
        while not self.take("{"):
            self.i += 1
        self.skip_to("}")
        return []

    def w_type(self) -> list[ast.stmt] | None:
        if self.peek().kind != "word" or not self.typed:
            return None
        self.i += 2
        if self.is_("<"):
            self.type_(("=",))
        self.want("=")
        self.type_((";",))
        self.take(";")
        return []

    def w_enum(self) -> list[ast.stmt]:
        self.want("enum")
        self.name()
        self.want("{")
        self.skip_to("}")
        return []

    def w_declare(self) -> list[ast.stmt] | None:
        if self.peek().kind != "word":
            return None
        self.i += 1
        if self.is_("module", "namespace", "global"):
            while not self.take("{"):
                self.i += 1
            self.skip_to("}")
            return []
        return self.statement()

    def w_namespace(self) -> list[ast.stmt] | None:
        if self.peek().kind != "word":
            return None
        while not self.is_("{"):
            self.i += 1
        return self.block()

    # ---- expressions

    def expression(self) -> ast.expr:
        e = self.assignment()
        while self.is_(","):
            self.i += 1
            self.hoisted += self.as_statement(e, self.t.line)
            e = self.assignment()
        return e

    def arrow(self) -> ast.expr | None:
        """A function by arrow, if one begins here."""
        j = self.i
        if self.r.token(j).text == "async" and not self.r.token(j + 1).newline and (self.r.token(j + 1).kind == "word" or self.r.token(j + 1).text in ("(", "<")):
            j += 1
        t = self.r.token(j)
        line = t.line
        if t.kind == "word":
            if self.r.token(j + 1).text != "=>" or t.text in ("async",) and j == self.i and self.r.token(j + 1).text != "=>":
                return None
            self.i = j + 2
            return self.arrow_body([self.put(ast.arg(t.text), line)], [], line)
        start = self.i
        if t.text == "<" and self.typed:
            self.i = j
            if not self.angles():
                self.i = start
                return None
            j = self.i
            t = self.r.token(j)
        if t.text != "(" or t.kind != "mark":
            self.i = start
            return None
        k, level = j, 0
        while True:
            x = self.r.token(k)
            if x.kind == "end":
                self.i = start
                return None
            if x.kind == "mark":
                level += (x.text in ("(", "[", "{")) - (x.text in (")", "]", "}"))
                if level == 0:
                    break
            k += 1
        after = self.r.token(k + 1)
        if after.text != "=>" and not (self.typed and after.text == ":" and not self.no_result_type):
            self.i = start
            return None
        held = list(self.hoisted)
        try:
            self.i = j
            args, first = self.parameters()
            if self.typed and self.take(":"):
                self.type_(("=>",))
            self.want("=>")
        except Unreadable:
            self.i, self.hoisted = start, held
            return None
        return self.arrow_body(args, first, line)

    def arrow_body(self, args: list[ast.arg], first: list[ast.stmt], line: int) -> ast.expr:
        name, self.given = self.given or self.fresh("fn"), ""
        held, self.in_switch = self.in_switch, False
        if self.is_("{"):
            body = self.block()
        else:
            outer, self.hoisted = self.hoisted, []
            value = self.assignment()
            body = [*self.hoisted, self.put(ast.Return(value), line)]
            self.hoisted = outer
        self.in_switch = held
        self.hoisted.append(self.define(name, args, first + body, line))
        return self.ref(name, line)

    def assignment(self) -> ast.expr:
        made = self.arrow()
        if made is not None:
            return made
        given, self.given = self.given, ""
        line, start = self.t.line, self.i
        if self.is_("yield"):
            self.i += 1
            self.take("*")
            return self.ref("undefined", line) if self.is_(")", "]", "}", ",", ";") or self.t.newline else self.assignment()
        if self.is_("{", "[") and self.destructures():
            target = self.pattern()
            self.want("=")
            value = self.assignment()
            self.hoisted += self.bind(target, value, line)
            return value
        if given and self.is_("function", "class", "async"):
            self.given = given
        left = self.conditional()
        self.given = ""
        if self.t.kind == "mark" and self.t.text in _ASSIGN:
            op = self.t.text
            if not isinstance(left, (ast.Name, ast.Attribute, ast.Subscript)):
                raise Unreadable(op)
            self.i += 1
            name = left.id if isinstance(left, ast.Name) else left.attr if isinstance(left, ast.Attribute) else ""
            self.given = name if op == "=" and re.fullmatch(r"[\w$]+", name) else ""
            value = self.assignment()
            self.given = ""
            if op in ("&&=", "||=", "??="):
                value = self.put(ast.BoolOp(ast.Or(), [left, value]), line)
            elif op != "=":
                value = self.put(ast.BinOp(left, _BINARY[op[:-1]](), value), line)
            if not (isinstance(left, ast.Name) and isinstance(value, ast.Name) and value.id == left.id):
                self.hoisted.append(self.assign(left, value, line))
            return left
        if self.i == start:
            raise Unreadable(self.t.text)
        return left

    def destructures(self) -> bool:
        """Whether the bracket that opens here closes before an equals sign."""
        k, level = self.i, 0
        while True:
            x = self.r.token(k)
            if x.kind == "end":
                return False
            if x.kind == "mark":
                level += (x.text in ("(", "[", "{")) - (x.text in (")", "]", "}"))
                if level == 0:
                    return self.r.token(k + 1).text == "=" and self.r.token(k + 1).kind == "mark"
            k += 1

    def conditional(self) -> ast.expr:
        test = self.binary(0)
        if not self.is_("?"):
            return test
        line = self.t.line
        self.i += 1
        held, self.no_in, self.no_result_type = (self.no_in, self.no_result_type), False, True
        a = self.assignment()
        self.no_in, self.no_result_type = held
        self.want(":")
        return self.put(ast.IfExp(test, a, self.assignment()), line)

    def binary(self, least: int) -> ast.expr:
        left = self.unary()
        while True:
            t = self.t
            if self.typed and t.kind == "word" and t.text in ("as", "satisfies") and not t.newline:
                self.i += 1
                self.type_((",", ")", "]", "}", ";", "?", ":", "||", "&&", "??", "=", "=>", "+", "-", "*", "/", "==", "===", "!=", "!==", "as", "instanceof", "in", "of", "."))
                continue
            op = t.text
            if op == ">" and self.peek().text == ">" and self.peek().start == t.end:
                op = ">>>" if self.peek(2).text == ">" and self.peek(2).start == self.peek().end else ">>"
            strength = _STRENGTH.get(op, -1) if t.kind in ("mark", "word") else -1
            if strength < least or op == "in" and self.no_in:
                return left
            self.i += len(op) if op in (">>", ">>>") else 1
            right = self.binary(strength + (op != "**"))
            if op in ("&&", "||", "??"):
                node: ast.expr = ast.BoolOp(ast.And() if op == "&&" else ast.Or(), [left, right])
            elif op in _COMPARE:
                node = ast.Compare(left, [_COMPARE[op]()], [right])
            else:
                node = ast.BinOp(left, _BINARY[op](), right)
            left = self.put(node, t.line)

    def unary(self) -> ast.expr:
        t = self.t
        if t.kind == "mark" and t.text in ("!", "-", "+", "~", "++", "--"):
            self.i += 1
            operand = self.unary()
            if t.text in ("++", "--"):
                return operand
            return self.put(ast.UnaryOp({"!": ast.Not, "-": ast.USub, "+": ast.UAdd, "~": ast.Invert}[t.text](), operand), t.line)
        if t.kind == "word" and t.text in ("typeof", "void", "delete") and not (self.peek().kind == "mark" and self.peek().text in ("=", ",", ")", ";", ":")):
            self.i += 1
            return self.put(ast.UnaryOp(ast.Not(), self.unary()), t.line)
        if t.kind == "word" and t.text == "await" and (self.peek().kind != "mark" or self.peek().text in ("(", "[", "{", "!", "`")):
            self.i += 1
            return self.unary()
        if t.text == "<" and t.kind == "mark":
            if self.markup and (self.peek().kind == "word" or self.peek().text == ">"):
                return self.element()
            if self.typed:
                self.i += 1
                self.type_((">",))
                self.want(">")
                return self.unary()
        e = self.postfix(self.primary())
        if self.t.kind == "mark" and self.t.text in ("++", "--") and not self.t.newline:
            self.i += 1
        return e

    def arguments(self) -> list[ast.expr]:
        out: list[ast.expr] = []
        self.want("(")
        held, self.no_in = self.no_in, False
        while not self.take(")"):
            line = self.t.line
            if self.take("..."):
                out.append(self.put(ast.Starred(self.assignment(), ast.Load()), line))
            else:
                out.append(self.assignment())
            if not self.take(",") and not self.is_(")"):
                raise Unreadable(self.t.text)
        self.no_in = held
        return out

    def postfix(self, e: ast.expr, calls: bool = True) -> ast.expr:
        while True:
            t = self.t
            if t.kind == "template":
                self.i += 1
                e = self.put(ast.Call(e, [self.template(t)], []), t.line)
            elif t.kind != "mark":
                return e
            elif t.text in (".", "?."):
                self.i += 1
                if t.text == "?." and self.is_("("):
                    e = self.put(ast.Call(e, self.arguments(), []), t.line)
                elif t.text == "?." and self.is_("["):
                    continue
                else:
                    e = self.put(ast.Attribute(e, self.name(), ast.Load()), t.line)
            elif t.text == "[":
                self.i += 1
                held, self.no_in = self.no_in, False
                key = self.expression()
                self.no_in = held
                self.want("]")
                e = self.put(ast.Attribute(e, key.value, ast.Load()) if isinstance(key, ast.Constant) and isinstance(key.value, str) else ast.Subscript(e, key, ast.Load()), t.line)
            elif t.text == "(" and calls:
                e = self.put(ast.Call(e, self.arguments(), []), t.line)
            elif t.text == "!" and self.typed and not t.newline:
                self.i += 1
            elif t.text == "<" and calls and self.angles():
                continue
            else:
                return e

    def primary(self) -> ast.expr:
        t = self.t
        self.i += 1
        if t.kind == "text":
            return self.put(ast.Constant(plain_text(t.text[1:-1])), t.line)
        if t.kind == "number":
            return self.put(ast.Constant(_number(t.text)), t.line)
        if t.kind == "regex":
            return self.put(ast.Constant(t.text), t.line)
        if t.kind == "template":
            return self.template(t)
        if t.kind == "word":
            if t.text in ("true", "false", "null", "undefined"):
                return self.put(ast.Constant({"true": True, "false": False}.get(t.text)), t.line)
            if t.text == "function" or t.text == "async" and self.is_("function"):
                self.i -= t.text == "function"
                s = self.function(self.given)
                self.hoisted.append(s)
                return self.ref(s.name, t.line)
            if t.text == "class":
                self.i -= 1
                s = self.class_()
                self.hoisted.append(s)
                return self.ref(s.name, t.line)
            if t.text == "new":
                if self.take("."):
                    self.name()
                    return self.ref("undefined", t.line)
                made = self.postfix(self.primary(), calls=False)
                self.angles()
                return self.put(ast.Call(made, self.arguments() if self.is_("(") else [], []), t.line)
            return self.ref(t.text, t.line)
        if t.text == "(":
            held, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = held
            self.want(")")
            return e
        if t.text == "[":
            items: list[ast.expr] = []
            while not self.take("]"):
                if self.take(","):
                    continue
                line = self.t.line
                items.append(self.put(ast.Starred(self.assignment(), ast.Load()), line) if self.take("...") else self.assignment())
                if not self.take(",") and not self.is_("]"):
                    raise Unreadable(self.t.text)
            return self.put(ast.List(items, ast.Load()), t.line)
        if t.text == "{":
            return self.object_(t.line)
        if t.text == "@":
            self.i -= 1
            self.decorators()
            return self.primary()
        raise Unreadable(t.text)

    def object_(self, line: int) -> ast.expr:
        keys: list[ast.expr | None] = []
        values: list[ast.expr] = []
        held, self.no_in = self.no_in, False
        while not self.take("}"):
            at = self.t.line
            if self.take("..."):
                keys.append(None)
                values.append(self.assignment())
            else:
                while self.t.text in ("async", "get", "set") and self.peek().text not in ("(", ",", ":", "}", "="):
                    self.i += 1
                self.take("*")
                word = self.t.kind == "word"
                if self.take("["):
                    key = self.assignment()
                    self.want("]")
                    name = ""
                else:
                    name = plain_text(self.t.text[1:-1]) if self.t.kind == "text" else self.t.text
                    if self.t.kind not in ("word", "text", "number"):
                        raise Unreadable(name)
                    self.i += 1
                    key = self.put(ast.Constant(name), at)
                if self.is_("(") or self.typed and self.is_("<"):
                    s = self.finish(name if re.fullmatch(r"[\w$]+", name) else self.fresh("fn"), at)
                    self.hoisted.append(s)
                    value: ast.expr = self.ref(getattr(s, "name", "undefined"), at)
                elif self.take(":"):
                    self.given = name if re.fullmatch(r"[A-Za-z_$][\w$]*", name) else ""
                    value = self.assignment()
                elif word:
                    value = self.ref(name, at)
                    if self.take("="):
                        self.assignment()
                else:
                    raise Unreadable(self.t.text)
                keys.append(key)
                values.append(value)
            if not self.take(",") and not self.is_("}"):
                raise Unreadable(self.t.text)
        self.no_in = held
        return self.put(ast.Dict(keys, values), line)

    def inner(self, source: str, line: int) -> ast.expr:
        """An expression that stands within a text of its own."""
        p = Parser(self.path, source, line, self)
        e = p.expression()
        if p.t.kind != "end":
            raise Unreadable(p.t.text)
        self.hoisted = p.hoisted
        return e

    def template(self, t: Token) -> ast.expr:
        values: list[ast.expr] = []
        for part in t.parts:
            if isinstance(part, str):
                if part:
                    values.append(self.put(ast.Constant(plain_text(part)), t.line))
            else:
                values.append(self.put(ast.FormattedValue(self.inner(*part), -1, None), part[1]))
        return self.put(ast.JoinedStr(values), t.line) if values else self.put(ast.Constant(""), t.line)

    # ---- markup

    def element(self) -> ast.expr:
        """An element as what its attributes take and what stands in it: attributes are stores into 'markup'."""
        line = self.want("<").line
        out: list[ast.expr] = []
        name = ""
        while self.t.kind == "word" or self.is_(".", "-", ":"):
            if name and self.t.kind == "word" and self.r.token(self.i - 1).kind == "word":
                break
            name += self.t.text
            self.i += 1
        while not self.slash().is_(">", "/"):
            if self.take("{"):
                self.take("...")
                out.append(self.assignment())
                self.want("}")
                continue
            at, attribute = self.t.line, ""
            while self.t.kind == "word" or self.is_("-", ":"):
                if attribute and self.t.kind == "word" and self.r.token(self.i - 1).kind == "word":
                    break
                attribute += self.t.text
                self.i += 1
            if not attribute:
                raise Unreadable(self.t.text)
            if self.take("="):
                if self.take("{"):
                    value = self.assignment()
                    self.want("}")
                elif self.t.kind == "text":
                    value = self.put(ast.Constant(self.t.text[1:-1]), at)
                    self.i += 1
                else:
                    value = self.element()
                store = self.put(ast.Attribute(self.ref("markup", at), attribute + "=", ast.Load()), at)
                out.append(self.put(ast.Call(store, [value], []), at))
        if self.take("/"):
            self.want(">")
        else:
            # text between elements is no code: it is read from the source, not as tokens
            at = self.t.end
            self.to(at)
            self.children(name, out)
        return self.put(ast.Tuple(out, ast.Load()), line)

    def slash(self) -> Parser:
        """Within an element a slash ends it and begins no regular expression."""
        t, r = self.t, self.r
        if t.kind == "regex":
            r.tokens[self.i :] = [Token("mark", "/", t.line, t.newline, t.start, t.start + 1)]
            r.at, r.line = t.start + 1, t.line
        return self

    def to(self, at: int) -> None:
        """Go on reading at a place of the source, behind the token that is current."""
        r = self.r
        t = r.token(self.i)
        del r.tokens[self.i + 1 :]
        r.line = t.line + r.source.count("\n", t.start, at)
        r.at = at

    def children(self, name: str, out: list[ast.expr]) -> None:
        while True:
            r = self.r
            m = re.compile(r"[^<{]*").match(r.source, r.at)
            self.to_text(m.end())
            if r.at >= len(r.source):
                raise Unreadable(name)
            self.i = len(r.tokens)
            if self.t.text == "{":
                self.i += 1
                if not self.is_("}"):
                    self.take("...")
                    out.append(self.expression())
                close = self.t
                if close.text != "}":
                    raise Unreadable(close.text)
                self.to(close.end)
            elif re.compile(r"\s*/").match(r.source, self.t.end):
                close = r.source.find(">", self.t.end)
                if close < 0:
                    raise Unreadable(name)
                self.to(close + 1)
                self.i += 1
                return
            else:
                out.append(self.element())
                last = self.r.tokens[self.i - 1]
                del self.r.tokens[self.i :]
                self.r.at, self.r.line = last.end, last.line

    def to_text(self, at: int) -> None:
        r = self.r
        r.line += r.source.count("\n", r.at, at)
        r.at = at


def _number(text: str) -> object:
    text = text.replace("_", "").rstrip("n")
    try:
        return int(text, 0) if not re.search(r"[.eE]", text) or text[:2] in ("0x", "0X") else float(text)
    except ValueError:
        return text


def module_name(path: str) -> str:
    """The dotted module of a file; an index file is its folder."""
    name = python_ast.module_name(path)
    return name.removesuffix(".index") if name != "index" else name


def lower(path: str, source: str) -> dict:
    """The tables of one file; partial if a statement of it could not be read."""
    if path.endswith(".vue") and re.search(r"<(?:script|template|style)\b", source):
        source = blank_outside_scripts(source)
    p = Parser(path, source)
    body = p.program()
    m = python_ast.Module(path, tree=ast.Module(body, []), module=module_name(path))
    return {**m.out, "module": m.module, "partial": p.partial}
