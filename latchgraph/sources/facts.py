"""Syntax and reference facts of Python files.

Each file is parsed on an executor with the standard ``ast`` module and gives rows of one tagged table:
functions, classes, imports, module aliases, references, value flows and syntax errors.  References are resolved here
as far as one file tells: local names, imports, annotations of parameters, constructor results, ``self`` and
its attributes become absolute dotted names; what lies in other files is left to joins.

A name whose value one file does not tell is a variable, and what may come into it gives ``flow`` rows, which
``operators.flow`` closes over all calls.  Variables are written as

    V|scope.name   a local name, parameter, module or instance attribute     R|function   what a function returns
    E|variable     the elements of what a variable holds                      T|module|n   an expression with several values
    M|variable|a   attribute a of what it holds (``load`` rows)               C|variable   what calling it gives (``result`` rows)

and references to them have the variable in ``receiver`` and the member's name (none: the value itself is called) in ``name``.
"""

from __future__ import annotations

import ast
import bisect
import builtins
import gc
import keyword
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: methods that operators and built-in functions call
BINARY = {"Add": "add", "Sub": "sub", "Mult": "mul", "MatMult": "matmul", "Div": "truediv", "FloorDiv": "floordiv", "Mod": "mod", "Pow": "pow", "LShift": "lshift", "RShift": "rshift", "BitOr": "or", "BitXor": "xor", "BitAnd": "and"}
COMPARE = {"Lt": "lt", "LtE": "le", "Gt": "gt", "GtE": "ge", "Eq": "eq", "NotEq": "ne"}
UNARY = {"USub": "neg", "UAdd": "pos", "Invert": "invert", "Not": "bool"}
FUNCTIONS = {"str": "str", "repr": "repr", "len": "len", "iter": "iter", "next": "next", "bool": "bool", "hash": "hash", "int": "int", "float": "float", "bytes": "bytes", "abs": "abs", "reversed": "reversed", "format": "format", "complex": "complex", "round": "round", "list": "iter", "tuple": "iter", "set": "iter", "sorted": "iter", "sum": "iter", "min": "iter", "max": "iter"}
#: All special methods that references may name.
_RIGHT, _PLACE = [f"r{m}" for m in BINARY.values()], [f"i{m}" for m in BINARY.values()]
_OTHER = ["call", "contains", "getitem", "setitem", "delitem", "enter", "exit", "aenter", "aexit", "iter", "next", "aiter", "anext"]
SPECIAL = frozenset(f"__{m}__" for m in [*BINARY.values(), *_RIGHT, *_PLACE, *COMPARE.values(), *UNARY.values(), *FUNCTIONS.values(), *_OTHER])
CONTAINERS = ("list", "List", "set", "Set", "frozenset", "FrozenSet", "tuple", "Tuple", "deque", "Sequence", "MutableSequence", "Iterable", "Iterator", "Collection", "AsyncIterable", "AsyncIterator", "Generator", "AsyncGenerator", "dict", "Dict", "Mapping", "MutableMapping")
SAME_ELEMENTS = ("list", "tuple", "set", "frozenset", "sorted", "reversed", "iter")
ANYTHING = ("typing.Any", "typing.Callable", "collections.abc.Callable", "builtins.object", "builtins.callable")
LOOPS = ("asyncio.get_running_loop", "asyncio.get_event_loop", "asyncio.new_event_loop", "asyncio.AbstractEventLoop")

ARGUMENT = pa.struct([("position", pa.int32()), ("keyword", pa.string()), ("text", pa.string()), ("target", pa.string()), ("value", pa.string()), ("holds", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = pa.schema(
    [
        ("project", pa.string()), ("path", pa.string()), ("fact", pa.string()), ("module", pa.string()), ("is_stub", pa.bool_()), ("name", pa.string()), ("qualified_name", pa.string()),
        ("enclosing", pa.string()), ("expression", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("level", pa.int32()), ("is_async", pa.bool_()), ("decorators", pa.list_(pa.string())),
        ("bases", pa.list_(pa.string())), ("arguments", pa.list_(ARGUMENT)), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int32()), ("column", pa.int32()), ("bare_column", pa.int32()), ("receiver", pa.string()),
    ]
)
DDL = """project string, path string, fact string, module string, is_stub boolean, name string, qualified_name string, enclosing string, expression string, kind string, target string, level int,
is_async boolean, decorators array<string>, bases array<string>, arguments array<struct<position int, keyword string, text string, target string, value string, holds string, start bigint, end bigint>>,
start bigint, end bigint, line int, column int, bare_column int, receiver string"""
COLUMNS = re.split(r",\s*(?![^<]*>)", DDL)

DEEPEST = 100_000
_BUILTINS = frozenset(dir(builtins))
_LOAD = ast.Load()
#: What has no parts that tell anything, and what ``Reader.visit`` tells of.
_LEAVES = (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop, ast.Constant, ast.Name, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal)
_LEAF = frozenset(c for base in _LEAVES for c in (base, *base.__subclasses__()))
_DEFINED = frozenset([ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda])
#: Facts on the flow of values; the others are syntax facts.
FLOWS = frozenset(["flow", "load", "result", "parameter"])
SYNTAX = ("alias", "class", "function", "import", "reference")
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20  # of rows and of sources that give one batch


#: Fields of each kind of node that may hold nodes, and types of what tells nothing.
_PLAIN = frozenset(["ctx", "op", "ops", "id", "attr", "module", "level", "asname", "type_comment", "type_ignores", "conversion", "simple", "is_async", "kind"])
_BRANCHES = {c: tuple(f for f in c._fields if f not in _PLAIN) for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)}
_BARE = _LEAF | {type(None), str, bytes, int, bool, float, complex, type(...)}


#: Fields of statements that hold statements, or handlers and cases with such.
_BLOCKS = {c: tuple(f for f in c._fields if f in ("body", "orelse", "handlers", "finalbody", "cases")) for c in _BRANCHES}
#: Statements that bind names for ``Reader.collect``, and expressions whose value ``Reader.value`` may tell.
_BINDING = frozenset([ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.AugAssign, ast.Assign, ast.AnnAssign, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.If, ast.While, ast.Try, ast.TryStar, ast.Match])
_VALUED = frozenset([ast.Name, ast.Attribute, ast.Call, ast.Await, ast.NamedExpr, ast.Subscript, ast.BoolOp, ast.IfExp, ast.List, ast.Tuple, ast.Set, ast.Dict, ast.ListComp, ast.SetComp, ast.GeneratorExp])
_ADDED = (1).__add__


def _statements(node: ast.stmt) -> list[ast.AST]:
    """What stands in the blocks of a statement."""
    return [x for name in _BLOCKS[type(node)] for x in getattr(node, name)]


def _binds_plain_names(source: bytes) -> bool:
    """Whether all loops and comprehensions surely bind plain names, so that expressions bind nothing that is seen outside them."""
    return b"coding" not in source and not any(re.search(rb"[.\[(#\\]", m[1]) for m in re.finditer(rb"for(.*?)\bin\b", source, re.DOTALL))


def _parts(node: ast.AST) -> list[ast.AST]:
    """The nodes below a node that may tell something, kept with it since several passes ask for them."""
    parts = getattr(node, "_parts", None)
    if parts is not None:
        return parts
    parts = []
    for name in _BRANCHES[type(node)]:
        x = getattr(node, name, None)
        kind = type(x)
        if kind is list:
            for y in x:
                if type(y) not in _BARE:
                    parts.append(y)
        elif kind not in _BARE:
            parts.append(x)
    node._parts = parts
    return parts


class Value:
    """What a name stands for: a dotted name, and whether it is an object of that class or a result of that call; or a variable."""

    __slots__ = ("dotted", "made", "var")

    def __init__(self, dotted: str, made: bool = False, var: bool = False):
        self.dotted, self.made, self.var = dotted, made, var

    @property
    def named(self) -> bool:
        return not (self.made or self.var)

    @property
    def holds(self) -> str:
        return "var" if self.var else "made" if self.made else "named"


class Scope:
    def __init__(self, parent: Scope | None, qualified: str, kind: str):
        self.parent, self.qualified, self.kind = parent, qualified, kind
        self.names: dict[str, Value | None] = {}

    def find(self, name: str) -> tuple[Scope | None, Value | None]:
        scope: Scope | None = self
        while scope:
            # names of a class body are not seen from the functions inside it
            if name in scope.names and (scope is self or scope.kind != "class"):
                return scope, scope.names[name]
            scope = scope.parent
        return None, None


class Reader:
    def __init__(self, project: str, path: str, module: str, is_package: bool, is_stub: bool, source: bytes, facts: frozenset[str] | None = None, columns: frozenset[str] | None = None, kinds: frozenset[str] | None = None, methods: frozenset[str] | None = None):
        self.facts, self.kinds, self.methods = facts, kinds, methods
        self.flows = facts is None or bool(facts & FLOWS)
        self.arguing = self.flows or columns is None or "arguments" in columns
        self.wording = columns is None or "expression" in columns
        self.placing = columns is None or not columns.isdisjoint(("line", "column"))
        self.telling = _telling(self.flows or "reference" in facts, None if self.flows else kinds)
        # without questions about expressions only statements are gone through
        self.below: Callable[[ast.AST], list[ast.AST]] = _parts if self.telling.keys() & _EXPRESSIVE or not _binds_plain_names(source) else _statements
        self.walruses = b":=" in source or b"coding" in source  # another encoding may write it otherwise
        self.ascii = source.isascii()
        self.base = {"project": project, "path": path, "module": module, "is_stub": is_stub}
        self.module, self.is_package, self.is_stub = module, is_package, is_stub
        self.source = source
        self.lines = list(accumulate(map(_ADDED, map(len, source.split(b"\n")[:-1])), initial=0))
        self.rows: list[dict] = []
        self.star = False
        self.attributes: dict[str, dict[str, Value | None]] = {}
        self.bodies: list[tuple] = []
        self.comprehended: dict[ast.AST, Scope] = {}
        self.pending: list[tuple] = []  # what comes into variables, told when all names are known
        self.told: set[tuple] = set()

    # positions

    def offset(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.offset(node.lineno, node.col_offset), self.offset(node.end_lineno, node.end_col_offset)

    def text(self, start: int, end: int) -> str:
        return self.source[start:end].decode("utf-8", "replace").strip()

    def place(self, start: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, start)
        if self.ascii:
            return line, start - self.lines[line - 1] + 1
        return line, len(self.source[self.lines[line - 1] : start].decode("utf-8", "replace")) + 1

    def said(self, start: int, end: int) -> str | None:
        """The text of an expression, where it is asked for."""
        return self.text(start, end) if self.wording else None

    def emit(self, fact: str, start: int, end: int, **more) -> None:
        if self.facts is None or fact in self.facts:
            if self.kinds is not None and fact == "reference" and more["kind"] not in self.kinds:
                return
            line, column = self.place(start) if self.placing else (None, None)
            self.rows.append(self.base | {"fact": fact, "start": start, "end": end, "line": line, "column": column} | more)

    # run

    def read(self) -> list[dict]:
        """The facts of the file.  What cannot be read gives one ``syntax_error`` row; other files go on."""
        limit = sys.getrecursionlimit()
        # calls between Python functions take no room on the C stack, so long chains of operators may nest deeply
        sys.setrecursionlimit(max(limit, DEEPEST))
        try:
            tree = ast.parse(self.source)
            top = Scope(None, "", "module")
            self.collect(tree.body, top)
            self.block(tree.body, top, None)
            for body, scope, enclosing in self.bodies:  # grows as functions inside functions are met
                self.block(body, scope, enclosing)
            for to, node, scope, each in self.pending if self.flows else ():  # grows as expressions with several values are met
                (self.pour_elements if each else self.pour)(to, node, scope)
            return self.rows
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            return [self.base | {"fact": "syntax_error", "expression": str(error)}] if self.facts is None or "syntax_error" in self.facts else []
        finally:
            sys.setrecursionlimit(limit)

    # names

    def absolute(self, name: str | None, level: int) -> str:
        if not level:
            return name or ""
        parts = self.module.split(".") if self.module else []
        parts = parts[: len(parts) - (level - (1 if self.is_package else 0))]
        return ".".join([*parts, *([name] if name else [])])

    def own(self, qualified: str) -> str:
        return f"{self.module}.{qualified}" if self.module else qualified

    def collect(self, body: list[ast.stmt], scope: Scope) -> None:
        """Names that a scope's statements bind, before anything in it is resolved."""
        for node in body:
            if self.walruses:
                self.walrus(node, scope)
            if type(node) not in _BINDING:
                continue
            match node:
                case ast.Import():
                    for a in node.names:
                        scope.names[a.asname or a.name.split(".")[0]] = Value(a.name if a.asname else a.name.split(".")[0])
                case ast.ImportFrom():
                    base = self.absolute(node.module, node.level)
                    for a in node.names:
                        if a.name == "*":
                            self.star = True
                        else:
                            scope.names[a.asname or a.name] = Value(f"{base}.{a.name}" if base else a.name)
                case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                    q = f"{scope.qualified}.{node.name}" if scope.qualified else node.name
                    scope.names[node.name] = Value(self.own(q))
                    if isinstance(node, ast.ClassDef):
                        self.attributes.setdefault(self.own(q), {})
                case ast.AugAssign():
                    # what a name stands for stays in force; one that was not known becomes a local name
                    if not (isinstance(node.target, ast.Name) and node.target.id in scope.names):
                        self.bind(node.target, None, scope, None)
                case ast.Assign() | ast.AnnAssign():
                    value = node.value
                    named = self.annotation(node.annotation, scope) if isinstance(node, ast.AnnAssign) else None
                    if isinstance(node, ast.AnnAssign) and not named and isinstance(node.target, ast.Name):
                        self.holding(self.variable(scope, node.target.id), node.annotation, scope)
                    for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                        self.bind(t, named or (self.value(value, scope) if value is not None else None), scope, value)
                case ast.With() | ast.AsyncWith():
                    for item in node.items:
                        if item.optional_vars is not None:
                            self.bind(item.optional_vars, self.value(item.context_expr, scope), scope, item.context_expr)
                    self.collect(node.body, scope)
                case ast.For() | ast.AsyncFor():
                    self.each(node.target, node.iter, scope, scope)
                    self.collect(node.body + node.orelse, scope)
                case ast.If() | ast.While():
                    self.collect(node.body + node.orelse, scope)
                case ast.Try() | ast.TryStar():
                    self.collect(node.body, scope)
                    for h in node.handlers:
                        if h.name:
                            scope.names[h.name] = None
                        self.collect(h.body, scope)
                    self.collect(node.orelse + node.finalbody, scope)
                case ast.Match():
                    for c in node.cases:
                        self.collect(c.body, scope)
                case _:
                    pass

    def variable(self, scope: Scope, name: str) -> str:
        return f"V|{self.own(f'{scope.qualified}.{name}' if scope.qualified else name)}"

    def walrus(self, node: ast.stmt, scope: Scope) -> None:
        """Names bound inside the expressions of a statement."""
        if type(node) in _DEFINED:
            return
        todo: list[ast.AST] = [x for x in _parts(node) if isinstance(x, (ast.expr, ast.withitem))]
        while todo:
            x = todo.pop()
            if type(x) is ast.NamedExpr:
                self.bind(x.target, self.value(x.value, scope), scope, x.value)
            if type(x) is not ast.Lambda:
                todo.extend(_parts(x))

    def each(self, target: ast.expr, source: ast.expr, scope: Scope, outer: Scope) -> None:
        """Binds the names of a loop; one name takes the elements of what is looped over."""
        self.bind(target, None, scope, None)
        if isinstance(target, ast.Name):
            self.pending.append((self.variable(scope, target.id), source, outer, True))

    def bind(self, target: ast.expr, value: Value | None, scope: Scope, source: ast.expr | None) -> None:
        match target:
            case ast.Name():
                # "name = None" beside an import (a guarded one, mostly) does not hide it
                if not (isinstance(source, ast.Constant) and source.value is None and scope.names.get(target.id)):
                    value = None if value and value.var else value
                    if value is None:
                        before = scope.names.get(target.id)
                        if before and before.made:
                            self.flow(self.variable(scope, target.id), before)
                        if source is not None:
                            self.pending.append((self.variable(scope, target.id), source, scope, False))
                    elif scope.kind == "module" and value.made:
                        self.flow(self.variable(scope, target.id), value)  # other modules may import the object
                    scope.names[target.id] = value
            case ast.Tuple() | ast.List():
                for t in target.elts:
                    self.bind(t, None, scope, None)
            case ast.Starred():
                self.bind(target.value, None, scope, None)
            case ast.Attribute(value=ast.Name()):
                found, owner = scope.find(target.value.id)
                if found and owner and owner.made and owner.dotted in self.attributes:
                    known = self.attributes[owner.dotted]
                    if source is not None:
                        self.pending.append((f"V|{owner.dotted}.{target.attr}", source, scope, False))
                    value = None if value and value.var else value
                    known[target.attr] = value if target.attr not in known or known[target.attr] is None else known[target.attr]

    def annotation(self, node: ast.expr | None, scope: Scope) -> Value | None:
        match node:
            case None:
                return None
            case ast.Constant(value=str() as text):
                if text.isascii() and text.isidentifier() and not keyword.iskeyword(text):
                    return self.annotation(ast.Name(text, _LOAD), scope)
                try:
                    return self.annotation(ast.parse(text, mode="eval").body, scope)
                except SyntaxError:
                    return None
            case ast.BinOp(op=ast.BitOr()):
                sides = [self.annotation(x, scope) for x in (node.left, node.right) if not (isinstance(x, ast.Constant) and x.value is None)]
                return sides[0] if len(sides) == 1 else None
            case ast.Subscript(value=ast.Name(id="Optional") | ast.Attribute(attr="Optional")):
                return self.annotation(node.slice, scope)
            case ast.Name() | ast.Attribute():
                found = self.value(node, scope)
                return Value(found.dotted, True) if found and found.named and found.dotted not in ANYTHING else None
        return None

    def holding(self, to: str, node: ast.expr | None, scope: Scope) -> None:
        """The elements that the annotation of a container names."""
        if not self.flows:
            return
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                node = ast.parse(node.value, mode="eval").body
            except SyntaxError:
                return
        if isinstance(node, ast.Subscript) and (name := getattr(node.value, "id", getattr(node.value, "attr", None))) in CONTAINERS:
            inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            value = self.annotation(inner[1 if name in CONTAINERS[-4:] and len(inner) > 1 else 0], scope)
            if value:
                self.flow(f"E|{to}", value)

    def tell(self, fact: str, **more) -> None:
        """A row without a place, once."""
        if not self.flows:
            return
        key = (fact, *sorted(more.items()))
        if key not in self.told:
            self.told.add(key)
            if self.facts is None or fact in self.facts:
                self.rows.append(self.base | {"fact": fact} | more)

    def flow(self, to: str, value: Value) -> None:
        self.tell("flow", name=to, kind=value.holds, target=None if value.var else value.dotted, receiver=value.dotted if value.var else None)
        if value.var:
            self.tell("flow", name=f"E|{to}", kind="var", receiver=f"E|{value.dotted}")

    def pour(self, to: str, node: ast.expr | None, scope: Scope) -> None:
        """All that an expression may give flows into a variable."""
        match node:
            case None | ast.Constant():
                pass
            case ast.BoolOp():
                for x in node.values:
                    self.pour(to, x, scope)
            case ast.IfExp():
                self.pour(to, node.body, scope)
                self.pour(to, node.orelse, scope)
            case ast.NamedExpr() | ast.Await():
                self.pour(to, node.value, scope)
            case ast.List() | ast.Tuple() | ast.Set():
                for x in node.elts:
                    self.pour(f"E|{to}", x, scope)
            case ast.Dict():
                for x in node.values:
                    self.pour(f"E|{to}", x, scope)
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp():
                self.pour(f"E|{to}", node.elt, self.comprehension(node, scope))
            case _:
                if value := self.value(node, scope):
                    self.flow(to, value)

    def pour_elements(self, to: str, node: ast.expr | None, scope: Scope) -> None:
        match node:
            case ast.List() | ast.Tuple() | ast.Set():
                for x in node.elts:
                    self.pour(to, x, scope)
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp():
                self.pour(to, node.elt, self.comprehension(node, scope))
            case ast.Call(func=ast.Attribute(attr="values")) if (value := self.value(node.func.value, scope)) and value.var:
                self.flow(to, Value(f"E|{value.dotted}", var=True))
            case _:
                if (value := self.value(node, scope)) and value.var:
                    self.flow(to, Value(f"E|{value.dotted}", var=True))
                elif value and value.made:
                    self.flow(to, Value(f"E|R|{value.dotted}", var=True))

    def comprehension(self, node: ast.AST, scope: Scope) -> Scope:
        if node not in self.comprehended:
            inner = Scope(scope, f"{scope.qualified}.<{self.span(node)[0]}>".lstrip("."), "function")
            self.comprehended[node] = inner
            for i, g in enumerate(node.generators):
                self.each(g.target, g.iter, inner, inner if i else scope)
        return self.comprehended[node]

    def several(self, node: ast.expr, scope: Scope) -> Value:
        """A variable for an expression with several values."""
        to = f"T|{self.module}|{self.span(node)[0]}.{self.span(node)[1]}"
        if ("several", to) not in self.told:
            self.told.add(("several", to))
            self.pending.append((to, node, scope, False))
        return Value(to, var=True)

    def value(self, node: ast.expr | None, scope: Scope) -> Value | None:
        if type(node) not in _VALUED:
            return None
        match node:
            case ast.Name():
                found, value = scope.find(node.id)
                if found:
                    return value or Value(self.variable(found, node.id), var=True)
                if node.id in _BUILTINS:
                    return Value(f"builtins.{node.id}")
                return Value(self.own(node.id)) if self.star else None
            case ast.Attribute():
                base = self.value(node.value, scope)
                if not base:
                    return None
                if base.var:
                    to = f"M|{base.dotted}|{node.attr}"
                    self.tell("load", name=to, receiver=base.dotted, expression=node.attr)
                    return Value(to, var=True)
                if base.made and base.dotted in self.attributes and node.attr in self.attributes[base.dotted]:
                    return self.attributes[base.dotted][node.attr] or Value(f"V|{base.dotted}.{node.attr}", var=True)
                return Value(f"{base.dotted}.{node.attr}")
            case ast.Call():
                called = self.value(node.func, scope)
                if isinstance(node.func, ast.Name) and node.func.id == "super" and called and called.dotted == "builtins.super":
                    owner = self.owner(scope)
                    return Value(f"{owner}.super()", True) if owner else None
                if not called or called.made:
                    return None
                if called.var:
                    self.tell("result", name=f"C|{called.dotted}", receiver=called.dotted)
                    return Value(f"C|{called.dotted}", var=True)
                if called.dotted == "functools.partial" and node.args:
                    return self.value(node.args[0], scope)  # calling it calls the function
                if called.dotted.startswith("builtins.") and called.dotted[9:] in SAME_ELEMENTS and node.args:
                    inner = self.value(node.args[0], scope)
                    return inner if inner and inner.var else Value(called.dotted, True)
                return Value("asyncio.AbstractEventLoop", True) if called.dotted in LOOPS else Value(called.dotted, True)
            case ast.Await() | ast.NamedExpr():
                return self.value(node.value, scope)
            case ast.Subscript():
                base = self.value(node.value, scope)
                return Value(f"E|{base.dotted}", var=True) if base and base.var else None
            case ast.BoolOp() | ast.IfExp() | ast.List() | ast.Tuple() | ast.Set() | ast.Dict() | ast.ListComp() | ast.SetComp() | ast.GeneratorExp():
                return self.several(node, scope)
        return None

    def owner(self, scope: Scope | None) -> str | None:
        while scope:
            if scope.kind == "class":
                return self.own(scope.qualified)
            scope = scope.parent
        return None

    # statements and expressions

    def block(self, body: list[ast.stmt], scope: Scope, enclosing: str | None) -> None:
        for node in body:
            self.visit(node, scope, enclosing)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, scope: Scope, enclosing: str | None) -> None:
        q = f"{scope.qualified}.{node.name}" if scope.qualified else node.name
        at = self.source.find(node.name.encode(), self.offset(node.lineno, node.col_offset) + (9 if isinstance(node, ast.AsyncFunctionDef) else 3))
        decorators = []
        for d in node.decorator_list:
            start, end = self.span(d)
            decorators.append(self.text(start, end))
            called = d.func if isinstance(d, ast.Call) else d
            value = self.value(called, scope)
            self.emit("reference", start, end, enclosing=q, expression=decorators[-1], kind="decorator", target=value.dotted if value and value.named else None, arguments=self.arguments(d, scope) if isinstance(d, ast.Call) else None)
        self.emit("function", at, at + len(node.name.encode()), name=node.name, qualified_name=q, is_async=isinstance(node, ast.AsyncFunctionDef), decorators=decorators, enclosing=scope.qualified if scope.kind == "class" else None)
        if self.below is _parts:
            for default in [*node.args.defaults, *[x for x in node.args.kw_defaults if x]]:
                self.visit(default, scope, enclosing)
        if self.is_stub:
            return
        inner = Scope(scope, q, "function")
        parameters = [*node.args.posonlyargs, *node.args.args]
        bound = int(scope.kind == "class" and "staticmethod" not in decorators)
        for p in [*parameters, *node.args.kwonlyargs, *[x for x in (node.args.vararg, node.args.kwarg) if x]]:
            inner.names[p.arg] = self.annotation(p.annotation, scope)
            if self.flows and inner.names[p.arg] is None:
                to = self.variable(inner, p.arg)
                self.holding(to, p.annotation, scope)
                if p in parameters[bound:]:
                    self.tell("parameter", name=to, enclosing=q, expression=p.arg, level=parameters.index(p) - bound)
                elif p in node.args.kwonlyargs:
                    self.tell("parameter", name=to, enclosing=q, expression=p.arg)
                elif p is node.args.vararg:
                    self.tell("parameter", name=f"E|{to}", enclosing=q, level=-1 - len(parameters) + bound)
        if scope.kind == "class" and parameters and "staticmethod" not in decorators:
            inner.names[parameters[0].arg] = Value(self.own(scope.qualified), "classmethod" not in decorators)
        self.collect(node.body, inner)
        self.returns(node, inner, scope)
        self.bodies.append((node.body, inner, q))

    def returns(self, node: ast.FunctionDef | ast.AsyncFunctionDef, inner: Scope, scope: Scope) -> None:
        """What the annotation names, else what the function returns and yields."""
        if not self.flows:
            return
        to = f"R|{self.own(inner.qualified)}"
        if value := self.annotation(node.returns, scope):
            self.flow(to, value)
            return
        self.holding(to, node.returns, scope)
        todo: list[ast.AST] = list(node.body)
        while todo:
            x = todo.pop()
            kind = type(x)
            if kind is ast.Return:
                self.pending.append((to, x.value, inner, False))
            elif kind is ast.Yield:
                self.pending.append((f"E|{to}", x.value, inner, False))
            if kind not in _DEFINED:
                todo.extend(_parts(x))

    def visit(self, node: ast.AST, scope: Scope, enclosing: str | None) -> None:
        tell = self.telling.get(type(node))
        if tell is not None:
            scope = tell(self, node, scope, enclosing)
            if scope is None:
                return
        for child in self.below(node):
            self.visit(child, scope, enclosing)

    # of each kind of node: what it tells, and the scope of its parts unless they are done with

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, scope: Scope, enclosing: str | None) -> None:
        self.function(node, scope, enclosing)

    def _class(self, node: ast.ClassDef, scope: Scope, enclosing: str | None) -> None:
        q = f"{scope.qualified}.{node.name}" if scope.qualified else node.name
        bases = [v.dotted for b in node.bases if (v := self.value(b.value if isinstance(b, ast.Subscript) else b, scope)) and not v.var]
        start, end = self.span(node)
        self.emit("class", start, end, name=node.name, qualified_name=q, bases=bases, decorators=[self.text(*self.span(d)) for d in node.decorator_list])
        inner = Scope(scope, q, "class")
        self.collect(node.body, inner)
        self.attributes_of(node, inner)
        self.block(node.body, inner, enclosing)

    def _import(self, node: ast.Import, scope: Scope, enclosing: str | None) -> None:
        for a in node.names:
            start, end = self.span(a)
            self.emit("import", start, end, name=a.name, expression=a.asname, level=0, target=a.name, kind="module")
            if scope.kind == "module" and a.asname:
                self.emit("alias", start, end, name=self.own(a.asname), target=a.name)

    def _import_from(self, node: ast.ImportFrom, scope: Scope, enclosing: str | None) -> None:
        base = self.absolute(node.module, node.level)
        for a in node.names:
            start, end = self.span(a)
            self.emit("import", start, end, name=a.name, expression=a.asname, level=node.level, target=base, kind="name", qualified_name=node.module)
            if scope.kind == "module":
                self.emit("alias", start, end, name=self.own(a.asname or a.name), target=f"{base}.{a.name}" if base else a.name)

    def _call(self, node: ast.Call, scope: Scope, enclosing: str | None) -> Scope:
        self.call(node, scope, enclosing)
        node.func.called = True
        return scope

    def _called(self, node: ast.Call, scope: Scope, enclosing: str | None) -> Scope:
        node.func.called = True
        return scope

    def _attribute(self, node: ast.Attribute, scope: Scope, enclosing: str | None) -> Scope:
        if type(node.ctx) is ast.Load and not getattr(node, "called", False) and (value := self.value(node.value, scope)):
            whole, end = self.span(node)
            bare = self.place(whole)[1] if getattr(node, "bare", False) else None
            what = {"receiver": value.dotted, "name": node.attr} if value.var else {"target": f"{value.dotted}.{node.attr}"}
            self.emit("reference", end - len(node.attr.encode()), end, enclosing=enclosing, expression=self.said(whole, end), kind="attribute", bare_column=bare, **what)
        return scope

    def _expression(self, node: ast.Expr, scope: Scope, enclosing: str | None) -> Scope:
        if type(node.value) is ast.Attribute:
            node.value.bare = True
        return scope

    def _binary(self, node: ast.BinOp, scope: Scope, enclosing: str | None) -> Scope:
        name = BINARY[type(node.op).__name__]
        self.implicit(node, node.left, name, scope, enclosing)
        self.implicit(node, node.right, f"r{name}", scope, enclosing)
        return scope

    def _augmented(self, node: ast.AugAssign, scope: Scope, enclosing: str | None) -> Scope:
        self.implicit(node, node.target, f"i{BINARY[type(node.op).__name__]}", scope, enclosing)
        return scope

    def _compare(self, node: ast.Compare, scope: Scope, enclosing: str | None) -> Scope:
        left = node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            kind = type(op).__name__
            if kind in COMPARE:
                self.implicit(node, left, COMPARE[kind], scope, enclosing)
            elif kind in ("In", "NotIn"):
                self.implicit(node, right, "contains", scope, enclosing)
            left = right
        return scope

    def _shown(self, node: ast.JoinedStr, scope: Scope, enclosing: str | None) -> Scope:
        for part in node.values:
            if isinstance(part, ast.FormattedValue):
                self.implicit(node, part.value, {-1: "format", 115: "str", 114: "repr", 97: "repr"}[part.conversion], scope, enclosing)
        return scope

    def _subscript(self, node: ast.Subscript, scope: Scope, enclosing: str | None) -> Scope:
        self.implicit(node, node.value, {"Load": "getitem", "Store": "setitem", "Del": "delitem"}[type(node.ctx).__name__], scope, enclosing)
        return scope

    def _with(self, node: ast.With | ast.AsyncWith, scope: Scope, enclosing: str | None) -> Scope:
        a = "a" if isinstance(node, ast.AsyncWith) else ""
        for item in node.items:
            self.implicit(node, item.context_expr, f"{a}enter", scope, enclosing)
            self.implicit(node, item.context_expr, f"{a}exit", scope, enclosing)
        return scope

    def _for(self, node: ast.For | ast.AsyncFor, scope: Scope, enclosing: str | None) -> Scope:
        a = "a" if isinstance(node, ast.AsyncFor) else ""
        self.implicit(node, node.iter, f"{a}iter", scope, enclosing)
        self.implicit(node, node.iter, f"{a}next", scope, enclosing)
        return scope

    def _unary(self, node: ast.UnaryOp, scope: Scope, enclosing: str | None) -> Scope:
        self.implicit(node, node.operand, UNARY[type(node.op).__name__], scope, enclosing)
        return scope

    def _comprehension(self, node: ast.AST, scope: Scope, enclosing: str | None) -> Scope:
        return self.comprehension(node, scope)

    def attributes_of(self, node: ast.ClassDef, scope: Scope) -> None:
        """Types of ``self`` attributes, from assignments in the methods and annotations in the body."""
        known = self.attributes.setdefault(self.own(scope.qualified), {})
        for s in node.body:
            if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and (v := self.annotation(s.annotation, scope)):
                known[s.target.id] = v
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef) and s.args.args:
                me = s.args.args[0].arg
                local = Scope(scope, scope.qualified, "function")
                for p in s.args.args[1:]:
                    local.names[p.arg] = self.annotation(p.annotation, scope)
                walked: list[ast.AST] = [s]
                for x in walked:  # grows; level by level; no statement stands in an expression
                    kind = type(x)
                    if _BLOCKS[kind]:
                        walked += _statements(x)
                    if (kind is ast.Assign or kind is ast.AnnAssign) and x.value is not None:
                        for t in x.targets if kind is ast.Assign else [x.target]:
                            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == me and (v := self.value(x.value, local)) and v.made:
                                known.setdefault(t.attr, v)

    def implicit(self, node: ast.AST, receiver: ast.expr, method: str, scope: Scope, enclosing: str | None) -> None:
        if self.methods is not None and f"__{method}__" not in self.methods:
            return
        value = self.value(receiver, scope)
        if value and not value.named:
            start, end = self.span(node)
            what = {"receiver": value.dotted, "name": f"__{method}__"} if value.var else {"target": f"{value.dotted}.__{method}__"}
            self.emit("reference", start, end, enclosing=enclosing, expression=self.said(start, end), kind="implicit", **what)

    def arguments(self, node: ast.Call, scope: Scope) -> list[dict] | None:
        if not self.arguing:
            return None
        out = []
        for i, a in enumerate(node.args):
            if isinstance(a, ast.Starred):
                break
            out.append(self.argument(a, i, None, scope))
        return out + [self.argument(k.value, None, k.arg, scope) for k in node.keywords if k.arg]

    def argument(self, node: ast.expr, position: int | None, keyword: str | None, scope: Scope) -> dict:
        start, end = self.span(node)
        named = node
        # partial(f, ...) hands over f
        if isinstance(node, ast.Call) and (v := self.value(node.func, scope)) and v.dotted == "functools.partial" and node.args:
            named = node.args[0]
        value = self.value(named, scope) if isinstance(named, ast.Name | ast.Attribute) else None
        target = value.dotted if value and value.named else None
        value = value or self.value(node, scope)
        return {"position": position, "keyword": keyword, "text": self.text(start, end), "target": target, "value": value.dotted if value else None, "holds": value.holds if value else None, "start": start, "end": end}

    def call(self, node: ast.Call, scope: Scope, enclosing: str | None) -> None:
        start, end = self.span(node)
        text = self.said(start, end)
        value = self.value(node.func, scope)
        arguments = self.arguments(node, scope)
        if value and value.made:
            if self.methods is not None and "__call__" not in self.methods:
                return
            self.emit("reference", start, end, enclosing=enclosing, expression=text, kind="implicit", target=f"{value.dotted}.__call__", arguments=arguments)
            return
        if value and value.var:
            member = isinstance(node.func, ast.Attribute)
            receiver = self.value(node.func.value, scope).dotted if member else value.dotted
            self.emit("reference", start, end, enclosing=enclosing, expression=text, kind="call", receiver=receiver, name=node.func.attr if member else None, arguments=arguments)
            return
        made = isinstance(node.func, ast.Attribute) and (base := self.value(node.func.value, scope)) is not None and base.made
        self.emit("reference", start, end, enclosing=enclosing, expression=text, kind="call", target=value.dotted if value else None, arguments=arguments, level=int(made))
        if value and value.dotted.startswith("builtins.") and node.args and (method := FUNCTIONS.get(value.dotted[9:])):
            self.implicit(node, node.args[0], method, scope, enclosing)


_STATED = {ast.FunctionDef: Reader._function, ast.AsyncFunctionDef: Reader._function, ast.ClassDef: Reader._class, ast.Import: Reader._import, ast.ImportFrom: Reader._import_from}
#: Comprehensions bind names.
_BOUND = dict.fromkeys([ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp], Reader._comprehension)
_ACCESSED = {ast.Attribute: Reader._attribute, ast.Expr: Reader._expression, ast.Call: Reader._called}
_OPERATED = {
    ast.BinOp: Reader._binary, ast.AugAssign: Reader._augmented, ast.Compare: Reader._compare, ast.JoinedStr: Reader._shown, ast.Subscript: Reader._subscript, ast.With: Reader._with, ast.AsyncWith: Reader._with,
    ast.For: Reader._for, ast.AsyncFor: Reader._for, ast.UnaryOp: Reader._unary, ast.Call: Reader._call,
}
_EXPRESSIVE = {ast.Attribute, ast.Call}


@lru_cache
def _telling(references: bool, kinds: frozenset[str] | None) -> dict[type, Callable]:
    """What tells something, where references of some kinds or all are asked for or none."""
    told = _STATED | _BOUND
    for kind, more in (("attribute", _ACCESSED), ("call", {ast.Call: Reader._call}), ("implicit", _OPERATED)) if references else ():
        if kinds is None or kind in kinds:
            told = told | more
    return told


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def special_methods(files: DataFrame) -> frozenset[str] | None:
    """The special methods whose names stand in the sources; None if one may be written otherwise, as text that is not ASCII or in another encoding can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                if source and (not source.isascii() or b"coding" in source):
                    found.add(b"")
                elif source and b"__" in source:
                    found.update(re.findall(rb"__[a-z]+__", source))
        names = {n.decode() for n in found}
        yield pa.RecordBatch.from_pydict({"name": sorted(names & SPECIAL | names & {""})}, pa.schema([("name", pa.string())]))

    # no more names than there are special methods
    met = {r["name"] for r in files.select("content").mapInArrow(run, "name string").distinct().collect()}
    return None if "" in met else frozenset(met)


def read_facts(files: DataFrame, facts: Iterable[str] | None = None, columns: Iterable[str] | None = None, kinds: Iterable[str] | None = None, methods: Iterable[str] | None = None) -> DataFrame:
    """The fact table of ``files`` (see ``SCHEMA``); a file that does not parse gives one ``syntax_error`` row.

    Files are parsed where they lie, so ``files`` must be dealt over many tasks.  With ``facts`` only rows of these kinds
    are made, with ``columns`` only these columns of them, with ``kinds`` only references of these kinds, with ``methods``
    only those implicit references that call one of them; every file is parsed all the same.
    """
    wanted = None if facts is None else frozenset(facts)
    kept = None if columns is None else frozenset(columns)
    some = None if kinds is None else frozenset(kinds)
    called = None if methods is None else frozenset(methods)
    schema = SCHEMA if kept is None else pa.schema([f for f in SCHEMA if f.name in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        # trees go as soon as nothing refers to them; the collector would walk the one in work again and again
        gc.disable()
        try:
            for batch in batches:
                for f in batch.to_pylist():
                    source = f["content"] or b""
                    rows += Reader(f["project"], f["path"], f["module"], f["is_package"], f["is_stub"], source, wanted, kept, some, called).read()
                    size += len(source)
                    if len(rows) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                        gc.collect(0)
            if rows:
                yield _batch(rows, schema)
        finally:
            gc.enable()

    table = files.select("project", "path", "module", "is_package", "is_stub", "content")
    return table.mapInArrow(run, DDL if kept is None else ", ".join(c for c in COLUMNS if c.split()[0] in kept))
