"""String functions of the analysis, all as Column expressions (inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEADING = r"^(?U)\s+"
_TRIMMED = r"(?U)^\s+|\s+$"


def qualify(scope: Column, name: Column) -> Column:
    """``scope.name``, or ``name`` where there is no scope."""
    return F.concat_ws(".", scope, name)


def callee(expression: Column) -> Column:
    """The trimmed text before the first ``(``; null if there is none."""
    return F.when(F.instr(expression, "(") > 0, F.trim(F.substring_index(expression, "(", 1)))


def decorator_text(expression: Column) -> Column:
    """A decorator without its leading ``@`` signs and outer white space."""
    return F.trim(F.regexp_replace(expression, r"^\s*@*\s*", ""))


def is_decorated(decorators: Column, name: str) -> Column:
    """Whether one of the decorators is ``name`` or ends in ``.name``."""
    return F.exists(decorators, lambda d: (d == name) | d.endswith("." + name))


def display_name(identity: Column) -> Column:
    """The part after the last ``:``, without a leading ``main.``."""
    return F.regexp_replace(F.substring_index(identity, ":", -1), r"^main\.", "")


def module_of(path: Column) -> Column:
    """The dotted module of a relative path: no extension, no ``__init__``, no ``stubs`` folder."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.pyi?$", ""), "/"), lambda x: (x != "stubs") & (x != ""))
    return F.regexp_replace(F.concat_ws(".", parts), r"\.__init__$", "")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def party_name(path: Column, qualified: Column, is_async: Column) -> Column:
    """How a first-party function is shown: async functions bare, others behind their module unless that is ``main``."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), "/", "."), r"\.__init__$", "")
    bare = is_async | (F.substring_index(module, ".", -1) == "main") | qualified.startswith(F.concat(module, F.lit(".")))
    return F.when(bare, display_name(qualified)).otherwise(F.concat_ws(".", module, display_name(qualified)))


def line_of(content: Column, offset: Column) -> Column:
    """The 1-based line of a byte offset in UTF-8 bytes; null outside the text or inside a character."""
    prefix = _prefix(content, offset)
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(content: Column, offset: Column) -> Column:
    """The 1-based column in characters of a byte offset in UTF-8 bytes."""
    return (F.length(F.substring_index(_prefix(content, offset), "\n", -1)) + 1).cast("int")


def _prefix(content: Column, offset: Column) -> Column:
    size = F.octet_length(content)
    # a byte 10xxxxxx at the offset lies inside a character
    following = F.conv(F.hex(F.substr(content, (offset + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    whole = (offset >= 0) & (offset <= size) & ((offset == size) | ~following.between(128, 191))
    return F.when(whole, F.decode(F.substr(content, F.lit(1), offset.cast("int")), "UTF-8"))


def snippet(content: Column, start: Column, end: Column) -> Column:
    """The trimmed text of a byte range."""
    return F.trim(F.decode(F.substr(content, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8"))


def relative_path(path: Column, root: Column) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(clean.startswith(base), F.substr(clean, F.length(base) + 1)).otherwise(clean)


def storage_key(key: Column) -> Column:
    """A file name for a key; a hash follows, since replaced signs alone could collide."""
    return F.concat_ws("-", F.translate(key, "/\\:", "___"), F.substring(F.sha2(key, 256), 1, 12))


def excluded(relative: Column, patterns: Column) -> Column:
    """Whether a path fits one of an array of patterns ``folder/**``, ``**/ending`` or a whole path."""

    def fits(p: Column) -> Column:
        folder = F.left(p, F.length(p) - 3)
        inside = (relative == folder) | F.startswith(relative, F.concat(folder, F.lit("/")))
        return F.when(p.endswith("/**"), inside).when(p.startswith("**/"), F.endswith(relative, F.substr(p, F.lit(4)))).otherwise(relative == p)

    return F.exists(patterns, fits)


def dotted_prefixes(name: Column) -> Column:
    """All prefixes of a dotted name that end at a dot or at its end, shortest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, F.lit(1), i)))


def callable_kind(name: Column, qualified: Column, is_async: Column, decorators: Column) -> Column:
    """The kind of a function; the first that fits in this order."""
    method = F.instr(qualified, ".") > 0
    return (
        F.when(name == "<lambda>", "Lambda")
        .when(name.startswith("__") & name.endswith("__") & (F.length(name) > 4), "DunderMethod")
        .when(is_decorated(decorators, "property") | is_decorated(decorators, "cached_property"), "Property")
        .when(is_decorated(decorators, "classmethod"), "ClassMethod")
        .when(is_decorated(decorators, "staticmethod"), "StaticMethod")
        .when(method & is_async, "AsyncMethod")
        .when(method, "Method")
        .when(is_async, "AsyncFunction")
        .otherwise("Function")
    )


#: The order of edge kinds, by which chains are compared.
EDGE_KINDS = ("DirectCall", "MethodCall", "PropertyAccess", "ImplicitDunder", "SuperCall", "DecoratorCall")


def edge_kind(target_kind: Column, is_decorator: Column, expression: Column) -> Column:
    """The kind of an edge; null where an expression is no use of its target."""
    called = callee(expression)
    return (
        F.when(target_kind == "Property", "PropertyAccess")
        .when(is_decorator, "DecoratorCall")
        .when(target_kind == "DunderMethod", "ImplicitDunder")
        .when(called.isNull(), F.lit(None).cast("string"))
        .when(F.trim(expression).startswith("super()."), "SuperCall")
        .when(F.instr(called, ".") > 0, "MethodCall")
        .otherwise("DirectCall")
    )


def error_number(chain: Column) -> Column:
    """1 direct, 2 transitive, 3 property, 4 implicit call: the first special edge of a chain decides."""
    special = F.get(F.filter(chain, lambda x: x["edge_kind"].isin("PropertyAccess", "ImplicitDunder")), F.lit(0))
    return F.when(special["edge_kind"] == "PropertyAccess", 3).when(special["edge_kind"] == "ImplicitDunder", 4).when(F.size(chain) == 1, 1).otherwise(2)


def split_arguments(args: Column) -> Column:
    """The parts of an argument list as structs of text, start and end (bytes, trimmed; nothing follows a comma at the very end).

    Commas outside all brackets part; brackets of the three kinds count alike, a closing one too many counts for nothing, and
    quotes have no meaning: a comma inside a string parts as well.  One pass over the characters with the depth and the beginning of the part.
    """
    characters = F.split(args, "")
    size = F.length(args)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        parts = (c == ",") & (s["depth"] == 0)
        depth = F.when(c.isin("(", "[", "{"), s["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cuts = F.when(parts, F.array_append(s["cuts"], F.struct(s["begin"].alias("begin"), s["at"].alias("end")))).otherwise(s["cuts"])
        return F.struct(depth.alias("depth"), F.when(parts, s["at"] + 1).otherwise(s["begin"]).alias("begin"), (s["at"] + 1).alias("at"), cuts.alias("cuts"))

    def finish(s: Column) -> Column:
        rest = F.array_append(s["cuts"], F.struct(s["begin"].alias("begin"), s["at"].alias("end")))
        return F.when(s["begin"] < s["at"], rest).otherwise(s["cuts"])

    def placed(x: Column) -> Column:
        raw = F.substr(args, x["begin"] + 1, x["end"] - x["begin"])
        text = F.regexp_replace(raw, _TRIMMED, "")
        before = F.octet_length(F.substr(args, F.lit(1), x["begin"])) + F.octet_length(raw) - F.octet_length(F.regexp_replace(raw, _LEADING, ""))
        return F.struct(text.alias("text"), before.alias("start"), (before + F.octet_length(text)).alias("end"))

    return F.transform(F.aggregate(F.when(size > 0, characters).otherwise(F.array().cast("array<string>")), state, step, finish), placed)


def argument_ranges(expression: Column, start: Column) -> Column:
    """The arguments of a call expression as structs of text, start and end in the file, where the expression begins at ``start``; empty ones go.

    The list lies between the first opening bracket and the end, without a closing bracket there."""
    opening = F.instr(expression, "(")
    inner = F.regexp_replace(F.substr(expression, opening + 1), "[)]$", "")
    base = start + F.octet_length(F.substr(expression, F.lit(1), opening))
    moved = F.transform(F.filter(split_arguments(inner), lambda x: x["text"] != ""), lambda x: F.struct(x["text"].alias("text"), (base + x["start"]).cast("long").alias("start"), (base + x["end"]).cast("long").alias("end")))
    return F.when(opening > 0, moved).otherwise(F.filter(moved, lambda x: F.lit(False)))
