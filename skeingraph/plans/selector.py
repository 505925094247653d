"""Symbol selectors: parsed on the driver, compiled to one column expression over encoded paths.

`Owner::Member` (owner: the end of namespace and type, dotted) or `Ns::Type::Member`
(matched as a whole; `global` is the empty namespace). Members are dotted segments: `Name`, `Name<T>`, `Name(types)`,
`[constructor]`, `[operator:+]`, `[get:Name]`, `[explicit:I.M]`, `<lambda#1>`, `<initializer:Name>`, `<top-level-statements>`
and others of these forms. No parameter list: all overloads; `()`: none. A segment `*` is any one segment, `**` none or several, as often as wanted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeingraph.plans import globs

#: The language's names of types, and its operators.
ALIASES = {
    "bool": "System.Boolean", "byte": "System.Byte", "sbyte": "System.SByte", "short": "System.Int16", "ushort": "System.UInt16",
    "int": "System.Int32", "uint": "System.UInt32", "long": "System.Int64", "ulong": "System.UInt64", "nint": "System.IntPtr",
    "nuint": "System.UIntPtr", "char": "System.Char", "float": "System.Single", "double": "System.Double", "decimal": "System.Decimal",
    "string": "System.String", "object": "System.Object", "void": "System.Void",
}
OPERATORS = "+ - ! ~ ++ -- true false * / % & | ^ << >> >>> == != < > <= >= += -= *= /= %= &= |= ^= <<= >>= >>>=".split()
VALUE_TYPES = {ALIASES[a] for a in ALIASES} - {"System.String", "System.Object", "System.Void"}
REF_KINDS = {"ref": 1, "out": 2, "in": 3, "ref readonly": 4}
PAIRS = {"(": ")", "<": ">", "[": "]"}


class SelectorError(ValueError):
    """The selector can't be parsed; nothing has been run."""


def split_top(text: str, separator: str) -> list[str]:
    """Parts between separators outside of brackets; within `[...]` angle brackets are plain characters."""
    out, closing, start, i = [], [], 0, 0
    while i < len(text):
        c = text[i]
        square = "]" in closing
        if closing and c == closing[-1]:
            closing.pop()
        elif c in PAIRS and not (c == "<" and square):
            closing.append(PAIRS[c])
        elif c in ")]" or (c == ">" and not square):
            raise SelectorError(f"unbalanced {c!r} in {text!r}")
        elif not closing and text.startswith(separator, i):
            out.append(text[start:i])
            i += len(separator)
            start = i
            continue
        i += 1
    if closing:
        raise SelectorError(f"{closing[-1]!r} is missing in {text!r}")
    return [*out, text[start:]]


@dataclass(frozen=True)
class Segment:
    kind: str
    name: str
    arity: int | None = None
    params: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Selector:
    explicit: bool
    namespace: tuple[tuple[str, int | None], ...]
    owner: tuple[tuple[str, int | None], ...]
    members: tuple[Segment, ...] = field(default=())


SPECIAL = re.compile(r"constructor|static-constructor|destructor|(?:checked-)?operator:(?P<op>.+)|conversion:(?:implicit|explicit):.+|checked-conversion:explicit:.+|(?:get|set|init|add|remove):.+|explicit:.+\..+")
SYNTHETIC = re.compile(r"<(?:lambda#(?:\d+|\*)|anonymous-method#(?:\d+|\*)|initializer:.+|top-level-statements)>")


def _name(text: str) -> tuple[str, int | None]:
    m = re.fullmatch(r"([^<>()\[\]]+)(?:<(.*)>)?", text)
    if not m or not m[1].strip():
        raise SelectorError(f"not a name: {text!r}")
    return m[1].strip().removeprefix("@"), None if m[2] is None else len(split_top(m[2], ","))


def _segment(text: str) -> Segment:
    synthetic = SYNTHETIC.match(text)
    close = _matching(text) if text.startswith("[") else synthetic.end() - 1 if synthetic else -1
    if text.startswith("[") and close > 0:
        m = SPECIAL.fullmatch(text[1:close])
        if not m or (m["op"] and m["op"] not in OPERATORS):
            raise SelectorError(f"unknown special member {text!r}")
        kind, name, rest = "special", _special(text[1:close]), text[close + 1 :]
    elif synthetic:
        kind, name, rest = "synthetic", synthetic[0], text[close + 1 :]
    else:
        at = text.find("(")
        kind, name, rest = "named", text if at < 0 else text[:at], "" if at < 0 else text[at:]
    arity = None
    if kind == "named":
        name, arity = _name(name)
    if not rest:
        return Segment(kind, name, arity)
    if not (rest.startswith("(") and rest.endswith(")")):
        raise SelectorError(f"unexpected {rest!r}")
    inner = rest[1:-1].strip()
    return Segment(kind, name, arity, tuple(p.strip() for p in split_top(inner, ",")) if inner else ())


def _special(name: str) -> str:
    """A conversion's target spelled out, as it is stored."""
    m = re.fullmatch(r"((?:checked-)?conversion:(?:implicit|explicit)):(.+)", name)
    return f"{m[1]}:{_forms(m[2])[0]}" if m and "*" not in m[2] else name


def _matching(text: str) -> int:
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if not depth:
            return i
    raise SelectorError(f"']' is missing in {text!r}")


def parse(text: str) -> Selector:
    parts = [p.strip() for p in split_top(text.strip(), "::")]
    if len(parts) not in (1, 2, 3) or not all(parts):
        raise SelectorError(f"not a selector: {text!r}")
    names = lambda t: tuple(_name(p) for p in split_top(t, "."))
    members = tuple(_segment(s) for s in split_top(parts[-1], ".")) if len(parts) > 1 else ()
    if len(parts) == 3:
        return Selector(True, () if parts[0] == "global" else names(parts[0]), names(parts[1]), members)
    return Selector(False, (), names(parts[0]), members)


def type_keys(text: str) -> list[tuple[str, int]]:
    """(type key, ref kind) forms that a parameter may have in store: aliases spelled out, blanks removed; `T?` of a type not known to be a value type is T or Nullable<T>."""
    kind, t = 0, text.strip()
    for word in ("ref readonly", "ref", "out", "in"):
        if t.startswith(word + " "):
            kind, t = REF_KINDS[word], t[len(word) + 1 :].strip()
            break
    return [(k, kind) for k in _forms(t)]


def _forms(t: str) -> list[str]:
    t = t.strip()
    if t.endswith("?"):
        return [x for f in _forms(t[:-1]) for x in ([f"System.Nullable<{f}>"] if f in VALUE_TYPES else [f"System.Nullable<{f}>", f])]
    if t.startswith("(") and t.endswith(")"):
        # A tuple, whose names don't count.
        items = [re.fullmatch(r"(.*[^\s])\s+@?[\w]+", p.strip()) or re.fullmatch(r"(.*)", p.strip()) for p in split_top(t[1:-1], ",")]
        return [f"System.ValueTuple<{','.join(_forms(m[1])[0] for m in items)}>"]
    if m := re.fullmatch(r"(.+?)((?:\[[,\s]*\]|\*)+)", t):
        return [f + re.sub(r"\s", "", m[2]) for f in _forms(m[1])]
    if m := re.fullmatch(r"([^<]+)<(.*)>", t):
        args = [_forms(a)[0] for a in split_top(m[2], ",")]
        return [f"{ALIASES.get(m[1].strip(), m[1].strip())}<{','.join(args)}>"]
    return [ALIASES.get(t, t)]


def _param(keys: Column, i: int, text: str) -> Column:
    return F.get(keys, F.lit(i)).isin([f"{kind}:{key}" for key, kind in type_keys(text)])


def compile(selector: Selector, ignore_case: bool = False) -> Column:
    """Over encoded rows: owner_ns, owner_type (globs.encode), members (an array of struct<kind, name, arity, params>), from `encoded`."""
    if selector.explicit:
        cond = F.col("owner_ns").rlike(globs.hierarchy(list(selector.namespace))) & F.col("owner_type").rlike(globs.hierarchy(list(selector.owner)))
    else:
        cond = F.concat("owner_ns", "owner_type").rlike(globs.hierarchy(list(selector.owner), any_owner=True))
    return cond & members_condition(selector.members, ignore_case=ignore_case) if selector.members else cond


def _any_run(m: Segment) -> bool:
    return m.kind == "named" and m.name == "**" and m.params is None and m.arity is None


def members_condition(segments: tuple[Segment, ...], literal: bool = False, ignore_case: bool = False) -> Column:
    """The whole of `members` matches the segments.

    A fold over the members carries one flag for each number of segments that may be used up so far, so `**` never backtracks."""
    runs = [not literal and _any_run(m) for m in segments]
    if not any(runs):
        cond = F.size("members") == len(segments)
        for i, m in enumerate(segments):
            cond &= _segment_condition(F.get("members", F.lit(i)), m, literal, ignore_case)
        return cond

    def through(flags):
        # A run may also stand for nothing.
        for i, run in enumerate(runs):
            if run:
                flags[i + 1] = flags[i + 1] | flags[i]
        return F.array(*flags)

    def step(a, x):
        flags = [F.lit(False)]
        for i, (m, run) in enumerate(zip(segments, runs, strict=True)):
            flags.append(F.get(a, F.lit(i + 1)) if run else F.get(a, F.lit(i)) & _segment_condition(x, m, literal, ignore_case))
        return through(flags)

    start = through([F.lit(i == 0) for i in range(len(segments) + 1)])
    return F.aggregate("members", start, step, lambda a: F.get(a, F.lit(len(segments))))


def _segment_condition(s: Column, m: Segment, literal: bool = False, ignore_case: bool = False) -> Column:
    if not literal and m.kind == "named" and m.name == "*" and m.params is None and m.arity is None:
        return s.isNotNull()
    glob = "*" in m.name and not literal
    name = s["name"].rlike(globs.component(m.name, ignore_case)) if glob else s["name"].rlike(rf"(?iu)\A{globs.quoted(m.name)}\z") if ignore_case else s["name"] == m.name
    cond = (s["kind"] == m.kind) & name
    if m.arity is not None:
        cond &= s["arity"] == m.arity
    if m.params is not None:
        cond &= F.size(s["params"]) == len(m.params)
        if m.arity is None:
            cond &= s["arity"] == 0
        for i, p in enumerate(m.params):
            cond &= _param(s["params"], i, p)
    return F.coalesce(cond, F.lit(False))


def members(text: str) -> tuple[Segment, ...]:
    """The segments of a member path alone, as in a method condition."""
    parts = split_top(text.strip(), ".")
    if not all(p.strip() for p in parts):
        raise SelectorError(f"not a member path: {text!r}")
    return tuple(_segment(p.strip()) for p in parts)


def hierarchy(text: str) -> list[tuple[str, int | None]]:
    """Names and arities of a dotted type path, as in a type condition."""
    return [_name(p.strip()) for p in split_top(text.strip(), ".")]


def matching(symbols: DataFrame, selector: Selector, ignore_case: bool = False) -> DataFrame:
    """The symbols that a selector matches. The leaf's name reaches the files; what is left is encoded, unless the columns are stored."""
    rows = symbols.where(candidate_hints(selector)) if not ignore_case else symbols
    rows = rows if "members" in rows.columns else encoded(rows)
    return rows.where(compile(selector, ignore_case)).select(*symbols.columns)


def encoded(symbols: DataFrame) -> DataFrame:
    """symbols with owner_ns, owner_type and members, from namespace_name, type_identity_path and executable_identity_path; done once, when facts are loaded."""
    schema = "owner_ns string, owner_type string, members array<struct<kind:string,name:string,arity:int,params:array<string>>>"

    def one(ns, type_path, executable):
        owner = [(n, a or 0) for n, a in map(_name, split_top(type_path, "."))] if type_path else []
        found = []
        for s in map(_segment, split_top(executable, ".") if executable else []):
            found.append((s.kind, s.name, s.arity or 0, ["{1}:{0}".format(*type_keys(p)[0]) for p in s.params or ()]))
        return globs.encode([(n, 0) for n in ns.split(".")] if ns else []), globs.encode(owner), found

    def run(batches):
        for pdf in batches:
            rows = [one(*r) for r in zip(pdf["namespace_name"], pdf["type_identity_path"], pdf["executable_identity_path"], strict=True)]
            pdf["owner_ns"], pdf["owner_type"] = [r[0] for r in rows], [r[1] for r in rows]
            pdf["members"] = [[dict(zip(("kind", "name", "arity", "params"), m, strict=True)) for m in r[2]] for r in rows]
            yield pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in symbols.schema)
    return symbols.mapInPandas(run, f"{fields}, {schema}")


def candidate_hints(selector: Selector) -> Column:
    """What can be pushed to the files before paths are matched: the exact leaf name, if it has no star."""
    leaf = selector.members[-1] if selector.members else None
    return F.col("name") == leaf.name if leaf and leaf.kind == "named" and "*" not in leaf.name else F.lit(True)
