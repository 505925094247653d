"""Scalar functions over text, positions, paths and hashes, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = r"\r\n|\r|\n"


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_slice(c: Column, start: Column, length: Column) -> Column:
    """The text of `length` UTF-16 units from `start`; an error where the range isn't inside the text."""
    raw = F.encode(c, "UTF-16BE")
    ok = (start >= 0) & (length > 0) & (start.cast("long") + length.cast("long") <= F.octet_length(raw) / 2)
    part = F.decode(F.substr(raw, start * 2 + 1, length * 2), "UTF-16BE")
    return F.when(ok, part).otherwise(F.raise_error(F.lit("range is outside of the text")))


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of an offset in UTF-16 units, which is clamped to the text."""
    return F.size(F.regexp_extract_all(_before(text, offset), F.lit(BREAK), F.lit(0))) + 1


def column_of(text: Column, offset: Column) -> Column:
    return utf16_length(F.regexp_extract(_before(text, offset), r"(?s)\A(?:.*(?:\r\n|\r|\n))?(.*)\z", 1)) + 1


def _before(text: Column, offset: Column) -> Column:
    at = F.least(F.greatest(offset, F.lit(0)), utf16_length(text))
    return F.decode(F.substr(F.encode(text, "UTF-16BE"), F.lit(1), at * 2), "UTF-16BE")


def line_starts(text: Column) -> Column:
    """Offset, in UTF-16 units, of each line's start."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\r|\n)"), F.lit(0))
    step = lambda a, p: F.array_append(a, F.element_at(a, -1) + utf16_length(p))
    return F.aggregate(pieces, F.array(F.lit(0)), step)


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """Offset of a line and column from 1; an error outside of the text."""
    starts = line_starts(text)
    start, after = F.get(starts, line - 1), F.coalesce(F.get(starts, line), utf16_length(text) + 1)
    ok = (line >= 1) & (column >= 1) & (line <= F.size(starts)) & (start + column - 1 < after)
    return F.when(ok, start + column - 1).otherwise(F.raise_error(F.lit("position is outside of the text")))


def parse_position(c: Column) -> Column:
    """struct<path, line, column> of `path:line:column`, read from the right; null fields if it has another form."""
    p = r"^(.+):(-?\d+):(-?\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"))


def normalize_path(c: Column) -> Column:
    """Slashes forward, empty and `.` parts dropped, `..` folded; null for a rooted path, one with `:` or one that leaves its root; `.` for nothing."""
    path = F.replace(c, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # A `..` that finds nothing to fold leaves the single part `..`, which nothing folds again.
    fold = lambda a, p: F.when(a == F.array(F.lit("..")), a).when(p != "..", F.array_append(a, p)).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array(F.lit("..")))
    done = F.aggregate(parts, F.array().cast("array<string>"), fold)
    bad = path.startswith("/") | path.contains(":") | (done == F.array(F.lit("..")))
    return F.when(bad, None).when(F.size(done) == 0, ".").otherwise(F.array_join(done, "/"))


def absolute_path(base: Column, relative: Column) -> Column:
    return F.when(relative == ".", base).otherwise(F.concat_ws("/", F.regexp_replace(base, "/+$", ""), relative))


def stored_path(base: Column, absolute: Column) -> Column:
    """The normalized path below base; null for one that is not below it."""
    root = F.concat(F.regexp_replace(F.replace(base, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
    path = F.replace(absolute, F.lit("\\"), F.lit("/"))
    inside = F.when(path.startswith(root), F.substr(path, F.length(root) + 1)).when(F.concat(path, F.lit("/")) == root, F.lit("."))
    return normalize_path(inside)


def text_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes."""
    return F.unhex(F.sha2(c, 256))


def input_fingerprint(files: DataFrame) -> bytes:
    """Hash over the files' upper-cased paths and content hashes, in the order of both. One line for each file reaches the driver, as an input list did before."""
    rows = files.select(F.upper("path").alias("path"), F.hex("content_hash").alias("hash")).orderBy("path", "hash")
    digest = hashlib.sha256()
    for r in rows.toLocalIterator():
        digest.update(f"{r['path']}\0{r['hash']}\n".encode())
    return digest.digest()


def project_fingerprint(header: list[str], project_file: bytes | None, references: list[tuple[str, list[str], bool]], documents: DataFrame, generated: list[tuple[str, int, bytes]] = ()) -> bytes:
    """Hash over what a project is made from: its header values, its file, references (identity, aliases, embedded) in order, its documents (path, text) by upper-cased path, and compiled-only generated ones (name, kind, hash).

    Documents are hashed on the executors; a path and 32 bytes of each reach the driver, one at a time."""
    digest = hashlib.sha256()
    add = lambda *values: digest.update("".join(f"{v}\0" for v in values).encode())
    add(*header)
    digest.update(hashlib.sha256(project_file).digest() if project_file is not None else b"\0")
    for identity, aliases, embedded in sorted((i, sorted(a), e) for i, a, e in references):
        add(identity, ",".join(aliases), embedded)
    rows = documents.select("path", F.upper("path").alias("upper"), F.sha2("text", 256).alias("hash")).orderBy("upper", "path")
    for r in rows.toLocalIterator():
        add(r["path"], r["hash"])
    for name, kind, content in sorted(generated, key=lambda g: (g[0], g[1], g[2].hex())):
        add("compilation-only-generated", name, kind, content.hex())
    return digest.digest()


def stable_key(profile: Column, assembly: Column, framework: Column, identity: Column, project: Column | None = None) -> Column:
    """A symbol's key: profile, assembly, perhaps a project, framework, and its documentation id or what stands for it."""
    scope = F.lit("") if project is None else F.coalesce(F.concat(F.lit("|project:"), project), F.lit(""))
    return F.concat(F.lit("profile:"), profile, F.lit("|assembly:"), F.coalesce(assembly, F.lit("source")), scope, F.lit("|tfm:"), F.coalesce(framework, F.lit("unknown")), F.lit("|"), identity)


def declaration_key(symbol: Column, path: Column, start: Column, length: Column, role: Column) -> Column:
    return F.concat(symbol, F.lit("|declaration:"), F.concat_ws(":", path, start.cast("string"), length.cast("string"), role.cast("string")))


def synthetic_key(owner: Column, path: Column, kind: Column, start: Column, length: Column, content_hash: Column) -> Column:
    """The key of what has no name, such as a lambda: its place in a version of a document."""
    return F.concat(owner, F.lit("|document:"), path, F.lit("|kind:"), kind, F.lit("|span:"), start.cast("string"), F.lit(":"), length.cast("string"), F.lit("|version:"), F.hex(content_hash))


def local_function_key(containing: Column, segment: Column, path: Column, start: Column, length: Column) -> Column:
    ok = (F.trim(containing) != "") & (F.trim(path) != "") & (start >= 0) & (length >= 0)
    key = F.concat(containing, F.lit("|local:"), segment, F.lit("|document:"), path, F.lit("|span:"), start.cast("string"), F.lit(":"), length.cast("string"))
    return F.when(ok, key).otherwise(F.raise_error(F.lit("a local function needs an owner, a document and a span")))


def request_hash(options: dict, versions: tuple[int, int, int]) -> bytes:
    return hashlib.sha256(json.dumps({"options": options, "versions": versions}, sort_keys=True).encode()).digest()


def generation_kind(path: Column, text: Column) -> Column:
    """Code of GenerationKind, from the file's name, its directories or its head; all without regard to case."""
    name = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^.*/", "")
    folders = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "[^/]*$", ""))
    head = F.lower(F.substring(text, 1, 2048))
    return (
        F.when(name.rlike(r"(?i)\.assemblyattributes\.cs$"), 4)
        .when(name.rlike(r"(?i)\.(?:g|generated|designer)\.cs$"), 1)
        .when(folders.rlike(r"(?i)/(?:generated|generatedcode)/"), 3)
        .when(head.contains("<auto-generated>") | head.contains("<autogenerated>"), 2)
        .otherwise(0)
    )


def framework_symbols(framework: str | None) -> list[str]:
    """Symbols that a target framework name defines."""
    name = (framework or "").strip().lower()
    found = {"WINDOWS"} if "-windows" in name else set()
    version = name.removeprefix("net").split("-")[0].split(".")
    if name.startswith("net") and not name.startswith(("netstandard", "netcoreapp")) and version[0].isdigit():
        major, minor = int(version[0]), version[1] if version[1:] and version[1].isdigit() else "0"
        found |= {"NET", f"NET{major}_{minor}", *(f"NET{v}_0_OR_GREATER" for v in range(5, major + 1))}
    return sorted(found)


def preprocessor_symbols(framework: str | None, defines: list[str], undefines: list[str]) -> list[str]:
    """Symbols of a directory input: WINDOWS, the framework's and the defined ones, without the undefined ones."""
    return sorted(({"WINDOWS", *framework_symbols(framework)} | set(defines)) - set(undefines))


def display_path(namespace: Column, type_path: Column, executable: Column, style: str = "csharp", short: bool = False) -> Column:
    """`Ns.Type::Member`, or explicit `Ns::Type::Member`; without a namespace `global::`; short names leave the namespace out."""
    empty = F.coalesce(namespace, F.lit("")) == ""
    if style == "csharp":
        owner = type_path if short else F.when(empty, type_path).otherwise(F.concat(namespace, F.lit("."), type_path))
    else:
        owner = F.concat(F.lit("**::"), type_path) if short else F.concat(F.when(empty, F.lit("global")).otherwise(namespace), F.lit("::"), type_path)
    member = short_types(executable) if short else executable
    return F.when(F.coalesce(executable, F.lit("")) == "", owner).otherwise(F.concat(owner, F.lit("::"), member))


def short_types(c: Column) -> Column:
    """Dotted names inside parameter and type-argument lists without their namespaces; the path before them stays."""
    return F.regexp_replace(c, r"(?<=[(<,\s])(?:global::)?(?:[\p{L}_][\p{L}\p{N}_]*(?:\.|::))+(?=[\p{L}_])", "")


ROLE_NAMES = ["DeclaredAsync", "ReturnsAwaitable", "ContainsAwait", "AsyncIterator", "ReturnsAsyncEnumerable", "AsyncVoid", "UniTaskVoid", "UsesAwaitForEach", "UsesAwaitUsing"]


def async_suffix(role: Column, depth: Column) -> Column:
    """` [async: roles; depth: n]`, or nothing where there is neither."""
    names = F.filter(F.array(*[F.when(role.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(ROLE_NAMES)]), lambda x: x.isNotNull())
    parts = F.concat_ws("; ", F.when(role != 0, F.concat(F.lit("async: "), F.array_join(names, ", "))), F.when(depth.isNotNull(), F.concat(F.lit("depth: "), depth.cast("string"))))
    return F.when(parts == "", "").otherwise(F.concat(F.lit(" ["), parts, F.lit("]")))


def one_line(c: Column) -> Column:
    """Tabs and line ends as one space each, CRLF as one."""
    return F.regexp_replace(c, "\\r\\n|[\\t\\r\\n\\u0085\\u2028\\u2029]", " ")


def signature(accessibility: Column, is_static: Column, is_async: Column, returns: Column, name: Column) -> Column:
    return F.concat_ws(" ", accessibility, F.when(is_static, "static"), F.when(is_async, "async"), returns, name)


#: Return types by metadata name that give an async role.
AWAITABLE = [
    "System.Threading.Tasks.Task", "System.Threading.Tasks.Task`1", "System.Threading.Tasks.ValueTask", "System.Threading.Tasks.ValueTask`1",
    "Cysharp.Threading.Tasks.UniTask", "Cysharp.Threading.Tasks.UniTask`1",
]
ASYNC_ENUMERABLE = ["System.Collections.Generic.IAsyncEnumerable`1", "Cysharp.Threading.Tasks.IUniTaskAsyncEnumerable`1"]
UNITASK_VOID = ["Cysharp.Threading.Tasks.UniTaskVoid"]


def async_role(is_async: Column, returns_void: Column, is_iterator: Column, return_type: Column) -> Column:
    """Async roles that a signature shows; return_type: the metadata name of the original definition."""
    bit = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0)
    parts = [bit(is_async, 1), bit(is_async & returns_void, 32), bit(is_async & is_iterator, 8), bit(return_type.isin(AWAITABLE), 2), bit(return_type.isin(ASYNC_ENUMERABLE), 16), bit(return_type.isin(UNITASK_VOID), 64)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def dispatch_kind(owner_type_kind: Column, is_virtual: Column, is_abstract: Column, is_override: Column) -> Column:
    """Interface, virtual or static dispatch of a call, from its method."""
    late = F.coalesce(is_virtual, F.lit(False)) | F.coalesce(is_abstract, F.lit(False)) | F.coalesce(is_override, F.lit(False))
    return F.when(owner_type_kind == 7, 3).when(late, 2).otherwise(1)


def has_role(role: Column, mask: int) -> Column:
    return role.bitwiseAND(int(mask)) != 0


def enum_name(code: Column, enum) -> Column:
    """The name of an enumeration's code; unknown codes as their number."""
    out = code.cast("string")
    for e in reversed(list(enum)):
        out = F.when(code == int(e), e.name.title().replace("_", "")).otherwise(out)
    return out
