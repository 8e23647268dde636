"""Column expressions over names, paths, signatures and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII letters for case folding; SQL LIKE folds these only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Directories that hold tests, and file names that are tests.
TEST_DIRS = ("test", "tests", "testing", "it")
TEST_FILE = r"^(test_.*\.py|.*_test\.py|conftest\.py|.*(Test|Tests|IT)\.java)$"
#: Fixed value: a word inside an identifier.
WORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
TYPE_KINDS = ("class", "interface", "enum", "record", "annotation")
CALLABLE_KINDS = ("method", "constructor", "function")


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(directories(path), F.array(*map(F.lit, TEST_DIRS))) | basename(path).rlike(TEST_FILE)


def dotted_suffix(qualified: Column, query: str) -> Column:
    """qualified is query or ends in '.' + query; ASCII case doesn't count in the latter."""
    return (qualified == query) | ascii_fold(qualified).endswith("." + query.translate(str.maketrans(UPPER, LOWER)))


def path_suffix(path: Column, query: str) -> Column:
    return F.concat(F.lit("/"), ascii_fold(path)).endswith("/" + query.translate(str.maketrans(UPPER, LOWER)))


def in_scope(path: Column, module: Column, scope: str) -> Column:
    """A scope with a slash or a source suffix is a directory or file; any other is a dotted fragment."""
    fold = scope.translate(str.maketrans(UPPER, LOWER))
    if "/" in scope or fold.endswith((".java", ".py")):
        e = fold.strip("/")
        whole = F.concat(F.lit("/"), ascii_fold(path))
        ends = [e] if e.endswith((".java", ".py")) else [e + ".java", e + ".py"]
        hit = whole.contains(f"/{e}/")
        for x in ends:
            hit = hit | whole.endswith("/" + x)
        return hit
    e = fold.removesuffix(".*").strip(".")
    return F.concat(F.lit("."), ascii_fold(module), F.lit(".")).contains(f".{e}.")


def arity_fits(args: Column, params: Column, varargs: Column) -> Column:
    """Whether a call of args arguments fits; unknown numbers fit everything."""
    return F.coalesce(F.when(varargs, args >= params - 1).otherwise(args == params), F.lit(True))


def is_static(signature: Column) -> Column:
    return F.array_contains(F.split(F.substring_index(signature, "(", 1), r"\s+"), "static")


def external_type(receiver: Column) -> Column:
    """Written like a type (`java.util.List`), and its last part isn't a constant's name."""
    last = F.substring_index(receiver, ".", -1)
    return receiver.rlike(r"^(?:[a-z_]\w*\.)*[A-Z]\w*$") & (F.upper(last) != last)


def split_words(name: Column) -> Column:
    """The words of an identifier, lower-cased: `parseHTTPName2` is `parse http name 2`."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(WORD), F.lit(0)), F.lower), " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def simple_name(base: Column) -> Column:
    """`List<a.B>` is `List`, `a.b.C` is `C`."""
    return F.substring_index(F.substring_index(base, "<", 1), ".", -1)


def short_name(qualified: Column, module: Column) -> Column:
    prefix = F.concat(module, F.lit("."))
    return F.when((module != "") & F.startswith(qualified, prefix), F.substring(qualified, F.length(prefix) + 1, F.length(qualified))).otherwise(qualified)


def kind_rank(kind: Column) -> Column:
    return F.when(kind.isin(*TYPE_KINDS), 0).when(kind.isin(*CALLABLE_KINDS), 1).otherwise(2)


def package_of(language: Column, path: Column, module: Column) -> Column:
    inner = (language == "python") & ~basename(path).eqNullSafe("__init__.py")
    return F.when(inner, F.regexp_replace(module, r"\.?[^.]*$", "")).otherwise(module)


def source_root(directory: Column, package: Column) -> Column:
    """`java/src/` for directory `java/src/com/x/` and package `com.x`; null if the folders don't end in the package."""
    tail = F.concat(F.lit("/"), F.replace(package, F.lit("."), F.lit("/")), F.lit("/"))
    whole = F.concat(F.lit("/"), directory)
    root = F.substring(whole, F.lit(2), F.length(whole) - F.length(tail))
    return F.when((package != "") & F.endswith(whole, tail), F.when(root == "", "./").otherwise(root))


def external_name(module: Column, language: Column) -> Column:
    return F.when(language == "java", F.substring_index(module, ".", 2)).otherwise(F.substring_index(module, ".", 1))


def clip(text: Column, width: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def line_count(content: Column) -> Column:
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return breaks + F.when((F.length(content) > 0) & ~F.endswith(content, F.lit("\n")), 1).otherwise(0)


def git_blob_id(data: Column) -> Column:
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "utf-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, data))
