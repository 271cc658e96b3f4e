"""Projects of several PySpark files: import discovery as a bounded closure, and lineage across files."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pyspark_ast import SPARK, Frame, Function, Interpreter, parse_pyspark

MAX_DEPTH = 10


def module_name(path: str, root: str = "") -> str:
    """Dotted module of a file below a search root; a package's __init__ is the package."""
    bare = path.removeprefix(root).strip("/").removesuffix(".py").replace("/", ".")
    return bare.removesuffix(".__init__") if bare.endswith(".__init__") else bare


def imported_modules(path: str, text: str, root: str = "") -> list[tuple[str, str | None, int]]:
    """(module, name, line) of a file's imports; relative ones are resolved within the root, others outside are dropped."""
    own = module_name(path, root).split(".")
    package = own if path.endswith("__init__.py") else own[:-1]
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            out += [(a.name, None, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.level:
                up = node.level - 1
                if up > len(package):
                    continue
                base = ".".join([*package[: len(package) - up], *([node.module] if node.module else [])])
            else:
                base = node.module or ""
            out += [(base, a.name, node.lineno) for a in node.names]
    return out


def resolve_import(module: str, name: str | None, modules: dict[str, str]) -> str | None:
    """Path of what an import means: a submodule before a name of the package itself."""
    if name and f"{module}.{name}" in modules:
        return modules[f"{module}.{name}"]
    return modules.get(module)


def import_edges(files: DataFrame, root: str = "") -> DataFrame:
    """(src, dst, rel, symbol, line) between files (path, content), and dst null for project imports that miss.

    Only modules travel to the workers that resolve: names of files, not their texts.
    """
    from .artifacts import entities, parse

    def rows(path: str, text: str):
        for module, name, line in imported_modules(path, text, root):
            yield "import", {"module": module, "name": name, "line": line}

    found = entities(parse(files.filter(F.col("path").endswith(".py")), rows), "import", "module string, name string, line int")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", f"^{root}", ""), r"^/+|\.py$", ""), "/", ".")
    modules = files.select(F.regexp_replace(bare, r"\.__init__$", "").alias("m"), F.col("path").alias("dst"), F.col("path").endswith("__init__.py").alias("init"))
    modules = modules.groupBy("m").agg(F.min_by("dst", "init").alias("dst"))  # mod.py comes before mod/__init__.py
    sub = modules.select(F.col("m").alias("sm"), F.col("dst").alias("sub"))
    own = modules.select(F.col("m").alias("om"), F.col("dst").alias("own"))
    joined = found.join(sub, F.concat_ws(".", "module", "name") == F.col("sm"), "left").join(own, F.col("module") == F.col("om"), "left")
    tops = modules.select(F.split("m", r"\.")[0].alias("top")).distinct()
    inside = joined.join(tops, F.split("module", r"\.")[0] == F.col("top"), "left_semi")
    return inside.select(F.col("path").alias("src"), F.coalesce("sub", "own").alias("dst"), F.lit("IMPORTS").alias("rel"), F.coalesce("name", F.lit("")).alias("symbol"), "line").distinct()


def parse_project(files: dict[str, str], entry: str, root: str = "", max_depth: int = MAX_DEPTH) -> dict[str, list[tuple[str, dict]]]:
    """Rows by file of an entry file and all that it imports; functions that it imports by name are inlined."""
    modules: dict[str, str] = {}
    for path in sorted(files, key=lambda p: p.endswith("__init__.py")):
        modules.setdefault(module_name(path, root), path)
    out: dict[str, list[tuple[str, dict]]] = {}
    notes: list[tuple[str, dict]] = []

    def visit(path: str, depth: int) -> None:
        if path in out:
            return
        if depth > max_depth:
            notes.append(("diagnostic", {"level": "warning", "code": "import_depth", "detail": path}))
            return
        out[path] = []
        external = {}
        for module, name, _ in imported_modules(path, files[path], root):
            target = resolve_import(module, name, modules)
            if target is None:
                if module.split(".")[0] in {m.split(".")[0] for m in modules}:
                    notes.append(("diagnostic", {"level": "warning", "code": "import_missing", "detail": module}))
                continue
            visit(target, depth + 1)
            for node in ast.parse(files[target]).body:
                if isinstance(node, ast.FunctionDef) and node.name == name:
                    external[name] = node
        out[path] = parse_with(path, files[path], external)

    visit(entry, 0)
    out[entry] += notes
    return out


def parse_with(path: str, text: str, external: dict[str, ast.FunctionDef]) -> list[tuple[str, dict]]:
    """parse_pyspark() with functions of other files bound beforehand."""
    if not external:
        return parse_pyspark(path, text)
    run = Interpreter(path)
    frames: list[Frame] = []
    make = run.frame
    run.frame = lambda *a: frames.append(f := make(*a)) or f
    env: dict = {"spark": SPARK}
    env |= {name: Function(node, env, name) for name, node in external.items()}
    tree = ast.parse(text)
    run.call_graph(tree)
    run.body(tree.body, env)
    return [("frame", {"id": f.id, "name": f.name, "creation_order": f.order, "partial": f.partial, "conditional": f.conditional, "line": f.line}) for f in frames] + run.rows
