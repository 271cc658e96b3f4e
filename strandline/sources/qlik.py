"""Load scripts: preprocessing, statements, and the lineage they imply.

Rows of (kind, payload): variable, connection, dataset, attribute, edge, store, constraint, diagnostic. Datasets are
named by their labels; attributes belong to datasets. Edges carry (src, dst, rel, transform, confidence).
"""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_PASSES, MAX_UNROLL = 10, 5, 1000
#: Functions of the script language that are not field names.
FUNCTIONS = {"upper", "lower", "trim", "ltrim", "rtrim", "left", "right", "mid", "len", "if", "sum", "count", "avg", "min", "max", "date", "date#", "num", "num#", "text", "year", "month", "day", "week", "today", "now", "addmonths", "monthstart", "monthend", "yearstart", "floor", "ceil", "round", "applymap", "mapsubstring", "pick", "match", "wildmatch", "mixmatch", "dual", "subfield", "replace", "purgechar", "keepchar", "index", "isnull", "null", "autonumber", "autonumberhash128", "rowno", "recno", "peek", "previous", "exists", "lookup", "interval", "time", "timestamp", "timestamp#", "makedate", "hash128", "hash256", "concat", "only", "rangesum", "alt", "fabs", "mod", "distinct", "total", "and", "or", "not", "as", "like", "is", "between", "then", "else", "end", "case", "when", "in"}


def static_truth(condition: Column) -> Column:
    """Truth of a condition over literals: texts or integers compared, a number, or a word; null if not static."""
    c = F.trim(condition)
    text = r"^'([^']*)'\s*(=|<>)\s*'([^']*)'$"
    number = r"^(-?\d+)\s*(=|<>|<=|>=|<|>)\s*(-?\d+)$"
    a, op, b = F.regexp_extract(c, number, 1).try_cast("long"), F.regexp_extract(c, number, 2), F.regexp_extract(c, number, 3).try_cast("long")
    compared = F.when(op == "=", a == b).when(op == "<>", a != b).when(op == "<", a < b).when(op == ">", a > b).when(op == "<=", a <= b).when(op == ">=", a >= b)
    same = F.regexp_extract(c, text, 1) == F.regexp_extract(c, text, 3)
    return (
        F.when(c.rlike(text), F.when(F.regexp_extract(c, text, 2) == "=", same).otherwise(~same))
        .when(c.rlike(number), compared)
        .when(c.rlike(r"^-?\d+$"), c.try_cast("long") != 0)
        .when(F.lower(c).isin("true", "true()"), F.lit(True))
        .when(F.lower(c).isin("false", "false()"), F.lit(False))
    )


def truth(condition: str) -> bool | None:
    """The same in plain Python, for the preprocessor."""
    c = condition.strip()
    if m := re.fullmatch(r"'([^']*)'\s*(=|<>)\s*'([^']*)'", c):
        return (m[1] == m[3]) == (m[2] == "=")
    if m := re.fullmatch(r"(-?\d+)\s*(=|<>|<=|>=|<|>)\s*(-?\d+)", c):
        a, b = int(m[1]), int(m[3])
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[m[2]]
    if re.fullmatch(r"-?\d+", c):
        return int(c) != 0
    return {"true": True, "true()": True, "false": False, "false()": False}.get(c.lower())


def strip_comments(text: str) -> str:
    token = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|\[[^\]]*\]|//[^\n]*|/\*.*?\*/|(?im:^\s*REM\b[^;]*;)", re.S)
    return token.sub(lambda m: " " if m.group().lstrip()[:2] in ("//", "/*") or m.group().lstrip()[:3].upper() == "REM" else m.group(), text)


def include(text: str, files: dict[str, str], depth: int = 0, seen: tuple[str, ...] = ()) -> tuple[str, list[tuple[str, dict]]]:
    """Text with includes filled in from files, by path or base name; missing, cyclic and too deep ones are told."""
    notes: list[tuple[str, dict]] = []

    def fill(m: re.Match) -> str:
        name = m[2].strip()
        key = name if name in files else next((k for k in files if k.replace("\\", "/").rsplit("/", 1)[-1] == name.replace("\\", "/").rsplit("/", 1)[-1]), None)
        code = "include_missing" if key is None else "include_cycle" if key in seen else "include_depth" if depth >= MAX_DEPTH else None
        if code:
            notes.append(("diagnostic", {"level": "error" if m[1] and code == "include_missing" else "warning", "code": code, "detail": name}))
            return ""
        inner, more = include(strip_comments(files[key]), files, depth + 1, (*seen, key))
        notes.extend(more)
        return inner

    return re.sub(r"\$\(\s*(Must_)?Include\s*=\s*([^)]+)\)\s*;?", fill, text, flags=re.I), notes


def expand(text: str, variables: dict[str, str]) -> str:
    """$(name) filled in, again while that brings new ones, up to MAX_PASSES times."""
    lower = {k.lower(): v for k, v in variables.items()}
    for _ in range(MAX_PASSES):
        new = re.sub(r"\$\(([A-Za-z_][\w.]*)\)", lambda m: lower.get(m[1].lower(), m.group()), text)
        if new == text:
            break
        text = new
    return text


def statements(text: str) -> list[str]:
    """Statements, cut at semicolons outside quotes and brackets; control lines end at the line."""
    token = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|\[[^\]]*\]|\((?:[^()']|'[^']*')*\)|;|(?im:^\s*(?:IF\b[^\n]*?\bTHEN|ELSEIF\b[^\n]*?\bTHEN|ELSE|END\s*IF|FOR\b[^\n]*|NEXT\b[^\n]*|SUB\b[^\n]*|END\s*SUB|CALL\b[^\n;]*))\s*$|.", re.S | re.M)
    out, now = [], []
    for m in token.finditer(text):
        piece = m.group()
        control = re.match(r"(?i)\s*(IF\b.*\bTHEN|ELSEIF\b.*\bTHEN|ELSE|END\s*IF|FOR\b|NEXT\b|SUB\b|END\s*SUB|CALL\b)", piece) if "\n" in piece or len(piece) > 1 else None
        if control and not "".join(now).strip():
            out.append(piece.strip())
            now = []
        elif piece == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(piece)
    out.append("".join(now).strip())
    return [s for s in out if s]


def run_control(items: list[str], variables: dict[str, str], subs: dict[str, tuple[list[str], list[str]]] | None = None, depth: int = 0) -> Iterator[str]:
    """Statements in the order they run: branches pruned where static (else all kept), loops unrolled, calls inlined."""
    subs = {} if subs is None else subs
    k = 0
    while k < len(items):
        s = items[k]
        head = s.split(None, 1)[0].upper() if s.split() else ""
        if head == "SUB":
            end = _matching(items, k, "SUB", r"END\s*SUB")
            m = re.match(r"(?i)SUB\s+(\w+)\s*(?:\(([^)]*)\))?", s)
            subs[m[1].lower()] = ([a.strip() for a in (m[2] or "").split(",") if a.strip()], items[k + 1 : end])
            k = end + 1
            continue
        if head == "CALL":
            m = re.match(r"(?i)CALL\s+(\w+)\s*(?:\((.*)\))?", s, re.S)
            if m and m[1].lower() in subs and depth < MAX_DEPTH:
                names, body = subs[m[1].lower()]
                values = [v.strip().strip("'") for v in split_top(m[2] or "")]
                bound = dict(zip(names, values))
                yield from run_control([expand(b, bound) for b in body], variables, subs, depth + 1)
            k += 1
            continue
        if head == "IF" and re.search(r"(?i)\bTHEN$", s):
            end = _matching(items, k, "IF", r"END\s*IF")
            arms, start, at, level = [], k, k, 0
            conditions = [re.sub(r"(?i)^IF\b|\bTHEN$", "", s).strip()]
            for at in range(k + 1, end + 1):
                word = items[at].split(None, 1)[0].upper() if items[at].split() else ""
                level += 1 if word == "IF" and re.search(r"(?i)\bTHEN$", items[at]) else -1 if re.match(r"(?i)END\s*IF", items[at]) and at != end else 0
                if at == end or (level == 0 and word in ("ELSE", "ELSEIF")):
                    arms.append((conditions[-1], items[start + 1 : at]))
                    conditions.append("true" if word == "ELSE" else re.sub(r"(?i)^ELSEIF\b|\bTHEN$", "", items[at]).strip())
                    start = at
            for condition, body in arms:
                known = truth(expand(condition, variables))
                if known is False:
                    continue
                yield from run_control(body, variables, subs, depth)
                if known:
                    break
            k = end + 1
            continue
        if head == "FOR":
            end = _matching(items, k, "FOR", r"NEXT\b")
            each = re.match(r"(?i)FOR\s+EACH\s+(\w+)\s+IN\s+(.*)", s, re.S)
            count = re.match(r"(?i)FOR\s+(\w+)\s*=\s*(-?\d+)\s+TO\s+(-?\d+)(?:\s+STEP\s+(-?\d+))?", expand(s, variables))
            values: list[str] = [v.strip().strip("'") for v in split_top(each[2])] if each else []
            if count:
                step = int(count[4] or 1) or 1
                values = [str(v) for v in range(int(count[2]), int(count[3]) + (1 if step > 0 else -1), step)]
            name = (each or count)[1] if each or count else None
            for v in (values or [None])[:MAX_UNROLL]:
                bound = {name: v} if name and v is not None else {}
                variables.update(bound)
                yield from run_control([expand(b, bound) for b in items[k + 1 : end]], variables, subs, depth)
            k = end + 1
            continue
        if m := re.match(r"(?is)(SET|LET)\s+([\w.]+)\s*=\s*(.*)", s):
            variables[m[2]] = expand(m[3].strip().strip("'"), variables)
        yield s
        k += 1


def _matching(items: list[str], k: int, opens: str, closes: str) -> int:
    level = 0
    for at in range(k, len(items)):
        word = items[at].split(None, 1)[0].upper() if items[at].split() else ""
        if word == opens and (opens != "IF" or re.search(r"(?i)\bTHEN$", items[at])):
            level += 1
        elif re.match(rf"(?i){closes}", items[at]):
            level -= 1
            if level == 0:
                return at
    return len(items) - 1


def split_top(text: str) -> list[str]:
    """Parts between commas outside quotes, brackets and parentheses."""
    out, now, level = [], [], 0
    for piece in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|\[[^\]]*\]|.", text, re.S):
        level += (piece == "(") - (piece == ")")
        if piece == "," and level == 0:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(piece)
    out.append("".join(now).strip())
    return [p for p in out if p]


def clean_name(text: str) -> str:
    return text.strip().strip('[]"`').strip()


def field_of(expression: str) -> dict:
    """struct(name, sources, expression, transforms) of one field of a LOAD."""
    m = re.search(r"(?is)^(.*?)\s+AS\s+(\[[^\]]+\]|\"[^\"]+\"|[\w.%#$ ]+?)$", expression.strip())
    expr = (m[1] if m else expression).strip()
    bare = re.sub(r"'(?:[^']|'')*'", " ", expr)
    names = [clean_name(x) for x in re.findall(r"\[[^\]]+\]|\"[^\"]+\"|(?<![\w.#])[A-Za-z_%][\w.%#$]*+(?!\s*\()", bare)]
    sources = list(dict.fromkeys(n for n in names if n.lower() not in FUNCTIONS and not re.fullmatch(r"[\d.]+", n)))
    called = [f for f in re.findall(r"([A-Za-z_][\w#]*)\s*\(", bare) if f.lower() in FUNCTIONS]
    name = clean_name(m[2]) if m else (sources[0] if len(sources) == 1 and clean_name(expr) == sources[0] else clean_name(expr))
    maps = re.findall(r"(?i)ApplyMap\s*\(\s*'([^']+)'", expr)
    return {"name": name, "sources": sources, "expression": expr, "transforms": called, "maps": maps}


_LOAD = re.compile(r"(?is)^(?:(?P<label>\[[^\]]+\]|\"[^\"]+\"|[\w .%#$-]+?)\s*:\s*)?(?P<prefix>(?:(?:MAPPING|NOCONCATENATE|BUFFER|ADD|REPLACE|CROSSTABLE\s*\([^)]*\)|CONCATENATE(?:\s*\([^)]*\))?|(?:LEFT|RIGHT|INNER|OUTER|FULL)?\s*(?:OUTER\s+)?(?:JOIN|KEEP)(?:\s*\([^)]*\))?)\s+)*)(?P<verb>LOAD|SQL\s+SELECT|SELECT)\s+(?P<rest>.*)$")


def parse_load_script(path: str, text: str, files: dict[str, str] | None = None) -> list[tuple[str, dict]]:
    """Rows of a script, resolved: datasets, attributes, edges with confidences, constraints."""
    text, notes = include(strip_comments(text), files or {})
    variables: dict[str, str] = {}
    out: list[tuple[str, dict]] = list(notes)
    datasets: dict[str, list[str]] = {}
    mappings: set[str] = set()
    connection, last, preceding = None, None, None

    def edge(src: str, dst: str, rel: str, confidence: float, transform: str = "") -> None:
        out.append(("edge", {"src": src, "dst": dst, "rel": rel, "confidence": confidence, "transform": transform}))

    def attribute_edge(dataset: str, name: str, origin: str, resident: bool, source: str, rel: str, confidence: float, transform: str = "") -> None:
        edge(f"{dataset}.{name}", f"{origin}.{source}", rel, confidence, transform)
        out.append(("attribute_edge", {"dataset": dataset, "name": name, "origin": origin, "resident": resident, "source": source, "rel": rel, "confidence": confidence, "transform": transform}))

    def attributes(dataset: str, names: list[str]) -> None:
        for n in names:
            if n not in datasets.setdefault(dataset, []):
                datasets[dataset].append(n)
                out.append(("attribute", {"dataset": dataset, "name": n}))

    for s in run_control(statements(text), variables):
        s = expand(s, variables)
        if m := re.match(r"(?is)(SET|LET)\s+([\w.]+)\s*=\s*(.*)", s):
            out.append(("variable", {"name": m[2], "kind": m[1].upper(), "value": variables.get(m[2], m[3].strip())}))
        elif m := re.match(r"(?is)(ODBC|OLEDB|LIB|CUSTOM)?\s*CONNECT(?:32|64)?\s+TO\s+(.*)", s):
            connection = clean_name(m[2].strip().strip("'"))
            pairs = dict(p.split("=", 1) for p in connection.split(";") if "=" in p)
            lower = {k.strip().lower(): v.strip() for k, v in pairs.items()}
            secret = any(k in lower for k in ("password", "pwd", "xpassword"))
            connection = lower.get("data source") or lower.get("dsn") or lower.get("server") or ("" if pairs else connection)
            out.append(("connection", {"driver": (m[1] or "").upper(), "name": connection, "database": lower.get("initial catalog") or lower.get("database"), "provider": lower.get("provider"), "has_credentials": secret}))
        elif m := re.match(r"(?is)STORE\s+(?:(?:\*|.*?)\s+FROM\s+)?(\[[^\]]+\]|\"[^\"]+\"|\w+)\s+INTO\s+(.*?)(?:\s*\((\w+)\))?$", s):
            target = clean_name(m[2].strip().strip("'"))
            out.append(("store", {"dataset": clean_name(m[1]), "file": target}))
            edge(clean_name(m[1]), target, "STORED_AS", 1.0)
        elif m := re.match(r"(?is)BINARY\s+(.*)", s):
            edge(clean_name(m[1].strip().strip("'")), path, "INHERITS", 1.0)
        elif m := re.match(r"(?is)DROP\s+(TABLE|FIELD)S?\s+(.*)", s):
            for name in split_top(re.sub(r"(?is)\s+FROM\s+.*", "", m[2])):
                out.append(("drop", {"kind": m[1].lower(), "name": clean_name(name)}))
        elif m := _LOAD.match(s):
            prefix, verb, rest = m["prefix"].upper(), m["verb"].upper(), m["rest"]
            sql = verb.endswith("SELECT")
            source = re.search(r"(?is)\b(RESIDENT|FROM_FIELD|FROM|INLINE|AUTOGENERATE)\b\s*(.*)$", rest)
            if source and not sql and source[1].upper() == "FROM" and "'" not in source[2] and "[" not in source[2]:
                pass
            listed = rest[: source.start()] if source else rest
            fields = [field_of(f) for f in split_top(re.sub(r"(?is)^\s*DISTINCT\s+", "", listed))]
            label = clean_name(m["label"]) if m["label"] else None
            joins = re.search(r"(LEFT|RIGHT|INNER|OUTER|FULL)?\s*(?:OUTER\s+)?(JOIN|KEEP)(?:\s*\(([^)]*)\))?", m["prefix"], re.I)
            concat = re.search(r"(?<!NO)CONCATENATE(?:\s*\(([^)]*)\))?", m["prefix"], re.I)
            if not sql and source is None:
                preceding = (label, fields, prefix, joins, concat)  # its rows come from the next statement
                continue
            if preceding is not None:
                p_label, p_fields, prefix, joins, concat = preceding
                label, inner, fields, preceding = p_label or label, fields, p_fields, None
            else:
                inner = None
            target = (clean_name(joins[3]) if joins and joins[3] else clean_name(concat[1]) if concat and concat[1] else last if joins or concat else None) or label or f"{path}#{len(datasets)}"
            kind = source[1].upper() if source else ""
            origin = source[2].strip() if source else ""
            if kind == "INLINE":
                header = re.search(r"\[\s*([^\n\]]+)", origin)
                fields = [{"name": clean_name(c), "sources": [], "expression": c, "transforms": [], "maps": []} for c in (header[1] if header else "").split(",") if c.strip()] if [f["name"] for f in fields] == ["*"] else fields
            origin_name = clean_name(re.split(r"(?is)\s+(?:WHERE|GROUP\s+BY|ORDER\s+BY|QUALIFY)\b|\s*\(", origin.strip().strip("'"))[0].strip().strip("'")) if origin else ""
            if kind == "RESIDENT":
                origin_name = clean_name(re.split(r"\s", origin)[0]) if not origin.startswith("[") else clean_name(re.match(r"\[[^\]]+\]", origin)[0])
                if [f["name"] for f in fields] == ["*"]:
                    fields = [{"name": c, "sources": [c], "expression": c, "transforms": [], "maps": []} for c in datasets.get(origin_name, [])]
            elif sql:
                origin_name = origin_name.split(" ")[0].upper()
                if inner is not None and [f["name"] for f in fields] == ["*"]:
                    fields = inner
            if "MAPPING" in prefix:
                mappings.add(target)
            if target not in datasets:
                datasets[target] = []
                out.append(("dataset", {"name": target, "kind": "mapping" if "MAPPING" in prefix else "table", "source_kind": "sql" if sql else kind.lower(), "source": origin_name, "connection": connection if sql else None}))
            before = list(datasets[target])
            confidence = 0.95 if kind == "RESIDENT" else 0.9 if concat else 1.0 if sql else 1.0
            rel = "DERIVES_FROM"
            if joins:
                how = f"{(joins[1] or 'OUTER').upper()} {joins[2].upper()}"
                edge(target, origin_name, "JOINS", 0.85, how)
            elif origin_name:
                edge(target, origin_name, "DERIVES_FROM" if kind == "RESIDENT" else "SOURCED_FROM", confidence, "concatenate" if concat else "")
            attributes(target, [f["name"] for f in fields if f["name"] != "*"])
            for f in fields:
                resident = kind == "RESIDENT"
                if joins and f["name"] in before:
                    attribute_edge(target, f["name"], origin_name, resident, f["name"], "REFERENCES_FK", 0.6)
                    continue
                for src in f["sources"]:
                    attribute_edge(target, f["name"], origin_name, resident, src, rel, 0.85 if joins else confidence, ">".join(f["transforms"]))
                for name in f["maps"]:
                    edge(f"{target}.{f['name']}", name, "MAPS_TO", 0.85)
                    out.append(("attribute_map", {"dataset": target, "name": f["name"], "mapping": name}))
            last = target
        elif re.match(r"(?i)(QUALIFY|UNQUALIFY|RENAME|SECTION|TRACE|SLEEP|EXIT|COMMENT|TAG|DIRECTORY|DISCONNECT|CALL|LOAD\b)", s):
            out.append(("diagnostic", {"level": "info", "code": "not_applied", "detail": s[:120]}))
        else:
            out.append(("diagnostic", {"level": "warning", "code": "unrecognised", "detail": s[:120]}))
    kept = {k: v for k, v in datasets.items() if k not in mappings}
    out += constraints(kept, [(x["src"], x["dst"]) for kind, x in out if kind == "edge" and x["rel"] == "JOINS"])
    return out


#: Confidence of each signal for a key.
SIGNALS = {"qvd_hint": 0.7, "join_inferred": 0.6, "synthetic": 0.55, "naming_inferred": 0.5, "key_name": 0.4}
_KEY_NAME = re.compile(r"(?i)id|[a-z_]\w*(?:id|key)|%[a-z_]\w*key")


def constraints(datasets: dict[str, list[str]], joins: Iterable[tuple[str, str]] = (), unique: dict[str, list[str]] | None = None) -> list[tuple[str, dict]]:
    """Key candidates of datasets (name to fields), the strongest signal first; the first of a dataset's kind and columns stands.

    unique: fields whose data file says that all values differ; joins: (target, source). Fields that datasets share refer
    to each other; two shared fields or more are a synthetic key of both; names that look like keys are the last resort.
    """
    out: dict[tuple, tuple[str, dict]] = {}

    def add(dataset: str, kind: str, columns: list[str], signal: str, target: str | None = None) -> None:
        row = {"dataset": dataset, "kind": kind, "columns": columns, "confidence": SIGNALS[signal], "signal": signal, "references": target}
        out.setdefault((dataset, kind, tuple(columns)), ("constraint", row))

    for d, fields in (unique or {}).items():
        for f in fields:
            add(d, "unique", [f], "qvd_hint")
    for d, other in joins:
        for f in sorted(set(datasets.get(d, ())) & set(datasets.get(other, ()))):
            add(d, "foreign_key", [f], "join_inferred", other)
    holders: dict[str, list[str]] = {}
    for d, fields in datasets.items():
        for f in dict.fromkeys(fields):
            holders.setdefault(f, []).append(d)
    shared: dict[tuple[str, str], list[str]] = {}
    for f, names in holders.items():
        for a, b in permutations(names, 2):
            add(a, "foreign_key", [f], "naming_inferred", b)
            if a < b:
                shared.setdefault((a, b), []).append(f)
    warnings = []
    for pair, fields in shared.items():
        if len(fields) >= 2:
            for d in pair:
                add(d, "synthetic_key", sorted(fields), "synthetic")
            warnings.append(("diagnostic", {"level": "warning", "code": "synthetic_key", "detail": f"{pair[0]} and {pair[1]} share {', '.join(sorted(fields))}"}))
    for d, fields in datasets.items():
        for f in fields:
            if _KEY_NAME.fullmatch(f):
                add(d, "primary_key", [f], "key_name")
    return [*out.values(), *warnings]


def qvd_header(content: bytes) -> dict:
    """Table name, records, fields (name, symbols, bit layout) and lineage statements of a QVD file's XML header."""
    end = content.find(b"</QvdTableHeader>")
    if end < 0:
        raise ValueError("no QVD header")
    root = ET.fromstring(content[: end + len(b"</QvdTableHeader>")])
    number = lambda e, tag: int(e.findtext(tag) or 0)
    records = number(root, "NoOfRecords")
    fields = [{"name": f.findtext("FieldName"), "symbols": number(f, "NoOfSymbols"), "bit_offset": number(f, "BitOffset"), "bit_width": number(f, "BitWidth"), "bias": number(f, "Bias"), "unique": number(f, "NoOfSymbols") == records and records > 0} for f in root.iter("QvdFieldHeader")]
    return {"table": root.findtext("TableName"), "records": records, "fields": fields, "lineage": [x.findtext("Statement") for x in root.iter("LineageInfo") if x.findtext("Statement")]}


def compound_streams(content: bytes) -> dict[str, bytes]:
    """Streams of an OLE compound file, by name: the container of binary documents."""
    if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    size = 1 << struct.unpack_from("<H", content, 30)[0]
    mini_size = 1 << struct.unpack_from("<H", content, 32)[0]
    n_fat, first_dir, cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<I", content, 44)[0], struct.unpack_from("<I", content, 48)[0], struct.unpack_from("<I", content, 56)[0], struct.unpack_from("<I", content, 60)[0], 0, struct.unpack_from("<I", content, 68)[0], struct.unpack_from("<I", content, 72)[0]
    sector = lambda n: content[(n + 1) * size : (n + 2) * size]
    tables = list(struct.unpack_from("<109I", content, 76))
    at = first_difat
    for _ in range(n_difat):
        block = struct.unpack(f"<{size // 4}I", sector(at))
        tables += block[:-1]
        at = block[-1]
    fat = [x for t in tables[:n_fat] if t < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(t))]

    def chain(start: int, links: list[int]) -> list[int]:
        out, seen = [], set()
        while start < 0xFFFFFFFA and start not in seen and start < len(links):
            seen.add(start)
            out.append(start)
            start = links[start]
        return out

    directory = b"".join(sector(n) for n in chain(first_dir, fat))
    entries = [directory[k : k + 128] for k in range(0, len(directory), 128)]
    named = [(e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace"), e[66], struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0]) for e in entries if len(e) == 128]
    root = next((x for x in named if x[1] == 5), None)
    mini = b"".join(sector(n) for n in chain(root[2], fat)) if root else b""
    mini_fat = [x for n in chain(first_mini, fat) for x in struct.unpack(f"<{size // 4}I", sector(n))]
    out = {}
    for name, kind, start, length in named:
        if kind == 2:
            data = b"".join(mini[n * mini_size : (n + 1) * mini_size] for n in chain(start, mini_fat)) if length < cutoff else b"".join(sector(n) for n in chain(start, fat))
            out[name] = data[:length]
    return out


def script_of_binary(content: bytes) -> str:
    """The stream of a binary document that looks most like a load script: by keywords, then by length."""
    words = ("LOAD", "SQL SELECT", "CONNECT TO", "RESIDENT", "STORE", "SET ", "LET ", "QUALIFY", "INLINE")
    best = (0, 0, "")
    for data in compound_streams(content).values():
        for code in ("utf-8", "utf-16-le", "cp1252"):
            text = data.decode(code, "ignore")
            hits = sum(w in text.upper() for w in words)
            best = max(best, (hits, len(text), text)) if hits >= 3 else best
    return best[2]


def sense_fields(objects: DataFrame) -> DataFrame:
    """(object, type, title, field): fields that app objects (qId, qType, qTitle, qData JSON) use, by their expressions."""
    found = F.regexp_extract_all("qData", F.lit(r"\"(?:qDef|qExpression|qFieldDefs)\"\s*:\s*\[?\s*\"((?:[^\"\\]|\\.)*)\""), 1)
    rows = objects.select(F.col("qId").alias("object"), F.col("qType").alias("type"), F.col("qTitle").alias("title"), F.explode(found).alias("expression"))
    bracketed = F.regexp_extract_all("expression", F.lit(r"\[([^\]]+)\]"), 1)
    words = F.filter(F.regexp_extract_all("expression", F.lit(r"(?<![\w\[])([A-Za-z_]\w*)(?![\w\]]*\()"), 1), lambda w: ~F.lower(w).isin(sorted(FUNCTIONS)))
    names = F.when(F.size(bracketed) > 0, bracketed).otherwise(words)
    return rows.select("object", "type", "title", F.explode(F.array_distinct(names)).alias("field")).distinct()


def feeds_objects(fields: DataFrame, attributes: DataFrame) -> DataFrame:
    """(object, dataset, attribute): object fields joined to attributes of that name, without case."""
    a = attributes.select("dataset", F.col("name").alias("attribute"), F.lower("name").alias("key"))
    return fields.withColumn("key", F.lower("field")).join(a, "key").select("object", "dataset", "attribute").distinct()


def app_scripts(content: bytes) -> list[str]:
    """Load scripts inside an app that is an SQLite file: text columns whose names speak of scripts, JSON unwrapped."""
    import json
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    out = []
    for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
        columns = [c[1] for c in db.execute(f'PRAGMA table_info("{table}")').fetchall()]
        wanted = [c for c in columns if re.search(r"(?i)script|definition|qscript|content|data", c)]
        for c in wanted:
            for (value,) in db.execute(f'SELECT "{c}" FROM "{table}"').fetchall():
                text = value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value or "")
                if text.lstrip().startswith("{"):
                    try:
                        held = json.loads(text)
                        text = next((str(held[k]) for k in ("qScript", "script", "Script") if k in held), text)
                    except ValueError:
                        pass
                if sum(w in text.upper() for w in ("LOAD", "SET ", "FROM", "RESIDENT", "CONNECT")) >= 2:
                    out.append(text)
    return out


def server_tasks(path: str, text: str) -> list[tuple[str, dict]]:
    """Rows of a server's task file: tasks, their triggers, and which task starts which, by name without case."""
    root = ET.fromstring(text)
    tasks = {t.get("name") or t.findtext("Name"): t for t in root.iter() if t.tag.lower() == "task"}
    by_name = {n.lower(): n for n in tasks if n}
    out = []
    for name, t in tasks.items():
        out.append(("task", {"name": name, "document": t.get("document") or t.findtext("Document")}))
        for g in (x for x in t.iter() if x.tag.lower() == "trigger"):
            kind, after = g.get("type") or "schedule", g.get("after") or g.findtext("After")
            out.append(("trigger", {"task": name, "kind": kind, "schedule": g.get("schedule") or g.findtext("Schedule")}))
            if after and after.lower() in by_name:
                out.append(("edge", {"src": by_name[after.lower()], "dst": name, "rel": "TRIGGERS", "confidence": 0.9}))
    return out


def connection_store(stores: dict[str, str], name: str) -> dict | None:
    """A named connection from the first store that has it: connection files, then settings, then data source lists."""
    for suffix in (".dconn", "settings.ini", "odbc.ini"):
        for path, text in sorted(stores.items()):
            if not path.lower().endswith(suffix):
                continue
            if suffix == ".dconn":
                if path.replace("\\", "/").rsplit("/", 1)[-1].removesuffix(".dconn").lower() == name.lower():
                    return {"store": path, "string": text.strip()}
            else:
                sections = re.split(r"(?m)^\[([^\]]+)\]\s*$", text)
                for section, body in zip(sections[1::2], sections[2::2]):
                    if section.lower() == name.lower():
                        return {"store": path, "string": ";".join(x.strip() for x in body.splitlines() if "=" in x)}
    return None


def inherited(datasets: DataFrame, binaries: DataFrame, max_depth: int = 10) -> DataFrame:
    """(path, name, origin, depth): datasets that scripts get through BINARY, over any number of steps, cycles guarded.

    datasets: (path, name); binaries: (path, source).
    """
    from ..operators.graph import reach_from_each

    edges = binaries.select(F.col("path").alias("src"), F.col("source").alias("dst"), F.lit("BINARY").alias("rel"))
    found = reach_from_each(edges, edges.select(F.col("src").alias("id")), max_depth)
    return found.join(datasets.withColumnRenamed("path", "id"), "id").select(F.col("root").alias("path"), "name", F.col("id").alias("origin"), "depth")


def variable_links(variables: DataFrame) -> DataFrame:
    """(src, dst, rel): a variable refers to those whose names its value expands, from (name, value)."""
    used = variables.select(F.col("name").alias("src"), F.explode(F.regexp_extract_all("value", F.lit(r"\$\((\w[\w.]*)\)"), 1)).alias("ref"))
    names = variables.select(F.col("name").alias("dst")).distinct()
    return used.join(names, F.lower("ref") == F.lower("dst")).select("src", "dst", F.lit("RESOLVES_TO").alias("rel")).distinct()
