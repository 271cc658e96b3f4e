"""Scheduler definitions: composer text and XML exports as rows, and the resolution of what they refer to.

Rows of (kind, payload): workstation, calendar, resource, prompt, schedule, job, follows, needs, opens, job_prompt,
recovery, run_cycle, event_rule, diagnostic. Ids are canonical ids of qualified names.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import make_id
from .artifacts import entities

_STREAM_WORDS = {"ON", "EXCEPT", "AT", "UNTIL", "DEADLINE", "CARRYFORWARD", "PRIORITY", "LIMIT", "FOLLOWS", "NEEDS", "OPENS", "PROMPT", "DESCRIPTION", "DRAFT", "VALIDFROM", "EVERY", "KEYSCHED", "MATCHING", "VARTABLE", "FREEDAYS", "ONUNTIL", "NOTFOLLOWS", "SCHEDTIME", "JSUNTIL", "CONFIRMED"}
_JOB_WORDS = {"SCRIPTNAME", "DOCOMMAND", "STREAMLOGON", "DESCRIPTION", "RECOVERY", "FOLLOWS", "NEEDS", "OPENS", "PROMPT", "AT", "UNTIL", "DEADLINE", "EVERY", "PRIORITY", "CONFIRMED", "KEYJOB", "TASKTYPE", "RCCONDSUCC", "MATCHING", "NOTFOLLOWS", "ABENDPROMPT", "INTERACTIVE", "ONUNTIL", "CRITICAL", "MAXDUR", "MINDUR"}
_TOP = ("SCHEDULE", "CPUNAME", "CALENDAR", "RESOURCE", "PROMPT", "EVENTRULE", "JOBS", "PARMS")


def stream_id(workstation: str, stream: str) -> str:
    return make_id("schedule", workstation, stream)


def job_id(workstation: str, stream: str, job: str) -> str:
    return make_id("job", workstation, stream, job)


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines without comments, continued ones joined, with their numbers."""
    text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m.group().count("\n"), text, flags=re.S)
    held, start = "", 0
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"^\s*#.*$", "", raw).rstrip()
        held, start = (held + " " + line.strip(), start) if held else (line, number)
        if held.endswith("\\"):
            held = held[:-1].rstrip()
            continue
        if held.strip():
            yield start, held.strip()
        held = ""


def _unquote(text: str) -> str:
    return text.strip().strip('"').strip()


def _stream_name(text: str) -> tuple[str, str]:
    """(workstation, stream) of WS#STREAM or WS#MASTER#STREAM."""
    parts = [p for p in text.strip().split("#") if p]
    return (parts[0], parts[-1]) if len(parts) > 1 else ("", parts[0] if parts else "")


def reference(text: str, workstation: str, stream: str) -> dict:
    """Target of a FOLLOWS: own stream for a bare job, the named stream otherwise; @ is the whole stream."""
    target, _, condition = re.sub(r"\s+", " ", text.strip()).partition(" IF ")
    target = target.split(" ")[0].rstrip(",")
    if "#" in target or "." in target:
        ws, name = _stream_name(target.rpartition(".")[0] if "." in target else target)
        job = target.rpartition(".")[2] if "." in target else "@"
        return {"workstation": ws or workstation, "stream": name, "job": job, "external": True, "condition": condition.strip() or None}
    return {"workstation": workstation, "stream": stream, "job": target, "external": False, "condition": condition.strip() or None}


def _time(text: str) -> str | None:
    m = re.match(r"(\d{1,2}):?(\d{2})\b", text.strip())
    return f"{int(m[1]):02d}:{m[2]}" if m and int(m[1]) < 24 and int(m[2]) < 60 else None


def parse_composer(path: str, text: str) -> Iterator[tuple[str, dict]]:
    """Rows of a composer dump. Lines that mean nothing are error diagnostics."""
    top, name, schedule, job, body, number = "", "", None, None, False, 0
    ws = stream = ""
    order = 0
    out: list[tuple[str, dict]] = []

    def bad(detail: str) -> None:
        out.append(("diagnostic", {"level": "error", "code": "syntax", "detail": detail[:200], "line": number}))

    def owner() -> dict:
        return {"job_id": job["id"] if job else None, "schedule_id": schedule["id"], "scope": "job" if job else "schedule"}

    def common(word: str, rest: str) -> bool:
        """Clauses that a stream and a job may both have."""
        target = job or schedule
        if word == "FOLLOWS":
            out.append(("follows", owner() | reference(rest, ws, stream) | {"line": number}))
        elif word == "NEEDS":
            m = re.match(r"(\d+)?\s*(\S+)", rest)
            held = m[2] if m else rest
            out.append(("needs", owner() | {"resource": held.split("#")[-1], "workstation": held.split("#")[0] if "#" in held else ws, "quantity": int(m[1]) if m and m[1] else 1}))
        elif word == "OPENS":
            m = re.match(r"(?:(\S+?)#)?\"([^\"]+)\"", rest)
            out.append(("opens", owner() | {"workstation": (m[1] if m and m[1] else ws), "file": m[2] if m else _unquote(rest)}))
        elif word == "PROMPT":
            inline = rest.startswith('"')
            out.append(("job_prompt", owner() | {"prompt": _unquote(rest) if not inline else f"inline:{make_id('prompt', _unquote(rest))}", "inline_text": _unquote(rest) if inline else None}))
        elif word in ("AT", "UNTIL", "DEADLINE", "EVERY"):
            target[{"AT": "start_time", "UNTIL": "end_time", "DEADLINE": "deadline", "EVERY": "every"}[word]] = _time(rest)
        elif word == "PRIORITY":
            target["priority"] = int(rest) if rest.isdigit() else None
        elif word == "DESCRIPTION":
            target["description"] = _unquote(rest)
        else:
            return False
        return True

    for number, line in _lines(text):
        word, _, rest = line.partition(" ")
        word, rest = word.upper(), rest.strip()
        if word == "END":
            top, schedule, job, body = "", None, None, False
            continue
        starts = word in _TOP and not (top == "SCHEDULE" or (top == "CPUNAME") or (top == "EVENTRULE"))
        if starts or word in ("SCHEDULE", "CPUNAME", "EVENTRULE") and rest:
            top, name = word, rest
            if word == "SCHEDULE":
                ws, stream = _stream_name(rest.split()[0])
                schedule, job, body, order = {"id": stream_id(ws, stream), "workstation": ws, "name": stream, "line": number, "carry_forward": False}, None, False, 0
                out.append(("schedule", schedule))
                out.append(("workstation", {"id": make_id("workstation", ws), "name": ws, "declared": False}))
            elif word == "CPUNAME":
                out.append(("workstation", {"id": make_id("workstation", rest.split()[0]), "name": rest.split()[0], "declared": True}))
            elif word == "CALENDAR":
                out.append(("calendar", {"id": make_id("calendar", rest.split()[0]), "name": rest.split()[0], "dates": []}))
            elif word == "RESOURCE":
                m = re.match(r"(?:(\S+?)#)?(\S+)\s*(\d+)?", rest)
                out.append(("resource", {"id": make_id("resource", m[2]), "name": m[2], "workstation": m[1], "units": int(m[3]) if m[3] else 1}))
            elif word == "PROMPT":
                out.append(("prompt", {"id": make_id("prompt", rest.split()[0]), "name": rest.split()[0], "text": None}))
            elif word == "EVENTRULE":
                out.append(("event_rule", {"id": make_id("eventrule", rest.split()[0]), "name": rest.split()[0], "streams": []}))
        elif top == "SCHEDULE":
            if line == ":":
                body = True
            elif not body:
                if word in ("ON", "EXCEPT"):
                    m = re.match(r"(?:RUNCYCLE\s+)?(\S+)(.*)", rest, re.S | re.I)
                    calendar = re.search(r"\bCALENDAR\s+(\S+)", m[2], re.I)
                    rule = re.search(r'"([^"]+)"', m[2])
                    valid = re.search(r"\bVALIDFROM\s+(\S+)", m[2], re.I)
                    out.append(("run_cycle", {"schedule_id": schedule["id"], "name": m[1], "exclude": word == "EXCEPT", "calendar": calendar[1] if calendar else None, "rule": rule[1] if rule else None, "valid_from": valid[1] if valid else None}))
                elif word == "CARRYFORWARD":
                    schedule["carry_forward"] = True
                elif word == "LIMIT":
                    schedule["limit"] = int(rest) if rest.isdigit() else None
                elif word in ("AT", "UNTIL") and re.search(r"\bUNTIL\b", rest, re.I) and word == "AT":
                    first, _, second = re.split(r"(\bUNTIL\b)", rest, maxsplit=1, flags=re.I)
                    common("AT", first.strip())
                    common("UNTIL", second.strip())
                elif not common(word, rest) and word not in _STREAM_WORDS:
                    bad(line)
            elif word in _JOB_WORDS:
                if job is None:
                    bad(line)
                elif word in ("SCRIPTNAME", "DOCOMMAND"):
                    job["script"] = _unquote(rest)
                elif word == "STREAMLOGON":
                    job["logon"] = rest
                elif word == "RECOVERY":
                    m = re.match(r"(\w+)(?:\s+AFTER\s+(?:(\S+?)#)?(\S+))?", rest, re.I)
                    job["recovery"] = m[1].lower() if m else None
                    if m and m[3]:
                        out.append(("recovery", owner() | {"action": m[1].lower(), "workstation": ws, "stream": stream, "job": m[3]}))
                else:
                    common(word, rest)
            elif re.fullmatch(r"(?:[\w.@-]+#)*[\w.-]+", line):
                own, _, short = line.rpartition("#")
                order += 1
                job = {"id": job_id(ws, stream, short), "schedule_id": schedule["id"], "workstation": ws, "runs_on": own.split("#")[0] or ws, "stream": stream, "name": short, "order": order, "script": None, "line": number}
                out.append(("job", job))
            else:
                bad(line)
        elif top == "CALENDAR":
            out[-1][1]["dates"] += re.findall(r"\d{2}/\d{2}/\d{4}", line)
        elif top in ("RESOURCE", "PROMPT") and line.startswith('"'):
            out[-1][1]["text"] = _unquote(line)
        elif top == "EVENTRULE":
            if word == "JOBSTREAM":
                out[-1][1]["streams"].append(rest)
        elif top != "CPUNAME":
            bad(line)
    yield from out


def parse_xml(path: str, text: str) -> Iterator[tuple[str, dict]]:
    """Rows of an XML export, of <schedule> elements or with <jobstream> as the root."""
    root = ET.fromstring(text)
    found = [root] if root.tag == "jobstream" else [e for e in root.iter() if e.tag in ("schedule", "jobstream") and (e.find("jobs") is not None or e.find("name") is not None)]
    for s in found:
        child = lambda *names, e=s: next((e.findtext(n).strip() for n in names if e.findtext(n)), None)
        ws, stream = s.get("workstation") or child("workstation") or "", s.get("name") or child("name") or ""
        limits = s.find("timerestrictions")
        at = limits.attrib if limits is not None else {}
        sid = stream_id(ws, stream)
        start, end = at.get("at") or child("startTime"), at.get("until") or child("endTime")
        priority = at.get("priority") or child("priority")
        yield "workstation", {"id": make_id("workstation", ws), "name": ws, "declared": False}
        yield "schedule", {"id": sid, "workstation": ws, "name": stream, "start_time": _time(start or ""), "end_time": _time(end or ""), "priority": int(priority) if priority else None, "carry_forward": (child("carryForward") or "").lower() == "true"}
        for cycle in [c.get("name") for c in s.findall("runcycle")] + ([child("onRunCycle")] if child("onRunCycle") else []):
            yield "run_cycle", {"schedule_id": sid, "name": cycle, "exclude": False, "valid_from": child("validFrom")}
        jobs = s.find("jobs")
        for order, j in enumerate(jobs if jobs is not None else [], 1):
            text_of = lambda *names, e=j: next((e.findtext(n).strip() for n in names if e.findtext(n)), None)
            name = j.get("name") or text_of("name")
            jid = job_id(ws, stream, name)
            own = {"job_id": jid, "schedule_id": sid, "scope": "job"}
            yield "job", {"id": jid, "schedule_id": sid, "workstation": ws, "runs_on": ws, "stream": stream, "name": name, "order": order, "script": text_of("scriptName", "scriptname"), "logon": text_of("streamLogon"), "description": text_of("description"), "recovery": (text_of("recovery") or "").lower() or None}
            for f in j.findall("follows"):
                names = [d.findtext("job") or d.get("job") for d in f.iter("dependency")] or [f.text]
                for target in filter(None, names):
                    yield "follows", own | reference(target, ws, stream)
            for n in j.findall("needs"):
                yield "needs", own | {"resource": n.get("resource") or (n.text or "").strip(), "workstation": ws, "quantity": int(n.get("quantity") or 1)}
            for o in j.findall("opens"):
                yield "opens", own | {"workstation": ws, "file": (o.text or "").strip()}


def parse_scheduler(path: str, text: str) -> list[tuple[str, dict]]:
    return list(parse_xml(path, text) if text.lstrip().startswith("<") else parse_composer(path, text))


FOLLOWS = "job_id string, schedule_id string, scope string, workstation string, stream string, job string, external boolean, condition string"
JOB = "id string, schedule_id string, workstation string, runs_on string, stream string, name string, `order` int, script string, logon string, description string, recovery string, start_time string"
SCHEDULE = "id string, workstation string, name string, start_time string, end_time string, priority int, carry_forward boolean, description string"


def dependencies(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings) of all FOLLOWS: job to job, job to whole stream, stream to job or stream.

    An internal reference is to a job of its own stream only, an external one to exactly the named job or stream.
    edges: (src, dst, rel, key); key is the condition, so parallel conditions are edges of their own.
    """
    follows = entities(parsed, "follows", FOLLOWS).withColumn("src", F.coalesce("job_id", "schedule_id"))
    jobs = entities(parsed, "job", JOB).select("workstation", "stream", F.col("name").alias("job"), F.col("id").alias("dst")).distinct()
    streams = entities(parsed, "schedule", SCHEDULE).select("workstation", F.col("name").alias("stream"), F.col("id").alias("dst")).distinct()
    upper = lambda df: df.withColumns({c: F.upper(c) for c in ("workstation", "stream", "job") if c in df.columns})
    one, whole = upper(follows.filter("job <> '@'")), upper(follows.filter("job = '@'"))
    hit = one.join(upper(jobs), ["workstation", "stream", "job"]).unionByName(whole.join(upper(streams), ["workstation", "stream"]), allowMissingColumns=True)
    edges = hit.select("src", "dst", F.lit("DEPENDS_ON").alias("rel"), F.coalesce("condition", F.lit("")).alias("key")).distinct()
    missed = one.join(upper(jobs), ["workstation", "stream", "job"], "left_anti").unionByName(whole.join(upper(streams), ["workstation", "stream"], "left_anti"))
    warnings = missed.select("path", F.lit("unresolved_follows").alias("code"), F.concat_ws("#", "workstation", F.concat_ws(".", "stream", "job")).alias("detail"))
    return edges, warnings


def topology(parsed: DataFrame) -> DataFrame:
    """(kind, n): distinct entities of each kind; streams and schedules are one per definition."""
    rows = parsed.filter(F.col("kind").isin("workstation", "schedule", "job", "calendar", "resource", "prompt", "event_rule"))
    return rows.select("kind", F.get_json_object("payload", "$.id").alias("id")).groupBy("kind").agg(F.count_distinct("id").alias("n"))


def triggered(parsed: DataFrame) -> DataFrame:
    """(rule, schedule): event rules resolved to streams, by qualified name, or by a bare name that is unique."""
    rules = entities(parsed, "event_rule", "id string, name string, streams array<string>").select(F.col("id").alias("rule"), F.explode("streams").alias("target"))
    streams = entities(parsed, "schedule", SCHEDULE).select("id", "workstation", "name").distinct()
    exact = rules.join(streams, F.upper("target") == F.upper(F.concat_ws("#", "workstation", "name"))).select("rule", F.col("id").alias("schedule"))
    unique = streams.groupBy(F.upper("name").alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("schedule")).filter("n = 1")
    bare = rules.filter(~F.contains("target", F.lit("#"))).join(unique, F.upper("target") == F.col("bare")).select("rule", "schedule")
    return exact.unionByName(bare).distinct()


def local_dependencies(parsed: DataFrame) -> DataFrame:
    """(job_id, depends_on): bare names resolved inside one schedule only, as the relational mirror has them."""
    follows = entities(parsed, "follows", FOLLOWS).filter("NOT external AND job_id IS NOT NULL").select("job_id", "schedule_id", F.upper("job").alias("name"))
    jobs = entities(parsed, "job", JOB).select("schedule_id", F.upper("name").alias("name"), F.col("id").alias("depends_on")).distinct()
    return follows.join(jobs, ["schedule_id", "name"]).select("job_id", "depends_on").distinct()


def commands(parsed: DataFrame) -> DataFrame:
    """(job_id, path, args, kind) of jobs' command lines."""
    from ..functions.text import script_parts

    jobs = entities(parsed, "job", JOB).filter("script IS NOT NULL").withColumn("s", script_parts(F.col("script")))
    return jobs.select(F.col("id").alias("job_id"), "s.path", "s.args", "s.kind")


def cycles(parsed: DataFrame) -> DataFrame:
    """(schedule_id, name, frequency, days, cron) of run cycles, by their names and start times."""
    from ..functions.text import run_cycle

    starts = entities(parsed, "schedule", SCHEDULE).select(F.col("id").alias("schedule_id"), "start_time").distinct()
    rows = entities(parsed, "run_cycle", "schedule_id string, name string, exclude boolean, rule string").filter("NOT coalesce(exclude, false)")
    rows = rows.join(starts, "schedule_id", "left").withColumn("r", run_cycle(F.col("name"), F.col("start_time")))
    # A recurrence rule says more than a name.
    freq = F.lower(F.regexp_extract("rule", r"FREQ=(\w+)", 1))
    return rows.select("schedule_id", "name", F.when(freq != "", freq).otherwise(F.col("r.frequency")).alias("frequency"), "r.days", "r.cron")
