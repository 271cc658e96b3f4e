"""Orchestration definitions: Airflow DAG sources, Databricks workflow JSON, spark-submit shell lines."""

from __future__ import annotations

import ast
import re
import shlex
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _literal(node: ast.AST | None):
    try:
        return ast.literal_eval(node) if node is not None else None
    except ValueError:
        return None


def parse_airflow(path: str, text: str) -> Iterable[tuple[str, dict]]:
    """dag, task and dependency rows of a DAG source: >>, <<, chain() and set_upstream/downstream()."""
    tasks: dict[str, str] = {}
    out: list[tuple[str, dict]] = []

    def members(node: ast.AST) -> list[str]:
        if isinstance(node, ast.Name):
            return [node.id] if node.id in tasks else []
        if isinstance(node, ast.List | ast.Tuple):
            return [x for e in node.elts for x in members(e)]
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.RShift | ast.LShift):
            return members(node.right)
        return []

    def link(a: list[str], b: list[str]) -> None:
        out.extend(("dependency", {"task": tasks[y], "upstream": tasks[x]}) for x in a for y in b)

    def shifts(node: ast.AST) -> None:
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.RShift | ast.LShift):
            shifts(node.left)
            a, b = members(node.left), members(node.right)
            link(a, b) if isinstance(node.op, ast.RShift) else link(b, a)

    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) == "DAG":
            kw = {k.arg: _literal(k.value) for k in node.keywords}
            out.append(("dag", {"dag_id": kw.get("dag_id") or (_literal(node.args[0]) if node.args else None), "schedule": kw.get("schedule", kw.get("schedule_interval"))}))
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name):
            name = getattr(node.value.func, "id", getattr(node.value.func, "attr", ""))
            if name.endswith(("Operator", "Sensor")):
                kw = {k.arg: _literal(k.value) for k in node.value.keywords}
                tasks[node.targets[0].id] = kw.get("task_id") or node.targets[0].id
                target = next((kw[k] for k in ("application", "bash_command", "sql", "notebook_path", "python_callable", "json") if kw.get(k)), None)
                out.append(("task", {"task": tasks[node.targets[0].id], "operator": name, "target": str(target) if target is not None else None, "line": node.lineno}))
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Expr):
            shifts(node.value)
            call = node.value
            if isinstance(call, ast.Call):
                name = getattr(call.func, "id", getattr(call.func, "attr", ""))
                if name == "chain":
                    for a, b in zip(call.args, call.args[1:]):
                        link(members(a), members(b))
                elif name in ("set_upstream", "set_downstream"):
                    own, other = members(call.func.value), [x for a in call.args for x in members(a)]
                    link(other, own) if name == "set_upstream" else link(own, other)
    return out


_WORKFLOW = """name string, settings struct<name: string, schedule: struct<quartz_cron_expression: string>, tasks: array<struct<task_key: string,
notebook_task: struct<notebook_path: string>, spark_python_task: struct<python_file: string>, spark_jar_task: struct<main_class_name: string>, sql_task: struct<file: struct<path: string>>,
python_wheel_task: struct<entry_point: string>, spark_submit_task: struct<parameters: array<string>>, pipeline_task: struct<pipeline_id: string>, depends_on: array<struct<task_key: string>>>>>"""


def workflow_tasks(artifacts: DataFrame) -> DataFrame:
    """(path, workflow, cron, task, kind, target, upstream array) of workflow JSON (path, content)."""
    w = artifacts.select("path", F.from_json("content", _WORKFLOW).alias("w")).filter("w IS NOT NULL")
    t = w.select("path", F.coalesce("w.settings.name", "w.name").alias("workflow"), F.col("w.settings.schedule.quartz_cron_expression").alias("cron"), F.explode("w.settings.tasks").alias("t"))
    kinds = [("notebook", F.col("t.notebook_task.notebook_path")), ("python", F.col("t.spark_python_task.python_file")), ("jar", F.col("t.spark_jar_task.main_class_name")), ("sql", F.col("t.sql_task.file.path")), ("wheel", F.col("t.python_wheel_task.entry_point")), ("submit", F.element_at("t.spark_submit_task.parameters", -1)), ("pipeline", F.col("t.pipeline_task.pipeline_id"))]
    kind = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in kinds], F.lit("unknown"))
    target = F.coalesce(*[c for _, c in kinds])
    return t.select("path", "workflow", "cron", F.col("t.task_key").alias("task"), kind.alias("kind"), target.alias("target"), F.coalesce(F.col("t.depends_on.task_key"), F.array().cast("array<string>")).alias("upstream"))


_FLAGS = {"--supervise", "--verbose", "-v", "--usage-error", "--version", "--help", "-h"}


def parse_spark_submit(path: str, text: str) -> Iterable[tuple[str, dict]]:
    """submit rows of a shell script: application, arguments, --conf pairs and other options."""
    joined = re.sub(r"\\\r?\n", " ", text)
    for number, line in enumerate(joined.splitlines(), 1):
        if "spark-submit" not in line or line.lstrip().startswith("#"):
            continue
        try:
            words = shlex.split(line, comments=True)
        except ValueError as e:
            yield "diagnostic", {"level": "warning", "code": "unbalanced_quotes", "detail": str(e), "line": number}
            continue
        at = next((k for k, w in enumerate(words) if w.rsplit("/", 1)[-1] == "spark-submit"), None)
        if at is None:
            continue
        conf, options, k = {}, {}, at + 1
        while k < len(words) and words[k].startswith("-"):
            name, eq, value = words[k].partition("=")
            if words[k] in _FLAGS:
                k += 1
                continue
            if not eq or name == "--conf" and not value:
                k += 1
                value = words[k] if k < len(words) else ""
            if name in ("--conf", "-c"):
                key, _, v = value.partition("=")
                conf[key] = v
            else:
                options[name.lstrip("-")] = value
            k += 1
        app = words[k] if k < len(words) else None
        yield "submit", {"application": app, "args": words[k + 1 :], "conf": conf, "options": options, "line": number}
