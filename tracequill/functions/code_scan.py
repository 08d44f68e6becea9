"""Code in the arguments of tool calls: Python by its syntax tree, shell and SQL by column expressions.

The strings of an argument's JSON are guessed to be of one language by words that it has; only those guessed as Python
go to a parser, in Arrow batches. Names of arguments that say "run me" raise a score, tools that read code lower it.
Null arguments and empty texts score 0; arguments that are no JSON are one text; nothing is cut unless `longest` says so.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Python code is watched for, and the scores.
BUILTINS = ("exec", "eval", "compile", "__import__")
OS_CALLS = (
    "system", "popen", "popen2", "popen3", "popen4", "execv", "execve", "execl", "execle", "execlp", "execlpe", "execvp", "execvpe",
    "spawnl", "spawnle", "spawnlp", "spawnlpe", "spawnv", "spawnve", "spawnvp", "spawnvpe", "startfile",
)
SUBPROCESS_CALLS = ("Popen", "call", "check_call", "check_output", "run", "getoutput", "getstatusoutput")
MODULES = ("os", "subprocess", "sys", "socket", "shutil", "importlib", "ctypes", "pickle", "marshal", "pty", "commands", "pexpect")
ESCAPES = ("__class__", "__bases__", "__subclasses__", "__init__", "__globals__", "__builtins__", "__code__", "__func__", "__wrapped__")
RUN, IMPORTED, ESCAPED, PROCESS, TAKEN, MODULE = 0.95, 0.90, 0.85, 0.85, 0.80, 0.65
# Words that hint at a language.
HINTS = {
    "python": ("import ", "from ", " def ", " class ", "exec(", "eval(", "subprocess", "__import__", "os.system", "print(", "if __name__"),
    "sql": ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", "DROP ", "CREATE ", "EXEC ", "UNION ", "TRUNCATE ", "ALTER "),
    "shell": ("| ", "&&", "||", "; ", "$(", "`", "#!/", "curl ", "wget ", "bash -", "sh -", "nc -", "ncat ", "rm -rf"),
}
# Interpreters, places that no output should go to, and words of SQL that reach files or the system.
INTERPRETERS = ("bash", "sh", "dash", "zsh", "ash", "ksh", "csh", "tcsh", "python", "python3", "python2", "perl", "ruby", "node", "nodejs", "php", "lua", "tclsh", "expect")
PLACES = ("/etc/", "/dev/", "/proc/", "~/.ssh/", "~/.bashrc", "~/.profile", "~/.zshrc", "/root/", "/var/spool/cron")
SQL_WORDS = ("XP_CMDSHELL", "SP_EXECUTESQL", "LOAD_FILE", "INTO OUTFILE", "INTO DUMPFILE", "UTL_FILE", "DBMS_SCHEDULER", "OPENROWSET", "BULK INSERT")
STATEMENTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "EXEC", "EXECUTE", "TRUNCATE")
# Names of arguments that are run, tools that read code, and words in names of such tools.
RUN_NAMES = ("command", "cmd", "shell", "bash", "script", "code", "execute", "exec", "eval", "run", "expression", "program", "binary", "query", "sql", "statement", "input", "payload")
READERS = (
    "review_code", "analyze_code", "lint_code", "check_code", "audit_code", "inspect_code", "static_analysis", "code_review", "code_analysis", "code_check", "code_audit", "code_quality",
    "security_review", "security_audit", "security_check", "scan_code", "code_scan", "run_linter", "run_tests", "execute_tests", "test_runner", "format_code", "refactor_code", "explain_code",
    "document_code", "read_file", "get_file_content", "read_code", "fetch_code", "get_file", "open_file", "view_file", "cat_file",
)
READING_WORDS = ("review", "analyze", "lint", "audit", "inspect", "explain", "document", "format", "refactor")
#: Fixed value: strings shorter than this inside of an object or list are passed over.
SHORTEST = 8


def _name(node: ast.AST) -> list[str]:
    """The parts of a dotted name, none for other expressions."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else []


def _known_names(nodes: list[ast.AST]) -> dict[str, str]:
    """What local names stand for: modules under another name, functions taken out of modules, built-ins assigned to a name."""
    names: dict[str, str] = {}
    for node in nodes:
        if isinstance(node, ast.Import):
            names.update({a.asname or a.name.split(".")[0]: a.name.split(".")[0] for a in node.names if a.name.split(".")[0] in MODULES})
        elif isinstance(node, ast.ImportFrom):
            names.update({a.asname or a.name: a.name for a in node.names if a.name in BUILTINS or a.name in OS_CALLS})
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Name) and node.value.id in BUILTINS:
            names.update({t.id: node.value.id for t in node.targets if isinstance(t, ast.Name)})
    return names


def _findings(node: ast.AST, names: dict[str, str]) -> list[tuple[str, float]]:
    """Patterns of one node and their scores. A call that is watched for but has no score of its own counts as a pattern only."""
    if isinstance(node, ast.Attribute) and node.attr in ESCAPES:
        return [(f"sandbox_escape:{node.attr}", ESCAPED)]
    if isinstance(node, ast.Import):
        return [(f"import:{a.name}", MODULE) for a in node.names if a.name.split(".")[0] in MODULES]
    if isinstance(node, ast.ImportFrom):
        module = node.module or ""
        taken = [a.name for a in node.names if a.name in BUILTINS or a.name in OS_CALLS]
        whole = [(f"from_import:{module}", MODULE)] if module.split(".")[0] in MODULES else []
        shells = [n for n in taken if module == "os" and n.startswith(("system", "popen"))]
        return whole + [(f"from_import:{module}.{n}", PROCESS if n in shells else TAKEN if any(b in n for b in BUILTINS) else MODULE) for n in taken]
    if isinstance(node, ast.Call) and (parts := _name(node.func)):
        head, last = names.get(parts[0], parts[0]), parts[-1]
        if len(parts) == 1:
            return [(f"call:{head}", {"exec": RUN, "eval": RUN, "__import__": IMPORTED}.get(head, 0.0))] if head in BUILTINS else []
        if head == "os" and last in OS_CALLS:
            return [(f"call:os.{last}", PROCESS if last.startswith(("system", "popen")) else 0.0)]
        if head == "subprocess" and last in SUBPROCESS_CALLS:
            return [(f"call:subprocess.{last}", PROCESS)]
    return []


def python_one(code: str | None) -> tuple[float, list[str]]:
    """The score of a Python text and what was found, in the order of the text; nothing where it can't be parsed."""
    try:
        nodes = list(ast.walk(ast.parse(code or "")))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return 0.0, []
    names = _known_names(nodes)
    nodes.sort(key=lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0)))
    found = [f for n in nodes for f in _findings(n, names)]
    return (min(1.0, max(s for _, s in found) + min(0.05, 0.01 * len(found))), [p for p, _ in found]) if found else (0.0, [])


def strings_one(arguments: str | None) -> list[tuple[str, str]]:
    """Names and values of the strings in JSON arguments of any depth, in their order; a list's strings are named by their places."""
    try:
        top = json.loads(arguments or "{}")
    except (ValueError, RecursionError):
        top = arguments
    if isinstance(top, str):
        return [("__value__", top)]
    found: list[tuple[str, str]] = []
    todo = [("", top)]
    while todo:
        name, value = todo.pop()
        if isinstance(value, str) and len(value) >= SHORTEST:
            found.append((name, value))
        elif isinstance(value, (dict, list)):
            inner = value.items() if isinstance(value, dict) else enumerate(value)
            todo.extend(reversed([(str(k), v) for k, v in inner]))
    return found


_PARTS = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))
_VERDICTS = pa.list_(pa.struct([("score", pa.float64()), ("patterns", pa.list_(pa.string()))]))


def strings(arguments: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"name": n, "text": t} for n, t in strings_one(x)] for x in texts.to_pylist()], _PARTS)

    return F.arrow_udf(run, "array<struct<name:string,text:string>>")(arguments)


def _pythons(texts: Column) -> Column:
    """The verdict on each text of an array; null texts are not parsed."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([[None if t is None else dict(zip(("score", "patterns"), python_one(t), strict=True)) for t in row] for row in rows.to_pylist()], _VERDICTS)

    return F.arrow_udf(run, "array<struct<score:double,patterns:array<string>>>")(texts)


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


def _verdict(checks: list[tuple[Column, Column | str, float]]) -> Column:
    """The highest score of the checks that hold, and their names."""
    score = F.greatest(F.lit(0.0), *[F.when(c, F.lit(s)).otherwise(0.0) for c, _, s in checks])
    return F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n, _ in checks])).alias("patterns"))


def shell(text: Column) -> Column:
    """score and patterns of a shell text: output piped to an interpreter, commands within commands, output to places of the system, chains."""
    counted = lambda name, n: F.concat(F.lit(f"shell:{name}(x"), n.cast("string"), F.lit(")"))
    within, chained = F.regexp_count(text, F.lit(r"\$\([^)]{1,200}\)|`[^`]{1,200}`")), F.regexp_count(text, F.lit(r"&&|\|\|"))
    return _verdict([
        (F.regexp_like(text, F.lit(rf"(?i)\|\s*(?:{_any_of(INTERPRETERS)})\b")), "shell:pipe_to_interpreter", 0.88), (within > 0, counted("command_substitution", within), 0.72),
        (F.regexp_like(text, F.lit(rf"(?i)>\s*(?:{_any_of(PLACES)})")), "shell:dangerous_redirect", 0.80), (chained >= 2, counted("command_chaining", chained), 0.55),
    ])


def sql(text: Column, upper: Column) -> Column:
    """score and patterns of an SQL text: words that reach files or the system, statements in a row, comments, unions. upper: the text in capitals."""
    words = [(F.contains(upper, F.lit(w)), f"sql:dangerous_keyword:{w}", 0.90) for w in SQL_WORDS]
    return _verdict([
        *words, (F.regexp_like(text, F.lit(rf"(?i);\s*(?:{_any_of(STATEMENTS)})")), "sql:stacked_statements", 0.80), (F.regexp_like(text, F.lit(r"--\s|#\s|/\*")), "sql:comment_truncation", 0.55),
        (F.contains(upper, F.lit("UNION")) & F.contains(upper, F.lit("SELECT")), "sql:union_select", 0.75),
    ])


def language(text: Column, upper: Column) -> Column:
    """python, sql, shell, whichever has most hints (the first of these at a tie); empty where there is none."""
    n = {k: sum((F.contains(upper if k == "sql" else text, F.lit(h)).cast("int") for h in hints), F.lit(0)) for k, hints in HINTS.items()}
    most = F.greatest(*n.values())
    return F.when(most == 0, "").when(n["python"] == most, "python").when(n["sql"] == most, "sql").otherwise("shell")


def boost(name: Column) -> Column:
    """What an argument's name does to the score."""
    n = F.regexp_replace(F.lower(name), "^[_-]+|[_-]+$", "")
    return F.when(n.isin(*RUN_NAMES), 1.8).when(F.regexp_like(n, F.lit(_any_of(RUN_NAMES))), 1.4).otherwise(1.0)


def dampening(tool: Column) -> Column:
    """What a tool's name does to the score."""
    n = F.replace(F.lower(F.coalesce(tool, F.lit(""))), F.lit("-"), F.lit("_"))
    return F.when(n.isin(*READERS), 0.5).when(F.regexp_like(n, F.lit(_any_of(READING_WORDS))), 0.6).otherwise(1.0)


def scanned(calls: DataFrame, arguments: str = "arguments", tool: str = "tool_name", threshold: float = 0.70, longest: int | None = None, most: int = 10) -> DataFrame:
    """The calls with a struct `code`: detected, confidence, language, patterns (so many at most), scanned_chars, of the worst argument (the first at a tie).

    longest leaves out strings with more characters; none are left out by default.
    """
    read = lambda p: (F.length(p["text"]) >= SHORTEST) & (F.lit(longest is None) | (F.length(p["text"]) <= (longest or 0)))
    rows = calls.withColumn("_parts", F.filter(strings(F.col(arguments)), read))
    capitals = F.transform("_parts", lambda p: F.struct(p["name"].alias("name"), p["text"].alias("text"), F.upper(p["text"]).alias("upper")))
    rows = rows.withColumn("_parts", F.transform(capitals, lambda p: F.struct(p["name"].alias("name"), p["text"].alias("text"), p["upper"].alias("upper"), language(p["text"], p["upper"]).alias("language"))))
    rows = rows.withColumn("_python", _pythons(F.transform("_parts", lambda p: F.when(p["language"] == "python", p["text"]))))

    def judged(p: Column, python: Column) -> Column:
        found = F.when(p["language"] == "python", python).when(p["language"] == "sql", sql(p["text"], p["upper"])).when(p["language"] == "shell", shell(p["text"]))
        return F.struct(p["name"].alias("name"), p["language"].alias("language"), found.alias("found"))

    def weighed(p: Column, i: Column) -> Column:
        score = F.least(F.lit(1.0), F.coalesce(p["found"]["score"], F.lit(0.0)) * boost(p["name"]))
        return F.struct(score.alias("score"), (-i).alias("first"), p["language"].alias("language"), p["found"]["patterns"].alias("patterns"))

    # an array of one element names what is used several times
    worst = F.array_max(F.transform(F.zip_with("_parts", "_python", judged), weighed))
    damped = F.transform(F.array(worst), lambda b: F.struct(F.coalesce(b["score"] * dampening(F.col(tool)), F.lit(0.0)).alias("score"), (F.coalesce(b["score"], F.lit(0.0)) > 0).alias("any"), b["language"].alias("language"), b["patterns"].alias("patterns")))
    chars = F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["text"]))
    code = F.transform(damped, lambda b: F.struct(
        (b["score"] >= threshold).alias("detected"), F.round(b["score"], 4).alias("confidence"), F.when(b["any"], b["language"]).otherwise("").alias("language"),
        F.when(b["any"], F.slice(b["patterns"], 1, most)).otherwise(F.array().cast("array<string>")).alias("patterns"), chars.alias("scanned_chars"),
    ))[0]
    return rows.withColumn("code", code).drop("_parts", "_python")
