"""Conversations as arrays of messages: parsing, rendering, expansion, checks, and code out of documents."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"^(User|Assistant|System|Tool|问|答)\s*[:：]\s?", re.M)
ROLES = {"User": "user", "Assistant": "assistant", "System": "system", "Tool": "tool", "问": "user", "答": "assistant"}
MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType())])
#: What makes a turn unusable (fixed values; names of products stand as any word).
NON_ANSWER = r"^\s*(?:No response requested\.?|\(no response\)|)\s*$"
UNACTIONABLE = r"^\s*+(?:\[Image:[^\]]*+\]\s*+)++$|^\s*+/[a-z][a-z-]{1,20}\s*+$"  # possessive, so that no repeated group recurses
ERROR = (
    r"^\s*(?:API [Ee]rror|Request timed out|\[?Request interrupted by user|Prompt is too long|\w+'s response was cut off"
    r"|You're out of usage credits|You've (?:hit|reached) your|Please run /|Run /usage-credits|Credit balance)"
)
MARKUP = r"(?:^|\n)\s*<(?:\w+:)?(?:invoke|function_calls)\b"
REFUSED = r"The user doesn't want to proceed with this tool use|tool use was rejected"
MACHINE = (
    r"<(?:task-notification|local-command-stdout|local-command-stderr|bash-stdout|bash-stderr|local-command-caveat|command-name|command-message|command-args|system-reminder|cross-session-message|user-prompt-submit-hook)>"
    r"|Caveat: The messages below|Another \w+ session sent a message|\[SYSTEM NOTIFICATION|\[(?:Your|The|This) [a-z]"
)


def parse(text: str | None) -> list[dict]:
    """Messages of a text whose turns begin with a role's name (V3); a text without a role is no conversation."""
    if not text:
        return []
    marks = list(TURN.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [{"role": ROLES[m.group(1)], "content": text[m.end() : e].strip()} for m, e in zip(marks, ends)]


@F.pandas_udf(ArrayType(MESSAGE))
def messages(text: pd.Series) -> pd.Series:
    """parse() of each text."""
    return text.map(parse)


def render(ms: Column, system: str | None = None) -> Column:
    """All messages between their marks (V1)."""
    head = f"{START}system\n{system}{END}\n" if system else ""
    return F.concat(F.lit(head), F.array_join(F.transform(ms, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(f"{END}\n"))), ""))


def prompt(question: Column, system: str | None = None) -> Column:
    """A question up to the assistant's opening mark (V1)."""
    head = f"{START}system\n{system}{END}\n" if system else ""
    return F.concat(F.lit(f"{head}{START}user\n"), question, F.lit(f"{END}\n{START}assistant\n"))


def agentic_pairs(df: DataFrame, key: str, ms: str) -> DataFrame:
    """key, turn, prompt, completion for every assistant turn, all turns before it in the prompt (V2)."""
    t = df.select(key, F.col(ms).alias("_m"), F.posexplode(ms).alias("turn", "m")).where("m.role = 'assistant'")
    before = F.when(F.col("turn") > 0, F.slice("_m", F.lit(1), F.col("turn"))).otherwise(F.array().cast(ArrayType(MESSAGE)))
    return t.select(key, "turn", F.concat(render(before), F.lit(f"{START}assistant\n")).alias("prompt"), F.concat("m.content", F.lit(END)).alias("completion"))


def unusable(ms: Column) -> Column:
    """Why a conversation cannot be used, the first reason, or null."""
    first = F.get(ms, 0)
    some = lambda role, pattern: F.exists(ms, lambda m: (m["role"] == role) & m["content"].rlike(pattern))
    orphan = F.exists(F.sequence(F.lit(0), F.size(ms) - 1), lambda i: (F.get(ms, i)["role"] == "tool") & ((i == 0) | (F.get(ms, i - 1)["role"] != "assistant")))
    return (
        F.when(F.size(ms) < 2, "few_turns").when(first["role"] != "user", "opening_role").when(first["content"].rlike(UNACTIONABLE), "unactionable")
        .when(F.forall(ms, lambda m: (m["role"] != "assistant") | m["content"].rlike(NON_ANSWER)), "no_answer").when(some("assistant", ERROR), "error").when(some("assistant", MARKUP), "broken_call")
        .when(some("tool", REFUSED), "refused").when(F.exists(ms, lambda m: m["content"].rlike(r"<\|im_(?:start|end)\|>")), "marks").when(F.substring(first["content"], 1, 600).rlike(MACHINE), "machine")
        .when(~F.exists(ms, lambda m: m["role"] == "assistant"), "no_assistant").when(orphan, "orphan_tool")
    )


def episode_key(ms: Column) -> Column:
    """Opening 120 and final 60 characters."""
    return F.struct(F.substring(F.get(ms, 0)["content"], 1, 120).alias("a"), F.substring(F.try_element_at(ms, F.lit(-1))["content"], 1, 60).alias("b"))


def message_stats(df: DataFrame, ms: str) -> DataFrame:
    """Per role: messages, characters, longest."""
    m = df.select(F.explode(ms).alias("m"))
    return m.groupBy("m.role").agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"), F.max(F.length("m.content")).alias("longest"))


def with_thinking(question: Column, thinking: Column, answer: Column) -> Column:
    """Question and answer with the thinking, if any, in its own tags (V4)."""
    t = F.trim(F.coalesce(thinking, F.lit("")))
    return F.concat(prompt(question), F.when(t != "", F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n"))).otherwise(""), answer, F.lit(END))


def output_reason(raw: Column) -> Column:
    """empty, bad_json (an opening brace that does not parse), no_text, or null (V5)."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    parsed = F.try_parse_json(t)
    return F.when(t == "", "empty").when(t.startswith("{") & parsed.isNull(), "bad_json").when(t.startswith("{") & F.try_variant_get(parsed, "$.text", "string").isNull(), "no_text")


def longest_turn(ms: Column) -> Column:
    """Characters of the longest prefix that ends in an assistant turn: what must fit (V9)."""
    lens = F.transform(ms, lambda m: F.length(m["content"]) + F.length(m["role"]) + len(START) + len(END) + 2)
    upto = lambda i: F.aggregate(F.slice(lens, 1, i + 1), F.lit(0), lambda a, x: a + x)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ms) - 1, F.lit(0))), lambda i: F.get(ms, i)["role"] == "assistant")
    return F.coalesce(F.array_max(F.transform(at, upto)), F.lit(0))


def fences(text: str | None) -> list[dict]:
    """Language and body of each fenced block; an open fence runs to the end."""
    out, body, lang = [], None, ""
    for line in (text or "").split("\n"):
        if line.lstrip().startswith("```"):
            if body is None:
                body, lang = [], line.strip().strip("`").strip()
            else:
                out.append({"lang": lang, "code": "\n".join(body)})
                body = None
        elif body is not None:
            body.append(line)
    if body is not None:
        out.append({"lang": lang, "code": "\n".join(body)})
    return out


@F.pandas_udf(ArrayType(StructType([StructField("lang", StringType()), StructField("code", StringType())])))
def code_blocks(text: pd.Series) -> pd.Series:
    """fences() of each text."""
    return text.map(fences)


def _tree(text: str | None):
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_functions(text: str | None) -> list[dict]:
    """name, docstring, stub and body of each top-level function with a docstring (V6, V7)."""
    tree, out = _tree(text), []
    if tree is None:
        return out
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and (doc := ast.get_docstring(node)):
            source = ast.get_source_segment(text, node) or ""
            first = node.body[1] if len(node.body) > 1 else None
            cut = sum(len(x) for x in source.splitlines(keepends=True)[: first.lineno - node.lineno]) if first else len(source)
            out.append({"name": node.name, "doc": doc, "stub": source[:cut], "body": source[cut:]})
    return out


def top_imports(text: str | None) -> list[str]:
    """Modules imported at the top level, by their first name."""
    tree = _tree(text)
    if tree is None:
        return []
    names = set()
    for node in tree.body:
        if isinstance(node, ast.Import):
            names.update(a.name.split(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            names.add(node.module.split(".")[0])
    return sorted(names)


@F.pandas_udf(ArrayType(StructType([StructField(k, StringType()) for k in ("name", "doc", "stub", "body")])))
def function_pairs(text: pd.Series) -> pd.Series:
    """python_functions() of each text."""
    return text.map(python_functions)


@F.pandas_udf(ArrayType(StringType()))
def imports(text: pd.Series) -> pd.Series:
    """top_imports() of each text."""
    return text.map(top_imports)


def tested_modules(df: DataFrame, repo: str, path: str, text: str) -> DataFrame:
    """Test files and the file of the same repository that each imports: repo, test, module (V11). One equi join by repository and module name."""
    t = df.where(F.col(repo).isNotNull() & F.col(path).isNotNull()).select(repo, path, imports(text).alias("names"), F.regexp_extract(path, r"([^/]+)\.py$", 1).alias("stem"))
    tests = t.where(F.col("stem").rlike("^test_|_test$")).select(F.col(repo).alias("repo"), F.col(path).alias("test"), F.explode("names").alias("stem"))
    return tests.join(t.where(~F.col("stem").rlike("^test_|_test$")).select(F.col(repo).alias("repo"), F.col(path).alias("module"), "stem"), ["repo", "stem"]).select("repo", "test", "module")


def prose_pairs(df: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """key, prompt, completion: a text cut at the paragraph end nearest its middle, both parts long enough (V8)."""

    @F.pandas_udf(StructType([StructField("prompt", StringType()), StructField("completion", StringType())]))
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            ends = [m.end() for m in re.finditer(r"\n\s*\n", t or "")]
            at = min(ends, key=lambda e: abs(e - len(t) / 2), default=None)
            ok = at is not None and at >= least and len(t) - at >= least
            rows.append((t[:at], t[at:]) if ok else (None, None))
        return pd.DataFrame(rows, columns=["prompt", "completion"])

    return df.select(key, cut(F.col(text)).alias("p")).where("p.prompt is not null").select(key, "p.prompt", "p.completion")
