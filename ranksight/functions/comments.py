"""Comments of source files as blocks {start, end, text, sig}; ``sig`` is the line of code a comment belongs to.

Languages with ``/* */`` share one scanner: a regular expression eats code and string literals up to a comment mark.
Lines count from 1. A ``#`` inside a Python string counts as a comment.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksight.functions.markdown import pack
from ranksight.settings import CHUNK_SIZE, COMMENT_STYLES

Block = dict[str, int | str]

_CODE = {
    "c": re.compile(r"""(?:[^"'/]|/(?![/*])|"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$))*"""),
    "sql": re.compile(r"""(?:[^'/-]|/(?!\*)|-(?!-)|'[^']*(?:'|$))*"""),
}
_MARK = {"c": "//", "sql": "--"}
_INLINE = re.compile(r"/\*.*?\*/")
_YAML = re.compile(r"""(?:[^'"#]|'[^']*(?:'|$)|"[^"]*(?:"|$)|(?<! )(?<!^)#)*""")


def next_code(lines: list[str], after: int, mark: str) -> str:
    """The first line from index ``after`` on that is neither blank nor begins with a comment mark."""
    return next((s for s in (x.strip() for x in lines[after:]) if s and not s.startswith(mark)), "")


def bare_code(line: str, style: str) -> str:
    """A line of code without a trailing comment."""
    if style in _MARK:
        return _INLINE.sub("", line).partition(_MARK[style])[0].rstrip() if _MARK[style] in line else _INLINE.sub("", line)
    if style == "yml":
        end = _YAML.match(line).end()
        return line[:end].rstrip() if end < len(line) else line
    return line


def _block(start: int, end: int, text: str, sig: Callable[[], str] | str) -> list[Block]:
    text = text.strip()
    return [{"start": start, "end": end, "text": text, "sig": sig if isinstance(sig, str) else sig()}] if text else []


def _slash_star(lines: list[str], style: str) -> list[Block]:
    code, mark, out, i, pos = _CODE[style], _MARK[style], [], 0, 0
    while i < len(lines):
        line = lines[i]
        at = code.match(line, pos).end()
        before, here = line[pos:at].strip(), i
        behind = lambda j: bare_code(next_code(lines, j, mark), style)
        if line.startswith("/*", at):
            close = line.find("*/", at + 2)
            if close >= 0:  # the rest of such a line is not looked at
                out += _block(i + 1, i + 1, line[at + 2 : close], lambda: before or behind(here + 1))
                i, pos = i + 1, 0
                continue
            j = next((j for j in range(i + 1, len(lines)) if "*/" in lines[j]), None)
            if j is None:
                out += _block(i + 1, len(lines), "\n".join([line[at + 2 :], *lines[i + 1 :]]), before if style == "c" else "")
                break
            close = lines[j].find("*/")
            text = "\n".join([line[at + 2 :], *lines[i + 1 : j], lines[j][:close]])
            out += _block(i + 1, j + 1, text, (lambda: before or behind(j + 1)) if style == "c" else (lambda: behind(j + 1)))
            i, pos = j, close + 2
            continue
        if line.startswith(mark, at):
            out += _block(i + 1, i + 1, line[at + 2 :], lambda: before or behind(here + 1))
        i, pos = i + 1, 0
    return out


def _python(lines: list[str]) -> list[Block]:
    out, i = [], 0
    while i < len(lines):
        bare = lines[i].strip()
        quote = bare[:3] if bare.startswith(("'''", '"""')) else None
        if quote is None:
            code, mark, text = lines[i].partition("#")
            if mark:
                out += _block(i + 1, i + 1, text, code.strip() or next_code(lines, i + 1, "#"))
            i += 1
            continue
        if len(bare) > 3 and bare.endswith(quote):
            end, text = i + 1, bare[3:-3]
        else:
            j = next((j for j in range(i + 1, len(lines)) if lines[j].rstrip().endswith(quote)), None)
            end = len(lines) if j is None else j + 1
            inner = lines[i + 1 : end]
            if j is not None:
                inner[-1] = inner[-1].rstrip()[:-3]
            text = "\n".join([bare[3:], *inner])
        out += _block(i + 1, end, text, next_code(lines, end, "#"))
        i = end
    return out


def _hash(lines: list[str]) -> list[Block]:
    return [b for i, (code, _, text) in enumerate(x.partition("#") for x in lines) for b in _block(i + 1, i + 1, text, code.strip() or next_code(lines, i + 1, "#"))]


def _yaml(lines: list[str]) -> list[Block]:
    out = []
    for i, line in enumerate(lines):
        at = len(line) - len(line.lstrip()) if line.lstrip().startswith("#") else _YAML.match(line).end()
        out += _block(i + 1, i + 1, line[at + 1 :], bare_code(line[:at].strip() or next_code(lines, i + 1, "#"), "yml"))
    return out


def _powershell(lines: list[str]) -> list[Block]:
    text, out = "\n".join(lines), []
    for m in re.finditer(r"<#(.*?)#>", text, re.DOTALL):
        start, inner = text.count("\n", 0, m.start()) + 1, m.group(1).strip()
        out += _block(start, start + inner.count("\n"), inner, next_code(lines, start, "#"))
    return out + [b for b in _hash([" " if x.lstrip().startswith("<#") else x for x in lines])]


def extract_comments(style: str | None, text: str | None) -> list[Block]:
    """Comment blocks of a text in one of the styles c, py, sql, yml, ps1, hash (any other counts as hash)."""
    lines = (text or "").split("\n")
    if style in _CODE:
        return _slash_star(lines, style)
    return {"py": _python, "yml": _yaml, "ps1": _powershell}.get(style, _hash)(lines)


def comment_chunks(path: str, blocks: list[Block], size: int = CHUNK_SIZE) -> list[dict]:
    """Blocks packed to at most ``size`` characters; the last block of a chunk also begins the next one."""
    spans = pack([len(b["text"]) for b in blocks], size, lambda last, nxt: last <= size)
    out = []
    for a, b in spans:
        part = blocks[a:b]
        text, sig = "\n\n".join(x["text"] for x in part), next((x["sig"] for x in part if x["sig"]), "")
        out.append({"file_path": path, "line": part[0]["start"], "heading": "", "text": text, "sig": sig, "text_for_embedding": f"[{path}:#{part[0]['start']}]" + (f" {sig}" if sig else "") + f"\n\n{text}"})
    return out


def style_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "hash" if name == "CMakeLists.txt" else COMMENT_STYLES.get(name.rsplit(".", 1)[-1].lower(), "hash")


def chunk_sources(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(file_path, line, heading, text, sig, text_for_embedding) of the comments of source files; none for null."""
    kind = "array<struct<file_path: string, line: int, heading: string, text: string, sig: string, text_for_embedding: string>>"

    @F.pandas_udf(kind)
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([comment_chunks(p, extract_comments(style_of(p), t)) if p is not None else [] for p, t in zip(paths, texts)])

    return files.select(F.explode(run(F.col(path), F.col(text))).alias("chunk")).select("chunk.*")
