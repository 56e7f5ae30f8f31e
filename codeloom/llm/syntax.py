"""Source files that do not parse.

1. ``lex``: each file becomes rows of its distinct adjacent token pairs and of what stands in its brackets
   (windowed reductions: innermost brackets are cut out, checked and replaced by one letter, level by level).
2. Pairs are anti-joined with the pairs that the grammar's productions permit.
3. Bracket contents and top-level statements, distinct over all files, are matched with the productions;
   what matches none condemns the files that hold it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import grammar
from codeloom.llm.lexing import CONTEXTUAL, EXTENSIONS, classes, letters, tokens
from codeloom.session import pin, spread

_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_REDUCED = {"(": "P", "[": "Q", "{": "B", "l": "G"}
_KEPT = 100_000
#: Runs of like list items; one more of them proves nothing.
_RUNS = re.compile(r"([^,;]{1,12},)\1{2,}")


def language(path_column):
    """The language a path claims by its extension, null for others."""
    ext = F.regexp_extract(path_column, r"\.([A-Za-z]+)$", 1)
    return F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[ext]


def _cut(lang: str):
    """A function that cuts the reduced content of a block into statements."""
    words = letters(lang)
    of = lambda names: "".join(words[n] for n in names.split() if n in words)
    if lang == "go":
        header = of("if for switch")
        pieces = re.compile(rf"(?:[{header}][^B]*?B|[^;])+;?|;")
        return lambda text: pieces.findall(text)
    # after a block a new statement begins, unless what follows carries the old one on
    onward = ";,.)dzPQtbmpvlgq&:=AwNc@x" + of("else catch finally while instanceof in as from satisfies extends implements")
    if lang == "java":
        pieces = re.compile(rf"(?<=;)(?![{of('else')}])|(?<=B)(?=[^{onward}M@]|M|@)(?!$)")
        return lambda text: [x for x in pieces.split(text) if x]
    ends = re.escape("insrtPQBcu>g") + of("return break continue this super") + of("async get set static of as from type await yield readonly")
    goes = re.escape(",.;dz)bmpvlgq&:=AwPQt") + of("else catch finally instanceof in as satisfies") + ("" if lang == "typescript" else "")
    breaks = re.compile(rf"(?<=[{ends}])N(?=[^{goes}])")
    pieces = re.compile(rf"(?<=;)(?![{of('else')}])|(?<=B)(?=[^{onward}])(?!$)")

    def cut(text: str) -> list[str]:
        return _joined([x for line in breaks.split(text) for x in pieces.split(line.replace("N", "")) if x], words)

    return cut


_DECORATORS = re.compile(r"(?:@\w(?:d\w)*P?)+")


def _joined(parts: list[str], words: dict[str, str]) -> list[str]:
    """Decorators belong to what follows them, and a while to the do before it."""
    out: list[str] = []
    for part in parts:
        before = out[-1] if out else ""
        if before and (_DECORATORS.fullmatch(before) or (before[0] == words["do"] and part[0] == words["while"])):
            out[-1] += part
        else:
            out.append(part)
    return out


class _Lexer:
    """Turns the files of one language into pairs and signatures."""

    def __init__(self, lang: str):
        self.lang, self.cut, self.words = lang, _cut(lang), letters(lang)
        self.memo: dict[str, tuple[str, ...]] = {}
        if lang == "go":
            ends = "ins)]}c" + "".join(self.words[w] for w in "return break continue fallthrough".split())
            self.ends = re.compile(rf"(?<=[{re.escape(ends)}])N+")
        inside = "".join(self.words[w] for w in "extends super keyof typeof void this readonly const infer".split() if w in self.words) + "".join(self.words[w] for w in CONTEXTUAL[lang].split() if w not in "as")
        before = "ixdMw=(" + ("{};B" if lang == "java" else "") + "".join(self.words[w] for w in CONTEXTUAL[lang].split())
        self.generic = re.compile(rf"(?<=[{before}])l[idqxGQPBNMws,&v=e:@{inside}]*g") if lang in ("java", "typescript") else None

    def lex(self, text: str) -> tuple[list[str], list[str]]:
        row = "".join(classes(self.lang, tokens(self.lang, text)))
        if self.lang == "go":
            row = self.ends.sub(";", row + "N").replace("N", "")
        flat = row.replace("N", "")
        if self.lang == "java":
            row = flat
        pairs = {a + b for a, b in set(zip(flat, flat[1:]))} | ({"EE"} if "E" in flat else set())
        contents: set[str] = set()

        def reduce(found: re.Match) -> str:
            group = found[0]
            contents.add(group)
            return _REDUCED[group[0]]

        while True:
            less = row
            while self.generic and (closed := self.generic.sub(reduce, less)) != less:
                less = closed
            less = _INNER.sub(reduce, less)
            if less == row:
                break
            row = less
        signatures = set()
        for group in contents:
            known = self.memo.get(group)
            if known is None:
                if len(self.memo) > _KEPT:
                    self.memo.clear()
                known = self.memo[group] = self.signatures(group)
            signatures.update(known)
        signatures.update("T" + x for x in self.cut(row))
        if self.lang == "go":
            first = self.cut(row)[:1]
            signatures.add("F" + (first[0][:1] if first else ""))
        return sorted(pairs), sorted(signatures)

    def signatures(self, group: str) -> tuple[str, ...]:
        """The contents of a bracket as strings to check: a kind letter, then class letters."""
        kind, inner = group[0], group[1:-1]
        if kind != "{":
            return (kind + _RUNS.sub(r"\1\1", inner.replace("N", "")),)
        statements = self.cut(inner)
        if len(statements) < 2 and ";" not in inner[:-1]:
            return ("{" + _RUNS.sub(r"\1\1", inner.replace("N", "")),)
        return tuple("S" + x for x in statements)


class _PythonLexer:
    """Python: logical lines, and how their indents follow each other."""

    def __init__(self):
        self.words = letters("python")
        self.follow = {self.words["try"]: self.words["except"] + self.words["finally"]}
        self.after = {self.words[w]: "".join(self.words[x] for x in of.split()) for w, of in {"elif": "if elif", "else": "if elif for while except", "except": "try except", "finally": "try except else"}.items()}

    def lex(self, text: str) -> tuple[list[str], list[str]]:
        found = tokens("python", text[1:] if text[:1] == "﻿" else text)
        kinds = classes("python", found)
        row = "".join(kinds)
        signatures: set[str] = set()
        contents: set[str] = set()

        def reduce(m: re.Match) -> str:
            contents.add(m[0].replace("N", ""))
            return _REDUCED[m[0][0]]

        # indents of logical lines: line ends outside brackets
        depth, indents = 0, []
        indent = found[0].rpartition("\n")[2] if found and kinds[0] == "N" else re.match(r"[ \t]*", text)[0]
        lines: list[str] = []
        current: list[str] = []
        for token, kind in zip(found, kinds):
            if kind == "N" and depth == 0:
                if current:
                    lines.append("".join(current))
                    indents.append(indent)
                    current = []
                indent = token.rpartition("\n")[2]
                continue
            if kind and kind in "([{":
                depth += 1
            elif kind and kind in ")]}":
                depth -= 1
            if kind and kind != "N":
                current.append(kind)
        if current:
            lines.append("".join(current))
            indents.append(indent)
        stack: list[tuple[str, str]] = []  # indent, first letter of the last line there
        header = False
        for k, (line, width) in enumerate(zip(lines, indents)):
            while True:
                less = _INNER.sub(reduce, line)
                if less == line:
                    break
                line = less
            opens = line.endswith(":")
            signatures.add(("H" if opens else "T") + line)
            first = line[0]
            if not stack:
                if width:
                    signatures.add("Dindent")
                stack.append((width, first))
            elif header:
                if not (width.startswith(stack[-1][0]) and len(width) > len(stack[-1][0])):
                    signatures.add("Dblock")
                    if width != stack[-1][0]:
                        break
                else:
                    stack.append((width, ""))
            else:
                while len(stack) > 1 and width != stack[-1][0] and len(width) < len(stack[-1][0]):
                    if stack[-1][1] == self.words["try"]:
                        signatures.add("Dtry")
                    stack.pop()
                if width != stack[-1][0]:
                    signatures.add("Dindent")
                    break
            before = stack[-1][1]
            if before == self.words["try"] and first not in self.follow[before] and k:
                signatures.add("Dtry")
            if first in self.after and before not in self.after[first]:
                signatures.add("Dorder")
            stack[-1] = (stack[-1][0], first)
            header = opens
        if header:
            signatures.add("Dblock")
        if any(first == self.words["try"] for _, first in stack):
            signatures.add("Dtry")
        for group in contents:
            signatures.add(group[0] + _RUNS.sub(r"\1\1", group[1:-1]))
        # a line end separates: only pairs within a line count
        pairs = {a + b for a, b in set(zip(row, row[1:])) if a != "N" and b != "N"} | ({"EE"} if "E" in row else set())
        return sorted(pairs), sorted(signatures)


_LEXERS: dict[str, _Lexer | _PythonLexer] = {}


def lexer(lang: str) -> _Lexer | _PythonLexer:
    if lang not in _LEXERS:
        _LEXERS[lang] = _PythonLexer() if lang == "python" else _Lexer(lang)
    return _LEXERS[lang]


def _lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [lexer(lang).lex((text or "").replace("\r\n", "\n")) for lang, text in zip(batch["lang"], batch["content"])]
        yield pd.DataFrame({"file_path": batch["file_path"], "lang": batch["lang"], "pairs": [r[0] for r in rows], "signatures": [r[1] for r in rows]})


_KINDS = {"T": "top", "S": "statement", "(": "in(", "[": "in[", "{": "in{", "l": "in<", "H": "block"}


def valid_signature(lang: str, signature: str) -> bool:
    """Whether a production covers the signature.  A block of one piece may be an initialiser or a statement."""
    kind, text = signature[0], signature[1:]
    if kind == "D":
        return False
    if kind == "F":
        return text == letters("go")["package"]
    own = grammar.grammar(lang)
    if own.matches(_KINDS[kind], text):
        return True
    return kind == "{" and lang != "python" and own.matches("statement", text)


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = [valid_signature(lang, s) for lang, s in zip(batch["lang"], batch["signature"])]
        yield batch[[not g for g in good]]


def known_files(files: DataFrame) -> DataFrame:
    """(file_path, project, lang, content) of the languages known; rows without a path are dropped, a null content is empty.

    Repeated rows stay: judging a file twice gives the same verdict, and results name each path once.
    """
    own = files.where(F.col("file_path").isNotNull()).select("file_path", "project", F.coalesce("content", F.lit("")).alias("content"))
    return own.withColumn("lang", language(F.col("file_path"))).where(F.col("lang").isNotNull())


def lex(files: DataFrame) -> DataFrame:
    """(file_path, lang, pairs, signatures) of each file."""
    own = spread(files.select("file_path", "lang", "content"))
    return own.mapInPandas(_lexed, "file_path string, lang string, pairs array<string>, signatures array<string>")


def permissible(spark) -> DataFrame:
    """All (lang, pair) that the grammars allow: a few hundred per language, whatever the data."""
    return spark.createDataFrame([(lang, p) for lang in grammar.languages() for p in sorted(grammar.permissible_pairs(lang))], "lang string, pair string")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_path, lang) of files that are no valid text of the language of their extension.

    ``files`` is what ``known_files`` gives.  Empty files are valid but in Go.  A path with several contents is
    invalid if any of them is.  Each path comes once.
    """
    lexed = pin(lex(files), "lexed")
    spark = files.sparkSession
    pairs = lexed.select("file_path", "lang", F.explode("pairs").alias("pair"))
    by_pair = pairs.join(F.broadcast(permissible(spark)), ["lang", "pair"], "left_anti").select("file_path", "lang")
    signatures = lexed.select("file_path", "lang", F.explode("signatures").alias("signature"))
    kinds = signatures.select("lang", "signature").distinct().repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a few rows, each dear to check
    broken = kinds.mapInPandas(_check, "lang string, signature string")
    by_production = signatures.join(broken, ["lang", "signature"], "left_semi").select("file_path", "lang")
    return by_pair.unionByName(by_production).distinct()
