"""Calls, methods and types of a source file.

Python files go through the standard library's parser. Java, Kotlin, JavaScript, TypeScript and Go go through a scanner of
brackets and names, which sees declarations by their shape; it does not follow macros, generics with braces or nested lambdas'
parameters. Languages without a reader are named by coverage_gaps().
"""

from __future__ import annotations

import ast
import re

from tracelake.extractors import patterns as P
from tracelake.functions import vocabulary as V

LANGUAGES = ("java", "kotlin", "python", "javascript", "typescript", "tsx", "go")
NO_FIELDS = ("javascript",)

_KEYWORDS = frozenset("if for while switch catch return new throw else do try synchronized when fun func function super this typeof sizeof await yield assert case".split())
_OWN_KEYWORDS = {"go": frozenset(("defer", "go", "select"))}
_CALL = re.compile(r"(?:\b((?:[A-Za-z_]\w*(?:\(\))?\s*(?:\?\.|\.)\s*)*))?\b([A-Za-z_]\w*)\s*\(")
_TYPE = re.compile(r"\b(class|interface|enum|record|object)\s+([A-Za-z_]\w*)(?:<[^>{]*>)?\s*(\([^)]*\))?([^{;]{0,400})\{")
_GO_TYPE = re.compile(r"\btype\s+([A-Za-z_]\w*)\s+(struct|interface)\s*\{")
_METHODS = {
    "java": re.compile(r"(?:^|[;{}\n])[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]{1,80}>\s+)?[\w<>\[\],.?]+(?:\s*\[\])?[ \t]+([A-Za-z_]\w*)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w.,\s]+)?([{;])"),
    "kotlin": re.compile(r"\bfun\s+(?:<[^>]{1,80}>\s+)?(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)[^{=\n]*([{=\n])"),
    "javascript": re.compile(r"(?:\bfunction\s+|(?:^|[;{}\n])[ \t]*(?:(?:public|private|protected|static|async|get|set)\s+)*)([A-Za-z_$][\w$]*)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*[\w<>\[\]|. ]+)?\s*([{])"),
    "go": re.compile(r"\bfunc\s+(?:\(\s*(\w+)\s+\*?(\w+)[^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)[^{\n]*(\{)"),
}
_METHODS["typescript"] = _METHODS["tsx"] = _METHODS["javascript"]


def blanked(text: str, language: str) -> str:
    """The text with comments and the insides of strings as spaces, so brackets and names in them do not count."""
    rx = r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" + ("|`[^`]*`" if language in ("javascript", "typescript", "tsx", "go") else "")

    def gone(m: re.Match[str]) -> str:
        s = m[0]
        keep = 0 if s[0] == "/" else 3 if s.startswith('"""') else 1
        return s[:keep] + re.sub(r"[^\n]", " ", s[keep : len(s) - keep]) + s[len(s) - keep :] if keep else re.sub(r"[^\n]", " ", s)

    return re.sub(rx, gone, text, flags=re.DOTALL)


def closing(text: str, at: int, pair: str) -> int:
    """Where the bracket opened at `at` closes; the end of the text if it does not."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(text)


def split_arguments(text: str) -> list[str]:
    """Arguments between commas outside brackets and strings."""
    out, depth, begin, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[k - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[begin:k])
            begin = k + 1
    return [a.strip()[:120] for a in [*out, text[begin:]] if a.strip()]


def parameter_names(text: str, language: str) -> list[str]:
    names = []
    for p in split_arguments(re.sub(r"@\w+(\([^)]*\))?", " ", text)):
        p = p.split("=")[0].strip()
        first = language in ("kotlin", "typescript", "tsx", "go", "javascript")
        found = re.findall(r"[A-Za-z_$][\w$]*", p)
        found = [x for x in found if x not in ("val", "var", "vararg", "final", "readonly", "public", "private", "protected")]
        if found:
            names.append(found[0] if first else found[-1])
    return names


def _observe_call(f, symbol: str, receiver: str | None, line: int, text: str, arguments: list[str], evidence: bool, names: dict[str, str]) -> None:
    hint = any(h in text for h in V.SQL_CALL_HINTS)
    if symbol in V.SQL_EXECUTION_NAMES or symbol in V.SQL_ORM_NAMES or hint or symbol in P.SCRIPT_CALLS:
        from tracelake.extractors.scan import posture

        detail = {"symbol": symbol, "receiver": receiver, "receiver_is_database": database_receiver(receiver), "library_hint": hint, "file_sql_evidence": evidence, "parameterised": posture(text, f.text, names), "arguments": arguments, "raw": text[:160]}
    else:
        detail = {"symbol": symbol, "receiver": receiver, "arguments": arguments}
    f.add(line, "reference", "call-site", detail, "high")
    if symbol in P.SCRIPT_CALLS:
        f.add(line, "sink", "script-exec", {"symbol": symbol, "raw": text[:120]}, "high", data="raw-script-expression")


def database_receiver(receiver: str | None) -> bool:
    """The same test as functions.fields.is_database_receiver, for one name."""
    last = (receiver or "").rsplit(".", 1)[-1].strip()
    tokens = [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+", last)]
    return bool(last) and any(t in V.DATABASE_RECEIVERS for t in (last.lower(), *tokens, *map("".join, zip(tokens, tokens[1:], strict=False))))


def declarations(f) -> None:
    """Adds calls, methods and types of a file, and the enclosing class and method of all its nodes."""
    from tracelake.extractors.scan import is_statement, symbols

    evidence = bool(P.SQL_LITERAL.search(f.text) or P.SQL_IMPORT.search(f.text))
    names = symbols(f.text, is_statement)
    if f.language == "python":
        spans = _python(f, evidence, names)
    elif f.language in _METHODS:
        spans = _scanned(f, evidence, names)
    else:
        return
    # Interval join: the innermost method around each node.
    for n in f.nodes:
        around = [s for s in spans if s[0] <= n["line"] <= s[1]]
        if around:
            s = min(around, key=lambda s: s[1] - s[0])
            n["detail"] |= {"enclosing_class": s[2], "enclosing_method": s[3]}


def _python(f, evidence: bool, names: dict[str, str]) -> list[tuple]:
    try:
        tree = ast.parse(f.text)
    except SyntaxError as e:
        raise ValueError("syntax") from e
    spans: list[tuple] = []

    def visit(node: ast.AST, owner: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(x, ast.ClassDef):
                fields = {t.target.id: ast.unparse(t.annotation) for t in x.body if isinstance(t, ast.AnnAssign) and isinstance(t.target, ast.Name)}
                for t in ast.walk(x):
                    if isinstance(t, ast.FunctionDef) and t.name == "__init__":
                        types = {a.arg: ast.unparse(a.annotation) for a in t.args.args if a.annotation}
                        for s in ast.walk(t):
                            if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Attribute) and isinstance(s.value, ast.Name) and s.value.id in types:
                                fields[s.targets[0].attr] = types[s.value.id]
                bases = [ast.unparse(b) for b in x.bases]
                f.add(x.lineno, "reference", "type-decl", {"class": x.name, "fields": fields, "supertypes": bases, "is_interface": any(b.split("[")[0] in ("ABC", "Protocol", "abc.ABC") for b in bases), "symbol": x.name}, "high")
                inner = x.name
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                params = [a.arg for a in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs) if a.arg not in ("self", "cls")]
                f.add(x.lineno, "reference", "method-decl", {"class": owner, "method": x.name, "params": params, "start_line": x.lineno, "end_line": x.end_lineno, "symbol": x.name}, "high")
                spans.append((x.lineno, x.end_lineno or x.lineno, owner or "", x.name))
            elif isinstance(x, ast.Call):
                at = x.func
                if isinstance(at, (ast.Name, ast.Attribute)):
                    symbol, receiver = (at.id, None) if isinstance(at, ast.Name) else (at.attr, ast.unparse(at.value))
                    _observe_call(f, symbol, receiver, x.lineno, ast.get_source_segment(f.text, x) or "", [ast.unparse(a)[:120] for a in x.args], evidence, names)
            visit(x, inner)

    visit(tree, None)
    return spans


def _scanned(f, evidence: bool, names: dict[str, str]) -> list[tuple]:
    text = blanked(f.text, f.language)
    keywords = _KEYWORDS | _OWN_KEYWORDS.get(f.language, frozenset())
    types: list[tuple[int, int, str]] = []
    if f.language == "go":
        for m in _GO_TYPE.finditer(text):
            end = closing(text, m.end() - 1, "{}")
            body = text[m.end() : end]
            fields = dict(re.findall(r"^\s*([A-Za-z_]\w*)\s+\*?([A-Za-z_][\w.]*)", body, re.MULTILINE)) if m[2] == "struct" else {}
            embedded = re.findall(r"^\s*\*?([A-Za-z_][\w.]*)\s*$", body, re.MULTILINE)
            f.add(f.line(m.start()), "reference", "type-decl", {"class": m[1], "fields": fields, "supertypes": embedded, "is_interface": m[2] == "interface", "symbol": m[1]}, "high")
    else:
        for m in _TYPE.finditer(text):
            end = closing(text, m.end() - 1, "{}")
            types.append((m.start(), end, m[2]))
            heads = re.sub(r"\b(extends|implements|permits)\b|:", ",", re.sub(r"\([^)]*\)|<[^<>]*>", "", m[4]))
            supers = [s.split(".")[-1] for s in re.findall(r"[A-Za-z_][\w.]*", heads) if s not in ("by", "where", "sealed")]
            f.add(f.line(m.start(2)), "reference", "type-decl", {"class": m[2], "fields": _fields(f.language, m[3] or "", text[m.end() : end]), "supertypes": supers, "is_interface": m[1] == "interface", "symbol": m[2]}, "high")
    owner_at = lambda at: min(((e - b, n) for b, e, n in types if b <= at <= e), default=(0, None))[1]
    spans: list[tuple] = []
    heads: set[int] = set()
    for m in _METHODS[f.language].finditer(text):
        go = f.language == "go"
        name, params, opens = (m[3], m[4], m.start(5)) if go else (m[1], m[2], m.start(3))
        at = m.start(3) if go else m.start(1)
        if name in keywords:
            continue
        owner = m[2] if go else owner_at(at)
        end = closing(text, opens, "{}") if text[opens] == "{" else opens
        detail = {"class": owner, "method": name, "params": parameter_names(f.text[m.start(4 if go else 2) : m.end(4 if go else 2)], f.language), "start_line": f.line(at), "end_line": f.line(min(end, len(text) - 1)), "symbol": name}
        if go and m[1]:
            detail["self_name"] = m[1]
        f.add(f.line(at), "reference", "method-decl", detail, "high")
        heads.add(at)
        if text[opens] in "{=":
            spans.append((detail["start_line"], detail["end_line"], owner or "", name))
    for m in _CALL.finditer(text):
        if m[2] in keywords or m.start(2) in heads:
            continue
        end = closing(text, m.end() - 1, "()")
        before = text[max(0, m.start() - 12) : m.start()]
        if re.search(r"\b(new|class|interface|fun|func|function)\s+$", before) or before.endswith("@"):
            continue
        receiver = re.sub(r"\s+|\?", "", m[1] or "").rstrip(".") or None
        _observe_call(f, m[2], receiver, f.line(m.start(2)), f.text[m.start() : end + 1], split_arguments(f.text[m.end() : end]), evidence, names)
    return spans


def _fields(language: str, head: str, body: str) -> dict[str, str]:
    """Types of a class's fields by name, of its constructor in Kotlin and TypeScript too."""
    flat, depth = [], 0
    for c in body:
        depth += (c == "{") - (c == "}")
        flat.append(c if not depth or c == "\n" else " ")
    own = "".join(flat)
    if language == "java":
        return {n: t for t, n in re.findall(r"(?:private|protected|public|final|static|\s)+\s([A-Z]\w*)(?:<[^>]*>)?\s+([a-z_]\w*)\s*[;=]", " " + own)}
    pairs = re.findall(r"\b(?:val|var|private|public|protected|readonly)\s+(?:val\s+|var\s+|readonly\s+)*([A-Za-z_]\w*)\s*\??\s*:\s*([A-Z]\w*)", head + " " + body)
    if language in ("typescript", "tsx"):
        pairs += re.findall(r"^\s*([A-Za-z_]\w*)\s*\??\s*:\s*([A-Z]\w*)\s*;", own, re.MULTILINE)
    return dict(pairs)


def coverage_gaps(languages: list[str]) -> list[str]:
    """What the readers cannot give for a repository's languages, one note each."""
    out = [f"{x}: limited extraction, no call graph" for x in sorted(set(languages)) if x not in LANGUAGES and x != "config"]
    return out + [f"{x}: limited extraction, no field types" for x in sorted(set(languages)) if x in NO_FIELDS]
