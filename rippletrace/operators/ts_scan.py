"""Top-level declarations, imports and calls of TypeScript and JavaScript files.

A file is first masked: comments, strings, regular expressions and template texts
become blanks of the same length, so brackets and words that are left are code.
Declarations are then found by bracket depth. One Arrow pass, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.exprs import symbol_id
from rippletrace.functions.ordering import spread
from rippletrace.schemas import CALLS, SYMBOL_META

API_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
OPEN, CLOSE = "([{", ")]}"
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_BRACKET = re.compile(r"[(\[{)\]}]")
_CONTINUING_WORD = re.compile(r"(?:in|instanceof|as|satisfies|extends)\b")
_DEFINES = re.compile(r"[ \t]*(?:\{|:\s*[\w<>\[\]|&. ]+\{)")
_ALIAS = re.compile(r"\s*(?:<|=)")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof))\s*$")
_NOT_CALLED = frozenset("if for while switch catch function return typeof in of void delete await yield throw new case do else with import super async instanceof as extends keyof".split())
_CONTINUES = frozenset(".,?:=+-*/%&|^<>([`)}]")
_OPEN_END = frozenset("=,:?|&+-*/%^<(.[{!~")


def mask(code: str) -> str:
    """The code with everything that is not code blanked; line feeds stay."""
    out, i, n = [], 0, len(code)
    nested: list[int] = []  # bracket depth of each open template expression
    depth = 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def template(at: int) -> int:
        start = at
        while at < n:
            if code[at] == "\\":
                at += 2
            elif code[at] == "`":
                out.append(blank(code[start:at]) + "`")
                return at + 1
            elif code.startswith("${", at):
                out.append(blank(code[start:at]) + " {")
                nested.append(depth)
                return at + 2
            else:
                at += 1
        out.append(blank(code[start:n]))
        return n

    while i < n:
        c = code[i]
        if c == "/" and code.startswith("//", i):
            j = code.find("\n", i)
            j = n if j < 0 else j
            out.append(blank(code[i:j]))
            i = j
        elif c == "/" and code.startswith("/*", i):
            j = code.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out.append(blank(code[i:j]))
            i = j
        elif c in "\"'":
            j = i + 1
            while j < n and code[j] != c and code[j] != "\n":
                j += 2 if code[j] == "\\" else 1
            j = min(j, n)
            out.append(c + blank(code[i + 1 : j]) + (c if j < n and code[j] == c else ""))
            i = j + 1 if j < n and code[j] == c else j
        elif c == "`":
            out.append("`")
            i = template(i + 1)
        elif c == "/" and _BEFORE_REGEX.search("".join(out[-40:])[-200:] if out else ""):
            j, inside = i + 1, False
            while j < n and code[j] != "\n" and (inside or code[j] != "/"):
                inside = code[j] == "[" or inside and code[j] != "]"
                j += 2 if code[j] == "\\" else 1
            out.append(blank(code[i : j + 1]))
            i = j + 1
        else:
            if c == "{":
                depth += 1
            elif c == "}":
                if nested and nested[-1] == depth:
                    nested.pop()
                    out.append("}")
                    i = template(i + 1)
                    continue
                depth -= 1
            out.append(c)
            i += 1
    return "".join(out)[:n].ljust(n)


def _matching(text: str, at: int) -> int:
    """Place after the bracket that closes the one at `at`."""
    depth = 0
    for j in range(at, len(text)):
        if text[j] in OPEN:
            depth += 1
        elif text[j] in CLOSE:
            depth -= 1
            if depth <= 0:
                return j + 1
    return len(text)


def _pairs(text: str) -> dict[int, int]:
    """For each bracket that has a partner, of any kind, its partner's place; one pass."""
    pairs, opened = {}, []
    for m in _BRACKET.finditer(text):
        at = m.start()
        if m[0] in OPEN:
            opened.append(at)
        elif opened:
            pairs[at] = opened.pop()
            pairs[pairs[at]] = at
    return pairs


def _line_feeds(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _body(text: str, at: int) -> int:
    """End of a declaration that has a block: after its first block outside types, or at its semicolon."""
    before = ""
    while at < len(text):
        c = text[at]
        if c == "{" and before not in (":", "|", "&", "<", ",", "=") or c == ";":
            return _matching(text, at) if c == "{" else at + 1
        if c in OPEN:
            at = _matching(text, at)
            before = ")"
            continue
        if not c.isspace():
            before = c
        at += 1
    return len(text)


def _statement(text: str, at: int) -> int:
    """End of a statement without its semicolon: at a semicolon, or at a line end that cannot go on."""
    last, last_at = "", at
    while at < len(text):
        c = text[at]
        if c == ";":
            return at
        if c in CLOSE:
            return at
        if c in OPEN:
            at = _matching(text, at)
            last = ")"
            continue
        if c == "\n" and last and last not in _OPEN_END and not (last == ">" and text[max(0, last_at - 1)] == "="):
            j = _skip(text, at)
            if j >= len(text) or text[j] not in _CONTINUES and not _CONTINUING_WORD.match(text, j):
                return at
        if not c.isspace():
            last, last_at = c, at
        at += 1
    return len(text)


_TYPE_ARGUMENTS = re.compile(r"(?<=[\w$])<[\w\s,.<>\[\]|&]*>(?=\s*\()")


def _declarators(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of the declarators of a variable statement."""
    start, angle, valued = at, 0, False
    while at < end:
        c = text[at]
        if c in OPEN:
            at = _matching(text, at)
            continue
        if c == "=" and text[at : at + 2] != "=>":
            valued = True
        elif not valued and c == "<":
            angle += 1
        elif not valued and c == ">" and text[at - 1] != "=":
            angle -= 1
        elif valued and c == "<" and (types := _TYPE_ARGUMENTS.match(text, at)):
            at = types.end()
            continue
        elif c == "," and angle <= 0:
            yield start, at
            start, angle, valued = at + 1, 0, False
        at += 1
    yield start, end


_ARROW = re.compile(r"(?:async\s+)?[A-Za-z_$][\w$]*\s*=>")


def _is_function(text: str) -> bool:
    """Whether a masked initializer is an arrow or function expression."""
    t = text.strip()
    if re.match(r"(?:async\s+)?function\b", t):
        return _body(t, t.index("function") + 8) >= len(t.rstrip())
    if _ARROW.match(t):
        return True
    t = re.sub(r"^async\s*(?=[(<])", "", t)
    if t.startswith("<"):
        t = t[t.find("(") :] if "(" in t else ""
    if not t.startswith("("):
        return False
    rest = t[_matching(t, 0) :].lstrip()
    return rest.startswith("=>") or rest.startswith(":") and "=>" in rest


def _calls(code: str, text: str, first_line: int) -> list[dict]:
    """Call expressions, outer before inner: callee text and line."""
    found, pairs, feeds = [], _pairs(text), _line_feeds(code)
    for m in re.finditer(r"\(", text):
        at = m.start()
        j = at
        while j > 0 and text[j - 1].isspace():
            j -= 1
        end = j
        if j and text[j - 1] == ">":  # type arguments
            depth, k = 0, j
            while k > 0:
                k -= 1
                depth += (text[k] == ">" and text[k - 1 : k] != "=") - (text[k] == "<")
                if depth == 0:
                    break
            if k and (text[k - 1].isalnum() or text[k - 1] in "_$") and text[k] == "<":
                end = j = k
            else:
                continue
        start, need_name = j, True
        while start > 0:
            c = text[start - 1]
            if need_name and (c.isalnum() or c in "_$"):
                while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_$#"):
                    start -= 1
                need_name = False
            elif c in ")]" :
                start = pairs.get(start - 1, 0)
                need_name = True
                c = text[start - 1] if start else ""
                if not (c.isalnum() or c in "_$)]!?." and c):
                    break
                if c in ".?!":
                    need_name = False
            elif c == "." and not need_name or c == "." :
                start -= 1
                if start and text[start - 1] == "?":
                    start -= 1
                while start > 0 and text[start - 1].isspace():
                    start -= 1
                need_name = True
            elif c == "!" and start > 1 and (text[start - 2].isalnum() or text[start - 2] in "_$)]"):
                start -= 1
            else:
                break
        name = code[start:end].strip()
        word = _WORD.match(name)
        if not name or name[0] in ".?" or (word and word[0] == name and name in _NOT_CALLED):
            continue
        if word and word[0] in ("if", "for", "while", "switch", "catch", "return", "await", "new", "typeof", "function"):
            continue
        before = re.search(r"([A-Za-z_$][\w$]*)\s*$", text[max(0, start - 40) : start])
        if before and before[1] in ("function", "new", "get", "set"):
            continue
        stop = pairs[at] + 1 if at in pairs else len(text)
        if word and word[0] == name and _DEFINES.match(text, stop):
            continue  # a method or function definition
        found.append((start + len(code[start:end]) - len(code[start:end].lstrip()), -stop, name))
    return [{"name": name, "line": first_line + bisect_left(feeds, at)} for at, _, name in sorted(found)]


def _references(text: str, first_line: int) -> list[dict]:
    feeds = _line_feeds(text)
    return [{"name": m[1], "line": first_line + bisect_left(feeds, m.start())} for m in re.finditer(r"(?<=[\w$)\]!?])\.\s*([A-Za-z_$][\w$]*)", text)]


_MODIFIERS = frozenset("export default declare async abstract".split())
_RANK = {"function": 0, "class": 1, "interface": 2, "type": 3, "variable": 4}


def parse(path: str, content: str | None) -> tuple[list[dict], list[dict]]:
    """(imports, symbols) of a file, symbols in the order functions, classes, interfaces, types, variables."""
    code = content or ""
    text = mask(code)
    imports, symbols, at = [], [], 0
    feeds = _line_feeds(code)
    line_of = lambda p: bisect_left(feeds, p) + 1

    def add(kind: str, rank: str, name: str, start: int, end: int, exported: bool, split: str):
        own, masked, first = code[start:end], text[start:end], line_of(start)
        symbols.append({
            "kind_rank": _RANK[rank], "pos": start, "name": name, "type": kind, "start_line": first, "end_line": first + own.count("\n"), "exported": exported,
            "signature": own.split(split)[0].strip(), "code": own, "calls": _calls(own, masked, first), "references": _references(masked, first),
        })

    while (at := _skip(text, at)) < len(text):
        start, exported, words = at, False, []
        while (m := _WORD.match(text, at)) and m[0] in _MODIFIERS:
            exported |= m[0] == "export"
            words.append(m[0])
            at = _skip(text, m.end())
        m = _WORD.match(text, at)
        word = m[0] if m else ""
        follow = _skip(text, m.end()) if m else at
        name = _WORD.match(text, follow)
        if word == "import" and not words and text[follow : follow + 1] not in ("(", "."):
            end = _statement(text, follow)
            if quoted := re.search(r"([\"'])([^\"'\n]*)\1\s*$", code[start:end].rstrip()):
                head = text[follow : start + quoted.start()]
                named = re.search(r"\{([^}]*)\}", head)
                names = [x.split()[-3] if " as " in f" {x} " and len(x.split()) >= 3 else x.split()[-1] for x in (named[1].split(",") if named else ()) if x.strip()]
                space = re.search(r"\*\s*as\s+([A-Za-z_$][\w$]*)", head)
                default = re.match(r"(?:type\s+(?!from\b))?([A-Za-z_$][\w$]*)\s*(?:,|from\b)", head)
                imports.append({"source": quoted[2], "imported_names": names, "default_import": default[1] if default else None, "namespace_import": space[1] if space else None, "line": line_of(start)})
            at = end + 1
        elif word == "function":
            star = follow + 1 if text[follow : follow + 1] == "*" else follow
            name = _WORD.match(text, _skip(text, star))
            end = _body(text, m.end())
            add("function", "function", name[0] if name else "anonymous", start, end, exported, "{")
            at = end
        elif word in ("class", "interface") and (name or word == "class"):
            end = _body(text, m.end())
            add(word, word, name[0] if name and name[0] not in ("extends", "implements") else "AnonymousClass", start, end, exported, "{")
            at = end
        elif word == "type" and name and _ALIAS.match(text, name.end()):
            end = _statement(text, follow)
            stop = end + 1 if text[end : end + 1] == ";" else end
            add("type", "type", name[0], start, stop, exported, "=")
            at = max(stop, at + 1)
        elif word in ("const", "let", "var") and not (word == "const" and name and name[0] == "enum"):
            end = _statement(text, m.end())
            for a, b in _declarators(text, m.end(), end):
                a = _skip(text, a)
                b = a + len(text[a:b].rstrip()) if text[a:b].strip() else a
                b = max(b, a + len(code[a:b].rstrip()))
                own = text[a:b]
                equal = next((k for k in re.finditer(r"=(?![=>])", own) if own[k.start() - 1 : k.start()] not in ("=", "!", "<", ">")), None)
                binding = _WORD.match(text, a)
                if a >= b:
                    continue
                label = binding[0] if binding else code[a : _matching(text, a)]
                function = equal is not None and _is_function(text[a + equal.end() : b])
                add("function" if function else "variable", "variable", label, a, b, exported, "=>")
            at = max(end, at) + 1
        else:
            end = _body(text, at) if word in ("enum", "namespace", "module") or words[:1] == ["declare"] else _statement(text, at)
            at = max(end, at) + 1
    if "/api/" in path or path.startswith("app/api/"):
        for s in symbols:
            if s["exported"] and s["name"] in API_METHODS:
                s["type"] = "api_route"
    symbols.sort(key=lambda s: (s["kind_rank"], s["pos"]))
    return imports, symbols


_CALL_TYPE = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))
_IMPORT_TYPE = pa.list_(pa.struct([("source", pa.string()), ("imported_names", pa.list_(pa.string())), ("default_import", pa.string()), ("namespace_import", pa.string()), ("line", pa.int32())]))
_SYMBOL_TYPE = pa.list_(
    pa.struct([("kind_rank", pa.int32()), ("pos", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()), ("signature", pa.string()), ("code", pa.string()), ("calls", _CALL_TYPE), ("references", _CALL_TYPE)])
)
_OUT = (
    "analysis_id string, file_seq int, path string, imports array<struct<source:string,imported_names:array<string>,default_import:string,namespace_import:string,line:int>>, "
    f"symbols array<struct<kind_rank:int,pos:int,name:string,type:string,start_line:int,end_line:int,exported:boolean,signature:string,code:string,calls:{CALLS},references:{CALLS}>>"
)


def _scan(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part = batch.slice(lo, 100)
            done = [parse(p or "", c) for p, c in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            columns = [part.column(0), part.column(1), part.column(2), pa.array([d[0] for d in done], _IMPORT_TYPE), pa.array([d[1] for d in done], _SYMBOL_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, names=["analysis_id", "file_seq", "path", "imports", "symbols"])


def scan(files: DataFrame) -> DataFrame:
    """One row for each file, with its imports and symbols as arrays."""
    return spread(files.select("analysis_id", "file_seq", "path", "content"), "analysis_id", "path").mapInArrow(_scan, _OUT)


def imports(scanned: DataFrame) -> DataFrame:
    return scanned.select("analysis_id", "file_seq", F.col("path").alias("file_path"), F.posexplode("imports").alias("import_seq", "i")).select("analysis_id", "file_seq", "file_path", "import_seq", "i.*")


def symbols(scanned: DataFrame) -> DataFrame:
    """Symbol rows with the order (file_seq, kind_rank, pos)."""
    rows = scanned.select("analysis_id", "file_seq", F.col("path").alias("file_path"), F.explode("symbols").alias("s"))
    return rows.select(
        "analysis_id", "file_seq", "s.kind_rank", "s.pos", symbol_id(F.col("file_path"), F.col("s.type"), F.col("s.name")).alias("id"), "s.name", "s.type", "file_path",
        "s.start_line", "s.end_line", "s.exported", "s.signature", "s.code", "s.calls", "s.references", F.lit(None).cast(SYMBOL_META).alias("metadata"),
    )
